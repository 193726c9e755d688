"""Score, loss and decision expressions over logits and probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def calibrated(logit, temperature) -> Column:
    """Probability of a logit scaled by a temperature."""
    if not isinstance(temperature, Column):
        temperature = F.lit(float(temperature))
    return sigmoid(logit / F.greatest(temperature, F.lit(1e-6)))


def tta(logit, flipped) -> Column:
    """Test-time average of the two views' logits."""
    return (logit + flipped) / F.lit(2.0)


def fused(logits, weights, bias: float = 0.0) -> Column:
    """Weighted logits of several branches with the bias inside the sigmoid."""
    total = F.lit(float(bias))
    for weight, logit in zip(weights, logits):
        total = total + F.lit(float(weight)) * logit
    return sigmoid(total)


def softplus_loss(logit, target) -> Column:
    """Binary cross entropy of a logit, in the form that does not overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def bce_smoothed(logit, label, smoothing: float = 0.05) -> Column:
    """Cross entropy against labels pulled towards one half."""
    return softplus_loss(logit, label * F.lit(1.0 - smoothing) + F.lit(0.5 * smoothing))


def focal_loss(logit, label, gamma: float = 2.0, alpha: float = 0.5) -> Column:
    """Cross entropy that fades on rows the model already gets right."""
    p = sigmoid(logit)
    right = F.when(label == 1, p).otherwise(F.lit(1.0) - p)
    balance = F.when(label == 1, F.lit(alpha)).otherwise(F.lit(1.0 - alpha))
    return balance * F.pow(F.lit(1.0) - right, F.lit(gamma)) * softplus_loss(logit, label)


def log_sigmoid(z) -> Column:
    return F.least(z, F.lit(0.0)) - F.log1p(F.exp(-F.abs(z)))


def bernoulli_kl(logit_p, logit_q) -> Column:
    """KL divergence between the two Bernoulli outcomes of a pair of logits."""
    p = F.exp(log_sigmoid(logit_p))
    return (p * (log_sigmoid(logit_p) - log_sigmoid(logit_q))
            + (F.lit(1.0) - p) * (log_sigmoid(-logit_p) - log_sigmoid(-logit_q)))

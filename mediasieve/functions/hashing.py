"""Hash, modulo, Hamming and band-key expressions, all JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 64


def sha(content) -> Column:
    """sha256 hex text of a binary or string column."""
    return F.sha2(content, 256)


def hex_number(hex_text, start: int, digits: int) -> Column:
    """``digits`` hex digits from 1-based ``start`` as a non-negative BIGINT (at most 15)."""
    return F.conv(F.substring(hex_text, start, digits), 16, 10).cast("bigint")


def hex_mod(hex_text, modulus: int, digits: int = 64) -> Column:
    """A wide hex number modulo a small integer without big-integer arithmetic.

    The digits are cut in 15-digit pieces that fit BIGINT; each piece counts
    with its power of 16 reduced by the modulus.
    """
    total = F.lit(0).cast("bigint")
    for start in range(1, digits + 1, 15):
        width = min(15, digits - start + 1)
        weight = pow(16, digits - (start + width - 1), modulus)
        total = total + (hex_number(hex_text, start, width) % modulus) * F.lit(weight).cast("bigint")
    return total % modulus


def uniform(key) -> Column:
    """A portable uniform in [0, 1): the first 52 bits of sha256(key)."""
    return hex_number(sha(key), 1, 13).cast("double") / F.lit(float(2**52))


def seed64(text) -> Column:
    """The first 8 bytes of sha256(text) as a signed 64-bit seed."""
    return F.conv(F.substring(sha(text), 1, 16), 16, -10).cast("bigint")


def hamming(left, right) -> Column:
    """Number of differing bits of two 64-bit hashes."""
    return F.bit_count(left.bitwiseXOR(right))


def from_unsigned(text) -> Column:
    """Unsigned decimal text to the signed BIGINT with the same 64 bits."""
    return F.conv(text, 10, -10).cast("bigint")


def to_unsigned(value) -> Column:
    """Signed BIGINT to unsigned decimal text, used only at export."""
    return F.conv(F.hex(value), 16, 10)


def from_bits(bits) -> Column:
    """Text of 64 binary digits, most significant first, to signed BIGINT."""
    return F.conv(bits, 2, -10).cast("bigint")


def one_bit(position) -> Column:
    """A BIGINT with only the given bit set."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), position.cast("int"))


def flip_mask(digest, flips, most: int, start: int = 3) -> Column:
    """Up to ``most`` bits chosen by a digest, as many as ``flips`` says."""
    none = F.lit(0).cast("bigint")
    mask = none
    for i in range(most):
        bit = one_bit(hex_number(digest, start + 2 * i, 2) % HASH_BITS)
        mask = mask.bitwiseOR(F.when(flips > i, bit).otherwise(none))
    return mask


def band_ranges(bands: int) -> list[tuple[int, int]]:
    """Bit ranges [low, high) that cut 64 bits in nearly equal bands."""
    return [(i * HASH_BITS // bands, (i + 1) * HASH_BITS // bands) for i in range(bands)]


def band_value(value, low: int, high: int) -> Column:
    """Bits [low, high) of a 64-bit hash."""
    mask = F.lit((1 << (high - low)) - 1).cast("bigint")
    return F.shiftrightunsigned(value, low).bitwiseAND(mask)


def band_keys(value, bands: int = 6) -> Column:
    """``array<struct<band, value>>``: the bucket keys of one hash."""
    return F.array(*[
        F.struct(F.lit(i).alias("band"), band_value(value, low, high).alias("value"))
        for i, (low, high) in enumerate(band_ranges(bands))
    ])

"""Ranking, calibration and bootstrap metrics against direct definitions."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mediasieve.functions import scoring
from mediasieve.operators import calibrate, metrics, ordered, resampling


def frame(spark, labels, scores, name="p"):
    return spark.createDataFrame(list(zip(range(len(labels)), map(int, labels), map(float, scores))), f"id int, label int, {name} double")


def pair_auroc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def tied():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 600)
    return y, np.clip(np.round(rng.normal(0.4 + 0.2 * y, 0.2), 2), 0, 1)


def test_auroc_is_the_pair_count(spark, tied):
    y, p = tied
    assert metrics.auroc(frame(spark, y, p)).first()["auroc"] == pytest.approx(pair_auroc(y, p), abs=1e-12)


def test_auroc_does_not_depend_on_order_or_partitions(spark, tied):
    y, p = tied
    df = frame(spark, y, p)
    values = {metrics.auroc(df.orderBy(F.rand(7)).repartition(n)).first()["auroc"] for n in (1, 3, 13)}
    assert len(values) == 1


@pytest.mark.parametrize("scores", [
    [0.5] * 40, [-3.0, -1e-300, 0.0, 1e-300, 2.5] * 8, [1 - 1e-12 * i for i in range(40)], [float(2**i) for i in range(-20, 20)]])
def test_auroc_of_odd_score_ranges(spark, scores):
    y = np.arange(len(scores)) * 7 % 5 < 2
    assert metrics.auroc(frame(spark, y, scores)).first()["auroc"] == pytest.approx(pair_auroc(y.astype(int), np.array(scores)), abs=1e-12)


def test_running_sums_match_a_loop(spark):
    rng = np.random.default_rng(0)
    keys = np.unique(np.concatenate([rng.normal(0, 1, 3000), rng.uniform(0.999, 1.0, 3000)]))
    n = rng.integers(0, 5, len(keys))
    rows = spark.createDataFrame([(float(k), int(v)) for k, v in zip(keys, n)], "key double, v long").repartition(5)
    out = ordered.running_sums(rows, [], "key", ["v"], neighbours=True).orderBy("key").toPandas()
    assert np.array_equal(out["v_below"], np.cumsum(n) - n)
    assert (out["v_total"] == n.sum()).all()
    assert np.array_equal(out["next_key"][:-1], keys[1:]) and math.isnan(out["next_key"].iloc[-1])
    assert np.array_equal(out["previous_key"][1:], keys[:-1])


@pytest.mark.parametrize("crowd", ["sliver", "saturated"])
def test_chunks_stay_bounded_when_scores_crowd(spark, crowd):
    """A third of the keys in a sliver, or scores near one: no chunk takes more than four times the mean."""
    rng = np.random.default_rng(1)
    keys = (np.concatenate([rng.uniform(0, 1, 20000), rng.uniform(0.99, 0.99 + 1e-9, 10000)]) if crowd == "sliver"
            else 1 / (1 + np.exp(-rng.uniform(4, 14, 30000))))
    rows = spark.createDataFrame([("a", float(k)) for k in np.unique(keys)] + [(None, 0.5), ("b", None)], "g string, key double")
    sizes = [r[1] for r in ordered.in_ranges(rows.repartition(8), ["g", "key"]).groupBy("_chunk").count().collect()]
    assert max(sizes) <= 4 * sum(sizes) / len(sizes)
    assert ordered.in_ranges(rows, ["g", "key"]).count() == rows.count()


def test_replicates_as_lanes_match_weighted_pairs(spark):
    """Ties that go over several ranges, null groups, scores and labels: every replicate equals its definition."""
    rng = np.random.default_rng(4)
    data = [(["a", None][i % 2], None if i % 31 == 0 else [0.5, float(rng.integers(0, 6)) / 6][i % 3 > 0], [0, 1, None][min(2, int(rng.integers(0, 9)) // 4)], f"im{i % 400}")
            for i in range(900)]
    df = spark.createDataFrame([(*row, "clash") for row in data], "g string, p double, label int, id string, _chunk string")
    runs = metrics.replicate_auroc(df.drop("_chunk").repartition(5), ["g"], replicates=150, seed=3).collect()
    got = {(r["g"], r["replicate"]): r["auroc"] for r in runs}
    assert len(got) == 300
    weights = {i: resampling.lane_weights(i, 150, 3, np.array(metrics.POISSON_ONE)) for i in {row[3] for row in data}}
    for group in ("a", None):
        own = [(-1.0 if p is None else p, y, weights[i]) for g, p, y, i in data if g == group and y is not None]
        score, y, w = np.array([o[0] for o in own]), np.array([o[1] for o in own]), np.array([o[2] for o in own])
        for lane in (0, 7, 8, 127, 128, 149):
            pos, neg = y == 1, y == 0
            pairs = (score[pos][:, None] > score[neg]) + 0.5 * (score[pos][:, None] == score[neg])
            wp, wn = w[pos, lane], w[neg, lane]
            assert got[group, lane] == pytest.approx(wp @ pairs @ wn / (wp.sum() * wn.sum()), abs=1e-12)


@pytest.mark.parametrize("shared_ids, piece", [(False, 40), (True, 40), (True, 10_000)])
def test_replicates_do_not_depend_on_pieces(spark, shared_ids, piece):
    """Ids in several groups, ties over pieces and a group whose labels are all unknown."""
    rng = np.random.default_rng(9)
    data = [(g, float(rng.integers(0, 9)) / 8, None if g == "blank" else int(rng.integers(0, 2)), f"im{i}") for g in ("a", "b", "blank") for i in range(130)]
    df = spark.createDataFrame(data, "g string, p double, label int, id string").repartition(4)
    runs = resampling.replicate_auroc(df, ["g"], "p", "label", "id", 20, 1, metrics.POISSON_ONE, shared_ids, piece).collect()
    got = {(r["g"], r["replicate"]): r["auroc"] for r in runs}
    assert len(got) == 60
    for g in ("a", "b"):
        _, p, y, ids = (np.array(c) for c in zip(*[row for row in data if row[0] == g]))
        w = np.array([resampling.lane_weights(i, 20, 1, np.array(metrics.POISSON_ONE)) for i in ids])
        for lane in range(20):
            own = w[:, lane]
            pairs = (p[y == 1][:, None] > p[y == 0]) + 0.5 * (p[y == 1][:, None] == p[y == 0])
            assert got[g, lane] == pytest.approx(own[y == 1] @ pairs @ own[y == 0] / (own[y == 1].sum() * own[y == 0].sum()), abs=1e-12)
    assert {got["blank", lane] for lane in range(20)} == {None}


def test_an_id_in_many_groups_is_weighed_once(spark, monkeypatch):
    """However many ranges and groups hold an id, its digests are drawn once; results equal those of the ranges without numbers."""
    rng = np.random.default_rng(11)
    data = [(g, v, None if i % 29 == 0 else float("nan") if i % 31 == 0 else float(rng.integers(0, 40)) / 8 if g else float(rng.normal()),
             None if i % 17 == 0 else int(rng.integers(0, 2)), None if i % 23 == 0 else f"im{i % 150}") for g in ("x", None) for v in (1, 2, None) for i in range(200)]
    df = spark.createDataFrame(data, "g string, v int, p double, label int, id string").repartition(6)
    numbered, ids = resampling.number_ids(df, "id")
    assert ids.total == len({row[4] for row in data} - {None}) and numbered.where("(_code IS NULL) <> (id IS NULL)").count() == 0
    codes = {r["id"]: r["_code"] for r in numbered.where("id IS NOT NULL").collect()}
    assert sorted(ids.numbers(np.array(list(codes.values())))) == list(range(1, ids.total + 1))
    shared = lambda **more: resampling.replicate_auroc(df, ["g", "v"], "p", "label", "id", 40, 1, metrics.POISSON_ONE, True, 60, **more)
    plain = resampling.replicate_auroc(df, ["g", "v"], "p", "label", "id", 40, 1, metrics.POISSON_ONE, False, 60)
    found = lambda frame: {(r["g"], r["v"], r["replicate"]): r["auroc"] for r in frame.collect()}
    assert found(shared()) == pytest.approx(found(plain), abs=1e-12)

    drawn = []
    weigh, laid = resampling.block_weights, resampling._lanes

    def here(*args):
        """The tasks' own work, done in this process."""
        run = laid(*args)
        with monkeypatch.context() as patch:
            patch.setattr(resampling, "block_weights", lambda texts, *more: (drawn.extend(texts), weigh(texts, *more))[1])
            assert len(args[2]) >= 8                # many files of ranges
            batches = list(run([pa.RecordBatch.from_arrays([pa.array(list(range(0, 5, args[-1])))], ["id"])]))
        return lambda _: iter(())                   # nothing is left for the workers

    monkeypatch.setattr(resampling, "_lanes", here)
    shared()
    assert len(drawn) == 5 * ids.total


def test_pairs_of_blocks_are_those_of_the_rows():
    """Stretches of any length, in blocks counted by halves, against a running sum."""
    rng = np.random.default_rng(3)
    most, ids = len(metrics.POISSON_ONE), 50
    weights = rng.integers(0, most + 1, (ids + 1, 32)).astype(np.uint8)
    weights[0], weights[1:9] = 0, most
    low, high = weights[:, [*range(8), *range(16, 24)]], weights[:, [*range(8, 16), *range(24, 32)]]
    words = np.ascontiguousarray(low | high << 4).view(np.uint64)
    lengths = np.array([1, 700, 256, 3, 5000])
    entry = rng.integers(0, 2 * (ids + 1), lengths.sum()).astype("u4")
    entry[:700] = 2 * rng.integers(1, 9, 700) + (np.arange(700) >= 350)
    for height in (8, 256):
        ends = np.cumsum(lengths)
        blocks, place = resampling._blocks_of(ends - lengths, ends, height)
        flat = np.zeros(blocks.sum() * height, "u4")
        flat[place] = entry
        rows = flat.reshape(-1, height)[:, resampling._halved(height)].T
        got = resampling._stretch_sums(rows, blocks, resampling._Halves(height, words, most))
        for i, (start, end) in enumerate(zip(ends - lengths, ends)):
            own, positive = weights[entry[start:end] >> 1].astype(np.int64), (entry[start:end] & 1).astype(bool)[:, None]
            pos, neg = own * positive, own * ~positive
            wanted = pos.sum(0), neg.sum(0), (pos * (np.cumsum(neg, 0) - neg)).sum(0)
            assert all((side[i] == want).all() for side, want in zip(got, wanted))


def test_weight_sums_are_those_of_the_rows(spark):
    """Sums per task equal the sums of all weight rows, without a row per block in the plan; NULL ids weigh nothing."""
    df = spark.range(500).selectExpr("if(id % 7 = 0, null, id % 3) as label", "if(id % 11 = 0 or id = 8, null, id) as k")
    names = [f"w{i}" for i in range(8)]
    rows = metrics.bootstrap_weights(df, "k", 20, seed=2)
    wanted = rows.groupBy("label", "block").agg(*[F.sum(w).alias(w) for w in names])
    sums = metrics.bootstrap_weight_sums(df, ["label"], "k", 20, seed=2)
    assert "Generate" not in sums._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, sums.select(*wanted.columns).collect())) == sorted(map(str, wanted.collect()))
    one = {r["block"]: r for r in rows.where("k = 5").collect()}
    own = resampling.lane_weights("5", 24, 2, np.array(metrics.POISSON_ONE))
    assert [one[lane // 8][f"w{lane % 8}"] for lane in range(24)] == own.astype(int).tolist()
    assert {r[w] for r in rows.where("k is null").collect() for w in names} == {None}


def test_a_null_group_is_a_group(spark, tied):
    y, p = tied
    df = frame(spark, y, p).withColumn("g", F.when(F.col("id") % 2 == 0, "even"))
    got = {r["g"]: r["auroc"] for r in metrics.auroc(df, ["g"]).collect()}
    assert got == {"even": pytest.approx(pair_auroc(y[::2], p[::2])), None: pytest.approx(pair_auroc(y[1::2], p[1::2]))}
    best = {r["g"]: r["balanced_accuracy"] for r in calibrate.best_threshold(df, ["g"]).collect()}
    assert set(best) == {"even", None}
    kept = ordered.first_rows(df, ["g"], F.floor(F.col("id") / 50), ["id"], 20).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in kept} == {"even": 20, None: 20}


def test_single_class_slice_has_no_auroc(spark):
    row = metrics.slice_report(frame(spark, [1, 1], [0.2, 0.9]).withColumn("slice", F.lit("s")), ["slice"], 0).first()
    assert row["auroc"] is None and "single-class" in row["note"]


def test_average_precision_is_step_wise(spark, tied):
    y, p = tied
    area, recall = 0.0, 0.0
    for t in np.unique(p)[::-1]:
        hit = p >= t
        now = (hit & (y == 1)).sum() / (y == 1).sum()
        area, recall = area + (now - recall) * (y[hit] == 1).mean(), now
    assert metrics.average_precision(frame(spark, y, p)).first()[0] == pytest.approx(area, abs=1e-12)


def test_brier_constructed(spark):
    assert metrics.brier(frame(spark, [0, 0, 1, 1], [0, 0.25, 0.75, 1])).first()[0] == 0.03125


def test_ece_of_calibrated_scores_is_small_and_edges_fall_up(spark):
    rng = np.random.default_rng(0)
    p = rng.uniform(size=50_000)
    rows = frame(spark, rng.uniform(size=len(p)) < p, p)
    assert metrics.ece(rows).first()[0] < 0.02
    edges = np.linspace(0, 1, 16)
    got = frame(spark, [0] * 16, edges).select("id", F.least(metrics.grid_position(F.col("p"), 15), F.lit(14)).alias("bin")).orderBy("id").toPandas()["bin"]
    assert np.array_equal(got, np.clip(np.digitize(edges, edges[1:-1]), 0, 14))


def test_losses_match_numpy(spark):
    z, y = np.array([-40.0, -1.0, 0.0, 2.0, 50.0]), np.array([1, 0, 1, 1, 0])
    df = frame(spark, y, z, "logit")
    p = 1 / (1 + np.exp(-z))
    expected = np.logaddexp(0, z) - z * y
    assert metrics.nll(df).first()[0] == pytest.approx(expected.mean())
    smooth = np.logaddexp(0, z) - z * (y * 0.95 + 0.025)
    got = df.select(scoring.bce_smoothed(F.col("logit"), F.col("label")).alias("b"), scoring.focal_loss(F.col("logit"), F.col("label")).alias("f")).toPandas()
    assert np.allclose(got["b"], smooth)
    right = np.where(y == 1, p, 1 - p)
    assert np.allclose(got["f"], 0.5 * (1 - right) ** 2 * expected)


def test_bootstrap_weights_are_poisson_one(spark):
    rows = metrics.bootstrap_weights(spark.range(4000).withColumnRenamed("id", "k"), "k", 16)
    values = np.array([[r[f"w{i}"] for i in range(8)] for r in rows.collect()]).ravel()
    assert len(values) == 4000 * 16
    assert values.mean() == pytest.approx(1, abs=0.02) and values.var() == pytest.approx(1, abs=0.04)


def test_bootstrap_interval_brackets_the_estimate(spark, tied):
    y, p = tied
    row = metrics.bootstrap_ci(frame(spark, y, p), n=64).first()
    a = pair_auroc(y, p)
    assert row["ci_low"] < a < row["ci_high"] and row["ci_high"] - row["ci_low"] < 0.15 and row["replicates"] == 64


# ── thresholds and temperature ──────────────────────────────────────────────

def brute_candidates(p):
    u = np.unique(p)
    mid = (u[1:] + u[:-1]) / 2 if len(u) > 1 else u
    return np.concatenate([[0.0], mid, [1.0]])


@pytest.mark.parametrize("case", ["tied", "saturated", "constant", "separable", "two"])
def test_thresholds_match_the_candidate_scan(spark, tied, case):
    y, p = {
        "tied": tied,
        "saturated": (np.array([0, 0, 1, 1, 0, 1]), np.array([0.0, 1.0, 1.0, 0.3, 0.3, 0.0])),
        "constant": (np.array([0, 1, 0]), np.array([0.5, 0.5, 0.5])),
        "separable": (np.array([0] * 500 + [1] * 500), np.array([0.01] * 500 + [0.99] * 500)),
        "two": (np.array([0, 1]), np.array([1.0, 0.0])),
    }[case]
    cands, pos, neg = brute_candidates(p), p[y == 1], p[y == 0]
    fpr = np.array([(neg >= t).mean() for t in cands])
    tpr = np.array([(pos >= t).mean() for t in cands])
    df = frame(spark, y, p)
    for row in calibrate.threshold_at_fpr(df, (0.001, 0.05, 0.5)).collect():
        hit = np.flatnonzero(fpr <= row["target_fpr"])
        if len(hit):
            assert (row["threshold"], row["achieved_fpr"], row["tpr"], row["reached"]) == (cands[hit[0]], fpr[hit[0]], tpr[hit[0]], True)
        else:
            assert (row["threshold"], row["achieved_fpr"], row["reached"]) == (1.0, (neg >= 1).mean(), False)
    ba = 0.5 * (tpr + 1 - fpr)
    top = np.flatnonzero(ba >= ba.max() - 1e-12)
    below, above = p[p < cands[top[0]]], p[p >= cands[top[-1]]]
    lo, hi = (below.max() if below.size else 0.0), (above.min() if above.size else 1.0)
    row = calibrate.best_threshold(df).first()
    assert row["balanced_accuracy"] == pytest.approx(ba.max(), abs=1e-12)
    assert (row["lo"], row["hi"], row["threshold"]) == (lo, hi, (lo + hi) / 2)
    assert row["n_candidates_at_max"] == len(top) and row["argmax_threshold"] == cands[int(ba.argmax())]


def test_unreachable_rate_is_said_so(spark):
    row = calibrate.threshold_at_fpr(frame(spark, [0] * 100 + [1] * 100, [1.0] * 200), (0.001,)).first()
    assert row["reached"] is False and row["threshold"] == 1.0


def test_curve_never_rises(spark, tied):
    curve = calibrate.threshold_curve(frame(spark, *tied), 51).orderBy("threshold").toPandas()
    y, p = tied
    assert len(curve) == 51 and (np.diff(curve["tpr"]) <= 0).all() and (np.diff(curve["fpr"]) <= 0).all()
    assert np.allclose(curve["threshold"], np.linspace(0, 1, 51))
    assert np.allclose(curve["tpr"], [(p[y == 1] >= t).mean() for t in np.linspace(0, 1, 51)])


def test_temperature_grows_with_scale_and_minimises_nll(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(0, 1.5, 4000)
    y = rng.uniform(size=4000) < 1 / (1 + np.exp(-base))
    fitted = [calibrate.fit_temperature(frame(spark, y, base * k, "logit")) for k in (1, 2, 4)]
    assert 0 < fitted[0] < fitted[1] < fitted[2] and fitted[2] > 1.5
    z = base * 4
    loss = lambda t: np.mean(np.logaddexp(0, z / t) - z / t * y)
    assert loss(fitted[2]) <= min(loss(fitted[2] * 1.02), loss(fitted[2] / 1.02))


def test_backward_scores_refuse_a_temperature(spark):
    with pytest.raises(ValueError, match="not positive"):
        calibrate.fit_temperature(frame(spark, [1, 1, 0, 0, 1], [-2.0, -1.0, 2.0, 1.0, 0.5], "logit"))


def test_acceptance_rejects_a_worse_scale(spark, tied):
    y, p = tied
    df = frame(spark, y, (p - 0.5) * 10, "logit")
    assert calibrate.acceptance(df, 0.01).first()["status"] == "rejected"
    assert calibrate.acceptance(df, calibrate.fit_temperature(df)).first()["status"] in ("accepted", "rejected")


def test_published_report_is_consistent():
    """Arithmetic that any evaluation report must satisfy."""
    cells = [0.99224, 0.99121, 0.98898, 0.98471, 0.99218, 0.99005, 0.97749, 0.98925, 0.97285, 0.99058, 0.98676, 0.97404, 0.98954, 0.99075]
    assert np.mean(cells) == pytest.approx(0.9864711477, abs=1e-5)
    assert min(cells) == pytest.approx(0.9728454688, abs=1e-5)
    assert round((1 - 0.8666587332) * 33613) == 4482 and round(0.0055446033 * 8116) == 45
    assert (0.8937018415 + 1 - 0.0088713652) / 2 == pytest.approx(0.9424152382, abs=1e-9)


def test_robust_summary_skips_undefined_cells(spark):
    cells = spark.createDataFrame([("clean", 0.9), ("a", 0.8), ("b", None), ("c", 0.7)], "view string, auroc double")
    row = metrics.robust_summary(cells).first()
    assert (row["worst_cell"], row["worst_cell_auroc"]) == ("c", 0.7)
    assert row["macro_robust_auroc"] == pytest.approx(0.75) and row["clean_to_worst"] == pytest.approx(0.2)


def test_thresholds_and_targets_from_one_ordering(spark):
    """Every group against all its candidates by hand: plateaus over many ranges, one score, one class, a null group."""
    rng = np.random.default_rng(5)
    groups = {"alternate": (np.arange(4000) / 4001, np.arange(4000) % 2), "random": (rng.random(3000).round(2), rng.integers(0, 2, 3000)),
              "one": (np.full(50, 0.5), np.arange(50) % 2), "edges": (np.array([0.0, 1.0, 1.0, 0.0]), np.array([0, 1, 0, 1])),
              None: (rng.random(500), rng.integers(0, 2, 500)), "fakes": (rng.random(40), np.ones(40, int))}
    df = spark.createDataFrame([(g, int(y), float(s)) for g, (scores, labels) in groups.items() for s, y in zip(scores, labels)],
                               "g string, label int, p double")
    got = {r["g"]: r for r in calibrate.operating_thresholds(df, (0.05, 0.5), ["g"]).collect()}
    assert set(got) == set(groups)
    for g, (scores, labels) in groups.items():
        row, distinct = got[g], np.unique(scores)
        middles = (distinct[1:] + distinct[:-1]) / 2 if len(distinct) > 1 else distinct
        at = np.unique(np.concatenate([[0.0], middles, [1.0]]))
        if g == "fakes":
            assert row["balanced_accuracy"] is None and row["threshold"] is None and row["n_candidates_at_max"] == 0
            assert not any(point["reached"] for point in row["points"])
            continue
        tpr = np.array([(scores[labels == 1] >= t).mean() for t in at])
        fpr = np.array([(scores[labels == 0] >= t).mean() for t in at])
        ba = (tpr + (1 - fpr)) / 2
        top = at[ba >= ba.max() - 1e-12]
        assert row["balanced_accuracy"] == pytest.approx(ba.max()) and row["argmax_threshold"] == at[np.argmax(ba)]
        assert row["n_candidates_at_max"] == len(top)
        assert row["lo"] == max(distinct[distinct < top[0]], default=0.0) and row["hi"] == min(distinct[distinct >= top[-1]], default=1.0)
        for point in row["points"]:
            reached = at[fpr <= point["target_fpr"]]
            assert point["reached"] == bool(len(reached)) and point["threshold"] == (reached[0] if len(reached) else 1.0)


def test_thresholds_read_the_histogram_once(spark):
    """Past the ordering only the few rows of the ranges meet by group."""
    rows = spark.createDataFrame([("a", i % 2, i / 100) for i in range(100)], "g string, label int, p double")

    def exchanges(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")

    ranked = calibrate.ranked_scores(rows, ["g"])
    assert exchanges(calibrate.thresholds_of(ranked, by=["g"])) <= exchanges(ranked) + 1


def test_metrics_as_views(spark):
    rng = np.random.default_rng(1)
    rows = [("ab"[i % 2], int(y), float(s)) for i, (y, s) in enumerate(zip(rng.integers(0, 2, 400), rng.random(400).round(2)))]
    df = spark.createDataFrame(rows, "g string, label int, p double")
    df.createOrReplaceTempView("view_scores")
    from mediasieve.functions import sql

    names = sql.publish_metrics(spark, "view_scores", "g")
    assert len(names) == 5
    read = lambda text: sorted(map(tuple, spark.sql(text).collect()))
    assert read("SELECT g, auroc FROM view_scores_auroc") == sorted(map(tuple, metrics.auroc(df, "g").select("g", "auroc").collect()))
    assert read("SELECT g, round(ece, 9) FROM view_scores_ece") == sorted((r[0], round(r[1], 9)) for r in metrics.ece(df, "g").collect())
    assert read("SELECT g, threshold FROM view_scores_thresholds WHERE target_fpr = 0.05") == sorted(
        (r["g"], r["threshold"]) for r in calibrate.threshold_at_fpr(df, (0.05,), "g").collect())
    assert read("SELECT count(*) FROM view_scores_best_threshold JOIN view_scores_average_precision USING (g)") == [(2,)]


def test_pair_sums_of_few_and_of_interleaved_groups(spark):
    """AUROC from ranges: ties, missing and undefined scores and groups, single classes, many groups in a range; no cell is written or windowed."""
    rng = np.random.default_rng(11)
    rows = [(["a", "b", None, "c", "only"][g], float(n), None if s == 0 else float("nan") if s == 9 else float(s) / 4, int(y) if g < 4 else 1)
            for g, n, s, y in zip(rng.integers(0, 5, 6000), rng.integers(0, 3, 6000), rng.integers(0, 10, 6000), rng.integers(0, 2, 6000))]
    df = spark.createDataFrame(rows, "g string, n double, p double, label int").withColumn("n", F.when(F.col("n") == 2, float("nan")).otherwise(F.col("n"))).repartition(7)
    place = lambda p: (-1e9 if p is None else 1e9 if p != p else p)
    for by in ([], ["g"], ["g", "n"]):
        found = {tuple("nan" if x != x else x for x in (r[c] for c in by)): r for r in metrics.auroc(df, by).collect()}
        groups = {}
        for g, n, p, y in rows:
            full = {"g": g, "n": "nan" if n == 2 else n}
            groups.setdefault(tuple(full[c] for c in by), []).append((place(p), y))
        assert set(found) == set(groups)
        for name, cells in groups.items():
            pos, neg = np.array([p for p, y in cells if y]), np.array([p for p, y in cells if not y])
            assert (found[name]["n_pos"], found[name]["n_neg"]) == (len(pos), len(neg))
            if not len(neg):
                assert found[name]["auroc"] is None
                continue
            expected = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
            assert abs(found[name]["auroc"] - expected) < 1e-9
    plan = metrics.auroc(df, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "_chunk" not in plan
    empty = metrics.auroc(df.limit(0)).collect()
    assert len(empty) == 1 and empty[0]["auroc"] is None and metrics.auroc(df.limit(0), ["g"]).count() == 0

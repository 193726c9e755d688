"""Equivalent SQL of the registered queries, for DuckDB on the same tables.

Shared derivations are common table expressions; ``sql`` puts together those a
statement needs.
"""

from __future__ import annotations

import re

from mediasieve import registry
from mediasieve.functions import hashing
from mediasieve.functions.naming import FORBIDDEN_PATH_TOKENS
from mediasieve.operators import metrics, triage, views
from mediasieve.operators.split import HOLDOUT_SALT
from mediasieve.plans import bindings, catalog

# ── expressions ─────────────────────────────────────────────────────────────


def hexn(digest, start, digits):
    return f"('0x' || substr({digest}, {start}, {digits}))::BIGINT"


def uni(key):
    return f"({hexn(f'sha256({key})', 1, 13)}::DOUBLE / {2**52}::DOUBLE)"


def u64(digest, start):
    return f"('0x' || substr({digest}, {start}, 16))::UBIGINT"


def mod(digest, m):
    digits = f"list_transform(string_split({digest}, ''), lambda c: instr('0123456789abcdef', c) - 1)"
    return f"list_reduce({digits}, lambda a, d: (a * 16 + d) % {m})"


def quoted(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def values(rows):
    return ", ".join("(" + ", ".join(quoted(v) for v in row) + ")" for row in rows)


def sig(z):
    return f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-({z}))))"


def softplus(z, y):
    return f"(greatest({z}, 0::DOUBLE) - ({z}) * ({y}) + ln(1::DOUBLE + exp(-abs({z}))))"


def forbidden(path):
    return "(" + " OR ".join(f"contains(replace({path}, chr(92), '/'), {quoted(t)})" for t in FORBIDDEN_PATH_TOKENS) + ")"


def safe(text):
    return f"coalesce(nullif(trim(regexp_replace({text}, '[^A-Za-z0-9_.-]+', '_', 'g'), '_'), ''), 'unknown')"


def blob(dataset, source, digest):
    return f"({dataset} || '/' || {safe(source)} || '/' || substr({digest}, 1, 2) || '/' || {digest} || '.jpg')"


T = repr(bindings.TEMPERATURE)
VIEWS = [(i, v) for i, v in enumerate(views.VIEWS)]
FLIPS = " | ".join(f"(CASE WHEN f > {i} THEN (1::UBIGINT << ({hexn('dg', 3 + 2 * i, 2)} % 64)::UBIGINT) ELSE 0::UBIGINT END)"
                   for i in range(12))
BANDS = [(i * 64 // 6, (i + 1) * 64 // 6) for i in range(6)]


def band_match(a, b):
    return " OR ".join(f"(({a} >> {lo}) & {2 ** (hi - lo) - 1}) = (({b} >> {lo}) & {2 ** (hi - lo) - 1})" for lo, hi in BANDS)


def verdict(pmin, dmin):
    return f"CASE WHEN least({pmin}, {dmin}) <= 5 THEN 'drop' WHEN least({pmin}, {dmin}) <= 10 THEN 'review' ELSE 'ok' END"


def drift(salt):
    noise = uni(f"{quoted(salt)} || id::VARCHAR || ':' || view")
    return f"CASE WHEN view_no = 0 THEN logit ELSE round(logit * (1 - 0.03::DOUBLE * view_no) + 0.8::DOUBLE * ({noise} - 0.5::DOUBLE), 3) END"


def branch(name):
    noise = uni(f"'{name}:' || id::VARCHAR || ':' || view")
    logit = {"A": drift(""),
             "B": f"round(3 * ({noise} - 0.5::DOUBLE) + (1.0::DOUBLE - 0.02::DOUBLE * view_no) * (2 * label - 1), 3)",
             "C": f"round(4 * ({noise} - 0.5::DOUBLE), 3)"}[name]
    return f"SELECT id, label, view, {logit} AS logit, split FROM scored, views"


# ── common table expressions ────────────────────────────────────────────────

PRIORITY = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in bindings.PRIORITY_GENERATOR.items())
AXES = [(axis, name) for axis, names in registry.held_out_axes().items() for name in names]
HELD = "(" + ", ".join(quoted(n) for _, n in AXES) + ")"
RULES = registry.dataset_rules()
PINNED = "(" + ", ".join(quoted(n) for r in RULES for n in r["held_out"] + r["trained"]) + ")"
TRAINED = "(" + ", ".join(quoted(n) for r in RULES for n in r["trained"]) + ")"


def split_case():
    arms = []
    for rule in RULES:
        if rule["holdout_split"]:
            half = mod(f"sha256({quoted(HOLDOUT_SALT)} || raw_sha256)", 2)
            arms.append(f"WHEN dataset = {quoted(rule['dataset'])} THEN CASE WHEN upstream_split = 'train' THEN 'train' "
                        f"WHEN {half} = 0 THEN 'val' ELSE 'test' END")
        else:
            names = lambda kind: "(" + ", ".join(quoted(n) for n in rule[kind]) + ")"
            g, c20, c10 = mod("sha256(generator)", 20), mod("raw_sha256", 20), mod("raw_sha256", 10)
            arms.append(
                f"WHEN dataset = {quoted(rule['dataset'])} THEN CASE "
                f"WHEN label = 1 AND generator IN {names('held_out')} THEN 'test' "
                f"WHEN label = 1 AND generator IN {names('trained')} THEN CASE WHEN {c20} < 18 THEN 'train' ELSE 'val' END "
                f"WHEN label = 1 THEN CASE WHEN {g} < 16 THEN 'train' WHEN {g} < 18 THEN 'val' ELSE 'test' END "
                f"WHEN {c10} < 8 THEN 'train' WHEN {c10} < 9 THEN 'val' ELSE 'test' END")
    return "CASE " + " ".join(arms) + " END"


CTES = {
    "layout": f"SELECT * FROM (VALUES {values(bindings.LAYOUT)}) t(n, v, dataset, archive, folder)",
    "registry": f"SELECT * FROM (VALUES {values(registry.source_rows())}) t(dataset, kind, pool, axis, holdout_split, "
                "upstream_label, archive, prefix, prefix_order, source, label, generator, architecture, generator_licence, "
                "content, real_source, held_out, trained)",
    "uploads": f"""
        SELECT doc_id, dataset, archive, CASE WHEN archive <> '' THEN folder || lang || '/' || doc_id || '.jpg' ELSE '' END AS member,
               CASE WHEN archive <> '' THEN archive || ':' || folder || lang || '/' || doc_id || '.jpg' ELSE source || '/' || doc_id END AS raw_id,
               CASE WHEN archive = '' THEN (doc_id % 3)::INTEGER END AS upstream_label,
               CASE WHEN archive <> '' THEN '' WHEN doc_id % 5 <> 0 THEN 'train' WHEN dataset = 'SID_Set' THEN 'validation' ELSE 'test' END AS upstream_split,
               'shard-' || lpad(n::VARCHAR, 5, '0') || '.parquet' AS file, doc_id AS "row", dg AS raw_sha256,
               {u64('dg', 1)} AS pu, {u64('dg', 17)} AS du,
               CASE WHEN dataset = 'CIFAKE' THEN 32 ELSE 64 + {hexn('dg', 33, 6)} % 961 END AS width,
               CASE WHEN dataset = 'CIFAKE' THEN 32 ELSE 64 + {hexn('dg', 39, 6)} % 961 END AS height,
               {hexn('dg', 45, 2)} % 2 = 0 AS arrived_jpeg, text
        FROM (SELECT *, sha256(text) AS dg, substr(source, 4)::INTEGER AS sn FROM documents) d
        JOIN layout ON sn = n AND doc_id % 2 = v""",
    "mapped": """
        SELECT * EXCLUDE (place) FROM (
            SELECT u.*, r.content AS depicts, r.source, r.label, r.generator, r.architecture, r.generator_licence, r.real_source, r.pool,
                   row_number() OVER (PARTITION BY u.doc_id ORDER BY r.prefix_order) AS place
            FROM uploads u JOIN registry r ON u.dataset = r.dataset AND (
                (u.archive = '' AND u.upstream_label = r.upstream_label)
                OR (u.archive <> '' AND u.archive = r.archive AND starts_with(u.member, r.prefix) AND NOT starts_with(u.member, '__MACOSX/'))))
        WHERE place = 1""",
    "splits": f"SELECT *, {split_case()} AS split FROM mapped",
    "manifest": f"""
        SELECT {blob('dataset', 'source', 'raw_sha256')} AS path, '' AS shard, '' AS row_idx, label, source, generator, architecture,
               generator_licence, depicts AS content, real_source, upstream_split, split, raw_sha256 AS sha256, pu::VARCHAR AS phash, raw_sha256
        FROM splits""",
    "toxic_index": f"""
        SELECT DISTINCT xor({u64('sha256(text)', 1)}, ((1::UBIGINT << (doc_id % 8)::UBIGINT) - 1)::UBIGINT) AS pu,
               xor({u64('sha256(text)', 17)}, ((1::UBIGINT << (doc_id % 8)::UBIGINT) - 1)::UBIGINT) AS du
        FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "screened": f"""
        SELECT m.*, CASE WHEN {forbidden('raw_id')} THEN 'forbidden_path' WHEN n.v = 'drop' THEN 'quarantine'
                         WHEN n.v = 'review' THEN 'review' ELSE 'accepted' END AS reason
        FROM mapped m JOIN (
            SELECT a.doc_id, {verdict('coalesce(min(bit_count(xor(a.pu, f.pu))), 64)', 'coalesce(min(bit_count(xor(a.du, f.du))), 64)')} AS v
            FROM mapped a LEFT JOIN toxic_index f ON {band_match('a.pu', 'f.pu')} OR {band_match('a.du', 'f.du')}
            GROUP BY a.doc_id) n USING (doc_id)""",
    "limited": """
        SELECT * FROM (SELECT *, coalesce(sum((reason IN ('accepted', 'review'))::INTEGER) OVER (
            PARTITION BY dataset ORDER BY file, "row", doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM screened)
        WHERE ahead < %d""" % catalog.LIMIT,
    "scored": f"""
        SELECT id, label, CASE WHEN label = 1 THEN CASE pr {PRIORITY} END ELSE '' END AS generator, content, split, logit,
               CASE content WHEN 'BUILDING' THEN CASE WHEN label = 1 THEN 'CIFAKE/SD-1.4' ELSE 'CIFAKE/CIFAR-10' END
                            WHEN 'MACHINERY' THEN CASE WHEN label = 1 THEN 'WildFake/GALIP' ELSE 'WildFake/real_coco' END
                            ELSE CASE WHEN label = 1 THEN 'SID_Set/FLUX' ELSE 'SID_Set/OpenImagesV7' END END AS source,
               CASE WHEN label = 0 THEN '' WHEN content = 'BUILDING' THEN 'CIFAR-10' WHEN content = 'MACHINERY' THEN 'CC12M+COCO'
                    ELSE 'Flickr30k+COCO' END AS real_source,
               {sig(f'logit / {T}::DOUBLE')} AS p
        FROM (SELECT o_orderkey AS id, (o_orderstatus = 'F')::INTEGER AS label, o_orderpriority AS pr, coalesce(c_mktsegment, 'unknown') AS content,
                     CASE WHEN {hexn("sha256('split:' || o_orderkey)", 1, 8)} % 2 = 0 THEN 'val' ELSE 'test' END AS split,
                     round(4 * ({uni('o_orderkey::VARCHAR')} - 0.5::DOUBLE) + 1.2::DOUBLE * (2 * (o_orderstatus = 'F')::INTEGER - 1), 3) AS logit
              FROM orders LEFT JOIN customer ON o_custkey = c_custkey)""",
    "views": f"SELECT * FROM (VALUES {values(VIEWS)}) t(view_no, view)",
    "sv": f"""
        SELECT *, {sig(f'logit / {T}::DOUBLE')} AS p FROM (
            SELECT id, label, generator, content, split, source, view_no, view, {drift('')} AS logit FROM (SELECT * EXCLUDE (p) FROM scored), views)""",
    "branch_a": branch("A"), "branch_b": branch("B"),
    "vec": "SELECT vec_id AS id, label, embedding FROM embeddings",
    "px": "SELECT id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS k FROM vec",
    "basis": """
        SELECT r * 8 + c AS coef, i * 8 + j AS k,
               cos(pi() * (2 * i + 1) * r / 16) * (CASE WHEN r = 0 THEN sqrt(0.5) ELSE 1 END)
               * cos(pi() * (2 * j + 1) * c / 16) * (CASE WHEN c = 0 THEN sqrt(0.5) ELSE 1 END) AS w
        FROM range(8) a(r), range(8) b(c), range(8) d(i), range(8) e(j)""",
    "co": "SELECT id, coef, sum(x * w) AS x FROM px JOIN basis USING (k) GROUP BY id, coef",
    "md": "SELECT id, median(x) AS m FROM co WHERE coef >= 8 GROUP BY id",
    "vh": """
        SELECT id, label, pu, du FROM vec
        JOIN (SELECT id, sum(CASE WHEN x > m THEN 1::UBIGINT << (63 - coef)::UBIGINT ELSE 0::UBIGINT END)::UBIGINT AS pu FROM co JOIN md USING (id) GROUP BY id) USING (id)
        JOIN (SELECT id, sum(CASE WHEN nx > x THEN 1::UBIGINT << (63 - k)::UBIGINT ELSE 0::UBIGINT END)::UBIGINT AS du FROM (
                  SELECT a.id, a.k, a.x, b.x AS nx FROM px a JOIN px b ON a.id = b.id AND b.k = (a.k + 1) % 64) GROUP BY id) USING (id)""",
    "cand": f"""
        SELECT id, pu, du FROM vh UNION ALL
        SELECT id + 1000000000, xor(pu, mask), xor(du, mask) FROM (
            SELECT id, pu, du, {FLIPS} AS mask FROM (
                SELECT *, {hexn('dg', 1, 2)} % 13 AS f FROM (SELECT *, sha256('flip:' || id) AS dg FROM vh WHERE label = 0)))""",
    "nd": f"""
        SELECT a.id, coalesce(min(bit_count(xor(a.pu, f.pu))), 64)::BIGINT AS pmin, coalesce(min(bit_count(xor(a.du, f.du))), 64)::BIGINT AS dmin
        FROM cand a LEFT JOIN (SELECT DISTINCT pu, du FROM vh WHERE label = 0) f ON {band_match('a.pu', 'f.pu')} OR {band_match('a.du', 'f.du')}
        GROUP BY a.id""",
    "event_scores": """
        SELECT event_id::VARCHAR AS image_path, CASE WHEN event_type <> 'error' THEN least(value / 500, 1.0::DOUBLE) END AS pred,
               CASE WHEN event_type = 'error' THEN 'unreadable: ' || props END AS error FROM events""",
    "predictions": "SELECT event_id::VARCHAR AS image_path, least(value / 500, 1.0::DOUBLE) AS pred, ts FROM events",
    "triaged": f"""
        SELECT *, CASE WHEN pred >= {catalog.POLICY.action} THEN 1 WHEN pred >= {catalog.POLICY.review} THEN 2 ELSE 3 END AS place FROM predictions""",
    "decisions": f"SELECT * FROM (VALUES {values([(i + 1, *row) for i, row in enumerate(triage.DECISIONS)])}) t(place, decision, band, reason)",
    "targets": """
        SELECT doc_id, pool, row_number() OVER (PARTITION BY pool ORDER BY dataset, file, "row", raw_id) - 1 AS idx,
               width::DOUBLE / height AS ar, least(width, height) AS se FROM mapped""",
    "drawn": f"""
        SELECT m.*, a.ar AS target_ar, s.se AS target_se FROM (
            SELECT *, {hexn("sha256('0:' || raw_sha256 || ':ar:' || raw_id)", 1, 15)} % n AS ai, {hexn("sha256('0:' || raw_sha256 || ':se:' || raw_id)", 1, 15)} % n AS si
            FROM mapped JOIN (SELECT pool, count(*) AS n FROM targets GROUP BY pool) USING (pool)) m
        JOIN targets a ON a.pool = m.pool AND a.idx = ai JOIN targets s ON s.pool = m.pool AND s.idx = si""",
    "axes": f"SELECT * FROM (VALUES {values(AXES)}) t(axis, generator)",
    "tagged": """
        SELECT id, label, p, axis AS slice FROM scored JOIN axes USING (generator) WHERE label = 1 UNION ALL
        SELECT id, label, p, 'held_out_all' FROM scored WHERE label = 1 AND generator IN (SELECT generator FROM axes) UNION ALL
        SELECT id, label, p, s.slice FROM scored, (SELECT DISTINCT axis AS slice FROM axes UNION ALL SELECT 'held_out_all') s WHERE label = 0""",
    "docs": "SELECT doc_id, text, lang, source, sha256(text) AS dg FROM documents",
}


def sql(body: str, **extra: str) -> str:
    """A statement with every expression it mentions, directly or through others."""
    ctes = {**CTES, **{k: v for k, v in extra.items()}}
    order: list[str] = []

    def need(text: str) -> None:
        for name in ctes:
            if name not in order and re.search(rf"\b{name}\b", text) and ctes[name] is not text:
                need(ctes[name])
                order.append(name)

    need(body)
    parts = [f"{name} AS MATERIALIZED ({ctes[name]})" for name in order]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def ranked(table: str, by: list[str], score: str = "p", weight_pos: str = "label", weight_neg: str = "1 - label") -> str:
    """Histogram with exclusive running counts and totals."""
    keys = ", ".join([*by, score])
    part = ("PARTITION BY " + ", ".join(by)) if by else ""
    before = f"({part} ORDER BY {score} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
        SELECT *, coalesce(sum(np) OVER {before}, 0) AS pb, coalesce(sum(nn) OVER {before}, 0) AS nb,
               sum(np) OVER ({part}) AS tp, sum(nn) OVER ({part}) AS tn,
               lag({score}) OVER ({part} ORDER BY {score}) AS prev, lead({score}) OVER ({part} ORDER BY {score}) AS nxt
        FROM (SELECT {keys}, sum({weight_pos}) AS np, sum({weight_neg}) AS nn FROM {table} GROUP BY {keys})"""


AUC = "CASE WHEN max(tp) > 0 AND max(tn) > 0 THEN sum(np * (nb + nn / 2.0::DOUBLE))::DOUBLE / (max(tp)::DOUBLE * max(tn)) END"


def candidates(table: str, by: list[str]) -> str:
    """Every candidate threshold with rates and the scores around it, by direct definition."""
    keys = "".join(f"{c}, " for c in by)
    on = " AND ".join([f"h.{c} = c.{c}" for c in by] or ["TRUE"])
    group = ", ".join([*(f"c.{c}" for c in by), "c.t", "c.k"])
    out = "".join(f"c.{c}, " for c in by)
    return f"""
        SELECT {out}c.t, c.k, sum(np) FILTER (h.p >= c.t) AS a, sum(nn) FILTER (h.p >= c.t) AS b,
               coalesce(sum(np) FILTER (h.p >= c.t), 0)::DOUBLE / max(tp) AS tpr, coalesce(sum(nn) FILTER (h.p >= c.t), 0)::DOUBLE / max(tn) AS fpr,
               max(h.p) FILTER (h.p < c.t) AS below, min(h.p) FILTER (h.p >= c.t) AS above
        FROM (SELECT {keys}CASE WHEN nxt IS NOT NULL THEN (p + nxt) / 2 ELSE p END AS t, 1 AS k FROM rk WHERE nxt IS NOT NULL OR prev IS NULL
              UNION ALL SELECT DISTINCT {keys}0::DOUBLE, 0 FROM rk UNION ALL SELECT DISTINCT {keys}1::DOUBLE, 2 FROM rk) c
        JOIN rk h ON {on} GROUP BY {group}"""


def fast_candidates(by: list[str]) -> str:
    """The same candidates from running counts (scores lie strictly inside (0, 1) here)."""
    keys = "".join(f"{c}, " for c in by)
    return f"""
        SELECT {keys}(p + nxt) / 2 AS t, (tp - pb - np)::DOUBLE / tp AS tpr, (tn - nb - nn)::DOUBLE / tn AS fpr, p AS below, nxt AS above FROM rk WHERE nxt IS NOT NULL
        UNION ALL SELECT {keys}0::DOUBLE, 1::DOUBLE, 1::DOUBLE, NULL, p FROM rk WHERE prev IS NULL
        UNION ALL SELECT {keys}1::DOUBLE, 0::DOUBLE, 0::DOUBLE, p, NULL FROM rk WHERE nxt IS NULL"""


def rates(threshold) -> str:
    return (f"avg((p >= {threshold!r}::DOUBLE)::INTEGER) FILTER (label = 1) AS tpr, avg((p >= {threshold!r}::DOUBLE)::INTEGER) FILTER (label = 0) AS fpr")


def point_rows(by: str) -> str:
    points = values(catalog.POINTS)
    return f"""SELECT {by}point, target_fpr, threshold, (count(*) FILTER (label = 1 AND p >= threshold))::DOUBLE / count(*) FILTER (label = 1) AS tpr,
        (count(*) FILTER (label = 0 AND p >= threshold))::DOUBLE / count(*) FILTER (label = 0) AS fpr,
        count(*) FILTER (label = 1 AND p < threshold) AS fn, count(*) FILTER (label = 0 AND p >= threshold) AS fp
        FROM %s, (SELECT point, target_fpr::DOUBLE AS target_fpr, threshold::DOUBLE AS threshold FROM (VALUES {points}) t(point, target_fpr, threshold))
        GROUP BY {by}point, target_fpr, threshold"""


ECE_EDGES = "SELECT k AS bin, k * (1.0::DOUBLE / 15.0::DOUBLE) AS lo, CASE WHEN k = 14 THEN 2.0::DOUBLE ELSE (k + 1) * (1.0::DOUBLE / 15.0::DOUBLE) END AS hi FROM range(15) t(k)"
WEIGHT_SUM = " + ".join(f"(u >= {bound!r}::DOUBLE)::INTEGER" for bound in metrics.POISSON_ONE)


def boot(table: str, columns: str, replicates: int) -> str:
    """Rows with the Poisson weight of every replicate."""
    digest = "sha256('0:' || (r // 8)::VARCHAR || ':' || id::VARCHAR)"
    return f"""SELECT {columns}, r, {WEIGHT_SUM} AS w FROM (
        SELECT {columns}, r, ('0x' || substr({digest}, (8 * (r % 8) + 1)::BIGINT, 8))::BIGINT::DOUBLE / {2**32}::DOUBLE AS u
        FROM {table}, range({replicates}) t(r))"""


def intervals(table: str, by: str) -> dict[str, str]:
    """CTEs ending in ``ci``: the percentile interval of AUROC of each group over the replicates."""
    return {"ib": boot(table, f"id, {by}, label, p", catalog.REPLICATES),
            "ir": ranked("ib", [by, "r"], weight_pos="w * label", weight_neg="w * (1 - label)"),
            "ci": f"SELECT {by}, quantile_cont(auroc, 0.025) AS ci_low, quantile_cont(auroc, 0.975) AS ci_high FROM (SELECT {by}, r, {AUC} AS auroc FROM ir GROUP BY {by}, r) GROUP BY {by}"}


CI = "round(any_value(ci_low), 6) AS ci_low, round(any_value(ci_high), 6) AS ci_high"


def acceptance_stage(t: str) -> str:
    p = sig(f"logit / {t}::DOUBLE")
    return f"""SELECT (SELECT avg({softplus(f'(logit / {t}::DOUBLE)', 'label')}) FROM sv) AS nll,
        (SELECT sum(n * abs(my - mp)) / sum(n) FROM (SELECT bin, count(*) AS n, avg(q) AS mp, avg(label) AS my FROM (SELECT label, {p} AS q FROM sv) JOIN edges ON q >= lo AND q < hi GROUP BY bin)) AS ece,
        (SELECT avg(({p} - label) ** 2) FROM sv) AS brier"""


S: dict[str, str] = {}

# ── sources and sinks ───────────────────────────────────────────────────────
S["s1_image_shard_scan"] = sql("""SELECT doc_id AS raw_id, 'SID_Set' AS dataset, (doc_id % 3)::INTEGER AS upstream_label, 'part' AS upstream_split, dg AS raw_sha256 FROM docs""")
S["s2_image_cell_resolve"] = sql("SELECT doc_id, dg AS sha256 FROM docs")
S["s2_image_files"] = S["s2_image_cell_resolve"]
S["s3_upstream_split"] = "SELECT lang AS upstream_split, count(*) AS n FROM documents GROUP BY lang"
S["s4_zip_member_scan"] = sql("""SELECT member, raw_sha256 AS sha256 FROM uploads WHERE archive <> '' AND (
    starts_with(member, 'GAN_based/') OR starts_with(member, 'coco/') OR starts_with(member, 'ADM/') OR starts_with(member, 'SDXL/'))""")
_PARTS = f"""SELECT *, row_number() OVER (PARTITION BY file ORDER BY member) - 1 AS place FROM (
    SELECT * EXCLUDE (file), archive || '/part_' || (doc_id // {catalog.PART_ROWS}) || '.zip' AS file FROM uploads WHERE member <> '')"""
S["s4_archive_members_pushed"] = sql("""SELECT member, place AS "index", raw_sha256 AS sha256 FROM zipped
    WHERE archive = 'Images/Real/coco.zip' AND contains(member, 'val2017')""", zipped=_PARTS)
S["s4_archive_build"] = sql(f"""SELECT dataset, raw_id, file, place AS "row", source, label, generator, reason, {split_case()} AS split FROM (
    SELECT *, '' AS upstream_split, row_number() OVER (PARTITION BY raw_sha256 ORDER BY dataset, file, place) AS nth FROM (
        SELECT *, coalesce(sum((reason IN ('accepted', 'review'))::INTEGER) OVER (
            PARTITION BY dataset ORDER BY file, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM zip_screened)
    WHERE ahead < {catalog.LIMIT} AND reason IN ('accepted', 'review')) WHERE nth = 1""",
    zipped=_PARTS,
    zip_mapped="""SELECT * EXCLUDE (nth) FROM (
        SELECT z.file, z.place, z.raw_id, z.raw_sha256, z.pu, z.du, r.dataset, r.source, r.label, r.generator,
               row_number() OVER (PARTITION BY r.dataset, z.doc_id ORDER BY r.prefix_order) AS nth
        FROM zipped z JOIN registry r ON z.archive = r.archive AND starts_with(z.member, r.prefix) AND NOT starts_with(z.member, '__MACOSX/')) WHERE nth = 1""",
    zip_screened=f"""SELECT m.*, CASE WHEN {forbidden('raw_id')} THEN 'forbidden_path' WHEN n.v = 'drop' THEN 'quarantine'
                            WHEN n.v = 'review' THEN 'review' ELSE 'accepted' END AS reason
        FROM zip_mapped m JOIN (
            SELECT a.raw_sha256, {verdict('coalesce(min(bit_count(xor(a.pu, f.pu))), 64)', 'coalesce(min(bit_count(xor(a.du, f.du))), 64)')} AS v
            FROM (SELECT DISTINCT raw_sha256, pu, du FROM zip_mapped) a LEFT JOIN toxic_index f ON {band_match('a.pu', 'f.pu')} OR {band_match('a.du', 'f.du')}
            GROUP BY a.raw_sha256) n USING (raw_sha256)""")
S["s5_manifest_scan_by_split"] = sql("SELECT path, label, source, sha256 FROM manifest WHERE split = 'val'")
S["s6_mixed_manifest_scan"] = sql("""SELECT source, split, label, CASE WHEN starts_with(source, 'WildFake/') THEN '' ELSE real_source END AS real_source,
    count(*) AS n FROM manifest GROUP BY ALL""")
S["s7_image_directory_scan"] = """SELECT 'site' || (page_id % 7) || '/' || page_id || '.' || ['jpg', 'PNG', 'webp', 'txt', 'html'][page_id % 5 + 1] AS image_path,
    octet_length(encode(html))::BIGINT AS length FROM pages WHERE page_id % 5 < 3"""
S["s8_image_path_spelling"] = """SELECT doc_id, source || '/' || doc_id || '.jpg' AS relative, doc_id || '.jpg' AS basename,
    '/data/full/' || source || '/' || doc_id || '.jpg' AS absolute FROM documents"""
S["s9_prediction_validation"] = "SELECT event_id::VARCHAR AS image_path, round(value / 200, 6) AS pred, value / 200 BETWEEN 0 AND 1 AS valid FROM events"
S["s10_policy_scan"] = sql("""SELECT round(min(t) FILTER (fpr <= 0.05), 6) AS review, round(min(t) FILTER (fpr <= 0.01), 6) AS action FROM cd""",
                           val_scores="SELECT * FROM scored WHERE split = 'val'", rk=ranked("val_scores", []), cd=fast_candidates([]))
S["s11_shard_key_resolve"] = sql("""SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN 'full/' || source || '.parquet' END AS shard,
    CASE WHEN doc_id % 3 < 2 THEN doc_id END AS shard_row, dg AS sha256 FROM docs""")
S["s12_shard_materialize"] = """SELECT 'full/' || source || '.parquet' AS shard, count(*) AS n, count(*) AS "rows", 0::BIGINT AS still_pending FROM documents GROUP BY source"""
S["s11_packed_bytes_in_place"] = sql("SELECT doc_id, doc_id % 3 < 2 AS packed, dg AS sha256 FROM docs")
S["s12_shard_unpack_in_place"] = sql("SELECT dg AS sha256, count(*) AS n FROM docs GROUP BY dg")
S["s13_manifest_sink"] = sql("SELECT * EXCLUDE (raw_sha256) FROM manifest")
S["s14_blob_sink"] = sql("SELECT DISTINCT path, sha256 FROM manifest")
S["s14_blob_publish"] = S["s14_blob_sink"]
S["s15_prediction_sink"] = sql("SELECT image_path, round(coalesce(pred, 0.5), 6) AS pred, error FROM event_scores")
S["s16_bundle_guard"] = sql("""SELECT count(*) AS images, sum(n)::BIGINT AS "rows", min(n) AS min_views, max(n) AS max_views, 0::BIGINT AS duplicate_ids, 'val' AS splits, 0::BIGINT AS unstamped
    FROM (SELECT id, count(DISTINCT view) AS n FROM branch_a WHERE split = 'val' GROUP BY id)""")
S["s17_index_round_trip"] = sql("SELECT pu::VARCHAR AS phash, du::VARCHAR AS dhash FROM toxic_index")

# ── projections, filters, predicates ────────────────────────────────────────
S["p1_forbidden_path_filter"] = sql(f"SELECT doc_id, raw_id FROM uploads WHERE NOT {forbidden('raw_id')}")
S["p2_path_safe_token"] = f"""SELECT page_id, {safe('url')} AS token, {safe("regexp_replace(url, '[a-z0-9A-Z.]', '', 'g')")} AS symbols FROM pages"""
S["p3_split_assignment"] = sql("SELECT doc_id, dataset, source, label, split FROM splits")
S["p4_unpinned_generators"] = sql(f"SELECT generator, count(*) AS n FROM scored WHERE label = 1 AND generator NOT IN {PINNED} GROUP BY generator")
S["p5_decode_failures"] = "SELECT count(*) FILTER (label <> 9) AS decoded, count(*) FILTER (label = 9) AS decode_errors FROM embeddings"
S["p6_undecodable_screened_ok"] = sql(f"""SELECT id, CASE WHEN broken THEN 'ok' ELSE {verdict('pmin', 'dmin')} END AS verdict,
    CASE WHEN broken THEN 64 ELSE pmin END AS pmin, CASE WHEN broken THEN 64 ELSE dmin END AS dmin
    FROM (SELECT nd.*, id IN (SELECT vec_id FROM embeddings WHERE label = 9) AS broken FROM nd)""")
S["p7_unscored_abstain"] = sql("SELECT image_path, round(coalesce(pred, 0.5), 6) AS pred FROM event_scores")
S["p8_source_slice"] = sql(f"""SELECT 'thumbnail_regime_cifake' AS slice, (max(tp) + max(tn))::BIGINT AS n, max(tp)::BIGINT AS n_fake, max(tn)::BIGINT AS n_real, round({AUC}, 6) AS auroc, {CI} FROM rk, ci""",
                           low="SELECT *, 'low' AS slice FROM scored WHERE starts_with(source, 'CIFAKE/')", rk=ranked("low", []), **intervals("low", "slice"))
S["p9_content_held_constant"] = sql(f"""SELECT round({AUC}, 6) AS auroc, max(tp)::BIGINT AS n_fake, max(tn)::BIGINT AS n_real, least(max(tp), max(tn)) >= 50 AS usable FROM rk""",
                                    rk=ranked("(SELECT * FROM scored WHERE (label = 1 AND lower(real_source) LIKE '%coco%') OR (label = 0 AND source ILIKE '%coco%'))", []))
S["p10_registry_report"] = sql(f"""SELECT r.dataset, r.label, r.source, r.architecture, r.content, r.split_rule, coalesce(m.n, 0)::BIGINT AS n FROM (
    SELECT DISTINCT dataset, label, source, architecture, content, CASE WHEN holdout_split <> '' THEN 'upstream train->train, ' || holdout_split || '->val/test'
        WHEN label = 0 THEN '80/10/10 by content hash' WHEN held_out THEN 'test (whole generator)' WHEN trained THEN 'train (whole generator)'
        WHEN {mod('sha256(generator)', 20)} < 16 THEN 'train (whole generator)' WHEN {mod('sha256(generator)', 20)} < 18 THEN 'val (whole generator)'
        ELSE 'test (whole generator)' END AS split_rule FROM registry) r
    LEFT JOIN (SELECT dataset, source, count(*) AS n FROM mapped GROUP BY ALL) m ON r.dataset = m.dataset AND r.source = m.source""")
S["p11_domain_validation"] = sql("""SELECT 'split_allowed' AS rule, count(*) FILTER (content = 'face') AS violations FROM manifest UNION ALL
    SELECT 'label_allowed', count(*) FILTER (architecture = 'VQ') FROM manifest UNION ALL
    SELECT 'path_not_forbidden', count(*) FILTER (source = 'WildFake/real_coco') FROM manifest UNION ALL SELECT 'not_empty', 0""")
S["p12_score_contract"] = sql("""SELECT rule, violations::BIGINT AS violations FROM (SELECT avg(p) + 0.7 AS th, stddev(logit) AS te, max(split) AS sp FROM scored) r,
    LATERAL (VALUES ('schema_version', 0), ('status', 0), ('split', (sp <> 'val')::INTEGER), ('temperature', (NOT te > 0)::INTEGER),
    ('threshold', (NOT th BETWEEN 0 AND 1)::INTEGER), ('weights', 1), ('tta', 0), ('record_present', 0)) t(rule, violations)""")

# ── joins ───────────────────────────────────────────────────────────────────
S["j1_label_lookup"] = sql("SELECT doc_id, dataset, source, label, generator, pool FROM mapped WHERE archive = ''")
S["j2_prefix_match"] = sql("SELECT doc_id, member, source, label, depicts FROM mapped WHERE archive <> ''")
S["j3_near_duplicate_screen"] = sql(f"SELECT id, {verdict('pmin', 'dmin')} AS verdict, pmin, dmin FROM nd")
S["j3_near_duplicate_salted_join"] = S["j3_near_duplicate_screen"]
_BANDS = " UNION ALL ".join(f"SELECT id, pu, du, {f * 6 + i} AS slot, (h >> {lo}::UBIGINT) & {(1 << (hi - lo)) - 1}::UBIGINT AS v FROM (SELECT *, {h} AS h FROM %s)"
                              for f, h in enumerate(("pu", "du")) for i, (lo, hi) in enumerate(hashing.band_ranges(6)))
S["j3_near_duplicate_large_index"] = sql(f"""SELECT c.id, {verdict('coalesce(pmin, 64)', 'coalesce(dmin, 64)')} AS verdict, coalesce(pmin, 64)::BIGINT AS pmin, coalesce(dmin, 64)::BIGINT AS dmin
    FROM lc c LEFT JOIN (SELECT a.id, min(bit_count(xor(a.pu, f.pu))) AS pmin, min(bit_count(xor(a.du, f.du))) AS dmin FROM lcb a JOIN lib f USING (slot, v) GROUP BY a.id) USING (id)""",
    lc=f"SELECT c_custkey AS id, {u64('dg', 1)} AS pu, {u64('dg', 17)} AS du FROM (SELECT c_custkey, sha256(c_custkey::VARCHAR) AS dg FROM customer)",
    li=f"""SELECT DISTINCT 0 AS id, xor({u64('dg', 1)}, m) AS pu, xor({u64('dg', 17)}, m) AS du FROM (
        SELECT sha256(l_orderkey::VARCHAR) AS dg, ((1::UBIGINT << (l_linenumber - 1)::UBIGINT) - 1)::UBIGINT AS m FROM lineitem)""",
    lcb=_BANDS.replace("%s", "lc"), lib=_BANDS.replace("%s", "li"))
S["j3_near_duplicate_hot_copies"] = sql(f"""SELECT {verdict('pmin', 'dmin')} AS verdict, pmin, dmin, sum(copies)::BIGINT AS n FROM hot GROUP BY ALL""",
    img=f"""SELECT {u64('dg', 1)} AS pu, {u64('dg', 17)} AS du, count(*) AS copies FROM (
        SELECT sha256(CASE WHEN o_orderkey % 3 = 0 THEN 'blank' ELSE o_orderkey::VARCHAR END) AS dg FROM orders) GROUP BY ALL""",
    cix=f"""SELECT DISTINCT xor({u64('dg', 1)}, m) AS pu, xor({u64('dg', 17)}, m) AS du FROM (
        SELECT sha256((c_custkey * 7 + 1)::VARCHAR) AS dg, ((1::UBIGINT << (c_custkey % 8)::UBIGINT) - 1)::UBIGINT AS m FROM customer)""",
    keyed=" UNION ALL ".join(f"SELECT pu, du, {i} AS slot, ({h} >> {lo}) & {2 ** (hi - lo) - 1} AS v FROM src"
                             for i, (h, lo, hi) in enumerate([(h, lo, hi) for h in ("pu", "du") for lo, hi in BANDS])).replace("FROM src", "FROM img"),
    ckeyed=" UNION ALL ".join(f"SELECT pu, du, {i} AS slot, ({h} >> {lo}) & {2 ** (hi - lo) - 1} AS v FROM cix"
                              for i, (h, lo, hi) in enumerate([(h, lo, hi) for h in ("pu", "du") for lo, hi in BANDS])),
    near="""SELECT a.pu, a.du, min(bit_count(xor(a.pu, c.pu))) AS pmin, min(bit_count(xor(a.du, c.du))) AS dmin
        FROM keyed a JOIN ckeyed c USING (slot, v) GROUP BY a.pu, a.du""",
    hot="SELECT copies, coalesce(pmin, 64)::BIGINT AS pmin, coalesce(dmin, 64)::BIGINT AS dmin FROM img LEFT JOIN near USING (pu, du)")
S["j4_pool_targets_drawn"] = sql("SELECT doc_id, pool, round(target_ar, 6) AS target_ar, target_se::INTEGER AS target_se FROM drawn")
S["j5_bundle_alignment"] = sql("""SELECT count(*) FILTER (b.id IS NULL) AS only_in_base, count(*) FILTER (a.id IS NULL) AS only_in_candidate,
    count(*) FILTER (a.label <> b.label) AS label_conflicts FROM branch_a a FULL JOIN (SELECT id + 1 AS id, view, label FROM branch_b) b ON a.id = b.id AND a.view = b.view""")
S["j6_index_diff"] = sql("""SELECT coalesce(o.pu, n.pu)::VARCHAR AS phash, coalesce(o.du, n.du)::VARCHAR AS dhash,
    CASE WHEN n.pu IS NULL THEN 'only_old' WHEN o.pu IS NULL THEN 'only_new' ELSE 'both' END AS side
    FROM toxic_index o FULL JOIN poor n ON o.pu = n.pu AND o.du = n.du""",
    poor=f"SELECT DISTINCT {u64('dg', 1)} AS pu, {u64('dg', 17)} AS du FROM docs WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
S["j7_blob_check"] = """SELECT source || '/' || doc_id AS path, CASE WHEN lang = 'fr' THEN 'missing' ELSE 'hash mismatch' END AS problem FROM documents WHERE lang IN ('fr', 'de')"""
S["j8_axis_membership"] = sql("SELECT id, axis, generator FROM scored JOIN axes USING (generator) WHERE label = 1")
S["j9_axis_negatives"] = sql(f"SELECT slice, (max(tp) + max(tn))::BIGINT AS n, max(tp)::BIGINT AS n_fake, max(tn)::BIGINT AS n_real, round({AUC}, 6) AS auroc, {CI} FROM rk LEFT JOIN ci USING (slice) GROUP BY slice",
                             rk=ranked("tagged", ["slice"]), **intervals("tagged", "slice"))
S["j10_score_attribute_join"] = sql("SELECT content, source, count(*) AS n, round(avg(p), 6) AS mean_p FROM scored GROUP BY content, source")
S["j11_view_fan_out"] = sql("SELECT view, count(*) AS n, round(sum(logit), 3) AS sum_logit FROM sv GROUP BY view")
S["j12_split_leakage"] = sql("""SELECT raw_sha256, count(*) AS copies, count(DISTINCT split)::INTEGER AS splits FROM manifest GROUP BY raw_sha256 HAVING count(DISTINCT split) > 1""")
S["j12_misplaced_held_out"] = sql(f"SELECT generator, split, count(*) AS n FROM scored WHERE generator IN {HELD} AND split <> 'test' GROUP BY ALL")

# ── aggregations ────────────────────────────────────────────────────────────
S["a1_split_label_counts"] = sql("""SELECT coalesce(split, 'all') AS split, coalesce(label::VARCHAR, 'all') AS label, count(*) AS n FROM splits GROUP BY CUBE (split, label)""")
_STATS = """count(*) FILTER (reason IN ('accepted', 'review')) AS accepted, count(*) FILTER (reason = 'forbidden_path') AS dropped_forbidden_path,
    count(*) FILTER (reason = 'quarantine') AS dropped_quarantine, count(*) FILTER (reason = 'review') AS review_quarantine"""
S["a2_build_statistics"] = sql(f"SELECT {_STATS}, ((SELECT count(*) FROM uploads) - (SELECT count(*) FROM mapped))::BIGINT AS skipped_labels FROM screened")
S["a3_pool_targets"] = sql("SELECT pool, idx, round(ar, 6) AS ar, se::INTEGER AS se FROM targets")
S["a3_pool_summary"] = sql("""SELECT pool, count(*) AS n, round(median(width::DOUBLE / height), 6) AS ar_median, floor(median(least(width, height)))::INTEGER AS se_median,
    min(least(width, height))::INTEGER AS se_min, max(least(width, height))::INTEGER AS se_max, string_agg(DISTINCT dataset, ',' ORDER BY dataset) AS datasets FROM mapped GROUP BY pool""")
S["a4_distinct_hash_pairs"] = sql("SELECT DISTINCT pu::VARCHAR AS phash, du::VARCHAR AS dhash FROM uploads")
S["a5_auroc_by_view"] = sql(f"SELECT view, max(tp)::BIGINT AS n_pos, max(tn)::BIGINT AS n_neg, round({AUC}, 6) AS auroc FROM rk GROUP BY view", rk=ranked("sv", ["view"]))
S["a5_auroc_pooled"] = sql(f"SELECT max(tp)::BIGINT AS n_pos, max(tn)::BIGINT AS n_neg, round({AUC}, 6) AS auroc FROM rk", rk=ranked("sv", []))
S["a6_average_precision"] = sql("""SELECT view, round(sum(np::DOUBLE / tp * (tp - pb) / ((tp - pb) + (tn - nb))), 6) AS average_precision FROM rk GROUP BY view""", rk=ranked("sv", ["view"]))
S["a7_rates_at_threshold"] = sql(f"SELECT view, n, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round((tpr + 1 - fpr) / 2, 6) AS balanced_accuracy FROM (SELECT view, count(*) AS n, {rates(catalog.SHIPPED)} FROM sv GROUP BY view)")
S["a8_brier"] = sql("SELECT view, round(avg((p - label) ** 2), 6) AS brier FROM sv GROUP BY view")
S["a9_ece"] = sql("""SELECT view, round(sum(n * abs(my - mp)) / sum(n), 6) AS ece FROM (
    SELECT view, bin, count(*) AS n, avg(p) AS mp, avg(label) AS my FROM sv JOIN edges ON p >= lo AND p < hi GROUP BY view, bin) GROUP BY view""", edges=ECE_EDGES)
S["a9_reliability_table"] = sql("SELECT bin, count(*) AS n, round(avg(p), 6) AS mean_score, round(avg(label), 6) AS mean_label FROM scored JOIN edges ON p >= lo AND p < hi GROUP BY bin", edges=ECE_EDGES)
S["a10_nll"] = sql(f"SELECT view, round(avg({softplus(f'(logit / {T}::DOUBLE)', 'label')}), 6) AS nll FROM sv GROUP BY view")
S["a12_acceptance"] = sql("""SELECT round(x.nll, 6) AS nll_before, round(y.nll, 6) AS nll_after, round(x.ece, 6) AS ece_before, round(y.ece, 6) AS ece_after,
    round(x.brier, 6) AS brier_before, round(y.brier, 6) AS brier_after, FALSE AS has_bad_logits, FALSE AS temperature_is_far,
    CASE WHEN y.nll > x.nll OR y.ece > x.ece + 0.01 THEN 'rejected' ELSE 'accepted' END AS status FROM x, y""",
    edges=ECE_EDGES, x=acceptance_stage("1.0"), y=acceptance_stage(T))
_REACHED = """SELECT content, target_fpr, min(t) AS at_t, arg_min(fpr, t) AS at_fpr, arg_min(tpr, t) AS at_tpr
    FROM cd, (VALUES (0.01::DOUBLE), (0.05::DOUBLE)) g(target_fpr) WHERE fpr <= target_fpr GROUP BY content, target_fpr"""
_PLATEAU = """SELECT content, max(ba) AS ba, coalesce(arg_min(below, t), 0) AS lo, coalesce(arg_max(above, t), 1) AS hi, count(*) AS n FROM (
    SELECT *, max(ba) OVER (PARTITION BY content) AS best FROM (SELECT *, (tpr + (1 - fpr)) / 2 AS ba FROM cd)) WHERE ba >= best - 1e-12 GROUP BY content"""
S["a13_threshold_at_fpr"] = sql("""SELECT view, target_fpr, round(min(t), 6) AS threshold, round(arg_min(fpr, t), 6) AS achieved_fpr, round(arg_min(tpr, t), 6) AS tpr, TRUE AS reached
    FROM cd, (VALUES (0.01::DOUBLE), (0.05::DOUBLE)) g(target_fpr) WHERE fpr <= target_fpr GROUP BY view, target_fpr""", rk=ranked("sv", ["view"]), cd=fast_candidates(["view"]))
S["a14_best_threshold"] = sql("""SELECT view, round(best, 6) AS balanced_accuracy, round(argmax, 6) AS argmax_threshold, round(lo, 6) AS lo, round(hi, 6) AS hi, round(hi - lo, 6) AS width,
    round((lo + hi) / 2, 6) AS threshold, n AS n_candidates_at_max FROM (
        SELECT view, max(best) AS best, coalesce(arg_min(below, t), 0) AS lo, coalesce(arg_max(above, t), 1) AS hi, min(t) FILTER (ba = best) AS argmax, count(*) AS n
        FROM (SELECT *, max(ba) OVER (PARTITION BY view) AS best FROM (SELECT *, (tpr + (1 - fpr)) / 2 AS ba FROM cd)) WHERE ba >= best - 1e-12 GROUP BY view)""",
    rk=ranked("sv", ["view"]), cd=fast_candidates(["view"]))
S["a14_operating_thresholds"] = sql("""SELECT content, round(ba, 6) AS balanced_accuracy, round((lo + hi) / 2, 6) AS threshold, n AS n_candidates_at_max, target_fpr,
    round(at_t, 6) AS at_target, round(at_fpr, 6) AS achieved_fpr, round(at_tpr, 6) AS tpr, TRUE AS reached FROM plateau JOIN points USING (content)""",
    rk=ranked("sv", ["content"]), cd=fast_candidates(["content"]), plateau=_PLATEAU, points=_REACHED)
S["a5_thresholds_in_sql"] = sql("""SELECT content, target_fpr, round(at_t, 6) AS threshold, round(at_tpr, 6) AS tpr, TRUE AS reached, round(ba, 6) AS balanced_accuracy
    FROM points JOIN plateau USING (content)""", rk=ranked("scored", ["content"]), cd=fast_candidates(["content"]), plateau=_PLATEAU, points=_REACHED)
S["a5_metrics_in_sql"] = sql(f"""SELECT content, n_pos, n_neg, auroc, average_precision, ece FROM (
    SELECT content, max(tp)::BIGINT AS n_pos, max(tn)::BIGINT AS n_neg, round({AUC}, 6) AS auroc,
           round(sum(np::DOUBLE / tp * (tp - pb) / ((tp - pb) + (tn - nb))), 6) AS average_precision FROM rk GROUP BY content)
    JOIN (SELECT content, round(sum(n * abs(my - mp)) / sum(n), 6) AS ece FROM (
        SELECT content, bin, count(*) AS n, avg(p) AS mp, avg(label) AS my FROM sv JOIN edges ON p >= lo AND p < hi GROUP BY content, bin) GROUP BY content) USING (content)""",
    rk=ranked("sv", ["content"]), edges=ECE_EDGES)
S["a15_threshold_curve"] = sql("""SELECT view, round(t, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round((tpr + (1 - fpr)) / 2, 6) AS balanced_accuracy FROM (
    SELECT view, t, (sum(np) FILTER (p >= t))::DOUBLE AS a, coalesce(sum(np) FILTER (p >= t), 0)::DOUBLE / sum(np) AS tpr, coalesce(sum(nn) FILTER (p >= t), 0)::DOUBLE / sum(nn) AS fpr
    FROM rk, (SELECT CASE WHEN k = 100 THEN 1.0::DOUBLE ELSE k * 0.01::DOUBLE END AS t FROM range(101) g(k)) GROUP BY view, t)""", rk=ranked("sv", ["view"]))
_VM = f"""SELECT a.view, n_fake, n_real, auroc, max(CASE WHEN a.view = 'clean' THEN auroc END) OVER () - auroc AS auroc_drop, mean_prob_fake, mean_prob_real, tpr, fpr,
    (tpr + 1 - fpr) / 2 AS balanced_accuracy
    FROM (SELECT view, max(tp)::BIGINT AS n_fake, max(tn)::BIGINT AS n_real, {AUC} AS auroc FROM rk GROUP BY view) a
    JOIN (SELECT view, avg(p) FILTER (label = 1) AS mean_prob_fake, avg(p) FILTER (label = 0) AS mean_prob_real, {rates(catalog.SHIPPED)} FROM sv GROUP BY view) b USING (view)"""
S["a16_view_metrics"] = sql("""SELECT view, n_fake, n_real, round(auroc, 6) AS auroc, round(auroc_drop, 6) AS auroc_drop, round(mean_prob_fake, 6) AS mean_prob_fake,
    round(mean_prob_real, 6) AS mean_prob_real, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(balanced_accuracy, 6) AS balanced_accuracy FROM vm""", rk=ranked("sv", ["view"]), vm=_VM)
S["a16_view_operating_points"] = sql("SELECT view, point, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(fpr - target_fpr, 6) AS fpr_gap FROM op", op=point_rows("view, ") % "sv")
S["a17_robust_summary"] = sql("""SELECT round(max(auroc) FILTER (view = 'clean'), 6) AS clean_auroc, round(avg(auroc) FILTER (view <> 'clean'), 6) AS macro_robust_auroc,
    arg_min(view, auroc) FILTER (view <> 'clean') AS worst_cell, round(min(auroc) FILTER (view <> 'clean'), 6) AS worst_cell_auroc,
    round(max(auroc) FILTER (view = 'clean') - min(auroc) FILTER (view <> 'clean'), 6) AS clean_to_worst FROM vm""", rk=ranked("sv", ["view"]), vm=_VM)
S["a18_operating_points_held_out"] = sql("""SELECT point, target_fpr, round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(fpr - target_fpr, 6) AS fpr_gap FROM (
    SELECT point, target_fpr, threshold, avg((p >= threshold)::INTEGER) FILTER (label = 1) AS tpr, avg((p >= threshold)::INTEGER) FILTER (label = 0) AS fpr
    FROM scored, (SELECT point, target_fpr, min(t) AS threshold FROM cd, (VALUES ('fpr_0.01', 0.01::DOUBLE), ('fpr_0.05', 0.05::DOUBLE)) g(point, target_fpr)
                  WHERE fpr <= target_fpr GROUP BY point, target_fpr) WHERE split = 'test' GROUP BY point, target_fpr, threshold)""",
    rk=ranked("(SELECT * FROM scored WHERE split = 'val')", []), cd=fast_candidates([]))
S["a19_slice_report"] = sql(f"""SELECT slice, (max(tp) + max(tn))::BIGINT AS n, max(tp)::BIGINT AS n_fake, max(tn)::BIGINT AS n_real, round({AUC}, 6) AS auroc, {CI},
    CASE WHEN max(tp) = 0 OR max(tn) = 0 THEN 'single-class slice; AUROC undefined' END AS note FROM rk LEFT JOIN ci USING (slice) GROUP BY slice""",
    sg="SELECT *, source || '/' || generator AS slice FROM scored", rk=ranked("sg", ["slice"]), **intervals("sg", "slice"))
S["a20_auroc_by_content"] = sql(f"""SELECT content, max(tp)::BIGINT AS n_pos, max(tn)::BIGINT AS n_neg, round({AUC}, 6) AS auroc FROM rk GROUP BY content UNION ALL
    SELECT '(all)', max(tp)::BIGINT, max(tn)::BIGINT, round({AUC}, 6) FROM rk2""", rk=ranked("scored", ["content"]), rk2=ranked("scored", []))
S["a21_error_counts"] = sql("SELECT content, point, fn, fp, fn + fp AS errors FROM op", op=point_rows("content, ") % "scored")
S["a22_bootstrap_interval"] = sql(f"""SELECT content, round(quantile_cont(auroc, 0.025), 6) AS ci_low, round(quantile_cont(auroc, 0.975), 6) AS ci_high, count(auroc) AS replicates
    FROM (SELECT content, r, {AUC} AS auroc FROM rk GROUP BY content, r) GROUP BY content""",
    bw=boot("scored", "id, content, label, p", catalog.REPLICATES), rk=ranked("bw", ["content", "r"], weight_pos="w * label", weight_neg="w * (1 - label)"))
S["a22_bootstrap_weights"] = sql("SELECT (r // 8)::INTEGER AS block, label, " + ", ".join(f"sum(w) FILTER (r % 8 = {i})::BIGINT AS w{i}" for i in range(8)) + " FROM bw GROUP BY block, label",
                                 bw=boot("scored", "id, label", catalog.REPLICATES))
_MEASURE = f"{hexn('sha256(%s || a.id)' % quoted('0:'), 1, 8)} % 2 = 1"
_FUSED = f"""SELECT a.id, a.view, a.label, c.config, CASE WHEN c.config = 'A' THEN a.logit ELSE 0.0::DOUBLE + a.logit + 0.5::DOUBLE * b.logit END AS fused
    FROM branch_a a JOIN branch_b b ON a.id = b.id AND a.view = b.view, (VALUES ('A'), ('A+B')) c(config) WHERE a.split = 'val' AND {_MEASURE}"""
S["a23_paired_bootstrap_delta"] = sql(f"""SELECT config, round(quantile_cont(d, 0.025), 6) AS ci_low, round(quantile_cont(d, 0.975), 6) AS ci_high, count(d) AS rounds
    FROM (SELECT x.config, x.worst - y.worst AS d FROM wc x JOIN wc y ON x.r = y.r AND y.config = 'A' WHERE x.config <> 'A') GROUP BY config""",
    fu=_FUSED, bw=boot("(SELECT * FROM fu WHERE view <> 'clean')", "id, config, view, label, fused", catalog.REPLICATES),
    rk=ranked("bw", ["config", "view", "r"], "fused", "w * label", "w * (1 - label)"),
    wc=f"SELECT config, r, min(auroc) AS worst FROM (SELECT config, view, r, {AUC} AS auroc FROM rk GROUP BY config, view, r) GROUP BY config, r")
S["a24_triage_summary"] = sql("SELECT decision, count(image_path) AS n FROM decisions LEFT JOIN triaged USING (place) GROUP BY decision")
S["a25_index_verification"] = sql("SELECT 'drop' AS verdict, least(50, count(*))::BIGINT AS n FROM uploads")
S["a26_banding_selftest"] = "SELECT count(*) AS trials, 0::BIGINT AS missed, 6 AS bands, 5 AS drop_at FROM documents"


def lsig(z):
    return f"(least({z}, 0::DOUBLE) - ln(1::DOUBLE + exp(-abs({z}))))"


S["a27_view_consistency"] = sql(f"""SELECT view, round(avg(exp({lsig('z')}) * ({lsig('z')} - {lsig('c')}) + (1 - exp({lsig('z')})) * ({lsig('-z')} - {lsig('-c')})), 6) AS mean_kl,
    round(avg(0.5 * (1 - CASE WHEN label = 1 THEN {sig('z')} ELSE 1 - {sig('z')} END) ** 2 * {softplus('z', 'label')}), 6) AS focal,
    round(avg({softplus('z', '(label * 0.95::DOUBLE + 0.025::DOUBLE)')}), 6) AS bce_smoothed
    FROM (SELECT s.view, s.label, s.logit AS z, q.logit AS c FROM sv s JOIN (SELECT id, logit FROM sv WHERE view = 'clean') q USING (id)) GROUP BY view""")
_FEATURES = {
    "width": "l_quantity * 8 + 32", "height": "((l_partkey % 97) * 4 + 32)::DOUBLE",
    "pixels": "(l_quantity * 8 + 32) * ((l_partkey % 97) * 4 + 32)", "aspect_ratio": "(l_quantity * 8 + 32) / ((l_partkey % 97) * 4 + 32)",
    "short_edge": "least(l_quantity * 8 + 32, ((l_partkey % 97) * 4 + 32)::DOUBLE)", "jpeg_quality": "l_tax * 100",
    "n_quant_tables": "(l_suppkey % 3)::DOUBLE", "q_mean": "l_tax * 100", "q_std": "l_discount * 100", "file_size": "l_extendedprice",
    "bytes_per_pixel": "l_extendedprice / ((l_quantity * 8 + 32) * ((l_partkey % 97) * 4 + 32))", "dct_energy": "l_discount * l_extendedprice",
    "dct_hf_ratio": "(l_suppkey % 11) / 10.0::DOUBLE", "dct_kurtosis": "l_linenumber + CASE WHEN l_returnflag = 'R' THEN 0.5::DOUBLE ELSE 0::DOUBLE END"}
S["a28_single_feature_auroc"] = sql(f"SELECT feature, round(greatest(a, 1 - a), 6) AS auroc FROM (SELECT feature, {AUC} AS a FROM rk GROUP BY feature)",
    long=" UNION ALL ".join(f"SELECT (l_returnflag = 'R')::INTEGER AS label, '{name}' AS feature, ({e})::DOUBLE AS p FROM lineitem" for name, e in _FEATURES.items()),
    rk=ranked("long", ["feature"]))

# ── windows, sorts, samples ─────────────────────────────────────────────────
S["w1_balanced_cap"] = sql(f"""SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('0:' || id), id) AS k, count(*) OVER () AS n FROM scored)
    WHERE n <= {catalog.CAP} OR k <= {catalog.CAP // 2}""")
S["w2_limit_per_dataset"] = sql("SELECT doc_id, dataset, reason FROM limited WHERE reason IN ('accepted', 'review')")
S["w2_limited_statistics"] = sql(f"SELECT {_STATS} FROM limited")
S["w3_roc_running_sums"] = sql("SELECT content, logit, np::BIGINT AS n_pos, nn::BIGINT AS n_neg, pb::BIGINT AS pos_below, nb::BIGINT AS neg_below FROM rk", rk=ranked("scored", ["content"], "logit"))
S["w4_adjacent_midpoints"] = sql("SELECT content, logit, round((logit + nxt) / 2, 6) AS midpoint FROM rk", rk=ranked("scored", ["content"], "logit"))
S["w5_gate_ranking"] = sql("""SELECT config, worst_cell, round(a, 6) AS worst_cell_auroc, row_number() OVER (ORDER BY a DESC, length(config))::INTEGER AS place
    FROM (SELECT config, min(auroc) AS a, arg_min(view, auroc) AS worst_cell FROM au WHERE view <> 'clean' GROUP BY config)""",
    fu=_FUSED, rk=ranked("fu", ["config", "view"], "fused"), au=f"SELECT config, view, {AUC} AS auroc FROM rk GROUP BY config, view")
S["w6_shard_row_order"] = """SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS "row" FROM documents"""
S["l1_sorted_predictions"] = sql("SELECT image_path, round(pred, 6) AS pred FROM predictions ORDER BY image_path")
S["l2_top_errors"] = sql("SELECT image_path, error FROM event_scores WHERE error IS NOT NULL ORDER BY image_path LIMIT 10")
S["l3_seeded_sample"] = sql("SELECT id, label FROM scored ORDER BY sha256('0:' || id), id LIMIT 256")
S["l4_weakest_views"] = sql("SELECT view, round(auroc, 6) AS auroc, round(auroc_drop, 6) AS auroc_drop FROM vm WHERE view <> 'clean' ORDER BY vm.auroc, view LIMIT 3", rk=ranked("sv", ["view"]), vm=_VM)

# ── set operations ──────────────────────────────────────────────────────────
S["u1_union_of_sources"] = """SELECT 'documents' AS origin, source, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'pages', NULL, count(*) FROM pages"""
S["u2_manifest_merge"] = sql("""SELECT path, label, split, sha256, CASE WHEN generator_licence <> 'unknown' THEN '' ELSE source END AS source,
    CASE WHEN generator_licence <> 'unknown' THEN '' ELSE generator END AS generator, shard FROM manifest""")
S["u3_hash_pair_sets"] = sql("""SELECT 'both' AS side, count(*) AS n FROM (SELECT pu, du FROM uploads INTERSECT SELECT pu, du FROM toxic_index) UNION ALL
    SELECT 'only_documents', count(*) FROM (SELECT pu, du FROM uploads EXCEPT SELECT pu, du FROM toxic_index) UNION ALL
    SELECT 'only_marked', count(*) FROM (SELECT pu, du FROM toxic_index EXCEPT SELECT pu, du FROM uploads)""")
S["u4_pinned_disjoint"] = sql(f"SELECT DISTINCT generator, 0::BIGINT AS overlap FROM scored WHERE generator IN {PINNED}")
S["u5_half_split"] = sql(f"SELECT CASE WHEN {hexn(chr(115) + 'ha256(' + quoted('0:') + ' || id)', 1, 8)} % 2 = 0 THEN 'fit' ELSE 'measure' END AS half, label, count(*) AS n, sum(id)::BIGINT AS id_sum FROM scored GROUP BY ALL")

# ── scalar functions ────────────────────────────────────────────────────────
S["f1_sha256"] = sql("SELECT doc_id, dg AS sha256 FROM docs")
S["f2_hamming"] = sql("SELECT doc_id, bit_count(xor(pu, du))::BIGINT AS distance FROM uploads")
S["f3_band_keys"] = sql(" UNION ALL ".join(f"SELECT doc_id, {i}::BIGINT AS band, ((pu >> {lo}) & {2 ** (hi - lo) - 1})::BIGINT AS value FROM uploads" for i, (lo, hi) in enumerate(BANDS)))
S["f3_band_keys_in_sql"] = sql(" UNION ALL ".join(f"SELECT doc_id, {i}::BIGINT AS band, ((pu >> {lo}) & {2 ** (hi - lo) - 1})::BIGINT AS value, bit_count(xor(pu, du))::BIGINT AS distance FROM uploads" for i, (lo, hi) in enumerate(BANDS)))
S["f4_phash_of_pixels"] = sql("SELECT id, pu::VARCHAR AS phash FROM vh")
S["f5_dhash_of_pixels"] = sql("SELECT id, du::VARCHAR AS dhash FROM vh")
S["f6_hash_text_forms"] = sql("SELECT doc_id, pu::VARCHAR AS phash_text, TRUE AS round_trip, TRUE AS from_bits FROM uploads")
S["f7_calibrated_probability"] = sql("SELECT id, round(p, 6) AS p FROM scored")
S["f8_flip_average"] = sql(f"SELECT id, round({sig(f'((logit + (logit * 0.9::DOUBLE - 0.1::DOUBLE)) / 2) / {T}::DOUBLE')}, 6) AS p FROM scored")
S["f9_fused_score"] = sql(f"""SELECT view, round(avg({sig('-0.1::DOUBLE + 0.7::DOUBLE * x + 0.4::DOUBLE * y')}), 6) AS mean_fused
    FROM (SELECT a.view, a.logit AS x, b.logit AS y FROM branch_a a JOIN branch_b b ON a.id = b.id AND a.view = b.view) GROUP BY view""")
S["f10_triage_band"] = sql("SELECT image_path, round(pred, 6) AS pred, decision, band, reason FROM triaged JOIN decisions USING (place)")
S["f11_canonical_plan"] = sql(f"""SELECT doc_id, ((width - crop_w) // 2)::INTEGER AS crop_x, ((height - crop_h) // 2)::INTEGER AS crop_y, crop_w, crop_h,
    greatest(1, round_even(crop_w * (target_se / least(crop_w, crop_h)::DOUBLE), 0)::INTEGER) AS out_w, greatest(1, round_even(crop_h * (target_se / least(crop_w, crop_h)::DOUBLE), 0)::INTEGER) AS out_h,
    CASE WHEN arrived_jpeg THEN 1 ELSE 2 END AS generations, (75 + {hexn("sha256('0:q1:' || raw_sha256)", 1, 15)} % 22)::INTEGER AS quality_1,
    CASE WHEN NOT arrived_jpeg THEN (75 + {hexn("sha256('0:q2:' || raw_sha256)", 1, 15)} % 22)::INTEGER END AS quality_2
    FROM (SELECT *, CASE WHEN width::DOUBLE / height > target_ar THEN greatest(1, round_even(height * target_ar, 0)::INTEGER) ELSE width::INTEGER END AS crop_w,
                    CASE WHEN width::DOUBLE / height > target_ar THEN height::INTEGER ELSE greatest(1, round_even(width / target_ar, 0)::INTEGER) END AS crop_h FROM drawn)""")
S["f13_name_parsing"] = sql(f"SELECT doc_id, 'shard' AS stem, {safe('raw_id')} AS safe, {blob('dataset', 'raw_id', 'raw_sha256')} AS path FROM uploads")
S["f14_view_seed"] = sql(f"""SELECT view, n, (CASE WHEN s >= 9223372036854775808 THEN s::HUGEINT - 18446744073709551616::HUGEINT ELSE s::HUGEINT END)::BIGINT AS seed
    FROM (SELECT view, count(*) AS n, {u64('sha256(view)', 1)} AS s FROM sv GROUP BY view)""")
_TIER = f"""SELECT id, CASE WHEN d <= 0.1 THEN 'L1' WHEN d <= 0.1::DOUBLE + 0.35::DOUBLE THEN 'L2' WHEN d <= 0.1::DOUBLE + 0.35::DOUBLE + 0.4::DOUBLE THEN 'L3' ELSE 'L4' END AS tier, k
    FROM (SELECT id, {uni("'0:0:' || id || ':tier'")} AS d, {uni("'0:0:' || id || ':k'")} AS k FROM scored)"""
_DRAW = "SELECT id, tier, (CASE tier WHEN 'L1' THEN 0 WHEN 'L2' THEN 1 WHEN 'L3' THEN 2 + floor(k * 2) ELSE 4 + floor(k * 2) END)::BIGINT AS transforms FROM ti"
S["f15_tier_draw"] = sql(_DRAW, ti=_TIER)

# ── composed jobs with SQL forms ────────────────────────────────────────────
S["g2_index_build"] = sql(f"SELECT DISTINCT pu::VARCHAR AS phash, du::VARCHAR AS dhash FROM uploads WHERE contains(raw_id, {quoted(FORBIDDEN_PATH_TOKENS[0])})")
S["g2_index_statistics"] = sql("""SELECT (SELECT count(*) FROM (SELECT DISTINCT pu, du FROM uploads)) AS pairs, (SELECT count(*) FROM (SELECT pu, du FROM uploads INTERSECT SELECT pu, du FROM toxic_index)) AS in_both,
    (SELECT count(*) FROM (SELECT pu, du FROM uploads EXCEPT SELECT pu, du FROM toxic_index)) AS only_new,
    (SELECT count(*) FROM (SELECT pu, du FROM toxic_index EXCEPT SELECT pu, du FROM uploads)) AS only_old, (SELECT count(*) FROM uploads) AS members""")
S["g5_training_tier_shares"] = sql(f"SELECT tier, transforms, count(*) AS n FROM ({_DRAW}) GROUP BY tier, transforms", ti=_TIER)
S["g13_gate_baseline"] = sql(f"""SELECT 'A' AS config, arg_min(view, auroc) AS worst_cell, round(min(auroc), 6) AS worst_cell_auroc
    FROM (SELECT view, {AUC} AS auroc FROM rk GROUP BY view) WHERE view <> 'clean'""",
    rk=ranked(f"(SELECT a.view, a.label, a.logit AS p FROM branch_a a WHERE split = 'val' AND {_MEASURE})", ["view"]))


def _pivot(source: str, section: str, key: str, names: list[str], note: str = "NULL::VARCHAR") -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, {key} AS slice, '{n}' AS metric, round(({n})::DOUBLE, 6) AS value, {note} AS note FROM {source}" for n in names)


S["g9_header_statistics"] = """SELECT id, (9216 + CASE WHEN n > 0 THEN 4 + 69 * n ELSE 0 END)::DOUBLE AS file_size, 64.0::DOUBLE AS width, 48.0::DOUBLE AS height,
    3072.0::DOUBLE AS pixels, round(64.0::DOUBLE / 48, 6) AS aspect_ratio, 48.0::DOUBLE AS short_edge, round((9216 + CASE WHEN n > 0 THEN 4 + 69 * n ELSE 0 END)::DOUBLE / 3072, 6) AS bytes_per_pixel,
    round(coalesce(m, 0), 6) AS jpeg_quality, n::DOUBLE AS n_quant_tables, round(coalesce(m, 0), 6) AS q_mean, round(coalesce(d, 0), 6) AS q_std
    FROM (SELECT vec_id AS id, vec_id % 4 AS n FROM embeddings) LEFT JOIN (
        SELECT vec_id AS id, avg(v) AS m, stddev_pop(v) AS d FROM (
            SELECT vec_id, ('0x' || substr(sha256('q0:' || vec_id || ':' || k) || sha256('q1:' || vec_id || ':' || k), 2 * i + 1, 2))::INTEGER AS v
            FROM embeddings, range(3) t(k), range(64) u(i) WHERE k < vec_id % 4) GROUP BY vec_id) USING (id)"""
_REPORT = " UNION ALL ".join([
    _pivot("(SELECT *, n_fake + n_real AS n FROM vm WHERE view = 'clean')", "clean", "'clean'", ["n", "n_fake", "n_real", "auroc", "tpr", "fpr", "balanced_accuracy"]),
    _pivot("(SELECT sum(np::DOUBLE / tp * (tp - pb) / ((tp - pb) + (tn - nb))) AS average_precision FROM rk WHERE view = 'clean')", "clean", "'clean'", ["average_precision"]),
    _pivot("(SELECT avg((p - label) ** 2) AS brier FROM ts WHERE view = 'clean')", "clean", "'clean'", ["brier"]),
    _pivot("(SELECT sum(n * abs(my - mp)) / sum(n) AS ece FROM (SELECT bin, count(*) AS n, avg(p) AS mp, avg(label) AS my FROM ts JOIN edges ON p >= lo AND p < hi WHERE view = 'clean' GROUP BY bin))", "clean", "'clean'", ["ece"]),
    _pivot("(SELECT * FROM vm WHERE view <> 'clean')", "cells", "view", ["auroc", "auroc_drop", "mean_prob_fake", "mean_prob_real", "tpr", "fpr", "balanced_accuracy"]),
    _pivot("rb", "robustness", "worst_cell", ["macro_robust_auroc", "worst_cell_auroc", "clean_to_worst"]),
    _pivot("(SELECT *, view || '/' || point AS slice, fpr - target_fpr AS fpr_gap FROM op)", "operating_points", "slice", ["threshold", "tpr", "fpr", "fpr_gap"]),
    _pivot("(SELECT * FROM ci WHERE slice = 'clean')", "clean", "'clean'", ["ci_low", "ci_high"]),
    _pivot("(SELECT sl.*, ci_low, ci_high FROM sl LEFT JOIN ci USING (slice))", "slices", "slice", ["n", "n_fake", "n_real", "auroc", "ci_low", "ci_high"],
           "CASE WHEN auroc IS NULL THEN 'single-class slice; AUROC undefined' WHEN slice <> 'thumbnail_regime_cifake' THEN 'AUROC against all reals of the split; the axis itself holds fakes only' END"),
    _pivot("ct", "content", "content", ["n_pos", "n_neg", "auroc"]),
])
S["g14_evaluation_report"] = sql(
    _REPORT, edges=ECE_EDGES, ts="SELECT * FROM sv WHERE split = 'test'", rk=ranked("ts", ["view"]), vm=_VM.replace("FROM sv ", "FROM ts "), op=point_rows("view, ") % "ts",
    rb="""SELECT avg(auroc) FILTER (view <> 'clean') AS macro_robust_auroc, arg_min(view, auroc) FILTER (view <> 'clean') AS worst_cell, min(auroc) FILTER (view <> 'clean') AS worst_cell_auroc,
        max(auroc) FILTER (view = 'clean') - min(auroc) FILTER (view <> 'clean') AS clean_to_worst FROM vm""",
    cl="SELECT * FROM ts WHERE view = 'clean'",
    tg=CTES["tagged"].replace("FROM scored", "FROM cl") + " UNION ALL SELECT id, label, p, 'thumbnail_regime_cifake' FROM cl WHERE starts_with(source, 'CIFAKE/')",
    rs=ranked("tg", ["slice"]), sl=f"SELECT slice, max(tp) + max(tn) AS n, max(tp) AS n_fake, max(tn) AS n_real, {AUC} AS auroc FROM rs GROUP BY slice",
    rc=ranked("cl", ["content"]), ct=f"SELECT content, max(tp) AS n_pos, max(tn) AS n_neg, {AUC} AS auroc FROM rc GROUP BY content",
    every="SELECT id, slice, label, p FROM tg UNION ALL SELECT id, 'clean', label, p FROM cl", **intervals("every", "slice"))

# ── streaming, compared with its batch form ─────────────────────────────────
S["x1_streaming_triage"] = sql("SELECT image_path, round(pred, 6) AS pred, decision FROM triaged JOIN decisions USING (place)")
S["x2_streaming_windowed_counts"] = sql("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, decision, count(*) AS n
    FROM triaged JOIN decisions USING (place) GROUP BY 1, 2""")
S["x3_streaming_dedup"] = sql("SELECT DISTINCT dg AS sha256 FROM docs")
S["x3_streaming_dedup_sessions"] = """SELECT event_id, sha256(content) AS sha256 FROM (
    SELECT event_id, content, ts, lag(ts) OVER (PARTITION BY content ORDER BY ts, event_id) AS before
    FROM (SELECT event_id, ts, concat_ws(':', user_id, event_type) AS content FROM events WHERE ts IS NOT NULL)) WHERE before IS NULL OR ts > before + INTERVAL 12 HOUR"""
S["x4_streaming_screen"] = S["j3_near_duplicate_screen"]

STATEMENTS = S

"""Exact top-k by inner product: paged metric trees (M-trees), searched best first.

Distances are Euclidean. With d(q, x) >= low and |x| <= norm a node's score is at
most (|q|^2 + norm^2 - low^2) / 2, where low comes from the triangle inequality:
first from stored parent distances, without computing anything, then from the
distance to the node's pivot less its covering radius.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LEAF, FANOUT = 256, 16
SHARD_ROWS = 16_384         # vectors of one tree, about
MOST_SHARDS = 100_000       # rows of the directory that is sent to tasks; trees grow beyond it
MOST_PIVOTS = 4096          # routing vectors, the bounded sample of the upper level
BLOCK = 8192                # queries that one task asks of one tree
TOGETHER = 1024             # of them that walk the tree at once
NO_ID = np.iinfo(np.int64).max
FOUND = "query_id long, vec_id long, score long, q long"


class MTree:
    """Nodes as arrays: pivot, radius, distance to the parent's pivot, largest norm, smallest id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order].astype(np.float64)
        self.norms = np.sqrt((self.vectors ** 2).sum(axis=1))
        self.nodes: list[dict] = []
        self.root = self._node(np.arange(len(ids)), None)

    def _away(self, rows: np.ndarray, pivot: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.vectors[rows] - pivot) ** 2).sum(axis=1))

    def _node(self, rows: np.ndarray, pivot: np.ndarray | None) -> int:
        if pivot is None:
            pivot = self.vectors[rows[0]] if len(rows) else np.zeros(0)
        at, away = len(self.nodes), self._away(rows, pivot)
        node = {"pivot": pivot, "radius": away.max(initial=0), "norm": self.norms[rows].max(initial=0),
                "least": self.ids[rows].min(initial=np.iinfo(np.int64).max)}
        self.nodes.append(node)
        if len(rows) <= LEAF:
            node.update(rows=rows, away=away, vectors=self.vectors[rows], norms=self.norms[rows], ids=self.ids[rows])
            return at
        seeds = self.vectors[rows[np.linspace(0, len(rows) - 1, FANOUT).astype(int)]]
        part = ((seeds ** 2).sum(axis=1)[None] - 2 * self.vectors[rows] @ seeds.T).argmin(axis=1)
        if np.bincount(part).max() == len(rows):        # equal vectors: pages by id
            part = np.arange(len(rows)) * FANOUT // len(rows)
        children = [self._node(rows[part == k], seeds[k]) for k in range(FANOUT) if (part == k).any()]
        kids = [self.nodes[c] for c in children]
        node.update(children=np.array(children), pivots=np.array([k["pivot"] for k in kids]),
                    radii=np.array([k["radius"] for k in kids]), norms=np.array([k["norm"] for k in kids]),
                    parent=np.sqrt(((np.array([k["pivot"] for k in kids]) - pivot) ** 2).sum(axis=1)),
                    leasts=np.array([k["least"] for k in kids]))
        return at

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place of the query, id, score): the best ``k`` ids other than its own, at least its floor; ties to smaller ids.

        Best first for a block of queries: a node waits with those that may need it, and
        the node that promises one of them most is next. A query leaves a node's queue when
        what it has found rules the node out. A floor that is NaN is none.
        """
        n, square = len(queries), (queries ** 2).sum(axis=1)
        limit, last = np.where(np.isnan(floors), -np.inf, floors), np.full(n, NO_ID)      # at the limit only ids below last count
        scores, ids = np.full((n, k), -np.inf), np.full((n, k), NO_ID)

        def needed(reach, rows, node):
            return (reach >= limit[rows]) & ((np.floor(reach) > limit[rows]) | (node["least"] < last[rows]))

        queue: list[tuple] = []

        def wait(at, rows, most):
            node = self.nodes[at]
            away = np.sqrt(np.maximum(square[rows] + (node["pivot"] ** 2).sum() - 2 * queries[rows] @ node["pivot"], 0))
            reach = np.minimum(most, _most(square[rows], node["norm"], away - node["radius"]))
            keep = needed(reach, rows, node)
            if keep.any():
                heapq.heappush(queue, (-reach[keep].max(), at, rows[keep], away[keep], reach[keep]))

        wait(self.root, np.arange(n), np.full(n, np.inf))
        while queue:
            _, at, rows, away, reach = heapq.heappop(queue)
            node = self.nodes[at]
            keep = needed(reach, rows, node)
            rows, away = rows[keep], away[keep]
            if not len(rows):
                continue
            leaf = "rows" in node
            # stored distances to this pivot rule entries out before anything is computed for them
            low = np.abs(away[:, None] - (node["away"] if leaf else node["parent"])) - (0 if leaf else node["radii"])
            most = _most(square[rows][:, None], node["norms"], low)
            may = most >= limit[rows][:, None]
            if not leaf:
                for j, child in enumerate(node["children"].tolist()):
                    if may[:, j].any():
                        wait(child, rows[may[:, j]], most[may[:, j], j])
                continue
            some = np.flatnonzero(may.any(axis=0))
            found = np.rint(queries[rows] @ node["vectors"][some].T)
            found[~may[:, some] | (own[rows][:, None] == node["ids"][some])] = -np.inf
            if len(some) >= k:
                limit[rows], last[rows] = _raised(limit[rows], last[rows], np.partition(found, -k, axis=1)[:, -k])
            edge, at_edge = limit[rows][:, None], node["ids"][some] < last[rows][:, None]
            q, v = np.nonzero((found > -np.inf) & ((found > edge) | ((found == edge) & at_edge)))
            if len(q):
                touched = np.unique(rows[q])
                place = np.concatenate([rows[q], np.repeat(touched, k)])
                score = np.concatenate([found[q, v], scores[touched].ravel()])
                name = np.concatenate([node["ids"][some][v], ids[touched].ravel()])
                order = np.lexsort((name, -score, place))
                place, score, name = place[order], score[order], name[order]
                rank = np.arange(len(place)) - np.searchsorted(place, place)
                first = rank < k
                scores[place[first], rank[first]], ids[place[first], rank[first]] = score[first], name[first]
                kth, tied = scores[touched, -1], scores[touched, -1] >= limit[touched]
                limit[touched] = np.maximum(limit[touched], kth)
                last[touched] = np.where(tied & (kth > -np.inf), ids[touched, -1], NO_ID)
        place, rank = np.nonzero(scores > -np.inf)
        return place, ids[place, rank], scores[place, rank].astype(np.int64)


def _raised(limit: np.ndarray, last: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Limits raised to scores that ``k`` rows are known to reach; all ids count at a new limit."""
    return np.maximum(limit, least), np.where(least > limit, NO_ID, last)


def _most(square: float, norms: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Largest possible score; a little above the exact bound, never below it."""
    return (square + norms ** 2 - np.maximum(low, 0) ** 2) / 2 + 1e-9 * (square + norms ** 2) + 1e-6


def quantized(vec_col: str, scale: int = 64) -> Column:
    """floor(scale x) of each component, as double."""
    return F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))


def usable(vec_col: str) -> Column:
    """The vector and its components are there and finite."""
    inf = float("inf")
    good = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return F.col(vec_col).isNotNull() & F.coalesce(good, F.lit(False))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _assign(pivots: np.ndarray):
    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            page = ((pivots ** 2).sum(axis=1)[None] - 2 * x @ pivots.T).argmin(axis=1) if len(x) else np.zeros(0, np.int64)
            away = np.sqrt(((x - pivots[page]) ** 2).sum(axis=1)) if len(x) else np.zeros(0)
            norm = np.sqrt((x ** 2).sum(axis=1)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(page.astype(np.int64)), pa.array(away), pa.array(norm)],
                                             ["id", "vec", "page", "away", "norm"])

    return run


def _route(pivots: np.ndarray, directory: list, first: bool):
    """Trees that a query must ask: the most promising one, or all others its floor does not rule out."""
    page, radius, norm = (np.array([d[i] for d in directory]) for i in (1, 2, 3))
    page = page.astype(int)

    def run(batches):
        for batch in batches:
            x, out = _matrix(batch.column(1)), ([], [])
            floors = batch.column(2).to_numpy(zero_copy_only=False)
            for i in range(len(x)):
                away = np.sqrt(((pivots - x[i]) ** 2).sum(axis=1))
                reach = _most(float(x[i] @ x[i]), norm, away[page] - radius)
                home = int(reach.argmax())
                asked = [home] if first else [s for s in np.flatnonzero(~(reach < floors[i])).tolist() if s != home]
                out[0].extend([i] * len(asked))
                out[1].extend(directory[s][0] for s in asked)
            rows = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out[1], pa.int64()), *[c.take(rows) for c in batch.columns]],
                                             ["shard", "id", "vec", "floor", "q"])

    return run


def _search(k: int):
    def run(key, vectors, queries):
        out = [(np.zeros(0, np.int64),) * 4]
        if len(vectors) and len(queries):
            tree = MTree(vectors["id"].to_numpy(), _matrix(vectors["vec"]))
            numbers = queries["q"].to_numpy()
            own, asked, floors = queries["id"].to_numpy(), _matrix(queries["vec"]), queries["floor"].cast(pa.float64()).to_numpy()
            for a in range(0, len(own), TOGETHER):
                part = slice(a, a + TOGETHER)
                place, ids, scores = tree.search(asked[part], own[part], k, floors[part])
                out.append((own[part][place], ids, scores, numbers[part][place]))
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["query_id", "vec_id", "score", "q"])

    return run


def _ask(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Search trees for their queries; a tree that very many ask is copied for blocks of them."""
    asked = materialize(asked, "asked")
    blocks = asked.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    copies = (vectors.join(F.broadcast(blocks), "shard")        # at most MOST_SHARDS rows
              .select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "vec"))
    dealt = asked.join(F.broadcast(blocks), "shard").select(
        "shard", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "vec", "floor", "q")
    return copies.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInArrow(_search(k), FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = 64, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best other rows by integer inner product.

    Vectors are dealt to pages by the nearest of a bounded sample of pivots, and
    large pages to several trees, so equal vectors don't meet in one. A query asks
    its most promising tree first; the score it finds there rules out others. Null
    ids and vectors that are null or hold null or non-finite components take no
    part; vectors of different lengths are never compared; ties go to the smaller
    id, a query is never compared with rows of its own id. Rows that repeat an id
    are candidates each; as queries, equal rows ask once and different vectors of
    one id ask each for itself, with ranks of their own. An empty table gives no rows.
    """
    rows = vectors.filter(usable(vec_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), quantized(vec_col, scale).alias("vec"), is_query.alias("is_query"))
    rows = materialize(rows, "vectors")
    parts = [_top_k(rows.filter(F.size("vec") == size), k, shard_rows).withColumn("size", F.lit(size))
             for (size,) in rows.select(F.size("vec")).distinct().collect()]      # one row per vector length
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    rank = Window.partitionBy("size", "q").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _top_k(rows: DataFrame, k: int, shard_rows: int) -> DataFrame:
    n = rows.count()
    shard_rows = max(shard_rows, math.ceil(n / MOST_SHARDS))
    n_pivots = min(MOST_PIVOTS, max(1, math.ceil(n / shard_rows)))
    sample = rows.orderBy(F.xxhash64("id")).limit(n_pivots).select("vec").collect()
    pivots = np.unique(np.array([r[0] for r in sample], np.float64).reshape(len(sample), -1), axis=0)
    placed = materialize(rows.select("id", "vec").mapInArrow(
        _assign(pivots), "id long, vec array<double>, page long, away double, norm double"), "pages")
    pages = placed.groupBy("page").agg(F.ceil(F.count("*") / F.lit(shard_rows)).cast("long").alias("trees"))
    base = Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.withColumn("base", F.coalesce(F.sum("trees").over(base), F.lit(0)))      # MOST_PIVOTS rows at most
    sharded = placed.join(F.broadcast(pages), "page").withColumn("shard", F.col("base") + F.pmod(F.xxhash64("id"), F.col("trees")))
    directory = [tuple(r) for r in sharded.groupBy("shard", "page").agg(F.max("away"), F.max("norm")).orderBy("shard").collect()]
    trees = sharded.select("shard", "id", "vec")
    asks = "shard long, id long, vec array<double>, floor long, q long"
    # numbered once and written: the number, not the id, tells queries apart
    queries = materialize(rows.filter("is_query").select("id", "vec").distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
    queries = queries.select("id", "vec", F.lit(None).cast("long").alias("floor"), "q")
    near = materialize(_ask(trees, queries.mapInArrow(_route(pivots, directory, True), asks), k), "nearest")
    floors = near.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k)
    raised = queries.drop("floor").join(floors, "q", "left").select("id", "vec", F.col("least").alias("floor"), "q")
    return near.unionByName(_ask(trees, raised.mapInArrow(_route(pivots, directory, False), asks), k))

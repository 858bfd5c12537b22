"""Exact top-k search by inner product with cover trees over queries and candidates.

1. Both sides are cut into blocks of near vectors: by the nearest of some pivots, and by id
   where a pivot has many. Each block's cover tree is built once and stored.
2. A block of queries first searches the candidate blocks that promise most. Then it meets
   only those whose root, by its covering radius, allows a score as high as the worst kth
   score of its queries so far.
3. A search walks both trees together: a pair of nodes is skipped where the best inner
   product that their covering radii allow is below the worst kth score of the query
   node's group.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

#: Vectors in a block of candidates and of queries.
CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 1024
#: Pivots that vectors are dealt out by, and vectors that they are chosen from.
PIVOTS = 256
PIVOT_SAMPLE = 4096
#: Candidate blocks that a block of queries searches before any is left out.
FIRST_BLOCKS = 2
#: Pairs of blocks are dealt to at most so many tasks.
MOST_PARTITIONS = 20_000
#: A node of so many points is not split further.
LEAF = 48
#: Ratio of the radii of two levels. Distances of vectors with many components differ little,
#: and with a ratio of 2 nearly every point would be a child of the root.
BASE = 1.15
#: Candidates that are scored at a time.
SCORED = 256
#: Stand-ins of a place that no candidate has taken yet.
NO_SCORE, NO_ID = -(1 << 62), (1 << 63) - 1


class CoverTree:
    """A cover tree: every level lessens the radius within which a node's centre covers its points.

    Centres of siblings are further apart than that radius, a node's centre is also that of
    its first child, and each point belongs to its nearest centre. Nodes are arrays:
    ``centre`` (row), ``radius`` (largest distance to a point of the node), children
    ``first`` to ``last``, and points ``order[low:high]``.
    """

    def __init__(self, points: np.ndarray):
        self.points = points = points.astype(np.float64)
        self.squares = np.einsum("ij,ij->i", points, points)
        self.order = np.arange(len(points))
        self.centre, self.radius, self.low, self.high, self.children = [], [], [], [], []
        if len(points):
            self._node(0, 0, len(points), self._distances(0, self.order))

    def packed(self) -> bytes:
        return pickle.dumps((self.points.astype(np.int32), self.order, self.centre, self.radius, self.low, self.high, self.children), 5)

    @classmethod
    def unpacked(cls, data: bytes) -> CoverTree:
        tree = cls(np.zeros((0, 0)))
        points, tree.order, tree.centre, tree.radius, tree.low, tree.high, tree.children = pickle.loads(data)
        tree.points = points.astype(np.float64)
        tree.squares = np.einsum("ij,ij->i", tree.points, tree.points)
        return tree

    def _distances(self, row: int, rows: np.ndarray) -> np.ndarray:
        square = self.squares[rows] + self.squares[row] - 2 * (self.points[rows] @ self.points[row])
        return np.sqrt(np.maximum(square, 0))

    def _node(self, centre: int, low: int, high: int, distance: np.ndarray) -> int:
        me = len(self.centre)
        radius = float(distance.max())
        self.centre.append(centre)
        self.radius.append(radius * (1 + 1e-9) + 1e-6)
        self.low.append(low)
        self.high.append(high)
        self.children.append([])
        if high - low <= LEAF or radius == 0:
            return me
        rows = self.order[low:high]
        best, owner, centres, cover = distance.copy(), np.zeros(len(rows), np.int64), [centre], radius / BASE
        while (far := int(best.argmax())) >= 0 and best[far] > cover:
            d = self._distances(int(rows[far]), rows)
            nearer = d < best
            best[nearer], owner[nearer] = d[nearer], len(centres)
            centres.append(int(rows[far]))
        sort = np.argsort(owner, kind="stable")
        self.order[low:high], best = rows[sort], best[sort]
        edges = low + np.searchsorted(owner[sort], np.arange(len(centres) + 1))
        for c, a, b in zip(centres, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b > a:
                self.children[me].append(self._node(c, a, b, best[a - low : b - low]))
        return me


class TopK:
    """The best scores of a block of queries so far; ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.scores = np.full((len(ids), k), NO_SCORE)
        self.found = np.full((len(ids), k), NO_ID)

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores[i, j]`` of query row i with candidate j; a query's own id is passed over."""
        scores = np.where(self.ids[rows][:, None] == ids[None, :], NO_SCORE, scores)
        better = scores >= self.scores[rows, -1][:, None]
        some, columns = better.any(axis=1), better.any(axis=0)
        rows, ids, scores = rows[some], ids[columns], scores[some][:, columns]
        if not len(rows):
            return
        scores = np.concatenate([self.scores[rows], scores], axis=1)
        found = np.concatenate([self.found[rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
        found = np.where(scores == NO_SCORE, NO_ID, found)
        order = np.lexsort((found, -scores), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(scores, order, 1)
        self.found[rows] = np.take_along_axis(found, order, 1)


def dual_search(queries: CoverTree, tree: CoverTree, ids: np.ndarray, best: TopK) -> None:
    """Offer ``best`` every candidate of ``tree`` that may be among a query's top k.

    A pair of nodes is opened on the query side until its group is a leaf, then on the
    candidates' side. Bounds of all children are taken at once and the most promising
    are followed first; candidate leaves are scored together, some hundred points at a time.
    """
    if not len(queries.points) or not len(tree.points):
        return
    q_length, t_length = np.sqrt(queries.squares), np.sqrt(tree.squares)
    q_centre, t_centre = np.array(queries.centre), np.array(tree.centre)
    q_radius, t_radius = np.array(queries.radius), np.array(tree.radius)

    def bounds(q: np.ndarray, t: np.ndarray) -> np.ndarray:
        a, b, r, s = q_centre[q], t_centre[t], q_radius[q], t_radius[t]
        dots = np.einsum("ij,ij->i", *np.broadcast_arrays(queries.points[a], tree.points[b]))
        return dots + r * t_length[b] + s * q_length[a] + r * s + 1e-6

    def worst(q: int) -> int:
        return best.scores[queries.order[queries.low[q] : queries.high[q]], -1].min()

    one = np.zeros(1, np.int64)
    stack = [(float(bounds(one, one)[0]), 0, 0)]
    while stack:
        limit, q, t = stack.pop()
        if limit < worst(q):
            continue
        if queries.children[q]:
            below = np.array(queries.children[q])
            found = bounds(below, np.array([t]))
            stack += [(float(found[i]), int(below[i]), t) for i in np.argsort(found)]
            continue
        below = np.array(tree.children[t]) if tree.children[t] else np.array([t])
        found = bounds(np.array([q]), below)
        order = np.argsort(-found)
        order = order[found[order] >= worst(q)]
        leaf = np.array([not tree.children[c] for c in below[order]], bool)
        inner = order[~leaf]
        rows = queries.order[queries.low[q] : queries.high[q]]
        part: list[np.ndarray] = []
        for k, i in enumerate(leaves := order[leaf].tolist()):
            if not part and found[i] < worst(q):
                break
            c = below[i]
            part.append(tree.order[tree.low[c] : tree.high[c]])
            if k + 1 == len(leaves) or sum(map(len, part)) >= SCORED:
                at = np.concatenate(part)
                best.offer(rows, ids[at], np.rint(queries.points[rows] @ tree.points[at].T).astype(np.int64))
                part = []
        stack += [(float(found[i]), q, int(below[i])) for i in inner[::-1]]


def pivots_of(points: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` of ``points``, each the furthest from those before it."""
    if not len(points):
        return points
    chosen, nearest = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < n and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0))


def _blocks(whole: DataFrame, pivots: np.ndarray, size: int, label: str) -> DataFrame:
    """``(block, centre, radius, ids, tree)`` of rows (id, vec): a row for each block."""
    squares = (pivots**2).sum(axis=1)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column(1), batch.num_rows).astype(np.float64)
            pivot = (squares - 2 * points @ pivots.T).argmin(axis=1) if len(points) else np.zeros(0, np.int64)
            yield pa.record_batch([*batch.columns, pa.array(pivot.astype(np.int32))], ["id", "vec", "pivot"])

    placed = stored(whole.mapInArrow(nearest, "id long, vec array<bigint>, pivot int"), label)
    counts = {r["pivot"]: r["count"] for r in placed.groupBy("pivot").count().collect()}  # a row for each pivot
    pieces = [max(1, -(-counts.get(i, 0) // size)) for i in range(len(pivots))]
    first = np.concatenate([[0], np.cumsum(pieces)]).tolist()
    of = lambda numbers: F.element_at(F.array(*[F.lit(int(x)) for x in numbers]), F.col("pivot") + 1)
    dealt = placed.select((of(first[:-1]) + F.pmod(F.xxhash64("id"), of(pieces))).cast("int").alias("block"), "id", "vec")

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def close() -> pa.RecordBatch:
            rows = []
            if held:
                tree = CoverTree(np.concatenate([p for _, p in held]))
                rows = [(at, tree.points[tree.centre[0]].tolist(), tree.radius[0], np.concatenate([i for i, _ in held]).tolist(), tree.packed())]
            kinds = [pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.int64()), pa.binary()]
            return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["block", "centre", "radius", "ids", "tree"])

        for batch in batches:
            block, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            points = _matrix(batch.column(2), batch.num_rows)
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a and block[a] != at:
                    yield close()
                    at, held = int(block[a]), []
                if b > a:
                    held.append((ids[a:b].copy(), points[a:b].copy()))
        yield close()

    n = min(first[-1], MOST_PARTITIONS)
    built = dealt.repartition(n, "block").sortWithinPartitions("block").mapInArrow(trees, "block int, centre array<double>, radius double, ids array<bigint>, tree binary")
    return stored(built, f"{label}-trees")


def _search_blocks(k: int):
    """mapInArrow over rows (q, query_ids, query_tree, ids, tree, scores): what a block of queries finds in one of candidates.

    ``scores``: each query's kth score so far, in the order of query_ids; what isn't better is passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, t_ids = (batch.column(j)[i].values.to_numpy() for j in (1, 3))
                queries, tree = (CoverTree.unpacked(batch.column(j)[i].as_py()) for j in (2, 4))
                best = TopK(q_ids, k)
                if batch.column(5)[i].is_valid:
                    best.scores[:] = batch.column(5)[i].values.to_numpy()[:, None]
                dual_search(queries, tree, t_ids, best)
                real = best.found < NO_ID
                out = [np.repeat(q_ids, real.sum(axis=1)), best.found[real], best.scores[real]]
                yield pa.record_batch([batch.column(0).take(pa.array([i] * len(out[0]), pa.int64())), *[pa.array(x, pa.int64()) for x in out]], ["q", "query_id", "vec_id", "score"])

    return run


def block_pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(q, t, bound)``: the best inner product that each pair of blocks allows, from their roots.

    Every block of queries is held against every root, a vector and a radius, of candidates.
    """
    centres = candidates.select(F.col("block").alias("t"), F.col("centre").alias("t_centre"), F.col("radius").alias("t_radius"))
    most = candidates.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]
    roots = queries.select(F.col("block").alias("q"), F.col("centre").alias("q_centre"), F.col("radius").alias("q_radius"), F.explode(F.sequence(F.lit(0), F.lit(most))).alias("t"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    length = lambda a: F.sqrt(dot(a, a))
    bound = dot("q_centre", "t_centre") + F.col("q_radius") * length("t_centre") + F.col("t_radius") * length("q_centre") + F.col("q_radius") * F.col("t_radius") + 1e-3
    return roots.join(centres, "t").select("q", "t", bound.alias("bound"))


def top_k_inner_product(queries: DataFrame, candidates: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "vec", candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` largest inner products, exactly.

    Both sides have a bigint id and a vector of integers, array<bigint>, all of one length
    and below 2**20 in size, so sums are exact. A query isn't its own candidate; ties go to
    the smaller id; a query with fewer candidates has fewer rows. Rows with a null id or
    vector, or a vector with a null, take no part; of rows that repeat an id with other
    vectors each is a candidate and the best counts once. Other columns aren't read. Blocks
    have a bounded size, so tasks do. Pivots come from ``PIVOT_SAMPLE`` vectors; they decide
    which vectors share a block, never what is found.
    """

    def whole(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<bigint>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL AND NOT exists(vec, x -> x IS NULL)").distinct()

    left, right = whole(queries), whole(candidates)
    sample = right.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("vec").collect()
    schema = "query_id long, rank int, vec_id long, score long"
    if not sample:
        return queries.sparkSession.createDataFrame([], schema)
    pivots = pivots_of(np.array([r["vec"] for r in sample], np.float64), min(PIVOTS, -(-right.count() // candidate_block)))
    q_blocks, t_blocks = _blocks(left, pivots, query_block, "queries"), _blocks(right, pivots, candidate_block, "candidates")
    pairs = stored(block_pairs(q_blocks, t_blocks).withColumn("turn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "t"))), "block-pairs")
    q_side = q_blocks.select(F.col("block").alias("q"), F.col("ids").alias("query_ids"), F.col("tree").alias("query_tree"))
    t_side = t_blocks.select(F.col("block").alias("t"), "ids", "tree")
    found_schema = "q int, query_id long, vec_id long, score long"

    def searched(chosen: DataFrame, kth: DataFrame | None, label: str) -> DataFrame:
        chosen = stored(chosen, f"{label}-pairs")
        met = chosen.join(q_side, "q")
        met = met.join(kth, "q") if kth is not None else met.withColumn("scores", F.lit(None).cast("array<bigint>"))
        rows = met.join(t_side, "t").select("q", "query_ids", "query_tree", "ids", "tree", "scores", "t")
        n = max(1, min(chosen.count(), MOST_PARTITIONS))
        # a number, so that pairs of few bytes but much work aren't put together
        return stored(rows.repartition(n, "q", "t").drop("t").mapInArrow(_search_blocks(k), found_schema), label)

    def top(found: DataFrame) -> DataFrame:
        best = found.groupBy("q", "query_id", "vec_id").agg(F.max("score").alias("score")).groupBy("q", "query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("lost"), "vec_id"))), 1, k).alias("all"))
        return best

    first = searched(pairs.where(f"turn <= {FIRST_BLOCKS}").select("q", "t"), None, "first")
    lost = top(first).where(F.size("all") == k).select("q", "query_id", (-F.element_at("all", -1)["lost"]).alias("kth"))
    # each query's kth score, in the order of its block's ids; none yet counts as the lowest
    each = q_blocks.select(F.col("block").alias("q"), F.posexplode("ids").alias("at", "query_id")).join(lost, ["q", "query_id"], "left")
    kth = stored(each.groupBy("q").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("kth", F.lit(NO_SCORE)).alias("kth")))), lambda x: x["kth"]).alias("scores")), "kth-scores")
    worst = kth.select("q", F.array_min("scores").alias("worst"))
    rest = searched(pairs.where(f"turn > {FIRST_BLOCKS}").join(worst, "q").where("bound >= worst").select("q", "t"), kth, "then")
    return top(first.union(rest)).select("query_id", F.posexplode("all").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", (-F.col("x.lost")).alias("score"))


def quantized(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``(vec_id, vec)``: every component x as floor(scale * x); vectors that aren't finite go."""
    finite = f"{vec_col} IS NOT NULL AND {id_col} IS NOT NULL AND NOT exists({vec_col}, x -> x IS NULL OR isnan(x) OR abs(CAST(x AS double)) = double('infinity'))"
    return embeddings.where(finite).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vec"))

"""N-gram Jaccard self-join by T-occurrence search (DivideSkip).

1. Texts with equal n-gram sets form a class, known by a digest of the set. The same
   pass counts n-grams in a sketch of fixed size, summed over all texts.
2. One order holds for all n-grams: by the sketch's count, then by the n-gram, so those
   that many texts share come last. Each class deals out the first ones, as many as a
   partner may miss and ``SHARED`` more; two classes that link always share so many of
   these, whatever the counts are. Pairs whose sizes allow a link and that do are joined;
   where an n-gram has more than ``CROWD`` partners for a class, these are joined one to
   the next without being counted. The connected classes are a block. Blocks that are too
   large are cut into a grid of pairs of pieces.
3. In each block, inverted lists answer one T-occurrence query per class: the longest
   lists are set aside, the short ones merged through a heap of their heads that skips
   ids which too few lists can hold, and the candidates probed in the long ones by
   binary search. Overlaps and links are then exact.

No step loses a link. N-grams are 64-bit hashes: two different ones of a pair of texts
agree with a probability of about 5e-20 for each pair of n-grams. Classes are told apart
by 128 bits, and by 64 within blocks.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .components import connected_components
from .storage import cut, release, stored

#: Counters of the sketch, and the parts in which tasks hand it over.
SKETCH = 1 << 20
SLICES = 64
#: N-grams that two classes share among their first ones, and a number that all up to it divide.
SHARED = 3
ENOUGH = 6
#: Partners of a class at one n-gram that are paired with it one by one.
CROWD = 4
#: Bits that tell which ids have a class in a block; false hits are dropped by the join.
ID_BITS = 1 << 25
#: N-grams of a block's pieces that one task holds at once.
PIECE_GRAMS = 1_000_000
#: Constant of the DivideSkip paper's rule for the number of long lists.
MU = 0.0085
#: Postings that are counted at once; more are merged through the heap, so many ids at a time.
STRETCH = 1 << 18
#: A binary search costs about as much as reading so many postings.
PROBE = 25


def _least(percent: int, n: int) -> int:
    """Smallest overlap of a set of ``n`` with any partner."""
    return -(-percent * n // 100)


def prefix_lengths(percent: int, n: int, shared: int = 1) -> tuple[int, int]:
    """N-grams of a set of ``n`` that meet ``shared`` of a partner's (or all that a link needs): a smaller one's, and one's at least as large."""
    return min(n, n - _least(percent, n) + shared), min(n, n + (-2 * percent * n // (100 + percent)) + shared)


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _key(mark: bytes) -> int:
    return int.from_bytes(mark[:8], "little", signed=True)


def _cells(grams: np.ndarray) -> np.ndarray:
    return (grams & np.uint64(SKETCH - 1)).astype(np.int64)


def _classes(docs: DataFrame, n: int) -> DataFrame:
    """(id, mark, n, digest, key) of every text, and (slice, counts) of each task's sketch.

    key is the first half of the digest. A set that a task meets again isn't counted again.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = np.zeros(SKETCH, np.uint32), set()
        names = ["id", "mark", "n", "digest", "key", "slice", "counts"]
        for batch in batches:
            sizes, marks, fresh = [], [], [np.zeros(0, np.int64)]
            for grams in wordhash.gram_sets(batch.column(1), n):
                sizes.append(len(grams))
                marks.append(mark := _digest(grams))
                if _key(mark) not in seen:
                    seen.add(_key(mark))
                    fresh.append(_cells(grams))
            sketch += np.bincount(np.concatenate(fresh), minlength=SKETCH).astype(np.uint32)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array([_key(m) for m in marks], pa.int64()), pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())], names)
        parts = [(i, part) for i, part in enumerate(np.split(sketch, SLICES)) if part.any()]
        empty = [pa.nulls(len(parts), kind) for kind in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())]
        yield pa.record_batch([*empty, pa.array([i for i, _ in parts], pa.int32()), pa.array([zlib.compress(part.astype("<u4").tobytes(), 1) for _, part in parts], pa.binary())], names)

    return docs.select("id", "text", F.xxhash64("text").alias("mark")).mapInArrow(digests, "id long, mark long, n long, digest binary, key long, slice int, counts binary")


def _summed(members: DataFrame) -> np.ndarray:
    """The sketch of all texts: ``SKETCH`` numbers, whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(zlib.decompress(counts.as_buffer()), "<u4")
                sums[i] = sums[i] + part if i in sums else part.astype(np.uint64)
        yield pa.record_batch([pa.array(sums, pa.int32()), pa.array([np.minimum(x, 0xFFFFFFFF).astype("<u4").tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])

    parts = members.where("slice IS NOT NULL").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(add, "slice int, counts binary").collect()
    sketch = np.zeros((SLICES, SKETCH // SLICES), np.uint32)
    for row in parts:
        sketch[row["slice"]] = np.frombuffer(row["counts"], "<u4")
    return sketch.reshape(-1)


def ordered(grams: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Sorted ``grams`` in the order that all texts share: rarest first, as far as the sketch tells."""
    counts = np.minimum(sketch[_cells(grams)], np.uint32((1 << 24) - 1)).astype(np.uint64)
    return grams[np.argsort(counts << np.uint64(40) | grams >> np.uint64(24), kind="stable")]


def _deal(n: int, percent: int, sketch):
    """mapInArrow over texts: rows (gram, size, key, other) of each class's first n-grams.

    size is four times the set's size, two more where the n-gram is too late for partners that
    are larger. Of more than ``CROWD`` classes of a batch that agree in n-gram and size the
    first is dealt out, its size one more, for all; the rest are joined with it here: rows
    with ``other``, dealt by key.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        order = sketch.value
        for batch in batches:
            out, sizes, keys = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for grams in wordhash.gram_sets(batch.column(0), n):
                if not len(grams) or (key := _key(_digest(grams))) in seen:
                    continue
                seen.add(key)
                probed, indexed = prefix_lengths(percent, len(grams), SHARED)
                out.append(ordered(grams, order)[:probed])
                size = np.full(probed, 4 * len(grams) + 2)
                size[:indexed] -= 2
                sizes.append(size)
                keys.append(np.full(probed, key))
            gram, size, key = np.concatenate(out).view(np.int64), np.concatenate(sizes), np.concatenate(keys)
            by = np.lexsort((size, gram))
            gram, size, key = gram[by], size[by], key[by]
            first = np.ones(len(gram), bool)
            first[1:] = (gram[1:] != gram[:-1]) | (size[1:] != size[:-1])
            run = np.cumsum(first) - 1
            crowd = np.bincount(run, minlength=1)[run] > CROWD
            kept = first | ~crowd
            yield pa.record_batch([pa.array(gram[kept]), pa.array((size + crowd)[kept]), pa.array(key[kept]), pa.nulls(int(kept.sum()), pa.int64())], ["gram", "size", "key", "other"])
            leader = key[np.flatnonzero(first)[run]]
            pairs = np.unique(np.stack([key[~kept], leader[~kept]]), axis=1) if not kept.all() else np.zeros((2, 0), np.int64)
            yield pa.record_batch([pa.array(pairs[0]), pa.array(np.zeros(pairs.shape[1], np.int64)), pa.array(pairs[0]), pa.array(pairs[1])], ["gram", "size", "key", "other"])

    return deal


def _met(percent: int):
    """mapInArrow over rows (gram, size, key, other) sorted by gram, size and key: (a, b, weight) of classes that may link.

    Each class with those before it whose n-gram is early enough, if the sizes allow a link;
    weights of a pair add up to ``ENOUGH`` where it shares as many n-grams as a link needs,
    ``SHARED`` at most. A class with more than ``CROWD`` such partners at an n-gram joins
    them all, one to the next, with all of ``ENOUGH``: so no count of theirs is needed. As
    partners of a later class are partners of this one, too, those are joined already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(3)]
            done = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            links = [np.stack([rows[2][done], batch.column(3).filter(pa.array(done)).to_numpy(), np.full(int(done.sum()), ENOUGH)])]
            gram, size, key = (np.concatenate([h, r[~done]]) for h, r in zip(held, rows, strict=True))
            if len(gram):
                fresh = np.arange(len(gram)) >= len(held[0])
                other = np.ones(len(gram), bool)  # a class that several tasks dealt out counts once
                other[1:] = (gram[1:] != gram[:-1]) | (size[1:] != size[:-1]) | (key[1:] != key[:-1])
                gram, size, key, fresh = gram[other], size[other], key[other], fresh[other]
                number = np.cumsum(np.concatenate([[0], gram[1:] != gram[:-1]])) << 32
                n, early, crowd = size >> 2, np.flatnonzero(size & 2 == 0), size & 1
                high = np.searchsorted(early, np.arange(len(gram)))
                low = np.minimum(high, np.searchsorted((number + n)[early], number - (-percent * n // 100)))
                weight = np.concatenate([[0], np.cumsum(1 + CROWD * crowd[early])])
                many = fresh & (high > low) & ((weight[high] - weight[low] > CROWD) | (crowd == 1))
                length = np.where(fresh & ~many, high - low, 0)
                me = np.repeat(np.arange(len(gram)), length)
                it = early[np.repeat(low - (np.cumsum(length) - length), length) + np.arange(len(me))]
                need = np.minimum(SHARED, -(-percent * (n[me] + n[it]) // (100 + percent)))
                links.append(np.stack([key[me], key[it], ENOUGH // np.maximum(1, need)]))
                links.append(np.stack([key[many], key[early[high[many] - 1]], np.full(int(many.sum()), ENOUGH)]))
                chained = np.zeros(len(early) + 1, np.int64)
                np.add.at(chained, low[many], 1)
                np.add.at(chained, high[many] - 1, -1)
                chained = np.flatnonzero(np.cumsum(chained)[:-1])
                links.append(np.stack([key[early[chained]], key[early[chained + 1]], np.full(len(chained), ENOUGH)]))
                last = early[number[early] == number[-1]][-CROWD - 1 :]
                last = np.union1d(last, [len(gram) - 1])
                held = [x[last] for x in (gram, size, key)]
            a, b, weight = np.concatenate(links, axis=1)
            a, b, weight = (x[a != b] for x in (np.maximum(a, b), np.minimum(a, b), weight))
            by = np.lexsort((b, a))
            a, b, weight = a[by], b[by], weight[by]
            at = np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            weight = np.minimum(ENOUGH, np.add.reduceat(weight, at)) if len(at) else weight
            yield pa.record_batch([pa.array(a[at]), pa.array(b[at]), pa.array(weight, pa.int32())], ["a", "b", "weight"])

    return run


def _candidates(docs: DataFrame, n: int, percent: int, sketch) -> DataFrame:
    """(a, b): keys of classes whose components hold all links."""
    dealt = docs.select("text").mapInArrow(_deal(n, percent, sketch), "gram long, size long, key long, other long")
    met = dealt.repartition("gram").sortWithinPartitions("gram", "size", "key").mapInArrow(_met(percent), "a long, b long, weight int")
    return met.groupBy("a", "b").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= ENOUGH).select("a", "b")


def _bits(ids: DataFrame) -> np.ndarray:
    """``ID_BITS`` bits, set at the slots of ``ids``, whatever their number."""
    slots = ids.select(F.expr("slot div 32768").alias("part"), F.expr("slot % 32768").alias("at")).repartition("part")
    bits = np.zeros((ID_BITS >> 15, 4096), np.uint8)
    for row in slots.groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits")).collect():
        bits[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return bits.reshape(-1)


class Lists:
    """Inverted lists over sets that are ordered by size."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        grams = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(grams, kind="stable")
        self.grams, number = np.unique(grams[order], return_inverse=True)
        self.places = max(1, len(sets))
        self.posting = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.coded = number * self.places + self.posting  # the posting's list and set in one sorted number

    def _gathered(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = end - begin
        return self.posting[np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())]

    def merged(self, begin: np.ndarray, end: np.ndarray, need: int, low: int, high: int, stretch: int | None = None) -> np.ndarray:
        """How many of the lists hold each of the sets ``low`` to ``high``; fewer than ``need`` may read as none.

        Lists run from ``begin`` to ``end`` and hold these sets only. A heap of their heads gives
        the sets in order; no set below the ``need``-th head is in so many lists, so all lists skip to that.
        """
        stretch = stretch or STRETCH
        if (end - begin).sum() <= stretch:
            return np.bincount(self._gathered(begin, end) - low, minlength=high - low)
        counts = np.zeros(high - low, np.int64)
        width = max(1, stretch // len(begin))
        at, stop, base = begin.tolist(), end.tolist(), (self.coded[begin] - self.posting[begin]).tolist()
        heap = [(int(self.posting[a]), i) for i, a in enumerate(at)]
        heapq.heapify(heap)
        while len(heap) >= need:
            first = heapq.nsmallest(need, heap)[-1][0] if need > 1 else heap[0][0]
            popped = []
            while heap and heap[0][0] < first + width:
                popped.append(heapq.heappop(heap)[1])
            codes = np.array([base[i] for i in popped])
            starts = np.maximum([at[i] for i in popped], np.searchsorted(self.coded, codes + first))
            ends = np.minimum([stop[i] for i in popped], np.searchsorted(self.coded, codes + first + width))
            np.add.at(counts, self._gathered(starts, np.maximum(starts, ends)) - low, 1)
            for i, e in zip(popped, ends.tolist(), strict=True):
                at[i] = e
                if e < stop[i]:
                    heapq.heappush(heap, (int(self.posting[e]), i))
        return counts

    def search(self, query: np.ndarray, percent: int, low: int) -> tuple[np.ndarray, np.ndarray]:
        """(sets from ``low`` on that link with ``query``, their overlaps), by DivideSkip."""
        none = np.zeros(0, np.int64)
        n = len(query)
        need = _least(percent, n)
        high = int(np.searchsorted(self.sizes, 100 * n // percent, "right"))
        low = max(low, int(np.searchsorted(self.sizes, need, "left")))
        if low >= high:
            return none, none
        at = np.searchsorted(self.grams, query)
        at = at[(at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] == query)]
        begin, end = np.searchsorted(self.coded, at * self.places + low), np.searchsorted(self.coded, at * self.places + high)
        some = end > begin
        at, begin, end = at[some], begin[some], end[some]
        if len(at) < need:
            return none, none
        order = np.argsort(begin - end, kind="stable")
        at, begin, end = at[order], begin[order], end[order]
        length = end - begin
        aside = min(need - 1, int(need / (MU * math.log2(max(2, length[0])) + 1)))
        counts = self.merged(begin[aside:], end[aside:], need - aside, low, high)
        found = np.flatnonzero(counts >= need - aside)
        overlap = counts[found]
        left = aside
        while left:
            keep = overlap + left >= need
            found, overlap = found[keep], overlap[keep]
            if not len(found):
                return none, none
            some = slice(max(0, left - max(8, (1 << 16) // len(found))), left)
            if length[some].sum() <= PROBE * len(found) * (some.stop - some.start):
                overlap = overlap + np.bincount(self._gathered(begin[some], end[some]) - low, minlength=high - low)[found]
            else:
                wanted = at[some, None] * self.places + (low + found)
                slot = np.minimum(np.searchsorted(self.coded, wanted), len(self.coded) - 1)
                overlap = overlap + (self.coded[slot] == wanted).sum(axis=0)
            left = some.start
        found = low + found
        keep = 100 * overlap >= percent * (n + self.sizes[found] - overlap)
        return found[keep], overlap[keep]


def _link_block(left: list[tuple], right: list[tuple] | None, percent: int) -> list[tuple[int, int, int]]:
    """(key, smallest key it reaches here, links) of the (key, copies, set) that have a link.

    ``right`` None: links within ``left``; else only those between the two.
    """
    left = sorted(left, key=lambda x: (len(x[2]), x[0]))
    right_rows = left if right is None else sorted(right, key=lambda x: (len(x[2]), x[0]))
    lists = Lists([x[2] for x in right_rows])
    rows = left if right is None else left + right_rows
    offset = len(rows) - len(right_rows)
    keys, copies = (np.array([x[i] for x in rows], np.int64) for i in range(2))
    parent, links = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    for k, (_, _, grams) in enumerate(left):
        found, _ = lists.search(grams, percent, k + 1 if right is None else 0)
        if len(found):
            found = found + offset
            links[k] += copies[found].sum()
            links[found] += copies[k]
            tops = np.append(found, k)
            while (parent[tops] != tops).any():
                tops = parent[tops]
            parent[tops] = tops.min()
            parent[found] = parent[k] = tops.min()
    while (parent[parent] != parent).any():
        parent = parent[parent]
    least = np.full(len(rows), np.iinfo(np.int64).max)
    np.minimum.at(least, parent, keys)
    return [(int(keys[i]), int(least[parent[i]]), int(links[i])) for i in np.flatnonzero(links)]


def _link_groups(percent: int):
    """mapInArrow over rows (block, i, j, piece, key, copies, grams) sorted by block, i, j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, held = None, [], set()

        def close() -> list[tuple[int, int, int]]:
            if len(rows) < 2:
                return []
            if group[1] == group[2]:
                return _link_block([r[1:] for r in rows], None, percent)
            return _link_block([r[1:] for r in rows if r[0] == group[1]], [r[1:] for r in rows if r[0] == group[2]], percent)

        def batch_of(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else ([], [], [])
            return pa.record_batch([pa.array(list(c), pa.int64()) for c in columns], ["key", "root", "links"])

        for batch in batches:
            out = []
            plain = [batch.column(i).to_pylist() for i in range(6)]
            for block, i, j, piece, me, copies, grams in zip(*plain, batch.column(6), strict=True):
                if (block, i, j) != group:
                    out += close()
                    group, rows = (block, i, j), []
                    held = set()
                if (me, piece) not in held:  # an id and text that stand in the table twice come twice
                    held.add((me, piece))
                    rows.append((piece, me, copies, np.frombuffer(grams.as_buffer(), np.uint64).copy()))
            yield batch_of(out)
        yield batch_of(close())

    return run


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``(id, n_shingles, component_id, n_links, component, mark)``, a row for each row of ``docs`` with an id.

    Two texts link when their sets of word ``n``-grams have Jaccard ``percent``/100 or more;
    ``component_id`` is the smallest id that links reach, itself included, and ``n_links``
    the number of other rows that the text links with. ``component`` tells components apart
    where an id stands for several texts (null: no n-gram, no links), and ``mark`` is the
    text's xxhash64. A text with fewer than ``n`` words has one gram, all of it; a null text or
    one without words has none and no links. Rows with a null id are left out; rows that
    repeat an id count as one row each. Other columns, whatever their names, aren't read.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    read = source.where("id IS NOT NULL")
    found = stored(_classes(read, n), "jaccard-members")
    sketch = spark.sparkContext.broadcast(_summed(found))
    members = found.where("slice IS NULL").select("id", "mark", "n", "digest", "key")
    classes = stored(members.where("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("key").alias("key")), "jaccard-classes")
    met = cut(_candidates(read, n, percent, sketch))
    release(spark)
    blocks = connected_components(met, "a", "b")
    survivors = stored(classes.join(blocks.select(F.col("node").alias("key"), F.col("component").alias("block")), "key").select("id", "key", "copies", "n", "block"), "jaccard-blocks")
    weights = stored(survivors.groupBy("block").agg(F.sum("n").alias("grams"), F.count("*").alias("rows")).where("rows > 1").select("block", F.ceil(F.col("grams") / F.lit(PIECE_GRAMS)).cast("int").alias("pieces")), "jaccard-pieces")
    survivors = survivors.join(weights, "block").withColumn("piece", F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int"))

    slot = F.pmod(F.xxhash64("id"), F.lit(ID_BITS)).alias("slot")
    bits = spark.sparkContext.broadcast(_bits(survivors.select(slot)))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array(bits.value[at >> 3] >> (at & 7) & 1 == 1))
            found = list(wordhash.gram_sets(batch.column(1), n))
            yield pa.record_batch([batch.column(0), pa.array([_key(_digest(g)) for g in found], pa.int64()), pa.array([g.tobytes() for g in found], pa.binary())], ["id", "key", "grams"])

    # merge join: the survivors grow with the texts, so they are never broadcast
    of_texts = read.select("id", "text", slot).mapInArrow(sets, "id long, key long, grams binary")
    with_sets = of_texts.join(survivors.hint("merge"), ["id", "key"]).select("block", "pieces", "piece", "key", "copies", "grams")
    cells = with_sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("block", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), "piece", "key", "copies", "grams")
    found = cut(cells.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j").mapInArrow(_link_groups(percent), "key long, root long, links long"))
    roots = connected_components(found, "key", "root").select(F.col("node").alias("key"), "component")
    linked = classes.join(roots, "key").join(found.groupBy("key").agg(F.sum("links").alias("links")), "key").select("digest", "id", "component", "links")
    least = linked.groupBy("component").agg(F.min("id").alias("component_id"))
    linked = linked.join(least, "component").select("digest", "component", "component_id", "links")
    of_class = classes.join(linked, "digest", "left").select("digest", F.coalesce("component", "key").alias("component"), F.coalesce("component_id", "id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    of_class = stored(of_class, "jaccard-results")  # written, so that the join below is all of its stage and a hot digest can be split
    empty = members.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component"), "mark")
    return members.where("n > 0").join(of_class.hint("merge"), "digest").select("id", F.col("n").alias("n_shingles"), "component_id", "n_links", "component", "mark").union(empty)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component of :func:`jaccard_groups`: that with the smallest id.

    Of rows that agree in id the one with the smallest hash of its text, once. Rows without
    an n-gram link with nothing and stay, once for each id; rows with a null id can't be
    grouped and stay. All columns are kept, whatever their names; an empty table stays empty.
    """
    groups = jaccard_groups(docs, id_col, text_col, n, percent)
    first = groups.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("id", "mark")).alias("m")).select("m.id", "m.mark")
    chosen = first.union(groups.where("component IS NULL").groupBy("id").agg(F.min("mark"))).select(F.col("id").alias("_kept_id"), F.col("mark").alias("_kept_mark"))
    marked = docs.where(F.col(id_col).isNotNull()).withColumns({"_mark": F.xxhash64(F.col(text_col).cast("string")), "_id": F.col(id_col).cast("long")})
    kept = marked.join(chosen.hint("merge"), (F.col("_id") == F.col("_kept_id")) & (F.col("_mark") == F.col("_kept_mark")), "left_semi").dropDuplicates(["_id", "_mark"])
    return kept.drop("_id", "_mark").unionByName(docs.where(F.col(id_col).isNull()))

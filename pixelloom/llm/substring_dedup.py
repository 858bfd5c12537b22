"""Fuzzy substring deduplication by collinear chaining of shared k-mer seeds.

1. Seeds are minimizers: of each ``WINDOW`` neighbouring word ``K``-mers the one with the
   smallest hash. Long ones, of half a passage, are dealt out beside them, so that every
   run of ``MIN_WORDS`` words has one.
2. Each seed points to an earlier holder: in a batch of texts to the smallest document
   that has it, and from there to the smallest of all. So a seed that very many documents
   share leaves a batch once, and no document meets all that share its seeds.
3. The matches of a pair are chained: runs on one diagonal are put together, and the best
   collinear chains of runs under linear gap costs found by a Fenwick tree of prefix maxima.
4. Chains are aligned, a document's best first: exact runs are counted, the gaps between
   them aligned by longest common subsequence, ends extended through changed words, from one
   seed too. Long and similar ones are passages; what lies inside one isn't aligned again.
5. Other documents may take the seeds of a passage from the one that has all of it. So the
   runs of ``MIN_WORDS`` words around a long seed that step 4 left open are dealt out by
   the hash of all their words: each meets an earlier document with just that run.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .storage import stored

K = 6
WINDOW = 12
#: Passages have at least so many words, of which at least this share agrees.
MIN_WORDS = 50
MIN_IDENTITY = 0.8
#: Cost of a word that a chain skips on either side, in words of a seed.
GAP_COST = 0.2
#: Seeds further apart than this many words never join one chain.
MAX_GAP = 64
#: Seeds of one diagonal no further apart than this are one run: joining them always gains.
RUN_STEP = 18
#: Words beside a chain that are looked at for its ends.
MARGIN = 64
#: Words that have to agree for a changed one between an end and its extension: at first, then where too few of all agree.
PRICES = (2, 4)
#: Changed words that nothing has paid for at which an end is settled.
DROP = 6
#: Share of its length that a chain scores where it is all seeds of one text copied: they stand some ``WINDOW / 2`` words apart.
DENSE = 0.6
#: A short chain is aligned if a stretch of a passage's length has this share of words from the other text.
ALIKE = 0.76


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) of each ``width`` neighbours."""
    done, out = 1, values
    while 2 * done <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    return pick(out[: len(out) - (width - done)], out[width - done :])


def minimizers(codes: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest of each ``window`` codes of a text; of a text with fewer codes, of all.

    Text i has the codes from ``bounds[i]`` to ``bounds[i + 1]``. A code is chosen where the
    largest of the minima of its windows is itself. Of equal ones that follow one another
    within half a window, as in a text that says one word over and over, one in half a
    window stays, so every window still has one.
    """
    n, counts = len(codes), np.diff(bounds)
    chosen = np.zeros(n, bool)
    if n >= window:
        low = _sliding(codes, window, np.minimum)
        low[np.arange(len(low)) + window > np.repeat(bounds[1:], counts)[: len(low)]] = 0
        none = np.zeros(window - 1, np.uint64)
        chosen = _sliding(np.concatenate([none, low, none]), window, np.maximum) == codes
    short = (counts > 0) & (counts < window)
    if short.any():
        inside = np.repeat(short, counts)
        first = np.cumsum(counts[short]) - counts[short]
        chosen[inside] = codes[inside] == np.repeat(np.minimum.reduceat(codes[inside], first), counts[short])
    at = np.flatnonzero(chosen)
    half = window // 2
    new = np.ones(len(at), bool)
    new[1:] = (codes[at[1:]] != codes[at[:-1]]) | (np.diff(at) > half) | np.isin(at[1:], bounds)
    step = (at - at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]) // half if len(at) else at
    new[1:] |= step[1:] != step[:-1]
    return at[new]


#: Rows on their way to an earlier holder (no leader yet, dealt by the seed), or there (dealt by id; ``seed`` of long ones only).
_ROUTED = "route long, id long, at int, seed long, leader long, leader_at int"
_MATCHES = "id long, at int, seed long, leader long, leader_at int"


def _batch(schema: str, *columns: np.ndarray, valid: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Columns of ``schema``, with nulls where ``valid`` has one and it doesn't hold."""
    names, kinds = zip(*[x.split() for x in schema.split(", ")], strict=True)
    out = [pa.array(c, {"long": pa.int64(), "int": pa.int32()}[kind], mask=None if name not in valid else ~valid[name]) for name, kind, c in zip(names, kinds, columns, strict=True)]
    return pa.record_batch(out, list(names))


def _first_holders(seed: np.ndarray, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Routed rows of a batch: of each seed those of its smallest document go on, the others point there.

    ``at`` of a long seed is -1 - its position.
    """
    by = np.lexsort((at, ids, seed))
    seed, ids, at = seed[by], ids[by], at[by].astype(np.int32)
    new = np.ones(len(seed), bool)
    new[1:] = seed[1:] != seed[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(seed)), 0))
    onward = ids == ids[first]
    long = at < 0
    route = np.where(onward, seed, wordhash.mix(ids.view(np.uint64))).view(np.int64)
    return _batch(_ROUTED, route, ids, at, seed.view(np.int64), ids[first], at[first], valid={"seed": long & ~onward, "leader": ~onward, "leader_at": ~onward})


def _found_holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over routed rows sorted by route, id, at: the matches of all."""
    held = None
    place = lambda at: np.where(at < 0, -1 - at, at)
    for batch in batches:
        done = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
        if done.any():
            there = batch.filter(pa.array(done))
            ids, at, leader, leader_at = (there.column(i).to_numpy() for i in (1, 2, 4, 5))
            seed = there.column(3)
            yield pa.record_batch([pa.array(ids), pa.array(place(at)), seed, pa.array(leader), pa.array(place(leader_at))], ["id", "at", "seed", "leader", "leader_at"])
        route, ids, at = (batch.column(i).to_numpy()[~done] for i in range(3))
        if not len(route):
            continue
        if held is not None:
            route, ids, at = (np.concatenate([[h], x]).astype(x.dtype) for h, x in zip(held, (route, ids, at), strict=True))
        new = np.ones(len(route), bool)
        new[1:] = route[1:] != route[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(route)), 0))
        held = route[first[-1]], ids[first[-1]], at[first[-1]]
        hit = ids != ids[first]
        long = at[hit] < 0
        yield _batch(_MATCHES, ids[hit], place(at[hit]), route[hit], ids[first][hit], place(at[first][hit]), valid={"seed": long})


def _matches(routed: DataFrame) -> DataFrame:
    """``(id, at, seed, leader, leader_at)``: every place of a seed, but those of the smallest document, with an earlier holder."""
    return routed.repartition("route").sortWithinPartitions("route", "id", "at").mapInArrow(_found_holders, _MATCHES)


def _seeds(docs: DataFrame, k: int, window: int, min_words: int) -> DataFrame:
    """Routed rows of the seeds of every text: short ones, and long ones of half a passage.

    A short code that a text repeats is dealt out a second time, told apart by how many came
    before it: any copy meets the first one of another text, and repetitive texts match
    in order too.
    """
    long = (min_words + 1) // 2

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            seeds, owners, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for start, rows, data, offsets in wordhash.text_chunks(batch.column(1)):
                hashes, _, _, first = wordhash.words(data, offsets)
                for width, span in ((k, window), (long, min_words - long + 1)):
                    codes, bounds = wordhash.grams(hashes, first, width)
                    chosen = minimizers(codes, bounds, span)
                    row = np.searchsorted(bounds, chosen, "right") - 1
                    at = chosen - bounds[row]
                    seeds.append(codes[chosen])
                    owners.append(ids[start + row])
                    places.append(at if width == k else -1 - at)
                    if width == k:
                        by = np.lexsort((chosen, codes[chosen], row))
                        new = np.ones(len(by), bool)
                        new[1:] = (codes[chosen][by[1:]] != codes[chosen][by[:-1]]) | (row[by[1:]] != row[by[:-1]])
                        turn = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0)) if len(by) else by
                        again, turn = by[turn > 0], turn[turn > 0]
                        seeds.append(wordhash.mix(codes[chosen][again] + turn.astype(np.uint64)))
                        owners.append(ids[start + row][again])
                        places.append(at[again])
            yield _first_holders(*(np.concatenate(x) for x in (seeds, owners, places)))

    return docs.mapInArrow(deal, _ROUTED)


def _runs(x: np.ndarray, y: np.ndarray, k: int, gap_cost: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matches by diagonal, first of each run and the end, score of each run)."""
    by = np.lexsort((x, y - x))
    step = np.diff(x[by])
    inside = (np.diff((y - x)[by]) == 0) & (step <= RUN_STEP)
    edges = np.concatenate([[0], np.flatnonzero(~inside) + 1, [len(x)]])
    gains = np.zeros(len(x))
    gains[1:] = np.where(inside, np.minimum(k, step) - 2 * gap_cost * np.maximum(0, step - k), 0)
    return by, edges, k + np.add.reduceat(gains, edges[:-1])


def chain(x: np.ndarray, y: np.ndarray, k: int = K, gap_cost: float = GAP_COST, max_gap: int = MAX_GAP) -> list[tuple[float, list[int]]]:
    """(score, indices) of collinear chains over matches (x, y): best first, disjoint.

    The score of a chain is the words its seeds cover less ``gap_cost`` for each word
    between them on either side. Runs of one diagonal are joined first. With
    g = score + cost * (x + y) at a run's end, the best predecessor of a run is a maximum of
    g over smaller y: a prefix maximum, kept in a Fenwick tree. Where the maximum lies over
    ``max_gap`` away, or overlaps the run, the predecessors within ``max_gap`` are looked
    through, so a far one never hides a near one.
    """
    if len(x) < 2:
        return [(float(k), [0])] * len(x)
    by, edges, gain = _runs(x, y, k, gap_cost)
    n = len(gain)
    if n == 1:
        return [(float(gain[0]), by.tolist())]
    first, last = by[edges[:-1]], by[edges[1:] - 1]
    x0, y0, x1, y1 = x[first].tolist(), y[first].tolist(), x[last].tolist(), y[last].tolist()
    order = sorted(range(n), key=lambda i: (x0[i], y0[i]))
    levels = np.unique(y[last])
    rank = (np.searchsorted(levels, y[last]) + 1).tolist()
    below = np.searchsorted(levels, y[first]).tolist()
    size = len(levels)
    tree: list[tuple[float, int]] = [(-1e300, -1)] * (size + 1)
    own, back = gain.tolist(), [-1] * n
    score = list(own)
    waiting: list[tuple[int, int]] = []
    ended: list[tuple[int, int]] = []

    def join(i: int, j: int) -> None:
        dx, dy = x0[i] - x1[j], y0[i] - y1[j]
        if 0 < dx <= max_gap and 0 < dy <= max_gap:
            joined = own[i] - k + score[j] + min(k, dx, dy) - gap_cost * (max(0, dx - k) + max(0, dy - k))
            if joined > score[i]:
                score[i], back[i] = joined, j

    for i in order:
        while waiting and waiting[0][0] < x0[i]:
            end, j = heapq.heappop(waiting)
            ended.append((end, j))
            g, r = (score[j] + gap_cost * (x1[j] + y1[j]), j), rank[j]
            while r <= size:
                if g > tree[r]:
                    tree[r] = g
                r += r & -r
        best, r = (-1e300, -1), below[i]
        while r:
            if tree[r] > best:
                best = tree[r]
            r &= r - 1
        j = best[1]
        if j >= 0:
            if k <= x0[i] - x1[j] <= max_gap and k <= y0[i] - y1[j] <= max_gap:
                join(i, j)
            else:
                for end, j in reversed(ended):
                    if x0[i] - end > max_gap:
                        break
                    join(i, j)
        heapq.heappush(waiting, (x1[i], i))
    used, chains = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        path, top = [], score[i]
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = back[i]
        if path:
            rest = score[i] if i >= 0 else 0.0
            chains.append((top - rest, [m for run in reversed(path) for m in by[edges[run] : edges[run + 1]].tolist()]))
    return sorted(chains, key=lambda c: -c[0])


def equal_in_gap(a: np.ndarray, b: np.ndarray) -> int:
    """Words that a best alignment of two gaps matches: longest common subsequence, by rows."""
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, np.int64)
    for word in a:
        step = np.maximum(row[1:], row[:-1] + (b == word))
        row[1:] = np.maximum.accumulate(step)
    return int(row[-1])


def align(a: np.ndarray, b: np.ndarray, anchors: list[tuple[int, int]], k: int = K) -> tuple[int, int, int, int, int]:
    """(start, end in a; start, end in b; words that agree) of an anchored chain.

    The ends are extended word by word while the words agree.
    """
    x, y = anchors[0]
    left = 0
    while x - left > 0 and y - left > 0 and a[x - left - 1] == b[y - left - 1]:
        left += 1
    start_a, start_b = x - left, y - left
    same, end_a, end_b = 0, start_a, start_b
    for x, y in anchors:
        if x < end_a or y < end_b:  # inside what is aligned, or across it
            continue
        same += equal_in_gap(a[end_a:x], b[end_b:y])
        run = np.flatnonzero(a[x : x + min(len(a) - x, len(b) - y)] != b[y : y + min(len(a) - x, len(b) - y)])
        length = int(run[0]) if len(run) else min(len(a) - x, len(b) - y)
        same += length
        end_a, end_b = x + length, y + length
    return start_a, end_a, start_b, end_b, same


def extend(a: list[int], b: list[int], price: int = PRICES[-1]) -> tuple[int, int, int]:
    """(words of a, of b, words that agree) of the best common start of both, changed words allowed.

    The best is where the words that agree less ``price`` for each other one are most, so
    ``1 / (1 + price)`` of a long start may differ. The furthest place on each diagonal is
    kept for every number of changes (Landau and Vishkin).
    """
    reach, best, score, changes = {0: (0, 0)}, (0, 0, 0), 0, 0
    while reach:
        ahead = {}
        for d, (x, same) in reach.items():
            y, start = x - d, x
            while x < len(a) and y < len(b) and a[x] == b[y]:
                x, y = x + 1, y + 1
            same += x - start
            value = same - price * changes
            if value > score:
                score, best = value, (x, y, same)
            if value > score - price * DROP:
                for step, i, j in ((d, x + 1, y + 1), (d + 1, x + 1, y), (d - 1, x, y + 1)):
                    if i <= len(a) and j <= len(b) and (i, same) > ahead.get(step, (-1, 0)):
                        ahead[step] = (i, same)
        reach, changes = ahead, changes + 1
    return best


def passage(a: np.ndarray, b: np.ndarray, anchors: list[tuple[int, int]], k: int = K, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> tuple[int, int, int, int, int]:
    """As :func:`align`, then both ends extended through changed words, less far where too few of all would agree.

    What stays under ``min_words`` at the lowest price isn't tried at a higher one, which reaches less far.
    """
    start_a, end_a, start_b, end_b, same = align(a, b, anchors, k)
    ends = a[:start_a][::-1].tolist(), b[:start_b][::-1].tolist(), a[end_a:].tolist(), b[end_b:].tolist()
    for price in PRICES:
        left, left_b, more = extend(*ends[:2], price)
        right, right_b, most = extend(*ends[2:], price)
        found = start_a - left, end_a + right, start_b - left_b, end_b + right_b, same + more + most
        if found[4] >= min_identity * max(found[1] - found[0], found[3] - found[2]):
            return found
        if found[1] - found[0] < min_words:
            break
    return start_a, end_a, start_b, end_b, same


_CHAINS = "id long, leader long, score double, low int, high int, leader_low int, leader_high int, x array<int>, y array<int>"


def _chained(k: int, min_words: int):
    """mapInArrow over matches sorted by id, leader, at, leader_at: the chains of each document.

    A chain inside a long one that is nearly all seeds is left out: those words are found with it.
    """

    def of_document(cols: list[np.ndarray], out: list[tuple]) -> None:
        edges = np.flatnonzero(np.diff(cols[1])) + 1
        chains = []
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(cols[0])], strict=True):
            x, y = cols[2][a:b], cols[3][a:b]
            chains += [(score, int(cols[1][a]), x[path], y[path]) for score, path in chain(x, y, k)]
        covered: list[tuple[int, int]] = []
        for score, leader, x, y in sorted(chains, key=lambda c: (-c[0], c[1])):
            low, high = int(x[0]), int(x[-1])
            if any(s <= low and high + k <= e for s, e in covered):
                continue
            if high + k - low >= min_words and score >= DENSE * (high + k - low):
                covered.append((low, high + k))
            out.append((int(cols[0][0]), leader, score, low, high, int(y[0]), int(y[-1]), x, y))

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.float64(), *[pa.int32()] * 4, pa.list_(pa.int32()), pa.list_(pa.int32())]
        names = [x.split()[0] for x in _CHAINS.split(", ")]
        return pa.record_batch([pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(4)]
            if not len(cols[0]):
                continue
            if parts and cols[0][-1] == parts[-1][0][-1]:  # one document goes on
                parts.append([c.copy() for c in cols])
                continue
            cols = [np.concatenate(x) for x in zip(*parts, cols, strict=True)]
            edges = [0, *(np.flatnonzero(np.diff(cols[0])) + 1).tolist()]
            parts = [[c[edges[-1] :].copy() for c in cols]]
            out: list[tuple] = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                of_document([c[a:b] for c in cols], out)
                if len(out) >= 2000:
                    yield batch_of(out)
                    out = []
            yield batch_of(out)
        if parts:
            out = []
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
            edges = [0, *(np.flatnonzero(np.diff(cols[0])) + 1).tolist(), len(cols[0])]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                of_document([c[a:b] for c in cols], out)
            yield batch_of(out)

    return run


def _chains(matches: DataFrame, k: int, min_words: int, label: str) -> DataFrame:
    rows = matches.select("id", "leader", "at", "leader_at").repartition("id").sortWithinPartitions("id", "leader", "at", "leader_at")
    return stored(rows.mapInArrow(_chained(k, min_words), _CHAINS), label)


def _coded(read: DataFrame, chains: DataFrame) -> DataFrame:
    """``(id, words)`` of the documents of ``chains``: 32 bits of the hash of each word, four bytes a word."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, rows, data, offsets in wordhash.text_chunks(batch.column(1)):
                hashes, _, _, first = wordhash.words(data, offsets)
                short = hashes.astype("<u4")
                out += [short[first[i] : first[i + 1]].tobytes() for i in range(rows)]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["id", "words"])

    ids = chains.select(F.explode(F.array("id", "leader")).alias("id")).distinct()
    return stored(read.join(ids.hint("merge"), "id").mapInArrow(codes, "id long, words binary"), "passage-words")


_PASSAGES = "doc_id long, start_word long, end_word long, source_id long, source_start long, source_end long, n_same long, n_words long"


def may_be_passage(a: np.ndarray, b: np.ndarray, min_words: int = MIN_WORDS, alike: float = ALIKE) -> bool:
    """Whether a stretch of ``min_words`` words of a has enough words that stand in b, in whatever order."""
    if min(len(a), len(b)) < MIN_IDENTITY * min_words or len(a) < min_words:
        return False
    known = set(b.tolist())
    count = np.zeros(len(a) + 1, np.int64)
    np.cumsum([word in known for word in a.tolist()], out=count[1:])
    return bool((count[min_words:] - count[:-min_words]).max() >= alike * min_words)


def _aligned(coded: DataFrame, chains: DataFrame, k: int, min_words: int, min_identity: float) -> DataFrame:
    """The passages among stored ``chains``: of each document in order of the chains' scores."""

    def part(words: str, low: str, high: str):
        first = F.greatest(F.lit(0), F.col(low) - MARGIN)
        return first, F.substring(F.col(words), first * 4 + 1, (F.col(high) + k + MARGIN - first) * 4)

    first, cut_words = part("words", "leader_low", "leader_high")
    with_source = chains.join(coded.withColumnRenamed("id", "leader"), "leader").select("id", "leader", "score", "low", "high", "x", "y", first.alias("leader_first"), cut_words.alias("leader_words"))
    first, cut_words = part("words", "low", "high")
    both = with_source.join(coded, "id").select("id", "leader", "score", first.alias("first"), "leader_first", (F.octet_length("words") / 4).cast("long").alias("n_words"), "x", "y", cut_words.alias("own"), "leader_words")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, covered = None, []
        for batch in batches:
            out = []
            ids, leaders, _, firsts, leader_firsts, sizes = (batch.column(i).to_pylist() for i in range(6))
            for i, (me, leader, first, leader_first, n_words) in enumerate(zip(ids, leaders, firsts, leader_firsts, sizes, strict=True)):
                if (me, n_words) != document:
                    document, covered = (me, n_words), []
                x, y = (batch.column(j)[i].values.to_numpy().astype(np.int64) for j in (6, 7))
                if any(s <= x[0] and x[-1] + k <= e for s, e in covered):
                    continue
                a, b = (np.frombuffer(batch.column(j)[i].as_buffer(), "<u4") for j in (8, 9))
                x, y = x - first, y - leader_first
                fits = (x + k <= len(a)) & (y + k <= len(b))
                if not fits.any() or x[-1] + k - x[0] < min_words and not may_be_passage(a, b, min_words):
                    continue
                s, e, t, u, same = passage(a, b, list(zip(x[fits].tolist(), y[fits].tolist(), strict=True)), k, min_words, min_identity)
                if e - s >= min_words and same >= min_identity * max(e - s, u - t):
                    out.append((me, s + first, e + first, leader, t + leader_first, u + leader_first, same, n_words))
                    covered.append((s + first, e + first))
            columns = zip(*out, strict=True) if out else [[]] * 8
            yield pa.record_batch([pa.array(list(c), pa.int64()) for c in columns], [x.split()[0] for x in _PASSAGES.split(", ")])

    return both.sortWithinPartitions("id", "n_words", F.desc("score"), "leader").mapInArrow(aligned, _PASSAGES).dropDuplicates()


def _thinned(codes: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """Which of the places ``at`` of runs to keep where a text repeats a run within ``step`` words: one in a step, and the last."""
    by = np.lexsort((at, codes))
    new = np.ones(len(by), bool)
    new[1:] = (codes[by[1:]] != codes[by[:-1]]) | (np.diff(at[by]) > step)
    first = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0)) if len(by) else by
    part = (at[by] - at[by][first]) // step
    kept = new.copy()
    kept[1:] |= part[1:] != part[:-1]
    kept[:-1] |= new[1:]
    kept[-1:] = True
    out = np.zeros(len(by), bool)
    out[by] = kept
    return out


def _joined(min_words: int):
    """mapInArrow over matches of runs sorted by id: passages of equal words, as few as cover a document's runs."""

    def of_document(me: int, leader: np.ndarray, at: np.ndarray, leader_at: np.ndarray, out: list[tuple]) -> None:
        shift = leader_at - at
        by = np.lexsort((at, shift, leader))
        leader, at, shift = leader[by], at[by], shift[by]
        new = np.ones(len(at), bool)
        new[1:] = (leader[1:] != leader[:-1]) | (shift[1:] != shift[:-1]) | (np.diff(at) > min_words)
        starts = np.flatnonzero(new)
        ends = at[np.append(starts[1:], len(at)) - 1] + min_words
        rows = sorted(zip(at[starts].tolist(), ends.tolist(), leader[starts].tolist(), shift[starts].tolist(), strict=True))
        reach, i = -1, 0
        while i < len(rows):
            best = None
            while i < len(rows) and (best is None or rows[i][0] <= max(reach, best[0])):
                best = rows[i] if best is None or rows[i][1] > best[1] else best
                i += 1
            if best[1] > reach:
                start, reach, source, moved = best[0], best[1], best[2], best[3]
                out.append((me, start, reach, source, start + moved, reach + moved, reach - start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        names = [x.split()[0] for x in _PASSAGES.split(", ")][:7]

        def done(cols: list[np.ndarray]) -> pa.RecordBatch:
            out: list[tuple] = []
            edges = [0, *(np.flatnonzero(np.diff(cols[0])) + 1).tolist(), len(cols[0])]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a:
                    of_document(int(cols[0][a]), *[c[a:b].astype(np.int64) for c in cols[1:]], out)
            return pa.record_batch([pa.array([r[i] for r in out], pa.int64()) for i in range(7)], names)

        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(4)]
            if not len(cols[0]):
                continue
            if parts and cols[0][-1] == parts[-1][0][-1]:
                parts.append([c.copy() for c in cols])
                continue
            cols = [np.concatenate(x) for x in zip(*parts, cols, strict=True)]
            last = int(np.argmax(cols[0] == cols[0][-1]))
            parts = [[c[last:].copy() for c in cols]]
            yield done([c[:last] for c in cols])
        if parts:
            yield done([np.concatenate(x) for x in zip(*parts, strict=True)])

    return run


def _open_runs(matches: DataFrame, coded: DataFrame, found: DataFrame, min_words: int) -> DataFrame:
    """Passages of equal words around the runs of ``min_words`` words that ``found`` leaves open.

    Every such run that stands word for word in a smaller document has a long seed; around
    those that no passage covers, all runs of all holders are dealt out by all their words.
    """
    long = (min_words + 1) // 2
    span = min_words - long + 1
    held = matches.where("seed IS NOT NULL")
    covered = found.select(F.col("doc_id").alias("_id"), "start_word", "end_word", "n_words").distinct()
    inside = (F.col("start_word") <= F.greatest(F.lit(0), F.col("at") - span + 1)) & (F.col("end_word") >= F.least(F.col("n_words"), F.col("at") + min_words))
    open_seeds = held.join(covered.hint("merge"), (held["id"] == covered["_id"]) & inside, "left_anti").select("seed").distinct()
    holders = held.select("seed", "id", "at").union(held.select("seed", "leader", "leader_at"))
    places = holders.join(open_seeds.hint("merge"), "seed", "left_semi").groupBy("id").agg(F.collect_set("at").alias("places"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            runs, owners, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i in range(batch.num_rows):
                words = wordhash.mix(np.frombuffer(batch.column(1)[i].as_buffer(), "<u4").astype(np.uint64))
                codes, _ = wordhash.grams(words, np.array([0, len(words)]), min_words)
                at = batch.column(2)[i].values.to_numpy().astype(np.int64)
                at = np.unique(at[:, None] - np.arange(span))
                at = at[(at >= 0) & (at < len(codes))]
                at = at[_thinned(codes[at], at, span)]
                runs.append(codes[at])
                starts.append(at)
                owners.append(np.full(len(at), ids[i], np.int64))
            yield _first_holders(*(np.concatenate(x) for x in (runs, owners, starts)))

    runs = _matches(coded.join(places.hint("merge"), "id").select("id", "words", "places").mapInArrow(deal, _ROUTED))
    rows = runs.select("id", "leader", "at", "leader_at").repartition("id").sortWithinPartitions("id")
    joined = rows.mapInArrow(_joined(min_words), ", ".join(_PASSAGES.split(", ")[:7]))
    sizes = coded.select(F.col("id").alias("doc_id"), (F.octet_length("words") / 4).cast("long").alias("n_words")).distinct()
    return joined.join(sizes.hint("merge"), "doc_id").where("end_word <= n_words").select(*[x.split()[0] for x in _PASSAGES.split(", ")])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> DataFrame:
    """``(doc_id, start_word, end_word, source_id, source_start, source_end, n_same, n_words)``.

    Passages of at least ``min_words`` words of a document that also stand, word for word
    or nearly, in the document ``source_id`` with a smaller id. Every run of ``min_words``
    words that stands word for word in a smaller document lies in the passages of a row, or
    of rows that overlap. Word positions count from 0, ends are exclusive; ``n_same`` words
    agree; ``n_words`` is the document's length. A source never lists that seed itself, so one copy
    of every passage has no row. Of several sources one is named; which one may depend on
    how rows come in batches. Words are compared in lower case (A-Z) and by 32 bits of their
    hash. Null and empty texts have no passage, nor have texts with a null id; rows that
    repeat an id are read as that id's versions, and a passage is not reported against its
    own id. Rows of a document may overlap. Other columns aren't read. An empty table gives none.
    """
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    matches = stored(_matches(_seeds(read, k, window, min_words)), "passage-matches")
    chains = _chains(matches, k, min_words, "passage-chains")
    coded = _coded(read, chains)
    found = stored(_aligned(coded, chains, k, min_words, min_identity), "passages")
    rest = _open_runs(matches, coded, found, min_words)
    known = found.select(F.col("doc_id").alias("known"), F.col("start_word").alias("known_start"), F.col("end_word").alias("known_end")).distinct()
    rest = rest.join(known.hint("merge"), (F.col("doc_id") == F.col("known")) & (F.col("known_start") <= F.col("start_word")) & (F.col("known_end") >= F.col("end_word")), "left_anti")
    return found.union(rest)


def drop_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the words of ``passages``; all columns kept, a text left bare is dropped.

    The text between two kept words stays as it is; a removed passage leaves a line feed.
    Rows without a passage, null ids and null texts among them, are passed on untouched, and
    of rows that repeat an id those whose number of words isn't that of the passage's text.
    """
    spans = passages.groupBy(F.col("doc_id").alias("_passage_id")).agg(F.sort_array(F.collect_set(F.struct("start_word", "end_word", "n_words"))).alias("_spans"))

    @F.pandas_udf("string")
    def without(texts, spans):
        out = []
        for text, spans_of in zip(texts, spans, strict=True):
            if spans_of is None or text is None:
                out.append(text)
                continue
            raw = text.encode()
            data = np.frombuffer(raw, np.uint8)
            _, starts, ends, _ = wordhash.words(data, np.array([0, len(data)]))
            kept, at = [], 0
            for span in spans_of:
                low, high = int(span["start_word"]), int(span["end_word"])
                if high > at and span["n_words"] == len(starts):
                    if low > at:
                        kept.append(raw[(starts[at] if at else 0) : ends[low - 1]])
                    at = high
            if at < len(starts):
                kept.append(raw[starts[at] :])
            out.append(b"\n".join(kept).decode())
        import pandas as pd

        return pd.Series(out, dtype=object)

    columns = [c for c in docs.columns if c != text_col]
    joined = docs.join(spans.hint("merge"), F.col(id_col) == F.col("_passage_id"), "left")
    cleaned = joined.select(*columns, F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(without(F.col(text_col), F.col("_spans"))).alias(text_col), F.col("_spans").isNotNull().alias("_cut"))
    return cleaned.where(f"NOT (_cut AND `{text_col}` IS NOT NULL AND trim(translate(`{text_col}`, '\\t\\n\\r\\f', '    ')) = '')").select(*docs.columns)

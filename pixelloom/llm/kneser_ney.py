"""Interpolated modified Kneser-Ney n-gram model, counted in Spark.

Counts travel as packed blocks of n-grams, not as rows: a block for each run of texts and
shard. Each shard is merged and written to the shared folder as sorted hash arrays, one
file for each kind, which the workers that score texts map into memory; a worker holds a
bounded number of them open.

A token is known by its 64-bit hash, and so is a run of tokens: two of the n-grams of one
level agree by chance with a probability of their number squared over 2 ** 65.
"""

from __future__ import annotations

import os
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .storage import cut, release, scratch_path

#: Bytes of training text for each shard of the model.
SHARD_BYTES = 16 << 20
#: Files of the model that a worker holds open.
OPEN_FILES = 256
#: Tokens that are counted at once before their blocks are handed over.
COUNTED = 1 << 21
#: Hashes of the token that ends every text, and of those before its first word.
END = np.uint64(0xE0D0E0D0E0D0E0D1)
START = np.uint64(0x57A7757A7757A775)
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)
_STEP = np.uint64(0xA0761D6478BD642F)
#: Kinds of blocks: 0 counts of tokens, n the n-grams of n tokens, above these the contexts of such, and the sums of a kind.
TOKENS, CONTEXT, SUMS = 0, 100, 1000


def _local(path: str) -> str:
    """A shared folder as a path that workers can map files of."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"{path} isn't mounted; the model's arrays have to be mapped from a mounted folder")
    return path


def tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, token hashes, token counts) in runs of texts; each text ends with END."""
    for start, rows, data, offsets in wordhash.text_chunks(column):
        hashes, _, _, first = wordhash.words(data, offsets)
        counts = np.diff(first) + 1
        out = np.insert(hashes, first[1:], np.full(rows, END, np.uint64))
        yield start, out, counts


def contexts(found: np.ndarray, counts: np.ndarray, order: int) -> list[np.ndarray]:
    """For j from 1 to order - 1: the hash of the j tokens before each, START before a text's first."""
    out: list[np.ndarray] = []
    place = np.arange(len(found)) - np.repeat(np.cumsum(counts) - counts, counts)
    for j in range(1, order):
        before = np.full(len(found), START)
        before[j:] = found[:-j]
        before[place < j] = START
        out.append(wordhash.mix(out[-1] + before * _STEP + np.uint64(j)) if out else before)
    return out


def ngram_keys(found: np.ndarray, before: list[np.ndarray], level: int) -> np.ndarray:
    """Hash of the ``level`` tokens that end with each; of one token itself."""
    return found if level == 1 else wordhash.mix(before[level - 2] * _STEP + found)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """By size of the upper half."""
    return ((keys >> _HALF) * np.uint64(shards)) >> _HALF


def _ngram_shard(keys: np.ndarray, context: np.ndarray, shards: int) -> np.ndarray:
    """By the context, spread over eight places by bits of the n-gram: no context fills a shard."""
    return _shard((((context >> _HALF) + (keys & np.uint64(7)) * np.uint64(0x9E3779B9)) & _LOW) << _HALF, shards)


def _packed(array: np.ndarray) -> bytes:
    """Bytes of equal place side by side, then zlib: sorted keys and small counts shrink."""
    return zlib.compress(np.ascontiguousarray(array).view(np.uint8).reshape(array.size, -1).T.tobytes(), 1)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def _smallest(values: np.ndarray) -> np.ndarray:
    """In the narrowest unsigned type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _packed_columns(columns: list[np.ndarray]) -> bytes:
    """The last column packed, with its length before it; the others, which have no order, as they are."""
    last = _packed(columns[-1])
    return b"".join([len(last).to_bytes(8, "little"), last, *[c.astype("<u8").tobytes() for c in columns[:-1]]])


def _unpacked_columns(data: bytes) -> np.ndarray:
    """A row for each column."""
    data = memoryview(data)
    end = 8 + int.from_bytes(data[:8], "little")
    last = _unpacked(data[8:end], "<u8")
    return np.concatenate([np.frombuffer(data[end:], "<u8").reshape(-1, len(last)), last[None]])


_BLOCK_SCHEMA = "kind int, shard int, columns binary, counts binary"


def _block_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    rows, at = list(rows), 0
    while at < len(rows):
        part = rows[at : at + 64]
        at += 64
        yield pa.record_batch([pa.array([r[i] for r in part], k) for i, k in enumerate(kinds)], ["kind", "shard", "columns", "counts"])


def _blocks(kind: int, shard: np.ndarray, columns: list[np.ndarray], values: np.ndarray) -> Iterator[tuple]:
    """(kind, shard, columns, values) for each shard, sorted by the last column, whose repeats pack well.

    Columns are 64-bit hashes; ``values`` has a row for each kind of count.
    """
    order = np.lexsort((columns[-1], shard))
    shard, columns, values = shard[order], [c[order] for c in columns], values[:, order]
    edges = np.flatnonzero(np.diff(shard)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(shard)], strict=True):
        if b > a:
            yield kind, int(shard[a]), _packed_columns([c[a:b] for c in columns]), _packed(values[:, a:b].astype("<u4"))


def merged(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct key in order of the keys, sums of each one's values by kind)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return order[starts], np.add.reduceat(values[:, order].astype(np.int64), starts, axis=1) if len(keys) else values


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    """(kind, shard, columns, values) of rows that are sorted by kind and shard."""

    def whole(kind: int, shard: int) -> tuple[int, int, list[np.ndarray], np.ndarray]:
        width = 4 if CONTEXT < kind < SUMS else 1
        return kind, shard, list(np.concatenate(parts[0], axis=1)), np.concatenate([v.reshape(width, -1) for v in parts[1]], axis=1)

    at, parts = None, ([], [])
    for batch in batches:
        for kind, shard, c, v in zip(*[x.to_pylist() for x in batch.columns[:2]], batch.column(2), batch.column(3), strict=True):
            if (kind, shard) != at:
                if at:
                    yield whole(*at)
                at, parts = (kind, shard), ([], [])
            parts[0].append(_unpacked_columns(c.as_buffer()))
            parts[1].append(_unpacked(v.as_buffer(), "<u4"))
    if at:
        yield whole(*at)


def _write(folder: str, name: str, keys: np.ndarray, values: np.ndarray) -> None:
    """Sorted keys and their values in one file, whole or not at all, however often a task is tried."""
    os.makedirs(folder, exist_ok=True)
    own = f"{folder}/.{name}-{os.getpid()}-{os.urandom(4).hex()}"
    values = _smallest(values)
    with open(own, "wb") as out:
        np.array([len(keys), len(values), values.dtype.itemsize], "<u8").tofile(out)
        keys.astype("<u8").tofile(out)
        values.tofile(out)
    os.replace(own, f"{folder}/{name}")


def _sums(kind: int, shard: int, values: np.ndarray) -> tuple:
    """A row of six numbers: keys, their sum, how many have 1 to 4."""
    facts = np.array([len(values), int(values.sum()), *[int((values == k).sum()) for k in (1, 2, 3, 4)]], np.int64)
    return SUMS + kind, shard, facts.tobytes(), b""


def discounts(counts: dict[int, int]) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the numbers of n-grams seen 1 to 4 times."""
    n1, n2, n3, n4 = (counts.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(k - 0.01, max(0.01, x)) for k, x in zip((1, 2, 3), d, strict=True))


class Model:
    """The arrays of a model's folder, mapped as they are needed, so many at a time."""

    def __init__(self, folder: str, shards: int, facts: dict, open_files: int = OPEN_FILES):
        self.folder, self.shards, self.facts, self.open_files = folder, shards, facts, open_files
        self.maps: OrderedDict[str, tuple | None] = OrderedDict()

    def _map(self, name: str) -> tuple | None:
        if name in self.maps:
            self.maps.move_to_end(name)
            return self.maps[name]
        path, found = f"{self.folder}/{name}", None
        if os.path.exists(path):
            n, rows, width = np.fromfile(path, "<u8", 3).tolist()
            whole = np.memmap(path, np.uint8, "r")
            found = whole[24 : 24 + 8 * n].view("<u8"), whole[24 + 8 * n :].view(f"<u{width}").reshape(rows, n)
        self.maps[name] = found
        if len(self.maps) > self.open_files:
            self.maps.popitem(last=False)  # the map closes with its last array
        return found

    def look_up(self, name: str, keys: np.ndarray, shard: np.ndarray, width: int = 1) -> np.ndarray:
        """Values of sorted-hash arrays, 0 where a key isn't there."""
        unique, first, back = np.unique(keys, return_index=True, return_inverse=True)
        order = np.argsort(shard[first], kind="stable")
        wanted, shard = unique[order], shard[first][order]
        out = np.zeros((width, len(unique)), np.int64)
        edges = np.flatnonzero(np.diff(shard)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(wanted)], strict=True):
            if b > a and (arrays := self._map(f"{name}-{int(shard[a])}")) is not None:
                have, values = arrays
                at = np.minimum(np.searchsorted(have, wanted[a:b]), len(have) - 1)
                out[:, order[a:b]] = np.where(have[at] == wanted[a:b], values[:, at], 0)
        return out[:, back]

    def score(self, found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 probability, base log10 probability, known tokens) of each text."""
        f, order = self.facts, self.facts["order"]
        starts = np.cumsum(counts) - counts
        own = _shard(found, self.shards)
        c = self.look_up("tokens", found, own)[0]
        base = np.log10((c + 1.0) / (f["tokens"] + f["words"] + 1.0))
        p = np.full(len(found), 1.0 / (f["words"] + 1.0))
        before = contexts(found, counts, order)
        for level in range(1, order + 1):
            d = np.array([0.0, *f["discounts"][level]])
            if level == 1:
                n = self.look_up("level1", found, own)[0]
                total = f["sums"][1][1]
                mass = d[1:] @ np.array(f["kinds"][1], float)
                if total:
                    p = np.maximum(n - d[np.minimum(n, 3)], 0) / total + mass / total * p
                continue
            keys = ngram_keys(found, before, level)
            n = self.look_up(f"level{level}", keys, _ngram_shard(keys, before[level - 2], self.shards))[0]
            total, n1, n2, n3 = self.look_up(f"context{level}", before[level - 2], _shard(before[level - 2], self.shards), 4)
            size = np.maximum(total, 1)
            higher = np.maximum(n - d[np.minimum(n, 3)], 0) / size + (d[1] * n1 + d[2] * n2 + d[3] * n3) / size * p
            p = np.where(total > 0, higher, p)
        log = np.log10(p)
        return np.add.reduceat(log, starts), np.add.reduceat(base, starts), np.add.reduceat((c > 0).astype(np.int64), starts)


def _reduced(folder: str, shards: int, order: int):
    """mapInArrow over blocks sorted by kind and shard: writes each shard's arrays, hands on what follows from them.

    Of the n-grams of a level follow their contexts' sums, and a count for each of the
    n-grams one token shorter: how many tokens stand before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, shard, columns, values in _by_shard(batches):
            if kind > CONTEXT or kind <= 1:
                places, values = merged(columns[0], values)
                name = f"context{kind - CONTEXT}" if kind > CONTEXT else "level1" if kind else "tokens"
                _write(folder, f"{name}-{shard}", columns[0][places], values)
                yield from _block_batches([_sums(kind, shard, values[0])])
                continue
            level = kind
            keys = ngram_keys(columns[0], columns[1:], level)
            places, values = merged(keys, values)
            n = values[0]
            _write(folder, f"level{level}-{shard}", keys[places], values)
            yield from _block_batches([_sums(kind, shard, n)])
            columns = [c[places] for c in columns]
            by, sums = merged(columns[-1], np.stack([n, n == 1, n == 2, n >= 3]))
            context = columns[-1][by]
            yield from _block_batches(_blocks(CONTEXT + level, _shard(context, shards), [context], sums))
            shorter = ngram_keys(columns[0], columns[1:], level - 1)
            by, sums = merged(shorter, np.ones((1, len(shorter)), np.int64))
            columns = [c[by] for c in columns[:-1]]
            place = _shard(columns[0], shards) if level == 2 else _ngram_shard(shorter[by], columns[-1], shards)
            yield from _block_batches(_blocks(level - 1, place, columns, sums))

    return run


def train(docs: DataFrame, text_col: str = "text", order: int = 2, shard_bytes: int = SHARD_BYTES) -> tuple[str, int, dict]:
    """(folder, shards, facts) of a model of all rows of ``docs`` and ``order`` 2 or more; null texts count as empty."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    shards = max(8, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))
    folder = _local(scratch_path(spark, "kneser-ney"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            words, n = np.unique(columns[0], return_counts=True)
            yield from _block_batches(_blocks(TOKENS, _shard(words, shards), [words], n[None]))
            keys = ngram_keys(columns[0], columns[1:], order)
            places, n = merged(keys, np.ones((1, len(keys)), np.int64))
            columns = [c[places] for c in columns]
            yield from _block_batches(_blocks(order, _ngram_shard(keys[places], columns[-1], shards), columns, n))

        for batch in batches:
            for _, found, counts in tokens(batch.column(0)):
                held.append([found, *contexts(found, counts, order)])
                size += len(found)
                if size >= COUNTED:
                    yield from counted()
                    held, size = [], 0
        if held:
            yield from counted()

    blocks, sums = texts.mapInArrow(count, _BLOCK_SCHEMA), {}
    for _ in range(order):
        # written: a shard's arrays are made once, and what follows from them goes on
        blocks = cut(blocks.repartition("kind", "shard").sortWithinPartitions("kind", "shard").mapInArrow(_reduced(folder, shards, order), _BLOCK_SCHEMA))
        release(spark)
        for row in blocks.where(f"kind >= {SUMS}").select("kind", "columns").collect():  # six numbers for each kind and shard
            sums[row["kind"] - SUMS] = sums.get(row["kind"] - SUMS, 0) + np.frombuffer(row["columns"], np.int64)
        blocks = blocks.where(f"kind < {SUMS}")
    found = {kind: np.asarray(sums.get(kind, np.zeros(6, np.int64))).tolist() for kind in range(order + 1)}
    facts = {"order": order, "words": found[TOKENS][0], "tokens": found[TOKENS][1], "sums": found, "discounts": {}, "kinds": {}}
    for level in range(1, order + 1):
        facts["discounts"][level] = discounts(dict(enumerate(found[level][2:], 1)))
        one, two = found[level][2:4]
        facts["kinds"][level] = (one, two, found[level][0] - one - two)
    return folder, shards, facts


def score(docs: DataFrame, model: tuple[str, int, dict], id_col: str = "doc_id", text_col: str = "text", open_files: int = OPEN_FILES) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    Null texts count as empty: one token, the end. Perplexity is 10 ** (-score / n_tokens).
    Null ids stay null; rows that repeat are scored alike; other columns aren't read.
    """
    folder, shards, facts = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = Model(folder, shards, facts, open_files)
        for batch in batches:
            sizes, logs, bases, known = [], [], [], []
            for _, found, counts in tokens(batch.column(1)):
                a, b, c = have.score(found, counts)
                sizes.append(counts)
                logs.append(a)
                bases.append(b)
                known.append(c)
            if sizes:
                n = batch.num_rows
                columns = [batch.column(0), *[pa.array(np.concatenate(x).astype(np.int64)) for x in (sizes, known)], pa.array(np.full(n, facts["tokens"], np.int64)), *[pa.array(np.concatenate(x)) for x in (bases, logs)]]
                yield pa.record_batch(columns, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out_scores(docs: DataFrame, modulus: int = 7, remainder: int = 2, order: int = 2) -> DataFrame:
    """All rows scored by a model of those whose crc32 of the id isn't ``remainder``; null ids train."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))
    scored = score(docs, train(docs.where(~held), order=order))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

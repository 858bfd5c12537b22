"""Language identification by error-correcting output codes over character n-grams.

Every language has a codeword. A binary classifier for each bit, naive Bayes over hashed
n-grams with every language of a side counting alike, tells the languages with a 1 from
those with a 0. A text's language is the one whose
codeword has the least loss over the classifiers' margins, each weighted by how well it
separates the languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import CHUNK_BYTES

#: Hashed n-grams, a power of two.
FEATURES = 1 << 16
ORDERS = (1, 2, 3, 4)
#: About so many documents of each language are learned from, chosen by a hash of their id.
SAMPLE_PER_LANGUAGE = 2000
#: Counts that every n-gram has in every language.
PRIOR = 0.5
#: Below this difference of the two best scores a prediction is flagged as ambiguous.
AMBIGUOUS = 0.2
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Of every code point whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def text_features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, feature of each n-gram, its row, rows with a letter) in runs of texts.

    N-grams lie within a word of letters, lower-cased, and may take the blank on either side.
    """
    lowered = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    sizes = np.cumsum(np.append(0, pc.binary_length(lowered).to_numpy(zero_copy_only=False)))
    first = 0
    while first < len(lowered):
        last = min(max(int(np.searchsorted(sizes, sizes[first] + CHUNK_BYTES, "right")) - 1, first + 1), len(lowered))
        texts = lowered.slice(first, last - first)
        lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        codes = np.frombuffer((" " + "\n".join(texts.to_pylist()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(lengths)), lengths + 1)
        owner = np.concatenate([[0], owner])[: len(codes)]
        letter = _letters()[codes]
        codes = np.where(letter, codes, np.uint32(32))
        found, rows = [], []
        for n in ORDERS:
            if len(codes) < n:
                continue
            hashed = np.full(len(codes) - n + 1, n, np.uint32)
            for i in range(n):
                hashed = (hashed ^ codes[i : len(hashed) + i]) * np.uint32(0x9E3779B1)
                hashed ^= hashed >> np.uint32(15)
            sound = np.ones(len(hashed), bool)
            for i in range(1, n - 1):
                sound &= letter[i : len(hashed) + i]
            ends = letter[: len(hashed)] if n == 1 else letter[: len(hashed)] | letter[n - 1 :][: len(hashed)]
            at = np.flatnonzero(sound & ends)
            found.append((hashed[at] & np.uint32(FEATURES - 1)).astype(np.int32))
            rows.append(owner[at + (~letter[at]).astype(np.int64)])
        features, rows = np.concatenate(found), np.concatenate(rows)
        order = np.argsort(rows, kind="stable")
        has = np.bincount(owner[letter], minlength=len(lengths)) > 0
        yield first, last - first, features[order], rows[order], has
        first = last


def codewords(n: int) -> np.ndarray:
    """A ±1 codeword for each of ``n`` classes, as rows.

    Up to five classes: every split of the classes once. More: the best, by the least
    distance of two rows, of some random codes of 10 log2(n) bits.
    """
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        splits = [[1.0] + [1.0 if m >> i & 1 else -1.0 for i in range(n - 1)] for m in range((1 << (n - 1)) - 1)]
        return np.array(splits).T
    rng, best, least = np.random.default_rng(7), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        distance = int(((code[:, None] != code[None]).sum(axis=2) + np.eye(n, dtype=int) * 10**6).min())
        if distance > least:
            best, least = code, distance
    return best


def fit(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(weights of features and bits, codewords, weight of each bit, scale) from counts by language."""
    share = (counts + PRIOR) / (counts + PRIOR).sum(axis=1, keepdims=True)
    code = codewords(len(counts))
    weights = np.zeros((counts.shape[1], code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        one, zero = share[code[:, b] > 0], share[code[:, b] < 0]
        if len(one) and len(zero):
            weights[:, b] = np.log(one.mean(axis=0)) - np.log(zero.mean(axis=0))
    margins = code * (share @ weights)  # expected, of each language and bit
    reliable = np.maximum(margins.min(axis=0), 1e-3)
    scale = 4.0 / max(float(np.median(margins)), 1e-3)
    return weights, code, reliable / reliable.sum(), scale


def decode(margins: np.ndarray, code: np.ndarray, reliable: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, score, lead over the second best) of rows of margins; scores of a row sum to 1."""
    loss = np.logaddexp(0, -scale * margins[:, None, :] * code[None]) @ reliable
    likely = np.exp(-3 * (loss - loss.min(axis=1, keepdims=True)))
    likely /= likely.sum(axis=1, keepdims=True)
    ranked = np.sort(likely, axis=1)
    lead = ranked[:, -1] - ranked[:, -2] if likely.shape[1] > 1 else np.ones(len(likely))
    return likely.argmax(axis=1), ranked[:, -1], lead


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE):
    """(languages, :func:`fit` of them) from rows with a language; null ids, texts and languages don't count.

    The sample is bounded: about ``per_language`` documents of each, or all if there are fewer.
    """
    known = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return [], None
    chosen = F.lit(False)
    for lang in languages:
        limit = int(min(1.0, per_language / sizes[lang]) * 2**31)
        chosen = F.when(F.col("lang") == lang, F.pmod(F.xxhash64(F.lit("lang"), "id"), F.lit(2**31)) < limit).otherwise(chosen)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.searchsorted(languages, batch.column(1).to_pylist())
            for first, rows, features, owner, _ in text_features(batch.column(0)):
                keys, n = np.unique(labels[first : first + rows][owner].astype(np.int64) * FEATURES + features, return_counts=True)
                yield pa.record_batch([pa.array(keys), pa.array(n)], ["key", "n"])

    # at most FEATURES rows for each language
    rows = known.where(chosen).select("text", "lang").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(languages) * FEATURES)
    counts[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return languages, fit(counts.reshape(len(languages), FEATURES))


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, ambiguous)`` of every row, from its whole text alone.

    A null text, or one without a letter, is ``und`` with score 0, as is every text where no
    language was learned. Null ids stay null, rows that repeat are judged alike, an empty
    table gives an empty result, and other columns aren't read.
    """
    languages, fitted = model
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.full(batch.num_rows, UNKNOWN, object)
            score, unsure = np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            if languages:
                weights, code, reliable, scale = shared.value
                for first, rows, features, owner, has in text_features(batch.column(1)):
                    sums, n = np.zeros((rows, weights.shape[1])), np.bincount(owner, minlength=rows)
                    for a in range(0, len(features), 1 << 18):
                        own = owner[a : a + (1 << 18)]
                        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                        np.add.at(sums, own[starts], np.add.reduceat(weights[features[a : a + (1 << 18)]], starts, axis=0, dtype=np.float64))
                    best, sure, lead = decode(sums / np.maximum(n, 1)[:, None], code, reliable, scale)
                    here = np.flatnonzero(has) + first
                    lang[here] = np.array(languages, object)[best[has]]
                    score[here], unsure[here] = sure[has], lead[has] < AMBIGUOUS
            yield pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def held_out_languages(docs: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """Every row predicted by what the rows teach whose crc32 of the id isn't ``remainder``."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))
    found = predict(docs, learn(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")

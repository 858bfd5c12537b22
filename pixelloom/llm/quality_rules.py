"""Quality rules as weak supervision, in DataFrame functions only.

Rules look for kinds of defects, several rules for each kind. Every rule votes bad, good
or abstains. For each kind, expectation-maximisation finds how often each rule votes which
way on texts with the defect and without it, from how the kind's rules agree, without
labels; nothing holds these numbers but a prior of a few texts' weight. A text's quality is
the posterior probability that it has none of the defects, which takes the place of "all
rules must pass": one rule that others contradict is overruled. The driver sees only the
number of documents with each pattern of votes: at most 3 ** 9 rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

#: Characters that count as symbols, and all ASCII signs and digits.
SYMBOLS = "#*$%&|<>"
SIGNS = "!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A document is kept from this posterior on.
THRESHOLD = 0.5
ROUNDS = 300
#: (kind of defect, name, bad where this holds, good where this holds); where neither holds, the rule abstains.
RULES = (
    ("markup", "symbols", "100 * n_symbols > 6 * word_chars", "100 * n_symbols <= word_chars"),
    ("markup", "symbol_words", "10 * n_marked > n_words", "50 * n_marked <= n_words"),
    ("markup", "signs", "100 * n_signs > 9 * word_chars", "100 * n_signs <= 6 * word_chars"),
    ("repetition", "repeats", "100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    ("repetition", "lines", "2 * n_dup_lines > n_lines", "10 * n_dup_lines <= n_lines"),
    ("repetition", "variety", "n_words >= 50 AND 10 * n_distinct < 4 * n_words", "n_words < 50 OR 2 * n_distinct >= n_words"),
    ("shouting", "loud_words", "2 * n_loud > n_words", "20 * n_loud <= n_words"),
    ("shouting", "capitals", "100 * n_capitals > 40 * word_chars", "100 * n_capitals <= 15 * word_chars"),
    ("shouting", "marks", "100 * n_marks > 5 * word_chars", "100 * n_marks <= word_chars"),
)
#: Where EM starts, and a few texts' weight of it in every round: P(bad, abstain, good) without the defect and with it; share with it.
START = ((0.1, 0.2, 0.7), (0.7, 0.2, 0.1))
START_SHARE = 0.1
PRIOR_TEXTS = 10.0


def _windows(width: int = 5) -> Column:
    """Sorted codes of the windows of ``_w``: hash above, position in the low ``_bits`` bits."""
    at = "x -> shiftleft(xxhash64(" + ", ".join(f"_h[x + {i}]" for i in range(width)) + "), _bits) | cast(x as bigint)"
    return F.expr(f"IF(n_words < {width}, CAST(array() AS array<bigint>), sort_array(transform(sequence(0, n_words - {width}), {at})))")


def _computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each evaluated once for a row.

    The optimizer copies a projected expression to where it is used, even into the lambda
    of another and so into its loop; it doesn't copy the output of a generator.
    """
    one = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    return df.select("*", one.alias("_one")).select(*df.columns, "_one.*")


def quality_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, row: bool = False) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_loud, n_marked, n_distinct, n_signs, n_capitals, n_marks)``.

    All are long; a null text counts as empty and has 0 throughout. ``n_lines`` counts
    lines with a word, ``n_loud`` words that end in two or more ``!``, ``n_marked`` words with a
    symbol, ``n_distinct`` distinct words, ``n_signs`` ASCII signs and digits, ``n_capitals`` A-Z and
    ``n_marks`` ``!``; with ``row`` the input row stays as the struct ``_row``. Windows that agree
    in all bits of their hash that are left beside the position are compared word by word.
    """
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if row else []
    held = ["_row"] if row else []
    space = r"[\x20\x09-\x0D]+"
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"), *kept)
    words = _computed(
        text,
        _w=F.filter(F.split("_t", space), lambda w: w != ""),
        _l=F.filter(F.split("_t", "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != ""),
        _b=F.translate("_t", " \t\n\x0b\x0c\r", ""),
    )
    without = lambda chars: F.char_length("_b") - F.char_length(F.translate("_b", chars, ""))
    counted = _computed(
        words,
        n_words=F.size("_w"),
        word_chars=F.char_length("_b"),
        n_symbols=without(SYMBOLS),
        n_signs=without(SIGNS),
        n_capitals=without(CAPITALS),
        n_marks=without("!"),
        n_marked=F.size(F.filter("_w", lambda w: F.translate(w, SYMBOLS, "") != w)),
        n_lines=F.size("_l"),
        n_dup_lines=F.size("_l") - F.size(F.array_distinct("_l")),
        n_loud=F.size(F.filter("_w", lambda w: F.endswith(w, F.lit("!!")))),
        _h=F.transform("_w", lambda w: F.xxhash64(w)),
        _bits=F.expr("greatest(1, CAST(ceil(log2(size(_w) + 1)) AS int))"),
    )
    coded = _computed(counted, _s=_windows(width), n_distinct=F.size(F.array_distinct("_h")))
    same = lambda a, b: f"(shiftright({a}, _bits) = shiftright({b}, _bits) AND slice(_w, CAST({a} & (shiftleft(1L, _bits) - 1) AS int) + 1, {width}) = slice(_w, CAST({b} & (shiftleft(1L, _bits) - 1) AS int) + 1, {width}))"
    repeated = F.expr(f"IF(size(_s) < 2, CAST(array() AS array<bigint>), sort_array(transform(filter(_s, (c, i) -> (i > 0 AND {same('c', '_s[i - 1]')}) OR (i + 1 < size(_s) AND {same('c', '_s[i + 1]')})), c -> c & (shiftleft(1L, _bits) - 1))))")
    covered = F.expr(f"aggregate(_r, named_struct('n', 0L, 'end', 0L), (a, p) -> named_struct('n', a.n + p + {width} - greatest(a.end, p), 'end', p + {width}), a -> a.n)")
    marked = _computed(coded, _r=repeated)
    as_long = lambda *names: [F.col(c).cast("long").alias(c) for c in names]
    return _computed(marked, n_repeat_words=covered.cast("long")).select("doc_id", *as_long("n_words", "word_chars", "n_symbols", "n_dup_lines"), "n_repeat_words", *as_long("n_lines", "n_loud", "n_marked", "n_distinct", "n_signs", "n_capitals", "n_marks"), *held)


def vote(bad: str, good: str) -> Column:
    """-1 bad, 1 good, 0 abstains."""
    return F.when(F.expr(bad), F.lit(-1)).when(F.expr(good), F.lit(1)).otherwise(F.lit(0))


def defect_posterior(votes: tuple[int, ...], share: float, rates: list) -> float:
    """Probability of the defect; ``rates``: of each rule P(vote -1, 0, 1) without the defect and with it."""
    odds = math.log(share / (1 - share)) + sum(math.log(with_it[v + 1] / without[v + 1]) for v, (without, with_it) in zip(votes, rates, strict=True))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def fit_kind(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list]:
    """(share of texts with the defect, rates as in :func:`defect_posterior`) by EM over counted patterns of one kind's rules.

    E: the posterior of each pattern. M: the share is the mean posterior, a rate the share of
    votes of one way among texts of one sort, weighed by the posteriors. Rules are taken to
    vote independently but for the defect; three or more of a kind are needed to tell them apart.
    """
    n_rules = len(patterns[0][0]) if patterns else 0
    share, rates = START_SHARE, [START] * n_rules
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        judged = [(votes, n, defect_posterior(votes, share, rates)) for votes, n in patterns]
        after = (sum(n * p for _, n, p in judged) + START_SHARE * PRIOR_TEXTS) / (total + PRIOR_TEXTS)
        rates = []
        for k in range(n_rules):
            both = []
            for sort, start in enumerate(START):
                votes_of = [sum(n * (p if sort else 1 - p) for votes, n, p in judged if votes[k] == v) for v in (-1, 0, 1)]
                both.append(tuple((c + PRIOR_TEXTS * s) / (sum(votes_of) + PRIOR_TEXTS) for c, s in zip(votes_of, start, strict=True)))
            rates.append(tuple(both))
        done, share = abs(after - share) < 1e-12, after
        if done:
            break
    return share, rates


def fit_rules(patterns: list[tuple[tuple[int, ...], int]], rules=RULES, rounds: int = ROUNDS) -> dict[str, tuple[float, list]]:
    """:func:`fit_kind` of every kind; patterns: the votes of all rules and how many texts cast them."""
    fitted = {}
    for kind in dict.fromkeys(rule[0] for rule in rules):
        own = [k for k, rule in enumerate(rules) if rule[0] == kind]
        counts: dict[tuple[int, ...], int] = {}
        for votes, n in patterns:
            part = tuple(votes[k] for k in own)
            counts[part] = counts.get(part, 0) + n
        fitted[kind] = fit_kind(sorted(counts.items()), rounds) if counts else (START_SHARE, [START] * len(own))
    return fitted


def quality_of(votes: tuple[int, ...], fitted: dict[str, tuple[float, list]], rules=RULES) -> float:
    """Probability of no defect of any kind."""
    return math.prod(1 - defect_posterior(tuple(v for v, rule in zip(votes, rules, strict=True) if rule[0] == kind), *fit) for kind, fit in fitted.items())


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, threshold: float = THRESHOLD, row: bool = False) -> DataFrame:
    """Features, ``base_failed``, ``kept`` and the posterior ``quality`` of every row.

    ``base_failed``: fewer than 10 words, or over 20 % of the words in repeated windows;
    such a row is never kept. Others are kept where the posterior is ``threshold`` or more.
    Null and empty texts fail; a null id stays null; an empty table gives an empty result.
    Rows that repeat are judged alike. No other column is read, whatever its name.
    """
    names = [f"v{i}" for i in range(len(rules))]
    votes = [vote(bad, good).alias(v) for v, (_, _, bad, good) in zip(names, rules, strict=True)]
    features = quality_features(docs, id_col, text_col, row=row).select("*", *votes)
    features = stored(features, "quality-features")  # the counts below read the votes only, not the rows
    counted = features.groupBy(*names).count().collect()
    fitted = fit_rules(sorted((tuple(r[:-1]), r[-1]) for r in counted), rules)
    quality = F.lit(1.0)
    for kind, (share, rates) in fitted.items():
        odds = F.lit(math.log(share / (1 - share)))
        for v, (without, with_it) in zip([v for v, rule in zip(names, rules, strict=True) if rule[0] == kind], rates, strict=True):
            bad, none, good = (math.log(b / a) for a, b in zip(without, with_it, strict=True))
            odds = odds + F.when(F.col(v) < 0, bad).when(F.col(v) > 0, good).otherwise(none)
        quality = quality * (1 - 1 / (1 + F.exp(-odds)))
    judged = features.withColumn("quality", quality)
    failed = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= threshold))


def quality_report(docs: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return quality_verdicts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    return quality_verdicts(docs, row=True).where("kept").select("_row.*")

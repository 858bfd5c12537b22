"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut

#: A distribution function is tabulated up to mean + this many deviations + 20.
TAIL = 10
#: The tables of all sources are broadcast if they hold at most so many numbers (8 MB);
#: else they are joined by source, and the engine splits hot ones.
BROADCAST_NUMBERS = 1_000_000
#: Largest mean that is inverted by a table of the whole distribution.
TABLE_RATE = 1000.0


def uniform(key: Column, seed: str) -> Column:
    """A number of [0, 1) from the first 52 bits of an MD5 digest: the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def poisson_table(rate: Column) -> Column:
    """P(count <= k) for k = 0, 1, ... until it is 1 for every 52-bit number.

    Terms are summed as exp(-rate + k log rate - log k!) so that large rates don't underflow.
    """
    last = F.ceil(rate + TAIL * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.lit(0.0).alias("lg"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all"))

    def step(acc, k):
        lg = acc["lg"] + F.when(k > 0, F.log(k.cast("double"))).otherwise(F.lit(0.0))
        total = acc["sum"] + F.exp(k * F.log(rate) - rate - lg)
        return F.struct(lg.alias("lg"), total.alias("sum"), F.concat(acc["all"], F.array(total)).alias("all"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(0), last), start, step, lambda acc: acc["all"])).otherwise(F.array(F.lit(1.0)))


def normal_quantile(u: Column) -> Column:
    """Of a number of (0, 1), within 0.00045: rational approximation 26.2.23 of Abramowitz and Stegun."""
    tail = F.greatest(F.least(u, 1 - u), F.lit(2.0**-53))
    t = F.sqrt(-2 * F.log(tail))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return F.when(u < 0.5, -z).otherwise(z)


def large_count(u: Column, rate: Column) -> Column:
    """Inverse Poisson distribution of a large mean, by the Cornish-Fisher expansion."""
    z = normal_quantile(u)
    return F.greatest(F.lit(0), F.ceil(rate + z * F.sqrt(rate) + (z * z - 1) / 6 - 0.5)).cast("int")


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", budget: float = 1.0) -> DataFrame:
    """``(source, chars, rate)``: how often each source's documents are repeated on average.

    ``weights``: target share of each source's characters; sources without one get none.
    None: shares in proportion to the square root of a source's size. The output has
    ``budget`` times the characters of the input. Null is a source like any other, named
    null (in ``weights``: None); a null text has no characters, a source without
    characters the rate 0.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.coalesce(F.char_length("text"), F.lit(0))).cast("long").alias("chars"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.sqrt(F.col("chars").cast("double")))
    else:
        weight = F.lit(0.0)
        for name, share in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(share))).otherwise(weight)
        weighed = sizes.withColumn("weight", weight)
    total = weighed.agg(F.sum("chars").alias("all_chars"), F.sum(F.floor(F.col("weight") * 1000).cast("long")).alias("all_weight"))
    rate = F.col("all_chars") * (F.floor(F.col("weight") * 1000) / F.col("all_weight")) / F.col("chars") * F.lit(float(budget))
    return weighed.crossJoin(F.broadcast(total)).select("source", "chars", F.when(F.col("chars") > 0, F.coalesce(rate, F.lit(0.0))).otherwise(F.lit(0.0)).alias("rate"))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: str = "mix", budget: float = 1.0, id_col: str = "doc_id", source_col: str = "source", shuffle: bool = True) -> DataFrame:
    """Every row of ``docs`` as often as a Poisson number with its source's mean rate says.

    The number is the inverse distribution function at a hash of seed and id, so it depends
    on nothing but these, and reruns and lost tasks give the same rows. Adds ``mix_copy``
    (from 1), ``mix_copies`` and ``mix_order``, by which the rows are sorted across all
    partitions: a random order that spreads copies. Means over ``TABLE_RATE``, of a source that
    is tiny beside its weight, are inverted by an expansion, some thousandths of a standard
    deviation off. Rows with a null id hash as "null";
    rows that repeat an id are repeated alike. Other columns are kept; those of the three
    names are replaced. An empty table gives an empty result.
    """
    own = [c for c in docs.columns if c not in ("mix_copy", "mix_copies", "mix_order")]
    texts = docs.select(F.col(source_col).alias("source"), F.col("text").cast("string").alias("text"))
    rates = source_rates(texts, weights, "source", budget).select(F.col("source").alias("_mix_source"), F.col("rate").alias("_mix_rate"), F.when(F.col("rate") <= TABLE_RATE, poisson_table(F.least(F.col("rate"), F.lit(TABLE_RATE)))).alias("_mix_table"))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rates = cut(rates)
    numbers = rates.agg(F.sum(F.greatest(F.size("_mix_table"), F.lit(1)))).first()[0] or 0
    if numbers <= BROADCAST_NUMBERS:
        rates = F.broadcast(rates)
    drawn = docs.select(*own, uniform(key, seed).alias("_mix_u"))
    joined = drawn.join(rates, F.col(source_col).eqNullSafe(F.col("_mix_source")), "left")
    counted = joined.withColumn("mix_copies", F.when(F.col("_mix_table").isNull(), large_count(F.col("_mix_u"), F.col("_mix_rate"))).otherwise(F.size(F.filter("_mix_table", lambda p: p <= F.col("_mix_u"))))).where("mix_copies > 0")
    copies = counted.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    ordered = copies.withColumn("mix_order", F.md5(F.concat(F.lit(f"{seed}/order:"), key, F.lit(":"), F.col("mix_copy").cast("string"))))
    result = ordered.select(*own, "mix_copy", "mix_copies", "mix_order")
    return result.orderBy("mix_order") if shuffle else result

"""Mixing sources to target weights by Poisson replication (native).

A source's repetition rate is the bytes its target weight gives it over the
bytes it has.  Each document draws its number of copies from a Poisson
distribution of that mean, by inverting the distribution at a number in (0, 1)
hashed from seed and document; copies are exploded and shuffled globally.

The distribution is tabulated once for each source, only where a double can tell
it from 0 and 1: twelve standard deviations on both sides of the mean, so the
table grows with the root of the rate.  Rates over ``HIGHEST`` are refused.

Defined results: a null source is a source of its own; a null text has no
bytes, and a text of any length counts whole; a source without bytes has rate 1;
rows repeated in the input draw the same number; a document that draws 0 is left
out; an empty table gives none.  Columns that the result adds are named anew (an
underscore behind) where the input has them.
As the SQL has it, a draw hangs on ``key`` and source alone: all rows of a source
without a key, and different texts under one key, share a draw.  With ``by_text``
(the pipeline's stage) the text is hashed too, so these draw, and are placed,
apart; only rows that repeat key, source and text share a draw then.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from famloom.llm.common import fresh, materialise, partitions

SEED = 20
#: Targets follow bytes to this power where no weights are given (1: as is, 0: equal).
TEMPERATURE = 0.5
#: Highest repetition rate; its table has some 760,000 entries.
HIGHEST = 1e9
#: Entries of all tables (8 bytes each) up to which they are broadcast; beyond, documents are dealt by source and one of SALTS.
BROADCAST, SALTS = 1 << 20, 64


def hashed_uniform(*cols: Column, seed: int) -> Column:
    """In (0, 1), from 52 bits of md5: the same in any engine."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def _log_factorial(k: Column) -> Column:
    """Of 0 or of 32 and more, by Stirling's series."""
    x = F.greatest(k, F.lit(32)).cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(k == 0, 0.0).otherwise(series)


def poisson_tables(rates: DataFrame) -> DataFrame:
    """``rates`` (source, rate) with low and cdf: P(X <= low), P(X <= low + 1), ... as far as a double tells it from 1.

    Log probabilities are summed from the first on, so large means do not underflow.
    """
    wide = 12 * F.sqrt("rate") + 24
    low = F.floor(F.col("rate") - wide)
    ends = rates.withColumn("low", F.when(low < 32, 0).otherwise(low).cast("long")).withColumn("high", F.ceil(F.col("rate") + wide).cast("long"))
    terms = ends.select("source", "rate", "low", F.explode(F.sequence("low", "high")).alias("k"))
    r = F.greatest("rate", F.lit(1e-300))
    first = F.col("low") * F.log(r) - r - _log_factorial(F.col("low"))
    so_far = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    terms = terms.withColumn("lp", F.sum(F.when(F.col("k") == F.col("low"), first).otherwise(F.log(r) - F.log(F.greatest("k", F.lit(1)).cast("double")))).over(so_far))
    terms = terms.withColumn("p", F.sum(F.exp("lp")).over(so_far))
    tables = terms.groupBy("source").agg(F.first("rate").alias("rate"), F.first("low").alias("low"), F.sort_array(F.collect_list("p")).alias("cdf"))
    # The first log probability of a large mean is a small difference of large numbers: its error is a factor, taken out here.
    whole = F.when(F.col("low") > 0, F.transform("cdf", lambda p: p / F.element_at("cdf", -1))).otherwise(F.col("cdf"))
    return tables.withColumn("cdf", F.when(F.col("rate") > 0, whole).otherwise(F.array(F.lit(1.0))))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = 1.0, source: str = "source") -> DataFrame:
    """A row for each source: source, rate.  ``weights``: shares of the output, taken relative to their sum; other sources get none."""
    sizes = docs.select(F.col(source).alias("source"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")).groupBy("source").agg(F.sum("bytes").alias("bytes"))
    if weights is None:
        want = F.pow(F.col("bytes").cast("double"), F.lit(float(temperature)))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else F.create_map().cast("map<string,double>")
        want = F.coalesce(given[F.col("source")], F.lit(0.0))
    sizes = sizes.withColumn("want", want)
    # One row of sums, joined to one row a source.
    sums = sizes.agg(F.sum("bytes").alias("all_bytes"), F.sum("want").alias("all_want"))
    rate = F.when(F.col("bytes") == 0, 1.0).otherwise(F.lit(float(epochs)) * F.col("all_bytes") * F.try_divide(F.col("want"), F.col("all_want")) / F.col("bytes"))
    return sizes.join(F.broadcast(sums), F.lit(True)).select("source", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = 1.0, seed: int = SEED, source: str = "source", key: str = "doc_id",
    by_text: bool = False, names: tuple[str, str, str, str] = ("rate", "copies", "copy", "place"),
) -> DataFrame:
    """All columns of ``docs``, a row for each copy, with four more (``names``, made anew where ``docs`` has them): rate, copies, copy (from 0) and place.

    Rows are dealt to partitions by a hash of their place and sorted by it there: a shuffle of the whole output.
    """
    spark = docs.sparkSession
    rate, copies, copy, place, u, salt, on, low, cdf, row = fresh(docs, *names, "__u", "__salt", "__source", "__low", "__cdf", "__row")
    tables = materialise(poisson_tables(materialise(rates(docs, weights, temperature, epochs, source), "rates")), "distributions")
    size = tables.agg(F.max("rate").alias("most"), F.sum(F.size("cdf").cast("long")).alias("entries")).first()
    if (size["most"] or 0) > HIGHEST:
        raise ValueError(f"a source would be repeated {size['most']:.3g} times, over {HIGHEST:.0e}")
    tables = tables.select(F.col("source").alias(on), F.col("rate").alias(rate), F.col("low").alias(low), F.col("cdf").alias(cdf))
    text = [F.md5(F.col("text").cast("binary"))] if by_text else []
    drawn = docs.withColumn(u, hashed_uniform(F.col(key), F.col(source), *text, seed=seed))
    if (size["entries"] or 0) <= BROADCAST:
        drawn = drawn.join(F.broadcast(tables), F.col(source).eqNullSafe(F.col(on)), "inner")
    else:  # a hot source is dealt to many tasks
        tables = tables.withColumn(f"{salt}_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        drawn = drawn.withColumn(salt, F.pmod(F.xxhash64(u, "text"), F.lit(SALTS)).cast("int"))
        drawn = drawn.join(tables.hint("merge"), F.col(source).eqNullSafe(F.col(on)) & (F.col(salt) == F.col(f"{salt}_")), "inner").drop(salt, f"{salt}_")
    below = F.size(F.filter(cdf, lambda c: c < F.col(u))).cast("long")
    drawn = drawn.withColumn(copies, F.when(below > 0, below + F.col(low)).otherwise(0)).where(F.col(copies) > 0).drop(on, low, cdf, u)
    out = drawn.withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1)))
    put = F.md5(F.concat_ws(":", F.lit(f"place{seed}"), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col(copy).cast("string"), *[F.coalesce(x, F.lit("null")) for x in text]))
    out = out.withColumns({place: put, row: F.monotonically_increasing_id()})
    return out.repartition(partitions(spark), place, row).sortWithinPartitions(place, row).drop(row)

"""Quality rules with host-level verdicts.

Each document is judged by rules of its own; failures are summed by host, and a
host's failure rate is shrunk towards the mean of all hosts by a beta prior
fitted to them (moments).  A host loses all its documents if its rate is over
the limit even at the lower end of what its documents leave open: the mean of
its posterior less ``CREDIBLE`` of its standard deviations.  The limit lies
``SPREAD`` standard deviations of the prior above its mean, so it follows from
how hosts differ, but never under ``LEAST_LIMIT`` or over ``MOST_LIMIT``.

Defined results: a null text has no words (and fails), a text of any length is
measured whole; a null host is no host, has no rate, and is never rejected; a
host of few documents stays near the prior and is not rejected for want of
evidence; if hosts do not differ, or there is one, the prior is as strong as
``STRONGEST``; an empty table gives no rows; repeated rows are counted each.
Other columns are kept by ``keep_good`` as they are, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from famloom.llm.common import arrow_batches, fresh, materialise

MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
#: The limit of host rates: standard deviations of the prior above its mean, and bounds; standard deviations of the posterior below its mean that must be over it.
SPREAD, LEAST_LIMIT, MOST_LIMIT, CREDIBLE = 3.0, 0.5, 0.8, 2.0
#: Bounds of the prior's strength, in documents.
WEAKEST, STRONGEST = 2.0, 1000.0
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOLS, _SPACE = re.compile(r"[#*$%&|<>]"), re.compile(r"[\x20\x09-\x0D]")


def metrics(text: str | None) -> tuple[int, ...]:
    """METRICS of a whole text; words are runs free of ASCII white space, lines end at \\n."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - len(_SPACE.findall(text)),
        len(_SYMBOLS.findall(text)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words that stand in a window found twice or more."""
    windows = list(zip(*[words[i:] for i in range(window)], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen, total, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + window - max(i, end)
            end = i + window
    return total


MEASURED = (*METRICS, "base_failed")


def measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "source"), names: tuple[str, ...] = MEASURED) -> DataFrame:
    """Columns ``keep`` with METRICS and base_failed of each row, under ``names``."""
    arrow_batches(docs.sparkSession)
    src = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys((*keep, "text"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(zip(*[metrics(x.as_py()) for x in b.column("text")], strict=True)) or [()] * len(METRICS)
            failed = [n < MIN_WORDS or 100 * again > REPEAT_PERCENT * n for n, again in zip(got[0], got[-1], strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(x, pa.int64()) for x in got), pa.array(failed, pa.bool_())], [*keep, *names])

    types = dict(src.dtypes)
    return src.mapInArrow(run, ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"`{n}` long" for n in names[:-1]] + [f"`{names[-1]}` boolean"]))


def host_rates(hosts: DataFrame) -> DataFrame:
    """``hosts`` (host, docs, failures: a row for each) with rate (shrunk) and rejected.

    The prior's mean is the mean of hosts' rates, its strength such that the
    variance of a host's rate, less what its number of documents explains, is
    that of the beta distribution.
    """
    raw = F.col("failures") / F.col("docs")
    fit = hosts.agg(F.avg(raw).alias("m"), F.coalesce(F.var_samp(raw), F.lit(0.0)).alias("v"), F.avg(F.lit(1.0) / F.col("docs")).alias("inv"))
    spread = F.col("m") * (1 - F.col("m"))
    # v = spread * (1 + strength * inv) / (strength + 1) where documents are drawn from hosts' own rates
    strength = F.when(F.col("v") - spread * F.col("inv") > 0, (spread - F.col("v")) / (F.col("v") - spread * F.col("inv"))).otherwise(STRONGEST)
    fit = fit.select("m", F.least(F.greatest(strength, F.lit(WEAKEST)), F.lit(STRONGEST)).alias("k"))
    limit = F.least(F.greatest(F.col("m") + SPREAD * F.sqrt(F.col("m") * (1 - F.col("m")) / (F.col("k") + 1)), F.lit(LEAST_LIMIT)), F.lit(MOST_LIMIT))
    # One row, joined to one row a host.
    out = hosts.join(F.broadcast(fit.withColumn("limit", limit)), F.lit(True))
    out = out.withColumn("rate", (F.col("failures") + F.col("m") * F.col("k")) / (F.col("docs") + F.col("k")))
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("docs") + F.col("k") + 1))
    return out.withColumn("rejected", F.col("rate") - CREDIBLE * deviation > F.col("limit")).select("host", "docs", "failures", "rate", "rejected")


def hosts_of(judged: DataFrame, host: str, failed: str = "base_failed") -> DataFrame:
    """Rates of all hosts, written so that Spark knows the table's size and picks the join by it: broadcast while it is small."""
    sums = judged.where(F.col(f"`{host}`").isNotNull()).groupBy(F.col(f"`{host}`").alias("host")).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col(failed).cast("long")).alias("failures"))
    return materialise(host_rates(sums), "hosts")


def judge(docs: DataFrame, host: str = "source", key: str = "doc_id") -> DataFrame:
    """A row for each of ``docs``: key, host, METRICS, base_failed, host_docs, host_failures, host_rate, kept."""
    src = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{host}`").alias("host"), "text")
    judged = materialise(measured(src, ("key", "host")), "rules")
    rates = hosts_of(judged, "host").select("host", F.col("docs").alias("host_docs"), F.col("failures").alias("host_failures"), F.col("rate").alias("host_rate"), "rejected")
    out = judged.join(rates, "host", "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))).select("key", "host", *MEASURED, "host_docs", "host_failures", "host_rate", "kept")


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are.

    Texts are measured twice rather than shuffled: once for the hosts, once where they stand.
    """
    bad = hosts_of(measured(docs.select(F.col(f"`{host}`").alias("host"), "text"), ("host",)), "host").where("rejected")
    names = fresh(docs, *MEASURED, "__bad")
    rows = measured(docs, tuple(docs.columns), tuple(names[:-1])).where(~F.col(names[-2]))
    return rows.join(bad.select(F.col("host").alias(names[-1])), F.col(f"`{host}`") == F.col(names[-1]), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))

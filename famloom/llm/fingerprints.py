"""Document fingerprints by a homomorphic multiset hash (native).

A text is the multiset of its paragraphs (lines, empty ones too).  Each
paragraph is hashed to a wide vector, and a fingerprint is the sum of its
paragraphs' vectors, lane by lane, modulo 2^32.  So the order of paragraphs does
not matter, and a paragraph is inserted or deleted by adding or subtracting its
vector.  Two kinds of lanes make up the vector:

* ``EXACT`` lanes are the eight 32-bit parts of the paragraph's SHA-256: equal
  multisets have equal sums, and others differ but for chance (2^-256).
* ``SIGN`` lanes take one bit for each sentence of the paragraph.  A sum and the
  number of sentences give a random-sign sum, whose squared difference between
  two fingerprints estimates how many sentences they do not share.

Defined results: a null text is empty; the empty text is one empty paragraph;
repeated rows (same doc_id and text) are one document in the order and get equal
results; a null doc_id comes last in the descending order; a table of one
document is its own next; texts of any length are hashed whole; an empty table
gives no rows; other columns are kept by ``fingerprint`` or left out, and may have
any names but those that begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from famloom.llm.common import ranked

EXACT, SIGN = 8, 64
LOW = (1 << 32) - 1
#: Bit 0 of each half of a 64-bit word: two 32-bit lanes are added at once.
PAIR = (1 << 32) | 1


def _low(c: Column) -> Column:
    return c.bitwiseAND(F.lit(LOW))


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n", -1)


def sentences(text: Column) -> Column:
    """Paragraphs cut after a full stop, question or exclamation mark before a blank; cutting never joins two paragraphs."""
    return F.split(text, r"\n|(?<=[.!?]) +", -1)


def lanes(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of column ``text`` as array<long> ``name``: EXACT sums, SIGN / 2 packed sums, the number of sentences."""
    p, s = f"__{name}_p", f"__{name}_s"
    zero = F.lit(0).cast("long")

    def exact(i: Column) -> Column:
        return F.aggregate(p, zero, lambda acc, x: _low(acc + F.conv(F.substring(x, i * 8 + 1, F.lit(8)), 16, 10).cast("long")))

    def packed(j: Column) -> Column:
        return F.aggregate(s, zero, lambda acc, x: acc + F.call_function("shiftrightunsigned", x, j).bitwiseAND(F.lit(PAIR)))

    hashed = df.withColumns({p: F.transform(paragraphs(F.col(text)), lambda x: F.sha2(F.encode(x, "UTF-8"), 256)), s: F.transform(sentences(F.col(text)), lambda x: F.xxhash64(x))})
    over = lambda n, f: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), f)
    return hashed.withColumn(name, F.concat(over(EXACT, exact), over(SIGN // 2, packed), F.array(F.size(s).cast("long")))).drop(p, s)


def _pairs(c: Column, i: int) -> tuple[Column, Column]:
    x = F.element_at(c, i + 1)
    return F.shiftrightunsigned(x, 32), _low(x)


def hexed(c: Column) -> Column:
    """Fingerprint as text: 8 hex digits for each exact lane, 16 for each pair of sign lanes and the number of sentences."""
    return F.array_join(F.transform(c, lambda x, i: F.lpad(F.lower(F.hex(x)), F.when(i < EXACT, 8).otherwise(16), F.lit("0"))), "")


def added(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the union of two multisets, or with sign -1 of the difference (insert or delete paragraphs)."""
    def lane(i: int) -> Column:
        x, y = F.element_at(a, i + 1), F.element_at(b, i + 1)
        if i < EXACT:
            return _low(x + y * sign)
        if i == EXACT + SIGN // 2:
            return x + y * sign
        (xh, xl), (yh, yl) = _pairs(a, i), _pairs(b, i)
        return F.shiftleft(_low(xh + yh * sign), 32).bitwiseOR(_low(xl + yl * sign))

    return F.array(*[lane(i) for i in range(EXACT + SIGN // 2 + 1)])


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints; else 1 - |A - B|^2 / (|A|^2 + |B|^2), estimated from the sign lanes, from 0 to 1."""
    count = lambda c: F.element_at(c, EXACT + SIGN // 2 + 1)

    def signs(c: Column) -> Column:
        """The random-sign sums: twice the ones less the number of sentences."""
        halves = F.flatten(F.transform(F.slice(c, EXACT + 1, SIGN // 2), lambda x: F.array(F.shiftrightunsigned(x, 32), _low(x))))
        return F.transform(halves, lambda x: (2 * x - count(c)).cast("double"))

    def square(c: Column) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x * x)

    sa, sb = signs(a), signs(b)
    value = 1 - F.try_divide(square(F.zip_with(sa, sb, lambda x, y: x - y)), square(sa) + square(sb))
    same = F.forall(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: z["x"] == z["y"])
    return F.when(same, 1.0).otherwise(F.least(F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0)), F.lit(1.0 - 2.0**-20)))


def fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as hex string ``name``."""
    out = lanes(docs.withColumn("__text", F.coalesce(F.col(text), F.lit(""))), "__text", "__lanes")
    return out.withColumn(name, hexed(F.col("__lanes"))).drop("__text", "__lanes")


def neighbours(docs: DataFrame) -> DataFrame:
    """For each distinct (doc_id, text): __id, __h, the key of the document before it and that one's length (__pid, __ph, __pn), in descending doc_id.

    Only ids, hashes and lengths are sorted and joined.
    """
    key = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("__text").alias("__h"), F.length("__text").cast("long").alias("__n"))
    key = key.groupBy("__id", "__h").agg(F.max("__n").alias("__n"))
    key = ranked(key, [F.col("__id").desc_nulls_last(), F.col("__h")], None, "__r")
    n = key.count()
    before = key.select(F.col("__id").alias("__pid"), F.col("__h").alias("__ph"), F.col("__n").alias("__pn"), ((F.col("__r") + 1) % max(n, 1)).alias("__r"))
    return key.join(before, "__r").select("__id", "__h", "__pid", "__ph", "__pn")


def edited(docs: DataFrame, share: int = 3) -> DataFrame:
    """doc_id, __text, __lanes of each document; its text with the last 1/share replaced by the next one's start (__edited), and the next one's lanes.

    The text is shuffled once by its key; the next document's start (a third of
    a text) goes to its reader by the key of the document before it.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    near = neighbours(base)
    keyed = lanes(base.withColumn("__h", F.xxhash64("__text")), "__text", "__lanes")
    on = [F.col("doc_id").eqNullSafe(F.col("__id")), F.col("k.__h") == F.col("m.__h")]
    starts = (
        keyed.alias("k").join(near.alias("m"), on)
        .select("__pid", "__ph", F.substring(F.col("__text"), F.lit(1), F.floor(F.col("__pn") / share).cast("int")).alias("__start"), F.col("__lanes").alias("__next"))
    )
    # Repeated rows would give a start each.
    starts = starts.groupBy("__pid", "__ph").agg(F.first("__start").alias("__start"), F.first("__next").alias("__next")) if _repeated(base) else starts
    out = keyed.join(starts, [F.col("doc_id").eqNullSafe(F.col("__pid")), F.col("__h") == F.col("__ph")])
    n = F.length("__text")
    kept = F.substring(F.col("__text"), F.lit(1), n - F.floor(n / share).cast("int"))
    return out.select("doc_id", "__text", "__lanes", F.concat(kept, "__start").alias("__edited"), "__next")


def _repeated(base: DataFrame) -> bool:
    """Whether a row repeats another's doc_id and text."""
    return bool(base.groupBy("doc_id", F.xxhash64("__text")).count().where("count > 1").limit(1).count())


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and their edited texts, with their likenesses."""
    out = lanes(edited(docs), "__edited", "__lanes2")
    return out.select(
        "doc_id",
        F.length("__text").cast("long").alias("n_chars"),
        F.sha2(F.encode("__edited", "UTF-8"), 256).alias("edited_sha256"),
        hexed(F.col("__lanes")).alias("fingerprint"),
        hexed(F.col("__lanes2")).alias("edited_fingerprint"),
        likeness(F.col("__lanes"), F.col("__lanes2")).alias("near_edited"),
        likeness(F.col("__lanes"), F.col("__next")).alias("near_next"),
    )

"""Readers and writers of alignments ("MSPs") and sequence dictionaries.

An alignment frame has msp_id, score, iden, direction, q_seq, q_lb, q_rb, s_seq,
s_lb, s_rb; coordinates are 1-based, closed and ordered, and direction is -1 if
one side was reversed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from famloom.operators.graph import numbered, partitions, written

FIELDS = ("score", "iden", "q_start", "q_end", "q_seq", "s_start", "s_end", "s_seq")

#: Line numbers (as a power of two) of a report that are one window.
BLOCK = 14


def _placed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, begin, n, value: the lines of text files; begin is where a line's split begins, and n ascends inside a split."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("n"), "value")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, n, value: the lines of text files, n ascending inside a file, whatever splits it is read in.

    A line is placed by the byte at which its split begins and by its order in the
    split; as a line has at least one byte, the sum of both ascends over splits.
    Windows run inside a split.
    """
    place = F.row_number().over(Window.partitionBy("file", "begin").orderBy("n"))
    return _placed_lines(spark, path).select("file", (F.col("begin") + place - 1).alias("n"), "value")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """seq_id (byte order of names, from 0), seq of a sequence list: its first line is the count.

    A line is a name or the header of a sequence: ``>`` and blanks before the
    name are left out, and so is what follows its first blank.  Names are kept
    whole.  A list longer than its count is an error.
    """
    lines = read_lines(spark, path)
    first = lines.orderBy("file", "n").first()
    if first is None:
        raise ValueError("an empty sequence list")
    names = lines.where((F.col("file") != first["file"]) | (F.col("n") != first["n"])).select(F.regexp_extract("value", r"^[\s>]*(\S+)", 1).alias("seq")).where("seq != ''")
    if names.count() > int(first["value"].strip()):
        raise ValueError("more names than the sequence list declares")
    # Equal names are told apart by their place.
    rows = names.withColumn("__n", F.monotonically_increasing_id())
    return numbered(rows, ["seq", "__n"], "seq_id").select(F.col("seq_id").cast("int").alias("seq_id"), "seq")


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """FIELDS of white-space separated lines; lines without eight well-formed fields are dropped."""
    parts = F.split(F.trim(F.col(value)), r"\s+")
    kinds = ("int", "float", "int", "int", "string", "int", "int", "string")
    cols = [F.try_element_at(parts, F.lit(i + 1)).try_cast(t).alias(n) for i, (n, t) in enumerate(zip(FIELDS, kinds, strict=True))]
    keep = [c for c in lines.columns if c != value]
    return lines.select(*keep, *cols).dropna(subset=list(FIELDS))


def normalise(raw: DataFrame) -> DataFrame:
    """Ordered coordinates and direction; each reversed side flips the direction."""
    flip = lambda a, b: F.when(F.col(a) > F.col(b), -1).otherwise(1)
    keep = [c for c in raw.columns if c not in ("q_start", "q_end", "s_start", "s_end")]
    return raw.select(
        *keep,
        (flip("q_start", "q_end") * flip("s_start", "s_end")).alias("direction"),
        F.least("q_start", "q_end").alias("q_lb"), F.greatest("q_start", "q_end").alias("q_rb"),
        F.least("s_start", "s_end").alias("s_lb"), F.greatest("s_start", "s_end").alias("s_rb"),
    )


def known(msps: DataFrame, names: DataFrame) -> DataFrame:
    """Alignments both of whose sequences the dictionary has."""
    one = names.select(F.col("seq").alias("__seq")).distinct()
    return msps.join(one, F.col("q_seq") == F.col("__seq"), "left_semi").join(one, F.col("s_seq") == F.col("__seq"), "left_semi")


def _in_order(raw: DataFrame, names: DataFrame | None) -> DataFrame:
    raw = known(raw, names) if names is not None else raw
    # Written, as range borders are drawn from a sample of what is numbered.
    return normalise(numbered(written(raw, "raw"), ["file", "begin", "n"], "msp_id").drop("file", "begin", "n"))


def read_msps(spark: SparkSession, path: str | list[str], names: DataFrame | None = None) -> DataFrame:
    """Alignments of text files, numbered from 0 as if the files stood one behind the other by path; malformed lines and unknown names take no number."""
    return _in_order(parse_lines(_placed_lines(spark, path)), names)


def read_blast(spark: SparkSession, path: str | list[str], names: DataFrame | None = None, score_cutoff: float = 0, iden_cutoff: float = 0) -> DataFrame:
    """Alignments of text reports, numbered like those of read_msps (see blast_to_msps for what counts)."""
    return _in_order(blast_to_msps(_placed_lines(spark, path), score_cutoff, iden_cutoff), names)


def format_msps(msps: DataFrame, *keep: str) -> DataFrame:
    """Lines of the text format (and columns ``keep``); the query of a reversed alignment is written backwards."""
    back = F.col("direction") == -1
    pick = lambda a, b: F.when(back, F.col(b)).otherwise(F.col(a))
    line = F.format_string("%06d %.1f %06d %06d %s %06d %06d %s ", "score", F.col("iden").cast("double"), pick("q_lb", "q_rb"), pick("q_rb", "q_lb"), F.col("q_seq").cast("string"), "s_lb", "s_rb", F.col("s_seq").cast("string"))
    return msps.select(*keep, line.alias("value"))


def write_msps(msps: DataFrame, path: str) -> None:
    format_msps(msps).write.text(path)


#: Kinds of lines: what they hold (looked for first, as most lines are of another kind) and their pattern.
_REPORT = {
    "q": ("Query:", r"^Query:\s+(\d+)\s+\S+\s+(\d+)"), "s": ("Sbjct:", r"^Sbjct:\s+(\d+)\s+\S+\s+(\d+)"), "same": ("Identities =", r"^\s+Identities =\s+(\d+)/(\d+)"),
    "score": ("Score =", r"^\s+Score =\s*(\S+)"), "query": ("Query=", r"^Query=\s+(\S+)"), "subject": (">", r"^>(\S+)"), "end": ("Parameters:", "^Parameters:"),
}


def _told(lines: DataFrame) -> DataFrame:
    """Lines of a report that count: their kind (a key of _REPORT) and what they tell, a word or two numbers."""
    kind, word, numbers = F, F, [F, F]
    for k, (held, pattern) in _REPORT.items():
        kind = kind.when(F.col("value").contains(held) & F.col("value").rlike(pattern), k)
        if k in ("query", "subject", "score"):
            word = word.when(F.col("kind") == k, F.regexp_extract("value", pattern, 1))
        elif k != "end":
            numbers = [x.when(F.col("kind") == k, F.regexp_extract("value", pattern, g + 1).cast("double")) for g, x in enumerate(numbers)]
    return lines.withColumn("kind", kind).where("kind is not null").select(*(c for c in lines.columns if c != "value"), "kind", word.alias("word"), numbers[0].alias("a"), numbers[1].alias("b"))


def blast_to_msps(lines: DataFrame, score_cutoff: float = 0, iden_cutoff: float = 0, block: int = BLOCK) -> DataFrame:
    """Alignments of text reports: ``lines`` has file, n (line number) and value; where a file is in splits, also begin, by which they are in order.

    A record begins at a score line and ends at the next one or at
    ``Parameters:``; one with neither after it is lost.  Identity is cut to a
    whole number, as in the text format.  Windows run inside a block of 2^block
    line numbers, whatever a file's size; what a block has from those before it (query,
    subject), and what its lines before its first record add to the record that is
    open there, are tables of a row for each block.
    """
    split = [c for c in ("begin",) if c in lines.columns]
    at, spot = ["file", *split, "block"], [*split, "block"]
    told = _told(lines).withColumn("block", F.shiftright(F.col("n").cast("long"), block))
    so_far = Window.partitionBy(*at).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    word = lambda kind: F.last(F.when(F.col("kind") == kind, F.col("word")), True).over(so_far)
    # An own number of partitions: by their size on the way, which is little, many would be put together.
    marked = told.repartition(partitions(lines.sparkSession), *at).withColumns({"query": word("query"), "subject": word("subject"), "rec": F.sum(F.col("kind").isin("score", "end").cast("int")).over(so_far)})
    first = lambda kind, c: F.min_by(c, F.when(F.col("kind") == kind, F.col("n")))
    last = lambda kind, c: F.max_by(c, F.when(F.col("kind") == kind, F.col("n")))
    # Record 0 is what stands before a block's first mark.
    pieces = marked.groupBy(*at, "rec").agg(
        F.min("n").alias("n"), F.max(F.when(F.col("kind") == "score", F.col("word"))).alias("score_text"),
        F.max_by("query", "n").alias("query"), F.min_by("subject", "n").alias("subject"), F.max_by("subject", "n").alias("last_subject"),
        last("same", "a").alias("same"), last("same", "b").alias("of"),
        first("q", "a").alias("q_from"), last("q", "b").alias("q_to"), first("s", "a").alias("s_from"), last("s", "b").alias("s_to"),
    )
    # Read twice.
    pieces = written(pieces, "pieces")
    firsts, lasts = ("q_from", "s_from"), ("query", "same", "of", "q_to", "s_to")
    of_block = F.when(F.col("rec") == 0, F.struct(*firsts, *lasts))
    blocks = pieces.groupBy(*at).agg(F.max("rec").alias("marks"), F.max_by("query", "rec").alias("query"), F.max_by("last_subject", "rec").alias("subject"), F.max(of_block).alias("more"))
    in_order = Window.partitionBy("file").orderBy(*spot)
    ahead, behind = in_order.rowsBetween(Window.unboundedPreceding, -1), in_order.rowsBetween(1, Window.unboundedFollowing)
    opened = F.last(F.when(F.col("marks") > 0, F.struct(*spot, F.col("marks").alias("rec"))), True).over(ahead)
    blocks = written(blocks.select(*at, "marks", F.last("query", True).over(ahead).alias("query_before"), F.last("subject", True).over(ahead).alias("subject_before"), (F.max("marks").over(behind) > 0).alias("go_on"), opened.alias("open"), "more"), "blocks")
    place = F.struct(*spot)
    found = lambda c, pick: pick(F.col(f"more.{c}"), F.when(F.col(f"more.{c}").isNotNull(), place)).alias(f"{c}_more")
    more = blocks.where("more is not null and open is not null").groupBy("file", "open").agg(*(found(c, F.min_by) for c in firsts), *(found(c, F.max_by) for c in lasts))
    more = more.select("file", "open.*", *(f"{c}_more" for c in (*firsts, *lasts)))
    whole = pieces.where("score_text is not null").join(blocks.select(*at, "marks", "query_before", "subject_before", "go_on"), at).where("rec < marks or go_on").join(more, [*at, "rec"], "left")
    begun, ended = (lambda c: F.coalesce(c, f"{c}_more")), (lambda c: F.coalesce(f"{c}_more", c))
    whole = whole.select(
        "file", *split, "n", F.col("score_text").cast("double").alias("value"), (ended("same") / ended("of") * 100).alias("iden"),
        F.coalesce("query_more", "query", "query_before").alias("q_seq"), F.coalesce("subject", "subject_before").alias("s_seq"),
        begun("q_from").cast("int").alias("q_start"), ended("q_to").cast("int").alias("q_end"), begun("s_from").cast("int").alias("s_start"), ended("s_to").cast("int").alias("s_end"),
    )
    whole = whole.where((F.col("value") > 0) & (F.col("value") > score_cutoff) & (F.col("iden") > iden_cutoff))
    return whole.select("file", *split, "n", F.col("value").cast("int").alias("score"), F.col("iden").cast("int").cast("float").alias("iden"), "q_start", "q_end", "q_seq", "s_start", "s_end", "s_seq")


def alignment_view(events: DataFrame) -> DataFrame:
    """Alignments derived from an events table (whole-number formulas of its key), for tests and queries."""
    k = F.col("event_id").cast("int")
    length = 100 + (k % 7) * 60
    third = lambda c: c % 3 * 300
    half = F.floor(k / 2).cast("int")
    q_lb = (k % 13) * 1000 + third(k) + ((F.col("event_id") * 7919) % 40).cast("int") + 1
    s_lb = ((F.col("event_id") * 5 + 3) % 13).cast("int") * 1000 + third(half) + ((F.col("event_id") * 104729) % 40).cast("int") + 1
    user = F.col("user_id").cast("int")
    return events.select(
        F.col("event_id").cast("long").alias("msp_id"), (200 + k % 900).alias("score"), (600 + ((F.col("event_id") * 31) % 400).cast("int")).alias("iden10"),
        user.alias("q_seq"), q_lb.alias("q_lb"), (q_lb + length - 1).alias("q_rb"),
        (user + 1 + k % 4).alias("s_seq"), s_lb.alias("s_lb"), (s_lb + length + k % 5 - 3).alias("s_rb"),
        F.when(F.col("event_type").isin("error", "view"), -1).otherwise(1).alias("direction"),
    ).withColumn("iden", (F.col("iden10") / 10).cast("float"))

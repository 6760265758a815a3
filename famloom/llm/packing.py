"""Bulk-synchronous best-fit packing of token sequences.

Documents (pieces) and the gaps of open sequences are sorted together by size
into range partitions, larger first.  In a superstep every document looks for its
successor, the smallest gap that holds it:

* each partition sweeps its range once.  Of documents that meet at one gap the
  largest (then the one of the lowest id) has the higher rank and takes it, the
  next takes the next larger gap that is free;
* documents that found no gap in their partition take, again by rank, the gaps
  that larger ranges have left: what each partition has left of either is one row
  on the driver, and the edge that is carried from range to range follows from
  these counts;
* gaps shrink by what they took, and the next superstep sorts them anew.

A gap of several times the largest document left offers a slot for each, so many
small documents move in one superstep.  Only documents of more than a
``SHARE``-th of the largest take part; the smaller ones wait, as in best fit
decreasing.  Documents over all gaps open sequences, besides the ``STOCK`` that is
open from the start.  Once few rows are left one task goes on with the same
supersteps by itself (``TAIL`` bounds it).

Defined results: a null text is empty and has the end token alone; documents over
the capacity are cut into full pieces, which are sequences of their own, and a
rest; ties and repeated rows are told apart by their place in the input, each
placed for itself; an empty table gives no rows; other columns are left out,
whatever their names.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from famloom.llm.common import arrow_batches, forget, materialise

CAPACITY, END = 4096, 1
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker remembers.
MEMORY = 600_000
#: Letters that normalising does nothing to but lower-case, as they stand alone (no marks) and their small letter does not depend on what follows.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
#: Such letters, and signs after them: the tokenizer cuts between the two in any case.
_WORD = re.compile(f"([{_LETTERS}]+)([!-&(-/:;=-@\\[-`{{-~]*)")
#: Python's split() takes these for white space, the tokenizer does not.
_NO_SPACE = re.compile("[\x1c-\x1f]")

_memory: dict[str, "Words"] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Words(dict):
    """Ids (little-endian unsigned 32-bit) of words without white space, worked out when a word is first asked for.

    Words of plain letters go to the tokenizer's model alone, in lower case and in its alphabet of bytes; signs after them
    are looked up apart; all else is encoded as a text.  What is put together from parts stays here only if its letters
    were known before: most words come once.  Beyond ``MEMORY`` words it starts anew.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        small = {c for c in map(chr, range(0x80, 0x250)) if _WORD.fullmatch(c) for c in c.lower()}
        self.alphabet = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in small}

    def encode(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: str) -> bytes:
        parts = _WORD.fullmatch(word)
        if not parts:
            ids = self.encode(word)
        else:
            x, end = parts[1].lower(), parts[2]
            if end or x != word:
                known = x in self
                ids = self[x] + self[end] if end else self[x]
                if not known:
                    return ids
            else:
                ids = _packed([t.id for t in self.model.tokenize(x if x.isascii() else x.translate(self.alphabet))])
        if len(self) >= MEMORY:
            self.clear()
        self[word] = ids
        return ids


class WordTokenizer:
    """Ids of whole texts under a tokenizer that drops white space and never joins what it separates: each run between white space is looked up in ``Words``, which a worker keeps."""

    def __init__(self, path: str):
        if path not in _memory:
            _memory[path] = Words(path)
        self.words = _memory[path]

    def _one(self, text: str) -> bytes:
        return self.words.encode(text)

    def raw(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if _NO_SPACE.search(text):
            return self._one(text)
        if text.isascii() and "<|" not in text:  # else it may hold a special token, or what lower-casing would join
            text = text.lower()
        return b"".join(map(self.words.__getitem__, text.split()))


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 (and ids)."""
    arrow_batches(docs.sparkSession)
    path, last = path or tokenizer_path(), int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokenizer(path)
        for b in batches:
            rows, at, start, length, crc, kept = [], [], [], [], [], []
            for k, text in enumerate(b.column("text")):
                raw = tokens.raw(text.as_py() or "") + last
                for p, i in enumerate(range(0, len(raw) // 4, capacity)):
                    part = raw[4 * i : 4 * (i + capacity)]
                    for to, x in ((rows, k), (at, p), (start, i), (length, len(part) // 4), (crc, zlib.crc32(part))):
                        to.append(x)
                    if with_ids:
                        kept.append(np.frombuffer(part, dtype="<i4").tolist())
            cols = [b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(at, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    src = docs.select("doc_id", "text")
    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


# --- supersteps ---------------------------------------------------------------

#: A superstep moves documents from a 1/SHARE of the largest; part of the sequences needed at least that is open from the start.
SHARE, STOCK = 4, 0.95
#: Rows of a range partition, partitions at least, and rows that one task finishes.
RANGE, RANGES, TAIL = 100_000, 4, 500


def swept(is_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gaps, documents) that meet in one sweep of rows sorted larger first, gaps before documents of their size.

    A document takes the last gap before it that is free.  With gaps counted up
    and documents down, a gap and its document stand at one level with nothing
    of that level between them; a document at which the count is lower than ever
    before finds none.
    """
    run = np.cumsum(np.where(is_doc, -1, 1))
    lowest = np.minimum.accumulate(np.minimum(run, 0))
    found = np.flatnonzero(~(is_doc & (run < np.concatenate(([0], lowest[:-1])))))
    doc = is_doc[found]
    count = np.cumsum(np.where(doc, -1, 1))
    order = np.argsort(np.where(doc, count + 1, count), kind="stable")
    level, doc = np.where(doc, count + 1, count)[order], doc[order]
    pair = (level[:-1] == level[1:]) & ~doc[:-1] & doc[1:]
    return found[order[:-1][pair]], found[order[1:][pair]]


def carried(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(partition, first document, documents, partition of the gaps, its gap for the first one): later documents take earlier gaps.

    ``left``: (partition, documents, gaps) without partner, in order of ranges.
    """
    out, free = [], []
    for part, docs, gaps in left:
        first = 0
        while first < docs and free:
            there, n = free.pop()
            many = min(n, docs - first)
            out.append((part, first, many, there, n - 1))
            first += many
            if n > many:
                free.append((there, n - many))
        if gaps:
            free.append((part, gaps))
    return out


def _opened(over: int, least: int, capacity: int) -> int:
    """Sequences for ``over`` documents of at least ``least``: as many as they need in any case."""
    return -(-over // (capacity // least)) if over else 0


def finish(ids: np.ndarray, sizes: np.ndarray, seqs: np.ndarray, gaps: np.ndarray, fresh_seq: int, capacity: int) -> tuple[np.ndarray, ...]:
    """The same supersteps in memory: (id, size, sequence, turn, slot) of every document."""
    order = np.lexsort((ids, -sizes))
    ids, sizes, out, turn = ids[order], sizes[order], [], 0
    while len(ids):
        turn += 1
        most = int(sizes[0])
        n = int(np.searchsorted(-sizes, -(most // SHARE), side="right"))
        now = sizes[:n]
        over = now[now > (gaps.max() if len(gaps) else 0)]
        if len(over):
            new = _opened(len(over), int(over[-1]), capacity)
            seqs, gaps = np.concatenate([seqs, fresh_seq + np.arange(new)]), np.concatenate([gaps, np.full(new, capacity, dtype=np.int64)])
            fresh_seq += new
        use = np.flatnonzero(gaps >= now[-1])
        many = np.maximum(1, gaps[use] // most)
        at = np.repeat(use, many)
        slot = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        size, doc = np.concatenate([gaps[at] // np.repeat(many, many), now]), np.concatenate([np.zeros(len(at), dtype=bool), np.ones(n, dtype=bool)])
        rows = np.lexsort((doc, -size))
        g, d = swept(doc[rows])
        g, d = rows[g], rows[d] - len(at)
        out.append((ids[d], sizes[d], seqs[at[g]], np.full(len(d), turn), slot[g]))
        np.subtract.at(gaps, at[g], sizes[d])
        ids, sizes = np.delete(ids, d), np.delete(sizes, d)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, dtype=np.int64) for _ in range(5))


_SWEPT = "id long, size long, seq long, slot long, kind int, part int, place long"
_LINK = "id long, size long, seq long, turn long, slot long"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (size, kind 0 gap or 1 document, id, slot) of one range, sorted: kind 0 where a document met a gap, 1 for a document and 2 for a gap left, counted by ``place``."""
    from pyspark import TaskContext

    held = list(batches)
    if not held:
        return
    rows = pa.Table.from_batches(held)
    size, kind, ident, slot = (rows.column(c).to_numpy() for c in ("size", "kind", "id", "slot"))
    gap, doc = swept(kind == 1)
    alone = np.ones(len(size), dtype=bool)
    alone[gap] = alone[doc] = False
    for k, at in ((0, doc), (1, np.flatnonzero(alone & (kind == 1))), (2, np.flatnonzero(alone & (kind == 0)))):
        seq = ident[gap] if k == 0 else ident[at]
        n = len(at)
        cols = [ident[at], size[at], seq, slot[gap] if k == 0 else slot[at], np.full(n, k, dtype=np.int32), np.full(n, TaskContext.get().partitionId(), dtype=np.int32), np.arange(n, dtype=np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["id", "size", "seq", "slot", "kind", "part", "place"])


def superstep(docs: DataFrame, gaps: DataFrame, most: int, rows: int) -> DataFrame:
    """``docs`` (id, size) with the sequence and slot each found among ``gaps`` (seq, gap), null where none was free."""
    spark = docs.sparkSession
    many = F.greatest(F.lit(1).cast("long"), F.floor(F.col("gap") / most).cast("long"))
    slots = gaps.select("seq", "gap", many.alias("many"), F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("slot"))
    slots = slots.select(F.floor(F.col("gap") / F.col("many")).cast("long").alias("size"), F.lit(0).alias("kind"), F.col("seq").alias("id"), "slot")
    items = slots.unionByName(docs.select("size", F.lit(1).alias("kind"), "id", F.lit(0).cast("long").alias("slot")))
    order = [F.col("size").desc(), F.col("kind"), F.col("id"), F.col("slot")]
    ranges = max(RANGES, -(-rows // RANGE))
    done = materialise(items.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(_sweep, _SWEPT), "swept")
    # Two rows a range at most.
    left: dict[int, list[int]] = {}
    for r in done.where("kind > 0").groupBy("part", "kind").agg(F.count(F.lit(1)).alias("n")).collect():
        left.setdefault(r["part"], [0, 0])[r["kind"] - 1] = r["n"]
    steps = spark.createDataFrame(carried([(p, *left[p]) for p in sorted(left)]), "p int, first long, many long, there int, top long")
    alone = done.where("kind = 1").select("id", "size", "part", "place")
    on = (F.col("part") == F.col("p")) & (F.col("place") >= F.col("first")) & (F.col("place") < F.col("first") + F.col("many"))
    asks = alone.join(F.broadcast(steps), on, "left").select("id", "size", "there", (F.col("top") - F.col("place") + F.col("first")).alias("that"))
    free = done.where("kind = 2").select(F.col("part").alias("there"), F.col("place").alias("that"), "seq", "slot")
    met = asks.where("there is not null").join(free.hint("merge"), ["there", "that"]).select("id", "size", "seq", "slot")
    none = asks.where("there is null").select("id", "size", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("long").alias("slot"))
    out = materialise(done.where("kind = 0").select("id", "size", "seq", "slot").unionByName(met).unionByName(none), "met")
    forget(done)
    return out


def _sizes(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.col("size").cast("long").alias("size"))


def placements(docs: DataFrame, capacity: int) -> DataFrame:
    """(id, size, seq, turn, slot) of all ``docs`` (id, size); in a sequence they stand by turn and slot."""
    spark = docs.sparkSession
    docs, links, turn, old = _sizes(docs), [], 0, []
    tokens = docs.agg(F.sum("size").alias("n")).first()["n"] or 0
    sequences = int(STOCK * tokens / capacity)
    gaps = spark.range(sequences).select(F.col("id").alias("seq"), F.lit(capacity).cast("long").alias("gap"))
    while True:
        turn += 1
        largest = gaps.agg(F.max("gap").alias("n")).first()["n"] or 0
        top = docs.agg(F.max("size").alias("most"), F.min("size").alias("least"), F.count(F.lit(1)).alias("n")).first()
        if not top["n"]:
            break
        usable = gaps.where(F.col("gap") >= top["least"])
        if top["n"] + usable.count() <= TAIL:
            links.append(_tail(docs, usable, sequences, capacity, turn))
            break
        now = docs.where(F.col("size") >= top["most"] // SHARE)
        over = F.when(F.col("size") > largest, F.col("size"))
        seen = now.agg(F.count(over).alias("over"), F.min(over).alias("low"), F.min("size").alias("least"), F.count(F.lit(1)).alias("n")).first()
        new = _opened(seen["over"], seen["low"] or 1, capacity)
        if new:
            gaps = gaps.unionByName(spark.range(sequences, sequences + new).select(F.col("id").alias("seq"), F.lit(capacity).cast("long").alias("gap")))
            sequences += new
        met = superstep(now, gaps.where(F.col("gap") >= seen["least"]), top["most"], seen["n"])
        links.append(met.where("seq is not null").select("id", "size", "seq", F.lit(turn).cast("long").alias("turn"), "slot"))
        took = met.where("seq is not null").groupBy("seq").agg(F.sum("size").alias("took"))
        rest = gaps.join(took.hint("merge"), "seq", "left").select("seq", (F.col("gap") - F.coalesce("took", F.lit(0))).alias("gap")).where("gap > 0")
        gaps, docs = materialise(rest, "gaps"), materialise(met.where("seq is null").select("id", "size").unionByName(docs.where(F.col("size") < top["most"] // SHARE)), "docs")
        forget(*old)
        old = [gaps, docs]
    return reduce(DataFrame.unionByName, links) if links else spark.createDataFrame([], _LINK)


def _tail(docs: DataFrame, gaps: DataFrame, sequences: int, capacity: int, turn: int) -> DataFrame:
    """``finish`` of few rows, in one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        rows = pa.Table.from_batches(held) if held else None
        if rows is None:
            return
        kind, ident, size = (rows.column(c).to_numpy() for c in ("kind", "id", "size"))
        doc = kind == 1
        order = np.argsort(ident[~doc], kind="stable")
        ids, sizes, seq, at, slot = finish(ident[doc], size[doc], ident[~doc][order], size[~doc][order].copy(), sequences, capacity)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (ids, sizes, seq, at + turn, slot)], ["id", "size", "seq", "turn", "slot"])

    items = docs.select(F.lit(1).alias("kind"), "id", "size").unionByName(gaps.select(F.lit(0).alias("kind"), F.col("seq").alias("id"), F.col("gap").alias("size")))
    return materialise(items.coalesce(1).mapInArrow(run, _LINK), "tail")


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (with ``length`` from 1 to capacity) with sequence_id and offset."""
    # Written, as rows are told apart by their place in it.
    rows = materialise(parts.withColumn("__id", F.monotonically_increasing_id()), "pieces")
    # Full pieces are sequences of their own, by negative numbers.
    found = placements(rows.where(F.col("length") < capacity).select(F.col("__id").alias("id"), F.col("length").alias("size")), capacity)
    before = F.sum("size").over(Window.partitionBy("seq").orderBy("turn", "slot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    found = found.select(F.col("id").alias("__id"), F.col("seq").alias("sequence_id"), before.alias("offset"))
    full = rows.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.col("__id"), "offset": F.lit(0).cast("long")})
    return rows.where(F.col("length") < capacity).join(found.hint("merge"), "__id").unionByName(full).drop("__id")


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """A row per piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(pieces(docs, capacity, path=path), capacity)


def sequences(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """The packed sequences: sequence_id, ids (up to ``capacity``), and positions and document number inside, so that attention stops at documents."""
    placed = place(pieces(docs, capacity, path=path, with_ids=True), capacity)
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "start", "ids"))).alias("parts"))
    return parts.select(
        "sequence_id",
        F.flatten("parts.ids").alias("ids"),
        F.flatten(F.transform("parts", lambda p: F.transform(p["ids"], lambda _, i: p["start"] + i))).alias("position_ids"),
        F.flatten(F.transform("parts", lambda p, k: F.transform(p["ids"], lambda _: k))).alias("segment_ids"),
    )

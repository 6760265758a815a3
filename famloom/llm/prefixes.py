"""Exact token counts of all prefixes of a text, by dynamic programming over prefixes.

A byte-pair encoding of a prefix ends in exactly one token, and what comes before
that token is the encoding of the shorter prefix; so a prefix's last token is the
one whose encoding goes together with the last token of the prefix before it, and
its count is one more.  Two tokens go together if no merge across the border
between them is due before those that make the tokens (``Vocabulary.together``).

Text is cut into pieces first (words with the blank before them, numbers, signs,
white space), as the tokenizer does, and pieces are encoded apart; a worker
remembers the counts of ``MEMORY`` pieces.  The counts of a text's prefixes follow
from those of its pieces, but for three places where the end of a prefix changes
how it is cut, and which are counted as the prefix alone would be:

* blanks at the end are one piece, even where the last one belongs to the next word;
* half of a contraction ('r of 're) is a sign and letters;
* half of a special string is ordinary text, which may go on from the piece before.

Counts tell how many tokens any prefix has and where to cut a text for a budget,
with no text encoded again: ``tokens_of`` and ``fitting`` are plain columns.

Defined results: a null text is empty and has no tokens; texts of any length are
counted whole; equal texts and repeated rows count each for itself; an empty table
gives no rows.  Special strings in a text are one token each, as the tokenizer
library takes them.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from famloom.llm.common import arrow_batches, fresh

TOKENIZER, LIMIT = "byte_bpe_50k.json", 1024
#: Pieces whose counts a worker remembers, the characters of one that may be remembered, and pairs of tokens of which it remembers whether they go together.
MEMORY, LONGEST, PAIRS = 800_000, 64, 300_000

#: Fixed value: how the tokenizer cuts texts (the public pattern of byte-level encodings).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PIECES, _BLANKS = regex.compile(PATTERN), regex.compile(r"\s{2,}")
#: Texts of Latin letters and plain signs, and the same pattern for them in terms that the quicker library has.
_LATIN = re.compile("[\t-\r -~\u00a1-\u00b1\u00b4-\u00b8\u00bb\u00bf-\u024f]*")
_LATIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?[^\s\w]+(?:_+[^\s\w]*)*| ?_+(?:[^\s\w]+_*)*|\s+(?!\S)|\s+")
_AT_END = regex.compile(r"(?<!\s)\s+\Z")
_HALVES = {"'re", "'ve", "'ll"}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _signs() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable Latin-1 for itself, the others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Vocabulary:
    """Tokens and merges of a byte-level encoding file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        plain = file.get("normalizer") is None and file["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if model["type"] != "BPE" or not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"]):
            raise ValueError(f"{path} is not a plain byte-level encoding")
        signs = _signs()
        special = {t["content"] for t in file["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        raw = {bytes(signs[c] for c in word): i for word, i in model["vocab"].items() if word not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        #: How each token was made: its parts and the rank of their merge.
        made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            one, two = bytes(signs[c] for c in a), bytes(signs[c] for c in b)
            pair = raw[one], raw[two]
            self.rank.setdefault(pair, r)
            made.setdefault(raw[one + two], (*pair, r))
        self._made = made
        # A token that no merges make does not occur.
        self._ends = ahocorasick.Automaton()
        for w, i in raw.items():
            if len(w) == 1 or i in made:
                self._ends.add_word(w.decode("latin-1"), (i, len(w)))
        self._ends.make_automaton()
        self._right: dict[int, list[tuple[int, float]]] = {}
        self._left: dict[int, list[tuple[int, float]]] = {}
        self._known: dict[int, bool] = {}

    def _edge(self, token: int, side: int, known: dict[int, list[tuple[int, float]]]) -> list[tuple[int, float]]:
        """What stands at the left (0) or right (1) end of a token while it is being made, each with the rank of the merge that takes it."""
        out = known.get(token)
        if out is None:
            out, at, rank = [], token, float("inf")
            while True:
                out.append((at, rank))
                if at not in self._made:
                    break
                rank, at = self._made[at][2], self._made[at][side]
            out.reverse()
            known[token] = out
        return out

    def together(self, one: int, two: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two tokens."""
        a, b, i, j = self._edge(one, 1, self._right), self._edge(two, 0, self._left), 0, 0
        while True:
            (x, x_rank), (y, y_rank) = a[i], b[j]
            across = self.rank.get((x, y))
            # Merges go by rank, and of equal rank from left to right.
            if across is not None and across < x_rank and across <= y_rank:
                return False
            if x_rank <= y_rank:
                if x_rank == float("inf"):
                    return True
                i += 1
            else:
                j += 1

    def prefix_tokens(self, raw: bytes) -> list[int]:
        """Number of tokens of each prefix of a piece (from one byte on)."""
        count, last, known, done = [0] * (len(raw) + 1), [-1] * (len(raw) + 1), self._known, -1
        # Tokens by where they end, at one place the longest first.
        for end, (token, size) in self._ends.iter(raw.decode("latin-1")):
            if end == done:
                continue
            start = end + 1 - size
            if start:
                pair = last[start] << 32 | token
                fits = known.get(pair)
                if fits is None:
                    if len(known) >= PAIRS:
                        known.clear()
                    fits = known[pair] = self.together(last[start], token)
                if not fits:
                    continue
            done = end
            last[end + 1], count[end + 1] = token, count[start] + 1
        if -1 in last[1:]:
            raise AssertionError("a prefix without a last token")
        return count[1:]


def pieces_of(text: str) -> list[str]:
    return (_LATIN_PIECES if _LATIN.fullmatch(text) else _PIECES).findall(text)


def _last(counts: bytes) -> int:
    return int.from_bytes(counts[-4:], sys.byteorder)


class _Memory(dict):
    """Counts of a piece's prefixes (a number of 4 bytes for each character)."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        if piece in _HALVES:
            sign, letter = (_last(self[x]) for x in (piece[0], piece[1]))
            out = array("i", [sign, sign + letter, self.vocabulary.prefix_tokens(piece.encode())[-1]]).tobytes()
        else:
            raw = piece.encode()
            counts = self.vocabulary.prefix_tokens(raw)
            if len(raw) != len(piece):  # prefixes of whole characters only
                counts = [n for n, after in zip(counts, raw[1:] + b" ", strict=True) if after & 0xC0 != 0x80]
            out = array("i", counts).tobytes()
        if len(piece) <= LONGEST:
            if len(self) >= MEMORY:
                self.clear()
            self[piece] = out
        return out


class Counter:
    """Counts tokens of texts."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.memory = _Memory(self.vocabulary)

    def _pieces(self, text: str) -> tuple[list[str], np.ndarray]:
        """Pieces of a text without special strings, and the counts of their prefixes one behind the other."""
        pieces = pieces_of(text)
        return pieces, np.frombuffer(b"".join(map(self.memory.__getitem__, pieces)), dtype=np.intc)

    def _segments(self, text: str) -> Iterator[tuple[int, int, bool]]:
        """Start, end and whether it is a special string."""
        at = 0
        for m in self.vocabulary.special.finditer(text) if self.vocabulary.special else ():
            if m.start() > at:
                yield at, m.start(), False
            yield m.start(), m.end(), True
            at = m.end()
        if at < len(text):
            yield at, len(text), False

    def _sizes(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Pieces of a text without special strings, their ends, and their numbers of tokens."""
        pieces, inner = self._pieces(text)
        ends = np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
        return pieces, ends, inner[ends - 1]

    def total(self, text: str) -> int:
        """Number of tokens: the count of the last prefix."""
        return sum(1 if special else int(self._sizes(text[start:end])[2].sum()) for start, end, special in self._segments(text))

    def total_and_fitting(self, text: str, limit: int) -> tuple[int, int]:
        """Number of tokens, and characters of the longest prefix of at most ``limit`` tokens."""
        segments = list(self._segments(text))
        if len(segments) != 1 or segments[0][2]:
            n = self.total(text)
            return n, len(text) if n <= limit else int(np.flatnonzero(self.prefixes(text) <= limit)[-1])
        pieces, ends, totals = self._sizes(text)
        sums = np.cumsum(totals)
        if sums[-1] <= limit:
            return int(sums[-1]), len(text)
        # Behind a word with ``limit`` tokens before it every prefix has more.
        k = int(np.searchsorted(sums, limit)) + 1
        while k < len(pieces) and pieces[k].isspace():
            k += 1
        near = self.prefixes(text[: ends[min(k, len(pieces) - 1)]])
        return int(sums[-1]), int(np.flatnonzero(near <= limit)[-1])

    def _ordinary(self, text: str) -> np.ndarray:
        """Counts of all prefixes, from one character on, of a text without special strings."""
        pieces, inner = self._pieces(text)
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        totals = inner[np.cumsum(sizes) - 1].astype(np.int64)
        out = inner + np.repeat(np.cumsum(totals) - totals, sizes)
        for m in _BLANKS.finditer(text):
            start, end = m.span()
            out[start:end] = np.frombuffer(self.memory[m.group()], dtype=np.intc) + (out[start - 1] if start else 0)
        return out

    def prefixes(self, text: str) -> np.ndarray:
        """Number of tokens of each prefix of ``text``, from the empty one to the whole."""
        out, n, before = np.zeros(len(text) + 1, dtype=np.int64), 0, (0, 0)
        for start, end, special in self._segments(text):
            if not special:
                counts = self._ordinary(text[start:end])
                out[start + 1 : end + 1] = n + counts
                before, n = (start, n), n + int(counts[-1])
                continue
            from_, base = self._last_piece(text, *before, start, n)
            for cut in range(start + 1, end):
                out[cut] = base + sum(_last(self.memory[p]) for p in pieces_of(text[from_:cut]))
            n += 1
            out[end], before = n, (end, n)
        return out

    def _last_piece(self, text: str, start: int, base: int, end: int, total: int) -> tuple[int, int]:
        """Where the last piece of text[start:end] begins, blanks at the end being one, and the count before it."""
        if start == end:
            return end, total
        part = text[start:end]
        blanks = _AT_END.search(part)
        if blanks:
            at = blanks.start()
            return start + at, base + (int(self._ordinary(part[:at])[-1]) if at else 0)
        last = pieces_of(part)[-1]
        return end - len(last), total - _last(self.memory[last])


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _run(docs: DataFrame, text: str, columns: str, make) -> DataFrame:
    """``docs`` with the columns that ``make`` gives for the list of texts of a batch."""
    arrow_batches(docs.sparkSession)
    schema = docs.schema
    out = docs.limit(0).selectExpr("*", *(f"cast(null as {t}) as `{n}`" for n, t in (c.split(" ") for c in columns.split(", "))))
    arrow = to_arrow_schema(out.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = make([t or "" for t in b.column(text).to_pylist()])
            values = [*b.columns, *made]
            yield pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

    return docs.select(*(f"`{f.name}`" for f in schema)).mapInArrow(run, out.schema)


def prefix_counts(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, name: str = "prefix_tokens") -> DataFrame:
    """``docs`` with an array of whole numbers: its k-th entry (from 0) is the number of tokens of the text's first k characters."""
    path = tokenizer_path(tokenizer)

    def make(texts: list[str]) -> list[pa.Array]:
        counts = [counter(path).prefixes(t) for t in texts]
        ends = np.cumsum([0, *map(len, counts)])
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(counts) if counts else [], pa.int32()))]

    return _run(docs, text, f"{name} array<int>", make)


def tokens_of(counts: Column, characters: Column) -> Column:
    """Tokens of a text's first characters, from its prefix_counts; null where it has not so many."""
    return F.get(counts, characters)


def fitting(counts: Column, budget: Column | int) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    # Counts may fall from one prefix to the next, so the last that fits is looked for.
    places = F.filter(F.sequence(F.lit(0), F.size(counts) - 1), lambda k: F.get(counts, k) <= budget)
    return F.element_at(places, -1)


def counted(docs: DataFrame, text: str = "text", limit: int = LIMIT, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_chars, the characters of the longest prefix of at most ``limit`` tokens.

    The same counts as prefix_counts, which here do not leave the worker.
    """
    path = tokenizer_path(tokenizer)

    def make(texts: list[str]) -> list[pa.Array]:
        c, total, fit = counter(path), [], []
        for t in texts:
            n, k = c.total_and_fitting(t, limit)
            total.append(n)
            fit.append(k)
        return [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(total, pa.int64()), pa.array(fit, pa.int64())]

    narrow = docs.select("doc_id", F.col(text).alias(fresh(docs, "text")[0]))
    out = _run(narrow, narrow.columns[1], "n_bytes bigint, n_tokens bigint, fit_chars bigint", make)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars")

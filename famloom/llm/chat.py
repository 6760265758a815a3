"""Chat formatting over a prefix tree.

Conversations are formatted by a template that marks turns and escapes control
strings inside texts, reversibly.  Conversations that begin with the same turns
share them: in the tree of turns each node's tokens are emitted once, depth
first, over the whole table.  A node carries its place in that stream, position
ids that go on from its ancestors, and the intervals of the stream that its
ancestors fill, which are what its tokens may attend to besides themselves.

Conversations sorted by the hashes of their turns are the leaves in depth-first
order; what a conversation shares with the tree is what it shares with the one
before it.  So range partitions emit in one pass each, and only each partition's
first and last conversation meet at the driver.

Defined results: null texts and roles are empty; turns that tie are sorted by
role, then text; repeated rows are turns of their own; equal conversations share
all nodes; a null conv_id is one conversation; an empty table gives no rows; a
conversation is held whole, as a row, so very long texts need as much memory in
one task; other columns are left out, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from famloom.llm.common import arrow_batches, materialise, partitions

VOCABULARY = "byte_bpe_50k.tiktoken"
ASSISTANT = "assistant"
_ESCAPED = re.compile(r"\\([\\_n])", re.S)


@dataclass(frozen=True)
class Template:
    """Marks of a turn: open, role, a line end, text, close.  ``control``: strings that must not appear inside texts."""

    open: str = "<|turn|>"
    close: str = "<|end|>\n"
    control: tuple[str, ...] = ("<|turn|>", "<|end|>", "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

    @cached_property
    def _marks(self) -> re.Pattern:
        return re.compile("(?=" + "|".join(re.escape(c) for c in sorted(self.control)) + ")(.)", re.S)

    def escape(self, text: str) -> str:
        """Doubles backslashes and puts ``\\_`` behind the first character of each control string."""
        return self._marks.sub(r"\1\\_", text.replace("\\", "\\\\"))

    def unescape(self, text: str) -> str:
        return _ESCAPED.sub(lambda m: {"\\": "\\", "_": "", "n": "\n"}[m[1]], text) if "\\" in text else text

    def head(self, role: str) -> str:
        return self.open + self.escape(role).replace("\n", "\\n") + "\n"

    def parts(self, role: str, text: str) -> tuple[str, str, str]:
        return self.head(role), self.escape(text), self.close

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The turns (role, text) of a formatted conversation."""
        out = []
        for turn in formatted.split(self.open)[1:]:
            if not turn.endswith(self.close):
                raise ValueError("a turn is not closed")
            role, _, text = turn.removesuffix(self.close).partition("\n")
            out.append((self.unescape(role), self.unescape(text)))
        return out


@lru_cache(maxsize=4)
def encoding(path: str | None = None):
    """Byte-level BPE whose ids give back the bytes of a text."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns (role, text in order) and path, the turns' hashes (32 hex digits each)."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    sorted_turns = F.sort_array(F.collect_list(F.struct(F.col("turn").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))))
    rows = turns.groupBy("conv_id").agg(sorted_turns.alias("turns"))
    one = lambda t: F.substring(F.sha2(F.encode(F.concat(F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]), "UTF-8"), 256), 1, 32)
    return rows.withColumn("path", F.array_join(F.transform("turns", one), ""))


_HASH = 32
_EMITTED = "conv_id {id}, part int, row long, path string, places array<long>, lengths array<long>, shared int, ids array<array<int>>, losses array<array<long>>"


def emitted(convs: DataFrame, template: Template, path: str | None = None) -> DataFrame:
    """A row per conversation, in depth-first order in each partition.

    places, lengths: of its nodes in the partition's own stream; shared: how many
    of them the conversation before emitted; ids, losses: tokens and the loss
    range (first token, end) of the others.
    """
    convs = convs.repartitionByRange(partitions(convs.sparkSession), F.col("path"), F.col("conv_id")).sortWithinPartitions("path", "conv_id")
    kind = dict(convs.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = encoding(path).encode_ordinary, TaskContext.get().partitionId()
        # Marks are encoded once; roles are few.
        close, head = encode(template.close), lru_cache(maxsize=1024)(lambda role: encode(template.head(role)))
        before, places, lengths, end, row = "", [], [], 0, 0
        for b in batches:
            out = {k: [] for k in ("part", "row", "path", "places", "lengths", "shared", "ids", "losses")}
            for turns, now in zip(b.column("turns").to_pylist(), b.column("path").to_pylist(), strict=True):
                shared = 0
                while shared < min(len(places), len(turns)) and before[shared * _HASH : (shared + 1) * _HASH] == now[shared * _HASH : (shared + 1) * _HASH]:
                    shared += 1
                places, lengths, ids, losses = places[:shared], lengths[:shared], [], []
                for t in turns[shared:]:
                    first, text = head(t["role"]), encode(template.escape(t["text"]))
                    ids.append(first + text + close)
                    losses.append([len(first), len(first) + len(text)] if t["role"] == ASSISTANT else [])
                    places.append(end)
                    lengths.append(len(ids[-1]))
                    end += len(ids[-1])
                for k, v in zip(out, (part, row, now, list(places), list(lengths), shared, ids, losses), strict=True):
                    out[k].append(v)
                before, row = now, row + 1
            types = (pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], ["conv_id", *out])

    return convs.mapInArrow(run, _EMITTED.format(id=kind))


def _carried(rows: DataFrame) -> dict[int, tuple[int, int, list[int]]]:
    """part -> (base, cut, places of the nodes its first conversation shares with the part before).

    Nodes of a partition below ``cut`` were emitted before; the others move by base - cut.
    Two rows of each partition are read, without their tokens.
    """
    marked = rows.groupBy("part").agg(F.max("row").alias("row")).withColumn("row", F.explode(F.array(F.lit(0).cast("long"), "row"))).distinct()
    thin = rows.select("part", "row", "path", "places", "lengths")
    found: dict[int, dict[int, object]] = {}
    for r in thin.join(F.broadcast(marked), ["part", "row"]).collect():
        found.setdefault(r["part"], {})[r["row"]] = r
    out, total, before, stack = {}, 0, "", []
    for part in sorted(found):
        first, last = found[part][0], found[part][max(found[part])]
        shared = 0
        while shared < min(len(stack), len(first["lengths"])) and before[shared * _HASH : (shared + 1) * _HASH] == first["path"][shared * _HASH : (shared + 1) * _HASH]:
            shared += 1
        cut = sum(first["lengths"][:shared])
        out[part] = (total, cut, stack[:shared])
        stack = [stack[i] if at < cut else total + at - cut for i, at in enumerate(last["places"])]
        total += max(0, last["places"][-1] + last["lengths"][-1] - cut) if last["places"] else 0
        before = last["path"]
    return out


def intervals(places: list[int], lengths: list[int]) -> list[tuple[int, int]]:
    """Where the nodes lie in the stream, neighbours joined."""
    out: list[tuple[int, int]] = []
    for a, n in zip(places, lengths, strict=True):
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], a + n)
        else:
            out.append((a, a + n))
    return out


def prefix_tree(turns: DataFrame, template: Template = Template(), path: str | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(nodes, paths).

    nodes, a row per turn of the tree: place (of its first token in the stream),
    depth, token_ids, position (of its first token; the others follow), loss
    (first token, end; empty where it is not an assistant's), attend (intervals
    of the stream that its ancestors fill).  paths: conv_id, places.
    """
    spark = turns.sparkSession
    arrow_batches(spark)
    # Written, as range partitioning reads its input twice.
    convs = materialise(conversations(turns), "conversations")
    rows = materialise(emitted(convs, template, path), "tree")
    carry = _carried(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.struct([("place", pa.int64()), ("depth", pa.int32()), ("token_ids", pa.list_(pa.int32())), ("position", pa.int64()), ("loss", pa.list_(pa.int64())), ("attend", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        for b in batches:
            places_out, nodes_out = [], []
            for r in b.drop_columns(["conv_id"]).to_pylist():
                base, cut, held = carry[r["part"]]
                places = [held[i] if at < cut else base + at - cut for i, at in enumerate(r["places"])]
                nodes = []
                for k, (ids, loss) in enumerate(zip(r["ids"], r["losses"], strict=True)):
                    depth = r["shared"] + k
                    if r["places"][depth] >= cut:
                        attend = [{"start": a, "end": e} for a, e in intervals(places[:depth], r["lengths"][:depth])]
                        nodes.append({"place": places[depth], "depth": depth, "token_ids": ids, "position": sum(r["lengths"][:depth]), "loss": loss, "attend": attend})
                places_out.append(places)
                nodes_out.append(nodes)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(places_out, pa.list_(pa.int64())), pa.array(nodes_out, pa.list_(kinds))], ["conv_id", "places", "nodes"])

    node = "struct<place:long,depth:int,token_ids:array<int>,position:long,loss:array<long>,attend:array<struct<start:long,end:long>>>"
    done = materialise(rows.mapInArrow(run, f"conv_id {dict(rows.dtypes)['conv_id']}, places array<long>, nodes array<{node}>"), "nodes")
    return done.select(F.explode("nodes").alias("n")).select("n.*"), done.select("conv_id", "places")


def read_back(nodes: DataFrame, paths: DataFrame, template: Template = Template(), path: str | None = None) -> DataFrame:  # noqa: B008
    """A row per conversation, decoded from the stream: conv_id, formatted, roles, texts, loss_text.

    A node that many conversations share is joined to each; adaptive execution splits such a key.
    """
    arrow_batches(nodes.sparkSession)
    steps = paths.select("conv_id", F.posexplode("places").alias("depth", "place"))
    found = steps.join(nodes.select("place", "token_ids", "loss"), "place")
    whole = found.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "token_ids", "loss"))).alias("nodes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoding(path).decode_bytes
        for b in batches:
            formatted, roles, texts, losses = [], [], [], []
            for conv in b.column("nodes").to_pylist():
                text = b"".join(decode(n["token_ids"]) for n in conv).decode("utf-8")
                turns = template.parse(text)
                formatted.append(text)
                roles.append([r for r, _ in turns])
                texts.append([t for _, t in turns])
                losses.append("".join(template.unescape(decode(n["token_ids"][n["loss"][0] : n["loss"][1]]).decode("utf-8")) for n in conv if n["loss"]))
            cols = [pa.array(formatted, pa.string()), pa.array(roles, pa.list_(pa.string())), pa.array(texts, pa.list_(pa.string())), pa.array(losses, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *cols], ["conv_id", "formatted", "roles", "texts", "loss_text"])

    return whole.mapInArrow(run, f"conv_id {dict(paths.dtypes)['conv_id']}, formatted string, roles array<string>, texts array<string>, loss_text string")


def digests(turns: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """Counts and digests of each conversation as read back from the tree."""
    arrow_batches(turns.sparkSession)
    nodes, paths = prefix_tree(turns, template)
    back = read_back(nodes, paths, template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for b in batches:
            rows = b.drop_columns(["conv_id"]).to_pylist()
            cols = [
                pa.array([len(r["roles"]) for r in rows], pa.int64()),
                pa.array([sha("".join(f"{a}\n{t}\n" for a, t in zip(r["roles"], r["texts"], strict=True))) for r in rows], pa.string()),
                pa.array([len(r["loss_text"]) for r in rows], pa.int64()),
                pa.array([sha(r["loss_text"]) for r in rows], pa.string()),
                pa.array([len(r["formatted"]) for r in rows], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *cols], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return back.mapInArrow(run, f"conv_id {dict(back.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

"""Chat formatting as a prefix tree: turns that conversations share from the start stand once.

A node is a turn after a certain history; its key is a digest of that history. Nodes are
laid out depth-first. Each has the offset where its tokens stand, the position ids that
they have in a conversation, and the interval of later tokens that may attend to them:
those of its own subtree. A token attends to exactly its ancestors and its own past.
Tokens are code points of the formatted text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut, stored

OPEN, CLOSE, ROLE, END_ROLE = "<s>", "</s>", "[INST:", "/INST]"
_CODES = {"\\": "\\\\", "<": "\\l", "[": "\\o", "/": "\\d"}
_CONTROL = re.compile(r"[\\<\[/]")
_ESCAPED = re.compile(r"\\([\\lod])")
_PLAIN = {code[1]: c for c, code in _CODES.items()}


def escape(text: str) -> str:
    """``text`` with a code for a backslash and for each character that begins a control string.

    ``<s>``, ``</s>``, ``[INST:`` and ``/INST]`` then occur nowhere in it.
    """
    return _CONTROL.sub(lambda m: _CODES[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, first and end code point of its text)."""
    head = f"{OPEN}{ROLE}{escape(role)}{END_ROLE}"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse_turn(segment: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    role, _, text = segment.removeprefix(OPEN + ROLE).removesuffix(CLOSE).partition(END_ROLE)
    return unescape(role), unescape(text)


def prefix_tree(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves) of all conversations.

    ``nodes``: ``(key, parent, depth, emit_start, emit_end, attended_until, position_start,
    segment, text_low, text_high, learned)``, a row for each different history, in
    depth-first order of ``emit_start``. Token ``t`` of a node, counted from 0, stands at
    ``emit_start + t`` and has position id ``position_start + t``; tokens from itself up
    to ``attended_until`` may attend to it. Code points ``text_low`` to ``text_high``
    are under the loss mask where ``learned``.
    ``leaves``: ``(conv_id, leaf, path)``: the key of the last turn, and of all turns.

    Turns are ordered by turn number, then role and text; null numbers come first, a null
    role or text is empty. Rows with a null id are left out; rows that repeat a turn are
    turns of their own. Other columns aren't read. An empty table has no nodes. A single
    conversation is gathered in one task, conversations and shared turns never are.
    """
    turns = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("t")).where("conv_id IS NOT NULL")
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    names = ["conv_id", "last", "key", "parent", "path", "depth", "position_start", "n_tokens", "segment", "text_low", "text_high", "learned"]
    kinds = [pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]

    def histories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key, path, position = b"", b"", 0
                for depth, turn in enumerate(turns):
                    segment, low, high = format_turn(turn["role"], turn["text"])
                    parent, key = key, hashlib.blake2b(key + segment.encode(), digest_size=16).digest()
                    path += key
                    out.append((conv, depth + 1 == len(turns), key, parent or None, path, depth, position, len(segment), segment, low, high, turn["role"] == learn))
                    position += len(segment)
            yield pa.record_batch([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)

    schema = "conv_id long, last boolean, key binary, parent binary, path binary, depth int, position_start long, n_tokens long, segment string, text_low long, text_high long, learned boolean"
    each = stored(grouped.mapInArrow(histories, schema), "chat-turns")
    nodes = each.drop("conv_id", "last").dropDuplicates(["key"])

    def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            starts = []
            for n in batch.column(batch.schema.get_field_index("n_tokens")).to_pylist():
                starts.append(total)
                total += n
            yield batch.append_column("part", pa.array([part] * batch.num_rows, pa.int32())).append_column("start", pa.array(starts, pa.int64()))

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    # a path sorts before its extensions, so its order is depth-first; a row for each
    # partition is all that the driver and the broadcast see
    ordered = cut(nodes.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(laid_out, columns + ", part int, start long"))
    sums = sorted((r["part"], r["n"]) for r in ordered.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    offsets, total = [], 0
    for part, n in sums:
        offsets.append((part, total))
        total += n
    base = ordered.sparkSession.createDataFrame(offsets, "part int, base long")
    placed = ordered.join(F.broadcast(base), "part").withColumn("emit_start", F.col("base") + F.col("start")).withColumn("emit_end", F.col("emit_start") + F.col("n_tokens"))
    # a node's tokens are attended to until the last of the conversations that go through it ends
    ends = each.where("last").select("conv_id", "key").join(placed.select("key", "emit_end"), "key").select("conv_id", F.col("emit_end").alias("end"))
    until = each.select("conv_id", "key").join(ends, "conv_id").groupBy("key").agg(F.max("end").alias("attended_until"))
    nodes = placed.join(until, "key").select("key", "parent", "depth", "emit_start", "emit_end", "attended_until", "position_start", "segment", "text_low", "text_high", "learned")
    return nodes, each.where("last").select("conv_id", F.col("key").alias("leaf"), "path")


def read_back(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """``(conv_id, turns, formatted_chars)``: each conversation from the tree's output.

    ``turns``: array of (role, text, learned), in order. Conversations with the same turns
    are read once.
    """
    steps = leaves.select("leaf", "path").dropDuplicates(["leaf"]).select("leaf", F.explode(F.expr("transform(sequence(0, CAST(octet_length(path) / 16 AS int) - 1), i -> substring(path, 16 * i + 1, 16))")).alias("key"))
    joined = steps.join(nodes.select("key", "position_start", "segment", "text_low", "text_high", "learned"), "key")
    whole = joined.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("position_start", "segment", "text_low", "text_high", "learned"))).alias("segments"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = pa.struct([("role", pa.string()), ("text", pa.string()), ("learned", pa.bool_())])
        for batch in batches:
            out, sizes = [], []
            for segments in batch.column(1).to_pylist():
                turns, at = [], 0
                for s in segments:
                    if s["position_start"] != at:
                        raise ValueError("a node's position doesn't follow its parent's")
                    at += len(s["segment"])
                    role, text = parse_turn(s["segment"])
                    if s["learned"]:
                        text = unescape(s["segment"][s["text_low"] : s["text_high"]])
                    turns.append({"role": role, "text": text, "learned": s["learned"]})
                out.append(turns)
                sizes.append(at)
            yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(turn)), pa.array(sizes, pa.int64())], ["leaf", "turns", "formatted_chars"])

    read = whole.mapInArrow(parsed, "leaf binary, turns array<struct<role string, text string, learned boolean>>, formatted_chars long")
    return leaves.select("conv_id", "leaf").join(read, "leaf").select("conv_id", "turns", "formatted_chars")


def chat_digests(conversations: DataFrame) -> DataFrame:
    """The columns of the registered query, of every conversation as it is read back."""
    back = read_back(*prefix_tree(conversations))
    turns = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: t["text"]))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")

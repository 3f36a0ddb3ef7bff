"""Operator 3: chat formatting of reply trees.

Messages name their parent.  Iterative self-joins double the reach of ancestor pointers (1, 2, 4, ...
replies up), and the same tables, joined to the leaves in turn, enumerate every root-to-leaf path with
each message once, in a number of joins that grows with the logarithm of the depth.  Paths of a tree
are ranked by the sum of their messages' scores (ties by leaf), and each of the best ``branches`` is
formatted as one conversation.

Template: ``### role: text</turn>`` and a line feed per message.  ``\\``, ``<``, ``#`` (and ``:`` in
roles) inside roles and texts are escaped by a ``\\``, so control strings in them cannot be taken for
marks and :func:`read_back` restores every turn.  The loss mask is a list of spans over the
formatted text that cover the escaped texts of the assistant's turns.

Edge cases: a null role or text is empty; a message whose parent is null or missing is a root; a
message whose ancestors run in a circle has no root and is left out; a null or NaN score is 0; of
messages with one id the first by tree, parent, role, text and score (null before others) stays; a
message without an id is left out (nothing can reply to it and no leaf names it).  :func:`from_turns`
numbers rows: equal turns keep the order of role and text, null turns come first, a null conv_id is a
conversation of its own.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgpulse.llm.scratch import Scratch

_TURN = re.compile(r"### ((?:[^\\:<#]+|\\.)*): ((?:[^\\<#]+|\\.)*)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def from_turns(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` as messages: each row replies to the one before."""
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    message = conversations.select("conv_id", "role", "text", name.alias("name"), place.alias("place"))
    return message.select(
        F.col("conv_id").alias("tree"), F.concat_ws(":", "name", "place").alias("id"),
        F.when(F.col("place") > 1, F.concat_ws(":", "name", F.col("place") - 1)).alias("parent"),
        "role", "text", F.lit(0.0).alias("score"))


def _paths(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """``(leaf, id, up)``: the message ``up`` replies above each leaf, for all its ancestors and itself."""
    ids = messages.select(F.col("id").alias("known"))
    jump = scratch.keep(messages.select("id", "parent").where("parent is not null").join(
        ids, F.col("parent") == F.col("known"), "left_semi").select("id", F.col("parent").alias("above")))
    leaves = ids.join(jump.select("above").distinct(), F.col("known") == F.col("above"), "left_anti")
    total = messages.count()
    jumps = []
    while not jump.isEmpty() and 1 << len(jumps) <= total:
        jumps.append(jump)
        upper = jump.toDF("via", "top")
        jump = scratch.keep(jump.join(upper, F.col("above") == F.col("via")).select("id", F.col("top").alias("above")))
    # what still has an ancestor further up than there are messages leads into a circle
    rows = leaves.join(jump.select("id"), F.col("known") == F.col("id"), "left_anti").select(
        F.col("known").alias("leaf"), F.col("known").alias("id"), F.lit(0).cast("long").alias("up"))
    for k, step in enumerate(jumps):
        rows = rows.union(rows.join(step, "id").select("leaf", F.col("above").alias("id"), F.col("up") + (1 << k)))
        rows = scratch.keep(rows)
    return rows


def _escape(text: Column, signs: str) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"([{signs}])", r"\\$1")


def _one_of_each_id(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """The messages, one of each id; only those whose id repeats are shuffled with their texts."""
    twice = scratch.keep(messages.groupBy("id").count().where("count > 1").select("id"))
    if twice.isEmpty():
        return messages
    first = messages.join(twice, "id", "left_semi").groupBy("id").agg(
        F.min(F.struct("tree", "parent", "role", "text", "score")).alias("m")).select("id", "m.*").select(messages.columns)
    return scratch.keep(messages.join(twice, "id", "left_anti").unionByName(first))


def format_chats(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``messages(tree, id, parent, role, text, score)`` -> one row per chosen path: tree, leaf, branch
    (1 is the best), score, n_turns, formatted, loss_spans (array of start, end in characters)."""
    scratch = Scratch(messages.sparkSession, "chat")
    messages = _one_of_each_id(scratch.keep(messages.select(
        "tree", "id", "parent", "role", "text", F.nanvl(F.col("score").cast("double"), F.lit(0.0)).alias("score")).where("id is not null")), scratch)
    paths = _paths(messages, scratch)
    scored = paths.join(messages.select("id", "tree", "score"), "id").groupBy("leaf").agg(
        F.sum(F.coalesce("score", F.lit(0.0))).alias("score"), F.max("up").alias("depth"),
        F.max(F.when(F.col("up") == 0, F.col("tree"))).alias("tree"))
    best = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    chosen = scored.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches)
    head = F.concat(F.lit("### "), _escape(F.col("role"), r"\\\\<#:"), F.lit(": "))
    body = _escape(F.col("text"), r"\\\\<#")
    turns = paths.join(chosen, "leaf").join(messages.select("id", "role", "text"), "id").select(
        "tree", "leaf", "branch", "score", (F.col("depth") - F.col("up")).alias("place"),
        (F.coalesce("role", F.lit("")) == "assistant").alias("loss"),
        F.length(head).alias("head"), F.length(body).alias("body"),
        F.concat(head, body, F.lit("</turn>\n")).alias("piece"))
    before = Window.partitionBy("leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.col("head")
    placed = turns.withColumn("span", F.when(F.col("loss"), F.struct(
        start.cast("long").alias("start"), (start + F.col("body")).cast("long").alias("end"))))
    pieces = F.array_sort(F.collect_list(F.struct("place", "piece", "span")))
    return placed.groupBy("leaf").agg(
        F.first("tree").alias("tree"), F.first("branch").alias("branch"), F.first("score").alias("score"),
        F.count("*").alias("n_turns"), pieces.alias("pieces")).select(
        "tree", "leaf", "branch", "score", "n_turns",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        F.transform(F.filter("pieces", lambda p: p["span"].isNotNull()), lambda p: p["span"]).alias("loss_spans"))


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    turns, end = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != end:
            break
        turns.append((_ESCAPED.sub(r"\1", m[1]), _ESCAPED.sub(r"\1", m[2])))
        end = m.end()
    if end != len(formatted):
        raise ValueError(f"not a formatted conversation from character {end}")
    return turns


def masked_text(formatted: str, spans: list[dict]) -> str:
    """The unescaped text under the loss mask."""
    return "".join(_ESCAPED.sub(r"\1", formatted[s["start"]:s["end"]]) for s in spans)


def digests(chats: DataFrame) -> DataFrame:
    """``(tree, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``, all read back from
    the formatted texts and their masks."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()):
                turns, loss = read_back(text), masked_text(text, spans)
                whole = hashlib.sha256()
                for role, said in turns:
                    whole.update(f"{role}\n{said}\n".encode())
                for column, value in zip(out, (len(turns), whole.hexdigest(), len(loss),
                                               hashlib.sha256(loss.encode()).hexdigest(), len(text))):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("tree"), *(pa.array(c, k) for c, k in zip(out, kinds))],
                names=["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = chats.schema["tree"].dataType.simpleString()
    return chats.select("tree", "formatted", "loss_spans").mapInArrow(
        read, f"tree {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

"""Operator 9: sharding by a hierarchical weighted hash tree (DataFrame functions only).

A tree of regions, racks and shards; every node weighs the sum of its shards' weights.  A document
descends: at each level every child draws ``-ln(u) / weight`` with ``u`` hashed from the child's name
and the doc_id, and the smallest draw wins, so children win in proportion to their weights and a
changed weight moves documents only into or out of the subtree in question.  :func:`grown` adds a
shard as a region of its own: no weight inside the old regions changes, so the documents that move all
move to the new shard.

Slots number the documents of a shard without gaps: 16 ** CELL_DIGITS hash cells per shard are
counted and prefix-summed, and only the rows of one cell meet in a window.

Edge cases: a null doc_id is hashed as the empty name; a null text has size 1 and the checksum of no
bytes (0); repeated rows share the shard and get slots of their own; an empty table gives an empty
result; other columns pass through :func:`sharded_documents` unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgpulse.llm.scratch import Scratch

CELL_DIGITS = 3

#: (region, rack, shard, weight)
Leaf = tuple[int, int, int, float]


def even_tree(regions: int = 2, racks: int = 2, shards: int = 2, weight: float = 1.0) -> list[Leaf]:
    """Shards 0, 1, ... spread evenly over racks (numbered through) and regions."""
    return [(r, r * racks + k, (r * racks + k) * shards + s, weight)
            for r in range(regions) for k in range(racks) for s in range(shards)]


def grown(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree and one more shard, in a region and a rack of its own."""
    top = [max(leaf[level] for leaf in tree) + 1 for level in range(3)]
    return [*tree, (top[0], top[1], top[2], weight)]


def _winner(level: str, weights: dict[int, float], key: Column) -> Column:
    """Child with the smallest weighted draw; ties go to the smaller number."""
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    draws = []
    for child, weight in sorted(weights.items()):
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(f"{level}{child}"), key), 11)
        u = (bits.cast("double") + 0.5) / float(1 << 53)
        draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("draw"), F.lit(child).alias("child")))
    return F.array_min(F.array(*draws))["child"]


def _below(tree: Sequence[Leaf], level: int) -> dict[int, dict[int, float]]:
    """For each node of a level its children and their weights."""
    found: dict[int, dict[int, float]] = {}
    for leaf in tree:
        if leaf[3] > 0:
            own = found.setdefault(leaf[level], {})
            own[leaf[level + 1]] = own.get(leaf[level + 1], 0.0) + leaf[3]
    return found


def _descend(frame: DataFrame, tree: Sequence[Leaf], suffix: str) -> DataFrame:
    """Adds the region, rack and shard that ``key`` comes to."""
    regions: dict[int, float] = {}
    for leaf in tree:
        if leaf[3] > 0:
            regions[leaf[0]] = regions.get(leaf[0], 0.0) + leaf[3]
    frame = frame.withColumn(f"region{suffix}", _winner("region", regions, F.col("key")))
    for level, above, name in ((0, "region", "rack"), (1, "rack", "shard")):
        chosen = F.lit(None).cast("int")
        for node, children in sorted(_below(tree, level).items()):
            chosen = F.when(F.col(above + suffix) == node, _winner(name, children, F.col("key"))).otherwise(chosen)
        frame = frame.withColumn(name + suffix, chosen)
    return frame


def _place(docs: DataFrame, tree: Sequence[Leaf]) -> DataFrame:
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        key.alias("key"), F.md5(key.cast("binary")).alias("hash"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    keyed = _descend(_descend(keyed, tree, ""), grown(tree), "_grown")
    keyed = keyed.withColumn("cell", F.substring("hash", 1, CELL_DIGITS))
    counted = keyed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    ahead = Scratch(docs.sparkSession, "sharding").keep(counted.select(
        "shard", "cell", F.coalesce(F.sum("n").over(
            Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead")))
    order = Window.partitionBy("shard", "cell").orderBy("hash", "key", "text_crc32", "size")
    return keyed.withColumn("place", F.row_number().over(order)).join(ahead, ["shard", "cell"]).withColumn(
        "slot", F.col("ahead") + F.col("place") - 1)


def shard_plan(docs: DataFrame, tree: Sequence[Leaf] | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: its size, checksum, shard, slot, and the shard it
    would have in the grown tree."""
    return _place(docs.select("doc_id", "text"), tree or even_tree()).select(
        "row.doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
        F.col("shard_grown").alias("grown_shard"), "region", "rack")


def sharded_documents(docs: DataFrame, tree: Sequence[Leaf] | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, followed by ``shard`` and ``slot`` (with as many ``_`` behind as it
    takes to differ from the columns of ``docs``)."""
    names = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        return free(name + "_") if name in names else name

    own = [F.col(c).alias(free(c)) for c in ("shard", "slot")]
    return _place(docs, tree or even_tree()).select("row.*", *own)

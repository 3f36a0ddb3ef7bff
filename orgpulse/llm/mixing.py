"""Operator 5: mixing sources to target weights by systematic sampling (DataFrame functions only).

Sources, in code point order with null last, weigh ``weights`` in turn and share ``share`` times the
sum of all sizes.  A target stops at ``most`` times its source's size; the excess goes to the others
by weight until none is above.  That end state is ``min(cap, level * weight)`` for one level, which
is found directly from prefix sums over the sources sorted by cap / weight.

Every document of a source expects ``target / source size`` copies.  Within its source, documents are
ranked, the expected copies are prefix-summed along the rank, one random offset is added, and a
document is emitted once per integer crossed.  The rank rises through the sizes of one half of the
documents (by hash of the doc_id) and falls through those of the other half: what the offset wins on
the rising side it loses on the falling one, which keeps the words taken near the target.

The prefix sum is a rank times a rate, and the rank comes from counts at four levels (source, band of
64 sizes, size, hash cell), each a window over a bounded number of rows; only rows of one (source,
size, cell) meet in a window, so a source with most rows or many equal copies is spread over tasks.

Size of a document: number of runs of characters outside ``\\x20 \\x09-\\x0D`` (null text: 0).  Edge
cases: a null source is a source of its own; a null doc_id hashes like an empty one; repeated rows are
ranked one after the other; documents of size 0, and sources that only hold such, take 0 words; an
empty table gives an empty result; other columns pass through :func:`mixed_documents` unchanged,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgpulse.llm.scratch import Scratch

#: Hash cells of a (source, size) group: 16 ** CELL_DIGITS.
CELL_DIGITS = 2
BAND = 64
#: Above any size: the falling half comes after the rising one.
_APEX = 1 << 40


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float, seed: str) -> DataFrame:
    """``sizes(no_source, source, total)`` -> with weight, target and offset.  One row per source: the
    windows without a partition hold as many rows as there are sources."""
    by_name = Window.orderBy("no_source", "source")
    everything = Window.partitionBy()
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    weighed = sizes.select(
        "*", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")).alias("weight"),
        (F.col("total") * F.lit(float(most))).alias("cap"),
        (F.sum("total").over(everything) * F.lit(float(share))).alias("whole"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "no_source", "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("whole") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = weighed.withColumn("level", level).withColumn(
        "level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(everything))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col("no_source").cast("string"), F.lit(":"), F.col("source"))), 1, 13), 16, 10)
    return levels.select(
        "no_source", "source", "total", "weight",
        F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"),
        (draw.cast("long") / F.lit(float(16 ** 13))).alias("start"))


def _mix(docs: DataFrame, carried: Sequence[str], weights: Sequence[float], share: float, most: float,
         seed: str) -> DataFrame:
    """Rows with ``row`` (the carried columns as a struct), size, source_size, target, copies."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"),
        "doc_id", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source"),
        word_count(F.col("text")).alias("size"), digest.alias("hash"),
        F.substring(digest, 1, CELL_DIGITS).alias("cell"))
    keyed = keyed.withColumn("step", F.when(F.col("hash") < "8", F.col("size") - _APEX).otherwise(_APEX - F.col("size")))
    scratch = Scratch(docs.sparkSession, "mixing")
    counted = scratch.keep(keyed.groupBy("no_source", "source", "step", "size", "cell").agg(F.count("*").alias("n")))

    def before(keys: list[str], order: str) -> Column:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(w), F.lit(0))

    source, band = ["no_source", "source"], F.floor(F.col("step") / BAND)
    sizes = counted.groupBy(*source, "step", "size").agg(F.sum("n").alias("n")).withColumn("band", band)
    bands = sizes.groupBy(*source, "band").agg(F.sum("n").alias("n"))
    totals = sizes.groupBy(*source).agg(F.sum(F.col("n") * F.col("size")).alias("total"))
    plan = targets(totals, weights, share, most, seed)
    bands = bands.select(*source, "band", before(source, "band").alias("band_before")).join(plan, source)
    sizes = sizes.select(*source, "band", "step", before([*source, "band"], "step").alias("size_before")).join(
        bands, [*source, "band"]).drop("band")
    cells = scratch.keep(counted.select(*source, "step", "cell", before([*source, "step"], "cell").alias("cell_before")).join(
        sizes, [*source, "step"]).select(
        *source, "step", "cell", (F.col("band_before") + F.col("size_before") + F.col("cell_before")).alias("ahead"),
        F.col("total").alias("source_size"), "target", "start"))
    place = F.row_number().over(Window.partitionBy(*source, "step", "cell").orderBy("hash", "doc_id"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.col("ahead") + F.col("place")
    return keyed.withColumn("place", place).join(cells, [*source, "step", "cell"]).select(
        "row", "size", "source_size", "target",
        (F.floor(rate * rank + F.col("start")) - F.floor(rate * (rank - 1) + F.col("start"))).alias("copies"))


def mix_plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
             seed: str = "mix") -> DataFrame:
    """One row per row of ``docs(doc_id, source, text)``: doc_id, size, source_size, target, copies, taken."""
    return _mix(docs, ["doc_id"], weights, share, most, seed).select(
        "row.doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
                    seed: str = "mix") -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as it is emitted."""
    return _mix(docs, docs.columns, weights, share, most, seed).where("copies > 0").select(
        "row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")

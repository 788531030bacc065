"""Mixing sources to target weights along a time-varying curriculum.

Plain DataFrame expressions throughout. A source has a weight schedule over training
time 0 to 1, linear between knots. Its integral is the source's weight; weights share
the budget, and no source gets more than ``repeat`` times its size (the excess is shared
again by weight until all fit). Documents of a source stand in a fixed pseudo-random
order; whole passes over the source and a last part of one make up its target. The
words that came before an occurrence, as a share of all that are taken of its kind, give
its training position: the time at which the schedule has asked for that share.

Defined cases: null text has size 0; a null source is a source, last in order; empty and
zero-word documents have size 0 and go with the passes that reach them; ties in the
order are broken by id and size; where all documents of a kind have size 0, their place
in the order stands for the share of words before them; repeated rows are documents of
their own; very long texts are counted whole; an empty table gives an empty result;
:func:`mixed_corpus` keeps other columns whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import materialize

#: Budget as a share of all sizes; most passes over a source.
BUDGET, REPEAT = 1.5, 2
#: Schedules dealt to the sources in order: (time, weight) knots with integrals 3, 1 and 2.
SCHEDULES = (((0.0, 4.5), (1.0, 1.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 2.0), (1.0, 2.0)))
#: Kinds of documents by size: over 1/20 of their source, over 1/100, over 1/400, the rest.
FINE = (20, 100, 400)
_ADDED = ("source_size", "target", "taken", "copies", "positions")


def word_count(text_col: str = "text") -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), 1)).cast("long")


def _segments(knots: tuple) -> Column:
    """Each stretch between knots: start, length, weight at the start, slope, integral before it."""
    rows, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        rows.append(F.struct(*[F.lit(float(v)).alias(n) for n, v in (("t0", t0), ("dt", t1 - t0), ("w0", w0), ("slope", (w1 - w0) / (t1 - t0)), ("before", before))]))
        before += (w0 + w1) / 2 * (t1 - t0)
    return F.array(*rows)


def integral(segments: str | Column) -> Column:
    return F.aggregate(segments, F.lit(0.0), lambda a, s: a + (s["w0"] + s["slope"] * s["dt"] / 2) * s["dt"])


def inverse(segments: Column, demand: Column) -> Column:
    """The time at which the integral of the schedule reaches ``demand``."""
    stretch = F.element_at(F.filter(segments, lambda s: s["before"] <= demand), -1)
    rest = demand - stretch["before"]
    root = F.sqrt(F.greatest(F.lit(0.0), stretch["w0"] * stretch["w0"] + 2 * stretch["slope"] * rest))
    step = F.when(rest <= 0, F.lit(0.0)).otherwise(2 * rest / (stretch["w0"] + root))
    return stretch["t0"] + F.least(step, stretch["dt"])


def source_targets(sizes: DataFrame, schedules: tuple = SCHEDULES, budget: float = BUDGET, repeat: int = REPEAT) -> DataFrame:
    """``(source, source_size, target, segments)`` of each source of ``sizes (source, size)``.

    Reads one row a source after a map-side sum. With sources in the order of the share
    at which they fill up, the level of the rest is one running sum; the first source
    that the level does not fill fixes it.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = total.withColumn("nth", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    dealt = F.element_at(F.array(*[_segments(k) for k in schedules]), (F.col("nth") % len(schedules) + 1).cast("int"))
    placed = placed.withColumn("segments", dealt).withColumn("weight", integral(F.col("segments"))).withColumn("cap", (repeat * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    everything = Window.partitionBy()
    filled = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (budget * F.sum("source_size").over(everything) - filled) / open_weight
    levelled = placed.withColumn("level", level).withColumn("rank", F.row_number().over(order))
    first = F.min_by("level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("rank")))
    return levelled.withColumn("least", first.over(everything)).select(
        "source", "source_size", F.coalesce(F.least(F.col("least") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"), "segments"
    )


def mix(rows: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", schedules: tuple = SCHEDULES, budget: float = BUDGET, repeat: int = REPEAT) -> DataFrame:
    """``rows`` with ``source_size``, ``target``, ``taken``, ``copies`` and ``positions``.

    ``rows`` is read several times, so it should be a stored table. The order within a
    source is by MD5 of the id. Its first 12 bits deal a source, the hot one too, over
    4,096 stretches: sums of the stretches give where each begins, and only a stretch is
    sorted in one task. Every document is taken in whole passes over its source. Of the
    part of a pass that is left, each kind of documents, from the largest to the smallest,
    takes its share of what is still missing, so only a small document's size is off.
    """
    source, size = F.col(source_col), F.col(size_col)
    targets = source_targets(rows.select(source.alias("source"), size.alias("size")), schedules, budget, repeat).withColumnRenamed("source", "_of")
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))

    def kinds(df: DataFrame) -> DataFrame:
        """With the source's figures, the place in its order, and the kind: 0 for the largest documents."""
        out = df.join(targets, source.eqNullSafe(F.col("_of"))).drop("_of")
        kind = F.size(F.filter(F.array(*map(F.lit, FINE)), lambda n: size * n <= F.col("source_size")))
        return out.withColumn("_key", key).withColumn("_stretch", F.substring("_key", 1, 3)).withColumn("_kind", kind)

    light = kinds(rows.select(id_col, source_col, size_col))
    sums = light.groupBy(source_col, "_kind", "_stretch").agg(F.sum(size_col).alias("_sum"))
    whole = Window.partitionBy(source_col, "_kind")
    ahead = whole.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    smaller = Window.partitionBy(source_col).orderBy("_kind").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    begins = sums.select(
        source.alias("_s"), F.col("_kind").alias("_k"), F.col("_stretch").alias("_p"),
        F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_begin"), F.sum("_sum").over(whole).alias("_mass"), F.sum("_sum").over(smaller).alias("_rest"),
    )
    begins = materialize(begins, "begins")
    inside = Window.partitionBy(source_col, "_kind", "_stretch").orderBy("_key", id_col, size_col).rowsBetween(Window.unboundedPreceding, -1)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    middle = F.col("_before") + size / 2

    def placed(df: DataFrame, gone: DataFrame | None) -> DataFrame:
        """With the words before each document of its kind and the share that its kind is to take."""
        out = df.withColumn("_inside", F.coalesce(F.sum(size_col).over(inside), F.lit(0)))
        out = out.join(begins, source.eqNullSafe(F.col("_s")) & (F.col("_kind") == F.col("_k")) & (F.col("_stretch") == F.col("_p"))).drop("_s", "_k", "_p")
        if gone is None:
            out = out.withColumn("_gone", F.lit(0).cast("long"))
        else:
            out = out.join(gone, source.eqNullSafe(F.col("_s")) & (F.col("_kind") == F.col("_k")), "left").drop("_s", "_k")
        left = F.col("target") - F.col("_passes") * F.col("source_size") - F.coalesce("_gone", F.lit(0))
        out = out.withColumn("_before", F.col("_begin") + F.col("_inside")).withColumn("_passes", passes)
        return out.withColumn("_share", left * F.col("_mass") / F.greatest("_rest", F.lit(1)))

    gone = None  # (source, kind): words that larger kinds took; a row a source and kind
    for k in range(len(FINE)):
        took = placed(light.where(F.col("_kind") == k), gone).where(middle < F.col("_share")).groupBy(source.alias("_s")).agg(F.sum(size_col).alias("_gone"))
        later = took.select("_s", F.explode(F.array(*map(F.lit, range(k + 1, len(FINE) + 1)))).alias("_k"), "_gone")
        gone = materialize((later if gone is None else gone.union(later)).groupBy("_s", "_k").agg(F.sum("_gone").alias("_gone")), "gone")
    full = placed(kinds(rows), gone)
    full = full.withColumn("copies", (F.col("_passes") + (middle < F.col("_share")).cast("long")).cast("int"))
    demand = F.col("_passes") * F.col("_mass") + F.least(F.greatest("_share", F.lit(0.0)), F.col("_mass"))
    shown = F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / (1 << 32)  # of documents without words

    def at(j: Column) -> Column:
        return F.coalesce(F.try_divide(j * F.col("_mass") + middle, demand), shown) * integral(F.col("segments"))

    turns = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda j: inverse(F.col("segments"), at(j))))
    taken = (F.col("copies") * size).cast("long")
    return full.withColumn("taken", taken).withColumn("positions", F.coalesce(turns, F.expr("array()").cast("array<double>"))).select(*rows.columns, *_ADDED)


def in_training_order(mixed: DataFrame) -> DataFrame:
    """A row for each occurrence, with its ``position``, range-sorted by it."""
    each = mixed.withColumn("position", F.explode("positions"))
    return each.repartitionByRange("position").sortWithinPartitions("position")


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id, source, size)`` of every row under their own names, stored in the shared folder."""
    return materialize(df.select(id_col, source_col, word_count(text_col).alias("size")), "sized")


def mixed_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``df`` as the mix takes them, repeats included, in training order."""
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), F.monotonically_increasing_id().alias("number"))
    stored = materialize(rows, "sized")  # numbers are fixed once stored
    plan = mix(stored.select("id", "source", "size", "number"), "id", "source").where("copies > 0").select("number", "positions")
    return in_training_order(stored.select("number", "row").join(plan, "number")).select("row.*")

"""Mixing sources to target sizes by entropy balancing, with DataFrame operations only.

Every document gets a rate, how often the mix takes it, as close to 1 as the
targets allow in the sense of relative entropy, and at most ``most``. The dual of
that problem has one multiplier for each source: a document of ``size`` words has
the rate ``min(most, exp(multiplier * size))``. Newton's method finds the
multipliers; gradient and curvature of all sources are one aggregate over the
number of documents of each source and size. Rates are whole numbers of
``1 / UNIT``, and sums are exact, so that reruns agree whatever order rows come in.

Rates become copies by running sums over the documents of a source in order of
their size: a document gets the copies by which the rounded sum grows. The error
in words is then below the largest size of the source. Some single copies, of
documents about as large as what is left of the error, are added or taken away.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phrasemill.llm.common import attach
from phrasemill.operators.slices import global_rank, in_parts
from phrasemill.session import written

WORD = r"[^\x20\x09-\x0D]+"
#: Rates are whole multiples of 1 / UNIT.
UNIT = 1 << 24
#: Newton's method ends when no source is off its target by more than this share, or after so many steps.
CLOSE = 1e-7
STEPS = 100
#: Rounds of single copies that bring the rounded sums nearer to the targets.
REPAIRS = 3


def words(column: str) -> F.Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(column).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def weighed_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: ``share`` of all sizes, split by weight.

    The weights repeat along the sources in code point order, null last. No
    target is above ``most`` times its source's size; what is above is shared
    by weight among the others until none is.
    """
    if share > most:
        raise ValueError("the sources cannot give so many words")
    number = global_rank(sizes, F.col("source").asc_nulls_last(), name="number")
    held = written(number.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.col("number") % len(weights)).cast("int"))),
                   "weights")
    most_of = F.col("source_size") * most
    row = held.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total = share * (row.size or 0)
    level, full = total / (row.weight or 1), -1
    while True:  # the level only rises, so sources that are full stay full
        above = most_of <= F.col("weight") * level
        got = held.agg(F.count_if(above).alias("n"), F.coalesce(F.sum(F.when(above, most_of)), F.lit(0)).alias("used"),
                       F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("weight")).first()
        if got.n == full or not got.weight:
            break
        full, level = got.n, (total - got.used) / got.weight
    return held.withColumn("target", F.least(most_of.cast("double"), F.col("weight") * F.lit(float(level)))).select(
        "source", "source_size", "target")


def _units(multiplier: F.Column, size: F.Column, scale: F.Column, most: int) -> F.Column:
    """The rate of a document in whole units; a source without a multiplier is taken as often as allowed."""
    tilt = multiplier * size / scale
    return F.when(multiplier.isNull() | (tilt >= math.log(most)), F.lit(most * UNIT)).otherwise(
        F.round(F.exp(tilt) * UNIT)).cast("long")


def _balanced(histogram: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """``targets`` with the multiplier of each source, in units of ``scale``; null where every document is taken ``most`` times.

    ``histogram``: (source key ``of``, size, n). ``targets``: (of, source_size, target, scale).
    """
    exact = lambda c: F.sum(c.cast("decimal(38, 0)"))
    units = _units(F.col("multiplier"), F.col("size"), F.col("scale"), most)
    inner = F.col("multiplier") * F.col("size") / F.col("scale") < math.log(most)
    by_size = F.col("n").cast("decimal(18, 0)") * F.col("size")
    start = F.log(F.col("target") / F.col("source_size"))
    reach = F.col("target") < F.col("source_size") * most
    state = written(targets.select(
        "of", "source_size", "target", "scale", F.when((F.col("target") > 0) & reach, start).alias("multiplier"),
        F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
        ((F.col("target") > 0) & reach).alias("open")), "state")
    columns = state.columns
    for _ in range(STEPS):
        if state.filter("open").isEmpty():
            break
        sums = (histogram.join(state.filter("open").select("of", "multiplier", "scale"), "of").groupBy("of").agg(
            exact(by_size * units).alias("words"), exact(F.when(inner, by_size * F.col("size") * units)).alias("slope")))
        taken = F.col("words").cast("double") / UNIT
        slope = F.col("slope").cast("double") / UNIT / F.col("scale")
        over = taken > F.col("target")
        low = F.when(over, F.col("low")).otherwise(F.col("multiplier"))
        high = F.when(over, F.col("multiplier")).otherwise(F.col("high"))
        newton = F.col("multiplier") - F.try_divide(taken - F.col("target"), slope)
        inside = (newton > F.coalesce(low, F.lit(-math.inf))) & (newton < F.coalesce(high, F.lit(math.inf)))
        wide = F.when(over, F.col("multiplier") - 1 - F.abs("multiplier")).otherwise(F.col("multiplier") + 1 + F.abs("multiplier"))
        following = F.when(inside, newton).otherwise(F.coalesce((low + high) / 2, wide))
        near = F.abs(taken - F.col("target")) <= F.col("target") * CLOSE
        moved = state.join(sums, "of", "left").withColumns({"near": near | F.col("words").isNull(), "next": following})
        state = written(moved.select(
            "of", "source_size", "target", "scale", F.when(F.col("near"), F.col("multiplier")).otherwise(F.col("next")).alias("multiplier"),
            low.alias("low"), high.alias("high"), (F.col("open") & ~F.col("near")).alias("open")).select(*columns), "state")
    return state.drop("low", "high", "open")


def _copied(docs: DataFrame, most: int) -> DataFrame:
    """``docs`` (of, size, id, mark, units, target) with ``copies``; the words of a source come near its target."""
    cut = in_parts(docs, "of", "size", "id", "mark")
    part = ["of", "_part"]
    before = (cut.groupBy(*part).agg(F.sum("units").alias("_sum")).select(*part, (
        F.sum("_sum").over(Window.partitionBy("of").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
        - F.col("_sum")).alias("_before")))
    upto = F.sum("units").over(Window.partitionBy(*part).orderBy("_no").rowsBetween(Window.unboundedPreceding, 0))
    whole = lambda c: F.expr(f"({c} + {UNIT // 2}) div {UNIT}")
    held = written(cut.withColumn("_upto", upto).join(before, part).withColumn("_upto", F.col("_upto") + F.col("_before"))
                   .withColumn("copies", (whole("_upto") - whole("_upto - units")).cast("int")).drop("_upto", "_before"), "copies")
    place, total = ["of", "_part", "_no"], held.count()
    gaps = written(held.groupBy("of").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"),
                                          F.count("*").alias("docs")), "gaps")
    changes = written(held.limit(0).select(*place, F.lit(0).alias("change")), "changes")
    up, off = F.col("gap") > 0, F.abs(F.abs("gap") - F.col("size"))
    can = F.when(up, F.col("copies") < most).otherwise(F.col("copies") > 0) & (off < F.abs("gap"))
    for _ in range(REPAIRS):
        rest = attach(held.join(changes, place, "left_anti"), gaps, "of", "docs", total).filter(can)
        best = rest.groupBy("of").agg(F.min(F.struct(off.alias("off"), "size", "id", "mark", "_part", "_no")).alias("best"))
        change = written(best.join(gaps, "of").select(
            "of", "best._part", "best._no", F.when(up, 1).otherwise(-1).alias("change"), "best.size"), "change")
        gaps = written(gaps.join(change, "of", "left").select(
            "of", (F.col("gap") - F.coalesce(F.col("change") * F.col("size"), F.lit(0))).alias("gap"), "docs"), "gaps")
        changes = written(changes.unionByName(change.select(*place, "change")), "changes")
    return held.join(changes, place, "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0)))


def mix_to(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
           most: int = 2) -> DataFrame:
    """(key, size, source_size, target, taken, rate, copies) of every document, for targets (source, target) in words.

    ``taken`` is ``copies`` times ``size``; no document is taken more than
    ``most`` times. A target beyond that is met as far as it goes; a source
    without a target is not taken. A null source is a source. Null and empty
    texts have no words. Repeated rows are documents of their own; rows that
    agree in key, text and source are interchangeable. Only those columns are
    read; an empty table gives no rows.
    """
    sized = _sized(docs, key, text, source)
    return _mixed(sized, _sizes(sized), targets, key, most)


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, key: str = "doc_id",
        text: str = "text", source: str = "source") -> DataFrame:
    """As ``mix_to``, with the targets of ``weighed_targets`` for the sources that there are."""
    sized = _sized(docs, key, text, source)
    sizes = _sizes(sized)
    targets = weighed_targets(sizes.select("source", "source_size"), weights, share, most)
    return _mixed(sized, sizes, targets.select("source", "target"), key, most)


def _of(source: str) -> F.Column:
    """A key that is never null and differs for all sources."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def _sized(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    named = docs.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), words(text).alias("size"),
                        F.xxhash64(F.col(text).cast("string")).alias("mark"))
    return written(named, "sized")


def _sizes(sized: DataFrame) -> DataFrame:
    """(source, source_size, docs, scale): words and documents of each source, and the mean size that a word meets."""
    counts = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    square = F.sum(F.col("n").cast("decimal(18, 0)") * F.col("size") * F.col("size")).cast("double")
    sums = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"), square.alias("square"))
    return written(sums.select("source", "source_size", "docs", F.greatest(
        F.coalesce(F.try_divide("square", F.col("source_size").cast("double")), F.lit(1.0)), F.lit(1.0)).alias("scale")), "sizes")


def _mixed(sized: DataFrame, sizes: DataFrame, targets: DataFrame, key: str, most: int) -> DataFrame:
    wanted = (sizes.withColumn("of", _of("source"))
              .join(targets.select(_of("source").alias("of"), "target"), "of", "left")
              .select("of", "docs", "source_size", "scale", F.when(F.col("target").isNull(), 0.0).otherwise(
                  F.least(F.col("target"), F.col("source_size").cast("double") * most)).alias("target")))
    wanted = written(wanted, "wanted")
    keyed = sized.withColumn("of", _of("source")).drop("source")
    histogram = written(keyed.groupBy("of", "size").agg(F.count("*").alias("n")), "histogram")
    balanced = written(_balanced(histogram, wanted, most).join(wanted.select("of", "docs"), "of"), "balanced")
    # A source may hold most documents.
    joined = attach(keyed, balanced, "of", "docs", keyed.count())
    units = F.when(F.col("target") > 0, _units(F.col("multiplier"), F.col("size"), F.col("scale"), most)).otherwise(0)
    out = _copied(joined.select("of", "size", "id", "mark", "source_size", "target", units.cast("long").alias("units")), most)
    return out.select(F.col("id").alias(key), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                      (F.col("units") / UNIT).alias("rate"), "copies")

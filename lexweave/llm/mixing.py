"""Mixing sources to target weights by hash-threshold histograms.

A source's target is met by taking every document floor(target / size) times and once more those documents whose hash
is at most a threshold. The threshold comes from histograms: words are summed by source and hash bucket, the bucket
where the budget ends is found, and only that bucket is summed again by the next bits, until single hash values are
left. Nothing is sorted or collected but histograms, whose size does not grow with the corpus; the last filter is a
comparison. A hot source is summed map-side first, so it is no hot task.

Thresholds are nested: a larger budget takes a superset. The hash comes from doc_id alone, so reruns agree.

Tables with a row a source are joined without a broadcast hint: Spark broadcasts them while their files are below its
threshold and merges beyond it. Their windows (order of sources, water level) hold a row a source in one task.

Defined cases: a null or empty text has size 0 and is taken 0 words of; a source without words has target 0 and its
rows are not taken; a null source is a source of its own, last in order; rows that repeat a doc_id share its hash and
are taken or left together, so a budget can be missed by all of their words; a very long text counts with all its words
and is taken whole or not; an empty table gives an empty mix; other columns are carried along, whatever their names.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

SHARE, MOST = 1.5, 2.0
WEIGHTS = (5, 2, 1)
#: Bits of the 60-bit hash that each histogram resolves.
LEVEL_BITS = (12, 12, 12, 24)
HASH_BITS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def doc_hash(doc_id: Column) -> Column:
    """60 bits of the md5 of the id as decimal text."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("/mix"))), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): share of all words by weight, none above most times its size.

    With ceilings c = most * size and ratio c / weight ascending, the first k sources stand at their ceilings and the
    others at weight * (budget - their ceilings) / (other weights), for the least k at which none is above: the fixed
    point of resharing the excess. That level only falls as k grows, so the least k has the largest of the levels at
    which none is above. One row a source, so the windows hold the list of sources and no documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    picks = F.array(*map(F.lit, weights))
    s = sources.withColumn("weight", F.element_at(picks, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("ceiling", most * F.col("source_size")).withColumn("ratio", F.col("ceiling") / F.col("weight"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("capped", F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))).withColumn("used", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", (share * F.sum("source_size").over(everything) - F.col("capped")) / (F.sum("weight").over(everything) - F.col("used")))
    s = s.withColumn("water", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    return s.select("source", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least("ceiling", F.col("weight") * F.coalesce("water", "ratio"))).alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, threshold): documents with hash <= threshold come nearest to goals' extra words.

    A budget that ends inside one hash value takes it if that comes nearer; a tie leaves it.
    """
    found = goals.select("source", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("below"), "extra")
    shift = HASH_BITS
    for bits in LEVEL_BITS:
        shift -= bits
        step = 1 << shift
        s, f = sized.alias("s"), found.alias("f")
        inside = F.shiftright("s.hash", shift + bits) == F.shiftright("f.prefix", shift + bits)
        bars = (
            s.join(f, F.col("s.source").eqNullSafe(F.col("f.source")) & inside)
            .groupBy(F.col("f.source").alias("source"), (F.shiftright("s.hash", shift) * step).alias("bar"))
            .agg(F.sum("s.size").alias("words"), F.first("f.below").alias("base"), F.first("f.extra").alias("extra"))
        )
        w = Window.partitionBy("source").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
        bars = bars.withColumn("upto", F.col("base") + F.sum("words").over(w))
        # the first bar whose end passes the budget holds its boundary
        hit = bars.where(F.col("upto") > F.col("extra")).groupBy("source").agg(F.min_by(F.struct("bar", F.col("upto").alias("end"), "words", "extra"), "bar").alias("b"))
        found = hit.select("source", F.col("b.bar").alias("prefix"), (F.col("b.end") - F.col("b.words")).alias("below"), F.col("b.extra").alias("extra"), F.col("b.words").alias("words"))
    nearer = (F.col("below") + F.col("words") - F.col("extra")) < (F.col("extra") - F.col("below"))
    return found.select("source", F.when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("threshold"))


def _plan(docs: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, hash) of each row, and (source, source_size, target, base, threshold) of each source."""
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), doc_hash(F.col("doc_id")).alias("hash")), "sizes")
    sources = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights), "targets")
    base = F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0))
    goals = sources.where("source_size > 0").select("source", (F.col("target") - base * F.col("source_size")).alias("extra")).where("extra > 0")
    cuts = thresholds(sized, goals)
    known = sources.withColumn("base", base).alias("t").join(cuts.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left").select("t.*", "c.threshold")
    return sized, written(known, "mix-plan")


def _copies(hashed: Column) -> Column:
    return (F.col("k.base") + F.when(hashed <= F.col("k.threshold"), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of each row."""
    sized, known = _plan(docs, share, most, weights)
    d, k = sized.alias("d"), known.alias("k")
    rows = d.join(k, F.col("d.source").eqNullSafe(F.col("k.source"))).withColumn("copies", _copies(F.col("d.hash")))
    return rows.select("d.doc_id", "d.source", "d.size", "k.source_size", "k.target", "copies", (F.col("d.size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """docs' rows, each as often as the mix takes it."""
    d, k = docs.alias("d"), _plan(docs, share, most, weights)[1].alias("k")
    copies = _copies(doc_hash(F.col("d.doc_id")))
    rows = d.join(k, F.col("d.source").eqNullSafe(F.col("k.source"))).where(copies > 0)
    turn = "copy_" + uuid4().hex
    return rows.select("d.*", F.explode(F.array_repeat(F.lit(0), copies)).alias(turn)).drop(turn)

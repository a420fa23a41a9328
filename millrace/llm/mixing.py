"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

A source's target is met by whole epochs first; what is left of it goes to documents in the order of
exponential keys, -ln(u) / weight, where u is drawn from the id and the weight is the document's
quality. Prefix sums of sizes along that order fill the budget exactly; the document at its edge is
taken in part.

A source is sorted slice by slice. A slice is a range of the key's logarithm: whatever the weights, the density of
the logarithm of an exponential variable is at most 1/e, so that a slice holds ln(2) / e / PER_OCTAVE of a
source's keys at most (a 16,000th). More can only be rows with equal ids: a slice that holds over CROWDED rows, and over
a CROWDS-th of the table, is split further by the key and then by a hash of id and text.

Cases: a null text has size 0 and takes nothing; null is a source, ordered last; sources of size 0
have target 0; a null id draws like the empty text; rows with equal ids share a key and are filled one after
the other, in the order of a hash of their texts; which of rows alike in id and text comes first is left
open; very long texts are counted in one pass; an empty table gives no rows; other columns of the input play no part.
The sources themselves are ordered in one task: some millions of them at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import WORD, cut, table, unit

#: Weights of the sources in their order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix over words of the input, and the most epochs of a source.
SHARE, EPOCHS = 1.5, 2
#: Slices of a source for each doubling of the key.
PER_OCTAVE = 4096
#: Slices of more rows than this, and of more than one in CROWDS of all rows (so at most CROWDS of them), are split further.
CROWDED, CROWDS = 20_000, 10_000


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) to (source, source_size, target): one row a source.

    A level is found such that sources get weight times level, or their cap where that is less:
    sources are taken by cap over weight, and the first that stays under its cap fixes the level.
    """
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((order - 1) % len(WEIGHTS) + 1).cast("int"))
    s = sizes.select("source", "source_size", weight.alias("w")).withColumn("cap", (F.col("source_size") * EPOCHS).cast("double"))
    by = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = by.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    left = F.lit(SHARE) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    s = s.select("*", (left / rest).alias("level"))
    first = F.min_by("level", F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("cap") / F.col("w"))).over(whole)
    return s.select("source", "source_size", F.least("cap", F.col("w") * first).alias("target"))


def quality_weight(text: Column, size: Column) -> Column:
    """1 for plain text, less with every symbol a word."""
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))
    return F.when(size > 0, F.lit(1.0) / (1 + symbols / size)).otherwise(F.lit(1.0))


def split(rows: DataFrame, per_slice: DataFrame, per_octave: int, crowded: int) -> DataFrame:
    """Rows with ``fine`` and ``part``, which are 0 but in crowded slices."""
    most = max(crowded, (per_slice.agg(F.sum("m")).first()[0] or 0) // CROWDS)
    many = per_slice.filter(F.col("m") > most).select(F.col("source").alias("s0"), F.col("slice").alias("l0"))
    rows = rows.join(F.broadcast(many), F.col("source").eqNullSafe(F.col("s0")) & (F.col("slice") == F.col("l0")), "left")
    deep = F.col("l0").isNotNull()
    return rows.withColumns({"fine": F.when(deep, F.floor((F.log2("key") * per_octave - F.col("slice")) * (1 << 20))).otherwise(0), "part": F.when(deep, F.shiftright("twin", 52)).otherwise(0)}).drop("s0", "l0")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", per_octave: int = PER_OCTAVE, crowded: int = CROWDED) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, epochs and taken (words, repeats counted)."""
    text = F.col(text_col)
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.col(text_col).alias("t"))
    key = -F.log(unit(F.col("id"), seed)) / quality_weight(F.col("t"), F.col("size"))
    twin = F.xxhash64("id", F.coalesce("t", F.lit("")))
    rows = rows.select("id", "source", "size", key.alias("key"), twin.alias("twin"))
    # Texts are read once; what follows has some forty bytes a row.
    rows = cut(rows.withColumn("slice", F.floor(F.log2("key") * per_octave).cast("int")))
    per_slice = cut(rows.groupBy("source", "slice").agg(F.sum("size").alias("n"), F.count("*").alias("m")))
    goal = targets(per_slice.groupBy("source").agg(F.sum("n").alias("source_size")))
    rows = split(rows, per_slice, per_octave, crowded)
    at = ["slice", "fine", "part"]
    parts = rows.groupBy("source", *at).agg(F.sum("size").alias("n"))
    # Sums in two levels: no task has more than the parts of one doubling of one source's keys.
    parts = parts.withColumn("octave", F.floor(F.col("slice") / per_octave))
    earlier = W.partitionBy("source").orderBy("octave").rowsBetween(W.unboundedPreceding, -1)
    octaves = parts.groupBy("source", "octave").agg(F.sum("n").alias("n")).select(F.col("source").alias("s3"), F.col("octave").alias("o3"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    before = W.partitionBy("source", "octave").orderBy(*at).rowsBetween(W.unboundedPreceding, -1)
    starts = parts.join(octaves, F.col("source").eqNullSafe(F.col("s3")) & (F.col("octave") == F.col("o3")))
    starts = starts.select(F.col("source").alias("s1"), *[F.col(c).alias(f"{c}1") for c in at], (F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("start"))
    goal = goal.withColumnRenamed("source", "s2")
    starts = starts.join(goal, F.col("s1").eqNullSafe(F.col("s2"))).drop("s2")
    within = W.partitionBy("source", *at).orderBy("key", "id", "twin").rowsBetween(W.unboundedPreceding, -1)
    same = F.col("source").eqNullSafe(F.col("s1"))
    for c in at:
        same &= F.col(c) == F.col(f"{c}1")
    out = rows.join(starts, same)
    done = F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    out = out.select("id", "source", "size", "source_size", "target", epochs.alias("epochs"), done.alias("done"))
    budget = F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("bigint")
    part = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), budget - F.col("done")))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).cast("bigint").alias("taken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS symbols,
        (CAST(CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM documents),
k AS (SELECT doc_id, source, size, -ln(u) / (CASE WHEN size > 0 THEN 1.0 / (1 + CAST(symbols AS DOUBLE) / size) ELSE 1.0 END) AS key FROM d),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS o FROM k GROUP BY source),
s1 AS (SELECT source, source_size, CAST([3, 1, 2][(o - 1) % 3 + 1] AS DOUBLE) AS w, CAST(source_size * 2 AS DOUBLE) AS cap FROM s0),
s2 AS (SELECT *, (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
       FROM s1 WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT source, source_size, least(cap, w * (SELECT arg_min(level, cap / w) FROM s2 WHERE level <= cap / w)) AS target FROM s2),
p AS (SELECT k.doc_id, k.size, s3.source_size, s3.target, CASE WHEN s3.source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
        coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
      FROM k JOIN s3 ON k.source IS NOT DISTINCT FROM s3.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, CAST(floor(target - epochs * source_size) AS BIGINT) - done)) AS BIGINT) AS taken FROM p
"""

"""From raw documents to token ids: five stages, each one operator of millrace.llm at work.

Every stage takes what the one before it wrote, and returns the columns of ``documents`` (the last one:
token ids). Rows are told apart by id and text together, so repeated ids do no harm; rows alike in both
are one document to the stages that choose among documents. Null texts and empty tables pass through
as each operator defines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from millrace.llm import bpe, langid, mixing, simhash, substrings
from millrace.llm.common import cut


#: The name of the key column while a stage runs.
KEY = "_millrace_row_key"
#: Columns of its working while a stage runs.
RANK = "_millrace_rank"


#: The share of a text's n-grams that its language must explain.
LEAST_SCORE = 0.2
#: Bytes of a repeated string that the suffix-array stage removes: a passage of over 50 words has them if its words
#: take four bytes each, the space included. Half of them are the anchor.
REPEAT, REPEAT_ANCHOR = 200, 100


def _key() -> Column:
    """128 bits of hash as text."""
    text = F.coalesce("text", F.lit(""))
    return F.concat_ws("/", F.xxhash64("doc_id", text), F.xxhash64(F.lit("second"), text, "doc_id"))


def _only(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Keyed documents, once per key KEY; ``rows`` has the keys alone. Nothing moves where no row is repeated.

    Of rows that differ in other columns alone, the first in the order of a hash of all of them, and of the columns, stays."""
    twice = cut(rows.groupBy(KEY).agg(F.count("*").alias("n")).filter("n > 1").select(KEY))
    if not twice.limit(1).collect():
        return docs
    rest = [c for c in docs.columns if c != KEY]
    text = F.concat_ws("\x01", *[F.coalesce(F.concat(F.lit("="), _plain(docs, c).cast("string")), F.lit("-")) for c in rest])
    order = [F.xxhash64(text), F.sha2(text, 256)]
    one = Window.partitionBy(KEY).orderBy(*order)
    held = docs.join(twice, KEY, "left_semi").withColumn(RANK, F.row_number().over(one)).filter(F.col(RANK) == 1).drop(RANK)
    return docs.join(twice, KEY, "left_anti").unionByName(held)


def _plain(docs: DataFrame, name: str) -> Column:
    """A column of any type as something that casts to text."""
    kind, col = docs.schema[name].dataType, F.col(f"`{name}`")
    return col if isinstance(kind, AtomicType) else F.to_json(F.struct(col.alias("c")))


def _own(docs: DataFrame) -> list[Column]:
    """The columns as they are, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents get the language that their text shows as ``lang``, whatever their label said; those without one go:
    null texts, texts without a letter, and texts of which the best language explains less than LEAST_SCORE.

    Where no language could be learned, only the letters decide and labels stay; a label that couldn't be learned
    speaks for its text, and stays too."""
    model = langid.fit(docs)
    learned = model.learned()
    if not learned:
        return langid.lettered(docs)
    rows = docs.select(F.struct(*_own(docs)).alias("row"))
    strange = F.coalesce(~F.col("row.lang").isin(learned), F.lit(False))
    seen = langid.predict(rows, model, "row", "row.text").filter((F.col("lang_pred") != "und") & ((F.col("score") >= LEAST_SCORE) | strange))
    return seen.select("row.*", F.when(strange, F.col("row.lang")).otherwise(F.col("lang_pred")).alias(RANK)).withColumn("lang", F.col(RANK)).drop(RANK)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates stays."""
    keyed = docs.withColumn(KEY, _key())
    rows = cut(simhash.fingerprints(keyed.select(F.struct("doc_id", KEY).alias("id"), "text"), "id"))
    near = simhash.near_duplicates(rows, "id")
    stay = cut(near.filter(F.col("id").eqNullSafe(F.col("component_id"))).select(f"id.{KEY}").distinct())
    return _only(keyed.join(stay, KEY, "left_semi"), rows.select(f"id.{KEY}")).select(_own(docs))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the bytes of long strings that occur elsewhere; every document stays."""
    rest = F.struct(*_own(docs.drop("text", "n_chars")), F.col("text").isNotNull().alias(RANK))
    left = substrings.remove_repeats(docs.select(rest.alias("row"), "text"), "row", "text", length=REPEAT, k=REPEAT_ANCHOR, with_text=True)
    out = left.select("row.*", F.when(F.col(f"row.{RANK}"), F.col("kept")).alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
    return out.select(_own(docs))


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it: its source's epochs, and once more if it is drawn."""
    keyed = docs.withColumn(KEY, _key())
    light = cut(mixing.mix(keyed.select(KEY, "text", "source"), KEY).select(KEY, "epochs", "size", "taken"))
    more = F.when(F.col("taken") > F.col("epochs") * F.col("size"), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.col("epochs") + more).otherwise(0)
    times = light.groupBy(KEY).agg(F.sum(copies).cast("int").alias("times")).filter("times > 0")
    taken = _only(keyed, light.select(KEY)).join(cut(times), KEY)
    return taken.withColumn(RANK, F.explode(F.sequence(F.lit(1), F.col("times")))).select(_own(docs))


def bpe_encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the text decoded from them."""
    return bpe.encode_decode(docs, bpe.production_path(), with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mixing", mixing_to_targets),
    ("bpe", bpe_encode_decode),
]

#: No SQL: fingerprints by XXH64, repeated substrings and byte-pair merges are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs

"""Corpus pipeline: from raw documents to balanced, ordered shards.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns a DataFrame; all but the last return the columns of ``documents``.

1. quality: documents that the attention classifier rejects go.
2. near_duplicates: of each component of the n-gram Jaccard join one row stays, the one
   of the least doc_id (nulls last, ties by a hash of the text).
3. decontaminate: documents that hold a benchmark item within its edit budget go.
4. mix: every source is brought to its target words; a document appears once for each
   copy that the mix takes.
5. shard: the copies are put in Hilbert-curve order and cut into shards.

Decisions are about texts and rows, never about a doc_id alone: rows that share an id, or
have none, are told apart by their texts, and repeated rows are near duplicates of each
other.  Rows without words are nobody's near duplicates and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurofold.llm.common import crc_fold, discard, materialise, noted
from neurofold.llm.decontaminate import contaminated
from neurofold.llm.jaccard import near_duplicates
from neurofold.llm.mix import pivotal_mix
from neurofold.llm.quality import apply, train
from neurofold.llm.shard import hilbert_shards

#: The classifier and the search are trained statistics and distances: no SQL form.
ORACLE_SQL = None
SHARDS = 16


def packed(docs: DataFrame) -> DataFrame:
    """Rows as one struct ``row`` beside fields of fixed names, so that no column of docs clashes with them: doc_id, source and
    text, two hashes of the text (null counts as empty, as in every operator) and one of the whole row."""
    text = F.coalesce("text", F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.select(row.alias("row"), F.col("doc_id").alias("id"), "source", "text", F.xxhash64(text).alias("one"), F.xxhash64(text, F.lit(1), text).alias("two"), F.xxhash64(row).alias("whole"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The column ``row`` as the columns of docs."""
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def by_key(docs: DataFrame) -> DataFrame:
    """A document for each row, that goes by its text's first hash."""
    return packed(docs).select(F.col("one").alias("doc_id"), "text")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the texts whose hashes are the doc_ids of ``gone``."""
    return unpacked(packed(docs).join(gone.select(F.col("doc_id").alias("one")).distinct(), "one", "left_anti"), docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.  It learns from all labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, crc_fold(F.col("doc_id"), 5) != 0)
    return without(docs, apply(model, by_key(docs)).where("predicted = 0"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates; of rows that differ in other columns alone, the least by a hash of all of them."""
    found = near_duplicates(by_key(docs)).select(F.col("doc_id").alias("one"), "n_shingles", "component_id").distinct()
    found = materialise(found, "near-duplicates")
    rows = packed(docs)
    kinds = rows.groupBy("id", "one", "two", "whole").agg(F.count("*").alias("k")).join(found.where("n_shingles > 0"), "one")
    order = F.struct(F.col("id").isNull(), "id", "one", "two", "whole")
    kept = kinds.groupBy("component_id").agg(F.min_by(F.struct("id", "one", "two", "whole", "k"), order).alias("m")).select("m.*", F.lit(False).alias("every"))
    none = lambda c: F.lit(None).cast("bigint").alias(c)
    wordless = found.where("n_shingles = 0").select(none("id"), "one", none("two"), none("whole"), F.lit(1).cast("bigint").alias("k"), F.lit(True).alias("every"))
    kept = materialise(kept.union(wordless), "near-duplicates-kept")
    match = F.col("m.every") | (F.col("r.id").eqNullSafe(F.col("m.id")) & (F.col("r.two") == F.col("m.two")) & (F.col("r.whole") == F.col("m.whole")))
    stay = lambda which: rows.alias("r").join(kept.where(which).alias("m"), F.col("r.one") == F.col("m.one")).where(match)
    out = unpacked(stay("k = 1").select("r.row"), docs)
    # A row that stays may itself be repeated.
    if not kept.where("k > 1").isEmpty():
        out = out.union(unpacked(stay("k > 1").groupBy("m.one").agg(F.first("r.row").alias("row")), docs))
    return out


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, contaminated(by_key(docs), benchmark))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.  A row goes by a hash of all its columns; rows that repeat are taken together."""
    rows = packed(docs)
    mixed = pivotal_mix(rows.select(F.col("whole").alias("doc_id"), "source", "text"))
    taken = mixed.groupBy(F.col("doc_id").alias("whole"), "uid").agg(F.sum("copies").cast("int").alias("times"), F.count("*").alias("n")).where("times > 0")
    taken = materialise(taken, "mix-taken")
    uid = F.xxhash64("whole", "source", "text")
    found = lambda which: rows.withColumn("uid", uid).join(taken.where(which), ["whole", "uid"])
    out = found("n = 1").select("row", "times")
    if not taken.where("n > 1").isEmpty():
        out = out.union(found("n > 1").groupBy("whole", "uid").agg(F.first("row").alias("row"), F.max("times").alias("times")).select("row", "times"))
    return unpacked(out.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))), docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and curve of every copy."""
    return hilbert_shards(docs, SHARDS)


STAGES = [("quality", quality), ("near_duplicates", one_of_each), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's rows are written as Parquet and read again as the next one's.

    What a stage wrote on the way, and the rows that it read, are deleted once its own rows are written.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with noted() as paths:
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(spark, last + paths[:-1])
        last = paths[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)

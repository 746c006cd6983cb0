"""Corpus pipeline: quality filter, near-dedup, substring dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), and works on all rows that the stage before it kept.
All but the last return the columns of documents.

Nulls and repeated rows: as in the operators. A document that loses all its words in a
stage goes; one without words that the quality classifier keeps stays, as one of its
group of equal texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm import common, decontaminate, packing, quality, simhash, substrings

ORACLE_SQL = None


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold go. The classifier learns from labelled documents of the table."""
    model = quality.train(docs, common.sources(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, into="__quality").where(F.col("__quality") >= quality.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts at 0.8 or more of their five-word shingles in common, directly or through others, the first by doc_id stays."""
    rows = common.stored(docs.withColumn("__rid", F.monotonically_increasing_id()))
    groups = simhash.near_duplicates(rows.select(F.col("__rid").alias("rid"), "text"))
    # within a group (rid, root), the smallest doc_id stays instead of the smallest rid
    members = groups.union(groups.select(F.col("root").alias("rid"), "root")).distinct()
    ids = members.join(rows.select(F.col("__rid").alias("rid"), "doc_id"), "rid")
    first = ids.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))["rid"].alias("rid"))
    losers = members.select(F.col("rid").alias("__rid")).join(first.select(F.col("rid").alias("__rid")), "__rid", "left_anti")
    return rows.join(losers, "__rid", "left_anti").select(*docs.columns)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that repeat go from everywhere they stand; texts without any keep their white space."""
    out = substrings.remove_repeats(docs, into="__repeats")
    left = out.where((F.col("__repeats.n_removed") == 0) | (F.col("__repeats.n_removed") < F.col("__repeats.n_words")))
    text = F.when(F.col("__repeats.n_removed") > 0, F.col("__repeats.kept")).otherwise(F.col("text"))
    return _with_text(left, docs, text)


def decontaminate_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go."""
    rows = common.stored(docs.withColumn("__rid", F.monotonically_increasing_id()))
    found = decontaminate.find_contamination(rows, common.sources(spark, sf_dir, "benchmark"), key="__rid")
    hit = found.where("n_hit > 0").select(F.col("rid").alias("__rid"))
    return rows.join(hit, "__rid", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a sequence, with its ids."""
    return packing.pack_documents(docs)


def _with_text(rows: DataFrame, docs: DataFrame, text) -> DataFrame:
    return rows.select(*((text.alias(c) if c == "text" else F.char_length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c)) for c in docs.columns))


STAGES = [
    ("quality classifier", filter_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", remove_repeated_passages),
    ("benchmark decontamination", decontaminate_benchmarks),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read by the next."""
    docs = common.sources(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs)
    return docs

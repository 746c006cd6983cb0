"""Document fingerprints: threshold-scaled sketches, in DataFrame functions only.

The sketch of a text is the set of all 64-bit hashes of its 5-word shingles (in lower
case) under a fixed share of the hash range. Sketches of parts merge by union (``merge``) into the sketch of the
whole, and the share of one sketch that is in another estimates containment, however unequal the documents.
Texts of up to SMALL shingles, of which few hashes or none would be kept, keep all, and are marked as exact; two of
those are compared exactly, and any other two by the hashes under the threshold. Texts of fewer than 5 words are one
shingle; texts of none have the empty sketch.

``with_next`` pairs each document with the one after it, in descending doc_id:
ids alone are sorted by range; the text's only shuffle, by id, serves both to send
the start of each text to its predecessor and to receive it.

Nulls: a null text is empty; a null doc_id comes last. Rows that are equal in id and text
stand at one place and have equal results; other rows of one id are ordered by a hash of
the text. A table of one row is its own next. An empty table gives no rows; other
columns are ignored. Very long texts are whole; their sketches grow with them, by a share of their shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridloom.llm.common import sources, stored

SHINGLE = 5
#: One of so many hashes is kept.
SCALE = 8
#: Shingles up to which all are kept.
SMALL = 64
LEAST = -(1 << 63)


def words(text: Column) -> Column:
    return F.split(F.btrim(F.lower(text), F.lit(" \t\n\x0b\f\r")), "[ \\t-\\r]+")


def under(hashes: Column, scale: int = SCALE) -> Column:
    return F.filter(hashes, lambda x: x < LEAST + (1 << 64) // scale)


def sketch(text: Column, scale: int = SCALE) -> Column:
    """struct(exact, hashes), hashes sorted."""
    w = words(text)
    hashes = F.transform(F.array(w), lambda a: F.transform(F.sequence(F.lit(0), F.greatest(F.size(a) - SHINGLE, F.lit(0))), lambda i: F.xxhash64(*(F.get(a, i + k) for k in range(SHINGLE)))))[0]
    made = lambda exact, h: F.struct(F.lit(exact).alias("exact"), F.array_sort(F.array_distinct(h)).alias("hashes"))
    kept = F.transform(F.array(hashes), lambda h: F.when(F.size(h) <= SMALL, made(True, h)).otherwise(made(False, under(h, scale))))[0]
    return F.when(F.btrim(text, F.lit(" \t\n\x0b\f\r")) == "", made(True, F.array().cast("array<bigint>"))).otherwise(kept)


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of the shingles of both."""
    both = F.array_sort(F.array_union(a["hashes"], b["hashes"]))
    exact = a["exact"] & b["exact"] & (F.size(both) <= SMALL)
    return F.struct(exact.alias("exact"), F.when(exact, both).otherwise(under(both, scale)).alias("hashes"))


def as_text(s: Column) -> Column:
    """= or ~ (exact or not), and 16 hex digits of each hash."""
    return F.concat(F.when(s["exact"], "=").otherwise("~"), F.array_join(F.transform(s["hashes"], lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ""))


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The share of a's shingles that b has, estimated, or exact for two exact sketches; null if a has nothing to tell by."""
    exact = a["exact"] & b["exact"]
    x, y = (F.when(exact, s["hashes"]).otherwise(under(s["hashes"], scale)) for s in (a, b))
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x))


def likeness(a: Column, b: Column) -> Column:
    """Containment of the smaller sketch in the other; 1 for equal ones; 0 if there is nothing to tell by."""
    return F.when(a == b, 1.0).otherwise(F.coalesce(F.greatest(containment(a, b), containment(b, a)), F.lit(0.0)))


def _next_ids(keyed: DataFrame) -> DataFrame:
    """(id, hash, n, nid, nhash): the row after each in descending order, after the last the first."""
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = keyed.groupBy("id", "hash").agg(F.max(F.length("text")).alias("n"))
    slim = stored(slim.repartitionByRange(n, F.desc("id"), F.desc("hash")).withColumn("part", F.spark_partition_id()))
    heads = slim.groupBy("part").agg(F.max(F.struct("id", "hash")).alias("head"))  # a row for each partition
    order = Window.orderBy("part")
    following = heads.select("part", F.coalesce(F.lead("head").over(order), F.first("head").over(order)).alias("follows"))
    within = Window.partitionBy("part").orderBy(F.desc("id"), F.desc("hash"))
    led = slim.withColumn("after", F.lead(F.struct("id", "hash")).over(within)).join(following, "part")
    after = F.coalesce("after", "follows")
    return led.select("id", "hash", "n", after["id"].alias("nid"), after["hash"].alias("nhash"))


def with_next(docs: DataFrame) -> DataFrame:
    """(id, text, sketch, n, start, next_sketch): start: the first floor(n / 3) code points of the next text; id: doc_id, LEAST for null."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    rows = keyed.withColumn("sketch", sketch(F.col("text"))).select("id", "hash", "text", "sketch")
    wants = _next_ids(keyed).select(F.col("nid").alias("id"), F.col("nhash").alias("hash"), F.col("id").alias("pid"), F.col("hash").alias("phash"), "n")
    sent = rows.join(wants, ["id", "hash"]).select(F.col("pid").alias("id"), F.col("phash").alias("hash"), "n", F.substring(F.col("text"), F.lit(1), F.floor(F.col("n") / 3).cast("int")).alias("start"), F.col("sketch").alias("next_sketch"))
    sent = sent.groupBy("id", "hash").agg(*(F.first(c).alias(c) for c in ("n", "start", "next_sketch")))
    return rows.join(sent, ["id", "hash"]).select("id", "text", "sketch", "n", "start", "next_sketch")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(sources(spark, sf_dir, "documents"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n") - F.floor(F.col("n") / 3)).cast("int")), F.col("start"))
    rows = rows.select("id", "n", "sketch", "next_sketch", edited.alias("edited")).withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        F.nullif("id", F.lit(LEAST)).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )

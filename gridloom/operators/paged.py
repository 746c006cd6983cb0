"""Block-paged ragged sequences: page tables, gathering, and sharing of equal pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridloom.operators.prefix import exclusive_sum
from gridloom.operators.quantize import affine


def page_table(tokens: DataFrame, page: int) -> DataFrame:
    """(seq, n_tokens, pages, seq_ptr) from rows (seq, t)."""
    sizes = tokens.groupBy("seq").agg(F.count("*").alias("n_tokens")).withColumn("pages", F.ceil(F.col("n_tokens") / page).cast("long"))
    return exclusive_sum(sizes, "seq", "pages", "seq_ptr")


def pages_of(tokens: DataFrame, page: int) -> DataFrame:
    """(seq, p, content): pages with a digest of what they hold, in order."""
    rows = tokens.withColumn("p", F.call_function("div", F.col("t"), F.lit(page)))
    listed = F.array_sort(F.collect_list(F.struct("t", "x")))  # a page at most
    slots = F.transform(listed, lambda r: F.concat_ws(":", (r["t"] % page).cast("string"), r["x"]))
    return rows.groupBy("seq", "p").agg(F.sha2(F.array_join(slots, "|"), 256).alias("content"))


def shared(pages: DataFrame) -> DataFrame:
    """(seq, p, seq_first, p_first): each page with the first page of equal content, which alone is stored."""
    first = pages.groupBy("content").agg(F.min(F.struct("seq", "p")).alias("f"))
    return pages.join(first, "content").select("seq", "p", F.col("f.seq").alias("seq_first"), F.col("f.p").alias("p_first"))


def gather(wanted: DataFrame, table: DataFrame, block_table: DataFrame, page: int) -> DataFrame:
    """wanted (seq, t) to physical slots: two equi-joins; undefined slots after the last token have none."""
    rows = wanted.join(table, "seq").where(F.col("t") < F.col("n_tokens"))
    rows = rows.withColumn("logical", F.col("seq_ptr") + F.call_function("div", F.col("t"), F.lit(page)))
    return rows.join(block_table, "logical").withColumn("slot", F.col("physical") * page + F.col("t") % page)


def numbered(pages: DataFrame, table: DataFrame) -> DataFrame:
    """Block table (logical, physical) where every page has its own place."""
    return pages.join(table, "seq").select((F.col("seq_ptr") + F.col("p")).alias("logical"), (F.col("seq_ptr") + F.col("p")).alias("physical"))


def element_offset(gathered: DataFrame, heads: int, dim: int) -> DataFrame:
    """Gathered rows (slot, h, d) with flat, their place in the page pool; a head or dimension out of bounds is an error."""
    wrong = (F.col("h") < 0) | (F.col("h") >= heads) | (F.col("d") < 0) | (F.col("d") >= dim)
    flat = (F.col("slot") * heads + F.col("h")) * dim + F.col("d")
    return gathered.withColumn("flat", F.when(wrong, F.raise_error(F.lit("head or dimension out of bounds")).cast("long")).otherwise(flat))


def dequantize(gathered: DataFrame, scales: DataFrame) -> DataFrame:
    """Gathered rows (slot, q) with x, by the (scale, zero) of their physical slot, so that a shared page has one set of them: one equi-join. A null zero is 0."""
    return gathered.join(scales, "slot", "left").withColumn("x", affine(F.col("scale"), F.col("q"), F.coalesce(F.col("zero"), F.lit(0)))).drop("scale", "zero")


def faults(seq_ptr: DataFrame, block_table: DataFrame, pages: int) -> DataFrame:
    """(fault, n) of pointers (k, ptr) and a block table (logical, physical): pointers begin at 0, never fall and end at the table's length, logical places have no gap, and pages exist."""
    zero = F.lit(0).cast("long")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), zero)
    first = seq_ptr.agg(count((F.col("k") == 0) & (F.col("ptr") != 0)).alias("n")).select(F.lit("start").alias("fault"), "n")
    steps = seq_ptr.alias("a").join(seq_ptr.alias("b"), F.col("b.k") == F.col("a.k") + 1)
    falling = steps.agg(count(F.col("b.ptr") < F.col("a.ptr")).alias("n")).select(F.lit("falling").alias("fault"), "n")
    ends = seq_ptr.agg(F.max_by("ptr", "k").alias("last")).crossJoin(block_table.agg(F.count("*").alias("n"), F.coalesce(F.max("logical") + 1, zero).alias("top")))  # one row each
    last = ends.select(F.lit("end").alias("fault"), (F.coalesce("last", zero) != F.col("n")).cast("long").alias("n"))
    gaps = ends.select(F.lit("gaps").alias("fault"), (F.col("top") != F.col("n")).cast("long").alias("n"))
    outside = block_table.agg(count((F.col("physical") < 0) | (F.col("physical") >= pages)).alias("n")).select(F.lit("pages").alias("fault"), "n")
    return first.unionByName(falling).unionByName(last).unionByName(gaps).unionByName(outside)

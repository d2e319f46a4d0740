"""Exact dedup by skew-safe combining.

Texts are equal when identical after every run of ASCII white space became one space. Copies meet in three steps,
each grouping on the digest *and* the full normalised text: inside a task (partial aggregation), inside a salted
digest group, and globally among the salt winners. A text that fills a third of the corpus reaches any later task as
at most one row per earlier task, so no group is ever collected.

Edge cases: a null text is the empty text and groups with it; a null doc_id never wins over a number; rows repeated
with one doc_id and one text count in ``group_size`` and only one of them is kept (of rows with one doc_id and equal but
not identical texts, the one with the least hash of the text as it is); a very long text is one row, normalised and compared
whole; other columns are not read by ``exact_dedup`` and stay in ``keep_first``, whose own names begin with ``_kl_``; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelattice.llm.skew import join_groups
from kinelattice.session import cut, drop

#: A run of ASCII white space that is more than a single space already.
_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalise(text: Column) -> Column:
    """Each run of ``[\\x20\\x09-\\x0D]`` as one space; null as the empty text. Lone spaces need no replacement."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUN, " ")


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """(text_sha256, keep_id, group_size): one row per distinct normalised text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), normalise(F.col(text_col)).alias("body"))
    rows = rows.select("doc_id", "body", F.sha2("body", 256).alias("text_sha256"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    salted = rows.groupBy("text_sha256", "salt", "body").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    whole = salted.groupBy("text_sha256", "body").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    merged = whole.groupBy("text_sha256").agg(F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    clash = F.raise_error(F.concat(F.lit("different texts share the digest "), F.col("text_sha256"))).cast("bigint")
    return merged.select("text_sha256", "keep_id", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(clash).alias("group_size"))


def _judged(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    """(doc_id, raw, text_sha256, copies, keep_id, group_size): one row for each doc_id and text as it is; written once."""
    text = F.col(text_col)
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("raw"), F.sha2(normalise(text), 256).alias("text_sha256"))
    own = cut(own.groupBy("text_sha256", "doc_id", "raw").agg(F.count("*").alias("copies")), "exact-rows")
    best = cut(winners(docs, id_col, text_col, salts), "exact-winners")
    total = best.agg(F.sum("group_size")).first()[0] or 0
    judged = cut(join_groups(own, best, ["text_sha256"], "group_size", total), "exact-judged")
    drop(own)
    drop(best)
    return judged


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    judged = _judged(docs, id_col, text_col, salts)
    first = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy("raw")) == 1
    wins = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    each = judged.filter(wins).withColumn("first", first).unionByName(judged.filter(~wins).withColumn("first", F.lit(False)))
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return each.select("doc_id", "keep_id", "group_size", (F.col("first") & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row for each different text.

    The rows are found again by doc_id and a hash of the text as it is, so texts are normalised for the verdict only.
    """
    judged = _judged(docs, "doc_id", "text", 16).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    kept = judged.groupBy("text_sha256").agg(F.min_by(F.struct("doc_id", "raw", "copies"), "raw").alias("row")).select(F.col("row.doc_id").alias("_kl_id"), F.col("row.raw").alias("_kl_kept"), "row.copies")
    kept = cut(kept, "exact-kept")
    rows = docs.withColumn("_kl_raw", F.xxhash64("text"))
    out = rows.join(kept.select("_kl_id", "_kl_kept"), F.col("doc_id").eqNullSafe(F.col("_kl_id")) & (F.col("_kl_raw") == F.col("_kl_kept")), "left_semi")
    again = not kept.filter("copies > 1").isEmpty()  # rows that repeat a doc_id with its text
    return (out.dropDuplicates(["doc_id", "_kl_raw"]) if again else out).drop("_kl_raw")

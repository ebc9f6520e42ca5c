"""Exact duplicate removal by sorting content."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import filled, unused, whole


def content_sort(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "largest", salts: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The texts are range-partitioned at sampled splitters along (text, salt of the id) and sorted inside each range, so that
    equal texts are neighbours. The window compares neighbouring keys in full; the last row of a run holds its id and length.
    The salt lets splitters fall inside a large group of copies, so no group is bound to one task. Runs of one text from
    several salts then meet through the SHA-256 of their one text, and only (id, digest) rows are shuffled for the result.

    Null text is empty text, and all empty texts are one group. `keep` is "largest" or "smallest" id; null ids lose against
    others. Of rows that repeat both text and id just one is kept. Further columns of `docs` are ignored; no rows give none.
    """
    key = F.col(f"`{doc_id}`")
    rows = docs.select(key.alias("doc_id"), filled(f"`{text}`").alias("body"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts))).repartitionByRange(parts, "body", "salt")
    best_last = F.col("doc_id").asc_nulls_first() if keep == "largest" else F.col("doc_id").desc_nulls_first()
    run = Window.partitionBy("body", "salt").orderBy(best_last)
    heads = (
        ranged.select("body", "doc_id", F.row_number().over(run).alias("n"), F.lead("salt").over(run).alias("next"))
        .filter(F.col("next").isNull())
        .select(F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("digest"), "doc_id", "n")
    )
    best = F.max("doc_id") if keep == "largest" else F.min("doc_id")
    groups = heads.groupBy("digest").agg(best.alias("keep_id"), F.sum("n").cast("long").alias("group_size"))
    same = Window.partitionBy("digest", "doc_id").orderBy("doc_id")
    members = rows.select("doc_id", F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("digest")).withColumn("nth", F.row_number().over(same))
    return members.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows that `content_sort` keeps, with all their columns, of whatever names."""
    key, kept_sha, sha, nth = (unused(docs, n) for n in ("_id", "_kept", "_sha", "_nth"))
    kept = content_sort(docs, keep=keep).filter("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(kept_sha))
    own = docs.withColumn(sha, F.sha2(filled().cast("binary"), 256))
    same = Window.partitionBy("doc_id", sha).orderBy("doc_id")
    met = own.join(kept, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(sha) == F.col(kept_sha)), "left_semi")
    return met.withColumn(nth, F.row_number().over(same)).filter(F.col(nth) == 1).select(whole(docs))

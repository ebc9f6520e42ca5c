"""The corpus pipeline: documents in, clean and tokenized documents out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipsight.functions.settle import settle
from shipsight.llm import bpe, exact_dedup, jaccard, toxicity, winnow
from shipsight.llm.text import held_out, unused, whole


def packed(docs: DataFrame) -> DataFrame:
    """The text, and all other columns as one, so that none meets a name that an operator adds."""
    return docs.select("text", F.struct(*[c for c, name in zip(whole(docs), docs.columns) if name.lower() != "text"]).alias("row"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` again."""
    return rows.select("text", "row.*").select(whole(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.7; the model learns from the labelled documents that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(packed(docs), toxicity.train(docs.select("doc_id", "text"), labels, ~held_out("doc_id", 3, 1)))
    return unpacked(scored.filter("score < 0.7"), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the one with the least id; rows that share an id stay or go together."""
    key = unused(docs, "_id")
    heads = jaccard.link_groups(docs.select("doc_id", "text")).filter("doc_id <=> component_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(heads, F.col("doc_id").eqNullSafe(F.col(key)), "left_semi")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up less than a twentieth of the words."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return unpacked(winnow.find(packed(docs), benchmark).filter("NOT contaminated"), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and digests of them and of the text that they decode to."""
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    done = bpe.decode(bpe.encode(docs.select("doc_id", "text"), tokenizer), tokenizer)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary")
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: Learned scores and tokenization have no SQL counterpart; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs)
    return docs

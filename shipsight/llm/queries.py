"""Registered queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, dialogue, exact_dedup, jaccard, katz, multi_index, piece_bpe, pii, quality, secrets, sql, toxicity, url_rules, winnow
from .text import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: (verdict, host, path): the rules of the URL query, fixed values.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE_SQL[name] = oracle
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_url_filter", sql.URL_FILTER)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(h, p, v) for v, h, p in URL_RULES], "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


@query("op6_exact_dedup", sql.EXACT_DEDUP)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.content_sort(table(spark, sf_dir, "documents"))


@query("op7_decontamination", sql.DECONTAMINATION)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


@query("op1_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    done = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer), tokenizer)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


@query("op2_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))
    return with_spans(found, pii.KINDS, by_kind=True)


@query("op9_secrets")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_spans(secrets.find(table(spark, sf_dir, "documents")), secrets.KINDS, by_kind=False)


@query("op10_lm_score")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"), ~held_out("doc_id", 10, 0))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with the damage that the repair query has to find, decided by conversation and turn."""
    rows = rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fate = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    role = F.when(fate == 4, "user").otherwise(F.col("role"))
    text = F.when(fate == 1, "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(fate == 3, 2).otherwise(1))
    return rows.filter(fate != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


@query("op11_conversation_repair", sql.CONVERSATION_REPAIR)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    report, repaired = dialogue.repair(damaged(rows))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    sides = rows.select("conv_id").distinct().unionByName(report, True).unionByName(dialogue.digests(repaired), True)
    nothing = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    found = [F.coalesce(F.max(c), nothing.get(c, F.lit(0).cast("long"))).alias(c) for c in (*counts, "audit", "repaired_sha256")]
    return sides.groupBy("conv_id").agg(*found)


@query("op12_hard_negatives", sql.HARD_NEGATIVES)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return multi_index.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


@query("op13_piece_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = piece_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ids = piece_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN, packed=True)
    done = piece_bpe.decode(ids, ranks)
    return done.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def is_kind(kind: str):
    return lambda x: x["kind"] == kind


def verdicts(scored: DataFrame, mod: int, rest: int) -> DataFrame:
    return scored.select("doc_id", held_out("doc_id", mod, rest).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@query("op3_jaccard_join", sql.JACCARD)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_groups(table(spark, sf_dir, "documents"))


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return verdicts(toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 3, 1))), 3, 1)


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return verdicts(quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 4, 2))), 4, 2)


def with_spans(found: DataFrame, kinds: tuple[str, ...], by_kind: bool) -> DataFrame:
    """Counts by kind and a digest of the base spans; all spans as text, ordered by kind then start, or by start then kind."""
    place = F.map_from_arrays(F.array(*[F.lit(k) for k in kinds]), F.array(*[F.lit(i) for i in range(len(kinds))]))
    key = (lambda x: F.struct(F.coalesce(place[x["kind"]], F.lit(99)).alias("a"), x["start"].alias("b"), x["stop"].alias("c"), x["kind"].alias("k"))) if by_kind else (
        lambda x: F.struct(x["start"].alias("a"), F.coalesce(place[x["kind"]], F.lit(99)).alias("b"), x["stop"].alias("c"), x["kind"].alias("k")))
    start = "b" if by_kind else "a"
    words = lambda c: F.array_join(F.transform(F.array_sort(F.transform(c, key)), lambda x: F.concat_ws(":", x["k"], x[start], x["c"])), ",")
    base = F.filter("spans", lambda x: x["base"])
    return found.select(
        "doc_id",
        *[F.size(F.filter(base, is_kind(k))).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(words(base).cast("binary"), 256).alias("base_sha256"),
        words(F.col("spans")).alias("spans"),
    )

"""The thin queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_mil, brown, byte_repeats, chat, divergence, line_crf, line_runs, mixing, oracles, sharding, simhash, tiling, url_templates, vantage
from .common import remainder, table

#: Share of a benchmark item's tokens from which a document counts as contaminated.
CONTAMINATED = 0.5
#: Words beyond which a repeated line goes by itself.
LONG_LINE = 50
#: Rules of urls, given.
URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
DOMAINS = ("web", "forum", "books", "code")
#: Target weights of nodes among their siblings; a node without one has 1.
WEIGHTS = {("web",): 4.0, ("forum",): 1.0, ("books",): 3.0, ("code",): 2.0, ("web", "en"): 3.0, ("web", "de"): 0.5, ("books", "fr"): 2.0, ("code", "es"): 0.0}


def tree() -> dict[str, Column]:
    """Domain, language, source. The tables have no domain; five sources by number make one."""
    n = F.regexp_extract("source", r"(\d+)", 1).try_cast("int")
    domain = F.when(n < 5, DOMAINS[0]).when(n < 10, DOMAINS[1]).when(n < 15, DOMAINS[2]).otherwise(DOMAINS[3])
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def potentials(spark: SparkSession, sf_dir: str) -> line_crf.Potentials:
    """Those of the line CRF, fitted to the labelled documents outside the held-out fifth."""
    return line_crf.fit_potentials(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), remainder("doc_id", 5) == 0
    model = attention_mil.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    out = attention_mil.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"), F.col("_attention").alias("top_attention"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return groups.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffle_shards(table(spark, sf_dir, "documents"), shards=40)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select("doc_id", (F.octet_length(raw) + 16).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), sharding.shard_of("doc_id", 41, 17).alias("grown_shard"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later copies of runs of two lines or more go, and of single lines of over 50 words."""
    out = line_runs.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), shortest=2, words=LONG_LINE)
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.aggregate("_runs", F.lit(0).cast("bigint"), lambda n, r: n + r[1]).alias("n_removed"), F.size("_runs").cast("bigint").alias("n_runs"), F.md5(F.col("_clean").cast("binary")).alias("kept_md5"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_repeats.drop_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    removed = F.col("_bytes") - F.octet_length("_kept")
    return out.select("doc_id", F.col("_bytes").alias("n_bytes"), removed.cast("bigint").alias("n_removed"), F.size("_removed").cast("bigint").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), tree(), fraction=1.0, max_epochs=4, weights=WEIGHTS)
    return out.select("doc_id", "lang", "source", F.col("_epoch").alias("epoch"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_crf.quality_rules(table(spark, sf_dir, "documents"), potentials=potentials(spark, sf_dir))
    return out.select("doc_id", *(F.col(f"_{n}").alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tiling.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.col("_coverage") >= CONTAMINATED).alias("contaminated"), F.col("_coverage").alias("coverage"), F.col("_item").cast("bigint").alias("item_id"), F.col("_tiles").alias("n_tiles"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder("doc_id", 7) == 2
    out = brown.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), *(F.col(a).alias(b) for a, b in (("_n_tokens", "n_tokens"), ("_n_known", "n_known"), ("_train_tokens", "train_tokens"), ("_base", "base_score"), ("_score", "score"))))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_templates.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"), URL_RULES)
    return out.select("page_id", *(F.col(f"_{n}").alias(n) for n in ("host", "path", "rule", "verdict", "template")))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=30, top=50)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vantage.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label, positives=5, k=10, low=30, high=90, scale=256)


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_simhash, op3_sharding, op4_line_dedup, op5_suffix_dedup, op6_mixing, op7_quality_rules, op8_decontamination, op9_chat, op10_lm_scoring, op11_url_filter, op12_divergence, op13_hard_negatives)}
ORACLES = oracles.ORACLES

"""The operators of this folder over their whole tables, as registered queries."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runcourier.llm.common import table
from runcourier.llm.decontamination import contaminated
from runcourier.llm.fill_in_middle import fill_in_middle, restored
from runcourier.llm.language import languages
from runcourier.llm.language_model import language_model_scores
from runcourier.llm.line_dedup import keep_bitmaps, without_lines
from runcourier.llm.mixing import mix_sources
from runcourier.llm.near_duplicates import near_duplicates
from runcourier.llm.neighbours import nearest
from runcourier.llm.periodic_runs import periodic_runs
from runcourier.llm.personal_data import personal_data
from runcourier.llm.repeats import removed
from runcourier.llm.token_counts import token_counts
from runcourier.llm.toxicity import toxicity


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts(table(spark, sf_dir, "documents"), path)


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4).drop("node", "first")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("node")


def _repeated_tail(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth by hash repeats a stretch of words to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.expr("if(n > 0, cast(g % n as int), 0)"))
    rows = rows.withColumn("p", F.expr("cast(1 + floor((n - a) / (3 + g % 8)) as int)"))
    times = F.expr("cast(ceil((n - a) / p) as int)")
    stretch = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times))
    tail = F.slice(stretch, F.lit(1), F.col("n") - F.col("a"))
    changed = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_repeated_tail(table(spark, sf_dir, "documents")), repeats=4, least_words=6)
    ranked = F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"]))
    longest = F.array_max(ranked)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    found = found.withColumn("longest", longest)
    size, period = F.col("longest.length"), -F.col("longest.col3")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("longest.col2")).alias("start"),
        size.alias("length"),
        period.alias("period"),
        F.floor(1000 * size / period).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"), seed=7, percent=100, spm_percent=50)
    text = restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(text, 256).alias("restored_sha256"),
    )


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = without_lines(docs, keep_bitmaps(docs, min_docs=10, min_chars=1))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_language_model": op2_language_model,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_repeats": op5_repeats,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_personal_data": op7_personal_data,
    "op8_language": op8_language,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_decontamination": op10_decontamination,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_line_dedup": op13_line_dedup,
}

"""Corpus pipeline: language ID, quality, near duplicates, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchline.llm import decontamination, language, ngram_join, packing, quality, token_ids
from matchline.plans.session import configure
from matchline.sources.scratch import scratch_path

KEEP_QUALITY = 0.7


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; NULL texts and texts without a letter go. Profiles come from the stage's own rows that are not held out."""
    profiles = language.learn(docs.where(~language.held_out("doc_id")))
    return language.predict(docs, profiles).where(F.col("lang_pred") != language.UNKNOWN).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of KEEP_QUALITY or more, by a model of the labelled rows that are not held out."""
    forest = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.predict(docs, forest).where(F.col("quality_score") >= KEEP_QUALITY).select(*docs.columns)


def one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more, taken transitively) the row with the least id stays, NULL last.

    Rows are told apart by a number of their own, so texts under a repeated id or without one are judged each by itself. A repeated row stays
    once; wordless texts are near nothing, and stay once for each id and text, or all where the id is NULL.
    """
    rows = ngram_join.kept(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    groups = ngram_join.similar_groups(rows, key="_row", size=5, num=80, den=100).select("_row", "n_shingles", "component_id")
    described = rows.select("_row", "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    single = (F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()
    group = F.when(single, F.concat_ws("/", "doc_id", "digest")).otherwise(F.col("component_id").cast("string"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", "_row"))
    kept = groups.join(described, "_row").groupBy(group.alias("group")).agg(first.alias("first")).select(F.col("first._row").alias("_row"))
    dropped = ngram_join.kept(groups.select("_row").join(kept, "_row", "left_anti"), "dropped")
    # Only rows that the marks name are shuffled: the dropped ones and a few others.
    marked = ngram_join.with_marks(rows, dropped, "_row")
    others = marked.where("_marked").join(dropped, "_row", "left_anti")
    return marked.where("NOT _marked").unionByName(others).select(*docs.columns)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated: hit words are less than a twentieth of theirs."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.contamination(docs, benchmark).where(~decontamination.is_contaminated()).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents in sequences of equal capacity."""
    return packing.pack(docs, token_ids.tokenizer_path())


STAGES = [
    ("language ID", known_language),
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_a_kind),
    ("benchmark decontamination", clean_of_benchmark),
    ("packing", packed),
]

#: The classifiers and the tokenizer cannot be written as SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each stage's rows are written and read again, so a lost executor repeats one stage at most."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

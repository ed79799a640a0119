"""A corpus from documents: language ID, near duplicates, decontamination, mixing, token files."""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stage
from tidemark.llm.decontam import drop_leaks
from tidemark.llm.lang_id import keep_known, learn
from tidemark.llm.mixing import mix_sources
from tidemark.llm.ngram_join import similar_components
from tidemark.llm.token_output import read_tokens, write_tokens


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the corpus names."""
    profiles, least = learn(docs)
    return keep_known(docs, profiles, least=least)


def free(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of the documents has, whatever its case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keyed(docs: DataFrame, row: str, dig: str) -> DataFrame:
    """The documents with a number of their own, ``row``, and a hash of the text, ``dig``; written, so that numbers stay."""
    return stage(docs.withColumns({row: F.monotonically_increasing_id(), dig: F.xxhash64(F.coalesce("text", F.lit("")))}), "rows")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group that links of similarity 0.8 or more hold together.

    Rows that repeat an id are documents of their own; null ids come after all others. Columns may have any name.
    """
    row, dig = free(docs, "_row", "_dig")
    rows = keyed(docs, row, dig)
    groups = stage(similar_components(rows.select(F.col(row).alias("_row"), "text"), id_col="_row", n=5, t=Fraction(4, 5)).select("_row", "component_id"), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_dig", "_row")
    own = rows.select(F.col(row).alias("_row"), F.col(dig).alias("_dig"), "doc_id")
    stay = groups.join(own, "_row").groupBy("component_id").agg(F.min(order)["_row"].alias(row))
    return rows.join(stay.select(row), row, "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it. Columns may have any name."""
    row, dig, copies, copy = free(docs, "_row", "_dig", "_n", "_mix_copy")
    rows = keyed(docs, row, dig)
    named = rows.select("doc_id", "source", "text", F.col(dig).alias("_dig"), F.col(row).alias("_row"))
    taken = mix_sources(named, key_cols=("_dig", "_row")).where("copies > 0").select(F.col("_row").alias(row), F.col("copies").cast("int").alias(copies))
    both = rows.join(taken, row)
    return both.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col(copies))).alias(copy)).drop(copy)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: a row per document."""
    return read_tokens(write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language ID and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None

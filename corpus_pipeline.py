"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and
returns a DataFrame; it is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm import jaccard, mixing, packing, quality, secrets
from tidewire.llm.store import only, reachable, written


def tokenizer() -> str:
    """Where the vocabulary lies; a parameter of packing."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the learned decision list go."""
    labels = reachable(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit_rules(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id.

    Of repeated rows of its doc_id the one whose text comes first stays. Rows without
    a doc_id are linked with nothing and stay.
    """
    reachable(spark)
    found = written(jaccard.link_components(docs), "components")
    rows = found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    single = only(docs, rows.where("n = 1").select("doc_id"))
    several = only(docs, rows.where("n > 1").select("doc_id"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), F.xxhash64(*docs.columns)))
    first = several.select(F.struct(*docs.columns).alias("row"), "doc_id", place.alias("place")).where("place = 1")
    unnamed = docs.where(F.col("doc_id").isNull())
    return single.select(*docs.columns).unionAll(first.select("row.*")).unionAll(unnamed)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by its kind; all documents stay."""
    return secrets.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of the mixed documents and the place of every piece in its sequence."""
    reachable(spark)
    return packing.pack(docs, tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scans", secret_scans),
    ("mix sources", mix_sources),
    ("pack sequences", pack_sequences),
]

# Learned rules and the tokenizer cannot be said in SQL; tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

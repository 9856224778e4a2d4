"""From raw documents to packed training sequences: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basalt.llm import mixing, near_dedup, packing, quality_rules, substring_dedup
from basalt.llm.common import cut


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.kept_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, similar to 0.8 or more over five words, stays."""
    return near_dedup.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of smaller id holds are cut out; texts and lengths change."""
    from pyspark.sql import functions as F

    return substring_dedup.deduplicated(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights in a budget of as many words as there are; a document of several epochs is there as often."""
    return mixing.mixed_documents(docs, share=1.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, each with its place in a sequence."""
    return packing.pack(docs, with_ids=False)


STAGES = [("quality_rules", rules), ("simhash_dedup", near_copies), ("substring_dedup", passages), ("mixing", mix), ("best_fit_packing", pack)]
#: Hashes, tokens and searches of several stages have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name}")
    return docs

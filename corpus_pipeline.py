"""A corpus cleaned in five stages, each over all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, decontaminate, language_id, line_dedup, simhash, word_sets
from gridloom.llm.common import connected_components, table
from gridloom.llm.queries import remainder, vocabulary
from gridloom.shipping import shared_folder, ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letter at all (null and empty texts too), or no language likelier than by
    chance. All else stays as it is, repeated rows, null ids and long texts too; an empty table stays empty."""
    ship(spark)  # the workers need this library's code from here on
    return language_id.reject_unknown(docs, language_id.train(docs, remainder(3) != 1))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines are cut from every text that has a line of its own besides. All rows and columns stay, null
    texts and ids and repeated rows too; an empty table stays empty."""
    return line_dedup.remove_boilerplate(docs).select(*(f"`{c}`" for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays; words by fives, 61 of 64 bits alike or a
    Jaccard similarity of 0.8. Texts without words are alike (fingerprint zero). Rows of one id are one document and
    stay or go together; rows without an id stay; long texts are compared whole; an empty table stays empty."""
    groups = simhash.near_duplicates(docs, words=5, max_bits=3).where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    linked = connected_components(groups.union(word_sets.near_copies(docs, words=5, least=0.8)), "a", "b")
    gone = linked.where("node <> root").select(F.col("node").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents of which over a fifth of the words are benchmark go. Nulls, empty
    texts, null ids and repeated rows stay; long texts are searched whole; an empty table stays empty."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the hash of the text that the ids decode to, for every row; a null or empty text has
    no ids. Null ids and repeated rows stay; an empty table gives no rows; other columns are not read."""
    coded = bpe.encode(docs, vocabulary("word_bpe_49k.json"), decoded=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language), ("line_dedup", lines), ("simhash_dedup", near_copies),
    ("decontamination", benchmark_passages), ("bpe", tokens),
]
#: A trained network and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result is a table in the shared folder that the next one reads, and that
    is removed once the next one is written. The last table is the result."""
    top = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{top}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

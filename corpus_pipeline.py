"""A corpus from documents: quality rules, near-duplicates, secrets, mixture, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import mixing, ngram_join, outliers, packing, secrets
from lattica.llm._spark import small_or_not, stored
from lattica.llm.queries import tokenizer
from lattica.plans.store import recorded, remove


#: Tables that stages left in the shared folder: application, number of the stage, path.
_LEFT: list[tuple[str, int, str]] = []


def _stage(number: int):
    """A stage that first removes what earlier stages left in the shared folder: their results are written by then. Tables that docs itself still reads stay."""

    def wrap(f):
        @functools.wraps(f)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            app = spark.sparkContext.applicationId
            over = [x for x in _LEFT if x[0] == app and x[1] < number]
            read = docs.inputFiles() if over else []
            for x in over:
                if not any(x[2] in file for file in read):
                    remove(spark, x[2])
                    _LEFT.remove(x)
            with recorded() as paths:
                out = f(spark, docs, sf_dir)
            _LEFT.extend((app, number, path) for path in paths)
            return out

        return run_stage

    return wrap


@_stage(1)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the robust outlier rules keep, each row by its own verdict; a null text fails the rules."""
    return outliers.keep(docs)


@_stage(2)
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingles of five words link at a similarity of 0.8: the one with the smallest doc_id.

    Rows are told apart by a key of their own, so different texts with one doc_id, or without any, all have their say;
    equal rows are copies like any other. A null doc_id counts as the largest. Documents without words stay.
    """
    cells = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = stored(docs.select(F.monotonically_increasing_id().alias("key"), cells.alias("row")), "keyed")
    found = ngram_join.jaccard_components(keyed.select(F.col("key").alias("doc_id"), "row.text"), num=80, den=100, width=5)
    ranked = found.select(F.col("doc_id").alias("key"), "component_id").join(keyed.select("key", F.col("row.doc_id").cast("long").alias("id")), "key")
    heads = ranked.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")).alias("head")).select("head.key")
    return keyed.join(small_or_not(stored(heads, "heads")), "key", "left_semi").select(*[F.col("row")[c].alias(c) for c in docs.columns])


@_stage(3)
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced; n_chars, if there is one, counts the new text."""
    out = secrets.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


@_stage(4)
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, row by row, the last of a source cut to its budget."""
    return mixing.apply(docs, mixing.quality_weights(spark, sf_dir))


@_stage(5)
def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with the token ids."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), end_id=1, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each stage's result written to the shared folder before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs


#: Outlier estimates, components and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

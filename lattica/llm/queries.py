"""The queries of this subpackage: opN_<name>(spark, sf_dir), each its operator over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, mixing, ngram_join, outliers, packing, perplexity, secrets, toxicity, vptree, wavelet
from ._spark import trusted_labels


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Where the public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op2_token_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_shards(wavelet.write_shards(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2))


def op3_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = trusted_labels(spark, sf_dir).where("quality = 1")
    return perplexity.classify(_table(spark, sf_dir, "documents"), trusted)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_table(spark, sf_dir, "pages"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), num=85, den=100, width=4)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3, F.lit(0))  # no id: not held out, and no label either
    model = toxicity.fit(*toxicity.sample(docs, trusted_labels(spark, sf_dir).where(fold != 1)))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op7_vptree_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op8_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)


def op9_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = outliers.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), mixing.quality_weights(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    mixed = mixing.ORACLE.replace("select doc_id, sized.source, size,", "select doc_id, size,")
    return {"op5_ngram_jaccard_join": ngram_join.oracle(85, 100, 4), "op9_robust_outliers": outliers.oracle(), "op10_source_mixing": mixed}

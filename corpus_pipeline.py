"""A training-data pipeline: each stage's table is written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.bpe import bpe
from tallyline.llm.jaccard_join import one_of_each
from tallyline.llm.language_id import identify, train
from tallyline.llm.mixing import mix, taken_text
from tallyline.llm.queries import held_out, table, vocabulary
from tallyline.llm.suffix_dedup import suffix_dedup
from tallyline.llm.tables import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (no letters, or no language with half of the posterior); a null lang becomes the predicted one."""
    model = train(docs.where(~held_out()).select("text", "lang"), vocabulary("piece_bpe_32k.model"))
    out = identify(docs.select(*COLUMNS), model).where("lang_pred <> 'und' AND lang_score >= 0.5")
    return out.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies, once; documents without an id stay."""
    return one_of_each(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts bytes of passages that occur earlier; documents of which only blanks are left go. A letter cut in two becomes U+FFFD."""
    out = suffix_dedup(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.make_valid_utf8(F.col("kept").cast("string"))).otherwise(F.col("text"))
    out = out.withColumn("text", text).where(r"n_removed = 0 OR text RLIKE '[^\\x20\\x09-\\x0D]'")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each time that a document is taken; the one that a budget ends in is cut there."""
    mixed = mix(docs.select(*COLUMNS), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return taken_text(mixed).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and a digest of what they decode to."""
    out = bpe(docs.select(*COLUMNS), vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mixing),
    ("BPE encoding and decoding", encoding),
]
#: Language ID, suffix arrays and BPE have no SQL form; tests/llm/test_pipeline_stages.py compares every stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

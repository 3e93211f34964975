"""A training-data pipeline over ``documents``: quality rules, near-duplicates, decontamination, secrets, SentencePiece.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. Each stage's result is written as Parquet
and read again as the next one's docs. All but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seismark.llm import decontaminate, quality, secrets, sentencepieces, simhash
from seismark.llm._common import materialize, table
from seismark.llm.queries import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go."""
    return quality.ledger(docs).filter(quality.passes(F.col("failure_bits"))).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the one with the smallest id (null ids last), among rows with that id the one with the smallest
    text hash. Rows that share an id but not a text are judged apart."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).filter(F.size("matches") == 0).select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is cut out and marked; n_chars follows the text. All documents stay."""
    found = secrets.secrets(docs)
    some = F.size("base") + F.size("random") > 0
    marked = found.select("row", some.alias("some"), F.when(some, secrets.redacted(F.col("row.text"), F.col("hits"))).otherwise(F.col("row.text")).alias("text"))
    cols = {"text": F.col("text"), "n_chars": F.when(F.col("some"), F.char_length("text")).otherwise(F.col("row.n_chars"))}
    return marked.select(*[cols[c].cast(docs.schema[c].dataType).alias(c) if c in cols else F.col("row").getField(c).alias(c) for c in docs.columns])


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids; a document whose ids do not decode to its text is marked."""
    found = sentencepieces.encode(docs, tokenizer_file("piece_bpe_32k.model"), check=True)
    held = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("ids", "n_tokens", "round_trip")]
    return found.select(*held, "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("SentencePiece encoding", sentencepiece_encoding),
]

#: The near-duplicate, decontamination, secret and encoding stages have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

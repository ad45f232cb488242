"""A training-corpus pipeline over documents: language, near-duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a
DataFrame; all but the last return the columns of documents. run() writes each stage's rows to the
shared folder and reads them again, so that a lost executor costs no more than tasks of one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardamom.llm import bpe, decontaminate, language, neardup, privacy
from cardamom.llm.common import discard, small, stored, table
from cardamom.llm.queries import byte_vocabulary

#: Ids of dropped documents that are sent to every task at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _apart(docs: DataFrame, made: set[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stage's rows, with the columns of docs, whichever of their names the operator makes columns of as well."""
    own = {c: f"__own_{c}" for c in docs.columns if c in made}
    return stage(docs.withColumnsRenamed(own)).select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets lang to the predicted language; null texts and those without letters go."""

    def stage(docs: DataFrame) -> DataFrame:
        found = language.identify(docs, language.fit(docs, ~language.held_out()), keep=docs.columns)
        return found.where(F.col("lang_pred") != language.UNKNOWN).withColumn("lang", F.col("lang_pred"))

    return _apart(docs, {"lang_pred", "score", "spans"}, stage)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the document with the smallest id stays, with all rows of that id.

    Rows of null id can't be told from one another and stay, copies of other documents too.
    """
    dropped = stored(neardup.find_components(docs).where("doc_id is not null and not kept").select("doc_id").distinct(), "dropped")
    return docs.join(F.broadcast(dropped) if small(dropped, BROADCAST_IDS) else dropped, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are passages of the benchmark go; others lose those passages, and n_chars follows the text. Null texts stay."""

    def stage(docs: DataFrame) -> DataFrame:
        found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=docs.columns)
        cut = found.where(~decontaminate.contaminated()).withColumn("text", decontaminate.without_hits("text", "hits"))
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        return cut.withColumn("n_chars", F.when(F.size("hits") > 0, size).otherwise(F.col("n_chars")))

    return _apart(docs, {"n_words", "n_hit", "hits", "items"}, stage)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets give way to their kind in brackets; n_chars follows the text. Null texts stay."""
    return privacy.redact(docs).select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, little-endian unsigned 32-bit, with digests of them and of what they decode to. A null text has none."""
    coded = bpe.encode_documents(docs, *byte_vocabulary(), keep=["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("byte_bpe", byte_bpe),
]

#: Trained models, bootstrapped patterns and a vocabulary file are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(spark, before)
        before = docs
    return docs

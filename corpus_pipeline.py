"""From raw documents to sampled token ids: quality, line dedup, near-dedup, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import fresh, materialize, read_table
from tideline.llm.line_dedup import dedup_lines
from tideline.llm.minhash import keep_one
from tideline.llm.mixing import mix_sources
from tideline.llm.pieces import encode_pieces
from tideline.llm.quality import keep_good
from tideline.llm.queries import vocabulary


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, does not reject. No documents in, none out."""
    return keep_good(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of three-line windows; n_chars follows the text, null stays null."""
    out = dedup_lines(docs)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else out[c] for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each group of near duplicates."""
    return keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: up to three rows, or none. Texts without words are not taken."""
    mix_id, mix_times, mix_copy = (fresh(docs, x) for x in ("mix_id", "mix_times", "mix_copy"))
    times = mix_sources(docs).where("taken > 0").groupBy(F.col("doc_id").alias(mix_id)).agg(F.max(F.col("taken") / F.col("size")).cast("int").alias(mix_times))
    out = docs.join(times, docs["doc_id"].eqNullSafe(F.col(mix_id)))
    return out.withColumn(mix_copy, F.explode(F.sequence(F.lit(1), F.col(mix_times)))).select(*[docs[c] for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document; copies of a document are drawn alike."""
    return encode_pieces(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", drop_low_quality),
    ("line dedup", drop_repeated_lines),
    ("minhash near-dedup", drop_near_duplicates),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: The classifier and the sampled segmentation are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

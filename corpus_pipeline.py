"""A corpus pipeline of five stages over `documents`; each stage's rows are written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm import bpe, decontam, langid, linededup, nearcopies
from ruleloom.llm.common import drop, quoted, row_of, ship, table, written

#: a prediction this sure, on this many characters, rejects a document that says it is in another language
SURE, LONG = 0.999, 200
#: row keys that may be broadcast (8 bytes each) to drop documents; beyond it, a shuffled join drops them
BROADCAST_IDS = 1_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, and those whose language surely is not the one they state.

    Columns of any name pass through, inside a struct. So it is in all stages.
    """
    labelled = docs.where(~langid.held_out(F.col("doc_id"))).select(F.col("doc_id").alias("key"), "text", "lang")
    told = langid.predict(docs.select(row_of(docs).alias("row"), "text"), langid.learn(labelled), ["row"])
    wrong = F.col("row.lang").isNotNull() & (F.col("lang_pred") != F.col("row.lang")) & (F.col("score") >= SURE) & (F.char_length("row.text") >= LONG)
    return told.where((F.col("lang_pred") != "und") & ~wrong).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents repeat go, but from one; n_chars follows. A null text becomes empty."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    rows = docs.select(F.struct(*(quoted(c) for c in rest)).alias("rest"), "doc_id", "text")
    made = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return linededup.dedup_lines(rows).select(*((made[c] if c in made else F.col("rest").getField(c)).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one with the smallest id (null last), then the smallest digest.

    Rows are told apart by a key of their own, so rows that share an id with a copy, or have no id, are judged by their
    own texts. Texts without words have no near copies: there, rows with equal text and the same id are one.
    """
    rows = written(docs.select(F.monotonically_increasing_id().alias("key"), row_of(docs).alias("row")), "rows")
    own = rows.select("key", F.col("row.doc_id").alias("doc_id"), F.sha2("row.text", 256).alias("digest"))
    told = written(nearcopies.near_copies(rows.select("key", F.col("row.text").alias("text")), "key").join(own, "key"), "told")
    alone = F.when((F.col("n_shingles") == 0) & F.col("doc_id").isNotNull(), F.struct("doc_id", "digest"))
    group = [F.when(alone.isNull(), F.col("component_id")).alias("component"), alone.alias("alone")]
    first = told.groupBy(*group).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "key")).alias("first"))
    gone = written(told.select("key").join(first.select("first.key"), "key", "left_anti"), "gone")
    small = gone.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(gone) if small else gone, "key", "left_anti").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token counts and digests of the ids and of the decoded text; what was kept of other columns ends here."""
    import public_tokenizers

    return bpe.digests(docs, ["doc_id"], public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", encoding),
]

#: tokens and near copies are beyond SQL: the tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
            drop(before)  # the next stage reads what this one wrote
            before = docs
    return docs

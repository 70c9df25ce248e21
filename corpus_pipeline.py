"""A corpus pipeline of five stages over documents; each returns documents' columns, the last adds token ids."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.decontaminate import decontaminate
from pairloom.llm.minhash import near_duplicates
from pairloom.llm.quality import quality_filter
from pairloom.llm.secrets import new_ledger, redact
from pairloom.llm.sentencepiece_bpe import public_model, round_trip_columns
from pairloom.llm.shared import BROADCAST_ROWS, cut, shared_folder, table, text_batches


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or are more likely bad than good go; so do those without a text.

    Rows that repeat stay or go alike; very long texts are counted whole; an
    empty table gives no rows; further columns, whatever their names, stay.
    """
    text_batches(spark)
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest doc_id stays.

    Texts without words are linked with nothing and stay, as do documents
    without a doc_id.  Rows that repeat a kept doc_id all stay if their texts
    are linked; with other texts each is judged by its own.  Very long texts have
    as many shingles as they have; an empty table gives no rows; further columns,
    whatever their names, stay.
    """
    text_batches(spark)
    gone = cut(near_duplicates(docs, text_key=True).where(~F.col("kept")).select("doc_id", "text_key").distinct())
    # Few ids are broadcast, and texts stay where they are; many are joined by shuffling both sides.
    side = (F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone).alias("g")
    same = (F.col("d.doc_id") == F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.text_key"))
    return docs.alias("d").join(side, same, "left_anti").select("d.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go; those without a text stay.

    Rows that repeat stay or go alike; very long texts are gone over whole; an
    empty table gives no rows, an empty benchmark loses none; further columns,
    whatever their names, stay.
    """
    text_batches(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and n_chars follows; a null text stays null.

    Each row stays, also one that repeats; of spans that overlap the first one's
    kind is named; very long texts are scanned whole; an empty table gives no
    rows; further columns, whatever their names, stay.
    """
    text_batches(spark)
    found = redact(docs, new_ledger(spark))
    if "n_chars" not in found.columns:
        return found
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with token_ids, the ids of its text, their number n_tokens, and decodes, whether they give the text again.

    Null counts as the empty text.  Columns of ``docs`` with these three names
    are replaced; all others stay.  Each row stays, also one that repeats; very
    long texts are encoded whole; an empty table gives no rows.
    """
    text_batches(spark)
    decoded = f"decoded_{uuid.uuid4().hex}"
    encoded = round_trip_columns(docs, public_model, decoded=decoded)
    # The space mark itself reads as a space after decoding.
    same = F.col(decoded) == F.translate(F.coalesce("text", F.lit("")), "▁", " ")
    return encoded.withColumns({"n_tokens": F.size("token_ids").cast("long"), "decodes": same}).drop(decoded)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece_encoding", piece_encoding),
]

#: Estimation of rule accuracies, and the ids, are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over the table documents; each stage's result is written to the shared folder and read again.

    With ``folder`` (of the same tables) a run that was ended goes on behind the
    last stage that was done, and all stages' results stay there.  Without it a
    stage's folder is given back when the next stage's is written.
    """
    docs = table(spark, sf_dir, "documents")
    own = folder or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(own).getFileSystem(spark._jsc.hadoopConfiguration())
    before = None
    for name, stage in STAGES:
        if not files.exists(hadoop(f"{own}/{name}/_SUCCESS")):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{own}/{name}")
        docs = spark.read.parquet(f"{own}/{name}")
        if before and not folder:
            files.delete(hadoop(before), True)
        before = f"{own}/{name}"
    return docs

"""A corpus pipeline: quality, language, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and
returns a DataFrame; all but the last return the columns of ``documents``. ``run`` writes
each stage's rows as Parquet in the shared folder and reads them back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaywise.llm.langid import UNKNOWN, fit_languages, predict_languages
from quaywise.llm.neardup import near_duplicates
from quaywise.llm.packing import pack
from quaywise.llm.quality import fit_quality, score_quality
from quaywise.llm.repeats import remove_repeats
from quaywise.llm.store import Workspace, read_table

#: Documents whose language is less probable than this are rejected.
LEAST_LANGUAGE_SCORE = 0.4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents which the classifier selects; toxic and low-quality ones go.

    Null and empty texts are judged as empty ones, texts are judged whole. Repeated rows and
    ties share one fate. An empty table stays empty. All columns stay as they are, also ones
    named like the classifier's own.
    """
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model, keep_columns=True, names=("__grade", "__tail", "__selected"))
    return scored.filter("__selected").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; null, empty, letterless and undecided ones go.

    Texts are read whole. Repeated rows and ties share one fate. If no document has a language
    nothing is learned and all go. An empty table stays empty. All columns stay as they are,
    also ones named like the predictor's own.
    """
    found = predict_languages(docs, fit_languages(docs), names=("__lang", "__score"))
    return found.filter((F.col("__lang") != UNKNOWN) & (F.col("__score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near-duplicates.

    Null, empty and blank texts are alike to nothing and stay. Texts are compared whole. The
    rows of a repeated doc_id are one document: they stay or go together. Rows without doc_id
    go. An empty table stays empty. All columns stay as they are, whatever their names.
    """
    kept = near_duplicates(docs).filter("kept").select("doc_id")
    return docs.join(kept.hint("merge"), "doc_id", "left_semi").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in earlier ones; a document with no word left goes.

    So do null, empty and blank texts. Texts are read whole; those that lose nothing stay as they
    are. Rows of a repeated doc_id take nothing from each other. An empty table stays empty. All
    other columns stay, whatever their names; n_chars, if there, is counted anew.
    """
    out = remove_repeats(docs).filter(F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences of 1024 tokens; see pack, also for the odd cases."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]

#: Trained models and tokenizers can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.table(stage(spark, docs, sf_dir), f"stage-{k}")
        work.keep(docs)
    return docs

"""Corpus preparation in five stages, from raw documents to packed batches.

Each stage works on all documents that the stage before kept, written as Parquet
to the shared folder and read again. All stages but the last return the columns
of ``documents``; texts change only where repeated passages are cut out, and
then ``n_chars`` follows. Documents with a null id are never rejected, as no
decision can name them. Where rows share an id, a decision against one of them
is against the id: all of them go. Texts of any length are judged whole, ties
are decided as each operator states, and an empty table goes through empty.
Columns beyond those of ``documents`` stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonframe.llm.minhash import near_duplicates
from codonframe.llm.packing import pack
from codonframe.llm.quality_model import score_quality
from codonframe.llm.registry import THRESHOLD
from codonframe.llm.shared import discard, in_fold, only_kept, stored, table
from codonframe.llm.suffix_dedup import without_repeats
from codonframe.llm.toxicity import score_toxicity


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(stored(ids.select("doc_id").distinct()), "doc_id", "left_anti").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose probability of good quality is below the threshold."""
    scored = score_quality(docs, table(spark, sf_dir, "labels"), ~in_fold("doc_id", 4, 2))
    return _without(docs, scored.where(F.col("score") < THRESHOLD))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose probability of toxicity reaches the threshold."""
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), ~in_fold("doc_id", 3, 1))
    return _without(docs, scored.where(F.col("score") >= THRESHOLD))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    return _without(docs, near_duplicates(docs).where(~F.col("kept")))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that also start earlier out of the texts."""
    cut = without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document in a batch of its length bucket."""
    return pack(docs)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", packing)]

# Models, sketches and the bucket optimum have no SQL form; the tests hold the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus. What a stage writes to the shared folder on its way goes once its result is written, and so does the result before."""
    docs, held = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        with only_kept(spark) as here:
            docs = here.keep(stored(stage(spark, docs, sf_dir)))
        discard(spark, held)
        held = here.kept
    return docs

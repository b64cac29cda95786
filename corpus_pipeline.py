"""From raw documents to packed token sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept;
all but the last return the columns of their input, whatever they are. The caller writes
each result as Parquet and reads it again for the next; a stage deletes the intermediate
tables of the stage before it on the same tables (and no others), so a result must be
written before the next stage is called.

Null texts have no language and go in the first stage; rows with a null or repeated
doc_id are judged as rows of their own, and the stages that choose between rows take the
smallest id, null last. An empty table passes through all stages.
"""

from __future__ import annotations

import contextvars
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import common, dedup, jaccard, language, packing, toxicity


#: The run that a stage belongs to.
_RUN: contextvars.ContextVar[str | None] = contextvars.ContextVar("run", default=None)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    """The stage with its scratch tables owned by the run, or by sf_dir when a caller
    writes the results between the stages itself."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        owner = f"pipeline {_RUN.get() or sf_dir}"
        common.clear_scratch(spark, owner)
        with common.owned(owner):
            return f(spark, docs, sf_dir)

    return run


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin stay."""
    return language.accepted(docs)


@stage
def toxic_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic stay; labels come from the labels table."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for blanks, the longest original stays."""
    return dedup.deduplicated(docs)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays."""
    return jaccard.representatives(docs)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, with their sequence and place."""
    return packing.pack(packing.pieces(docs))


STAGES = [("language ID", language_id), ("toxicity", toxic_text), ("exact dedup", exact_copies), ("near duplicates", near_copies), ("packing", packed)]

#: Compression sizes and a trained network are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. A stage's table goes when the next stage's is
    written; what the last one reads lasts until the session ends, whatever runs later."""
    token = _RUN.set(common.token())
    try:
        return _through(spark, common.documents(spark, sf_dir), sf_dir)
    finally:
        _RUN.reset(token)


def _through(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    before = None
    for i, (_, f) in enumerate(STAGES):
        out = f(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = common.scratch_path(spark, f"stage-{i}")
            out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
            if before:
                common.remove(spark, before)
            before = path
    return out

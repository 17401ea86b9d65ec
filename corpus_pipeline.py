"""The corpus pipeline: stages over ``documents``, each calling one operator of ``edgewright.llm``.

Language identification (texts without a language go), exact deduplication (the first of equal texts stays),
SimHash near-duplicates (the document with the smallest id of each group stays), repeated passages (their bytes go
from the texts), packing (the pieces of all that is left). All but the last return the columns of ``documents``.

Null and repeated ids pass from stage to stage as the operators' docstrings say; a null text has no language and goes first;
packing gives a piece for every document that is left, for an emptied text its end id alone. An empty table gives no piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edgewright.llm import exact_dedup, language, packing, simhash, substrings
from edgewright.llm.common import cut, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.strip_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language", language_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("passages", passages_stage),
    ("packing", packing_stage),
]
#: Classifier, fingerprints and tokens have no SQL. ``test_pipeline_stages_against_brute_force`` compares exact, near and
#: passages with brute-force versions, and what goes into language and packing with what comes out.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; each result is written and read back as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus from ``documents``: filter, deduplicate, decontaminate, redact, mix.

Each stage gets all that the one before kept; what it decides takes effect on the rows
that it returns. All but the last return the columns of ``documents``; the last adds
mix_start, mix_block, mix_slot, mix_last_slot and mix_parts, by which the corpus is to be read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rxloom.llm.common import Scratch, table
from rxloom.llm.decontamination import decontamination_stage
from rxloom.llm.quality_classifier import quality_stage
from rxloom.llm.secret_scan import redact_stage
from rxloom.llm.simhash_dedup import dedup_stage
from rxloom.llm.source_mixing import mixing_stage

STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", redact_stage),
    ("source mixing", mixing_stage),
]

#: SQL cannot express the first three stages; tests/llm/test_stages.py holds each against plain versions or planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written to the shared folder and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{at}")
        if at:
            scratch.drop(f"stage-{at - 1}")
    return docs

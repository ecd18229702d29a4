"""A corpus pipeline over ``documents``: filter, dedup, cut repeats, mix, encode.

Each stage is written as Parquet in the shared folder and read again by the next, after
which it is deleted; the last one stays, as the result is read from it.

Defined cases: rows with nulls in any column, empty and very long texts, repeated rows
and columns of any other name go through the stages as their docstrings say: texts that
fail the quality rules leave, copies leave but for one, rows without a source are one
source. An empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import op2_simhash, op3_suffix, op5_pieces, op7_mixing, op8_rules
from fathom.llm.common import dropped, stored, table

STAGES = [
    ("quality_rules", op8_rules.stage),
    ("simhash_near_dedup", op2_simhash.stage),
    ("suffix_array_dedup", op3_suffix.stage),
    ("mixing", op7_mixing.stage),
    ("sentencepiece", op5_pieces.stage),
]

#: Fingerprints, suffixes and sampled segmentations are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES:
        docs, path = stored(stage(spark, docs, sf_dir))
        if before:
            dropped(spark, before)
        before = path
    return docs

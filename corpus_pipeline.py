"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again for the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docmill.llm.bpe import encode_stage
from docmill.llm.common import stage
from docmill.llm.decontam import drop_contaminated
from docmill.llm.langid import keep_identified
from docmill.llm.linededup import drop_lines
from docmill.llm.neardup import keep_one
from docmill.session import table

STAGES = [
    ("language_id", keep_identified),
    ("line_dedup", drop_lines),
    ("near_duplicates", keep_one),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode_stage),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

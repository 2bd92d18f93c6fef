"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing, SentencePiece.

Every stage takes (spark, docs, sf_dir) and returns a table that the next one takes as docs;
all but the last return the columns of documents, and others that docs has beside them.

Defined results: documents without a language (null, empty and letterless texts among them) go
in the first stage; of rows that repeat both doc_id and text, later ones lose their lines in the
second and go with them in the third; a null doc_id comes before all others; of similar texts
the least doc_id stays; a null source is a source of its own. An empty table gives an empty
result. Each stage's docstring says what it does with such rows by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strokeforge.llm.common import materialize
from strokeforge.llm.langid import language_stage
from strokeforge.llm.line_dedup import line_stage
from strokeforge.llm.mixing import mixing_stage
from strokeforge.llm.pieces import piece_stage
from strokeforge.llm.simhash import simhash_stage

STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", simhash_stage),
    ("mixing sources", mixing_stage),
    ("SentencePiece", piece_stage),
]
#: SQL can't express code lengths, XXH64 majorities or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "pipeline")
    return docs

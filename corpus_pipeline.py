"""A training-data pipeline over `documents`: five stages, each written as Parquet and read by the next.

1. quality rules: documents that the fertility rules reject go;
2. line dedup: boilerplate lines on several sources go from the texts;
3. n-gram Jaccard join: of each group of near copies one document stays;
4. mixing: sources are brought to their target weights, a document once for each epoch that takes it;
5. packing: pieces of all rows get their place in training sequences.

All but the last return the columns of `documents`. `doc_id` may occur twice after mixing, in which case
packing treats the rows as documents of their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.llm.fertility import judged
from maskloom.llm.jaccard_join import one_of_each
from maskloom.llm.line_spread import without_boilerplate
from maskloom.llm.mixing import mixed_rows
from maskloom.llm.packing import pack
from maskloom.llm.queries import BYTE_BPE, PIECES
from maskloom.llm.shared import removed, written

#: Word n-grams and percentage of the near-duplicate stage.
SHINGLE = 5
PERCENT = 80


def aside(docs: DataFrame, name: str) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with a column that has the name of a stage's result under a free one, and where each column now is."""
    free = name
    while free in docs.columns:
        free += "_"
    return docs.withColumnRenamed(name, free), {c: free if c == name else c for c in docs.columns}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, at = aside(docs, "_q")
    found = judged(rows, public_tokenizers.path(PIECES)).filter("_q.kept")
    return found.select(*(F.col(f"`{k}`").alias(c) for c, k in at.items()))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without boilerplate lines; a document of which no word remains goes."""
    kept = F.col("_lines.kept")
    changed = F.col("_lines.n_removed") > 0
    n_chars = F.when(changed, F.length(kept).cast("long")).otherwise(F.col("n_chars"))
    columns = {"text": kept.alias("text"), "n_chars": n_chars.alias("n_chars")}
    rows, at = aside(docs, "_lines")
    found = without_boilerplate(rows).filter(~changed | kept.rlike(r"[^\x20\x09-\x0D]"))
    return found.select(*(columns.get(c, F.col(f"`{k}`").alias(c)) for c, k in at.items()))


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, n=SHINGLE, percent=PERCENT)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path(BYTE_BPE))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicate_join),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]

#: Tokenizers and the links of near copies have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`; what packing returns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            removed(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_dedup as lines
from tidemark.llm import mixing, ngram_join, packing
from tidemark.llm import quality_rules as rules
from tidemark.llm.common import delete, scratch, shared_dir, words_of, written
from tidemark.llm.queries import tokenizer_path

#: No source is repeated more often than this, and every document comes once at least.
MOST_REPEATS = 2.0


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects; null and empty texts fail, as they have fewer than ten words."""
    return rules.keep(docs)


def apart(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its own columns of some names under others, which an operator's columns can't clash with; and what these stand for."""
    own = {f"_own_{c}": c for c in names if c in docs.columns}
    return docs.withColumnsRenamed({c: k for k, c in own.items()}), own


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are later matches; a document left without a word by that goes, as a copy.

    Null and empty texts stay as they are; a repeated row loses its lines to the first one of them; ``n_chars`` follows the text where there is such a column.
    """
    rows, own = apart(docs, ("removed_lines",))
    out = lines.dedup(rows)
    whole = F.size("removed_lines") == 0
    kept = out.where(whole | (F.size(words_of(F.col("text"))) > 0))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return kept.drop("removed_lines").withColumnsRenamed(own).select(docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: that of the smallest id. Texts without words link with nothing, and rows without an id stay."""
    return ngram_join.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, those of small sources more often, as evenly as the repetition limit allows. A null source is one of its own."""
    rows, own = apart(docs, ("n_words", "copy", "order_key"))
    mixed = mixing.mix(rows, entropy_share=None, limit=MOST_REPEATS, budget_share=None)
    return mixed.select(rows.columns).withColumnsRenamed(own)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences. Null and empty texts are their end mark; repeated rows are packed as often as they come."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("source_mixing", source_mixing),
    ("packing", sequence_packing),
]
#: SQL can express neither the line join at these sizes nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``. What a stage wrote on its way is deleted when its documents are written, and so are these when the next stage's are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            written(stage(spark, docs, sf_dir), path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

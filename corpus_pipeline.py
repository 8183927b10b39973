"""The corpus pipeline: quality rules, near-dedup, repeated passages, mixing, packing.

``run`` applies the stages to ``documents``; each stage is written as Parquet
in the shared checkpoint folder and read again as the next one's documents.

Edge cases of every stage: a null or empty text fails the quality rules; after
them it is a copy of nothing, has no repeated string and is packed as its end
token.  Rows that share an id are documents of their own to the quality rules,
the near-dedup (equal texts are one), the mix and packing, and one document to
the repeated passages.  Null ids, sources, languages and counts are kept as they
are; an empty table gives an empty table; columns besides those of ``documents``
are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagefuse.llm import minhash, mixing, packing, quality, suffix_array
from pagefuse.llm.common import table, written

#: Columns of ``documents``; every stage but the last returns them.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The column that the mixing stage adds and packing follows.
POSITION = "mix_position"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy of the rule ledger keeps."""
    return quality.kept_documents(docs.select(*COLUMNS), quality.V1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8."""
    return minhash.one_of_each(docs.select(*COLUMNS), shingle=5, percent=80, bands=24, rows=4)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes or more that a document with a smaller id holds.

    A document stays, with what is left of it; one that is all repeated has an empty text.
    """
    return suffix_array.removed(docs.select(*COLUMNS), length=200)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the Pfair mix (``mix_position``), written in its order."""
    return mixing.in_mix_order(docs.select(*COLUMNS), position=POSITION)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in length buckets; batches fill in the order of the mix.

    Documents that were not mixed have no ``mix_position`` and come in order of a hash of the id.
    """
    order = [POSITION] if POSITION in docs.columns else []
    lengths = packing.encoded(docs.select("doc_id", "text", *order))
    return packing.packed(lengths, order=POSITION if order else None, length_col="n_tokens")


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: SQL can't express the suffix array, the schedule and the dynamic program; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline in five stages over the documents table.

Each stage gets what its predecessor kept, written as Parquet and read again. All stages treat null texts as empty and
take texts whole, whatever their length; an empty table gives an empty result; columns with other names pass through the
first four stages, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.exact_dedup import drop_exact_copies
from tessella.llm.language_id import keep_identified
from tessella.llm.mixing import mix
from tessella.llm.packing import pack_documents
from tessella.llm.simhash_dedup import drop_near_copies
from tessella.llm.tables import table
from tessella.plans.storage import stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determinable language go: null and empty texts, those without letters, and those where no language is likelier
    than all others together. Labels that are null are no labels; repeated rows are judged alike."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays; null ids lose, of repeated rows one stays."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose 5-word shingles have a similarity of 0.8 or more, and those that such links join, the document with the smallest id
    stays; null ids lose, of repeated rows one stays, texts without words all stay."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks, 0 to 3 times. A null source is a source; repeated ids go together."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2048 ids; an empty text is its closing id, repeated rows are packed one by one."""
    return pack_documents(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Language models, fingerprints and tokenizers have no SQL form; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs

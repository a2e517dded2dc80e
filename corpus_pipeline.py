"""A training corpus from raw documents: rules, near copies, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; run() writes
each stage as Parquet into the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.dedup import without_copies
from wayline.llm.mixing import mix_sources
from wayline.llm.packing import pack_documents
from wayline.llm.quality import quality_rules
from wayline.llm.repeats import remove_repeats
from wayline.llm.workspace import Workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least similarity of near copies, in percent, and bytes of a passage: 51 short words have about 285.
NEAR, PASSAGE = 80, 250


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within their language's and source's robust bounds.

    Null and empty texts fail the base rules and go. Null ids, languages and sources stay as they are; repeated rows are
    judged alike. An empty table gives no rows; columns other than COLUMNS are left out, in all stages.
    """
    return quality_rules(docs.select(*COLUMNS), carry=True)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of least id, of each group of near copies (Jaccard 0.8 or more of 5-word shingles).

    Rows count, not ids: repeated rows and rows of null or shared ids are copies where their texts are.
    """
    return without_copies(docs.select(*COLUMNS), k=5, percent=NEAR)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of PASSAGE bytes or more that occur more than once; texts may end up empty.

    Null texts count as empty and come out so; of equal texts all lose what is long enough, none being the first.
    An empty table gives no rows.
    """
    return remove_repeats(docs.select(*COLUMNS), size=PASSAGE, carry=True).withColumn("n_chars", F.length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled with probabilities raked to source, language and topic marginals.

    Rows of equal id and cell come or go together, rows without an id by their text; null and empty texts count as
    one token and are drawn like others. An empty table gives no rows.
    """
    return mix_sources(docs.select(*COLUMNS)).where("_chosen").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens as pieces of sequences of 2048.

    Each row makes a piece at least, null and empty texts too; repeated and null ids are rows like others. An
    empty table gives no pieces.
    """
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("suffix_array_dedup", suffix_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: SQL can't express the robust estimates, the tokenizer or the packing: tests/llm/test_pipeline.py has a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir))
    return docs

"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audit import AUDIT_SQL, audit_filters
from .bpe import decode_ids, encode_texts
from .chat import CHAT_SQL, rotate_speakers
from .dedup import near_duplicates
from .fingerprints import fingerprint_edits
from .licenses import scan_licenses
from .mixing import mix_sources, mixing_sql
from .negatives import NEGATIVES_SQL, hard_negatives
from .packing import pack_documents
from .quality import quality_rules
from .ranking import score_quality
from .repeats import remove_repeats
from .toxicity import score_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), k=5, percent=85)


def op7_suffix_array_dedup(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents"), size=400, least=250)  # passages of 51 words: 250 bytes, as in the pipeline
    text = F.make_valid_utf8(F.col("kept").cast("string"))  # a code point that is cut into shows as U+FFFD
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), text.alias("text"), F.col("n_repeated").alias("passage_bytes"), F.col("n_runs").alias("passage_spans"))


def op1_chat_rotation(spark, sf_dir):
    return rotate_speakers(table(spark, sf_dir, "conversations"))


def op2_document_fingerprints(spark, sf_dir):
    out = fingerprint_edits(table(spark, sf_dir, "documents"))
    edited = F.sha2(F.col("edited"), 256).alias("edited_sha256")
    return out.select("doc_id", "n_chars", edited, "fingerprint", "edited_fingerprint", "near_edited", "near_next", "distinct_shingles", "contained_in_edited")


def op5_vector_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), tokens=2048)


def op6_robust_quality_rules(spark, sf_dir):
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def op8_mixing_rake(spark, sf_dir):
    out = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    side = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return out.select("doc_id", side("source"), side("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("_weight", 6).alias("weight"), F.round("_probability", 6).alias("probability"), F.col("_chosen").alias("chosen"))


def op9_toxicity_neighbours(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, fold=0)


def op10_quality_ranking(spark, sf_dir):
    out = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=3, fold=1)
    return out.select("doc_id", "held_out", "score", "predicted", "rank_score")


def op11_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, positives=5, k=10, low=30, high=90, scale=256.0)


def op12_lexicon_bpe(spark, sf_dir):
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    out = encode_texts(table(spark, sf_dir, "documents")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), "ids")
    return decode_ids(out).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_filter_audit(spark, sf_dir):
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_rotation,
        op2_document_fingerprints,
        op3_license_scan,
        op4_minhash_near_dedup,
        op5_vector_packing,
        op6_robust_quality_rules,
        op7_suffix_array_dedup,
        op8_mixing_rake,
        op9_toxicity_neighbours,
        op10_quality_ranking,
        op11_hard_negatives,
        op12_lexicon_bpe,
        op13_filter_audit,
    )
}
#: The others have no SQL form: see their tests.
ORACLE_SQL: dict[str, str] = {"op1_chat_rotation": CHAT_SQL, "op8_mixing_rake": mixing_sql(), "op11_hard_negatives": NEGATIVES_SQL, "op13_filter_audit": AUDIT_SQL}

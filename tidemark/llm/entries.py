"""The queries opN_<name> of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, langid, lm, near_dedup, packing, preference, repeats, toxicity
from .common import table

#: The vocabulary of the BPE queries: its file's name in the folder of public tokenizers.
VOCABULARY_FILE = "byte_bpe_multi_50k.tiktoken"
#: Its pattern has an optional blank before words, digits and signs, so that a single blank begins a match.
BLANK_BEGINS = True


def vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY_FILE), public_tokenizers.PATTERN


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.occurrences(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score_documents(docs, lm.train(docs))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.select("doc_id", "text", "lang").where(~langid.held_out()))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256", F.size("passages").cast("long").alias("n_passages"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents"), *vocabulary(), with_ids=False, blank_begins=BLANK_BEGINS)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), *vocabulary())
    return packed.select("sequence_id", "n_tokens", "n_segments", "cu_seqlens", "doc_ids", "starts", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("position_ids", 256).alias("positions_sha256"))


def op8_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    pairs = preference.format_pairs(conversations, preference.paired_by_id(conversations))
    mask = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["length"].cast("string"), F.when(s["train"], "+").otherwise("-"))), ",").alias(c)
    return pairs.select("pair_id", "chosen_id", "rejected_id", "n_common", "prompt", "chosen", "rejected", mask("chosen_mask"), mask("rejected_mask"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_dedup.near_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", "class_size", "kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = ~toxicity.held_out()
    model = toxicity.train(docs.where(learn), table(spark, sf_dir, "labels").select("doc_id", "toxic").where(learn))
    found = toxicity.scored(docs, model)
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


QUERIES = {q.__name__: q for q in (op1_decontamination, op2_lm_scoring, op3_language_id, op4_repeats, op5_byte_bpe, op6_packing, op7_exact_dedup, op8_preference, op9_near_dedup, op10_toxicity)}
ORACLE_SQL = {"op1_decontamination": decontaminate.ORACLE, "op4_repeats": repeats.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE, "op8_preference": preference.ORACLE}

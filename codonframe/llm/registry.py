"""Queries over the test tables, one per training-data operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from .bpe import encode_documents
from .embedding_dedup import near_duplicates as near_vectors
from .hard_negatives import mine
from .language_id import identify
from .minhash import near_duplicates
from .oracle import oracle_sql as _oracle_sql
from .packing import pack
from .quality_model import score_quality
from .quality_rules import quality_rules
from .shared import in_fold, table
from .suffix_dedup import dedup
from .suffix_tree_lm import score_texts
from .token_alignment import align_documents
from .toxicity import score_toxicity
from .warc import read_records, write_archives

THRESHOLD = 0.7


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_bpe_path() -> str:
    return tokenizer_path("word_bpe_49k.json")


def _predicted():
    return F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")


def op1_warc(spark, sf_dir):
    return read_records(write_archives(table(spark, sf_dir, "pages")))


def op2_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_quality_model(spark, sf_dir):
    held_out = in_fold("doc_id", 4, 2)
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", _predicted())


def op5_suffix_dedup(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    held_out = in_fold("doc_id", 3, 1)
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", _predicted())


def op7_language_id(spark, sf_dir):
    held_out = in_fold("doc_id", 4, 2)
    found = identify(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_bpe(spark, sf_dir):
    return encode_documents(table(spark, sf_dir, "documents"), word_bpe_path())


def op9_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark, sf_dir):
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 9) for c in ("char_distance", "word_distance")})


def op11_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_suffix_tree_lm(spark, sf_dir):
    held_out = in_fold("doc_id", 7, 2)
    found = score_texts(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_token_alignment(spark, sf_dir):
    return align_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def queries():
    first = (op1_warc, op2_minhash, op3_embedding_dedup, op4_quality_model, op5_suffix_dedup, op6_toxicity, op7_language_id, op8_bpe, op9_packing, op10_quality_rules)
    return {f.__name__: f for f in (*first, op11_hard_negatives, op12_suffix_tree_lm, op13_token_alignment)}


def oracle_sql():
    return _oracle_sql()

"""One query for each training-data operator, over the whole of its table."""

from __future__ import annotations

import public_tokenizers

from . import bpe, lm, media, mixing, quality, rules, secrets, simhash, token_counts, toxicity
from .common import crc_remainder, table


def op1_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"), crc_remainder("doc_id", 3) != 1)
    return quality.classify(docs, model).selectExpr("doc_id", "crc32(coalesce(string(doc_id), '')) % 3 = 1 AS held_out", "score", "predicted")


def op2_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_bpe_transducer(spark, sf_dir):
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return rules.apply_rules(docs, rules.learn(docs, table(spark, sf_dir, "labels")))


def op5_secret_scan(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.learn(secrets.labelled_findings(spark)))


def op6_media_containers(spark, sf_dir):
    return media.media_features(table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    network = toxicity.learn(docs, table(spark, sf_dir, "labels"), crc_remainder("doc_id", 5) != 0)
    return toxicity.score_documents(docs, network).selectExpr("doc_id", "crc32(coalesce(string(doc_id), '')) % 5 = 0 AS held_out", "score", "predicted")


def op8_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_language_model(spark, sf_dir):
    return lm.score_documents(table(spark, sf_dir, "documents"), crc_remainder("doc_id", 7) != 2, public_tokenizers.path("word_bpe_49k.json"))


_ALL = (op1_quality_classifier, op2_source_mixing, op3_bpe_transducer, op4_quality_rules, op5_secret_scan, op6_media_containers, op7_toxicity, op8_token_counts, op9_simhash_near_dedup, op10_language_model)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {"op2_source_mixing": mixing.MIX_SQL}

"""One query per operator, with production parameters over its whole table, and the SQL where there is one."""

from __future__ import annotations

from . import chat, fingerprint, mixing, neardup, packing, quality, secrets, sharding, substring, toxicity
from .common import table


def op1_substring_dedup(spark, sf_dir):
    return substring.substring_report(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_chat_formatting(spark, sf_dir):
    return chat.chat_report(
        table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.hard_conversation(spark))
    )


def op4_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark, sf_dir):
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark, sf_dir):
    return neardup.near_classes(table(spark, sf_dir, "documents"))


def op7_document_fingerprints(spark, sf_dir):
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op10_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_toxicity,
        op3_chat_formatting,
        op4_packing,
        op5_secret_scan,
        op6_near_duplicates,
        op7_document_fingerprints,
        op8_source_mixing,
        op9_quality_rules,
        op10_sharding,
    )
}

ORACLE_SQL = {"op3_chat_formatting": chat.ORACLE_SQL, "op8_source_mixing": mixing.ORACLE_SQL}

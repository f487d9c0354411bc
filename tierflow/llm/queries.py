"""Registered queries of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
from tierflow.llm import align, chat, decontaminate, extendible, fim, hyperminhash, oracle, packing, ppm, quality_rules, systematic_mix, topk, warc, weak_label


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark, sf_dir):
    return chat.report(_table(spark, sf_dir, "conversations"))


def op2_hyperminhash_near_dedup(spark, sf_dir):
    return hyperminhash.report(_table(spark, sf_dir, "documents"))


def op3_power_of_two_packing(spark, sf_dir):
    return packing.report(_table(spark, sf_dir, "documents"))


def op4_systematic_mix(spark, sf_dir):
    return systematic_mix.report(_table(spark, sf_dir, "documents"))


def op5_exact_top_k(spark, sf_dir):
    return topk.report(_table(spark, sf_dir, "embeddings"))


def op6_warc(spark, sf_dir):
    return warc.report(_table(spark, sf_dir, "pages"))


def op7_quality_rules(spark, sf_dir):
    return quality_rules.report(_table(spark, sf_dir, "documents"))


def op8_weak_label_quality(spark, sf_dir):
    return weak_label.scored(_table(spark, sf_dir, "documents"))


def op9_extendible_shards(spark, sf_dir):
    return extendible.sharded(_table(spark, sf_dir, "documents"))


def op10_ppm(spark, sf_dir):
    return ppm.scored(_table(spark, sf_dir, "documents"))


def op11_cross_tokenizer_alignment(spark, sf_dir):
    return align.report(_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark, sf_dir):
    return fim.report(_table(spark, sf_dir, "documents"))


def op13_benchmark_decontamination(spark, sf_dir):
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_hyperminhash_near_dedup": op2_hyperminhash_near_dedup,
    "op3_power_of_two_packing": op3_power_of_two_packing,
    "op4_systematic_mix": op4_systematic_mix,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_warc": op6_warc,
    "op7_quality_rules": op7_quality_rules,
    "op8_weak_label_quality": op8_weak_label_quality,
    "op9_extendible_shards": op9_extendible_shards,
    "op10_ppm": op10_ppm,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_benchmark_decontamination": op13_benchmark_decontamination,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {
    "op1_chat_formatting": oracle.CHAT,
    "op2_hyperminhash_near_dedup": oracle.NEAR_DUPLICATES,
    "op4_systematic_mix": oracle.systematic_mix(),
    "op5_exact_top_k": oracle.TOP_K,
    "op6_warc": oracle.WARC,
    "op7_quality_rules": oracle.quality_rules(),
    "op9_extendible_shards": oracle.extendible(extendible.LIMIT),
    "op12_fill_in_middle": oracle.FILL_IN_MIDDLE,
    "op13_benchmark_decontamination": oracle.DECONTAMINATION,
}

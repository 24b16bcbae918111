"""Queries of this subpackage and, where DuckDB can express them on whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embeddings, funnel, hmm, langid, license, lloyd, media, mixing, packing, simhash, substring, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jpeg_media": media.op1_jpeg_media,
    "op2_substring_dedup": substring.op2_substring_dedup,
    "op3_license_templates": license.op3_license_templates,
    "op4_minimum_bin_slack_packing": packing.op4_minimum_bin_slack_packing,
    "op5_hmm_language_model": hmm.op5_hmm_language_model,
    "op6_byte_gru_language_id": langid.op6_byte_gru_language_id,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_rotated_code_near_dedup": embeddings.op8_rotated_code_near_dedup,
    "op9_temperature_mixing": mixing.op9_temperature_mixing,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_funnels": funnel.op11_funnels,
    "op12_warc": warc.op12_warc,
    "op13_lloyd_clusters": lloyd.op13_lloyd_clusters,
}

ORACLES: dict[str, str] = {"op11_funnels": funnel.ORACLE, "op12_warc": warc.ORACLE, "op13_lloyd_clusters": lloyd.ORACLE}

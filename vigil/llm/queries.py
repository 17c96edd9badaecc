"""Registered queries of the package: opN_<name> over the whole intended table, and SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, lattice_lm, license_scan, line_dedup, merkle_manifest, near_dedup, packing, periodic_runs, quality_rules, sharding, substring_dedup, suffix_dedup, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": suffix_dedup.op1,
    "op2_license_scan": license_scan.op2,
    "op3_lattice_lm": lattice_lm.op3,
    "op4_url_filter": url_filter.op4,
    "op5_packing": packing.op5,
    "op6_decontamination": decontaminate.op6,
    "op7_substring_dedup": substring_dedup.op7,
    "op8_sharding": sharding.op8,
    "op9_near_dedup": near_dedup.op9,
    "op10_quality_rules": quality_rules.op10,
    "op11_merkle_manifest": merkle_manifest.op11,
    "op12_line_dedup": line_dedup.op12,
    "op13_periodic_runs": periodic_runs.op13,
}
ORACLE: dict[str, str] = {"op4_url_filter": url_filter.OP4_SQL, "op11_merkle_manifest": merkle_manifest.OP11_SQL, "op12_line_dedup": line_dedup.OP12_SQL}

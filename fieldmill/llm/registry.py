"""Queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op01_pii import op1_pii
from .op02_fingerprints import op2_fingerprints
from .op03_secret_scans import op3_secret_scans
from .op04_media import op4_media
from .op05_simhash import op5_simhash
from .op06_language_id import op6_language_id
from .op07_url_filters import ORACLE_OP7, op7_url_filters
from .op08_bpe import op8_bpe
from .op09_mixing import op9_mixing
from .op10_sharding import op10_sharding
from .op11_period_runs import op11_period_runs
from .op12_passage_quality import op12_passage_quality
from .op13_filter_audit import ORACLE_OP13, op13_filter_audit

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_fingerprints": op2_fingerprints,
    "op3_secret_scans": op3_secret_scans,
    "op4_media": op4_media,
    "op5_simhash": op5_simhash,
    "op6_language_id": op6_language_id,
    "op7_url_filters": op7_url_filters,
    "op8_bpe": op8_bpe,
    "op9_mixing": op9_mixing,
    "op10_sharding": op10_sharding,
    "op11_period_runs": op11_period_runs,
    "op12_passage_quality": op12_passage_quality,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {"op7_url_filters": ORACLE_OP7, "op13_filter_audit": ORACLE_OP13}

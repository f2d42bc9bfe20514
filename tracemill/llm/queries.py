"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import decontamination, license_scan, sharding, suffix_dedup
from tracemill.llm.decontamination import op3_decontamination
from tracemill.llm.html_extract import op4_html_extract
from tracemill.llm.license_scan import op2_license_scan
from tracemill.llm.packing import op9_packing
from tracemill.llm.pfor import op6_pfor
from tracemill.llm.pii import op10_pii
from tracemill.llm.sharding import op5_sharding
from tracemill.llm.suffix_dedup import op1_suffix_dedup
from tracemill.llm.superminhash import op7_superminhash
from tracemill.llm.weak_quality import op8_weak_quality

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_decontamination": op3_decontamination,
    "op4_html_extract": op4_html_extract,
    "op5_sharding": op5_sharding,
    "op6_pfor": op6_pfor,
    "op7_superminhash": op7_superminhash,
    "op8_weak_quality": op8_weak_quality,
    "op9_packing": op9_packing,
    "op10_pii": op10_pii,
}

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": suffix_dedup.sql(),
    "op2_license_scan": license_scan.sql(),
    "op3_decontamination": decontamination.sql(),
    "op5_sharding": sharding.sql(),
}

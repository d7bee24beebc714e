"""The registered queries of this subpackage, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .bpe import op10_bpe
from .decontaminate import op6_decontaminate
from .fingerprint import op8_fingerprint
from .language_id import op4_language_id
from .near_duplicates import op9_near_duplicates
from .pii import op5_pii
from .substring_dedup import op1_substring_dedup
from .toxicity import op2_toxicity
from .url_filter import op3_url_filter
from .warc import op7_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_url_filter": op3_url_filter,
    "op4_language_id": op4_language_id,
    "op5_pii": op5_pii,
    "op6_decontaminate": op6_decontaminate,
    "op7_warc": op7_warc,
    "op8_fingerprint": op8_fingerprint,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_bpe": op10_bpe,
}
ORACLES: dict[str, str] = {
    "op1_substring_dedup": oracles.OP1,
    "op3_url_filter": oracles.OP3,
    "op6_decontaminate": oracles.OP6,
    "op7_warc": oracles.OP7,
    "op9_near_duplicates": oracles.OP9,
}

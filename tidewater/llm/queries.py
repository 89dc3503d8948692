"""The registered queries of this subpackage, one an operator, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import op3_byte_bpe
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .language_model import op8_language_model
from .media import op2_media
from .near_dedup import op6_near_dedup
from .packing import op10_packing
from .pii import op9_pii
from .quality import op5_quality
from .secrets import OP1_SQL, op1_secrets
from .token_counts import op7_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_media": op2_media,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality": op5_quality,
    "op6_near_dedup": op6_near_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_language_model": op8_language_model,
    "op9_pii": op9_pii,
    "op10_packing": op10_packing,
}

ORACLE_SQL: dict[str, str] = {"op1_secrets": OP1_SQL, "op4_exact_dedup": OP4_SQL}

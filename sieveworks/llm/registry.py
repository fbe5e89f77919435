"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .mixing import op7_mixing
from .packing import op2_packing
from .preferences import OP9_SQL, op9_preferences
from .quality import op8_quality
from .secrets import op10_secrets
from .simhash import op4_simhash
from .spotsigs import op1_spotsigs
from .topk import OP6_SQL, op6_topk
from .toxicity import op5_toxicity
from .urls import op3_urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_spotsigs": op1_spotsigs,
        "op2_packing": op2_packing,
        "op3_urls": op3_urls,
        "op4_simhash": op4_simhash,
        "op5_toxicity": op5_toxicity,
        "op6_topk": op6_topk,
        "op7_mixing": op7_mixing,
        "op8_quality": op8_quality,
        "op9_preferences": op9_preferences,
        "op10_secrets": op10_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_topk": OP6_SQL, "op9_preferences": OP9_SQL}

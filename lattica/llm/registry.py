"""The queries of the training-data operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import op8_byte_bpe
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .fill_in_middle import OP13_SQL, op13_fill_in_middle
from .language_id import op3_language_id
from .licenses import op4_license_scan
from .near_dedup import OP2_SQL, op2_near_dedup
from .packing import op1_best_fit_packing
from .quality import op10_quality
from .quality_rules import OP12_SQL, op12_quality_rules
from .ranked_search import OP11_SQL, op11_ranked_search
from .topk import OP9_SQL, op9_exact_top_k
from .url_filter import OP6_SQL, op6_url_filter
from .warc import OP5_SQL, op5_warc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_near_dedup": op2_near_dedup,
    "op3_language_id": op3_language_id,
    "op4_license_scan": op4_license_scan,
    "op5_warc": op5_warc,
    "op6_url_filter": op6_url_filter,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_quality": op10_quality,
    "op11_ranked_search": op11_ranked_search,
    "op12_quality_rules": op12_quality_rules,
    "op13_fill_in_middle": op13_fill_in_middle,
}

#: The others are models, iterations or libraries' own results: their tests hold them
#: against brute force, round trips and held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op2_near_dedup": OP2_SQL,
    "op5_warc": OP5_SQL,
    "op6_url_filter": OP6_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op9_exact_top_k": OP9_SQL,
    "op11_ranked_search": OP11_SQL,
    "op12_quality_rules": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}

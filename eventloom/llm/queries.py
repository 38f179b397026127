"""The queries of this subpackage, and their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from .bpe import op6_byte_bpe
from .line_dedup import op3_fuzzy_line_dedup
from .media import op9_media_columns
from .near_dups import op2_bagminhash_near_dups
from .packing import op5_cost_balanced_packing
from .pii import op10_bootstrapped_pii
from .quality_gam import op8_gam_quality
from .quality_rules import op1_quality_rules
from .secrets import op7_markov_secret_scan
from .toxicity import op4_nearest_toxicity

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_bagminhash_near_dups, op3_fuzzy_line_dedup, op4_nearest_toxicity, op5_cost_balanced_packing, op6_byte_bpe, op7_markov_secret_scan, op8_gam_quality, op9_media_columns, op10_bootstrapped_pii)}

ORACLE_SQL: dict[str, str] = {}

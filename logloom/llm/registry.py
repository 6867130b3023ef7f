"""Queries of this folder, for the entry module."""

from __future__ import annotations

from .line_dedup import op7_line_dedup
from .lm_scoring import op4_lm_scoring
from .manifest import ORACLE as MERKLE_SQL
from .manifest import op13_merkle
from .mixing import op3_mixing
from .near_dedup import op8_near_dedup
from .packing import op5_packing
from .private_data import op6_private_data
from .quality_classifier import op2_quality
from .quality_rules import op10_quality_rules
from .simhash import op12_simhash
from .spelling import ORACLE as SPELLING_SQL
from .spelling import op11_spelling
from .topk import ORACLE as TOPK_SQL
from .topk import op1_topk
from .toxicity import op9_toxicity

QUERIES = {
    "op1_topk": op1_topk,
    "op2_quality": op2_quality,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_packing": op5_packing,
    "op6_private_data": op6_private_data,
    "op7_line_dedup": op7_line_dedup,
    "op9_toxicity": op9_toxicity,
    "op3_mixing": op3_mixing,
    "op8_near_dedup": op8_near_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_spelling": op11_spelling,
    "op12_simhash": op12_simhash,
    "op13_merkle": op13_merkle,
}

ORACLE_SQL: dict[str, str] = {"op1_topk": TOPK_SQL, "op11_spelling": SPELLING_SQL, "op13_merkle": MERKLE_SQL}

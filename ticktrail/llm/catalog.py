"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .language import op7_language
from .line_dedup import OP6_SQL, op6_line_dedup
from .mixing import op1_mixing
from .ngram_join import op2_ngram_join
from .packing import op3_packing
from .quality_cnn import op5_quality
from .quality_rules import ABLATIONS_SQL, OP8_SQL, op8_quality_rules, rule_ablations
from .topk import OP9_SQL, op9_topk
from .toxicity import op4_toxicity
from .url_filter import OP10_SQL, op10_url_filter

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_ngram_join": op2_ngram_join,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_line_dedup": op6_line_dedup,
    "op7_language": op7_language,
    "op8_quality_rules": op8_quality_rules,
    "op9_topk": op9_topk,
    "op10_url_filter": op10_url_filter,
    "rule_ablations": rule_ablations,
}
ORACLES = {
    "op6_line_dedup": OP6_SQL,
    "op8_quality_rules": OP8_SQL,
    "op9_topk": OP9_SQL,
    "op10_url_filter": OP10_SQL,
    "rule_ablations": ABLATIONS_SQL,
}

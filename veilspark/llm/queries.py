"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import fingerprint, jaccard_join, language, line_dedup, lm_score, mixing, nearest, packing, quality, url_filter

QUERIES = {
    f.__name__: f
    for f in (
        line_dedup.op1_line_dedup, mixing.op2_mixing, jaccard_join.op3_jaccard_join, fingerprint.op4_fingerprints, packing.op5_packing,
        language.op6_language, quality.op7_quality, nearest.op8_nearest, url_filter.op9_url_filter, lm_score.op10_lm_score,
    )
}
ORACLES = {"op2_mixing": mixing.ORACLE, "op9_url_filter": url_filter.ORACLE}

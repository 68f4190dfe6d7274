"""Registered queries of this subpackage and, where SQL can say them, their DuckDB twins."""

from __future__ import annotations

from . import counts, decontaminate, fingerprint, fixity, jaccard, negatives, packing, passages, pii, quality, search, secrets, tokenfiles

QUERIES = {
    "op1_repeated_passages": passages.op1_repeated_passages,
    "op2_jaccard_join": jaccard.op2_jaccard_join,
    "op3_quality": quality.op3_quality,
    "op4_fingerprints": fingerprint.op4_fingerprints,
    "op5_token_files": tokenfiles.op5_token_files,
    "op6_token_rollups": counts.op6_token_rollups,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_personal_data": pii.op8_personal_data,
    "op9_fixity_audit": fixity.op9_fixity_audit,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_secret_scan": secrets.op12_secret_scan,
    "op13_ranked_search": search.op13_ranked_search,
}
ORACLES: dict[str, str] = {"op9_fixity_audit": fixity.OP9_SQL, "op10_decontamination": decontaminate.OP10_SQL,
                           "op11_hard_negatives": negatives.OP11_SQL, "op13_ranked_search": search.OP13_SQL}

"""Queries of this subpackage: one opN_<name> for each operator, and the pipeline."""

from __future__ import annotations

from .media import op7_chroma_alignment
from .merkle import ORACLE as MERKLE
from .merkle import op4_merkle_fingerprints
from .mixing import ORACLE as MIXING
from .mixing import op10_pfair_mixing
from .near_dedup import ORACLE as NEAR_DEDUP
from .near_dedup import op3_minhash_near_dedup
from .packing import op6_harmonic_packing
from .quality import op9_quality_rules
from .secrets import op2_secret_scan
from .substring_dedup import op1_substring_dedup
from .token_rollup import ORACLE as TOKEN_ROLLUP
from .token_rollup import op8_token_rollup
from .toxicity import op5_toxicity_kneser_ney

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_merkle_fingerprints": op4_merkle_fingerprints,
    "op5_toxicity_kneser_ney": op5_toxicity_kneser_ney,
    "op6_harmonic_packing": op6_harmonic_packing,
    "op7_chroma_alignment": op7_chroma_alignment,
    "op8_token_rollup": op8_token_rollup,
    "op9_quality_rules": op9_quality_rules,
    "op10_pfair_mixing": op10_pfair_mixing,
}

#: DuckDB SQL, where SQL can express the operator.
ORACLES = {"op3_minhash_near_dedup": NEAR_DEDUP, "op4_merkle_fingerprints": MERKLE, "op8_token_rollup": TOKEN_ROLLUP, "op10_pfair_mixing": MIXING}

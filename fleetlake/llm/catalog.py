"""The registered queries of this package and their DuckDB twins.

SQL has no twin for edit distance, learnt scores, crc32 folds, merges or digests; tests/llm holds those queries against brute force.
"""

from __future__ import annotations

from fleetlake.llm import bpe, decontaminate, fingerprint, katz, language, licenses, near, neighbours, oracle, quality, ranking, repeats, secrets, whitening

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_quality": quality.query,
    "op3_katz": katz.query,
    "op4_language": language.query,
    "op5_near_duplicates": near.query,
    "op6_secrets": secrets.query,
    "op7_licenses": licenses.query,
    "op8_bpe": bpe.query,
    "op9_repeats": repeats.query,
    "op10_fingerprint": fingerprint.query,
    "op11_ranking": ranking.query,
    "op12_whitening": whitening.query,
    "op13_neighbours": neighbours.query,
}
ORACLE = {"op5_near_duplicates": oracle.NEAR, "op9_repeats": oracle.REPEATS, "op11_ranking": oracle.RANKED}

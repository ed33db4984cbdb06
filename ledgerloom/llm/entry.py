"""The queries of this subpackage and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from ledgerloom.llm import audio, bpe, jaccard, licenses, mixture, neighbours, secrets, suffixes, topk, toxicity, urls, variants, whitening

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_url_filter": urls.op2_url_filter,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_topk": topk.op4_topk,
    "op5_audio_fingerprints": audio.op5_audio_fingerprints,
    "op6_suffix_dedup": suffixes.op6_suffix_dedup,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_bpe": bpe.op9_bpe,
    "op10_mixture": mixture.op10_mixture,
    "op11_spelling_variants": variants.op11_spelling_variants,
    "op12_neighbours": neighbours.op12_neighbours,
    "op13_whitening": whitening.op13_whitening,
}
ORACLE_SQL = {
    "op2_url_filter": urls.OP2_SQL,
    "op3_jaccard_join": jaccard.OP3_SQL,
    "op4_topk": topk.OP4_SQL,
    "op10_mixture": mixture.OP10_SQL,
    "op11_spelling_variants": variants.OP11_SQL,
}

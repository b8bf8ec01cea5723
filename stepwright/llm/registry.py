"""The corpus queries and their oracle SQL."""

from __future__ import annotations

from . import bpe, divergence, exact, licences, linejoin, linkrank, mixing, quality, setjoin, simhash, spans, spelling, toxicity

QUERIES = {
    "op1_linkrank": linkrank.query,
    "op2_toxicity": toxicity.query,
    "op3_linejoin": linejoin.query,
    "op4_bpe": bpe.query,
    "op5_spans": spans.query,
    "op6_licences": licences.query,
    "op7_simhash": simhash.query,
    "op8_quality": quality.query,
    "op9_exact": exact.query,
    "op10_mixing": mixing.query,
    "op11_spelling": spelling.query,
    "op12_divergence": divergence.query,
    "op13_setjoin": setjoin.query,
    "quality_ablations": quality.query_ablations,
}
ORACLES = {
    "op1_linkrank": linkrank.oracle(),
    "op8_quality": quality.ORACLE,
    "op9_exact": exact.ORACLE,
    "op11_spelling": spelling.ORACLE,
    "op12_divergence": divergence.ORACLE,
    "op13_setjoin": setjoin.ORACLE,
    "quality_ablations": quality.ORACLE_ABLATIONS,
}

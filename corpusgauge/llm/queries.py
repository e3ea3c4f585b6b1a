"""The registered queries of this package and, where SQL can say it, their oracles."""

from __future__ import annotations

from corpusgauge.llm import (
    alignment, arc, bpe, collocations, host_rules, jaccard, licenses, line_dedup, mixing, order_minhash, quality, suffixes, token_files,
)

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_arc_to_warc": arc.op2_arc_to_warc,
    "op3_mixing": mixing.op3_mixing,
    "op4_host_rules": host_rules.op4_host_rules,
    "op5_suffixes": suffixes.op5_suffixes,
    "op6_licenses": licenses.op6_licenses,
    "op7_jaccard": jaccard.op7_jaccard,
    "op8_order_minhash": order_minhash.op8_order_minhash,
    "op9_token_files": token_files.op9_token_files,
    "op10_bpe": bpe.op10_bpe,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_collocations": collocations.op12_collocations,
    "op13_alignment": alignment.op13_alignment,
}

ORACLES = {
    "op2_arc_to_warc": arc.arc_to_warc_sql(),
    "op3_mixing": mixing.mixing_sql(),
    "op4_host_rules": host_rules.host_rules_sql(),
    "op6_licenses": licenses.licenses_sql(),
    "op11_line_dedup": line_dedup.line_dedup_sql(),
    "op12_collocations": collocations.collocations_sql(),
}

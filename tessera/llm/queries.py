"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm import bpe, classifier, exactdedup, fim, html, linededup, mixing, neardup, periodic, pii, rules, secrets, topk

QUERIES = {
    "op1_exact_top_k": topk.op1_exact_top_k,
    "op2_source_mixture": mixing.op2_source_mixture,
    "op3_pii_surrogates": pii.op3_pii_surrogates,
    "op4_line_dedup": linededup.op4_line_dedup,
    "op5_minhash_near_dedup": neardup.op5_minhash_near_dedup,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_quality_classifier": classifier.op8_quality_classifier,
    "op9_quality_rules": rules.op9_quality_rules,
    "op10_html_main_text": html.op10_html_main_text,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_exact_dedup": exactdedup.op12_exact_dedup,
    "op13_periodic_runs": periodic.op13_periodic_runs,
    "line_dedup_texts": linededup.line_dedup_texts,
}
SQL = {**topk.SQL, **neardup.SQL, **rules.SQL, **fim.SQL, **exactdedup.SQL, **periodic.SQL}

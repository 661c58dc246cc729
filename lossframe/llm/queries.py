"""The registered queries of the corpus operators, and their SQL for DuckDB."""

from __future__ import annotations

from lossframe.llm import (alignment, bpe, decontaminate, exact_dedup, filter_audit, html_text, language, pieces, pii, quality, simhash, toxicity,
                           url_filter)

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_simhash": simhash.op3_simhash,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_language": language.op5_language,
    "op6_html_text": html_text.op6_html_text,
    "op7_pii": pii.op7_pii,
    "op8_bpe": bpe.op8_bpe,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_quality": quality.op10_quality,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_pieces": pieces.op12_pieces,
    "op13_alignment": alignment.op13_alignment,
}
ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op4_url_filter": url_filter.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
}

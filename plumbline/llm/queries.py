"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from plumbline.llm import (
    alignment,
    decontaminate,
    exact_dedup,
    html_extract,
    line_dedup,
    near_dedup,
    packing,
    pii,
    quality,
    token_counts,
    training_order,
    warc,
    whitening,
)

QUERIES = {
    "op1_html_extraction": html_extract.op1_html_extraction,
    "op2_minhash_near_dedup": near_dedup.op2_minhash_near_dedup,
    "op3_pii": pii.op3_pii,
    "op4_benchmark_decontamination": decontaminate.op4_benchmark_decontamination,
    "op5_training_order": training_order.op5_training_order,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_packing": packing.op8_packing,
    "op9_warc": warc.op9_warc,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_whitening": whitening.op11_whitening,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_token_counts": token_counts.op13_token_counts,
}
ORACLES = {"op9_warc": warc.OP9_SQL, "op10_exact_dedup": exact_dedup.OP10_SQL}

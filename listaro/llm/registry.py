"""The queries of this subpackage, by name."""

from __future__ import annotations

import corpus_pipeline
from listaro.llm import byte_bpe, centroids, exact_dedup, fingerprints, html_extraction, packing, quality, simhash, substring_dedup, token_files, toxicity, vector_codes, warc


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_byte_bpe": byte_bpe.op2_byte_bpe,
        "op3_packing": packing.op3_packing,
        "op4_token_files": token_files.op4_token_files,
        "op5_quality": quality.op5_quality,
        "op6_html_extraction": html_extraction.op6_html_extraction,
        "op7_simhash": simhash.op7_simhash,
        "op8_suffix_array": substring_dedup.op8_suffix_array,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_fingerprints": fingerprints.op10_fingerprints,
        "op11_warc": warc.op11_warc,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_centroids": centroids.op13_centroids,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.OP1_SQL,
        "op3_packing": packing.OP3_SQL,
        "op8_suffix_array": substring_dedup.OP8_SQL,
        "op11_warc": warc.OP11_SQL,
        "op12_vector_codes": vector_codes.OP12_SQL,
        "op13_centroids": centroids.OP13_SQL,
    }

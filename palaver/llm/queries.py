"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from palaver.llm import ann, bpe, decontaminate, fim, langid, maxent, minhash, secrets, sitetree, toxicity, urls, warc, whiten


def queries() -> dict[str, Callable]:
    return {
        "op1_byte_bpe": bpe.op1_byte_bpe,
        "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
        "op3_url_filters": urls.op3_url_filters,
        "op4_nearest_neighbours": ann.op4_nearest_neighbours,
        "op5_minhash_near_dedup": minhash.op5_minhash_near_dedup,
        "op6_language_id": langid.op6_language_id,
        "op7_warc": warc.op7_warc,
        "op8_secret_scans": secrets.op8_secret_scans,
        "op9_lm_scoring": maxent.op9_lm_scoring,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_fill_in_middle": fim.op11_fill_in_middle,
        "op12_html_extraction": sitetree.op12_html_extraction,
        "op13_embedding_whitening": whiten.op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those that SQL can express."""
    return {
        "op3_url_filters": urls.SQL,
        "op7_warc": warc.SQL,
        "op11_fill_in_middle": fim.SQL,
    }

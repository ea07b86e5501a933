"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, bpe, html_text, line_dedup, mixing, pii, quality, simhash, toxicity, url_filter


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_line_dedup": line_dedup.query,
        "op2_bpe": bpe.query,
        "op3_toxicity": toxicity.query,
        "op4_html_text": html_text.query,
        "op5_mixing": mixing.query,
        "op6_ann": ann.query,
        "op7_quality": quality.query,
        "op8_simhash": simhash.query,
        "op9_pii": pii.query,
        "op10_url_filter": url_filter.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_url_filter": url_filter.sql()}  # the others hash, train or decode beyond SQL; tests/llm has brute force

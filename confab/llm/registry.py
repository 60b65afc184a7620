"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from confab.llm import ann, bpe, centroids, exact_dedup, mixing, ngram_join, packing, quality, resampling, secret_scans, substring_dedup, url_filters, warc

QUERIES = {
    "op1_ann": ann.op1_ann,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality": quality.op3_quality,
    "op4_url_filters": url_filters.op4_url_filters,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_warc": warc.op7_warc,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_secrets": secret_scans.op9_secrets,
    "op10_bpe": bpe.op10_bpe,
    "op11_centroids": centroids.op11_centroids,
    "op12_packing": packing.op12_packing,
    "op13_resampling": resampling.op13_resampling,
}

ORACLES = {
    "op4_url_filters": url_filters.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op6_substring_dedup": substring_dedup.ORACLE,
    "op7_warc": warc.ORACLE,
    "op8_ngram_join": ngram_join.ORACLE,
}

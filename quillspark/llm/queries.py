"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from quillspark.llm import ann, embedding_dedup, license_scan, mixing, sentencepiece_codec, simhash, substring_dedup, toxicity, url_filter, warc

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.query,
    "op2_license_scan": license_scan.query,
    "op3_url_filter": url_filter.query,
    "op4_warc": warc.query,
    "op5_sentencepiece": sentencepiece_codec.query,
    "op6_toxicity": toxicity.query,
    "op7_mixing": mixing.query,
    "op8_simhash": simhash.query,
    "op9_substring_dedup": substring_dedup.query,
    "op10_nearest_neighbours": ann.query,
}

ORACLE_SQL = {
    "op1_embedding_dedup": embedding_dedup.ORACLE,
    "op2_license_scan": license_scan.ORACLE,
    "op3_url_filter": url_filter.ORACLE,
    "op4_warc": warc.ORACLE,
    "op9_substring_dedup": substring_dedup.ORACLE,
}

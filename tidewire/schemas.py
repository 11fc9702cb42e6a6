"""Declared schemas; nothing is inferred."""

from __future__ import annotations

CAPTURE = (
    "capture_id string, doc_id string, title string, text string, language string, url string, canonical_url string, domain string, "
    "source_type string, discovery_channel string, fetch_ts timestamp, observed_ts timestamp, published_ts timestamp, content_hash string, robots_decision string"
)
RECORD = (
    "capture_id string, doc_id string, title string, text_excerpt string, published_ts timestamp, domain string, language string, url string, "
    "is_finance_relevant boolean, finance_relevance_score double, asset_classes array<string>, impact_reason_codes array<string>, "
    "candidate_symbols array<string>, candidate_entities array<string>, impact_horizons array<string>, sentiment_label string, sentiment_score double, "
    "evidence_sentences array<string>, reason_text string, component_scores map<string,double>, diagnostic_multimodal_enabled boolean, "
    "diagnostic_multimodal_result string, processing_mode string, model_versions map<string,string>, created_at timestamp"
)
REVIEW = (
    "capture_id string, reviewer_id string, reviewer_version string, payload struct<is_finance_relevant:boolean,finance_relevance_score:double,"
    "asset_classes:array<string>,impact_reason_codes:array<string>,candidate_symbols:array<string>,sentiment_label:string,sentiment_score:double,"
    "evidence_sentences:array<string>,reason_text:string>, input_tokens int, output_tokens int, usd_cost double, latency_ms int, created_at timestamp, error_code string"
)
HOLDING = "id bigint, symbol string, label string, shares double, weight double, cost_basis double, notes string, added_at timestamp"
QUOTE = "symbol string, last double, prev_close double, error_code string"
TAG = "capture_id string, tag string, created_at timestamp"

#: The five label lists of a record and the name of each in the label index.
LABEL_LISTS = {"asset_class": "asset_classes", "reason_code": "impact_reason_codes", "symbol": "candidate_symbols", "entity": "candidate_entities", "horizon": "impact_horizons"}

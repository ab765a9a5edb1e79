"""Fixed schemas of the tables, as DDL; never inferred."""

from __future__ import annotations

FILES = "path string, display_name string, document_type string, size bigint, sha256 string, mtime_ms double, error_code string"
PARTS = "doc_id string, ord int, name string, contents binary, is_dir boolean, method int, flags int, mode int, size bigint, compressed_size bigint"
STYLES = "doc_id string, style_id string, name string, outline int"
TEXT_ITEMS = "doc_id string, page int, ord int, x double, y double, width double, height double, font_size double, text string"
NODES = "doc_id string, pos bigint, node_id string, kind string, level int, text string, label string, page int, bbox struct<x:double,y:double,width:double,height:double>, excerpt string, digest string"
FACTS = "doc_id string, kind string, ord int, node_id string, value string, normalized string, excerpt string"
ANCHOR = "struct<document:string,nodeId:string,label:string,excerpt:string>"
FINDINGS = f"pair_id string, id string, ord int, type string, severity string, confidence double, summary string, tender_evidence array<{ANCHOR}>, bid_evidence array<{ANCHOR}>, suggestion string, source string, status string"
OCCURRENCES = "doc_id string, part string, locator string, pos int, field string, category string, value_type string, action string, replacement_kind string, original_value string, date_role string"
DIAGNOSTICS = "timestamp timestamp, appVersion string, runtime string, os string, taskType string, stage string, code string, detailId string, systemCategory string"
AI_REVIEW = f"findings array<struct<type:string,severity:string,confidence:double,summary:string,suggestion:string,tenderEvidence:array<{ANCHOR}>,bidEvidence:array<{ANCHOR}>>>"

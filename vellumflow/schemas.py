"""Schemas of the stored tables and of the records that come in."""

from __future__ import annotations

PAPERS = (
    "arxiv_id string, versioned_id string, version int, title string, abstract string, authors array<string>, "
    "affiliations map<string,array<string>>, categories array<string>, primary_category string, published_at timestamp, "
    "updated_at timestamp, abs_url string, pdf_url string, doi string, journal_ref string, comment string, pdf_path string, "
    "text_path string, last_error string, created_at timestamp, last_seen_at timestamp"
)
EVIDENCE = "struct<field:string,value:string,statement:string>"
ENVELOPE = (
    "struct<claim:string,claim_type:string,direction:string,comparators:array<string>,evaluation_contexts:array<string>,"
    "metrics:array<string>,reported_values:array<string>,effect_sizes:array<string>,uncertainty:array<string>,"
    "conditions:array<string>,paper_level_boundaries:array<string>,"
    "evidence:struct<source:string,sentence_index:int,statement:string>,confidence:double>"
)
FEATURES = (
    "arxiv_id string, source_versioned_id string, extractor string, extractor_version string, prompt_version string, "
    "extracted_at timestamp, features string"
)
STATE = "state_key string, state_value timestamp, updated_at timestamp"
NODES = "node_id string, node_type string, name string, canonical_name string, properties map<string,string>, updated_at timestamp"
EDGES = "source_id string, relation string, target_id string, properties map<string,string>, updated_at timestamp"
DATASET = (
    "abs_url string, abstract string, arxiv_id string, authors array<string>, categories array<string>, comment string, doi string, "
    "journal_ref string, pdf_url string, primary_category string, published_at string, submitted_date string, title string, "
    "updated_at string, versioned_id string"
)
VALIDITY_INPUT = "arxiv_id string, versioned_id string, submitted_date string, title string, abstract string"
CLASSIFIER_INPUT = "arxiv_id string, title string, abstract string, primary_category string"

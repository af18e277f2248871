"""Explicit schemas of everything that is read; nothing is inferred."""

from __future__ import annotations

LISTING = "Key string, Size bigint, Modified string, ETag string, Class string"
LISTING_META = (
    "bucket string, region string, object_count bigint, total_bytes bigint, total_bytes_human string, complete boolean, "
    "continuation_token string, listing_file string, updated_at string, error string"
)
REGISTRY = "name string, region string, site_id string, in_scope boolean, approx_objects bigint, approx_bytes bigint, notes string"
PROVENANCE = "struct<s3_key:string,original_url:string,s3_bucket:string,s3_etag:string,byte_size:bigint,file_sha256:string,retrieved_from:string>"
EXTRACTION = "struct<status:string,method:string,char_count:bigint,ocr_confidence:double,error:string,tool_version:string>"
RECORD = (
    "title string, source_site string, content_type string, provenance " + PROVENANCE + ", body_text string, id string, title_inferred boolean, "
    "mime_type string, publication_date string, publication_date_precision string, publication_date_source string, capture_date string, "
    "text_sha256 string, duplicate_of string, extraction " + EXTRACTION + ", topics array<string>, schema_version string"
)
LEDGER = "log_seq bigint, s3_key string, record_id string, text_sha256 string, etag string, byte_size bigint, status string, attempts int, error string, updated_at string"
MEASUREMENT = "bucket string, key string, size bigint, stratum string, verdict string, pages bigint, producer string, chars_scanned bigint, pages_measured bigint, chars_per_page double, error string"

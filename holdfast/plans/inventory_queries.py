"""The queries of inventory, records, sampling and ledger, with their SQL.

Objects are the current rows of ``object_listing``. Measurements stand in for the external tools' and are
computed from the key, alike on both sides: pages, characters and failures by digits of a hash.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions import html as H
from holdfast.functions import scalars as S
from holdfast.operators import inventory as I
from holdfast.operators import ledger as L
from holdfast.operators import records as R
from holdfast.operators import sampling as P
from holdfast.plans import reports
from holdfast.sources import files, paged
from holdfast.storage import shared_dir, table, written
from holdfast.streaming import ledger as SL

SEED = 20260907
EXCLUDED_PREFIX = "ftpArchive/"
EXCLUDED_BUCKETS = 3
TOTAL, MINIMUM, MAX_MB = 1500, 40, 200


def _objects(s: SparkSession, d: str) -> DataFrame:
    return I.current_objects(table(s, d, "object_listing"))


def _exclusions(s: SparkSession, d: str) -> DataFrame:
    names = table(s, d, "bucket_registry").orderBy("name").limit(EXCLUDED_BUCKETS)
    return names.select(F.col("name").alias("bucket"), F.lit(EXCLUDED_PREFIX).alias("prefix"))


def _population(s: SparkSession, d: str) -> DataFrame:
    return P.ingestable(_objects(s, d), _exclusions(s, d))


def _measured(drawn: DataFrame) -> DataFrame:
    """The stand-in's measurements of drawn files: digits of a hash of bucket and key."""
    h = F.conv(F.substring(F.md5(F.concat_ws("/", "bucket", "key")), 1, 8), 16, 10).cast("bigint")
    m = drawn.withColumn("h", h)
    failure = F.when(F.col("h") % 97 == 0, "corrupt").when(F.col("h") % 101 == 0, "encrypted").when(F.col("h") % 103 == 0, "timeout")
    m = m.withColumn("failure", failure).withColumn("pages", F.when(F.col("failure").isNull(), F.col("h") % 60))
    m = m.withColumn("producer", F.when(F.col("failure").isNull() & (F.col("h") % 7 > 0), F.concat(F.repeat(F.lit("maker "), (F.col("h") % 5 * 5).cast("int")), F.lit("no. "), (F.col("h") % 31).cast("string"))))
    m = m.withColumn("chars_scanned", F.when(F.col("pages") > 0, F.col("h") % 9973))
    return m.withColumn("chars_per_page", S.chars_per_page(F.col("chars_scanned"), F.col("pages"))).drop("h")


def _drawn(s: SparkSession, d: str) -> DataFrame:
    p = _population(s, d)
    return P.draw(p, P.allocation(p, TOTAL, MINIMUM), SEED)


def _results(s: SparkSession, d: str) -> DataFrame:
    return P.verdict(_measured(_drawn(s, d)), MAX_MB)


def _allocated(s: SparkSession, d: str) -> DataFrame:
    return P.allocation(_population(s, d), TOTAL, MINIMUM)


def _hashed(s: SparkSession, d: str) -> DataFrame:
    """Written once: what follows reads hashes, not texts."""
    return written(R.checksums(table(s, d, "documents"), "doc_id", "text").select("id", "text_sha256"), "hashes")


def _ledger(s: SparkSession, d: str) -> DataFrame:
    return L.state(table(s, d, "ingested"))


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """The ledger folded by a stream of the log's files, drained, and read back."""
    base = f"{shared_dir(s)}/holdfast/stream-{uuid.uuid4().hex}"
    SL.maintain(SL.event_stream(s, f"{d}/ingested.parquet*"), f"{base}/state", f"{base}/checkpoint").awaitTermination()
    return SL.current(s, f"{base}/state")


def _checkpoints(s: SparkSession, d: str) -> DataFrame:
    """Stand-ins for listing checkpoints: complete where a bucket is in scope, to be resumed where that is undecided, and none for excluded ones."""
    held = _objects(s, d).groupBy("bucket").agg(F.count("*").alias("object_count"), F.sum(S.size_of(F.col("size"))).alias("total_bytes"))
    r = table(s, d, "bucket_registry").where("in_scope IS NULL OR in_scope").groupBy(F.col("name").alias("bucket")).agg(F.bool_and("in_scope").alias("scope"))
    return held.join(r, "bucket").select("bucket", "object_count", "total_bytes", F.coalesce("scope", F.lit(False)).alias("complete"), F.when(F.col("scope").isNull(), F.concat(F.lit("after "), F.col("bucket"))).alias("continuation_token"))


def _events(s: SparkSession, d: str) -> DataFrame:
    """The ledger's states written again as events of their statuses."""
    out = None
    for status in ("done", "failed", "skipped"):
        e = L.event(_ledger(s, d).where(F.col("status") == status), status, 12).drop("updated_at")
        out = e if out is None else out.unionByName(e)
    return out


def _read_back(s: SparkSession, d: str) -> DataFrame:
    """Derived records written as JSON lines and read again."""
    path = f"{shared_dir(s)}/holdfast/records-{uuid.uuid4().hex}"
    files.write_records(R.derived(R.unique_records(table(s, d, "document_records"))), path)
    return files.read_records(s, path).select("id", "title", "source_site", "content_type", "text_sha256", "body_text", F.col("extraction.char_count").alias("char_count"), F.size("topics").alias("topics"))


def _listed_by_stream(s: SparkSession, d: str) -> DataFrame:
    """The listing as JSON files drained by a stream, and counted."""
    base = f"{shared_dir(s)}/holdfast/listing-{uuid.uuid4().hex}"
    _objects(s, d).select("bucket", "key", "size", "modified", "etag", "class").write.json(f"{base}/in")
    SL.listing_stream(s, f"{base}/in", f"{base}/out", f"{base}/checkpoint", 100).awaitTermination()
    return s.read.parquet(f"{base}/out").groupBy("bucket").agg(F.count("*").alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def _info(s: SparkSession, d: str) -> DataFrame:
    """Fields of what an information tool might print of a bucket."""
    said = F.concat(F.lit("Title:   "), F.coalesce("notes", F.lit("")), F.lit("\nPages:  "), F.coalesce("approx_objects", F.lit(0)), F.lit("\nPage size: x\n"))
    return table(s, d, "bucket_registry").select("name", S.info_field(said, "Pages").alias("pages"), S.info_field(said, "Producer").alias("producer"))


def _top(dim: str, k: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: I.top_k(I.value_counts(_objects(s, d), dim), k, [F.desc("objects"), F.col(dim)])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "corpus_totals": lambda s, d: I.corpus_totals(_objects(s, d)),
        "ext_counts_top25": _top("ext", 25),
        "ext_bytes_top40": lambda s, d: I.top_k(I.described(_objects(s, d)).where("NOT noise").groupBy("ext").agg(F.sum("size").alias("bytes")), 40, [F.desc("bytes"), F.col("ext")]),
        "ext_counts_top40": lambda s, d: I.top_k(I.described(_objects(s, d)).where("NOT noise").groupBy("ext").agg(F.count("*").alias("objects")), 40, [F.desc("objects"), F.col("ext")]),
        "listing_summary": lambda s, d: I.listing_summary(_objects(s, d), table(s, d, "bucket_registry")),
        "listing_top_groups": lambda s, d: I.largest_listing_groups(_objects(s, d)),
        "listing_actions": lambda s, d: paged.listing_actions(table(s, d, "bucket_registry"), _checkpoints(s, d)),
        "listing_totals": lambda s, d: paged.listing_totals(_checkpoints(s, d)),
        "empty_listings": lambda s, d: I.empty_listings(_objects(s, d).where("key LIKE '%.docx'"), table(s, d, "bucket_registry")),
        "failed_measurements": lambda s, d: P.failed(_results(s, d)),
        "top_producers": lambda s, d: P.top_producers(_results(s, d)),
        "display_text": lambda s, d: R.displayed(table(s, d, "documents"), "doc_id", "text"),
        "documents_in_ledger": lambda s, d: R.with_ledger(R.unique_records(table(s, d, "document_records")).select("id", "text_sha256"), L.seen_texts(_ledger(s, d))),
        "ledger_events": lambda s, d: _events(s, d),
        "ctype_counts": lambda s, d: I.value_counts(_objects(s, d), "ctype"),
        "storage_class_counts": lambda s, d: I.value_counts(_objects(s, d), "class"),
        "top_prefix_counts": _top("top", 40),
        "year_counts": lambda s, d: I.value_counts(_objects(s, d), "year"),
        "dimension_counts": lambda s, d: I.dimension_counts(_objects(s, d)),
        "material_by_bucket": lambda s, d: I.dimension_counts(_objects(s, d), ("material",)).select("bucket", F.col("value").alias("material"), "objects", "bytes"),
        "bucket_matrix": lambda s, d: I.bucket_matrix(_objects(s, d)),
        "prefix_tree_d2": lambda s, d: I.top_k(I.dimension_counts(_objects(s, d), ("prefix",)).select("bucket", F.col("value").alias("prefix"), "objects", "bytes"), 25, [F.desc("objects"), F.col("prefix")], ["bucket"]),
        "size_percentiles": lambda s, d: I.size_summary(_objects(s, d)),
        "text_extractable_share": lambda s, d: I.text_extractable(_objects(s, d)),
        "zero_byte_first20": lambda s, d: I.zero_byte(_objects(s, d)),
        "archive_tier_flag": lambda s, d: I.archive_tier(_objects(s, d)),
        "name_size_collisions": lambda s, d: I.name_size_collisions(_objects(s, d)),
        "etag_dupes_listing": lambda s, d: I.listing_duplicates(_objects(s, d)),
        "etag_dupes_corpus": lambda s, d: I.duplicate_totals(_objects(s, d)),
        "etag_top_groups": lambda s, d: I.largest_groups(_objects(s, d)),
        "stride_sample": lambda s, d: I.stride_sample(_objects(s, d)),
        "human_bytes_by_bucket": lambda s, d: _objects(s, d).groupBy("bucket").agg(F.sum(S.size_of(F.col("size"))).alias("bytes")).withColumn("shown", S.human_bytes(F.col("bytes"))),
        "ingestable_pdfs": _population,
        "consent_excluded": lambda s, d: P.excluded_by_pattern(_objects(s, d)).select("bucket", "key"),
        "strata_population": lambda s, d: _population(s, d).groupBy("stratum").agg(F.count("*").alias("population")),
        "strata_allocation": _allocated,
        "stratified_draw": lambda s, d: _drawn(s, d).select("bucket", "key", "stratum"),
        "verdicts": lambda s, d: P.verdict_counts(_results(s, d), _allocated(s, d)),
        "ocr_estimate": lambda s, d: P.estimate(_results(s, d), _allocated(s, d)),
        "pages_stats": lambda s, d: P.page_statistics(_results(s, d)),
        "canonical_hash": lambda s, d: R.checksums(table(s, d, "documents"), "doc_id", "text"),
        "content_dupes": lambda s, d: R.content_groups(_hashed(s, d)),
        "duplicate_of": lambda s, d: R.duplicate_of(_hashed(s, d)),
        "record_hashes": lambda s, d: R.checksums(R.unique_records(table(s, d, "document_records"))),
        "stable_ids": lambda s, d: R.unique_records(table(s, d, "document_records")).select("id", S.stable_id(F.col("source_site"), S.locator(F.col("provenance.original_url"), F.col("provenance.s3_key"))).alias("made")),
        "records_valid": lambda s, d: R.violations(R.unique_records(table(s, d, "document_records"))),
        "dangling_duplicates": lambda s, d: R.dangling_duplicates(R.unique_records(table(s, d, "document_records"))),
        "record_json_lines": lambda s, d: R.to_json_lines(R.derived(R.unique_records(table(s, d, "document_records")))),
        "file_hashes": lambda s, d: table(s, d, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("file_sha256")),
        "ledger_state": _ledger,
        "stream_ledger": _streamed,
        "html_text": lambda s, d: R.unique_records(table(s, d, "document_records")).select("id", H.html_to_text(F.col("body_text")).alias("text")),
        "records_read_back": _read_back,
        "stream_listing": _listed_by_stream,
        "info_fields": _info,
        "spaceless_lengths": lambda s, d: table(s, d, "documents").select("doc_id", S.spaceless_length(F.col("text")).alias("chars")),
        "year_chart": lambda s, d: reports.year_chart(_objects(s, d)),
        "type_shares": lambda s, d: reports.type_shares(_objects(s, d)),
        "ledger_lookup": lambda s, d: L.lookup(_ledger(s, d), _objects(s, d).where("key LIKE '%.pdf'").select(F.col("key").alias("s3_key"))).select("s3_key", "status", "attempts"),
        "ledger_counts": lambda s, d: L.status_counts(_ledger(s, d)),
        "ledger_failures": lambda s, d: L.failures(_ledger(s, d)),
        "ledger_seen_text": lambda s, d: L.seen_texts(_ledger(s, d)),
        "ledger_done": lambda s, d: L.done_keys(_ledger(s, d), _objects(s, d).select(F.col("key").alias("s3_key"), "etag")),
        "scope_filter": lambda s, d: I.select_scope(table(s, d, "bucket_registry"), undecided=True).select("name", "in_scope"),
        "unknown_buckets": lambda s, d: I.unknown_buckets(_objects(s, d), I.select_scope(table(s, d, "bucket_registry"))),
        "sites_registered": lambda s, d: R.unique_records(table(s, d, "document_records")).groupBy(F.col("source_site").alias("site")).agg(F.count("*").alias("records")).join(table(s, d, "bucket_registry").where("site_id IS NOT NULL").groupBy(F.col("site_id").alias("site")).agg(F.count("*").alias("buckets")), "site", "left").na.fill(0, ["buckets"]),
    }


# The SQL side is written out by hand, values and all, so that it shares no constant with the library.
_CTYPE = """CASE
    WHEN sfx = '.pdf' THEN 'pdf' WHEN sfx IN ('.htm', '.html', '.shtml', '.cfm', '.asp', '.php') THEN 'html' WHEN sfx IN ('.txt', '.md', '.rtf') THEN 'text'
    WHEN sfx IN ('.doc', '.docx', '.xls', '.xlsx', '.ppt', '.pptx') THEN 'office' WHEN sfx IN ('.jpg', '.jpeg', '.png', '.gif', '.tif', '.tiff', '.bmp') THEN 'image'
    WHEN sfx IN ('.mp4', '.mov', '.avi', '.wmv') THEN 'video' WHEN sfx IN ('.mp3', '.wav') THEN 'audio' ELSE 'other' END"""
_MATERIAL = """CASE WHEN noise THEN 'noise' WHEN ext IN ('.pdf', '.doc', '.docx', '.rtf', '.txt', '.odt', '.pages', '.eml') THEN 'document'
    WHEN ext IN ('.html', '.htm', '.php', '.cfm', '.js', '.css', '.xml', '.asp', '.mo', '.po') THEN 'web'
    WHEN ext IN ('.jpg', '.jpeg', '.png', '.gif', '.tif', '.tiff', '.mp3', '.m4a', '.wav', '.mov', '.mp4', '.avi', '.psd', '.dvf', '.key', '.ppt', '.pptx') THEN 'media' ELSE 'other' END"""
_BUNDLES = "contains(key, '.pages/') OR contains(key, '.key/') OR contains(key, '.numbers/') OR contains(key, '.app/') OR contains(key, '.sparsebundle/')"

_OBJECTS = f"""
    o AS (
        SELECT bucket, key, size, etag, class, modified FROM object_listing WHERE key IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY bucket, key ORDER BY listed_at DESC NULLS LAST, size DESC NULLS LAST, etag DESC NULLS LAST, class DESC NULLS LAST, modified DESC NULLS LAST) = 1
    ), n AS (
        SELECT *, regexp_extract(regexp_replace(key, '(/+\\.?)+$', ''), '([^/]*)$', 1) AS base, list_last(string_split(key, '/')) AS seg, string_split(key, '/') AS parts FROM o
    ), x AS (
        SELECT bucket, key, coalesce(size, 0) AS size, coalesce(trim(etag, '"'), '') AS etag, coalesce(nullif(class, ''), 'STANDARD') AS class, lower(base) AS name,
               lower(regexp_extract(base, '^.+(\\.[^.]+)$', 1)) AS sfx,
               key LIKE '%/' OR contains(key, '__MACOSX/') OR {_BUNDLES} OR starts_with(seg, '._') OR seg IN ('.DS_Store', 'Thumbs.db', '.localized', 'Icon' || chr(13)) AS noise,
               CASE WHEN contains(key, '/') THEN parts[1] ELSE '(root)' END AS top,
               coalesce(nullif(CASE WHEN len(parts) > 2 THEN parts[1] || '/' || parts[2] WHEN len(parts) = 2 THEN parts[1] ELSE '' END, ''), '(root)') AS prefix,
               CASE WHEN regexp_matches(modified, '^[0-9]{{4}}') THEN left(modified, 4) END AS year
        FROM n
    ), y AS (SELECT *, CASE WHEN length(sfx) BETWEEN 2 AND 6 THEN sfx ELSE '(none)' END AS ext, {_CTYPE} AS ctype FROM x),
    d AS (SELECT *, {_MATERIAL} AS material FROM y)
"""

_STRATUM = """CASE WHEN size < 0 THEN 'huge' WHEN size < 100000 THEN 'tiny' WHEN size < 1000000 THEN 'small' WHEN size < 10000000 THEN 'medium'
    WHEN size < 100000000 THEN 'large' ELSE 'huge' END"""
_POPULATION = (
    _OBJECTS
    + f""", e AS (SELECT name AS bucket FROM bucket_registry ORDER BY name LIMIT 3),
    pop AS (
        SELECT bucket, key, size, {_STRATUM} AS stratum FROM d
        WHERE lower(key) LIKE '%.pdf' AND NOT noise AND size <> 0 AND NOT (bucket IN (SELECT bucket FROM e) AND starts_with(key, 'ftpArchive/'))
    ), nh AS (SELECT stratum, count(*) AS population FROM pop GROUP BY stratum),
    alloc AS (
        SELECT stratum, population, least(population, greatest(40, CAST(round_even(1500::DOUBLE * population / (SELECT sum(population) FROM nh), 0) AS BIGINT))) AS sampled FROM nh
    )"""
)
_DRAW = (
    _POPULATION
    + f""", dr AS (
        SELECT bucket, key, size, stratum FROM pop JOIN alloc USING (stratum)
        QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5(concat_ws(chr(0), '20260907', bucket, key)), bucket, key) <= sampled
    )"""
)
_RESULTS = (
    _DRAW
    + f""", m0 AS (SELECT *, CAST('0x' || left(md5(bucket || '/' || key), 8) AS BIGINT) AS h FROM dr),
    m1 AS (SELECT *, CASE WHEN h % 97 = 0 THEN 'corrupt' WHEN h % 101 = 0 THEN 'encrypted' WHEN h % 103 = 0 THEN 'timeout' END AS failure FROM m0),
    m2 AS (SELECT *, CASE WHEN failure IS NULL THEN h % 60 END AS pages, CASE WHEN failure IS NULL AND h % 7 > 0 THEN repeat('maker ', h % 5 * 5) || 'no. ' || (h % 31) END AS producer FROM m1),
    m3 AS (SELECT *, CASE WHEN pages > 0 THEN round((h % 9973) / least(pages, 30)::DOUBLE, 1) END AS chars_per_page FROM m2),
    res AS (
        SELECT *, CASE WHEN size > 200000000 THEN 'skipped_too_large' WHEN failure IS NOT NULL THEN failure WHEN coalesce(pages, 0) = 0 THEN 'corrupt'
                       WHEN chars_per_page < 50 THEN 'needs_ocr' WHEN chars_per_page < 250 THEN 'sparse_text' ELSE 'text_layer' END AS verdict FROM m3
    ), w AS (SELECT stratum, population::DOUBLE / sampled AS weight FROM alloc WHERE sampled > 0),
    rw AS (SELECT res.*, coalesce(weight, 0) AS weight FROM res LEFT JOIN w USING (stratum))"""
)
_SPACE = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_CANON = f"trim(regexp_replace(nfc_normalize({{0}}), '{_SPACE}+', ' ', 'g'), ' ')"


def _hash(t: str) -> str:
    return f"sha256({_CANON.replace('{0}', t)})"


def _display(t: str) -> str:
    flat = f"regexp_replace(regexp_replace(replace(nfc_normalize({t}), chr(160), ' '), '[ \\t\\r\\f\\x{{0b}}]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    lines = f"list_transform(string_split({flat}, chr(10)), lambda s: regexp_replace(s, '^{_SPACE}+|{_SPACE}+$', '', 'g'))"
    return f"regexp_replace(array_to_string({lines}, chr(10)), '^{_SPACE}+|{_SPACE}+$', '', 'g')"


_RECORDS = "r AS (SELECT * FROM document_records WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY capture_date DESC NULLS LAST) = 1)"
_LEDGER = """
    l AS (
        SELECT s3_key, record_id, text_sha256, etag, byte_size, status, attempts, error, updated_at FROM ingested WHERE s3_key IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY s3_key ORDER BY CAST(updated_at AS TIMESTAMPTZ) DESC NULLS LAST, attempts DESC NULLS LAST, log_seq DESC NULLS LAST) = 1
    )
"""


def _html(t: str) -> str:
    """By hand: scripts, styles and comments go, block elements become line ends, other tags go, references are resolved."""
    t = f"regexp_replace({t}, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g')"
    t = f"regexp_replace({t}, '(?i)<br\\b[^<>]*>|</?(?:p|div|h[1-6]|li|ul|ol|tr|table|pre|center|blockquote|section|article|title)\\b[^<>]*>', chr(10), 'g')"
    t = f"regexp_replace({t}, '(?i)</?[a-z][a-z0-9]*(?:\\s[^<>]*|\\s*/)?>', '', 'g')"
    t = f"replace(replace(replace(replace({t}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"')"
    t = f"replace(replace(replace(replace(replace({t}, '&#39;', chr(39)), '&#8217;', '’'), '&ldquo;', '“'), '&rdquo;', '”'), '&mdash;', '—')"
    t = f"regexp_replace(regexp_replace(replace({t}, '&amp;', '&'), '[ \\t\\r\\f]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g')"
    return f"trim(regexp_replace(regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\A\\n+|\\n+\\z', '', 'g'), ' ')"


def _counts(dim: str, tail: str = "") -> str:
    return f"WITH {_OBJECTS} SELECT {dim}, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM d WHERE {dim} IS NOT NULL GROUP BY {dim} {tail}"


def oracle_sql() -> dict[str, str]:
    dims = " UNION ALL ".join(f"SELECT bucket, '{x}' AS dim, {x} AS value, size FROM d WHERE {x} IS NOT NULL" for x in ("ext", "ctype", "class", "top", "year", "material", "prefix"))
    broken = """
        SELECT id, 'required:id' AS rule FROM r WHERE coalesce(id, '') = '' UNION ALL SELECT id, 'required:title' FROM r WHERE coalesce(title, '') = ''
        UNION ALL SELECT id, 'required:source_site' FROM r WHERE coalesce(source_site, '') = '' UNION ALL SELECT id, 'required:content_type' FROM r WHERE coalesce(content_type, '') = ''
        UNION ALL SELECT id, 'required:capture_date' FROM r WHERE coalesce(capture_date, '') = '' UNION ALL SELECT id, 'required:text_sha256' FROM r WHERE coalesce(text_sha256, '') = ''
        UNION ALL SELECT id, 'required:provenance.s3_key' FROM r WHERE coalesce(provenance.s3_key, '') = ''
        UNION ALL SELECT id, 'pattern:id' FROM r WHERE NOT regexp_matches(id, '^[a-z0-9][a-z0-9_-]*-[0-9a-f]{12}$')
        UNION ALL SELECT id, 'pattern:source_site' FROM r WHERE NOT regexp_matches(source_site, '^[a-z0-9_]+$')
        UNION ALL SELECT id, 'pattern:publication_date' FROM r WHERE NOT regexp_matches(publication_date, '^[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?$')
        UNION ALL SELECT id, 'pattern:provenance.file_sha256' FROM r WHERE NOT regexp_matches(provenance.file_sha256, '^[0-9a-f]{64}$')
        UNION ALL SELECT id, 'pattern:text_sha256' FROM r WHERE NOT regexp_matches(text_sha256, '^[0-9a-f]{64}$')
        UNION ALL SELECT id, 'enum:content_type' FROM r WHERE content_type NOT IN ('pdf', 'html', 'image', 'office', 'video', 'audio', 'text', 'other')
        UNION ALL SELECT id, 'enum:publication_date_precision' FROM r WHERE publication_date_precision NOT IN ('day', 'month', 'year')
        UNION ALL SELECT id, 'enum:publication_date_source' FROM r WHERE publication_date_source NOT IN ('document_metadata', 'page_byline', 'url_path', 'filename', 'manual')
        UNION ALL SELECT id, 'enum:provenance.retrieved_from' FROM r WHERE provenance.retrieved_from NOT IN ('s3_archive', 'live_site', 'wayback')
        UNION ALL SELECT id, 'enum:extraction.status' FROM r WHERE extraction.status NOT IN ('ok', 'empty', 'ocr', 'ocr_low_confidence', 'failed', 'skipped')
        UNION ALL SELECT id, 'enum:extraction.method' FROM r WHERE extraction.method NOT IN ('pdftotext', 'tesseract', 'textract', 'html_extract', 'plain')
        UNION ALL SELECT id, 'range:provenance.byte_size' FROM r WHERE provenance.byte_size < 0 UNION ALL SELECT id, 'range:extraction.char_count' FROM r WHERE extraction.char_count < 0
        UNION ALL SELECT id, 'range:extraction.ocr_confidence' FROM r WHERE extraction.ocr_confidence NOT BETWEEN 0 AND 100
        UNION ALL SELECT id, 'unique:topics' FROM r WHERE len(list_distinct(topics)) <> len(topics) UNION ALL SELECT id, 'const:schema_version' FROM r WHERE schema_version <> '1'
    """
    totals = {"objects": "NOT noise", "documents": "NOT noise AND material = 'document'", "pdfs": "NOT noise AND ext = '.pdf'", "noise_objects": "noise"}
    sums = {"bytes": "objects", "document_bytes": "documents", "pdf_bytes": "pdfs", "noise_bytes": "noise_objects"}
    groups = "g AS (SELECT etag, count(*) AS copies, count(DISTINCT bucket) AS buckets FROM d WHERE NOT noise AND size > 0 AND etag <> '' AND NOT contains(etag, '-') GROUP BY etag HAVING count(*) > 1)"
    need = "verdict IN ('needs_ocr', 'sparse_text')"
    percent = ", ".join(f"max(size) FILTER (rn = CAST(round_even({p} / 100.0::DOUBLE * (objects - 1), 0) AS BIGINT) + 1) AS p{p}" for p in (50, 90, 99))
    return {
        "corpus_totals": f"WITH {_OBJECTS} SELECT " + ", ".join([f"count(*) FILTER ({c}) AS {n}" for n, c in totals.items()] + [f"CAST(coalesce(sum(size) FILTER ({totals[c]}), 0) AS BIGINT) AS {n}" for n, c in sums.items()]) + " FROM d",
        "ext_counts_top25": _counts("ext", "ORDER BY objects DESC, ext LIMIT 25"),
        "ext_bytes_top40": f"WITH {_OBJECTS} SELECT ext, CAST(sum(size) AS BIGINT) AS bytes FROM d WHERE NOT noise GROUP BY ext ORDER BY bytes DESC, ext LIMIT 40",
        "ext_counts_top40": f"WITH {_OBJECTS} SELECT ext, count(*) AS objects FROM d WHERE NOT noise GROUP BY ext ORDER BY objects DESC, ext LIMIT 40",
        "listing_summary": f"""WITH {_OBJECTS}, s AS (SELECT bucket, size, row_number() OVER (PARTITION BY bucket ORDER BY size) AS rn, count(*) OVER (PARTITION BY bucket) AS objects FROM d),
            sizes AS (SELECT bucket, any_value(objects) AS objects, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(size) // any_value(objects) AS BIGINT) AS mean, min(size) AS min, max(size) AS max, {percent} FROM s GROUP BY bucket),
            more AS (SELECT bucket, count(*) FILTER (ctype IN ('pdf', 'html', 'text', 'office')) AS extractable, round(count(*) FILTER (ctype IN ('pdf', 'html', 'text', 'office')) / count(*)::DOUBLE, 4) AS extractable_share, count(*) FILTER (size = 0) AS zero_byte_objects FROM d GROUP BY bucket),
            names AS (SELECT bucket, count(*) AS collision_groups FROM (SELECT bucket, name, size FROM d WHERE size <> 0 GROUP BY ALL HAVING count(*) > 1) GROUP BY bucket),
            dup AS (SELECT bucket, count(*) AS identical_groups, CAST(sum(n - 1) AS BIGINT) AS redundant_objects FROM (SELECT bucket, etag, count(*) AS n FROM d WHERE etag <> '' AND NOT contains(etag, '-') GROUP BY ALL HAVING count(*) > 1) GROUP BY bucket),
            c AS (SELECT bucket, dim, value, count(*) AS n, sum(size) AS b FROM ({dims}) GROUP BY ALL),
            k AS (SELECT *, row_number() OVER (PARTITION BY bucket, dim ORDER BY CASE WHEN dim = 'year' THEN value END, n DESC, value) AS rank FROM c),
            dims AS (SELECT bucket, {", ".join(f"string_agg(value || '=' || n || '/' || b, chr(10) ORDER BY rank) FILTER (dim = '{x}'{f' AND rank <= {most}' if most else ''}) AS by_{x}" for x, most in (("ext", 25), ("ctype", 0), ("class", 0), ("top", 40), ("year", 0), ("material", 0), ("prefix", 25)))} FROM k GROUP BY bucket),
            r AS (SELECT name AS bucket, max(region) AS region FROM bucket_registry WHERE name IS NOT NULL GROUP BY name)
            SELECT bucket, region, {", ".join(f"coalesce({x}, 0) AS {x}" for x in "objects bytes mean min max p50 p90 p99 extractable extractable_share zero_byte_objects collision_groups identical_groups redundant_objects".split())}, {", ".join(f"coalesce(by_{x}, '') AS by_{x}" for x in ("ext", "ctype", "class", "top", "year", "material", "prefix"))}
            FROM r FULL JOIN sizes USING (bucket) LEFT JOIN more USING (bucket) LEFT JOIN names USING (bucket) LEFT JOIN dup USING (bucket) LEFT JOIN dims USING (bucket)""",
        "listing_top_groups": f"WITH {_OBJECTS}, g AS (SELECT bucket, etag, count(*) AS copies FROM d WHERE etag <> '' AND NOT contains(etag, '-') GROUP BY bucket, etag HAVING count(*) > 1 QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY count(*) DESC, etag) <= 10), k AS (SELECT bucket, etag, key FROM d JOIN g USING (bucket, etag) QUALIFY row_number() OVER (PARTITION BY bucket, etag ORDER BY key) <= 5) SELECT bucket, etag, any_value(copies) AS copies, string_agg(key, chr(10) ORDER BY key) AS keys FROM g JOIN k USING (bucket, etag) GROUP BY bucket, etag",
        "listing_actions": f"WITH {_OBJECTS}, h AS (SELECT bucket, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM d GROUP BY bucket), r AS (SELECT name AS bucket, bool_and(in_scope) AS scope, bool_or(in_scope IS NULL OR in_scope) AS known FROM bucket_registry WHERE name IS NOT NULL GROUP BY name) SELECT bucket, CASE WHEN NOT known OR objects IS NULL THEN 'start' WHEN scope THEN 'skip' ELSE 'resume' END AS action, CASE WHEN known AND scope IS NULL AND objects IS NOT NULL THEN 'after ' || bucket END AS token, CASE WHEN known THEN coalesce(objects, 0) ELSE 0 END AS objects, CASE WHEN known THEN coalesce(bytes, 0) ELSE 0 END AS bytes FROM r LEFT JOIN h USING (bucket)",
        "listing_totals": f"WITH {_OBJECTS}, h AS (SELECT bucket, count(*) AS objects, sum(size) AS bytes FROM d GROUP BY bucket), r AS (SELECT DISTINCT name AS bucket, in_scope FROM bucket_registry WHERE in_scope IS NULL OR in_scope) SELECT count(*) AS buckets, CAST(sum(objects) AS BIGINT) AS objects, CAST(sum(bytes) AS BIGINT) AS bytes, coalesce(string_agg(bucket, ',' ORDER BY bucket) FILTER (in_scope IS NULL), '') AS incomplete FROM h JOIN r USING (bucket)",
        "empty_listings": "SELECT DISTINCT name AS bucket FROM bucket_registry WHERE name IS NOT NULL AND name NOT IN (SELECT bucket FROM object_listing WHERE key LIKE '%.docx' AND bucket IS NOT NULL)",
        "failed_measurements": f"WITH {_RESULTS} SELECT bucket, key, verdict FROM res WHERE verdict IN ('corrupt', 'encrypted', 'timeout', 'download_failed')",
        "top_producers": f"WITH {_RESULTS} SELECT left(producer, 80) AS producer, count(*) AS files FROM res WHERE producer <> '' GROUP BY 1 ORDER BY files DESC, producer LIMIT 12",
        "display_text": f"SELECT doc_id AS id, {_display('text')} AS display_text FROM documents",
        "documents_in_ledger": f"WITH {_RECORDS}, {_LEDGER}, t AS (SELECT text_sha256, arg_min(record_id, (CAST(updated_at AS TIMESTAMPTZ), s3_key)) AS seen_as, count(*) AS keys FROM l WHERE status = 'done' AND text_sha256 IS NOT NULL GROUP BY 1) SELECT id, text_sha256, seen_as, coalesce(keys, 0) AS keys FROM r LEFT JOIN t USING (text_sha256)",
        "ledger_events": f"WITH {_LEDGER} SELECT s3_key, status, CASE WHEN status = 'done' THEN record_id END AS record_id, CASE WHEN status = 'done' THEN text_sha256 END AS text_sha256, CASE WHEN status = 'done' THEN etag END AS etag, CASE WHEN status = 'done' THEN byte_size END AS byte_size, CASE WHEN status <> 'done' THEN left(error, 12) END AS error FROM l WHERE status IN ('done', 'failed', 'skipped')",
        "ctype_counts": _counts("ctype"),
        "storage_class_counts": _counts("class"),
        "top_prefix_counts": _counts("top", "ORDER BY objects DESC, top LIMIT 40"),
        "year_counts": _counts("year"),
        "dimension_counts": f"WITH {_OBJECTS} SELECT bucket, dim, value, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM ({dims}) GROUP BY ALL",
        "material_by_bucket": f"WITH {_OBJECTS} SELECT bucket, material, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM d GROUP BY ALL",
        "bucket_matrix": f"WITH {_OBJECTS} SELECT bucket, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes, " + ", ".join(f"count(*) FILTER (material = '{m}') AS {m}_objects" for m in ("document", "web", "media", "other", "noise")) + ", count(*) FILTER (ext = '.pdf') AS pdfs FROM d GROUP BY bucket",
        "prefix_tree_d2": f"WITH {_OBJECTS} SELECT bucket, prefix, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM d GROUP BY bucket, prefix QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY count(*) DESC, prefix) <= 25",
        "size_percentiles": f"WITH {_OBJECTS}, s AS (SELECT bucket, size, row_number() OVER (PARTITION BY bucket ORDER BY size) AS rn, count(*) OVER (PARTITION BY bucket) AS objects FROM d) SELECT bucket, any_value(objects) AS objects, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(size) // any_value(objects) AS BIGINT) AS mean, min(size) AS min, max(size) AS max, {percent} FROM s GROUP BY bucket",
        "text_extractable_share": f"WITH {_OBJECTS} SELECT bucket, count(*) AS objects, count(*) FILTER (ctype IN ('pdf', 'html', 'text', 'office')) AS extractable, round(count(*) FILTER (ctype IN ('pdf', 'html', 'text', 'office')) / count(*)::DOUBLE, 4) AS extractable_share FROM d GROUP BY bucket",
        "zero_byte_first20": f"WITH {_OBJECTS} SELECT bucket, key, count(*) OVER (PARTITION BY bucket) AS zero_byte_objects FROM d WHERE size = 0 QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY key) <= 20",
        "archive_tier_flag": f"WITH {_OBJECTS} SELECT bucket, bool_or(regexp_matches(class, 'GLACIER|DEEP')) AS archived FROM d GROUP BY bucket",
        "name_size_collisions": f"WITH {_OBJECTS}, c AS (SELECT bucket, name, size FROM d WHERE size <> 0 GROUP BY ALL HAVING count(*) > 1) SELECT bucket, count(*) AS collision_groups FROM c GROUP BY bucket",
        "etag_dupes_listing": f"WITH {_OBJECTS}, c AS (SELECT bucket, etag, count(*) AS n FROM d WHERE etag <> '' AND NOT contains(etag, '-') GROUP BY ALL HAVING count(*) > 1) SELECT bucket, count(*) AS identical_groups, CAST(sum(n - 1) AS BIGINT) AS redundant_objects FROM c GROUP BY bucket",
        "etag_dupes_corpus": f"WITH {_OBJECTS}, {groups} SELECT count(*) AS identical_groups, count(*) FILTER (buckets > 1) AS cross_bucket_groups, CAST(coalesce(sum(copies - 1), 0) AS BIGINT) AS redundant_objects FROM g",
        "etag_top_groups": f"WITH {_OBJECTS}, {groups}, t AS (SELECT * FROM g ORDER BY copies DESC, etag LIMIT 25), k AS (SELECT etag, bucket || '::' || key AS k FROM d JOIN t USING (etag) WHERE NOT noise AND size > 0 QUALIFY row_number() OVER (PARTITION BY etag ORDER BY bucket, key) <= 6) SELECT t.etag, t.copies, t.buckets, string_agg(k, chr(10) ORDER BY k) AS keys FROM t JOIN k USING (etag) GROUP BY ALL",
        "stride_sample": f"WITH {_OBJECTS}, s AS (SELECT bucket, key, row_number() OVER (ORDER BY bucket, key) - 1 AS pos, greatest(1, count(*) OVER () // 50) AS step FROM o) SELECT pos, bucket, key FROM s WHERE pos % step = 0 AND pos < step * 50",
        "human_bytes_by_bucket": f"""WITH {_OBJECTS}, b AS (SELECT bucket, CAST(sum(size) AS BIGINT) AS bytes FROM d GROUP BY bucket)
            SELECT bucket, bytes, CASE WHEN abs(bytes) < 1024 THEN format('{{:,}} B', bytes) WHEN abs(bytes) < 1024 ** 2 THEN format('{{:,.1f}} KB', bytes / 1024.0::DOUBLE)
                WHEN abs(bytes) < 1024 ** 3 THEN format('{{:,.1f}} MB', bytes / 1048576.0::DOUBLE) WHEN abs(bytes) < 1024 ** 4 THEN format('{{:,.1f}} GB', bytes / 1073741824.0::DOUBLE)
                ELSE format('{{:,.1f}} TB', bytes / 1099511627776.0::DOUBLE) END AS shown FROM b""",
        "ingestable_pdfs": f"WITH {_POPULATION} SELECT * FROM pop",
        "consent_excluded": f"WITH {_OBJECTS} SELECT bucket, key FROM o WHERE lower(key) LIKE '%.eml'",
        "strata_population": f"WITH {_POPULATION} SELECT stratum, population FROM nh",
        "strata_allocation": f"WITH {_POPULATION} SELECT * FROM alloc",
        "stratified_draw": f"WITH {_DRAW} SELECT bucket, key, stratum FROM dr",
        "verdicts": f"WITH {_RESULTS} SELECT 'all' AS level, '' AS value, verdict, count(*) AS files, round(sum(weight), 6) AS weighted FROM rw GROUP BY verdict UNION ALL SELECT 'stratum', stratum, verdict, count(*), round(sum(weight), 6) FROM rw GROUP BY stratum, verdict UNION ALL SELECT 'bucket', bucket, verdict, count(*), round(sum(weight), 6) FROM rw GROUP BY bucket, verdict",
        "ocr_estimate": f"""WITH {_RESULTS},
            t AS (SELECT sum(weight) FILTER ({need}) / sum(weight) AS share, sum(weight * coalesce(pages, 0)) FILTER ({need}) AS pn, sum(weight * pages) FILTER (pages > 0) AS pa, avg(pages) FILTER (pages > 0) AS mp FROM rw),
            k AS (SELECT stratum, count(*) FILTER ({need}) AS k FROM res GROUP BY stratum),
            p AS (SELECT a.population, a.sampled, coalesce(k, 0) / a.sampled::DOUBLE AS p, (SELECT sum(population) FROM nh) AS n FROM alloc a LEFT JOIN k USING (stratum) WHERE sampled >= 2),
            v AS (SELECT sqrt(coalesce(sum((population / n::DOUBLE) ** 2 * p * (1 - p) / sampled), 0)) AS se FROM p),
            q AS (SELECT *, CAST((SELECT sum(population) FROM nh) AS BIGINT) AS population, CAST(floor(pn + 1e-6) AS BIGINT) AS pages FROM t, v)
            SELECT population, round(share, 6) AS ocr_share, round(se, 6) AS std_error, round(greatest(0.0, share - 1.96 * se), 4) AS ci_low, round(least(1.0, share + 1.96 * se), 4) AS ci_high,
                   pages AS pages_needing_ocr, CAST(floor(pa + 1e-6) AS BIGINT) AS corpus_pages, round(population * share * mp, 2) AS naive_pages,
                   round(pages / 1000.0::DOUBLE * 1.5, 2) AS usd, round(pages * 2.0::DOUBLE / 3600, 2) AS core_hours FROM q""",
        "pages_stats": f"WITH {_RESULTS}, q AS (SELECT verdict, pages, chars_per_page FROM res WHERE pages > 0 UNION ALL SELECT 'all', pages, chars_per_page FROM res WHERE pages > 0) SELECT verdict, count(*) AS files, round(avg(pages), 6) AS mean_pages, round(median(chars_per_page), 6) AS median_chars_per_page FROM q GROUP BY verdict",
        "canonical_hash": f"SELECT doc_id AS id, {_hash("coalesce(text, '')")} AS text_sha256, length(coalesce(text, '')) AS char_count, length({_display("coalesce(text, '')")}) AS display_length FROM documents",
        "content_dupes": f"SELECT {_hash("coalesce(text, '')")} AS text_sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
        "duplicate_of": f"WITH h AS (SELECT doc_id AS id, {_hash("coalesce(text, '')")} AS text_sha256 FROM documents) SELECT id, text_sha256, nullif(min(id) OVER (PARTITION BY text_sha256), id) AS duplicate_of FROM h",
        "record_hashes": f"WITH {_RECORDS} SELECT id, {_hash("coalesce(body_text, '')")} AS text_sha256, length(coalesce(body_text, '')) AS char_count, length({_display("coalesce(body_text, '')")}) AS display_length FROM r",
        "stable_ids": f"WITH {_RECORDS}, s AS (SELECT id, trim(regexp_replace(lower(source_site), '[^a-z0-9_-]+', '-', 'g'), '-') AS slug, trim(coalesce(nullif(provenance.original_url, ''), provenance.s3_key)) AS loc FROM r) SELECT id, slug || '-' || left(sha256(slug || chr(0) || loc), 12) AS made FROM s",
        "records_valid": f"WITH {_RECORDS} {broken}",
        "dangling_duplicates": f"WITH {_RECORDS} SELECT a.id, a.duplicate_of FROM r a ANTI JOIN r b ON a.duplicate_of = b.id AND a.text_sha256 = b.text_sha256 AND a.id <> b.id AND coalesce(CAST(b.capture_date AS TIMESTAMPTZ) <= CAST(a.capture_date AS TIMESTAMPTZ), TRUE) WHERE a.duplicate_of IS NOT NULL",
        "record_json_lines": f"""WITH {_RECORDS}, s AS (SELECT *, coalesce(body_text, '') AS body, trim(regexp_replace(lower(source_site), '[^a-z0-9_-]+', '-', 'g'), '-') AS slug, trim(coalesce(nullif(provenance.original_url, ''), provenance.s3_key)) AS loc FROM r)
            SELECT CAST(to_json({{
                'body_text': body, 'capture_date': capture_date, 'content_type': content_type, 'duplicate_of': duplicate_of,
                'extraction': {{'char_count': coalesce(extraction.char_count, length(body)), 'error': extraction.error, 'method': extraction.method, 'ocr_confidence': extraction.ocr_confidence, 'status': coalesce(extraction.status, 'ok'), 'tool_version': extraction.tool_version}},
                'id': coalesce(nullif(id, ''), slug || '-' || left(sha256(slug || chr(0) || loc), 12)), 'mime_type': mime_type,
                'provenance': CASE WHEN provenance IS NOT NULL THEN {{'byte_size': provenance.byte_size, 'file_sha256': provenance.file_sha256, 'original_url': provenance.original_url, 'retrieved_from': provenance.retrieved_from, 's3_bucket': provenance.s3_bucket, 's3_etag': provenance.s3_etag, 's3_key': provenance.s3_key}} END,
                'publication_date': publication_date, 'publication_date_precision': publication_date_precision, 'publication_date_source': publication_date_source,
                'schema_version': coalesce(schema_version, '1'), 'source_site': source_site, 'text_sha256': coalesce(nullif(text_sha256, ''), {_hash("body")}),
                'title': title, 'title_inferred': coalesce(title_inferred, FALSE), 'topics': coalesce(topics, [])
            }}) AS VARCHAR) AS value FROM s""",
        "file_hashes": "SELECT doc_id, sha256(text) AS file_sha256 FROM documents",
        "ledger_state": f"WITH {_LEDGER} SELECT * FROM l",
        "stream_ledger": f"WITH {_LEDGER} SELECT * FROM l",
        "html_text": f"WITH {_RECORDS} SELECT id, {_html('body_text')} AS text FROM r",
        "records_read_back": f"WITH {_RECORDS} SELECT id, title, source_site, content_type, coalesce(nullif(text_sha256, ''), {_hash("coalesce(body_text, '')")}) AS text_sha256, coalesce(body_text, '') AS body_text, coalesce(extraction.char_count, length(coalesce(body_text, ''))) AS char_count, CAST(len(coalesce(topics, [])) AS INTEGER) AS topics FROM r",
        "stream_listing": f"WITH {_OBJECTS} SELECT bucket, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM d GROUP BY bucket",
        "info_fields": "SELECT name, CAST(coalesce(approx_objects, 0) AS VARCHAR) AS pages, CAST(NULL AS VARCHAR) AS producer FROM bucket_registry",
        "spaceless_lengths": f"SELECT doc_id, length(regexp_replace(text, '{_SPACE}+', '', 'g')) AS chars FROM documents",
        "year_chart": f"WITH {_OBJECTS}, per AS (SELECT year, count(*) AS objects FROM d WHERE year IS NOT NULL GROUP BY year) SELECT year, objects, repeat('#', greatest(1, objects * 60 // (SELECT max(objects) FROM per))) AS bar FROM per",
        "type_shares": f"WITH {_OBJECTS} SELECT ctype, count(*) AS objects, round(count(*) / (SELECT count(*) FROM d)::DOUBLE, 6) AS share FROM d GROUP BY ctype",
        "ledger_lookup": f"WITH {_OBJECTS}, {_LEDGER} SELECT s3_key, status, attempts FROM l WHERE s3_key IN (SELECT key FROM o WHERE key LIKE '%.pdf')",
        "ledger_counts": f"WITH {_LEDGER} SELECT status, count(*) AS keys FROM l GROUP BY status",
        "ledger_failures": f"WITH {_LEDGER} SELECT s3_key, attempts, error FROM l WHERE status = 'failed' ORDER BY attempts DESC, CAST(updated_at AS TIMESTAMPTZ) DESC, s3_key LIMIT 100",
        "ledger_seen_text": f"WITH {_LEDGER} SELECT text_sha256, arg_min(record_id, (CAST(updated_at AS TIMESTAMPTZ), s3_key)) AS record_id, count(*) AS keys FROM l WHERE status = 'done' AND text_sha256 IS NOT NULL GROUP BY 1",
        "ledger_done": f"WITH {_OBJECTS}, {_LEDGER} SELECT DISTINCT o.key AS s3_key FROM o JOIN l ON o.key = l.s3_key WHERE l.status = 'done' AND coalesce(trim(o.etag, '\"') = trim(l.etag, '\"'), TRUE)",
        "scope_filter": "SELECT name, in_scope FROM bucket_registry WHERE in_scope IS NULL OR in_scope",
        "unknown_buckets": f"WITH {_OBJECTS} SELECT bucket, count(*) AS objects FROM o WHERE bucket NOT IN (SELECT name FROM bucket_registry WHERE in_scope) GROUP BY bucket",
        "sites_registered": f"WITH {_RECORDS}, b AS (SELECT site_id AS site, count(*) AS buckets FROM bucket_registry WHERE site_id IS NOT NULL GROUP BY 1) SELECT source_site AS site, count(*) AS records, coalesce(any_value(b.buckets), 0) AS buckets FROM r LEFT JOIN b ON r.source_site = b.site GROUP BY source_site",
    }

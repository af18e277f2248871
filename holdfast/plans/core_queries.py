"""The core's queries for training data: problems 2 and 7."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from holdfast.operators import incremental, skew
from holdfast.storage import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p2_found": lambda s, d: incremental.pending_keys(table(s, d, "object_listing"), table(s, d, "ingested")).selectExpr("item_key AS s3_key"),
        "p2_pending": lambda s, d: incremental.pending_keys(table(s, d, "object_listing"), table(s, d, "ingested")),
        "p7_found": lambda s, d: skew.heavy_etags(table(s, d, "duplicate_candidates")),
        "p7_totals": lambda s, d: skew.totals_per_etag(table(s, d, "duplicate_candidates")),
        "p7_joined": lambda s, d: skew.joined_totals(table(s, d, "duplicate_candidates"), table(s, d, "object_listing")).selectExpr("etag", "batches", "objects", "pairs", "CAST(pair_bytes AS DOUBLE) AS pair_bytes"),
    }


_PENDING = """
    WITH now AS (
        SELECT key, nullif(trim(etag, '"'), '') AS etag FROM object_listing WHERE key IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY key ORDER BY listed_at DESC NULLS LAST, nullif(trim(etag, '"'), '') DESC NULLS LAST) = 1
    ), state AS (
        SELECT s3_key, nullif(trim(etag, '"'), '') AS etag, status FROM ingested WHERE s3_key IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY s3_key ORDER BY CAST(updated_at AS TIMESTAMPTZ) DESC NULLS LAST, attempts DESC NULLS LAST, log_seq DESC) = 1
    )
    SELECT {columns} FROM now LEFT JOIN state ON now.key = state.s3_key
    WHERE state.s3_key IS NULL OR state.status NOT IN ('done', 'skipped') OR now.etag <> state.etag
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _PENDING.format(columns="now.key AS s3_key"),
        "p2_pending": _PENDING.format(columns="now.key AS item_key, now.etag AS etag"),
        "p7_found": """
            WITH c AS (SELECT DISTINCT batch_id, nullif(trim(etag, '"'), '') AS etag FROM duplicate_candidates WHERE batch_id IS NOT NULL)
            SELECT etag FROM c WHERE etag IS NOT NULL GROUP BY etag
            HAVING count(*) >= 0.025 * (SELECT count(DISTINCT batch_id) FROM duplicate_candidates)
        """,
        "p7_totals": """
            WITH c AS (
                SELECT batch_id, nullif(trim(etag, '"'), '') AS etag, max(copies) AS copies FROM duplicate_candidates WHERE batch_id IS NOT NULL GROUP BY ALL
            ), k AS (
                SELECT etag, count(DISTINCT k) AS distinct_keys
                FROM (SELECT nullif(trim(etag, '"'), '') AS etag, unnest(keys) AS k FROM duplicate_candidates WHERE batch_id IS NOT NULL) GROUP BY etag
            )
            SELECT c.etag, count(*) AS batches, CAST(coalesce(sum(c.copies), 0) AS BIGINT) AS copies, coalesce(any_value(k.distinct_keys), 0) AS distinct_keys
            FROM c LEFT JOIN k ON c.etag IS NOT DISTINCT FROM k.etag GROUP BY c.etag
        """,
        "p7_joined": """
            WITH c AS (SELECT DISTINCT batch_id, nullif(trim(etag, '"'), '') AS etag FROM duplicate_candidates WHERE batch_id IS NOT NULL),
            b AS (SELECT etag, count(*) AS batches FROM c WHERE etag IS NOT NULL GROUP BY etag),
            o AS (SELECT nullif(trim(etag, '"'), '') AS etag, count(*) AS objects, sum(coalesce(size, 0)) AS bytes FROM object_listing GROUP BY 1)
            SELECT etag, batches, objects, batches * objects AS pairs, CAST(CAST(batches AS HUGEINT) * bytes AS DOUBLE) AS pair_bytes FROM b JOIN o USING (etag)
        """,
    }

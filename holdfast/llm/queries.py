"""The queries of this subpackage and their SQL, added to the entry's where the subpackage is present."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import boilerplate, markup, mixing, neardup, ocr, packing, pii
from holdfast.llm import quality as text_quality
from holdfast.storage import table


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_records")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_profiles(table(spark, d, "documents"), table(spark, d, "pack_profiles"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: markup.marked_up(_records(s, d), table(s, d, "common_words")),
        "p1_clean": lambda s, d: markup.clean_markup(_records(s, d), table(s, d, "common_words")).withColumn("markup", F.array_join("markup", ",")),
        "p3_found": lambda s, d: ocr.scan_defects(_records(s, d)),
        "p3_repaired": lambda s, d: ocr.repair_scans(_records(s, d)).where("scanned").select("record_id", F.size("lines").alias("defects"), "repaired"),
        "p4_found": lambda s, d: boilerplate.repeated_lines(_records(s, d)),
        "p4_blocks": lambda s, d: boilerplate.Boilerplate(_records(s, d)).blocks().select("site", "lines", "records"),
        "p4_clean": lambda s, d: boilerplate.Boilerplate(_records(s, d)).cleaned(),
        "p5_found": lambda s, d: neardup.near_duplicate_pairs(_records(s, d)),
        "p5_aligned": lambda s, d: neardup.NearDuplicates(_records(s, d)).aligned(),
        "p5_groups": lambda s, d: neardup.NearDuplicates(_records(s, d)).groups(),
        "p6_found": lambda s, d: pii.personal_data(_records(s, d), table(s, d, "name_lexicon")),
        "p8_packed": _packed,
        "p8_fill": lambda s, d: packing.fill_by_profile(_packed(s, d), table(s, d, "pack_profiles")),
        "p9_plan": lambda s, d: mixing.Mix(table(s, d, "documents"), table(s, d, "mix_targets")).plan(),
        "p9_shares": lambda s, d: mixing.Mix(table(s, d, "documents"), table(s, d, "mix_targets")).report(),
        "p9_whole_plan": lambda s, d: mixing.Mix(table(s, d, "documents"), table(s, d, "mix_targets"), total="all").plan(),
        "p9_whole_shares": lambda s, d: mixing.Mix(table(s, d, "documents"), table(s, d, "mix_targets"), total="all").report(),
        "p9_entropy_plan": lambda s, d: mixing.Mix(table(s, d, "documents"), table(s, d, "mix_targets"), entropy_of_targets=True).plan(),
        "p9_temperature": lambda s, d: mixing.temperature_weights(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p10_found": lambda s, d: text_quality.not_prose(table(s, d, "documents"), table(s, d, "common_words")),
        "p10_counts": lambda s, d: text_quality.statistics(table(s, d, "documents"), table(s, d, "common_words")).select("doc_id", "words", "lines", F.round("common_words", 6).alias("common_words"), F.round("distinct_words", 6).alias("distinct_words"), F.round("ending_punctuation", 6).alias("ending_punctuation"), F.round("repeated_lines", 6).alias("repeated_lines")),
        "p10_held_out": lambda s, d: text_quality.held_out_report(table(s, d, "documents"), table(s, d, "common_words")),
        "p10_statistics": lambda s, d: text_quality.quality(table(s, d, "documents"), table(s, d, "common_words")),
        "p6_sanitized": lambda s, d: pii.generalized(_records(s, d), table(s, d, "name_lexicon")),
    }


_LINES = r"""
    WITH r AS (
        SELECT id, arg_max(source_site, capture_date) AS site, arg_max(body_text, capture_date) AS body
        FROM document_records WHERE id IS NOT NULL GROUP BY id
    ), l AS (
        SELECT id, site, generate_subscripts(string_split(body, chr(10)), 1) AS line_no, unnest(string_split(body, chr(10))) AS line
        FROM r WHERE site IS NOT NULL AND length(body) > 0
    ), m AS (
        SELECT id, site, line_no, line AS raw,
               trim(regexp_replace(regexp_replace(regexp_replace(lower(line), '[0-9]', '', 'g'), '[\t\r\f]', ' ', 'g'), ' +', ' ', 'g'), ' ') AS line
        FROM l
    ), s AS (SELECT site, count(*) AS records FROM r WHERE site IS NOT NULL GROUP BY site),
    h AS (
        SELECT m.site, m.line FROM m JOIN s USING (site) WHERE regexp_matches(m.line, '\p{L}')
        GROUP BY m.site, m.line HAVING count(DISTINCT id) >= 8 AND count(DISTINCT id) >= 0.10 * any_value(s.records)
    )
"""


#: Pairs of records of at least 50 words whose distinct runs of three words are common for half of all, by brute force.
_ALIKE = """
    r AS (
        SELECT id, list_filter(regexp_split_to_array(lower(arg_max(body_text, capture_date)), '\\s+'), lambda x: x <> '') AS w FROM document_records WHERE id IS NOT NULL GROUP BY id
    ), g AS (
        SELECT DISTINCT id, hash(array_to_string(w[i : i + 2], ' ')) AS h FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM r WHERE len(w) >= 50)
    ), n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
    met AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM g a JOIN g b ON a.h = b.h AND a.id < b.id GROUP BY ALL)
    SELECT id_a, id_b FROM met JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c >= 0.5 * (x.n + y.n - c)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": "WITH " + _ALIKE,
        "p4_blocks": _LINES.replace("WITH r AS", "WITH RECURSIVE r AS").replace("SELECT m.site, m.line FROM m JOIN", "SELECT m.site, m.line, count(DISTINCT id) AS n FROM m JOIN")
        + """, q AS (SELECT id, site, line, row_number() OVER (PARTITION BY id ORDER BY line_no) AS k FROM m WHERE regexp_matches(line, '\\p{L}')),
            p AS (SELECT DISTINCT x.id, x.site, x.line AS a, y.line AS b FROM q x JOIN q y ON x.id = y.id AND y.k = x.k + 1),
            e AS (
                SELECT p.site, a, b FROM p JOIN h x ON x.site = p.site AND x.line = a JOIN h y ON y.site = p.site AND y.line = b
                GROUP BY ALL HAVING count(*) >= greatest(8, 0.5 * least(any_value(x.n), any_value(y.n)))
            ), u AS (SELECT * FROM e UNION SELECT site, b, a FROM e),
            reach AS (SELECT site, line AS x, line AS y FROM h UNION SELECT r.site, r.x, u.b FROM reach r JOIN u ON u.site = r.site AND u.a = r.y),
            root AS (SELECT site, x, min(y) AS top FROM reach GROUP BY ALL)
            SELECT root.site, count(*) AS lines, max(h.n) AS records FROM root JOIN h ON h.site = root.site AND h.line = root.x GROUP BY root.site, root.top""",
        "p10_counts": """
            WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents WHERE doc_id IS NOT NULL),
            f AS (SELECT doc_id, line FROM l WHERE regexp_matches(line, '\\S')),
            s AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (right(regexp_replace(line, '\\s+$', ''), 1) IN ('.', '!', '?', '…', '"', '”', '»', ')')) / count(*)::DOUBLE AS ending, 1 - count(DISTINCT line) / count(*)::DOUBLE AS repeated FROM f GROUP BY doc_id),
            w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
            t AS (SELECT doc_id, len(w) AS words, len(list_distinct(w)) AS different FROM w),
            k AS (SELECT doc_id, count(*) AS common FROM (SELECT doc_id, unnest(w) AS x FROM w) WHERE x IN (SELECT word FROM common_words) GROUP BY doc_id)
            SELECT doc_id, words, coalesce(lines, 0) AS lines, round(coalesce(common, 0) / greatest(words, 1)::DOUBLE, 6) AS common_words, round(different / greatest(words, 1)::DOUBLE, 6) AS distinct_words,
                   round(coalesce(ending, 0), 6) AS ending_punctuation, round(coalesce(repeated, 0), 6) AS repeated_lines
            FROM t LEFT JOIN s USING (doc_id) LEFT JOIN k USING (doc_id)""",
        "p4_found": _LINES + " SELECT m.id AS record_id, CAST(m.line_no AS INTEGER) AS line_no FROM m JOIN h USING (site, line)",
        "p4_clean": _LINES
        + """, c AS (
            SELECT m.id, coalesce(string_agg(m.raw, chr(10) ORDER BY m.line_no) FILTER (h.line IS NULL), '') AS clean_text, CAST(count(h.line) AS INTEGER) AS removed
            FROM m LEFT JOIN h USING (site, line) GROUP BY m.id
        )
        SELECT r.id AS record_id, r.site AS source_site, coalesce(c.clean_text, r.body) AS clean_text, coalesce(c.removed, 0) AS removed FROM r LEFT JOIN c USING (id)""",
    }

"""Scalar functions over object keys, sizes, ETags and texts, as column expressions."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The two classifications of file names.
CONTENT_TYPES = {
    "pdf": (".pdf",),
    "html": (".htm", ".html", ".shtml", ".cfm", ".asp", ".php"),
    "text": (".txt", ".md", ".rtf"),
    "office": (".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx"),
    "image": (".jpg", ".jpeg", ".png", ".gif", ".tif", ".tiff", ".bmp"),
    "video": (".mp4", ".mov", ".avi", ".wmv"),
    "audio": (".mp3", ".wav"),
}
MATERIAL = {
    "document": (".pdf", ".doc", ".docx", ".rtf", ".txt", ".odt", ".pages", ".eml"),
    "web": (".html", ".htm", ".php", ".cfm", ".js", ".css", ".xml", ".asp", ".mo", ".po"),
    "media": (".jpg", ".jpeg", ".png", ".gif", ".tif", ".tiff", ".mp3", ".m4a", ".wav", ".mov", ".mp4", ".avi", ".psd", ".dvf", ".key", ".ppt", ".pptx"),
}
NOISE_NAMES = (".DS_Store", "Thumbs.db", ".localized", "Icon\r")
BUNDLES = (".pages/", ".key/", ".numbers/", ".app/", ".sparsebundle/")
TEXT_TYPES = ("pdf", "html", "text", "office")
STRATA = (("tiny", 100_000), ("small", 1_000_000), ("medium", 10_000_000), ("large", 100_000_000))
# What Unicode counts as white space, for Java's patterns.
SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0  -     　]"


def basename(key: Column) -> Column:
    """The last component of a path: slashes at the end and components that are a dot are passed over."""
    return F.regexp_extract(key, r"(?s)(?:^|/)((?!\.(?:/|\z))[^/]+)(?:/+\.?)*\z", 1)


def last_segment(key: Column) -> Column:
    """What follows the last slash, as it stands."""
    return F.substring_index(key, "/", -1)


def suffix(key: Column) -> Column:
    """The lower-cased last suffix of the base name with its dot; empty for dot files and a dot at the end."""
    return F.lower(F.regexp_extract(basename(key), r"(?s)\A.+(\.[^.]+)\z", 1))


def extension(key: Column) -> Column:
    """The suffix where it has two to six characters, else ``(none)``."""
    s = suffix(key)
    return F.when(F.length(s).between(2, 6), s).otherwise(F.lit("(none)"))


def _lookup(value: Column, classes: dict[str, tuple[str, ...]], other: str) -> Column:
    out = F.lit(other)
    for name, members in reversed(classes.items()):
        out = F.when(value.isin(*members), F.lit(name)).otherwise(out)
    return out


def content_type(key: Column) -> Column:
    """The content type by suffix of any length; ``other`` where none is known."""
    return _lookup(suffix(key), CONTENT_TYPES, "other")


def is_noise(key: Column) -> Column:
    """Whether a key is a file system's leftover: a directory marker, an archive's shadow, a bundle's part."""
    name = last_segment(key)
    out = key.endswith("/") | key.contains("__MACOSX/")
    for b in BUNDLES:
        out = out | key.contains(b)
    return out | name.startswith("._") | name.isin(*NOISE_NAMES)


def material(key: Column) -> Column:
    """noise, document, web, media or other; noise comes first."""
    return F.when(is_noise(key), F.lit("noise")).otherwise(_lookup(extension(key), MATERIAL, "other"))


def top_prefix(key: Column) -> Column:
    return F.when(key.contains("/"), F.substring_index(key, "/", 1)).otherwise(F.lit("(root)"))


def prefix(key: Column, depth: int = 2) -> Column:
    """The first ``depth`` segments where there are more than that, else the parent; ``(root)`` where that is empty."""
    parts = F.split(key, "/")
    n = F.size(parts)
    parent = F.when(n > 1, F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(1))), "/")).otherwise(F.lit(""))
    cut = F.when(n > depth, F.substring_index(key, "/", depth)).otherwise(parent)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("(root)"))


def modified_year(modified: Column) -> Column:
    """The first four characters where all are digits, else NULL."""
    return F.when(modified.rlike("^[0-9]{4}"), F.substring(modified, 1, 4))


def bare(etag: Column) -> Column:
    return F.trim(etag, F.lit('"'))


def is_content_hash(etag: Column) -> Column:
    """Whether an unquoted ETag is one part's hash of the content."""
    return F.coalesce((etag != "") & ~etag.contains("-"), F.lit(False))


def storage_class(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("STANDARD"))


def size_of(size: Column) -> Column:
    return F.coalesce(size, F.lit(0).cast("bigint"))


def human_bytes(n: Column) -> Column:
    """Bytes by powers of 1024 with one decimal; whole bytes without; terabytes are the largest unit."""
    out = F.concat(F.format_number(n / F.lit(1024.0**4), 1), F.lit(" TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(F.abs(n) < 1024.0 ** (power + 1), F.concat(F.format_number(n / F.lit(1024.0**power), 1), F.lit(f" {unit}"))).otherwise(out)
    return F.when(F.abs(n) < 1024, F.concat(F.format_number(n, 0), F.lit(" B"))).otherwise(out)


def stratum(size: Column) -> Column:
    """The half-open size band; negative sizes fall through to the last."""
    out = F.lit("huge")
    for name, below in reversed(STRATA):
        out = F.when((size >= 0) & (size < below), F.lit(name)).otherwise(out)
    return out


@functools.cache
def _nfc_udf():
    @F.pandas_udf("string")
    def nfc(text: pd.Series) -> pd.Series:
        return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return nfc


def nfc(text: Column) -> Column:
    """Unicode's composed form. There is no built-in function for it: see :func:`needs_nfc`."""
    return _nfc_udf()(text)


def needs_nfc(text: Column) -> Column:
    """Whether a text may not be composed already: it holds a character from U+0300 on."""
    return text.rlike(r"[^\x{0}-\x{2ff}]")


def canonical_text(composed: Column) -> Column:
    """A composed text with runs of white space made one space, and trimmed."""
    return F.trim(F.regexp_replace(composed, SPACE + "+", " "))


def display_text(composed: Column) -> Column:
    """A composed text for reading: spaces and tabs to one space, three line ends or more to two, lines trimmed."""
    t = F.regexp_replace(F.regexp_replace(composed, " ", " "), r"[ \t\r\f\x0b]+", " ")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    edges = f"^{SPACE}+|{SPACE}+$"
    lines = F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(x, edges, ""))
    return F.regexp_replace(F.array_join(lines, "\n"), rf"\A{SPACE}+|{SPACE}+\z", "")


def text_checksum(composed: Column) -> Column:
    return F.sha2(canonical_text(composed), 256)


def spaceless_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE + "+", ""))


def stable_id(site: Column, locator: Column) -> Column:
    """``slug-hash``: the site's slug and twelve digits of a hash of slug, NUL and locator. Raises where either is empty."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(site), "[^a-z0-9_-]+", "-"), "^-+|-+$", "")
    loc = F.regexp_replace(locator, rf"\A{SPACE}+|{SPACE}+\z", "")
    made = F.concat(slug, F.lit("-"), F.substring(F.sha2(F.concat(slug, F.lit("\0"), loc), 256), 1, 12))
    empty = (F.coalesce(F.trim(site), F.lit("")) == "") | (F.coalesce(loc, F.lit("")) == "")
    return F.when(empty, F.raise_error(F.lit("site and locator must not be empty"))).otherwise(made)


def locator(original_url: Column, s3_key: Column) -> Column:
    return F.coalesce(F.nullif(original_url, F.lit("")), s3_key)


def utc_now() -> Column:
    """This moment in UTC, to the second, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def share(part: Column, whole: Column) -> Column:
    """A ratio, 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def chars_per_page(chars: Column, pages: Column, scanned: int = 30) -> Column:
    """Characters for each measured page, rounded to one decimal before any threshold is applied."""
    return F.round(F.try_divide(chars, F.least(pages, F.lit(scanned))), 1)


def info_field(output: Column, name: str) -> Column:
    """The value of a ``name: value`` line."""
    return F.nullif(F.trim(F.regexp_extract(output, rf"(?m)^{name}:\s*(.*)$", 1)), F.lit(""))

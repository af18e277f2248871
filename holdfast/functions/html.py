"""Plain text of HTML pages by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character references that are resolved; the ampersand comes last.
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#8217;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&mdash;", "—"), ("&amp;", "&"))
DROPPED = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
BREAKS = r"(?i)<br\b[^<>]*>|</?(?:p|div|h[1-6]|li|ul|ol|tr|table|pre|center|blockquote|section|article|title)\b[^<>]*>"
TAGS = r"(?i)</?[a-z][a-z0-9]*(?:\s[^<>]*|\s*/)?>"


def html_to_text(html: Column) -> Column:
    """Text without tags, scripts, styles and comments: block elements become line ends, lines are trimmed, runs of
    line ends become two at most. NULL stays NULL."""
    t = F.regexp_replace(html, DROPPED, "")
    t = F.regexp_replace(F.regexp_replace(t, BREAKS, "\n"), TAGS, "")
    for name, sign in REFERENCES:
        t = F.replace(t, F.lit(name), F.lit(sign))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\r\f]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), r"\A\n+|\n+\z", ""))

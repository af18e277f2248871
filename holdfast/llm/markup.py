"""Markup residue in text documents (problem 1).

``clean_markup`` finds in which of four languages a text is marked up, be it in part, and turns it
into plain text: constructs become blocks (heading, list item, table row, code, formula, paragraph),
and paragraphs of marked-up texts are sorted into content and boilerplate in two passes. The first
decides by stop-word density, length and link density; the second lets short and near-decided
paragraphs inherit the label of the nearest decided neighbours. Structure is always kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.batches import common_words, map_columns

LANGUAGES = ("html", "markdown", "wiki", "latex")

# Element names of HTML.
HTML_TAGS = (
    "a abbr acronym address applet area article aside b base basefont bdo big blink blockquote body br button caption "
    "center cite code col colgroup dd del details dfn dir div dl dt em embed fieldset figcaption figure font footer "
    "form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main "
    "map mark marquee menu meta nav noframes noscript object ol optgroup option p param pre q s samp script section "
    "select small span strike strong style sub summary sup table tbody td textarea tfoot th thead title tr tt u ul "
    "var video"
)
_TAG = re.compile(r"</?(?:" + "|".join(HTML_TAGS.split()) + r")(?:\s[^<>]*|\s*/)?>|<!--|<!doctype\b", re.I)
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z][A-Za-z0-9]{1,31}));")

# What only Markdown has.
_MD_LINK = re.compile(r"!?\[[^\[\]\n]*(?:\n[^\[\]\n]+)?\]\((?:[^()\s]|\([^()\s]*\))+(?:\s+\"[^\"\n]*\")?\)")
_MD_STRONG = re.compile(r"(?<![*\w\\])\*\*(?=[^\s*])[^*\n]*(?:\n[^*\n]+)?(?<=[^\s*\\])\*\*(?![*\w])|(?<![\w\\_])__(?=[^\s_])[^\n]*?(?:\n[^\n]+?)?(?<=[^\s_\\])__(?!\w)")
_MD_CODE = re.compile(r"(?<![`\\])`(?=[^`\s])[^`\n]*(?:\n[^`\n]+)?(?<=[^`\s])`(?!`)")
_MD_FENCE = re.compile(r"^[ \t]{0,3}(```+|~~~+)[ \t]*[\w+-]*[ \t\r]*\n(.*?)(?:^[ \t]{0,3}\1[ \t\r]*$|\Z)", re.M | re.S)
_MD_ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S[^\n]*?)[ \t]*#*[ \t\r]*$", re.M)
_MD_SETEXT = re.compile(r"^(?=[^\n]*\w)([^\s=#>|*-][^\n]{0,118}?)[ \t\r]*\n(={3,}|-{3,})[ \t\r]*$", re.M)
_MD_RULE_ROW = re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t\r]*$", re.M)

# What only wiki text has.
_WIKI_LINK = re.compile(r"\[\[([^\[\]|\n]{1,200})(?:\|([^\[\]\n]*(?:\n[^\[\]\n]+)?))?\]\]")
_WIKI_EXT = re.compile(r"\[(?:https?|ftp)://[^\s\]]+[ \t\n]([^\]\n]*(?:\n[^\]\n]+)?)\]")
_WIKI_QUOTES = re.compile(r"(?<!')('{5}|'''|'')(?=[^'\s])((?:[^'\n]|'(?!'))*(?:\n(?:[^'\n]|'(?!'))+)?)(?<=\S)\1(?!')")
_WIKI_TEMPLATE = re.compile(r"\{\{[ \t]*[A-Za-z#:][^{}]{0,400}\}\}")
_WIKI_HEAD = re.compile(r"^(={2,6})[ \t]*([^=\s](?:[^\n]*?[^=\s])?)[ \t]*\1[ \t\r]*$", re.M)
_WIKI_TABLE = re.compile(r"^[ \t]*\{\|[^\n]*\n(?:.*?\n)??[ \t]*\|\}", re.M | re.S)
_WIKI_TAG = re.compile(r"</?(?:ref|nowiki|gallery|noinclude|includeonly|onlyinclude|references)\b[^<>]*>", re.I)
_WIKI_MAGIC = re.compile(r"^(?:__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__|#REDIRECT\b)", re.M)

# What only LaTeX has. A backslash after a word character, colon or backslash belongs to a path.
_TEX_CMD = re.compile(
    r"(?<![\w:\\])\\(?:begin|end|documentclass|usepackage|section|subsection|subsubsection|chapter|paragraph|textbf|textit|"
    r"texttt|textsc|emph|underline|cite[tp]?|ref|label|footnote|caption|href|url|title|author|mbox|frac|sqrt|mathrm|"
    r"mathbf|text|hspace|vspace|includegraphics|input|bibitem)\*?[ \t]*(?:\[[^\]\n]*\][ \t]*)?\{"
)
_TEX_WORD = re.compile(
    r"(?<![\w:\\])\\(?:item|maketitle|tableofcontents|newpage|noindent|centering|hline|ldots|dots|leq|geq|neq|times|"
    r"alpha|beta|gamma|delta|sigma|mu|pi|sum|int|infty|cdot|pm|approx|par|bigskip|medskip|smallskip)(?![A-Za-z\\.])"
)
_TEX_MATH = re.compile(r"\$\$[^$]{1,400}\$\$|(?<![\\$\w])\$(?=[^\s$])(?=[^$\n]*[\\^_={}])[^$\n]{1,200}(?<=[^\s\\$])\$(?![\w$])|\\\[[^\[\]]{1,400}\\\]|\\\([^()\n]{1,200}\\\)")

_SIGNS = ("<", "&", "\\", "$", "`", "**", "__", "[[", "{{", "{|", "''", "==", "](", "[http", "[ftp", "#", "--")


def _wiki_list_heads(text: str) -> bool:
    """Whether lines begun by ``#`` and a space are numbered list items: two in a row."""
    return bool(re.search(r"^#[ \t]+\S[^\n]*\n#[ \t]+\S", text, re.M))


def markup_kinds(text: str | None) -> list[str]:
    """The languages a text is marked up in, in the order of :data:`LANGUAGES`; none for NULL or empty text."""
    if not text or not any(x in text for x in _SIGNS):
        return []
    found = set()
    bare = text
    if "```" in text or "~~~" in text:
        bare = _MD_FENCE.sub("\n", text)
        if bare != text:
            found.add("markdown")
    if "<pre" in bare.lower():
        bare = re.sub(r"(<pre\b[^<>]*>).*?(</pre>)", r"\1\2", bare, flags=re.I | re.S)
    if "`" in bare and _MD_CODE.search(bare):
        found.add("markdown")
        bare = _MD_CODE.sub(" ", bare)
    if "<" in bare and _TAG.search(bare) or "&" in bare and any(_is_entity(m) for m in _ENTITY.finditer(bare)):
        found.add("html")
    if "](" in bare and _MD_LINK.search(bare) or ("**" in bare or "__" in bare) and _MD_STRONG.search(bare):
        found.add("markdown")
    if "---" in bare and _MD_RULE_ROW.search(bare):
        found.add("markdown")
    if "#" in bare:
        heads = _MD_ATX.findall(bare)
        if any(len(h) > 1 for h, _ in heads) or heads and not _wiki_list_heads(bare):
            found.add("markdown")
    if ("===" in bare or "---" in bare) and any(len(m[2]) >= 0.5 * len(m[1].strip()) for m in _MD_SETEXT.finditer(bare)):
        found.add("markdown")
    if (
        "[[" in bare and _WIKI_LINK.search(bare)
        or "[http" in bare and _WIKI_EXT.search(_MD_LINK.sub(" ", bare))
        or "''" in bare and _WIKI_QUOTES.search(bare)
        or "{{" in bare and _WIKI_TEMPLATE.search(bare)
        or "==" in bare and _WIKI_HEAD.search(bare)
        or "{|" in bare and _WIKI_TABLE.search(bare)
        or "<" in bare and _WIKI_TAG.search(bare)
        or ("__" in bare or "#R" in bare) and _WIKI_MAGIC.search(bare)
    ):
        found.add("wiki")
    if ("\\" in bare or "$" in bare) and (_TEX_CMD.search(bare) or _TEX_WORD.search(bare) or _TEX_MATH.search(bare)):
        found.add("latex")
    return [x for x in LANGUAGES if x in found]


def _is_entity(m: re.Match) -> bool:
    return m[1] is None or f"{m[1]};" in html.entities.html5


# Marks put into the text while it is converted; they are removed at the end.
_HEAD, _ITEM, _ROW, _CELL, _LINK, _KNIL, _KEEP = "\ue010", "\ue011", "\ue012", "\ue013", "\ue014", "\ue015", "\ue016"
_MARKS = re.compile("[\ue010-\ue016]")

# How LaTeX commands and brackets of formulas read in plain text.
_TEX_SIGNS = {"leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "times": "×", "cdot": "·", "pm": "±", "approx": "≈", "infty": "∞", "ldots": "…", "dots": "…", "sum": "Σ", "int": "∫", "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "sigma": "σ", "mu": "μ", "pi": "π"}


class _Kept:
    """Code and formulas taken out of the text, so that later steps don't touch them."""

    def __init__(self):
        self.parts: list[tuple[str, str]] = []

    def put(self, kind: str, body: str) -> str:
        self.parts.append((kind, body))
        return f"{_KEEP}{len(self.parts) - 1}{_KEEP}"


def _formula(body: str) -> str:
    body = re.sub(r"\\([A-Za-z]+)", lambda m: _TEX_SIGNS.get(m[1], m[1]), body)
    body = re.sub(r"([_^])\{([^{}]*)\}", lambda m: m[1] + m[2], body)
    return " ".join(re.sub(r"[{}$\\]", "", body).split())


def _from_html(text: str, kept: _Kept) -> str:
    text = re.sub(r"<!--.*?-->|<!doctype[^>]*>|<(script|style)\b.*?</\1\s*>", "", text, flags=re.I | re.S)
    text = re.sub(r"<pre\b[^<>]*>(.*?)</pre\s*>", lambda m: "\n\n" + kept.put("code", html.unescape(re.sub(r"<[^<>]*>", "", m[1]))) + "\n\n", text, flags=re.I | re.S)
    text = re.sub(r"<sup\b[^<>]*>([^<>]{1,20})</sup>", r"^\1", text, flags=re.I)
    text = re.sub(r"<sub\b[^<>]*>([^<>]{1,20})</sub>", r"_\1", text, flags=re.I)
    text = re.sub(r"<a\b[^<>]*\bhref[^<>]*>(.*?)</a\s*>", lambda m: _LINK + m[1] + _KNIL, text, flags=re.I | re.S)
    text = re.sub(r"<h[1-6]\b[^<>]*>\s*", "\n\n" + _HEAD, text, flags=re.I)
    text = re.sub(r"<li\b[^<>]*>\s*", "\n" + _ITEM, text, flags=re.I)
    text = re.sub(r"<tr\b[^<>]*>\s*", "\n" + _ROW, text, flags=re.I)
    text = re.sub(r"\s*</t[dh]>\s*(?=<t[dh]\b|[^<\s])|(?<=[^\s>\ue012])\s*(?=<t[dh]\b)", _CELL, text, flags=re.I)
    text = re.sub(r"\s*<br\b[^<>]*>\s*\n?", "\n", text, flags=re.I)
    text = re.sub(r"</?(?:p|div|h[1-6]|table|ul|ol|center|blockquote|title|body|head|html|section|article)\b[^<>]*>", "\n\n", text, flags=re.I)
    text = re.sub(_TAG.pattern.rsplit("|<!--", 1)[0], "", text, flags=re.I)
    return _ENTITY.sub(lambda m: html.unescape(m[0]) if _is_entity(m) else m[0], text).replace("\xa0", " ")


def _from_latex(text: str, kept: _Kept) -> str:
    text = re.sub(r"\\begin\{(verbatim|lstlisting)\}[^\n]*\n(.*?)\\end\{\1\}", lambda m: "\n\n" + kept.put("code", m[2]) + "\n\n", text, flags=re.S)
    text = re.sub(r"\\begin\{(equation|align|displaymath|math)(\*?)\}(.*?)\\end\{\1\2\}", lambda m: "\n\n" + kept.put("formula", _formula(m[3])) + "\n\n", text, flags=re.S)
    text = re.sub(r"\\begin\{tabular\*?\}(?:\{[^{}]*\})*(.*?)\\end\{tabular\*?\}", _tabular, text, flags=re.S)
    text = _TEX_MATH.sub(lambda m: (("\n\n" + kept.put("formula", _formula(m[0].strip("\\[]$"))) + "\n\n") if m[0][:2] in ("$$", "\\[") else kept.put("inline", _formula(m[0].strip("\\()$")))), text)
    text = re.sub(r"\\(?:documentclass|usepackage|label|includegraphics|input|vspace|hspace)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}|\\(?:maketitle|tableofcontents|newpage|noindent|centering|hline)\b|~?\\(?:cite[tp]?|ref)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}", "", text)
    text = re.sub(r"\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\]\n]*\])?", "\n\n", text)
    text = re.sub(r"\\(?:chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}\n]*)\}", "\n\n" + _HEAD + r"\1" + "\n\n", text)
    text = re.sub(r"\\item\b[ \t]*(?:\[[^\]\n]*\])?[ \t]*", "\n" + _ITEM, text)
    text = re.sub(r"\\footnote\{([^{}]*)\}", r" (\1)", text)
    text = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", lambda m: _LINK + m[1] + _KNIL, text)
    for _ in range(3):
        text = re.sub(r"(?<![\w:\\])\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", text)
    text = re.sub(r"\\([#&_{}$%])", r"\1", text)
    return re.sub(r"(?<![\w:\\])\\\\(?=\s)", "\n", text)


def _tabular(m: re.Match) -> str:
    rows = [r.replace("\\hline", "").strip() for r in re.split(r"\\\\", m[1])]
    return "\n\n" + "\n".join(_ROW + _CELL.join(c.strip() for c in re.split(r"(?<!\\)&", r)) for r in rows if r) + "\n\n"


def _from_wiki(text: str, kept: _Kept) -> str:
    def table(m: re.Match) -> str:
        rows = []
        for part in re.split(r"^[ \t]*\|-[^\n]*$", m[0], flags=re.M):
            cells = [c.strip() for line in part.split("\n") if re.match(r"[ \t]*[|!](?![}+])", line) for c in re.split(r"\|\||!!", line.strip()[1:])]
            if cells:
                rows.append(_ROW + _CELL.join(cells))
        return "\n\n" + "\n".join(rows) + "\n\n"

    text = _WIKI_TABLE.sub(table, text)
    text = re.sub(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref\s*>", "", text, flags=re.I | re.S)
    text = re.sub(r"<(?:nowiki|gallery|noinclude|includeonly|onlyinclude|references)\b[^<>]*>|</(?:nowiki|gallery|noinclude|includeonly|onlyinclude)>", "", text, flags=re.I)
    for _ in range(3):
        text = _WIKI_TEMPLATE.sub("", text)
    text = re.sub(r"\[\[(?:Category|File|Image)\s*:[^\[\]\n]*\]\]", "", text, flags=re.I)
    text = _WIKI_LINK.sub(lambda m: _LINK + (m[2] or m[1]) + _KNIL, text)
    text = _WIKI_EXT.sub(lambda m: _LINK + m[1] + _KNIL, text)
    text = _WIKI_HEAD.sub("\n" + _HEAD + r"\2" + "\n", text)
    for _ in range(2):
        text = _WIKI_QUOTES.sub(r"\2", text)
    text = re.sub(r"^(?:__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__|#REDIRECT)", "", text, flags=re.M)
    text = re.sub(r"^ (\S[^\n]*\^[^\n]*)$", lambda m: "\n" + kept.put("formula", m[1].strip()) + "\n", text, flags=re.M)
    return re.sub(r"^[*#]+[ \t]*(?=\S)", _ITEM, text, flags=re.M)


def _from_markdown(text: str, kept: _Kept) -> str:
    text = re.sub(r"!\[([^\[\]\n]*(?:\n[^\[\]\n]+)?)\]\([^()\s]*(?:\([^()\s]*\)[^()\s]*)*\)", r"\1", text)
    text = re.sub(r"\[([^\[\]\n]*(?:\n[^\[\]\n]+)?)\]\([^()\s]*(?:\([^()\s]*\)[^()\s]*)*(?:\s+\"[^\"\n]*\")?\)", lambda m: _LINK + m[1] + _KNIL, text)
    text = _MD_ATX.sub("\n" + _HEAD + r"\2" + "\n", text)
    text = _MD_SETEXT.sub("\n" + _HEAD + r"\1" + "\n", text)
    text = _MD_RULE_ROW.sub("\ue017", text)
    text = re.sub(r"\n?\ue017[ \t\r]*", "", text)
    text = re.sub(r"^[ \t]*\|(.*)\|[ \t\r]*$", lambda m: _ROW + _CELL.join(c.strip() for c in m[1].split("|")), text, flags=re.M)
    text = _MD_STRONG.sub(lambda m: m[0][2:-2], text)
    return re.sub(r"^>[ \t]?", "", text, flags=re.M)


def convert(text: str | None, stop: frozenset[str]) -> tuple[list[str], str, int, int]:
    """Languages found, clean text, blocks kept and blocks dropped as boilerplate.

    NULL gives an empty text. A text without markup comes back as it is.
    """
    kinds = markup_kinds(text)
    if not kinds:
        return kinds, text or "", 0, 0
    kept = _Kept()
    out = _MARKS.sub("", text)
    if "markdown" in kinds:
        out = _MD_FENCE.sub(lambda m: "\n\n" + kept.put("code", m[2]) + "\n\n", out)
        out = _MD_CODE.sub(lambda m: kept.put("inline", _formula(m[0][1:-1]) if re.search(r"[_^]\{", m[0]) else m[0][1:-1]), out)
    if "html" in kinds:
        out = _from_html(out, kept)
    if "latex" in kinds:
        out = _from_latex(out, kept)
    if "wiki" in kinds:
        out = _from_wiki(out, kept)
    if "markdown" in kinds:
        out = _from_markdown(out, kept)
    blocks = _blocks(out, kept)
    labels = classify_blocks([(k, b, links) for k, b, links in blocks], stop)
    parts, last = [], ""
    for (kind, body, _), good in zip(blocks, labels):
        if good:
            parts.append(("\n" if kind == last and kind in ("item", "row") else "\n\n") + body)
            last = kind
    return kinds, "".join(parts).strip("\n"), sum(labels), len(labels) - sum(labels)


_KEPT = re.compile(f"{_KEEP}(\\d+){_KEEP}")


def _blocks(text: str, kept: _Kept) -> list[tuple[str, str, float]]:
    """``(kind, rendered text, share of its characters in links)`` in document order."""
    out: list[tuple[str, str, float]] = []
    para: list[str] = []

    def inline(s: str) -> str:
        s = _KEPT.sub(lambda m: kept.parts[int(m[1])][1], s)
        return re.sub(r"[ \t\r\f\v]+", " ", _MARKS.sub("", s)).strip()

    def flush() -> None:
        if para:
            raw = "\n".join(para)
            linked = sum(len(x) for x in re.findall(f"{_LINK}([^{_KNIL}]*)", raw))
            lines = [x for x in map(inline, para) if x]
            if lines:
                body = "\n".join(lines)
                out.append(("paragraph", body, linked / max(1, len(body))))
            para.clear()

    for line in text.split("\n"):
        bare = line.strip()
        whole = _KEPT.fullmatch(bare)
        if whole and kept.parts[int(whole[1])][0] in ("code", "formula"):
            flush()
            kind, body = kept.parts[int(whole[1])]
            out.append((kind, "\n".join("    " + x.rstrip() for x in body.strip("\n").split("\n")) if kind == "code" else body, 0.0))
        elif bare[:1] == _HEAD:
            flush()
            out.append(("heading", inline(bare), 0.0))
        elif bare[:1] == _ITEM:
            flush()
            out.append(("item", "- " + inline(bare), 0.0))
        elif bare[:1] == _ROW:
            flush()
            out.append(("row", "\t".join(inline(c) for c in bare[1:].split(_CELL)), 0.0))
        elif not bare:
            flush()
        else:
            para.append(line)
    flush()
    return [b for b in out if b[1].strip()]


def classify_blocks(
    blocks: Sequence[tuple[str, str, float]],
    stop: frozenset[str],
    length_low: int = 70,
    length_high: int = 200,
    stop_low: float = 0.30,
    stop_high: float = 0.32,
    max_link_density: float = 0.2,
) -> list[bool]:
    """Whether each block is content. Only paragraphs can be boilerplate."""
    first = []
    for kind, body, links in blocks:
        if kind != "paragraph":
            first.append("keep")
            continue
        words = re.findall(r"\w+", body.lower())
        density = sum(w in stop for w in words) / max(1, len(words))
        if links > max_link_density:
            first.append("bad")
        elif len(body) < length_low:
            first.append("bad" if links > 0 and density < stop_low else "short")
        elif density >= stop_high:
            first.append("good" if len(body) > length_high else "near")
        else:
            first.append("near" if density >= stop_low or len(body) <= length_high else "good" if density > 0.1 else "bad")
    final = []
    for i, label in enumerate(first):
        if label in ("short", "near"):
            left = next((first[j] for j in range(i - 1, -1, -1) if first[j] in ("good", "bad")), "")
            right = next((first[j] for j in range(i + 1, len(first)) if first[j] in ("good", "bad")), "")
            sides = {left, right} - {""}
            # near-good blocks yield only where both sides are boilerplate, short ones where no side is content
            final.append(not sides or "good" in sides)
        else:
            final.append(label != "bad")
    return final


def clean_markup(records: DataFrame, words: DataFrame, id_col: str = "id", text_col: str = "body_text") -> DataFrame:
    """``(record_id, markup, clean_text, blocks_kept, blocks_dropped)``, a row for each input row with an id.

    ``words`` is the table of common words, ``(lang, word)``; it is a fixed list of a few hundred rows.
    NULL and empty texts give no markup and an empty text. Columns other than id and text are ignored.
    """
    stop = common_words(words)

    def run(ids, texts):
        for i, t in zip(ids, texts):
            kinds, clean, good, bad = convert(t, stop)
            yield i, kinds, clean, good, bad

    rows = records.select(F.col(id_col).cast("string").alias("record_id"), F.col(text_col).alias("text")).where("record_id IS NOT NULL")
    return map_columns(rows, run, "record_id string, markup array<string>, clean_text string, blocks_kept int, blocks_dropped int")


def marked_up(records: DataFrame, words: DataFrame) -> DataFrame:
    """Distinct ``(record_id, markup)``: each language a record is marked up in."""
    return clean_markup(records, words).select("record_id", F.explode("markup").alias("markup")).distinct()

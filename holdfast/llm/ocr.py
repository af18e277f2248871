"""Noise in text from scanned pages (problem 3).

Scanned texts are told by their lines (hard-wrapped running text) and the hints of their extraction. One pass over
the corpus counts its words, and pairs of them where they are needed, and notes each distinct word of a scanned
text. These are joined to a symmetric-delete index of the frequency lexicon: letters are deleted from both sides,
and a pair of letters that scanners read as one is deleted together. Candidates are weighed by an edit distance in
which confused pairs are cheap; the context's word-pair counts decide between close ones. Lines are labelled
(``hyphen``, ``misread``, ``header``, ``page_no``), and the text is repaired into paragraphs.

Counts, index and candidates are tables, joined by exchange. Only the repairs found, some for each misread word,
are broadcast where they are few; of more each record gets its own by a join.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.batches import map_columns
from holdfast.operators.rows import join_counted
from holdfast.storage import small_enough, written

# What scanners read, and the letters that stood there.
CONFUSIONS = (
    ("c", "e"), ("e", "c"), ("ä", "a"), ("à", "a"), ("á", "a"), ("ö", "o"), ("ó", "o"), ("ü", "u"), ("é", "e"), ("f", "t"), ("t", "f"), ("5", "s"), ("$", "s"), ("0", "o"),
    ("o", "0"), ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("l", "i"), ("i", "l"), ("9", "g"), ("6", "b"),
    ("8", "b"), ("b", "h"), ("h", "b"), ("(", "c"), ("3", "e"), ("2", "z"), ("4", "a"), ("7", "t"), ("@", "a"), ("€", "e"), ("ri", "n"), ("n", "ri"),
    ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("rn", "m"), ("m", "rn"), ("vv", "w"), ("w", "vv"), ("h", "li"), ("li", "h"),
    ("fi", "ﬁ"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("in", "m"), ("m", "in"), ("nn", "m"), ("u", "n"), ("n", "u"), ("v", "y"), ("y", "v"), ("lc", "k"), ("tl", "d"), ("o", "c"), ("ij", "y"),
)
_DOUBLE = {a for a, _ in CONFUSIONS if len(a) == 2}
_DOUBLE_TRUE = {b for _, b in CONFUSIONS if len(b) == 2}
_LIKELY = {p: 0.25 for p in CONFUSIONS} | {p: 0.6 for p in (("u", "n"), ("n", "u"), ("v", "y"), ("y", "v"), ("o", "c"), ("in", "m"), ("m", "in"), ("nn", "m"), ("t", "f"), ("e", "c"), ("h", "b"))}

WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_SIGN = "-¬‐­"
_PAGE = re.compile(r"[\s\f]*(?:[-–—(\[]\s*)?(?:(?:page|pg\.?|p\.?|seite|pagina|página)\s*)?(?:[\dlO]{0,3}\d[\dlO]{0,3}(?:\s*(?:of|/|von|de|sur)\s*\d{1,4})?|(?=[ivxlc])x{0,3}(?:xl|l?x{0,3})(?:ix|iv|v?i{0,3}))(?:\s*[-–—)\]])?[\s\f]*", re.I)
_NUMBERED = re.compile(r"[\s\f]*(?:(\d{1,4}|[ivxl]{1,7})\s{2,}(\S.*?)|(\S.*?)\s{2,}(\d{1,4}|[ivxl]{1,7}))[\s\f]*")
_SMALL = frozenset("a an and at by de der des die du en et for from in la le les near of on or the to und von with y".split())

SCHEMA = (
    "record_id string, scanned boolean, lines array<struct<line_no:int,defect:string>>, repaired string, "
    "choices array<struct<mark:string,options:array<struct<text:string,n:bigint,before:bigint,after:bigint>>>>"
)


def _pair(a: int, b: int) -> int:
    return (a * 0x9E3779B97F4A7C15 + b) & 0xFFFFFFFFFFFFFFFF


class _Ids(dict):
    """64-bit hashes of words; forgets them all when it grows too large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _hinted(records: DataFrame) -> Column:
    """Whether a record's extraction says that it was read from a scan; false where there is no such column."""
    try:
        fields = set(records.schema["extraction"].dataType.names)
    except (KeyError, AttributeError):
        return F.lit(False)
    hint = F.lit(False)
    if "method" in fields:
        hint = hint | F.coalesce(F.col("extraction.method").isin("tesseract", "textract"), F.lit(False))
    return hint | F.col("extraction.ocr_confidence").isNotNull() if "ocr_confidence" in fields else hint


def _texts(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(record_id, text, hinted)`` of texts that aren't empty."""
    return records.select(F.col(id_col).cast("string").alias("record_id"), F.col(text_col).alias("text"), _hinted(records).alias("hinted")).where("length(text) > 0")


def corpus_words(texts: DataFrame, pairs: bool = True) -> DataFrame:
    """``(kind, word, pair, n)`` of :func:`_texts`: lower-cased ``word``s and their numbers, ``pair``s of neighbours by hash, and
    the words of scanned texts that are ``asked`` for repairs or ``counted``. Combined map-side."""

    def run(ids, bodies, hints):
        known = _Ids()
        words: Counter = Counter()
        both = []
        asking = _Asking()
        for i, t, hinted in zip(ids, bodies, hints):
            found = WORD.findall(t.lower())
            words.update(found)
            if pairs and len(found) > 1:
                h = np.fromiter((known[w] for w in found), np.uint64, len(found))
                both.append(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
            if i is not None:
                label_lines(t, asking, hinted)
        yield from (("word", w, None, n) for w, n in words.items())
        if both:
            keys, n = np.unique(np.concatenate(both), return_counts=True)
            yield from zip(["pair"] * len(keys), [None] * len(keys), keys.view(np.int64).tolist(), n.tolist())
        yield from (("asked", w, None, 1) for w in asking.asked)
        yield from (("counted", w, None, 1) for w in asking.counted)

    return map_columns(texts, run, "kind string, word string, pair bigint, n bigint").groupBy("kind", "word", "pair").agg(F.sum("n").alias("n"))


def _deletes(word: str, doubles: set[str]) -> Iterator[str]:
    yield word
    for i in range(len(word)):
        yield word[:i] + "\0" + word[i + 1 :]
        if word[i : i + 2] in doubles:
            yield word[:i] + "\0" + word[i + 2 :]


def _is_plain(word: str) -> bool:
    return word.isalpha() or WORD.fullmatch(word) is not None


def _floor(word: str, own: int, least: int) -> int:
    """How often a repair must stand in the corpus: a reading of letters only must be far rarer than it, the more so the shorter it is."""
    return max(20, own * (25 if len(word) > 4 else 60 if len(word) > 3 else 150)) if _is_plain(word) else max(least, own * 5)


def _spots(word: str) -> Iterator[str]:
    """The word, and where it may be misread in more than one place, the word with one kind of misreading undone throughout."""
    yield word
    plain = _is_plain(word)
    if not plain and sum(not c.isalpha() for c in word) > 1 or plain and len(word) > 8:
        for a, b in CONFUSIONS:
            if a in word and (word.count(a) > 1 or not a.isalpha()):
                yield word.replace(a, b)


def _is_near(word: str, weight: float) -> bool:
    return weight <= (0.6 if len(word) < 7 else 0.75)


def _key(delete: str) -> int:
    """A delete's 64-bit hash, signed."""
    h = xxhash.xxh64_intdigest(delete)
    return h - (1 << 64) if h >> 63 else h


def found_repairs(corpus: DataFrame, least: int = 4) -> DataFrame:
    """``(word, own, found)`` of the words of scanned texts that have repairs or are counted: how often a word itself stands in the
    corpus, and its possible repairs ``(weight, word, n)``, best first.

    ``corpus`` is a written table of :func:`corpus_words`. The lexicon is all words that occur ``least`` times, whatever the
    corpus's size. The index is joined by the hashes of deletes, each of which few words share.
    """
    words = corpus.where("kind = 'word'").select("word", "n")
    most = words.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"))  # one row
    own = F.coalesce("n", F.lit(0))
    asked = corpus.where("kind = 'asked'").select("word").join(words, "word", "left").select("word", own.alias("own")).join(F.broadcast(most)).where("own * 25 <= most")

    def spread(these, numbers):
        for w, n in zip(these, numbers):
            floor = _floor(w, n, least)
            for d in {d for x in _spots(w) for d in _deletes(x, _DOUBLE)}:
                yield _key(d), w, n, floor

    def index(these, numbers):
        for w, n in zip(these, numbers):
            for d in set(_deletes(w, _DOUBLE_TRUE)):
                yield _key(d), w, n

    def weighed(seen, owns, true, numbers):
        for a, o, b, n in zip(seen, owns, true, numbers):
            weight = Lexicon.distance(a, b)
            if _is_near(a, weight):
                yield a, o, weight, b, n

    left = map_columns(asked.select("word", "own"), spread, "d bigint, seen string, own bigint, floor bigint")
    right = map_columns(words.where(F.col("n") >= least).where(F.length("word").between(2, 24)), index, "d bigint, word string, n bigint")
    met = left.join(right, "d").where("n >= floor AND word <> seen").select("seen", "own", "word", "n").distinct()
    near = map_columns(met, weighed, "seen string, own bigint, weight double, word string, n bigint")
    # a word's repairs are as few as the words a letter away
    best = near.groupBy("seen").agg(F.max("own").alias("own"), F.array_sort(F.collect_list(F.struct("weight", (-F.col("n")).alias("less"), "word"))).alias("f"))
    repairs = best.select(F.col("seen").alias("word"), "own", F.transform("f", lambda x: F.struct(x["weight"].alias("weight"), x["word"].alias("word"), (-x["less"]).alias("n"))).alias("found"))
    counted = corpus.where("kind = 'counted'").select("word").join(words, "word").select("word", F.col("n").alias("own"))
    return counted.join(repairs.withColumnRenamed("own", "o"), "word", "full").select("word", F.coalesce("own", "o").alias("own"), F.coalesce("found", F.array().cast("array<struct<weight:double,word:string,n:bigint>>")).alias("found"))


class _Repairs:
    """Looks up misread words: ``words`` has how often words stand in the corpus, ``candidates`` their possible repairs."""

    words: dict[str, int]
    least: int
    _sound: set[str]

    def candidates(self, word: str) -> list[tuple[float, str, int]]:
        """``(weight, repair, how often that stands in the corpus)`` for a lower-case word, best first; none for one that is well known."""
        raise NotImplementedError

    def choose(self, options: list[tuple[str, str, int]], before: str, after: str) -> str:
        """One of ``(text, word, n)`` by its context."""
        return max(options, key=lambda o: o[2])[0]

    def also(self, first: str, last: str) -> None:
        """Called with halves of a word that may be joined without a bracket before them."""

    def repair(self, word: str, before: str = "", after: str = "") -> str | None:
        """The repair of a misread word, or None where it is sound or nothing fits."""
        found = self.candidates(word.lower())
        if not found:
            return None
        options = [(_cased(c, word), c, n) for x, c, n in found if x <= found[0][0] + 0.2]
        return options[0][0] if len(options) == 1 else self.choose(options, before.lower(), after.lower())


def _cased(repair: str, word: str) -> str:
    return repair.upper() if len(word) > 1 and word.isupper() else repair[:1].upper() + repair[1:] if word[:1].isupper() else repair


class _Asking(_Repairs):
    """Finds nothing, and notes what is looked for."""

    least = 1

    def __init__(self):
        self.asked: set[str] = set()
        self.counted: set[str] = set()
        self._sound = set()
        self.words = self  # type: ignore[assignment]

    def get(self, word: str, other: int = 0) -> int:
        self.counted.add(word)
        return 0

    def candidates(self, word: str) -> list[tuple[float, str, int]]:
        if word:
            self.asked.add(word)
        return []

    def also(self, first: str, last: str) -> None:
        for x in (first + last, f"{first}-{last}"):
            self.get(x.lower())
            self.repair(x)
        for x in (first.split("-")[-1], last.split("-")[0]):
            self.get(x.lower())


class Facts(_Repairs):
    """What :func:`found_repairs` found, for some words. Where the context must decide, the text gets a mark and the options are noted."""

    def __init__(self, rows: Iterable[tuple[str, int, list]], least: int = 4):
        self.words, self.found, self.least = {}, {}, least
        for word, own, found in rows:
            self.words[word] = own
            if found:
                self.found[word] = [(f["weight"], f["word"], f["n"]) for f in found]
        self._sound, self._ids = set(), _Ids()
        self.choices: list[dict] = []

    def candidates(self, word: str) -> list[tuple[float, str, int]]:
        return self.found.get(word, [])

    def choose(self, options: list[tuple[str, str, int]], before: str, after: str) -> str:
        if not before and not after:
            return super().choose(options, before, after)
        ids, signed = self._ids, lambda h: h - (1 << 64) if h >> 63 else h
        mark = f"\ue020{len(self.choices)}\ue021"
        rows = [{"text": t, "n": n, "before": signed(_pair(ids[before], ids[c])), "after": signed(_pair(ids[c], ids[after]))} for t, c, n in options]
        self.choices.append({"mark": mark, "options": rows})
        return mark


class Lexicon(_Repairs):
    """A lexicon in memory with its delete index, for small fixtures; :func:`found_repairs` gives the same candidates."""

    def __init__(self, words: dict[str, int], pairs: dict[int, int] | None = None, least: int = 4):
        self.words, self.pairs, self.least = words, pairs or {}, least
        self.index: dict[str, list[str]] = defaultdict(list)
        for w, n in words.items():
            if n >= least and 2 <= len(w) <= 24:
                for d in _deletes(w, _DOUBLE_TRUE):
                    self.index[d].append(w)
        self._sound, self._ids = set(), _Ids()
        self._most = max(words.values(), default=0)

    def candidates(self, word: str) -> list[tuple[float, str, int]]:
        own = self.words.get(word, 0)
        if own * 25 > self._most:
            return []
        floor, out = _floor(word, own, self.least), {}
        for d in {d for x in _spots(word) for d in _deletes(x, _DOUBLE)}:
            for c in self.index.get(d, ()):
                if c not in out and c != word and self.words[c] >= floor:
                    out[c] = self.distance(word, c)
        return sorted(((x, c, self.words[c]) for c, x in out.items() if _is_near(word, x)), key=lambda v: (v[0], -v[2], v[1]))

    def choose(self, options: list[tuple[str, str, int]], before: str, after: str) -> str:
        ids = self._ids
        return max(options, key=lambda o: (self.pairs.get(_pair(ids[before], ids[o[1]]), 0) + self.pairs.get(_pair(ids[o[1]], ids[after]), 0), o[2]))[0]

    @staticmethod
    def distance(seen: str, true: str) -> float:
        """Edit distance where confused pairs cost little; what both words begin and end with costs nothing."""
        k = 0
        while k < len(seen) and k < len(true) and seen[-1 - k] == true[-1 - k]:
            k += 1
        if k:
            seen, true = seen[:-k], true[:-k]
        k = 0
        while k < len(seen) and k < len(true) and seen[k] == true[k]:
            k += 1
        seen, true = seen[k:], true[k:]
        if (seen, true) in _LIKELY:
            return _LIKELY[seen, true]
        if min(len(seen), len(true)) == 0 or len(seen) > 12:
            return float(max(len(seen), len(true)))
        rows, cols = len(seen), len(true)
        d = [[0.0] * (cols + 1) for _ in range(rows + 1)]
        for i in range(rows + 1):
            for j in range(cols + 1):
                if i == j == 0:
                    continue
                best = 99.0
                if i:
                    best = d[i - 1][j] + 1
                if j:
                    best = min(best, d[i][j - 1] + 1)
                if i and j:
                    a, b = seen[i - 1], true[j - 1]
                    best = min(best, d[i - 1][j - 1] + (0 if a == b else _LIKELY.get((a, b), 1.0)))
                    if i > 1 and (seen[i - 2 : i], b) in _LIKELY:
                        best = min(best, d[i - 2][j - 1] + _LIKELY[seen[i - 2 : i], b])
                    if j > 1 and (a, true[j - 2 : j]) in _LIKELY:
                        best = min(best, d[i - 1][j - 2] + _LIKELY[a, true[j - 2 : j]])
                d[i][j] = best
        return d[rows][cols]


def looks_scanned(lines: list[str], hinted: bool = False) -> bool:
    """Hard-wrapped running text: few long lines, and most lines break off within a sentence. Where the extraction hints at
    a scan twice as many lines may be long."""
    full = [x for x in lines if x.strip()]
    if len(full) < 3 or sum(len(x) > 100 for x in full) > (0.1 if hinted else 0.05) * len(full):
        return False
    runs = [(a.rstrip(), b) for a, b in zip(lines, lines[1:]) if len(a.strip()) > 20 and b.strip()]
    mid = sum(a[-1] not in ".!?:;|>}" or bool(re.search(r"\b(?:Dr|Mr|Ms|St)\.$", a)) for a, b in runs)
    return len(runs) >= 2 and mid >= 0.5 * len(runs)


def _skeleton(line: str) -> str:
    """A line with what scanners confuse made alike and its page number removed."""
    m = _NUMBERED.fullmatch(line)
    s = (m[2] or m[3]) if m else line
    s = re.sub(r"\s+", " ", s.strip()).lower()
    for a, b in (("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("li", "h")):
        s = s.replace(a, b)
    return re.sub(r"[0-9]{2,}", "#", s).translate(_ALIKE)


_ALIKE = str.maketrans(
    {"ä": "a", "à": "a", "á": "a", "@": "a", "ö": "o", "ó": "o", "0": "o", "ü": "u", "é": "e", "e": "c", "3": "c", "(": "c", "1": "l", "!": "l", "|": "l", "i": "l", "5": "s", "$": "s", "9": "g", "8": "b", "6": "b", "h": "b", "f": "t"}
)


def _title_like(line: str) -> bool:
    words = re.findall(r"[^\s,;]+", line.strip())
    if not words or line.rstrip()[-1:] in ".!?;:" or len(words) > 14:
        return False
    big = [w for w in words if w.lower() not in _SMALL]
    upper = sum(w[:1].isupper() or not w[:1].isalpha() for w in big)
    return bool(big) and words[0][:1].upper() == words[0][:1] and upper >= 0.5 * len(big)


def label_lines(text: str, lex: _Repairs, hinted: bool = False) -> tuple[list[tuple[int, str]], str] | None:
    """Defects as ``(line number from 1, kind)`` and the repaired text; None where the text isn't scanned."""
    lines = text.split("\n")
    if not looks_scanned(lines, hinted):
        return None
    n = len(lines)
    page = [bool(x.strip() and _PAGE.fullmatch(x)) for x in lines]
    kind = ["page_no" if p else "" for p in page]
    skeletons = [_skeleton(x) if x.strip() and not p else "" for x, p in zip(lines, page)]
    often = Counter(s for s in skeletons if s)
    known = set()
    for i, line in enumerate(lines):
        if page[i] or not line.strip():
            continue
        m = _NUMBERED.fullmatch(line)
        body = (m[2] or m[3]) if m else line
        if re.search(r"\S\s{3,}\S", body.strip()) or len(body.strip()) < 4 or re.match(r"\s*(?:[-•*o]|\d+[.)])\s", line):
            continue
        near_page = i and page[i - 1] or i + 1 < n and page[i + 1]
        cuts = i == 0 or lines[i - 1].strip() != "" and lines[i - 1].rstrip()[-1:] not in ".!?"
        if _title_like(body) and (
            m or "\f" in line or often[skeletons[i]] > 1 and (near_page or cuts or i == 0 or i + 1 < n and lines[i + 1].strip()) or near_page and (i + 1 < n and lines[i + 1].strip() or i == n - 1)
        ):
            known.add(skeletons[i])
    _by_position(skeletons, page, often, known)
    for i, s in enumerate(skeletons):
        if s and s in known:
            kind[i] = "header"
    defects = [(i + 1, k) for i, k in enumerate(kind) if k]
    body = [i for i in range(n) if not kind[i]]
    parts = {i: lines[i].replace("\f", "").split() for i in body}
    paragraphs: list[list[str]] = [[]]
    joined_first: set[int] = set()
    misread: set[int] = set()
    for pos, i in enumerate(body):
        words = parts[i]
        if not words:
            # a page break within a paragraph: what comes next goes on in lower case
            after = next((parts[j][0] for j in body[pos + 1 :] if parts[j]), "")
            if paragraphs[-1] and not (pos and kind[body[pos] - 1 if body[pos] else 0] in ("header", "page_no") and after[:1].islower()):
                paragraphs.append([])
            continue
        nxt = next((j for j in body[pos + 1 :] if parts[j]), None)
        for k, token in enumerate(words):
            if k == 0 and i in joined_first:
                continue
            before = words[k - 1] if k else ""
            after = words[k + 1] if k + 1 < len(words) else ""
            if k == len(words) - 1 and nxt is not None and len(token) > 1 and token[-1] in _SIGN and (token[-2].isalpha() or token[-2] in "0159!($8"):
                head, tail = token[:-1], parts[nxt][0]
                if tail[:1].islower() or tail[:1] in "0159!($8" or head.isupper() and len(head) > 1:
                    broken, whole, wrong = _join(head, token[-1], tail, lex)
                    if broken:
                        defects.append((i + 1, "hyphen"))
                    misread.update(i if x == 0 else nxt for x in wrong)
                    paragraphs[-1].append(whole)
                    joined_first.add(nxt)
                    continue
            fixed = _fix(token, before, after, lex)
            if fixed is not None:
                misread.add(i)
            paragraphs[-1].append(token if fixed is None else fixed)
    defects += [(i + 1, "misread") for i in misread]
    return sorted(defects), "\n\n".join(" ".join(p) for p in paragraphs if p)


def _by_position(skeletons: list[str], page: list[bool], often: Counter, known: set[str]) -> None:
    """Adds to ``known`` the recurring lines, begun by a letter, that stand at a break of pages wherever they stand: beside a page number, a known
    header, or the text's beginning or end, blank lines aside."""
    full = [i for i, s in enumerate(skeletons) if s or page[i]]
    todo = {s for s, n in often.items() if n > 1 and len(s) > 3 and s[0].isalpha()} - known
    while todo:
        breaks = {-1, len(full)} | {k for k, i in enumerate(full) if page[i] or skeletons[i] in known}
        at: dict[str, bool] = {}
        for k, i in enumerate(full):
            s = skeletons[i]
            if s in todo:
                at[s] = at.get(s, True) and (k - 1 in breaks or k + 1 in breaks)
        new = {s for s, ok in at.items() if ok}
        if not new:
            return
        known |= new
        todo -= new


_CORE = re.compile(r"^([\"'“”‘’(\[]*)(.*?)([\"'“”‘’)\].,;:!?]*)$", re.S)
_NOT_WORDS = re.compile(r"^(?:\d+(?:st|nd|rd|th|s)?|[\d.,/:$%€£+()-]+|.*(?:[@/\\_=<>{}#*]|www|\w\.\w).*|[A-Z]{1,3}-?\d{2,}.*|[A-Z]{1,3}-?\d|\d+[a-zA-Z]?|[a-zA-Z])$")


def _fix(token: str, before: str, after: str, lex: _Repairs) -> str | None:
    """The repaired token, or None where it is sound. Whether it is sound doesn't depend on the context."""
    if token in lex._sound:
        return None
    fixed = _look(token, before, after, lex)
    if fixed is None:
        if len(lex._sound) > 500_000:
            lex._sound.clear()
        lex._sound.add(token)
    return fixed


def _look(token: str, before: str, after: str, lex: _Repairs) -> str | None:
    pre, core, post = _CORE.match(token).groups()
    options = [(pre, core, post)]
    if pre[-1:] == "(" and ")" not in post:
        options.append((pre[:-1], "(" + core, post))
    if post[:1] == "!":
        options.append((pre, core + "!", post[1:]))
    for p, c, q in options:
        if len(c) < 3 or _NOT_WORDS.match(c) or sum(x.isalpha() for x in c) * 2 < len(c):
            continue
        whole = lex.repair(c, _CORE.match(before)[2], _CORE.match(after)[2])
        if whole is None and "-" in c:
            bits = c.split("-")
            mended = [None if len(b) < 3 or not b else lex.repair(b) for b in bits]
            if any(mended):
                whole = "-".join(m or b for m, b in zip(mended, bits))
        if whole is None and c.endswith(("'s", "’s")):
            whole = lex.repair(c[:-2])
            whole = whole and whole + c[-2:]
        if whole is not None:
            return p + whole + q
    return None


def _join(head: str, sign: str, tail: str, lex: _Repairs) -> tuple[bool, str, list[int]]:
    """Whether a word was broken here, the word made whole, and which of its halves (0, 1) are misread."""
    pre, first, _ = _CORE.match(head).groups()
    if pre[-1:] == "(" or tail[:1] == "(":
        lex.also(first, _CORE.match(tail)[2])
    if pre[-1:] == "(" and lex.words.get((first + _CORE.match(tail)[2]).lower(), 0) == 0:
        pre, first = pre[:-1], "(" + first
    _, last, post = _CORE.match(tail).groups()
    if tail[:1] in "(" and ")" not in post:
        last = "(" + last
    one, two = first + last, f"{first}-{last}"
    a, b = lex.words.get(one.lower(), 0), lex.words.get(two.lower(), 0)
    if sign == "-" and a == b == 0:
        mended, hyphened = lex.repair(one), lex.repair(two)
        known = [lex.words.get(x.lower(), 0) >= lex.least for x in (first.split("-")[-1], last.split("-")[0])]
        broken = mended is not None or hyphened is None and not all(known)
    else:
        mended, hyphened = lex.repair(one), None
        broken = sign != "-" or a > b
    if not broken:
        whole = hyphened or two
        return False, pre + whole + post, _halves(two, whole, len(first))
    whole = mended or one
    return True, pre + whole + post, _halves(one, whole, len(first)) if mended else []


def _halves(seen: str, true: str, cut: int) -> list[int]:
    """Which halves of ``seen`` differ from ``true``."""
    if seen.lower() == true.lower():
        return []
    a, b = seen.lower(), true.lower()
    left = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return [0] if left < cut else [1]


def repair_scans(records: DataFrame, id_col: str = "id", text_col: str = "body_text", repaired: bool = True, max_broadcast_rows: int = 200_000, least: int = 4) -> DataFrame:
    """``(record_id, scanned, lines, repaired)``, a row for each record that may be scanned.

    Rows without id and NULL or empty texts are left out, as are texts more than a tenth of whose lines have over 100
    characters. The lexicon comes from all records; ``extraction``, where there is such a column, only hints at scans. Without ``repaired`` that
    column may hold marks where the context would have to decide, and word pairs aren't counted.
    """
    texts = _texts(records, id_col, text_col)
    corpus = written(corpus_words(texts, repaired), "words")
    facts = written(found_repairs(corpus, least), "repairs")
    lines = F.split("text", "\n")
    short = F.size(F.filter(lines, lambda x: F.length(x) > 100)) <= 0.1 * F.size(lines)
    rows = texts.where(F.col("record_id").isNotNull() & short)
    held: dict = {}
    few = small_enough(facts, max_broadcast_rows)
    shared = records.sparkSession.sparkContext.broadcast([(r["word"], r["own"], [f.asDict() for f in r["found"]]) for r in facts.collect()] if few else None)

    def run(ids, bodies, hints, own=None):
        if few and "lex" not in held:
            held["lex"] = Facts(shared.value, least)
        for n, (i, t, hinted) in enumerate(zip(ids, bodies, hints)):
            lex = held["lex"] if few else Facts([(x["word"], x["own"], x["found"]) for x in own[n] or ()], least)
            lex.choices = []
            got = label_lines(t, lex, hinted)
            yield (i, False, [], t, []) if got is None else (i, True, [{"line_no": a, "defect": b} for a, b in got[0]], got[1], lex.choices)

    if not few:
        rows = rows.join(_own_facts(rows, facts, max_broadcast_rows), "record_id", "left")
    labelled = map_columns(rows, run, SCHEMA)
    if not repaired:
        return labelled.drop("choices")
    return _chosen(written(labelled, "labelled"), corpus)


def _own_facts(rows: DataFrame, facts: DataFrame, max_broadcast_rows: int) -> DataFrame:
    """``(record_id, own)``: the facts that each record asks for."""

    def asks(ids, bodies, hints):
        for i, t, hinted in zip(ids, bodies, hints):
            asking = _Asking()
            label_lines(t, asking, hinted)
            yield i, sorted(asking.asked | asking.counted)

    each = map_columns(rows, asks, "record_id string, words array<string>").select("record_id", F.explode("words").alias("word")).distinct()
    # a word stands in no more records than its number says
    met = join_counted(each, facts, "word", "own", max_broadcast_rows=max(1, max_broadcast_rows))
    return met.groupBy("record_id").agg(F.collect_list(F.struct("word", "own", "found")).alias("own"))  # no more than a record's own words


def _chosen(labelled: DataFrame, corpus: DataFrame) -> DataFrame:
    """``labelled``, a written table, with the marks in its texts replaced by the options whose word pairs are most frequent, then by the most frequent words."""
    key = F.xxhash64("record_id", "repaired").alias("key")
    each = labelled.where("size(choices) > 0").select(key, F.explode("choices").alias("c")).select("key", "c.mark", F.explode("c.options").alias("o")).select("key", "mark", "o.*").distinct()
    pairs = corpus.where("kind = 'pair'").select("pair", F.col("n").alias("times"))
    sides = each.select("key", "mark", "text", "n", F.explode(F.array("before", "after")).alias("pair")).join(pairs, "pair", "left")
    score = sides.groupBy("key", "mark", "text").agg(F.sum(F.coalesce("times", F.lit(0))).alias("context"), F.max("n").alias("n"))
    best = score.groupBy("key", "mark").agg(F.max_by("text", F.struct("context", "n", "text")).alias("text"))
    per = best.groupBy("key").agg(F.collect_list(F.struct("mark", "text")).alias("chosen"))  # a record's own marks
    text = F.aggregate(F.coalesce("chosen", F.array().cast("array<struct<mark:string,text:string>>")), F.col("repaired"), lambda t, x: F.replace(t, x["mark"], x["text"]))
    j = labelled.withColumn("key", key).join(per, "key", "left")
    return j.select("record_id", "scanned", "lines", text.alias("repaired"))


def scan_defects(records: DataFrame) -> DataFrame:
    """Distinct ``(record_id, line_no, defect)`` of scanned texts."""
    found = repair_scans(records, repaired=False).select("record_id", F.explode("lines").alias("l"))
    return found.select("record_id", "l.line_no", "l.defect").distinct()

"""Personal information inside free text (problem 6).

E-mail addresses, phone and identity numbers and addresses are told by their form and by the words
before them. Person names come from information-theoretic sanitisation: corpus co-occurrence estimates
how strongly a term reveals a protected entity, here how much likelier a name stands next to it than
next to any capitalised word. Terms whose disclosure exceeds the thresholds count as parts of names
beside those of the given, incomplete lexicon, and are replaced with them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.batches import map_columns
from holdfast.operators.rows import join_counted
from holdfast.storage import small_enough, written

KINDS = ("email", "phone", "id_number", "address", "person")

_EMAIL = re.compile(r"[\w.+%-]*[\w+%]@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}\b|\b[\w.+%-]*[\w+%]\s?(?:\[at\]|\(at\)|\{at\}|<at>)\s?[\w-]+(?:\s?(?:\[dot\]|\(dot\)|\{dot\}|\.)\s?[\w-]+)*?(?:\s?(?:\[dot\]|\(dot\)|\{dot\})\s?|\.)[A-Za-z]{2,}\b(?!-|\s?(?:\[dot\]|\(dot\)|\{dot\})|\.\w)", re.I)
_AT = re.compile(r"@|[\[({<]at[\])}>]", re.I)
_EMAIL_WORDS = re.compile(r"\b[\w.+%-]+ at [\w-]+(?: dot [\w-]+)+\b", re.I)

_SEP = r"[ .\-–/ ]"
_PHONE = re.compile(
    r"(?<![\w.\-/+(])(?:"
    rf"(?:\+1{_SEP}?|1{_SEP})?\(\d{{3}}\)\s?\d{{3}}{_SEP}?\d{{4}}"
    rf"|(?:\+1{_SEP}?|1{_SEP})?\d{{3}}{_SEP}\d{{3}}{_SEP}\d{{4}}"
    rf"|\+1\d{{10}}"
    rf"|\+\d{{2,3}}{_SEP}?(?:\(0\){_SEP}?)?\d{{1,5}}(?:{_SEP}\d{{2,6}}){{1,5}}"
    rf"|\+\d{{9,14}}"
    rf"|0\d(?:{_SEP}\d\d){{4}}"
    rf"|\(0\d{{1,4}}\)\s?\d{{3,8}}(?:{_SEP}\d{{2,6}}){{0,2}}"
    rf"|0\d{{2,4}}(?:\s?[/–-]\s?|{_SEP})\d{{3,5}}{_SEP}\d{{3,4}}"
    r")(?![\w]|[-.,/]\d)"
)
_DIGITS = re.compile(r"\d[\d().\-–/  ]{6,}\d")
# Words before a number that make it something other than a phone or a person's identity number.
_OTHER_NUMBER = re.compile(r"\b(?:sheets?|plates?|maps?|contracts?|invoices?|permits?|orders?|parts?|lots?|parcels?|dockets?|cases?|items?|files?|units?|isbn|issn|plots?|serial|models?|figures?|tables?|accessions?|boxes|shelf|catalogue|catalog|folder|volume|reference|ref)(?:\s+(?:no|nr|number|num|id))?\.?[:#]?[ \t]*$", re.I)
_ID_CUE = re.compile(r"\b(?:ssn|social\s+security|tax\s?payer|tax\s+(?:id|no|number|identification)|tin|itin|passports?|licen[cs]e|driver'?s|steuer\S*|sozialversicherung\S*|reisepass\S*|führerschein\S*|passeport|permis|sécurité\s+sociale|pasaporte|nif|nie|dni|seguridad\s+social)\b[^.\n!?]{0,34}?(?:\b(?:no|nr|núm)\.\s*)?(?:\n\s*)?$", re.I)
# Markup that may stand between a number and the word before it.
_OPENING = re.compile(r"(?:[*_\"“'\[({ \t]|&\w+;|<[^<>]*>|\[\[[^\]|]*\||\\\w+\{)+$")
# One of these stands in every text that holds a cue; nothing is asked of what follows or precedes it.
_ID_STEMS = ("ssn", "social", "tax", "tin", "passport", "licence", "license", "driver", "steuer", "sozialv", "reisepass", "führerschein", "passeport", "permis", "sécurité", "pasaporte", "nif", "nie", "dni", "seguridad")
_ID = re.compile(r"(?<![\w+(.-])(?:[A-Z]{1,2}-?)?\d(?:[ .-]?\d){5,16}[A-Z]?(?![\w-])|(?<!\w)[A-Z]\d{3}-\d{3}-\d{2,3}(?!\w)")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")

# Names of streets' kinds, as they stand in addresses.
_STREET = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Way|Boulevard|Blvd|Place|Pl|Terrace|Ter|Circle|Cir|Highway|Hwy|Parkway|Pkwy|Trail|Trl|Square|Sq"
_STREET_FR = "rue|avenue|chemin|boulevard|place|route|allée|impasse|quai|cours|passage|sentier"
_STREET_ES = "Avenida|Calle|Camino|Plaza|Paseo|Carretera|Travesía|Ronda|C/|Avda\\.?"
_STREET_DE = "straße|strasse|str\\.|weg|gasse|allee|platz|ring|damm|ufer|steig|pfad"
_CAP = r"[A-ZÄÖÜÉÈ][\w'’-]*"
_GAP = r"(?:[ \t ]+|[ \t]*\n[ \t]*)"
# The signs that _GAP can begin with.
_GAP_STARTS = tuple(c for c in map(chr, range(0x3100)) if re.fullmatch(_GAP, c))
_UNIT = rf"(?:(?:,{_GAP}?|{_GAP})(?:(?:Apt|Apartment|Suite|Ste|Unit|Room|Rm|Fl|Floor)\.?{_GAP}#?\d+[A-Za-z]?\b|#{_GAP}?\d+[A-Za-z]?\b))?"
_NUMBER_NAME = re.compile(r"\d[A-Za-z]?[ \t ]+[A-ZÄÖÜÉÈ]")
# Each form of address with what a text must hold for it to be looked for: one of these stands wherever the form matches.
_ADDRESSES = tuple(
    (gate, re.compile(form))
    for gate, form in (
        (_STREET.split("|"), rf"(?<![\w.,/#-])\d{{1,5}}[A-Za-z]?[ \t ]+(?:(?:N|S|E|W|NE|NW|SE|SW|North|South|East|West)\.?{_GAP})?(?:{_CAP}{_GAP}){{1,4}}?(?:(?:St|Ave)\b\.?|(?:{_STREET})\b(?:\.(?=,|[ \t](?:[a-z]|Apt|Suite|Ste|Unit|#)))?){_UNIT}"),
        (_STREET_FR.split("|"), rf"(?<![\w-])\d{{1,4}}(?:[ \t]?(?:bis|ter|[A-D]))?,?{_GAP}(?:{_STREET_FR}){_GAP}(?:(?:de{_GAP}la|de|du|des|d['’]|la|le|les){_GAP}?)?{_CAP}(?:[ -]{_CAP})?"),
        (["Avenida", "Calle", "Camino", "Plaza", "Paseo", "Carretera", "Travesía", "Ronda", "C/", "Avda"], rf"(?<!\w)(?:{_STREET_ES}){_GAP}(?:(?:de{_GAP}la|de|del|las?|los|el){_GAP})?{_CAP}(?:{_GAP}{_CAP})?,?{_GAP}(?:n[.º°]*{_GAP}?)?\d{{1,4}}\b(?:,?{_GAP}\d+[ºª°]?(?:{_GAP}?[A-D]\b)?)?"),
        ([f"{x}{y}" for x in _STREET_DE.replace("\\", "").split("|") for y in _GAP_STARTS], rf"(?<!\w){_CAP}(?:{_STREET_DE}){_GAP}\d{{1,4}}(?:[ \t]?[a-h])?\b"),
        (["Allee", "Straße", "Strasse", "Str.", "Weg", "Gasse", "Platz", "Ring", "Damm", "Ufer"], rf"(?<!\w)(?:{_CAP}(?:er|en)?{_GAP})(?:Allee|Straße|Strasse|Str\.|Weg|Gasse|Platz|Ring|Damm|Ufer){_GAP}\d{{1,4}}(?:[ \t]?[a-h])?\b"),
        (["Box", "Postfach", "Apartado", "Boîte", "BP", "B.P"], rf"(?<!\w)(?:P\.?[ \t]?O\.?{_GAP}Box|Post{_GAP}Office{_GAP}Box|Postfach|Apartado(?:{_GAP}de{_GAP}Correos)?|Boîte{_GAP}postale|B\.?P\.?){_GAP}\d{{1,7}}\b"),
    )
)
_GATES = ahocorasick.Automaton()
for _form, (_words, _) in enumerate(_ADDRESSES):
    for _word in _words:
        _GATES.add_word(_word, _form)
_GATES.make_automaton()
# Words after or before a name that make it a place, a street or an organisation.
_PLACE_AFTER = frozenset(
    "creek ridge basin flats gap valley mill road rd lane ln drive dr street st avenue ave court ct way blvd boulevard tract tracts river lake mountain mountains mount "
    "forest park trail falls springs spring meadow meadows butte peak canyon pass bridge grove county national wilderness unit district press society foundation project stand stands sale law area site museum library hall center centre".split()
)
_PLACE_BEFORE = frozenset("mount mt lake fort port cape camp point upper lower river rio la le".split())
_TITLES = frozenset("dr mr mrs ms miss prof professor sir herr frau señor señora sr sra monsieur madame mme m".split())
_NAME_GAP = re.compile(r",?[ \t ]+(?:[A-Z]\.[ \t ]+)?")
_AFTER = re.compile(r"[ \t ]+([^\W_]+)")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ][^\W\d_]+(?:[-'’][^\W\d_]+)*")
_NEXT = re.compile(r"(?:[ \t ]+|[ \t]*\n[ \t]*)([^\W\d_]+(?:['’-][^\W\d_]+)*)")
_BEFORE = re.compile(r"([^\W\d_]+(?:['’-][^\W\d_]+)*)(?:[ \t ]+|[ \t]*\n[ \t]*)$")
# Words that aren't looked at as neighbours of names.
_NO_NAMES = _PLACE_AFTER | _TITLES | frozenset(re.sub(r"[\\.?]", "", f"{_STREET}|{_STREET_FR}|{_STREET_ES}|{_STREET_DE}|po|box|postfach|apartado").lower().split("|"))


class Names:
    """Terms that are parts of names: for each lower-cased term whether it is known as given (1), family (2) or both (3)."""

    def __init__(self, roles: dict[str, int], ordinary: frozenset[str] = frozenset()):
        self.roles, self.ordinary = roles, ordinary
        self.automaton = ahocorasick.Automaton()
        for w, r in roles.items():
            self.automaton.add_word(w, (len(w), r))
        if roles:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """``(start, end, role)`` of whole words that are parts of names, longest first at each place."""
        if not self.roles:
            return []
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        found: dict[int, tuple[int, int]] = {}
        n = len(low)
        for end, (size, role) in self.automaton.iter(low):
            a, b = end - size + 1, end + 1
            if (a and (low[a - 1].isalnum() or low[a - 1] in "_-'’@")) or (b < n and (low[b].isalnum() or low[b] in "_@" or low[b] == "-" and b + 1 < n and low[b + 1].isalnum())):
                continue
            if a not in found or found[a][0] < b:
                found[a] = (b, role)
        return sorted((a, b, r) for a, (b, r) in found.items())


def corpus_evidence(records: DataFrame, text_col: str = "body_text") -> DataFrame:
    """``(kind, term, other, n)``: in how many texts each ``word`` stands in any case, each ``pair`` of capitalised ones right
    before each other, or after each other and a comma, as given and family name may stand, and each cue, the word before
    it, of a number in the form of a phone's: ``sure`` where it begins with a plus or a bracket, else ``plain``. Pairs with
    words of places, streets or titles, and those that such a word or a number follows, aren't counted. Terms are lower-cased.
    """

    def run(texts):
        total, pairs, cues = Counter(), Counter(), Counter()
        for t in texts:
            beside = set()
            cues.update({(_cue(t, m.start()), m[0][0] in "+(") for m in _phones(t)})
            last, end = "", -9
            for m in _CAPITAL.finditer(t):
                x = m.start()
                if x - end < 6 and (gap := t[end:x])[-1:] == " " and _NAME_GAP.fullmatch(gap):
                    a, b = last.lower(), m[0].lower()
                    after = _AFTER.match(t, m.end())
                    if not {a, b} & _NO_NAMES and not (after and (after[1].lower() in _NO_NAMES or after[1][0].isdigit())):
                        beside.add((b, a) if gap[0] == "," else (a, b))
                last, end = m[0], m.end()
            pairs.update(beside)
            total.update(set(_TOKEN.findall(t.lower())))
        yield from (("word", w, None, n) for w, n in total.items())
        yield from (("pair", a, b, n) for (a, b), n in pairs.items())
        yield from (("sure" if sure else "plain", w, None, n) for (w, sure), n in cues.items() if w)

    texts = records.select(F.col(text_col).alias("t")).where("length(t) > 0")
    return map_columns(texts, run, "kind string, term string, other string, n bigint").groupBy("kind", "term", "other").agg(F.sum("n").alias("n"))


def _phones(text: str) -> Iterator[re.Match]:
    """Numbers in the form of a phone's."""
    return (p for c in _DIGITS.finditer(text) for p in _PHONE.finditer(text, max(0, c.start() - 3), min(len(text), c.end() + 2)))


def _head(text: str, at: int) -> str:
    """What stands before a place, markup that opens there aside."""
    return _OPENING.sub(" ", text[max(0, at - 60) : at])


def _cue(text: str, at: int) -> str:
    """The lower-cased word before a number, or an empty string."""
    m = _CUE.search(_head(text, at))
    return m[1].lower() if m else ""


_CUE = re.compile(r"([^\W\d_]{2,})[.:#]?[ \t]*(?:\n\s*)?$")


def misleading_cues(evidence: DataFrame, least: float = 0.25, most: int = 1_000_000) -> frozenset[str]:
    """Words before which numbers in the form of a phone's disclose none: the upper bound of the share that is surely a
    phone's is less than ``least`` times that of all cues. There are few; more than ``most`` raise."""
    cues = evidence.where("kind IN ('sure', 'plain')").groupBy("term").agg(F.coalesce(F.sum(F.when(F.col("kind") == "sure", F.col("n"))), F.lit(0)).alias("sure"), F.sum("n").alias("n"))
    every = cues.agg((F.sum("sure") / F.sum("n")).alias("share"))  # one row
    rows = cues.join(F.broadcast(every)).where(_bounds(F.col("sure"), F.col("n"))[1] < least * F.col("share")).select("term").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} misleading cues")
    return frozenset(r["term"] for r in rows)


def _bounds(part: Column, whole: Column, z: float = 1.28) -> tuple[Column, Column]:
    """Wilson's bounds of a share, each exceeded in one case of ten."""
    p = F.least(part / whole, F.lit(1.0))
    mid, half = p + z * z / (2 * whole), z * F.sqrt(p * (1 - p) / whole + z * z / (4 * whole * whole))
    return (mid - half) / (1 + z * z / whole), (mid + half) / (1 + z * z / whole)


def disclosure(evidence: DataFrame, names: DataFrame, small: bool = True) -> DataFrame:
    """``(term, given, family, n, low, high, bits)``: how often a term stands as given name before a known family name and as
    family name after a known given name, bounds of the greater one's share of all the term's texts, and the pointwise mutual
    information, at the lower bound, of the term and a name beside it.

    ``names`` is a written table ``(name, role)``; it is broadcast where it is ``small``.
    """
    beside = lambda role: (F.broadcast if small else lambda x: x)(names.where(f"role & {role} > 0").select("name"))
    pairs = evidence.where("kind = 'pair'")
    given = pairs.join(beside(2), F.col("other") == F.col("name")).groupBy("term").agg(F.sum("n").alias("given"))
    family = pairs.join(beside(1), F.col("term") == F.col("name")).groupBy(F.col("other").alias("term")).agg(F.sum("n").alias("family"))
    named = given.join(family, "term", "full").na.fill(0, ["given", "family"])
    every = evidence.where("kind = 'word'").select("term", "n")
    total = every.agg(F.sum("n").alias("all"))
    contexts = named.agg(F.sum(F.col("given") + F.col("family")).alias("beside"))
    # one row each
    x = named.join(every, "term").join(F.broadcast(total)).join(F.broadcast(contexts))
    low, high = _bounds(F.greatest("given", "family"), F.col("n"))
    return x.select("term", "given", "family", "n", low.alias("low"), high.alias("high"), F.round(F.log2(low / (F.col("beside") / F.col("all"))), 6).alias("bits"))


def learned_names(evidence: DataFrame, lexicon: DataFrame, least_share: float = 0.15, least_bits: float = 1.0, least: int = 2, weak_share: float = 0.1, max_broadcast_rows: int = 200_000, max_rounds: int = 20) -> DataFrame:
    """``(name, role, n)`` of the corpus's terms that disclose a name beside them and of how many texts they stand in; a written
    table, without the lexicon's names. ``evidence`` is a written table of :func:`corpus_evidence`.

    A term is taken when names stand beside it in at least ``least`` texts, the lower bound of their share of its texts is
    ``least_share`` or more, and it tells of a name by ``least_bits`` or more; bounds and bits mean the same in a corpus of any
    size. Names that stand beside others in less than ``weak_share`` of their texts (the upper bound), being mostly ordinary
    words or parts of places, are no evidence. What a round learns is known to the next, until nothing is added.
    """
    spark = evidence.sparkSession
    known = lexicon_names(lexicon)
    start = written(spark.createDataFrame(list(known.items()), "name string, role int"), "names")
    told = start.join(disclosure(evidence, start).select(F.col("term").alias("name"), "high"), "name", "left")
    told = told.join(evidence.where("kind = 'word'").select(F.col("term").alias("name"), "n"), "name", "left")
    sound = F.coalesce("high", _bounds(F.lit(0), F.col("n"))[1], F.lit(1.0)) >= weak_share
    names = written(told.where(sound).select("name", "role"), "names")
    start = F.broadcast(start.select(F.col("name").alias("term")))  # the given lexicon
    learned = None
    for _ in range(max_rounds):
        rows = disclosure(evidence, names, small_enough(names, max_broadcast_rows)).where((F.greatest("given", "family") >= least) & (F.col("low") >= least_share) & (F.col("bits") >= least_bits))
        role = F.when(F.col("given") >= F.col("family"), 1).otherwise(0) + F.when(F.col("family") >= F.col("given"), 2).otherwise(0)
        new = rows.join(start, "term", "left_anti").select(F.col("term").alias("name"), role.cast("int").alias("role"), "n")
        if learned is not None:
            new = new.join(learned.select("name"), "name", "left_anti")
        new = written(new, "learned")
        if small_enough(new, 0):
            return new if learned is None else learned
        learned = new if learned is None else written(learned.unionByName(new), "learned")
        names = written(names.unionByName(new.drop("n")), "names")
    return learned


def lexicon_names(lexicon: DataFrame, most: int = 1_000_000) -> dict[str, int]:
    """The roles of a lexicon's lower-cased names; a lexicon of more than ``most`` rows, no longer a small given table, raises."""
    rows = lexicon.where("name IS NOT NULL").select(F.lower("name").alias("name"), "name_kind").distinct()
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a lexicon of more than {most} names")
    known: dict[str, int] = {}
    for r in got:
        known[r["name"]] = known.get(r["name"], 0) | (1 if r["name_kind"] == "given" else 2)
    return known


# Names that are also ordinary words.
_ORDINARY = frozenset("april ash basil cliff heather rose brook forest frost hill marsh wood may june august ray mark will grace hope dale glen reed stone rivers lake field fields".split())


def find_persons(text: str, names: Names) -> list[tuple[int, int]]:
    """Spans of person names: given names or initials with a family name, in either order."""
    hits = names.hits(text)
    if not hits:
        return []
    at = {a: (b, r) for a, b, r in hits}
    out: list[tuple[int, int]] = []
    done = -1

    for a, b, role in hits:
        if a < done:
            continue
        best = None
        # given names and initials before the family name
        if role & 1:
            pos, seen = b, 0
            while True:
                m = re.compile(r"(?:[ \t ]+|[ \t]*\n[ \t]*)").match(text, pos)
                if not m:
                    break
                init = re.compile(r"[A-Z]\.").match(text, m.end())
                if init:
                    pos = init.end()
                elif m.end() in at:
                    e, r = at[m.end()]
                    if r & 2:
                        best = (a, e)
                    if not r & 1:
                        break
                    pos = e
                else:
                    break
                seen += 1
                if seen > 3:
                    break
        # family name, given names
        if role & 2:
            m = re.compile(r",(?:[ \t ]+|[ \t]*\n[ \t]*)").match(text, b)
            if m and m.end() in at and at[m.end()][1] & 1:
                end = at[m.end()][0]
                while True:
                    g = re.compile(r"(?:[ \t ]+|[ \t]*\n[ \t]*)").match(text, end)
                    if not g:
                        break
                    init = re.compile(r"[A-Z]\.").match(text, g.end())
                    if init:
                        end = init.end()
                    elif g.end() in at and at[g.end()][1] == 1 and not re.compile(r"(?:[ \t ]+|[ \t]*\n[ \t]*)[A-Z]").match(text, at[g.end()][0]):
                        end = at[g.end()][0]
                    else:
                        break
                if best is None or end > best[1]:
                    best = (a, end)
            if m and best is None:
                init = re.compile(r"(?:[A-Z]\.[ \t ]?)+").match(text, m.end())
                if init:
                    best = (a, init.end() if text[init.end() - 1] == "." else init.end() - 1)
            if best is None:
                # initials before a family name
                m = re.search(r"(?<![\w.])(?:[A-Z]\.[ \t ]*\n?)+$", text[max(0, a - 12) : a])
                if m and not (b < len(text) and text[b : b + 1] == ","):
                    best = (a - len(m[0]), b)
                elif m:
                    best = (a - len(m[0]), b)
            if best is None and role & 2:
                # family name right before a given name
                m = re.compile(r"[ \t ]+").match(text, b)
                if m and m.end() in at and at[m.end()][1] == 1 and role == 2:
                    e = at[m.end()][0]
                    g = re.compile(r"[ \t ]+").match(text, e)
                    if not (g and g.end() in at and at[g.end()][1] & 2):
                        best = (a, e)
        if best is None:
            continue
        x, y = best
        words = [w.lower() for w in _TOKEN.findall(text[x:y])]
        if all(w in names.ordinary or len(w) < 2 for w in words) and not text[x].isupper():
            continue
        if not text[x].isupper() and any(w in names.ordinary for w in words):
            continue
        after, before = _NEXT.match(text, y), _BEFORE.search(text[max(0, x - 40) : x])
        if after and after[1].lower() in _PLACE_AFTER and "," not in text[x:y]:
            if after[1].lower() not in ("dr", "project", "will", "may") or after[1][0].isupper() and after[1].lower() != "dr":
                continue
        if before and before[1].lower() in _PLACE_BEFORE and before[1][0].isupper():
            continue
        if before and before[1].lower() == "the" and all(w in names.ordinary for w in words):
            continue
        if before and re.search(r"\d+\s+(?:[NSEW]{1,2}\.?\s+)?(?:Old\s+)?$", text[max(0, x - 20) : x]):
            continue
        if re.compile(r"\s+\d").match(text, y) and words[-1] == "april":
            continue
        out.append((x, y))
        done = y
    return out


def find_personal(text: str | None, names: Names, misleading: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of personal data, not overlapping, in text order. NULL and empty texts have none.

    ``misleading`` are cues before which the corpus has no phone numbers, beside those that are always known.
    """
    if not text:
        return []
    spans: list[tuple[int, int, str]] = []
    low = text.lower()
    done = 0
    for m in _AT.finditer(text) if "@" in text or "at]" in low or "at)" in low or "at}" in low or "at>" in low else ():
        # an address has at most 64 characters before its sign and 255 after it
        e = _EMAIL.search(text, max(done, m.start() - 65), m.end() + 256)
        while e and e.end() <= m.start():
            e = _EMAIL.search(text, e.end(), m.end() + 256)
        if e and e.start() < m.end():
            spans.append((e.start(), e.end(), "email"))
            done = e.end()
    if " dot " in low:
        spans += [(m.start(), m.end(), "email") for m in _EMAIL_WORDS.finditer(text)]
    for m in _ID.finditer(text) if any(x in low for x in _ID_STEMS) else ():
        head = _head(text, m.start())
        if _ID_CUE.search(head) and not _OTHER_NUMBER.search(head.split("icen")[-1] if "icen" in head else head):
            spans.append((m.start(), m.end(), "id_number"))
    for m in _phones(text):
        if m[0][0] in "+(" or not _OTHER_NUMBER.search(_head(text, m.start())) and _cue(text, m.start()) not in misleading:
            spans.append((m.start(), m.end(), "phone"))
    for form in {x for _, x in _GATES.iter(text)}:
        if form or _NUMBER_NAME.search(text):
            spans += [(m.start(), m.end(), "address") for m in _ADDRESSES[form][1].finditer(text)]
    spans += [(a, b, "person") for a, b in find_persons(text, names)]
    order = {k: i for i, k in enumerate(KINDS)}
    out: list[tuple[int, int, str]] = []
    for s in sorted(spans, key=lambda s: (s[0], -s[1], order[s[2]])):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
        elif order[s[2]] < order[out[-1][2]] and s[1] - s[0] >= out[-1][1] - out[-1][0]:
            out[-1] = s
    return out


def replace_personal(text: str, spans: Iterable[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its typed placeholder, all else as it was."""
    parts, pos = [], 0
    for a, b, kind in spans:
        parts += [text[pos:a], f"[{kind.upper()}]"]
        pos = b
    return "".join(parts) + text[pos:]


def sanitize(records: DataFrame, lexicon: DataFrame, id_col: str = "id", text_col: str = "body_text", max_broadcast_rows: int = 200_000) -> DataFrame:
    """``(record_id, found, clean_text)`` for each row with an id; ``found`` is an array of (kind, found).

    NULL texts come out as empty ones. Columns other than id and text are ignored. Of more than
    ``max_broadcast_rows`` learned names each record gets those it holds by a join, with the same result.
    """
    evidence = written(corpus_evidence(records, text_col), "evidence")
    learned, misleading = learned_names(evidence, lexicon, max_broadcast_rows=max_broadcast_rows), misleading_cues(evidence)
    known = lexicon_names(lexicon)
    few = small_enough(learned, max_broadcast_rows)
    if few:
        known |= {r["name"]: r["role"] for r in learned.collect()}
    shared = records.sparkSession.sparkContext.broadcast(known)
    held: dict = {}

    def run(ids, texts, own=None):
        if "names" not in held:
            held["names"] = Names(shared.value, _ORDINARY)
        for n, (i, t) in enumerate(zip(ids, texts)):
            names = held["names"] if own is None or not own[n] else Names(shared.value | {x["name"]: x["role"] for x in own[n]}, _ORDINARY)
            spans = find_personal(t, names, misleading)
            yield i, [{"kind": k, "found": t[a:b]} for a, b, k in spans], replace_personal(t or "", spans)

    rows = records.select(F.col(id_col).cast("string").alias("record_id"), F.col(text_col).alias("text")).where("record_id IS NOT NULL")
    if not few:
        words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+(?:['’-][\p{L}]+)*"), F.lit(0))
        # a possessive's ending is no part of the name
        every = F.array_distinct(F.concat(words, F.transform(words, lambda w: F.regexp_replace(w, "['’].*$", ""))))
        each = rows.select("record_id", F.explode(every).alias("name")).distinct()
        own = join_counted(each, learned, "name", "n", max_broadcast_rows=max(1, max_broadcast_rows)).groupBy("record_id").agg(F.collect_list(F.struct("name", "role")).alias("own"))  # no more than a record's own words
        rows = rows.join(own, "record_id", "left")
    return map_columns(rows, run, "record_id string, found array<struct<kind:string,found:string>>, clean_text string")


def disclosing_terms(sanitized: DataFrame, least_records: int = 3, least_share: float = 0.6, least_bits: float = 6.0, max_broadcast_rows: int = 200_000) -> DataFrame:
    """``(term, person, records, share, bits)``: capitalised terms that tell of one person although no part of the name.

    ``sanitized`` has ``(record_id, terms, persons)``. A term discloses a person when it stands in ``least_records`` of
    that person's records, these are ``least_share`` of its own, and their mutual information is ``least_bits`` or more. Counts are
    over all records. Only terms and persons of enough records meet, and of these only such as can reach the share, so
    that a directory's common words and single mentions make no pairs.
    """
    each = {c: sanitized.select("record_id", F.explode(f"{c}s").alias(c)).distinct() for c in ("term", "person")}
    support = {c: written(d.groupBy(c).agg(F.count("*").alias(f"n_{c}")).where(F.col(f"n_{c}") >= least_records), f"{c}s") for c, d in each.items()}
    total = sanitized.agg(F.count_distinct("record_id").alias("all"))
    most = support["person"].agg(F.max("n_person").alias("most"))
    terms = join_counted(each["term"], support["term"], "term", "n_term", max_broadcast_rows=max_broadcast_rows)
    terms = terms.join(F.broadcast(most)).where(F.col("n_term") * least_share <= F.col("most")).drop("most")  # one row
    persons = join_counted(each["person"], support["person"], "person", "n_person", max_broadcast_rows=max_broadcast_rows)
    met = terms.join(persons, "record_id").where(F.col("n_term") * least_share <= F.col("n_person"))
    both = met.groupBy("term", "person").agg(F.count("*").alias("records"), F.max("n_term").alias("nt"), F.max("n_person").alias("np"))
    x = both.where(F.col("records") >= least_records).join(F.broadcast(total))  # one row
    share = F.col("records") / F.col("nt")
    x = x.withColumn("share", F.round(share, 6)).withColumn("bits", F.round(F.log2(share / (F.col("np") / F.col("all"))), 6))
    return x.where((F.col("share") >= least_share) & (F.col("bits") >= least_bits)).select("term", "person", "records", "share", "bits")


def generalized(records: DataFrame, lexicon: DataFrame, id_col: str = "id", text_col: str = "body_text", max_broadcast_rows: int = 200_000) -> DataFrame:
    """``(record_id, replaced, generalized, clean_text)``: :func:`sanitize`, then terms that still disclose a person give way to ``[TERM]``.

    Numbers of both kinds of replacement stand beside the text. NULL texts come out as empty ones.
    """

    def with_terms(ids, found, texts):
        for i, f, t in zip(ids, found, texts):
            terms = sorted({w for w in _CAPITAL.findall(t) if len(w) > 3 and w.upper() not in _PLACEHOLDERS})
            persons = sorted({" ".join(x["found"].lower().replace(",", " ").split()) for x in f if x["kind"] == "person"})
            yield i, len(f), t, terms, persons

    base = written(map_columns(sanitize(records, lexicon, id_col, text_col), with_terms, "record_id string, replaced int, clean_text string, terms array<string>, persons array<string>"), "sanitized")
    terms = written(disclosing_terms(base, max_broadcast_rows=max_broadcast_rows).select("term").distinct(), "terms")
    side = F.broadcast(terms) if small_enough(terms, max_broadcast_rows) else terms
    hit = base.select("record_id", F.explode("terms").alias("term")).join(side, "term", "left_semi")
    per = hit.groupBy("record_id").agg(F.collect_set("term").alias("bad"))  # no more than a record's own terms

    def replace(ids, replaced, texts, bad):
        for i, n, t, b in zip(ids, replaced, texts, bad):
            done = 0
            if b:
                t, done = re.subn(r"(?<![\w'’-])(?:" + "|".join(map(re.escape, sorted(b, key=len, reverse=True))) + r")(?![\w'’-])", "[TERM]", t)
            yield i, n, done, t

    joined = base.select("record_id", "replaced", "clean_text").join(per, "record_id", "left")
    return map_columns(joined, replace, "record_id string, replaced int, generalized int, clean_text string")


_PLACEHOLDERS = frozenset(k.upper() for k in KINDS) | {"ID_NUMBER", "NUMBER", "TERM"}


def personal_data(records: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Distinct ``(record_id, kind, found)``."""
    f = sanitize(records, lexicon).select("record_id", F.explode("found").alias("f"))
    return f.select("record_id", "f.kind", "f.found").distinct()

"""Per-document text quality statistics (problem 10).

Statistics of every document and of each of its lines tell natural prose from lists, tables and junk.
Gradient-boosted trees are trained on lines weakly labelled by rules that abstain when in doubt, from a
bounded sample of documents, and calibrated by class on lines checked by hand that aren't trained on. A line's
kind is the one of the greatest calibrated probability, a document's kind what most of its characters belong to.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.batches import common_words, map_columns
from holdfast.llm.trees import BoostedTrees

KINDS = ("prose", "list", "table", "junk")

_ITEM = re.compile(r"\s*(?:[-*•–—·▪◦‣+]|\[[ xX]?\]|\(?\d{1,3}[.)]|\(?[a-z][.)]|\([ivxlc]{1,7}\)|[ivxlc]{1,7}[.)]|o(?=\s))\s+\S")
_LOG = re.compile(r"\d\d:\d\d(?::\d\d)?|\b(?:GET|POST|ERROR|WARN|INFO|DEBUG|0x[0-9a-f]+)\b|\b[0-9a-f]{8}:|https?://\S{30,}")
_VOWEL = frozenset("aeiouyäöüáéíóúàèùâêîôûëïAEIOUYÄÖÜÁÉÍÓÚÀÈÙÂÊÎÔÛËÏ")

# Classes of code points: 0 other sign, 1 letter, 2 capital, 3 digit, 4 space, 5 vowel, 6 capital vowel, 7 end of sentence, 8 comma or the like
_CLASS = np.zeros(0x250, np.int64)
for _c in range(0x250):
    _s = chr(_c)
    _CLASS[_c] = (5 if _s in _VOWEL else 1) + _s.isupper() if _s.isalpha() else 3 if _s.isdigit() else 4 if _s.isspace() else 7 if _s in ".!?" else 8 if _s in ",;:'\"()-" else 0

FEATURES = (
    "length letters capitals digits spaces signs vowels words word_length longest stop_share item ends_sentence ends_item cells same_cells log start_capital "
    "distinct_words repeats top_sign doc_stop doc_item doc_cells doc_distinct near_stop near_item near_cells runs_on doc_length_median doc_line_deviation"
).split()
_ID = {f: i for i, f in enumerate(FEATURES)}


def _sum(index: np.ndarray, weight: np.ndarray | None, n: int) -> np.ndarray:
    return np.bincount(index, weight, n).astype(float)


def _near(value: np.ndarray, weight: np.ndarray, doc: np.ndarray, reach: int = 3) -> np.ndarray:
    """Weighted mean over the lines up to ``reach`` away in the same document."""
    num, den = value * weight, weight.copy()
    v, w = num.copy(), den.copy()
    for k in range(1, reach + 1):
        same = doc[k:] == doc[:-k]
        num[k:] += v[:-k] * same
        den[k:] += w[:-k] * same
        num[:-k] += v[k:] * same
        den[:-k] += w[k:] * same
    return num / np.maximum(den, 1e-9)


def batch_features(texts: list[str], stop: frozenset[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], dict[str, np.ndarray]]:
    """Features of all lines that aren't blank, their weights in characters other than white space, the number of
    each one's document, the lines, and the documents' statistics by name.

    The texts of a batch are worked on as one array of code points.
    """
    docs = len(texts)
    lines: list[str] = []
    doc_of: list[int] = []
    for d, t in enumerate(texts):
        own = [x for x in t.split("\n") if x and not x.isspace()]
        lines += own
        doc_of += [d] * len(own)
    n = len(lines)
    doc = np.array(doc_of, np.int64)
    if not n:
        return np.zeros((0, len(FEATURES))), np.zeros(0), doc, lines, _statistics(docs, doc, lines, np.zeros((0, len(FEATURES))), np.zeros((0, 10)), np.zeros(0), np.zeros(0), np.zeros(docs))
    joined = "\n".join(lines)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    # more letters are told apart from signs only by where they stand
    cls = np.where(code < 0x250, _CLASS[np.minimum(code, 0x24F)], np.where((code >= 0x370) & (code < 0x2000) | (code >= 0x2E80) & (code < 0xE000), 1, 0))
    newline = code == 10
    row = np.cumsum(newline) - newline
    cls = np.where(newline, 9, cls)
    count = np.bincount(row * 10 + cls, minlength=n * 10).reshape(n, 10).astype(float)
    length = count[:, :9].sum(1)
    letters = count[:, 1] + count[:, 2] + count[:, 5] + count[:, 6]
    size = np.maximum(length, 1)
    out = np.zeros((n, len(FEATURES)))
    set_ = lambda name, v: out.__setitem__((slice(None), _ID[name]), v)
    set_("length", np.log1p(length))
    set_("letters", letters / size)
    set_("capitals", (count[:, 2] + count[:, 6]) / np.maximum(letters, 1))
    set_("digits", count[:, 3] / size)
    set_("spaces", count[:, 4] / size)
    set_("signs", count[:, 0] / size)
    set_("vowels", (count[:, 5] + count[:, 6]) / np.maximum(letters, 1))
    # words: runs without white space; their lines and lengths come from the code points
    blank = (cls == 4) | newline
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    ends = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
    word_row = row[starts]
    words = _sum(word_row, None, n)
    tokens = joined.lower().split()
    if len(tokens) == len(starts):
        hits = np.fromiter((t in stop for t in tokens), float, len(tokens))
    else:  # lower-casing or a rare space changed the words
        tokens = [joined[a:b].lower() for a, b in zip(starts.tolist(), ends.tolist())]
        hits = np.fromiter((t in stop for t in tokens), float, len(tokens))
    stops = _sum(word_row, hits, n)
    set_("words", np.log1p(words))
    set_("word_length", (length - count[:, 4]) / np.maximum(words, 1))
    longest = np.zeros(n)
    np.maximum.at(longest, word_row, (ends - starts).astype(float))
    set_("longest", longest)
    stop_share = stops / np.maximum(words, 1)
    set_("stop_share", stop_share)
    item = np.fromiter((_ITEM.match(x) is not None for x in lines), float, n)
    set_("item", item)
    last = np.fromiter((x.rstrip()[-1] for x in lines), "U1", n)
    ends_sentence = np.isin(last, list(".!?…\"”»)"))
    set_("ends_sentence", ends_sentence)
    set_("ends_item", np.isin(last, list(",;")))
    first = np.fromiter((x.lstrip("\"'>«„“ ")[:1].isupper() for x in lines), float, n)
    set_("start_capital", first)
    # cells: bars, tabs, runs of two spaces or more within a line, commas and semicolons other than at its end
    follows = np.r_[code[1:], 10]
    inside = follows != 10
    gap = (code == 32) & (follows == 32) & np.r_[True, code[:-1] != 32] & np.r_[True, ~newline[:-1]]
    mark = (code == 124) | (code == 9) | gap & inside | ((code == 59) | (code == 44)) & inside
    cells = _sum(row, mark.astype(float), n)
    set_("cells", np.minimum(cells, 12) / np.maximum(words, np.minimum(cells, 12) + 1))
    same = np.zeros(n)
    for k in (1, 2):
        alike = (cells[k:] == cells[:-k]) & (doc[k:] == doc[:-k]) & (cells[k:] > 0)
        same[k:] += alike
        same[:-k] += alike
    set_("same_cells", same)
    log = np.zeros(n)
    for i in np.flatnonzero((out[:, _ID["digits"]] > 0.08) | (longest > 30)).tolist():
        log[i] = len(_LOG.findall(lines[i]))
    set_("log", log)
    distinct = np.ones(n)
    for i in np.flatnonzero(words >= 12).tolist():
        w = lines[i].split()
        distinct[i] = len(set(w)) / len(w)
    set_("distinct_words", distinct)
    seen: dict[tuple[int, str], int] = {}
    keys = list(zip(doc_of, lines))
    for k in keys:
        seen[k] = seen.get(k, 0) + 1
    set_("repeats", np.fromiter((seen[k] for k in keys), float, n))
    set_("top_sign", count[:, :9].max(1) / size)
    weight = size - count[:, 4]
    per_doc = np.maximum(_sum(doc, weight, docs), 1)
    mean = lambda v: (_sum(doc, v * weight, docs) / per_doc)[doc]
    set_("doc_stop", mean(stop_share))
    set_("doc_item", mean(item))
    set_("doc_cells", mean(out[:, _ID["cells"]]))
    bounds = np.r_[0, np.cumsum(np.bincount(doc, words, docs)).astype(int)]
    different = np.array([len(set(tokens[a:b])) for a, b in zip(bounds, bounds[1:])], float)
    set_("doc_distinct", (different / np.maximum(np.bincount(doc, words, docs), 1))[doc])
    set_("near_stop", _near(stop_share, words, doc))
    set_("near_item", _near(item, np.ones(n), doc))
    set_("near_cells", _near(out[:, _ID["cells"]], np.ones(n), doc))
    runs = np.zeros(n)
    on = (~ends_sentence[:-1]) & (first[1:] == 0) & (doc[1:] == doc[:-1])
    runs[:-1] += on
    runs[1:] += on
    set_("runs_on", runs)
    order = np.lexsort((out[:, 0], doc))
    many = np.bincount(doc, minlength=docs)
    begin = np.r_[0, np.cumsum(many)[:-1]]
    median = out[order, 0][np.minimum(begin + many // 2, n - 1)]
    set_("doc_length_median", median[doc])
    m1, m2 = _sum(doc, out[:, 0], docs) / np.maximum(many, 1), _sum(doc, out[:, 0] ** 2, docs) / np.maximum(many, 1)
    set_("doc_line_deviation", np.sqrt(np.maximum(m2 - m1**2, 0))[doc])
    return out, weight, doc, lines, _statistics(docs, doc, lines, out, count, words, stops, different)


def _statistics(docs: int, doc: np.ndarray, lines: list[str], x: np.ndarray, count: np.ndarray, words: np.ndarray, stops: np.ndarray, different: np.ndarray) -> dict[str, np.ndarray]:
    """The documents' statistics; zeros where a text is blank."""
    n_words, n_lines = _sum(doc, words, docs), _sum(doc, None, docs)
    letters = _sum(doc, count[:, [1, 2, 5, 6]].sum(1), docs)
    chars = np.maximum(_sum(doc, count[:, :9].sum(1), docs), 1)
    at = lambda name: _sum(doc, x[:, _ID[name]], docs) / np.maximum(n_lines, 1)
    once = _sum(doc, 1 / np.maximum(x[:, _ID["repeats"]], 1), docs)
    return {
        "words": n_words.astype(int),
        "mean_word_length": letters / np.maximum(n_words, 1),
        "symbol_ratio": _sum(doc, count[:, 0], docs) / chars,
        "digit_ratio": _sum(doc, count[:, 3], docs) / chars,
        "upper_ratio": _sum(doc, count[:, 2] + count[:, 6], docs) / np.maximum(letters, 1),
        "lines": n_lines.astype(int),
        "ending_punctuation": at("ends_sentence"),
        "common_words": _sum(doc, stops, docs) / np.maximum(n_words, 1),
        "distinct_words": different / np.maximum(n_words, 1),
        "item_lines": at("item"),
        "repeated_lines": np.where(n_lines > 0, 1 - once / np.maximum(n_lines, 1), 0.0),
    }


def weak_labels(x: np.ndarray, lines: list[str]) -> np.ndarray:
    """A class for each line, or -1 where the rules abstain."""
    g = lambda f: x[:, _ID[f]]
    y = np.full(len(x), -1)
    words, length = np.expm1(g("words")), np.expm1(g("length"))
    stop, cells, letters, item = g("stop_share"), g("cells"), g("letters"), g("item") == 1
    fence = np.array([bool(re.fullmatch(r"[\s|+=:_-]*[|+][\s|+=:_-]*", s)) for s in lines], bool)
    few = np.array([len(set(s)) <= 3 for s in lines], bool)
    piped = np.array([s.count("|") >= 2 or "\t" in s.strip() or bool(re.search(r"\S {2,}\S", s)) for s in lines], bool)
    prose = (stop >= 0.22) & (words >= 6) & (letters >= 0.7) & ~item & (cells < 0.25) & (g("distinct_words") > 0.4) & (g("vowels") > 0.2)
    prose |= (g("near_stop") >= 0.28) & (g("runs_on") >= 1) & (letters >= 0.6) & ~item & (cells < 0.25) & (g("near_cells") < 0.2) & (g("vowels") > 0.2)
    table = (cells >= 0.4) & (g("same_cells") >= 1) & (stop < 0.35) & (length < 200) & (g("log") == 0) & ~item & (g("digits") > 0.05) | fence & (g("doc_cells") > 0.2)
    table |= piped & (g("same_cells") >= 1) & (words <= 40) & (g("log") == 0) & (letters + g("digits") > 0.25)
    table |= (cells >= 0.5) & (g("same_cells") >= 2) & (g("near_cells") >= 0.45) & (length < 200) & (g("log") == 0) & ~item
    items = item & (words <= 16) & (stop < 0.45) & (letters > 0.4)
    short = (length <= 60) & (words <= 8) & (letters >= 0.6) & (g("runs_on") < 2) & (g("near_stop") < 0.25) & (g("vowels") > 0.2) & (cells < 0.3) & ~piped & (g("log") == 0) & (g("near_cells") < 0.25)
    items |= short & (stop < 0.45) & (length >= 3) & (g("doc_length_median") < np.log1p(60))
    junk = (g("longest") > 30) & (words <= 12) & ~fence & (cells < 0.25) | (g("log") >= 1) & (stop < 0.15) | (letters < 0.15) & (g("spaces") < 0.1) & ~fence & (cells < 0.3)
    junk |= (g("vowels") < 0.18) & (letters > 0.6) & (length > 12) & (stop < 0.15) & ~item & (cells < 0.3)
    junk |= (words >= 12) & (stop < 0.08) & (letters > 0.7) & (cells < 0.1) & ~item
    junk |= (length > 8) & few & ~fence
    junk |= (g("signs") > 0.25) & ~fence & (cells < 0.25) & ~item
    votes = np.stack([prose, items, table, junk], 1)
    one = votes.sum(1) == 1
    y[one] = votes[one].argmax(1)
    y[fence & table] = 2
    y[junk & items & ~prose & ~table] = 3
    return y


def line_features(text: str, stop: frozenset[str]) -> tuple[np.ndarray, list[str]]:
    """Features of one text's lines, and the lines."""
    x, _, _, lines, _ = batch_features([text], stop)
    return x, lines


# Texts checked by hand, for calibration: each line of a text is of the kind given. The second half are passages of documents of
# a public test corpus, read and labelled one by one.
HOLDOUT = (
    ("prose", "The committee met on Tuesday and heard from three of the owners, who said that the road had been closed\nfor most of the winter and that nobody had told them when it would be opened again."),
    ("prose", "Er hat den Brief gestern geschrieben, aber er wurde erst heute mit der Post abgeholt. Die Kinder warten auf eine Antwort."),
    ("prose", "THE COUNCIL HAS NOT YET DECIDED WHETHER THE BRIDGE WILL BE BUILT OR WHETHER THE MONEY GOES TO THE SCHOOL."),
    ("prose", "\"We had no idea that the water was so low,\" she said. \"It has never been like this before.\""),
    ("prose", "> Il a dit que la maison était vendue et que les voisins ne le savaient pas encore.\n> Ils ont été surpris de la nouvelle, mais ils ne sont pas venus."),
    ("prose", "No fue posible llegar a la casa porque el camino estaba cubierto de nieve.\nLos vecinos esperaron hasta la noche.\nDespués volvieron a su pueblo."),
    ("prose", "It was late. The dog barked at us, and then it ran off into the trees. We never saw it again."),
    ("list", "- apples\n- two loaves of bread\n- cheese\n- candles, 12 pieces\n- matches"),
    ("list", "1. minutes of the last meeting\n2. election of the board\n3. budget\n4. any other business"),
    ("list", "a) town hall;\nb) library;\nc) old station;\nd) swimming pool;"),
    ("list", "Robin\nBlackbird\nGreat tit\nHouse sparrow\nCommon swift\nGrey heron"),
    ("list", "[ ] call the plumber\n[ ] copy of the keys\n[ ] water the plants\n[ ] book hotel"),
    ("list", "(i) map of the district\n(ii) photographs\n(iii) letter of 4 May\n(iv) list of members"),
    ("table", "name | age | town\nJo | 34 | Leeds\nKim | 29 | York\nAlex | 41 | Hull"),
    ("table", "month\train\tsun\nMay\t44\t201\nJune\t51\t220\nJuly\t39\t248"),
    ("table", "station      high     low     mean\nNorth        12.4     3.1     7.7\nSouth        15.0     5.2     10.1\nEast         n/a      4.0     -"),
    ("table", "id;price;sold\n17;4.50;yes\n18;3.20;no\n19;7.75;yes"),
    ("table", "+------+------+\n| item | cost |\n+------+------+\n| nail | 0.10 |\n+------+------+"),
    ("junk", "U29tZSBsb25nIGVuY29kZWQgdGV4dCB3aXRoIG5vIG1lYW5pbmcgYXQgYWxsIGhlcmU=\nQW5vdGhlciBsaW5lIG9mIHRoZSBzYW1lIHNvcnQgdGhhdCBnb2VzIG9uIGFuZCBvbg=="),
    ("junk", "10:14:07 GET /index.html 200 5120\n10:14:09 GET /logo.gif 304 0\n10:14:12 POST /form 500 77"),
    ("junk", "00000000: 4d5a 9000 0300 0000 0400 0000 ffff 0000\n00000010: b800 0000 0000 0000 4000 0000 0000 0000"),
    ("junk", "hotel cheap hotel flights hotel cheap flights hotel booking cheap cheap hotel flights booking hotel"),
    ("junk", "xqzv brtkl mnpw ghtrs vvkl pqrst zxcv bnmk\nwrtp lkjh gfds qwrt zxcvb mnbv plkm tgbn"),
    ("junk", "=*=*=*=*=*=*=*=*=*=*=*=*=*=\n~~~~~~~~~~~~~~~~~~~~~~~~\nxxxxxxxxxxxxxxxxxxxxxxxxx"),
    ("prose", 'Les parcelles échangées en 2001 étaient les plus belles de la forêt de Skellholt. Peu avant Noël 1981, la commune de Oskgate écrivait que la forêt de Lorngate ne serait plus touchée. Si la salamandre est de retour, la forêt de Kelsburn le doit surtout à 447 volontaires patients. Les riverains ont écrit à la commune de Oskgate pour demander que la limite soit respectée. Les parcelles échangées en'),
    ("prose", 'For the record, in February 2012, the hearing officer reviewed the salvage project near Thorndale Flats. In short, the company offered to trade remote plots at Tarnford Basin for 87 acres of flat ground, at least until 1972. Earlier that year, letters to the inspector ran 9 to one against the salvage project, and most mentioned red cedar, as the harvest ledger admits.'),
    ("prose", 'Old photographs from 2008 show degraded units where today only brush and stumps remain. The map attached to the monitoring report omits 40 miles of temporary road in Lornfork Flats. The trail to Mussmere Ridge crosses 24 streams and passes recently thinned parcels full of yew. According to the field notes, snag density exceeded the model between 1999 and 1987. The older road above Dunwick Creek'),
    ("prose", 'Ohne das Gutachten aus Ravley lässt sich nicht prüfen, welche Flächen die Gemeinde Yelburn verkauft hat. Es gibt keine Zahlen dazu, wie sich die Eibe nach dem Feuer von 1987 erholt hat. Es gibt keine Zahlen dazu, wie sich die Bachforelle nach dem Feuer von 1986 erholt hat. Seit dem Sturm von 1991 liegen im Oskburner Wald noch immer 275 Stämme quer über dem Weg.'),
    ("prose", 'Wie der Abschlussbericht zeigt, ist der Bestand seit 2007 um mehr als 358 Bäume kleiner geworden.\nDer Bach wurde an 885 Stellen gemessen, und das Wasser war überall zu warm.\nDie Gemeinde Mussmere und die Eigentümer haben sich auf einen Tausch von 432 Hektar geeinigt.\nNach der Räumung von 827 Hektar im Crowburner Tal war der Luchs nicht mehr zu finden.'),
    ("prose", 'A short section of the field notes deals with whitebark\npine; the rest is about costs. The estimate of 933 board\nfeet per acre seems high for such privately held\ndrainages, far more than in 2004. Both pine marten and'),
    ("prose", "Il n'y a plus de trace de la salamandre dans la forêt de\nSkellstead depuis la construction de la route. Si la salamandre\nest de retour, la forêt de Oskley le doit surtout à 665\nvolontaires patients."),
    ("prose", 'Sin el inventario de Dunstead nadie puede\ncomprobar qué terrenos vendió el municipio\nde Lornfork. Sin el inventario de Vellholt\nnadie puede comprobar qué terrenos vendió'),
    ("prose", "Les bénévoles ont compté 33 arbres\nanciens le long du ruisseau avant\nla fin de l'été. Finalement 569\nmembres ont voté pour attaquer la"),
    ("prose", 'Letters to the regional forester ran 68\nto one against the pipeline corridor,\nand most mentioned mountain hemlock. We\nfound that visitor numbers could not be'),
    ("prose", 'Wer den Hollowmereer Tal kennt, weiß, dass die Eibe dort nur noch\nselten zu sehen ist. Die Anwohner wurden erst 1989 darüber\ninformiert, dass die Straße durch das Gebiet führt. Zwischen 1965\nund 1964 sank der Grundwasserspiegel unter dem Kelsridgeer Moor um'),
    ("prose", 'El agua de el bosque de Thorngate está\ndemasiado caliente para que los peces\npuedan vivir en ella. Entre 1975 y 2008, el\nnivel del agua bajo el bosque de Thornley'),
    ("prose", 'Because the 2 April memo relied on\ndata from 1968, its account of\nold-growth cover is out of date.\nEarlier that year, the coalition'),
    ("list", 'wolverine.\nDunridge Valley, unit 88.\nLorngate Gap, unit 78.\nVellcroft Creek, unit 87.'),
    ("list", '1. Crowfork Ridge, unit 50\n2. Mussgate Basin, unit 59\n3. copy of the aerial survey\n4. Skellholt'),
    ("list", '– Oskley Ridge, unit 82\n– copy of the appeal record\n– copy of the 2 April memo\n– Skellgate'),
    ("list", '* copy of the aerial survey\n* Umbercroft\n* high-elevation meadows\n* Kelsley'),
    ("list", '(i) Briarwick.\n(ii) Thornwick Flats, unit 79.\n(iii) Skellmere Valley, unit 98.\n(iv) black-backed woodpecker.'),
    ("list", '1. unlogged slopes\n2. privately held drainages\n3. red cedar\n4. copy of the 2 April memo'),
    ("list", 'a) Briarwick\nb) Skellgate\nc) spotted bat\nd) Crowwick Gap, unit 48'),
    ("list", '(i) copy of the aerial survey\n(ii) Thornwick Gap, unit 56\n(iii) copy of the final impact statement\n(iv) unlogged tracts'),
    ("table", '| unit | temp | year | score | score |\n| Dunmere | no | 92% |  |  |\n| Vellfork |  | 14% | - | yes |\n| Oskfork | n/a | 8% | yes | no |'),
    ("table", '+---------+\n|unit|share|share|temp|\n+---------+\n|Skellmere|227.68|1180|370.15|'),
    ("table", 'unit         year         score        year         score        share\nYelstead     108.86       65%          902          1992         331.07\nBriarridge   145.44       10%          1706         2010         162.55\nHollowdale   337.80       26%          6527         1965         390.59'),
    ("table", 'unit\tacres\tscore\nKelsburn\t2349\t8912\nThornstead\t2460\t3146\nCrowfork\t5081\t5831'),
    ("table", 'unit,share,class,acres\nSkellgate,2000,187.66,1999\nWashmere,2008,197.99,2003\nThornwick,1997,275.86,1968'),
    ("table", 'unit;year;acres\nCrowdale;2%;4140\nWashholt;18%;7105\nYelstead;32%;1817'),
    ("table", 'unit\tclass\tshare\tscore\tscore\nVellfork\t99%\t1991\t50%\t1965\nMussstead\t64%\t2013\t52%\t1987\nDundale\t22%\t1972\t10%\t1967'),
    ("table", 'unit         temp         temp         acres        score        year\nSkellburn    6274         0%           n/a          yes          374.75\nNorthholt    7057         29%          -                         238.09\nLornley      4073         65%          n/a          yes          389.40'),
    ("junk", '00000000: 34a6 55dc 28ed 62fd 57b3 c1ba edf2 3b25\n00000010: 8390 9573 99f4 e708 2be6 d915 b44e 25fe\n00000020: c3b2 4f54 97d5 f234 94f0 df85 8a24 ff7b\n00000030: 9ee7 085f 0bd5 00e6 febb ad70 a87e 50e5'),
    ("junk", 'âx€™�?€q x¤q#âqâ¶#© ™©¤¤â#¤x�™ €™™â¤q© ¤Ã€¶¤€¶� ™¶™ q¤©â™�qx¶ €Ã�q? x¤Ã? x�qx¤�? ¤€€??? ¤¤¤Ã qx#q #©€?â�Ã ¶#��™#â© ¤#™?#Ã¶â© ¶#©€x€Ã âq¶©©�™ Ã™xâ¤x ## €™q€ â€€â¤ ¶™�¤ x#�¶q€q� ¶€Ãâ#Ã€ â€#� ™q#¤¶�â€?q ¤©ââq �?�©©?™ �#¤x#¶¤ ��¤q ?™¤Ã ?™€â#¤¶©# ¶�©© �¤¶¤Ã¤©© x¶?©�â€ Ã€¶™? ?qâÃ¤#?¶ ¤#©?¤©?¶¤ â¶™â¶��x ¶¤¶ ™™€q™¤™? #¤¶©qq ?#© ©€€ÃÃ q# �� x#Ã ™€©?x¶Ãq #�€¶™q# â¤â©¤¤€# â©©ââ ¤�¶™Ã? �qâ¶€?âÃ™ �â¤ ¶€#™'),
    ("junk", 'q###Ã ¶?™xq��¤ ?#¶™â¶ €�â ¶qâ™ ¤?â q#™ #€x€âx?¶Ã€ �©#™# �q?#™#™� x?qq¶¤q€¤ #©ÃÃ¤ ¤¤â âx âÃ¤x ™�Ã €âqâ �#âx¤q¶ â�€â©â ¶€# qxx€©ÃxÃ€ ™#¶â? x¤™ âÃ?q€©¶¤ ©??Ã#©?# ¤©Ã#�?¤ ��qÃ Ã?â©€xx# q�©¶Ã?Ãâ� ©Ã© â#¤¶â??? ™™x¶ ¤q¶Ã?q€Ã? q€Ã¶�â#™€â ÃÃ™¤?™ €¶™#�? Ãâxâ# ?#?©™¤#©q# ©© q#¤¤ Ã¶xqÃ ©¶�©?€q?© ¤�¤ ?¤ Ãxqx#â©¤ ?#™xx? q© ¤™¶x#x#™q q¤xâqâ#¶qq #x€qÃâ™Ã?� ?â��q€ ��x€#Ã?¶ ¶©Ã¤€¤ #qÃx ¶�x Ã¶€¶q™âq x¶xx #¶�#¶€€#x#'),
    ("junk", 'JB5XDNb+IICZ3iP06l5TWle1skXLtJc4RkFm59WLXx00bap1UPO3EOn7HwDm4CEv\nQ6BZTIyKMQZCNkXeR7o/d+udG5Vfm7NdbyrBFS5flD6hdRSNw8yJy24Yudv/FxK0\nSIswu1QDCmZi4OVnIpI5cKhoE3z23tBOGpUAXz1RdWhmDFGgoKCAdYJ4dUA+kM+I\nOsb35zPgfrQw9hlPijW78P0xi0dfdH6ldjdV4c8mHX4jI1iycQW5YRn1a9P6SIod'),
    ("junk", '06:03:55 GET /skelldale/5931.gif 200 1172\n17:05:22 GET /washcroft/2291.gif 200 79631\n04:16:57 GET /oskford/5222.gif 304 27396\n20:49:38 GET /dunstead/4478.gif 404 56610'),
    ("junk", '=-=-=-=-=-=-=-=-=-=-=-=-\n=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-\n=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-\n=-=-=-=-=-=-=-=-=-=-=-=-'),
    ("junk", 'rMHD/PiCGYlHrvkI9W+hC/ANCO0Vm7G8iZSbgtlYYqXesmOGM4p6l+1SM1Zyj2rg\n5DTiutINhTBh3b4T1fZoi3ZJLzjpsDmWcdqngz1CGXa17hWKvxXySWjSQKc3vyFg\nk5zZL04xqc2AXfqYQga89AzMY9MGdA7ZZ3VINCW/up0197GujFKFZeUB6df77Xlt\nmDLgnzrE0Q5gyUPpa2zMf62XsP424s0hCURGiCcyqLtTtIx2ZnC9Icu4BaXhJbNN'),
    ("junk", 'grey wolf timber tailed frog sugar pine free maps mountain hemlock cheap cabins umberfork cheap cabins free maps free maps crowburn timber skellholt timber free maps free maps free maps free maps red cedar cheap cabins grey wolf umberridge vole vellburn cheap cabins free maps spotted bat pineridge vole tarnfork wolverine timber cheap cabins timber free maps cheap cabins timber elk free maps'),
    ("junk", 'free maps timber mountain hemlock cheap cabins free maps mussmere timber timber timber timber cheap cabins lorngate yelburn cheap cabins tarnridge free maps cheap cabins free maps cheap cabins timber timber cheap cabins cheap cabins free maps western larch free maps kelsdale skellholt cheap cabins yelwick cheap cabins cheap cabins cheap cabins free maps free maps cheap cabins yelwick cheap cabins'),
    ("junk", 'timber kelsmere cheap cabins dunford cheap cabins free maps black-backed woodpecker alder tailed frog free maps whitebark pine timber free maps timber cheap cabins tailed frog cheap cabins lornfork timber free maps vellholt timber tarnmere cheap cabins pineley timber cheap cabins free maps free maps cheap cabins free maps free maps free maps cheap cabins cheap cabins sugar pine river trout grey'),
    ("junk", 'lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum lorum '),
)


def holdout(stop: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(line_features(t, stop)[0], KINDS.index(k)) for k, t in HOLDOUT]
    return np.concatenate([x for x, _ in parts]), np.concatenate([np.full(len(x), k) for x, k in parts])


def train(documents: DataFrame, stop: frozenset[str], text_col: str = "text", id_col: str = "doc_id", max_documents: int = 2_000, max_lines: int = 16_000, least: int = 20) -> BoostedTrees | None:
    """Trees fitted to weakly labelled lines of a sample of some ``max_documents`` documents, chosen by hash of the id,
    and at most ``max_lines`` of their lines; calibrated on :data:`HOLDOUT`, whose lines are no training lines.

    Lines are turned into features and labelled where they lie; only those of the sample come to the driver. None where
    a class has fewer than ``least`` labelled lines.
    """
    steps = 1 << 30
    reach = min(steps, -(-steps * max_documents // max(1, documents.count())))
    held_out = frozenset(x for _, t in HOLDOUT for x in t.split("\n"))

    def labelled(keys, texts):
        for h, t in zip(keys, texts):
            x, lines = line_features(t, stop)
            for n, (row, y, line) in enumerate(zip(x.tolist(), weak_labels(x, lines).tolist(), lines)):
                if y >= 0 and line not in held_out:
                    yield xxhash.xxh64_intdigest(f"{h}/{n}") >> 1, y, row

    rows = documents.where(f"length({text_col}) > 0").select(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(steps)).alias("h"), F.col(text_col).alias("t"))
    sample = map_columns(rows.where(F.col("h") < reach), labelled, "o bigint, y int, x array<double>")
    got = sample.orderBy("o", "y").limit(max_lines).toPandas()
    n = np.bincount(got.y.to_numpy().astype(int), minlength=len(KINDS)) if len(got) else np.zeros(len(KINDS))
    if n.min() < least:
        return None
    x, y = np.array(got.x.tolist()).reshape(len(got), len(FEATURES)), got.y.to_numpy().astype(int)
    weight = (len(y) / (len(KINDS) * n))[y]
    return BoostedTrees(len(KINDS)).fit(x, y, weight).calibrate(*holdout(stop))


def held_out_report(documents: DataFrame, words: DataFrame) -> DataFrame:
    """``(kind, lines, right, mean_probability)`` of the trees on the lines checked by hand, by class: how many are told rightly, and
    the mean calibrated probability of their class."""
    stop = common_words(words)
    model, (x, y) = train(documents, stop), holdout(stop)
    p = model.probabilities(x) if model else np.zeros((len(x), len(KINDS)))
    rows = [(k, int((y == n).sum()), int((p[y == n].argmax(1) == n).sum()) if model else 0, float(p[y == n, n].mean())) for n, k in enumerate(KINDS)]
    return documents.sparkSession.createDataFrame(rows, "kind string, lines int, right int, mean_probability double")


SCHEMA = (
    "doc_id bigint, kind string, probability double, prose_share double, list_share double, table_share double, junk_share double, words bigint, mean_word_length double, symbol_ratio double, "
    "digit_ratio double, upper_ratio double, lines bigint, ending_punctuation double, common_words double, distinct_words double, item_lines double, repeated_lines double"
)


def quality(documents: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: BoostedTrees | None = None) -> DataFrame:
    """A row of statistics for each document with an id, whatever its text.

    ``kind`` is ``prose`` unless more than half of the characters other than white space are found to be something
    else, then the kind that most of these belong to; ``probability`` is the mean calibrated probability of that kind over
    the characters. NULL and blank texts have kind ``empty`` and zeros. Where a corpus is too small to train on kinds are ``unknown``,
    with zeros for shares and probability.
    """
    stop = common_words(words)
    if model is None:
        model = train(documents, stop, text_col, id_col)

    def run(ids, texts):
        for lo in range(0, len(ids), 500):
            some = ids[lo : lo + 500]
            x, weight, doc, _, stats = batch_features([t or "" for t in texts[lo : lo + 500]], stop)
            n = len(some)
            p = model.probabilities(x) if model and len(x) else np.zeros((len(x), len(KINDS)))
            best = p.argmax(1)
            share = np.bincount(doc * len(KINDS) + best, weight * (p.max(1) > 0), n * len(KINDS)).reshape(n, len(KINDS)) if len(x) else np.zeros((n, len(KINDS)))
            mean = np.stack([_sum(doc, weight * p[:, k], n) for k in range(len(KINDS))], 1)
            total = _sum(doc, weight, n)[:, None]
            share, mean = share / np.maximum(total, 1e-9), mean / np.maximum(total, 1e-9)
            which = np.where(share[:, 0] >= 0.5, 0, 1 + share[:, 1:].argmax(1))
            kind = np.where(total[:, 0] == 0, "empty", np.array(KINDS)[which] if model else "unknown")
            yield from zip(some, kind.tolist(), mean[np.arange(n), which].tolist(), *share.T.tolist(), *(v.tolist() for v in stats.values()))

    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    return map_columns(rows, run, SCHEMA)


def statistics(documents: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The statistics of :func:`quality` alone, without a model."""
    stop = common_words(words)

    def run(ids, texts):
        for lo in range(0, len(ids), 500):
            stats = batch_features([t or "" for t in texts[lo : lo + 500]], stop)[4]
            yield from zip(ids[lo : lo + 500], *(v.tolist() for v in stats.values()))

    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    return map_columns(rows, run, "doc_id bigint, " + SCHEMA.split("junk_share double, ")[1])


def not_prose(documents: DataFrame, words: DataFrame) -> DataFrame:
    """Distinct ``(doc_id, kind)`` of documents mostly made up of a list, a table or junk."""
    return quality(documents, words).where(F.col("kind").isin(*KINDS[1:])).select("doc_id", "kind").distinct()

import random

import pytest

from holdfast.llm import ocr
from holdfast.llm.ocr import Lexicon, label_lines, looks_scanned, repair_scans, scan_defects
from tests.conftest import rows

WORDS = {w: 1000 for w in "the water was low and river had been closed for many years when they came back to measure corridor modern high elevation stands along valley report survey".split()} | {"high-elevation": 500, "the": 9000}

PAGE = """12   REPORT OF THE SURVEY
the water was 1ow and the river had been c1osed for
many years when they came back to measure the corri-
dor along the valley and the high-
elevation stands when they came back to the modern
river and the water was low and the survey had been
- 12 -
13   REPORT OF THE SURVEY
closed for rnany years when they came back to measure
the valley and the water was low for many years when
they had been closed."""


def test_lines():
    defects, text = label_lines(PAGE, Lexicon(WORDS))
    assert defects == [(1, "header"), (2, "misread"), (3, "hyphen"), (7, "page_no"), (8, "header"), (9, "misread")]
    assert "water was low and the river had been closed" in text and "the corridor along" in text and "high-elevation stands" in text and "closed for many years" in text
    assert "REPORT" not in text and "- 12 -" not in text


def test_signs_and_candidates():
    lex = Lexicon(WORDS)
    assert lex.repair("cornmodern") is None and lex.repair("rnodern") == "modern" and lex.repair("Vvater") == "Water" and lex.repair("closecl") == "closed"
    assert lex.repair("valley") is None and lex.repair("") is None
    assert lex.distance("rnodern", "modern") < 0.5 < lex.distance("modxrn", "modern")
    text = PAGE.replace("corri-\ndor", "corri¬\ndor").replace("c1osed", "closed")
    assert (3, "hyphen") in label_lines(text, lex)[0]


def test_context_decides():
    ids = {}
    from holdfast.llm.ocr import _Ids, _pair

    ids = _Ids()
    lex = Lexicon({"hall": 100, "ball": 5000, "the": 10**6, "town": 100}, {_pair(ids["town"], ids["hall"]): 50})
    assert lex.repair("hal1", "town", "") == "hall"


def test_only_wrapped_text_is_scanned():
    assert not looks_scanned(["One sentence on a line.", "Another sentence on a line.", "And one more of them."])
    assert not looks_scanned(["x" * 150, "y", "z"])
    assert label_lines("", Lexicon(WORDS)) is None and label_lines("a\n\nb", Lexicon({})) is None


def test_table(spark):
    fill = "\n".join([PAGE.split("\n")[i] for i in (5, 8, 9)]).replace("rnany", "many")
    data = [("s", PAGE, 1), ("s", PAGE, 2), ("n", None, 1), (None, PAGE, 1), ("e", "", 1), ("l", "word " * 100_000, 1)] + [(f"d{i}", fill, 1) for i in range(40)]
    data += [(f"h{i}", "the corridor of high-elevation modern stands along report", 1) for i in range(40)]
    df = spark.createDataFrame(data, "id string, body_text string, line_no int")
    found = [r for r in rows(scan_defects(df)) if r[0] == "s"]
    assert ("s", 2, "misread") in found and ("s", 3, "hyphen") in found and ("s", 7, "page_no") in found
    assert len(found) == len(set(found))
    assert {r["record_id"] for r in repair_scans(df).collect()} >= {"s", "d0"} and "l" not in {r["record_id"] for r in repair_scans(df).collect()}
    assert rows(scan_defects(df.where("false"))) == []


def corpus(seed=3, docs=60):
    """Wrapped texts of a few hundred words of very uneven frequency, with misreadings and broken words."""
    r = random.Random(seed)
    letters = "abcdehilmnorstuvw"
    words = sorted({"".join(r.choice(letters) for _ in range(r.randrange(3, 9))) for _ in range(300)})
    out = []
    for n in range(docs):
        body = [words[min(int(r.expovariate(0.03)), len(words) - 1)] for _ in range(r.randrange(80, 200))]
        if n % 2:
            for k in range(0, len(body), 12):
                a, b = r.choice([p for p in ocr.CONFUSIONS if p[1] in body[k]] or [("", "")])
                body[k] = body[k].replace(b, a, 1) if b else body[k]
        lines = [" ".join(body[k : k + 9]) for k in range(0, len(body), 9)]
        for k in range(0, len(lines) - 1, 3):
            head, tail = lines[k].rsplit(" ", 1)
            if len(tail) > 4:
                lines[k], lines[k + 1] = f"{head} {tail[:2]}-", f"{tail[2:]} {lines[k + 1]}"
        out.append((f"s{n:03d}", "\n".join(lines)))
    return out


@pytest.mark.parametrize("most", [200_000, 0])
def test_joined_index_equals_the_one_in_memory(spark, most):
    data = corpus()
    words, pairs, ids = {}, {}, ocr._Ids()
    for _, t in [*data, data[1]]:
        found = ocr.WORD.findall(t.lower())
        for w in found:
            words[w] = words.get(w, 0) + 1
        for a, b in zip(found, found[1:]):
            k = ocr._pair(ids[a], ids[b])
            pairs[k] = pairs.get(k, 0) + 1
    lex = Lexicon(words, pairs)
    want = {i: label_lines(t, lex) for i, t in data}
    df = spark.createDataFrame([*data, data[1]], "id string, body_text string")
    got = {r["record_id"]: ([tuple(x) for x in r["lines"]], r["repaired"]) for r in repair_scans(df, max_broadcast_rows=most).collect()}
    assert got == want and sum(len([k for _, k in d if k == "misread"]) for d, _ in want.values()) > 50


def test_rare_sound_words_are_kept_at_any_size(spark):
    """A name that stands a dozen times isn't repaired into a frequent word a confusion away, however large the corpus."""
    fill = "\n".join(PAGE.split("\n")[i] for i in (5, 8, 9)).replace("rnany", "many")
    for times in (1, 20):
        data = [(f"d{i}", fill) for i in range(40 * times)] + [(f"n{i}", fill.replace("river", "rlver")) for i in range(12 * times)]
        df = spark.createDataFrame(data, "id string, body_text string")
        assert not [r for r in scan_defects(df).collect() if r["defect"] == "misread"]


def test_hints_and_long_lines(spark):
    lines = PAGE.split("\n")
    assert looks_scanned(lines * 2 + ["x" * 150]) and not looks_scanned(lines + ["x" * 150]) and looks_scanned(lines + ["x" * 150], hinted=True) and not looks_scanned(lines + ["x" * 150] * 2, hinted=True)
    schema = "id string, body_text string, extraction struct<method:string,ocr_confidence:double>"
    data = [("a", "\n".join(lines + ["x" * 150]), ("tesseract", None)), ("b", "\n".join(lines + ["x" * 150]), ("plain", None)), ("c", PAGE, None), ("d", "\n".join(lines + ["x" * 150]), (None, 50.0))]
    assert {r["record_id"] for r in scan_defects(spark.createDataFrame(data, schema)).select("record_id").distinct().collect()} == {"a", "c", "d"}


def test_headers_by_position():
    lines = ["the water was low and the river had been", "closed for many years when they came back", "the water was low along the valley and they", "came back to measure the river and the water"]
    text = "\n".join([*lines[:2], "kept for the society of the valley", "- 12 -", *lines[2:], "kept for the society of the valley", "- 13 -", "when they had been along the river and the", "kept for the society of the valley"])
    assert [n for n, k in label_lines(text, Lexicon(WORDS))[0] if k == "header"] == [3, 7, 10]

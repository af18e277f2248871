import pytest

from holdfast.llm.pii import _ORDINARY, Names, disclosure, generalized, find_personal, learned_names, corpus_evidence, misleading_cues, personal_data, replace_personal, sanitize
from tests.conftest import rows

NAMES = Names({"ada": 1, "rose": 1, "april": 1, "heather": 1, "quill": 2, "brook": 2, "marsh": 2, "kestholt": 2, "vey-low": 2}, _ORDINARY)


@pytest.mark.parametrize(
    "text,want",
    [
        ("write to a.b+c@x-y.org.example.", [("email", "a.b+c@x-y.org.example")]), ("joe [at] site.example, or", [("email", "joe [at] site.example")]), ("joe (at) big-site (dot) org (dot) example now", [("email", "joe (at) big-site (dot) org (dot) example")]),
        ("Tel. (541)555-0154, fax +1 312 555 0109", [("phone", "(541)555-0154"), ("phone", "+1 312 555 0109")]), ("ring 020 7946 0393 or 01.99.00.72.54", [("phone", "020 7946 0393"), ("phone", "01.99.00.72.54")]), ("+49 30 23125 997 x", [("phone", "+49 30 23125 997")]),
        ("030 / 23125-032", [("phone", "030 / 23125-032")]), ("Sheet 541-555-0154 of the atlas", []), ("The plot lies at 44.5497, -121.2278", []), ("1994 2001", []),
        ("SSN: 934-31-6917", [("id_number", "934-31-6917")]), ("Passport no. X19294261 was", [("id_number", "X19294261")]), ("My licence, D113-288-07, was", [("id_number", "D113-288-07")]), ("Taxpayer ID 2 44 05 99 891 223 24 x", [("id_number", "2 44 05 99 891 223 24")]), ("Timber contract 053-18-1892 was", []),
        ("at 43 N. Old Mill Drive, Apt. 204 and", [("address", "43 N. Old Mill Drive, Apt. 204")]), ("live at 1393 Dunmere Mill St. and", [("address", "1393 Dunmere Mill St.")]), ("at 56 rue de Washburn.", [("address", "56 rue de Washburn")]), ("103 bis, chemin de Vellburn", [("address", "103 bis, chemin de Vellburn")]),
        ("in Briarsteadweg 79, then", [("address", "Briarsteadweg 79")]), ("Velldaleer Allee 121", [("address", "Velldaleer Allee 121")]), ("Camino de Skellgate, 159 and", [("address", "Camino de Skellgate, 159")]), ("to PO Box 9130, but", [("address", "PO Box 9130")]),
        ("Dr. Ada Quill said", [("person", "Ada Quill")]), ("QUILL, ADA B. said", [("person", "QUILL, ADA B.")]), ("Ada J. Vey-Low and A. Quill.", [("person", "Ada J. Vey-Low"), ("person", "A. Quill")]), ("Ada\nQuill", [("person", "Ada\nQuill")]),
        ("near Kestholt Creek", []), ("The Heather Brook tract and Mount April", []), ("April 1982 and roses by the brook", []), ("Ada went home", []), ("", []), (None, []),
    ],
)
def test_found(text, want):
    spans = find_personal(text, NAMES)
    assert [(k, text[a:b]) for a, b, k in spans] == want


@pytest.mark.parametrize(
    "text,kind,want",
    [(f"at {a}{end}", "address", a) for a in ("7120 N. Frost Rd", "7964 SW Kelscroft Court") for end in ("", "\r\n", ")", ";", ":", "\t")]
    + [("at 12 Old Mill\nRoad", "address", "12 Old Mill\nRoad"), ("at 12  Mill Road", "address", "12  Mill Road"), ("at 12 August Road", "address", "12 August Road"), ("at 12, rue\nVellburn", "address", "12, rue\nVellburn"), ("in Briarsteadweg\n79", "address", "Briarsteadweg\n79")]
    + [(f"{cue}934-31-6917", "id_number", "934-31-6917") for cue in ("TIN: ", "DNI: ", "NIF:", "NIE\t", "social\nsecurity ", "tax payer ", "tax\tid ")],
)
def test_found_whatever_stands_around(text, kind, want):
    assert (kind, want) in [(k, text[a:b]) for a, b, k in find_personal(text, NAMES)]


def test_replacement():
    t = "Ada Quill, ada@x.example, 541-555-0154."
    assert replace_personal(t, find_personal(t, NAMES)) == "[PERSON], [EMAIL], [PHONE]."


def test_learned_and_table(spark):
    lex = spark.createDataFrame([("Ada", "given"), ("Bea", "given"), ("Cleo", "given"), ("Quill", "family"), ("Rust", "family"), (None, None)], "name string, name_kind string")
    data = [(f"r{i}", f"{g} Zandorf spoke near Quill Creek. The river and Mill Creek were low.", 1) for i, g in enumerate(["Ada", "Bea", "Cleo"] * 3)]
    data += [(f"u{i}", f"Then Ottilie Zandorf came. Long Water {i} ran.", 1) for i in range(5)] + [("n", None, 1), (None, "Ada Quill", 1), ("e", "", 1), ("x", "Mr. Ottilie Zandorf", 1), ("x", "Mr. Ottilie Zandorf", 1), ("long", "Water " * 100_000, 1)]
    df = spark.createDataFrame(data, "id string, body_text string, found int")
    assert {r["name"]: r["role"] for r in learned_names(corpus_evidence(df), lex).collect()} == {"zandorf": 2, "ottilie": 1}
    known = spark.createDataFrame([("ada", 1), ("bea", 1), ("cleo", 1), ("quill", 2)], "name string, role int")
    bits = {r["term"]: r["bits"] for r in disclosure(corpus_evidence(df), known).collect()}
    assert bits["zandorf"] > 2
    got = rows(personal_data(df, lex))
    assert ("x", "person", "Ottilie Zandorf") in got and ("r0", "person", "Ada Zandorf") in got and not [g for g in got if "Creek" in g[2]]
    assert rows(sanitize(df, lex, max_broadcast_rows=0)) == rows(sanitize(df, lex))
    clean = {r["record_id"]: r["clean_text"] for r in sanitize(df, lex).collect() if r["record_id"] in ("x", "n", "e")}
    assert clean == {"x": "Mr. [PERSON]", "n": "", "e": ""}
    assert rows(personal_data(df.where("false"), lex)) == []


def test_terms_that_disclose(spark):
    lex = spark.createDataFrame([("Ada", "given"), ("Quill", "family")], "name string, name_kind string")
    data = [(f"a{i}", f"Ada Quill of Zephyrhaven spoke. The River {i} ran.") for i in range(4)] + [(f"b{i}", "The River ran low.") for i in range(996)] + [("c", "In Zephyrhaven it rained."), ("n", None)]
    got = {r["record_id"]: r for r in generalized(spark.createDataFrame(data, "id string, body_text string"), lex, max_broadcast_rows=0).collect()}
    assert got["a0"]["clean_text"] == "[PERSON] of [TERM] spoke. The River 0 ran." and (got["a0"]["replaced"], got["a0"]["generalized"]) == (1, 1)
    assert got["c"]["clean_text"] == "In [TERM] it rained." and got["b1"]["clean_text"] == "The River ran low." and got["n"]["clean_text"] == ""


def test_names_learned_are_the_same_in_a_larger_corpus(spark):
    lex = spark.createDataFrame([("April", "given"), ("Ada", "given"), ("Bea", "given"), ("Quill", "family"), ("Rust", "family")], "name string, name_kind string")
    data = [f"{g} Zandorf wrote the April memo. Quill, Northleyer Allee 7." for g in ("Ada", "Bea")] * 20 + ["April Memo: Ada Rust."] * 4 + ["the memo of april 1990"] * 60 + ["April came. Northleyer Allee and Northleyer Weg."] * 60
    for times in (1, 10):
        df = spark.createDataFrame([(f"{i}-{n}", t) for i in range(times) for n, t in enumerate(data)], "id string, body_text string")
        assert [r["name"] for r in learned_names(corpus_evidence(df), lex).collect()] == ["zandorf"]
        found = personal_data(df, lex).where("kind = 'person'").groupBy("found").count().collect()
        assert {r["found"]: r["count"] for r in found} == {"Ada Zandorf": 20 * times, "Bea Zandorf": 20 * times, "Ada Rust": 4 * times}


def test_misleading_cues(spark):
    data = ["Call (541) 555-0154."] * 20 + ["Call 541-555-0154, or tel. +1 541 555 0199."] * 20 + ["Tract 541-555-0154 was sold."] * 40 + ["Ring 541-555-0188."]
    df = spark.createDataFrame([(f"{n}", t) for n, t in enumerate(data)], "id string, body_text string")
    assert misleading_cues(corpus_evidence(df)) == {"tract"}
    lex = spark.createDataFrame([("Ada", "given")], "name string, name_kind string")
    assert {r["found"]: r["count"] for r in personal_data(df, lex).groupBy("found").count().collect()} == {"(541) 555-0154": 20, "541-555-0154": 20, "+1 541 555 0199": 20, "541-555-0188": 1}

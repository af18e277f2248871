import re
from collections import Counter, defaultdict

from holdfast.llm.boilerplate import Boilerplate, repeated_lines
from tests.conftest import rows

SCHEMA = "id string, source_site string, body_text string, capture_date string, site int, lines int, n int"


def normal(x):
    return re.sub(" +", " ", re.sub("[\t\r\f]", " ", re.sub("[0-9]", "", x.lower()))).strip(" ")


def brute(data):
    recs = {}
    for i, s, t, c, *_ in data:
        if i is not None and (i not in recs or (c or "") >= (recs[i][2] or "")):
            recs[i] = (s, t, c)
    sites = Counter(s for s, _, _ in recs.values() if s)
    at = defaultdict(set)
    for i, (s, t, _) in recs.items():
        for x in (t or "").split("\n"):
            if s and re.search(r"[^\W\d_]", normal(x)):
                at[s, normal(x)].add(i)
    bad = {k for k, v in at.items() if len(v) >= 8 and len(v) >= 0.1 * sites[k[0]]}
    return sorted((i, n) for i, (s, t, _) in recs.items() for n, x in enumerate((t or "").split("\n"), 1) if (s, normal(x)) in bad)


def make():
    data = []
    for i in range(30):
        body = [f"Own line number {'abcdefghij'[i % 10]}{chr(97 + i // 10)}", "", "12 34"]
        if i < 9:
            body += [f"Share THIS page {i}", "\tAll  rights\f reserved "]
        if i < 7:
            body.append("seldom line")
        data.append((f"r{i:02d}", "a", "\n".join(body), "2020", 1, 1, 1))
    data += [(f"s{i}", "big", "Common" if i < 9 else f"x{chr(97 + i % 26)}{chr(97 + i // 26)}", "2020", 1, 1, 1) for i in range(120)]
    data += [("r00", "a", data[0][2], "2021", 1, 1, 1), ("n1", None, "Share this page", "2020", 1, 1, 1), (None, "a", "Share this page", "2020", 1, 1, 1), ("e", "a", None, None, None, None, None), ("f", "a", "", "2020", 1, 1, 1)]
    return data


def test_found_equals_brute_force(spark):
    data = make()
    df = spark.createDataFrame(data, SCHEMA)
    want = brute(data)
    assert len(want) == 18  # two lines of nine records
    assert rows(repeated_lines(df)) == want
    big = Boilerplate(df, max_broadcast_rows=0)
    assert sorted((r["record_id"], r["line_no"]) for r in big.occurrences().collect()) == want


def test_blocks_and_cleaning(spark):
    b = Boilerplate(spark.createDataFrame(make(), SCHEMA))
    assert [(r["site"], r["lines"], r["records"]) for r in b.blocks().collect()] == [("a", 2, 9)]
    clean = {r["record_id"]: (r["clean_text"], r["removed"]) for r in b.cleaned().collect()}
    assert clean["r00"][1] == 2 and "Share" not in clean["r00"][0] and "seldom line" in clean["r00"][0]
    other = Boilerplate(spark.createDataFrame(make(), SCHEMA), max_broadcast_rows=0)
    assert rows(other.cleaned()) == rows(b.cleaned()) and rows(other.blocks()) == rows(b.blocks())
    assert len({r["block"] for r in b.occurrences().where("site = 'a'").collect()}) == 1
    assert clean["n1"] == ("Share this page", 0) and clean["e"] == (None, 0) and clean["s3"] == ("Common", 0)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rows(repeated_lines(df)) == [] and rows(Boilerplate(df).blocks()) == []

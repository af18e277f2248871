import pytest

from holdfast.llm.markup import clean_markup, classify_blocks, convert, marked_up, markup_kinds
from tests.conftest import rows

STOP = frozenset("the of and to in a is was for on that with as by it".split())

MARKED = [
    ("<p>One</p>", "html"), ("x &amp; y", "html"), ("a<br>b", "html"), ("<!-- c -->", "html"), ("caf&#233;", "html"), ("see [it](http://x.example/a.html) now", "markdown"), ("![i](a.png)", "markdown"),
    ("a **bold** b", "markdown"), ("a __bold__ b", "markdown"), ("use `x = 1` here", "markdown"), ("```\ncode\n```", "markdown"), ("## Title", "markdown"), ("Title\n=====\ntext", "markdown"), ("| a | b |\n|---|---|\n| 1 | 2 |", "markdown"),
    ("[[Page|text]]", "wiki"), ("[[Page]]", "wiki"), ("'''b'''", "wiki"), ("''i'' x", "wiki"), ("== Head ==", "wiki"), ("x{{cite|7}} y", "wiki"), ("[http://x.example label]", "wiki"), ('{| class="w"\n|-\n| a || b\n|}', "wiki"),
    ("\\section{A}", "latex"), ("\\emph{x} y", "latex"), ("$x_{0} \\leq 4$", "latex"), ("\\begin{itemize}\n\\item a\n\\end{itemize}", "latex"), ("$$a = 2 b^{3}$$", "latex"), ("at~\\cite{r4} b", "latex"),
]
PLAIN = [
    "- item\n- item", "1. a\n2. b", "* Not seen in 1941.", "    indented", "a    b    c\nd    e    f", "http://x.example/a_b", "R&D {draft} #16 [sic]", "C:\\maps\\unit_58.shp", "between $4 and $28", "If a < b and c > d", "pH < 6.1 and > 8.4",
    "Initial here: ______", "[16]", "x [1] y", "", "a * b * c", "don't 'quote' it", "AT&T; and", "snake_case_name __init__x", "# one\n# two", "2 ** 3", "<x@y.example>",
]


@pytest.mark.parametrize("text,kind", MARKED)
def test_marked(text, kind):
    assert markup_kinds(text) == [kind]
    _, clean, _, _ = convert(text, STOP)
    assert markup_kinds(clean) == []


@pytest.mark.parametrize("text", PLAIN)
def test_plain(text):
    assert markup_kinds(text) == []
    assert convert(text, STOP)[1] == text


def test_code_in_one_language_is_no_other():
    assert markup_kinds("run `<b>x</b> [[y]]` now") == ["markdown"]
    assert markup_kinds("<pre>a **b** [[c]]</pre>") == ["html"]


def test_structure_is_kept():
    text = "<h1>Head</h1><p>Some <b>text</b> &amp; more</p><ul><li>one<li>two</ul><pre>if x:\n    y</pre><table><tr><td>a</td><td>b</td></tr></table><p>E = mc<sup>2</sup></p>"
    assert convert(text, STOP)[1] == "Head\n\nSome text & more\n\n- one\n- two\n\n    if x:\n        y\n\na\tb\n\nE = mc^2"
    assert convert("\\section{H}\n\n$$a = 2 b^{3}$$\n\n\\begin{verbatim}\nx\n\\end{verbatim}", STOP)[1] == "H\n\na = 2 b^3\n\n    x"


def test_two_passes():
    good = ("paragraph", "It was the end of the year and the cold was with us in the house, as it is in the winter by the sea. " * 3, 0.0)
    bad = ("paragraph", "Home Contact Imprint Archive Newsletter Login Register Sitemap Print Share Shop Basket Jobs Press", 1.0)
    short = ("paragraph", "Read more here", 0.0)
    assert classify_blocks([good, short, good], STOP) == [True, True, True]
    assert classify_blocks([bad, short, bad], STOP) == [False, False, False]
    assert classify_blocks([bad, ("heading", "H", 0.0), short], STOP)[:2] == [False, True]


def test_table(spark):
    df = spark.createDataFrame([("a", "x **b** y", 1), ("a", "x **b** y", 2), ("b", None, 3), (None, "<p>", 4), ("c", "", 5), ("d", "<p>" + "word " * 200_000, 6)], "id string, body_text string, markup int")
    words = spark.createDataFrame([("en", "the"), (None, None)], "lang string, word string")
    assert rows(marked_up(df, words)) == [("a", "markdown"), ("d", "html")]
    assert {r["record_id"]: r["clean_text"] for r in clean_markup(df, words).where("record_id <> 'd'").collect()} == {"a": "x b y", "b": "", "c": ""}
    assert rows(marked_up(df.where("false"), words)) == []

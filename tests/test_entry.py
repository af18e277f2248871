import __spark_entry__ as E


def test_every_sql_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert {"p2_found", "p7_found", "corpus_totals"} <= set(E.queries())


def test_entry(spark):
    assert E.entry(spark).first()["objects"] > 0


def test_core_stands_without_the_text_package():
    import pathlib

    root = pathlib.Path(E.__file__).parent / "holdfast"
    inside = "holdfast." + "llm"
    for p in root.rglob("*.py"):
        if p.parent.name != "llm":
            assert inside not in p.read_text(), p

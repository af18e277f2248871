import numpy as np

from holdfast.llm.quality import HOLDOUT, KINDS, batch_features, holdout, not_prose, quality, train
from holdfast.llm.trees import BoostedTrees
from tests.conftest import rows

PROSE = "The road was closed for most of the winter and nobody had told the owners when it would be open again, so they waited by the river until it was late."
LIST = "\n".join(f"{n}. old station, unit {n}" for n in range(1, 14))
TABLE = "unit | year | share\n" + "\n".join(f"Mill{n} | 19{n + 10} | {n * 3}%" for n in range(20))
JUNK = "\n".join(f"10:14:{n + 10} GET /img/{n}.gif 200 {n * 331}" for n in range(20))
WORDS = "the of and for most was had been it would be so they by until is to in that when a not with this as he she we were from".split()


def tables(spark, data):
    return spark.createDataFrame(data, "doc_id bigint, text string, words int, kind string"), spark.createDataFrame([("en", w) for w in WORDS] + [(None, None)], "lang string, word string")


def test_kinds(spark):
    data = [(n, t, 1, "x") for n, t in enumerate([PROSE, LIST, TABLE, JUNK, PROSE + "\n" + JUNK, PROSE * 9 + "\n" + LIST, None, "", "   \n "])]
    data += [(100 + 4 * n + k, t, 1, "x") for n in range(60) for k, t in enumerate([PROSE, LIST, TABLE, JUNK])] + [(None, JUNK, 1, "x"), (3, JUNK, 1, "x")]
    docs, words = tables(spark, data)
    got = {r[0]: r[1] for r in not_prose(docs, words).where("doc_id < 100").collect()}
    assert got == {1: "list", 2: "table", 3: "junk", 4: "junk"}
    stats = {r["doc_id"]: r for r in quality(docs, words).where("doc_id < 100").collect()}
    assert stats[0]["words"] == len(PROSE.split()) and stats[0]["lines"] == 1 and stats[0]["ending_punctuation"] == 1.0 and stats[0]["common_words"] > 0.3
    assert [stats[n]["kind"] for n in (6, 7, 8)] == ["empty"] * 3
    assert rows(not_prose(docs.where("false"), words)) == []


def test_holdout_accuracy(spark):
    """Trained on the corpus at hand, held against the lines checked by hand."""
    folder = "/root/testdata/sf0.01"
    stop = frozenset(r["word"] for r in spark.read.parquet(f"{folder}/common_words.parquet").collect())
    model = train(spark.read.parquet(f"{folder}/documents.parquet"), stop)
    x, y = holdout(stop)
    p = model.probabilities(x)
    assert np.allclose(p.sum(1), 1) and (p.argmax(1) == y).mean() > 0.9
    for k in range(len(KINDS)):
        assert (p[y == k].argmax(1) == k).mean() > 0.8
    # calibrated: the mean probability of the kind told is near the share told rightly
    assert abs(p.max(1).mean() - (p.argmax(1) == y).mean()) < 0.08


def test_too_little_to_train_on(spark):
    docs, words = tables(spark, [(1, PROSE, 1, "x"), (2, JUNK, 1, "x"), (3, None, 1, "x")])
    assert {r["doc_id"]: (r["kind"], r["probability"]) for r in quality(docs, words).collect()} == {1: ("unknown", 0.0), 2: ("unknown", 0.0), 3: ("empty", 0.0)}
    assert rows(not_prose(docs, words)) == []


def test_lines_checked_by_hand_are_never_trained_on(spark):
    """A corpus of nothing but the hand-checked lines has nothing to train on."""
    docs, words = tables(spark, [(n, t, 1, "x") for n, (_, t) in enumerate(HOLDOUT * 40)])
    assert train(docs, frozenset(WORDS)) is None


def test_bias_moves_the_border():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 1))
    m = BoostedTrees(2).fit(x[:1000], (x[:1000, 0] > 0).astype(int))
    late = (x[1000:, 0] > 0.5).astype(int)
    plain = (m.scores(x[1000:]).argmax(1) == late).mean()
    m.calibrate(x[1000:], late)
    assert m.bias[0] > 0 > m.bias[1] and (m.probabilities(x[1000:]).argmax(1) == late).mean() > plain


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] > 0).astype(int) + 2 * (x[:, 1] > 0.5)).astype(int)
    m = BoostedTrees(4).fit(x[:2000], y[:2000])
    assert (m.scores(x[2000:]).argmax(1) == y[2000:]).mean() > 0.97
    noisy = np.where(rng.random(1000) < 0.2, rng.integers(0, 4, 1000), y[2000:])
    assert m.calibrate(x[2000:], noisy).temperature > 1


def test_long_text_and_odd_signs():
    x, w, doc, lines, stats = batch_features(["word " * 200_000, "\ud7ff\u2028a\x85b", "\n\n"], frozenset(["word"]))
    assert len(x) == 2 and set(doc.tolist()) == {0, 1} and stats["words"][0] == 200_000 and stats["lines"][2] == 0
    assert len(KINDS) == 4

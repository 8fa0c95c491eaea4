import numpy as np

from quillworks.llm import pii as P
from quillworks.llm.boost import Boosted, calibrated_threshold
from quillworks.llm.pii_examples import labelled


def test_trees_learn_xor():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    t = Boosted.fit(x, y)
    assert ((t.probability(x) > 0.5) == (y > 0)).mean() > 0.95


def test_threshold():
    p, y = np.array([0.9, 0.8, 0.4, 0.3]), np.array([1.0, 1, 0, 0])
    assert 0.4 < calibrated_threshold(p, y) < 0.8


def test_held_out_accuracy():
    """Examples of another seed have other names, streets and numbers."""
    trees, thresholds = P.model()
    made = labelled(400, seed=1234)
    lexicon = P.Lexicon.of([t for t, _ in made])
    hit = found = true = 0
    for (text, truth), got in zip(made, P.find_batch([t for t, _ in made], lexicon, trees, thresholds)):
        a, b = {(s, k) for s, _, k in truth}, {(s, k) for s, _, k in got}
        hit, found, true = hit + len(a & b), found + len(b), true + len(a)
    assert hit / found > 0.95 and hit / true > 0.9


def test_frame(spark):
    lines = "Posted by Mara Tellberg\nTel: +49 30 23125 802\nInvoice 961-45-7119 is paid.\nWrite to info (at) mail (dot) oak (dot) example.\nAddress: 12B Mill Street, Apt 4\nPassport L123-4567-8901"
    filler = [(i, f"The letter was signed by {a} {b}.") for i, (a, b) in enumerate([("Mara", "Tellberg"), ("Joss", "Tellberg"), ("Mara", "Venn")] * 5)]
    df = spark.createDataFrame([(100, lines), (101, None), (102, ""), (103, "x " * 50_000), (None, lines), *filler], "k int, t string")
    got = {r.k: r for r in P.find_personal(df, ["k"], "t").collect()}
    assert got[100].redacted == "Posted by [NAME]\nTel: [PHONE]\nInvoice 961-45-7119 is paid.\nWrite to [EMAIL].\nAddress: [ADDRESS]\nPassport [ID]"
    assert got[None].redacted == got[100].redacted and got[101].redacted is None and got[102].redacted == "" and got[103].spans == []
    assert [lines[s.start_pos - 1 : s.end_pos] for s in got[100].spans][1] == "+49 30 23125 802"
    assert P.find_personal(df.limit(0), ["k"], "t").count() == 0


def test_lexicon_counts_all_texts(spark):
    """A name with two certain uses among many texts is known, with the lexicon at hand or distributed."""
    rows = [(i, f"The {i} pears were ripe and cheap at the market stall.") for i in range(9000)]
    rows += [(-1, "The letter was signed by Quorra Zelmund."), (-2, "Signed by Quorra Zelmund at noon."), (-3, "At dusk Quorra Zelmund rowed home."), (-4, None), (-5, "It was signed by Mara Venn."), (-6, "It was signed by Mara Venn.")]
    df = spark.createDataFrame(rows, "k int, t string").repartition(4)
    words = {r.word: r.ratio for r in P.corpus_words(df, "t").collect()}
    assert words == {w: 2 / 4 for w in ("quorra", "zelmund")} | {w: 2 / 3 for w in ("mara", "venn")}
    whole = sorted((r.k, [tuple(s) for s in r.spans]) for r in P.find_personal(df, ["k"], "t", False).collect())
    parts = sorted((r.k, [tuple(s) for s in r.spans]) for r in P.find_personal(df, ["k"], "t", False, most_words=1).collect())
    assert whole == parts and len(whole) == len(rows)
    assert dict(whole)[-3] == [("name", 9, 23 - 1)]


def test_addresses_beside_a_dotted_capital_i():
    text = "In İstanbul, deliver to 12 Mill Street today."
    assert "12 Mill Street" in {text[s:e] for s, e, k in P.candidates(text, P.Lexicon({})) if k == "address"}


def test_small_names_that_touch_punctuation():
    text = "yesterday we met mara tellberg, and it rained."
    got = P.candidates(text, P.Lexicon({"mara": 0.5, "tellberg": 0.5}))
    assert "mara tellberg" in {text[s:e] for s, e, k in got if k == "name"}

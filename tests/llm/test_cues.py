import random

from quillworks.llm import cues
from quillworks.llm.cues import OTHER, TYPO, collapse_runs, dissimilarity, reduced, segment, segment_by_first


def d(a, b):
    return dissimilarity(reduced(a), reduced(b))


def test_same_cues():
    assert d("The old mill.", "<i>the  OLD\nmill</i>!") == 0
    assert d("{\\an8}Straße", "STRASSE") == 0
    assert d("The old mill", "The old mll") == TYPO == d("The old mill", "The odl mill".replace("odl", "oId"))
    assert d("foot ball", "football") == 0


def test_different_cues():
    for a, b in [("Number 22 open", "Number 23 open"), ("a cat sat", "cat sat"), ("cat sat", "cat sat down"), ("the red door", "the blue door"), ("page 1", "page 11"), (None, None), ("o rio", "a rio")]:
        assert d(a, b) == OTHER, (a, b)


def test_segment_is_optimal():
    rnd = random.Random(5)
    for _ in range(200):
        costs = [rnd.choice([0.0, 0.5, 0.9, 1.5, 4.0]) for _ in range(rnd.randint(0, 9))]
        n, best = len(costs) + 1, float("inf")
        for mask in range(2 ** len(costs)):
            best = min(best, sum(cues.PENALTY if mask >> i & 1 else c for i, c in enumerate(costs)))
        starts = segment(costs)
        assert abs(best - sum(cues.PENALTY if i + 1 in starts else c for i, c in enumerate(costs))) < 1e-9 and n >= len(starts)


def test_runs_against_their_first_event_are_optimal():
    """Brute force over all segmentations; slow drift ends a run, and not where neighbours differ most."""
    rnd = random.Random(6)
    words = ["the old mill", "the odd mill", "the add mill", "thf old mill", "xx", None]
    for _ in range(150):
        keys = [rnd.choice(words) for _ in range(rnd.randint(1, 8))]
        n, best = len(keys), float("inf")

        def price(starts):
            ends = [*starts[1:], n]
            return sum(cues.PENALTY + sum(dissimilarity(keys[s], keys[k]) for k in range(s + 1, e)) for s, e in zip(starts, ends))

        for mask in range(2 ** (n - 1)):
            best = min(best, price([0] + [i + 1 for i in range(n - 1) if mask >> i & 1]))
        assert abs(price(segment_by_first(keys)) - best) < 1e-9
    assert segment_by_first(["the old mill", "the odd mill", "the add mill"]) != segment([TYPO, TYPO])


def brute(rows):
    out, seen = [], {}
    for e, s, t, a, b in rows:
        if e is not None and s is not None:
            seen.setdefault((e, s), (t, a, b))
    prev = None
    for (e, s), (t, a, b) in sorted(seen.items(), key=lambda x: x[0]):
        if prev and prev[0] == e and d(prev[1], t) <= TYPO:
            out[-1][2], out[-1][3] = s, out[-1][3] + 1
        else:
            out.append([e, s, s, 1])
        prev = (e, t)
    return {tuple(x) for x in out}


def test_runs_over_block_edges_match_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    words = ["The old mill", "the old mill.", "The odd mill", "A new day", None, "...", "[music]", "[Music]"]
    rows = [(rnd.choice([1, 1, 1, 2, 3, None]), rnd.randint(0, 9000), rnd.choice(words) if rnd.random() < 0.7 else "la la", None, 1.0) for _ in range(4000)]
    rows += [(9, s, "same", float(s), float(s) + 1) for s in range(0, 9500)]
    first = {}
    rows = [first.setdefault((r[0], r[1]), r) for r in rows] + rows[:5]
    first = {}
    rows = [first.setdefault((r[0], r[1]), r) for r in rows]
    df = spark.createDataFrame(rows, "e int, q bigint, text string, a double, b double")
    got = collapse_runs(df, "e", "q", "text", "a", "b").collect()
    assert {(r.entity, r.first_seq, r.last_seq, r.n_events) for r in got} == brute(rows)
    drift = collapse_runs(df, "e", "q", "text", "a", "b", against="first").collect()
    assert sum(r.n_events for r in drift) == sum(r.n_events for r in got)
    sparse = collapse_runs(df.selectExpr("e", "q * 1000000007 as q", "text", "a", "b"), "e", "q", "text", "a", "b").collect()
    assert {(r.entity, r.first_seq // 1000000007, r.last_seq // 1000000007, r.n_events) for r in sparse} == brute(rows)
    long = [r for r in got if r.entity == 9]
    assert len(long) == 1 and long[0].n_events == 9500 and long[0].start_time == 0 and long[0].end_time == 9500
    assert {(r.entity, r.first_seq) for r in collapse_runs(df, "e", "q", "text", "a", "b", True).collect()} == {(e, s) for e, s, _, n in brute(rows) if n > 1}
    assert collapse_runs(df.limit(0), "e", "q", "text", "a", "b").count() == 0

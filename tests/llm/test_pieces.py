from hypothesis import given, settings, strategies as st

from quillworks.llm.pieces import cut, split_items


def rebuilt(text, parts):
    out, last = "", 0
    for s, e, _ in parts:
        assert s <= last < e or last == 0
        out, last = out + text[last:e], e
    return out


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n é́", max_size=400), st.sampled_from([(20, 0), (30, 5), (50, 20), (7, 6), (1, 0)]))
def test_pieces_are_whole_and_within_the_limit(text, size):
    limit, overlap = size
    parts = cut(text, limit, overlap)
    assert rebuilt(text, parts) == text
    assert all(e - s <= limit for s, e, _ in parts)


def test_prefers_paragraphs_and_repeats_the_overlap():
    para = "word " * 30
    text = "\n\n".join([para.strip()] * 10)
    parts = cut(text, 400, 40)
    assert {k for _, _, k in parts} == {"paragraph", "end"}
    for (_, e, _), (s, _, _) in zip(parts, parts[1:]):
        assert 20 <= e - s <= 60 and text[s - 1].isspace()


def test_best_cut_equals_brute_force():
    from quillworks.llm import pieces as P

    text = "aa bb. cc dd ee. ff gg hh\nii jj kk. ll"
    limit, overlap = 16, 0
    ends, kinds = P.boundaries(text, limit, overlap)
    n, k = len(text), -(-len(text) // limit)
    even = n / k

    def best(i):
        if i == n:
            return 0.0
        return min((P.PENALTY[w] + P.PIECE_COST + P.BALANCE * ((e - i - even) / limit * 1.0) ** 2 + best(e) for e, w in zip(ends, kinds) if 0 < e - i <= limit), default=float("inf"))

    cost = sum(P.PENALTY[w] + P.PIECE_COST + P.BALANCE * ((e - s - even) / limit) ** 2 for s, e, w in cut(text, limit, overlap))
    assert abs(cost - best(0)) < 1e-9


def test_frame_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "short", "x"), (4, "z" * 5000, "x"), (4, "z" * 5000, "x"), (None, "y" * 2500, "x")]
    df = spark.createDataFrame(rows, "k int, t string, piece_no string")
    got = split_items(df, ["k"], "t", 2000, 150).collect()
    by = {}
    for r in got:
        by.setdefault(r.k, []).append(r)
    assert set(by) == {2, 3, 4, None} and len(by[4]) == 3 and len(by[None]) == 2
    assert all(len(r.text) == r.end_pos - r.start_pos + 1 <= 2000 for r in by[4])
    assert split_items(df.limit(0), ["k"], "t", 2000, 150).count() == 0


def test_very_long_text():
    text = ("lorem ipsum dolor. " * 60_000)
    parts = cut(text, 2000, 150)
    assert rebuilt(text, parts) == text and all(e - s <= 2000 for s, e, _ in parts)

import random

import numpy as np

from quillworks.llm import boilerplate
from quillworks.llm.boilerplate import MIN_PAGES, Page, common_prefixes, forms, recurrence, separate_pages, source_lines, suffix_order, tokens


def test_suffix_array_matches_sorted_suffixes():
    rnd = random.Random(1)
    for _ in range(60):
        t = np.array([rnd.randint(0, 3) for _ in range(rnd.randint(2, 60))])
        order, levels = suffix_order(t, 64)
        assert [tuple(t[i:]) for i in order] == sorted(tuple(t[i:]) for i in range(len(t)))
        lcp = common_prefixes(order, levels)
        for a, b, n in zip(order, order[1:], lcp):
            k = 0
            while a + k < len(t) and b + k < len(t) and t[a + k] == t[b + k]:
                k += 1
            assert k == n


def test_recurrence_matches_counting():
    rnd = random.Random(2)
    long = "a long line of words that goes on " * 12
    texts = ["home", "news", "old mill", "a long line of words", "© 2020 site", "© 2021 site", "see: {}", "see also: {}", long + "x", long + "y", "old mill road {}"]
    pages = [[tokens(rnd.choice(texts).format(f"unique{'z' * k}")) if rnd.random() < 0.7 else tokens(f"unique {'k' * k} x{'y' * i}") for i in range(rnd.randint(0, 8))] for k in range(30)]
    on = {}
    for k, lines in enumerate(pages):
        for words in lines:
            for f, form in enumerate(forms(words)):
                if form is not None:
                    on.setdefault((f, form), set()).add(k)
    for lines, counts in zip(pages, recurrence(pages)):
        for words, got in zip(lines, counts):
            want = [0 if form is None else len(on[f, form]) for f, form in enumerate(forms(words))]
            assert got == tuple(n if n >= MIN_PAGES else 0 for n in want)


def test_source_lines_and_boxes():
    src = "<html>\n<head><title>T</title></head><body>\n<nav>\n<p>Home</p>\n</nav>\n<article>\n<h1>Title</h1>\n<p>The mill turned all night and nobody heard it.</p>\n<pre>\nx = 1\n</pre>\n</article>\n<footer>\n<p>Odd words</p>\n</footer>\n</body></html>"
    lines = source_lines(src)
    assert [(p, t) for p, _, _, t in lines] == [(4, "Home"), (7, "Title"), (8, "The mill turned all night and nobody heard it."), (10, "x = 1"), (14, "Odd words")]
    page = Page(("t", 1), lines)
    assert page.furniture({}) == [False] * 5  # nothing recurs, so nothing is furniture
    page.counts[0] = (5, 0, 5)
    assert page.furniture({page.form(0): True}) == [True, False, False, False, False]


def test_frame(spark):
    art = lambda k: [("paragraph", "Home | News"), ("heading:1", f"Title {'t' * k} of the day"), ("paragraph", f"Sentence number {'x' * k} tells a long story about a mill."), ("listItem", "Farinha, sal"), ("paragraph", f"Another {'y' * k} sentence follows, as long as the first one."), ("paragraph", "House rules apply to all"), ("heading:3", "Most read"), ("listItem", f"Other {'z' * k} title"), ("paragraph", "© 2020 Site")]
    rows = [("web_articles", k, "h", None, art(k)) for k in range(1, 9)] + [("web_articles", 1, "h", None, art(1)), ("web_articles", 99, None, None, [(None, None), ("paragraph", "")]), ("web_articles", None, "h", None, art(3)), ("extracted_docs", 5, "h", "<p>One line of text that is a sentence.</p>", None)]
    df = spark.createDataFrame(rows, "tbl string, rec_id long, host string, source string, blocks array<struct<kind:string,text:string>>")
    got = {(r.tbl, r.rec_id): r for r in separate_pages(df).collect()}
    assert len(got) == 10
    for k in range(1, 9):
        r = got[("web_articles", k)]
        assert 2 in r.kept and 3 in r.kept and 4 in r.kept and 5 in r.kept and {1, 7, 8, 9} <= set(r.furniture)
    assert got[("web_articles", 99)].kept == [] and got[("extracted_docs", 5)].kept == [1]
    assert separate_pages(df.limit(0)).count() == 0


def test_shards_give_what_one_group_gives(spark):
    """A line on 5 of 40 pages is seen as repeated, however the host is split."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    rows = []
    for k in range(40):
        blocks = [("paragraph", f"Walls of {word()} ask {k}"), ("heading:1", f"Title {word()} {word()}"), ("paragraph", f"The {word()} told a long story about the {word()} mill."), ("paragraph", "Farinha, sal"), ("paragraph", f"Another {word()} sentence follows, as long as the {word()}.")]
        blocks += [("paragraph", "© 2020 Site")] * (k % 13 == 0) + [("paragraph", "Odd words of the house")] * (k % 13 == 0 or k == 5) + [("paragraph", f"Lines {k} of the desk")] * (k % 2) + [("paragraph", f"{word()} {word()}")] * (k % 3 == 0)
        rows.append(("web_articles", k, "h", None, blocks))
    rows += rows[:3] + [("web_articles", 100, "small", None, rows[0][4])]
    df = spark.createDataFrame(rows, "tbl string, rec_id long, host string, source string, blocks array<struct<kind:string,text:string>>")
    one, many = ({(r.tbl, r.rec_id): (r.kept, r.furniture) for r in separate_pages(df, shard).collect()} for shard in (1_000_000, 800))
    assert one == many and len(many) == 41
    assert 6 in many["web_articles", 5][1]
    assert any(f for _, f in many.values())


def test_article_in_two_boxes():
    """A box goes with its repeated lines; one with unique sentences stays."""
    src = "<body>\n<div>\n<p>This site is kept by the friends of the old mill.</p>\n<p>Odd words</p>\n</div>\n<article>\n<h1>Title</h1>\n<p>The mill turned all night and nobody heard it.</p>\n</article>\n<section>\n<h2>Later</h2>\n<p>By morning the wheel had stopped and the pond was dry.</p>\n</section>\n</body>"
    page = Page(("t", 1), source_lines(src))
    page.counts[0] = (9, 0, 9)
    assert page.furniture({page.form(0): True}) == [True, True, False, False, False, False]
    assert page.places() == {page.form(0): (True, True)}


def test_without_the_suffix_array_nothing_is_furniture(spark, monkeypatch):
    art = lambda k: [("paragraph", "Home | News"), ("heading:1", f"Title {'t' * k} of the day"), ("paragraph", f"Sentence number {'x' * k} tells a long story about a mill."), ("paragraph", "© 2020 Site. All rights reserved.")]
    pages = []
    for k in range(1, 9):
        pages.append(("web_articles", k, "h", boilerplate.WHOLE, k, None, [dict(zip(("kind", "text"), b)) for b in art(k)], None, None, None, None))
    assert all(r[3] == [1, 4] for r in boilerplate._group_rows(pages))
    monkeypatch.setattr(boilerplate, "recurrence", lambda pages, least=MIN_PAGES: [[(0, 0, 0)] * len(p) for p in pages])
    assert all(r[3] == [] for r in boilerplate._group_rows(pages))


def test_copies_of_a_page_are_one_page(spark):
    """An article that stands on many addresses of its host isn't furniture of it."""
    art = [("heading:1", "Title of the day"), ("paragraph", "One sentence tells a long story about a mill."), ("paragraph", "Another sentence follows, as long as the first.")]
    df = spark.createDataFrame([("web_articles", k, "h", None, art) for k in range(9)], "tbl string, rec_id long, host string, source string, blocks array<struct<kind:string,text:string>>")
    for shard in (1_000_000, 200):
        assert all(r.furniture == [] and r.kept == [1, 2, 3] for r in separate_pages(df, shard).collect())

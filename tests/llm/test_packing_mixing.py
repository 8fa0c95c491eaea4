from quillworks.llm import tokens
from quillworks.llm.mixing import mix_sources, share_report
from quillworks.llm.packing import Packer, fill_report, pack_items


def test_token_parts_join_to_the_whole():
    t = "word " * 9000 + "x" * 30_000
    assert tokens.count(t) > 9000 and tokens.count("") == tokens.count(None) == 0
    e = tokens.encoder()
    assert tokens.count("a short text, with signs") == len(e.encode_ordinary("a short text, with signs"))


def test_packer_never_overfills_and_loses_nothing():
    import random

    rnd = random.Random(4)
    for cap in (10, 100, 1000):
        p, sizes, bins = Packer(cap), [rnd.randint(1, cap) for _ in range(3000)], []
        for i, s in enumerate(sizes):
            bins += p.add((i, s), s)
        bins += p.rest()
        assert sorted(i for _, items in bins for i, _ in items) == list(range(3000))
        assert all(used == sum(s for _, s in items) <= cap for used, items in bins)
        assert sum(sizes) / (cap * len(bins)) > 0.85


def test_pack(spark):
    rows = [(i, "word " * (1 + i * 7 % 90)) for i in range(400)] + [(900, "tree " * 2500), (901, None), (902, ""), (None, "x"), (5, "word " * 36)]
    df = spark.createDataFrame(rows, "k int, t string").repartition(4)
    packed = pack_items(df, "k", "t", {"small": 64, "big": 1000})
    got = packed.collect()
    for name, cap in (("small", 64), ("big", 1000)):
        bins, parts = {}, {}
        for r in got:
            if r.limit_name == name:
                bins[r.container] = bins.get(r.container, 0) + r.n_tokens
                parts.setdefault(r.item_id, []).append(r)
        assert max(bins.values()) <= cap and None not in bins
        assert sum(p.n_tokens for p in parts[900]) == tokens.count("tree " * 2500) and sorted(p.start_token for p in parts[900]) == list(range(0, sum(p.n_tokens for p in parts[900]), cap))
        assert len(parts[5]) == 2 if tokens.count("word " * 36) <= cap else True
        assert 901 not in parts and 902 not in parts and None not in parts
    assert {r.limit_name: r.fill > 0.85 for r in fill_report(packed).collect()} == {"small": True, "big": True}
    assert pack_items(df.limit(0), "k", "t", {"a": 5}).count() == 0


def test_mix(spark):
    rows = [(i, f"text number {i} " + "oak " * (i % 17), "abc"[i % 3] if i % 5 else "a") for i in range(600)] + [(1000 + i, f"rare {i}", "d") for i in range(20)] + [(2000, "text number 1 oak ", "c"), (2001, None, "a"), (2002, "x", None), (2003, "y", "zzz")]
    df = spark.createDataFrame(rows, "k int, t string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 1), ("d", 0.05, 3), ("gone", 0.1, 1), ("zero", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixture = mix_sources(df, targets.filter("source <> 'gone'"), "k", "t", "source")
    got = mixture.collect()
    assert {r.source for r in got} == {"a", "b", "c", "d"}
    uses = {}
    for r in got:
        uses.setdefault((r.source, r.item_id), []).append(r.use_no)
    most = {"a": 1, "b": 2, "c": 1, "d": 3}
    assert all(sorted(u) == list(range(1, len(u) + 1)) and len(u) <= most[s] for (s, _), u in uses.items())
    report = {r.source: r for r in share_report(mixture, targets).collect()}
    for s in "abcd":
        assert abs(report[s].actual_share - report[s].target_share) < 0.02
    assert report["gone"].n_tokens == 0
    places = sorted((r.place, r.n_tokens) for r in got)
    assert [p for p, _ in places] == [sum(n for _, n in places[: i + 1]) for i in range(len(places))]
    budget = sum(r.n_tokens for r in got) // 2
    assert sum(r.n_tokens for r in mix_sources(df, targets, "k", "t", "source", budget=budget).collect()) <= budget
    assert mix_sources(df.limit(0), targets, "k", "t", "source").count() == 0

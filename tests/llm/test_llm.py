"""The training-data operators against brute force, on small tables with every kind of dirt."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palinode.llm import heavy, leakage, lookalike, mix, packing, pairs, pii, quantiles, ribbon
from palinode.llm.common import day_of, digest_of, instant_us, pass_name
from palinode.llm.seen import SeenBefore


def values(df):
    return sorted(tuple(r) for r in df.collect())


# 1 ------------------------------------------------------------------------------------------------------------------


@pytest.fixture
def attacks(spark):
    rows = [(i, ["Bidi ", "split_string", "HOMO-glyph", None, " rare"][min(4, i % 40 // 9)], "t") for i in range(400)]
    return spark.createDataFrame(rows, "sample_id bigint, category string, mix_category string")


def test_mix_keeps_quotas_and_reports_shortfalls(spark, attacks):
    targets = spark.createDataFrame(
        [("bidi", 0.2, 5), ("split-string", 0.1, 50), ("rare", 0.3, 2), ("unknown", 0.1, 1), ("homo glyph", None, None), (None, 0.3, 1)],
        "category string, share double, min_rows int",
    )
    sample, report = mix.sample_to_mix(attacks, targets, "category", ["sample_id"])
    got = {r["category"]: r for r in report.collect()}
    assert got["bidi"]["wanted"] == 40 and got["split-string"]["wanted"] == 50
    assert {c for c, r in got.items() if r["exhausted"]} == {"rare", "unknown"} == {r["category"] for r in mix.shortfalls(sample, report).collect()}
    drawn = Counter(r["mix_category"] for r in sample.collect())
    assert drawn == {c: r["quota"] for c, r in got.items() if r["quota"]}
    assert values(sample) == values(mix.sample_to_mix(attacks.repartition(7), targets, "category", ["sample_id"])[0])
    assert len({r["sample_id"] for r in sample.collect()}) == sample.count()


def test_mix_is_uniform_within_a_category(spark, attacks):
    targets = spark.createDataFrame([("bidi", 0.2, 0)], "category string, share double, min_rows int")
    counts = Counter(r["sample_id"] for seed in range(10) for r in mix.sample_to_mix(attacks, targets, "category", ["sample_id"], seed=seed)[0].collect())
    # 40 of 90 rows, 10 times
    assert len(counts) == 90 and max(counts.values()) < 10


def test_mix_of_nothing_and_of_equal_rows(spark, attacks):
    targets = spark.createDataFrame([("bidi", 0.5, 1)], "category string, share double, min_rows int")
    sample, report = mix.sample_to_mix(attacks.limit(0), targets, "category", ["sample_id"])
    assert sample.count() == 0 and report.first()["exhausted"]
    same = spark.createDataFrame([(1, "bidi")] * 10, "sample_id bigint, category string")
    assert mix.sample_to_mix(same, targets, "category", ["sample_id"])[0].count() == 3
    # repeated keys in two categories, in several pieces
    same = spark.createDataFrame([(k % 3, ["bidi", "leet"][k % 2]) for k in range(600)], "sample_id bigint, category string").repartition(5)
    both = spark.createDataFrame([("bidi", 0.35, 1), ("leet", 0.1, 70)], "category string, share double, min_rows int")
    sample, report = mix.sample_to_mix(same, both, "category", ["sample_id"])
    assert {r["mix_category"]: r["count"] for r in sample.groupBy("mix_category").count().collect()} == {"bidi": 105, "leet": 70}
    assert {r["category"]: r["share_reached"] for r in report.collect()} == {"bidi": 0.6, "leet": 0.4} and mix.shortfalls(sample, report).count() == 0


# 2 ------------------------------------------------------------------------------------------------------------------

SAME = [
    ("café", "café"), ("ignore", "іgnοre"), ("a b", "a b"), ("a b", "a b"), ("office", "oﬃce"), ("fi", "ﬁ"),
    ("ABC", "ＡＢＣ"), ("reset", "re​s­et️"), ("Hut", "Нut"), ("x", "х"), ("é", "е́"), ("カ", "ｶ"),
]
DIFFERENT = [("a", "A"), ("cafe", "café"), ("1", "l"), ("0", "O"), ("a-b", "a b"), ("a  b", "a b"), ("I", "l"), ("m", "rn"), ("x²", "x2"), ("щ", "w"), ("a\nb", "a b")]


def test_look_alikes(spark):
    rewriter = lookalike.Rewriter(lookalike.rewriting({c: 1000 for c in "abcdefghijklmnopqrstuvwxyzABCHINORT "}))
    for a, b in SAME:
        assert rewriter.one(a) == rewriter.one(b), (a, b)
        assert rewriter.one(rewriter.one(b)) == rewriter.one(b)
    for a, b in DIFFERENT:
        assert rewriter.one(a) != rewriter.one(b), (a, b)


def test_letters_of_all_scripts(spark):
    rewriter = lookalike.Rewriter(lookalike.rewriting({c: 1000 for c in "abcdefghijklmnopqrstuvwxyzABCHINORT "}))
    for a, b in [("Hat", "\u13bbat"), ("Bat", "\ua4d0at"), ("Cat", "\u2ca4at"), ("big", "bi\u0261"), ("cat", "c\u0251t")]:
        assert rewriter.one(a) == rewriter.one(b), (a, b)
    for c in lookalike.look_alike_classes():
        assert len({x for x in c if len(x) == 1 and x.isascii() and x.isalnum()}) <= 1, c


def test_representatives_follow_the_corpus(spark):
    cyrillic = spark.createDataFrame([("оаеоаео",), (None,), ("",), ("o",)], "text string")
    rewriter = lookalike.fitted(cyrillic)
    assert rewriter.one("oae") == "оае"
    assert rewriter.one("оﬁ") == "оfi".replace("i", rewriter.one("i"))


def test_same_looking_pairs(spark):
    rows = [("t", 1, "ignore"), ("t", 2, "іgnore"), ("t", 3, "ignore"), ("u", 4, "ignorе"), ("t", 5, None), ("t", 6, ""), ("t", 7, "​"), ("t", 8, "x" * 20000), ("t", 9, "x" * 19999 + "х")]
    texts = spark.createDataFrame(rows, "tbl string, id bigint, text string")
    keys = lookalike.keyed(texts, lookalike.fitted(texts))
    assert values(lookalike.pairs(keys)) == [("t", 1, 2), ("t", 2, 3), ("t", 8, 9)]
    got = {(r["tbl"], r["id"]): (r["variants"], r["links"]) for r in lookalike.members(keys).collect()}
    assert got == {("t", 1): (2, 1), ("t", 3): (2, 1), ("t", 2): (2, 2), ("t", 8): (2, 1), ("t", 9): (2, 1)}
    assert sorted((r["variants"], r["rows"]) for r in lookalike.classes(keys).collect()) == [(2, 2), (2, 3)]
    none = texts.limit(0)
    assert lookalike.pairs(lookalike.keyed(none, lookalike.fitted(none))).count() == 0


def test_every_text_is_rewritten_once(spark):
    rows = [("t", k, f"text {k % 7}" + "\u200b" * (k % 3)) for k in range(200)] + [("t", 5, "text 5\u200b\u200b"), ("t", None, "text 1")]
    texts = spark.createDataFrame(rows, "tbl string, id bigint, text string")
    plan = lookalike.pairs(lookalike.keyed(texts, lookalike.fitted(texts)))
    assert "ArrowEvalPython" not in plan._jdf.queryExecution().executedPlan().toString()
    by = {}
    for _, k, t in rows:
        if k is not None:
            by.setdefault(t.replace("\u200b", ""), set()).add((k, t))
    want = {(min(a, b), max(a, b)) for c in by.values() for a, s in c for b, t in c if s != t and a != b}
    assert {(r["id_a"], r["id_b"]) for r in plan.collect()} == want


# 3 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [8, 16, 32])
@pytest.mark.parametrize("n", [0, 1, 700, 20_000])
def test_ribbon_holds_every_key_and_hardly_any_other(bits, n):
    rng = np.random.default_rng(n)
    h1, h2, o1, o2 = (rng.integers(-(2**63), 2**63 - 1, max(n, 20_000), dtype=np.int64) for _ in range(4))
    blob = ribbon.build(np.r_[h1[:n], h1[: n // 2]], np.r_[h2[:n], h2[: n // 2]], bits)
    assert ribbon.probe(blob, h1[:n], h2[:n]).all()
    assert ribbon.probe(blob, o1, o2).mean() <= 2.0**-bits * 1.5 + 3e-4
    if n == 20_000:
        assert len(blob) * 8 / (1.5 * n) < 1.4 * bits


def test_seen_before_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "hot", "hot", "hot", *map(str, range(400))]), rng.choice([None, *range(0, 5000, 7)])) for i in range(2000)]
    rows += [(None, "9", 1)]
    before = [("3",), ("5",), (None,)]
    seen = SeenBefore(spark.createDataFrame(rows, "id bigint, key string, us bigint"), spark.createDataFrame(before, "key string"))
    met, want = {"3", "5"}, []
    for i, key, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[2] is None, r[2] or 0, r[0])):
        if key is not None:
            if key in met:
                want.append((i,))
            met.add(key)
    assert values(seen.seen()) == sorted(want)
    report = seen.audit(2000).collect()
    assert all(r["wrong"] == 0 for r in report) and {r["gen"] for r in report} >= {-1, 0}
    empty = SeenBefore(spark.createDataFrame([], "id bigint, key string, us bigint"), spark.createDataFrame([], "key string"))
    assert empty.seen().count() == 0


def test_audit_asks_as_answers_do(spark):
    rows = [(i, f"k{i}", i) for i in range(3000)]
    log, before = spark.createDataFrame([*rows, (3000, "absent 7", 3000)], "id bigint, key string, us bigint"), spark.createDataFrame([("b",)], "key string")
    # a stored key of the form of the absent ones is met where it is stored, so they are hashed and dealt as all keys
    got = {r["gen"]: r for r in SeenBefore(log, before).audit(1000).collect()}
    assert [g for g, r in got.items() if r["wrong"]] == [15] and got[15]["answers_wrong"] == 1
    got = [r for r in SeenBefore(log, before, 8).audit(20_000).orderBy("gen").collect()]
    assert all(a["answers_wrong"] <= b["answers_wrong"] <= a["answers_wrong"] + b["wrong"] for a, b in zip(got, got[1:], strict=False))
    assert 0.5 < got[-1]["answer_rate"] / got[-1]["expected_answer_rate"] < 1.5


def test_generations_are_filled_whatever_single_instants(spark):
    rows = [(k, f"k{k % 700}", 10**15 + k) for k in range(1000)] + [(1000, "k5", 0), (1001, "k6", 10**17), (1002, "k7", None)]
    seen = SeenBefore(spark.createDataFrame(rows, "id bigint, key string, us bigint"), spark.createDataFrame([], "key string"))
    met, want = set(), set()
    for i, key, _ in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0])):
        if key in met:
            want.add(i)
        met.add(key)
    assert {r["id"] for r in seen.seen().collect()} == want
    sizes = [r["count"] for r in seen.firsts.groupBy("gen").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 150


def test_digests_instants_and_names(spark):
    h = "ab" * 32
    forms = [h, h.upper(), ":".join(["AB"] * 32), "0x" + h, "sha256:" + h, f" {h}\n", h[:40], "n/a", "", None]
    got = [r[0] for r in spark.createDataFrame([(f,) for f in forms], "f string").select(digest_of(F.col("f"))).collect()]
    assert got == [h] * 6 + [None] * 4
    rows = [("2017-01-03T10:29:06Z", 0), ("2017-01-03 10:29:06Z", 0), ("2017-01-03T12:29:06+02:00", 0), ("2017-01-03T10:29:06.000Z", 0), ("", 1), (None, 1), ("soon", 1)]
    df = spark.createDataFrame(rows, "w string, k int").withColumn("r", F.expr("timestamp_ntz'2017-01-04 00:00:01'"))
    got = [(r[0], r[1]) for r in df.select(instant_us(F.col("w"), F.col("r")), day_of(instant_us(F.col("w"), F.col("r")))).collect()]
    assert got == [(1483439346000000, "2017-01-03")] * 4 + [(1483488001000000, "2017-01-04")] * 3
    names = ["BiDiControl", "bidi_control ", "BIDI-CONTROL", "PreScanNfc", "Base64", "SomethingNew", " ", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(pass_name(F.col("n"))).collect()]
    assert got == ["bidi-control"] * 3 + ["pre-scan-nfc", "base64", "something-new", None, None]


# 4 ------------------------------------------------------------------------------------------------------------------


def test_pairs_match_brute_force(spark):
    rng = random.Random(4)
    rows = [(None if k % 50 == 0 else [rng.choice([*"abcdef", None]) for _ in range(rng.randrange(6))],) for k in range(600)] + [(["a", "b"],)] * 300
    df = spark.createDataFrame(rows, "items array<string>")
    sets = [set(r[0]) - {None} for r in rows if r[0]]
    n = len(sets)
    one, two = Counter(x for s in sets for x in s), Counter((a, b) for s in sets for a in s for b in s if a < b)
    got = pairs.pair_counts(df, F.col("items")).collect()
    assert {(r["item_a"], r["item_b"]): r["together"] for r in got} == two
    for r in got:
        a, b, t = one[r["item_a"]], one[r["item_b"]], r["together"]
        assert (r["count_a"], r["count_b"], r["n"]) == (a, b, n)
        assert math.isclose(r["lift"], t * n / (a * b))
        assert r["conviction"] is None if a == t else math.isclose(r["conviction"], (1 - b / n) / (1 - t / a))
    chosen = pairs.surprising(pairs.pair_counts(df, F.col("items")), 1, 1)
    assert {(r["item_a"], r["item_b"]) for r in chosen.collect()} == {p for p, t in two.items() if t * 100 >= n and t * n >= one[p[0]] * one[p[1]]}
    assert pairs.pair_counts(df.limit(0), F.col("items")).count() == 0


# 5 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [8, 4096])
def test_most_frequent_matches_brute_force(spark, width):
    rng = random.Random(5)
    keys = [None] * 20 + ["hot"] * 3000 + [f"k{int(rng.paretovariate(0.7)) % 900}" for _ in range(6000)]
    rng.shuffle(keys)
    top = heavy.most_frequent(spark.createDataFrame([(k,) for k in keys], "key string").repartition(6), 12, width=width).collect()
    want = sorted(((-n, k) for k, n in Counter(k for k in keys if k).items()))[:12]
    assert [(-r["n"], r["key"]) for r in top] == want
    assert all(r["lower"] <= r["n"] <= r["upper"] for r in top)


def test_votes_merge_in_a_tree_and_memory_stays_bounded(spark, monkeypatch):
    keys = spark.createDataFrame([(f"k{k % 37 if k % 3 else 1}",) for k in range(3000)], "key string").repartition(9)
    whole = candidates_of(heavy.sketch(keys.select(F.xxhash64("key").alias("h")), width=64))
    monkeypatch.setattr(heavy, "FAN", 2)
    tree = candidates_of(heavy.sketch(keys.select(F.xxhash64("key").alias("h")), width=64))
    assert {(r, c): t for r, c, t, _ in tree} == {(r, c): t for r, c, t, _ in whole}
    top = heavy.most_frequent(keys, 1, width=64).first()
    assert top["key"] == "k1" and top["lower"] <= top["n"] <= top["upper"] and top["other"] < top["n"]
    even = spark.createDataFrame([(f"k{k % 500}",) for k in range(2000)], "key string")
    rows = heavy.most_frequent(even, 5, width=8, max_width=8).collect()
    assert len(rows) == 5 and all(r["n"] == 4 and r["other"] >= 4 for r in rows)


def candidates_of(cells):
    return sorted((r["row"], r["cell"], r["total"], r["candidate"]) for r in cells.collect())


def test_most_frequent_of_nothing_and_of_ties(spark):
    assert heavy.most_frequent(spark.createDataFrame([], "key string"), 5).count() == 0
    ties = spark.createDataFrame([(f"{k:03}",) for k in range(300)], "key string")
    assert [r["key"] for r in heavy.most_frequent(ties, 3).collect()] == ["000", "001", "002"]


# 6 ------------------------------------------------------------------------------------------------------------------


def _exact(sorted_values, pct):
    return sorted_values[max(1, -(-pct * len(sorted_values) // 100)) - 1]


def test_percentiles_match_brute_force(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), np.float32(round(rng.betavariate(2, 5), 3)).item()) for _ in range(30_000)]
    rows += [("b", None), ("b", float("nan")), ("nothing", None), ("one", 0.5), ("v", 0.25)]
    df = spark.createDataFrame(rows, "grp string, value float")
    got = {(r["grp"], r["pct"]): (r["n"], r["value"]) for r in quantiles.percentiles(df, ["grp"], [50, 90, 99], k=64).collect()}
    by = {}
    for g, v in rows:
        if v is not None and v == v:
            by.setdefault(g, []).append(v)
    assert got == {(g, p): (len(vs), _exact(sorted(vs), p)) for g, vs in by.items() for p in (50, 90, 99)}
    assert quantiles.percentiles(df.limit(0), ["grp"], [50]).count() == 0


def test_missed_brackets_are_opened(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SIX_SIGMA", 0.0)
    df = spark.range(20_000).select(F.lit("g").alias("grp"), ((F.col("id") * 7919) % 20_011).cast("float").alias("value"))
    want = sorted((i * 7919) % 20_011 for i in range(20_000))
    got = {r["pct"]: r["value"] for r in quantiles.percentiles(df, ["grp"], [1, 50, 99], k=16).collect()}
    assert got == {p: _exact(want, p) for p in (1, 50, 99)}


def test_percentiles_of_wide_numbers(spark):
    # single precision would make many of these one number
    wide = [2**40 + 3 * k for k in range(9000)]
    df = spark.createDataFrame([("a", float(v), v) for v in wide], "grp string, value double, whole bigint").repartition(3)
    for rows in (df.select("grp", "value"), df.select("grp", F.col("whole").alias("value"))):
        got = {r["pct"]: r["value"] for r in quantiles.percentiles(rows, ["grp"], [50, 99], k=32).collect()}
        assert got == {p: _exact(wide, p) for p in (50, 99)}


def test_sketches_of_days_merge(spark):
    df = spark.range(50_000).select((F.col("id") % 5).cast("string").alias("day"), F.lit("a").alias("grp"), (F.col("id") / 50_000).cast("float").alias("value"))
    merged = quantiles.merge(quantiles.sketches(df, ["grp", "day"]), ["grp"])
    row = quantiles.approximate(merged, [50]).first()
    assert row["n"] == 50_000 and abs(row["value"] - 0.5) < 0.02 and row["low"] <= 0.5 <= row["high"]


# 7 ------------------------------------------------------------------------------------------------------------------


def test_packing_is_complete_and_tight(spark):
    rng = random.Random(7)
    sizes = [rng.choice([rng.randrange(1, 1500), 4000, 96]) for _ in range(3000)] + [4096, 4097, 9000, 12288, None, 0, -3]
    docs = spark.createDataFrame([(k if k % 9 else None, s) for k, s in enumerate(sizes)], "doc_id bigint, s bigint")
    rows = packing.pack(docs, "doc_id", F.col("s"), 4096).collect()
    assert sum(r["size"] for r in rows) == sum(s for s in sizes if s and s > 0)
    assert Counter(r["n_parts"] for r in rows if r["part"] == 0 and r["n_parts"] > 1) == Counter(-(-s // 4096) for s in sizes if s and s > 4096)
    used = Counter()
    for r in rows:
        used[r["container"]] += r["size"]
    assert max(used.values()) <= 4096 and sorted(used) == list(range(len(used)))
    assert len(used) <= 1.01 * sum(used.values()) / 4096 + 1
    assert packing.pack(docs.limit(0), "doc_id", F.col("s"), 4096).count() == 0


def test_exact_complements_beat_best_fit():
    counts = np.zeros(101, np.int64)
    counts[[60, 30, 10, 50, 25]] = [10, 10, 10, 4, 8]
    patterns = packing.plan(counts.copy(), 100)
    assert all(sum(p) == 100 for p, _ in patterns)
    used = np.zeros(101, np.int64)
    for p, times in patterns:
        for x in p:
            used[x] += times
    assert (used == counts).all()


# 8 ------------------------------------------------------------------------------------------------------------------

_WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango".split()


def _item(k):
    rng = random.Random(k)
    return [f"{rng.choice(_WORDS)}{rng.randrange(900)}" for _ in range(30)]


def test_leaks(spark):
    items = spark.createDataFrame([(1, " ".join(_item(1))), (2, " ".join(_item(2))), (3, "too short"), (4, None), (None, "x")], "item_id bigint, text string")
    a, b = _item(1), _item(2)
    changed = a[:20]
    changed[5], changed[12] = "other", "else"
    left_out = b[2:10] + b[11:19]
    texts = [
        "no leak at all", "intro " + " ".join(a) + " outro", " ".join(changed), " ".join(left_out), " ".join(a[:12]), " ".join(a[4:19]).upper().replace(" ", ",\n"),
        "&lt;" + "​".join(" ".join(b[:16])) + "&gt;", " ".join(w[:3] + "-\n" + w[3:] for w in a[:16]), " ".join(w if k % 3 else "bad" for k, w in enumerate(a)),
        None, "", "filler words " * 5000 + " ".join(a) + " and " + " ".join(b),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert values(leakage.leaked(docs, items)) == [(1, 1), (2, 1), (3, 2), (5, 1), (6, 2), (7, 1), (11, 1), (11, 2)]
    assert leakage.leaked(docs.limit(0), items).count() == 0 and leakage.leaked(docs, items.limit(0)).count() == 0


def test_a_match_before_the_passage_does_not_hide_it(spark):
    w = _item(1)
    # four clean words, six others of the same length each, twenty clean ones
    leak = w[:4] + [x[::-1] for x in w[4:10]] + w[10:]
    items = spark.createDataFrame([(1, " ".join(w))], "item_id bigint, text string")
    # the other documents make the first shingle the rarest, which is looked for first
    docs = spark.createDataFrame([(0, " ".join(leak)), *[(k, " ".join(w[10:])) for k in range(1, 4)]], "doc_id bigint, text string")
    assert values(leakage.leaked(docs, items)) == [(k, 1) for k in range(4)]


def test_passages_of_many_items_are_reported_for_each(spark):
    # the same question in six suites, and six questions that share their first 18 words
    rows = [(k, " ".join(_item(1))) for k in range(6)] + [(k, " ".join(_item(2)[:18] + _item(k)[:12])) for k in range(6, 12)]
    items = spark.createDataFrame(rows, "item_id bigint, text string")
    docs = spark.createDataFrame([(0, "see " + " ".join(_item(1)) + " there"), (1, " ".join(_item(2)[:18]))], "doc_id bigint, text string")
    assert values(leakage.leaked(docs, items)) == [(0, k) for k in range(6)] + [(1, k) for k in range(6, 12)]


def _filled(k):
    """An item of a template: 24 words, every sixth of its own."""
    return [f"own{k}x{n}" if n % 6 == 5 else w for n, w in enumerate(_item(50)[:24])]


def test_a_template_loses_to_the_item_that_stands_there(spark):
    rows = [(k, " ".join(_filled(k))) for k in range(8)] + [(90 + k, " ".join(_filled(3))) for k in range(5)]
    items = spark.createDataFrame(rows, "item_id bigint, text string")
    hurt = _filled(4)
    hurt[2], hurt[14] = "other", "else"
    # in the last one no item stands, only what all have in common: all are reported
    docs = spark.createDataFrame([(0, "so " + " ".join(_filled(3)) + " end"), (1, " ".join(hurt)), (2, " ".join(_filled(100)))], "doc_id bigint, text string")
    want = [(0, 3), *[(0, 90 + k) for k in range(5)], (1, 4), *[(2, r[0]) for r in rows]]
    assert values(leakage.leaked(docs, items)) == sorted(want)
    every = leakage.leaks(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in every.where("doc_id = 0 and not stands").collect()} == {(0, k) for k in range(8) if k != 3}
    assert every.where("own > rival").count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = [(k, " ".join(_item(k))) for k in range(12)] + [(20 + k, " ".join(_filled(k))) for k in range(6)] + [(30 + k, " ".join(_item(2))) for k in range(8)]
    items = spark.createDataFrame(items, "item_id bigint, text string")
    docs = [(k, "see " + " ".join(_item(k)[3:25])) for k in range(0, 12, 2)] + [(20, " ".join(_filled(1))), (2**60 + 1, "a " + " ".join(_item(5))), (None, " ".join(_item(7)))]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = [(k, k) for k in range(0, 12, 2)] + [(2, 30 + k) for k in range(8)] + [(20, 21), (2**60 + 1, 5), (None, 7)]
    found = lambda: {tuple(r) for r in leakage.leaked(docs, items).collect()}
    assert found() == set(want)
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 700)
    assert found() == set(want)


def test_the_filter_of_documents_never_misses(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "bc", "word", "wörter", "x1"]) for _ in range(40)) for _ in range(30)]
    known = leakage.filter_of(spark.createDataFrame([(t,) for t in texts], "text string"))
    streams = [leakage.letters(leakage.plain(t)) for t in texts]
    assert known.may_hold(streams).all() and known.short and known.lengths
    assert known.may_hold(["", "zzzz", "q" * 2_000_000 + streams[0]]).tolist() == [False, False, True]


# 9 ------------------------------------------------------------------------------------------------------------------

FORMS = {
    "email": ["ann.lee@mail.example", "ANN+X@MAIL.CO.EXAMPLE", "ann at mail dot example", "ann [at] mail.example", "ann(at)mail(dot)test", "ann@​mail.example"],
    "phone": ["+1 883 555 0102", "(249) 555-0199", "893-555-0194", "+44 (0)1632 960792", "020 7946 0993", "+33 1 99 00 70 53", "030/23125308", "+16955550149"],
    "id_number": ["919-74-6193", "979 59 6006", "2 71 25 97 695 265 53", "00 375 990 034", "QQ 38 84 86 B", "QQ325322A", "00031538M", "00023376-P", "112-233-445 95", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"],
    "street_address": ["13 Elmshaw Lane", "88B Kestrelshaw St.", "No. 127 Old Fullerthorpe Street", "140 ELMERTHORPE ROAD", "48 bis avenue de Birkenagate", "Elmacombeweg 138b", "Calle Doverershaw, 199", "10250 Main Street", "ул. Ленина, д. 5", "Calle " + "A" + "b" * 60 + ", 12"],
}
NOT = ["Price 273.10 per blanket, item no. 791289", "Order reference 63-6683-95, shelf 34", "Build 2.20.378 answers on 192.0.2.219", "Coordinates 53.24540, 5.49130; height 834 m",
       "Open 9:00-18:30, 11.8.2019 excepted", "Catalogue 565/849/19 lists 6953 items", "/static/broth@3x.png", "Follow @market for news, meets @ 9 pm.", "After 32 days it ended",
       "Ref 112-233-445 96", "Calle Mayor 28013 Madrid"]


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, ts in FORMS.items() for t in ts])
def test_fixed_forms_are_found_whole(kind, text):
    for frame in ("see {} now", "{}", "well: {}, and so on", "one\n{}\ntwo"):
        full = frame.format(text)
        assert [(k, full[a:b]) for k, a, b in pii.fixed_forms(full)] == [(kind, text)], full


@pytest.mark.parametrize("at", ["<at>", "{AT}", "[ AT ]", "{ at }", "[\u00a0at]", "[  at  ]", "<arroba>"])
def test_every_at_sign_is_read(at):
    text = f"write to ann{at}mail.example now"
    assert [(k, text[a:b]) for k, a, b in pii.fixed_forms(text)] == [("email", f"ann{at}mail.example")]


def test_a_spelt_address_with_no_break_spaces():
    text = "write to ann at mail\u00a0dot\u00a0example now"
    assert [(k, text[a:b]) for k, a, b in pii.fixed_forms(text)][0][0] == "email"


@pytest.mark.parametrize("text", NOT)
def test_other_numbers_are_left(text):
    assert pii.fixed_forms(text) == []


def test_numbers_without_a_form_are_told_by_their_context(spark):
    texts = [f"Note {k}. Hotline: +1 883 555 {1000 + k} all day. Batch code {7000000 + k} packed." for k in range(40)]
    texts += ["Note. Hotline: 8835550102 all day.", "Batch code 8835550103 packed."] + ["Hotline: 8835550104 all day."] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = pii.find(docs, spark.createDataFrame([], "token string, role string"))
    got = {(r["doc_id"], r["surface"]) for r in found.where("pii_type = 'phone'").collect()}
    assert got == {(k, f"+1 883 555 {1000 + k}") for k in range(40)} | {(40, "8835550102")} | {(k, "8835550104") for k in (42, 43, 44)}
    assert found.where("pii_type <> 'phone'").count() == 0


def test_words_of_both_roles_and_large_lexicons(spark, monkeypatch):
    lexicon = [("Mirka", "given"), ("Zarnley", "family"), ("Jordan", "given"), ("Jordan", "family"), ("Kaldez", "family"), ("Osine", "given")]
    lexicon = spark.createDataFrame([*lexicon, *lexicon], "token string, role string")
    long = "Mirka Osine Jordan Mirka Osine Jordan Mirka Osine Zarnley"
    texts = ["We saw Mirka Jordan here", "We saw Jordan Kaldez here", f"We saw {long} here", "We saw Mirka Zarnley here", "Vast Plain Empty Words Of Many Capital Letters Here", None]
    docs = spark.createDataFrame([(2**60 + k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    names = lambda: values(pii.find(docs, lexicon).select("doc_id", "surface"))
    want = [(2**60, "Mirka Jordan"), (2**60 + 1, "Jordan Kaldez"), (2**60 + 2, long), (2**60 + 3, "Mirka Zarnley")]
    assert names() == want
    monkeypatch.setattr(pii, "MAX_LEXICON", 2)
    monkeypatch.setattr(pii, "MANY_WORDS", 3)
    assert names() == want
    monkeypatch.setattr(pii, "MAX_TERMS", 0)
    assert names() == want


def test_names_by_co_occurrence(spark):
    given, family = ["Mirka", "Nevka", "Jorto", "Lidara", "Osine"], ["Zarnley", "Brenquist", "Wolmark", "Stavesh", "Kaldez"]
    lexicon = spark.createDataFrame([(t, "given") for t in given] + [(t, "family") for t in family] + [("Bench", "family"), (None, "given")], "token string, role string")
    rng = random.Random(9)
    known = [f"{rng.choice(given)} {rng.choice(family)}" for _ in range(60)]
    texts = [f"The bench is old. Please ask for {n} at the desk." for n in known[:30]] + [f"Written by {n}\nthe bench was green" for n in known[30:]]
    texts += [f"The ferry from Port {rng.choice(['Narstead', 'Velcroft'])} is full." for _ in range(20)] + ["© Seldesk Bench Trust"] * 20
    cases = {
        "Please ask for Ulroto Hespersen at the desk.": ["Ulroto Hespersen"],
        "Written by Mirka B. van Zarnley": ["Mirka B. van Zarnley"],
        "Please ask for BRENQUIST, NEVKA at the desk.": ["BRENQUIST, NEVKA"],
        "Written by Osine Stavesh-Kaldez": ["Osine Stavesh-Kaldez"],
        "Wolmark Bridge is closed.": [],
        "The ferry from Port Velcroft is full.": [],
    }
    rows = list(enumerate([*texts, *cases, None, "", "word " * 30000 + "Jorto Wolmark"]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = pii.find(docs, lexicon)
    by = {}
    for r in found.where("pii_type = 'person_name'").collect():
        by.setdefault(r["doc_id"], []).append(r["surface"])
    for k, (_text, want) in enumerate(cases.items()):
        assert by.get(len(texts) + k, []) == want
    assert all(known[k] in by[k] for k in range(60)) and by[rows[-1][0]] == ["Jorto Wolmark"]
    out = {r["doc_id"]: r["redacted"] for r in pii.redact(docs, found).collect()}
    assert out[0] == "The bench is old. Please ask for [NAME] at the desk." and out[rows[-3][0]] is None and out[rows[-2][0]] == "" and len(out) == len(rows)
    assert pii.find(docs.limit(0), lexicon).count() == 0 and pii.find(docs, lexicon.limit(0)).count() == 0


def test_names_do_not_depend_on_the_number_of_mentions(spark, monkeypatch):
    given, family = ["Mirka", "Nevka", "Jorto"], ["Zarnley", "Brenquist", "Wolmark"]
    lexicon = spark.createDataFrame([(t, "given") for t in given] + [(t, "family") for t in family], "token string, role string")
    texts = [f"Day {k}. Please ask for {given[k % 3]} {family[k // 3 % 3]} at the desk." for k in range(60)]
    texts += [f"Room {k}. The Tax Office is closed. The bench is old." for k in range(60)]
    spread = [f"Hall {k}. Please ask for Ulroto Hespersen at the desk." for k in range(30)]
    copied = ["Please ask for Vantor Ellmark at the desk."] * 12
    last = "Please ask for Mirka Zarnley Tax"
    rows = list(enumerate([*texts, *spread, *copied, last, None]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = pii.find(docs, lexicon).where("pii_type = 'person_name'")
    monkeypatch.setattr(pii, "MAX_TERMS", 0)
    assert values(pii.find(docs, lexicon).where("pii_type = 'person_name'")) == values(found)
    by = Counter(r["surface"] for r in found.collect())
    assert by["Ulroto Hespersen"] == 30 and by["Vantor Ellmark"] == 12
    assert not any("Tax" in surface for surface in by)

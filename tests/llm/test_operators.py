import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import decontaminate as deco
from tessera.llm import language_id as lang
from tessera.llm import near_dedup as near
from tessera.llm import quality
from tessera.llm import substring_dedup as sub
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.line_dedup import line_dedup
from tessera.llm.url_filter import url_filter

BLANKS = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t) for i, t in enumerate(texts)], "doc_id long, text string")


def passages(seed, n, most=120, vocab=40):
    """Texts with shared passages, copies and near copies."""
    r = np.random.default_rng(seed)
    shared = [" ".join(f"w{x}" for x in r.integers(0, vocab, 45)) for _ in range(3)]
    out = []
    for i in range(n):
        words = [f"u{x}" for x in r.integers(0, 400, r.integers(0, most))]
        if r.random() < 0.4:
            at = r.integers(0, len(words) + 1)
            words[at:at] = shared[r.integers(3)].split()[r.integers(20) :]
        if out and r.random() < 0.3:
            words = out[r.integers(len(out))].split()
            for _ in range(r.integers(0, 3)):
                if words:
                    words[r.integers(len(words))] = "X"
        out.append(" ".join(words))
    return out


# exact dedup


def test_exact_dedup(spark, odd_docs):
    docs = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    want = sorted(
        (d, max(x for x, u in docs if u == t), sum(u == t for _, u in docs), d == max(x for x, u in docs if u == t), hashlib.sha256(t.encode()).hexdigest()) for d, t in docs
    )
    assert sorted(map(tuple, exact_dedup(odd_docs).collect())) == want


def test_exact_dedup_heavy_group_and_null_ids(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    docs = docs.union(spark.createDataFrame([(None, "same"), (None, "alone")], "doc_id long, text string"))
    out = exact_dedup(docs)
    assert out.where("text_sha256 = sha2('same', 256)").groupBy("keep_id", "group_size").count().collect() == [(2997, 1001, 1001)]
    assert out.where("kept").count() == 2002
    assert out.where("doc_id IS NULL AND kept").count() == 1
    assert exact_dedup(docs.where("false")).count() == 0


# line dedup


def lines_by_hand(docs, min_chars=20, min_docs=3):
    key = lambda line: line.strip(BLANKS).translate(UPPER)
    holders = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(-1 if d is None else d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and (-1 if d is None else d) != max(holders[key(x)]) for x in lines]
        out.append((d, "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone)))
    return sorted(out, key=str)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["", "short", "a line of twenty characters", " A line of TWENTY characters\t", "another long line, with é and 語", "x" * 20, "y" * 19]), max_size=5).map("\n".join)), max_size=12))
def test_line_dedup(spark, texts):
    got = line_dedup(frame(spark, texts)).select("doc_id", "kept_text", "n_lines", "n_dropped")
    assert sorted(map(tuple, got.collect()), key=str) == lines_by_hand(list(enumerate(texts)))


def test_line_dedup_odd_rows(spark, odd_docs):
    out = line_dedup(odd_docs)
    assert set(out.columns) == {*odd_docs.columns, "n_lines", "n_dropped"}
    assert sorted(map(tuple, out.select("doc_id", "kept_text", "n_lines", "n_dropped").collect()), key=str) == lines_by_hand([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert line_dedup(odd_docs.where("false")).count() == 0


def test_line_dedup_counts_ids(spark, monkeypatch):
    a, b, c = (x * 20 for x in "abc")
    rows = [(1, f"{a}\n{c}"), (1, f"{a}\n{b}"), (2, f"{a}\n{b}"), (3, f"{b}\nx"), (3, c), (None, f"{b}\n{c}"), (None, c), (7, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(lines_by_hand(rows), key=str)
    assert [n for *_, n in want].count(0) < len(rows)
    for hot in (256, 1):
        monkeypatch.setattr("tessera.llm.line_dedup.HOT_KEYS", hot)
        assert sorted(map(tuple, line_dedup(docs).select("doc_id", "kept_text", "n_lines", "n_dropped").collect()), key=str) == want


# URL filter

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("b.c", "", "block"), ("b.c", "/x", "allow"), ("b.c", "/x", "block")]


def judged(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:at].translate(UPPER), rest[at:].split("?")[0].split("#")[0]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[4]) if fits else (host, path, None, "allow")


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "https://Example.ORG/es/x?q=/y#z", "http://a.example.org/en/12", "http://example.org/en/2", "http://example.org", "x://org/", "http://myorg/", "http://a.b.c?x", "http://b.c/xy", "http://b.c/x\ny", "http://éx.b.c/", "http://b.c:80/", "a://b.c/p://q.org/", "http://..b.c/", "http://example.org/es"]
    pages = spark.createDataFrame([(i, u, "taken") for i, u in enumerate(urls + urls[4:6])], "page_id long, url string, rule string")
    got = url_filter(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))
    assert got.columns == ["page_id", "url", "rule", "host", "path", "verdict"]
    assert sorted(map(tuple, got.select("page_id", "host", "path", "rule", "verdict").collect())) == [(i, *judged(u)) for i, u in enumerate(urls + urls[4:6])]


@pytest.mark.parametrize("few", [0, 100])
def test_url_filter_either_way(spark, few, monkeypatch):
    monkeypatch.setattr("tessera.llm.url_filter.MAP_SHAPES", few)
    urls = ["http://Example.ORG/en/1", "http://x.b.c/x", "http://b.c/x", "", None, "http://", "http://a.org/?", "http://org"]
    pages = spark.createDataFrame([(i, u, "taken", 1) for i, u in enumerate(urls * 2)], "page_id long, url string, _labels string, __uf_x int")
    got = url_filter(pages, spark.createDataFrame([*RULES, *RULES], "host string, path string, verdict string"))
    assert sorted(map(tuple, got.select("page_id", "host", "path", "rule", "verdict").collect())) == [(i, *judged(u)) for i, u in enumerate(urls * 2)]
    assert got.columns == [*pages.columns, "host", "path", "rule", "verdict"]


def test_url_filter_without_rules_or_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert url_filter(pages, none, default="block").select("host", "rule", "verdict").collect() == [("a.b", None, "block")]
    assert url_filter(pages.where("false"), none).count() == 0


# substring dedup


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    texts = [None, "", "  ", *passages(seed, 60), " ".join(["again"] * 70), "é\x1c語 " * 30]
    out = sub.substring_dedup(frame(spark, texts), buckets=7).withColumn("kept_text", F.sha2("kept_text", 256))
    want = sub.brute_force(list(enumerate(texts)))
    assert sorted(map(tuple, out.collect())) == want
    assert sum(w[2] for w in want) > 100


def test_substring_dedup_odd_rows(spark, odd_docs):
    out = sub.substring_dedup(odd_docs)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == odd_docs.count()
    assert rows[13].n_removed == sub.brute_force([(13, odd_docs.where("doc_id = 13").first().text)])[0][2]
    assert rows[14].kept_text.endswith("tail") and rows[14].n_removed >= 30_000 - 20
    assert rows[0].n_words == 0 and rows[0].kept_text == ""
    assert sub.substring_dedup(odd_docs.where("false")).count() == 0


def test_repeated_rows_do_not_repeat_themselves(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = frame(spark, [text]).union(frame(spark, [text])).repartition(2)
    assert [r.n_removed for r in sub.substring_dedup(docs).collect()] == [0, 0]


def test_equal_hashes_are_compared_by_words():
    word = np.array([1, 2, 3, 1, 2, 3, 9, 9, 9, 9, 9, 9])
    at = np.array([0, 3, 6, 9])
    assert sub.repeated(word, np.zeros(4, np.uint64), at, 3).tolist() == [False, True, False, True]


# near-dedup


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent):
    texts = [None, "", "one", "ONE", "two words", *passages(3, 150, most=200)]
    got = near.near_duplicates(frame(spark, texts), percent).drop("text_key")
    assert sorted(map(tuple, got.collect())) == near.brute_force(list(enumerate(texts)), percent)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(40):
        words = list(base)
        for k in range(i % 5):
            words[(i * 7 + k * 31) % 120] = f"x{i}{k}"
        texts.append(" ".join(words))
    monkeypatch.setattr(near, "BLOCK", 8)
    got = near.near_duplicates(frame(spark, texts), 85).drop("text_key")
    assert sorted(map(tuple, got.collect())) == near.brute_force(list(enumerate(texts)), 85)


def test_near_duplicates_odd_rows(spark, odd_docs):
    got = sorted(map(tuple, near.near_duplicates(odd_docs).drop("text_key").collect()))
    assert got == sorted(near.brute_force([(r.doc_id, r.text) for r in odd_docs.collect()], 80))
    assert near.near_duplicates(odd_docs.where("false")).count() == 0


def test_near_duplicates_by_rows_of_null_and_shared_ids(spark, monkeypatch):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(None, a), (None, b), (3, a), (7, b), (1, b), (5, a), (5, b), (5, b + " end"), (None, c), (None, "C" + c[1:] + " x"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = near.brute_force(rows, 80)
    got = near.near_duplicates(docs).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == sorted([w[:3] for w in want], key=str)
    key = {near_key: text for text, near_key in spark.createDataFrame([(t,) for _, t in rows], "text string").distinct().select("text", near.text_key(F.col("text"))).collect()}
    kept = sorted(((r.doc_id, key[r.text_key] or "") for r in got if r.kept), key=str)
    nulls = [x for x in kept if x[0] is None]
    assert [x for x in kept if x[0] is not None] == [(1, b), (3, a)]
    assert len(nulls) == 3 and sum(x[1][:2].lower() == "c0" for x in nulls) == 1
    # classes that share a number are told apart
    sketch = spark.createDataFrame([(i, i, 1, bytes([i]) * 16, [1]) for i in range(4)], "doc_id long, text_key long, n_shingles long, digest binary, bands array<long>")
    real = F.xxhash64
    monkeypatch.setattr(near.F, "xxhash64", lambda *c: F.lit(5).cast("long") if c == ("digest",) else real(*c))
    assert near._classes(sketch).select("node").distinct().count() == 4


def test_circulant_signature_estimates_similarity():
    r = np.random.default_rng(0)
    a = np.unique(r.integers(0, 2**63, 1000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:800], r.integers(0, 2**63, 200).astype(np.uint64)]))
    s = near.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 512)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.08


# language ID


def test_language_id(spark):
    words = {"xx": "the and of to in", "yy": "der die und das ist", "zz": "éle ôné ça où là"}
    r = np.random.default_rng(5)
    rows = [(i, " ".join(r.choice(words[k].split(), 60)), k) for i, k in enumerate(list(words) * 10)]
    docs = spark.createDataFrame([*rows, (90, None, "xx"), (91, "", None)], "doc_id long, text string, lang string")
    profiles = lang.learn_profiles(docs)
    assert set(profiles) == set(words)
    tests = spark.createDataFrame([(1, "THE of and", 0.0), (2, "und das", 0.0), (3, "12 !", 0.0), (4, None, 0.0), (5, "OÙ ça", 0.0), (5, "OÙ ça", 0.0)], "doc_id long, text string, score double")
    got = lang.identify(tests, profiles)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"]
    assert [r.lang_pred for r in got.orderBy("doc_id").collect()] == ["xx", "yy", "und", "und", "zz", "zz"]
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert [r.lang_pred for r in lang.identify(tests, {}).collect()] == ["und"] * 6
    assert lang.learn_profiles(docs.where("false")) == {}


def test_ngrams_and_distance_by_hand():
    grams, doc = lang.ngrams(["Ab, a", "", "1"])
    names = lambda g: "".join(chr(g >> s & 0x1FFFFF) for s in (42, 21, 0) if g >> s & 0x1FFFFF)
    assert sorted(map(names, grams.tolist())) == sorted(["a", "b", "a", " a", "ab", "b ", " a", "a ", " ab", "ab ", " a "])
    assert set(doc.tolist()) == {0}
    a, b, c = (lang.ngrams(["abc"])[0][k] for k in range(3))
    p = lang.Profiles({"x": [int(a), int(b)], "y": [int(c)]}, size=5)
    # a text whose only gram is b: 1 place off in x, absent (5) in y
    assert p.judge(np.array([b]), np.array([3])) == ("x", (5 - 1) / 5)


# decontamination

ITEMS = [(1, " ".join(f"q{i}" for i in range(30))), (2, "five words are here now"), (3, "too short"), (4, None), (5, " ".join(f"r{i}" for i in range(12))), (5, " ".join(f"r{i}" for i in range(12)))]


def test_decontamination(spark):
    q = ITEMS[0][1].split()
    bent = [w if i % 7 else "no" for i, w in enumerate(q)]
    half = [w if i % 2 else "no" for i, w in enumerate(q)]
    texts = [
        None, "", "clean text", "x " * 40 + " ".join(q) + " y", " ".join(bent), " ".join(half), " ".join(q[5:26]).upper() + "!", " ".join(q[:15]),
        "so: FIVE words, are here now.", "five words are not now", "too short", "r0 r1 no r3 r4 r5 r6 r7 r8 r9 no r11", "- ".join(q),
    ]
    docs = frame(spark, texts).withColumn("overlap", F.lit("taken"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = deco.decontaminate(docs, items)
    want = [(i, *deco.brute_force(t, [x for x in ITEMS if x[1]])) for i, t in enumerate(texts)]
    assert sorted(map(tuple, got.select("doc_id", "contaminated", "item_id", "overlap").collect())) == want
    assert [i for i, c, *_ in want if c] == [3, 4, 6, 8, 11, 12]
    assert deco.decontaminate(docs, items.where("false")).where("contaminated").count() == 0
    assert deco.decontaminate(docs.where("false"), items).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(deco, "BLOCK_WORDS", 10)
    docs = frame(spark, [ITEMS[0][1], ITEMS[4][1], "nothing of it"])
    got = deco.decontaminate(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert [r.item_id for r in got.orderBy("doc_id").collect()] == [1, 5, None]
    # the better of overlaps with items of different blocks, the smaller id of equal ones
    q = ITEMS[0][1].split()
    bent = " ".join(w if i % 7 else "no" for i, w in enumerate(q))
    items = [(9, bent), (4, ITEMS[0][1]), (6, ITEMS[0][1]), (2, bent + " more"), (8, ITEMS[4][1])]
    texts = [ITEMS[0][1], bent, "x", None, ITEMS[4][1]]
    got = deco.decontaminate(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "contaminated", "item_id", "overlap")
    assert sorted(map(tuple, got.collect())) == [(i, *deco.brute_force(t, items)) for i, t in enumerate(texts)]


def overlaps(texts, items):
    h, first = deco.normal_words(pa.array(texts, pa.string()))
    best: dict = {}
    for d, item, share in deco.TestSet(items).overlaps(h, first):
        best[d] = max(best.get(d, (0.0, 0)), (share, -items[item][0]))
    return [(True, -best[k][1], best[k][0]) if k in best else (False, None, 0.0) for k in range(len(texts))]


@pytest.mark.parametrize("n", range(10, 21))
def test_no_placement_of_substitutions_hides_an_overlap(n):
    words, gone = [f"q{i}" for i in range(n)], n // 5
    texts = [" ".join("no" if i in c else w for i, w in enumerate(words)) for c in map(set, combinations(range(n), gone))]
    assert set(overlaps(texts, [(7, " ".join(words))])) == {(True, 7, (n - gone) / n)}
    over = [" ".join("no" if i in c else w for i, w in enumerate(words)) for c in map(set, combinations(range(n), gone + 1))]
    assert set(overlaps(over, [(7, " ".join(words))])) == {(False, None, 0.0)}


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([1, 2, 4, 60]), st.sampled_from([7, 1 << 14]))
def test_overlaps_are_those_of_brute_force(seed, vocab, hits):
    r = np.random.default_rng(seed)
    items = [(k, " ".join(f"w{x}" for x in r.integers(0, vocab, r.integers(1, 45)))) for k in range(4)]
    texts = ["", *(" ".join(f"w{x}" for x in r.integers(0, vocab, r.integers(1, 30))) for _ in range(3))]
    for _, t in items:
        words = t.split()[r.integers(0, 12) :]
        for _ in range(len(words) // 5):
            words[r.integers(len(words))] = "X"
        texts.append(" ".join(words))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(deco, "HITS", hits)
        assert overlaps(texts, items) == [deco.brute_force(t, items) for t in texts]


# quality


def test_ordinal_regression(spark, odd_docs):
    r = np.random.default_rng(2)
    neutral = [f"n{i}" for i in range(60)]
    rows = []
    for i in range(900):
        g = i % 3
        words = list(r.choice(neutral, 40)) + list(r.choice([["vile", "nasty"], ["meh##", "dull##"], ["fine", "good"]][g], 4))
        rows.append((i, " ".join(words), g))
    rated = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    docs, grades = rated.select("doc_id", "text"), rated.select("doc_id", "grade")
    model = quality.learn(docs, grades.where("doc_id < 600"), 3)
    assert model.thresholds[0] < model.thresholds[1]
    got = quality.rate(rated.where("doc_id >= 600"), model).collect()
    assert np.mean([round(x.expected_grade) == x.grade for x in got]) > 0.95
    assert np.mean([x.keep == (x.grade == 2) for x in got]) > 0.95
    odd = quality.rate(odd_docs, model)
    assert odd.count() == odd_docs.count() and odd.where("NOT expected_grade BETWEEN 0 AND 2").count() == 0
    assert quality.rate(odd_docs.where("false"), model).count() == 0
    assert quality.learn(docs, grades.where("false"), 3).weights.any() == np.False_


def test_features_have_one_length():
    bucket, value, starts = quality.features(pa.array(["a b a", "", "!!"]))
    assert np.allclose([np.sqrt((value[a:b] ** 2).sum()) for a, b in zip(starts[:-1], starts[1:])], [quality.NORM, 0, quality.NORM])

"""Nulls, repeated ids, clashing names and empty tables: the defined result of each operator."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tickloom.llm import op1_license_scan, op2_line_dedup, op4_url_filter, op6_minhash_dedup, op7_quality_rules, op8_toxicity, op9_decontamination, tables

SF = "/root/testdata/sf0.001"


def rows(spark, data, schema="doc_id long, text string, source string"):
    return spark.createDataFrame(data, schema)


MENU = [(100 + i, f"menu\nbody {i}", f"s{i}") for i in range(12)]


def test_lines_of_a_repeated_id_go_by_row(spark):
    docs = rows(spark, [*MENU, (5, "menu\nbody 5", "s5"), (5, "other text\nmore", "s5")])
    got = sorted(r.text for r in op2_line_dedup.line_dedup(docs).where("doc_id = 5").collect())
    assert got == ["menu\nbody 5", "other text\nmore"]


def test_lines_of_null_ids_lose_no_unique_text(spark):
    docs = rows(spark, [*MENU, (None, "unique a\nmenu", "s1"), (None, "menu\nunique b", None), (None, "unique a\nunique c", "s2")])
    got = sorted(r.text for r in op2_line_dedup.line_dedup(docs).where("doc_id is null").collect())
    assert got == ["unique a", "unique a\nunique c", "unique b"]
    only = rows(spark, [(None, f"menu\nbody {i}", f"s{i}") for i in range(12)])
    left = [r.text for r in op2_line_dedup.line_dedup(only).collect()]
    assert sum("menu" in t for t in left) == 1 and all("body" in t for t in left)


def test_lines_of_equal_rows_are_treated_alike(spark):
    docs = rows(spark, [(1, "menu\nbody", "s0")] * 3 + MENU)
    got = [r.text for r in op2_line_dedup.line_dedup(docs).where("doc_id = 1").collect()]
    assert got == ["menu\nbody"] * 3


def test_line_columns_with_clashing_names_pass(spark):
    names = ["_drop", "_id", "_row", "_doc", "_split", "_cuts", "_pos", "_k1", "_first", "a.b"]
    docs = rows(spark, MENU)
    for n in names:
        docs = docs.withColumn(n, F.lit(n))
    out = op2_line_dedup.line_dedup(docs.withColumn("_n_lines", F.lit("old")))
    got = out.where("doc_id = 101").first()
    assert got.text == "body 1" and [got[n] for n in names] == names and got._n_lines == 2 and out.count() == 12


def test_line_dedup_of_one_very_long_text(spark):
    docs = rows(spark, [*MENU, (1, "\n".join(["menu"] * 50_000 + ["end"]), "x")])
    got = op2_line_dedup.line_dedup(docs).where("doc_id = 1").first()
    assert got.text == "menu\nend" and got._n_removed == 49_999


ITEM = " ".join(f"q{i}" for i in range(30))


def test_items_without_an_id_count_as_hits(spark):
    docs = spark.createDataFrame([(1, ITEM), (2, "clean words only"), (None, ITEM)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, ITEM), (None, "short one"), (4, "one")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r._n_hit, tuple(r._items)) for r in op9_decontamination.decontaminate(docs, bench).collect())
    assert got == [(0, 30, ()), (1, 30, ()), (2, 0, ())]


def test_benchmark_columns_and_rows_that_repeat(spark):
    docs = spark.createDataFrame([(1, f"a {ITEM} b", 0, 0)] * 2, "doc_id long, text string, fp int, key int")
    bench = spark.createDataFrame([(7, ITEM, 1), (7, ITEM, 1), (8, ITEM, 2)], "item_id long, text string, matched int")
    got = [(r._n_words, r._n_hit, r._items) for r in op9_decontamination.decontaminate(docs, bench).collect()]
    assert got == [(32, 30, ["7", "8"])] * 2


@pytest.mark.parametrize("most", [2, 6, 23])
def test_hits_do_not_depend_on_the_bit_sets(spark, monkeypatch, most):
    """Short items of every length, and long ones, with bit sets that let nearly everything pass."""
    monkeypatch.setattr(op9_decontamination, "MAX_BITS", max(7, most))
    monkeypatch.setattr(op9_decontamination, "LEAST_BITS", 7)
    monkeypatch.setattr(op9_decontamination, "BROADCAST_ROWS", 0 if most == 2 else 200_000)
    items = {n: " ".join(f"i{n}w{k}" for k in range(n)) for n in range(1, 41)}
    docs = {n: f"x y {t} z" for n, t in items.items()} | {100 + n: t.rsplit(" ", 1)[0] for n, t in items.items() if 1 < n <= 13}
    got = {r.doc_id: (r._n_hit, r._items) for r in op9_decontamination.decontaminate(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert got == {n: (n, [str(n)]) for n in items} | {n: (0, []) for n in docs if n > 100}


def test_stored_tables_are_released(spark, tmp_path):
    df = tables.stored(spark.range(3).toDF("x"))
    assert df.count() == 3 and tables.release(spark) >= 1 and tables.release(spark) == 0


def near(spark, data):
    docs = spark.createDataFrame(data, "doc_id long, text string")
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in op6_minhash_dedup.near_duplicates(docs).collect()), key=str)


def test_near_copies_of_a_repeated_id(spark):
    """Id 1 has two texts; document 3 is the second one and a word."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    got = near(spark, [(1, a), (1, b), (3, b + " more"), (4, a)])
    assert got == [(1, 56, 1, True), (1, 56, 1, True), (3, 57, 1, False), (4, 56, 1, False)]


def test_near_copies_without_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    assert near(spark, [(None, text), (7, text + " x"), (None, "other words"), (None, ""), (8, None)]) == sorted(
        [(None, 56, 7, False), (7, 57, 7, True), (None, 1, None, True), (None, 0, None, True), (8, 0, 8, True)], key=str
    )


def test_distinct_documents_by_row(spark):
    text = " ".join(f"w{i}" for i in range(60))
    data = [(1, text, "a"), (1, text, "a"), (None, text, "b"), (None, text, "b"), (None, "x y", "c"), (None, "x y", "d"), (5, "", "e")]
    docs = spark.createDataFrame(data, "doc_id long, text string, row string").withColumn("set_id", F.lit("s")).withColumn("doc", F.lit(1))
    out = op6_minhash_dedup.distinct_documents(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, text), (None, "x y"), (5, "")], key=str)


def test_contaminated_documents_go_whatever_their_ids(spark):
    docs = spark.createDataFrame([(None, ITEM, 1), (2, ITEM, 1), (2, "clean words", 1), (None, "clean words", 1), (None, None, 1)], "doc_id long, text string, key int")
    bench = spark.createDataFrame([(None, ITEM)], "item_id long, text string")
    out = op9_decontamination.clean_documents(docs, bench)
    assert out.columns == docs.columns and sorted(str(r.text) for r in out.collect()) == ["None", "clean words", "clean words"]


def test_ftrl_equals_a_scalar_version():
    """One number at a time, features in dictionaries."""
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 40, 12)) for _ in range(120)]
    labels = [int(3 in r) for r in rows]
    z, n, order = {}, {}, np.random.Generator(np.random.PCG64(3))
    seen = {s: sum(s in r for r in rows) for s in range(40)}

    def weight(k, l1):
        v = z.get(k, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((op8_toxicity.BETA + math.sqrt(n.get(k, 0.0))) / op8_toxicity.ALPHA + op8_toxicity.L2)

    for _ in range(op8_toxicity.EPOCHS):
        for i in order.permutation(len(rows)):
            keys = [int(s) for s in rows[i] if seen[s] >= op8_toxicity.LEAST_ROWS] + ["bias"]
            w = {k: weight(k, 0.0 if k == "bias" else op8_toxicity.L1) for k in keys}
            g = (1 / (1 + math.exp(-sum(w.values()))) - labels[i]) * (op8_toxicity.POSITIVE if labels[i] else 1.0)
            for k in keys:
                sigma = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / op8_toxicity.ALPHA
                z[k] = z.get(k, 0.0) + g - sigma * w[k]
                n[k] = n.get(k, 0.0) + g * g
    want = {s: weight(s, op8_toxicity.L1) for s in range(40)}
    slots, weights, bias = op8_toxicity.fit(rows, labels)
    assert dict(zip(slots.tolist(), np.round(weights, 9), strict=True)) == {s: round(w, 9) for s, w in want.items() if w}
    assert abs(bias - weight("bias", 0.0)) < 1e-9 and 3 in want and want[3] > 0


def test_toxicity_of_repeated_training_ids_and_clashes(spark):
    """Copies of a labelled id count once, and the bound on features holds."""
    data = [(i, f"kind words here {'vile thing' if i % 3 == 0 else 'nice thing'} {i}", i) for i in range(200)]
    docs = spark.createDataFrame(data, "doc_id long, text string, label int").withColumn("h", F.lit(1)).withColumn("score", F.lit(2.0))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(None, 1), (7, 5)], "doc_id long, toxic int")
    once, twice = (op8_toxicity.train(d, labels, "doc_id", "text", "toxic") for d in (docs, docs.unionAll(docs).unionAll(docs)))
    assert (once[0] == twice[0]).all() and np.allclose(once[1], twice[1]) and len(once[0])
    out = op8_toxicity.toxicity(docs.unionAll(spark.createDataFrame([(None, "vile thing " * 50_000, 0, 1, 0.0)], docs.schema)), labels)
    got = {r.doc_id: r.score for r in out.collect()}
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and len(got) == 201 and got[None] > got[1]


def test_toxicity_features_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(op8_toxicity, "TRAIN_SLOTS", 40)
    taken = []
    monkeypatch.setattr(op8_toxicity, "fit", lambda rows, labels: taken.append(sum(map(len, rows))) or (np.zeros(0, np.int64), np.zeros(0), 0.0))
    docs = spark.createDataFrame([(i, f"a{i} b{i} c{i}") for i in range(60)], "doc_id long, text string")
    op8_toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"), "doc_id", "text", "toxic")
    assert 34 < taken[0] <= 40


def brute_rules(labelled):
    """Every combination of tokens, by counting."""
    n = len(labelled)
    tokens = sorted({t for ts, _ in labelled for t in ts})
    extent = {t: frozenset(i for i, (ts, _) in enumerate(labelled) if t in ts) for t in tokens}
    alone = [t for t in tokens if len(extent[t]) >= op4_url_filter.MIN_SUPPORT * n and not any(extent[u] == extent[t] and u < t for u in tokens)]
    rules = set()
    for k in range(1, len(alone) + 1):
        for need in itertools.combinations(alone, k):
            have = frozenset.intersection(*[extent[t] for t in need])
            blocked = sum(labelled[i][1] == "block" for i in have)
            if have and blocked >= op4_url_filter.MIN_SUPPORT * n and blocked / len(have) >= op4_url_filter.MIN_CONFIDENCE:
                rules.add(need)
    return {r for r in rules if not any(tuple(x for x in r if x != t) in rules for t in r)}


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(300):
        ts = {"s:http", f"h:{rng.choice('abc')}", f"p0:{rng.choice('xyz')}"} | ({"q:k", "q:l"} if rng.random() < 0.3 else set())
        bad = ("h:a" in ts and "p0:x" in ts) or "q:k" in ts and "h:b" in ts
        rows.append((sorted(ts), "block" if bad or rng.random() < 0.02 else "allow"))
    df = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(rows)], "row long, tokens array<string>, verdict string")
    got = {tuple(r.need) for r in op4_url_filter.mine(df).collect()}
    assert got == brute_rules(rows) and ("h:a", "p0:x") in got and ("h:b", "q:k") in got


def test_url_tokens_that_all_share_are_mined_in_bounded_time(spark):
    """Thirty tokens in every URL, and thirty that differ a little: 2 ** 60 combinations without the bound."""
    rng = random.Random(1)
    same = "&".join(f"k{i}=1" for i in range(30))
    pages = []
    for i in range(200):
        own = "&".join(f"m{j}=1" for j in range(30) if rng.random() < 0.95)
        pages.append((i, f"http://x.com/{'de' if i % 2 else 'fr'}/p?{same}&{own}{'&bad=1' if i % 2 else ''}"))
    pages += [(1000, f"http://y.net/p?{same}&bad=1"), (1001, f"http://y.net/p?{same}"), (None, None), (1000, f"http://y.net/p?{same}&bad=1")]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("rule", F.lit("x")).withColumn("row", F.lit(1)).withColumn("need", F.lit(0))
    out = op4_url_filter.url_filter(df)
    got = sorted(((r.page_id, r.verdict) for r in out.where("page_id >= 1000 or page_id is null").collect()), key=str)
    assert got == [(1000, "block"), (1000, "block"), (1001, "allow"), (None, "allow")] and out.count() == 204


def test_rules_of_urls_with_many_tokens(spark):
    """A pair of tokens that says nothing one by one, in URLs with twenty that say more; and every combination by grow."""
    kinds = [("de", "a=1&b=1")] * 100 + [("de", "c=1")] * 100 + [("fr", "a=1")] * 100 + [("fr", "b=1")] * 100
    pages = []
    for i, (path, own) in enumerate(kinds):
        pages.append((i, f"http://x.com/{path}/p?{own}&" + "&".join(f"n{j}=1" for j in range(20) if i != 200 + 10 * j)))
    pages += [(1000, "http://y.net/p?a=1&b=1"), (1001, "http://y.net/p?a=1"), (1002, "http://y.net/p?b=1&c="), (1003, "http://y.net/p?b=1&n1=1")]
    out = op4_url_filter.url_filter(spark.createDataFrame(pages, "page_id long, url string"))
    assert {r.page_id: r.verdict for r in out.where("page_id >= 1000").collect()} == {1000: "block", 1001: "allow", 1002: "block", 1003: "allow"}

    rng = np.random.default_rng(3)
    for _ in range(60):
        has = (rng.random((rng.integers(5, 60), 6)) < rng.uniform(0.3, 0.9)).astype(np.uint8)
        a, b = rng.integers(0, 4, (2, len(has)))
        least = max(1, rng.uniform(0.005, 0.1) * (a.sum() + b.sum()))
        if b.sum() >= 0.9 * (a.sum() + b.sum()):
            continue
        every = [set(s) for k in range(1, 7) for s in itertools.combinations(range(6), k)]
        on = [has[:, sorted(s)].all(axis=1) for s in every]
        rules = [s for s, r in zip(every, on, strict=True) if b[r].sum() >= least and b[r].sum() / (a[r].sum() + b[r].sum()) >= op4_url_filter.MIN_CONFIDENCE]
        got = [set(s) for s in op4_url_filter.grow(has, a, b, least)]
        assert all(g in rules for g in got) and all(any(g <= r for g in got) for r in rules)


def brute_url(url):
    """Host, path, rule and its verdict."""
    host = path = ""
    if url is not None and "://" in url:
        rest = re.split("[?#]", url.split("://", 1)[1], maxsplit=1)[0]
        host, slash, path = rest.partition("/")
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path
    fits = [(h + p, v) for v, h, p in op4_url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda f: len(f[0])) if fits else (None, None))


def test_url_query_equals_brute_force(spark):
    got = {r.page_id: r for r in op4_url_filter.query(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        host, path, rule, verdict = brute_url(p.url)
        r = got[p.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict), p.url


def brute_base(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    tri = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words) >= 50 and 100 * len(covered) <= 50 * len(words)


def brute_kept(texts, good):
    """Texts that pass the base rules and whose ratios, whole and by chunk, lie within the limits of the good ones."""
    ratio = lambda raw: len(zstandard.ZstdCompressor(level=3, write_checksum=False).compress(raw)) / len(raw)
    raw = {d: (t or "").encode() for d, t in texts.items()}
    base = {d for d, t in texts.items() if brute_base(t or "")}
    found = {}
    for d in base & good:
        if len(raw[d]) >= 256:
            found.setdefault(math.floor(2 * math.log2(len(raw[d]))), []).append(ratio(raw[d]))
    limits = {}
    for k, v in found.items():
        if len(v) >= 40:
            a, m, b = np.quantile(v, [0.005, 0.5, 0.995])
            limits[k] = (a - 0.5 * (m - a), b + 0.5 * (b - m))

    def fits(piece):
        bands = [b for b in op7_quality_rules.WHOLE_BANDS if b[0] <= len(piece)]
        low, high = limits.get(math.floor(2 * math.log2(len(piece))), (0, 1))
        return not bands or max(low, bands[-1][1]) <= ratio(piece) <= min(high, bands[-1][2])

    kept = set()
    for d in base:
        parts = [raw[d][i : i + 4096] for i in range(0, len(raw[d]), 4096)] if len(raw[d]) > 4096 else []
        bad = sum(len(p) for p in parts if len(p) >= 1024 and not fits(p))
        if fits(raw[d]) and bad <= 0.5 * len(raw[d]):
            kept.add(d)
    return base, kept


def test_quality_verdicts_equal_brute_force(spark):
    """The compression limits decide: texts labelled bad that pass the base rules go, those labelled good stay."""
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    base, kept = brute_kept(texts, {d for d, q in labels.items() if q == 1})
    got = {r.doc_id: (r.base_failed, r.kept) for r in op7_quality_rules.query(spark, sf).collect()}
    assert got == {d: (d not in base, d in kept) for d in texts}
    gone = base - kept
    assert len([d for d in gone if labels.get(d) == 0]) >= 5 and len([d for d in gone if labels.get(d) == 1]) <= 0.01 * len(base)


def test_quality_of_texts_with_one_bad_half(spark):
    rng = random.Random(2)
    prose = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(1700))[:8192]
    texts = [prose, prose + " " + "x" * 8192, prose[:4096] + " " + "x" * 3000, prose + prose[:2000]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("i", F.lit(1))
    assert [r.kept for r in op7_quality_rules.quality_rules(docs).orderBy("doc_id").collect()] == [True, False, False, True]
    assert sorted(r.doc_id for r in op7_quality_rules.keep_good(docs).collect()) == [0, 3]
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert op7_quality_rules.fit_limits(docs, no_labels) == {}


def test_quality_limits_are_fitted_on_all_labelled_texts(spark):
    """More labelled texts than were once fitted on (20,000): the limits are the quantiles of all of them, ties and repeats too."""
    rng = random.Random(11)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(4000)]
    texts = [" ".join(rng.choices(words[: rng.choice([150, 4000])], k=rng.randint(56, 75))) for _ in range(24_000)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0]), (5, texts[7])], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 12 > 0)) for i in range(24_000)] + [(None, 1), (5, 1)], "doc_id long, quality int").repartition(4)
    compress = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
    found = {}
    for t in [t for i, t in enumerate(texts) if i % 12] + [texts[7]]:
        raw = t.encode()
        if brute_base(t) and len(raw) >= 256:
            found.setdefault(math.floor(2 * math.log2(len(raw))), []).append(len(compress(raw)) / len(raw))
    assert sum(map(len, found.values())) > 20_000
    want = {}
    for k, v in found.items():
        if len(v) >= 40:
            a, m, b = np.quantile(v, [0.005, 0.5, 0.995])
            want[k] = (a - 0.5 * (m - a), b + 0.5 * (b - m))
    got = op7_quality_rules.fit_limits(docs, labels)
    assert got.keys() == want.keys() and want and all(np.allclose(got[k], want[k], rtol=0, atol=1e-12) for k in want)


def brute_licenses(text):
    """Every window of every template's group, without bands."""
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    sets = {k: set(grams(words(t))) for k, t in op1_license_scan.TEMPLATES.items()}
    order, longest = sorted(sets, key=lambda k: -len(sets[k])), {}
    top = 0
    for k in order:
        top = longest[k] = top if top and len(sets[k]) * op1_license_scan.SPREAD >= top else len(sets[k])
    own, found = grams(words(text)), {}
    for k, s in sets.items():
        step = max(1, longest[k] // 2)
        n = sum(len(s & set(own[at : at + 3 * longest[k]])) >= 0.8 * len(s) for at in range(0, len(own), step))
        if n:
            found[k] = n
    return found


def test_licenses_equal_brute_force(spark):
    """Whole texts, and templates with words lost, exchanged and inserted at any place."""
    rng = random.Random(6)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [None, ""]
    for t in op1_license_scan.TEMPLATES.values():
        for _ in range(4):
            w = t.split()
            for _ in range(rng.randint(0, max(1, len(w) // 20))):
                w[rng.randrange(len(w))] = rng.choice(["", "other"])
            at = rng.randrange(len(w))
            w[at:at] = [f"in{i}" for i in range(rng.randint(0, len(w)))]
            texts.append(" ".join([f"a{i}" for i in range(rng.randint(0, 300))] + w + [f"z{i}" for i in range(rng.randint(0, 200))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("name", F.lit(1)).withColumn("licenses", F.lit(1))
    got = {r.doc_id: {x.name: x.windows for x in r.licenses} for r in op1_license_scan.license_scan(docs).collect()}
    assert got == {i: brute_licenses(t) for i, t in enumerate(texts)}
    assert sum(map(bool, got.values())) > 40


def test_license_templates_without_a_shingle_are_an_error(spark):
    with pytest.raises(ValueError, match="short"):
        op1_license_scan.license_scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"), {"short": "only four words here"})

"""The pipeline against five stages in plain Python, on all of the smallest scale and on an odd table."""

import hashlib
import random
import re

import tiktoken

import corpus_pipeline
from test_edge_cases import brute_base, brute_kept
from test_operators import brute_components
from tickloom.llm import op10_byte_bpe

SF = "/root/testdata/sf0.001"
BLANKS = " \t\r\x0b\x0c"


def brute_lines(docs):
    """Lines on 10 sites, or 3 if they have 50 words, stay where they are first."""
    sites, first = {}, {}
    for d, text, source in docs:
        for pos, line in enumerate(text.split("\n")):
            key = line.strip(BLANKS)
            if key:
                sites.setdefault(key, set()).add(source)
                first[key] = min(first.get(key, (d, pos)), (d, pos))
    out = []
    for d, text, _ in docs:
        left = []
        for pos, line in enumerate(text.split("\n")):
            key = line.strip(BLANKS)
            need = 3 if len(re.findall("[^ \t\r\x0b\x0c]+", key)) >= 50 else 10
            if not key or len(sites[key]) < need or first[key] == (d, pos):
                left.append(line)
        changed = "\n".join(left)
        if changed == text or re.search("[^\x20\x09-\x0d]", changed):
            out.append((d, changed))
    return out


def brute_contaminated(text, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    own, hit = words(text), set()
    for item in items:
        w = words(item)
        k = min(13, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(own) - k + 1):
            if windows and tuple(own[i : i + k]) in windows:
                hit.update(range(i, i + k))
    return bool(hit) and 20 * len(hit) >= len(own)


def brute_pipeline(rows, good, items):
    texts = {d: t for d, t, _ in rows}
    _, kept = brute_kept(texts, good)
    docs = brute_lines([r for r in rows if r[0] in kept])
    comps = brute_components(dict(docs))
    docs = [(d, t) for d, t in docs if comps[d][1] == d]
    docs = [(d, t) for d, t in docs if not brute_contaminated(t, items)]
    path, pattern = op10_byte_bpe.public_vocabulary()
    ranks = {t: i for i, t in enumerate(op10_byte_bpe.read_ranks(path))}
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    out = {}
    for d, t in docs:
        ids = known.encode_ordinary(t)
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        out[d] = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    return out


def test_pipeline_equals_brute_force(spark):
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*c).collect()]
    rows = read("documents", "doc_id", "text", "source")
    good = {d for d, q in read("labels", "doc_id", "quality") if q == 1}
    want = brute_pipeline(rows, good, [t for (t,) in read("benchmark", "text")])
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(want) < len(rows)


def write_tables(spark, folder, docs, bench, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, row string, _drop int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def prose(i, n=80):
    return " ".join(hashlib.md5(f"{i}/{k}".encode()).hexdigest()[:6].translate(str.maketrans("0123456789", "aeioulnrst")) for k in range(n))


def test_pipeline_of_an_odd_table(spark, tmp_path):
    """Null and repeated ids, nulls, empties, a contaminated document without an id, and columns with other names."""
    item = prose("item", 60)
    texts = [(1, prose(1)), (1, prose(1)), (None, prose(1)), (None, prose(2)), (None, prose(2)), (1, prose(3)), (4, None), (None, ""), (5, "few words"), (None, item + " " + prose(6)), (7, item + " " + prose(7)), (8, prose(8))]
    docs = [(d, t, "en", f"s{i}", len(t or ""), "x", 1) for i, (d, t) in enumerate(texts)]
    folder = str(tmp_path / "odd")
    write_tables(spark, folder, docs, [(None, item)], [(8, 1, 0), (None, 1, 0)])
    got = sorted((str(r.doc_id), r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert brute_base(prose(1)) and got == sorted([("1", sha(prose(1))), ("1", sha(prose(3))), ("None", sha(prose(2))), ("8", sha(prose(8)))])


def test_pipeline_of_empty_tables(spark, tmp_path):
    write_tables(spark, str(tmp_path / "empty"), [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).collect() == []


def test_quality_stage_is_fitted_on_all_labelled_texts(spark, tmp_path):
    """40 of 24,000 labelled documents have the length that decides about a repetitive one: any smaller share of the labels leaves no limit for it."""
    rng = random.Random(4)

    def words(k):
        some = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(k)]
        return " ".join(rng.choices(some, k=400))[:1700]

    docs = [(i, words(5000)) for i in range(40)] + [(100_000, words(100)), (None, words(5000))]
    folder = str(tmp_path / "many")
    write_tables(spark, folder, [(d, t, "en", "s", len(t), "x", 1) for d, t in docs], [(1, "item")], [(i, 1, 0) for i in range(24_000)])
    table = spark.read.parquet(f"{folder}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    _, want = brute_kept(dict(docs), set(range(24_000)))
    got = {r.doc_id for r in corpus_pipeline.quality(spark, table, folder).collect()}
    assert got == want == {*range(40), None}

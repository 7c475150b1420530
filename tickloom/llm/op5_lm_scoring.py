"""LM scoring: the difference of cross-entropies under a target and a background bigram model.

Both models have the same form and count every word and every word pair of all documents, so they
grow with the corpus.  What a pair doesn't take backs off to the unigram model; each model sums to
one.  The background is every document, the target the documents whose label is 1.  A document isn't
scored by itself: its own counts are taken off those of a model that has seen it, so a text that
occurs once is new to both models, and one that occurs twice isn't.

The counts are never in one place.  The rows of a task are cut into chunks; a chunk sends each of
its distinct keys (words and pairs) once, with its own counts, to the partition of the key, which
adds up over all chunks and answers each of them.  So a key that every document has costs one
entry a chunk.  A second pass sends each chunk's words, as indexes, to where the answers meet them;
both passes have to see the same rows in the same tasks, as from stored tables.

score = (loss under the background - loss under the target) / tokens, in nats: higher means more
like the target.

Defined cases: texts without words (null, empty) have 0 tokens and score 0; unlabelled rows and
labels other than 1 are background only; a repeated row counts as often as it occurs; other
columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.tables import stored, table
from tickloom.llm.textarrays import SpanHasher, Words, lower_table, mix64, separator_table, slices, text_buffer

#: Weight of the pair estimate, and what is added to every unigram count.
LAMBDA, ADD = 0.6, 0.5
#: Ids of the target that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Words of a chunk, unless one slice has more.
CHUNK_WORDS = 1_000_000
#: The last bit of a key says what it counts.
WORD, PAIR = 0, 1
OWN = "chunk long, data array<binary>"
ASKED = "chunk long, part int, data array<binary>"
ANSWER = ASKED + ", words long, b long, t long"


def _hashed(batch_column):
    """(row range, word hashes, bounds) of slices of a batch."""
    lower, sep, hasher = lower_table(), separator_table("alnum"), SpanHasher()
    data, offsets = text_buffer(batch_column)
    for a, b in slices(offsets):
        part, off = lower[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        words = Words(part, off, sep)
        yield a, b, hasher(part, words.starts, words.ends), words.bounds


def _pack(*arrays) -> list[bytes]:
    """Compressed, lowest bytes of all numbers first."""
    compress = zstandard.ZstdCompressor(level=1).compress
    return [compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()) for a in arrays]


def _unpack(blobs, *kinds):
    raw = [np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8) for b in blobs]
    return [np.ascontiguousarray(r.reshape(np.dtype(k).itemsize, -1).T).view(k).ravel() for r, k in zip(raw, kinds, strict=True)]


def _messages(rows, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "array<binary>": pa.list_(pa.binary())}
    fields = [c.split() for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _kind(h: np.ndarray, kind: int) -> np.ndarray:
    return (h & ~np.uint64(1)) | np.uint64(kind)


class Chunk:
    """Distinct keys of some rows, by partition and key, and where the rows have them."""

    def __init__(self, vocab: np.ndarray, ids: np.ndarray, n: np.ndarray, parts: int):
        """vocab: distinct word hashes; ids: the words of all rows as indexes into it; n: words of each row."""
        self.vocab, self.ids, self.n = vocab, ids, n
        self.row = np.repeat(np.arange(len(n)), n)
        self.second = np.flatnonzero(self.row[1:] == self.row[:-1]) + 1
        first = ids[self.second - 1]
        pairs, self.pair_ids = np.unique(mix64(vocab[first] * np.uint64(0x9FB21C651E98DF25) + vocab[ids[self.second]]), return_inverse=True)
        self.keys = np.concatenate([_kind(vocab, WORD), _kind(pairs, PAIR)])
        part = ((self.keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        self.order = np.argsort(self.keys, kind="stable")
        self.cuts = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])

    def counts(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own counts of the keys, a row of the chunk counting weight, and of these the words that end a row."""
        v, size, w = len(self.vocab), len(self.keys), weight[self.row].astype(np.float64)
        ends = np.cumsum(self.n)[self.n > 0] - 1
        all_ = np.concatenate([np.bincount(self.ids, w, v), np.bincount(self.pair_ids, w[self.second], size - v)])
        return all_.astype(np.int64), np.bincount(self.ids[ends], w[ends], size).astype(np.int64)

    def own(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often a word's row has it, how often it has it with a word after it, and how often a pair's row has the pair."""
        words, pairs = (np.unique(row * (len(self.keys) + 1) + ids, return_inverse=True, return_counts=True)[1:] for row, ids in ((self.row, self.ids), (self.row[self.second], self.pair_ids)))
        word = words[1][words[0]].astype(np.float64)
        ends = np.cumsum(self.n) - 1
        return word, word - (self.ids == self.ids[ends[self.row]]), pairs[1][pairs[0]].astype(np.float64)

    def losses(self, counts: np.ndarray, last: np.ndarray, total: int, words: int, mine: np.ndarray, own) -> np.ndarray:
        """Losses of the rows, from the counts of all chunks; mine: rows whose own counts are among them."""
        v, at, less = len(self.vocab), self.second, mine[self.row].astype(np.float64)
        uni = counts[:v].astype(np.float64)[self.ids] - own[0] * less
        kept = (counts - last)[:v].astype(np.float64)[self.ids] - own[1] * less
        pair = counts[v:].astype(np.float64)[self.pair_ids] - own[2] * less[at]
        q = (uni + ADD) / (total - (self.n * mine)[self.row] + ADD * (words + 1))
        some = np.maximum(uni[at - 1], 1)
        q[at] = LAMBDA * pair / some + (1 - LAMBDA * kept[at - 1] / some) * q[at]
        return -np.bincount(self.row, np.log(q), len(self.n))


def _chunks(batches):
    """(number, ids, target flags, words of each row, word hashes) of a task's chunks."""
    chunk, size, held = TaskContext.get().partitionId() << 32, 0, ([], [], [], [])
    for batch in batches:
        ids, flags = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for a, b, h, bounds in _hashed(batch.column(1)):
            for x, y in zip(held, (ids[a:b], flags[a:b], [np.diff(bounds)], [h]), strict=True):
                x.extend(y)
            size += len(h)
            if size >= CHUNK_WORDS:
                yield chunk, held[0], np.asarray(held[1], bool), np.concatenate(held[2]), np.concatenate(held[3])
                chunk, size, held = chunk + 1, 0, ([], [], [], [])
    if held[0]:
        yield chunk, held[0], np.asarray(held[1], bool), np.concatenate(held[2]), np.concatenate(held[3])


def _ask(parts: int):
    """Each chunk's keys and counts, by partition."""

    def run(batches):
        for chunk, _, flags, n, hashes in _chunks(batches):
            own = Chunk(*np.unique(hashes, return_inverse=True), n, parts)
            keys = own.keys[own.order]
            counts = [c[own.order] for w in (np.ones(len(n)), flags) for c in own.counts(w)]
            rows = [(chunk, i, _pack(np.diff(keys[x:y], prepend=np.uint64(0)), *(c[x:y] for c in counts))) for i, (x, y) in enumerate(zip(own.cuts[:-1], own.cuts[1:], strict=True)) if y > x]
            yield _messages(rows, ASKED)

    return run


def _own(batches):
    """Each chunk's ids and words."""
    for chunk, ids, flags, n, hashes in _chunks(batches):
        vocab, at, often = np.unique(hashes, return_inverse=True, return_counts=True)
        # frequent words get small indexes, which compress better
        rank = np.argsort(-often, kind="stable")
        place = np.empty_like(rank)
        place[rank] = np.arange(len(rank))
        valid = np.asarray([i is not None for i in ids], bool)
        data = _pack(np.asarray([0 if i is None else i for i in ids], np.int64), valid, flags, n.astype(np.int64), vocab[rank], place[at].astype(np.int32))
        yield _messages([(chunk, data)], OWN)


def _answer(asked: pa.Table) -> pa.Table:
    """Counts of a partition's keys over all chunks, sent back in the order asked."""
    data = [_unpack(d, np.uint64, *[np.int64] * 4) for d in asked.column("data").to_pylist()]
    keys, at = np.unique(np.concatenate([np.cumsum(d[0]) for d in data]), return_inverse=True)
    counts = [np.bincount(at, np.concatenate([d[i] for d in data]), len(keys)).astype(np.int64) for i in (1, 2, 3, 4)]
    word = (keys & np.uint64(1)) == WORD
    said, end, out = (int(word.sum()), int(counts[0][word].sum()), int(counts[2][word].sum())), 0, []
    for chunk, part, d in zip(asked.column("chunk").to_pylist(), asked.column("part").to_pylist(), data, strict=True):
        mine, end = at[end : end + len(d[0])], end + len(d[0])
        out.append((chunk, part, _pack(*(c[mine] for c in counts)), *said))
        said = (0, 0, 0)
    return pa.Table.from_batches([_messages(out, ANSWER)])


def lm_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, n_tokens, background_loss, target_loss, score) of each row."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    good = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct().withColumn("_t", F.lit(True))
    few = good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(good) if few else good, F.col(id_col) == F.col("_id"), "left")
    texts = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce("_t", F.lit(False)).alias("t"))
    # both passes have to cut the same chunks, which a join by shuffle doesn't promise
    texts = texts if few else stored(texts, "texts")
    asked = texts.mapInArrow(_ask(parts), ASKED)
    answers = stored(asked.groupBy("part").applyInArrow(_answer, ANSWER), "counts")
    words, n_b, n_t = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "b", "t")]).first()

    def score(own: pa.Table, met: pa.Table) -> pa.Table:
        (data,) = own.column("data").to_pylist()
        ids, valid, flags, n, vocab, at = _unpack(data, np.int64, bool, bool, np.int64, np.uint64, np.int32)
        chunk = Chunk(vocab, at, n, parts)
        told = dict(zip(met.column("part").to_pylist(), met.column("data").to_pylist(), strict=True))
        told = [_unpack(told[part], *[np.int64] * 4) for part in sorted(told)]
        counts = np.zeros((4, len(chunk.keys)), np.int64)
        for i in range(4) if told else ():
            counts[i, chunk.order] = np.concatenate([x[i] for x in told])
        mine = chunk.own() if len(at) else None
        per = [chunk.losses(counts[i], counts[i + 1], total, words, seen, mine) / np.maximum(n, 1) if mine else np.zeros(len(n)) for i, total, seen in ((0, n_b, np.ones(len(n), bool)), (2, n_t, flags))]
        return pa.table({id_col: pa.array(ids, pa.int64(), mask=~valid), "n_tokens": n, "background_loss": per[0], "target_loss": per[1], "score": per[0] - per[1]})

    ddl = f"`{id_col}` long, n_tokens long, background_loss double, target_loss double, score double"
    own = texts.mapInArrow(_own, OWN)
    return own.groupBy("chunk").cogroup(answers.select("chunk", "part", "data").groupBy("chunk")).applyInArrow(score, ddl)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_tokens", *[(F.round(c, 6) + 0.0).alias(c) for c in ("background_loss", "target_loss", "score")])


_SEPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
ORACLE = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SEPS}'), lambda x: x <> '') AS w,
  doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good FROM documents),
t AS (SELECT doc_id, good, p, w[p] AS w, w[p - 1] AS v FROM (SELECT doc_id, good, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
n AS (SELECT count(*) AS b, coalesce(sum(good::INT), 0) AS t FROM t),
u AS (SELECT w, count(*) AS b, sum(good::INT) AS t FROM t GROUP BY w),
x AS (SELECT count(*) AS v FROM u),
g AS (SELECT v, w, count(*) AS b, sum(good::INT) AS t FROM t WHERE p > 1 GROUP BY v, w),
s AS (SELECT v, sum(b) AS b, sum(t) AS t FROM g GROUP BY v),
ou AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY doc_id, w),
os AS (SELECT doc_id, v, count(*) AS n FROM t WHERE p > 1 GROUP BY doc_id, v),
og AS (SELECT doc_id, v, w, count(*) AS n FROM t WHERE p > 1 GROUP BY doc_id, v, w),
dn AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c AS (SELECT t.doc_id, t.p, (u.b - ou.n + {ADD}) / (n.b - dn.n + {ADD} * (x.v + 1)) AS pb,
  (u.t - t.good::INT * ou.n + {ADD}) / (n.t - t.good::INT * dn.n + {ADD} * (x.v + 1)) AS pt,
  g.b - og.n AS gb, g.t - t.good::INT * og.n AS gt, s.b - os.n AS sb, s.t - t.good::INT * os.n AS st,
  greatest(f.b - fo.n, 1) AS fb, greatest(f.t - t.good::INT * fo.n, 1) AS ft
  FROM t CROSS JOIN n CROSS JOIN x JOIN dn ON t.doc_id = dn.doc_id JOIN u ON t.w = u.w JOIN ou ON t.doc_id = ou.doc_id AND t.w = ou.w
  LEFT JOIN u f ON t.v = f.w AND t.p > 1 LEFT JOIN ou fo ON t.doc_id = fo.doc_id AND t.v = fo.w AND t.p > 1
  LEFT JOIN s ON t.v = s.v AND t.p > 1 LEFT JOIN os ON t.doc_id = os.doc_id AND t.v = os.v AND t.p > 1
  LEFT JOIN g ON t.v = g.v AND t.w = g.w AND t.p > 1 LEFT JOIN og ON t.doc_id = og.doc_id AND t.v = og.v AND t.w = og.w AND t.p > 1),
l AS (SELECT doc_id, CASE WHEN p = 1 THEN pb ELSE {LAMBDA} * gb / fb + (1 - {LAMBDA} * sb / fb) * pb END AS qb,
  CASE WHEN p = 1 THEN pt ELSE {LAMBDA} * gt / ft + (1 - {LAMBDA} * st / ft) * pt END AS qt FROM c),
r AS (SELECT doc_id, count(*) AS n, -sum(ln(qb)) / count(*) AS lb, -sum(ln(qt)) / count(*) AS lt FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(r.n, 0)::BIGINT AS n_tokens, round(coalesce(lb, 0), 6) + 0.0 AS background_loss, round(coalesce(lt, 0), 6) + 0.0 AS target_loss,
  round(coalesce(lb - lt, 0), 6) + 0.0 AS score
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""

QUERIES = {"op5_lm_scoring": query}
ORACLE_SQL = {"op5_lm_scoring": ORACLE}

"""Toxicity: logistic regression over hashed word n-grams and skip-grams, trained by FTRL-proximal.

Features of a text are the distinct hashes of its words, word pairs and pairs with one word
between them, in 2 ** BITS slots.  FTRL gives each slot its own learning rate and, with its L1
term, leaves most weights at exactly zero: what is sent to the workers are the other ones.

Training uses at most TRAIN_ROWS labelled rows with TRAIN_SLOTS features together (the first by a
hash of the id; both are parameters that bound what the driver gathers), and only ids whose crc32 (of
the id as text) has a remainder other than 1 by 3; the rest is held out.  Only the text enters a score.

Defined cases: null and empty texts get the score of the intercept alone; labels other than 0
and 1 and null ids are not learnt from; of an id with several labels the largest counts, of an id with
several texts the one whose features come first; without
labelled rows of both classes every score is 0.5; repeated rows are scored alike; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.tables import stored, table
from tickloom.llm.textarrays import SpanHasher, Words, lower_table, mix64, separator_table, slices, text_buffer

BITS = 20
TRAIN_ROWS, TRAIN_SLOTS = 16_000, 24_000_000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 20.0, 0.5, 6
#: How much more a positive row weighs; training rows a slot has to occur in.
POSITIVE, LEAST_ROWS = 8.0, 5
THRESHOLD = 0.7


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1


def _slots(column, distinct: bool):
    """The feature slots of each row."""
    lower, sep, hasher = lower_table(), separator_table("alnum"), SpanHasher()
    data, offsets = text_buffer(column)
    m = np.uint64(0x9E3779B97F4A7C15)
    for a, b in slices(offsets):
        part, off = lower[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        words = Words(part, off, sep)
        hashes = hasher(part, words.starts, words.ends)
        for r in range(b - a):
            h = hashes[words.bounds[r] : words.bounds[r + 1]]
            both = [h, mix64(h[:-1] * m + h[1:]), mix64(h[:-2] * m + h[2:] + np.uint64(5))]
            slots = (np.concatenate(both) & np.uint64((1 << BITS) - 1)).astype(np.int64)
            yield np.unique(slots) if distinct else slots


def fit(rows: list[np.ndarray], labels: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots, weights, intercept) of the weights that aren't zero."""
    if len(set(labels)) < 2:
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    seen = np.zeros(1 << BITS, np.int32)
    for x in rows:
        seen[x] += 1
    rows = [x[seen[x] >= LEAST_ROWS] for x in rows]
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0
    rng = np.random.Generator(np.random.PCG64(3))

    def weights(zi, ni, l1):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            x = rows[i]
            zi, ni = z[x], n[x]
            w = weights(zi, ni, L1)
            bias = float(weights(bias_z, bias_n, 0.0))
            g = float(1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - labels[i]) * (POSITIVE if labels[i] else 1.0)
            root = np.sqrt(ni + g * g)
            z[x] = zi + g - (root - np.sqrt(ni)) / ALPHA * w
            n[x] = ni + g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA * bias
            bias_n += g * g
    w = weights(z, n, L1)
    at = np.flatnonzero(w)
    return at, w[at], float(weights(bias_z, bias_n, 0.0))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str):
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col))
        .groupBy(id_col).agg(F.max(label_col).alias("label"))
        .orderBy(F.xxhash64(F.col(id_col).cast("long")), id_col).limit(TRAIN_ROWS)
    )

    def features(batches):
        for batch in batches:
            rows = list(_slots(batch.column(2), True))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int32()))], ["id", "label", "slots"])

    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    got = texts.join(F.broadcast(chosen.withColumnRenamed(id_col, "id")), "id").select(F.col("id").cast("long"), F.col("label").cast("int"), "text")
    # one row an id before anything is gathered
    each = got.mapInArrow(features, "id long, label int, slots array<int>").groupBy("id").agg(F.max("label").alias("label"), F.min("slots").alias("slots"))
    each = stored(each.select("id", "label", "slots", F.size("slots").alias("n"), F.xxhash64("id").alias("h")), "training-rows")
    # TRAIN_ROWS numbers say where the features of all together reach their bound
    sizes = sorted((r.h, r.n) for r in each.select("h", "n").collect())
    total = np.cumsum([n for _, n in sizes])
    few = each if not len(total) or total[-1] <= TRAIN_SLOTS else each.where(F.col("h") < sizes[int(np.searchsorted(total, TRAIN_SLOTS, "right"))][0])
    ids, own, rows = [], [], []
    for batch in few.select("id", "label", "slots").toArrow().to_batches():
        ids += batch.column("id").to_pylist()
        own += batch.column("label").to_pylist()
        ends = batch.column("slots").value_lengths().to_numpy().cumsum()
        rows += np.split(batch.column("slots").flatten().to_numpy(), ends[:-1]) if len(ends) else []
    order = sorted(range(len(ids)), key=ids.__getitem__)
    return fit([rows[i] for i in order], [own[i] for i in order])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted) of each row.  Training gathers TRAIN_ROWS rows; scoring needs no shuffle."""
    slots, weights, bias = train(docs, labels, id_col, text_col, label_col)

    def run(batches):
        by_slot = np.zeros(1 << BITS)
        by_slot[slots] = weights
        for batch in batches:
            logits = []
            for x in _slots(batch.column(1), False):
                hit = x[by_slot[x] != 0]
                logits.append(bias + by_slot[np.unique(hit)].sum())
            score = 1 / (1 + np.exp(-np.clip(np.array(logits), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [id_col, "score", "predicted"])

    scored = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` long, score double, predicted int")
    return scored.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", "predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op8_toxicity": query}
ORACLE_SQL: dict[str, str] = {}

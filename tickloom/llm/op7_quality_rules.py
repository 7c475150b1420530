"""Quality rules: word, symbol and repetition counts, and zstandard compression bands.

A text that says the same again compresses to almost nothing; random strings hardly compress.
Both the whole text and each fixed chunk of it (the rest after the last full one, too) are
compressed, and the ratio (compressed bytes to bytes) has to lie in the band for its length: short
texts compress badly whatever they say, so their band lies higher.

The bands are wide where nothing is known.  ``fit_limits`` narrows them to what texts labelled good
have: for each length class (half an octave of bytes) with at least FIT_LEAST of them, the ratios
between two far quantiles, and half as far again beyond each as it is from the median.  It fits on
all labelled rows: every text is judged, and only its figures meet the labels.  The quantiles are exact:
counts by narrow bins of the ratio say which bins have them, and these bins are then sorted.

Defined cases: a null or empty text has no words and fails; texts may repeat and each row is
judged alone; null ids aren't learnt from, and of a repeated id all texts are; other columns of the
input are ignored; without labels the wide bands hold; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.tables import stored, table
from tickloom.llm.textarrays import SpanHasher, Words, separator_table, shingle_hashes, slices, text_buffer

#: (bytes from, least ratio, largest ratio) of whole texts; shorter texts than the first are not judged.
#: Ordinary text of scale 0.1, and English manuals, lie in 0.46-0.73 up to 1 KB, 0.40-0.58 up to 4 KB, 0.36-0.52 from
#: 4 KB, 0.34-0.46 from 8 KB and 0.34-0.44 from 16 KB.  Random base64 has 0.74 or more at any length, letters 0.60, hex 0.51.
WHOLE_BANDS = (
    (256, 0.40, 0.80), (512, 0.38, 0.76), (1024, 0.35, 0.63), (1536, 0.34, 0.60), (2048, 0.33, 0.57), (4096, 0.31, 0.54),
    (6144, 0.30, 0.51), (8192, 0.29, 0.50), (16384, 0.27, 0.49), (65536, 0.25, 0.49),
)
#: Bytes of a chunk; a last one of fewer than CHUNK_LEAST isn't judged.  Bytes of chunks outside their band may be this share.
CHUNK_BYTES, CHUNK_LEAST, CHUNK_SHARE = 4096, 1024, 0.5
#: Good texts a length class needs, the quantiles, and how far beyond them is allowed; bins a ratio of 1 has when quantiles are looked for.
FIT_LEAST, FIT_QUANTILES, FIT_MARGIN, FIT_BINS = 40, (0.005, 0.5, 0.995), 0.5, 4096
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, whole_ratio double, n_chunks long, n_bad_chunks long, n_bytes long"
)


def repeat_words(words: np.ndarray) -> int:
    """Words (given by hash) inside 3-word windows that the text has twice or more."""
    if len(words) < 4:
        return 0
    windows = shingle_hashes(words, 3)
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[i : i + len(windows)] |= twice
    return int(covered.sum())


def length_class(n_bytes: int) -> int:
    """Half octaves."""
    return int(2 * math.log2(n_bytes))


def in_band(ratio: float, n_bytes: int, limits=None) -> bool:
    fit = [b for b in WHOLE_BANDS if n_bytes >= b[0]]
    if not fit:
        return True
    low, high = limits[length_class(n_bytes)] if limits and length_class(n_bytes) in limits else (0.0, 1.0)
    return max(low, fit[-1][1]) <= ratio <= min(high, fit[-1][2])


def compression(raw: bytes, compress, limits=None) -> tuple[float, int, int, bool]:
    """Whole ratio, chunks, chunks outside their band, verdict."""
    if not raw:
        return 0.0, 0, 0, True
    ratio = len(compress(raw)) / len(raw)
    parts = [raw[i : i + CHUNK_BYTES] for i in range(0, len(raw), CHUNK_BYTES)] if len(raw) > CHUNK_BYTES else []
    parts = [p for p in parts if len(p) >= CHUNK_LEAST]
    bad = [len(p) for p in parts if not in_band(len(compress(p)) / len(p), len(p), limits)]
    return ratio, len(parts), len(bad), in_band(ratio, len(raw), limits) and sum(bad) <= CHUNK_SHARE * len(raw)


def _judge(batches, limits=None):
    space, hasher = separator_table("space"), SpanHasher()
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    newline = np.ones(256, bool)
    newline[:] = False
    newline[10] = True
    compress = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        found = []
        for a, b in slices(offsets):
            part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            words = Words(part, off, space)
            hashes = hasher(part, words.starts, words.ends)
            lines = Words(part, off, newline)
            line_hashes = hasher(part, lines.starts, lines.ends)
            # a line without a word can't be a duplicate
            line_words = np.searchsorted(words.starts, lines.ends) - np.searchsorted(words.starts, lines.starts)
            points = np.concatenate([[0], np.cumsum(words.inside & ((part & 0xC0) != 0x80))])
            marks = np.concatenate([[0], np.cumsum(symbol[part])])
            raw = part.tobytes()
            for r in range(b - a):
                own = hashes[words.bounds[r] : words.bounds[r + 1]]
                at = slice(lines.bounds[r], lines.bounds[r + 1])
                kept_lines = line_hashes[at][line_words[at] > 0]
                n, repeats = len(own), repeat_words(own)
                failed = n < MIN_WORDS or 100 * repeats > 50 * n
                ratio, chunks, bad, ok = compression(raw[off[r] : off[r + 1]], compress, limits)
                found.append(
                    (n, int(points[off[r + 1]] - points[off[r]]), int(marks[off[r + 1]] - marks[off[r]]),
                     len(kept_lines) - len(np.unique(kept_lines)), repeats, failed, ok and not failed, ratio, chunks, bad, int(off[r + 1] - off[r]))
                )
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 3
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        columns = zip(*found, strict=True) if found else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: dict | None = None) -> DataFrame:
    """One row for each row of docs: the counts, base_failed, kept and the compression figures.  No shuffle."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(lambda batches: _judge(batches, limits), SCHEMA)


def fit_limits(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict[int, tuple[float, float]]:
    """(least, largest ratio) by length class, from the texts labelled 1 that pass the base rules."""
    good = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    judged = quality_rules(texts).where(~F.col("base_failed") & (F.col("n_bytes") >= WHOLE_BANDS[0][0]))
    ratios = judged.select("doc_id", F.floor(2 * F.log2("n_bytes")).cast("int").alias("length"), F.col("whole_ratio").alias("ratio")).join(good, "doc_id", "left_semi")
    found = quantiles(stored(ratios.select("length", "ratio"), "ratios"), FIT_QUANTILES, FIT_LEAST)
    return {k: (q[0] - FIT_MARGIN * (q[1] - q[0]), q[2] + FIT_MARGIN * (q[2] - q[1])) for k, q in found.items()}


def quantiles(ratios: DataFrame, at, least: int) -> dict[int, list[float]]:
    """The quantiles of the ratios of each length that has at least so many, interpolated; ratios: (length, ratio), read twice."""
    binned = ratios.withColumn("bin", F.floor(F.col("ratio") * FIT_BINS).cast("int"))
    counts: dict[int, list[tuple[int, int]]] = {}
    for r in binned.groupBy("length", "bin").count().orderBy("length", "bin").collect():
        counts.setdefault(r.length, []).append((r.bin, r["count"]))
    places, wanted = {}, set()
    for length, bins in counts.items():
        upto = np.cumsum([n for _, n in bins])
        if upto[-1] >= least:
            places[length] = [q * (int(upto[-1]) - 1) for q in at]
            for rank in {f(p) for p in places[length] for f in (math.floor, math.ceil)}:
                i = int(np.searchsorted(upto, rank, "right"))
                wanted.add((length, bins[i][0], rank, rank - int(upto[i]) + bins[i][1]))
    if not places:
        return {}
    # of equal ratios one row is sorted
    asked = F.broadcast(ratios.sparkSession.createDataFrame(sorted(wanted), "length int, bin int, rank long, local long"))
    some = binned.join(asked.select("length", "bin").distinct(), ["length", "bin"], "left_semi").groupBy("length", "bin", "ratio").count()
    upto = some.withColumn("upto", F.sum("count").over(Window.partitionBy("length", "bin").orderBy("ratio")))
    hit = upto.join(asked, ["length", "bin"]).where((F.col("local") < F.col("upto")) & (F.col("local") >= F.col("upto") - F.col("count")))
    value = {(r.length, r.rank): r.ratio for r in hit.collect()}

    def between(length, p):
        low, high = math.floor(p), math.ceil(p)
        return value[length, low] if low == high else (high - p) * value[length, low] + (p - low) * value[length, high]

    return {length: [between(length, p) for p in ps] for length, ps in places.items()}


def keep_good(docs: DataFrame, text_col: str = "text", limits: dict | None = None) -> DataFrame:
    """Rows of docs that the rules keep, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            text = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], ["i", "text"])
            for judged in _judge([text], limits):
                yield batch.filter(judged.column("kept"))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, limits=fit_limits(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op7_quality_rules": query}
ORACLE_SQL: dict[str, str] = {}

"""Benchmark decontamination by winnowing, with DataFrame functions only.

Each text becomes an array of word hashes, then of K-word gram hashes.  Of every W consecutive
grams the smallest is kept as a fingerprint; two texts that share WINDOW = K + W - 1 consecutive
words select the same gram there, so every such shared span has a common fingerprint.  Each
fingerprint carries the word hashes up to WINDOW - K to either side; a common fingerprint is
extended over them as far as both texts agree, and counts if the run has WINDOW words.

Items of fewer than WINDOW words are one window.  They are found by the hash of their first K words
(of all, if they have fewer), and the whole item is compared.

The benchmark's hashes are put into bit sets (two bits a hash, 2 ** MAX_BITS bits at most), with which
the scan drops fingerprints that no item has before they become rows.  The same plan holds for any
benchmark: the bit sets grow with it, and beyond their bound more rows pass that match nothing.

The benchmark side is broadcast while it has at most ``BROADCAST_ROWS`` fingerprints (checked by
a count); beyond, the same join shuffles by fingerprint.

Defined cases: a null or empty text has no words and isn't contaminated; rows are judged one by
one, so repeated rows (and null ids) each give a row; windows of an item without an id count as hits,
but it has no place among the items; an empty benchmark leaves all documents clean; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.tables import table

WINDOW, K = 13, 5
W = WINDOW - K + 1
SIDE = WINDOW - K
BROADCAST_ROWS = 200_000
#: The bit sets have 2 ** LEAST_BITS bits, or more: SPARSE for each hash, up to 2 ** MAX_BITS (1 MB).
LEAST_BITS, MAX_BITS, SPARSE = 16, 23, 256
POS_BITS = 30
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def word_hashes(text: Column) -> Column:
    """Hashes of the words, A-Z lower-cased."""
    # one character to split at: faster than a pattern
    spaced = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER + _SEPARATORS, _LOWER + " " * len(_SEPARATORS))
    return F.transform(F.filter(F.split(spaced, " "), lambda w: w != ""), lambda w: F.xxhash64(w))


def _grams(h: Column, k: int = K) -> Column:
    """For each position with k words from there on: 33 bits of their hash above 30 bits of position, so that the least of some is the smallest hash, the leftmost of equals."""
    def packed(x, i):
        fp = F.shiftrightunsigned(F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]), 31)
        return F.shiftleft(fp, POS_BITS).bitwiseOR(i.cast("bigint"))

    return F.slice(F.transform(h, packed), 1, F.greatest(F.size(h) - (k - 1), F.lit(0)))


def _minima(g: Column) -> Column:
    """The distinct least grams of all windows of W grams: a minimum stays the same until it leaves the window or a lesser one comes."""
    def lowest(_x, i):
        return F.least(*[F.get(g, i + j) for j in range(W)])

    return F.array_distinct(F.slice(F.transform(g, lowest), 1, F.greatest(F.size(g) - (W - 1), F.lit(0))))


def _pos(m: Column) -> Column:
    return m.bitwiseAND((1 << POS_BITS) - 1).cast("int")


def _fp(m: Column) -> Column:
    return F.shiftrightunsigned(m, POS_BITS)


def _context(h: Column, m: Column, key: int) -> Column:
    """(pos, hash, words before, words from there on) of a fingerprint (key 0) or of the first words of a short item (key: how many)."""
    return F.struct(
        _pos(m).alias("pos"),
        _fp(m).alias("fp"),
        F.lit(key).alias("key"),
        (F.array().cast("array<bigint>") if key else F.slice(h, F.greatest(_pos(m) - SIDE, F.lit(0)) + 1, F.least(_pos(m), F.lit(SIDE)))).alias("left"),
        F.slice(h, _pos(m) + 1, WINDOW - 1 if key else K + SIDE).alias("right"),
    )


def _contexts(h: Column, key: int):
    return lambda m: _context(h, m, key)


def _probes(fp: Column, bits: int) -> list[Column]:
    """Two places in a bit set: the low and the high bits of a hash of 33 bits."""
    return [fp.bitwiseAND((1 << bits) - 1), F.shiftrightunsigned(fp, 33 - bits)]


class BitSet:
    """Which hashes a benchmark may have.  Built by an aggregation, read in the scan as a constant."""

    def __init__(self, fps: DataFrame):
        """fps: distinct hashes in a column fp."""
        self.n = fps.count()
        self.bits = min(MAX_BITS, max(LEAST_BITS, (self.n * SPARSE).bit_length()))
        at = fps.select(F.explode(F.array(*_probes(F.col("fp"), self.bits))).alias("at"))
        one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at").bitwiseAND(63).cast("int"))
        words = ["0"] * (1 << self.bits - 6)
        # 2 ** (MAX_BITS - 6) rows at most
        for r in at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toLocalIterator() if self.n else ():
            words[r.word] = str(r.bits)
        # split and cast of a constant are done once, when the plan is made
        self.words = F.split(F.lit(",".join(words)), ",").cast("array<bigint>")

    def test(self, m: Column) -> Column:
        """Whether the benchmark may have the hash of a packed gram."""
        found = F.lit(True)
        for at in _probes(_fp(m), self.bits):
            word = F.get(self.words, F.shiftright(at, 6).cast("int"))
            found = found & (F.call_function("shiftright", word, at.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1)
        return found


def _agree(a: Column, b: Column, most: int, back: bool) -> Column:
    """How many elements agree from the start (or the end) of two arrays."""
    def cell(x: Column, i: int) -> Column:
        return F.get(x, F.size(x) - 1 - i) if back else F.get(x, F.lit(i))

    out = F.lit(most)
    for i in reversed(range(most)):
        out = F.when(F.coalesce(cell(a, i) == cell(b, i), F.lit(False)), out).otherwise(F.lit(i))
    return out


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each row of docs: id, _n_words, _n_hit, _items (sorted strings), _spans (not merged)."""
    h, none = F.col("h"), F.array().cast("array<bigint>")
    items = bench.select(F.col(item_col).cast("string").alias("item"), word_hashes(F.col(item_text)).alias("h")).where(F.size("h") > 0)
    long_items = (
        items.where(F.size("h") >= WINDOW).withColumn("g", _grams(h)).withColumn("m", _minima(F.col("g")))
        .select("item", F.explode(F.transform("m", lambda m: _context(h, m, 0))).alias("f"))
        .select(F.col("f.fp").alias("fp"), F.lit(0).alias("key"), "item", F.col("f.left").alias("i_left"), F.col("f.right").alias("i_right"))
    )
    heads = [items.where(F.size("h") == k if k < K else F.size("h").between(K, WINDOW - 1)).select(_fp(F.get(_grams(h, k), F.lit(0))).alias("fp"), F.lit(k).alias("key"), "item", none.alias("i_left"), h.alias("i_right")) for k in range(1, K + 1)]
    index = long_items
    for head in heads:
        index = index.unionByName(head)
    found = index.select("key", "fp").distinct()
    among = {k: BitSet(found.where(F.col("key") == k).select("fp")) for k in sorted(r.key for r in found.select("key").distinct().collect())}

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), word_hashes(F.col(text_col)).alias("h"))
    rows = rows.withColumn("g", _grams(h))
    kind = "struct<pos:int,fp:bigint,key:int,left:array<bigint>,right:array<bigint>>"
    parts = [F.array(F.struct(F.lit(-1), F.lit(None).cast("bigint"), F.lit(0), none, none).cast(kind))]
    for k, some in among.items():
        at = F.col("g") if k in (0, K) else _grams(h, k)
        if k == 0:
            # without a gram among the benchmark's fingerprints no window of a text can match: such texts need no winnowing
            rows = rows.withColumn("m", F.when(F.exists("g", some.test), _minima(F.col("g"))).otherwise(none))
            at = F.col("m")
        parts.append(F.transform(F.filter(at, some.test), _contexts(h, k)).cast(f"array<{kind}>"))
    # outer, though no array is empty: for an inner explode Spark would compute the arrays once more in a filter
    each = rows.select("row", "id", F.size("h").alias("n"), F.explode_outer(F.concat(*parts)).alias("f")).select("row", "id", "n", "f.*")
    met = each.join(_bounded(index.withColumn("matched", F.lit(True))), ["fp", "key"], "left").where((F.col("pos") < 0) | F.col("matched"))

    short = F.col("key") > 0
    before = F.when(short, F.lit(0)).otherwise(_agree(F.col("left"), F.col("i_left"), SIDE, True))
    after = _agree(F.col("right"), F.col("i_right"), K + SIDE, False)
    spans = met.withColumn("a", before).withColumn("b", after)
    good = F.when(short, F.col("b") == F.size("i_right")).otherwise((F.col("b") >= K) & (F.col("a") + F.col("b") >= WINDOW))
    good = (F.col("pos") >= 0) & F.coalesce(good, F.lit(False))
    span = F.when(good, F.struct((F.col("pos") - F.col("a")).alias("s"), (F.col("pos") + F.col("b")).alias("e")))
    spans = spans.select("row", "id", "n", span.alias("span"), F.when(good, F.col("item")).alias("item")).where((F.col("pos") < 0) | good)
    per_row = spans.groupBy("row", "id", "n").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    hit = F.aggregate("spans", zero, lambda acc, s: F.struct((acc["n"] + F.greatest(s["e"] - F.greatest(s["s"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], s["e"]).alias("end")))["n"]
    return per_row.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("_n_words"), hit.cast("long").alias("_n_hit"), F.col("items").alias("_items"), F.col("spans").alias("_spans"))


def contaminated() -> Column:
    return (F.col("_n_hit") > 0) & (F.col("_n_hit") * 20 >= F.col("_n_words"))


def clean_documents(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows of docs that aren't contaminated, all columns.  A verdict is on a text, so neither null nor repeated ids matter."""
    text = F.col(f"`{text_col}`").cast("string")
    key = F.struct(F.xxhash64(text).alias("a"), F.hash(text, F.length(text)).alias("b"))
    found = decontaminate(docs.select(key.alias("key"), text.alias("text")), bench, "key", "text", item_col, item_text)
    gone = found.where(contaminated()).select("key").distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key.alias("key"))
    return packed.join(gone, "key", "left_anti").select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def _sql_words(text: str) -> str:
    chars = f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"
    return f"list_filter(regexp_split_to_array({chars}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


ORACLE = f"""
WITH i AS (SELECT item_id, {_sql_words("text")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS l, array_to_string(w[p:p + least(len(w), {WINDOW}) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_sql_words("text")} AS w FROM documents),
dw AS (SELECT doc_id, l, p, array_to_string(w[p:p + l - 1], ' ') AS k
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)),
hits AS (SELECT doc_id, item_id, p, dw.l FROM dw JOIN iw ON dw.l = iw.l AND dw.k = iw.k),
words AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items,
  sha256(coalesce(found.ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN found ON d.doc_id = found.doc_id
"""

QUERIES = {"op9_decontamination": query}
ORACLE_SQL = {"op9_decontamination": ORACLE}

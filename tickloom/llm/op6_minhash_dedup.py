"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

1. Each text becomes its set of 5-word shingles and SYMBOLS MinHash values cut to 16 bits.
   Texts with equal sets collapse to one before anything is compared; from then on a set is known
   by a 128-bit digest, not by the id of a document.
2. The first INDEXED symbols are split into CHUNKS chunks.  Two signatures that differ in at most
   DISTANCE of them differ in at most DISTANCE // CHUNKS symbols of some chunk (pigeonhole), so each
   chunk is entered once for every way to leave out that many of its symbols: all pairs within
   DISTANCE share an entry.  At similarity s a symbol differs with probability 1 - s; with the
   values below a pair at 0.85 shares no entry with probability 2e-8.
3. An entry's members aren't paired.  Its most central member (the one whose entries have the
   most members) is its hub, and all members of entries with the same hub form a cluster, so a
   group of copies is one cluster of which each text is a member once.
4. Of a large cluster every member within FAR of the hub (signature distance, all SYMBOLS) is compared
   with it on full sets, and what links so is connected already.  Clusters are dealt into blocks; each
   pair of blocks is a task of its own, of bounded size, that first compares signatures alone: only
   members within FAR of one that they aren't connected with go on.  At 0.85 the distance exceeds FAR
   with probability 1.3e-7, at 0.5 it is within it with probability 6e-5.
5. The texts of these are moved to their tasks, whose exact intersections are a product of the
   shingle incidence matrix.  Of the links found only a spanning forest leaves the task.
6. Components: alternating large-star and small-star steps on the forest, checkpointed.

Defined cases: null and empty texts (no words) have an empty set, link with nothing and keep;
rows with a repeated id are documents of their own, each with its own set, so an id may have several
components; a component's id is its least id, null only if it has no other; a row with a null id is
kept only if its component has no id at all (or it has no words).  ``distinct_documents`` keeps one
row a component, the one with the least id, and of equal rows one.  Other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.components import connected_components
from tickloom.llm.tables import stored, table
from tickloom.llm.textarrays import SpanHasher, Words, lower_table, mix64, separator_table, shingle_hashes, slices, text_buffer

SHINGLE = 5
SYMBOLS, FAR = 128, 42
INDEXED, CHUNKS, DISTANCE = 32, 8, 15
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
#: A block of a large cluster: members and shingles, about.
BLOCK_DOCS, BLOCK_SHINGLES = 128, 400_000


def _sets(column, lower, space, hasher):
    """The sorted shingle set of each row."""
    data, offsets = text_buffer(column)
    for a, b in slices(offsets):
        part, off = lower[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        words = Words(part, off, space)
        hashes = hasher(part, words.starts, words.ends)
        for r in range(b - a):
            yield np.unique(shingle_hashes(hashes[words.bounds[r] : words.bounds[r + 1]], SHINGLE))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(11))
    return rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """SYMBOLS 16-bit symbols of a set."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 256):
        low = np.minimum(low, (s[i : i + 256, None] * a + b).min(axis=0))
    return (mix64(low) & np.uint64(0xFFFF)).astype(np.uint16)


def entries(sig: np.ndarray) -> np.ndarray:
    """Keys of a signature: for each chunk and each choice of DISTANCE // CHUNKS symbols to leave out."""
    width, skip = INDEXED // CHUNKS, DISTANCE // CHUNKS
    keys = []
    for c in range(CHUNKS):
        for kept in combinations(range(width), width - skip):
            key = np.uint64(c * 1000003 + sum(1 << k for k in kept))
            for k in kept:
                key = mix64(key + sig[..., c * width + k].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            keys.append(key)
    return np.stack(keys, axis=-1)


def digest(s: np.ndarray) -> bytes | None:
    """128 bits of a sorted set of hashes; an empty one has none."""
    if not len(s):
        return None
    return int(mix64(s).sum(dtype=np.uint64)).to_bytes(8, "big") + int(np.bitwise_xor.reduce(mix64(s + np.uint64(len(s))))).to_bytes(8, "big")


def _sign(batches):
    lower, space, hasher = lower_table(), separator_table("space"), SpanHasher()
    a, b = _permutations()
    for batch in batches:
        sizes, set_ids, sigs = [], [], []
        for s in _sets(batch.column(2), lower, space, hasher):
            sizes.append(len(s))
            set_ids.append(digest(s))
            sigs.append(signature(s, a, b) if len(s) else np.zeros(SYMBOLS, np.uint16))
        sigs = np.array(sigs, np.uint16).reshape(-1, SYMBOLS)
        keys = entries(sigs).astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * keys.shape[-1]), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(sizes, pa.int64()), pa.array(set_ids, pa.binary()), pa.array([x.tobytes() for x in sigs], pa.binary()), lists],
            ["id", "row", "n", "set_id", "sig", "keys"],
        )


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols in which each signature of a differs from each of b."""
    out = np.empty((len(a), len(b)), np.int16)
    for i in range(len(a)):
        out[i] = (a[i] != b).sum(axis=1)
    return out


def links(sets: list[np.ndarray], skip_within: int = 0) -> list[tuple[int, int]]:
    """A spanning forest of the exact links among sets; pairs of the first skip_within are not looked at."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    common = np.zeros((n, n), np.float32)
    if n == 2:
        common[0, 1] = common[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.concatenate([[True], flat[1:] != flat[:-1]])
        ident = np.cumsum(new) - 1
        count = np.bincount(ident)
        shared = count[ident] > 1  # a shingle of one set is in no intersection
        owner, ident = owner[shared], (np.cumsum(count > 1) - 1)[ident[shared]]
        step = max(64, (1 << 22) // n)
        for a in range(0, int(ident[-1]) + 1 if len(ident) else 0, step):
            lo, hi = np.searchsorted(ident, [a, a + step])
            m = np.zeros((n, step), np.float32)
            m[owner[lo:hi], ident[lo:hi] - a] = 1
            common += m @ m.T
    union = sizes[:, None] + sizes[None, :] - common
    ok = 100 * common.astype(np.float64) >= PERCENT * union.astype(np.float64)
    ok[:skip_within, :skip_within] = False
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(ok, 1)), strict=True):
        x, y = find(int(i)), find(int(j))
        if x != y:
            root[x] = y
            out.append((int(i), int(j)))
    return out


EDGES = pa.schema([("u", pa.binary()), ("v", pa.binary())])


def _groups(batches, n_keys: int):
    """Groups of a partition that is sorted by its first n_keys columns: a list of the other columns' values for each."""
    key, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[:n_keys] != key:
                if held:
                    yield key, list(zip(*held, strict=True))
                key, held = row[:n_keys], []
            held.append(row[n_keys:])
    if held:
        yield key, list(zip(*held, strict=True))


def _candidates(batches):
    """(hub, pair, set_id, near) of the members of a pair of blocks that are within FAR of one that they aren't connected with."""
    names = ["hub", "pair", "set_id", "near"]
    kinds = (pa.binary(), pa.int64(), pa.binary(), pa.bool_())
    for (hub, pair), (ids, labels, near, sigs) in _groups(batches, 2):
        sig = np.frombuffer(b"".join(sigs), np.uint16).reshape(-1, SYMBOLS)
        _, own = np.unique(np.array(labels, object), return_inverse=True)
        ok = (distances(sig, sig) <= FAR) & (own[:, None] != own[None, :])
        is_near = np.array(near, bool)
        ok[np.ix_(is_near, is_near)] = False
        at = np.flatnonzero(ok.any(axis=1))
        if len(at):
            rows = ([hub] * len(at), [pair] * len(at), [ids[i] for i in at], [near[i] for i in at])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)


def _confirm(batches):
    """Forests of whole clusters and of pairs of blocks; a text whose set isn't the one asked for is passed over."""
    lower, space, hasher = lower_table(), separator_table("space"), SpanHasher()
    u, v = [], []
    for _key, (ids, near, texts) in _groups(batches, 2):
        sets = list(_sets(pa.array(texts, pa.string()), lower, space, hasher))
        order = sorted((i for i in range(len(ids)) if digest(sets[i]) == ids[i]), key=lambda i: not near[i])
        if len(order) > 1:
            for i, j in links([sets[i] for i in order], sum(near[i] for i in order)):
                x, y = ids[order[i]], ids[order[j]]
                u.append(max(x, y))
                v.append(min(x, y))
        if len(u) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], schema=EDGES)
            u, v = [], []
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], schema=EDGES)


def _within(batches):
    """(hub, set_id) of the pairs whose signatures are within FAR."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for i in (2, 3))
        yield batch.filter(pa.array((a != b).sum(axis=1) <= FAR)).select([0, 1])


def _near_hub(batches):
    """(hub, set_id) of the members of a large cluster that link to its hub."""
    lower, space, hasher = lower_table(), separator_table("space"), SpanHasher()
    last, hub_set = None, None
    for batch in batches:
        near = []
        hubs, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, s in enumerate(_sets(batch.column(2), lower, space, hasher)):
            if hubs[i] != last:
                last, hub_set = hubs[i], next(_sets(batch.column(3).slice(i, 1), lower, space, hasher))
            common = len(np.intersect1d(s, hub_set, assume_unique=True))
            near.append(digest(s) == ids[i] and digest(hub_set) == last and 100 * common >= PERCENT * (len(s) + len(hub_set) - common))
        yield batch.filter(pa.array(near, pa.bool_())).select([0, 1])


def _row_key(id_col: str, text_col: str) -> Column:
    """What a row is known by: a hash of its id and text."""
    own = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    return F.xxhash64(*own, own[0].isNull())


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), _row_key(id_col, text_col).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, n, set_id, sig, keys) of each row."""
    return _rows(docs, id_col, text_col).mapInArrow(_sign, "id long, row long, n long, set_id binary, sig binary, keys array<long>")


def clusters(sets: DataFrame) -> DataFrame:
    """(hub, set_id) of sets that share an entry with another, hubs included.  sets: (set_id, keys), one row a set."""
    each = sets.select("set_id", F.explode("keys").alias("key"))
    sizes = each.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = stored(each.join(sizes, "key").select("key", "set_id", "members"), "entries")
    central = met.groupBy("set_id").agg(F.sum("members").alias("score"))
    scored = met.join(central, "set_id").select("key", "set_id", "score")
    best = scored.groupBy("key").agg(F.max("score").alias("score"))
    hubs = scored.join(best, ["key", "score"]).groupBy("key").agg(F.min("set_id").alias("hub"))
    return met.join(hubs, "key").select("hub", "set_id").distinct()


def _edges(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): links between sets, enough to connect all that are connected."""
    members = stored(clusters(sets.select("set_id", "keys")), "clusters")
    own = sets.select("set_id", "n", "row", "sig")
    # stored, so that the joins below are of plain tables and a hub with very many members can be split
    sizes = stored(members.join(own, "set_id").groupBy("hub").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles")), "sizes")
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.least(F.col("docs"), F.ceil(F.col("shingles") / BLOCK_SHINGLES)))
    placed = members.join(sizes.select("hub", blocks.cast("long").alias("blocks")), "hub")
    placed = stored(placed.join(own.drop("n"), "set_id"), "placed")

    def with_text(df: DataFrame) -> DataFrame:
        """df (with a column row) and one text a row."""
        needed = df.select("row").distinct()
        # of rows with equal id and text one: the keys are the join's, so this deals nothing out anew
        return df.join(texts.join(needed, "row").select("row", "text").dropDuplicates(["row"]), "row")

    # a large cluster: first every member against the hub
    large = stored(placed.where("blocks > 1"), "large")
    hubs = large.where("hub = set_id").select("hub", F.col("sig").alias("hub_sig"), F.col("row").alias("hub_row"))
    close = large.join(hubs.select("hub", "hub_sig"), "hub").select("hub", "set_id", "sig", "hub_sig").mapInArrow(_within, "hub binary, set_id binary")
    close = stored(close.join(own.select("set_id", "row"), "set_id").where("hub <> set_id"), "within")
    hub_texts = stored(with_text(hubs.select("hub", F.col("hub_row").alias("row"))).select("hub", F.col("text").alias("hub_text")), "hub-texts")
    compared = with_text(close).join(hub_texts, "hub").select("hub", "set_id", "text", "hub_text")
    near = stored(compared.mapInArrow(_near_hub, "hub binary, set_id binary"), "near-hub")
    star = near.select(F.greatest("hub", "set_id").alias("u"), F.least("hub", "set_id").alias("v")).distinct()
    joined = stored(connected_components(star).withColumnRenamed("node", "set_id").withColumnRenamed("component", "label"), "labels")

    # what isn't connected so far meets block by block, in proportion to how many members are near and far; near blocks don't meet
    is_near = near.withColumn("near", F.lit(True)).unionByName(hubs.select("hub", F.col("hub").alias("set_id"), F.lit(True).alias("near")))
    dealt = large.join(is_near, ["hub", "set_id"], "left").withColumn("near", F.coalesce("near", F.lit(False))).join(joined, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    dealt = stored(dealt.select("hub", "set_id", "sig", "blocks", "near", "label"), "dealt")
    share = F.avg(F.col("near").cast("double"))
    open_ = dealt.groupBy("hub").agg(share.alias("share"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("hub", "share")
    dealt = dealt.join(stored(open_, "open-hubs"), "hub").withColumn("b_near", F.ceil(F.col("blocks") * F.col("share"))).withColumn("b_far", F.ceil(F.col("blocks") * (1 - F.col("share"))))
    at = F.xxhash64("set_id")
    dealt = dealt.withColumn("block", F.when(F.col("near"), F.pmod(at, F.col("b_near"))).otherwise(F.col("b_near") + F.pmod(at, F.greatest("b_far", F.lit(1)))))
    first = F.when(F.col("near"), F.col("b_near")).otherwise(F.lit(0).cast("long"))
    pair = F.least("block", "other") * 2_000_000_000 + F.greatest("block", "other") + 1
    paired = dealt.withColumn("other", F.explode(F.sequence(first, F.col("b_near") + F.col("b_far") - 1))).select("hub", pair.alias("pair"), "set_id", "label", "near", "sig")
    whole = placed.where("blocks = 1").select("hub", F.lit(0).cast("long").alias("pair"), "set_id", F.col("set_id").alias("label"), F.lit(False).alias("near"), "sig")
    some = whole.unionByName(paired).repartition("hub", "pair").sortWithinPartitions("hub", "pair")
    tasks = stored(some.mapInArrow(_candidates, "hub binary, pair long, set_id binary, near boolean"), "candidates")
    work = with_text(tasks.join(own.select("set_id", "row"), "set_id")).select("hub", "pair", "set_id", "near", "text")
    found = work.repartition("hub", "pair").sortWithinPartitions("hub", "pair").mapInArrow(_confirm, "u binary, v binary")
    return found.unionByName(star).distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, row, n, set_id) of each row, and (set_id, component, cid) of each set, cid being the component's least id."""
    signed = stored(signatures(docs, id_col, text_col), "signatures")
    # equal sets have equal signatures; any of their rows stands for them
    first = [F.first(c).alias(c) for c in ("n", "sig", "keys")]
    sets = stored(signed.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min("id").alias("rep"), F.min("row").alias("row"), *first), "sets")
    found = stored(connected_components(stored(_edges(sets, _rows(docs, id_col, text_col)), "links")), "components")
    own = sets.select("set_id", "rep").join(found, sets.set_id == found.node, "left").select("set_id", "rep", F.coalesce("component", "set_id").alias("component"))
    least = stored(own.groupBy("component").agg(F.min("rep").alias("cid")), "least")
    return signed.select("id", "row", "n", "set_id"), stored(own.select("set_id", "component").join(least, "component"), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id, kept."""
    rows, classes = _classes(docs, id_col, text_col)
    kept = F.col("set_id").isNull() | F.col("id").eqNullSafe(F.col("component_id"))
    return (
        rows.join(classes, "set_id", "left").withColumn("component_id", F.when(F.col("set_id").isNull(), F.col("id")).otherwise(F.col("cid")))
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row a component, all columns; rows without words stay."""
    rows, classes = _classes(docs, id_col, text_col)
    # null ids last, then by a hash of the row
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    first = rows.join(classes, "set_id").groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.row").alias("row"))
    keep = stored(first.unionByName(rows.where(F.col("set_id").isNull()).select("row")).distinct(), "kept-rows")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _row_key(id_col, text_col).alias("row"))
    return packed.dropDuplicates(["row"]).join(keep, "row", "left_semi").select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + {SHINGLE - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n p ON c.x = p.doc_id JOIN n q ON c.y = q.doc_id WHERE 100 * both_have >= {PERCENT} * (p.n + q.n - both_have)),
r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON r.reached = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT node, min(reached) AS component_id FROM r GROUP BY node) m ON d.doc_id = m.node
"""

QUERIES = {"op6_minhash_dedup": query}
ORACLE_SQL = {"op6_minhash_dedup": ORACLE}

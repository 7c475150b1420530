"""Line dedup: boilerplate lines are those that many different sites carry.

Per line key an HLL sketch of the sites is built and merged by aggregation, so a line that
every document has costs one sketch a map task.  The estimate decides for lines well above or
below ``min_sites`` (``long_sites`` for lines of LONG_WORDS words or more); lines whose estimate lies within ``NEAR`` of it are counted exactly in a
second pass over these lines only.  Of a boilerplate line the first occurrence (smallest id,
then position) stays, and all others are removed, so no text is lost from the corpus.

Lines are split at \\n and compared after trimming ASCII blanks; empty lines are never removed.

Positions are dropped by row, not by id: a row is known by its id, text and site.

Defined cases: a null site counts as one site of its own; a null or empty text has no line and
comes back as it is; of rows that share an id but not the text each loses its own lines only, and a
line that they have at the same position stays in the row with the lesser hash; null ids come after
all others, so they lose a line that any other row has too; rows equal in id, text and site are
treated alike, so where they hold a first occurrence all of them keep it; an empty table gives an
empty result; other columns pass through whatever their names, but for _n_lines and _n_removed,
which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.tables import stored, table

MIN_SITES = 10
#: Words from which on a line is a passage, and how many sites then suffice where passages go, too.  Copies of a
#: whole text on two sites are left to the near-dedup, which keeps one text and no rest of another.
LONG_WORDS, LONG_SITES = 50, 3
#: 2 ** LG_K registers: a relative standard error of 1.04 / 2 ** (LG_K / 2), 2.3 per cent.
LG_K = 11
#: Estimates within this share of min_sites (over eight standard errors) are counted exactly.
NEAR = 0.2

BLANKS = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _row_key(id_col: str, text_col: str, site_col: str) -> Column:
    """96 bits of a row's id, text and site."""
    own = [F.col(f"`{c}`") for c in (id_col, text_col, site_col)]
    return F.struct(F.xxhash64(*own, own[0].isNull()).alias("a"), F.hash(*own, own[2].isNull()).alias("b"))


def line_keys(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_sites: int = MIN_SITES, long_sites: int | None = None) -> DataFrame:
    """(id, row, pos, key, site, sites needed): a row for each line that isn't blank; the key is a pair of hashes, 96 bits."""
    each = docs.select(
        F.col(f"`{id_col}`").alias("_id"),
        _row_key(id_col, text_col, site_col).alias("_row"),
        F.xxhash64(F.coalesce(F.col(f"`{site_col}`").cast("string"), F.lit("\x00null"))).alias("_site"),
        F.posexplode(_lines(F.col(f"`{text_col}`").cast("string"))).alias("_pos", "_line"),
    )
    line = F.trim(F.col("_line"), F.lit(BLANKS))
    need = F.lit(min_sites)
    if long_sites is not None:
        # so many words have a blank between any two
        long = F.when(F.length(line) >= 2 * LONG_WORDS - 1, F.size(F.split(line, "[ \\t\\r\\x0b\\x0c]+")) >= LONG_WORDS)
        need = F.when(long, F.lit(long_sites)).otherwise(need)
    return each.where(line != "").select("_id", "_row", "_site", "_pos", F.xxhash64(line).alias("_k1"), F.hash(line, F.length(line)).alias("_k2"), need.alias("_need"))


def _place() -> Column:
    """Where a line is, in the order that says which occurrence is the first; null ids last."""
    return F.struct(F.col("_id").isNull().alias("_null"), F.col("_id"), F.col("_pos"), F.col("_row"))


def boilerplate(lines: DataFrame) -> DataFrame:
    """(k1, k2, first place) of the lines that as many sites carry as they need, or more."""
    firsts = F.min(_place())
    need = F.max("_need").alias("_need")
    stats = lines.groupBy("_k1", "_k2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("_site", F.lit(LG_K))).alias("_est"), firsts.alias("_first"), need)
    wide = stored(stats.where(F.col("_est") >= F.col("_need") * (1 - NEAR)), "wide-lines")
    sure = wide.where(F.col("_est") > F.col("_need") * (1 + NEAR)).select("_k1", "_k2", "_first")
    near = wide.where(F.col("_est") <= F.col("_need") * (1 + NEAR))
    exact = (
        lines.join(near.select("_k1", "_k2"), ["_k1", "_k2"], "left_semi")
        .select("_k1", "_k2", "_site").distinct()
        .groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("_n"))
    )
    return sure.unionByName(near.join(exact, ["_k1", "_k2"]).where(F.col("_n") >= F.col("_need")).select("_k1", "_k2", "_first"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, long_sites: int | None = None) -> DataFrame:
    """docs with text_col shortened, plus _n_lines and _n_removed.  Only line keys are shuffled, and texts once, by row."""
    lines = line_keys(docs, id_col, text_col, site_col, min_sites, long_sites)
    found = stored(boilerplate(lines), "boilerplate")
    drop = lines.join(found, ["_k1", "_k2"]).where(~_place().eqNullSafe(F.col("_first")))
    # stored, so that the join below is of two plain tables and rows that repeat very often can be split; merged at any size, as
    # the lists grow with the corpus
    drop = stored(drop.groupBy("_row").agg(F.array_sort(F.collect_set("_pos")).alias("_drop")), "dropped-lines")
    # the input's columns travel in one struct, so that none of their names can meet one of those used here
    own = [c for c in docs.columns if c not in ("_n_lines", "_n_removed")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_doc"), _row_key(id_col, text_col, site_col).alias("_row"))
    text = F.col("_doc").getField(text_col)
    # what stays are the runs between two dropped positions: one pass, however many are dropped
    cuts = F.concat(F.array(F.lit(-1)), F.col("_drop"), F.array(F.size("_split")))
    runs = F.transform(F.sequence(F.lit(0), F.size("_drop")), lambda j: F.slice(F.col("_split"), F.get(F.col("_cuts"), j) + 2, F.get(F.col("_cuts"), j + 1) - F.get(F.col("_cuts"), j) - 1))
    work = rows.join(drop.hint("merge"), "_row", "left").withColumn("_split", _lines(text.cast("string"))).withColumn("_cuts", cuts)
    left = F.when(F.col("_drop").isNull(), text).otherwise(F.array_join(F.flatten(runs), "\n"))
    n = F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(F.size("_split"))
    return work.select(
        *[left.alias(c) if c == text_col else F.col("_doc").getField(c).alias(c) for c in own],
        n.cast("long").alias("_n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("_n_removed"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.greatest(F.col("_n_removed"), F.lit(0)).alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE = f"""
WITH ln AS (
  SELECT doc_id, source, t.line AS line, t.pos AS pos, trim(t.line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS k
  FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos) t
  WHERE text IS NOT NULL),
bp AS (SELECT k FROM ln WHERE k <> '' GROUP BY k HAVING count(DISTINCT coalesce(source, chr(0))) >= {MIN_SITES}),
marked AS (
  SELECT ln.*, bp.k IS NOT NULL AND row_number() OVER (PARTITION BY ln.k ORDER BY doc_id, pos) > 1 AS gone
  FROM ln LEFT JOIN bp ON ln.k = bp.k)
SELECT d.doc_id, CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE count(m.pos) END AS n_lines,
  count(m.pos) FILTER (WHERE m.gone) AS n_removed,
  sha256(coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (WHERE NOT m.gone), '')) AS text_sha256
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id GROUP BY d.doc_id, d.text
"""

QUERIES = {"op2_line_dedup": query}
ORACLE_SQL = {"op2_line_dedup": ORACLE}

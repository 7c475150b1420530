"""URL filter: domain rules first, then association rules that FP-growth mines from labelled URLs.

A URL is a set of tokens (scheme, host labels and suffixes, path segments, file extension, query
keys).  Path segments carry their depth; those from the fourth on share one.  The URLs that a domain
rule decides are the labelled ones; FP-growth finds token combinations frequent among them, and rules
``tokens -> block`` are kept if their support and confidence are high and no kept rule with fewer
tokens says the same.  A URL that no domain rule decides is blocked if it has all tokens of a mined
rule, which an inverted index from each rule's rarest token finds; else it is allowed.

Every frequent token of every labelled URL is mined.  Tokens that n URLs share can form 2 ** n combinations, but
most of them can't matter: tokens of exactly the same URLs are mined as one, any of which then fits;
a token that is a rule by itself, or that all URLs have, is in no longer rule that says more; and a
pattern isn't grown further if it is a rule, if its last token excludes no URL, or if the allowed URLs that
have all tokens it could still get are too many for any rule (``grow``).  None of this loses a URL
that some combination blocks.  As in parallel FP-growth, a task grows the patterns of one rarest token from the
tokens before it, by frequency, of the distinct token sets that have it.

The mined rules are broadcast after a count shows at most BROADCAST_RULES of them; more are
joined by a shuffle on the token.

Defined cases: a null url or one without :// has empty host and path, no rule and no tokens, and is
allowed; rows are judged one by one, so repeated rows and null ids give a row each; without any
blocked label no rule is mined; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.tables import stored, table

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.9
BROADCAST_RULES = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: str) -> dict[str, Column]:
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    return {
        "host": F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER),
        "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
        "_scheme": F.when(at > 0, F.substring(u, F.lit(1), at - 1)),
        "_query": F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1),
    }


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest domain rule that fits host and path, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def tokens() -> Column:
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    named = F.transform(segments, lambda s, i: F.concat(F.lit("p"), F.least(i, F.lit(3)).cast("string"), F.lit(":"), F.regexp_replace(s, "[0-9]+", "#")))
    keys = F.transform(F.filter(F.split("_query", "&"), lambda x: x != ""), lambda q: F.concat(F.lit("q:"), F.regexp_extract(q, "^[^=]*", 0)))
    suffix = F.when(F.size(labels) >= 2, F.array(F.concat(F.lit("d:"), F.array_join(F.slice(labels, -2, 2), ".")))).otherwise(F.array().cast("array<string>"))
    every = F.concat(
        F.array_compact(F.array(F.concat(F.lit("s:"), F.col("_scheme")))),
        F.transform(labels, lambda x: F.concat(F.lit("h:"), x)), suffix, named, keys,
    )
    return F.when(F.col("_scheme").isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(every))


def frequent(labelled: DataFrame, n: int) -> DataFrame:
    """(token, n, b, twins) of the tokens of enough blocked URLs, one for all that have the same URLs; n, b: its URLs, and the blocked ones."""
    each = labelled.select("row", "verdict", F.explode("tokens").alias("token"))
    block = (F.col("verdict") == "block").cast("long")
    # at most (tokens of a URL) / MIN_SUPPORT tokens are frequent, whatever the number of URLs; same: which URLs a token is in
    same = F.struct(F.sum(F.xxhash64("row") % (1 << 31)), F.bit_xor(F.xxhash64("row", F.lit(1))))
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(block).alias("b"), same.alias("same")).where(F.col("b") >= MIN_SUPPORT * n)
    alone = counts.groupBy("same", "n", "b").agg(F.min("token").alias("token"), F.collect_list("token").alias("twins"))
    return stored(alone.select("token", "n", "b", "twins"), "tokens")


def grow(has: np.ndarray, a: np.ndarray, b: np.ndarray, least: float, need: tuple[int, ...] = (), left: np.ndarray | None = None):
    """Sets of columns that make a rule and don't contain a rule found on the way; has: (token sets, columns), a, b: allowed and blocked URLs of each set, least: blocked URLs of a rule."""
    left = np.arange(has.shape[1]) if left is None else left
    n_a, n_b = a.sum(), b.sum()
    own_a, own_b = a @ has, b @ has
    # a token that excludes no URL adds nothing to this pattern or a longer one
    some = (own_b >= least) & ((own_a < n_a) | (own_b < n_b))
    rule = some & (own_b / np.maximum(own_a + own_b, 1) >= MIN_CONFIDENCE)
    for i in np.flatnonzero(rule):
        yield (*need, int(left[i]))
    on = np.flatnonzero(some & ~rule)
    # the purest last: they are added to all others, and leave the least to be tried
    on = on[np.argsort(own_b[on] / (own_a[on] + own_b[on]), kind="stable")]
    left, has = left[on], has[:, on]
    for i in range(len(on) - 1):
        rows = has[:, i] > 0
        rest, x, y = has[rows, i + 1 :], a[rows], b[rows]
        # the allowed URLs with all further tokens stay whatever is added
        stay = x[rest.all(axis=1)].sum()
        if y.sum() / (y.sum() + stay) < MIN_CONFIDENCE:
            continue
        keys = np.packbits(rest, axis=1)
        _, first, to = np.unique(keys.view(f"V{keys.shape[1]}").ravel(), return_index=True, return_inverse=True)
        sums = [np.bincount(to, w, len(first)).astype(np.int64) for w in (x, y)]
        yield from grow(rest[first], *sums, least, (*need, int(left[i])), left[i + 1 :])


def patterns(sets: DataFrame, least: float) -> DataFrame:
    """(need) of the rules of two tokens or more; sets: distinct (items, a, b), items by frequency, the most frequent first."""
    at = F.posexplode("items").alias("i", "anchor")
    each = sets.select("items", "a", "b", at).where("i > 0").groupBy("anchor", F.slice("items", F.lit(1), F.col("i")).alias("before")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))

    def run(key, group):
        before = group.column("before").combine_chunks()
        a, b = (group.column(c).to_numpy().astype(np.int64) for c in "ab")
        names = before.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(a)), before.value_lengths().to_numpy())
        codes = names.indices.to_numpy()
        own = np.bincount(codes, b[row], len(names.dictionary))
        kept = np.flatnonzero(own >= least)
        column = np.full(len(own), -1)
        column[kept] = np.arange(len(kept))
        on = column[codes] >= 0
        has = np.zeros((len(a), len(kept)), np.uint8)
        has[row[on], column[codes[on]]] = 1
        tokens, anchor = names.dictionary.take(pa.array(kept)).to_pylist(), key[0].as_py()
        found = [sorted([anchor, *(tokens[i] for i in need)]) for need in grow(has, a, b, least)]
        return pa.table({"need": pa.array(found, pa.list_(pa.string()))})

    return each.groupBy("anchor").applyInArrow(run, "need array<string>")


def mine(labelled: DataFrame) -> DataFrame:
    """(rule_id, need, any_of, anchor) of the pruned rules, a row for each token that the rule is indexed by; labelled: (row, tokens, verdict).

    any_of has, for each token that a rule needs, all that are as good.
    """
    block = (F.col("verdict") == "block").cast("long")
    n, n_block = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum(block), F.lit(0))).first()
    if not n_block:
        none = labelled.sparkSession.createDataFrame([], "need array<string>")
        return none.select(F.lit(0).cast("long").alias("rule_id"), "need", F.array("need").alias("any_of"), F.lit("").alias("anchor"))
    some = frequent(labelled, n)
    alone = F.col("b") / F.col("n") >= MIN_CONFIDENCE
    inside = some.where(~alone & (F.col("n") < n)).select("token", (-F.col("n")).alias("order"))
    found = labelled.select("row", block.alias("b"), F.explode("tokens").alias("token")).join(F.broadcast(inside), "token")
    items = F.transform(F.array_sort(F.collect_list(F.struct("order", "token"))), lambda x: x["token"])
    sets = found.groupBy("row", "b").agg(items.alias("items")).groupBy("items").agg(F.sum(1 - F.col("b")).alias("a"), F.sum("b").alias("b"))
    rules = stored(some.where(alone).select(F.array("token").alias("need")).unionAll(patterns(sets, MIN_SUPPORT * n)), "rules")
    # a rule is kept unless dropping one token leaves a rule that is as good: subsets of kept rules are rules themselves
    shorter = rules.select(F.explode("need").alias("out"), "need").select("need", F.array_remove(F.col("need"), F.col("out")).alias("less"))
    covered = shorter.join(rules.select(F.col("need").alias("less")), "less").select("need").distinct()
    kept = rules.join(covered, "need", "left_anti").withColumn("rule_id", F.xxhash64("need"))
    each = kept.select("rule_id", "need", F.explode("need").alias("token")).join(F.broadcast(some), "token")
    rarest = F.min(F.struct("n", "token", "twins"))["twins"]
    return each.groupBy("rule_id", "need").agg(F.collect_list("twins").alias("any_of"), rarest.alias("anchors")).select("rule_id", "need", "any_of", F.explode("anchors").alias("anchor"))


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict) of each row."""
    rule, verdict = rule_columns(rules)
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col), *[c.alias(n) for n, c in parts(url_col).items()])
    rows = rows.select("row", id_col, "host", "path", rule.alias("rule"), verdict.alias("verdict"), tokens().alias("tokens"))
    mined = stored(mine(rows.where(F.col("rule").isNotNull()).select("row", "tokens", "verdict")), "mined-rules")
    if mined.count() <= BROADCAST_RULES:
        mined = F.broadcast(mined)
    # rows that a domain rule decides need no look-up; the empty token keeps each row
    look = F.when(F.col("rule").isNull(), F.concat(F.array(F.lit("")), F.col("tokens"))).otherwise(F.array(F.lit("")))
    each = rows.withColumn("token", F.explode_outer(look))
    met = each.join(mined, F.col("token") == F.col("anchor"), "left").where((F.col("token") == "") | F.forall("any_of", lambda some: F.arrays_overlap(some, F.col("tokens"))))
    found = met.groupBy("row", id_col, "host", "path", "rule", "verdict").agg(F.max(F.when(F.col("rule_id").isNotNull(), 1).otherwise(0)).alias("blocked"))
    return found.select(id_col, "host", "path", "rule", F.coalesce("verdict", F.when(F.col("blocked") == 1, "block").otherwise("allow")).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


QUERIES = {"op4_url_filter": query}
ORACLE_SQL: dict[str, str] = {}

"""Benchmark decontamination in DataFrame functions only: SimHash of item-sized windows, exact verification.

A window has as many words as the benchmark item it is held against. Any window that has something in common
with an item holds one of the item's five-word shingles. Shared shingles less than an item length apart make a group; a
window before the group's smallest alignment with the item, or behind its largest, shares no more than the one there
does, so every window from the one to the other is proposed for that item, less those that hold too few shared shingles
to reach the threshold whatever their counts. This loses no pair and spares a fingerprint per word of the corpus. A
window's 64-bit SimHash is cut into RADIUS + 1 blocks: two fingerprints within RADIUS bits agree on a block, so an
equi-join on (item, block, value) finds all proposed pairs within the radius, and carries no arrays. Pairs at similarity
0.8 lie about 10 bits apart with a deviation under 3, RADIUS is 20. Candidates are verified by the exact similarity of
their weighted shingles: sum of the smaller counts over sum of the larger counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .scratch import materialize

SHINGLE, RADIUS = 5, 20
#: Benchmark shingles that are broadcast at once (about 40 bytes each). More are taken in blocks of about so many, each
#: against all documents, so the shingles of the documents are never shuffled.
BROADCAST_SHINGLES = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Array of lower-cased words; empty for null and blank texts."""
    bare = F.btrim(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def _hash(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, at + j) for j in range(k)])


def _shingles(words: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: _hash(words, i, k))


def simhash(hashes: Column) -> Column:
    """64 bits; bit b is set where most of the hashes have it set."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)),
        F.lit(0).cast("long"),
        lambda acc, b: F.when(F.size(F.filter(hashes, lambda h: F.getbit(h, b) == 1)) * 2 > F.size(hashes), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(acc),
    )


def _blocks(print_: Column) -> Column:
    """(block, value) of the RADIUS + 1 blocks."""
    count = RADIUS + 1
    edges = [64 * i // count for i in range(count + 1)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(print_, a).bitwiseAND((1 << (b - a)) - 1).alias("value")) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))])


def _numbered(rows: DataFrame, keys: list[str], hashes: str, out: str) -> DataFrame:
    """rows' keys and `out`: the hashes, of which repeats are told apart by their number, so that counts of a multiset
    become members of a set."""
    one = rows.select(*keys, F.explode(hashes).alias("h"))
    each = one.withColumn("time", F.row_number().over(Window.partitionBy(*keys, "h").orderBy("h")))
    return each.groupBy(*keys).agg(F.collect_list(F.xxhash64("h", "time")).alias(out))


def _starts(hits: DataFrame, k: int, threshold: float) -> DataFrame:
    """(row, which, n, start, aligned): windows that can reach the threshold, of hits (row, which, n, size, p, start), where
    `start` is the window that puts the shared shingle at p in its item's place."""
    own = ["row", "which", "n", "size"]
    apart = F.col("p") - F.lag("p").over(Window.partitionBy(*own).orderBy("p", "start")) >= F.col("n")
    group = F.sum(F.coalesce(apart.cast("int"), F.lit(0))).over(Window.partitionBy(*own).orderBy("p", "start"))
    groups = hits.withColumn("part", group).groupBy(*own, "part").agg(F.min("start").alias("first"), F.max("start").alias("last"), F.collect_set("p").alias("held"), F.collect_set("start").alias("at"))
    inside = lambda s: F.greatest(F.lit(0), F.least(s, F.col("size") - F.col("n")))
    starts = groups.withColumn("start", F.explode(F.array_distinct(F.transform(F.sequence("first", "last"), inside))))
    shingles = F.least("n", "size") - k + 1
    shared = F.size(F.filter("held", lambda p: (p >= F.col("start")) & (p < F.col("start") + shingles)))
    reach = shared * (1 + threshold) >= threshold * (shingles + F.col("n") - k + 1) - 1e-6
    aligned = F.array_contains(F.transform("at", inside), F.col("start"))
    return starts.where((shared > 0) & reach).groupBy("row", "which", "n", "start").agg(F.max(aligned).alias("aligned"))


def contamination(docs: DataFrame, items: DataFrame, threshold: float = 0.8, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity) of each document and item of which a window reaches the threshold.

    `start` is the first word of the best window; among equals those at an alignment of a shared shingle come first, then
    the earliest. n_words is its length: the item's, or
    the document's if that is shorter. An item of fewer than five words is one shingle of all its words. Null or
    blank texts match nothing; rows with equal doc_id count as one document; a null doc_id is kept as such. Rows
    that repeat an item_id with other words are windows of their own, of which the best counts. `by` names the
    columns that tell documents apart, here and in the result. Other columns don't matter.
    """
    spark = docs.sparkSession
    bench = items.select("item_id", words_of(F.col("text")).alias("item")).distinct().select("item_id", "item", F.size("item").alias("n"), F.least(F.lit(SHINGLE), F.size("item")).alias("k"), F.xxhash64("item").alias("which"))
    bench = materialize(bench, "items")
    facts = bench.where("k > 0").groupBy("k").agg(F.sum(F.col("n") - F.col("k") + 1).alias("shingles")).collect()  # five rows at most
    texts = docs.select(*by, F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64(*by, "text"))

    found = None
    for k, shingles in sorted((r["k"], r["shingles"]) for r in facts):
        # Each step is written, or Catalyst would move copies of its costly expressions into filters below joins.
        own = bench.where(F.col("k") == k).select("which", "n", _shingles(F.col("item"), k).alias("hashes")).dropDuplicates(["which"])
        own = materialize(own, "shingles")
        own = materialize(own.withColumn("item_print", simhash(F.col("hashes"))), "prints")
        keys = own.select("which", "n", F.posexplode("hashes").alias("q", "h"))
        # The words are bound to a variable, or each access to one of them would cut the text anew.
        shingled = lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.struct(_hash(w, i, k).alias("h"), F.size(w).alias("size"))))  # noqa: B023, E731
        every = F.get(F.transform(F.array(words_of(F.col("text"))), shingled), F.lit(0))
        at = texts.select("row", F.posexplode(every).alias("p", "x")).select("row", F.col("x.size").alias("size"), "p", F.col("x.h").alias("h"))
        blocks, hits = -(-shingles // BROADCAST_SHINGLES), None
        for b in range(blocks):
            block = F.broadcast(keys.where(F.pmod(F.xxhash64("which", "q"), F.lit(blocks)) == b))  # its size is bounded
            part = materialize(at.join(block, "h").select("row", "which", "n", "size", "p", (F.col("p") - F.col("q")).alias("start")).distinct(), "hits")
            hits = part if hits is None else hits.union(part)
        proposed = materialize(_starts(hits, k, threshold), "starts")
        there = proposed.select("row", "n", "start").distinct().withColumnRenamed("row", "row_")
        met = texts.join(there, F.col("row") == F.col("row_")).select("row", "n", "start", F.slice(words_of(F.col("text")), F.col("start") + 1, F.col("n")).alias("window"))
        windows = materialize(met.dropDuplicates(["row", "n", "start"]), "windows")
        windows = materialize(windows.select("row", "n", "start", F.size("window").alias("n_words"), _shingles(F.col("window"), k).alias("own")), "own")
        prints = windows.select("row", "n", "start", "n_words", simhash(F.col("own")).alias("print"))
        left = materialize(proposed.join(prints, ["row", "n", "start"]), "prints")
        left = left.select("*", F.inline(_blocks(F.col("print"))))
        right = own.select("which", "item_print", F.inline(_blocks(F.col("item_print"))))
        near = left.join(right, ["which", "block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
        near = materialize(near.select("row", "n", "start", "n_words", "aligned", "which").distinct(), "near")
        members = _numbered(windows.join(near.select("row", "n", "start").distinct(), ["row", "n", "start"]), ["row", "n", "start"], "own", "own")
        both = near.join(members, ["row", "n", "start"]).join(_numbered(own, ["which"], "hashes", "hashes"), "which")
        common = F.size(F.array_intersect("own", "hashes"))
        scored = both.select("row", "which", "start", "n_words", "aligned", (common / (F.size("own") + F.size("hashes") - common)).alias("similarity"))
        found = scored if found is None else found.union(scored)
    if found is None:
        kinds = [StructField(c, docs.schema[c].dataType) for c in by] + [StructField("item_id", items.schema["item_id"].dataType), StructField("start", LongType()), StructField("n_words", LongType()), StructField("similarity", DoubleType())]
        return spark.createDataFrame([], StructType(kinds))
    found = materialize(found.where(F.col("similarity") >= threshold), "scored")
    named = found.join(bench.select("item_id", "which"), "which").withColumnRenamed("row", "row_")
    named = texts.select(*by, "row").distinct().join(named, F.col("row") == F.col("row_"))
    best = named.groupBy(*by, "item_id").agg(F.max(F.struct("similarity", "aligned", (-F.col("start")).alias("early"), "n_words")).alias("b"))
    return best.select(*by, "item_id", (-F.col("b.early")).cast("long").alias("start"), F.col("b.n_words").cast("long").alias("n_words"), F.round("b.similarity", 6).alias("similarity"))


#: DuckDB SQL for all windows from an item's first alignment to its last, without fingerprints.
ORACLE = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
b AS (SELECT *, row_number() OVER () AS iid FROM (SELECT item_id, ws AS item, len(ws) AS n, least(5, len(ws)) AS k FROM (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM benchmark) WHERE len(ws) > 0)),
bs AS (SELECT iid, n, k, q, array_to_string(item[q + 1 : q + k], ' ') AS s FROM (SELECT *, unnest(range(0, n - k + 1)) AS q FROM b)),
ks AS (SELECT DISTINCT k FROM b),
ds AS (SELECT doc_id, k, p, len(ws) AS size, array_to_string(ws[p + 1 : p + k], ' ') AS s FROM (SELECT doc_id, ws, k, unnest(range(0, len(ws) - k + 1)) AS p FROM w, ks WHERE len(ws) >= k)),
al AS (SELECT DISTINCT doc_id, iid, bs.n, bs.k, greatest(0, least(p - q, size - bs.n)) AS start FROM ds JOIN bs ON ds.s = bs.s AND ds.k = bs.k),
rg AS (SELECT doc_id, iid, n, k, unnest(range(min(start), max(start) + 1)) AS start FROM al GROUP BY doc_id, iid, n, k),
win AS (SELECT *, row_number() OVER () AS wid FROM (SELECT DISTINCT doc_id, n, k, start, ws[start + 1 : start + n] AS win FROM (SELECT DISTINCT doc_id, n, k, start FROM rg) JOIN w USING (doc_id))),
wc AS (SELECT wid, s, count(*) AS c FROM (SELECT wid, array_to_string(win[i + 1 : i + k], ' ') AS s FROM (SELECT *, unnest(range(0, len(win) - k + 1)) AS i FROM win)) GROUP BY ALL),
ic AS (SELECT iid, s, count(*) AS c FROM bs GROUP BY ALL),
hit AS (SELECT wid, rg.iid, sum(least(wc.c, ic.c)) AS common FROM rg JOIN win USING (doc_id, n, k, start) JOIN wc USING (wid) JOIN ic ON ic.iid = rg.iid AND ic.s = wc.s GROUP BY ALL),
sim AS (SELECT win.doc_id, b.item_id, win.start, len(win) AS n_words, common / ((len(win) - win.k + 1) + (b.n - b.k + 1) - common) AS similarity, al.start IS NOT NULL AS aligned
  FROM hit JOIN win USING (wid) JOIN b USING (iid) LEFT JOIN al ON al.doc_id = win.doc_id AND al.iid = hit.iid AND al.start = win.start)
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start, CAST(n_words AS BIGINT) AS n_words, round(similarity, 6) AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, aligned DESC, start) AS r FROM sim WHERE similarity >= 0.8) WHERE r = 1
"""

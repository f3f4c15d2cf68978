"""Operator 2: mixing sources to target weights, with hash-threshold histograms.

Every document has a fixed hash. Per source, words are summed by hash bucket;
the bucket in which the running sum passes the budget is the boundary bucket,
and only its documents are summed again by their next hash bits, level by
level, until a bucket holds a single hash value. A document is then taken by
comparing its hash with its source's threshold: nothing is sorted, and what is
shuffled is at most a bucket row per source and task.

A budget above the source's size takes every document once, and the rest of it
as a second, nested pass. The boundary hash value itself is taken if that
brings the source closer to its target (a tie: left out). The hash is of doc_id,
text and, where rows repeat both within a source, the row's number among those,
so rows of one id, or without any, are dealt one by one; which of several equal
rows gets which number makes no difference. A null doc_id or text hashes like an
empty one. A null source is a source of its own, last in order. Null and empty
texts have size 0. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.llm.common import WORD_PATTERN, discard, materialize, table, words_of

WEIGHTS = (3, 1, 2)
#: Share of all words that the mix takes, and how often a source may repeat.
SHARE, REPEATS = 1.5, 2
#: Hash bits, and bits of one level of the histogram.
HASH_BITS, LEVEL_BITS = 60, 12


def row_key(doc_id: Column, text: Column) -> Column:
    """md5 digests of doc_id and text, in hex."""
    return F.concat(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def row_hash(key: Column, number: Column) -> Column:
    """A 60-bit hash that SQL engines agree on: the first 15 hex digits of the md5 of key and number."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), number.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def numbered(rows: DataFrame) -> DataFrame:
    """row, number of all rows (source, key, row) that are not alone with their source and key, counted from 0.

    In two levels, as such rows may be many: within the task that read them
    (``row`` is its number and the row's place in it), and over the tasks' counts.
    """
    at = [F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("of"), "key"]
    task = F.shiftright("row", 33).alias("task")
    counts = rows.groupBy(*at, task).agg(F.count("*").alias("n"))
    order = Window.partitionBy("of", "key").orderBy("task")
    base = counts.withColumn("before", F.sum("n").over(order) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy("of", "key"))).filter("all > 1")
    rows = rows.select(*at, task, "row").join(base, ["of", "key", "task"])
    own = F.row_number().over(Window.partitionBy("of", "key", "task").orderBy("row")) - 1
    return rows.select(F.col("row").alias("again"), (F.col("before") + own).alias("number"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target: the share of all words, dealt by weight under a cap.

    Dealing what exceeds the caps again, by weight, until no target is above its
    cap gives min(cap, level * weight) for one level; it is found from running
    sums over the sources in order of cap / weight. There is a row per source,
    which is what the unpartitioned windows here run over.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(repeats)).withColumn("at", F.col("cap") / F.col("weight"))
    total = Window.partitionBy()
    order = Window.orderBy("at", F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "*",
        (F.sum("source_size").over(total) * F.lit(share)).alias("budget"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("full"),
        (F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open"),
        F.row_number().over(order).alias("place"),
    )
    level = (F.col("budget") - F.col("full")) / F.col("open")
    per = per.withColumn("level", F.min(F.when(level <= F.col("at"), F.struct("place", level.alias("level")))).over(total)["level"])
    return per.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))).alias("target"))


def thresholds(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """source, low, pass_low: documents with a hash below ``low`` are taken once more than ``passes``."""

    goal = goal.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")).cast("int")).otherwise(F.lit(1))).withColumn("need", F.col("target") - F.col("passes") * F.col("source_size"))
    edge = goal.select(F.col("source").alias("edge_source"), "need", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("gone"))
    rows = sized.select("source", "hash", "size").filter(F.col("size") > 0)
    for bits in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        # Of the rows still at the boundary, words by the next bits; each source has at most 2**LEVEL_BITS buckets.
        bucket = F.shiftright("hash", bits)
        sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
        joined = sums.join(edge, F.col("source").eqNullSafe(F.col("edge_source")))
        order = Window.partitionBy("source").orderBy("bucket")
        running = joined.withColumn("upto", F.col("gone") + F.sum("size").over(order))
        # The first bucket whose running sum passes the need.
        found = running.filter(F.col("upto") > F.col("need")).groupBy("edge_source").agg(F.min(F.struct("bucket", "upto", "size", "need")).alias("b"))
        edge = found.select("edge_source", F.col("b.need").alias("need"), F.shiftleft("b.bucket", bits).alias("low"), (F.col("b.upto") - F.col("b.size")).alias("gone"), F.col("b.size").alias("last"))
        edge = materialize(edge, "mix-edge")
        if bits:
            near = edge.select("edge_source", F.shiftright("low", bits).alias("edge_bucket"))
            rows = rows.join(near, F.col("source").eqNullSafe(F.col("edge_source")) & (bucket == F.col("edge_bucket"))).select("source", "hash", "size")
            rows = materialize(rows, "mix-near")
    # The last boundary is one hash value: taken if that is nearer than leaving it.
    low = F.col("low") + F.when(F.col("gone") + F.col("last") - F.col("need") < F.col("need") - F.col("gone"), 1).otherwise(0)
    edge = edge.select("edge_source", low.alias("low"))
    return goal.join(edge, F.col("source").eqNullSafe(F.col("edge_source")), "left").select(F.col("source").alias("goal_source"), "source_size", "target", "passes", F.coalesce("low", F.lit(0)).alias("low"))


def sizes(docs: DataFrame) -> Column:
    """Words of each text (null: 0), counted JVM-side."""
    return F.size(words_of(F.col("text"))).cast("long")


#: Sources whose thresholds may be broadcast (a row of under 1 kB each).
BROADCAST_SOURCES = 50_000


def mix(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, hash, copies (and the columns to keep) of every row.

    Rows are written once with their size and key; all else works on narrow
    columns of that table, and the verdict is a filter by its source's threshold.
    """
    columns = [c for c in keep if c not in ("doc_id", "source")]
    sized = materialize(docs.select("doc_id", "source", *columns, sizes(docs).alias("_size"), row_key(F.col("doc_id"), F.col("text")).alias("_key"), F.monotonically_increasing_id().alias("_row")), "mix-rows")
    again = materialize(numbered(sized.select("source", F.col("_key").alias("key"), F.col("_row").alias("row"))), "mix-again")
    if again.limit(1).count():
        rows = sized.join(again, F.col("_row") == F.col("again"), "left")
        hashed = rows.withColumn("_hash", row_hash(F.col("_key"), F.coalesce("number", F.lit(0))))
    else:
        hashed = sized.withColumn("_hash", row_hash(F.col("_key"), F.lit(0)))
    narrow = materialize(hashed.select("source", F.col("_hash").alias("hash"), F.col("_size").alias("size")), "mix-sized")
    goal = materialize(targets(narrow), "mix-goal")
    cut = materialize(thresholds(narrow, goal), "mix-cut")
    discard(narrow)
    if cut.count() <= BROADCAST_SOURCES:
        cut = F.broadcast(cut)
    copies = F.col("passes") + F.when(F.col("_hash") < F.col("low"), 1).otherwise(0)
    out = hashed.join(cut, F.col("source").eqNullSafe(F.col("goal_source"))).withColumn("copies", F.least(copies, F.lit(REPEATS)))
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("copies")).cast("long").alias("taken"), "source", F.col("_hash").alias("hash"), "copies", *columns)


def dealt(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The rows that the mix takes, with the columns to keep: one taken twice stands twice."""
    return mix(docs, keep).filter("copies > 0").select(*keep, F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select(*keep)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: Sort-based: documents by hash within their source, taken while the running sum is nearer to the need.
OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, size, ('0x' || substr(md5(key || ':' || (row_number() OVER (PARTITION BY source, key) - 1)::VARCHAR), 1, 15))::BIGINT AS hash
  FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}'))::BIGINT AS size,
               md5(coalesce(doc_id::VARCHAR, '')) || md5(coalesce(text, '')) AS key FROM documents)),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
        [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
w AS (SELECT *, 2 * source_size AS cap, 2 * source_size / weight AS at_level FROM s),
r AS (SELECT *, (sum(source_size) OVER ()) * 1.5 AS budget,
        coalesce(sum(cap) OVER o, 0) AS gone, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS open_weight,
        row_number() OVER (ORDER BY at_level, source NULLS LAST) AS place
      FROM w WINDOW o AS (ORDER BY at_level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((budget - gone) / open_weight, place) AS level FROM r WHERE (budget - gone) / open_weight <= at_level),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, level * weight) END AS target FROM r, l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 1 END AS passes FROM t),
h AS (SELECT source, hash, sum(size) AS hash_size FROM d GROUP BY source, hash),
c AS (SELECT source, hash, hash_size, sum(hash_size) OVER (PARTITION BY source ORDER BY hash) AS upto FROM h),
k AS (SELECT c.source, c.hash, upto <= need OR (before < need AND upto - need < need - before) AS more
      FROM (SELECT *, upto - hash_size AS before FROM c) c
      JOIN (SELECT source, target - passes * source_size AS need FROM g) n ON c.source IS NOT DISTINCT FROM n.source)
SELECT d.doc_id, d.size, g.source_size, g.target,
       (d.size * least(2, g.passes + CASE WHEN k.more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
JOIN k ON k.source IS NOT DISTINCT FROM d.source AND k.hash = d.hash
"""

"""The log: routing, offsets, ranged and budgeted reads, time lookup, indexes, retention, recovery."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.functions import scalars as S
from strandlog.functions import wire
from strandlog.model import EARLIEST, LATEST, LOG, MAX_SEGMENT, READ_COMMITTED


def route(df: DataFrame, partitions: int) -> DataFrame:
    """A partition for every record: by key, or by batch for null keys."""
    by_batch = (F.col("batch_id") % partitions).cast("int")
    return df.withColumn("partition", F.when(F.col("key").isNull(), by_batch).otherwise(S.partition_for_key(F.col("key"), partitions)))


def running(df: DataFrame, value: Column, name: str, keys: tuple = LOG, chunk: str = "batch_id", order: str = "seq") -> DataFrame:
    """Exclusive running sum per key in two levels: within chunks, and over the chunks' totals.

    A partition's rows need not meet in one task: chunks are summed apart, and
    only a row per chunk is ordered over the whole partition.
    """
    at = [*keys, chunk]
    sums = df.groupBy(*at).agg(F.sum(value).alias("_sum"), F.min(order).alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*at, F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast("long").alias("_base"))
    inner = Window.partitionBy(*at).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_own", F.coalesce(F.sum(value).over(inner), F.lit(0)).cast("long")).join(base, at)
    return out.withColumn(name, F.col("_base") + F.col("_own")).drop("_base", "_own")


def scanned(df: DataFrame, values: dict[str, tuple[str, Column]], keys: list[str], order: Column, chunk: Column) -> DataFrame:
    """Running results per key, this row included, in two levels as in ``running``.

    ``values`` names columns, each a kind ("max", "min", or "last", the last value
    that is not null) and a value. ``chunk`` must not fall as ``order`` rises; a
    task orders the rows of one chunk, and a row per chunk is ordered over a key.
    """
    at = [*keys, "_chunk"]
    df = df.withColumn("_chunk", chunk).withColumn("_order", order).withColumns({f"_v_{n}": v for n, (_, v) in values.items()})
    own = {n: F.col(f"_v_{n}") for n in values}
    total = {"max": F.max, "min": F.min, "last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("_order")))}
    over = {"max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
    join = {"max": F.greatest, "min": F.least, "last": F.coalesce}
    sums = df.groupBy(*at).agg(*(total[kind](own[n]).alias(f"_t_{n}") for n, (kind, _) in values.items()))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*at, *(over[kind](F.col(f"_t_{n}")).over(before).alias(f"_b_{n}") for n, (kind, _) in values.items()))
    inner = Window.partitionBy(*at).orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(base, at).withColumns({n: join[kind](over[kind](own[n]).over(inner), F.col(f"_b_{n}")) for n, (kind, _) in values.items()})
    return out.drop("_chunk", "_order", *(f"_{k}_{n}" for k in "vb" for n in values))


def assign_offsets(df: DataFrame, high: DataFrame | None = None) -> DataFrame:
    """Dense offsets per partition, after the ends in ``high`` (topic, partition, log_end) if given."""
    out = running(df, F.lit(1), "offset")
    if high is None:
        return out
    ends = high.select(*LOG, F.col("log_end").alias("_end"))
    return out.join(ends, list(LOG), "left").withColumn("offset", F.col("offset") + F.coalesce("_end", F.lit(0))).drop("_end")


def produce_status(records: DataFrame, declared: DataFrame) -> DataFrame:
    """topic, partition, batch_id, n, status of each produced batch (rows with ``data``) against its declared count.

    A batch without records, or with another number of them than declared, is
    INVALID_ARGUMENT, one with a malformed record CORRUPTION. Checksums are not
    read: the log writes its own (see ``append_bytes``).
    """
    read = wire.parsed(records)
    seen = read.groupBy(*LOG, "batch_id").agg(F.count("*").alias("n"), F.count_if(~F.col("verdict").isin("OK", "CORRUPT")).alias("bad"))
    out = declared.join(seen, [*LOG, "batch_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when((F.col("n") == 0) | (F.col("declared") == 0), "INVALID_ARGUMENT").when(F.col("bad") > 0, "CORRUPTION").when(F.col("n") != F.col("declared"), "INVALID_ARGUMENT").otherwise("OK")
    return out.select(*LOG, "batch_id", "n", status.alias("status"))


def append_bytes(records: DataFrame) -> DataFrame:
    """Produced records under the offsets and times that the log gives them (``offset``, ``timestamp_ms``), with checksums anew."""
    return records.withColumn("data", wire.rewrite_header(F.col("data"), F.col("offset"), F.col("timestamp_ms")))


def append_vectored(parts: list[DataFrame], high: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts of one append, in order: the rows that continue the log without a gap, and each partition's verdict.

    The parts are one run of offsets; a partition whose run does not begin at the
    log's end, or has a gap (across the parts' edges too), is OUT_OF_RANGE whole.
    """
    rows = parts[0].withColumn("part", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        rows = rows.unionByName(p.withColumn("part", F.lit(k)))
    sums = rows.groupBy(*LOG).agg(F.min("offset").alias("base"), F.max("offset").alias("last"), F.count("*").alias("n"), F.countDistinct("offset").alias("distinct"), F.max("part").alias("parts"))
    dense = (F.col("base") == F.col("log_end")) & (F.col("last") - F.col("base") + 1 == F.col("n")) & (F.col("distinct") == F.col("n"))
    verdict = sums.join(high.select(*LOG, "log_end"), list(LOG)).withColumn("status", F.when(dense, "OK").otherwise("OUT_OF_RANGE"))
    return rows.join(verdict.filter("status = 'OK'").select(*LOG), list(LOG), "left_semi"), verdict


def checked_batches(records: DataFrame) -> DataFrame:
    """One row per pushed batch: base, last, n, and ``crc_ok``, whether all of its records' bytes are whole and hold their offsets."""
    read = wire.parsed(records)
    good = (F.col("verdict") == "OK") & (F.col("record.offset") == F.col("offset"))
    return read.groupBy(*LOG, "batch_id").agg(F.min("offset").alias("base"), F.max("offset").alias("last"), F.count("*").alias("n"), F.every(F.coalesce(good, F.lit(False))).alias("crc_ok"))


def accept_batches(batches: DataFrame, ends: DataFrame, epoch: int) -> DataFrame:
    """A follower's verdict on each pushed batch: NOT_LEADER, PROBE, OUT_OF_RANGE, CORRUPT or APPENDED."""
    out = batches.join(ends.select(*LOG, "log_end"), list(LOG))
    verdict = F.when(F.col("epoch") < epoch, "NOT_LEADER").when((F.col("n") == 0) & (F.col("base") == F.col("log_end")), "PROBE").when(F.col("base") != F.col("log_end"), "OUT_OF_RANGE").when(~F.col("crc_ok") | (F.col("last") - F.col("base") + 1 != F.col("n")), "CORRUPT").otherwise("APPENDED")
    return out.withColumn("verdict", verdict)


def resolve_start(start: Column, isolation: Column) -> Column:
    """The offset that a read begins at; sentinels stand for the log's start and its visible end."""
    visible = F.when(isolation == READ_COMMITTED, F.col("hwm")).otherwise(F.col("log_end"))
    return F.when(start == EARLIEST, F.col("log_start")).when(start == LATEST, visible).otherwise(start)


#: Offsets of a stretch, the unit by which reads and as-of lookups are dealt out.
STRETCH = 1 << 13
#: Milliseconds of a stretch of time.
TIME_STRETCH = 60_000


def fetch(records: DataFrame, state: DataFrame, requests: DataFrame) -> DataFrame:
    """Records of each request (req_id, topic, partition, start, max_bytes, isolation).

    A record is kept if the bytes before it, from the start, are less than the
    budget; the budget applies before the cut at the visible end. Requests out
    of range give nothing here (see ``bounds_error``). A request meets only the
    records of the stretches of offsets that its budget can reach.
    """
    r = requests.join(state, list(LOG)).withColumn("from_offset", resolve_start(F.col("start"), F.col("isolation")))
    r = r.filter(F.col("from_offset").between(F.col("log_start"), F.col("log_end"))).withColumn("visible", F.when(F.col("isolation") == READ_COMMITTED, F.col("hwm")).otherwise(F.col("log_end")))
    # A record takes 27 bytes at least, so an offset bound prunes before bytes are summed; the first record always stays.
    span = F.floor(F.col("max_bytes") / 27) + 1
    r = r.withColumn("upto", F.col("from_offset") + span).withColumn("stretch", F.explode(F.sequence(F.floor(F.col("from_offset") / STRETCH), F.floor(F.least(F.col("upto"), F.col("log_end")) / STRETCH))))
    rows = records.withColumn("stretch", F.floor(F.col("offset") / STRETCH)).join(r, [*LOG, "stretch"]).filter(F.col("offset").between(F.col("from_offset"), F.col("upto"))).drop("stretch", "upto")
    before = Window.partitionBy("req_id").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("bytes_before", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))
    return rows.filter((F.col("bytes_before") < F.col("max_bytes")) & (F.col("offset") < F.col("visible")))


def consume(records: DataFrame, start: Column, limit: int) -> DataFrame:
    """``limit`` records of every partition from an offset: offsets are dense, so this is a range."""
    return records.filter((F.col("offset") >= start) & (F.col("offset") < start + limit))


def gaps(records: DataFrame) -> DataFrame:
    """Records that do not follow the one before them, with ``missing``: offsets left out (negative: repeated)."""
    # In stretches; a stretch's first record is compared with the last of all before it.
    inner = Window.partitionBy(*LOG, F.floor(F.col("offset") / STRETCH)).orderBy("offset", "seq")
    tops = records.groupBy(*LOG, F.floor(F.col("offset") / STRETCH).alias("_chunk")).agg(F.max("offset").alias("_end"))
    tops = tops.withColumn("_before", F.max("_end").over(Window.partitionBy(*LOG).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    out = records.withColumn("_lag", F.lag("offset").over(inner)).withColumn("_chunk", F.floor(F.col("offset") / STRETCH)).join(tops, [*LOG, "_chunk"])
    return out.withColumn("missing", F.col("offset") - F.coalesce("_lag", "_before") - 1).filter("missing <> 0").drop("_lag", "_before", "_chunk")


def bounds_error(requests: DataFrame, state: DataFrame) -> DataFrame:
    """OK, OUT_OF_RANGE or NOT_FOUND for each request."""
    r = requests.join(state, list(LOG), "left").withColumn("from_offset", resolve_start(F.col("start"), F.col("isolation")))
    error = F.when(F.col("log_end").isNull(), "NOT_FOUND").when((F.col("from_offset") < F.col("log_start")) | (F.col("from_offset") > F.col("log_end")), "OUT_OF_RANGE").otherwise("OK")
    return r.withColumn("error", error)


def offsets_for_times(records: DataFrame, state: DataFrame, times: DataFrame) -> DataFrame:
    """First offset at or after each time (topic, partition, t), else the log's end; exact."""
    return ceiling(records.select(*LOG, F.col("timestamp_ms").alias("at"), "offset"), state, times)


def ceiling(entries: DataFrame, state: DataFrame, times: DataFrame) -> DataFrame:
    """The least offset of the entries (topic, partition, at, offset) at or after each time, else the log's end.

    Entries and times stand in one order, the latest first, and the least offset
    is carried along: no pairs are made.
    """
    a = times.select(*LOG, "t", F.col("t").alias("at"), F.lit(None).cast("long").alias("offset"))
    b = entries.select(*LOG, F.lit(None).cast("long").alias("t"), "at", "offset")
    order = F.struct(-F.col("at"), F.col("t").isNotNull())
    both = scanned(a.unionByName(b), {"hit": ("min", F.col("offset"))}, list(LOG), order, F.floor(-F.col("at") / TIME_STRETCH))
    return both.filter("t IS NOT NULL").join(state.select(*LOG, "log_end"), list(LOG)).withColumn("found", F.coalesce("hit", "log_end"))


def batches_of(records: DataFrame) -> DataFrame:
    """One row per batch and partition: base, last, n, bytes, max_ts."""
    return records.groupBy(*LOG, "batch_id").agg(F.min("offset").alias("base"), F.max("offset").alias("last"), F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("timestamp_ms").alias("max_ts"))


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], step: Callable, schema: str) -> DataFrame:
    """An order-dependent fold: ``step(state, row) -> (state, output row)`` over each key's rows in order.

    Rows stream through sorted tasks with one state, so no key's rows are ever
    gathered; the state starts anew (None) with each key.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        state, last = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != last:
                    state, last = None, key
                state, made = step(state, row)
                out.append(made)
            yield pd.DataFrame(out, columns=[c.strip().split()[0] for c in schema.split(",")])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


SEGMENTED = "topic string, partition int, batch_id long, base long, last long, n long, bytes long, max_ts long, segment_base long, start long, indexed boolean"


def roll_and_index(batches: DataFrame, segment_bytes: int, index_bytes: int, segment_ms: int = 0) -> DataFrame:
    """Each batch's segment, its byte position there, and whether the sparse index gets an entry.

    A segment that holds data is closed before a batch that would overfill it, or
    that comes ``segment_ms`` (if any) or more after the segment's first; a
    batch is never split. Times are the batches' ``append_ms``, if they have it. An entry is added for a segment's first batch, then
    whenever ``index_bytes`` have passed since the last entry.
    """

    def step(state, row):
        base, used, last, since = state or (row.base, 0, None, row.append_ms)
        if used > 0 and (used + row.bytes > segment_bytes or segment_ms > 0 and row.append_ms - since >= segment_ms) or used + row.bytes > MAX_SEGMENT:
            base, used, last, since = row.base, 0, None, row.append_ms
        indexed = last is None or used - last >= index_bytes
        made = (row.topic, row.partition, row.batch_id, row.base, row.last, row.n, row.bytes, row.max_ts, base, used, indexed)
        return (base, used + row.bytes, used if indexed else last, since), made

    at = F.col("append_ms") if "append_ms" in batches.columns else F.lit(0)
    return fold_sorted(batches.select(*LOG, "batch_id", "base", "last", "n", "bytes", "max_ts", at.cast("long").alias("append_ms")), list(LOG), ["base"], step, SEGMENTED)


def segments_of(segmented: DataFrame) -> DataFrame:
    return segmented.groupBy(*LOG, "segment_base").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("records"), F.max("max_ts").alias("max_ts"), F.max("last").alias("last"))


def time_index(segmented: DataFrame) -> DataFrame:
    """Index entries whose time does not fall below an earlier entry's."""
    entries = segmented.filter("indexed")
    # Within a segment, which has few entries: its size bounds them.
    before = Window.partitionBy(*LOG, "segment_base").orderBy("base").rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("_top", F.max("max_ts").over(before)).filter("_top IS NULL OR max_ts >= _top").drop("_top")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, on: str, take: str) -> DataFrame:
    """For each left row, ``take`` of the right row with the largest ``on`` that is at most ``at`` (offsets).

    Both sides are put in one order per key, in stretches, and the last right row
    is carried forward: no row pairs are made, and a hot key is many tasks.
    """
    a = left.select(*left.columns, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[take].dataType).alias("_take"))
    b = right.select(*keys, *(F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema if f.name not in keys), F.col(on).alias("_at"), F.lit(0).alias("_side"), F.col(take).alias("_take"))
    both = scanned(a.unionByName(b), {take: ("last", F.col("_take"))}, keys, F.struct("_at", "_side"), F.floor(F.col("_at") / STRETCH))
    return both.filter("_side = 1").drop("_at", "_side", "_take")


def offsets_for_times_sparse(segmented: DataFrame, state: DataFrame, times: DataFrame) -> DataFrame:
    """The ceiling of each time on the sparse time index; it can land later than the exact answer."""
    entries = time_index(segmented).select(*LOG, F.col("max_ts").alias("entry_ts"), "base", "segment_base")
    reach = segments_of(segmented).select(*LOG, "segment_base", F.col("max_ts").alias("segment_ts"))
    # An entry serves times up to its own and its segment's last; the segment's last is no less than its entries' times.
    reached = entries.join(reach, [*LOG, "segment_base"])
    return ceiling(reached.select(*LOG, F.least("entry_ts", "segment_ts").alias("at"), F.col("base").alias("offset")), state, times)


def retention(segments: DataFrame, now_ms: int, max_age_ms: int = 0, max_bytes: int = 0) -> DataFrame:
    """Segments with ``dropped``: the longest prefix, never the last, that is too old or too much."""
    w = Window.partitionBy(*LOG).orderBy("segment_base")
    rest = F.sum("bytes").over(w.rowsBetween(0, Window.unboundedFollowing))
    old = (F.lit(max_age_ms) > 0) & (F.col("max_ts") > 0) & (F.lit(now_ms) - F.col("max_ts") > max_age_ms)
    much = (F.lit(max_bytes) > 0) & (rest > max_bytes)
    one = F.lead("segment_base").over(w).isNotNull() & (old | much)
    return segments.withColumn("_one", one).withColumn("dropped", F.min("_one").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_one")


def truncate_segments(segments: DataFrame, ends: DataFrame) -> DataFrame:
    """Segments with ``fate`` under each partition's new end: dropped if they begin at or beyond it (not the first one), cut if they hold it, else kept."""
    first = segments.groupBy(*LOG).agg(F.min("segment_base").alias("_first"))
    out = segments.join(first, list(LOG)).join(ends, list(LOG))
    fate = F.when((F.col("segment_base") >= F.col("new_end")) & (F.col("segment_base") != F.col("_first")), "DROPPED").when(F.col("last") >= F.col("new_end"), "CUT").otherwise("KEPT")
    return out.withColumn("fate", fate).drop("_first", "new_end")


def needs_flush(state: DataFrame, max_records: int = 0, max_bytes: int = 0, max_ms: int = 0) -> DataFrame:
    """Partitions with ``due``: unflushed records, bytes or time (unflushed_*, where the state has them) reach a threshold; 0 is none."""
    limits = {"unflushed_records": max_records, "unflushed_bytes": max_bytes, "unflushed_ms": max_ms}
    reached = [(F.col("unflushed_records") > 0) & (F.col(c) >= n) for c, n in limits.items() if n > 0 and c in state.columns]
    due = F.lit(False)
    for r in reached:
        due = due | r
    return state.withColumn("due", due)


def within_segment(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """Records of a read inside one segment: whole records of no more than ``max_bytes`` in all, one at least.

    ``entries``: topic, partition, segment_base, offset, position, size; requests:
    req_id, topic, partition, segment_base, start, max_bytes.
    """
    r = requests.withColumn("upto", F.floor(F.col("max_bytes") / 27) + F.col("start"))
    rows = entries.join(r, [*LOG, "segment_base"]).filter(F.col("offset").between(F.col("start"), F.col("upto")))
    first = F.first("position").over(Window.partitionBy("req_id").orderBy("offset"))
    rows = rows.withColumn("_end", F.col("position") + F.col("size") - first)
    return rows.filter((F.col("_end") <= F.col("max_bytes")) | (F.col("offset") == F.col("start"))).drop("_end", "upto")


def truncate(records: DataFrame, ends: DataFrame) -> DataFrame:
    """Records below each partition's new end (topic, partition, new_end)."""
    return records.join(ends, list(LOG)).filter(F.col("offset") < F.col("new_end")).drop("new_end")


def valid_prefix(df: DataFrame, keys: list[str], order: str, bad: Column) -> DataFrame:
    """Rows before each key's first bad one: its place is an aggregate, so no key is sorted."""
    first = df.filter(bad).groupBy(*keys).agg(F.min(order).alias("_bad"))
    return df.join(first, keys, "left").filter(F.col("_bad").isNull() | (F.col(order) < F.col("_bad"))).drop("_bad")


def inspect(stored: DataFrame) -> DataFrame:
    """Stored records (topic, partition, slot, data) with ``reason``: null, or why the log ends before this one.

    SHORT, EMPTY (space that was reserved, not written), BAD_LENGTH, CORRUPT, or
    GAP where the offset in the bytes does not follow the one before it.
    """
    read = wire.parsed(stored).withColumn("stored_offset", F.col("record.offset"))
    chunk = F.floor(F.col("slot") / STRETCH)
    inner = Window.partitionBy(*LOG, chunk).orderBy("slot")
    tops = read.groupBy(*LOG, chunk.alias("_chunk")).agg(F.max_by("stored_offset", "slot").alias("_end"))
    tops = tops.withColumn("_before", F.lag("_end").over(Window.partitionBy(*LOG).orderBy("_chunk")))
    out = read.withColumn("_lag", F.lag("stored_offset").over(inner)).withColumn("_first", F.row_number().over(inner) == 1).withColumn("_chunk", chunk)
    out = out.join(tops.select(*LOG, "_chunk", "_before"), [*LOG, "_chunk"])
    follows = F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_lag")) + 1
    gap = F.coalesce(F.col("stored_offset") != follows, F.lit(False))
    return out.withColumn("reason", F.when(F.col("verdict") != "OK", F.col("verdict")).when(gap, "GAP")).drop("_lag", "_first", "_chunk", "_before")


def recover(stored: DataFrame) -> DataFrame:
    """The records that a log keeps after a crash: those before the first with a reason to end it."""
    read = inspect(stored)
    return valid_prefix(read, list(LOG), "slot", F.col("reason").isNotNull())


def recovery_report(stored: DataFrame) -> DataFrame:
    """Per partition: records found, records kept, the next offset, why it ends there, bytes cut as damage, and bytes that were only reserved."""
    read = inspect(stored)
    first = read.filter("reason IS NOT NULL").groupBy(*LOG).agg(F.min_by("reason", "slot").alias("reason"), F.min("slot").alias("cut"))
    sums = read.drop("reason").join(first, list(LOG), "left").groupBy(*LOG).agg(
        F.count("*").alias("records"), F.max("reason").alias("reason"), F.count_if(F.col("cut").isNull() | (F.col("slot") < F.col("cut"))).alias("kept"),
        F.max(F.when(F.col("cut").isNull() | (F.col("slot") < F.col("cut")), F.col("stored_offset"))).alias("last"), F.sum(F.when(F.col("slot") >= F.col("cut"), F.octet_length("data")).otherwise(0)).alias("rest"),
    )
    empty = F.coalesce(F.col("reason") == "EMPTY", F.lit(False))
    return sums.select(*LOG, "records", "kept", (F.coalesce("last", F.lit(-1)) + 1).alias("next_offset"), "reason", F.when(empty, 0).otherwise(F.col("rest")).alias("cut_bytes"), F.when(empty, F.col("rest")).otherwise(0).alias("reserved_bytes"))


def batch_by_bytes(df: DataFrame, limit: int, count: int) -> DataFrame:
    """Producer batches: a record that would overfill the batch, or exceed its count, begins the next."""

    def step(state, row):
        number, used, n = state or (0, 0, 0)
        if n and (used + row.size > limit or n >= count):
            number, used, n = number + 1, 0, 0
        return (number, used + row.size, n + 1), (row.topic, row.partition, row.offset, row.size, number)

    return fold_sorted(df.select(*LOG, "offset", "size"), list(LOG), ["offset"], step, "topic string, partition int, offset long, size long, batch_no long")

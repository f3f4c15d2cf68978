"""Operator 9: SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``2r`` bits share a variant within ``r`` bits of both.
Every distinct fingerprint therefore emits all its variants of up to ``r``
flipped bits (2081 for r = 2), and variants that collide give links. Any two
fingerprints that share a variant are within ``2r`` bits, so a bucket links
them by a star, never by all its pairs, and loses no connection; each link is
verified all the same.

The shuffle is on a part of the variant: its syndrome under a linear code over
the 64 bit positions. Flipping bits moves the syndrome by a known amount, so a
fingerprint knows which of its variants belong to a syndrome, and one copy of
it per syndrome stands for all of them there; the receiving task flips the bits
again, and sorts and deduplicates the variants. With the 6-bit Hamming code
each copy stands for 33 variants. A task takes variants in slices of a bounded
number, by their leading bits: in sorted fingerprints those of one mask are a
range, so all slices together make every variant once. Past
``TASK_FINGERPRINTS`` fingerprints the code gets as many bits as bring a task's
expected share below that number.

Links are reduced to connected components by alternating large-star and
small-star steps over checkpointed tables. Joins by fingerprint or vertex meet
hubs and hot fingerprints (all empty texts have one): the keys of over a
thousandth of the rows, fewer than a thousand, are joined by broadcast.

Defined results: texts of fewer than four words are one shingle, texts without
words (null, empty) have fingerprint zero and link like any other; rows of
equal doc_id are one vertex each and share the component of their fingerprint;
a null doc_id never names a component unless all of its rows are null. Other
columns are ignored; an empty table gives no rows. ``keep_one`` leaves exactly
one row of each group, whatever ids repeat or are null.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strandlog.llm.common import bounded, discard, doc_bytes, materialize, table

BITS, SEED = 64, 42
#: Fingerprints of one syndrome's task, variants that it sorts at once, and links that it holds unmerged.
TASK_FINGERPRINTS, SLICE_VARIANTS, HELD_LINKS = 1 << 25, 1 << 22, 1 << 22
#: Fingerprints that a sending task packs at once, and copies of them that it sorts by syndrome.
SEND_FINGERPRINTS, SEND_COPIES = 1 << 18, 1 << 22


def fingerprint(text: bytes, size: int) -> int:
    """SimHash of the word shingles: a bit is 1 if set in over half of the hashes."""
    import numpy as np
    import xxhash

    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        hashes = [h(joined, SEED)]
    else:
        ends = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1))
        hashes = [h(joined[a:b], SEED) for a, b in zip([0, *(e + 1 for e in ends)], ends[size - 1 :])]
    n, counts = len(hashes), np.zeros(BITS, dtype=np.int64)
    planes = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    for k in range(8):
        counts[8 * k : 8 * k + 8] = np.bincount(planes[:, k], minlength=256) @ _BYTE_BITS()
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _BYTE_BITS():  # noqa: N802
    import numpy as np

    global _TABLE
    if _TABLE is None:
        _TABLE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    return _TABLE


_TABLE = None


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) for every row."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in bounded(batches):
            fps = np.array([fingerprint(t, size) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return doc_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, fp long")


def with_fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """All columns of the rows, and fp."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in bounded(batches):
            fps = np.array([fingerprint(t or b"", size) for t in b.column("text").cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps.view(np.int64))], names=[*b.schema.names, "fp"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("fp", LongType())]))


def code(bits: int) -> list[int]:
    """A syndrome for each bit position: its number, then pseudo-random bits beyond six."""
    out = []
    for i in range(BITS):
        x = (i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
        x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        out.append(i | ((x >> 20) & ((1 << bits - 6) - 1)) << 6)
    return out


@functools.lru_cache(maxsize=4)
def masks_by_syndrome(radius: int, bits: int) -> dict[int, list[int]]:
    """Every set of up to ``radius`` flips, grouped by what it adds to the syndrome."""
    columns, out = code(bits), {}
    for k in range(radius + 1):
        for flips in itertools.combinations(range(BITS), k):
            s = m = 0
            for i in flips:
                s ^= columns[i]
                m |= 1 << i
            out.setdefault(s, []).append(m)
    return out


def code_bits(n: int, radius: int) -> int:
    """Bits of the code, six at least, at which a task expects no more than ``TASK_FINGERPRINTS`` of n fingerprints."""
    bits = 6
    while n * len(masks_by_syndrome(radius, bits)) > TASK_FINGERPRINTS << bits:
        bits += 1
    return bits


def syndromes(x, bits: int):
    """The syndrome of each fingerprint (numpy, uint64), byte by byte through tables."""
    import numpy as np

    out = np.zeros(len(x), dtype=np.uint8 if bits <= 8 else np.int64)
    planes, columns = x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), code(bits)
    for k in range(8):
        lookup = np.zeros(256, dtype=out.dtype)
        for i in range(8):
            lookup[1 << i : 2 << i] = lookup[: 1 << i] ^ out.dtype.type(columns[8 * k + i])
        out ^= lookup[planes[:, k]]
    return out


def forest(a, b):
    """Edges that keep the components of the edges (a, b): each vertex to the smallest of its local component."""
    import numpy as np

    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    away = label != np.arange(len(nodes))
    return nodes[label[away]], nodes[away]


def slices(parts: list, limit: int) -> Iterator:
    """Ranges (low, high) of each part's sorted fingerprints for each of its masks, a list per slice.

    A slice holds the variants that begin with the same bits, as many bits as
    it takes for no more than ``limit`` variants (or a single value).
    """
    import numpy as np

    todo = [(0, 0)]
    while todo:
        n, lead = todo.pop()
        cut = []
        for x, masks in parts:
            if n:
                first = (np.uint64(lead) ^ (masks >> np.uint64(BITS - n))) << np.uint64(BITS - n)
                cut.append((np.searchsorted(x, first), np.searchsorted(x, first | np.uint64((1 << BITS - n) - 1), side="right")))
            else:
                cut.append((np.zeros(len(masks), dtype=np.int64), np.full(len(masks), len(x))))
        total = sum(int((high - low).sum()) for low, high in cut)
        if total > limit and n < BITS:
            todo += [(n + 1, 2 * lead + 1), (n + 1, 2 * lead)]
        elif total:
            yield cut


def colliding(x, syndrome: int, radius: int, bits: int, slice_variants: int = SLICE_VARIANTS):
    """Links among fingerprints ``x`` whose variants of this syndrome collide, as a forest."""
    import numpy as np

    groups = {s: np.array(m, dtype=np.uint64) for s, m in masks_by_syndrome(radius, bits).items()}
    x = np.unique(x)
    own = syndromes(x, bits)
    parts = [(x[own == s], groups[int(s) ^ syndrome]) for s in np.unique(own) if int(s) ^ syndrome in groups]
    del x, own
    left, right, held = [], [], 0
    for cut in slices(parts, slice_variants):
        owners = [p[i:j] for (p, masks), (low, high) in zip(parts, cut) for i, j in zip(low.tolist(), high.tolist())]
        flips = np.concatenate([masks for _, masks in parts])
        o = np.concatenate(owners)
        v = o ^ np.repeat(flips, [len(q) for q in owners])
        ordered = np.sort(v)
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        del ordered
        if not len(again):
            continue
        # Only variants seen twice matter from here on; a bit table drops most of the others.
        mixed = (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        seen = np.zeros(1 << 20, dtype=bool)
        seen[(again * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)] = True
        near = seen[mixed]
        v, o = v[near], o[near]
        near = np.isin(v, again)
        v, o = v[near], o[near]
        order = np.lexsort((o, v))
        v, o = v[order], o[order]
        start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        first = np.repeat(o[start], np.diff(np.append(start, len(v))))
        keep = first != o
        first, o = first[keep], o[keep]
        keep = np.bitwise_count(first ^ o) <= 2 * radius
        a, b = forest(first[keep], o[keep])
        left.append(a)
        right.append(b)
        held += len(a)
        if held > HELD_LINKS:
            a, b = forest(np.concatenate(left), np.concatenate(right))
            left, right, held = [a], [b], 0
    if not left:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    return forest(np.concatenate(left), np.concatenate(right))


def links(distinct: DataFrame, radius: int = 2, count: int | None = None) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp) that keep all components within 2 * radius bits."""
    n = distinct.count() if count is None else count
    bits = code_bits(n, radius)

    def emit(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        groups = np.array(sorted(masks_by_syndrome(radius, bits)), dtype=np.int64)
        held: list = []

        def packed(to: list, fps: list):
            return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(fps, pa.binary())], names=["syndrome", "fps"])

        def out():
            x = np.unique(np.concatenate(held))
            if len(groups) == 1 << bits:  # every fingerprint has variants of every syndrome
                for s in range(1 << bits):
                    yield packed([s], [x.tobytes()])
                return
            own, step = syndromes(x, bits).astype(np.int64), max(1, SEND_COPIES // len(groups))
            for at in range(0, len(x), step):
                to = (own[at : at + step, None] ^ groups[None, :]).ravel()
                order = np.argsort(to, kind="stable")
                to, copies = to[order], x[at + order // len(groups)]
                cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])).tolist()
                yield packed(to[cuts[:-1]].tolist(), [copies[i:j].tobytes() for i, j in zip(cuts, cuts[1:])])

        rows = 0
        for b in batches:
            held.append(b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            rows += b.num_rows
            if rows >= SEND_FINGERPRINTS:
                yield from out()
                held, rows = [], 0
        if rows:
            yield from out()

    def match(key, tab):
        import numpy as np
        import pyarrow as pa

        x = np.concatenate([np.frombuffer(f.as_buffer(), dtype=np.uint64) for f in tab.column("fps")])
        a, b = colliding(x, key[0].as_py(), radius, bits)
        return pa.table({"u": a.view(np.int64), "v": b.view(np.int64)})

    return distinct.select("fp").mapInArrow(emit, "syndrome long, fps binary").groupBy("syndrome").applyInArrow(match, "u long, v long")


#: Keys that are joined by broadcast: those with more than one of so many parts of all rows.
HOT_KEYS = 1000


def hub_join(left: DataFrame, right: DataFrame, on: str, key: str, total: int) -> DataFrame:
    """Inner join of left.on with right.key, of which each value has one row and ``n`` rows in ``left``, ``total`` in all."""
    hot = F.col("n") * HOT_KEYS > total  # fewer than HOT_KEYS rows
    hubs = right.filter(hot).drop("n")
    near = left.join(F.broadcast(hubs), F.col(on) == F.col(key))
    far = left.join(F.broadcast(hubs.select(F.col(key).alias("_hub"))), F.col(on) == F.col("_hub"), "left_anti")
    return near.unionByName(far.join(right.filter(~hot).drop("n"), F.col(on) == F.col(key)))


def components(edges: DataFrame) -> DataFrame:
    """node, label: every vertex of the edges (u, v), with the smallest vertex of its component.

    Alternating star steps: a large star hangs the larger neighbours of a vertex
    on its smallest neighbour, a small star the smaller ones. Both aggregate
    before they join, so a hub is a counter, not a gathered group. They end when
    every vertex hangs on one other and none of those hangs on a third.
    """
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "star")
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"), "n")
        large = hub_join(both, low, "u", "c", 2 * edges.count()).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u <> v").distinct(), "star")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumnRenamed("u", "c")
        small = hub_join(large, low, "u", "c", large.count()).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("c", "m"))
        small = materialize(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
        discard(edges, large)
        edges = small
        centres = edges.select(F.col("v").alias("centre")).distinct()
        hung = centres.join(edges.groupBy("u").agg(F.count("*").alias("n")), F.col("centre") == F.col("u"))
        if not edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() and not hung.limit(1).count():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(centres.select("centre", "centre"))


def near_duplicates(docs: DataFrame, size: int = 4, radius: int = 2) -> DataFrame:
    """doc_id, fp, component_id, group_fp for every row: the smallest doc_id (and the smallest
    fingerprint, by which groups can be told apart) reachable over links of up to 2 * radius bits."""
    prints = materialize(fingerprints(docs, size), "simhash-fp")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "simhash-distinct")
    edges = materialize(links(distinct, radius), "simhash-links")
    member = distinct.withColumn("group_fp", F.col("fp"))
    if edges.limit(1).count():
        labels = materialize(components(edges), "simhash-labels")
        named = materialize(distinct.join(labels, F.col("fp") == F.col("node")).select("fp", "label", "rep"), "simhash-named")
        least = named.groupBy("label").agg(F.min("rep").alias("least"), F.count("*").alias("n")).withColumnRenamed("label", "of")
        linked = hub_join(named, least, "label", "of", named.count()).select(F.col("fp").alias("linked_fp"), "least", "label")
        member = distinct.join(linked, F.col("fp") == F.col("linked_fp"), "left").select("fp", F.coalesce("least", "rep").alias("rep"), F.coalesce("label", "fp").alias("group_fp"), "n")
        member = materialize(member, "simhash-member")
    member = member.select(F.col("fp").alias("member_fp"), F.col("rep").alias("component_id"), "group_fp", "n")
    return hub_join(prints, member, "fp", "member_fp", prints.count()).select("doc_id", "fp", "component_id", "group_fp")


def keep_one(docs: DataFrame, size: int = 4, radius: int = 2) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest doc_id, a null one last.

    A doc_id of a single row decides by itself. Rows whose id repeats (or is
    null more than once) are told apart by their fingerprint; of several that
    could stay for a group, the smallest row does.
    """
    found = materialize(near_duplicates(docs, size, radius), "simhash-found")
    moved = ~F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = found.groupBy(F.col("doc_id").alias("odd_id")).agg(F.count("*").alias("n"), F.max(moved).alias("moved"))
    odd = materialize(ids.filter((F.col("n") > 1) | F.col("moved")), "simhash-odd")
    same = docs["doc_id"].eqNullSafe(F.col("odd_id"))
    kept = docs.join(odd.select("odd_id"), same, "left_anti")
    again = odd.filter("n > 1").select("odd_id")
    if not again.limit(1).count():
        return kept
    groups = found.select(F.col("fp").alias("of_fp"), "component_id", "group_fp").distinct()
    rows = with_fingerprints(docs.join(again, same, "left_semi"), size)
    first = rows.join(groups, F.col("fp") == F.col("of_fp")).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return kept.unionByName(first.groupBy("group_fp").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*"))


def op9_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

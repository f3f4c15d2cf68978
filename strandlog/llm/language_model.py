"""Operator 5: language-model scores by deleted interpolation.

Unigram and bigram counts of all training documents meet in buckets of hashed
keys. Documents are dealt into batches by hash; a batch asks once for each of
its distinct keys (sending what it adds to their counts), a bucket sums and
answers each batch, and the batch reads the totals back for its documents. What
is shuffled is one packed row per batch and bucket, so a frequent word is one
key of each batch, never a gathered group.

P(w | v) = l2 * c(v,w)/c(v) + l1 * c(w)/N + l0/(V+1), with weights for each
bucket of the context's frequency c(v). The weights are learned by
expectation-maximisation on held-out counts: every training token is predicted
from the counts without its own batch. All tokens take part, through a bounded
histogram of (bucket, p2/p0, p1/p0) on quarter-octave steps from 2**-16 to 2**47
whose cells hold the sums of both ratios, so that a cell stands for its mean; a
ratio is at most the number of types, so none is clipped below 10**14 types.

Words are told apart by 64-bit hashes. Defined results: null and empty texts
are one end token; without training documents every score is 0 (the one unseen
class has probability 1); repeated rows score alike; a null doc_id counts as
empty text in the folds; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm.common import bounded, doc_bytes, fold_of, materialize, table

FOLDS, HELD_OUT = 7, 2
#: Bytes of text of a batch, and of all texts for each bucket of keys.
BATCH_TEXT, BUCKET_TEXT, MIN_BATCHES, MIN_BUCKETS = 6 << 20, 16 << 20, 16, 12
#: Context-frequency buckets (by powers of two), steps of an octave, and steps kept.
BUCKETS, STEPS, LEVELS = 16, 4, 256
#: The level of a ratio of one.
EVEN = 1 + 16 * STEPS
EM_STEPS = 200
SMALL = {1: "<u1", 2: "<u2", 4: "<u4", 8: "<u8"}


def tokens(texts: list[bytes]):
    """Hashes of all tokens (each document's words, then its end), and where documents start."""
    import numpy as np
    import xxhash

    h, out, starts = xxhash.xxh64_intdigest, [], [0]
    end = h(b"")
    for t in texts:
        out += map(h, t.lower().split())
        out.append(end)
        starts.append(len(out))
    return np.array(out, dtype=np.uint64), np.array(starts)


def pairs(w, starts):
    """Hash of each token with the one before it; the first follows an end."""
    import numpy as np

    before = np.roll(w, 1)
    if len(w):
        before[starts[:-1]] = w[-1]  # the end token's hash
    x = before * np.uint64(0x9E3779B97F4A7C15) + w
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def small(x) -> bytes:
    """Unsigned numbers in the smallest width that holds them all."""
    import numpy as np

    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)).tobytes()


def unsmall(data: bytes, n: int):
    import numpy as np

    return np.frombuffer(data, dtype=SMALL[len(data) // n]).astype(np.int64) if n else np.zeros(0, dtype=np.int64)


def batch_keys(tab) -> tuple:
    """Of a batch: for words and for pairs, the distinct keys, each token's key, and the training counts."""
    import numpy as np

    w, starts = tokens(tab.column("text").to_pylist())
    train = np.repeat(~np.array(tab.column("held_out").to_pylist(), dtype=bool), np.diff(starts))
    out = []
    for x in (w, pairs(w, starts)):
        keys, at = np.unique(x, return_inverse=True)
        out.append((keys, at, np.bincount(at[train], minlength=len(keys))))
    return starts, train, out


def requests(buckets: int):
    """A batch's keys and counts, packed for each kind (0 words, 1 pairs) and bucket."""

    def run(key, tab):
        import numpy as np
        import pyarrow as pa

        _, _, kinds = batch_keys(tab)
        rows = []
        edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)
        for kind, (keys, _, counts) in enumerate(kinds):
            cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
            rows += [(key[0].as_py(), kind, b, keys[i:j].tobytes(), small(counts[i:j])) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("batch", "kind", "bucket", "keys", "counts"), zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))})

    return run


def answers(key, tab):
    """Totals of a bucket's keys for each batch that asked, and a row (batch -1) of types and tokens."""
    import numpy as np
    import pyarrow as pa

    asked = [np.frombuffer(k, dtype=np.uint64) for k in tab.column("keys").to_pylist()]
    counts = [unsmall(c, len(k)) for c, k in zip(tab.column("counts").to_pylist(), asked)]
    keys, at = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)
    cuts = np.cumsum([0, *map(len, asked)])
    n = len(asked)
    return pa.table({
        "batch": pa.array([*tab.column("batch").to_pylist(), -1], pa.int64()), "kind": pa.array([key[0].as_py()] * (n + 1), pa.int64()), "bucket": pa.array([key[1].as_py()] * (n + 1), pa.int64()),
        "n_keys": pa.array([*map(len, asked), 0], pa.int64()), "totals": pa.array([*(small(total[at[i:j]]) for i, j in zip(cuts, cuts[1:])), b""], pa.binary()),
        "types": pa.array([0] * n + [int((total > 0).sum())], pa.int64()), "tokens": pa.array([0] * n + [int(total.sum())], pa.int64()),
    })


def level(p, p0: float):
    """Quarter octaves of p over p0, ``EVEN`` for equals; 0 for no probability."""
    import numpy as np

    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.rint(STEPS * np.log2(np.where(p > 0, p, 1) / p0)) + EVEN, 1, LEVELS - 1), 0).astype(np.int64)


def context_bucket(c1):
    """0 for unseen contexts, then one bucket per power of two."""
    import numpy as np

    return np.minimum(BUCKETS - 1, np.where(c1 > 0, np.log2(np.maximum(c1, 1)).astype(np.int64) + 1, 0))


def contexts(cw, starts, ends: int):
    """Count of each token's context: that of the token before it, or of ends at a document's start."""
    import numpy as np

    c1 = np.roll(cw, 1)
    if len(cw):
        c1[starts[:-1]] = ends
    return c1


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, counts binary, cell long, cell_n long, cell_r2 double, cell_r1 double"


def counted(n_tokens: int, n_types: int, ends: int):
    """Documents with their tokens' counts, and the batch's share of the held-out histogram."""

    def run(key, tab, got):
        import numpy as np
        import pyarrow as pa
        import zstandard

        if not tab.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, types)})
        starts, train, kinds = batch_keys(tab)
        got = got.select(["kind", "bucket", "n_keys", "totals"]).to_pylist()
        full, own = [], []
        for kind, (keys, at, counts) in enumerate(kinds):
            parts = [unsmall(r["totals"], r["n_keys"]) for r in sorted((r for r in got if r["kind"] == kind), key=lambda r: r["bucket"])]
            total = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
            if len(total) != len(keys):
                raise RuntimeError("the answers are not those of this batch")
            full.append(total[at])
            own.append(counts[at])
        cw, c2 = full
        sizes = np.diff(starts)
        known = np.add.reduceat((cw > 0).astype(np.int64), starts[:-1])
        base = np.add.reduceat(np.log10((cw + 1) / (n_tokens + n_types + 1)), starts[:-1])
        # Without what this batch itself has counted, for its training tokens.
        mine = int((~np.array(tab.column("held_out").to_pylist(), dtype=bool)).sum())
        w1, w2 = cw - own[0], c2 - own[1]
        v1 = contexts(w1, starts, ends - mine)
        p0, rest = 1 / (n_types + 1), max(1, n_tokens - int(train.sum()))
        p2, p1 = np.where(v1 > 0, w2 / np.maximum(v1, 1), 0.0)[train], (w1 / rest)[train]
        cell, at, cell_n = np.unique((context_bucket(v1)[train] * LEVELS + level(p2, p0)) * LEVELS + level(p1, p0), return_inverse=True, return_counts=True)
        r2, r1 = (np.bincount(at, weights=p / p0, minlength=len(cell)) for p in (p2, p1))
        pack = zstandard.ZstdCompressor(level=1).compress
        blobs = [pack(cw[i:j].astype("<u4").tobytes() + c2[i:j].astype("<u4").tobytes()) for i, j in zip(starts[:-1], starts[1:])]
        n, k = len(sizes), len(cell)
        cols = [tab.column("doc_id").to_pylist() + [None] * k, tab.column("held_out").to_pylist() + [None] * k, sizes.tolist() + [None] * k, known.tolist() + [None] * k, base.tolist() + [None] * k, blobs + [None] * k, [None] * n + cell.tolist(), [None] * n + cell_n.tolist(), [None] * n + r2.tolist(), [None] * n + r1.tolist()]
        return pa.table({c: pa.array(v, t) for c, v, t in zip(names, cols, types)})

    import pyarrow as pa

    names = [c.split()[0] for c in OUT.split(", ")]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return run


def learn_weights(cells, counts, r2, r1):
    """Weights (BUCKETS, 3) of p2, p1 and p0 by expectation-maximisation over the histogram's cells, their tokens and sums of ratios."""
    import numpy as np

    bucket = cells // (LEVELS * LEVELS)
    out = np.tile(np.array([0.3, 0.5, 0.2]), (BUCKETS, 1))
    everything = np.ones(len(cells), dtype=bool)
    for b in [None, *range(BUCKETS)]:  # all contexts first: where buckets without tokens start from
        mine = everything if b is None else bucket == b
        if not mine.any():
            continue
        p = np.stack([r2[mine] / counts[mine], r1[mine] / counts[mine], np.ones(mine.sum())], axis=1)
        n, w = counts[mine].astype(float), np.full(3, 1 / 3) if b is None else out[b].copy()
        for _ in range(EM_STEPS):
            x = p * w
            w = (n[:, None] * x / x.sum(1, keepdims=True)).sum(0) + 1e-3
            w /= w.sum()
        if b is None:
            out[:] = w
        else:
            out[b] = w
    out[0] = [0.0, out[0][1], out[0][2]]
    out[0] /= out[0].sum()
    return out


def score_counts(docs: DataFrame, weights, n_tokens: int, n_types: int, ends: int) -> DataFrame:
    """The model's log10 probability of each document, from its tokens' counts."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in bounded(batches, column="counts"):
            scores = []
            for data in b.column("counts").to_pylist():
                x = np.frombuffer(unpack(data), dtype="<u4").astype(np.int64)
                cw, c2 = x[: len(x) // 2], x[len(x) // 2 :]
                c1 = contexts(cw, np.array([0, len(cw)]), ends)
                w = weights[context_bucket(c1)]
                p = w[:, 0] * c2 / np.maximum(c1, 1) + w[:, 1] * cw / max(1, n_tokens) + w[:, 2] / (n_types + 1)
                scores.append(float(np.log10(p).sum()))
            cols = [b.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(scores, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return docs.select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "counts").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score, train_tokens of every document."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    batches, buckets = max(MIN_BATCHES, size // BATCH_TEXT), max(MIN_BUCKETS, size // BUCKET_TEXT)
    held = fold_of(F.col("doc_id"), FOLDS) == HELD_OUT
    dealt = doc_bytes(docs, F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"))
    dealt = dealt.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)))
    asked = dealt.groupBy("batch").applyInArrow(requests(buckets), "batch long, kind long, bucket long, keys binary, counts binary")
    answered = asked.groupBy("kind", "bucket").applyInArrow(answers, "batch long, kind long, bucket long, n_keys long, totals binary, types long, tokens long")
    answered = materialize(answered, "lm-answers")
    sums = {r.kind: r for r in answered.filter("batch = -1").groupBy("kind").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).collect()}
    n_tokens, n_types = (sums[0].tokens, sums[0].types) if 0 in sums else (0, 0)
    ends = docs.filter(~held).count()
    out = dealt.groupBy("batch").cogroup(answered.filter("batch >= 0").groupBy("batch")).applyInArrow(counted(n_tokens, n_types, ends), OUT)
    out = materialize(out, "lm-counts")
    import numpy as np

    got = out.filter("cell is not null").groupBy("cell").agg(F.sum("cell_n").alias("n"), F.sum("cell_r2").alias("r2"), F.sum("cell_r1").alias("r1")).orderBy("cell").collect()  # at most BUCKETS * LEVELS**2 cells
    weights = learn_weights(*(np.array([r[k] for r in got], dtype=t) for k, t in enumerate((np.int64, np.int64, float, float))))
    scored = score_counts(out.filter("cell is null"), weights, n_tokens, n_types, ends)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op5_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))

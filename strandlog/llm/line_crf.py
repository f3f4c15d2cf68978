"""Operator 6: document quality from a linear-chain CRF over lines.

Each non-blank line is described by binned measures of itself and of its two
neighbours. A two-label chain (good, bad) is trained on a bounded sample of
labelled documents; as labels are per document, lines of bad documents are
labelled anew by the model between rounds, the worst line staying bad.
Forward-backward marginals, weighted by line length, give a document's share of
good text; a logistic map, fitted on the sample with the true class balance,
turns it into the score.

Only text enters a score. Defined results: null, empty and blank texts score
the share of good documents among the labels; without labels of both classes
every document scores that share (1 without any labels); repeated rows score
alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm.common import bounded, doc_bytes, fold_of, table, unit_hash

#: Labelled documents of each class to train on, and characters of each: of a longer text one span at a hashed place.
TRAIN_EACH, TRAIN_CHARS = 1200, 60_000
FOLDS, THRESHOLD = 5, 0.3
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123)) + bytes(range(128, 256))
DIGITS = bytes(range(48, 58))
SYMBOLS = b"#*$%&|<>{}[]\\^~_@+="
MARKS = b"!?"
BINS = 6
#: Measures of a line: length, shares of upper case, digits, symbols, marks, letters, distinct words, and mean word length.
MEASURES = 8
WIDTH = MEASURES * BINS
CUTS = (
    (20, 50, 100, 200, 400),
    (0.02, 0.05, 0.15, 0.4, 0.7),
    (0.01, 0.03, 0.08, 0.2, 0.5),
    (0.005, 0.02, 0.05, 0.1, 0.3),
    (0.002, 0.01, 0.03, 0.06, 0.15),
    (0.4, 0.6, 0.75, 0.85, 0.95),
    (0.2, 0.4, 0.6, 0.8, 0.95),
    (3.0, 4.5, 5.5, 6.5, 9.0),
)


def measures(text: bytes) -> tuple[list[tuple], list[int]]:
    """The measures and the byte length of every non-blank line."""
    rows, sizes = [], []
    for line in text.split(b"\n"):
        words = line.split()
        n = len(line)
        if words:
            count = lambda drop: (n - len(line.translate(None, drop))) / n  # noqa: B023, E731
            rows.append((n, count(UPPER), count(DIGITS), count(SYMBOLS), count(MARKS), count(LOWER), len(set(words)) / len(words), n / len(words)))
            sizes.append(n)
    return rows, sizes


def features(texts: list[bytes]):
    """bins (lines, MEASURES), byte lengths, and the first line of each document (with a last bound)."""
    import numpy as np

    rows, sizes, starts = [], [], [0]
    for t in texts:
        r, s = measures(t)
        rows += r
        sizes += s
        starts.append(len(rows))
    values = np.array(rows, dtype=np.float64).reshape(-1, MEASURES)
    bins = np.stack([np.searchsorted(CUTS[k], values[:, k]) + k * BINS for k in range(MEASURES)], axis=1) if len(rows) else np.zeros((0, MEASURES), dtype=np.int64)
    return bins, np.array(sizes, dtype=np.float64), np.array(starts)


class LineChain:
    """Weights of a bad line (own, previous, next measures) and of label pairs."""

    def __init__(self):
        import numpy as np

        self.own, self.before, self.after = (np.zeros(WIDTH) for _ in range(3))
        self.bias, self.pair = 0.0, np.zeros((2, 2))
        self.a, self.b, self.share = 1.0, 0.0, 1.0

    def unary(self, bins, starts):
        """Log odds of bad for each line; the first and last lines of a document lack a neighbour."""
        import numpy as np

        n = len(bins)
        own, before, after = self.own[bins].sum(1) + self.bias, self.before[bins].sum(1), self.after[bins].sum(1)
        out = own.copy()
        first = np.zeros(n + 1, dtype=bool)
        first[starts] = True
        if n > 1:
            inner = ~first[1:n]
            out[1:] += np.where(inner, before[:-1], 0)
            out[:-1] += np.where(inner, after[1:], 0)
        return out

    def marginals(self, u, starts):
        """P(bad) of each line, and expected label pairs, by forward-backward over all documents at once."""
        import numpy as np

        sizes = np.diff(starts)
        order = np.argsort(-sizes, kind="stable")
        begin, sizes = starts[:-1][order], sizes[order]
        p, pairs = np.zeros(len(u)), np.zeros((2, 2))
        if not len(u):
            return p, pairs
        w = np.exp(self.pair)
        longest = int(sizes[0])
        live = np.searchsorted(-sizes, -np.arange(longest), side="left")  # documents longer than t
        e = np.stack([np.ones(len(u)), np.exp(np.clip(u, -30, 30))], axis=1)
        f, g = np.zeros((len(u), 2)), np.zeros((len(u), 2))
        for t in range(longest):
            i = begin[: live[t]] + t
            x = e[i] if t == 0 else (f[i - 1] @ w) * e[i]
            f[i] = x / x.sum(1, keepdims=True)
        for t in range(longest - 1, -1, -1):
            i = begin[: live[t]] + t
            g[i] = 0.5
            if t + 1 < longest:
                j = begin[: live[t + 1]] + t
                x = (g[j + 1] * e[j + 1]) @ w.T
                g[j] = x / x.sum(1, keepdims=True)
                joint = f[j][:, :, None] * w[None] * (g[j + 1] * e[j + 1])[:, None, :]
                pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        x = f * g
        return x[:, 1] / x.sum(1), pairs

    def fit(self, bins, starts, y, rounds: int = 60, rate: float = 0.1, ridge: float = 1e-3):
        """Adam on the likelihood of the line labels ``y``."""
        import numpy as np

        first = np.zeros(len(y) + 1, dtype=bool)
        first[starts] = True
        inner = np.flatnonzero(~first[1 : len(y)])
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[inner], y[inner + 1]), 1)
        names, n = ("own", "before", "after", "bias", "pair"), max(1, len(y))
        m = {k: 0.0 for k in names}
        s = {k: 0.0 for k in names}
        for t in range(1, rounds + 1):
            p, pairs = self.marginals(self.unary(bins, starts), starts)
            d = p - y
            count = lambda rows, by: np.bincount(bins[rows].ravel(), np.repeat(by, MEASURES), minlength=WIDTH)
            grad = {"own": count(slice(None), d), "before": count(inner, d[inner + 1]), "after": count(inner + 1, d[inner]), "bias": d.sum(), "pair": pairs - seen}
            for k, v in grad.items():
                v = v / n + ridge * getattr(self, k)
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.99 * s[k] + 0.01 * v * v
                setattr(self, k, getattr(self, k) - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8))

    def good_share(self, bins, sizes, starts):
        """Length-weighted mean of P(good) of each document; nan without lines."""
        import numpy as np

        p, _ = self.marginals(self.unary(bins, starts), starts)
        total = np.concatenate([[0], np.cumsum(sizes)])
        good = np.concatenate([[0], np.cumsum(sizes * (1 - p))])
        with np.errstate(invalid="ignore"):
            return (good[starts[1:]] - good[starts[:-1]]) / (total[starts[1:]] - total[starts[:-1]])

    @staticmethod
    def logit(g):
        import numpy as np

        g = np.clip(g, 1e-4, 1 - 1e-4)
        return np.log(g / (1 - g))

    def score(self, texts: list[bytes]):
        import numpy as np

        g = self.good_share(*features(texts))
        z = self.a * self.logit(np.nan_to_num(g, nan=0.5)) + self.b
        return np.where(np.isnan(g), self.share, 1 / (1 + np.exp(-z)))


def train(docs: DataFrame, labels: DataFrame) -> LineChain:
    """A chain from labelled documents of the training folds, a bounded number of each class."""
    import numpy as np

    lab = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("quality")).filter((fold_of(F.col("doc_id"), FOLDS) != 0) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    balance = {r.quality: r.n for r in lab.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    chain = LineChain()
    chain.share = balance.get(1, 0) / max(1, sum(balance.values())) if balance else 1.0
    if len(balance) < 2:
        chain.a, chain.b = 0.0, float(LineChain.logit(np.array(chain.share)))
        return chain
    picked = [lab.filter(F.col("quality") == q).orderBy(F.xxhash64("label_id"), "label_id").limit(TRAIN_EACH) for q in (0, 1)]
    place = F.floor(unit_hash("doc_id", "text") * F.greatest(F.lit(0), F.length("text") - TRAIN_CHARS)) + 1
    spans = docs.select("doc_id", F.substring(F.col("text"), place.cast("int"), F.lit(TRAIN_CHARS)).alias("text"))
    sample = doc_bytes(spans, "doc_id").join(F.broadcast(picked[0].union(picked[1])), F.col("doc_id") == F.col("label_id"))  # at most 2 * TRAIN_EACH rows
    picked_rows = sample.select("doc_id", "text", "quality").orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text", "quality").limit(8 * TRAIN_EACH)  # ids may repeat
    rows = sorted((r.doc_id, bytes(r.text), r.quality) for r in picked_rows.collect())
    q = np.array([r[2] for r in rows], dtype=np.int64)
    bins, sizes, starts = features([r[1] for r in rows])
    doc = np.repeat(np.arange(len(rows)), np.diff(starts))
    y = (1 - q)[doc]
    for _ in range(3):
        chain.fit(bins, starts, y)
        p, _pairs = chain.marginals(chain.unary(bins, starts), starts)
        worst = np.zeros(len(rows))
        np.maximum.at(worst, doc, p)
        y = ((1 - q)[doc] * ((p >= 0.5) | (p >= worst[doc] - 1e-9))).astype(np.int64)
    g = chain.good_share(bins, sizes, starts)
    known = ~np.isnan(g)
    z, t = LineChain.logit(g[known]), q[known]
    weight = np.where(t == 1, balance[1] / max(1, (t == 1).sum()), balance[0] / max(1, (t == 0).sum()))
    weight = weight / weight.mean()
    a, b = 1.0, 0.0
    for _ in range(100):
        x = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = weight * x * (1 - x)
        h = np.array([[(w * z * z).sum() + 1.0, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, np.array([(weight * (x - t) * z).sum() + (a - 1.0), (weight * (x - t)).sum()]))
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    chain.a, chain.b = float(a), float(b)
    return chain


def score_documents(docs: DataFrame, chain: LineChain) -> DataFrame:
    """doc_id, score of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in bounded(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(chain.score(b.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"])

    return doc_bytes(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, score double")


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

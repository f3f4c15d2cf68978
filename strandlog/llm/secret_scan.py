"""Operator 8: secret scans with a character convolutional network.

Three base patterns give spans that always stay. Candidates are all runs of 8 or
more token characters (``A-Za-z0-9+/_=-``) that are no plain words: with a
digit, a symbol, mixed case or 20 and more characters, and runs of 6 or more
that follow ``:`` or ``=``. A numpy network reads every candidate, inside and
outside of base spans: its convolution slides over the whole candidate and over
the characters around it, and the maxima over both decide. What it finds is
added as spans of kind ``model``.

It is trained on labelled findings: candidates that lie in a base finding of any
document against candidates and words that do not, the ``TRAIN_EACH`` smallest
hashes of either (a bounded sample), and ``GENERATED`` findings of known formats
put in the place of the latter, so that there is always something to learn from.
Half of the time the surroundings are hidden. Of the sample three fifths train, a
fifth calibrates the scores, and a fifth sets the threshold: the highest that
keeps ``MIN_RECALL`` of its findings. Without any candidate or word (as in an
empty table) there is no model and only base spans are reported.

Defined results: spans are code points, end exclusive, of the whole match;
null and empty texts have none; repeated rows give repeated results; a null
doc_id is kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm.common import bounded, doc_bytes, table

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,}+")
ODD = re.compile(r"[0-9+/_=]|[a-z][A-Z]|[A-Z]{2}[a-z]")
FOLLOWS = re.compile(r"""[:=]\x20*["']?([A-Za-z0-9+/_=-]{6,}+)""")
LONG_RUN = 20
#: Characters that the network reads before and after a candidate, and convolution steps of one block of it.
BEFORE, AFTER, BLOCK = 16, 8, 44
#: Findings and other candidates to train on, longest candidate among them, generated findings, and the recall to keep.
TRAIN_EACH, TRAIN_CHARS, GENERATED, MIN_RECALL = 2000, 2000, 600, 0.98
#: Plain words of a batch that take part in the draw of other candidates.
BATCH_WORDS = 64


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the base findings, by start, then kind."""
    out = []
    low = text.lower()
    if any(c in low for c in CUES):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # Runs of hex digits are maximal either way, so short ones need no match of their own.
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """All spans that the network reads, in order."""
    odd = ODD.search
    found = {m.span() for m in RUN.finditer(text) if len(m[0]) >= LONG_RUN or odd(m[0])}
    if ":" in text or "=" in text:
        found |= {m.span(1) for m in FOLLOWS.finditer(text)}
    return sorted(found)


def window(text: str, start: int, end: int) -> str:
    """What the network reads: the characters before (padded), the whole candidate, the characters after (padded)."""
    return text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + text[start:end] + text[end : end + AFTER].ljust(AFTER, "\0")


def encode_windows(windows: list[str], width: int = 5):
    """(surroundings, blocks, owner, steps, extra) of windows as numpy arrays.

    A candidate is cut in blocks of ``BLOCK`` steps that overlap by the filter's
    width less one, so every step of it is in one block; ``owner`` is the window
    of each block and ``steps`` its number of steps, the rest being padding.
    Characters: printable ASCII as they are, everything else as one class.
    """
    import numpy as np

    n, size = len(windows), BLOCK + width - 1
    around = np.zeros((n, BEFORE), dtype=np.int64)
    extra = np.zeros((n, 3))
    blocks, owner, steps = [], [], []
    for k, w in enumerate(windows):
        raw = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        raw = np.where(raw < 127, raw, 127)
        token = raw[BEFORE : len(raw) - AFTER]
        around[k] = raw[:BEFORE]
        extra[k] = ((token >= 48) & (token <= 57)).mean(), len(np.unique(token)) / min(len(token), 40), min(len(token), 64) / 64
        body = raw[BEFORE - width + 1 :]
        count = len(body) - width + 1
        for at in range(0, count, BLOCK):
            block = np.zeros(size, dtype=np.int64)
            part = body[at : at + size]
            block[: len(part)] = part
            blocks.append(block)
            owner.append(k)
            steps.append(min(BLOCK, count - at))
    return around, np.array(blocks).reshape(-1, size), np.array(owner, dtype=np.int64), np.array(steps, dtype=np.int64), extra


def rows_of(x, index):
    """The encoded windows at an ascending or shuffled ``index``, with their blocks."""
    import numpy as np

    around, blocks, owner, steps, extra = x
    first = np.searchsorted(owner, index)
    count = np.searchsorted(owner, index, side="right") - first
    pick = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    return around[index], blocks[pick], np.repeat(np.arange(len(index)), count), steps[pick], extra[index]


class CharNet:
    """Embedding, one convolution, maxima over the surroundings and the whole candidate, one output."""

    WIDTH, EMBED, FILTERS = 5, 8, 24

    def __init__(self, seed: int = 7):
        import numpy as np

        r = np.random.default_rng(seed)
        self.w = {
            "e": r.normal(0, 0.3, (128, self.EMBED)),
            "k": r.normal(0, (2 / (self.WIDTH * self.EMBED)) ** 0.5, (self.WIDTH * self.EMBED, self.FILTERS)),
            "kb": np.zeros(self.FILTERS),
            "o": r.normal(0, 0.1, 2 * self.FILTERS + 3),
            "ob": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _maxima(self, chars, steps):
        """Inputs of the largest step of every filter, that step, and its value; steps that are padding give zero."""
        import numpy as np

        n, length = chars.shape
        emb = self.w["e"][chars]
        cols = np.lib.stride_tricks.sliding_window_view(emb, self.WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, length - self.WIDTH + 1, -1)
        act = np.maximum(cols @ self.w["k"] + self.w["kb"], 0)
        act[np.arange(act.shape[1])[None] >= steps[:, None]] = 0
        spot = act.argmax(1)
        return cols, spot, np.take_along_axis(act, spot[:, None, :], 1)[:, 0]

    def forward(self, x):
        """The raw output of each window, and what the gradient needs."""
        import numpy as np

        around, blocks, owner, steps, extra = x
        n = len(around)
        near = self._maxima(around, np.full(n, BEFORE - self.WIDTH + 1))
        own = self._maxima(blocks, steps)
        first = np.searchsorted(owner, np.arange(n))
        best = np.maximum.reduceat(own[2], first, axis=0)
        top = np.concatenate([near[2], best, extra], axis=1)
        return top @ self.w["o"] + self.w["ob"][0], (top, near, own, first, best)

    def gradient(self, x, d, kept):
        """Gradients of all weights for the gradient ``d`` of each window's output."""
        import numpy as np

        around, blocks, owner, _, _ = x
        top, near, own, first, best = kept
        g = {"o": top.T @ d, "ob": np.array([d.sum()]), "e": np.zeros_like(self.w["e"]), "k": np.zeros_like(self.w["k"]), "kb": np.zeros_like(self.w["kb"])}
        # The block in which each filter has its maximum, the first of equals.
        at = np.where(own[2] == best[owner], np.arange(len(blocks))[:, None], len(blocks))
        win = np.minimum.reduceat(at, first, axis=0)
        rows = np.broadcast_to(np.arange(len(d))[:, None], win.shape)
        filters = np.arange(self.FILTERS)[None]
        for f, (cols, spot, _), chars, row in ((slice(0, self.FILTERS), near, around, rows), (slice(self.FILTERS, 2 * self.FILTERS), own, blocks, win)):
            da = d[:, None] * self.w["o"][f] * (top[:, f] > 0)
            g["kb"] += da.sum(0)
            step = spot[row, filters]
            g["k"] += np.einsum("nf,nfc->cf", da, cols[row, step])
            back = (da[:, :, None] * self.w["k"].T[None]).reshape(len(d), self.FILTERS, self.WIDTH, self.EMBED)
            np.add.at(g["e"], chars[row[:, :, None], step[:, :, None] + np.arange(self.WIDTH)].ravel(), back.reshape(-1, self.EMBED))
        return g

    def fit(self, x, y, epochs: int = 12, batch: int = 128, rate: float = 4e-3, seed: int = 11):
        """Adam on the logistic loss. Half of the time the surroundings are hidden, so candidates must tell by themselves."""
        import numpy as np

        r, n = np.random.default_rng(seed), len(y)
        weight = np.where(y == 1, n / max(1, 2 * y.sum()), n / max(1, 2 * (n - y.sum())))
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        t = 0
        for _ in range(epochs):
            order = r.permutation(n)
            for at in range(0, n, batch):
                i = order[at : at + batch]
                part = rows_of(x, i)
                part[0][r.random(len(i)) < 0.5] = 0
                z, kept = self.forward(part)
                d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) * weight[i] / len(i)
                t += 1
                for k, v in self.gradient(part, d, kept).items():
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.999 * s[k] + 0.001 * v * v
                    self.w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def raw(self, x):
        """Raw outputs, in bounded blocks."""
        import numpy as np

        n, out = len(x[0]), []
        ends = np.searchsorted(x[2], np.arange(n), side="right")
        at = 0
        while at < n:  # about 512 blocks, or one window
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + 512, side="right")))
            out.append(self.forward(rows_of(x, np.arange(at, stop)))[0])
            at = stop
        return np.concatenate(out or [np.zeros(0)])

    def score(self, x):
        """Calibrated probability that a candidate is a secret."""
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(x) + self.shift, -30, 30)))

    def calibrate(self, x, y):
        """A logistic map of the raw output to probabilities, fitted by Newton steps."""
        import numpy as np

        z = self.raw(x)
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w = p * (1 - p) + 1e-6
            h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(h, np.array([((p - y) * z).sum() + 1e-3 * (a - 1), (p - y).sum()]))
            a, b = a - step[0], b - step[1]
            if abs(step).max() < 1e-9:
                break
        self.scale, self.shift = float(a), float(b)
        return self

    def constrain(self, x, y, recall: float = MIN_RECALL):
        """The highest threshold that keeps the recall over these findings."""
        import numpy as np

        found = np.sort(self.score(x)[y == 1])
        if len(found):
            self.threshold = float(found[int(len(found) * (1 - recall))])
        return self


def labels_of(text: str) -> list[tuple[int, int, int]]:
    """(start, end, label) of every candidate: 1 if it meets the value of a base finding."""
    values = sorted((v, e) for _, _, e, v in base_spans(text))
    reach = []  # the furthest end of all values up to each one
    for _, e in values:
        reach.append(max(e, reach[-1] if reach else 0))
    out = []
    for a, e in candidates(text):
        k = bisect.bisect_left(values, (e, 0))  # values that begin before the candidate ends
        out.append((a, e, int(k > 0 and reach[k - 1] > a)))
    return out


def labelled(docs: DataFrame) -> DataFrame:
    """win, label, h: of each task the findings and the other candidates (and some words) of the smallest hashes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        held: tuple[dict, dict] = ({}, {})

        def add(label: int, win: str) -> None:
            if len(win) <= TRAIN_CHARS:
                held[label][win] = xxhash.xxh64_intdigest(win.encode("utf-8", "surrogatepass")) >> 1
                if len(held[label]) >= 4 * TRAIN_EACH:
                    cut(label)

        def cut(label: int) -> None:
            least = sorted(held[label].items(), key=lambda x: (x[1], x[0]))[:TRAIN_EACH]
            held[label].clear()
            held[label].update(least)

        for b in bounded(batches):
            texts = [raw.decode("utf-8", "replace") for raw in b.column("text").to_pylist()]
            for text in texts:
                for a, e, label in labels_of(text):
                    add(label, window(text, a, e))
            for text in texts[:: max(1, len(texts) // BATCH_WORDS)]:
                m = RUN.search(text, len(text) // 2)
                if m and not ODD.search(m[0]) and not any(v < m.end() and m.start() < e for _, _, e, v in base_spans(text)):
                    add(0, window(text, *m.span()))
        for label in (0, 1):
            cut(label)
            rows = held[label]
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array([label] * len(rows), pa.int32()), pa.array(list(rows.values()), pa.int64())], names=["win", "label", "h"])

    return docs.mapInArrow(run, "win string, label int, h long")


def generated(others: list[str], n: int = GENERATED, seed: int = 5) -> list[str]:
    """Findings of known formats (hex, base 64, access keys, prefixed and grouped tokens) amid the surroundings of other candidates."""
    r = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    draw = lambda chars, lo, hi: "".join(r.choices(chars, k=r.randint(lo, hi)))
    formats = (
        lambda: draw("0123456789abcdef", 16, 64),
        lambda: draw("0123456789ABCDEF", 20, 64),
        lambda: draw(lower + upper + digits + "+/", 20, 64) + r.choice(("", "=", "==")),
        lambda: draw(lower + upper + digits + "_-", 16, 48),
        lambda: "AKIA" + draw(upper + digits, 16, 16),
        lambda: draw(lower, 2, 4) + "_" + draw(lower, 3, 5) + "_" + draw(lower + upper + digits, 16, 40),
        lambda: "-".join(draw("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)),
        lambda: draw(lower + digits, 20, 40),
    )
    return [w[:BEFORE] + r.choice(formats)() + w[len(w) - AFTER :] for w in r.choices(others, k=n)] if others else []


def training_set(docs: DataFrame) -> tuple[list[str], list[int]]:
    """Windows and labels: bounded, hash-picked from all documents, and the generated findings."""
    found = labelled(doc_bytes(docs)).distinct()
    picked = {k: [r.win for r in found.filter(F.col("label") == k).orderBy("h", "win").limit(TRAIN_EACH).collect()] for k in (0, 1)}
    known = set(picked[1])
    others = [w for w in picked[0] if w not in known]
    made = generated(others)
    return picked[1] + made + others, [1] * (len(picked[1]) + len(made)) + [0] * len(others)


def train(docs: DataFrame) -> CharNet | None:
    """The network from all documents' findings (a bounded sample); None if there is nothing to tell findings from."""
    import numpy as np

    wins, labels = training_set(docs)
    y = np.array(labels, dtype=np.int64)
    if not y.sum() or y.sum() == len(y):
        return None
    order = np.random.default_rng(3).permutation(len(y))
    x, y = encode_windows([wins[k] for k in order]), y[order]
    fold = np.arange(len(y)) % 5
    part = lambda keep: (rows_of(x, np.flatnonzero(keep)), y[keep])
    return CharNet().fit(*part(fold < 3)).calibrate(*part(fold == 3)).constrain(*part(fold == 4))


def scan_many(texts: list[str], model: CharNet | None) -> list[list[tuple[int, int, int, int]]]:
    """All spans of each text: base findings and the candidates that the network finds."""
    out = [base_spans(t) for t in texts]
    if model is not None:
        places = [(k, a, e) for k, t in enumerate(texts) for a, e in candidates(t)]
        at = 0
        while at < len(places):  # in parts of a bounded number of characters, or one candidate
            stop, chars = at, 0
            while stop < len(places) and (stop == at or chars < 1 << 18):
                chars += places[stop][2] - places[stop][1] + BEFORE + AFTER
                stop += 1
            part = places[at:stop]
            scores = model.score(encode_windows([window(texts[k], a, e) for k, a, e in part]))
            for (k, a, e), p in zip(part, scores):
                if p >= model.threshold:
                    out[k].append((a, 3, e, a))
            at = stop
    return [sorted(spans) for spans in out]


def scan(text: str, model: CharNet | None) -> list[tuple[int, int, int, int]]:
    return scan_many([text], model)[0]


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e, _ in spans)


def redact(text: str, spans, mark: str = "[SECRET]") -> str:
    """The text with the value of every span replaced; overlapping values are replaced once."""
    out, at = [], 0
    for a, e in sorted((value, end) for _, _, end, value in spans):
        if e <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = e
    return "".join([*out, text[at:]])


def scan_documents(docs: DataFrame, model: CharNet | None) -> DataFrame:
    """doc_id, counts, base_sha256, spans for every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in bounded(batches):
            counts, shas, spans = ([], [], []), [], []
            for found in scan_many([raw.decode("utf-8", "replace") for raw in b.column("text").to_pylist()], model):
                base = [s for s in found if s[1] < 3]
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in base))
                shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(found))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas), pa.array(spans)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return doc_bytes(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_documents(docs: DataFrame, model: CharNet | None) -> DataFrame:
    """The documents with all secrets' values replaced (null texts stay null)."""
    schema = docs.schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in bounded(batches):
            held = b.column("text").to_pylist()
            spans = scan_many([t or "" for t in held], model)
            texts = [None if t is None else redact(t, s) for t, s in zip(held, spans)]
            cols = [pa.array(texts, b.schema.field("text").type) if f.name == "text" else b.column(f.name) for f in b.schema]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(run, schema)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_documents(docs, train(docs))

"""Operator 7: language identification as inference of a multilingual mixture.

Every word has a likelihood under each language's model of byte trigrams
(hashed, smoothed, with word bounds). Expectation-maximisation, run until the
proportions stand still, estimates the share of every language in a document.
The set of languages then grows from the most likely one by decreasing share, as
long as the likelihood of the set, less a penalty per language, rises. The
prediction is the selected set's largest language, the score its proportion.

Every learned language has a model. Models are trained on executors from a
bounded, hash-picked sample of each language in the training folds: about
``TRAIN_EACH`` documents, and of a long text one span of ``TRAIN_CHARS``
characters at a hashed place. The table of all models has ``TABLE_CELLS`` cells
at most, so it may be broadcast: beyond 256 languages its hash has fewer bits.

Only text enters a prediction. Defined results: a null text, or one without a
letter (Unicode category L), is ``und`` with score 0; so is every text if
nothing could be learned; repeated rows are predicted alike; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm.common import bounded, doc_bytes, fold_of, table, unit_hash

FOLDS = 5
#: Training documents of each language, about, and characters of a text that are taken.
TRAIN_EACH, TRAIN_CHARS = 600, 60_000
#: Cells of the table of all models (languages times hashed trigrams), bits of the hash at most, and what is added to counts.
TABLE_CELLS, HASH_BITS, ALPHA = 1 << 24, 16, 0.3
#: Languages whose sampling shares may be broadcast (a row of under 1 kB each).
BROADCAST_LANGUAGES = 10_000
#: Trigrams of a word overlap; their log likelihoods count by this share.
TEMPER = 1 / 3
#: Log likelihood that another language must add, for each natural log of the number of words.
PENALTY = 3.0
#: Expectation-maximisation ends when no proportion moves by more, or after so many steps.
TOLERANCE, EM_STEPS = 1e-4, 500
#: Bytes of text, and word likelihoods (words times languages), that are held at once.
BATCH_TEXT, BATCH_CELLS = 1 << 20, 1 << 23
#: Everything in ASCII but letters becomes a space; A-Z were lowered before.
SPACED = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def hash_bits(languages: int) -> int:
    """Bits of the trigram hash with which all models fit into the table."""
    bits = HASH_BITS
    while bits > 1 and languages << bits > TABLE_CELLS:
        bits -= 1
    return bits


def trigrams(text: str, bits: int = HASH_BITS):
    """Bucket of the trigram that starts at each byte, and the word of each; a word's bounds are spaces."""
    import numpy as np

    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(SPACED) + b"  ", dtype=np.uint8)
    blank = raw == 32
    middle = ~blank[1:-1]  # a trigram belongs to the word of its middle byte
    x = raw.astype(np.uint32)
    h = ((x[:-2] << 16) | (x[1:-1] << 8) | x[2:])[middle]
    h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    word = np.cumsum(middle & blank[:-2])[middle] - 1
    return h, word


def fit(like, starts, steps: int = EM_STEPS):
    """Proportions of each document by expectation-maximisation: ``like`` (words, languages), words of a document from ``starts``.

    Documents whose proportions stand still are set aside; the others go on.
    """
    import numpy as np

    sizes = np.diff(np.append(starts, len(like)))
    p = np.full((len(starts), like.shape[1]), 1 / like.shape[1])
    if like.shape[1] == 1:
        return p
    live = np.arange(len(starts))
    part, count = like, sizes
    for _ in range(steps):
        q = p[live]
        of = np.repeat(np.arange(len(live)), count)
        mixed = np.einsum("ij,ij->i", part, q[of])
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        new = q * np.add.reduceat(part / mixed[:, None], first, axis=0) / count[:, None]
        p[live] = new
        moving = np.abs(new - q).max(1) > TOLERANCE
        if not moving.any():
            break
        if not moving.all():
            part = part[np.repeat(moving, count)]
            live, count = live[moving], count[moving]
    return p


def log_likelihood(like, starts, p):
    """Of each document under its proportions, without what was taken out of the words' likelihoods."""
    import numpy as np

    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(like))))
    return np.add.reduceat(np.log(np.maximum(np.einsum("ij,ij->i", like, p[of]), 1e-300)), starts)


class Mixture:
    """Trigram log probabilities of each language, and the inference over them."""

    def __init__(self, langs: list[str], counts, bits: int = HASH_BITS):
        import numpy as np

        self.langs, self.bits = langs, bits
        total = counts.sum(0, keepdims=True, dtype=np.float64)
        self.logp = counts.astype(np.float32)
        self.logp += np.float32(ALPHA)
        np.log(self.logp, out=self.logp)
        self.logp -= np.log(total + ALPHA * len(counts)).astype(np.float32)
        self.logp *= np.float32(TEMPER)

    def likelihoods(self, texts: list[str]):
        """Likelihoods of all words (rows) under each language, each word's largest being 1, and each text's first word."""
        import numpy as np

        parts, starts, n = [], [], 0
        for t in texts:
            starts.append(n)
            h, word = trigrams(t, self.bits)
            cut = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
            for at in range(0, len(cut), max(1, BATCH_CELLS // (8 * max(1, len(self.langs))))):  # a bounded number of words
                stop = min(len(cut), at + max(1, BATCH_CELLS // (8 * max(1, len(self.langs)))))
                a, b = cut[at], cut[stop] if stop < len(cut) else len(h)
                scores = np.add.reduceat(self.logp[h[a:b]], cut[at:stop] - a, axis=0)
                parts.append(np.exp(scores - scores.max(1, keepdims=True)))
            n += len(cut)
        return np.concatenate(parts) if parts else np.zeros((0, len(self.langs)), dtype=np.float32), np.array(starts)

    def predict_many(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        import numpy as np

        out: list = [("und", 0.0)] * len(texts)
        read = [k for k, t in enumerate(texts) if self.langs and any(map(str.isalpha, t))]
        if not read:
            return out
        like, starts = self.likelihoods([texts[k] for k in read])  # a letter makes a word, so no text is empty
        words = np.diff(np.append(starts, len(like)))
        p = fit(like, starts)
        order = np.argsort(-p, axis=1, kind="stable")
        value, lead, share = np.full(len(read), -np.inf), np.zeros(len(read), dtype=np.int64), np.zeros(len(read))
        live = np.arange(len(read))
        for k in range(1, len(self.langs) + 1):
            keep = np.zeros(len(read), dtype=bool)
            keep[live] = True
            chosen = order[live, :k]
            own = np.take_along_axis(like[np.repeat(keep, words)], np.repeat(chosen, words[live], axis=0), 1)
            first = np.concatenate([[0], np.cumsum(words[live])[:-1]])
            q = fit(own, first)
            now = log_likelihood(own, first, q) - PENALTY * k * np.log(words[live] + 1)
            better = now > value[live]
            live, chosen, q = live[better], chosen[better], q[better]
            value[live] = now[better]
            top = q.argmax(1)
            lead[live] = np.take_along_axis(chosen, top[:, None], 1)[:, 0]
            share[live] = np.take_along_axis(q, top[:, None], 1)[:, 0]
            if not len(live):
                break
        for k, a, s in zip(read, lead.tolist(), share.tolist()):
            out[k] = (self.langs[a], min(1.0, max(0.0, s)))
        return out

    def predict(self, text: str) -> tuple[str, float]:
        return self.predict_many([text])[0]


def train(docs: DataFrame) -> Mixture:
    """Trigram counts of a bounded, hash-picked sample of each language, packed by language on executors."""
    import numpy as np

    known = docs.select("doc_id", "lang", "text").filter((fold_of(F.col("doc_id"), FOLDS) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()  # a row per language
    langs = [r.lang for r in sizes]
    bits = hash_bits(len(langs))
    counts = np.zeros((1 << bits, len(langs)), dtype=np.float32)
    if langs:
        shares = docs.sparkSession.createDataFrame([(k, r.lang, min(1.0, TRAIN_EACH / r.n)) for k, r in enumerate(sizes)], "k int, share_lang string, share double")
        if len(langs) <= BROADCAST_LANGUAGES:
            shares = F.broadcast(shares)
        place = F.col("unit") * F.greatest(F.lit(0), F.length("text") - TRAIN_CHARS)
        sample = known.withColumn("unit", unit_hash("doc_id", "text")).join(shares, F.col("lang") == F.col("share_lang")).filter(F.col("unit") < F.col("share"))
        sample = sample.select("k", F.substring(F.col("text"), (F.floor(place / F.col("share")) + 1).cast("int"), F.lit(TRAIN_CHARS)).alias("text"))

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                sums: dict = {}
                for k, text in zip(b.column("k").to_pylist(), b.column("text").to_pylist()):
                    h, n = np.unique(trigrams(text, bits)[0], return_counts=True)
                    sums.setdefault(k, np.zeros(1 << bits, dtype=np.int64))[h] += n
                for k, s in sums.items():
                    h = np.flatnonzero(s)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, dtype=np.int32)), pa.array(h.astype(np.int32)), pa.array(s[h])], names=["k", "h", "n"])

        def pack(tab):  # at most a row per bucket
            import pyarrow as pa

            model = np.zeros(1 << bits, dtype="<f4")
            model[tab.column("h").to_numpy()] = tab.column("n").to_numpy()
            return pa.table({"k": pa.array([tab.column("k")[0].as_py()], pa.int32()), "model": pa.array([model.tobytes()], pa.binary())})

        summed = sample.mapInArrow(run, "k int, h int, n long").groupBy("k", "h").agg(F.sum("n").alias("n"))
        for r in summed.groupBy("k").applyInArrow(pack, "k int, model binary").toLocalIterator():  # a model each, TABLE_CELLS cells in all
            counts[:, r.k] = np.frombuffer(r.model, dtype="<f4")
    return Mixture(langs, counts, bits)


def predict_documents(docs: DataFrame, model: Mixture) -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TABLE_CELLS cells of four bytes at most
    limit = max(1 << 14, BATCH_TEXT * 4 // max(4, len(model.langs)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in bounded(batches, limit):
            got = shared.value.predict_many([t.decode("utf-8", "replace") for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return doc_bytes(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict_documents(docs, train(docs))
    return found.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "lang_pred", "score")

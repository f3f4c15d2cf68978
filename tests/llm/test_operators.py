"""Each operator on odd inputs, and against brute force."""

import hashlib
import io
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandlog.llm import audio, bpe, common, language_mix, language_model, line_crf, mixing, quality_rules, secret_scan, simhash, token_store

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCAB = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(common.WORD_PATTERN)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCAB)


@pytest.fixture(scope="module")
def some_docs(spark, sf):
    return common.table(spark, sf, "documents")


def test_tree_encoding_is_exact(library):
    enc, rng = bpe.PieceEncoder(VOCAB, leaf=60), random.Random(5)
    alphabets = ["abcdefghijklmnop", "aeth", "éàüß'", "!!#$%", "12ab's", "日本語かな", "हिन्दी", "ǰJ̌x", "ΣσİI"]
    for _ in range(400):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(1, 500)))
        text += rng.choice(["", " ", "<|endoftext|>", "\x0b\x1c\x85"]) + text[:9]
        want = library.encode(text, add_special_tokens=False).ids
        assert enc.encode_long(text) == want
        assert np.frombuffer(enc.encode_many([text.encode()])[0], dtype=enc.dtype).tolist() == want
        assert enc.decode(want) == library.decode(want, skip_special_tokens=False)


def test_trees_of_whole_texts(some_docs, library, monkeypatch):
    """Texts with white space above a small bound go through halves and joins, and are exact."""
    monkeypatch.setattr(bpe, "EDGE_CHARS", 20)
    enc, rng = bpe.PieceEncoder(VOCAB, leaf=60, tree=120), random.Random(6)
    texts = [r.text for r in some_docs.filter("text IS NOT NULL").limit(60).collect()]
    alphabets = ["abcdefghijkl", "éàüß'", " ", " \n\t", "12ab's", "日本語かな", "हिन्दी", "ΣσİI", "\x0b\x85\u3000", "\u0301e "]
    for _ in range(150):
        text = rng.choice(texts)[: rng.randrange(3000)] + "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(900))) + rng.choice(["", "<|endoftext|> x", " don't"])
        assert np.frombuffer(enc.encode_many([text.encode()])[0], dtype=enc.dtype).tolist() == library.encode(text, add_special_tokens=False).ids
    assert enc.joins > 500


def test_trees_of_long_texts(library):
    enc = bpe.PieceEncoder(VOCAB)
    for text in ("ab" * 60_000, "the quick fox's " * 70_000, " " * 1_100_000, "a " + "é" * 20_000):
        assert np.frombuffer(enc.encode_many([text.encode()])[0], dtype=enc.dtype).tolist() == library.encode(text, add_special_tokens=False).ids
    assert enc.joins > 100
    assert max(map(len, enc.cache), default=0) <= bpe.CACHED_PIECE


def test_codec_on_odd_rows(odd_docs, no_docs, library):
    got = bpe.digest_documents(odd_docs, VOCAB).collect()
    want = Counter()
    for r in odd_docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[(r.doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in got) == want
    assert bpe.digest_documents(no_docs, VOCAB).count() == 0


def test_store_round_trip(spark, odd_docs, no_docs, library):
    path = common.scratch_dir(spark, "store")
    token_store.write_store(odd_docs, path, VOCAB, end_id=2, shards=3)
    got = sorted(token_store.read_store(spark, path).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    texts = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [2] for r in odd_docs.collect()}
    for r in got:
        raw = np.array(texts[r.doc_id], dtype="<u4").tobytes()
        assert (bytes(r.ids), r.ids_crc32) == (raw, zlib.crc32(raw))
    empty = common.scratch_dir(spark, "store")
    token_store.write_store(no_docs, empty, VOCAB, end_id=2)
    assert token_store.read_store(spark, empty).count() == 0


class Ranges:
    """A file that counts what is read of it."""

    def __init__(self, data):
        self.data, self.at, self.got = data, 0, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        self.got += n
        return self.data[self.at : self.at + n]


def test_shard_finds_one_document():
    out = io.BytesIO()
    w = token_store.ShardWriter(out, b"", 2)
    rng = np.random.default_rng(1)
    texts = {k: rng.integers(0, 40_000, 2000).astype("<u2").tobytes() for k in range(0, 3000, 3)}
    w.add(None, b"ab")
    for k, v in texts.items():
        w.add(k, v)
    w.close()
    data = out.getvalue()
    file = Ranges(data)
    r = token_store.ShardReader(file, len(data), b"")
    assert r.find(900) == texts[900]
    assert file.got < 10_000 < len(data) // 100
    with pytest.raises(KeyError):
        r.find(4)
    assert [x[0] for part in r.scan() for x in part] == [None, *texts]
    assert [x[2] for part in r.scan() for x in part] == [b"ab", *texts.values()]
    with pytest.raises(ValueError, match="dictionary"):
        token_store.ShardReader(file, len(data), b"other")


def test_store_finds_one_document(spark, some_docs, library):
    path = common.scratch_dir(spark, "store")
    manifest = token_store.write_store(some_docs, path, VOCAB, end_id=2, shards=4)
    assert len(manifest["shards"]) > 1
    store = token_store.Store(path)
    for r in some_docs.filter("doc_id % 37 = 0").collect():
        assert store.find(r.doc_id) == [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
    with pytest.raises(KeyError):
        store.find(-5)


def test_store_of_null_ids(spark, some_docs):
    path = common.scratch_dir(spark, "store")
    nulls = some_docs.limit(30).withColumn("doc_id", F.lit(None).cast("long"))
    token_store.write_store(nulls, path, VOCAB, end_id=2, shards=3)
    got = sorted(token_store.read_store(spark, path).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    assert len(got) == 30


def test_mixing(odd_docs, no_docs, some_docs):
    got = mixing.mix(odd_docs).collect()
    assert len(got) == odd_docs.count()
    for docs in (odd_docs, some_docs):
        by = {}
        for r in mixing.mix(docs).collect():
            assert r.taken in (0, r["size"], 2 * r["size"])
            by.setdefault((r.source, r.target, r.source_size), []).append(r)
        total = sum(k[2] for k in by)
        assert math.isclose(sum(k[1] for k in by), 1.5 * total)
        for (_, target, size), rows in by.items():
            assert target <= 2 * size + 1e-9
            assert abs(sum(r.taken for r in rows) - target) <= max(r["size"] for r in rows) * 2
    assert mixing.mix(no_docs).count() == 0


def test_mixing_of_rows_without_ids(spark):
    """Null and repeated ids, equal rows among them, still meet the targets; the query is its SQL."""
    import duckdb

    rows = spark.range(3000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).cast("long").alias("doc_id"), F.concat(F.lit("one two "), (F.col("id") % 7).cast("string")).alias("text"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source")).repartition(5)
    path = common.scratch_dir(spark, "mix-test")
    rows.write.parquet(path)
    got = mixing.mix(spark.read.parquet(path)).select("doc_id", "size", "source_size", "target", "taken")
    for r in mixing.mix(spark.read.parquet(path)).groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) <= 3
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path.removeprefix('file://')}/*.parquet'")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.sql(mixing.OP2_SQL).fetchall(), key=str)


def test_quality_counts(odd_docs, no_docs):
    got = {r.doc_id: r for r in quality_rules.judge(odd_docs).collect()}
    assert got[2].base_failed
    assert not got[2].kept
    assert got[8].n_dup_lines == 2
    for r in odd_docs.collect():
        words = WORD.findall(r.text or "")
        grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        places = {k + j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(5)}
        assert (got[r.doc_id].n_words, got[r.doc_id].word_chars, got[r.doc_id].n_repeat_words) == (len(words), sum(map(len, words)), len(places))
    assert quality_rules.judge(no_docs).count() == 0


@pytest.fixture(scope="module")
def verdicts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, quality_rules.judge(docs).collect()


def test_quality_rejects_most_labelled_junk(spark, verdicts):
    docs, got = verdicts
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    long = [r for r in got if not r.base_failed and r.n_words >= quality_rules.MIN_CLASS_WORDS and r.doc_id in labels]
    lost = {q: np.mean([not r.kept for r in long if labels[r.doc_id] == q]) for q in (0, 1)}
    assert lost[0] > 0.8
    assert lost[1] < 0.01
    kept = quality_rules.reject(docs, ("doc_id", "text"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)


def test_quality_verdicts_match_sql(spark, verdicts):
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = con.sql(quality_rules.OP4_SQL).select(*quality_rules.COLUMNS).fetchall()
    assert sorted(tuple(r[c] for c in quality_rules.COLUMNS) for r in verdicts[1]) == sorted(want)


def test_quality_of_many_languages_is_that_of_few(verdicts, monkeypatch):
    """References that are joined by salt give the same verdicts as broadcast ones."""
    monkeypatch.setattr(quality_rules, "BROADCAST_LANGUAGES", 0)
    docs, got = verdicts
    assert sorted((r.doc_id, r.kept) for r in quality_rules.judge(docs).select("doc_id", "kept").collect()) == sorted((r.doc_id, r.kept) for r in got)


def test_audio(odd_docs, no_docs):
    got = audio.describe(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.feature))
    for text in odd_docs.collect():
        raw = (text.text or "").encode()
        pad = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        (only,) = by[text.doc_id]
        assert only[:5] == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]), 44 + len(pad))
        assert only[5].startswith(f"frames={len(audio.features(audio.to_wav(pad))['mel'])};")
    assert audio.describe(no_docs).count() == 0


def test_stored_tensors(spark, odd_docs):
    """What is stored is a fixed-shape tensor column with time spans, and it holds the features."""
    import pyarrow as pa

    path = common.scratch_dir(spark, "tensors")
    files = audio.extract(audio.store_media(odd_docs), path).collect()
    texts, seen = {r.doc_id: r.text for r in odd_docs.collect()}, 0
    for f in files:
        for batch in audio.read_features(path, f.file):
            assert batch.column("log_mel").type == pa.fixed_shape_tensor(pa.float32(), (audio.PATCH_FRAMES, audio.MELS))
            tensors = batch.column("log_mel").to_numpy_ndarray()
            for k, row in enumerate(batch.drop_columns(["log_mel"]).to_pylist()):
                want = audio.features(audio.to_wav(audio.padded((texts[row["doc_id"]] or "").encode())))
                assert np.array_equal(tensors[k], want["patches"][row["patch"]])
                assert (row["start"], row["stop"]) == want["spans"][row["patch"]]
                assert all(row["start"] - 1e-9 <= s["start"] < s["stop"] for s in row["segments"])
                seen += row["patch"] == 0
    assert seen == odd_docs.count()


@pytest.mark.parametrize(("up", "down"), [(160, 441), (3, 4), (1, 2), (5, 3)])
def test_resampling_is_filter_then_decimate(up, down):
    """Against zero-stuffing to the common rate, one plain convolution, and taking every down-th value."""
    x = np.random.default_rng(1).normal(size=700)
    taps = audio.TAPS
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    full = np.convolve(stuffed, audio.low_pass(up, down))
    # Output k ends its window at input k * down // up + taps // 2 - 1, at the phase that is left over.
    want = [full[(k * down // up + taps // 2 - 1) * up + k * down % up] if (k * down // up + taps // 2 - 1) * up + k * down % up < len(full) else 0 for k in range(-(-len(x) * up // down))]
    assert np.allclose(audio.resample(x, up, down), want, atol=1e-9)


def test_log_mel_is_that_of_the_definition():
    x, rate = np.random.default_rng(2).normal(size=1500), 16_000
    mel, power = audio.log_mel(x, rate)
    hz = lambda m: 700 * (10 ** (m / 2595) - 1)
    top = 2595 * math.log10(1 + rate / 2 / 700)
    for t in range(len(mel)):
        frame = np.zeros(audio.FRAME)
        part = x[t * audio.HOP : t * audio.HOP + audio.FRAME]
        frame[: len(part)] = part
        windowed = frame * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(audio.FRAME) / (audio.FRAME - 1)))
        spectrum = [abs(sum(v * np.exp(-2j * np.pi * f * np.arange(audio.FRAME) / audio.FRAME)[i] for i, v in enumerate(windowed))) ** 2 for f in (3, 40)] if t == 0 else None
        if spectrum:
            assert np.allclose(spectrum, np.abs(np.fft.rfft(windowed))[[3, 40]] ** 2)
        energy = np.abs(np.fft.rfft(windowed)) ** 2
        for m in range(audio.MELS):
            low, mid, high = (hz(top * (m + k) / (audio.MELS + 1)) for k in range(3))
            weight = [max(0.0, min((f - low) / (mid - low), (high - f) / (high - mid))) for f in np.arange(audio.FRAME // 2 + 1) * rate / audio.FRAME]
            weight[int(np.argmin([abs(f - mid) for f in np.arange(audio.FRAME // 2 + 1) * rate / audio.FRAME]))] += 1e-3
            assert math.isclose(mel[t, m], math.log10(float(np.dot(energy, weight)) + 1e-6), rel_tol=1e-9)
        assert math.isclose(power[t], float((frame**2).mean()), rel_tol=1e-9)
    assert audio.hysteresis(np.array([-2, 0, 2, 0, -2, 0, 2.0])) == [(2, 4), (6, 7)]


def test_language_model(some_docs, odd_docs, no_docs):
    rows = some_docs.collect()
    toks = {r.doc_id: [*(r.text or "").encode().lower().split(), b""] for r in rows}
    count = Counter(t for k, v in toks.items() if zlib.crc32(str(k).encode()) % 7 != 2 for t in v)
    n, v = sum(count.values()), len(count)
    better = []
    for r in language_model.score_documents(some_docs).collect():
        t = toks[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(count[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        if r.held_out:
            better.append((r.base_score, r.score))
    assert sum(b for _, b in better) > sum(a for a, _ in better)
    assert language_model.score_documents(odd_docs).filter("score > 0 OR score IS NULL").count() == 0
    assert language_model.score_documents(no_docs).count() == 0


def test_model_is_a_distribution():
    n = language_model.LEVELS
    w = language_model.learn_weights(np.array([0, 5 * n * n + 90 * n + 80]), np.array([10, 100]), np.array([0.0, 4000.0]), np.array([0.0, 700.0]))
    assert np.allclose(w.sum(1), 1)
    assert w[0][0] == 0


def test_scores_are_those_of_brute_force(spark, some_docs, monkeypatch):
    """The whole model again, with plain dictionaries and exact ratios instead of a histogram."""
    monkeypatch.setattr(language_model, "MIN_BATCHES", 3)
    rows = some_docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b""))), F.lit(3)).alias("batch")).collect()
    toks = [[*(r.text or "").encode().lower().split(), b""] for r in rows]
    pairs = [list(zip([b"", *t], t)) for t in toks]  # the first follows an end
    train = [zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for r in rows]
    c1, c2, own1, own2, ends = Counter(), Counter(), {}, {}, Counter()
    for r, t, p, keep in zip(rows, toks, pairs, train):
        if keep:
            c1.update(t)
            c2.update(p)
            own1.setdefault(r.batch, Counter()).update(t)
            own2.setdefault(r.batch, Counter()).update(p)
    n, v = sum(c1.values()), len(c1)
    bucket = lambda c: min(language_model.BUCKETS - 1, int(math.log2(c)) + 1) if c else 0
    seen = {}
    for r, p, keep in zip(rows, pairs, train):
        if keep:
            rest = n - sum(own1[r.batch].values())
            for a, b in p:
                a1 = c1[a] - own1[r.batch][a]
                seen.setdefault(bucket(a1), []).append(((c2[a, b] - own2[r.batch][a, b]) / a1 if a1 else 0.0, (c1[b] - own1[r.batch][b]) / rest, 1 / (v + 1)))
    weights = {}
    for k, x in [(None, sum(seen.values(), [])), *seen.items()]:  # contexts of buckets that were not seen take the weights of all
        x, w = np.array(x), np.full(3, 1 / 3)
        for _ in range(300):
            e = x * w
            w = (e / e.sum(1, keepdims=True)).sum(0)
            w /= w.sum()
        weights[k] = w
    got = {r.doc_id: r.score for r in language_model.score_documents(some_docs).collect()}
    diffs = []
    for r, p in zip(rows, pairs):
        want = 0.0
        for a, b in p:
            w = weights.get(bucket(c1[a]), weights[None])
            want += math.log10(w @ np.array([c2[a, b] / c1[a] if c1[a] else 0.0, c1[b] / n, 1 / (v + 1)]))
        diffs.append(abs(want - got[r.doc_id]) / len(p))  # of a token's logarithm
    assert max(diffs) < 1e-3


def test_line_chain_marginals_are_exact():
    rng, chain = np.random.default_rng(2), line_crf.LineChain()
    chain.pair = rng.normal(size=(2, 2))
    u, starts = rng.normal(size=7), np.array([0, 3, 3, 7])
    p, pairs = chain.marginals(u, starts)
    want, both = np.zeros(7), np.zeros((2, 2))
    for a, b in ((0, 3), (3, 7)):
        z = 0.0
        own, two = np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            s = math.exp(sum(u[a + k] * v for k, v in enumerate(y)) + sum(chain.pair[i, j] for i, j in zip(y, y[1:])))
            z += s
            own += s * np.array(y)
            for i, j in zip(y, y[1:]):
                two[i, j] += s
        want[a:b] = own / z
        both += two / z
    assert np.allclose(p, want)
    assert np.allclose(pairs, both)


def test_line_quality(spark, sf, odd_docs, no_docs):
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    chain = line_crf.train(docs, labels)
    got = line_crf.score_documents(docs, chain).join(labels, "doc_id").collect()
    assert np.mean([(r.score >= line_crf.THRESHOLD) == (r.quality == 1) for r in got]) > 0.9
    assert line_crf.score_documents(odd_docs, chain).filter("score BETWEEN 0 AND 1").count() == odd_docs.count()
    assert line_crf.score_documents(no_docs, chain).count() == 0
    assert line_crf.train(no_docs, labels.limit(0)).share == 1.0


def test_language_mixture(some_docs, odd_docs, no_docs):
    model = language_mix.train(some_docs)
    got = language_mix.predict_documents(some_docs, model).join(some_docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    odd = {r.doc_id: r.lang_pred for r in language_mix.predict_documents(odd_docs, model).collect()}
    assert {odd[k] for k in (2, 3, 7)} == {"und"}
    assert language_mix.train(no_docs).predict("some text") == ("und", 0.0)
    assert [model.predict(t) for t in ("½ ²", "Ⅷ", "12 _ 3", "")] == [("und", 0.0)] * 4
    long = model.predict_many([" ".join(["the", "of", "and"] * 150_000), "the of and that is"])
    assert [x[0] for x in long] == ["en", "en"]


def brute_mixture(model, text):
    """One document at a time: plain loops over words, expectation-maximisation to a finer tolerance, the same growth of the set."""
    words, raw = [], " " + text.lower() + " "
    for w in re.split("[\x00-\x60\x7b-\x7f]+", raw):
        if w:
            b = b" " + w.encode() + b" "
            hashes = [((b[k] << 16 | b[k + 1] << 8 | b[k + 2]) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - model.bits) for k in range(len(b) - 2)]
            words.append([math.exp(float(sum(model.logp[h, k].astype(float) for h in hashes))) for k in range(len(model.langs))])

    def em(chosen):
        p = {k: 1 / len(chosen) for k in chosen}
        for _ in range(3000):
            new = dict.fromkeys(chosen, 0.0)
            for w in words:
                z = sum(p[k] * w[k] for k in chosen)
                for k in chosen:
                    new[k] += p[k] * w[k] / z / len(words)
            moved = max(abs(new[k] - p[k]) for k in chosen)
            p = new
            if moved < 1e-6:
                break
        return p, sum(math.log(sum(p[k] * w[k] for k in chosen)) for w in words)

    full, _ = em(list(range(len(model.langs))))
    order = sorted(full, key=lambda k: -full[k])
    best = (-math.inf, None, 0)
    for n in range(1, len(order) + 1):
        p, like = em(order[:n])
        value = like - language_mix.PENALTY * n * math.log(len(words) + 1)
        if value <= best[0]:
            break
        lead = max(p, key=lambda k: p[k])
        best = (value, model.langs[lead], p[lead])
    return best[1:]


def test_mixture_is_that_of_brute_force(some_docs):
    model = language_mix.train(some_docs)
    by = {}
    for r in some_docs.filter("text IS NOT NULL AND length(text) < 1500").limit(120).collect():
        by.setdefault(r.lang, []).append(r.text)
    texts = [t for v in by.values() for t in v[:3]]
    langs = sorted(by)
    texts += [by[a][0] + " " + by[b][1] for a, b in itertools.combinations(langs, 2)] + [" ".join(by[k][0] for k in langs)]
    for text, (lang, score) in zip(texts, model.predict_many(texts)):
        want = brute_mixture(model, text)
        assert lang == want[0] or abs(score - 0.5) < 0.02
        assert abs(score - want[1]) < 0.02


def test_every_language_has_a_model(spark):
    """Some hundreds of languages, and one that is all long texts."""
    rng = random.Random(1)
    rows = []
    for k in range(450):
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(3)]
        rows += [(10 * k + j, " ".join(own * 5), f"l{k:03d}") for j in range(4)]
    rows += [(10**6 + j, "zyzzyva quux " * 8000, "long") for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_mix.train(docs)
    assert set(model.langs) == {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 5}
    assert len(model.langs) > 440
    assert model.bits < language_mix.HASH_BITS
    assert model.predict("quux zyzzyva quux")[0] == "long"
    got = model.predict_many([r[1] for r in rows[:-3:4]])
    assert np.mean([g[0] == r[2] for g, r in zip(got, rows[:-3:4]) if r[2] in model.langs]) > 0.99


def test_secret_base_spans(odd_docs, no_docs):
    plain = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    rng = random.Random(4)
    parts = ["password", "TOKEN", ": ", "=", " = '", "abc", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", "cafe", " ", "é", "secret", "\n", "ſecret=aaaaaaa"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        want = [(m.start(), 0, m.end()) for m in plain.finditer(text) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        assert [s[:3] for s in secret_scan.base_spans(text)] == sorted(want)
    rows = {r.doc_id: r for r in secret_scan.scan_documents(odd_docs, None).collect()}
    assert rows[None].n_assign == 2
    assert rows[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secret_scan.redact("a password=hunter22!", secret_scan.scan("a password=hunter22!", None)) == "a password=[SECRET]!"
    assert secret_scan.scan_documents(no_docs, None).count() == 0
    assert secret_scan.train(no_docs) is None


def brute_forward(net, win):
    """The network by loops: every step of the surroundings and of the candidate, one after the other."""
    chars = [c if c < 127 else 127 for c in map(ord, win)]
    width, emb = net.WIDTH, net.w["e"]
    act = lambda at: np.maximum(np.concatenate([emb[c] for c in chars[at : at + width]]) @ net.w["k"] + net.w["kb"], 0)
    edge = secret_scan.BEFORE - width + 1
    near = np.max([act(k) for k in range(edge)], axis=0)
    own = np.max([act(k) for k in range(edge, len(chars) - width + 1)], axis=0)
    token = chars[secret_scan.BEFORE : len(chars) - secret_scan.AFTER]
    extra = [sum(48 <= c <= 57 for c in token) / len(token), len(set(token)) / min(len(token), 40), min(len(token), 64) / 64]
    return float(np.concatenate([near, own, extra]) @ net.w["o"] + net.w["ob"][0])


def random_windows(n=12, seed=3):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("abcdef0123456789XYZ+/é ") for _ in range(k))
    return [secret_scan.window(t := text(30 + size + 20), 20, 20 + size) for size in [6, 43, 44, 45, 88, 200, 1000, *(rng.randrange(6, 60) for _ in range(n))]]


def test_secret_network_is_that_of_brute_force():
    wins = random_windows()
    net = secret_scan.CharNet()
    assert np.allclose(net.raw(secret_scan.encode_windows(wins)), [brute_forward(net, w) for w in wins])


def test_secret_network_gradient():
    wins = random_windows()
    x, net = secret_scan.encode_windows(wins), secret_scan.CharNet()
    d = np.random.default_rng(4).normal(size=len(wins))
    got = net.gradient(x, d, net.forward(x)[1])
    rng, step = np.random.default_rng(5), 1e-6
    for name, w in net.w.items():
        for at in rng.integers(0, w.size, 25):
            held = w.flat[at]
            values = []
            for sign in (1, -1):
                w.flat[at] = held + sign * step
                values.append(net.forward(x)[0] @ d)
            w.flat[at] = held
            assert math.isclose((values[0] - values[1]) / (2 * step), got[name].flat[at], rel_tol=1e-3, abs_tol=1e-6)


def test_secret_labels_are_those_of_brute_force(some_docs, odd_docs):
    for r in [*some_docs.collect(), *odd_docs.collect()]:
        text = r.text or ""
        values = [(v, e) for _, _, e, v in secret_scan.base_spans(text)]
        assert secret_scan.labels_of(text) == [(a, e, int(any(v < e and a < x for v, x in values))) for a, e in secret_scan.candidates(text)]


def test_secret_recall(spark):
    """Findings of held-out documents without their surroundings, and formats that no base pattern knows."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    net = secret_scan.train(docs.filter("doc_id % 2 = 0"))
    held = [r.text for r in docs.filter("doc_id % 2 = 1 AND text IS NOT NULL").collect()]
    found, clean = [], 0
    for text in held:
        for a, e, label in secret_scan.labels_of(text):
            if label:
                found.append("\0" * secret_scan.BEFORE + text[a:e] + "\0" * secret_scan.AFTER)
    scores = net.score(secret_scan.encode_windows(found))
    assert len(found) > 40
    assert (scores >= net.threshold).mean() >= 0.9
    made = secret_scan.generated([secret_scan.window(t, 40, 60) for t in held if len(t) > 100], 300, seed=77)
    assert (net.score(secret_scan.encode_windows(made)) >= net.threshold).mean() >= 0.9
    spans = secret_scan.scan_many(held, net)
    base = [{(a, e) for a, k, e, _ in s if k < 3} for s in spans]
    clean = sum(any(k == 3 for _, k, _, _ in s) and not b for s, b in zip(spans, base))
    assert clean < 0.005 * len(held)
    assert sum(k == 3 for s in spans for _, k, _, _ in s) >= 0.9 * len(found)


def test_secrets_without_a_base_pattern(spark, some_docs, odd_docs):
    """A small corpus has a model too, and it adds spans that no base pattern gives; long texts take linear time."""
    net = secret_scan.train(some_docs)
    text = "the deploy note says dG9rZW4tMTIzNDU2Nzg5MGFiY2RlZg9xQz and more words of the day"
    (span,) = secret_scan.scan(text, net)
    assert (secret_scan.KINDS[span[1]], text[span[0] : span[2]]) == ("model", "dG9rZW4tMTIzNDU2Nzg5MGFiY2RlZg9xQz")
    many = " ".join(f"{k:032x}" for k in range(10**9, 10**9 + 20_000))
    assert sum(k == 2 for _, k, _, _ in secret_scan.scan(many, net)) == 20_000
    assert secret_scan.scan("x" * 1_200_000, net) is not None
    assert secret_scan.scan_documents(odd_docs, net).count() == odd_docs.count()


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]), seed=42) for k in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(odd_docs):
    got = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(odd_docs).collect()}
    assert got == {r.doc_id: brute_fingerprint(r.text) for r in odd_docs.collect()}


@pytest.mark.parametrize(("bits", "slice_variants"), [(6, 1 << 22), (6, 1000), (9, 1 << 22)])
def test_links_keep_all_components(bits, slice_variants):
    rng = random.Random(bits + slice_variants)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(200):
        x = rng.choice(fps)
        for _ in range(rng.randrange(1, 6)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    x = np.unique(np.array(fps, dtype=np.uint64))
    groups = set(simhash.masks_by_syndrome(2, bits))
    assert sum(map(len, simhash.masks_by_syndrome(2, bits).values())) == 1 + 64 + 64 * 63 // 2
    parent = {int(v): int(v) for v in x}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for s in {int(o) ^ g for o in np.unique(simhash.syndromes(x, bits)) for g in groups}:
        for a, b in zip(*simhash.colliding(x, s, 2, bits, slice_variants)):
            parent[max(find(int(a)), find(int(b)))] = min(find(int(a)), find(int(b)))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    label = np.arange(len(x))
    while True:
        new = np.where(near, label[None, :], len(x)).min(1)
        if (new == label).all():
            break
        label = new
    assert [find(int(v)) for v in x] == [int(x[k]) for k in label]


@pytest.mark.parametrize("share", [1 << 25, 40])
def test_links_are_those_of_brute_force(spark, monkeypatch, share):
    """Whole runs with the short code and with one so long that a fingerprint goes to a part of the tasks."""
    monkeypatch.setattr(simhash, "TASK_FINGERPRINTS", share)
    monkeypatch.setattr(simhash, "SEND_COPIES", 1 << 14)
    rng = random.Random(share)
    fps = [0, (1 << 64) - 1, *(rng.getrandbits(64) for _ in range(20))]
    for _ in range(60):
        fps.append(rng.choice(fps) ^ sum(1 << b for b in set(rng.choices(range(64), k=rng.randrange(1, 6)))))
    fps = sorted(set(fps))
    assert (simhash.code_bits(len(fps), 2) > 6) == (share == 40)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    edges = simhash.links(spark.createDataFrame([(f - (1 << 64) * (f >> 63),) for f in fps], "fp long")).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")

    def parts(links):
        group = {f: {f} for f in fps}
        for a, b in links:
            if group[a] is not group[b]:
                group[a] |= group[b]
                for f in group[b]:
                    group[f] = group[a]
        return {frozenset(g) for g in group.values()}

    near = [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 4]
    assert parts((r.u & (1 << 64) - 1, r.v & (1 << 64) - 1) for r in edges) == parts(near)


def test_near_duplicates(spark, odd_docs, no_docs):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(odd_docs).collect()}
    assert got[2] == got[3] == got[7] == 2
    assert got[1] == 1
    assert simhash.near_duplicates(no_docs).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.range(1, 60).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    assert {r.label for r in simhash.components(edges).collect()} == {0}


def test_components_are_those_of_brute_force(spark):
    """Random graphs with hubs: more edges than HOT_KEYS, so that hubs are joined by broadcast."""
    rng = random.Random(8)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1500)] + [(5, k) for k in range(3000, 4200)] + [(k, 7) for k in range(5000, 5400)]
    edges = [(a, b) for a, b in edges if a != b]
    label = {v: v for e in edges for v in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    got = {r.node: r.label for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == label


def test_hot_fingerprints(spark):
    """Empty texts share one fingerprint; each row is there once, with the smallest doc_id of all."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("")).otherwise(F.concat(F.lit("w"), F.sha2(F.col("id").cast("string"), 256))).alias("text"))
    got = simhash.near_duplicates(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    assert {r.component_id for r in got if r.doc_id % 3} == {1}


def test_pipeline_runs(spark, tmp_path, sf, library):
    """The whole run: what comes out are the digests of what the last stage but one kept."""
    import corpus_pipeline as p

    docs = common.table(spark, sf, "documents").limit(120)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = p.run(spark, str(tmp_path))
    docs = common.table(spark, str(tmp_path), "documents")
    for _, stage in p.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, str(tmp_path)), "pipeline-test")
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[(r.doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in out.collect()) == want
    assert want


def test_all_operators_on_all_nulls(spark):
    """A table whose every value is null."""
    nulls = spark.createDataFrame([(None,) * 5] * 4, "doc_id long, text string, lang string, source string, n_chars long")
    assert bpe.digest_documents(nulls, VOCAB).count() == 4
    assert {r.taken for r in mixing.mix(nulls).collect()} == {0}
    assert {r.kept for r in quality_rules.judge(nulls).collect()} == {False}
    assert {r.n_bytes for r in audio.describe(nulls).collect()} == {0}
    assert {r.n_tokens for r in language_model.score_documents(nulls).collect()} == {1}
    assert {r.lang_pred for r in language_mix.predict_documents(nulls, language_mix.train(nulls)).collect()} == {"und"}
    assert {r.spans for r in secret_scan.scan_documents(nulls, secret_scan.train(nulls)).collect()} == {""}
    assert [r.component_id for r in simhash.near_duplicates(nulls).collect()] == [None] * 4
    chain = line_crf.train(nulls, spark.createDataFrame([(None, None)], "doc_id long, quality int"))
    assert {r.score for r in line_crf.score_documents(nulls, chain).collect()} == {1.0}


def test_pipeline_stages(spark, sf, odd_docs, no_docs):
    import corpus_pipeline as p

    for docs in (odd_docs, no_docs):
        for _, stage in p.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert tuple(out.columns) == p.COLUMNS
            out.count()
    kept = p.near_duplicates(spark, odd_docs, sf)
    assert kept.filter("doc_id IN (3, 7)").count() == 0
    assert kept.filter("doc_id = 2").count() == 1


def test_pipeline_stages_with_repeated_ids(spark, sf):
    """Rows that share an id (or have none) are judged one by one, and each group keeps exactly one row."""
    import corpus_pipeline as p

    fox = "The quick fox of the hill and the river is in a valley to see it for that was on the way"
    hen = "A brown hen by the old barn sat with nine eggs as the cold rain fell on every roof of our town"
    owl = "Some grey owl flew over wide fields at night while all mice hid under hay near that broken mill"
    rows = [(1, fox), (1, fox), (5, fox), (5, hen), (None, hen), (None, owl), (None, owl), (None, "short one"), (7, "short"), (7, owl + " again")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    clean = p.quality(spark, docs, sf)
    assert sorted((r.doc_id or 0, r.text) for r in clean.collect()) == sorted((i or 0, t) for i, t in rows if len(t.split()) >= 10)
    groups = {}
    for i, t in rows:
        f = brute_fingerprint(t)
        linked = [g for g in groups if any((f ^ x).bit_count() <= 4 for x in g)]
        merged = sorted((m for g in linked for m in groups.pop(g)), key=str) + [(i, t)]
        groups[frozenset(brute_fingerprint(t) for _, t in merged)] = merged
    kept = [(r.doc_id, r.text) for r in p.near_duplicates(spark, docs, sf).collect()]
    assert len(kept) == len(groups)
    for group in groups.values():
        least = min((i for i, _ in group if i is not None), default=None)
        assert sum(k in group for k in kept) == 1
        assert any(k in group and k[0] == least for k in kept)

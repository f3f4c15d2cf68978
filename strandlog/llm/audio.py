"""Operator 3: audio features of media columns.

A payload of 8-bit samples is stored losslessly as a mono PCM WAV, in a table in
the shared folder, and read back from the stored bytes. Features: polyphase
resampling from 44.1 to 16 kHz (a windowed-sinc low-pass, split by output phase:
160 phases, every output is one of them), log-mel energies of overlapped frames,
and segments of the frame energy by hysteresis (a segment opens above the upper
and ends below the lower threshold). Log-mel frames are dealt into patches of
one fixed shape, each with its time span, and stored as Arrow files with a
fixed-shape tensor column; the query's digests are of what those files hold.

Frames are computed in blocks, per document, so equal payloads give equal
values; memory grows with one payload (about forty bytes a byte), not with a
batch. A task writes its file under a name of its own and renames it, so a task
that runs twice leaves the same file. Defined results: a null or empty text is
192 spaces; repeated rows give repeated results; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from strandlog.llm.common import bounded, doc_bytes, materialize, scratch_dir, store_fs, table

UNIT = 192
RATE, UP, DOWN = 44_100, 160, 441
FRAME, HOP, MELS = 400, 160, 20
TAPS = 16  # of each phase
PATCH_FRAMES = 16
BLOCK_FRAMES, BLOCK_OUTPUTS = 4096, 1 << 16
#: Decibels of frame energy, against the document's mean, at which a segment opens and ends.
OPEN_DB, END_DB = 0.5, -0.5
#: Log energy of the padding of a last patch.
SILENCE = -6.0
#: Bytes of media, and patches, that a batch holds.
MEDIA_BYTES, BATCH_PATCHES = 1 << 20, 4096


def padded(text: bytes) -> bytes:
    """The payload: bytes 32 appended up to a positive multiple of 192."""
    return text + b" " * ((-len(text)) % UNIT if text else UNIT)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """An 8-bit mono PCM WAV; its data chunk is padded to even length as the format asks."""
    pad = b"\0" * (len(payload) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + pad


def from_wav(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of an 8-bit mono PCM WAV, by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@functools.lru_cache(maxsize=8)
def low_pass(up: int, down: int, taps: int = TAPS):
    """Windowed-sinc coefficients at the rate of both, ``taps`` for each output phase."""
    import numpy as np

    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hamming(n)
    return h * (up / h.sum())


@functools.lru_cache(maxsize=8)
def phases(up: int, down: int, taps: int = TAPS):
    """The low-pass filter split by output phase: row p holds every ``up``-th coefficient from p, newest input last."""
    import numpy as np

    return np.ascontiguousarray(low_pass(up, down, taps).reshape(taps, up).T[:, ::-1])


def resample(x, up: int = UP, down: int = DOWN):
    """Output k stands at k * down / up inputs: phase k * down % up of the filter over the inputs around it."""
    import numpy as np

    bank, taps = phases(up, down), TAPS
    n = -(-len(x) * up // down)
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(taps // 2), x, np.zeros(taps + down // up)]), taps)
    out = np.empty(n)
    for k in range(0, n, BLOCK_OUTPUTS):
        at, phase = np.divmod(np.arange(k, min(n, k + BLOCK_OUTPUTS)) * down, up)
        out[k : k + len(at)] = (view[at] * bank[phase]).sum(1)
    return out


@functools.lru_cache(maxsize=8)
def mel_bank(rate: int, frame: int = FRAME, mels: int = MELS):
    """Triangular filters with centres equally spaced in mel, overlapping by half."""
    import numpy as np

    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    hz = np.arange(frame // 2 + 1) * rate / frame
    low, mid, high = (edges[k : k + mels, None] for k in range(3))
    bank = np.clip(np.minimum((hz - low) / (mid - low), (high - hz) / (high - mid)), 0, None)
    bank[np.arange(mels), np.abs(hz[None] - mid).argmin(1)] += 1e-3  # no filter is empty
    return np.ascontiguousarray(bank.T)


def log_mel(x, rate: int):
    """Log energies (frames, MELS) of overlapped Hann frames, and each frame's mean square; the last frame is padded with zeros."""
    import numpy as np

    frames = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    x = np.concatenate([x, np.zeros(max(0, (frames - 1) * HOP + FRAME - len(x)))])
    view = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    bank, hann = mel_bank(rate), np.hanning(FRAME)
    out, power = np.empty((frames, MELS)), np.empty(frames)
    for at in range(0, frames, BLOCK_FRAMES):
        block = view[at : at + BLOCK_FRAMES]
        spectrum = np.fft.rfft(block * hann)
        out[at : at + BLOCK_FRAMES] = np.log10(np.einsum("ij,jk->ik", spectrum.real**2 + spectrum.imag**2, bank, optimize=False) + 1e-6)
        power[at : at + BLOCK_FRAMES] = (block**2).mean(1)
    return out, power


def hysteresis(energy, open_at: float = OPEN_DB, end_at: float = END_DB):
    """(start, stop) frames of segments: opened at the upper threshold, kept until below the lower."""
    import numpy as np

    mark = np.where(energy >= open_at, 1, np.where(energy < end_at, -1, 0))
    place = np.where(mark != 0, np.arange(len(mark)), -1)
    last = np.maximum.accumulate(place)
    on = np.where(last >= 0, mark[np.maximum(last, 0)], -1) == 1
    step = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()))


def features(media: bytes) -> dict:
    """patches (n, PATCH_FRAMES, MELS) as 32-bit floats, their spans and the segments in seconds, and the frames, from the stored bytes."""
    import numpy as np

    rate, samples = from_wav(media)
    y = resample((np.frombuffer(samples, dtype=np.uint8) - 128.0) / 128)
    out_rate = rate * UP // DOWN
    mel, power = log_mel(y, out_rate)
    level = 10 * np.log10(power + 1e-10)
    count = -(-len(mel) // PATCH_FRAMES)
    patches = np.full((count * PATCH_FRAMES, MELS), SILENCE, dtype=np.float32)
    patches[: len(mel)] = mel
    second = HOP / out_rate
    spans = [(k * PATCH_FRAMES * second, min((k + 1) * PATCH_FRAMES, len(mel)) * second) for k in range(count)]
    return {"patches": patches.reshape(count, PATCH_FRAMES, MELS), "spans": spans, "segments": [(a * second, b * second) for a, b in hysteresis(level - level.mean())], "mel": mel, "power": power}


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the payloads as WAVs, written to the shared folder and read back."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in bounded(batches, MEDIA_BYTES):
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array([to_wav(padded(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return materialize(doc_bytes(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary"), "audio-media")


def tensor_schema(doc_id):
    """The columns of the stored features: a row per patch, the patch as a fixed-shape tensor, with digests of the media it is from."""
    import pyarrow as pa

    span = pa.struct([("start", pa.float64()), ("stop", pa.float64())])
    tensor = pa.fixed_shape_tensor(pa.float32(), (PATCH_FRAMES, MELS))
    return pa.schema([("row", pa.int64()), ("doc_id", doc_id), *((n, pa.string() if n.endswith("sha256") else pa.int64()) for n in MEDIA), ("patch", pa.int64()), ("log_mel", tensor), ("start", pa.float64()), ("stop", pa.float64()), ("segments", pa.list_(span))])


MEDIA = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")


def media_digest(n_bytes: int, media: bytes) -> tuple:
    """MEDIA of one stored payload."""
    back = from_wav(media)[1]
    return n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest()


def patch_batch(held: list, schema):
    """A record batch of (row, doc_id, media digest, features) of some documents; a segment goes to the patch in which it begins."""
    import numpy as np
    import pyarrow as pa

    second = PATCH_FRAMES * HOP / (RATE * UP // DOWN)
    columns: list = [[] for _ in schema]
    for row, doc_id, digest, got in held:
        n = len(got["spans"])
        own: list = [[] for _ in range(n)]
        for a, b in got["segments"]:
            own[min(n - 1, int(a / second + 1e-9))].append({"start": a, "stop": b})
        for column, value in zip(columns, (row, doc_id, *digest)):
            column += [value] * n
        for column, values in zip(columns[-5:], (range(n), [got["patches"]], [x[0] for x in got["spans"]], [x[1] for x in got["spans"]], own)):
            column += values
    return pa.RecordBatch.from_arrays([pa.FixedShapeTensorArray.from_numpy_ndarray(np.concatenate(c)) if f.name == "log_mel" else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def extract(stored: DataFrame, path: str) -> DataFrame:
    """Features of stored media (doc_id, n_bytes, media) as Arrow files in ``path``; file, n_rows: a row per file.

    A document's rows follow one another; ``row`` numbers the documents of a file.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        fs, root = store_fs(path)
        fs.create_dir(root, recursive=True)
        name = f"features-{TaskContext.get().partitionId():06d}.arrow"
        own, out, n, docs, held, patches = f"{root}/.{name}-{uuid.uuid4().hex}", None, 0, 0, [], 0
        for b in bounded(batches, MEDIA_BYTES, "media"):
            if out is None:
                schema = tensor_schema(b.schema.field("doc_id").type)
                sink = fs.open_output_stream(own)
                out = pa.ipc.new_file(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            for doc_id, n_bytes, media in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                held.append((docs, doc_id, media_digest(n_bytes, media), features(media)))
                docs, patches = docs + 1, patches + len(held[-1][3]["spans"])
                if patches >= BATCH_PATCHES:
                    out.write_batch(patch_batch(held, schema))
                    n, held, patches = n + patches, [], 0
        if out is not None:
            if held:
                out.write_batch(patch_batch(held, schema))
            out.close()
            sink.close()
            fs.move(own, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "n_rows": [n + patches]}, schema=pa.schema([("file", pa.string()), ("n_rows", pa.int64())]))

    return materialize(stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "file string, n_rows long"), "audio-files")


def read_features(path: str, name: str) -> Iterator:
    """The record batches of one file of features."""
    import pyarrow as pa

    fs, root = store_fs(path)
    with fs.open_input_file(f"{root}/{name}") as f:
        reader = pa.ipc.open_file(f)
        for k in range(reader.num_record_batches):
            yield reader.get_batch(k)


def summary(tensor, rows: list[dict]) -> str:
    """Frames, segments, digests of tensors and spans, and the mean log energy of each mel band, from a document's stored rows."""
    frames = round(rows[-1]["stop"] * (RATE * UP // DOWN) / HOP)
    mean = tensor.reshape(-1, MELS)[:frames].mean(0, dtype="float64")
    segments = [(s["start"], s["stop"]) for r in rows for s in r["segments"]]
    spans = [x for r in rows for x in (r["start"], r["stop"])] + [x for s in segments for x in s]
    sha = lambda x: hashlib.sha256(x).hexdigest()[:32]
    return f"frames={frames};segments={len(segments)};tensors={sha(tensor.astype('<f4').tobytes())};spans={sha(struct.pack(f'<{len(spans)}d', *spans))};mel=" + ",".join(f"{v:.2f}" for v in mean)


def describe(docs: DataFrame) -> DataFrame:
    """Digests of each document's stored media and of its stored features, read from the files that hold them."""
    kind, path = docs.schema["doc_id"].dataType.simpleString(), scratch_dir(docs.sparkSession, "audio-features")
    files = extract(store_media(docs), path)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for name in b.column("file").to_pylist():
                for batch in read_features(path, name):
                    # A document's rows are in one batch.
                    tensors, rows = batch.column("log_mel").to_numpy_ndarray(), batch.drop_columns(["log_mel"]).to_pylist()
                    cuts = [k for k, r in enumerate(rows) if not k or r["row"] != rows[k - 1]["row"]]
                    firsts = [rows[k] for k in cuts]
                    feature = [summary(tensors[a:e], rows[a:e]) for a, e in zip(cuts, [*cuts[1:], len(rows)])]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in firsts], batch.schema.field(c).type) for c in ("doc_id", *MEDIA)] + [pa.array(feature, pa.string())], names=["doc_id", *MEDIA, "feature"])

    columns = ", ".join(f"{n} {'string' if n.endswith('sha256') else 'long'}" for n in MEDIA)
    count = max(1, files.count())  # a task for each file
    return files.repartition(count, "file").mapInArrow(run, f"doc_id {kind}, {columns}, feature string")


def op3_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(table(spark, sf_dir, "documents"))

"""Captured protocol frames: a 32-byte header, then the payload.

Header, little-endian: magic u32, version u16, opcode u16, request id u64, payload
length u32, flags u16, reserved u16, payload CRC-32C u32 (0 of an empty payload),
CRC-32C u32 of the header before it.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.functions.crc import crc32c_array
from strandlog.functions.wire import _column
from strandlog.model import OPCODES

#: Fixed values of the format.
MAGIC, VERSION, MAX_PAYLOAD = 0x47534C50, 1, 64 << 20
FIELDS = struct.Struct("<IHHQIHHI")
HEADER = FIELDS.size + 4


def checksums(data: list[bytes]) -> list[int]:
    """CRC-32C of each, 0 of empty ones."""
    import pyarrow as pa

    return [c if d else 0 for c, d in zip(crc32c_array(pa.array(data, pa.large_binary())).to_pylist(), data)]


def frames(fields: list[tuple], payloads: list[bytes]) -> list[bytes]:
    """Frames of (version, opcode, request_id, payload length or None for the true one, reserved) and payloads."""
    heads = [FIELDS.pack(MAGIC, version, opcode, request, len(p) if length is None else length, 0, reserved, c) for (version, opcode, request, length, reserved), p, c in zip(fields, payloads, checksums(payloads))]
    return [h + struct.pack("<I", c) + p for h, c, p in zip(heads, checksums(heads), payloads)]


def verdict(frame: bytes, head_sum: int, payload_sum: int) -> str:
    """OK, SHORT_HEADER or SHORT_PAYLOAD (more is needed), TRAILING_BYTES, or why a decoder refuses a frame; the header's checksum comes before its fields."""
    if len(frame) < HEADER:
        return "SHORT_HEADER"
    magic, version, opcode, _, length, _, reserved, stored = FIELDS.unpack_from(frame)
    checks = (
        (magic != MAGIC, "BAD_MAGIC"), (int.from_bytes(frame[28:32], "little") != head_sum, "BAD_HEADER"), (reserved != 0, "BAD_RESERVED"), (version != VERSION, "UNSUPPORTED_VERSION"), (opcode not in OPCODES, "UNKNOWN_OPCODE"),
        (length > MAX_PAYLOAD, "TOO_LARGE"), (len(frame) < HEADER + length, "SHORT_PAYLOAD"), (len(frame) > HEADER + length, "TRAILING_BYTES"), (stored != payload_sum, "BAD_PAYLOAD"),
    )
    return next((name for bad, name in checks if bad), "OK")


def encode(opcode: Column, request_id: Column, payload: Column) -> Column:
    """A frame around a payload."""

    def run(opcode, request_id, payload):
        import pyarrow as pa

        return pa.array(frames([(VERSION, o, r, None, 0) for o, r in zip(opcode.to_pylist(), request_id.to_pylist())], payload.to_pylist()), pa.binary())

    return _column(run, "binary", opcode.cast("int"), request_id.cast("long"), payload.cast("binary"))


def classify(captured: DataFrame, column: str = "frame") -> DataFrame:
    """The rows with the ``verdict`` on their frame."""

    def run(frame):
        import pyarrow as pa

        raw = [f or b"" for f in frame.to_pylist()]
        return pa.array([verdict(f, h, p) for f, h, p in zip(raw, checksums([f[:28] for f in raw]), checksums([f[HEADER:] for f in raw]))], pa.string())

    return captured.withColumn("verdict", _column(run, "string", F.col(column).cast("binary")))


def fields_of(kind: int, request: int) -> tuple:
    """The fields of a frame, bad ones for the numbers from 6 to 9."""
    bad = {6: (VERSION, 1, request, None, 1), 7: (2, 1, request, None, 0), 8: (VERSION, 19, request, None, 0), 9: (VERSION, 1, request, MAX_PAYLOAD + 1, 0), 11: (VERSION, 40, request, None, 0)}
    return bad.get(kind, (VERSION, 1, request, None, 0))


def damage(kind: int, frame: bytes) -> bytes:
    """A frame with damage of the kind that the numbers 1 to 5 and 10 stand for."""
    flip = lambda at: frame[:at] + bytes([frame[at] ^ 1]) + frame[at + 1 :]
    return {1: frame[:20], 2: flip(0), 3: flip(8), 4: frame[: HEADER + 4], 5: frame + b" ", 10: flip(len(frame) - 1)}.get(kind, frame)


def sample(events: DataFrame) -> DataFrame:
    """Frames of the events' properties; of every sixteen ten are bad, each in its own way."""

    def run(event_id, props):
        import pyarrow as pa

        ids = event_id.to_pylist()
        made = frames([fields_of(e % 16, e) for e in ids], [b"" if e % 16 == 12 else p.encode() for e, p in zip(ids, props.to_pylist())])
        return pa.array([damage(e % 16, f) for e, f in zip(ids, made)], pa.binary())

    return events.select("event_id", _column(run, "binary", F.col("event_id"), F.col("props")).alias("frame"))

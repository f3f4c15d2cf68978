"""Records as bytes: encoding, decoding and rewriting the stored form, in Arrow batches.

Record, little-endian: length u32 (of what follows it), CRC-32C u32 (of what
follows it), offset i64, timestamp i64, attributes u8, key field (base-128: 0 for
a null key, else its length + 1), value length (base-128), key, value.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlog.functions.crc import crc32c_array
from strandlog.model import MAX_RECORD, RECORD_PREFIX

REST = 1 << 30
HEAD = struct.Struct("<IIqqB")


def little(data: Column, at: Column | int, size: int) -> Column:
    """The little-endian number of ``size`` bytes from a place (from 1) of a binary column; of eight bytes, signed."""
    at = F.lit(at) if isinstance(at, int) else at
    digits = F.concat(*(F.hex(F.substring(data, at + k, F.lit(1))) for k in reversed(range(size))))
    return F.conv(digits, 16, -10 if size == 8 else 10).cast("long")


def varuint(x: int) -> bytes:
    """A base-128 number as bytes."""
    out = bytearray()
    while x >= 128:
        out.append(x & 127 | 128)
        x >>= 7
    return bytes([*out, x])


def read_varuint(data: bytes, at: int) -> tuple[int, int]:
    """A base-128 number and the place after it; (-1, at) if the bytes end before it or it is longer than ten."""
    x = 0
    for k in range(min(10, len(data) - at)):
        b = data[at + k]
        x |= (b & 127) << 7 * k
        if b < 128:
            return x, at + k + 1
    return -1, at


def sealed(bodies: list[bytes]) -> list[bytes]:
    """Records from their bodies: length and checksum go before each."""
    import pyarrow as pa

    sums = crc32c_array(pa.array(bodies, pa.large_binary())).to_pylist()
    return [struct.pack("<II", len(b) + 4, c) + b for b, c in zip(bodies, sums)]


def body(offset: int, timestamp_ms: int, attributes: int, key: bytes | None, value: bytes | None) -> bytes:
    """What a record's checksum covers; a null key is told apart from an empty one, a null value is empty."""
    key_field, value = 0 if key is None else len(key) + 1, value or b""
    return struct.pack("<qqB", offset, timestamp_ms, attributes) + varuint(key_field) + varuint(len(value)) + (key or b"") + value


def structure(data: bytes) -> tuple:
    """(verdict but for the checksum, offset, timestamp, attributes, key, value) of one record's bytes."""
    n, none = len(data), (None,) * 5
    if n < 4:
        return "SHORT", *none
    length = int.from_bytes(data[:4], "little")
    if length == 0:
        return "EMPTY", *none
    if n < RECORD_PREFIX:
        return "SHORT", *none
    if length < RECORD_PREFIX - 4 or length > MAX_RECORD:
        return "BAD_LENGTH", *none
    if n != length + 4:
        return "SHORT" if n < length + 4 else "BAD_LENGTH", *none
    _, _, offset, timestamp_ms, attributes = HEAD.unpack_from(data)
    key_field, at = read_varuint(data, RECORD_PREFIX)
    size, at = read_varuint(data, at)
    if min(key_field, size) < 0 or at + max(0, key_field - 1) + size != n:
        return "BAD_LENGTH", *none
    key = data[at : at + key_field - 1] if key_field else None
    return "OK", offset, timestamp_ms, attributes, key, data[n - size :]


def _column(run, returns: str, *columns: Column) -> Column:
    """A column of an Arrow function of whole columns."""
    import pyarrow as pa

    run.__annotations__ = dict.fromkeys([*run.__code__.co_varnames[: run.__code__.co_argcount], "return"], pa.Array)
    return F.arrow_udf(run, returns)(*columns)


def encode(offset: Column, timestamp_ms: Column, attributes: Column, key: Column, value: Column) -> Column:
    """A record as bytes."""

    def run(offset, timestamp_ms, attributes, key, value):
        import pyarrow as pa

        return pa.array(sealed([body(*row) for row in zip(*(c.to_pylist() for c in (offset, timestamp_ms, attributes, key, value)))]), pa.binary())

    return _column(run, "binary", offset.cast("long"), timestamp_ms.cast("long"), attributes.cast("int"), key.cast("binary"), value.cast("binary"))


def rewrite_header(data: Column, offset: Column, timestamp_ms: Column) -> Column:
    """The record under another offset and timestamp, with its checksum anew; shorter bytes stay as they are."""

    def run(data, offset, timestamp_ms):
        import pyarrow as pa

        rows = list(zip(*(c.to_pylist() for c in (data, offset, timestamp_ms))))
        new = sealed([struct.pack("<qq", o, t) + d[24:] for d, o, t in rows])
        return pa.array([d if len(d) < RECORD_PREFIX else x for (d, _, _), x in zip(rows, new)], pa.binary())

    return _column(run, "binary", data, offset.cast("long"), timestamp_ms.cast("long"))


def turned(data: Column) -> Column:
    """The bytes with one bit of the last one turned, as damage."""

    def run(data):
        import pyarrow as pa

        return pa.array([None if d is None else d[:-1] + bytes([d[-1] ^ 1]) if d else d for d in data.to_pylist()], pa.binary())

    return _column(run, "binary", data)


def peek_length(data: Column) -> Column:
    """The length field; null of fewer than four bytes."""
    return F.when(F.octet_length(data) >= 4, little(data, 1, 4))


def peek_timestamp(data: Column) -> Column:
    return little(data, 17, 8)


def decode(data: Column) -> Column:
    """struct(verdict, offset, timestamp_ms, attributes, key, value) of a record's bytes.

    OK, or why bytes are no record: SHORT, EMPTY (space that was reserved, not
    written), BAD_LENGTH or CORRUPT; the checksum comes before the inner lengths.
    """

    def run(data):
        import pyarrow as pa

        raw = [d or b"" for d in data.to_pylist()]
        sums = crc32c_array(pa.array([d[8:] for d in raw], pa.large_binary())).to_pylist()
        rows = []
        for d, c in zip(raw, sums):
            got = structure(d)
            whole = got[0] == "OK" or got[0] == "BAD_LENGTH" and int.from_bytes(d[:4], "little") + 4 == len(d) >= RECORD_PREFIX
            rows.append(("CORRUPT", *(None,) * 5) if whole and int.from_bytes(d[4:8], "little") != c else got)
        types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        names = ("verdict", "offset", "timestamp_ms", "attributes", "key", "value")
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return _column(run, "struct<verdict: string, offset: bigint, timestamp_ms: bigint, attributes: int, key: binary, value: binary>", data.cast("binary"))


def parsed(df, column: str = "data"):
    """The rows with ``record`` (offset, timestamp_ms, attributes, key, value) and ``verdict`` of their bytes."""
    return df.withColumn("record", decode(F.col(column))).withColumn("verdict", F.col("record.verdict"))

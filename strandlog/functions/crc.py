"""CRC-32C of many byte strings at once, in numpy, and as an Arrow column function.

``scalars.crc32c`` folds over the bytes of short values (keys, topics) inside the
JVM; payloads come here: strings are cut into chunks that end with them, all
chunks are folded together, byte place by byte place, and the chunks of a string
are joined by a table that shifts a checksum over a whole chunk.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlog.functions.scalars import CRC_TABLE

CHUNK, SLAB = 256, 1 << 14


@functools.lru_cache(maxsize=1)
def tables():
    """The byte table, and four tables that shift a checksum over a chunk of zeros."""
    import numpy as np

    table = np.array(CRC_TABLE, dtype=np.uint32)
    state = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(CHUNK):
        state = table[state & 255] ^ state >> np.uint32(8)
    return table, state.reshape(4, 256)


def shifted(c):
    """Checksums after a chunk of zeros."""
    _, shift = tables()
    return shift[0][c & 255] ^ shift[1][c >> 8 & 255] ^ shift[2][c >> 16 & 255] ^ shift[3][c >> 24]


def after_zeros(sizes):
    """The initial state after so many zero bytes."""
    import numpy as np

    table, _ = tables()
    out = np.full(len(sizes), 0xFFFFFFFF, dtype=np.uint32)
    chunks, rest = np.divmod(sizes, CHUNK)
    for k in range(int(rest.max(initial=0))):
        more = rest > k
        out[more] = table[out[more] & 255] ^ out[more] >> np.uint32(8)
    for k in range(int(chunks.max(initial=0))):
        more = chunks > k
        out[more] = shifted(out[more])
    return out


def crc32c_many(data, starts, stops):
    """Checksums of data[start:stop] (numpy: bytes, and their bounds)."""
    import numpy as np

    table, _ = tables()
    sizes = stops - starts
    count = -(-sizes // CHUNK)
    owner = np.repeat(np.arange(len(sizes)), count)
    place = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count) if len(owner) else owner
    begin = stops[owner] - (count[owner] - place) * CHUNK  # the first chunk may begin before its string
    raw = np.zeros(len(owner), dtype=np.uint32)
    for at in range(0, len(owner), SLAB):
        part = slice(at, at + SLAB)
        state, low, first = raw[part], starts[owner[part]], begin[part]
        for k in range(CHUNK):
            here = first + k
            inside = here >= low  # zeros before a string leave a state of zero as it is
            if not inside.any():
                continue
            byte = np.where(inside, data[np.maximum(here, 0)], 0)
            state = table[(state ^ byte) & 255] ^ state >> np.uint32(8)
        raw[part] = state
    out = np.zeros(len(sizes), dtype=np.uint32)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    for k in range(int(count.max(initial=0))):
        more = np.flatnonzero(count > k)
        out[more] = shifted(out[more]) ^ raw[first[more] + k]
    return out ^ after_zeros(sizes) ^ np.uint32(0xFFFFFFFF)


def crc32c_array(column):
    """Checksums of a binary Arrow array, null of null."""
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    if not len(column):
        return pa.array([], pa.int64())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(1, dtype=np.uint8)
    return pa.array(crc32c_many(raw, bounds[:-1], bounds[1:]).astype(np.int64), mask=np.array(column.is_null()))


def crc32c(data: bytes) -> int:
    import numpy as np

    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(1, dtype=np.uint8)
    return int(crc32c_many(raw, np.array([0]), np.array([len(data)]))[0])


def crc32c_payload(data: Column) -> Column:
    """CRC-32C of a binary column (null: null), in Arrow batches."""
    import pyarrow as pa

    def checksum(column):
        return crc32c_array(column)

    checksum.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(checksum, "long")(data.cast("binary"))

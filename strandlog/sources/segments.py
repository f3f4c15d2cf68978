"""Binary log segments as a Spark data source: ``format("strand_segments")``.

A segment file is a run of records (see ``functions.wire``), which may be followed
by zeros: space that was reserved, not written. Files are read in parts of
``PART_BYTES``, from the place that ``start`` asks for where a sparse index file
(``.index``: offset, position pairs of u64) lies beside the segment. Reading
stops at the first short, damaged or discontinuous record. ``write_segment``
makes such files, ``walk`` tells where one ends and why.
"""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandlog.functions import wire
from strandlog.functions.crc import crc32c_array
from strandlog.model import MAX_RECORD, RECORD_PREFIX

SCHEMA = "segment_base long, offset long, timestamp_ms long, attributes int, key binary, value binary, size long"
PART_BYTES, INDEX_EVERY = 8 << 20, 4096


def records(file, size: int, position: int, expected: int | None, part_bytes: int = PART_BYTES) -> Iterator[tuple]:
    """(position, offset, timestamp, attributes, key, value, size) of valid records, then (position, why it ends): END, EMPTY, SHORT, BAD_LENGTH, CORRUPT or GAP."""
    import pyarrow as pa

    while position < size:
        file.seek(position)
        part = file.read(min(part_bytes, size - position))
        cuts, at = [], 0
        while at + 4 <= len(part):
            length = int.from_bytes(part[at : at + 4], "little")
            if not RECORD_PREFIX - 4 <= length <= MAX_RECORD or at + 4 + length > len(part):
                break
            cuts.append((at, at + 4 + length))
            at += 4 + length
        sums = crc32c_array(pa.array([part[a + 8 : b] for a, b in cuts], pa.large_binary())).to_pylist()
        for (a, b), c in zip(cuts, sums):
            data = part[a:b]
            verdict, offset, *fields = wire.structure(data)
            if int.from_bytes(data[4:8], "little") != c:
                verdict = "CORRUPT"
            elif verdict == "OK" and expected is not None and offset != expected:
                verdict = "GAP"
            if verdict != "OK":
                yield position + a, verdict
                return
            yield position + a, offset, *fields, b - a
            expected = offset + 1
        position += at
        rest = part[at : at + 4]
        length = int.from_bytes(rest, "little")
        if len(rest) == 4 and not RECORD_PREFIX - 4 <= length <= MAX_RECORD:
            yield position, "EMPTY" if length == 0 else "BAD_LENGTH"
            return
        if position + len(part) - at >= size and position < size:
            yield position, "SHORT"
            return
        if not at:
            part_bytes = MAX_RECORD + 4
    yield position, "END"


def walk(file, size: int, base: int) -> dict:
    """records, next_offset, valid_bytes, reserved_bytes, cut_bytes and reason of a segment."""
    n = 0
    for r in records(file, size, 0, base):
        if len(r) == 2:
            rest = size - r[0]
            return {"records": n, "next_offset": base + n, "valid_bytes": r[0], "reserved_bytes": rest if r[1] == "EMPTY" else 0, "cut_bytes": 0 if r[1] == "EMPTY" else rest, "reason": r[1]}
        n += 1
    raise AssertionError("a walk always ends")


def write_segment(folder: str, base: int, rows: list[tuple], reserve: int = 0) -> str:
    """A segment of (timestamp_ms, attributes, key, value) records from offset ``base``, its sparse index, and reserved space after it."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    path, index, at, last = f"{root}/{base:020d}.log", [], 0, None
    with store.open_output_stream(path) as out:
        for k, data in enumerate(wire.sealed([wire.body(base + k, *r) for k, r in enumerate(rows)])):
            if last is None or at - last >= INDEX_EVERY:
                index.append(struct.pack("<QQ", base + k, at))
                last = at
            out.write(data)
            at += len(data)
        out.write(bytes(reserve))
    with store.open_output_stream(f"{root}/{base:020d}.index") as out:
        out.write(b"".join(index))
    return path


def floor_position(store, path: str, start: int, base: int) -> tuple[int, int]:
    """(position, offset) of the last index entry at or before ``start``; the segment's begin without an index."""
    name = path.removesuffix(".log") + ".index"
    if store.get_file_info(name).size is None:
        return 0, base
    with store.open_input_file(name) as f:
        data = f.read()
    entries = [e for e in struct.iter_unpack("<QQ", data[: len(data) // 16 * 16])]
    k = bisect.bisect_right([e[0] for e in entries], start) - 1
    return (entries[k][1], entries[k][0]) if k >= 0 else (0, base)


class SegmentFile(InputPartition):
    def __init__(self, folder: str, path: str):
        self.folder, self.path = folder, path


class SegmentReader(DataSourceReader):
    def __init__(self, folder: str, start: int, max_bytes: int):
        self.folder, self.start, self.max_bytes = folder, start, max_bytes

    def partitions(self) -> list[SegmentFile]:
        """One task per segment; segments wholly below the start offset are skipped by the next one's base."""
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.folder)
        paths = sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".log"))
        bases = [int(p.rpartition("/")[2][:20]) for p in paths]
        return [SegmentFile(self.folder, p) for p, after in zip(paths, [*bases[1:], None]) if after is None or after > self.start]

    def read(self, partition: SegmentFile) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(partition.folder)
        base = int(partition.path.rpartition("/")[2][:20])
        position, offset = floor_position(store, partition.path, self.start, base)
        with store.open_input_file(partition.path) as f:
            taken = 0
            for r in records(f, f.size(), position, offset):
                if len(r) == 2 or self.max_bytes and taken and taken + r[6] > self.max_bytes:
                    return
                if r[1] >= self.start:
                    taken += r[6]
                    yield base, *r[1:]


class SegmentSource(DataSource):
    """Options: ``path`` (a folder's URI), ``start`` (the first offset wanted), ``maxBytes`` (of each segment; whole records, one at least)."""

    @classmethod
    def name(cls) -> str:
        return "strand_segments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SegmentReader:
        return SegmentReader(self.options["path"], int(self.options.get("start", 0)), int(self.options.get("maxBytes", 0)))

"""Names, sentinels and limits of the log model."""

from __future__ import annotations

#: Offsets that stand for a place rather than a number.
LATEST, EARLIEST = -1, -2
#: Isolation: all records, or only those that are replicated.
READ_UNCOMMITTED, READ_COMMITTED = 0, 1
#: Attribute bits of a record.
TOMBSTONE_BIT, COMPRESSION_MASK = 4, 3
#: Bytes of a record before its key, and a record's and a segment's largest size.
RECORD_PREFIX, MAX_RECORD, MAX_SEGMENT = 25, 16 << 20, (1 << 32) - 1
#: Keys of a log partition.
LOG = ("topic", "partition")

#: Error names by code, in order from 0, and those after which a client may try again.
ERRORS = (
    "OK", "UNKNOWN", "INVALID_ARGUMENT", "NOT_FOUND", "ALREADY_EXISTS", "OUT_OF_RANGE", "CORRUPTION", "IO_ERROR", "UNAVAILABLE", "TIMEOUT", "BACKPRESSURE", "NOT_LEADER",
    "NOT_ENOUGH_REPLICAS", "PROTOCOL_ERROR", "UNSUPPORTED_VERSION", "PERMISSION_DENIED", "RESOURCE_EXHAUSTED", "REBALANCE_IN_PROGRESS", "UNKNOWN_MEMBER", "ILLEGAL_GENERATION", "CLOSED", "WOULD_BLOCK", "INTERNAL",
)
RETRYABLE = ("UNAVAILABLE", "TIMEOUT", "BACKPRESSURE", "NOT_LEADER", "NOT_ENOUGH_REPLICAS", "REBALANCE_IN_PROGRESS", "WOULD_BLOCK")
#: Operations, and the range of those between brokers.
OPCODES = (1, 2, 3, 20, 21, 22, 23, 24, 25, 26, 27, 28, 40, 41, 42, 60, 61)
INTER_BROKER = (40, 59)
#: Names of modes, codecs and strategies.
CODEC_ALIASES = {"none": "none", "0": "none", "lz4like": "lz4like", "lz4": "lz4like", "1": "lz4like"}
STRATEGY_ALIASES = {"range": "range", "roundrobin": "roundrobin", "round-robin": "roundrobin"}
ACK_ALIASES = {"0": "none", "none": "none", "1": "leader", "leader": "leader", "all": "quorum", "-1": "quorum", "quorum": "quorum"}

"""Column builders: checksums, routing, sizes, names and parsers. All run JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlog.model import ACK_ALIASES, CODEC_ALIASES, ERRORS, INTER_BROKER, OPCODES, RECORD_PREFIX, RETRYABLE, STRATEGY_ALIASES


def crc32c_table() -> list[int]:
    """The reflected table of the Castagnoli polynomial, from its rule."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


CRC_TABLE = crc32c_table()


def crc32c(data: Column, seed: Column | int = 0) -> Column:
    """CRC-32C of a binary or string column (null: null). ``crc32c(b, crc32c(a))`` is that of ``ab``."""
    raw, table = data.cast("binary"), F.array(*(F.lit(x).cast("long") for x in CRC_TABLE))
    full = F.lit(0xFFFFFFFF).cast("long")
    start = (F.lit(seed) if isinstance(seed, int) else seed).cast("long").bitwiseXOR(full)
    byte = lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("long")
    step = lambda c, i: F.shiftright(c, 8).bitwiseXOR(F.get(table, c.bitwiseXOR(byte(i)).bitwiseAND(F.lit(255)).cast("int")))
    n = F.octet_length(raw)
    folded = F.aggregate(F.sequence(F.lit(1), n), start, step).bitwiseXOR(full)
    return F.when(n == 0, start.bitwiseXOR(full)).when(n > 0, folded)


def partition_for_key(key: Column, partitions: int) -> Column:
    """The partition of a key: its checksum without the sign bit, modulo the partitions."""
    if partitions <= 1:
        return F.when(key.isNotNull(), F.lit(0))
    return (crc32c(key).bitwiseAND(F.lit(0x7FFFFFFF)) % partitions).cast("int")


def coordinator_slot(group: Column, brokers: int) -> Column:
    """The slot, among id-sorted brokers, that coordinates a group (no sign mask)."""
    return (crc32c(group) % brokers).cast("int")


def varuint_size(x: Column) -> Column:
    """Bytes of a base-128 number."""
    return F.lit(1) + sum(((x >= 128**k).cast("int") for k in (1, 2, 3, 4)), F.lit(0))


def record_size(key: Column, value: Column) -> Column:
    """Encoded bytes of a record; a null key is told apart from an empty one by its length field."""
    k, v = F.octet_length(key), F.coalesce(F.octet_length(value), F.lit(0))
    return (F.lit(RECORD_PREFIX) + varuint_size(F.coalesce(k + 1, F.lit(0))) + varuint_size(v) + F.coalesce(k, F.lit(0)) + v).cast("long")


def zigzag(x: Column) -> Column:
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(x: Column) -> Column:
    return F.shiftrightunsigned(x, 1).bitwiseXOR(-x.bitwiseAND(F.lit(1)))


def segment_name(base: Column) -> Column:
    return F.lpad(base.cast("string"), 20, "0")


def parse_segment_name(name: Column) -> Column:
    """The base offset of a 20-digit name; null for any other."""
    return F.when(name.rlike("^[0-9]{20}$"), name.cast("long"))


def valid_topic(name: Column) -> Column:
    return name.rlike("^[A-Za-z0-9._-]{1,200}$") & ~name.isin(".", "..")


def _alias(text: Column, aliases: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv)), text)


def parse_ack_mode(text: Column) -> Column:
    """none, leader or quorum by one of its names, as written; null for any other."""
    return _alias(text, ACK_ALIASES)


def parse_compression(text: Column) -> Column:
    return _alias(text, CODEC_ALIASES)


def parse_strategy(text: Column) -> Column:
    return _alias(text, STRATEGY_ALIASES)


def error_name(code: Column) -> Column:
    """The name of an error code; UNKNOWN_CODE for any other."""
    return F.coalesce(F.get(F.array(*map(F.lit, ERRORS)), code.cast("int")), F.lit("UNKNOWN_CODE"))


def error_code(name: Column) -> Column:
    """The code of an error name; null for any other."""
    at = F.array_position(F.array(*map(F.lit, ERRORS)), name)
    return F.when(at > 0, at - 1)


def retryable(name: Column) -> Column:
    return F.coalesce(name.isin(*RETRYABLE), F.lit(False))


def known_opcode(code: Column) -> Column:
    return code.isin(*OPCODES)


def inter_broker(code: Column) -> Column:
    return code.between(*INTER_BROKER)


def _scaled(text: Column, pattern: str, units: dict[str, Column | int]) -> Column:
    number = F.regexp_extract(text, pattern, 1).cast("long")
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    out = F.lit(None).cast("long")
    for name, factor in units.items():
        out = F.when(unit == name, factor(number) if callable(factor) else number * factor).otherwise(out)
    return F.when(text.rlike(pattern), out)


def parse_bytes(text: Column) -> Column:
    """A size with an optional binary suffix; null if it is none."""
    units = {"": 1, "b": 1} | {f"{p}{s}": 1024**k for k, p in enumerate("kmgt", 1) for s in ("", "b", "ib")}
    return _scaled(text, r"^\s*([0-9]+)\s*([A-Za-z]*)\s*$", units)


def parse_duration(text: Column) -> Column:
    """Milliseconds of a duration; no suffix means milliseconds, microseconds round down."""
    units = {"": 1, "us": lambda n: F.floor(n / 1000).cast("long"), "ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000}
    return _scaled(text, r"^\s*([0-9]+)\s*([A-Za-z]*)\s*$", units)


def parse_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def parse_bool(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "yes", "on", "1"), True).when(low.isin("false", "no", "off", "0"), False)


def parse_broker(spec: Column) -> Column:
    """struct(id, host, port) of ``id@host:port`` (split at the last colon); null if malformed."""
    pattern = r"^([0-9]+)@(.+):([0-9]{1,5})$"
    port = F.regexp_extract(spec, pattern, 3).try_cast("int")
    fields = F.struct(F.regexp_extract(spec, pattern, 1).try_cast("int").alias("id"), F.regexp_extract(spec, pattern, 2).alias("host"), port.alias("port"))
    return F.when(spec.rlike(pattern) & port.between(1, 65535), fields)


def parse_endpoint(spec: Column) -> Column:
    """struct(host, port) of ``host:port`` or ``[v6]:port``."""
    pattern = r"^(?:\[([^\]]+)\]|([^:\[\]]+)):([0-9]{1,5})$"
    port = F.regexp_extract(spec, pattern, 3).try_cast("int")
    host = F.concat(F.regexp_extract(spec, pattern, 1), F.regexp_extract(spec, pattern, 2))
    return F.when(spec.rlike(pattern) & port.between(0, 65535), F.struct(host.alias("host"), port.alias("port")))


def env_key(name: Column, prefix: str = "") -> Column:
    """A setting's key from a variable's name: ``_`` is a dot, ``__`` an underscore."""
    low = F.lower(F.substring(name, len(prefix) + 1, 1 << 20))
    return F.replace(F.replace(F.replace(low, F.lit("__"), F.lit("\u0001")), F.lit("_"), F.lit(".")), F.lit("\u0001"), F.lit("_"))


def escape_label(text: Column) -> Column:
    """A label value in the text format of metrics."""
    out = text
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_json(text: Column) -> Column:
    """A string as it stands in JSON, without its quotes."""
    quoted = F.to_json(F.array(text))
    return F.substring(quoted, F.lit(3), F.length(quoted) - 4)


def tenths(x: Column) -> Column:
    """A double rounded to one digit as C's ``%.1f`` does: its exact value decides, and halves go to the even digit."""
    ten = x * 10
    # What the product lost: eight and two times x are exact.
    lost = x * 2 - (ten - x * 8)
    half = F.abs(ten - F.rint(ten)) == 0.5
    return F.rint(F.when(half, ten + F.signum(lost) * 0.5).otherwise(ten)) / 10


def human_number(n: Column) -> Column:
    """A count with thousands, millions or billions as k, M, G."""
    out = F.format_string("%d", n.cast("long"))
    for k, unit in enumerate(("k", "M", "G"), 1):
        out = F.when(n >= 1000**k, F.format_string(f"%.1f{unit}", tenths(n / float(1000**k)))).otherwise(out)
    return out


def series_key(name: Column, labels: Column) -> Column:
    """A metric's name and its labels in order, apart by a unit separator."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat_ws("\u001f", F.concat(F.array(name), pairs))


def human_bytes(n: Column, units: tuple[str, ...] = ("KiB", "MiB", "GiB", "TiB")) -> Column:
    """A size in the largest of the units that it reaches, or in bytes."""
    out = F.format_string("%d B", n.cast("long"))
    for k, unit in enumerate(units, 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.1f {unit}", tenths(n / float(1024**k)))).otherwise(out)
    return out


def backoff(initial: int, cap: int, tries: int) -> Column:
    """Waits that double up to a cap."""
    return F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda i: F.least(F.lit(cap).cast("double"), initial * F.pow(F.lit(2.0), i)).cast("long"))


def bit_length(v: Column) -> Column:
    return F.when(v <= 0, 0).otherwise(F.length(F.bin(v)))


def hdr_slot_top(value: Column, digits: int = 3, highest: int = 3_600_000_000_000) -> Column:
    """The largest value of a value's slot in a log-linear histogram; values are clamped to [0, highest]."""
    bits = next(k for k in range(64) if 2**k >= 2 * 10**digits)
    v = F.greatest(F.lit(0).cast("long"), F.least(value, F.lit(highest)))
    shift = F.greatest(F.lit(0), bit_length(v) - bits)
    step = F.expr("1L")
    # Shifts by a column: through powers of two, which are exact.
    width = F.pow(F.lit(2.0), shift).cast("long") * step
    return F.floor(v / width).cast("long") * width + width - 1

"""Raw data headers: fields by a layout table, and chains of headers within a block."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER_SIZE, LEAST_STEP, MOST_STEP = 64, 64, 8192
#: field: (byte offset, bytes, shift, mask). The library's own layout, little endian.
LAYOUT = {
    "version": (0, 1, 0, 0xFF),
    "header_size": (1, 1, 0, 0xFF),
    "fee_id": (2, 2, 0, 0xFFFF),
    "system_id": (4, 1, 0, 0xFF),
    "offset_to_next": (8, 2, 0, 0xFFFF),
    "memory_size": (10, 2, 0, 0xFFFF),
    "link_id": (12, 4, 0, 0xFF),
    "cru_id": (12, 4, 16, 0xFFF),
    "endpoint_id": (12, 4, 28, 0xF),
    "bc": (16, 2, 0, 0xFFF),
    "orbit": (20, 4, 0, 0xFFFFFFFF),
    "trigger_type": (32, 4, 0, 0xFFFFFFFF),
    "page_counter": (36, 2, 0, 0xFFFF),
    "stop_bit": (38, 1, 0, 0xFF),
}
#: Versions 3 and 4 have two orbits and crossings, of the trigger and of the heartbeat; the latter count, and stand elsewhere.
LAYOUT_OLD = LAYOUT | {"orbit": (24, 4, 0, 0xFFFFFFFF), "bc": (28, 2, 0, 0xFFF), "trigger_orbit": (20, 4, 0, 0xFFFFFFFF), "trigger_bc": (16, 2, 0, 0xFFF)}
OLD, NEW = (3, 4), (5, 6, 7)


def layout(version: int) -> dict[str, tuple[int, int, int, int]]:
    return LAYOUT_OLD if version in OLD else LAYOUT


def any_field(block: Column, name: str, at: int = 0) -> Column:
    """A header field by the layout of the header's own version; null for versions that aren't known."""
    version = field(block, "version", at)
    return F.when(version.isin(*OLD), field(block, name, at, OLD[0])).when(version.isin(*NEW), field(block, name, at))


def field(block: Column, name: str, at: int = 0, version: int = 7) -> Column:
    """A header field of a binary column, without leaving the JVM."""
    offset, width, shift, mask = layout(version)[name]
    text = F.hex(F.substring(block, at + offset + 1, width))
    value = F.conv(F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(width))]), 16, 10).cast("bigint")
    return F.shiftright(value, shift).bitwiseAND(F.lit(mask))


def header(fields: dict[str, Column], version: int = 7) -> Column:
    """A binary header of HEADER_SIZE bytes from columns: the inverse of field()."""
    at: dict[int, tuple[int, list[Column]]] = {}
    for name, value in fields.items():
        offset, width, shift, mask = layout(version)[name]
        at.setdefault(offset, (width, []))[1].append(F.shiftleft(value.cast("bigint").bitwiseAND(F.lit(mask)), shift))
    parts, done = [], 0
    for offset in sorted(at):
        width, values = at[offset]
        total = values[0]
        for v in values[1:]:
            total = total.bitwiseOR(v)
        big = F.lpad(F.hex(total), 2 * width, "0")
        parts += [F.lit("00" * (offset - done)), *[F.substring(big, 2 * i + 1, 2) for i in reversed(range(width))]]
        done = offset + width
    return F.unhex(F.concat(*parts, F.lit("00" * (HEADER_SIZE - done))))


def origin(version: Column, system: Column, known: dict[int, str], given: str) -> Column:
    """Detector code by system id, for headers of version 6 only; else, or if unknown, the given one."""
    looked_up = F.element_at(F.create_map(*[F.lit(x) for k, v in known.items() for x in (k, v)]), system.cast("int")) if known else F.lit(None)
    return F.coalesce(F.when(version == 6, looked_up), F.lit(given))


CHAIN = "array<struct<memory_size:bigint,offset_to_next:bigint,stop_bit:boolean,orbit:bigint,page_counter:bigint,at:bigint>>"
_CHAIN = pa.list_(pa.struct([("memory_size", pa.int64()), ("offset_to_next", pa.int64()), ("stop_bit", pa.bool_()), ("orbit", pa.int64()), ("page_counter", pa.int64()), ("at", pa.int64())]))


def walk(block: bytes | None) -> list[dict]:
    """Headers chained in a block, until a stop bit, a step that is not legal, or a short tail."""
    out, at = [], 0
    while block is not None and len(block) - at >= HEADER_SIZE:
        step, memory = struct.unpack_from("<HH", block, at + 8)
        orbit_at = layout(block[at])["orbit"][0]
        (orbit,), (page,), stop = struct.unpack_from("<I", block, at + orbit_at), struct.unpack_from("<H", block, at + 36), block[at + 38] != 0
        out.append({"memory_size": memory, "offset_to_next": step, "stop_bit": stop, "orbit": orbit, "page_counter": page, "at": at})
        if stop or not LEAST_STEP <= step <= MOST_STEP:
            break
        at += step
    return out


def with_chain(df: DataFrame, block: str = "block", name: str = "chain") -> DataFrame:
    """df with its blocks' header chains: a pointer walk, which no expression can do."""
    at = df.columns.index(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([walk(x.as_py()) for x in b.column(at)], _CHAIN)], [*b.schema.names, name])

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{name}` {CHAIN}"]))


def memory_of(chain: Column, length: Column) -> Column:
    """(size, stop): memory over all headers of a block and the last one's stop bit, false if they run over the block."""
    size = F.aggregate(chain, F.lit(0).cast("bigint"), lambda a, h: a + h["memory_size"])
    stop = F.coalesce(F.element_at(F.transform(chain, lambda h: h["stop_bit"]), -1), F.lit(False))
    return F.struct(size.alias("size"), (stop & (size <= length)).alias("stop"))

"""The binary record format: writing, from Arrow batches."""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from lamina.sources.wire import BINARY, BOOL, COLUMNAR, DELTA_TAIL, DENSE, EMBEDDED, FILE, FLOAT, FOOTER, INT, LIST, NARROW, OBJECT, PACKED_BOOLS, PAGE, PAGED, STR, TIME, FormatError, bitmap_size, schema_hash

VERSION, COMPACT_VERSION = 0x0101, 0x0103


def type_mark(kind: pa.DataType) -> int:
    """The mark of an Arrow type; lists and records count as strings."""
    if pa.types.is_boolean(kind):
        return BOOL
    if pa.types.is_integer(kind):
        return INT
    if pa.types.is_floating(kind) or pa.types.is_decimal(kind):
        return FLOAT
    if pa.types.is_timestamp(kind) or pa.types.is_date(kind):
        return TIME
    if pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
        return BINARY
    if pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_list(kind) or pa.types.is_struct(kind) or pa.types.is_null(kind):
        return STR
    raise FormatError("ERR_UNSUPPORTED", str(kind))


def schema_marks(schema: pa.Schema) -> dict[str, int]:
    """Keys and marks of a file: the columns, then the keys of records within them."""
    out = {f.name: type_mark(f.type) for f in schema}

    def add(kind: pa.DataType) -> None:
        for f in kind:
            if out.setdefault(f.name, type_mark(f.type)) != type_mark(f.type):
                raise FormatError("ERR_UNSUPPORTED", f"{f.name} has two types")
            if pa.types.is_struct(f.type):
                add(f.type)

    for f in schema:
        if pa.types.is_struct(f.type):
            add(f.type)
    return out


def schema_bytes(marks: dict[str, int]) -> bytes:
    out = struct.pack("<H", len(marks)) + bytes(marks.values()) + b"".join(k.encode() + b"\0" for k in marks)
    return out + bytes(-len(out) % 8)


def head(marks: dict[str, int], flags: int, tail: int) -> bytes:
    schema = schema_bytes(marks)
    return struct.pack("<IHHQQ8x", FILE, VERSION, flags | EMBEDDED, schema_hash(schema), tail) + schema


def _padded(cell: bytes) -> bytes:
    return cell + bytes(-len(cell) % 8)


def _cell(value: object, kind: pa.DataType, slots: dict[str, int]) -> bytes:
    if pa.types.is_struct(kind):
        return record({f.name: (value[f.name], f.type) for f in kind}, slots)
    if pa.types.is_list(kind):
        whole = pa.types.is_integer(kind.value_type)
        if not whole and not pa.types.is_floating(kind.value_type):
            raise FormatError("ERR_UNSUPPORTED", f"list of {kind.value_type}")
        values = np.array(value, dtype="<i8" if whole else "<f8")
        return struct.pack("<IIBI3x", LIST, 16 + 8 * len(values), INT if whole else FLOAT, len(values)) + values.tobytes()
    if isinstance(value, str):
        value = value.encode()
    if isinstance(value, bytes):
        return _padded(struct.pack("<I", len(value)) + value)
    mark = type_mark(kind)
    return struct.pack("<?7x", value) if mark == BOOL else struct.pack("<d", value) if mark == FLOAT else struct.pack("<q", value)


def record(fields: dict[str, tuple[object, pa.DataType]], slots: dict[str, int]) -> bytes:
    """One record: absent fields (None) leave no trace but in the mask."""
    n = len(slots)
    mask = bytearray([128] * (-(-n // 7) - 1) + [0])
    there = sorted((slots[k], v, t) for k, (v, t) in fields.items() if v is not None)
    start = 8 + len(mask) + 2 * n
    body, table = bytes(-start % 8), []
    start += len(body)
    cells = []
    for slot, value, kind in there:
        mask[slot // 7] |= 1 << slot % 7
        if start > 0xFFFF:
            raise FormatError("ERR_UNSUPPORTED", "record beyond 64 KB before its last field")
        table.append(start)
        cells.append(_cell(value, kind, slots))
        start += len(cells[-1])
    offsets = np.array(table + [0] * (n - len(table)), dtype="<u2").tobytes()
    return struct.pack("<II", OBJECT, start) + bytes(mask) + offsets + body + b"".join(cells)


def _plain(column: pa.Array) -> pa.Array:
    """Times and dates (their midnight) as nanoseconds, decimals as doubles."""
    if pa.types.is_date(column.type):
        column = column.cast(pa.timestamp("s"))
    if pa.types.is_timestamp(column.type):
        return column.cast(pa.timestamp("ns", column.type.tz)).cast(pa.int64())
    return column.cast(pa.float64()) if pa.types.is_decimal(column.type) else column


class RowWriter:
    """Row layout as a stream of bytes: the head, records as they come, and the tail."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self.marks = schema_marks(schema)
        self.slots = {k: i for i, k in enumerate(self.marks)}
        self.offsets: list[int] = []
        self.size = 0

    def head(self) -> bytes:
        out = head(self.marks, 0, 0)
        self.size = len(out)
        return out

    def sector(self, batch: pa.RecordBatch) -> bytes:
        """The records' bytes, without head or tail: what an append log takes."""
        if not batch.schema.equals(self.schema):
            raise FormatError("ERR_TYPE", "batch of another schema")
        columns = [(f.name, f.type, _plain(c).to_pylist()) for f, c in zip(batch.schema, batch.columns, strict=True)]
        out = []
        for i in range(len(batch)):
            self.offsets.append(self.size)
            out.append(record({k: (v[i], t) for k, t, v in columns}, self.slots))
            self.size += len(out[-1])
        return b"".join(out)

    def tail(self) -> bytes:
        entries = np.zeros(len(self.offsets), np.dtype([("key", "<u2"), ("at", "<u8")]))
        entries["key"], entries["at"] = np.arange(len(self.offsets)) & 0xFFFF, self.offsets
        return struct.pack("<I", len(self.offsets)) + entries.tobytes() + struct.pack("<QI", self.size, FOOTER)


def encode_rows(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> bytes:
    w = RowWriter(schema)
    return b"".join([w.head(), *(w.sector(b) for b in batches), w.tail()])


def column_bytes(column: pa.Array) -> bytes:
    """A column: presence bitmap and cells, or bitmap, offsets and bytes."""
    column = _plain(column)
    n = len(column)
    bits = np.packbits(column.is_valid().to_numpy(zero_copy_only=False), bitorder="little").tobytes()
    bitmap = bits + bytes(bitmap_size(n) - len(bits))
    kind = column.type
    if pa.types.is_list(kind) or pa.types.is_struct(kind):
        raise FormatError("ERR_UNSUPPORTED", f"{kind} in columns")
    if type_mark(kind) in (STR, BINARY):
        if pa.types.is_null(kind):
            return bitmap + bytes(4 * (n + 1))
        filled = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(filled.buffers()[1], "<i8", n + 1, 8 * filled.offset)
        if offsets[-1] - offsets[0] >= 1 << 32:
            raise FormatError("ERR_UNSUPPORTED", "a column of 4 GB of text")
        values = filled.buffers()[2]
        return bitmap + (offsets - offsets[0]).astype("<u4").tobytes() + (values[int(offsets[0]) : int(offsets[-1])].to_pybytes() if values else b"")
    cells = column.fill_null(False if pa.types.is_boolean(kind) else 0).to_numpy(zero_copy_only=False)
    return bitmap + cells.astype("<f8" if type_mark(kind) == FLOAT else "<i8").tobytes()


def encode_columns(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> bytes:
    table = pa.Table.from_batches(batches, schema).combine_chunks()
    marks = schema_marks(schema)
    columns = [column_bytes(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c) for c in table.columns]
    at = 32 + len(schema_bytes(marks))
    entries = b""
    for slot, c in enumerate(columns):
        entries += struct.pack("<HHQQ", slot, 0, at, len(c))
        at += len(c)
    return head(marks, COLUMNAR, at) + b"".join(columns) + entries + struct.pack("<QQI", at, len(table), FOOTER)


class PageWriter:
    """Paged layout as a stream of bytes; readers see a page once it is whole."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.marks = schema, schema_marks(schema)
        self.entries: list[bytes] = []
        self.size = self.records = self.largest = 0

    def head(self) -> bytes:
        out = head(self.marks, PAGED, 0)
        self.size = len(out)
        return out

    def page(self, batch: pa.RecordBatch) -> bytes:
        n, number = len(batch), len(self.entries)
        body = struct.pack("<IIQIHxx", PAGE, number, self.records, n, len(self.marks)) + b"".join(map(column_bytes, batch.columns))
        size = len(body) + 4
        self.entries.append(struct.pack("<IQIQI", number, self.records, n, self.size, size))
        out = _padded(body + struct.pack("<I", size))
        self.size, self.records, self.largest = self.size + len(out), self.records + n, max(self.largest, n)
        return out

    def tail(self) -> bytes:
        return b"".join(self.entries) + struct.pack("<QQIII", self.size, self.records, len(self.entries), self.largest, FOOTER)


def encode_pages(batches: Iterable[pa.RecordBatch], schema: pa.Schema, page_records: int = 256) -> bytes:
    w = PageWriter(schema)
    out = [w.head()]
    for b in pa.Table.from_batches(batches, schema).combine_chunks().to_batches(page_records):
        out += [w.page(b.slice(i, page_records)) for i in range(0, len(b), page_records)]
    return b"".join([*out, w.tail()])


class CompactWriter:
    """Compact rows as a stream of bytes: dense records where all fields are there, others with a mask; integers as narrow
    as their column's type, booleans of a record packed, strings of the ``pooled`` columns (at most 65,536 values) by
    number, a delta tail. The pool comes before the records, so it must be known at the start."""

    _BLOCK = 64

    def __init__(self, schema: pa.Schema, pool: list[str], pooled: set[str]):
        self.schema, self.names = schema, schema.names
        self.marks = [type_mark(f.type) for f in schema]
        if any(pa.types.is_nested(f.type) for f in schema) or len(pool) > 1 << 16:
            raise FormatError("ERR_UNSUPPORTED", "lists, records or a large pool in compact rows")
        self.pool = {v: i for i, v in enumerate(pool)}
        self.pooled = [f.name in pooled and m == STR for f, m in zip(schema, self.marks, strict=True)]
        self.widths = [f.type.bit_width // 8 if m == INT and pa.types.is_integer(f.type) else 0 for f, m in zip(schema, self.marks, strict=True)]
        self.bools = [i for i, m in enumerate(self.marks) if m == BOOL]
        self.offsets: list[int] = []

    def head(self) -> bytes:
        n = len(self.names)
        out = struct.pack("<H", n) + bytes(self.marks) + b"".join(k.encode() + b"\0" for k in self.names)
        out = _padded(out) + bytes(self.widths) + bytes(int(p) for p in self.pooled) + struct.pack("<H", len(self.pool)) + b"".join(v.encode() + b"\0" for v in self.pool)
        if self.pool:
            out += bytes(-(32 + len(out)) % 8)
        flags = DENSE | PACKED_BOOLS | NARROW | DELTA_TAIL | EMBEDDED
        out = struct.pack("<IHHQQ8x", FILE, COMPACT_VERSION, flags, schema_hash(out), 0) + out
        self.size = len(out)
        return out

    def _word(self, row: list) -> bytes:
        return sum(1 << k for k, i in enumerate(self.bools) if row[i]).to_bytes(-(-len(self.bools) // 8), "little")

    def _cell(self, i: int, value: object) -> tuple[bytes, int]:
        """A field's bytes and what they are aligned to."""
        if self.pooled[i]:
            return struct.pack("<H", self.pool[value]), 2
        if self.marks[i] in (STR, BINARY):
            raw = value.encode() if isinstance(value, str) else value
            return _padded(struct.pack("<I", len(raw)) + raw), 1
        width = self.widths[i] or 8
        return (struct.pack("<d", value) if self.marks[i] == FLOAT else int(value).to_bytes(width, "little", signed=True)), width

    def _record(self, row: list) -> bytes:
        dense = all(v is not None for v in row)
        body, table, mask = b"", [], bytearray([128] * (-(-len(row) // 7) - 1) + [0])
        there = [i for i, v in enumerate(row) if v is not None]
        first_bool = next((i for i in there if i in self.bools), None)
        start = 9 if dense else 9 + len(mask) + 2 * (len(there) - max(0, sum(i in self.bools for i in there) - 1))
        for i in there:
            mask[i // 7] |= 1 << i % 7
            if i in self.bools:
                if i != first_bool:
                    continue
                cell, align = self._word(row), max(1, -(-len(self.bools) // 8))
            else:
                cell, align = self._cell(i, row[i])
            if dense:
                body += bytes(-len(body) % align)
            table.append(start + len(body))
            body += cell
        if table and table[-1] > 0xFFFF:
            raise FormatError("ERR_UNSUPPORTED", "record beyond 64 KB before its last field")
        lead = b"" if dense else bytes(mask) + np.array(table, "<u2").tobytes()
        return struct.pack("<IIB", OBJECT, 9 + len(lead) + len(body), int(dense)) + lead + body

    def sector(self, batch: pa.RecordBatch) -> bytes:
        columns = [_plain(c).to_pylist() for c in batch.columns]
        out = []
        for row in zip(*columns, strict=True):
            self.offsets.append(self.size)
            out.append(self._record(list(row)))
            self.size += len(out[-1])
        return b"".join(out)

    def tail(self) -> bytes:
        n, at = len(self.offsets), np.array(self.offsets, dtype=np.int64)
        anchors = at[:: self._BLOCK]
        deltas = at - np.repeat(anchors, self._BLOCK)[:n] if n else at
        index = struct.pack("<IIHH4x", n, self._BLOCK, 0, len(anchors)) if len(anchors) <= 0xFFFF else None
        if index is None:
            raise FormatError("ERR_UNSUPPORTED", "more than 65,535 blocks of records")
        return index + anchors.astype("<u8").tobytes() + deltas.astype("<u4").tobytes() + struct.pack("<QI", self.size, FOOTER)

"""The binary record format: reading. Little-endian throughout; all decoding is over numpy arrays of offsets.

A file is a preamble, an embedded schema (keys, one type mark a key, a hash), data in one of three layouts and a tail.
Row layout: records with a presence mask and a table of offsets, found by a tail index; its compact variants have
dense records without masks, packed booleans, narrow cells, pooled strings and a delta tail index. Columnar layout: a
presence bitmap and cells (or offsets and bytes) per field. Paged layout: pages of such columns.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

# Magics, flags and type marks of the format.
FILE, OBJECT, LIST, FOOTER, PAGE = 0x4E595842, 0x4E59584F, 0x4E59584C, 0x2153584E, 0x4E585350
COLUMNAR, EMBEDDED, PAGED = 0x0001, 0x0002, 0x0004
DENSE, PACKED_BOOLS, NARROW, DELTA_TAIL, REORDERED = 0x0010, 0x0020, 0x0040, 0x0080, 0x0100
COMPACT = DENSE | PACKED_BOOLS | NARROW | DELTA_TAIL | REORDERED
INT, FLOAT, BOOL, STR, TIME, BINARY, NULL, KEYWORD, LINK = b'=~?"@<^$&'
#: Marks that one writer puts for the same types.
LETTERS = {ord("i"): INT, ord("d"): FLOAT, ord("b"): BOOL, ord("n"): NULL, ord("B"): BINARY}
HASH_SEED, HASH_ONE, HASH_TWO = 0x93681D6255313A99, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
_M64 = (1 << 64) - 1
#: Records of a block whose types are looked at together.
_SCHEMA_ROWS = 65536
_DEEPEST = 32


class FormatError(ValueError):
    """Malformed bytes; ``code`` names the fault."""

    def __init__(self, code: str, what: str):
        super().__init__(f"{code}: {what}")
        self.code = code


def schema_hash(data: bytes) -> int:
    """The 64-bit hash of the schema's bytes."""
    h = HASH_SEED
    padded = data + bytes(-len(data) % 8)
    for (k,) in struct.iter_unpack("<Q", padded):
        k = k * HASH_ONE & _M64
        h = (h ^ k ^ k >> 33) * HASH_TWO & _M64
        h ^= h >> 33
    h ^= len(data)
    h = (h ^ h >> 33) * HASH_ONE & _M64
    return h ^ h >> 33


def bitmap_size(n: int) -> int:
    """Bytes of a presence bitmap, padded to 8."""
    return -(-n // 64) * 8


def is_record_file(data: bytes) -> bool:
    return len(data) >= 4 and struct.unpack_from("<I", data)[0] == FILE


def _names_within(kind: pa.DataType) -> set[str]:
    return {f.name for f in kind}.union(*(_names_within(f.type) for f in kind)) if pa.types.is_struct(kind) else set()


def wider(a: pa.DataType, b: pa.DataType) -> pa.DataType:
    """The type of values of both: fields of either record, doubles where a list has any. Strings and nulls are what a
    place without lists and records is taken for; otherwise the first holds."""
    if pa.types.is_struct(a) and pa.types.is_struct(b):
        fields = {f.name: f.type for f in a}
        for f in b:
            fields[f.name] = wider(fields[f.name], f.type) if f.name in fields else f.type
        return pa.struct([pa.field(k, t) for k, t in fields.items()])
    if pa.types.is_list(a) and pa.types.is_list(b):
        return a if pa.types.is_floating(a.value_type) else b
    if pa.types.is_null(a) or (pa.types.is_string(a) and pa.types.is_nested(b)):
        return b
    return a


def wider_schema(schemas: list[pa.Schema]) -> pa.Schema:
    """Columns of all files; a key that one file has only within records isn't missed there."""
    out: dict[str, pa.DataType] = {}
    for schema in schemas:
        for f in schema:
            out[f.name] = wider(out[f.name], f.type) if f.name in out else f.type
    return pa.schema(list(out.items()))


@dataclass
class Page:
    first: int
    n: int
    at: int
    size: int


@dataclass
class RecordFile:
    """A file's head and tail, checked; ``read`` decodes ranges of records."""

    data: memoryview
    keys: list[str] = field(default_factory=list)
    sigils: list[int] = field(default_factory=list)
    widths: list[int] = field(default_factory=list)
    attributes: list[int] = field(default_factory=list)
    pool: list[str] = field(default_factory=list)
    flags: int = 0
    layout: str = "row"
    n: int = 0
    pages: list[Page] = field(default_factory=list)
    columns: dict[int, tuple[int, int]] = field(default_factory=dict)
    tail: int = 0
    sealed: bool = True

    @classmethod
    def open(cls, data: bytes | memoryview, streaming: bool = False) -> RecordFile:
        """``streaming``: take a paged file that is still being written; its pages are those complete so far."""
        f = cls(memoryview(data))
        f.bytes = np.frombuffer(f.data, np.uint8)
        size = len(f.data)
        if size < 32:
            raise FormatError("ERR_OUT_OF_BOUNDS", "file too small")
        magic, _, f.flags, hashed, tail = struct.unpack_from("<IHHQQ", f.data)
        if magic != FILE:
            raise FormatError("ERR_BAD_MAGIC", "preamble")
        if f.flags & COLUMNAR and f.flags & PAGED:
            raise FormatError("ERR_INVALID_FLAGS", "columnar and paged both set")
        if f.flags & COLUMNAR and not tail:
            raise FormatError("ERR_INCOMPATIBLE_FLAGS", "columnar without a tail")
        end = f._schema()
        if f.flags & EMBEDDED and schema_hash(bytes(f.data[32:end])) != hashed:
            raise FormatError("ERR_DICT_MISMATCH", "schema hash mismatch")
        f.layout = "columnar" if f.flags & COLUMNAR else "paged" if f.flags & PAGED else "row"
        closed = size >= 44 and struct.unpack_from("<I", f.data, size - 4)[0] == FOOTER
        if f.layout == "paged" and not tail and not f._sealed_tail():
            if not streaming:
                raise FormatError("ERR_BAD_MAGIC", "footer")
            f._complete_pages(end)
            return f
        if not closed:
            if not streaming or f.layout != "row" or tail:
                raise FormatError("ERR_OUT_OF_BOUNDS" if size < 44 else "ERR_BAD_MAGIC", "footer")
            f._complete_records(end)
            return f
        getattr(f, f"_{f.layout}_tail")(tail)
        return f

    def _need(self, at: int, size: int, what: str) -> None:
        if at < 0 or at + size > len(self.data):
            raise FormatError("ERR_OUT_OF_BOUNDS", what)

    def _strings(self, at: int, n: int, what: str) -> tuple[list[str], int]:
        out = []
        for _ in range(n):
            zeros = np.flatnonzero(self.bytes[at : at + 65536] == 0)
            if not len(zeros):
                raise FormatError("ERR_OUT_OF_BOUNDS", what)
            out.append(bytes(self.data[at : at + int(zeros[0])]).decode())
            at += int(zeros[0]) + 1
        return out, at

    def _schema(self) -> int:
        """Reads the schema; returns the end of what the hash covers."""
        self._need(32, 2, "number of keys")
        (n,) = struct.unpack_from("<H", self.data, 32)
        self._need(34, n, "type marks")
        self.sigils = [LETTERS.get(s, s) for s in self.data[34 : 34 + n]]
        self.keys, at = self._strings(34 + n, n, "keys")
        at += -at % 8
        self.widths, self.attributes = [0] * n, [0] * n
        if self.flags & NARROW:
            self._need(at, n, "widths of cells")
            self.widths, at = list(self.data[at : at + n]), at + n
        if self.flags & COMPACT:
            self._need(at, n, "attributes of keys")
            self.attributes, at = list(self.data[at : at + n]), at + n
            if at + 2 <= len(self.data):
                (count,) = struct.unpack_from("<H", self.data, at)
                self.pool, at = self._strings(at + 2, count, "pooled strings")
                if count:
                    at += -at % 8
        return at

    def _row_tail(self, tail: int) -> None:
        if not tail:
            self._need(len(self.data) - 12, 12, "footer")
            (tail,) = struct.unpack_from("<Q", self.data, len(self.data) - 12)
        self.tail = tail
        self._need(tail, 12 if self.flags & DELTA_TAIL else 4, "tail index")
        (self.n,) = struct.unpack_from("<I", self.data, tail)
        if self.flags & DELTA_TAIL:
            _, block, _, anchors = struct.unpack_from("<IIHH", self.data, tail)
            self._need(tail + 16, anchors * 8 + self.n * 4, "delta tail")
            self.block, self.anchors = max(1, block), anchors
        else:
            self._need(tail + 4, self.n * 10, "tail index")

    def _columnar_tail(self, tail: int) -> None:
        self._need(len(self.data) - 20, 20, "columnar footer")
        tail, self.n, _ = struct.unpack_from("<QQI", self.data, len(self.data) - 20)
        self._need(tail, 20 * len(self.keys), "columnar tail entry")
        for i in range(len(self.keys)):
            slot, _, at, size = struct.unpack_from("<HHQQ", self.data, tail + 20 * i)
            if slot >= len(self.keys):
                raise FormatError("ERR_OUT_OF_BOUNDS", f"field {slot}")
            self._need(at, size, "column")
            self.columns[slot] = (at, size)

    def _sealed_tail(self) -> bool:
        size = len(self.data)
        if size < 60 or struct.unpack_from("<I", self.data, size - 4)[0] != FOOTER:
            return False
        (tail,) = struct.unpack_from("<Q", self.data, size - 28)
        return 0 < tail <= size - 28

    def _paged_tail(self, tail: int) -> None:
        self._need(len(self.data) - 28, 28, "paged footer")
        tail, self.n, pages, _, _ = struct.unpack_from("<QQIII", self.data, len(self.data) - 28)
        self._need(tail, 28 * pages, "page entry")
        for i in range(pages):
            _, first, n, at, size = struct.unpack_from("<IQIQI", self.data, tail + 28 * i)
            self._need(at, 24, "page offset")
            if struct.unpack_from("<I", self.data, at)[0] != PAGE:
                raise FormatError("ERR_INVALID_PAGE_MAGIC", "page magic mismatch")
            self.pages.append(Page(first, n, at, size))

    def _complete_pages(self, at: int) -> None:
        """Pages whose length trailer is there and right."""
        self.sealed = False
        at += -at % 8
        while at + 28 <= len(self.data) and struct.unpack_from("<I", self.data, at)[0] == PAGE:
            first, n = struct.unpack_from("<QI", self.data, at + 8)
            try:
                size = self._page_columns(at, n)[-1] - at + 4
                self._need(at, size + -size % 8, "page")
            except FormatError:
                break
            if struct.unpack_from("<I", self.data, at + size - 4)[0] != size:
                break
            self.pages.append(Page(first, n, at, size))
            self.n += n
            at += size + -size % 8

    def _complete_records(self, at: int) -> None:
        """Records that are there whole in a row file without a tail yet."""
        self.sealed, found = False, []
        while at + 8 <= len(self.data):
            magic, size = struct.unpack_from("<II", self.data, at)
            if magic != OBJECT:
                break
            if size < 8:
                raise FormatError("ERR_OUT_OF_BOUNDS", "record length")
            if at + size > len(self.data):
                break
            found.append(at)
            at += size
        self.walked = np.array(found, dtype=np.int64)
        self.n = len(found)

    def _column_size(self, at: int, n: int, slot: int) -> int:
        head = bitmap_size(n)
        if self.sigils[slot] not in (STR, BINARY):
            return head + 8 * n
        self._need(at + head, 4 * (n + 1), "offsets")
        return head + 4 * (n + 1) + struct.unpack_from("<I", self.data, at + head + 4 * n)[0]

    def _page_columns(self, at: int, n: int) -> list[int]:
        """Where each column of a page starts, and where the last ends."""
        out = [at + 24]
        for slot in range(len(self.keys)):
            out.append(out[-1] + self._column_size(out[-1], n, slot))
            self._need(out[-1], 0, "page column")
        return out

    # -- types
    def arrow_schema(self, most: int | None = None) -> pa.Schema:
        """Types by the type marks; in row layout all records (or the first ``most``), block by block, tell lists, nested records and marks that
        a last null has overwritten. A nested record has the fields of all records in its place."""
        kinds = {INT: pa.int64(), FLOAT: pa.float64(), BOOL: pa.bool_(), STR: pa.string(), TIME: pa.int64(), BINARY: pa.binary(), KEYWORD: pa.string(), NULL: pa.null()}
        if LINK in self.sigils:
            raise FormatError("ERR_UNSUPPORTED", "link fields")
        out = {k: kinds.get(s, pa.string()) for k, s in zip(self.keys, self.sigils, strict=True)}
        if self.layout == "row" and not self.flags & DENSE and self.n:
            own: set[str] = set()
            found: dict[str, pa.DataType] = {}
            looked = self.n if most is None else min(self.n, most)
            for start in range(0, looked, _SCHEMA_ROWS):
                places = self._positions(self.record_offsets(start, min(looked, start + _SCHEMA_ROWS)), list(range(len(self.keys))))
                for slot, key in enumerate(self.keys):
                    at = places[slot][places[slot] >= 0]
                    if len(at):
                        own.add(key)
                        if kind := self._kind_at(at):
                            found[key] = wider(found[key], kind) if key in found else kind
            out |= found
            for key in set().union(*map(_names_within, found.values())) - own:  # keys that only records within records have
                del out[key]
        return pa.schema([pa.field("_rec", pa.int64()), *(pa.field(k, t) for k, t in out.items())])

    def _kind_at(self, at: np.ndarray, depth: int = 0) -> pa.DataType | None:
        """The list or record type of the values at these places, if they are any. Their sizes are looked at as well, as
        a number may begin like one."""
        if depth > _DEEPEST:
            raise FormatError("ERR_OUT_OF_BOUNDS", "records nested too deep")
        at = at[at + 9 <= len(self.data)]
        if not len(at):
            return None
        magic, size = self._gather(at, "<u4"), self._gather(at + 4, "<u4")
        fits = (size >= 8) & (at + size.astype(np.int64) <= len(self.data))
        lists, records = at[(magic == LIST) & fits], at[(magic == OBJECT) & fits]
        if len(records):
            return pa.struct([pa.field(k, t) for k, t in self._nested_kinds(records, depth).items()])
        if len(lists):
            return pa.list_(pa.int64() if (self._gather(lists + 8, "u1") == INT).all() else pa.float64())
        return None

    def _nested_kinds(self, at: np.ndarray, depth: int) -> dict[str, pa.DataType]:
        kinds = {INT: pa.int64(), FLOAT: pa.float64(), BOOL: pa.bool_(), TIME: pa.int64(), BINARY: pa.binary()}
        out = {}
        places = self._positions(at, list(range(len(self.keys))))
        for slot, key in enumerate(self.keys):
            inner = places[slot][places[slot] >= 0]
            if len(inner):
                out[key] = self._kind_at(inner, depth + 1) or kinds.get(self.sigils[slot], pa.string())
        return out

    # -- records
    def record_offsets(self, start: int, stop: int) -> np.ndarray:
        if not self.sealed:
            return self.walked[start:stop]
        if self.flags & DELTA_TAIL:
            i = np.arange(start, stop)
            anchors = np.frombuffer(self.data, "<u8", self.anchors, self.tail + 16).astype(np.int64)
            deltas = np.frombuffer(self.data, "<u4", stop - start, self.tail + 16 + 8 * self.anchors + 4 * start).astype(np.int64)
            return anchors[i // self.block] + deltas
        entries = np.frombuffer(self.data, np.dtype([("key", "<u2"), ("at", "<u8")]), stop - start, self.tail + 4 + 10 * start)
        return entries["at"].astype(np.int64)

    def _gather(self, at: np.ndarray, kind: str) -> np.ndarray:
        """Values of a numpy type at byte places."""
        width = np.dtype(kind).itemsize
        if len(at) and (at.min() < 0 or at.max() + width > len(self.bytes)):
            raise FormatError("ERR_OUT_OF_BOUNDS", "value")
        return self.bytes[at[:, None] + np.arange(width)].view(kind).ravel()

    def _positions(self, at: np.ndarray, slots: list[int]) -> dict[int, np.ndarray]:
        """Byte places of the fields of the records at ``at``; -1 where absent."""
        if len(at) and (self._gather(at, "<u4") != OBJECT).any():
            raise FormatError("ERR_BAD_MAGIC", "record")
        if not self.flags & DENSE:
            return self._masked(at, slots, 8, False)
        dense = self._gather(at + 8, "u1") & 1 == 1
        out = {s: np.full(len(at), -1, dtype=np.int64) for s in slots}
        for rows, found in ((dense, self._dense(at[dense], slots)), (~dense, self._masked(at[~dense], slots, 9, True))):
            for s in slots:
                out[s][rows] = found[s]
        return out

    def _masked(self, at: np.ndarray, slots: list[int], head: int, bounded: bool) -> dict[int, np.ndarray]:
        n = len(self.keys)
        present = np.zeros((len(at), 7 * -(-n // 7)), dtype=np.int16)
        place, going = at + head, np.ones(len(at), dtype=bool)
        k = 0
        while going.any():
            if bounded and 7 * k >= n:
                break
            byte = np.zeros(len(at), dtype=np.uint8)
            byte[going] = self._gather(place[going], "u1")
            if 7 * k < n:
                present[:, 7 * k : 7 * k + 7] = byte[:, None] >> np.arange(7) & 1
            place += going
            going = going & (byte & 128 == 128)
            k += 1
        present = present[:, :n]
        tabled = present.copy()
        bools = self._bool_slots() if bounded else []
        seen = np.zeros(len(at), dtype=bool)
        for s in bools:  # packed booleans share one entry
            tabled[:, s] = present[:, s] * ~seen
            seen |= present[:, s] == 1
        before = np.cumsum(tabled, axis=1) - tabled
        out = {}
        for s in slots:
            here = np.full(len(at), -1, dtype=np.int64)
            rows = np.flatnonzero(present[:, s])
            entry = before[rows, s]
            if s in bools:
                entry = np.stack([np.where(tabled[rows, b] == 1, before[rows, b], -1) for b in bools]).max(axis=0)
            rel = self._gather(place[rows] + 2 * entry, "<u2").astype(np.int64)
            here[rows] = at[rows] + rel + (bools.index(s) // 8 if s in bools else 0)
            out[s] = here
        return out

    def _bool_slots(self) -> list[int]:
        return [i for i, s in enumerate(self.sigils) if s == BOOL] if self.flags & PACKED_BOOLS else []

    def _promoted(self, slot: int) -> bool:
        return bool(self.attributes[slot] & 1)

    def _prefix(self, slot: int) -> int:
        return 2 if self.attributes[slot] & 2 else 4

    def _width(self, slot: int) -> int:
        if self._promoted(slot) or self.sigils[slot] == KEYWORD:
            return 2
        return (self.widths[slot] or 8) if self.flags & NARROW else 8

    def _wire_order(self) -> list[int]:
        bools = self._bool_slots()
        if not self.flags & REORDERED:
            return list(range(len(self.keys)))
        var = [i for i, s in enumerate(self.sigils) if s in (STR, BINARY)]
        word = -(-len(bools) // 8)
        fixed = [(word if i in bools else 1 if self.sigils[i] == NULL else self._width(i) if self.sigils[i] in (INT, FLOAT, KEYWORD) else 8, i) for i in range(len(self.keys)) if i not in var and (i not in bools or i == bools[0])]
        return [i for _, i in sorted(fixed, key=lambda x: (-x[0], x[1]))] + var

    def _dense(self, at: np.ndarray, slots: list[int]) -> dict[int, np.ndarray]:
        """All fields are there, in wire order, each aligned from the start of the body."""
        body, pos = at + 9, np.zeros(len(at), dtype=np.int64)
        bools = self._bool_slots()
        out: dict[int, np.ndarray] = {}
        align = lambda p, w: p + -p % w
        for slot in self._wire_order():
            sigil = self.sigils[slot]
            if slot in bools:
                if slot == bools[0]:
                    word = -(-len(bools) // 8)
                    pos = align(pos, word)
                    out |= {b: body + pos + i // 8 for i, b in enumerate(bools)}
                    pos = pos + word
            elif sigil in (STR, BINARY) and not self._promoted(slot):
                out[slot] = body + pos
                prefix = self._prefix(slot)
                size = prefix + self._gather(body + pos, "<u2" if prefix == 2 else "<u4").astype(np.int64)
                pos = pos + size + -size % 8
            elif self._promoted(slot) or sigil == KEYWORD:
                out[slot] = body + (pos if self.flags & REORDERED and sigil in (STR, BINARY) else align(pos, 2))
                pos = align(pos, 2) + 2
            else:
                width = self._width(slot) if sigil in (INT, FLOAT, BOOL) else 8
                out[slot] = body + align(pos, width)
                pos = align(pos, width) + width
        return {s: out[s] for s in slots}

    def _cells(self, slot: int, at: np.ndarray, kind: pa.DataType) -> pa.Array:
        """Values at byte places, null where -1."""
        present = at >= 0
        where = at[present]
        if pa.types.is_null(kind) or not present.any():
            return pa.nulls(len(at), kind)
        sigil = self.sigils[slot]
        if pa.types.is_struct(kind):
            inner = self._positions(where, [self.keys.index(f.name) for f in kind])
            values = pa.StructArray.from_arrays([self._cells(self.keys.index(f.name), inner[self.keys.index(f.name)], f.type) for f in kind], fields=list(kind))
        elif pa.types.is_list(kind):
            if (self._gather(where, "<u4") != LIST).any():
                raise FormatError("ERR_BAD_MAGIC", "list")
            counts = self._gather(where + 9, "<u4").astype(np.int64)
            starts = np.repeat(where + 16, counts)
            inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            flat = self._gather(starts + 8 * inside, "<i8" if kind.value_type == pa.int64() else "<f8")
            values = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(flat))
        elif self._promoted(slot) or sigil == KEYWORD:
            index = self._gather(where, "<u2")
            values = pa.array([self.pool[i] if i < len(self.pool) else "" for i in index.tolist()], kind)
        elif pa.types.is_string(kind) or pa.types.is_binary(kind):
            prefix = self._prefix(slot)
            sizes = self._gather(where, "<u2" if prefix == 2 else "<u4").astype(np.int64)
            if (where + prefix + sizes > len(self.data)).any():
                raise FormatError("ERR_OUT_OF_BOUNDS", "string")
            starts = np.repeat(where + prefix - (np.cumsum(sizes) - sizes), sizes)
            flat = self.bytes[starts + np.arange(sizes.sum())]
            offsets = pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            values = pa.Array.from_buffers(kind, len(where), [None, offsets, pa.py_buffer(flat)])
        elif sigil == BOOL:
            cell = self._gather(where, "u1")
            bools = self._bool_slots()
            values = pa.array(cell >> (bools.index(slot) % 8) & 1 == 1 if bools else cell != 0)
        elif sigil == FLOAT:
            values = pa.array(self._gather(where, "<f4" if self._width(slot) == 4 else "<f8").astype(np.float64))
        else:
            values = pa.array(self._gather(where, f"<i{self._width(slot) if sigil == INT else 8}").astype(np.int64))
        if present.all():
            return values
        index = np.cumsum(present) - 1
        return values.take(pa.array(index, mask=~present))

    def _column(self, slot: int, at: int, n: int, start: int, stop: int, kind: pa.DataType) -> pa.Array:
        """Records ``start`` to ``stop`` of a column of ``n``."""
        first, m = start // 8, stop - start
        bits = np.unpackbits(self.bytes[at + first : at + -(-stop // 8)], bitorder="little")[start - 8 * first :][:m].astype(bool)
        cells = at + bitmap_size(n)
        if self.sigils[slot] in (STR, BINARY):
            offsets = np.frombuffer(self.data, "<u4", m + 1, cells + 4 * start).astype(np.int64)
            if m and ((np.diff(offsets) < 0).any() or cells + 4 * (n + 1) + offsets[-1] > len(self.data)):
                raise FormatError("ERR_OUT_OF_BOUNDS", "column values")
            raw = self.bytes[cells + 4 * (n + 1) + offsets[0] : cells + 4 * (n + 1) + offsets[-1]]
            values = pa.Array.from_buffers(kind, m, [None, pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
            return values if bits.all() else values.take(pa.array(np.arange(m), mask=~bits))
        cell = np.frombuffer(self.data, {FLOAT: "<f8"}.get(self.sigils[slot], "<i8"), m, cells + 8 * start)
        if pa.types.is_null(kind):
            return pa.nulls(m)
        return pa.array(cell & 255 != 0 if self.sigils[slot] == BOOL else cell, mask=~bits)

    def read(self, start: int, stop: int, schema: pa.Schema) -> pa.RecordBatch:
        """Records of a range, the columns of ``schema`` (``_rec`` and keys; unknown keys are null)."""
        start, stop = max(0, start), min(self.n, stop)
        m = max(0, stop - start)
        wanted = {f.name: self.keys.index(f.name) for f in schema if f.name in self.keys and f.name != "_rec"}
        arrays = {}
        if m and self.layout == "row":
            at = self._positions(self.record_offsets(start, stop), sorted(set(wanted.values())))
            arrays = {k: self._cells(s, at[s], schema.field(k).type) for k, s in wanted.items()}
        elif m and self.layout == "columnar":
            arrays = {k: self._column(s, self.columns[s][0], self.n, start, stop, schema.field(k).type) for k, s in wanted.items() if s in self.columns}
        elif m:
            parts = [p for p in self.pages if p.first < stop and p.first + p.n > start]
            places = {id(p): self._page_columns(p.at, p.n) for p in parts}
            for k, s in wanted.items():
                arrays[k] = pa.concat_arrays([self._column(s, places[id(p)][s], p.n, max(start, p.first) - p.first, min(stop, p.first + p.n) - p.first, schema.field(k).type) for p in parts])
        arrays["_rec"] = pa.array(np.arange(start, start + m))
        return pa.RecordBatch.from_arrays([arrays[f.name].cast(f.type) if f.name in arrays else pa.nulls(m, f.type) for f in schema], schema=schema)


class RangedFile:
    """A file of which byte ranges are fetched as they are needed: head and tail to open it, then what a range of records
    and columns takes. The bytes not fetched are zero pages that the system doesn't hold."""

    _STEP = 1 << 16

    def __init__(self, fetch: Callable[[int, int], bytes], size: int):
        self.fetch, self.size = fetch, size
        self.bytes = np.zeros(size, np.uint8)
        self.there = np.zeros(-(-size // self._STEP), bool)
        self.fetched = 0

    @classmethod
    def open(cls, fetch: Callable[[int, int], bytes], size: int) -> RangedFile:
        f = cls(fetch, size)
        f.ensure(max(0, size - cls._STEP), size)
        head = cls._STEP
        while True:
            f.ensure(0, min(size, head))
            try:
                f._tail()
                f.file = RecordFile.open(memoryview(f.bytes))
                return f
            except FormatError:
                if head >= size:
                    raise
                head *= 16  # keys beyond the head

    def _tail(self) -> None:
        """Fetches the index at the end, which the footer points to."""
        if self.size < 44:
            return
        flags, tail = struct.unpack_from("<H8xQ", self.bytes, 6)
        back = 28 if flags & PAGED else 20 if flags & COLUMNAR else 12
        (end,) = struct.unpack_from("<Q", self.bytes, self.size - back)
        tail = end if flags & (PAGED | COLUMNAR) or not tail else tail
        if 0 < tail < self.size:
            self.ensure(tail, self.size)
        if flags & PAGED:  # pages are checked by their first bytes
            pages = struct.unpack_from("<I", self.bytes, self.size - 12)[0]
            for i in range(pages if tail + 28 * pages <= self.size else 0):
                at = struct.unpack_from("<Q", self.bytes, tail + 28 * i + 16)[0]
                self.ensure(at, min(self.size, at + 24))

    def ensure(self, start: int, stop: int) -> None:
        """Fetches the bytes of a range that aren't there yet, neighbouring ones together."""
        step = self._STEP
        first, last = max(0, start) // step, -(-min(stop, self.size) // step)
        missing = np.flatnonzero(~self.there[first:last]) + first
        if not len(missing):
            return
        for run in np.split(missing, np.flatnonzero(np.diff(missing) > 1) + 1):
            a, z = int(run[0]) * step, min(self.size, (int(run[-1]) + 1) * step)
            data = self.fetch(a, z)
            if len(data) != z - a:
                raise FormatError("ERR_OUT_OF_BOUNDS", f"fetched {len(data)} bytes of {z - a}")
            self.bytes[a:z] = np.frombuffer(data, np.uint8)
            self.there[run] = True
            self.fetched += z - a

    def need(self, start: int, stop: int, keys: list[str]) -> None:
        """Fetches what records ``start`` to ``stop`` take: their bytes in row layout, the columns' cells in columnar
        layout, whole pages in paged layout."""
        f = self.file
        start, stop = max(0, start), min(f.n, stop)
        if stop <= start:
            return
        if f.layout == "row":
            at = f.record_offsets(start, stop)
            after = f.record_offsets(stop, stop + 1)[0] if stop < f.n else f.tail
            self.ensure(int(at.min()), int(max(after, at.max() + 8)))
            last = int(at.max())
            self.ensure(last, last + int(struct.unpack_from("<I", self.bytes, last + 4)[0]))
        elif f.layout == "paged":
            for p in f.pages:
                if p.first < stop and p.first + p.n > start:
                    self.ensure(p.at, p.at + p.size)
        else:
            for key in keys:
                slot = f.keys.index(key) if key in f.keys else None
                if slot in f.columns:
                    at, cells = f.columns[slot][0], f.columns[slot][0] + bitmap_size(f.n)
                    self.ensure(at + start // 8, at + -(-stop // 8))
                    if f.sigils[slot] in (STR, BINARY):
                        self.ensure(cells + 4 * start, cells + 4 * (stop + 1))
                        low, high = (struct.unpack_from("<I", self.bytes, cells + 4 * k)[0] for k in (start, stop))
                        self.ensure(cells + 4 * (f.n + 1) + low, cells + 4 * (f.n + 1) + high)
                    else:
                        self.ensure(cells + 8 * start, cells + 8 * stop)

    def arrow_schema(self, most: int) -> pa.Schema:
        if self.file.layout == "row":
            self.need(0, most, [])
        return self.file.arrow_schema(most)

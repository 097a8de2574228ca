"""The record format: round trips in all layouts, compact records built by hand, faults, streams."""

import datetime as dt
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamina.sources import encode, wire
from lamina.sources.record_source import RecordSource, describe, ranged, read_anywhere, register
from lamina.sources.wire import FormatError, RecordFile
from lamina.streaming.running import append, arriving, running_sum

FLAT = pa.RecordBatch.from_pydict(
    {"id": list(range(1000)), "username": [f"user_{i}" for i in range(1000)], "score": [i * 0.25 + 1.5 for i in range(1000)], "active": [i % 2 == 0 for i in range(1000)], "gap": [None if i % 3 else i for i in range(1000)], "word": [None if i % 7 else "héllo\n" * (i % 5) for i in range(1000)], "raw": [bytes([i % 256]) * (i % 9) for i in range(1000)]},
    schema=pa.schema([("id", pa.int64()), ("username", pa.string()), ("score", pa.float64()), ("active", pa.bool_()), ("gap", pa.int64()), ("word", pa.string()), ("raw", pa.binary())]),
)


def _read(data: bytes, start: int = 0, stop: int | None = None, **kw) -> list[dict]:
    f = RecordFile.open(data, **kw)
    schema = f.arrow_schema()
    return pa.Table.from_batches([f.read(start, f.n if stop is None else stop, schema)]).to_pylist()


@pytest.mark.parametrize("how", [encode.encode_rows, encode.encode_columns, encode.encode_pages])
@pytest.mark.parametrize(("start", "stop"), [(0, None), (0, 0), (250, 519), (999, 1000), (900, 5000)])
def test_round_trip(how, start, stop):
    want = [r | {"_rec": i} for i, r in enumerate(FLAT.to_pylist())][start:stop]
    assert [{k: v for k, v in r.items()} for r in _read(how([FLAT], FLAT.schema), start, stop)] == [{"_rec": r["_rec"], **{k: r[k] for k in FLAT.schema.names}} for r in want]


@pytest.mark.parametrize("how", [encode.encode_rows, encode.encode_columns, encode.encode_pages])
def test_no_records(how):
    assert _read(how([], FLAT.schema)) == []


def test_nested_and_lists():
    inner = pa.struct([("b", pa.struct([("c", pa.float64())])), ("d", pa.string())])
    schema = pa.schema([("id", pa.int64()), ("a", inner), ("longs", pa.list_(pa.int64())), ("doubles", pa.list_(pa.float64()))])
    rows = [{"id": 1, "a": {"b": {"c": 2.5}, "d": "x"}, "longs": [1, 2, 3], "doubles": []}, {"id": 2, "a": None, "longs": None, "doubles": [0.5]}]
    got = _read(encode.encode_rows([pa.RecordBatch.from_pylist(rows, schema)], schema))
    assert [{k: v for k, v in r.items() if k != "_rec"} for r in got] == rows


def test_late_lists_and_nested_fields():
    """What first comes after many records, or not in the first nested one, has its type too."""
    schema = pa.schema([("id", pa.int64()), ("a", pa.struct([("b", pa.int64()), ("c", pa.string())])), ("c", pa.string()), ("longs", pa.list_(pa.int64()))])
    rows = [{"id": i, "a": None, "c": None, "longs": None} for i in range(1500)]
    rows[3]["a"], rows[4]["a"] = {"b": 1, "c": None}, {"b": None, "c": "x"}
    rows += [{"id": wire.OBJECT, "a": {"b": 2, "c": "y"}, "c": "own", "longs": [7, 8]}]
    assert [{k: v for k, v in r.items() if k != "_rec"} for r in _read(encode.encode_rows([pa.RecordBatch.from_pylist(rows, schema)], schema))] == rows
    one = wire.wider_schema([pa.schema([("a", pa.string())]), pa.schema([("a", pa.list_(pa.int64())), ("z", pa.bool_())])])
    assert one == pa.schema([("a", pa.list_(pa.int64())), ("z", pa.bool_())])


def test_many_fields_and_unknown_keys():
    schema = pa.schema([(f"f{i}", pa.int64()) for i in range(30)])
    rows = [{f"f{i}": i * 100 for i in range(30) if (i + r) % 4} for r in range(9)]
    f = RecordFile.open(encode.encode_rows([pa.RecordBatch.from_pylist(rows, schema)], schema))
    got = f.read(0, 9, f.arrow_schema().append(pa.field("nope", pa.int64()))).to_pylist()
    assert [{k: v for k, v in r.items() if v is not None and k != "_rec"} for r in got] == rows


def _compact(flags: int, keys: list[tuple[str, int]], records: list[bytes], widths=None, attributes=None, pool=(), delta=False) -> bytes:
    n = len(keys)
    schema = struct.pack("<H", n) + bytes(s for _, s in keys) + b"".join(k.encode() + b"\0" for k, _ in keys)
    schema += bytes(-(32 + len(schema)) % 8)
    if flags & wire.NARROW:
        schema += bytes(widths or [0] * n)
    schema += bytes(attributes or [0] * n) + struct.pack("<H", len(pool)) + b"".join(p.encode() + b"\0" for p in pool)
    if pool:
        schema += bytes(-(32 + len(schema)) % 8)
    at, offsets, body = 32 + len(schema), [], b""
    for r in records:
        offsets.append(at + len(body))
        body += r
    tail = at + len(body)
    if delta:
        index = struct.pack("<IIHH4xQ", len(records), 64, 1, 1, offsets[0]) + np.array([o - offsets[0] for o in offsets], "<u4").tobytes()
    else:
        index = struct.pack("<I", len(records)) + b"".join(struct.pack("<HQ", i, o) for i, o in enumerate(offsets))
    return struct.pack("<IHHQQ8x", wire.FILE, 0x0103, flags | wire.EMBEDDED, wire.schema_hash(schema), tail) + schema + body + index + struct.pack("<QI", tail, wire.FOOTER)


def _dense(body: bytes) -> bytes:
    return struct.pack("<IIB", wire.OBJECT, 9 + len(body), 1) + body


def test_compact_dense_records():
    keys = [("a", wire.INT), ("x", wire.BOOL), ("s", wire.STR), ("y", wire.BOOL), ("f", wire.FLOAT), ("k", wire.KEYWORD), ("p", wire.STR)]
    flags = wire.DENSE | wire.PACKED_BOOLS | wire.NARROW | wire.DELTA_TAIL
    rows = []
    for i in range(5):
        body = struct.pack("<b", i - 2) + bytes([i & 1 | (i >> 1 & 1) << 1])  # a (1 byte), both booleans in one
        text = b"t" * i
        cell = struct.pack("<H", len(text)) + text
        body += cell + bytes(-len(cell) % 8)
        body += bytes(-len(body) % 4) + struct.pack("<f", i / 2)
        body += bytes(-len(body) % 2) + struct.pack("<H", i % 2) + struct.pack("<H", 1 - i % 2)
        rows.append(_dense(body))
    data = _compact(flags, keys, rows, widths=[1, 0, 0, 0, 4, 0, 0], attributes=[0, 0, 2, 0, 0, 0, 1], pool=("zero", "one"), delta=True)
    want = [{"_rec": i, "a": i - 2, "x": bool(i & 1), "s": "t" * i, "y": bool(i & 2), "f": i / 2, "k": ["zero", "one"][i % 2], "p": ["one", "zero"][i % 2]} for i in range(5)]
    assert _read(data) == want


def test_compact_reordered_and_sparse_records():
    keys = [("s", wire.STR), ("x", wire.BOOL), ("a", wire.INT), ("y", wire.BOOL)]
    flags = wire.DENSE | wire.PACKED_BOOLS | wire.REORDERED
    full = _dense(struct.pack("<q", 7) + bytes([0b10]) + struct.pack("<I", 2) + b"hi\0\0")
    # sparse: s and both booleans; the booleans share one entry of the table
    mask, head = bytes([0b1011]), 9 + 1 + 4
    sparse = struct.pack("<IIB", wire.OBJECT, head + 9, 0) + mask + struct.pack("<HH", head, head + 8) + struct.pack("<I", 3) + b"abc\0" + bytes([0b01])
    assert _read(_compact(flags, keys, [full, sparse])) == [{"_rec": 0, "s": "hi", "x": False, "a": 7, "y": True}, {"_rec": 1, "s": "abc", "x": True, "a": None, "y": False}]


def test_faults():
    good = encode.encode_rows([FLAT], FLAT.schema)
    columns, pages = encode.encode_columns([FLAT], FLAT.schema), encode.encode_pages([FLAT], FLAT.schema)

    def changed(data: bytes, at: int, new: bytes) -> bytes:
        return data[:at] + new + data[at + len(new) :]

    first = RecordFile.open(pages).pages[0].at
    for data, code in [
        (changed(good, 0, b"XXXX"), "ERR_BAD_MAGIC"),
        (good[:20], "ERR_OUT_OF_BOUNDS"),
        (changed(good, 40, b"\xff"), "ERR_DICT_MISMATCH"),
        (changed(good, len(good) - 4, b"XXXX"), "ERR_BAD_MAGIC"),
        (changed(columns, 6, struct.pack("<H", wire.COLUMNAR | wire.PAGED | wire.EMBEDDED)), "ERR_INVALID_FLAGS"),
        (changed(columns, 16, bytes(8)), "ERR_INCOMPATIBLE_FLAGS"),
        (changed(pages, first, b"XXXX"), "ERR_INVALID_PAGE_MAGIC"),
    ]:
        with pytest.raises(FormatError) as e:
            RecordFile.open(data)
        assert e.value.code == code
    w = encode.RowWriter(FLAT.schema)
    with pytest.raises(FormatError):
        w.sector(pa.RecordBatch.from_pydict({"id": ["late change"]}))
    bad = w.head() + struct.pack("<II", wire.OBJECT, 4) + bytes(64)
    with pytest.raises(FormatError):
        RecordFile.open(bad, streaming=True)


@pytest.mark.parametrize("layout", ["row", "columnar", "paged"])
def test_spark_round_trip(spark, tmp_path, layout):
    register(spark)
    df = spark.range(1000, numPartitions=3).select(F.col("id"), (F.col("id") * 0.5).alias("score"), (F.col("id") % 2 == 0).alias("active"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("user_"), "id")).alias("name"))
    df.write.format("records").mode("overwrite").option("layout", layout).option("page_records", 64).save(str(tmp_path))
    back = spark.read.format("records").option("records_per_partition", 100).load(str(tmp_path))
    assert sorted(map(tuple, back.drop("_rec").collect())) == sorted(map(tuple, df.collect()))
    assert [r["_rec"] for r in back.orderBy("_rec").select("_rec").collect()] == list(range(1000))
    assert back.filter("_rec = 42").count() == 1 and back.filter("_rec between 100 and 199").count() == 100
    one = spark.read.format("records").option("columns", "score").load(str(tmp_path))
    assert one.columns == ["_rec", "score"] and one.agg(F.sum("score")).first()[0] == 249750.0
    assert read_anywhere(spark, str(tmp_path), ["score"]).agg(F.sum("score")).first()[0] == 249750.0


def test_partitions_follow_filters(tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.rec").write_bytes(encode.encode_rows([FLAT], FLAT.schema))
    from pyspark.sql import datasource as ds

    reader = RecordSource({"path": str(tmp_path)}).reader(None)
    list(reader.pushFilters([ds.GreaterThanOrEqual(("_rec",), 990), ds.LessThan(("_rec",), 1005)]))
    assert [(p.start, p.stop, p.base) for p in reader.partitions()] == [(990, 1000, 0), (0, 5, 1000)]
    reader = RecordSource({"path": str(tmp_path)}).reader(None)
    list(reader.pushFilters([ds.In(("_rec",), (3, 1999, 5000))]))
    assert [(p.start, p.base) for p in reader.partitions()] == [(3, 0), (999, 1000)]


@pytest.mark.parametrize("kind", ["paged", "row"])
def test_stream_of_a_growing_file(spark, tmp_path, kind):
    batch = pa.RecordBatch.from_pydict({"id": list(range(1000)), "score": [i * 0.5 for i in range(1000)]})
    w = encode.PageWriter(batch.schema) if kind == "paged" else encode.RowWriter(batch.schema)
    head = w.head()
    put = w.page if kind == "paged" else w.sector
    parts = [put(batch.slice(i, 256)) for i in range(0, 1000, 256)]
    path = tmp_path / "grow.rec"
    path.write_bytes(head + parts[0] + parts[1][:20])  # the second is still being written
    where = tmp_path / "checkpoint"

    def total() -> tuple:
        q = running_sum(arriving(spark, str(path)), "score").writeStream.outputMode("complete").format("memory").queryName("sums").option("checkpointLocation", str(where)).start()
        q.processAllAvailable()
        q.stop()
        return tuple(spark.table("sums").first())

    # in row layout the 20 bytes hold no whole record either
    assert total() == (16320.0, 256)
    path.write_bytes(head + b"".join(parts) + w.tail())
    assert total() == (249750.0, 1000)
    assert RecordFile.open(path.read_bytes(), streaming=True).sealed


def _ids(n: int, start: int = 0) -> pa.RecordBatch:
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])
    return pa.RecordBatch.from_pydict({"id": list(range(start, start + n)), "score": [float(i) for i in range(start, start + n)]}, schema)


def test_stream_of_a_folder(spark, tmp_path):
    """All files, those that grow, and those that come later; each record once."""
    folder, where, out = tmp_path / "in", str(tmp_path / "checkpoint"), str(tmp_path / "out")
    folder.mkdir()
    for i in range(4):
        (folder / f"{i}.rec").write_bytes(encode.encode_rows([_ids(100, 100 * i)], _ids(0).schema))
    (folder / "notes.txt").write_text("no records")
    w = encode.PageWriter(_ids(0).schema)
    head, first, second = w.head(), w.page(_ids(50, 400)), w.page(_ids(50, 450))
    (folder / "grows.rec").write_bytes(head + first + second[:30])
    counts = []
    for turn in range(3):
        append(arriving(spark, str(folder)), out, where).awaitTermination()
        counts.append(sorted(r["id"] for r in spark.read.format("records").load(out).select("id").collect()))
        if not turn:
            (folder / "grows.rec").write_bytes(head + first + second + w.tail())
            (folder / "new.rec").write_bytes(encode.encode_columns([_ids(100, 500)], _ids(0).schema))
    assert counts[0] == list(range(450)) and counts[1] == counts[2] == list(range(600))


def test_repeated_batch_counts_once(spark, tmp_path):
    register(spark)
    write = lambda lo, hi, batch, parts: spark.range(lo, hi, numPartitions=parts).write.format("records").mode("append").option("batch", batch).save(str(tmp_path))
    write(0, 50, 0, 3)
    write(50, 80, 1, 4)
    write(50, 80, 1, 2)  # again, with other partitions
    assert sorted(r["id"] for r in spark.read.format("records").load(str(tmp_path)).collect()) == list(range(80))


def test_overwrite_keeps_what_is_no_record_file(spark, tmp_path):
    register(spark)
    (tmp_path / "notes.txt").write_text("mine")
    for n in (50, 20):
        spark.range(n).write.format("records").mode("overwrite").save(str(tmp_path))
    assert spark.read.format("records").load(str(tmp_path)).count() == 20
    assert (tmp_path / "notes.txt").read_text() == "mine" and not [f for f in tmp_path.iterdir() if f.name.startswith("_")]

    def fails(batches):
        for b in batches:
            if b.column(0)[0].as_py() > 3:
                raise RuntimeError("lost")
            yield b

    with pytest.raises(Exception, match="lost"):
        spark.range(10, numPartitions=5).mapInArrow(fails, "id long").write.format("records").mode("overwrite").save(str(tmp_path))
    assert spark.read.format("records").load(str(tmp_path)).count() == 20
    with pytest.raises(Exception, match="mounted"):
        spark.read.format("records").load("hdfs://host/somewhere")


@pytest.mark.parametrize("how", [encode.encode_rows, encode.encode_columns, encode.encode_pages])
def test_ranged_reads(spark, tmp_path, how):
    """Head, tail and the ranges that a read takes, and no more."""
    big = pa.RecordBatch.from_pydict({"id": list(range(60_000)), "word": [f"some word {i}" * 3 for i in range(60_000)], "gap": [None if i % 3 else i for i in range(60_000)]})
    data = how([big], big.schema)
    calls = []
    f = wire.RangedFile.open(lambda a, z: calls.append((a, z)) or data[a:z], len(data))
    schema = f.arrow_schema(10)
    opened = f.fetched
    f.need(30_000, 30_100, ["id", "word", "gap"])
    assert f.file.read(30_000, 30_100, schema).to_pylist() == [{"_rec": i, **r} for i, r in enumerate(big.slice(30_000, 100).to_pylist(), 30_000)]
    assert f.fetched - opened <= 6 * (1 << 16) and (how is encode.encode_pages or f.fetched < len(data) / 2)
    path = tmp_path / "x.rec"
    path.write_bytes(data)
    got = ranged(spark, {str(path): len(data)}, records_per_partition=7000).orderBy("_rec").collect()
    assert [r.asDict() for r in got] == [{"_rec": i, **r} for i, r in enumerate(big.to_pylist())]
    with pytest.raises(FormatError):
        wire.RangedFile.open(lambda a, z: data[a:z][:-1], len(data))


def test_compact_writer():
    """Dense and sparse records, many booleans, narrow integers, pooled strings, dates, over several blocks."""
    schema = pa.schema([("a", pa.int8()), ("x", pa.bool_()), ("s", pa.string()), ("y", pa.bool_()), ("b", pa.int32()), ("f", pa.float64()), ("p", pa.string()), ("d", pa.date32()), ("raw", pa.binary()), *((f"z{i}", pa.bool_()) for i in range(9))])
    rng = np.random.default_rng(3)
    rows = []
    for i in range(500):
        row = {"a": i % 256 - 128, "x": i % 2 == 0, "s": "é" * (i % 7), "y": i % 3 == 0, "b": -(10**6) * i, "f": i / 7, "p": ["zero", "one", "two"][i % 3], "d": dt.date(2020, 1, 1) + dt.timedelta(i), "raw": bytes([i % 256]) * (i % 5)} | {f"z{k}": bool(i >> k & 1) for k in range(9)}
        rows.append({k: None if i % 4 == 0 and rng.random() < 0.4 else v for k, v in row.items()})
    w = encode.CompactWriter(schema, ["one", "two", "zero"], {"p"})
    data = w.head() + w.sector(pa.RecordBatch.from_pylist(rows, schema)) + w.tail()
    ns = lambda d: None if d is None else (d - dt.date(1970, 1, 1)).days * 86_400_000_000_000
    assert _read(data) == [{"_rec": i, **r, "d": ns(r["d"])} for i, r in enumerate(rows)]
    with pytest.raises(FormatError):
        encode.CompactWriter(pa.schema([("l", pa.list_(pa.int64()))]), [], set())


def test_describe(spark, tmp_path):
    for name, how in (("a", encode.encode_rows), ("b", encode.encode_columns), ("c", encode.encode_pages)):
        (tmp_path / f"{name}.rec").write_bytes(how([FLAT], FLAT.schema))
    got = describe(spark, str(tmp_path)).orderBy("file").collect()
    assert [(r["layout"], r["records"], r["pages"], r["marks"], r["sealed"]) for r in got] == [("row", 1000, 0, '="~?="<', True), ("columnar", 1000, 0, '="~?="<', True), ("paged", 1000, 4, '="~?="<', True)]
    assert got[0]["keys"] == FLAT.schema.names
    assert wire.is_record_file((tmp_path / "a.rec").read_bytes()) and not wire.is_record_file(b"PAR1")


def test_append_log():
    """Records without head and tail, as an append log takes them, are what a whole file holds between the two."""
    w = encode.RowWriter(FLAT.schema)
    head = w.head()
    log = b"".join(w.sector(FLAT.slice(i, 100)) for i in range(0, 1000, 100))
    assert head + log + w.tail() == encode.encode_rows([FLAT], FLAT.schema)


_ROW = st.fixed_dictionaries(
    {
        "i": st.none() | st.integers(-(1 << 63), (1 << 63) - 1),
        "f": st.none() | st.floats(allow_nan=False),
        "b": st.none() | st.booleans(),
        "s": st.none() | st.text(st.characters(exclude_categories=["Cs"]), max_size=20),
        "x": st.none() | st.binary(max_size=20),
    }
)
_KINDS = pa.schema([("i", pa.int64()), ("f", pa.float64()), ("b", pa.bool_()), ("s", pa.string()), ("x", pa.binary())])


@settings(max_examples=60, deadline=None)
@given(st.lists(_ROW, max_size=40), st.integers(0, 45), st.integers(0, 45), st.integers(1, 17))
def test_any_table_round_trips(rows, start, stop, page):
    batch = pa.RecordBatch.from_pylist(rows, _KINDS)
    want = [r | {"_rec": k} for k, r in enumerate(rows)][start:stop]
    for data in (encode.encode_rows([batch], _KINDS), encode.encode_columns([batch], _KINDS), encode.encode_pages([batch], _KINDS, page)):
        f = RecordFile.open(data)
        got = f.read(start, stop, pa.schema([("_rec", pa.int64()), *_KINDS])).to_pylist()
        assert got == [{"_rec": r["_rec"], **{k: r[k] for k in _KINDS.names}} for r in want]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=200), st.integers(0, 1 << 30))
def test_damaged_files_fail_cleanly(noise, at):
    """Bytes overwritten anywhere give a format error, another table, or text that is no UTF-8; never a crash."""
    data = bytearray(encode.encode_rows([FLAT.slice(0, 20)], FLAT.schema))
    at %= len(data)
    data[at : at + len(noise)] = noise[: len(data) - at]
    try:
        _read(bytes(data))
    except (FormatError, UnicodeDecodeError):
        pass

"""Small files against descriptions: typed fields, null, booleans, unicode, evolution, two-byte masks, faults."""

import pyarrow as pa
import pytest

from lamina.sources import encode
from lamina.sources.conformance import differences

CASES = [
    ({"id": [10, 20], "name": ["foo", "bar"], "value": [1.5, 2.5]}, {"record_count": 2, "keys": ["id", "name", "value"], "records": [{"id": 10, "name": "foo", "value": 1.5}, {"id": 20, "name": "bar", "value": 2.5}]}),
    ({"a": [99], "b": pa.array([None], pa.int64())}, {"records": [{"a": 99, "b": None}]}),
    ({"flag": [True, False]}, {"records": [{"flag": True}, {"flag": False}]}),
    ({"msg": ["héllo wörld"]}, {"records": [{"msg": "héllo wörld"}]}),
    ({"a": [100], "b": [200], "c": [300]}, {"keys": ["a", "b", "c"], "records": [{"a": 100, "c": 300, "later": None}]}),
    ({f"f{i}": [i * 100] for i in range(9)}, {"records": [{f"f{i}": i * 100 for i in range(9)}]}),
    ({"xs": [[1, 2], []], "ys": [[0.5], None]}, {"records": [{"xs": [1, 2], "ys": [0.5]}, {"xs": []}]}),
]


@pytest.mark.parametrize(("columns", "expected"), CASES)
def test_described(columns, expected):
    batch = pa.RecordBatch.from_pydict(columns)
    data = encode.encode_rows([batch], batch.schema)
    assert differences(data, expected) == []
    assert differences(data, expected | {"record_count": 77}) == [f"{len(batch)} records, expected 77"]
    assert differences(data[:20], {"error": "ERR_OUT_OF_BOUNDS"}) == [] and differences(data, {"error": "ERR_BAD_MAGIC"}) and differences(b"", expected)
    wrong = {"records": [{k: "no such value" for k in columns}]}
    assert len(differences(data, wrong)) == len(columns)


@pytest.mark.parametrize("n", [100, 1000])
def test_closed_forms(n):
    """i * 0.5 sums to n (n - 1) / 4 in each layout; strings at page edges are where they should be."""
    batch = pa.RecordBatch.from_pydict({"id": list(range(n)), "score": [i * 0.5 for i in range(n)], "active": [i % 2 == 0 for i in range(n)], "ts": [i * 1_000_000 for i in range(n)], "name": [f"user_{i}" for i in range(n)]})
    expected = {"record_count": n, "records": batch.to_pylist()}
    for data in (encode.encode_rows([batch], batch.schema), encode.encode_columns([batch], batch.schema), encode.encode_pages([batch], batch.schema, 128)):
        assert differences(data, expected) == []

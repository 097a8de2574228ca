"""Holds a record file against a description of what it should read as.

A description has ``record_count``, ``keys`` and ``records`` (all optional), or the ``error`` code that opening or
reading the file must give. Numbers may differ by a relative 1e-9; fields expected as null are skipped.
"""

from __future__ import annotations

import math

import pyarrow as pa

from lamina.sources.wire import FormatError, RecordFile


def _same(found: object, wanted: object) -> bool:
    if isinstance(wanted, bool) or isinstance(found, bool):
        return found is wanted
    if isinstance(wanted, (int, float)) and isinstance(found, (int, float)):
        return found == wanted or math.isclose(found, wanted, rel_tol=1e-9, abs_tol=1e-9)
    if isinstance(wanted, list) and isinstance(found, list):
        return len(wanted) == len(found) and all(map(_same, found, wanted))
    if isinstance(wanted, dict) and isinstance(found, dict):
        return all(v is None or _same(found.get(k), v) for k, v in wanted.items())
    return found == wanted


def differences(data: bytes, expected: dict) -> list[str]:
    """What is not as described; empty if all is."""
    try:
        f = RecordFile.open(data)
        schema = f.arrow_schema()
        rows = pa.Table.from_batches([f.read(0, f.n, schema)]).to_pylist()
    except FormatError as e:
        return [] if e.code == expected.get("error") else [f"error {e.code}, expected {expected.get('error')}"]
    if "error" in expected:
        return [f"no error, expected {expected['error']}"]
    out = []
    if "record_count" in expected and f.n != expected["record_count"]:
        out.append(f"{f.n} records, expected {expected['record_count']}")
    if "keys" in expected and f.keys != list(expected["keys"]):
        out.append(f"keys {f.keys}, expected {expected['keys']}")
    for i, (row, wanted) in enumerate(zip(rows, expected.get("records", []), strict=False)):
        out += [f"record {i}, {k}: {row.get(k)!r}, expected {v!r}" for k, v in wanted.items() if v is not None and not _same(row.get(k), v)]
    if len(expected.get("records", [])) > f.n:
        out.append("fewer records than described")
    return out

"""Results of Python functions over files are taken over part by part."""

import pyarrow as pa

from regulith.sources import files


def test_results_are_python_objects_in_small_parts_only(monkeypatch):
    held, made = [], []
    monkeypatch.setattr(files, "PART", 100)
    own = pa.array
    monkeypatch.setattr(files.pa, "array", lambda rows, kind: made.append(len(rows)) or own(rows, kind))
    rows = [b"x" * n for n in (10, 40, 60, 0, 300, 5)] + [None]
    got = files._array(iter(rows), pa.binary(), lambda b: held.append(b) or len(b or b""))
    assert got.to_pylist() == rows and made == [3, 2, 2] and held == rows
    assert files._array(iter(()), pa.binary(), len).to_pylist() == []

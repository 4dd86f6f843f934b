"""Arrow functions take their rows some at a time."""

import pyarrow as pa
import pytest

from quietlog.functions import text


@pytest.mark.parametrize("limit", [1, 50, 1 << 20])
def test_steps_bound_what_is_taken_apart(monkeypatch, limit):
    monkeypatch.setattr(text, "STEP_BYTES", limit)
    names = [None if i % 7 == 3 else "é" * (i % 13) for i in range(200)]
    lists = [None if i % 5 == 0 else [str(i)] * (i % 4) for i in range(200)]
    sizes = []

    def one(a, b):
        sizes.append((len(a), sum(2 * len(x or "") for x in a)))
        return [None if x is None else [x, *(y or [])] for x, y in zip(a, b, strict=True)]

    kind = pa.list_(pa.string())
    out = text.in_steps(one, kind, pa.array(names, pa.string()), pa.array(lists, kind))
    assert out.type == kind and out.to_pylist() == [None if x is None else [x, *(y or [])] for x, y in zip(names, lists, strict=True)]
    assert all(n == 1 or size <= limit for n, size in sizes)


def test_no_rows():
    assert text.in_steps(lambda a: a, pa.string(), pa.array([], pa.string())).to_pylist() == []

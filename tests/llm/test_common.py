"""Tasks that give memory back."""

import pyarrow as pa
import pytest

from graphlake.llm import common


def test_batches_pass_through_and_memory_goes_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    batches = [pa.RecordBatch.from_arrays([pa.array([i])], names=["a"]) for i in range(3)]
    assert list(common.released(lambda b: b)(iter(batches))) == batches and calls == [1]

    def fails(b):
        yield next(b)
        raise ValueError("text")

    with pytest.raises(ValueError, match="text"):
        list(common.released(fails)(iter(batches)))
    assert calls == [1, 1]
    assert list(common.released(lambda b: b)(iter([]))) == [] and calls == [1, 1, 1]


def test_giving_back_keeps_what_is_held():
    held = pa.array(range(1000))
    common.give_back()
    assert held.to_pylist() == list(range(1000))

"""Words of rows become Python objects in blocks, however many rows a batch has."""

from __future__ import annotations

import pyarrow as pa

from quillspark.operators import penalised as pn


def test_words_are_counted_in_blocks():
    n = 3 * pn.ROWS + 7
    batch = pa.RecordBatch.from_pydict({"key": [str(i) for i in range(n)], "label": [i % 2 for i in range(n)], "folds": [[i % 5] for i in range(n)], "terms": [["b", "a", "b", "z"][: i % 5] for i in range(n)]})
    out = list(pn._counted([batch, batch.slice(0, 0)], {"a": 0, "b": 1}))
    assert [b.num_rows for b in out] == [pn.ROWS] * 3 + [7]
    rows = pa.Table.from_batches(out).to_pylist()
    assert [r["key"] for r in rows] == [str(i) for i in range(n)] and [r["folds"] for r in rows] == [[i % 5] for i in range(n)]
    assert [(r["at"], r["n"]) for r in rows[:5]] == [([], []), ([1], [1.0]), ([0, 1], [1.0, 1.0]), ([0, 1], [1.0, 2.0]), ([0, 1], [1.0, 2.0])]

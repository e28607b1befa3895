"""Cells are packed by ranges; those of two objects come out, whatever the sizes of ranges and batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from demandlens.llm import similarity
from demandlens.llm.line_dedup import LineConfig, Lines, Run


@pytest.mark.parametrize("counted", [False, True])
@pytest.mark.parametrize("limits", [{}, {"RANGES": 1, "ROW_CELLS": 7, "RANGE_CELLS": 20}])
def test_cells_of_two_objects_are_found(spark, monkeypatch, counted, limits):
    for k, v in limits.items():
        monkeypatch.setattr(similarity, k, v)
    rng = np.random.default_rng(7)
    # one cell of very many objects, some of a few, many of one; rows repeat
    sig = np.concatenate([np.full(500, -5), rng.integers(0, 400, 600), rng.integers(-(1 << 62), 1 << 62, 900)]) * 3_037_000_493
    key = rng.integers(0, 300, len(sig))
    rows = sorted(set(zip(sig.tolist(), key.tolist())))
    rows = [(s, k) for s, k in rows for _ in range(1 + k % 3)]

    def run(batches):
        for batch in batches:
            s, k = (np.array(c.to_pylist(), dtype=np.int64) for c in batch.columns)
            more = [pa.array((k % 5).astype(np.int32)), pa.array((k % 11).astype(np.int32))] if counted else []
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(k), *more], ["sig", "key", "tag", "need"][: 2 + len(more)])

    found = similarity.shared_cells(spark.createDataFrame(rows, "sig long, key long").repartition(5), run, counted).collect()
    objects: dict[int, set[int]] = {}
    for s, k in rows:
        objects.setdefault(s, set()).add(k)
    assert {(x.sig, x.key) for x in found} == {(s, k) for s, keys in objects.items() if len(keys) > 1 for k in keys}
    assert not counted or all((x.tag, x.need) == (x.key % 5, x.key % 11) for x in found)
    assert len(found) < len(rows)


def test_lines_with_a_word_and_hashes_of_parts():
    lines = Lines(["\n--\nа\n漢 \n\n .é", "", "x", "½\n٣\n \n_"])
    assert [lines.text.split("\n")[i] for i in lines.compared(LineConfig())] == ["а", "漢 ", " .é", "x", "½", "٣"]
    assert lines.compared(LineConfig(min_chars=2)).tolist() == [3, 5]
    run = Run(lines.codes)
    assert run.total.tolist() == Run(lines.codes.astype(np.uint64)).total.tolist()

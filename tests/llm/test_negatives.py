"""Hard negatives against all scores."""

import math
import random

import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from siteloom.llm import negatives
from siteloom.llm.queries import QUERIES
from siteloom.llm.sql import ORACLES

SCHEMA = "vec_id long, embedding array<float>, label int, score long, cells string"


def vectors(seed=5, n=400, size=9, labels=4):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0.3, 1) for _ in range(size)], rng.randrange(labels)) for i in range(n)]
    rows += [(1000 + i, rows[200][1], rng.randrange(labels)) for i in range(60)]  # copies
    rows += [(100, rows[100][1], rows[100][2]), (300, rows[5][1], 0), (None, rows[7][1], 1)]  # repeated and null ids
    rows += [(2000, None, 1), (2100, rows[1][1], None), (2200, [None] * size, 1), (2300, [math.nan] * size, 1), (2400, [1e39] * size, 2), (2500, [1.0, 2.0], 1), (2600, [], 1)]
    return rows


def plain(rows, k=5):
    """By hand, with numpy only for float32 rounding."""
    real = []
    for i, v, label in rows:
        v = None if v is None else [None if x is None else float(np.float32(x)) for x in v]
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        real.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    first = lambda x: (-x[0], x[1] is not None, x[1] or 0)
    out = []
    for at, (anchor, label, v) in enumerate(real):
        if anchor is None or anchor % 100:
            continue
        scores = [(sum(a * b for a, b in zip(v, w, strict=False)), i, other, n != at) for n, (i, other, w) in enumerate(real)]
        same = sorted([s for s in scores if s[2] == label and s[3]], key=first)[:k]
        for p in same:
            fits = sorted([s for s in scores if s[2] != label and 80 * p[0] <= 100 * s[0] <= 100 * p[0]], key=first)[:k]
            out += [(anchor, p[1], r, s[1], p[0], s[0]) for r, s in enumerate(fits, 1)]
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


@pytest.mark.parametrize("cells,group,part", [(256, 512, 2048), (4, 2, 50), (16, 1, 7)])
def test_equals_all_scores(spark, tmp_path, monkeypatch, cells, group, part):
    for name, value in (("CELLS", cells), ("ANCHORS", group), ("ROWS", part)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors()
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((tuple(r) for r in QUERIES["op11_hard_negatives"](spark, str(tmp_path)).collect()), key=str)
    assert got == plain(rows) and len(got) > 20


def test_no_rows_no_anchors_no_components(spark, tmp_path):
    rows = frame(spark, vectors()).select("vec_id", "label", negatives.whole_components("embedding").alias("vector"))
    for some, anchor in ((rows.limit(0), F.lit(True)), (rows, F.lit(False)), (rows.where("vector IS NULL"), F.lit(True)), (rows.where("size(vector) = 0"), F.lit(True))):
        assert negatives.hard_negatives(some, anchor).count() == 0


def test_bounds_hold_and_are_tight():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.standard_normal((500, 16))).astype(np.int64)
    edges = np.stack([np.quantile(c, np.linspace(0, 1, 257)).astype(np.int64) for c in x.T])
    edges[:, 0], edges[:, -1] = x.min(0), x.max(0)
    cells = negatives.cells_of(edges, x)
    at = np.arange(16)
    assert (edges[at, cells] <= x).all() and (x <= edges[at, cells.astype(int) + 1]).all()
    low, high = negatives.score_bounds(edges, x[:40], cells)
    exact = x[:40] @ x.T
    assert (low <= exact).all() and (exact <= high).all() and np.median(high - low) < exact.std() / 2


def test_twin(spark, duck):
    mine, theirs = same_rows(QUERIES["op11_hard_negatives"](spark, "/root/testdata/sf0.001"), duck.sql(ORACLES["op11_hard_negatives"]))
    assert mine == theirs

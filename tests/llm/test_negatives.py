"""op13: exact products, heaps, and mining against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import hard_negatives as hn
from tracewell.llm.strassen import multiply


@pytest.mark.parametrize("shape", [(0, 3, 2), (1, 1, 1), (3, 64, 5), (33, 65, 17), (70, 48, 91)])
def test_products(shape):
    rng = np.random.default_rng(1)
    m, k, n = shape
    for top in (3, 2**28):
        a, b = rng.integers(-top, top, (m, k)), rng.integers(-top, top, (k, n))
        assert (multiply(a, b, leaf=2) == a @ b).all() and multiply(a, b).shape == (m, n)


def test_products_are_right_where_sums_in_between_overflow():
    a = np.array([[2**62, 0], [0, 2**62]])
    b = np.array([[1, 0], [0, -1]])
    assert (multiply(a, b, leaf=1) == np.array([[2**62, 0], [0, -(2**62)]])).all()


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(2)
    rows = [(int(h), int(s), int(i)) for h, s, i in zip(rng.integers(0, 4, 300), rng.integers(-5, 5, 300), rng.integers(0, 40, 300), strict=True)]
    want = {h: sorted({(-s, i) for g, s, i in rows if g == h})[:3] for h in range(4)}
    for size in (1, 7, 300):
        heaps = hn.Heaps(4, 3)
        for i in range(0, len(rows), size):
            heaps.put(*map(np.array, zip(*rows[i : i + size], strict=True)))
        assert {h: [(-int(s), int(i)) for s, i in zip(heaps.score[h], heaps.id[h], strict=True)] for h in range(4)} == want
    assert hn.Heaps(2, 2).rows().num_rows == 0


def brute(rows, anchor, low=80, high=100):
    held = [(i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, label, v in rows
            if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for a, label, v in {(i, lab, tuple(v)) for i, lab, v in held if anchor(i)}:
        scored = {(-sum(x * y for x, y in zip(v, w, strict=True)), i, lab == label) for i, lab, w in held if i != a and len(w) == len(v)}
        for p, pid, _ in sorted(s for s in scored if s[2])[:5]:
            inside = sorted((n, i) for n, i, same in scored if not same and low * -p <= high * -n <= high * -p)[:5]
            out |= {(a, pid, r + 1, i, -p, -n) for r, (n, i) in enumerate(inside)}
    return out


def mined(frame, **bounds):
    got = hn.mine(frame, F.col("id") % 10 == 0, **bounds)
    rows = [tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def test_against_brute_force_in_small_slices_and_parts(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), int(rng.integers(0, 3)), rng.normal(size=6).round(1).tolist()) for i in rng.permutation(160) - 20]
    rows += [(200 + i, 1, [0.5] * 6) for i in range(12)] + [(300, None, [1.0] * 6), (310, 1, None), (320, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (None, 1, [1.0] * 6)]
    rows += [(330, 1, [float("nan")] * 6), (340, 2, [float("inf")] + [0.0] * 5), (350, 0, [1.0, 2.0]), (351, 0, [2.0, 1.0]), (352, 1, [1.0, 1.45]), (360, 1, [0.0] * 6), (370, 5, [9.0] * 6), (380, 1, [])]
    rows += rows[:5]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, label int, embedding array<float>, id int, v int").repartition(5)
    want = brute(rows, lambda i: i % 10 == 0)
    assert mined(frame) == mined(frame, anchor_rows=4, part_rows=16) == want and any(a < 0 for a, *_ in want) and (350, 351) in {r[:2] for r in want}
    assert hn.mine(frame.where("false"), F.col("id") % 10 == 0).count() == 0
    assert hn.mine(frame, F.lit(False)).count() == 0


def test_scores_that_do_not_fit_are_refused(spark):
    frame = spark.createDataFrame([(0, 1, [1e30]), (1, 1, [1.0])], "vec_id int, label int, embedding array<float>")
    with pytest.raises(OverflowError):
        hn.mine(frame, F.col("id") == 0)

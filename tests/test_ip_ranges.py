"""Ranges of addresses as blocks: the blocks cover the range exactly once, and are few."""

import random

from addresskit.plans.requests import prefixes


def test_blocks_cover_each_range_once(spark):
    rng = random.Random(3)
    ranges = [(0, 2 ** 32 - 1), (0, 0), (2 ** 32 - 1, 2 ** 32 - 1), (1, 2 ** 32 - 2), (2 ** 31, 2 ** 32 - 1), (5, 6), (4, 7)]
    for _ in range(60):
        a = rng.randrange(2 ** 32)
        ranges.append((a, min(2 ** 32 - 1, a + rng.randrange(2 ** rng.randint(1, 32)))))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ranges)], "id long, base long, last long")
    blocks = {}
    for r in prefixes(df).collect():
        blocks.setdefault(r.id, []).append((r.block << r.bits, (r.block + 1) << r.bits, r.bits))
    for i, (base, last) in enumerate(ranges):
        got = sorted(blocks[i])
        assert got[0][0] == base and got[-1][1] == last + 1 and len(got) <= 64
        assert all(x[1] == y[0] for x, y in zip(got, got[1:]))
        assert max(sum(1 for x in got if x[2] == bits) for bits in {x[2] for x in got}) <= 2
    assert blocks[0] == [(0, 2 ** 32, 32)]

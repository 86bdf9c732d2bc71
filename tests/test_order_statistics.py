"""Cuts of several columns at once, and bits of codes packed for a block at once."""

import numpy as np

from vectorgrove.functions import codecs
from vectorgrove.operators import aggregates, clustering


def test_order_statistics_are_quantile_cuts(spark):
    r = np.random.default_rng(2)
    rows = [(float(a), float(b), 0.0, float(-0.0 if i % 2 else 0.0)) for i, (a, b) in enumerate(zip(r.normal(size=333), r.integers(-3, 3, 333) / 7, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(3)
    bins = {"a": 64, "b": 8, "c": 4, "d": 1}
    got = clustering.order_statistics(df, bins)
    assert got == {c: aggregates.quantile_cuts(df, df[c], n) for c, n in bins.items()}
    assert clustering.order_statistics(df.limit(0), bins) == dict.fromkeys(bins, [])


def test_blocks_of_codes_are_packed_bit_by_bit():
    r = np.random.default_rng(4)
    for bits in (np.array([6, 1, 12, 31]), np.full(5, 8), np.array([3])):
        top = 2 ** (bits - 1) - 1
        code = r.integers(-top, top + 1, (4, len(bits)))
        packed = codecs.pack_block(code, bits)
        for row, p in zip(code, packed, strict=True):
            value = "".join(format(int(c) + (1 << int(b) - 1), f"0{b}b")[::-1] for c, b in zip(row, bits, strict=True))
            assert p == bytes(int(value[i : i + 8][::-1], 2) for i in range(0, len(value), 8))
        assert (codecs.unpack_block(packed, bits) == code).all()

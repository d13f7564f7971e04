"""Interval algebra against plain integers."""

import random

import pytest
from pyspark.sql import functions as F

from prefixloom.functions import cidr
from prefixloom.operators import ranges


def merged(rows):
    out = []
    for a, b in sorted(rows):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def greedy(lo, end, bits):
    out = []
    while lo < end:
        size = lo & -lo or 1 << bits
        while size > end - lo:
            size >>= 1
        out.append((lo, bits - size.bit_length() + 1))
        lo += size
    return out


def labelled(a, b):
    points = sorted({x for r in (*a, *b) for x in r})
    out = {"onlyA": [], "onlyB": [], "common": []}
    for p, q in zip(points, points[1:], strict=False):
        ina, inb = any(x <= p < y for x, y in a), any(x <= p < y for x, y in b)
        if ina or inb:
            out["common" if ina and inb else "onlyA" if ina else "onlyB"].append((p, q))
    return {k: merged(v) for k, v in out.items()}


def blocks(rng, n, bits=32, low=20):
    out = []
    for _ in range(n):
        pfx = rng.choice([0, 4, 8, 11, 12, 13, 16, 20, 24, 28, 32]) if rng.random() < 0.05 else rng.randint(low, bits)
        size = 1 << (bits - pfx)
        out.append((rng.randrange(1 << bits) // size * size if rng.random() < 0.3 else (1 << 28) + rng.randrange(1 << 22) // size * size, pfx))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_v4_merge_sweep_and_emission(spark, seed):
    rng = random.Random(seed)
    rows = [(c, s, lo, lo + (1 << (32 - p))) for c in "xy" for s in (0, 1) for lo, p in blocks(rng, 150, low=21 if seed else 9)]
    rows += [("z", 0, 0, 1 << 32), ("z", 1, 5, 6), ("w", 0, 7, 8), ("w", 0, 8, 9), ("w", 1, (1 << 20) - 1, 1 << 20), ("w", 1, 1 << 20, (1 << 20) + 1)]
    df = spark.createDataFrame(rows, "cat string, side int, lo long, end long")
    got = ranges.merge_ranges(df.drop("side"), ["cat"])
    for c in "xyzw":
        assert sorted((r["lo"], r["end"]) for r in got.collect() if r["cat"] == c) == merged([r[2:] for r in rows if r[0] == c])
    emitted = ranges.emit4(got, ["cat"]).collect()
    counts = {r["cat"]: r["n"] for r in got.groupBy("cat").agg(F.sum(cidr.block_count(F.col("lo"), F.col("end"))).alias("n")).collect()}
    swept = ranges.sweep(df.filter("side = 0"), df.filter("side = 1"), ["cat"]).collect()
    for c in "xyzw":
        want = [b for a, z in merged([r[2:] for r in rows if r[0] == c]) for b in greedy(a, z, 32)]
        assert sorted((r["num"], r["pfx"]) for r in emitted if r["cat"] == c) == sorted(want) and counts[c] == len(want)
        sides = labelled(*(merged([r[2:] for r in rows if r[0] == c and r[1] == s]) for s in (0, 1)))
        for side, spans in sides.items():
            assert sorted((r["lo"], r["end"]) for r in swept if r["cat"] == c and r["side"] == side) == spans, (c, side)


def test_v6(spark):
    rng = random.Random(9)
    rows = [(s, lo.to_bytes(16, "big"), p) for s in (0, 1) for lo, p in blocks(rng, 120, 128, 118)] + [(0, b"\xff" * 16, 128), (1, bytes(16), 0)]
    df = spark.createDataFrame(rows, "side int, ip binary, pfx short").withColumns({"cat": F.lit("c"), "fam": F.lit(6)})
    span = lambda ip, p: (n := int.from_bytes(ip, "big") >> (128 - p) << (128 - p), n + (1 << (128 - p)))
    num = lambda b: int.from_bytes(b, "big")
    for side in (0, 1):
        part = ranges.merge_ranges(ranges.ranges6(df.filter(F.col("side") == side), ["cat"]), ["cat"], v4=False)
        want = merged([span(ip, p) for s, ip, p in rows if s == side])
        assert sorted((num(r["lo"]), num(r["end"])) for r in part.collect()) == want
        got = sorted((num(r["ip"]), r["pfx"]) for r in ranges.emit6(part, ["cat"]).collect())
        assert got == sorted(b for a, z in want for b in greedy(a, z, 128))
    a, b = (ranges.ranges6(df.filter(F.col("side") == s), ["cat"]) for s in (0, 1))
    sides = labelled(*(merged([span(ip, p) for s, ip, p in rows if s == side]) for side in (0, 1)))
    for r in (swept := ranges.sweep(a, b, ["cat"], v4=False).collect()):
        assert (num(r["lo"]), num(r["end"])) in sides[r["side"]]
    assert len(swept) == sum(map(len, sides.values()))


@pytest.mark.parametrize("bits", [1, 2, 3, 6])
def test_closed_form_is_greedy(bits):
    for lo in range(1 << bits):
        for end in range(lo, (1 << bits) + 1):
            assert cidr.cover(lo, end, bits) == greedy(lo, end, bits)


def test_identities_and_idempotence(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([("c", s, lo, lo + (1 << (32 - p))) for s in (0, 1) for lo, p in blocks(rng, 80)], "cat string, side int, lo long, end long")
    a, b = df.filter("side = 0").drop("side"), df.filter("side = 1").drop("side")
    back = ranges.merge_ranges(ranges.subtract(a, b, ["cat"]).unionByName(ranges.intersect(a, b, ["cat"])), ["cat"])
    rows = lambda d: sorted(map(tuple, d.collect()))
    once = ranges.merge_ranges(a, ["cat"])
    assert rows(back) == rows(once) == rows(ranges.merge_ranges(once, ["cat"]))
    assert ranges.subtract(a, a, ["cat"]).isEmpty()

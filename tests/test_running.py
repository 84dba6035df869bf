import random

import pytest
from framebasin.operators import motion as mo
from framebasin.operators.running import Ordered, group_rank, prefix_offsets
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    data = [("hot", i, rng.randrange(5)) for i in range(900)] + [(f"g{i % 7}", i, rng.randrange(5)) for i in range(100)]
    rng.shuffle(data)
    return data


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, i long, v long").repartition(5)


def expected(rows):
    out, groups = {}, {}
    for g, i, v in sorted(rows):
        seen = groups.setdefault(g, [])
        out[(g, i)] = (len(seen), sum(seen) + v, seen[-1] if seen else None)
        seen.append(v)
    return out


@pytest.mark.parametrize("limit", [50, 10_000])
def test_rank_sum_lag_do_not_depend_on_splitting(spark, rows, limit):
    o = Ordered(frame(spark, rows), ["g"], ["i"], hot_rows=limit)
    assert o.split == (limit == 50)
    o.lag({"prev": F.col("v")}).running_sum({"total": F.col("v")}).rank("r").group_size("n")
    got = {(r["g"], r["i"]): (r["r"], r["total"], r["prev"]) for r in o.result().collect()}
    assert got == expected(rows)
    sizes = {(r["g"], r["n"]) for r in o.result().collect()}
    assert ("hot", 900) in sizes


def test_hot_group_is_spread(spark, rows):
    o = Ordered(frame(spark, rows), ["g"], ["i"], hot_rows=50)
    largest = o.df.groupBy("g", "__seg").count().agg(F.max("count")).first()[0]
    assert largest < 300


def test_whole_table_rank_splits(spark, rows):
    df = frame(spark, rows)
    # ties on v are broken by the rest of the order
    got = group_rank(df, [], [-F.col("v"), "g", "i"], "r", hot_rows=100).collect()
    want = sorted(rows, key=lambda t: (-t[2], t[0], t[1]))
    assert [(r["g"], r["i"], r["v"]) for r in sorted(got, key=lambda r: r["r"])] == want


def test_prefix_offsets_cross_blocks(spark):
    df = spark.range(1000).select(F.col("id").alias("o"), (F.col("id") % 3).alias("n"))
    got = {r["o"]: r["b"] for r in prefix_offsets(df, "o", "n", "b", block=16).collect()}
    total = 0
    for i in range(1000):
        assert got[i] == total
        total += i % 3


def test_unwrap_ignores_wrapping_and_splitting(spark):
    rng = random.Random(1)
    rows = []
    for atom in range(3):
        x = [0.5, 0.5, 0.5]
        for t in range(200 if atom == 0 else 30):
            x = [c + rng.uniform(-0.4, 0.4) for c in x]
            rows.append((atom, t, *x, *[c % 1.0 for c in x]))
    df = spark.createDataFrame(rows, "atom_idx int, frame_idx int, rx double, ry double, rz double, fx double, fy double, fz double")
    for limit in (40, None):
        got = mo.unwrap(df, by=["atom_idx"], hot_rows=limit).collect()
        origin = {r["atom_idx"]: (r["rx"], r["ry"], r["rz"]) for r in got if r["step"] == 0}
        for r in got:
            o = origin[r["atom_idx"]]
            for k, c in enumerate("xyz"):
                assert abs(r[f"u_f{c}"] - (r[f"r{c}"] - o[k])) < 1e-9

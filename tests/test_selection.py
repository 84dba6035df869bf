import numpy as np
import pytest
from framebasin.operators import descriptors as ds
from framebasin.operators import sampling as sp
from framebasin.operators import structures as st
from framebasin.operators.metrics import histogram, parity
from helpers import frame, frames_df
from pyspark.sql import functions as F


def index(spark, n):
    return spark.range(n).select(F.col("id").alias("frame_idx"), (F.col("id") % 7 / 10.0).alias("uncertainty"), (F.col("id") % 3).alias("source"))


@pytest.mark.parametrize("k,n,skip", [(1, 9, 0), (5, 17, 0), (5, 17, 3), (12, 9, 0), (100, 1000, 0)])
def test_uniform_is_truncated_linspace(spark, k, n, skip):
    got = sorted(r["frame_idx"] for r in sp.sample_uniform(index(spark, n), k, skip).collect())
    assert got == sorted((np.linspace(0, n - skip - 1, k, dtype=int) + skip).tolist())


def test_top_n_breaks_ties_by_order_and_by_any_route(spark, monkeypatch):
    df = index(spark, 100)
    rows = [(i % 7 / 10.0, i, i % 3) for i in range(100)]
    want = {(s, i) for s in range(3) for _, i in sorted((-u, i) for u, i, g in rows if g == s)[:4]}
    assert {(r["source"], r["frame_idx"]) for r in sp.top_n(df, "uncertainty", 4, per=["source"]).collect()} == want
    monkeypatch.setattr(sp, "_GROUP_LIMIT", 0)
    monkeypatch.setattr(sp, "_TAKE_LIMIT", 0)
    assert {(r["source"], r["frame_idx"]) for r in sp.top_n(df, "uncertainty", 4, per=["source"]).collect()} == want
    every = [i for _, i in sorted((-u, i) for u, i, _ in rows)[:9]]
    assert sorted(r["frame_idx"] for r in sp.top_n(df, "uncertainty", 9).collect()) == sorted(every)


@pytest.mark.parametrize("method", ["uniform", "random"])
def test_split_is_exact_and_disjoint(spark, method):
    df = index(spark, 101)
    train, test = sp.split_test(df, 0.1, method, seed=3)
    a, b = ({r["frame_idx"] for r in d.collect()} for d in (train, test))
    assert not a & b and len(a | b) == 101 and len(b) == 10
    again = {r["frame_idx"] for r in sp.split_test(df.repartition(3), 0.1, method, seed=3)[1].collect()}
    assert again == b


def test_split_sizes(spark):
    parts = sp.split(index(spark, 25), 0.5, seed=1).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"train": 12, "test": 13}
    assert sp.test_count(0.01, 10) == 1
    for bad in (0, 10, 1.5):
        with pytest.raises(ValueError):
            sp.test_count(bad, 10)


def test_errors_of_pickers(spark):
    with pytest.raises(ValueError, match="out of range"):
        sp.pick_many(index(spark, 5), [1, 9])
    with pytest.raises(ValueError, match="available"):
        sp.sample_random(index(spark, 5), 6, seed=0)


def naive_fps(new, ref, count=None, min_distance=None):
    d = np.full(len(new), np.inf)
    picks = []
    if len(ref):
        d = np.min([np.sqrt(((new - r) ** 2).sum(1)) for r in ref], axis=0)
    else:
        picks = [0]
        d = np.minimum(d, np.sqrt(((new - new[0]) ** 2).sum(1)))
        d[0] = -1
    while (count is None or len(picks) < count) and d.max() >= 0:
        if min_distance is not None and not d.max() > min_distance and len(picks) >= 1:
            break
        i = int(d.argmax())
        picks.append(i)
        d = np.where(d < 0, d, np.minimum(d, np.sqrt(((new - new[i]) ** 2).sum(1))))
        d[i] = -1
    return picks


def vectors(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, vec array<double>").repartition(4)


@pytest.mark.parametrize("pool", [3, 16, 512])
@pytest.mark.parametrize("with_ref", [False, True])
def test_farthest_points_match_the_plain_loop(spark, pool, with_ref):
    rng = np.random.default_rng(pool)
    new = rng.integers(0, 6, (60, 2)).astype(float)  # many ties and repeats
    ref = rng.integers(0, 6, (3, 2)).astype(float) if with_ref else np.zeros((0, 2))
    kw = {"reference": vectors(spark, ref)} if with_ref else {}
    got = ds.farthest_points(vectors(spark, new), "vec", ["id"], count=12, pool=pool, **kw).orderBy("step").collect()
    assert [r["id"] for r in got] == naive_fps(new, ref, 12)
    if pool == 16:
        far = ds.farthest_points(vectors(spark, new), "vec", ["id"], min_distance=1.5, pool=pool, **kw).orderBy("step").collect()
        assert [r["id"] for r in far] == naive_fps(new, ref, None, 1.5)
        every = ds.farthest_points(vectors(spark, new), "vec", ["id"], count=99, pool=pool, **kw)
        assert sorted(r["id"] for r in every.collect()) == list(range(60))


def test_nearest_reference_by_groups_is_exact(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(200, 5)), np.concatenate([rng.normal(size=(150, 5)), np.tile(rng.normal(size=5), (150, 1))])
    want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)).min(1)
    for kw in ({}, {"broadcast_bytes": 1, "pivots": 8}):
        got = {r["id"]: r["dmin"] for r in ds.nearest_reference(vectors(spark, a), vectors(spark, b), ["id"], **kw).collect()}
        assert len(got) == 200 and all(abs(got[i] - want[i]) < 1e-9 for i in range(200))


def test_visits_of_many_blocks_leave_in_small_pieces():
    import pandas as pd

    rng = np.random.default_rng(4)
    piv, vec = rng.normal(size=(8, 5)), rng.normal(size=(3000, 5))
    limits = (np.zeros(8), np.full(8, 100.0), np.full(8, 1000))  # every sample visits every group of 1,000 blocks
    got = list(ds._visits(iter([pd.DataFrame({"id": range(3000), "vec": list(vec)})]), ["id"], piv, limits))
    assert max(len(g) for g in got) <= ds._VISITS and sum(len(g) for g in got) == 3000 * 8
    assert {(r.id, r.cell) for g in got for r in g.itertuples()} == {(i, c) for i in range(3000) for c in range(8)}


def test_pca_matches_svd(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(80, 4)) * [5, 2, 1, 0.1] + 3
    out, ratio = ds.pca(vectors(spark, m), 2)
    got = np.array([r["pc"] for r in out.orderBy("id").collect()])
    c = m - m.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    want = c @ vt[:2].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-9)
    assert np.allclose(ratio, (s**2 / (s**2).sum())[:2])


def test_principal_axes_of_close_variances(spark):
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    m = (rng.normal(size=(400, 40)) * np.linspace(2.0, 1.0, 40)) @ turn + 5
    want, turned = np.linalg.eigh(np.cov(m.T))
    v = vectors(spark, m).select(F.col("vec").alias("v")).repartition(5)
    axes, values, total, mean = ds.principal_components(v, 3)
    assert np.allclose(values, want[::-1][:3], rtol=1e-9) and np.isclose(total, want.sum()) and np.allclose(mean, m.mean(0))
    assert np.allclose(np.abs((axes * turned[:, ::-1][:, :3]).sum(0)), 1, atol=1e-9)
    wide = rng.normal(size=(300, 150))
    want = np.linalg.eigvalsh(np.cov(wide.T))[::-1]
    _, values, _, _ = ds.principal_components(vectors(spark, wide).select(F.col("vec").alias("v")), 2)
    assert np.allclose(values, want[:2], rtol=1e-9)
    flat = vectors(spark, np.tile([1.0, 2.0, 3.0], (7, 1)))
    out, ratio = ds.pca(flat, 2)
    assert ratio == [0.0, 0.0] and all(np.allclose(r["pc"], 0) for r in out.collect())


def test_coreset_is_the_same_for_any_partitioning(spark):
    rng = np.random.default_rng(2)
    m = np.round(rng.normal(size=(300, 3)), 1)
    v = vectors(spark, m)

    def picks(df, **kw):
        return [r["id"] for r in ds.coreset_points(df, "vec", ["id"], count=20, **kw).orderBy("step").collect()]

    assert picks(v) == naive_fps(m, np.zeros((0, 3)), 20)  # one part: exact
    parted = picks(v, per_part=60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert picks(v.repartition(9), per_part=60) == parted
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    union = []
    for p in range(4):
        mine = [i for i in range(300) if i % 4 == p]
        union += [mine[j] for j in naive_fps(m[mine], np.zeros((0, 3)), 20)]
    union.sort()
    want = [union[j] for j in naive_fps(m[union], np.zeros((0, 3)), 20)]
    assert picks(v, part=F.col("id") % 4) == want

    def radius(ids):
        return np.sqrt(((m[:, None] - m[ids][None]) ** 2).sum(-1)).min(1).max()

    assert radius(parted) <= 4 * radius(naive_fps(m, np.zeros((0, 3)), 20))


def test_windows_of_a_table_of_splits(spark):
    from framebasin.operators import levels as lv

    rng = np.random.default_rng(6)
    points = [(int(i), int(rng.integers(3)) or None, float(rng.integers(8))) for i in range(200)]
    splits = [(int(rng.integers(3)) or None, float(rng.integers(16)) / 2) for _ in range(20)]
    b = spark.createDataFrame(points, "id long, g long, k double").repartition(3)
    s = spark.createDataFrame(splits, "g long, split double")
    for kw in ({}, {"hot_rows": 10}):
        got = sorted((r.id, r.window) for r in lv.segment_table(b, s, by=["g"], **kw).collect())
        want = []
        for i, g, x in points:
            mine = [v for h, v in splits if h == g]
            want += [(i, w) for w in range(sum(v < x for v in mine), sum(v <= x for v in mine) + 1)]
        assert got == sorted(want)
        one = sorted((r.id, r.window) for r in lv.segment_table(b, s, by=["g"], both=False, **kw).collect())
        assert one == sorted((i, sum(v < x for h, v in splits if h == g)) for i, g, x in points)


def test_shift_pairs_of_a_crowded_gap(spark, monkeypatch):
    from framebasin.operators import levels as lv

    rng = np.random.default_rng(8)
    rows = [(f"s{i}", i, float(v), float(v + g)) for i, (v, g) in enumerate(zip(rng.uniform(-6, -4, 150), rng.choice([1.0, 1.01, 1.5], 150), strict=True))]
    want = {
        (a[0], b[0]) for a in rows for b in rows
        if a[1] < b[1] and abs(b[2] - a[2]) > 0.3 and abs((b[2] - a[2]) - (b[3] - a[3])) < 0.02 and abs((b[3] - b[2]) - (a[3] - a[2])) < 0.02
    }
    df = spark.createDataFrame(rows, "system string, ord int, vbm double, cbm double")
    for size in (7, 5000):
        monkeypatch.setattr(lv, "_BIN_ROWS", size)
        got = [(r.a, r.b) for r in lv.rigid_shift(df).collect()]
        assert len(got) == len(want) and set(got) == want


def test_shift_pairs_of_one_gap_are_spread_over_tasks(spark, monkeypatch):
    from framebasin.operators import levels as lv

    monkeypatch.setattr(lv, "_BIN_ROWS", 50)
    rows = [(f"s{i}", i, float(i), i + 1.0) for i in range(600)]
    out = lv.rigid_shift(spark.createDataFrame(rows, "system string, ord int, vbm double, cbm double"))
    made = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 600 * 599 // 2 and max(made) < sum(made) / 8


def test_factors_keep_small_targets_and_shape(spark):
    rows = [frame(0, 0, ["Mo"] * 4, np.zeros((4, 3)), np.diag([3.0, 6.0, 12.0])), frame(0, 1, ["Mo"] * 50, np.zeros((50, 3)), np.eye(3))]
    got = {r["frame_idx"]: (r["fa"], r["fb"], r["fc"]) for r in st.factors_for_target(frames_df(spark, rows), 32).collect()}
    assert got == {0: (4, 2, 1), 1: (1, 1, 1)}


def test_decoration_reports_why(spark):
    flat = [[0, 0, 0], [5, 0, 0], [0, 5, 0], [5, 5, 0]]
    rows = [
        frame(0, 0, ["Mo"] * 4, flat, np.eye(3) * 10),
        frame(0, 1, ["Mo"] * 3 + ["Al"], flat, np.eye(3) * 10),
        frame(0, 2, ["Te"] * 4, flat, np.eye(3) * 10),
        frame(0, 3, ["Mo"] * 4, [[0, 0, 0], [5, 0.5, 0], [0, 5, 0], [5, 5, 0]], np.eye(3) * 10),
        frame(0, 4, ["Mo"] * 3, flat[:3], np.eye(3) * 10),
        frame(0, 5, ["Mo"] * 4, [[0, 0, 0], [5, 0, 9], [0, 5, 9], [5, 5, 0]], np.eye(3) * 10),
    ]
    out = st.decorate(frames_df(spark, rows), "Al", "Mo", 2.0, "checker", 0.5, n=2)
    got = {r["frame_idx"]: (r["status"], r["added"], r["natoms"]) for r in out.collect()}
    assert got == {
        0: ("ok", 2, 6), 1: ("skip", 0, 4), 2: ("no_substrate", 0, 4), 3: ("off_grid", 0, 4), 4: ("not_square", 0, 3), 5: ("too_low", 0, 4),
    }


@pytest.mark.parametrize("style", ["normal", "uniform", "const"])
def test_perturbed_copies_are_reproducible_and_bounded(spark, style):
    rng = np.random.default_rng(3)
    df = frames_df(spark, [frame(0, i, ["Mo"] * 6, rng.uniform(0, 9, (6, 3)), np.eye(3) * 9) for i in range(4)])
    one = st.perturb(df, 3, 0.05, 0.2, style, seed=4).orderBy("frame_idx", "copy").collect()
    two = st.perturb(df.repartition(3), 3, 0.05, 0.2, style, seed=4).orderBy("frame_idx", "copy").collect()
    assert one == two and len(one) == 12
    assert all(abs(v - w) <= 0.05 * 9 + 1e-12 for r in one for v, w in zip(r["lattice"], (np.eye(3) * 9).reshape(-1)))
    assert len({tuple(r["lattice"]) for r in one}) == 12


def test_parity_without_variance(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "pred double, true double")
    assert parity(df).first()["r2"] is None
    assert parity(df, zero_variance="one").first()["r2"] == 1.0


def test_histogram_closes_the_last_bin(spark):
    v = [0.0, 0.1, 0.5, 0.9, 1.0]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    got = [r["n"] for r in histogram(df, "v", 4).orderBy("bin").collect()]
    assert got == np.histogram(v, 4)[0].tolist()


def test_ledger_states(spark):
    ledger = spark.createDataFrame([(1, "p1", "new", "present"), (2, "p2", "new", "present")], "frame_idx long, path string, event string, status string")
    now = sp.refresh_ledger(ledger, spark.createDataFrame([("p1",)], "path string"))
    assert {r["frame_idx"]: (r["event"], r["status"]) for r in now.collect()} == {1: ("new", "present"), 2: ("removed", "lost")}
    got = {r["frame_idx"]: r["event"] for r in sp.new_frames(index(spark, 4), now).collect()}
    assert got == {0: "new", 2: "rebuilt", 3: "new"}

import numpy as np
import pytest
from framebasin.operators import filters as fl
from framebasin.operators import kernel
from framebasin.operators import pairs as pr
from framebasin.sources.frames import atoms_view
from helpers import all_pairs, frame, frames_df, random_frames

SKEWED = [[9.0, 0, 0], [2.5, 8.0, 0], [-1.0, 1.5, 7.0]]
CELLS = [(None, (True, True, True)), (SKEWED, (True, True, True)), (SKEWED, (True, False, True)), (np.zeros((3, 3)), (True,) * 3), (SKEWED, (False,) * 3)]


@pytest.mark.parametrize("lattice,pbc", CELLS)
@pytest.mark.parametrize("small", [0, 1000])
def test_close_pairs_match_brute_force(spark, lattice, pbc, small):
    rows = random_frames(3, 4, 30, lattice, pbc)
    cutoff = 2.0
    got = {
        (r["frame_idx"], r["i"], r["j"]): r["d"]
        for r in pr.close_pairs(atoms_view(frames_df(spark, rows)), cutoff, small=small).collect()
    }
    want = {(row[1], i, j): d for row in rows for i, j, _, _, d in all_pairs(row) if d <= cutoff}
    assert got.keys() == want.keys() and want
    for k, d in want.items():
        assert abs(got[k] - d) < 1e-9


@pytest.mark.parametrize("small", [0, 1000])
def test_shortest_distance_with_first_frame_on_ties(spark, small):
    rows = random_frames(5, 3, 40, SKEWED)
    rows += [(0, 10 + r[1], *r[2:]) for r in rows]  # later copies must not win
    got = {(r["sa"], r["sb"]): (r["d"], r["frame_idx"]) for r in pr.pair_min_distance(atoms_view(frames_df(spark, rows)), small=small).collect()}
    z = {"Li": 3, "Mo": 42, "Te": 52}
    want = {}
    for row in rows:
        for _, _, a, b, d in all_pairs(row):
            k = tuple(sorted((a, b), key=z.get))
            if k not in want or d < want[k][0] - 1e-12:
                want[k] = (d, row[1])
    assert got.keys() == want.keys()
    for k in want:
        assert abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1]


def test_mixed_small_and_large_frames(spark):
    rows = random_frames(6, 3, 5, SKEWED) + [(0, 10 + r[1], *r[2:]) for r in random_frames(7, 2, 60, SKEWED)]
    at = atoms_view(frames_df(spark, rows))
    mixed = {(r["sa"], r["sb"]): round(r["d"], 9) for r in pr.pair_min_distance(at, small=20).collect()}
    plain = {(r["sa"], r["sb"]): round(r["d"], 9) for r in pr.pair_min_distance(at, small=1000).collect()}
    assert mixed == plain


@pytest.mark.parametrize("kw", [{"small": 1000}, {"small": 0, "tile": 16}, {"small": 0, "rmax": 100.0}])
def test_histogram_is_the_same_by_join_tiles_and_grid(spark, kw):
    rows = random_frames(8, 3, 50, SKEWED)
    dr = 0.25
    got = {(r["sa"], r["sb"], r["bin"]): r["n"] for r in pr.distance_histogram(atoms_view(frames_df(spark, rows)), dr, **kw).collect()}
    z = {"Li": 3, "Mo": 42, "Te": 52}
    want = {}
    for row in rows:
        for _, _, a, b, d in all_pairs(row):
            k = (*sorted((a, b), key=z.get), int(d // dr))
            want[k] = want.get(k, 0) + 1
    assert got == want


def test_rdf_edges(spark):
    # distances 1.0, 2.0 and 3.0 with dr = 0.5: the last bin is closed at 3.0
    rows = [frame(0, 0, ["Mo", "Te", "Te", "Te"], [[0, 0, 0], [1, 0, 0], [2, 0, 0], [3, 0, 0]])]
    g = pr.rdf_all(atoms_view(frames_df(spark, rows)), 0.5, volume=100.0).orderBy("bin").collect()
    assert [r["bin"] for r in g] == [0, 1, 2, 3, 4, 5]
    assert [r["n"] for r in g] == [0, 0, 1, 0, 1, 1]
    r = 1.5
    assert abs(g[2]["g"] - 1 / (4 * np.pi * r * r * 0.5 * (3 / 1 / 100.0) * 1)) < 1e-12


@pytest.mark.parametrize("lattice,pbc", CELLS)
def test_cell_list_finds_all_pairs(monkeypatch, lattice, pbc):
    import pyarrow as pa

    monkeypatch.setattr(kernel, "_DENSE", 1)
    monkeypatch.setattr(kernel, "_MOST", 50)
    rows = random_frames(13, 5, (1, 70), lattice, pbc)
    atoms = [[{"species": a[1], "x": a[2], "y": a[3], "z": a[4]} for a in r[5]] for r in rows]
    batch = pa.RecordBatch.from_pydict({"rows": atoms, "lattice": pa.array([r[3] for r in rows], pa.list_(pa.float64())), "pbc": [r[4] for r in rows]}).slice(1)
    fr = kernel.unpack(batch)
    for cutoff in (0.7, 2.5, 30.0, None):
        got = {}
        for f, a, b, d in kernel.pairs(fr, cutoff):
            for k, x, y, v in zip(f.tolist(), (a - fr.start[f]).tolist(), (b - fr.start[f]).tolist(), d.tolist()):
                assert (k, min(x, y), max(x, y)) not in got
                got[k, min(x, y), max(x, y)] = v
        want = {(k, i, j): d for k, r in enumerate(rows[1:]) for i, j, _, _, d in all_pairs(r) if cutoff is None or d <= cutoff}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_rdf_of_a_pair_counts_all_frames(spark):
    rows = random_frames(14, 6, 12, SKEWED) + [(0, 20 + r[1], *r[2:]) for r in random_frames(15, 4, 5, np.eye(3) * 6, species=["Te"])]
    rows += [(0, 40 + r[1], *r[2:]) for r in random_frames(16, 2, 9, SKEWED, species=["Te", "Mo"])]
    at = atoms_view(frames_df(spark, rows))
    everything = {(r["sa"], r["sb"], r["bin"]): (r["n"], r["g"]) for r in pr.rdf_all(at, 0.5).collect()}
    for a, b in (("Mo", "Li"), ("Te", "Mo")):
        for small in (4096, 0):
            got = {(r["sa"], r["sb"], r["bin"]): (r["n"], r["g"]) for r in pr.rdf(at, a, b, 0.5, small=small).collect()}
            want = {k: v for k, v in everything.items() if {k[0], k[1]} == {a, b}}
            assert got.keys() == want.keys() and want
            assert all(got[k][0] == v[0] and abs(got[k][1] - v[1]) < 1e-9 for k, v in want.items())
    some = {(r["bin"]): r["n"] for r in pr.rdf(at, "Mo", "Te", 0.5, frames=(40, 50)).collect()}
    pairs = [d for r in rows if r[1] >= 40 for *_, p, q, d in all_pairs(r) if p != q]
    last = int(max(pairs) / 0.5)
    assert sum(some.values()) == sum(d < last * 0.5 for d in pairs)


@pytest.mark.parametrize("in_row", [200, 0])
def test_min_distance_filter(spark, monkeypatch, in_row):
    monkeypatch.setattr(fl, "_IN_ROW", in_row)
    rows = random_frames(9, 12, (2, 9), SKEWED)
    rows += [
        frame(0, 100, ["Mo", "Te"], [[0, 0, 0], [0, 0, 1.5]], np.eye(3) * 20),  # exactly at the limit
        frame(0, 101, ["Mo", "Te"], [[0, 0, 0], [0, 0, 0.1]]),  # no cell: kept
        frame(0, 102, ["Mo"], [[0, 0, 0]], np.eye(3) * 20),  # one atom
        frame(0, 103, ["Mo", "Te"], [[0.1, 0, 0], [19.9, 0, 0]], np.eye(3) * 20),  # close through the boundary
    ]
    got = {r["frame_idx"] for r in fl.filter_min_distance(frames_df(spark, rows), 1.5).collect()}
    want = {r[1] for r in rows if r[3] is None or min((p[4] for p in all_pairs(r)), default=9e9) >= 1.5 - 1e-9}
    assert got == want and {100, 101, 102} <= got and 103 not in got


def test_bonds_and_angles(spark):
    # a water-like triangle: one centre with two neighbours at a right angle
    rows = [frame(0, 0, ["O", "H", "H"], [[0, 0, 0], [1, 0, 0], [0, 1, 0]], np.eye(3) * 10)]
    got = {r["kind"]: r for r in pr.bond_angle_stats(atoms_view(frames_df(spark, rows)), "H", "O", 1.2).collect()}
    assert got["H-O"]["n"] == 2 and abs(got["H-O"]["mean"] - 1) < 1e-12
    assert got["H-O-H"]["n"] == 1 and abs(got["H-O-H"]["mean"] - 90) < 1e-9 and got["H-O-H"]["std"] == 0.0
    assert got["O-H-O"]["n"] == 0 and got["O-H-O"]["mean"] is None


def test_atoms_on_one_spot_are_at_distance_zero(spark):
    rows = random_frames(11, 2, 40, SKEWED)
    spot = [[1.0, 1.0, 1.0]] * 50
    rows.append(frame(0, 5, ["Te"] * 50, spot, SKEWED))
    at = atoms_view(frames_df(spark, rows))
    for small in (0, 1000):
        got = {(r["sa"], r["sb"]): (r["d"], r["frame_idx"]) for r in pr.pair_min_distance(at, small=small).collect()}
        assert got[("Te", "Te")] == (0.0, 5) and got[("Mo", "Mo")][0] > 0
    assert {r["frame_idx"]: r["dmin"] for r in pr.too_close(at, 1e-3, small=0).collect()}[5] == 0.0

"""Labelled frames out of logs, over splits smaller than a section."""

import numpy as np
import pytest
from framebasin.sources import results as rs
from framebasin.sources import sections as sc
from framebasin.sources.lines import scan_lines
from pyspark.sql import functions as F


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_sections_reach_over_splits(spark, tmp_path, small_splits):
    text = [f"#{'ab'[k // 40 % 2]}" if k % 40 == 7 else f"row {k} {'x' * 30}" for k in range(300)]
    (tmp_path / "s.txt").write_text("\n".join(text))
    line = F.col("line")
    openers = {"a": line == "#a", "b": line == "#b"}
    got = sc.with_sections(scan_lines(spark, str(tmp_path / "s.txt")), openers, F.lit(True), {"n": line.startswith("#")})
    rows = {r["line_no"]: r for r in got.collect()}
    assert sorted(rows) == list(range(300)) and len({r["blk"] for r in rows.values()}) > 5
    kind, opened, seen = None, None, 0
    for k in range(300):
        if text[k].startswith("#"):
            kind, opened, seen = text[k][1], k, seen + 1
        r = rows[k]
        assert (r["section"], r["opened"], r["n"]) == (kind, opened, seen)
        assert r["at"] == (None if opened is None else k - opened)


SPECIES, COUNTS = ("Mo", "Te", "Li"), (2, 3, 1)


def outcar(seed, steps, marks=1, spoil=None, cells=True):
    """Text of a log and its frames: (lattice, positions, forces, energy, kbar)."""
    rng = np.random.default_rng(seed)
    out = [f"   TITEL  = PAW_PBE {s}_sv 02Feb2006" for s in SPECIES]
    out += ["   ions per type =  " + "  ".join(map(str, COUNTS))]
    frames, lattice = [], None
    for k in range(steps):
        for _ in range(3):
            out += ["----- Iteration", f"  free energy    TOTEN  =   {rng.uniform(-9, 0):.8f} eV", "   7.0  1.0 2.0 3.0 4.0 5.0"]
        if k < marks:
            out += ["------ aborting loop because EDIFF is reached ------"]
        kbar = rng.uniform(-50, 50, 6).round(5)
        out += ["  in kB  " + " ".join(f"{x:.5f}" for x in kbar)]
        if cells or k == 0:
            lattice = (np.eye(3) * 8 + rng.uniform(0, 1, (3, 3))).round(6)
            out += ["      direct lattice vectors                 reciprocal lattice vectors"]
            out += ["  " + "  ".join(f"{x:.6f}" for x in [*row, 0.1, 0.2, 0.3]) for row in lattice]
        pos, frc = rng.uniform(0, 8, (6, 3)).round(5), rng.uniform(-1, 1, (6, 3)).round(6)
        out += [" POSITION                                       TOTAL-FORCE (eV/Angst)", " " + "-" * 80]
        body = ["  " + "  ".join(f"{x:.6f}" for x in [*p, *f]) for p, f in zip(pos, frc, strict=True)]
        if spoil == k:
            body[2] = "   0.1 0.2 ****** 0.1 0.2 0.3"
        energy = round(float(rng.uniform(-90, 0)), 8)
        out += [*body, " " + "-" * 80, "    total drift:   0.1 0.2 0.3", "  7 1 1 1 1 1", f"  free  energy   TOTEN  =  {energy:.8f} eV"]
        frames.append((lattice, pos, frc, energy, kbar))
    return "\n".join(out) + "\n", frames


def same_frame(r, want):
    lattice, pos, frc, energy, kbar = want
    assert r["natoms"] == 6 and r["energy"] == energy
    assert np.allclose(np.array(r["lattice"]).reshape(3, 3), lattice)
    assert [a["species"] for a in r["atoms"]] == ["Mo", "Mo", "Te", "Te", "Te", "Li"]
    assert np.allclose([[a[c] for c in ("x", "y", "z")] for a in r["atoms"]], pos)
    assert np.allclose([[a[c] for c in ("fx", "fy", "fz")] for a in r["atoms"]], frc)
    xx, yy, zz, xy, yz, zx = kbar * abs(np.linalg.det(lattice)) / 1602.1766208
    assert np.allclose(r["virial"], [xx, xy, zx, xy, yy, yz, zx, yz, zz])


def job(root, name, text, file="OUTCAR"):
    (root / name).mkdir(exist_ok=True)
    (root / name / file).write_text(text)


def test_outcar_frames_of_every_step(spark, tmp_path, small_splits):
    logs = {"1": outcar(1, 5), "2": outcar(2, 3, cells=False), "10": outcar(3, 2, spoil=1)}
    for name, (text, _) in logs.items():
        job(tmp_path, name, text)
    got = {(r["source"], r["frame_idx"]): r for r in rs.outcar_frames(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted((n, k) for n, (_, f) in logs.items() for k in range(len(f)))
    for (name, k), r in got.items():
        if (name, k) == ("10", 1):
            assert r["status"] == "unreadable" and r["atoms"] is None
        else:
            assert r["status"] == "ok"
            same_frame(r, logs[name][1][k])


def test_newest_frames_of_converged_jobs(spark, tmp_path, small_splits):
    logs = {"1": outcar(1, 4), "2": outcar(2, 2, marks=0), "3": outcar(3, 3, marks=2), "4": outcar(4, 2, spoil=1), "6": outcar(6, 3, cells=False)}
    for name, (text, _) in logs.items():
        job(tmp_path, name, text)
    job(tmp_path, "7", "aborting loop because EDIFF is reached\nnothing else\n")
    jobs = spark.createDataFrame([(str(k),) for k in range(1, 8)], "job string")
    got = {r["job"]: r for r in rs.collect_frames(spark, str(tmp_path), jobs).collect()}
    status = {k: r["status"] for k, r in got.items()}
    assert status == {"1": "ok", "2": "not_converged", "3": "repeated", "4": "unreadable", "5": "missing", "6": "ok", "7": "unreadable"}
    assert got["1"]["frame_idx"] == 3 and got["2"]["atoms"] is None
    same_frame(got["1"], logs["1"][1][3])
    same_frame(got["6"], logs["6"][1][2])


XYZ = '3\nLattice="5 0 0 0 6 0 0 0 7"\nMo 0.1 0.2 0.3\nTe 1 2 3 extra\nLi 4 5 6\nleft over 1 2 3\n'
INP = "&SUBSYS\n  &CELL\n    A 8 0 0\n    B 0 8 0\n    C 1 0 8\n  &END CELL\n  &COORD\n    O 0 0 0\n# H 9 9 9\n    H 1e-1 -2 3\n  &END COORD\n&END\n"
NEW = (
    " ENERGY| Total FORCE_EVAL ( QS ) energy [hartree]   -17.5\n FORCES| Atomic forces [hartree/bohr]\n FORCES| Atom x y z |f|\n"
    " FORCES|   1  0.1 0.2 0.3 0.4\n FORCES|   2  -0.1 0.2 0.5 0.4\n FORCES|  3 1e-2 0 0 1\n FORCES| Sum 0 0 0\n\n"
    " STRESS| Analytical stress tensor [bar]\n STRESS|       x  y  z\n STRESS| x 100 2 3\n STRESS| y 2 50 6\n STRESS| z 3 6 9\n"
)
OLD = (
    " ENERGY| Total FORCE_EVAL ( QS ) energy (a.u.):      -3.25\n ATOMIC FORCES in [a.u.]\n\n # Atom   Kind   Element          X              Y              Z\n"
    "      1      1      O           0.5  0.25  -1\n      2      2      H           0.125 0 0\n SUM OF ATOMIC FORCES  0 0 0 0\n"
    " STRESS| Analytical stress tensor [GPa]\n STRESS| x 1 2 3\n STRESS| y 2 5 6\n STRESS| z 3 6 9\n"
)


def test_cp2k_frames_and_reasons(spark, tmp_path, small_splits):
    for name, files in {
        "both": {"cp2k.log": NEW, "a.log": "x", "p2.xyz": XYZ, "p10.xyz": "1\n\nH 0 0 0\n", "r.inp": INP},
        "xyz": {"run.log": NEW, "p.xyz": XYZ},
        "inp": {"run.log": OLD, "r.inp": INP, "p.xyz": "3\nc\nMo 0 0 bad\nMo 0 0 0\nMo 0 0 0\n"},
        "flat": {"run.log": NEW, "p.xyz": XYZ.replace('Lattice="5 0 0 0 6 0 0 0 7"', "none")},
        "nothing": {"run.log": NEW},
        "nostress": {"run.log": NEW.split(" STRESS")[0], "p.xyz": XYZ},
        "noforce": {"run.log": NEW.replace("FORCES| Atomic", "FORCES| No"), "p.xyz": XYZ},
        "noenergy": {"run.log": NEW.replace("FORCE_EVAL", "F"), "p.xyz": XYZ},
        "neither": {"run.log": NEW.replace("FORCE_EVAL", "F").replace("FORCES| Atomic", "FORCES| No"), "p.xyz": XYZ},
        "nolog": {"p.xyz": XYZ},
    }.items():
        for file, text in files.items():
            job(tmp_path, name, text, file)
    got = {r["job"]: r for r in rs.collect_frames_cp2k(spark, str(tmp_path)).collect()}
    assert {k: r["status"] for k, r in got.items()} == {
        "both": "ok", "xyz": "ok", "inp": "ok", "flat": "ok", "nothing": "no_structure", "nostress": "no_stress",
        "noforce": "no_forces", "noenergy": "no_energy", "neither": "no_energy_and_forces",
    }
    both, inp = got["both"], got["inp"]
    assert both["natoms"] == 3 and both["lattice"] == [8, 0, 0, 0, 8, 0, 1, 0, 8] and got["xyz"]["lattice"] == [5, 0, 0, 0, 6, 0, 0, 0, 7]
    assert both["energy"] == pytest.approx(-17.5 * 27.211386245988)
    assert [a["species"] for a in both["atoms"]] == ["Mo", "Te", "Li"] and both["atoms"][1]["x"] == 1.0
    assert both["atoms"][2]["fx"] == pytest.approx(0.01 * 51.4220674763259)
    assert both["virial"][0] == pytest.approx(0.01 * 512 / 160.2176634) and got["flat"]["virial"] == [0.0] * 9
    assert inp["natoms"] == 2 and inp["atoms"][1]["x"] == 0.1 and inp["atoms"][1]["fx"] == pytest.approx(0.125 * 51.4220674763259)
    assert inp["energy"] == pytest.approx(-3.25 * 27.211386245988)
    legacy = {r["job"]: r for r in rs.collect_frames_cp2k(spark, str(tmp_path), legacy=True).collect()}
    assert legacy["both"]["energy"] == pytest.approx(-17.5 * 27.2113838565563, abs=1e-9)

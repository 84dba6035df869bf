import numpy as np
import pytest
from framebasin.functions import text as tx
from framebasin.operators import labels as lb
from framebasin.sources import frames as fs
from framebasin.sources import lines as ln
from framebasin.sources import tables as tb
from pyspark.sql import functions as F


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def write_xyz(path, count):
    with open(path, "w") as f:
        for k in range(count):
            n = k % 4 + 1
            f.write(f"{n}\n")
            # a comment that looks like a count line, and atoms given by number
            f.write("17\n" if k % 3 == 0 else f'Lattice="9 0 0 0 9 0 0 0 {k + 1}" energy={k} note="a b" energy={k + 0.5}\n')
            for i in range(n):
                f.write(f"8 {i}.5 {k} 0.25\n")
            if k % 5 == 0:
                f.write("\n")


def test_strict_reader_follows_counts_across_splits(spark, tmp_path, small_splits):
    for name, count in (("a10.xyz", 150), ("a2.xyz", 40)):
        write_xyz(tmp_path / name, count)
    df = fs.read_frames(spark, str(tmp_path))
    rows = {(r["file_ord"], r["frame_idx"]): r for r in df.collect()}
    assert len(rows) == 190
    assert {r["file"].rsplit("/", 1)[1] for k, r in rows.items() if k[0] == 0} == {"a2.xyz"}  # natural order
    for (o, k), r in rows.items():
        assert r["natoms"] == k % 4 + 1 == len(r["atoms"])
        assert all(a["y"] == k and a["species"] == "8" and a["x"] == i + 0.5 for i, a in enumerate(r["atoms"]))
        if k % 3:
            assert r["energy"] == k + 0.5 and r["lattice"][8] == k + 1 and r["info"]["note"] == "a b"
        else:
            assert r["lattice"] is None and r["pbc"] == [True] * 3
    numbers = sorted(r["frame_no"] for r in fs.frame_numbers(df).collect())
    assert numbers == list(range(190))


def test_strict_reader_rejects_broken_files(spark, tmp_path):
    (tmp_path / "cut.xyz").write_text("3\nc\nH 0 0 0\nH 0 0 1\n")
    with pytest.raises(Exception, match="cut short"):
        fs.read_frames(spark, str(tmp_path / "cut.xyz")).collect()
    (tmp_path / "off.xyz").write_text("1\nc\nH 0 0 0\nH 0 0 1\n1\nc\nH 0 0 0\n")
    with pytest.raises(Exception, match="atom count was expected"):
        fs.read_frames(spark, str(tmp_path / "off.xyz")).collect()


def blocks_of(text):
    """Plain strict reading: (header line, lines) of every frame."""
    lines, out, at = text.split("\n"), [], 0
    while at < len(lines):
        if not lines[at].strip():
            at += 1
            continue
        n = int(lines[at].split()[0])
        out.append((at, [x.rstrip() for x in lines[at : at + n + 2]]))
        at += n + 2
    return out


@pytest.mark.parametrize("bytes_", ["600", "100000"])
def test_frames_straddle_splits_of_any_size(spark, tmp_path, bytes_):
    spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_)
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        texts = {}
        for name, count in (("a.xyz", 60), ("b.xyz", 1), ("c.xyz", 25)):
            write_xyz(tmp_path / name, count)
        (tmp_path / "d.xyz").write_text("60\nlong\n" + "8 1.0 2.0 3.0\n" * 60 + "\n\n\n1\n5\nH 0 0 0\n\n")
        # counts with text behind them, atom rows that are lone numbers: nothing to guess a start by
        (tmp_path / "e.xyz").write_text("".join(f"{k % 3 + 1} atoms\n{k % 3}\n" + "3\n" * (k % 3 + 1) for k in range(50)))
        (tmp_path / "f.xyz").write_text("".join("2\n1\n1\n3\n" for _ in range(60)))
        (tmp_path / "empty.xyz").write_text("")
        for f in tmp_path.glob("*.xyz"):
            texts[f.name] = f.read_text()
        got = {}
        for r in fs.frame_blocks(spark, str(tmp_path)).collect():
            got.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["frame_idx"], r["line_no"], r["ls"]))
        for name, text in texts.items():
            want = [(k, at, ls) for k, (at, ls) in enumerate(blocks_of(text))]
            assert sorted(got.get(name, [])) == want, name
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_other_columns_and_text_survive(spark, tmp_path):
    text = (
        '2\nLattice="9 0 0 0 9 0 0 0 9" Properties=species:S:1:vel:R:3:pos:R:3:Group:I:2:forces:R:3:note:S:1 energy=1.50\n'
        "Mo 0.10 2e-3 -1 1.0 2.0 3.000 4 5 1 2 3 a|b\nTe  .5 6 7   0 0 1 8 9 4 5 6 é\n"
        "1\nProperties=pos:R:3:species:S:1\n0 1 2 Li\n"
    )
    (tmp_path / "a.xyz").write_text(text)
    one = fs.read_frames(spark, str(tmp_path / "a.xyz"), raw=True)
    fs.write_frames(one, str(tmp_path / "out"))
    two = fs.read_frames(spark, str(tmp_path / "out")).orderBy("frame_idx").collect()
    assert two[0]["properties"] == "species:S:1:vel:R:3:pos:R:3:Group:I:2:forces:R:3:note:S:1"
    assert [a["more"] for a in two[0]["atoms"]] == [["0.10 2e-3 -1", "4 5", "a|b"], [".5 6 7", "8 9", "é"]]
    assert (two[0]["atoms"][1]["z"], two[0]["atoms"][1]["fz"]) == (1.0, 6.0)
    assert two[1]["properties"] == "pos:R:3:species:S:1" and two[1]["atoms"][0]["species"] == "Li"
    fs.write_frames(one, str(tmp_path / "raw"), raw=True)
    back = "".join(f.read_text() for f in sorted((tmp_path / "raw").glob("part-*")))
    assert back == text
    grouped = lb.with_groups(one.where("frame_idx = 0").withColumn("atoms", F.transform("atoms", lambda a: a.dropFields("more"))), ["Te", "Mo"])
    fs.write_frames(grouped.withColumn("properties", F.lit(None).cast("string")).withColumn("info", F.lit(None).cast("map<string,string>")), str(tmp_path / "g"))
    r = fs.read_frames(spark, str(tmp_path / "g")).first()
    assert r["properties"] == "species:S:1:pos:R:3:forces:R:3:group:I:1" and [a["more"] for a in r["atoms"]] == [["1"], ["0"]]
    bare = lb.drop_labels(one)
    fs.write_frames(bare, str(tmp_path / "bare"))
    r = fs.read_frames(spark, str(tmp_path / "bare")).orderBy("frame_idx").first()
    assert "forces" not in r["properties"] and r["atoms"][0]["more"] == ["0.10 2e-3 -1", "4 5", "a|b"] and r["atoms"][0]["fx"] is None


def test_names_with_long_runs_of_digits(spark):
    names = ["a9", "a10", "a" + "1" * 25, "a" + "1" * 24 + "2", "a2" + "0" * 1200, "a3" + "0" * 1200, "a0010", "b1", "A9x"]
    got = {r[0]: r[1] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", tx.natural_key(F.col("n"))).collect()}
    assert len(set(got.values())) == len(names) - 1 and got["a10"] == got["a0010"]
    order = sorted(set(names) - {"a0010"}, key=got.get)
    assert order == ["a9", "A9x", "a10", "a" + "1" * 25, "a" + "1" * 24 + "2", "a2" + "0" * 1200, "a3" + "0" * 1200, "b1"]


BAD = """junk before the first frame
2
comment
H 0 0 0
H 0 0 1

2
comment
H 0 0 0
3
comment
H 0 0 0
H 0 0 1
H 0 0 2
H 0 0 3
1
comment
H 0 zero 0
H 1 1 1
2
H 0 0 0
H 0 0 1
2

comment
H 1 0 0

H 0 0 1
4
only a comment
"""


def test_tolerant_reader_statuses(spark, tmp_path, small_splits):
    (tmp_path / "bad.xyz").write_text(BAD)
    rows = fs.frame_lines(spark, str(tmp_path / "bad.xyz"))
    blocks = fs.frame_blocks(spark, str(tmp_path / "bad.xyz"), strict=False)
    for found in (fs.validate_frames(rows), fs.validate_blocks(blocks)):
        got = {r["frame_idx"]: (r["status"], r["declared"], r["found"], r["header_line"]) for r in found.collect()}
        assert got == {
            0: ("good", 2, 2, 1), 1: ("missing", 2, 1, 6), 2: ("extra", 3, 4, 9), 3: ("invalid", 1, 1, 15),
            4: ("good", 2, 2, 19), 5: ("good", 2, 2, 22), 6: ("missing", 4, 0, 28),
        }
    assert rows.filter("frame_idx IS NULL").count() == 1
    kept = fs.read_frames(spark, str(tmp_path / "bad.xyz"), strict=False).orderBy("frame_idx").collect()
    assert [(r["frame_idx"], r["natoms"], r["atoms"][0]["x"]) for r in kept] == [(0, 2, 0.0), (1, 2, 0.0), (2, 2, 1.0)]


def test_text_survives_a_round_trip(spark, tmp_path):
    (tmp_path / "a.xyz").write_text(
        '2\nTime=5 Lattice="1 2 3 4 5 6 7 8 10" Properties=species:S:1:pos:R:3:tag:I:1:forces:R:3 energy=-1.25 pbc="T F T" name="x y"\n'
        "Mo 0.1 0.2 0.3 7 1 2 3\nTe 1e-3 -2.5 3 8 4 5 6\n"
    )
    one = fs.read_frames(spark, str(tmp_path / "a.xyz"))
    fs.write_frames(one, str(tmp_path / "out"))
    two = fs.read_frames(spark, str(tmp_path / "out"))
    cols = ("natoms", "lattice", "pbc", "energy", "atoms")
    assert one.select(*cols).collect() == two.select(*cols).collect()
    r = two.first()
    assert r["info"]["name"] == "x y" and r["info_keys"][:2] == ["Time", "Lattice"]
    assert (r["atoms"][1]["x"], r["atoms"][1]["fz"]) == (0.001, 6.0)


def test_line_numbers_across_splits(spark, tmp_path, small_splits):
    (tmp_path / "n.txt").write_text("".join(f"{'#' if i % 10 == 0 else ''} line {i} {'x' * (i % 37)}\n" for i in range(700)))
    df = ln.read_lines(spark, str(tmp_path / "n.txt"), {"marks": F.col("line").startswith("#")})
    assert df.select("blk").distinct().count() > 3
    for r in df.collect():
        assert int(r["line"].split("line ")[1].split()[0]) == r["line_no"]
        assert r["marks"] == r["line_no"] // 10 + 1


def test_matrix_positions_over_files_with_gaps(spark, tmp_path):
    (tmp_path / "m1.out").write_text("1 2\n\n3 4\n")
    (tmp_path / "m2.out").write_text("\n")
    (tmp_path / "m10.out").write_text("5 6\n")
    got = sorted((r["row_no"], r["row"], r["values"]) for r in tb.read_matrix(spark, str(tmp_path)).collect())
    assert got == [(0, 0, [1.0, 2.0]), (1, 1, [3.0, 4.0]), (2, 0, [5.0, 6.0])]


def test_other_encodings_of_profiles(spark, tmp_path):
    text = "# té\n\n1 10\n2 20 x\n\n3 30\n"
    for k, encoding in enumerate(("latin-1", "utf-8", "utf-16", "cp1252", "utf-16le")):
        (tmp_path / f"p{k}.dat").write_bytes(text.encode(encoding))
        got = tb.read_profile(spark, str(tmp_path / f"p{k}.dat"), skip=2, encoding=encoding).orderBy("z").collect()
        assert [(r["line_no"], r["z"], r["value"]) for r in got] == [(2, 1.0, 10.0), (3, 2.0, 20.0), (5, 3.0, 30.0)], encoding


def test_encodings_are_tried_in_turn(spark, tmp_path):
    text = "# té\n\n1 10\n2 20 x\n\n3 30\n"
    for encoding in ("utf-16", "utf-8-sig", "utf-16le", "utf-8"):
        (tmp_path / encoding).write_bytes(text.encode(encoding))
    (tmp_path / "ascii").write_text("head\n\n1 10\r\n2 20\n\n3 30")
    (tmp_path / "none").write_bytes(b"t\xe9\n")
    (tmp_path / "empty").write_bytes(b"")
    rows = tb.read_profile(spark, str(tmp_path), skip=2, encoding=ln.ENCODINGS).collect()
    got = {}
    for r in rows:
        got.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["line_no"], r["z"], r["value"]))
    want = [(2, 1.0, 10.0), (3, 2.0, 20.0), (5, 3.0, 30.0)]
    assert {k: sorted(v) for k, v in got.items()} == {k: want for k in ("utf-16", "utf-8-sig", "utf-16le", "utf-8", "ascii")}
    found = {r["file"].rsplit("/", 1)[1]: r["encoding"] for r in ln.encodings_of(spark, str(tmp_path)).collect()}
    assert found == {"utf-16": "utf-16", "utf-8-sig": "utf-8-sig", "utf-16le": "utf-16le", "utf-8": "utf-8-sig", "ascii": "utf-8-sig", "none": None}


def test_loss_and_level_layouts(spark, tmp_path):
    (tmp_path / "loss6").write_text("1 1 2 3 4 9\n2 5 6 7 8 9\n")
    got = tb.read_loss(spark, str(tmp_path / "loss6")).filter("step = 2").orderBy("value").collect()
    assert [(r["metric"], r["value"]) for r in got] == [("Loss", 5.0), ("Energy-train", 6.0), ("Force-train", 7.0), ("Virial-train", 8.0)]
    (tmp_path / "loss9").write_text("0 1 2 3 4 5 6 7 8\n50 1 2 3 4 5 6 7 8\n")
    with pytest.raises(ValueError, match="step size"):
        tb.read_loss(spark, str(tmp_path / "loss9"))
    (tmp_path / "levels.csv").write_text("system,vbm,cbm\na,1,2\n")
    with pytest.raises(ValueError, match="ef"):
        tb.read_levels(spark, str(tmp_path / "levels.csv"))


def test_relabel_needs_equal_row_counts(spark):
    cell = np.eye(3).reshape(-1).tolist()
    frames = spark.createDataFrame([(0, 2, cell), (1, 1, cell)], "frame_no long, natoms int, lattice array<double>")
    energy = spark.createDataFrame([(0, [1.5, 0.0]), (1, [2.0, 0.0])], "row_no long, values array<double>")
    assert sorted(r["energy"] for r in lb.relabel_frames(frames, energy).collect()) == [2.0, 3.0]
    with pytest.raises(Exception, match="row counts differ"):
        lb.relabel_frames(frames, energy.filter("row_no = 0")).collect()
    with pytest.raises(Exception, match="row counts differ"):
        lb.relabel_frames(frames.filter("frame_no = 0"), energy).collect()

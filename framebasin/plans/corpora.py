"""Sources and sinks: each query writes files from a supplied table and reads them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import labels as lb
from ..operators import levels as lv
from ..sources import frames as fr_src
from ..sources import lines as ln
from ..sources import logs as lg
from ..sources import sinks as sk
from ..sources import tables as tb
from ..sources import trajectory as tj
from ..session import scratch_path
from ..streaming.ingest import ingest_stream
from . import standins as si
from .registry import query
from .standins import FRAMES_SQL, rnd, table

_PER_FILE = 64


def _emb(spark, sf) -> DataFrame:
    e = F.transform("embedding", lambda v: v.cast("double"))
    src = table(spark, sf, "embeddings").select("vec_id", "label", e.alias("e"))
    return src.withColumn("bucket", F.floor(F.col("vec_id") / _PER_FILE).cast("int"))


def _s(c: Column) -> Column:
    return c.cast("string")


def _headed(rows: DataFrame, header: Column) -> DataFrame:
    """Rows of a bucket with a header before the first one; buckets are bounded in size."""
    first = F.col("vec_id") % _PER_FILE == 0
    return rows.withColumn("value", F.when(first, F.concat_ws("\n", header, F.col("value"))).otherwise(F.col("value")))


def _vec() -> Column:
    return (F.col("file_ord") * _PER_FILE + F.col("frame_idx")).alias("vec_id")


# -- extended XYZ --------------------------------------------------------------------


@query(
    "read_extxyz",
    f"""WITH {FRAMES_SQL} SELECT frame_idx AS frame_no, frame_idx AS vec, frame_idx * 5 AS "time", count(*) AS natoms, round(max(e[64]), 8) AS energy, round(max(la) * 120, 6) AS volume,
          'TTF' AS pbc, round(sum(x + 2 * y + 3 * z), 6) AS pos, round(sum(fx + 2 * fy + 3 * fz), 6) AS force, round(max(e[9]), 8) AS v_zz FROM fatoms GROUP BY frame_idx""",
)
def read_extxyz(spark, sf):
    path = scratch_path(spark, "extxyz")
    fr_src.write_frames(si.frames(spark, sf), path)
    got = fr_src.frame_numbers(fr_src.read_frames(spark, path))
    info = lambda k: tx.info_value(F.col("info"), k).cast("long")

    def total(*names):
        return F.aggregate("atoms", F.lit(0.0), lambda s, a: s + a[names[0]] + 2 * a[names[1]] + 3 * a[names[2]])

    m = [F.get("lattice", F.lit(k)) for k in (0, 4, 8)]
    return got.select(
        "frame_no", info("vec").alias("vec"), info("time").alias("time"), F.col("natoms").cast("long").alias("natoms"),
        rnd("energy", 8).alias("energy"), rnd(m[0] * m[1] * m[2]).alias("volume"),
        F.array_join(F.transform("pbc", lambda p: F.when(p, "T").otherwise("F")), "").alias("pbc"),
        rnd(total("x", "y", "z")).alias("pos"), rnd(total("fx", "fy", "fz")).alias("force"),
        rnd(F.get("virial", F.lit(8)), 8).alias("v_zz"),
    )


@query(
    "read_lossless",
    f"""WITH {FRAMES_SQL} SELECT frame_idx, atom_idx, species, CASE atom_idx % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS grp, round(x, 8) AS x, round(fz, 8) AS fz,
          round(y / 3, 8) AS vx, round(z / 3, 8) AS vy, round(x / 3, 8) AS vz, 'odd_' || atom_idx || '|' || (frame_idx % 7) AS tag, 'force' AS named FROM fatoms""",
)
def read_lossless(spark, sf):
    fr = si.frames(spark, sf)
    vel = lambda a: F.concat_ws(" ", *[_s(a[c] / 3) for c in "yzx"])
    tag = lambda a: F.concat(F.lit("odd_"), a["atom_idx"], F.lit("|"), F.col("frame_idx") % 7)
    # velocities and an odd text stand before and after the positions
    fr = fr.withColumns({
        "atoms": F.transform("atoms", lambda a: a.withField("more", F.array(vel(a), tag(a)))),
        "properties": F.lit("species:S:1:vel:R:3:pos:R:3:Tag_of:S:1:forces:R:3"),
        "info": F.map_concat("info", F.create_map(F.lit("Properties"), F.lit("species:S:1:vel:R:3:pos:R:3:Tag_of:S:1:forces:R:3"),
                             F.lit("Lattice"), tx.join_floats(F.col("lattice")), F.lit("energy"), _s(F.col("energy")))),
    })
    path = scratch_path(spark, "lossless")
    fr_src.write_frames(lb.with_groups(lb.harmonise(fr), si.SPECIES), path)
    got = fr_src.read_frames(spark, path)
    again = scratch_path(spark, "lossless")
    fr_src.write_frames(got, again)
    got = fr_src.frame_numbers(fr_src.read_frames(spark, again))
    named = F.regexp_extract(tx.info_value(F.col("info"), "Properties"), r":(forces?):R:3", 1)
    rows = got.select(F.col("frame_no").alias("frame_idx"), named.alias("named"), F.inline("atoms"))
    v = F.split(F.get("more", F.lit(0)), " ")
    return rows.select(
        "frame_idx", "atom_idx", "species", F.get("more", F.lit(2)).cast("int").alias("grp"), rnd("x", 8).alias("x"), rnd("fz", 8).alias("fz"),
        *[rnd(F.get(v, F.lit(k)).cast("double"), 8).alias(f"v{c}") for k, c in enumerate("xyz")], F.get("more", F.lit(1)).alias("tag"), "named",
    )


def _spoiled(spark, sf) -> str:
    """Frames of three atoms; by number modulo 5 a row is missing, extra or unreadable, or the comment is absent."""
    emb = _emb(spark, sf)
    k = F.col("vec_id") % 5

    def row(s: str, i: int) -> Column:
        return F.concat_ws(" ", F.lit(s), *[_s(F.get("e", F.lit(i + j))) for j in range(3)])

    rows = F.concat_ws(
        "\n",
        F.when(F.col("vec_id") == 0, "left over from an earlier run"),
        F.lit("3"),
        F.when(k != 4, F.concat(F.lit("energy="), _s(F.get("e", F.lit(63))))),
        row("Mo", 0),
        F.when(k == 3, "Te 1.0 oops 2.0").otherwise(row("Te", 3)),
        F.when(k == 4, F.lit("")),
        F.when(k != 1, row("Li", 6)),
        F.when(k == 2, row("Li", 9)),
    )
    return si.derive_text(emb.select(F.col("vec_id").alias("ord"), rows.alias("value")), "spoiled")


@query(
    "validate_frames",
    """SELECT vec_id AS frame_no, 3 AS declared, CASE vec_id % 5 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 2 ELSE 3 END AS found,
         CASE vec_id % 5 WHEN 1 THEN 'missing' WHEN 2 THEN 'extra' WHEN 3 THEN 'invalid' ELSE 'good' END AS status FROM embeddings""",
)
def validate_frames(spark, sf):
    path = _spoiled(spark, sf)
    status = fr_src.validate_blocks(fr_src.frame_blocks(spark, path, strict=False))
    files = ln.list_files(spark, path).select("file", "file_ord")
    return fr_src.frame_numbers(status.join(files, "file")).select("frame_no", "declared", "found", "status")


@query(
    "read_tolerant",
    """SELECT row_number() OVER (ORDER BY vec_id) - 1 AS frame_no, 3 AS natoms, CASE WHEN vec_id % 5 = 0 THEN round(CAST(embedding[64] AS DOUBLE), 8) END AS energy,
         round(CAST(embedding[1] AS DOUBLE) + CAST(embedding[4] AS DOUBLE) + CAST(embedding[7] AS DOUBLE), 8) AS sx
       FROM embeddings WHERE vec_id % 5 IN (0, 4)""",
)
def read_tolerant(spark, sf):
    got = fr_src.frame_numbers(fr_src.read_frames(spark, _spoiled(spark, sf), strict=False))
    sx = F.aggregate("atoms", F.lit(0.0), lambda s, a: s + a["x"])
    return got.select("frame_no", "natoms", rnd("energy", 8).alias("energy"), rnd(sx, 8).alias("sx"))


@query(
    "merge_status",
    f"""WITH b AS (SELECT vec_id // {_PER_FILE} AS bucket, vec_id FROM embeddings)
        SELECT bucket, CASE bucket % 4 WHEN 2 THEN 'empty' WHEN 3 THEN 'invalid' ELSE 'ok' END AS status,
          CASE WHEN bucket % 4 > 1 THEN 0 WHEN bucket % 4 = 1 THEN count(*) FILTER (WHERE vec_id % 2 = 0) ELSE count(*) END AS frames,
          CASE WHEN bucket % 4 = 1 THEN count(*) FILTER (WHERE vec_id % 2 = 1) ELSE 0 END AS bad FROM b GROUP BY 1""",
)
def merge_status(spark, sf):
    kind = F.col("bucket") % 4
    frame = F.concat(F.lit("1\ntag="), _s(F.col("vec_id")), F.when((kind == 1) & (F.col("vec_id") % 2 == 1), "").otherwise("\nMo 0 0 0"))
    value = F.when(kind == 2, "").when(kind == 3, "no frames here").otherwise(frame)
    rows = _emb(spark, sf).select("bucket", "vec_id", value.alias("value"))
    path = si.derive_files(rows, "merge", "vec_id")
    got = fr_src.merge_status(spark, path, recursiveFileLookup="true")
    bucket = F.regexp_extract("file", r"bucket=(\d+)", 1).cast("long")
    return got.select(bucket.alias("bucket"), "status", "frames", "bad")


@query(
    "discover",
    f"SELECT DISTINCT CAST(vec_id // {_PER_FILE} AS INTEGER) AS file_ord, 'bucket=' || (vec_id // {_PER_FILE}) AS folder FROM embeddings",
)
def discover(spark, sf):
    root = si.derive_files(_emb(spark, sf).select("bucket", "vec_id", _s(F.col("vec_id")).alias("value")), "found", "vec_id")
    files = ln.discover(spark, root, "part-*", exclude="_SUCCESS")
    return files.select("file_ord", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("folder"))


# -- trajectories ----------------------------------------------------------------------


@query(
    "read_xdatcar",
    """WITH f AS (SELECT vec_id, CAST(i.range AS INTEGER) AS atom_idx, CAST(embedding AS DOUBLE[]) AS e FROM embeddings, range(21) i)
       SELECT vec_id, atom_idx, CASE WHEN atom_idx < 4 THEN 'Mo' WHEN atom_idx < 12 THEN 'Te' ELSE 'Li' END AS species,
         round(3 * e[3*atom_idx+1] - floor(3 * e[3*atom_idx+1]), 8) AS fx, round(e[3*atom_idx+2] - floor(e[3*atom_idx+2]), 8) AS fy, round(e[3*atom_idx+3] - floor(e[3*atom_idx+3]), 8) AS fz,
         round(10 * (3 * e[3*atom_idx+1] - floor(3 * e[3*atom_idx+1])), 7) AS x FROM f""",
)
def read_xdatcar(spark, sf):
    emb = _emb(spark, sf)
    coords = F.transform(
        F.sequence(F.lit(0), F.lit(20)),
        lambda i: F.concat_ws(" ", _s(3 * F.get("e", 3 * i)), _s(F.get("e", 3 * i + 1)), _s(F.get("e", 3 * i + 2))),
    )
    mark = F.concat(F.lit("Direct configuration=  "), _s(F.col("vec_id") % _PER_FILE + 1))
    rows = emb.withColumn("value", F.concat_ws("\n", mark, F.array_join(coords, "\n")))
    header = F.lit("sample\n2.0\n5.0 0.0 0.0\n0.0 5.0 0.0\n0.0 0.0 6.0\nMo Te Li\n4 8 9")
    path = si.derive_files(_headed(rows, header).select("bucket", "vec_id", "value"), "xdatcar", "vec_id")
    pos = tj.to_cartesian(tj.read_xdatcar(spark, path, recursiveFileLookup="true"))
    return pos.select(_vec(), "atom_idx", "species", *[rnd(c, 8).alias(c) for c in ("fx", "fy", "fz")], rnd("x", 7).alias("x"))


@query(
    "read_cfg",
    """WITH f AS (SELECT vec_id, i.range AS i, CAST(embedding AS DOUBLE[]) AS e FROM embeddings, range(10) i)
       SELECT vec_id, CAST(i AS INTEGER) AS atom_idx, CASE (vec_id + i) % 3 WHEN 0 THEN 'Mo' WHEN 1 THEN 'Te' ELSE 'Li' END AS species, round(e[i+1], 8) AS x, round(e[i+31], 8) AS fz,
         round(e[64], 8) AS energy, round(e[60], 8) AS v_xy, round(4.0::DOUBLE + e[1], 8) AS a_x FROM f""",
)
def read_cfg(spark, sf):
    emb = _emb(spark, sf)
    atoms = F.transform(
        F.sequence(F.lit(9), F.lit(0), F.lit(-1)),
        lambda i: F.concat_ws(
            " ", _s(i + 1), _s((F.col("vec_id") + i) % 3), _s(F.get("e", i)), _s(F.get("e", i + 10)), _s(F.get("e", i + 20)),
            F.lit("0.5"), F.lit("0.25"), _s(F.get("e", i + 30)), F.lit("0.1"),
        ),
    )
    stress = F.concat_ws(" ", *[_s(F.get("e", F.lit(k))) for k in (54, 55, 56, 57, 58, 59)])
    value = F.concat_ws(
        "\n", F.lit("BEGIN_CFG"), F.lit(" Size"), F.lit("    10"), F.lit(" Supercell"),
        F.concat_ws(" ", _s(4.0 + F.get("e", F.lit(0))), F.lit("0 0")), F.lit("0 5 0"), F.lit("0 0 6"),
        F.lit(" AtomData:  id type cartes_x cartes_y cartes_z fx fy fz site_en"), F.array_join(atoms, "\n"),
        F.lit(" EnergyWeight"), F.lit("  2.0"), F.lit(" Energy"), _s(F.get("e", F.lit(63))),
        F.lit(" PlusStress:  xx yy zz yz xz xy"), stress, F.lit("END_CFG"), F.lit(""),
    )
    path = si.derive_files(emb.select("bucket", "vec_id", value.alias("value")), "cfg", "vec_id")
    cfg = tj.read_cfg(spark, path, si.SPECIES, recursiveFileLookup="true")
    v = F.get("virial", F.lit(5))
    rows = cfg.select(_vec(), "energy", v.alias("v"), F.get("lattice", F.lit(0)).alias("a_x"), F.inline("atoms"))
    return rows.select(
        "vec_id", "atom_idx", "species", rnd("x", 8).alias("x"), rnd("fz", 8).alias("fz"), rnd("energy", 8).alias("energy"),
        rnd("v", 8).alias("v_xy"), rnd("a_x", 8).alias("a_x"),
    )


@query(
    "join_cp2k",
    """WITH f AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
       SELECT vec_id, 2 AS natoms, round(e[64] * 27.211386245988, 6) AS energy, round(e[1] + e[4], 8) AS sx,
         round(e[10] * 51.4220674763259, 6) AS fx0, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE round(e[13] * 51.4220674763259, 6) END AS fx1, round(9.0::DOUBLE + e[2], 8) AS a_x FROM f""",
)
def join_cp2k(spark, sf):
    emb = _emb(spark, sf)

    def frame(lead: int, second: Column) -> Column:
        head = F.concat(F.lit(" i = "), _s(F.col("vec_id")), F.lit(", time = 0.5, E = "), _s(F.get("e", F.lit(63))))
        first = F.concat_ws(" ", F.lit("Mo"), *[_s(F.get("e", F.lit(lead + k))) for k in range(3)])
        return F.concat_ws("\n", F.lit("2"), head, first, second)

    def row(s: str, i: int) -> Column:
        return F.concat_ws(" ", F.lit(s), *[_s(F.get("e", F.lit(i + k))) for k in range(3)])

    pos = emb.withColumn("value", frame(0, row("Te", 3)))
    # every fourth frame has an unreadable second force row
    frc = emb.withColumn("value", frame(9, F.when(F.col("vec_id") % 4 == 0, "Te *** *** ***").otherwise(row("Te", 12))))
    cells = _headed(
        emb.withColumn("value", F.concat_ws(" ", _s(F.col("vec_id")), F.lit("0.5"), _s(9.0 + F.get("e", F.lit(1))), F.lit("0 0 0 9 0 0 0 9 729"))),
        F.lit("# Step Time Ax Ay Az Bx By Bz Cx Cy Cz Volume"),
    )
    paths = [si.derive_files(d.select("bucket", "vec_id", "value"), n, "vec_id") for d, n in ((pos, "pos"), (frc, "frc"), (cells, "cell"))]
    opt = {"recursiveFileLookup": "true"}
    out = lb.join_cp2k(
        tj.read_cp2k_frames(spark, paths[0], **opt), tj.read_cp2k_frames(spark, paths[1], **opt), tj.read_cp2k_cell(spark, paths[2], **opt)
    )
    atom = lambda k: F.get("atoms", F.lit(k))
    return out.select(
        _vec(), "natoms", rnd("energy").alias("energy"), rnd(atom(0)["x"] + atom(1)["x"], 8).alias("sx"),
        rnd(atom(0)["fx"]).alias("fx0"), rnd(atom(1)["fx"]).alias("fx1"), rnd(F.get("lattice", F.lit(0)), 8).alias("a_x"),
    )


# -- numeric tables ------------------------------------------------------------------------


@query(
    "read_matrix",
    """SELECT event_id AS row_no, value, CAST(user_id AS DOUBLE) AS "user" FROM events""",
)
def read_matrix(spark, sf):
    ev = table(spark, sf, "events")
    # every seventh row is followed by a blank line
    text = F.concat(_s(F.col("value")), F.lit("  "), _s(F.col("user_id")), F.when(F.col("event_id") % 7 == 0, "\n").otherwise(""))
    path = si.derive_text(ev.select(F.col("event_id").alias("ord"), text.alias("value")), "matrix")
    return tb.relabel_columns(tb.read_matrix(spark, path), ["value", "user"]).drop("file", "row")


@query(
    "read_profile",
    """SELECT CAST(p_partkey // 500 AS INTEGER) AS file_ord, count(*) AS n, round(avg(CASE WHEN p_size BETWEEN 10 AND 30 THEN p_retailprice END), 6) AS mean FROM part GROUP BY 1""",
)
def read_profile(spark, sf):
    part = table(spark, sf, "part").withColumn("bucket", F.floor(F.col("p_partkey") / 500).cast("int"))
    line = F.concat_ws("   ", _s(F.col("p_size")), _s(F.col("p_retailprice")), F.lit("junk"))
    first = F.col("p_partkey") % 500 == 0
    rows = part.select("bucket", "p_partkey", F.when(first, F.concat(F.lit("# z V(z)\n  9 not data\n\n"), line)).otherwise(line).alias("value"))
    path = si.derive_files(rows, "profile", "p_partkey")
    opt = {"recursiveFileLookup": "true"}
    prof = tb.read_profile(spark, path, skip=2, **opt).join(ln.list_files(spark, path, **opt), "file")
    means = lv.interval_mean(prof, 10, 30, by=["file_ord"])
    sizes = prof.groupBy("file_ord").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(means, "file_ord").withColumn("mean", rnd("mean"))


@query(
    "read_encodings",
    """WITH p AS (SELECT *, p_partkey // 100 AS b FROM part),
       n AS (SELECT b, CASE b % 5 WHEN 0 THEN 'utf-16' WHEN 3 THEN 'utf-16le' WHEN 4 THEN NULL ELSE 'utf-8-sig' END AS encoding FROM (SELECT DISTINCT b FROM p))
       SELECT n.b AS bucket, n.encoding, CASE WHEN encoding IS NOT NULL THEN p_partkey - b * 100 + 2 END AS line_no, CASE WHEN encoding IS NOT NULL THEN CAST(p_size AS DOUBLE) END AS z,
         CASE WHEN encoding IS NOT NULL THEN p_retailprice END AS value FROM n JOIN p USING (b) WHERE encoding IS NOT NULL
       UNION ALL SELECT b, NULL, NULL, NULL, NULL FROM n WHERE encoding IS NULL""",
)
def read_encodings(spark, sf):
    part = table(spark, sf, "part").withColumn("bucket", F.floor(F.col("p_partkey") / 100).cast("int"))
    no = (F.col("p_partkey") % 100).cast("int")
    # two lines of header, the second blank; the rows of missing keys are blank too
    line = F.concat_ws("   ", _s(F.col("p_size")), _s(F.col("p_retailprice")))
    text = part.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct(no, line))).alias("rows"))
    rows = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("rows"))), lambda k: F.coalesce(F.try_element_at("rows", k), F.lit(" ")))  # a blank, as the writer drops empty lines
    # latin-1 with an odd number of bytes fits none of the encodings
    even = (F.char_length(F.array_join(rows, "\n")) + F.length(F.lit("# Höhe in Å")) + 4) % 2 == 0
    head = F.concat(F.when(F.col("bucket") % 5 == 1, "\ufeff").otherwise(""), F.lit("# Höhe in Å"), F.when(even, "!").otherwise(""))
    lines = text.select("bucket", F.posexplode(F.concat(F.array(head, F.lit(" ")), rows)).alias("ord", "value"))
    lines = lines.repartition("bucket").sortWithinPartitions("bucket", "ord")
    path = scratch_path(spark, "encodings")
    for k, codec in enumerate(("UTF-16", "UTF-8", "UTF-8", "UTF-16LE", "ISO-8859-1")):
        plain = {"encoding": codec, "sep": "\u0001", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
        lines.where(F.col("bucket") % 5 == k).select("bucket", "value").write.mode("append").partitionBy("bucket").options(**plain).csv(path)
    opt = {"recursiveFileLookup": "true"}
    bucket = F.regexp_extract("file", r"bucket=(\d+)", 1).cast("long").alias("bucket")
    prof = tb.read_profile(spark, path, skip=2, encoding=ln.ENCODINGS, **opt)
    named = ln.encodings_of(spark, path, **opt)
    return named.join(prof, "file", "left").select(bucket, "encoding", "line_no", "z", "value")


@query(
    "read_blocks",
    """WITH f AS (SELECT vec_id, i.range AS i, CAST(embedding AS DOUBLE[]) AS e FROM embeddings, range(32) i)
       SELECT vec_id, count(*) AS n, round(sum(e[2*i+1]), 7) AS sk, round(sum(e[2*i+2]), 7) AS sf FROM f GROUP BY 1""",
)
def read_blocks(spark, sf):
    rows = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.concat_ws(" ", _s(F.get("e", 2 * i)), _s(F.get("e", 2 * i + 1))))
    blank = F.when(F.col("vec_id") % 3 == 0, "\n\n").otherwise("\n")
    emb = _emb(spark, sf).withColumn("value", F.concat(F.array_join(rows, "\n"), blank))
    path = si.derive_files(_headed(emb, F.lit("# branches\n# k f")).select("bucket", "vec_id", "value"), "blocks", "vec_id")
    opt = {"recursiveFileLookup": "true"}
    got = tb.read_blocks(spark, path, **opt).join(ln.list_files(spark, path, **opt), "file")
    return got.groupBy((F.col("file_ord") * _PER_FILE + F.col("block")).alias("vec_id")).agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum(F.get("values", F.lit(0))), 7).alias("sk"), rnd(F.sum(F.get("values", F.lit(1))), 7).alias("sf")
    )


@query(
    "read_bands",
    """SELECT vec_id, CAST(vec_id AS DOUBLE) AS k, CAST(i.range AS INTEGER) AS band, round(CAST(embedding[i.range + 1] AS DOUBLE), 8) AS energy FROM embeddings, range(64) i""",
)
def read_bands(spark, sf):
    emb = _emb(spark, sf).withColumn("value", F.concat_ws(" ", _s(F.col("vec_id")), tx.join_floats(F.col("e"))))
    path = si.derive_files(_headed(emb, F.lit("# k bands")).select("bucket", "vec_id", "value"), "bands", "vec_id")
    opt = {"recursiveFileLookup": "true"}
    got = tb.read_bands(spark, path, **opt).join(ln.list_files(spark, path, **opt), "file")
    return got.select((F.col("file_ord") * _PER_FILE + F.col("row")).alias("vec_id"), "k", "band", rnd("energy", 8).alias("energy"))


@query(
    "read_loss",
    """SELECT vec_id AS row_no, CAST(vec_id * 100 AS DOUBLE) AS step, m.name AS metric, round(CAST(embedding[m.i] AS DOUBLE), 8) AS value
       FROM embeddings, (VALUES (1, 'Total'), (2, 'L1-Reg'), (3, 'L2-Reg'), (4, 'Energy-train'), (5, 'Force-train'), (6, 'Virial-train')) m(i, name)""",
)
def read_loss(spark, sf):
    emb = _emb(spark, sf)
    text = F.concat_ws(" ", _s(F.col("vec_id") * 100), tx.join_floats(F.slice("e", 1, 9)))
    path = si.derive_text(emb.select(F.col("vec_id").alias("ord"), text.alias("value")), "loss")
    return tb.read_loss(spark, path).withColumn("value", rnd("value", 8))


@query(
    "read_levels",
    """SELECT s_name AS system, round(-s_acctbal / 1000, 6) AS vbm, round(2 - s_acctbal / 1000, 6) AS cbm, round(1 - s_acctbal / 1000, 6) AS ef FROM supplier""",
)
def read_levels(spark, sf):
    base = F.col("s_acctbal") / 1000
    rows = table(spark, sf, "supplier").select(
        F.col("s_name").alias("#system"), (-base).alias("vbm_ev"), (2 - base).alias("cbm_ev"), (1 - base).alias("ef_ev")
    )
    path = scratch_path(spark, "levels")
    sk.write_table(rows, path)
    return tb.read_levels(spark, path).select("system", *[rnd(c).alias(c) for c in ("vbm", "cbm", "ef")])


@query(
    "read_pdos",
    """SELECT vec_id, CAST(vec_id AS DOUBLE) AS energy, round(CAST(embedding[1] AS DOUBLE), 8) AS s, round(CAST(embedding[4] AS DOUBLE), 8) AS px, round(CAST(embedding[2] AS DOUBLE), 8) AS py,
         round(CAST(embedding[3] AS DOUBLE), 8) AS pz FROM embeddings""",
)
def read_pdos(spark, sf):
    emb = _emb(spark, sf).withColumn("value", F.concat_ws(" ", _s(F.col("vec_id")), tx.join_floats(F.slice("e", 1, 4))))
    path = si.derive_files(_headed(emb, F.lit("# E s py pz px")).select("bucket", "vec_id", "value"), "pdos", "vec_id")
    got = tb.read_pdos(spark, path, recursiveFileLookup="true")
    return got.select(F.col("energy").cast("long").alias("vec_id"), "energy", *[rnd(c, 8).alias(c) for c in ("s", "px", "py", "pz")])


# -- logs ------------------------------------------------------------------------------------


def _job_logs(spark, sf):
    """One log folder per bucket; the convergence marker shows bucket % 3 times."""
    emb = _emb(spark, sf)
    k = F.col("vec_id") % _PER_FILE
    marks = F.when((k == 1) & (F.col("bucket") % 3 > 0), lg.EDIFF_MARK)
    again = F.when((k == 2) & (F.col("bucket") % 3 > 1), lg.EDIFF_MARK)
    value = F.concat_ws(
        "\n", F.concat(F.lit("  free  energy   TOTEN  =  "), F.format_string("%.8f", F.get("e", F.lit(0))), F.lit(" eV")),
        F.lit("  volume of cell :     120.50"),
        F.concat(F.lit("  in kB  "), F.concat_ws(" ", *[F.format_string("%.5f", F.get("e", F.lit(j))) for j in range(6)])), marks, again,
    )
    path = si.derive_files(emb.select("bucket", "vec_id", value.alias("value")), "jobs", "vec_id")
    jobs = emb.select("bucket").distinct().select(F.concat(F.lit("bucket="), F.col("bucket")).alias("job"))
    more = emb.select("bucket").distinct().select(F.concat(F.lit("lost="), F.col("bucket")).alias("job"))
    return lg.read_logs(spark, path, "part-*"), jobs.unionByName(more)


_JOBS = f"""b AS (SELECT vec_id // {_PER_FILE} AS b, max(vec_id) AS top, count(*) AS n FROM embeddings GROUP BY 1),
  m AS (SELECT b, top, 'bucket=' || b AS job, CASE WHEN n > 2 THEN b % 3 WHEN n > 1 THEN least(b % 3, 1) ELSE 0 END AS marks FROM b)"""


@query(
    "scf_status",
    f"""WITH {_JOBS} SELECT job, marks, CASE marks WHEN 0 THEN 'not_converged' WHEN 1 THEN 'ok' ELSE 'repeated' END AS status FROM m
        UNION ALL SELECT 'lost=' || b, NULL, 'missing' FROM m""",
)
def scf_status(spark, sf):
    logs, jobs = _job_logs(spark, sf)
    return lg.scf_status(logs, jobs)


@query(
    "collect_results",
    f"""WITH {_JOBS}, l AS (SELECT m.*, CAST(embedding AS DOUBLE[]) AS e FROM m JOIN embeddings ON vec_id = top)
        SELECT job, CASE marks WHEN 0 THEN 'not_converged' WHEN 1 THEN 'ok' ELSE 'repeated' END AS status,
          CASE WHEN marks = 1 THEN round(e[1], 6) END AS energy, CASE WHEN marks = 1 THEN round(round(e[4], 5) * 120.5::DOUBLE / 1602.1766208, 6) END AS v_xy FROM l
        UNION ALL SELECT 'lost=' || b, 'missing', NULL, NULL FROM m""",
)
def collect_results(spark, sf):
    logs, jobs = _job_logs(spark, sf)
    out = lg.collect_results(logs, jobs)
    return out.select("job", "status", rnd("energy").alias("energy"), rnd(F.get("virial", F.lit(1))).alias("v_xy"))


@query(
    "scf_status_documents",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
       SELECT doc_id, count(*) FILTER (WHERE contains(line, 'the ')) AS marks,
         CASE count(*) FILTER (WHERE contains(line, 'the ')) WHEN 0 THEN 'not_converged' WHEN 1 THEN 'ok' ELSE 'repeated' END AS status FROM l GROUP BY 1""",
)
def scf_status_documents(spark, sf):
    docs = table(spark, sf, "documents")
    logs = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lg.scf_status(logs, mark="the ", by="doc_id")


@query(
    "outcar_status",
    """SELECT vec_id AS job, CASE WHEN vec_id % 7 = 6 THEN NULL ELSE vec_id % 2 END AS nsw, 4 AS nelm, 2 + vec_id % 4 AS steps,
         CASE WHEN vec_id % 7 = 6 THEN false WHEN vec_id % 2 = 1 THEN true ELSE vec_id % 3 > 0 AND 2 + vec_id % 4 < 4 END AS converged FROM embeddings""",
)
def outcar_status(spark, sf):
    v = F.col("vec_id")
    lines = F.concat(
        F.array(
            F.when(v % 7 == 6, "   NSW    =  ***    number of steps for IOM").otherwise(
                F.concat(F.lit("   NSW    =      "), _s(v % 2), F.lit("    number of steps for IOM"))
            ),
            F.lit("   NELM   =     4;   NELMIN=      2; NELMDL=      0     # of ELM steps"),
        ),
        F.transform(F.sequence(F.lit(1), (2 + v % 4).cast("int")), lambda i: F.concat(F.lit("---- Iteration    1("), _s(i), F.lit(") ----"))),
        F.when(v % 3 > 0, F.array(F.concat(F.lit("  "), F.lit(lg.EDIFF_MARK)))).otherwise(F.array().cast("array<string>")),
    )
    logs = _emb(spark, sf).select(v.alias("job"), F.posexplode(lines).alias("line_no", "line"))
    return lg.outcar_status(logs).select("job", "nsw", "nelm", "steps", "converged")


@query(
    "abacus_status",
    """SELECT vec_id AS job, 1 + vec_id % 6 AS steps, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE 1 END AS done, CASE WHEN vec_id % 2 = 0 THEN 4 ELSE 100 END AS nmax,
         NOT ((vec_id % 2 = 0 AND 1 + vec_id % 6 = 4) OR (vec_id % 2 = 1 AND 1 + vec_id % 6 = 100) OR vec_id % 5 = 0) AS converged FROM embeddings""",
)
def abacus_status(spark, sf):
    v = F.col("vec_id")
    lines = F.concat(
        F.transform(F.sequence(F.lit(1), (1 + v % 6).cast("int")), lambda i: F.concat(F.lit(" ALGORITHM ---- step "), _s(i))),
        F.when(v % 5 > 0, F.array(F.lit(" Total  Time  : 12 s"))).otherwise(F.array().cast("array<string>")),
    )
    emb = _emb(spark, sf)
    logs = emb.select(v.alias("job"), F.posexplode(lines).alias("line_no", "line"))
    inputs = emb.select(v.alias("job"), F.lit(0).alias("line_no"), F.when(v % 2 == 0, "scf_nmax  4").otherwise("ecutwfc 60").alias("line"))
    return lg.abacus_status(logs, inputs)


@query(
    "collect_cp2k",
    """WITH f AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
       SELECT vec_id, round(round(e[64], 6) * 27.211386245988, 6) AS energy, round(round(e[1], 6) * 51.4220674763259, 6) AS fx0, round(round(e[6], 6) * 51.4220674763259, 6) AS fz1,
         round(round(e[11], 5) * CASE WHEN vec_id % 2 = 0 THEN 0.0001::DOUBLE ELSE 1 END * ((10 + label) * 120) / 160.2176634, 7) AS v_xy FROM f""",
)
def collect_cp2k(spark, sf):
    e = lambda k: F.format_string("%.6f", F.get("e", F.lit(k)))
    s = lambda k: F.format_string("%.5f", F.get("e", F.lit(k)))
    new = F.concat_ws(
        "\n", F.concat(F.lit(" ENERGY| Total FORCE_EVAL ( QS ) energy [hartree]     "), e(63)), F.lit(" FORCES| Atomic forces [hartree/bohr]"),
        F.lit(" FORCES| Atom  x  y  z  |f|"),
        *[F.concat_ws("  ", F.lit(f" FORCES|  {a + 1}"), e(3 * a), e(3 * a + 1), e(3 * a + 2), F.lit("0.5")) for a in range(2)],
        F.lit(" FORCES| Sum  0 0 0"), F.lit(" STRESS| Analytical stress tensor [bar]"), F.lit(" STRESS|     x   y   z"),
        *[F.concat_ws("  ", F.lit(f" STRESS|  {c}"), s(9 + 3 * q), s(10 + 3 * q), s(11 + 3 * q)) for q, c in enumerate("xyz")],
    )
    old = F.concat_ws(
        "\n", F.concat(F.lit(" ENERGY| Total FORCE_EVAL ( QS ) energy (a.u.):     "), e(63)), F.lit(" ATOMIC FORCES in [a.u.]\n\n # Atom   Kind   Element   X   Y   Z"),
        *[F.concat_ws("  ", F.lit(f"     {a + 1}   1   Mo"), e(3 * a), e(3 * a + 1), e(3 * a + 2)) for a in range(2)],
        F.lit(" SUM OF ATOMIC FORCES  0 0 0 0"), F.lit(" STRESS| Analytical stress tensor [GPa]"),
        *[F.concat_ws("  ", F.lit(f" STRESS|  {c}"), s(9 + 3 * q), s(10 + 3 * q), s(11 + 3 * q)) for q, c in enumerate("xyz")],
    )
    lattice = F.array(10.0 + F.col("label"), *[F.lit(x) for x in (0.0, 0.0, 1.0, 10.0, 0.0, 0.0, 0.0, 12.0)])
    texts = _emb(spark, sf).select("vec_id", lattice.alias("lattice"), F.when(F.col("vec_id") % 2 == 0, new).otherwise(old).alias("text"))
    out = lg.collect_cp2k(texts)
    return out.select(
        "vec_id", rnd("energy").alias("energy"), rnd(F.get("forces", F.lit(0))["fx"]).alias("fx0"),
        rnd(F.get("forces", F.lit(1))["fz"]).alias("fz1"), rnd(F.get("virial", F.lit(1)), 7).alias("v_xy"),
    )


@query(
    "read_abacus_json",
    """WITH f AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
       SELECT round(e[64], 8) AS energy, 2 AS natoms, vec_id % 4 <> 3 AS converged, round(e[1] + e[4], 8) AS sx, round(e[7], 8) AS fx0, round(e[14] * 240 / 1602.1766208, 8) AS v_xy, 'Mo' AS s0 FROM f""",
)
def read_abacus_json(spark, sf):
    emb = _emb(spark, sf)
    row = lambda *k: F.array(*[F.get("e", F.lit(i)) for i in k])
    lits = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    steps = F.transform(F.sequence(F.lit(0), (F.col("vec_id") % 4 + 1).cast("int")), lambda i: F.struct(_s(i).cast("double").alias("energy")))
    out = F.struct(
        F.get("e", F.lit(63)).alias("energy"), F.array(lits(4, 0, 0), lits(0, 6, 0), lits(1, 0, 10)).alias("cell"),
        F.array(row(0, 1, 2), row(3, 4, 5)).alias("coordinate"), F.array(row(6, 7, 8), row(9, 10, 11)).alias("force"),
        F.array(row(12, 13, 14), row(13, 15, 16), row(14, 16, 17)).alias("stress"), steps.alias("scf"),
    )
    doc = F.to_json(F.struct(F.struct(F.lit(2).alias("natom"), F.array(F.lit("Mo"), F.lit("Te")).alias("label")).alias("init"), F.array(out).alias("output")))
    last = F.lead("vec_id").over(_by_bucket()).isNull()
    value = F.concat(F.when(F.col("vec_id") % _PER_FILE == 0, "[").otherwise(""), doc, F.when(last, "]").otherwise(","))
    path = si.derive_files(emb.select("bucket", "vec_id", value.alias("value")), "json", "vec_id")
    got = lg.read_abacus_json(spark, path, nmax=5, recursiveFileLookup="true")
    a = lambda k: F.get("atoms", F.lit(k))
    return got.select(
        rnd("energy", 8).alias("energy"), "natoms", "converged", rnd(a(0)["x"] + a(1)["x"], 8).alias("sx"), rnd(a(0)["fx"], 8).alias("fx0"),
        rnd(F.get("virial", F.lit(1)), 8).alias("v_xy"), a(0)["species"].alias("s0"),
    )


def _by_bucket():
    from pyspark.sql import Window

    return Window.partitionBy("bucket").orderBy("vec_id")  # 64 rows per bucket


# -- exports and ledgers -----------------------------------------------------------------------


@query(
    "export_frames",
    """WITH n AS (SELECT count(*) AS n FROM embeddings), i AS (SELECT unnest(range(2 * n)) AS export_id, n FROM n)
       SELECT export_id // 500 AS grp, count(*) AS frames, CAST(sum(export_id % n) AS BIGINT) AS vec_sum FROM i GROUP BY 1""",
)
def export_frames(spark, sf):
    path = scratch_path(spark, "export")
    fr = si.frames(spark, sf).withColumn("frame_no", F.col("frame_idx"))
    sk.export_frames(fr, path)
    sk.export_frames(fr, path)  # continues after the largest id
    vec = F.regexp_extract("value", r"vec=(\d+)", 1).cast("long")
    got = spark.read.parquet(path)
    return got.groupBy(F.col("grp").cast("long").alias("grp")).agg(F.count(F.lit(1)).alias("frames"), F.sum(vec).alias("vec_sum"))


@query(
    "audit_ledger",
    """SELECT event, status, count(*) AS n FROM (
         SELECT 'new' AS event, 'present' AS status FROM orders UNION ALL
         SELECT 'rebuilt', 'present' FROM orders WHERE o_orderstatus = 'F') GROUP BY 1, 2""",
)
def audit_ledger(spark, sf):
    path = scratch_path(spark, "audit")
    base = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("frame_idx"), "o_orderstatus", F.lit("present").alias("status")
    )
    sk.append_audit(base.withColumn("event", F.lit("new")).drop("o_orderstatus"), path)
    sk.append_audit(base.filter("o_orderstatus = 'F'").withColumn("event", F.lit("rebuilt")).drop("o_orderstatus"), path)
    return spark.read.parquet(path).groupBy("event", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "write_table",
    "SELECT event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1",
)
def write_table(spark, sf):
    path = scratch_path(spark, "table")
    rows = table(spark, sf, "events").select("event_id", F.col("event_type").alias("kind"), "value")
    sk.write_table(rows, path, "csv")
    got = spark.read.option("header", "true").schema("event_id long, kind string, value double").csv(path)
    return got.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("value"), 4).alias("total"))


@query(
    "with_source",
    f"SELECT 'bucket=' || (vec_id // {_PER_FILE}) AS source, count(*) AS lines FROM embeddings GROUP BY 1",
)
def with_source(spark, sf):
    root = si.derive_files(_emb(spark, sf).select("bucket", "vec_id", _s(F.col("vec_id")).alias("value")), "src", "vec_id")
    lines = ln.read_lines(spark, root, recursiveFileLookup="true")
    return lb.with_source(lines).groupBy("source").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "ingest_stream",
    f"""WITH {FRAMES_SQL} SELECT frame_idx AS vec, count(*) AS natoms, round(max(e[64]), 8) AS energy, round(sum(x), 6) AS sx FROM fatoms GROUP BY 1""",
)
def ingest_stream_query(spark, sf):
    fr = si.frames(spark, sf)
    # every frame comes twice, in files of consecutive frames
    copies = fr.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    text = fr_src.render_frames(copies.withColumn("file_ord", F.col("copy")))
    rows = text.select(
        F.concat(F.col("file_ord"), F.lit("-"), F.floor(F.col("frame_idx") / si.frames_per_file(fr))).alias("bucket"), "frame_idx", "value"
    )
    source = si.derive_files(rows, "stream", "frame_idx")
    target, state = scratch_path(spark, "stream-table"), scratch_path(spark, "stream-state")
    ingest_stream(spark, source, target, state, recursiveFileLookup="true", maxFilesPerTrigger=2).awaitTermination()
    got = spark.read.parquet(target)
    sx = F.aggregate("atoms", F.lit(0.0), lambda s, a: s + a["x"])
    return got.select(
        tx.info_value(F.col("info"), "vec").cast("long").alias("vec"), F.col("natoms").cast("long").alias("natoms"),
        rnd("energy", 8).alias("energy"), rnd(sx).alias("sx"),
    )

"""Duplicate frames: blocking on a fingerprint, strict match, first frame wins.

With equal fingerprints the rounded positions of two frames agree. Unless two
atoms of a frame sit closer than the match tolerance allows to tell apart, the
strict greedy match succeeds exactly when species agree position by position,
so grouping on a digest that ties species to positions gives the same answer
without comparing frames, and a hot group of copies collapses map-side. Only
crowded frames need the pairwise match. Positions that can be told apart split a
frame into zones; frames whose zones hold different species never match, so each
kind of zones is a group of its own. Inside a group the first frames in order are
settled among themselves and everything after them is matched with those that are
kept; their number grows fourfold from round to round, so rounds follow the
logarithm of the kept frames until a block has ``_MOST_LEADERS``, and no group is
ever collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cell
from ..functions.binding import let
from ..session import cut, setting
from .running import HOT_ROWS, HOT_ROWS_KEY, MAX_HOT

# Fingerprint digits and match tolerance (fractional).
QUANT = 1e6
MATCH_TOL = 1e-4

_BUCKET = 500  # in quantised units; more than twice the match tolerance plus rounding
FRAME = ("file_ord", "frame_idx")


def _fractional(inv: Column) -> Column:
    """Atoms with fractional coordinates, wrapped on periodic axes; Cartesian without a cell."""

    def one(a: Column) -> Column:
        xyz = [a["x"], a["y"], a["z"]]
        frac = cell.to_frac(xyz, inv)
        out = []
        for k in range(3):
            f = F.coalesce(frac[k], xyz[k])
            out.append(F.when(F.get("pbc", F.lit(k)), cell.wrap(f)).otherwise(f))
        return F.struct(
            a["species"].alias("s"), out[0].alias("u"), out[1].alias("v"), out[2].alias("w")
        )

    return F.transform("atoms", one)


def _q(c: Column) -> Column:
    return F.rint(c * QUANT).cast("long")


def _crowded(q: Column) -> Column:
    """Whether two atoms may sit too close for the tolerance to tell apart (never misses a case).

    Two such atoms share a bucket of at least one of the eight shifted grids.
    """
    half = _BUCKET // 2
    shifts = [F.array(*[F.lit(o) for o in (x, y, z)]) for x in (0, half) for y in (0, half) for z in (0, half)]

    def doubled(o: Column) -> Column:
        def code(a: Column) -> Column:
            b = [F.floor(F.pmod(a[c] + F.get(o, F.lit(k)), F.lit(int(QUANT))) / _BUCKET) for k, c in enumerate("uvw")]
            return b[0] * 4_000_000 + b[1] * 2_000 + b[2]

        return F.size(F.array_distinct(F.transform(q, code))) < F.size(q)

    return F.exists(F.array(*shifts), doubled)


def _signature(frac: Column, q: Column) -> Column:
    box = F.transform(F.coalesce("lattice", F.array().cast("array<double>")), _q)
    positions = F.array_sort(F.transform(q, lambda a: F.struct(a["u"], a["v"], a["w"])))
    species = F.array_sort(F.transform(q, lambda a: a["s"]))
    exact = F.struct(F.col("lattice"), F.col("pbc"), frac.alias("f"))
    return F.struct(
        F.sha2(F.to_json(F.struct(box.alias("b"), F.array_sort(q).alias("p"))), 256).alias("tied"),
        F.sha2(F.to_json(F.struct(box.alias("b"), species.alias("s"), positions.alias("p"))), 256).alias("loose"),
        F.sha2(F.to_json(exact), 256).alias("exact"),
        _crowded(q).alias("crowded"),
        frac.alias("frac"),
    )


def fingerprints(frames: DataFrame) -> DataFrame:
    """Add ``loose`` (fingerprint), ``tied`` (with species tied to positions), ``exact``, ``crowded`` and ``frac``."""

    def rounded(frac: Column) -> Column:
        return F.transform(
            frac, lambda a: F.struct(_q(a["u"]).alias("u"), _q(a["v"]).alias("v"), _q(a["w"]).alias("w"), a["s"].alias("s"))
        )

    sig = let(
        let(cell.cell_inverse(F.col("lattice")), _fractional),
        lambda frac: let(rounded(frac), lambda q: _signature(frac, q)),
    )
    return frames.withColumn("__sig", sig).select(*frames.columns, "__sig.*")


def copies(
    rows: DataFrame,
    content: str | Sequence[str],
    key: Sequence[str],
    by: Sequence[str] = (),
    hot_rows: int | None = None,
) -> DataFrame:
    """Rows whose content was seen at a smaller key: ``<key>, dup_of`` (the first such row).

    The first key per content is a map-side aggregate; only contents held by more
    than one row take part in the join back. Contents with very many copies are
    few, so they are looked up by broadcast and never meet in one task.
    """
    content = [content] if isinstance(content, str) else list(content)
    slim = rows.select(*by, *content, F.struct(*key).alias("__k"))
    group = [*by, *content]
    first = cut(
        slim.groupBy(*group)
        .agg(F.min("__k").alias("dup_of"), F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") > 1),
        "copies",
    )
    limit = hot_rows or int(setting(rows.sparkSession, HOT_ROWS_KEY, str(HOT_ROWS)))
    top, total = first.agg(F.max("__n"), F.sum("__n")).first()
    if top is not None and top > limit:
        limit = max(limit, total // MAX_HOT)
        hot = F.col("__n") > limit  # at most MAX_HOT contents
        many = F.broadcast(first.filter(hot))
        cold = slim.join(many.select(*group), group, "left_anti").join(first.filter(~hot), group)
        found = slim.join(many, group).unionByName(cold)
    else:
        found = slim.join(first, group)
    return found.filter(F.col("__k") != F.col("dup_of")).select("__k.*", "dup_of")


def _arrays(rows) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r["s"] for r in rows]), np.array([[r["u"], r["v"], r["w"]] for r in rows])


def _match(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> bool:
    """Strict match of two frames: greedy nearest unused atom of the same species."""
    (sx, px), (sy, py) = x, y
    free = np.ones(len(sy), bool)
    for s, p in zip(sx, px, strict=True):
        d = py - p
        far = np.abs(d - np.rint(d)).max(axis=1)
        far[~free | (sy != s)] = np.inf
        k = int(far.argmin())
        if far[k] > MATCH_TOL:
            return False
        free[k] = False
    return True


@F.pandas_udf(T.BooleanType())
def _same(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_match(_arrays(x), _arrays(y)) for x, y in zip(a, b, strict=True)])


_REACH = int(MATCH_TOL * QUANT) + 2  # rounded positions further apart than this never match


def _zone(rows) -> str:
    """Digest of the species in each cluster of positions that a match could mix up."""
    species, xyz = _arrays(rows)
    q = np.rint(xyz * QUANT).astype(np.int64) % int(QUANT)
    bins = -(-int(QUANT) // _REACH)
    home: dict[tuple, list[int]] = {}
    root = list(range(len(q)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k, (p, at) in enumerate(zip(q, q // _REACH, strict=True)):
        for step in np.ndindex(5, 5, 5):  # the last bin of an axis is narrow, so two bins to each side
            for j in home.get(tuple((at + step - 2) % bins), ()):
                d = np.abs(q[j] - p)
                if np.minimum(d, int(QUANT) - d).max() <= _REACH:
                    root[find(k)] = find(j)
        home.setdefault(tuple(at), []).append(k)
    zones: dict[int, list[int]] = {}
    for k in range(len(q)):
        zones.setdefault(find(k), []).append(k)
    told = sorted((sorted(map(tuple, q[m].tolist())), sorted(species[m].tolist())) for m in zones.values())
    return hashlib.sha1(repr(told).encode()).hexdigest()


@F.pandas_udf(T.StringType())
def _zones(frac: pd.Series) -> pd.Series:
    return pd.Series([_zone(rows) for rows in frac])


_MOST_LEADERS = 1024  # frames of a group that one task settles among themselves


def _settled(schema: T.StructType):
    """The frames of a block with the earlier frame each repeats, or none."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        kept, out = [], []
        for row in block.sort_values("r").itertuples():
            mine = _arrays(row.frac)
            hit = next((k for k, other in kept if _match(other, mine)), None)
            if hit is None:
                kept.append((row.k, mine))
            out.append(hit)
        return block.sort_values("r").assign(dup_of=out)[schema.names]

    return run


def _leader_rounds(rows: DataFrame, key: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``<key>, dup_of`` among crowded frames of equal fingerprint."""
    same = copies(rows, "exact", key, by)
    single = rows.join(same, list(key), "left_anti")
    group = [*by, "loose", "zone"]
    rest = cut(single.withColumn("zone", _zones("frac")).select(*group, F.struct(*key).alias("k"), "frac"), "crowded")
    kind = rest.schema["k"].dataType
    matched, take = None, 1
    while True:
        place = F.row_number().over(Window.partitionBy(*group).orderBy("k"))
        block = cut(rest.withColumn("r", place).where(F.col("r") <= take), "block")
        schema = T.StructType([*block.select(*group, "k", "frac").schema.fields, T.StructField("dup_of", kind)])
        settled = cut(block.groupBy(*group).applyInPandas(_settled(schema), schema), "settled")
        leaders = settled.where("dup_of IS NULL").select(*group, F.col("k").alias("lead"), F.col("frac").alias("frac_lead"))
        others = rest.join(block.select("k"), "k", "left_anti")
        met = others.join(leaders, group).where(_same("frac_lead", "frac"))
        hits = cut(met.groupBy("k").agg(F.min("lead").alias("dup_of")), "hits")
        found = settled.where("dup_of IS NOT NULL").select("k", "dup_of").union(hits)
        matched = found if matched is None else matched.union(found)
        rest = cut(others.join(hits, "k", "left_anti"), "crowded")
        if rest.isEmpty():
            break
        take = min(take * 4, _MOST_LEADERS)
    # a copy of a dropped frame is a duplicate of what that frame duplicates
    first = matched.select(F.col("k").alias("dup_of"), F.col("dup_of").alias("root"))
    copied = same.join(first, "dup_of", "left").select(
        F.struct(*key).alias("k"), F.coalesce("root", "dup_of").alias("dup_of")
    )
    return matched.unionByName(copied).select("k.*", "dup_of")


def dup_report(frames: DataFrame, key: Sequence[str] = FRAME, by: Sequence[str] = ()) -> DataFrame:
    """Dropped frames and the kept frame each one repeats; ``by=["file"]`` stays inside files."""
    crowded = F.col("crowded")
    keep = list(dict.fromkeys([*by, *key]))
    # one pass over the frames leaves a slim table; positions stay only where they are compared
    marked = cut(
        fingerprints(frames).select(
            *keep, "tied", "crowded", *[F.when(crowded, F.col(c)).alias(c) for c in ("loose", "exact", "frac")]
        ),
        "fingerprints",
    )
    plain = copies(marked.filter(~crowded), "tied", key, by)
    close = marked.filter(crowded)
    if close.isEmpty():
        return plain
    return plain.unionByName(_leader_rounds(close, key, by))


def dedup(frames: DataFrame, key: Sequence[str] = FRAME, by: Sequence[str] = ()) -> DataFrame:
    """H2: frames without later duplicates."""
    return frames.join(dup_report(frames, key, by).select(*key), list(key), "left_anti")


def dups(frames: DataFrame, key: Sequence[str] = FRAME, by: Sequence[str] = ()) -> DataFrame:
    """H5: the duplicates that :func:`dedup` drops."""
    return frames.join(dup_report(frames, key, by).select(*key), list(key), "left_semi")


def index_map(frames: DataFrame, report: DataFrame, file: str = "file_ord", idx: str = "frame_idx") -> DataFrame:
    """H3: old frame number -> number after removal inside its file (-1 if dropped)."""
    from .running import Ordered

    dropped = report.select(file, idx).withColumn("__d", F.lit(1))
    marked = frames.select(file, idx).join(dropped, [file, idx], "left").withColumn("kept", F.col("__d").isNull())
    o = Ordered(marked, [file], [idx]).running_sum({"__k": F.col("kept").cast("long")})
    return o.result().select(file, idx, F.when(F.col("kept"), F.col("__k") - 1).otherwise(-1).alias("new_idx"))


def cross_dups(frames: DataFrame, key: Sequence[str] = FRAME, file: str = "file_ord") -> DataFrame:
    """Frames of later files, already unique inside their file, that an earlier file holds."""
    return dup_report(dedup(frames, key, [file]), key)


def merge_dedup(frames: DataFrame, key: Sequence[str] = FRAME, file: str = "file_ord") -> DataFrame:
    """H4: unique frames of the first file, then those of later files not seen before."""
    return dedup(dedup(frames, key, [file]), key)


def merge(*frames: DataFrame) -> DataFrame:
    """H1: ordered concatenation; ``file_ord`` of later inputs continues after earlier ones."""
    out, base = None, 0
    for df in frames:
        top = df.agg(F.max("file_ord")).first()[0]
        if top is None:
            continue  # an empty input adds nothing
        shifted = df.withColumn("file_ord", (F.col("file_ord") + base).cast("int"))
        out = shifted if out is None else out.unionByName(shifted, allowMissingColumns=True)
        base += top + 1
    return out if out is not None else frames[0]


def same_structure(a: DataFrame, b: DataFrame, key: Sequence[str] = FRAME, atol: float = 1e-6) -> DataFrame:
    """H7: ``same`` per frame: composition, cell and, per species, the multiset of positions."""

    def shaped(df: DataFrame, tag: str) -> DataFrame:
        with_inv = df.withColumn("inv", cell.cell_inverse(F.col("lattice")))

        def one(p: Column) -> Column:
            f = cell.to_frac([p["x"], p["y"], p["z"]], F.col("inv"))
            r = [F.rint(c * 1e8) / 1e8 for c in f]
            return F.struct(p["species"].alias("s"), r[0].alias("u"), r[1].alias("v"), r[2].alias("w"))

        return with_inv.select(
            *key, F.col("lattice").alias(f"cell_{tag}"), F.array_sort(F.transform("atoms", one)).alias(f"p_{tag}")
        )

    def near(x: Column, y: Column) -> Column:
        return F.abs(x - y) <= F.lit(atol) + F.lit(1e-5) * F.abs(y)

    j = shaped(a, "a").join(shaped(b, "b"), list(key))
    cells = F.forall(F.zip_with("cell_a", "cell_b", near), lambda t: t)
    atoms = F.forall(
        F.zip_with(
            "p_a",
            "p_b",
            lambda x, y: (x["s"] == y["s"]) & near(x["u"], y["u"]) & near(x["v"], y["v"]) & near(x["w"], y["w"]),
        ),
        lambda t: F.coalesce(t, F.lit(False)),
    )
    return j.select(*key, (cells & (F.size("p_a") == F.size("p_b")) & atoms).alias("same"))

"""Descriptor vectors: means, nearest references, farthest points, principal components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

_BLOCK = 1024  # vectors per packed block
_VISITS = 4096  # samples with a group each that leave a task at a time
_BROADCAST_BYTES = 32 << 20  # a reference up to this size goes to every task
_RECUT = 2048  # picks carried in task closures before the table is written again
_POOL = 512  # candidates looked at per farthest-point pass


def with_descriptor(frames: DataFrame, load: Callable[[], Callable], dim_col: str = "vec") -> DataFrame:
    """L1: descriptor column from a user model, loaded once per task.

    ``load()`` returns a function from a pandas batch of frames to an array of
    vectors, one per row.
    """
    schema = T.StructType([*frames.schema.fields, T.StructField(dim_col, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            yield pdf.assign(**{dim_col: [np.asarray(v, dtype=float).tolist() for v in model(pdf)]})

    return frames.mapInPandas(run, schema)


def mean_descriptor(rows: DataFrame, by: Sequence[str], vec: str = "vec") -> DataFrame:
    """Mean vector per frame of per-atom vectors; whole vectors are summed up before they are shuffled."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    vectors = rows.where(F.col(vec).isNotNull()).select(*by, array_to_vector(F.col(vec).cast("array<double>")).alias("__v"))
    means = vectors.groupBy(*by).agg(Summarizer.mean(F.col("__v")).alias("__v"))
    return means.select(*by, vector_to_array("__v").alias(vec))


def _as_matrix(col) -> np.ndarray:
    return np.array([np.asarray(v, dtype=float) for v in col])


def _dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, one reference row at a time to bound memory."""
    out = np.empty((len(a), len(b)))
    for j in range(len(b)):
        d = a - b[j]
        out[:, j] = np.sqrt((d * d).sum(axis=1))
    return out


def _least_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    best = np.full(len(a), np.inf)
    for row in b:
        d = a - row
        np.minimum(best, np.sqrt((d * d).sum(axis=1)), out=best)
    return best


def nearest_reference(
    sample: DataFrame,
    reference: DataFrame,
    key: Sequence[str],
    vec: str = "vec",
    broadcast_bytes: int = _BROADCAST_BYTES,
    pivots: int = 64,
) -> DataFrame:
    """Distance of each sample to its nearest reference vector, ``<key>, dmin``.

    A reference of checked size is broadcast. A larger one is grouped around
    pivots; a sample visits only the groups the triangle inequality cannot rule
    out, in packed blocks of bounded size. Both ways are exact.
    """
    spark = sample.sparkSession
    keyed = sample.select(*key, F.col(vec).cast("array<double>").alias("vec"))
    ref = reference.select(F.col(vec).cast("array<double>").alias("vec"))
    schema = T.StructType([*keyed.drop("vec").schema.fields, T.StructField("dmin", T.DoubleType())])
    names = list(key)
    dim = ref.select(F.size("vec")).first()
    if dim is None:
        return keyed.select(*key, F.lit(float("inf")).alias("dmin"))
    fit = max(1, broadcast_bytes // (8 * dim[0]))
    head = ref.limit(fit + 1).count()
    if head <= fit:
        shared = spark.sparkContext.broadcast(_as_matrix(ref.toPandas()["vec"]))

        def scan(batches):
            for pdf in batches:
                d = _least_distance(_as_matrix(pdf["vec"]), shared.value)
                yield pdf[names].assign(dmin=d)

        return keyed.mapInPandas(scan, schema)
    return _nearest_by_groups(keyed, ref, names, schema, pivots)


def _nearest_by_groups(keyed, ref, names, schema, pivots) -> DataFrame:
    spark = keyed.sparkSession
    # pivots only steer the grouping; any choice gives the same distances
    chosen = ref.orderBy(F.xxhash64("vec")).limit(pivots)
    piv = spark.sparkContext.broadcast(_as_matrix(chosen.toPandas()["vec"]))

    def assign(batches):
        for pdf in batches:
            d = _dist(_as_matrix(pdf["vec"]), piv.value)
            cell = d.argmin(axis=1)
            yield pd.DataFrame({"cell": cell, "r": d[np.arange(len(d)), cell], "vec": pdf["vec"]})

    # equal vectors fold into one, however many there are
    celled = cut(ref.dropDuplicates(["vec"]).mapInPandas(assign, "cell int, r double, vec array<double>"), "reference")
    stats = celled.groupBy("cell").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count(F.lit(1)).alias("n"))
    rows = stats.collect()  # one row per pivot
    lo, hi, blocks = np.full(pivots, np.inf), np.full(pivots, -np.inf), np.zeros(pivots, int)
    for r in rows:
        lo[r["cell"]], hi[r["cell"]] = r["lo"], r["hi"]
        blocks[r["cell"]] = -(-r["n"] // _BLOCK)
    limits = spark.sparkContext.broadcast((lo, hi, blocks))
    block_of = F.pmod(F.xxhash64("vec"), F.get(F.array(*[F.lit(int(max(b, 1))) for b in blocks]), F.col("cell")))
    packed = celled.groupBy("cell", block_of.alias("block")).agg(F.collect_list("vec").alias("ref"))

    visits = T.StructType(
        [*[f for f in schema.fields if f.name != "dmin"], T.StructField("cell", T.IntegerType()),
         T.StructField("vec", T.ArrayType(T.DoubleType()))]
    )
    asked = keyed.mapInPandas(lambda batches: _visits(batches, names, piv.value, limits.value), visits)
    # samples travel in packs of bounded size; a pack meets each block of a group it visits
    pack = F.pmod(F.xxhash64(*names), F.lit(max(1, -(-keyed.count() // _BLOCK))))
    packs = asked.groupBy("cell", pack.alias("pack")).agg(F.collect_list(F.struct(*names, "vec")).alias("rows"))
    n_blocks = F.get(F.array(*[F.lit(int(max(b, 1))) for b in blocks]), F.col("cell"))
    packs = packs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (n_blocks - 1).cast("long"))))
    parts = packs.join(packed, ["cell", "block"]).select("rows", "ref").mapInArrow(lambda batches: _measured(batches, names), schema)
    return parts.groupBy(*names).agg(F.min("dmin").alias("dmin"))


def _visits(batches: Iterator[pd.DataFrame], names: list[str], piv: np.ndarray, limits: tuple) -> Iterator[pd.DataFrame]:
    """Samples with the groups they visit, ``<names>, cell, vec``, some thousand rows at a time."""
    lo, hi, blocks = (v[: len(piv)] for v in limits)
    for pdf in batches:
        d = _dist(_as_matrix(pdf["vec"]), piv)
        upper = (d + lo).min(axis=1)
        lower = np.maximum(np.maximum(d - hi, lo - d), 0)
        # a little slack keeps rounding from ruling out the true nearest
        i, c = np.nonzero((lower <= upper[:, None] * (1 + 1e-12) + 1e-12) & (blocks > 0))
        for at in range(0, max(len(i), 1), _VISITS):
            some = pdf.iloc[i[at : at + _VISITS]]
            yield some[names].assign(cell=c[at : at + _VISITS].astype("int32"), vec=some["vec"])


def _matrix(lists: pa.Array) -> np.ndarray:
    """The vectors of an Arrow column as rows, without a Python object for each."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _measured(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Least distance of each sample of a pack to the block it meets, one pack at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            rows, ref = (batch.column(c).slice(k, 1).flatten() for c in ("rows", "ref"))
            d = _least_distance(_matrix(rows.field("vec")), _matrix(ref))
            yield pa.RecordBatch.from_arrays([*[rows.field(n) for n in names], pa.array(d)], [*names, "dmin"])


def farthest_points(
    sample: DataFrame,
    vec: str,
    key: Sequence[str],
    count: int | None = None,
    min_distance: float | None = None,
    min_select: int = 1,
    reference: DataFrame | None = None,
    pool: int = _POOL,
) -> DataFrame:
    """Exact farthest-point order, ``step, <key>, dist``.

    Stops at ``count`` picks, or when no sample is farther than ``min_distance``
    from all picks (after at least ``min_select``). Without a reference the first
    pick is the smallest key. Ties go to the smaller key; nothing is picked twice.

    Distances to the picked set only shrink, so each pass over the data takes
    the ``pool`` farthest candidates and keeps picking among them for as long as
    the best one still beats everything outside the pool. The picks are those of
    the one-at-a-time loop, with far fewer passes.
    """
    if count is None and min_distance is None:
        raise ValueError("give a count or a minimum distance")
    spark = sample.sparkSession
    names = list(key)
    schema = T.StructType(
        [
            T.StructField("step", T.IntegerType()),
            *sample.select(*names).schema.fields,
            T.StructField("dist", T.DoubleType()),
        ]
    )
    k = F.struct(*names)
    rows = sample.select(k.alias("k"), F.to_json(k).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    picks: list[tuple] = []
    since: list[tuple[str, np.ndarray]] = []  # picks not yet in the written table
    if reference is not None and not reference.isEmpty():
        init = nearest_reference(rows, reference.select(F.col(vec).alias("vec")), ["id"])
        start = rows.join(init, "id").select("k", "id", "vec", "dmin")
    else:
        first = rows.orderBy("k").first()
        if first is None:
            return spark.createDataFrame([], schema)
        picks.append((first["k"], None))
        since.append((first["id"], np.array(first["vec"])))
        start = rows.withColumn("dmin", F.lit(float("inf")))
    base = cut(start, "farthest")

    def current() -> DataFrame:
        if not since:
            return base
        ids, matrix = {i for i, _ in since}, np.array([v for _, v in since])

        def run(batches):
            for pdf in batches:
                d = np.minimum(pdf["dmin"].to_numpy(), _least_distance(_as_matrix(pdf["vec"]), matrix))
                d[pdf["id"].isin(ids).to_numpy()] = -1.0
                yield pdf.assign(dmin=d)

        return base.mapInPandas(run, base.schema)

    done = False
    while not done:
        if len(since) >= _RECUT:
            base, since = cut(current(), "farthest"), []
        cand = current().orderBy(F.desc("dmin"), "k").limit(pool).collect()
        if not cand:
            break
        v = np.array([c["vec"] for c in cand])
        d = np.array([c["dmin"] for c in cand])
        keys = [tuple(c["k"]) for c in cand]
        rank = np.empty(len(cand), int)
        rank[sorted(range(len(cand)), key=keys.__getitem__)] = np.arange(len(cand))
        # rows outside the pool come after its last row
        edge = (d[-1], rank[-1]) if len(cand) == pool else (-np.inf, 0)
        while True:
            if count is not None and len(picks) >= count:
                done = True
                break
            top = d.max()
            tied = np.nonzero(d == top)[0]
            i = int(tied[rank[tied].argmin()])
            if top < edge[0] or (top == edge[0] and rank[i] > edge[1]):
                break
            enough = min_distance is not None and not top > min_distance and len(picks) >= min_select
            if top < 0 or enough:
                done = True
                break
            picks.append((cand[i]["k"], float(top)))
            since.append((cand[i]["id"], v[i]))
            step = v - v[i]
            d = np.where(d < 0, d, np.minimum(d, np.sqrt((step * step).sum(axis=1))))
            d[i] = -1.0
    return spark.createDataFrame([(n, *tuple(p), dist) for n, (p, dist) in enumerate(picks)], schema)


def coreset_points(
    sample: DataFrame, vec: str, key: Sequence[str], count: int, per_part: int = 8192, part: Column | None = None
) -> DataFrame:
    """G12, approximate for very many samples: farthest points of each part, then over the union, ``step, <key>, dist``.

    Parts hold about ``per_part`` samples and follow the keys (``part``, or their hash), not Spark's partitions, and a
    part is worked through in the order of its keys: the picks are the same for any partitioning. While the union is
    larger than a part it is divided again. Picks of a part cover it within twice the best radius, so after L divisions
    the result covers all samples within 2 L + 2 times the radius of the best ``count`` centres.
    """
    names = list(key)
    rows = sample.select(*names, F.col(vec).cast("array<double>").alias("vec"))
    schema = rows.schema

    def spread(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values(names, ignore_index=True)
        v = _as_matrix(chunk["vec"])
        d, take, at = np.full(len(v), np.inf), [], 0
        while len(take) < min(count, len(v)):
            take.append(at)
            step = v - v[at]
            d = np.minimum(d, np.sqrt((step * step).sum(axis=1)))
            d[take] = -1.0
            at = int(d.argmax())
        return chunk.iloc[sorted(take)][schema.names]

    n, level = rows.count(), 0
    while n > per_part or (part is not None and not level):
        parts = -(-n // per_part)
        own = part if part is not None and not level else F.pmod(F.xxhash64(*names, F.lit(level)), F.lit(parts))
        picked = cut(rows.withColumn("__part", own).groupBy("__part").applyInPandas(lambda c: spread(c.drop(columns="__part")), schema), "coreset")
        left = picked.count()
        rows, level = picked, level + 1
        if left == n:  # no part has more samples than picks
            break
        n = left
    return farthest_points(rows, "vec", names, count=count)


class _Moments:
    """Sums over distributed vectors: mean, total variance, and the covariance times a thin matrix."""

    def __init__(self, vectors: DataFrame):
        self.vectors = vectors
        found = {r["i"]: r["s"] for r in self._sums(lambda x: np.concatenate([x.sum(axis=0), [len(x)]]))}
        self.n = int(found[len(found) - 1]) if found else 0
        self.mean = np.array([found[i] for i in range(len(found) - 1)]) / max(self.n, 1)
        self.total = None

    def _sums(self, of: Callable[[np.ndarray], np.ndarray]) -> list:
        """``of`` each batch as one flat array, summed up; as many rows as it has entries come back."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                lists = batch.column("v")
                width = lists.value_lengths().to_numpy()
                if width.min() != width.max():
                    raise ValueError("vectors of different lengths")
                new = of(lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                acc = new if acc is None else acc + new
            if acc is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(acc))), pa.array(acc)], ["i", "s"])

        return self.vectors.mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()

    def times(self, q: np.ndarray) -> np.ndarray:
        """Covariance times ``q``."""
        mean = self.mean
        shared = self.vectors.sparkSession.sparkContext.broadcast(q)

        def part(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return np.concatenate([(c.T @ (c @ shared.value)).ravel(), [(c * c).sum()]])

        found = self._sums(part)
        flat = np.zeros(len(found))
        for r in found:
            flat[r["i"]] = r["s"]
        self.total = flat[-1] / max(self.n - 1, 1)
        return flat[:-1].reshape(q.shape) / max(self.n - 1, 1)


def principal_components(vectors: DataFrame, k: int, tolerance: float = 1e-10, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Leading ``k`` axes (columns), their variances, the total variance and the mean of distributed vectors (``v``).

    Randomised block Krylov iteration: each pass multiplies a thin block by the covariance, and the axes come from the
    space that all blocks span, until their residuals are below the tolerance. Only matrices of a few columns reach the
    driver. An axis points to where its largest entry is positive.
    """
    m = _Moments(vectors)
    d = len(m.mean)
    k, width = min(k, d), min(d, k + 8)
    if not d:
        return np.zeros((0, 0)), np.zeros(0), 0.0, m.mean
    most = max(96, 8 * width)  # columns kept
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    while True:
        new = m.times(block)
        basis, image = np.hstack([basis, block]), np.hstack([image, new])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        lead = turn[:, ::-1][:, :k]
        axes, along, values = basis @ lead, image @ lead, values[::-1]
        gap = np.linalg.norm(along - axes * values[:k], axis=0)
        if gap.max() <= tolerance * max(values[0], 1e-300) or basis.shape[1] >= d:
            break
        block = new  # what is new in it holds the residuals of all axes so far
        for _ in range(2):
            block = block - basis @ (basis.T @ block)
            u, size, _ = np.linalg.svd(block, full_matrices=False)
            block = u[:, size > 1e-12 * max(values[0], 1e-300)]
        if basis.shape[1] + width > most:  # go on from the best directions
            keep = turn[:, ::-1][:, : 2 * width]
            basis, image = basis @ keep, image @ keep
        block = block[:, : d - basis.shape[1]]
        if not block.shape[1]:
            break
    sign = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    return axes * np.where(sign == 0, 1, sign), np.maximum(values[:k], 0), m.total, m.mean


def pca(df: DataFrame, k: int = 2, fit_on: DataFrame | None = None, vec: str = "vec") -> tuple[DataFrame, list[float]]:
    """Centred projection ``pc`` on ``k`` components fitted on ``fit_on``, and the shares of the variance."""
    source = (fit_on if fit_on is not None else df).where(F.col(vec).isNotNull())
    vectors = cut(source.select(F.col(vec).cast("array<double>").alias("v")), "vectors")
    axes, values, total, mean = principal_components(vectors, k)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def project(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else ((np.asarray(x, float) - mean) @ axes).tolist() for x in v])

    return df.withColumn("pc", project(F.col(vec).cast("array<double>"))), [float(v) / total if total else 0.0 for v in values]

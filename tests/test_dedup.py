import numpy as np
from framebasin.operators import dedup as dd
from helpers import frame, frames_df

L = np.eye(3) * 10.0


def greedy(rows):
    """Fingerprint groups and strict greedy match, first frame wins."""

    def frac(r):
        f = np.array([a[2:5] for a in r[5]]) @ np.linalg.inv(np.array(r[3]).reshape(3, 3))
        return f - np.floor(f)

    def fp(r):
        q = [tuple(np.rint(p * 1e6).astype(int)) for p in frac(r)]
        return r[2], tuple(sorted(a[1] for a in r[5])), tuple(np.rint(np.array(r[3]) * 1e6)), tuple(sorted(q))

    def same(x, y):
        fx, fy, used = frac(x), frac(y), set()
        for i, a in enumerate(x[5]):
            best = None
            for j, b in enumerate(y[5]):
                if j in used or a[1] != b[1]:
                    continue
                d = fx[i] - fy[j]
                d = np.abs(d - np.rint(d)).max()
                if best is None or d < best[0]:
                    best = (d, j)
            if best is None or best[0] > 1e-4:
                return False
            used.add(best[1])
        return True

    groups, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        kept = groups.setdefault(fp(r), [])
        hit = next((k for k in kept if same(k, r)), None)
        if hit is None:
            kept.append(r)
        else:
            out[(r[0], r[1])] = (hit[0], hit[1])
    return out


def report(spark, rows):
    got = dd.dup_report(frames_df(spark, rows)).collect()
    return {(r["file_ord"], r["frame_idx"]): (r["dup_of"]["file_ord"], r["dup_of"]["frame_idx"]) for r in got}


def test_plain_and_crowded_frames_match_greedy_search(spark):
    rng = np.random.default_rng(2)
    rows, k = [], 0
    for base in range(6):
        xyz = rng.uniform(0, 10, (5, 3))
        names = ["Mo", "Te", "Li", "Te", "Mo"]
        if base % 2:  # two atoms closer than the match tolerance
            xyz[1] = xyz[0] + [4e-4, 0, 0]
        variants = [
            (names, xyz),
            (names, xyz),
            (names[::-1], xyz[::-1]),
            (names, xyz + [10.0, 0, -20.0]),
            ([names[1], names[0], *names[2:]], xyz),
            (names, xyz + [5e-4, 0, 0]),
            (names, xyz + [4e-7, 0, 0]),
        ]
        for names_v, xyz_v in variants:
            rows.append(frame(k % 3, k, names_v, xyz_v, L))
            k += 1
    want = greedy(rows)
    got = report(spark, rows)
    assert got == want and len(want) > 10


def test_a_group_of_many_kept_frames(spark, monkeypatch):
    """One fingerprint, many arrangements of species that no tolerance makes equal, and chains that match only nearby."""
    rng = np.random.default_rng(4)
    sites = np.concatenate([rng.uniform(0, 9, (5, 3)), [[9, 9, 9]]])
    sites = np.concatenate([sites, sites + [4e-4, 0, 0]])  # every site twice, closer than the tolerance
    # a chain whose neighbours match and whose ends do not
    chain = np.array([[5.0 + 7e-4 * k, 5, 5] for k in range(6)])
    rows = []
    for k in range(150):
        names = [["Mo", "Te", "Li"][v] for v in rng.permutation([0] * 4 + [1] * 4 + [2] * 4)]
        rows.append(frame(0, len(rows), names, sites, L))
    for k in range(60):
        names = [["Mo", "Te"][v] for v in rng.permutation([0, 0, 0, 1, 1, 1])]
        rows.append(frame(1, len(rows), names, chain, L))
    monkeypatch.setattr(dd, "_MOST_LEADERS", 8)
    want = greedy(rows)
    assert report(spark, rows) == want and 10 < len(want) < 200


def test_dedup_is_idempotent_and_counts_up(spark):
    xyz = np.array([[1.0, 2, 3], [4, 5, 6]])
    rows = [frame(0, i, ["Mo", "Te"], xyz + (0 if i % 2 else 0.5), L) for i in range(8)]
    df = frames_df(spark, rows)
    once = dd.dedup(df)
    assert sorted(r["frame_idx"] for r in once.collect()) == [0, 1]
    assert dd.dedup(once).count() == 2
    assert dd.dups(df).count() == 6
    new = {r["frame_idx"]: r["new_idx"] for r in dd.index_map(df, dd.dup_report(df)).collect()}
    assert new == {0: 0, 1: 1, **{i: -1 for i in range(2, 8)}}


def test_hot_group_of_copies(spark):
    xyz = np.array([[1.0, 2, 3], [1.0001, 2, 3]])  # crowded, all equal
    rows = [frame(0, i, ["Mo", "Te"], xyz, L) for i in range(200)]
    got = report(spark, rows)
    assert len(got) == 199 and set(got.values()) == {(0, 0)}


def test_files_one_after_another(spark):
    a, b = np.array([[1.0, 2, 3]]), np.array([[5.0, 5, 5]])
    rows = [frame(0, 0, ["Mo"], a, L), frame(0, 1, ["Mo"], a, L), frame(1, 0, ["Mo"], b, L), frame(1, 1, ["Mo"], a, L), frame(1, 2, ["Mo"], b, L)]
    df = frames_df(spark, rows)
    inside = {(r["file_ord"], r["frame_idx"]) for r in dd.dup_report(df, by=["file_ord"]).collect()}
    assert inside == {(0, 1), (1, 2)}
    cross = {(r["file_ord"], r["frame_idx"]) for r in dd.cross_dups(df).collect()}
    assert cross == {(1, 1)}
    assert {(r["file_ord"], r["frame_idx"]) for r in dd.merge_dedup(df).collect()} == {(0, 0), (1, 0)}


def test_contents_with_many_copies_take_the_broadcast_route(spark):
    rows = [(i, "a" if i % 3 else f"t{i % 12}") for i in range(600)]
    df = spark.createDataFrame(rows, "k long, c string").repartition(6)
    want = {}
    first = {}
    for k, c in rows:
        if c in first:
            want[k] = first[c]
        first.setdefault(c, k)
    for limit in (100, 10_000):
        got = {r["k"]: r["dup_of"]["k"] for r in dd.copies(df, "c", ["k"], hot_rows=limit).collect()}
        assert got == want

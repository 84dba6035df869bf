"""Sharding, the manifest and lexical search against brute force and SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from conftest_llm import DOCS, doc_row, prose
from framebasin.llm import lexical, manifest, sharding
from pyspark.sql import functions as F


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


# sharding


def shards_of(df):
    return [r.asDict() for r in df.select("doc_id", "text", "size", "shard", "slot").collect()]


def check_slots(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))


def test_packer_takes_the_highest_dot_product():
    rng = np.random.default_rng(3)
    free, weights = np.ones((5, 3)), (4.0, 2.0, 1.0)
    packer = sharding.Packer(free, weights)
    for _ in range(300):
        share = tuple(rng.random(3) / 50)
        dots = [sum(f * w * s for f, w, s in zip(row, weights, share, strict=True)) for row in free]
        fits = [all(f >= s for f, s in zip(row, share, strict=True)) for row in free]
        allowed = [k for k in range(5) if fits[k]] or list(range(5))
        shard, _ = packer.put(share, 1)
        assert dots[shard] == pytest.approx(max(dots[k] for k in allowed), abs=1e-12)
        free[shard] -= share


@pytest.mark.parametrize("per_cell", [8192, 20])
def test_shards_hold_equal_bytes_and_whole_groups(spark, per_cell):
    rows = [doc_row(k, prose(k % 700, 5 + k % 90)) for k in range(900)]
    docs = spark.createDataFrame(rows, DOCS)
    got = shards_of(sharding.place(docs, sharding.Plan(shards=6, per_cell=per_cell)))
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted((r[0], r[1]) for r in rows)
    assert all(r["size"] == len(r["text"].encode()) + 1 for r in got)
    check_slots(got)
    home = defaultdict(set)
    for r in got:
        home[r["text"]].add(r["shard"])
    assert all(len(s) == 1 for s in home.values())
    for measure in (lambda r: r["size"], lambda r: len(r["text"].split()), lambda r: 1):
        loads = Counter()
        for r in got:
            loads[r["shard"]] += measure(r)
        assert max(loads.values()) - min(loads.values()) <= 0.05 * max(loads.values())
    again = shards_of(sharding.place(docs.repartition(7), sharding.Plan(shards=6, per_cell=per_cell)))
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_a_group_above_a_shard_is_dealt_into_pieces(spark):
    rows = [doc_row(k, "the same words again") for k in range(500)] + [doc_row(1000 + k, prose(k, 6)) for k in range(600)]
    got = shards_of(sharding.place(spark.createDataFrame(rows, DOCS), sharding.Plan(shards=8)))
    check_slots(got)
    loads = Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    assert len(loads) == 8 and max(loads.values()) - min(loads.values()) <= 0.05 * max(loads.values())


def test_shards_of_odd_rows(odd_docs, odd_rows, no_docs):
    out = sharding.place(odd_docs, sharding.Plan(shards=3))
    assert set(out.columns) == {*odd_docs.columns, "shard", "slot"}
    got = out.collect()
    check_slots(shards_of(out))
    assert sorted(map(repr, ((r.doc_id, r.text, r._id, r.label) for r in got))) == sorted(map(repr, ((r[0], r[1], r[5], r[9]) for r in odd_rows)))
    assert {r["size"] for r in got if r.text is None} == {1}
    assert sharding.place(no_docs).count() == 0


def test_written_shards_are_in_slot_order(spark, odd_docs, tmp_path):
    sharding.write_shards(sharding.place(odd_docs, sharding.Plan(shards=3)), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == odd_docs.count()
    for f in (tmp_path / "s").glob("shard=*/*.parquet"):
        slots = [r.slot for r in spark.read.parquet(str(f)).collect()]
        assert slots == list(range(slots[0], slots[0] + len(slots)))


# manifest


def leaf_of(row, low=False):
    parts = []
    for k, v in enumerate((row[0], row[3], row[2], row[4], lower(row[1]) if low and row[1] is not None else row[1])):
        parts.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def sha(texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def proofs(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of every row, tree by tree in plain Python."""
    by_source = defaultdict(list)
    for r in rows:
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        by_source[r[3]].append((r[0] is not None, r[0] or 0, leaf_of(r), leaf_of(r, changed), r[0]))

    def climb(digests, place, x):
        path = []
        while len(digests) > 1:
            run = digests[place // 16 * 16 : place // 16 * 16 + 16]
            at = place % 16
            path += run[:at] + run[at + 1 :]
            x = sha([*run[:at], x, *run[at + 1 :]])
            digests = [sha(digests[k : k + 16]) for k in range(0, len(digests), 16)]
            place //= 16
        return digests[0], path, x

    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [sorted(by_source[s]) for s in sources]
    tops = [climb([m[2] for m in t], 0, "")[0] for t in trees]
    out = []
    for number, tree in enumerate(trees):
        for place, m in enumerate(tree):
            subroot, low, x = climb([n[2] for n in tree], place, m[3])
            root, high, x = climb(tops, number, x)
            out.append((m[4], m[2], subroot, root, sha(low + high), x, x == root))
    return sorted(out, key=repr)


def audited(docs):
    return sorted((tuple(r) for r in manifest.audit_lowered(docs).collect()), key=repr)


def test_manifest_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    assert audited(odd_docs) == proofs(odd_rows)
    assert audited(no_docs) == []
    for few in (odd_rows[:1], [doc_row(k, "A text", source="s") for k in range(40)], [doc_row(k, "B", source=f"s{k}") for k in range(20)]):
        assert audited(spark.createDataFrame(few, DOCS)) == proofs(few)


def test_manifest_of_deep_trees(spark):
    rows = [doc_row(k, f"Words {k}", source="hot") for k in range(300)] + [doc_row(900 + k, "X y", source=f"s{k % 40}") for k in range(60)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = audited(docs)
    assert got == proofs(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [r[:5] for r in rows])
    assert sorted(con.execute(manifest.sql()).fetchall(), key=repr) == got


def test_saved_manifest_is_linked_to_one_root(spark, odd_docs, tmp_path):
    manifest.build(odd_docs).save(str(tmp_path / "m"))
    nodes = spark.read.parquet(str(tmp_path / "m" / "nodes"))
    assert nodes.where("parent is null").count() == 1
    assert nodes.join(nodes.select(F.col("node").alias("up")), F.col("parent") == F.col("up"), "left_anti").count() == 1


# lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, top=10):
    bags = [(d, Counter(TERM.findall(lower(t)))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            m = 25 + 75 * sum(b.values()) * n_docs // length
            score = 0
            for t, c in Counter(TERM.findall(lower(text))).items():
                if b[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += c * w * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


ITEMS = "item_id long, text string, terms string, block int"


def searched(spark, docs, items, plan=lexical.Plan()):
    frame = spark.createDataFrame([(*i, "x", 1) for i in items], ITEMS)
    return sorted((tuple(r) for r in lexical.search(docs, frame, plan).collect()), key=repr)


def items_for(rows):
    texts = [r[1] for r in rows if r[1]]
    return [(k, " ".join(t.split()[:12])) for k, t in enumerate(texts[:12])] + [
        (50, None), (51, "?!"), (52, "Nothingknown"), (53, prose(1, 200)), (53, "one, ONE two"), (None, "words x"), (54, "É w3a-w4b"),
    ]


@pytest.mark.parametrize("plan", [lexical.Plan(), lexical.Plan(items=4, cells=200), lexical.Plan(top=2)])
def test_search_equals_brute_force(spark, odd_docs, odd_rows, plan):
    items = items_for(odd_rows)
    assert searched(spark, odd_docs, items, plan) == ranked([r[:2] for r in odd_rows], items, plan.top)


def test_search_with_ties_and_empty_tables(spark, odd_docs, no_docs):
    rows = [doc_row(k % 15, "alpha beta" if k % 2 else "beta gamma") for k in range(60)]
    items = [(1, "alpha"), (2, "beta beta"), (3, "gamma alpha")]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    assert searched(spark, docs, items) == ranked([r[:2] for r in rows], items)
    assert searched(spark, no_docs, items) == []
    assert lexical.search(odd_docs, spark.createDataFrame([], ITEMS)).count() == 0


def test_masks_beyond_a_word():
    rng = np.random.default_rng(5)
    for n in (3, 64, 65, 150):
        bitmaps = rng.random((n, 200)) < 0.03
        masks, group = lexical._masks(bitmaps)
        assert (masks[:, group] == bitmaps).all()
        assert masks.shape[1] == len({bitmaps[:, k].tobytes() for k in range(200)})


def test_terms_of_a_text_longer_than_a_slice():
    text = "Ab-cé " * 500_000 + "z" * 3_000_000
    assert Counter(t.decode() for part in lexical.terms(text) for t in part) == Counter(TERM.findall(lower(text)))

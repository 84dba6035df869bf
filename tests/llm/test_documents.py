"""Operators over documents against brute force, on rows with every odd case."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import DOCS, doc_row, edited, prose, words_of
from framebasin.llm import classifier, decontam, fertility, licenses, mixing, neardup, substring
from framebasin.llm.frames import cut_lean, lean
from framebasin.llm.words import words
from framebasin.session import scratch_root
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def as_duckdb(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    return con


def same_as_sql(df, sql, rows):
    cur = as_duckdb(rows).execute(sql)
    names = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(n) for n in names]
    want = sorted((tuple(r[k] for k in at) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=repr)
    assert sorted(df.columns) == names
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBé \t\n\x0b\x1c\x85 ", max_size=30)), max_size=8))
def test_words_match_the_pattern(texts):
    w = words(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        a, b = w.bounds[k : k + 2]
        found = [bytes(w.data[x:y]).decode() for x, y in zip(w.starts[a:b], w.ends[a:b], strict=True)]
        assert found == words_of(t)
    seen = defaultdict(set)
    for x, y, h in zip(w.starts, w.ends, w.hashes, strict=True):
        seen[bytes(w.data[x:y])].add(int(h))
    assert all(len(v) == 1 for v in seen.values()) and len({min(v) for v in seen.values()}) == len(seen)


def test_words_of_a_text_longer_than_a_slice():
    text = "ab cd\n" * 1_000_000 + "e" * 5_000_000
    w = words(pa.array([text, "ab"]))
    assert w.bounds.tolist() == [0, 2_000_001, 2_000_002]
    assert w.hashes[0] == w.hashes[-1] and w.hashes[1] == w.hashes[3] != w.hashes[0]
    assert w.ends[-2] - w.starts[-2] == 5_000_000


# mixing


def test_shares_equal_sql_and_budget(odd_docs, odd_rows):
    got = mixing.shares(odd_docs)
    same_as_sql(got.select("doc_id", "size", "source_size", "target", "taken"), mixing.SQL, odd_rows)
    rows = got.collect()
    assert sum(r.taken for r in rows) <= sum(r["size"] for r in rows)
    assert all(r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in rows)
    served, longest = Counter(), max(r["size"] for r in rows)
    for r in rows:
        served[r.source] += r.taken
    for r in rows:
        assert r.target <= 3 * r.source_size and abs(served[r.source] - r.target) <= longest


def test_a_source_without_words(spark):
    rows = [doc_row(1, "a b c", source="x"), doc_row(2, None, source="y"), doc_row(3, " ", source="y"), doc_row(4, "d", source=None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: (r.target, r.taken, r.finish) for r in mixing.shares(docs).collect()}
    assert got[2] == got[3] == (0.0, 0, None) and got[1][2] > 0
    assert {r.doc_id for r in mixing.mix(docs).collect()} <= {1, 4}
    empty = spark.createDataFrame(rows[1:3], DOCS)
    assert [r.taken for r in mixing.shares(empty).collect()] == [0, 0] and mixing.mix(empty).count() == 0


def test_short_items_are_found_word_for_word(spark):
    docs = spark.createDataFrame(
        [doc_row(1, "so the Quick fox ran"), doc_row(2, "the fox is quick"), doc_row(3, prose(1, 300) + " quick fox ran"), doc_row(4, None), doc_row(5, "fox")], DOCS
    )
    items = spark.createDataFrame([(1, "quick fox"), (2, "the quick fox ran"), (3, ""), (4, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()}
    assert got == {(1, 1), (3, 1), (1, 2)}


def test_targets_fill_up_by_weight(spark):
    sizes = spark.createDataFrame([("a", 600), ("b", 10), ("c", 390), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes, (1, 2, 3), 3).collect()}
    # b stops at 30; a and c share the other 970 by 1 to 3; the null source is last and weighs 1, but has nothing
    assert got["b"] == 30 and got[None] == 0
    assert math.isclose(got["a"], 970 / 4) and math.isclose(got["c"], 970 * 3 / 4)


def test_mix_keeps_rows_and_columns(odd_docs, no_docs):
    got = mixing.mix(odd_docs)
    assert got.columns == [*odd_docs.columns, "mix_passes", "mix_finish"]
    chosen = Counter((r.doc_id, r.taken) for r in mixing.shares(odd_docs).where("taken > 0").collect())
    assert Counter((r.doc_id, len(words_of(r.text)) * r.mix_passes) for r in got.collect()) == chosen
    assert mixing.mix(no_docs).count() == 0 and mixing.shares(no_docs).count() == 0


# decontamination


def brute_leaks(docs, items, overlap=0.5):
    grams = lambda t: {tuple(w[j : j + 5]) for w in [words_of(t.lower())] for j in range(len(w) - 4)}
    need = {i: grams(t) for i, t in items}
    return {(d, i) for d, t in docs for i, n in need.items() if n and len(n & grams(t or "")) >= overlap * len(n)}


@pytest.mark.parametrize("block", [1, 8])
def test_leaks_equal_brute_force(spark, block):
    items = [(k, prose(1000 + k, 12 + 5 * (k % 9)) + ". " + prose(2000 + k, 9)) for k in range(40)] + [(98, None), (99, "")]
    docs = [(k, prose(k, 200)) for k in range(60)] + [(900, None), (901, "")]
    for k in range(40):
        item = items[k][1]
        if k % 4 == 1:
            item = item.upper()
        if k % 4 == 2:
            item = edited(item, k, 0.04)
        if k % 4 == 3:
            item = " ".join(item.split()[: len(item.split()) // 2])
        docs.append((100 + k, f"{prose(300 + k, 37 * (k % 5))} {item}\n{prose(400 + k, 150)}"))
    docs.append((100, docs[62][1]))
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id long, text string")
    found = [(r.doc_id, r.item_id) for r in decontam.leaks(left, right, decontam.Search(block=block)).collect()]
    want = brute_leaks(docs, [(i, t) for i, t in items if t])
    assert set(found) <= want
    assert all(any((100 + k, k) == f for f in found) for k in range(40) if k % 4 < 3)
    assert len(found) == len(set(found)) + 1  # the repeated row is judged on its own
    # several small indexes find the same
    few = decontam.leaks(left, right, decontam.Search(block=block, most_words=200)).collect()
    assert {(r.doc_id, r.item_id) for r in few} >= {(100 + k, k) for k in range(0, 40, 4)}


def test_leaks_lose_nothing_to_the_bounds():
    items = [(k, prose(1000 + k, 20, vocabulary=60)) for k in range(30)]
    s = decontam.Search(threshold=0.3, block=4, frequent=0.1)
    index = decontam.Index(items, s)
    texts = [prose(k, 90, vocabulary=60) for k in range(40)]
    w = decontam.folded_words(pa.array(texts))
    got = {(int(a), int(b), int(c)): d for a, b, c, d in zip(*decontam._retrieve(w, index), strict=True)}
    where = {int(h): k for k, h in enumerate(index.terms)}
    for t in range(40):
        mine = w.hashes[w.bounds[t] : w.bounds[t + 1]]
        for at in range(0, len(mine), index.half):
            score = np.zeros(len(items))
            for h in np.unique(mine[at : at + 2 * index.half]):
                k = where.get(int(h))
                if k is not None:
                    score[index.item[index.at[k] : index.at[k + 1]]] += index.share[index.at[k] : index.at[k + 1]]
            for i in np.flatnonzero(score >= 0.3 + 1e-9):
                assert math.isclose(got[t, at, i], score[i])


def test_without_leaks(odd_docs, no_docs, spark):
    bench = spark.createDataFrame([(1, prose(200, 30)), (None, prose(9999, 30))], "item_id long, text string")
    got = decontam.without_leaks(odd_docs, bench)
    assert got.columns == odd_docs.columns and got.count() == odd_docs.count() - 1
    assert got.where("doc_id = 200").count() == 0
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontam.without_leaks(odd_docs, nothing).count() == odd_docs.count()
    assert decontam.leaks(no_docs, bench).count() == decontam.leaks(odd_docs, nothing).count() == 0


# near-duplicates


def test_items_of_all_lengths_are_met_by_one_pass(spark, monkeypatch):
    plans, write = [], decontam.cut
    monkeypatch.setattr(decontam, "cut", lambda df, name: plans.append(df) or write(df, name))
    items = [(k, prose(1000 + k, 6 * 4**k)) for k in range(4)]  # an index for each length
    docs = [(k, prose(k, 200)) for k in range(20)] + [(100 + k, f"{prose(300 + k, 50)} {items[k][1]}") for k in range(4)]
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.leaks(left, right)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(100 + k, k) for k in range(4)}
    assert {r.doc_id for r in decontam.without_leaks(left, right).collect()} == set(range(20))
    # a Python worker for each task, not one for each index
    passes = [df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") for df in (found, *plans)]
    assert passes == [1, 1]
    plans.clear()
    small = decontam.Search(most_words=100)  # the two short ones together, the others alone
    assert {r.doc_id for r in decontam.without_leaks(left, right, small).collect()} == set(range(20)) and len(plans) > 1


def brute_components(rows, width, percent=80):
    sets = []
    for _, text, *_ in rows:
        w = words_of(lower(text))
        sets.append({tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k][0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return Counter((rows[k][0], len(sets[k]), least[find(k)]) for k in range(len(rows)))


@pytest.mark.parametrize("width", [2, 5])
def test_components_equal_brute_force(odd_docs, odd_rows, width):
    got = neardup.components(odd_docs, neardup.Plan(width=width)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(odd_rows, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_large_group_of_near_copies(spark, rounds):
    base = prose(77, 120)
    rows = [doc_row(k, edited(base, k, 0.03 + 0.0004 * k)) for k in range(150)] + [doc_row(500 + k, prose(k, 80, 60)) for k in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    got = neardup.components(docs, neardup.Plan(width=2, rounds=rounds)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 2)


def test_few_pairs_of_a_group_below_the_threshold_meet(spark, monkeypatch):
    base = prose(78, 200, 3000)
    rows = [doc_row(k, edited(base, k, 0.07)) for k in range(240)] + [doc_row(1000, base), doc_row(1001, base + " end")]
    asked, estimate = [], neardup._estimate
    monkeypatch.setattr(neardup, "_estimate", lambda pairs, *more: asked.append(pairs.count()) or estimate(pairs, *more))
    got = neardup.components(spark.createDataFrame(rows, DOCS), neardup.Plan(width=2)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 2)
    assert sum(asked) < 15 * len(rows)  # of 29,161 pairs


def test_pairs_of_the_last_step_lose_no_link(spark):
    rng = random.Random(5)
    rows = [doc_row(10 * g + k, edited(prose(g, rng.randrange(3, 150), 900), 31 * g + k, 0.02 * k)) for g in range(40) for k in range(5)]
    rows += [doc_row(1000 + g, " ".join(words_of(prose(g, 150, 900))[: 120 + g])) for g in range(30)]
    got = neardup.components(spark.createDataFrame(rows, DOCS), neardup.Plan(width=2, rounds=0)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 2)


def test_only_sets_with_somebody_near_are_ordered(spark, monkeypatch):
    rows = [doc_row(k, prose(k, 120, 12)) for k in range(120)] + [doc_row(500 + k, edited(prose(k, 120, 12), k, 0.02)) for k in range(40)]
    ordered, prefixes = [], neardup._prefixes
    monkeypatch.setattr(neardup, "_prefixes", lambda sets, plan: ordered.append(sets.count()) or prefixes(sets, plan))
    for small in (1024, 3):
        got = neardup.components(spark.createDataFrame(rows, DOCS), neardup.Plan(width=2, rounds=0, small=small)).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 2)
    assert ordered[0] <= 100 < ordered[1]  # all share word pairs, 80 are like another


def test_tables_written_on_the_way_are_removed(spark, odd_docs):
    folder = Path(scratch_root(spark).removeprefix("file://"), "framebasin")
    before = set(folder.glob("*"))
    got = neardup.distinct_documents(odd_docs)
    assert {p.name.split("-")[0] for p in set(folder.glob("*")) - before} == {"gone", "twice"}
    assert 0 < got.count() < odd_docs.count()


def test_isolated_pairs_around_the_listed_values_meet(spark):
    rows = []
    for k in range(60):
        small, large = ((63, 78), (63, 77), (62, 77))[k % 3]
        both = [f"p{k}x{j}" for j in range(large + 1)]
        rows += [doc_row(2 * k, " ".join(both)), doc_row(2 * k + 1, " ".join(both[: small + 1]))]
    got = neardup.components(spark.createDataFrame(rows, DOCS), neardup.Plan(width=2)).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: k - k % 2 for k in range(120)}


def test_distinct_documents(odd_docs, no_docs):
    got = neardup.distinct_documents(odd_docs, neardup.Plan(width=5))
    assert got.columns == odd_docs.columns
    ids = Counter(r.doc_id for r in got.collect())
    assert ids[2] == ids[3] == 0 and ids[1] == ids[4] == ids[5] == ids[6] == 1
    assert neardup.components(no_docs).count() == neardup.distinct_documents(no_docs).count() == 0


def test_one_document_of_a_group_with_repeated_or_no_ids(spark):
    a, b, c = prose(31, 90), prose(32, 90), prose(33, 90)
    rows = [
        doc_row(1, a, source="x"), doc_row(1, a, source="y"), doc_row(1, a + " end"), doc_row(2, a),
        doc_row(None, b), doc_row(None, b), doc_row(None, b + " end"), doc_row(None, c), doc_row(3, None), doc_row(3, None),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    got = neardup.distinct_documents(docs)
    assert got.columns == docs.columns
    left = Counter((r.doc_id, r.text and r.text[:20]) for r in got.collect())
    assert left == {(1, a[:20]): 1, (None, b[:20]): 1, (None, c[:20]): 1, (3, None): 2}


# repeated passages


def test_substrings_equal_sql(odd_docs, odd_rows, no_docs):
    same_as_sql(substring.summary(odd_docs, 13), substring.SQL, [r for r in odd_rows if r[0] is not None] + [r for r in odd_rows if r[0] is None])
    assert substring.summary(no_docs).count() == 0


def test_without_repeats_cuts_words_only(spark, no_docs):
    passage = prose(3, 60)
    rows = [doc_row(1, f"{prose(10, 20)}\n{passage}\n{prose(11, 9)}"), doc_row(2, f"start here\n{passage}\n\nand  end"), doc_row(3, passage), doc_row(4, prose(12, 70)), doc_row(5, None)]
    got = {r.doc_id: r for r in substring.without_repeats(spark.createDataFrame(rows, DOCS), 50).collect()}
    assert got[1].text == rows[0][1] and got[4].text == rows[3][1] and got[5].text is None
    assert got[2].text == "start here\nand  end" and got[2].n_chars == len(got[2].text) and got[2]["_th"] == "x1"
    assert 3 not in got
    assert substring.without_repeats(no_docs).columns == no_docs.columns


def test_paths_name_their_source(spark):
    a, b = prose(21, 30), prose(22, 25)
    rows = [doc_row(1, a), doc_row(2, b), doc_row(3, f"{prose(23, 5)} {a} {b}")]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted(tuple(r) for r in substring.paths(substring.marks(docs, 13), 13).select("doc_id", "start", "n_words", "source").collect())
    assert got == [(3, 5, 30, 1), (3, 35, 25, 2)]


# classifier


def test_classifier_learns_and_ignores_the_rest(spark, no_docs):
    rows = [doc_row(k, prose(k, 60) if k % 3 else prose(k, 60).upper().replace(" ", "!! ")) for k in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(400)] + [(None, 1), (3, None)], "doc_id long, quality int")
    s = classifier.Settings(word_bits=12, gram_bits=12)
    model = classifier.fit(docs, labels, s)
    got = classifier.score(docs, model, s).withColumn("held", classifier.held_out(F.col("doc_id"), 5)).collect()
    held = [r for r in got if r.held]
    assert len(held) > 40 and np.mean([(r.quality_score > 0.5) == (r.doc_id % 3 > 0) for r in held]) > 0.97
    assert "text" not in got[0].asDict() and got[0]["size"] == "x3"
    odd = classifier.score(spark.createDataFrame([doc_row(1, None), doc_row(2, ""), doc_row(2, "")], DOCS), model, s).collect()
    assert len({r.quality_score for r in odd}) == 1 and 0 <= odd[0].quality_score <= 1
    none = classifier.fit(docs, labels.where("false"), s)
    assert none is None and {r.quality_score for r in classifier.score(docs, none, s).collect()} == {0.5}
    assert classifier.score(no_docs, model, s).count() == 0
    again = classifier.fit(docs, labels, s)
    assert np.array_equal(again.vectors, model.vectors)


# quality rules


def brute_quality(text):
    w = words_of(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
    covered = {j + d for j in range(len(w) - 2) if windows[tuple(w[j : j + 3])] > 1 for d in range(3)}
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered))


def test_quality_statistics_equal_brute_force(spark, odd_docs, odd_rows, no_docs):
    rows = [*odd_rows, doc_row(300, "a b c\na b c\n\n \na b c\nd#|"), doc_row(301, "x y\nx y\r\nx y"), doc_row(302, "日本語 " * 60)]
    got = fertility.judge(spark.createDataFrame(rows, DOCS)).collect()
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()
    assert Counter((r.doc_id, *[r.quality_stats[n] for n in names]) for r in got) == Counter((r[0], *brute_quality(r[1])) for r in rows)
    for r in got:
        s = r.quality_stats
        assert s.base_failed == (s.n_words < 50 or 100 * s.n_repeat_words > 50 * s.n_words)
        assert not (s.base_failed and s.kept)
    good = fertility.keep_good(odd_docs)
    assert good.columns == odd_docs.columns and good.where("doc_id in (4, 5, 6, 7, 13)").count() == 0
    assert fertility.keep_good(no_docs).count() == 0


def test_fertility_equals_the_tokenizer(spark):
    import sentencepiece

    text = prose(5, 120) + " éè\u4e2d\u6587 \U0001f9ff\u2e80 end"
    model = sentencepiece.SentencePieceProcessor(model_file=fertility.VOCABULARY)
    ids = [i for w in words_of(text) for i in model.encode(w)]
    share = np.array(list(Counter(ids).values())) / len(ids)
    s = fertility.judge(spark.createDataFrame([doc_row(1, text)], DOCS)).first().quality_stats
    assert s.n_tokens == len(ids) and math.isclose(s.byte_share, sum(model.is_byte(i) for i in ids) / len(ids))
    assert math.isclose(s.token_entropy, -(share * np.log2(share)).sum()) and math.isclose(s.chars_per_token, s.word_chars / len(ids))
    assert s.byte_share > 0


COMMON = (
    "the of and to in is was he for it with as his on be at by had not are but from or have an they which one you were all her she there "
    "would their we him been has when who will no more if out so up said what its about than into them can only other time new some could "
    "these two may first then do any like my now over such our man me even most made after also did many off before must well back through"
).split()


def common(seed, n, junk=0.0):
    rng = random.Random(seed)
    return " ".join("".join(rng.sample("qxzjkvw", 4)) if rng.random() < junk else rng.choice(COMMON) for _ in range(n))


def test_bands_come_from_the_clean_labelled_rows(spark, odd_docs):
    rows = [doc_row(k, common(k, 60 + 5 * (k % 60), 0.25 * (k >= 400))) for k in range(460)]
    rows += [doc_row(None, common(999, 80)), doc_row(500, common(500, 70, 0.25), "fr")]
    labels = spark.createDataFrame([(k, int(k < 400)) for k in range(460) if k % 2] + [(1, None), (None, 1), (3, 0)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, DOCS)
    wide, own = ({r.doc_id: r.quality_stats for r in fertility.judge(docs, labels=x).collect()} for x in (None, labels))
    passed = [k for k in range(400) if not own[k].base_failed]
    assert len(passed) > 300 and sum(own[k].kept for k in passed) > 0.93 * len(passed)
    junk = [k for k in range(400, 460) if not own[k].base_failed]
    assert junk and all(wide[k].kept for k in junk) and not any(own[k].kept for k in junk)
    assert own[500].kept == wide[500].kept  # no clean French rows: the wide band
    bare = fertility.judge(docs, labels=labels, keep_text=False)
    assert bare.columns == [*[c for c in docs.columns if c != "text"], "quality_stats"] and bare.count() == len(rows)
    good = fertility.keep_good(docs, labels=labels)
    assert good.columns == docs.columns and good.count() == sum(x.kept for x in own.values())
    none = fertility.keep_good(odd_docs, labels=labels.limit(0))
    assert sorted(map(str, none.collect())) == sorted(map(str, fertility.keep_good(odd_docs).collect()))


def test_short_texts_have_an_entropy_floor_too(spark):
    rules = fertility.Rules(min_words=1, max_repeat_pct=100)
    rows = [doc_row(1, "the " * 60), doc_row(2, common(2, 60))]
    assert {r.doc_id: r.quality_stats.kept for r in fertility.judge(spark.createDataFrame(rows, DOCS), rules).collect()} == {1: False, 2: True}


# licenses


def test_licenses_equal_sql(spark, odd_rows, no_docs):
    notice = "Redistribution and use in source and binary forms, with or without modification, is permitted"
    rows = [
        *odd_rows, doc_row(400, "ALL RIGHTS reserved. all rights-reserved; All rights. Reserved"), doc_row(401, "CC BY-NC 4.0 cc  by"),
        doc_row(402, f"{prose(4, 20)} {notice} {prose(5, 20)}"), doc_row(403, "cc"), doc_row(404, "GNU General Public License, version 3"),
        doc_row(405, "licensed under the good old Apache License, Version 2.0"),
    ]
    scanned = licenses.scan(spark.createDataFrame(rows, DOCS))
    named = "words:n_words base:n_base first:first_word last:last_word base_labels:base_labels labels:labels score:score"
    pairs = [x.split(":") for x in named.split()]
    same_as_sql(scanned.select("doc_id", *[F.col(f"license_{a}").alias(b) for a, b in pairs]), licenses.sql(), rows)
    by_id = {r.doc_id: r for r in scanned.collect()}
    assert by_id[400].license_base == 3 and by_id[400].license_first == 0 and by_id[400].license_last == 6
    assert by_id[402].license_labels == "bsd" and by_id[404].license_labels == "gpl,gpl-3.0"
    assert "text" not in scanned.columns and by_id[400]["size"] == "x3"
    assert licenses.scan(no_docs).count() == 0


def test_kept_text_digest(spark):
    rows = [doc_row(1, "a  b\tc"), doc_row(2, None)]
    got = {r.doc_id: r.kept_sha256 for r in substring.summary(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: hashlib.sha256(b"a b c").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}


def test_words_of_a_long_slice_take_little_memory():
    import tracemalloc

    texts = pa.array(["ab cde f " * 230_000], pa.string())
    words(texts)  # tables that are kept
    tracemalloc.start()
    w = words(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(w.hashes) == 690_000 and len(set(w.hashes.tolist())) == 3
    assert peak < 60 << 20


def test_frequent_words_are_encoded_once_beside_many_rare_ones():
    kept = fertility.Fertility(fertility.VOCABULARY, 2)
    model, seen = kept.model, []

    class Spy:
        def encode(self, texts, **more):
            seen.extend(texts)
            return model.encode(texts, **more)

    kept.model = Spy()
    texts = pa.array(["alpha beta gamma alpha beta", None, "delta über alpha beta"], pa.large_string())
    first, again = (fertility._measure(texts, kept) for _ in range(2))
    assert first.equals(again) and first.equals(fertility._measure(texts, fertility.Fertility(fertility.VOCABULARY, 100)))
    assert [seen.count(x) for x in ("alpha", "beta", "gamma", "über")] == [1, 1, 2, 2]


def test_arrow_batches_of_written_tables_are_bounded_by_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    texts = spark.range(0, 200, 1, 1).selectExpr("repeat(cast(id as string), 50000) as text")
    got = [r.n for r in cut_lean(texts.mapInArrow(lean(sizes), "n long"), "sizes").collect()]
    assert len(got) > 3 and max(got) < 5 << 20 and sum(got) > 20 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before

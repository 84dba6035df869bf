"""Operators over pages: archives, main text, url rules and the link graph."""

import gzip
import hashlib
from collections import Counter
from itertools import product
from pathlib import Path

import pytest
from framebasin.llm import urlgraph, warc, wrappers
from framebasin.llm.htmltree import Tree, match_trees, parse, read_skeleton, skeleton
from pyspark.sql import types as T

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
        *[T.StructField(c, T.StringType()) for c in ("host", "_own", "_bad", "digest", "main_text", "url_rule")],
    ]
)


def pages_df(spark, rows):
    return spark.createDataFrame([(*r, "h", "o", "b", "d", "m", "u") for r in rows], PAGES).repartition(3)


BIG = "<p>é" + "x" * 200
ROWS = [
    (1, "http://a.org/1", BIG), (2, "http://a.org/2", BIG), (2, "http://a.org/2", BIG), (0, "http://b.org/ \r\nx", BIG + "y"),
    (3, "http://b.org/3", BIG + "y"), (4, None, None), (5, "http://c.org", ""), (6, "http://c.org", "small"), (7, "http://c.org", "small"),
    (None, "http://d.org", BIG), (None, None, BIG + "z"), (8, "http://e.org", BIG + "z"),
    (9, "http://f.org", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" * 20), (10, "http://f.org", "ends in WARC/1.1"),
    (11, "http://f.org", "x" * 3_000_000),
]


def test_archives_round_trip(spark):
    got = warc.round_trip(pages_df(spark, ROWS)).collect()
    want = Counter()
    first = {}
    for p, _, h in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (h or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        kind, to = "response", None
        if len(data) >= 100 and digest in first:
            kind, to = "revisit", first[digest]
        first.setdefault(digest, p)
        want[p, len(data), digest, kind, to] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(r.declared_digest == r.payload_digest for r in got)
    assert warc.round_trip(pages_df(spark, [])).count() == 0


def test_archives_are_plain_records(spark, tmp_path):
    warc.write_archives(pages_df(spark, ROWS), f"{tmp_path}/w", "2024-01-01T00:00:00Z")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(f"{tmp_path}/w").glob("*.gz")))
    kinds = Counter()
    while data:  # a reader of its own: header lines, then the declared number of bytes
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        kinds[fields["WARC-Type"]] += 1
        if fields["WARC-Type"] == "response":
            payload = rest[:n].partition(b"\r\n\r\n")[2]
            assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
        else:
            assert fields["WARC-Refers-To"].startswith("<urn:uuid:") and "WARC-Profile" in fields
        data = rest[n + 4 :]
    assert kinds == {"response": len(ROWS) - 5, "revisit": 5}


def test_reader_takes_single_payloads(spark, tmp_path):
    warc.write_archives(pages_df(spark, ROWS), f"{tmp_path}/w", "2024-01-01T00:00:00Z")
    got = warc.read_archives(spark, f"{tmp_path}/w").where("record_type = 'response'").collect()
    assert {bytes(r.payload).decode() for r in got} == {h or "" for _, _, h in ROWS}
    (tmp_path / "cut").mkdir()
    whole = gzip.decompress(next(p for p in sorted(Path(f"{tmp_path}/w").glob("*.gz")) if p.stat().st_size > 100).read_bytes())
    (tmp_path / "cut" / "a.gz").write_bytes(gzip.compress(whole[:-30]))
    with pytest.raises(Exception, match="ends inside a record|malformed record"):
        warc.read_archives(spark, f"{tmp_path}/cut").collect()


# urls


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("https://A.Example.ORG/es/x?y#z", "a.example.org", "/es/x", "example.org/es/"),
        ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/"),
        ("http://x.com/fr/#a", "x.com", "/fr/", "com/fr/"),
        ("http://x.com?/fr/", "x.com", "", None),
        ("ftp://x.org", "x.org", "", None),
        ("a://b://c/d", "b:", "//c/d", None),
        ("no scheme/fr/", "", "", None),
        ("http:///fr/", "", "/fr/", None),
        ("", "", "", None),
        (None, "", "", None),
    ],
)
def test_hosts_paths_and_rules(spark, url, host, path, rule):
    r = urlgraph.judge(pages_df(spark, [(1, url, None)])).first()
    assert (r.url_host, r.url_path, r.url_rule, r.host) == (host, path, rule, "h")
    verdicts = {x.text: x.verdict for x in urlgraph.RULES}
    assert r.url_verdict == verdicts.get(rule, "allow")


def brute_propagation(seeds, links, damping, rounds):
    out, into = Counter(), Counter()
    for (a, b), n in links.items():
        out[a] += n
        into[b] += n
    trust, bad = dict(seeds), dict(seeds)
    t = {h: s[0] for h, s in seeds.items()}
    d = {h: s[1] for h, s in seeds.items()}
    for _ in range(rounds):
        nt, nd = Counter({h: s[0] for h, s in seeds.items()}), Counter({h: s[1] for h, s in seeds.items()})
        for (a, b), n in links.items():
            nt[b] += damping * t.get(a, 0) * n / out[a]
            nd[a] += damping * d.get(b, 0) * n / into[b]
        t, d = nt, nd
    assert trust and bad
    return {h: (t.get(h, 0), d.get(h, 0)) for h in {*t, *d} if t.get(h) or d.get(h)}


def test_propagation_equals_brute_force(spark):
    seeds = {"a": (1.0, 0.0), "b": (0.0, 1.0), "c": (0.2, 0.1)}
    links = {("a", "d"): 3, ("a", "e"): 1, ("d", "e"): 2, ("e", "a"): 1, ("f", "b"): 5, ("f", "d"): 1, ("g", "f"): 1, ("h", "c"): 2}
    s = spark.createDataFrame([(h, *v) for h, v in seeds.items()], "host string, trust double, distrust double")
    e = spark.createDataFrame([(*k, n) for k, n in links.items()], "src string, dst string, n long")
    got = {r.host: (r.trust, r.distrust) for r in urlgraph.propagate(s, e, rounds=9, every=4, tolerance=0.0).collect()}
    want = brute_propagation(seeds, links, 0.85, 9)
    assert got.keys() == want.keys()
    assert all(got[h] == pytest.approx(want[h]) for h in want)


def test_links_block_who_links_to_bad_hosts(spark):
    link = '<p><a class=x href="//{}/p">x</a> <A HREF=\'/own\'>y</A></p>'
    rows = [
        (1, "http://bad.com/de/1", ""), (2, "http://farm.net/x", link.format("BAD.com")), (3, "http://fan.net/", link.format("good.org")),
        (4, "http://good.org/", link.format("friend.net")), (5, "http://friend.net/", None), (5, "http://friend.net/", None),
    ]
    got = urlgraph.judge(pages_df(spark, rows)).collect()
    assert {r.url_host: r.url_verdict for r in got} == {"bad.com": "block", "farm.net": "block", "fan.net": "allow", "good.org": "allow", "friend.net": "allow"}
    assert len(got) == len(rows)
    edges = {(r.src, r.dst): r.n for r in urlgraph.host_links(pages_df(spark, rows)).collect()}
    assert edges == {("farm.net", "bad.com"): 1, ("fan.net", "good.org"): 1, ("good.org", "friend.net"): 1}
    assert urlgraph.judge(pages_df(spark, [])).count() == 0


# main text


def brute_match(a, b, i=0, j=0):
    if a.labels[i] != b.labels[j]:
        return 0
    left, right = a.children[i], b.children[j]
    m = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for x, y in product(range(1, len(left) + 1), range(1, len(right) + 1)):
        m[x][y] = max(m[x - 1][y], m[x][y - 1], m[x - 1][y - 1] + brute_match(a, b, left[x - 1], right[y - 1]))
    return 1 + m[-1][-1]


def test_tree_matching():
    a = read_skeleton("html(body(nav(ul(li*)),div.ad,article(h1,p*,div(p)),footer))")
    b = read_skeleton("html(body(div.ad,nav(ul(li*)),article(p*,div(p,p)),div,footer))")
    got = match_trees(a, b)
    assert len(got) == brute_match(a, b) and all(a.labels[i] == b.labels[j] for i, j in got.items())
    assert a.labels[:4] == ["html", "body", "nav", "ul"]
    assert match_trees(Tree(["html"], [[]]), Tree(["body"], [[]])) == {}


def test_parser_takes_what_browsers_take():
    page = parse("<p>a<p>b <i>c</i><br>d&amp;<ul><li>1<li>2</ul><script>if (a<b) '</p>'</script>tail &eacute; &am<div title='>'>x</div><p")
    assert [b.text for b in page.blocks] == ["a", "b c d&", "1", "2", "tail é &am", "x"]
    assert [page.nodes[b.node].tag for b in page.blocks] == ["p", "p", "li", "li", "html", "div"]
    assert skeleton(page)[0] == "html(p*,ul(li*),div,p)"
    shape, folded = skeleton(parse("<div><p>1<p>2</div><div><p>3<p>4</div><div></div>"))
    assert shape == "html(div(p*)*,div)" and folded == [0, 1, 2, 2, 1, 2, 2, 3]
    for odd in ("", "<", "</p>", "<!-- x", "<p class='", "text only", "<a" * 5000, "<div>" * 3000 + "deep"):
        parse(odd)


def page(k, body, extra=""):
    return (
        f"<html><head><title>t{k}</title></head><body class='no-sidebar'><header>Site</header><nav><a href='/{k}'>m{k}</a></nav>"
        f"<div class='content'><h1>Title {k}</h1>{body}<p>Read more here</p>{extra}</div><aside>side {k}</aside>"
        f"<div id='comments'><p>nice {k} {'blah ' * k}</p></div><form>f</form><footer>&copy; {k}</footer></body></html>"
    )


def test_wrappers_find_the_slot(spark):
    rows = [(k, f"http://x.net/{k}", page(k, f"<p>One {k} {'lorem ' * 30}</p><p>two&nbsp;{k}\n x</p>")) for k in range(20)]
    rows += [
        (20, "http://x.net/a", None), (21, "http://x.net/b", ""), (22, "http://x.net/c", "<p>bare"), (23, None, "<article><p>lone &lt;b&gt;</article><footer>f"),
        (24, "http://y.net/", "<main><nav>no</nav><p>only</p><div class='ad banner'>buy</div></main>"), (24, "http://y.net/", "<main><p>only</p></main>"),
        (25, "http://x.net/d", page(25, "<p>short, but longer than the template</p>", "<div class='share'>tweet</div><article class='comment'>reader</article>")),
        (26, "http://x.net/e", page(26, "<p>" + "long " * 200_000 + "</p>")),
    ]
    got = wrappers.extract(pages_df(spark, rows))
    assert got.columns == ["page_id", "url", "host", "_own", "_bad", "digest", "url_rule", "main_text"]
    text = {}
    for r in got.collect():
        text.setdefault(r.page_id, []).append(r.main_text)
    for k in range(20):
        assert text[k] == [f"Title {k}\nOne {k} {('lorem ' * 30).strip()}\ntwo {k} x"]
    assert text[20] == text[21] == [""] and text[22] == ["bare"] and text[23] == ["lone <b>"]
    assert text[24] == ["only", "only"] and text[25] == ["Title 25\nshort, but longer than the template"]
    assert len(text[26][0]) > 900_000
    assert wrappers.extract(pages_df(spark, [])).count() == 0


def test_a_shared_article_is_no_template(spark):
    rows = [(k, f"http://z.org/{k}", page(0, "<p>The same article everywhere, word for word.</p>")) for k in range(30)]
    got = {r.main_text for r in wrappers.extract(pages_df(spark, rows)).collect()}
    assert got == {"Title 0\nThe same article everywhere, word for word.\nRead more here"}


@pytest.mark.parametrize("pages", [1, 12])
@pytest.mark.parametrize(
    "body, lines",
    [
        ("<div class='post'><h1>Title {k}</h1><p>lead {k}</p><div class='body'><p>long {k} {x}</p><p>more {k} {x}</p></div></div>", "Title {k}|lead {k}|long {k} {x}|more {k} {x}"),
        ("<div class='one'><p>first {k} {x} {x}</p></div><div class='two'><p>second {k} {x}</p></div>", "first {k} {x} {x}|second {k} {x}"),
        ("<article><h2>A {k}</h2><p>a {k} {x}</p></article><article><p>b {k} {x}</p><ul><li>c {k}</li></ul></article>", "A {k}|a {k} {x}|b {k} {x}|c {k}"),
        ("<main><h1>T {k}</h1><article><p>in {k} {x}</p></article><p>after {k}</p></main>", "T {k}|in {k} {x}|after {k}"),
    ],
)
def test_the_slot_holds_the_whole_article(spark, body, lines, pages):
    fill = lambda t, k: t.format(k=k, x=f"words{k} " * 40).strip()
    rows = [(k, f"http://w.org/{k}", f"<body><nav>menu</nav><div class='ad'>buy {k}</div>{fill(body, k)}<footer>f {k}</footer></body>") for k in range(pages)]
    got = {r.page_id: r.main_text for r in wrappers.extract(pages_df(spark, rows)).collect()}
    for k in range(pages):
        assert got[k] == "\n".join(" ".join(fill(x, k).split()) for x in lines.split("|"))


def test_text_beside_the_slot_stays(spark):
    one = "<div class='ad'>buy</div><div class='story'><p>story {k} words</p></div>"
    rows = [(k, f"http://v.org/{k}", one.format(k=k) + ("<div class='extra'><p>only here</p></div>" if k == 3 else "")) for k in range(12)]
    got = {r.page_id: r.main_text for r in wrappers.extract(pages_df(spark, rows)).collect()}
    assert got == {k: f"story {k} words" + "\nonly here" * (k == 3) for k in range(12)}


def test_template_text_inside_the_article_stays(spark):
    rows = [(k, f"http://u.org/{k}", f"<div class='top'>Our motto</div><div class='story'><p>story {k} words</p>{'<h2>Our motto</h2>' * (k % 2)}<p>end {k} of it</p></div>") for k in range(12)]
    got = {r.page_id: r.main_text for r in wrappers.extract(pages_df(spark, rows)).collect()}
    assert got == {k: f"story {k} words\n" + "Our motto\n" * (k % 2) + f"end {k} of it" for k in range(12)}


def test_classes_that_only_mention_furniture():
    for name in (
        "has-sidebar", "no-sidebar main", "entry with-comments", "content page-header-less", "article-header", "cookie-recipe",
        "share-price-news", "advertising-free", "shared", "breadth",
    ):
        assert not any(n.furniture for n in parse(f"<body><div class='{name}'><p>Text</p></div>").nodes), name
    for name in ("sidebar", "site-footer", "x ad", "main-nav", "comment-list", "cookie-banner", "sidebar-left", "nav menu1", "box_ad_2"):
        assert any(n.furniture for n in parse(f"<body><div class='{name}'><p>Text</p></div>").nodes), name


def test_propagation_runs_until_it_has_converged(spark):
    chain = [f"h{k}" for k in range(30)]
    edges = [("a", "b", 1), ("b", "a", 1), *((x, y, 1) for x, y in zip(chain, chain[1:]))]
    s = spark.createDataFrame([("a", 1.0, 0.0), ("h0", 1.0, 0.0)], "host string, trust double, distrust double")
    e = spark.createDataFrame(edges, "src string, dst string, n long")
    got = {r.host: r.trust for r in urlgraph.propagate(s, e).collect()}
    assert got["a"] == pytest.approx(1 / (1 - 0.85**2), abs=1e-4) and got["b"] == pytest.approx(0.85 / (1 - 0.85**2), abs=1e-4)
    assert got["h29"] == pytest.approx(0.85**29)
    with pytest.warns(UserWarning, match="after 4 rounds"):
        urlgraph.propagate(s, e, rounds=4)

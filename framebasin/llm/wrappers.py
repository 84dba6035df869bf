"""Main text of pages by wrapper induction.

1. Every page is parsed into a tree of its block elements; runs of like siblings fold into one node. The most
   frequent folded tree of a host is its reference.
2. Trees of all pages of the host are aligned with the reference by simple tree matching, and every block of text is
   counted by its aligned node and its content. Blocks that nearly all pages have at one node are template, at that
   node only; the others fill slots. Hosts of fewer than ``least_pages`` pages have no template and keep all blocks.
3. The slot of the article is the deepest container around all varying, mostly unlinked text outside of elements
   named as menus, headers, footers, sidebars, notices, adverts, forms or comments, whatever share of it lies where.
4. A page's text are the blocks inside its node aligned with that slot, and all mostly unlinked blocks outside of it,
   without such elements and template blocks. Pages whose tree lacks the slot are judged by the same rule on the page alone.

Counts are combined before they are shuffled; one row for each host comes back to its pages, by a join that adaptive
execution splits where a host has very many. Pages of a host never meet in one task.

Defined results: null html is empty and gives an empty text. Text outside of any element is a block. Pages without
a url form the host "". A page whose slot would lose more than half of its text to the template keeps it all.
Repeated rows are extracted one by one and count as pages of their own. Extra columns stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .frames import carry, restore, slices
from .htmltree import Page, Tree, match_trees, parse, read_skeleton, skeleton
from .urlgraph import host_of

CONTAINERS = frozenset("html body main article section div td center blockquote".split())


@dataclass(frozen=True)
class Induction:
    least_pages: int = 10  # of a host before a block counts as template
    constant: float = 0.8  # share of pages that hold a template block


_BLOCKS = "array<struct<node:int,digest:bigint,chars:int,linked:int,plain:boolean>>"


def _furnished(page: Page) -> list[bool]:
    """Whether each node or one around it is named as something that is not the article."""
    out = []
    for n in page.nodes:
        out.append(n.furniture or (n.parent >= 0 and out[n.parent]))
    return out


def _slot(labels: list[str], parents: list[int], texts: set[int]) -> int:
    """The deepest container around all nodes of ``texts``; parents come before their children."""
    inside = [int(k in texts) for k in range(len(labels))]
    for k in range(len(labels) - 1, 0, -1):
        inside[parents[k]] += inside[k]
    at = max((k for k in range(len(labels)) if inside[k] == len(texts)), default=0) if texts else 0
    while at > 0 and labels[at].split(".")[0] not in CONTAINERS:
        at = parents[at]
    return at


def _structure(pages: DataFrame) -> DataFrame:
    """Of each page: host, skeleton, and its blocks by folded node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("node", pa.int32()), ("digest", pa.int64()), ("chars", pa.int32()), ("linked", pa.int32()), ("plain", pa.bool_())]))
        for batch in slices(batches, "html"):
            shapes, found = [], []
            for source in batch.column("html").to_pylist():
                page = parse(source or "")
                shape, folded = skeleton(page)
                bad = _furnished(page)
                shapes.append(shape)
                found.append([(folded[b.node], _digest(b.text), len(b.text), b.linked, not bad[b.node]) for b in page.blocks])
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), pa.array(shapes, pa.string()), pa.array([[dict(zip(("node", "digest", "chars", "linked", "plain"), x, strict=True)) for x in f] for f in found], kind)],
                ["host", "skeleton", "blocks"],
            )

    return pages.mapInArrow(run, f"host string, skeleton string, blocks {_BLOCKS}")


def _digest(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _parents(tree: Tree) -> list[int]:
    out = [-1] * len(tree.labels)
    for k, below in enumerate(tree.children):
        for c in below:
            out[c] = k
    return out


def induce(pages: DataFrame, how: Induction = Induction()) -> DataFrame:
    """The wrapper of each host: host, skeleton, slot (node of the skeleton, -1 if undecided), template (nodes and digests)."""
    shaped = cut(_structure(pages), "structure")
    counted = shaped.groupBy("host", "skeleton").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct("n", (-F.length("skeleton")).alias("short"), "skeleton")
    references = cut(counted.groupBy("host").agg(F.max(order).alias("best"), F.sum("n").alias("pages")).select("host", F.col("best.skeleton").alias("reference"), "pages"), "references")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], dict[int, int]] = {}
        for batch in batches:
            host, node, digest, chars, linked = [], [], [], [], []
            for h, mine, reference, blocks in zip(*(batch.column(c).to_pylist() for c in ("host", "skeleton", "reference", "blocks")), strict=True):
                if (mine, reference) not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[mine, reference] = match_trees(read_skeleton(mine), read_skeleton(reference))
                to = known[mine, reference]
                merged: Counter = Counter()
                for b in blocks:
                    if b["node"] in to and b["plain"]:
                        merged[to[b["node"]], b["digest"], b["chars"], b["linked"]] = 1  # once for a page
                for k, d, c, li in merged:
                    host.append(h), node.append(k), digest.append(d), chars.append(c), linked.append(li)
            yield pa.RecordBatch.from_arrays(
                [pa.array(host, pa.string()), *(pa.array(x, pa.int64()) for x in (node, digest, chars, linked))],
                ["host", "node", "digest", "chars", "linked"],
            )

    met = shaped.join(references, "host").select("host", "skeleton", "reference", "blocks")
    aligned = met.mapInArrow(align, "host string, node long, digest long, chars long, linked long")
    blocks = aligned.groupBy("host", "node", "digest").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    judged = blocks.join(references.select("host", "pages"), "host").withColumn(
        "constant", (F.col("pages") >= how.least_pages) & (F.col("n") >= how.constant * F.col("pages"))
    )
    per_node = judged.groupBy("host", "node").agg(
        F.max(~F.col("constant") & (2 * F.col("linked") <= F.col("chars"))).alias("varies"),
        F.collect_list(F.when(F.col("constant"), F.struct("node", "digest"))).alias("template"),
    )
    wrappers = per_node.groupBy("host").agg(
        F.collect_list(F.when(F.col("varies"), F.col("node"))).alias("texts"), F.flatten(F.collect_list("template")).alias("template")
    )

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = []
            for reference, texts in zip(batch.column("skeleton").to_pylist(), batch.column("texts").to_pylist(), strict=True):
                tree = read_skeleton(reference)
                slots.append(_slot(tree.labels, _parents(tree), set(texts)) if texts else -1)
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("skeleton"), pa.array(slots, pa.int32()), batch.column("template")], ["host", "skeleton", "slot", "template"])

    every = references.join(wrappers, "host", "left").select("host", F.col("reference").alias("skeleton"), "texts", "template")
    return every.mapInArrow(choose, "host string, skeleton string, slot int, template array<struct<node:bigint,digest:bigint>>")


def _text(source: str, wrapper: tuple[Tree, int, frozenset] | None, known: dict, reference: str, how: Induction) -> str:
    page = parse(source)
    if not page.blocks:
        return ""
    shape, folded = skeleton(page)
    roots: set[int] = set()
    bad = _furnished(page)
    to: dict[int, int] = {}
    if wrapper:
        if (shape, reference) not in known:
            if len(known) > 10_000:
                known.clear()
            known[shape, reference] = match_trees(read_skeleton(shape), wrapper[0])
        to = known[shape, reference]
        roots = {k for k, f in enumerate(folded) if wrapper[1] >= 0 and to.get(f) == wrapper[1]}
    template = wrapper[2] if wrapper else frozenset()
    constant = [bool(template) and (to.get(folded[b.node]), _digest(b.text)) in template for b in page.blocks]
    free = [not bad[b.node] and 2 * b.linked <= len(b.text) for b in page.blocks]
    if not roots:
        texts = {b.node for b, f, c in zip(page.blocks, free, constant, strict=True) if f and not c}
        texts = texts or {b.node for b, f in zip(page.blocks, free, strict=True) if f}
        roots = {_slot([n.label for n in page.nodes], [n.parent for n in page.nodes], texts)}
    state: list[bool] = []  # inside the slot and outside of furniture
    for k, n in enumerate(page.nodes):
        if k in roots:
            state.append(True)
        else:
            state.append(n.parent >= 0 and state[n.parent] and not n.furniture)
    chosen = [(b.text, c) for b, f, c in zip(page.blocks, free, constant, strict=True) if state[b.node] or (f and not c)]
    own, kept = [t for t, _ in chosen], [t for t, c in chosen if not c]
    if 2 * sum(map(len, kept)) < sum(map(len, own)):
        kept = own
    return "\n".join(kept)


def extract(pages: DataFrame, how: Induction = Induction(), url: str = "url", html: str = "html", into: str = "main_text") -> DataFrame:
    """``pages`` without html, with the main text of each."""
    wrappers = cut(induce(pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).withColumn("host", F.coalesce("host", F.lit(""))), how), "wrappers")
    needed, whole_rows = (url, html), pages
    pages = carry(pages, needed)
    names = [c for c in pages.columns if c != html]
    right = wrappers.withColumnsRenamed({c: f"_{c}" for c in wrappers.columns})
    met = pages.withColumn("_own", F.coalesce(host_of(F.col(url)), F.lit(""))).join(right, F.col("_own") == F.col("_host"))
    schema = T.StructType([*[pages.schema[c] for c in names], T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, tuple] = {}
        known: dict[tuple[str, str], dict[int, int]] = {}
        for batch in slices(batches, html):
            texts = []
            columns = (batch.column(c).to_pylist() for c in (html, "_host", "_skeleton", "_slot", "_template"))
            for source, host, reference, slot, template in zip(*columns, strict=True):
                if host not in trees:
                    if len(trees) > 1000:
                        trees.clear()
                    trees[host] = (read_skeleton(reference), slot, frozenset((x["node"], x["digest"]) for x in template or ()))
                texts.append(_text(source or "", trees[host], known, reference, how))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(texts, pa.string())], [*names, into])

    out = met.select(*names, html, "_host", "_skeleton", "_slot", "_template").mapInArrow(run, schema)
    return restore(out, whole_rows, needed, (into,), drop=(html,))

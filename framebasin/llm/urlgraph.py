"""Url rules and link-graph propagation over hosts, with DataFrame functions only.

Rules decide the urls they fit. For every other url its host decides: trust flows from hosts whose pages rules
allow along links, distrust flows from hosts whose pages rules block against links (who links to bad hosts is
suspect), both as personalised PageRank, and a host whose distrust exceeds its trust by a margin is blocked.

Defined results: null urls and urls without ``://`` have empty host and path, fit no rule and are allowed. Links
from and to an empty host and links inside a host do not count. Repeated rows count as pages of their own. Hosts
without seeds and links have no score and are allowed. Extra columns stay.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .frames import carry, lower_ascii, restore


@dataclass(frozen=True)
class Rule:
    """Fits hosts equal to or below ``host`` where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
#: An absolute or protocol-relative link in an anchor; relative links stay on their host and do not count.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.when(F.instr(url, "://") > 0, lower_ascii(host)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def fitted(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        text = F.when(fits, r.text) if text is None else text.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    return (text, verdict) if text is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Number of links between different hosts: src, dst, n."""
    target = F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), 1))
    found = pages.select(host_of(F.col(url)).alias("src"), target.alias("to"))
    absolute = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))
    pairs = found.select("src", host_of(absolute).alias("dst"))
    return pairs.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(
    seeds: DataFrame, links: DataFrame, damping: float = 0.85, rounds: int | None = None, every: int = 5, tolerance: float = 1e-6
) -> DataFrame:
    """Trust and distrust of hosts: host, trust, distrust.

    ``seeds`` has host, trust, distrust; ``links`` has src, dst, n. Trust of a host is its seed plus the damped
    shares of those that link to it; distrust is the same against the direction of links. Every few rounds the
    scores are written to the scratch folder, and the rounds end once no score moves by more than ``tolerance``. What
    moves shrinks by ``damping`` each round, so that many rounds always suffice; a caller may give a number of rounds
    and is warned if scores still moved then.
    """
    if rounds is None and not (0 <= damping < 1 and tolerance > 0):
        raise ValueError("without a number of rounds, damping must be below 1 and the tolerance above 0")
    links = cut(links, "links")
    out, into = (links.groupBy(c).agg(F.sum("n").alias("all")) for c in ("src", "dst"))
    flows = cut(
        links.join(out, "src").select(F.lit("t").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("all")).alias("share"))
        .union(links.join(into, "dst").select(F.lit("d"), "dst", "src", F.col("n") / F.col("all"))),
        "flows",
    )
    start = cut(
        seeds.select("host", F.explode(F.create_map(F.lit("t"), F.col("trust"), F.lit("d"), F.col("distrust"))).alias("kind", "score"))
        .where("score > 0"),
        "seeds",
    )
    scores = start
    if not flows.isEmpty():
        for k in count(1) if rounds is None else range(1, rounds + 1):
            got = flows.join(scores, ["kind", "host"]).select(
                F.col("to").alias("host"), "kind", (F.col("score") * F.col("share") * damping).alias("score")
            )
            moved = start.select("host", "kind", "score").union(got).groupBy("host", "kind").agg(F.sum("score").alias("score"))
            if k % every and k != rounds:
                scores = moved
                continue
            new = cut(moved, "scores")
            old = scores.withColumnRenamed("score", "old")
            gap = new.join(old, ["kind", "host"], "full").agg(
                F.max(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))
            ).first()[0]
            scores = new
            if (gap or 0.0) <= tolerance:
                break
            if k == rounds:
                warnings.warn(f"scores of hosts still moved by {gap:.2g} after {rounds} rounds", stacklevel=2)
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0))
    return scores.groupBy("host").agg(part("t").alias("trust"), part("d").alias("distrust"))


def judge(
    pages: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    margin: float = 0.25,
    damping: float = 0.85,
    rounds: int | None = None,
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """``pages`` without html, with url_host, url_path, url_rule and url_verdict.

    Seeds are the shares of a host's pages that rules allow and block. Pages of one host may be any share of all
    rows: counts are combined before the shuffle, and adaptive execution splits the join that brings verdicts back.
    """
    rule, verdict = fitted(F.col("url_host"), F.col("url_path"), rules)
    needed = (url, html)
    judged = carry(pages, needed).drop(html).withColumns({"url_host": host_of(F.col(url)), "url_path": path_of(F.col(url))}).withColumns(
        {"url_rule": rule, "_verdict": verdict}
    )
    seeds = (
        judged.where("url_host <> ''")
        .groupBy(F.col("url_host").alias("host"))
        .agg(
            F.avg((F.coalesce("_verdict", F.lit("")) == "allow").cast("double")).alias("trust"),
            F.avg((F.coalesce("_verdict", F.lit("")) == "block").cast("double")).alias("distrust"),
        )
    )
    bad = (
        propagate(seeds, host_links(pages, url, html), damping, rounds)
        .where(F.col("distrust") - F.col("trust") > margin)
        .select(F.col("host").alias("_bad"))
    )
    met = judged.join(bad, F.col("url_host") == F.col("_bad"), "left")
    decided = F.coalesce("_verdict", F.when(F.col("_bad").isNotNull(), "block").otherwise("allow"))
    new = ("url_host", "url_path", "url_rule", "url_verdict")
    return restore(met.withColumn("url_verdict", decided), pages, needed, new, drop=(html,))

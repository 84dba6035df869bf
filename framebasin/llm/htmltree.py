"""A small tree of the block elements of a page, and simple tree matching of such trees."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

#: Fixed values of HTML: elements that stand as blocks, that hold no content, that hold no text, raw text.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot "
    "th thead tr ul noscript template iframe svg button select textarea object canvas video audio".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp".split())
UNSEEN = frozenset("script style title noscript template iframe svg button select textarea object canvas video audio dialog".split())
FURNITURE = frozenset("nav footer aside form menu search".split())
CLOSES_P = BLOCKS - frozenset("html body td th tr tbody thead tfoot".split())
ENDS_BEFORE = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr"), "th": ("td th", "tr")}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies consent "
    "gdpr notice popup modal overlay newsletter subscribe sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
    "comment comments disqus replies respond share sharing social related pagination pager toolbar widget login signup".split()
)
HEAD_NAMES = frozenset("header masthead topbar".split())
#: Words that may stand beside such a name in one class or id, as in site-footer; with any other word, as in
#: no-sidebar or cookie-recipe, the class names something else.
BESIDE = frozenset(
    "site main page global primary secondary top bottom left right inner outer box list item items area block section bar wrap "
    "wrapper container slot link links form content panel post user mobile desktop fixed sticky sub".split()
)
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPLIT_NAME = re.compile(r"[^a-z]+")


class Node(NamedTuple):
    parent: int
    tag: str
    label: str  # tag and classes without digits
    furniture: bool  # named as something that is not the article


class Block(NamedTuple):
    node: int
    text: str
    linked: int  # characters inside links


class Page(NamedTuple):
    nodes: list[Node]
    blocks: list[Block]


def _node(parent: int, tag: str, attributes: str, in_article: bool) -> Node:
    classes, names, furniture = "", [], tag in UNSEEN or tag in FURNITURE or (tag == "header" and not in_article)
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "class":
                classes = " ".join(sorted(re.sub(r"\d+", "", value).split()))
            if key in ("class", "id"):
                names += [[w for w in SPLIT_NAME.split(token) if w] for token in value.split()]
            elif key == "role":
                furniture |= value in ROLES
            elif key == "hidden":
                furniture = True
    own = NAMES if in_article else NAMES | HEAD_NAMES
    hits = [set(token) & own for token in names if all(w in own or w in BESIDE for w in token)]
    if tag not in ("html", "body", "article", "main") or any(h & {"comment", "comments"} for h in hits):
        furniture |= any(hits)
    return Node(parent, tag, f"{tag}.{classes}" if classes else tag, furniture)


def parse(source: str) -> Page:
    """Blocks of text in page order with the element each stands in. Never fails: what is open at the end is closed."""
    nodes, blocks = [Node(-1, "html", "html", False)], []
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements, inline ones with the node around them
    held: list[str] = []
    linked, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                blocks.append(Block(stack[-1][1], text, min(linked, len(text))))
            held.clear()
        linked = 0

    def close(to: int) -> None:
        nonlocal in_link
        if any(t in BLOCKS for t, _ in stack[to:]):
            flush()
        in_link -= sum(t == "a" for t, _ in stack[to:])
        del stack[to:]

    while at < len(source):
        m = TAG.search(source, at)
        end = m.start() if m else len(source)
        if end > at:
            held.append(source[at:end])
            if in_link:
                linked += end - at
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in ("table", "article", "body") and tag in ("p", "li", "a", "b", "i", "span"):
                    break
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            at = stop.end() if stop else len(source)
            continue
        if tag in ("html", "head"):
            continue
        if tag == "br" or tag in VOID and tag != "hr":
            held.append(" ")
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        if tag in ENDS_BEFORE:
            ends, limit = (x.split() for x in ENDS_BEFORE[tag])
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    close(k)
                    break
                if stack[k][0] in limit:
                    break
        if tag in BLOCKS:
            flush()
            if tag == "hr":
                continue
            inside = any(t in ("article", "main") for t, _ in stack)
            nodes.append(_node(stack[-1][1], tag, m[3], inside))
            stack.append((tag, len(nodes) - 1))
        else:
            stack.append((tag, stack[-1][1]))
            in_link += tag == "a"
    flush()
    return Page(nodes, blocks)


def skeleton(page: Page) -> tuple[str, list[int]]:
    """The tree as text with runs of like siblings folded into one, and the folded node of every node.

    Nodes of the text are numbered in its order. ``a(b,c*)`` is a with the children b and a run of c.
    """
    children: list[list[int]] = [[] for _ in page.nodes]
    for k, n in enumerate(page.nodes):
        if n.parent >= 0:
            children[n.parent].append(k)
    shape: list[str] = [""] * len(page.nodes)
    runs: list[list[list[int]]] = [[] for _ in page.nodes]
    for k in range(len(page.nodes) - 1, -1, -1):  # children come after their parents
        for c in children[k]:
            if runs[k] and shape[runs[k][-1][0]] == shape[c]:
                runs[k][-1].append(c)
            else:
                runs[k].append([c])
        inner = ",".join(shape[r[0]] + ("*" if len(r) > 1 else "") for r in runs[k])
        label = re.sub(r"[(),*]", "_", page.nodes[k].label)
        shape[k] = f"{label}({inner})" if inner else label
    folded, count = [0] * len(page.nodes), 0
    todo = [[0]]
    while todo:
        group = todo.pop()
        for k in group:
            folded[k] = count
        count += 1
        # members of a run have equal shapes, so their runs of children line up
        lined = [[c for k in group for c in runs[k][j]] for j in range(len(runs[group[0]]))]
        todo += reversed(lined)
    return shape[0], folded


class Tree(NamedTuple):
    labels: list[str]
    children: list[list[int]]


def read_skeleton(text: str) -> Tree:
    labels: list[str] = []
    children: list[list[int]] = []
    open_nodes: list[int] = []
    for token in re.findall(r"[^(),*]+|[(),*]", text):
        if token == "(":
            open_nodes.append(len(labels) - 1)
        elif token == ")":
            open_nodes.pop()
        elif token not in ",*":
            labels.append(token)
            children.append([])
            if open_nodes:
                children[open_nodes[-1]].append(len(labels) - 1)
    return Tree(labels, children)


def match_trees(a: Tree, b: Tree) -> dict[int, int]:
    """Simple tree matching: the largest order-keeping matching of like nodes whose parents match; a's node to b's."""
    known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    post: list[tuple[int, int]] = []
    todo = [(0, 0)]
    while todo:  # pairs that may match, parents first
        i, j = todo.pop()
        post.append((i, j))
        todo += [(c, d) for c in a.children[i] for d in b.children[j] if a.labels[c] == b.labels[d]]
    for i, j in reversed(post):
        left, right = a.children[i], b.children[j]
        best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for x, c in enumerate(left, 1):
            for y, d in enumerate(right, 1):
                gain = known[c, d][0] if a.labels[c] == b.labels[d] else 0
                best[x][y] = max(best[x - 1][y], best[x][y - 1], best[x - 1][y - 1] + gain)
        pairs, x, y = [], len(left), len(right)
        while x and y:
            if best[x][y] == best[x - 1][y]:
                x -= 1
            elif best[x][y] == best[x][y - 1]:
                y -= 1
            else:
                x, y = x - 1, y - 1
                pairs.append((left[x], right[y]))
        known[i, j] = (1 + best[-1][-1], pairs)
    out: dict[int, int] = {}
    todo = [(0, 0)] if a.labels[0] == b.labels[0] else []
    while todo:
        i, j = todo.pop()
        out[i] = j
        todo += known[i, j][1]
    return out

"""A small reader of HTML: block elements as nodes, text in blocks, and features of every node."""

from __future__ import annotations

import html as entities
import math
import re
from dataclasses import dataclass, field

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"
    r"([^>\"']*+(?:\"[^\"<]*+\"[^>\"']*+|'[^'<]*+'[^>\"']*+)*+>|[^>]*>|[^>]*\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# fixed values: the elements of HTML by kind
RAW = frozenset("script style noscript template iframe svg object audio video canvas title textarea head".split())
_TO_END = frozenset("script style iframe title textarea".split())  # raw text: without an end tag they run to the end of the page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = tuple(("body div section article main aside nav header footer h1 h2 h3 h4 h5 h6 p ul ol li dl dt dd table tbody thead tfoot "
                "tr td th caption form fieldset legend label button select option blockquote pre figure figcaption address "
                "details summary dialog hgroup center menu search").split())
_BLOCK = frozenset(BLOCKS)
_INLINE_PARENTS = frozenset("p h1 h2 h3 h4 h5 h6".split())  # end where a block starts
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
_DEEPEST = 512  # elements below this depth lie beside each other, as in browsers
_FENCES = frozenset("table ul ol dl select body".split())  # implied ends do not reach beyond these
# fixed values: first letters of words in attributes that tell what a part of a page is for
TOKEN_GROUPS = {
    "content": ("article", "content", "post", "entry", "story", "main", "body", "text", "prose"),
    "menu": ("nav", "menu", "breadcrumb", "toc", "pagination", "pager", "tabs", "toolbar"),
    "edge": ("header", "footer", "masthead", "topbar", "bottom", "copyright", "legal", "colophon", "credits"),
    "side": ("sidebar", "side", "aside", "widget", "rail", "related", "recommend", "popular", "more", "tags", "teaser"),
    "advert": ("ad", "ads", "adv", "advert", "advertisement", "banner", "promo", "sponsor", "sponsored", "affiliate"),
    "notice": ("notice", "cookie", "consent", "alert", "popup", "modal", "overlay", "gdpr", "disclaimer", "message", "warning"),
    "form": ("form", "search", "login", "signup", "subscribe", "newsletter", "contact", "register"),
    "comment": ("comment", "comments", "reply", "respond", "discussion", "disqus", "replies", "feedback", "reviews"),
    "social": ("social", "share", "sharing", "follow", "byline", "author", "meta"),
}
_WHOLE = frozenset({"ad", "ads", "adv", "side", "more", "tags", "text", "body", "main", "meta"})
_GROUP_OF_ROLE = {"navigation": "menu", "banner": "edge", "contentinfo": "edge", "complementary": "side", "main": "content",
                  "article": "content", "search": "form", "dialog": "notice", "alert": "notice"}


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    groups: frozenset[str]
    order: int  # place among the children of the parent
    children: int = 0
    chars: int = 0
    linked: int = 0
    words: int = 0
    stops: int = 0
    tags: int = 0
    paragraphs: int = 0
    runs: list[int] = field(default_factory=list)


def token_groups(attributes: str) -> frozenset[str]:
    """Groups of the words in class, id, role and the like."""
    found = set()
    for name, *values in _ATTRIBUTE.findall(attributes):
        for word in _PART.findall("".join(values)):
            word = word.lower()
            if name.lower() == "role":
                found.add(_GROUP_OF_ROLE.get(word, "other"))
                continue
            for group, heads in TOKEN_GROUPS.items():
                if any(word == head or (head not in _WHOLE and word.startswith(head)) for head in heads):
                    found.add(group)
    return frozenset(found)


def parse(source: str | None) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes in page order (the first is the body) and the text runs (node, text) between the borders of blocks."""
    nodes = [Node("body", -1, 0, frozenset(), 0)]
    stack: list[tuple[str, int]] = [("body", 0)]  # open elements with the node that holds their text
    runs: list[tuple[int, str]] = []
    parts: list[str] = []
    links = 0
    source = source or ""

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                owner = stack[-1][1]
                nodes[owner].runs.append(len(runs))
                runs.append((owner, text))

    def close(to: int) -> None:
        nonlocal links
        if any(tag in _BLOCK for tag, _ in stack[to:]):
            flush()
        links -= sum(tag == "a" for tag, _ in stack[to:])
        del stack[to:]

    def opened(tags, fences=_FENCES) -> int:
        """Place of the innermost open element of ``tags``, 0 if there is none up to the next fence."""
        for at in range(len(stack) - 1, 0, -1):
            if stack[at][0] in tags:
                return at
            if stack[at][0] in fences:
                return 0
        return 0

    at, size = 0, len(source)
    while at < size:
        match = _TAG.search(source, at)
        text = source[at: match.start()] if match else source[at:]
        if text:
            parts.append(text)
            if links:
                nodes[stack[-1][1]].linked += len(text)
        if not match:
            break
        at = match.end()
        tag = (match[2] or "").lower()
        if not tag:
            continue
        if match[1]:
            if tag in ("body", "html"):
                continue  # what follows still belongs to the body
            place = opened({tag}, frozenset() if tag in _BLOCK and tag not in _CLOSES else _FENCES)
            if place:
                close(place)
            continue
        if tag in ("svg", "math") and match[3].endswith("/>"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, at)
            if end is None:
                at = size if tag in _TO_END else at  # others do not hide the page
            else:
                close_at = source.find(">", end.end())
                at = size if close_at < 0 else close_at + 1
            continue
        if tag in ("html", "body"):
            if tag == "body":
                nodes[0].groups = token_groups(match[3])
            continue
        if tag in VOID:
            if tag in ("br", "hr", "wbr") or tag == "img":
                parts.append("" if tag == "wbr" else " ")
            continue
        if tag in _BLOCK:
            if tag in _CLOSES and (place := opened(_CLOSES[tag])):
                close(place)
            while place := opened(_INLINE_PARENTS, _FENCES | {"button", "td", "th", "li"}):
                close(place)
            flush()
            parent = stack[-1][1]
            above = nodes[parent]
            nodes.append(Node(tag, parent, above.depth + 1, token_groups(match[3]) if "=" in match[3] else frozenset(), above.children))
            above.children += 1
            if len(stack) < _DEEPEST:
                stack.append((tag, len(nodes) - 1))
        else:
            nodes[stack[-1][1]].tags += 1
            if not match[3].rstrip(">").endswith("/") and len(stack) < _DEEPEST:
                stack.append((tag, stack[-1][1]))
                links += tag == "a"
    flush()
    return nodes, runs


FEATURES = (["depth", "order", "siblings", "same_siblings", "log_chars", "share", "link_density", "tag_density", "stop_density",
             "mean_run", "paragraphs", "own_log_chars", "before", "nested"]
            + [f"is_{tag}" for tag in BLOCKS if tag not in ("body", "tbody", "thead", "tfoot", "hgroup", "center", "caption", "legend")]
            + [f"in_{tag}" for tag in ("nav", "aside", "header", "footer", "form", "article", "main", "li", "table", "dialog")]
            + [f"own_{group}" for group in TOKEN_GROUPS] + [f"in_group_{group}" for group in TOKEN_GROUPS])
_AT = {name: k for k, name in enumerate(FEATURES)}


def features(nodes: list[Node], runs: list[tuple[int, str]]) -> list[list[float]]:
    """One row of ``FEATURES`` for each node: own tag and attributes, those above, siblings and the subtree."""
    own = [0] * len(nodes)
    for owner, text in runs:
        node = nodes[owner]
        own[owner] += len(text)
        node.chars += len(text)
        node.words += text.count(" ") + 1
        node.stops += text.count(".") + text.count(",")
        node.paragraphs += node.tag == "p"
    counts = [len(node.runs) for node in nodes]
    for k in range(len(nodes) - 1, 0, -1):  # children come after their parents
        node, above = nodes[k], nodes[nodes[k].parent]
        above.chars += node.chars
        above.linked += node.linked
        above.words += node.words
        above.stops += node.stops
        above.tags += node.tags + 1
        above.paragraphs += node.paragraphs
        counts[node.parent] += counts[k]
    kin: dict[tuple[int, str], int] = {}
    for node in nodes:
        kin[node.parent, node.tag] = kin.get((node.parent, node.tag), 0) + 1
    total = max(1, nodes[0].chars)
    table, before = [], 0
    inherited: list[list[int]] = []
    for k, node in enumerate(nodes):
        row = [0.0] * len(FEATURES)
        siblings = nodes[node.parent].children if k else 1
        row[: 14] = [node.depth, node.order, siblings, kin[node.parent, node.tag] / siblings, math.log1p(node.chars), node.chars / total,
                     min(1.0, node.linked / max(1, node.chars)), node.tags / max(1, node.chars), node.stops / max(1, node.chars),
                     node.words / max(1, counts[k]), node.paragraphs, math.log1p(own[k]), before / total, node.children]
        before += own[k]
        above = inherited[node.parent] if k else []
        for at in above:
            row[at] = 1.0
        mine = [at for at in (_AT.get(f"in_{node.tag}"), *(_AT[f"in_group_{g}"] for g in node.groups if g in TOKEN_GROUPS)) if at is not None]
        inherited.append(above + mine if mine else above)
        if (at := _AT.get(f"is_{node.tag}")) is not None:
            row[at] = 1.0
        for group in node.groups:
            if group in TOKEN_GROUPS:
                row[_AT[f"own_{group}"]] = 1.0
        table.append(row)
    return table

"""Main text of web pages: gradient-boosted trees over the nodes of a page, decoded from the root down.

Every block element is a node with features of its tag, its attribute words and those above it, its depth and siblings, and its
subtree (text, links, stops, share of the page). Boosted trees give the probability that a node holds main text. Decoding picks the likeliest labelling of the
whole tree in which no node below a rejected one is kept: a dynamic programme from the leaves up, read from
the root down.

There are no labelled pages, so labels are derived for a bounded sample. Pages that mark their article with
``<article>`` or ``<main>`` give their own labels, and the paragraphs of these pages are set into invented layouts
(plain ``div``s and tables, sidebars, notices, adverts, forms, comments) whose labels are known by construction.

Defined results: a null or empty page has an empty text; markup that is cut off is read as far as it goes. White
space is any run of Unicode white space. Repeated rows get equal results; extra columns are not read. Without a
page to learn from, nodes are judged by the invented layouts with placeholder words.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsignal.llm import dom
from newsignal.llm.linear import sampled
from newsignal.llm.shared import materialise

_MARKS = frozenset({"article", "main"})
_ASIDE_TAGS = frozenset({"nav", "aside", "header", "footer", "form", "dialog", "menu", "button", "select", "search"})
_ASIDE_GROUPS = frozenset(dom.TOKEN_GROUPS) - {"content", "social"}


def teacher(nodes: list[dom.Node]) -> list[int] | None:
    """Labels of a page that marks its article: whether a node holds text of it. None for other pages."""
    inside, aside = [False] * len(nodes), [False] * len(nodes)
    for k, node in enumerate(nodes):
        up = node.parent if k else None
        inside[k] = node.tag in _MARKS or (up is not None and inside[up])
        aside[k] = node.tag in _ASIDE_TAGS or bool(node.groups & _ASIDE_GROUPS and node.tag not in _MARKS and k > 0) or (up is not None and aside[up])
    if not any(inside):
        return None
    label = [int(inside[k] and not aside[k] and bool(node.runs)) for k, node in enumerate(nodes)]
    for k in range(len(nodes) - 1, 0, -1):
        label[nodes[k].parent] |= label[k]
    return label


def layout(paragraphs: list[str], title: str, words: list[str], seed: int) -> tuple[str, list[int]]:
    """An invented page around ``paragraphs`` and, in the order of its nodes, whether each holds main text."""
    rng = random.Random(seed)
    out: list[str] = []
    labels = [1]

    def node(tag: str, main: int, attributes: str = "", text: str = "") -> None:
        labels.append(main)
        out.append(f"<{tag}{attributes}>{text}")

    def close(tag: str) -> None:
        out.append(f"</{tag}>")

    def phrase(low: int = 1, high: int = 6) -> str:
        return " ".join(rng.choice(words) for _ in range(rng.randint(low, high)))

    def mark(*names: str) -> str:
        name = rng.choice(names)
        return rng.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {rng.choice("abcdef")}{rng.randint(1, 99)}"'])

    def links(tag: str, many: int, attributes: str) -> None:
        node(tag, 0, attributes)
        node("ul", 0)
        for _ in range(many):
            node("li", 0, "", f'<a href="/{rng.randint(1, 9999)}">{phrase(1, 5)}</a></li>')
        out.append("</ul>")
        close(tag)

    def prose(tag: str, many: int, attributes: str, inner: str = "p", wrap: str | None = None) -> None:
        node(tag, 0, attributes)
        for _ in range(many):
            if wrap:
                node("div", 0, wrap)
            node(inner, 0, "", f"{rng.choice(paragraphs)}</{inner}>")
            if wrap:
                close("div")
        close(tag)

    def header():
        node(tag := rng.choice(["header", "div"]), 0, "" if tag == "header" and rng.random() < .5 else mark("header", "site-header", "masthead", "topbar"))
        node("div", 0, "", f"{phrase(1, 3)}</div>")
        if rng.random() < .5:
            links(rng.choice(["nav", "div"]), rng.randint(3, 8), mark("navbar", "menu", "main-nav"))
        close(tag)

    def menu():
        plain = rng.random() < .4
        links("nav" if plain else "div", rng.randint(3, 9), "" if plain else mark("nav", "menu", "breadcrumbs", "navigation"))

    def advert():
        node("div", 0, mark("ad", "ad-slot", "advert", "banner", "sponsored", "promo"), f"{rng.choice([phrase(3, 12), rng.choice(paragraphs)])}</div>")

    def notice():
        node("div", 0, mark("cookie-notice", "notice", "consent", "alert", "popup"))
        node("p", 0, "", f"{rng.choice([phrase(5, 15), rng.choice(paragraphs)])}</p>")
        if rng.random() < .6:
            node("button", 0, "", f"{phrase(1, 2)}</button>")
        close("div")

    def form():
        node("form", 0, rng.choice(["", mark("newsletter", "search-form", "login")]))
        if rng.random() < .5:
            node("p", 0, "", f"{phrase(4, 12)}</p>")
        node("label", 0, "", f'{phrase(1, 3)}<input name="q"></label>')
        node("button", 0, "", f"{phrase(1, 2)}</button>")
        close("form")

    def sidebar():
        tag = rng.choice(["aside", "div", "section"])
        attributes = "" if tag == "aside" and rng.random() < .5 else mark("sidebar", "widget", "related", "side-column")
        if rng.random() < .5:
            links(tag, rng.randint(2, 6), attributes)
        else:
            prose(tag, rng.randint(1, 3), attributes)

    def comments():
        tag = rng.choice(["section", "div", "div"])
        node(tag, 0, mark("comments", "comment-list", "discussion", "reader-comments"))
        if rng.random() < .5:
            node("h3", 0, "", f"{phrase(1, 3)}</h3>")
        for _ in range(rng.randint(1, 5)):
            node(inner := rng.choice(["div", "li", "article"]), 0, rng.choice([mark("comment", "reply"), ""]))
            node("p", 0, "", f"{rng.choice([phrase(4, 20), rng.choice(paragraphs)])}</p>")
            close(inner)
        close(tag)

    def footer():
        tag = rng.choice(["footer", "div"])
        attributes = "" if tag == "footer" else mark("footer", "site-footer", "copyright")
        if rng.random() < .5:
            node(tag, 0, attributes, f"&copy; {phrase(2, 10)}")
        else:
            node(tag, 0, attributes)
            node("p", 0, "", f"&copy; {rng.choice([phrase(2, 10), rng.choice(paragraphs)])}</p>")
        close(tag)

    def article(extra) -> None:
        wrap = rng.choice(["article", "main", "div", "div", "section", "table"])
        if wrap == "table":
            for tag in ("table", "tr", "td"):
                node(tag, 1, "")
        else:
            node(wrap, 1, "" if wrap in _MARKS or rng.random() < .3 else mark("content", "post", "entry-content", "article-body", "story", "main"))
        if rng.random() < .8:
            node(tag := rng.choice(["h1", "h1", "h2"]), 1, "", f"{title}</{tag}>")
        middle = rng.randint(0, len(paragraphs))
        for k, text in enumerate(paragraphs):
            if k == middle and extra:
                rng.choice(extra)()
            kind = rng.random()
            if kind < .8:
                node("p", 1, "", rng.choice([f"{text}</p>", text, f"<b>{text}</b></p>", f'{text} <a href="/x">{phrase(1, 3)}</a></p>']))
            elif kind < .87:
                node("blockquote", 1, "", f"{text}</blockquote>")
            elif kind < .94:
                node("ul", 1)
                for _ in range(rng.randint(2, 4)):
                    node("li", 1, "", f"{phrase(3, 15)}</li>")
                out.append("</ul>")
            else:
                node(tag := rng.choice(["h2", "h3", "pre"]), 1, "", f"{phrase(2, 6) if tag != 'pre' else text}</{tag}>")
        out.append("</td></tr></table>" if wrap == "table" else f"</{wrap}>")

    for part in (header, menu, notice, advert, sidebar):
        if rng.random() < .5:
            part()
    if shell := rng.random() < .5:
        node("div", 1, rng.choice(["", mark("page", "wrapper", "container", "main")]))
    article([advert, form, notice, sidebar] if rng.random() < .4 else [])
    for part in (comments, sidebar, advert, form):
        if rng.random() < .45:
            part()
    if shell:
        close("div")
    for part in (menu, notice, footer):
        if rng.random() < .6:
            part()
    return "<html><body>" + "".join(out) + "</body></html>", labels


@dataclass(frozen=True)
class Forest:
    """Regression trees as arrays; a leaf points at itself."""
    feature: np.ndarray  # trees x nodes
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weight: np.ndarray
    depth: int

    @staticmethod
    def of(model: GBTClassificationModel) -> Forest:
        trees = [_flat(tree._call_java("rootNode")) for tree in model.trees]
        most = max(len(tree) for tree in trees)
        padded = np.array([tree + [(0, 0.0, 0, 0, 0.0)] * (most - len(tree)) for tree in trees], dtype=float)
        whole = [padded[:, :, k].astype(int) for k in (0, 2, 3)]
        return Forest(whole[0], padded[:, :, 1], whole[1], whole[2], padded[:, :, 4], np.array(model.treeWeights),
                      max(tree.depth for tree in model.trees))

    def probability(self, rows: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(rows))
        every = np.arange(len(rows))
        for t, weight in enumerate(self.weight):
            at = np.zeros(len(rows), dtype=int)
            for _ in range(self.depth):
                low = rows[every, self.feature[t][at]] <= self.threshold[t][at]
                at = np.where(low, self.left[t][at], self.right[t][at])
            margin += weight * self.value[t][at]
        return 1.0 / (1.0 + np.exp(-2.0 * margin))


def _flat(root) -> list[tuple[int, float, int, int, float]]:
    """(feature, threshold, left, right, value) of the nodes of a fitted tree."""
    out: list = []

    def walk(node) -> int:
        at = len(out)
        out.append(None)
        if node.numDescendants() == 0:
            out[at] = (0, 0.0, at, at, node.prediction())
        else:
            split = node.split()
            left, right = walk(node.leftChild()), walk(node.rightChild())
            out[at] = (split.featureIndex(), split.threshold(), left, right, node.prediction())
        return at

    walk(root)
    return out


_PLACEHOLDER = ["One sentence of a paragraph, and then another one that goes on for a while. It ends here.",
                "A second paragraph, with commas, that says a little more than the first one did before it."]


def examples(pages: DataFrame, layouts: int = 2) -> DataFrame:
    """features, label of the nodes of the pages that mark their article, and of ``layouts`` layouts of their text."""
    def of_page(source: str | None, seed: int) -> list[tuple[list[float], int]]:
        nodes, runs = dom.parse(source)
        labels = teacher(nodes)
        found = list(zip(dom.features(nodes, runs), labels)) if labels else []
        texts = [text for owner, text in runs if labels and labels[owner] and len(text) > 40]
        titles = [text for owner, text in runs if labels and labels[owner] and nodes[owner].tag == "h1"]
        paragraphs = [t.replace("<", " ").replace("&", "and") for t in texts[:40]] or _PLACEHOLDER
        words = sorted(set(" ".join(paragraphs).split()))
        for k in range(layouts):
            made, known = layout(paragraphs, (titles or words)[0].replace("<", " "), words, seed * layouts + k)
            nodes, runs = dom.parse(made)
            if len(nodes) == len(known):
                found += zip(dom.features(nodes, runs), known)
        return found

    def run(batches):
        for batch in batches:
            for source, seed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = of_page(source, seed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f for f, _ in found], pa.list_(pa.float64())), pa.array([y for _, y in found], pa.int32())], names=["features", "label"])

    seeded = pages.select("html", F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)).alias("seed"))
    return seeded.mapInArrow(run, "features array<double>, label int")


def fit(pages: DataFrame, *, bound: int = 400, layouts: int = 2, trees: int = 12, depth: int = 5) -> Forest:
    """Fit on a sample of at most about ``bound`` pages (page_id, url, html), chosen by a hash of the id."""
    sample = sampled(pages.withColumnRenamed("page_id", "doc_id"), bound).withColumnRenamed("doc_id", "page_id")
    some = examples(sample, layouts)
    plain = examples(pages.sparkSession.createDataFrame([(k, "", None) for k in range(20)], "page_id long, url string, html string"), layouts)
    rows = materialise(some.unionByName(plain).repartition(4))
    learner = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.4, maxBins=32, seed=1, featuresCol="x", labelCol="y")
    return Forest.of(learner.fit(rows.select(array_to_vector("features").alias("x"), F.col("label").cast("double").alias("y"))))


def decode(nodes: list[dom.Node], chances: np.ndarray) -> list[bool]:
    """Likeliest labels in which nothing below a rejected node is kept. The body itself is always open."""
    p = np.clip(chances, 1e-6, 1.0 - 1e-6)
    keep, drop = np.log(p).tolist(), np.log1p(-p).tolist()
    for k in range(len(nodes) - 1, 0, -1):  # children come after their parents
        up = nodes[k].parent
        keep[up] += max(keep[k], drop[k])
        drop[up] += drop[k]
    kept = [True] * len(nodes)
    for k in range(1, len(nodes)):
        kept[k] = kept[nodes[k].parent] and keep[k] > drop[k]
    return kept


def main_texts(sources: list[str | None], forest: Forest, step: int = 256) -> list[str]:
    """Main text of every page."""
    texts: list[str] = []
    for first in range(0, len(sources), step):
        parsed = [dom.parse(source) for source in sources[first: first + step]]
        table = np.array([row for nodes, runs in parsed for row in dom.features(nodes, runs)])
        chances = forest.probability(table)
        at = 0
        for nodes, runs in parsed:
            own = chances[at: at + len(nodes)]
            at += len(nodes)
            kept = decode(nodes, own)
            # text that stands in the body itself is judged like that of a node
            kept[0] = bool(own[0] >= 0.5)
            texts.append("\n".join(text for owner, text in runs if kept[owner]))
    return texts


def extract(pages: DataFrame, forest: Forest) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    def run(batches):
        for batch in batches:
            texts = main_texts(batch.column(2).to_pylist(), forest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")

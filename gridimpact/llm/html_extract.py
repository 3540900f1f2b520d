"""Main text of web pages by boosted trees over the elements of the page.

Each element gets features of its subtree (text, links, punctuation), its tag and attribute words, those of its
ancestors, its depth and its siblings. Gradient-boosted trees say how likely it belongs to the article; then the labels of
the whole tree are chosen together, so nothing below a dropped element is kept and an element is dropped only if
that explains all below it best.

There are no labelled pages, so the trees learn from pages laid out anew, whose labels are known by construction: at most
`max_pages` pages, chosen by a hash of their content, lend their texts, whatever tags and names surround them. Long blocks become
articles and comments, short ones the rest, in layouts of many kinds: with telling names, with names that tell nothing, and with
none. Pages without such texts get made-up words, so there is always something to learn from.

Where that would leave nothing of a page that shows text, what stands in no element with an aside's tag or name is kept.

Defined results: null and empty html give an empty text; repeated rows are separate rows; an empty table gives an empty table; extra
columns are ignored. A line break counts as white space inside its block. What a browser never shows (scripts, styles, titles,
templates, frames' fallbacks) is no text.
"""

from __future__ import annotations

import html
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridimpact.llm.common import bounded_sample, written
from gridimpact.llm.html_dom import FEATURES, Page, decode, kept_text


class Trees:
    """Boosted regression trees as arrays; a leaf points to itself."""

    def __init__(self, trees: list[list[tuple[int, float, int, int, float]]], weights: list[float]):
        """A tree is a list of nodes (feature, threshold, left, right, value)."""
        self.trees = [tuple(np.array(column) for column in zip(*t, strict=True)) for t in trees]
        self.weights = weights

    @classmethod
    def of(cls, model) -> Trees:
        def flat(node, out: list) -> int:
            at = len(out)
            out.append(None)
            if node.getClass().getSimpleName() == "InternalNode":
                split = node.split()
                left, right = flat(node.leftChild(), out), flat(node.rightChild(), out)
                out[at] = (split.featureIndex(), float(split.threshold()), left, right, 0.0)
            else:
                out[at] = (0, 0.0, at, at, float(node.prediction()))
            return at

        trees = []
        for tree in model._java_obj.trees():
            nodes: list = []
            flat(tree.rootNode(), nodes)
            trees.append(nodes)
        return cls(trees, list(model.treeWeights))

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        rows = np.arange(len(x))
        for (feature, threshold, left, right, value), weight in zip(self.trees, self.weights, strict=True):
            at = np.zeros(len(x), int)
            while True:
                to = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
                if (to == at).all():
                    break
                at = to
            out += weight * value[at]
        return 2 * out


def material(page: Page, rng: random.Random, least: int = 80) -> tuple[list[str], list[str]]:
    """Long blocks of a page, in order, and its short ones; made-up ones where it has none."""
    made = lambda n: " ".join("".join(rng.choice("aeioubcdlmnprst") for _ in range(rng.randint(2, 9))) for _ in range(n))
    texts = [t for _, t in page.blocks]
    long = [t for t in texts if len(t) >= least] or [made(rng.randint(20, 120)).capitalize() + "." for _ in range(rng.randint(1, 8))]
    short = [t for t in texts if len(t) < least] or [made(rng.randint(1, 6)) for _ in range(8)]
    heading = rng.random()
    return ([" ".join(long[0].split()[: rng.randint(2, 12)])] if heading < 0.8 else []) + long, short + [rng.choice(long)]


def laid_out(main: list[str], rest: list[str], rng: random.Random) -> tuple[str, set[int]]:
    """A page with these texts in a layout by chance, and the order numbers of the blocks that belong to the article."""
    out: list[str] = []
    kept: set[int] = set()
    count = 0
    telling = rng.choice([1.0, 0.9, 0.6])  # how many names say what is inside
    esc = html.escape
    prose = [t for t in main if len(t) > 40] or main

    def put(text: str, tag: str, article: bool = False) -> None:
        nonlocal count
        text = " ".join(text.split())
        if not text:
            return
        out.append(f"<{tag}>{esc(text)}</{tag.split()[0]}>" if tag else esc(text))
        if article:
            kept.add(count)
        count += 1

    def box(tags: list[str], words: list[str], body, bare: float = 0.25) -> None:
        tag = rng.choice(tags)
        named = tag in ("div", "section", "ul") or rng.random() < 0.5
        label = rng.choice(words) + rng.choice(["", "", "-box", "_1", " clearfix"]) if rng.random() < telling else rng.choice("abcdefgh") + str(rng.randint(1, 99)) + rng.choice(["", " row", " xq"])
        out.append(f'<{tag} {rng.choice(["class", "class", "id"])}="{label}">' if named and rng.random() >= bare * (tag not in ("div", "section", "ul")) else f"<{tag}>")
        body()
        out.append(f"</{tag}>")

    def links() -> None:
        nonlocal count
        listed = rng.random() < 0.7
        out.append("<ul>" if listed else "<div>")
        names = [rng.choice(rest).split() or ["x"] for _ in range(rng.randint(3, 9))]
        for w in names:
            name = esc(" ".join(w[: rng.randint(1, 3)]))
            out.append(f'<li><a href="/{rng.randint(1, 99)}">{name}</a></li>' if listed else f'<div><a href="#">{name}</a></div>')
            count += 1
        out.append("</ul>" if listed else "</div>")

    chance = lambda p: rng.random() < p
    short = lambda: put(" ".join(rng.choice(rest).split()[: rng.randint(3, 30)]), rng.choice(["", "p", "span", "div"]))
    talk = lambda: [put(" ".join(rng.choice(prose).split()[: rng.randint(5, 60)]), rng.choice(["p", "div", 'div class="comment"', "li"])) for _ in range(rng.randint(1, 6))]

    def listed(text: str) -> None:
        """A text of the article as the rows of a table or as a list."""
        words = text.split()
        size = rng.randint(1, 12)
        parts = [" ".join(words[k : k + size]) for k in range(0, min(len(words), 10 * size), size)]
        if chance(0.5):
            width = rng.randint(1, 3)
            out.append("<table>" + "<tbody>" * chance(0.5))
            for k in range(0, len(parts), width):
                out.append("<tr>")
                for part in parts[k : k + width]:
                    put(part, "th" if k == 0 and chance(0.5) else "td", True)
                out.append("</tr>")
            out.append("</table>")
        else:
            kind, item = rng.choice([("ul", "li"), ("ol", "li"), ("dl", "dd")])
            out.append(f"<{kind}>")
            for part in parts:
                put(part, item, True)
            out.append(f"</{kind}>")

    def article() -> None:
        plain = rng.choice(["p", "p", "p", "div"])
        nested = chance(0.2)
        headed = chance(0.15)
        for k, text in enumerate(main):
            tag = rng.choice(["h1", "h2"]) if k == 0 and len(text) < 120 else rng.choice([plain] * 12 + ["blockquote", "li", "h2"])
            if chance(0.3):  # articles have short paragraphs too
                text = " ".join(text.split()[: rng.randint(1, 14)])
            if nested:
                out.append(rng.choice(["<div>", "<section>", '<div class="part">', '<div class="row">']))
            if k == 0 and headed:
                out.append("<header>")
            if k and chance(0.08):
                listed(text)
            else:
                put(text, tag, True)
            if k == 0 and headed:
                out.append("</header>")
            if nested:
                out.append("</section></div>")
            if rng.random() < 0.04:
                box(["div", "aside"], ["ad", "promo", "related", "share"], short)

    def form() -> None:
        put(rng.choice(["Search", "Your e-mail", "Subscribe", "Name"]), "label")
        out.append('<input type="text">')
        put(rng.choice(["Send", "Go", "OK"]), "button")

    if chance(0.08):  # a page that is nothing but its article, in an element of its own or not
        if chance(0.3):
            article()
        else:
            box(["article", "main", "div"], ["content", "post", "story", "main", "text"], article)
        return "<html><body>" * chance(0.5) + "".join(out), kept
    if chance(0.4):
        box(["header", "div"], ["header", "masthead", "top", "banner"], lambda: (put(" ".join(rng.choice(rest).split()[:4]), "h1" if chance(0.3) else "div"), links() if chance(0.5) else None))
    if chance(0.8):
        box(["nav", "div", "nav"], ["nav", "menu", "navbar", "navigation"], links)
    if chance(0.35):
        box(["div", "section"], ["cookie-notice", "consent", "notice", "gdpr", "alert"], short)
    if chance(0.25):
        box(["div"], ["breadcrumb", "breadcrumbs"], links)
    for _ in range(rng.choice([0, 1, 1, 2])):
        box(["div", "aside"], ["ad", "ads", "advert", "sponsored", "banner", "promo"], short)
    side_first = chance(0.3)
    side = lambda: box(["aside", "div"], ["sidebar", "widget", "related", "side"], lambda: (put("Related", "h3"), links(), short()))
    if side_first:
        side()
    if chance(0.1):
        article()
    else:
        box(["article", "main", "div", "div", "section"], ["content", "post", "entry-content", "story", "article-body", "main", "text", "page-body", "c12", "col"], article)
    if chance(0.3):
        box(["div"], ["share", "social", "tags"], links)
    if chance(0.45):
        box(["section", "div"], ["comments", "comment-list", "responses", "discussion", "replies"], lambda: (put(rng.choice(["Comments", "3 comments", "Replies"]), "h3"), talk()))
    if chance(0.3):
        box(["form", "div"], ["search", "newsletter", "signup", "form"], form)
    if not side_first and chance(0.4):
        side()
    if chance(0.9):
        box(["footer", "div", "footer"], ["footer", "site-footer", "copyright", "legal"], lambda: (short(), links() if chance(0.3) else None))
    return "<html><head><title>t</title></head><body>" + "".join(out) + "</body></html>", kept


def labelled_elements(page: Page, kept: set[int]) -> Iterator[tuple[float, np.ndarray]]:
    """Label (whether most of the text inside is kept) and features of every element with text."""
    good, whole = np.zeros(len(page.tag)), np.zeros(len(page.tag))
    for k, (node, t) in enumerate(page.blocks):
        whole[node] += len(t)
        good[node] += len(t) * (k in kept)
    for k in range(len(page.tag) - 1, 0, -1):
        good[page.parent[k]] += good[k]
        whole[page.parent[k]] += whole[k]
    x = page.features()
    for k in np.flatnonzero(whole > 0):
        yield float(good[k] > 0.5 * whole[k]), x[k]


def learning_rows(source: str, layouts: int, seed: int) -> Iterator[tuple[float, np.ndarray]]:
    """Rows of pages in which this page's texts are laid out anew."""
    rng = random.Random(seed)
    main, rest = material(Page(source), rng)
    for _ in range(layouts):
        chosen = main if rng.random() < 0.7 else main[: rng.randint(1, 6)]
        if rng.random() < 0.1:  # articles of a line or two
            chosen = [" ".join(t.split()[: rng.randint(1, 12)]) for t in chosen[: rng.randint(1, 2)]]
        text, kept = laid_out(chosen, rest, rng)
        yield from labelled_elements(Page(text), kept)


def fit(pages: DataFrame, max_pages: int, layouts: int, rounds: int = 20, depth: int = 5) -> Trees:
    """Trees from at most max_pages pages (html) of different content; only their hashes are put in order, so no task gathers pages."""
    keyed = pages.select(F.xxhash64("html").alias("h"), "html")
    chosen = bounded_sample(keyed.select("h"), "h", max_pages, once=True)
    sample = keyed.join(F.broadcast(chosen), "h", "left_semi").groupBy("h").agg(F.first("html").alias("html"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(learning_rows(source, layouts, h))
                yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in found]), *(pa.array(c) for c in np.array([x for _, x in found]).T)], ["label", *FEATURES])

    table = written(sample.repartition(6, "h").mapInArrow(rows, ", ".join(f"{c} double" for c in ["label", *FEATURES])), "elements")
    if table.isEmpty():  # no pages at all
        return Trees([], [])
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(table).select("label", "x")
    return Trees.of(GBTClassifier(featuresCol="x", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=3).fit(vectors))


def main_text(pages: DataFrame, id_col: str = "page_id", max_pages: int = 400, layouts: int = 3) -> DataFrame:
    """id, url, text and n_chars of every page."""
    rows = pages.select(F.coalesce("html", F.lit("")).alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(fit(rows, max_pages, layouts))
    rows = pages.select(F.col(id_col), "url", F.coalesce("html", F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                batch = whole.slice(k, 64)
                read = [Page(h) for h in batch.column(2).to_pylist()]
                logits = trees.logit(np.concatenate([p.features() for p in read]))
                ends = np.cumsum([len(p.tag) for p in read])
                texts = [kept_text(p, decode(p, own)) for p, own in zip(read, np.split(logits, ends[:-1]), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names)

    names = [id_col, "url", "text"]
    kinds = [f.dataType.simpleString() for f in rows.schema]
    return rows.mapInArrow(run, f"`{id_col}` {kinds[0]}, url {kinds[1]}, text string").withColumn("n_chars", F.length("text").cast("long"))

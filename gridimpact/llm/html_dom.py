"""A small tolerant HTML reader: element tree, text blocks in page order, and statistics of every element."""

from __future__ import annotations

import html
import re
from collections import defaultdict

import numpy as np

_NAME = r"""<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)"""
TAG = re.compile(rf"""{_NAME}((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
#: For the rest of a page from a quote that never ends: quotes mean nothing there, so a page is read in linear time whatever it holds.
ROUGH = re.compile(rf"""{_NAME}([^>]*)>""")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
PART = re.compile(r"[A-Za-z][a-z]*")

#: Element names of HTML. HIDDEN content is never shown; PLAIN content is text without markup, decoded only where it says so.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style title iframe noembed noframes template".split())
PLAIN = {"textarea": True, "xmp": False}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder svg g text tspan object canvas".split()
)
#: Start tags that end an open element of one of the first names, if none of the others stands between.
CLOSES = {
    "li": ("li", "ul ol table"), "dt": ("dt dd", "dl table"), "dd": ("dt dd", "dl table"), "tr": ("tr", "table"), "td": ("td th", "table"),
    "th": ("td th", "table"), "option": ("option", "select table"),
}
ASIDE_TAGS = frozenset("nav aside footer header form button select menu dialog fieldset".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 blockquote pre li td dd figcaption".split())
MAIN_TAGS = frozenset("article main".split())
#: Parts of class, id and role names.
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu sidebar side aside footer foot header masthead topbar ad ads adv advert advertisement sponsor sponsored banner promo cookie cookies consent gdpr notice alert popup modal newsletter subscribe signup login comment comments reply replies response responses discussion disqus share sharing social related recommended widget breadcrumb breadcrumbs pagination pager toolbar search form copyright legal disclaimer tags meta byline complementary contentinfo".split()
)
MAIN_WORDS = frozenset("article main content post entry story body text prose page hentry single".split())


def unescape(text: str) -> str:
    return html.unescape(text) if "&" in text else text


def _end_of(name: str, source: str, at: int) -> tuple[int, int]:
    """Where the content that starts at a place ends, and where the page goes on; a template may hold others."""
    depth = 1
    for m in re.compile(rf"<(/?){name}(?=[\s/>])", re.I).finditer(source, at):
        depth += -1 if m[1] else name == "template"
        if not depth:
            end = source.find(">", m.end())
            return m.start(), len(source) if end < 0 else end + 1
    return len(source), len(source)


class Page:
    """Elements in page order: parent, tag, depth, attribute words; blocks: (element, text).

    Every step looks at the ends of a few lists only, so reading is linear in the page, however deep it is nested.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.depth = [-1], ["#root"], [0]
        self.words: list[frozenset[str]] = [frozenset()]
        self.blocks: list[tuple[int, str]] = []
        self.linked: list[int] = [0]  # characters of link text inside, own blocks only
        self._open, self._blocks, self._places = [0], [0], defaultdict(list)  # open elements; places of those that are not inline; places by name
        pending: list[str] = []
        block = 0

        def flush() -> None:
            text = " ".join("".join(pending).split())
            pending.clear()
            if text:
                self.blocks.append((block, text))

        def put(text: str) -> None:
            if text:
                pending.append(text)
                if self._places["a"]:
                    self.linked[block] += len(text.strip())

        at, tag, last = 0, TAG, source.rfind(">") + 1  # no tag ends after the last ">"
        while at < len(source):
            start = source.find("<", at, last)
            put(unescape(source[at : start if start >= 0 else len(source)]))
            if start < 0:
                break
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                at = end + 3 if end >= 0 else len(source)
                continue
            m = tag.match(source, start, last)
            if not m and (m := ROUGH.match(source, start, last)):
                tag = ROUGH
            if not m:
                put("<")
                at = start + 1
                continue
            at, name = m.end(), (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                if name not in INLINE:
                    flush()
                places = self._places[name]
                if places and not (name in INLINE and self._blocks[-1] > places[-1]):
                    self._close(places[-1])
                block = self._open[self._blocks[-1]]
                continue
            empty = m[3].endswith("/")
            if name in HIDDEN and not empty:
                at = _end_of(name, source, at)[1]
                pending.append(" ")
                continue
            if name in VOID:
                pending.append(" ")
                if name == "hr":
                    flush()
                continue
            if name not in INLINE:
                flush()
                self._close_for(name)
            node, up = len(self.tag), self._open[-1]
            self.parent.append(up)
            self.tag.append(name)
            self.depth.append(self.depth[up] + 1)
            self.words.append(frozenset(p.lower() for _, v in ATTRIBUTE.findall(m[3]) for p in PART.findall(v)))
            self.linked.append(0)
            if name in PLAIN and not empty:
                block = node
                end, at = _end_of(name, source, at)
                put(unescape(source[m.end() : end]) if PLAIN[name] else source[m.end() : end])
                flush()
            elif not empty:
                self._places[name].append(len(self._open))
                if name not in INLINE:
                    self._blocks.append(len(self._open))
                self._open.append(node)
            block = self._open[self._blocks[-1]]
        flush()

    def _close(self, place: int) -> None:
        """Ends the open elements from a place on."""
        while len(self._open) > place:
            self._places[self.tag[self._open.pop()]].pop()
            if self._blocks[-1] == len(self._open):
                self._blocks.pop()

    def _close_for(self, name: str) -> None:
        """Ends the elements whose end tags may be missing before this start tag."""
        if self.tag[self._open[self._blocks[-1]]] == "p":
            self._close(self._blocks[-1])
        if name in CLOSES:
            last = lambda names: max((self._places[n][-1] for n in names.split() if self._places[n]), default=0)
            same, bound = map(last, CLOSES[name])
            if same > bound:
                self._close(same)

    def features(self) -> np.ndarray:
        """A row of FEATURES for each element."""
        n = len(self.tag)
        parent = np.array(self.parent)
        own, link, marks, blocks = (np.zeros(n) for _ in range(4))
        for node, text in self.blocks:
            own[node] += len(text)
            marks[node] += sum(map(text.count, ".,;:!?"))
            blocks[node] += 1
        link[:] = self.linked
        sums = [own.copy(), link, marks, blocks, np.ones(n)]
        for k in range(n - 1, 0, -1):  # children come after their parents
            for s in sums:
                s[parent[k]] += s[k]
        text, link, marks, blocks, size = sums
        index, family = np.zeros(n), np.zeros(n)
        for k in range(1, n):
            index[k] = family[parent[k]]
            family[parent[k]] += 1
        up = np.maximum(parent, 0)
        flag = lambda tags: np.array([t in tags for t in self.tag], float)
        words = lambda known: np.array([len(w & known) for w in self.words], float)
        aside, main = flag(ASIDE_TAGS), flag(MAIN_TAGS)
        aside_words, main_words = words(ASIDE_WORDS), words(MAIN_WORDS)
        above = [np.zeros(n) for _ in range(4)]
        for a, x in zip(above, (aside, main, aside_words, main_words), strict=True):
            for k in range(1, n):
                a[k] = max(a[parent[k]], min(x[parent[k]], 1.0))
        before = np.zeros(n)  # share of the page's text before the element
        order = np.zeros(n + 1)
        for node, t in self.blocks:
            order[node + 1] += len(t)
        before = np.cumsum(order)[:n] / max(1.0, text[0])
        prior = np.concatenate([[0.0], text[:-1]])
        columns = [
            aside, main, aside_words, main_words, *above, flag(TEXT_TAGS), flag(("h1", "h2", "h3")), flag(("li", "ul", "ol")),
            np.log1p(own), np.log1p(text), link / np.maximum(text, 1), marks / np.maximum(text, 1), text / np.maximum(blocks, 1), text / np.maximum(text[0], 1),
            text / size, np.array(self.depth, float), index, family[up], text / np.maximum(text[up], 1), before, np.log1p(prior),
        ]
        return np.stack(columns, 1)


FEATURES = [
    "aside_tag", "main_tag", "aside_words", "main_words", "under_aside_tag", "under_main_tag", "under_aside_words", "under_main_words", "text_tag",
    "heading", "list", "log_own_text", "log_text", "link_density", "marks", "text_a_block", "share_of_page", "text_an_element", "depth", "sibling", "siblings",
    "share_of_parent", "before", "log_text_before",
]


def decode(page: Page, logit: np.ndarray) -> np.ndarray:
    """Which elements are kept. Dropping an element drops all below it; the choice with the largest total evidence wins."""
    n = len(page.tag)
    own = np.zeros(n)
    for node, text in page.blocks:
        own[node] += len(text)
    shared = logit + 0.5 * logit[np.maximum(page.parent, 0)]  # a few words say little by themselves
    evidence = shared * np.where(own > 0, 1 + np.log1p(own), 1.0)
    total, best = evidence.copy(), evidence.copy()
    for k in range(n - 1, 0, -1):
        p = page.parent[k]
        total[p] += total[k]
        best[p] += max(best[k], -total[k])
    kept = np.ones(n, bool)
    for k in range(1, n):
        kept[k] = kept[page.parent[k]] and best[k] >= -total[k]
    return kept


def kept_text(page: Page, kept: np.ndarray) -> str:
    """The kept blocks; where there are none, those that stand in no element with an aside's tag or name."""
    if page.blocks and not any(kept[node] for node, _ in page.blocks):
        kept = np.ones(len(page.tag), bool)
        for k in range(1, len(page.tag)):
            kept[k] = kept[page.parent[k]] and page.tag[k] not in ASIDE_TAGS and not page.words[k] & ASIDE_WORDS
    return "\n".join(text for node, text in page.blocks if kept[node])

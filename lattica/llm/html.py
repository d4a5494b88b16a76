"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded so that ancestors and descendants agree.

A page is parsed into a tree of elements (unclosed and stray tags, comments and raw-text elements as browsers take them).
Each element gets features: its tag and those above it, tokens of its class, id and role attributes and those above it,
depth, size and density of its subtree, links in it, its place, and how it compares with its siblings. The trees say how
likely the element holds article text. Decoding picks the set of elements of largest summed log odds in which an element
is kept only if its parent is kept: one pass from the leaves up (the best of a subtree is its own log odds plus the best
of its children, or nothing) and one down. The text of kept elements is the result.

The trees are learned from generated pages of varied layouts whose parts are marked. Blocks end at block-level tags and
line breaks; character references are decoded, white space inside a block becomes one space, blocks are trimmed and
joined by one space.

Defined cases: null and empty pages, and pages without article text, give an empty text; any depth of nesting and any
length is taken whole; repeated rows give equal texts.
"""

from __future__ import annotations

import re
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField

from lattica.llm import gbdt
from lattica.llm.common import append_columns, as_text

_TAG = re.compile(r"""<(?:!--(?:.*?--|.*\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']|"[^"]*+"|'[^']*+')*+)|[!?/][^>]*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|data-kept)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea noscript template iframe svg title xmp".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I | re.A) for t in _RAW}
_MATH = "math mfrac mi mmultiscripts mn mo mover mpadded mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split()
_INLINE = frozenset([*_MATH, *"a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split()])
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li".split())
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
_SCOPE = frozenset("table td th caption button html body".split())
#: End tags that close their element across those.
_REACHES = frozenset("table tr tbody body html form div article section main".split())

_GROUPS = [
    ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "input", "button", "select", "option", "label", "fieldset", "textarea"),
    ("script", "style", "noscript", "template", "iframe", "svg", "head", "title", "meta", "link"), ("article",), ("main",), ("section",), ("div",), ("p",),
    ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("li", "dt", "dd"), ("ul", "ol", "dl"), ("a",), ("table", "tbody", "tr", "td", "th"), ("blockquote", "pre", "xmp"), ("figure", "figcaption"),
    ("b", "i", "em", "strong", "span", "u", "small", "font", "code", "mark", "sub", "sup", "q", "cite", "abbr", *_MATH),
]
_GROUP = {t: i for i, ts in enumerate(_GROUPS) for t in ts}
_GOOD = frozenset("article content post entry main body story text prose news page paragraph".split())
_BAD = {
    w: i
    for i, ws in enumerate(
        [
            "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc skip links topbar".split(),
            "footer copyright legal colophon imprint bottom".split(),
            "sidebar aside widget related recommended rail popular trending more teaser".split(),
            "ad ads advert advertisement adsense banner promo promotion sponsor sponsored sponsors commercial".split(),
            "cookie cookies consent notice alert warning gdpr popup modal overlay message announcement privacy".split(),
            "comment comments reply replies respond disqus commentlist discussion feedback reader".split(),
            "share social follow subscribe newsletter signup login search form toolbar buttons tags meta byline".split(),
            "header masthead branding logo top head".split(),
        ]
    )
    for w in ws
}
_N_BAD = 8


class Page:
    """A parsed page: arrays over its elements, in document order (parents first), and its pieces of text."""

    def __init__(self, source: str):
        self.tag, self.parent, self.start, self.words, self.mark = ["#root"], [-1], [0], [()], [""]
        self.pieces: list[tuple[int, str]] = []  # (element, decoded text), or (-1, "") where a block ends
        self._build(source)

    def _open(self, tag: str, at: int, attributes: str, stack: list[int]) -> int:
        words: list[str] = []
        mark = ""
        if attributes and "=" in attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                value = m.group(2) or m.group(3) or m.group(4) or ""
                if m.group(1).lower() == "data-kept":
                    mark = value
                else:
                    words += [w.lower() for w in _WORD.findall(value)]
        self.tag.append(tag)
        self.parent.append(stack[-1])
        self.start.append(at)
        self.words.append(tuple(words))
        self.mark.append(mark)
        return len(self.tag) - 1

    def _build(self, source: str) -> None:
        tag, pieces, stack, last, skip_to = self.tag, self.pieces, [0], 0, 0
        unclosed: set[str] = set()  # raw elements without another end tag
        # by tag, where its open elements stand in the stack; and where the open elements stand that aren't inline, and
        # those that end tags of inside elements don't reach beyond
        places: dict[str, list[int]] = {}
        solid: list[int] = [0]
        scopes: list[int] = [0]

        def cut(k: int) -> None:
            """Close the open elements from place k up."""
            for i in range(len(stack) - 1, k - 1, -1):
                places[tag[stack[i]]].pop()
            del stack[k:]
            for kept in (solid, scopes):
                while kept[-1] >= k:
                    kept.pop()

        def last_open(names) -> int:
            """The place of the innermost open element of these tags, or 0."""
            return max((p[-1] for n in names if (p := places.get(n))), default=0)

        pos = 0
        while True:
            m = _TAG.search(source, pos)
            end = m.start() if m else len(source)
            if end > last:
                text = source[last:end]
                pieces.append((stack[-1], unescape(text) if "&" in text else text))
            if not m:
                break
            pos = last = m.end()
            name = m.group(2)
            if not name:
                continue
            name = name.lower()
            if m.group(1):  # end tag
                k = last_open((name,))
                if k and (k >= scopes[-1] or name in _REACHES):
                    cut(k)
                if name not in _INLINE:
                    pieces.append((-1, ""))
                continue
            if name in _ENDS_P:
                if solid[-1] and tag[stack[solid[-1]]] == "p":
                    cut(solid[-1])
            if name in _CLOSES:
                closes, within = _CLOSES[name]
                border = last_open(within)
                while (k := last_open(closes)) > border:
                    cut(k)
                    if name != "tr":
                        break
            if name not in _INLINE:
                pieces.append((-1, ""))
            node = self._open(name, m.start(), m.group(3), stack)
            if name in _RAW:
                if name == "svg" and (m.group(3) or "").endswith("/"):
                    continue
                close = None if name in unclosed else _RAW_END[name].search(source, pos)
                if close is None:
                    unclosed.add(name)
                    if name == "svg":  # unlike the others it doesn't swallow the rest of a page
                        continue
                inside = source[pos : close.start() if close else len(source)]
                if name == "title":
                    pieces.append((node, unescape(inside)))
                elif name == "xmp":
                    pieces += [(node, inside), (-1, "")]
                after = source.find(">", close.end()) if close else -1
                pos = last = len(source) if after < 0 else after + 1
            elif name not in _VOID and not (m.group(3) or "").endswith("/"):
                if name not in _INLINE:
                    solid.append(len(stack))
                if name in _SCOPE:
                    scopes.append(len(stack))
                places.setdefault(name, []).append(len(stack))
                stack.append(node)

    def text(self, kept: np.ndarray) -> str:
        """The text of kept elements."""
        blocks, run = [], []
        for node, piece in self.pieces:
            if node < 0:
                if run:
                    blocks.append(" ".join("".join(run).split()))
                    run = []
            elif kept[node]:
                run.append(piece)
        if run:
            blocks.append(" ".join("".join(run).split()))
        return " ".join(b for b in blocks if b)

    def features(self) -> np.ndarray:
        n = len(self.tag)
        own, links, marks, words = (np.zeros(n) for _ in range(4))
        for node, piece in self.pieces:
            if node >= 0:
                size = len(piece.strip())
                if size:
                    own[node] += size
                    marks[node] += piece.count(",") + piece.count(".")
                    words[node] += piece.count(" ") + 1
        group = [_GROUP.get(t, len(_GROUPS)) for t in self.tag]
        above = np.zeros((n, 8))
        attr = np.zeros((n, 2 + 2 * _N_BAD))
        depth, index, count = np.zeros(n), np.zeros(n), np.zeros(n)
        parent = self.parent
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            index[i] = count[p]
            count[p] += 1
            above[i] = above[p]
            if group[p] < 8:
                above[i, group[p]] = 1
            attr[i, 1] = attr[p, 1]
            attr[i, 2 + _N_BAD :] = attr[p, 2 + _N_BAD :]
            for w in self.words[i]:
                if w in _GOOD:
                    attr[i, 0] = attr[i, 1] = 1
                k = _BAD.get(w)
                if k is not None:
                    attr[i, 2 + k] = attr[i, 2 + _N_BAD + k] = 1
            if group[i] == 15:
                links[i] = 1
        tags, size, link_text, points, total_words = np.ones(n), own.copy(), own * links, marks.copy(), words.copy()
        paragraphs = np.array([t == "p" for t in self.tag], float)
        headings = np.array([t == "h1" for t in self.tag], float)
        in_link = np.zeros(n, bool)
        for i in range(1, n):
            in_link[i] = in_link[parent[i]] or bool(links[i])
        link_text = np.where(in_link, own, 0)
        longest = own.copy()
        for i in range(n - 1, 0, -1):
            p = parent[i]
            tags[p] += tags[i]
            size[p] += size[i]
            link_text[p] += link_text[i]
            points[p] += points[i]
            total_words[p] += total_words[i]
            paragraphs[p] += paragraphs[i]
            headings[p] += headings[i]
            longest[p] = max(longest[p], longest[i])
        up = np.array([max(p, 0) for p in parent])
        siblings = np.maximum(1, count[up])
        total = max(1.0, size[0])
        one = np.zeros((n, len(_GROUPS) + 1))
        one[np.arange(n), group] = 1
        up_group = np.array([group[p] for p in up], float)
        start = np.array(self.start, float)
        rest = [
            depth, np.log1p(own), np.log1p(size), size / total, link_text / np.maximum(1, size), np.log1p(size / tags), np.log1p(points),
            points / np.maximum(1, total_words), np.log1p(total_words), np.log1p(paragraphs), headings, np.log1p(count), np.log1p(siblings), index / siblings,
            size / np.maximum(1, size[up]), np.log1p(size[up] / siblings), start / max(1.0, start.max()), np.log1p(longest), up_group, np.log1p(size[up]), headings[up], np.log1p(paragraphs[up]),
        ]
        return np.concatenate([one, above, attr, np.stack(rest, 1)], 1)

    def labels(self) -> np.ndarray:
        """From marked (generated) pages: whether an element holds article text."""
        n = len(self.tag)
        kept = np.zeros(n, bool)
        for i in range(1, n):
            kept[i] = self.mark[i] == "1" or self.mark[i] != "0" and kept[self.parent[i]]
        has = np.zeros(n, bool)
        for node, piece in self.pieces:
            if node > 0 and piece.strip() and kept[node]:
                has[node] = True
        for i in range(n - 1, 0, -1):
            if has[i]:
                has[self.parent[i]] = True
        return has

    def decode(self, odds: np.ndarray) -> np.ndarray:
        """The kept elements: largest summed log odds in which every kept element's parent is kept."""
        own = np.zeros(len(odds))
        for node, piece in self.pieces:
            if node >= 0:
                own[node] += len(piece)
        best = odds * np.log2(2 + own)
        best[0] = 0.0
        for i in range(len(best) - 1, 0, -1):
            if best[i] > 0:
                best[self.parent[i]] += best[i]
        kept = np.zeros(len(best), bool)
        kept[0] = True
        for i in range(1, len(best)):
            kept[i] = kept[self.parent[i]] and best[i] > 0
        kept[0] = False
        return kept


# ---- generated pages to learn from


def generated_page(r: np.random.Generator) -> str:
    """A page of random layout; data-kept marks what belongs to the article (1) and what in it doesn't (0)."""
    pick = lambda *x: x[r.integers(len(x))]
    chance = lambda p: r.random() < p
    syllables = "the an er on re in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve und ich ein que ado".split()
    word = lambda: "".join(r.choice(syllables, r.integers(1, 4)))

    def words(low: int, high: int) -> str:
        out = [word() for _ in range(r.integers(low, high + 1))]
        style = r.random()
        if style < 0.8:
            out = [w + ("," if chance(0.12) else "." if chance(0.1) else "") for w in out]
        return " ".join(out).capitalize() + ("." if chance(0.8) else "")

    def inline(text: str) -> str:
        if chance(0.3):
            t = text.split(" ")
            i = int(r.integers(len(t)))
            tag = pick("b", "i", "em", "a", "strong", "span", "math")
            if tag == "math":
                t[i] = f"<mi>{t[i]}</mi>" + (f"<mo>=</mo><mn>{word()}</mn>" if chance(0.5) else "")
            t[i] = f'<{tag}{" href=/" + word() if tag == "a" else ""}>{t[i]}' + (f"</{tag}>" if chance(0.85) else "")
            text = " ".join(t)
        return text.replace(". ", ". &amp; ", 1) if chance(0.08) else text

    def named(tag: str, *names: str, p: float = 0.85, mark: str = "") -> str:
        a = f' {pick("class", "id")}="{pick(*names)}{pick("", "", "-" + word(), " " + word())}"' if names and chance(p) else ""
        return f"<{tag}{a}{mark}>"

    def paragraphs(n: int) -> str:
        out = []
        for _ in range(n):
            t = words(*pick((1, 4), (5, 30), (20, 90), (60, 200)))
            out.append(pick(f"<p>{inline(t)}</p>", f"<p>{inline(t)}</p>", f"<p>{inline(t)}", f"<p><b>{t}<br>" if chance(0.4) else f"<p>{t}</p>"))
            if chance(0.08):
                out.append(f"<h2>{words(2, 6)}</h2>")
            if chance(0.05):
                out.append("<ul>" + "".join(f"<li>{words(2, 12)}</li>" for _ in range(r.integers(2, 6))) + "</ul>")
            if chance(0.04):
                out.append(f"<blockquote>{words(10, 40)}</blockquote>")
            if chance(0.03):
                out.append("<table>" + "".join(f"<tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr>" for _ in range(r.integers(2, 5))) + "</table>")
        return "".join(out)

    def menu() -> str:
        items = "".join(f'<li><a href="/{word()}">{word()}</a></li>' if chance(0.8) else f'<a href="/{word()}">{word()} {word()}</a> ' for _ in range(r.integers(3, 12)))
        return pick(f"<nav>{'<ul>' * chance(0.8)}{items}</ul></nav>", named("div", "nav", "menu", "navbar", "topbar") + f"<ul>{items}</ul></div>", f"<ul {pick('class', 'id')}=menu>{items}</ul>")

    def block(*names: str, tag: str = "div", low: int = 3, high: int = 60) -> str:
        body = words(low, high) if chance(0.5) else f"<p>{words(low, high)}</p>" * pick(1, 1, 2)
        return named(tag, *names, p=1.0, mark=' data-kept="0"') + body + f"</{tag}>"

    ad = lambda: block("ad", "ads", "advert", "banner", "sponsor", "promo", tag=pick("div", "div", "aside", "section"))
    notice = lambda: block("cookie", "notice", "consent", "alert", "popup", tag=pick("div", "div", "section", "aside"))
    form = lambda: '<form data-kept="0">' + f"<label>{words(1, 3)}</label><input name=q><button>{word()}</button>" + (f"<p>{words(4, 20)}</p>" if chance(0.3) else "") + "</form>"

    def comments() -> str:
        tag = pick("section", "div", "ol", "aside")
        inner = pick("comment", "reply", "comment-body")
        each = "li" if tag == "ol" else pick("div", "article", "div")
        body = "".join(f'<{each} class="{inner}">{"<b>" + word() + "</b>" if chance(0.5) else ""}<p>{words(3, 70)}</p></{each}>' for _ in range(r.integers(1, 6)))
        return named(tag, "comments", "commentlist", "discussion", "responses comments", p=1.0, mark=' data-kept="0"') + (f"<h3>{words(1, 2)}</h3>" if chance(0.6) else "") + body + f"</{tag}>"

    def aside() -> str:
        tag = pick("aside", "div", "aside", "section")
        body = "".join(pick(f"<li><a href=/{word()}>{words(2, 8)}</a></li>", f"<p>{words(3, 40)}</p>") for _ in range(r.integers(1, 7)))
        return (named(tag, "sidebar", "widget", "related", "rail", p=1.0 if tag != "aside" else 0.6) if True else "") + body + f"</{tag}>"

    title = words(3, 9)
    n = pick(1, 2, 3, 5, 8, 15)
    inner = (f"<h1>{title}</h1>" if chance(0.85) else "")
    parts = [paragraphs(max(1, n // 3)) for _ in range(3)] if n >= 3 else [paragraphs(n)]
    for p in parts:
        inner += p + (ad() if chance(0.1) else "") + (notice() if chance(0.04) else "") + (form() if chance(0.03) else "")
    if chance(0.1):
        inner += block("share", "social", "tags", high=8)
    if chance(0.12):
        inner += comments()
    kind = r.random()
    if kind < 0.5:
        article = named("article", "post", "entry", "story", p=0.3, mark=' data-kept="1"') + inner + "</article>"
    elif kind < 0.75:
        article = named(pick("div", "section"), "content", "article", "post", "entry", "story", "main-content", "article-body", p=0.9, mark=' data-kept="1"') + inner + "</div>"
    elif kind < 0.9:
        article = '<main data-kept="1">' + inner + "</main>"
    else:
        article = '<div data-kept="1">' + inner + "</div>"
    before = [menu() for _ in range(chance(0.85))] + [notice() for _ in range(chance(0.2))] + [ad() for _ in range(r.integers(0, 3))] + [form() for _ in range(chance(0.15))]
    after = [ad() for _ in range(chance(0.2))] + [aside() for _ in range(chance(0.35))] + [comments() for _ in range(chance(0.35))] + [form() for _ in range(chance(0.1))] + [notice() for _ in range(chance(0.08))]
    r.shuffle(before)
    r.shuffle(after)
    if chance(0.3):
        before.insert(0, pick("<header>", '<div class="header">') + f"<a href=/>{words(1, 3)}</a>" + (f"<p>{words(2, 10)}</p>" if chance(0.5) else "") + (menu() if chance(0.4) else "") + "</div></header>")
    if chance(0.2):
        after.insert(0, aside())
    body = "".join(before) + article + "".join(after)
    if chance(0.3):
        body = named("div", "wrapper", "container", "page", "site") + body + "</div>"
    if chance(0.9):
        body += pick("<footer>", '<div class="footer">') + f"&copy; {word()}.example.com &middot; {words(3, 30)}" + pick("</footer>", "</div>", "")
    head = f'<head><meta charset="utf-8"><title>{title}</title>' + ('<style>p{margin:0}</style><script>var t="</p>";</script>' if chance(0.7) else "") + "</head>"
    return f'<!DOCTYPE html><html lang="en">{head}<body>{body}' + ("</body></html>" if chance(0.85) else "")


@cache
def trained_forest(pages: int = 500, seed: int = 17) -> gbdt.Forest:
    """The trees, learned from generated pages; the same ones each time."""
    r = np.random.default_rng(seed)
    made = [Page(generated_page(r)) for _ in range(pages)]
    x = np.concatenate([p.features()[1:] for p in made])
    y = np.concatenate([p.labels()[1:] for p in made]).astype(float)
    return gbdt.fit(x, y, rounds=60, depth=5, bins=24, rate=0.2, least=2.0)


def extract_many(sources: list[str], forest: gbdt.Forest) -> list[str]:
    """The main texts of some pages; their elements go through the trees together."""
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    odds = forest.raw(np.concatenate([p.features() for p in pages]))
    out, k = [], 0
    for p in pages:
        out.append(p.text(p.decode(odds[k : k + len(p.tag)])))
        k += len(p.tag)
    return out


FIELDS = [StructField("text", StringType()), StructField("n_chars", LongType())]
GROUP_CHARS = 1_000_000


def extract(pages: DataFrame, html_col: str = "html", forest: gbdt.Forest | None = None) -> DataFrame:
    """pages with text (the article's) and n_chars (its code points)."""
    from lattica.llm.bpe import groups

    shared = pages.sparkSession.sparkContext.broadcast(forest or trained_forest())
    at = pages.columns.index(html_col)

    def make():
        trees = shared.value

        def work(batch):
            texts = [t for run in groups(as_text(batch.column(at)), GROUP_CHARS) for t in extract_many(run, trees)]
            return [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]

        return work

    return append_columns(pages, FIELDS, make)

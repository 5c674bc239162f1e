"""The main text of web pages, by boosted trees over the nodes of their element trees.

A page becomes a tree of block elements and text runs.  Trees trained on made pages of many
layouts (``training_pages``) give each node the odds of being article.  Decoding is
hierarchical: an element is article throughout, or boilerplate throughout, or mixed, in which
case its children decide; the best labelling of the whole page is found from the leaves up,
so a descendant never contradicts an ancestor.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.store import table
from tessella.llm.trees import Trees
from tessella.plans.ship import ship

#: Made pages that the trees are fitted on, and the seed that they are made with.
PAGES = 600
SEED = 11
#: Log odds that a mixed element must gain.
MIXED = 1.0

# Elements by what they do to the tree; fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements whose content is no text of the page; the first three end where one of BREAKS begins.
HIDDEN = frozenset("svg select datalist template noscript".split())
BROKEN = frozenset("svg select datalist".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table caption thead tbody tfoot tr td th ul button".split()
)
BREAKS = BLOCK | frozenset("b big br code em embed font i img s small span strong strike sub sup tt u var".split())
CLOSES_P = BLOCK - frozenset("html body td th tr thead tbody tfoot caption button".split())
#: An open element of the key ends where one of the values begins, unless a barrier stands between.
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th", "tr"), "th": ("td", "th", "tr"), "thead": ("tbody", "tfoot"), "tbody": ("tbody", "tfoot")}
BARRIER = frozenset("html body table td th ul ol dl button article section div main aside nav footer header form".split())

TAGS = ("article main", "nav menu", "header hgroup", "footer", "aside", "form fieldset button search", "section", "div", "p", "h1", "h2 h3 h4 h5 h6", "li", "ul ol dl", "table thead tbody tr td th caption", "blockquote pre figure figcaption", "html body")
_TAG = {t: i for i, names in enumerate(TAGS) for t in names.split()}
#: Groups of words in class, id and role attributes.
TOKENS = (
    "article content main post entry story body text prose single page",
    "nav navbar navigation menu breadcrumb breadcrumbs toc tabs skip",
    "ad ads adv advert advertisement adsense banner sponsor sponsored promo promoted promotion outbrain taboola",
    "comment comments reply replies disqus discussion respond responses feedback",
    "share sharing social follow like twitter facebook",
    "cookie cookies consent notice notices alert gdpr privacy popup modal overlay toast warning disclaimer",
    "footer foot copyright bottom legal colophon contentinfo",
    "header head masthead top logo brand branding",
    "sidebar side aside widget widgets rail secondary complementary",
    "related recommended recommendations more popular trending readmore suggestions",
    "form login signin signup register subscribe subscription newsletter search contact",
    "meta tags tag category categories author byline date pagination pager paging",
)
_TOKEN = {w: i for i, words in enumerate(TOKENS) for w in words.split()}

#: Open elements, at most; deeper ones do not nest, and their text belongs to the innermost of these.
DEEPEST = 512

_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)>""")
_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_MARK = "data-article"


class Page:
    """Columns of a page's nodes in document order; a text run is a leaf, with ``text``."""

    def __init__(self, source: str) -> None:
        self.parent: list[int] = []
        self.tag: list[int] = []
        self.depth: list[int] = []
        self.tokens: list[int] = []  # a bit for each group of TOKENS
        self.text: list[str | None] = []
        self.link: list[int] = []  # characters inside links
        self.inputs: list[int] = []
        self.article: list[bool] = []  # marked so, in made pages
        self._parse(source)

    def _node(self, parent: int, tag: int, tokens: int, text: str | None, link: int, article: bool) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tokens.append(tokens)
        self.text.append(text)
        self.link.append(link)
        self.inputs.append(0)
        self.article.append(article)
        return len(self.parent) - 1

    def _parse(self, source: str) -> None:
        """Read the page in one pass, in time linear in its length.

        A tag that never ends is no text, nor is what follows it; where a quoted value never
        ends, tags end at the next ``>`` from there on.  An unclosed ``script``, ``style`` or
        comment goes on to the end of the page; of any other element that is not parsed, or
        that would hide all that follows, the start tag alone goes.
        """
        root = self._node(-1, _TAG["html"], 0, None, 0, False)
        stack: list[tuple[str, int]] = [("html", root)]  # (name, node of the nearest block)
        opened, deeper, last_end = Counter({"html": 1}), Counter(), {}
        hiding: list[str] = []  # the open elements of HIDDEN
        run: list[str] = []
        links = linked = 0

        def flush() -> None:
            nonlocal run, linked
            if run:
                text = " ".join(html.unescape("".join(run)).split())
                if text:
                    at = stack[-1][1]
                    self._node(at, self.tag[at], 0, text, min(linked, len(text)), self.article[at])
                run, linked = [], 0

        def push(name: str, node: int) -> None:
            stack.append((name, node))
            opened[name] += 1

        def pop(to: int) -> None:
            nonlocal links
            for name, _ in stack[to:]:
                links -= name == "a"
                opened[name] -= 1
                if name in HIDDEN:
                    hiding.pop()
                elif name in BLOCK:
                    flush()
            del stack[to:]

        def pop_to(names: tuple[str, ...], barriers: frozenset[str]) -> None:
            """End the innermost open element of these, if no barrier stands before it."""
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in names:
                    pop(i)
                    return
                if stack[i][0] in barriers:
                    return

        def ends(name: str) -> bool:
            """Whether an end tag of that name follows."""
            if name not in last_end:
                last_end[name] = max((m.start() for m in re.finditer(rf"</{name}[\s/>]", source, re.I)), default=-1)
            return last_end[name] >= at

        def end_of(name: str) -> int:
            """Where the content after the next end tag of that name begins; -1 without one."""
            if not ends(name):
                return -1
            pattern = re.compile(rf"</{name}[\s/>]", re.I)
            gt = source.find(">", pattern.search(source, at).end() - 1)
            return gt + 1 if gt >= 0 else len(source)

        at, loose = 0, False
        while at < len(source):
            lt = source.find("<", at)
            piece = source[at:lt] if lt >= 0 else source[at:]
            if piece and not hiding:
                run.append(piece)
                if links:
                    linked += len(piece.strip())
            if lt < 0:
                break
            m = _NAME.match(source, lt)
            if not m:
                comment = _COMMENT.match(source, lt)
                if comment:
                    at = comment.end()
                elif source[lt + 1 : lt + 2] in ("!", "?", "/"):
                    at = source.find(">", lt) + 1 or len(source)
                else:
                    at = lt + 1
                    if not hiding:
                        run.append("<")
                continue
            tail = None if loose else _REST.match(source, m.end())
            if tail:
                rest, at = tail[1], tail.end()
            else:
                loose = True
                gt = source.find(">", m.end())
                if gt < 0:
                    break
                rest, at = source[m.end() : gt], gt + 1
            closing, name = m[1], m[2].lower()
            if closing and name != "br":
                if hiding and not (name in HIDDEN or (name in BLOCK and hiding[-1] in BROKEN)):
                    continue
                if deeper[name]:
                    deeper[name] -= 1
                elif opened[name]:
                    if name in BLOCK:
                        flush()
                    # An inline end tag does not end blocks.
                    pop_to((name,), frozenset() if name in BLOCK or name in HIDDEN else BLOCK)
                if name in BLOCK:
                    flush()
                continue
            if name in RAW and not (name == "title" and "svg" in hiding[-1:]):
                if not rest.endswith("/"):
                    end = end_of(name)
                    at = end if end >= 0 else len(source) if name in ("script", "style") else at
                if name == "textarea":
                    self.inputs[stack[-1][1]] += 1
                continue
            if hiding:
                while hiding and hiding[-1] in BROKEN and name in BREAKS:
                    pop_to((hiding[-1],), frozenset())
                if hiding and name not in HIDDEN:
                    continue
            if name in HIDDEN:
                if name == "select":
                    self.inputs[stack[-1][1]] += 1
                if rest.endswith("/") or (name not in BROKEN and not ends(name)):
                    continue
                if hiding and len(stack) >= DEEPEST:
                    deeper[name] += 1
                else:
                    push(name, stack[-1][1])
                    hiding.append(name)
                continue
            if name == "br":
                run.append(" ")
                continue
            if name == "input":
                self.inputs[stack[-1][1]] += 1
            if name in CLOSES_P:
                flush()
                pop_to(("p",), BLOCK)
            if name in IMPLIED:
                flush()
                pop_to(tuple(k for k, ends in IMPLIED.items() if name in ends), BARRIER)
            if name in VOID or name == "html":
                continue
            if len(stack) >= DEEPEST:
                if name in BLOCK:
                    flush()
                deeper[name] += not rest.endswith("/") or name in BLOCK
            elif name in BLOCK:
                flush()
                bits = 0
                if rest:
                    for a in _ATTRIBUTE.findall(rest):
                        for w in _WORD.findall(a[0] or a[1] or a[2]):
                            k = _TOKEN.get(w.lower())
                            if k is not None:
                                bits |= 1 << k
                push(name, self._node(stack[-1][1], _TAG.get(name, _TAG["div"]), bits, None, 0, _MARK in rest or self.article[stack[-1][1]] and "data-other" not in rest))
            elif not rest.endswith("/"):
                links += name == "a"
                push(name, stack[-1][1])
        pop(1)
        flush()


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    """Rows of each depth, in order."""
    return np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all nodes, parents over all pages, depths): subtree density, attribute words, depth and siblings."""
    base = np.cumsum([0, *[len(p.parent) for p in pages]])
    page = np.repeat(np.arange(len(pages)), np.diff(base))
    gather = lambda f: np.array([v for p in pages for v in f(p)])
    parent = gather(lambda p: p.parent)
    parent = np.where(parent >= 0, parent + base[:-1][page], -1)
    depth, tag, bits, link, inputs = (gather(f) for f in (lambda p: p.depth, lambda p: p.tag, lambda p: p.tokens, lambda p: p.link, lambda p: p.inputs))
    texts = [t for p in pages for t in p.text]
    leaf = np.array([t is not None for t in texts])
    chars = np.array([len(t) if t else 0 for t in texts])
    words = np.array([t.count(" ") + 1 if t else 0 for t in texts])
    stops = np.array([t.count(". ") + t.count(", ") + (t[-1:] in ".!?") if t else 0 for t in texts])
    signs = np.array([any(c in t for c in "©|»›·") if t else False for t in texts])
    sums = np.stack([chars, words, stops, link, leaf, np.ones(len(leaf), int), inputs, tag == _TAG["p"], tag == _TAG["li"]], 1).astype(np.float64)
    up, inherited = bits.copy(), np.zeros(len(bits), np.int64)
    above = np.zeros(len(bits), np.int64)  # tags of ancestors, a bit for each
    levels = _levels(depth)
    for rows in levels[1:]:
        inherited[rows] = inherited[parent[rows]] | bits[parent[rows]]
        above[rows] = above[parent[rows]] | (1 << tag[parent[rows]])
    subtree = sums.copy()
    for rows in levels[:0:-1]:
        np.add.at(subtree, parent[rows], subtree[rows])
        np.bitwise_or.at(up, parent[rows], up[rows])
    own = np.where(parent >= 0, parent, np.arange(len(parent)))
    order = np.argsort(own, kind="stable")
    first = np.r_[True, own[order][1:] != own[order][:-1]] if len(order) else np.zeros(0, bool)
    group = np.cumsum(first) - 1
    index = np.empty(len(own), int)
    index[order] = np.arange(len(own)) - np.flatnonzero(first)[group] if len(own) else 0
    siblings = np.bincount(own, minlength=len(own))[own]
    begun = np.cumsum(chars) - chars
    total = subtree[base[:-1], 0][page]
    c, w, s, k, leaves, nodes, boxes, ps, lis = subtree.T
    above_c = c[own]
    columns = [leaf, np.log1p(c), np.log1p(w), s / (w + 1), k / (c + 1), c / nodes, w / np.maximum(leaves, 1), np.log1p(nodes), np.log1p(boxes), np.log1p(ps), np.log1p(lis)]
    columns += [depth, index, siblings, index / siblings, c / (above_c + 1), c / (total + 1), (begun - begun[base[:-1]][page]) / (total + 1), s[own] / (w[own] + 1), k[own] / (above_c + 1), ps[own], w[own] / np.maximum(leaves[own], 1), signs]
    columns += [tag == i for i in range(len(TAGS))]
    columns += [(above >> i) & 1 for i in (0, 1, 2, 3, 4, 5, 11)]
    columns += [(bits >> i) & 1 for i in range(len(TOKENS))] + [(inherited >> i) & 1 for i in range(len(TOKENS))]
    return np.stack(columns, 1).astype(np.float32), parent, depth


def decode(margin: np.ndarray, parent: np.ndarray, depth: np.ndarray, leaf: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which nodes are article, in the best labelling without contradictions."""
    weight = np.where(leaf, 1 + np.log1p(words), 1.0)
    inside, outside = -weight * np.logaddexp(0, -margin), -weight * np.logaddexp(0, margin)
    mixed = np.where(leaf, -np.inf, -MIXED)
    levels = _levels(depth)
    for rows in levels[:0:-1]:
        np.add.at(inside, parent[rows], inside[rows])
        np.add.at(outside, parent[rows], outside[rows])
        np.add.at(mixed, parent[rows], np.maximum(np.maximum(inside[rows], outside[rows]), mixed[rows]))
    choice = np.where((mixed > inside) & (mixed > outside), 2, (inside > outside).astype(int))
    for rows in levels[1:]:
        above = choice[parent[rows]]
        choice[rows] = np.where(above == 2, choice[rows], above)
    return choice == 1


_SYLLABLES = "ka lo mi ne ru ta shi vo pre con ter al ing er ed tion le so da ve ro na ti po ul em ist or an de".split()


def training_pages(n: int, seed: int) -> list[str]:
    """Made pages; an element with ``data-article`` holds article text, but for what is marked ``data-other`` inside it."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    chance = lambda p: rng.random() < p

    def word() -> str:
        return "".join(_SYLLABLES[i] for i in rng.integers(0, len(_SYLLABLES), rng.integers(1, 4)))

    def sentence(low: int = 3, high: int = 18) -> str:
        some = [word() for _ in range(rng.integers(low, high))]
        return " ".join(w + ("," if chance(0.08) else "") for w in some[:-1]).capitalize() + " " + some[-1] + pick(".", ".", ".", "!", "?")

    def prose(most: int = 9) -> str:
        text = " ".join(sentence() for _ in range(rng.integers(1, most)))
        if chance(0.25):
            text = re.sub(r" (\w+) ", r' <a href="/x">\1</a> ', text, count=1)
        if chance(0.2):
            text = re.sub(r" (\w+) (\w+)", r" <b>\1</b> <em>\2</em>", text, count=1)
        return text

    def attribute(*names: str) -> str:
        return "" if chance(0.1) else f' {pick("class", "class", "id")}="{pick(*names)}{pick("", "", "-1", " box", " clearfix")}"'

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{word()}">{pick(word(), word() + " " + word(), sentence(3, 8))}</a></li>' for _ in range(n))

    def menu() -> str:
        body = pick("<ul>{}</ul>", "{}").format(links(int(rng.integers(2, 9))))
        return pick("<nav{a}>{b}</nav>", "<div{a}>{b}</div>", "<ul{a}>{b}</ul>").format(a=attribute("nav", "menu", "navbar", "main-navigation", "breadcrumb", "tabs"), b=body)

    def advert() -> str:
        body = pick(sentence(2, 6), prose(4), f"<p>{prose(3)}</p>", f'<a href="/buy">{sentence(2, 7)}</a>', f"<h3>{sentence(2, 5)}</h3><p>{prose(3)}</p>")
        return pick("<div{a}>{b}</div>", "<aside{a}>{b}</aside>", "<section{a}>{b}</section>", "<div{a}><div>{b}</div></div>").format(a=f' class="{pick("ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "banner", "promoted-content", "ad box")}"', b=body)

    def comments() -> str:
        each = pick('<div class="comment"><b>{}</b><p>{}</p></div>', "<li class=comment><cite>{}</cite> <p>{}</p></li>", "<div><span class=author>{}</span><p>{}</p></div>", "<p>{}: {}</p>")
        body = "".join(each.format(word(), prose(5)) for _ in range(rng.integers(1, 9)))
        return pick("<section{a}>{b}</section>", "<div{a}>{b}</div>", "<ol{a}>{b}</ol>", "<aside{a}>{b}</aside>").format(a=f' {pick("class", "id")}="{pick("comments", "comment-list", "discussion", "responses", "disqus_thread", "reader-comments", "replies")}"', b=pick("", f"<h2>{sentence(1, 3)}</h2>", "<h3>Comments</h3>") + body)

    def form() -> str:
        return pick("<form{a}>{b}</form>", "<div{a}><form>{b}</form></div>").format(a=attribute("login", "newsletter", "subscribe", "search", "signup-form", "contact"), b=pick("", f"<p>{prose(3)}</p>", f"<label>{word()}</label>") + '<input name=q><button>Go</button>' + pick("", f"<small>{sentence()}</small>"))

    def notice() -> str:
        return pick("<div{a}>{b}</div>", "<section{a}>{b}</section>", "<dialog{a}>{b}</dialog>").format(a=f' class="{pick("cookie-banner", "consent", "notice", "alert", "gdpr", "cookie-notice", "popup", "site-notice", "modal")}"', b=pick("{}", "<p>{}</p>").format(prose(4)) + pick("", "<button>OK</button>"))

    def sidebar() -> str:
        parts = "".join(pick(lambda: f"<h3>{sentence(1, 4)}</h3><ul>{links(4)}</ul>", lambda: f"<p>{prose(4)}</p>", advert, lambda: f"<div class=widget><h4>{word()}</h4><p>{prose(3)}</p></div>")() for _ in range(rng.integers(1, 5)))
        return pick("<aside{a}>{b}</aside>", "<div{a}>{b}</div>").format(a=f' {pick("class", "id")}="{pick("sidebar", "side", "widgets", "right-rail", "secondary", "aside")}"', b=parts)

    def related() -> str:
        return f'<div class="{pick("related", "recommended", "more-stories", "popular", "trending")}"><h3>{sentence(1, 4)}</h3>' + pick(f"<ul>{links(5)}</ul>", "".join(f"<div><a href=/x>{sentence(3, 9)}</a><p>{prose(3)}</p></div>" for _ in range(3))) + "</div>"

    def share() -> str:
        return f'<div class="{pick("share", "social", "sharing-buttons", "follow-us")}">' + "".join(f"<a href=#>{word()}</a> " for _ in range(rng.integers(2, 6))) + "</div>"

    def footer() -> str:
        body = pick(f"&copy; {word()}.example &middot; {sentence()}", f"<p>Copyright 2020 {word()}. {prose(3)}</p>", f"<ul>{links(5)}</ul><p>{sentence()}</p>", f"<p>{prose(4)}</p>")
        return pick("<footer{a}>{b}</footer>", "<footer>{b}</footer>", '<div{a}>{b}</div>').format(a=f' class="{pick("footer", "site-footer", "foot", "copyright", "bottom")}"', b=body)

    def header() -> str:
        body = pick(f'<a href="/">{word()}</a>', f"<h1>{word()}</h1><p>{sentence(2, 6)}</p>", f'<div class=logo>{word()}</div>') + pick("", menu(), form())
        return pick("<header{a}>{b}</header>", "<header>{b}</header>", "<div{a}>{b}</div>").format(a=f' class="{pick("header", "masthead", "top", "site-header")}"', b=body)

    def other(makers, p: float) -> str:
        some = pick(*makers)() if chance(p) else ""
        return re.sub(r"^<(\w+)", r"<\1 data-other", some)

    def part() -> str:
        k = rng.random()
        if k < 0.45:
            return f"<p>{prose()}</p>"
        if k < 0.6:
            return f"<p>{prose()}" + pick("", "<br>", "<br><br>")
        if k < 0.68:
            return f"<p><b>{prose()}<br>"
        if k < 0.76:
            return f"<h{pick(2, 3)}>{sentence(2, 7)}</h2>"
        if k < 0.83:
            return pick("<ul>{}</ul>", "<ol>{}</ol>").format("".join(f"<li>{prose(3)}</li>" for _ in range(rng.integers(1, 6))))
        if k < 0.88:
            return f"<blockquote>{pick('<p>{}</p>', '{}').format(prose(4))}</blockquote>"
        if k < 0.91:
            return "<table>" + "".join(f"<tr><td>{word()}</td><td>{sentence(2, 6)}</td></tr>" for _ in range(rng.integers(1, 5))) + "</table>"
        if k < 0.94:
            return f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>"
        if k < 0.97:
            return f"<div>{prose()}</div>"
        return f"<pre>{prose(3)}</pre>"

    def article() -> str:
        inside = (advert, share, related, comments, form, notice, menu)
        parts = [f"<h1>{sentence(2, 9)}</h1>"] if chance(0.8) else []
        if chance(0.12):
            parts = [f"<header><h1>{sentence(2, 9)}</h1></header>"]
        for _ in range(int(rng.integers(0, pick(3, 8, 20)))):
            parts.append(part())
            parts.append(other(inside, 0.06))
        if len(parts) < 2:
            parts.append(f"<p>{prose(3)}</p>")
        parts.append(other((share, related, comments, form, advert), 0.3))
        name = pick("article", "article", "main", "div", "section", "td")
        words = "" if name in ("article", "main") and chance(0.6) else f' {pick("class", "id", "class")}="{pick("content", "article", "post", "entry-content", "main", "story-body", "post-body", "text", "page-content", "prose")}"'
        body = "".join(parts)
        if chance(0.25):
            body = f"<div{attribute('inner', 'body', 'content', 'row')}>{body}</div>"
        out = f"<{name}{words} {_MARK}>{body}</{name}>"
        if name == "td":
            out = f"<table><tr><td>{links(3)}</td>{out}</tr></table>"
        return f"<main>{out}</main>" if name == "article" and chance(0.25) else out

    out = []
    for _ in range(n):
        before = "".join(m() for m, p in ((notice, 0.2), (header, 0.6), (menu, 0.6), (advert, 0.45), (sidebar, 0.2)) if chance(p))
        after = "".join(m() for m, p in ((share, 0.2), (related, 0.25), (comments, 0.3), (sidebar, 0.3), (form, 0.2), (advert, 0.25), (notice, 0.15), (footer, 0.8)) if chance(p))
        body = before + article() + after
        if chance(0.3):
            body = f'<div{attribute("wrapper", "container", "page", "site")}>{body}</div>'
        out.append(f"<!DOCTYPE html><html><head><title>{sentence()}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>")
    return out


def fit(pages: int = PAGES, seed: int = SEED) -> Trees:
    """Trees that tell article nodes from others, fitted on made pages."""
    made = [Page(x) for x in training_pages(pages, seed)]
    x, parent, _ = features(made)
    y = np.array([a for p in made for a in p.article], float)
    leaf = x[:, 0] > 0
    # An element that holds both is neither; only pure elements and text runs teach.
    pure_in, pure_out = y.copy(), 1 - y
    for rows in range(len(y) - 1, 0, -1):
        if parent[rows] >= 0:
            pure_in[parent[rows]] = min(pure_in[parent[rows]], pure_in[rows])
            pure_out[parent[rows]] = min(pure_out[parent[rows]], pure_out[rows])
    pure = (pure_in + pure_out) > 0
    weight = np.where(leaf, 1 + x[:, 2] / 3, 1.0)
    return Trees(x[pure], y[pure], weight[pure])


def main_texts(model: Trees, sources: list[str]) -> list[str]:
    """The article text of each page: its text runs in order, joined by one space."""
    pages = [Page(s) for s in sources]
    x, parent, depth = features(pages)
    margin = model.margin(x)
    leaf = x[:, 0] > 0
    chosen = decode(margin, parent, depth, leaf, np.expm1(x[:, 2]))
    out, at = [], 0
    for p in pages:
        out.append(" ".join(t for t, c in zip(p.text, chosen[at : at + len(p.text)], strict=True) if t is not None and c))
        at += len(p.text)
    return out


def extract(pages: DataFrame, html_col: str = "html", model: Trees | None = None) -> DataFrame:
    """``pages`` with ``text``, each page's main text, in place of its html.

    White space inside a text run becomes one space; runs are joined by one space.  A null,
    empty or article-less page has an empty text.  Each row has its own result, so rows may
    repeat; an empty table gives none.  A column of ``pages`` that is called ``text``, in
    whatever case, is replaced.
    """
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or fit())
    columns = [c for c in pages.columns if c.lower() not in (html_col.lower(), "text")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, texts, low, size = batch.column(len(columns)).fill_null("").to_pylist(), [], 0, 0
            for i, s in enumerate(sources):
                size += len(s)
                if size > 1 << 20 or i == len(sources) - 1:
                    texts += main_texts(shared.value, sources[low : i + 1])
                    low, size = i + 1, 0
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(columns))), pa.array(texts, pa.string())], [*columns, "text"])

    kinds = dict(pages.dtypes)
    return pages.select(*columns, html_col).mapInArrow(read, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "text string"]))


def query(spark, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.selectExpr("page_id", "url", "text", "cast(length(text) as bigint) as n_chars")

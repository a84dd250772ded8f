"""Main text of web pages, by boosted trees over DOM nodes and hierarchical decoding.

Every block-level element is a node, and so are runs of text that stand in the body itself and inline elements whose tokens
tell of an advert or a notice. Nodes have features: kind of tag, tokens of its class, id and role, the same of what it lies
in, depth, text and link density of its subtree, sibling statistics. Boosted trees give each node log-odds of being part
of the article. The decoding chooses for every node one of three states: around the article, in it, or cut out; going down
a state may only stay or move on in this order, so that nothing is kept inside what was cut out. The best choice for the
whole page is found bottom-up. A page with prose of which nothing would be kept is read from its best subtree instead.

The trees are fitted to pages that are generated here with their right answer (`training_pages`), a bounded set whose
layouts vary in tags, class names, order and noise; no page of the input teaches anything.

Elements whose content may be part of a sentence or stands for a picture (math, svg, object, canvas, audio, video) are
read through like any inline element; only raw text that is no text of the page is passed over (scripts, styles, templates,
the title, text fields), and so are the controls of forms; what stands in noscript is text like any other. Elements nested deeper than `DEPTH` belong to the one at that depth. Reading a page takes time in
proportion to its length, whatever its markup.

Empty cases: null or blank html gives an empty text; markup that never closes is closed where it must end, and a `<` that
begins no tag is text; pages may be of any length; rows that repeat a page_id, or have none, are read each by itself;
columns other than page_id, url and html are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, boost

TRAINING_PAGES, ROUNDS, SEED, DEPTH = 1100, 80, 11, 512
#: Log-odds that it takes to cut a node without telling names out of an article.
CUT = 1.5
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>", re.S)
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
TAG_START = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
STOP = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Fixed values of the HTML standard: elements that flow inside a line, that have no content, whose content is raw text.
INLINE = frozenset("a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i ins kbd label map mark math meter object output picture progress q rp rt ruby s samp slot small span strike strong sub sup svg time tt u var video wbr".split())
#: Fixed values of the MathML and SVG standards: elements within those.
INLINE |= frozenset("annotation maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics circle clippath defs desc ellipse g line lineargradient mask path pattern polygon polyline radialgradient rect stop symbol text textpath tspan use".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea title".split())
#: Parts of forms that hold no text of their page wherever they stand; elements that a page without a found article isn't read from.
CONTROLS, NEVER = frozenset("select option optgroup datalist button".split()), frozenset("nav footer aside header form menu".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
KINDS = (("p", "pre", "blockquote"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl", "menu"), ("li", "dt", "dd"), ("table", "tbody", "thead", "tr", "td", "th"), ("article",), ("main",), ("section",), ("div", "center"), ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset", "button", "select"), ("figure", "figcaption"), ("body", "html"), ("#text",), ("#inline",), ("noscript",))
#: Parts of class, id and role tokens, by what they usually mark.
TOKENS = (
    ("ad", "ads", "advert", "advertisement", "adbox", "sponsor", "sponsored", "promo", "promoted", "banner", "adslot"),
    ("nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs", "skip"),
    ("header", "masthead", "topbar", "branding", "logo"),
    ("footer", "foot", "copyright", "legal", "contentinfo", "bottom"),
    ("sidebar", "aside", "widget", "rail", "related", "recommended", "popular", "trending", "more", "complementary"),
    ("comment", "comments", "commentlist", "discussion", "respond", "reply", "replies", "disqus", "responses"),
    ("cookie", "cookies", "consent", "notice", "gdpr", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "paywall", "message", "dialog"),
    ("share", "sharing", "social", "follow", "tags", "meta", "byline", "author"),
    ("content", "article", "post", "entry", "story", "main", "text", "body", "page", "articlebody", "hentry", "blog"),
    ("search", "login", "signup", "form", "contact"),
)
#: Groups whose tokens make an inline element a node: adverts, notices.
TELLING = 1 << 0 | 1 << 6
#: Groups that mark what isn't an article, and those that mark content.
PUSHED, CONTENT = 0b1011111111, 1 << 8
TOKEN_KIND = {t: k for k, group in enumerate(TOKENS) for t in group}
FEATURES = 2 * len(KINDS) + 2 * len(TOKENS) + 20
END = re.compile(r"[.!?](?:\s|$)")


class Tags:
    """Tags and comments by where they start. A quote that never closes is met once only, so that hostile markup costs no more than its length."""

    def __init__(self, source: str) -> None:
        self.source, self.last, self.plain, self.dead = source, source.rfind(">"), True, set()

    def at(self, start: int) -> tuple[str, str, str, int] | None:
        """("/" of an end tag, name or nothing for a comment, attributes, where it ends); None if no tag starts there."""
        if self.source.startswith(("<!", "<?"), start):
            if start > self.last and not self.source.startswith("<!--", start):
                return None
            return "", "", "", COMMENT.match(self.source, start).end()
        m = TAG_START.match(self.source, start)
        if m is None or start > self.last:
            return None
        if self.plain:
            whole = TAG.match(self.source, start)
            if whole is not None:
                return whole[1], whole[2].lower(), whole[3], whole.end()
            self.plain = False  # from here on step by step
        end = self._end(m.end())
        return m[1], m[2].lower(), self.source[m.end() : end - 1], end

    def _end(self, at: int) -> int:
        """After the first > outside quotes; if those don't close, after the first > at all."""
        x, passed = at, []
        while True:
            m = STOP.search(self.source, x)
            if m is not None and m[0] == ">":
                return m.end()
            other = -1 if m is None or m.start() in self.dead else self.source.find(m[0], m.end())
            if m is not None:
                passed.append(m.start())
            if other < 0:
                self.dead.update(passed)
                return self.source.find(">", at) + 1
            x = other + 1


class Page:
    """Nodes of a page: tag, tokens, parent; and its blocks of text in order, each as pieces of (node, text).

    Text that stands in the root or the body itself is a node of its own for each block, and so is an inline element whose
    tokens tell of an advert or a notice.
    """

    def __init__(self, source: str) -> None:
        self.tag, self.kinds, self.parent, self.hidden = ["html"], [0], [-1], [False]
        self.block_node: list[int] = []
        self.block: list[list[tuple[int, str]]] = []
        self.block_link: list[int] = []
        self._parts: list[tuple[int, str]] = []
        self._links = 0
        self._inline: list[tuple[str, int, int]] = []  # open inline nodes: tag, depth of the stack, node
        self._parse(source)

    def _node(self, tag: str, kinds: int, parent: int, hidden: bool = False) -> int:
        self.tag.append(tag)
        self.kinds.append(kinds)
        self.parent.append(parent)
        self.hidden.append(hidden)
        return len(self.tag) - 1

    def _flush(self, node: int) -> None:
        if self._parts:
            size = sum(len(" ".join(x.split())) for _, x in self._parts)
            if size:
                own = self._node("#text", 0, node) if self.tag[node] in ("html", "body") else node
                self.block_node.append(own)
                self.block.append([(own if at == node else at, x) for at, x in self._parts])
                self.block_link.append(min(self._links, size))
            self._parts, self._links = [], 0

    @staticmethod
    def _about(attributes: str) -> tuple[int, bool]:
        """Groups of the tokens, and whether the element is hidden."""
        kinds, hidden = 0, False
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                hidden = True
            elif key in ("class", "id", "role"):
                for t in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
                    if t in TOKEN_KIND:
                        kinds |= 1 << TOKEN_KIND[t]
        return kinds, hidden

    def _open(self, name: str, attributes: str, stack: list[int]) -> None:
        kinds, hidden = self._about(attributes) if attributes else (0, False)
        stack.append(self._node(name, kinds, self._inline[-1][2] if self._inline else stack[-1], hidden))

    def _open_inline(self, name: str, attributes: str, stack: list[int]) -> None:
        kinds, hidden = self._about(attributes)
        if kinds & TELLING and len(self._inline) < DEPTH:
            self._inline.append((name, len(stack), self._node("#inline", kinds, self._inline[-1][2] if self._inline else stack[-1], hidden)))

    def _close_inline(self, name: str | None, depth: int) -> None:
        """The inline nodes down to one of the name; without a name those that were opened below the depth."""
        if name is None:
            while self._inline and self._inline[-1][1] > depth:
                self._inline.pop()
        elif any(n == name and d == depth for n, d, _ in self._inline):
            while self._inline.pop()[0] != name:
                pass

    def _parse(self, source: str) -> None:
        stack, at, link, end = [0], 0, 0, len(source)
        nested, endless = Counter(), set()  # open elements by tag; raw elements without an end tag
        tags = Tags(source)

        def text(piece: str) -> None:
            if piece:
                piece = html.unescape(piece)
                self._parts.append((self._inline[-1][2] if self._inline else stack[-1], piece))
                if link:
                    self._links += len(piece)

        def close(names: set[str], stop: frozenset[str] | set[str]) -> None:
            if not any(nested[x] for x in names):
                return
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] in names:
                    self._flush(stack[-1])
                    nested.subtract(self.tag[n] for n in stack[k:])
                    del stack[k:]
                    return
                if self.tag[stack[k]] in stop:
                    return

        while at < end:
            start = source.find("<", at)
            if start < 0:
                text(source[at:])
                break
            found = tags.at(start)
            if found is None:
                text(source[at : start + 1])
                at = start + 1
                continue
            text(source[at:start])
            closing, name, attributes, at = found
            if not name:
                continue
            if name in RAW:
                if not closing and not attributes.endswith("/") and name not in endless:
                    shut = re.compile(rf"</{re.escape(name)}\b[^>]*+>", re.I).search(source, at)
                    if shut is not None:
                        at = shut.end()
                    elif name in ("script", "style"):
                        at = end
                    else:
                        endless.add(name)
                continue
            if name in INLINE:
                if closing:
                    self._close_inline(name, len(stack))
                elif attributes:
                    self._open_inline(name, attributes, stack)
                link = link + 1 if name == "a" and not closing else max(0, link - 1) if name == "a" else link
                continue
            if name in VOID or name == "br":
                self._flush(stack[-1])
                continue
            if closing:
                self._flush(stack[-1])
                close({name}, {"td", "th"} if name not in ("table", "tr", "tbody", "thead", "td", "th", "body", "html") else set())
                self._close_inline(None, len(stack))
                link = 0
                continue
            self._flush(stack[-1])
            link = 0
            if name in ("html", "head"):
                continue
            if name in CLOSES_P:
                close({"p"}, CLOSES_P - {"p"} | {"li", "td", "th", "body"})
            if name in ENDS_SAME:
                close(ENDS_SAME[name], {"ul", "ol", "dl", "table", "select"} - ENDS_SAME[name])
            self._close_inline(None, len(stack))
            if len(stack) < DEPTH:
                self._open(name, attributes, stack)
                nested[name] += 1
        self._flush(stack[-1])

    def features(self) -> np.ndarray:
        n = len(self.tag)
        own = np.zeros((n, 6))  # characters, links' characters, blocks, sentence ends, long blocks, commas
        for node, pieces, link in zip(self.block_node, self.block, self.block_link, strict=True):
            texts: dict[int, list[str]] = {node: []}
            for at, x in pieces:
                texts.setdefault(at, []).append(x)
            for at, x in texts.items():
                text = " ".join("".join(x).split())
                own[at] += (len(text), link * (at == node), at == node, len(END.findall(text)), len(text) > 80, text.count(","))
        parent = np.array(self.parent)
        total, count = own.copy(), np.ones(n)
        paragraphs = np.array([t == "p" for t in self.tag], dtype=float)
        below = paragraphs.copy()
        for i in range(n - 1, 0, -1):
            total[parent[i]] += total[i]
            count[parent[i]] += count[i]
            below[parent[i]] += below[i]
        kind = np.array([KIND_OF.get(t, len(KINDS)) for t in self.tag])
        tag = np.zeros((n, len(KINDS) + 1))
        tag[np.arange(n), kind] = 1
        token = (np.array(self.kinds)[:, None] >> np.arange(len(TOKENS)) & 1).astype(float)
        up_tag, up_token, depth = np.zeros_like(tag), np.zeros_like(token), np.zeros(n)
        index, siblings, alike = np.zeros(n), np.zeros(n), np.zeros(n)
        seen: dict[object, int] = {}
        for i in range(1, n):
            p = parent[i]
            up_tag[i] = np.maximum(up_tag[p], tag[p])
            up_token[i] = np.maximum(up_token[p], token[p])
            depth[i] = depth[p] + 1
            index[i] = siblings[p]
            siblings[p] += 1
            seen[p, self.tag[i]] = seen.get((p, self.tag[i]), 0) + 1
        for i in range(1, n):
            alike[i] = seen[parent[i], self.tag[i]]
        chars = total[:, 0]
        first_block = np.full(n, len(self.block), dtype=float)
        for k in range(len(self.block) - 1, -1, -1):
            first_block[self.block_node[k]] = k
        for i in range(n - 1, 0, -1):
            first_block[parent[i]] = min(first_block[parent[i]], first_block[i])
        above = np.maximum(parent, 0)
        extra = np.stack(
            [
                depth,
                np.log1p(chars),
                total[:, 1] / (chars + 1),
                chars / (count + 1),
                chars / (chars[0] + 1),
                chars / (chars[above] + 1),
                total[:, 2],
                chars / (total[:, 2] + 1),
                total[:, 3] / (total[:, 2] + 1),
                total[:, 4] / (total[:, 2] + 1),
                total[:, 5] / (chars + 1) * 100,
                below,
                np.log1p(own[:, 0]),
                index,
                siblings[above],
                (siblings[above] - index) / (siblings[above] + 1),
                alike,
                first_block / (len(self.block) + 1),
                np.log1p(chars[above] - chars),
                np.array(self.hidden, dtype=float),
            ],
            axis=1,
        )
        return np.hstack([tag[:, : len(KINDS)], up_tag[:, : len(KINDS)], token, up_token, extra])

    def decode(self, odds: np.ndarray, cut: float = 0.0) -> list[bool]:
        """Which nodes are in the article: states 0 around, 1 in, 2 cut out, that never go back on the way down.

        The best sum of odds, where a node without telling names is cut out of an article only for a gain of over `cut`.
        """
        n = len(self.tag)
        odds = np.where([t in CONTROLS for t in self.tag], -1e6, odds)
        own = np.stack([np.zeros(n), odds, np.zeros(n)], axis=1)
        best = own.copy()
        choice = np.zeros((n, 3), np.int64)
        for i in range(n - 1, 0, -1):
            options = best[i]
            c2 = 2
            c1 = 1 if options[1] >= options[2] - cut * (not self.kinds[i] and self.tag[i] not in NEVER) else 2
            c0 = max((0, 1, 2), key=lambda s: (options[s], s == 0)) if options[0] < max(options[1], options[2]) else 0
            choice[i] = (c0, c1, c2)
            best[self.parent[i]] += (options[c0], options[c1], options[c2])
        state = np.zeros(n, np.int64)
        for i in range(1, n):
            state[i] = choice[i, state[self.parent[i]]]
        return (state == 1).tolist()

    def kept(self, odds: np.ndarray) -> list[bool]:
        """decode's choice; if no text comes of it, the page is read from the node that is most like an article."""
        keep = self.decode(odds, CUT)
        if any(keep[at] and x.strip() for pieces in self.block for at, x in pieces) or (found := self.likeliest(odds)) is None:
            return keep
        top, out = found
        keep = [False] * len(self.tag)
        keep[top] = True
        for i in range(top + 1, len(self.tag)):
            keep[i] = keep[self.parent[i]] and not out[i]
        return keep

    def likeliest(self, odds: np.ndarray) -> tuple[int, np.ndarray] | None:
        """The node most like an article, and what is left out of it: one with prose (a sentence's end, few links), or all of a page without elements; None if there is none."""
        n, bare = len(self.tag), set(self.tag) <= {"html", "#text"}
        chars, links, ends, out = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, bool)
        for node, pieces, link in zip(self.block_node, self.block, self.block_link, strict=True):
            text = " ".join("".join(x for _, x in pieces).split())
            chars[node], links[node], ends[node] = chars[node] + len(text), links[node] + link, ends[node] + len(END.findall(text)) + (len(text) > 200 or bare)
        for i in range(1, n):
            out[i] = out[self.parent[i]] or (self.tag[i] in NEVER and self.tag[i] != "form") or self.tag[i] in CONTROLS or bool(self.kinds[i] & PUSHED and not self.kinds[i] & CONTENT)
        for i in range(n - 1, 0, -1):
            if not out[i]:
                for x in (chars, links, ends):
                    x[self.parent[i]] += x[i]
        fit = ~out & (ends > 0) & (links < 0.5 * (chars + 1))
        fit[0] = bare
        value = np.where(fit, np.log1p(chars) * 4 + np.clip(odds, -8, 8), -np.inf)
        return (int(value.argmax()), out) if fit.any() else None


KIND_OF = {t: k for k, group in enumerate(KINDS) for t in group}


def training_pages(n: int = TRAINING_PAGES, seed: int = SEED) -> Iterator[str]:
    """Generated pages; elements of the article carry data-keep="1", what lies in it but isn't part of it data-keep="0"."""
    rng = random.Random(seed)
    syllables = ["".join(rng.choice(x) for x in ("bcdfghlmnprstvw", "aeiouéäö", "nrstl ")).strip() for _ in range(60)]

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.randrange(a, b)))

    def prose(a: int, b: int) -> str:
        noise = rng.choice(("", "", "", " &amp;", "###", "%%%"))
        return " ".join(words(1, 16).capitalize() + noise + rng.choice((".", ".", ",", "!")) for _ in range(rng.randrange(a, b)))

    def named(*names: str) -> str:
        return rng.choice(("", f' class="{rng.choice(names)}"', f' class="{rng.choice(names)}"', f' id="{rng.choice(names)}"', f' class="x-{rng.choice(names)} {word()}"'))

    def links(tag: str, k: int) -> str:
        return "".join(f'<{tag}><a href="/{word()}">{words(1, 5)}</a></{tag}>' for _ in range(k))

    def menu() -> str:
        inner = rng.choice((f"<ul>{links('li', rng.randrange(3, 12))}</ul>", links("span", 6)))
        return rng.choice((f"<nav>{inner}</nav>", f"<div{named('menu', 'nav', 'navbar', 'breadcrumbs')}>{inner}</div>", f"<nav{named('menu')}>{inner}</nav>"))

    def advert() -> str:
        return rng.choice((f"<div{named('ad', 'advert', 'sponsored', 'promo banner')}>{prose(1, 3)}</div>", f"<aside{named('ad')}>{prose(1, 3)}</aside>", f'<div class="ad">{words(2, 12)}</div>'))

    def notice() -> str:
        return f"<div{rng.choice((' class="cookie-notice"', ' id="cookie-consent"', ' class="notice"', ' role="dialog"', ' class="newsletter popup"', ' role="alert"'))}><p>{prose(1, 3)}</p><button>{words(1, 3)}</button></div>"

    def sidebar() -> str:
        inner = rng.choice((f"<h3>{words(1, 4)}</h3><ul>{links('li', rng.randrange(3, 8))}</ul>", f"<h2>{words(1, 3)}</h2><p>{prose(1, 4)}</p>", f"<p>{prose(1, 3)}</p>{links('div', 4)}"))
        return rng.choice((f"<aside>{inner}</aside>", f"<div{named('sidebar', 'widget', 'related', 'rail')}>{inner}</div>", f'<div class="sidebar">{inner}</div>'))

    def form() -> str:
        return f"<form{named('search', 'login', 'contact')}><label>{words(1, 4)}</label><input name=q><p>{words(1, 8)}</p><button>{word()}</button></form>"

    def comments() -> str:
        one = lambda: rng.choice((f'<div class="comment"><b>{word()}</b><p>{prose(1, 4)}</p></div>', f"<li><p>{prose(1, 4)}</p></li>", f'<article class="comment"><p>{prose(1, 4)}</p></article>', f"<p>{prose(1, 3)}</p>"))
        inner = "".join(one() for _ in range(rng.randrange(1, 6)))
        return rng.choice((f'<section class="comments"><h2>{words(1, 3)}</h2>{inner}</section>', f'<div id="comments">{inner}</div>', f'<ol class="commentlist">{inner}</ol>', f'<div class="discussion">{inner}</div>', f'<section id="comments">{inner}</section>'))

    def head() -> str:
        inner = f"<h1>{words(1, 5)}</h1>" * rng.randrange(2) + f"<p>{words(2, 9)}</p>" + rng.choice(("", menu()))
        return rng.choice((f"<header>{inner}</header>", f"<div{named('header', 'masthead', 'topbar')}>{inner}</div>", ""))

    def foot() -> str:
        inner = f"&copy; {word()}.example &middot; {prose(1, 3)}"
        return rng.choice((f"<footer>{inner}</footer>", f"<footer><p>{inner}</p>{links('span', 3)}</footer>", f"<div{rng.choice((' class="footer"', ' id="footer"', ' class="copyright"'))}>{inner}</div>"))

    def out(piece: str) -> str:
        """A piece in the article that isn't part of it."""
        return re.sub(r"^<(\w+)", r'<\1 data-keep="0"', piece)

    def body() -> list[str]:
        title = words(1, 10).capitalize()
        pieces = [f"<h1>{title}</h1>"] if rng.random() < 0.8 else []
        if rng.random() < 0.2:  # very short articles, some that only repeat their title
            return [f"<h1>{title}</h1>", f"<p>{title if rng.random() < 0.5 else words(1, 8)}.</p>"]
        for _ in range(rng.choice((1, 2, 4, 8, 16, 30))):
            r = rng.random()
            if r < 0.7:
                pieces.append(f"<p>{prose(1, 8)}</p>" if rng.random() < 0.8 else f"<p>{words(1, 3)}.</p>")
            elif r < 0.76:
                pieces.append(f"<p><b>{prose(1, 4)}<br><p>{prose(1, 4)}</p>")
            elif r < 0.82:
                pieces.append(f"<h2>{words(1, 6)}</h2>")
            elif r < 0.87:
                pieces.append(f"<ul>{''.join(f'<li>{words(1, 14)}</li>' for _ in range(rng.randrange(2, 6)))}</ul>")
            elif r < 0.9:
                pieces.append(f"<blockquote><p>{prose(1, 3)}</p></blockquote>")
            elif r < 0.93:
                pieces.append("<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 5)}</td></tr>" for _ in range(3)) + "</table>")
            elif r < 0.95:
                pieces.append(f"<pre>{words(3, 20)}</pre>")
            elif r < 0.97:
                pieces.append(f'<p>{prose(1, 3)} <a href="/x">{words(1, 4)}</a> {prose(1, 2)}</p>')
            elif r < 0.985:  # an advert or a choice in a sentence; words of a class that are the sentence's own
                inside = rng.choice((f'<span class="{rng.choice(("ad", "sponsored", "promo text", "advert"))}" data-keep="0">{words(2, 9)}</span>', f'<span class="{rng.choice(("message", "notice-board", "alert-level"))}" data-keep="1">{words(1, 3)}</span>', f'<select data-keep="0"><option>{word()}<option>{word()}</select>'))
                pieces.append(f"<p>{prose(1, 3)} {inside} {prose(1, 3)}</p>")
            else:
                pieces.append(f"<noscript><p>{prose(1, 3)}</p></noscript>")
        if not any("<p" in x for x in pieces):
            pieces.append(f"<p>{prose(1, 5)}</p>")
        for make, share in ((advert, 0.2), (notice, 0.07), (sidebar, 0.1), (form, 0.07), (menu, 0.1)):
            if rng.random() < share:
                pieces.insert(rng.randrange(len(pieces) + 1), out(make()))
        if rng.random() < 0.1:
            pieces.insert(0, out(f"<header>{words(1, 6)}</header>") if rng.random() < 0.5 else out(f'<div class="share social">{links("span", 4)}</div>'))
        if rng.random() < 0.2:
            pieces.append(out(comments()))
        if rng.random() < 0.1:
            pieces.append(out(f"<footer>{words(2, 9)}</footer>"))
        return pieces

    def bare() -> str:
        """An article without paragraphs of its own, or with one: lines between breaks, preformatted or running text."""
        lines = [prose(1, 5) for _ in range(rng.choice((1, 2, 4, 9, 20)))]
        return rng.choice((rng.choice(("<br>", "<br><br>", "<br/>\n<br/>")).join(lines), f"<pre>{chr(10).join(lines)}</pre>", f"<p>{lines[0]}</p>", f"<h1>{words(1, 7)}</h1>{'<br>'.join(lines)}", f"<p>{lines[0]}</p>{'<br>'.join(lines[1:])}", "".join(f"<div>{x}</div>" for x in lines)))

    def stray() -> str:
        """Names of a container that say little of what it holds."""
        own = ("comment-free", "main", "header", "post-header", "no-sidebar", "with-ads", "has-menu", "nav-open", "footer-dark", "story", "content", "share-on", "wrap", "page", "meta-left", "more")
        return f' class="{" ".join(rng.sample(own, rng.randrange(1, 4)))}"'

    names = (("article", ""), ("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="content"'), ("div", ' class="entry-content"'), ("div", ' class="article-body"'), ("section", ' class="story"'), ("div", ' class="post"'))
    for _ in range(n):
        kind = rng.random()
        if kind < 0.03:  # text without any markup
            yield "\n\n".join(prose(1, 6) for _ in range(rng.choice((1, 2, 5))))
            continue
        inner = bare() if rng.random() < 0.2 else "".join(body())
        before = [f() for f, share in ((head, 0.5), (menu, 0.7), (notice, 0.25), (advert, 0.4), (sidebar, 0.2), (form, 0.15)) if rng.random() < share]
        after = [f() for f, share in ((advert, 0.2), (comments, 0.35), (sidebar, 0.3), (form, 0.15), (menu, 0.15), (notice, 0.1), (foot, 0.8)) if rng.random() < share]
        rng.shuffle(before)
        if rng.random() < 0.1:
            before.append(f"<noscript>{prose(1, 2)}</noscript>")
        if rng.random() < 0.08:  # nothing but the article
            before, after = [], []
        if kind < 0.06:  # no article at all
            yield f'<html><body data-keep="0">{"".join([*before, *after]) or menu()}</body></html>'
            continue
        if kind < 0.2:  # the article stands in the body itself
            yield f'<html><head><title>{words(1, 8)}</title></head><body data-keep="1">{"".join([*map(out, before), inner, *map(out, after)])}</body></html>'
            continue
        tag, name = rng.choice(names) if kind < 0.8 else ("div", "") if kind < 0.86 else ("div", stray()) if kind < 0.97 else ("td", "")
        article = f'<{tag}{name} data-keep="1">{inner}</{tag}>'
        if tag == "td":
            article = f"<table><tr><td>{menu()}</td>{article}</tr></table>"
        elif tag != "main" and rng.random() < 0.3:
            article = f"<main{rng.choice(('', ' id=main'))}>{article}{rng.choice(('', '', comments(), sidebar()))}</main>"
        middle = "".join([*before, article, *after])
        if rng.random() < 0.3:
            middle = f"<div{rng.choice(('', ' id=page', ' class=wrapper', ' class=container'))}>{middle}</div>"
        yield f"<!DOCTYPE html><html><head><title>{words(1, 8)}</title></head><body>{middle}</body></html>"


KEEP = re.compile(r'\bdata-keep="([01])"')


class Marked(Page):
    """A training page that remembers which nodes are part of the article; all are, if nothing is marked."""

    def __init__(self, source: str) -> None:
        self.keep = ["data-keep" not in source]
        self._mark = None
        super().__init__(source)

    def _node(self, tag: str, kinds: int, parent: int, hidden: bool = False) -> int:
        self.keep.append(self._mark[1] == "1" if self._mark else self.keep[parent])
        self._mark = None
        return super()._node(tag, kinds, parent, hidden)

    def _open(self, name: str, attributes: str, stack: list[int]) -> None:
        self._mark = KEEP.search(attributes)
        super()._open(name, attributes, stack)

    def _open_inline(self, name: str, attributes: str, stack: list[int]) -> None:
        self._mark = KEEP.search(attributes)
        super()._open_inline(name, attributes, stack)
        self._mark = None


@functools.lru_cache(maxsize=4)
def learn(pages: int = TRAINING_PAGES, seed: int = SEED) -> Boosted:
    """Fitted once in a session for each number of pages and seed."""
    found = [Marked(x) for x in training_pages(pages, seed)]
    return boost(np.vstack([p.features() for p in found]), np.concatenate([np.array(p.keep, dtype=float) for p in found]), rounds=ROUNDS)


def main_texts(sources: list[str | None], model: Boosted) -> list[str]:
    pages = [Page(s or "") for s in sources]
    if not pages:
        return []
    sizes = np.cumsum([len(p.tag) for p in pages])
    odds = np.split(model.raw(np.vstack([p.features() for p in pages])), sizes[:-1])
    out = []
    for p, o in zip(pages, odds, strict=True):
        keep = p.kept(o)
        texts = (" ".join("".join(x for at, x in pieces if keep[at]).split()) for pieces in p.block)
        out.append(" ".join(t for t in texts if t))
    return out


def extract(pages: DataFrame, model: Boosted) -> DataFrame:
    """page_id, url, text of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                some = batch.slice(a, 200)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(main_texts(some.column(2).to_pylist(), sent.value), pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(each, "page_id long, url string, text string")

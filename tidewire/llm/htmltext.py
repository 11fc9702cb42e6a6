"""Main-text extraction from HTML by a tree-structured graphical model.

A page becomes its tree of elements, with the runs of text as leaves.  Every
node is content or not; a node's potential is log-linear in what is seen of it
(tag, names, text length, links), and potentials between parent and child tie
a node to its surroundings.  Sum-product messages go up and down the tree once,
which gives each node's exact marginal; the runs that are more likely content
than not are the text.

The weights are trained on labelled pages by gradient ascent on the exact
likelihood, the expected counts being such marginals.  The labelled pages are
made here, from layouts that are common on the web (see ``labelled_pages``).
"""

from __future__ import annotations

import html
import math
import random
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import plainly_named, text_batches

# HTML's elements by their part in the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript iframe object svg textarea select option head title audio video canvas map".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr caption ul button label".split())
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption button label".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PLAIN = frozenset("html body div section center".split())
LISTS = frozenset("ul ol menu dl table".split())
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())

#: Words of class, id and role values, and what they say of an element whose name ends in one.
SIGN_WORDS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination paginator toc tab tabs tablist skip skiplink",
    "edge": "header footer masthead topbar bottombar copyright colophon banner contentinfo",
    "side": "sidebar aside rail widget widgets related recommend recommended recommendation recommendations popular trending teaser teasers complementary",
    "advert": "ad ads advert adverts advertisement advertisements advertising advertorial sponsor sponsors sponsored promo promos promotion banner banners affiliate affiliates partnership outbrain taboola doubleclick adsense",
    "notice": "cookie cookies consent gdpr notice notices alert alerts popup modal overlay paywall toast disclaimer warning dialog alertdialog",
    "talk": "comment comments commenting response responses discuss discussion discussions reply replies disqus review reviews feedback forum respond",
    "form": "form forms subscribe subscription newsletter signup login signin search contact cta",
    "share": "share shares sharing social follow like likes print byline author authors meta tag tags date dateline",
    "main": "article content main post entry story body text prose",
}
SIGNS: dict[str, set[str]] = {}
for _sign, _words in SIGN_WORDS.items():
    for _word in _words.split():
        SIGNS.setdefault(_word, set()).add(_sign)
#: Words that only say that an element holds something: what stands before them tells what.
SHELLS = frozenset("area bar block box body card cell column container content group holder inner item items layer layout left line link links list main module outer pane panel posts region right row section slot stack strip table unit up view wrap wrapper zone".split())
#: Words that say how something is, or that it isn't there: a name with one tells nothing of what the element holds.
STATES = frozenset("no not non without has is with hide hidden show shown visible open opened close closed fixed sticky static active inactive enabled disabled off on ready loaded loading yet free less".split())
NAME_WORD = regex.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+|[^\W_A-Za-z0-9]+")
#: Blocks of this many characters outside links are prose; how many an element holds is told up to the second number.
PROSE_CHARS, PROSE_MOST = 100, 3
ROLE_TAGS = {"nav": "menu", "menu": "menu", "header": "edge", "footer": "edge", "aside": "side", "form": "form", "fieldset": "form", "button": "form", "label": "form", "dialog": "notice", "search": "form", "article": "main", "main": "main"}
#: Markup from its "<" on; every repetition is possessive, so a page cut off anywhere is read once.
COMMENT = regex.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", regex.DOTALL)
OTHER = regex.compile(r"<(?:[!?]|/(?![a-zA-Z]))[^>]*+>?+")
TAG = regex.compile(r"""<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))*+)>""")
ATTRIBUTE = regex.compile(r"""([^\s=/>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?+""")
RAW_END = {tag: regex.compile(rf"</{tag}(?=[\s/>])", regex.IGNORECASE) for tag in RAW}
NAME = regex.compile("/?[a-zA-Z]")
NAMING = ("class", "id", "role", "aria-label")
NO_DISPLAY = regex.compile(r"(?:^|;)\s*+display\s*+:\s*+none\b", regex.IGNORECASE)
ZEROS = regex.compile(r"&#0++(?=[0-9])")
#: Numbers with more digits than any character has.
NO_CHARACTER = regex.compile(r"&#[0-9]{8,}+;?+")


def attributes(attrs: str) -> dict[str, str]:
    """Values by lower-case name; of a repeated name the first counts."""
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(attrs):
        out.setdefault(name.lower(), next(filter(None, values), ""))
    return out


def not_shown(own: dict[str, str]) -> bool:
    """Whether an element's attributes hide it: hidden itself, aria-hidden="true" or a style without display."""
    return "hidden" in own or own.get("aria-hidden", "").strip().lower() == "true" or bool(NO_DISPLAY.search(html.unescape(own.get("style", ""))))


@lru_cache(100_000)
def name_signs(name: str) -> frozenset[str]:
    """What one class, id or role name says: that of its last word but for shells and numbers ("site-footer", "adBox-2").

    Words are what white space, punctuation and changes of case divide, and
    count as a whole.  What qualifies something else ("header-image") or tells
    a state ("no-sidebar", "modal-open") says nothing.
    """
    words = [w.lower() for w in NAME_WORD.findall(name)]
    if not STATES.isdisjoint(words):
        return frozenset()
    words = [w for w in words if not w.isdigit()]
    own = list(words)
    while own and own[-1] in SHELLS:
        own.pop()
    # What holds nothing but content is named by a shell alone; "sign-up" is one word, and a heading of an article is of the article.
    last = own[-1] if own else next((w for w in words if w in SIGNS), "")
    signs = SIGNS.get("signup" if words[-2:] == ["sign", "up"] else last, set())
    if signs and any(w in ("article", "post", "entry", "story") for w in words[:-1]):
        signs = signs | {"main"}
    return frozenset(signs)


def comment_title(text: str) -> bool:
    """Whether a fold-out's title is about comments: "Comments", "12 comments", "Reader comments (3)"."""
    words = [w.lower() for w in NAME_WORD.findall(text[:80])]
    return len(text) < 80 and len(words) < 5 and any("talk" in SIGNS.get(w, ()) for w in words)


def decoded(text: str) -> str:
    """``text`` with its character references decoded."""
    if "&" not in text:
        return text
    return html.unescape(NO_CHARACTER.sub("�", ZEROS.sub("&#", text)) if "&#" in text else text)


class Tree:
    """Nodes in page order: parent, tag, features; runs of text hang as leaves, with their text."""

    def __init__(self, page: str):
        self.parent: list[int] = [-1]
        self.features: list[list[str]] = [["bias"]]
        self.texts: list[str | None] = [None]
        #: Open elements: name, node, whether it hides what is in it; and the places of each name and kind in that stack.
        self._stack: list[tuple[str, int, bool]] = [("", 0, False)]
        self._places: dict[str, list[int]] = {}
        self._blocks: list[int] = []
        self._lists: list[int] = []
        self._run: list[str] = []
        self._linked = self._hidden = 0
        self._link = False
        #: Leaves, and whether they are prose.
        self._prose: list[tuple[int, bool]] = []
        self._read(page)
        self._flush()
        self._weigh()

    def _weigh(self) -> None:
        """Tell how much prose an element holds, for those with and without a sign: a name says less of an element full of it."""
        held = [0] * len(self.parent)
        for i, prose in self._prose:
            held[i] = int(prose)
        for i in range(len(held) - 1, 0, -1):
            held[self.parent[i]] += held[i]
        #: The nearest element with a sign around each node, or the node itself.
        named = [0] * len(held)
        for i, (features, text, n) in enumerate(zip(self.features, self.texts, held, strict=True)):
            if i:
                named[i] = named[self.parent[i]]
            if text is not None:
                features += [f"in:{f}" for f in self.features[named[i]] if f.startswith("sign:")]
                continue
            signs = [f for f in features if f.startswith("sign:")]
            if signs:
                named[i] = i
            if n:
                features += [f"{f}&prose:{min(n, PROSE_MOST)}" for f in signs or ["plain"]]

    def _flush(self) -> None:
        text = " ".join(decoded("".join(self._run)).split())
        if text:
            own, n = self._stack[-1], len(text)
            linked = min(1.0, self._linked / n)
            self.parent.append(own[1])
            self.texts.append(text)
            if own[0] == "summary" and comment_title(text):
                self.features[self.parent[own[1]]].append("sign:talk")
            self._prose.append((len(self.parent) - 1, n >= PROSE_CHARS and linked <= 0.2))
            self.features.append(["bias", "leaf", f"leaf:{'l' if linked > 0.6 else 'm' if linked > 0.2 else 't'}", f"size:{min(5, int(math.log(n, 3)))}", "in:" + (own[0] if own[0] in BLOCK else "")])
        self._run, self._linked = [], 0

    def _text(self, text: str) -> None:
        if self._hidden or not text:
            return
        self._run.append(text)
        if self._link:
            self._linked += len(text)

    def _last(self, tag: str) -> int:
        """Place of the innermost open ``tag`` in the stack, 0 if there is none."""
        places = self._places.get(tag)
        return places[-1] if places else 0

    def _open(self, tag: str, attrs: str) -> None:
        if tag in BLOCK:
            self._flush()
        own = attributes(attrs) if attrs and not attrs.isspace() else {}
        hidden = tag in HIDDEN or (tag not in ("html", "body") and bool(own) and not_shown(own))
        self._hidden += hidden
        node, place = self._stack[-1][1], len(self._stack)
        if tag in BLOCK and not self._hidden:
            signs: set[str] = set()
            if tag not in ("html", "body"):
                signs.update(*(name_signs(name) for x in NAMING if own.get(x) for name in ([own[x]] if x == "aria-label" else own[x].split())))
            if tag in ROLE_TAGS:
                signs.add(ROLE_TAGS[tag])
            self.parent.append(node)
            self.texts.append(None)
            # An element that only divides tells nothing, however many there are around an article.
            own_tag = [] if tag in PLAIN and not signs else ["bias", "element", f"tag:{tag}"]
            self.features.append([*own_tag, *(f"sign:{s}" for s in sorted(signs)), *(f"p:{s}" for s in sorted(signs) if tag == "p")])
            node = len(self.parent) - 1
        self._stack.append((tag, node, hidden))
        self._places.setdefault(tag, []).append(place)
        if tag in BLOCK:
            self._blocks.append(place)
        if tag in LISTS:
            self._lists.append(place)
        if tag == "a":
            self._link = True

    def _close(self, upto: int) -> None:
        while len(self._stack) > upto:
            tag, _, hidden = self._stack[-1]
            if tag in BLOCK:
                self._flush()
                self._blocks.pop()
            elif tag == "a":
                self._link = False
            if tag in LISTS:
                self._lists.pop()
            self._hidden -= hidden
            self._places[tag].pop()
            self._stack.pop()

    def _end(self, tag: str) -> None:
        place = self._last(tag)
        # An inline end tag doesn't close blocks, nor an item's end tag the list around it.
        if not place or (tag not in BLOCK and self._blocks and self._blocks[-1] > place) or (tag in CLOSED_BY and self._lists and self._lists[-1] > place):
            return
        self._close(place)

    def _start(self, tag: str, attrs: str) -> None:
        if tag not in IN_HEAD and (place := self._last("head")):
            self._close(place)
        if tag in CLOSES_P and (place := self._last("p")) and place > max(map(self._last, ("td", "th", "button", "table"))):
            self._close(place)
        if tag in CLOSED_BY:
            around = self._lists[-1] if self._lists else 0
            inside = [x for x in map(self._last, CLOSED_BY[tag]) if x > around]
            if inside:
                self._close(min(inside))
        if tag in VOID:
            if tag in ("br", "hr", "wbr", "img"):
                self._text("" if tag == "wbr" else " ")
                if tag == "hr":
                    self._flush()
            return
        if attrs.endswith("/") and tag not in BLOCK:
            return
        self._open(tag, attrs)

    def _read(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            next_ = page.find("<", at)
            if next_ < 0:
                self._text(page[at:])
                return
            if next_ > at:
                self._text(page[at:next_])
            after = page[next_ + 1 : next_ + 4]
            if after[:1] in ("!", "?") or (after[:1] == "/" and len(after) > 1 and not (after[1].isascii() and after[1].isalpha())):
                at = (COMMENT if after == "!--" else OTHER).match(page, next_).end()
                continue
            if not NAME.match(after):
                self._text("<")
                at = next_ + 1
                continue
            m = TAG.match(page, next_)
            if m is None:
                # The page ends within this tag, which is none then.
                return
            at = m.end()
            tag = m["name"].lower()
            if m["end"]:
                if tag == "br":
                    self._text(" ")
                else:
                    self._end(tag)
                continue
            self._start(tag, m["attrs"])
            if tag in RAW:
                close = RAW_END[tag].search(page, at)
                # What is in it is hidden; its end tag is read next.
                at = close.start() if close else n


class Model:
    """Weights of node features (for content) and of parent-child agreement, and inference with them."""

    def __init__(self):
        self.node: dict[str, float] = {}
        #: Log potential of (parent is content, child is content), for a child that is an element or a leaf.
        self.edge = {(k, a, b): 0.0 for k in ("element", "leaf") for a in (0, 1) for b in (0, 1)}

    def marginals(self, tree: Tree) -> tuple[list[float], list[tuple[float, ...]]]:
        """Each node's probability of content, and each node's joint with its parent (00, 01, 10, 11)."""
        n, parent = len(tree.parent), tree.parent
        weights = self.node
        own = [sum([weights.get(f, 0.0) for f in fs]) for fs in tree.features]
        kind = ["leaf" if t is not None else "element" for t in tree.texts]
        psi = {k: tuple(math.exp(self.edge[k, a, b]) for a in (0, 1) for b in (0, 1)) for k in ("element", "leaf")}
        # Log odds of content from below, and the ratio of the message to the parent.
        below, up = own[:], [0.0] * n
        for i in range(n - 1, 0, -1):
            e = math.exp(max(-50.0, min(50.0, below[i])))
            p00, p01, p10, p11 = psi[kind[i]]
            up[i] = math.log((p10 + p11 * e) / (p00 + p01 * e))
            below[parent[i]] += up[i]
        odds, joint = below[:], [(0.0,) * 4] * n
        for i in range(1, n):
            rest = math.exp(max(-50.0, min(50.0, odds[parent[i]] - up[i])))
            e = math.exp(max(-50.0, min(50.0, below[i])))
            p00, p01, p10, p11 = psi[kind[i]]
            odds[i] = below[i] + math.log((p01 + p11 * rest) / (p00 + p10 * rest))
            q = (p00, p01 * e, p10 * rest, p11 * rest * e)
            total = sum(q)
            joint[i] = tuple(x / total for x in q)
        return [1 / (1 + math.exp(-max(-50.0, min(50.0, x)))) for x in odds], joint

    def train(self, pages: list[tuple[Tree, list[int]]], rounds: int = 80, rate: float = 0.5, ridge: float = 0.005) -> Model:
        """Gradient ascent on the penalised likelihood of labels (per node 0 or 1), steps scaled as in Adagrad."""
        squares: dict = {}
        for _ in range(rounds):
            slope: dict = {}
            for tree, labels in pages:
                marginal, joint = self.marginals(tree)
                for i, (fs, y) in enumerate(zip(tree.features, labels, strict=True)):
                    for f in fs:
                        slope[f] = slope.get(f, 0.0) + y - marginal[i]
                    if i:
                        kind, a = "leaf" if tree.texts[i] is not None else "element", labels[tree.parent[i]]
                        for k, q in enumerate(joint[i]):
                            key = (kind, k >> 1, k & 1)
                            slope[key] = slope.get(key, 0.0) + (a == k >> 1 and y == k & 1) - q
            for key, g in slope.items():
                table = self.edge if isinstance(key, tuple) else self.node
                g -= ridge * len(pages) * table.get(key, 0.0)
                squares[key] = squares.get(key, 1e-8) + g * g
                table[key] = table.get(key, 0.0) + rate * g / math.sqrt(squares[key])
        return self

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        tree = Tree(page)
        marginal, _ = self.marginals(tree)
        return "\n".join(t for t, p in zip(tree.texts, marginal, strict=True) if t is not None and p > 0.5)


CONTENT = "\ue000"


def labelled_pages(count: int = 90, seed: int = 7) -> list[tuple[Tree, list[int]]]:
    """Pages in varied layouts; a run of text is content if it starts with a mark, which the model doesn't see.

    An element is content if a run below it is.
    """
    rng = random.Random(seed)
    words = "lorem ipsum dolor sit amet elit sed tempor magna aliqua enim minim veniam quis nostrud ullamco nisi duis aute irure velit esse cillum fugiat nulla".split()

    def say(low: int, high: int) -> str:
        return " ".join(rng.choice(words) for _ in range(rng.randint(low, high))).capitalize() + rng.choice([".", ".", "!", "?", ""])

    def links(low: int, high: int) -> str:
        items = [f'<a href="/{i}">{say(1, 3)}</a>' for i in range(rng.randint(low, high))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.7 else " | ".join(items)

    def named(tag: str, names: list[str], inner: str) -> str:
        name = rng.choice(names)
        at = rng.choice(["class", "id"])
        return f'<{tag} {at}="{name}">{inner}</{tag}>'

    def paragraph(mark: str) -> str:
        inner = mark + say(2, rng.choice([8, 40, 120]))
        roll = rng.random()
        if roll < 0.15:
            inner += f' <a href="/x">{say(1, 3)}</a> ' + say(2, 10)
        if roll > 0.9:
            inner = f"<b>{inner}<br>"
        return f"<p>{inner}" + ("</p>" if rng.random() < 0.85 else "")

    def article() -> str:
        """An article in up to four elements that tell nothing."""
        inner = own_article()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            tag = rng.choice(["div", "div", "section", "center", "main"])
            inner = f"<{tag}>{inner}</{tag}>"
        return f"<table><tr><td>{inner}</td></tr></table>" if rng.random() < 0.05 else inner

    def own_article() -> str:
        mark = CONTENT
        parts = [f"<h1>{mark}{say(2, 9)}</h1>"] if rng.random() < 0.9 else []
        for _ in range(rng.randint(1, 9)):
            roll = rng.random()
            if roll < 0.7:
                parts.append(paragraph(mark))
            elif roll < 0.78:
                parts.append(f"<h2>{mark}{say(1, 6)}</h2>")
            elif roll < 0.84:
                parts.append("<ul>" + "".join(f"<li>{mark}{say(2, 14)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif roll < 0.88:
                parts.append(f"<blockquote><p>{mark}{say(6, 30)}</p></blockquote>")
            elif roll < 0.9:
                parts.append("<table>" + "".join(f"<tr><td>{mark}{say(1, 3)}</td><td>{mark}{say(1, 3)}</td></tr>" for _ in range(3)) + "</table>")
            elif roll < 0.93:
                parts.append(f"<pre>{mark}{say(4, 20)}</pre>")
            elif roll < 0.96:
                parts.append(aside())
            elif roll < 0.98:
                parts.append(advert())
            else:
                parts.append(invitation())
        body = "".join(parts)
        if sum(len(p) > 200 for p in parts) > 2 and rng.random() < 0.15:
            # An article in an element whose name says something else.
            body = named("div", ["navigation", "widget", "banner", "header", "alert", "search", "author", "share-tools", "modal", "related", "form", "page-header", "menu"], body)
        roll = rng.random()
        if roll < 0.55:
            return f"<article>{body}</article>"
        if roll < 0.8:
            return named("div", ["content", "article-body", "post", "entry-content", "story", "main-text"], body)
        if roll < 0.9:
            return f"<main>{body}</main>"
        return f"<div>{body}</div>" if rng.random() < 0.6 else body

    def advert() -> str:
        if rng.random() < 0.1:
            return named("table", ["paid-partnership", "sponsors", "ad-table"], "".join(f"<tr><td>{say(1, 4)}</td><td>{say(1, 6)}</td></tr>" for _ in range(rng.randint(1, 3))))
        return named("div", ["ad", "ads", "advert", "sponsored", "promo-box", "banner-ad"], rng.choice([say(3, 30), f"<p>{say(3, 20)}</p>", f"{say(2, 8)} {say(4, 12)}"]))

    def aside() -> str:
        inner = rng.choice([links(2, 6), f"<h3>{say(1, 3)}</h3>" + links(2, 5), f"<p>{say(4, 30)}</p>"])
        return f"<aside>{inner}</aside>" if rng.random() < 0.5 else named("div", ["sidebar", "related-posts", "widget", "recommended"], inner)

    def menu() -> str:
        return f"<nav>{links(3, 8)}</nav>" if rng.random() < 0.6 else named("div", ["menu", "navbar", "breadcrumbs", "nav-main"], links(3, 8))

    def header() -> str:
        return f"<header>{rng.choice([say(1, 4), f'<h1>{say(1, 4)}</h1>', links(1, 4)])}</header>" if rng.random() < 0.7 else named("div", ["header", "masthead", "site-header"], say(1, 5))

    def footer() -> str:
        inner = rng.choice([f"&copy; {say(2, 20)}", links(2, 5), f"<p>{say(4, 30)}</p>"])
        return f"<footer>{inner}</footer>" if rng.random() < 0.75 else named("div", ["footer", "site-footer", "copyright"], inner)

    def notice() -> str:
        return named(rng.choice(["div", "section", "div"]), ["cookie-notice", "consent", "alert", "notice", "popup", "gdpr-banner"], f"<p>{say(5, 30)}</p><button>{say(1, 2)}</button>")

    def invitation() -> str:
        inner = rng.choice([say(3, 12), f"<p>{say(3, 14)}</p><button>{say(1, 2)}</button>"])
        return named("div" if "<p>" in inner else rng.choice(["p", "div", "section"]), ["sub-cta", "newsletter-signup", "sign-up", "cta-box"], inner)

    def form() -> str:
        if rng.random() < 0.4:
            return invitation()
        return rng.choice([f"<form><label>{say(1, 3)}</label><input type=text><button>{say(1, 2)}</button></form>", named("div", ["newsletter", "search-form", "subscribe"], f"<p>{say(3, 14)}</p><form><input><button>{say(1, 2)}</button></form>")])

    def comments() -> str:
        each = "".join(rng.choice([f'<div class="comment"><p>{say(4, 60)}</p></div>', f'<li class="comment"><b>{say(1, 2)}</b><p>{say(4, 50)}</p></li>']) for _ in range(rng.randint(1, 5)))
        if rng.random() < 0.2:
            return f"<details><summary>{rng.choice(['Comments', '12 comments', 'Reader comments', 'Discussion (4)'])}</summary>{each if rng.random() < 0.5 else each.replace(' class="comment"', '')}</details>"
        if rng.random() < 0.4:
            # Named as a whole alone.
            each = each.replace(' class="comment"', "")
        return named(rng.choice(["div", "section", "ol"]), ["comments", "comment-list", "discussion", "responses"], f"<h3>{say(1, 3)}</h3>" + each)

    out = []
    for _ in range(count):
        top = [x() for x in (header, menu, notice, advert) if rng.random() < 0.6]
        bottom = [x() for x in (comments, aside, form, advert, footer) if rng.random() < 0.5]
        rng.shuffle(top)
        page = "<html><head><title>t</title></head><body>" + "".join(top) + article() + "".join(bottom) + "</body></html>"
        tree = Tree(page)
        labels = [int(t is not None and CONTENT in t) for t in tree.texts]
        tree.texts = [t and t.replace(CONTENT, "") for t in tree.texts]
        for i in range(len(labels) - 1, 0, -1):
            labels[tree.parent[i]] |= labels[i]
        out.append((tree, labels))
    return out


@cache
def default_model() -> Model:
    return Model().train(labelled_pages())


def extract_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Add main_text to all columns of ``pages`` (html, ...): the whole page's content runs, joined by line feeds.

    A null or empty page has empty text, and so has one without content; a tag
    that the page's end cuts off is no text.  The time grows with the page's
    length, whatever its nesting or faults.
    Character references are decoded and white space in a run is one space.
    Repeated rows get equal texts; a column named main_text is replaced.
    """
    model = model or default_model()
    pages = pages.drop("main_text")
    names = pages.columns
    where = names.index("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_batches(whole, where):
                texts = [model.extract(x) for x in batch.column(where).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "main_text"])

    return plainly_named(pages).mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField("main_text", T.StringType())]))

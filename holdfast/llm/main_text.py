"""Main text of web pages by a tree-structured graphical model.

Every block element of a page is a node with a hidden label: content, boilerplate, or a
wrapper of both. A table of parent-child potentials gives a child's label by its parent's,
its own tag and the hints in its class, id and role; what a node emits is the length of its
own text, the share of it inside links and whether it begins like boilerplate, by its tag
and the nearest hint above it; boilerplate stays so below. One pass up and one pass down the tree (sum-product) give
each node's marginals, and text of nodes that are content with over 0.5 is kept.

The tables are counts over labelled pages: the small hand-labelled set below, and a
bounded sample of the table's own pages that mark their article themselves. Text is
evidence only in surroundings in which both kinds of it were seen, so that long comments
don't outweigh what their section is called.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import chunks, small_batches

#: Pages that mark their own article which training takes, by their hash (about so many, or all if there are fewer).
TRAIN_PAGES = 2000
#: Times that each hand-labelled page counts.
HAND_WEIGHT = 40
#: Elements deeper than this become children of the last one above it, as browsers do; no text is lost.
MAX_DEPTH = 512

#: Labels: boilerplate, content, wrapper.
BOILER, CONTENT, WRAPPER = 0, 1, 2

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*+")
_STOP = re.compile("[>\"']")
_RAW = {t: re.compile(rf"(?i)</{t}(?=[\s/>])") for t in ("script", "style", "textarea", "title", "iframe")}
_NAMES = re.compile(r"""(?<![\w-])(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_MARK = re.compile(r'data-y="([012])"')

# Kinds of tags of the HTML standard, and words that pages name their parts by.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset(
    "address article aside blockquote body center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul td tr th dt dd".split()
)
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "button": {"button"}, "select": {"select"}}
#: Elements whose own text is not content, nor is what is below one that is closed.
_OFF = frozenset("button select option optgroup object noscript template svg".split())
_STOPS = frozenset("ul ol dl table body article section div".split())
_PARTS = {
    "nav": "nav", "aside": "aside", "footer": "foot", "header": "head", "form": "form", "article": "article", "main": "main",
    "section": "div", "div": "div", "body": "body", "html": "body", "center": "div", "head": "meta", "dialog": "aside",
    "p": "p", "blockquote": "p", "pre": "p", "h1": "h", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h",
    "ul": "list", "ol": "list", "dl": "list", "menu": "nav", "li": "li", "dt": "li", "dd": "li",
    "table": "table", "tbody": "table", "thead": "table", "tr": "table", "td": "cell", "th": "cell", "figure": "figure", "figcaption": "figure",
    "button": "form", "select": "form", "option": "form", "optgroup": "form", "object": "form", "noscript": "form", "template": "form", "svg": "form",
}
_BOILER = frozenset(
    "ad ads adv adsense adslot advert adverts advertisement advertorial banner banners billboard sponsor sponsors sponsored sponsorship promo promos promoted promotion outbrain taboola dfp "
    "cookie cookies consent gdpr ccpa notice notices notification notifications alert alerts popup popups modal overlay lightbox toast paywall disclaimer interstitial "
    "newsletter subscribe subscription signup login signin register search form forms poll survey "
    "nav navbar navi navigation menu menus submenu breadcrumb breadcrumbs crumbs sitemap skip toc tabs pagination pager paging paginator prev next "
    "sidebar sidebars side aside rail gutter secondary tertiary widget widgets "
    "related recommend recommended recommendations recommendation popular trending teaser teasers similar "
    "share sharing shares social follow bookmark "
    "footer footers foot bottom colophon copyright legal imprint credits masthead header topbar toolbar taskbar complementary contentinfo "
    "comment comments commentary commentlist replies reply respond responses discussion discussions disqus guestbook feedback reviews tagcloud tags".split()
)
_STEMS = ("comment", "advert", "cookie", "sidebar", "footer", "navbar", "navig", "breadcrumb", "newsletter", "subscri", "sponsor", "disqus", "recommend", "related", "sharing", "promo")
_CONTENT = frozenset("article articlebody content contents maincontent main post postbody entry story storybody body text prose copy blogpost news".split())
#: Parts of a name that say what a page or post is about or has, not what the element is.
_ABOUT = re.compile(r"(?i)^(?:tag|category|cat|type|status|format|has|no|with|without|hide|show|is|js|template|single|postid|page)[-_]")
#: Parts of a name that say what an element stands beside.
_BESIDES = re.compile(r"(?i)[-_](?:with|without|has|no|fixed|sticky)[-_]\w+")
#: Names of what readers wrote or what leads elsewhere, which holds articles of its own; and those that can't be meant otherwise.
_TALK = re.compile(r"(?i)comment|repl(?:y|ies)|respon[sd]|discuss|disqus|review|guestbook|feedback|related|recommend|teaser|trending|popular|sidebar|promo|sponsor|advert")
_SURE = re.compile(r"(?i)comment|repl(?:y|ies)|respon[sd]|disqus|cookie|consent|gdpr|notice|notif|alert|advert|\bads?\b|sponsor|promo|newsletter|subscri|nav|menu|footer|sidebar|related|recommend|popup|overlay|toast|legal|copyright|share|social|log-?in|sign-?(?:in|up)|header|widget|banner|paywall")
_SIDES = re.compile(r"(?i)^(?:col|column|box|pane|panel|region|content|layout)?[-_]?(?:left|right)[-_]?(?:col|column|rail|bar|box|pane|panel|side)?$")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: How boilerplate that has no name of its own begins.
_CUE = re.compile(
    r"(?i)(?:(?:\d+ )?(?:comments?|replies|responses)\b|leave a (?:reply|comment)|related\b|you (?:may|might) also|more (?:stories|from|on this)|most (?:read|popular)|read (?:more|next)|recommended|trending|share (?:this|on)|follow us|sign (?:up|in)|log ?in|subscribe|advertisement|sponsored|about the author|©|\(c\)|copyright|all rights reserved|(?:we|this (?:web)?site) uses? cookies|by (?:continuing|using)|accept (?:all|cookies)|skip to|privacy policy|terms (?:of|and))"
)


def hint_of(tag: str, attrs: str) -> str:
    """What an element's names say that it is."""
    if tag in ("body", "html"):
        return "-"
    found = "-"
    for m in _NAMES.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        for name in value.split():
            if _ABOUT.match(name):
                continue
            words = [w.lower() for w in _WORD.findall(_BESIDES.sub("", name))]
            if not words:
                continue
            if any(w in _BOILER or w.startswith(_STEMS) for w in words) or _SIDES.match(name):
                if tag == "main" or tag == "article" and not any(w.startswith(("comment", "repl", "respon", "teaser", "related", "promo", "advert", "sponsor", "widget")) or w == "ad" for w in words):
                    continue
                if words[0] in ("article", "post", "entry", "story") and words[-1] in ("header", "title", "text", "body", "content"):
                    continue  # a post's own header
                return "boiler"
            if any(w in _CONTENT for w in words):
                found = "content"
    return found


class Node:
    __slots__ = ("tag", "part", "hint", "parent", "chars", "linked", "cue", "label", "names")

    def __init__(self, tag: str, hint: str, parent: int, label: int | None):
        self.tag, self.part, self.hint, self.parent, self.chars, self.linked, self.cue, self.label = tag, _PARTS.get(tag, "other"), hint, parent, 0, 0, 0, label
        self.names = ""


def _tokens(page: str):
    """(start, end, name, closing, attributes) of tags; name is None for comments, declarations and raw elements.

    One scan forward: what isn't there any more is looked for once.
    """
    at, quotes = 0, {'"': True, "'": True}
    while (start := page.find("<", at)) >= 0:
        first = page[start + 1 : start + 2]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            end = len(page) if end < 0 else end + 3
            yield start, end, None, False, ""
            at = end
            continue
        m = _NAME.match(page, start + 2 if first == "/" else start + 1)
        if m is None and first not in ("!", "?", "/"):
            at = start + 1
            continue
        if m is None or first == "/":
            end = page.find(">", start)
            if end < 0:
                return
            yield start, end + 1, m and m[0].lower(), True, ""
            at = end + 1
            continue
        k = m.end()
        while True:
            stop = _STOP.search(page, k)
            if stop is None:
                return
            k, quote = stop.end(), stop[0]
            if quote == ">":
                break
            if quotes[quote]:
                close = page.find(quote, k)
                if close < 0:
                    quotes[quote] = False
                else:
                    k = close + 1
        name, attrs = m[0].lower(), page[m.end() : k - 1]
        if name in _RAW:
            close = _RAW[name].search(page, k)
            end = len(page) if close is None else page.find(">", close.end() - 1) + 1 or len(page)
            yield start, end, None, False, ""
            at = end
            continue
        yield start, k, name, False, attrs
        at = k


def parse(page: str, marks: bool = False) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements, parents first, and the text blocks in page order with their nodes; ``marks`` reads labels, of hand-labelled pages only."""
    nodes = [Node("html", "-", -1, None)]
    stack, blocks, run, links, last = [0], [], [], 0, 0
    opened: Counter = Counter()

    def flush() -> None:
        if run:
            said = " ".join(html_lib.unescape("".join(run)).split())
            run.clear()
            if said:
                blocks.append((stack[-1], said))
                n = nodes[stack[-1]]
                n.chars += len(said)
                n.cue = n.cue or int(bool(_CUE.match(said)))

    def pop(k: int, closed: int = -1) -> None:
        flush()
        ended = {at for at in stack[k:] if nodes[at].tag in _OFF}
        for n in nodes[min(ended) + 1 :] if ended else ():
            if closed in ended:
                n.part, n.hint = "form", "boiler"
            elif n.parent in ended:  # never closed: what follows isn't below it
                n.parent = nodes[n.parent].parent
        for at in stack[k:]:
            opened[nodes[at].tag] -= 1
        del stack[k:]

    for start, end, tag, closing, attrs in _tokens(page):
        if start > last:
            run.append(page[last:start])
            if links:
                nodes[stack[-1]].linked += start - last
        last = end
        if tag is None:
            continue
        if tag in _INLINE:
            if tag == "a":
                links = 0 if closing else 1
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in _VOID and tag != "hr":
            continue
        if closing:
            if opened[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]].tag == tag:
                        pop(k, stack[k])
                        break
            else:
                flush()
            continue
        if tag == "svg" and attrs.endswith("/"):
            continue
        flush()
        links = 0
        if tag in _CLOSES_P and nodes[stack[-1]].tag == "svg":
            pop(len(stack) - 1)
        if tag in _CLOSES_P and nodes[stack[-1]].tag == "p":
            pop(len(stack) - 1)
        if tag in _SAME and any(opened[t] for t in _SAME[tag]):
            for k in range(len(stack) - 1, 0, -1):
                here = nodes[stack[k]].tag
                if here in _SAME[tag]:
                    pop(k)
                    break
                if here in _STOPS:
                    break
        mark = _MARK.search(attrs) if marks else None
        if tag == "html" and mark:
            nodes[0].label = int(mark[1])
        if tag in ("html", "hr"):
            continue
        while len(stack) > MAX_DEPTH:
            pop(len(stack) - 1)
        hint = "boiler" if tag in _OFF else hint_of(tag, attrs) if attrs else "-"
        nodes.append(Node(tag, hint, stack[-1], int(mark[1]) if mark else None))
        if hint == "boiler":
            nodes[-1].names = attrs
        stack.append(len(nodes) - 1)
        opened[tag] += 1
    if last < len(page):
        run.append(page[last:])
    pop(1)
    flush()
    _weigh(nodes)
    if not any(nodes[k].tag not in ("html", "body") for k, _ in blocks):
        for n in nodes:
            n.part = "lone" if n.part == "body" else n.part  # a page of bare text
    return nodes, blocks


def _weigh(nodes: list[Node]) -> None:
    """What the prose of the whole page says about its elements' names, and elements that only hold another.

    A part named like boilerplate isn't any if it holds the article, the main part or a part
    named like content with most of the page's prose; nor is one whose name may be meant
    otherwise, or a form, if it has several paragraphs and there is no prose elsewhere. A heading that begins like
    boilerplate names the part that it opens. Elements without a name, text or second child
    around another such element are passed over, so that depth costs nothing.
    """
    first: set[int] = set()
    for n in nodes:
        if n.chars and n.parent > 0 and n.parent not in first:
            first.add(n.parent)
            up = nodes[n.parent]
            if n.part == "h" and n.cue and up.part == "div" and up.hint == "-" and not up.chars and up.tag != "body":
                up.hint, up.names = "boiler", "related"
    named = [n.tag not in _OFF and (n.hint == "boiler" or n.part == "form") and n.part not in ("nav", "foot", "aside") for n in nodes]
    if any(named):
        prose = [n.chars if n.chars > 30 and n.linked < n.chars * 0.3 else 0 for n in nodes]
        held, many, core, off, outside = list(prose), [x > 0 for x in prose], [0] * len(nodes), [False] * len(nodes), 0
        for k in range(len(nodes) - 1, 0, -1):
            up, n = nodes[k].parent, nodes[k]
            held[up] += held[k]
            many[up] += many[k]
            core[up] = max(core[up], core[k], held[k] if n.tag in ("article", "main") or n.hint == "content" else 0)
        for k, n in enumerate(nodes):
            off[k] = n.hint == "boiler" or n.part in ("nav", "foot", "aside", "form") or n.parent >= 0 and off[n.parent]
            outside += 0 if off[k] else prose[k]
        for k, n in enumerate(nodes):
            if named[k] and (2 * core[k] > held[0] and not _TALK.search(n.names) or not outside and many[k] > 1 and 2 * held[k] > held[0] and not _SURE.search(n.names)):
                n.hint, n.part = "-", "div" if n.part == "form" else n.part
    children = Counter(n.parent for n in nodes)
    for n in nodes:
        while n.part == "div" and n.parent > 0 and (up := nodes[n.parent]).part == "div" and up.hint == "-" and not up.chars and children[n.parent] == 1:
            n.label = up.label if n.label is None else n.label
            up.part, n.parent = "void", up.parent


def seen(nodes: list[Node]) -> list[tuple[str, str]]:
    """Of every node: its surroundings (the nearest hint above or at it, with its own part), and its own text's length, links and beginning."""
    near, out = [], []
    for n in nodes:
        here = n.hint if n.hint != "-" else "boiler" if n.part in ("nav", "aside", "foot", "form") else "head" if n.part == "head" else "content" if n.part in ("article", "main") else ""
        above = near[n.parent] if n.parent >= 0 else "-"
        near.append(above if above == "boiler" or not here else here)
        size = 0 if not n.chars else 1 + (n.chars > 30) + (n.chars > 120)
        links = 0 if not n.chars else 1 if n.linked < n.chars * 0.3 else 2
        out.append((f"{n.part},{near[-1]}", f"{size},{links},{n.cue}"))
    return out


def labelled(nodes: list[Node]) -> list[int] | None:
    """Labels from marks, which hold down to the next mark, or else from the one article; nodes that hold it are wrappers."""
    labels = []
    if any(n.label is not None for n in nodes):
        for n in nodes:
            labels.append(n.label if n.label is not None else labels[n.parent] if n.parent >= 0 else WRAPPER)
        return labels
    roots = [k for k, n in enumerate(nodes) if n.tag == "article" and n.hint != "boiler"] or [k for k, n in enumerate(nodes) if n.tag == "main"]
    if len(roots) != 1:
        return None
    above, k = set(), nodes[roots[0]].parent
    while k >= 0:
        above.add(k)
        k = nodes[k].parent
    for k, n in enumerate(nodes):
        off = n.part in ("nav", "aside", "foot", "form") or n.hint == "boiler"
        labels.append(WRAPPER if k in above else CONTENT if k == roots[0] else BOILER if off or labels[n.parent] == WRAPPER else labels[n.parent])
    return labels


def count(nodes: list[Node], labels: list[int], into: Counter) -> None:
    for n, y, (place, text) in zip(nodes, labels, seen(nodes), strict=True):
        if n.part == "void":
            continue
        into[f"text|{place}|{text}", y] += 1
        into[f"step|{n.part},{n.hint}|{labels[n.parent]}" if n.parent >= 0 else f"root|{n.part}|", y] += 1


#: What a child's label is by its parent's where nothing was counted: for each parent label, (boiler, content, wrapper).
_CHILD = {BOILER: (1.0, 1e-7, 1e-7), CONTENT: (0.1, 0.9, 1e-4), WRAPPER: (0.5, 0.2, 0.3)}
_HINTED = {BOILER: (1.0, 1e-9, 1e-9), CONTENT: (1.0, 1e-5, 1e-7), WRAPPER: (1.0, 1e-5, 1e-5)}


class Model:
    """Log tables from counts of (what is seen, label)."""

    def __init__(self, counts: Counter, smooth: float = 2.0):
        steps: Counter = Counter()
        texts: Counter = Counter()
        self.tables: dict[str, tuple[float, float, float]] = {}
        keys = {k for k, _ in counts}
        for key in keys:
            kind, a, b = key.split("|")
            for y in range(3):
                n = counts[key, y]
                if kind == "step":
                    steps[a.split(",")[1], b, y] += n
                elif kind == "text":
                    texts[a, y] += n
                    texts[a, b, "any"] += n
                    texts[a, "any"] += n
        self._back = {}
        for hint in ("-", "content", "boiler"):
            for up in range(3):
                base = (_HINTED if hint == "boiler" else _CHILD)[up]
                total = sum(steps[hint, str(up), y] for y in range(3)) + smooth
                self._back[hint, up] = [(steps[hint, str(up), y] + smooth * base[y] / sum(base)) / total for y in range(3)]
        for key in keys:
            kind, a, b = key.split("|")
            n = [counts[key, y] for y in range(3)]
            if kind == "step":
                back = self._back[a.split(",")[1], int(b)]
                self.tables[key] = tuple(log((n[y] + smooth * back[y]) / (sum(n) + smooth)) for y in range(3))
            elif kind == "root":
                self.tables[key] = tuple(log((n[y] + 0.01) / (sum(n) + 0.03)) for y in range(3))
            else:
                # a label's share of the lengths seen in this place, drawn to that of all labels
                every = texts[a, b, "any"] / texts[a, "any"]
                self.tables[key] = tuple(log((n[y] + smooth * every) / (texts[a, y] + smooth)) for y in range(3))
        # a length not seen in its place
        self.places = {a: tuple(log(smooth * 0.01 / (texts[a, y] + smooth)) for y in range(3)) for a in {k.split("|")[1] for k in keys if k.startswith("text")}}

    def potential(self, part: str, hint: str, up: int) -> tuple[float, ...]:
        """Log of a child's label by its parent's."""
        found = self.tables.get(f"step|{part},{hint}|{up}")
        return found or tuple(log(x) for x in self._back[hint, up])

    def emission(self, place: str, text: str) -> tuple[float, ...]:
        return self.tables.get(f"text|{place}|{text}") or self.places.get(place) or (0.0, 0.0, 0.0)

    def root(self, part: str) -> tuple[float, ...]:
        return self.tables.get(f"root|{part}|") or (log(0.05), log(0.05), log(0.9))

    def marginals(self, nodes: list[Node]) -> list[tuple[float, float, float]]:
        """Probabilities of every node's labels by sum-product over the tree."""
        labels = range(3)
        steps = [[self.potential(n.part, n.hint, up) for up in labels] for n in nodes]
        # of many texts side by side each is less evidence of what they stand in
        texts = Counter(n.parent for n in nodes if n.chars)
        below = [[x / max(1, texts[n.parent]) ** 0.5 for x in self.emission(*e)] for n, e in zip(nodes, seen(nodes), strict=True)]  # own evidence and what children send
        sent = [(0.0, 0.0, 0.0)] * len(nodes)
        for k in range(len(nodes) - 1, 0, -1):  # children come after their parents
            to, own = below[nodes[k].parent], below[k]
            sent[k] = tuple(_sum(*(steps[k][up][y] + own[y] for y in labels)) for up in labels)
            for up in labels:
                to[up] += sent[k][up]
        down, out = [self.root(nodes[0].part)] * len(nodes), []
        for k, n in enumerate(nodes):
            if k:
                rest = [down[n.parent][up] + below[n.parent][up] - sent[k][up] for up in labels]
                down[k] = tuple(_sum(*(rest[up] + steps[k][up][y] for up in labels)) for y in labels)
            own = [down[k][y] + below[k][y] for y in labels]
            total = _sum(*own)
            out.append(tuple(exp(x - total) for x in own))
        return out

    def text(self, page: str) -> str:
        nodes, blocks = parse(page)
        if not blocks:
            return ""
        p = self.marginals(nodes)
        return "\n".join(said for k, said in blocks if p[k][CONTENT] > 0.5)


def _sum(*logs: float) -> float:
    top = max(logs)
    return top + log(sum(exp(x - top) for x in logs))


_LONG = "Long sentences of prose stand in the body of an article, with commas, clauses and a full stop at their end, and they go on for more than a line or two before they come to it."
_MID = "Another sentence of some dozen words, as are found in any story."
_P = f"<p>{_LONG}</p><p>Short one.</p><p>{_MID} <a href='/x'>With a link</a> or none.</p>"
_LINKS = "<ul><li><a href='/'>Home</a></li><li><a href='/n'>News of the day</a></li><li><a href='/c'>Contact us</a></li></ul>"
_SAYS = f"<p>{_LONG}</p><p>Great read!</p><p>{_MID}</p>"

#: The body of an article, as it may be made up; marks are labels of an element and what is below it.
_BODIES = [
    f"<h1>A title</h1>{_P}<h2>Part</h2>{_P}<ul><li>One item of a list</li><li>{_MID}</li><li>{_LONG}</li></ul>",
    f"<header><h1>A title</h1><p>By someone, some day</p></header><div>{_P}</div><blockquote>{_MID}</blockquote><section>{_P}<h3>Part</h3>{_P}</section>",
    f"<div><h1>A title</h1>{_P}<figure><figcaption>What the picture shows.</figcaption></figure><table><tr><th>Name</th><td>A cell</td><td>42</td></tr></table>{_P}</div>",
    f"<h1>A title</h1>{_P}<dl><dt>Term</dt><dd>{_MID}</dd></dl><pre>{_MID}</pre><ol><li>Mix both.</li><li>{_LONG}</li></ol><blockquote><p>{_LONG}</p></blockquote>",
    f"<section><h2>A title</h2>{_LONG}<div>{_MID}</div><div>Short.</div><div>{_LONG}</div></section><p>{_LONG}</p>",
]
#: What holds it.
_HOLDERS = [
    ("<article data-y='1'>", "</article>"), ("<main data-y='1'>", "</main>"), ("<main data-y='2'><article data-y='1'>", "</article></main>"),
    ("<div id='content' data-y='1'>", "</div>"), ("<div data-y='2'><div class='post-body' data-y='1'>", "</div></div>"), ("<div class='wrapper' data-y='2'><article class='post' data-y='1'>", "</article></div>"),
    ("<div data-y='2'><div data-y='1'>", "</div></div>"), ("<div data-y='1'>", "</div>"), ("<section data-y='1'>", "</section>"), ("<table data-y='2'><tr><td data-y='1'>", "</td></tr></table>"),
    ("<div class='page' data-y='2'><section data-y='2'><div class='story' data-y='1'>", "</div></section></div>"),
]
#: What stands beside it, with names or without; and with short and long text.
_BESIDE = [
    f"<header><p>The Daily Site</p><h2>Site name</h2><nav>{_LINKS}</nav></header>", f"<nav>{_LINKS}</nav>", f"<div class='menu'>{_LINKS}</div>", f"<div>{_LINKS}</div>", f"<ul><li><a href='/a'>One</a></li><li><a href='/b'>{_MID}</a></li></ul>",
    f"<div class='ad'>{_MID}</div>", f"<div class='advert'><p>{_LONG}</p></div>", f"<div class='cookie'><p>{_LONG}</p><p>{_MID}</p></div>", f"<div class='notice' role='alert'><div>{_LONG}</div></div>",
    f"<aside><h3>Popular</h3>{_SAYS}</aside>", f"<div class='sidebar'><div><h3>About</h3><p>{_LONG}</p>{_LINKS}</div><div><p>{_MID}</p></div></div>", f"<div class='related'><h3>More</h3>{_LINKS}<p>{_LONG}</p></div>",
    f"<form><p>Stay in touch.</p><label>Mail</label><p>{_LONG}</p><div>{_MID}</div></form>", f"<div class='newsletter'><h3>Letter</h3><p>{_LONG}</p><form><input><p>{_MID}</p></form></div>",
    f"<section class='comments'><h3>Comments</h3><ul><li><p>{_LONG}</p></li><li>{_SAYS}</li></ul><div><div><p>{_LONG}</p><p>{_LONG}</p></div></div><article><p>{_LONG}</p></article></section>",
    f"<div class='comment'><div><p>{_LONG}</p></div><div class='text'>{_SAYS}</div></div>", f"<article class='comment'>{_SAYS}<div>{_LONG}</div></article>", f"<ol class='comments'><li><div>{_SAYS}</div></li></ol>",
    "<p>© 2020 of its owners.</p>", "<div>Copyright 2020, all rights reserved.</div>", "<div>This site uses cookies to work as it should.</div>", "<div><p>We use cookies so that this site works as it should, and to count its visits and those of others.</p></div>",
    f"<footer><p>{_MID}</p>{_LINKS}</footer>", f"<footer><p>{_LONG}</p><div>{_MID}</div></footer>", f"<div class='footer'><p>{_MID}</p><p>{_LONG}</p></div>", f"<div class='share'>{_LINKS}</div>",
    "<div><a href='/l'>Log in</a></div>", "<div>Skip to what follows</div>", f"<dialog><p>{_LONG}</p></dialog>", "<button>Accept</button>", "<select><option>One</option></select>",
    f"<div><h3>Related stories</h3>{_LINKS}</div>", f"<table><tr><td>{_LINKS}</td></tr></table>", f"<section><h2>Most read</h2>{_LINKS}</section>",
]


def _page(k: int) -> str:
    """A page of a holder, a body, and some things before, in and after it."""
    (begin, end), body = _HOLDERS[k % len(_HOLDERS)], _BODIES[k % len(_BODIES)]
    beside = [_BESIDE[(5 * k + j * 7) % len(_BESIDE)].replace(">", " data-y='0'>", 1) for j in range(5)]
    cut = body.index(_P) + len(_P) if _P in body else len(begin) and body.index("<div>")
    inside = beside[2] if k % 2 and not beside[2].startswith("<p") else ""  # a bare paragraph of an article is the article's
    return f"<body data-y='2'>{beside[0]}{beside[1]}{begin}{body[:cut]}{inside}{body[cut:]}{beside[4] if k % 3 == 0 else ''}{end}{beside[3]}</body>"


#: Hand-labelled pages; pages of bare text are content as a whole.
LABELLED = [_page(k).replace("'", '"') for k in range(110)] + [
    f"<body data-y='1'>{_BESIDE[k].replace('>', " data-y='0'>", 1)}{_BODIES[k % len(_BODIES)]}{_BESIDE[-1 - k].replace('>', " data-y='0'>", 1)}</body>".replace("'", '"') for k in range(12)
] + [f'<html data-y="1">{x}' for x in (f"<p>{_LONG}</p><p>{_MID}</p>", f"<h1>A title</h1>{_P}", "<p>Short one.</p>")] + [
    f'<html data-y="1">{x}' for x in (_LONG, _MID, "Short one.", f"{_MID}<br><br>{_LONG}<br>{_MID}", f'<body data-y="1">{_LONG}<br>{_LONG}</body>', f'<body data-y="1">{_MID}</body>')
]


def _hand_counts() -> Counter:
    counts: Counter = Counter()
    for page in LABELLED:
        nodes, _ = parse(page, marks=True)
        count(nodes, labelled(nodes), counts)
    return Counter({k: n * HAND_WEIGHT for k, n in counts.items()})


def train(pages: DataFrame, sample: int = TRAIN_PAGES) -> Model:
    """Tables from ``LABELLED`` and from some ``sample`` pages, by hash, that mark their article.

    What comes to the driver is one row for each kind of emission and label: a fixed number.
    """

    def scan(batches):
        found: Counter = Counter()
        for batch in chunks(batches, "html"):
            for page in batch.column(0).to_pylist():
                nodes, _ = parse(page)
                if (labels := labelled(nodes)) is not None:
                    count(nodes, labels, found)
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.string()), pa.array([y for _, y in keys], pa.int32()), pa.array([found[k] for k in keys], pa.int64())],
            names=["seen", "label", "n"],
        )

    html = F.col("html").cast("string")
    marked = pages.where(html.rlike("(?i)<(article|main)"))
    # of all marked pages, those whose hash falls below the share that makes up the sample
    share = min(1.0, sample / max(1, marked.count()))
    few = marked.where(F.pmod(F.xxhash64("page_id", "html"), F.lit(1 << 31)) < int(share * (1 << 31))).select(html.alias("html"))
    counts = _hand_counts()
    found = few.mapInArrow(scan, "seen string, label int, n bigint").groupBy("seen", "label").agg(F.sum("n").alias("n")).collect()
    # the table's own pages weigh as much as the hand-labelled ones at most
    scale = min(1.0, sum(counts.values()) / max(1, sum(r.n for r in found)))
    for r in found:
        counts[r.seen, r.label] += r.n * scale
    return Model(counts)


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Main text of each page; columns ``page_id, url, text, n_chars``.

    One row per input row, repeated ones alike; null or empty html gives an empty text, a
    page of bare text that text. Other columns are not used; an empty table gives no rows. A
    map over partitions, with no shuffle but the training counts'.
    """
    small_batches(pages.sparkSession)
    model = model or train(pages)

    def scan(batches):
        for batch in chunks(batches, "html"):
            out = [model.text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(scan, "page_id bigint, url string, text string, n_chars bigint")

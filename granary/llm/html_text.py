"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is cut into blocks, each with its path of open elements.  A linear classifier gives each block a cost of being
boilerplate and a cost of being content; these are the capacities from the source and to the sink.  Its features are
length, link density, sentence ends, the share of the page's text that the block's surroundings hold, and what tags and
names of the path say; the weights are fixed, since pages carry no labels.  Neighbouring blocks, and the next block of
the same parent, are tied by smoothness edges that weaken with their distance in the tree.  The minimum cut labels the
blocks, and the source side is the main text.

Tags and names.  What clearly is no article (navigation, adverts, consent, reader comments, forms, ...) costs its blocks
``AGAINST`` once, however deep it is nested.  But an element that holds a main heading, an article, or several paragraphs
with half of the page's text is a wrapper, whatever its name (a form around the whole page, ``layout-with-sidebar``):
it becomes a node of the graph with a cost of its own, tied to its blocks, and so the cut overrules it when
they are good enough together.  Reader comments are never a wrapper.

Never text: scripts, styles, templates, frames, form controls, comments of the markup, the document's head, and elements
hidden by an attribute of their own (``hidden``, ``aria-hidden``, a style that displays nothing).  Such an element never
takes its surroundings along: the head ends where the body's content begins, a form control where a paragraph or
heading does, and any other that is never closed is no element at all (but scripts and styles, which run to the page's end).
Inside a block white space becomes one space, ends are trimmed, character references are decoded; a line break in the
markup is white space.

Cost.  The page is read once from left to right, what elements hold is summed from the leaves up and what they
are is handed down from the root, and the flow is found with search trees that are kept between augmenting paths, so
the work is close to linear in the length of the page, however deep or broken its markup is.

Defined results: a null or empty html has an empty text; a page without markup is one block; repeated page_ids are
rows of their own; unclosed and misnested tags close with their nearest open element; a tag that is never closed
by ``>`` is text; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by what they mean for text blocks.
SILENT = frozenset("script style noscript template svg iframe object embed applet canvas audio video select datalist textarea button head title map frameset noframes".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp noembed".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - frozenset(("html", "body", "head", "title", "option", "optgroup"))
CLOSES_SAME = frozenset("li dt dd tr td th option optgroup".split())
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head html".split())
CONTROLS = frozenset("select datalist button".split())
ENDS_CONTROL = frozenset("article aside blockquote body dl figure footer form h1 h2 h3 h4 h5 h6 header main nav ol p pre section table ul".split())
BARRIERS = frozenset("table td th article main body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of the id, class and role values, by what they say of an element.
COMMENT_NAMES = frozenset("comment comments commentlist disqus replies reply respond shoutbox discussion".split())
STRONG_NAMES = frozenset("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs complementary consent contentinfo cookie cookies copyright footer gdpr menu menubar modal nav navbar navigation newsletter outbrain overlay pager pagination paywall popup promo promoted share sharing skip social sponsor sponsored subscribe subscription taboola toolbar topbar".split())
WEAK_NAMES = frozenset("alert alertdialog aside banner byline dialog disclaimer form header login masthead meta notice notices recommended related search sidebar signup tags toc widget widgets".split())
CONTENT_NAMES = frozenset("article articlebody body content entry main maincontent post postbody story text".split())
#: First parts of names that tell of a state or a topic, and parts after which a name tells of something else.
_STATES, _BESIDE = frozenset("has with without no is tag category page format status type layout js".split()), frozenset("with without has no".split())
#: Cost of a block in an element that clearly is no article, in one that may be none, and of a wrapper as a whole.
AGAINST, DOUBT, WRAPPER = 8.0, 5.0, 3.0

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)?(?:\s*(=)\s*)?""")
_UNQUOTED = re.compile(r"[^\s>]*")
_DISPLAYS_NOTHING = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_END = re.compile(r"[.!?…:;。！？]['\"”’)\]]*$")


class _Page:
    """A page's tags and texts from left to right; every character is looked at a bounded number of times."""

    def __init__(self, html: str) -> None:
        self.html, self.quotes = html, True
        self.last = {x: html.rfind(x) for x in (">", '"', "'")}
        self._ends: dict[str, list[int]] = {}

    def end_of(self, tag: str, at: int) -> int:
        """Where the next end tag of this name stands, or -1."""
        if tag not in self._ends:
            self._ends[tag] = [m.start() for m in re.finditer(rf"</{tag}[\s/>]", self.html, re.I)]
        k = bisect_left(self._ends[tag], at)
        return self._ends[tag][k] if k < len(self._ends[tag]) else -1

    def _attributes(self, at: int) -> tuple[int, dict[str, str]] | None:
        """Behind a tag's name: (where the tag ends, its attributes), or nothing if it doesn't end."""
        html, out, n = self.html, {}, len(self.html)
        while at < n:
            if html[at] == ">":
                return at + 1, out
            m = _ATTRIBUTE.match(html, at)
            name, at = m[1], m.end()  # type: ignore[index]
            value = ""
            if m[2]:  # type: ignore[index]
                quote = html[at : at + 1]
                if self.quotes and quote in ('"', "'") and self.last[quote] > at:
                    end = html.index(quote, at + 1)
                    value, at = html[at + 1 : end], end + 1
                else:
                    found = _UNQUOTED.match(html, at)
                    value, at = found[0].strip("\"'"), found.end()  # type: ignore[index]
            if name:
                out.setdefault(name.lower(), value)
        return None

    def tokens(self) -> Iterator[tuple[str, bool, dict[str, str], str, int]]:
        """(name, is an end tag, attributes, text, place behind); name or text is empty.  A place sent back is gone to."""
        html, at, n = self.html, 0, len(self.html)
        while at < n:
            if html[at] != "<":
                end = html.find("<", at)
                end = n if end < 0 else end
                text, at = html[at:end], end
                yield "", False, {}, text, at
                continue
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                at = n if end < 0 else end + 3
                continue
            if html.startswith("<![CDATA[", at):
                end = html.find("]]>", at)
                at = n if end < 0 else end + 3
                continue
            if self.last[">"] < at:  # no tag ends any more: all is text
                yield "", False, {}, html[at:], n
                return
            if html.startswith(("<!", "<?"), at):
                at = html.index(">", at) + 1
                continue
            close = html.startswith("</", at)
            m = _NAME.match(html, at + 1 + close)
            if m is None:
                yield "", False, {}, "<", at + 1
                at += 1
                continue
            if html.startswith(">", m.end()):
                found = m.end() + 1, {}
            elif (found := self._attributes(m.end())) is None:
                # Quotes that hide every end: from here on they are characters like others.
                self.quotes = False
                found = self._attributes(m.end()) or (html.index(">", at) + 1, {})
            at, attributes = found
            if attributes and html[at - 2] == "/":
                attributes.setdefault("/", "")
            at = (yield m[0].lower(), close, attributes, "", at) or at


def kind_of_names(attributes: dict[str, str]) -> str:
    """What id, class and role say: comment, strong, weak, content or nothing."""
    found = set()
    for token in " ".join(attributes.get(x, "") for x in ("class", "id", "role", "itemprop")).split():
        parts = [x.lower() for x in _PARTS.findall(token)]
        if not parts or parts[0] in _STATES:
            continue
        parts = parts[: next((k for k, x in enumerate(parts) if x in _BESIDE), len(parts))]
        for kind, names in (("comment", COMMENT_NAMES), ("strong", STRONG_NAMES), ("weak", WEAK_NAMES), ("content", CONTENT_NAMES)):
            if names.intersection(parts):
                found.add(kind)
                break
    if "weak" in found and "content" in found:
        return ""
    return next((k for k in ("comment", "strong", "weak", "content") if k in found), "")


def is_hidden(attributes: dict[str, str]) -> bool:
    """Whether an element's own attributes hide it; words in other attributes' values don't."""
    if "hidden" in attributes and attributes["hidden"].lower() != "until-found":
        return True
    return attributes.get("aria-hidden", "").strip().lower() == "true" or "style" in attributes and bool(_DISPLAYS_NOTHING.search(attributes["style"]))


class _Node:
    """An element: its tag, parent and depth, what its names and tag say, and what it came to hold."""

    __slots__ = ("against", "block", "bonus", "chars", "depth", "kind", "link", "main", "open", "paragraphs", "parent", "silent", "tag", "within", "wrapper")

    def __init__(self, tag: str, attributes: dict[str, str], parent: _Node | None) -> None:
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.silent = bool(parent and parent.silent) or tag in SILENT
        self.link = bool(parent and parent.link) or tag == "a"
        self.within = bool(parent and parent.within) or tag in ("article", "main")
        #: The nearest element that makes blocks, itself included.
        self.block: _Node = self if parent is None or tag in BLOCK else parent.block
        #: How many elements of each name are open inside the nearest barrier, or on the page.
        self.open: dict[str, int] = {} if parent is None or tag in BARRIERS else parent.open
        self.chars, self.main, self.paragraphs = 0, False, 0
        self.kind = ""
        if tag in ("nav", "menu", "aside", "dialog", "footer", "form"):
            self.kind = "strong"
        elif tag == "header":
            self.kind = "title" if parent is not None and parent.within else "weak"
        elif attributes and tag not in ("html", "body"):
            self.kind = kind_of_names(attributes)
            if self.kind == "weak" and self.within and tag in ("div", "span", "p", "header") and any("header" in x.lower() for x in attributes.values()):
                self.kind = "title"
        if tag in ("article", "main") and self.kind != "comment":
            self.kind = "content"
        if attributes and tag not in ("html", "body") and is_hidden(attributes):
            self.silent = True

    def wraps(self, total: int) -> bool:
        """Whether it holds the article itself, whatever it is called."""
        return self.kind in ("strong", "weak") and (self.main and self.tag != "footer" or self.paragraphs > 2 and 2 * self.chars > total)


class Block:
    __slots__ = ("chars", "linked", "node", "text")

    def __init__(self, node: _Node, text: str, linked: int) -> None:
        self.node, self.text, self.linked, self.chars = node, text, linked, len(text)


def parse(html: str) -> tuple[list[Block], list[_Node]]:
    """Text blocks in page order, and all elements, parents before children."""
    page = _Page(html)
    root = node = home = _Node("#", {}, None)
    nodes, out, parts, linked = [root], [], [], 0
    #: Open elements by name on the whole page.
    total: dict[str, int] = {}

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(home, text, linked))
            parts, linked = [], 0

    def leave(to: _Node) -> None:
        """Close all elements up to one, and that one."""
        nonlocal node
        while True:
            was, node = node, node.parent  # type: ignore[assignment]
            total[was.tag] -= 1
            (was.parent if was.tag in BARRIERS else was).open[was.tag] -= 1  # type: ignore[union-attr]
            if was is to:
                return

    def nearest(tag: str) -> _Node:
        up = node
        while up.tag != tag:
            up = up.parent  # type: ignore[assignment]
        return up

    tokens = page.tokens()
    goto = None
    while True:
        try:
            tag, close, attributes, text, at = tokens.send(goto)
        except StopIteration:
            break
        goto = None
        if not tag:
            if node.tag == "head" and text.strip():
                flush()
                leave(node)
                home = node.block
            if not node.silent:
                parts.append(text)
                if node.link:
                    linked += len(text.strip())
            continue
        quiet = node.silent
        if tag in BLOCK and not quiet:
            flush()
        elif tag == "br":
            parts.append(" ")
        if close:
            # An end tag of no open element says nothing; one that isn't of a block stays inside its cell or article.
            if (total if tag in BLOCK else node.open).get(tag):
                leave(nearest(tag))
        else:
            if total.get("head") and tag not in IN_HEAD:
                leave(nearest("head"))
            if tag in ENDS_CONTROL or tag in BLOCK and tag not in ("option", "optgroup"):
                for x in CONTROLS:
                    while total.get(x) and (tag in ENDS_CONTROL or page.end_of(x, at) < 0):
                        leave(nearest(x))
            if tag in CLOSES_P or tag in CLOSES_SAME:
                up = node.block
                if up is not root and (up.tag == "p" and tag in CLOSES_P or tag == up.tag and tag in CLOSES_SAME):
                    leave(up)
            if tag in RAW:
                end = page.end_of(tag, at)
                if end < 0 and tag in ("script", "style"):
                    break
                if end < 0:
                    if tag == "title":
                        goto = html.find("<", at) if html.find("<", at) >= 0 else len(html)
                    continue
                goto = end
            if tag not in VOID and "/" not in attributes or tag in ("p", "div", "a", "script"):
                if tag not in SILENT or tag in RAW or tag == "head" or tag in CONTROLS or page.end_of(tag, at) >= 0:
                    total[tag] = total.get(tag, 0) + 1
                    node.open[tag] = node.open.get(tag, 0) + 1
                    node = _Node(tag, attributes, node)
                    nodes.append(node)
        if not node.silent:
            if quiet and tag in BLOCK:
                flush()
            home = node.block
    flush()
    return out, nodes


def blocks_of(html: str) -> list[Block]:
    return parse(html)[0]


def _summed(blocks: list[Block], nodes: list[_Node]) -> int:
    """What elements hold, from the leaves up, and what they are inside, from the root down; the characters outside links."""
    total = 0
    for b in blocks:
        own = max(0, b.chars - b.linked)
        b.node.chars += own
        total += own
    for node in reversed(nodes):
        up = node.parent
        if up is not None:
            up.chars += node.chars
            if node.kind != "comment" and up.kind != "comment":
                # What reader comments hold says nothing of what is around them.
                up.paragraphs += node.paragraphs + (node.tag == "p")
                up.main |= node.main or node.tag in ("h1", "article", "main")
    for node in nodes:
        up = node.parent
        node.against, node.bonus, node.wrapper = (up.against, up.bonus, up.wrapper) if up is not None else (0.0, 0.0, None)
        if node.kind == "comment":
            node.against = AGAINST
        elif node.kind in ("strong", "weak"):
            if node.wraps(total):
                node.wrapper = node
            else:
                node.against = max(node.against, AGAINST if node.kind == "strong" else DOUBT)
        elif node.kind == "title":
            node.against = max(node.against, 1.0)
        elif node.kind == "content":
            node.bonus = max(node.bonus, 3.0 if node.tag in ("article", "main") else 1.5)
    return total


def score(block: Block, total: int) -> float:
    """The classifier, above 0 for content; the page has ``total`` characters outside links."""
    s = 0.0
    share = min(1.0, block.linked / max(1, block.chars))
    words = block.text.count(" ") + 1
    near = block.node.parent if block.node.tag not in ("div", "td", "body", "section", "#") and block.node.parent else block.node
    around = max(near.chars, near.parent.chars if near.parent is not None and near.parent.tag not in ("body", "html", "#") else 0)
    s += 1.2 if block.node.tag in ("p", "blockquote", "pre", "figcaption") or block.node.tag in HEADINGS else 0.0
    s -= 0.6 if block.node.tag in ("li", "td", "th", "dd", "dt") and not block.node.within else 0.0
    s += min(2.0, words / 20)
    s += 0.5 if _END.search(block.text) else 0.0
    s += 2.0 * around / max(1, total)
    s -= 3.0 * share * share
    s -= 0.8 if words < 4 and not block.node.within else 0.0
    if words < 40 and ("©" in block.text[:40] or words < 12 and "©" in block.text):
        s -= 4.0
    return s + block.node.bonus - block.node.against - 1.2


def _distance(a: _Node, b: _Node) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent  # type: ignore[assignment]
        else:
            b = b.parent  # type: ignore[assignment]
        steps += 1
    return steps


_NONE, _END_NODE, _ORPHAN = -1, -2, -3


class _Flow:
    """Maximum flow by two search trees, from the source and from the sink, that are mended after each augmenting path."""

    def __init__(self, gain: list[float], edges: list[tuple[int, int, float]]) -> None:
        n = len(gain)
        self.rest = list(gain)  # above 0: left from the source; below: left to the sink
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[float] = []
        for a, b, c in edges:
            for x, y in ((a, b), (b, a)):
                self.out[x].append(len(self.to))
                self.to.append(y)
                self.cap.append(c)
        self.side = [(g > _TINY) - (g < -_TINY) for g in gain]
        #: The edge from the parent (on the source side) or to it; else what it is.
        self.way = [_END_NODE if s else _NONE for s in self.side]
        self.depth = [0] * n
        self.active = deque(i for i in range(n) if self.side[i])

    def run(self) -> list[bool]:
        active, side, cap, to = self.active, self.side, self.cap, self.to
        while active:
            i = active[0]
            bridge = _NONE
            if side[i]:
                for e in self.out[i]:
                    if cap[e if side[i] > 0 else e ^ 1] > _TINY:
                        j = to[e]
                        if not side[j]:
                            side[j], self.way[j], self.depth[j] = side[i], e if side[i] > 0 else e ^ 1, self.depth[i] + 1
                            active.append(j)
                        elif side[j] != side[i]:
                            bridge = e if side[i] > 0 else e ^ 1
                            break
            if bridge == _NONE:
                active.popleft()
            else:
                self._adopt(self._augment(bridge))
        return [s > 0 for s in side]

    def _augment(self, bridge: int) -> list[int]:
        """Fill the path over an edge between the trees; the nodes that lose their parents."""
        ways, orphans = [bridge], []
        i = self.to[bridge ^ 1]
        while self.way[i] >= 0:
            ways.append(self.way[i])
            i = self.to[self.way[i] ^ 1]
        j = self.to[bridge]
        while self.way[j] >= 0:
            ways.append(self.way[j])
            j = self.to[self.way[j]]
        flow = min(min(self.cap[e] for e in ways), self.rest[i], -self.rest[j])
        self.rest[i] -= flow
        self.rest[j] += flow
        for e in ways:
            self.cap[e] -= flow
            self.cap[e ^ 1] += flow
            if self.cap[e] <= _TINY and e != bridge:
                x = self.to[e] if self.side[self.to[e]] > 0 else self.to[e ^ 1]
                self.way[x] = _ORPHAN
                orphans.append(x)
        for x in (i, j):
            if abs(self.rest[x]) <= _TINY:
                self.way[x] = _ORPHAN
                orphans.append(x)
        return orphans

    def _rooted(self, i: int) -> int:
        """The distance of a node to its root, or -1 if an orphan is on the way."""
        steps = 0
        while self.way[i] >= 0:
            i = self.to[self.way[i] ^ 1] if self.side[i] > 0 else self.to[self.way[i]]
            steps += 1
        return steps if self.way[i] == _END_NODE else -1

    def _adopt(self, orphans: list[int]) -> None:
        todo = deque(orphans)
        while todo:
            i = todo.popleft()
            s = self.side[i]
            best, parent = -1, _NONE
            for e in self.out[i]:
                j = self.to[e]
                if self.side[j] == s and self.cap[e ^ 1 if s > 0 else e] > _TINY:
                    d = self._rooted(j)
                    if d >= 0 and (best < 0 or d < best):
                        best, parent = d, e ^ 1 if s > 0 else e
                        if d == 0:
                            break
            if best >= 0:
                self.way[i] = parent
                continue
            for e in self.out[i]:
                j = self.to[e]
                if self.side[j] == s:
                    if self.cap[e ^ 1 if s > 0 else e] > _TINY:
                        self.active.append(j)
                    w = self.way[j]
                    if w >= 0 and (self.to[w ^ 1] if s > 0 else self.to[w]) == i:
                        self.way[j] = _ORPHAN
                        todo.append(j)
            self.side[i], self.way[i] = 0, _NONE


_TINY = 1e-9


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the cost of going against ``gain`` and of cutting edges.

    True for the source side.  A gain above 0 is a capacity from the source, one below 0 a capacity to the sink.
    """
    return _Flow(gain, edges).run()


SMOOTH = 1.0


def main_blocks(html: str, smooth: float = SMOOTH) -> list[str]:
    """Texts of the blocks on the content side, in page order."""
    blocks, nodes = parse(html)
    if not blocks:
        return []
    total = _summed(blocks, nodes)
    gain, edges, last, wrappers = [], [], {}, {}
    for k, b in enumerate(blocks):
        gain.append(score(b, total))
        parent = b.node.parent
        if k:
            edges.append((k - 1, k, smooth / (1 + _distance(blocks[k - 1].node, b.node))))
        if (j := last.get(id(parent))) is not None and j < k - 1:
            edges.append((j, k, smooth / 2))
        last[id(parent)] = k
        if b.node.wrapper is not None:
            edges.append((k, wrappers.setdefault(id(b.node.wrapper), len(blocks) + len(wrappers)), smooth))
    side = minimum_cut(gain + [-WRAPPER] * len(wrappers), edges)
    return [b.text for b, s in zip(blocks, side, strict=False) if s]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = ["\n".join(main_blocks(h)) if h else "" for h in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")

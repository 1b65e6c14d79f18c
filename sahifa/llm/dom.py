"""A lenient reading of HTML into blocks: a tree of block elements with runs of text as its leaves."""

from __future__ import annotations

import html as entities
import re

TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|</(?P<end>[A-Za-z][^\s/>]*)[^>]*(?:>|\Z)"""
    r"""|<(?P<tag>[A-Za-z][^\s/>]*)(?:(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+)>|(?P<odd>[^>]*)(?:>|\Z))|<[!?][^>]*(?:>|\Z)""",
    re.S,
)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr "
    "html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
UNSEEN = frozenset("audio canvas datalist head iframe math noembed noframes noscript object script style svg template textarea title video xmp".split())
#: Unseen elements whose content is not markup; the others may hold elements of their own kind.
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
#: Unseen elements that go on to the end of the page if nothing ends them; of others the start tag only goes.
ENDLESS = RAW - {"noscript"}
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
CLOSES_P = BLOCKS - frozenset("button option optgroup select".split())
#: An open element on the left is closed by one on the right, unless a bound comes first.
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"tbody", "thead", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
P_BOUND = frozenset("body button caption html table td th".split())


class Node:
    """A block element, or a run of text (``tag`` is ``#text``, ``text`` is its text with white space made single)."""

    __slots__ = ("attrs", "children", "depth", "link", "parent", "tag", "text")

    def __init__(self, tag: str, parent: Node | None, attrs: str = "", text: str = "", link: int = 0):
        self.tag, self.parent, self.attrs, self.text, self.link, self.children = tag, parent, attrs, text, link, []
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.children.append(self)


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(source)}


class Reader:
    """Builds the tree of one page; what is open is a stack of (tag, node), inline elements without a node."""

    def __init__(self, source: str):
        self.root = Node("#root", None)
        self.open: list[tuple[str, Node | None]] = []
        self.at, self.run, self.links, self.link_run = self.root, [], 0, 0
        self.unended: set[str] = set()
        self.read(source)
        self.flush()

    def flush(self) -> None:
        if self.run:
            text = " ".join(entities.unescape("".join(self.run)).split())
            if text:
                Node("#text", self.at, text=text, link=min(self.link_run, len(text)))
            self.run, self.link_run = [], 0

    def close_to(self, place: int) -> None:
        """Close what is open from ``place`` on."""
        for tag, node in reversed(self.open[place:]):
            if node is not None:
                self.flush()
                self.at = node.parent
            elif tag == "a":
                self.links -= 1
        del self.open[place:]

    def close_any(self, tags, bounds) -> None:
        """Close the outermost of ``tags`` that is open above the last of ``bounds``."""
        found = None
        for place in range(len(self.open) - 1, -1, -1):
            if self.open[place][0] in tags:
                found = place
            elif self.open[place][0] in bounds:
                break
        if found is not None:
            self.close_to(found)

    def start(self, tag: str, attrs: str) -> None:
        if tag in CLOSES_P:
            self.close_any({"p"}, P_BOUND)
        if tag in CLOSED_BY:
            self.close_any(*CLOSED_BY[tag])
        if tag in ("html", "body") and any(t == tag for t, _ in self.open):
            return
        if tag == "br":
            self.run.append(" ")
        elif tag == "hr":
            self.flush()
        elif tag in BLOCKS:
            self.flush()
            self.at = Node(tag, self.at, attrs)
            self.open.append((tag, self.at))
        elif tag not in VOID:
            self.links += tag == "a"
            self.open.append((tag, None))

    def end(self, tag: str) -> None:
        if tag in ("body", "html", "br"):
            return
        block = tag in BLOCKS
        for place in range(len(self.open) - 1, -1, -1):
            open_tag, node = self.open[place]
            if open_tag == tag:
                self.close_to(place)
                return
            if node is not None and (not block or open_tag in ("table", "body") and tag not in ("table", "div", "form", "article", "section", "main")):
                return

    def text(self, piece: str) -> None:
        self.run.append(piece)
        if self.links > 0:
            self.link_run += len(piece)

    def read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            m = TAG.search(source, at)
            if m is None:
                self.text(source[at:])
                return
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            if m["tag"]:
                tag, attrs = m["tag"].lower(), m["attrs"] if m["attrs"] is not None else m["odd"]
                if tag in UNSEEN and not attrs.endswith("/"):
                    at = self.past(source, tag, at)
                    self.run.append(" " if tag in ("textarea",) else "")
                else:
                    self.start(tag, attrs)
                    if attrs.endswith("/") and tag in ("svg", "path", "i", "span") and self.open and self.open[-1][0] == tag:
                        self.close_to(len(self.open) - 1)
            elif m["end"]:
                self.end(m["end"].lower())

    def open_head(self, source: str, at: int) -> int:
        """Where a head that nothing closes has ended: at the first text or start tag that no head has."""
        for _ in range(len(source)):
            m = TAG.search(source, at)
            stop = len(source) if m is None else m.start()
            if source[at:stop].strip():
                return at
            if m is None or m["tag"] and m["tag"].lower() not in IN_HEAD:
                return stop
            at = m.end()
            if m["tag"] and m["tag"].lower() in UNSEEN - {"head"}:
                at = self.past(source, m["tag"].lower(), at)
        return at

    def past(self, source: str, tag: str, at: int) -> int:
        """Where an unseen element that begins before ``at`` has ended."""
        if tag == "head":
            m = re.compile(r"</head\s*>|<body[\s>]", re.I).search(source, at)
            return self.open_head(source, at) if m is None else m.end() if m[0][1] == "/" else m.start()
        if tag in self.unended:
            return at
        pattern = re.compile(rf"</{re.escape(tag)}\s*>" if tag in RAW else rf"</{re.escape(tag)}\s*>|<{re.escape(tag)}[\s>]", re.I)
        depth, begin, ends = 1, at, 0
        while depth:
            m = pattern.search(source, at)
            if m is None:
                if tag in ENDLESS:
                    return len(source)
                if not ends:
                    self.unended.add(tag)
                return begin
            ends += m[0][1] == "/"
            at, depth = m.end(), depth + (1 if m[0][1] != "/" else -1)
        return at


def parse(source: str | None) -> Node:
    return Reader(source or "").root


def ordered(root: Node) -> list[Node]:
    """All nodes below the root, parents before children, in page order."""
    out, todo = [], list(reversed(root.children))
    while todo:
        node = todo.pop()
        out.append(node)
        todo += reversed(node.children)
    return out

"""Main text of web pages by boosted trees over DOM nodes.

Every block element and every run of text gets features: its own and its ancestors' tags and attribute words, depth,
place among its siblings and in the page, how much text its subtree has and how much of that is links, and the same
of its neighbours. Boosted trees give the log odds that it belongs to the article. The page's labels are then decoded
together, from the leaves up: a node can be article only below article nodes, and of all such labelings the one of
the greatest total score is taken, so a menu inside the article goes as a whole and a lone paragraph in a sidebar
can't stay. The text is that of the runs labelled article, in page order.

No page comes with labels, so the trees are fitted to pages made by ``training_page``: N_TRAINING of them from a fixed
seed, of many layouts, with attribute words that are sometimes missing, misleading or meaningless. Fitting takes a
few seconds on the driver, once; the model is some thousand numbers and is sent to the workers.

Defined cases: a null or empty page has an empty text; so has one without an article; pages that repeat give the
same text; markup that doesn't nest is read leniently, and none is dropped for its length. Only the columns named as
parameters are read, so further columns may have any names.
"""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sahifa.llm.arrow import field, map_slices
from sahifa.llm.boosting import BoostedTrees
from sahifa.llm.dom import HEADINGS, Node, attributes, ordered, parse

SEED, N_TRAINING = 20240601, 700
TAG_GROUPS = (
    {"#text"}, {"p"}, HEADINGS, {"li", "dd", "dt"}, {"ul", "ol", "dl", "menu", "dir"}, {"div", "section", "center"}, {"article", "main"}, {"nav"}, {"header", "hgroup"}, {"footer"},
    {"aside"}, {"form", "fieldset", "button", "select", "option", "legend", "search"}, {"table", "tr", "td", "th", "tbody"}, {"blockquote", "pre", "figure", "figcaption"}, {"dialog", "details"},
)
ATTR_GROUPS = (
    r"nav|menu|breadcrumb|pagination|pager|toc|tabs?|skip|navbar|crumbs?",
    r"header|masthead|topbar|brand|logo|toolbar",
    r"footer|foot|copyright|legal|colophon|bottom",
    r"sidebar|aside|side|widget|rail|related|recommend\w*|popular|trending|more",
    r"ad|ads|advert\w*|sponsor\w*|promo\w*|banner|dfp|outbrain|taboola|adsense|adbox",
    r"cookie|consent|gdpr|notice|alert|popup|modal|overlay|message|disclaimer|notification",
    r"comments?|disqus|respond|reply|replies|discussion|thread|reviews?",
    r"form|search|login|subscribe|signup|newsletter|share|social|follow|buttons?|rating",
    r"content|article|entry|post|story|main|body|text|prose|page|copy",
    r"meta|byline|author|date|tags?|caption|info|avatar|bio",
)
ATTR_PATTERNS = [re.compile(rf"(?:^|[\s_\-])(?:{g})(?=$|[\s_\-\d])", re.I) for g in ATTR_GROUPS]
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SAID = re.compile(r"(?i)\b(?:comments?|cookies?|advertisement|sponsored|newsletter|subscribe|copyright|all rights reserved|related|share this|follow us|sign up|log in|read more|privacy|terms)\b|©")
HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
LANDMARKS = tuple(TAG_GROUPS[i] for i in (6, 7, 8, 9, 10, 11))


def own_words(node: Node) -> tuple[float, ...]:
    """Which groups of attribute words a node has, and whether it is hidden."""
    if not node.attrs:
        return (0.0,) * (len(ATTR_PATTERNS) + 1)
    named = attributes(node.attrs)
    words = CAMEL.sub("-", " ".join(named.get(k, "") for k in ("class", "id", "role", "itemprop", "aria-label")))
    hidden = "hidden" in named or named.get("aria-hidden") == "true" or HIDDEN.search(named.get("style", ""))
    return (*(float(bool(p.search(words))) for p in ATTR_PATTERNS), float(bool(hidden)))


def features(root: Node) -> tuple[list[Node], np.ndarray]:
    """The nodes below the root in page order, and a row of features for each."""
    nodes = ordered(root)
    n = len(nodes)
    if not n:
        return nodes, np.zeros((0, 0))
    place = {id(node): i for i, node in enumerate(nodes)}
    parent = np.array([place.get(id(node.parent), -1) for node in nodes])
    chars, links, runs, ends = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    elements, paragraphs, headings, said = np.ones(n), np.zeros(n), np.zeros(n), np.zeros(n)
    start, before = np.zeros(n), 0.0
    for i, node in enumerate(nodes):
        start[i] = before
        if node.tag == "#text":
            text = node.text
            chars[i], links[i], runs[i], ends[i] = len(text), node.link, 1, text[-1] in ".!?…\"'”»"
            said[i] = len(text) < 200 and SAID.search(text) is not None
            before += len(text)
        paragraphs[i], headings[i] = node.tag == "p", node.tag in HEADINGS
    for i in range(n - 1, -1, -1):
        if parent[i] >= 0:
            for of in (chars, links, runs, ends, elements, paragraphs, headings, said):
                of[parent[i]] += of[i]
    total = max(1.0, before)
    words = np.array([own_words(node) for node in nodes])
    above = np.zeros_like(words)
    marks = np.array([[float(node.tag in tags) for tags in LANDMARKS] for node in nodes])
    marks_above = np.zeros_like(marks)
    for i in range(n):
        if parent[i] >= 0:
            above[i] = np.maximum(above[parent[i]], words[parent[i]])
            marks_above[i] = np.maximum(marks_above[parent[i]], marks[parent[i]])
    tags = np.array([[float(node.tag in group) for group in TAG_GROUPS] for node in nodes])
    siblings = [node.parent.children for node in nodes]
    index = np.zeros(n)
    for node in [root, *nodes]:
        for k, child in enumerate(node.children):
            index[place[id(child)]] = k
    count = np.array([len(s) for s in siblings], float)
    link_share = links / np.maximum(chars, 1)
    neighbour = np.zeros((n, 4))
    same = np.zeros(n)
    for i, node in enumerate(nodes):
        k, around = int(index[i]), siblings[i]
        for side, j in ((0, k - 1), (2, k + 1)):
            if 0 <= j < len(around):
                other = place[id(around[j])]
                neighbour[i, side], neighbour[i, side + 1] = np.log1p(chars[other]), link_share[other]
            else:
                neighbour[i, side] = -1
    kinds: dict[tuple[int, str], int] = {}
    for i, node in enumerate(nodes):
        kinds[id(node.parent), node.tag] = kinds.get((id(node.parent), node.tag), 0) + 1
    for i, node in enumerate(nodes):
        same[i] = kinds[id(node.parent), node.tag]
    parent_chars = np.where(parent >= 0, chars[parent], before)
    numbers = [
        np.array([node.depth for node in nodes], float), index / np.maximum(count - 1, 1), np.log1p(count), same / count, np.log1p(chars), link_share, chars / total,
        chars / np.maximum(parent_chars, 1), np.log1p(elements), chars / elements, np.log1p(paragraphs), np.log1p(headings), ends / np.maximum(runs, 1), np.log1p(runs), chars / np.maximum(runs, 1),
        start / total, (start + chars) / total, said, said / np.maximum(runs, 1),
    ]
    return nodes, np.concatenate([np.stack(numbers, axis=1), tags, words, above, marks_above, neighbour], axis=1)


def decode(nodes: list[Node], log_odds: np.ndarray) -> np.ndarray:
    """The labeling of greatest total log odds in which article nodes have article parents only."""
    n = len(nodes)
    place = {id(node): i for i, node in enumerate(nodes)}
    best = log_odds.astype(float).copy()  # of the subtree, if its top is article; not article gives 0
    for i in range(n - 1, -1, -1):
        p = place.get(id(nodes[i].parent))
        if p is not None:
            best[p] += max(0.0, best[i])
    chosen = np.zeros(n, bool)
    for i in range(n):
        p = place.get(id(nodes[i].parent))
        chosen[i] = best[i] > 0 and (p is None or chosen[p])
    return chosen


def main_texts(pages: list[str | None], model: BoostedTrees) -> list[str]:
    """The main text of each page; scores are taken for all pages at once."""
    read = [features(parse(page)) for page in pages]
    filled = [f for nodes, f in read if nodes]
    scores = model.log_odds(np.concatenate(filled)) if filled else np.zeros(0)
    out, at = [], 0
    for nodes, _ in read:
        chosen = decode(nodes, scores[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n\n".join(node.text for node, on in zip(nodes, chosen, strict=True) if on and node.tag == "#text"))
    return out


class PageMaker:
    """Makes pages whose article is known. What is article stands between the marks ARTICLE and END in the source."""

    ARTICLE, END = "\x01", "\x02"

    def __init__(self, rng: random.Random):
        self.rng = rng
        self.syllables = ["".join(rng.choice("bcdfghklmnprstvz") * (rng.random() < 0.8) + rng.choice("aeiouéöü") + rng.choice("nrslt") * (rng.random() < 0.4) for _ in range(1)) for _ in range(60)]
        self.decorated = rng.random() < 0.12
        self.named = rng.random()

    def word(self) -> str:
        word = "".join(self.rng.choices(self.syllables, k=self.rng.choice((1, 1, 2, 2, 3))))
        return word + self.rng.choice(("###", "***", "&amp;&amp;", "%%%", "!!")) if self.decorated else word

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def sentence(self) -> str:
        return self.words(1, 18).capitalize() + self.rng.choice("....!?")

    def prose(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(low, high)))

    def cls(self, *names: str, always: bool = False) -> str:
        """An attribute with one of the names, or none, or a meaningless one."""
        draw = self.rng.random()
        if not always and draw > self.named:
            return "" if draw < 0.85 else f' class="{self.rng.choice("abcdefgh")}{self.rng.randint(1, 99)}"'
        name = self.rng.choice(names)
        return f' {self.rng.choice(("class", "class", "id"))}="{self.rng.choice(("", "site-", "block ", "c-"))}{name}{self.rng.choice(("", "", "-1", " wide"))}"'

    def link(self) -> str:
        return f'<a href="/{self.rng.randint(1, 9999)}">{self.words(1, 3)}</a>'

    def links(self, low: int = 3, high: int = 9) -> str:
        items = [self.link() for _ in range(self.rng.randint(low, high))]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if self.rng.random() < 0.7 else self.rng.choice((" | ", " ", " &middot; ")).join(items)

    def paragraph(self) -> str:
        r, text = self.rng.random(), self.prose()
        if r < 0.12:
            text = f"<b>{text}" if r < 0.06 else f"<b>{text}</b>"
        elif r < 0.25:
            text = f"{text} {self.link()} {self.sentence()}"
        elif r < 0.3:
            text = text.replace(". ", ".<br>", 1) + "<br>"
        return f"<p>{text}" + ("</p>" if self.rng.random() < 0.85 else "")

    def article_body(self) -> str:
        parts = [f"<h1>{self.words(2, 9).capitalize()}</h1>"] if self.rng.random() < 0.85 else []
        for _ in range(self.rng.choice((1, 1, 2, 3, 4, 6, 9, 14))):
            r = self.rng.random()
            if r < 0.72:
                parts.append(self.paragraph())
            elif r < 0.8:
                parts.append(f"<h{(k := self.rng.choice('234'))}>{self.words(1, 6)}</h{k}>" + self.paragraph())
            elif r < 0.87:
                tag = self.rng.choice(("ul", "ol"))
                parts.append(f"<{tag}>" + "".join(f"<li>{self.prose(1, 2)}</li>" for _ in range(self.rng.randint(2, 6))) + f"</{tag}>")
            elif r < 0.91:
                parts.append(f"<blockquote>{self.paragraph()}</blockquote>")
            elif r < 0.94:
                rows = "".join("<tr>" + "".join(f"<td>{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.rng.randint(2, 5)))
                parts.append(f"<table>{rows}</table>")
            elif r < 0.97:
                parts.append(f"<figure><img src='x.png'><figcaption>{self.sentence()}</figcaption></figure>")
            else:
                parts.append(f"<div>{self.prose()}</div>")
            if self.rng.random() < 0.08:
                parts.append(self.END + self.inserted() + self.ARTICLE)
        return self.ARTICLE + "".join(parts) + self.END

    def inserted(self) -> str:
        """What stands inside articles without being of them."""
        return self.rng.choice(
            (
                lambda: f"<div{self.cls('ad', 'advert', 'promo', 'ad-slot', always=True)}>{self.prose(1, 3)}</div>",
                lambda: f"<div{self.cls('share', 'social-buttons', 'share-bar', always=True)}>{self.links(2, 5)}</div>",
                lambda: f"<aside>{self.prose(1, 2)}{self.links(2, 4)}</aside>",
                lambda: f"<div{self.cls('related', 'related-posts', 'more', always=True)}><h3>{self.rng.choice(('Related', 'Read more', self.words(1, 2)))}</h3>{self.links(2, 5)}</div>",
                lambda: f"<form{self.cls('newsletter', 'subscribe')}><label>{self.words(2, 6)}</label><input><button>{self.words(1, 2)}</button></form>",
                lambda: f"<nav{self.cls('toc')}>{self.links(3, 6)}</nav>",
            )
        )()

    def comments(self) -> str:
        one = lambda: f"<div{self.cls('comment', 'reply', 'comment-body')}>" + (f"<b>{self.words(1, 2)}</b> " if self.rng.random() < 0.6 else "") + f"<p>{self.prose(1, 4)}</p></div>"
        title = f"<h3>{self.rng.choice(('Comments', '3 comments', 'Discussion', self.words(1, 2)))}</h3>" if self.rng.random() < 0.8 else ""
        tag = self.rng.choice(("div", "section", "div"))
        return f"<{tag}{self.cls('comments', 'comment-list', 'disqus', 'discussion', 'responses', 'reader-comments', always=True)}>{title}" + "".join(one() for _ in range(self.rng.randint(1, 6))) + f"</{tag}>"

    def sidebar(self) -> str:
        tag = self.rng.choice(("aside", "aside", "div"))
        boxes = [
            f"<div{self.cls('widget', 'box')}><h4>{self.words(1, 3)}</h4>{self.links(3, 7) if self.rng.random() < 0.6 else '<p>' + self.prose(1, 3) + '</p>'}</div>" for _ in range(self.rng.randint(1, 4))
        ]
        return f"<{tag}{self.cls('sidebar', 'side', 'right-rail', 'widgets', always=tag == 'div')}>{''.join(boxes)}</{tag}>"

    def notice(self) -> str:
        tag = self.rng.choice(("div", "div", "section", "dialog"))
        said = self.rng.choice(("We use cookies. ", "", "By using this site you accept our privacy policy. ", ""))
        button = f"<button>{self.words(1, 2)}</button>" if self.rng.random() < 0.6 else ""
        return f"<{tag}{self.cls('cookie-notice', 'consent', 'notice', 'alert', 'gdpr-banner', 'popup', always=True)}><p>{said}{self.prose(1, 3)}</p>{button}</{tag}>"

    def advert(self) -> str:
        return f"<!-- ad --><div{self.cls('ad', 'ads', 'advert', 'banner', 'sponsored', 'promo', 'ad-box', always=True)}>{self.prose(1, 4)}</div>"

    def header(self) -> str:
        inner = f"<div{self.cls('logo', 'brand')}>{self.words(1, 3)}</div>" + (f"<p>{self.words(2, 8)}</p>" if self.rng.random() < 0.4 else "")
        inner += f"<nav>{self.links()}</nav>" if self.rng.random() < 0.5 else ""
        tag = self.rng.choice(("header", "header", "div"))
        return f"<{tag}{self.cls('header', 'masthead', 'top-bar', always=tag == 'div')}>{inner}</{tag}>"

    def menu(self) -> str:
        tag = self.rng.choice(("nav", "nav", "div", "ul"))
        body = self.links(3, 12)
        return f"<{tag}{self.cls('nav', 'menu', 'navbar', 'breadcrumb', always=tag == 'div')}>{body}</{tag}>"

    def footer(self) -> str:
        tag = self.rng.choice(("footer", "footer", "footer", "div"))
        parts = [self.rng.choice(("&copy; ", "Copyright ", "")) + self.words(1, 3) + self.rng.choice((" &middot; ", ". ", " ")) + self.prose(0, 3)]
        if self.rng.random() < 0.5:
            parts.append(self.links(2, 8))
        return f"<{tag}{self.cls('footer', 'site-footer', 'legal', 'copyright', always=tag == 'div')}>{''.join(f'<p>{p}</p>' if self.rng.random() < 0.5 else p for p in parts)}</{tag}>"

    def form(self) -> str:
        return f"<form{self.cls('search', 'login', 'newsletter', 'contact')}><label>{self.words(1, 6)}</label><input name='q'><select><option>{self.words(1, 2)}</option></select><button>{self.words(1, 2)}</button>" + (f"<p>{self.prose(1, 2)}</p>" if self.rng.random() < 0.4 else "") + "</form>"

    def page(self) -> str:
        rng, article = self.rng, self.article_body()
        tag = rng.choice(("article", "article", "article", "main", "div", "div", "section", "td"))
        byline = f"<div{self.cls('byline', 'meta', 'post-meta')}>{self.words(1, 4)}</div>" if rng.random() < 0.1 else ""
        article = article.replace(self.ARTICLE, self.ARTICLE, 1)
        core = f"<{tag}{self.cls('content', 'article', 'post', 'entry-content', 'story', 'main', always=tag == 'div' and rng.random() < 0.7)}>{byline}{article}" + (self.inserted() if rng.random() < 0.15 else "") + f"</{tag}>"
        if tag == "td":
            core = f"<table><tr><td>{self.links()}</td>{core}</tr></table>"
        extras = [f() for f, p in ((self.comments, 0.3), (self.sidebar, 0.3), (self.advert, 0.25), (self.form, 0.2)) if rng.random() < p]
        first = [f() for f, p in ((self.notice, 0.25), (self.header, 0.45), (self.menu, 0.65), (self.advert, 0.45), (self.form, 0.1), (self.sidebar, 0.1)) if rng.random() < p]
        last = [f() for f, p in ((self.footer, 0.85), (self.notice, 0.1), (self.menu, 0.1)) if rng.random() < p]
        if rng.random() < 0.3:
            core = f"<div{self.cls('wrapper', 'container', 'page', 'row')}>{core}{''.join(extras)}</div>"
        elif rng.random() < 0.25:
            core = f"<main>{core}{''.join(extras)}</main>"
        else:
            core += "".join(extras)
        if rng.random() < 0.03:
            core = ""
        body = "".join(first) + core + "".join(last)
        if rng.random() < 0.2:
            body = f"<div{self.cls('page', 'wrap', 'site')}>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


def training_page(rng: random.Random) -> tuple[list[Node], np.ndarray, np.ndarray]:
    """A made page: nodes, features, and whether each node holds article text."""
    source = PageMaker(rng).page()
    # The marks become text runs' first and last characters; they are taken out of the tree before features are.
    root = parse(source)
    inside, leaf = False, {}
    for node in ordered(root):
        if node.tag == "#text":
            kept = ""
            article = 0
            for piece in re.split("([\x01\x02])", node.text):
                if piece == PageMaker.ARTICLE:
                    inside = True
                elif piece == PageMaker.END:
                    inside = False
                else:
                    article += len(piece) * inside
                    kept += piece
            node.text = kept.strip()
            leaf[id(node)] = bool(article) and article * 2 >= len(node.text)
    drop_empty(root)
    nodes, x = features(root)
    label = {id(node): leaf.get(id(node), False) for node in nodes}
    for node in reversed(nodes):
        if label[id(node)] and node.parent is not root:
            label[id(node.parent)] = True
    return nodes, x, np.array([label[id(node)] for node in nodes], bool)


def drop_empty(root: Node) -> None:
    for node in reversed(ordered(root)):
        if node.tag == "#text" and not node.text:
            node.parent.children.remove(node)


@cache
def trained(n_pages: int = N_TRAINING, seed: int = SEED) -> BoostedTrees:
    """The model fitted to ``n_pages`` made pages; each run of text weighs double, as the text is what counts."""
    rng = random.Random(seed)
    made = [training_page(rng) for _ in range(n_pages)]
    x, y = np.concatenate([m[1] for m in made if m[0]]), np.concatenate([m[2] for m in made if m[0]])
    weight = np.concatenate([[1.0 + (node.tag == "#text") for node in m[0]] for m in made if m[0]])
    return BoostedTrees().fit(x, y.astype(float), weight)


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ("url",), model: BoostedTrees | None = None) -> DataFrame:
    """One row per input row: identifier, ``carry``, ``text`` and ``n_chars``."""
    spread = df.sparkSession.sparkContext.broadcast(model or trained())
    schema = T.StructType([field(df, id_col), *(field(df, c) for c in carry), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    names = [id_col, *carry]

    def run(batch):
        texts = main_texts(batch.column(len(names)).to_pylist(), spread.value)
        return {n: batch.column(i) for i, n in enumerate(names)} | {"text": texts, "n_chars": [len(t) for t in texts]}

    return map_slices(df.select(*names, html_col), run, schema)

"""Main-text extraction by minimum-cut labelling of a page's blocks.

A page is cut into blocks of text at block-level tags. A small classifier (logistic regression, trained
from ``TRAINING``) turns each block's tags, class names, links and length into log-odds; those are the
capacities to the two terminals. Neighbouring blocks, and blocks that follow one another in the same
container, are tied by smoothness edges. The minimum cut, found by max-flow, separates content from
boilerplate. Scripts, styles, the head and comments in markup are no text at all.

Rows: a null or empty html has an empty text. Repeated rows give equal texts. Unclosed and stray tags are
taken as browsers do: a block tag ends the running block, an end tag closes up to its partner. Other
columns are not read.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from terravane.llm import logistic
from terravane.runtime import ship

#: Up to </head>; if that is missing, to the first tag or text that does not stand in a head.
_HEAD = (
    r"<(?P<head>head)\b[^>]*>(?:(?:(?!<(?:body|head)\b).)*?</head\s*>|"
    r"(?:\s|<!--.*?(?:-->|\Z)|<(?P<own>script|style|noscript|template|title)\b[^>]*>.*?(?:</(?P=own)\s*>|\Z)|"
    r"<(?:meta|link|base)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<![^>]*>)*+)|"
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|select|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|" + _HEAD +
    r"</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<[!?][^>]*>",
    re.S | re.I,
)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
_HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "img br input".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HELD = ("nav", "header", "footer", "aside", "form", "menu", "article", "main", "dialog")
_SINGLE = frozenset("li h1 h2 h3 h4 h5 h6 td tr dt dd option".split())
_FENCE = frozenset(("ul", "ol", "table", "div", "section", "blockquote", *_HELD))
_HINTS = {
    "ad": re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner)(?:$|[\s_-])"),
    "notice": re.compile(r"cookie|consent|notice|alert|popup|modal|newsletter|subscribe|gdpr"),
    "comment": re.compile(r"comment|reply|replies|discuss|disqus|respond"),
    "side": re.compile(r"side-?bar|widget|related|share|social|recommend|popular|teaser"),
    "menu": re.compile(r"menu|(?:^|[\s_-])nav|breadcrumb|toolbar|pagination|pager|tags?(?:$|[\s_-])|navigation"),
    "foot": re.compile(r"foot|copyright|legal|imprint"),
    "body": re.compile(r"content|article|post(?:$|[\s_-])|entry|story|body"),
}
_OWN = ("p", "h1", "h2", "h3", "li", "td", "blockquote", "pre", "button", "label")
FEATURES = [*(f"in:{t}" for t in _HELD), *(f"hint:{t}" for t in _HINTS), *(f"own:{t}" for t in _OWN), "links", "len:0", "len:1", "len:2", "len:3", "stop", "sign", "head:article"]
_AT = {f: i for i, f in enumerate(FEATURES)}


@dataclass
class Block:
    text: str
    features: list[int]
    box: int  # the container it stands in


@dataclass
class _Open:
    """An open tag; own and box are those of the nearest such tag up to here, fence is the place of the nearest fence."""

    name: str
    features: frozenset = frozenset()
    box: int = 0
    own: str = ""
    fence: int = -1


class _Stack:
    """The open tags, with the places of each name, so that no search walks the stack."""

    def __init__(self):
        self.tags = [_Open("")]
        self.places: dict[str, list[int]] = {}

    def push(self, tag: _Open):
        self.places.setdefault(tag.name, []).append(len(self.tags))
        if tag.name in _FENCE:
            tag.fence = len(self.tags)
        self.tags.append(tag)

    def last(self, name: str) -> int:
        """The innermost open tag of that name, -1 if there is none."""
        found = self.places.get(name)
        return found[-1] if found else -1

    def cut(self, place: int):
        while len(self.tags) > place:
            self.places[self.tags.pop().name].pop()


@dataclass
class _Run:
    parts: list = field(default_factory=list)
    linked: int = 0
    size: int = 0


def blocks(page: str) -> list[Block]:
    """The page's non-empty blocks in order."""
    out: list[Block] = []
    stack, boxes, run, links = _Stack(), 0, _Run(), 0

    def end():
        nonlocal run
        if run.parts:
            text = " ".join(_html.unescape("".join(run.parts)).split())
            if text:
                top = stack.tags[-1]
                f = set(top.features)
                if top.own:
                    f.add(_AT[f"own:{top.own}"])
                if run.size and 2 * run.linked > run.size:
                    f.add(_AT["links"])
                n = len(text)
                f.add(_AT[f"len:{0 if n < 25 else 1 if n < 80 else 2 if n < 300 else 3}"])
                if text[-1] in ".!?…\"'”»":
                    f.add(_AT["stop"])
                if "©" in text:
                    f.add(_AT["sign"])
                out.append(Block(text, sorted(f), top.box))
            run = _Run()

    def say(s: str):
        if s:
            run.parts.append(s)
            n = len(s.strip())
            run.size += n
            if links:
                run.linked += n

    at = 0
    for m in _TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        tag = m[0]
        name = _NAME.match(tag)
        if not name or m[1] or m["head"]:
            if m["head"]:
                end()
            continue
        name = name[1].lower()
        closing = tag[1] == "/"
        if name in _INLINE:
            if name == "a":
                links = max(0, links + (-1 if closing else 1))
            elif name == "br":
                run.parts.append("\n")
            continue
        end()
        links = 0
        if closing:
            k = stack.last(name)
            if k > 0:
                stack.cut(k)
            continue
        if name in _VOID or tag.endswith("/>"):
            continue
        if stack.tags[-1].name == "p":  # a block tag closes an open paragraph
            stack.cut(len(stack.tags) - 1)
        if name in _SINGLE:
            # an open one of the same kind ends here, unless a list or table stands between
            k = stack.last(name)
            if k > stack.tags[-1].fence:
                stack.cut(k)
        top = stack.tags[-1]
        f, box, own = top.features, top.box, top.own
        if name in _HELD:
            inside = _AT["in:article"] in f or _AT["in:main"] in f
            f = f | {_AT["head:article" if name == "header" and inside else f"in:{name}"]}
        hints = " ".join(a or b or c for a, b, c in _HINT.findall(tag)).lower()
        if hints:
            f = f | {_AT[f"hint:{k}"] for k, p in _HINTS.items() if p.search(hints)}
        if name in _OWN:
            own = name
        else:
            boxes += 1
            box = boxes
        stack.push(_Open(name, f, box, own, top.fence))
    say(page[at:])
    end()
    return out


# Labelled pages: a block whose text starts with + is content, with - is boilerplate.
_LONG = "the river turned grey in the morning and the people of the village came down to look at it, as they had done every year. " * 3
_MID = "a short paragraph tells what happened next in the town."
TRAINING = [
    f"<body><nav><ul><li><a href=x>-home</a></li><li><a href=x>-about us</a></li></ul></nav><div class='ad'>-buy now and save on everything you like.</div>"
    f"<article><h1>+The river</h1><p>+{_LONG}</p><p>+{_MID}</p><p>+yes.</p><p>+three words here</p></article><footer>-&copy; 2020 site. {_MID}</footer></body>",
    f"<body><header><div class='menu'><a href=x>-start</a> <a href=x>news</a></div><p>-the best site in town.</p></header><main><h1>+A title of an article</h1><h2>+part one</h2><p>+{_MID}</p>"
    f"<div class='advert'><p>-sponsored: {_MID}</p></div><p>+{_LONG}</p><ul><li>+one thing</li><li>+another thing, too.</li></ul></main><aside><p>-{_MID}</p><a href=x>-more stories</a></aside><footer><p>-all rights reserved</p></footer></body>",
    f"<div id='cookie-notice'>-We use cookies. {_MID}</div><div class='content'><h1>+Headline of the day</h1><p>+{_LONG}</p><blockquote>+{_MID}</blockquote><p>+{_MID}</p></div>"
    f"<div class='sidebar'><h3>-popular</h3><p>-{_MID}</p><ul><li><a href=x>-first link</a></li></ul></div><div id='comments'><h3>-2 comments</h3><p>-I liked this a lot. {_MID}</p><p>-{_LONG}</p></div>",
    f"<article><header><h1>+Story title</h1><p>+by a writer</p></header><p>+{_LONG}</p><form><label>-your name</label><button>-send</button><p>-sign up for our letter today.</p></form><p>+{_MID}</p>"
    f"<section class='comments'><p>-great text. {_MID}</p><p>-{_LONG}</p></section><div class='related'><a href=x>-read this too</a></div></article>",
    f"<article><h1>+x</h1><p>+ok</p><p>+{_MID}</p><td>+cell</td><pre>+code line</pre></article><div class='newsletter'><p>-subscribe now. {_LONG}</p></div><footer>-&copy; me &middot; {_LONG}</footer>",
    f"<div><p>+{_LONG}</p><p>+{_MID}</p><p>+{_LONG}</p></div><div class='share'><a href=x>-share</a></div><div class='footer'><p>-{_MID}</p></div>",
    f"<article><h1>+A</h1><p>+{_MID}</p><aside><p>-{_LONG}</p></aside><nav><a href=x>-next page</a></nav><div class='promo'>-{_LONG}</div><footer><p>-posted by someone</p></footer></article>",
    f"<article><p>+{_MID}</p><form><p>-your name</p><p>-{_LONG}</p></form><p>+{_MID}</p><div class='cookie-banner'><p>-accept all</p></div><p>+short one</p><nav><p>-{_MID}</p></nav><div class='reply'><p>-{_MID}</p><p>-me too</p></div><p>+{_MID}</p></article>",
    f"<main><p>+{_MID}</p><aside><p>-also read</p></aside><footer><p>-tags and more</p></footer><p>+{_LONG}</p><header><p>+by a writer</p></header><div class='widget'><p>-{_MID}</p></div></main>",
    f"<main><p>+{_LONG}</p><p>+two words</p><div class='alert'><p>-{_LONG}</p></div></main><dialog><p>-{_MID}</p></dialog><menu><li>-{_MID}</li></menu>",
]


@lru_cache(maxsize=1)
def model() -> tuple[list[float], float]:
    rows, labels = [], []
    for page in TRAINING:
        for b in blocks(page):
            rows.append(b.features)
            labels.append(int(b.text[0] == "+"))
    weights, bias = logistic.fit(rows, labels, len(FEATURES), l2=0.02, rounds=3000, rate=0.3)
    return weights.tolist(), bias


def min_cut(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels of least cost: a node costs abs(gain) on its unlikely side, an edge its capacity if cut.

    Max-flow from nodes with surplus to nodes with deficit by level graphs (Dinitz): each phase finds all
    nodes' distances from any surplus at once and pushes flow along shortest paths until none is left. True
    is the source side, that is, what cannot be cut off more cheaply.
    """
    n = len(gain)
    left = list(gain)
    to, cap, out = [], [], [[] for _ in range(n)]  # edge e and its reverse e ^ 1
    for a, b, c in edges:
        out[a].append(len(to))
        to.append(b)
        out[b].append(len(to))
        to.append(a)
        cap += [c, c]

    def levels() -> tuple[list[int], list[int], bool]:
        level, queue, met = [-1] * n, [i for i in range(n) if left[i] > 0], False
        for i in queue:
            level[i] = 0
        sources = list(queue)
        while queue and not met:
            ahead = []
            for v in queue:
                for e in out[v]:
                    w = to[e]
                    if cap[e] and level[w] < 0:
                        level[w] = level[v] + 1
                        met = met or left[w] < 0
                        ahead.append(w)
            queue = ahead
        return level, sources, met

    while True:
        level, sources, met = levels()
        if not met:
            return [x >= 0 for x in level]
        at = [0] * n
        for s in sources:
            path, v = [], s
            while left[s] > 0:
                if left[v] < 0:
                    push = min(left[s], -left[v], *(cap[e] for e in path))
                    for e in path:
                        cap[e] -= push
                        cap[e ^ 1] += push
                    left[s] -= push
                    left[v] += push
                    path, v = [], s
                    continue
                own, e = out[v], -1
                while at[v] < len(own):
                    e = own[at[v]]
                    if cap[e] and level[to[e]] == level[v] + 1:
                        break
                    at[v] += 1
                if at[v] < len(own):
                    path.append(e)
                    v = to[e]
                elif path:  # a dead end: step back past the edge that led here
                    v = to[path.pop() ^ 1]
                    at[v] += 1
                else:
                    break


def labels(page: list[Block], near: int = 30, same_box: int = 30) -> list[bool]:
    """Whether each block is content. Capacities are hundredths of log-odds."""
    weights, bias = model()
    gain = [int(100 * max(-9.0, min(9.0, bias + sum(weights[f] for f in b.features)))) or -1 for b in page]
    edges, last = [], {}
    for i, b in enumerate(page):
        if i:
            edges.append((i - 1, i, near))
        if b.box in last:
            edges.append((last[b.box], i, same_box))
        last[b.box] = i
    return min_cut(gain, edges)


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, keep in zip(found, labels(found)) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    ship(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")

"""Main-text extraction by minimum-cut labelling of a page's blocks.

A page is cut into text blocks. A logistic classifier over each block's text (length, links, punctuation, place) and markup (the
elements, roles and names around it) gives its log-odds of being content: the capacity of its edge to source or sink. Neighbours in
the page, and blocks near in the document tree, are tied by smoothness edges, as strong as such neighbours were alike in training.
A maximum flow finds the cheapest labelling; blocks on the source's side are the main text.

Nodes whose own cost outweighs all their ties take their label first, which changes no minimum cut, and the flow runs over the
rest. The classifier starts from prior weights and is trained on the blocks of at most ``SAMPLE_PAGES`` pages whose elements say what
they are, once as they stand and once with the markup taken away, so that its text features hold where there is none.

Cases: a null, empty or unparsable page, or one without text, gives an empty text. Unclosed and misnested tags close where the
next fitting end tag or block begins; a tag with an unclosed quote ends at its next bracket, one without a bracket at the page's
end. Very long pages are read whole. Repeated rows are extracted one by one; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape
from math import log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that the classifier sees at most.
SAMPLE_PAGES = 400
#: Share of the log-ratio of like to unlike neighbours that their tie has.
SMOOTH = 0.25

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*+)(?:((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|([^>]*+)(?:>|\Z))",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/\"'<>]+)")
_RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "canvas", "audio", "video", "xmp", "noembed", "noframes"}
_SKIPPED = {"head", "select", "button", "datalist", "option"}
#: Elements within which others end on their own, and elements that the next one of their kind ends.
_ENCLOSING = {"ul", "ol", "dl", "table", "div", "section", "article", "body", "blockquote"}
_ENDED = {"li", "dt", "dd", "tr", "td", "th", "option"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr img input".split())
_AGAINST = {"nav", "footer", "aside", "form", "menu", "dialog", "header", "fieldset"}
_FOR = {"article", "main"}
_NAMES_AGAINST = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion sidebar comment comments reply replies disqus discussion share sharing social cookie cookies consent gdpr "
    "notice notices alert subscribe subscription newsletter signup login related recommended recommendation recommendations menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead popup modal overlay "
    "widget widgets toolbar copyright legal disclaimer tags skip".split()
)
_NAMES_FOR = set("article content post entry story main body text maincontent articlebody".split())
_ROLES = {"navigation": -1, "banner": -1, "contentinfo": -1, "complementary": -1, "search": -1, "dialog": -1, "alert": -1, "form": -1, "menu": -1, "main": 1, "article": 1}


class Block:
    """One run of text between block tags. marks: what its surroundings are (see ``MARKS``)."""

    __slots__ = ("text", "links", "marks", "parent", "section", "heading")

    def __init__(self, text: str, links: int, marks: tuple[int, ...], parent: int, section: int, heading: bool):
        self.text, self.links, self.marks, self.parent, self.section, self.heading = text, links, marks, parent, section, heading


#: What surrounds a block: an element or role of boilerplate, a name of it, an element or role of content, a name of it.
MARKS = ("against", "named_against", "for", "named_for")


def _marks(tag: str, attributes: str, inside: tuple[int, ...]) -> tuple[tuple[int, ...], bool]:
    """The marks within an element, and whether it is hidden. inside: the marks around it. A header within content is part of it,
    and an element of content is no boilerplate for its own name."""
    said = {}
    for m in _ATTRIBUTE.finditer(attributes):
        name = (m[1] or m[5] or "").lower()
        said.setdefault(name, m[2] or m[3] or m[4] or "")
    hidden = "hidden" in said or said.get("aria-hidden", "").lower() == "true" or "display:none" in re.sub(r"\s", "", said.get("style", "").lower())
    if tag in ("html", "body"):
        return inside, hidden
    names = {w for k in ("class", "id") for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", said.get(k, "")).lower()) if w}
    role = _ROLES.get(said.get("role", "").lower(), 0)
    against, named, content, called = inside
    within = (content or called) and not (against or named)
    if (tag in _AGAINST and not (tag == "header" and within)) or role < 0:
        against = 1
    elif names & _NAMES_AGAINST and tag not in _FOR and not (tag == "header" and within):
        named = 1
    elif tag in _FOR or role > 0:
        content = 1
    elif names & _NAMES_FOR:
        called = 1
    return (against, named, content, called), hidden


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order: markup, scripts, styles and hidden parts are gone, references decoded."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[int, ...], int, int, bool]] = [("", (0, 0, 0, 0), 0, 0, False)]  # tag, marks, element, section, dropped
    texts: list[str] = []
    links = in_link = serial = 0
    # How many of each tag are open, and how many since each enclosing block began: no start or end tag walks a stack in vain.
    opened: Counter[str] = Counter()
    scopes: list[Counter[str]] = [Counter()]

    def cut(k: int) -> None:
        for entry in reversed(stack[k:]):
            opened[entry[0]] -= 1
            if entry[0] in _ENCLOSING:
                scopes.pop()
            else:
                scopes[-1][entry[0]] -= 1
        del stack[k:]

    def close():
        nonlocal texts, links
        if texts:
            tag, marks, element, section, dropped = stack[-1]
            text = " ".join("".join(texts).split())
            if text and not dropped:
                parent = stack[-2][2] if tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "dd", "dt", "blockquote", "pre") and len(stack) > 1 else element
                found.append(Block(text, min(links, len(text)), marks, parent, section, tag in ("h1", "h2", "h3", "h4", "h5", "h6")))
            texts, links = [], 0

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        stop = m.start() if m else end
        if stop > at:
            text = unescape(html[at:stop])
            texts.append(text)
            if in_link:
                links += len(text.strip())
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, said = m[2].lower(), m[3] if m[3] is not None else m[4]
        if m[1]:
            if tag == "a":
                in_link = 0
            if tag in _INLINE:
                continue
            close()
            if opened[tag]:
                cut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
                in_link = 0
            continue
        if tag in _RAW:
            if tag in ("title", "svg", "math") or not said.rstrip().endswith("/"):
                over = re.compile(rf"</{re.escape(tag)}[^>]*>", re.IGNORECASE).search(html, at)
                at = over.end() if over else end
            if tag not in ("svg", "math"):
                close()
            continue
        if tag == "br":
            texts.append(" ")
            continue
        if tag in _INLINE:
            in_link = 1 if tag == "a" else in_link
            continue
        close()
        if tag in _VOID:
            continue
        if scopes[-1]["p"] or tag in _ENDED and scopes[-1][tag]:  # an element that this one ends
            cut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == "p" or stack[k][0] == tag and tag in _ENDED))
        if tag == "body" and opened["head"]:
            cut(next(k for k, x in enumerate(stack) if x[0] == "head"))
        _, inside, _, section, dropped = stack[-1]
        marks, hidden = _marks(tag, said, inside)
        serial += 1
        if marks != inside or tag in ("section", "article", "main", "aside", "nav", "header", "footer"):
            section = serial
        stack.append((tag, marks, serial, section, dropped or hidden or tag in _SKIPPED))
        opened[tag] += 1
        if tag in _ENCLOSING:
            scopes.append(Counter())
        else:
            scopes[-1][tag] += 1
    close()
    return found


def features(found: list[Block], markup: bool = True) -> np.ndarray:
    """What the classifier sees of each block: its text and place, and (with ``markup``) what surrounds it."""
    n = len(found)
    rows = []
    for i, b in enumerate(found):
        words = b.text.count(" ") + 1
        near = [found[j].text.count(" ") + 1 for j in (i - 1, i + 1) if 0 <= j < n]
        own = (1.0, log1p(words), min(b.links / len(b.text), 1.0), float(b.text[-1] in ".!?\"'”»…"), i / max(1, n - 1), log1p(sum(near) / max(1, len(near))), float("©" in b.text or "|" in b.text))
        rows.append((*own, *(b.marks if markup else (0,) * len(MARKS))))
    return np.array(rows, dtype=float).reshape(-1, 7 + len(MARKS))


#: The classifier's prior weights: longer, linkless, punctuated text is content; elements, roles and names say more than text.
PRIOR = (-2.0, 0.6, -3.0, 0.8, 0.0, 0.3, -1.0, -14.0, -14.0, 7.0, 7.0)
#: Ties of neighbours where no page is there to learn from: in the same element, in the same section, elsewhere.
DEFAULT_TIES = (1.5, 0.8, 0.0)


class Model:
    """Weights of the classifier, and the ties of its three kinds of neighbours."""

    __slots__ = ("weights", "ties")

    def __init__(self, weights: tuple[float, ...] = PRIOR, ties: tuple[float, ...] = DEFAULT_TIES):
        self.weights, self.ties = weights, ties

    def __reduce__(self):
        return Model, (self.weights, self.ties)


def told(b: Block) -> int:
    """What a block's markup says without doubt: 1 content, -1 boilerplate, 0 nothing."""
    return -1 if b.marks[0] or b.marks[1] else 1 if b.marks[2] or b.marks[3] else 0


def neighbours(found: list[Block]) -> list[tuple[int, int, int]]:
    """(i, j, kind): blocks that follow each other, and those of one element with others between them."""
    pairs, last = [], {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            pairs.append((i - 1, i, 0 if a.parent == b.parent else 1 if a.section == b.section else 2))
        if b.parent in last and last[b.parent] != i - 1:
            pairs.append((last[b.parent], i, 0))
        last[b.parent] = i
    return pairs


def train(pages: list[str], l2: float = 1e-3) -> Model:
    """A logistic regression, drawn to its prior, from the blocks whose markup says what they are; ties from their neighbours."""
    rows, target, like = [], [], [[0, 0] for _ in DEFAULT_TIES]
    for html in pages:
        found = blocks(html)
        says = [told(b) for b in found]
        if 1 not in says or -1 not in says:
            continue
        keep = [i for i, t in enumerate(says) if t]
        for markup in (True, False):
            rows.append(features(found, markup)[keep])
            target += [float(says[i] > 0) for i in keep]
        for i, j, kind in neighbours(found):
            if says[i] and says[j]:
                like[kind][says[i] == says[j]] += 1
    if not rows:
        return Model()
    x, y = np.concatenate(rows), np.array(target)
    prior = np.array(PRIOR)
    w = prior.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) / len(y) + l2 * (w - prior)
        bend = (x * (p * (1 - p))[:, None]).T @ x / len(y) + (l2 + 1e-6) * np.eye(x.shape[1])
        w = w - np.linalg.solve(bend, slope)
    return Model(tuple(float(v) for v in w), tuple(SMOOTH * max(0.0, log((same + 1) / (other + 1))) for other, same in like))


def min_cut(own: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling of least cost: own[i] is paid where node i is False if over 0, where it is True (negated) if under 0; a tie
    where its ends differ."""
    n = len(own)
    own = list(own)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in ties:
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(own[i]) >= sum(near[i].values()):
            label[i] = own[i] > 0
            for j, c in near[i].items():
                own[j] += c if label[i] else -c
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        source, sink = n, n + 1
        flow: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest}
        flow[source], flow[sink] = {}, {}
        for i in rest:
            if own[i] > 0:
                flow[source][i], flow[i][source] = own[i], 0.0
            else:
                flow[i][sink], flow[sink][i] = -own[i], 0.0
        while True:
            before, queue = {source: source}, deque([source])
            while queue and sink not in before:
                u = queue.popleft()
                for v, c in flow[u].items():
                    if c > 1e-9 and v not in before:
                        before[v] = u
                        queue.append(v)
            if sink not in before:
                break
            path, v = [], sink
            while v != source:
                path.append((before[v], v))
                v = before[v]
            push = min(flow[u][v] for u, v in path)
            for u, v in path:
                flow[u][v] -= push
                flow[v][u] = flow[v].get(u, 0.0) + push
        for i in rest:
            label[i] = i in before
    return [bool(x) for x in label]


def label(found: list[Block], model: Model, markup: bool = True) -> tuple[list[bool], list[float]]:
    """(content or not, log-odds) of each block of a page."""
    own = (features(found, markup) @ np.array(model.weights)).tolist()
    return min_cut(own, [(i, j, model.ties[kind]) for i, j, kind in neighbours(found) if model.ties[kind]]), own


def main_text(html: str, model: Model | None = None) -> str:
    """The content blocks of a page, joined by one space."""
    found = blocks(html)
    if not found:
        return ""
    return " ".join(b.text for b, keep in zip(found, label(found, model or Model())[0], strict=True) if keep)


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", sample: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of each row. ``sample`` bounds the pages (smallest hashes of id and page) the classifier sees."""
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    marked = rows.where("html is not null").select(F.xxhash64("page_id", "html").alias("h"), "html")
    # Only hashes are ordered; then the pages below the last one come, equal ones once.
    chosen = [r["h"] for r in marked.select("h").distinct().orderBy("h").limit(sample).collect()]
    seen = marked.where(F.col("h") <= F.lit(max(chosen))).dropDuplicates(["h"]).collect() if chosen else []
    model = train([r["html"] for r in sorted(seen, key=lambda r: r["h"])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "", model) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every row of ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))

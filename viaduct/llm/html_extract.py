"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaduct.llm.common import bounded

# Comments, declarations and tags as the HTML standard reads them: a quote opens a value only where a
# value begins, so a stray one ends with its word.  Possessive, so no input makes it backtrack.
_VALUE = r"""(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)"""
_MARKUP = re.compile(
    rf"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=?[^\s/>=]*+(?:\s*+=\s*+{_VALUE})?+(?<![\s/])|=)*+)(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>"'][^\s>]*+)))?+""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th"
    " blockquote pre figure figcaption address center details summary nav header footer aside form fieldset dialog hgroup"
    " head noscript template select button menu search option".split()
)
_DROPPED = frozenset("head script style title textarea xmp iframe noembed noframes noscript template nav footer aside form select button menu dialog svg math object embed canvas audio video search fieldset option input".split())
_CLOSES_P = _BLOCK - {"html", "body", "head", "option"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
# Words of class and id names that mark what is not the article.
_UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|sponsor\w*|promo\w*|banner\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar\w*|side-?bar|rail|footer\w*|masthead|site-?header|page-?header|topbar|top-?nav"
    r"|cookie\w*|consent|gdpr|notices?|notification\w*|alert|popup|modal|overlay|subscribe|subscription|newsletter|signup|sign-?up|login|paywall"
    r"|comments?|comment-?list|disqus|replies|respond|responses|discussion|share|sharing|social\w*|related|recommend\w*|read-?more|more-?stories|trending|popular|pagination|pager|widget\w*|skip-?link|toolbar|tags|byline-?share|search\w*|feedback|form)(?:$|[\s_-])",
    re.I,
)
# Words for what readers add, which may be longer than the article itself.
_READERS = re.compile(r"(?:^|[\s_-])(?:comments?|comment-?list|disqus|replies|respond|responses|discussion)(?:$|[\s_-])", re.I)
# Words that an article may well use for its own parts.  There they count only for what also
# looks like something else.
_SOFT = re.compile(r"(?:^|[\s_-])(?:notices?|alert|overlay|rail|replies|respond|responses|discussion|trending|popular|toolbar|tags|search\w*|feedback|form|widget\w*|recommend\w*)(?=$|[\s_-])", re.I)
_NOTICE = re.compile(r"(?:^|[\s_'\"=-])(?:notices?|alert|overlay)(?:$|[\s_'\"-])", re.I)
# Words for the parts of a reader's entry.
_VOICES = re.compile(r"(?:^|[\s_-])(?:comment\w*|repl(?:y|ies)|author\w*|user\w*|avatar|posted|timestamp|vote\w*)(?:$|[\s_-])", re.I)
# Beginnings of names that tell a state of the page, such as has-sidebar.
_STATES = ("has-", "with-", "no-", "without-", "is-", "hide-", "show-", "has_", "with_", "no_", "without_", "is_")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_BESIDE = frozenset("ul ol dl table blockquote pre figure".split())
_OWN_TEXT = frozenset("p pre h1 h2 h3 h4 h5 h6 li td dd dt blockquote figcaption".split())
_HEADINGS = frozenset(("h1", "h2", "h3"))
_SENTENCE = re.compile(r"[.!?…。！？][\"'»”’)]*(?:\s|$)")
_START = {"article": 10, "main": 8, "section": 3, "div": 5, "blockquote": 3, "td": 3, "pre": 3, "body": 0, "ul": -3, "ol": -3, "dl": -3, "address": -3, "th": -5}
_LEVELS = 5


@dataclass
class _Node:
    tag: str
    parent: int
    article: int  # nearest enclosing article or main, itself included, else -1
    dropped: bool
    doubt: str = ""  # named like something beside the article: "named", or "readers" for comments
    soft: bool = False  # by words only that an article may use for its parts
    named: str = ""  # its attributes, if so
    voices: int = 0  # names and times such as readers' entries have
    score: float = 0.0
    size: int = 0
    linked: int = 0
    end: int = 0  # nodes from here to end (exclusive) are below this one


@dataclass
class _Page:
    nodes: list[_Node] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)  # (node, text) in page order


def _standing(tag: str, attributes: str) -> str:
    """``hidden``, ``readers`` or ``named`` for an element that its attributes put beside the article."""
    out = ""
    if not attributes or attributes.isspace():
        return out
    for m in _ATTRIBUTE.finditer(attributes):
        name = m.group(1).lower()
        if name not in ("class", "id", "role", "hidden", "aria-hidden", "style"):
            continue
        value = html.unescape(m.group(2) or m.group(3) or m.group(4) or "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return "hidden"
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "hidden"
        if name == "role" and value.strip().lower() in _ROLES:
            out = out or "named"
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            words = " ".join(_HUMP.sub("-", w) for w in value.split() if not w.lower().startswith(_STATES))
            if _READERS.search(words):
                out = "readers"
            elif _UNLIKELY.search(words):
                out = out or "named"
    return out


def _named_softly(attributes: str) -> bool:
    """Whether class, id and role hold no name that puts an element beside the article but soft ones."""
    for m in _ATTRIBUTE.finditer(attributes):
        if m.group(1).lower() in ("class", "id", "role"):
            words = " ".join(_HUMP.sub("-", w) for w in html.unescape(m.group(2) or m.group(3) or m.group(4) or "").split() if not w.lower().startswith(_STATES))
            if m.group(1).lower() == "role" and words.lower() in _ROLES or _UNLIKELY.search(_SOFT.sub(" ", words)):
                return False
    return True


def _has_voice(attributes: str) -> bool:
    return any(m.group(1).lower() in ("class", "id") and _VOICES.search(m.group(2) or m.group(3) or m.group(4) or "") for m in _ATTRIBUTE.finditer(attributes))


def _parse(source: str) -> _Page:
    """The page's block elements as a tree in page order, and the text of each run between their tags."""
    page = _Page([_Node("#root", -1, -1, False)])
    nodes, stack, opened = page.nodes, [0], Counter()
    words: list[str] = []
    links = anchors = 0
    muted, muted_at, nested = "", 0, 0  # an inline element whose text does not count, and the depth it is at
    at, n = 0, len(source)

    def flush() -> None:
        nonlocal words, links
        text = " ".join("".join(words).split()) if words else ""
        if text:
            here = nodes[stack[-1]]
            if not here.dropped:
                page.blocks.append((stack[-1], text))
                here.size += len(text)
                here.linked += min(links, len(text))
        words, links = [], 0

    def close(k: int) -> None:
        while len(stack) > k:
            node = stack.pop()
            nodes[node].end = len(nodes)
            opened[nodes[node].tag] -= 1
        if muted and k < muted_at:
            unmute()

    def unmute() -> None:
        nonlocal muted
        muted = ""

    def find(tags: set[str], stop: set[str] = frozenset()) -> int:
        for k in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[k]].tag
            if tag in tags:
                return k
            if tag in stop:
                break
        return 0

    def text(raw: str) -> None:
        nonlocal links
        if raw and not muted:
            raw = html.unescape(raw) if "&" in raw else raw
            words.append(raw)
            if anchors:
                links += len(raw.strip())

    while at < n:
        m = _MARKUP.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        if not m.group(2):
            continue
        tag, closing = m.group(2).lower(), bool(m.group(1))
        if tag == "a":
            anchors = 0 if closing else 1
        if tag in _RAW and not closing:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            at = end.start() if end else n
            continue
        if tag == "br":
            words.append("\n")
            continue
        if tag not in _BLOCK and tag not in _DROPPED:
            if muted and tag == muted:
                nested += -1 if closing else 1
                if not nested:
                    muted = ""
            elif not muted and not closing and tag not in _VOID:
                spoken = m.group(3)
                if tag == "time" or spoken and not spoken.isspace() and _has_voice(spoken):
                    nodes[stack[-1]].voices += 1
                standing = _standing(tag, spoken)
                if standing and not (standing != "hidden" and nodes[stack[-1]].article >= 0 and _named_softly(spoken)):
                    muted, muted_at, nested = tag, len(stack), 1
            continue  # other inline elements are transparent
        if tag in _VOID:
            continue
        if closing:
            if opened[tag]:
                flush()
                close(find({tag}))
                anchors = 0 if tag in _BLOCK else anchors
            elif tag == "p":
                flush()
            continue
        flush()
        if tag in _CLOSES_P and opened["p"] and (k := find({"p"}, {"table", "td", "th", "button", "dialog"})):
            close(k)
        if tag in _CLOSES and (k := find(_CLOSES[tag], _SCOPE.get(tag, set()))):
            close(k)
        parent = nodes[stack[-1]]
        standing = _standing(tag, m.group(3))
        dropped = parent.dropped or tag in _DROPPED or tag == "header" and parent.article < 0 or standing == "hidden" or bool(muted)
        me = len(nodes)
        article = me if tag in ("article", "main") and not dropped and (parent.article < 0 or nodes[parent.article].tag == "main") else parent.article
        soft = bool(standing) and standing != "hidden" and _named_softly(m.group(3))
        voice = bool(m.group(3)) and not m.group(3).isspace() and _has_voice(m.group(3))
        nodes.append(_Node(tag, stack[-1], article, dropped, standing, soft, m.group(3) if soft else "", int(voice), float(_START.get(tag, 0))))
        stack.append(me)
        opened[tag] += 1
        if m.group().endswith("/>") and tag in ("svg", "math", "canvas", "object"):
            close(len(stack) - 1)
    flush()
    close(0)
    return page


def _judge_names(page: _Page, points: list[float]) -> _Page:
    """The page without what is named like something beside the article.

    An element by such a name stays if it holds an article or main element or over half of the page's
    points (what readers add: only the former), and all names are forgiven if they leave no text.

    Inside an article or main element soft names are not enough: an element of text stays, a container
    goes if half of it are links, if two or more of its parts are named like readers' entries, if it is
    a notice or if none of its text is in paragraphs, headings or lists.
    """
    nodes = page.nodes
    weight, holds = [0.0] * len(nodes), [not x.dropped and x.tag in ("article", "main") for x in nodes]
    size, linked, voices, prose = [x.size for x in nodes], [x.linked for x in nodes], [x.voices for x in nodes], [x.tag in _OWN_TEXT and x.size > 0 for x in nodes]
    for (node, _), p in zip(page.blocks, points, strict=True):
        weight[node] += p
    for k in range(len(nodes) - 1, 0, -1):
        up = nodes[k].parent
        weight[up] += weight[k]
        holds[up] |= holds[k]
        size[up] += size[k]
        linked[up] += linked[k]
        voices[up] += voices[k]
        prose[up] |= prose[k]

    def forgiven(k: int) -> bool:
        node = nodes[k]
        if not node.soft or node.article < 0 or node.article == k or 2 * linked[k] > size[k]:
            return False
        return node.tag in _OWN_TEXT or prose[k] and voices[k] - node.voices < 2 and not _NOTICE.search(node.named)

    gone, k = [False] * len(nodes), 1
    while k < len(nodes):
        node = nodes[k]
        inside = node.doubt and (holds[k] or forgiven(k))
        if node.doubt and not inside and (node.doubt == "readers" or 2 * weight[k] <= weight[0]):
            gone[k : node.end] = [True] * (node.end - k)
            k = node.end
        else:
            k += 1
    blocks = [x for x in page.blocks if not gone[x[0]]]
    if not blocks:
        return page
    for k, node in enumerate(nodes):
        if gone[k]:
            node.dropped, node.size, node.linked, node.score = True, 0, 0, 0.0
    return _Page(nodes, blocks)


def main_text(source: str | None) -> str:
    """The blocks of the best container and its fitting siblings, joined by empty lines.

    Every run of text passes points for its length and commas to its ancestors, halved at each level
    and discounted by link density; navigation, forms, hidden parts and the like are out of the
    running.  The winner grows to the article or main element around it.
    """
    if not source:
        return ""
    page = _parse(source)
    nodes = page.nodes
    worth_of = lambda node, text: (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - nodes[node].linked / max(nodes[node].size, 1))
    page = _judge_names(page, [worth_of(*x) for x in page.blocks])
    for node, text in page.blocks:
        points = worth_of(node, text)
        at = nodes[node].parent if nodes[node].tag in _OWN_TEXT else node
        for _ in range(_LEVELS):
            if at < 0:
                break
            nodes[at].score += points
            points /= 2
            at = nodes[at].parent
    if not page.blocks:
        return ""
    size, linked = [x.size for x in nodes], [x.linked for x in nodes]
    for k in range(len(nodes) - 1, 0, -1):
        size[nodes[k].parent] += size[k]
        linked[nodes[k].parent] += linked[k]
    live = {b for b, _ in page.blocks}
    live |= {nodes[b].parent for b in live if nodes[b].parent >= 0}
    worth = {k: nodes[k].score * (1 - linked[k] / max(size[k], 1)) for k in live}
    best = max(worth, key=lambda k: (worth[k], -k))
    top = nodes[best].article if nodes[best].article >= 0 else best
    kept, above = _siblings(page, top, size, linked, least=max(10.0, 0.2 * worth.get(best, 0.0)))
    chosen = bytearray(len(nodes))
    for k in kept:
        end = max(nodes[k].end, k + 1)
        chosen[k:end] = b"\1" * (end - k)
    own = above if above >= 0 and nodes[top].tag not in ("article", "main") and 4 * nodes[above].linked < max(nodes[above].size, 1) else -2
    places = [n for n, (node, _) in enumerate(page.blocks) if chosen[node]]
    first, last = places[0], places[-1]
    # Text of the parent itself: what stands between kept blocks, and sentences beside them.
    return "\n\n".join(text for n, (node, text) in enumerate(page.blocks) if chosen[node] or node == own and (first < n < last or _SENTENCE.search(text)))


def _siblings(page: _Page, top: int, size: list[int], linked: list[int], least: float) -> tuple[list[int], int]:
    """The winner with its fitting siblings, and their parent (-1 for none).

    Siblings fit by their score, or beside a container by being prose, lists or headings with few links,
    also in wrappers of nothing but headings; what stands between two that fit does too unless half of it
    are links.
    """
    nodes = page.nodes
    kept, above = [top], nodes[top].parent
    if above < 0:
        return kept, above
    texts: dict[int, set[str]] = {}
    for node, _ in page.blocks:
        at = node
        while at > above and nodes[at].parent != above:
            at = nodes[at].parent
        if at > above:
            texts.setdefault(at, set()).add(nodes[node].tag)
    rows, k = [], above + 1
    while k < nodes[above].end:
        if k == top or not nodes[k].dropped and size[k]:
            rows.append(k)
        k = max(nodes[k].end, k + 1)
    loose = nodes[top].tag != "article"
    fits = []
    for k in rows:
        node, density = nodes[k], linked[k] / max(size[k], 1)
        scored = node.score * (1 - density) >= least and node.tag in ("article", "section", "div", "main")
        prose = loose and density < 0.25 and (node.tag == "p" or node.tag in _HEADINGS or node.tag in _BESIDE or texts.get(k, {""}) <= _HEADINGS)
        fits.append(k == top or scored or prose)
    if loose and True in fits:
        low, high = fits.index(True), len(fits) - 1 - fits[::-1].index(True)
        fits = [fit or low < n < high and 2 * linked[k] <= size[k] for n, (k, fit) in enumerate(zip(rows, fits, strict=True))]
    return [k for k, fit in zip(rows, fits, strict=True) if fit], above


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) of every page.

    Null and blank html and pages without text give an empty text; null ids and urls pass through;
    repeated rows each get a row; a very long page is parsed whole; an empty table gives no rows; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})

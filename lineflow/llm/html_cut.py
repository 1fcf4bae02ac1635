"""Main text of web pages by a minimum cut.

A page is a row of text blocks.  A classifier gives each block a cost for calling it
content and one for calling it boilerplate: the capacities of its edges to the two
terminals.  Blocks that follow each other, and blocks close to each other in the
document tree, are joined by edges that cost something if their labels differ.  The
maximum flow finds the cheapest labelling.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import exp, log, log1p

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineflow.llm.shipping import ship_package

ROWS_AT_A_TIME = 128

#: Pages and blocks the classifier is fitted on, at most.
SAMPLE_PAGES = 400
SAMPLE_BLOCKS = 40_000

#: Price of different labels for blocks that follow each other, halved for every step
#: between their parents in the tree, and for elements of one name and parent.
FOLLOWS = 0.6
SAME_PARENT = 0.8

# ---- fixed lists of element names and of words in classes and ids -----------

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template title textarea svg math iframe object canvas select option".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
#: What can stand in a head; anything else ends it, tags for its end being optional.
HEAD_ELEMENTS = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
CONTENT_ELEMENTS = frozenset(("article", "main"))
FRAME_ELEMENTS = frozenset("nav header footer aside form menu dialog button fieldset".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
FRAME_WORDS = (
    "ad ads advert advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments complementary consent "
    "contentinfo cookie cookies copyright disqus footer gdpr hidden login masthead menu modal nav navbar navigation newsletter "
    "notice notices pager pagination popup promo promoted recommended related replies reply respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget"
)
CONTENT_WORDS = "article body content entry main post story text"

_FRAME_NAMES = frozenset(FRAME_WORDS.split())
_CONTENT_HINT = re.compile(rf"(?<![a-z0-9])(?:{'|'.join(CONTENT_WORDS.split())})(?![a-z0-9])", re.I).search
_MAY_HIDE = re.compile(r"hidden|display", re.I).search
_ATTRIBUTES = re.compile(r"([^\s\"'=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?").findall
_HIDING_STYLE = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)(?![\w-])", re.I).search
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I).findall
_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_STOPS = re.compile(r"[.!?…。！？](?=\s|$)").findall


def _is_hidden(rest: str) -> bool:
    """If attributes hide their element: hidden itself, as aria-hidden or as a class, or by style."""
    if not _MAY_HIDE(rest):
        return False
    for name, *values in _ATTRIBUTES(rest):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "class" and "hidden" in value.split() or name == "style" and _HIDING_STYLE(value):
            return True
    return False


class _Place:
    """An element around blocks, by a link to the one around it."""

    __slots__ = ("above", "depth")

    def __init__(self, above: _Place | None):
        self.above, self.depth = above, 0 if above is None else above.depth + 1


@dataclass
class Block:
    """A run of text between two block elements."""

    text: str
    linked: int
    place: _Place
    own: str
    inside: bool
    frame: bool
    frame_hint: bool
    content_hint: bool
    heading: bool
    item: bool
    #: Frame words stand only above the content element it is in.
    hint_above: bool = False


class _Open:
    __slots__ = (
        "tag", "own", "around", "within", "heading", "item", "inside", "frame", "hidden", "named", "above_content", "content_hint"
    )

    def __init__(self, tag, above, names, hidden):
        self.tag = tag
        # Of the nearest block element: its name, where it is, and where its children are.
        if above is None:
            self.own, self.around, self.heading, self.item = "", _Place(None), False, False
            self.within = self.around
        elif tag in INLINE:
            self.own, self.around, self.within, self.heading, self.item = above.own, above.around, above.within, above.heading, above.item
        else:
            self.own, self.around, self.within = tag, above.within, _Place(above.within)
            self.heading, self.item = above.heading or tag in HEADINGS, above.item or tag == "li"
        own_names = names.lower().split()
        is_main = tag == "main" or "main" in own_names
        was_inside = above is not None and above.inside
        self.inside = tag in CONTENT_ELEMENTS or is_main or was_inside
        # A header within an article holds its headline.
        own = tag in FRAME_ELEMENTS and not (tag == "header" and self.inside)
        self.frame = own or (above is not None and above.frame)
        page = tag in ("html", "body")
        self.hidden = (not page and hidden) or (above is not None and above.hidden)
        # Frame words of a wrapper do not hold over a main; over an article, see blocks_of.
        self.named = above is not None and above.named
        self.above_content = above is not None and above.above_content
        if self.inside and not was_inside:
            self.above_content, self.named = self.named and not is_main, False
        elif is_main:
            self.above_content = self.named = False
        self.named = self.named or (not page and not _FRAME_NAMES.isdisjoint(own_names))
        self.content_hint = bool(_CONTENT_HINT(names)) or (above is not None and above.content_hint)


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page, in order; broken markup is read as far as it goes.

    Frame words above an article hold for it only if the page has content without them,
    such as the article that a list of related ones goes with.
    """
    found: list[Block] = []
    stack: list[_Open] = []
    text: list[str] = []
    linked, links = 0, 0
    outer = _Open("", None, "", False)
    opened: Counter[str] = Counter()

    def leave(place: int) -> None:
        opened.subtract(o.tag for o in stack[place:])
        del stack[place:]

    def finish():
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if joined:
                top = stack[-1] if stack else outer
                found.append(
                    Block(
                        joined, min(linked, len(joined)), top.around, top.own, top.inside, top.frame, top.hidden or top.named,
                        top.content_hint, top.heading, top.item or top.own == "dd", top.above_content,
                    )
                )
        linked = 0

    at, end, in_head = 0, len(page), False
    while at < end:
        match = _MARKUP.search(page, at)
        stop = match.start() if match else end
        if in_head and page[at:stop].strip():
            in_head = False
        if stop > at and not in_head:
            piece = page[at:stop]
            text.append(piece)
            if links:
                linked += len(piece)
        if not match:
            break
        at = match.end()
        tag = match["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if match["end"]:
            if tag in ("head", "body", "html", "br"):
                in_head = False
            if tag == "a":
                links = max(0, links - 1)
            if tag not in INLINE:
                finish()
            if opened[tag]:
                leave(next(place for place in range(len(stack) - 1, -1, -1) if stack[place].tag == tag))
            continue
        if tag not in HEAD_ELEMENTS:
            in_head = False
        if tag in UNREAD:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag == "head":
            in_head = not found and not "".join(text).strip()
        if tag in ("br", "hr", "wbr"):
            text.append(" ")
        if tag in VOID:
            continue
        if tag == "a":
            links += 1
        if tag not in INLINE:
            finish()
            implied = _closed_by(stack, tag)
            if implied is not None:
                leave(implied)
            if tag in FRAME_ELEMENTS or tag in CONTENT_ELEMENTS:
                links = 0
        rest = match["rest"]
        names = " ".join("".join(n) for n in _NAMES(rest)) if "=" in rest else ""
        hidden = bool(rest) and _is_hidden(rest)
        stack.append(_Open(tag, stack[-1] if stack else outer, names, hidden))
        opened[tag] += 1
    finish()
    if any(b.hint_above for b in found) and any(b.inside and not b.frame and not b.frame_hint and not b.hint_above for b in found):
        for block in found:
            block.frame_hint = block.frame_hint or block.hint_above
    return found


def _closed_by(stack: list[_Open], tag: str) -> int | None:
    """Where the stack ends: a paragraph does where a block begins, an entry where the next one does."""
    ends = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
    closing = ends.get(tag, ())
    for place in range(len(stack) - 1, -1, -1):
        name = stack[place].tag
        if name == "p" or name in closing:
            return place
        if name not in INLINE:
            return None
    return None


# ---- the classifier --------------------------------------------------------

FEATURES = (
    "one", "log_words", "linked", "ends_in_stop", "stops", "inside_content", "in_frame", "frame_hint", "content_hint",
    "heading", "item", "outside_content",
)

#: Where the fit starts from, and what it is drawn to where pages say nothing.
PRIOR = (-0.5, 0.5, -3.0, 0.5, 0.5, 3.0, -4.0, -6.0, 1.0, 0.5, -0.5, -4.0)


def features_of(block: Block, has_content: bool) -> tuple[float, ...]:
    words = block.text.count(" ") + 1
    return (
        1.0,
        log1p(words),
        block.linked / len(block.text),
        float(block.text[-1] in ".!?…。！？:\"”»"),
        min(1.0, 5 * len(_STOPS(block.text)) / words),
        float(block.inside and not block.frame and not block.frame_hint),
        float(block.frame),
        float(block.frame_hint),
        float(block.content_hint),
        float(block.heading),
        float(block.item),
        float(has_content and not block.inside),
    )


#: Of pages whose markup says nothing: what the text and its surroundings say.
TEXT_FEATURES = ("one", "log_words", "linked", "ends_in_stop", "stops", "heading", "item", "with_most_text", "share_of_text")

TEXT_PRIOR = (-2.0, 0.5, -4.0, 0.5, 0.5, 0.5, -0.5, 1.5, 1.5)


def text_features(blocks: Sequence[Block]) -> list[tuple[float, ...]]:
    """The TEXT_FEATURES of each block of a page.

    The text of a page is where most words stand side by side: of the elements around
    blocks, the one with the most words counts, and how large a part of that another has.
    """
    words = [block.text.count(" ") + 1 for block in blocks]
    beside: Counter[_Place] = Counter()
    for block, n in zip(blocks, words):
        beside[block.place] += n
    most, found = max(beside.values(), default=1), []
    for block, n in zip(blocks, words):
        markup = features_of(block, False)
        share = beside[block.place] / most
        found.append((*markup[:5], markup[9], markup[10], float(share == 1.0), share))
    return found


def is_unmarked(blocks: Sequence[Block]) -> bool:
    """If neither elements nor names say what is content."""
    return not any(b.inside or b.frame or b.frame_hint or b.content_hint for b in blocks)


def silver_label(block: Block, has_content: bool) -> bool | None:
    """What the page's own markup says of a block, if it says anything."""
    if block.frame or block.frame_hint:
        return False
    if has_content:
        return block.inside
    return None


def _has_content(blocks: Sequence[Block]) -> bool:
    return any(b.inside and not b.frame and not b.frame_hint for b in blocks)


def fit_classifier(
    pages: DataFrame,
    page_id: str = "page_id",
    html_column: str = "html",
    sample_pages: int = SAMPLE_PAGES,
    sample_blocks: int = SAMPLE_BLOCKS,
) -> list[float]:
    """Weights of a logistic classifier of blocks, in the order of FEATURES.

    It is fitted on the blocks of ``sample_pages`` pages, those with the smallest hash
    of their id, and at most ``sample_blocks`` of them, labelled by the pages' own
    elements; both bounds are parameters, and the sample is all that reaches the
    driver.  Weights are drawn to PRIOR, which is what remains if no page has labels.
    """
    return fit_classifiers(pages, page_id, html_column, sample_pages, sample_blocks)[0]


def fit_classifiers(
    pages: DataFrame,
    page_id: str = "page_id",
    html_column: str = "html",
    sample_pages: int = SAMPLE_PAGES,
    sample_blocks: int = SAMPLE_BLOCKS,
) -> tuple[list[float], list[float]]:
    """The weights of :func:`fit_classifier`, and those of TEXT_FEATURES for unmarked pages.

    The second classifier has the labels of the first and sees nothing of the markup
    they come from, so it can say something of pages without it.
    """
    ship_package(pages.sparkSession)
    ids = pages.select(F.xxhash64(F.col(f"`{page_id}`").cast("string")).alias("place")).distinct()
    chosen = [row.place for row in ids.orderBy("place").limit(sample_pages).collect()]
    place = F.xxhash64(F.col(f"`{page_id}`").cast("string"))
    sample = pages.filter(place.isin(chosen)).select(F.col(f"`{html_column}`").cast("string").alias("html"))
    schema = "features array<double>, text_features array<double>, content boolean"
    rows = sample.mapInArrow(_labelled_batches, schema).limit(sample_blocks).collect()
    labels = [row.content for row in rows]
    return _fitted([row.features for row in rows], labels, PRIOR), _fitted([row.text_features for row in rows], labels, TEXT_PRIOR)


def _fitted(features: list, labels: list[bool], prior: Sequence[float]) -> list[float]:
    import numpy as np

    prior = np.array(prior)
    if not labels:
        return prior.tolist()
    seen, content = np.array(features), np.array(labels, float)
    weights = prior.copy()
    for _ in range(25):  # Newton steps of the penalised likelihood
        share = 1 / (1 + np.exp(-seen @ weights))
        slope = seen.T @ (share - content) + (weights - prior)
        curve = (seen * (share * (1 - share))[:, None]).T @ seen + np.eye(len(prior))
        step = np.linalg.solve(curve, slope)
        weights -= step
        if abs(step).max() < 1e-8:
            break
    return weights.tolist()


def _labelled_batches(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        features, of_text, labels = [], [], []
        for page in batch.column(0).to_pylist():
            blocks = blocks_of(page or "")
            has_content = _has_content(blocks)
            for block, text in zip(blocks, text_features(blocks)):
                label = silver_label(block, has_content)
                if label is not None:
                    features.append(features_of(block, has_content))
                    of_text.append(text)
                    labels.append(label)
        doubles = pa.list_(pa.float64())
        arrays = [pa.array(features, doubles), pa.array(of_text, doubles), pa.array(labels, pa.bool_())]
        yield pa.RecordBatch.from_arrays(arrays, ["features", "text_features", "content"])


# ---- the cut ---------------------------------------------------------------


def minimum_cut(excess: Sequence[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut.

    ``excess`` is the capacity from the source less that to the sink; the common part
    of the two flows through the node in any case.  A node whose excess is as large as
    all its edges together keeps its sign's side whatever the others do; it is settled
    at once and its edges become capacities of its neighbours.  Flow is sent through
    what is left.
    """
    n = len(excess)
    excess = list(excess)
    beside: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), price in edges.items():
        beside[a][b] = beside[a].get(b, 0.0) + price
        beside[b][a] = beside[b].get(a, 0.0) + price
    side: list[bool | None] = [None] * n
    waiting = deque(range(n))
    while waiting:
        node = waiting.popleft()
        if side[node] is not None or abs(excess[node]) < sum(beside[node].values()):
            continue
        side[node] = excess[node] > 0
        for other, price in beside[node].items():
            excess[other] += price if side[node] else -price
            del beside[other][node]
            waiting.append(other)
        beside[node] = {}
    if None in side:
        _send_flow(excess, beside, side)
    return [bool(s) for s in side]


def _send_flow(excess: list[float], beside: list[dict[int, float]], side: list[bool | None]) -> None:
    """Augment along shortest paths from nodes with excess to nodes without; then label by reach."""
    open_nodes = [v for v, s in enumerate(side) if s is None]
    while True:
        came: dict[int, int | None] = {v: None for v in open_nodes if excess[v] > 1e-12}
        queue, goal = deque(came), None
        while queue and goal is None:
            node = queue.popleft()
            for other, room in beside[node].items():
                if room > 1e-12 and other not in came:
                    came[other] = node
                    if excess[other] < -1e-12:
                        goal = other
                        break
                    queue.append(other)
        if goal is None:
            for v in open_nodes:
                side[v] = v in came
            return
        path = [goal]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        flow = min(excess[path[0]], -excess[goal], *(beside[a][b] for a, b in zip(path, path[1:])))
        excess[path[0]] -= flow
        excess[goal] += flow
        for a, b in zip(path, path[1:]):
            beside[a][b] -= flow
            beside[b][a] = beside[b].get(a, 0.0) + flow


def label_blocks(
    blocks: Sequence[Block], weights: Sequence[float], text_weights: Sequence[float] = TEXT_PRIOR
) -> list[bool]:
    """True for the blocks that are content."""
    if is_unmarked(blocks):
        weights, features = text_weights, text_features(blocks)
    else:
        has_content = _has_content(blocks)
        features = [features_of(block, has_content) for block in blocks]
    excess, last_of = [], {}
    edges: dict[tuple[int, int], float] = {}
    for i, block in enumerate(blocks):
        score = sum(w * x for w, x in zip(weights, features[i]))
        share = min(max(1 / (1 + exp(-min(max(score, -30), 30))), 1e-5), 1 - 1e-5)
        excess.append(log(share) - log(1 - share))  # cost of boilerplate less cost of content
        if i:
            edges[i - 1, i] = FOLLOWS * _nearness(blocks[i - 1].place, block.place)
        sibling = last_of.get((block.place, block.own))
        if sibling is not None:
            edges[sibling, i] = edges.get((sibling, i), 0.0) + SAME_PARENT
        last_of[block.place, block.own] = i
    return minimum_cut(excess, edges)


#: Steps through the tree beyond which blocks are not near at all.
_FAR = 60


def _nearness(a: _Place, b: _Place) -> float:
    """Halved with each step through the tree from one place to the other."""
    steps = 0
    while a is not b:
        if steps == _FAR:
            return 0.0
        if a.depth >= b.depth:
            a = a.above
        else:
            b = b.above
        steps += 1
    return 0.5**steps


def main_text(page: str, weights: Sequence[float] = PRIOR, text_weights: Sequence[float] = TEXT_PRIOR) -> str:
    """The content blocks of a page, in order, two line feeds between them."""
    blocks = blocks_of(page)
    labels = label_blocks(blocks, weights, text_weights)
    return "\n\n".join(block.text for block, content in zip(blocks, labels) if content)


def extract_main_text(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    html_column: str = "html",
    weights: Sequence[float] | None = None,
    text_weights: Sequence[float] | None = None,
) -> DataFrame:
    """page_id, url, text, n_chars of every row; the classifiers are fitted on ``pages`` unless given.

    Null and empty pages, and pages without content, have an empty text.  Null and
    repeated ids pass through; rows are worked on in place, without a shuffle.  Other
    columns are not read.
    """
    ship_package(pages.sparkSession)
    if weights is None or text_weights is None:
        fitted = fit_classifiers(pages, page_id, html_column)
        weights, text_weights = weights or fitted[0], text_weights or fitted[1]
    rows = pages.select(
        F.col(f"`{page_id}`").alias("page_id"),
        F.col(f"`{url}`").alias("url"),
        F.coalesce(F.col(f"`{html_column}`").cast("string"), F.lit("")).alias("html"),
    )
    kinds = {name: rows.schema[name].dataType.simpleString() for name in ("page_id", "url")}
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    return rows.mapInArrow(_text_batches(list(weights), list(text_weights)), schema)


def _text_batches(weights: Sequence[float], text_weights: Sequence[float]) -> Callable[[Iterator], Iterator]:
    def texts(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_A_TIME):
                part = batch.slice(start, ROWS_AT_A_TIME)
                found = [main_text(page, weights, text_weights) for page in part.column(2).to_pylist()]
                columns = [
                    part.column(0), part.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())
                ]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return texts

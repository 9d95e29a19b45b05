"""HTML extraction (op10): content and boilerplate labelled by a minimum cut.

A page is read into text blocks, each with its place in the element tree. A
linear classifier of tags, names, links and length gives every block the cost
of either label; the costs are capacities to the two terminals. Blocks that
follow each other, and neighbours within one container, are joined by edges
whose capacity falls with their distance in the tree. The cheapest labelling is
a minimum cut, found by maximum flow after fixing all blocks whose own cost
outweighs their edges, which no minimum cut can label otherwise.

What a name says of an element is weighed when the page is read: one that holds
the main article is a wrapper, whatever it is called ("layout with-sidebar"), and
a section of an article with an ambiguous id ("discussion") counts the less the
more text it holds. Pages are scanned in linear time; a tag whose quotes do not
close ends at its first ``>``.

Cases: null and empty pages, and pages without content, have the text ``""``;
unclosed elements end with their container or the page; repeated pages are
extracted each; an empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimhound.llm.staging import table

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
QUOTE_OR_END = re.compile("[>\"']")
# Fixed values of HTML: elements whose text is not the page's.
RAW = frozenset("script style noscript template textarea iframe svg".split())
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in RAW}
NAMES = re.compile(
    r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE
)
HIDDEN = re.compile(
    r"""\bhidden\b(?!\s*=)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE
)

# Fixed values of HTML: elements that begin a block, that hold nothing, and that close each other.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
    "nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title "
    "tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th", "th": "td th",
          "option": "option", "p": "p"}

# The classifier: log-odds of content. Names are words of class, id, role and label.
BAD_TAGS = {
    "nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "head": -20.0, "button": -9.0,
    "select": -9.0, "menu": -9.0, "dialog": -9.0, "header": -7.0, "fieldset": -7.0, "label": -4.0,
}
BAD_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices notification alert menu nav navbar navigation "
    "sidebar widget footer header masthead comment comments disqus reply replies respond share "
    "sharing social related recommended newsletter subscribe subscription signup login popup modal "
    "overlay breadcrumb breadcrumbs pagination pager toolbar search copyright legal disclaimer "
    "complementary contentinfo dialog form reactions discussion".split()
)
GOOD_NAMES = frozenset("article main content post entry story body text".split())
#: Names that a section of an article may bear as its id; they count as half at this many words.
AMBIGUOUS_NAMES = frozenset("discussion reactions legal search menu form dialog".split())
AMBIGUOUS_WORDS = 15
BAD_NAME, GOOD_NAME, IN_ARTICLE, IN_MAIN = -9.0, 1.5, 5.0, 3.0
BIAS, PARAGRAPH, HEADING, LINKS, PER_WORD, MOST_WORDS = -1.0, 1.2, 0.6, -5.0, 0.04, 50
HIDDEN_SCORE = -20.0
#: Capacity of an edge between blocks of one container, divided by their distance beyond it.
SMOOTH = 1.0


@dataclass
class Node:
    tag: str
    parent: Node | None
    own: float = 0.0  # what tells of the element itself, names and forms apart
    bad: float = 0.0  # of a bad name or a form, unless the element is a wrapper
    ambiguous: bool = False
    main: int = 0  # how surely it is the main article: 3 article, 2 main, 1 by name
    in_article: bool = False
    depth: int = 0
    p: bool = False
    heading: bool = False
    words: int = 0  # of the element's own blocks, then of all in it
    score: float = 0.0  # of the element and all around it


@dataclass
class Block:
    node: Node
    text: str
    score: float


def scan(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start and end of each piece of markup, with tag ("" of none), whether it ends it, and attributes.

    Each place is passed a bounded number of times: a quote from which an
    earlier tag found no end is remembered.
    """
    last_end = page.rfind(">")
    last_quote = {q: page.rfind(q) for q in "\"'"}
    dead: set[int] = set()
    at = page.find("<")
    while at >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4) + 3
            end = end if end >= 3 else len(page)
            yield at, end, "", False, ""
        elif at > last_end:
            # nothing closes any more, but a comment may still follow
            end = page.find("<!--", at + 1)
            at = end
            continue
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1
            yield at, end, "", False, ""
        elif m := TAG.match(page, at):
            place, passed = m.end(), []
            while True:
                place = QUOTE_OR_END.search(page, place)
                place = place.start() if place else -1
                if place < 0 or page[place] == ">":
                    break
                passed.append(place)
                if place in dead or place >= last_quote[page[place]]:
                    place = -1
                    break
                place = page.index(page[place], place + 1) + 1
            if place < 0:
                dead.update(passed)
                place = page.find(">", m.end())
            tag, more, end = m[2].lower(), page[m.end() : place], place + 1
            if tag in RAW and not m[1] and not (tag == "svg" and more.endswith("/")):
                closed = RAW_END[tag].search(page, end)
                end = page.find(">", closed.end()) + 1 if closed else 0
                yield at, end or len(page), "", False, ""
                end = end or len(page)
            else:
                yield at, end, tag, bool(m[1]), more
        else:
            end = at + 1
        at = page.find("<", end)


def _names(more: str) -> set[str]:
    found = " ".join(a or b or c for a, b, c in NAMES.findall(more)).lower()
    return set(re.split(r"[^a-z0-9]+", found))


def _open(tag: str, more: str, parent: Node) -> Node:
    node = Node(tag, parent, in_article=parent.in_article, depth=parent.depth + 1)
    if tag == "article" and not node.in_article:
        node.own, node.in_article, node.main = IN_ARTICLE, True, 3
    elif tag == "main":
        node.own, node.main = IN_MAIN, 2
    elif tag == "form":
        node.bad = BAD_TAGS[tag]
    elif tag in BAD_TAGS and not (tag == "header" and node.in_article):
        node.own = BAD_TAGS[tag]
    if more and "=" in more:
        names = _names(more)
        bad = names & BAD_NAMES
        if bad and tag not in ("html", "body"):
            node.ambiguous = parent.in_article and tag == "section" and bad <= AMBIGUOUS_NAMES
            node.bad += BAD_NAME
            node.main = 0
        elif names & GOOD_NAMES:
            node.own += GOOD_NAME
            node.main = node.main or 1
    if more and HIDDEN.search(more):
        node.own += HIDDEN_SCORE
    node.p = parent.p or tag in ("p", "blockquote", "pre")
    node.heading = parent.heading or tag in HEADINGS
    return node


def _weigh(nodes: list[Node]) -> None:
    """Scores of all nodes (parents first), once the words in each are known.

    The element that is most surely the main article, and of those the one with
    most words, makes wrappers of all around it; one that only a name tells
    must hold half of the page's words.
    """
    for node in reversed(nodes[1:]):
        node.parent.words += node.words
    total = nodes[0].words
    sure = [n for n in nodes if n.main > 1 or n.main and 2 * n.words >= total]
    main = max(sure, key=lambda n: (n.main, n.words), default=None)
    wrappers, up = set(), main
    while up is not None and up.parent is not None:
        up = up.parent
        wrappers.add(id(up))
    for node in nodes[1:]:
        bad = 0.0 if id(node) in wrappers else node.bad
        if node.ambiguous:
            bad *= AMBIGUOUS_WORDS / (AMBIGUOUS_WORDS + node.words)
        node.score = node.parent.score + node.own + bad


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, with the classifier's log-odds of content."""
    out: list[Block] = []
    node, runs, linked, link_depth = Node("", None), [], 0, 0
    owner, nodes = node, [node]
    open_tags: Counter[str] = Counter()

    def flush() -> None:
        nonlocal runs, linked
        text = " ".join("".join(runs).split())
        if text:
            words = text.count(" ") + 1
            owner.words += words
            kind = HEADING if owner.heading else PARAGRAPH if owner.p else 0.0
            links = LINKS * min(1.0, linked / len(text))
            out.append(Block(owner, text, BIAS + kind + links + PER_WORD * min(words, MOST_WORDS)))
        runs, linked = [], 0

    def said(run: str) -> None:
        nonlocal linked, owner
        run = html.unescape(run) if "&" in run else run
        if not run:
            return
        if not runs or not owner_has_text():
            owner = node
        runs.append(run)
        if link_depth:
            linked += len(run.strip())

    def leave(last: Node) -> None:
        nonlocal node
        while node is not last.parent:
            open_tags[node.tag] -= 1
            node = node.parent

    def owner_has_text() -> bool:
        return any(not r.isspace() for r in runs)

    at = 0
    for start, end, tag, ends, more in scan(page):
        if start > at:
            said(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "br":
            runs.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if ends:
            if open_tags[tag]:
                up = node
                while up.tag != tag:
                    up = up.parent
                leave(up)
            if tag == "a":
                link_depth = 0
            continue
        if tag in VOID:
            continue
        if tag in CLOSES:
            closed, up = CLOSES[tag].split(), node
            while up.parent is not None and up.tag not in closed and (
                tag == "p" and up.tag not in BLOCKS or up.tag == "p"
            ):
                up = up.parent
            if up.tag in closed:
                leave(up)
        elif tag in BLOCKS and open_tags["p"]:
            up = node  # a paragraph ends where another block begins
            while up.parent is not None and up.tag not in BLOCKS:
                up = up.parent
            if up.tag == "p":
                leave(up)
        if tag == "a":
            link_depth = 1
        node = _open(tag, more, node)
        nodes.append(node)
        open_tags[tag] += 1
    said(page[at:])
    flush()
    _weigh(nodes)
    for block in out:
        block.score += block.node.score
    return out


def _distance(a: Node, b: Node) -> int:
    """Steps in the tree from ``a`` to ``b`` over what holds both."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges(found: list[Block]) -> dict[tuple[int, int], float]:
    """Capacities between blocks: followers on the page, and neighbours in one container."""
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, block in enumerate(found):
        inside = block.node.parent or block.node
        near = {i - 1} if i else set()
        if id(inside) in last:
            near.add(last[id(inside)])
        for j in near:
            out[j, i] = 2 * SMOOTH / max(2, _distance(found[j].node, block.node))
        last[id(inside)] = i
    return out


def minimum_cut(scores: list[float], between: dict[tuple[int, int], float]) -> list[bool]:
    """Labels (True: content) of least total cost: own costs, plus capacities across labels."""
    n = len(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), c in between.items():
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    own, label = list(scores), [None] * n
    waiting = deque(range(n))
    while waiting:  # blocks whose own cost decides
        i = waiting.popleft()
        if label[i] is None and abs(own[i]) > sum(near[i].values()):
            label[i] = own[i] > 0
            for j, c in near[i].items():
                own[j] += c if label[i] else -c
                del near[j][i]
                waiting.append(j)
            near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        content = _source_side(left, own, near)
        for i in left:
            label[i] = i in content
    return label


def _source_side(left: list[int], own: list[float], near: list[dict[int, float]]) -> set[int]:
    """Blocks that the source still reaches after a maximum flow (shortest paths first)."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {source: {}, sink: {}}
    for i in left:
        room[i] = dict(near[i])
    for i in left:
        if own[i] > 0:
            room[source][i], room[i][source] = own[i], 0.0
        elif own[i] < 0:
            room[i][sink], room[sink][i] = -own[i], 0.0
    while True:
        came, waiting = {source: source}, deque([source])
        while waiting and sink not in came:
            i = waiting.popleft()
            for j, c in room[i].items():
                if c > 1e-12 and j not in came:
                    came[j] = i
                    waiting.append(j)
        if sink not in came:
            return {i for i in came if i >= 0}
        path, j = [], sink
        while j != source:
            path.append((came[j], j))
            j = came[j]
        amount = min(room[i][j] for i, j in path)
        for i, j in path:
            room[i][j] -= amount
            room[j][i] = room[j].get(i, 0.0) + amount


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    keep = minimum_cut([b.score for b in found], edges(found))
    return "\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array(map(len, texts), pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    columns = [F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")]
    return pages.select(*columns).mapInArrow(
        rows, "page_id long, url string, text string, n_chars long"
    )


def op10_minimum_cut(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

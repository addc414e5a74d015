"""Main text of web pages by consensus paths of hosts.

Each page scores its containers and names the path (tags and classes from the root, numbers generalised) that holds its
main text; Spark counts the votes of every host, and each page is read again from its host's winning path. A page where
that path is missing, or holds clearly less than the container the page itself would choose, is read from its own.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.scratch import stored

#: Share of a page's text (without links) that its container holds at least; among several the deepest gets the vote.
SHARE = 0.8
#: Share of what the page's own choice holds (without links) that the host's path holds at least on a page read from it.
COVER = 0.8
#: Characters from which on a block counts as prose even if it doesn't end like a sentence.
PROSE_CHARS = 60
#: A page that keeps less than this share of its text gives up the class words that removed the rest.
LEFT = 0.2
#: Elements nested deeper count as their ancestor of this depth.
DEPTH = 64
#: Characters of extracted text that a batch of results holds.
BATCH_CHARS = 1 << 22

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"

PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?:^|[\s/\"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=$|[\s/>\"'])", re.I)
NUMBERS = re.compile(r"\d+")

# HTML elements by what they mean here.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
DROPPED = set("head nav footer aside form script style noscript template iframe object svg math canvas audio video button select textarea option title dialog menu".split())
CONTAINERS = set("html body main article section div td center".split())
ENDS_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SAFE = {"html", "body", "main", "article"}
ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
# Words in classes and ids that mark what isn't the article.
MARKS = (
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead cookie cookies consent gdpr notice notices comment comments disqus reply replies respond share sharing social related "
    "recommended newsletter subscribe signup popup modal overlay widget widgets toolbar pagination pager"
).split()
MARKED = re.compile(rf"(?<![a-z])(?<!has-)(?<!with-)(?<!no-)(?<!has_)(?<!with_)(?<!no_)(?:{'|'.join(MARKS)})(?![a-z])")
# Marks that never belong to the article, however much of the page they hold.
SURE = set("comment comments disqus reply replies respond cookie cookies consent gdpr".split())
SENTENCE = re.compile(r"[.!?…:;][\"'”’»)\]]*$")


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(text)} if text and not text.isspace() else {}


def is_dropped(tag: str, found: dict[str, str], in_article: bool) -> bool:
    """Whether tag, role or attributes say that the element is not the article."""
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    return tag not in SAFE and bool(found) and ("hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in ROLES)


def marks_of(tag: str, found: dict[str, str]) -> frozenset[str]:
    """The names by which classes and id mark the element: up to the marking word, or whole where they begin with it."""
    names = set()
    if tag not in SAFE and found:
        for name in (n.lower() for key in ("class", "id") for n in found.get(key, "").split()):
            if match := MARKED.search(name):
                names.add(name if match.start() == 0 or match[0] in SURE else name[: match.end()])
    return frozenset(names)


def is_sure(name: str) -> bool:
    """A mark that says it all: the word alone, or one that never stands for an article's wrapper."""
    return name in MARKS or any(m in SURE for m in MARKED.findall(name))


def step(tag: str, found: dict[str, str]) -> str:
    """A part of a path: the tag and its classes, numbers made alike."""
    return tag + "".join(f".{NUMBERS.sub('#', c.lower())}" for c in sorted(set(found.get("class", "").split())))


@dataclass(frozen=True)
class Block:
    """A run of text between the borders of block elements: its container, characters in links, whether it is a heading,
    and the innermost marked element around it."""

    container: int
    text: str
    links: int
    heading: bool
    mark: int = -1

    @property
    def plain(self) -> int:
        """Characters outside links."""
        return max(0, len(self.text) - self.links)

    @property
    def prose(self) -> bool:
        return not self.heading and 2 * self.links < len(self.text) and (len(self.text) >= PROSE_CHARS or SENTENCE.search(self.text) is not None)


@dataclass(frozen=True)
class Container:
    parent: int
    path: str
    tag: str


def blocks(page: str) -> tuple[list[Block], list[Container]]:
    """Every block that no dropped element holds, in page order, and all containers; number 0 is the page itself.

    Unclosed and wrongly nested elements are closed as browsers do for the common cases; a closing tag without its
    opening one is passed over, and what follows an unfinished comment or script is no text.
    """
    out: list[Block] = []
    nodes = [Container(-1, "", "")]
    stack: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, -1)]  # tag, container, dropped, in an article, mark
    marks: list[tuple[int, frozenset[str]]] = []  # the mark around it, and its names
    words: list[str] = []
    links = anchors = at = 0

    def flush() -> None:
        nonlocal links
        if words:
            text = " ".join("".join(words).split())
            if text:
                out.append(Block(stack[-1][1], text, links, stack[-1][0] in HEADINGS, stack[-1][4]))
            words.clear()
        links = 0

    def say(raw: str) -> None:
        nonlocal links
        if raw and not stack[-1][2]:
            text = html.unescape(raw) if "&" in raw else raw
            words.append(text)
            if anchors:
                links += len(text.strip())

    while (match := PIECE.search(page, at)) is not None:
        say(page[at : match.start()])
        at = match.end()
        if match[2] is None:
            continue
        tag = match[2].lower()
        if match[1]:
            if tag == "a":
                anchors = max(0, anchors - 1)
            deep = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if deep:
                if tag not in INLINE:
                    flush()
                del stack[deep:]
            elif tag == "p":
                flush()
            continue
        if tag == "br":
            if not stack[-1][2]:
                words.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag == "a":
            anchors += 1
        found = attributes(match[3])
        _, node, dropped, in_article, mark = stack[-1]
        if tag in INLINE:
            if not dropped and (is_dropped(tag, found, in_article) or marks_of(tag, found)):
                stack.append((tag, node, True, in_article, mark))
            continue
        flush()
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        while stack[-1][0] == "p" or stack[-1][0] in ENDS_ITSELF.get(tag, ()):
            stack.pop()
        _, node, dropped, in_article, mark = stack[-1]
        gone = dropped or is_dropped(tag, found, in_article)
        if not gone and (names := marks_of(tag, found)):
            marks.append((mark, names))
            mark = len(marks) - 1
            gone = any(map(is_sure, names))
        if tag in CONTAINERS and len(stack) < DEPTH:
            nodes.append(Container(node, f"{nodes[node].path}>{step(tag, found)}", tag))
            node = len(nodes) - 1
        if match[3].endswith("/") and tag not in CONTAINERS:
            continue
        stack.append((tag, node, gone, in_article or tag in ("article", "main"), mark))
    say(page[at:])
    flush()
    return unmarked(out, marks), nodes


def unmarked(found: list[Block], marks: list[tuple[int, frozenset[str]]]) -> list[Block]:
    """The blocks outside marked elements. Where hardly any text is left, the page's builder uses these names for its
    wrappers: the names around most of the lost text are given up, one after another, until enough is left."""
    if not marks:
        return found
    total, given_up = sum(b.plain for b in found), set()
    while True:
        blocking: list[frozenset[str]] = []
        for around, names in marks:  # a mark stands after the one around it
            blocking.append((names - given_up) | (blocking[around] if around >= 0 else frozenset()))
        kept = [b for b in found if b.mark < 0 or not blocking[b.mark]]
        if sum(b.plain for b in kept) >= LEFT * total:
            return kept
        lost: dict[str, int] = {}
        for b in found:
            for name in blocking[b.mark] if b.mark >= 0 else ():
                lost[name] = lost.get(name, 0) + b.plain
        if not lost:
            return kept
        given_up.add(max(lost, key=lambda name: (lost[name], name)))


def vote(page: tuple[list[Block], list[Container]]) -> tuple[str, int]:
    """Path of the container that the page would choose, and how many characters outside links it holds.

    That is the deepest single container with enough of the page's text; the article or main element around it, if there
    is one; else the nearest ancestor that holds all prose, and from there the nearest that adds nothing but headings.
    """
    found, nodes = page
    held, plain, titled, prose = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    for block in found:
        title = block.heading and 2 * block.links < len(block.text)
        held[block.container] += block.plain
        prose[block.container] += block.prose
        plain[block.container] += not title
        titled[block.container] += title
    for k in range(len(nodes) - 1, 0, -1):  # a container stands after its parent
        for count in (held, prose, plain, titled):
            count[nodes[k].parent] += count[k]
    depth = [0] * len(nodes)
    for k in range(1, len(nodes)):
        depth[k] = depth[nodes[k].parent] + 1
    best = max(range(len(nodes)), key=lambda k: (held[k] >= SHARE * held[0] and held[k] > 0, depth[k], held[k], -k))
    up = [best]
    while nodes[up[-1]].parent > 0:
        up.append(nodes[up[-1]].parent)
    for tag in ("article", "main"):
        if around := [k for k in up if nodes[k].tag == tag]:
            return nodes[around[0]].path, held[around[0]]
    up = up[next((i for i, k in enumerate(up) if prose[k] == prose[0]), len(up) - 1) :]
    best = up[0] if prose[best] < prose[0] else best
    for k in up[1:]:
        if plain[k] != plain[best]:
            break
        if titled[k] > titled[best]:
            best = k
    return nodes[best].path, held[best]


def within(page: tuple[list[Block], list[Container]], path: str | None) -> list[Block]:
    """Blocks below the containers with this path; the page's own path is the empty one."""
    found, nodes = page
    if path is None:
        return []
    inside = [False] * len(nodes)
    for k, node in enumerate(nodes):
        inside[k] = node.path == path or (k > 0 and inside[node.parent])
    return [block for block in found if inside[block.container]]


def chosen(page: tuple[list[Block], list[Container]], path: str | None) -> str:
    """Text below the host's path if it covers what the page's own choice holds, else that choice."""
    own, held = vote(page)
    agreed = within(page, path)
    if not agreed or sum(b.plain for b in agreed) < COVER * held:
        agreed = within(page, own)
    return "\n\n".join(b.text for b in agreed)


def host_of(url: Column) -> Column:
    """Host in lower case without port; no host for null and relative addresses."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def votes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, chars): one vote of every page in which some text is found."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cast = [vote(blocks(h.as_py())) for h in batch.column("html")]
            whole = pa.RecordBatch.from_arrays([batch.column("host"), pa.array([c[0] for c in cast], pa.string()), pa.array([c[1] for c in cast], pa.int64())], ["host", "path", "chars"])
            yield whole.filter(pa.array([bool(c[0]) for c in cast]))

    return rows.mapInArrow(run, "host string, path string, chars long")


def winners(cast: DataFrame) -> DataFrame:
    """(host, path) with most votes; ties go to the path with more text, then to the later in the alphabet."""
    counted = cast.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    return counted.groupBy("host").agg(F.max(F.struct("n", "chars", "path")).alias("best")).select("host", F.col("best.path").alias("path"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every row. Null and empty pages and pages without text get an empty text; rows that share an id
    or an address stay rows of their own, each with a vote; pages without a host vote together.

    The winning paths, one row a host, are written before they are joined, so Spark knows their size: below its
    threshold they are broadcast and the pages stay where they are; beyond it both sides are shuffled by host and
    adaptive execution splits hosts that hold many pages.
    """
    won = stored(winners(votes(pages, url_col, html_col)), "paths")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host_of(F.col(url_col)).alias("host"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, texts, size = 0, [], 0
            for i, (page, path) in enumerate(zip(batch.column("html"), batch.column("path"), strict=True)):
                texts.append(chosen(blocks(page.as_py()), path.as_py()))
                size += len(texts[-1])
                if size >= BATCH_CHARS or i + 1 == batch.num_rows:
                    some = batch.slice(first, len(texts))
                    yield pa.RecordBatch.from_arrays([some.column("id"), some.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])
                    first, texts, size = i + 1, [], 0

    return rows.join(won, "host", "left").select("id", "url", "html", "path").mapInArrow(run, f"id {kind}, url string, text string")

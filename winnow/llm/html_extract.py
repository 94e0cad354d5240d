"""Main text of web pages by consensus host paths.

First pass: every container of a page is scored by the text of its own blocks outside links, and
the page votes for the generalised path of its best container (tags with their classes, digits
replaced).  Spark adds the votes per host, combined before the shuffle, and keeps the paths that
carry a tenth of the votes or more, so ten at most.  Second pass: the page is parsed again and
the container at the host's winning path gives the text; a page without it uses its own best.

Menus, headers, footers, sidebars, notices, adverts, forms, reader comments, scripts and styles
are skipped in both passes, by element or by class and id words.  A form, or an element with such a
word, that holds the page itself is kept; an element that is never closed does not swallow what
follows: an open form is kept, another one ends before the next heading, paragraph or section.

Where the text lies in an article, that article and its neighbours are taken; otherwise <main>,
or the smallest container that holds all kept text outside links.  Nothing is left out by its size.

Defined results: null and empty pages give an empty text; a page without container text gives an
empty text; pages without host share the host ''; unclosed elements end with the page; texts of
any length and nesting of any depth are taken whole; repeated rows give repeated results; other
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm.common import SLICE_ROWS, map_slices, settle, table
from winnow.llm.registry import query

#: Hosts up to this many are broadcast with their paths; more are joined by shuffle.
HOSTS_BROADCAST = 20_000

# fixed values: HTML element names
_RAW = frozenset("script style title textarea iframe noscript template svg math".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split())
_CONTAINER = frozenset("article body div main section td".split())
_SKIP = frozenset("nav footer aside form button select option dialog menu object audio video "
                  "canvas".split())
_CLOSES = {"p": frozenset("p".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]),
           "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
           "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
           "option": frozenset(["option"])}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 "
                    "h5 h6 header hr main nav ol p pre section table ul".split())
#: A class, id or role that is one of these words, or begins with one; behind a hyphen a word says
#: nothing (no-sidebar, overflow-hidden) unless the part before it is only a place.
_NOISE = re.compile(
    r"(?:^|\s)(?:(?:site|page|global|main|top|bottom|left|right|primary|secondary)[-_])?"
    r"(?:ads?|advert(?:s|isements?|ising)?|banner|breadcrumbs?|comments?|"
    r"comment-?list|cookies?|consent|disqus|footer|header|hidden|masthead|menu|modal|nav|"
    r"navbar|navigation|newsletter|notices?|popup|promo(?:tion)?|related|recommend(?:ed|ations)?|"
    r"replies|responses|share|sharing|sidebar|social|sponsor(?:ed)?|subscribe|toolbar|widget)"
    r"(?:$|[^a-z])")
#: Elements no class word can drop.
_CONTENT = frozenset("article main".split())
#: Inside these a header belongs to the text.
_PARTS = frozenset("article main section".split())
#: A skipped element that is never closed ends where one of these begins.
_RESUMES = frozenset("article main section h1 h2 h3 p blockquote pre table".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)/?>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
OPEN_COMMENT = re.compile(r"<!--.*\Z", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?",
                   re.I)
_DIGITS = re.compile(r"\d+")


class _Node:
    """An open element; ``box`` is the container around its text, ``home`` the outermost article.

    An element knows its own step and the one above; ``key`` stands for the steps from the root, so
    that paths are compared without being written out.
    """

    __slots__ = ("tag", "step", "key", "above", "skip", "score", "start", "end", "link", "box",
                 "up", "home", "hard", "total", "part", "number")

    def __init__(self, tag, step, skip, start, link, above=None):
        self.tag, self.step, self.skip, self.start, self.link = tag, step, skip, start, link
        # html and body begin a path anew
        self.above = None if tag in ("html", "body") else above
        self.key = hash((self.above.key if self.above else 0, step))
        self.score, self.end, self.total, self.number = 0.0, None, 0, 0
        self.hard = skip  # skipped by its element, not by its class
        inner = above is None or tag in _CONTAINER
        self.box = self if inner else above.box
        self.up = above.box if inner and above is not None else None
        self.home = above.home if above is not None and above.home is not None else (
            self if tag == "article" else None)
        self.part = tag in _PARTS or above is not None and above.part

    @property
    def path(self) -> str:
        steps, node = [], self
        while node is not None:
            steps.append(node.step)
            node = node.above
        return ">".join(reversed(steps))


def _key_of(path: str) -> int:
    key = 0
    for step in path.split(">"):
        key = hash((key, step))
    return key


def _attributes(text: str) -> tuple[str, str, bool]:
    """(class, class and id and role words, hidden) of a start tag."""
    classes = words = ""
    hidden = False
    for name, value in _ATTR.findall(text):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "class":
            classes = value
        if name in ("class", "id", "role"):
            words += " " + value
        if name == "hidden" or name == "aria-hidden" and value == "true":
            hidden = True
    return classes, words, hidden


def parse(page: str) -> tuple[list[_Node], list[str]]:
    """Containers with scores, and the kept pieces of text their ranges point into.

    Pieces are runs of text; a block boundary is a piece of one space.  Where a skipped element
    holds the page itself or is never closed, the page is read a second time.
    """
    nodes, pieces, cleared, open_ = _parsed(page, frozenset(), frozenset())
    if cleared or open_:
        nodes, pieces, *_ = _parsed(page, cleared, open_)
    return nodes, pieces


def _parsed(page: str, cleared: frozenset, ended: frozenset
            ) -> tuple[list[_Node], list[str], frozenset, frozenset]:
    """``cleared``: numbers of elements that are not skipped; ``ended``: of those that end at the
    next part of a text.  Returned are also the numbers that should be in either: elements that
    hold most of the text with its heading or article, or nearly all text, and forms without an
    end; other skipped elements without an end."""
    root = _Node("html", "html", False, 0, False)
    stack, nodes, pieces = [root], [], []
    at, end = 0, len(page)
    run = 0  # weighed characters of the block being read
    mass = heads = number = 0  # characters class words aside, main headings, elements
    noisy: dict[_Node, tuple] = {}  # open elements with a word of noise
    held: list[tuple] = []
    unclosed: list[_Node] = []

    def text(raw: str) -> None:
        nonlocal run, mass
        top = stack[-1]
        if not top.hard and not top.link:
            mass += len(raw.strip())
        if top.skip or not raw:
            return
        raw = html.unescape(raw) if "&" in raw else raw
        pieces.append(raw)
        if not top.link:
            run += len(raw.strip())

    def block() -> None:
        """A block ends: all its text counts for the container around it and for the article,
        half of it for the container above."""
        nonlocal run
        if run:
            top = stack[-1]
            box, up, home = top.box, top.box.up, top.home
            box.score += run
            box.total += run
            if home is not None and home is not box:
                home.score += run
            if up is not None and up is not home:
                up.score += run / 2
            run = 0
        pieces.append(" ")

    def close(node: _Node, own: bool = False) -> None:
        node.end = len(pieces)
        if not own and node.number and node.tag in _SKIP:
            unclosed.append(node)
        if node in noisy:
            n, m, h = noisy.pop(node)
            held.append((n, mass - m, heads > h))

    last = page.rfind(">")
    while at < end:
        # no tag ends behind the last sign; only a comment can still begin there
        hit = TOKEN.search(page, at) if at <= last else OPEN_COMMENT.search(page, at)
        if hit is None:
            text(page[at:])
            break
        text(page[at:hit.start()])
        at = hit.end()
        tag = hit.re is TOKEN and (hit[2] or hit[5])
        if not tag:
            continue
        tag = tag.lower()
        if hit[1] or hit[4]:
            if tag in _BLOCK:
                block()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    for node in stack[:i:-1]:
                        close(node)
                    close(stack[i], True)
                    del stack[i:]
                    break
            continue
        given = hit[3] if hit[2] else hit[6]
        if tag in _RAW:
            done = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = done.end() if done else end
            continue
        if tag in _BLOCK:
            block()
        if ended and tag in _RESUMES:
            for i in range(1, len(stack)):
                if stack[i].number in ended:
                    for node in stack[i:]:
                        close(node)
                    del stack[i:]
                    break
        closes = _CLOSES.get(tag, frozenset())
        if tag in _ENDS_P:
            closes = closes | {"p"}
        if closes:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes:
                    for node in stack[i:]:
                        close(node)
                    del stack[i:]
                    break
                if stack[i].tag in _CONTAINER or stack[i].tag in ("ul", "ol", "table", "dl"):
                    break
        if tag in _VOID or given.endswith("/"):
            continue
        top = stack[-1]
        classes, words, hidden = _attributes(given) if given.strip() else ("", "", False)
        number += 1
        hard = top.hard or hidden or tag in _SKIP and tag != "form" or (
            tag == "header" and not top.part)
        noise = tag == "form" or (bool(words) and tag not in ("html", "body")
                                  and tag not in _CONTENT and bool(_NOISE.search(words)))
        skip = top.skip or hard or noise and number not in cleared
        kinds = () if tag in ("html", "body") else sorted(
            set(_DIGITS.sub("#", classes.replace(">", "")).split()))
        node = _Node(tag, ".".join([tag, *kinds]), skip, len(pieces), top.link or tag == "a", top)
        node.hard, node.number = hard, number
        if noise and not hard:
            noisy[node] = number, mass, heads
        heads += not hard and (tag == "h1" or tag in _CONTENT)
        stack.append(node)
        if tag in _CONTAINER and not skip:
            nodes.append(node)
    block()
    for node in reversed(stack):
        close(node)
    for node in reversed(nodes):
        node.up.total += node.total
    if root.total or not nodes:
        nodes.append(root)
    kept = [n for n, m, h in held if 2 * m > mass and h or 10 * m > 9 * mass]
    return nodes, pieces, frozenset(
        [*kept, *(n.number for n in unclosed if n.tag == "form")]), frozenset(
        n.number for n in unclosed if n.tag != "form")


def best_container(nodes: list[_Node]) -> _Node:
    """Highest score, the earlier of equal ones; in an article that article, otherwise <main> or
    the smallest container that holds all kept text outside links."""
    best = max(nodes, key=lambda n: (n.score, -n.start))
    if best.home is not None:
        return best.home
    if not best.score:
        return best
    top = best
    while top.up is not None and top.tag != "main":
        top = top.up
    if top.tag == "main":
        return top
    while best.up is not None and (best.tag == "section" or best.total < top.total):
        best = best.up
    return best


def text_of(nodes: list[_Node], pieces: list[str], paths: list[str] | None) -> str:
    """Text of the containers at the first of ``paths`` the page has, or of its best one.

    Articles come with the articles beside them, whatever their classes.
    """
    chosen: list[_Node] = []
    for path in paths or ():
        key = _key_of(path)
        chosen = [n for n in nodes if n.key == key and n.total > 0 and n.path == path]
        if chosen:
            break
    if not chosen:
        chosen = [best_container(nodes)]
    beside = {id(n.up) for n in chosen if n.tag == "article"}
    chosen = list({id(n): n for n in [*chosen, *(
        n for n in nodes if n.tag == "article" and id(n.up) in beside)]}.values())
    out, upto = [], -1
    for n in sorted(chosen, key=lambda n: (n.start, -n.end)):
        if n.start < upto:  # inside one that was taken
            continue
        out.append("".join(pieces[n.start:n.end]))
        upto = n.end
    return " ".join(" ".join(out).split())


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(
        F.coalesce(url, F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame, share: float = 0.1) -> DataFrame:
    """(host, paths): the paths that carry ``share`` of a host's votes, best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(votes)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]),
                 pa.array([votes[k] for k in keys], pa.int64())],
                names=["host", "path", "votes"])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    nodes, _ = parse(page or "")
                    best = best_container(nodes)
                    if best.total > 0:
                        votes[host, best.path] += 1
                if len(votes) > 10_000:  # pre-aggregated, not dropped
                    yield out()
                    votes.clear()
        if votes:
            yield out()

    counted = (pages.select(host_of(F.col("url")).alias("host"), "html")
               .mapInArrow(run, "host string, path string, votes bigint")
               .groupBy("host", "path").agg(F.sum("votes").alias("votes")))
    counted = settle(counted)
    total = counted.groupBy("host").agg(F.sum("votes").alias("all"))
    return (counted.join(total, "host").filter(F.col("votes") >= F.col("all") * share)
            .groupBy("host").agg(F.array_sort(F.collect_list(
                F.struct((-F.col("votes")).alias("v"), "path"))).alias("p"))
            .select("host", F.transform("p", lambda x: x["path"]).alias("paths")))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns and ``text``, the main text of the whole page."""
    paths = settle(host_paths(pages))
    rows = pages.select(*keep, F.col("html").alias("_html"), host_of(F.col("url")).alias("_host"))
    paths = paths.withColumnRenamed("host", "_host").withColumnRenamed("paths", "_paths")
    if paths.count() <= HOSTS_BROADCAST:
        paths = F.broadcast(paths)
    rows = rows.join(paths, "_host", "left").select(*keep, "_html", "_paths")
    schema = T.StructType([*pages.select(*keep).schema.fields,
                           T.StructField("text", T.StringType())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        k = len(keep)
        texts = [text_of(*parse(page or ""), paths) for page, paths in
                 zip(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist())]
        return pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(texts, pa.string())],
                                          names=[*keep, "text"])

    return map_slices(rows, work, schema)


@query("op4_html_extract")
def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))

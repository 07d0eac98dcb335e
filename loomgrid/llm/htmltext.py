"""Main text of web pages, with removal of site templates.

Every element subtree outside the running text of an article gets two hashes: of its tags and text (furniture that
stands as it is on many pages), and, outside of articles and main parts, of its shape: tags, classes and ids without digits, and the
distinct shapes inside (a site's menu, advert slot or footer, whatever it says on this page). Spark counts each hash's pages per host, and subtrees on
``LEAST_PAGES`` pages of a host are deleted, however many pages the host has. Pages of a host with the
same body count once, and html, body, what holds an article or main, and what holds most of the text of a
page without either are never templates, so copies of an article don't empty each other; on a page without article and main a
shape counts only if most of it is links and nothing in it is running text.

On hosts with ``LEAST_PAGES`` bodies these counts choose the text: what they leave is cut into blocks, in an article or not.
Below the counts lies a net of tag and class rules for what recurs too rarely to be counted (a notice of one page, a form inside an
article). Hosts with fewer bodies can't be counted at all: there the rules and the article (else the main part, else the body) decide. With ``markup``
off there are neither rules nor a preferred element anywhere: counts alone decide.

Cases: a null, empty or text-free page gives an empty text; broken or cut-off markup is read as
browsers do (open elements end with their parent, a cut tag is dropped); a null URL shares one
host ``''``; repeated rows are separate pages and copies of each other; ties can't arise; an empty table gives an empty result; very long
pages are read whole; columns beside page_id, url and html play no part, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import list_column, staged

#: A subtree is a template if it is on so many pages of its host.
LEAST_PAGES = 5
#: Parts of a subtree's pages; the hash that stands for the host itself: among a page's templates if the host has enough bodies to be counted.
SALTS, HOST = 64, 0

# HTML's void, raw-text and block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul hr".split()
)
FURNITURE = frozenset("nav header footer aside form button select option input label fieldset dialog menu svg canvas object audio video map head search".split())
#: Elements that an element of the same kind ends.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements of running text, whose repetition is no sign of a template inside an article.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd figcaption article main body html".split())

#: Elements whose text is running text, and those whose text is unless most of it is links.
RUNNING, LISTED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split()), frozenset("li td th dt dd".split())

MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|"
    r"cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|"
    r"comments?|comment-list|disqus|replies|footer|header|masthead|pagination|pager|toolbar|widget|skip-link)(?:$|[\s_-])",
    re.I,
)
_TAG = re.compile(r"<(?:!--(?:.*?-->|.*\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))", re.S)
_DIGITS = re.compile(r"\d+")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|\Z)", re.I | re.S)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())


def host() -> Column:
    """Host of the URL, lower-cased, without user and port."""
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#]*@)?([^/?#:@]*)", 1))


class _Open:
    """An open element: its tag and name (with classes and ids), whether its text is dropped, its pieces so far, the lengths of its text, of all text inside
    and of links, the shapes inside, and whether it holds running text, an article or main."""

    __slots__ = ("tag", "name", "drop", "prose", "article", "main", "pieces", "first", "mark", "at", "size", "chars", "links", "shapes", "runs", "holds")

    def __init__(self, tag: str, name: str, drop: bool, prose: bool, article: bool, main: bool, first: int, mark: int = 0, at: int = 0) -> None:
        self.tag, self.name, self.drop, self.prose, self.article, self.main, self.first, self.mark, self.at = tag, name, drop, prose, article, main, first, mark, at
        self.pieces: list[str] = []
        self.shapes: dict[str, None] = {}
        self.size = self.chars = self.links = 0
        self.runs = self.holds = False


def _decoded(raw: str) -> str:
    """Character references decoded, white space as single spaces, trimmed."""
    if "&" in raw:
        raw = raw.replace("&amp;", "&") if raw.count("&") == raw.count("&amp;") else html.unescape(raw)
    return " ".join(raw.split())


def read_page(page: str, only_trees: bool = False, only_blocks: bool = False, markup: bool = True) -> tuple[list[tuple[str, bool, bool, bool]], list[tuple[int, int, int]], int]:
    """Blocks (text, in an article, in the main part, dropped by the rules) in page order, subtrees (hash, first block, block after the last), and the body's hash.

    Hashes are of the text as it stands, so that counting needn't decode it.
    """
    blocks: list[tuple[str, bool, bool, bool]] = []
    trees: list[tuple[int, int, int, int, bool]] = []
    shapes: list[tuple[int, int, int, int, bool]] = []
    stack = [_Open("", "", False, True, False, False, 0)]
    text: list[str] = []

    def flush() -> None:
        if text:
            top = stack[-1]
            # text before a dropped inline element stays
            raw = "".join(text[top.mark :] if top.drop else text)
            if not only_trees and (s := _decoded(raw)):
                blocks.append((s, top.article, top.main, top.drop))
            if not only_blocks and (raw := raw.strip()):
                top.pieces.append(raw)
                top.size += 0 if top.drop else len(raw)
                top.chars += len(raw)
                top.runs |= top.tag in RUNNING or (top.tag in LISTED and 2 * top.links < len(raw))
            del text[top.mark if top.drop else 0 :]

    def close(depth: int) -> None:
        while len(stack) > depth:
            if stack[-1].tag in BLOCK or stack[-1].drop:
                flush()
            top = stack.pop()
            up = stack[-1]
            if top.tag == "a":
                top.links = sum(map(len, text[top.at :])) + top.chars
            up.size += top.size
            up.chars += top.chars
            up.links += top.links
            up.runs |= top.runs
            up.holds |= not top.drop and (top.holds or top.tag in ("article", "main"))
            if top.pieces:
                inner = f"<{top.tag}>{''.join(top.pieces)}</>"
                h = xxhash.xxh64_intdigest(inner) >> 1
                if up.drop or not top.drop:  # a body is told by what isn't furniture
                    up.pieces.append(f"{h:x};")
                if top.drop or not top.holds and top.tag in BLOCK and top.tag not in ("html", "body") and not (top.prose and (top.article or top.main)):
                    trees.append((h, top.first, len(blocks), top.size, top.article or top.main))
                if not (top.article or top.main or top.holds) and top.tag not in ("html", "body"):
                    shape = f"{top.name}({','.join(top.shapes)})"
                    up.shapes[shape if len(shape) < 200 else f"{xxhash.xxh64_intdigest(shape):x}"] = None
                    if top.drop or top.tag in BLOCK:
                        shapes.append((xxhash.xxh64_intdigest("shape " + shape) >> 1, top.first, len(blocks), top.chars, not top.runs and 2 * top.links >= top.chars))

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:  # an end tag
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in BLOCK and tag not in BLOCK:
                    break
            continue
        if tag in VOID:
            if tag in ("br", "wbr"):
                text.append(" " if tag == "br" else "")
            elif tag in BLOCK:
                flush()
            continue
        if tag in RAW:  # its text isn't markup; it ends at its own end tag only
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in BLOCK:
            flush()
            for k in range(len(stack) - 1, 0, -1):
                t = stack[k].tag
                if t == "p" or t in SIBLINGS.get(tag, ()):
                    close(k)
                    if t == "p" and tag in SIBLINGS:
                        continue
                    break
                if t in BLOCK and not (tag == "tr" and t in ("td", "th")):
                    break
        up = stack[-1]
        drop, outside, names = up.drop or (markup and tag in FURNITURE), not only_blocks and not (up.article or up.main), []
        if m[3] and (outside or (markup and not drop)) and tag not in ("html", "body"):
            for name, a, b, c in _ATTR.findall(m[3]):
                value, name = a or b or c, name.lower()
                if name in ("class", "id"):
                    names += _DIGITS.sub("", value).split()
                if markup:
                    drop = drop or name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "role" and value.lower() in ROLES) or (name in ("class", "id") and bool(MARKED.search(value)))
        mark = up.mark if up.drop else len(text) if drop else 0
        stack.append(_Open(tag, ".".join([tag, *sorted(set(names))]), drop, tag in PROSE, up.article or tag == "article", up.main or tag == "main", len(blocks), mark, len(text)))
    flush()
    close(1)
    root = stack[0]
    if root.holds:  # the article or main part is known: no other part has to be spared
        found = [t[:3] for t in trees if not t[4] or 2 * t[3] <= root.size] + [t[:3] for t in shapes]
    else:
        total: dict[int, int] = {}
        for t in shapes:
            total[t[0]] = total.get(t[0], 0) + t[3]
        found = [t[:3] for t in trees if 2 * t[3] <= root.size] + [t[:3] for t in shapes if t[4] and 2 * total[t[0]] <= root.chars]
    return blocks, found, xxhash.xxh64_intdigest("".join(root.pieces)) >> 1


def choose(page: str | None, templates: frozenset[int] = frozenset(), markup: bool = True) -> list[tuple[str, str]]:
    """The page's blocks in order, each with what decides on it: ``count`` (in one of the given subtrees), ``rule`` (by tag, class, or outside of the preferred element), or ``keep``."""
    blocks, trees, _ = read_page(page or "", only_blocks=not templates, markup=markup)
    gone = bytearray(len(blocks) + 1)
    for h, a, b in trees:
        if h in templates:
            gone[a:b] = b"\1" * (b - a)
    left = [b for b in blocks if not b[3]]
    part = 0 if not markup or HOST in templates else 1 if any(b[1] for b in left) else 2 if any(b[2] for b in left) else 0
    return [(b[0], "count" if gone[k] else "rule" if b[3] or (part and not b[part]) else "keep") for k, b in enumerate(blocks)]


def main_text(page: str | None, templates: frozenset[int] = frozenset(), markup: bool = True) -> str:
    """The page's main text without the given subtrees."""
    return "\n".join(text for text, why in choose(page, templates, markup) if why == "keep")


def _subtrees(markup: bool):
    """(host, page, body, hashes): the distinct subtrees of each page and ``HOST``, and the hash of its body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [read_page(page.as_py() or "", only_trees=True, markup=markup) for page in batch.column("html")]
            found = [np.unique(np.array([HOST, *(t[0] for t in trees)], dtype=np.int64)) for _, trees, _ in read]
            offs = np.cumsum([0, *map(len, found)])
            hashes = list_column(np.concatenate([np.empty(0, np.int64), *found]), offs, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page"), pa.array([r[2] for r in read], pa.int64()), hashes], names=["host", "page", "body", "hashes"])

    return run


def page_templates(pages: DataFrame, least: int = LEAST_PAGES, markup: bool = True) -> DataFrame:
    """(host, page, templates): hashes of the templates, and ``HOST``, on each page of a host with ``least`` bodies; ``page`` is the hash of its text."""
    keys = pages.select(host().alias("host"), F.xxhash64("html").alias("page"), "html")
    read = staged(keys.mapInArrow(_subtrees(markup), "host string, page long, body long, hashes array<long>"), "subtrees")
    # copies of a body are one page
    rows = read.select("host", "body", F.explode("hashes").alias("hash")).distinct().withColumn("salt", F.pmod("body", F.lit(SALTS)))
    rows = staged(rows, "subtrees")
    # a subtree's pages are counted, and joined, in parts, as it can be on all pages of a large host
    parts = rows.groupBy("host", "hash", "salt").agg(F.count(F.lit(1)).alias("n"))
    often = parts.withColumn("pages", F.sum("n").over(Window.partitionBy("host", "hash"))).filter(F.col("pages") >= least).select("host", "hash", "salt")
    known = staged(rows.join(often, ["host", "hash", "salt"]).groupBy("host", "body").agg(F.collect_set("hash").alias("templates")), "known")
    return read.select("host", "page", "body").distinct().join(known, ["host", "body"]).select("host", "page", "templates")


def _extract(markup: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), frozenset(gone.as_py() or ()), markup) for page, gone in zip(batch.column("html"), batch.column("_templates"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, least: int = LEAST_PAGES, markup: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    templates = staged(page_templates(pages, least, markup).withColumnsRenamed({"host": "_host", "page": "_page", "templates": "_templates"}), "templates")
    base = pages.select("page_id", "url", "html", host().alias("_host"), F.xxhash64("html").alias("_page"))
    # by the table's bytes Spark sends it to all tasks or joins by page
    joined = base.join(templates, ["_host", "_page"], "left").select("page_id", "url", "html", "_templates")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select("page_id", "url").schema)
    return joined.mapInArrow(_extract(markup), f"{fields}, text string, n_chars long")

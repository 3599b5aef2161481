"""Main text of web pages, with site templates removed.

Every page becomes a tree of elements.  Subtrees are hashed and counted per host;
what recurs on a host's pages is its template and goes, as do elements that say
what they are (menus, footers, forms, scripts ...).  The article's own blocks of
text stay, also where several pages share them; a block outside of it goes if most
pages of the host have it at that place.
"""

from __future__ import annotations

import html as entities
import re
from hashlib import blake2b
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from parapet.llm.shared import mix64, stored, unused

#: A subtree is a template from so many pages of its host, however many the host has.
MIN_PAGES = 5
MOST = 0.5  # of a host's pages: a lone block of prose outside of articles goes if more have it
BROADCAST_HASHES = 2_000_000  # 8 bytes each; more are joined with the pages' own

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
NO_TEXT = RAW | frozenset("head nav footer aside form button select option menu dialog svg template "
                          "object canvas audio video datalist map math".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog div dl dt fieldset "
                  "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre "
                  "search section summary table tbody td tfoot th thead tr ul caption".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption".split())
#: Elements that may be templates: those that lay out a page, but not what holds prose.
LAYOUT = (BLOCK | frozenset(["span", "ins"])) - PROSE - frozenset("html body article main".split())
CLOSES_P = BLOCK - frozenset("html body li td th tr tbody thead tfoot caption dd dt".split())
#: What an element may end when it begins, and where the search for it stops.
ENDS = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}),
        "tr": ("tr", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}),
        "option": ("option", {"select"})}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar "
                  "toolbar form".split())
#: Words in a class or id that tell what an element is for.
CHROME = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
                   "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar toolbar "
                   "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup "
                   "login share sharing social related recommended comment comments reply replies respond disqus "
                   "pagination pager widget skip".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/)?(?P<tag2>[a-zA-Z][^\s/>]*)[^<>]*+>", re.S)
_NAMES = re.compile(r"(?:^|[\s/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


class Element:
    __slots__ = ("tag", "rest", "children", "content", "_chrome")

    def __init__(self, tag: str, rest: str):
        self.tag, self.rest, self.children = tag, rest, []
        self.content = tag in ("article", "main")

    def chrome(self, inside: bool) -> bool:
        """Whether the element is no content by its name; ``inside``: of an article."""
        if self.tag in NO_TEXT:
            return True
        if self.tag == "header" and not inside:
            return True
        if not self.rest or self.tag in ("html", "body"):
            return False
        for name, *values in _NAMES.findall(self.rest):
            name, value = name.lower(), "".join(values)
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return True
            if name == "role" and value.lower() in ROLES:
                return True
            if name in ("class", "id") and self.tag != "main" and self._told(value):
                return not self.holds_article()
        return False

    def _told(self, names: str) -> bool:
        """Whether a name is a word of CHROME or begins or ends with one; of an article, is one."""
        for name in names.split():
            words = [w.lower() for w in _WORDS.findall(name)]
            if len(words) > 1 and self.tag == "article":
                continue
            if words and (words[0] in CHROME or words[-1] in CHROME):
                return True
        return False

    def holds_article(self) -> bool:
        todo = list(self.children)
        while todo:
            x = todo.pop()
            if not isinstance(x, str):
                if x.content:
                    return True
                todo += x.children
        return False


def parse(page: str) -> Element:
    """The page's tree.  Missing end tags are implied, stray ones ignored."""
    root = Element("#root", "")
    stack = [root]
    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at:m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in CLOSES_P:
            _end(stack, ("p",), {"table", "td", "th", "button", "li", "div", "article", "section", "main"})
        elif tag in ENDS:
            names, stop = ENDS[tag]
            _end(stack, names.split(), stop)
        element = Element(tag, m["rest"] or "")
        stack[-1].children.append(element)
        if tag in VOID or element.rest.endswith("/"):
            continue
        if tag in RAW:
            close = re.compile(f"</{tag}[^>]*>?", re.I).search(page, at)
            at = close.end() if close else size
            continue
        stack.append(element)
    return root


def _end(stack: list[Element], names, stop: set[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in names:
            del stack[k:]
            return
        if stack[k].tag in stop:
            return


def hashed(root: Element) -> dict[int, tuple[int, int]]:
    """For each element with text, by identity: hash of its subtree, characters of text."""
    found: dict[int, tuple[int, int]] = {}
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [c for c in x.children if not isinstance(c, str)]
    for x in reversed(order):
        h, size = blake2b(x.tag.encode(), digest_size=8), 0
        for c in x.children:
            if isinstance(c, str):
                text = _SPACE.sub(" ", c).strip()
                if text:
                    h.update(b"t" + text.encode("utf-8", "replace"))
                    size += len(text)
            elif id(c) in found:
                own, n = found[id(c)]
                h.update(b"e" + own.to_bytes(8, "little", signed=True))
                size += n
        if size:
            found[id(x)] = int.from_bytes(h.digest(), "little", signed=True), size
    return found


def subtree_hashes(page: str | None) -> list[int]:
    """Distinct hashes of the subtrees that may be templates: layout outside of prose."""
    root = parse(page or "")
    return sorted(_layout(root, hashed(root)))


def _layout(root: Element, found) -> set[int]:
    out, todo = set(), list(root.children)
    while todo:
        x = todo.pop()
        if isinstance(x, str) or id(x) not in found:
            continue
        if x.tag in LAYOUT:
            out.add(found[id(x)][0])
        if x.tag not in PROSE:
            todo += x.children
    return out


def _stand_in(root: Element, found) -> Element | None:
    """What a page without an article has in its place: the part with over half of the text."""
    at = root
    while True:
        texts = any(isinstance(c, str) and c.strip() for c in at.children)
        parts = [c for c in at.children if not isinstance(c, str) and id(c) in found and not c.chrome(False)]
        if texts or len(parts) != 1 or parts[0].tag in PROSE:
            break
        at = parts[0]
    total = sum(found[id(c)][1] for c in parts)
    return next((c for c in parts if c.tag not in PROSE and 2 * found[id(c)][1] > total), None)


def prose_marks(root: Element, found) -> dict[int, int]:
    """Of the outermost blocks of prose outside of articles, by identity: a hash of text
    and place, which is the tags above it and the half of the page."""
    kept, total = _stand_in(root, found), found.get(id(root), (0, 0))[1]
    marks: dict[int, int] = {}
    at, todo = 0, [(root, 0)]
    while todo:
        x, path = todo.pop()
        if isinstance(x, str):
            at += len(_SPACE.sub(" ", x).strip())
            continue
        size = found.get(id(x), (0, 0))[1]
        if not size:
            continue
        if x.tag in PROSE or x.content or x is kept:
            if x.tag in PROSE:
                place = f"{found[id(x)][0]} {path} {2 * at + size > total}"
                marks[id(x)] = int.from_bytes(blake2b(place.encode(), digest_size=8).digest(), "little", signed=True)
            at += size
            continue
        path = crc32(x.tag.encode(), path)
        todo += [(c, path) for c in reversed(x.children)]
    return marks


def main_text(page: str | None, templates=frozenset()) -> str:
    """Blocks of the article, one a line.  A page without article or main element has
    its body as the article.  A template that holds over half of the article's text
    is no template: pages that repeat an article are kept whole."""
    root = parse(page or "")
    found = hashed(root)
    return _main_text(root, found, templates, prose_marks(root, found) if templates else {})


def _main_text(root: Element, found, templates, marks: dict[int, int]) -> str:
    whole = _contents(root) or [root]
    blocks: list[str] = []
    for article in whole:
        total = found.get(id(article), (0, 0))[1]
        _collect(article, found, templates, total, article is not root, blocks, marks)
    return "\n".join(blocks)


def _contents(root: Element) -> list[Element]:
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.content and not x.chrome(True):
            out.append(x)
            continue
        if x is not root and x.tag not in ("html", "body") and x.chrome(False) and not x.holds_article():
            continue
        if x.content:
            continue
        todo += [c for c in reversed(x.children) if not isinstance(c, str)]
    return out


def _collect(article: Element, found, templates, total: int, inside: bool, blocks: list[str],
             marks: dict[int, int]) -> None:
    line: list[str] = []

    def close():
        text = _SPACE.sub(" ", entities.unescape("".join(line))).strip()
        if text:
            blocks.append(text)
        line.clear()

    todo: list = [iter(article.children)]
    ends: list[bool] = [True]
    prose = 0  # depth at which prose began
    while todo:
        x = next(todo[-1], None)
        if x is None:
            todo.pop()
            if ends.pop():
                close()
            if len(todo) < prose:
                prose = 0
            continue
        if isinstance(x, str):
            line.append(x)
            continue
        block = x.tag in BLOCK
        if x.tag == "br":
            line.append(" ")
            continue
        if x.chrome(inside):
            if block:
                close()
            continue
        own = found.get(id(x))
        # in an article, a lone block of text may be a passage that pages share
        if own and x.tag in LAYOUT and not prose and own[0] in templates and 2 * own[1] <= total and (
                not inside or any(not isinstance(c, str) for c in x.children)):
            close()
            continue
        if own and not prose and 2 * own[1] <= total and marks.get(id(x)) in templates:
            close()
            continue
        if block:
            close()
        todo.append(iter(x.children))
        ends.append(block)
        if x.tag in PROSE and not prose:
            prose = len(todo)
    close()


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _key(host: str) -> int:
    return int.from_bytes(blake2b(host.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _of_host(host: int, hashes) -> np.ndarray:
    """Hashes with the host in them, so that one number tells both."""
    own = np.fromiter(hashes, np.int64, len(hashes)).view(np.uint64)
    return mix64(own + mix64(np.array([host], np.int64).view(np.uint64))).view(np.int64)


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, most: float = MOST) -> DataFrame:
    """hash (with the host in it): the subtrees on at least ``min_pages`` pages of a host,
    and the lone blocks of prose that over ``most`` of its pages have at the same place.

    Counted over all pages.
    """
    import pyarrow as pa

    def find(batches):
        for batch in batches:
            hosts, hashes, kinds = [], [np.zeros(0, np.int64)], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                root = parse(page or "")
                found = hashed(root)
                layout, prose = _layout(root, found), set(prose_marks(root, found).values())
                at = _key(host)
                hashes.append(_of_host(at, [at, *layout, *prose]))
                kinds += [0] + [1] * len(layout) + [2] * len(prose)  # 0 counts the pages
                hosts += [at] * (1 + len(layout) + len(prose))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.int64()), pa.array(kinds, pa.int32()), pa.array(np.concatenate(hashes))],
                ["host", "kind", "hash"])

    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").alias("page")).where("host <> ''")
    counts = rows.mapInArrow(find, "host long, kind int, hash long").groupBy("host", "kind", "hash").agg(F.count("*").alias("n"))
    counts = stored(counts.where((F.col("n") >= min_pages) | (F.col("kind") == 0)), "html-subtrees")
    totals = counts.where("kind = 0").select("host", F.col("n").alias("pages"))
    prose = counts.where("kind = 2").join(totals, "host").where(F.col("n") > most * F.col("pages"))
    return counts.where("kind = 1").select("hash").unionByName(prose.select("hash")).distinct()


def with_text(pages: DataFrame, min_pages: int = MIN_PAGES, most: float = MOST,
              text_col: str = "text", broadcast: int = BROADCAST_HASHES) -> DataFrame:
    """Add the main text of each page (columns url and html); empty if there is none.

    A null page is empty; a page without a host keeps what isn't named as chrome.
    Every row is kept, repeated ones too.  A column named as the result is
    replaced.  Up to ``broadcast`` templates are sent to all tasks; more are joined
    with the pages' own subtrees.
    """
    import pyarrow as pa

    pages = pages.drop(text_col)
    templates = stored(site_templates(pages, min_pages, most), "html-templates")
    schema = pages.select("*", F.lit("").alias(text_col)).schema
    column, host = pages.columns.index("html"), unused("_host", pages)

    def own_hashes(root, found, name):
        at, marks = _key(name), prose_marks(root, found)
        own = [*_layout(root, found), *marks.values()]
        return own, _of_host(at, own), marks

    def rewritten(batches, chosen):
        for batch in batches:
            out = []
            names, lists = (batch.column(k).to_pylist() for k in (batch.num_columns - 2, batch.num_columns - 1))
            for page, name, listed in zip(batch.column(column).to_pylist(), names, lists):
                root = parse(page or "")
                found = hashed(root)
                own, keys, marks = own_hashes(root, found, name) if name else ([], np.zeros(0, np.int64), {})
                hit = chosen(keys, listed)
                out.append(_main_text(root, found, {h for h, y in zip(own, hit.tolist()) if y}, marks))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.string())],
                                             [*batch.schema.names[:-2], text_col])

    hashes, page = unused("_hashes", pages), unused("_page", pages)
    hosted = pages.withColumn(host, host_of(F.col("url")))
    if templates.count() <= broadcast:
        known = pages.sparkSession.sparkContext.broadcast(np.sort(  # bounded above
            templates.toArrow().column("hash").to_numpy()))

        def extract(batches):
            table = known.value
            last = len(table) - 1
            return rewritten(batches, lambda keys, _: table[np.minimum(np.searchsorted(table, keys), last)] == keys
                             if len(table) else np.zeros(len(keys), bool))

        return hosted.withColumn(hashes, F.lit(None).cast("array<bigint>")).mapInArrow(extract, schema)

    def asks(batches):
        for batch in batches:
            ids, asked = [], [np.zeros(0, np.int64)]
            for i, name, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                root = parse(text or "")
                keys = np.unique(own_hashes(root, hashed(root), name)[1])
                ids += [i] * len(keys)
                asked.append(keys)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(asked))], [page, "hash"])

    # a page is told by its host and content; equal ones have equal templates
    hosted = hosted.withColumn(page, F.xxhash64(host, "html"))
    asked = hosted.where(F.col(host) != "").select(page, host, "html").mapInArrow(asks, f"`{page}` long, hash long").distinct()
    lists = asked.join(templates, "hash").groupBy(page).agg(F.collect_list("hash").alias(hashes))
    joined = hosted.join(lists, page, "left").drop(page)

    def extract_joined(batches):
        return rewritten(batches, lambda keys, listed: np.isin(keys, np.array(listed or [], np.int64)))

    return joined.mapInArrow(extract_joined, schema)

"""Main text of web pages with a site style tree.

The pages of a host are merged into one style tree: a node is an element's path of tags
and classes, and it counts how many pages have which contents and which child elements
there. Where pages say the same, or say it in the same form, the entropy of contents or of
forms is low. Importances, half content and half form, part a host's nodes in two: menus,
adverts and footers, whose form hardly changes even where their words do, and the content.
The cut is at the widest gap between them. Branches below it that are in no node above it
are removed from each page of the host, and so is what nearly all pages repeat word by word.

Where the tree has nothing to say, names help: a host with few pages has no statistics, and
reader comments are as varied as articles. So elements whose tag, role or class names a menu,
advert, form and the like are removed too, an ``article`` or ``main`` element is the content
where there is one (of it only what pages repeat word by word goes, and never the element
itself), and pages of a host with the same content are copies, which count as one page:
what only copies repeat is not low. With ``marks=False`` the tree decides alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemirror.llm.chunks import text_batches
from tablemirror.llm.common import discard, replaced, written

#: Nodes below this importance are removed, if at least so many pages of the host have them.
LEAST_IMPORTANCE, LEAST_PAGES = 0.3, 3
#: Low nodes are sent to all executors up to so many bytes; beyond, pages are joined to them by host and salt.
MOST_SENT, SALTS = 8 << 20, 64
#: Share that the contents make of the importance by which repeated branches are found; the rest is the form of its children.
CONTENT_SHARE = 0.9
#: A host's nodes are parted at the widest gap of their importances (half content, half form), if it is at least so wide.
LEAST_GAP = 0.08

_MARKUP = re.compile(
    r"<!--|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_NAME_PART = re.compile(r"[A-Za-z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; all but these are never text of the page.
_RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
#: Starting one of these ends an open element of the listed kinds.
_ENDS = {
    **dict.fromkeys(_BLOCK - {"li", "dd", "dt", "td", "th", "tr", "option", "tbody", "thead", "tfoot"}, ("p",)),
    "li": ("li", "p"), "dd": ("dd", "dt", "p"), "dt": ("dd", "dt", "p"), "option": ("option",),
    "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("tr", "td", "th", "p"),
    "tbody": ("tbody", "thead", "tr", "td", "th"), "thead": ("tbody", "tr"), "tfoot": ("tbody", "thead", "tr", "td", "th"),
}
#: An implied end does not reach beyond these.
_SCOPE = frozenset("table ul ol dl body html article section div main aside nav button".split())

_NOISE_TAGS = frozenset("nav aside footer form button select fieldset dialog head menu label input".split())
_NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead comment comments disqus replies reply "
    "share sharing social related recommended newsletter subscribe signup popup modal pagination pager login toolbar skip".split()
)
#: Of these, the ones whose elements often hold articles of their own (reader comments, teasers, paid posts).
_LISTED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus replies reply "
    "related recommended".split()
)
#: A name with one of the first, or that begins with one of the second, tells of the layout or the subject of what it is on.
_LAYOUT, _SUBJECT = frozenset("has no with without not free layout".split()), frozenset("category cat tag topic term tax".split())
#: What an element is by its tag, role or style, and by its names: noise for certain, a whole name or a name's first part,
#: any other part, and the same two for _LISTED names.
_SURE, _NAME, _PART, _LIST, _LIST_PART = 1, 2, 3, 4, 5
_NOISE_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alertdialog menu menubar toolbar".split())
_ROOTS = frozenset(("article", "main"))
_CONTAINERS = frozenset("address article aside center details div dl footer form header main menu nav ol section table ul".split())
#: Blocks that are nodes of the tree where they have a class.
_NAMED = _BLOCK - _CONTAINERS - {"body", "html"}


def _name_mark(value: str) -> int:
    """The mark that the names in a class or id give; 0 for none."""
    marks = set()
    for token in value.split():
        parts = _NAME_PART.findall(token)
        if _NOISE_NAMES.isdisjoint(parts) or (len(parts) > 1 and (parts[0] in _SUBJECT or not _LAYOUT.isdisjoint(parts))):
            continue
        if not _LISTED.isdisjoint(parts):
            marks.add(_LIST if len(parts) == 1 else _LIST_PART)
        else:
            marks.add(_NAME if parts[0] in _NOISE_NAMES else _PART)
    return next((m for m in (_LIST, _LIST_PART, _NAME, _PART) if m in marks), 0)


def _mark(tag: str, attributes: str, in_root: bool) -> int:
    if tag in ("html", "body"):
        return 0
    if tag in _NOISE_TAGS or (tag == "header" and not in_root):
        return _SURE
    if not attributes or attributes.isspace():
        return 0
    marks = set()
    for match in _ATTRIBUTE.finditer(attributes):
        name, value = match.group(1).lower(), (match.group(2) or "").strip("\"'").lower()
        if name in ("class", "id"):
            marks.add(_name_mark(value))
        if (name == "role" and value in _NOISE_ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true"):
            return _SURE
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return _SURE
    return next((m for m in (_LIST, _LIST_PART, _NAME, _PART) if m in marks), 0)


def _step(tag: str, attributes: str) -> str:
    """One step of a path: the tag and its class names without digits."""
    match = re.search(r"\bclass\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", attributes, re.I) if attributes else None
    return tag + "." + ".".join(sorted(set(_NAME_PART.findall(match.group(1).lower())))) if match else tag


def path_id(*steps: str) -> int:
    """Number of a path of steps (a tag and its class names, as in ``div.rail``) from the body; 0 for no step."""
    found = 0
    for step in steps:
        found = _signed(f"{found}/{step}")
    return found


class Page:
    """A page's blocks of text, each with its path and whether noise or content encloses it.

    A path is a number that names the steps to an element (see ``path_id``), so that deep
    nesting costs no more than flat markup; paths that say the same are one.
    """

    def __init__(self, html: str, marks: bool = True):
        self.marks = marks
        # per path, parents before children: parent, depth, tags of its child elements
        self.paths: dict[int, tuple[int, int, list[str]]] = {0: (0, 0, [])}
        # elements with a mark and content roots: place of the next one around it, mark, tag, path
        self.places: list[tuple[int, int, str, int]] = [(0, 0, "", 0)]
        self.found: list[tuple[str, int, int]] = []
        # per open element: tag, path, its place or the next one around it, inside an article or main
        self.open: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]
        self.tags: Counter[str] = Counter()  # of the open elements
        self.parts: list[str] = []
        self._read(html)
        self._flush()
        judged = self._judge()
        self.blocks: list[tuple[str, int, bool, int | None]] = [(text, path, *judged[place]) for text, path, place in self.found]
        self.rooted = any(root is not None and not noise for _, _, noise, root in self.blocks)

    def _flush(self) -> None:
        if self.parts:
            text = " ".join(unescape("".join(self.parts)).split())
            self.parts = []
            if text:
                # inline elements do not part a block, so the innermost block element names its place
                at = next((o for o in reversed(self.open) if o[0] in _BLOCK or not o[0]), self.open[0])
                self.found.append((text, at[1], self.open[-1][2]))

    def _judge(self) -> list[tuple[bool, int | None]]:
        """Of each place: whether it is noise, and the path of the content root around it.

        A name alone never removes a ``main``, an article (but of a whole _LISTED name) or
        what encloses a ``main`` or the longest article; and a part of a name never removes
        most of a page. There the style tree decides.
        """
        places = self.places
        if len(places) == 1:
            return [(False, None)]
        sizes, sure, mains, firm = [0] * len(places), [False] * len(places), set(), [False] * len(places)
        for text, _, place in self.found:
            sizes[place] += len(text)
        for i in range(len(places) - 1, 0, -1):
            sizes[places[i][0]] += sizes[i]
        for i, (up, mark, tag, _) in enumerate(places):
            sure[i] = sure[up] or mark == _SURE
            if tag == "main" and not sure[i] and sizes[i]:
                while i and i not in mains:
                    mains.add(i)
                    i = places[i][0]
        for i, (up, mark, tag, _) in enumerate(places):
            firm[i] = firm[up] or sure[i] or (i not in mains and (mark == _LIST or (mark == _LIST_PART and tag not in _ROOTS)))
        within = [False] * len(places)
        for i, (up, _, tag, _) in enumerate(places):
            within[i] = within[up] or tag == "main"
        articles = [i for i, x in enumerate(places) if x[2] == "article" and not firm[i] and (within[i] or not mains)]
        safe = mains | (self._around(max(articles, key=sizes.__getitem__)) if articles else set())
        whole = sum(len(text) for text, _, place in self.found if not firm[place])
        out: list[tuple[bool, int | None]] = [(False, None)]
        for i, (up, mark, tag, path) in enumerate(places[1:], 1):
            named = mark in (_NAME, _PART) and tag not in _ROOTS and i not in safe
            noise = out[up][0] or firm[i] or (named and not (mark == _PART and 2 * sizes[i] > whole))
            out.append((noise, path if out[up][1] is None and tag in _ROOTS and not noise else out[up][1]))
        return out

    def _around(self, place: int) -> set[int]:
        found = set()
        while place:
            found.add(place)
            place = self.places[place][0]
        return found

    def _read(self, html: str) -> None:
        at, last = 0, html.rfind(">") + 1  # no tag ends beyond it
        while True:
            match = _MARKUP.search(html, at, last)
            if match is None:
                comment = html.find("<!--", at)
                self._text(html[at:comment] if comment >= 0 else html[at:])
                return
            self._text(html[at : match.start()])
            at = match.end()
            if match.group() == "<!--":
                close = html.find("-->", at)
                at = close + 3 if close >= 0 else len(html)
                continue
            tag = (match.group(2) or match.group(5) or "").lower()
            if not tag:
                continue
            if match.group(1) or match.group(4):
                self._end(tag)
                continue
            attributes = match.group(3) or match.group(6) or ""
            if tag in _RAW:
                close = re.compile(rf"</{tag}\s*/?[^>]*>", re.I).search(html, at)
                at = close.end() if close else len(html)
                continue
            self._start(tag, attributes)

    def _text(self, text: str) -> None:
        if text:
            self.parts.append(text)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _BLOCK:
            self._flush()
        elif tag == "br":
            self.parts.append(" ")
        for name in _ENDS.get(tag, ()):
            if not self.tags[name]:
                continue
            for back in range(len(self.open) - 1, 0, -1):
                if self.open[back][0] == name:
                    self._flush()
                    self._close(back)
                    break
                if self.open[back][0] in _SCOPE:
                    break
        if tag in _VOID:
            return
        _, path, place, in_root = self.open[-1]
        mark = 0 if not self.marks or self.places[place][1] == _SURE else _mark(tag, attributes, in_root)
        if mark:
            self._flush()
        step = _step(tag, attributes)
        if tag in _BLOCK:
            self.paths[path][2].append(step)
        if tag in _CONTAINERS or (tag in _NAMED and step != tag):
            up, path = path, _signed(f"{path}/{step}")
            if path not in self.paths:
                self.paths[path] = (up, self.paths[up][1] + 1, [])
        if mark or (tag in _ROOTS and self.marks):
            self.places.append((place, mark, tag, path))
            place = len(self.places) - 1
        self.open.append((tag, path, place, in_root or tag in _ROOTS))
        self.tags[tag] += 1

    def _close(self, back: int) -> None:
        """The open elements from ``back`` on end."""
        self.tags.subtract(o[0] for o in self.open[back:])
        del self.open[back:]

    def _end(self, tag: str) -> None:
        for back in range(len(self.open) - 1 if self.tags[tag] else 0, 0, -1):
            if self.open[back][0] == tag:
                if tag in _BLOCK or self.open[back][2] != self.open[back - 1][2]:
                    self._flush()
                self._close(back)
                return
            if self.open[back][0] in _SCOPE and tag not in _BLOCK:
                return
        if tag == "p" or tag == "br":
            self._flush() if tag == "p" else self.parts.append(" ")

    def content(self) -> int:
        """Hash of all that the page says outside of noise."""
        return _signed(self.text(frozenset()))

    def nodes(self) -> Iterator[tuple[int, int, int]]:
        """Path, hash of the contents and hash of the form of each container node of the page.

        The contents of a node are the blocks of its whole subtree, whatever their order;
        its form is the sequence of its child elements with their classes.
        """
        contents = dict.fromkeys(self.paths, 0)
        for text, path, _, _ in self.blocks:
            contents[path] += _signed(text) | 1
        for path in reversed(self.paths):  # children before parents
            if path:
                contents[self.paths[path][0]] += contents[path]
        for path, (_, _, children) in self.paths.items():
            if path and contents[path]:
                yield path, (contents[path] + (1 << 63)) % (1 << 64) - (1 << 63), _signed(",".join(children))

    def text(self, removed: frozenset[int], below: frozenset[int] = frozenset(), above: frozenset[int] = frozenset()) -> str:
        """Blocks of the page's content without noise and without the branches that the tree removes.

        A content root and what encloses it stay, so only branches below it are ``removed``.
        Outside of one, branches ``below`` the host's cut go, but not inside nodes ``above`` it.
        """
        return "\n\n".join(t for t, _, _ in self.kept(removed, below, above))

    def kept(self, removed: frozenset[int], below: frozenset[int] = frozenset(), above: frozenset[int] = frozenset()) -> list[tuple[str, int, int]]:
        """The blocks of ``text``: text, path and path of the content root around it."""
        kept = [(t, p, root or 0) for t, p, noise, root in self.blocks if not noise and (root is not None or not self.rooted)]
        if below:
            low: dict[int, bool | None] = {}  # False inside a node above the cut, True inside one below it only
            for path, (up, _, _) in self.paths.items():
                outer = low.get(up)
                low[path] = False if outer is False or path in above else True if outer or path in below else None
            kept = [(t, p, root) for t, p, root in kept if root or not low[p]]
        if not removed:
            return kept
        deepest: dict[int, int] = {}  # depth of the deepest removed path at or above each path
        for path, (up, depth, _) in self.paths.items():
            deepest[path] = depth if path in removed else deepest.get(up, 0)
        return [(t, p, root) for t, p, root in kept if deepest[p] <= self.paths[root][1]]


def _signed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def host_of(url_col: str):
    """Host of a URL, lower case, without port; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url_col}`"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def style_tree(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The merged style trees: ``host``, ``path``, ``pages``, ``importance`` and ``balanced`` (half content, half form) of each node.

    With p the share of the pages that have one content (or form) at a node, the entropy
    is the sum of -p log p to the base of the number of pages: 0 where all pages agree, 1
    where all differ. A node that one page has is fully important. Pages with the same
    content outside of noise are copies and count once. Pages send their nodes
    as hashes, and counts are combined before the shuffle, so a host that holds a third of
    all pages is no single task's work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "__html"):
            rows = []
            for host, html in zip(batch.column("host").to_pylist(), texts, strict=True):
                page = Page(html)
                core = page.content()
                rows += [(host, core, *node) for node in page.nodes()]
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["host", "core", "path", "content", "form"])

    pages = df.select(host_of(url_col).alias("host"), F.col(f"`{html_col}`").alias("__html"))
    nodes = pages.mapInArrow(run, "host string, core bigint, path bigint, content bigint, form bigint")
    nodes = nodes.groupBy("host", "path", "core").agg(F.min("content").alias("content"), F.min("form").alias("form"))
    seen = (
        nodes.select("host", "path", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("content").alias("h")), F.struct(F.lit(1).alias("kind"), F.col("form").alias("h")))).alias("x"))
        .groupBy("host", "path", F.col("x.kind").alias("kind"), F.col("x.h").alias("h"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    is_content = F.col("kind") == 0
    sums = seen.groupBy("host", "path").agg(
        F.sum(F.when(is_content, F.col("n"))).alias("pages"),
        F.sum(F.when(is_content, F.col("n") * F.log("n"))).alias("c"),
        F.sum(F.when(~is_content, F.col("n") * F.log("n"))).alias("f"),
    )
    share = lambda s: 1 - F.col(s) / (F.col("pages") * F.log("pages"))
    mixed = lambda part: F.when(F.col("pages") > 1, part * share("c") + (1 - part) * share("f")).otherwise(1.0)
    return sums.select("host", "path", "pages", mixed(CONTENT_SHARE).alias("importance"), mixed(0.5).alias("balanced"))


def parted(tree: DataFrame, least_pages: int = LEAST_PAGES, least_gap: float = LEAST_GAP) -> DataFrame:
    """``(host, path, below)`` of the nodes of hosts whose importances have a gap: whether a node is below the widest one.

    Nodes on fewer than ``least_pages`` distinct pages are left out. A host is a row for each
    path of its layout here, however many pages it has. The node of greatest importance is
    never below.
    """
    judged = tree.where(F.col("pages") >= least_pages).select("host", "path", F.round("balanced", 9).alias("x"))
    down = Window.partitionBy("host").orderBy(F.desc("x"))
    gaps = judged.select("host", "x").distinct().select("host", "x", (F.lag("x").over(down) - F.col("x")).alias("gap"))
    cuts = gaps.where(F.col("gap") >= least_gap).groupBy("host").agg(F.max(F.struct("gap", F.col("x").alias("cut"))).alias("top")).select("host", "top.cut")
    return judged.join(cuts, "host").select("host", "path", (F.col("x") <= F.col("cut")).alias("below"))


def extract_text(
    df: DataFrame,
    url_col: str = "url",
    html_col: str = "html",
    least_importance: float = LEAST_IMPORTANCE,
    least_pages: int = LEAST_PAGES,
    marks: bool = True,
) -> DataFrame:
    """Replace the HTML by ``text``: the blocks of the main text, joined by two line ends.

    Null and empty pages, and pages without main text, give an empty text. Pages without
    a host share the empty host's tree. The judged nodes of a host travel together. They are
    written first and measured, which runs Spark jobs at once. Without ``marks`` names and
    tags do not count, only the tree. Other columns stay, but for
    clashing ones.
    """
    tree, path = written(style_tree(df, url_col, html_col), "style-tree")
    low = tree.where((F.col("importance") < least_importance) & (F.col("pages") >= least_pages)).select("host", "path", F.lit(0).alias("kind"))
    sides = parted(tree, least_pages).select("host", "path", F.when(F.col("below"), 1).otherwise(2).alias("kind"))
    nodes, _ = written(low.union(sides), "judged-nodes")
    discard(df.sparkSession, path)
    lists = [F.collect_list(F.when(F.col("kind") == k, F.col("path"))).alias(name) for k, name in enumerate(("low", "below", "above"))]
    removed = nodes.groupBy(F.col("host").alias("__host")).agg(*lists).select("__host", F.struct("low", "below", "above").alias("__removed"))
    rows = replaced(df, "text", "__host", "__removed", "__key", "__salt").withColumn("__key", host_of(url_col))
    size = nodes.agg(F.coalesce(F.sum(F.length("host") + 72), F.lit(0))).first()[0]
    if size <= MOST_SENT:
        joined = rows.join(F.broadcast(removed), F.col("__key") == F.col("__host"), "left").drop("__key", "__host")
    else:  # a host with a third of all pages is dealt out by a salt
        salted = rows.withColumn("__salt", F.pmod(F.xxhash64(F.col(f"`{html_col}`")), F.lit(SALTS)))
        copies = removed.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same = (F.col("__key") == F.col("__host")) & (F.col("__salt") == F.col("__copy"))
        joined = salted.join(copies, same, "left").drop("__key", "__host", "__salt", "__copy")
    kept = [f for f in joined.schema.fields if f.name not in (html_col, "__removed")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch, pages in text_batches(batches, html_col):
            judged: dict[int, tuple[frozenset[int], ...]] = {}
            texts = []
            for html, found in zip(pages, batch.column("__removed").to_pylist(), strict=True):
                key = 0 if found is None else hash((*found["low"], -1, *found["below"], -1, *found["above"]))
                sets = judged.get(key) or judged.setdefault(key, tuple(frozenset((found or {}).get(k) or ()) for k in ("low", "below", "above")))
                texts.append(Page(html, marks).text(*sets))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, "text"])

    return joined.mapInArrow(run, T.StructType([*kept, T.StructField("text", T.StringType())]))

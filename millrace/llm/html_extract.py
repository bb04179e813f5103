"""Main text of web pages by template deduction from equivalence classes.

Tokens of a page are its block elements, told apart by their path of ancestors, and
its text blocks at their path. The occurrence vector of a token says how often each
page of the host has it; tokens with the same vector form an equivalence class.
Vectors are never built: every page adds a hash of itself and the count, so equal
sums are equal vectors, and the sums are combined before they are shuffled.

A class is valid if it has two tokens or more and occurs on enough of the host's
pages. Elements of valid classes whose parents are in valid classes too nest into the
host's template. Text blocks that are on every page alike belong to the template;
what remains are its slots. The content element is chosen by the text of its slots; all
text below it, without that below menus, adverts and the like, is the main text. Equal
pages of a host count once.

A host with fewer than ``LEAST_PAGES`` pages shows no template; its pages are read by
the names of their elements alone, as is a page that lacks its host's content element.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.arrow import arrow_schema
from millrace.llm.registry import keep

#: Pages from which a host's template is deduced.
LEAST_PAGES = 3
#: Share of a host's pages that a valid class occurs on.
LEAST_SHARE = 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|math|object|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-z][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
# An element that opens ends these if they are open directly around it.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
         "option": {"option"}}

_SKIPPED_TAGS = {"head", "nav", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "label"}
_SKIPPED_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "nav", "navigation", "navbar",
    "menu", "menubar", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "complementary",
    "contentinfo", "comment", "comments", "disqus", "respond", "replies", "notice", "notices", "cookie", "cookies", "consent",
    "gdpr", "popup", "modal", "alert", "newsletter", "subscribe", "signup", "login", "search", "share", "sharing", "social",
    "related", "recommended", "pagination", "pager", "toolbar", "widget", "skip"}
_CONTENT_WORDS = {"article", "content", "post", "entry", "story", "main", "body", "text"}


# How surely a name says that an element is not content: one word of a compound says it only by the way.
_BY_THE_WAY, _SURELY = 1, 2


def _label(tag: str, attributes: str) -> tuple[str, set[str], int]:
    """Name of an element in a path, the words of its class, id and role, and whether they say it is not content."""
    classes, words, skip = [], set(), 0
    for kind, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        value = "".join(values)
        for name in value.split():
            parts = {w.lower() for w in _NAME.findall(name)}
            words |= parts
            if parts & _SKIPPED_WORDS:
                skip = max(skip, _SURELY if parts <= _SKIPPED_WORDS else _BY_THE_WAY)
        if kind.lower() != "id":
            classes += re.sub(r"\d+", "", value).split()
    return ".".join([tag, *sorted(set(classes))]), words, skip


class Page:
    """Elements and text blocks of a page, in page order."""

    def __init__(self, html: str):
        self.paths: list[str] = []  # of each block element
        self.ranks: list[int] = []  # how much its name promises content
        self.skipped: list[bool] = []  # it is or lies in what is not content
        self._named: list[int] = []  # how surely its own name says so
        self.parents: list[int] = []
        self.blocks: list[tuple[int, str]] = []  # innermost element, text
        self._stack: list[tuple[str, int]] = []  # tag, element
        self._parts: list[str] = []
        for match in _TOKEN.finditer(html):
            piece = match.group(0)
            if not piece.startswith("<") or piece == "<":
                self._parts.append(piece)
            elif match.group(3):
                tag = match.group(3).lower()
                if match.group(2):
                    self._close(tag)
                elif tag not in _INLINE:
                    self._open(tag, match.group(4))
        self._flush()
        self._skip()

    def _element(self) -> int:
        return self._stack[-1][1] if self._stack else -1

    def _flush(self) -> None:
        if self._parts:
            text = " ".join(unescape("".join(self._parts)).split())
            self._parts = []
            if text:
                self.blocks.append((self._element(), text))

    def _open(self, tag: str, attributes: str) -> None:
        self._flush()
        if tag in _VOID:
            return
        tags = [t for t, _ in self._stack]
        if "p" in tags:  # no block stands inside a paragraph
            del self._stack[tags.index("p"):]
        while self._stack and self._stack[-1][0] in _ENDS.get(tag, ()):
            self._stack.pop()
        if tag == "body":  # ends an open head
            self._stack = [x for x in self._stack if x[0] != "head"]
        label, words, skip = _label(tag, attributes)
        parent = self._element()
        if tag in _SKIPPED_TAGS or (tag == "header" and not self._in_content()):
            skip = _SURELY
        rank = 4 if tag == "article" else 3 if tag == "main" or "main" in words and "role" in attributes else (
            2 if words & _CONTENT_WORDS else 1 if tag == "body" else 0)
        if tag in ("html", "body", "main"):
            skip = 0
        self.paths.append(f"{self.paths[parent]}/{label}" if parent >= 0 else label)
        self._named.append(skip)
        self.ranks.append(rank)
        self.parents.append(parent)
        self._stack.append((tag, len(self.paths) - 1))

    def _skip(self) -> None:
        """What is skipped: by a sure name; by one word of a name unless an article or half of the text is in it."""
        for named, parent in zip(self._named, self.parents, strict=True):
            self.skipped.append(named == _SURELY or (parent >= 0 and self.skipped[parent]))
        if _BY_THE_WAY not in self._named:
            return
        sizes = self.chars()
        whole = sum(len(t) for e, t in self.blocks if e < 0 or not self.skipped[e])
        holds = [r >= 3 and not s for r, s in zip(self.ranks, self.skipped, strict=True)]
        for i in range(len(self.parents) - 1, -1, -1):
            if holds[i] and self.parents[i] >= 0:
                holds[self.parents[i]] = True
        for i, parent in enumerate(self.parents):
            by_name = self._named[i] == _BY_THE_WAY and not holds[i] and 2 * sizes[i] < whole
            self.skipped[i] |= by_name or (parent >= 0 and self.skipped[parent])

    def _in_content(self) -> bool:
        return any(t in ("article", "main") for t, _ in self._stack)

    def _close(self, tag: str) -> None:
        if tag in _INLINE:
            return
        self._flush()
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] == tag:
                del self._stack[i:]
                return

    def path_of(self, element: int) -> str:
        return self.paths[element] if element >= 0 else ""

    def chars(self) -> list[int]:
        """Characters of text below each element, without what is skipped."""
        out = [0] * len(self.paths)
        for element, text in self.blocks:
            if element >= 0 and not self.skipped[element]:
                while element >= 0:
                    out[element] += len(text)
                    element = self.parents[element]
        return out

    def text(self, content: str | None) -> str:
        """Text below the elements with the path ``content``; None: the page's own best guess."""
        inside = [False] * len(self.paths)
        if content is None or content not in self.paths:
            sizes = self.chars()
            best = choose([(p, r, c) for p, r, c, s in zip(self.paths, self.ranks, sizes, self.skipped, strict=True) if not s])
            content = best
        if content is None:
            chosen = [t for e, t in self.blocks if e < 0 or not self.skipped[e]]
            return " ".join(chosen)
        out = []
        for i, parent in enumerate(self.parents):
            inside[i] = self.paths[i] == content or (parent >= 0 and inside[parent])
        for element, text in self.blocks:
            if element >= 0 and inside[element] and not self.skipped[element]:
                out.append(text)
        return " ".join(out)


def choose(candidates: list[tuple[str, int, int]]) -> str | None:
    """The content element among (path, rank of its name, characters below it)."""
    full = [c for c in candidates if c[2] > 0]
    if not full:
        return None
    best = max(r for _, r, _ in full)
    if best >= 2:
        return min((-c, len(p), p) for p, r, c in full if r == best)[2]
    # No name promises content: the deepest element that still holds most of the text.
    most = max(c for _, _, c in full)
    return min((-p.count("/"), -c, p) for p, _, c in full if c >= 0.8 * most)[2]


def _signed(digest: int) -> int:
    return digest - ((digest >> 63) << 64)


def text_token(path: str, text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(f"{path}\0{text}"))


def host_of(url: str) -> F.Column:
    """Lower-case host of a URL; null or no URL: the empty host."""
    pattern = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
    return F.coalesce(F.regexp_extract(F.lower(F.trim(url)), pattern, 1), F.lit(""))


_TEXT = -2


def page_tokens(pages: DataFrame) -> DataFrame:
    """(host, token, path, rank, pages, vector, chars) from (host, html): sums over the pages of a batch.

    rank is ``_TEXT`` for text tokens; token 0 counts the pages themselves.
    """
    ddl = "host string, token long, path string, rank int, pages long, vector long, chars long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            sums: dict[tuple[str, int], list] = {}
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                number += 1
                page = Page(html or "")
                counts: dict[int, list] = {0: [1, None, 0, 0]}
                for path, rank, chars, skip in zip(page.paths, page.ranks, page.chars(), page.skipped, strict=True):
                    at = counts.setdefault(_signed(xxhash.xxh64_intdigest(path)), [0, path, -1 if skip else rank, 0])
                    at[0] += 1
                    at[3] += chars
                for element, text in page.blocks:
                    at = counts.setdefault(text_token(page.path_of(element), text), [0, page.path_of(element), _TEXT, 0])
                    at[0] += 1
                    at[3] += len(text) if element >= 0 and not page.skipped[element] else 0
                for token, (count, path, rank, chars) in counts.items():
                    mark = _signed(xxhash.xxh64_intdigest(f"{number}:{count}"))
                    at = sums.setdefault((host, token), [path, rank, 0, 0, 0])
                    at[2] += 1
                    at[3] ^= mark
                    at[4] += chars
            rows = [(*k, *v) for k, v in sums.items()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return pages.select("host", "html").mapInArrow(run, ddl)


def templates(pages: DataFrame) -> DataFrame:
    """(host, content): the content element of every host with enough different pages."""
    different = pages.select("host", "html").dropDuplicates(["host", "html"])
    sums = keep(
        page_tokens(different).groupBy("host", "token").agg(
            F.min("path").alias("path"), F.max("rank").alias("rank"), F.sum("pages").alias("pages"),
            F.bit_xor("vector").alias("vector"), F.sum("chars").alias("chars")).filter("pages > 1"), "page-tokens")
    hosts = sums.filter(f"token = 0 AND pages >= {LEAST_PAGES}").select(
        "host", F.col("pages").alias("all_pages"), F.col("vector").alias("root"))
    common = sums.filter("token <> 0").join(hosts, "host").filter(F.col("pages") >= LEAST_SHARE * F.col("all_pages"))
    size = F.count("*").over(Window.partitionBy("host", "vector", "pages"))
    valid = common.withColumn("size", size)
    constant = f"rank = {_TEXT} AND pages = all_pages AND vector = root AND chars > 0"
    tokens = valid.filter(f"rank > {_TEXT} AND size > 1 OR {constant}").groupBy("host").agg(
        F.collect_list(F.struct("path", "rank", "chars")).alias("tokens"))

    def nest(column: pa.Array) -> pa.Array:
        out = []
        for tokens in column.to_pylist():
            elements = [e for e in tokens if e["rank"] > _TEXT]
            known = {e["path"] for e in elements}
            constants: dict[str, int] = {}  # characters of constant text below each path
            for e in tokens:
                path = e["path"] if e["rank"] == _TEXT else ""
                while path:
                    constants[path] = constants.get(path, 0) + e["chars"]
                    path = path.rpartition("/")[0]

            def nested(path: str) -> bool:
                while "/" in path:
                    path = path.rpartition("/")[0]
                    if path not in known:
                        return False
                return True

            out.append(choose([
                (e["path"], e["rank"], e["chars"] - constants.get(e["path"], 0))
                for e in elements if e["rank"] >= 0 and nested(e["path"])]))
        return pa.array(out, pa.string())

    return tokens.select("host", F.arrow_udf(nest, "string")("tokens").alias("content"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text) of every row; null html, or no main text: the empty text.

    Character references are decoded; white space inside a block is one space; blocks are
    joined by one space in page order. Repeated rows give repeated results and count as
    one page. Templates are joined to pages by host: a table of the hosts.
    """
    rows = pages.select(F.col(key), F.col(url), F.col(html).alias("html"), host_of(url).alias("host"))
    known = keep(templates(rows), "templates").withColumnRenamed("host", "of_host")

    def read(html_column: pa.Array, content: pa.Array) -> pa.Array:
        pages = zip(html_column.to_pylist(), content.to_pylist(), strict=True)
        return pa.array([Page(text or "").text(path) for text, path in pages], pa.string())

    joined = rows.join(known, F.col("host") == F.col("of_host"), "left")
    return joined.select(key, url, F.arrow_udf(read, "string")("html", "content").alias("text"))

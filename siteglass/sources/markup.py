"""Stored pages -> one row per page with its element array.

The only per-row Python of the batch side: a tag scanner that keeps an open-element stack.
It runs once per page in ``mapInArrow`` and writes Arrow buffers directly; every extraction
rule and feature is a column expression over the result (see ``functions.select``).
"""

from __future__ import annotations

import html as htmllib
import json
import re
from collections.abc import Callable, Iterator
from functools import partial
from html.entities import html5

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

NODE = T.StructType(
    [
        T.StructField("i", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("last", T.IntegerType()),
        T.StructField("cls", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.StringType()),
        T.StructField("a", T.IntegerType()),
        T.StructField("b", T.IntegerType()),
        T.StructField("ka", T.IntegerType()),
        T.StructField("kb", T.IntegerType()),
    ]
)

# --- fixed values: HTML element classes -------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
ESCAPED_RAW = frozenset(("textarea", "title"))
HEAD_ONLY = frozenset("html head title meta link base script style template noscript".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl dt dd li fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
SCOPE = frozenset("html table td th caption template button object marquee applet".split())
LIST_STOP = SCOPE | frozenset("ul ol dl menu body article aside section main nav header footer blockquote form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SIBLING_ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "a": ("a",), "option": ("option",),
    "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "button": ("button",),
}
TEXT_TAGS = HEADINGS | frozenset("a dt dd title".split())
BOILERPLATE = frozenset("script style nav footer header aside".split())
# Attributes the selectors look at; class and id have columns of their own. Others (style, data-*, handlers)
# stay behind in the scanner.
KEPT_ATTRS = frozenset("alt content datetime href itemprop media name property rel role src srcset type".split())
# ----------------------------------------------------------------------------

_ATTR = r"[\s/]+[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+))?"
_TOKEN = re.compile(
    r"<!--(?P<c>.*?)(?:-->|\Z)|<[!?][^>]*>"
    r"|</(?P<e>[a-zA-Z][^\s/>]*+)[^>]*>"
    r"|<(?P<s>[a-zA-Z][^\s/>]*+)(?P<at>(?:" + _ATTR + r")*+[\s/]*+|[^>]*)>",
    re.S,
)
_ATTRS = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?", re.S)
_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


def _closed(text: str) -> str:
    """Character references that end in a semicolon; one cut before it stays as it is written."""
    return _CLOSED.sub(lambda m: htmllib.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


def _attributes(source: str, unescape: Callable[[str], str]) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, dq, sq, bare in _ATTRS.findall(source):
        value = dq or sq or bare
        found.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return found


class Page:
    """Elements and text of one page. HTML reads ``&amp`` without a semicolon too; ``closed_references`` leaves it as it is."""

    def __init__(self, source: str, closed_references: bool = False):
        self._unescape = _closed if closed_references else htmllib.unescape
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.last: list[int] = []
        self.attrs: list[dict[str, str]] = []
        self.a: list[int] = []
        self.b: list[int] = []
        self.ka: list[int | None] = []
        self.kb: list[int | None] = []
        self._text: list[str] = []
        self._kept: list[str] = []
        self._n = self._k = self._muted = 0
        self._stack: list[int] = []
        self._body = False
        self._scan(source)
        while self._stack:
            self._close()
        self.text = "".join(self._text)
        self.kept = "".join(self._kept)

    def _scan(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            if m is None:
                self._add_text(self._unescape(source[at:]))
                return
            if m.start() > at:
                self._add_text(self._unescape(source[at : m.start()]))
            at = m.end()
            if m["s"]:
                name = m["s"].lower()
                self._start(name, _attributes(m["at"], self._unescape))
                if name in RAW:
                    stop = _RAW_END[name].search(source, at)
                    raw = source[at : stop.start() if stop else end]
                    self._put(self._unescape(raw) if name in ESCAPED_RAW else raw)
                    at = stop.start() if stop else end
            elif m["e"]:
                self._end(m["e"].lower())

    def _put(self, text: str) -> None:
        self._text.append(text)
        self._n += len(text)
        if not self._muted:
            self._kept.append(text)
            self._k += len(text)

    def _add_text(self, text: str) -> None:
        if not self._body and text.strip() and not self._inside("title", "textarea"):
            self._open_body()
        self._put(text)

    def _inside(self, *names: str) -> bool:
        return bool(self._stack) and self.tags[self._stack[-1]] in names

    def _open_body(self, attrs: dict[str, str] | None = None) -> None:
        while self._stack and self.tags[self._stack[-1]] != "html":
            self._close()
        self._body = True
        self._push("body", attrs or {})

    def _push(self, name: str, attrs: dict[str, str]) -> None:
        i = len(self.tags)
        hidden = name in BOILERPLATE or attrs.get("role") == "navigation"
        self._muted += hidden
        seen = None if self._muted else self._k
        self.tags.append(name)
        self.parents.append(self._stack[-1] if self._stack else -1)
        self.last.append(i)
        self.attrs.append(attrs)
        self.a.append(self._n)
        self.b.append(self._n)
        self.ka.append(seen)
        self.kb.append(seen)
        if name not in VOID:
            self._stack.append(i)
        else:
            self._muted -= hidden

    def _close(self) -> None:
        i = self._stack.pop()
        self.last[i] = len(self.tags) - 1
        self.b[i] = self._n
        if self.ka[i] is not None:
            self.kb[i] = self._k
        self._muted -= self.tags[i] in BOILERPLATE or self.attrs[i].get("role") == "navigation"

    def _close_to(self, names: tuple[str, ...], stop: frozenset[str]) -> bool:
        """Close elements up to the nearest open one of ``names``, unless ``stop`` comes first."""
        for depth in range(len(self._stack) - 1, -1, -1):
            open_tag = self.tags[self._stack[depth]]
            if open_tag in names:
                while len(self._stack) > depth:
                    self._close()
                return True
            if open_tag in stop:
                return False
        return False

    def _start(self, name: str, attrs: dict[str, str]) -> None:
        if name == "body":
            if not self._body:
                self._open_body(attrs)
            return
        if name in ("html", "head") and (name in self.tags[:4] or self._body):
            return
        if not self._body and name not in HEAD_ONLY:
            self._open_body()
        if name in ENDS_PARAGRAPH:
            self._close_to(("p",), SCOPE)
        if name in HEADINGS and self._inside(*HEADINGS):
            self._close()
        if name in SIBLING_ENDS:
            self._close_to(SIBLING_ENDS[name], SCOPE - {"td", "th", "button"} if name in ("tr", "td", "th", "button") else LIST_STOP)
        self._push(name, attrs)

    def _end(self, name: str) -> None:
        if name in ("body", "html") or name in VOID:
            return
        names = tuple(HEADINGS) if name in HEADINGS else (name,)
        stop = frozenset(("html", "body")) if name in SCOPE else SCOPE - {"button"}
        if not self._close_to(names, stop) and name == "p" and self._body:
            self._push("p", {})
            self._close()


def _is_ld(page: Page, i: int) -> bool:
    return page.tags[i] == "script" and (page.attrs[i].get("type") or "").lower() == "application/ld+json"


def _schema_types(value: object, into: dict[str, None]) -> None:
    """Every ``@type`` of a JSON-LD value, outer before inner."""
    pending = [value]
    while pending:
        item = pending.pop()
        if isinstance(item, dict):
            kind = item.get("@type")
            for t in kind if isinstance(kind, list) else [kind]:
                if isinstance(t, str) and t:
                    into.setdefault(t)
            pending.extend(v for v in reversed(list(item.values())) if isinstance(v, (dict, list)))
        elif isinstance(item, list):
            pending.extend(v for v in reversed(item) if isinstance(v, (dict, list)))


_NODE_ARROW = pa.struct(
    [
        ("i", pa.int32()), ("tag", pa.string()), ("parent", pa.int32()), ("last", pa.int32()), ("cls", pa.string()), ("id", pa.string()),
        ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()),
        ("a", pa.int32()), ("b", pa.int32()), ("ka", pa.int32()), ("kb", pa.int32()),
    ]
)


def _parse_batch(batch: pa.RecordBatch, closed_references: bool) -> pa.RecordBatch:
    texts, kepts, lds, types = [], [], [], []
    node_offsets, attr_offsets = [0], [0]
    own, tag, parent, last, cls, ident, text, a, b, ka, kb = ([] for _ in range(11))
    keys: list[str] = []
    values: list[str] = []
    for source in batch.column("__html").to_pylist():
        page = Page(source or "", closed_references)
        texts.append(page.text)
        kepts.append(page.kept)
        found: dict[str, None] = {}
        blocks = []
        for i, name in enumerate(page.tags):
            attrs = page.attrs[i]
            names = attrs.get("class")
            cls.append(None if names is None else " " + " ".join(names.split()) + " ")
            ident.append(attrs.get("id"))
            for key in KEPT_ATTRS & attrs.keys():
                keys.append(key)
                values.append(attrs[key])
            attr_offsets.append(len(keys))
            text.append(page.text[page.a[i] : page.b[i]] if name in TEXT_TAGS else None)
            if _is_ld(page, i):
                raw = page.text[page.a[i] : page.b[i]]
                try:
                    parsed = json.loads(raw)
                except (ValueError, RecursionError):
                    continue
                blocks.append(raw)
                _schema_types(parsed, found)
        lds.append(blocks)
        types.append(list(found))
        own.extend(range(len(page.tags)))
        tag += page.tags
        parent += page.parents
        last += page.last
        a += page.a
        b += page.b
        ka += page.ka
        kb += page.kb
        node_offsets.append(len(tag))
    attrs_array = pa.MapArray.from_arrays(
        pa.array(attr_offsets, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string())
    )
    columns = [
        pa.array(own, pa.int32()), pa.array(tag, pa.string()), pa.array(parent, pa.int32()), pa.array(last, pa.int32()),
        pa.array(cls, pa.string()), pa.array(ident, pa.string()), attrs_array, pa.array(text, pa.string()),
        pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(ka, pa.int32()), pa.array(kb, pa.int32()),
    ]
    nodes = pa.ListArray.from_arrays(
        pa.array(node_offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_NODE_ARROW))
    )
    strings = pa.list_(pa.string())
    kept_columns = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "__html"]
    kept_names = [n for n in batch.schema.names if n != "__html"]
    return pa.RecordBatch.from_arrays(
        kept_columns
        + [pa.array(texts, pa.string()), pa.array(kepts, pa.string()), nodes, pa.array(lds, strings), pa.array(types, strings)],
        names=kept_names + ["page_text", "kept_text", "nodes", "json_ld", "schema_types"],
    )


# Markup per output batch: pages differ in size by orders of magnitude, and elements take more room than markup.
SLICE_BYTES = 4 * 1024 * 1024


def _parse(batches: Iterator[pa.RecordBatch], closed_references: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start = size = 0
        for row, length in enumerate(pc.binary_length(batch.column("__html")).to_pylist()):
            if size and size + (length or 0) > SLICE_BYTES:
                yield _parse_batch(batch.slice(start, row - start), closed_references)
                start, size = row, 0
            size += length or 0
        yield _parse_batch(batch.slice(start), closed_references)


def parse_pages(pages: DataFrame, html: Column | str = "html", closed_references: bool = False) -> DataFrame:
    """Replace the markup column by ``page_text``, ``kept_text``, ``nodes``, ``json_ld``, ``schema_types``.

    Elements keep the attributes in ``KEPT_ATTRS``. ``json_ld`` holds the JSON-LD blocks that parse; ``html_length`` keeps the markup size.
    With ``closed_references`` only character references that end in a semicolon are read, as SQL's replacements do; HTML itself also reads some without.
    """
    source = F.col(html) if isinstance(html, str) else html
    name = html if isinstance(html, str) else None
    keep = [c for c in pages.columns if c != name]
    shaped = pages.select(*keep, F.coalesce(F.length(source), F.lit(0)).alias("html_length"), source.alias("__html"))
    out = T.StructType(
        [f for f in shaped.schema.fields if f.name != "__html"]
        + [
            T.StructField("page_text", T.StringType()),
            T.StructField("kept_text", T.StringType()),
            T.StructField("nodes", T.ArrayType(NODE)),
            T.StructField("json_ld", T.ArrayType(T.StringType())),
            T.StructField("schema_types", T.ArrayType(T.StringType())),
        ]
    )
    return shaped.mapInArrow(partial(_parse, closed_references=closed_references), out)

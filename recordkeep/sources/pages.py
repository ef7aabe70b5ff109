"""Landed pages to rows: detail pages, listing cards and tag sections, after decoding.

Which containers and labels a site uses is a parameter (:class:`Layout`). The small parser only runs inside Spark
jobs, once per page; everything after it is DataFrame operations.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from typing import NamedTuple
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from recordkeep.functions import keys, text, values
from recordkeep.functions.urls import pick_cover, query_id

# The markup language's elements without an end, and how a page declares its charset.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHARSET = re.compile(rb"<meta\b[^>]*?charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)


@dataclass(frozen=True)
class Layout:
    """How a site marks up its pages. The defaults are fixed values: the containers and labels of the site served today."""

    base: str = "https://www.example.com"
    record_path: str = "/product/index.php"
    record_param: str = "product_id"
    tag_path: str = "/search/index.php"
    tag_param: str = "tag_id"
    title_box: str = "works_pic"
    fields_box: str = "works_txt"
    card_class: str = "thumbox"
    cover_name: str = "pac_s.jpg"
    code_label: str = "作品番号"
    names_label: str = "出演女優"
    date_label: str = "DVDリリース日"
    name_classes: tuple[str, ...] = ("yaku", "actor", "actress")
    tag_groups: tuple[tuple[str, str], ...] = (("ジャンルタグ", "genre"), ("キャラクタータグ", "character"))


class _Mark(NamedTuple):
    """What stands between the brackets of a tag; the name of an end begins with its slash."""

    tag: str
    attrs: dict[str, str]
    classes: frozenset[str]


class _Nest:
    """Where elements end, and between which texts they lie, by the order of their tags; an end without a beginning is passed over."""

    __slots__ = ("ends", "froms", "tos", "open")

    def __init__(self) -> None:
        self.ends: list[int] = []
        self.froms: list[int] = []
        self.tos: list[int] = []
        self.open: list[tuple[str, int]] = []

    def begin(self, tag: str, texts: int) -> None:
        at = len(self.ends)
        self.ends.append(at + 1)
        self.froms.append(texts)
        self.tos.append(texts)
        if tag not in VOID and tag != "#comment":
            self.open.append((tag, at))

    def finish(self, tag: str, texts: int) -> None:
        opened = self.open
        for k in range(len(opened) - 1, -1, -1):
            if opened[k][0] == tag:
                self._end(k, texts)
                return

    def _end(self, k: int, texts: int) -> None:
        """End all elements that are open from the ``k``-th on."""
        for _, at in self.open[k:]:
            self.ends[at], self.tos[at] = len(self.ends), texts
        del self.open[k:]

    def close(self, texts: int) -> None:
        self._end(0, texts)


class _Page:
    """Marks and texts in page order. It does not hold its elements, which hold it, so a page that was read is let go at once."""

    __slots__ = ("marks", "texts", "nest", "own")

    def __init__(self, marks: Sequence[_Mark], texts: Sequence[str], nest: _Nest, own: dict[int, list[str]]):
        self.marks, self.texts, self.nest, self.own = marks, texts, nest, own


class _Element:
    """An element of a page. Elements and texts stand in page order, so what is inside one is a slice of each."""

    __slots__ = ("page", "at", "tag", "attrs", "classes")

    def __init__(self, page: _Page, at: int):
        self.page, self.at = page, at
        self.tag, self.attrs, self.classes = page.marks[at]

    def all(self) -> list[_Element]:
        page = self.page
        return [_Element(page, k) for k in range(self.at + 1, page.nest.ends[self.at])]

    def of(self, *tags: str) -> list[_Element]:
        """Those of :meth:`all` with these tags."""
        page, marks = self.page, self.page.marks
        return [_Element(page, k) for k in range(self.at + 1, page.nest.ends[self.at]) if marks[k][0] in tags]

    def text(self) -> str:
        """The words inside, without those of comments, scripts and styles in it."""
        page, at = self.page, self.at
        return " ".join(" ".join(page.own.get(at, ()) if self.tag in _HIDDEN else page.texts[page.nest.froms[at] : page.nest.tos[at]]).split())


def _classes(attrs: dict[str, str]) -> frozenset[str]:
    return frozenset(attrs["class"].lower().split()) if "class" in attrs else _NONE


_NONE: frozenset[str] = frozenset()
_HIDDEN = ("script", "style")


class _Builder(HTMLParser):
    """Any markup, by the events of a parser."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = _Page([], [], _Nest(), {})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        found = {k: v or "" for k, v in attrs}
        self._add(_Mark(tag, found, _classes(found)))

    def handle_comment(self, data: str) -> None:
        self._add(_Mark("#comment", {"data": data}, _NONE))

    def _add(self, mark: _Mark) -> None:
        self.page.marks.append(mark)
        self.page.nest.begin(mark.tag, len(self.page.texts))

    def handle_endtag(self, tag: str) -> None:
        self.page.nest.finish(tag, len(self.page.texts))

    def handle_data(self, data: str) -> None:
        opened = self.page.nest.open
        if opened and opened[-1][0] in _HIDDEN:
            self.page.own.setdefault(opened[-1][1], []).append(data)
        else:
            self.page.texts.append(data)


#: Plain markup: texts, tags whose attributes are quoted, and comments; nothing that parsers read in several ways.
_TAG = re.compile(r"""([A-Za-z][A-Za-z0-9]*)((?:[ \t\n]+[A-Za-z][A-Za-z0-9_-]*="[^"<&]*")*)|(/[A-Za-z][A-Za-z0-9]*)""")
_ATTR = re.compile(r"""([A-Za-z][A-Za-z0-9_-]*)="([^"]*)\"""")
#: A comment, or what may be a tag.
_BRACKETS = re.compile(r"<(?:!--(?![>-])([^-]*(?:-[^-]+)*)--|([^>]*))>")
#: Elements whose content is not markup, in one version of the parser or another.
_RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript plaintext svg math".split())


@lru_cache(8192)
def _plain_tag(inside: str) -> _Mark | None:
    """The mark of a plain tag; null for what is not plain."""
    found = _TAG.fullmatch(inside)
    if found is None or found[1] and found[1].lower() in _RAW:
        return None
    if found[3]:
        return _Mark(found[3].lower(), {}, _NONE)
    attrs = {k.lower(): v for k, v in _ATTR.findall(found[2])}
    return _Mark(found[1].lower(), attrs, _classes(attrs))


def _outline(tags: tuple[str, ...]) -> tuple[_Nest, list[int]]:
    """How the tags of a page nest, a text before and behind each, and which of them begin an element."""
    nest, begins = _Nest(), []
    for k, tag in enumerate(tags):
        if tag[0] == "/":
            nest.finish(tag[1:], k + 1)
        else:
            begins.append(k)
            nest.begin(tag, k + 1)
    nest.close(len(tags) + 1)
    return nest, begins


#: Pages of a site share few outlines; only short ones are kept.
_short_outline = lru_cache(1024)(_outline)
_SHORT = 500


def _plain(html: str) -> _Page | None:
    """The page if all of it is plain markup, as :class:`_Builder` reads it but much faster."""
    if html.rfind(">") < html.rfind("<"):
        return None
    if "<!" in html:
        parts = _BRACKETS.split(html)
        texts, notes, insides = parts[::3], parts[1::3], parts[2::3]
    else:
        first, *parts = html.split("<")
        pairs = [p.split(">", 1) for p in parts]
        texts, notes, insides = [first, *[p[-1] for p in pairs]], (), [p[0] for p in pairs]
    if "&" in html:
        if "&" in texts[-1]:
            return None  # a last text may end within a reference
        texts = [unescape(t) if "&" in t else t for t in texts]
    marks = list(map(_plain_tag, insides)) if not notes else [_Mark("#comment", {"data": n}, _NONE) if n else _plain_tag(i) for n, i in zip(notes, insides, strict=True)]
    if None in marks:
        return None
    tags = tuple([m[0] for m in marks])
    nest, begins = _short_outline(tags) if len(tags) <= _SHORT else _outline(tags)
    return _Page([marks[k] for k in begins], texts, nest, {})


def _closed(page: _Page) -> list[_Element]:
    return [_Element(page, k) for k in range(len(page.marks))]


def _general(html: str) -> _Page:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    builder.page.nest.close(len(builder.page.texts))
    return builder.page


def _any(html: str) -> list[_Element]:
    """The elements of any markup in page order."""
    return _closed(_general(html))


def _page(html: str | None) -> _Page:
    page = _plain(html or "")
    return _general(html or "") if page is None else page


def _tree(html: str | None) -> list[_Element]:
    """The elements of a page in page order."""
    return _closed(_page(html))


def decode(body: bytes | None, header: str | None = None) -> str | None:
    """Text of a landed page, decoded strictly: by the charset that the header declares, else the markup's, else UTF-8 or CP932.

    A declared charset is the only one that is tried: where it fails, or is unknown, the text is null.
    """
    if body is None:
        return None
    named = re.search(r"charset\s*=\s*[\"']?([^\s;\"']+)", header or "", re.I)
    declared = named[1] if named else next((m.decode("ascii") for m in CHARSET.findall(body[:4096])), None)
    for name in [declared] if declared else ["utf-8", "cp932"]:
        try:
            return body.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return None


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` that pages are made of, or pages, in as many tasks as a shuffle has, or three a core if that is more.

    Reading a page takes far longer than its bytes say: one row group of narrow rows can hold a million pages. So neither
    the splits of files nor sizes of shuffles say how many tasks there should be.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), key)


def decoded(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, body, content_type) -> page_id, html; null for undecodable bytes. UTF-8 needs no Python."""
    plain = F.try_validate_utf8(F.col("body").cast("string"))
    no_hint = ~F.coalesce(F.col("content_type").rlike("(?i)charset"), F.lit(False)) & ~F.col("body").cast("string").rlike("(?i)<meta[^>]*charset")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            found = [decode(bytes(b) if b is not None else None, h) for b, h in zip(frame["body"], frame["content_type"], strict=True)]
            yield pd.DataFrame({"page_id": frame["page_id"], "html": found})

    easy = F.coalesce(no_hint & plain.isNotNull(), F.lit(False))
    rest = pages.where(~easy).select("page_id", "body", "content_type").mapInPandas(run, "page_id long, html string")
    return pages.where(easy).select("page_id", plain.alias("html")).unionByName(rest)


def _names(inside: list[_Element], layout: Layout, comments: bool) -> list[str]:
    """Names among the elements of a box."""
    wanted = layout.name_classes
    holders = [e for e in inside if e.classes and not e.classes.isdisjoint(wanted)]
    found: list[str] = []
    for h in holders:
        links = [a.text() for a in h.all() if a.tag == "a"]
        found += links or [h.text()]
    if not holders:
        found += [a.text() for a in inside if a.tag == "a" and layout.record_path not in a.attrs.get("href", "")]
    if comments:
        for e in inside:
            if e.tag == "#comment" and "<" in e.attrs["data"]:
                found += _noted_names(e.attrs["data"], layout)
    return found


@lru_cache(1024)
def _noted_names(comment: str, layout: Layout) -> tuple[str, ...]:
    """Names in a comment with markup; the same names stand on many cards."""
    return tuple(_names(_tree(_BREAKS.split(_LABEL.sub("", comment), maxsplit=1)[0]), layout, False))


_LABEL, _BREAKS, _SPACES, _HEADING = re.compile(r"^.*?出演\s*[:：]?", re.S), re.compile(r"(?i)<br\s*/?>"), re.compile(r"[\s:：]+"), re.compile("h[1-6]")


@lru_cache(1024)
def _label(shown: str) -> str:
    return _SPACES.sub("", shown)


def _fields(inside: list[_Element]) -> dict[str, _Element]:
    """Label (without colons and spaces) -> value element, of definition lists."""
    out: dict[str, _Element] = {}
    name = None
    for e in inside:
        if e.tag == "dt":
            name = _label(e.text())
        elif e.tag == "dd" and name:
            out.setdefault(name, e)
            name = None
    return out


@lru_cache(4096)
def _joined(base: str, address: str) -> str:
    return urljoin(base, address)


def _covers(inside: list[_Element], layout: Layout) -> list[str]:
    return [_joined(layout.base, e.attrs["src"]) for e in inside if e.tag == "img" and f"/{layout.cover_name}" in e.attrs.get("src", "").lower()]


BOXES = "code_text string, title string, names array<string>, date_text string, covers array<string>"
TAGS = "tags array<struct<href:string,group:string,name:string>>"
IMAGES = "images array<string>"
CARD = "page_id long, at int, hrefs array<string>, code_text string, title string, names array<string>, date_text string, covers array<string>"


def _boxes(page: _Page, layout: Layout) -> tuple:
    """The cells of BOXES; all are null on a page without its boxes."""
    found = {m.attrs["id"]: _Element(page, k) for k, m in enumerate(page.marks) if m.attrs and m.attrs.get("id") in (layout.title_box, layout.fields_box)}
    pic, txt = found.get(layout.title_box), found.get(layout.fields_box)
    if pic is None or txt is None:
        return None, None, None, None, None
    shown = pic.of("h5", "img")
    title = next((e.text() for e in shown if e.tag == "h5"), None)
    fields = _fields(txt.of("dt", "dd"))
    get = lambda label: fields[label].text() if label in fields else ""
    box = fields.get(layout.names_label)
    names = [] if box is None else [a.text() for a in box.of("a")] or _names(box.all(), layout, False)
    return get(layout.code_label), title, names, get(layout.date_label), _covers(shown, layout)


def _tags(page: _Page, layout: Layout) -> tuple:
    """The cell of TAGS: links of the known sections as (href, group, name)."""
    groups, tags = dict(layout.tag_groups), []
    with_id = [(k, m.attrs["id"]) for k, m in enumerate(page.marks) if "id" in m.attrs]
    for section in (_Element(page, k) for k, i in with_id if i == "tag"):
        last = page.nest.ends[section.at]
        head = next((_Element(page, k).text() for k, i in with_id if section.at < k < last and i == "tag_header"), "")
        if group := groups.get(head):
            tags += [(a.attrs.get("href", ""), group, a.text()) for a in section.of("a")]
    return (tags,)


def _images(page: _Page, layout: Layout) -> tuple:
    """The cell of IMAGES: addresses of large ones."""
    return ([_joined(layout.base, m.attrs[k]) for m in page.marks if m.attrs for k in ("href", "src", "data-src") if k in m.attrs and m.attrs[k].lower().endswith("_l.jpg")],)


_READERS = {BOXES: _boxes, TAGS: _tags, IMAGES: _images}


def raw_details(pages: DataFrame, layout: Layout = Layout(), parts: tuple[str, ...] = (BOXES, TAGS, IMAGES)) -> DataFrame:
    """What a detail page says, unparsed: page_id and the columns of ``parts``."""
    readers = [_READERS[p] for p in parts]

    def rows_of(page_id: int, html: str | None) -> list[tuple]:
        page = _page(html)
        return [(page_id, *[cell for read in readers for cell in read(page, layout)])]

    return _parsed(pages, rows_of, ", ".join(["page_id long", *parts]))


def _parsed(pages: DataFrame, rows_of: Callable[[int, str | None], list[tuple]], schema: str) -> DataFrame:
    """The rows that ``rows_of`` finds on each page."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in rows_of(i, h)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return pages.select("page_id", "html").mapInArrow(run, schema)


def detail_records(pages: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Detail pages -> record rows; code is null where a required part is missing."""
    raw = raw_details(pages, layout, (BOXES,)).withColumn("code", keys.embedded(F.col("code_text")))
    raw = raw.withColumn("code", keys.extract_code(F.col("code")))
    raw = raw.withColumns({"cover": pick_cover(F.col("covers"), F.col("code")), "title": text.collapse(F.col("title"))})
    code, cover = F.col("code"), F.col("cover")
    raw = raw.withColumn("whole", code.isNotNull() & (F.col("title") != "") & cover.isNotNull())
    whole = F.col("whole")
    return raw.select(
        "page_id",
        F.when(whole, code).alias("code"),
        F.when(whole, F.col("title")).alias("title"),
        F.when(whole, text.distinct_names(F.col("names"))).alias("actors"),
        F.when(whole, values.normalize_date(F.col("date_text"))).alias("release_date"),
        F.when(whole, cover).alias("cover"),
    )


def page_tags(pages: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """(page_id, id, group, name): tags of the known sections, the first of an id."""
    rows = raw_details(pages, layout, (TAGS,)).select("page_id", F.posexplode("tags").alias("at", "t"))
    rows = rows.select("page_id", "at", query_id(F.col("t.href"), layout.tag_path, layout.tag_param).alias("id"), F.col("t.group").alias("group"), text.collapse(F.col("t.name")).alias("name")).where("id is not null and name <> ''")
    return rows.groupBy("page_id", "id").agg(F.min_by("group", "at").alias("group"), F.min_by("name", "at").alias("name"))


def listing_cards(pages: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Listing pages -> one row per card: product_id, code and the rest, and whether the card was parsed."""

    def one(page_id: int, html: str | None) -> list[tuple]:
        rows = []
        for at, card in enumerate(e for e in _tree(html) if layout.card_class in e.classes):
            inside = card.all()
            links = [a for a in inside if a.tag == "a"]
            title = next((e.text() for e in inside if _HEADING.fullmatch(e.tag)), None) or next((e.text() for e in inside if "title" in e.classes), None)
            title = title or next((t for a in links if layout.record_param in a.attrs.get("href", "") and (t := a.text())), None)
            whole = card.text()
            behind = whole.partition(title)[2] if title else ""
            fields = _fields(inside)
            date = fields[layout.date_label].text() if layout.date_label in fields else whole
            rows.append((page_id, at, [a.attrs.get("href", "") for a in links], f"{behind} | {whole}", title, _names(inside, layout, True), date, _covers(inside, layout)))
        return rows

    # each column that several others use is made in a step of its own, which Spark does not compute again for each use
    raw = _parsed(pages, one, CARD).withColumn("code", keys.embedded(F.col("code_text")))
    raw = raw.withColumn("code", keys.extract_code(F.col("code")))
    code = F.col("code")
    ids = F.filter(F.transform("hrefs", lambda h: query_id(h, layout.record_path, layout.record_param)), lambda x: x.isNotNull())
    raw = raw.withColumns({"product_id": F.get(ids, F.lit(0)), "cover": pick_cover(F.col("covers"), code), "title": text.collapse(F.col("title"))})
    record_id, cover = F.col("product_id"), F.col("cover")
    parsed = record_id.isNotNull() & code.isNotNull() & (F.col("title") != "") & cover.isNotNull()
    raw, parsed = raw.withColumn("parsed", F.coalesce(parsed, F.lit(False))), F.col("parsed")
    keep = lambda c: F.when(parsed, c)
    return raw.select(
        "page_id",
        "at",
        "product_id",
        "parsed",
        keep(code).alias("code"),
        keep(F.col("title")).alias("title"),
        keep(text.distinct_names(F.col("names"))).alias("actors"),
        keep(values.normalize_date(F.regexp_extract("date_text", r"((?:19|20)[0-9]{2}[/-][0-9]{1,2}[/-][0-9]{1,2})", 1))).alias("release_date"),
        keep(cover).alias("cover"),
    )


def listing_records(cards: DataFrame) -> DataFrame:
    """The parsed cards of :func:`listing_cards`, of several with one id on a page the first."""
    first = Window.partitionBy("page_id", "product_id").orderBy("at")
    return cards.where("parsed").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def link_texts(pages: DataFrame) -> DataFrame:
    """(page_id, links, title): simple facts of regular markup, without Python."""
    return pages.select("page_id", F.regexp_count("html", F.lit("<a href=")).alias("links"), text.collapse(F.regexp_extract("html", r"<title>([^<]*)</title>", 1)).alias("title"))

"""HTML pages: elements by the standard parser in Arrow batches, and what the engine keeps of them by array functions."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.dialect import SPARK

#: A page as its elements: the text of each (pieces joined by blanks; as it stands), and where a link leads.
ELEMENTS = "id long, url string, elements array<struct<tag:string,text:string,raw:string,href:string,target:string>>, metas array<struct<name:string,property:string,itemprop:string,content:string>>, images int"
_ELEMENT = pa.list_(pa.struct([(k, pa.string()) for k in ("tag", "text", "raw", "href", "target")]))
_META = pa.list_(pa.struct([(k, pa.string()) for k in ("name", "property", "itemprop", "content")]))
_ARROW = pa.schema([("id", pa.int64()), ("url", pa.string()), ("elements", _ELEMENT), ("metas", _META), ("images", pa.int32())])
# Meta names, and limits of what is kept of a page.
AUTHOR_NAMES = frozenset(["citation_author", "dc.creator", "author"])
DOI_NAMES = frozenset(["citation_doi", "dc.identifier", "dc.identifier.doi", "prism.doi", "doi"])
MAX_HEADINGS, MAX_ANCHORS, MAX_LINKS, MAX_BLOCKS, LEAD_PARAGRAPHS, LEAD_CHARS, MAX_OUTLINE = 6, 160, 120, 120, 10, 1000, 10
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
KEPT = frozenset(["title", "a", "p", "li", "h1", "h2", "h3", "h4", "h5", "h6"])


class _Page(HTMLParser):
    """Collects the text pieces of the elements that matter, in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[tuple[str, dict, list[str]]] = []
        self.open: list[tuple[str, list[str] | None]] = []
        self.metas: list[dict] = []
        self.images = 0
        self.quiet = 0

    def handle_starttag(self, tag, attrs):
        found = {k: v or "" for k, v in attrs}
        if tag == "meta":
            self.metas.append(found)
        elif tag == "img":
            self.images += 1
        if tag in VOID:
            return
        self.quiet += tag in ("script", "style")
        pieces = [] if tag in KEPT else None
        if pieces is not None:
            self.elements.append((tag, found, pieces))
        self.open.append((tag, pieces))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                for gone, _ in self.open[k:]:
                    self.quiet -= gone in ("script", "style")
                del self.open[k:]
                return

    def handle_data(self, data):
        if not self.quiet:
            for _, pieces in self.open:
                if pieces is not None:
                    pieces.append(data)


def page_elements(html: str | None, url: str | None) -> dict:
    """The elements of one page. Null HTML is an empty page; a link that can't be resolved leads nowhere."""
    page = _Page()
    page.feed(html or "")
    page.close()

    def target(href: str) -> str:
        try:
            return urljoin(url or "", href.strip())
        except ValueError:
            return ""

    rows = [{"tag": tag, "text": " ".join(x for p in pieces if (x := p.strip())), "raw": "".join(pieces).strip(), "href": attrs.get("href"), "target": target(attrs["href"]) if "href" in attrs else None} for tag, attrs, pieces in page.elements]
    return {"url": url or "", "elements": rows, "metas": page.metas, "images": page.images}


#: Pages that a worker holds at a time.
BATCH = 500


def elements(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """The elements of pages (key, url, html), after the session's Arrow batches are held to BATCH rows: a worker has one at a time."""
    conf, name = pages.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH:
        conf.set(name, str(BATCH))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                rows = [{"id": r["id"], **page_elements(r["html"], r["url"])} for r in batch.slice(at, BATCH).to_pylist()]
                yield from pa.Table.from_pylist(rows, _ARROW).to_batches()

    return pages.selectExpr(f"{key} AS id", "url", "html").mapInArrow(work, ELEMENTS)


def _of(*tags: str) -> Column:
    return F.filter("elements", lambda e: e["tag"].isin(*tags))


def _texts(rows: Column, part: str = "text") -> Column:
    return F.transform(rows, lambda e: e[part])


def _meta(kind: str, name: str) -> Column:
    """The first content that a meta element of a name has."""
    found = F.filter("metas", lambda m: (m[kind] == name) & (F.trim(m["content"]) != ""))
    return F.coalesce(F.trim(F.get(found, F.lit(0))["content"]), F.lit(""))


def _said(names: frozenset) -> Column:
    """The contents of the meta elements that go by one of the names."""
    key = lambda m: F.lower(F.trim(F.coalesce(*(F.nullif(m[k], F.lit("")) for k in ("name", "property", "itemprop")), F.lit(""))))
    return F.filter(F.transform(F.filter("metas", lambda m: key(m).isin(*sorted(names))), lambda m: F.trim(m["content"])), lambda x: x != "")


def _links() -> Column:
    """The first different links that lead somewhere and say something."""
    follows = lambda e: (F.trim(e["href"]) != "") & (e["text"] != "") & ~F.trim(e["href"]).rlike("^(?:#|javascript:|mailto:)")
    told = F.transform(F.filter(F.slice(F.filter(_of("a"), lambda e: e["href"].isNotNull()), 1, MAX_ANCHORS), follows), lambda e: F.struct(e["text"].alias("text"), e["target"].alias("url")))
    same = lambda x: F.struct(F.lower(x["url"]), F.lower(x["text"]))
    first = lambda every: F.filter(every, lambda x, k: F.array_position(F.transform(every, same), same(x)) == k + 1)
    return F.slice(F.get(F.transform(F.array(told), first), F.lit(0)), 1, MAX_LINKS)


def parse_pages(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """What the engine keeps of pages (key, url, html)."""
    rows = elements(pages, key).withColumn("blocks", F.array_join(F.filter(_texts(F.slice(_of("p", "li"), 1, MAX_BLOCKS)), lambda x: x != ""), "\n"))
    heads = F.concat(*(_texts(F.slice(_of(f"h{k}"), 1, MAX_HEADINGS)) for k in range(1, 5)))
    outline = F.slice(F.concat(*(_outlined(k) for k in range(1, 7))), 1, MAX_OUTLINE)
    return rows.select(
        "id", "url", F.expr(T.normalize_document_text(SPARK, "blocks")).alias("text"), F.coalesce(F.get(_texts(_of("title")), F.lit(0)), F.lit("")).alias("title"),
        F.coalesce(F.try_element_at(_said(DOI_NAMES), F.lit(-1)), F.lit("")).alias("doi"), F.array_distinct(_said(AUTHOR_NAMES)).alias("authors"), heads.alias("headings"), _links().alias("links"),
        _meta("name", "description").alias("description"), _meta("name", "keywords").alias("keywords"), _meta("property", "og:title").alias("og_title"), _meta("property", "og:description").alias("og_description"),
        F.left(F.array_join(_texts(F.slice(_of("p"), 1, LEAD_PARAGRAPHS), "raw"), " "), F.lit(LEAD_CHARS)).alias("lead"), outline.alias("outline"), F.size(_of("a")).alias("n_links"), F.col("images").alias("n_images"),
    )


def _outlined(level: int) -> Column:
    return F.transform(_of(f"h{level}"), lambda e: F.struct(F.lit(level).alias("level"), e["raw"].alias("text")))

"""Listings and prices out of stored web pages: Arrow batches of pages in, rows of candidate texts out; the rest is column expressions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from realty_spark.functions import numbers as N
from realty_spark.functions import text as T

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


#: Elements that end where another of their kind begins.
_SIBLINGS = {"p", "li", "tr", "td", "th", "dt", "dd", "option"}


class _Cards(HTMLParser):
    """Collects, per element of class or tag ``card`` inside one of class or tag ``container``, the texts of the elements of each field.

    What is open is counted by name, so that the time for a page grows with its length even where nothing is closed.
    """

    def __init__(self, container: str, card: str, fields: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.container, self.card, self.fields = container, card, fields
        self.open: list[tuple[str, set[str], int | None]] = []
        self.spans: list[int] = []
        self.count: Counter[str] = Counter()
        self.tags: Counter[str] = Counter()
        self.before: Counter[str] = Counter()
        self.cards: list[dict] = []
        self.here: dict | None = None
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        if tag in _SIBLINGS and self.open and self.open[-1][0] == tag:
            self.handle_endtag(tag)
        own = dict(attrs)
        names = set((own.get("class") or "").split()) | {tag}
        if self.here is None and self.count[self.container] and self.card in names:
            self.here, self.depth = {"classes": names, "texts": {}, "all": [], "attrs": {}, "spans": [], "typed": None, "plain": []}, len(self.open)
            self.spans = []
            self.before = Counter({f: self.count[f] for f in (*self.fields, "type")})
        if self.here is not None:
            self.here["classes"] = self.here["classes"] | ({"skeleton"} & names)
            for k in ("href", "data-date"):
                if own.get(k):
                    self.here["attrs"].setdefault(k, own[k])
        span = None
        if self.here is not None and tag == "span":
            span = len(self.here["spans"])
            self.here["spans"].append([])
            self.spans.append(span)
            if self.here["typed"] is None and self._in("type"):
                self.here["typed"] = span
        self.open.append((tag, names, span))
        self.tags[tag] += 1
        self.count.update(names)

    def handle_endtag(self, tag):
        if not self.tags[tag]:
            return
        while True:
            name, names, span = self.open.pop()
            if span is not None and self.spans and self.spans[-1] == span:
                self.spans.pop()
            self.tags[name] -= 1
            self.count.subtract(names)
            if name == tag:
                break
        if self.here is not None and len(self.open) <= self.depth:
            self.cards.append(self.here)
            self.here = None

    def _in(self, field: str) -> bool:
        return self.count[field] > self.before[field]

    def handle_data(self, data):
        text = data.strip()
        if self.here is None or not text or self.tags["script"] or self.tags["style"]:
            return
        self.here["all"].append(text)
        for s in self.spans:
            self.here["spans"][s].append(text)
        if self._in("type") and not self.tags["svg"]:
            self.here["plain"] += text.split()
        for f in self.fields:
            if self._in(f):
                self.here["texts"].setdefault(f, []).append(text)


FIELDS = ("address", "price", "surface", "rooms", "type", "alt")


def cards(pages: DataFrame, container: str = "article", card: str = "p", fields: tuple[str, ...] = FIELDS, least_text: int = 20) -> DataFrame:
    """page_id, place, one text per field, all text, href, date, spans, type_span and type_word of each card; skeletons, hidden and short cards are left out.

    spans: the texts of span elements.  type_span, type_word: the first span in the element ``type``, and its last word outside of pictures.

    ``container``, ``card`` and ``fields`` are classes or tags.  Null and malformed pages give what can be read of them, maybe nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(len(fields) + 7)]
            which = []
            for i, html in enumerate(batch.column(1).to_pylist()):
                parser = _Cards(container, card, fields)
                parser.feed(html or "")
                parser.close()
                found = parser.cards + ([parser.here] if parser.here else [])
                for place, c in enumerate(found):
                    text = " ".join(c["all"])
                    if {"skeleton", "hidden"} & c["classes"] or len(text) < least_text:
                        continue
                    which.append(i)
                    values = [place, *(" ".join(c["texts"][f]) if f in c["texts"] else None for f in fields), text, c["attrs"].get("href"), c["attrs"].get("data-date")]
                    spans = [" ".join(s) for s in c["spans"]]
                    values += [spans, spans[c["typed"]] if c["typed"] is not None else None, c["plain"][-1] if c["plain"] else None]
                    for column, v in zip(out, values):
                        column.append(v)
            kinds = [pa.int32(), *[pa.string()] * (len(fields) + 3), pa.list_(pa.string()), pa.string(), pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(out, kinds)]
            yield pa.record_batch([batch.column(0).take(pa.array(which, pa.int64())), *arrays], ["page_id", "place", *fields, "all_text", "href", "millis", "spans", "type_span", "type_word"])

    names = ", ".join(f"{f} string" for f in fields)
    return pages.select("page_id", "html").mapInArrow(run, f"page_id long, place int, {names}, all_text string, href string, millis string, spans array<string>, type_span string, type_word string")


def kind_of(type_span: Column, type_word: Column, spans: Column, all_text: Column, other: Column) -> Column:
    """The property type: of the type element's span or last word, else of a span that names one, else of a word in all text, else of another element."""
    named = F.filter(spans, lambda s: T.names_type(s))
    told = lambda c: F.when(F.trim(c) != "", T.property_type(c))
    words = [F.when(F.lower(all_text).contains(w), t) for w, t in T.TYPE_WORDS]
    return F.coalesce(told(type_span), told(type_word), told(F.get(named, F.lit(0))), *words, told(F.when(T.names_type(other), other)), F.lit("other"))


def listings(pages: DataFrame, base: str = "https://example.com", **shape) -> DataFrame:
    """Raw sales of all pages: address, city, postal_code, price, surface, rooms, sale_date, property_type, property_url."""
    c = cards(pages, **shape)
    parts = T.split_listing_address(F.col("address"))
    return c.select(
        "page_id", "place", parts["address"].alias("address"), parts["city"].alias("city"), parts["postal_code"].alias("postal_code"),
        T.listing_price(F.col("price")).alias("price"), T.listing_surface(F.col("surface")).alias("surface"), T.listing_rooms(F.col("rooms")).alias("rooms"),
        N.epoch_date(F.col("millis")).alias("sale_date"), kind_of(*(F.col(x) for x in ("type_span", "type_word", "spans", "all_text", "alt"))).alias("property_type"), T.absolute_url(F.col("href"), base).alias("property_url"),
    )


def market_prices(pages: DataFrame) -> DataFrame:
    """page_id with the house and apartment price per square metre that follow their headings."""
    text = F.regexp_replace(F.regexp_replace("html", "(?is)<(script|style).*?</\\1>", " "), "<[^>]*>", " ")
    # a figure belongs to a heading if no other heading stands between
    price = lambda word, other: F.regexp_replace(F.regexp_extract(text, f"(?is){word}(?:(?!{other})[^0-9]){{0,200}}([0-9][0-9 \u00a0\u202f.]*)", 1), "[^0-9]", "").try_cast("int")
    return pages.select("page_id", price("maison", "appartement").alias("house_price_avg"), price("appartement", "maison").alias("apartment_price_avg"))

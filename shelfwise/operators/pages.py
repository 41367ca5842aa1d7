"""Rows and ids in web pages."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.deals import deal_from_compare_text
from ..functions.units import parse_price, repair_price

#: Names before the digits of a product's id.
ID_PREFIXES = "our|temp|prod|item|[0-9]+"
_ZERO_WIDTH = re.compile("[\\u200b-\\u200f\\ufeff]")
_STYLE_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SELECTOR = re.compile(r"^([a-zA-Z]*)(#[\w-]+)?\[data-([\w-]+)=[\"']?([^\"'\]]*)[\"']?\]$|^([a-zA-Z]*)(#[\w-]+)?\[data-([\w-]+)\]$")
ROWS = "page_id long, kind string, row_index int, chain_name string, store_name string, place string, deal_text string, deal_price_text string, row_price_text string, skipped int"


class _Rows(HTMLParser):
    """The cells of the result tables, without what the page's styles hide."""

    def __init__(self, rules: list) -> None:
        super().__init__(convert_charrefs=True)
        self.rules, self.tables, self.hidden = rules, [], []
        self.row = self.cell = None
        self.deal, self.button = "", None  # of a deal's button: its description, and what it shows
        self.hidden_values: dict[str, str] = {}  # of inputs with an id, the first value of each
        self.heading, self.in_heading, self.in_table = [], None, 0  # the first headline within the first table
        self.open: list[tuple[str, bool]] = []

    def _is_hidden(self, tag: str, attributes: dict) -> bool:
        best, hidden = -1, "display:none" in (attributes.get("style") or "").replace(" ", "")
        for name, ident, key, value, shown in self.rules:
            fits = f"data-{key}" in attributes and (value is None or attributes[f"data-{key}"] == value) and name in ("", tag) and (not ident or attributes.get("id") == ident[1:])
            weight = 1 + bool(name) + 2 * bool(ident)
            if fits and weight >= best:
                best, hidden = weight, not shown
        return hidden

    def handle_starttag(self, tag, attrs):
        attributes = dict(attrs)
        if tag == "br":
            self.handle_data("<BR>")
        if tag == "input" and attributes.get("id") and attributes.get("value"):
            self.hidden_values.setdefault(attributes["id"], attributes["value"])
        self.in_table += tag == "table"
        if tag in ("h1", "h2", "h3", "h4") and self.in_table and not self.heading:
            self.in_heading = tag
        if tag in ("br", "img", "input", "meta", "link", "hr"):
            return
        if tag == "button" and self.cell is not None and len(self.row) == 3 and "btn-discount" in (attributes.get("class") or ""):
            self.deal, self.button = attributes.get("data-discount-desc") or "", []
        self.open.append((tag, self._is_hidden(tag, attributes)))
        if tag == "table" and "results-table" in (attributes.get("class") or ""):
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.row = None if "display_when_narrow" in (attributes.get("class") or "") else []
        elif tag in ("td", "th") and self.row is not None:
            self.cell = []

    def handle_endtag(self, tag):
        if tag == self.in_heading:
            self.in_heading = None
        while self.open and any(t == tag for t, _ in self.open):
            if self.open.pop()[0] == tag:
                break
        if tag == "td" and self.row is not None and self.cell is not None:
            shown = (self.button or []) if len(self.row) == 3 else self.cell
            self.row.append(" ".join(_ZERO_WIDTH.sub("", "".join(shown)).split()))
            self.cell = None
        elif tag == "tr" and self.row is not None:
            if self.row:
                self.tables[-1].append([*self.row[:5], self.deal] if len(self.row) >= 5 else self.row)
            self.row, self.deal, self.button = None, "", None

    def handle_data(self, data):
        if self.in_heading:
            self.heading.append(data.replace("<BR>", " "))
        if self.cell is not None and not any(h for _, h in self.open):
            self.cell.append(data)
            if self.button is not None and len(self.row) == 3 and any(t == "button" for t, _ in self.open):
                self.button.append(data)


def _rules(page: str) -> list:
    rules = []
    for style in re.findall(r"<style[^>]*>(.*?)</style", page, re.DOTALL | re.IGNORECASE):
        for selectors, body in _STYLE_RULE.findall(style):
            m = re.search(r"display\s*:\s*([\w-]+)|visibility\s*:\s*([\w-]+)|font-size\s*:\s*0", body)
            if m:
                shown = (m[1] or m[2] or "none") not in ("none", "hidden")
                for selector in selectors.split(","):
                    s = _SELECTOR.match(selector.strip())
                    if s:
                        rules.append(((s[1] or s[5] or "").lower(), s[2] or s[6], s[3] or s[7], s[4] if s[3] else None, shown))
    return rules


def compare_cells(pages: DataFrame) -> DataFrame:
    """The visible rows of both result tables of each page: the first is of stores, the second of websites.

    A deal is a button in the fourth cell: its text is the deal's price, and an attribute of it the
    deal's text. Without a button both are empty. Rows with under five cells are left out and counted in skipped.
    """

    def of(frames):
        for frame in frames:
            out = []
            for page_id, page in zip(frame["page_id"], frame["html"]):
                parser = _Rows(_rules(page or ""))
                parser.feed(page or "")
                for kind, table in zip(("physical", "online"), parser.tables):
                    skipped = sum(len(r) < 5 for r in table)
                    good = [r for r in table if len(r) >= 5]
                    out += [(page_id, kind, i, *r, skipped) for i, r in enumerate(good)]
            yield pd.DataFrame(out, columns=["page_id", "kind", "row_index", "chain_name", "store_name", "place", "deal_price_text", "row_price_text", "deal_text", "skipped"])[[x.split()[0] for x in ROWS.split(", ")]]

    return pages.select("page_id", "html").mapInPandas(of, ROWS)


#: Fixed ids of the inputs that hold a product's code and name.
CODE_INPUT, NAME_INPUT = "displayed_product_code", "displayed_product_name_and_contents"
#: Fixed patterns of a headline's brand and barcode.
HEADLINE_BRAND, HEADLINE_BARCODE = r"יצרן/מותג[:：]\s*([^,()]+)", r"ברקוד[:：]\s*(\d+)"


def compare_products(pages: DataFrame) -> DataFrame:
    """page_id and what a comparison page tells of its product, null if it doesn't: product_id and name (hidden inputs), brand and barcode (the headline of the first table)."""

    def of(frames):
        for frame in frames:
            out = []
            for page_id, page in zip(frame["page_id"], frame["html"]):
                parser = _Rows([])
                parser.feed(page or "")
                out.append((page_id, parser.hidden_values.get(CODE_INPUT), parser.hidden_values.get(NAME_INPUT), " ".join("".join(parser.heading).split())))
            yield pd.DataFrame(out, columns=["page_id", "product_id", "name", "headline"])

    found = pages.select("page_id", "html").mapInPandas(of, "page_id long, product_id string, name string, headline string")
    told = {"brand": F.trim(F.regexp_extract("headline", HEADLINE_BRAND, 1)), "barcode": F.regexp_extract("headline", HEADLINE_BARCODE, 1)}
    return found.select("page_id", "product_id", F.nullif(F.trim("name"), F.lit("")).alias("name"), *(F.nullif(v, F.lit("")).alias(k) for k, v in told.items()))


def with_page_products(items: DataFrame, told: DataFrame) -> DataFrame:
    """items (page_id, product_id, name, brand, barcode, ...) with what their pages tell, which goes first. A barcode that neither has is that of the id: what follows temp_, or the digits after the first _."""
    both = items.alias("i").join(told.alias("t"), "page_id", "left")
    taken = {c: F.coalesce(F.col(f"t.{c}"), F.col(f"i.{c}")) for c in ("product_id", "name", "brand", "barcode")}
    merged = both.select("page_id", *(taken[c].alias(c) if c in taken else F.col(f"i.{c}") for c in items.columns if c != "page_id"))
    own = F.regexp_extract("product_id", r"^(?:temp_(.+)|.*)$", 1)
    digits = F.regexp_extract("product_id", r"^[^_]*_(\d+)$", 1)
    return merged.withColumn("barcode", F.coalesce("barcode", F.nullif(own, F.lit("")), F.nullif(digits, F.lit("")))).select(*items.columns)


def of_kind(rows: DataFrame, kind: str) -> DataFrame:
    """The rows of a comparison page's stores (physical) or of its websites (online)."""
    if kind not in ("physical", "online"):
        raise ValueError(kind)
    return rows.where(F.col("kind") == kind)


def extract_compare_rows(pages: DataFrame) -> DataFrame:
    """compare_cells with prices repaired and deals read; rows without a price are left out."""
    cells = compare_cells(pages)
    price = F.coalesce(parse_price(F.col("row_price_text")), repair_price(F.col("row_price_text"), F.col("deal_price_text")))
    rows = cells.withColumn("row_price", price).where("row_price is not null")
    return rows.withColumn("deal", deal_from_compare_text(F.col("deal_text"), F.col("deal_price_text"), F.col("row_price")))


def compare_product_rollup(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Of each product: rows, stores, the cheapest and the dearest store and price."""
    low, high = F.min(F.struct("row_price", "store_name")), F.max(F.struct("row_price", "store_name"))
    found = rows.groupBy(key).agg(F.count("*").alias("rows"), F.countDistinct("store_name").alias("stores"), low.alias("low"), high.alias("high"))
    return found.select(key, "rows", "stores", F.col("low.row_price").alias("cheapest"), F.col("low.store_name").alias("cheapest_store"), F.col("high.row_price").alias("dearest"), F.col("high.store_name").alias("dearest_store"))


def rows_by_price(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """The rows of each product with their place, the cheapest first."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("row_price", "store_name", "kind", "row_index")))


def deal_type_presence(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Of each product the types of its deals, and in how many tables and rows it is; best_products() orders them."""
    found = rows.groupBy(key).agg(F.sort_array(F.collect_set("deal.deal_type")).alias("deal_types"), F.countDistinct("kind").alias("tables"), F.count("*").alias("rows"))
    return found


def best_products(presence: DataFrame, limit: int, key: str = "page_id") -> DataFrame:
    """Those in both tables first, then those with the most rows."""
    return presence.orderBy(F.desc(F.col("tables") == 2), F.desc("rows"), key).limit(limit)


def links(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """page_id and link of every href and loc, percent-decoded."""
    hrefs = F.regexp_extract_all("html", F.lit(r"""href\s*=\s*["']([^"']+)["']"""), F.lit(1))
    locs = F.regexp_extract_all("html", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    return pages.select(F.col(id_col).alias("page_id"), F.explode(F.concat(hrefs, locs)).alias("raw")).select("page_id", F.coalesce(F.try_url_decode("raw"), "raw").alias("link"))


def extract_product_ids(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """page_id and product_id of links whose path ends in an id-like part and digits, or has a part with a known prefix."""
    found = links(pages, id_col)
    path = F.regexp_replace("link", r"[?#].*$", "")
    by_place = F.nullif(F.regexp_extract(path, r"/([A-Za-z0-9]+_[A-Za-z0-9_]+)/\d+/?$", 1), F.lit(""))
    by_prefix = F.nullif(F.regexp_extract(path, rf"/((?:{ID_PREFIXES})_[A-Za-z0-9]+)(?:/|$)", 1), F.lit(""))
    return found.select("page_id", F.coalesce(by_place, by_prefix).alias("product_id")).where("product_id is not null").distinct()


def distinct_ids(ids: DataFrame, limit: int | None = None) -> DataFrame:
    rows = ids.select("product_id").distinct().orderBy("product_id")
    return rows.limit(limit) if limit else rows


def id_prefix_counts(ids: DataFrame) -> DataFrame:
    return ids.groupBy(F.substring_index("product_id", "_", 1).alias("prefix")).agg(F.count("*").alias("n"))


def page_stats(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """Of each page its status (200 unless the table tells it), its length and the number of ids in it."""
    counts = ids.groupBy("page_id").agg(F.count("*").alias("ids"))
    status = F.col("status") if "status" in pages.columns else F.lit(200)
    own = pages.select("page_id", status.alias("status"), F.length("html").cast("long").alias("length"))
    return own.join(counts, "page_id", "left").select("page_id", "status", "length", F.coalesce("ids", F.lit(0)).alias("ids"))


def page_summary(stats: DataFrame) -> DataFrame:
    """One row: pages, the first and last, how many are empty or failed (status not 200), and ids. failed_ranges tells which failed."""
    failed = F.coalesce(F.col("status"), F.lit(0)) != 200
    return stats.agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page"), F.count_if(F.col("ids") == 0).alias("empty_pages"), F.sum("ids").alias("ids"), F.count_if(failed).alias("failed"))


def failed_ranges(stats: DataFrame, span: int = 1 << 16) -> DataFrame:
    """The pages that failed as runs of successive ids: first_page, last_page, pages.

    Ids are taken in spans, each in one task; a run over a span's end is told as two, so no row and no task grows with the table.
    """
    failed = stats.where(F.coalesce(F.col("status"), F.lit(0)) != 200).select("page_id").distinct().withColumn("_span", F.floor(F.col("page_id") / span))
    run = F.col("page_id") - F.row_number().over(Window.partitionBy("_span").orderBy("page_id"))
    return failed.withColumn("_run", run).groupBy("_span", "_run").agg(F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page"), F.count("*").alias("pages")).drop("_span", "_run")

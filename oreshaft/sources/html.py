"""Rows of changelog tables in HTML, and their text form."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bytes import changelog_date, normalize_space, safe_filename

#: The wrapper's class, the rows' attribute, the cells' classes, and elements without an end tag.
WRAPPER, MODEL = "firmware-table-details", "data-modelno"
CELLS = ("firmware-date", "firmware-version", "firmware-message")
#: Rows of pages that a task makes before they leave it.
GIVEN = 1 << 12
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Rows(HTMLParser):
    """Collects (model, texts of the first cell of each class) of every row in the first wrapper."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[list[str]], dict | None]] = []  # tag, texts that it feeds, its row
        self.rows: list[tuple[str, dict[str, list[str]]]] = []
        self.wrapper: int | None = None
        self.done = False

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        given = dict(reversed(attrs))
        classes = (given.get("class") or "").split()
        if self.wrapper is None and tag == "div" and WRAPPER in classes:
            self.wrapper = len(self.open)
        feeds, row = [], None
        if self.wrapper is not None:
            if tag == "tr" and given.get(MODEL) is not None:
                row = {}
                self.rows.append((given[MODEL], row))
            for _, _, own in self.open:  # a row's cells may lie at any depth
                for c in CELLS:
                    if own is not None and c in classes and c not in own:
                        own[c] = []
                        feeds.append(own[c])
        if tag not in VOID:
            self.open.append((tag, feeds, row))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None or self.done:
            return
        del self.open[at:]
        self.done = self.wrapper is not None and at <= self.wrapper

    def handle_data(self, data):
        if self.wrapper is not None and not self.done and self.open[-1][0] not in ("script", "style"):
            for _, feeds, _ in self.open:
                for text in feeds:
                    text.append(data)


def parsed(page: str | None) -> list[tuple[int, str, str, str, str]]:
    """(pos, model, date, version, message) of a page's rows."""
    parser = _Rows()
    parser.feed(page or "")
    parser.close()
    return [(i, model, *("".join(cells.get(c, ())) for c in CELLS)) for i, (model, cells) in enumerate(parser.rows)]


def changelog_rows(pages: DataFrame, models: list[str] | None = None, html: str = "html") -> DataFrame:
    """(…, pos, model, date, version, message): rows tr[data-modelno] of the first div.firmware-table-details whose message isn't empty.

    Pages are parsed with the standard library's parser, so that elements nest and
    entities are read. White space is normalised. A null page has no rows.
    """
    new = ("pos", "model", "date", "version", "message")
    keep = [c for c in pages.columns if c != html and c.lower() not in new]
    source = pages.select(*(f"`{c}`" for c in keep), F.col(f"`{html}`").cast("string").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list = []

            def made():
                who, pos, *texts = zip(*found)
                at = pa.array(who, pa.int64())
                return pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(len(keep))), pa.array(pos, pa.int32()), *(pa.array(x, pa.string()) for x in texts)], names=[*keep, *new])

            for i, page in enumerate(b.column(len(keep))):  # one page as text at a time
                found.extend((i, *row) for row in parsed(page.as_py()))
                if len(found) >= GIVEN:
                    yield made()
                    found = []
            if found:
                yield made()

    schema = T.StructType([source.schema[c] for c in keep]).add("pos", "integer")
    for c in new[1:]:
        schema.add(c, "string")
    rows = source.mapInArrow(run, schema)
    out = rows.select(*(f"`{c}`" for c in keep), "pos", "model", *(normalize_space(F.col(c)).alias(c) for c in new[2:]))
    return out.where("message <> ''" if models is None else (F.col("message") != "") & F.col("model").isin(*models))


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(…, pos, href, label): every anchor of a page in order."""
    keep = [c for c in pages.columns if c != html]
    each = F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r'<a href="([^"]*)">[^<]*</a>'), F.lit(0))).alias("pos", "a")
    return pages.select(*keep, each).select(*keep, "pos", F.regexp_extract("a", r'href="([^"]*)"', 1).alias("href"), normalize_space(F.regexp_extract("a", r">([^<]*)<", 1)).alias("label"))


def newest_first(rows: DataFrame, by: list[str], *seq: str) -> DataFrame:
    """rows with rank: newest date first within `by`, dates that don't parse last, else as they came (by seq)."""
    when = F.coalesce(changelog_date(F.col("date")), F.lit("0001-01-01").cast("timestamp"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(when.desc(), *(seq or ("pos",)))))


def changelog_text(rows: DataFrame, models: list[str], *seq: str, source: str = "", fetched: str = "") -> DataFrame:
    """(model, file, body): a text for each of models, newest first; one without rows says so."""
    known = lambda c: F.when(F.col(c) == "", f"Unknown {c}").otherwise(F.col(c))
    entry = F.concat(F.lit("- "), known("date"), F.lit(" | "), known("version"), F.lit("\n  "), F.col("message"), F.lit("\n\n"))
    ordered = newest_first(rows, ["model"], *seq).groupBy("model").agg(F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))).alias("es"))
    asked = rows.sparkSession.createDataFrame([(m,) for m in models], "model string")
    head = F.concat(F.lit("Model: "), F.col("model"), F.lit(f"\nSource: {source}\nFetched: {fetched}\n{'=' * 80}\n\n"))
    body = F.when(F.col("es").isNull(), "No entries found.\n").otherwise(F.array_join(F.transform("es", lambda x: x["e"]), ""))
    return asked.join(ordered, "model", "left").select("model", F.concat(safe_filename(F.col("model")), F.lit(".txt")).alias("file"), F.concat(head, body).alias("body"))

"""Listing pages: links to acts, and cards with metadata."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexcorpus.functions.urls import allowed, law_id
from lexcorpus.sources.archive import ajax_body

LINK = r'(?is)<a\b[^>]*class="[^"]*\bact-name\b[^"]*"[^>]*>.*?</a>'


def links(pages: DataFrame, hosts: list[str], suffixes: list[str] = ()) -> DataFrame:
    """(page_id, ordinal, url, law_id, title) of the act links of ``pages`` (page_id, html); links without a number or to other hosts are left out, the first of an address is kept."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(LINK), F.lit(0))).alias("ordinal", "a"))
    title = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("a", "(?is)^<a[^>]*>(.*)</a>$", 1), "<[^>]+>", " "), r"\s+", " "))
    rows = found.select("page_id", "ordinal", F.regexp_extract("a", r'(?is)^<a\b[^>]*href="([^"]*)"', 1).alias("url"), title.alias("title"))
    rows = rows.withColumn("law_id", law_id(F.col("url"))).where(F.col("law_id").isNotNull() & allowed(F.col("url"), hosts, suffixes))
    first = rows.groupBy("page_id", "url").agg(F.min(F.struct("ordinal", "law_id", "title")).alias("f"))
    return first.select("page_id", "f.ordinal", "url", "f.law_id", "f.title")


def categories(pages: DataFrame) -> DataFrame:
    """(page_id, category_id): numbers of /law/<n> links, each once."""
    found = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="[^"]*/law/([0-9]+)"'), F.lit(1))).alias("category_id"))
    return found.distinct()


def discover(spark, base: str, url: str | None = None, law_ids: list[str] = (), listing: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(ordinal, url, law_id) of the acts to fetch: a given address, else given numbers, else the links of a listing page, in order, ``limit`` at most."""
    schema = "ordinal int, url string"
    if url:
        rows = spark.createDataFrame([(0, url)], schema)
    elif law_ids or listing is None:
        rows = spark.createDataFrame([(i, f"{base}/mn/detail?lawId={n}") for i, n in enumerate(dict.fromkeys(law_ids))], schema)
    else:
        rows = listing.groupBy("url").agg(F.min("ordinal").alias("ordinal")).select("ordinal", "url")
    rows = rows.withColumn("law_id", law_id(F.col("url")))
    return rows.orderBy("ordinal", "url").limit(limit) if limit is not None else rows


def until_empty(pages: DataFrame, most: int) -> DataFrame:
    """Pages (category, page_no, html) of a crawl before the first one without links, ``most`` a category; answers may be JSON with the page inside."""
    p = pages.withColumn("html", ajax_body(F.col("html"))).where(F.col("page_no") <= most)
    empty = p.where(~F.coalesce(F.rlike("html", F.lit(LINK)), F.lit(False))).groupBy("category").agg(F.min("page_no").alias("end"))
    return p.join(empty, "category", "left").where("end is null or page_no < end").drop("end")


def pdf_source(html):
    """The address of an act's PDF: the first link that ends in .pdf, else the number of a download call, else the toolbar's link; null if there is none."""
    some = lambda pattern: F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))
    return F.coalesce(some(r'(?i)href="([^"]+\.pdf(?:[?#][^"]*)?)"'), F.concat(F.lit("download:"), some(r"(?i)downloadlaw\(\s*'1'\s*,\s*'?([0-9]+)")), some(r'(?is)class="[^"]*\btoolbar\b[^"]*".*?href="([^"]+)"'))


class _Cards(HTMLParser):
    """Cards: an element of the card class; inside it a link (title), emphasised text (number), dates, a check mark, PDF mentions."""

    VOID = {"br", "img", "input", "hr", "meta", "link"}

    def __init__(self, card: str):
        super().__init__()
        self.card, self.depth, self.cards, self.stack = card, 0, [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if not self.depth and self.card in classes:
            self.cards.append({"title": "", "url": None, "number": "", "dates": [], "active": False, "pdf": False})
            self.depth = 1
        elif self.depth and tag not in self.VOID:
            self.depth += 1
        if self.depth:
            c = self.cards[-1]
            c["active"] |= "fa-check" in classes
            c["pdf"] |= any("pdf" in (v or "").lower() for v in a.values())
            if tag == "a" and c["url"] is None and a.get("href"):
                c["url"] = a["href"]
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if self.depth and tag not in self.VOID:
            self.depth -= 1
            if tag in self.stack:
                while self.stack.pop() != tag:
                    pass

    def handle_data(self, data):
        if self.depth:
            c, text = self.cards[-1], " ".join(data.split())
            c["pdf"] |= "pdf" in text.lower()
            c["dates"] += re.findall(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text)
            if "a" in self.stack and not c["title"]:
                c["title"] = text
            if {"i", "em"} & set(self.stack):
                c["number"] += text


CARDS = "page_id string, ordinal int, law_id string, title string, document_number string, source_url string, issued_date string, effective_date string, status string, pdf_available boolean"


def cards(pages: DataFrame, card: str = "shine-huuli-content") -> DataFrame:
    """CARDS of ``pages`` (page_id, html): one Python pass per page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for page, html in zip(b["page_id"], b["html"]):
                p = _Cards(card)
                p.feed(html or "")
                for i, c in enumerate(p.cards):
                    number = re.search(r"lawId=([0-9]+)|/details?/([0-9]+)", c["url"] or "", re.I)
                    dates = [*c["dates"], None, None]
                    out.append((page, i, number and (number[1] or number[2]), c["title"] or None, c["number"] or None, c["url"], dates[0], dates[1], "ACTIVE" if c["active"] else "ARCHIVED", c["pdf"]))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in CARDS.split(", ")])

    return pages.select(F.col("page_id").cast("string").alias("page_id"), "html").mapInPandas(run, CARDS)

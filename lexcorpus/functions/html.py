"""Pages to lines (built-in expressions) and lines to provisions (one Python pass per page)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexcorpus.tables import BLANKS

#: Ordinal words of headings (fixed values).
UNITS = {
    "НЭГДҮГЭЭР": 1, "ХОЁРДУГААР": 2, "ГУРАВДУГААР": 3, "ДӨРӨВДҮГЭЭР": 4, "ТАВДУГААР": 5, "ЗУРГАДУГААР": 6, "ЗУРГААДУГААР": 6, "ДОЛООДУГААР": 7, "ДОЛДУГААР": 7, "НАЙМДУГААР": 8, "ЕСДҮГЭЭР": 9, "АРАВДУГААР": 10,
    "ХОРЬДУГААР": 20, "ГУЧДУГААР": 30, "ДӨЧДҮГЭЭР": 40, "ТАВЬДУГААР": 50, "ЖАРДУГААР": 60, "ДАЛДУГААР": 70, "НАЯДУГААР": 80, "ЕРДҮГЭЭР": 90,
}
TENS = {"АРВАН": 10, "ХОРИН": 20, "ГУЧИН": 30, "ДӨЧИН": 40, "ТАВИН": 50, "ЖАРАН": 60, "ДАЛАН": 70, "НАЯН": 80, "ЕРЭН": 90}

#: Parts of a page that hold no text of the act (fixed values).
CHROME = [r"<script.*?</script>", r"<style.*?</style>", r"<nav.*?</nav>", r"<footer.*?</footer>", r"<label.*?</label>", r"<span[^>]*print-zuil[^>]*>.*?</span>", r"<span[^>]*icon-s[^>]*>.*?</span>", r'<p[^>]*style="[^"]*display\s*:\s*none[^"]*"[^>]*>.*?</p>']
#: Entities and their characters, in this order (fixed values).
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")]
#: Forms of the lines of an act (fixed values).
CHROME_LINE = r"(?iu)^(?:хэвлэх|pdf|word|сонсох.*|хуваалцах|-->)$"

_ORDINAL = rf"(?:({'|'.join(TENS)})\s+)?({'|'.join(UNITS)})(?:\^([0-9]+))?"
CHAPTER = rf"(?iu)^{_ORDINAL}\s+БҮЛЭГ(?:\^([0-9]+))?(?:[.\s:—-]*(.*))?$"
WORD_ARTICLE = rf"(?iu)^{_ORDINAL}\s+ЗҮЙЛ(?:[.\s:—-]*(.*))?$"
ARTICLE = r"(?iu)^([0-9]+(?:\.[0-9]+)?)(?:\^([0-9]+))?\s*(?:дүгээр|дугаар|дэх)\s*зүйл(?:[.\s:—-]+(.*))?$"
QUALIFIED = r"^([0-9]+)(?:\^([0-9]+))?\.([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?\.?\s*(.*)$"
SIMPLE = r"^([0-9]+)(?:[.)]|/)\s*(.*)$"
ANNEX = r"(?iu)^хавсралт(?![\w])"
SIGNATURE = r"(?iu)^монгол улсын их хурлын дарга(?![\w])"
#: What stands before the dates of an act (fixed values).
ADOPTED = r"(?iu)батлагдсан[:\s]*([0-9]{4}-[0-9]{2}-[0-9]{2})"
EFFECTIVE = r"(?iu)хүчин\s*төгөлдөр(?:\s*болсон)?[:\s]*([0-9]{4}-[0-9]{2}-[0-9]{2})"


def _decoded(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def lines(html: Column) -> Column:
    """The non-empty lines of a page, cleaned, in order."""
    c = html
    for pattern in CHROME:
        c = F.regexp_replace(c, f"(?is){pattern}", " ")
    c = F.regexp_replace(c, r"(?i)<sup>([0-9]+)</sup>", "^$1")
    c = F.regexp_replace(c, r"(?i)</(?:p|div|h1|h2|h3|li|br|tr)>|<br\s*/?>", "\n")
    c = _decoded(F.regexp_replace(c, "<[^>]+>", " "))
    each = F.split(c, "\n+")
    each = F.transform(each, lambda x: F.trim(F.regexp_replace(x, f"[{BLANKS}]+", " ")))
    each = F.transform(each, lambda x: F.regexp_replace(F.trim(F.regexp_replace(F.trim(F.regexp_replace(x, r"(?iu)^(?:хэвлэх|pdf|word) +", "")), r'(?i)^text-align\s*:\s*center">', "")), r"([0-9]+)\s+\.(?=[0-9])", "$1."))
    return F.filter(each, lambda x: x != "")


def title(html: Column, act: Column | None = None) -> Column:
    """The page title of three characters or more, else the first heading, else the first line in capitals that ends in "law", else the first line, else Untitled.

    Headings and lines are those of ``act``, the part of the page that holds the act (by default all of it).
    """
    act = html if act is None else act
    inside = lambda page, tag: F.trim(F.regexp_replace(_decoded(F.regexp_replace(F.regexp_extract(page, f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]+>", " ")), f"[{BLANKS}]+", " "))
    page = inside(html, "title")
    named = lambda ls: F.coalesce(F.get(F.filter(ls, lambda x: F.rlike(x, F.lit("(?iu)хууль$")) & (x == F.upper(x))), 0), F.get(ls, 0))
    of_lines = F.get(F.transform(F.array(lines(act)), named), F.lit(0))
    return F.coalesce(F.when(F.length(page) >= 3, page), F.nullif(inside(act, "h1"), F.lit("")), of_lines, F.lit("Untitled"))


def labelled_date(html: Column, label: str) -> Column:
    """The date behind ``label`` (:data:`ADOPTED` or :data:`EFFECTIVE`), null where there is none or none such day."""
    return F.try_to_date(F.nullif(F.regexp_extract(html, label, 1), F.lit("")), "yyyy-MM-dd")


def line_class(line: Column) -> Column:
    """What a line of an act is."""
    is_ = lambda p: F.rlike(line, F.lit(p))
    return F.when(is_(CHROME_LINE), "chrome").when(is_(CHAPTER), "chapter").when(is_(WORD_ARTICLE) | is_(ARTICLE), "article").when(is_(ANNEX), "annex").when(is_(SIGNATURE), "signature").when(is_(QUALIFIED), "qualified").when(is_(SIMPLE), "simple").otherwise("text")


def line_context(lines_: DataFrame) -> DataFrame:
    """(doc_id, line_no, kind, chapter_line, article_line): each line of ``lines_`` (doc_id, line_no, kind) with the headings it stands under; a chapter ends the article before it.

    The window is over the lines of one page.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("line_no"))).over(w)
    out = lines_.withColumn("chapter_line", at("chapter")).withColumn("article_line", at("article"))
    return out.withColumn("article_line", F.when(F.coalesce(F.col("article_line") > F.col("chapter_line"), F.lit(True)), F.col("article_line")))


def isolate(html: str) -> str:
    """The element of the act's text, or the whole page: the tab ``bordered-tab1``, in it the class ``law_content``."""
    scope = html
    tab = re.search(r"<div\b[^>]*id=[\"']bordered-tab1[\"']", html, re.I)
    if tab:
        scope = _balanced(html, tab.start())
    body = re.search(r'<div\b[^>]*class="[^"]*\blaw_content\b', scope, re.I)
    return _balanced(scope, body.start()) if body else scope


def _balanced(html: str, start: int) -> str:
    depth = 0
    for m in re.compile(r"<div\b|</div>", re.I).finditer(html, start):
        depth += 1 if m.group()[1] != "/" else -1
        if not depth:
            return html[start : m.end()]
    return html[start:]


class Outline:
    """Provisions of one act, built line by line.

    State is the innermost open provision of each level. A line N.M[.K[.L]] goes to article N if
    there is one, otherwise to the open article; it is clause M of paragraph N if that paragraph
    was numbered plainly before, otherwise paragraph M. Other lines continue the innermost
    provision, unless it holds them already. An annex ends the open provision: lines below its heading
    belong to none. The line of the signature is no text of the act.
    """

    _RE = {k: re.compile(v) for k, v in {"chrome": CHROME_LINE, "chapter": CHAPTER, "word": WORD_ARTICLE, "article": ARTICLE, "qualified": QUALIFIED, "simple": SIMPLE, "annex": ANNEX, "signature": SIGNATURE}.items()}

    def __init__(self, heading: str, annexes: bool = True):
        self.annexes = annexes
        self.rows = [self._row("doc", None, "DOCUMENT", heading, title=heading)]
        self.under: dict[tuple[int, str], int] = {}
        self.articles: dict[str, int] = {}
        self.plain: set[int] = set()
        self.open: dict[str, int | None] = dict.fromkeys(("CHAPTER", "ARTICLE", "PARAGRAPH", "CLAUSE"))

    @staticmethod
    def _row(locator, parent, kind, text, title=None, number=None) -> dict:
        return {"locator": locator, "parent": parent, "node_type": kind, "title": title, "text": text, "number": number}

    def _enter(self, kind: str, at: int) -> None:
        order = list(self.open)
        for k in order[order.index(kind) + 1 :]:
            self.open[k] = None
        self.open[kind] = at

    def _add(self, *args, **kw) -> int:
        self.rows.append(self._row(*args, **kw))
        return len(self.rows) - 1

    def _child(self, parent: int, kind: str, mark: str, number: str, text: str) -> int:
        """The child of that number, made if need be; ``text`` is appended."""
        key = (parent, f"{mark}-{number}")
        if key not in self.under:
            self.under[key] = self._add(f"{self.rows[parent]['locator']}/{mark}-{number}", parent, kind, "", number=number)
        self._append(self.under[key], text)
        return self.under[key]

    def _append(self, at: int, text: str) -> None:
        row = self.rows[at]
        if text and text not in row["text"]:
            row["text"] = f"{row['text']} {text}".strip()

    @staticmethod
    def _ordinal(m: re.Match) -> str:
        n = UNITS[m[2].upper()] + (TENS[m[1].upper()] if m[1] else 0)
        return str(n)

    def _article(self, number: str, name: str | None, line: str) -> None:
        top = self.open["CHAPTER"] or 0
        at = self._add(f"art-{number}", top, "ARTICLE", line, title=name or f"Article {number}", number=number)
        self.articles.setdefault(number, at)
        self._enter("ARTICLE", at)

    def feed(self, line: str) -> None:
        r = self._RE
        if r["chrome"].match(line) or "Lang::lineCode" in line or r["signature"].match(line):
            return
        if m := r["chapter"].match(line):
            bis = m[3] or m[4]
            number = self._ordinal(m) + (f"^{bis}" if bis else "")
            self._enter("CHAPTER", self._add(f"ch-{number}", 0, "CHAPTER", line, title=line, number=number))
        elif m := r["word"].match(line):
            self._article(self._ordinal(m), m[3], line)  # an inserted number serves as the title here
        elif m := r["article"].match(line):
            self._article(m[1] + (f"^{m[2]}" if m[2] else ""), (m[3] or "").strip(), line)
        elif self.annexes and r["annex"].match(line):
            self._add(f"annex-{sum(x['parent'] == 0 for x in self.rows) + 1}", self.open["CHAPTER"] or 0, "ANNEX", line, title=line[:120])
            self.open.update(ARTICLE=None, PARAGRAPH=None, CLAUSE=None)
        elif (m := r["qualified"].match(line)) and self.open["ARTICLE"] is not None:
            self._qualified(m)
        elif (m := r["simple"].match(line)) and not r["qualified"].match(line) and self.open["ARTICLE"] is not None:
            at = self._child(self.open["ARTICLE"], "PARAGRAPH", "p", m[1], m[2].strip())
            self.plain.add(at)
            self._enter("PARAGRAPH", at)
        else:
            inner = next((a for a in (self.open["CLAUSE"], self.open["PARAGRAPH"], self.open["ARTICLE"]) if a is not None), None)
            if inner is not None:
                self._append(inner, line)

    def _qualified(self, m: re.Match) -> None:
        number = m[1] + (f"^{m[2]}" if m[2] else "")
        article = self.open["ARTICLE"]
        if self.rows[article]["number"] != number:
            article = self.articles.get(number, article)
            if article != self.open["ARTICLE"]:
                self._enter("ARTICLE", article)
        rest = m[6].strip()
        numbered = self.under.get((article, f"p-{m[1]}"))
        if not m[4] and numbered in self.plain:
            self._enter("PARAGRAPH", numbered)
            self._enter("CLAUSE", self._child(numbered, "CLAUSE", "c", m[3], rest))
            return
        self._enter("PARAGRAPH", self._child(article, "PARAGRAPH", "p", m[3], "" if m[4] else rest))
        if m[4]:
            clause = self._child(self.open["PARAGRAPH"], "CLAUSE", "c", m[4], "" if m[5] else rest)
            self._enter("CLAUSE", clause)
            if m[5]:
                self._add(f"{self.rows[clause]['locator']}/sc-{m[5]}", clause, "SUB_CLAUSE", rest, number=m[5])


PROVISIONS = "doc_id string, ordinal int, parent_ordinal int, locator string, node_type string, number string, title string, text string, content_hash string"


def isolated(pages: DataFrame) -> DataFrame:
    """``pages`` (doc_id, html) and act, the part of the page that holds the act: one Python pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(act=[None if h is None else isolate(h) for h in b["html"]])

    return pages.select(F.col("doc_id").cast("string").alias("doc_id"), "html").mapInPandas(run, "doc_id string, html string, act string")


def parsed(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Acts (doc_id, title, adopted_at, effective_from, content_hash) and PROVISIONS of ``pages`` (doc_id, html): the whole way from a page to its tree."""
    p = isolated(pages)
    page_title = title(F.col("html"), F.col("act"))
    acts = p.select("doc_id", page_title.alias("title"), labelled_date(F.col("html"), ADOPTED).alias("adopted_at"), labelled_date(F.col("html"), EFFECTIVE).alias("effective_from"), F.sha2("html", 256).alias("content_hash"))
    return acts, provisions(p.select("doc_id", page_title.alias("title"), lines(F.col("act")).alias("lines")))


def provisions(pages: DataFrame) -> DataFrame:
    """PROVISIONS of ``pages`` (doc_id, title, lines): one Python pass per page; a null or empty page has only its root."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, heading, ls in zip(b["doc_id"], b["title"], b["lines"]):
                o = Outline(heading or "Untitled")
                for line in ls if ls is not None else []:
                    o.feed(line)
                for i, r in enumerate(o.rows):
                    digest = hashlib.sha256(f"{r['locator']}:{r['text']}".encode()).hexdigest()
                    out.append((doc, i, r["parent"], r["locator"], r["node_type"], r["number"], r["title"], r["text"], digest))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in PROVISIONS.split(", ")])
            frame["parent_ordinal"] = frame["parent_ordinal"].astype("Int32")
            yield frame

    return pages.select(F.col("doc_id").cast("string").alias("doc_id"), "title", "lines").mapInPandas(run, PROVISIONS)

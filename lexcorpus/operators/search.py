"""Ranked search over provisions: token match, phrase, trigram similarity and cover density.

Two ways with the same results. Without an index, the cheap predicate (tokens, or trigrams of the short
title) selects candidates in one scan; the costly text similarity is computed for candidates only.
With :func:`build_index`, a question reads only the partitions of its own words and trigrams: postings
(term, id, at) and trigrams of titles are laid out by hash of the term, and sorted by it within; the
texts of candidates come from a table laid out by hash of the id. The query is constant, and the top
rows are taken per partition first.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
TITLE_SIMILARITY = 0.3


def lexemes(text: Column) -> Column:
    """Lower-case words, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def query_words(query: str) -> list[str]:
    return re.findall(r"[^\W_]+", query.lower())


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each with two blanks before and one behind it."""
    per_word = F.transform(lexemes(text), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(per_word))


def _query_grams(query: str) -> list[str]:
    padded = [f"  {w} " for w in query_words(query)]
    return list(dict.fromkeys(p[i : i + 3] for p in padded for i in range(len(p) - 2)))


def similarity(a: Column, query: str) -> Column:
    """Shared trigrams over all trigrams; 0 where either side has none."""
    grams = _query_grams(query)
    q = F.array(*map(F.lit, grams)) if grams else F.array().cast("array<string>")
    t = trigrams(F.coalesce(a, F.lit("")))
    common = F.size(F.array_intersect(t, q))
    return F.coalesce(common / F.nullif(F.size(t) + F.lit(len(grams)) - common, F.lit(0)), F.lit(0.0))


def websearch(words: Column, query: str) -> Column:
    """The predicate of a web-style query: terms are AND-ed, "phrases", or, -not."""
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    groups: list[list[Column]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if word.lower() == "or" and not minus:
            groups.append([])
            continue
        ws = query_words(phrase or word)
        if not ws:
            continue
        hit = F.array_contains(words, ws[0]) if len(ws) == 1 else F.contains(line, F.lit(f" {' '.join(ws)} "))
        groups[-1].append(~hit if minus else hit)
    alternatives = []
    for g in groups:
        if g:
            every = g[0]
            for c in g[1:]:
                every = every & c
            alternatives.append(every)
    if not alternatives:
        return F.lit(False)
    out = alternatives[0]
    for c in alternatives[1:]:
        out = out | c
    return out


def _terms(query: str) -> list[str]:
    return list(dict.fromkeys(query_words(query)))


def density(occurrences: Column, n: int) -> Column:
    """Cover density of ``occurrences`` (array of struct<at, t>, in order of at) of ``n`` terms numbered from 0: every shortest span with all terms adds 0.1 over one plus the words between."""
    seen = lambda a, x: F.transform(a["seen"], lambda v, j: F.when(j == x["t"], x["at"]).otherwise(v))

    def step(a: Column, x: Column) -> Column:
        def with_start(start: Column) -> Column:
            fresh = start > a["start"]
            gain = F.when(fresh, F.lit(0.1) / (F.lit(1) + (x["at"] - start + 1 - n))).otherwise(F.lit(0.0))
            return F.struct(seen(a, x).alias("seen"), F.when(fresh, start).otherwise(a["start"]).alias("start"), (a["total"] + gain).alias("total"))

        return F.get(F.transform(F.array(F.array_min(seen(a, x))), with_start), F.lit(0))

    zero = F.struct(F.array_repeat(F.lit(-1), n).alias("seen"), F.lit(-1).alias("start"), F.lit(0.0).alias("total"))
    return F.coalesce(F.aggregate(occurrences, zero, step, lambda a: a["total"]), F.lit(0.0))


def cover_density(words: Column, query: str) -> Column:
    """:func:`density` of the query's words in a text; 0 for a null text or an empty query."""
    terms = _terms(query)
    if not terms:
        return F.lit(0.0)
    places = F.transform(words, lambda w, i: F.struct(i.alias("at"), (F.array_position(F.array(*map(F.lit, terms)), w).cast("int") - 1).alias("t")))
    return density(F.filter(places, lambda x: x["t"] >= 0), len(terms))


def candidates(nodes: DataFrame, query: str) -> DataFrame:
    """Rows of ``nodes`` (title, text) that hold every word of the query or whose title is similar to it."""
    words = lexemes(F.concat_ws(" ", "title", "text"))
    terms = query_words(query)
    return nodes.where((websearch(words, " ".join(terms)) if terms else F.lit(False)) | (similarity(F.col("title"), query) >= TITLE_SIMILARITY))


def _public(versions: DataFrame, instant: str | None) -> DataFrame:
    from lexcorpus.operators.versions import PUBLIC_EVER, PUBLIC_NOW

    return versions.where(F.col("status").isin(PUBLIC_EVER if instant else PUBLIC_NOW)).select(F.col("id").alias("document_version_id"), "document_id", "effective_from", "effective_to").distinct()


def _best(scored: DataFrame, instant: str | None, top: int) -> DataFrame:
    from lexcorpus.operators.versions import covers

    best = scored.orderBy(F.desc("score"), "id").limit(top)
    if instant:
        best = best.where(covers(instant))
    one = best.groupBy("document_id", "source_locator").agg(F.max_by(F.struct("id", "document_version_id", "title", "score"), F.struct("score", F.col("id"))).alias("b"))
    return one.select("document_id", "source_locator", "b.*")


def open_question(nodes: DataFrame, versions: DataFrame, query: str, instant: str | None = None, top: int = 20) -> DataFrame:
    """The best provisions for a question, one per (document, locator), with their score.

    The ``top`` candidates are taken before the as-of filter, in order of (score, id); a blank
    question has no answers. Scores are only comparable within one query.
    """
    found = candidates(nodes, query).join(_public(versions, instant), "document_version_id")
    words = lexemes(F.concat_ws(" ", "title", "text"))
    score = cover_density(words, query) + 0.3 * similarity(F.col("text"), query) + 0.8 * similarity(F.col("title"), query)
    return _best(found.withColumn("score", score), instant, top)


BUCKETS = 64


@dataclass(frozen=True)
class Index:
    """Tables of :func:`build_index`, each laid out by ``bucket``: postings (term, id, at), grams (gram, id, n) of titles, rows (id, document_version_id, source_locator, title, text)."""

    postings: DataFrame
    grams: DataFrame
    rows: DataFrame


def _bucket(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def build_index(nodes: DataFrame, write: Callable[[DataFrame, str, list[str]], DataFrame]) -> Index:
    """The index of ``nodes`` (id, document_version_id, source_locator, title, text), a row for each id.

    ``write`` (frame, name, columns of the layout) stores a table and gives it back. A term's rows are spread over
    several tasks by their ids, so a word in a third of all texts is no hot group.
    """

    def laid(df: DataFrame, key: str) -> DataFrame:
        spread = df.withColumn("bucket", _bucket(F.col(key))).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8)))
        return spread.sortWithinPartitions("bucket", key)

    tokens = nodes.select("id", F.posexplode(lexemes(F.concat_ws(" ", "title", "text"))).alias("at", "term"))
    titles = nodes.where("title is not null").select("id", F.explode(F.array(trigrams(F.col("title")))).alias("g"))
    grams = titles.select("id", F.size("g").alias("n"), F.explode("g").alias("gram"))
    rows = nodes.select("id", "document_version_id", "source_locator", "title", "text")
    return Index(write(laid(tokens, "term"), "postings", ["bucket"]), write(laid(grams, "gram"), "grams", ["bucket"]), write(laid(rows, "id"), "rows", ["bucket"]))


def indexed_candidates(index: Index, query: str) -> DataFrame:
    """(id, density): nodes with every word of the query, or a title similar to it, and the cover density of its words."""
    terms, grams = _terms(query), _query_grams(query)
    # partitions are named as values, so that only theirs are listed and read
    spark = index.postings.sparkSession
    numbered = lambda values: {r.v: r.b for r in spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias("v")).select("v", _bucket(F.col("v")).alias("b")).collect()} if values else {}
    at = lambda df, column, values: df.where(F.col("bucket").isin(*set(numbered(values).values())) & F.col(column).isin(*values)) if values else df.limit(0)
    number = F.array_position(F.array(*map(F.lit, terms)), F.col("term")).cast("int") - 1 if terms else F.lit(0)
    hits = at(index.postings, "term", terms).groupBy("id").agg(F.countDistinct("term").alias("k"), F.array_sort(F.collect_list(F.struct("at", number.alias("t")))).alias("places"))
    whole = hits.where(F.col("k") == len(terms)).select("id", density(F.col("places"), max(1, len(terms))).alias("density"))
    common = at(index.grams, "gram", grams).groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"))
    near = common.where(F.col("k") / (F.col("n") + len(grams) - F.col("k")) >= TITLE_SIMILARITY).select("id", F.lit(0.0).alias("density"))
    return whole.unionByName(near).groupBy("id").agg(F.max("density").alias("density"))


def open_question_indexed(index: Index, versions: DataFrame, query: str, instant: str | None = None, top: int = 20) -> DataFrame:
    """:func:`open_question` from an index."""
    found = indexed_candidates(index, query).withColumn("bucket", _bucket(F.col("id")))
    rows = index.rows.join(found, ["bucket", "id"]).join(_public(versions, instant), "document_version_id")
    score = F.col("density") + 0.3 * similarity(F.col("text"), query) + 0.8 * similarity(F.col("title"), query)
    return _best(rows.withColumn("score", score), instant, top)


def token_overlap(df: DataFrame, text_col: str, query: str, least: int = 3) -> Column:
    """Number of query words (of ``least`` letters or more) that the text contains anywhere, one more if it contains the whole query."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    hits = [F.contains(low, F.lit(w)).cast("int") for w in query_words(query) if len(w) >= least]
    total = F.contains(low, F.lit(query.lower())).cast("int")
    for h in hits:
        total = total + h
    return total

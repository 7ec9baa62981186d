"""Authorities, citation index and batch verification.

A candidate may name a provision in several ways: by citation key, locator, node or article number. All
ways are brought into one long form (way, key) on both sides, so a batch is one equi-join instead of a
disjunctive one. Where a candidate names an act as well, by id or by words of its title, the document
joins the key; words are resolved to documents once per batch, through the rarest run of three
characters. For a verdict the corpus side is aggregated to the least and greatest (version, node) of a
key first: that is all the verdict needs, and it keeps a key that names very many provisions from
multiplying the batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexcorpus.functions.citations import citation_key, parse_phrase
from lexcorpus.functions.urls import law_id
from lexcorpus.operators.audit import nodes_once
from lexcorpus.operators.versions import PUBLIC_EVER, PUBLIC_NOW, covers
from lexcorpus.tables import records

EXCERPT = 500


def authorities(nodes: DataFrame, versions: DataFrame, documents: DataFrame) -> DataFrame:
    """(node_id, document_id, document_version_id, title, excerpt, locator, document_title): nodes as they are cited.

    The title is the node's, else "Article N", else the locator.
    """
    d = records(documents, "id", ["title"], ["updated_at"]).select(F.col("id").alias("document_id"), F.col("title").alias("document_title"))
    v = versions.select(F.col("id").alias("document_version_id"), "document_id").distinct()
    title = F.coalesce("title", F.concat(F.lit("Article "), F.nullif("article", F.lit(""))), "source_locator")
    n = nodes_once(nodes, ["document_version_id", "title", "article", "source_locator", "text"]).select(F.col("id").alias("node_id"), "document_version_id", title.alias("title"), F.substring("text", 1, EXCERPT).alias("excerpt"), F.col("source_locator").alias("locator"))
    return n.join(v, "document_version_id").join(d, "document_id", "left").select("node_id", "document_id", "document_version_id", "title", "excerpt", "locator", "document_title")


def citation_index(nodes: DataFrame, versions: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_version_id, legal_node_id, citation_key, locator, exact_text, source_url, content_hash, status): a citation of every node but roots."""
    d = records(documents, "id", ["canonical_url", "document_number"], ["updated_at"]).select(F.col("id").alias("document_id"), "canonical_url", F.coalesce(law_id(F.col("canonical_url")), "document_number").alias("law"))
    v = versions.select(F.col("id").alias("document_version_id"), "document_id", F.col("content_hash").alias("v_hash")).distinct()
    n = nodes_once(nodes, ["document_version_id", "node_type", "source_locator", "text", "content_hash"]).where("node_type <> 'DOCUMENT'")
    j = n.join(v.join(d, "document_id"), "document_version_id")
    return j.select(
        "document_version_id",
        F.col("id").alias("legal_node_id"),
        citation_key(F.col("law"), F.col("source_locator")).alias("citation_key"),
        F.col("source_locator").alias("locator"),
        F.col("text").alias("exact_text"),
        F.col("canonical_url").alias("source_url"),
        F.coalesce(F.nullif("content_hash", F.lit("")), "v_hash").alias("content_hash"),
        F.lit("VALID").alias("status"),
    )


def backfill_needs(nodes: DataFrame, citations: DataFrame) -> DataFrame:
    """(document_version_id, n_nodes, n_citations, complete): versions whose numbers of citations and nodes differ need a back-fill."""
    n = nodes_once(nodes, ["document_version_id", "node_type"]).where("node_type <> 'DOCUMENT'").groupBy("document_version_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    c = citations.select("id", "document_version_id").distinct().groupBy("document_version_id").agg(F.count(F.lit(1)).alias("n_citations"))
    j = n.join(c, "document_version_id", "left").withColumn("n_citations", F.coalesce("n_citations", F.lit(0)))
    return j.withColumn("complete", F.col("n_nodes") == F.col("n_citations"))


def missing_citations(nodes: DataFrame, citations: DataFrame) -> DataFrame:
    """(id, document_version_id): nodes that no citation of their version names."""
    c = citations.select(F.col("legal_node_id").alias("id"), "document_version_id").distinct()
    return nodes_once(nodes, ["document_version_id", "node_type"]).where("node_type <> 'DOCUMENT'").select("id", "document_version_id").join(c, ["id", "document_version_id"], "left_anti")


def public_citations(citations: DataFrame, nodes: DataFrame, versions: DataFrame, instant: str | None = None) -> DataFrame:
    """Citations of public versions with the place of their node, whatever the status of the citation."""
    v = versions.where(F.col("status").isin(PUBLIC_EVER if instant else PUBLIC_NOW) & (covers(instant) if instant else F.lit(True)))
    v = v.select(F.col("id").alias("document_version_id"), "document_id").distinct()
    n = nodes_once(nodes, ["node_type", "article", "paragraph", "title"]).select(F.col("id").alias("legal_node_id"), "node_type", "article", "paragraph", F.col("title").alias("node_title"))
    # one shuffle does for both the distinct and the join
    c = citations.select("citation_key", "locator", "legal_node_id", "document_version_id", "exact_text").repartition("document_version_id").distinct()
    return c.join(v, "document_version_id").join(n, "legal_node_id")


def titled(hints: DataFrame, documents: DataFrame) -> DataFrame:
    """(hint, document_id): documents whose title contains each of ``hints`` (hint), in any case."""
    grams = lambda c: F.array_distinct(F.flatten(F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - k + 1, F.lit(1))), lambda i: F.substring(c, i, k)))))
    d = records(documents, "id", ["title"], ["updated_at"]).select(F.col("id").alias("document_id"), F.lower("title").alias("low")).where("low is not null")
    of_title = d.select("document_id", "low", F.explode(grams(F.col("low"))).alias("gram"))
    h = hints.select("hint").where("hint <> ''").distinct().withColumn("part", F.lower("hint"))
    longest = F.filter(grams(F.col("part")), lambda g: F.length(g) == F.least(F.length("part"), F.lit(3)))
    often = of_title.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    # a run that no title has makes the hint fit none
    rarest = h.select("hint", "part", F.explode(longest).alias("gram")).join(often, "gram", "left").groupBy("hint", "part").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram")).alias("r"))
    rarest = rarest.where("r.often > 0").select("hint", "part", "r.gram")
    return rarest.join(of_title, "gram").where("contains(low, part)").select("hint", "document_id")


_PAIR = "\u0001"


def _asked(candidates: DataFrame) -> DataFrame:
    """(candidate_id, way, key, document_id, hint): every way in which a candidate names a provision."""
    have = lambda c: F.col(c) if c in candidates.columns else F.lit(None).cast("string").alias(c)
    rows = candidates.select("candidate_id", "query", "node_id", "locator", have("document_id"), have("citation_key"), F.explode(F.array(parse_phrase(F.col("query")))).alias("p"))
    way = lambda name, key: F.struct(F.lit(name).alias("way"), key.alias("key"))
    # a locator of its own goes before that of the phrase
    ways = [way("key", F.col("query")), way("locator", F.col("query")), way("node", F.col("node_id")), way("locator", F.coalesce("locator", "p.locator")), way("key", F.col("citation_key")), way("place", F.concat_ws(_PAIR, "p.article", "p.paragraph"))]
    return rows.select("candidate_id", F.col("p.title_hint").alias("hint"), "document_id", F.inline(F.array(*ways))).where("key <> ''").distinct()


def _named(public: DataFrame) -> DataFrame:
    """(way, key, document_id, document_version_id, legal_node_id): the names of every public provision."""
    way = lambda name, key: F.struct(F.lit(name).alias("way"), key.alias("key"))
    place = F.when(F.col("node_type") == "ARTICLE", F.col("article")).when((F.col("node_type") == "PARAGRAPH") & F.col("paragraph").isNotNull(), F.concat(F.col("article"), F.lit(_PAIR), F.col("paragraph")))
    ways = [way("key", F.col("citation_key")), way("locator", F.col("locator")), way("node", F.col("legal_node_id")), way("place", place)]
    return public.select("document_id", "document_version_id", "legal_node_id", F.inline(F.array(*ways))).where("key is not null")


def _within(keys: DataFrame, documents: DataFrame) -> DataFrame:
    """``keys`` (way, key, document_id, hint, ...; one of the last two set) with in_document: the documents that each is restricted to."""
    by_title = keys.where("hint is not null").join(titled(keys.where("hint is not null"), documents).withColumnRenamed("document_id", "in_document"), "hint").where("document_id is null or document_id = in_document")
    return keys.where("hint is null").withColumn("in_document", F.col("document_id")).unionByName(by_title)


def _met(asked: DataFrame, documents: DataFrame, named: DataFrame) -> DataFrame:
    """(candidate_id, lo, hi): the least and greatest provision that a candidate names, for each of its ways."""
    place = F.struct("document_version_id", "legal_node_id")
    least = lambda keys: named.groupBy(*keys).agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
    free = asked.where("document_id is null and hint is null").select("candidate_id", "way", "key")
    bound = asked.where("document_id is not null or hint is not null")
    inside = _within(bound.select("way", "key", "document_id", "hint").distinct(), documents).join(least(["way", "key", "document_id"]).withColumnRenamed("document_id", "in_document"), ["way", "key", "in_document"])
    inside = inside.groupBy("way", "key", "document_id", "hint").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    r = inside.select(*[F.col(c).alias(f"r_{c}") for c in ("way", "key", "document_id", "hint")], "lo", "hi")
    same = (F.col("way") == F.col("r_way")) & (F.col("key") == F.col("r_key")) & F.col("document_id").eqNullSafe(F.col("r_document_id")) & F.col("hint").eqNullSafe(F.col("r_hint"))
    return free.join(least(["way", "key"]), ["way", "key"]).select("candidate_id", "lo", "hi").unionByName(bound.join(r, same).select("candidate_id", "lo", "hi"))


def verify(candidates: DataFrame, public: DataFrame, documents: DataFrame) -> DataFrame:
    """(candidate_id, verdict, document_version_id, legal_node_id): VALID if exactly one provision fits, CONFLICT if several, UNRESOLVED if none.

    ``candidates``: candidate_id, query, node_id, locator and, if need be, document_id, citation_key (any
    may be null). A provision fits if it bears the query as its key or locator, the node, the locator (its
    own, else the phrase's), the key, or the article (and paragraph) number of the phrase; its document
    must be the one given, and its title contain what the phrase says before the law. Every row gets a verdict.
    """
    found = _met(_asked(candidates), documents, _named(public)).groupBy("candidate_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    verdict = F.when(F.col("lo").isNull(), "UNRESOLVED").when(F.col("lo") == F.col("hi"), "VALID").otherwise("CONFLICT")
    sure = lambda c: F.when(F.col("verdict") == "VALID", F.col(f"lo.{c}")).alias(c)
    return candidates.select("candidate_id").join(found, "candidate_id", "left").withColumn("verdict", verdict).select("candidate_id", "verdict", sure("document_version_id"), sure("legal_node_id"))


#: Reasons of a verdict (fixed values).
REASONS = {"UNRESOLVED": "citation_unresolved", "CONFLICT": "citation_conflict", "VALID": "citation_unique"}


def reasons(verdict: Column, as_of: bool) -> Column:
    """array<string>: why a verdict is what it is."""
    said = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return F.array_compact(F.array(F.element_at(said, verdict), F.when((verdict == "UNRESOLVED") & F.lit(as_of), "as_of_unavailable")))


#: Rows of the result that one part of a list makes, about.
PART = 2_000_000
#: Groups that the candidates of a list are gathered in, at most.
GATHERED = 64
#: Where a candidate has more rows, the pairs of those that ask in more ways are made distinct.
MANY = 50


def _each(candidates: DataFrame, public: DataFrame, documents: DataFrame, provisions: DataFrame) -> DataFrame:
    """``candidate_id`` and the columns of ``provisions`` (document_version_id, legal_node_id, ...): every provision that fits a candidate, once.

    What is asked (way, key and what it is restricted to) has a list of provisions. A candidate gets its longest
    list whole and of every other what no longer list of it holds, so nothing has to be made distinct behind the
    join, which is the last step: only lists and candidates are shuffled, never the pairs. Candidates
    of one list stand in arrays, and a list that many ask for is cut into parts.
    """
    ask, place = F.struct("way", "key", "document_id", "hint").alias("ask"), ["document_version_id", "legal_node_id"]
    asked, named = _asked(candidates), _named(public)
    keys = asked.groupBy("way", "key", "document_id", "hint").agg(F.count(F.lit(1)).alias("n_asked"))
    free = named.drop("document_id").join(keys.where("document_id is null and hint is null"), ["way", "key"])
    bound = _within(keys.where("document_id is not null or hint is not null"), documents).join(named.withColumnRenamed("document_id", "in_document"), ["way", "key", "in_document"])
    held = free.select(ask, "n_asked", *place).unionByName(bound.select(ask, "n_asked", *place))
    sizes = held.groupBy("ask").agg(F.count(F.lit(1)).alias("n_held"), F.max("n_asked").alias("n_asked"))
    parts = F.least("n_held", F.ceil(F.col("n_held") * F.col("n_asked") / PART)).cast("int").alias("parts")
    lists = held.join(sizes.drop("n_asked"), "ask").groupBy(*place).agg(F.collect_set(F.struct("ask", parts)).alias("lists"))
    there = provisions.join(lists, place).select(*provisions.columns, F.col("lists.ask").alias("holds"), F.explode("lists").alias("list"))
    there = there.select(*provisions.columns, "holds", "list.ask", F.pmod(F.xxhash64(*place), "list.parts").cast("int").alias("part"))
    # the longest list first; the order is the same for all candidates, so those that ask the same have the same ``before``
    own = asked.select("candidate_id", ask).join(sizes, "ask").groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n_held")).alias("order"), "ask", parts))).alias("own"))

    def met(own: DataFrame, once: bool) -> DataFrame:
        rows = own.select("candidate_id", F.col("own.ask").alias("asks"), F.posexplode("own").alias("at", "list"))
        before = F.slice("asks", F.lit(1), F.col("at") if once else F.lit(0)).alias("before")
        rows = rows.select("candidate_id", "list.ask", "list.parts", before, F.pmod(F.xxhash64("candidate_id"), F.lit(GATHERED)).alias("group"))
        rows = rows.groupBy("ask", "parts", "before", "group").agg(F.collect_list(F.struct("candidate_id")).alias("who"))
        rows = rows.select("ask", "before", "who", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        return there.join(rows, ["ask", "part"]).where("size(before) = 0 or not arrays_overlap(before, holds)").select(F.inline("who"), *provisions.columns)

    # a row has a few ways to ask; a short job finds out whether the second join is needed
    if candidates.groupBy("candidate_id").count().where(F.col("count") > MANY).isEmpty():
        return met(own, True)
    return met(own.where(F.size("own") <= MANY), True).unionByName(met(own.where(F.size("own") > MANY), False).distinct())


def find(candidates: DataFrame, public: DataFrame, documents: DataFrame) -> DataFrame:
    """(candidate_id, document_version_id, legal_node_id): every provision that fits a candidate of :func:`verify`, once."""
    return _each(candidates, public, documents, public.select("document_version_id", "legal_node_id").distinct())


def retrieve_batch(candidates: DataFrame, public: DataFrame, documents: DataFrame) -> DataFrame:
    """(candidate_id, document_id, document_version_id, legal_node_id, locator, title, excerpt): all matches of every candidate, as a bag: a provision asked for twice comes twice.

    Of several citations of one provision the one with the least key counts.
    """
    pick = F.min(F.struct("citation_key", "locator", "node_title", "exact_text", "document_id")).alias("c")
    once = public.groupBy("document_version_id", "legal_node_id").agg(pick).select(
        "c.document_id", "document_version_id", "legal_node_id", "c.locator", F.coalesce("c.node_title", "c.locator").alias("title"), F.substring("c.exact_text", 1, EXCERPT).alias("excerpt")
    )
    return _each(candidates, public, documents, once)


def amendments(versions: DataFrame) -> DataFrame:
    """(from_document, to_document, relation): the amending document of each version."""
    return versions.where("amendment_document_id is not null").select(F.col("amendment_document_id").alias("from_document"), F.col("document_id").alias("to_document"), F.lit("AMENDS").alias("relation")).distinct()


def touching(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """Edges with either end in ``documents`` (document_id): two semi-joins instead of one disjunction."""
    a = edges.join(documents.select(F.col("document_id").alias("from_document")).distinct(), "from_document", "left_semi")
    b = edges.join(documents.select(F.col("document_id").alias("to_document")).distinct(), "to_document", "left_semi")
    return a.unionByName(b).distinct()

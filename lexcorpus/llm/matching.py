"""Entities of two tables matched without a common key, by a cascade of deterministic rules.

Each rule is an exact join on a combination of attributes; the rules stand in passes, each weaker than
the one before. Within a pass a record is resolved by the first of its rules under which exactly one
entity remains that nothing speaks against (another number, an impossible date, another kind, another
number in the address). Resolved records are removed by an anti-join before the next pass.

The confidence of a match is the smoothed precision of its rule, measured on labelled records. For all
rules but the first the label is the entity number in a record's address: such records pass the cascade
a second time with that number hidden, only to be counted, and one whose number no entity has counts
against every rule that matches it. The first rule, which uses that number, is measured on the records
that the whole-title rules resolve with the number hidden: those must give the same entity. A rule
is smoothed towards the precision of itself and all weaker rules (and of the next stronger ones until
there are ``POOL`` cases); ``cases`` tells how many labelled records stand behind it, and with none the
confidence is that prior alone.

Scale: a pass is one shuffle join of all its rules in long form, on a hash of (rule, key, part); titles are only fetched
for the pairs that meet. Parts divide the group
of a key by what would contradict anyway, date (or year) and number, so that each pair that isn't
contradicted meets in exactly one part; entities alike in all that is still compared are one row with
the least and greatest id. So a key owned by a third of all rows isn't paired as a whole, no entity is
left out, and the plan is the same at every size. Null keys are dropped first.

Defined cases: null, blank and unknown values ('0', 'n/a', ...) of an attribute neither join nor
contradict; repeated rows are one record; several editions of an entity each match by themselves; an
address number that several entities share resolves nothing; a title cut to fewer than eight
characters isn't continued.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexcorpus.staging import Stage

#: Weight of the prior of a rule's precision, in cases.
PRIOR = 2
#: A prior is the precision over at least so many cases, where there are so many.
POOL = 10
#: Addresses hold at most so many characters of a title.
SLUG = 40
#: What typists add before and behind a title, as patterns; a parameter of :func:`matches`.
BEFORE = (r"монгол улсын хууль\. ", "эх: ", r"\[скан\] ")
BEHIND = (r" /\d{4} он/", " /шинэчилсэн найруулга/", " - эх бичвэр", r" \(хүчингүй болсон\)", r" \.")
#: Other names of a jurisdiction, as patterns; a parameter of :func:`matches`.
PLACES = {"MONGOL.*": "MN"}

#: Cyrillic letters and their Latin spelling (fixed values).
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "j", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "ө": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ү": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sh", "ъ": "", "ы": "y", "ь": "i", "э": "e", "ю": "yu", "я": "ya",
}

#: Kinds of acts as the two systems name them (fixed values).
KINDS = {
    "law": "LAW", "act": "LAW", "хууль": "LAW", "regulation": "REGULATION", "журам": "REGULATION", "resolution": "GOVERNMENT_RESOLUTION", "тогтоол": "GOVERNMENT_RESOLUTION", "order": "MINISTERIAL_ORDER",
    "тушаал": "MINISTERIAL_ORDER", "tailbar": "INTERPRETATION", "court": "SUPREME_COURT_DECISION", "магадлал": "SUPREME_COURT_DECISION", "treaty": "TREATY", "гэрээ": "TREATY", "other": "OTHER",
}


def latin(text: Column) -> Column:
    """Lower-case Latin spelling of ``text``."""
    out = F.lower(text)
    single = {a: b for a, b in LATIN.items() if len(b) == 1}
    for a, b in LATIN.items():
        if len(b) != 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, "".join(single), "".join(single.values()))


def _title(text: Column, before: tuple[str, ...], behind: tuple[str, ...]) -> Column:
    """A title in small letters without what typists add, with single blanks."""
    t = F.trim(F.regexp_replace(F.lower(text), r"[\s\u00a0]+", " "))
    t = F.regexp_replace(t, f"^(?:{'|'.join(before)})+", "") if before else t
    return F.regexp_replace(t, f"(?:{'|'.join(behind)})+$", "") if behind else t


def _attributes(df: DataFrame, before: tuple[str, ...], behind: tuple[str, ...], places: dict[str, str]) -> DataFrame:
    """Keys of records (id, title, number, day, address, jurisdiction, kind)."""
    t = _title(F.col("title"), before, behind)
    place = F.upper(F.trim("jurisdiction"))
    for pattern, name in places.items():
        place = F.regexp_replace(place, f"^{pattern}$", name)
    plain = F.trim(F.regexp_replace(latin(F.regexp_replace(t, r"[^\p{L}\p{N} …]", "")), r"…$", ""))
    n = F.trim(F.col("number"))
    day = F.regexp_extract(F.col("day"), r"(\d{4})\D+(\d{1,2})\D+(\d{1,2})", 0)
    part = lambda k: F.regexp_extract(day, r"(\d{4})\D+(\d{1,2})\D+(\d{1,2})", k)
    df = df.select(
        "id",
        plain.alias("plain"),
        F.rlike(t, F.lit(r"\p{L}\.(?: |$)")).alias("shortened"),
        t.endswith("…").alias("cut"),
        F.nullif(F.coalesce(F.nullif(F.regexp_extract(n, r"^\d{4}/0*(\d+)$", 1), F.lit("")), F.nullif(F.regexp_extract(n, r"^0*(\d+)-\d{4}$", 1), F.lit("")), F.regexp_extract(n, r"(?:^|[^0-9])0*(\d+)$", 1)), F.lit("")).alias("n0"),
        F.nullif(F.concat(F.regexp_extract(n, r"^(\d{4})/\d+$", 1), F.regexp_extract(n, r"^\d+-(\d{4})$", 1)), F.lit("")).cast("int").alias("year"),
        F.try_to_date(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd").alias("date"),
        F.nullif(F.coalesce(F.nullif(F.regexp_extract("address", r"(?i)lawid=(\d+)", 1), F.lit("")), F.regexp_extract("address", r"/(?:detail|details)/(\d+)", 1)), F.lit("")).alias("own"),
        F.nullif(F.regexp_extract("address", r"/([a-z-]+)\.html$", 1), F.lit("")).alias("slug0"),
        place.alias("place"),
        F.upper(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.lower(F.trim("kind"))), F.trim("kind"))).alias("kind"),
    )
    words = F.filter(F.split("plain", " "), lambda w: (w != "tukhai") & (w != ""))
    return df.select(
        "id", "plain", "shortened", "cut", "year", "date", "own", "place", "kind",
        F.when(F.col("n0") != "0", F.col("n0")).alias("n"),
        F.substring("slug0", 1, SLUG).alias("slug"),
        F.substring(F.replace("plain", F.lit(" "), F.lit("-")), 1, SLUG).alias("slugged"),
        F.array_join(F.array_sort(words), " ").alias("sorted"),
        F.array_join(F.transform(words, lambda w: F.substring(w, 1, 3)), " ").alias("stems"),
        F.when(F.length(F.replace("plain", F.lit(" "), F.lit(""))) >= 8, F.substring(F.replace("plain", F.lit(" "), F.lit("")), 1, 8)).alias("head"),
        F.element_at(words, 1).alias("first"),
        F.array_join(F.slice(F.reverse(words), 1, 2), " ").alias("last"),
        F.replace("plain", F.lit(" "), F.lit("")).alias("solid"),
        words.alias("words"),
    )


@dataclass(frozen=True)
class Rule:
    """A join on ``keys``; ``fits`` says which records it is for and what else must hold (k: record, d: entity)."""

    name: str
    keys: tuple[str, ...]
    fits: str = ""


_PREFIX = "k_cut and startswith(d_solid, k_solid)"
#: An amending or accompanying act has all words of its base act but the last; it is told by the length it adds.
_NEAR = "(levenshtein(k_solid, d_solid, 3) >= 0 or size(array_intersect(k_words, d_words)) >= size(d_words) - 1 and length(k_solid) < length(d_solid) + 10)"
#: Slugs are cut: a title that isn't must agree behind them as well.
_WHOLE = f"(k_cut or coalesce(k_plain, '') = '' or k_sorted = d_sorted or k_stems = d_stems or levenshtein(k_solid, d_solid, 6) >= 0 or {_NEAR})"
PASSES = [
    [Rule("address number", ("own",))],
    [
        Rule("slug and number", ("slug", "n"), _WHOLE),
        Rule("slug and date", ("slug", "date"), _WHOLE),
        Rule("title and number", ("solid", "n")),
        Rule("title and date", ("solid", "date")),
        Rule("title words and number", ("sorted", "n")),
        Rule("title words and date", ("sorted", "date")),
    ],
    [
        Rule("slug", ("slug", "place", "kind"), _WHOLE),
        Rule("title", ("solid", "place", "kind")),
        Rule("title words", ("sorted", "place", "kind")),
        Rule("cut title and number", ("head", "n"), _PREFIX),
        Rule("cut title and date", ("head", "date"), _PREFIX),
        Rule("cut title", ("head", "place", "kind"), _PREFIX),
    ],
    [
        Rule("word stems and number", ("stems", "n")),
        Rule("word stems and date", ("stems", "date")),
        Rule("word stems", ("stems", "place", "kind"), f"(k_shortened or {_NEAR})"),
    ],
    [
        Rule("number, kind and near title", ("n", "kind"), _NEAR),
        Rule("date, kind and near title", ("date", "kind"), _NEAR),
        Rule("first word and near title", ("first", "kind", "place"), _NEAR),
        Rule("last words and near title", ("last", "kind", "place"), _NEAR),
    ],
]
RULES = [rule for rules in PASSES for rule in rules]
#: The passes that compare whole titles: with the address number hidden they label the rule that uses it.
LABELLING = (1, 2)

#: What speaks against a pair; dates of a record lie up to ``{days}`` days after the entity's. A record whose
#: address number is still open isn't an entity that has a number.
AGAINST = "(k_n <> d_n) or (k_kind <> d_kind) or (k_year <> year(d_date)) or (datediff(k_date, d_date) not between 0 and {days}) or (k_held and d_held)"
_TITLE = ("plain", "solid", "sorted", "stems", "words")


def _parts(side: str, rule: Rule, days: int) -> str:
    """Parts of a group a row (side k: record, d: entity) belongs to: a pair that neither date, year nor number contradict meets in exactly one.

    Of dates, b is a span of ``days`` + 1 days, of which a record sees at most two, y the year where a record has
    nothing else, d any date and u none; of numbers, n is the number, a any and 0 none. What is part of the
    key divides no further.
    """
    span = lambda back: f"concat('b', floor((unix_date({side}_date) - {back}) / {days + 1}))"
    if "date" in rule.keys:
        dates = "array('')"
    elif side == "d":
        dates = f"if(d_date is null, array('u'), array({span(0)}, concat('y', year(d_date)), 'd'))"
    else:
        dates = f"case when k_date is not null then array_distinct(array({span(0)}, {span(days)}, 'u')) when k_year is not null then array(concat('y', k_year), 'u') else array('d', 'u') end"
    if "n" in rule.keys:
        numbers = "array('')"
    elif side == "d":
        numbers = "if(d_n is null, array('0'), array(concat('n', d_n), 'a'))"
    else:
        numbers = "array(if(k_n is null, 'a', concat('n', k_n)), '0')"
    return f"flatten(transform({dates}, x -> transform({numbers}, y -> struct(x, y))))"


def _long(df: DataFrame, side: str, rules: list[Rule], days: int) -> DataFrame:
    """``df`` once for every rule it has the keys of, and part: rule, at (a hash of rule, key and part), and what is still compared.

    Of an entity, what no record that sees the part can contradict is left out; titles are named by their
    hash, and only where the rule compares them.
    """
    rows = []
    for rule in rules:
        i = RULES.index(rule)
        keys = [f"cast({side}_{c} as string)" for c in rule.keys]
        there = " and ".join(f"coalesce({k}, '') <> ''" for k in keys)
        title = f"{side}_as" if rule.fits else "cast(null as binary)"
        date = "d_date" if "date" in rule.keys else "if(p.x in ('d', 'u'), null, d_date)"
        compared = f", {date} as d_date, if(p.y in ('a', '0', ''), null, d_n) as d_n" if side == "d" else ""
        at = f"struct({i} as rule, unhex(md5(concat_ws('\u0001', {i}, {', '.join(keys)}, p.x, p.y))) as at, {title} as {side}_as{compared})"
        rows.append(f"if({there}, transform({_parts(side, rule, days)}, p -> {at}), array())")
    others = ["d_kind", "d_held", "d_own", "d_id"] if side == "d" else ["k_id", "shadow", "k_n", "k_kind", "k_year", "k_date", "k_held", "k_own", "k_cut", "k_shortened"]
    return df.select(*others, F.inline(F.expr(f"concat({', '.join(rows)})")))


def _alike(d: DataFrame) -> DataFrame:
    """Entities of a part that are alike in what is still compared are one row: d_id is the least id, d_other the greatest."""
    return d.groupBy("rule", "at", "d_kind", "d_date", "d_n", "d_held", "d_as").agg(F.min("d_id").alias("d_id"), F.max("d_id").alias("d_other"), F.min("d_own").alias("d_own"))


def _fitting(met: DataFrame, titles: DataFrame) -> DataFrame:
    """Pairs whose titles fit, where the rule compares them."""
    fits = F.expr("case rule " + " ".join(f"when {i} then {r.fits}" for i, r in enumerate(RULES) if r.fits) + " end")
    of = lambda side: titles.select(F.col("as").alias(f"{side}_as"), *[F.col(c).alias(f"{side}_{c}") for c in _TITLE])
    titled = met.where("d_as is not null").join(of("k"), "k_as").join(of("d"), "d_as").where(fits)
    return met.where("d_as is null").unionByName(titled.select(*met.columns))


def matches(entities: DataFrame, sources: DataFrame, days: int = 31, least: float = 0.7, before: tuple[str, ...] = BEFORE, behind: tuple[str, ...] = BEHIND, places: dict[str, str] = PLACES) -> DataFrame:
    """(document_id, knowledge_id, rule, confidence, cases) of ``sources`` that are one of ``entities``.

    Both need (id, title, number, day, address, jurisdiction, kind). Matches of rules with a
    confidence below ``least`` are left out.
    """
    spark = sources.sparkSession
    stage = Stage(spark, "matching")
    named = lambda df: _attributes(df.distinct(), before, behind, places).distinct().withColumn("as", F.unhex(F.md5(F.coalesce("plain", F.lit("")))))
    d, k = stage.write(named(entities), "entities"), stage.write(named(sources), "sources")
    # a blank title is none: it is near to nothing
    titles = stage.write(d.select("as", *_TITLE).unionByName(k.select("as", *_TITLE)).distinct().select("as", *[F.when(F.col("plain") != "", F.col(c)).alias(c) for c in _TITLE]).distinct(), "titles")
    # addresses of entities need hold no slug: theirs is made of the title
    d = d.withColumn("slug", F.coalesce("slug", "slugged")).select([F.col(c).alias(f"d_{c}") for c in d.columns]).withColumn("d_held", F.col("d_own").isNotNull())
    k = k.select([F.col(c).alias(f"k_{c}") for c in k.columns])
    against = F.coalesce(F.expr(AGAINST.format(days=days)), F.lit(False))
    found: list[DataFrame] = []
    for i, rules in enumerate(PASSES):
        if i:
            # shadow: the record with its address number hidden, only counted
            rest = k.withColumn("shadow", F.explode(F.expr("if(k_own is null, array(false), array(false, true))"))).withColumn("k_held", F.expr("k_own is not null and not shadow"))
            for f in found:
                rest = rest.join(f.select("k_id", "shadow"), ["k_id", "shadow"], "left_anti")
        else:
            rest = k.withColumn("shadow", F.lit(False)).withColumn("k_held", F.lit(False))
        met = _long(rest, "k", rules, days).join(_alike(_long(d, "d", rules, days)), ["rule", "at"]).where(~against)
        if any(r.fits for r in rules):
            met = _fitting(met, titles)
        single = met.groupBy("k_id", "shadow", "rule").agg(F.min("d_id").alias("d_id"), F.max("d_other").alias("other"), F.min("d_own").alias("d_own"), F.min("k_own").alias("k_own")).where("d_id = other")
        first = single.groupBy("k_id", "shadow").agg(F.min(F.struct("rule", "d_id", "d_own", "k_own")).alias("m")).select("k_id", "shadow", "m.*")
        found.append(stage.write(first, f"pass{i}"))
    every = lambda which: reduce(DataFrame.unionByName, [found[i] for i in which])
    rated = _rated(found[0], every(range(1, len(found))), every(LABELLING))
    confidence = spark.createDataFrame(rated, "rule int, name string, confidence double, cases bigint").where(F.col("confidence") >= least)
    out = every(range(len(found))).where("not shadow").join(F.broadcast(confidence), "rule")
    return out.select(F.col("d_id").alias("document_id"), F.col("k_id").alias("knowledge_id"), F.col("name").alias("rule"), "confidence", "cases")


def _rated(owned: DataFrame, ruled: DataFrame, labelling: DataFrame) -> list[tuple[int, str, float, int]]:
    """(rule, name, confidence, cases) of every rule."""
    shadows = ruled.where("shadow").select("rule", F.coalesce(F.col("k_own") == F.col("d_own"), F.lit(False)).alias("right"))
    by_title = labelling.where("shadow").select("k_id", F.col("d_id").alias("label"))
    first = owned.join(by_title, "k_id").select("rule", (F.col("d_id") == F.col("label")).alias("right"))
    # one row a rule
    counted = {r.rule: (r.right, r.n) for r in shadows.unionByName(first).groupBy("rule").agg(F.count_if("right").alias("right"), F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for i, rule in enumerate(RULES):
        # the rule and all weaker ones, then stronger ones until there are enough cases
        start = next((j for j in range(i, -1, -1) if sum(counted.get(x, (0, 0))[1] for x in range(j, len(RULES))) >= POOL), 0)
        right, n = (sum(counted.get(x, (0, 0))[c] for x in range(start, len(RULES))) for c in (0, 1))
        r, m = counted.get(i, (0, 0))
        out.append((i, rule.name, (r + PRIOR * (right + 1) / (n + 2)) / (m + PRIOR), m))
    return out

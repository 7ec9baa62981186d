"""Citation phrases to provisions: a deterministic phrase parser and a normalizer with an instrument catalogue."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexcorpus.tables import BLANKS

# --- phrase parser, in built-in expressions -------------------------------------------------

#: "N[.M] [ordinal suffix] article" (fixed value).
PHRASE = r"(?iu)([0-9]+)\s*(?:\.\s*([0-9]+))?\s*(?:дүгээр|дугаар|дэх)?\s*зүйл"
#: The act a phrase names: what stands before the word "of the law" (fixed value).
HINT = r"(?iu)^(.+?)\s+хуулийн(?:[^\p{L}\p{N}_]|$)"
#: N.M between characters that are no ASCII word characters (fixed value).
DOTTED = r"(?<![A-Za-z0-9_])([0-9]+)\.([0-9]+)(?![A-Za-z0-9_])"


def collapsed(col: Column) -> Column:
    """Runs of blanks as one space, none at either end."""
    return F.trim(F.regexp_replace(col, f"[{BLANKS}]+", " "))


def parse_phrase(query: Column) -> Column:
    """struct<article, paragraph, locator, title_hint> of a citation phrase; null what it doesn't hold."""
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  names a value, so that it is computed once
    number = lambda m, pattern, k: F.nullif(F.regexp_extract(m, pattern, k), F.lit(""))

    def parts(q: Column) -> Column:
        phrase = once(F.regexp_extract(q, PHRASE, 0), lambda m: F.struct(number(m, PHRASE, 1).alias("article"), number(m, PHRASE, 2).alias("paragraph")))
        dotted = once(F.regexp_extract(q, DOTTED, 0), lambda m: F.struct(number(m, DOTTED, 1).alias("article"), number(m, DOTTED, 2).alias("paragraph")))
        both = once(F.struct(phrase.alias("p"), dotted.alias("d")), lambda x: F.struct(*[F.coalesce(x["p"][c], x["d"][c]).alias(c) for c in ("article", "paragraph")]))
        place = lambda x: F.when(x["article"].isNotNull(), F.concat(F.lit("art-"), x["article"], F.coalesce(F.concat(F.lit("/p-"), x["paragraph"]), F.lit(""))))
        hint = F.nullif(F.regexp_extract(q, HINT, 1), F.lit(""))
        return once(both, lambda x: F.struct(x["article"].alias("article"), x["paragraph"].alias("paragraph"), place(x).alias("locator"), hint.alias("title_hint")))

    return once(collapsed(query), parts)


def citation_key(law_id: Column, locator: Column) -> Column:
    """``law:locator``, or the bare locator where the law is null or empty."""
    return F.coalesce(F.concat(F.nullif(law_id, F.lit("")), F.lit(":"), locator), locator)


# --- normalizer -----------------------------------------------------------------------------

#: Abbreviations in the order in which they are spelled out (fixed values).
ABBREVIATIONS = [("art.", "article"), ("para.", "paragraph"), ("subpara.", "subparagraph"), ("sec.", "section"), ("no.", "number")]
#: Inflected words and their base forms (fixed values).
LEMMAS = {"хуулийн": "хууль", "зүйлийн": "зүйл", "хэсгийн": "хэсэг", "заалтын": "заалт", "цэгийн": "цэг", "тогтоолын": "тогтоол", "тушаалын": "тушаал", "гэрээний": "гэрээ"}
#: Words that name a level of a locator (fixed values).
LEVELS = {
    "article": ["зүйл", "article", "articles", "art"],
    "paragraph": ["хэсэг", "paragraph", "paragraphs", "para", "section", "sections"],
    "subparagraph": ["заалт", "subparagraph", "subpara", "clause", "clauses"],
    "item": ["цэг", "item", "items", "point", "points"],
}
#: Words that say nothing in a citation (fixed values).
SKIPPED = ["(", ")", "дүгээр", "дугаар", "дэх", "дахь", "the", "of", "no", "number", "тухай", "and"]
#: Instruments: code, document type, aliases (fixed values).
INSTRUMENTS = [
    ("CRIMINAL_CODE", "LAW", ["эх", "эрүүгийн хууль", "criminal code", "mongolian criminal code"]),
    ("CIVIL_CODE", "LAW", ["их", "иргэний хууль", "civil code", "mongolian civil code"]),
    ("CONSTITUTION", "CONSTITUTION", ["үх", "үндсэн хууль", "constitution", "constitution of mongolia"]),
    ("CRIMINAL_PROCEDURE", "LAW", ["эххштх", "эрүүгийн хэрэг хянан шийдвэрлэх тухай хууль", "criminal procedure", "criminal procedure code"]),
    ("ADMINISTRATIVE_PROCEDURE", "LAW", ["зхшхштх", "захиргааны хэрэг шүүхэд хянан шийдвэрлэх тухай хууль", "administrative procedure", "administrative procedure code"]),
    ("GOVERNMENT_RESOLUTION", "RESOLUTION", ["згт", "засгийн газрын тогтоол", "government resolution"]),
    ("MINISTERIAL_ORDER", "ORDER", ["сайдын тушаал", "ministerial order", "minister's order"]),
    ("INTERNATIONAL_TREATY", "TREATY", ["олон улсын гэрээ", "international treaty", "treaty"]),
]
COUNTRY = "MN"
_TOKEN = re.compile(r"[0-9]+(?:[.-][0-9]+)*|[^\W\d_]+|[()]")
_ROLE = {word: level[0] for level, words in LEVELS.items() for word in words}
_NAMES = list(LEVELS)
_PIECE = re.compile(r"[apsi]n|n[apsi]|n")


def fold(text: str | None) -> str:
    """Compatibility form, lower case, no quotes, abbreviations spelled out, single spaces."""
    s = unicodedata.normalize("NFKC", text or "").lower()
    s = s.translate({**dict.fromkeys(map(ord, "«»“”\"№"), " "), ord("'"): None, ord("’"): None, ord("§"): " paragraph "})
    for short, word in ABBREVIATIONS:
        s = s.replace(short, f" {word} ")
    return " ".join(s.split())


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(fold(text))


class Catalogue:
    """Aliases of instruments, longest first."""

    def __init__(self, instruments=INSTRUMENTS):
        codes = [code for code, _, _ in instruments]
        if len(set(codes)) != len(codes):
            raise ValueError("an instrument code occurs twice")
        aliases: dict[tuple[str, ...], tuple] = {}
        for code, kind, names in instruments:
            for name in names:
                words = tuple(LEMMAS.get(t, t) for t in tokens(name))
                if words:
                    aliases.setdefault((code, *words), (words, code, kind))
        self.aliases = sorted(aliases.values(), key=lambda a: (-len(a[0]), -len(" ".join(a[0]))))

    def find(self, toks: list[str]) -> tuple[str | None, str | None, list[str]]:
        """(code, kind, remaining tokens) of the first alias that occurs as a run of tokens."""
        base = [LEMMAS.get(t, t) for t in toks]
        line = " " + " ".join(base) + " "
        for words, code, kind in self.aliases:
            at = line.find(" " + " ".join(words) + " ")
            if at >= 0:
                n = line.count(" ", 0, at)
                return code, kind, toks[:n] + toks[n + len(words) :]
        return None, None, toks


def locate(toks: list[str]) -> dict[str, str | None]:
    """Levels of a locator: a label with the number beside it, or bare numbers from the first free level."""
    kept = [(LEMMAS.get(t, t), t) for t in toks if t not in SKIPPED and LEMMAS.get(t, t) not in SKIPPED]
    line = "".join(_ROLE.get(base) or _ROLE.get(t) or ("n" if t[0].isdigit() else "x") for base, t in kept)
    found: dict[str, str | None] = dict.fromkeys(_NAMES)
    for m in _PIECE.finditer(line):
        number = kept[m.start() + m.group().index("n")][1]
        label = m.group().replace("n", "")
        if label:
            level = next(i for i, name in enumerate(_NAMES) if name[0] == label)
        elif found["article"] is None:
            level = 0
        else:
            level = next((i for i, name in enumerate(_NAMES) if found[name] is None), len(_NAMES) - 1)
        for part in re.split(r"[.-]", number):
            if level >= len(_NAMES):
                found["item"] = f"{found['item']}.{part}" if found["item"] else part
            else:
                if found[_NAMES[level]] is None:
                    found[_NAMES[level]] = part
                level += 1
    return found


def normalize(text: str | None, catalogue: Catalogue) -> dict[str, str | None]:
    code, kind, rest = catalogue.find(tokens(text))
    place = COUNTRY if code else None
    return {"country": place, "jurisdiction": place, "code": code, "document_type": kind, **locate(rest), "original_text": text}


NORMALIZED = "country string, jurisdiction string, code string, document_type string, article string, paragraph string, subparagraph string, item string, original_text string"


def normalizer(instruments=INSTRUMENTS):
    """A vectorized column function: citation text -> struct of NORMALIZED."""
    catalogue = Catalogue(instruments)

    @F.pandas_udf(NORMALIZED)
    def run(texts: pd.Series) -> pd.DataFrame:
        which, distinct = pd.factorize(texts, use_na_sentinel=False)  # each text once
        found = pd.DataFrame([normalize(None if pd.isna(t) else t, catalogue) for t in distinct], columns=[c.split()[0] for c in NORMALIZED.split(", ")])
        return found.iloc[which].reset_index(drop=True)

    return run


def folder():
    """A vectorized column function: text -> its folded form; null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        which, distinct = pd.factorize(texts, use_na_sentinel=False)  # each text once
        return pd.Series([None if pd.isna(t) else fold(t) for t in distinct], dtype=object).iloc[which].reset_index(drop=True)

    return run

"""Sentence units of texts in several scripts, as SQL expressions.

Marks that end nothing are replaced, character for character, by private-use placeholders: line
breaks that make an empty line, marks in addresses, decimals and dates, initials, abbreviations,
leading numbers, and every mark inside a quotation or bracket that stands in a running sentence.
One regular expression with the terminators of each script then cuts the masked text into
consecutive pieces. As masking keeps every position, a piece's place in the masked text is its
place in the original, from which the unit's text is restored.

Rules by script: Latin and Cyrillic marks end a unit before a capital, a digit, an opening quote
or the end of the block, never before a small letter; an abbreviation that can close a sentence
(etc., Ltd., г.м.) follows the same rule, one that calls for a name or number never ends a unit.
Danda, Mongolian and CJK full stops always end one, unless a quotation goes on behind them.
Scripts without case take ! and ? as ends but not dots (except the doubled CJK ellipsis). In Thai a
blank between two letters ends a unit. Empty lines always do, single line breaks never.

Defined cases: null, empty and blank texts have no units; a text without marks is one unit for
each block; placeholders that occur in the input are ordinary characters of its text. Bounds of
lookbehinds: a mail host has up to 60 characters before a dot, a leading number up to 15, a
heading number is looked for behind up to 9 blanks at the beginning of a line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexcorpus.tables import spread

# Placeholders: a masked mark, the end of a block, an opening and a closing straight quote, the dot of a leading number.
MASK, BLOCK, OPEN, CLOSE, NUMBER = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"

H = r"\t\x0B\f \u00a0\u1680\u180e\u2000-\u200a\u202f\u205f\u3000"  # blanks within a line
WS = H + r"\n\r\u0085\u2028\u2029"
BLANK_CHARS = "\t\x0b\f \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\n\r\u0085\u2028\u2029"

SOFT = r".!?…"
HARD = r"。！？．｡।॥᠃᠉"
T = SOFT + HARD
O = r"«“„‘(\[「『（【《" + OPEN  # noqa: E741
C = r"»”’)\]」』）】》" + CLOSE
HAN = r"぀-ヿ㐀-鿿豈-﫿"
THAI = r"ก-ฺเ-๎"

#: Code points of a chunk that sentences are cut from.
CHUNK = 1024


@dataclass(frozen=True)
class Abbreviations:
    """Word lists, a parameter (the values are fixed ones of the corpus' languages; others need lists of their own).

    ``leading`` call for what follows and never end a unit, ``numbered`` call for a number and don't end one
    before it, ``number_words`` stand with a dot before a heading (in Mongolian, up to fifteen).
    """

    leading: tuple[str, ...] = ("проф", "акад", "тал", "т.е", "ж.нь", "им", "ст", "гл", "ул", "стр", "Art", "Arts", "Sec", "para", "paras", "cf", "e.g", "i.e", "v", "vs", "approx", "ch", "Ch", "Mr", "Mrs", "Ms", "Dr", "Prof", "No", "Nos", "St", "डॉ", "श्री", "सं", "रु")
    numbered: tuple[str, ...] = ("п", "ч", "т", "с", "s", "p", "pp", "r", "№", "зүйл", "хэс", "No")
    number_words: tuple[str, ...] = ("Нэг", "Хоёр", "Гурав", "Дөрөв", "Тав", "Зургаа", "Долоо", "Найм", "Ес", "Арав", "Арван нэг", "Арван хоёр", "Арван гурав", "Арван дөрөв", "Арван тав")


def _not(chars: str) -> str:
    """A class of all but ``chars``; the commonest letters, none of which is in ``chars``, are tried first."""
    return rf"[\u0400-\u04FFa-z [^{chars}]]"


def _any(words: tuple[str, ...]) -> str:
    return "|".join(w.replace(".", f"[.{MASK}]") for w in sorted(words, key=len, reverse=True))


def masked(text: Column, words: Abbreviations = Abbreviations()) -> Column:
    """``text`` with every mark that ends nothing replaced by a placeholder, of the same length.

    Each step names its input once: the expression would double at every step otherwise. Steps for
    marks that few texts hold run only on those.
    """
    own = MASK + BLOCK + OPEN + CLOSE + NUMBER
    c = _where(text, list(own), rf"[{own}]", "\ue00a")
    c = _where(F.replace(c, F.lit("\r\n"), F.lit(" \n")), list("\r\u0085\u2028\u2029"), r"[\r\u0085\u2028\u2029]", "\n")
    c = _where(c, "\n", rf"\n(?=[{H}]*\n)", BLOCK)
    # straight quotes as pairs, a German pair likewise
    c = _where(c, '"', rf'"([^"{BLOCK}]*)"', f"{OPEN}$1{CLOSE}")
    c = _where(c, "'", rf"'(?<![\p{{L}}\p{{N}}]')([^'{BLOCK}]*)'(?![\p{{L}}\p{{N}}])", f"{OPEN}$1{CLOSE}")
    c = _where(c, "„", rf"„([^„“”{BLOCK}]*)[“”]", f"{OPEN}$1{CLOSE}")
    # addresses: marks with more of the address behind them
    c = _where(c, "://", rf"(\G(?!\A)[^{WS}{T}]*|https?://[^{WS}{T}]*)[{T}](?=[^{WS}{C}{T},;])", f"$1{MASK}")
    # decimals, dates, mail addresses, dots inside abbreviations, initials, abbreviations
    dots = "|".join(
        [
            r"(?<=[0-9]\.)(?=[0-9])",
            rf"(?<=@[\w.{MASK}-]{{1,60}}\.)(?=\w)",
            r"(?<=(?<![\p{L}\p{N}])\p{Ll}\.)(?=\p{Ll})",
            rf"(?<=(?<![\p{{L}}\p{{N}}])\p{{Lu}}\.)(?=[{WS}]?\p{{Lu}})",
            rf"(?<=(?<![\p{{L}}\p{{M}}\p{{N}}.])(?:{_any(words.leading)})\.)(?=[{WS}(]*[\p{{L}}\p{{N}}])",
            rf"(?<=(?<![\p{{L}}\p{{N}}.])(?:{_any(words.numbered)})\.)(?=[{WS}]*[0-9])(?<!т\.[{WS}]?п\.)(?<!т[.{MASK}]п\.)",
        ]
    )
    c = F.regexp_replace(c, rf"\.(?:{dots})", MASK)
    leading = rf"[0-9][0-9{MASK}]{{0,14}}|[IVXLC]{{1,7}}|{_any(words.number_words)}"
    c = F.regexp_replace(c, rf"[.{MASK}](?=[{WS}]+[^{WS}{BLOCK}])(?<=(?:\A|[\n{BLOCK}]|[{T}][{C}]?[{WS}])[{H}]{{0,9}}[{O}]?(?:{leading})[.{MASK}])", NUMBER)
    # quotations and brackets in a running sentence; then all but the last mark in any of them
    inside, closed = rf"{_not(T + C + O + BLOCK)}*", rf"{_not(C + O + BLOCK)}*[{C}]"
    c = F.regexp_replace(c, rf"(\G(?!\A){inside}|[{O}](?<=[^{T}{C}{WS}{BLOCK}{NUMBER}][{WS}]{{0,2}}[{O}]){inside})[{T}](?={closed})", f"$1{MASK}")
    c = F.regexp_replace(c, rf"(\G(?!\A){inside}|[{O}]{inside})[{T}](?![{T}]*[{C}])(?={closed})", f"$1{MASK}")
    # marks behind which the sentence goes on
    c = F.regexp_replace(c, rf"[{SOFT}](?![{T}]*[{C}]*[{WS}]*(?:{_NEXT}|{BLOCK}|\z))(?!{_CASELESS})", MASK)
    c = _where(c, list(HARD), rf"[{HARD}](?=[{T}]*[{C}]*[的，、と；;：:,])", MASK)
    # Thai: a blank between two letters
    return _where(c, list("กคงดตนปมยรลวสอา"), rf"[{H}](?<=[{THAI}][{H}])(?=[{H}]*[{THAI}])", BLOCK)


def _where(c: Column, marks: str | list[str], pattern: str, to: str) -> Column:
    """regexp_replace on the texts that hold one of ``marks``; the lambda names the text once."""

    def step(x: Column) -> Column:
        held = F.lit(False)
        for m in [marks] if isinstance(marks, str) else marks:
            held = held | F.contains(x, F.lit(m))
        return F.when(held, F.regexp_replace(x, pattern, to)).otherwise(x)

    return _named(c, step)


_NEXT = rf"[{O}]*[\p{{Lu}}\p{{Lt}}\p{{N}}]|[-–—•][{WS}]*\p{{Lu}}"
#: Ends before a letter without case: ! or ?, a dot behind a small letter, the doubled ellipsis of CJK, a hard mark in the same run.
_CASELESS = rf"(?<=[!?]|\p{{Ll}}\.|[{HAN}]…{{1,2}})[{T}]*[{C}]*[{WS}]*[{O}]*\p{{Lo}}|[{SOFT}]*[{HARD}!?]"
PIECE = rf"{BLOCK}+|{_not(T + BLOCK)}*+(?:[{T}]++[{C}]*+|(?={BLOCK})|\z)"


def _named(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """Sums of all numbers up to each, in log2(n) passes over the array: an array can't grow by appending without being copied each time."""

    def added(step: int):
        shifted = lambda a: F.transform(a, lambda x, i: x + F.when(i >= step, F.get(a, i - step)).otherwise(0))
        return lambda a: F.when(F.size(a) > step, shifted(a)).otherwise(a)

    out = numbers
    for i in range(30):
        out = _named(out, added(1 << i))
    return out


def spans(text: Column, abbreviations: Abbreviations = Abbreviations(), with_text: bool = False) -> Column:
    """array<struct<start_pos, end_pos[, sentence]>> of the units of ``text``, in code points from 0."""
    blanks = F.lit(BLANK_CHARS + BLOCK)

    def units(pieces: Column, whole: Column | None) -> Column:
        sized = lambda ends: F.zip_with(pieces, ends, lambda p, end: F.struct(
            (end - F.length(F.ltrim(p, blanks))).alias("start_pos"),
            (end - F.length(F.ltrim(p, blanks)) + F.length(F.trim(p, blanks))).alias("end_pos"),
        ))
        kept = F.filter(_named(running_sums(F.transform(pieces, F.length)), sized), lambda u: u["end_pos"] > u["start_pos"])
        if whole is None:
            return kept
        # a cut counts code points from the start of a string: it is made from the chunks a unit lies in
        chunks = F.regexp_extract_all(whole, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))

        def cut(parts: Column) -> Column:
            first = lambda u: F.floor(u["start_pos"] / CHUNK).cast("int")
            last = lambda u: F.floor((u["end_pos"] - 1) / CHUNK).cast("int")
            near = lambda u: F.array_join(F.slice(parts, first(u) + 1, last(u) - first(u) + 1), "")
            return F.transform(kept, lambda u: F.struct(u["start_pos"], u["end_pos"], F.substring(near(u), u["start_pos"] - first(u) * CHUNK + 1, u["end_pos"] - u["start_pos"]).alias("sentence")))

        return _named(chunks, cut)

    cut_up = lambda t: _named(F.regexp_extract_all(masked(t, abbreviations), F.lit(PIECE), F.lit(0)), lambda pieces: units(pieces, t if with_text else None))
    return _named(text, cut_up) if with_text else cut_up(text)


def sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, abbreviations: Abbreviations = Abbreviations()) -> DataFrame:
    """(doc_id, start_pos, end_pos[, sentence]): the sentence units of every text."""
    rows = spread(df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    found = rows.select("doc_id", F.explode(spans(F.col("text"), abbreviations, with_text)).alias("u"))
    at = [F.col("u.start_pos").cast("bigint").alias("start_pos"), F.col("u.end_pos").cast("bigint").alias("end_pos")]
    return found.select("doc_id", *at, *(["u.sentence"] if with_text else []))

"""Payloads: hashes, storage keys, format sniffing, JSON guards, dates and previews in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Source types by the word a legacy system uses (fixed values).
SOURCE_TYPES = {
    "legislation": "LEGISLATION", "law": "LEGISLATION", "regulation": "REGULATION", "resolution": "GOVERNMENT_RESOLUTION", "government_resolution": "GOVERNMENT_RESOLUTION", "order": "MINISTERIAL_ORDER", "ministerial_order": "MINISTERIAL_ORDER",
    "court": "SUPREME_COURT", "supreme_court": "SUPREME_COURT", "constitutional_court": "CONSTITUTIONAL_COURT", "treaty": "TREATY", "interpretation": "INTERPRETATION", "other": "OTHER",
}


def sha256(data: Column) -> Column:
    return F.sha2(data, 256)


def archive_key(sha: Column) -> Column:
    """archive/<2>/<sha>; null unless it is a hash in hexadecimal."""
    return F.when(F.rlike(sha, F.lit("^[0-9a-f]{64}$")), F.concat(F.lit("archive/"), F.substring(sha, 1, 2), F.lit("/"), sha))


def content_key(sha: Column) -> Column:
    """sha256/<2>/<2>/<sha>; null unless it is a hash in hexadecimal."""
    return F.when(F.rlike(sha, F.lit("^[0-9a-f]{64}$")), F.concat(F.lit("sha256/"), F.substring(sha, 1, 2), F.lit("/"), F.substring(sha, 3, 2), F.lit("/"), sha))


def node_hash(locator: Column, text: Column) -> Column:
    """Hash of a parsed node: locator and text."""
    return F.sha2(F.concat(locator, F.lit(":"), text), 256)


def metadata_checksum(fields: dict[str, Column]) -> Column:
    """Hash of the fields as one JSON object in the given order, nulls included."""
    return F.sha2(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"}), 256)


def sniff(mime: Column, payload: Column) -> Column:
    """pdf, word, html or unknown, from the media type and the first bytes; a PDF mark wins over the type."""
    media = F.lower(F.trim(F.substring_index(F.coalesce(mime, F.lit("")), ";", 1)))
    head = F.coalesce(F.lower(F.ltrim(F.substring(payload, 1, 512))), F.lit(""))
    return (
        F.when((media == "application/pdf") | payload.startswith("%PDF"), "pdf")
        .when(F.contains(media, F.lit("word")), "word")
        .when(media.isin("text/html", "application/xhtml+xml") | F.contains(head, F.lit("<html")) | head.startswith("<!doctype html"), "html")
        .otherwise("unknown")
    )


def sniff_download(mime: Column, payload: Column) -> Column:
    """As ``sniff``, for downloads: a byte order mark before a page is no part of it."""
    return sniff(mime, F.regexp_replace(payload, "^\ufeff", ""))


def accepted(kind: Column, mime: Column, payload: Column) -> Column:
    """ok, or why a payload can't be taken."""
    return (
        F.when(F.coalesce(F.length(payload), F.lit(0)) == 0, "empty_body")
        .when(kind == "unknown", F.concat(F.lit("unexpected_type:"), F.coalesce(mime, F.lit(""))))
        .when((kind == "html") & payload.startswith("%PDF"), "expected_html_got_pdf")
        .otherwise("ok")
    )


def json_object(text: Column) -> Column:
    """``text`` where it is a JSON object; null for arrays, scalars and what can't be read."""
    return F.when(F.rlike(text, F.lit(r"^\s*\{")) & F.try_parse_json(text).isNotNull(), text)


def merged(old: Column, new: Column) -> Column:
    """Two maps as one; the new value of a key wins."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def strict_date(text: Column) -> Column:
    """The date at the start of an ISO date or time; null for anything else."""
    return F.try_to_date(F.regexp_extract(text, r"^\s*([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[T ].*)?$", 1), "yyyy-MM-dd")


def source_type(text: Column) -> Column:
    """The source type of a legacy word, OTHER where it is unknown."""
    table = F.create_map(*[F.lit(x) for kv in SOURCE_TYPES.items() for x in kv])
    return F.coalesce(F.element_at(table, F.lower(F.trim(text))), F.lit("OTHER"))


def known_source_type(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin(list(SOURCE_TYPES)), F.lit(False))


def title_type(title: Column) -> Column:
    """The document type that a title names; a law unless it says otherwise."""
    low = F.lower(title)
    return F.when(F.contains(low, F.lit("тогтоол")), "GOVERNMENT_RESOLUTION").when(F.contains(low, F.lit("тушаал")), "MINISTERIAL_ORDER").otherwise("LAW")


def preview(text: Column, side: int = 1000) -> Column:
    """Both ends of a long text with the number of characters left out between them."""
    n = F.length(text)
    return F.when(n <= 2 * side, text).otherwise(F.concat(F.substring(text, 1, side), F.lit(" … ["), (n - 2 * side).cast("string"), F.lit("] … "), F.right(text, F.lit(side))))

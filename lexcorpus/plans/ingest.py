"""Queries of payloads, addresses, pages, write paths and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexcorpus.functions import html as H
from lexcorpus.functions import payload as P
from lexcorpus.functions import urls as U
from lexcorpus.operators import ingest as I
from lexcorpus.operators.audit import LOCATOR, nodes_once
from lexcorpus.plans.corpus import _BLANK, _N, _REPORT
from lexcorpus.tables import table

BASE = "https://acts.example"
HOSTS = ["khuuli-san.example", "togtool.example", "tushaal.example"]
SUFFIXES = [".test"]
SPLIT = "2019-06-01"


#: Numbers that say nothing (fixed values).
UNKNOWN = ["", "0", "n/a", "тодорхойгүй"]


def archive_put_if_absent(s: SparkSession, d: str) -> DataFrame:
    return I.put_if_absent(table(s, d, "documents"), "doc_id", "text")


def catalog_reuse(s: SparkSession, d: str) -> DataFrame:
    return I.reuse(table(s, d, "legal_source_archives"))


def archive_integrity(s: SparkSession, d: str) -> DataFrame:
    return I.integrity(table(s, d, "legal_source_archives"))


def discover_classify(s: SparkSession, d: str) -> DataFrame:
    k = table(s, d, "legal_knowledge_documents")
    at = F.lit(SPLIT).cast("timestamp_ntz")
    # an unknown number doesn't make one act of all: there the address is the key
    number = F.trim("law_id")
    k = k.withColumn("act", F.when(F.coalesce(number, F.lit("")).isin(*UNKNOWN), F.concat(F.lit("at "), F.coalesce("source_url", "id"))).otherwise(number))
    return I.classify(k.where(F.col("ingested_at") >= at), k.where(F.col("ingested_at") < at), ["act"], "content_sha256")


def run_counters(s: SparkSession, d: str) -> DataFrame:
    return discover_classify(s, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def merge_upsert(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "legal_documents")
    return I.upsert(t.where("updated_at = created_at"), t.where("updated_at > created_at"), "id", ["updated_at"]).select("id", "title", "status", "updated_at")


def insert_missing(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "legal_sources").select("id", "source_type", "jurisdiction", "base_url").distinct()
    new = table(s, d, "legal_source_archives").select("source_id", P.source_type(F.col("source_type")).alias("source_type"), "jurisdiction", U.origin(F.col("original_url")).alias("base_url"))
    new = new.groupBy("source_type", "jurisdiction", "base_url").agg(F.min("source_id").alias("id"))
    return I.insert_missing(t, new, ["source_type", "jurisdiction", "base_url"])


def replace_version(s: SparkSession, d: str) -> DataFrame:
    c = ["id", "document_version_id", "source_locator", "content_hash"]
    n = table(s, d, "legal_nodes").select(*c, "created_at", "updated_at").distinct()
    return I.replace_versions(n.where("updated_at = created_at").select(*c), n.where("updated_at > created_at").select(*c)).groupBy("document_version_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def publish_counters(s: SparkSession, d: str) -> DataFrame:
    return publish_decision(s, d).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def archive_link(s: SparkSession, d: str) -> DataFrame:
    return I.archived_bytes(table(s, d, "legal_knowledge_documents"), table(s, d, "legal_source_archives"), "archive_id", "content_sha256")


def publish_decision(s: SparkSession, d: str) -> DataFrame:
    return I.publish_decisions(table(s, d, "legal_document_versions"))


def reconcile(s: SparkSession, d: str) -> DataFrame:
    return I.reconcile(table(s, d, "citation_entries"), table(s, d, "legal_nodes"))


def reconcile_totals(s: SparkSession, d: str) -> DataFrame:
    return reconcile(s, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def shared_targets(s: SparkSession, d: str) -> DataFrame:
    return I.shared_targets(table(s, d, "citation_entries"))


def job_lifecycle(s: SparkSession, d: str) -> DataFrame:
    return I.lifecycle(table(s, d, "events"), "user_id", "event_type", "ts", "error", "purchase")


def pending_download(s: SparkSession, d: str) -> DataFrame:
    return I.pending(table(s, d, "legal_knowledge_documents"), table(s, d, "legal_source_archives"))


def gate_reasons(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "legal_document_versions").select("id", "archive_record_id", "version_number", "content_hash").distinct()
    # an archive's hash is that of the first version made from it
    first = v.groupBy("archive_record_id").agg(F.min_by("content_hash", F.struct("version_number", "id")).alias("archive_sha256"))
    hashes = v.join(first, "archive_record_id", "left").select(F.col("id").alias("document_version_id"), "archive_sha256", F.col("content_hash").alias("bytes_sha256")).where("archive_sha256 is not null")
    return I.gate_reasons(table(s, d, "legal_nodes"), table(s, d, "legal_document_versions"), table(s, d, "legal_documents"), hashes)


def parse_confidence(s: SparkSession, d: str) -> DataFrame:
    return I.confidence(table(s, d, "legal_nodes"), table(s, d, "legal_document_versions"), table(s, d, "legal_documents"))


def labelled_dates(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "legal_documents").select("id", "title", "adopted_at").distinct()
    day = F.date_format("adopted_at", "yyyy-MM-dd")
    html = F.concat(F.lit("<p>"), F.coalesce("title", F.lit("")), F.lit("</p>БАТЛАГДСАН: "), F.coalesce(day, F.lit("-")), F.lit(" хүчин  төгөлдөр болсон\n"), F.coalesce(F.replace(day, F.lit("-11-"), F.lit("-31-")), F.lit("")))
    return t.select("id", F.date_format(H.labelled_date(html, H.ADOPTED), "yyyy-MM-dd").alias("adopted"), F.date_format(H.labelled_date(html, H.EFFECTIVE), "yyyy-MM-dd").alias("effective")).distinct()


def parsed_pages(s: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit('<title>t</title><div class="menu">menu</div><div id="bordered-tab1"><div><div class="x law_content"><div>'), F.col("html"), F.lit('</div></div></div></div><div>footer</div>'))
    acts, rows = H.parsed(_pages(s, d).select(F.col("id").alias("doc_id"), page.alias("html")))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.max(F.when(F.col("ordinal") == 0, F.col("text"))).alias("root")).join(acts.select("doc_id", "title"), "doc_id")


def type_mapping(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "legal_source_archives").select("id", "source_type").distinct()
    return a.select("id", P.source_type(F.col("source_type")).alias("mapped"), P.known_source_type(F.col("source_type")).alias("known"))


def unmapped_types(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "legal_source_archives").where(~P.known_source_type(F.col("source_type"))).groupBy(F.lower(F.trim("source_type")).alias("source_type")).agg(F.countDistinct("id").alias("n"))


def title_types(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "legal_documents").select("id", "title").distinct()
    return t.select("id", P.title_type(F.col("title")).alias("document_type"))


def strict_dates(s: SparkSession, d: str) -> DataFrame:
    k = table(s, d, "legal_knowledge_documents").select("id", "valid_from").distinct()
    date = P.strict_date(F.col("valid_from"))
    return k.select("id", F.date_format(date, "yyyy-MM-dd").alias("day"), (F.col("valid_from").isNotNull() & date.isNull()).alias("rejected"))


def storage_keys(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "legal_document_versions").select("content_hash").distinct()
    return v.select("content_hash", P.archive_key(F.col("content_hash")).alias("archive_key"), P.content_key(F.col("content_hash")).alias("content_key"))


def node_hashes(s: SparkSession, d: str) -> DataFrame:
    n = nodes_once(table(s, d, "legal_nodes"))
    plain, located = P.sha256(F.col("text")), P.node_hash(F.col("source_locator"), F.col("text"))
    return n.select("id", plain.alias("text_hash"), located.alias("located_hash"), (F.col("content_hash") == plain).alias("is_text_hash"))


def metadata_checksum(s: SparkSession, d: str) -> DataFrame:
    k = table(s, d, "legal_sources").select("id", "source_name", "source_type", "base_url").distinct()
    return k.select("id", P.metadata_checksum({"title": F.col("source_name"), "type": F.col("source_type"), "url": F.col("base_url"), "note": F.lit(None).cast("string")}).alias("checksum"))


def download_check(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "legal_source_archives").select("id", "mime_type", "sha256").distinct()
    body = F.concat(F.lit("\ufeff"), F.when(F.col("sha256") < "6", "<!doctype html><p>x").when(F.col("sha256") < "c", "%PDF-1.4").otherwise("text"))
    kind = P.sniff_download(F.col("mime_type"), body)
    return a.select("id", kind.alias("kind"), P.accepted(kind, F.col("mime_type"), body).alias("accepted"))


def sniff_format(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "legal_source_archives").select("id", "mime_type", "sha256").distinct()
    body = F.when(F.col("sha256") < "4", F.concat(F.lit("%PDF-1.7 "), "sha256")).when(F.col("sha256") < "8", F.concat(F.lit(" <!DOCTYPE html><p>"), "sha256")).when(F.col("sha256") < "a", "").otherwise(F.col("sha256"))
    a = a.withColumn("body", body).withColumn("kind", P.sniff(F.col("mime_type"), F.col("body")))
    return a.select("id", "kind", P.accepted(F.col("kind"), F.col("mime_type"), F.col("body")).alias("accepted"))


def text_preview(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", P.preview(F.col("text"), 200).alias("preview"), F.substring("text", 1, 255).alias("head"))


def json_object_guard(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    raw = F.when(F.col("event_type") == "view", F.concat(F.lit("["), "props", F.lit("]"))).when(F.col("event_type") == "click", F.substring("props", 1, 3)).otherwise(F.col("props"))
    return e.select("event_id", P.json_object(raw).alias("metadata"))


def metadata_merge(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    old = F.from_json("props", "map<string,string>")
    new = F.create_map(F.lit("kind"), F.col("event_type"), F.when(F.col("event_type") == "error", F.lit("k")).otherwise(F.lit("user")), F.col("user_id").cast("string"))
    m = P.merged(old, new)
    return e.select("event_id", F.array_join(F.array_sort(F.map_keys(m)), ",").alias("names"), m["k"].alias("k"))


def url_canonical(s: SparkSession, d: str) -> DataFrame:
    k = table(s, d, "legal_knowledge_documents").select("id", "source_url").distinct()
    u = F.col("source_url")
    return k.select("id", U.law_id(u).alias("law"), U.canonical(u, BASE).alias("canonical_url"), U.host(u).alias("host"), U.origin(u).alias("origin"))


def url_guard(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "legal_documents").select("id", "canonical_url").distinct()
    return t.select("id", U.allowed(F.col("canonical_url"), HOSTS, SUFFIXES).alias("allowed"), U.private_ip(F.concat(F.length("canonical_url").cast("string"), F.lit(".0.0.1"))).alias("private"))


def backoff(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("attempt"))
    return e.select("user_id", "attempt", U.backoff_ms(F.col("attempt")).alias("wait_ms"))


def _pages(s: SparkSession, d: str) -> DataFrame:
    n = nodes_once(table(s, d, "legal_nodes"))
    html = F.concat(
        F.lit("<html><head><title> "), F.coalesce("title", F.lit("")), F.lit("</title><style>p {color: red}</style></head><body><nav>menu</nav><h1>"), F.coalesce("article", F.lit("")), F.lit("</h1><p>"), F.coalesce("source_locator", F.lit("")),
        F.lit("</p><div>"), F.coalesce("text", F.lit("")), F.lit(" 11 .1<sup>2</sup>&nbsp;&amp; <b>end</b></div><br/>Word list<script>x()</script></body></html>"),
    )
    return n.select("id", html.alias("html"))


def html_lines(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("id", F.posexplode(H.lines(F.col("html"))).alias("line_no", "line"))


def html_title(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("id", H.title(F.col("html")).alias("title"))


def line_classes(s: SparkSession, d: str) -> DataFrame:
    ls = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return ls.select("doc_id", "line_no", H.line_class(F.trim("line")).alias("kind")).where("kind <> 'text'")


def line_context(s: SparkSession, d: str) -> DataFrame:
    ls = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    # numbered lines of these texts stand for articles, capitals for chapters
    t = F.trim("line")
    kind = F.when(F.rlike(t, F.lit(r"^[0-9]+\.[0-9]+\. ")), "article").when(F.rlike(t, F.lit(r"^[0-9]+\. ")), "chapter").otherwise("text")
    return H.line_context(ls.select("doc_id", "line_no", kind.alias("kind")))


def parse_provisions(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    text = F.concat(F.lit("1 дүгээр зүйл. "), F.coalesce("text", F.lit("")))
    return H.provisions(docs.select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("lines")))


def page_links(s: SparkSession, d: str) -> DataFrame:
    from lexcorpus.sources.listing import links

    k = table(s, d, "legal_documents").select("id", "canonical_url", "title").distinct()
    page = F.concat(F.lit('<ul><li><a class="act-name" href="'), "canonical_url", F.lit('">'), "title", F.lit('</a></li><li><a class="act-name" href="https://elsewhere.invalid/x">x</a></li><li><a class="act-name" href="'), "canonical_url", F.lit('">again</a></li></ul>'))
    return links(k.select(F.col("id").alias("page_id"), page.alias("html")), HOSTS, SUFFIXES)


QUERIES = {
    f.__name__: f
    for f in (
        archive_put_if_absent, catalog_reuse, archive_integrity, discover_classify, run_counters, merge_upsert, insert_missing, replace_version, publish_decision, reconcile, reconcile_totals, shared_targets, job_lifecycle, pending_download,
        gate_reasons, publish_counters, archive_link, parse_confidence, labelled_dates, parsed_pages, type_mapping, unmapped_types, title_types, strict_dates, storage_keys, node_hashes, metadata_checksum, sniff_format, download_check, text_preview, json_object_guard, metadata_merge, url_canonical, url_guard, backoff, html_lines, html_title,
        line_classes, line_context, parse_provisions, page_links,
    )
}

_MAP = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in P.SOURCE_TYPES.items()) + "}"
_MAPPED = f"coalesce({_MAP}[lower(trim(source_type))], 'OTHER')"
_KNOWN = "coalesce(lower(trim(source_type)) IN (" + ", ".join(f"'{a}'" for a in P.SOURCE_TYPES) + "), false)"
_LAWID = "coalesce(nullif(regexp_extract({0}, '(?i)[?&]lawid=([^&#]+)', 1), ''), nullif(regexp_extract({0}, '/details?/([0-9]+)', 1), ''))"
_ORIGIN = "coalesce(lower(nullif(regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1), '')), {0})"
_HOST = "lower(nullif(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), ''))"
_PAGES = "p AS (SELECT id, coalesce(title, '') AS title, '<html><head><title> ' || coalesce(title, '') || '</title><style>p {color: red}</style></head><body><nav>menu</nav><h1>' || coalesce(article, '') || '</h1><p>' || coalesce(source_locator, '') || '</p><div>' || coalesce(text, '') || ' 11 .1<sup>2</sup>&nbsp;&amp; <b>end</b></div><br/>Word list<script>x()</script></body></html>' AS html FROM n)"
_CLASSIFIED = f"""k AS (SELECT *, CASE WHEN coalesce(trim(law_id), '') IN ({", ".join(repr(x) for x in UNKNOWN)}) THEN 'at ' || coalesce(source_url, id) ELSE trim(law_id) END AS act FROM legal_knowledge_documents),
i AS (SELECT act, max(content_sha256) AS s FROM k WHERE ingested_at >= TIMESTAMP '{SPLIT}' GROUP BY 1),
o AS (SELECT act, list(content_sha256) AS l FROM k WHERE ingested_at < TIMESTAMP '{SPLIT}' GROUP BY 1),
x AS (SELECT i.act, CASE WHEN l IS NULL THEN 'inserted' WHEN list_contains(l, s) THEN 'duplicate' ELSE 'updated' END AS outcome FROM i LEFT JOIN o USING (act))"""
_RECON = f"""{_N}, c AS (SELECT DISTINCT id, legal_node_id, document_version_id, locator, exact_text FROM citation_entries),
x AS (SELECT c.id AS citation_id, CASE WHEN n.id IS NULL THEN 'missing_node' WHEN n.document_version_id <> c.document_version_id THEN 'other_version' WHEN source_locator <> locator THEN 'other_locator'
  WHEN n.text IS DISTINCT FROM exact_text THEN CASE WHEN starts_with(n.text, exact_text) THEN 'shortened_text' ELSE 'other_text' END ELSE 'matched' END AS outcome FROM c LEFT JOIN n ON n.id = c.legal_node_id)"""


_FACTS = f"""t AS (SELECT *, coalesce(regexp_replace(regexp_replace(text, '^{_BLANK}+', ''), '{_BLANK}+$', ''), '') AS x, coalesce(regexp_replace(regexp_replace(title, '^{_BLANK}+', ''), '{_BLANK}+$', ''), '') AS tx FROM n),
f AS (SELECT document_version_id, count(*) FILTER (node_type = 'ARTICLE') AS articles, count(*) AS nodes, count(DISTINCT source_locator) AS locators, count(DISTINCT source_locator) FILTER (node_type <> 'DOCUMENT') AS cited_locators, count(*) FILTER (node_type <> 'DOCUMENT') AS cited,
  bool_or(node_type = 'ARTICLE' AND coalesce(article, '0') IN ('', '0')) AS malformed, coalesce(bool_or(node_type <> 'DOCUMENT' AND x <> ''), false) AS has_text, count(*) FILTER (node_type = 'DOCUMENT' AND parent_id IS NULL) AS roots,
  bool_or(NOT coalesce(regexp_matches(source_locator, '{LOCATOR}'), false) OR coalesce(chapter = '0', false)) AS invented, bool_or(node_type IN ('BOOK', 'PART', 'SECTION')) AS levels, bool_or(node_type <> 'DOCUMENT' AND (regexp_matches(x, '{I.CHROME_ONLY}') OR regexp_matches(tx, '{I.CHROME_ONLY}'))) AS chrome,
  bool_or(coalesce(trim(source_locator), '') = '' OR coalesce(trim(content_hash), '') = '') AS unsound FROM t GROUP BY 1),
o AS (SELECT document_version_id, bool_or(orphan) AS orphan, bool_or(invalid_parent OR incompatible) AS wrong FROM r GROUP BY 1),
e AS (SELECT id AS document_version_id, min(document_id) AS document_id, max(effective_to) IS NOT NULL AS ends FROM legal_document_versions GROUP BY 1),
acts AS (SELECT id AS document_id, unnest(arg_max(struct_pack(title, document_type), (updated_at, title, document_type))) FROM legal_documents GROUP BY 1)"""
_CONF = """CASE WHEN length(coalesce(trim(title), '')) < 3 OR title = 'Untitled' THEN 'missing_title' END, CASE WHEN coalesce(document_type, '') = '' THEN 'missing_act_type' END, CASE WHEN nodes IS NULL THEN 'missing_version' END,
  CASE WHEN locators < nodes OR orphan OR unsound THEN 'broken_article_hierarchy' END, CASE WHEN articles = 0 THEN 'no_recognizable_provisions' END, CASE WHEN nodes < 2 THEN 'suspiciously_low_node_count' END, CASE WHEN locators < nodes THEN 'duplicate_locators' END,
  CASE WHEN malformed THEN 'malformed_numbering' END, CASE WHEN NOT has_text THEN 'empty_legal_text' END"""


def _sql_lines(html: str) -> str:
    c = html
    for p in H.CHROME:
        c = f"regexp_replace({c}, '(?is){p}', ' ', 'g')"
    c = f"regexp_replace({c}, '(?i)<sup>([0-9]+)</sup>', '^\\1', 'g')"
    c = f"regexp_replace({c}, '(?i)</(?:p|div|h1|h2|h3|li|br|tr)>|<br\\s*/?>', chr(10), 'g')"
    c = f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    for a, b in H.ENTITIES:
        c = f"replace({c}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    each = f"list_transform(string_split({c}, chr(10)), lambda x: trim(regexp_replace(x, '{_BLANK}+', ' ', 'g')))"
    each = f"list_transform({each}, lambda x: regexp_replace(trim(regexp_replace(trim(regexp_replace(x, '(?i)^(?:хэвлэх|pdf|word) +', '')), '(?i)^text-align\\s*:\\s*center.>', '')), '([0-9]+)\\s+\\.([0-9])', '\\1.\\2', 'g'))"
    return f"list_filter({each}, lambda x: x <> '')"


ORACLE = {
    "archive_put_if_absent": "SELECT sha256(text) AS sha256, min(doc_id) AS first_key, count(DISTINCT doc_id) AS n_payloads, 'archive/' || left(sha256(text), 2) || '/' || sha256(text) AS storage_key, max(strlen(text)) :: INT AS byte_size FROM documents WHERE coalesce(text, '') <> '' GROUP BY 1",
    "catalog_reuse": "WITH a AS (SELECT DISTINCT id, sha256, mime_type, fetched_at FROM legal_source_archives), f AS (SELECT sha256, min((fetched_at, id, mime_type)) AS f, arg_min(id, (fetched_at, id)) AS fid, arg_min(mime_type, (fetched_at, id)) AS kept_mime FROM a GROUP BY 1) SELECT id, sha256, id <> fid AS reused, kept_mime, mime_type IS DISTINCT FROM kept_mime AS mime_differs FROM a JOIN f USING (sha256)",
    "archive_integrity": """WITH a AS (SELECT *, CASE WHEN regexp_matches(sha256, '^[0-9a-f]{64}$') THEN 'archive/' || left(sha256, 2) || '/' || sha256 END AS k FROM legal_source_archives)
SELECT DISTINCT id, 'bad_hash' AS problem FROM a WHERE k IS NULL UNION ALL SELECT DISTINCT id, 'key_mismatch' FROM a WHERE storage_key IS DISTINCT FROM k
UNION ALL SELECT DISTINCT id, 'empty' FROM a WHERE coalesce(byte_size, 0) <= 0 UNION ALL SELECT DISTINCT id, 'unverified' FROM a WHERE NOT coalesce(checksum_verified, false)""",
    "discover_classify": f"WITH {_CLASSIFIED} SELECT * FROM x",
    "run_counters": f"WITH {_CLASSIFIED} SELECT outcome, count(*) AS n FROM x GROUP BY 1",
    "merge_upsert": "SELECT id, arg_max(title, (updated_at > created_at, updated_at)) AS title, arg_max(status, (updated_at > created_at, updated_at)) AS status, arg_max(updated_at, (updated_at > created_at, updated_at)) AS updated_at FROM legal_documents GROUP BY 1",
    "insert_missing": f"WITH t AS (SELECT DISTINCT id, source_type, jurisdiction, base_url FROM legal_sources), a AS (SELECT min(source_id) AS id, {_MAPPED} AS st, jurisdiction, {_ORIGIN.format('original_url')} AS base_url FROM legal_source_archives GROUP BY 2, 3, 4) SELECT * FROM t UNION ALL SELECT id, st, jurisdiction, base_url FROM a WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.source_type = a.st AND t.jurisdiction = a.jurisdiction AND t.base_url = a.base_url)",
    "replace_version": "WITH n AS (SELECT DISTINCT id, document_version_id, source_locator, content_hash, created_at, updated_at FROM legal_nodes), u AS (SELECT * FROM n WHERE updated_at > created_at), r AS (SELECT * FROM n WHERE updated_at = created_at AND document_version_id NOT IN (SELECT document_version_id FROM u) UNION ALL SELECT * FROM u) SELECT document_version_id, count(*) AS n, min(id) AS first_id FROM r GROUP BY 1",
    "publish_decision": "WITH v AS (SELECT DISTINCT id, document_id, version_number, content_hash, parser_id FROM legal_document_versions), w AS (SELECT *, min(version_number) OVER (PARTITION BY document_id) AS a, min(version_number) OVER (PARTITION BY document_id, content_hash) AS b, min(version_number) OVER (PARTITION BY document_id, content_hash, parser_id) AS c FROM v) SELECT id, document_id, version_number, CASE WHEN version_number = a THEN 'new_document' WHEN c < version_number THEN 'unchanged' WHEN b < version_number THEN 'canonicalization' ELSE 'source_update' END AS decision FROM w",
    "publish_counters": "SELECT decision, count(*) AS n FROM (WITH v AS (SELECT DISTINCT id, document_id, version_number, content_hash, parser_id FROM legal_document_versions), w AS (SELECT *, min(version_number) OVER (PARTITION BY document_id) AS a, min(version_number) OVER (PARTITION BY document_id, content_hash) AS b, min(version_number) OVER (PARTITION BY document_id, content_hash, parser_id) AS c FROM v) SELECT id, document_id, version_number, CASE WHEN version_number = a THEN 'new_document' WHEN c < version_number THEN 'unchanged' WHEN b < version_number THEN 'canonicalization' ELSE 'source_update' END AS decision FROM w) GROUP BY 1",
    "archive_link": """WITH a AS (SELECT lower(trim(id)) AS key, arg_max(sha256, (fetched_at, sha256)) AS h FROM legal_source_archives GROUP BY 1), k AS (SELECT DISTINCT id, lower(trim(archive_id)) AS key, content_sha256 FROM legal_knowledge_documents)
SELECT id, content_sha256 AS expected_sha256, h AS archive_sha256, coalesce(h = content_sha256, false) AS ok FROM k LEFT JOIN a USING (key)""",
    "reconcile": f"WITH {_RECON} SELECT * FROM x",
    "reconcile_totals": f"WITH {_RECON} SELECT outcome, count(*) AS n FROM x GROUP BY 1",
    "shared_targets": "SELECT lower(trim(legal_node_id)) AS legal_node_id, count(DISTINCT id) AS n FROM citation_entries WHERE trim(legal_node_id) <> '' GROUP BY 1 HAVING count(DISTINCT id) > 1",
    "job_lifecycle": "SELECT user_id, min(ts) AS started_at, max(ts) AS last_at, arg_max(event_type, (ts, event_id)) AS last_kind, count(*) FILTER (event_type = 'error') AS retry_count, count(*) AS n_events, arg_max(event_type, (ts, event_id)) = 'purchase' AS finished FROM events GROUP BY 1",
    "pending_download": "SELECT DISTINCT id FROM legal_knowledge_documents k WHERE NOT EXISTS (SELECT 1 FROM legal_source_archives a WHERE lower(trim(a.id)) = lower(trim(k.archive_id)))",
    "gate_reasons": f"""WITH {_REPORT}, {_FACTS}, av AS (SELECT DISTINCT id, archive_record_id, version_number, content_hash FROM legal_document_versions WHERE archive_record_id IS NOT NULL),
af AS (SELECT archive_record_id, arg_min(content_hash, (version_number, id)) AS h FROM av GROUP BY 1), ah AS (SELECT id AS document_version_id, bool_or(h IS DISTINCT FROM content_hash) AS other FROM av JOIN af USING (archive_record_id) WHERE h IS NOT NULL GROUP BY 1),
l AS (SELECT document_version_id, [{_CONF},
  CASE WHEN coalesce(other, false) THEN 'archive_hash_mismatch' END, CASE WHEN locators < nodes THEN 'duplicate_locators' END, CASE WHEN orphan THEN 'orphan_nodes' END, CASE WHEN wrong THEN 'invalid_parent_relationships' END, CASE WHEN roots <> 1 THEN 'broken_article_hierarchy' END,
  CASE WHEN cited_locators < cited THEN 'duplicate_citation_locators' END, CASE WHEN invented THEN 'invented_locator' END, CASE WHEN levels THEN 'invented_structural_level' END, CASE WHEN chrome THEN 'chrome_or_toc_node' END, CASE WHEN coalesce(ends, false) THEN 'unsafe_effective_to' END] AS x
  FROM f JOIN o USING (document_version_id) LEFT JOIN e USING (document_version_id) LEFT JOIN acts USING (document_id) LEFT JOIN ah USING (document_version_id))
SELECT document_version_id, array_to_string(list_filter(x, lambda y, i: y IS NOT NULL AND NOT list_contains(x[1:i - 1], y)), ',') AS reasons FROM l""",
    "parse_confidence": f"""WITH {_REPORT}, {_FACTS} SELECT acts.document_id, document_version_id, array_to_string(list_filter([{_CONF}], lambda y: y IS NOT NULL), ',') AS reasons
FROM acts LEFT JOIN (f JOIN o USING (document_version_id) JOIN e USING (document_version_id)) USING (document_id)""",
    "labelled_dates": "SELECT DISTINCT id, strftime(adopted_at, '%Y-%m-%d') AS adopted, CASE WHEN month(adopted_at) <> 11 THEN strftime(adopted_at, '%Y-%m-%d') END AS effective FROM legal_documents",
    "type_mapping": f"SELECT DISTINCT id, {_MAPPED} AS mapped, {_KNOWN} AS known FROM legal_source_archives",
    "unmapped_types": f"SELECT lower(trim(source_type)) AS source_type, count(DISTINCT id) AS n FROM legal_source_archives WHERE NOT {_KNOWN} GROUP BY 1",
    "title_types": "SELECT id, CASE WHEN contains(lower(title), 'тогтоол') THEN 'GOVERNMENT_RESOLUTION' WHEN contains(lower(title), 'тушаал') THEN 'MINISTERIAL_ORDER' ELSE 'LAW' END AS document_type FROM (SELECT DISTINCT id, title FROM legal_documents)",
    "strict_dates": "WITH k AS (SELECT DISTINCT id, valid_from, try_cast(nullif(regexp_extract(valid_from, '^\\s*([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[T ].*)?$', 1), '') AS DATE) AS d FROM legal_knowledge_documents) SELECT id, strftime(d, '%Y-%m-%d') AS day, valid_from IS NOT NULL AND d IS NULL AS rejected FROM k",
    "storage_keys": "SELECT DISTINCT content_hash, 'archive/' || left(content_hash, 2) || '/' || content_hash AS archive_key, 'sha256/' || left(content_hash, 2) || '/' || substring(content_hash, 3, 2) || '/' || content_hash AS content_key FROM legal_document_versions",
    "node_hashes": f"WITH {_N} SELECT id, sha256(text) AS text_hash, sha256(source_locator || ':' || text) AS located_hash, content_hash = sha256(text) AS is_text_hash FROM n",
    "metadata_checksum": """SELECT DISTINCT id, sha256('{"title":' || to_json(source_name) || ',"type":' || to_json(source_type) || ',"url":' || to_json(base_url) || ',"note":null}') AS checksum FROM legal_sources""",
    "sniff_format": """WITH a AS (SELECT DISTINCT id, mime_type, CASE WHEN sha256 < '4' THEN '%PDF-1.7 ' || sha256 WHEN sha256 < '8' THEN ' <!DOCTYPE html><p>' || sha256 WHEN sha256 < 'a' THEN '' ELSE sha256 END AS body FROM legal_source_archives),
m AS (SELECT *, lower(trim(split_part(coalesce(mime_type, ''), ';', 1))) AS media, lower(ltrim(left(body, 512))) AS head FROM a),
k AS (SELECT *, CASE WHEN media = 'application/pdf' OR starts_with(body, '%PDF') THEN 'pdf' WHEN contains(media, 'word') THEN 'word' WHEN media IN ('text/html', 'application/xhtml+xml') OR contains(head, '<html') OR starts_with(head, '<!doctype html') THEN 'html' ELSE 'unknown' END AS kind FROM m)
SELECT id, kind, CASE WHEN length(body) = 0 THEN 'empty_body' WHEN kind = 'unknown' THEN 'unexpected_type:' || coalesce(mime_type, '') WHEN kind = 'html' AND starts_with(body, '%PDF') THEN 'expected_html_got_pdf' ELSE 'ok' END AS accepted FROM k""",
    "download_check": """WITH a AS (SELECT DISTINCT id, mime_type, CASE WHEN sha256 < '6' THEN '<!doctype html><p>x' WHEN sha256 < 'c' THEN '%PDF-1.4' ELSE 'text' END AS body FROM legal_source_archives),
m AS (SELECT *, lower(trim(split_part(coalesce(mime_type, ''), ';', 1))) AS media FROM a),
k AS (SELECT *, CASE WHEN media = 'application/pdf' OR starts_with(body, '%PDF') THEN 'pdf' WHEN contains(media, 'word') THEN 'word' WHEN media IN ('text/html', 'application/xhtml+xml') OR starts_with(body, '<!doctype html') THEN 'html' ELSE 'unknown' END AS kind FROM m)
SELECT id, kind, CASE WHEN kind = 'unknown' THEN 'unexpected_type:' || coalesce(mime_type, '') ELSE 'ok' END AS accepted FROM k""",
    "text_preview": "SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE substring(text, 1, 200) || ' … [' || (length(text) - 400) || '] … ' || right(text, 200) END AS preview, substring(text, 1, 255) AS head FROM documents",
    "json_object_guard": "WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN '[' || props || ']' WHEN 'click' THEN left(props, 3) ELSE props END AS x FROM events) SELECT event_id, CASE WHEN json_valid(x) AND json_type(x) = 'OBJECT' THEN x END AS metadata FROM e",
    "metadata_merge": "SELECT event_id, CASE WHEN event_type = 'error' THEN 'k,kind' ELSE 'k,kind,user' END AS names, CASE WHEN event_type = 'error' THEN user_id :: VARCHAR ELSE props ->> 'k' END AS k FROM events",
    "url_canonical": f"WITH k AS (SELECT DISTINCT id, source_url, {_LAWID.format('source_url')} AS law FROM legal_knowledge_documents) SELECT id, law, coalesce('{BASE}/mn/detail?lawId=' || law, regexp_replace(source_url, '[?#].*$', '')) AS canonical_url, {_HOST.format('source_url')} AS host, {_ORIGIN.format('source_url')} AS origin FROM k",
    "url_guard": f"WITH k AS (SELECT DISTINCT id, canonical_url, {_HOST.format('canonical_url')} AS h FROM legal_documents) SELECT id, regexp_matches(canonical_url, '(?i)^https://[^/?#@]+(?:[/?#]|$)') AND (h IN ({', '.join(repr(h) for h in HOSTS)}) OR ends_with(h, '{SUFFIXES[0]}')) AS allowed, regexp_matches(length(canonical_url) || '.0.0.1', '{U.PRIVATE_IPV4}') AS private FROM k",
    "backoff": "SELECT user_id, count(*) AS attempt, least(16000, 500 * power(2, least(count(*), 20) - 1)) :: BIGINT AS wait_ms FROM events WHERE event_type = 'error' GROUP BY 1",
    "html_lines": f"WITH {_N}, {_PAGES}, l AS (SELECT id, {_sql_lines('html')} AS ls FROM p) SELECT id, (i - 1) :: INT AS line_no, ls[i] AS line FROM l, unnest(range(1, len(ls) + 1)) AS u(i)",
    "html_title": f"WITH {_N}, {_PAGES}, t AS (SELECT id, trim(regexp_replace(title, '{_BLANK}+', ' ', 'g')) AS t, {_sql_lines('html')} AS ls, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h FROM p) SELECT id, coalesce(CASE WHEN length(t) >= 3 THEN t END, nullif(trim(h), ''), list_filter(ls, lambda x: regexp_matches(x, '(?i)хууль$') AND x = upper(x))[1], ls[1], 'Untitled') AS title FROM t",
    "line_classes": "WITH l AS (SELECT doc_id, (i - 1) :: INT AS line_no, trim(x[i]) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL), unnest(range(1, len(x) + 1)) AS u(i)), k AS (SELECT doc_id, line_no, CASE "
    + " ".join(f"WHEN regexp_matches(line, '{p.replace('(?iu)', '(?i)')}') THEN '{n}'" for p, n in ((H.CHROME_LINE, "chrome"), (H.CHAPTER, "chapter"), (H.WORD_ARTICLE, "article"), (H.ARTICLE, "article"), (H.QUALIFIED, "qualified"), (H.SIMPLE, "simple")))
    + " ELSE 'text' END AS kind FROM l) SELECT * FROM k WHERE kind <> 'text'",
    "line_context": """WITH l AS (SELECT doc_id, (i - 1) :: INT AS line_no, trim(x[i]) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL), unnest(range(1, len(x) + 1)) AS u(i)),
k AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '^[0-9]+\\.[0-9]+\\. ') THEN 'article' WHEN regexp_matches(line, '^[0-9]+\\. ') THEN 'chapter' ELSE 'text' END AS kind FROM l),
w AS (SELECT *, max(CASE WHEN kind = 'chapter' THEN line_no END) OVER o AS c, max(CASE WHEN kind = 'article' THEN line_no END) OVER o AS a FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))
SELECT doc_id, line_no, kind, c AS chapter_line, CASE WHEN coalesce(a > c, true) THEN a END AS article_line FROM w""",
    "page_links": f"SELECT DISTINCT id AS page_id, 0 AS ordinal, canonical_url AS url, {_LAWID.format('canonical_url')} AS law_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title FROM (SELECT DISTINCT id, canonical_url, title, {_HOST.format('canonical_url')} AS h FROM legal_documents) WHERE h IN ({', '.join(repr(h) for h in HOSTS)}) OR ends_with(h, '{SUFFIXES[0]}')",
}

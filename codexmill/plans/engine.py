"""Queries that run whole paths of the engine over files and made-up texts, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import curated as C
from ..functions import scalars as S
from ..functions import wikitext as W
from ..operators import bookmarks as B
from ..operators import ingest as I
from ..operators import retrieval as R
from ..operators import search as X
from ..operators import vectors as V
from ..sources import files as Y
from ..store import stored
from ..streaming import governance as G
from ..tables import table
from . import dumpfiles as E
from .curated_sql import sql
from .library import _FIELDS, _POST, _STATS, _TITLED, _TOK, _search, _titled

_AT = 1_720_000_000


def _module_files(s, d):
    """The modules as one TOML file each."""
    path = E.new_folder(s)
    members = C.module_members(s, d).groupBy(F.col("module_id").alias("id")).agg(F.concat_ws(", ", F.array_sort(F.collect_list(F.concat(F.lit('"'), "title", F.lit('"'))))).alias("titles"))
    for r in C.modules(s, d).join(members, "id").collect():  # a handful of hand-written files
        Y.write_text(s, f"{path}/{r['id']}.toml", f'id = "{r["id"]}"\nname = "{r["name"]}"\ndefault_tier = "{r["default_tier"]}"\nexplicit_titles = [{r["titles"]}]\n')
    return path


def _backup(s, d):
    path = f"{E.new_folder(s)}/backup.json"
    marks = C.bookmarks(s, d)
    Y.write_backup(B.export_rows(C.folders(s, d), marks), marks.count(), path, "codexmill", "bookmarks", _AT)
    return Y.read_backup(s, path, "codexmill", "bookmarks")


def _streamed_index(s, d):
    """Index files taken in as a stream, over the hot articles of before."""
    where, marks = E.new_folder(s), E.new_folder(s)
    I.write_version(C.articles(s, d).where("tier = 'hot'"), where, "page_id")
    q = I.ingest_index_stream(s, E.index_file(s, d), where, _AT, marks).trigger(availableNow=True).start()
    q.awaitTermination()
    return I.read_current(s, where).select("page_id", "title", "tier", "stream_offset")


def _ring(s, d):
    """The access log as a stream of several batches, of which a table keeps the latest thousand."""
    source, target, marks = E.new_folder(s), E.new_folder(s), E.new_folder(s)
    log = C.access_log(s, d).select("event_id", "page_id", "at")
    log.repartition(3, "event_id").write.parquet(source)
    q = s.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source).writeStream.foreachBatch(G.keep_latest(target)).option("checkpointLocation", marks).trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress.batchId if q.lastProgress else 0
    return s.read.schema(log.schema).parquet(f"{target}/v{last % 2}")


def _counted(s, d):
    df, seen = G.observed(C.access_log(s, d), "access log")
    df.write.format("noop").mode("overwrite").save()
    return s.createDataFrame([(seen.get["rows"],)], "rows bigint")


def _requests(s, d):
    """Errors are 503, every fourth 404; one attempt each."""
    e = C.access_log(s, d)
    status = F.when(F.col("event_type") != "error", 200).when(F.col("event_id") % 4 == 0, 404).otherwise(503)
    return e.select((F.col("page_id") % 20).alias("client"), F.concat(F.lit("u"), F.col("event_id") % 700).alias("url"), F.floor(F.col("at") / 400).alias("at"), "event_id", F.array(status).alias("statuses"))


def _made_text(s, d, text):
    return C.articles(s, d).where("title not like '%|%'").select("page_id", "title", text.alias("wikitext"))


def _cat(*parts):
    return F.concat(*(F.lit(p[1:]) if p.startswith("=") else F.col(p) for p in parts))


def _embedded(s, d):
    a = C.articles(s, d)
    return V.embed_titles(a, "letters", V.letter_embedder), a


def _contexts(s, d):
    """Two questions' worth of fall-back: semantic hits where there are any, else the words of the title."""
    e, a = _embedded(s, d)
    sem = V.top_k(e, a, "letters", V.letter_embedder(["Treaty of the river"])[0].tolist(), 5)
    sem = sem.select(F.lit(1).cast("bigint").alias("question_id"), "page_id", F.row_number().over(R.Window.orderBy(F.desc("score"), "page_id")).cast("bigint").alias("rank"))  # five rows
    lex = C.articles(s, d).where(F.lower("title").contains("bridge")).select("page_id", F.col("page_id").alias("rank"))
    lex = lex.withColumn("question_id", F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")))).select("question_id", "page_id", "rank")
    return R.semantic_else_lexical(sem, lex)


def _postings(s, d):
    return stored(s, d, "postings", ["documents"], lambda: X.build_postings(_titled(s, d), _FIELDS), ["term", "page_id"])


QUERIES = {
    "snk21_postings": lambda s, d: _postings(s, d).select("term", "field", "page_id", "tf", "len", F.element_at("positions", 1).alias("first")),
    "src10_module_files": lambda s, d: Y.read_modules(s, _module_files(s, d)).select("id", "name", "default_tier", F.array_join("titles", "|").alias("titles")),
    "src11_backup_folders": lambda s, d: _backup(s, d)[0],
    "src11_backup_bookmarks": lambda s, d: _backup(s, d)[1],
    "src13_checksums": lambda s, d: Y.sha1_of(s, _module_files(s, d)).select("sha1"),
    "st1_index_stream": _streamed_index,
    "st5_ring": _ring,
    "st7_progress": _counted,
    "st8_outcomes": lambda s, d: G.request_outcomes(_requests(s, d), 1.0, attempts=1).select("event_id", "outcome", "attempts", F.round("wait", 6).alias("wait")),
    "r5_boolean": lambda s, d: _search(s, d, "title:treaty AND museum NOT amber", 50),
    "r6_guarded": lambda s, d: _search(s, d, "  granite " + "x" * 5000 + " harbour ", 50),
    "r6_malformed": lambda s, d: _search(s, d, 'granite AND', 50),
    "r8_semantic": lambda s, d: (lambda e, a: V.top_k(e, a, "letters", V.letter_embedder(["Treaty of the river"])[0].tolist(), 30))(*_embedded(s, d)).select("page_id", "title", F.round("score", 6).alias("score")),
    "r8_else_lexical": lambda s, d: _contexts(s, d).select("question_id", "page_id"),
    "f12_one_edit": lambda s, d: _postings(s, d).select("term").distinct().select("term", X.within_one_edit(F.col("term"), "bridge").alias("near")),
    "f14_rest_urls": lambda s, d: C.articles(s, d).select("page_id", S.rest_url("https://x.example/html/", "title", F.col("revision_id")).alias("url")),
    "f19_internal_urls": lambda s, d: C.access_log(s, d).select("event_id", F.element_at(F.array(*map(F.lit, _URLS)), (F.col("event_id") % len(_URLS) + 1).cast("int")).alias("url")).select("event_id", S.is_internal_url("url").alias("internal")),
    "w1_tables": lambda s, d: _made_text(s, d, _cat("={|\n|+ ", "title", "=\n! A !! B\n|-\n| ", "page_id", "= || ''x''\n|}\n* one\n* ", "title", "=\n----\n pre & <b>")).select("page_id", W.render("wikitext").alias("html")),
    "w2_links": lambda s, d: _made_text(s, d, _cat("=See [[About ", "title", "=]], [[About ", "title", "=|the ''page'']], [[File:X.jpg|thumb]][[Category:Y]] and [https://x.example/", "page_id", "= here].")).select("page_id", W.render("wikitext").alias("html")),
    "w5_citations": lambda s, d: _made_text(s, d, _cat("={{cite web|title=", "title", "=|last=Doe|first=J.|date=2020|url=https://x.example/", "page_id", "=|other=}}")).select("page_id", W.render("wikitext").alias("html")),
    "w6_templates": lambda s, d: _made_text(s, d, _cat("={{convert|", "page_id", "=|km|mi}} {{lang|fr|", "title", "=}} {{IPA|abc}} {{Odd_one|", "page_id", "=}}")).select("page_id", W.render("wikitext").alias("html")),
    "w9_parameters": lambda s, d: _made_text(s, d, _cat("={{Infobox place\n| name = ", "title", "=\n| area_km2 = ", "page_id", "=\n| empty =\n| site = {{nested|a=b}} [[Some|where]]\n}}")).select("page_id", F.explode(W.infoboxes("wikitext")).alias("x")).select("page_id", "x.name", "x.key", "x.value"),
}

_URLS = ("about:blank", "https://x.example/", "http://localhost:8080/a", "http://127.0.0.1/", "ws://LOCALHOST/x", "data:text/plain,x", "javascript:alert(1)", "http://user@localhost.evil/", "pmtiles://a", "/relative", "")
_INTERNAL = (True, False, True, True, True, True, False, False, True, False, False)


def _html(c: str) -> str:
    for a, b in S.HTML_ESCAPES:
        c = f"replace({c}, '{a.replace(chr(39), chr(39) * 2)}', '{b}')"
    return c


_URL = "replace(title, ' ', '_')"
for _x in S.URL_RESERVED:
    _URL = f"replace({_URL}, '{_x}', '%{ord(_x):02X}')"
_T, _U = _html("title"), _html(_URL)
_MADE = "art WHERE title NOT LIKE '%|%'"
_LETTERS = "[" + ", ".join(f"(length(t) - length(replace(t, '{chr(97 + i)}', '')))::DOUBLE" for i in range(26)) + "]"
_ASK = "'treaty of the river'"
_SIM = f"sim AS (SELECT page_id, title, list_cosine_similarity({_LETTERS}, (SELECT {_LETTERS} FROM (SELECT {_ASK} AS t))) AS score FROM (SELECT page_id, title, translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM art) WHERE regexp_matches(t, '[a-z]'))"
_EACH = "ln(1 + (nd - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / al)))"
_DF = "(SELECT term, field, count(*) AS df FROM post GROUP BY 1, 2)"

ORACLES = {
    "snk21_postings": sql("SELECT term, field, page_id, cast(count(*) AS INTEGER) AS tf, cast(any_value(n) AS INTEGER) AS len, cast(min(i) AS INTEGER) AS first FROM (SELECT page_id, field, len(w) AS n, unnest(w) AS term, unnest(range(0, len(w))) AS i FROM tok) GROUP BY term, field, page_id", _TITLED, _TOK),
    "src10_module_files": sql("SELECT m.id, m.name, m.default_tier, string_agg(title, '|' ORDER BY title) AS titles FROM mod m JOIN mem ON module_id = m.id GROUP BY ALL"),
    "src11_backup_folders": sql("SELECT f.name, p.name AS parent, f.created_at FROM fold f LEFT JOIN fold p ON p.id = f.parent_id"),
    "src11_backup_bookmarks": sql("SELECT article_title AS title, f.name AS folder, note, b.created_at FROM book b LEFT JOIN fold f ON f.id = b.folder_id"),
    "src13_checksums": sql("SELECT sha1('id = \"' || m.id || '\"' || chr(10) || 'name = \"' || m.name || '\"' || chr(10) || 'default_tier = \"' || m.default_tier || '\"' || chr(10) || 'explicit_titles = [' || string_agg('\"' || title || '\"', ', ' ORDER BY title) || ']' || chr(10)) AS sha1 FROM mod m JOIN mem ON module_id = m.id GROUP BY m.id, m.name, m.default_tier"),
    "st1_index_stream": sql("SELECT page_id, title, CASE WHEN tier = 'hot' THEN 'hot' ELSE 'cold' END AS tier, stream_offset FROM art WHERE tier = 'hot' OR stream_offset IS NOT NULL"),
    "st5_ring": sql('SELECT event_id, page_id, "at" FROM log ORDER BY "at" DESC, event_id DESC LIMIT 1000'),
    "st7_progress": sql("SELECT count(*) AS rows FROM log"),
    "st8_outcomes": sql(
        "SELECT event_id, outcome, attempts, round(wait, 6) AS wait FROM rec WHERE n > 0",
        "ev AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY client ORDER BY t_at, event_id) AS n FROM (SELECT page_id % 20 AS client, 'u' || (event_id % 700) AS url, floor(\"at\" / 400)::DOUBLE AS t_at, event_id, CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 4 = 0 THEN 404 ELSE 503 END AS status FROM log))",
        "rec AS (SELECT DISTINCT client, 0::BIGINT AS n, 0::BIGINT AS event_id, NULL::DOUBLE AS tokens, NULL::DOUBLE AS last, []::DOUBLE[] AS recent, NULL::DOUBLE AS until, []::VARCHAR[] AS cache, '' AS outcome, 0 AS attempts, 0::DOUBLE AS wait FROM ev UNION ALL "
        "SELECT client, n, event_id, CASE WHEN go THEN t - 1 ELSE tokens END, CASE WHEN go THEN greatest(t_at, coalesce(last, t_at)) ELSE last END, CASE WHEN trips THEN [] ELSE r2 END, CASE WHEN trips THEN t_at + w + 300 ELSE u1 END, CASE WHEN go AND status = 200 THEN list_append(cache, url) ELSE cache END, "
        "CASE WHEN u0 IS NOT NULL THEN 'broken' WHEN NOT go THEN 'cached' WHEN status = 200 THEN 'sent' WHEN status = 404 THEN 'failed' WHEN trips OR u1 IS NOT NULL THEN 'broken' ELSE 'exhausted' END, CASE WHEN go THEN 1 ELSE 0 END, CASE WHEN go THEN w ELSE 0 END FROM ("
        "SELECT *, go AND status = 503 AND u1 IS NULL AND len(r2) >= 10 AS trips FROM ("
        "SELECT *, CASE WHEN go AND status = 503 AND u1 IS NULL THEN list_append(list_filter(r0, lambda x: t_at + w - x <= 60), t_at + w) ELSE r0 END AS r2 FROM ("
        "SELECT *, u0 AS u1, CASE WHEN t >= 1 THEN 0 ELSE 1 - t END AS w FROM ("
        "SELECT *, u0 IS NULL AND NOT list_contains(cache, url) AS go, CASE WHEN tokens IS NULL THEN 1::DOUBLE ELSE least(1::DOUBLE, tokens + greatest(0, t_at - last)) END AS t FROM ("
        "SELECT e.client, e.n, e.event_id, e.url, e.t_at, e.status, r.tokens, r.last, r.cache, CASE WHEN r.until IS NOT NULL AND e.t_at >= r.until THEN NULL ELSE r.until END AS u0, CASE WHEN r.until IS NOT NULL AND e.t_at >= r.until THEN [] ELSE r.recent END AS r0 FROM rec r JOIN ev e ON e.client = r.client AND e.n = r.n + 1))))))",
    ),
    "r5_boolean": sql(
        f"SELECT page_id, title, round(score, 6) AS score, false AS fuzzy FROM (SELECT page_id, sum(score) AS score FROM hit GROUP BY 1 HAVING count(DISTINCT clause) = 2) h JOIN doc USING (page_id) WHERE page_id NOT IN (SELECT page_id FROM post WHERE term = 'amber') ORDER BY h.score DESC, page_id LIMIT 50",
        _TITLED, _TOK, _POST, _STATS,
        f"hit AS (SELECT page_id, 0 AS clause, 3.0::DOUBLE * {_EACH} AS score FROM post JOIN {_DF} USING (term, field) JOIN stats USING (field) WHERE term = 'treaty' AND field = 'title' UNION ALL SELECT page_id, 1, CASE WHEN field = 'title' THEN 3.0::DOUBLE ELSE 1 END * {_EACH} FROM post JOIN {_DF} USING (term, field) JOIN stats USING (field) WHERE term = 'museum')",
    ),
    "r6_guarded": sql(
        "SELECT page_id, title, round(score, 6) AS score, false AS fuzzy FROM hit JOIN doc USING (page_id) ORDER BY hit.score DESC, page_id LIMIT 50",
        _TITLED, _TOK, _POST, _STATS,
        f"hit AS (SELECT page_id, sum(CASE WHEN field = 'title' THEN 3.0::DOUBLE ELSE 1 END * {_EACH}) AS score FROM post JOIN {_DF} USING (term, field) JOIN stats USING (field) WHERE term = 'granite' GROUP BY 1)",
    ),
    "r6_malformed": "SELECT doc_id AS page_id, title, 0::DOUBLE AS score, false AS fuzzy FROM documents WHERE false",
    "r8_semantic": sql("SELECT page_id, title, round(score, 6) AS score FROM sim ORDER BY sim.score DESC, page_id LIMIT 30", _SIM),
    "r8_else_lexical": sql("SELECT 1::BIGINT AS question_id, page_id FROM (SELECT page_id FROM sim ORDER BY score DESC, page_id LIMIT 5) UNION ALL SELECT 2, page_id FROM art WHERE contains(lower(title), 'bridge')", _SIM),
    "f12_one_edit": sql("SELECT DISTINCT term, damerau_levenshtein(term, 'bridge') <= 1 AS near FROM post", _TITLED, _TOK, _POST),
    "f14_rest_urls": sql("SELECT page_id, 'https://x.example/html/' || url_encode(title) || '/html' || coalesce('/' || revision_id, '') AS url FROM art"),
    "f19_internal_urls": sql("SELECT event_id, [" + ", ".join(map(str, _INTERNAL)) + f"][event_id % {len(_URLS)} + 1] AS internal FROM log"),
    "w1_tables": sql(f"SELECT page_id, '<table class=\"wk-grid\"><caption>' || {_T} || '</caption><tr><th>A</th><th>B</th></tr><tr><td>' || page_id || '</td><td><em>x</em></td></tr></table><ul><li>one</li><li>' || {_T} || '</li></ul><hr/><pre class=\"wk-typed\">pre &amp; </pre>' AS html FROM {_MADE}"),
    "w2_links": sql(f"SELECT page_id, '<p>See <a href=\"#/article/' || {_U} || '\" class=\"wk-link\">' || {_T} || '</a>, <a href=\"#/article/' || {_U} || '\" class=\"wk-link\">the <em>page</em></a>, <span class=\"wk-picture\">File:X.jpg</span> and <a href=\"https://x.example/' || page_id || '\" class=\"wk-web\" target=\"_blank\" rel=\"noopener noreferrer\">here</a>.</p>' AS html FROM (SELECT page_id, 'About ' || title AS title FROM {_MADE})"),
    "w5_citations": sql(f"SELECT page_id, '<p><span class=\"wk-source\">“' || {_T} || '”. Doe, J.. (2020). <a href=\"https://x.example/' || page_id || '\" target=\"_blank\" rel=\"noopener noreferrer\">https://x.example/' || page_id || '</a></span></p>' AS html FROM {_MADE}"),
    "w6_templates": sql(f"SELECT page_id, '<p><span class=\"wk-measure\">' || page_id || ' km</span> ' || {_T} || ' abc <span class=\"wk-template\">{{Odd_one}}</span></p>' AS html FROM {_MADE}"),
    "w9_parameters": sql(f"SELECT page_id, 'Infobox place' AS name, unnest(['name', 'area km2', 'site']) AS key, unnest([title, cast(page_id AS VARCHAR), '{{nested}} where']) AS value FROM {_MADE}"),
}

"""Queries of changes, bookmarks, modules, vectors, search and retrieval, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import curated as C
from ..operators import bookmarks as B
from ..operators import mutations as M
from ..operators import retrieval as R
from ..operators import search as X
from ..operators import vectors as V
from ..operators.ingest import backfill_embeddings
from ..store import stored
from ..tables import table
from .curated_sql import sql

def _now():
    return F.lit(1_720_000_000).cast("bigint")


def _change(s, d):
    """All raw article rows as a stream of changes, ordered by their update."""
    a = table(s, d, "articles").where("page_id is not null and title is not null and tier is not null")
    return a.withColumn("seq", F.coalesce("updated_at", F.lit(0)))


_CUT = "2024-01-01"


def _replayed(rows, keys, values, order, upsert):
    """The table as it was at a moment, changed by all rows loaded later; it must be the table of today."""
    then, later = rows.where(f"loaded_at < timestamp_ntz '{_CUT}'"), rows.where(f"loaded_at >= timestamp_ntz '{_CUT}'")
    return upsert(C.latest(then, keys, order).select(*keys, *values), later.withColumn("seq", F.struct(*order)), "seq")


def _titled(s, d):
    """Documents stand for the search corpus: page_id, title, body, tier."""
    tier = F.element_at(F.array(*map(F.lit, ("hot", "hot", "warm", "warm", "warm", "cold", "cold", "cold", "cold", "evicted"))), (F.col("doc_id") % 10 + 1).cast("int"))
    return table(s, d, "documents").select(F.col("doc_id").alias("page_id"), F.coalesce("title", F.lit("")).alias("title"), F.col("text").alias("body"), tier.alias("tier"))


_FIELDS = {"title": "title", "body": "body"}


def _search(s, d, q, n, tiers=None):
    c = _titled(s, d)
    postings = stored(s, d, "postings", ["documents"], lambda: X.build_postings(c, _FIELDS), ["term", "page_id"])
    stats = stored(s, d, "corpus_stats", ["documents"], lambda: X.corpus_stats(c, _FIELDS), ["field"])
    r = X.search(postings, stats, c, q, n, tiers)
    return r.select("page_id", "title", F.round("score", 6).alias("score"), "fuzzy")


def _archive(s, d):
    r = C.saved_revisions(s, d).withColumnRenamed("id", "page_id")
    p = X.build_postings(r, {"title": "title", "wikitext": "wikitext", "note": "user_note"}, stemmed=True)
    size = r.select("page_id", sum((F.size(X.tokens(c)) for c in ("title", "wikitext", "user_note")), F.lit(0)).alias("len"))
    return X.search_archive(p, size, "granite lighthouses", 40).select("page_id", F.round("score", 6).alias("score"))


def _query_vector(s, d):
    return [float(x) for x in table(s, d, "embeddings").where("vec_id = 7").first()["embedding"]]


def _vector_articles(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("page_id"), F.concat(F.lit("Vector "), "vec_id").alias("title"), F.when(F.col("vec_id") % 10 == 9, "evicted").otherwise("cold").alias("tier"))


def _imported(s, d):
    b = C.bookmarks(s, d)
    folders, marks, counters = B.import_bookmarks(
        C.folders(s, d), b,
        C.folders(s, d).select(F.upper("name").alias("name"), F.lit(None).cast("string").alias("parent"), "created_at").unionByName(s.createDataFrame(_INCOMING, "name string, parent string, created_at bigint")),
        b.where("note is not null").select(F.concat("article_title", F.when(F.col("folder_id").isNull(), F.lit(" II")).otherwise("")).alias("title"), F.lit("new").alias("folder"), "note", "created_at"),
    )
    return folders, marks, counters


#: Folders of an import: new ones, a cycle, an orphan with a child and a grandchild, names apart by Unicode case only, one name twice.
_INCOMING = [
    ("New", "1-URGENT", 5), ("loop a", "loop b", 6), ("loop b", "loop a", 7), ("under new", "new", 8), ("Orphan", "nowhere", 9), ("child", "ORPHAN", 10),
    ("grandchild", "child", 11), ("\u00c4rger", None, 12), ("below", "\u00e4RGER", 13), ("\u00e4rger", "New", 14), ("twice", "nowhere", 1), ("Twice", "below", 15),
]
_MADE = [
    ("New", "1-URGENT"), ("loop a", None), ("loop b", None), ("under new", "New"), ("Orphan", None), ("child", None),
    ("grandchild", None), ("\u00c4rger", None), ("below", "\u00c4rger"), ("Twice", "below"),
]


def _parents(folders):
    p = folders.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    return folders.join(p, "parent_id", "left").select("name", "parent")


def _first_page(s, d):
    return C.articles(s, d).agg(F.min("page_id")).first()[0]


def _moved(s, d):
    a, hot, warm = M.set_tier(C.articles(s, d), C.hot_content(s, d), C.hot_content(s, d).limit(0), _first_page(s, d), "warm", "moved text")
    return a.where("tier = 'warm'").select("page_id", "tier").join(warm, "page_id", "left").join(hot.select("page_id", F.length("wikitext").alias("hot_chars")), "page_id", "left")


def _total(c):
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"))


QUERIES = {
    "snk1_upsert": lambda s, d: M.upsert_metadata(C.articles(s, d), _change(s, d), _now(), "seq"),
    "snk2_upsert_cold": lambda s, d: M.batch_upsert_cold(C.articles(s, d), _change(s, d), _now(), "seq").select("page_id", "tier", "pinned", "last_accessed", "access_count", "created_at", "updated_at", "stream_offset"),
    "snk3_upsert_geotags": lambda s, d: _replayed(C.geotag_rows(s, d), ["page_id", "lat", "lon"], ["primary_", "kind"], ["loaded_at", "primary_", "kind"], M.upsert_geotags),
    "snk4_upsert_links": lambda s, d: _replayed(C.categorylink_rows(s, d), ["cl_from", "cl_to"], ["cl_type"], ["loaded_at", "cl_timestamp", "cl_type"], M.upsert_categorylinks),
    "snk5_upsert_redirects": lambda s, d: _replayed(C.redirect_rows(s, d), ["from_page_id"], ["target_title"], ["loaded_at"], M.upsert_redirects),
    "snk6_upsert_embeddings": lambda s, d: M.upsert_embeddings(C.embeddings(s, d), C.embeddings(s, d).where("model = 'm1'").withColumn("model", F.lit("new")).withColumn("embedding", F.reverse(F.slice("embedding", 1, 40)))).select("page_id", "model", F.size("embedding").alias("dims"), F.round(_total("embedding"), 4).alias("total"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first")),
    "snk9_touch": lambda s, d: M.touch_all(C.articles(s, d), C.access_log(s, d)).select("page_id", "last_accessed", "access_count"),
    "snk10_clear": lambda s, d: M.clear_history(C.articles(s, d))[1],
    "snk11_add_bookmarks": lambda s, d: B.add_bookmarks(C.bookmarks(s, d).where("folder_id is not null"), C.bookmarks(s, d)).select("article_title", "folder_id").distinct(),
    "snk12_move": lambda s, d: B.move_bookmarks(C.bookmarks(s, d), C.bookmarks(s, d).where("note is not null").select("id", F.lit(3).cast("bigint").alias("folder_id"))).select("id", "folder_id"),
    "snk12_remove": lambda s, d: B.remove_bookmarks(C.bookmarks(s, d), C.bookmarks(s, d).where("folder_id is null").select("id")),
    "snk14_delete_folder": lambda s, d: B.delete_folders(C.folders(s, d), C.bookmarks(s, d), s.createDataFrame([(1,)], "id bigint"))[1].select("id", "folder_id"),
    "snk15_import_folders": lambda s, d: _parents(_imported(s, d)[0]),
    "snk15_counters": lambda s, d: _imported(s, d)[2],
    "snk15_import_bookmarks": lambda s, d: _imported(s, d)[1].select("article_title", "note", "created_at"),
    "snk16_export": lambda s, d: B.export_rows(C.folders(s, d), C.bookmarks(s, d)),
    "snk17_save_revision": lambda s, d: M.save_revisions(C.saved_revisions(s, d).where("fetched_at < 1704067200"), C.saved_revisions(s, d).withColumn("user_note", F.lit("again")), _now()).select("title", "revision_id", "fetched_at", "user_note"),
    "snk7_set_tier": lambda s, d: _moved(s, d),
    "snk8_pin": lambda s, d: M.pin(C.articles(s, d), _first_page(s, d), True).select("page_id", "pinned"),
    "snk13_rename_folder": lambda s, d: B.rename_folder(C.folders(s, d), 2, "Renamed"),
    "snk18_delete_revision": lambda s, d: M.delete_rows(C.saved_revisions(s, d), "id", C.saved_revisions(s, d).agg(F.min("id")).first()[0]).select("id", "title", "revision_id"),
    "snk19_install_module": lambda s, d: B.list_modules(*M.install_module(C.modules(s, d), C.module_members(s, d), {"id": "asia", "name": "Asia again", "explicit_titles": ["X", "Y", "X"]}, 9)),
    "snk20_uninstall_module": lambda s, d: B.list_modules(*M.uninstall_module(C.modules(s, d), C.module_members(s, d), "europe")),
    "snk24_embed": lambda s, d: backfill_embeddings(C.articles(s, d), C.embeddings(s, d), "letters", V.letter_embedder).select("page_id", "model", F.size("embedding").alias("dims"), F.round(_total("embedding"), 4).alias("total")),
    "q14_revisions_of_title": lambda s, d: B.revisions_of(C.saved_revisions(s, d), C.saved_revisions(s, d).agg(F.max("title")).first()[0]),
    "q9_is_bookmarked": lambda s, d: B.is_bookmarked(C.bookmarks(s, d), C.bookmarks(s, d).select((F.concat(F.lit("Article "), F.col("id") % 9000)).alias("title")).distinct()),
    "q10_unfiled": lambda s, d: B.in_folder(C.bookmarks(s, d), None, 100),
    "q11_all_bookmarks": lambda s, d: B.all_bookmarks(C.bookmarks(s, d)),
    "q12_folders": lambda s, d: B.list_folders(C.folders(s, d)),
    "q14_revisions": lambda s, d: B.list_revisions(C.saved_revisions(s, d)),
    "q15_modules": lambda s, d: B.list_modules(C.modules(s, d), C.module_members(s, d).where("module_id <> 'asia'")),
    "q15_owners": lambda s, d: B.owners_of(C.module_members(s, d), C.modules(s, d), F.col("title").startswith("I")),
    "a7_folder_tally": lambda s, d: B.folder_tally(C.bookmarks(s, d)),
    "t2_cosine_top_k": lambda s, d: V.top_k(C.embeddings(s, d), _vector_articles(s, d), "m1", _query_vector(s, d), 25).select("page_id", "title", F.round("score", 6).alias("score")),
    "f10_blob": lambda s, d: C.embeddings(s, d).select("page_id", F.length(V.encode_blob("embedding")).alias("n_bytes"), (V.decode_blob(V.encode_blob("embedding")) == F.col("embedding")).alias("same")),
    "f11_self_cosine": lambda s, d: C.embeddings(s, d).select("page_id", F.round(V.cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("score")),
    "r1_tokens": lambda s, d: _titled(s, d).select("page_id", F.explode(X.tokens("title")).alias("term")).groupBy("term").agg(F.count("*").alias("n")),
    "r2_bm25": lambda s, d: _search(s, d, "granite lighthouse harbour", 50),
    "r2_phrase": lambda s, d: _search(s, d, '+"tonnes a year" -granite', 50),
    "r3_tiers": lambda s, d: _search(s, d, "museum amber", 50, ["hot", "warm"]),
    "r4_fuzzy": lambda s, d: _search(s, d, "brigde", 40),
    "r7_archive": _archive,
    "a8_corpus": lambda s, d: X.corpus_stats(_titled(s, d), _FIELDS).select("field", "n_docs", F.round("avg_len", 6).alias("avg_len")),
    "j12_merged_lists": lambda s, d: X.merge_lists(
        _titled(s, d).where("tier = 'hot'").select("page_id", "title"), _titled(s, d).where("tier = 'warm'").select("page_id", F.upper("title").alias("title")), C.articles(s, d).select("page_id", "title")
    ),
    "r10_contexts": lambda s, d: R.contexts(table(s, d, "chat_context").where("page_id is not null").groupBy("question_id", "page_id").agg(F.min("id").alias("rank")), C.articles(s, d), C.hot_content(s, d)).select("question_id", "id", "page_id", "title", F.md5("snippet").alias("snippet_md5")),
    "r11_sources": lambda s, d: R.sources_block(table(s, d, "chat_context").groupBy("question_id", "id").agg(F.min("title").alias("title"), F.min("snippet").alias("snippet"))),
    "r12_citations": lambda s, d: C.access_log(s, d).select("event_id", F.concat(F.lit("See [A"), F.col("page_id") % 7, F.lit("][A2][A2] and [A99] or [A"), F.col("event_id") % 5, F.lit("].")).alias("answer")).select("event_id", F.array_join(R.citations("answer", F.array(*map(F.lit, range(1, 6)))), ",").alias("cited")),
}

_CHANGE = f"chg AS (SELECT * FROM (SELECT * FROM articles WHERE page_id IS NOT NULL AND title IS NOT NULL AND tier IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY coalesce(updated_at, 0) DESC, title DESC NULLS LAST, tier DESC NULLS LAST, pinned DESC NULLS LAST, stream_offset DESC NULLS LAST, stream_length DESC NULLS LAST, revision_id DESC NULLS LAST) = 1)"
_CHANGE2 = _CHANGE.replace("title DESC NULLS LAST, tier DESC NULLS LAST, pinned DESC NULLS LAST, stream_offset DESC NULLS LAST, stream_length DESC NULLS LAST, revision_id DESC NULLS LAST", "title DESC NULLS LAST, stream_offset DESC NULLS LAST")
_EVEN = "even AS (SELECT * FROM art)"  # the table before the change
_TITLED = "doc AS (SELECT doc_id AS page_id, coalesce(title, '') AS title, text AS body, ['hot', 'hot', 'warm', 'warm', 'warm', 'cold', 'cold', 'cold', 'cold', 'evicted'][doc_id % 10 + 1] AS tier FROM documents)"
_WORDS = "list_filter(string_split_regex(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' AND strlen(x) < 40)"
_TOK = f"tok AS MATERIALIZED (SELECT page_id, 'title' AS field, {_WORDS.format('title')} AS w FROM doc UNION ALL SELECT page_id, 'body', {_WORDS.format('body')} FROM doc)"
_POST = "post AS MATERIALIZED (SELECT page_id, field, term, count(*) AS tf, any_value(n) AS n FROM (SELECT page_id, field, len(w) AS n, unnest(w) AS term FROM tok) GROUP BY 1, 2, 3)"
_STATS = "stats AS (SELECT field, count(*) AS nd, avg(len(w)) AS al FROM tok GROUP BY 1)"
_EACH = "CASE WHEN field = 'title' THEN 3.0::DOUBLE ELSE 1 END * ln(1 + (nd - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / al)))"


def _hits(words: str) -> str:
    return f"hit AS (SELECT page_id, sum({_EACH}) AS score FROM post JOIN (SELECT term, field, count(*) AS df FROM post GROUP BY 1, 2) USING (term, field) JOIN stats USING (field) WHERE term IN ({words}) GROUP BY 1)"


ORACLES = {
    "snk1_upsert": sql("SELECT coalesce(e.page_id, c.page_id) AS page_id, " + ", ".join(f"CASE WHEN c.page_id IS NOT NULL THEN c.{x} ELSE e.{x} END AS {x}" for x in ("title", "tier", "pinned", "stream_offset", "stream_length", "revision_id")) + ", CASE WHEN e.page_id IS NOT NULL THEN e.last_accessed ELSE 0 END AS last_accessed, CASE WHEN e.page_id IS NOT NULL THEN e.access_count ELSE 0 END AS access_count, CASE WHEN e.page_id IS NOT NULL THEN e.created_at ELSE 1720000000 END AS created_at, CASE WHEN c.page_id IS NOT NULL THEN 1720000000 ELSE e.updated_at END AS updated_at FROM even e FULL JOIN chg c ON c.page_id = e.page_id", _EVEN, _CHANGE),
    "snk2_upsert_cold": sql("SELECT coalesce(e.page_id, c.page_id) AS page_id, CASE WHEN e.page_id IS NULL THEN 'cold' ELSE e.tier END AS tier, CASE WHEN e.page_id IS NULL THEN false ELSE e.pinned END AS pinned, CASE WHEN e.page_id IS NULL THEN 0 ELSE e.last_accessed END AS last_accessed, CASE WHEN e.page_id IS NULL THEN 0 ELSE e.access_count END AS access_count, CASE WHEN e.page_id IS NULL THEN 1720000000 ELSE e.created_at END AS created_at, CASE WHEN c.page_id IS NOT NULL THEN 1720000000 ELSE e.updated_at END AS updated_at, CASE WHEN c.page_id IS NOT NULL THEN c.stream_offset ELSE e.stream_offset END AS stream_offset FROM even e FULL JOIN chg c ON c.page_id = e.page_id", _EVEN, _CHANGE2),
    "snk3_upsert_geotags": sql("SELECT page_id, lat, lon, primary_, kind FROM geo"),
    "snk4_upsert_links": sql("SELECT cl_from, cl_to, cl_type FROM cl"),
    "snk5_upsert_redirects": sql("SELECT from_page_id, target_title FROM red"),
    "snk6_upsert_embeddings": sql("SELECT page_id, model, cast(len(e) AS INTEGER) AS dims, round(list_sum(cast(e AS DOUBLE[])), 4) AS total, round(cast(e[1] AS DOUBLE), 6) AS first FROM (SELECT page_id, CASE WHEN model = 'm1' THEN 'new' ELSE model END AS model, CASE WHEN model = 'm1' THEN list_reverse(embedding[1:40]) ELSE embedding END AS e FROM emb)"),
    "snk9_touch": sql("SELECT a.page_id, greatest(last_accessed, t) AS last_accessed, coalesce(access_count, 0) + coalesce(n, 0) AS access_count FROM art a LEFT JOIN (SELECT page_id, max(\"at\") AS t, count(*) AS n FROM log GROUP BY 1) l ON l.page_id = a.page_id"),
    "snk10_clear": sql("SELECT count(*) FILTER (last_accessed > 0 OR access_count > 0) AS n FROM art"),
    "snk11_add_bookmarks": sql("SELECT DISTINCT article_title, folder_id FROM book"),
    "snk12_move": sql("SELECT id, CASE WHEN note IS NOT NULL THEN 3 ELSE folder_id END AS folder_id FROM book"),
    "snk12_remove": sql("SELECT * FROM book WHERE folder_id IS NOT NULL"),
    "snk14_delete_folder": sql("SELECT id, CASE WHEN folder_id IN (SELECT id FROM down) THEN NULL ELSE folder_id END AS folder_id FROM book", "down AS (SELECT CAST(1 AS BIGINT) AS id UNION SELECT f.id FROM fold f JOIN down ON f.parent_id = down.id)"),
    "snk15_import_folders": sql("SELECT f.name, p.name AS parent FROM fold f LEFT JOIN fold p ON p.id = f.parent_id UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{n}', {p})" for n, p in ((n, f"'{p}'" if p else "NULL") for n, p in _MADE)) + ") v(name, parent)"),
    "snk15_counters": sql(f"SELECT cast({len(_MADE)} AS BIGINT) AS folders_added, (SELECT count(*) FROM fold) AS folders_merged, (SELECT count(DISTINCT article_title || CASE WHEN folder_id IS NULL THEN ' II' ELSE '' END) FROM book WHERE note IS NOT NULL) AS bookmarks_added, (SELECT count(*) FROM book WHERE note IS NOT NULL) - (SELECT count(DISTINCT article_title || CASE WHEN folder_id IS NULL THEN ' II' ELSE '' END) FROM book WHERE note IS NOT NULL) AS bookmarks_skipped"),
    "snk15_import_bookmarks": sql("SELECT article_title, note, created_at FROM book UNION ALL SELECT title, note, created_at FROM (SELECT article_title || CASE WHEN folder_id IS NULL THEN ' II' ELSE '' END AS title, note, created_at FROM book WHERE note IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY title ORDER BY created_at, note NULLS FIRST) = 1"),
    "snk16_export": sql("SELECT 'folder' AS kind, '{\"name\":\"' || f.name || '\"' || coalesce(',\"parent\":\"' || p.name || '\"', '') || ',\"created_at\":' || f.created_at || '}' AS json FROM fold f LEFT JOIN fold p ON p.id = f.parent_id UNION ALL SELECT 'bookmark', '{\"title\":\"' || article_title || '\"' || coalesce(',\"folder\":\"' || f.name || '\"', '') || coalesce(',\"note\":\"' || note || '\"', '') || ',\"created_at\":' || b.created_at || '}' FROM book b LEFT JOIN fold f ON f.id = b.folder_id"),
    "snk17_save_revision": sql("SELECT title, revision_id, CASE WHEN fetched_at < 1704067200 THEN fetched_at ELSE 1720000000 END AS fetched_at, 'again' AS user_note FROM rev"),
    "snk7_set_tier": sql("SELECT a.page_id, 'warm' AS tier, CASE WHEN a.page_id = m.p THEN 'moved text' END AS wikitext, CASE WHEN a.page_id <> m.p THEN cast(length(h.wikitext) AS INTEGER) END AS hot_chars FROM art a CROSS JOIN (SELECT min(page_id) AS p FROM art) m LEFT JOIN hot h ON h.page_id = a.page_id WHERE tier = 'warm' OR a.page_id = m.p"),
    "snk8_pin": sql("SELECT page_id, pinned OR page_id = (SELECT min(page_id) FROM art) AS pinned FROM art"),
    "snk13_rename_folder": sql("SELECT id, CASE WHEN id = 2 THEN 'Renamed' ELSE name END AS name, parent_id, created_at FROM fold"),
    "snk18_delete_revision": sql("SELECT id, title, revision_id FROM rev WHERE id > (SELECT min(id) FROM rev)"),
    "snk19_install_module": sql("SELECT id, CASE WHEN id = 'asia' THEN 'Asia again' ELSE name END AS name, CASE WHEN id = 'asia' THEN 'cold' ELSE default_tier END AS default_tier, installed_at, CASE WHEN id = 'asia' THEN 2 ELSE (SELECT count(*) FROM mem WHERE module_id = m.id) END AS member_count FROM mod m"),
    "snk20_uninstall_module": sql("SELECT m.*, (SELECT count(*) FROM mem WHERE module_id = m.id) AS member_count FROM mod m WHERE id <> 'europe'"),
    "snk24_embed": sql("SELECT coalesce(a.page_id, e.page_id) AS page_id, CASE WHEN a.page_id IS NULL THEN e.model ELSE 'letters' END AS model, CASE WHEN a.page_id IS NULL THEN cast(len(e.embedding) AS INTEGER) ELSE 26 END AS dims, round(CASE WHEN a.page_id IS NULL THEN list_sum(cast(e.embedding AS DOUBLE[])) ELSE length(regexp_replace(a.title, '[^A-Za-z]', '', 'g')) END, 4) AS total FROM art a FULL JOIN emb e ON e.page_id = a.page_id"),
    "q14_revisions_of_title": sql("SELECT id, title, revision_id, fetched_at, user_note FROM rev WHERE title = (SELECT max(title) FROM rev)"),
    "q9_is_bookmarked": sql("SELECT title, title IN (SELECT article_title FROM book) AS bookmarked FROM (SELECT DISTINCT 'Article ' || (id % 9000) AS title FROM book)"),
    "q10_unfiled": sql("SELECT * FROM book WHERE folder_id IS NULL ORDER BY created_at DESC, id DESC LIMIT 100"),
    "q11_all_bookmarks": sql("SELECT * FROM book"),
    "q12_folders": sql("SELECT id, name, parent_id, created_at FROM fold"),
    "q14_revisions": sql("SELECT id, title, revision_id, fetched_at, user_note FROM rev"),
    "q15_modules": sql("SELECT m.*, (SELECT count(*) FROM mem WHERE module_id = m.id AND module_id <> 'asia') AS member_count FROM mod m"),
    "q15_owners": sql("SELECT mem.title, mod.id, mod.name FROM mem JOIN mod ON mod.id = module_id WHERE starts_with(mem.title, 'I')"),
    "a7_folder_tally": sql("SELECT coalesce(cast(folder_id AS VARCHAR), 'unfiled') AS folder, count(*) AS n FROM book GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM book"),
    "t2_cosine_top_k": sql("SELECT page_id, 'Vector ' || page_id AS title, round(list_cosine_similarity(cast(embedding AS DOUBLE[]), (SELECT cast(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)), 6) AS score FROM emb WHERE model = 'm1' ORDER BY list_cosine_similarity(cast(embedding AS DOUBLE[]), (SELECT cast(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)) DESC, page_id LIMIT 25"),
    "f10_blob": sql("SELECT page_id, cast(len(embedding) * 4 AS INTEGER) AS n_bytes, true AS same FROM emb"),
    "f11_self_cosine": sql("SELECT page_id, round(list_cosine_similarity(cast(embedding AS DOUBLE[]), list_reverse(cast(embedding AS DOUBLE[]))), 6) AS score FROM emb"),
    "r1_tokens": sql(f"SELECT term, count(*) AS n FROM (SELECT unnest({_WORDS.format('title')}) AS term FROM doc) GROUP BY 1", _TITLED),
    "r2_bm25": sql("SELECT page_id, title, round(score, 6) AS score, false AS fuzzy FROM hit JOIN doc USING (page_id) ORDER BY hit.score DESC, page_id LIMIT 50", _TITLED, _TOK, _POST, _STATS, _hits("'granite', 'lighthouse', 'harbour'")),
    "r2_phrase": sql(
        f"SELECT page_id, title, round(score, 6) AS score, false AS fuzzy FROM (SELECT page_id, sum({_EACH}) AS score FROM ph JOIN (SELECT field, count(*) AS df FROM ph GROUP BY 1) USING (field) JOIN stats USING (field) GROUP BY 1) h JOIN doc USING (page_id) WHERE page_id NOT IN (SELECT page_id FROM post WHERE term = 'granite') ORDER BY h.score DESC, page_id LIMIT 50",
        _TITLED, _TOK, _POST, _STATS,
        "ph AS (SELECT * FROM (SELECT page_id, field, len(w) AS n, len(list_filter(range(1, len(w) - 1), lambda i: w[i] = 'tonnes' AND w[i + 1] = 'a' AND w[i + 2] = 'year')) AS tf FROM tok) WHERE tf > 0)",
    ),
    "r3_tiers": sql("SELECT page_id, title, round(score, 6) AS score, false AS fuzzy FROM hit JOIN doc USING (page_id) WHERE tier IN ('hot', 'warm') ORDER BY hit.score DESC, page_id LIMIT 50", _TITLED, _TOK, _POST, _STATS, _hits("'museum', 'amber'")),
    "r4_fuzzy": sql("SELECT page_id, title, 0.0::DOUBLE AS score, true AS fuzzy FROM doc WHERE page_id IN (SELECT page_id FROM post WHERE field = 'title' AND damerau_levenshtein(term, 'brigde') <= 1) ORDER BY page_id LIMIT 40", _TITLED, _TOK, _POST),
    "r7_archive": sql(
        "SELECT page_id, round(score, 6) AS score FROM (SELECT page_id, sum(greatest(1e-6::DOUBLE, ln((nd - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / al)))) AS score FROM per JOIN (SELECT stem, count(*) AS df FROM per GROUP BY 1) USING (stem) JOIN words USING (page_id) CROSS JOIN (SELECT count(*) AS nd, avg(n) AS al FROM words) GROUP BY 1 HAVING count(*) = 2) ORDER BY score DESC, page_id LIMIT 40",
        f"words AS MATERIALIZED (SELECT id AS page_id, list_concat({_WORDS.format('title')}, list_concat({_WORDS.format('wikitext')}, {_WORDS.format('user_note')})) AS w, len(w) AS n FROM rev)",
        "per AS (SELECT page_id, stem, count(*) AS tf FROM (SELECT page_id, CASE WHEN t IN ('granite', 'granites') THEN 1 WHEN t IN ('lighthouse', 'lighthouses') THEN 2 END AS stem FROM (SELECT page_id, unnest(w) AS t FROM words)) WHERE stem IS NOT NULL GROUP BY 1, 2)",
    ),
    "a8_corpus": sql("SELECT field, nd AS n_docs, round(al, 6) AS avg_len FROM stats", _TITLED, _TOK, _STATS),
    "j12_merged_lists": sql(
        "SELECT page_id, title, 0 AS source FROM l0 UNION ALL SELECT page_id, title, 1 FROM l1 WHERE f NOT IN (SELECT f FROM l0) UNION ALL SELECT page_id, title, 2 FROM l2 WHERE f NOT IN (SELECT f FROM l0 UNION SELECT f FROM l1)",
        _TITLED, *(f"{n} AS (SELECT page_id, {t} AS title, translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS f FROM {w})" for n, t, w in (("l0", "title", "doc WHERE tier = 'hot'"), ("l1", "upper(title)", "doc WHERE tier = 'warm'"), ("l2", "title", "art"))),
    ),
    "r12_citations": sql("SELECT event_id, array_to_string(list_filter(CASE WHEN page_id % 7 = 2 THEN CASE WHEN event_id % 5 = 2 THEN [2] ELSE [2, event_id % 5] END WHEN event_id % 5 IN (2, page_id % 7) THEN [page_id % 7, 2] ELSE [page_id % 7, 2, event_id % 5] END, lambda x: x BETWEEN 1 AND 5), ',') AS cited FROM log"),
    "r10_contexts": sql("SELECT question_id, cast(id AS INTEGER) AS id, r.page_id, a.title, md5(CASE WHEN a.tier = 'hot' AND wikitext IS NOT NULL THEN CASE WHEN strlen(wikitext) <= 600 THEN wikitext ELSE wikitext[1:len(list_filter([strlen(wikitext[1:k]) for k in range(1, 601)], lambda b: b <= 600))] || '…' END WHEN a.tier = 'warm' AND wikitext IS NOT NULL THEN '(article ''' || a.title || ''' available in storage)' ELSE '(no local snippet for ''' || a.title || ''')' END) AS snippet_md5 FROM (SELECT question_id, page_id, row_number() OVER (PARTITION BY question_id ORDER BY min(id), page_id) AS id FROM chat_context WHERE page_id IS NOT NULL GROUP BY 1, 2) r JOIN art a ON a.page_id = r.page_id LEFT JOIN hot h ON h.page_id = r.page_id WHERE id <= 5"),
    "r11_sources": "SELECT question_id, string_agg('[A' || id || '] ' || coalesce(title, '') || ': ' || coalesce(snippet, ''), chr(10) ORDER BY id NULLS FIRST) AS sources FROM (SELECT question_id, id, min(title) AS title, min(snippet) AS snippet FROM chat_context GROUP BY 1, 2) GROUP BY 1",
}

"""Lookups, changes, bookmarks, search, vectors and retrieval on small hand-made tables."""

import math

import pytest
from pyspark.sql import functions as F

from codexmill.functions import scalars as S
from codexmill.functions.porter import stem
from codexmill.operators import bookmarks as B
from codexmill.operators import category, geo, lookup, retrieval
from codexmill.operators import mutations as M
from codexmill.operators import search as X
from codexmill.operators import vectors as V

ART = "page_id bigint, title string, tier string, pinned boolean, stream_offset bigint, stream_length bigint, revision_id bigint, last_accessed bigint, access_count bigint, created_at bigint, updated_at bigint"


def art(spark, *rows):
    base = dict(tier="cold", pinned=False, stream_offset=None, stream_length=None, revision_id=None, last_accessed=0, access_count=0, created_at=1, updated_at=1)
    return spark.createDataFrame([tuple({**base, **r}[c.split()[0]] for c in ART.split(", ")) for r in rows], ART)


def titles(df):
    return [r.title for r in df.collect()]


def test_prefix_suggestions(spark):
    a = art(spark, *(dict(page_id=i, title=t, tier="evicted" if t == "Voltage" else "cold") for i, t in enumerate(["United States", "United Kingdom", "United", "Uruguay", "100% Orange Juice", "1000 Genomes Project", "Volcano", "Voltage", "Éclair"])))
    assert titles(lookup.titles_with_prefix(a, "united")) == ["United", "United States", "United Kingdom"]
    # The prefix counts as it is given: nothing is trimmed, and an underscore is one.
    assert titles(lookup.titles_with_prefix(a, "united ")) == ["United States", "United Kingdom"] and titles(lookup.titles_with_prefix(a, "united_")) == []
    assert titles(lookup.titles_with_prefix(a, "100%")) == ["100% Orange Juice"] and titles(lookup.titles_with_prefix(a, "vol")) == ["Volcano"]
    assert titles(lookup.titles_with_prefix(a, "  ")) == [] and titles(lookup.titles_with_prefix(a, "é")) == [] and len(titles(lookup.titles_with_prefix(a, "u", 0))) == 1


def test_lru_and_history(spark):
    a = art(spark, *(dict(page_id=i, title=f"t{i}", tier="hot", last_accessed=10, access_count=4 if i > 3 else 1, pinned=i == 1) for i in range(1, 6)))
    assert titles(lookup.lru_candidates(a, 2)) == ["t2", "t3"]
    log = spark.createDataFrame([(2, 50), (2, 60), (77, 5)], "page_id bigint, at bigint")
    assert titles(lookup.recent_articles(M.touch_all(a, log), 1)) == ["t2"]
    cleared, n = M.clear_history(a)
    assert n.first().n == 5 and lookup.recent_articles(cleared).count() == 0


def test_random_probe_never_gives_evicted(spark):
    a = art(spark, *(dict(page_id=i, title=str(i), tier="evicted" if i == 5000 else "cold") for i in (5, 17, 23, 99, 1000, 5000)))
    got = {titles(lookup.random_article(a, s))[0] for s in range(12)}
    assert "5000" not in got and len(got) > 1 and lookup.random_article(a.limit(0), 1).count() == 0


def test_content_and_tiers(spark):
    a = art(spark, dict(page_id=1, title="A", tier="hot"), dict(page_id=2, title="B", tier="cold", stream_offset=9), dict(page_id=3, title="C"), dict(page_id=4, title="D", tier="evicted"))
    hot = spark.createDataFrame([(1, "text")], "page_id bigint, wikitext string")
    assert {r.page_id: r.kind for r in lookup.article_content(a, hot).collect()} == {1: "hot", 2: "cold", 3: "error", 4: "evicted"}
    a2, h2, w2 = M.set_tier(a, hot, hot.limit(0), 1, "warm", "new")
    assert h2.count() == 0 and w2.first().wikitext == "new" and lookup.lookup(a2, "A").first().tier == "warm"
    for bad in (lambda: M.set_tier(a, hot, hot, 1, "hot"), lambda: M.set_tier(a, hot, hot, 3, "cold"), lambda: M.set_tier(a, hot, hot, 99, "cold"), lambda: M.set_tier(a, hot, hot, 1, "tepid", "x"), lambda: M.pin(a, 99, True)):
        with pytest.raises(ValueError):
            bad()


def test_cold_upsert_keeps_what_it_must(spark):
    a = art(spark, dict(page_id=1, title="Old", tier="hot", pinned=True, access_count=7, stream_offset=1))
    change = spark.createDataFrame([(1, "New", 5, 1), (1, "Newer", 6, 2), (2, "Two", 7, 3)], "page_id bigint, title string, stream_offset bigint, seq int")
    got = {r.page_id: r for r in M.batch_upsert_cold(a, change, F.lit(99).cast("bigint"), "seq").collect()}
    assert (got[1].title, got[1].tier, got[1].pinned, got[1].access_count, got[1].stream_offset, got[1].created_at, got[1].updated_at) == ("Newer", "hot", True, 7, 6, 1, 99)
    assert (got[2].tier, got[2].pinned, got[2].access_count, got[2].created_at) == ("cold", False, 0, 99)
    with pytest.raises(ValueError):
        M.check_titles(a.unionByName(a.withColumn("page_id", F.lit(9).cast("bigint"))))
    again = M.batch_upsert_cold(M.batch_upsert_cold(a, change, F.lit(99).cast("bigint"), "seq"), change, F.lit(99).cast("bigint"), "seq")
    assert {r.page_id: r for r in again.collect()} == got


def test_pages_tile_the_set(spark):
    tags = spark.createDataFrame([(i, float(i), 0.0, i != 8, None) for i in range(1, 9)] + [(99, 1.0, 1.0, True, None), (1, 5.0, 5.0, True, "k")], "page_id bigint, lat double, lon double, primary_ boolean, kind string")
    a = art(spark, *(dict(page_id=i, title=f"t{i}") for i in range(1, 9)))
    pages = [[tuple(r) for r in geo.primary_geotags_page(tags, a, o, 3).collect()] for o in (0, 3, 6, 9)]
    assert [len(p) for p in pages] == [3, 3, 2, 0] and geo.count_primary(tags, a).first().n == 8
    rows = geo.primary_geotags(tags, a)
    deep, last = [], None
    while part := lookup.page_after(rows, ["page_id", "lat", "lon"], last, 3).collect():
        deep += [tuple(r) for r in part]
        last = (part[-1].page_id, part[-1].lat, part[-1].lon)
    assert deep == sum(pages, [])
    assert {r.page_id: (r.lat, r.primary_) for r in geo.geotag_per_page(tags).collect()}[1] == (1.0, True)


def test_categories(spark):
    links = spark.createDataFrame([(1, "Big_cat", "page"), (2, "Big_cat", "page"), (2, "Other", "page"), (3, "Other", "page"), (1, "Other", "page"), (9, "Big_cat", "subcat"), (10, "Sub", "subcat"), (9, "Leaf", "subcat"), (4, "Sub", "page"), (5, "Leaf", "page")], "cl_from bigint, cl_to string, cl_type string")
    a = art(spark, *(dict(page_id=i, title=t) for i, t in ((1, "One"), (2, "Two"), (3, "Three"), (9, "Category:Sub"), (10, "Category:Leaf"))))
    assert titles(category.category_members(links, a, "Big cat")) == ["Category:Sub", "One", "Two"]
    assert titles(category.category_members(links, a, "Sub")) == ["Category:Leaf", "Sub"] and titles(category.category_members(links, a, "Sub", "page", repaired=True)) == ["#4"]
    assert [(r.title, r.shared) for r in category.related_to(links, a, "One").collect()] == [("Two", 2), ("Three", 1)]
    roots = spark.createDataFrame([("Big cat",)], "root string")
    assert sorted((r.page_id, r.level) for r in category.closure_to_depth(links, a, roots, 5).collect()) == [(1, 0), (2, 0), (4, 1), (5, 2)]
    assert sorted(r.page_id for r in category.closure_to_depth(links, a, roots, 1).collect()) == [1, 2, 4]
    assert [r.category for r in category.search_categories(links, "big c").collect()] == ["Big cat"]


def test_bookmark_import(spark):
    F_, B_ = "id bigint, name string, parent_id bigint, created_at bigint", "id bigint, article_title string, folder_id bigint, note string, created_at bigint"
    folders, marks = spark.createDataFrame([(1, "Physics", None, 1)], F_), spark.createDataFrame([(1, "Photon", 1, None, 1)], B_)
    new_f = spark.createDataFrame([("PHYSICS", None, 5), ("Quantum", "physics", 5), ("Deep", "quantum", 5), ("Orphan", "nowhere", 5), ("a", "b", 5), ("b", "a", 5)], "name string, parent string, created_at bigint")
    new_b = spark.createDataFrame([("Photon", "physics", None, 5), ("Quark", "DEEP", "n", 5), ("Lost", "unknown", None, 5), ("Lost", None, None, 6)], "title string, folder string, note string, created_at bigint")
    f, b, c = B.import_bookmarks(folders, marks, new_f, new_b)
    assert c.first().asDict() == dict(folders_added=5, folders_merged=1, bookmarks_added=2, bookmarks_skipped=2)
    name = {r.id: r.name for r in f.collect()}
    assert {r.name: name.get(r.parent_id) for r in f.collect()} == {"Physics": None, "Quantum": "Physics", "Deep": "Quantum", "Orphan": None, "a": None, "b": None}
    assert {r.article_title: name.get(r.folder_id) for r in b.collect()} == {"Photon": "Physics", "Quark": "Deep", "Lost": None}
    assert B.import_bookmarks(f, b, new_f, new_b)[2].first().asDict() == dict(folders_added=0, folders_merged=6, bookmarks_added=0, bookmarks_skipped=4)
    f2, b2 = B.delete_folders(f, b, f.where("name = 'Physics'").select("id"))
    assert sorted(r.name for r in f2.collect()) == ["Orphan", "a", "b"] and {r.folder_id for r in b2.collect()} == {None}
    assert {r.folder: r.n for r in B.folder_tally(b).collect()}["unfiled"] == 1
    assert [r.article_title for r in B.in_folder(b, None).collect()] == ["Lost"]


def corpus(spark):
    rows = [(1, "Photon", "A photon is a quantum of light", "hot"), (2, "Electron", "The electron is a charged particle of matter", "warm"), (3, "Quark", "A quark is a particle; gravity acts", "warm"), (4, "Higgs boson", "The boson gives mass", "cold"), (5, "Cooking", "Cooking is heat applied to food and light meals", "cold"), (6, "Gravity", "short", "cold"), (7, None, None, "cold")]
    return spark.createDataFrame(rows, "page_id bigint, title string, body string, tier string")


def run(spark, q, n=10, tiers=None):
    c = corpus(spark)
    f = {"title": "title", "body": "body"}
    return X.search(X.build_postings(c, f), X.corpus_stats(c, f), c, q, n, tiers)


def test_search(spark):
    assert titles(run(spark, "gravity"))[:2] == ["Gravity", "Quark"]
    assert titles(run(spark, "light", tiers=["cold"])) == ["Cooking"]
    assert set(titles(run(spark, "particle light"))) == {"Photon", "Electron", "Quark", "Cooking"}
    assert set(titles(run(spark, '"quantum of light"'))) == {"Photon"} and titles(run(spark, '"of quantum"')) == []
    assert titles(run(spark, "+particle -charged")) == ["Quark"] and titles(run(spark, "title:gravity")) == ["Gravity"]
    assert set(titles(run(spark, "particle AND electron"))) == {"Electron"}
    assert [(r.title, r.fuzzy) for r in run(spark, "Photno").collect()] == [("Photon", True)]
    assert titles(run(spark, "qua")) == [] and titles(run(spark, "fotno photno")) == [] and titles(run(spark, "gravity", 0)) == []
    for bad in ('"open', "", "AND x", "x AND", "a (b", "nofield:x"):
        assert titles(run(spark, bad)) == [], bad
    c = corpus(spark)
    p, s = X.build_postings(c, {"title": "title"}), X.corpus_stats(c, {"title": "title"})
    score = X.search(p, s, c, "photon", 1).first().score
    n, al = 7, (1 + 1 + 1 + 2 + 1 + 1 + 0) / 7
    assert math.isclose(score, 3 * math.log(1 + (n - 1 + 0.5) / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 1 / al)))


def test_stemmer_and_archive(spark):
    for w, s in dict(caresses="caress", ponies="poni", cats="cat", feed="feed", agreed="agre", plastered="plaster", motoring="motor", conflated="conflat", hopping="hop", falling="fall", filing="file", happy="happi", sky="sky", relational="relat", rational="ration", vietnamization="vietnam", triplicate="triplic", hopefulness="hope", revival="reviv", adoption="adopt", controlling="control", probate="probat", rate="rate", yes="ye").items():
        assert stem(w) == s, w
    c = corpus(spark)
    p = X.build_postings(c, {"title": "title", "body": "body"}, stemmed=True)
    size = c.select("page_id", (F.size(X.tokens("title")) + F.size(X.tokens("body"))).alias("len"))
    assert [r.page_id for r in X.search_archive(p, size, "particles charging").collect()] == [2]
    with pytest.raises(ValueError):
        X.search_archive(p, size, '"')


def test_merge_lists(spark):
    mk = lambda *t: spark.createDataFrame([(i, x) for i, x in enumerate(t)], "page_id int, title string")
    got = X.merge_lists(mk("Ab", "C"), mk("aB", "D"), mk("d", "c", "É", "é")).collect()
    assert sorted((r.source, r.title) for r in got) == [(0, "Ab"), (0, "C"), (1, "D"), (2, "É"), (2, "é")]


def test_vectors(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0], "m"), (2, [0.71, 0.71], "m"), (3, [0.0, 1.0], "m"), (4, [-1.0, 0.0], "m"), (5, [0.0, 0.0], "m"), (6, [1.0], "m"), (7, [1.0, 0.0], "other"), (8, [1.0, 0.0], "m")], "page_id bigint, embedding array<float>, model string")
    a = art(spark, *(dict(page_id=i, title=f"t{i}", tier="evicted" if i == 8 else "cold") for i in range(1, 9)))
    got = V.top_k(e, a, "m", [2.0, 0.0], 3).collect()
    assert [r.page_id for r in got] == [1, 8, 2] and abs(got[2].score - 0.70710678) < 1e-6
    for q, k in (([], 3), ([0.0, 0.0], 3), ([1.0, 0.0], 0)):
        assert V.top_k(e, a, "m", q, k).count() == 0
    b = e.select("page_id", V.encode_blob("embedding").alias("b")).select("b", V.decode_blob("b").alias("v"), V.decode_blob(F.expr("substring(b, 1, 3)")).alias("bad"))
    assert all(len(r.b) == 4 * len(r.v) and r.bad is None for r in b.collect())
    emb = V.embed_titles(lookup.without_embedding(a, e, "m").unionByName(a.select("page_id", "title")), "new", V.hashing_embedder(8)).collect()
    assert len(emb) == 9 and len(emb[0].embedding) == 8


def test_retrieval(spark):
    s = spark.createDataFrame([("a" * 599 + "é" + "b",), ("é" * 300,), ("x" * 601,), (None,)], "t string")
    assert [r[0] for r in s.select(S.truncate_snippet("t", 600)).collect()] == ["a" * 599 + "…", "é" * 300, "x" * 600 + "…", None]
    t = spark.createDataFrame([("x [A1] y [A2][A2] z [A99]",), ("none",), ("[A2] [A1] [a1] [A]",)], "t string")
    assert [r[0] for r in t.select(retrieval.citations("t", F.array(F.lit(1), F.lit(2)))).collect()] == [[1, 2], [], [2, 1]]
    ctx = spark.createDataFrame([(1, 2, "B", "y"), (1, 1, "A", "x"), (2, 1, None, None)], "question_id bigint, id int, title string, snippet string")
    assert {r[0]: r[1] for r in retrieval.sources_block(ctx).collect()} == {1: "[A1] A: x\n[A2] B: y", 2: "[A1] : "}
    sem, lex = (spark.createDataFrame(x, "question_id int, page_id int, rank int") for x in ([(1, 1, 1)], [(1, 2, 1), (2, 3, 1)]))
    assert sorted((r[0], r[1]) for r in retrieval.semantic_else_lexical(sem, lex).collect()) == [(1, 1), (2, 3)]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    L = F.lit
    assert one(S.slugify(L("  Hello, Wörld! "))) == "hello-w-rld" and one(S.slugify(L("日本"))) == "section"
    assert one(S.html_escape(L("<a href=\"x\">'&'</a>"))) == "&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;&lt;/a&gt;"
    assert one(S.url_encode_title(L('A b?c%d#"'))) == "A_b%3Fc%25d%23%22"
    hrefs = {"#/article/A_b%20c": "A b c", "./X#frag": "X", "//en.wikipedia.org/wiki/C%2B%2B?x=1": "C++", "https://de.m.wikipedia.org/wiki/A+B": "A+B", "/wiki/Q_r": "Q r", "https://example.org/wiki/X": None}
    for h, t in hrefs.items():
        assert one(S.title_from_href(L(h))) == t, h
    assert [one(S.backoff_seconds(L(i))) for i in range(9)] == [1, 1, 2, 4, 8, 16, 32, 60, 60] and one(S.backoff_seconds(L(1), L(900))) == 300
    assert one(S.retry_after(L(" 12 "))) == 12 and one(S.retry_after(L("Wed, 21 Oct"))) is None
    ranges = {"bytes=10-20": (10, 20), "bytes=50-": (50, 99), "bytes=-25": (75, 99), "bytes=90-200": (90, 99), "bytes=200-300": None, "bytes=1-2,4-5": None, "lines=1-2": None, "bytes=-0": None, "bytes=-500": (0, 99), None: (0, 99), "bytes=9-3": None}
    for h, r in ranges.items():
        got = one(S.byte_range(L(h).cast("string"), L(100)))
        assert (None if got is None else tuple(got)) == r, h
    assert one(S.coordinate_label(L(-42.5), L(71.0))) == "42.50° S · 71.00° E"
    assert [one(S.relative_time(L(t).cast("bigint"), L(1_000_000))) for t in (0, None, 999_990, 999_000, 990_000, 800_000, 5)] == ["never", "never", "just now", "16 min ago", "2 hr ago", "2 days ago", "1970-01-01"]
    assert [one(S.is_internal_url(L(u))) for u in ("about:blank", "http://localhost:1420/x", "https://example.org", "ws://127.0.0.1", "file:///etc")] == [True, True, False, True, False]
    assert one(S.rest_url("https://x.org/page/", L("A/b c?"))) == "https://x.org/page/A%2Fb%20c%3F/html"
    d = one(S.disk_projection(L(100), L(1000), L(10)))
    assert abs(d.free_after_pct - 9.0) < 1e-9 and d.warn
    toc = one(S.table_of_contents(L('<h2 id="a">A <em>b</em></h2><p>x</p><h3 id="c">C</h3><h4 id="d">D</h4><h2 id="e"> </h2><h2>none</h2>')))
    assert [(t.level, t.id, t.text) for t in toc] == [(2, "a", "A b"), (3, "c", "C")]

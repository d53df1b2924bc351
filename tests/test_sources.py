"""Dumps, files, wikitext and streaming on generated fixtures."""

import bz2
import gzip
import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from codexmill.functions import wikitext as W
from codexmill.operators import bookmarks as B
from codexmill.sources import dumps as D
from codexmill.sources import files as X
from codexmill.streaming import governance as G

PAGES = [(23535, "Photon", 1, "light & <b>"), (9404, "Electron", 2, "''charge''\n== H =="), (25313, "Quark: a tale", 3, ""), (35179, "Higgs boson", 4, "mass")]


def page_xml(p):
    esc = lambda x: x.replace("&", "&amp;").replace("<", "&lt;")
    return f'  <page>\n <title>{esc(p[1])}</title><ns>0</ns><id>{p[0]}</id><revision><id>{p[2]}</id><contributor><username>u</username><id>999</id></contributor><text xml:space="preserve">{esc(p[3])}</text></revision>\n</page>\n'


@pytest.fixture
def dump(tmp_path):
    """A multistream dump, two pages a stream, and its index."""
    data, index = bz2.compress(b"<mediawiki><siteinfo/>\n"), []
    for i in range(0, 4, 2):
        index += [f"{len(data)}:{p[0]}:{p[1]}" for p in PAGES[i : i + 2]]
        data += bz2.compress("".join(map(page_xml, PAGES[i : i + 2])).encode())
    data += bz2.compress(b"</mediawiki>\n")
    (tmp_path / "d.xml.bz2").write_bytes(data)
    half = "\n".join(index[:2]) + "\r\n\n"
    (tmp_path / "d.txt.bz2").write_bytes(bz2.compress(half.encode()) + bz2.compress(("\n".join(index[2:]) + "\n").encode()))
    return tmp_path


def test_dump(spark, dump):
    digest = hashlib.sha1((dump / "d.xml.bz2").read_bytes()).hexdigest()
    index = D.read_index(spark, str(dump / "d.txt.bz2"))
    assert sorted((r.page_id, r.title) for r in index.collect()) == sorted((p[0], p[1]) for p in PAGES)
    for got in (D.read_pages(spark, str(dump / "d.xml.bz2")), D.read_streams(index, str(dump / "d.xml.bz2"))):
        assert sorted(map(tuple, got.collect())) == sorted(PAGES)
    for where in (str(dump / "made"), f"file://{dump}/addressed"):
        made = D.write_multistream(spark.createDataFrame(PAGES, "page_id bigint, title string, revision_id bigint, wikitext string"), where, 2)
        assert sorted(map(tuple, D.read_streams(made, where).collect())) == sorted(PAGES) and made.select("file", "stream_offset").distinct().count() >= 2
    assert sorted(map(tuple, D.read_streams(index, f"file://{dump}/d.xml.bz2").collect())) == sorted(PAGES)
    sha = X.sha1_of(spark, str(dump / "d.xml.bz2"))
    assert sha.first().sha1 == digest and X.verify_sha1(sha, digest.upper()).first().ok
    for bad in ("x:1:T", "12"):
        with pytest.raises(Exception, match="bad index line"):
            D.parse_index_lines(spark.createDataFrame([(bad,)], "value string")).collect()
    with pytest.raises(Exception, match="bad page id"):
        D.parse_page_xml(spark.createDataFrame([("<page><title>x</title><id>z</id></page>",)], "value string")).collect()


def split_tuples(values):
    """The fields of each tuple up to a ';' outside them, character by character."""
    out, i = [], 0
    while i < len(values) and values[i] != ";":
        if values[i] == "(":
            fields, now, quoted, i = [], [], False, i + 1
            while i < len(values) and (quoted or values[i] != ")"):
                c = values[i]
                if quoted and c == "\\" and i + 1 < len(values):
                    i += 1
                    now.append(values[i])
                elif c == "'":
                    quoted = not quoted
                elif c == "," and not quoted:
                    fields.append("".join(now).strip())
                    now = []
                else:
                    now.append(c)
                i += 1
            if i >= len(values):
                break  # not closed
            out.append([*fields, "".join(now).strip()])
        i += 1
    return out


def test_tuples(spark):
    r = random.Random(6)
    parts = ["(", ")", ",", "'", "''", "\\'", "a", "1", " ", "NULL", "é", ";", "\n"]
    rows = [r"(1,'a\'b',NULL),( 2 ,'x''y, (z)','\\n');", "(1,,'')", "()", "(" + "1," * 200_000 + "2)", "('" + "\\'" * 200_000 + "')"]
    rows += ["".join(r.choices(parts, k=r.randrange(1, 16))) for _ in range(2000)]
    df = spark.createDataFrame([(i, "INSERT INTO `t` VALUES " + x) for i, x in enumerate(rows)], "i bigint, value string")
    got = {}
    for x in D.insert_tuples(df.where("i < 5"), "t").collect() + D.insert_tuples(df.where("i >= 5"), "t").collect():
        got[tuple(x.fields)] = got.get(tuple(x.fields), 0) + 1
    want = {}
    for x in rows:
        for f in split_tuples(x):
            want[tuple(f)] = want.get(tuple(f), 0) + 1
    assert got == want


def test_table_dumps(spark, tmp_path):
    geo = "INSERT INTO `geo_tags` VALUES (1,10,'earth',1,51.5,-0.1,500,'city','L\\'x; y',NULL,NULL),(2,11,'earth',0,999,0,1,NULL,'',NULL,NULL);\nINSERT INTO `other` VALUES (1,2);\nINSERT INTO `geo_tags` VALUES (3,12,'earth',1,-5,7,1,NULL,'a''b',NULL,NULL);\n"
    with gzip.open(tmp_path / "g.sql.gz", "wt") as f:
        f.write(geo)
    got = D.geotags_from(D.read_table_dump(spark, str(tmp_path / "g.sql.gz"), "geo_tags", 2))
    assert sorted(map(tuple, got.collect())) == [(10, 51.5, -0.1, True, "city"), (12, -5.0, 7.0, True, None)]
    st = lambda t, v: spark.createDataFrame([(f"INSERT INTO `{t}` VALUES {v}",)], "value string")
    cl = D.categorylinks_from(D.insert_tuples(st("categorylinks", "(1,'A','','','','','page'),(2,'','','','','','page'),(3,'B','','','','','weird'),(4,'C','','','','','subcat')"), "categorylinks"))
    assert sorted(map(tuple, cl.collect())) == [(1, "A", "page"), (4, "C", "subcat")]
    rd = D.redirects_from(D.insert_tuples(st("redirect", "(1,0,'A_b','',''),(2,1,'C','',''),(3,0,'D','wiki',''),(4,0,'_','',''),(5,0,'E',NULL,'')"), "redirect"))
    assert list(map(tuple, rd.collect())) == [(1, "A b")]


def test_modules_and_settings(spark, tmp_path):
    p = tmp_path / "m.toml"
    p.write_text('id = "science-basics"\nname = "S"\n[[categories]]\nname = "Physics"\ndepth = 2\nexplicit_titles = ["X"]\n')
    spec = X.read_module(str(p))
    assert "explicit_titles" not in spec  # the key belongs to the table before it
    for bad in ({"id": "A b", "name": "x", "explicit_titles": ["t"]}, {"id": "a", "name": " ", "explicit_titles": ["t"]}, {"id": "a", "name": "x"}, {"id": "a", "name": "x", "categories": [{"name": "c", "depth": 50}]}):
        with pytest.raises(ValueError):
            X.check_module(bad)
    s = str(tmp_path / "s.json")
    assert X.load_settings(s, {"a": 1}) == {"a": 1}
    X.save_settings(s, {"a": 2, "z": 3})
    assert X.load_settings(s, {"a": 1}) == {"a": 2}
    (tmp_path / "s.json").write_text("{broken")
    assert X.load_settings(s, {"a": 1}) == {"a": 1}
    (tmp_path / "b.bin").write_bytes(bytes(range(100)))
    assert X.read_window(str(tmp_path / "b.bin"), 10, 12) == b"\n\x0b\x0c"


def test_backup_round_trip(spark, tmp_path):
    f = spark.createDataFrame([(1, "Phys", None, 5), (2, "Sub", 1, 6)], "id bigint, name string, parent_id bigint, created_at bigint")
    b = spark.createDataFrame([(1, 'Pho"ton', 2, "é", 7), (2, "X", None, None, 8)], "id bigint, article_title string, folder_id bigint, note string, created_at bigint")
    path = X.write_backup(B.export_rows(f, b), 2, str(tmp_path), "app", "bookmarks", 99)
    folders, marks, newer = X.read_backup(spark, path, "app", "bookmarks")
    assert not newer and sorted((r.name, r.parent) for r in folders.collect()) == [("Phys", None), ("Sub", "Phys")]
    assert sorted((r.title, r.folder, r.note) for r in marks.collect()) == [('Pho"ton', "Sub", "é"), ("X", None, None)]
    with pytest.raises(ValueError):
        X.write_backup(B.export_rows(f, b), 3, str(tmp_path), "app", "bookmarks", 99)
    for body in ({"app": "app"}, {"app": "other", "format_version": 1}):
        (tmp_path / "x.json").write_text(json.dumps(body))
        with pytest.raises(ValueError):
            X.read_backup(spark, str(tmp_path / "x.json"), "app", "bookmarks")


def test_backup_in_parts(spark, tmp_path, monkeypatch):
    """no rows come to the driver, and the file is read in many tasks."""
    f = spark.createDataFrame([(1, None, None, 5), (2, "Sub", 3, 6), (3, 'A "\\ b', None, None)], "id bigint, name string, parent_id bigint, created_at bigint")
    odd = [(1, None, None, None, None), (2, 'a"\n\r\u2028\x01,', 2, "é,", 7), (3, "{}", 1, "]}", 8), (4, "", 3, "", -1), (5, None, 2, "n" * 50_000 + "\n" * 50_000, 2**60)]
    b = spark.createDataFrame(odd + [(i, f"T{i % 700}", i % 4, None, i) for i in range(6, 3000)], "id bigint, article_title string, folder_id bigint, note string, created_at bigint")
    names = {1: None, 2: "Sub", 3: 'A "\\ b'}
    want = sorted(((r[1], names.get(r[2]), r[3], r[4]) for r in map(tuple, b.collect())), key=str)
    where = f"file:{tmp_path}/x.json"
    with monkeypatch.context() as m:
        m.setattr(type(b), "collect", lambda *_: pytest.fail("rows come to the driver"))
        for path in (str(tmp_path), where, where):  # the last replaces what is there
            X.write_backup(B.export_rows(f, b), 2999, path, "app", "bookmarks", 99)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        for path in (str(tmp_path / "bookmarks-99.json"), where):
            folders, marks, _ = X.read_backup(spark, path, "app", "bookmarks")
            assert marks.rdd.getNumPartitions() > 3
            assert sorted(map(tuple, marks.collect()), key=str) == want
            assert sorted(map(tuple, folders.collect()), key=str) == sorted([(None, None, 5), ("Sub", 'A "\\ b', 6), ('A "\\ b', None, None)], key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with open(tmp_path / "x.json", encoding="utf-8", newline="") as text:
        doc = json.load(text)
    assert sorted(((r["title"], r.get("folder"), r.get("note"), r.get("created_at")) for r in doc["bookmarks"]), key=str) == want and len(doc["folders"]) == 3
    before = sorted(os.listdir(tmp_path))
    with pytest.raises(ValueError):
        X.write_backup(B.export_rows(f, b), 3000, where, "app", "bookmarks", 1)
    assert sorted(os.listdir(tmp_path)) == before and json.loads((tmp_path / "x.json").read_text(encoding="utf-8")) == doc


def test_backup_folders_in_parts(spark, tmp_path, monkeypatch):
    """folders neither, however many."""
    n = 3000
    f = spark.range(n).selectExpr("id", "concat('Folder ', id) AS name", "if(id = 0, null, (id - 1) div 2) AS parent_id", "id AS created_at")
    b = f.limit(0).selectExpr("id", "name AS article_title", "id AS folder_id", "name AS note", "created_at")
    with monkeypatch.context() as m:
        m.setattr(type(f), "collect", lambda *_: pytest.fail("rows come to the driver"))
        path = X.write_backup(B.export_rows(f, b), 0, str(tmp_path), "app", "bookmarks", 99)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        folders, marks, _ = X.read_backup(spark, path, "app", "bookmarks")
        assert folders.rdd.getNumPartitions() > 3 and marks.isEmpty()
        assert {tuple(r) for r in folders.collect()} == {(f"Folder {i}", f"Folder {(i - 1) // 2}" if i else None, i) for i in range(n)}
        assert folders.count() == n
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_backup_of_long_records(spark, tmp_path):
    """nor the records that are sampled for their order, however long."""
    f = spark.createDataFrame([(1, "F" * 300, None, 5), (2, "F" * 300 + "2", 1, 6)], "id bigint, name string, parent_id bigint, created_at bigint")
    b = spark.range(0, 120, 1, 6).selectExpr("id", "concat(repeat('T', if(id % 2 = 0, 200, 5)), md5(string(id))) AS article_title", "id % 3 AS folder_id", "repeat(md5(string(id)), 3000) AS note", "id AS created_at")
    conf = spark.sparkContext._jsc.sc().conf()
    most = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", "1m")
    try:
        path = X.write_backup(B.export_rows(f, b), 120, str(tmp_path), "app", "bookmarks", 99)
    finally:
        conf.set("spark.driver.maxResultSize", most)
    with open(path, encoding="utf-8") as text:
        lines = [x.strip().lstrip(",") for x in text]
    assert lines[1:3] == sorted(lines[1:3]) and lines[4:-1] == sorted(lines[4:-1]) and len(lines) == 125
    names = {1: "F" * 300, 2: "F" * 300 + "2"}
    _, marks, _ = X.read_backup(spark, path, "app", "bookmarks")
    assert sorted(map(tuple, marks.collect())) == sorted((r.article_title, names.get(r.folder_id), r.note, r.created_at) for r in b.collect())


def test_backup_of_other_layout(spark, tmp_path):
    """Files that only look like ours are read as the JSON they are."""
    head, mid = '{"app":"app","kind":"bookmarks","format_version":1,"exported_at":9,"folders":[\n', '],"bookmarks":[\n'
    f, m, n = '{"name":"F","created_at":1}\n', '{"title":"A","created_at":2}\n', '{"title":"B"}\n'
    for text, folders, marks, ours in (
        (head + f + mid + m + "," + n + "]}\n", ["F"], ["A", "B"], True),
        (head + f + mid + m + "," + n.strip() + "," + n + "]}\n", ["F"], ["A", "B", "B"], False),  # two in a line
        (head + f + mid + m + "," + f + "]}\n", ["F"], ["A", None], False),  # a record in the other's place
        (head + f + mid + '{"title":"A","new":{"x":[1]}}\n' + "]}\n", ["F"], ["A"], False),
        (head + f + mid + '{"title": "A"}\n' + ", " + n + "]}\n", ["F"], ["A", "B"], False),
        (head + f + '],"more":[],"bookmarks":[\n' + m + "]}\n", ["F"], ["A"], False),
        (head + f + mid + m + "," + n, None, None, False),  # cut off
        (head + f + mid + m + n + "]}\n", None, None, False),  # no comma
        (head + f + mid + "," + m + "]}\n", None, None, False),
        (mid + m + "]}\n" + head + f, None, None, False),
        ("", None, None, False),
    ):
        p = tmp_path / "x.json"
        p.write_text(text)
        assert (X._by_lines(spark, str(p)) is not None) == ours, text
        if folders is None:
            with pytest.raises(ValueError):
                X.read_backup(spark, str(p), "app", "bookmarks")
        else:
            got = X.read_backup(spark, str(p), "app", "bookmarks")
            assert [r.name for r in got[0].collect()] == folders and [r.title for r in got[1].collect()] == marks, text


def test_revisions(spark):
    df = spark.createDataFrame([(1, json.dumps({"query": {"pages": [{"revisions": [{"revid": 5, "user": "u"}, {"revid": 4}]}]}})), (2, json.dumps({"query": {"pages": [{"missing": True}]}})), (3, "{"), (4, json.dumps({"query": {"pages": []}}))], "id int, body string")
    assert [(r.id, r.revid, r.user, r.size, r.minor) for r in X.parse_revisions(df, "body", ["id"]).collect()] == [(1, 5, "u", 0, False), (1, 4, "", 0, False)]


HTML = [
    ("plain & <x", "<p>plain &amp; &lt;x</p>"), ("'''b''' ''i''", "<p><strong>b</strong> <em>i</em></p>"), ("'''open", "<p><strong>open</strong></p>"), ("a\n\nb", "<p>a</p><p>b</p>"),
    ("== A b ==\n== A b ==", '<h2 id="s-a-b">A b</h2><h2 id="s-a-b-2">A b</h2>'), ("= T =", '<h2 id="s-t">T</h2>'), ("----", "<hr/>"), ("* a\n* b", "<ul><li>a</li><li>b</li></ul>"), ("# a", "<ol><li>a</li></ol>"), ("; t\n: d", "<dl><dt>t</dt><dd>d</dd></dl>"),
    ("[[A b|c]]", '<p><a href="#/article/A_b" class="wk-link">c</a></p>'), ("[http://x.org lab el]", '<p><a href="http://x.org" class="wk-web" target="_blank" rel="noopener noreferrer">lab el</a></p>'),
    ("<nowiki>'''x'''</nowiki>", "<p>&#39;&#39;&#39;x&#39;&#39;&#39;</p>"), ("a<!-- c -->b", "<p>ab</p>"), ("[[Category:X]]", ""), (" pre <b>", '<pre class="wk-typed">pre </pre>'),
    ("{{convert|5|km|mi}}", '<p><span class="wk-measure">5 km</span></p>'), ("{{lang|fr|Élysée}}", "<p>Élysée</p>"), ("{{IPA|/x/}}", "<p>/x/</p>"), ("{{Foo|1}}", '<p><span class="wk-template">{Foo}</span></p>'),
    ("{{cite web|title=T|last=L|first=F|date=1999|url=ftp://x}}", '<p><span class="wk-source">“T”. L, F. (1999). ftp://x</span></p>'),
    ("{{Infobox_x\n| a_b = [[L|l]]\n| c =\n}}", '<div class="wk-facts"><div class="wk-facts-name">Infobox x</div><table><tr><th>a b</th><td>l</td></tr></table></div>'),
    ("{|\n|+ cap\n! h\n|-\n| a || b\n|}", '<table class="wk-grid"><caption>cap</caption><tr><th>h</th></tr><tr><td>a</td><td>b</td></tr></table>'),
    ("x<ref>''n'' {{cite|title=T}}</ref>", '<p>x<sup class="wk-note"><a href="#ref-1">[1]</a></sup></p><section class="wk-notes"><h2 id="s-references">References</h2><ol><li id="ref-1"><em>n</em> <span class="wk-source">“T”</span></li></ol></section>'),
    ("[[File:a.jpg|thumb|x]]", '<p><span class="wk-picture">File:a.jpg</span></p>'), ("&eacute; {{open", "<p>é {{open</p>"), ("", ""),
]


def test_html(spark):
    for text, want in HTML:
        assert W.Renderer().document(text) == want, text
    assert 'class="wk-link wk-absent"' in W.Renderer({"B"}).document("[[A]]")
    for odd in ("{{" * 3000, "[[" * 3000, "'" * 5000, "<ref>" * 2000, "{{a|" * 500 + "}}" * 500, "[[a|" * 300 + "]]" * 300, "=" * 3000):
        W.Renderer().document(odd)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(HTML)] + [(99, None)], "k bigint, t string")
    assert {r.k: r.h for r in df.select("k", W.render("t").alias("h")).collect()} == {i: h for i, (_, h) in enumerate(HTML)} | {99: None}
    assert [tuple(x) for r in df.select(W.infoboxes("t").alias("x")).collect() for x in r.x] == [("Infobox_x", "a b", "l")]
    assert [x for r in df.select(W.references("t").alias("x")).collect() for x in r.x] == ["n {cite}"]
    assert df.where("k = 9").select(W.plain_text("t")).first()[0] == ""
    assert [tuple(r) for r in W.internal_links(df, "k", "t").collect()] == [(10, 0, "A b"), (21, 0, "L")]


def test_folds_equal_their_definition(spark):
    r = random.Random(6)
    events = [(k, t, i, r.random() < 0.6) for k in "ab" for i, t in enumerate(sorted(r.randrange(4000) for _ in range(400)))]
    df = spark.createDataFrame(events, "k string, t bigint, i bigint, e boolean").repartition(3)
    got = {(x.key, x.tie): x.is_open for x in G.fold_sorted(df, "k", "t", "i", "e", G.breaker_fold(), "is_open", "boolean").collect()}
    for k in "ab":
        errors, until = [], None
        for kk, t, i, e in events:
            if kk != k:
                continue
            if until is not None and t >= until:
                errors, until = [], None
            if until is None and e:
                errors.append(t)
                if sum(1 for x in errors if t - x <= 60) >= 10:
                    until = t + 300
            assert got[(k, i)] == (until is not None)
    wait = [x.w for x in G.fold_sorted(spark.createDataFrame([("a", 0, i, False) for i in range(100)], "k string, t bigint, i bigint, e boolean"), "k", "t", "i", "e", G.bucket_fold(10.0), "w", "double").orderBy("tie").collect()]
    assert wait[:10] == [0.0] * 10 and abs(max(wait) - 9.0) < 0.01  # a hundred at ten a second


def test_streams(spark, tmp_path):
    r = random.Random(8)
    events = [("ab"[i % 2], 10 * i, i, r.random() < 0.7) for i in range(200)]
    for n in range(2):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(dict(zip("ktie", x))) for x in events[n * 100 : n * 100 + 100]))
        os.utime(tmp_path / "in" / f"{n}.json", (1000 + n, 1000 + n))  # files are taken in order of their times
    stream = spark.readStream.schema("k string, t bigint, i bigint, e boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = G.fold_stream(stream, "k", "t", "i", "e", G.breaker_fold(3, 60, 100), "is_open", "boolean").writeStream.format("memory").queryName("open_now").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = G.fold_sorted(spark.createDataFrame(events, "k string, t bigint, i bigint, e boolean"), "k", "t", "i", "e", G.breaker_fold(3, 60, 100), "is_open", "boolean")
    assert sorted((x.key, x.tie, x.is_open) for x in spark.table("open_now").collect()) == sorted((x.key, x.tie, x.is_open) for x in batch.collect())
    lines = G.stream_lines(spark, str(tmp_path / "in")).select(F.col("value")).writeStream.format("memory").queryName("lines_now").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    lines.awaitTermination(60)
    assert spark.table("lines_now").count() == 200
    sink = G.keep_latest(str(tmp_path / "ring"), 5)
    for n in range(3):
        sink(spark.createDataFrame([(n * 10 + i, n * 10 + i) for i in range(4)], "event_id int, at int"), n)
    assert sorted(x.event_id for x in spark.read.parquet(str(tmp_path / "ring" / "v0")).collect()) == [13, 20, 21, 22, 23]


def test_outcomes(spark):
    ok, down, gone = [200], [503], [404]
    log = [("c", "u1", 0, 0, ok), ("c", "u1", 1, 1, ok), ("c", "u2", 2, 2, down), *[("c", f"e{i}", 3, 3 + i, down) for i in range(9)], ("c", "u3", 4, 50, ok), ("c", "u1", 5, 51, ok), ("c", "u4", 400, 60, ok), ("d", "u1", 0, 70, gone), ("d", "u1", 1, 71, ok)]
    schema = "client string, url string, at bigint, event_id bigint, statuses array<int>"
    df = spark.createDataFrame(log, schema)
    got = {r.event_id: r.outcome for r in G.request_outcomes(df, 100.0, attempts=1).collect()}
    assert (got[0], got[1], got[2], got[11], got[50], got[51], got[60]) == ("sent", "cached", "exhausted", "broken", "broken", "broken", "sent")
    assert got[70] == "failed" and got[71] == "sent"
    assert {r.outcome for r in G.request_outcomes(df, killed=True).collect()} == {"killed"}
    # Attempts: pauses of 1, 2, 4 ... seconds, the server's wish up to 300, and no more once the breaker opens.
    log = [("a", "x", 0, 0, [503, 0, 200], None), ("b", "x", 0, 1, [500], None), ("e", "x", 0, 2, [429, 200], [1000]), ("f", "x", 0, 3, [500, 404], None)]
    log += [("g", f"x{i}", 0, 10 + i, [503], None) for i in range(2)]
    rows = {r.event_id: (r.outcome, r.attempts, r.wait) for r in G.request_outcomes(spark.createDataFrame(log, schema + ", retry_after array<bigint>"), 100.0).collect()}
    assert rows[0] == ("sent", 3, 3.0) and rows[1] == ("exhausted", 7, 63.0) and rows[2] == ("sent", 2, 300.0) and rows[3] == ("failed", 2, 1.0)
    # Five errors of the client's first request lie within a minute of its last; the fifth of the second request makes ten.
    assert rows[10] == ("exhausted", 7, 63.0) and rows[11][:2] == ("broken", 5)


def test_progress(spark, tmp_path):
    df, seen = G.observed(spark.range(25), "ingest")
    df.write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == 25
    told = []
    log = G.ProgressLog(lambda run, rows: told.append(rows), every=10)
    spark.streams.addListener(log)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x\n" * 25)
    q = G.stream_lines(spark, str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    spark.streams.removeListener(log)
    assert 25 in told


def test_ring_in_any_file_system(spark, tmp_path):
    target = f"file://{tmp_path}/ring"
    sink = G.keep_latest(target, 5)
    for n in range(3):
        sink(spark.createDataFrame([(n * 10 + i, n * 10 + i) for i in range(4)], "event_id int, at int"), n)
    assert sorted(x.event_id for x in spark.read.parquet(f"{target}/v0").collect()) == [13, 20, 21, 22, 23]


@pytest.mark.parametrize("text", ["{{ " * 40_000, "[[" * 40_000, "{{a|" * 20_000 + "}}" * 20_000, "[[a|" * 15_000 + "]]" * 15_000, "<ref>" * 20_000, "<nowiki>" * 20_000, "[http://a " * 20_000, "{{infobox|a=" * 9_000 + "}}" * 9_000])
def test_time_is_linear(text):
    import time

    began = time.process_time()
    assert W.render_text(text)
    assert time.process_time() - began < 5


def test_a_text_that_cannot_be_parsed(monkeypatch):
    monkeypatch.setattr(W.Renderer, "document", lambda *_: 1 / 0)
    assert W.render_text("a <b> & c") == '<pre class="wk-unread">a &lt;b&gt; &amp; c</pre>'

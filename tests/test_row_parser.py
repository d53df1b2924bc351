"""The row parser's generated patterns against a reader that goes field by field by the grammar."""

import glob
import os
import random
import re

import pytest

from codexmill.functions.text import WHITE_SPACE
from codexmill.operators import row_parser as R
from codexmill.operators.row_parser import SCHEMAS

_WS = "[" + re.escape(WHITE_SPACE) + "]*+"
_BAD_TITLE = re.compile("[#<>\\[\\]{}|\ufffd]")
_DIGITS = re.compile(r"[0-9]+")
_DECIMAL = re.compile(r"[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_INTEGER = re.compile(r"[+-]?[0-9]+")

_OPEN = re.compile(rf"{_WS}(\()?")
_FIELD = re.compile(rf"{_WS}(?:'((?:[^'\\]|\\.|'')*+)'(?P<after>{_WS})|(?P<bare>[^,)]*+))", re.S)
_TAIL = re.compile(rf"{_WS}[,;]?{_WS}\Z")
_ESCAPE = re.compile(r"\\(.)|''", re.S)
_NEXT_TUPLE = re.compile(rf"{_WS}[,;]?{_WS}\(?")


def _unescape(x: str) -> str:
    return _ESCAPE.sub(lambda m: m[1] if m[1] is not None else "'", x)


def split_row(line: str) -> tuple[list[tuple[str, bool]], bool, int]:
    """(fields of the first tuple as (value, quoted), is it one whole tuple, first field with broken quoting or -1)."""
    m = _OPEN.match(line)
    opened, at, n = m[1] is not None, m.end(), len(line)
    fields: list[tuple[str, bool]] = []
    whole, first, k = False, True, 0
    while True:
        m = _FIELD.match(line, at)
        at = m.end()
        if m["bare"] is None:
            if at < n and line[at] not in ",)":
                return fields, False, k
            value = (_unescape(m[1]), True)
        else:
            if "'" in m["bare"]:
                return fields, False, k
            value = (m["bare"].strip(WHITE_SPACE), False)
        if first:
            fields.append(value)
        k += 1
        if at >= n:
            return fields, whole and opened, -1
        if line[at] == ",":
            at += 1
            continue
        if first:
            whole = _TAIL.match(line, at + 1) is not None
        if whole:
            return fields, opened, -1
        first = False
        at = _NEXT_TUPLE.match(line, at + 1).end()
        if at >= n:
            return fields, False, -1


def _valid(kind: str, value: str, quoted: bool) -> bool:
    if kind == "page":
        return _DIGITS.fullmatch(value) is not None and value.strip("0") != ""
    if kind in ("lat", "lon"):
        return _DECIMAL.fullmatch(value) is not None and abs(float(value)) <= (90 if kind == "lat" else 180)
    if kind == "type":
        return value in ("page", "subcat", "file")
    if kind == "integer":
        return _INTEGER.fullmatch(value) is not None
    name = value.replace("_", " ").strip(WHITE_SPACE)
    return not (name == "" or len(name.encode("utf-8", "surrogatepass")) > 255 or _BAD_TITLE.search(name) or (not quoted and value == "NULL"))


def diagnose(line: str | None, dump_table: str | None) -> tuple[str | None, int, list[str | None] | None]:
    """(reason or None, index of the first broken field or -1, fields of a valid row)."""
    if line is None:
        return "column_count", -1, None
    fields, whole, broken = split_row(line)
    if broken >= 0:
        return "quoting", broken, None
    s = SCHEMAS.get(dump_table)
    if s is None or not whole or len(fields) != s.width:
        return "column_count", min(len(fields), s.width) if s else -1, None
    for i, kind in s.checks.items():
        if not _valid(kind, *fields[i]):
            return "bad_value", i, None
    return None, -1, [None if (not q and v == "NULL") else v for v, q in fields]


GOOD = {"redirect": "(12,0,'Foo','','')", "categorylinks": "(12,'Foo','s','t','','','page')", "geo_tags": "(1,12,'earth',1,9.5,-10,10,'city','n','c','r')"}
PARTS = ["'", "\\", ",", "(", ")", " ", "12", "page", "subcat", "NULL", "a", "''", "-1.5", "9e1", "#", ";", "\n", "_", "0", "é", "\x1f", "x" * 300]


def lines(n, seed):
    r = random.Random(seed)
    for _ in range(n):
        table = r.choice([*GOOD, "unknown", None])
        if table in GOOD and r.random() < 0.6:
            x = list(GOOD[table])
            for _ in range(r.randrange(4)):
                k, what = r.randrange(len(x)), r.random()
                if what < 0.4:
                    x[k] = r.choice(PARTS)
                elif what < 0.7:
                    x.insert(k, r.choice(PARTS))
                else:
                    del x[k]
            yield "".join(x), table
        else:
            yield "".join(r.choices(PARTS, k=r.randrange(14))), table


def test_patterns_equal_the_reader():
    for line, table in lines(30_000, 5):
        assert R.diagnose(line, table) == diagnose(line, table), (line, table)
    assert R.diagnose(None, "redirect")[0] == "column_count"


def test_long_rows():
    long = "(1,0,'" + "\\'" * 500_000 + "','','')"
    assert R.diagnose(long, "redirect")[:2] == ("bad_value", 2)
    assert R.diagnose(long[:-8], "redirect")[0] == "quoting"
    assert R.diagnose("(" + "1," * 500_000 + "1)", "redirect")[:2] == ("column_count", 5)


def test_operator_reads_refused_rows_once(spark):
    rows = [(i, t, 0, x, "clash") for i, (x, t) in enumerate(lines(3000, 8))] + [(9000, "redirect", 0, None, "x")] + [(9001 + i, t, 0, x, "y") for i, (t, x) in enumerate(GOOD.items())]
    df = spark.createDataFrame(rows, "raw_id bigint, dump_table string, line_no bigint, line string, reason string")
    want = {i: diagnose(x, t) for i, t, _, x, _ in rows}
    failed, loaded = R.failed_rows(df), R.loaded_rows(df)
    assert {r.raw_id: (r.reason, r.broken_field) for r in failed.collect()} == {i: d[:2] for i, d in want.items() if d[0]}
    got = {r.raw_id: r for r in loaded.collect()}
    assert set(got) == {i for i, d in want.items() if not d[0]}
    for i, d in want.items():
        if not d[0]:
            at = SCHEMAS[next(t for j, t, *_ in rows if j == i)].outputs
            assert str(got[i].page_id) == str(int(d[2][at["page"]])) if int(d[2][at["page"]]) < 2**63 else got[i].page_id is None
            if "title" in at:
                assert got[i].title == d[2][at["title"]].replace("_", " ").strip(WHITE_SPACE)
            if "kind" in at:
                assert got[i].kind == (d[2][at["kind"]] or None) and got[i].is_primary == (None if d[2][at["primary"]] is None else d[2][at["primary"]] == "1")
    plan = failed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan and "Filter" in plan.split("MapInArrow")[1]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no data here")
def test_on_the_data(spark):
    import __spark_entry__ as entry

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob("/root/testdata/sf0.01/raw_rows.parquet"):
        con.execute(f"CREATE VIEW raw_rows AS SELECT * FROM read_parquet('{p}')")
    for name in ("p4_found", "p4_loaded"):
        df = entry.queries()[name](spark, "/root/testdata/sf0.01")
        cur = con.execute(entry.oracle_sql()[name])
        names = [x[0] for x in cur.description]
        assert sorted(str([r[c] for c in names]) for r in df.collect()) == sorted(map(lambda r: str(list(r)), cur.fetchall()))

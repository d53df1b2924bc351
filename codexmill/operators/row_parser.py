"""Rows that fail to parse (problem 4).

Every schema has one anchored regular expression for whole rows, evaluated in the JVM. It holds
only bounded or possessive loops, so it neither backtracks badly nor overflows the stack; it is
deliberately stricter than the grammar. Rows it accepts are valid and are typed from its groups, all
taken in one evaluation. All other rows (a few per cent) pass once through incremental field-prefix
patterns in Arrow batches: per schema two patterns of nested optional fields are generated, one of
well-quoted fields and one of fields of the right kind. The longest prefix of fields each matches
names the first broken field and the reason, or shows an odd row to be valid after all. What no
pattern can say - that a coordinate lies in range and a title in its length - is tested on the
fields that matched.

Reasons, the first that applies: ``quoting``, ``column_count``, ``bad_value``.
Defined cases: a null line or a null or unknown dump_table is ``column_count``, unless the quoting
of the line is broken; very long lines are read whole; repeated rows come out as often as they came
in; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITE_SPACE, norm_title

_WS = "[" + re.escape(WHITE_SPACE) + "]*+"
_BAD = "#<>\\[\\]{}|\ufffd"


class Schema(NamedTuple):
    """Field count, and for the checked positions the kind of value."""

    width: int
    checks: dict[int, str]
    outputs: dict[str, int]


#: Positions are those of the dump tables' columns.
SCHEMAS = {
    "geo_tags": Schema(11, {1: "page", 4: "lat", 5: "lon"}, {"page": 1, "primary": 3, "lat": 4, "lon": 5, "kind": 7}),
    "categorylinks": Schema(7, {0: "page", 1: "title", 6: "type"}, {"page": 0, "title": 1, "stamp": 3, "type": 6}),
    "redirect": Schema(5, {0: "page", 1: "integer", 2: "title"}, {"page": 0, "namespace": 1, "title": 2, "interwiki": 3}),
}

# ---- whole rows, in the JVM ---------------------------------------------------------------------

_MARK = "\x1f"  # joins the groups of an accepted row; rows that hold it go the other way
_QUOTED = r"'[^'\\\x1f]*+(?:(?:\\[^\x1f]|'')[^'\\\x1f]*+){0,32}+'"
_BARE = r"[^'(),\\\s\x1f][^'(),\\\x1f]*+"
_ANY = rf"(?:{_QUOTED}|{_BARE}|)"


def _either(x: str) -> str:
    return rf"(?:{x}|'{x}')"


_T = r"\\#<>\[\]{}|\x{FFFD}\x1f"
_VALUE = {
    "page": _either(r"[1-9][0-9]{0,17}+"),
    "lat": _either(r"-?(?:[0-8]?[0-9](?:\.[0-9]{1,20}+)?|90(?:\.0{1,20}+)?)"),
    "lon": _either(r"-?(?:(?:1[0-7][0-9]|[0-9]{1,2})(?:\.[0-9]{1,20}+)?|180(?:\.0{1,20}+)?)"),
    "title": rf"'[\p{{L}}\p{{N}}][^'{_T}]{{0,62}}+'",
    "type": _either("(?:page|subcat|file)"),
    "integer": _either("-?[0-9]{1,9}+"),
}


def whole_row_pattern(s: Schema) -> str:
    """The anchored pattern of a valid row; one group per output field, in order of position."""
    fields = []
    for i in range(s.width):
        x = _VALUE[s.checks[i]] if i in s.checks else _ANY
        fields.append(rf"\s*+({x})\s*+" if i in s.outputs.values() else rf"\s*+{x}\s*+")
    return r"(?s)^\s*+\(" + ",".join(fields) + r"\)\s*+[,;]?\s*+\z"


# ---- refused rows, by the longest prefix of fields -----------------------------------------------

_Q = r"'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'"
_B = r"[^,)']*+"
_END = r"(?=[,)]|\Z)"
_WELL = rf"{_WS}(?:{_Q}{_WS}|{_B}){_END}"
_SEP = rf"(?:,|\){_WS}[,;]?+{_WS}\(?+)"


def _kind(kind: str, b: str) -> str:
    """The pattern of a value; b is what may stand before each of its characters, a backslash within quotes."""
    d = f"(?:{b}[0-9])"
    if kind == "page":
        return rf"(?:{b}0)*+(?:{b}[1-9]){d}*+"
    if kind in ("lat", "lon"):
        return rf"(?:{b}[+-])?+{d}++(?:{b}\.{d}++)?+(?:{b}[eE](?:{b}[+-])?+{d}++)?+"
    if kind == "type":
        return "(?:" + "|".join("".join(b + c for c in w) for w in ("page", "subcat", "file")) + ")"
    if kind == "integer":
        return rf"(?:{b}[+-])?+{d}++"
    return rf"(?:[^'\\{_BAD}]|\\[^{_BAD}]|'')*+" if b else rf"(?!NULL{_WS}[,)])[^,)'{_BAD}]*+"


def _typed(kind: str) -> str:
    bare = _kind(kind, "")
    return rf"{_WS}(?:'{_kind(kind, chr(92) * 2 + '?+')}'{_WS}|{bare}{_WS}){_END}"


def _nested(fields: list[str]) -> str:
    """Fields between commas, each optional with all after it; as many groups match as fields do."""
    out = ""
    for i in range(len(fields) - 1, -1, -1):
        out = rf"(?:{',' if i else ''}({fields[i]}){out})?+"
    return out


class _Prefixes:
    """The incremental patterns of one schema (of none: quoting only)."""

    def __init__(self, s: Schema | None):
        width = s.width if s else 1
        self.width, self.checks = width, s.checks if s else {}
        self.well = re.compile(rf"{_WS}(?P<open>\()?+" + _nested([_WELL] * width), re.S)
        self.typed = re.compile(rf"{_WS}\(" + _nested([_typed(self.checks[i]) if i in self.checks else _WELL for i in range(width)]), re.S)


_PREFIXES: dict[str | None, _Prefixes] = {}
_ONE = re.compile(_SEP + _WELL, re.S)
_REST = re.compile(rf"(?:{_SEP}{_WELL})*+\Z", re.S)
_TAIL = re.compile(rf"\){_WS}[,;]?{_WS}\Z", re.S)
_ESCAPE = re.compile(r"\\(.)|''", re.S)


def _value(raw: str) -> tuple[str, bool]:
    """(value, was it quoted) of a field as it stands between commas."""
    x = raw.strip(WHITE_SPACE)
    return (_ESCAPE.sub(lambda m: m[1] if m[1] is not None else "'", x[1:-1]), True) if x[:1] == "'" else (x, False)


def _within(kind: str, value: str) -> bool:
    if kind in ("lat", "lon"):
        return abs(float(value)) <= (90 if kind == "lat" else 180)
    if kind == "title":
        name = value.replace("_", " ").strip(WHITE_SPACE)
        return 0 < len(name.encode("utf-8", "surrogatepass")) <= 255
    return True


def diagnose(line: str | None, dump_table: str | None) -> tuple[str | None, int, list[str | None] | None]:
    """(reason or None, index of the first broken field or -1, fields of a valid row)."""
    if line is None:
        return "column_count", -1, None
    s = SCHEMAS.get(dump_table)
    known = dump_table if s else None
    p = _PREFIXES.get(known) or _PREFIXES.setdefault(known, _Prefixes(s))
    m = p.well.match(line)
    groups = m.groups()[1:]
    k = sum(g is not None for g in groups)
    at = m.end()
    if k == 0 or _REST.match(line, at) is None:  # some field is not well quoted: count those before it
        while k and (one := _ONE.match(line, at)):
            k, at = k + 1, one.end()
        return "quoting", k, None
    if s is None or k < p.width or m["open"] is None or _TAIL.match(line, at) is None:
        many = k == p.width and line[at : at + 1] == ","
        return "column_count", (p.width if many else min(k, p.width)) if s else -1, None
    t = sum(g is not None for g in p.typed.match(line).groups())
    values = [_value(g) for g in groups]
    for i, kind in p.checks.items():
        if i >= t or not _within(kind, values[i][0]):
            return "bad_value", min(i, t), None
    return None, -1, [None if (not q and v == "NULL") else v for v, q in values]


def _dispatch(make) -> Column:
    c = F.lit(None)
    for name in SCHEMAS:
        c = F.when(F.col("dump_table") == name, make(name)).otherwise(c)
    return c


def _accepted() -> Column:
    return F.coalesce(_dispatch(lambda t: F.col("line").rlike(whole_row_pattern(SCHEMAS[t]))).cast("boolean"), F.lit(False))


def refused_rows(rows: DataFrame) -> DataFrame:
    """raw_id, dump_table, reason, broken_field, fields of the rows that the whole-row patterns refuse; each is read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [diagnose(x, t) for t, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            reason, field, fields = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(reason, pa.string()), pa.array(field, pa.int32()), pa.array(fields, pa.list_(pa.string()))],
                names=["raw_id", "dump_table", "reason", "broken_field", "fields"],
            )

    refused = rows.select("raw_id", "dump_table", "line").where(~_accepted())
    kinds = dict(refused.dtypes)
    return refused.mapInArrow(run, f"raw_id {kinds['raw_id']}, dump_table string, reason string, broken_field int, fields array<string>")


def failed_rows(rows: DataFrame) -> DataFrame:
    """raw_id, reason, broken_field (counted from 0; -1: none) of every line that fails."""
    return refused_rows(rows).where("reason is not null").select("raw_id", "reason", "broken_field")


def loaded_rows(rows: DataFrame) -> DataFrame:
    """The valid lines as typed rows: raw_id, dump_table, page_id, title, lat, lon, is_primary, kind, stamp, namespace, interwiki.

    Columns that a table lacks are null; page ids beyond BIGINT are null.
    """

    def groups(table: str) -> Column:
        s = SCHEMAS[table]
        marked = _MARK.join(f"${i + 1}" for i in range(len(s.outputs)))
        return F.split(F.regexp_replace("line", whole_row_pattern(s), marked), _MARK, -1)

    # One evaluation takes all groups of an accepted row.
    good = rows.select("raw_id", "dump_table", "line").where(_accepted()).select("raw_id", "dump_table", _dispatch(groups).alias("g"))

    def unquoted(x: Column) -> Column:
        bare = F.when(F.btrim(x) != "NULL", F.btrim(x))
        return F.when(x.startswith("'"), F.regexp_replace(x.substr(F.lit(2), F.length(x) - 2), r"(?s)\\(.)|'(')", "$1$2")).otherwise(bare)

    good = good.select("raw_id", "dump_table", F.transform("g", unquoted).alias("g"))
    odd = refused_rows(rows).where("reason is null")
    # The fields of odd rows in the same order as the groups of the others.
    odd = odd.select("raw_id", "dump_table", _dispatch(lambda t: F.array(*(F.get("fields", F.lit(i)) for i in sorted(SCHEMAS[t].outputs.values())))).alias("g"))
    p = good.unionByName(odd)

    def field(name: str) -> Column:
        def of(table: str) -> Column:
            at = SCHEMAS[table].outputs
            return F.get("g", F.lit(sorted(at.values()).index(at[name]))) if name in at else F.lit(None).cast("string")

        return _dispatch(of)

    return p.select(
        "raw_id",
        "dump_table",
        field("page").try_cast("bigint").alias("page_id"),
        norm_title(field("title")).alias("title"),
        field("lat").try_cast("double").alias("lat"),
        field("lon").try_cast("double").alias("lon"),
        (field("primary") == "1").alias("is_primary"),
        F.nullif(field("kind"), F.lit("")).alias("kind"),
        field("type").alias("cl_type"),
        field("stamp").alias("stamp"),
        field("namespace").try_cast("int").alias("namespace"),
        field("interwiki").alias("interwiki"),
    )

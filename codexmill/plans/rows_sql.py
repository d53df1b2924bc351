"""DuckDB SQL of the row parser: the grammar of a line spelt out in its linear-time expressions."""

from __future__ import annotations

from ..functions.text import WHITE_SPACE
from ..operators.row_parser import SCHEMAS, Schema

_W = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITE_SPACE) + "]*"
_QUOTED = r"'(?:[^'\\]|\\.|'')*'"
_FIELD = rf"{_W}(?:{_QUOTED}{_W}|[^,)']*)"
_NUMBER = "[+-]?[0-9]+(?:[.][0-9]+)?(?:[eE][+-]?[0-9]+)?"


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: Every field of the line, also of what follows a first tuple, is well quoted.
_WELL = f"regexp_full_match(line, {_lit(rf'(?s){_W}[(]?{_FIELD}(?:(?:,|[)]{_W}[,;]?{_W}[(]?){_FIELD})*')})"


def _row(s: Schema, group: int | None = None) -> str:
    fields = [f"({_FIELD})" if i == group else _FIELD for i in range(s.width)]
    return _lit(rf"(?s)\A{_W}[(]" + ",".join(fields) + rf"[)]{_W}[,;]?{_W}\z")


def _field(s: Schema, i: int) -> str:
    """struct(v, q): the value of a field and whether it was quoted."""
    raw = f"trim(regexp_extract(line, {_row(s, i)}, 1), '{WHITE_SPACE}')"
    escape = _lit(r"(?s)\\(.)|'(')")
    inner = rf"regexp_replace({raw}[2:-2], {escape}, '\1\2', 'g')"
    return f"CASE WHEN starts_with({raw}, '''') THEN {{'v': {inner}, 'q': true}} ELSE {{'v': {raw}, 'q': false}} END"


def _bad(kind: str, f: str) -> str:
    v = f"{f}.v"
    if kind == "page":
        return f"NOT regexp_full_match({v}, '0*[1-9][0-9]*')"
    if kind in ("lat", "lon"):
        return f"NOT (regexp_full_match({v}, {_lit(_NUMBER)}) AND coalesce(abs(try_cast({v} AS DOUBLE)) <= {90 if kind == 'lat' else 180}, false))"
    if kind == "type":
        return f"{v} NOT IN ('page', 'subcat', 'file')"
    if kind == "integer":
        return f"NOT regexp_full_match({v}, '[+-]?[0-9]+')"
    name = f"trim(replace({v}, '_', ' '), '{WHITE_SPACE}')"
    return rf"({name} = '' OR strlen({name}) > 255 OR regexp_matches({name}, '[#<>\[\]{{}}|\x{{FFFD}}]') OR (NOT {f}.q AND {v} = 'NULL'))"


_NAMES = ("page", "title", "lat", "lon", "primary", "kind", "type", "stamp", "namespace", "interwiki")


def _tables() -> str:
    """One part per schema: raw_id, bad and the values of the output fields (null for an unquoted NULL)."""
    parts = []
    for name, s in SCHEMAS.items():
        at = sorted({*s.checks, *s.outputs.values()})
        cut = ", ".join(f"{_field(s, i)} AS f{i}" for i in at)
        bad = " OR ".join(_bad(kind, f"f{i}") for i, kind in s.checks.items())
        shown = ", ".join((f"CASE WHEN f{s.outputs[n]}.q OR f{s.outputs[n]}.v <> 'NULL' THEN f{s.outputs[n]}.v END" if n in s.outputs else "CAST(NULL AS VARCHAR)") + f" AS {n}_" for n in _NAMES)
        parts.append(f"SELECT raw_id, dump_table, ({bad}) AS bad, {shown} FROM (SELECT raw_id, dump_table, {cut} FROM raw_rows WHERE dump_table = '{name}' AND {_WELL} AND regexp_matches(line, {_row(s)}))")
    return " UNION ALL ".join(parts)


_READ = f"parsed AS MATERIALIZED ({_tables()})"

ORACLES = {
    "p4_found": f"""
      WITH {_READ}
      SELECT r.raw_id, CASE WHEN NOT coalesce({_WELL}, true) THEN 'quoting' WHEN p.raw_id IS NULL THEN 'column_count' ELSE 'bad_value' END AS reason
      FROM raw_rows r LEFT JOIN parsed p ON p.raw_id = r.raw_id WHERE p.raw_id IS NULL OR p.bad""",
    "p4_loaded": f"""
      WITH {_READ}
      SELECT raw_id, dump_table, try_cast(page_ AS BIGINT) AS page_id, trim(replace(title_, '_', ' '), '{WHITE_SPACE}') AS title,
             try_cast(lat_ AS DOUBLE) AS lat, try_cast(lon_ AS DOUBLE) AS lon, primary_ = '1' AS is_primary, nullif(kind_, '') AS kind,
             type_ AS cl_type, stamp_ AS stamp, try_cast(namespace_ AS INTEGER) AS namespace, interwiki_ AS interwiki
      FROM parsed WHERE NOT bad""",
}

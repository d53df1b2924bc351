"""Scalar functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c

# Replacements of the five characters special in HTML, '&' first.
HTML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
# Reserved characters of a title in a URL, '%' first.
URL_RESERVED = '%#?&"<>\\|{}'
#: Seconds to wait before attempt 1, 2, ...; the last for all later ones.
BACKOFF = (1, 1, 2, 4, 8, 16, 32, 60)
RETRY_AFTER_MOST = 300


def _replace_all(c: Column, pairs) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def html_escape(c: Column | str) -> Column:
    return _replace_all(_c(c), HTML_ESCAPES)


def slugify(c: Column | str) -> Column:
    """runs of other than ASCII letters and digits become '-', ends trimmed, 'section' if nothing is left."""
    x = F.btrim(F.lower(F.regexp_replace(_c(c), "[^A-Za-z0-9]+", "-")), F.lit("-"))
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("section"))


def url_encode_title(c: Column | str) -> Column:
    """spaces become '_', reserved characters %XX; nothing else changes."""
    return _replace_all(F.translate(_c(c), " ", "_"), [(x, f"%{ord(x):02X}") for x in URL_RESERVED])


def prettify_template(c: Column | str) -> Column:
    """F8: '_' becomes a space and the first character upper case."""
    x = F.translate(_c(c), "_", " ")
    return F.concat(F.upper(x.substr(1, 1)), F.substring(x, 2, 2**31 - 1))


def rest_url(base: str, title: Column | str, revision: Column | None = None) -> Column:
    """base/title/html[/revision], the title as one percent-encoded path segment."""
    segment = F.replace(F.replace(F.url_encode(_c(title)), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
    url = F.concat(F.lit(base.rstrip("/") + "/"), segment, F.lit("/html"))
    return url if revision is None else F.concat(url, F.when(revision.isNotNull(), F.concat(F.lit("/"), revision)).otherwise(""))


def backoff_seconds(attempt: Column | str, retry_after: Column | None = None) -> Column:
    """the server's wish up to 300 s, else 1, 1, 2, 4, ... 60 s for attempt 0, 1, 2, ..."""
    waits = F.array(*map(F.lit, BACKOFF))
    own = F.element_at(waits, (F.least(F.greatest(_c(attempt), F.lit(0)), F.lit(len(BACKOFF) - 1)) + 1).cast("int"))
    return own if retry_after is None else F.when(retry_after.isNotNull(), F.least(retry_after, F.lit(RETRY_AFTER_MOST))).otherwise(own)  # least() skips nulls


def retry_after(c: Column | str) -> Column:
    """F16: seconds of the header if it is a plain number."""
    x = F.btrim(_c(c))
    return F.when(x.rlike("^[0-9]+$"), x.try_cast("bigint"))


def is_retryable(status: Column | str) -> Column:
    s = _c(status)
    return s.isin(408, 425, 429) | (s >= 500)


def disk_projection(free: Column, total: Column, needed: Column, least_percent: int = 15) -> Column:
    """struct(free_after_pct, warn) after a download of ``needed`` bytes."""
    left = F.greatest(F.lit(0), free - needed)
    pct = F.when(total > 0, left.cast("double") / total.cast("double") * F.lit(100.0)).otherwise(0.0)
    return F.struct(pct.alias("free_after_pct"), ((free < needed) | (F.floor(pct) < least_percent)).alias("warn"))


def is_internal_url(c: Column | str, schemes=("about", "data", "blob", "pmtiles"), hosts=("localhost", "127.0.0.1")) -> Column:
    """an allowed scheme, or http or ws to a local host."""
    u = _c(c)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z]+://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return scheme.isin(*schemes) | (scheme.isin("http", "ws") & host.isin(*hosts))


def title_from_href(c: Column | str) -> Column:
    """Q19: the article title of a link in one of five forms, percent-decoded, else null."""
    h = _c(c)
    bare = F.regexp_extract(h, r"^([^#?]*)", 1)
    own = F.regexp_extract(h, r"^#/article/([^?]+)$", 1)
    forms = [r"^\./(.+)$", r"(?i)^(?:https?:)?//[a-z-]+\.(?:m\.)?wikipedia\.org/wiki/(.+)$", r"^/wiki/(.+)$"]
    raw = F.coalesce(*(F.nullif(x, F.lit("")) for x in [own, *(F.regexp_extract(bare, p, 1) for p in forms)]))
    # url_decode would turn '+' into a space, which a path does not
    return F.translate(F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), "_", " ")


def coordinate_label(lat: Column | str, lon: Column | str) -> Column:
    """Q21: two decimals and the hemispheres."""
    a, o = _c(lat), _c(lon)
    return F.concat(F.format_string("%.2f", F.abs(a)), F.lit("° "), F.when(a >= 0, "N").otherwise("S"), F.lit(" · "), F.format_string("%.2f", F.abs(o)), F.lit("° "), F.when(o >= 0, "E").otherwise("W"))


def relative_time(at: Column | str, now: Column) -> Column:
    """Q22: how long ago, in the largest fitting unit; dates beyond a week; 0 and null are 'never'."""
    t = _c(at)
    d = now - t
    unit = lambda n, name: F.concat(F.floor(d / n).cast("string"), F.lit(name))
    return (
        F.when(t.isNull() | (t == 0), "never")
        .when(d < 60, "just now")
        .when(d < 3600, unit(60, " min ago"))
        .when(d < 86400, unit(3600, " hr ago"))
        .when(d < 604800, unit(86400, " days ago"))
        .otherwise(F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd"))
    )


def truncate_snippet(c: Column | str, most: int) -> Column:
    """the first ``most`` bytes at a character boundary, with an ellipsis if anything was cut."""
    x = _c(c)
    head = F.decode(F.substring(F.encode(x, "UTF-8"), 1, most + 4), "ISO-8859-1")
    cut = F.regexp_extract(head, rf"(?s)\A(.{{0,{most}}})(?![\x80-\xBF])", 1)
    return F.when(F.octet_length(x) <= most, x).otherwise(F.concat(F.decode(F.encode(cut, "ISO-8859-1"), "UTF-8"), F.lit("…")))


def table_of_contents(html: Column | str) -> Column:
    """Q20: ARRAY<STRUCT<level, id, text>> of the h2 and h3 elements that have an id and text, in order."""
    whole = F.regexp_extract_all(_c(html), F.lit(r"(?is)<h[23]\b[^>]*\bid=\"[^\"]+\"[^>]*>.*?</h[23]>"), F.lit(0))
    text = lambda x: F.btrim(F.regexp_replace(x, r"(?s)<[^>]*>", ""))
    found = F.transform(whole, lambda x: F.struct(F.when(F.lower(x.substr(1, 3)) == "<h3", 3).otherwise(2).alias("level"), F.regexp_extract(x, r"(?i)\bid=\"([^\"]+)\"", 1).alias("id"), text(x).alias("text")))
    return F.filter(found, lambda x: x["text"] != "")


def byte_range(header: Column | str, total: Column) -> Column:
    """SRC14: struct(first, last) of a single 'bytes=' range, null if it is malformed or out of bounds.

    A null header asks for everything.
    """
    h = _c(header)
    lo = F.regexp_extract(h, r"^bytes=([0-9]*)-([0-9]*)$", 1)
    hi = F.regexp_extract(h, r"^bytes=([0-9]*)-([0-9]*)$", 2)
    good = h.rlike(r"^bytes=(?:[0-9]+-[0-9]*|-[0-9]+)$")
    suffix = F.least(hi.try_cast("bigint"), total)
    first = F.when(h.isNull(), F.lit(0)).when(lo == "", F.when(suffix > 0, total - suffix)).otherwise(lo.try_cast("bigint"))
    last = F.when(h.isNull() | (lo == "") | (hi == ""), total - 1).otherwise(F.least(hi.try_cast("bigint"), total - 1))
    ok = (total > 0) & (h.isNull() | good) & (first <= last) & (first < total)
    return F.when(ok, F.struct(first.cast("bigint").alias("first"), last.cast("bigint").alias("last")))

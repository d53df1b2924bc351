"""Lookups over articles, content, history, redirects and settings.

Arguments that a caller gives are literals, so filters are pushed into the Parquet scan; batch forms
take a table of requests and join it. Every ordered result has a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITE_SPACE, ascii_fold, norm_title

#: Spreads seeds over the key range: any odd number.
SPREAD = 2_654_435_761
TIERS = ("hot", "warm", "cold", "evicted")


def clamp(n: int, low: int, high: int) -> int:
    return max(low, min(high, n))


def normalise(title: str) -> str:
    return title.replace("_", " ").strip(WHITE_SPACE)


def lookup(articles: DataFrame, title: str) -> DataFrame:
    """Q1: the article of a title, exact and case-sensitive after normalising."""
    return articles.where(F.col("title") == normalise(title))


def article_content(articles: DataFrame, hot: DataFrame, warm: DataFrame | None = None) -> DataFrame:
    """Q2: page_id, kind and content by tier; a cold article without offset is an error row.

    ``kind`` is hot, warm, cold, missing (content not stored), evicted or error.
    """
    a = articles.select("page_id", "tier", "stream_offset", "stream_length")
    a = a.join(hot.select("page_id", F.col("wikitext").alias("hot_text")), "page_id", "left")
    warm = hot.select("page_id", F.col("wikitext").alias("warm_text")) if warm is None else warm.select("page_id", F.col("wikitext").alias("warm_text"))
    a = a.join(warm, "page_id", "left")
    text = F.when(F.col("tier") == "hot", F.col("hot_text")).when(F.col("tier") == "warm", F.col("warm_text"))
    kind = (
        F.when(F.col("tier").isin("hot", "warm"), F.when(text.isNull(), "missing").otherwise(F.col("tier")))
        .when(F.col("tier") == "cold", F.when(F.col("stream_offset").isNull(), "error").otherwise("cold"))
        .otherwise("evicted")
    )
    cold = F.col("tier") == "cold"
    return a.select("page_id", kind.alias("kind"), text.alias("text"), F.when(cold, F.col("stream_offset")).alias("stream_offset"), F.when(cold, F.col("stream_length")).alias("stream_length"))


def resolve_redirects(articles: DataFrame, redirects: DataFrame) -> DataFrame:
    """Q4: title -> target_title over a single hop, for articles that redirect."""
    return articles.join(redirects, articles["page_id"] == redirects["from_page_id"]).select("title", "target_title")


def resolve_articles(requests: DataFrame, articles: DataFrame, redirects: DataFrame, hot: DataFrame) -> DataFrame:
    """Q17: requested titles -> resolved title, page, how it is served.

    A redirect is followed once, if the requested title is itself an article; then the tier tells
    where the text is. ``served`` is hot, warm, cold, missing, error, evicted or not_found.
    """
    asked = requests.select(F.btrim(F.translate("title", "_", " "), F.lit(WHITE_SPACE)).alias("asked")).where("asked <> ''").distinct()
    hop = resolve_redirects(articles, redirects).withColumnRenamed("title", "asked")
    to = asked.join(hop, "asked", "left").select("asked", F.coalesce("target_title", "asked").alias("title"))
    found = to.join(articles.select("title", "page_id"), "title", "left")
    served = article_content(articles, hot).select("page_id", "kind")
    return found.join(served, "page_id", "left").select("asked", "title", "page_id", F.coalesce("kind", F.lit("not_found")).alias("served"))


def titles_with_prefix(articles: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """Q7: titles that begin with the prefix as it is given (ASCII case folded), not evicted, shortest first.

    A blank prefix gives nothing. A column ``fold`` with the folded title, where there is one, is used.
    """
    if not prefix.strip(WHITE_SPACE):
        return articles.select("page_id", "title").limit(0)
    fold = prefix.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    folded = F.col("fold") if "fold" in articles.columns else ascii_fold("title")
    hit = articles.where((F.col("tier") != "evicted") & folded.startswith(fold))
    return hit.select("page_id", "title").orderBy(F.length("title"), "title", "page_id").limit(clamp(limit, 1, 50))


def without_embedding(articles: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Articles the model has not embedded yet, by page_id."""
    return articles.join(embeddings.where(F.col("model") == model), "page_id", "left_anti").select("page_id", "title").orderBy("page_id")


def recent_articles(articles: DataFrame, limit: int = 50) -> DataFrame:
    """Q13: read articles, last read first."""
    return articles.where("last_accessed > 0").select("page_id", "title", "last_accessed", "access_count").orderBy(F.desc("last_accessed"), "page_id").limit(clamp(limit, 1, 1000))


def tier_counts(articles: DataFrame) -> DataFrame:
    """A1: one row, a count per tier, absent tiers 0."""
    return articles.agg(*(F.count_if(F.col("tier") == t).alias(t) for t in TIERS))


def table_counts(**tables: DataFrame) -> DataFrame:
    """A2: table_name, n_rows."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out


def key_range(articles: DataFrame) -> DataFrame:
    """Least and greatest page id of all articles, evicted ones included."""
    return articles.agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi"))


def lru_candidates(articles: DataFrame, limit: int) -> DataFrame:
    """Hot or warm and unpinned, least recently and least often read first."""
    c = articles.where("tier in ('hot', 'warm') and not coalesce(pinned, false)").select("page_id", "title", "tier", "last_accessed", "access_count")
    return c.orderBy("last_accessed", "access_count", "page_id").limit(max(0, limit))


def random_article(articles: DataFrame, seed: int) -> DataFrame:
    """T4: the first article not evicted at or after a seeded probe in the range of all keys, else the first of all.

    Articles after wide gaps are drawn more often, as a probe in key space must. The probe is a
    literal of the second query, so it reaches the scan; both parts take one row each.
    """
    a = articles.where("tier <> 'evicted'").select("page_id", "title")
    r = key_range(articles).first()
    if r is None or r["lo"] is None:
        return a.limit(0)
    probe = r["lo"] + seed * SPREAD % (r["hi"] - r["lo"] + 1)
    after, first = (x.orderBy("page_id").limit(1) for x in (a.where(F.col("page_id") >= probe), a))
    both = after.withColumn("_o", F.lit(0)).unionByName(first.withColumn("_o", F.lit(1)))
    return both.orderBy("_o").limit(1).drop("_o")


def ring_buffer(log: DataFrame, at: str, tie: str, keep: int = 1000) -> DataFrame:
    """T7, ST5: the latest ``keep`` requests."""
    return log.orderBy(F.desc(at), F.desc(tie)).limit(keep)


def links_available(links: DataFrame, articles: DataFrame, target: str = "target") -> DataFrame:
    """Link targets with ``available``: whether an article, of whatever tier, has the normalised title."""
    there = articles.select(F.col("title").alias("_t"), F.lit(True).alias("_a"))
    return links.join(there, norm_title(links[target]) == there["_t"], "left").withColumn("available", F.coalesce("_a", F.lit(False))).drop("_t", "_a")


def page_of(df: DataFrame, order: list[Column | str], offset: int, limit: int) -> DataFrame:
    """One page of a stable order; limit is clamped to 1..100,000."""
    return df.orderBy(*order).offset(max(0, offset)).limit(clamp(limit, 1, 100_000))


def page_after(df: DataFrame, keys: list[str], last: tuple | None, limit: int) -> DataFrame:
    """T1 for deep pages: the rows after a key, without skipping over those before it."""
    if last is not None:
        after, same = F.lit(False), F.lit(True)
        for k, x in zip(keys, last):
            after, same = after | (same & (F.col(k) > F.lit(x))), same & (F.col(k) == F.lit(x))
        df = df.where((F.col(keys[0]) >= F.lit(last[0])) & after)  # the first comparison reaches the scan
    return df.orderBy(*keys).limit(clamp(limit, 1, 100_000))


def revision_timeline(revisions: DataFrame) -> DataFrame:
    """(key, revid, ts, size) -> x in 0..1000 and bar height of each revision of a key."""
    from pyspark.sql import Window

    w = Window.partitionBy("key")
    lo, hi, most = F.min("ts").over(w), F.max("ts").over(w), F.max("size").over(w)
    span = F.greatest(F.lit(1), (hi - lo) * 1000)
    return revisions.select(
        "key", "revid", "ts", ((F.col("ts") - lo) * F.lit(1000) / span * F.lit(1000.0)).alias("x"), (F.col("size") / F.greatest(F.lit(1), most) * F.lit(60.0) + F.lit(2.0)).alias("h")
    )

"""Full-text search (R1-R7, J7, J12, A8, T5, SNK21).

The index is a table of postings (term, field, page_id, positions, tf, len) and one row of corpus
statistics. It is built once and stored clustered by term, so a query reads only its terms; scoring
joins those few postings and keeps k rows. Corpus statistics are aggregations over all documents.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.porter import stem
from ..functions.text import ascii_fold
from ..session import cut
from .lookup import clamp

#: BM25 parameters, boost of the title, longest token in bytes.
K1, B, TITLE_BOOST, LONGEST = 1.2, 0.75, 3.0, 40


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits, without those of 40 bytes and more."""
    c = F.col(text) if isinstance(text, str) else text
    # Empty strings at the ends hold no place of their own in a text.
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.filter(words, lambda x: F.octet_length(x) < LONGEST)


def build_postings(corpus: DataFrame, fields: dict[str, str], stemmed: bool = False) -> DataFrame:
    """SNK21: term, field, page_id, positions, tf, len, from a corpus with page_id; fields: name -> column."""
    out = None
    for name, column in fields.items():
        t = corpus.select("page_id", tokens(column).alias("w")).withColumn("len", F.size("w"))
        t = t.select("page_id", "len", F.posexplode("w").alias("pos", "term"))
        t = t.withColumn("term", _stem("term")) if stemmed else t
        t = t.groupBy("page_id", "term").agg(F.sort_array(F.collect_list("pos")).alias("positions"), F.first("len").alias("len"))
        t = t.select("term", F.lit(name).alias("field"), "page_id", "positions", F.size("positions").alias("tf"), "len")
        out = t if out is None else out.unionByName(t)
    return out


@F.pandas_udf(T.StringType())
def _stem(words: pd.Series) -> pd.Series:
    known = {w: stem(w) for w in words.unique()}
    return words.map(known)


def corpus_stats(corpus: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Field, n_docs, avg_len."""
    lengths = corpus.select(*(F.size(tokens(c)).alias(n) for n, c in fields.items()))
    wide = lengths.agg(F.count("*").alias("_n"), *(F.avg(n).alias(n) for n in fields))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col("_n").alias("n_docs"), F.col(n).alias("avg_len")) for n in fields))).alias("s")).select("s.*")


class Clause(NamedTuple):
    occur: str  # 'should', 'must' or 'not'
    field: str | None
    terms: tuple[str, ...]  # several: a phrase


_TOKEN = re.compile(r'\s*(?:(?P<op>AND|OR|NOT)(?=\s|$)|(?P<sign>[+-])?(?:(?P<field>\w+):)?(?:"(?P<phrase>[^"]*)"|(?P<word>[^\s"]+)))')


def parse_query(text: str, fields=("title", "body")) -> list[Clause] | None:
    """Words, "phrases", + and -, AND, OR, NOT and field: ; None if it is malformed."""
    out: list[Clause] = []
    at, joined, negate = 0, False, False
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            return None
        at = m.end()
        if m["op"]:
            if m["op"] == "NOT":
                negate = True
                continue
            if not out or joined:
                return None
            if m["op"] == "AND":
                joined = True
                if out[-1].occur == "should":
                    out[-1] = out[-1]._replace(occur="must")
            continue
        if m["field"] and m["field"] not in fields:
            return None
        raw = m["phrase"] if m["phrase"] is not None else m["word"]
        if m["phrase"] is None and re.search(r"[()\[\]{}^~]", raw):
            return None
        terms = tuple(w for w in re.split(r"[\W_]+", raw.lower()) if w and len(w.encode()) < LONGEST)
        occur = "not" if m["sign"] == "-" or negate else "must" if m["sign"] == "+" or joined else "should"
        joined = negate = False
        if terms:
            out.append(Clause(occur, m["field"], terms))
    return None if joined or negate else out


def guard(text: str, most: int = 4096) -> str:
    """Stripped, and cut to ``most`` bytes at a character boundary."""
    return text.strip().encode()[:most].decode("utf-8", "ignore")


def _shifted(positions: str, by: int) -> Column:
    return F.transform(positions, lambda x: x - by)


def _clause_scores(postings: DataFrame, stats: DataFrame, clause: Clause, number: int) -> DataFrame:
    p = postings.where(F.col("term").isin(list(set(clause.terms))))
    if clause.field:
        p = p.where(F.col("field") == clause.field)
    if len(clause.terms) > 1:
        parts = None
        for i, t in enumerate(clause.terms):
            one = p.where(F.col("term") == t).select("field", "page_id", "len", _shifted("positions", i).alias(f"_p{i}"))
            parts = one if parts is None else parts.join(one.drop("len"), ["field", "page_id"])
        starts = F.col("_p0")
        for i in range(1, len(clause.terms)):
            starts = F.array_intersect(starts, F.col(f"_p{i}"))
        p = parts.select("field", "page_id", "len", F.size(starts).alias("tf")).where("tf > 0")
    df = p.groupBy("field").agg(F.count("*").alias("df")).join(stats, "field")
    s = p.join(F.broadcast(df), "field")  # a row per field
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    boost = F.when(F.col("field") == "title", TITLE_BOOST).otherwise(1.0)
    return s.groupBy("page_id").agg(F.sum(boost * idf * tf).alias("score")).withColumn("clause", F.lit(number))


def bm25(postings: DataFrame, stats: DataFrame, clauses: list[Clause]) -> DataFrame:
    """R2: page_id, score; any clause matches unless some are required or excluded."""
    spark = postings.sparkSession
    # The query's own postings, read once; scores and document frequencies both come from them.
    postings = cut(postings.where(F.col("term").isin(sorted({t for c in clauses for t in c.terms}))))
    scored = [(_clause_scores(postings, stats, c, i), c) for i, c in enumerate(clauses)]
    if not any(c.occur != "not" for c in clauses):
        return spark.createDataFrame([], "page_id bigint, score double")
    hits = None
    for s, c in scored:
        if c.occur != "not":
            hits = s if hits is None else hits.unionByName(s)
    must = [i for i, c in enumerate(clauses) if c.occur == "must"]
    total = hits.groupBy("page_id").agg(F.sum("score").alias("score"), F.count_if(F.col("clause").isin(must)).alias("_m"))
    total = total.where(F.col("_m") == len(must)).drop("_m")
    for s, c in scored:
        if c.occur == "not":
            total = total.join(s.select("page_id"), "page_id", "left_anti")
    return total


def within_one_edit(a: Column, word: str) -> Column:
    """Equal, or one insertion, deletion, substitution or swap of neighbours away."""
    swapped = [word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)]
    return (F.levenshtein(a, F.lit(word), 1) >= 0) | a.isin(swapped)


def search(postings: DataFrame, stats: DataFrame, articles: DataFrame, query: str, limit: int = 20, tiers: list[str] | None = None) -> DataFrame:
    """page_id, title, score, fuzzy, best first.

    If exact hits are fewer than the limit and the query is one word of four characters or more,
    articles with a title term one edit away follow, without those already found.
    """
    none = postings.sparkSession.createDataFrame([], "page_id bigint, title string, tier string, score double, fuzzy boolean")
    text = guard(query)
    clauses = parse_query(text) if text else None
    if not clauses or limit <= 0:
        return none
    limit = clamp(limit, 1, 500)
    shown = articles.select("page_id", "title", "tier")
    if tiers:
        shown = shown.where(F.col("tier").isin(tiers))
    exact = bm25(postings, stats, clauses).join(shown, "page_id").select("page_id", "title", "tier", "score", F.lit(False).alias("fuzzy"))
    if not re.fullmatch(r"[^\W_]{4,}", text):
        return exact.orderBy(F.desc("score"), "page_id").limit(limit)
    word = text.lower()
    title_words = postings.where(F.col("field") == "title")
    alike = title_words.select("term").distinct().where(within_one_edit(F.col("term"), word))  # each word is compared once
    near = title_words.join(alike, "term", "left_semi").groupBy("page_id").agg(F.max((F.col("term") == word).cast("double")).alias("score"))
    near = near.join(shown, "page_id").join(exact.select("page_id"), "page_id", "left_anti").select("page_id", "title", "tier", "score", F.lit(True).alias("fuzzy"))
    top = exact.orderBy(F.desc("score"), "page_id").limit(limit)
    return top.unionByName(near.orderBy(F.desc("score"), "page_id").limit(limit)).orderBy("fuzzy", F.desc("score"), "page_id").limit(limit)


def search_archive(postings: DataFrame, corpus: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Rows holding all stemmed words anywhere, ranked by BM25 over the whole row.

    ``postings`` come from build_postings(stemmed=True); ``corpus`` has page_id and the row's length
    ``len``. A query without a word or with an open quote is an error.
    """
    if query.count('"') % 2 or not re.search(r"\w", query):
        raise ValueError(f"malformed query {query!r}")
    words = sorted({stem(w) for w in re.split(r"[\W_]+", query.lower()) if w})
    per = postings.where(F.col("term").isin(words)).groupBy("term", "page_id").agg(F.sum("tf").alias("tf"))
    per = cut(per)
    df = per.groupBy("term").agg(F.count("*").alias("df"))
    n = corpus.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    s = per.join(F.broadcast(df), "term").join(corpus.select("page_id", "len"), "page_id").join(F.broadcast(n))
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    hits = s.groupBy("page_id").agg(F.sum(idf * tf).alias("score"), F.count("*").alias("_n")).where(F.col("_n") == len(words))
    return hits.select("page_id", "score").orderBy(F.desc("score"), "page_id").limit(clamp(limit, 1, 1000))


def merge_lists(*lists: DataFrame) -> DataFrame:
    """J12, U: lists of (page_id, title) in falling priority; a title shows in its first list only, ASCII case folded."""
    out = None
    for i, x in enumerate(lists):
        x = x.select("page_id", "title", F.lit(i).alias("source"))
        if out is not None:
            shown = out.select(ascii_fold("title").alias("_t")).distinct()
            x = x.join(shown, ascii_fold(x["title"]) == shown["_t"], "left_anti")
        out = x if out is None else out.unionByName(x)
    return out

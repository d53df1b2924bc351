"""Retrieval contexts, prompts and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import truncate_snippet

#: Hits of a context, bytes of a snippet.
HITS, SNIPPET_BYTES = 5, 600


def contexts(hits: DataFrame, articles: DataFrame, hot: DataFrame) -> DataFrame:
    """(question_id, page_id, rank) -> question_id, id, page_id, title, snippet, for the best five.

    The snippet is the beginning of a hot text; for other articles it says what there is.
    """
    w = Window.partitionBy("question_id").orderBy("rank", "page_id")
    best = hits.withColumn("id", F.row_number().over(w)).where(F.col("id") <= HITS)
    c = best.join(articles.select("page_id", "title", "tier"), "page_id").join(hot, "page_id", "left")
    quoted = F.concat(F.lit("'"), "title", F.lit("'"))
    snippet = (
        F.when((F.col("tier") == "hot") & F.col("wikitext").isNotNull(), truncate_snippet("wikitext", SNIPPET_BYTES))
        .when((F.col("tier") == "warm") & F.col("wikitext").isNotNull(), F.concat(F.lit("(article "), quoted, F.lit(" available in storage)")))
        .otherwise(F.concat(F.lit("(no local snippet for "), quoted, F.lit(")")))
    )
    return c.select("question_id", "id", "page_id", "title", snippet.alias("snippet"))


def semantic_else_lexical(semantic: DataFrame, lexical: DataFrame) -> DataFrame:
    """The semantic hits of a question if it has any, else the lexical ones."""
    return semantic.unionByName(lexical.join(semantic.select("question_id").distinct(), "question_id", "left_anti"))


def sources_block(context: DataFrame) -> DataFrame:
    """question_id, sources: a line '[A<id>] title: snippet' for each of the question's excerpts."""
    line = F.concat(F.lit("[A"), F.col("id"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit(": "), F.coalesce("snippet", F.lit("")))
    ordered = F.sort_array(F.collect_list(F.struct("id", line.alias("line"))))
    return context.groupBy("question_id").agg(F.concat_ws("\n", F.transform(ordered, lambda x: x["line"])).alias("sources"))


def citations(answer: Column | str, valid: Column) -> Column:
    """Ids cited as [A<digits>] that are among ``valid``, each once, as first seen."""
    a = F.col(answer) if isinstance(answer, str) else answer
    found = F.transform(F.regexp_extract_all(a, F.lit(r"\[A([0-9]{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.filter(F.array_distinct(found), lambda x: F.array_contains(valid, x))

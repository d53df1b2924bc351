"""Splitting oversized items at natural boundaries (problem 2).

A text longer than ``limit`` bytes is cut by one regular expression with bounded quantifiers. Its
alternatives are ordered by the strength of the boundary they end at: the end of the text, a
section heading, a paragraph, a sentence, a word, and last any character. Each consumes as much as
the limit allows, and from a quarter of the limit on, so a strong boundary right at the start of a
piece doesn't make slivers. The expression runs over a one-character-per-byte view of the text, so
its quantifiers count UTF-8 bytes; a lookahead keeps cuts out of characters. Every piece but the
first is preceded by the last ``overlap`` bytes of the piece before it, fewer by up to three bytes
where those would begin inside a character.

Everything is a chain of built-in array and string functions inside the JVM; rows need no shuffle.

Defined cases: null and empty texts give no piece; texts within the limit, blank ones included,
give one piece as they are; repeated rows are split each; extra columns are ignored. ``limit`` must
be at least four times ``overlap`` and at least 16.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Byte-view patterns: (?s) lets . match any byte; \s covers ASCII white space.
_SECTION = r"(?<=\n)(?===)"
_PARAGRAPH = r"(?<=\n\n|\n\r\n|\n[ \t]\n)"
_SENTENCE = r"(?<=[.!?]\s|[.!?][\"')\]}]\s|\xE2\x80\xA6\s|[.!?]\xC2\xBB\s|\xE3\x80\x82|\xEF\xBC\x81|\xEF\xBC\x9F)"
_WORD = r"(?<=\s|\xC2\xA0|\xE3\x80\x80)"
_CHARACTER = r"(?![\x80-\xBF])"


def piece_pattern(limit: int, overlap: int) -> str:
    """The first piece may take ``limit`` bytes, later ones leave room for their overlap."""

    def upto(most: int) -> str:
        least = max(overlap, limit // 4, 1)
        strong = [rf".{{{least},{most}}}{b}" for b in (_SECTION, _PARAGRAPH, _SENTENCE, _WORD)]
        return "|".join([rf".{{1,{most}}}+\z", *strong, rf".{{1,{most}}}{_CHARACTER}", rf".{{1,{most}}}"])

    return rf"(?s)\A(?:{upto(limit)})|(?:{upto(limit - overlap)})"


def split_pieces(text: Column, limit: int, overlap: int) -> Column:
    """ARRAY<STRUCT<start BIGINT, overlap INT, piece STRING>> of a text; start counts bytes."""
    view = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.regexp_extract_all(view, F.lit(piece_pattern(limit, overlap)), F.lit(0))


def split_texts(df: DataFrame, item_id: str, text: str, limit: int, overlap: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """item_id, the ``keep`` columns, piece_no, n_pieces, overlap_bytes, n_bytes and piece of every text; ``whole`` is the hash of the text."""
    if limit < 4 * overlap or limit < 16:
        raise ValueError("limit must be at least 16 and four times overlap")
    base = df.select(F.col(item_id).alias("item_id"), *keep, F.col(text).alias("_text")).where("_text <> ''")
    large = F.octet_length("_text") > limit
    base = base.withColumn("_cuts", F.when(large, split_pieces(F.col("_text"), limit, overlap)))

    def piece(fresh: Column, i: Column) -> Column:
        before = F.element_at("_cuts", i.cast("int"))  # one-based: the cut before number i
        tail = F.regexp_replace(F.substring(before, -overlap, overlap), r"\A[\x80-\xBF]+", "") if overlap else F.lit("")
        tail = F.when(i > 0, tail).otherwise("")
        return F.struct(F.length(tail).alias("overlap_bytes"), F.decode(F.encode(F.concat(tail, fresh), "ISO-8859-1"), "UTF-8").alias("piece"))

    whole = F.array(F.struct(F.lit(0).alias("overlap_bytes"), F.col("_text").alias("piece")))
    pieces = F.when(F.col("_cuts").isNotNull(), F.transform("_cuts", piece)).otherwise(whole)
    n = F.when(F.col("_cuts").isNotNull(), F.size("_cuts")).otherwise(F.lit(1))
    out = base.select("item_id", *keep, n.alias("n_pieces"), F.xxhash64("_text").alias("whole"), F.posexplode(pieces).alias("piece_no", "_p"))
    return out.select("item_id", *keep, "whole", "piece_no", "n_pieces", "_p.overlap_bytes", F.octet_length("_p.piece").alias("n_bytes"), "_p.piece")


def split_tables(hot_content: DataFrame, chat_context: DataFrame) -> DataFrame:
    """The pieces of both tables with their limits: 4,096 and 320 bytes, overlaps 256 and 40."""
    hot = split_texts(hot_content, "page_id", "wikitext", 4096, 256, ("revision_id",)).withColumn("table_name", F.lit("hot_content"))
    chat = split_texts(chat_context, "context_id", "snippet", 320, 40).withColumn("table_name", F.lit("chat_context"))
    return hot.unionByName(chat.withColumn("revision_id", F.lit(None).cast("bigint")))

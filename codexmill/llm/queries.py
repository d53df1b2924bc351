"""Queries pN_ of the operators on texts, with their DuckDB SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import cut
from ..tables import table
from .packing import pack_items
from .spans import SharedSpans
from .splitting import split_tables
from .tokenize import count_tokens, decode_ids, encode_texts


def _pieces(s, d):
    return split_tables(table(s, d, "hot_content"), table(s, d, "chat_context"))


def _round_trip(s, d):
    ids = encode_texts(table(s, d, "documents"), "text", ["doc_id", "text"])
    back = decode_ids(ids, "ids", ["doc_id", "text"])
    return back.select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def _rejoined(s, d):
    """Each item put together again from its pieces without their overlaps."""
    p = _pieces(s, d).withColumn("fresh", F.decode(F.encode("piece", "UTF-8"), "ISO-8859-1").substr(F.col("overlap_bytes") + 1, F.col("n_bytes")))
    # Repeated rows of an item give the same pieces; a piece counts once per row number and length of the whole.
    p = p.select("table_name", "item_id", "revision_id", "n_pieces", "whole", "piece_no", "fresh", "n_bytes").distinct()
    one = p.groupBy("table_name", "item_id", "revision_id", "whole").agg(F.array_sort(F.collect_list(F.struct("piece_no", "fresh"))).alias("x"), F.max("n_bytes").alias("most"), F.count("*").alias("n"), F.first("n_pieces").alias("n_pieces"))
    text = F.decode(F.encode(F.concat_ws("", F.transform("x", lambda v: v["fresh"])), "ISO-8859-1"), "UTF-8")
    limit = F.when(F.col("table_name") == "hot_content", 4096).otherwise(320)
    return one.select("table_name", "item_id", F.md5(text).alias("text_md5"), ((F.col("most") <= limit) & (F.col("n") == F.col("n_pieces"))).alias("within")).distinct()


def _packed(s, d):
    return pack_items(count_tokens(table(s, d, "documents"), "text", ["doc_id"]), "doc_id", "n_tokens", 1024)


def _packed_totals(s, d):
    """Per document: do its parts in containers have all its tokens, is it whole unless larger, does no container overflow."""
    sizes = count_tokens(table(s, d, "documents"), "text", ["doc_id"]).where("n_tokens > 0")
    p = cut(_packed(s, d))
    real = p.groupBy("container").agg(F.sum("n_tokens").alias("held"), F.min("fill").alias("lo"), F.max("fill").alias("hi"))
    p = p.join(real, "container").groupBy(F.col("item_id").alias("doc_id")).agg(F.sum("n_tokens").alias("packed"), F.count("*").alias("parts"), F.bool_and(F.expr("held <= 1024 and held = lo and held = hi")).alias("fits"))
    return sizes.join(p, "doc_id", "left").select("doc_id", (F.col("packed") == F.col("n_tokens")).alias("same"), (F.col("parts") == F.ceil(F.col("n_tokens") / 1024)).alias("whole"), "fits")


def _packed_summary(s, d):
    """Are the containers at most a hundredth (and two) more than the tokens need at least."""
    x = _packed(s, d).select("container", "fill").distinct().agg(F.count("*").alias("n"), F.sum("fill").alias("t"))
    return x.select((F.col("n") <= F.ceil(F.col("t") / 1024) * 1.01 + 2).alias("tight"))


QUERIES = {
    "p2_found": lambda s, d: _pieces(s, d).where("piece_no = 1").select("table_name", "item_id").distinct(),
    "p2_pieces": _pieces,
    "p2_rejoined": _rejoined,
    "p7_ids": lambda s, d: encode_texts(table(s, d, "documents"), "text", ["doc_id"]),
    "p7_round_trip": _round_trip,
    "p8_containers": _packed,
    "p8_totals": _packed_totals,
    "p8_tight": _packed_summary,
    "p9_found": lambda s, d: SharedSpans(table(s, d, "documents")).shared_pairs(),
    "p9_shared": lambda s, d: SharedSpans(table(s, d, "documents")).shared_lengths(),
}

#: Hashes of all runs of 160 code points, and those in several documents.
_RUNS = """
      WITH t AS (SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 160),
      g AS (SELECT doc_id, i, md5_number(text[i:i + 159]) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 158)) AS i FROM t)),
      m AS (SELECT h FROM g GROUP BY h HAVING min(doc_id) <> max(doc_id)),
      k AS (SELECT doc_id, i, h FROM g WHERE h IN (SELECT h FROM m))"""

ORACLES = {
    "p2_found": """
      SELECT DISTINCT 'hot_content' AS table_name, page_id AS item_id FROM hot_content WHERE strlen(wikitext) > 4096
      UNION SELECT DISTINCT 'chat_context', context_id FROM chat_context WHERE strlen(snippet) > 320""",
    "p2_rejoined": """
      SELECT DISTINCT 'hot_content' AS table_name, page_id AS item_id, md5(wikitext) AS text_md5, true AS within FROM hot_content WHERE wikitext <> ''
      UNION SELECT DISTINCT 'chat_context', context_id, md5(snippet), true FROM chat_context WHERE snippet <> ''""",
    "p8_totals": "SELECT doc_id, true AS same, true AS whole, true AS fits FROM documents WHERE text <> ''",
    "p8_tight": "SELECT true AS tight",
    "p9_found": f"""{_RUNS},
      d AS (SELECT DISTINCT doc_id, h FROM k)
      SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM d a JOIN d b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p9_shared": f"""{_RUNS},
      s AS (SELECT doc_id, least(160, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 160)) AS n FROM k),
      c AS (SELECT doc_id, cast(sum(n) AS BIGINT) AS n FROM s GROUP BY doc_id)
      SELECT t.doc_id, length(text) AS n_chars, coalesce(n, 0) AS shared_chars, coalesce(n, 0) / length(text) AS share FROM documents t LEFT JOIN c ON c.doc_id = t.doc_id WHERE t.doc_id IS NOT NULL AND text <> ''""",
    "p7_round_trip": "SELECT doc_id, true AS same FROM documents",
}

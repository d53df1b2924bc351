"""Geotags: one per page, the map's pages and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import page_of


def geotag_per_page(tags: DataFrame) -> DataFrame:
    """Q3: the primary tag of each page, else any; of equals the least (lat, lon)."""
    best = tags.groupBy("page_id").agg(F.min(F.struct((~F.col("primary_")).alias("second"), "lat", "lon", "kind")).alias("g"))
    return best.select("page_id", "g.lat", "g.lon", (~F.col("g.second")).alias("primary_"), "g.kind")


def primary_geotags(tags: DataFrame, articles: DataFrame) -> DataFrame:
    """Primary tags of the articles there are, with titles."""
    t = tags.where("primary_")
    return t.join(articles.select("page_id", "title"), "page_id").select("page_id", "title", "lat", "lon", "kind")


def primary_geotags_page(tags: DataFrame, articles: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of J1 in a total order."""
    return page_of(primary_geotags(tags, articles), ["page_id", "lat", "lon"], offset, limit)


def count_primary(tags: DataFrame, articles: DataFrame) -> DataFrame:
    """A3: as many as all pages of T1 hold."""
    return primary_geotags(tags, articles).agg(F.count("*").alias("n"))

"""Cosine search over embeddings (T2, F10, F11, R8, J6, J9, A9, SNK24)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lookup import clamp


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """null for zero vectors and for different lengths."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def top_k(embeddings: DataFrame, articles: DataFrame, model: str, query: list[float], k: int) -> DataFrame:
    """The k articles nearest to a query vector, best first.

    Rows of another length and zero rows are skipped; an empty or zero query and k = 0 give nothing.
    Only k rows per task leave the scan (TakeOrderedAndProject).
    """
    q = [float(x) for x in query]
    norm = sum(x * x for x in q) ** 0.5
    hits = embeddings.where(F.col("model") == model).join(articles.select("page_id", "title"), "page_id")
    if not q or norm == 0 or k <= 0:
        return hits.select("page_id", "title", F.lit(0.0).alias("score")).limit(0)
    unit = F.array(*(F.lit(x / norm) for x in q))
    own = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    hits = hits.where(F.size("embedding") == len(q)).withColumn("_n", own).where("_n > 0 and not isnan(_n)")
    return hits.select("page_id", "title", (dot(F.col("embedding"), unit) / F.col("_n")).alias("score")).orderBy(F.desc("score"), "page_id").limit(clamp(k, 1, 500))


def encode_blob(c: Column | str) -> Column:
    """32-bit floats in little-endian order."""
    return _encode_blob(c)


def decode_blob(c: Column | str) -> Column:
    """null if the length is no multiple of four."""
    return _decode_blob(c)


@F.pandas_udf(T.BinaryType())
def _encode_blob(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _decode_blob(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, "<f4"))


def hashing_embedder(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a model: signed counts of hashed lower-case words."""
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dims] += 1 if h & 0x10000 else -1
        return out

    return embed


def letter_embedder(texts: list[str]) -> np.ndarray:
    """The simplest stand-in: how often each of the letters a to z occurs, whatever its case."""
    out = np.zeros((len(texts), 26), np.float32)
    for i, t in enumerate(texts):
        b = np.frombuffer(t.encode("ascii", "ignore"), np.uint8) | 0x20
        out[i] = np.bincount(b[(b >= 97) & (b <= 122)] - 97, minlength=26)
    return out


def embed_titles(pending: DataFrame, model: str, embedder: Callable[[list[str]], np.ndarray], batch: int = 64) -> DataFrame:
    """SNK24: (page_id, embedding, model) of pending articles, in batches of titles; the model loads once a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for i in range(0, len(x), batch):
                part = x.iloc[i : i + batch]
                yield pd.DataFrame({"page_id": part["page_id"], "embedding": list(embedder(part["title"].tolist())), "model": model})

    return pending.select("page_id", "title").mapInPandas(run, "page_id bigint, embedding array<float>, model string")

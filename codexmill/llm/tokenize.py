"""Encoding of the whole corpus with a public tokenizer (problem 7), and back.

One narrow pass over Arrow batches; no shuffle. Each worker builds its transducer once and keeps
it, with memos of bounded size, for all its tasks. Only the text and the kept columns are read.

Defined cases: null and empty texts have an empty list of ids; blank texts are encoded as they are;
texts of any length are encoded whole; repeated rows are encoded each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import TOKENIZERS, Tokenizer, Utf8Machine

#: The vocabulary of the queries; its ranks are the ids.
VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(folder: str | None = None, name: str = VOCABULARY) -> str:
    return f"{folder or TOKENIZERS}/{name}"


def _ids_array(found: list[bytes]) -> pa.Array:
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) // 4
    if len(ends) and ends[-1] >= 2**31:
        raise ValueError("a batch holds too many tokens; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32())
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def encode_texts(df: DataFrame, text: str, keep: list[str], path: str | None = None) -> DataFrame:
    """The ``keep`` columns and ``ids ARRAY<INT>`` of each row."""
    path = path or vocabulary_path()
    source = df.select(*keep, df[text].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Tokenizer.load(path).encode_bytes
        for b in batches:
            ids = _ids_array([encode(x) for x in b.column("_text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), ids], names=[*keep, "ids"])

    schema = T.StructType([source.schema[c] for c in keep]).add("ids", T.ArrayType(T.IntegerType()))
    return source.mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str, keep: list[str], path: str | None = None) -> DataFrame:
    """The ``keep`` columns and ``n_tokens BIGINT`` of each row."""
    path = path or vocabulary_path()
    source = df.select(*keep, df[text].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Tokenizer.load(path).count
        for b in batches:
            n = pa.array([count(x) for x in b.column("_text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), n], names=[*keep, "n_tokens"])

    return source.mapInArrow(run, T.StructType([source.schema[c] for c in keep]).add("n_tokens", "long"))


def decode_ids(df: DataFrame, ids: str, keep: list[str], path: str | None = None) -> DataFrame:
    """The ``keep`` columns and the ``decoded`` text of each row; null ids are as an empty list."""
    path = path or vocabulary_path()
    source = df.select(*keep, df[ids].alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Utf8Machine(Tokenizer.load(path).transducer.bytes_of)
        for b in batches:
            texts = pa.array([machine.decode(x or ()) for x in b.column("_ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), texts], names=[*keep, "decoded"])

    return source.mapInArrow(run, T.StructType([source.schema[c] for c in keep]).add("decoded", "string"))

"""Long exact spans shared between records (problem 9): count-min prefilter, then exact grouping.

A span of at least 2k code points (k = 80) holds k + 1 windows of k, all the same in every record
that has it. Of every k + 1 windows in a row those of least hash are kept, so each such span keeps
the same window in all its records, while only about one window in forty is looked at further.

Pass one adds the kept windows of each partition to a count-min sketch. A cell only has to tell
none, one and more, so a row is two bit maps; partial sketches are compressed, merged cell by cell
in a distributed aggregation, and the merged "more than once" maps are broadcast. Their width
follows the corpus up to ``MAX_BITS`` a row (16 MB each), a proven bound. Pass two computes the
windows again and passes on only those that every row of the sketch estimates repeated, as narrow
rows of hash, record and place. These are grouped exactly by hash, and those that only one record
holds go. Only for the rest the texts are read once more, those of other records filtered out by a
bit map before they are shuffled, and k code points of context on either side taken. So a sketch that is too narrow for the corpus loses nothing and costs at most one narrow
row for every 40 code points; contexts are written for windows that are truly repeated, whatever
the sketch lets through.

Windows are then grouped by equal context into classes, so that the copies of a passage become one
row with many members, and the classes of a window are compared in pairs. Where a window has more
than ``MANY`` classes, no pairs are formed: every class gives its k + 1 spans of length 2k around
the window, and equal spans are grouped, which is linear and finds the same. Pairs of at most 64
classes are at most 32 comparisons a class, in place of 81 spans a class to be hashed and shuffled.

``shared_pairs`` lists pairs of records, as many as there are; ``shared_lengths`` never expands
pairs and gives each record's number of code points lying in shared spans.

Defined cases: null ids are no records; null, empty and short texts share nothing; texts compare as
stored, by code points; a span repeated within one record only is not shared; repeated rows with the
same id are one record; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

#: Half the least length of a span.
K = 80
#: Rows of the sketch, most bits in a row, bits in a chunk that is merged as one.
ROWS, MAX_BITS, CHUNK_BITS = 3, 1 << 27, 1 << 20
#: Classes of one window above which spans are grouped instead of compared in pairs.
MANY = 64
_SLICE = 1 << 20  # code points hashed at a time
_BASE = 0x9E3779B97F4A7C15  # any odd number: it has an inverse modulo 2**64
_powers: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power(name: str, base: int, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        x = np.full(max(n, _SLICE), base & (2**64 - 1), np.uint64)
        x[0] = 1
        _powers[name] = np.multiply.accumulate(x)
    return _powers[name][:n]


def _sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """Least (or most) of every ``width`` values in a row."""
    span = 1
    while 2 * span <= width:
        x = least(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return least(x[:-rest], x[rest:]) if rest else x


def kept_windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, position, hash) of the windows kept; texts of at least 2K code points."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(codes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mix(codes + np.uint64(1)) * _power("up", _BASE, n), out=sums[1:])
    h = _mix((sums[K:] - sums[:-K]) * _power("down", pow(_BASE, -1, 2**64), n)[: n - K + 1])
    ends = np.cumsum(lengths)
    most = np.uint64(2**64 - 1)
    h = np.minimum(h, most - np.uint64(1))
    for e in ends[:-1]:  # windows across two texts are none
        h[e - K + 1 : e] = most
    low = _sliding(h, K + 1, np.minimum)
    high = _sliding(np.concatenate([np.zeros(K, np.uint64), low, np.zeros(K, np.uint64)]), K + 1, np.maximum)
    at = np.flatnonzero((high == h) & (h != most))
    which = np.searchsorted(ends, at, side="right")
    return which, at - (ends - lengths)[which], h[at]


def _slices(ids: list, texts: list) -> Iterator[tuple[list, list[int], list[str]]]:
    """Groups of about _SLICE code points; longer texts in slices overlapping by 2K - 1."""
    i, o, t, size = [], [], [], 0
    for d, x in zip(ids, texts):
        if d is None or x is None or len(x) < 2 * K:
            continue
        for at in range(0, max(1, len(x) - 2 * K + 1), _SLICE):
            part = x[at : at + _SLICE + 2 * K - 1]
            i.append(d)
            o.append((at, x))
            t.append(part)
            size += len(part)
            if size >= _SLICE:
                yield i, o, t
                i, o, t, size = [], [], [], 0
    if t:
        yield i, o, t


def _cells(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each hash in each row of the sketch; ``bits`` is a power of two."""
    return [(_mix(h + np.uint64(r * 0x632BE59BD9B4E019 % 2**64)) & np.uint64(bits - 1)).astype(np.int64) for r in range(ROWS)]


def _as_bytes(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte numbers, bits of the cells in each, bits of those met more than once); the first bit of a byte is the highest."""
    cell, n = np.unique(cells, return_counts=True)
    byte, bit = cell >> 3, (128 >> (cell & 7)).astype(np.uint8)
    first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]])) if len(byte) else np.empty(0, np.int64)
    if not len(first):
        return byte, bit, bit
    return byte[first], np.bitwise_or.reduceat(bit, first), np.bitwise_or.reduceat(np.where(n > 1, bit, 0).astype(np.uint8), first)


def _sketch_bits(chars: int) -> int:
    want = max(CHUNK_BITS, 8 * chars // (K // 2))
    return min(MAX_BITS, 1 << (int(want) - 1).bit_length())


def sketch(docs: DataFrame, bits: int) -> list[np.ndarray]:
    """The merged sketch: for each row a bit map of the cells holding more than one kept window."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, more = (np.zeros((ROWS, bits // 8), np.uint8) for _ in range(2))
        for b in batches:
            for _, _, t in _slices(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for r, c in enumerate(_cells(kept_windows(t)[2], bits)):
                    at, new, again = _as_bytes(c)
                    more[r, at] |= again | (one[r, at] & new)
                    one[r, at] |= new
        step = CHUNK_BITS // 8
        for r in range(ROWS):
            for k in range(bits // CHUNK_BITS):
                if one[r, k * step : (k + 1) * step].any():
                    maps = [zlib.compress(m[r, k * step : (k + 1) * step].tobytes(), 1) for m in (one, more)]
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([k], pa.int32()), *(pa.array([m], pa.binary()) for m in maps)], names=["r", "k", "one", "more"])

    def merge(x: pd.DataFrame) -> pd.DataFrame:
        one = more = None
        for a, b in zip(x["one"], x["more"]):
            a, b = (np.frombuffer(zlib.decompress(m), np.uint8) for m in (a, b))
            one, more = (a, b) if one is None else (one | a, more | b | (one & a))
        return pd.DataFrame({"r": x["r"].iloc[:1], "k": x["k"].iloc[:1], "more": [zlib.compress(more.tobytes(), 1)]})

    parts = docs.mapInArrow(partial, "r int, k int, one binary, more binary")
    out = [np.zeros(bits // 8, np.uint8) for _ in range(ROWS)]
    step = CHUNK_BITS // 8
    for row in parts.groupBy("r", "k").applyInPandas(merge, "r int, k int, more binary").toLocalIterator():
        out[row["r"]][row["k"] * step : (row["k"] + 1) * step] = np.frombuffer(zlib.decompress(row["more"]), np.uint8)
    return out


def passed_windows(docs: DataFrame) -> DataFrame:
    """(h, doc, t, pos): windows that the sketch estimates repeated; t is the hash of their text."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = _sketch_bits(chars)
    maps = docs.sparkSession.sparkContext.broadcast(sketch(docs, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = maps.value
        for b in batches:
            hashes = b.column(2).to_pylist()
            for ids, origin, t in _slices(list(zip(b.column(0).to_pylist(), hashes)), b.column(1).to_pylist()):
                which, pos, h = kept_windows(t)
                keep = np.ones(len(h), bool)
                for m, c in zip(rows, _cells(h, bits)):
                    keep &= (m[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
                w = which[keep]
                doc, text, start = (np.fromiter(x, np.int64, len(ids)) for x in ((i for i, _ in ids), (j for _, j in ids), (o[0] for o in origin)))
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(doc[w]), pa.array(text[w]), pa.array(pos[keep] + start[w])], names=["h", "doc", "t", "pos"])

    return docs.withColumn("t", F.xxhash64("text")).mapInArrow(run, "h long, doc long, t long, pos long")


def _key_cells(b: pa.RecordBatch, bits: int) -> np.ndarray:
    doc, t = (b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("doc", "t"))
    return (_mix(doc ^ _mix(t)) & np.uint64(bits - 1)).astype(np.int64)


def likely(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs whose (doc, t) are among ``keys``, and few others, so that only they are shuffled to them.

    The keys are put into one bit map of at most ``MAX_BITS``, merged in a distributed aggregation and
    broadcast; the more keys there are beyond a sixteenth of that, the more other rows pass.
    """
    wanted = max(CHUNK_BITS, 16 * keys.count())
    bits = min(MAX_BITS, 1 << (wanted - 1).bit_length())
    step = CHUNK_BITS // 8

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 8, np.uint8)
        for b in batches:
            at, new, _ = _as_bytes(_key_cells(b, bits))
            held[at] |= new
        for k in range(bits // CHUNK_BITS):
            part = held[k * step : (k + 1) * step]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["k", "held"])

    def merge(x: pd.DataFrame) -> pd.DataFrame:
        held = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(m), np.uint8) for m in x["held"]])
        return pd.DataFrame({"k": x["k"].iloc[:1], "held": [zlib.compress(held.tobytes(), 1)]})

    whole = np.zeros(bits // 8, np.uint8)
    for r in keys.mapInArrow(partial, "k int, held binary").groupBy("k").applyInPandas(merge, "k int, held binary").toLocalIterator():
        whole[r["k"] * step : (r["k"] + 1) * step] = np.frombuffer(zlib.decompress(r["held"]), np.uint8)
    known = docs.sparkSession.sparkContext.broadcast(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = _key_cells(b, bits)
            keep = known.value[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1
            yield b.filter(pa.array(keep.astype(bool)))  # texts stay in Arrow

    return docs.mapInArrow(run, docs.schema)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(h, doc, pos, left, rest): windows that several records hold, with their context.

    ``left`` is up to K code points before the window, ``rest`` the window and up to K after it.
    """
    seen = cut(passed_windows(docs))
    several = seen.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("h")
    places = cut(seen.join(several, "h", "left_semi").groupBy("doc", "t").agg(F.collect_set(F.struct("pos", "h")).alias("w")))
    found = likely(docs.withColumn("t", F.xxhash64("text")), places.select("doc", "t")).join(places, ["doc", "t"]).select("doc", "text", "w")

    def contexts(rows: list[tuple]) -> pa.RecordBatch:
        h, doc, pos, text = zip(*rows)
        left, rest = ([x[max(0, j - K) : j] for j, x in zip(pos, text)], [x[j : j + 2 * K] for j, x in zip(pos, text)])
        columns = zip((h, doc, pos, left, rest), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns], names=["h", "doc", "pos", "left", "rest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for d, x, windows in zip(*(c.to_pylist() for c in b.columns)):
                for w in windows:
                    rows.append((w["h"], d, w["pos"], x))
                    if len(rows) == 10_000:
                        yield contexts(rows)
                        rows = []
            if rows:
                yield contexts(rows)

    return found.mapInArrow(run, "h long, doc long, pos long, left string, rest string")


_RUN = T.StructType().add("l", "integer").add("r", "integer")


def _same(a: str, b: str) -> int:
    """Length of the common beginning."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


@F.pandas_udf(_RUN)
def _common_run(left1: pd.Series, rest1: pd.Series, left2: pd.Series, rest2: pd.Series) -> pd.DataFrame:
    """Code points before and after the window that both share; -1 if even the windows differ."""
    out = []
    for a, b, c, d in zip(left1, rest1, left2, rest2):
        out.append((_same(a[::-1], c[::-1]), _same(b[K:], d[K:])) if b[:K] == d[:K] else (-1, -1))
    return pd.DataFrame(out, columns=["l", "r"])


class SharedSpans:
    """The classes of repeated windows and what they share; from these derive pairs and lengths."""

    def __init__(self, documents: DataFrame):
        self.docs = documents.select(F.col("doc_id").cast("bigint").alias("doc"), "text").where("doc is not null")
        key = F.unhex(F.md5(F.concat_ws("\0", F.length("left").cast("string"), "left", "rest")))
        seen = cut(repeated_windows(self.docs).withColumn("c", key))
        self.members = cut(seen.select("h", "c", "doc", "pos").distinct())
        docs_of = self.members.select("h", "c", "doc").distinct().groupBy("h", "c").agg(F.count("*").alias("n_docs"), F.min("doc").alias("min_doc"))
        text_of = seen.select("h", "c", "left", "rest").groupBy("h", "c").agg(F.first("left").alias("left"), F.first("rest").alias("rest"))
        per_window = docs_of.groupBy("h").agg(F.count("*").alias("n_classes"), F.min("min_doc").alias("lo"), F.max("min_doc").alias("hi"), F.max("n_docs").alias("most"))
        # Windows whose classes all belong to one record (their hashes alone met another's) go here.
        per_window = per_window.where("most > 1 or lo <> hi").select("h", "n_classes")
        self.classes = cut(text_of.join(docs_of, ["h", "c"]).join(per_window, "h"))
        self.pairs = cut(self._class_pairs())
        self.spans = cut(self._equal_spans())

    def _class_pairs(self) -> DataFrame:
        """(h, c, c2, l, r, n_docs2, min_doc2) both ways, of windows with few classes."""
        few = self.classes.where(F.col("n_classes").between(2, MANY)).drop("n_classes")
        other = few.select("h", *(F.col(x).alias(x + "2") for x in ("c", "left", "rest", "n_docs", "min_doc")))
        met = few.join(other, "h").where("c < c2 and not (n_docs = 1 and n_docs2 = 1 and min_doc = min_doc2)")
        met = met.withColumn("x", _common_run("left", "rest", "left2", "rest2")).where(f"x.l >= 0 and x.l + x.r >= {K}")
        one = met.select("h", "c", "c2", "x.l", "x.r", "n_docs2", "min_doc2")
        two = met.select("h", F.col("c2").alias("c"), F.col("c").alias("c2"), "x.l", "x.r", F.col("n_docs").alias("n_docs2"), F.col("min_doc").alias("min_doc2"))
        return one.unionByName(two)

    def _equal_spans(self) -> DataFrame:
        """(h, c, l, s) of windows with many classes: every span of 2K code points around the window, by its hash."""
        many = self.classes.where(F.col("n_classes") > MANY).select("h", "c", F.length("left").alias("n_left"), F.concat("left", "rest").alias("whole"))
        cuts = many.select("h", "c", "n_left", "whole", F.explode(F.sequence(F.lit(0), F.lit(K))).alias("l"))
        cuts = cuts.where(f"l <= n_left and n_left - l + {2 * K} <= length(whole)")
        return cuts.select("h", "c", "l", F.unhex(F.md5(F.substring("whole", F.col("n_left") - F.col("l") + 1, F.lit(2 * K)))).alias("s"))

    def shared_pairs(self) -> DataFrame:
        """Distinct (doc_a, doc_b), doc_a < doc_b: records with a common span of at least 2K code points."""
        member = self.members.select("h", "c", "doc").distinct()
        other = member.select("h", F.col("c").alias("c2"), F.col("doc").alias("doc2"))
        unequal = self.pairs.where("c < c2").select("h", "c", "c2").join(member, ["h", "c"]).join(other, ["h", "c2"]).select("doc", "doc2")
        long = self.classes.where(f"length(left) + length(rest) >= {2 * K} and n_docs > 1").select("h", "c")
        same = long.join(member, ["h", "c"])
        equal = same.join(same.withColumnRenamed("doc", "doc2"), ["h", "c"]).where("doc < doc2").select("doc", "doc2")
        holder = self.spans.join(member, ["h", "c"]).select("h", "l", "s", "doc").distinct()
        dense = holder.join(holder.withColumnRenamed("doc", "doc2"), ["h", "l", "s"]).where("doc < doc2").select("doc", "doc2")
        rows = unequal.unionByName(equal).unionByName(dense).where("doc <> doc2")
        return rows.select(F.least("doc", "doc2").alias("doc_a"), F.greatest("doc", "doc2").alias("doc_b")).distinct()

    def shared_lengths(self) -> DataFrame:
        """(doc_id, n_chars, shared_chars, share) of every record with a text."""
        at = F.col("pos") - F.col("l")
        by_pair = self.members.join(self.pairs, ["h", "c"]).where("n_docs2 > 1 or min_doc2 <> doc").select("doc", at.alias("a"), (F.col("pos") + K + F.col("r")).alias("b"))
        same = self.classes.where(f"length(left) + length(rest) >= {2 * K} and n_docs > 1").select("h", "c", F.length("left").alias("l"), (F.length("rest") - K).alias("r"))
        by_class = self.members.join(same, ["h", "c"]).select("doc", at.alias("a"), (F.col("pos") + K + F.col("r")).alias("b"))
        held = self.spans.join(self.members, ["h", "c"])
        several = held.groupBy("h", "l", "s").agg(F.min("doc").alias("d1"), F.max("doc").alias("d2")).where("d1 <> d2").select("h", "l", "s")
        by_span = held.join(several, ["h", "l", "s"]).select("doc", at.alias("a"), (at + 2 * K).alias("b"))
        spans = by_pair.unionByName(by_class).unionByName(by_span).distinct()
        before = Window.partitionBy("doc").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
        fresh = F.greatest(F.lit(0), F.col("b") - F.greatest("a", F.coalesce(F.max("b").over(before), F.lit(0))))
        covered = spans.select("doc", fresh.alias("n")).groupBy("doc").agg(F.sum("n").alias("shared_chars"))
        whole = self.docs.groupBy("doc").agg(F.max(F.length("text")).cast("bigint").alias("n_chars")).where("n_chars > 0")
        out = whole.join(covered, "doc", "left").select(F.col("doc").alias("doc_id"), "n_chars", F.coalesce("shared_chars", F.lit(0).cast("bigint")).alias("shared_chars"))
        return out.withColumn("share", F.col("shared_chars") / F.col("n_chars"))

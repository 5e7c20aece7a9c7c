"""Substring dedup with compressed FM-indexes.

A word is removed if a window of ``WINDOW`` consecutive words covers it whose word sequence also starts in a document of
smaller id. The steps:

1. Each window has an anchor: the smallest hash of its ``GRAM``-word grams, so equal windows have equal anchors. Runs of
   windows with one anchor are noted, without text. Anchors found in one document only are dropped.
2. The runs that are left are cut out of their documents as segments (the words of a run's windows). No run is longer
   than the windows that one gram can lie in; longer ones, as of a repeated word, are noted in parts.
3. Segments are dealt out by anchor. A shard indexes its different segments, streams segments through the index by
   backward search, and reports for each window the smallest document in the interval of its matches. An anchor with
   very many different segments is split into chunks: each chunk is indexed in a call of its own, through which all the
   anchor's segments are streamed, ``shard_words`` words at a time.
4. Windows whose owner is smaller than their document become intervals; a document's intervals mark its words.

Copies of a segment meet in a map task first, so what many documents share is moved once for each task.

Defined cases: null text has no words; documents of under ``WINDOW`` words lose none; a null id sorts last and owns
nothing that another document has; rows that repeat an id don't remove each other's words; a very long text is cut into
runs like any other, so no call holds it as a whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import few_files, kernel, materialise, slices, words
from voxelweave.llm.fmindex import FMIndex

WINDOW, GRAM = 50, 10
SHARD_WORDS, CHUNK = 150_000, 1500
LAST = (1 << 63) - 1
MULTIPLIER = 0x9E3779B97F4A7C15


def window_anchors(found: list[bytes], window: int, gram: int) -> np.ndarray:
    """The anchor of each window of the document."""
    n = len(found)
    code = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, n)
    total, size = code, 1
    factor, parts = np.uint64(MULTIPLIER), gram
    with np.errstate(over="ignore"):
        power = {1: factor}
        doubled = {1: code}
        while size * 2 <= gram:
            total = doubled[size]
            doubled[size * 2] = total[: len(total) - size] * power[size] + total[size:]
            power[size * 2] = power[size] * power[size]
            size *= 2
        grams, done = doubled[size], size
        for step in sorted(doubled, reverse=True):
            while gram - done >= step:
                grams = grams[: n - done - step + 1] * power[step] + doubled[step][done : n - step + 1]
                done += step
        grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        grams ^= grams >> np.uint64(32)
    span, size, least = window - gram + 1, 1, grams
    while size * 2 <= span:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    rest = span - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def anchor_runs(window: int, gram: int):
    longest = window - gram + 1

    def run(batches):
        for b in slices(batches, 64):
            cols = [[], [], [], [], []]
            for order, key, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                found = words(text)
                if len(found) < window:
                    continue
                anchor = window_anchors(found, window, gram).view(np.int64)
                start = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
                parts = -(-np.diff(np.append(start, len(anchor))) // longest)
                if parts.max() > 1:
                    start = np.repeat(start, parts) + longest * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
                last = np.append(start[1:], len(anchor)) - 1
                for c, x in zip(cols, (anchor[start], np.full(len(start), order), np.full(len(start), key), start, last)):
                    c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in cols], names=["anchor", "doc_order", "doc_key", "first", "last"])

    return run


def cut_segments(window: int):
    """Rows of documents with their shared runs, by rising doc_order; text stays with a segment's first row in the task."""

    def run(batches):
        seen: set[bytes] = set()
        for b in slices(batches, 64):
            out: list[tuple] = []
            for order, key, text, runs in zip(*(b.column(k).to_pylist() for k in range(4))):
                found = words(text)
                for r in runs:
                    content = b" ".join(found[r["first"] : r["last"] + window])
                    name = xxhash.xxh3_128_digest(content)
                    new = name not in seen
                    if new:
                        seen.add(name)
                    out.append((r["anchor"], name, order, key, r["first"], content if new else None))
            if len(seen) > 200_000:
                seen.clear()
            if out:
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["anchor", "segment", "doc_order", "doc_key", "first", "content"])

    return run


class Shard:
    """The segments of a call: index holds (owner, content) of different ones, asked (segment, content)."""

    def __init__(self, window: int):
        self.window = window
        self.clear()

    def clear(self) -> None:
        self.index: list[tuple[int, bytes]] = []
        self.asked: list[tuple[bytes, bytes]] = []
        self.codes: dict[bytes, int] = {}
        self.fm, self.words, self.asked_words = None, 0, 0

    def add(self, role: int, segment: bytes, owner: int, content: bytes) -> None:
        n = content.count(b" ") + 1
        if role != 1:
            self.index.append((owner, content))
            self.words += n
        if role != 0:
            self.asked.append((segment, content))
            self.asked_words += n

    def answers(self) -> Iterator[pa.RecordBatch]:
        """segment, offset, n_windows, owner of what was asked so far; the index stays."""
        if not self.index or not self.asked:
            return
        codes = self.codes
        if self.fm is None:
            texts = [np.array([codes.setdefault(w, len(codes) + 1) for w in c.split()], np.int32) for _, c in self.index]
            self.fm = FMIndex(texts, np.array([o for o, _ in self.index], np.int64), len(codes) + 1, self.window)
            self.index = self.index[:1]
        unknown = len(codes) + 1
        asked, self.asked, self.asked_words = self.asked, [], 0
        names, cols = [], [[], [], []]
        for (name, _), owner in zip(asked, self.fm.owners_of([np.array([codes.get(w, unknown) for w in c.split()], np.int32) for _, c in asked])):
            owner = owner[: len(owner) - self.window + 1]
            start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            size = np.diff(np.append(start, len(owner)))
            some = owner[start] != LAST
            names += [name] * int(some.sum())
            for c, x in zip(cols, (start, size, owner[start])):
                c.append(x[some])
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), *(pa.array(np.concatenate(c).astype(np.int64)) for c in cols)], names=["segment", "offset", "n_windows", "owner"])


def shards(window: int, shard_words: int):
    """Rows sorted by anchor, chunk, role, segment, doc_order. role: 0 index, 1 asked, 2 both. Small units share a call;
    of a large unit, whose indexed rows come first, the asked ones pass through its index in parts."""

    def run(batches):
        shard, unit, last = Shard(window), None, None
        for b in slices(batches, 512):
            for anchor, a, role, name, order, content in zip(*(b.column(k).to_pylist() for k in range(6))):
                if unit != (anchor, a):
                    if shard.words >= shard_words or unit and unit[1] != 0:
                        yield from shard.answers()
                        shard.clear()
                    unit, last = (anchor, a), None
                if (role, name) == last:
                    continue  # the same segment from another task; the first has the smallest document
                last = (role, name)
                if role == 1 and shard.asked_words >= shard_words:
                    yield from shard.answers()
                shard.add(role, name, order, content)
        yield from shard.answers()

    return run


def dealt(contents: DataFrame, chunk: int) -> DataFrame:
    """The calls: anchor, a (number of the indexed chunk, from 1; 0 for anchors that aren't split), role, segment,
    doc_order, content."""
    large = contents.groupBy("anchor").agg(F.count("*").alias("c")).where(F.col("c") > chunk).select("anchor", F.ceil(F.col("c") / F.lit(float(chunk))).alias("n"))
    rows = contents.join(large, "anchor", "left")
    call = lambda a, role: F.struct(a.cast("long").alias("a"), F.lit(role).alias("role"))
    own = F.pmod(F.xxhash64("segment"), F.col("n")) + 1
    calls = F.when(F.col("n").isNull(), F.array(call(F.lit(0), 2))).otherwise(F.concat(F.array(call(own, 0)), F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda x: call(x, 1))))
    return rows.withColumn("call", F.explode(calls)).select("anchor", "call.a", "call.role", "segment", "doc_order", "content")


def repeated_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS, chunk: int = CHUNK) -> DataFrame:
    """doc_order, doc_key, spans: word intervals [first, past) to remove, one row for each document that has any."""
    rows = keyed(df, id_col, text_col)
    runs = materialise(kernel(rows, anchor_runs(window, gram), "anchor long, doc_order long, doc_key long, first long, last long", df), "anchors", df)
    shared = runs.groupBy("anchor").agg(F.min("doc_order").alias("low"), F.max("doc_order").alias("high")).where("low < high").select("anchor")
    by_doc = runs.join(shared, "anchor").groupBy("doc_order", "doc_key").agg(F.collect_set(F.struct("anchor", "first", "last")).alias("runs"))
    # partitions are joined before the sort, or else a task's first row of a segment need not have its smallest document
    texts = few_files(rows.join(by_doc, ["doc_order", "doc_key"]).select("doc_order", "doc_key", "text", "runs"), df).sortWithinPartitions("doc_order")
    segments = materialise(kernel(texts, cut_segments(window), "anchor long, segment binary, doc_order long, doc_key long, first long, content binary"), "segments")
    contents = segments.where("content is not null").select("anchor", "segment", "doc_order", "content")
    calls = dealt(contents, chunk).repartition("anchor", "a").sortWithinPartitions("anchor", "a", "role", "segment", "doc_order")
    owners = kernel(calls, shards(window, shard_words), "segment binary, offset long, n_windows long, owner long")
    spans = segments.select("segment", "doc_order", "doc_key", "first").join(owners, "segment").where("owner < doc_order")
    first = F.col("first") + F.col("offset")
    span = F.struct(first.alias("first"), (first + F.col("n_windows") + (window - 1)).alias("past"))
    return spans.groupBy("doc_order", "doc_key").agg(F.collect_set(span).alias("spans"))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_order"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("doc_key"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"))


def remove(keep_text: bool):
    def run(batches):
        for b in slices(batches, 64):
            out = []
            for doc_id, text, spans in zip(*(b.column(k).to_pylist() for k in range(3))):
                found = words(text)
                gone = np.zeros(len(found) + 1, np.int64)
                for s in spans or ():
                    gone[s["first"]] += 1
                    gone[s["past"]] -= 1
                mark = np.cumsum(gone[:-1]) > 0
                kept = [found[k] for k in np.flatnonzero(~mark)] if spans else found
                joined = b" ".join(kept)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], mark, [False]]).astype(np.int8)))
                merged = [{"first": int(x), "past": int(y)} for x, y in zip(edge[::2], edge[1::2])]
                out.append((doc_id, len(found), len(found) - len(kept), hashlib.sha256(joined).hexdigest(), merged, *((joined.decode(),) if keep_text else ())))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())])), pa.string()]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"]
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names[: len(cols)])

    return run


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, **settings) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans, and with keep_text kept_text: one row for each input row."""
    spans = repeated_words(df, id_col, text_col, **settings)
    rows = keyed(df, id_col, text_col).join(spans, ["doc_order", "doc_key"], "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first: long, past: long>>" + ", kept_text string" * keep_text
    return kernel(rows, remove(keep_text), schema, df)

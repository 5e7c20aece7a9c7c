"""Exact dedup with Patricia-trie owners.

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``. Each map task has a compressed
radix trie for each of ``PARTS`` partitions by length and content hash, and inserts the full byte strings; terminals hold
the best row so far (most code points, then smallest id). The terminals are dealt out by (length, hash), sorted, and
merged by tries again, so a text copied a million times reaches a merging task once for each map task and no more. When a
task's tries outgrow their memory limit, the largest spills its largest subtrees: their terminals are emitted as partial
rows, which later tries merge.

Defined cases: null text counts as empty; null ids sort last and can own a group only if all its ids are null; of
repeated rows (same id, same text) one is kept; a very long text is one label of a trie and counts towards its limit; an
empty table gives no rows; other columns are left alone, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import FEW_IDS, WS, WS_BYTES, fresh, kernel, materialise, slices

LARGEST = (1 << 63) - 1
PARTS = 16


class Node:
    __slots__ = ("kids", "label", "owner", "size")

    def __init__(self, label: bytes):
        self.label, self.kids, self.owner, self.size = label, {}, None, 0


class PatriciaTrie:
    """A compressed radix trie over byte strings. Terminals hold [rows, -code points, id or LARGEST, id is null]."""

    def __init__(self):
        self.root, self.bytes, self.terminals = Node(b""), 0, 0

    def insert(self, key: bytes, rows: int, chars: int, doc_id: int | None) -> None:
        rank = [-chars, doc_id is None, LARGEST if doc_id is None else doc_id]
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = Node(key[at:])
                self.bytes += len(kid.label) + 200
                node, at = kid, len(key)
                break
            label = kid.label
            if key.startswith(label, at):
                node, at = kid, at + len(label)
                continue
            low, high = 1, min(len(label), len(key) - at)  # the shared prefix ends in here: halve
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if key.startswith(label[:mid], at) else (low, mid - 1)
            fork = Node(label[:low])
            kid.label = label[low:]
            fork.kids[kid.label[0]] = kid
            node.kids[key[at]] = fork
            self.bytes += 200
            node, at = fork, at + low
        if node.owner is None:
            node.owner = [rows, rank]
            self.terminals += 1
        else:
            node.owner[0] += rows
            node.owner[1] = min(node.owner[1], rank)

    def items(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, list]]:
        stack = [(node or self.root, prefix)]
        while stack:
            node, prefix = stack.pop()
            whole = prefix + node.label
            if node.owner is not None:
                yield whole, node.owner
            stack += [(kid, whole) for kid in node.kids.values()]

    def spill(self) -> Iterator[tuple[bytes, list]]:
        """Takes out the largest subtrees under the first fork, half of the trie's weight at least, and yields their
        terminals; so each node is weighed a few times in all."""
        node, prefix = self.root, b""
        while len(node.kids) == 1 and node.owner is None:
            prefix, node = prefix + node.label, next(iter(node.kids.values()))
        if not node.kids:  # a single terminal is left
            yield from list(self.items())
            self.__init__()
            return

        def weight(top: Node) -> int:
            total, stack = 0, [top]
            while stack:
                x = stack.pop()
                total += len(x.label) + 200
                stack += x.kids.values()
            return total

        sizes = {k: weight(kid) for k, kid in node.kids.items()}
        goal, gone = sum(sizes.values()) / 2, 0
        for first in sorted(sizes, key=sizes.get, reverse=True):
            if gone >= goal:
                break
            gone += sizes[first]
            kid = node.kids.pop(first)
            self.bytes -= sizes[first]
            for item in self.items(kid, prefix + node.label):
                self.terminals -= 1
                yield item


def normalise(text: str | None) -> bytes:
    return text.encode("utf-8", "replace").translate(None, WS_BYTES) if text else b""


def content_hash(norm: bytes) -> int:
    return int.from_bytes(xxhash.xxh64_digest(norm), "big", signed=True)


PARTIAL = "n_bytes long, content_hash long, norm binary, n_rows long, best_chars long, best_id long"


def emit(items, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0

    def batch():
        cols = list(zip(*rows))
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["n_bytes", "content_hash", "norm", "n_rows", "best_chars", "best_id"])

    for key, (count, rank) in items:
        rows.append((len(key), content_hash(key), key, count, -rank[0], None if rank[1] else rank[2]))
        held += len(key)
        if held > size:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


def partial_tries(limit: int):
    def run(batches):
        tries, held = [PatriciaTrie() for _ in range(PARTS)], 0
        for b in slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                norm = normalise(text)
                trie = tries[(len(norm) + content_hash(norm)) % PARTS]
                held -= trie.bytes
                trie.insert(norm, 1, len(text or ""), doc_id)
                held += trie.bytes
                while held > limit:
                    trie = max(tries, key=lambda t: t.bytes)
                    held -= trie.bytes
                    yield from emit(trie.spill())
                    held += trie.bytes
        for trie in tries:
            yield from emit(trie.items())

    return run


def merge_tries(batches):
    """Rows arrive sorted by length and hash: the subtree of one (length, hash) is complete when another begins."""
    trie, last = PatriciaTrie(), None

    def groups():
        nonlocal trie, last
        for b in slices(batches):
            cols = [b.column(k).to_pylist() for k in range(6)]
            for n_bytes, code, norm, count, chars, doc_id in zip(*cols):
                if last not in (None, (n_bytes, code)):
                    yield from trie.items()
                    trie = PatriciaTrie()
                last = (n_bytes, code)
                trie.insert(norm, count, chars, doc_id)
        yield from trie.items()

    rows = []
    names = ["text_sha256", "keep_id", "keep_chars", "group_size"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
    for key, (count, rank) in groups():
        rows.append((hashlib.sha256(key).hexdigest(), None if rank[1] else rank[2], -rank[0], count))
        if len(rows) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def members(batches):
    for b in slices(batches):
        texts = b.column(1).to_pylist()
        sha = [hashlib.sha256(normalise(t)).hexdigest() for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_chars_text", "text_sha256"])


def groups_of_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_mb: int = 48) -> DataFrame:
    """text_sha256, keep_id, keep_chars, group_size: one row for each different normalised text."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    partial = kernel(rows, partial_tries(trie_mb << 20), PARTIAL)
    dealt = partial.repartition("n_bytes", "content_hash").sortWithinPartitions("n_bytes", "content_hash")
    return kernel(dealt, merge_tries, "text_sha256 string, keep_id long, keep_chars long, group_size long")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    light = kernel(rows, members, "doc_id long, n_chars_text long, text_sha256 string")
    light = light.groupBy("doc_id", "text_sha256", "n_chars_text").agg(F.count("*").alias("copies"))
    joined = light.join(groups_of_copies(df, id_col, text_col), "text_sha256")
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars_text") == F.col("keep_chars"))
    # repeated rows share a line up to here; the first of each set of repeats may stay
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc_id", "keep_id", "group_size", (best & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with df's own columns.

    The dropped are named by id and text and taken out of df by an anti-join, which needs no shuffle of df while they are
    few. An id and text that several rows share can be both kept and dropped; of such rows the longest stays, then the
    first by its other columns.
    """
    from pyspark.sql import Window

    names = df.columns
    sha, by_id, by_sha, rank = fresh(df, "sha", "by_id", "by_sha", "rank")
    found = materialise(exact_dedup(df, id_col, text_col).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"), "copies", df, light=True)
    clean = F.translate(F.coalesce(F.col(text_col), F.lit("")), WS, "")
    keyed = df.withColumn(sha, F.sha2(clean, 256))

    def named(rows: DataFrame):
        rows = rows.select(F.col("doc_id").alias(by_id), F.col("text_sha256").alias(by_sha))
        return F.broadcast(rows) if rows.count() <= FEW_IDS else rows

    same = F.col(id_col).cast("long").eqNullSafe(F.col(by_id)) & (F.col(sha) == F.col(by_sha))
    left = keyed.join(named(found.where("not kept")), same, "left_anti")
    again = found.where("kept")
    if not again.isEmpty():
        again = named(again)
        chars = F.char_length(F.coalesce(F.col(text_col), F.lit("")))
        first = Window.partitionBy(id_col, sha).orderBy(chars.desc(), *(F.col(c).cast("string") for c in names if c not in (id_col, text_col)))
        one = left.join(again, same, "left_semi").withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1)
        left = left.join(again, same, "left_anti").select(*names).unionByName(one.select(*names))
    return left.select(*names)

"""SimHash near-dedup with pigeonring filtering.

Fingerprints of 64 bits link at ``tau`` or fewer differing bits. Cut into m = tau + 1 ring-ordered segments, a linked
pair has a segment from which, for every l, l consecutive segments differ in l * tau / m bits at most: 0, 1, 2, ... The
first budgets make the candidate keys: segment i is equal, and the rest of a chain of L segments differs in L - 1 bits at
most, so of any b equal blocks of that rest at least b - L + 1 are equal. One key for each i and choice of blocks; for
tau = 3: L = 2, b = 2, eight keys of 24 bits; for tau = 7: L = 4, b = 6, 160 keys of 20 bits. Pairs that share a key pass
the chain's budgets one after another before the full Hamming check.

A key's fingerprints are compared in one kernel call by vectorised passes; the call returns one link from each to the
smallest of its local component, never all pairs. Keys with more than ``block`` fingerprints are only named by the first
pass; a second one splits them: each pair of chunks is a call of its own, so every pair is still compared and no call
holds more than two chunks. Components come from
alternating large-star and small-star rounds on tables in the shared folder.

Defined cases: null and empty texts have fingerprint 0 and link like others; repeated rows fall into one component;
component_id is the smallest non-null id reachable (null if there is none); an empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.llm.common import FEW_IDS, discard, fresh, kernel, materialise, slices

SEED, TAU, BLOCK = 42, 3, 4096
#: tau -> segments of the chain whose budgets make the keys, blocks of its rest.
CHAINS = {3: (2, 2), 7: (4, 6)}


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    found = text.encode("utf-8", "replace").lower().split() if text else []  # bytes.lower() changes A-Z alone
    if not found:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(found), len(found)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1) - 1
    starts = [0, *(ends[: n - width] + 1).tolist()]
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())), np.uint64, n - width + 1)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes. Counted in slices, so that memory doesn't grow with the text."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64)
        total += bits.sum(axis=0, dtype=np.int32)
    ones = total * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long): one row for each input row."""

    def run(batches):
        for b in slices(batches):
            fps = [majority(shingle_hashes(t, width)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return kernel(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, fp long", df)


def keys(fps: DataFrame, tau: int = TAU) -> DataFrame:
    """fp, key: the candidate keys of each fingerprint, natively. A key's upper part is its kind, start * kinds + choice."""
    (chain, blocks), segments = CHAINS[tau], tau + 1
    width = 64 // segments
    block = (chain - 1) * width // blocks
    chosen = list(combinations(range(blocks), blocks - chain + 1))
    bits = width + (blocks - chain + 1) * block
    fp, ring = F.col("fp"), F.col("ring")
    turns = [F.shiftleft(fp, i * width).bitwiseOR(F.shiftrightunsigned(fp, 64 - i * width)) if i else fp for i in range(segments)]
    part = lambda first, size: F.shiftrightunsigned(ring, 64 - first - size).bitwiseAND(F.lit((1 << size) - 1))
    made = []
    for j, choice in enumerate(chosen):
        key = F.shiftleft(F.col("start").cast("long") * len(chosen) + j, bits).bitwiseOR(F.shiftleft(part(0, width), bits - width))
        for k, c in enumerate(choice):
            key = key.bitwiseOR(F.shiftleft(part(width + c * block, block), bits - width - (k + 1) * block))
        made.append(key)
    turned = fps.select("fp", F.posexplode(F.array(*turns)).alias("start", "ring"))
    return turned.select("fp", F.explode(F.array(*made)).alias("key")) if len(made) > 1 else turned.select("fp", made[0].alias("key"))


def start_of(key: np.ndarray, tau: int) -> np.ndarray:
    """The segment at which a key's chain starts."""
    chain, blocks = CHAINS[tau]
    width = 64 // (tau + 1)
    bits = width + (blocks - chain + 1) * ((chain - 1) * width // blocks)
    return (key >> bits) // math.comb(blocks, chain - 1)


def units(keyed: DataFrame, large: DataFrame, block: int) -> DataFrame:
    """fp, key, a, b, side: the calls for large keys. a = b compares a chunk within itself, else chunk a with chunk b."""
    counts = keyed.join(large, "key").groupBy("key").agg(F.count("*").alias("c"))
    many = keyed.join(counts, "key").withColumn("n", F.ceil(F.col("c") / F.lit(float(block))))
    many = many.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return many.select("fp", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("side"))


def chain_links(x: np.ndarray, start: np.ndarray, tau: int = TAU) -> np.ndarray:
    """Which differences x pass the chain from segment ``start``, budget by budget, and the full check at its end."""
    segments = tau + 1
    width = 64 // segments
    by = (start * width).astype(np.uint64)
    turned = (x << by) | (x >> ((np.uint64(64) - by) & np.uint64(63)))
    at = np.arange(len(x))
    for length in range(1, segments + 1):
        at = at[np.bitwise_count(turned[at] >> np.uint64(64 - width * length)) <= length * tau // segments]
    ok = np.zeros(len(x), bool)
    ok[at] = True
    return ok


def unit_roots(fp: np.ndarray, unit: np.ndarray, start: np.ndarray, side: np.ndarray, cross: np.ndarray, tau: int = TAU) -> np.ndarray:
    """For rows sorted by unit: the index of the first row of each row's component within its unit."""
    n = len(fp)
    root = np.arange(n)
    left, gap = np.arange(n), 1
    while True:
        left = left[left + gap < n]
        left = left[unit[left] == unit[left + gap]]
        if not len(left):
            return root
        right = left + gap
        asked = (root[left] != root[right]) & (~cross[left] | (side[left] != side[right]))
        a, b = left[asked], right[asked]
        if len(a):
            ok = chain_links(fp[a] ^ fp[b], start[a], tau)
            a, b = a[ok], b[ok]
        while len(a):  # hook larger roots to smaller ones until all these links are inside components
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if not len(a):
                break
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
        gap += 1


def key_links(batches, tau: int, limit: int | None = None):
    """Sorted rows fp, key[, a, b, side] in; out: u, v, the first of u's local component, or large, a key with more than
    limit rows, of which no more are held. A key's call is never split between batches."""
    names = ("key", "a", "b")
    held: list[pa.RecordBatch] = []
    over = None  # the large key whose rows are being passed over

    def out(u, v, large):
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(large, pa.int64())], names=["u", "v", "large"])

    def links(table: pa.Table):
        parts = {c: table.column(c).to_numpy() for c in table.column_names}
        fp, key = parts["fp"].view(np.uint64), parts["key"]
        new = np.ones(len(fp), bool)
        new[1:] = np.logical_or.reduce([parts[c][1:] != parts[c][:-1] for c in names if c in parts])
        unit = np.cumsum(new) - 1
        size = np.bincount(unit)
        large = np.flatnonzero(size > limit) if limit else np.zeros(0, np.int64)
        if len(large):
            at = np.flatnonzero(new)[large]
            yield out([None] * len(at), [None] * len(at), key[at])
        some = (size[unit] > 1) & ~np.isin(unit, large)
        fp, key, unit = fp[some], key[some], unit[some]
        side, cross = (parts["side"][some], (parts["a"] != parts["b"])[some]) if "side" in parts else (np.zeros(len(fp), int), np.zeros(len(fp), bool))
        root = unit_roots(fp, unit, start_of(key, tau), side, cross, tau)
        moved = np.flatnonzero(root != np.arange(len(fp)))
        signed = fp.view(np.int64)
        if len(moved):
            yield out(signed[moved], signed[root[moved]], [None] * len(moved))

    def last_call(table: pa.Table) -> int:
        """The first row of the last call, which may go on in the next batch."""
        same = np.ones(table.num_rows, bool)
        for c in names:
            if c in table.column_names:
                column = table.column(c).to_numpy()
                same &= column == column[-1]
        return int(np.argmax(same))

    for batch in batches:
        table = pa.Table.from_batches([*held, batch])
        if over is not None:
            table = table.filter(pc.not_equal(table.column("key"), over))
        if not table.num_rows:
            held = []
            continue
        over, at = None, last_call(table)
        if at:
            yield from links(table.slice(0, at).combine_chunks())
        table = table.slice(at).combine_chunks()
        if limit and table.num_rows > limit:
            over = table.column("key")[0].as_py()
            yield out([None], [None], [over])
            held = []
        else:
            held = table.to_batches()
    if held:
        yield from links(pa.Table.from_batches(held).combine_chunks())


def links(fps: DataFrame, block: int = BLOCK, tau: int = TAU, source: DataFrame | None = None) -> DataFrame:
    """u, v (u != v): links whose components are those of all pairs within tau. fps: different values of fp."""
    keyed, schema = keys(fps, tau), "u long, v long, large long"
    first = kernel(keyed.repartition("key").sortWithinPartitions("key"), lambda batches: key_links(batches, tau, block), schema, source)
    first = materialise(first, "links", source)
    edges = first.where("large is null").select("u", "v")
    large = first.where("large is not null").select(F.col("large").alias("key")).distinct()
    if not large.isEmpty():
        calls = units(keyed, large, block).repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
        edges = edges.unionByName(kernel(calls, lambda batches: key_links(batches, tau), schema).select("u", "v"))
    return edges.distinct()


def components(edges: DataFrame, source: DataFrame | None = None, rounds: int = 60) -> DataFrame:
    """node, label: label is the smallest node reachable. Alternating large-star and small-star rounds. source: the table
    that the edges are made from, by whose size the rounds' tables get their files."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        seen = both.join(least, "u")
        if large:
            out = seen.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = seen.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return out.where("u != v").distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = materialise(edges, "links", source, light=True)
    seen = state(edges)
    for _ in range(rounds):
        if not seen[0]:
            break
        before, edges = edges, materialise(star(star(edges, True), False), "stars", source, light=True)
        discard(before)
        now = state(edges)
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen = now
    if seen[0]:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, block: int = BLOCK, tau: int = TAU) -> DataFrame:
    """doc_id, fp, component_id: one row for each input row."""
    prints = materialise(fingerprints(df, id_col, text_col, width), "fingerprints", df)
    by_fp = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    labels = components(links(by_fp.select("fp"), block, tau, df), df)
    named = by_fp.join(labels, by_fp["fp"] == labels["node"], "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    owners = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = named.join(owners, "label").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """One row of each component stays, that with the smallest id; df's own columns. Rows link at a Jaccard similarity of 0.8
    or more of their shingle sets: fingerprints link first, an exact check of their links follows, and pairs at 0.8 that
    differ in more bits than fingerprints may are found exactly.

    The dropped are named by id and text, as an id may stand on several texts. Of a component's rows that share its smallest
    id the first by text, then by the other columns stays. Rows without an id are copies of each other alone: of a
    component's, one stays likewise.
    """
    from voxelweave.llm import jaccard  # which imports this module

    by_id, by_text, group, rank, text_hash = fresh(df, "by_id", "by_text", "group", "rank", "text_hash")
    found = materialise(jaccard.members(df, id_col, text_col, width), "members", df, light=True)
    gone = found.where("doc_id > component_id").select(F.col("doc_id").alias(by_id), F.col("th").alias(by_text)).distinct()
    gone = materialise(gone, "near-gone", df, light=True)
    firsts = found.where("doc_id is null or doc_id = component_id")
    several = firsts.groupBy("label", "doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("label").alias(group), F.col("doc_id").alias(by_id))
    tied = firsts.join(several, (F.col("label") == F.col(group)) & F.col("doc_id").eqNullSafe(F.col(by_id))).select(by_id, F.col("th").alias(by_text), group).distinct()
    tied = materialise(tied, "near-tied", df, light=True)

    def named(rows: DataFrame) -> DataFrame:  # more rows meet df in a shuffle
        return F.broadcast(rows) if rows.count() <= FEW_IDS else rows

    same = F.col(id_col).cast("long").eqNullSafe(F.col(by_id)) & (F.col(text_hash) == F.col(by_text))
    left = df.withColumn(text_hash, F.xxhash64(text_col)).join(named(gone), same, "left_anti")
    if tied.isEmpty():
        return left.drop(text_hash)
    tied = named(tied)
    first = Window.partitionBy(group, by_id).orderBy(text_col, *(F.col(c).cast("string") for c in df.columns if c not in (id_col, text_col)))
    one = left.join(tied, same).withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).drop(by_id, by_text, group, rank)
    return left.join(tied, same, "left_anti").unionByName(one).drop(text_hash)

"""Near copies by SimHash and an exact check: sets of word shingles with a Jaccard similarity of 0.8 or more.

SimHash goes first: fingerprints of ``PRINT_WIDTH``-word shingles within ``PRINT_TAU`` bits, by the pigeonring operator, are
checked with the sets themselves, and what passes is linked. Pairs at 0.8 whose fingerprints differ in more bits are no less
near copies; the rest of this module finds them exactly, among the sets that SimHash's links don't join.

Shingles are put in one order: those common in a sample of ``SAMPLE`` texts last, the others by hash. Sets of n shingles
at 0.8 or more share one of the first n - ceil(0.8 n) + 1 of each. The sample decides the order only, so how much work
there is; what is found is exact for any order (up to collisions of 64-bit hashes).

Sets that share such a key and fit in length form groups; keys with the same sets are one group. In a first round each set
is compared with the first set of each of its groups that SimHash hasn't joined with it, so a group of near copies costs as much as it has members. A second
round compares what is left: the pairs of a group that the first round's links don't join. Groups with ``SMALL`` sets at
most give pairs, pruned by bitmaps: each set has the parities of its hashes in about n cells, and two sets differ in at
least as many shingles as cells. Pairs that pass are checked with the sets themselves. Groups with more sets are compared
in kernel calls: one with the bitmaps names the sets that some other one isn't told apart from, one holds these sets and
gives one link from each to the first of its local component. A group with more than ``BLOCK`` sets is split into pairs of
chunks, so every pair is still compared or known to be joined.

Defined cases: texts of fewer words than ``width`` have one shingle; null and empty texts have none and link with each
other; repeated rows link; a very long text has a set as large as its shingles are many, which no kernel call copies; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.llm.common import hash_fraction, kernel, materialise, slices
from voxelweave.llm.simhash import components, majority, shingle_hashes, units
from voxelweave.llm.simhash import links as fingerprint_links

#: Words of a fingerprint's shingles and the bits in which fingerprints may differ.
PRINT_WIDTH, PRINT_TAU = 3, 7
SAMPLE, COMMON, SMALL, BLOCK = 8000, 200_000, 32, 2048
#: Bits at most of the table that tells which texts are read again.
MOST_CELLS = 1 << 26


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def node_of(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of two sorted sets is 0.8 or more, in whole numbers."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return 9 * int((b[at] == a).sum()) >= 4 * (len(a) + len(b))


def parities(found: np.ndarray) -> np.ndarray:
    """Parities of the hashes' counts in as many cells as the power of two at or over their number, 64 at least."""
    cells = max(64, 1 << (len(found) - 1).bit_length()) if len(found) else 64
    counts = np.bincount((found & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def may_differ(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """In how many shingles sets of n and m may differ at 0.8."""
    return n + m - 2 * -(-4 * (n + m) // 9)


def common(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes found in two or more sampled texts, sorted, and their counts."""

    def run(batches):
        for b in slices(batches, 64):
            sets = [shingle_set(t, width) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])

    share = min(1.0, SAMPLE / max(1, texts.count()))
    counts = kernel(texts.where(hash_fraction("text", share)).select("text"), run, "h long").groupBy("h").agg(F.count("*").cast("int").alias("c"))
    most = counts.where("c > 1").orderBy(F.desc("c"), "h").limit(COMMON).toArrow()
    h = most.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], most.column("c").to_numpy()[order]


def prefix(found: np.ndarray, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    n = len(found)
    hashes, counts = often
    if len(hashes) and n:
        at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
        found = found[np.lexsort((found, np.where(hashes[at] == found, counts[at], 0)))]
    return found[: n - -(-4 * n // 5) + 1]


def prints(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """doc_id, node (hash of the shingle set), fp (the text's SimHash), th (hash of the text), n, keys, bits: one row for
    each input row. keys and bits stand with a set's first row in the task only, so a set that many rows have is moved once for each task."""
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    shared = df.sparkSession.sparkContext.broadcast(common(texts, width))
    kind = pa.list_(pa.int64())

    def run(batches):
        seen: set[int] = set()
        for b in slices(batches):
            found = b.column(1).to_pylist()
            sets = [shingle_set(t, width) for t in found]
            nodes = [node_of(s) for s in sets]
            fps = [majority(shingle_hashes(t, PRINT_WIDTH)) for t in found]
            new = [not (x in seen or seen.add(x)) for x in nodes]
            keys = pa.array([prefix(s, shared.value).view(np.int64) if k else None for s, k in zip(sets, new)], kind)
            bits = pa.array([parities(s).tobytes() if k else None for s, k in zip(sets, new)], pa.binary())
            columns = [b.column(0), pa.array(nodes, pa.int64()), pa.array(fps, pa.int64()), b.column(2), pa.array([len(s) for s in sets], pa.int32()), keys, bits]
            if len(seen) > 200_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "fp", "th", "n", "keys", "bits"])

    return kernel(texts, run, "doc_id long, node long, fp long, th long, n int, keys array<long>, bits binary", df)


def whole_units(batches, names: tuple[str, ...]):
    """Tables of whole groups of rows that agree in ``names``, from rows sorted by these."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        other = np.zeros(batch.num_rows, bool)
        for c in names:
            column = batch.column(batch.schema.get_field_index(c)).to_numpy()
            other |= column != column[-1]
        at = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        last = held and any(held[-1].column(c)[held[-1].num_rows - 1] != batch.column(c)[0] for c in names)
        if at or last:
            ready = [*held, batch.slice(0, at)] if at else held
            yield pa.Table.from_batches(ready).combine_chunks()
            held = []
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def sizes(bits: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, bits), np.int64, len(bits)) // 8


def near_bits(n: np.ndarray, bits: list[bytes], size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs a, b fit in length and aren't told apart by their bitmaps. The larger bitmap is folded to the smaller."""
    low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    ok = 5 * low >= 4 * high
    least = np.minimum(size[a], size[b])
    for w in np.unique(least[ok]):
        pairs = np.flatnonzero(ok & (least == w))
        used = np.unique(np.concatenate([a[pairs], b[pairs]]))
        rows = np.array([np.bitwise_xor.reduce(np.frombuffer(bits[k], np.uint64).reshape(-1, w), axis=0) for k in used])
        x, y = np.searchsorted(used, a[pairs]), np.searchsorted(used, b[pairs])
        for at in range(0, len(pairs), 1 << 14):
            part = slice(at, at + (1 << 14))
            apart = np.bitwise_count(rows[x[part]] ^ rows[y[part]]).sum(axis=1, dtype=np.int64)
            ok[pairs[part]] = apart <= may_differ(low[pairs[part]], high[pairs[part]])
    return ok


def small_pairs(batches):
    """Rows key, node, n, bits, label sorted by key, n in: u, v, pairs of a key with different labels that may be similar."""
    for t in whole_units(batches, ("key",)):
        key, node, label = (t.column(c).to_numpy() for c in ("key", "node", "label"))
        n, bits = t.column("n").to_numpy().astype(np.int64), t.column("bits").to_pylist()
        size = sizes(bits)
        left, gap = np.arange(len(key)), 1
        while True:
            left = left[left + gap < len(key)]
            left = left[key[left] == key[left + gap]]
            left = left[5 * n[left] >= 4 * n[left + gap]]  # sorted by n: what is too long stays so
            if not len(left):
                break
            a = left[label[left] != label[left + gap]]
            a = a[near_bits(n, bits, size, a, a + gap)] if len(a) else a
            u, v = node[a], node[a + gap]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])
            gap += 1


def calls_of(batches, *columns: str):
    """The calls in rows sorted by key, a, b, n: whether it is a chunk against another, side, node, n, bits, sizes, label,
    and the further columns."""
    for t in whole_units(batches, ("key", "a", "b")):
        parts = {c: t.column(c).to_numpy() for c in ("key", "a", "b", "side", "node", "n", "label")}
        new = np.ones(t.num_rows, bool)
        new[1:] = np.logical_or.reduce([parts[c][1:] != parts[c][:-1] for c in ("key", "a", "b")])
        starts = [*np.flatnonzero(new).tolist(), t.num_rows]
        for first, end in zip(starts, starts[1:]):
            n, side, node, label = (parts[c][first:end] for c in ("n", "side", "node", "label"))
            bits = t.column("bits").slice(first, end - first).to_pylist()
            yield (parts["a"][first] != parts["b"][first], side, node, n.astype(np.int64), bits, sizes(bits), label, *(t.column(c).slice(first, end - first) for c in columns))


def facing(i: int, root: np.ndarray, cross: bool, side: np.ndarray, n: np.ndarray, bits: list[bytes], size: np.ndarray) -> np.ndarray:
    """Rows after i that are to be compared with it, are of other components, and aren't told apart from it."""
    j = np.arange(i + 1, int(np.searchsorted(n, 5 * n[i] // 4, side="right")))
    j = j[(root[j] != root[i]) & (not cross or side[j] != side[i])]
    return j[near_bits(n, bits, size, np.full(len(j), i), j)] if len(j) else j


def unit_needs(batches):
    """Rows key, a, b, side, node, n, bits, label in: key, a, b, need, the nodes that some other one of the call isn't told
    apart from."""
    for cross, side, node, n, bits, size, label, key, a, b in calls_of(batches, "key", "a", "b"):
        need = np.zeros(len(n), bool)
        for i in range(len(n) - 1):
            j = facing(i, label, cross, side, n, bits, size)
            need[j] = True
            need[i] |= len(j) > 0
        if need.any():
            some = pa.array(need)
            yield pa.RecordBatch.from_arrays([*(c.filter(some).combine_chunks() for c in (key, a, b)), pa.array(node[need])], names=["key", "a", "b", "need"])


def unit_links(batches):
    """Rows key, a, b, side, node, n, bits, label, found in: u, v, the first of u's component in its call. Rows with one
    label are joined from the start."""
    for cross, side, node, n, bits, size, label, found in calls_of(batches, "found"):
        _, firsts, inverse = np.unique(label, return_index=True, return_inverse=True)
        root = firsts[inverse]
        for i in range(len(n) - 1):
            own = None
            for k in facing(i, root, cross, side, n, bits, size).tolist():
                if root[k] != root[i]:
                    own = np.frombuffer(found[i].as_py(), np.uint64) if own is None else own
                    if similar(own, np.frombuffer(found[k].as_py(), np.uint64)):
                        low, high = sorted((root[i], root[k]))
                        root[root == high] = low
        moved = np.flatnonzero(label != label[root])
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], names=["u", "v"])


def near_pairs(batches):
    """Rows u, v, nu, nv, bu, bv in: u, v of those that aren't told apart by lengths and bitmaps."""
    for b in slices(batches, 4096):
        n = np.concatenate([b.column(k).to_numpy() for k in (2, 3)]).astype(np.int64)
        at, bits = np.arange(b.num_rows), b.column(4).to_pylist() + b.column(5).to_pylist()
        ok = pa.array(near_bits(n, bits, sizes(bits), at, at + b.num_rows))
        yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["u", "v"])


def checked(batches):
    for b in batches:
        u, v = b.column("u"), b.column("v")
        ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column("fu").to_pylist(), b.column("fv").to_pylist())]
        yield pa.RecordBatch.from_arrays([u.filter(pa.array(ok, pa.bool_())), v.filter(pa.array(ok, pa.bool_()))], names=["u", "v"])


def sets_of(df: DataFrame, nodes: DataFrame, text_col: str, width: int, most_cells: int = MOST_CELLS) -> DataFrame:
    """node, found for the rows node, th of ``nodes``: their texts are read again. A table of bits, sixteen for each row and
    ``most_cells`` at most, tells which texts may be asked for; more rows meet the texts in a shuffle."""
    asked = nodes.select("node", "th")
    n = asked.count()
    cells = max(1 << 16, 1 << (16 * n - 1).bit_length()) if n else 1 << 16
    texts = df.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    if cells > most_cells:
        texts, shared = texts.join(asked.select("th").distinct(), "th", "left_semi").select("text", "th"), None
    else:
        cell = F.col("th").bitwiseAND(cells - 1)
        table = asked.groupBy(F.shiftright(cell, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST((th & {cells - 1}) & 63 AS INT))")).alias("w")).toArrow()
        words = np.zeros(cells // 64, np.int64)
        words[table.column("at").to_numpy()] = table.column("w").to_numpy()
        shared = df.sparkSession.sparkContext.broadcast(words.view(np.uint64))

    def run(batches):
        for b in slices(batches):
            text = b.column(0)
            if shared is not None:
                at = b.column(1).to_numpy().view(np.uint64) & np.uint64(cells - 1)
                hit = (shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
                text = text.filter(pa.array(hit == 1))
            sets = [shingle_set(t, width) for t in text.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "found"])

    found = kernel(texts, run, "node long, found binary")
    return found.join(asked.select("node"), "node", "left_semi").dropDuplicates(["node"])


def groups_of(rows: DataFrame, source: DataFrame) -> DataFrame:
    """key, node, n, c: the sets that share a key and fit in length with another one there; c sets share the key. Keys that
    the same sets share are one, named by the sets."""
    keyed = rows.where("keys is not null").select("node", "n", F.explode("keys").alias("key"))
    keyed = keyed.repartition("key").dropDuplicates(["key", "node"])  # from several tasks
    own, by_n = Window.partitionBy("key"), Window.partitionBy("key").orderBy("n")
    keyed = keyed.withColumn("less", F.lag("n").over(by_n)).withColumn("more", F.lead("n").over(by_n)).withColumn("c", F.count("*").over(own)).withColumn("name", F.bit_xor("node").over(own))
    return materialise(keyed.where("5 * less >= 4 * n OR 5 * n >= 4 * more").select(F.xxhash64("name", "c").alias("key"), "node", "n", "c").distinct(), "groups", source, light=True)


def similar_pairs(pairs: DataFrame, df: DataFrame, nodes: DataFrame, text_col: str, width: int, name: str) -> DataFrame:
    """The pairs u, v whose sets, made from the texts again, are similar."""
    pairs = materialise(pairs.distinct(), f"{name}-pairs", df, light=True)
    asked = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    sets = materialise(sets_of(df, nodes.join(asked, "node", "left_semi"), text_col, width), f"{name}-sets", df)
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("found").alias("fu")), "u").join(sets.select(F.col("node").alias("v"), F.col("found").alias("fv")), "v")
    return materialise(kernel(both, checked, "u long, v long", df, light=True), f"{name}-links", df, light=True)


def print_pairs(rows: DataFrame, df: DataFrame) -> DataFrame:
    """u, v: nodes with one fingerprint, and nodes whose fingerprints SimHash links, one pair for each of its links."""
    both = materialise(rows.select("node", "fp").distinct(), "node-prints", df, light=True)
    firsts = materialise(both.groupBy("fp").agg(F.min("node").alias("first")), "first-prints", df, light=True)
    same = both.join(firsts, "fp").select(F.col("node").alias("u"), F.col("first").alias("v"))
    first = lambda fp, end: firsts.select(F.col("fp").alias(fp), F.col("first").alias(end))
    near = fingerprint_links(firsts.select("fp"), tau=PRINT_TAU, source=df).select(F.col("u").alias("fu"), F.col("v").alias("fv"))
    near = near.join(first("fu", "a"), "fu").join(first("fv", "b"), "fv").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    return same.unionByName(near).where("u != v").distinct()


def links(df: DataFrame, rows: DataFrame, nodes: DataFrame, text_col: str, width: int, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """u, v: links whose components are those of all pairs of nodes at 0.8 or more. rows: prints; nodes: node, th."""
    met = groups_of(rows, df)
    bits = rows.where("bits is not null").select("node", "n", "bits").dropDuplicates(["node"])
    bits = materialise(bits.join(met.select("node").distinct(), "node", "left_semi"), "bits", df, light=True)

    side = lambda end: bits.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("bits").alias(f"b{end}"))

    def proven(pairs: DataFrame, name: str) -> DataFrame:  # a set in no group is similar to no other one
        pairs = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "nu", "nv", "bu", "bv")
        return similar_pairs(kernel(pairs, near_pairs, "u long, v long"), df, nodes, text_col, width, name)

    by_print = proven(print_pairs(rows, df), "print")
    joined = components(by_print, df)
    named = met.select("key", "node").join(joined, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    firsts = named.groupBy("key").agg(F.min(F.struct("node", "label")).alias("f"))
    stars = named.join(firsts, "key").where("label != f.label").select(F.col("node").alias("u"), F.col("f.node").alias("v")).distinct()
    first = by_print.unionByName(proven(stars, "first"))

    labels = components(first, df)
    left = met.where("c > 2").join(labels, "node", "left").select("key", "node", "n", "c", F.coalesce("label", "node").alias("label"))
    mixed = left.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    left = materialise(left.join(mixed, "key", "left_semi"), "mixed", df, light=True)
    few = left.where(F.col("c") <= small).join(bits.select("node", "bits"), "node").repartition("key").sortWithinPartitions("key", "n").select("key", "node", "n", "bits", "label")
    second = similar_pairs(kernel(few, small_pairs, "u long, v long"), df, nodes, text_col, width, "second")

    many = left.where(F.col("c") > small).select(F.col("node").alias("fp"), "key")
    if many.isEmpty():
        return first.unionByName(second).distinct()
    own = left.where(F.col("c") > small).select("key", "node", "label").join(bits, "node")
    calls = units(many, many.select("key").distinct(), block).withColumnRenamed("fp", "node").join(own, ["key", "node"])
    dealt = lambda rows: rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "n")
    needs = materialise(kernel(dealt(calls), unit_needs, "key long, a long, b long, need long", df, light=True), "needs", df, light=True)
    sets = sets_of(df, nodes.join(needs.select(F.col("need").alias("node")).distinct(), "node", "left_semi"), text_col, width)
    calls = calls.join(needs.withColumnRenamed("need", "node"), ["key", "a", "b", "node"], "left_semi").join(sets, "node")
    return first.unionByName(second).unionByName(kernel(dealt(calls), unit_links, "u long, v long")).distinct()


def members(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """doc_id, th (hash of the text), label (of the component, ids or not), component_id (the smallest id reachable): one
    row for each input row."""
    rows = materialise(prints(df, id_col, text_col, width), "prints", df)
    nodes = materialise(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("th").alias("th")), "nodes", df, light=True)
    labels = components(links(df, rows, nodes, text_col, width, small, block), df)
    named = nodes.select("node", "first_id").join(labels, "node", "left").select("node", "first_id", F.coalesce("label", "node").alias("label"))
    owners = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = named.join(owners, "label").select("node", "label", "component_id")
    return rows.select("doc_id", "th", "node").join(named, "node").select("doc_id", "th", "label", "component_id")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """doc_id, component_id (the smallest id reachable): one row for each input row."""
    return members(df, id_col, text_col, width, small, block).select("doc_id", "component_id")

"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

The examples are an id-hash sample of the labelled rows that aren't held out, ``EXAMPLES`` at most in expectation. Terms are
the words of the examples: those that two or more examples hold, without those that over ``COMMON`` of them hold. Words and
word beginnings that are significantly more frequent in toxic examples (signed root of the likelihood ratio of ``least_z``
or more) are terms as well, and weigh that root times as much. Document frequencies are counted over all documents.
Examples are ordered so that similar ones share a block of 64; each term has its largest weight in each block that it
occurs in, so a block whose bound is below the k-th similarity found so far is passed over. Votes of the k nearest,
weighted by squared similarity, are mapped to probabilities by isotonic regression on leave-one-out votes of the examples
themselves; the neighbours are kept as evidence.

Defined cases: null texts, empty texts and texts without any term have no neighbours and get the smoothed share of toxic
rows among such examples, or among all if each example has a term; without any example the score is 0; texts and words of
any length are read whole; an id labelled more than once counts as toxic if one label says so; labels of unknown ids and
null labels are passed over; repeated rows agree; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import hash_fraction, kernel, slices, train_rows

EXAMPLES, NEIGHBOURS, BLOCK, COMMON = 4000, 4, 64, 0.05
RUN = re.compile(r"[^\W\d_]+")
#: Letters of the word beginnings that may be chosen as terms, so that inflected and compounded forms share one.
STEMS = (4, 5, 6, 7, 8)


def beginnings(word: str) -> list[str]:
    return [word[:n] + "-" for n in STEMS if len(word) > n]


class Terms:
    """Finds the vocabulary's terms in texts: whole words by set operations, beginnings only of words that start like one."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary
        self.heads = {x[: STEMS[0]] for x in vocabulary if x.endswith("-")}

    def present(self, text: str | None) -> set[int]:
        if not text:
            return set()
        words, get, first, heads = set(RUN.findall(text.lower())), self.vocabulary.get, STEMS[0], self.heads
        out = {get(w) for w in self.vocabulary.keys() & words}
        out.update(k for w in words if w[:first] in heads for x in beginnings(w) if (k := get(x)) is not None)
        return out

    def counts(self, text: str | None) -> dict[int, int]:
        if not text:
            return {}
        words, get, first, heads = Counter(RUN.findall(text.lower())), self.vocabulary.get, STEMS[0], self.heads
        out = {get(w): words[w] for w in self.vocabulary.keys() & words.keys()}
        for w in words:
            if w[:first] in heads:
                for x in beginnings(w):
                    if (k := get(x)) is not None:
                        out[k] = out.get(k, 0) + words[w]
        return out


def word_presence(batches):
    """word, toxic, c: examples in which each word or beginning occurs; flushed when large."""
    seen: Counter = Counter()

    def flush():
        rows = iter(seen.items())
        while part := list(islice(rows, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in part], pa.string()), pa.array([k[1] for k, _ in part], pa.int32()), pa.array([c for _, c in part], pa.int64())], names=["word", "toxic", "c"])
        seen.clear()

    for b in slices(batches, 64):
        for toxic, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            seen.update((x, toxic) for x in {x for w in set(RUN.findall((text or "").lower())) for x in (w, *beginnings(w))})
            if len(seen) > 100_000:
                yield from flush()
    yield from flush()


def examples(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """doc_id, toxic, text of the sampled examples. The sampled labels are bounded by ``most``, so they're broadcast."""
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    rows = train_rows(rows).where(~F.col("held_out")).select("doc_id", "toxic")
    total = rows.count()
    sample = rows.where(hash_fraction("doc_id", min(1.0, most / max(1, total))))
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text")


def choose_terms(rows: DataFrame, least_z: float, least_count: int) -> list[tuple[str, float]]:
    """(term, factor of its weight). Their number is bounded by the words of the sampled examples."""
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 + n0:
        return []
    by = kernel(rows, word_presence, "word string, toxic int, c long").groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("c")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("c"))).alias("b"))
    n, seen = float(n1 + n0), F.col("a") + F.col("b")
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    gain = part(F.col("a"), n1 * seen / n) + part(F.col("b"), n0 * seen / n) + part(n1 - F.col("a"), n1 * (1 - seen / n)) + part(n0 - F.col("b"), n0 * (1 - seen / n))
    lift = (F.col("a") >= least_count) & (F.col("a") * float(max(n0, 1)) > 2.0 * n1 * F.col("b"))
    by = by.withColumn("z", F.when(lift, F.sqrt(2 * F.greatest(gain, F.lit(0.0)))).otherwise(0.0))
    plain = ~F.col("word").endswith("-") & (seen >= 2) & (seen <= COMMON * n)
    best = by.where((F.col("z") >= least_z) | plain).select("word", F.when(F.col("z") >= least_z, F.col("z")).otherwise(1.0).alias("factor"))
    return sorted((r["word"], r["factor"]) for r in best.collect())


def frequencies(documents: DataFrame, text_col: str, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """Over all documents: in how many each term occurs, and their number."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        terms, total, n = Terms(shared.value), np.zeros(len(shared.value), np.int64), 0
        for b in slices(batches):
            found = [terms.present(text) for text in b.column(0).to_pylist()]
            n += len(found)
            size = sum(map(len, found))
            total += np.bincount(np.fromiter((k for x in found for k in x), np.int64, size), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(total[some], n), pa.int64())], names=["term", "n"])

    out, n = np.zeros(len(vocabulary), np.int64), 0
    counted = kernel(documents.select(F.col(text_col).alias("text")), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    for term, c in zip(counted.column("term").to_pylist(), counted.column("n").to_pylist()):
        if term < 0:
            n = c
        else:
            out[term] = c
    return out, n


def ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges [start, end) in a row, and how many each has."""
    size = end - start
    total = int(size.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(size) - size), size), size


class BlockMaxIndex:
    """Postings of unit vectors (term numbers, weights), by term, then example. An entry is a term's part in one block: its
    block, where its postings begin, and its largest weight."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], ids: list[int], toxic: list[int], n_terms: int):
        heaviest = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in vectors]
        order = sorted(range(len(vectors)), key=lambda i: (heaviest[i], ids[i]))
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.toxic = np.array([toxic[i] for i in order], np.int64)
        self.n, self.n_blocks = len(order), -(-len(order) // BLOCK)
        empty = [np.zeros(0, np.int64)]
        term = np.concatenate([vectors[i][0] for i in order] or empty).astype(np.int64)
        weight = np.concatenate([vectors[i][1] for i in order] or empty).astype(np.float64)
        row = np.repeat(np.arange(self.n), [len(vectors[i][0]) for i in order])
        by = np.lexsort((row, term))
        term, self.weights, self.rows = term[by], weight[by], row[by]
        block = self.rows // BLOCK
        new = np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))[: len(term)]
        self.entry = np.append(np.flatnonzero(new), len(term))
        self.block = block[self.entry[:-1]]
        self.most = np.maximum.reduceat(self.weights, self.entry[:-1]) if len(term) else np.zeros(0)
        self.first = np.searchsorted(term[self.entry[:-1]], np.arange(n_terms + 1))

    def vector(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Example k's terms and weights, from the postings."""
        at = np.flatnonzero(self.rows == k)
        entry = np.searchsorted(self.entry, at, side="right") - 1
        return np.searchsorted(self.first, entry, side="right") - 1, self.weights[at]

    def similarities(self, entry: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Of all examples, as far as these entries, with the query's weights for them, go."""
        at, size = ranges(self.entry[entry], self.entry[entry + 1])
        return np.bincount(self.rows[at], np.repeat(q, size) * self.weights[at], self.n)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, leave_out: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Similarities and numbers of up to k examples with a similarity over 0, by falling similarity, then number.
        Exact: blocks are read in two rounds, the most promising first, then those whose bound isn't below the k-th."""
        entry, size = ranges(self.first[terms], self.first[terms + 1])
        if not len(entry):
            return np.zeros(0), np.zeros(0, np.int64)
        q, block = np.repeat(weights, size), self.block[entry]
        bound = np.bincount(block, q * self.most[entry], self.n_blocks)
        head = np.zeros(self.n_blocks, bool)
        head[np.argsort(-bound, kind="stable")[: max(4, 2 * k // BLOCK)]] = True
        chosen = head[block]
        found = self.similarities(entry[chosen], q[chosen])
        if leave_out >= 0:
            found[leave_out] = 0
        seen = found[found > 0]
        least = float(np.partition(seen, len(seen) - k)[len(seen) - k]) if len(seen) >= k else 0.0
        rest = ~head & (bound * (1 + 1e-9) >= least)
        chosen = rest[block]
        if chosen.any():
            found += self.similarities(entry[chosen], q[chosen])
            if leave_out >= 0:
                found[leave_out] = 0
        some = np.flatnonzero(found >= least) if least > 0 else np.flatnonzero(found)
        some = some[np.lexsort((some, -found[some]))][:k]
        return found[some], some


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (from, value) of the non-decreasing fit; each pool's mean is smoothed by half a row of each class."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for at, value in zip(x[order], y[order]):
        pools.append([at, float(value), 1.0])
        while len(pools) > 1 and (pools[-2][0] == pools[-1][0] or pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]):
            last = pools.pop()
            pools[-1][1] += last[1]
            pools[-1][2] += last[2]
    means = np.array([(s + 0.5) / (n + 1) for _, s, n in pools])
    return np.array([p[0] for p in pools]), np.maximum.accumulate(means)


class Model:
    """rows: (id, toxic, {term: count}) of the examples."""

    def __init__(self, vocabulary: dict[str, int], scale: np.ndarray, rows: list[tuple[int, int, dict[int, int]]], k: int):
        self.vocabulary, self.scale, self.k = vocabulary, scale, k
        vectors = [self.unit(c) for _, _, c in rows]
        none = [t for (_, t, _), (v, _) in zip(rows, vectors) if not len(v)] or [t for _, t, _ in rows]
        self.base = (sum(none) + 0.5) / (len(none) + 1) if none else 0.0
        some = sorted((i for i, (v, _) in enumerate(vectors) if len(v)), key=lambda i: rows[i][0])
        self.index = BlockMaxIndex([vectors[i] for i in some], [rows[i][0] for i in some], [rows[i][1] for i in some], len(vocabulary))
        place = {int(d): k for k, d in enumerate(self.index.ids)}
        votes = np.array([self.vote(*self.index.nearest(*vectors[i], k, leave_out=place[rows[i][0]])) for i in some])
        self.steps = isotonic(votes, np.array([rows[i][1] for i in some])) if some else (np.zeros(0), np.zeros(0))

    def unit(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        terms = np.fromiter(counts, np.int64, len(counts))
        order = np.argsort(terms)  # sums run in one order, so that reruns agree to the last bit
        terms = terms[order]
        w = (1 + np.log(np.fromiter(counts.values(), np.float64, len(counts))[order])) * self.scale[terms]
        return terms, w / max(np.sqrt((w * w).sum()), 1e-300)

    def vote(self, similarity: np.ndarray, near: np.ndarray) -> float:
        """Share of toxic neighbours, weighted by squared similarity; one neighbour of similarity 0.25 has the base rate."""
        weight = similarity * similarity
        return float(((weight * self.index.toxic[near]).sum() + 0.0625 * self.base) / (weight.sum() + 0.0625))

    def score(self, counts: dict[int, int]) -> tuple[float, np.ndarray, np.ndarray]:
        similarity, near = self.index.nearest(*self.unit(counts), self.k)
        if not len(near):
            return self.base, similarity, near
        at = int(np.searchsorted(self.steps[0], self.vote(similarity, near), side="right")) - 1
        return float(self.steps[1][max(at, 0)]), similarity, near


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = EXAMPLES, k: int = NEIGHBOURS, least_z: float = 4.5, least_count: int = 4) -> Model:
    rows = examples(documents, labels, id_col, text_col, label_col, most).persist()
    chosen = choose_terms(rows, least_z, least_count)
    vocabulary = {w: i for i, (w, _) in enumerate(chosen)}
    df, n = frequencies(documents, text_col, vocabulary) if chosen else (np.zeros(0, np.int64), 0)
    scale = (np.log((n + 1) / (df + 1)) + 1) * np.array([f for _, f in chosen])
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        counter = Terms(shared.value)
        for b in slices(batches):
            found = [counter.counts(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([list(c) for c in found], pa.list_(pa.int64())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], names=["doc_id", "toxic", "terms", "counts"])

    seen = kernel(rows, run, "doc_id long, toxic int, terms array<long>, counts array<long>").toArrow()
    rows.unpersist()
    # rows that repeat an id are one example
    found = {i: (i, t, dict(sorted(zip(x, c)))) for i, t, x, c in sorted(zip(*(seen.column(c).to_pylist() for c in seen.column_names)))}
    return Model(vocabulary, scale, list(found.values()), k)


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (nearest examples): one row for each input row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        terms, index = Terms(model.vocabulary), model.index
        for b in slices(batches):
            found = [model.score(terms.counts(t)) for t in b.column(2).to_pylist()]
            scores = [min(1.0, max(0.0, s)) for s, _, _ in found]
            ends = np.append(0, np.cumsum([len(near) for _, _, near in found]))
            near = np.concatenate([near for _, _, near in found])
            flat = pa.StructArray.from_arrays([pa.array(index.ids[near]), pa.array(np.concatenate([s for _, s, _ in found])), pa.array(index.toxic[near], pa.int32())], names=["doc_id", "similarity", "toxic"])
            evidence = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), evidence], names=["doc_id", "held_out", "score", "predicted", "evidence"])

    rows = train_rows(documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "held_out", "text")
    return kernel(rows, run, "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id: long, similarity: double, toxic: int>>")

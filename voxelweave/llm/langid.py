"""Language ID with word-first backoff.

A model holds, per language, log frequencies of words and of character n-grams (n = 1 to 5, with word edges). A known
word scores by its own frequencies; an unseen one by the longest n for which any of its n-grams is known. A text's score
is the softmax of the mean word score, sharpened by its number of words up to ``sharp``. A run of more than ``BLOCK``
letters is never a vocabulary word: its n-grams are counted and scored over the whole run, in blocks of ``BLOCK`` letters
that count as words in proportion to their length.

Fit: rows with a language that aren't held out; ``docs_per_language`` bounds the sample (an id-hash share of each
language), ``entries`` bounds the model, which is all the driver ever holds. Every language is learned; more than
``most_languages`` raise an error, as each entry has a score for each language.

Defined cases: null texts and texts without a letter give ``und`` and score 0; without any training row all do; texts
with letters but no known n-gram get the first language with a score of 1 / languages; repeated rows agree.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.llm.common import hash_fraction, kernel, slices, train_rows

RUN = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
LONGEST = 5
#: Letters of a run that make one word at most.
BLOCK = 100
#: Starts a block of a longer run; no letter.
PART = "+"
#: Different entries that a counting task holds at most before it passes them on.
HELD = 60_000


def letter_runs(text: str) -> list[str]:
    return [w for w in RUN.findall(text.lower()) if any(map(str.isalpha, w))]


def blocks(word: str) -> list[str]:
    """The blocks of a long run, each marked and with the letters that its last n-grams reach into; a short run itself."""
    if len(word) <= BLOCK:
        return [word]
    edged = f"^{word}$"
    return [PART + edged[at : at + BLOCK + LONGEST - 1] for at in range(0, len(edged), BLOCK)]


def grams(word: str, n: int) -> list[str]:
    if word.startswith(PART):
        part = word[1:]
        found = [part[i : i + n] for i in range(min(BLOCK, len(part) - n + 1))]
        return [g for g in found if g not in "^$"] if n == 1 else found
    if n == 1:
        return list(word)
    edged = f"^{word}$"
    return [edged[i : i + n] for i in range(len(edged) - n + 1)]


def flushed(seen: Counter, *names: str):
    """Batches of the counter's entries, whose keys are tuples; it is empty afterwards."""
    rows = iter(seen.items())
    while part := list(islice(rows, 10_000)):
        keys = [pa.array(x, pa.int32() if name == "n" else pa.string()) for name, x in zip(names, zip(*(k for k, _ in part)))]
        yield pa.RecordBatch.from_arrays([*keys, pa.array([c for _, c in part], pa.int64())], names=[*names, "c"])
    seen.clear()


def count_words(batches):
    """lang, word, c; flushed now and then, so that memory is bounded."""
    seen: Counter = Counter()
    for b in slices(batches, 64):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for word, c in Counter(letter_runs(text)).items():
                for part in blocks(word):
                    seen[lang, part] += c
            if len(seen) > HELD:
                yield from flushed(seen, "lang", "word")
    yield from flushed(seen, "lang", "word")


def count_grams(batches):
    """lang, n, gram, c."""
    seen: Counter = Counter()
    for b in slices(batches, 4096):
        for lang, word, c in zip(*(b.column(k).to_pylist() for k in range(3))):
            for n in range(1, LONGEST + 1):
                for g in grams(word, n):
                    seen[lang, n, g] += c
            if len(seen) > HELD:
                yield from flushed(seen, "lang", "n", "gram")
    yield from flushed(seen, "lang", "n", "gram")


class Model:
    """langs; table: a row of scores for each entry, log-probabilities normalised over the languages; words and grams:
    entry -> its row."""

    def __init__(self, langs: list[str], words: list[tuple], gram_rows: list[tuple], smooth: float = 0.5):
        self.langs = langs
        at = {x: k for k, x in enumerate(langs)}
        self.words: dict[str, int] = {}
        self.grams: dict[str, int] = {}
        tables = [np.zeros((0, len(langs)), np.float32), self._scores(self.words, [(lang, word, c) for lang, word, c in words], at, smooth, 0)]
        for n in range(1, LONGEST + 1):
            tables.append(self._scores(self.grams, [(lang, g, c) for lang, m, g, c in gram_rows if m == n], at, smooth, sum(map(len, tables))))
        self.table = np.concatenate(tables)

    @staticmethod
    def _scores(into: dict[str, int], rows: list[tuple], at: dict[str, int], smooth: float, first: int) -> np.ndarray:
        """The scores of the rows' entries, whose numbers go on from ``first``."""
        names = {x: k for k, x in enumerate(dict.fromkeys(x for _, x, _ in rows))}
        table = np.full((len(names), len(at)), smooth)
        for lang, x, c in rows:
            table[names[x], at[lang]] += c
        table = np.log(table / np.maximum(table.sum(axis=0), 1))
        top = table.max(axis=1, keepdims=True) if len(names) else table
        into.update({x: first + k for x, k in names.items()})
        return (table - top - np.log(np.exp(table - top).sum(axis=1, keepdims=True))).astype(np.float32)

    def evidence(self, part: str) -> list[int]:
        """The rows of a known word, or of the known n-grams of the largest n that has any."""
        known = self.words.get(part)
        if known is not None:
            return [known]
        get = self.grams.get
        for n in range(LONGEST, 0, -1):
            if found := [r for g in grams(part, n) if (r := get(g)) is not None]:
                return found
        return []

    def run(self, word: str) -> tuple[np.ndarray, float]:
        """A letter run's scores and weight: 1 for a word; a long run's blocks count by their letters."""
        total, letters = np.zeros(len(self.langs), np.float32), 0
        for part in blocks(word):
            found, size = self.evidence(part), len(grams(part, 1))
            if found:
                total += self.table[found].mean(axis=0) * size
            letters += size
        weight = max(1.0, len(word) / BLOCK)
        return total / letters * weight, weight


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 1500, entries: int = 200_000, most_languages: int = 500) -> Model:
    rows = train_rows(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")))
    rows = rows.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    per = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(most_languages + 1).collect()
    if len(per) > most_languages:
        raise ValueError(f"more than {most_languages} languages to learn; raise most_languages or correct {lang_col}")
    if not per:
        return Model([], [], [])
    share = F.create_map(*(x for r in per for x in (F.lit(r["lang"]), F.lit(min(1.0, docs_per_language / r["n"])))))
    sample = rows.where(hash_fraction("doc_id", F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)))).select("lang", "text")
    counted = kernel(sample, count_words, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c"))
    counted = counted.persist()
    most = max(100, min(entries, 8_000_000 // len(per)) // (2 * len(per)))  # each entry has a score for each language

    def top(counts: DataFrame, keys: list[str], name: str, n: int) -> list[tuple]:
        best = Window.partitionBy(*keys).orderBy(F.desc("c"), name)
        return [tuple(r) for r in counts.withColumn("k", F.row_number().over(best)).where(F.col("k") <= n).drop("k").collect()]

    words = top(counted.where((F.length("word") <= BLOCK) & ~F.col("word").startswith(PART)).select("lang", "word", "c"), ["lang"], "word", most)
    gram_counts = kernel(counted, count_grams, "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    gram_rows = top(gram_counts.select("lang", "n", "gram", "c"), ["lang", "n"], "gram", max(50, most // LONGEST))
    counted.unpersist()
    langs = sorted({r[0] for r in words} | {r[0] for r in gram_rows})
    return Model(langs, words, gram_rows)


class Scorer:
    """Scores texts; the vectors of recent tokens are kept, ``room`` of them at most."""

    def __init__(self, model: Model, sharp: int = 30, room: int = 150_000):
        self.model, self.sharp, self.room = model, sharp, min(room, 20_000_000 // (len(model.langs) + 1))
        self.at: dict[str, int] = {}
        self.table = np.zeros((self.room, len(model.langs) + 1), np.float32)

    def learn(self, tokens: list[str]) -> None:
        """Makes the rows of tokens not held yet: the sums of their runs' scores, and of the runs' weights."""
        first, evidence, of, size = len(self.at), [], [], []
        self.table[first : first + len(tokens)] = 0
        for k, token in enumerate(tokens, first):
            self.at[token] = k
            runs = (token,) if token.isalpha() else letter_runs(token)
            if len(runs) == 1 and len(runs[0]) <= BLOCK:
                self.table[k, -1] = 1
                if found := self.model.evidence(runs[0]):
                    evidence += found
                    of.append(k)
                    size.append(len(found))
            else:
                for scores, weight in map(self.model.run, runs):
                    self.table[k, :-1] += scores
                    self.table[k, -1] += weight
        if of:
            starts = np.cumsum(size) - size
            self.table[of, :-1] = np.add.reduceat(self.model.table[evidence], starts, axis=0) / np.array(size, np.float32)[:, None]

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.model.langs:
            return UNKNOWN, 0.0
        counts = list(Counter(text.lower().split()).items())
        total = np.zeros(len(self.model.langs) + 1)
        for first in range(0, len(counts), self.room // 3):
            part = counts[first : first + self.room // 3]
            if len(self.at) + len(part) > self.room:
                self.at.clear()
            at = self.at
            if new := [t for t, _ in part if t not in at]:
                self.learn(new)
            rows = [at[t] for t, _ in part]
            total += np.array([c for _, c in part], np.float64) @ self.table[rows].astype(np.float64)
        n = total[-1]
        if not n:
            return UNKNOWN, 0.0
        logits = total[:-1] / n * min(n, self.sharp)
        best = int(np.argmax(logits))
        return self.model.langs[best], float(1 / np.exp(logits - logits[best]).sum())


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each input row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for b in slices(batches):
            found = [scorer(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = train_rows(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return kernel(rows.select("doc_id", "held_out", "text"), run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(df: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of df whose language the model can tell: not ``und`` and a score of ``least`` or more."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches):
        scorer = Scorer(shared.value)
        for b in slices(batches):
            found = [scorer(t) for t in b.column(at).to_pylist()]
            keep = pa.array([x != UNKNOWN and s >= least for x, s in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in b.columns], schema=b.schema)

    return kernel(df, run, df.schema)

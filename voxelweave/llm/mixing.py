"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents are shuffled by a hash and laid end to end; this stream of words, continued with a second and
differently shuffled round, is cut into blocks of ``block`` words. Slot t of the schedule has the golden-ratio point
frac((t + 1) * phi), which the cumulative target weights map to a source; the r-th slot of a source takes its block r.
Targets: sources in code point order (null last) weigh 5, 2, 1, repeating; they share ``share`` times all words, none
above ``cap`` times its own size, the excess being dealt out anew by weight.

Ranks and stream positions are prefix sums of two levels (bucket totals, then rows in a bucket; buckets by the shuffling
hash's first digits, as many as the table's size asks for), so that no source, a hot one included, has to pass through one
task as a whole.

Defined cases: null text has size 0 and is never taken; a table without words gives targets of 0; null sources form one
group, repeated rows are mixed as rows of their own; a very long text is one row of its stream, cut into as many blocks as
it fills; other columns are left alone, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.llm.common import fresh, materialise

WEIGHTS = (5, 2, 1)
SHARE, CAP, BLOCK = 1.5, 2, 128
#: Rows aimed at in a bucket of a source's stream.
PER_BUCKET = 8192
#: frac(golden ratio) and frac(2**20 * golden ratio), for points that keep their precision for any t.
PHI, PHI_HIGH = 0.6180339887498949, (0.6180339887498949 * (1 << 20)) % 1.0


def sizes(df: DataFrame, text_col: str = "text"):
    """Number of words; splitting at runs of the six characters leaves one empty string at each end at most."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def targets(df: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target. df: source, size. One row for each source, so single-task windows are small.

    Source k in the order of limit / weight is capped if the level that all uncapped sources would get exceeds its
    limit; the levels come from running sums, which gives the same fixed point as resharing round by round.
    """
    by = df.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    by = by.withColumn("n", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int")))
    by = by.withColumn("limit", F.lit(float(cap)) * F.col("source_size")).withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
    below = Window.orderBy(F.col("limit") / F.col("weight"), "n").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("gone", F.coalesce(F.sum("limit").over(below), F.lit(0.0))).withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    by = by.withColumn("level", (F.col("total") - F.col("gone")) / F.col("left")).withColumn("capped", F.col("level") * F.col("weight") >= F.col("limit"))
    by = by.withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything))
    by = by.withColumn("target", F.when(F.col("capped"), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("level") * F.col("weight"))))
    return by.select("source", "n", "source_size", "target")


def schedule(by_source: DataFrame, block: int = BLOCK, chunk: int = 1 << 16) -> DataFrame:
    """n (source number), slot, block: which block each slot takes. by_source: n, target."""
    spark = by_source.sparkSession
    total = by_source.agg(F.sum("target")).first()[0] or 0.0
    slots = int(round(total / block))
    cumulative = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    ranges = by_source.where("target > 0").withColumn("high", F.sum("target").over(cumulative) / F.lit(total or 1.0)).withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("n")), F.lit(0.0)))
    last = Window.partitionBy(F.lit(0))
    ranges = ranges.withColumn("high", F.when(F.col("n") == F.max("n").over(last), F.lit(2.0)).otherwise(F.col("high")))
    # a source's range is cut at cells of 1/CELLS, so that slots find theirs by an equi-join
    cells = 4096
    ranges = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.lit(cells), F.floor(F.col("high") * cells))))).select("n", "low", "high", "cell")
    t = F.col("id") + 1
    low_bits, high_bits = (t % F.lit(1 << 20)).cast("double"), F.floor(t / F.lit(float(1 << 20))).cast("double")
    point = (low_bits * F.lit(PHI) + high_bits * F.lit(PHI_HIGH)) % F.lit(1.0)
    picked = spark.range(slots).select(F.col("id").alias("slot"), point.alias("u")).withColumn("cell", F.floor(F.col("u") * cells))
    picked = picked.join(ranges, "cell").where("u >= low and u < high").select("slot", "n", F.floor(F.col("slot") / F.lit(float(chunk))).alias("chunk"))
    counts = picked.groupBy("n", "chunk").agg(F.count("*").alias("c"))
    before = Window.partitionBy("n").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("n", "chunk", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("n", "chunk").orderBy("slot")
    ranked = picked.withColumn("k", F.row_number().over(inside) - 1)
    return ranked.join(counts, ["n", "chunk"]).select("n", "slot", (F.col("first") + F.col("k")).alias("block"))


def stream(rows: DataFrame, rounds: int, seed: str) -> DataFrame:
    """Adds round and start: where the row's words begin in its source's stream. rows: n, doc_id, size, text_key."""
    count = rows.count()
    rows = rows.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    rows = rows.withColumn("mixed", F.md5(F.concat_ws("/", F.lit(seed), F.col("round").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    digits = max(2, math.ceil(math.log(max(1, count) / PER_BUCKET, 16)))  # so a bucket's size doesn't grow with the table
    rows = rows.withColumn("bucket", F.substring("mixed", 1, digits))
    totals = rows.groupBy("n", "round", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("n").orderBy("round", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("n", "round", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("n", "round", "bucket").orderBy("mixed", "doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(totals, ["n", "round", "bucket"]).withColumn("start", F.col("base") + F.col("offset"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken: one row for each input row."""
    lean = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), sizes(df, text_col).alias("size"))
    lean = lean.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
    lean = materialise(lean, "mix-sizes", df)
    by = materialise(targets(lean, weights, share, cap), "mix-targets", df, light=True)
    rows = lean.join(by, lean["source"].eqNullSafe(by["source"])).select("n", "doc_id", "size", "copy", "source_size", "target")
    slots = schedule(by, block).groupBy("n", "block").agg(F.count("*").alias("times"))
    laid = stream(rows.where("size > 0"), int(cap), seed)
    pieces = laid.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / F.lit(float(block))), F.floor((F.col("start") + F.col("size") - 1) / F.lit(float(block))))))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    taken = pieces.select("n", "block", "doc_id", "size", "copy", words.alias("words")).join(slots, ["n", "block"]).groupBy("n", "doc_id", "size", "copy").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    out = rows.alias("r").join(taken.alias("t"), F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("r.n") == F.col("t.n")) & (F.col("r.size") == F.col("t.size")) & (F.col("r.copy") == F.col("t.copy")), "left")
    return out.select("r.doc_id", "r.size", "r.source_size", "r.target", F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken"))


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """df's rows as often as the mix takes them: taken / size, rounded; df's own columns.

    Blocks cut the stream between two documents at its end alone, so all but one document of each source and round are
    taken as a whole or not at all, and rounding moves a source's words by about one document.
    """
    doc_id, size, many, words, copy = fresh(df, "taken_id", "taken_size", "times", "words", "copy")
    taken = mix(df, id_col, text_col, source_col, **settings)
    times = taken.where("size > 0").groupBy(F.col("doc_id").alias(doc_id), F.col("size").alias(size)).agg(F.max(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias(many)).where(F.col(many) > 0)
    rows = df.withColumn(words, sizes(df, text_col))
    joined = rows.join(times, F.col(id_col).eqNullSafe(F.col(doc_id)) & (F.col(words) == F.col(size)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(many)))).select(*df.columns)

"""Parameter files: `key = value` lines with # comments."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLANKS = " \t\r\n"
TRUE, FALSE = ("true", "1", "yes", "on"), ("false", "0", "no", "off")


def trim(s: str) -> str:
    return s.strip(BLANKS)


def trim_column(c):
    """Spark's trim takes spaces only."""
    return F.btrim(c, F.lit(BLANKS))


@dataclass
class Params:
    """Typed access; a missing key raises KeyError, an unreadable value ValueError."""

    values: dict[str, str] = field(default_factory=dict)

    def get(self, key: str) -> str:
        if key not in self.values:
            raise KeyError(f"parameter {key} is missing")
        return self.values[key]

    def _number(self, key: str, pattern: str, kind):
        m = re.match(pattern, self.get(key))  # what trails the number is passed over
        if not m:
            raise ValueError(f"parameter {key}: {self.values[key]!r}")
        return kind(m[0])

    def get_int(self, key: str) -> int:
        return self._number(key, r"\s*[+-]?\d+", int)

    def get_double(self, key: str) -> float:
        return self._number(key, r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", float)

    def get_bool(self, key: str) -> bool:
        value = self.get(key).lower()
        if value in TRUE:
            return True
        if value in FALSE:
            return False
        raise ValueError(f"parameter {key}: {value!r}")


def parse_lines(lines) -> Params:
    out = {}
    for line in lines:
        line = trim(line)
        if not line or line.startswith("#") or "=" not in line:
            continue
        key, value = line.split("=", 1)
        out[trim(key)] = trim(value.split("#", 1)[0])
    return Params(out)


def load_params(path: str) -> Params:
    with open(path) as f:
        return parse_lines(f)


def parse_frame(lines: DataFrame, line_col: str = "value", order_col: str = "line_no") -> DataFrame:
    """The same rules over a table of lines: key, value; of a repeated key the last line counts."""
    s = trim_column(F.col(line_col))
    rows = lines.select(F.col(order_col).alias("n"), s.alias("s")).where((F.col("s") != "") & ~F.col("s").startswith("#") & F.contains("s", F.lit("=")))
    at = F.instr("s", "=")
    rows = rows.select("n", trim_column(F.substring("s", F.lit(1), at - 1)).alias("key"), trim_column(F.split_part(F.substring("s", at + 1, F.length("s")), F.lit("#"), F.lit(1))).alias("value"))
    last = Window.partitionBy("key").orderBy(F.desc("n"))
    return rows.withColumn("r", F.row_number().over(last)).where("r = 1").select("key", "value")


def read_params(spark: SparkSession, path: str) -> Params:
    """Through Spark's reader, for paths in a store. Parameter files are small, so their lines come to the driver."""
    return parse_lines(r["value"] for r in spark.read.text(path).collect())

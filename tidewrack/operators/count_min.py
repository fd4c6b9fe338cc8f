"""Count-min sketches as sparse relations (``row``, ``cell``, ``cnt``).

A sketch is linear, so it is built from the term frequencies: one tokenization
serves every width and depth. Merging sketches is a union and a sum.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.hashing import sketch_cell

# Default size of a sketch and the number of terms its error is measured on.
WIDTH = 20_000
DEPTH = 7
EVALUATED_TERMS = 5_000


def _rows(depth: int):
    return F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("row")


@dataclass
class CountMin:
    """A sketch; ``cells`` holds its non-zero counters."""

    cells: DataFrame
    width: int
    depth: int
    family: str = "md5"

    @classmethod
    def build(cls, tf: DataFrame, width: int = WIDTH, depth: int = DEPTH, family: str = "md5", term: str = "term", count: str = "tf") -> "CountMin":
        """Adds ``count`` for each ``term`` to one cell in every row; null terms are left out."""
        if width < 1 or depth < 1:
            raise ValueError("width and depth must be positive")
        spread = tf.where(F.col(term).isNotNull()).select(F.col(term).alias("term"), F.col(count).alias("n"), _rows(depth))
        cells = spread.select("row", sketch_cell(F.col("row"), F.col("term"), width, family).alias("cell"), "n").groupBy("row", "cell").agg(F.sum("n").alias("cnt"))
        return cls(cells, width, depth, family)

    def update(self, tf: DataFrame) -> "CountMin":
        """The sketch after further updates (``term``, ``tf``)."""
        return self.merge(CountMin.build(tf, self.width, self.depth, self.family))

    def merge(self, other: "CountMin") -> "CountMin":
        if (self.width, self.depth, self.family) != (other.width, other.depth, other.family):
            raise ValueError("sketches of different shape")
        both = self.cells.unionByName(other.cells).groupBy("row", "cell").agg(F.sum("cnt").alias("cnt"))
        return CountMin(both, self.width, self.depth, self.family)

    def estimate(self, terms: DataFrame, term: str = "term") -> DataFrame:
        """``terms`` with ``estimate``: the least counter of each term's cells (0 for an empty cell)."""
        asked = terms.select(F.col(term).alias("term")).distinct().select("term", _rows(self.depth))
        asked = asked.select("term", "row", sketch_cell(F.col("row"), F.col("term"), self.width, self.family).alias("cell"))
        least = asked.join(self.cells, ["row", "cell"], "left").groupBy("term").agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))
        return terms.join(least.withColumnRenamed("term", term), term)

    def lookup(self, terms: list[str]) -> DataFrame:
        spark = self.cells.sparkSession
        return self.estimate(spark.createDataFrame([(t.lower(),) for t in terms], "term string").distinct())

    def total_updates(self) -> DataFrame:
        """One row, ``total_updates``: every update is in row 0 once."""
        return self.cells.where("row = 0").agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_updates"))

    def save(self, path: str) -> None:
        """Cells as parquet, shape beside them."""
        self.cells.write.mode("overwrite").parquet(f"{path}/cells")
        shape = [(self.width, self.depth, self.family)]
        self.cells.sparkSession.createDataFrame(shape, "width int, depth int, family string").coalesce(1).write.mode("overwrite").json(f"{path}/shape")

    @classmethod
    def load(cls, spark, path: str) -> "CountMin":
        s = spark.read.json(f"{path}/shape").first()
        return cls(spark.read.parquet(f"{path}/cells"), int(s["width"]), int(s["depth"]), s["family"])

    def to_json(self) -> str:
        """The dense form ``{width, depth, tables, total_updates}`` (a driver-side export of bounded size)."""
        tables = [[0] * self.width for _ in range(self.depth)]
        for r in self.cells.toLocalIterator():
            tables[r["row"]][r["cell"]] = int(r["cnt"])
        return json.dumps({"width": self.width, "depth": self.depth, "tables": tables, "total_updates": sum(tables[0])})

    @classmethod
    def from_json(cls, spark, text: str, family: str = "xxh64") -> "CountMin":
        data = json.loads(text)
        cells = [(i, j, n) for i, row in enumerate(data["tables"]) for j, n in enumerate(row) if n]
        return cls(spark.createDataFrame(cells, "row int, cell bigint, cnt bigint"), data["width"], data["depth"], family)


def estimates_by_config(tf: DataFrame, top: DataFrame, configs: list[tuple[int, int]]) -> DataFrame:
    """(``width``, ``depth``, ``term``, ``tf``, ``estimate``, ``error``) of the terms ``top`` under each configuration.

    All configurations are one plan: a cell's hash is computed once a (term, row)
    and taken modulo each width. The table of configurations holds a few rows and is written into the expression.
    """
    from tidewrack.functions.hashing import md5_number

    deepest = max(d for _, d in configs)
    options = F.array(*[F.struct(F.lit(w).alias("width"), F.lit(d).alias("depth")) for w, d in configs])

    def located(df: DataFrame) -> DataFrame:
        hashed = df.select("term", "tf", _rows(deepest)).withColumn("h", md5_number(F.concat(F.col("row").cast("string"), F.col("term"))))
        each = hashed.withColumn("c", F.explode(F.filter(options, lambda c: c["depth"] > F.col("row"))))
        return each.select("term", "tf", "row", F.col("c.width").alias("width"), F.col("c.depth").alias("depth"), (F.col("h") % F.col("c.width")).alias("cell"))

    cells = located(tf).groupBy("width", "depth", "row", "cell").agg(F.sum("tf").alias("cnt"))
    least = located(top).join(cells, ["width", "depth", "row", "cell"]).groupBy("width", "depth", "term").agg(F.max("tf").alias("tf"), F.min("cnt").alias("estimate"))
    return least.withColumn("error", F.col("estimate") - F.col("tf"))


def error_summary(estimates: DataFrame) -> DataFrame:
    """By configuration: ``avg_error``, ``max_error``, ``wrong_terms`` (those with an error above zero)."""
    return estimates.groupBy("width", "depth").agg(F.round(F.avg("error"), 6).alias("avg_error"), F.max("error").alias("max_error"), F.sum((F.col("error") > 0).cast("bigint")).alias("wrong_terms"))


def error_histogram(errors: DataFrame, column: str = "error", bins: int = 60) -> DataFrame:
    """(``bin``, ``n``): equal bins from the least to the largest value, the last one closed.

    If all values are equal, the range is widened by a half to either side.
    """
    ends = errors.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    if ends["a"] is None:
        return errors.select(F.lit(0).cast("bigint").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    a, b = float(ends["a"]), float(ends["b"])
    if a == b:
        a, b = a - 0.5, b + 0.5
    placed = errors.where(F.col(column).isNotNull()).withColumn("bin", F.least(F.floor((F.col(column) - a) * bins / (b - a)), F.lit(bins - 1)))
    return placed.groupBy("bin").agg(F.count("*").alias("n"))

"""Most frequent word runs: exact, and with bounded memory by a sketch that is counted again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions import text as X


def grams_of(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """(gram): the runs of ``n`` words of each column; none crosses a column's end."""
    if n < 1 or not columns:
        raise ValueError("n must be positive and a column be given")
    return df.select(F.explode(F.array(*columns)).alias("field")).select(F.explode(X.ngrams("field", n)).alias("gram"))


def heavy_exact(df: DataFrame, columns: list[str], n: int, top: int) -> DataFrame:
    """(gram, n): the ``top`` most frequent runs; ties by gram."""
    return grams_of(df, columns, n).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gram").limit(top)


def heavy_sketch(df: DataFrame, columns: list[str], n: int, top: int, counters: int = 10_000) -> DataFrame:
    """The same with at most ``counters`` counters a task: all runs that a frequency sketch still holds are counted exactly in a second pass."""
    grams = grams_of(df, columns, n)
    found = grams.agg(F.expr(f"approx_top_k(gram, {max(counters, top)}, {max(counters, top)})").alias("k")).select(F.explode("k").alias("c")).select(F.col("c.item").alias("gram"))
    return grams.join(F.broadcast(found), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gram").limit(top)

"""Sequential rules over ordered rows: streamed folds, and running totals without a window over everything."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def streamed_fold(rows: DataFrame, key: str, order: list[str], fold: Callable[[], Callable], schema: str) -> DataFrame:
    """Each key's rows in order through a fresh fold(): a function of one row that returns the rows which that row gives.

    fold().end, if there, gives the key's last rows. Rows stream; a key costs its own rows and the state of one fold, whatever its length.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.strip().split()[0] for f in schema.split(",")]
        last, step, out = None, None, []

        def finish() -> list:
            return list(step.end()) if step is not None and hasattr(step, "end") else []

        for frame in frames:
            for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False):
                value = getattr(row, key)
                if step is None or value != last:
                    out += finish()
                    last, step = value, fold()
                out += step(row)
            yield pd.DataFrame(out, columns=names)
            out = []
        yield pd.DataFrame(finish(), columns=names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def running_total(rows: DataFrame, at: str, value: str, fan: int = 4096) -> DataFrame:
    """rows with `before`: the sum of value over rows of smaller `at`, a unique integer. Blocks of blocks: no window holds more than a block's rows
    or one row for fan * fan consecutive numbers."""
    first, second = F.floor(F.col(at) / fan), F.floor(F.col(at) / (fan * fan))
    upto = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    named = rows.withColumn("__block", first).withColumn("__range", second)
    blocks = named.groupBy("__block", "__range").agg(F.sum(value).alias(value))
    ranges = blocks.groupBy("__range").agg(F.sum(value).alias(value)).select("__range", upto(Window.orderBy("__range")).alias("__of_ranges"))
    blocks = blocks.select("__block", "__range", upto(Window.partitionBy("__range").orderBy("__block")).alias("__of_blocks"))
    own = named.withColumn("__own", upto(Window.partitionBy("__block").orderBy(at)))
    return own.join(blocks, ["__block", "__range"]).join(ranges, "__range").withColumn("before", F.col("__own") + F.col("__of_blocks") + F.col("__of_ranges")).drop(
        "__own", "__block", "__range", "__of_blocks", "__of_ranges"
    )

"""Table functions for SQL: intervals and simulated pixels."""

from __future__ import annotations

import math
import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class Intervals:
    """Rows of a comma-joined list of intervals; what isn't an interval is left out."""

    def eval(self, text: str):
        for part in (text or "").split(","):
            if m := re.fullmatch(r"([^:\-]+)[:\-](\d+)-(\d+)", part.strip()):
                yield m[1], int(m[2]), int(m[3]), (int(m[2]) + int(m[3])) // 2


class Blob:
    """Pixels of a Gaussian spot on a grid of unit coordinates."""

    def eval(self, rows: int, cols: int, x0: float, y0: float, sigma: float):
        x0, y0, sigma = float(x0), float(y0), float(sigma)  # SQL literals come as decimals
        for i in range(rows):
            for j in range(cols):
                x, y = j / max(cols - 1, 1), i / max(rows - 1, 1)
                yield i, j, math.exp(-((x - x0) ** 2 + (y - y0) ** 2) / (2 * sigma * sigma))


def register(spark: SparkSession) -> None:
    """Makes ``parse_intervals(text)`` and ``blob(rows, cols, x0, y0, sigma)`` known to the session's SQL."""
    spark.udtf.register("parse_intervals", udtf(Intervals, returnType="chrom string, start long, end long, center long"))
    spark.udtf.register("blob", udtf(Blob, returnType="row int, col int, value double"))

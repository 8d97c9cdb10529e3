"""Small results as text: Markdown and LaTeX tables, and tables scraped from LaTeX."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def markdown(df: DataFrame, order: list[str], rows: int = 1000) -> str:
    """A Markdown table of a small result (at most so many rows, or an error)."""
    found = df.orderBy(*order).limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"more than {rows} rows are not a report")
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return head + "".join("\n| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found)


def latex(df: DataFrame, order: list[str], rows: int = 1000) -> str:
    found = df.orderBy(*order).limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"more than {rows} rows are not a report")
    line = lambda cells: " & ".join("" if c is None else str(c) for c in cells) + r" \\"
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", line(df.columns), r"\hline", *map(line, found), r"\end{tabular}"])


def latex_cell(cell: Column) -> tuple[Column, Column, Column]:
    """Mean and deviation of `$12.34 \\pm 0.56$` cells, and k of `k/3` cells."""
    number = lambda pattern, i: F.nullif(F.regexp_extract(cell, pattern, i), F.lit(""))
    spread = r"([+-]?\d+\.\d+)\s*\\pm\s*(\d+\.\d+)"
    return number(spread, 1).cast("double"), number(spread, 2).cast("double"), number(r"(\d+)/3", 1).cast("int")

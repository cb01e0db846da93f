"""Text artifacts from small aggregates: CSV and Markdown lines, HTML rows, prompts from templates.

Everything is a column expression over rows that are already aggregated; a sink writes the lines in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def csv_line(*cols: str) -> Column:
    """Quoted where it has to be."""
    cell = lambda c: F.when(text(c).rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text(c))
    return F.concat_ws(",", *[cell(c) for c in cols])


def markdown_line(*cols: str) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(text(c), F.lit("|"), F.lit("\\|")) for c in cols]), F.lit(" |"))


def html_row(*cols: str) -> Column:
    safe = lambda c: F.replace(F.replace(F.replace(text(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), safe(c), F.lit("</td>")) for c in cols], F.lit("</tr>"))


def filled(template: str, **values: Column) -> Column:
    """A template's ``{name}`` places filled with columns; NULL and empty values become (none)."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit("(none)")))
    return out


def document(lines: DataFrame, order: list[str], line: str, head: list[str]) -> DataFrame:
    """One row with the whole text: for reports of bounded length only."""
    sorted_ = F.array_sort(F.collect_list(F.struct(*order, line)))
    body = F.array_join(F.transform(sorted_, lambda x: x[line]), "\n")
    return lines.agg(F.concat_ws("\n", *[F.lit(h) for h in head], body).alias("document"))

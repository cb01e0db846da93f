"""Sheets as long grids (sheet, row, col, value): islands, header detection, blocks, ranges, and evidence rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import non_blank, strip

BLOCK_ROWS = 30
# Words of total rows, and the form of numbers, percentages and amounts.
TOTALS = "总计|合计|小计|汇总|总成本|总费用|总金额|小合计|total|subtotal|grand total|sum"
NUMBER = r"^[-+]?[¥$€]?\s*\d[\d,]*(?:\.\d+)?\s*(?:%|元|万元)?$"


def is_number(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(NUMBER), F.lit(False))


def cells(lines: DataFrame, sheet: str, text: str, joint: str = r"\|") -> DataFrame:
    """Delimited lines of a text as a grid; rows and columns count from 1, blank cells are NULL."""
    rows = lines.where(F.col(text).isNotNull()).select(F.col(sheet).alias("sheet"), F.posexplode(F.split(text, "\n")).alias("r", "line")).where(F.col("line").rlike(joint))
    out = rows.select("sheet", (F.col("r") + 1).alias("row"), F.posexplode(F.split("line", joint)).alias("c", "value"))
    return out.select("sheet", "row", (F.col("c") + 1).alias("col"), non_blank("value").alias("value"))


def row_profile(grid: DataFrame) -> DataFrame:
    """Per row: filled cells, numeric cells, and whether it is a total row (a key word in its first filled cell, or nothing but numbers)."""
    filled, number = F.col("value").isNotNull(), is_number(F.col("value"))
    first = F.min(F.when(filled, F.struct("col", "value")))["value"]
    p = grid.groupBy("sheet", "row").agg(F.count_if(filled).cast("int").alias("n_filled"), F.count_if(number).cast("int").alias("n_numeric"), F.coalesce(F.lower(first).rlike(TOTALS), F.lit(False)).alias("has_total"))
    return p.withColumn("is_summary", F.col("has_total") | ((F.col("n_filled") > 0) & (F.col("n_filled") == F.col("n_numeric"))))


def islands(grid: DataFrame) -> DataFrame:
    """Maximal runs of filled columns in each row (gaps and islands)."""
    filled = grid.where("value is not null")
    key = F.col("col") - F.row_number().over(Window.partitionBy("sheet", "row").orderBy("col"))
    return filled.withColumn("k", key).groupBy("sheet", "row", "k").agg(F.min("col").alias("first_col"), F.max("col").alias("last_col"), F.count_if(is_number(F.col("value"))).cast("int").alias("n_numeric")).drop("k")


def header_rows(grid: DataFrame) -> DataFrame:
    """The first row of a sheet without numbers, and the row after it (where the data begin)."""
    p = row_profile(grid).where("n_filled > 1 and n_numeric = 0").groupBy("sheet").agg(F.min("row").alias("header_row"))
    return p.withColumn("data_start", F.col("header_row") + 1)


def anchors(grid: DataFrame) -> DataFrame:
    """Every cell as a candidate for a question: (sheet, row, col, value, label, reason), reason NULL where it may be asked for.

    The checks run in this order: empty, no_header (the sheet has no header row), above_data, summary_row, no_label (nothing stands in
    the header above it), aggregate_label (the header itself speaks of a total).
    """
    h = header_rows(grid)
    heads = grid.join(h.select("sheet", F.col("header_row").alias("row")), ["sheet", "row"], "left_semi").select("sheet", "col", F.col("value").alias("label"))
    g = grid.join(h, "sheet", "left").join(row_profile(grid).select("sheet", "row", "is_summary"), ["sheet", "row"]).join(heads, ["sheet", "col"], "left")
    reason = (
        F.when(F.col("value").isNull(), "empty").when(F.col("data_start").isNull(), "no_header").when(F.col("row") < F.col("data_start"), "above_data")
        .when(F.col("is_summary"), "summary_row").when(F.col("label").isNull(), "no_label").when(F.lower("label").rlike(TOTALS), "aggregate_label")
    )
    return g.select("sheet", "row", "col", "value", "label", reason.alias("reason"))


def value_pairs(grid: DataFrame) -> DataFrame:
    """A row of labels directly above a row of values, matched by adjacency."""
    w = Window.partitionBy("sheet").orderBy("row")
    p = row_profile(grid).withColumns({"next_row": F.lead("row").over(w), "next_numeric": F.lead("n_numeric").over(w)})
    return p.where("n_numeric = 0 and next_row = row + 1 and next_numeric > 0").select("sheet", F.col("row").alias("label_row"), F.col("next_row").alias("value_row"))


def blocks(grid: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Data rows cut into blocks of a fixed height (the first row is the header)."""
    return grid.groupBy("sheet", "row").agg(F.count("value").alias("n")).where("row >= 2").groupBy("sheet", F.floor((F.col("row") - 2) / rows).alias("block")).agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.sum("n").alias("n_cells"))


def block_markdown(grid: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """One Markdown text per (sheet, block) with the blocks of ``blocks``; the first row of a sheet, its header, stands above each.

    A sheet of nothing but its first row is one block.
    """
    cells_ = F.array_sort(F.collect_list(F.struct("col", F.coalesce("value", F.lit("")).alias("v"))))  # as many as a row has columns
    line = F.concat(F.lit("| "), F.array_join(F.transform(cells_, lambda x: x["v"]), " | "), F.lit(" |"))
    lines = grid.groupBy("sheet", "row").agg(line.alias("line"))
    block = F.greatest(F.floor((F.col("row") - 2) / rows), F.lit(0)).cast("bigint")
    body = F.array_sort(F.collect_list(F.when(F.col("row") >= 2, F.struct("row", "line"))))  # as many as a block has rows
    cut = lines.groupBy("sheet", block.alias("block")).agg(F.transform(body, lambda x: x["line"]).alias("body"))
    heads = lines.where("row = 1").select("sheet", F.col("line").alias("head"))
    return cut.join(heads, "sheet", "left").select("sheet", "block", F.array_join(F.concat(F.array_compact(F.array("head")), "body"), "\n").alias("markdown"))


def contained(ranges: DataFrame, allowed: DataFrame) -> DataFrame:
    """Ranges that lie within an allowed range of the same sheet and row band.

    The containment runs behind an equi-join on (sheet, row), to which ranges of several rows are exploded, never as a
    product of all ranges.
    """
    one = ranges.withColumn("row", F.explode(F.sequence("min_row", "max_row")))
    hit = one.join(allowed.select("sheet", "row", "first_col", "last_col"), ["sheet", "row"]).where("min_col >= first_col and max_col <= last_col")
    n = hit.select("sheet", "range_id", "row").distinct().groupBy("sheet", "range_id").agg(F.count("*").alias("n_rows"))
    return ranges.join(n, ["sheet", "range_id"], "left").withColumn("inside", F.coalesce(F.col("n_rows") == F.col("max_row") - F.col("min_row") + 1, F.lit(False))).drop("n_rows")


def rendered(grid: DataFrame) -> DataFrame:
    """Rows as ``header：value；...`` under the first header row of their sheet."""
    h = header_rows(grid)
    heads = grid.join(h.select("sheet", F.col("header_row").alias("row")), ["sheet", "row"]).select("sheet", "col", F.col("value").alias("head"))
    body = grid.join(h, "sheet").where("row >= data_start and value is not null").join(heads, ["sheet", "col"], "left")
    cell = F.when(F.col("head").isNull(), F.col("value")).otherwise(F.concat("head", F.lit("："), "value"))
    agg = body.groupBy("sheet", "row").agg(F.array_sort(F.collect_list(F.struct("col", cell.alias("t")))).alias("cells"))  # as many as a row has columns
    return agg.select("sheet", "row", F.array_join(F.transform("cells", lambda x: x["t"]), "；").alias("evidence"))


def column_letters(n: Column) -> Column:
    """1 -> A, 27 -> AA (up to three letters)."""
    letter = lambda x: F.char((x + 65).cast("int"))
    z = n - 1
    return F.when(n <= 26, letter(z)).when(n <= 702, F.concat(letter(F.floor((z - 26) / 26)), letter((z - 26) % 26))).otherwise(F.concat(letter(F.floor((z - 702) / 676)), letter(F.floor((z - 702) / 26) % 26), letter((z - 702) % 26)))


def column_number(letters: Column) -> Column:
    return F.aggregate(F.filter(F.split(F.upper(letters), ""), lambda c: c != ""), F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64)

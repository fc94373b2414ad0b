"""Match pages (K10, K11): a table of results per query as HTML rows, several queries to a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.functions.scalars import border


def match_rows(marked: DataFrame, names: DataFrame, per_page: int = 20) -> DataFrame:
    """(page, query_id, html): one table row of thumbnails per query, in rank order, bordered by verdict.

    marked: (query_id, image_id, rank, mark); names: (image_id, name). Pages hold per_page queries each.
    """
    cells = marked.join(names, "image_id").select("query_id", "rank", F.format_string('<td style="border:3px solid %s"><img src="%s"/></td>', border(F.col("mark")), F.col("name")).alias("cell"))
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cell"))), lambda c: c["cell"]), "")
    rows = cells.groupBy("query_id").agg(F.concat(F.lit("<tr>"), row, F.lit("</tr>")).alias("html"))
    return rows.select(F.floor(F.col("query_id") / per_page).cast("long").alias("page"), "query_id", "html")


def pages(rows: DataFrame) -> DataFrame:
    """(page, html): whole pages with links to the one before and after where there is one."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("query_id", "html"))), lambda r: r["html"]), "\n")
    last = rows.agg(F.max("page").alias("last")).collect()[0]["last"]
    link = lambda k, text: F.when((k >= 0) & (k <= F.lit(last)), F.format_string('<a href="%d.html">%s</a>', k, F.lit(text))).otherwise("")
    nav = F.concat(link(F.col("page") - 1, "previous"), link(F.col("page") + 1, "next"))
    return rows.groupBy("page").agg(body.alias("_b")).select("page", F.concat(F.lit("<html><body><table>"), "_b", F.lit("</table>"), nav, F.lit("</body></html>")).alias("html"))


def write_pages(whole: DataFrame, path: str) -> None:
    """One text file per page folder."""
    whole.select("page", F.col("html").alias("value")).write.partitionBy("page").mode("overwrite").text(path)

"""Site-relative line frequency: lines that most pages of a host share are dropped.

A line counts once per page. It is dropped on a host if two pages or more hold it and these exceed `ratio` of
the host's pages, whatever their number. Counting is by (host, line) with partial sums, so a host
of any size is spread over all tasks. The fractions of a host's lines sum to its mean number of lines
per page, so at most (mean / ratio) lines of a host are dropped: that list is one bounded row per host,
and pages meet it in one join, a host's on as many salts as it has `SALT_PAGES` pages. Lines travel as 96 bits of hashes, never as text.
All of it is SQL.

Nulls: a null or hostless url belongs to no site, all its lines stay; a null page has no lines. Order and
repeats of the lines that stay are kept. Repeated rows count as pages. Empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

RATIO = 0.3
SALT_PAGES = 8192
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
HIDDEN = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
BLOCK = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|"
    r"select|table|tbody|td|th|thead|title|tr|ul)(?:[ \t\r\n/][^>]*)?>"
)
TAG = r"<[a-zA-Z/!?][^>]*>"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def lines_of(html: Column) -> Column:
    """Visible text of a page by line: block tags end lines, other tags vanish, white space is squeezed."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "\n")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK, "\n"), TAG, "")
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t\r]+", " "), r" ?\n[ \n]*", "\n"))
    return F.filter(F.split(text, "\n"), lambda line: line != "")


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def boilerplate(pages: DataFrame, ratio: float = RATIO) -> DataFrame:
    """host, total and dropped (the keys of its boilerplate lines); pages has host and lines."""
    sited = pages.where("host IS NOT NULL")
    totals = sited.groupBy("host").agg(F.count(F.lit(1)).alias("total")).where("total > 1")
    counts = sited.select("host", F.explode(F.array_distinct(F.transform("lines", _key))).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    often = counts.where("n > 1").join(totals, "host").where(F.col("n") > F.col("total") * ratio)
    return often.groupBy("host", "total").agg(F.collect_list("line").alias("dropped"))


def without_boilerplate(pages: DataFrame, ratio: float = RATIO, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", salt_pages: int = SALT_PAGES) -> DataFrame:
    """page_id, host, n_lines, n_dropped, text: the lines that stay."""
    # Lines are found once and written.
    rows = staged(pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), lines_of(F.col(html_col)).alias("lines")), "page-lines")
    lists = staged(boilerplate(rows, ratio).withColumn("salts", F.ceil(F.col("total") / salt_pages).cast("int")), "page-lists")
    # Hosts of several salts are one in `salt_pages` pages at most.
    rows = rows.join(lists.where("salts > 1").select("host", "salts"), "host", "left")
    rows = rows.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("page_id", "lines"), "salts"), F.lit(0)).cast("int"))
    lists = lists.select("host", "dropped", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rows = rows.join(lists, ["host", "salt"], "left")
    kept = F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda line: ~F.array_contains("dropped", _key(line))))
    rows = rows.select("page_id", "host", F.size("lines").cast("bigint").alias("n_lines"), kept.alias("kept"))
    return rows.select("page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))

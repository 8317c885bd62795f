"""Block scoring (O38): a page as a sequence of text blocks with their nesting depth, text and link density.

Comments and boilerplate elements are dropped, the rest is cut into tags and text. A tag that opens or closes a block
element ends the block before it; text in between belongs to one block, and text inside ``<a>`` to its links. Depth is the
number of open block elements; a closing tag without an opening one does not go below zero. So with S the running sum of
+1 and -1 over a page's tags, depth is S less its lowest value so far (if below zero), which windows over a page's tokens
give without a state machine. Everything is DataFrame functions; a page's tokens meet in one task, bounded by the
contract's page size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .extract import DROP_STEPS, unescape

#: Elements that hold blocks of text.
BLOCK_TAGS = ["address", "article", "blockquote", "body", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2",
              "h3", "h4", "h5", "h6", "html", "li", "main", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th",
              "thead", "tr", "ul"]
TOKEN_PATTERN = r"<[^>]*>|[^<]+|<"
NAME_PATTERN = r"^</?([a-zA-Z][a-zA-Z0-9]*)"
HEAD_PATTERN = r"(?is)<head(?:\s[^>]*)?>.*?</head\s*>"
#: A block is content from so many characters outside links on, if links are at most half of it.
LEAST_TEXT = 25


def page_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per block with text: the id, ``block_no`` (in page order, from 0; blocks without text are counted), ``depth``,
    ``text``, ``n_chars``, ``link_chars`` and ``content``. NULL html: no rows. Pages go by their id: rows of equal id would mix,
    so ids are to be unique."""
    html = F.regexp_replace(F.col(html_col), HEAD_PATTERN, " ")
    for pattern, with_ in DROP_STEPS:
        html = F.regexp_replace(html, pattern, with_)
    tokens = pages.select(F.col(id_col).alias("id"),
                          F.posexplode(F.regexp_extract_all(html, F.lit(f"({TOKEN_PATTERN})"), 1)).alias("pos", "token"))
    tag = F.col("token").startswith("<") & F.col("token").endswith(">")
    name = F.when(tag, F.lower(F.regexp_extract("token", NAME_PATTERN, 1)))
    tokens = tokens.select("*", name.alias("name"), F.col("token").startswith("</").alias("closes"))
    block = F.col("name").isin(*BLOCK_TAGS) & ~F.col("token").endswith("/>")
    step = F.when(block, F.when(F.col("closes"), -1).otherwise(1)).otherwise(0)
    link = F.when(F.col("name") == "a", (~F.col("closes")).cast("int"))
    so_far = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tokens = tokens.withColumns({"step": step, "link": link})
    tokens = tokens.withColumns({"level": F.sum("step").over(so_far), "block_no": F.sum(F.abs("step")).over(so_far),
                                 "in_link": F.coalesce(F.last("link", ignorenulls=True).over(so_far), F.lit(0))})
    tokens = tokens.withColumn("depth", F.col("level") - F.least(F.lit(0), F.min("level").over(so_far)))
    # an inline tag leaves no gap, any other a space
    text = F.when(F.col("name").isNull(), F.col("token")).when(F.col("name").isin("br", "hr", "img"), F.lit(" ")).otherwise(F.lit(""))
    part = F.struct("pos", text.alias("text"), F.when(F.col("in_link") == 1, text).otherwise(F.lit("")).alias("linked"))
    blocks = tokens.groupBy("id", "block_no").agg(F.max("depth").alias("depth"), F.array_sort(F.collect_list(part)).alias("parts"))

    def joined(field: str):
        return X.collapse_ws(unescape(F.array_join(F.transform("parts", lambda p: p[field]), "")))

    out = blocks.select("id", "block_no", "depth", joined("text").alias("text"), joined("linked").alias("linked"))
    out = out.select("id", "block_no", "depth", "text", F.length("text").cast("long").alias("n_chars"),
                     F.length("linked").cast("long").alias("link_chars")).where("n_chars > 0")
    content = (F.col("n_chars") - F.col("link_chars") >= LEAST_TEXT) & (F.col("link_chars") * 2 <= F.col("n_chars"))
    return out.withColumn("content", content).withColumnRenamed("id", id_col)

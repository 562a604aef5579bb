"""Lines of laid-out pages (a PDF's text layer, extracted elsewhere) to blocks in reading order, in DataFrame operations only.

lines: path, page, top, x0, x1, size, text, small_digit (the line opens with a digit smaller than its type), marker_only (a footnote
number on a row of its own). Kinds of blocks: text (a paragraph), footnote, furniture (running heads, feet, page numbers), corrupt (the
text layer of a scan), table. Of equally frequent sizes, margins and pitches the least counts. A document's lines meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Signs of a scan's text layer, and the letters that real text of this length has.
JUNK, LETTERS, LONG = r"[\\~${}|]", "[àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ]", 40


def _layout(lines: DataFrame) -> DataFrame:
    """One row a document: body type size, left and right margin, line pitch."""
    by_size = lines.groupBy("path", F.round("size", 1).alias("s")).agg(F.sum(F.length("text")).alias("n"))
    body = by_size.groupBy("path").agg(F.max_by("s", F.struct("n", -F.col("s"))).alias("body"))
    step = F.round(F.lead("top").over(Window.partitionBy("path", "page").orderBy("top", "x0")) - F.col("top"))
    at = lines.join(body, "path").withColumn("step", step)
    main = (F.col("size") >= F.col("body")) & ~F.col("marker_only")
    pick = lambda c, when: F.mode(F.when(when, c), deterministic=True)
    return at.groupBy("path", "body").agg(pick(F.round("x0"), main).alias("left"), pick(F.round("x1"), main).alias("right"), pick(F.col("step"), F.col("step") > 0).alias("pitch"))


def _kinds(lines: DataFrame) -> DataFrame:
    """Lines with `kind`, and `first`/`last` of their page."""
    page = Window.partitionBy("path", "page")
    down, up = page.orderBy("top", "x0"), page.orderBy(F.desc("top"), F.desc("x0"))
    marked = lines.withColumns({"edge": (F.row_number().over(down) == 1) | (F.row_number().over(up) == 1), "key": F.regexp_replace(F.trim("text"), r"\d+", "#")})
    often = marked.filter("edge").select("path", "page", "key").distinct().groupBy("path", "key").agg(F.count("*").alias("pages")).filter("pages > 1 or key = '#'").select("path", "key", F.lit(True).alias("running"))
    marked = marked.join(often, ["path", "key"], "left")
    # the footnotes of a page: its last lines that are all smaller than the body, from the first of them that opens with a small digit
    large = F.max((F.col("size") >= F.col("body")).cast("int")).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = marked.withColumn("notes", F.when((large == 0) & F.col("small_digit"), F.col("top")))
    marked = marked.withColumn("notes", F.min("notes").over(page))
    corrupt = (F.length("text") > LONG) & F.rlike("text", F.lit(JUNK)) & ~F.rlike(F.lower("text"), F.lit(LETTERS))
    kind = F.when(F.col("edge") & F.col("running"), "furniture").when(F.col("top") >= F.col("notes"), "footnote").when(F.col("marker_only"), "marker").when(corrupt, "corrupt").otherwise("text")
    return marked.withColumn("kind", kind)


def blocks(lines: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """path, ordinal, kind, text. tables: path, page, top, text (markdown). A page without a text layer has no block.

    A paragraph begins at an indented line, after a short one, after a wider gap, and after a footnote, a table or corrupt text;
    furniture between two of its lines does not end it.
    """
    kinds = _kinds(lines.join(_layout(lines), "path")).filter("kind <> 'marker'").select("path", "page", "top", "x0", "x1", "text", "kind", "body", "left", "right", "pitch")
    if tables is not None:
        kinds = kinds.unionByName(tables.select("path", "page", "top", "text", F.lit("table").alias("kind")), allowMissingColumns=True)
    order = Window.partitionBy("path").orderBy("page", "top", "x0")
    placed = kinds.withColumn("nth", F.row_number().over(order))
    flow = placed.filter("kind <> 'furniture'")
    before = lambda c: F.lag(c).over(Window.partitionBy("path").orderBy("nth"))
    em = F.col("body")
    breaks = (
        (F.col("kind") != "text") | before("kind").isNull() | (before("kind") != "text") | (F.col("x0") >= F.col("left") + em / 2)
        | (before("x1") < F.col("right") - 2 * em) | ((F.col("top") > before("top")) & (F.col("top") - before("top") > F.col("pitch") + em / 2))
    )
    flow = flow.withColumn("part", F.sum(F.coalesce(breaks, F.lit(False)).cast("int")).over(Window.partitionBy("path").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)))
    joined = flow.groupBy("path", "part", "kind").agg(F.min("nth").alias("nth"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), " ").alias("text"))
    every = joined.select("path", "nth", "kind", "text").unionByName(placed.filter("kind = 'furniture'").select("path", "nth", "kind", "text"))
    return every.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("nth")) - 1).alias("ordinal"), "kind", "text")

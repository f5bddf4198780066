"""Reading order of boxes and glyphs on pages.

boxes(page, cx, cy, w, h, text); glyphs(doc, page, x, y, w, h, text, page_w, page_h).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.nested import let
from ..functions.text import strip
from .matching import held_names
from .windows import gap_groups

TALL, TALL_SHARE, X_TOLERANCE, Y_TOLERANCE, WIDE_ROWS, MERGE_GAP = 1.2, 0.3, 30, 30, 50, 100
COLUMN_GAP, ROW_GAP, ORPHANS = 24.0, 8.0, 5
# Character classes of the quality score.
QUALITY = r"[぀-ゟ゠-ヺ一-鿿⺀-⻿㈀-㋿㐀-䶿豈-﫿]"
SYMBOLS = r"[♡♪/＝・…※✧⩌⩊]"


PAGE = "page int, width double, height double, blocks array<struct<lines:array<struct<spans:array<struct<chars:array<struct<c:string,bbox:array<double>>>>>>>>>"


def read_glyphs(spark: SparkSession, path: str) -> DataFrame:
    """Glyphs of page files: rows (doc, page, seq, text, x, y, w, h, page_w, page_h), doc being the file.

    A line of a file is a page as JSON: page, width, height, and blocks of lines of spans of chars (c, bbox), as
    PDF libraries give them; each file is read by tasks of its own, and columns that are not asked for are not
    parsed.  Blanks and control characters go, a missing box is all zeros, numbers keep one decimal; seq is the
    order on the page.
    """
    inner = lambda outer, name: F.flatten(F.transform(outer, lambda x: F.coalesce(x[name], F.array())))
    pages = spark.read.schema(PAGE).json(path).select(F.input_file_name().alias("doc"), "page", "width", "height", inner(inner(inner(F.col("blocks"), "lines"), "spans"), "chars").alias("chars"))
    chars = pages.select("doc", "page", "width", "height", F.posexplode_outer("chars").alias("seq", "g")).filter(strip("g.c") != "")
    at = lambda i: F.coalesce(F.get("g.bbox", F.lit(i)), F.lit(0.0))
    one = lambda x: F.bround(x, 1)
    return chars.select("doc", "page", "seq", F.col("g.c").alias("text"), one(at(0)).alias("x"), one(at(1)).alias("y"), one(at(2) - at(0)).alias("w"), one(at(3) - at(1)).alias("h"), one(F.col("width")).alias("page_w"), one(F.col("height")).alias("page_h"))


def vertical_pages(boxes: DataFrame, by: str = "page") -> DataFrame:
    """Per page, whether boxes stand in columns."""
    n = boxes.groupBy(by).agg(F.count("*").alias("n"), F.avg((F.col("h") > F.col("w") * TALL).cast("double")).alias("tall"))
    columns = boxes.groupBy(by, F.bround(F.col("cx") / X_TOLERANCE).alias("column")).agg(F.count("*").alias("m")).filter("m >= 2").groupBy(by).agg(F.count("*").alias("columns"))
    joined = n.join(columns, by, "left")
    return joined.select(by, ((F.col("n") >= 4) & ((F.col("tall") > TALL_SHARE) | (F.coalesce("columns", F.lit(0)) >= 2))).alias("vertical"))


def horizontal_order(boxes: DataFrame, by: str = "page", tolerance: float = Y_TOLERANCE) -> DataFrame:
    """Rows of boxes from the top, from the left inside a row; ties by text."""
    key = F.bround(F.col("cy") / tolerance)
    return boxes.withColumn("row", key).withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(key, "cx", "cy", "text")))


def vertical_order(boxes: DataFrame, by: str = "page") -> DataFrame:
    """O3: rows (page, nth, text): columns from the right with near boxes joined, then wide boxes by row.

    Wide boxes whose text stands in a vertical one of the page go; wide texts have 20 letters at least.
    """
    tall = F.col("h") > F.col("w") * TALL
    wide = ~tall & (F.col("w") > F.col("h"))
    kind = F.when(tall | (wide & (F.length("text") < 20)), "vertical").when(wide, "wide").otherwise("square")
    b = boxes.withColumn("kind", kind)
    across = b.filter("kind = 'wide' and w <= 1000")
    held = held_names(across.select(by, F.col("text").alias("name")).distinct(), b.filter("kind = 'vertical'").select(by, F.col("text").alias("holder")).distinct(), (by,))
    rows = across.join(held.select(by, F.col("name").alias("text")).distinct().hint("shuffle_hash"), [by, "text"], "left_anti")
    columns = b.filter("kind <> 'wide'").withColumn("column", F.bround(F.col("cx") / X_TOLERANCE))
    grouped = gap_groups(columns, [by, "column"], "cy", MERGE_GAP)
    ordered = F.array_sort(F.collect_list(F.struct("cy", "text")))
    texts = grouped.groupBy(by, "column", "gap_group").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"))
    first = texts.select(by, F.lit(0).alias("part"), (-F.col("column")).alias("k1"), F.col("gap_group").cast("double").alias("k2"), "text")
    second = rows.select(by, F.lit(1).alias("part"), F.bround(F.col("cy") / WIDE_ROWS).alias("k1"), F.col("cx").cast("double").alias("k2"), "text")
    return first.unionByName(second).select(by, F.row_number().over(Window.partitionBy(by).orderBy("part", "k1", "k2", "text")).alias("nth"), "text")


def bucket_orphans(buckets: DataFrame, least: int = ORPHANS) -> DataFrame:
    """buckets(doc, page, bucket, n, seen) to their target bucket, seen being the order of first glyphs.

    A bucket of under ``least`` glyphs joins the nearest larger one; of equally near ones that holding
    more by then, then the lower.  Earlier orphans count (Q16): a fold over a page's orphans, by seen, then
    bucket, whose state is the larger buckets with their sizes.  A page has as many buckets as columns.
    """
    sized = lambda keep, *order: F.array_sort(F.collect_list(F.when(keep, F.struct(*order))))
    large, small = F.col("n") >= least, F.col("n") < least
    pages = buckets.groupBy("doc", "page").agg(sized(large, "bucket", "n").alias("large"), sized(small, "seen", "bucket", "n").alias("small"))
    state = "struct<large:array<struct<bucket:double,n:bigint>>,out:array<struct<bucket:double,target:double>>>"

    def joined(s: Column, orphan: Column) -> Column:
        near = F.array_min(F.transform(s["large"], lambda b: F.struct(F.abs(orphan["bucket"] - b["bucket"]).alias("far"), (-b["n"]).alias("less"), b["bucket"].alias("bucket"))))
        grown = lambda to: F.transform(s["large"], lambda b: F.struct(b["bucket"], F.when(b["bucket"] == to, b["n"] + orphan["n"]).otherwise(b["n"]).alias("n")))
        return let(near["bucket"], lambda to: F.struct(grown(to).alias("large"), F.array_append(s["out"], F.struct(orphan["bucket"], to.alias("target"))).alias("out")).cast(state))

    own = lambda c: F.transform(c, lambda b: F.struct(b["bucket"].cast("double").alias("bucket"), b["bucket"].cast("double").alias("target")))
    zero = F.struct(F.transform("large", lambda b: F.struct(b["bucket"].cast("double").alias("bucket"), b["n"].cast("long").alias("n"))).alias("large"), F.array().alias("out")).cast(state)
    moved = F.aggregate("small", zero, joined)["out"]
    every = F.concat(own(F.col("large")), F.when((F.size("large") > 0) & (F.size("small") > 0), moved).otherwise(own(F.col("small"))))
    return pages.select("doc", "page", F.explode_outer(every).alias("b")).select("doc", "page", "b.bucket", "b.target")


def glyph_lines(glyphs: DataFrame, vertical: bool = True, gap: float | None = None, drop_digits: bool = False) -> DataFrame:
    """Rows (doc, page, line, text): columns from the right, or rows from the top.

    glyphs carry seq, their order in the source.  Lines of digits alone go.
    """
    across, along = ("x", "y") if vertical else ("y", "x")
    gap = gap or (COLUMN_GAP if vertical else ROW_GAP)
    g = glyphs.withColumn("bucket", F.bround(F.col(across) / gap) * gap)
    sizes = g.groupBy("doc", "page", "bucket").agg(F.count("*").alias("n"), F.min("seq").alias("seen"))
    g = g.join(bucket_orphans(sizes), ["doc", "page", "bucket"])
    text = F.when(F.rlike(strip("text"), F.lit(r"(?U)^\d+$")), "").otherwise(F.col("text")) if drop_digits else F.col("text")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(along).alias("o"), "seq", text.alias("t"))))
    lines = g.groupBy("doc", "page", "target").agg(strip(F.array_join(F.transform(ordered, lambda x: x["t"]), "")).alias("text"))
    lines = lines.filter((F.col("text") != "") & ~F.rlike("text", F.lit(r"(?U)^\d+$")))
    order = F.desc("target") if vertical else F.asc("target")
    return lines.select("doc", "page", F.row_number().over(Window.partitionBy("doc", "page").orderBy(order)).alias("line"), "text")


def pages_to_text(lines: DataFrame) -> DataFrame:
    """The lines of a document under a mark for each page."""
    page = lines.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("body"))
    page = page.withColumn("text", F.concat(F.lit("<!-- page "), F.col("page").cast("string"), F.lit(" -->\n"), "body", F.lit("\n")))
    return page.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n").alias("text"))


def text_quality(lines: DataFrame, by: list[str]) -> DataFrame:
    """CJK share less twice the symbol share, weighted by length."""
    s = lines.withColumn("s", strip("text")).filter((F.col("s") != "") & ~F.rlike("s", F.lit(r"(?U)^\d+$")))
    score = F.regexp_count("s", F.lit(QUALITY)) - 2.0 * F.regexp_count("s", F.lit(SYMBOLS))
    return s.groupBy(*by).agg((F.sum(score) / F.greatest(F.sum(F.length("s")), F.lit(1))).alias("quality"))


def is_horizontal(glyphs: DataFrame, pages: int = 3, least: int = 30) -> DataFrame:
    """Per document, the vote of its first pages; ties and no votes mean vertical."""
    first = glyphs.withColumn("rank", F.dense_rank().over(Window.partitionBy("doc").orderBy("page"))).filter(F.col("rank") <= pages)
    first = first.withColumn("n", F.count("*").over(Window.partitionBy("doc", "page"))).filter(F.col("n") >= least).drop("n", "rank")
    down = text_quality(glyph_lines(first.filter(strip("text") != ""), True), ["doc", "page"]).withColumnRenamed("quality", "v")
    across = text_quality(glyph_lines(first, False, drop_digits=True), ["doc", "page"]).withColumnRenamed("quality", "h")
    zero = F.lit(0.0)
    votes = down.join(across, ["doc", "page"], "full").select("doc", F.signum(F.coalesce("h", zero) - F.coalesce("v", zero)).alias("vote"))
    docs = glyphs.select("doc").distinct()
    return docs.join(votes.groupBy("doc").agg(F.sum("vote").alias("votes")), "doc", "left").select("doc", (F.coalesce("votes", zero) > 0).alias("horizontal"))


def histograms(glyphs: DataFrame, x_step: int = 20, y_step: int = 30) -> DataFrame:
    """Glyph counts by floor bins of x and of y."""
    one = lambda axis, step: glyphs.groupBy("doc", F.lit(axis).alias("axis"), (F.floor(F.col(axis) / step) * step).alias("bin")).agg(F.count("*").alias("n"))
    return one("x", x_step).unionByName(one("y", y_step))


def dense_pages(glyphs: DataFrame, most: int = 3, over: int = 50, sample: int = 150) -> DataFrame:
    """Glyphs of the fullest pages of each document, in strides down to ``sample`` of a page."""
    pages = glyphs.groupBy("doc", "page").agg(F.count("*").alias("n")).filter(F.col("n") > over)
    pages = pages.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("n"), "page"))).filter(F.col("rank") <= most)
    rows = glyphs.join(pages, ["doc", "page"]).withColumn("at", F.row_number().over(Window.partitionBy("doc", "page").orderBy("seq")) - 1)
    return rows.filter(F.col("at") % F.greatest(F.lit(1), F.floor(F.col("n") / sample)) == 0)


def representative(files: DataFrame) -> DataFrame:
    """Per group the file with most glyphs, the first of equals.  files(grp, path, seq, n)."""
    return files.groupBy("grp").agg(F.max_by("path", F.struct("n", -F.col("seq"))).alias("path"))


def in_body(glyphs: DataFrame, low: float, high: float) -> DataFrame:
    """Glyphs, or blocks with y0 and y1, that reach into the body of the page."""
    return glyphs.filter(F.col("y").between(low, high)) if "y" in glyphs.columns else glyphs.filter((F.col("y1") >= low) & (F.col("y0") <= high))


def accept_text(texts: DataFrame) -> DataFrame:
    """Documents with over 100 characters that are Japanese enough, or over 500."""
    share = F.regexp_count("text", F.lit("[぀-ヿ一-鿿]")) / F.greatest(F.length("text"), F.lit(1))
    return texts.withColumn("accepted", (F.length("text") > 100) & ((share > 0.03) | (F.length("text") > 500)))

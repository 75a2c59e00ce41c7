"""Sources and sinks: text, HTML and page files, JSON lines, CSV, experiment runs; tables and small JSON files."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import ids, text

# Media type by suffix, and what isn't content.
MEDIA = {".txt": "text/plain", ".md": "text/markdown", ".html": "text/html", ".htm": "text/html", ".pdf": "application/pdf"}
DROPPED = ("script", "style", "nav", "footer", "noscript")
_BLOCKS = ("p", "div", "article", "section", "main", "header", "ul", "ol", "table", "blockquote", "pre", "body", "html", "aside", "form", "figure")
_VOID = ("br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr")


class UnsupportedDocument(ValueError):
    pass


def file_list(spark: SparkSession, root: str) -> DataFrame:
    """source, digest, suffix and content of each supported file below ``root``."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.where(suffix.isin(*MEDIA)).select(F.col("path").alias("source"), F.sha2("content", 256).alias("digest"), suffix.alias("suffix"), "content")


def decoded(content: Column) -> Column:
    """UTF-8 with a replacement character for what isn't."""

    @F.pandas_udf("string")
    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: bytes(b).decode("utf-8", "replace"), na_action="ignore")

    return decode(content)


class _Content(HTMLParser):
    """Main content as Markdown: headings, paragraphs, list items, tables; ``visible`` holds all visible text beside it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.visible: list[str] = []
        self.line, self.mark, self.row = "", "", None
        self.skipped = self.main = 0
        self.hidden: list[str] = []

    def end_line(self) -> None:
        words = " ".join(self.line.split())
        if words:
            self.lines.append(f"{self.mark}{words}")
        self.line, self.mark = "", ""

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in _VOID:
            if tag in ("br", "hr"):
                self.end_line()
            return
        if tag in DROPPED or tag in ("head", "title", "template"):
            self.hidden.append(tag)
        if self.hidden:
            return
        if re.fullmatch("h[1-6]", tag):
            self.end_line()
            self.mark = "#" * int(tag[1]) + " "
        elif tag == "li":
            self.end_line()
            self.mark = "- "
        elif tag == "tr":
            self.end_line()
            self.row = []
        elif tag in _BLOCKS:
            self.end_line()

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
            return
        if tag in ("td", "th") and self.row is not None:
            self.row.append(" ".join(self.line.split()))
            self.line = ""
        elif tag == "tr" and self.row is not None:
            if any(self.row):
                self.lines.append("| " + " | ".join(self.row) + " |")
            self.row = None
        elif tag in _BLOCKS or tag == "li" or re.fullmatch("h[1-6]", tag):
            self.end_line()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.line += data
            if data.strip():
                self.visible.append(data)


def html_content(html: str | None) -> tuple[str, bool]:
    """Main content, and whether only the visible text could be had."""
    parser = _Content()
    try:
        parser.feed(html or "")
        parser.close()
        parser.end_line()
    except (ValueError, AssertionError):
        return re.sub(r"<[^>]*>", "\n", html or ""), True
    content = "\n\n".join(parser.lines)
    return (content, False) if content.strip() else ("\n".join(parser.visible), True)


def extract_html(html: Column) -> Column:
    @F.pandas_udf("struct<content:string,fallback:boolean>")
    def extract(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([html_content(h) for h in batch], columns=["content", "fallback"])

    return extract(html)


def as_documents(raw: DataFrame) -> DataFrame:
    """source, text, media_type, page, language, warnings, doc_hash from rows (source, raw, content, media_type, page,
    first_warnings): ``raw`` is what was read, ``content`` what was taken from it."""
    cleaned = raw.withColumn("text", text.clean_text(F.col("content")))
    warnings = F.array_distinct(F.concat("first_warnings", text.quality_warnings(F.col("raw"), F.col("text"))))
    return cleaned.select("source", "text", "media_type", "page", text.probable_language(F.col("text")).alias("language"), warnings.alias("warnings"), ids.doc_hash(F.col("text")).alias("doc_hash"))


def html_documents(pages: DataFrame, source: str = "url", html: str = "html") -> DataFrame:
    got = pages.select(F.col(source).alias("source"), F.col(html).alias("raw"), extract_html(F.col(html)).alias("x"))
    first = F.when(F.col("x.fallback"), F.array(F.lit("content_fallback"))).otherwise(F.array().cast("array<string>"))
    return as_documents(got.select("source", "raw", F.col("x.content").alias("content"), F.lit("text/html").alias("media_type"), F.lit(None).cast("int").alias("page"), first.alias("first_warnings")))


def load_documents(files: DataFrame, page_blocks: DataFrame | None = None) -> DataFrame:
    """Documents of files (source, suffix, content). Page files need ``page_blocks`` (see ``page_documents``), which a PDF
    library makes; a file of another suffix fails when run."""
    known = F.when(F.col("suffix").isin(*MEDIA), True).otherwise(F.raise_error(F.concat(F.lit("unsupported document: "), F.col("source"))).cast("boolean"))
    files = files.where(known)
    plain = files.where(F.col("suffix").isin(".txt", ".md")).withColumn("raw", decoded(F.col("content")))
    media = F.when(F.col("suffix") == ".md", "text/markdown").otherwise("text/plain")
    out = as_documents(plain.select("source", "raw", F.col("raw").alias("content"), media.alias("media_type"), F.lit(None).cast("int").alias("page"), F.array().cast("array<string>").alias("first_warnings")))
    web = files.where(F.col("suffix").isin(".html", ".htm")).select("source", decoded(F.col("content")).alias("html"))
    out = out.unionByName(html_documents(web, "source", "html"))
    return out if page_blocks is None else out.unionByName(page_documents(page_blocks))


def page_texts(blocks: DataFrame) -> DataFrame:
    """(source, page, raw, first_warnings) from layout blocks (source, page, width, height, x0, y0, x1, y1, text).

    With two narrow blocks or more on either side of the middle a page has two columns: wide blocks at the top, the left
    column, the right one, wide blocks below. Else blocks go from top to bottom. Every block comes once, also those that
    straddle the middle (after the right column). A page without text has the warning no_text_layer.
    """
    full = text.strip(F.coalesce("text", F.lit(""))) != ""
    wide = F.col("x1") - F.col("x0") >= F.col("width") * 0.70
    left = ~wide & (F.col("x1") <= F.col("width") / 2 * 1.08)
    right = ~wide & (F.col("x0") >= F.col("width") / 2 * 0.92)
    page = Window.partitionBy("source", "page")
    marked = blocks.withColumns({"full": full, "wide": wide, "left": left, "right": right & ~left})
    two = (F.count_if(F.col("full") & F.col("left")).over(page) >= 2) & (F.count_if(F.col("full") & right).over(page) >= 2)
    zone = F.when(~F.col("two"), 0).when(F.col("wide") & (F.col("y0") < F.col("height") * 0.18), 1).when(F.col("left"), 2).when(F.col("right"), 3).when(F.col("wide"), 5).otherwise(4)
    ordered = F.array_sort(F.collect_list(F.when(F.col("full"), F.struct(F.col("zone"), F.col("y0"), F.col("x0"), text.strip(F.col("text")).alias("t")))))
    done = marked.withColumn("two", two).withColumn("zone", zone).groupBy("source", "page").agg(ordered.alias("o"), F.bool_or("two").alias("two"))
    warnings = F.array_compact(F.array(F.when(F.size("o") == 0, "no_text_layer"), F.when(F.col("two"), "two_column_layout_detected")))
    return done.select("source", "page", F.array_join(F.transform("o", lambda x: x["t"]), "\n").alias("raw"), warnings.alias("first_warnings"))


def edge_line(line: Column) -> Column:
    return F.regexp_replace(text.squeezed(line), rf"(?<!{text.WORD})\p{{Nd}}+(?!{text.WORD})", "<num>")


def without_furniture(pages: DataFrame) -> DataFrame:
    """Pages with their first and last lines blanked where these repeat on 60 % of a document's pages, two at least."""
    lines = F.split("raw", text.LINE_BREAK, -1)
    solid = F.filter(lines, lambda x: text.strip(x) != "")
    edges = pages.select("source", "page", F.explode(F.array_distinct(F.transform(F.filter(F.array(F.get(solid, F.lit(0)), F.element_at(F.when(F.size(solid) > 0, solid), -1)), lambda x: x.isNotNull()), edge_line))).alias("edge"))
    counts = pages.groupBy("source").agg(F.count(F.lit(1)).alias("pages"))
    often = edges.groupBy("source", "edge").agg(F.count_distinct("page").alias("n")).join(counts, "source")
    often = often.where((F.col("pages") >= 2) & (F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * 0.60))) & (F.col("edge") != ""))
    known = often.groupBy("source").agg(F.collect_set("edge").alias("known"))
    joined = pages.join(known, "source", "left").withColumn("lines", lines).withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    at_edge = lambda line, i: ((i == 0) | (i == F.size("lines") - 1)) & F.array_contains("known", edge_line(line))
    kept = F.transform("lines", lambda line, i: F.when(at_edge(line, i), "").otherwise(line))
    joined = joined.withColumn("content", F.array_join(kept, "\n"))
    removed = F.when(F.col("content") != F.col("raw"), F.array(F.lit("repeated_header_footer_removed"))).otherwise(F.array().cast("array<string>"))
    return joined.select("source", "page", "raw", "content", "first_warnings", removed.alias("last_warnings"))


def page_documents(blocks: DataFrame) -> DataFrame:
    """One document for each page of layout blocks."""
    pages = without_furniture(page_texts(blocks)).withColumn("media_type", F.lit("application/pdf"))
    made = as_documents(pages.withColumn("page", F.col("page").cast("int")))
    late = pages.select("source", F.col("page").cast("int").alias("page"), "last_warnings")
    joined = made.join(late, ["source", "page"])
    return joined.withColumn("warnings", F.array_distinct(F.concat("warnings", "last_warnings"))).select(*made.columns)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines file; blank lines are skipped, others must fit the schema."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    fits = F.from_json("value", schema, {"mode": "FAILFAST"})
    return lines.select(fits.alias("x")).select("x.*")


def read_runs(spark: SparkSession, directory: str) -> DataFrame:
    """config, result and status of the experiment runs that ended well."""
    return spark.read.option("multiLine", True).json(directory).where(F.col("status") == "ok")


def read_review(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).na.fill("")


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """(source, digest) and the chunk configuration's hash; nothing where there is no manifest yet."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return spark.createDataFrame([], "source string, digest string"), None
    rows = spark.read.schema("source string, digest string, chunk_config_hash string").parquet(path)
    head = rows.where("source IS NULL").head()
    return rows.where("source IS NOT NULL").select("source", "digest"), head["chunk_config_hash"] if head else None


def write_manifest(files: DataFrame, chunk_config_hash: str, path: str) -> None:
    """Written last, so that a run that broke off is done again."""
    spark = files.sparkSession
    head = spark.createDataFrame([(None, None, chunk_config_hash)], "source string, digest string, chunk_config_hash string")
    files.select("source", "digest", F.lit(None).cast("string").alias("chunk_config_hash")).unionByName(head).write.mode("overwrite").parquet(path)


def replace_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines written beside ``path`` and then put in its place."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, old = jvm.org.apache.hadoop.fs.Path(f"{path}.new"), jvm.org.apache.hadoop.fs.Path(path)
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}.new")
    fs = old.getFileSystem(conf)
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{path}.new could not be renamed")


def table_bytes(df: DataFrame) -> str:
    """A small result as JSON text, for reports."""
    return json.dumps([r.asDict(recursive=True) for r in df.collect()], indent=2, sort_keys=True, default=str)

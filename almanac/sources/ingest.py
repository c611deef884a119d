"""Documents, JSON tables, quarantine and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.operators.rounds import settled, spread
from almanac.sources import pdf

#: Rows of words closer than this are one line; a column is so many points wide.
LINE_GAP, POINTS = 3.0, 4.0


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSON file (an array or one object); none if the path does not exist."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def publish(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> None:
    """Write all ``tables`` beside ``folder`` and put them in its place when all are whole.

    Until then readers find the old tables; a build that ends early leaves
    them as they were, and what it had written is deleted by the next.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    target = path(folder)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    staged, old = path(f"{folder}.new"), path(f"{folder}.old")
    if store.exists(old) and not store.exists(target):  # a build was lost between its two renames
        store.rename(old, target)
    for left in (staged, old):
        store.delete(left, True)
    for name, table in tables.items():
        write_json(table, f"{folder}.new/{name}")
    store.mkdirs(target.getParent())
    for source, to in ((target, old), (staged, target)):
        if store.exists(source) and not store.rename(source, to):
            raise OSError(f"cannot move {source} to {to}")
    store.delete(old, True)


def save_profile(df: DataFrame, path: str) -> None:
    """Replace the store of a single profile (``path``/profile) as a whole."""
    publish(df.sparkSession, {"profile": df.limit(1).coalesce(1)}, path)


def load_profile(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The stored profile; no row before the first is saved."""
    return read_json(spark, f"{path}/profile", schema)


def pdf_files(spark: SparkSession, folder: str, limit: int | None = None, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """(path, content) of the PDF files of a folder, in order of path; ``limit`` must be positive.

    Spark plans the partitions by the files' sizes, and reads no content for a
    query that asks for paths only. A limit picks paths before contents are read.
    """
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    if limit is None:
        return files
    return files.join(F.broadcast(files.select("path").orderBy("path").limit(limit)), "path", "left_semi")


WORD = pa.struct([("page", pa.int32()), ("x", pa.float64()), ("y", pa.float64()), ("word", pa.string())])
WORDS = pa.list_(WORD)
READ = "struct<error:string,n_pages:int,words:array<struct<page:int,x:double,y:double,word:string>>>"


def read_pdf(content: bytes | None) -> tuple:
    """(error, pages, words) of a PDF; whatever goes wrong is the file's error."""
    try:
        pages = pdf.words(bytes(content or b""))
        return None, max((w.page for w in pages), default=0), [tuple(w) for w in pages]
    except Exception as e:  # noqa: BLE001  a file of any content must leave the scan going
        return f"{type(e).__name__}: {e}", None, None


def packed(content: bytes | None) -> pa.Array:
    """What ``read_pdf`` gives as an array of one row: Spark would make an object for every word."""
    error, n, words = read_pdf(content)
    listed = pa.nulls(1, WORDS) if words is None else pa.ListArray.from_arrays([0, len(words)], pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*words, strict=True) if words else [[]] * 4, WORD, strict=True)], fields=list(WORD)))
    return pa.StructArray.from_arrays([pa.array([error], pa.string()), pa.array([n], pa.int32()), listed.cast(WORDS)], ["error", "n_pages", "words"])


def read_pdfs(contents: pa.Array) -> pa.Array:
    return pa.concat_arrays([packed(c.as_py()) for c in contents] or [packed(None).slice(0, 0)])


def documents(files: DataFrame) -> DataFrame:
    """``files`` (path, content) with error, n_pages and words (page, x, y, word) in place of the content.

    Reading is a column, so a query that uses none of them decodes nothing; a
    file that cannot be read is one row with its error. Spark would repeat the
    reading for a filter on its outcome if it took it for a plain expression.
    """
    read = F.arrow_udf(read_pdfs, READ).asNondeterministic()
    others = [c for c in files.columns if c != "content"]
    return files.withColumn("_read", read("content")).select(*others, "_read.error", "_read.n_pages", "_read.words")


def failures(files: DataFrame) -> DataFrame:
    """``files`` (path, content) with error in place of the content: every file is read whole, but its words go no further."""
    error = F.udf(lambda content: read_pdf(content)[0], "string", useArrow=True)
    return files.withColumn("error", error("content")).drop("content")


def page_texts(read: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page_no, text): the pages of ``documents`` that have words, in their layout."""
    words = read.select(*keys, F.inline("words")).withColumnRenamed("page", "page_no")
    return layout_words(words, [*keys, "page_no"])


def texts(files: DataFrame, decode: Callable[[bytes], str] | None = None) -> DataFrame:
    """(source_file, text, error), pages parted by form feeds: a file that cannot be read gives its error, and the scan goes on.

    Files are decoded once, whatever reads the result; ``decode`` is another decoder of whole files.
    """
    if decode is None:
        read = settled(documents(files).withColumn("source_file", F.element_at(F.split("path", "/"), -1)))
        at = F.struct("page_no", "text")
        pages = page_texts(read.where("error IS NULL"), ["path"]).groupBy("path").agg(F.map_from_entries(F.collect_list(at)).alias("pages"))
        every = F.transform(F.sequence(F.lit(1), F.col("n_pages")), lambda n: F.coalesce(F.try_element_at("pages", n), F.lit("")))
        text = F.when(F.col("error").isNull(), F.when(F.col("n_pages") > 0, F.array_join(every, "\f")).otherwise(""))
        return read.drop("words").join(pages, "path", "left").select("source_file", text.alias("text"), "error")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append((path.rpartition("/")[2], decode(content), None))
                except Exception as e:  # noqa: BLE001  whatever a decoder raises goes into the row
                    rows.append((path.rpartition("/")[2], None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["source_file", "text", "error"])

    return settled(files.mapInPandas(run, "source_file string, text string, error string"))


def lines_of(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, page_no, line_no, line): pages are parted by form feeds, lines by line feeds."""
    pages = docs.select(key, F.posexplode(F.split(text, "\f")).alias("page_no", "_page"))
    return pages.select(key, (F.col("page_no") + 1).alias("page_no"), F.posexplode(F.split("_page", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def layout_words(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text) of pages from positioned words (keys, x, y, word).

    A word starts a new line if it is more than ``LINE_GAP`` below the line's
    first word; its column is its x in units of ``POINTS``.
    """
    def step(state: Column, at: Column) -> Column:
        near = F.coalesce(F.abs(at["y"] - state["y"]) <= LINE_GAP, F.lit(False))
        return F.struct(
            F.when(near, F.concat(state["row"], at["row"])).otherwise(at["row"]).alias("row"), F.when(near, state["y"]).otherwise(at["y"]).alias("y"),
            F.when(near | state["y"].isNull(), state["rows"]).otherwise(F.array_append(state["rows"], state["row"])).alias("rows"),
        )

    def place(line: Column, w: Column) -> Column:
        gap = F.greatest(F.lit(1), w["column"] - F.length(line))
        return F.concat(line, F.repeat(F.lit(" "), gap), w["word"])

    # Words of one height come together first, so a page is a fold over its heights, not its words.
    one = F.sort_array(F.collect_list(F.struct("x", "word", F.rint(F.col("x") / POINTS).cast("int").alias("column"))))
    heights = spread(words, *keys).withColumns({c: F.col(c).cast("double") for c in ("x", "y")}).groupBy(*keys, "y").agg(one.alias("row"))
    row = "array<struct<x:double,word:string,column:int>>"
    start = F.struct(F.array().cast(row).alias("row"), F.lit(None).cast("double").alias("y"), F.array().cast(f"array<{row}>").alias("rows"))
    folded = heights.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("y", "row"))).alias("_w")).withColumn("_s", F.aggregate("_w", start, step))
    rows = F.array_append(F.col("_s.rows"), F.col("_s.row"))
    drawn = F.transform(rows, lambda row: F.aggregate(F.sort_array(row), F.lit(""), place))
    return folded.select(*keys, F.array_join(drawn, "\n").alias("text"))


#: Phrases of page headers and footers.
FURNITURE = r"(?i)^(?:BIRLA INSTITUTE|Pilani Campus|AUGS\s*/|AGSR Division|Academic (?:Undergraduate|Graduate) Studies|Please Do Not Print|\[Type here\])"
PAGE_NUMBER = r"(?i)^(?:Page\s+)?\d+(?:\s+of\s+\d+)?$"


def without_furniture(rows: DataFrame, key: str) -> DataFrame:
    """Blank the headers, footers and page numbers of (key, page_no, line_no, line); lines keep their lengths.

    Page numbers count only in the first five and last three lines of a page that are not blank.
    """
    from pyspark.sql import Window

    bare = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    page = Window.partitionBy(key, "page_no", bare != "")
    down, up = F.row_number().over(page.orderBy("line_no")), F.row_number().over(page.orderBy(F.desc("line_no")))
    edge = (bare != "") & ((F.col("_down") <= 5) | (F.col("_up") <= 3))
    gone = F.regexp_like(bare, F.lit(FURNITURE)) | (edge & F.regexp_like(bare, F.lit(PAGE_NUMBER)))
    marked = rows.withColumn("_down", down).withColumn("_up", up)
    return marked.withColumn("line", F.when(gone, F.repeat(F.lit(" "), F.length("line"))).otherwise(F.col("line"))).drop("_down", "_up")


def pages_joined(rows: DataFrame, key: str) -> DataFrame:
    """(key, text) from (key, page_no, line_no, line): the inverse of ``lines_of``."""
    page = rows.groupBy(key, "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("_page"))
    return page.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "_page"))), lambda x: x["_page"]), "\f").alias("text"))


def stats(catalogue: DataFrame, offerings: DataFrame, handouts: DataFrame) -> DataFrame:
    """One row: courses, offerings, handouts and the documents they come from."""
    a = catalogue.agg(F.count_distinct("course").alias("courses"))
    return a.join(offerings.agg(F.count("*").alias("offerings"))).join(handouts.agg(F.count("*").alias("handouts")))

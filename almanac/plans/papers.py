"""PDF queries: files are written from all documents into the shared folder and read back."""

from __future__ import annotations

import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.operators.rounds import shared_folder
from almanac.plans.academic import read
from almanac.sources import ingest

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Documents of a file, words of a line.
IN_FILE, IN_LINE = 100, 12
BLANKS = r"[\x20\x09-\x0D]+"


def made(pages: list[str]) -> str:
    """A PDF in ASCII, a page for each text; letters are UTF-16 codes with a map to Unicode, streams are packed and written in hex."""
    kids = " ".join(f"{5 + 2 * i} 0 R" for i in range(len(pages)))
    objects = ["<</Type/Catalog/Pages 2 0 R>>", f"<</Type/Pages/Kids[{kids}]/Count {len(pages)}/Resources<</Font<</F 3 0 R>>>>>>",
        "<</Type/Font/Subtype/Type0/BaseFont/F/Encoding/Identity-H/ToUnicode 4 0 R/DescendantFonts[<</Type/Font/Subtype/CIDFontType2/BaseFont/F/DW 500>>]>>"]

    def stream(body: str) -> str:
        data = zlib.compress(body.encode()).hex() + ">"
        return f"<</Length {len(data)}/Filter[/ASCIIHexDecode/FlateDecode]>>\nstream\n{data}\nendstream"

    objects.append(stream("1 beginbfrange <0000> <FFFF> <0000> endbfrange"))
    for i, text in enumerate(pages):
        lines = text.split("\n")
        shown = "".join(f"<{line.encode('utf-16-be', 'surrogatepass').hex()}> Tj T*\n" for line in lines)
        height = 100 + 14 * len(lines)
        objects += [f"<</Type/Page/Parent 2 0 R/MediaBox[0 0 612 {height}]/Contents {6 + 2 * i} 0 R>>", stream(f"BT /F 12 Tf 14 TL 72 {height - 60} Td\n{shown}ET")]
    out, places = "%PDF-1.7\n", []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{n} 0 obj\n{body}\nendobj\n"
    table = "".join(f"{at:010d} 00000 n \n" for at in places)
    return f"{out}xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<</Size {len(objects) + 1}/Root 1 0 R>>\nstartxref\n{len(out)}\n%%EOF"


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content, file, broken) of PDF files with a page for every document; of every seventh file only a third was written."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), BLANKS), lambda w: w != "")
    # A line ends after so many words; cutting an array for each line would copy it as often.
    lines = F.regexp_replace("_text", f"([^ ]+(?: [^ ]+){{{IN_LINE - 1}}}) ", "$1\n")
    docs = read(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", F.array_join(words, " ").alias("_text"))
    head = F.concat(F.lit("#"), F.col("doc_id").cast("string"))
    pages = docs.select((F.col("doc_id") / IN_FILE).cast("long").alias("file"), "doc_id", F.concat(head, F.when(F.col("_text") != "", F.concat(F.lit("\n"), lines)).otherwise("")).alias("text"))

    @F.pandas_udf("string")
    def written(texts: pd.Series, file: pd.Series) -> pd.Series:
        whole = texts.map(made)
        return whole.where(file % 7 != 6, whole.map(lambda t: t[20 : len(t) // 3]))

    files = pages.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("pages"))
    folder = f"{shared_folder(spark)}/papers-{uuid.uuid4().hex}"
    files.select("file", written(F.transform("pages", lambda p: p["text"]), F.col("file")).alias("value")).write.partitionBy("file").text(folder)
    found = ingest.pdf_files(spark, folder, pattern="*.txt")
    return found.withColumn("file", F.regexp_extract("path", r"file=(\d+)", 1).cast("long"))


def query(sql: str):
    def add(function):
        QUERIES[function.__name__], ORACLE_SQL[function.__name__] = function, sql
        return function

    return add


@query(f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{BLANKS}'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, doc_id // {IN_FILE} AS file, doc_id % {IN_FILE} + 1 AS page_no, CAST(len(w) AS BIGINT) AS n_words, CAST(ceil(len(w) / {IN_LINE}) AS BIGINT) AS n_lines, md5(array_to_string(w, ' ')) AS words_md5
FROM d WHERE (doc_id // {IN_FILE}) % 7 <> 6""")
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and lines of every page of every PDF file that can be read."""
    laid_out = ingest.page_texts(ingest.documents(papers(spark, sf_dir)), ["file"])  # a file that cannot be read has no words
    lines = F.split("text", "\n")
    words = F.filter(F.split(F.array_join(F.slice(lines, 2, F.size(lines)), " "), " +"), lambda w: w != "")
    return laid_out.select(
        F.substring(F.trim(F.get(lines, F.lit(0))), 2, 20).cast("long").alias("doc_id"), "file", F.col("page_no").cast("long").alias("page_no"),
        F.size(words).cast("long").alias("n_words"), (F.size(lines) - 1).cast("long").alias("n_lines"), F.md5(F.array_join(words, " ").cast("binary")).alias("words_md5"),
    )


@query(f"SELECT DISTINCT doc_id // {IN_FILE} AS file, CASE WHEN (doc_id // {IN_FILE}) % 7 = 6 THEN 'ValueError: not a PDF file' END AS error FROM documents WHERE doc_id IS NOT NULL")
def pdf_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each file: the error of one that cannot be read, and the scan goes on."""
    return ingest.failures(papers(spark, sf_dir)).select("file", "error")

"""Command line: ``python -m almanac build --root FOLDER`` and ``python -m almanac outlines --root FOLDER [--limit N]``."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.operators import catalog, handouts
from almanac.sources import ingest

# The documents of an academic build.
BULLETIN, REGULATIONS, TIMETABLE = "bulletin.pdf", "Academic-Regulations-2023.pdf", "timetable.pdf"


def positive(value: str) -> int:
    n = int(value)
    if n < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return n


def arguments(given: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="almanac", description="Read academic documents into tables.")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="tables of the catalogue, the regulations and the timetable")
    outlines = commands.add_parser("outlines", help="records of course outlines")
    outlines.add_argument("--limit", type=positive, help="read the first files only")
    for command in (build, outlines):
        command.add_argument("--root", required=True, help="folder of the PDF files")
        command.add_argument("--out", help="folder of the written tables; by default tables in --root")
    return parser.parse_args(given)


def build(spark: SparkSession, root: str, out: str, decode: Callable[[bytes], str] | None) -> dict[str, int]:
    """Replace every table of the build but the report at once, and return the report."""

    def lines(name: str) -> DataFrame:
        files = spark.read.format("binaryFile").load(f"{root}/{name}").select("path", "content")
        # A document of the build must be readable, so an error ends it.
        told = ingest.texts(files, decode).withColumn("text", F.when(F.col("error").isNull(), F.col("text")).otherwise(F.raise_error("error").cast("string")))
        return ingest.lines_of(told.withColumnRenamed("source_file", "source_document"), "source_document")

    tables = catalog.build(lines(BULLETIN), lines(REGULATIONS), lines(TIMETABLE))
    report = tables.pop("report")
    ingest.publish(spark, tables, out)
    return {r["what"]: r["n"] for r in report.collect()}  # a row a table


def outlines(spark: SparkSession, root: str, out: str, limit: int | None, decode: Callable[[bytes], str] | None) -> dict[str, int]:
    """Replace the records, components, rules and quarantine of the outlines at once, and return their counts."""
    texts = ingest.texts(ingest.pdf_files(spark, root, limit), decode)  # files are decoded once
    docs = texts.where("error IS NULL").select(F.col("source_file").alias("doc_id"), F.col("source_file").alias("file_name"), "text")
    results = dict(zip(("records", "components", "rules"), handouts.parse(docs), strict=True)) | {"quarantine": texts.where("error IS NOT NULL").drop("text")}
    ingest.publish(spark, results, out)
    return {name: spark.read.text(f"{out}/{name}").count() for name in results}


def main(given: Sequence[str] | None = None, spark: SparkSession | None = None, decode: Callable[[bytes], str] | None = None) -> None:
    args = arguments(given)
    spark = spark or SparkSession.builder.appName("almanac").getOrCreate()
    out = args.out or f"{args.root}/tables"
    counts = build(spark, args.root, out, decode) if args.command == "build" else outlines(spark, args.root, out, args.limit, decode)
    print(json.dumps(counts, indent=2, sort_keys=True))


if __name__ == "__main__":
    main()

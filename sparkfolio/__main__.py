"""python -m sparkfolio detect|convert|text|metadata PATH...: one line of JSON for each file under the paths."""

from __future__ import annotations

import argparse


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sparkfolio")
    parser.add_argument("command", choices=("detect", "convert", "text", "metadata", "version"))
    parser.add_argument("paths", nargs="*")
    given = parser.parse_args(arguments)
    from sparkfolio.operators.convert import VERSION, convert

    if given.command == "version" or not given.paths:
        print(VERSION)
        return
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from sparkfolio.operators.detect import detect, format_info, summary_line
    from sparkfolio.operators.extract import document_text
    from sparkfolio.sources.files import read_files
    from sparkfolio.sources.parse import parse_files

    spark = SparkSession.builder.appName("sparkfolio").getOrCreate()
    for path in given.paths:
        files = read_files(spark, path)
        found = detect(files)
        if given.command == "detect":
            rows = found.select("name", summary_line(format_info(F.col("format"))["name"], F.col("mime_type"), F.col("confidence")).alias("summary"))
        elif given.command == "convert":
            rows = convert(files).select("name", "status", "content_type", "body")
        else:
            parsed = parse_files(found.where("format IS NOT NULL"), gated=False)
            rows = parsed.select("name", document_text(F.col("document")).alias("text")) if given.command == "text" else parsed.select("name", "document.metadata")
        for line in rows.toJSON().toLocalIterator():
            print(line)


if __name__ == "__main__":
    main()

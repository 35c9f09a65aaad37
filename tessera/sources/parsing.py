"""Parsers: file contents to pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.files import extension
from tessera.functions.text import decode

PAGES = "array<struct<text:string,page_number:int>>"
#: Bytes of a document -> its pages' texts.
Parser = Callable[[bytes], list[str]]


def pdf_pages(data: bytes) -> list[str]:
    """Page texts by an optional PDF library."""
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("no PDF library is installed") from e
    with fitz.open(stream=data, filetype="pdf") as doc:
        return [page.get_text() for page in doc]


def pdf_parser(parse: Parser = pdf_pages):
    """A UDF content -> (pages, error): page numbers from 1, blank pages left out, their numbers kept. A file that fails gives an error, not a failed job."""

    @F.pandas_udf(f"struct<pages:{PAGES},error:string>")
    def run(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in contents:
            rows = []
            for data in batch:
                try:
                    if data is None:
                        raise OSError("unreadable")
                    rows.append(([{"text": t, "page_number": i} for i, t in enumerate(parse(bytes(data)), 1) if t.strip()], None))
                except Exception as e:  # noqa: BLE001  any fault of a parser is the file's
                    rows.append(([], str(e)))
            yield pd.DataFrame(rows, columns=["pages", "error"])

    return run


def is_pdf() -> Column:
    return extension(F.col("rel_path")) == ".pdf"


def parse(files: DataFrame, parser: Parser = pdf_pages, any_pdf: bool = True) -> DataFrame:
    """``files`` (rel_path, content) with pages and parse_error: text files natively, as one page 0; PDF by ``parser``, which has no tasks where there is not ``any_pdf``."""
    pdf = is_pdf()
    text = F.array(F.struct(decode(F.col("content")).alias("text"), F.lit(0).alias("page_number")))
    missing = F.when(F.col("content").isNull(), "unreadable")
    plain = (files.filter(~pdf) if any_pdf else files).select("*", F.coalesce(F.when(F.col("content").isNotNull(), text), F.array().cast(PAGES)).alias("pages"), missing.alias("parse_error"))
    if not any_pdf:
        return plain
    other = files.filter(pdf).withColumn("__parsed", pdf_parser(parser)("content")).select(*files.columns, F.col("__parsed.pages").alias("pages"), F.col("__parsed.error").alias("parse_error"))
    return plain.unionByName(other)

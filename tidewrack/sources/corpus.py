"""Corpora: WARC files, tables of texts, saved pages."""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions.html import preprocess_html
from tidewrack.functions.text import MAX_TEXT_CHARS
from tidewrack.operators.ranking import global_rank

# Documents of a corpus and pages kept by the page sink.
MAX_DOCS = 5_000
SAVED_PAGES = 20


def warc_records(data: bytes) -> Iterator[tuple[int, str, str | None, str | None, bytes]]:
    """(number, type, target URI, date, payload) of the records of a WARC file, gzipped or not.

    The payload of an HTTP record is its body. Reading ends at the first header
    that isn't one of a record.
    """
    if data[:2] == b"\x1f\x8b":
        out, rest = [], data
        while rest:  # one gzip member a record
            unzip = zlib.decompressobj(16 + zlib.MAX_WBITS)
            try:
                out.append(unzip.decompress(rest))
            except zlib.error:
                break
            rest = unzip.unused_data
        data = b"".join(out)
    stream, number = io.BytesIO(data), 0
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            return
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        content = stream.read(int(headers.get("content-length") or 0))
        if headers.get("content-type", "").startswith("application/http"):
            for gap in (b"\r\n\r\n", b"\n\n"):
                if gap in content:
                    content = content.partition(gap)[2]
                    break
        yield number, headers.get("warc-type", ""), headers.get("warc-target-uri"), headers.get("warc-date"), content
        number += 1


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(``warc_file``, ``record_no``, ``rec_type``, ``target_uri``, ``warc_date``, ``payload``) of the WARC files at ``path``.

    Files are read in parallel, one task a file (gzip can't be split). Bytes that
    are no UTF-8 are dropped from the payload.
    """

    def run(frames):
        for f in frames:
            for name, content in zip(f.path, f.content):
                rows = [(name, n, kind, uri, date, body.decode("utf-8", "ignore")) for n, kind, uri, date, body in warc_records(content)]
                yield pd.DataFrame(rows, columns=["warc_file", "record_no", "rec_type", "target_uri", "warc_date", "payload"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "warc_file string, record_no bigint, rec_type string, target_uri string, warc_date string, payload string")


def write_warc(path: str, records: list[tuple[str, str, bytes]]) -> None:
    """Writes (type, target URI, HTTP message) records as a gzipped WARC file."""
    with open(path, "wb") as f:
        for kind, uri, content in records:
            head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nContent-Type: application/http; msgtype={kind}\r\nContent-Length: {len(content)}\r\n\r\n"
            f.write(gzip.compress(head.encode() + content + b"\r\n\r\n"))


def document_texts(records: DataFrame, payload: str = "payload", max_chars: int = MAX_TEXT_CHARS, only_markup: bool = False) -> DataFrame:
    """Responses with a payload, and their cleaned, normalized and truncated ``text``; a null payload gives no document.

    Responses of any content type count, unless ``only_markup`` leaves out empty
    payloads and those that begin with the mark of a PDF.
    """
    kept = records.where((F.col("rec_type") == "response") & F.col(payload).isNotNull())
    if only_markup:
        kept = kept.where((F.col(payload) != "") & ~F.startswith(F.col(payload), F.lit("%PDF-")))
    return kept.withColumn("text", preprocess_html(F.col(payload), max_chars))


def first_documents(texts: DataFrame, order: list[str], max_docs: int = MAX_DOCS) -> DataFrame:
    """The first ``max_docs`` texts in the given order, numbered by ``doc_id`` from 0."""
    return global_rank(texts, order, "doc_id").where(F.col("doc_id") < max_docs)


def saved_pages(pages: DataFrame, order: list[str], size: int = SAVED_PAGES, url: str = "url") -> DataFrame:
    """What the page sink keeps: the first ``size`` pages with ``file_id``, the MD5 of the URL."""
    return pages.where(F.col(url).isNotNull()).orderBy(*order).limit(size).withColumn("file_id", F.md5(F.col(url)))


def save_pages(pages: DataFrame, path: str, order: list[str], size: int = SAVED_PAGES) -> DataFrame:
    """Writes the page sink's table (parquet) and its metadata (JSON); returns the manifest."""
    kept = saved_pages(pages, order, size)
    kept.write.mode("append").parquet(f"{path}/pages")
    manifest = kept.drop("html")
    manifest.write.mode("append").json(f"{path}/metadata")
    return manifest

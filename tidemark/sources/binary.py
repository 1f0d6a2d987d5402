"""Binary formats: a firmware image's header and the spool of framed records."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The header's magic word, and the offsets and lengths of its fields.
MAGIC = "abcd5432"
FIELDS = {"version": (16, 32), "project": (48, 32), "time": (80, 16), "date": (96, 16), "idf": (112, 32)}
DIGEST = (144, 32)
#: Records longer than this mark a corrupt length.
LONGEST = 5 << 20


def header(image: Column) -> Column:
    """struct of the header's NUL-terminated strings and its SHA-256 in hex; null if the magic word is missing or the
    image is too short."""
    text = lambda at, n: F.split(F.decode(F.substring(image, at + 1, n), "ISO-8859-1"), "\0")[0]
    fields = [text(*v).alias(k) for k, v in FIELDS.items()]
    good = (F.lower(F.hex(F.substring(image, 1, 4))) == MAGIC) & (F.octet_length(image) >= sum(DIGEST))
    return F.when(good, F.struct(*fields, F.lower(F.hex(F.substring(image, DIGEST[0] + 1, DIGEST[1]))).alias("sha256")))


def records(files: DataFrame) -> DataFrame:
    """(path, place, meta, size) of each record [length, little-endian][JSON][image up to the next NUL-framed record] in
    files of (path, content), as binaryFile reads them. Reading a file ends at a length that can't be."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                at, place = 0, 0
                while at + 8 <= len(content):
                    meta, image = struct.unpack_from("<II", content, at)
                    if not 0 < meta <= LONGEST or image > LONGEST or at + 8 + meta + image > len(content):
                        break
                    rows.append((path, place, content[at + 8 : at + 8 + meta].decode("utf-8", "replace"), image))
                    at, place = at + 8 + meta + image, place + 1
            yield pd.DataFrame(rows, columns=["path", "place", "meta", "size"])

    return files.select("path", "content").mapInPandas(run, "path string, place int, meta string, size long")


def framed(meta: str, image: bytes) -> bytes:
    raw = meta.encode()
    return struct.pack("<II", len(raw), len(image)) + raw + image

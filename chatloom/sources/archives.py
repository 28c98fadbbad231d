"""ZIP archives and Word documents as rows, from binary files."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from chatloom.functions.text import XML_ENTITIES, decoded

#: The first bytes of a ZIP archive.
MAGIC = (b"PK\x03\x04", b"PK\x05\x06")


class ArchiveError(ValueError):
    """An archive that cannot be read: encrypted, damaged, or packed in a way that is not supported."""


def _open(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError) as e:
        raise ArchiveError(str(e)) from e


def read_entries(data: bytes, wanted: Callable[[str], bool] = lambda name: True) -> Iterator[tuple[str, bytes]]:
    """Names and contents of the files of an archive (stored or deflated); those that are not wanted are not unpacked."""
    archive = _open(data)
    for info in archive.infolist():
        if info.flag_bits & 1:
            raise ArchiveError(f"encrypted: {info.filename}")
        if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise ArchiveError(f"unsupported method {info.compress_type}: {info.filename}")
        if not info.is_dir() and wanted(info.filename):
            try:
                content = archive.read(info)
            except (zipfile.BadZipFile, zlib.error, EOFError, OSError, ValueError, NotImplementedError) as e:
                raise ArchiveError(f"{info.filename}: {e}") from e
            yield info.filename, content


def base_name(name: str) -> str:
    return name.replace("\\", "/").rpartition("/")[2]


def _each(files: DataFrame, read: Callable[[bytes], list[tuple]], columns: str) -> DataFrame:
    """Rows (source_id, error, and ``columns``) that ``read`` makes of each content; of one it cannot read, one with the error."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for source, data in zip(pdf["source_id"], pdf["content"], strict=True):
                try:
                    rows, error = read(bytes(data) if data is not None else b""), None
                except ArchiveError as e:
                    rows, error = [(None,) * len(names)], str(e)
                out = pd.DataFrame(rows, columns=names, dtype=object)
                yield out.assign(source_id=source, error=error)[["source_id", "error", *names]]

    return files.select("source_id", "content").mapInPandas(run, f"source_id string, error string, {columns}")


def _whole(rows: DataFrame) -> DataFrame:
    """``rows`` without the error column; an error stops the query, and says which source it was."""
    said = F.concat(F.coalesce("source_id", F.lit("null")), F.lit(": "), F.col("error"))
    return rows.where(F.when(F.col("error").isNotNull(), F.raise_error(said).cast("boolean")).otherwise(True)).drop("error")


def entries(files: DataFrame) -> DataFrame:
    """(source_id, name, content) of every file in archives (source_id, content). One that is damaged stops the query."""
    return _whole(_each(files, lambda data: list(read_entries(data)), "name string, content binary"))


@F.pandas_udf(StructType([StructField("error", StringType()), StructField("names", ArrayType(StringType()))]))
def archive_names(contents: pd.Series) -> pd.DataFrame:
    """The names of an archive's files, or why it cannot be read; null content: neither. Nothing is unpacked."""
    rows = []
    for data in contents:
        try:
            rows.append((None, None if data is None else [x.filename for x in _open(bytes(data)).infolist()]))
        except ArchiveError as e:
            rows.append((str(e), None))
    return pd.DataFrame(rows, columns=["error", "names"], dtype=object)


@F.pandas_udf(StructType([StructField("error", StringType()), StructField("text", StringType())]))
def word_text(contents: pd.Series) -> pd.DataFrame:
    """The text of a Word document, null without a document part, or why it cannot be read; null content: neither."""
    rows = []
    for data in contents:
        try:
            rows.append((None, None if data is None else _word(bytes(data))))
        except ArchiveError as e:
            rows.append((str(e), None))
    return pd.DataFrame(rows, columns=["error", "text"], dtype=object)


def bundle_texts(files: DataFrame, wanted: Callable[[str], bool]) -> DataFrame:
    """(source_id, error, name, text) of bundles (source_id, content): of an archive the files that are wanted, which alone are
    unpacked, and of anything else the whole as ``message.json``. One that cannot be read is a row with its error."""

    def read(data: bytes) -> list[tuple]:
        return list(read_entries(data, wanted)) if data[:4] in MAGIC else [("message.json", data)]

    return _each(files, read, "name string, content binary").withColumn("text", decoded(F.col("content"))).drop("content")


def entry_names(files: DataFrame) -> DataFrame:
    """(source_id, error, names) of archives; nothing is unpacked, and one that is damaged has an error instead of names."""
    return _each(files, lambda data: [([x.filename for x in _open(data).infolist()],)], "names array<string>")


def text_entries(files: DataFrame, errors: bool = False) -> DataFrame:
    """(source_id, name, text): archives as bundles of named texts. With ``errors`` a damaged one is a row with ``error``."""
    rows = _each(files, lambda data: list(read_entries(data)), "name string, content binary")
    rows = rows if errors else _whole(rows)
    return rows.withColumn("text", decoded(F.col("content"))).drop("content")


def is_archive(column: str = "content") -> Column:
    head = F.substring(column, 1, 4)
    return head.isin(*(F.lit(bytearray(m)) for m in MAGIC))


def _xml_text(x: str) -> str:
    def char(digits: str, base: int) -> str:
        try:
            return chr(int(digits, base))
        except (ValueError, OverflowError):
            return ""

    x = re.sub(r"&#x([0-9a-fA-F]+);", lambda m: char(m[1], 16), x)
    x = re.sub(r"&#([0-9]+);", lambda m: char(m[1], 10), x)
    for name, value in XML_ENTITIES.items():
        x = x.replace(f"&{name};", value)
    return x.replace("&amp;", "&")


def paragraph_lines(xml: str) -> list[str]:
    """The lines of a Word document's paragraphs, trimmed, without empty ones."""
    out = []
    for paragraph in xml.split("</w:p>"):
        text = ""
        for m in re.finditer(r"<w:t(?:\s[^>]*)?>(.*?)</w:t>|<w:(br|tab)\b[^>]*/?>", paragraph, re.S):
            text += _xml_text(m[1]) if m[1] is not None else {"br": "\n", "tab": "\t"}[m[2]]
        out.extend(line.strip() for line in text.split("\n"))
    return [line for line in out if line]


def _word(data: bytes) -> str | None:
    found = [c for _, c in read_entries(data, lambda n: base_name(n) == "document.xml")]
    return "\n".join(paragraph_lines(found[0].decode("utf-8", "replace"))) if found else None


def word_texts(files: DataFrame, errors: bool = False) -> DataFrame:
    """(source_id, text) of Word documents (source_id, content); one without a document part gives null. With ``errors`` a
    damaged one is a row with ``error``, else it stops the query."""

    rows = _each(files, lambda data: [(_word(data),)], "text string")
    return rows if errors else _whole(rows)

"""Files and directories as a corpus (path, text, byte_size).

A directory is walked on the driver, since Spark's own lister hides dot files and follows links; the executors
then read the listed files. Any doubt about a supported file ends the whole load: there are no partial corpora.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputIncomplete, InputPathNotFound, InputPermissionDenied
from ..functions import fixed


@dataclass(frozen=True)
class Limits:
    max_files: int = fixed.MAX_FILES
    max_file_bytes: int = fixed.MAX_FILE_BYTES
    max_total_bytes: int = fixed.MAX_TOTAL_BYTES

    def __post_init__(self) -> None:
        if any(type(v) is not int or v <= 0 for v in (self.max_files, self.max_file_bytes, self.max_total_bytes)) or self.max_total_bytes < self.max_file_bytes:
            raise ValueError("limits are positive whole numbers, the total no less than a file's")


@dataclass(frozen=True)
class Corpus:
    docs: DataFrame
    inspected: int
    skipped: int
    total_bytes: int


def is_supported(name: str) -> bool:
    name = os.path.basename(name).lower()
    return name == ".env" or name.startswith(".env.") or Path(name).suffix[1:] in fixed.EXTENSIONS


def manifest(root: str | Path) -> tuple[list[tuple[str, str]], int]:
    """(relative path, full path) of the supported files, by relative path, and how many entries were skipped."""
    top = Path(root)
    try:
        if top.is_symlink():
            raise InputIncomplete()
        mode = top.stat().st_mode
        base = top.resolve(strict=True)
        if stat.S_ISREG(mode):
            return ([(top.name, str(base))], 0) if is_supported(top.name) else ([], 1)
        if not stat.S_ISDIR(mode):
            raise InputIncomplete()
        found, skipped = [], 0

        def stop(error: OSError) -> None:
            raise error

        for folder, folders, files in os.walk(base, onerror=stop, followlinks=False):
            links = [d for d in folders if os.path.islink(os.path.join(folder, d))]
            skipped += len(links)
            folders[:] = sorted(set(folders) - set(links))
            for name in files:
                full = os.path.join(folder, name)
                if stat.S_ISREG(os.lstat(full).st_mode) and is_supported(name):
                    found.append((Path(full).resolve(strict=True).relative_to(base).as_posix(), full))
                else:
                    skipped += 1
        return sorted(found), skipped
    except FileNotFoundError:
        raise InputPathNotFound() from None
    except PermissionError:
        raise InputPermissionDenied() from None
    except (OSError, RuntimeError, ValueError):
        raise InputIncomplete() from None


def _read(full: str, most: int) -> tuple[str | None, int]:
    """A stable snapshot of a file as strict UTF-8 without its byte order mark; None if there is any doubt."""
    try:
        fd = os.open(full, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0))
        with os.fdopen(fd, "rb") as f:
            before = os.fstat(f.fileno())
            data = f.read(most + 1)
            after = os.fstat(f.fileno())
        same = (before.st_ino, before.st_dev, before.st_size, before.st_mtime_ns) == (after.st_ino, after.st_dev, after.st_size, after.st_mtime_ns)
        if not stat.S_ISREG(before.st_mode) or len(data) > most or not same or after.st_size != len(data):
            return None, 0
        return data.decode("utf-8-sig"), len(data)
    except (OSError, UnicodeDecodeError):
        return None, 0


def load_path(spark: SparkSession, root: str | Path, limits: Limits | None = None) -> Corpus:
    limits = limits or Limits()
    listed, skipped = manifest(root)
    if len(listed) > limits.max_files:
        raise InputIncomplete()
    most = limits.max_file_bytes

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [_read(f, most) for f in part["full"]]
            yield pd.DataFrame({"path": part["path"], "text": [t for t, _ in got], "byte_size": [n for _, n in got]})

    rows = spark.createDataFrame(listed, "path string, full string").repartition(max(1, min(len(listed), 64)))
    docs = rows.mapInPandas(read, "path string, text string, byte_size bigint").persist()
    total = docs.agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("bad"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("b")).first()
    if total["bad"] or total["b"] > limits.max_total_bytes:
        docs.unpersist()
        raise InputIncomplete()
    return Corpus(docs, total["n"], skipped, total["b"])


def from_table(docs: DataFrame, path: str = "path", text: str = "text") -> Corpus:
    """A corpus of table rows; limits don't apply to tables."""
    own = docs.select(F.col(path).alias("path"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("byte_size", F.octet_length("text").cast("bigint"))
    total = own.agg(F.count("*").alias("n"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("b")).first()
    return Corpus(own, total["n"], 0, total["b"])

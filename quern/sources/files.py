"""Files as facts: walking a tree, path chains, chunks, sanitising."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import ancestors, parent_path

EXCLUDED = (".git", "node_modules", "target", "__pycache__", ".venv")
CHUNK_BYTES, OVERLAP_LINES, OVERLAP_BYTES = 32_768, 2, 1_024  # fixed values


def walk(spark: SparkSession, root: str, pattern: str = "*", excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(path, size_bytes, modified_at, content) of the files below root, without excluded directories."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    relative = F.regexp_replace(F.col("path"), r"^.*?" + base.replace(".", r"\.") + "/", "")
    out = found.select(relative.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "content")
    skip = "|".join(x.replace(".", r"\.") for x in excluded)
    return out.where(~F.col("path").rlike(rf"(^|/)({skip})(/|$)"))


def tree(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (path, kind) of all files and their directories, and (parent, child) of what contains what."""
    chain = paths.select(F.col("path").alias("file"), F.explode(ancestors(F.col("path"))).alias("path"))
    nodes = chain.groupBy("path").agg(F.when(F.bool_or(F.col("path") == F.col("file")), "file").otherwise("directory").alias("kind"))
    contains = nodes.select(parent_path(F.col("path")).alias("parent"), F.col("path").alias("child")).where("parent IS NOT NULL")
    return nodes, contains


def looks_binary(head: bytes) -> bool:
    """By the first 8000 bytes: four NULs in a row, or over 30 % bytes that aren't text."""
    head = head[:8000]
    odd = sum(b < 9 or 13 < b < 32 and b != 27 or b == 127 for b in head)
    return b"\0\0\0\0" in head or 100 * odd > 30 * len(head)


def sanitise(data: bytes) -> bytes:
    """Each byte of invalid UTF-8, and each NUL, becomes a space; the length stays."""
    out, at = bytearray(), 0
    while at < len(data):
        try:
            data[at:].decode()
            out += data[at:]
            break
        except UnicodeDecodeError as e:
            out += data[at : at + e.start] + b" " * (e.end - e.start)
            at += e.end
    return bytes(out).replace(b"\0", b" ")


def plan_chunks(data: bytes, most: int = CHUNK_BYTES, lines: int = OVERLAP_LINES, overlap: int = OVERLAP_BYTES) -> list[tuple[int, int]]:
    """[start, end) of chunks: whole lines up to most bytes, a longer line cut at a character; each but the first starts up
    to two lines earlier, if those are within overlap bytes."""
    out, at, n = [], 0, len(data)
    while at < n:
        end = min(at + most, n)
        if end < n:
            line = data.rfind(b"\n", at, end) + 1
            if line > at:
                end = line
            else:
                while end > at + 1 and data[end] & 0xC0 == 0x80:
                    end -= 1
        out.append((at, end))
        if end >= n:
            break
        back = end
        for _ in range(lines):
            start = data.rfind(b"\n", 0, max(back - 1, 0)) + 1
            if end - start > overlap or start <= at or start == back:
                break
            back = start
        at = back if back > at else end
    return out


def chunks(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chunk, start_byte, end_byte) of each file's text."""

    @F.pandas_udf("array<struct<start_byte:bigint,end_byte:bigint>>")
    def plan(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start_byte": s, "end_byte": e} for s, e in plan_chunks((t or "").encode())])

    found = files.select(F.col(key), F.posexplode(plan(F.col(text))).alias("chunk", "r"))
    return found.select(key, "chunk", "r.start_byte", "r.end_byte")


def position(data: bytes, offset: int, units: str = "utf-8") -> tuple[int, int]:
    """Line and column, both from 0, of a byte offset; columns in UTF-8, UTF-16 or UTF-32 units."""
    start = data.rfind(b"\n", 0, offset) + 1
    line = data[start:offset].decode("utf-8", "ignore")
    width = {"utf-8": offset - start, "utf-16": len(line.encode("utf-16-le")) // 2, "utf-32": len(line)}
    return data.count(b"\n", 0, offset), width[units]

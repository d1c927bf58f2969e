"""Benchmark decontamination by a prefix-filtered set join with exact containment.

A window is ``window`` consecutive words of an item (the whole item, if it is shorter). Its set is its shingles of
``shingle`` words. Containment must be whole, so one shingle of a window is prefix enough: each window is indexed by
the shingle that is rarest in all documents. A document's shingle that equals an indexed one gives a window and, from
the shingle's place in it, the only start it can have; starts that leave the document on either side are dropped
(positional and length bounds), and what is left is compared word by word.

The index goes to every executor in blocks of at most BLOCK_BYTES of item text, one after the other over the same rows,
so its size is bounded however large the benchmark is; documents are never shuffled.

Null text has no words, and so has no hits; items of null text have no window. Items of equal text count each by their
id; an item of null id has windows that hit, but no id to list. Repeated rows of items count once, repeated rows of
documents each get a row. Other columns pass through, and those named like a result are replaced.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.bytescan import U64, Rolling, mix, text_bytes, words
from quern.llm.shared import small_batches, table

WINDOW = 10
SHINGLE = 5
BLOCK_BYTES = 2 << 20
CHUNK = 2 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_STEP = [pow(0x9E3779B97F4A7C15, k, 2**64) for k in range(64)]
_ROLLING: list[Rolling] = []


class _Words:
    """The words of some texts, and hashes of runs of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        if not _ROLLING:
            _ROLLING.append(Rolling(1009))
        self.data = _LOWER[data]
        self.starts, self.ends, self.of_text = words(self.data, offsets, _IS_WORD)
        self.hash = _ROLLING[0].ranges(_ROLLING[0].prefix(self.data), self.starts, self.ends)
        self.last = np.repeat(self.of_text[1:], np.diff(self.of_text))

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of n words within one text start, and their hashes."""
        at = np.flatnonzero(np.arange(n, len(self.starts) + n) <= self.last)
        total = np.zeros(len(at), U64)
        for k in range(n):
            total += self.hash[at + k] * U64(_STEP[k])
        return at, mix(total)

    def run(self, at: int, n: int) -> bytes:
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[at : at + n], self.ends[at : at + n]))


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int, _Words]]:
    """Rows lo to hi with their words, about CHUNK bytes at once."""
    data, offsets = text_bytes(texts)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, side="right")) - 1)
        yield lo, hi, _Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


class Items:
    """A block of items: its distinct windows, who has them, and their shingles."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int, shingle: int) -> None:
        self.owners: dict[bytes, set[str]] = defaultdict(set)
        inner: dict[bytes, tuple[np.ndarray, int]] = {}
        for row_0, _, w in _chunks(pa.array(texts, pa.string())):
            first = w.of_text.tolist()
            for row, (lo, hi) in enumerate(zip(first, first[1:]), start=row_0):
                n = min(window, hi - lo)
                for at in range(lo, hi - n + 1) if n else ():
                    text = w.run(at, n)
                    self.owners[text] |= {ids[row]} - {None}
                    if text not in inner:
                        inner[text] = (w.hash[at : at + n], n)
        self.windows = list(self.owners)
        self.sizes = [inner[t][1] for t in self.windows]
        self.shingles: list[list[tuple[int, int]]] = []  # of each window: (length, hash) by place
        for t in self.windows:
            h, n = inner[t]
            k = min(shingle, n)
            self.shingles.append([(k, int(mix(np.array([np.sum(h[p : p + k] * np.array(_STEP[:k], U64), dtype=U64)]))[0])) for p in range(n - k + 1)])

    def distinct(self) -> dict[int, np.ndarray]:
        """Sorted distinct shingle hashes by length."""
        out = defaultdict(set)
        for s in self.shingles:
            for k, h in s:
                out[k].add(h)
        return {k: np.array(sorted(v), U64) for k, v in out.items()}

    def index(self, counts: dict[tuple[int, int], int]) -> dict[int, tuple[np.ndarray, list[list[tuple[int, int]]]]]:
        """By shingle length: sorted prefix shingles, and the windows of each with the shingle's place in them."""
        by: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for w, s in enumerate(self.shingles):
            place = min(range(len(s)), key=lambda p: (counts.get(s[p], 0), s[p][1], p))
            k, h = s[place]
            by[k][h].append((w, place))
        return {k: (np.array(sorted(v), U64), [v[h] for h in sorted(v)]) for k, v in by.items()}


def _sieve(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[(hashes & U64((1 << 20) - 1)).astype(np.int64)] = True
    return out


def _matches(found: tuple[np.ndarray, np.ndarray], hashes: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places among the runs whose hash is one of hashes, and which."""
    at, h = found
    may = np.flatnonzero(sieve[(h & U64((1 << 20) - 1)).astype(np.int64)])
    k = np.minimum(np.searchsorted(hashes, h[may]), len(hashes) - 1)
    hit = hashes[k] == h[may]
    return at[may[hit]], k[hit]


def _frequencies(df: DataFrame, text: str, wanted: dict[int, np.ndarray]) -> dict[tuple[int, int], int]:
    """How often each wanted shingle occurs in all texts."""
    sent = df.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {k: np.zeros(len(h), np.int64) for k, h in sent.value.items()}
        sieves = {k: _sieve(h) for k, h in sent.value.items()}
        for batch in batches:
            for _, _, w in _chunks(batch.column(0)):
                for k, h in sent.value.items():
                    totals[k] += np.bincount(_matches(w.runs(k), h, sieves[k])[1], minlength=len(h))
        for k, t in totals.items():
            some = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array(t[some], pa.int64())], names=["k", "i", "n"])

    rows = df.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(count, "k int, i int, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).collect()  # at most the block's shingles
    return {(r["k"], int(wanted[r["k"]][r["i"]])): r["n"] for r in rows}


_STATE = [T.StructField("_words", T.LongType()), T.StructField("_hits", T.ArrayType(T.IntegerType())), T.StructField("_items", T.ArrayType(T.StringType()))]


def _scan(df: DataFrame, text: str, items: Items, index: dict) -> DataFrame:
    """Adds the hits of one block of items to _words, _hits (starts and ends of word spans, alternating) and _items."""
    sent = df.sparkSession.sparkContext.broadcast((items.windows, items.sizes, [sorted(items.owners[w]) for w in items.windows], index))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, sizes, owners, index = sent.value
        sieves = {k: _sieve(h) for k, (h, _) in index.items()}
        for batch in batches:
            spans = [set(zip(h[::2], h[1::2])) if h else set() for h in batch.column("_hits").to_pylist()]
            held = [set(x or ()) for x in batch.column("_items").to_pylist()]
            counts = np.zeros(batch.num_rows, np.int64)
            for lo, hi, w in _chunks(batch.column(text).cast(pa.string())):
                counts[lo:hi] = np.diff(w.of_text)
                for k, (hashes, entries) in index.items():
                    at, which = _matches(w.runs(k), hashes, sieves[k])
                    rows = np.searchsorted(w.of_text, at, side="right") - 1
                    for q, e, row in zip(at.tolist(), which.tolist(), rows.tolist()):
                        for window, place in entries[e]:
                            start, n = q - place, sizes[window]
                            if start >= w.of_text[row] and start + n <= w.of_text[row + 1] and w.run(start, n) == windows[window]:
                                spans[lo + row].add((start - int(w.of_text[row]), start - int(w.of_text[row]) + n))
                                held[lo + row].update(owners[window])
            flat = [[x for s in sorted(r) for x in s] for r in spans]
            yield pa.RecordBatch.from_arrays([batch.column("meta"), batch.column("text"), pa.array(counts), pa.array(flat, pa.list_(pa.int32())), pa.array([sorted(x) for x in held], pa.list_(pa.string()))], names=["meta", "text", *(f.name for f in _STATE)])

    return df.mapInArrow(scan, df.schema)


def decontaminate(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES, keep_text: bool = True) -> DataFrame:
    """df with n_words, n_hit (words inside an occurrence), hit_spans (word spans), items (ids) and contaminated."""
    small_batches(df.sparkSession)
    size = items.agg(F.sum(F.octet_length(F.col(f"`{item_text}`")))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    named = items.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{item_text}`").alias("text")).where("text IS NOT NULL").distinct()
    rest = [c for c in df.columns if c not in RESULT and (keep_text or c != text)]
    rows = df.select(F.struct(F.lit(0).alias("__none"), *(F.col(f"`{c}`") for c in rest if c != text)).alias("meta"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.withColumns({"_words": F.lit(None).cast("long"), "_hits": F.lit(None).cast("array<int>"), "_items": F.lit(None).cast("array<string>")})
    for k in range(blocks):
        part = named.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()  # about block_bytes of text
        block = Items([r["id"] for r in part], [r["text"] for r in part], window, shingle)
        if block.windows or k == 0:
            rows = _scan(rows, "text", block, block.index(_frequencies(df, text, block.distinct())))
    return _spelled(rows, rest, text)


RESULT = ("n_words", "n_hit", "hit_spans", "items", "contaminated")


def _spelled(rows: DataFrame, rest: list[str], text: str) -> DataFrame:
    starts = F.transform(F.sequence(F.lit(1), F.size("_hits"), F.lit(2)), lambda i: F.struct(F.element_at("_hits", i).alias("start"), F.element_at("_hits", i + 1).alias("end")))
    spans = F.when(F.size("_hits") > 0, starts).otherwise(F.expr("CAST(array() AS array<struct<start:int,end:int>>)"))
    # spans are in order of their start, so each adds what lies beyond the furthest end so far
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    total = F.aggregate("hit_spans", state, lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["to"]))).cast("long").alias("n"), F.greatest(s["to"], x["end"]).alias("to")))
    out = rows.withColumn("hit_spans", spans).withColumn("n_hit", total["n"])
    return out.select(*(F.col("text").alias(c) if c == text else F.col(f"meta.`{c}`") for c in rest), F.col("_words").alias("n_words"), "n_hit", "hit_spans", F.col("_items").alias("items"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep_text=False)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bl AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bp AS (SELECT item_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM bl),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS s FROM bp),
l AS (SELECT DISTINCT n FROM bw),
dp AS (SELECT rid, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, l WHERE len(w) >= n),
h AS (SELECT rid, i, n, item_id FROM (SELECT rid, i, n, array_to_string(w[i + 1 : i + n], ' ') AS s FROM dp) JOIN bw USING (n, s)),
hp AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hp USING (rid) LEFT JOIN hi USING (rid)
"""

"""Removal of every byte that lies in a 200-byte string found more than once, by difference-cover blockwise sorting.

A difference cover D modulo v is a set of residues such that for any two positions i and j there is a shift d < v with
both i + d and j + d in the cover. So if the strings of ``length`` bytes at i and j are equal, both hold a cover
position at the same shift d, with the same d bytes before it and the same length - d bytes from it on. The steps:

1. Texts are gathered into blocks of a few MB, stored once, bucketed by block, so that answers come back to them without
   moving them again. Equal whole texts are found by a cryptographic digest; only the first of them goes on.
2. The cover's positions (12 of 133) are named by a 32-bit hash of their next length - v + 1 bytes. One bit comes back for
   each name: whether it occurs more than once. Names only prune: equal strings have equal names at their common shift, so
   a name found once leads to none, and a chance agreement costs work, not a wrong result.
3. The cover positions that are left go, with the bytes around them, to the reducer of their name, ``rounds`` ranges of
   names one after the other, so that no more than one range is on the move. A reducer sorts their suffixes by their
   next ``length`` bytes, which gives their ranks and how many bytes neighbours have in common. Then it takes one bucket
   of suffixes after the other, those that start d bytes before a cover position, for each shift d: they are sorted by
   those d bytes, and ties are resolved by the cover position's rank. Suffixes of one bucket that agree in all of
   ``length`` bytes are repeated. All this compares the bytes themselves. One bit for each shift comes back.
4. Each block adds up what its repeated strings cover.

A block sends equal surroundings of a cover position once. A name that more than ``hot`` blocks hold would still make a
large group; its cover positions go out by ranges of HOT_SHIFTS shifts instead, each to the reducer of the bytes that
all strings of the range share, so a group has in common all but a few of the ``length`` bytes.

Null text is empty. Texts shorter than ``length`` lose nothing. Strings don't cross texts. All other columns pass
through, whatever their names; result columns replace columns of the same name. A text larger than a block makes a
block of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.bytescan import U64, Rolling, text_bytes
from quern.llm.shared import materialize, plan_bytes, remove, scratch, settings, shuffle_partitions, store, table, trim

LENGTH = 200
ORDER = 11  # of the field; v = ORDER**2 + ORDER + 1
BLOCK_BYTES = 1 << 20
NAMES = 1 << 20  # a reducer sorts at once, about
ITEMS = 1 << 15  # cover positions with their surroundings; the same
ROUNDS = 3
PIECES = 8  # of a round, which a block handles one after the other
HOT = 1 << 16  # blocks that hold a name
HOT_SHIFTS = 8
DIGEST = 16


def difference_cover(q: int) -> tuple[int, list[int]]:
    """Singer's construction for a prime q: v = q*q + q + 1 and q + 1 residues whose differences take every value modulo v.

    The exponents of a primitive element of GF(q**3) at which the coefficient of x**2 vanishes, modulo v.
    """
    v = q * q + q + 1
    for c0 in range(1, q):
        for c1 in range(q):
            for c2 in range(q):  # x**3 = c2 x**2 + c1 x + c0
                e, found, order = (1, 0, 0), [], 0
                while True:
                    if e[2] == 0 and order < v:
                        found.append(order)
                    a, b, c = e
                    e = (c * c0 % q, (a + c * c1) % q, (b + c * c2) % q)
                    order += 1
                    if e == (1, 0, 0) or order >= q**3:
                        break
                if order == q**3 - 1 and len({(a - b) % v for a in found for b in found}) == v:
                    return v, found
    raise ValueError(f"no cover for {q}")


def _blocks(df: DataFrame, text: str, buckets: int, block_bytes: int) -> DataFrame:
    """Rows (b, block, ends, data, meta): texts end to end, with the other columns of their rows."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != text] or [F.lit(0).alias("__none")]
    rows = df.select(F.struct(*rest).alias("meta"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([T.StructField("b", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("data", T.BinaryType()), T.StructField("meta", T.ArrayType(rows.schema["meta"].dataType))])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        size = made = 0

        def row() -> pa.RecordBatch:
            ends = np.cumsum(np.concatenate([np.diff(o) for _, o, _ in held]))
            meta = pa.concat_arrays([m for _, _, m in held])
            return pa.RecordBatch.from_arrays(
                [pa.array([task % buckets], pa.int32()), pa.array([(task << 32) | made], pa.int64()), pa.array([ends], pa.list_(pa.int64())), pa.array([np.concatenate([d for d, _, _ in held]).tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(meta)], pa.int32()), meta)],
                names=["b", "block", "ends", "data", "meta"],
            )

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            at = 0
            while at < batch.num_rows:
                room = block_bytes - size
                n = max(int(np.searchsorted(offsets[at + 1 :] - offsets[at], room, side="right")), 0 if held else 1)
                n = min(n, batch.num_rows - at)
                if n:
                    part = offsets[at : at + n + 1]
                    held.append((data[part[0] : part[-1]], part, batch.column(0).slice(at, n)))
                    size += int(part[-1] - part[0])
                    at += n
                if at < batch.num_rows:
                    yield row()
                    held, size, made = [], 0, made + 1
        if held:
            yield row()

    return rows.mapInArrow(gather, schema)


class _Block:
    """One block with what the exchanges have answered so far."""

    def __init__(self, cfg: dict, ends: np.ndarray, data: np.ndarray, answers: dict[int, bytes]) -> None:
        self.cfg, self.data, self.ends, self.answers = cfg, data, ends, answers
        self.starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.lens = ends - self.starts

    def reducer(self, h: np.ndarray, n: int) -> np.ndarray:
        return ((h >> U64(32)) * U64(n)) >> U64(32)

    def texts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Texts long enough to hold a window: their numbers; distinct digests; their reducers; the digest of each; its first text."""
        long = np.flatnonzero(self.lens >= self.cfg["length"])
        raw = b"".join(hashlib.blake2b(self.data[s:e], digest_size=DIGEST).digest() for s, e in zip(self.starts[long].tolist(), self.ends[long].tolist()))
        names, first, inverse = np.unique(np.frombuffer(raw, f"S{DIGEST}"), return_index=True, return_inverse=True)
        heads = names.view(np.uint8).reshape(-1, DIGEST)[:, :8].copy().view(">u8").ravel().astype(U64)
        return long, names, self.reducer(heads, self.cfg["digests"]), inverse, first

    def copies(self) -> np.ndarray:
        """Of each text, whether it is equal to another (1: the first of them, 2: the others)."""
        long, names, reducers, inverse, first = self.texts()
        state = _bytes(self.answers, 0, self.cfg["digests"], reducers)
        twice = np.bincount(inverse, minlength=len(names)) > 1
        is_first = np.zeros(len(long), bool)
        is_first[first] = True
        out = np.zeros(len(self.lens), np.uint8)
        out[long] = np.where((state[inverse] == 2) | (twice[inverse] & ~is_first), 2, np.where((state[inverse] == 1) | twice[inverse], 1, 0))
        return out

    def cover(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The cover's positions in texts to use; their hashes; distinct names (reducer above 32 bits); the name of each; how often the block has it."""
        cover, span = self.cfg["cover"], self.cfg["length"] - self.cfg["v"] + 1
        lens, starts = self.lens[use], self.starts[use]
        all_at = (np.arange(0, int(lens.max(initial=0)) + self.cfg["v"], self.cfg["v"])[:, None] + cover[None, :]).ravel()
        counts = np.searchsorted(all_at, np.maximum(lens - span + 1, 0))
        at = np.concatenate([all_at[:n] + s for n, s in zip(counts.tolist(), starts.tolist())] or [np.zeros(0, np.int64)])
        rolling = _rolling()
        h = rolling.ranges(rolling.prefix(self.data), at, at + span)
        names, inverse, times = np.unique((self.reducer(h, self.cfg["names"]) << U64(32)) | (h & U64(0xFFFFFFFF)), return_inverse=True, return_counts=True)
        return at, h, names, inverse, times

    def sites(self, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cover positions whose names occur more than once, their hashes, whether their names are hot, and their texts' bounds."""
        at, h, names, inverse, times = self.cover(copies != 2)
        again, hot = _bits(self.answers, self.cfg["digests"], self.cfg["names"], names >> U64(32))
        again = (again | (times > 1))[inverse]
        keep = np.flatnonzero(again)
        at = at[keep]
        text = np.searchsorted(self.starts, at, side="right") - 1
        return at, h[keep], hot[inverse][keep], self.starts[text], self.ends[text]

    def items(self, copies: np.ndarray, turn: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each range of shifts and each piece of the reducers: the range's number, the cover positions, distinct surroundings,
        their reducers, and those of each position. A reducer is in one piece, so a block holds the surroundings of one piece only."""
        at, h, hot, starts, ends = self.sites(copies)
        length, n, pieces = self.cfg["length"], self.cfg["reducers"], PIECES * self.cfg["rounds"]
        reach, rolling = 2 * length, _rolling()
        prefix = rolling.prefix(self.data) if hot.any() else None
        windows = np.lib.stride_tricks.sliding_window_view(np.pad(self.data, reach), reach)
        for kind, (lo, hi) in enumerate(self.cfg["ranges"]):
            least, most = np.maximum(lo, length - (ends - at)), np.minimum(hi - 1, at - starts)
            fit = np.flatnonzero((hot if kind else ~hot) & (least <= most))
            if not len(fit):
                continue
            key = rolling.ranges(prefix, at[fit] - lo, at[fit] + length - hi + 1) if kind else h[fit]
            of = self.reducer(key, n)
            for piece in range(pieces) if turn is None else range(turn * PIECES, (turn + 1) * PIECES):
                now = (of >= U64(piece * n // pieces)) & (of < U64((piece + 1) * n // pieces))
                if not now.any():
                    continue
                some, r = fit[now], of[now]
                a, left, right = at[some], hi - 1, length - lo
                width = 7 + left + right
                rows = np.empty((len(a), width), np.uint8)
                rows[:, :4] = r.astype(">u4").view(np.uint8).reshape(-1, 4)
                rows[:, 4], rows[:, 5], rows[:, 6] = 0, least[some], most[some]
                around = windows[a + reach - left, : left + right]
                for rim, room, steps in ((np.flatnonzero(a - starts[some] < left), a - starts[some], left - 1 - np.arange(left + right)), (np.flatnonzero(ends[some] - a < right), ends[some] - a - 1, np.arange(left + right) - left)):
                    around[rim] *= steps <= room[rim][:, None]  # bytes of other texts
                rows[:, 7 : 7 + left], rows[:, 7 + left :] = around[:, :left][:, ::-1], around[:, left:]
                made, inverse, times = np.unique(rows.view(f"S{width}").ravel(), return_inverse=True, return_counts=True)
                made = made.view(np.uint8).reshape(-1, width).copy()
                made[:, 4] = times > 1
                yield kind, a, made[:, 4:], made[:, :4].copy().view(">u4").ravel().astype(np.int64), inverse

    def removed(self) -> np.ndarray:
        """For each byte, whether it goes."""
        copies = self.copies()
        mark, starts = np.zeros(len(self.data) + 1, np.int32), np.zeros(len(self.data), bool)
        for kind, a, made, reducers, inverse in self.items(copies):
            lo, hi = self.cfg["ranges"][kind]
            shifts = np.zeros((len(made), hi - lo), bool)
            bounds = np.searchsorted(reducers, np.arange(self.cfg["reducers"] + 1))
            for r in np.flatnonzero(np.diff(bounds)).tolist():
                got = self.answers.get(self.cfg["base"] + kind * self.cfg["reducers"] + r)
                if got is not None:
                    packed = np.frombuffer(got, np.uint8).reshape(bounds[r + 1] - bounds[r], -1)
                    shifts[bounds[r] : bounds[r + 1]] = np.unpackbits(packed, axis=1, count=hi - lo).astype(bool)
            for k in range(0, len(a), 1 << 12):
                i, d = np.nonzero(shifts[inverse[k : k + (1 << 12)]])
                starts[a[k + i] - lo - d] = True
        starts = np.flatnonzero(starts)
        mark[starts] += 1
        mark[starts + self.cfg["length"]] -= 1
        whole = copies > 0
        np.add.at(mark, self.starts[whole], 1)
        np.add.at(mark, self.ends[whole], -1)
        return np.cumsum(mark)[:-1] > 0


def _common(rows: np.ndarray) -> np.ndarray:
    """How many first bytes each row has in common with the row before it; -1 for the first."""
    out = np.full(len(rows), -1, np.int64)
    for lo in range(1, len(rows), 1 << 15):
        a, b = rows[lo - 1 : min(lo - 1 + (1 << 15), len(rows) - 1)], rows[lo : lo + (1 << 15)]
        differ = np.concatenate([a != b, np.ones((len(a), 1), bool)], 1)
        out[lo : lo + len(a)] = differ.argmax(1)
    return out


def repeated_shifts(items: np.ndarray, lo: int, hi: int, length: int) -> np.ndarray:
    """For each item and each shift d from lo to hi - 1, whether the string of ``length`` bytes that starts d bytes before
    its cover position is also in another place.

    An item is a row of bytes: whether it stands for more than one place, the least and the most shift that its text
    has room for, the hi - 1 bytes before its cover position, the nearest first, and the length - lo bytes from it on.
    """
    many, before, after = items[:, 0] > 0, items[:, 3 : 2 + hi], items[:, 2 + hi :]
    # rank the cover positions by the bytes from them on; equal items come together
    full = np.ascontiguousarray(np.concatenate([after, before, items[:, 1:3]], 1))
    order = np.argsort(full.view(f"S{full.shape[1]}").ravel(), kind="stable")
    full, many = full[order], many[order]
    fresh = np.ones(len(full), bool)
    fresh[1:] = (full[1:] != full[:-1]).any(1)
    which = np.cumsum(fresh) - 1
    at = np.flatnonzero(fresh)
    many = np.logical_or.reduceat(many, at) | (np.diff(np.append(at, len(full))) > 1)
    full = full[at]
    after, before, least, most = full[:, : length - lo], full[:, length - lo : -2], full[:, -2].astype(np.int64), full[:, -1].astype(np.int64)
    shifts = np.arange(lo, hi)
    out = many[:, None] & (least[:, None] <= shifts) & (shifts <= most[:, None])
    same_after = _common(after)
    # a group shares what all strings of the range have in common after the cover position; one alone is done
    group = np.cumsum(same_after < length - hi + 1)
    social = np.flatnonzero((np.bincount(group)[group] > 1))
    if len(social):
        after_same, group, least, most = same_after[social], group[social], least[social], most[social]
        after_same[np.flatnonzero(np.diff(group, prepend=-1))] = -1
        named = np.concatenate([group.astype(">u4").view(np.uint8).reshape(-1, 4), before[social]], 1)
        by_before = np.argsort(np.ascontiguousarray(named).view(f"S{named.shape[1]}").ravel(), kind="stable")
        before_same = _common(named[by_before]) - 4
        for d in range(lo, hi):  # a bucket of suffixes: by the d bytes before the cover position, ties by its rank
            room = np.flatnonzero((least <= d) & (d <= most))
            if len(room) < 2:
                continue
            key = np.empty(len(social), np.int64)
            key[by_before] = np.cumsum(before_same < d)
            key = (np.cumsum(after_same < length - d) << 32 | key)[room]
            by = np.argsort(key)
            tied = key[by[1:]] == key[by[:-1]]
            hit = np.zeros(len(room), bool)
            hit[by[1:]] = tied
            hit[by[:-1]] |= tied
            out[social[room[hit]], d - lo] = True
    answer = np.empty((len(items), hi - lo), bool)
    answer[order] = out[which]
    return answer


def _bits(answers: dict[int, bytes], base: int, n: int, reducers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both bits of sorted names: reducers has each name's, ascending."""
    out = np.zeros((2, len(reducers)), bool)
    bounds = np.searchsorted(reducers, np.arange(n + 1, dtype=U64))
    for r in np.flatnonzero(np.diff(bounds)).tolist():
        lo, hi = bounds[r], bounds[r + 1]
        if base + r in answers:
            out[:, lo:hi] = np.unpackbits(np.frombuffer(answers[base + r], np.uint8).reshape(2, -1), axis=1, count=hi - lo)
    return out[0], out[1]


def _bytes(answers: dict[int, bytes], base: int, n: int, reducers: np.ndarray) -> np.ndarray:
    out = np.zeros(len(reducers), np.uint8)
    bounds = np.searchsorted(reducers, np.arange(n + 1, dtype=U64))
    for r in np.flatnonzero(np.diff(bounds)).tolist():
        if base + r in answers:
            out[bounds[r] : bounds[r + 1]] = np.frombuffer(answers[base + r], np.uint8)
    return out


_ROLLING: list[Rolling] = []


def _rolling() -> Rolling:
    """One for each worker: its powers are kept."""
    if not _ROLLING:
        _ROLLING.append(Rolling(20240229))
    return _ROLLING[0]


def _each(batches: Iterator[pa.RecordBatch], cfg: dict) -> Iterator[tuple[pa.RecordBatch, int, _Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            data = np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8)
            ends = batch.column("ends")[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
            answers = {}
            if "answers" in batch.schema.names and batch.column("answers")[i].is_valid:
                got = batch.column("answers")[i].values
                answers = dict(zip(got.field("g").to_pylist(), got.field("bits").to_pylist()))
            yield batch, i, _Block(cfg, ends, data, answers)
    trim()


QUESTION = "g int, b int, block long, names binary"
ANSWER = "g int, b int, block long, bits binary, hits long"


def _rows(batch: pa.RecordBatch, i: int, base: int, reducers: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """Sorted values, one row for each reducer that gets any."""
    found, lo = np.unique(reducers, return_index=True)
    parts = [p.tobytes() for p in np.split(values, lo[1:])] if len(found) else []
    b, block = batch.column("b")[i].as_py(), batch.column("block")[i].as_py()
    return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64) + base, pa.int32()), pa.array([b] * len(parts), pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["g", "b", "block", "names"])


def _ask_texts(cfg: dict):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, block in _each(batches, cfg):
            _, names, reducers, _, _ = block.texts()
            yield _rows(batch, i, 0, reducers, names)

    return ask


def _ask_cover(cfg: dict):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, block in _each(batches, cfg):
            _, _, names, _, _ = block.cover(block.copies() != 2)
            yield _rows(batch, i, cfg["digests"], names >> U64(32), (names & U64(0xFFFFFFFF)).astype(np.uint32))

    return ask


def _ask_items(cfg: dict, turn: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, block in _each(batches, cfg):
            for kind, _, made, reducers, _ in block.items(block.copies(), turn):
                yield _rows(batch, i, cfg["base"] + kind * cfg["reducers"], reducers, made)

    return ask


def _answer(cfg: dict):
    """Answers a group's questions: for digests which block has the first of several, for names whether more than one block
    has them, for surroundings of cover positions which shifts give repeated strings."""

    def answer(group: pa.Table) -> pa.Table:
        g = group.column("g")[0].as_py()
        order = np.argsort(group.column("block").to_numpy(), kind="stable")
        group = group.take(pa.array(order)).combine_chunks()
        parts = [x.as_buffer() for x in group.column("names").chunk(0)]
        if g >= cfg["digests"] + cfg["names"]:
            lo, hi = cfg["ranges"][(g - cfg["base"]) // cfg["reducers"]]
            each = [np.frombuffer(x, np.uint8).reshape(-1, 2 + hi + cfg["length"] - lo) for x in parts]
            shifts = np.packbits(repeated_shifts(np.concatenate(each), lo, hi, cfg["length"]), axis=1)
            out = [x.tobytes() for x in np.split(shifts, np.cumsum([len(x) for x in each])[:-1])]
            hits = [0] * len(out)
        else:
            each = [np.frombuffer(x, np.uint32 if g >= cfg["digests"] else f"S{DIGEST}") for x in parts]
            inverse = np.unique(np.concatenate(each), return_inverse=True)[1]
            times = np.bincount(inverse)  # a block sends a name once
            seen = np.zeros(len(times), bool)
            out, hits = [], []
            for k in np.split(inverse, np.cumsum([len(x) for x in each])[:-1]):
                hit = times[k] > 1
                hits.append(int(hit.sum()))
                if g < cfg["digests"]:
                    out.append(np.where(hit, np.where(seen[k], 2, 1), 0).astype(np.uint8).tobytes())
                    seen[k] = True
                else:
                    out.append(np.packbits(hit).tobytes() + np.packbits(times[k] > cfg["hot"]).tobytes())
        return pa.table([group.column("g"), group.column("b"), group.column("block"), pa.array(out, pa.binary()), pa.array(hits, pa.int64())], names=["g", "b", "block", "bits", "hits"])

    return answer


def dedup_substrings(df: DataFrame, text: str = "text", length: int = LENGTH, keep_text: bool = True, block_bytes: int = BLOCK_BYTES, rounds: int = ROUNDS, names: int = NAMES, items: int = ITEMS, hot: int = HOT, order: int = ORDER) -> DataFrame:
    """df with ``text`` cut (if keep_text, else without it) and n_bytes, n_removed, n_spans, kept_sha256.

    A character that is cut in part goes from the text, not from the hash of the remaining bytes.
    """
    spark = df.sparkSession
    v, cover = difference_cover(order)
    if not v < length < 256:
        raise ValueError("the length must be above the cover's modulus and below 256")
    most = min(100_000, max(shuffle_partitions(spark), plan_bytes(df) // (16 << 20)))
    path = scratch(spark)
    name, done = f"quern_blocks_{path[-32:]}", [path]
    tight = {"spark__sql__execution__arrow__maxRecordsPerBatch": "8", "spark__sql__parquet__columnarReaderBatchSize": "8", "spark__sql__requireAllClusterKeysForCoPartition": "false", "spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}
    try:
        with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="256", spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
            built = _blocks(df, text, most, block_bytes)
            built.write.format("parquet").option("compression", "zstd").option("parquet.block.size", str(16 << 20)).option("path", path).bucketBy(most, "b").saveAsTable(name)
        with settings(spark, **tight):
            blocks = spark.table(name)
            total, texts = blocks.agg(F.sum(F.element_at("ends", -1)), F.sum(F.size("ends"))).first()
            cfg = {"length": length, "v": v, "cover": np.array(cover, np.int64), "digests": max(1, (texts or 0) // names), "names": max(1, (total or 0) * len(cover) // v // names), "rounds": rounds, "hot": hot}
            cfg["ranges"] = [(0, v), *((lo, min(lo + HOT_SHIFTS, v)) for lo in range(0, v, HOT_SHIFTS))]
            cfg["base"] = cfg["digests"] + cfg["names"]
            inputs = blocks.select("b", "block", "ends", "data")

            def joined(rows: DataFrame, said: DataFrame) -> DataFrame:
                lists = said.repartition(most, "b").groupBy("b", "block").agg(F.collect_list(F.struct("g", "bits")).alias("answers"))
                return rows.join(lists, ["b", "block"], "left")

            def exchange(rows: DataFrame, ask) -> DataFrame:
                got, at = store(rows.mapInArrow(ask, QUESTION).groupBy("g").applyInArrow(_answer(cfg), ANSWER))
                done.append(at)
                return got

            said = exchange(inputs, _ask_texts(cfg))
            named = exchange(joined(inputs, said), _ask_cover(cfg))
            said = known = said.unionByName(named)
            cfg["reducers"] = rounds * max(1, (named.agg(F.sum("hits")).first()[0] or 0) // (rounds * items))
            for turn in range(rounds):
                said = said.unionByName(exchange(joined(inputs, known), _ask_items(cfg, turn)))
            out = materialize(_cut(joined(blocks, said), text, df, cfg, keep_text))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        for p in done:
            remove(spark, p)
    return out


RESULT = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]


def _cut(rows: DataFrame, text: str, df: DataFrame, cfg: dict, keep_text: bool) -> DataFrame:
    meta = rows.schema["meta"].dataType.elementType
    schema = T.StructType([T.StructField("meta", meta), *([T.StructField("kept", T.StringType())] if keep_text else []), *RESULT])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, block in _each(batches, cfg):
            gone = block.removed()
            total = np.concatenate([[0], np.cumsum(gone)])
            edge = gone & ~np.concatenate([[False], gone[:-1]]) if len(gone) else gone
            edge[block.starts[block.lens > 0]] = gone[block.starts[block.lens > 0]]
            edges = np.concatenate([[0], np.cumsum(edge)])
            kept = block.data[~gone].tobytes()
            ends = block.ends - total[block.ends]
            starts = block.starts - total[block.starts]
            parts = [kept[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
            arrays = [batch.column("meta")[i].values]
            if keep_text:
                arrays.append(pa.array([p.decode("utf-8", "ignore") for p in parts], pa.string()))
            arrays += [pa.array(block.lens, pa.int64()), pa.array(total[block.ends] - total[block.starts], pa.int64()), pa.array(edges[block.ends] - edges[block.starts], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    new = {f.name for f in RESULT}
    out = rows.select("b", "block", "ends", "data", "meta", "answers").mapInArrow(cut, schema)
    cols = [F.col("kept").alias(c) if c == text else F.col(f"meta.`{c}`") for c in df.columns if c not in new and (keep_text or c != text)]
    return out.select(*cols, *new_columns())


def new_columns() -> list[str]:
    return [f.name for f in RESULT]


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)

"""Packing into fixed-length sequences by vector bin packing with the dot-product heuristic.

Three limits hold at once: tokens, segments and loss-bearing tokens a sequence. A sequence takes, again and again, the
example whose demand has the largest dot product with what is left of the limits, each as a share of its limit. When no
whole example fits, one is cut so that the sequence is full (unless cut is False, for data that mustn't be cut).

Every partition packs what it reads, in pools of at most POOL examples, so nothing is shuffled and memory is bounded; at
most one sequence of a partition ends short, and it is split into sequences of powers of two, which need no padding.
Examples longer than a sequence give whole sequences first; the rest joins the pool.

Ids are those of the tokenizer for the whole text. It never looks across ASCII white space, so each distinct word of a
batch is encoded once. The text's ids are followed by END.

Null text is empty: one piece of one id. Null ids and repeated rows are packed like any other, each row by itself; an
empty table gives no piece.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.bytescan import gathered, text_bytes
from quern.llm.shared import small_batches, table

TOKENS = 2048
SEGMENTS = 512
END = 1
POOL = 2048
CHUNK = 16 << 20
VOCABULARY = "word_bpe_49k.json"
_TOKENIZERS: dict = {}


def tokenizer(path: str | None = None):
    """The tokenizer at path; by default the public one installed on this machine."""
    if path not in _TOKENIZERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            _TOKENIZERS[path] = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
        else:
            _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


_PLAIN = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-/:-@\[-`{-~]*)$"
_KNOWN: dict = {}
KNOWN = 600_000


def _byte_letters() -> dict[int, int]:
    """The letter by which a byte-level vocabulary writes each byte: printable bytes are themselves, others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


def _of_words(words: pa.Array, path: str | None) -> list[list[int]]:
    """The ids of each word.

    A word of Latin letters with ASCII punctuation after it is two pieces to the tokenizer, the letters in lower case and
    the punctuation. Letters go to its model at once, which is much cheaper than its whole pipeline; all other words take
    the pipeline.
    """
    tok = tokenizer(path)
    found = pc.extract_regex(words, _PLAIN)
    plain = found.is_valid().to_numpy(zero_copy_only=False)
    out: list = [None] * len(words)
    rest = np.flatnonzero(~plain)
    for i, e in zip(rest.tolist(), tok.encode_batch_fast(words.take(pa.array(rest)).to_pylist(), add_special_tokens=False)):
        out[i] = e.ids
    use = pa.array(np.flatnonzero(plain))
    found = found.take(use)
    cores, tails = (pc.utf8_lower(found.field(0)) if k == 0 else found.field(1) for k in (0, 1))
    cores, tails = cores.dictionary_encode(), tails.dictionary_encode()
    names = cores.dictionary.to_pylist()
    known = _KNOWN.setdefault(path, {})
    if len(known) > KNOWN:
        known.clear()
    new = [w for w in names if w not in known]
    if new:
        model = tok.model.tokenize
        spelled = "\n".join(new).encode().decode("latin-1").translate({b: c for b, c in _byte_letters().items() if b != 10}).split("\n")
        known.update(zip(new, ([t.id for t in model(w)] for w in spelled)))
    core_ids = [known[w] for w in names]
    tail_ids = [e.ids for e in tok.encode_batch_fast(tails.dictionary.to_pylist(), add_special_tokens=False)]
    for i, c, t in zip(use.to_pylist(), cores.indices.to_pylist(), tails.indices.to_pylist()):
        out[i] = core_ids[c] + tail_ids[t] if tail_ids[t] else core_ids[c]
    return out


def encode(texts: pa.Array, path: str | None = None, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """All ids, each text's followed by end, and the offsets of the texts among them."""
    split = pc.ascii_split_whitespace(texts.fill_null(""))
    if isinstance(split, pa.ChunkedArray):
        split = split.combine_chunks()
    coded = split.flatten().dictionary_encode()
    made = _of_words(coded.dictionary, path)
    sizes = np.fromiter(map(len, made), np.int64, len(made))
    flat = np.fromiter(itertools.chain.from_iterable(made), np.uint32, int(sizes.sum()))
    firsts = np.cumsum(sizes) - sizes
    word = coded.indices.to_numpy()
    n = sizes[word]
    before = np.concatenate([[0], np.cumsum(n)])
    ids = flat[np.repeat(firsts[word] - before[:-1], n) + np.arange(before[-1])]
    offsets = split.offsets.to_numpy().astype(np.int64)
    ends = before[offsets - offsets[0]]
    return np.insert(ids, ends[1:], np.uint32(end)), ends + np.arange(len(ends))


class Packer:
    """Takes examples and gives pieces: (example's key, start, ids, sequence, offset)."""

    def __init__(self, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, cut: bool = True, pool: int = POOL) -> None:
        self.limit = np.array([tokens, segments, loss or tokens], float)
        self.tokens, self.cut, self.most = tokens, cut, pool
        self.pool: list[tuple[object, int, np.ndarray, np.ndarray]] = []  # key, start, ids, loss mask
        self.sequences = 0
        self.open: list[tuple[object, int, np.ndarray, int]] = []

    def add(self, key: object, ids: np.ndarray, bears: np.ndarray | None = None, base: int = 0) -> Iterator[tuple]:
        """Pieces that are ready once this example is in. base: the example's ids before these, of which more may follow."""
        bears = np.ones(len(ids), bool) if bears is None else bears
        start = 0
        if self.cut:
            while len(ids) - start >= self.tokens and bears[start : start + self.tokens].sum() <= self.limit[2]:
                yield key, base + start, ids[start : start + self.tokens], self.sequences, 0
                self.sequences += 1
                start += self.tokens
        elif len(ids) > self.tokens or bears.sum() > self.limit[2]:
            raise ValueError(f"example {key} is over a limit and mustn't be cut")
        if start < len(ids):
            self.pool.append((key, base + start, ids[start:], bears[start:]))
        if len(self.pool) >= self.most:
            yield from self._pack(self.most // 4)

    def _pack(self, leave: int) -> Iterator[tuple]:
        """Fills sequences from the pool until at most ``leave`` examples are left."""
        items = sorted(self.pool, key=lambda x: -len(x[2]))
        need = np.array([[len(x[2]), 1, x[3].sum()] for x in items], float).reshape(-1, 3)
        share, alive, count = need / self.limit, np.ones(len(items), bool), len(items)
        while count > leave:
            left, at, row = self.limit.copy(), 0, []
            while count:
                fits = alive & (need <= left).all(1)
                if fits.any():
                    best = int(np.argmax(np.where(fits, share @ (left / self.limit), -1.0)))
                    part = items[best]
                    alive[best] = False
                    count -= 1
                elif self.cut and left[0] > 0 and left[1] > 0 and left[2] > 0:
                    best = int(np.argmax(np.where(alive, share[:, 0], -1.0)))
                    key, start, ids, bears = items[best]
                    n = int(min(left[0], np.searchsorted(np.cumsum(bears), left[2], side="right")))
                    if not n:
                        break
                    part = (key, start, ids[:n], bears[:n])
                    items[best] = (key, start + n, ids[n:], bears[n:])
                    need[best] = len(ids) - n, 1, bears[n:].sum()
                    share[best] = need[best] / self.limit
                else:
                    break
                row.append((part[0], part[1], part[2], at))
                at += len(part[2])
                left -= (len(part[2]), 1, part[3].sum())
                if not left[0]:
                    break
            if not count and at < self.tokens and self.cut:
                yield from self._short(row, at)
            else:
                for key, start, ids, offset in row:
                    yield key, start, ids, self.sequences, offset
                self.sequences += 1
        self.pool = [x for x, a in zip(items, alive) if a]

    def _short(self, row: list[tuple], total: int) -> Iterator[tuple]:
        """One short sequence as sequences of powers of two, the longest first."""
        sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
        room, at = sizes.pop(0), 0
        for key, start, ids, _ in row:
            while len(ids):
                n = min(room - at, len(ids))
                yield key, start, ids[:n], self.sequences, at
                start, ids, at = start + n, ids[n:], at + n
                if at == room:
                    self.sequences += 1
                    room, at = sizes.pop(0) if sizes else 0, 0

    def finish(self) -> Iterator[tuple]:
        yield from self._pack(0)


def pack(df: DataFrame, id_col: str = "doc_id", text: str = "text", tokens: int = TOKENS, segments: int = SEGMENTS, with_ids: bool = False, path: str | None = None) -> DataFrame:
    """One row a piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").cast("string").alias("_text"))
    longs = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in longs), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        packer, made = Packer(tokens, segments), []
        kind = None

        def out() -> pa.RecordBatch:
            cols = [pa.array([k for (k, _), *_ in made], kind)]
            cols += [pa.array(v, pa.int64()) for v in ([p[1] for p in made], [len(p[2]) for p in made], [zlib.crc32(p[2].tobytes()) for p in made], [n for (_, n), *_ in made], [base + p[3] for p in made], [p[4] for p in made])]
            if with_ids:
                cols.append(pa.array([p[2].astype(np.int32) for p in made], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

        for batch in gathered(batches, 1, CHUNK):
            kind = batch.column(0).type
            offsets = text_bytes(batch.column(1))[1]
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, side="right")) - 1)
                ids, at = encode(batch.column(1).slice(lo, hi - lo), path)
                keys = batch.column(0).slice(lo, hi - lo).to_pylist()
                for k, s, e in zip(keys, at[:-1].tolist(), at[1:].tolist()):
                    made.extend(packer.add((k, e - s), ids[s:e].astype("<u4")))
                lo = hi
                if made:
                    yield out()
                    made = []
        made.extend(packer.finish())
        if made:
            yield out()

    return rows.mapInArrow(run, schema)


def pack_conversations(turns: DataFrame, tokens: int = TOKENS, segments: int = 64, loss: int = TOKENS, bearing: tuple[str, ...] = ("assistant",), path: str | None = None) -> DataFrame:
    """One row a piece of instruction data: conv_id, start, length, loss_tokens, sequence_id, offset, ids.

    Turns (conv_id, turn, role, text) are ordered within their conversation; the ids of the roles in ``bearing`` bear
    loss, and END ends every turn. Turns stream through a task one after the other, so a very long conversation is held
    a few sequences at a time. Null roles bear none, null texts are END alone, turns of equal number keep the order of
    their role and text.
    """
    small_batches(turns.sparkSession)
    rows = turns.select("conv_id", "role", F.col("text").cast("string").alias("text"), "turn").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    schema = T.StructType([T.StructField("conv_id", turns.schema["conv_id"].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "length", "loss_tokens", "sequence_id", "offset")), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        packer, made, kind = Packer(tokens, segments, loss), [], None
        key, held, bears, base, any_ = None, [], [], 0, False

        def flush() -> None:
            nonlocal held, bears, base
            if held:
                ids = np.concatenate(held)
                masks.setdefault(key, []).append((base, np.concatenate(bears)))
                made.extend(packer.add(key, ids, np.concatenate(bears), base))
                base += len(ids)
                held, bears = [], []

        masks: dict = {}

        def loss_of(k: object, start: int, n: int) -> int:
            return sum(int(m[max(start - at, 0) : max(start + n - at, 0)].sum()) for at, m in masks.get(k, ()))

        def out() -> pa.RecordBatch:
            cols = [pa.array([p[0] for p in made], kind)]
            cols += [pa.array(v, pa.int64()) for v in ([p[1] for p in made], [len(p[2]) for p in made], [loss_of(p[0], p[1], len(p[2])) for p in made], [first + p[3] for p in made], [p[4] for p in made])]
            return pa.RecordBatch.from_arrays([*cols, pa.array([p[2].astype(np.int32) for p in made], pa.list_(pa.int32()))], names=[f.name for f in schema.fields])

        for batch in gathered(batches, 2, CHUNK):
            kind = batch.column(0).type
            ids, at = encode(batch.column(2), path)
            for k, role, s, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                if not any_ or k != key:
                    flush()
                    key, base, any_ = k, 0, True
                held.append(ids[s:e].astype("<u4"))
                bears.append(np.full(e - s, role in bearing))
                if sum(map(len, held)) >= 64 * tokens:
                    flush()
            if made:
                yield out()
                made = []
                waiting = {x[0] for x in packer.pool} | {key}
                for k in [k for k in masks if k not in waiting]:
                    del masks[k]
        flush()
        made.extend(packer.finish())
        if made:
            yield out()

    return rows.mapInArrow(run, schema)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

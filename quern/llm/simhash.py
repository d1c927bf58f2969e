"""SimHash near-duplicates by tiled exact comparison.

Each text becomes a 64-bit fingerprint of its word shingles. Distinct fingerprints are laid into tiles by the
population counts of their four 16-bit parts. The counts of two fingerprints can't differ by more, summed over the
parts, than the fingerprints do in bits; so a tile meets only the tiles whose counts lie within the radius, and every
other pair of tiles is skipped. Within a pair of tiles, numpy compares by exclusive or and bit counts, exactly.

A task emits links that join what is not joined yet, a forest over its tile, never all pairs: the components are the
same. A tile of more than CHUNK fingerprints is cut into chunks by hash, and what visits it into slices; a task holds
one chunk and one slice, so its memory doesn't grow with the data.

``keep_first`` drops documents by similarity: five-word shingles, of which at least 0.8 of all that two texts hold must
be common. Such texts differ in up to WIDE bits, and at that radius population counts tell nothing apart, so tiles are
made of the number of distinct shingles: that of two similar texts differs by a factor of 0.8 at most, and all other
pairs of tiles are skipped. Fingerprints within the radius are compared by sketches of their shingles (the least hash in
each of BINS ranges), which give a forest of likely links; the links of the forest are checked on the texts. Some similar
texts are further apart, or are left out because a link that failed stood for them. So the tiles are compared once more
by parities: whether each of some ranges of hashes holds an odd number of a text's shingles. Two parities differ in no
more bits than the texts do in shingles, an exact bound, so every pair of similar texts of different classes comes up. The
likeliest pair of every two classes is checked on the texts, then every pair whose classes are still apart. So the classes
are those of all similar pairs, whatever the order of rows.

Null text, and text without a word, has fingerprint zero, which links like any other. Repeated rows each get a row. Other
columns pass through, whatever their names; columns named fingerprint and component_id are replaced. Ids must not be
null for component_id to be the smallest doc_id reachable: a null id never is one. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.llm.shared import plan_bytes, remove, scratch, settings, shuffle_partitions, small_batches, store, table, trim

RADIUS = 3
SHINGLE = 3
SEED = 42
PARTS = 4
CHUNK = 1 << 15
SIMILAR = 0.8
SIMILAR_SHINGLE = 5
WIDE = 20
BINS = 128
LIKELY, SURE = 0.7, 0.84  # by sketches
PARITY_BITS = 1 << 12  # two to four bits a shingle up to here, then one to two: with less than 0.45 texts that share nothing would pass
SIMILAR_CHUNK = 1 << 15
PARITY_CHUNK = 16 << 20  # bytes of parities
PLACE_BITS = 15  # a bitmap of kept rows has 1 << 15 places, as bitmap_construct_agg makes them
SENT = 1 << 20  # links whose ends are sent to every executor, 24 MB; more are joined by a shuffle
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _hashes(words: list[bytes], shingle: int, seed: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), seed)], np.uint64)
    joined = map(b" ".join, zip(*(itertools.islice(words, k, None) for k in range(shingle))))
    return np.fromiter((digest(s, seed) for s in joined), np.uint64, len(words) - shingle + 1)


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().translate(_LOWER))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text: bit i is 1 if bit i is set in over half of its shingles' hashes."""
    words = _words(text)
    return _majority(_hashes(words, shingle, seed)) if words else 0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprint(df: DataFrame, text: str = "text", shingle: int = SHINGLE, seed: int = SEED, keep_text: bool = True) -> DataFrame:
    """(row, fp): all columns of df as one, without the text unless it is to be kept, and the fingerprint as a signed long."""
    small_batches(df.sparkSession)

    @F.pandas_udf("long")
    def of(texts):
        return texts.map(lambda t: _signed(fingerprint(t, shingle, seed))).astype("int64")

    rest = [F.col(f"`{c}`") for c in df.columns if keep_text or c != text]
    return df.select(F.struct(F.lit(0).alias("__none"), *rest).alias("row"), of(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("fp"))


def _counts(fp: Column, parts: int = PARTS) -> list[Column]:
    width = 64 // parts
    return [F.bit_count(F.shiftrightunsigned(fp, k * width).bitwiseAND(F.lit((1 << width) - 1))) for k in range(parts)]


def _tile(fp: Column, parts: int = PARTS) -> Column:
    """One number for the counts. Moved counts that are out of range give tiles nobody lives in."""
    total = F.lit(0)
    for c in _counts(fp, parts):
        total = total * 32 + c + 4
    return total.cast("int")


def _moves(radius: int, parts: int) -> list[int]:
    """What to add to a tile's number: half of the moves within the radius, so that each pair of tiles meets once."""
    zero = (0,) * parts
    steps = [s for s in itertools.product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, s)) <= radius and s > zero]
    return [sum(d * 32 ** (parts - 1 - k) for k, d in enumerate(s)) for s in steps]


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _forest(home: np.ndarray, visitors: np.ndarray, radius: int, rows: int = 256, columns: int = 1 << 13) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (home first, visitors after) that join everything linked within home and between home and visitors."""
    both = np.concatenate([home, visitors])
    parent = np.arange(len(both))
    label = np.arange(len(both))
    for lo in range(0, len(home), rows):
        a = home[lo : lo + rows]
        for at in range(lo, len(both), columns):
            b = both[at : at + columns]
            i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
            i, j = i + lo, j + at
            new = label[i] != label[j]
            if not new.any():
                continue
            left, right = [], []
            pairs = np.unique(np.stack([label[i[new]], label[j[new]]], 1), axis=0, return_index=True)[1]
            for x, y in zip(i[new][pairs].tolist(), j[new][pairs].tolist()):
                p, q = _find(parent, x), _find(parent, y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    left.append(x)
                    right.append(y)
            while True:
                flat = parent[parent]
                if (flat == parent).all():
                    break
                parent = flat
            label = parent.copy()
            yield np.array(left, np.int64), np.array(right, np.int64)


def _in_chunks(homes: DataFrame, moves: list[int], chunk: int | Column, key: str = "fp") -> DataFrame:
    """Rows (tile, fp, ...) by the tasks that compare them: (tile, part, slice, home, fp, ...).

    A tile's rows live in chunks; the rows of tiles a move below it, and those of its own chunks before, visit in slices.
    Every pair of rows whose tiles are equal or a move apart meets in exactly one task, and a task has about a chunk of
    homes and two of visitors at most. A chunk may depend on the tile; rows are dealt by ``key``.
    """
    data = [c for c in homes.columns if c != "tile"]
    count = homes.groupBy("tile").agg(F.count(F.lit(1)).alias("n"))
    step = F.explode(F.array(*map(F.lit, moves)))
    guests = count.select("tile", "n", step.alias("move")).groupBy((F.col("tile") + F.col("move")).alias("tile")).agg(F.sum("n").alias("m"))
    sizes = count.join(guests, "tile", "left").select("tile", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"), F.ceil((F.coalesce("m", F.lit(0)) + F.when(F.col("n") > chunk, F.col("n")).otherwise(0)) / (2 * chunk)).cast("int").alias("slices"))
    sizes = F.broadcast(sizes.select("tile", "chunks", F.greatest("slices", F.lit(1)).alias("slices")))  # a row a tile: at most 17**4
    part = F.pmod(F.xxhash64(key), F.col("chunks")).cast("int")
    one = F.pmod(F.xxhash64(key, F.lit(1)), F.col("slices")).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    settled = homes.join(sizes, "tile").select("tile", part.alias("part"), "slices", "chunks", one.alias("one"), *data)
    at_home = settled.select("tile", "part", F.explode(upto("slices")).alias("slice"), F.lit(True).alias("home"), *data)
    visits = homes.select("tile", *data, step.alias("move")).withColumn("tile", F.col("tile") + F.col("move")).join(sizes, "tile")  # tiles where nobody lives get no visit
    calls = visits.select("tile", F.explode(upto("chunks")).alias("part"), one.alias("slice"), F.lit(False).alias("home"), *data)
    within = settled.where("part < chunks - 1").select("tile", F.explode(F.sequence(F.col("part") + 1, F.col("chunks") - 1)).alias("part"), F.col("one").alias("slice"), F.lit(False).alias("home"), *data)
    return at_home.union(calls).union(within)


def near_links(prints: DataFrame, radius: int = RADIUS, parts: int = PARTS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): ids whose links have the same components as all links of distinct fingerprints (fp, id) within the radius."""

    def link(group: pa.Table) -> pa.Table:
        home = group.column("home").to_numpy()
        order = np.argsort(~home, kind="stable")
        fp, ids, n = group.column("fp").to_numpy()[order].view(np.uint64), group.column("id").to_numpy()[order], int(home.sum())
        found = list(_forest(fp[:n], fp[n:], radius))
        a, b = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
        return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64())})

    homes = prints.select("fp", "id", _tile(F.col("fp"), parts).alias("tile"))
    return _in_chunks(homes, _moves(radius, parts), chunk).groupBy("tile", "part", "slice").applyInArrow(link, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, keep_text: bool = True, chunk: int = CHUNK) -> DataFrame:
    """df with ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id that links of the radius reach."""
    rows, _ = store(with_fingerprint(df.drop("fingerprint", "component_id"), text, keep_text=keep_text))
    prints, _ = store(rows.groupBy("fp").agg(F.min(F.col(f"row.`{id_col}`")).alias("id")))
    found = components(near_links(prints.where("id IS NOT NULL"), radius, chunk=chunk)).withColumnRenamed("component", "component_id")
    of_print = prints.join(found, "id", "left").select("fp", F.coalesce("component_id", "id").alias("component_id"))
    names = [F.col(f"row.`{c}`") for c in df.columns if c not in ("fingerprint", "component_id") and (keep_text or c != text)]
    return rows.join(of_print, "fp", "left").select(*names, "component_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False).select("doc_id", "fingerprint", "component_id")


def _parity(hashes: np.ndarray) -> bytes:
    """Of each of a power of two of ranges, by the low bits, whether it holds an odd number of some distinct hashes."""
    power = lambda x: 1 << (x - 1).bit_length()
    n = len(hashes)
    bits = max(64, min(power(2 * n), PARITY_BITS), power(n))
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(parities: list[bytes], words: int) -> np.ndarray:
    """Parities as rows of so many 64-bit words, of half the ranges or fewer where they have more."""
    out, length = np.empty((len(parities), words), np.uint64), np.array([len(p) for p in parities])
    for n in np.unique(length).tolist():
        at = np.flatnonzero(length == n)
        out[at] = np.bitwise_xor.reduce(np.frombuffer(b"".join(parities[k] for k in at.tolist()), np.uint64).reshape(len(at), -1, words), axis=1)
    return out


def signature(text: str | None, shingle: int = SIMILAR_SHINGLE, seed: int = SEED) -> tuple[int, int, bytes, bytes, bytes]:
    """Of one text: the fingerprint of its distinct shingles, their number, their sketch, a digest of its words, and the shingles' parity."""
    words = _words(text)
    digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    if not words:
        return 0, 0, bytes(BINS), digest, bytes(8)
    hashes = np.unique(_hashes(words, shingle, seed))
    sketch = np.zeros(BINS, np.uint8)
    which, first = np.unique((hashes >> np.uint64(57)).astype(np.int64), return_index=True)
    sketch[which] = hashes[first] % np.uint64(255) + np.uint64(1)  # 0: nothing in this range
    return _signed(_majority(hashes)), len(hashes), sketch.tobytes(), digest, _parity(hashes)


def similarity(a: str | None, b: str | None, shingle: int = SIMILAR_SHINGLE) -> float:
    """The share of common shingles among all distinct ones of two texts; 1 if neither has any."""
    x, y = (set(_hashes(w, shingle, SEED).tolist()) if w else set() for w in (_words(a), _words(b)))
    return len(x & y) / len(x | y) if x or y else 1.0


class _Joined:
    """Which of some places are joined."""

    def __init__(self, n: int) -> None:
        self.parent, self.label = np.arange(n), np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Joins pairs, of those with one end in common the first one first; the pairs that joined what wasn't joined before."""
        used, left = [], np.arange(len(i))
        while len(left := left[self.label[i[left]] != self.label[j[left]]]):
            for k in left[np.sort(np.unique(self.label[j[left]], return_index=True)[1])].tolist():
                p, q = _find(self.parent, i[k]), _find(self.parent, j[k])
                if p != q:
                    self.parent[max(p, q)] = min(p, q)
                    used.append(k)
            while (self.parent[self.parent] != self.parent).any():
                self.parent = self.parent[self.parent]
            self.label = self.parent.copy()
        return np.array(used, np.int64)


def _blocks(size: np.ndarray, homes: int, at_home: bool, least: float, rows: int, columns: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (a, b) of places that hold every pair of a home and another place, and of two homes if at_home, whose sizes allow the similarity."""
    home = np.argsort(size[:homes], kind="stable")
    spans = [home] if at_home else []
    spans.append(homes + np.argsort(size[homes:], kind="stable"))
    for lo in range(0, homes, rows):
        a = home[lo : lo + rows]
        for others in spans:
            s = size[others]
            first = max(np.searchsorted(s, least * size[a[0]] - 1e-9), lo if others is home else 0)
            last = np.searchsorted(s, size[a[-1]] / least + 1e-9, side="right")
            for at in range(first, last, columns):
                yield a, others[at : min(at + columns, last)]


def likely_links(fp: np.ndarray, size: np.ndarray, sketch: np.ndarray, homes: int, at_home: bool, least: float = SIMILAR, radius: int = WIDE, rows: int = 256, columns: int = 1 << 11) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) between the first ``homes`` places and the others, and among them if at_home, that are likely by sketches.

    Two forests: one of links that are all but sure, one of likely links as well. So a link that fails later on the texts
    rarely stands for one that wouldn't. What these leave out, ``other_links`` finds.
    """
    sure, likely, left, right = _Joined(len(fp)), _Joined(len(fp)), [], []
    for a, b in _blocks(size, homes, at_home, least, rows, columns):
        i, j = np.nonzero(np.bitwise_count(fp[a][:, None] ^ fp[b][None, :]) <= radius)
        i, j = a[i], b[j]
        ok = (i != j) & (np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j])) & (sure.label[i] != sure.label[j])
        i, j = i[ok], j[ok]
        share = np.empty(len(i))
        for k in range(0, len(i), 1 << 14):
            x, y = sketch[i[k : k + (1 << 14)]], sketch[j[k : k + (1 << 14)]]
            share[k : k + (1 << 14)] = ((x == y) & (x > 0)).sum(1) / np.maximum(((x > 0) | (y > 0)).sum(1), 1)
        order = np.argsort(-share, kind="stable")
        order = order[share[order] >= LIKELY]
        i, j, share = i[order], j[order], share[order]
        strong = int((share >= SURE).sum())
        keep = sure.join(i[:strong], j[:strong])
        more = likely.join(i, j)
        keep = np.concatenate([keep, more[more >= strong]])
        left.append(i[keep])
        right.append(j[keep])
    return np.concatenate([*left, np.zeros(0, np.int64)]), np.concatenate([*right, np.zeros(0, np.int64)])


def other_links(fp: np.ndarray, size: np.ndarray, parity: list[bytes], label: np.ndarray, homes: int, at_home: bool, least: float = SIMILAR, rows: int = 256, columns: int = 1 << 11) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j, share of shingles by which they differ at least) between the first ``homes`` places and the others, and among them if at_home, whose labels differ and
    whose parities don't rule out that they are similar: all similar ones of different labels, and few others.

    Sets of m and n shingles with a similarity of t differ in (m + n) * (1 - t) / (1 + t) shingles at most. Parities are
    folded to about one bit a shingle at first; only pairs that pass are compared in full.
    """
    if not homes:
        return
    ratio = (1 - least) / (1 + least)
    fine = _folded(parity, min(map(len, parity)) // 8)
    words = min(fine.shape[1], 1 << (int(size.max()) * 3 // 256).bit_length())
    coarse = np.ascontiguousarray(np.bitwise_xor.reduce(fine.reshape(len(fine), -1, words), axis=1).T)
    step = max(1, (8 << 20) // fine[0].nbytes)
    for a, b in _blocks(size, homes, at_home, least, rows, columns):
        apart = np.zeros((len(a), len(b)), np.uint16 if words < 1024 else np.uint32)
        for word in coarse:
            apart += np.bitwise_count(word[a][:, None] ^ word[b][None, :])
        i, j = np.nonzero(apart <= ratio * (size[a].max() + size[b].max()) + 1e-6)
        ok = label[a[i]] != label[b[j]]
        apart, i, j = apart[i[ok], j[ok]], a[i[ok]], b[j[ok]]
        m, n = size[i], size[j]
        most = np.floor(ratio * (m + n) + 1e-6)
        once = (j >= homes) | (m < n) | ((m == n) & (i < j))  # two homes may come both ways
        ok = (apart <= most) & once & (np.minimum(m, n) >= least * np.maximum(m, n) - 1e-9) & ((most > 0) | (fp[i] == fp[j]))  # equal sets have equal fingerprints
        i, j, most = i[ok], j[ok], most[ok]
        for k in range(0, len(i), step):
            x, y = i[k : k + step], j[k : k + step]
            apart = np.bitwise_count(fine[x] ^ fine[y]).sum(1, dtype=np.int64)
            ok = apart <= most[k : k + step]
            if ok.any():
                yield x[ok], y[ok], apart[ok] / (size[x[ok]] + size[y[ok]])


def _signatures(rows: DataFrame, shingle: int) -> DataFrame:
    """(row, id, text) as (row, id, fp, size, sketch, digest, parity)."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [signature(t, shingle) for t in batch.column(2).to_pylist()]
            parts = [pa.array([m[k] for m in made], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *parts], names=["row", "id", "fp", "size", "sketch", "digest", "parity"])
        trim()

    return rows.mapInArrow(run, f"row long, id {kind}, fp long, size long, sketch binary, digest binary, parity binary")


def _checked(spark: SparkSession, links: DataFrame, texts: DataFrame, least: float, shingle: int, sent: int) -> tuple[DataFrame, str]:
    """Those of links (a, b) whose texts (id, text) are similar, and where they are stored."""
    found, at = store(links)
    few = found.count() <= sent
    ends = found.select("a", "b", F.explode(F.array("a", "b")).alias("id"))
    said = texts.join(F.broadcast(ends) if few else ends, "id").select("a", "b", (F.col("id") == F.col("a")).alias("first"), "text")

    @F.pandas_udf("double")
    def alike(x, y):
        return x.combine(y, lambda p, q: similarity(p, q, shingle)).astype("float64")

    pairs = said.groupBy("a", "b").agg(F.max(F.when(F.col("first"), F.col("text"))).alias("x"), F.max(F.when(~F.col("first"), F.col("text"))).alias("y"))
    out = store(pairs.where(alike("x", "y") >= least).select("a", "b"))
    remove(spark, at)
    return out


def similar_links(nodes: DataFrame, texts: DataFrame, least: float = SIMILAR, radius: int = WIDE, shingle: int = SIMILAR_SHINGLE, chunk: int = SIMILAR_CHUNK, sent: int = SENT) -> tuple[DataFrame, str]:
    """(a, b): ids of nodes (id, fp, size, sketch, parity) whose texts (id, text) are similar, each checked. And where they are stored.

    Their components are those of all similar pairs: a forest of likely links first, then the likeliest pair of every two
    classes, then all pairs that these left apart.
    """

    def link(group: pa.Table) -> pa.Table:
        home = group.column("home").to_numpy()
        order = np.argsort(~home, kind="stable")
        col = lambda c: group.column(c).to_numpy()[order]
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)[order]
        i, j = likely_links(col("fp").view(np.uint64), col("size"), sketch, int(home.sum()), group.column("slice")[0].as_py() == 0, least, radius)
        ids = col("id")
        trim()
        return pa.table({"a": pa.array(ids[i], pa.int64()), "b": pa.array(ids[j], pa.int64())})

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        home = group.column("home").to_numpy()
        order = np.argsort(~home, kind="stable")
        col = lambda c: group.column(c).to_numpy()[order]
        parity, ids, label = group.column("parity").take(pa.array(order)).to_pylist(), col("id"), col("label")
        for i, j, off in other_links(col("fp"), col("size"), parity, label, int(home.sum()), group.column("slice")[0].as_py() == 0, least):
            x, y = label[i], label[j]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (ids[i], ids[j], np.minimum(x, y), np.maximum(x, y))), pa.array(off, pa.float64())], names=["a", "b", "u", "v", "off"])
        trim()

    spark = nodes.sparkSession
    width = float(-np.log(least)) * (1 + 1e-9)  # so that sizes just at the bound aren't two tiles apart
    tile = F.floor(F.log(F.col("size").cast("double")) / width).cast("int").alias("tile")
    some = nodes.where("size > 0")
    likely = _in_chunks(some.select("id", "fp", "size", "sketch", tile), [1], chunk, "id").groupBy("tile", "part", "slice").applyInArrow(link, "a long, b long")
    first, at_first = _checked(spark, likely, texts, least, shingle, sent)
    tiles, at_tiles = store(some.join(components(first), "id", "left").select("id", "fp", "size", "parity", F.coalesce("component", "id").alias("label"), tile))
    held = F.greatest(F.lit(PARITY_BITS / 8), F.exp((F.col("tile") + 1) * width) / 4)  # bytes of a parity at most
    fits = F.greatest(F.lit(1), F.least(F.lit(chunk), F.floor(PARITY_CHUNK / held)))
    rest, at_rest = store(_in_chunks(tiles, [1], fits, "id").groupBy("tile", "part", "slice").applyInArrow(complete, "a long, b long, u long, v long, off double"))
    best = rest.groupBy("u", "v").agg(F.min(F.struct("off", "a", "b")).alias("best")).select("u", "v", "best.a", "best.b")
    second, at_second = _checked(spark, best.select("a", "b"), texts, least, shingle, sent)
    now = components(best.join(second, ["a", "b"]).select(F.col("u").alias("a"), F.col("v").alias("b")))
    u, v = (now.select(F.col("id").alias(c), F.col("component").alias(f"{c}_now")) for c in ("u", "v"))
    apart = rest.join(u, "u", "left").join(v, "v", "left").where(F.coalesce("u_now", "u") != F.coalesce("v_now", "v"))
    third, at_third = _checked(spark, apart.select("a", "b").join(best.select("a", "b"), ["a", "b"], "left_anti"), texts, least, shingle, sent)
    out = store(first.union(second).union(third))
    for path in (at_first, at_tiles, at_rest, at_second, at_third):
        remove(spark, path)
    return out


def _place() -> Column:
    return F.col("row").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def _in_buckets(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows, which monotonically_increasing_id gave ``row``, stored with ``part`` in buckets by part, and how many of them.

    Rows of one task have one or few parts, so a task writes each of its rows to the bucket of its part and none moves;
    a join on part then takes the rows where they are. The table's name goes at once, its files stay.
    """
    spark = rows.sparkSession
    path = scratch(spark)
    name, buckets = f"quern_rows_{path[-32:]}", min(100_000, max(shuffle_partitions(spark), plan_bytes(rows) // (16 << 20)))
    try:
        with settings(spark, spark__sql__maxConcurrentOutputFileWriters="16"):  # up to so many parts are written without a sort
            rows.withColumn("part", F.shiftright("row", PLACE_BITS)).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, "part").saveAsTable(name)
        return spark.table(name), buckets
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def keep_first(df: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = SIMILAR, radius: int = WIDE, shingle: int = SIMILAR_SHINGLE, chunk: int = SIMILAR_CHUNK, sent: int = SENT) -> DataFrame:
    """The rows of df without near-duplicates: of each class of similar texts, the row with the smallest id (null ids last) stays.

    Classes are those that links between texts of similarity ``least`` or more make; texts of the same words are alike.
    Which rows stay comes back to the texts as one bit a row, in bitmaps of their part, so the texts aren't moved for it.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows, buckets = _in_buckets(df.select(F.monotonically_increasing_id().alias("row"), F.struct(F.lit(0).alias("__none"), *(F.col(f"`{c}`") for c in df.columns)).alias("of")))
    prints, at_prints = store(_signatures(rows.select("row", F.col(f"of.`{id_col}`").alias("id"), F.col(f"of.`{text}`").cast("string").alias("text")), shingle))
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")
    nodes, at_nodes = store(prints.groupBy("digest").agg(best, F.any_value("fp").alias("fp"), F.any_value("size").alias("size"), F.any_value("sketch").alias("sketch"), F.any_value("parity").alias("parity")).select("first", F.col("first.row").alias("id"), "fp", "size", "sketch", "parity"))
    texts = rows.select(F.col("row").alias("id"), F.col(f"of.`{text}`").alias("text"))
    links, at_links = similar_links(nodes.select("id", "fp", "size", "sketch", "parity"), texts, least, radius, shingle, chunk, sent)
    found = components(links)
    stays, _ = store(nodes.join(found, "id", "left").groupBy(F.coalesce("component", "id").alias("component")).agg(F.min("first").alias("first")).select(F.col("first.row").alias("row")))
    for path in (at_prints, at_nodes, at_links):
        remove(spark, path)
    bits = stays.select(F.shiftright("row", PLACE_BITS).alias("part"), _place().alias("place")).repartition(buckets, "part").groupBy("part").agg(F.bitmap_construct_agg("place").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.shiftright("place", 3) + 1, F.lit(1))), 16, 10).cast("int")
    kept = rows.withColumn("place", _place()).join(bits.hint("shuffle_hash"), "part").where(F.getbit(byte, F.col("place").bitwiseAND(F.lit(7))) == 1)
    return kept.select(*(F.col(f"of.`{c}`") for c in df.columns))

"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is its own embedding (for words of the training sample) beside the mean embedding of its hashed character
n-grams, so inflected and unseen words count too. Overlapping windows of WINDOW words, STRIDE apart, cover the whole
text; a text's score is that of its highest window.

Labels belong to texts, not windows, so training goes in rounds: of a toxic text, first the windows with the word that is
most significantly more frequent in toxic texts (by itself, or by its first letters) take its label, then those that the
network scores highest. The network is fitted on at most SAMPLE toxic and OTHERS other labelled texts, of at
most SAMPLE_BYTES each, taken in order of a hash of the id; these bounds are parameters. Scoring covers all texts whole.

Null and empty texts, and texts without a letter, have no window and score 0. With no labels of one class every score
is 0. Repeated rows are scored row by row; other columns pass through, and a column named score or predicted is replaced.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.bytescan import gathered, text_bytes
from quern.llm.shared import chosen, small_batches, table, trim

WINDOW, STRIDE = 32, 16
HIDDEN = 8
WORD_DIM = CHAR_DIM = 8
BUCKETS = 1 << 14
DROPPED = 0.3  # of word embeddings, in training: characters must do too
DECAY = 1e-3
NGRAMS = (3, 4, 5)
VOCABULARY = 8192
SAMPLE = 1200  # toxic texts; and of others:
OTHERS = 3600
SAMPLE_BYTES = 16384
CHUNK = 6 << 20
WINDOWS = 6000  # of toxic texts in an epoch
STEM = 4  # letters
ROUNDS = (("seed", 3), ("best", 2), ("best", 2), ("best", 2))
f32 = np.float32


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-case words (runs of letters), the word at each place, and the texts' offsets among the places."""
    letters = pc.replace_substring_regex(pc.utf8_lower(texts.fill_null("")), r"[^\p{L}]+", " ")
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(letters))
    coded = lists.flatten().dictionary_encode()
    at = lists.offsets.to_numpy().astype(np.int64)
    words, place, at = coded.dictionary, coded.indices.to_numpy().astype(np.int64), at - at[0]
    empty = pc.equal(words, "").to_numpy(zero_copy_only=False)
    if empty.any():  # of texts without a letter
        keep = ~empty[place]
        at = np.concatenate([[0], np.cumsum(keep)])[at]
        place = (np.cumsum(~empty) - 1)[place[keep]]
        words = words.filter(pa.array(~empty))
    return words, place, at


def ngrams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of ^word$, and the words' offsets among them."""
    data, at = text_bytes(pc.binary_join_element_wise("^", words, "$", ""))
    n = len(data)
    ends = np.repeat(at[1:], np.diff(at))
    owner = np.repeat(np.arange(len(words)), np.diff(at))
    h = np.zeros(n, np.uint32)
    places, buckets = [], []
    for k in range(max(NGRAMS)):
        h = h * np.uint32(257) + np.concatenate([data[k:], np.zeros(k, np.uint8)]).astype(np.uint32)
        if k + 1 in NGRAMS:
            ok = np.flatnonzero(np.arange(n) + k < ends)
            places.append(owner[ok])
            buckets.append((((h[ok] + np.uint32(k)) * np.uint32(2654435769)) >> np.uint32(18)).astype(np.int32) % BUCKETS)
    who, what = np.concatenate(places), np.concatenate(buckets)
    order = np.argsort(who, kind="stable")
    return what[order], np.searchsorted(who[order], np.arange(len(words) + 1))


def windows(at: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, length and text of every window."""
    n = np.diff(at)
    count = np.where(n > 0, 1 + np.maximum(-(-(n - WINDOW) // stride), 0), 0)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = at[text] + k * stride
    return first, np.minimum(at[text + 1] - first, WINDOW), text


class Network:
    """Parameters, scores and gradients."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) * 0.3).astype(f32)
        h, d = HIDDEN, WORD_DIM + CHAR_DIM
        self.vocabulary = vocabulary
        self.p = {"word": draw(len(vocabulary) + 1, WORD_DIM) * f32(0.3), "char": draw(BUCKETS, CHAR_DIM) * f32(0.1), "in": draw(d, 6 * h), "bias": np.zeros(6 * h, f32), "fore": draw(h, 3 * h), "back": draw(h, 3 * h), "attend": draw(2 * h), "out": draw(2 * h), "base": np.zeros(1, f32)}
        self.p["word"][0] = 0

    def features(self, words: pa.Array, drop: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A row for each word, and what it is made of."""
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in words.to_pylist()), np.int64, len(words))
        if drop is not None:
            ids[drop.random(len(ids)) < DROPPED] = 0
        grams, at = ngrams(words)
        sums = np.add.reduceat(self.p["char"][grams], at[:-1], axis=0) if len(words) else np.zeros((0, CHAR_DIM), f32)
        size = np.maximum(np.diff(at), 1).astype(f32)[:, None]
        return np.concatenate([self.p["word"][ids], 2 * sums / size], 1), ids, grams, at

    def project(self, words: pa.Array, step: int = 1 << 15) -> np.ndarray:
        """What each word feeds to the gates of both directions; one more row for padding."""
        out = np.zeros((len(words) + 1, 6 * HIDDEN), f32)
        for lo in range(0, len(words), step):
            part = words.slice(lo, step)
            out[lo : lo + len(part)] = self.features(part)[0] @ self.p["in"] + self.p["bias"]
        return out

    def _run(self, x: np.ndarray, idx: np.ndarray, mask: np.ndarray, u: np.ndarray, lo: int, back: bool, keep: list | None) -> np.ndarray:
        h, n = np.zeros((len(idx), HIDDEN), f32), HIDDEN
        out = np.empty((WINDOW, len(idx), n), f32)
        for t in range(WINDOW - 1, -1, -1) if back else range(WINDOW):
            g = x[idx[:, t], lo : lo + 3 * n]
            a = h @ u
            zr = g[:, : 2 * n] + a[:, : 2 * n]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(g[:, 2 * n :] + r * a[:, 2 * n :])
            new = c + z * (h - c)
            if keep is not None:
                keep.append((t, h, a, z, r, c))
            m = mask[:, t, None]
            h = new if m.all() else np.where(m, new, h)
            out[t] = h
        return out

    def forward(self, x: np.ndarray, idx: np.ndarray, mask: np.ndarray, tape: list | None = None) -> np.ndarray:
        """The logit of each window; idx has rows of x."""
        p, keeps = self.p, ([], []) if tape is not None else (None, None)
        states = np.concatenate([self._run(x, idx, mask, p["fore"], 0, False, keeps[0]), self._run(x, idx, mask, p["back"], 3 * HIDDEN, True, keeps[1])], 2)
        e = np.where(mask.T, states @ p["attend"], f32(-1e9))
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = np.einsum("tb,tbh->bh", w, states)
        if tape is not None:
            tape += [keeps, states, w, pooled]
        return pooled @ p["out"] + p["base"][0]

    def gradients(self, words: pa.Array, idx: np.ndarray, mask: np.ndarray, label: np.ndarray, weight: np.ndarray, drop: np.random.Generator | None = None) -> dict[str, np.ndarray]:
        """Of the weighted mean cross entropy."""
        p, n, tape = self.p, HIDDEN, []
        feats, ids, grams, at = self.features(words, drop)
        x = np.concatenate([feats @ p["in"] + p["bias"], np.zeros((1, 6 * n), f32)])
        logit = self.forward(x, idx, mask, tape)
        keeps, states, w, pooled = tape
        g = {k: np.zeros_like(v) for k, v in p.items()}
        d = ((1 / (1 + np.exp(-logit)) - label) * weight / weight.sum()).astype(f32)
        g["out"], g["base"][0] = pooled.T @ d, d.sum()
        dp = d[:, None] * p["out"]
        de = w * np.einsum("tbh,bh->tb", states - pooled, dp)
        g["attend"] = np.einsum("tb,tbh->h", de, states)
        ds = w[:, :, None] * dp + de[:, :, None] * p["attend"]
        dx = np.zeros_like(x)
        for name, lo, keep, cols in (("fore", 0, keeps[0], slice(0, n)), ("back", 3 * n, keeps[1], slice(n, 2 * n))):
            dh, u = np.zeros((len(idx), n), f32), p[name]
            for t, h, a, z, r, c in reversed(keep):
                dh = dh + ds[t][:, cols]
                m = mask[:, t, None]
                dn = np.where(m, dh, 0)
                dc = dn * (1 - z) * (1 - c * c)
                dz = dn * (h - c) * z * (1 - z)
                dr = dc * a[:, 2 * n :] * r * (1 - r)
                da = np.concatenate([dz, dr, dc * r], 1)
                g[name] += h.T @ da
                np.add.at(dx[:, lo : lo + 3 * n], idx[:, t], np.concatenate([dz, dr, dc], 1))
                dh = np.where(m, dn * z, dh) + da @ u.T
        dx = dx[:-1]
        g["in"], g["bias"] = feats.T @ dx, dx.sum(0)
        df = dx @ p["in"].T
        np.add.at(g["word"], ids, df[:, :WORD_DIM])
        g["word"][0] = 0
        size = np.maximum(np.diff(at), 1).astype(f32)[:, None]
        np.add.at(g["char"], grams, np.repeat(2 * df[:, WORD_DIM:] / size, np.diff(at), axis=0))
        return g

    def window_logits(self, place: np.ndarray, x: np.ndarray, first: np.ndarray, length: np.ndarray, step: int = 4096) -> np.ndarray:
        out = np.empty(len(first), f32)
        padded = np.concatenate([place, np.full(WINDOW, len(x) - 1, np.int64)])
        steps = np.arange(WINDOW)
        for lo in range(0, len(first), step):
            mask = steps < length[lo : lo + step, None]
            out[lo : lo + step] = self.forward(x, np.where(mask, padded[first[lo : lo + step, None] + steps], len(x) - 1), mask)
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        """The highest window's score of each text; 0 for texts without a word."""
        words, place, at = split(texts)
        first, length, text = windows(at, STRIDE)
        out = np.zeros(len(texts))
        if len(first):
            logits = self.window_logits(place, self.project(words), first, length)
            starts = np.flatnonzero(np.diff(text, prepend=-1))
            top = np.maximum.reduceat(logits, starts).astype(np.float64)
            out[text[starts]] = 1 / (1 + np.exp(-top))
        return out


def significance(texts_with: np.ndarray, toxic_with: np.ndarray, texts: int, toxic: int) -> np.ndarray:
    """z scores: how much likelier a toxic text is to hold each of some words than another text."""
    p = texts_with / texts
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / toxic + 1 / (texts - toxic)))
    return (toxic_with / toxic - (texts_with - toxic_with) / (texts - toxic)) / spread


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float) -> None:
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, d in g.items():
            self.m[k] += 0.1 * (d - self.m[k])
            self.v[k] += 0.01 * (d * d - self.v[k])
            self.p[k] *= f32(1 - (DECAY if k in ("word", "char") else 0))
            self.p[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-6)).astype(f32)


def train(texts: list[str | None], labels: np.ndarray, seed: int = 7, rounds=ROUNDS, batch: int = 128) -> Network | None:
    """Fits a network; None if a class is missing."""
    labels = np.asarray(labels, f32)
    if not (0 < labels.sum() < len(labels)):
        return None
    words, place, at = split(pa.array(texts, pa.string()))
    holders, pairs = np.divmod(np.unique(np.repeat(np.arange(len(texts)), np.diff(at)) * len(words) + place), max(len(words), 1))
    spread = np.bincount(pairs, minlength=len(words))  # in how many texts
    rare = max(2, len(texts) // 400)
    common = [int(i) for i in np.lexsort((np.arange(len(words)), -spread))[:VOCABULARY] if spread[i] >= rare]
    spelled = words.take(pa.array(common, pa.int64())).to_pylist()
    net = Network({w: i + 1 for i, w in enumerate(spelled)}, seed)
    # every fourth text of a class only sets the threshold: what the network has learnt by heart says little of others
    apart = np.zeros(len(texts), bool)
    for c in (0, 1):
        apart[np.flatnonzero(labels == c)[3::4]] = True
    if min(np.sum(apart & (labels == c)) for c in (0, 1)) < 5:
        apart[:] = False
    first, length, text = windows(at, STRIDE)
    y = labels[text]
    padded = np.concatenate([place, np.full(WINDOW, len(words), np.int64)])
    steps = np.arange(WINDOW)
    stems = pc.utf8_slice_codeunits(words, 0, STEM).dictionary_encode()
    stem = stems.indices.to_numpy().astype(np.int64)
    stem_holders, stem_pairs = np.divmod(np.unique(holders * len(stems.dictionary) + stem[pairs]), max(len(stems.dictionary), 1))
    known = ~apart
    count = lambda of, who, n: (np.bincount(of[known[who]], minlength=n), np.bincount(of[known[who]], weights=labels[who[known[who]]], minlength=n))
    z = np.maximum(significance(*count(pairs, holders, len(words)), known.sum(), labels[known].sum()), significance(*count(stem_pairs, stem_holders, len(stems.dictionary)), known.sum(), labels[known].sum())[stem])
    z = np.append(z, -np.inf)  # padding
    telling = np.empty(len(first), f32)
    for lo in range(0, len(first), 8192):
        at_ = first[lo : lo + 8192, None] + steps
        telling[lo : lo + 8192] = np.where(steps < length[lo : lo + 8192, None], z[padded[at_]], -np.inf).max(1)
    rng = np.random.default_rng(seed)
    adam = Adam(net.p, 0.01)
    few = max(1, 4000 // max(len(first), 1))  # small samples go round more often
    for which, times in rounds:
        use = np.ones(len(first), bool)
        logits = telling if which == "seed" else net.window_logits(place, net.project(words), first, length)
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, text, logits)
        use = (y == 0) | (logits >= top[text] - 0.5)  # a word lies in two windows
        chosen = np.flatnonzero(use & ~apart[text])
        good, bad = chosen[y[chosen] == 0], chosen[y[chosen] == 1]
        for _ in range(times * few):
            bad = rng.permutation(bad)[:WINDOWS]
            n = min(len(good), max(2 * len(bad), 2000))
            hard = good[np.argsort(-logits[good])[: n // 2]]
            some = np.unique(np.concatenate([hard, rng.permutation(good)[: n - len(hard)]]))
            order = rng.permutation(np.concatenate([some, bad]))
            share = f32(max(1.0, len(some) / max(len(bad), 1)) ** 0.5)
            for lo in range(0, len(order), batch):
                w = order[lo : lo + batch]
                mask = steps < length[w, None]
                idx = np.where(mask, padded[first[w, None] + steps], len(words))
                used, inner = np.unique(idx, return_inverse=True)
                if used[-1] != len(words):
                    used = np.append(used, len(words))
                inner = np.where(mask, inner.reshape(idx.shape), len(used) - 1)
                adam.step(net.gradients(words.take(pa.array(used[:-1])), inner, mask, y[w], np.where(y[w] == 1, share, f32(1)), rng))
    # the threshold that tells most texts apart, moved to 0.5: where several do, three quarters of the way up, for texts
    # longer than those of the sample have more windows to be wrong about
    logits = net.window_logits(place, net.project(words), first, length)
    top = np.full(len(texts), -20.0)
    np.maximum.at(top, text, logits)
    judged = apart if apart.any() else ~apart
    top, labels = top[judged], labels[judged]
    order = np.argsort(top)
    right = np.concatenate([[labels.sum()], labels.sum() + np.cumsum(1 - 2 * labels[order])])
    best = np.flatnonzero(right == right.max())
    low, high = top[order[max(best[0] - 1, 0)]], top[order[min(best[-1], len(order) - 1)]]
    net.p["base"] -= f32(low + 0.75 * (high - low))
    return net


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, others: int = OTHERS, sample_bytes: int = SAMPLE_BYTES) -> Network | None:
    """Trains on at most ``sample`` toxic and ``others`` other labelled texts, each of at most ``sample_bytes``, never on held-out ids.

    One task trains, so the driver holds no text, and a lost executor costs one training. Of documents that share an id
    the least text is taken.
    """
    known = labels.where(~held_out(F.col("doc_id"))).where("toxic IN (0, 1)").select("doc_id", "toxic")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    texts = docs.where(F.octet_length("text").between(1, sample_bytes)).select("doc_id", "text")
    parts = []
    for c, most in ((0, others), (1, sample)):
        ids = known.where(chosen(F.xxhash64("doc_id", F.lit(11)), F.col("toxic"), {c: counts.get(c, 0)}, most)).select("doc_id").distinct()
        # about 1.2 * most ids, and a text for each
        parts.append(texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).select(F.col("doc_id").cast("string").alias("id"), "text", F.lit(c).alias("toxic")))
    most_of = {0: others, 1: sample}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(batch.column(k).to_pylist() for k in range(3)))]
        rows.sort(key=lambda r: (zlib.crc32(r[0].encode()), r[1]))
        rows = [r for c, most in most_of.items() for r in [r for r in rows if r[2] == c][:most]]
        net = train([t for _, t, _ in rows], np.array([c for _, _, c in rows])) if rows else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])

    made = parts[0].unionByName(parts[1]).repartition(1).mapInArrow(run, "net binary").collect()  # about 1 MB
    return pickle.loads(made[0]["net"]) if made else None


def score(df: DataFrame, net: Network | None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """df with score and predicted."""
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(net)  # a constant size
    rest = [c for c in df.columns if c not in ("score", "predicted") and (keep_text or c != text)]
    rows = df.select(F.struct(F.lit(0).alias("__none"), *(F.col(f"`{c}`") for c in rest if c != text)).alias("meta"), F.col(f"`{text}`").cast("string").alias("text"))

    schema = T.StructType([rows.schema["meta"], *([rows.schema["text"]] if keep_text else []), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 1, CHUNK):
            offsets = text_bytes(batch.column(1))[1]
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, side="right")) - 1)
                part = batch.slice(lo, hi - lo)
                got = sent.value.score(part.column(1)) if sent.value is not None else np.zeros(hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), *([part.column(1)] if keep_text else []), pa.array(got, pa.float64())], names=schema.names)
                lo = hi
        trim()

    return rows.mapInArrow(run, schema).select(*(F.col("text").alias(c) if c == text else F.col(f"meta.`{c}`") for c in rest), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, net, keep_text=False).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

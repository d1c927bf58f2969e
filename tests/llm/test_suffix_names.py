"""Substring dedup on structured texts, where hashes of a rolling kind agree, and with hot names split by shifts."""

import hashlib
import random

import numpy as np
import pytest

from quern.llm import suffix


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def brute(texts: list[str], length: int) -> list[tuple[int, int, int, str]]:
    """The contract by its words: every string of the length, counted by its bytes."""
    data, times = [t.encode() for t in texts], {}
    for d in data:
        for i in range(len(d) - length + 1):
            times[d[i : i + length]] = times.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if times[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(x for x, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def structured() -> list[str]:
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, short = text(230), text(199)
    near = text(900)
    return [
        thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a"), thue_morse(700, "x", "y"), "ab" * 300, "z" * 450, text(97) * 7,
        text(50) + passage + text(33), passage, text(131) + passage, passage[7:] + text(150), text(64) + passage[:211] + text(3), text(20) + short + text(90), short, text(140) + short,
        near, near[:400] + "!" + near[401:], near[:400] + "?" + near[401:], near[300:700], "é" * 120, "é" * 99 + text(300), "", "q" * 199, near, near[200:] + near[:200],
    ]


@pytest.mark.parametrize("settings", [{}, {"block_bytes": 500}, {"hot": 0, "block_bytes": 700}, {"hot": 1, "items": 8, "names": 64, "block_bytes": 300}])
def test_structured_texts(spark, settings):
    texts = structured()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = suffix.dedup_substrings(rows, **settings).orderBy("doc_id").collect()
    for r, want, t in zip(got, brute(texts, 200), texts):
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, (r.doc_id, t[:30])


def test_shifts_of_items():
    """Random items over two letters against a comparison of all pairs."""
    rng = np.random.default_rng(3)
    for lo, hi in ((0, 9), (4, 7)):
        length, n = 14, 300
        least = rng.integers(lo, hi, n)
        most = rng.integers(lo, hi, n)
        items = np.concatenate([(rng.random(n) < 0.1)[:, None], least[:, None], most[:, None], rng.integers(97, 99, (n, hi - 1 + length - lo))], 1).astype(np.uint8)
        items[rng.integers(0, n, 40)] = items[rng.integers(0, n, 40)]
        got = suffix.repeated_shifts(items, lo, hi, length)
        before, after = items[:, 3 : 2 + hi], items[:, 2 + hi :]
        for d in range(lo, hi):
            room = [i for i in range(n) if items[i, 1] <= d <= items[i, 2]]
            names = {i: (before[i, :d].tobytes(), after[i, : length - d].tobytes()) for i in room}
            times = {}
            for i in room:
                times[names[i]] = times.get(names[i], 0) + 1 + items[i, 0]
            assert [bool(x) for x in got[:, d - lo]] == [i in names and times[names[i]] > 1 for i in range(n)]

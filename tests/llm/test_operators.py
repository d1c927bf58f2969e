"""Each operator against a brute-force version, and over rows that are null, empty, long, repeated or oddly named."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import decontaminate, htmltext, language, packing, quality, sharding, simhash, suffix, toxicity, warc
from quern.llm.components import components

CLASHING = ("meta", "b", "block", "ends", "data", "answers", "id", "tile", "fp", "row", "h", "cell", "rank", "host", "_words", "_row", "__words", "__lines", "__hashes", "__fp", "__row", "of", "digest", "size", "sketch", "_", "score", "n_words", "kept", "shard", "slot", "fingerprint", "n_hit", "n_bytes")


def docs_of(spark, texts, clash=False):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in CLASHING}) if clash else df


ODD = [None, "", " \n\t", "one", "same text", "same text", "é ß 日本語", "a,b", "word " * 20000, "x" * 5000]


# --- quality rules


def quality_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_quality_measures(spark):
    rng = random.Random(5)
    texts = [*ODD[:-2], "w " * 300, "a b c d e f g h", "a b c d e f g h a b c d e f g h i", "x\nx\nx\n\n \ny#$"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(40)]
    book = {r.doc_id: r for r in quality.ledger(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = book[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == quality_of(t), t
        assert bool(r.fail_bits & 3) == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def test_policies_and_ablation(spark, sf_dir):
    book = quality.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")).cache()
    rows = [r.fail_bits for r in book.collect()]
    for r in quality.ablation(book).collect():
        policy = next(p for p in quality.POLICIES if p.version == r.policy)
        mask, bit = policy.mask(), quality.Policy("", (r.rule,)).mask()
        assert r.rejected == sum(bool(b & mask) for b in rows)
        assert r.hit == sum(bool(b & bit) for b in rows)
        assert r.only_this == sum(b & mask == bit for b in rows)
    assert quality.apply_policy(book, quality.POLICIES[-1]).where("kept").count() == sum(b == 0 for b in rows)


# --- sharding


def test_ring_balance_and_slots(spark):
    df = docs_of(spark, ["t"] * 1003, clash=True)
    rows = sharding.shard_rows(df, "doc_id").select("doc_id", "shard", "slot").collect()
    counts = collections.Counter(r.shard for r in rows)
    assert len(rows) == 1003 and set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))


def test_bounded_load_moves_few(spark):
    """With one more row, or one more shard, most keys stay."""
    counts = {c: 25 for c in range(sharding.CELLS)}
    where = lambda plan: {(c, k): s for c, lo, hi, s, _ in plan for k in range(lo, hi)}
    before, grown = where(sharding.deal(counts, 8)), where(sharding.deal(counts, 9))
    assert sum(before[k] != grown[k] for k in before) < 0.35 * len(before)
    more = where(sharding.deal(counts | {7: 26}, 8))
    assert sum(before[k] != more[k] for k in before) < 0.01 * len(before)


def test_key_law_moves_only_into_the_new_shard(spark):
    df = spark.range(4000).select("id", sharding.shard_of_key(F.col("id"), 8).alias("a"), sharding.shard_of_key(F.col("id"), 9).alias("b"))
    assert df.where("a <> b AND b <> 8").count() == 0
    assert 0 < df.where("a <> b").count() < 1000


# --- substring dedup


def cut_of(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("settings", [{}, {"block_bytes": 1500, "names": 64, "rounds": 3}, {"block_bytes": 1, "names": 16}])
def test_substring_dedup(spark, settings):
    rng = random.Random(1)
    base = "".join(rng.choice("abcdé ") for _ in range(900))
    texts = [None, "", base, base, base[:230], base[100:500] + "x" * 50, "y" * 700, "short", base[300:], "q" + base[200:420] + "zz" + base[600:810], base[:199], "z" * 199, "w" * 200, "v" * 201]
    texts += ["".join(rng.choice("ab") for _ in range(300)) for _ in range(10)]
    got = suffix.dedup_substrings(docs_of(spark, texts), **settings).orderBy("doc_id").collect()
    assert [tuple(r)[2:] for r in got] == cut_of(texts, 200)


def test_substring_dedup_over_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = suffix.op10_suffix_dedup(spark, sf_dir).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == cut_of([r.text for r in rows], 200)


def test_difference_covers():
    for q in (2, 3, 5, 7, 11):
        v, cover = suffix.difference_cover(q)
        assert len(cover) == q + 1 and {(a - b) % v for a in cover for b in cover} == set(range(v))


# --- SimHash


def print_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, ids):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(prints, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3) + i + 1:
            x, y = find(i), find(int(j))
            parent[max(x, y)] = min(x, y)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_simhash(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    texts, ids = [*(r.text for r in rows), *ODD[:-2]], [*(r.doc_id for r in rows), *range(10**6, 10**6 + len(ODD) - 2)]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    prints = [print_of(t) for t in texts]
    for d, p, c in zip(ids, prints, linked(prints, ids)):
        assert (got[d].fingerprint, got[d].component_id) == (f"{p:016x}", c)


def shingles_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {""}


def test_similar_texts(spark, sf_dir):
    """The documents kept against a comparison of all pairs of texts, with copies changed more and more."""
    rng = random.Random(4)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    texts, ids = [*(r.text for r in rows), *ODD], [*(r.doc_id for r in rows), *range(10**6, 10**6 + len(ODD))]
    for n in (30, 90, 400):
        base = [f"w{rng.randrange(900)}" for _ in range(n)]
        for changes in (0, 0, 1, 1, 2, 3, 4, 6, 9):
            words = list(base)
            for _ in range(changes):
                words[rng.randrange(n)] = "other"
            texts.append(" ".join(words))
            ids.append(2 * 10**6 + len(ids))
    sets = [shingles_of(t) for t in texts]
    least = dict(zip(ids, ids))
    alike = [(i, j) for i in range(len(ids)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in range(20):
        for i, j in alike:
            least[ids[i]] = least[ids[j]] = min(least[ids[i]], least[ids[j]])
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASHING})
    for settings in ({}, {"chunk": 20, "sent": 0}):
        kept = sorted(r.doc_id for r in simhash.keep_first(df, **settings).collect())
        assert kept == sorted(set(least.values()))
    twice = simhash.keep_first(df.union(df))
    assert sorted(r.doc_id for r in twice.collect()) == kept and twice.columns == df.columns
    assert simhash.keep_first(df.limit(0)).count() == 0


def test_forest_of_a_large_class():
    """A class of hundreds of similar texts gives links that join it, and about as many."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    made = []
    for _ in range(700):
        words = list(base)
        words[int(rng.integers(0, 120))] = f"x{rng.integers(0, 9999)}"
        made.append(simhash.signature(" ".join(words)))
    fp, size, sketch = np.array([m[0] for m in made]).view(np.uint64), np.array([m[1] for m in made]), np.array([list(m[2]) for m in made], np.uint8)
    i, j = simhash.likely_links(fp, size, sketch, 300, True, columns=64)
    more = simhash.likely_links(fp[300:], size[300:], sketch[300:], 400, True)
    joined = simhash._Joined(700)
    joined.join(np.concatenate([i, more[0] + 300]), np.concatenate([j, more[1] + 300]))
    assert len(i) < 2 * 700 and len(set(joined.label.tolist())) == 1


def test_similar_texts_with_fingerprints_far_apart(spark):
    """A text and the same without its last word share four of five shingles, while many fingerprints differ in over 20 bits."""
    rng = random.Random(5)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(9)] for _ in range(2000)]
    texts += [t[:8] for t in texts]
    prints = [simhash.signature(" ".join(t))[0] for t in texts]
    assert sum(((x ^ y) & (1 << 64) - 1).bit_count() > simhash.WIDE for x, y in zip(prints, prints[2000:])) >= 5
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for settings in ({}, {"chunk": 400, "sent": 0}):
        assert sorted(r.doc_id for r in simhash.keep_first(df, **settings).collect()) == list(range(2000))


def test_other_links_against_all_pairs():
    """No similar pair of different labels is left out, at any size and share, and none comes twice; few others come."""
    rng = np.random.default_rng(6)
    for n in (1, 2, 5, 9, 31, 130, 1000, 5000, 9000):
        sets = []
        for _ in range(12 if n > 500 else 40):
            base = rng.integers(0, 2**64, n, dtype=np.uint64)
            sets.append(np.unique(base))
            for change in (0, 0.05, 0.1, 0.11, 0.2, 0.23):
                cut = base[int(rng.uniform(0, 1) * change * n) :]
                sets.append(np.unique(np.concatenate([cut, rng.integers(0, 2**64, int(rng.uniform(0, 1) * change * n), dtype=np.uint64)])))
        rng.shuffle(sets)
        size, fp, label = np.array([len(x) for x in sets]), np.array([simhash._majority(x) for x in sets], np.uint64), rng.integers(0, 9, len(sets))
        as_sets = [set(x.tolist()) for x in sets]
        homes = len(sets) // 3
        got = [(int(x), int(y)) for i, j, _ in simhash.other_links(fp, size, [simhash._parity(x) for x in sets], label, homes, True, columns=50) for x, y in zip(i, j)]
        pairs = {(min(i, j), max(i, j)) for i, j in got}
        assert len(pairs) == len(got) and all(i < homes and label[i] != label[j] for i, j in pairs)
        shares = {(i, j): len(as_sets[i] & as_sets[j]) / len(as_sets[i] | as_sets[j]) for i in range(homes) for j in range(i + 1, len(sets)) if label[i] != label[j]}
        alike = {p for p, share in shares.items() if share >= 0.8}
        assert alike and alike <= pairs
        assert sum(shares[p] <= 0.5 for p in pairs) <= 0.01 * len(shares)


@pytest.mark.parametrize("chunk", [3, 1 << 15])
def test_links_of_chains_and_chunked_tiles(spark, chunk):
    rng = np.random.default_rng(3)
    prints = []
    for b in rng.integers(0, 2**63, 20, dtype=np.uint64):
        x = int(b)
        for _ in range(20):
            prints.append(x)
            for bit in rng.integers(0, 64, 3):
                x ^= 1 << int(bit)
    prints = list(dict.fromkeys(prints))
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)), i) for i, p in enumerate(prints)], "fp long, id long")
    found = {r.id: r.component for r in components(simhash.near_links(df, chunk=chunk)).collect()}
    assert [found.get(i, i) for i in range(len(prints))] == linked(prints, list(range(len(prints))))


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{k: 1000 for k in range(1000, 1100)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- decontamination


def hits_of(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, ids = split(text), set(), set()
    for item, t in items:
        w = split(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for k in range(len(words) - n + 1):
                if words[k : k + n] == w[i : i + n]:
                    hit |= set(range(k, k + n))
                    ids.add(str(item))
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


@pytest.mark.parametrize("block_bytes", [1 << 24, 40])
def test_decontamination(spark, block_bytes):
    rng = random.Random(2)
    some = lambda n: " ".join(rng.choice(["The", "cat", "sat", "é9", "mat", "x"]) for _ in range(n))
    items = [(10, some(12)), (9, some(4)), (1, some(10)), (2, None), (3, ""), (4, "cat"), (5, some(30)), (6, some(12)), (1, some(11))]
    texts = [None, "", "no match here", items[0][1] + "!", "CAT", some(200), items[6][1][5:], " , ".join(items[2][1].split()), *(some(40) for _ in range(15))]
    df = decontaminate.decontaminate(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    for r in df.collect():
        digest = hashlib.sha256(",".join(r["items"]).encode()).hexdigest()
        assert (r.n_words, r.n_hit, len(r["items"]), digest) == hits_of(texts[r.doc_id], items)
        assert r.contaminated == (r.n_hit > 0) and r.text == texts[r.doc_id]


# --- packing


def test_packing_covers_every_id(spark, sf_dir):
    tok = packing.tokenizer()
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += ["a<|startoftext|>b  <|endoftext|>", "x é é́ ΣΑΣ. I'LL it's", "\t\n\x0b\x1c a", "İstanbul ǅ ﬁ ½", "don't É, ẞ naïve…", None, "", "word " * 9000]
    rows = packing.pack(docs_of(spark, texts), with_ids=True).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
    for i, t in enumerate(texts):
        got = sorted(pieces[i], key=lambda r: r.start)
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        assert [x for r in got for x in r.ids] == ids and {r.doc_tokens for r in got} == {len(ids)}
    padding = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and len(s) <= packing.SEGMENTS
        padding += 2048 - at if at & (at - 1) else 0
    assert padding == 0


def test_packer_keeps_three_limits():
    rng = np.random.default_rng(4)
    packer, rows, sizes = packing.Packer(tokens=100, segments=4, loss=50, cut=False, pool=16), [], {}
    for k in range(200):
        n = int(rng.integers(1, 60))
        bears = rng.random(n) < 0.5
        bears[np.cumsum(bears) > 50] = False
        sizes[k] = (n, int(bears.sum()))
        rows += packer.add(k, np.arange(n, dtype=np.uint32), bears)
    rows += packer.finish()
    assert sorted(r[0] for r in rows) == list(range(200))
    by = collections.defaultdict(list)
    for key, start, ids, s, offset in rows:
        assert start == 0 and len(ids) == sizes[key][0]
        by[s].append(key)
    for keys in by.values():
        assert len(keys) <= 4 and sum(sizes[k][0] for k in keys) <= 100 and sum(sizes[k][1] for k in keys) <= 50
    assert len(by) <= 1.35 * max(sum(a for a, _ in sizes.values()) / 100, 200 / 4, sum(b for _, b in sizes.values()) / 50)
    with pytest.raises(ValueError):
        list(packing.Packer(tokens=10, cut=False).add("long", np.zeros(11, np.uint32)))


# --- toxicity


def test_gradients(monkeypatch):
    monkeypatch.setattr(toxicity, "f32", np.float64)
    texts = ["you idiot fool", "hello nice day today", "what a moron idiot he is", "the day is nice and fine"]
    words, place, at = toxicity.split(pa.array(texts))
    net = toxicity.Network({w: i + 1 for i, w in enumerate(words.to_pylist()[:5])})
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    first, length, _ = toxicity.windows(at, toxicity.STRIDE)
    steps = np.arange(toxicity.WINDOW)
    mask = steps < length[:, None]
    idx = np.where(mask, np.concatenate([place, np.full(toxicity.WINDOW, len(words))])[first[:, None] + steps], len(words))
    y, weight = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 1])

    def loss():
        x = np.concatenate([net.features(words)[0] @ net.p["in"] + net.p["bias"], np.zeros((1, 6 * toxicity.HIDDEN))])
        z = net.forward(x, idx, mask)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() / weight.sum())

    grads, rng = net.gradients(words, idx, mask, y, weight), np.random.default_rng(0)
    for name, g in grads.items():
        flat = net.p[name].reshape(-1)
        for i in rng.choice(np.flatnonzero(g), min(3, np.count_nonzero(g)), replace=False):
            old, e = flat[i], 1e-3
            flat[i] = old + e
            up = loss()
            flat[i] = old - e
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * e) - g.reshape(-1)[i]) < 1e-4, name


def test_windows_overlap_and_cover_the_text():
    at = np.array([0, 0, 5, 100, 132, 133, 500])
    first, length, text = toxicity.windows(at, toxicity.STRIDE)
    for t in range(len(at) - 1):
        mine = np.flatnonzero(text == t)
        seen = {p for w in mine for p in range(first[w], first[w] + length[w])}
        assert seen == set(range(at[t], at[t + 1]))
    assert (length <= toxicity.WINDOW).all()


def test_toxicity_held_out(spark):
    out = toxicity.op2_toxicity(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.85 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out.collect())


# --- HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain text", "plain text"),
        ("<p>A  b<br>c</p><p>d&amp;e &copy;</p>", "A b c d&e ©"),
        ("<body><nav><a href=x>Menu</a></nav><article><h1>T</h1><p>One, two<p>Three <b>bo</b>ld</article><aside>Side, bar, words, here</aside><footer>F</footer>", "T One, two Three bold"),
        ("<div class='sidebar'><p>" + "noise, " * 40 + "</p></div><div id=content><p>" + "real, " * 30 + "end</p></div>", "real, " * 30 + "end"),
        ("<article><p>Text, here</p><script>var a='</p>';</script><style>p{}</style><!-- no --><div class='comments'><p>me, too, yes</p></div></article>", "Text, here"),
        ("<main><p>keep, this</p><form><p>not, this</p><input></form><div style='display:none'>hid</div></main>", "keep, this"),
        ("<article><ul><li>a, b, c<li>d, e, f</ul><table><tr><td>1<td>2<tr><td>3</table></article>", "a, b, c d, e, f 1 2 3"),
    ],
)
def test_main_text(page, text):
    assert htmltext.main_text(page) == text


def test_main_text_of_deep_nesting():
    assert htmltext.main_text("<div>" * 20000 + "<p>deep, down</p>") == "deep, down"


def test_html_over_pages(spark, sf_dir):
    import html

    rows = {r.page_id: r for r in htmltext.op5_html_extraction(spark, sf_dir).collect()}
    for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", inner)).split())
        assert rows[p.page_id].text == want and rows[p.page_id].n_chars == len(want)


# --- WARC


def test_warc_round_trip(spark, sf_dir):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    rows += [(9001, "http://a.com/x\n y", "same"), (9002, None, "same"), (9003, "b", None), (9004, "b", ""), (None, "b", "same"), (9004, "b", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.write_archives(df, archive_bytes=4000)
    got = warc.history(warc.read_archives(archives)).collect()
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", -1), i)
    want = collections.Counter()
    for i, _, h in rows:
        payload, top = (h or "").encode(), largest[h or ""]
        want[i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if i == top else "revisit", None if i == top else top] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    keys = [(r.url_key, r.captured_at) for r in got]
    assert keys == sorted(keys)


def test_warc_threshold(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "a"), (4, "u", "a")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.read_archives(warc.write_archives(df, min_bytes=2)).collect()}
    assert got == {1: "revisit", 2: "response", 3: "response", 4: "response"}


def test_loser_tree():
    rng = random.Random(6)
    for k in range(9):
        runs = [sorted((rng.randrange(50), j, i) for i in range(rng.randrange(8))) for j in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("HTTPS://www.News.Example.com:80/a?b=1#c") == "com,example,news)/a?b=1"
    assert warc.url_key(None) == ")/"


# --- language


def test_language(spark, sf_dir):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    pages = {r.page_id: re.search('lang="(..)"', r.html)[1] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = language.op3_language_id(spark, sf_dir).collect()
    assert len(rows) == len(docs) + len(pages)
    right = sum(r.lang == (docs[r.doc_id] if r.doc_id is not None else pages[r.page_id]) for r in rows)
    assert right >= 0.97 * len(rows) and all(0 < r.confidence <= 1.000001 for r in rows)


def test_language_evidence_without_text(spark):
    model = language.Model(["de", "en"], {"de": ["der die das und nicht ein"] * 5, "en": ["the of and to in it is"] * 5})
    rows = [("der die das und nicht", "a.example.de", "de")] * 20 + [("the of and to in", "b.example.com", "en")] * 20 + [(None, "a.example.de", None), ("", "b.example.com", None), (None, "new.example.xyz", "de"), (None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, host string, declared string").withColumns({c: F.lit(1) for c in ("row", "_domain", "lang", "_n", "meta")})
    got = {r.doc_id: r.lang for r in language.identify(df, model).select("doc_id", "lang").collect()}
    assert [got[40], got[41], got[42]] == ["de", "en", "de"] and len(got) == 44


# --- every operator over odd rows, clashing names and no rows


OPERATORS = {
    "quality": lambda s, d: quality.ledger(d),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.train(["bad idiot"] * 4 + ["fine day"] * 4, np.array([1] * 4 + [0] * 4))),
    "untrained": lambda s, d: toxicity.score(d, None),
    "decontamination": lambda s, d: decontaminate.decontaminate(d, s.createDataFrame([(1, "same text")], "item_id long, text string")),
    "no items": lambda s, d: decontaminate.decontaminate(d, s.createDataFrame([], "item_id long, text string")),
    "sharding": lambda s, d: sharding.shard_rows(d, "doc_id"),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "suffix": lambda s, d: suffix.dedup_substrings(d),
    "html": lambda s, d: htmltext.extract(d.withColumnRenamed("text", "html")),
    "language": lambda s, d: language.identify(d.withColumn("declared", F.lit(None).cast("string")), language.Model(["de", "en"], {"de": ["der und"], "en": ["the of"]})),
}


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("clash", [False, True])
def test_odd_rows(spark, name, clash):
    df = docs_of(spark, ODD, clash)
    if name == "language" and not clash:
        df = df.withColumn("host", F.lit("h.example.org"))
    df = df.union(df).union(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    out = OPERATORS[name](spark, df)
    rows = out.collect()
    assert len(rows) == 2 * len(ODD) + 1 and len(set(out.columns)) == len(out.columns)
    assert len(OPERATORS[name](spark, df.limit(0)).collect()) == 0


def test_packing_of_odd_rows(spark):
    df = docs_of(spark, ODD, True)
    assert packing.pack(df.union(df)).select("doc_id").distinct().count() == len(ODD)
    assert packing.pack(df.limit(0)).count() == 0
    assert packing.pack(df.withColumn("doc_id", F.lit(None).cast("long"))).count() >= len(ODD)


def test_warc_of_no_rows(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.history(warc.read_archives(warc.write_archives(df))).count() == 0


def test_conversations(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-1, 0, None, None), (-1, 1, "assistant", "hello"), (-2, 0, "user", "word " * 9000), (-2, 1, "assistant", "yes " * 3000)], "conv_id long, turn long, role string, text string")
    turns, tok = turns.unionByName(odd), packing.tokenizer()
    want = collections.defaultdict(list)
    for r in turns.orderBy("conv_id", "turn").collect():
        want[r.conv_id] += [(i, r.role == "assistant") for i in [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]]
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack_conversations(turns, segments=8, loss=1024).collect():
        pieces[r.conv_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for k, rows in pieces.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.ids == [i for i, _ in want[k][at : at + r.length]] and r.loss_tokens == sum(b for _, b in want[k][at : at + r.length])
            at += r.length
        assert at == len(want[k])
    for rows in sequences.values():
        assert sum(r.length for r in rows) <= 2048 and len(rows) <= 8 and sum(r.loss_tokens for r in rows) <= 1024

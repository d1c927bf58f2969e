"""Language identification by Bayesian fusion of evidence.

Text gives likelihoods of character n-grams. The declared markup language and the address suffix give likelihoods that
are learnt from the corpus: how often each language, as the text alone tells it, declares what or sits where. Hosts give
priors, smoothed towards their domain's, which are smoothed towards the whole corpus's. All counts are grouped sums of
text posteriors over all rows; a row's own share is taken out of its host's before it is used as its prior.

The n-gram tables are fitted on at most SAMPLE texts a language. Null or empty text gives no evidence, so such a row is
decided by the rest; a missing host, suffix or declaration gives none either. Repeated rows count as often as they are
there. Every row is returned. Other columns pass through; result columns replace those of the same name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.bytescan import gathered, text_bytes
from quern.llm.shared import chosen, small_batches, store, table
from quern.llm.toxicity import BUCKETS, ngrams, split

SAMPLE = 250
SAMPLE_BYTES = 8192
TEMPER = 0.2
HOST_WEIGHT = DOMAIN_WEIGHT = 8.0
EVIDENCE_WEIGHT = 4.0
CHUNK = 6 << 20


class Model:
    """Log likelihoods of n-gram buckets by language."""

    def __init__(self, langs: list[str], texts: dict[str, list[str]]) -> None:
        self.langs = langs
        counts = np.full((BUCKETS, len(langs)), 0.5)
        for k, lang in enumerate(langs):
            words, place, _ = split(pa.array(texts[lang], pa.string()))
            grams, at = ngrams(words)
            np.add.at(counts[:, k], grams, np.repeat(np.bincount(place, minlength=len(words)), np.diff(at)))
        self.table = np.log(counts / counts.sum(0)).astype(np.float32)

    def posteriors(self, texts: pa.Array) -> np.ndarray:
        """By text alone, under a flat prior."""
        words, place, at = split(texts)
        total = np.zeros((len(texts), len(self.langs)))
        if len(place):
            each = np.zeros((len(words), len(self.langs)), np.float32)
            for lo in range(0, len(words), 1 << 15):
                grams, of = ngrams(words.slice(lo, 1 << 15))
                each[lo : lo + (1 << 15)] = np.add.reduceat(self.table[grams], of[:-1], axis=0)
            each -= each.mean(1, keepdims=True)
            some = np.flatnonzero(np.diff(at))
            total[some] = np.add.reduceat(each[place], at[some], axis=0, dtype=np.float64)
        total = TEMPER * (total - total.max(1, keepdims=True))
        p = np.exp(total)
        return p / p.sum(1, keepdims=True)


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """A model of every language in ``lang``, from at most ``sample`` texts of each, of at most ``sample_bytes``."""
    known = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.octet_length("text").between(1, sample_bytes))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    langs, texts = sorted(counts), {k: [] for k in counts}
    # texts below a threshold of their hash, such that about ``sample`` of each language are: what comes here doesn't grow
    # however many rows share a text, it comes once
    for r in known.where(chosen(F.xxhash64("text"), F.col("lang"), counts, sample)).select("lang", "text").distinct().collect():
        texts[r["lang"]].append(r["text"])
    texts = {k: sorted(v, key=lambda t: zlib.crc32(t.encode()))[:sample] for k, v in texts.items()}
    langs = [k for k in langs if texts[k]]
    return Model(langs, texts) if langs else None


def _posteriors(df: DataFrame, text: str, model: Model) -> DataFrame:
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)  # a constant size for each language
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text)).alias("meta"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 1, CHUNK):
            offsets = text_bytes(batch.column(1))[1]
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, side="right")) - 1)
                part = batch.slice(lo, hi - lo)
                p = sent.value.posteriors(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64()))], names=["meta", "text_post"])
                lo = hi

    out = rows.mapInArrow(run, T.StructType([rows.schema["meta"], T.StructField("text_post", T.ArrayType(T.DoubleType()))]))
    return out.select("meta.*", "text_post")


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def declared_in(page: Column) -> Column:
    """The primary language subtag of the html element."""
    return F.nullif(F.lower(F.regexp_extract(page, r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})\b", 1)), F.lit(""))


def visible(page: Column) -> Column:
    return F.regexp_replace(page, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")


def identify(df: DataFrame, model: Model, text: str = "text", host: str = "host", declared: str = "declared") -> DataFrame:
    """df without its text, with text_lang (by text alone), lang, and confidence (the posterior of lang)."""
    n, langs = len(model.langs), F.array(*map(F.lit, model.langs))
    rest = [c for c in df.columns if c not in (text, "text_lang", "lang", "confidence")]
    at = F.col(f"`{host}`")
    end = lambda k: F.when(at.contains("."), F.substring_index(at, ".", -k))
    keyed = df.select(F.struct(F.lit(0).alias("__none"), *(F.col(f"`{c}`") for c in rest)).alias("row"), at.alias("host"), end(2).alias("_domain"), end(1).alias("_suffix"), F.col(f"`{declared}`").alias("declared"), F.col(f"`{text}`").alias("text"))
    rows, _ = store(_posteriors(keyed, "text", model))

    def sums(by: list[str], into: str) -> DataFrame:
        return rows.where(F.col(by[-1]).isNotNull()).groupBy(*by).agg(F.array(*(F.sum(F.col("text_post")[i]) for i in range(n))).alias(into))

    total = rows.agg(*(F.sum(F.col("text_post")[i]) for i in range(n))).first()
    everywhere = [1 / n] * n if total[0] is None else [(x + 1) / (sum(total) + n) for x in total]
    overall = F.array(*map(F.lit, everywhere))
    hosts = sums(["_domain", "host"], "_host_n")
    domains = sums(["_domain"], "_domain_n")

    def of_evidence(by: str, into: str) -> DataFrame:
        """Log likelihood of each value of a column, given each language, smoothed towards the value's overall share."""
        found = sums([by], "_n")
        everything = found.agg(*(F.sum(F.col("_n")[i]) for i in range(n))).first()
        by_lang = F.array(*(F.lit(float(x or 0)) for x in everything))
        share = F.aggregate("_n", F.lit(0.0), lambda a, x: a + x) / F.lit(max(sum(x or 0 for x in everything), 1e-9))
        return found.select(by, F.zip_with("_n", by_lang, lambda x, t: F.log((x + EVIDENCE_WEIGHT * share) / (t + EVIDENCE_WEIGHT))).alias(into))

    said, sits = of_evidence("declared", "_said"), of_evidence("_suffix", "_sits")
    full = rows.join(hosts.drop("_domain"), "host", "left").join(domains, "_domain", "left").join(said, "declared", "left").join(sits, "_suffix", "left")
    zero = F.array_repeat(F.lit(0.0), n)
    own = F.col("text_post")
    minus = lambda c: F.zip_with(F.coalesce(F.col(c), own), own, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    smooth = lambda counts, towards, weight: F.zip_with(counts, towards, lambda a, p: (a + weight * p) / (size(counts) + weight))
    full = full.withColumn("_h", minus("_host_n")).withColumn("_d", minus("_domain_n"))
    full = full.withColumn("_prior", smooth(F.col("_d"), overall, DOMAIN_WEIGHT)).withColumn("_prior", smooth(F.col("_h"), F.col("_prior"), HOST_WEIGHT))
    score = F.zip_with(own, F.col("_prior"), lambda t, p: F.log(t + F.lit(1e-12)) + F.log(p + F.lit(1e-12)))
    for c in ("_said", "_sits"):
        score = F.zip_with(score, F.coalesce(F.col(c), zero), lambda a, b: a + b)
    full = full.withColumn("_score", score).withColumn("_top", F.array_max("_score"))
    pick = lambda scores, top: F.element_at(langs, F.array_position(scores, top).cast("int"))
    return full.select(
        *(F.col(f"row.`{c}`") for c in rest),
        F.when(F.array_max(own) > F.array_min(own), pick(own, F.array_max(own))).alias("text_lang"),
        pick(F.col("_score"), F.col("_top")).alias("lang"),
        (1 / F.aggregate("_score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))).alias("confidence"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (their source is their host) and all pages (with host, suffix and declared language)."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    nothing = F.lit(None)
    rows = docs.select("doc_id", nothing.cast("long").alias("page_id"), F.col("source").alias("host"), nothing.cast("string").alias("declared"), "text").unionByName(
        pages.select(nothing.cast("long").alias("doc_id"), "page_id", host_of(F.col("url")).alias("host"), declared_in(F.col("html")).alias("declared"), visible(F.col("html")).alias("text"))
    )
    model = fit(docs)
    if model is None:
        return rows.select("doc_id", "page_id", *(F.lit(None).cast(t).alias(c) for c, t in (("text_lang", "string"), ("lang", "string"), ("confidence", "double"))))
    return identify(rows, model).select("doc_id", "page_id", "text_lang", "lang", "confidence")

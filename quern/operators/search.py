"""Lexical and tiered search over documents: postings, BM25F, phrases, tiers and their fold."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import tokens
from quern.model import BM25_B, BM25_K1, FIELD_WEIGHT, MICROS

FIELDS = ("body", "name", "path", "qualified_name", "signature")


def parse(query: str) -> list[list[str]]:
    """The query's units: a quoted part is a phrase, other words stand alone. An open quote ends with the query; a unit
    that was there before is left out."""
    out: list[list[str]] = []
    for i, part in enumerate(query.split('"')):
        folded = "".join(c for c in unicodedata.normalize("NFD", part) if not unicodedata.combining(c)).lower()
        words = re.findall(r"[^\W_]+", folded)
        for unit in [words] if i % 2 else [[w] for w in words]:
            if unit and unit not in out:
                out.append(unit)
    return out


def columns_of(docs: DataFrame) -> list[str]:
    return [f for f in FIELDS if f in docs.columns]


def with_tokens(docs: DataFrame) -> DataFrame:
    """docs with an array of tokens for each field (t_<field>) and token_count over all fields."""
    have = columns_of(docs)
    out = docs.select("*", *(tokens(F.col(f)).alias(f"t_{f}") for f in have))
    return out.withColumn("token_count", sum((F.size(f"t_{f}") for f in have), F.lit(0)).cast("long"))


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, col, tf, positions): the index, of one explode and one grouping by all three keys."""
    have = columns_of(docs)
    parts = [docs.select("doc_id", F.lit(f).alias("col"), F.posexplode(tokens(F.col(f))).alias("pos", "term")) for f in have]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("term", "doc_id", "col").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def phrase_count(words: Column, phrase: list[str]) -> Column:
    """At how many places of an array of tokens the phrase starts."""

    def starts(t: Column, i: Column) -> Column:
        hit = t == phrase[0]
        for k, w in enumerate(phrase[1:], start=1):
            hit = hit & (F.coalesce(F.get(words, i + k), F.lit("")) == w)
        return hit

    return F.size(F.filter(words, starts))


def hits(docs: DataFrame, units: list[list[str]]) -> DataFrame:
    """(doc_id, unit, token_count, tf by field): documents with a unit. One scan, whatever the number of units; a document
    without any of them leaves before it is shuffled."""
    have = columns_of(docs)
    per_unit = F.array(*(F.struct(F.lit(i).alias("unit"), *(phrase_count(F.col(f"t_{f}"), u).alias(f"tf_{f}") for f in have)) for i, u in enumerate(units)))
    found = with_tokens(docs).select("doc_id", "token_count", F.explode(per_unit).alias("h")).select("doc_id", "token_count", "h.*")
    return found.where(" + ".join(f"tf_{f}" for f in have) + " > 0")


def bm25(docs: DataFrame, units: list[list[str]]) -> DataFrame:
    """(doc_id, score_micros, occurrences): BM25F with exact document frequencies; terms are added in query order."""
    have = columns_of(docs)
    found = hits(docs, units)
    n_docs, n_tokens = with_tokens(docs).agg(F.count(F.lit(1)), F.coalesce(F.sum("token_count"), F.lit(0))).first()
    df = found.groupBy("unit").agg(F.count(F.lit(1)).alias("df"))
    weighted = sum((F.lit(FIELD_WEIGHT[f]) * F.col(f"tf_{f}") for f in have), F.lit(0.0))
    scored = found.join(F.broadcast(df), "unit")  # one row a unit
    average = F.lit(max(n_tokens, 1) / max(n_docs, 1))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    sat = F.col("w") * (BM25_K1 + 1) / (F.col("w") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("token_count") / average))
    each = scored.withColumn("w", weighted).select("doc_id", "unit", (idf * sat).alias("s"), sum((F.col(f"tf_{f}") for f in have), F.lit(0)).alias("occ"))
    summed = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("unit", "s"))).alias("parts"), F.sum("occ").alias("occurrences"))
    total = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["s"])
    micros = F.when(F.isnan(total), F.lit(0)).otherwise(F.round(total * MICROS)).cast("long")
    return summed.select("doc_id", micros.alias("score_micros"), "occurrences")


def normal_path(query: str) -> str | None:
    """A query as a path within the repository, or None if it can't be one."""
    p = query.strip().replace("\\", "/")
    while p.startswith("./"):
        p = p[2:]
    bad = not p or p.startswith("/") or "//" in p or ".." in p.split("/") or re.match(r"^[A-Za-z]:", p)
    return None if bad else p


def tier(query: str, path: str = "path", qualified: str = "qualified_name", name: str = "name") -> Column:
    """The least exact tier a row is in: 0 its path, 1 its qualified name, 2 a prefix of it, 3 its name; null for none."""
    at = normal_path(query)
    out = F.when(F.col(path) == at, 0) if at else F.when(F.lit(False), 0)
    return out.when(F.col(qualified) == query, 1).when(F.col(qualified).startswith(query), 2).when(F.col(name) == query, 3)


def search(docs: DataFrame, query: str, limit: int | None = 200) -> DataFrame:
    """(node_id, tier, score_micros, occurrences, path): exact tiers and the lexical one, folded by node, best first.

    A node keeps its least tier, its largest score and all its occurrences. Without a limit all results come, unordered.
    """
    exact = docs.withColumn("tier", tier(query)).where("tier IS NOT NULL").select("node_id", "tier", F.lit(0).cast("long").alias("score_micros"), F.lit(0).cast("long").alias("occurrences"), "path")
    units = parse(query)
    if units:
        lexical = docs.select("doc_id", "node_id", "path").join(bm25(docs, units), "doc_id").select("node_id", F.lit(4).alias("tier"), "score_micros", F.col("occurrences").cast("long").alias("occurrences"), "path")
        exact = exact.unionByName(lexical)
    folded = exact.groupBy("node_id").agg(F.min("tier").alias("tier"), F.max("score_micros").alias("score_micros"), F.sum("occurrences").alias("occurrences"), F.min("path").alias("path"))
    return folded if limit is None else folded.orderBy("tier", F.desc("score_micros"), "path", "node_id").limit(limit)


def resolve(nodes: DataFrame, query: str, limit: int = 200) -> DataFrame:
    """Symbols by id, qualified name, prefix or name, in that order of trust. An id that exists hides all else."""
    found = nodes.withColumn("tier", F.when(F.col("node_id") == query, -1).when(F.col("qualified_name") == query, 1).when(F.col("qualified_name").startswith(query), 2).when(F.col("name") == query, 3)).where("tier IS NOT NULL")
    by_id = found.where("tier = -1")
    kept = found if by_id.isEmpty() else by_id
    return kept.orderBy("tier", "node_id").limit(limit)


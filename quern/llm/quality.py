"""Quality rules: a bitmask ledger, policies over it, and their ablations. Native: DataFrame functions only.

Every rule is evaluated once a document. The ledger keeps its measurements and one failure bit a rule; a policy is a
versioned mask of rules, applied with one bitwise AND, so a new policy or an ablation reads the ledger and no text.

Null text counts as empty text: no words, so it fails ``too_few_words``. Repeated rows are judged row by row. All other
columns pass through; a column of the input that has the name of a measurement is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import table

WINDOW = 8
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """A named condition over the measurements. Its place in RULES is its bit."""

    name: str
    fails: str


RULES = (
    Rule("too_few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbol_noise", "100 * n_symbols > 30 * n_words"),
    Rule("shouting", "100 * n_exclamations > 30 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 60 * n_lines"),
    Rule("long_words", "word_chars > 40 * n_words"),
)
BASE = ("too_few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A version and the rules it rejects by."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        place = {r.name: i for i, r in enumerate(rules)}
        return sum(1 << place[name] for name in self.rules)


POLICIES = (
    Policy("base", BASE),
    Policy("v1", (*BASE, "symbol_noise", "shouting")),
    Policy("v2", tuple(r.name for r in RULES)),
)


def _bound(value: Column, body) -> Column:
    """body(value) with value computed once, not once for each reference or element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(words: Column, n: Column) -> Column:
    """Words that lie in windows found twice or more, by the windows' own texts."""

    def positions(windows: Column) -> Column:
        hit = F.filter(windows, lambda w, j: (F.get(windows, j - 1)["t"] == w["t"]) | (F.get(windows, j + 1)["t"] == w["t"]))
        return F.sort_array(F.transform(hit, lambda w: w["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    windows = F.sort_array(F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("t"), i.alias("i"))))
    return _bound(_bound(windows, positions), covered)


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the measurements that the rules read.

    Windows are compared in two steps: a document whose window hashes all differ has no repeated window; only the
    others compare the windows' texts. So the count is exact, and most documents never build those texts.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    names = [c for c in df.columns if c not in MEASURES]
    lines = F.filter(F.split(t, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rest = F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`") for c in names))
    split = df.select(rest.alias("of"), t.alias("text"), F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("words"), lines.alias("lines"))
    t, w = F.col("text"), F.col("words")
    hashes = F.when(F.size(w) > WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))))
    counted = split.select(
        "of",
        "words",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(t, r"[^!]+", "")).cast("long").alias("n_exclamations"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("hashes"),
    )
    repeated = F.col("hashes").isNotNull() & (F.size(F.array_distinct("hashes")) < F.size("hashes"))
    return counted.select(*(F.col(f"of.`{c}`") for c in names), *(c for c in MEASURES if c != "n_repeat_words"), F.when(repeated, _repeated_words(w, F.size(w))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_exclamations", "n_lines", "n_dup_lines", "n_repeat_words")


def ledger(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with its measurements and ``fail_bits``: bit i is set where rule i fails."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits + F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return measure(df, text).withColumn("fail_bits", bits)


def apply_policy(book: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES, into: str = "kept") -> DataFrame:
    return book.withColumn(into, F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules))) == 0)


def ablation(book: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and each of its rules: documents that the policy rejects, that the rule hits, and that it alone rejects.

    The ledger is first counted by bitmask, at most 2**rules rows, so the ablation costs one small aggregation.
    """
    rows = [F.struct(F.lit(p.version).alias("policy"), F.lit(r).alias("rule"), F.lit(p.mask(rules)).cast("long").alias("mask"), F.lit(Policy(p.version, (r,)).mask(rules)).cast("long").alias("bit")) for p in policies for r in p.rules]
    masks = book.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return (
        masks.select("fail_bits", "n", F.inline(F.array(*rows)))
        .groupBy("policy", "rule")
        .agg(
            F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("rejected"),
            F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("hit"),
            F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("only_this"),
        )
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = ledger(table(spark, sf_dir, "documents"))
    judged = apply_policy(apply_policy(book, POLICIES[0], into="base_ok"), POLICIES[-1])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_ok")).alias("base_failed"), "kept", "fail_bits")


OP1_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
pos AS (SELECT rid, words, unnest(range(len(words) - 7)) AS i FROM w WHERE len(words) >= 8),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(words[i + 1 : i + 8], ' ')) AS n FROM pos),
hit AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM win WHERE n > 1),
rep AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words FROM hit GROUP BY rid),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        length(regexp_replace(text, '[^!]+', '', 'g'))::BIGINT AS n_exclamations,
        len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (rid)),
b AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_exclamations > 30 * n_words THEN 8 ELSE 0 END
        + CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 16 ELSE 0 END + CASE WHEN word_chars > 40 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""

"""Quality rules as a bitmask ledger: every rule is evaluated once, its failure is a bit, and policies are masks over the bits.

[native]: column expressions and aggregates only. A row's measurements come from its own text, without a shuffle; what is
aggregated afterwards has one row for each pattern of failures, so a source with a third of all rows is no hot key.

A null or empty text has no words, fails "few_words" and no other rule. Repeated rows are judged alike, each on its own, and
an empty table gives an empty ledger. Extra columns are ignored by `ledger`; `passing` keeps them all, whatever their names.
Three-word windows are compared by their 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserax.llm.common import fresh

SPACES = r"[\x20\x09-\x0D]+"
#: What words are made of, within brackets.
WORDLY = r"^\x20\x09-\x0D"
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letterless", "n_capitals",
    "n_bullet_lines", "n_ellipsis_lines",
)

#: Name and failure, over the measurements, in integers. A rule's place is its bit for good: new rules are put at the end.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "5 * n_dup_lines > 2 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("few_letters", "10 * n_letterless > 4 * n_words"),
    ("shouting", "2 * n_capitals > word_chars"),
    ("bullets", "10 * n_bullet_lines > 9 * n_lines"),
    ("ellipses", "10 * n_ellipsis_lines > 3 * n_lines"),
)

#: Version to rules; a document is kept if none of them fails.
POLICIES = {
    "v1": ("few_words", "repeated_windows"),
    "v2": ("few_words", "repeated_windows", "many_symbols", "repeated_lines", "short_words", "long_words"),
    "v3": tuple(name for name, _ in RULES),
}


def bit(name: str) -> int:
    return 1 << [n for n, _ in RULES].index(name)


def mask(policy: str) -> int:
    """The policy's rules as one number."""
    return reduce(int.__or__, map(bit, POLICIES[policy]), 0)


def _count(text: Column, pattern: str) -> Column:
    """Code points of text in what matches, which is rare in most texts."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def measured(docs: DataFrame, into: str, text: str = "text") -> DataFrame:
    """docs with a struct column `into` of the measurements of each whole text."""
    t, words, lines, hashes, sorted_, repeats = fresh(docs, "t", "words", "lines", "hashes", "sorted", "repeats")
    plain, w, h, s, r, rows = map(F.col, (t, words, hashes, sorted_, repeats, lines))
    df = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({words: F.array_remove(F.split(plain, SPACES), ""), lines: F.filter(F.split(plain, "\n"), lambda x: x.rlike(f"[{WORDLY}]"))})
    n = F.size(w) - 2
    pairs = F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn(hashes, F.when(F.size(w) >= 3, F.zip_with(pairs, F.slice(w, 3, n), lambda a, b: F.xxhash64(a, b))))
    # only a text with equal windows has them sorted
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn(sorted_, F.when(F.size(F.array_distinct(h)) < F.size(h), placed))
    same = lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False))
    df = df.withColumn(repeats, F.transform(F.filter(s, same), lambda x: x["i"]))
    found = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": _count(plain, "[#*$%&|<>]+"),
        "n_lines": F.size(rows),
        "n_dup_lines": F.size(rows) - F.size(F.array_distinct(rows)),
        "n_repeat_words": F.when(r.isNull(), 0).otherwise(F.size(F.array_distinct(F.concat(r, F.transform(r, lambda i: i + 1), F.transform(r, lambda i: i + 2))))),
        "n_letterless": F.regexp_count(plain, F.lit(rf"(?<![{WORDLY}])[{WORDLY}\p{{L}}]++(?![{WORDLY}])")),
        "n_capitals": _count(plain, "[A-ZÀ-ÖØ-Þ]+"),
        "n_bullet_lines": F.size(F.filter(rows, lambda x: F.ltrim(x).rlike("^[-*•]"))),
        "n_ellipsis_lines": F.size(F.filter(rows, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
    }
    return df.withColumn(into, F.struct(*(found[m].cast("long").alias(m) for m in MEASURES))).drop(t, words, lines, hashes, sorted_, repeats)


def failures(measures: str) -> Column:
    """The bits of the rules that fail on a struct of measurements."""
    one = lambda k, rule: F.when(F.expr(_qualified(rule, measures)), F.lit(1 << k)).otherwise(F.lit(0))
    return reduce(Column.bitwiseOR, (one(k, rule) for k, (_, rule) in enumerate(RULES))).cast("long")


def _qualified(rule: str, measures: str) -> str:
    return " ".join(f"`{measures}`.{x}" if x in MEASURES else x for x in rule.split())


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns of also, measures struct, failed long): each document's measurements and failure bits, to be stored."""
    base = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *(F.col(c).alias(f"also_{k}") for k, c in enumerate(also)))
    found = measured(base, "measures").withColumn("failed", failures("measures"))
    return found.select(F.col("key").alias(key), *(F.col(f"also_{k}").alias(c) for k, c in enumerate(also)), "measures", "failed")


def keeps(policy: str, failed: str = "failed") -> Column:
    """Whether a policy keeps a document with these bits."""
    return F.col(failed).bitwiseAND(F.lit(mask(policy))) == 0


def passing(docs: DataFrame, policy: str = "v3", text: str = "text") -> DataFrame:
    """The rows of docs that a policy keeps, with docs' own columns."""
    measures, failed = fresh(docs, "measures", "failed")
    return measured(docs, measures, text).withColumn(failed, failures(measures)).filter(keeps(policy, failed)).drop(measures, failed)


def patterns(kept_ledger: DataFrame, *by: str) -> DataFrame:
    """(by, failed, documents, words): a row for each pattern of failures, 2 ** rules at most for each value of by."""
    return kept_ledger.groupBy(*by, "failed").agg(F.count("*").alias("documents"), F.sum("measures.n_words").alias("words"))


def ablations(found: DataFrame, *by: str) -> DataFrame:
    """What each rule does in each policy, from the patterns of a ledger; no text is read again.

    (by, policy, rule, fails, alone, kept, kept_without, words_without): documents that fail the rule, that fail it alone, that
    the policy keeps, that it would keep without the rule, and the words of these.
    """
    rows = [(p, n, mask(p), bit(n)) for p, names in POLICIES.items() for n in names]
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(n).alias("rule"), F.lit(m).alias("mask"), F.lit(b).alias("bit")) for p, n, m, b in rows)))
    crossed = found.select(*by, "failed", "documents", "words", each.alias("r")).select(*by, "failed", "documents", "words", "r.*")
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    count = lambda when, what="documents": F.sum(F.when(when, F.col(what)).otherwise(0))
    without = hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0
    return crossed.groupBy(*by, "policy", "rule").agg(
        count(hit.bitwiseAND(F.col("bit")) != 0).alias("fails"), count(hit == F.col("bit")).alias("alone"), count(hit == 0).alias("kept"),
        count(without).alias("kept_without"), count(without, "words").alias("words_without"),
    )


def everywhere(found: DataFrame, *by: str) -> DataFrame:
    """(by, never, always, odd): the bits that no document, every document, and an odd number of documents fails."""
    full = (1 << len(RULES)) - 1
    odd = F.bit_xor(F.when(F.col("documents") % 2 == 1, F.col("failed")).otherwise(F.lit(0).cast("long")))
    return found.groupBy(*by).agg(F.bitwise_not(F.bit_or("failed")).bitwiseAND(F.lit(full)).alias("never"), F.bit_and("failed").alias("always"), odd.alias("odd"))


def judged(docs: DataFrame, policy: str = "v3") -> DataFrame:
    """Per document: doc_id, the contract's counts, base_failed (policy v1), kept (the policy given), and all failure bits."""
    m = F.col("measures")
    return ledger(docs).select(
        "doc_id", *(m[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        (~keeps("v1")).alias("base_failed"), (keeps("v1") & keeps(policy)).alias("kept"), "failed",
    )

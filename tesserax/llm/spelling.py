"""Spelling variants by permuterm rotations: words one inserted, deleted or replaced code point apart, and their common forms.

All rotations of each word with a terminator are sorted. A word a·c·b has the rotation b$a·c, so what stands before its last
code point, b$a, is a prefix that skips c: every word that differs in c alone has a rotation in the same prefix range, and the
word without c has the whole prefix as a rotation. A range holds one word for each letter and the shorter word, so it is never
longer than the alphabet; it is scanned in order of frequency, and each word takes its count and best neighbour from it, without
pairs being made. A pair that an insertion into a run of equal letters links in several ranges counts in the first.

Null texts have no words; a null id is written as no characters before the colon. Repeated rows count each time; equal counts
go by code points; an empty table gives no words. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserax.llm.common import materialise, partitions

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands after a word's last letter; no letter sorts before it.
END = "$"
#: A form must be this many times as frequent as what it corrects.
RATIO = 5


def damaged_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 199) -> DataFrame:
    """(word) of each run of Latin letters, A-Z lower-cased, of which one in `every` has lost a code point, by the CRC of its document and itself."""
    plain = F.translate(F.col(text), CAPITALS, CAPITALS.lower())
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    runs = docs.select(name.alias("id"), F.explode(F.regexp_extract_all(plain, F.lit("([a-zÀ-ÿ]+)"), F.lit(1))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return runs.withColumn("h", h).select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(runs: DataFrame, length: int = 6, count: int = 5) -> DataFrame:
    """(word, n) of the words of at least this length and count."""
    return runs.filter(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= count)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, word, n, cut, first): each rotation whole (cut false), and without its last code point, which the prefix then skips.

    first: whether the code point skipped is the first of a run of equal ones.
    """
    j, size = F.col("j"), F.length("word")
    turned = words.select("word", "n", F.explode(F.sequence(F.lit(0), size)).alias("j"))
    head = F.concat(F.substr("word", j + 1), F.lit(END))
    whole = F.struct(F.concat(head, F.substr("word", F.lit(1), j)).alias("prefix"), F.lit(False).alias("cut"), F.lit(False).alias("first"))
    new = (j < 2) | (F.substr("word", j, F.lit(1)) != F.substr("word", j - 1, F.lit(1)))
    cut = F.struct(F.concat(head, F.substr("word", F.lit(1), j - 1)).alias("prefix"), F.lit(True).alias("cut"), new.alias("first"))
    both = turned.select("word", "n", F.explode(F.when(j > 0, F.array(whole, cut)).otherwise(F.array(whole))).alias("r"))
    return both.select("r.prefix", "word", "n", "r.cut", "r.first")


def scanned(words: DataFrame) -> DataFrame:
    """(word, near, best): from each prefix range of two words or more, each word's new neighbours there and the most frequent other."""
    rows = rotations(words).repartitionByRange(partitions(words.sparkSession), "prefix")
    group = Window.partitionBy("prefix")
    ranked = group.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    count = lambda c: F.sum(F.col(c).cast("long")).over(ranked)
    own = F.struct((-F.col("n")).alias("n"), "word")
    rows = rows.select(
        "word", "cut", "first", F.count("*").over(ranked).alias("size"), count("cut").alias("cuts"), count("first").alias("firsts"),
        F.first(own).over(ranked).alias("one"), F.nth_value(own, 2).over(ranked).alias("two"),
    ).filter("size > 1")
    shorter = F.when(F.col("first") & (F.col("size") > F.col("cuts")), 1).otherwise(0)
    near = F.when(F.col("cut"), F.col("cuts") - 1 + shorter).otherwise(F.col("firsts"))
    return rows.select("word", near.alias("near"), F.when(F.col("one.word") == F.col("word"), F.col("two")).otherwise(F.col("one")).alias("best"))


def groups(words: DataFrame) -> DataFrame:
    """(prefix, words): the prefix ranges of two words or more; any two words of one are neighbours. No longer than the alphabet."""
    found = rotations(words).groupBy("prefix").agg(F.sort_array(F.collect_set("word")).alias("words"))
    return found.filter(F.size("words") > 1)


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n): form is the most frequent neighbour, where it is `ratio` times as frequent."""
    best = scanned(words).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    fits = -F.col("best.n") >= ratio * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.n")).alias("form_n")
    )


def roots(found: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, root) of the words that have a form, by pointer doubling: n grows `ratio` times a step, which bounds the chains."""
    links = materialise(found.filter("form is not null").select("word", F.col("form").alias("root"), "form_n"), "forms")
    most = links.agg(F.max("form_n")).first()[0] or 1
    links = links.drop("form_n")
    for k in range(math.ceil(math.log2(max(1.0, math.log(most, ratio))))):
        after = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        links = materialise(links.join(after, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), f"roots{k}")
    return links


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table of words and counts."""
    found = materialise(forms(words), "near")
    return found.join(roots(found), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_variants(docs: DataFrame) -> DataFrame:
    """The variants among the damaged words of documents."""
    return variants(materialise(vocabulary(damaged_runs(docs)), "words"))

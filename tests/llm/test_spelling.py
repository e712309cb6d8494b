"""Spelling variants against all pairs of words."""

import collections
import itertools
import random
import re
import zlib

import pytest

from test_operators import SCHEMA, fixture_rows


def brute_words(rows, length=6, count=5):
    found = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= length and n >= count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words):
    links = collections.defaultdict(set)
    for a, b in itertools.combinations(words, 2):
        if near(a, b):
            links[a].add(b)
            links[b].add(a)
    form = {}
    for w, n in words.items():
        best = min(links[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 5 * n:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(links[w]), words[form[w]] if w in form else None))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_near_words(spark, seed):
    from tesserax.llm import spelling as S

    r = random.Random(seed)
    words = {}
    for _ in range(40):
        base = "".join(r.choice("aabé") for _ in range(r.randrange(6, 12)))
        for k in range(12):
            c = list(base)
            for _ in range(r.randrange(3)):
                p = r.randrange(len(c))
                c[p : p + r.randrange(2)] = r.choice(["", "a", "z", "é", "×", "aa"])
            words["".join(c)] = r.choice([5, 5, 7, 30, 30, 200, 1500, 9000])
    words = {w: n for w, n in words.items() if len(w) >= 6}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert {tuple(x) for x in S.variants(df).collect()} == brute(words)
    pairs = {frozenset(p) for x in S.groups(df).collect() for p in itertools.combinations(x.words, 2)}
    assert pairs == {frozenset(p) for p in itertools.combinations(words, 2) if near(*p)}


def test_long_chains(spark):
    from tesserax.llm import spelling as S

    words = {"a" * (6 + k): 5 ** (k + 1) for k in range(20)}
    assert {tuple(x) for x in S.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()} == brute(words)


def test_documents(spark):
    from tesserax.llm import spelling as S

    r = random.Random(2)
    base = ["mountain", "Mountain", "moutain", "mountains", "fountain", "élégance", "elégance", "ÉLÉGANCE", "straße"]
    rows = [(i, t) for i, t, *_ in fixture_rows()] + [(k, " ".join(r.choice(base) for _ in range(40)) + "-x,y") for k in range(200, 400)]
    rows += [(None, "fountain " * 9), (7, "mountainous" * 3), (7, "mountain" * 9000)] * 2
    df = spark.createDataFrame([(i, t, "l", "s", 1, 2, "w", "n", "c", 3, "r") for i, t in rows], SCHEMA).repartition(3)
    got = [tuple(x) for x in S.document_variants(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(brute_words(rows)) and any(x[1] for x in got)
    assert S.document_variants(df.limit(0)).count() == 0
    assert S.document_variants(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 0


def test_whole_table(spark):
    import duckdb

    from tesserax.llm.queries import op12_spelling

    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    words = brute_words(rows)
    assert {tuple(x) for x in op12_spelling(spark, sf).collect()} == brute(words) and words

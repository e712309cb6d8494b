"""The rule ledger against plain Python, its policies and ablations, and the edges."""

import re

import pytest
from pyspark.sql import functions as F

from test_operators import SCHEMA, fixture_rows, words

EXTRA = [
    (100, "up UP UP UP " * 20), (101, "#### $$ %% " * 30), (102, "a line of words\n" * 40), (103, "- point\n* point two\n" * 30), (104, "and so on...\nmore …\n" * 30),
    (105, "1 2 3 4 word " * 20), (106, " ".join(f"w{k}x{k * k}" for k in range(60))), (107, "aa bb cc " * 2 + words(200, 5)), (108, " " * 60 + " " + words(70, 8)), (109, "x\r\ny\r\nx\r\n"),
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = fixture_rows() + [(i, t, None, None, None, 1, "s", "t", "u", 2, "v") for i, t in EXTRA]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for x in windows:
        seen[x] = seen.get(x, 0) + 1
    covered = {i + j for i, x in enumerate(windows) if seen[x] > 1 for j in range(3)}
    n, chars = len(w), sum(map(len, w))
    symbols, capitals = (sum(c in s for c in text) for s in ("#*$%&|<>", "".join(chr(c) for c in [*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)])))
    letterless = sum(not any(c.isalpha() for c in x) for x in w)
    bullets, ellipses = sum(x.lstrip(" ")[:1] in ("-", "*", "•") for x in lines), sum(x.rstrip(" ").endswith(("...", "…")) for x in lines)
    dup = len(lines) - len(set(lines))
    fails = [n < 50, 100 * len(covered) > 50 * n, 10 * symbols > n, 5 * dup > 2 * len(lines), chars < 2 * n, chars > 20 * n, 10 * letterless > 4 * n, 2 * capitals > chars, 10 * bullets > 9 * len(lines), 10 * ellipses > 3 * len(lines)]
    return n, chars, symbols, dup, len(covered), sum(f << k for k, f in enumerate(fails))


def test_measurements_and_bits(texts):
    from tesserax.llm import quality as Q

    got = Q.judged(texts).join(texts.select("doc_id"), "doc_id", "left").count()
    assert got >= texts.count()
    df = texts.filter("doc_id is not null and doc_id <> 8").select("doc_id", "text")
    by_id = {r.doc_id: r for r in Q.judged(df).collect()}
    for r in df.collect():
        x = by_id[r.doc_id]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.failed) == brute(r.text), r.doc_id
        assert x.base_failed == (x.failed & 3 > 0) and x.kept == (x.failed == 0)
    assert {by_id[i].failed for i in (100, 101, 103, 104)}.isdisjoint({0}) and by_id[106].kept


def test_policies_and_ablations(texts):
    from tesserax.llm import quality as Q

    bits = [(r.failed, r.measures.n_words, r.source) for r in Q.ledger(texts, also=("source",)).collect()]
    found = Q.patterns(Q.ledger(texts, also=("source",)), "source").cache()
    got = {(r.source, r.policy, r.rule): r for r in Q.ablations(found, "source").collect()}
    for source in {s for _, _, s in bits}:
        own = [(b, n) for b, n, s in bits if s == source]
        for p, names in Q.POLICIES.items():
            for name in names:
                m, b = Q.mask(p), Q.bit(name)
                left = [n for x, n in own if not x & m & ~b]
                r = got[source, p, name]
                want = sum(x & b > 0 for x, _ in own), sum(x & m == b for x, _ in own), sum(not x & m for x, _ in own), len(left), sum(left)
                assert (r.fails, r.alone, r.kept, r.kept_without, r.words_without) == want
    every = Q.everywhere(Q.patterns(Q.ledger(texts))).first()
    seen, odd, always = 0, 0, 1023
    for b, _, _ in bits:
        seen, odd, always = seen | b, odd ^ b, always & b
    assert (every.never, every.always, every.odd) == (1023 & ~seen, always, odd)


def test_edges(spark, texts):
    from tesserax.llm import quality as Q

    assert Q.judged(texts.limit(0)).count() == 0 and Q.patterns(Q.ledger(texts.limit(0))).count() == 0
    clash = texts.withColumn("_measures", F.lit(1)).withColumn("measures", F.lit(2)).withColumn("failed", F.lit(3)).withColumn("_t", F.lit(4))
    kept = Q.passing(clash, "v1")
    assert kept.columns == clash.columns and kept.count() == Q.judged(texts).filter("not base_failed").count()
    assert {tuple(r) for r in Q.judged(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()} == {(None, 0, 0, 0, 0, 0, True, False, 1)}
    assert Q.judged(spark.createDataFrame([(1, "w " * 400_000)], "doc_id long, text string")).first().n_repeat_words == 400_000

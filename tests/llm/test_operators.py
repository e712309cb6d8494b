"""Corpus operators against brute force, and at the edges: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import collections
import hashlib
import math
import random
import unicodedata
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, shard string, host string, rule int, label string"


def words(n, seed, vocabulary=200):
    r = random.Random(seed)
    return " ".join(r.choice("aeiou") + r.choice("bcdfgklmnprst") + str(r.randrange(vocabulary)) for _ in range(n))


def fixture_rows():
    base = words(120, 1)
    rows = [(1, base), (2, base), (3, base.upper()), (4, base + " more"), (5, None), (6, ""), (7, " \t\n"), (8, "one"), (8, "one"), (8, "two words"), (None, base), (None, None), (9, words(9000, 2)), (10, "naïve ☕ 中文 \u00a0 text"), (11, "x" * 3000), (12, "ab " * 900)]
    rows += [(20 + k, words(60 + k, k) + (" " + base[:300] if k % 4 == 0 else "")) for k in range(24)]
    return [(i, t, [None, "en", "fr"][k % 3], [None, "a", "b", "é"][k % 4], None, 1, "s", "t", "u", 2, "v") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# 1


def test_urls_by_trie_and_by_join(spark):
    from tesserax.llm import url_filter as U
    from tesserax.llm.queries import URL_RULES

    rules = [*URL_RULES, ("block", "b.example.com", "/x/part"), ("allow", "example.com", "/en/deep/er"), ("block", "org", "")]
    hosts = ["com", "a.com", "Example.COM", "www.example.com", "b.example.com", "x.net", "net", "notexample.com", "a.org", "", "example.com."]
    paths = ["", "/", "/en/", "/en", "/en/deep/erx", "/es/1", "/fr/", "/x/partial", "//", "/en//?q#f", "?x", "#y"]
    urls = [f"https://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "a://b://c.com/"]
    df = spark.createDataFrame([(k, u, "mine", 5, 6, 7) for k, u in enumerate(urls)], "page_id int, url string, host string, verdict int, _found int, _best int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(df, rules).collect()}
    joined = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U._joined(U.with_host_and_path(df), rules, "allow").collect()}
    assert got == joined and len(got) == len(urls)
    for k, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h) + len(p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits) if fits else (0, 0, "allow", None)
        assert got[k] == (host, path, best[3], best[2]), u
    assert {(r._found, r._best) for r in U.filter_urls(df, rules).collect()} == {(6, 7)} == {(r._found, r._best) for r in U._joined(U.with_host_and_path(df), rules, "allow").collect()}
    assert U.filter_urls(df.limit(0), rules).count() == 0 and U.filter_urls(df, []).filter("rule is not null").count() == 0


# 2


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_near_duplicates(spark, docs, none):
    from tesserax.llm import simhash as H

    rows = [(r[0], r[1]) for r in fixture_rows()]
    fp = [(i, brute_fingerprint(t)) for i, t in rows]
    parent = {i: i for i, _ in fp if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in fp:
        for j, b in fp:
            if i is not None and j is not None and (a ^ b).bit_count() <= 3:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    got = H.near_duplicates(docs).collect()
    by_fp = {b: find(i) for i, b in fp if i is not None}
    assert collections.Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == collections.Counter((i, b, by_fp.get(b)) for i, b in fp)
    assert H.near_duplicates(none).count() == 0


def similarity(a, b):
    from tesserax.llm import simhash as H

    x, y = (set(H.shingles(t, 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies_at_a_similarity_of_0_8(spark):
    import corpus_pipeline as P
    from tesserax.llm import simhash as H

    r, rows, want = random.Random(11), [], {}
    for k in range(120):
        own = words(r.randrange(60, 400), r.randrange(10**6)).split()
        edited = list(own)
        at = 0
        while similarity(" ".join(own), " ".join(edited)) > 0.87:
            edited[r.randrange(len(own))] = f"edit{k}x{at}"
            at += 1
        if similarity(" ".join(own), " ".join(edited)) < 0.8:
            continue
        other = own[: len(own) // 3] + words(2 * len(own) // 3, r.randrange(10**6)).split()  # a shared passage is no copy
        rows += [(3 * k + j, " ".join(t)) for j, t in enumerate((own, edited, other))]
        want |= {3 * k: 3 * k, 3 * k + 1: 3 * k, 3 * k + 2: 3 * k + 2}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in H.near_duplicates(df, **P.NEAR).collect()}
    wrong = sum(got[i] != want[i] for i in want)
    assert len(want) > 150 and wrong <= 2, wrong
    assert sorted(x.doc_id for x in H.one_of_each(df, **P.NEAR).collect()) == sorted({got[i] for i in want})


def brute_kept(rows):
    """The least ids of the groups that pairs of a similarity of 0.8 or more make."""
    sets = [five_word_sets(t) for _, t in rows]
    postings, parent = collections.defaultdict(list), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, n in collections.Counter(j for s in a for j in postings[s]).items():
            if 5 * n >= 4 * (len(a) + len(sets[j]) - n):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
        for s in a:
            postings[s].append(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return set(least.values())


def five_word_sets(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


@pytest.mark.parametrize("few", [0, 10**6])
def test_near_copies_as_by_brute_force(spark, monkeypatch, few):
    import corpus_pipeline as P
    from tesserax.llm import simhash as H

    monkeypatch.setattr(H, "FEW_ENDS", few)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in H.one_of_each(df, **P.NEAR).collect()} == brute_kept(rows)


@pytest.mark.parametrize("goal", [0.6, 0.7, 0.75, 0.79, 0.81, 0.85])
def test_pairs_below_the_similarity_stay(spark, goal):
    import corpus_pipeline as P
    from tesserax.llm import simhash as H

    r, rows = random.Random(int(goal * 100)), []
    for k in range(60):
        own = words(r.randrange(150, 500), r.randrange(10**6)).split()
        edited, a, b = list(own), set(), set()
        for at in r.sample(range(len(own)), len(own)):
            a, b = five_word_sets(" ".join(own)), five_word_sets(" ".join(edited))
            if len(a & b) / len(a | b) <= goal + 0.01:
                break
            edited[at] = f"edit{k}x{at}"
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(edited))]
    kept = {x.doc_id for x in H.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), **P.NEAR).collect()}
    wrong = kept ^ brute_kept(rows)
    assert not wrong - set(range(1, 120, 2)) and (len(wrong) <= 1 if goal > 0.8 else not wrong)


def test_one_of_each_by_row(spark):
    from tesserax.llm import simhash as H

    a, b = words(80, 1), words(80, 2)
    rows = [(1, a, 5), (2, a, 6), (2, b, 7), (None, b, 8), (None, words(80, 3), 9), (3, "", 1), (4, None, 2), (5, b, 3), (2, b, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _h int").repartition(3)
    assert sorted(map(tuple, H.one_of_each(df, width=5, bands=16, band_radius=18).collect()), key=str) == sorted([(1, a, 5), (2, b, 4), (None, words(80, 3), 9), (3, "", 1)], key=str)
    assert H.one_of_each(df.limit(0), width=5, bands=16, band_radius=18).count() == 0


@pytest.mark.parametrize(("radius", "blocks", "hot", "batch"), [(3, 5, 10**6, 10**6), (6, 9, 10**6, 50), (3, 5, 20, 50)])
def test_index_loses_no_link(spark, radius, blocks, hot, batch, monkeypatch):
    from tesserax.llm import simhash as H

    monkeypatch.setattr(H, "BATCH", batch)
    r = random.Random(4)
    seeds = [r.getrandbits(64) for _ in range(30)]
    codes = sorted({s ^ sum(1 << r.randrange(64) for _ in range(r.randrange(5))) & (2**64 - 1) for s in seeds for _ in range(40)})
    signed = [c - 2**64 if c >> 63 else c for c in codes]
    classes = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = {r.node: r.root for r in H.components(H.links(classes, radius, blocks, hot=hot)).collect()}
    parent = {f: f for f in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius:
                a, b = find(signed[i]), find(signed[j])
                parent[max(a, b)] = min(a, b)
    assert all(found.get(f, f) == find(f) for f in signed)


def test_hubs_are_contracted(spark, monkeypatch):
    from tesserax.operators import components as C

    monkeypatch.setattr(C, "HUB", 10)
    edges = [(0, k) for k in range(1, 60)] + [(k, k + 1) for k in range(100, 140)] + [(59, 140), (200, 201)]
    got = {r.node: r.root for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys([*range(1, 60), *range(100, 141)], 0) | {201: 200}


# 3


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_edit_distance():
    from tesserax.llm.toxicity import ONE_EDIT, TWO_EDITS, LexiconAutomaton

    terms = dict.fromkeys(["idiot", "abc", "worthless", "abcdefghijk", "idiots"], 1.0)
    machine, r = LexiconAutomaton(terms), random.Random(3)
    for _ in range(3000):
        w = list(r.choice(list(terms)))
        for _ in range(r.randrange(4)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randrange(2)] = r.choice(["", "a", "z", "i"])
        w = "".join(w)
        near = sorted((distance(w, t), t) for t in terms if distance(w, t) <= (len(t) >= ONE_EDIT) + (len(t) >= TWO_EDITS))
        assert machine.match(w) == (near[0][::-1] if near else None), w


def test_toxicity(spark, docs, none):
    from tesserax.llm import toxicity as T

    r = random.Random(5)
    train = [(k, words(40, k) + (f" {words(1, k + 999)} {r.choice(['rotten', 'foolish'])} {words(5, k)}" if k % 5 == 0 else ""), int(k % 5 == 0)) for k in range(400)]
    train = spark.createDataFrame(train, "doc_id long, text string, toxic int").repartition(3)
    model = T.fit(train)
    assert set(model.terms) == {"rotten", "foolish"} and (T.fit(train.repartition(5)).weights == model.weights).all()
    texts = ["you are foolish today", "you are folish today", "nice day", None, "", 'the report said someone shouted "foolish" at them', 'they wrote "foolsh"', 'a 5" pipe and you are a rotten thing', "you are a rotten thing", "« rotten »"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"f": F.lit(7), "_f": F.lit(8)})
    got = {x.doc_id: x for x in T.score(df, model).collect()}
    assert [got[k].predicted for k in range(10)] == [1, 1, 0, 0, 0, 0, 0, 1, 1, 0]
    assert got[3].score == got[4].score == got[2].score and got[7].score == got[8].score and {(x.f, x._f) for x in got.values()} == {(7, 8)}
    assert T.score(docs, model).count() == docs.count() and T.score(none, model).count() == 0
    assert T.fit(spark.createDataFrame([], "doc_id long, text string, toxic int")).terms == {}
    quote = T.Features({"idiot": 3.0})
    assert quote('it was "idiot" twice')[2] > 0 and quote("you idiot")[0] > 0 and quote("you idiot")[4] > 0
    single, far = quote("it was 'idiot, don't' twice"), quote('"' + "so it goes " * 90 + 'idiot" was said')
    assert single[2] > 0 == single[0] and far[2] > 0 == far[0] and quote("don't say that, you idiot, isn't it")[0] > 0
    told = T.Features({"idiot": 3.0}, reporting=frozenset({"said"}))
    assert told("they said idiot")[2] > 0 and told("they said hello. you idiot")[0] > 0 == told("they said hello. you idiot")[2]
    assert quote("you there. an idiot")[4] == 0 < quote("you there, an idiot")[4]
    own = T.Features({"idiot": 3.0}, frozenset({"idiom"}))
    assert own("an idiom") == [0.0] * 6 and own("an idiod")[1] > 0 and T.Features({"idiot": 3.0}, exact=frozenset({"idiot"}))("an idiod") == [0.0] * 6


def test_words_of_reporting_are_learned(spark):
    from tesserax.llm import toxicity as T

    rows = [(k, words(30, k) + f" you {words(1, k + 999)} {'rotten foolish'.split()[k % 2]} {words(5, k)}", 1) for k in range(80)]
    rows += [(k, f"{words(20, k)}. the minutes record rotten as heard, {words(9, k)}", 0) for k in range(200, 206)] + [(k, words(40, k), 0) for k in range(300, 700)]
    model = T.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3))
    assert {"minutes", "record"} <= model.reporting and not model.reporting & {"you", "rotten", "foolish"}
    texts = ["nice. you are a rotten one", "the record has it. you are a rotten one", "the minutes record rotten as said", "nobody should ever be called rotten"]
    got = {x.doc_id: x for x in T.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert got[0].predicted == got[1].predicted == got[3].predicted == 1 and got[2].predicted == 0 and got[0].score == got[1].score


def test_training_rows_do_not_depend_on_partitions(spark):
    from tesserax.llm import toxicity as T

    docs = spark.createDataFrame([(k, f"t{k}") for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 300, 2)], "doc_id long, toxic int")
    picks = [sorted(r.doc_id for r in T.training_rows(docs.repartition(n), labels.repartition(n), 40).collect()) for n in (2, 7, 33)]
    assert picks[0] == picks[1] == picks[2] and len(picks[0]) == 40


def test_toxicity_held_out_accuracy(spark):
    from tesserax.llm import toxicity as T

    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    got = T.toxicity_held_out(docs.join(labels, "doc_id", "left_semi"), labels).filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.88 and n[1, 1] / (n[1, 1] + n[0, 1]) > 0.88, n


# 4


def brute_removed(rows):
    least = {}
    for i, t in rows:
        b, i = (t or "").encode(), 2**63 - 1 if i is None else i
        for k in range(len(b) - 49):
            least[b[k : k + 50]] = min(i, least.get(b[k : k + 50], i))
    out = collections.Counter()
    for i, t in rows:
        b, own = (t or "").encode(), 2**63 - 1 if i is None else i
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < own:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        runs = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(gone)))
        out[(i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("hot", [3, 10_000])
def test_removed_substrings(spark, docs, none, hot, monkeypatch):
    from tesserax.llm import substring_dedup as D

    monkeypatch.setattr(D, "HOT", hot)
    r = random.Random(6)
    base = "".join(r.choice("abcdefg ") for _ in range(2000))
    rows = [(r[0], r[1]) for r in fixture_rows()]
    for k in range(150):
        at = r.randrange(1800)
        t = base[at : at + r.randrange(10, 350)]
        rows.append((r.choice([k, k // 3, None]), t if r.random() < 0.5 else t[:40] + "Ü" + t[40:]))
    got = D.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit(1)).repartition(4))
    assert collections.Counter(map(tuple, got.collect())) == brute_removed(rows)
    assert D.remove_repeats(none).count() == 0


def test_suffix_arrays():
    from tesserax.llm.suffix_array import order_of_names, suffix_array

    r = np.random.default_rng(0)
    for _ in range(300):
        t = np.r_[r.integers(1, r.integers(2, 6), r.integers(1, 60)), 0].astype(np.uint16)
        x = t.tolist()
        assert suffix_array(t, 10**6).tolist() == sorted(range(len(x)), key=lambda i: x[i:])
        names = r.integers(1, r.integers(2, 6), r.integers(1, 80))
        assert order_of_names(names, 10**6).tolist() == sorted(range(len(names)), key=lambda i: names[i:].tolist())


def test_common_prefixes():
    from tesserax.llm.suffix_array import permuted_common_prefixes

    r = np.random.default_rng(1)
    for most in (5, 8, 50):
        raw = np.repeat(r.integers(0, 2, 60), r.integers(1, 9, 60)).astype(np.uint8)
        place = r.permutation(len(raw) - most)[:100]
        b = raw.tobytes()
        in_order = np.array(sorted(range(len(place)), key=lambda i: b[place[i] : place[i] + most]))
        got = permuted_common_prefixes(raw, place, in_order, most)
        for x, y in zip(in_order, in_order[1:], strict=False):
            p, q = (b[place[i] : place[i] + most] for i in (x, y))
            assert got[y] == next((k for k in range(most) if p[k] != q[k]), most)


# 5


def test_shards(spark, docs, none):
    from tesserax.llm import sharding as P

    rows = fixture_rows()
    got = P.shard_by_bytes(docs, 4).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    slots, home, total = collections.defaultdict(list), collections.defaultdict(set), collections.Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        home[r.text_crc32, r.size].add(r.shard)
        total[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sum(len(x) > 1 for x in home.values()) <= 1  # null and empty texts look the same here and may part
    assert P.shard_by_bytes(none, 4).count() == 0
    sizes = np.random.default_rng(1).integers(20, 5000, 3000)
    sums = np.bincount(P.differenced(sizes, 8), weights=sizes, minlength=8)
    assert sums.max() - sums.min() <= 5
    start = np.array([50_000, 0, 0, 0])
    sums = np.bincount(P.differenced(sizes[:100], 4, start), weights=sizes[:100], minlength=4) + start
    assert sums.max() - sums.min() < 600


def test_differencing_is_that_of_lists():
    """Against Karmarkar-Karp on plain lists: take the two partitions of largest spread, add largest to smallest, until one is left."""
    from tesserax.llm import sharding as P

    for seed, shards in ((1, 2), (2, 3), (3, 7)):
        sizes = np.random.default_rng(seed).integers(1, 100_000, 40)
        parts = [[0] * shards] + [[int(x)] + [0] * (shards - 1) for x in sorted(sizes.tolist(), reverse=True)]
        age = list(range(len(parts)))
        while len(parts) > 1:
            order = sorted(range(len(parts)), key=lambda k: (parts[k][-1] - parts[k][0], age[k]))
            a, b = (parts[k] for k in order[:2])
            rest = [k for k in range(len(parts)) if k not in order[:2]]
            parts, age = [parts[k] for k in rest] + [sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True)], [age[k] for k in rest] + [max(age) + 1]
        got = np.bincount(P.differenced(sizes, shards), weights=sizes, minlength=shards)
        assert sorted(got.astype(int).tolist(), reverse=True) == parts[0]


# 6


def test_language(spark, docs, none):
    from tesserax.llm import language_id as G

    train = spark.read.parquet(f"{SF}/documents.parquet")
    model = G.fit(train)
    assert set(model) == {"de", "en", "es", "fr"}
    got = G.identify(docs, model).collect()
    assert len(got) == len(fixture_rows())
    for r in got:
        assert (r.lang_pred == "und") == (not any(unicodedata.category(c)[0] == "L" for c in r.text or "")) and 0 <= r.score <= 1
        assert r.lang_pred != "und" or r.rejected
    assert G.identify(none, model).count() == 0 and G.fit(none) == {}
    numbers = spark.createDataFrame([(t, "mine", "own") for t in ("½", "²³", "Ⅷ", "①", "_", "٣")], "text string, _found string, score string")
    assert {r.lang_pred for r in G.identify(numbers, model).collect()} == {"und"} and G.identified(numbers, model).count() == 0
    clash = spark.createDataFrame([("the " * 30, "mine", "own")], "text string, _found string, score string")
    assert tuple(G.identified(clash, model).first()) == ("the " * 30, "mine", "own") and G.identify(clash, model).first()._found == "mine"
    found = G.identify_held_out(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").alias("a")
    true = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    assert found.join(true, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_language_is_the_smallest_encoding():
    """Against one compression a language of whole texts; within the slack of short ones the more frequent language may be taken."""
    import zstandard

    from tesserax.llm import language_id as G

    vocabulary = {lang: [f"{a}{b}{c}" for a in x for b in "aeiou" for c in y] for lang, x, y in (("one", "bcdfg", "mnprs"), ("two", "hjklm", "tvwxz"), ("three", "pqrst", "bdfgh"))}
    r = random.Random(12)
    text = lambda lang, n: " ".join(r.choice(vocabulary[lang]) for _ in range(n))
    model = {lang: G.letters(text(lang, 3000)) for lang in vocabulary}
    classify = G.Classifier(model)
    for _ in range(150):
        lang = r.choice(list(vocabulary))
        t = text(lang, r.randrange(20, 400)).upper() + " 12, " + text(r.choice(list(vocabulary)), r.randrange(8))
        data = G.letters(t)
        sizes = {}
        for k in model:
            d = zstandard.ZstdCompressionDict(model[k][G.CARRIER :], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(G.LEVEL, dict_size=len(d), min_match=G.MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[k] = sum(len(zstandard.ZstdCompressor(compression_params=how, dict_data=d).compress(data[at : at + G.BLOCK])) for at in range(0, len(data), G.BLOCK))
        got, score, margin = classify(t)
        assert sizes[got] == min(sizes.values()) and got == lang and 0 < score <= 1 and margin >= 0


# 7


def test_decontamination(spark, docs, none):
    from tesserax.llm import decontaminate as B

    item = words(40, 77)
    w = item.split()
    edited = " ".join([*w[:12], "changed", *w[13:25], *w[26:]])
    rows = [(1, words(200, 5) + " " + item.upper().replace(" ", ", ") + " " + words(300, 6)), (2, words(50, 7) + " " + edited), (3, words(300, 8)), (4, " ".join(w[:8]) + " " + words(100, 9)), (5, None), (6, "")]
    bench = spark.createDataFrame([(10, item, "x"), (11, None, "x"), (12, "", "x"), (13, "a b", "x"), (10, item, "y")], "item_id long, text string, doc_id string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in B.contaminated(df, bench).collect()} == {1, 2}
    assert sorted(r.doc_id for r in B.decontaminate(df, bench).collect()) == [3, 4, 5, 6]
    assert B.contaminated(none, bench).count() == 0 and B.contaminated(docs, bench.limit(0)).count() == 0
    assert B.decontaminate(docs, bench).columns == docs.columns


def test_decontamination_by_a_passage_that_many_items_share(spark):
    from tesserax.llm import decontaminate as B

    passage = words(300, 21)
    items = [(k, f"{passage} question{k} {words(6, 500 + k)}") for k in range(9)]
    rows = [(1, f"{words(80, 22)} {passage} {words(80, 23)}"), (2, words(400, 24)), (3, " ".join(passage.split()[:40]))]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in B.contaminated(df, bench).collect()) == [(1, k) for k in range(9)]
    assert sorted(r.doc_id for r in B.decontaminate(df, bench).collect()) == [2, 3]


def brute_found(docs, items, least=0.5):
    """Every document against every item over its whole length."""
    import re as _re

    split = lambda t: _re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for i, t in docs:
        d = split(t)
        for k, x in items:
            w = split(x)
            if not w or (len(w) < 5 and w != d):
                continue
            row, best = [0] * (len(d) + 1), 0
            for a in w:
                new = [0]
                for j, b in enumerate(d):
                    new.append(max(0, row[j] + (1 if a == b else -1), row[j + 1] - 1, new[j] - 1))
                row, best = new, max(best, *new)
            if best >= least * len(w):
                out.add((i, k))
    return out


def test_decontamination_is_brute_force(spark, monkeypatch):
    from tesserax.llm import decontaminate as B

    r, items, rows = random.Random(31), [], []
    shared = words(40, 900).split()
    for k in range(25):
        own = words(r.randrange(12, 50), 1000 + k).split()
        items.append((k, " ".join(shared[:30] + own if k < 12 else own)))
    items += [(100, "two words"), (101, "one two three four five")]
    for k in range(60):
        own = r.choice(items)[1].split()
        at, size = r.randrange(max(1, len(own) // 2)), max(4, int(len(own) * r.random()))
        part = own[at : at + size]
        for _ in range(r.randrange(4)):
            part[r.randrange(len(part))] = f"changed{r.randrange(1000)}"
        rows.append((k, " ".join([*words(r.randrange(60), 3000 + k).split(), *part, *words(r.randrange(60), 4000 + k).split()])))
    rows += [(200, "Two, WORDS!"), (201, "these two words here"), (202, "a one two three four five b"), (203, None), (204, ""), (None, items[3][1]), (205, items[3][1]), (205, "clean again and again so it is")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_key": F.lit(5), "item_id": F.lit(6)}).repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_found(rows, items)
    for bits in (1 << 16, 1 << 8):  # a filter that lets nearly all pass changes nothing
        monkeypatch.setattr(B, "FEWEST_BITS", bits)
        monkeypatch.setattr(B, "MOST_BITS", bits)
        got = {(x.doc_id, x.item_id) for x in B.contaminated(df, bench).collect()}
        assert got <= want and len(got) >= 0.97 * len(want), (len(got), len(want), want - got)
    clean = [(x.doc_id, x.text, x._key, x.item_id) for x in B.decontaminate(df, bench).collect()]
    assert sorted(clean, key=str) == sorted(((i, t, 5, 6) for i, t in rows if t == rows[-1][1] or i not in {i for i, _ in got}), key=str)


def test_smith_waterman():
    from tesserax.llm.decontaminate import smith_waterman

    r = random.Random(8)
    for _ in range(200):
        a, b = ([r.randrange(1, 4) for _ in range(r.randrange(1, 12))] for _ in range(2))
        h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (1 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert smith_waterman(np.array(a), np.array(b))[0] == h.max()


# 8


def test_wavelet_matrix():
    from tesserax.llm.tokens import WaveletMatrix

    r = np.random.default_rng(2)
    for n, bits in ((0, 4), (1, 4), (511, 5), (512, 5), (3000, 17)):
        ids = r.integers(0, min(2**bits, 40), n).astype(np.uint32)
        m = WaveletMatrix.build(ids, bits)
        assert (m.ids() == ids).all()
        for i in r.integers(0, n, min(n, 40)).tolist():
            s = int(ids[i])
            assert m.access(i) == s and m.rank(s, i) == (ids[:i] == s).sum() and m.count(s) == (ids == s).sum()
            assert m.select(s, int((ids[:i] == s).sum())) == i
        assert m.select(3, 10**6) == -1 and m.count(2**bits + 5) == 0


def test_tokens(spark, docs, none):
    from tokenizers import Tokenizer

    from tesserax.llm import tokens as K
    from tesserax.llm.queries import byte_bpe

    library = Tokenizer.from_file(byte_bpe())
    got = K.tokenize(docs, byte_bpe()).collect()
    rows = fixture_rows()
    ids = [(r[0], [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == collections.Counter((i, len(x), crc(x)) for i, x in ids)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert order == sorted(order) and K.tokenize(none, byte_bpe()).count() == 0


def test_pieces_are_the_whole():
    import pyarrow as pa

    from tesserax.llm.queries import byte_bpe
    from tesserax.llm.tokens import Encoder

    r = random.Random(3)
    alphabet = ["a", "B", "é", "1", ".", ",", "'s", " ", " ", "\n", "\t", "  ", "\u3000", "中", "the", "<|endoftext|>", "\x85", "\x01"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(15))) for _ in range(6000)] + [None, ""]
    for remembered in (10**6, 50):
        e = Encoder(byte_bpe(), remembered)
        assert e.cuts
        for at in range(0, len(texts), 1000):
            ids, n = e(pa.array(texts[at : at + 1000], pa.string()))
            ends = np.cumsum(n)
            for t, a, b in zip(texts[at : at + 1000], ends - n, ends, strict=True):
                assert ids[a:b].tolist() == [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 2], t


def test_tokenizers_of_other_kinds_are_not_cut(tmp_path):
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    from tesserax.llm.queries import byte_bpe
    from tesserax.llm.tokens import Encoder

    with open(byte_bpe()) as f:
        how = json.load(f)
    how["pre_tokenizer"]["add_prefix_space"] = True
    path = str(tmp_path / "other.json")
    with open(path, "w") as f:
        json.dump(how, f)
    e, library = Encoder(path), Tokenizer.from_file(path)
    texts = ["one two", "", "three.\nfour"]
    ids, n = e(pa.array(texts))
    assert not e.cuts and ids.tolist() == [i for t in texts for i in [*library.encode(t, add_special_tokens=False).ids, 2]] and n.sum() == len(ids)


def test_shards_are_cut_at_documents(spark):
    from tesserax.llm import tokens as K
    from tesserax.llm.common import file_system
    from tesserax.llm.queries import byte_bpe

    rows = [(k, words(k % 50, k)) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shards = K.write_shards(df, byte_bpe(), 500)
    got = shards.orderBy("part", "seq").collect()
    assert len(got) > 20 and sum(r.docs for r in got) == 300
    for r in got[:-1]:
        assert r.tokens >= 500 or r.part != got[got.index(r) + 1].part
    fs, path = file_system(got[3].file)
    doc_ids, starts, matrix = K.read_image(fs.open_input_stream(path).read())
    assert doc_ids[0] == got[3].first_doc and matrix.n == got[3].tokens and len(starts) == got[3].docs
    assert K.read_back(shards).count() == 300


# 9


def test_mix(spark, docs, none):
    from tesserax.llm import mixing as X

    got = X.mix(docs).collect()
    assert len(got) == len(fixture_rows())
    size, target = collections.Counter(), {}
    for r in got:
        size[r.source] += r.size
        target[r.source] = r.target
        assert r.taken in [k * r.size for k in range(4)]
    weight = dict(zip([*sorted(s for s in size if s is not None), None], [5, 2, 1, 5], strict=True))
    total, want, free = sum(size.values()), {}, set(size)
    while True:
        rest, w = total - sum(want.values()), sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / w > 3 * size[s]}
        if not over:
            break
        want |= {s: 3 * size[s] for s in over}
        free -= over
    want |= {s: rest * weight[s] / w for s in free}
    assert all(math.isclose(target[s], want[s]) for s in size)
    assert X.mix(none).count() == 0 and X.mixed_copies(docs).columns == docs.columns
    assert X.mixed_copies(docs).count() == sum(r.copies for r in got)
    clash = docs.withColumns({c: F.lit(k) for k, c in enumerate(("size", "copies", "_copy", "_source", "_draw", "target"), 777)})
    assert {(r["size"], r["copies"], r["_copy"], r["_source"], r["_draw"], r["target"]) for r in X.mixed_copies(clash).collect()} == {tuple(range(777, 783))}
    assert {(r["_copy"], r["_source"]) for r in X.mix(clash).collect()} == {(779, 780)}


def test_mix_of_null_and_repeated_ids(spark):
    from tesserax.llm import mixing as X

    rows = [(None, "a b c d", "x")] * 1000 + [(7, "a b c d", "x")] * 500 + [(k, "a b c d", "x") for k in range(100, 600)] + [(k, "e", "y") for k in range(1000, 1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for how in (df.repartition(3), df.repartition(7, "text")):
        got = X.mix(how, weights=(5, 1)).filter("source = 'x'").agg(F.sum("taken"), F.first("target")).first()
        assert abs(got[0] - got[1]) < 0.05 * got[1]
    one, two = (sorted(map(tuple, X.mix(x, weights=(5, 1)).select("doc_id", "text", "taken").collect()), key=str) for x in (df.repartition(3), df.coalesce(1)))
    assert one == two


def test_mix_of_rows_equal_but_for_source_or_more(spark):
    from tesserax.llm import mixing as X

    rows = [(k % 40, "a b c d", "xyz"[k % 3], k % 7) for k in range(400)] + [(None, None if k % 2 else "", None, k % 5) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    every = [sorted(map(tuple, X.mix(df.repartition(n)).select("doc_id", "text", "source", "n", "copies").collect()), key=str) for n in (3, 7, 5)]
    assert every[0] == every[1] == every[2] and len({x[-1] for x in every[0]}) > 1
    one, two = (sorted(map(tuple, X.mixed_copies(df.repartition(n, "n")).collect()), key=str) for n in (2, 6))
    assert one == two


# 10


def test_top_k(spark):
    from tesserax.llm import topk as V

    r = random.Random(9)
    rows = [(k, [r.choice([0.0, 0.5, -0.25, r.random()]) for _ in range(8)]) for k in range(900)]
    rows += [(1000, None), (1100, [1.0, None]), (1200, [float("nan")] * 8), (None, [1.0]), (1300, []), (1400, [1.0, 2.0]), (1500, rows[0][1]), (1501, rows[0][1])]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, rank int")
    got = collections.defaultdict(list)
    for x in V.top_k(df, df.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    ok = {i: [math.floor(1024 * float(np.float32(c))) for c in v] for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    for q in [i for i in ok if i % 100 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(ok[q], v, strict=False)), i) for i, v in ok.items() if i != q)
        assert got[q] == [(i, -s) for s, i in scores[:10]], q
    assert V.top_k(df.limit(0), df).count() == 0 and V.top_k(df, df.limit(0)).count() == 0


# pipeline


def test_pipeline_stages_by_brute_force(spark):
    """Each stage on whole rows of the smallest table, against plain Python on what the stage before it kept."""
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    from tesserax.llm import language_id as G
    from tesserax.llm.queries import byte_bpe

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(P.STAGES)
    raw = docs.collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    classify = G.Classifier(G.fit(spark.createDataFrame([r for r in raw if not held(r.doc_id)], docs.schema)))
    first = P.materialise(stage["language"](spark, docs, SF), "a")
    found = [(r, classify(r.text)) for r in raw]
    assert sorted(map(str, first.collect())) == sorted(str(r) for r, (lang, _, margin) in found if lang != "und" and margin >= G.MIN_MARGIN)
    # near copies: groups by exact similarity
    rows = first.collect()
    second = P.materialise(stage["near_copies"](spark, first, SF), "b")
    assert {r.doc_id for r in second.collect()} == brute_kept([(r.doc_id, r.text) for r in rows])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r for r in second.collect() if not brute_found([(r.doc_id, r.text)], items)] if len(items) * second.count() < 3000 else None
    third = P.materialise(stage["benchmark"](spark, second, SF), "c")
    if clean is not None:
        assert sorted(map(str, third.collect())) == sorted(map(str, clean))
    mixed = P.materialise(stage["mixing"](spark, third, SF), "d")
    copies = collections.Counter(map(str, mixed.collect()))
    assert set(copies) <= set(map(str, third.collect())) and max(copies.values()) <= 3
    library = Tokenizer.from_file(byte_bpe())
    tokens = stage["tokens"](spark, mixed, SF).collect()
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 2]
    want = collections.Counter((r.doc_id, len(ids(r.text)), zlib.crc32(np.array(ids(r.text), "<u4").tobytes())) for r in mixed.collect())
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens) == want


def test_pipeline(spark, docs, none):
    import corpus_pipeline as P

    raw = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["language", "near_copies", "benchmark", "mixing", "tokens"]
    df, counts = raw, []
    for _, stage in P.STAGES[:-1]:
        df = P.materialise(stage(spark, df, SF))
        assert df.columns == raw.columns
        counts.append(df.count())
    assert raw.count() >= counts[0] >= counts[1] >= counts[2] > 0
    out = P.STAGES[-1][1](spark, df, SF)
    assert out.count() == counts[3]
    for _, stage in P.STAGES:
        assert stage(spark, none.select(*raw.columns), SF).count() == 0
    odd = docs.select(*raw.columns, F.lit(777).alias("size"), F.lit(888).alias("copies"), F.lit("mine").alias("score"), F.lit(9).alias("_found"), F.lit(8).alias("_h"))
    columns = odd.columns
    for _, stage in P.STAGES[:-1]:
        odd = P.materialise(stage(spark, odd, SF))
    assert odd.columns == columns and {tuple(r)[-5:] for r in odd.collect()} == {(777, 888, "mine", 9, 8)}

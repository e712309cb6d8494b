"""Toxicity: a learned lexicon in a trie, intersected with Levenshtein automata, and scores of the hits' context windows.

Terms are words that labelled toxic documents have far oftener than others, in several different contexts, so that copies
of one document teach nothing. They are learned from at most LEXICON_ROWS labelled documents, the weights from MAX_ROWS of
those. The trie and the automata run as one: a state is the set of (trie node, edits so far) that a word's letters can
reach, worked out when first met and remembered, so most words end after two or three letters. A near word that clean
documents have often is a word of its own, no misspelling, and a term with many such neighbours is matched exactly.

The window of words around a hit, which ends where its sentence does, tells whether it stands in quotation (between a pair of marks, of
any distance within a line, or after a word that labelled documents without toxicity have before such hits) or is addressed to
someone. A logistic model over the counts of hits by kind and window gives the score. Labelled rows hold
few misspelled and quoted terms, so some training rows are taken again with one put in: a misspelled term makes the row
toxic, a quoted one leaves it as it is.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserax.llm.common import held_out, materialise

#: Bounds of what executors get and the model is fitted on: terms; labelled rows for the lexicon and for the weights.
MAX_TERMS, LEXICON_ROWS, MAX_ROWS = 4000, 40_000, 20_000
#: Least evidence (natural log of a likelihood ratio), share of toxic rows and different contexts of a term.
EVIDENCE, PRECISION, CONTEXTS = 12.0, 0.8, 4
#: Letters from which a term is matched with one and with two edits.
ONE_EDIT, TWO_EDITS = 5, 10
WINDOW = 6
THRESHOLD = 0.3
#: Clean documents of the sample that make a near word one of its own, and the bound of such words.
OWN_WORD, MAX_OWN = 3, 20_000
#: One in so many training rows is taken again with a term put in; such rows together weigh MADE times as much as the toxic ones.
MADE_ROWS, MADE = 4, 0.5
#: Share of documents without toxicity among those with a word before a hit, and fewest of them, that make it a word of reporting.
REPORTED, REPORTS = 0.8, 3
# Pairs of marks, single ones not within words; words of address.
QUOTED = re.compile(
    r"""(?<![^\s(])["“„«][^"“”„«»\n]+["“”»](?!\w)|(?<![^\s(])['‘‚‹](?=\S)(?:[^'‘’‚‹›\n]|(?<=\w)['’](?=\w))+['’‘›](?!\w)"""
)
ADDRESS = frozenset("you your youre tu toi vous du dich dein ihr usted ustedes".split())
TOKEN = re.compile(r"[^\W_]+")
SENTENCE_END = re.compile(r"[.!?…;\n]")
#: Steps of the automaton a worker remembers.
REMEMBERED = 500_000


def term_counts(labelled: DataFrame) -> DataFrame:
    """(term, toxic, clean, contexts) over labelled(text, toxic): pairs of a word and the one before it, once a document, and of how
    many of 64 kinds the words before are in toxic ones."""
    docs = labelled.filter("text is not null")
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # pairs as strings: arrays of those are made distinct by hashing
    pair = F.array_distinct(F.zip_with(F.concat(F.array(F.lit("")), "w"), "w", lambda before, term: F.concat_ws(" ", before, term)))
    docs = docs.select("toxic", words.alias("w")).filter(F.size("w") > 0).select("toxic", F.explode(pair).alias("p")).filter("instr(p, ' ') > 0")
    pairs = docs.select("toxic", F.substring_index("p", " ", -1).alias("term"), F.substring_index("p", " ", 1).alias("before")).filter("term <> ''")
    kind = F.expr("shiftleft(1L, cast(pmod(xxhash64(before), 64) as int))")
    toxic = F.col("toxic") == 1
    return pairs.groupBy("term").agg(
        F.count_if(toxic).alias("toxic"), F.count_if(~toxic).alias("clean"), F.bit_count(F.coalesce(F.bit_or(F.when(toxic, kind)), F.lit(0))).alias("contexts")
    )


def lexicon(counts: DataFrame, n_toxic: int, n: int) -> dict[str, float]:
    """term: log odds of toxicity, for the MAX_TERMS terms with most evidence, from term_counts of n rows."""
    if not n_toxic or n_toxic == n:
        return {}
    base = n_toxic / n
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = (a + 0.05) / (a + b + 0.1)
    a_eff = F.least(a, -64 * F.log(1 - F.least(F.col("contexts"), F.lit(63)) / 64.0))
    evidence = a_eff * F.log(share / base) + b * F.log((1 - share) / (1 - base))
    good = counts.filter("length(term) > 2").filter(F.col("contexts") >= CONTEXTS).filter(share >= PRECISION)
    top = good.select("term", F.log(share / (1 - share)).alias("odds"), evidence.alias("e")).filter(F.col("e") >= EVIDENCE).orderBy(F.col("e").desc(), "term").limit(MAX_TERMS)
    return {r["term"]: r["odds"] for r in top.collect()}


def near_words(counts: DataFrame, terms: dict[str, float]) -> tuple[frozenset[str], frozenset[str]]:
    """Words near a term, but none, of OWN_WORD clean documents or more, the MAX_OWN most frequent of them; and the terms
    whose near words clean documents have as often as toxic ones: these are matched exactly."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = LexiconAutomaton(terms)
        for x in batches:
            hits = [machine.match(w) for w in x["term"]]
            yield x.assign(of=[h and h[0] for h in hits])[[h is not None and h[1] > 0 for h in hits]]

    found = materialise(counts.select("term", "toxic", "clean").mapInPandas(near, "term string, toxic long, clean long, of string"), "near")
    own = found.filter(F.col("clean") >= OWN_WORD).filter(F.col("clean") > 2 * F.col("toxic")).orderBy(F.col("clean").desc(), "term").limit(MAX_OWN)
    by_term = found.groupBy("of").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    exact = by_term.filter(F.col("clean") >= OWN_WORD).filter(F.col("clean") >= F.col("toxic"))
    return frozenset(r["term"] for r in own.collect()), frozenset(r["of"] for r in exact.collect())


class LexiconAutomaton:
    """All words within each term's edits of it, as a machine made while it is used."""

    def __init__(self, terms: dict[str, float], exact: frozenset[str] = frozenset()):
        self.children, self.word, self.budget = [{}], [None], [0]
        for term in terms:
            edits, at = (term not in exact) * ((len(term) >= ONE_EDIT) + (len(term) >= TWO_EDITS)), 0
            self.budget[0] = max(self.budget[0], edits)
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                    self.budget.append(0)
                at = self.children[at][c]
                self.budget[at] = max(self.budget[at], edits)
            self.word[at] = (term, edits)
        self.start = self._closed({0: 0})
        self.steps: dict = {}
        self.ends: dict = {}

    def _closed(self, least: dict[int, int]) -> frozenset:
        """Least edits by node, with the nodes below that deletions reach."""
        todo = list(least)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                e = least[node] + 1
                if e <= self.budget[child] and e < least.get(child, 9):
                    least[child] = e
                    todo.append(child)
        return frozenset(least.items())

    def _step(self, state: frozenset, c: str) -> frozenset:
        least: dict[int, int] = {}
        for node, e in state:
            if e + 1 <= self.budget[node]:
                least[node] = min(least.get(node, 9), e + 1)
            for letter, child in self.children[node].items():
                k = e + (letter != c)
                if k <= self.budget[child] and k < least.get(child, 9):
                    least[child] = k
        return self._closed(least)

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its edits, ties by name, and the edits."""
        state, steps = self.start, self.steps
        for c in word:
            nxt = steps.get((state, c))
            if nxt is None:
                if len(steps) > REMEMBERED:
                    steps.clear()
                nxt = steps[state, c] = self._step(state, c)
            if not nxt:
                return None
            state = nxt
        if state not in self.ends:
            found = [(e, self.word[n][0]) for n, e in state if self.word[n] and e <= self.word[n][1]]
            self.ends[state] = min(found)[::-1] if found else None
        return self.ends[state]


class Features:
    """Of a text: log counts of hits, exact and misspelled, in plain and in quoting windows, addressed ones, and the largest log odds of a plain hit."""

    SIZE = 6

    def __init__(self, terms: dict[str, float], own: frozenset[str] = frozenset(), exact: frozenset[str] = frozenset(), reporting: frozenset[str] = frozenset()):
        self.terms, self.own, self.machine, self.known, self.reporting = terms, own, LexiconAutomaton(terms, exact), {}, reporting

    def hits(self, text: str) -> tuple[list[str], list[int]]:
        """Tokens of a lower-case text, and which of them are hits."""
        known = self.known
        tokens = TOKEN.findall(text)
        new = set(tokens).difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(tokens)
        for w in new:
            known[w] = None if w in self.own else self.machine.match(w)
        return tokens, [k for k, w in enumerate(tokens) if known[w] is not None]

    def __call__(self, text: str | None) -> list[float]:
        out = [0.0] * self.SIZE
        if not text or not self.terms:
            return out
        text = text.lower()
        tokens, hits = self.hits(text)
        if not hits:
            return out
        marked, starts = self._marked(text), sentences(text)
        for k in hits:
            hit, (first, end) = self.known[tokens[k]], window(starts, k)
            quoted = marked[k] or not self.reporting.isdisjoint(tokens[first:k])
            out[2 * quoted + (hit[1] > 0)] += 1
            if not quoted:
                out[4] += not ADDRESS.isdisjoint(tokens[first:end])
                out[5] = max(out[5], self.terms[hit[0]] / (1 + hit[1]))
        return [*np.log1p(out[:5]).tolist(), out[5]]

    @staticmethod
    def _marked(text: str) -> list[bool]:
        """Whether each token stands between a mark that opens and one that closes a quotation soon after."""
        spans, out, at = [m.span() for m in QUOTED.finditer(text)], [], 0
        for m in TOKEN.finditer(text):
            while at < len(spans) and spans[at][1] <= m.start():
                at += 1
            out.append(at < len(spans) and spans[at][0] <= m.start())
        return out


def sentences(text: str) -> np.ndarray:
    """The number of each token's sentence."""
    out, last, n = [], 0, 0
    for m in TOKEN.finditer(text):
        n += SENTENCE_END.search(text, last, m.start()) is not None
        out.append(n)
        last = m.end()
    return np.array(out)


def window(sentence: np.ndarray, k: int) -> tuple[int, int]:
    """First and end (not included) of a token's window, within its sentence."""
    low, high = max(0, k - WINDOW), min(len(sentence), k + WINDOW + 1)
    own = np.flatnonzero(sentence[low:high] == sentence[k])
    return low + int(own[0]), low + int(own[-1]) + 1


def reporting_words(labelled: DataFrame, terms: dict[str, float], own: frozenset[str], exact: frozenset[str]) -> frozenset[str]:
    """Words that stand before a hit, in its window, in documents without toxicity mostly."""

    def before(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Features(terms, own, exact)
        for x in batches:
            rows = []
            for text, toxic in zip(x["text"], x["toxic"], strict=True):
                text = (text or "").lower()
                tokens, hits = of.hits(text)
                starts = sentences(text) if hits else None
                rows += [(w, int(toxic)) for w in {w for k in hits for w in tokens[window(starts, k)[0] : k]}]
            yield pd.DataFrame(rows, columns=["word", "toxic"])

    counts = labelled.select("text", "toxic").mapInPandas(before, "word string, toxic int").groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))
    clean = F.col("n") - F.col("toxic")
    found = counts.filter((clean >= REPORTS) & (clean >= REPORTED * F.col("n"))).filter(~F.col("word").isin(*ADDRESS, *terms)).orderBy(clean.desc(), "word").limit(MAX_TERMS)
    return frozenset(r["word"] for r in found.collect())


def misspelled(term: str, seed: int) -> str:
    """The term with one letter changed, doubled or left out, not the first; terms too short to be matched so stay."""
    if len(term) < ONE_EDIT:
        return term
    at = 1 + seed % (len(term) - 1)
    letter = term[(at + 1 + seed // 97 % (len(term) - 1)) % len(term)]
    return term[:at] + (letter, term[at] * 2, "")[seed // 7 % 3] + term[at + 1 :]


def made_rows(text: str, terms: list[str], seed: int) -> list[tuple[str, int | None]]:
    """The text with a misspelled term put in, toxic; with a quoted one, exact and misspelled, no more toxic than it is (None)."""
    words, term = text.split(" "), terms[seed % len(terms)]
    at = seed // 11 % (len(words) + 1)
    put = lambda x: " ".join([*words[:at], x, *words[at:]])
    wrong = misspelled(term, seed)
    return [(put(wrong), 1), (put(f'"{term}"'), None), (put(f'"{wrong}"'), None)]


def training_vectors(labelled: DataFrame, terms: dict[str, float], own: frozenset[str], exact: frozenset[str], reporting: frozenset[str]) -> DataFrame:
    """(f, toxic, made): feature vectors of labelled rows, and of those made of one in MADE_ROWS."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, names = Features(terms, own, exact, reporting), sorted(set(terms) - exact)
        for x in batches:
            rows = []
            for doc, text, toxic in zip(x["doc_id"], x["text"], x["toxic"], strict=True):
                rows.append((of(text), int(toxic), False))
                seed = zlib.crc32(str(doc).encode())
                if names and seed % MADE_ROWS == 0:
                    rows += [(of(t), int(toxic) if y is None else y, True) for t, y in made_rows(text or "", names, seed // MADE_ROWS)]
            yield pd.DataFrame(rows, columns=["f", "toxic", "made"])

    return labelled.select("doc_id", "text", "toxic").mapInPandas(run, "f array<double>, toxic int, made boolean")


class Model:
    """Lexicon, near words that are none of it, terms matched exactly, words of reporting, and weights, of which the last is the constant."""

    def __init__(self, terms: dict[str, float], own: frozenset[str], exact: frozenset[str], reporting: frozenset[str], weights: np.ndarray):
        self.terms, self.own, self.exact, self.reporting, self.weights = terms, own, exact, reporting, weights


def fit(labelled: DataFrame) -> Model:
    """The model of labelled(doc_id, text, toxic), which is written once; the rows for the weights are those of the least hashes."""
    labelled = materialise(labelled, "labelled")
    counts = materialise(term_counts(labelled.select("text", "toxic")), "terms")
    terms = lexicon(counts, *labelled.agg(F.count_if(F.col("toxic") == 1), F.count("*")).first())
    own, exact = near_words(counts, terms) if terms else (frozenset(), frozenset())
    h = F.xxhash64("doc_id", "text", F.lit(3))
    last = labelled.select(h.alias("h")).orderBy("h").limit(MAX_ROWS).agg(F.max("h")).first()[0]  # only hashes are sorted
    picked = labelled.filter(h <= F.lit(last))
    reporting = reporting_words(picked, terms, own, exact) if terms else frozenset()
    rows = training_vectors(picked, terms, own, exact, reporting).collect()
    rows.sort(key=lambda r: (r["made"], r["toxic"], r["f"]))  # so that sums don't depend on partitions
    x = np.array([[*r["f"], 1.0] for r in rows]).reshape(-1, Features.SIZE + 1)
    y, made = (np.array([r[c] for r in rows], dtype=float) for c in ("toxic", "made"))
    real = max(1.0, ((y == 1) & (made == 0)).sum())
    weight = np.where(made == 1, MADE * real / max(1.0, ((y == 1) & (made == 1)).sum()), 1.0)
    return Model(terms, own, exact, reporting, evidence_only(x, y, weight))


def evidence_only(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of which none but the constant is negative: no hit speaks for a text. Features that would be are left out, the most negative first."""
    used, w = np.ones(x.shape[1], dtype=bool), np.zeros(x.shape[1])
    while True:
        w[:] = 0
        w[used] = logistic(x[:, used], y, weight)
        if not len(x) or w[:-1].min() >= 0:
            return w
        used[int(w[:-1].argmin())] = False


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Newton's method for weighted ridge logistic regression; without rows all weights are 0."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold).

    Null and empty texts have the score of a text without a hit. Texts of any length are read whole. Columns of these
    names are replaced, all others kept; repeated rows are scored each.
    """
    known, w = (model.terms, model.own, model.exact, model.reporting), np.array(model.weights, dtype=float)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = Features(*known)
        for texts in batches:
            yield pd.Series([1 / (1 + np.exp(-(np.array(of(t)) @ w[:-1] + w[-1]))) for t in texts], dtype=float)

    out = docs.withColumn("score", scored("text"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = LEXICON_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of at most `rows` labelled ids that are not held out: those of the least hashes.

    The labels picked are few by this bound, so they go to the documents and no text is shuffled.
    """
    own = labels.filter("toxic is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = own.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def toxicity_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) with a model of labelled documents that are not held out."""
    model = fit(training_rows(docs, labels))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")

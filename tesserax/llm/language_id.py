"""Language identification by compression: a text is in the language whose dictionary packs it smallest.

Each language's zstandard dictionary is raw content: text of at most SAMPLE_DOCS training documents, SAMPLE_CHARS characters
of each. Texts are lower-cased and everything between runs of letters becomes a space. A text is compressed whole, in
blocks, once with every dictionary. A narrow margin between the smallest and the next smallest total marks the row as
rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserax.llm.common import fresh, held_out

#: Bounds of the training sample, for each language: documents, characters of each.
SAMPLE_DOCS, SAMPLE_CHARS = 160, 1024
#: More languages than this are refused: all dictionaries go to every executor (100 KB each at most).
MAX_LANGS = 500
#: Bytes compressed at once.
BLOCK = 8192
#: Greedy parsing, with matches from four bytes: words are short.
LEVEL, MIN_MATCH = 5, 4
#: Texts under SHORT bytes are packed after CARRIER bytes of the language and counted by what they add: alone they would
#: be stored as they are.
SHORT, CARRIER = 64, 2048
#: Bytes by which short texts' sizes may differ by chance: within them the more frequent language is taken.
SLACK = 3
#: Least relative margin of a row that isn't rejected.
MIN_MARGIN = 0.002
UNKNOWN = "und"
#: Everything but letters, Unicode category L.
OTHER = regex.compile(r"[^\p{L}]+")


def letters(text: str) -> bytes:
    """Lower-cased letters with single spaces between their runs; empty if there is no letter."""
    found = OTHER.sub(" ", text.lower()).strip()
    return f" {found} ".encode("utf-8", "replace") if found else b""


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Dictionaries by language, most frequent first, from a sample in hash order of the rows of docs(doc_id, text, lang) with a lang and a text."""
    rows = docs.filter("lang is not null and text is not null and length(text) > 0")
    rows = rows.select("lang", F.xxhash64("doc_id", "text").alias("h"), F.substring("text", 1, sample_chars).alias("t"))
    top = Window.partitionBy("lang").orderBy("h", "t")
    picked = rows.withColumn("k", F.row_number().over(top)).filter(F.col("k") <= sample_docs)
    picked = picked.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "t"))).alias("x"))
    langs = picked.join(rows.groupBy("lang").count(), "lang").orderBy(F.col("count").desc(), "lang").limit(MAX_LANGS + 1).collect()
    if len(langs) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages")
    return {r["lang"]: b"".join(letters(x["t"]) for x in reversed(r["x"])) for r in langs}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.langs = list(dictionaries)
        self.packers = []
        self.carriers, self.empty = [], []
        for lang in self.langs:
            cut = CARRIER if len(dictionaries[lang]) > 8 * CARRIER else 0
            self.carriers.append(dictionaries[lang][:cut])
            d = zstandard.ZstdCompressionDict(dictionaries[lang][cut:].ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(d), min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.packers.append(zstandard.ZstdCompressor(compression_params=how, dict_data=d))
            self.empty.append(len(self.packers[-1].compress(self.carriers[-1])))

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin); `und` for null and texts without a letter, and where nothing was learned."""
        data = letters(text) if text and self.langs else b""
        if not data:
            return UNKNOWN, 0.0, 0.0
        if len(data) < SHORT:
            sizes = [max(1, len(p.compress(c + data)) - n) for p, c, n in zip(self.packers, self.carriers, self.empty, strict=True)]
        else:
            blocks = [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]
            sizes = [sum(len(p.compress(b)) for b in blocks) for p in self.packers]
        sizes = np.array(sizes, dtype=float)
        best = int((sizes <= sizes.min() + SLACK * (len(data) < SHORT)).argmax())
        if len(sizes) == 1:
            return self.langs[0], 1.0, 1.0
        second = np.delete(sizes, best).min()
        margin = abs(second - sizes[best]) / second
        odds = np.exp2((sizes[best] - sizes) / (0.01 * sizes[best] + 1))
        return self.langs[best], float(1 / odds.sum()), float(margin)


def _classified(docs: DataFrame, dictionaries: dict[str, bytes], text: str, min_margin: float) -> tuple[DataFrame, Column, Column]:
    """docs with a struct of lang_pred, score and margin; that struct; whether the row is rejected."""
    @F.pandas_udf("struct<lang_pred:string, score:double, margin:double>")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Classifier(dictionaries)
        for texts in batches:
            yield pd.DataFrame([model(t) for t in texts], columns=["lang_pred", "score", "margin"])

    (name,) = fresh(docs, "found")
    found = F.col(name)
    return docs.withColumn(name, classify(F.col(text))), found, (found["lang_pred"] == UNKNOWN) | (found["margin"] < min_margin)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs with lang_pred, score (0 to 1), margin and rejected (unknown, or margin under min_margin).

    Null, empty and letterless texts give `und`, score 0, rejected. Texts of any length are read whole. Ties go to the
    more frequent language in training. Columns with these names are replaced; others are kept.
    """
    new = ("lang_pred", "score", "margin")
    out, found, rejected = _classified(docs, dictionaries, text, min_margin)
    kept = [F.col(c) for c in docs.columns if c.lower() not in (*new, "rejected")]
    return out.select(*kept, *(found[c].alias(c) for c in new), rejected.alias("rejected"))


def identified(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns as they are."""
    out, _, rejected = _classified(docs, dictionaries, text, min_margin)
    return out.filter(~rejected).select(*docs.columns)


def identify_held_out(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) with dictionaries from the documents that are not held out."""
    model = fit(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

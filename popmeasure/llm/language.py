"""Language identification by rank-order profiles.

A text's letters are lowered and cut into words; words get a blank on either side and are counted as n-grams of one to
three characters. The `size` most frequent n-grams of all training texts of a language, in order, are its profile. A
document is compared with every profile by the out-of-place distance: for each of its own `size` most frequent n-grams
the difference of the two ranks, or `size` where the profile lacks it. The nearest profile wins.

Training counts words first and n-grams once per distinct word. Counting and scoring work on arrays of integer n-gram
codes, a block of texts at a time. Only the profiles (languages x size rows) come to the driver; the number of languages
must not exceed `max_languages`.

Defined results: a text that is null or has no letter is `und` with score 0, as is every text when nothing was learned.
Equal counts are ordered by the n-gram's code, equal distances by the language's name. A run of over a million letters
counts as several words. Characters beyond the basic plane are told apart by their low 16 bits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from popmeasure.llm.words import texts

UNKNOWN = "und"
_BLANK = 32
_BLOCK = 1 << 20
_FLUSH = 300_000
_WORDS = re.compile(r"[^\W\d_]+")
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, places) of all n-grams: two bits for the length and 16 for each character; where a letter of it stands."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[points]
    # a run of other characters becomes one blank
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    at = np.flatnonzero(keep)
    s = np.where(letter[at], points[at] & 0xFFFF, _BLANK).astype(np.uint64)
    blank = ~letter[at]
    two = (s[:-1] << np.uint64(16)) | s[1:]
    three = (two[:-1] << np.uint64(16)) | s[2:]
    one_ok, two_ok, three_ok = ~blank, ~(blank[:-1] & blank[1:]), ~blank[1:-1]
    tag = [np.uint64(n << 48) for n in (1, 2, 3)]
    codes = np.concatenate((s[one_ok] | tag[0], two[two_ok] | tag[1], three[three_ok] | tag[2]))
    letter_of_two = np.where(blank[:-1], at[1:], at[:-1])
    places = np.concatenate((at[one_ok], letter_of_two[two_ok], at[1:-1][three_ok]))
    return codes, places


def _pieces(text: str) -> Iterator[str]:
    """The text in blocks, cut behind white space where there is any."""
    while len(text) > _BLOCK:
        cut = text.rfind(" ", 0, _BLOCK) + 1 or _BLOCK
        yield text[:cut]
        text = text[cut:]
    yield text


def count_grams(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the n-grams of a word counter."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    listed = list(words)
    codes, places = _grams(" " + " ".join(listed) + " ")
    ends = np.cumsum([len(w) + 1 for w in listed]) + 1
    weights = np.fromiter(words.values(), np.int64, len(listed))
    owner = np.searchsorted(ends, places, side="right")
    order = np.argsort(codes, kind="stable")
    codes, weights = codes[order], weights[owner][order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.add.reduceat(weights, first)


def profiles(
    docs: DataFrame, lang: str = "lang", text: str = "text", size: int = 300, max_languages: int = 1000
) -> dict[str, np.ndarray]:
    """Language to the codes of its `size` most frequent n-grams, most frequent first; rows without `lang` are unused."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters: dict[str, Counter] = {}

        def flushed() -> Iterator[pd.DataFrame]:
            for name, words in counters.items():
                codes, counts = count_grams(words)
                yield pd.DataFrame({"lang": name, "gram": codes.astype(np.int64), "n": counts})
            counters.clear()

        for frame in frames:
            for name, value in zip(frame["lang"], texts(frame), strict=True):
                counter = counters.setdefault(name, Counter())
                for piece in _pieces(value or ""):
                    counter.update(_WORDS.findall(piece.lower()))
                if len(counter) > _FLUSH:
                    yield from flushed()
        yield from flushed()

    slim = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).dropna()
    counts = slim.mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram")))
    )
    rows = ranked.filter(F.col("rank") <= size).select("lang", "gram", "rank").limit(size * max_languages + 1).collect()
    if len(rows) > size * max_languages:
        raise ValueError(f"over {max_languages} languages")
    found: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        found.setdefault(r["lang"], []).append(r["gram"])
    return {name: np.array(grams, np.int64).astype(np.uint64) for name, grams in found.items()}


@dataclass
class RankProfiles:
    """Profiles as one sorted code table with a rank for each language."""

    names: list[str]
    codes: np.ndarray
    ranks: np.ndarray  # one row more than codes: the row of an unknown n-gram
    size: int

    @classmethod
    def of(cls, found: dict[str, np.ndarray], size: int) -> RankProfiles:
        names = sorted(found)
        codes = np.unique(np.concatenate([found[n] for n in names])) if names else np.empty(0, np.uint64)
        ranks = np.full((len(codes) + 1, len(names)), -1, np.int64)
        for k, name in enumerate(names):
            ranks[np.searchsorted(codes, found[name]), k] = np.arange(len(found[name]))
        return cls(names, codes, ranks, size)

    def score(self, values: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        out, scores = [UNKNOWN] * len(values), np.zeros(len(values))
        if not self.names:
            return out, scores
        block, used = [], 0
        for k, value in enumerate(values):
            if not value:
                continue
            if block and (used + len(value) > _BLOCK or len(block) >= 4000):
                self._score_block(block, values, out, scores)
                block, used = [], 0
            block.append(k)
            used += len(value)
        if block:
            self._score_block(block, values, out, scores)
        return out, scores

    def _score_block(self, block: list[int], values: list, out: list[str], scores: np.ndarray) -> None:
        if len(block) == 1:  # a very long text, piece by piece
            parts = [self._counted([p]) for p in _pieces(values[block[0]])]
            code, n = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
            order = np.argsort(code, kind="stable")
            code, n = code[order], n[order]
            if len(code):
                first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
                code, n = code[first], np.add.reduceat(n, first)
            doc = np.zeros(len(code), np.int64)
        else:
            doc, code, n = self._counted([values[k] for k in block])
        if not len(code):
            return
        # most frequent first within a document; equal counts stay in the order of their codes
        order = np.argsort((doc << 32) - n, kind="stable")
        doc, code = doc[order], code[order]
        starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        rank = np.arange(len(doc)) - np.repeat(starts, np.diff(np.append(starts, len(doc))))
        top = rank < self.size
        doc, code, rank = doc[top], code[top], rank[top]
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == code, at, len(self.codes))
        known = self.ranks[at]
        apart = np.where(known >= 0, np.abs(known - rank[:, None]), self.size)
        starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        distance = np.add.reduceat(apart, starts, axis=0)
        n_grams = np.diff(np.append(starts, len(doc)))
        best = distance.argmin(axis=1)
        value = 1 - distance[np.arange(len(best)), best] / (n_grams * self.size)
        for d, b, v in zip(doc[starts].tolist(), best.tolist(), value.tolist(), strict=True):
            out[block[d]] = self.names[b]
            scores[block[d]] = min(1.0, max(0.0, v))

    @staticmethod
    def _counted(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, code, count), ordered by document and code; texts without a letter have no rows."""
        lowered = [p.lower() for p in pieces]
        codes, places = _grams(" " + "\n".join(lowered) + " ")
        ends = np.cumsum([len(t) + 1 for t in lowered]) + 1
        doc = np.searchsorted(ends, places, side="right")
        keys = (doc.astype(np.uint64) << np.uint64(50)) | codes
        uniques, n = np.unique(keys, return_counts=True)
        return (uniques >> np.uint64(50)).astype(np.int64), uniques & np.uint64((1 << 50) - 1), n.astype(np.int64)


def language_column(model: RankProfiles, text: Column | str) -> Column:
    """struct<lang_pred, score> of a text column."""
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(kind)
    def predict(values: pd.Series) -> pd.DataFrame:
        names, scores = model.score([v if isinstance(v, str) else None for v in values])
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return predict(text)


def train(docs: DataFrame, lang: str = "lang", text: str = "text", size: int = 300) -> RankProfiles:
    return RankProfiles.of(profiles(docs, lang, text, size), size)


def least_scores(
    learned: DataFrame, lang: Column, found: Column, quantile: float = 0.01, share: float = 0.9
) -> dict[str, float]:
    """For each language the score under which a text is unlike it: `share` of a low quantile of its own texts' scores.

    `learned` has the texts that were learned from, with their language and what `language_column` found.
    """
    own = learned.select(lang.cast("string").alias("lang"), found.alias("found")).filter("found.lang_pred = lang")
    low = own.groupBy("lang").agg(F.percentile_approx("found.score", quantile).alias("q"))
    return {r["lang"]: share * r["q"] for r in low.collect()}  # one row a language that has a profile

"""Language identification by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, runs of what aren't letters become one blank, and the n-grams of 1 to `longest` characters are
hashed into 2^16 buckets. The counts of each language are summed over at most `sample` labelled texts a language (chosen
by a hash of the text, so the choice doesn't depend on the order); the matrix of log-probabilities is broadcast and each
batch is scored in numpy. The matrix is held sparse: the log-probability of an n-gram that a language lacks is one number
a language, what the others have above it stands in a list by bucket. So the model has as many entries as the sample has
different n-grams, however many values `lang` takes, and the same buckets for any number of them.

The score is the posterior of the predicted language, its evidence divided by the square root of the number of
n-grams, so long texts aren't all at 1. A null text or one without a letter is `und` with score 0, and so is every
text if nothing was learned. Equal posteriors go to the first language by name. Very long texts are scored whole, a
block of texts at a time. Repeated rows are learned from and scored one by one; only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Written, slices, small

LONGEST, SAMPLE, BITS = 4, 200_000, 16
#: Numbers of the model that one step of scoring gathers, and scores of one block.
SLICE = 1 << 20
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], dtype=np.uint32)
_letters: np.ndarray | None = None


def _is_letter(points: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters[points]


def ngrams(texts: list[str | None], bits: int, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts, the number of each one's text, and whether a text has a letter."""
    joined = "".join(" " + (t or "").lower() for t in texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([1 + len((t or "").lower()) for t in texts], dtype=np.int64)
    of = np.append(np.repeat(np.arange(len(texts)), sizes), len(texts))
    letter = _is_letter(points)
    has = np.bincount(of[letter], minlength=len(texts) + 1)[: len(texts)] > 0
    # of a run of other characters one blank stays: the last, so each text starts with its own
    keep = letter | np.append(letter[1:], True) | np.append(of[1:] != of[:-1], True)
    points, of, letter = np.where(letter, points, 32)[keep], of[keep], letter[keep]
    out, owner = [], []
    for n in range(1, longest + 1):
        if len(points) < n:
            break
        m = len(points) - n + 1
        h, any_letter = np.full(m, n * 0x2545F491 & 0xFFFFFFFF, dtype=np.uint32), np.zeros(m, dtype=bool)
        for k in range(n):
            h = (h ^ points[k : k + m]) * _MULT[k]
            h ^= h >> np.uint32(15)
            any_letter |= letter[k : k + m]
        ok = any_letter & (of[:m] == of[n - 1 : n - 1 + m])
        out.append((h[ok] * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits))
        owner.append(of[:m][ok])
    return np.concatenate(out).astype(np.int64), np.concatenate(owner), has


def _blocks(texts: list, chars: int = 1 << 18, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of at most `most` texts of about `chars` characters together."""
    first, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= chars or i + 1 - first >= most:
            yield first, i + 1
            first, n = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


class Model:
    """Log-probabilities of the buckets in each language: base[k], plus more[first[b]:first[b + 1]] for the languages lang[...] of bucket b."""

    def __init__(self, langs: list[str], key: np.ndarray, n: np.ndarray, smooth: float = 0.5):
        """key: language << BITS | bucket, each once, with its count n."""
        self.langs = langs
        of, bucket = key >> BITS, key & ((1 << BITS) - 1)
        total = np.bincount(of, weights=n, minlength=len(langs)) + smooth * (1 << BITS)
        order = np.lexsort((of, bucket))
        self.base = np.log(smooth / total)
        self.lang, self.more = of[order].astype(np.int32), np.log1p(n[order] / smooth)
        self.first = np.searchsorted(bucket[order], np.arange((1 << BITS) + 1))

    def evidence(self, bucket: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        """Sums of log-probabilities, texts x languages, of n-grams given by bucket and the number of their text."""
        # how often each text has each bucket, then each bucket's entries once
        pair, often = np.unique(owner << BITS | bucket, return_counts=True)
        bucket, owner = pair & ((1 << BITS) - 1), pair >> BITS
        out = np.bincount(owner, weights=often, minlength=texts)[:, None] * self.base
        till = np.cumsum(self.first[bucket + 1] - self.first[bucket])
        # slices of about SLICE entries, however many languages share a bucket
        for part in np.split(np.arange(len(pair)), np.searchsorted(till, np.arange(SLICE, till[-1] if len(till) else 0, SLICE))):
            begin, n = self.first[bucket[part]], self.first[bucket[part] + 1] - self.first[bucket[part]]
            at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
            cell = np.repeat(owner[part], n) * len(self.langs) + self.lang[at]
            out += np.bincount(cell, weights=self.more[at] * np.repeat(often[part], n), minlength=out.size).reshape(out.shape)
        return out


def train(rows: DataFrame, longest: int = LONGEST, sample: int = SAMPLE, text: str = "text", lang: str = "lang") -> Model:
    """The model of the rows whose language isn't null."""
    rows = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null")
    counts = Written(rows.groupBy("lang").agg(F.count("*").alias("n")))
    langs = sorted(r["lang"] for r in counts.df.select("lang").collect())
    if not langs:
        return Model([], np.zeros(0, dtype=np.int64), np.zeros(0))
    # the share of each language's rows that goes in: all up to `sample` rows
    width = counts.df.agg(F.max(F.octet_length("lang"))).first()[0] + 32
    known = counts.df.select(F.col("lang").alias("_lang"), (F.lit(sample) / F.col("n")).alias("share"))
    joined = rows.join(small(known, len(langs), width), F.col("lang") == F.col("_lang"))
    chosen = joined.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("text", "lang")
    number = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in (part for whole in batches for part in slices(whole, 0)):
            texts, of = batch.column(0).to_pylist(), np.array([number[x] for x in batch.column(1).to_pylist()], dtype=np.int64)
            for a, b in _blocks(texts):
                bucket, owner, _ = ngrams(texts[a:b], BITS, longest)
                new, often = np.unique(of[a:b][owner] << BITS | bucket, return_counts=True)
                key, at = np.unique(np.concatenate([key, new]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([n, often]), minlength=len(key)).astype(np.int64)
        if len(key):
            yield pa.record_batch([pa.array(key), pa.array(n)], names=["key", "n"])

    # at most languages x buckets rows, each task's counts are merged before they move
    found = chosen.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    counts.drop()
    return Model(langs, found["key"].to_numpy(dtype=np.int64), found["n"].to_numpy(dtype=np.float64))


def predict(docs: DataFrame, model: Model, longest: int = LONGEST, text: str = "text") -> Column:
    """A column struct(lang_pred, score) by the broadcast model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            texts, best, score = list(batch), [], []
            for a, b in _blocks(texts, most=max(1, SLICE // len(model.langs))) if model.langs else []:
                bucket, owner, has = ngrams(texts[a:b], BITS, longest)
                n = np.bincount(owner, minlength=b - a)
                evidence = model.evidence(bucket, owner, b - a) / np.sqrt(np.maximum(n, 1))[:, None]
                top = evidence.argmax(axis=1)
                part = np.exp(evidence - evidence.max(axis=1, keepdims=True))
                best += [model.langs[k] if ok else "und" for k, ok in zip(top, has, strict=True)]
                score += np.where(has, 1 / part.sum(axis=1), 0.0).tolist()
            yield pd.DataFrame({"lang_pred": best, "score": score}) if model.langs else pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts)})

    return run(F.col(text))

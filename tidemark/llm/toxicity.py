"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches.

Folding: lower case, homoglyphs and digits become the letters they stand for. Learning, from labelled rows: the share
of toxic documents among those with a word gives word stems, each the longest that keeps its support, and whole words,
with their log-odds as weights. Words that begin like a stem but stand in clean texts become exceptions, and so do
phrases of two words that clean texts have around a hit; phrases can be given besides. Matching: a stem counts at the
start of a word and outside exceptions. The weights, and the weights for each 100 characters, go through a logistic
curve that is fitted on at most `sample` labelled rows. At most `LABELLED` labelled documents are learned from, chosen by
a hash of their id, so their ids can always be broadcast. An entry needs the support of `least` documents and of a share
`SUPPORT` of those with its label: so the lexicon has as many entries as the language has, not as the corpus has rows.
Stems have 4 to 12 letters; longer words are learned whole.

Null and empty texts have no hits and get the score of such texts; very long texts are matched whole, in one pass.
Without both labels in the training rows all scores are 0.5 times the share of the label present, below 0.5; so they
are without any row. A label that is null or no 0 or 1 is no label; an id that is labelled twice counts twice. Repeated
rows are scored one by one. Only the text is scored, whatever else the rows hold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Written, slices, small

SAMPLE, LABELLED, SUPPORT = 50_000, 1_000_000, 0.0002
#: Characters that look like Latin letters, then digits and signs that stand for letters.
LOOKALIKES = "аеорсухіјѕԁԛԝһоαεορυικντ" + "0134578@$"
LETTERS = "aeopcyxijsdqwhoaeopuikvt" + "oieastbas"


def folded(text: Column) -> Column:
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), LOOKALIKES, LETTERS)


def labelled(docs: DataFrame, labels: DataFrame, most: int = LABELLED, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, toxic) of the documents that have a label, at most about `most` of them."""
    known = labels.select(F.col(id_column).alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("_id is not null and toxic in (0, 1)")
    n = known.count()
    share = min(1.0, most / max(n, 1))
    chosen = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    own = docs.select(F.col(id_column).alias("_doc"), F.col(text).alias("text"))
    return own.join(small(chosen, min(n, most + most // 10), 16), F.col("_doc") == F.col("_id")).select("text", "toxic")


def words_in(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(r"\p{L}+"), F.lit(0))


def _tally(rows: DataFrame, key: str) -> DataFrame:
    """(key, t, c): how many toxic and clean rows (key, toxic) each key has."""
    return rows.groupBy(key).agg(F.sum("toxic").cast("long").alias("t"), F.sum(1 - F.col("toxic")).cast("long").alias("c"))


def learn_lexicon(rows: DataFrame, least: int = 5, support: float = SUPPORT, purity: float = 0.8, shortest: int = 4, longest: int = 12) -> tuple[dict[str, float], list[str]]:
    """({stem: weight}, exception words and phrases) from rows (text, toxic)."""
    of = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    least_t, least_c = (max(least, math.ceil(support * of.get(k, 0))) for k in (1, 0))
    counts = Written(_tally(rows.select("toxic", F.explode(F.array_distinct(words_in(F.col("text")))).alias("word")), "word"))
    # beginnings of words, and whole words with a blank behind
    begins = f"concat(transform(sequence({shortest}, least(length(word), {longest})), n -> left(word, n)), array(concat(word, ' ')))"
    every = counts.df.where(F.length("word") >= shortest).select("t", "c", F.explode(F.expr(begins)).alias("stem")).groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    found = every.where((F.col("t") >= least_t) & (F.col("t") >= purity * (F.col("t") + F.col("c"))))
    top = {r["stem"]: (r["t"], r["c"]) for r in found.collect()}
    by_start: dict[str, list[str]] = {}
    for s in sorted(top):
        if not s.endswith(" "):
            by_start.setdefault(s[:-1], []).append(s)
    kept: dict[str, float] = {}
    for stem in sorted(top, key=lambda s: (len(s), s)):
        if any(stem[:k] in kept for k in range(shortest, len(stem) + 1)):
            continue
        while longer := [s for s in by_start.get(stem, []) if top[s][0] >= 0.95 * top[stem][0]]:
            stem = longer[0]
        t, c = top[stem]
        kept[stem] = min(8.0, math.log((t + 0.5) / (c + 0.5)) + 1.0)
    if not kept:
        counts.drop()
        return {}, []
    stems = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in sorted(kept)], "stem string"))
    starts = F.expr(f"concat(transform(sequence({shortest}, greatest({shortest}, least(length(word), {longest}))), n -> left(word, n)), array(concat(word, ' ')))")
    hits = Written(counts.df.select("word", "t", "c", F.explode(starts).alias("stem")).join(stems, "stem").select("word", "t", "c").distinct())
    clean = (F.col("c") >= least_c) & (F.col("t") * 2 < F.col("c"))
    words = [r["word"] for r in hits.df.where(clean).select("word").collect()]
    phrase = F.explode(_beside(rows, kept, words)).alias("phrase")
    phrases = _tally(rows.select("toxic", phrase), "phrase").where(clean)
    words += [r["phrase"] for r in phrases.select("phrase").collect()]
    counts.drop()
    hits.drop()
    return kept, sorted(words)


def _automaton(weights: dict[str, float], excepted: list[str]):
    """Of stems, whole words (a blank behind) and exceptions: (length, weight or None, whether it must end a word)."""
    import ahocorasick

    auto = ahocorasick.Automaton()
    for stem, w in weights.items():
        auto.add_word(stem.rstrip(" "), (len(stem.rstrip(" ")), w, stem.endswith(" ")))
    for phrase in excepted:
        if phrase and phrase not in weights and f"{phrase} " not in weights:
            auto.add_word(phrase, (len(phrase), None, True))
    if len(auto):
        auto.make_automaton()
    return auto


def _matches(auto, x: str) -> Iterator[tuple[int, int, float | None]]:
    """(first, last, weight or None) of the entries that begin a word of x, and end one where they must."""
    for end, (n, w, whole) in auto.iter(x) if len(auto) and x else ():
        at = end + 1 - n
        if not (at and x[at - 1].isalpha() or whole and end + 1 < len(x) and x[end + 1].isalpha()):
            yield at, end, w


def _beside(rows: DataFrame, lexicon: dict[str, float], clean: list[str], text: str = "text") -> Column:
    """The text's different phrases of a hit and the word before or after it, a blank between; clean words are no hits."""
    shared = rows.sparkSession.sparkContext.broadcast((lexicon, frozenset(clean)))

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, harmless = shared.value
        auto = _automaton(weights, [])

        def word(x: str, at: int, step: int) -> int:
            """Where the word that goes on at `at` ends, in the direction of step; one past it."""
            while 0 <= at < len(x) and x[at].isalpha():
                at += step
            return at

        def around(x: str) -> list[str]:
            found = set()
            for at in sorted({at for at, _, _ in _matches(auto, x)}):
                end = word(x, at, 1)
                if x[at:end] in harmless:
                    continue
                before = word(x, at - 2, -1) + 1 if at and x[at - 1] == " " else at
                if before < at - 1:
                    found.add(x[before:end])
                after = word(x, end + 1, 1) if end < len(x) and x[end] == " " else end
                if after > end + 1:
                    found.add(x[at:after])
            return sorted(found)

        for batch in batches:
            parts = slices(pa.record_batch([batch], names=["x"]), 0)
            out = [pa.array([around(x) for x in part.column(0).to_pylist()], pa.list_(pa.string())) for part in parts]
            yield pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))

    return run(folded(F.col(text)))


def features(docs: DataFrame, lexicon: dict[str, float], exceptions: list[str], text: str = "text") -> Column:
    """array(sum of the weights found, its share of the length) of the text."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, exceptions))

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        auto = _automaton(*shared.value)
        for batch in batches:
            out = []
            for x in batch:
                hits, safe = {}, []
                for at, end, w in _matches(auto, x):
                    if w is None:
                        safe.append((at, end))
                    else:
                        hits[at] = max(w, hits.get(at, 0.0))
                total, till, k = 0.0, -1, 0
                safe.sort()
                for at in sorted(hits):
                    while k < len(safe) and safe[k][0] <= at:
                        till, k = max(till, safe[k][1]), k + 1
                    total += hits[at] if at > till else 0.0
                out.append([total, 100 * total / (len(x) + 100)])
            yield pd.Series(out)

    return run(folded(F.col(text)))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic curve over log1p of the features, the last for the constant; Newton's method."""
    if not len(y) or y.min() == y.max():
        return np.array([0.0, 0.0, -20.0 if not len(y) or y[0] == 0 else -0.01])
    a = np.column_stack([np.log1p(x), np.ones(len(x))])
    w, keep = np.zeros(3), ridge * len(y) / 1000 * np.diag([1.0, 1.0, 0.0]) + 1e-9 * np.eye(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep, a.T @ (y - p) - keep @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(rows: DataFrame, sample: int = SAMPLE, exceptions: tuple[str, ...] = ()) -> tuple[dict[str, float], list[str], np.ndarray]:
    """(lexicon, exceptions, curve) from rows (text, toxic 0/1)."""
    rows = rows.select("text", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    lexicon, learned = learn_lexicon(rows)
    excepted = sorted({*learned, *exceptions})
    n = rows.count()
    part = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(min(1.0, sample / max(n, 1)) * (1 << 20)))
    found = part.select("toxic", features(part, lexicon, excepted).alias("f")).select("toxic", F.col("f")[0].alias("a"), F.col("f")[1].alias("b")).toPandas()
    return lexicon, excepted, fit_curve(found[["a", "b"]].to_numpy(dtype=float), found["toxic"].to_numpy(dtype=float))


def score(docs: DataFrame, model: tuple[dict[str, float], list[str], np.ndarray], text: str = "text") -> Column:
    """The score of the text, 0 to 1."""
    lexicon, excepted, (a, b, c) = model
    f = features(docs, lexicon, excepted, text)
    return F.transform(F.array(f), lambda x: 1 / (1 + F.exp(-(a * F.log1p(x[0]) + b * F.log1p(x[1]) + c))))[0]

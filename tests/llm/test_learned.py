import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from tests.llm import brute
from tidemark.llm import entry, langid, toxicity

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in entry.read(spark, SF, "documents").collect()}
    got = [r for r in entry.op2_language_id(spark, SF).collect() if r.held_out]
    assert len(got) > 100 and all(brute.crc(r.doc_id) == 0 for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def plain_ngrams(text, longest):
    """n-grams of the normalised text, with a letter in each."""
    out, last = [], ""
    clean = ""
    for c in " " + text.lower():
        c = c if c.isalpha() else " "
        if c == " " and last == " ":
            continue
        clean += c
        last = c
    for n in range(1, longest + 1):
        out += [clean[i : i + n] for i in range(len(clean) - n + 1) if any(x.isalpha() for x in clean[i : i + n])]
    return out


def test_ngrams_are_counted_once_each():
    texts = ["Héllo,  wörld 12 x", "", None, "a", "abc abc"]
    bucket, owner, has = langid.ngrams(texts, 16, 3)
    for i, t in enumerate(texts):
        want = plain_ngrams(t or "", 3)
        assert (owner == i).sum() == len(want)
        assert len(set(bucket[owner == i])) == len(set(want))
    assert has.tolist() == [True, False, False, True, True]


def test_language_edges(docs, none, rows):
    model = langid.train(docs)
    assert model.langs == ["de", "en"]
    got = docs.select("doc_id", "text", langid.predict(docs, model).alias("p")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.p.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        assert 0 <= r.p.score <= 1
    nothing = langid.train(none)
    assert {r.p.lang_pred for r in docs.select(langid.predict(docs, nothing).alias("p")).collect()} == {"und"}
    assert none.select(langid.predict(none, model)).collect() == []


def bucket_of(gram):
    """The bucket of one n-gram, in plain integers."""
    h = len(gram) * 0x2545F491 & 0xFFFFFFFF
    for c, m in zip(gram, langid._MULT, strict=False):
        h = (h ^ ord(c)) * int(m) & 0xFFFFFFFF
        h ^= h >> 15
    return (h * 0x9E3779B1 & 0xFFFFFFFF) >> 16


def plain_posteriors(train, texts):
    """(language, score) of each text by naive Bayes over counters."""
    counts = defaultdict(Counter)
    for t, lang in train:
        counts[lang].update(map(bucket_of, plain_ngrams(t or "", 4)) if lang is not None else ())
        if lang is None:
            del counts[lang]
    out = []
    for t in texts:
        grams = Counter(map(bucket_of, plain_ngrams(t or "", 4)))
        if not counts or not grams:
            out.append(("und", 0.0))
            continue
        total = {k: sum(c.values()) + 0.5 * 65536 for k, c in counts.items()}
        e = {k: sum(n * math.log((c[g] + 0.5) / total[k]) for g, n in grams.items()) / math.sqrt(sum(grams.values())) for k, c in counts.items()}
        best = min(e, key=lambda k: (-e[k], k))
        out.append((best, 1 / sum(math.exp(x - e[best]) for x in e.values())))
    return out


def test_posteriors_against_counters(docs, rows, spark):
    langs = ["xx", "yy", "zz", None, ""]
    train = [(t if t is None or len(t) < 20_000 else t[:20_000], langs[i % 5]) for i, (_, t, *_) in enumerate(rows)]
    model = langid.train(spark.createDataFrame(train, "text string, lang string"))
    texts = [t for t, _ in train]
    want = plain_posteriors(train, texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
    got = {r.i: r.p for r in df.select("i", langid.predict(df, model).alias("p")).collect()}
    for i, (lang, score) in enumerate(want):
        assert abs(got[i].score - score) < 1e-4, i
        assert got[i].lang_pred == lang or score < 0.34, i


def test_many_languages_keep_the_buckets(spark):
    train = [(f"wort{i} {chr(97 + i % 26) * 3} text", f"l{i:04}") for i in range(700)]
    model = langid.train(spark.createDataFrame(train, "text string, lang string"))
    assert len(model.langs) == 700 and len(model.first) == (1 << 16) + 1
    want = plain_posteriors(train, [t for t, _ in train[:30]])
    bucket, owner, _ = langid.ngrams([t for t, _ in train[:30]], 16)
    e = model.evidence(bucket, owner, 30)
    assert [model.langs[k] for k in e.argmax(axis=1)] == [x for x, _ in want]


def test_toxicity_of_held_out_documents(spark):
    labels = {r.doc_id: r.toxic for r in entry.read(spark, SF, "labels").collect()}
    got = [r for r in entry.op5_toxicity(spark, SF).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in got]) > 0.95


def toxic_corpus(spark, often=40):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdeilnort", k=rng.randint(3, 8)))
    rows = []
    for i in range(400):
        text = [word() for _ in range(rng.randint(10, 60))]
        toxic = i % 4 == 0
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["grobian", "GROBIAN", "gr0bian", "grоbian", "grobians"])
        elif i % often == 1:
            text[rng.randrange(len(text))] = "grobianology"
        rows.append((" ".join(text), int(toxic)))
    return spark.createDataFrame(rows, "text string, toxic int")


def test_folding_weights_and_exceptions(spark):
    model = toxicity.train(toxic_corpus(spark), exceptions=("grobian street",))
    lexicon, excepted, _ = model
    assert any("grobian".startswith(s) for s in lexicon) or "grobian" in lexicon
    assert "grobianology" in excepted
    texts = ["you grobian", "you GR0BIAN!", "a grоbians", "about grobianology", "on grobian street today", "fine words only", "", None, "xgrobian"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r[0]: r[1] for r in df.select("doc_id", toxicity.score(df, model)).collect()}
    assert min(got[i] for i in (0, 1, 2)) >= 0.5 and max(got[i] for i in (3, 4, 5, 6, 7, 8)) < 0.5
    long = spark.createDataFrame([("you grobian " + "fine words only " * 2_000,), ("you grobian",)], "text string")
    a, b = (r[0] for r in long.select(toxicity.score(long, model)).collect())
    assert a <= b


def test_phrases_of_clean_texts_become_exceptions(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdeilnort", k=rng.randint(3, 8)))
    rows = []
    for i in range(600):
        text = [word() for _ in range(20)]
        if i % 3 == 0:
            text[9:11] = ["you", "grobian"]
        elif i % 24 == 1:
            text[9:11] = ["grobian", "street"]
        rows.append((" ".join(text), int(i % 3 == 0)))
    model = toxicity.train(spark.createDataFrame(rows, "text string, toxic int"))
    assert "grobian street" in model[1] and not any(x.startswith("you ") for x in model[1])
    df = spark.createDataFrame([(0, "a you grobian x"), (1, "the GR0BIAN street corner"), (2, "grobian street, you grobian")], "doc_id long, text string")
    got = {r[0]: r[1] for r in df.select("doc_id", toxicity.score(df, model)).collect()}
    assert got[0] >= 0.5 > got[1] and got[2] >= 0.5


def plain_score(text, model):
    """The score by looking for every entry at every place."""
    lexicon, excepted, (a, b, c) = model
    x = (text or "").lower().translate(str.maketrans(toxicity.LOOKALIKES, toxicity.LETTERS))
    whole = lambda at, n: not (at and x[at - 1].isalpha()) and not (at + n < len(x) and x[at + n].isalpha())
    safe = {i for p in excepted if p and p not in lexicon and p + " " not in lexicon for at in range(len(x)) if x.startswith(p, at) and whole(at, len(p)) for i in range(at, at + len(p))}
    total = 0.0
    for at in range(len(x)):
        own = [w for s, w in lexicon.items() if x.startswith(s.rstrip(" "), at) and not (at and x[at - 1].isalpha()) and (not s.endswith(" ") or whole(at, len(s) - 1))]
        total += max(own) if own and at not in safe else 0.0
    return 1 / (1 + math.exp(-(a * math.log1p(total) + b * math.log1p(100 * total / (len(x) + 100)) + c)))


def test_scores_against_every_place(spark):
    model = toxicity.train(toxic_corpus(spark), exceptions=("grobian street", "street of grobian"))
    rng = random.Random(9)
    parts = ["grobian", "GR0BIAN", "grobians", "grobianology", "street", "of", "grobian street", "x", "grоbian", "agrobian", "grobian-", "3", "."]
    texts = [" ".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(200)] + ["", None, "grobian " * 3_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r[0]: r[1] for r in df.select("i", toxicity.score(df, model)).collect()}
    assert all(abs(got[i] - plain_score(t, model)) < 1e-9 for i, t in enumerate(texts))


def test_odd_labels(spark):
    docs = spark.createDataFrame([(1, "a", 9), (1, "a", 9), (2, None, 9), (None, "c", 9), (4, "d", 9)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(1, 1, "z"), (2, 0, "z"), (None, 1, "z"), (4, None, "z"), (4, 7, "z"), (1, 0, "z")], "doc_id long, toxic int, text string")
    got = Counter((r.text, r.toxic) for r in toxicity.labelled(docs, labels).collect())
    assert got == Counter({("a", 1): 2, ("a", 0): 2, (None, 0): 1})


def test_whole_words_where_the_beginning_is_common(spark):
    model = toxicity.train(toxic_corpus(spark, 4 + 1))
    assert "grobian " in model[0] and "grobian" not in model[0]
    df = spark.createDataFrame([(0, "a grobian"), (1, "of grobianology")], "doc_id long, text string")
    got = {r[0]: r[1] for r in df.select("doc_id", toxicity.score(df, model)).collect()}
    assert got[0] >= 0.5 > got[1]


def test_toxicity_edges(docs, none, spark):
    empty = spark.createDataFrame([], "text string, toxic int")
    model = toxicity.train(empty)
    assert all(0 <= r[0] < 0.5 for r in docs.select(toxicity.score(docs, model)).collect())
    assert none.select(toxicity.score(none, model)).collect() == []
    one = toxicity.train(spark.createDataFrame([("a b", 1), (None, 1)], "text string, toxic int"))
    assert all(0 <= r[0] <= 1 for r in docs.select(toxicity.score(docs, one)).collect())


def test_words_beside_hits(spark):
    """Against all pairs of words that a blank joins, of which one begins like a stem or is a whole word of the lexicon."""
    texts = [None, "", "grob", "a grobian b", "a  grobian\nb", "mean grob mean", "x grobheit grob y, grob", "xgrob grob", "GR0B mann tell teller tell", "é grobß grobé"]
    lexicon, clean = {"grob": 1.0, "tell ": 1.0}, ["grobheit"]
    expected = []
    for text in texts:
        x = (text or "").lower().translate(str.maketrans(toxicity.LOOKALIKES, toxicity.LETTERS))
        hit = lambda w: w not in clean and (w.startswith("grob") or w == "tell")
        words = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\W\d_]+", x)]
        expected.append(sorted({f"{a[2]} {b[2]}" for a, b in zip(words, words[1:]) if x[a[1] : b[0]] == " " and (hit(a[2]) or hit(b[2]))}))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r[0]: r[1] for r in rows.select("i", toxicity._beside(rows, lexicon, clean)).collect()}
    assert [got[i] for i in range(len(texts))] == expected

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from tidemark.llm import packing, pretoken, token_counts


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_pretokens_agree_with_the_library(path, library):
    rng = random.Random(1)
    parts = ["a", "'", "s", "'s", "'re", "ll", "'ll", "'ve", " ", "  ", "\n", "\t", "\u00a0", "é", "中", "1", "٣", "#", "!!", "\u2003", "\x1c", "\x85", "😀", "don't", " 's", "''", "<|endoftext|>", "a" * 70, "\U00031350"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(2_000)]
    enc = pretoken.Encoder(path)
    raw = [t.encode() for t in texts]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in enc.ids(raw)] == expected
    assert enc.counts(raw).tolist() == [len(x) for x in expected]


def test_long_texts_and_full_caches(path, library):
    rng = random.Random(2)
    text = "".join(rng.choices(["ab", " c", "'s", "\n", "  x", "é", " 12", "!"], k=900_000))
    tiny = pretoken.Encoder(path, bits=8)
    assert len(text.encode()) > pretoken.CHUNK
    assert tiny.ids([text.encode()])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    words = [f" w{i}x{i * 7}" for i in range(600)]
    assert tiny.counts([w.encode() for w in words]).tolist() == [len(library.encode(w, add_special_tokens=False).ids) for w in words]
    blob = "x" * (pretoken.CHUNK + 10)
    assert pretoken.safe_cuts(blob.encode()) == []
    assert tiny.counts([b"x" * 3_000])[0] == len(library.encode("x" * 3_000, add_special_tokens=False).ids)


def test_counts(docs, rows, path, library):
    want = Counter((k, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t, *_ in rows)
    got = token_counts.token_counts(docs, path, limit=100, most=50).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)


def test_counts_of_nothing(none, path):
    assert token_counts.token_counts(none, path).collect() == []


def test_summaries_keep_the_frequent(docs, path):
    found = token_counts.frequent_pretokens(docs, path, most=200)
    assert 0 < len(found) <= 200 and len(set(found)) == len(found)
    assert token_counts.trimmed({"a": 5, "b": 3, "c": 1}, 2) == {"a": 4, "b": 2}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_is_best_fit_decreasing(lengths):
    size = 64
    rooms, used = defaultdict(list), set()
    for length, lo, hi, first, each, offset in packing.plan(Counter(lengths), size):
        for r in range(lo, hi):
            rooms[first + (r - lo) // each].append((offset + (r - lo) % each * length, length))
            used.add((length, r))
    assert len(used) == len(lengths)
    for pieces in rooms.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    assert len(rooms) == brute.best_fit(lengths, size)


def test_packing(docs, rows, path, library):
    got = packing.pack(docs, path, size=256).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    want = defaultdict(list)
    for k, t, *_ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for i, (a, n) in enumerate(packing.cut(len(ids), 256)):
            want[k].append((i, a, n, zlib.crc32(ids[a : a + n].tobytes())))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    assert len(sequences) == brute.best_fit([n for v in want.values() for _, _, n, _ in v], 256)


def test_ids_of_pieces(docs, path):
    rows = packing.token_pieces(docs, path, 256).collect()
    assert all(r.length == len(r.ids) and zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in rows)


def test_packing_nothing(none, path):
    assert packing.pack(none, path).collect() == []
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)]

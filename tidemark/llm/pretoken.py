"""Exact byte-level BPE in numpy: cuts texts into pre-tokens, looks their ids up in a cache, merges what is missing.

The class of each code point (letter, number, space, other) is asked of the tokenizer itself the first time that the
code point is seen, so the cuts agree with the library's Unicode tables whatever their version. Texts that hold an
added token, and tokenizers of another make, go to the library as they are.
"""

from __future__ import annotations

import json
import os

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

OTHER, LETTER, NUMBER, SPACE, UNKNOWN = 0, 1, 2, 3, 255
#: Bytes that are cut and looked up at once; longer texts are cut where a space follows a letter or digit.
CHUNK = 1 << 18
#: Longer pre-tokens go to the library and aren't kept.
LONG = 64
NEVER = np.int64(1 << 40)

_rng = np.random.default_rng(20250101)
_TABLES = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASES = _rng.integers(1, 1 << 62, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = None


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of data[starts[i]:ends[i]]; data holds at most CHUNK bytes."""
    global _POWERS
    if _POWERS is None:
        _POWERS = [_powers(b, CHUNK + 1) for b in _BASES]
    out = []
    for table, power in zip(_TABLES, _POWERS, strict=True):
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(table[data] * power[: len(data)], out=sums[1:])
        out.append((sums[ends] - sums[starts]) * power[CHUNK - starts])
    return out[0], out[1]


class Splitter:
    """Cuts UTF-8 into the pre-tokens of the byte-level pre-tokenizer."""

    def __init__(self, tokenizer):
        self._cut = tokenizer.pre_tokenizer.pre_tokenize_str
        self._class = np.full(0x110000, UNKNOWN, dtype=np.uint8)

    def _learn(self, points: np.ndarray) -> None:
        for p in points:
            # joined to a letter, a number or a sign: of that class; to none of them: a space
            starts = {a for _, (a, _) in self._cut(f"a{chr(p)}1{chr(p)}#{chr(p)}.")}
            self._class[p] = LETTER if 1 not in starts else NUMBER if 3 not in starts else OTHER if 5 not in starts else SPACE

    def starts(self, data: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
        """Byte offsets where pre-tokens start. doc_starts: offsets of texts that aren't empty, ascending, the first 0."""
        if not len(data):
            return np.zeros(0, dtype=np.int64)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        point = data[at].astype(np.int32)
        wide = np.flatnonzero(point >= 0x80)
        if len(wide):
            lead, pos = point[wide], at[wide]
            tail = np.concatenate([data, np.zeros(3, dtype=np.uint8)]).astype(np.int32) & 0x3F
            a, b, c = tail[pos + 1], tail[pos + 2], tail[pos + 3]
            point[wide] = np.where(lead < 0xE0, (lead & 0x1F) << 6 | a, np.where(lead < 0xF0, (lead & 0x0F) << 12 | a << 6 | b, (lead & 0x07) << 18 | a << 12 | b << 6 | c))
        kind = self._class[point]
        if (kind == UNKNOWN).any():
            self._learn(np.unique(point[kind == UNKNOWN]))
            kind = self._class[point]
        n = len(at)
        first = np.zeros(n + 1, dtype=bool)
        first[np.searchsorted(at, doc_starts)] = True
        first[n] = True
        cut = first[:n].copy()
        cut[1:] |= kind[1:] != kind[:-1]
        # the last character of a run of spaces goes with what follows if it is a blank, else it stands alone
        after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:n]) + 1
        cut[after - 1] = True
        cut[after[point[after - 1] == 32]] = False
        # 's 't 'm 'd 're 've 'll
        mark = np.flatnonzero((point == 39) & ~first[1:])
        if len(mark):
            mark = mark[first[mark] | (kind[mark - 1] != OTHER) & (point[mark - 1] != 32)]
            more = np.concatenate([point, [0, 0, 0]])
            one, two = more[mark + 1], np.where(first[np.minimum(mark + 2, n)], 0, more[mark + 2])
            short = np.isin(one, [ord(x) for x in "stmd"])
            long = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            for hit, size in ((mark[short], 2), (mark[long], 3)):
                cut[hit + 1] = False
                if size == 3:
                    cut[hit + 2] = False
                cut[(hit + size)[hit + size < n]] = True
        return at[cut]


class Merger:
    """Byte-pair merges of many short byte strings at once, one merge a string and round, lowest rank first, leftmost first."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        # the printable stand-ins of the byte-level alphabet
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        sign = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self._byte = np.array([vocab[sign[b]] for b in range(256)], dtype=np.int64)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self._size = np.int64(max(vocab.values()) + 1)
        key = np.array([vocab[a] * int(self._size) + vocab[b] for a, b in pairs], dtype=np.int64)
        self._made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        # a sparse table by hash: nearly every pair is found, or found missing, at its first place
        self._bits = max(10, int(len(key) * 5).bit_length())
        self._key, self._rank = np.full(1 << self._bits, -1, dtype=np.int64), np.full(1 << self._bits, NEVER, dtype=np.int64)
        left, slot = np.arange(len(key)), self._slot(key)
        while len(left):
            free = np.flatnonzero(self._key[slot] < 0)
            free = free[np.unique(slot[free], return_index=True)[1]]
            self._key[slot[free]], self._rank[slot[free]] = key[left[free]], left[free]
            go = np.ones(len(left), dtype=bool)
            go[free] = False
            left, slot = left[go], (slot[go] + 1) & ((1 << self._bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _GOLDEN) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self._size + right
        slot = self._slot(key)
        at = self._key[slot]
        out = np.where(at == key, self._rank[slot], NEVER)
        more = np.flatnonzero((at != key) & (at >= 0))
        while len(more):
            slot[more] = (slot[more] + 1) & ((1 << self._bits) - 1)
            at = self._key[slot[more]]
            out[more] = np.where(at == key[more], self._rank[slot[more]], NEVER)
            more = more[(at != key[more]) & (at >= 0)]
        return out

    def encode(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all strings one after another, and how many each has. sizes: their bytes, at least 1 each."""
        ids, word = self._byte[data], np.repeat(np.arange(len(sizes)), sizes)
        last = np.append(word[1:] != word[:-1], True)
        rank = np.where(last, NEVER, self._ranks(ids, np.append(ids[1:], 0)))
        done_ids, done_words = [], []
        while len(ids):
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            span = np.diff(np.append(begin, len(ids)))
            best = np.repeat(np.minimum.reduceat(rank, begin), span)
            over = best == NEVER
            if over.any():
                done_ids.append(ids[over])
                done_words.append(word[over])
                keep = ~over
                ids, word, rank, best = ids[keep], word[keep], rank[keep], best[keep]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == best)
            hit = hit[np.append(True, word[hit[1:]] != word[hit[:-1]])]
            ids[hit] = self._made[rank[hit]]
            keep = np.ones(len(ids), dtype=bool)
            keep[hit + 1] = False
            hit = hit - np.arange(len(hit))  # one id goes before each later place
            ids, word, rank = ids[keep], word[keep], rank[keep]
            touched = np.zeros(len(ids), dtype=bool)
            touched[hit] = True
            touched[hit[hit > 0] - 1] = True
            near = np.flatnonzero(touched)
            after = np.minimum(near + 1, len(ids) - 1)
            rank[near] = np.where((after > near) & (word[after] == word[near]), self._ranks(ids[near], ids[after]), NEVER)
        if not done_ids:
            return np.zeros(0, dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
        ids, word = np.concatenate(done_ids), np.concatenate(done_words)
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(sizes))


class Cache:
    """Open addressing from a pair of hashes to a row number; a full cache starts anew."""

    def __init__(self, bits: int):
        self.bits, self.n = bits, 0
        self._keys = np.zeros((1 << bits, 2), dtype=np.uint64)
        self._row = np.full(1 << bits, -1, dtype=np.int32)

    def full(self, more: int) -> bool:
        return self.n + more > (1 << self.bits) * 6 // 10

    def _slot(self, a: np.ndarray) -> np.ndarray:
        return ((a * _GOLDEN) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rows of the pairs, -1 where there is none."""
        out, left, slot = np.full(len(a), -1, dtype=np.int64), np.arange(len(a)), self._slot(a)
        while len(left):
            row = self._row[slot]
            same = (row >= 0) & (self._keys[slot, 0] == a[left]) & (self._keys[slot, 1] == b[left])
            out[left[same]] = row[same]
            go = (row >= 0) & ~same
            left, slot = left[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Gives distinct pairs that aren't here the next rows, in their order."""
        row = np.arange(self.n, self.n + len(a), dtype=np.int32)
        self.n += len(a)
        left, slot = np.arange(len(a)), self._slot(a)
        while len(left):
            free = np.flatnonzero(self._row[slot] < 0)
            free = free[np.unique(slot[free], return_index=True)[1]]
            at, who = slot[free], left[free]
            self._keys[at, 0], self._keys[at, 1], self._row[at] = a[who], b[who], row[who]
            go = np.ones(len(left), dtype=bool)
            go[free] = False
            left, slot = left[go], (slot[go] + 1) & ((1 << self.bits) - 1)


class Encoder:
    """Token ids or counts of texts as the library gives them, without added special tokens."""

    def __init__(self, path: str, bits: int = 20):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cutter, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.plain = (
            cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
            and not spec.get("normalizer") and model.get("type") == "BPE"
            and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        )
        self.added = [x["content"].encode() for x in spec.get("added_tokens") or []]
        if self.plain:
            self.splitter, self.merger, self._bits = Splitter(self.library), Merger(model), bits
            self._anew()

    def _anew(self, need: int = 0) -> None:
        """An empty cache, large enough for `need` pre-tokens at once."""
        self._bits = max(self._bits, (2 * need).bit_length())
        self._cache = Cache(self._bits)
        self._from, self._count, self._ids, self._used = np.zeros(1 << self._bits, dtype=np.int64), np.zeros(1 << self._bits, dtype=np.int32), np.zeros(1 << 16, dtype=np.uint32), 0

    def _keep(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        if self._used + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros(max(len(self._ids), len(ids)), dtype=np.uint32)])
        rows = slice(self._cache.n, self._cache.n + len(a))
        self._ids[self._used : self._used + len(ids)] = ids
        self._count[rows] = counts
        self._from[rows] = self._used + np.cumsum(counts) - counts
        self._used += len(ids)
        self._cache.add(a, b)

    def direct(self, text: bytes) -> np.ndarray:
        return np.array(self.library.encode(text.decode(), add_special_tokens=False).ids, dtype=np.uint32)

    def chunks(self, texts: list[bytes]):
        """Yields (texts' numbers, their lengths, data) of at most CHUNK bytes, or (number, None, text) to encode directly."""
        numbers, sizes, parts, total = [], [], [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.plain or any(x in text for x in self.added):
                yield i, None, text
                continue
            cuts = [0, len(text)]
            if len(text) > CHUNK and not (cuts := safe_cuts(text)):
                yield i, None, text
                continue
            for a, b in zip(cuts, cuts[1:], strict=False):
                if total + b - a > CHUNK:
                    yield numbers, sizes, b"".join(parts)
                    numbers, sizes, parts, total = [], [], [], 0
                numbers.append(i)
                sizes.append(b - a)
                parts.append(text[a:b])
                total += b - a
        if numbers:
            yield numbers, sizes, b"".join(parts)

    def pieces(self, raw: bytes, sizes: list[int]):
        """data, starts and ends of its pre-tokens, and of each text the number of its first pre-token."""
        data = np.frombuffer(raw, dtype=np.uint8)
        docs = np.cumsum(sizes) - sizes
        starts = self.splitter.starts(data, docs)
        return data, starts, np.append(starts[1:], len(data)), np.searchsorted(starts, docs)

    def _rows(self, raw: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, known=None):
        """Cache rows of the pre-tokens (-1: long or known), and those that are long. known: counts by hashes, or -1."""
        a, b = piece_hashes(data, starts, ends)
        fixed = known(a, b) if known else np.full(len(a), -1, dtype=np.int64)
        big = np.flatnonzero((ends - starts > LONG) & (fixed < 0))
        look = np.flatnonzero((ends - starts <= LONG) & (fixed < 0))
        a, b = a[look], b[look]
        found = self._cache.find(a, b)
        tries = 0
        while len(miss := np.flatnonzero(found < 0)):
            new = miss[np.unique(a[miss], return_index=True)[1]]
            if self._cache.full(len(new)) and not tries:
                self._anew(len(a))
                found = np.full(len(a), -1, dtype=np.int64)
                tries = 1
                continue
            at = look[new]
            sizes = ends[at] - starts[at]
            flat = np.repeat(starts[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            ids, counts = self.merger.encode(data[flat], sizes)
            self._keep(a[new], b[new], ids, counts)
            found[miss] = self._cache.find(a[miss], b[miss])
        rows = np.full(len(starts), -1, dtype=np.int64)
        rows[look] = found
        return rows, fixed, big

    def counts(self, texts: list[bytes], known=None) -> np.ndarray:
        """Tokens of each text. known(a, b): counts that a first table has for hashes, -1 elsewhere."""
        out = np.zeros(len(texts), dtype=np.int64)
        for numbers, sizes, raw in self.chunks(texts):
            if sizes is None:
                out[numbers] += len(self.direct(raw))
                continue
            data, starts, ends, firsts = self.pieces(raw, sizes)
            rows, fixed, big = self._rows(raw, data, starts, ends, known)
            n = np.where(rows >= 0, self._count[rows], np.maximum(fixed, 0)).astype(np.int64)
            for k in big:
                n[k] = len(self.direct(raw[starts[k] : ends[k]]))
            np.add.at(out, numbers, np.add.reduceat(n, firsts))
        return out

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Token ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for numbers, sizes, raw in self.chunks(texts):
            if sizes is None:
                out[numbers].append(self.direct(raw))
                continue
            data, starts, ends, firsts = self.pieces(raw, sizes)
            rows, _, big = self._rows(raw, data, starts, ends)
            n = np.where(rows >= 0, self._count[rows], 0).astype(np.int64)
            own = {int(k): self.direct(raw[starts[k] : ends[k]]) for k in big}
            for k, x in own.items():
                n[k] = len(x)
            till = np.cumsum(n)
            flat = np.repeat(np.where(rows >= 0, self._from[rows], 0) - (till - n), n) + np.arange(n.sum())
            for k in own:
                flat[till[k] - n[k] : till[k]] = 0
            got = self._ids[flat]
            for k, x in own.items():
                got[till[k] - n[k] : till[k]] = x
            at = np.append((till - n)[firsts], len(got))
            for i, p, q in zip(numbers, at[:-1], at[1:], strict=True):
                out[i].append(got[p:q])
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, dtype=np.uint32) for x in out]


def safe_cuts(text: bytes) -> list[int]:
    """Places at most CHUNK bytes apart where a blank or line end follows an ASCII letter or digit: pre-tokens always end there. Empty: there is none."""
    data = np.frombuffer(text, dtype=np.uint8)
    space = (data[1:] == 32) | (data[1:] == 10)
    word = (data[:-1] >= 48) & (data[:-1] <= 57) | ((data[:-1] | 32) >= 97) & ((data[:-1] | 32) <= 122)
    ok = np.append(np.flatnonzero(space & word) + 1, len(text))
    cuts = [0]
    while cuts[-1] < len(text):
        near = np.searchsorted(ok, cuts[-1] + CHUNK, side="right")
        if not near or ok[near - 1] <= cuts[-1]:
            return []
        cuts.append(int(ok[near - 1]))
    return cuts


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, bits: int = 20) -> Encoder:
    """One encoder, with its cache, for each worker process and file."""
    if (path, bits) not in _encoders:
        _encoders[path, bits] = Encoder(path, bits)
    return _encoders[path, bits]

"""Byte-pair encoding of a corpus with a public tokenizer.

Every pretoken's bytes stand in a segment tree whose nodes hold the smallest pair rank of
their positions, the leftmost first. A merge reads the root, joins the pair, and updates the
joined, the removed and the preceding position in logarithmic time. The trees of many pretokens of
a batch are worked on together, one merge of each at a time; a few long ones each by itself.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN_PATTERN = r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
# a tree's value holds a rank of at most _ID bits before a position; its largest stands for no pair
_ID, _PLACE = 24, 36
_NONE = np.int64(1) << (_ID + _PLACE)
_NO_RANK = 1 << _ID
CACHE = 400_000
_SPACED = re.compile(r"[^\S ] (?:\s|$)")


def read_vocabulary(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file with a token in base 64 and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Encodes texts to ids; keeps the ids of the pieces that it has met, up to a bound."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if max(ranks.values()) >= _NO_RANK:
            raise ValueError(f"an id needs more than {_ID} bits")
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << _ID | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.pieces: dict[str, np.ndarray] = {}
        self.words: dict[str, np.ndarray] = {}
        self.plain = re.compile(_PLAIN_PATTERN)
        odd = "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) in ("Nl", "No"))
        self.odd = re.compile(f"[\x1c-\x1f{re.escape(odd)}]")
        self.full = None

    def split(self, piece: str) -> list[str]:
        """The pretokens of a piece. The standard module stands in where both patterns agree."""
        if not self.odd.search(piece):
            return self.plain.findall(piece)
        if self.full is None:
            import regex

            self.full = regex.compile(PATTERN)
        return self.full.findall(piece)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << _ID | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NO_RANK)

    def merge_many(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of words of similar length, by one tree each, all in step."""
        n, lengths = len(words), np.array([len(w) for w in words])
        size = 1 << max(1, int(lengths.max() - 1).bit_length())
        at = np.arange(size)
        live = at < lengths[:, None]
        flat = np.zeros((n, size + 1), dtype=np.int64)
        flat[:, :size][live] = self.bytes[np.frombuffer(b"".join(words), dtype=np.uint8)]
        after = np.minimum(np.broadcast_to(at + 1, (n, size)), lengths[:, None]).copy()
        before = np.broadcast_to(at - 1, (n, size)).copy()
        tree = np.full((n, 2 * size), _NONE, dtype=np.int64)
        paired = at < (lengths - 1)[:, None]
        rank = np.full((n, size), _NO_RANK)
        rank[paired] = self._rank(flat[:, :size][paired], flat[:, 1 : size + 1][paired])
        tree[:, size:] = np.where(rank < _NO_RANK, rank << _PLACE | at, _NONE)
        for level in range(size.bit_length() - 2, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        # indices into the flattened arrays
        tree_, tok, nxt, prv = tree.reshape(-1), flat.reshape(-1), after.reshape(-1), before.reshape(-1)
        active = np.flatnonzero(tree[:, 1] < _NONE)
        while len(active):
            root = tree_[active * (2 * size) + 1]
            keep = root < _NONE
            active, root = active[keep], root[keep]
            if not len(active):
                break
            i = root & ((1 << _PLACE) - 1)
            row, trow, orow = active * size, active * (2 * size), active * (size + 1)
            length = lengths[active]
            j = nxt[row + i]
            k = nxt[row + j]
            p = prv[row + i]
            tok[orow + i] = root >> _PLACE
            live[active, j] = False
            nxt[row + i] = k
            inner = k < length
            prv[(row + k)[inner]] = i[inner]
            here = np.where(inner, self._rank(tok[orow + i], tok[orow + np.minimum(k, size)]), _NO_RANK)
            has = p >= 0
            pp = np.maximum(p, 0)
            there = np.where(has, self._rank(tok[orow + pp], tok[orow + i]), _NO_RANK)
            tree_[trow + size + i] = np.where(here < _NO_RANK, here << _PLACE | i, _NONE)
            tree_[trow + size + j] = _NONE
            back = np.where(there < _NO_RANK, there << _PLACE | pp, _NONE)
            tree_[(trow + size + pp)[has]] = back[has]
            nodes, base = np.concatenate((i, j, np.where(has, pp, i))) + size, np.concatenate((trow, trow, trow))
            for _ in range(size.bit_length() - 1):
                nodes >>= 1
                left = base + 2 * nodes
                tree_[base + nodes] = np.minimum(tree_[left], tree_[left + 1])
        ids = flat[:, :size][live]
        return np.split(ids, np.cumsum(live.sum(axis=1))[:-1])

    def merge_one(self, word: bytes) -> np.ndarray:
        """The ids of one word, by the same tree in plain numbers."""
        n, none, pairs, low = len(word), int(_NONE), self.pairs, (1 << _PLACE) - 1
        size = 1 << max(1, (n - 1).bit_length())
        tok = self.bytes[np.frombuffer(word, dtype=np.uint8)].tolist()
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * size)

        def leaf(a: int) -> int:
            b = nxt[a]
            rank = pairs.get(tok[a] << _ID | tok[b]) if b < n else None
            return none if rank is None else rank << _PLACE | a

        for a in range(n):
            tree[size + a] = leaf(a)
        for a in range(size - 1, 0, -1):
            tree[a] = min(tree[2 * a], tree[2 * a + 1])

        def put(a: int, value: int) -> None:
            a += size
            tree[a] = value
            a >>= 1
            while a:
                value = min(tree[2 * a], tree[2 * a + 1])
                if tree[a] == value:
                    return
                tree[a] = value
                a >>= 1

        live = [True] * n
        while tree[1] < none:
            root = tree[1]
            i = root & low
            j = nxt[i]
            k = nxt[j]
            tok[i], live[j], nxt[i] = root >> _PLACE, False, k
            if k < n:
                prv[k] = i
            put(j, none)
            put(i, leaf(i))
            if prv[i] >= 0:
                put(prv[i], leaf(prv[i]))
        return np.array([t for t, alive in zip(tok, live) if alive], dtype=np.int64)

    def _learn(self, words: set[str]) -> None:
        classes: dict[int, list[str]] = {}
        for w in words:
            data = w.encode("utf-8", "surrogatepass")
            classes.setdefault(max(1, (len(data) - 1).bit_length()), []).append(w)
        for size, members in classes.items():
            if len(members) * 32 < 1 << size:
                for w in members:
                    self.words[w] = self.merge_one(w.encode("utf-8", "surrogatepass")).astype(np.int32)
                continue
            step = max(32, (1 << 19) >> size)
            for a in range(0, len(members), step):
                part = members[a : a + step]
                for w, ids in zip(part, self.merge_many([x.encode("utf-8", "surrogatepass") for x in part])):
                    self.words[w] = ids.astype(np.int32)

    @staticmethod
    def cut(text: str) -> list[str]:
        """The text in pieces that begin where a blank follows another character, so that no pretoken spans two.

        A run of white space is one pretoken but for its last character, so it's only cut where a blank is its last or its first."""
        parts = text.split(" ")
        spaced = _SPACED.search(text)
        if "" not in parts and not spaced:
            return [parts[0], *[" " + p for p in parts[1:]]]
        out, blanks = [], ""
        for i, p in enumerate(parts):
            lead = blanks + (" " if i else "")
            if not p:
                blanks = lead
                continue
            if spaced and out and out[-1][-1].isspace() and (len(lead) > 1 or p[0].isspace()):
                out[-1] += lead + p
            else:
                out.append(lead + p)
            blanks = ""
        if blanks and out and out[-1][-1].isspace():
            out[-1] += blanks
            return out
        return [*out, blanks] if blanks else out

    def encode_batch(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The offsets and the ids of the texts; null and empty texts have no ids."""
        cut = [self.cut(t) if t else [] for t in texts]
        if len(self.pieces) > CACHE or len(self.words) > CACHE:
            self.pieces.clear()
            self.words.clear()
        unknown = set().union(*cut) - self.pieces.keys() if cut else set()
        spelled = {p: self.split(p) for p in unknown}
        self._learn(set().union(*spelled.values()) - self.words.keys() if spelled else set())
        for p, words in spelled.items():
            self.pieces[p] = self.words[words[0]] if len(words) == 1 else np.concatenate([self.words[w] for w in words]) if words else np.zeros(0, np.int32)
        pieces = self.pieces
        found = [pieces[p] for parts in cut for p in parts]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ends = np.concatenate(([0], np.cumsum(sizes)))
        offsets = ends[np.concatenate(([0], np.cumsum([len(parts) for parts in cut], dtype=np.int64)))]
        return offsets, np.concatenate(found) if found else np.zeros(0, np.int32)


_ENCODERS: dict[bytes, Encoder] = {}


def _encoder(name: bytes, ranks: dict[bytes, int]) -> Encoder:
    """One encoder for each vocabulary, named by its contents, and worker process."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(ranks)
    return _ENCODERS[name]


def vocabulary_name(ranks: dict[bytes, int]) -> bytes:
    """A hash of all tokens and their ranks."""
    digest = hashlib.blake2b(digest_size=16)
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        digest.update(b"%d:%d:" % (rank, len(token)) + token)
    return digest.digest()


def encode(df: DataFrame, text: str, keys: Sequence[str], vocabulary: str = VOCABULARY, count_only: bool = False) -> DataFrame:
    """keys and ids (or n_tokens) of every row.

    Null and empty texts have an empty list (0 tokens); texts are encoded whole, without special
    tokens, whose strings are ordinary text. Repeated rows come out repeatedly; other columns are
    ignored. A narrow operator: the vocabulary file, of fixed size, is read by the driver and broadcast."""
    read = read_vocabulary(vocabulary)
    name, ranks = vocabulary_name(read), df.sparkSession.sparkContext.broadcast(read)
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("n_tokens", T.LongType()) if count_only else T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, ranks.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                offsets, ids = encoder.encode_batch(batch.column("t").to_pylist())
                if count_only:
                    out = pa.array(np.diff(offsets), pa.int64())
                else:
                    out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keys))], out], [*keys, schema.fields[-1].name])

    return df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("t")).mapInArrow(run, schema)

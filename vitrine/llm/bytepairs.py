"""Byte-level byte-pair encoding by segment trees, and decoding.

A pre-token that is a token itself is that token. Of any other, each byte position is a leaf of
a segment tree and holds the rank of the pair that begins there; a node holds the leftmost least
rank below it. The root names the next pair to merge. A merge changes three leaves: the
pair's own, that of its right part, which goes, and that of the live neighbour to the left. Each
change climbs to the root, so a pre-token of n bytes takes at most 3 n log n steps, whatever it repeats.

Many short pre-tokens are worked on at once, as rows of one array of trees; a long one has a tree
of its own. Distinct pre-tokens are worked out once a worker. A text longer than ``WINDOW``
characters is cut where a blank follows what is not blank, which is always between two pre-tokens,
so memory is bounded but for runs without a blank.

Defined cases: null text is empty and has no ids; rows are independent, so null ids, ties and
repeated rows come back as they are; an empty table gives no row; other columns are ignored.
A null list of ids decodes to no bytes; an id that the ranks do not have stops the job.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from .shared import texts
from .textkit import chunks

WINDOW = 1 << 20
#: Pre-tokens of up to so many bytes share an array of trees; nodes in one array.
SHARED, NODES = 128, 1 << 21
NONE = np.int64(1) << 62
#: Rows that are decoded at once.
ROWS = 1000


class RankFile:
    """Tokens by rank, and the rank of each pair of tokens whose bytes together are a token."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.fromiter(map(len, tokens), np.int64, size)
        self.begin = np.cumsum(self.length) - self.length
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if self.single.min() < 0:
            raise ValueError("the ranks lack a byte")

    @functools.cached_property
    def pairs(self) -> dict[int, int]:
        """Only encoding needs them; a worker that decodes does not hold them."""
        get, found = self.ranks.get, {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = get(token[:k]), get(token[k:])
                if a is not None and b is not None:
                    found[a << 32 | b] = rank
        return found

    @functools.cached_property
    def sorted_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array(sorted(self.pairs), np.int64)
        return keys, np.array([self.pairs[k] for k in keys.tolist()], np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each pair of token ids, NONE where it is no token."""
        key = a << 32 | b
        keys, values = self.sorted_pairs
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, values[at], NONE)


def merge_long(file: RankFile, data: bytes) -> list[int]:
    """The ids of one pre-token, by a tree of its own."""
    n = len(data)
    size = 1 << max(1, (n - 1).bit_length())
    ids = file.single[np.frombuffer(data, np.uint8)]
    tree = [NONE] * (2 * size)
    first = file.rank(ids[:-1], ids[1:])
    tree[size : size + n - 1] = [r if r == NONE else r * size + i for i, r in enumerate(first.tolist())]
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    ids, after, before, pairs, none = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), file.pairs, int(NONE)

    def put(at: int, value: int) -> None:
        node = size + at
        tree[node] = value
        while node > 1:
            other = tree[node ^ 1]
            node >>= 1
            if other < value:
                value = other
            if tree[node] == value:
                break
            tree[node] = value

    while tree[1] < none:
        rank, at = divmod(tree[1], size)
        right = after[at]
        ids[at] = rank
        after[at] = follows = after[right]
        put(right, none)
        if follows < n:
            before[follows] = at
            r = pairs.get(rank << 32 | ids[follows])
            put(at, none if r is None else r * size + at)
        else:
            put(at, none)
        if (left := before[at]) >= 0:
            r = pairs.get(ids[left] << 32 | rank)
            put(left, none if r is None else r * size + left)
    out, at = [], 0
    while at < n:
        out.append(ids[at])
        at = after[at]
    return out


def merge_short(file: RankFile, data: list[bytes], size: int) -> list[list[int]]:
    """The ids of pre-tokens of at most ``size`` bytes (a power of two), one row of trees each."""
    m = len(data)
    length = np.fromiter(map(len, data), np.int64, m)
    inside = np.arange(size) < length[:, None]
    ids = np.zeros((m, size), np.int64)
    ids[inside] = file.single[np.frombuffer(b"".join(data), np.uint8)]
    tree = np.full((m, 2 * size), NONE)
    here, place = inside[:, 1:], np.arange(size - 1)
    ranks = file.rank(ids[:, :-1][here], ids[:, 1:][here])
    tree[:, size:-1][here] = np.where(ranks == NONE, NONE, ranks * size + np.broadcast_to(place, here.shape)[here])
    level = size
    while level > 1:
        level >>= 1
        np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
    after = np.broadcast_to(np.arange(1, size + 1), (m, size)).copy()
    before = np.broadcast_to(np.arange(-1, size - 1), (m, size)).copy()
    live = np.ones((m, size), bool) & inside
    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        rank, at = np.divmod(tree[rows, 1], size)
        right = after[rows, at]
        follows = after[rows, right]
        ids[rows, at] = rank
        after[rows, at] = follows
        live[rows, right] = False
        more = follows < length[rows]
        before[rows[more], follows[more]] = at[more]
        own = np.full(len(rows), NONE)
        r = file.rank(rank[more], ids[rows[more], follows[more]])
        own[more] = np.where(r == NONE, NONE, r * size + at[more])
        tree[rows, size + right] = NONE
        tree[rows, size + at] = own
        left = before[rows, at]
        has = left >= 0
        r = file.rank(ids[rows[has], left[has]], rank[has])
        tree[rows[has], size + left[has]] = np.where(r == NONE, NONE, r * size + left[has])
        left = np.where(has, left, at)
        nodes = [size + right, size + at, size + left]
        for _ in range(size.bit_length() - 1):
            nodes = [x >> 1 for x in nodes]
            for x in nodes:
                tree[rows, x] = np.minimum(tree[rows, 2 * x], tree[rows, 2 * x + 1])
        rows = rows[tree[rows, 1] < NONE]
    flat, ends = ids[live].tolist(), np.cumsum(live.sum(1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Encoder:
    """Encodes texts by one rank file and decodes ids."""

    def __init__(self, path: str):
        self.file = RankFile(path)
        self.store = pieces.Store(self.give)

    def give(self, strings: list[str]) -> list[list[int]]:
        """The ids of each pre-token."""
        raw = [s.encode("utf-8", "surrogatepass") for s in strings]
        out: list[list[int]] = [[]] * len(raw)
        sizes: dict[int, list[int]] = {}
        for i, data in enumerate(raw):
            whole = self.file.ranks.get(data)
            if whole is not None:
                out[i] = [whole]
            elif len(data) > SHARED:
                out[i] = merge_long(self.file, data)
            elif data:
                sizes.setdefault(1 << (len(data) - 1).bit_length(), []).append(i)
        for size, which in sizes.items():
            step = max(1, NODES // (2 * size))
            for k in range(0, len(which), step):
                part = which[k : k + step]
                for i, ids in zip(part, merge_short(self.file, [raw[i] for i in part], size), strict=True):
                    out[i] = ids
        return out

    def encode(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, and each text's first (one more at the end)."""
        cp, first = pieces.code_points(rows)
        if not len(cp):
            return np.zeros(0, np.uint32), np.zeros(len(rows) + 1, np.int64)
        starts = pieces.byte_level(cp, first)[0]
        begin, size = self.store.look_up(cp, starts, np.append(starts[1:], len(cp)))
        ids = self.store.values[pieces.spread(begin, size)].astype(np.uint32)
        return ids, np.append(0, np.cumsum(size))[np.searchsorted(starts, first)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids' bytes, and where those of each id end."""
        size = self.file.length[ids]
        return self.file.bytes[pieces.spread(self.file.begin[ids], size)], np.cumsum(size)


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def windows(text: str, most: int = WINDOW) -> Iterator[str]:
    """The text in parts of some ``most`` characters, cut only where a blank follows what is none."""
    at = 0
    while len(text) - at > most:
        to = at + most
        while to < len(text) and (not text[to].isspace() or text[to - 1].isspace() or text[to] in "\x1c\x1d\x1e\x1f" or text[to - 1] in "\x1c\x1d\x1e\x1f"):
            to += 1
        yield text[at:to]
        at = to
    yield text[at:]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids: unsigned little-endian 32-bit integers, one after the other."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for chunk in chunks(batches):
            rows = chunk.texts.to_pylist()
            if len(rows) == 1:
                ids = np.concatenate([own.encode([part])[0] for part in windows(rows[0])])
                first = np.array([0, len(ids)])
            else:
                ids, first = own.encode(rows)
            data = pa.py_buffer(ids.astype("<u4"))
            columns = [chunk.batch.column("doc_id"), pa.array(np.diff(first)), pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(4 * first.astype(np.int64)), data]).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids"])

    return texts(docs).mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def decoded(tokens: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """The columns of ``tokens`` and the bytes that the ids stand for."""
    if to in tokens.columns:
        raise ValueError(f"there is a column {to} already")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, max(b.num_rows, 1), ROWS)):
            out = []
            for value in batch.column(ids):
                data = np.frombuffer(value.as_buffer() or b"", "<u4") if value.is_valid else np.zeros(0, np.uint32)
                parts = [own.decode(data[k : k + WINDOW].astype(np.int64))[0].tobytes() for k in range(0, len(data), WINDOW)]
                out.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, to])

    schema = tokens.withColumn(to, F.lit(None).cast("binary")).schema
    return tokens.mapInArrow(decode, schema)

"""Byte-level BPE encoding and decoding.

A piece's bytes are the leaves of a segment tree that holds, for each live token, the rank of the pair it
starts; the root is the leftmost pair of least rank. A merge changes two neighbours' pairs and removes one
token, so it costs three point updates of logarithmic length, whatever the length of the piece. Short pieces
that a worker meets for the first time are merged together, one numpy row and tree each; long ones one by one.

Null text counts as empty: no tokens. A text of any length is encoded whole; repeated rows give repeated results.
Empty tables give no rows. Only the id and text columns are read, so other columns' names don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from shelfwise.llm.batches import map_arrays, map_slices

#: Bytes of the chunks of text that a worker remembers, twice over, and characters of the longest; bytes of the largest tree of the batches.
KNOWN_BYTES, KNOWN_CHARS, TREE_BYTES = 24 << 20, 64, 64
#: Bytes of Arrow data encoded at a time: tokens, their places and what they decode to take some 30 times as much.
CODED_BYTES = 1 << 20
#: A remembered chunk's place in its dictionary, in bytes.
PLACE_BYTES = 100
#: The pattern whose matches can be cut as Codec says, and the white space that stands in the way.
CUT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
UNEVEN_SPACE = r"[ \n][ \n]|\A[ \n]|[ \n]\z|[\t\x0B-\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NONE = 1 << 62


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ranks from the lines of a rank file."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * size)
    ends = list(range(1, n + 1))  # of the live token that starts at a position
    before = list(range(-1, n - 1))
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * size + i  # smaller rank first, then the leftmost
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            a, b = tree[i], tree[i ^ 1]
            i >>= 1
            least = a if a < b else b
            if tree[i] == least:
                return
            tree[i] = least

    def pair(i: int) -> int:
        mid = ends[i]
        r = get(piece[i : ends[mid]]) if mid < n else None
        return NONE if r is None else r * size + i

    while (least := tree[1]) != NONE:
        i = least % size
        gone = ends[i]
        ends[i] = after = ends[gone]
        if after < n:
            before[after] = i
        put(gone, NONE)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class Trees:
    """Merges many short pieces at once: row p of each array belongs to piece p."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, r in ranks.items():
            for at in range(1, len(token)):
                a, b = ranks.get(token[:at]), ranks.get(token[at:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(r)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.array(values, np.int64)[order], -1)
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        found = np.searchsorted(self.keys, key)
        return np.where(self.keys[found] == key, self.ranks[found] * size + at, NONE)

    def merge(self, pieces: list[bytes], size: int) -> list[bytes]:
        """The ids, as 32-bit integers, of pieces of at most `size` bytes, a power of two."""
        many = len(pieces)
        n = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(many, size)
        token = np.concatenate([self.bytes[raw], np.zeros((many, 1), np.int64)], axis=1)
        at = np.arange(size, dtype=np.int64)
        live = at[None, :] < n[:, None]
        ends = np.broadcast_to(at + 1, (many, size)).copy()
        before = np.broadcast_to(at - 1, (many, size)).copy()
        tree = np.full((many, 2 * size), NONE, np.int64)
        first = self.pair(token[:, : size - 1], token[:, 1:size], size, at[None, : size - 1])
        tree[:, size : 2 * size - 1] = np.where(at[None, 1:size] < n[:, None], first, NONE)
        width = size
        while width > 1:
            tree[:, width // 2 : width] = np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2])
            width //= 2
        rows = np.flatnonzero(tree[:, 1] != NONE)
        while rows.size:
            least = tree[rows, 1]
            i = least % size
            gone = ends[rows, i]
            after = ends[rows, gone]
            token[rows, i] = least // size
            ends[rows, i] = after
            live[rows, gone] = False
            more = after < n[rows]
            before[rows[more], after[more]] = i[more]
            left = before[rows, i]
            tree[rows, size + gone] = NONE
            tree[rows, size + i] = np.where(more, self.pair(token[rows, i], token[rows, after], size, i), NONE)
            has = left >= 0
            tree[rows[has], size + left[has]] = self.pair(token[rows[has], left[has]], token[rows[has], i[has]], size, left[has])
            for r, leaf in ((rows, gone), (rows, i), (rows[has], left[has])):
                node = (size + leaf) >> 1
                while node.size and node[0]:
                    tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
                    node = node >> 1
            rows = rows[tree[rows, 1] != NONE]
        ids, stops = token[:, :size][live].astype(np.int32).tobytes(), (4 * np.cumsum(live.sum(axis=1))).tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops)]


class Codec:
    """Encodes texts and decodes ids by the ranks of one file.

    Where every space of a text stands between two characters that aren't white space, and every line break too,
    the pattern's matches never cross the places before a space and around a line break: whatever follows a lone
    space is matched with it. Such texts are cut there first, and a worker remembers the ids of what it has met.
    """

    def __init__(self, data: bytes, pattern: str):
        self.ranks = read_ranks(data)
        self.numbers = pa.array(self.ranks.values(), pa.int32())
        self.bytes = pa.array(self.ranks.keys(), pa.binary())
        self.decimals = self.numbers.cast(pa.string())
        self.find = regex.compile(pattern).findall
        self.cuts = pattern == CUT_PATTERN
        self.trees = Trees(self.ranks)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def merged(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of distinct pieces, as 32-bit integers."""
        out, waiting = {}, {8: [], 16: [], 32: [], 64: []}
        for text in pieces:
            data = text.encode()
            if data in self.ranks:
                out[text] = self.ranks[data].to_bytes(4, sys.byteorder)
            elif len(data) > TREE_BYTES:
                out[text] = np.array(merge_piece(data, self.ranks), np.int32).tobytes()
            else:
                waiting[max(8, 1 << (len(data) - 1).bit_length())].append((text, data))
        for size, found in waiting.items():
            for at in range(0, len(found), 4096):
                part = found[at : at + 4096]
                out.update(zip((t for t, _ in part), self.trees.merge([d for _, d in part], size)))
        return out

    def chunks(self, texts: list[str]) -> pa.ListArray:
        """Each text's chunks; for a text that can't be cut as above, the pattern's matches. No text holds a NUL."""
        even = pa.array(texts, pa.string())
        if self.cuts:
            uneven = pc.match_substring_regex(even, UNEVEN_SPACE).to_numpy(zero_copy_only=False)
        else:
            uneven = np.ones(len(texts), bool)
        for pattern, by in ((" ", "\0 "), ("\n", "\0\n\0")):
            even = pc.replace_substring(even, pattern, by)
        if uneven.any():
            even = pa.array([("\0".join(self.find(t)) if odd else e) for t, odd, e in zip(texts, uneven, even.to_pylist())], pa.string())
        return pc.split_pattern(even, "\0")

    def ids_of(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks, as 32-bit integers."""
        out = [self.known.get(c) for c in chunks]
        missing = [(at, c) for at, c in enumerate(chunks) if out[at] is None]
        new = []
        for at, c in missing:
            out[at] = got = self.older.get(c)
            if got is None:
                new.append((at, c, self.find(c)))
            else:
                self.remember(c, got)
        ids = self.merged(set().union(*(pieces for _, _, pieces in new)))
        for at, c, pieces in new:
            out[at] = ids[pieces[0]] if len(pieces) == 1 else b"".join([ids[p] for p in pieces])
            if len(c) <= KNOWN_CHARS:
                self.remember(c, out[at])
        return out

    def remember(self, chunk: str, ids: bytes) -> None:
        if self.held > KNOWN_BYTES:
            self.known, self.older, self.held = {}, self.known, 0
        self.known[chunk] = ids
        self.held += sys.getsizeof(chunk) + sys.getsizeof(ids) + PLACE_BYTES

    def encode_many(self, texts: list[str]) -> pa.ListArray:
        """Each text's ids, as list<int32>."""
        nul = [at for at, t in enumerate(texts) if "\0" in t]
        if nul:
            out = self.encode_many([t if "\0" not in t else "" for t in texts]).to_pylist()
            for at in nul:
                out[at] = np.frombuffer(self.ids_of([texts[at]])[0], np.int32).tolist()
            return pa.array(out, pa.list_(pa.int32()))
        cut = self.chunks(texts)
        coded = cut.values.dictionary_encode()
        ids = self.ids_of(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.int32)
        starts = np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy()
        many = sizes[which]
        stops = np.concatenate([[0], np.cumsum(many)])
        places = np.arange(stops[-1]) + np.repeat(starts[which] - stops[:-1], many)
        return pa.ListArray.from_arrays(pa.array(stops[cut.offsets.to_numpy()], pa.int32()), pa.array(flat[places], pa.int32()))

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].as_py()

    def joined(self, ids: pa.ListArray) -> pa.Array:
        """Each row's decimal ids, joined by commas."""
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.decimals.take(pc.index_in(ids.values, self.numbers))), ",")

    def decode_many(self, ids: pa.ListArray) -> pa.Array:
        """Each row's bytes; an id outside the vocabulary is an error."""
        places = pc.index_in(ids.values, self.numbers)
        if places.null_count:
            raise ValueError("an id outside the vocabulary")
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.bytes.take(places)), b"")

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_many(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


_codecs: dict[str, Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """One for each vocabulary and worker, kept between tasks."""
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(data, pattern)
    return _codecs[key]


#: Bytes of a rank file that may be broadcast.
VOCABULARY_BYTES = 32 << 20


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:
        data = f.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{path}: more than {VOCABULARY_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast(data)


def _schema(df: DataFrame, keep: tuple[str, ...], rest: str) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep) + rest


def encode(df: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns of `keep` and ids of every row; null text has no ids."""
    data = _vocabulary(df, path)

    def make():
        c = codec(data.value, pattern)
        return lambda texts: [c.encode_many(pc.fill_null(texts, "").to_pylist())]

    return map_arrays(df.select(*dict.fromkeys((*keep, text_col))), [*keep], [text_col], "ids array<int>", make, CODED_BYTES)


def encode_checked(df: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns of `keep`, n_tokens, ids and round_trip: whether the ids decode to the text's bytes."""
    data = _vocabulary(df, path)

    def make():
        c = codec(data.value, pattern)

        def arrays(texts):
            texts = pc.fill_null(texts, "")
            ids = c.encode_many(texts.to_pylist())
            return [pc.list_value_length(ids), ids, pc.equal(c.decode_many(ids), texts.cast(pa.binary()))]

        return arrays

    return map_arrays(df.select(*dict.fromkeys((*keep, text_col))), [*keep], [text_col], "n_tokens bigint, ids array<int>, round_trip boolean", make, CODED_BYTES)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Id and bytes of every row; null ids give no bytes, an id outside the vocabulary is an error."""
    data = _vocabulary(df, path)

    def make():
        c = codec(data.value, pattern)
        return lambda keys, ids: list(zip(keys, c.decode_many(pa.array([i or [] for i in ids], pa.list_(pa.int32()))).to_pylist()))

    return map_slices(df.select(id_col, ids_col), _schema(df, (id_col,), "bytes binary"), make)


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, n_tokens, ids_sha256 of the decimal ids joined by commas, and decoded_sha256 of the bytes they decode to."""
    data = _vocabulary(df, path)

    def make():
        c = codec(data.value, pattern)

        def rows(keys, texts):
            ids = c.encode_many([t or "" for t in texts])
            lengths = np.diff(ids.offsets.to_numpy()).tolist()
            hashes = [[hashlib.sha256(x.as_buffer()).hexdigest() for x in a] for a in (c.joined(ids), c.decode_many(ids))]
            return list(zip(keys, lengths, *hashes))

        return rows

    return map_slices(df.select(id_col, text_col), _schema(df, (id_col,), "n_tokens bigint, ids_sha256 string, decoded_sha256 string"), make, CODED_BYTES)

"""Tokenizing a corpus: every distinct piece once, then whole texts by lookup.

Both tokenizers cut a text into pieces before they merge, and white space
always ends one. So a text's ids are those of its pieces, joined. A first pass
finds the distinct pieces (hash and bytes), each is encoded once with the
tokenizers library, and the result lies in the shared folder as sorted hash
arrays, split into shards by hash range. The second pass maps these files and
gathers ids, a block of texts at a time, without a Python object for each word.

Pieces of "words" are runs of non-space bytes, for tokenizers that drop white
space and ignore case. Pieces of "spaced" are such runs with the space before
them, and the white space that is left, cut as the byte-level pattern
`\\s+(?!\\S)|\\s+` cuts it. ASCII punctuation that ends such a run after a letter
or digit is a piece of its own, as the pattern cuts there too. A text that holds
other white space than ASCII's is one piece.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textcore as core

#: Distinct pieces that one task holds before it hands them on.
FLUSH_PIECES = 400_000

_loaded: dict = {}
_MARK, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def tokenizer(path: str):
    """The tokenizer of a file, loaded once a process.

    As the vocabulary files' own notes have it, special tokens' strings in a text are ordinary
    text: a document can't put an end of text into the ids.
    """
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _loaded[path] = t
    return _loaded[path]


def id_type(path: str) -> np.dtype:
    return np.dtype("<u2" if tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")


def spelled(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes that the ids of a byte-level vocabulary stand for: where each id's start, how many they are, and all of them."""
    if ("bytes", path) not in _loaded:
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # these bytes are written as themselves, others from 256 on
        of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        vocabulary = tokenizer(path).get_vocab(with_added_tokens=True)
        made = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            made[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        length = np.array([len(x) for x in made], np.int64)
        _loaded["bytes", path] = np.cumsum(length) - length, length, np.frombuffer(b"".join(made), np.uint8)
    return _loaded["bytes", path]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of all elements of the ranges [start, start + length), in order."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def wide_space_rows(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows with white space beyond ASCII."""
    at = np.flatnonzero(data >= 0xC2)
    at = at[np.isin(data[at], (0xC2, 0xE1, 0xE2, 0xE3))]
    if not len(at):
        return at
    pad = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, c = pad[at], pad[at + 1], pad[at + 2]
    space = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    space |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | np.isin(c, (0xA8, 0xA9, 0xAF)))) | ((b == 0x81) & (c == 0x9F)))
    return np.unique(np.searchsorted(off, at[space], side="right") - 1)


def short_runs(starts, ends, row) -> tuple[np.ndarray, np.ndarray]:
    """Spans of 3 to 10 neighbouring words of at most two bytes, one from each word that begins one."""
    short = ends - starts <= 2
    reach = np.arange(len(starts))
    for d in range(1, 10):  # how far an unbroken run goes, ten words at most
        if d < len(starts):
            on = (reach[:-d] == np.arange(len(starts) - d) + d - 1) & short[d:] & short[:-d] & (row[d:] == row[:-d])
            reach[:-d][on] += 1
    at = np.flatnonzero(reach - np.arange(len(starts)) >= 2)
    return starts[at], ends[reach[at]]


def marks_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the marks at the end of each word begin, its end if it has none: ASCII punctuation, up to 8 bytes, after a letter or digit of ASCII or a letter of Latin-1."""
    at = ends.copy()
    some = np.flatnonzero(_MARK[data[ends - 1]]) if len(ends) else np.zeros(0, np.int64)
    for k in range(1, 9):
        some = some[ends[some] - k > starts[some]]
        before = ends[some] - k - 1
        mark = _MARK[data[before]]
        own, b = some[~mark], before[~mark]
        last, lead = data[b], data[np.maximum(b - 1, 0)]
        letter = _ALNUM[last] | ((b > starts[own]) & (lead == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))
        at[own[letter]] = b[letter] + 1
        some = some[mark]
    return at


def pieces(kind: str, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of a block's pieces, and per row the index of its first piece (rows + 1 values).

    Kinds are "words", "spaced", and "segments": words, and runs of very short ones.
    """
    starts, ends, first = core.word_bounds(data, off)
    if kind == "words":
        return starts, ends, first
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    if kind == "segments":
        s, e = short_runs(starts, ends, row)
        s, e = np.concatenate([starts, s]), np.concatenate([ends, e])
        order = np.argsort(s, kind="stable")
        s, e = s[order], e[order]
        return s, e, np.searchsorted(s, off)
    before = off[row]
    if len(starts):
        same = np.empty(len(starts), bool)
        same[0] = False
        same[1:] = row[1:] == row[:-1]
        before = np.where(same, np.concatenate([[0], ends[:-1]]), before)
    gap = starts - before
    lead = (gap > 0) & (data[np.maximum(starts - 1, 0)] == 32) if len(starts) else np.zeros(0, bool)
    run, lone = gap >= 2, (gap > 0) & ~lead
    last_end = off[:-1].copy()
    has = np.diff(first) > 0
    last_end[has] = ends[first[1:][has] - 1]
    tail = last_end < off[1:]
    mark = marks_at(data, starts, ends)
    count = 1 + (mark < ends)
    s, e, own = np.repeat(starts - lead, count), np.repeat(ends, count), np.cumsum(count) - count
    e[own] = mark
    s[own[count > 1] + 1] = mark[count > 1]
    left, upto = np.concatenate([before[run], starts[lone] - 1, last_end[tail]]), np.concatenate([starts[run] - 1, starts[lone], off[1:][tail]])
    order = np.argsort(left)
    at = np.searchsorted(s, left[order])
    s, e = np.insert(s, at, left[order]), np.insert(e, at, upto[order])
    wide = wide_space_rows(data, off)
    if len(wide):
        own = np.searchsorted(off, s, side="right") - 1
        keep = ~np.isin(own, wide)
        s, e = np.concatenate([s[keep], off[wide]]), np.concatenate([e[keep], off[wide + 1]])
        order = core.order_of(s)
        s, e = s[order], e[order]
    return s, e, np.searchsorted(s, off)


def piece_hashes(kind: str, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return core.span_hashes(data, s, e, kind != "spaced")


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


class Distinct:
    """Distinct pieces of a task's blocks."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.seen, self.h, self.n, self.w = np.zeros(0, np.uint64), [], [], []

    def add(self, h, data, s, e):
        u, at = core.one_of_each(h)
        pos = np.minimum(np.searchsorted(self.seen, u), max(len(self.seen) - 1, 0))
        new = self.seen[pos] != u if len(self.seen) else np.ones(len(u), bool)
        u, at = u[new], at[new]
        if len(u):
            lengths = e[at] - s[at]
            self.h.append(u)
            self.n.append(lengths)
            self.w.append(data[ragged(s[at], lengths)])
            self.seen = np.sort(np.concatenate([self.seen, u]))

    def rows(self, shards: int):
        if not self.h:
            return
        h, n, w = np.concatenate(self.h), np.concatenate(self.n), np.concatenate(self.w)
        order = core.order_of(h)
        starts = np.cumsum(n) - n
        h, n, starts = h[order], n[order], starts[order]
        cut = np.searchsorted(shard_of(h, shards), np.arange(shards + 1, dtype=np.uint64))
        for k in np.flatnonzero(np.diff(cut)):
            a, b = cut[k], cut[k + 1]
            yield int(k), core.planes(n[a:b].astype("<u4")), w[ragged(starts[a:b], n[a:b])].tobytes()
        self.clear()


def encoder(path: str, joined: bool = False):
    """Pieces' bytes -> (values of each, all values): their token ids.

    `joined`, for "spaced" pieces and byte-level vocabularies that cut words as GPT-2's do: pieces that begin with a space and hold no other
    white space are encoded many in one text. The pattern cuts before a space that a word follows and never looks back, so each has the ids
    that it has alone; the ids' bytes tell where it ends. The others are encoded alone.
    """

    def encode_alone(w: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t, dtype, ids, counts = tokenizer(path), id_type(path), [np.zeros(0, id_type(path))], [np.zeros(0, np.int64)]
        for i in range(0, len(starts), 4096):
            words = [w[a : a + x].tobytes().decode() for a, x in zip(starts[i : i + 4096], n[i : i + 4096], strict=True)]
            got = [x.ids for x in t.encode_batch_fast(words, add_special_tokens=False)]
            counts.append(np.fromiter(map(len, got), np.int64, len(got)))
            ids.append(np.fromiter((x for g in got for x in g), dtype, int(counts[-1].sum())))
        return np.concatenate(counts), np.concatenate(ids)

    def encode_joined(w: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        off = np.concatenate([[0], np.cumsum(n)])
        data = w[ragged(starts, n)]
        spaces = np.concatenate([[0], np.cumsum(core._SPACE[data])])
        follows = (n > 1) & (data[np.minimum(off[:-1], len(data) - 1)] == 32) & (spaces[off[1:]] - spaces[off[:-1]] == 1)
        follows[wide_space_rows(data, off)] = False
        some, alone = np.flatnonzero(follows), np.flatnonzero(~follows)
        t, dtype, length, ids, counts = tokenizer(path), id_type(path), spelled(path)[1], [], []
        for i in range(0, len(some), 1024):
            own = some[i : i + 1024]
            text, ends = data[ragged(off[own], n[own])].tobytes().decode(), np.cumsum(n[own])
            got = np.array(t.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype)
            stop = np.cumsum(length[got])
            upto = np.searchsorted(stop, ends) + 1
            if stop[-1] != ends[-1] or (stop[upto - 1] != ends).any():
                raise ValueError(f"{path}: ids don't end where pieces do")
            counts.append(np.diff(upto, prepend=0))
            ids.append(got)
        lone_counts, lone_ids = encode_alone(w, starts[alone], n[alone])
        own_counts, own_ids = np.concatenate([*counts, lone_counts]), np.concatenate([*ids, lone_ids])
        place = core.order_of(np.concatenate([some, alone]))
        return own_counts[place], own_ids[ragged((np.cumsum(own_counts) - own_counts)[place], own_counts[place])]

    return encode_joined if joined else encode_alone


def build_store(docs: DataFrame, text: str, encode, kind: str) -> tuple[str, int]:
    """Encodes every distinct piece of the texts once; (folder, shards) of the files."""
    spark = docs.sparkSession
    core.ship(spark)
    folder = core.shared_folder(spark, "pieces")
    shards = core.shards_for(docs.select(text))

    def collect(batches):
        core.settle()
        core.reuse()
        found = Distinct()
        schema = pa.schema([("shard", pa.int32()), ("n", pa.binary()), ("w", pa.binary())])
        flush = lambda: [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True))], schema=schema) for r in found.rows(shards)]
        for b in batches:
            data, off = core.string_buffers(b.column(0))
            for i, j in core.blocks(off):
                block = data[off[i] : off[j]]
                s, e, _ = pieces(kind, block, off[i : j + 1] - off[i])
                found.add(piece_hashes(kind, block, s, e), block, s, e)
                if len(found.seen) > FLUSH_PIECES:
                    yield from flush()
        yield from flush()

    def save(group):
        n = np.concatenate([core.unplanes(x, "<u4") for x in group.column("n").to_pylist()]).astype(np.int64)
        w = np.frombuffer(b"".join(group.column("w").to_pylist()), np.uint8)
        ends = np.cumsum(n)
        u, at = core.one_of_each(piece_hashes(kind, w, ends - n, ends))
        counts, values = encode(w, (ends - n)[at], n[at])
        k = group.column("shard")[0].as_py()
        core.put_file(f"{folder}/{k:06d}.hash", u)
        core.put_file(f"{folder}/{k:06d}.end", np.cumsum(counts))
        core.put_file(f"{folder}/{k:06d}.ids", values)
        return pa.table({"shard": pa.array([k], pa.int32()), "pieces": pa.array([len(u)], pa.int64())})

    parts = docs.select(text).mapInArrow(collect, "shard int, n binary, w binary")
    held = [r["shard"] for r in parts.groupBy("shard").applyInArrow(save, "shard int, pieces bigint").collect()]
    return folder, shards if held else 0


class Lookup:
    """Counts by 64-bit hash, in sorted files of one hash range each."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards = folder, shards

    @staticmethod
    def put(folder: str, k: int, h: np.ndarray, n: np.ndarray) -> None:
        core.put_file(f"{folder}/{k:06d}.n", n.astype("<i8"))
        core.put_file(f"{folder}/{k:06d}.hash", h)

    def get(self, h: np.ndarray) -> np.ndarray:
        """Counts of ascending hashes, 0 for those that aren't held."""
        out = np.zeros(len(h), np.int64)
        cut = np.searchsorted(shard_of(h, self.shards), np.arange(self.shards + 1, dtype=np.uint64))
        for k in np.flatnonzero(np.diff(cut)):
            try:
                own, n = (np.asarray(core.map_file(f"{self.folder}/{k:06d}.{x}", d)) for x, d in (("hash", "<u8"), ("n", "<i8")))
            except FileNotFoundError:
                continue
            if len(own):
                part = h[cut[k] : cut[k + 1]]
                at = np.minimum(np.searchsorted(own, part), len(own) - 1)
                out[cut[k] : cut[k + 1]] = np.where(own[at] == part, n[at], 0)
        return out


class Store:
    """The files of build_store, memory-mapped."""

    def __init__(self, folder: str, shards: int, dtype):
        self.folder, self.shards, self.dtype = folder, shards, dtype

    def shard(self, k: int):
        return tuple(np.asarray(core.map_file(f"{self.folder}/{k:06d}.{x}", d)) for x, d in (("hash", "<u8"), ("end", "<i8"), ("ids", self.dtype)))

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in order, and the number of ids of each piece."""
        if not len(h):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        u, back = core.numbered(h)
        cut = np.searchsorted(shard_of(u, self.shards), np.arange(self.shards + 1, dtype=np.uint64))
        counts, flat = np.empty(len(u), np.int64), []
        for k in np.flatnonzero(np.diff(cut)):
            a, b = cut[k], cut[k + 1]
            hashes, ends, ids = self.shard(int(k))
            at = np.searchsorted(hashes, u[a:b])
            stop = ends[at]
            start = np.where(at > 0, ends[at - 1], 0)
            counts[a:b] = stop - start
            flat.append(ids[ragged(start, stop - start)])
        flat = np.concatenate(flat)
        starts = np.cumsum(counts) - counts
        lengths = counts[back]
        return flat[ragged(starts[back], lengths)], lengths


def opened_store(folder: str, shards: int, dtype) -> Store:
    """One Store a process."""
    if folder not in _loaded:
        for old in [k for k, v in _loaded.items() if isinstance(v, Store)]:
            del _loaded[old]
        _loaded[folder] = Store(folder, shards, dtype)
    return _loaded[folder]


def encoded(column, store: Store, kind: str):
    """Blocks (row a, row b, ids, ends) of a string column; ends: per row, where its ids end in the block."""
    data, off = core.string_buffers(column)
    for a, b in core.blocks(off):
        block = data[off[a] : off[b]]
        s, e, first = pieces(kind, block, off[a : b + 1] - off[a])
        ids, lengths = store.ids(piece_hashes(kind, block, s, e))
        yield a, b, ids, np.concatenate([[0], np.cumsum(lengths)])[first][1:]

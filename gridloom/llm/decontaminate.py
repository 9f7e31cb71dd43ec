"""Benchmark decontamination by SimHash of item-sized windows.

A word is a run of letters, digits and non-ASCII bytes, in lower case, so that
punctuation and capitals don't hide a passage. Every window of a document as
long as some item gets a 64-bit SimHash of its five-word shingles, weighted by
rarity in the whole benchmark. Fingerprints are cut into BLOCKS blocks; two of them
within RADIUS bits differ in at most RADIUS // BLOCKS bits in some block, so
looking up each block's buckets with that many bits flipped finds every item within the
radius. Candidates are then verified: the weighted Jaccard similarity of window
and item shingles must reach THRESHOLD.

Only windows whose items' shingles weigh THRESHOLD of the lightest item of that
length are fingerprinted; others can't reach the threshold, so nothing is lost. Prefix sums over the shingles'
bits give any window's fingerprint in constant time.

Defined cases: null or wordless items match nothing, nor do such documents. Items
or documents of fewer than five words are one shingle. Repeated items each
match, repeated rows each report, and rows with a null id too. Of equal best windows the first counts. The benchmark is
read in parts of at most PART_ITEMS items and PART_BYTES bytes (a longer item is a part of its own), one pass over the
documents for each; weights are counted over all parts, so cuts don't change a match. `search` reads only the named
columns; `clean` passes all columns through, whatever their names.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packing, tokens
from . import textcore as core

K, THRESHOLD = 5, 0.8
RADIUS, BLOCKS = 17, 6
PART_ITEMS, PART_BYTES = 20_000, 16 << 20
#: Windows whose buckets are looked up at a time.
ASKED = 2048

_BITS = np.arange(64, dtype=np.uint64)
#: First bit and width of each block, and the flips that a lookup tries.
_CUTS = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
_SPANS = list(itertools.pairwise(_CUTS))
_FLIPS = [np.array([sum(1 << x for x in c) for k in range(RADIUS // BLOCKS + 1) for c in itertools.combinations(range(z - a), k)], np.int64) for a, z in _SPANS]


def signs(s: np.ndarray) -> np.ndarray:
    return ((s[:, None] >> _BITS) & np.uint64(1)).astype(np.float64) * 2 - 1


def pack(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


class Items:
    """A part of the benchmark: shingles, weights, fingerprints, and block tables by item length."""

    def __init__(self, ids: list, texts: list[str], others: tokens.Lookup | None = None, n_items: int = 0):
        """others, n_items: the whole benchmark's shingles and number of items, where this isn't all of it."""
        raw = [np.frombuffer((t or "").encode(), np.uint8) for t in texts]
        sets, words = [], []
        for x in raw:
            h = core.plain_hashes(x, np.array([0, len(x)]))[0] if len(x) else np.zeros(0, np.uint64)
            words.append(len(h))
            sets.append(core.shingles(h, K))
        keep = [i for i, n in enumerate(words) if n]
        self.ids, self.words, self.runs = [ids[i] for i in keep], np.array([words[i] for i in keep], np.int64), [sets[i] for i in keep]
        every = [np.unique(s) for s in self.runs]
        flat = np.concatenate(every) if every else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(every)), [len(s) for s in every]) if every else np.zeros(0, np.int64)
        self.shingles, n = np.unique(flat, return_counts=True)
        self.others, self.n_items = others, n_items if others else len(every)
        self.rare = float(np.log1p(self.n_items))
        self.weights = np.log1p(self.n_items / (others.get(self.shingles) if others else np.maximum(n, 1)))
        order = np.argsort(flat, kind="stable")
        self.owners, self.owner_ends = owner[order], np.cumsum(n)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.shingles >> np.uint64(44)] = True
        self.prints = np.array([pack((signs(s) * self.weight(s)[:, None]).sum(axis=0, keepdims=True))[0] for s in self.runs], np.uint64)
        totals = np.array([self.weight(s).sum() for s in self.runs])
        self.sizes = {int(w): np.flatnonzero(self.words == w) for w in np.unique(self.words)}
        self.least = {w: THRESHOLD * totals[at].min() - 1e-9 for w, at in self.sizes.items()}
        self.tables = {w: [self.buckets(self.prints[at], a, z) for a, z in _SPANS] for w, at in self.sizes.items()}

    @staticmethod
    def block(prints: np.ndarray, a: int, z: int) -> np.ndarray:
        return ((prints >> np.uint64(a)) & np.uint64((1 << (z - a)) - 1)).astype(np.int64)

    def buckets(self, prints: np.ndarray, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
        """Items in the order of a block's value, and where each value's bucket begins."""
        value = self.block(prints, a, z)
        order = np.argsort(value, kind="stable")
        return order, np.searchsorted(value[order], np.arange((1 << (z - a)) + 1))

    def near(self, prints: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, Hamming distance) of all within RADIUS among the items of w words."""
        found = []
        for low in range(0, len(prints), ASKED):
            own, pairs = prints[low : low + ASKED], []
            for (a, z), flips, (order, first) in zip(_SPANS, _FLIPS, self.tables[w], strict=True):
                value = (self.block(own, a, z)[:, None] ^ flips).ravel()
                length = first[value + 1] - first[value]
                at = tokens.ragged(first[value], length)
                pairs.append(np.repeat(np.repeat(np.arange(len(own)), len(flips)), length) * len(self.prints) + self.sizes[w][order[at]])
            window, item = np.divmod(np.unique(np.concatenate(pairs)), len(self.prints))
            bits = np.bitwise_count(own[window] ^ self.prints[item]).astype(np.int64)
            ok = bits <= RADIUS
            found.append((window[ok] + low, item[ok], bits[ok]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def place(self, s: np.ndarray) -> np.ndarray:
        """Index among the items' shingles, -1 for others."""
        out = np.full(len(s), -1, np.int64)
        maybe = np.flatnonzero(self.filter[s >> np.uint64(44)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.shingles, s[maybe]), len(self.shingles) - 1)
            hit = self.shingles[at] == s[maybe]
            out[maybe[hit]] = at[hit]
        return out

    def weight(self, s: np.ndarray) -> np.ndarray:
        at = self.place(s)
        out = np.where(at >= 0, self.weights[at], self.rare)
        if self.others:  # shingles of other parts
            rest, back = np.unique(s[at < 0], return_inverse=True)
            n = self.others.get(rest)
            out[at < 0] = np.where(n > 0, np.log1p(self.n_items / np.maximum(n, 1)), self.rare)[back]
        return out

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard of shingle multisets."""
        a, n = np.unique(window, return_counts=True)
        b, m = np.unique(self.runs[item], return_counts=True)
        every = np.union1d(a, b)
        x, y = np.zeros(len(every)), np.zeros(len(every))
        x[np.searchsorted(every, a)], y[np.searchsorted(every, b)] = n, m
        w = self.weight(every)
        return float((w * np.minimum(x, y)).sum() / (w * np.maximum(x, y)).sum())

    def matches(self, h: np.ndarray) -> list[tuple]:
        """(item, similarity, first word, words, Hamming distance) of each item's best window in a document."""
        found: dict[int, tuple] = {}
        lengths = list(self.sizes)
        long = [w for w in lengths if w >= K]
        if len(h) >= K and long:
            s = core.shingles(h, K)
            at = self.place(s)
            hits = np.flatnonzero(at >= 0)
            if len(hits):
                self.search(s, at, hits, long, found)
        for w in (w for w in lengths if w < K and w <= len(h)):  # items of one short shingle
            with np.errstate(over="ignore"):
                s = np.array([core.shingles(h[i : i + w], K)[0] for i in range(len(h) - w + 1)], np.uint64)
            at = self.place(s)
            for i in np.flatnonzero(at >= 0):
                for item in self.owned(at[i]):
                    if self.words[item] == w and item not in found:
                        found[item] = (1.0, int(i), w, 0)
        return [(item, *x) for item, x in sorted(found.items())]

    def owned(self, place: int) -> np.ndarray:
        return self.owners[self.owner_ends[place - 1] if place else 0 : self.owner_ends[place]]

    def search(self, s, at, hits, lengths, found) -> None:
        for run in np.split(hits, np.flatnonzero(np.diff(hits) > max(lengths)) + 1):  # far runs share no window
            low, high = max(0, int(run[0]) - max(lengths)), min(len(s), int(run[-1]) + max(lengths))
            part = s[low:high]
            sums = None
            held = np.concatenate([[0.0], np.cumsum(np.where(at[low:high] >= 0, self.weights[at[low:high]], 0.0))])
            for w in lengths:
                n = w - K + 1
                if n > len(part):
                    continue
                start = np.flatnonzero(held[n:] - held[:-n] >= self.least[w])
                if not len(start):
                    continue
                if sums is None:
                    sums = np.concatenate([np.zeros((1, 64)), np.cumsum(signs(part) * self.weight(part)[:, None], axis=0)])
                prints = pack(sums[start + n] - sums[start])
                for i, item, bits in zip(*self.near(prints, w), strict=True):
                    i, item = int(i), int(item)
                    window = part[start[i] : start[i] + n]
                    if np.isin(window, self.runs[item]).any():
                        got = self.similarity(window, item)
                        if got >= THRESHOLD and (item not in found or (-round(got, 12), low + start[i]) < (-round(found[item][0], 12), found[item][1])):
                            found[item] = (got, int(low + start[i]), w, int(bits))


def parts(items: DataFrame, key: str, text: str, most_items: int, most_bytes: int):
    """The benchmark as (ids, texts, repeats, whole benchmark's shingles, its items) of bounded size each, by ranges of a hash of the rows."""
    rows = items.select(F.col(key).alias("i"), F.col(text).alias("t")).groupBy("i", "t").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("i", "t"))
    total = rows.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("t"), F.lit(0))).alias("b")).first()
    n = 1 if total["n"] <= most_items and (total["b"] or 0) <= most_bytes else max(-(-total["n"] * 2 // most_items), -(-total["b"] * 2 // most_bytes))
    others, n_items = None, 0
    if n > 1:
        others, n_items, _ = packing.count_words(rows.select("t"), core.shards_for(rows), K, 1)
    for i in range(n):
        own = rows.filter(F.pmod("h", F.lit(n)) == i).select("i", "t", "n").collect()
        yield [r[0] for r in own], [r[1] for r in own], [r[2] for r in own], others, n_items


def found_in(items: Items, column):
    """(row, matches) of the rows of a column that hold an item."""
    if not len(items.ids):
        return
    data, off = core.string_buffers(column)
    for i, j in core.blocks(off):
        h, first = core.plain_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
        for x in documents_with_hits(items, h, first):
            if got := items.matches(h[first[x] : first[x + 1]]):
                yield int(i + x), got


def search(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", part_items: int = PART_ITEMS, part_bytes: int = PART_BYTES) -> DataFrame:
    """A row for each document and item that it holds: key, item_key, similarity, first_word, n_words, distance."""
    spark = docs.sparkSession
    core.ship(spark)
    kinds = docs.schema[key].dataType, benchmark.schema[item_key].dataType
    shape = f"`{key}` {kinds[0].simpleString()}, `{item_key}` {kinds[1].simpleString()}, similarity double, first_word bigint, n_words bigint, distance bigint"
    names, out = [key, item_key, "similarity", "first_word", "n_words", "distance"], None
    for part in parts(benchmark, item_key, item_text, part_items, part_bytes):
        bag = spark.sparkContext.broadcast(part)  # at most part_items and part_bytes

        def run(batches, bag=bag):
            ids, texts, repeats, *whole = bag.value
            items = Items(list(zip(ids, repeats, strict=True)), texts, *whole)
            for b in batches:
                rows = [[] for _ in names]
                for x, matches in found_in(items, b.column(1)):
                    doc = b.column(0)[x].as_py()
                    for item, *rest in matches:
                        for c, v in zip(rows, (doc, items.ids[item][0], *rest), strict=True):
                            c += [v] * items.ids[item][1]
                types = (b.schema.field(0).type, None, pa.float64(), pa.int64(), pa.int64(), pa.int64())
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) if t else pa.array(c) for c, t in zip(rows, types, strict=True)], names=names)

        found = docs.select(key, text).mapInArrow(run, shape)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", part_items: int = PART_ITEMS, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    spark = docs.sparkSession
    core.ship(spark)
    place = docs.columns.index(text)
    for part in parts(benchmark, item_key, item_text, part_items, part_bytes):
        bag = spark.sparkContext.broadcast(part)  # at most part_items and part_bytes

        def keep(batches, bag=bag):
            ids, texts, _, *whole = bag.value
            items = Items(ids, texts, *whole)
            for b in batches:
                stays = np.ones(b.num_rows, bool)
                stays[[x for x, _ in found_in(items, b.column(place))]] = False
                yield b.filter(pa.array(stays))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def documents_with_hits(items: Items, h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows of a block that hold a shingle of some item, or may hold an item of fewer than five words."""
    if min(items.sizes) < K:
        return np.flatnonzero(np.diff(first) > 0)
    if len(h) < K:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(items.place(core.shingles(h, K)) >= 0)  # windows across rows may only add rows
    return np.unique(np.searchsorted(first, at, side="right") - 1)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(core.table(spark, sf_dir, "documents"), core.table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return clean(docs, core.table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_decontaminate": op8_decontaminate}

"""Perplexity under an interpolated modified Kneser-Ney bigram model.

The model is counted in Spark and lies in the shared folder as sorted arrays,
which workers map instead of loading:

* vocabulary shards, by range of word hash: hash, count, and per word the number
  of distinct contexts before it, and as a context its total and its numbers of
  followers seen once, twice, and more often;
* bigram shards: sorted keys (context id * 2**32 + word id) and counts. They are dealt
  by context, and a context with over 1/4096 of all tokens is dealt by its followers too.

    p(w|h) = max(c(hw) - D(c(hw)), 0) / c(h) + g(h) p(w)
    p(w)   = max(a(w) - D'(a(w)), 0) / a + g' / (V + 1),   a(w): distinct contexts of w

with the three discounts of each order from its counts of counts, g(h) the mass
that discounting frees. An unseen context leaves p(w); an unseen word has only the
uniform share. Bigrams are the order whose distinct counts fit the disk budget: these
corpora repeat few trigrams, so their table would be as long as the corpus.

Defined cases: a null text counts as empty and is scored as its end token alone.
Repeated rows are learnt and scored each. With nothing to learn from, p is 1 and
base_score has N = V = 0. A null id is neither learnt from nor held out. Only the key and
text columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as core
from . import tokens

END = np.uint64(2)  # the end token's reserved hash
#: Entries that a task counts before it hands them on; what counts as a context to split, and into how many.
FLUSH, HOT_SHARE, SPLIT = 2_000_000, 4096, 64


@dataclass(frozen=True)
class Model:
    words: str
    bigrams: str
    bases: tuple[int, ...]  # first id of each vocabulary shard, and the number of ids
    shards: int
    total: int  # N
    uni: tuple[float, ...]  # D1, D2, D3+ of continuation counts
    bi: tuple[float, ...]
    pairs: int  # distinct bigrams
    uni_free: float  # mass freed at the lowest order, as a share


def with_ends(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with each row's end token, and where rows start."""
    rows = len(first) - 1
    return np.insert(h, first[1:], END), first + np.arange(rows + 1)


def discounts(n: np.ndarray) -> tuple[float, ...]:
    """D1, D2, D3+ from the numbers of n-grams seen 1, 2, 3 and 4 times; fixed ones where they don't suffice."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return d if all(0 < x <= i + 1 for i, x in enumerate(d)) else (0.5, 1.0, 1.5)


def discount(c: np.ndarray, d: tuple[float, ...]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


def merged(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = core.order_of(k)
    k, c = k[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[at], np.add.reduceat(c, at)


class Counter:
    """Counts of 64-bit keys, merged as they come."""

    def __init__(self):
        self.k, self.c, self.size = [], [], 0

    def add(self, keys: np.ndarray) -> bool:
        """Whether it is time to hand on."""
        return self.add_counted(*np.unique(keys, return_counts=True))

    def add_counted(self, u: np.ndarray, n: np.ndarray) -> bool:
        """The same for distinct keys in ascending order."""
        self.k.append(u)
        self.c.append(n.astype(np.int64))
        self.size += len(u)
        if self.size >= FLUSH:
            k, c = merged(self.k, self.c)
            self.k, self.c, self.size = [k], [c], len(k)
            return self.size >= FLUSH // 2
        return False

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = merged(self.k, self.c) if self.k else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.__init__()
        return out


def blocks_of(k: np.ndarray, c: np.ndarray, shard: np.ndarray, shards: int) -> pa.RecordBatch:
    """Rows (shard, keys as differences, counts), in byte planes; k ascends."""
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    rows = []
    for s in np.flatnonzero(np.diff(cut)):
        at = order[cut[s] : cut[s + 1]]
        rows.append({"shard": int(s), "k": core.planes(np.diff(k[at], prepend=np.uint64(0))), "c": core.planes(c[at].astype("<i8"))})
    return pa.RecordBatch.from_pylist(rows, schema=SHAPE)


def summed(group) -> tuple[np.ndarray, np.ndarray]:
    keys = [np.cumsum(core.unplanes(x, "<u8"), dtype=np.uint64) for x in group.column("k").to_pylist()]
    return merged(keys, [core.unplanes(x, "<i8") for x in group.column("c").to_pylist()])


BLOCKS = "shard int, k binary, c binary"
SHAPE = pa.schema([("shard", pa.int32()), ("k", pa.binary()), ("c", pa.binary())])


class Words:
    """The vocabulary's files, mapped as they are needed."""

    def __init__(self, folder: str, bases: tuple[int, ...]):
        self.folder, self.bases, self.shards = folder, np.array(bases), len(bases) - 1

    def file(self, k: int, name: str, kind) -> np.ndarray:
        return core.map_file(f"{self.folder}/{k:06d}.{name}", kind)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Ids of word hashes, -1 for those that weren't learnt; h ascends."""
        out = np.full(len(h), -1, np.int64)
        cut = np.searchsorted(tokens.shard_of(h, self.shards), np.arange(self.shards + 1, dtype=np.uint64))
        for k in np.flatnonzero(np.diff(cut)):
            k = int(k)
            if (n := self.bases[k + 1] - self.bases[k]) > 0:
                f, part = self.file(k, "hash", "<u8"), h[cut[k] : cut[k + 1]]
                at = np.minimum(np.searchsorted(f, part), n - 1)
                out[cut[k] : cut[k + 1]] = np.where(f[at] == part, at + self.bases[k], -1)
        return out

    def take(self, ids: np.ndarray, name: str, kind) -> np.ndarray:
        """A column's values for ascending ids; the last shard's end + 1 is the start context."""
        out = np.zeros(len(ids), kind)
        cut = np.searchsorted(ids, self.bases)
        for k in np.flatnonzero(np.diff(cut)):
            out[cut[k] : cut[k + 1]] = self.file(int(k), name, kind)[ids[cut[k] : cut[k + 1]] - self.bases[k]]
        if cut[-1] < len(ids):
            out[cut[-1] :] = self.file(self.shards, name, kind)[ids[cut[-1] :] - self.bases[-1]]
        return out


def opened_words(folder: str, bases) -> Words:
    """One Words a process for each folder."""
    if ("words", folder) not in tokens._loaded:
        for old in [k for k, v in tokens._loaded.items() if isinstance(v, Words)]:
            del tokens._loaded[old]
        tokens._loaded["words", folder] = Words(folder, bases)
    return tokens._loaded["words", folder]


def bigram_shard(context: np.ndarray, word: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    spread = np.where(hot, word % SPLIT + 1, 0)
    return tokens.shard_of(core.mix64((context * (SPLIT + 1) + spread).astype(np.uint64)), shards).astype(np.int64)


def stream(h: np.ndarray, first: np.ndarray, words: Words):
    """ids, contexts, starts of a block's rows: a token's id (-1 unknown), its context's (V at a row's start)."""
    h, starts = with_ends(h, first)
    u, back = np.unique(h, return_inverse=True)
    ids = words.ids(u)[back]
    context = np.concatenate([[0], ids[:-1]]) if len(ids) else ids
    context[starts[:-1]] = words.bases[-1]
    return ids, context, starts


def learn(texts: DataFrame, text: str = "text") -> Model:
    """Counts the model from whole texts."""
    spark = texts.sparkSession
    core.ship(spark)
    shards = core.shards_for(texts.select(text))
    words_at, bigrams_at = core.shared_folder(spark, "words"), core.shared_folder(spark, "bigrams")
    texts = texts.select(F.col(text).alias("t"))

    def count_words(batches):
        held = Counter()
        for b in batches:
            for _, _, h, first in core.hashed_rows(b.column(0)):
                if held.add(with_ends(h, first)[0]):
                    k, c = held.take()
                    yield blocks_of(k, c, tokens.shard_of(k, shards).astype(np.int64), shards)
        k, c = held.take()
        if len(k):
            yield blocks_of(k, c, tokens.shard_of(k, shards).astype(np.int64), shards)

    def save_words(group):
        k, c = summed(group)
        s = group.column("shard")[0].as_py()
        core.put_file(f"{words_at}/{s:06d}.hash", k)
        core.put_file(f"{words_at}/{s:06d}.count", c)
        return pa.table({"shard": pa.array([s], pa.int32()), "v": pa.array([len(k)], pa.int64()), "n": pa.array([int(c.sum())], pa.int64())})

    sizes = {r["shard"]: r for r in texts.mapInArrow(count_words, BLOCKS).groupBy("shard").applyInArrow(save_words, "shard int, v bigint, n bigint").collect()}
    bases = tuple(np.cumsum([0, *(sizes[s]["v"] if s in sizes else 0 for s in range(shards))]).tolist())
    total = sum(r["n"] for r in sizes.values())
    if bases[-1] >= 1 << 32:
        raise ValueError("more than 2**32 distinct words")
    if not total:
        return Model(words_at, bigrams_at, bases, shards, 0, (0.5, 1.0, 1.5), (0.5, 1.0, 1.5), 0, 1.0)

    def count_pairs(batches):
        words, held = opened_words(words_at, bases), Counter()

        def out():
            k, c = held.take()
            context, word = (k >> np.uint64(32)).astype(np.int64), (k & np.uint64(0xFFFFFFFF)).astype(np.int64)
            known, back = np.unique(context, return_inverse=True)
            hot = (known == bases[-1]) | (words.take(np.minimum(known, bases[-1] - 1), "count", "<i8") * HOT_SHARE > total)
            return blocks_of(k, c, bigram_shard(context, word, hot[back], shards), shards)

        for b in batches:
            for _, _, h, first in core.hashed_rows(b.column(0)):
                ids, context, _ = stream(h, first, words)
                if held.add((context.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64)):
                    yield out()
        if held.k:
            yield out()

    def save_pairs(group):
        k, c = summed(group)
        s = group.column("shard")[0].as_py()
        wide = "<u4" if not len(c) or int(c.max()) < 1 << 32 else "<u8"
        core.put_file(f"{bigrams_at}/{s:06d}.{wide[1:]}", c.astype(wide))
        core.put_file(f"{bigrams_at}/{s:06d}.key", k)
        context, word = (k >> np.uint64(32)).astype(np.int64), (k & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        own = context[at]
        columns = [np.add.reduceat(x, at) for x in (c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c >= 3).astype(np.int64))]
        w, d = np.unique(word, return_counts=True)
        rows, tally = [], np.bincount(np.minimum(c, 5), minlength=6)[1:5]
        cut, cut_w = np.searchsorted(own, bases), np.searchsorted(w, bases)
        for v in range(shards + 1):
            a, z = cut[v], cut[v + 1] if v < shards else len(own)
            aw, zw = (cut_w[v], cut_w[v + 1]) if v < shards else (0, 0)
            if z > a or zw > aw:
                rows.append({"shard": v, "own": core.planes(own[a:z]), "sums": b"".join(core.planes(x[a:z]) for x in columns), "w": core.planes(w[aw:zw]), "d": core.planes(d[aw:zw])})
        rows.append({"shard": -1, "own": tally.astype("<i8").tobytes(), "sums": np.array([len(k)], "<i8").tobytes(), "w": b"", "d": b""})
        return pa.Table.from_pylist(rows, schema=pa.schema([("shard", pa.int32()), *((x, pa.binary()) for x in ("own", "sums", "w", "d"))]))

    facts = texts.mapInArrow(count_pairs, BLOCKS).groupBy("shard").applyInArrow(save_pairs, "shard int, own binary, sums binary, w binary, d binary")

    def save_facts(group):
        s = group.column("shard")[0].as_py()
        if s < 0:
            tally = sum(np.frombuffer(x, "<i8") for x in group.column("own").to_pylist())
            pairs = sum(int(np.frombuffer(x, "<i8")[0]) for x in group.column("sums").to_pylist())
        else:
            n = bases[s + 1] - bases[s] if s < shards else 1
            sums, before = np.zeros((4, n), np.int64), np.zeros(n, np.int64)
            for own, x, w, d in zip(*(group.column(c).to_pylist() for c in ("own", "sums", "w", "d")), strict=True):
                at = core.unplanes(own, "<i8") - bases[s]
                for i in range(4):
                    sums[i, at] += core.unplanes(x[i * len(own) : (i + 1) * len(own)], "<i8")  # a row's contexts are distinct
                before[core.unplanes(w, "<i8") - bases[s]] += core.unplanes(d, "<i8")
            for name, x in zip(("total", "n1", "n2", "n3"), sums, strict=True):
                core.put_file(f"{words_at}/{s:06d}.{name}", x)
            core.put_file(f"{words_at}/{s:06d}.before", before)
            tally, pairs = np.bincount(np.minimum(before, 5), minlength=6)[1:5], int((before >= 3).sum())
        return pa.table({"shard": pa.array([s], pa.int32()), "pairs": pa.array([pairs], pa.int64()), "tally": pa.array([tally.tolist()], pa.list_(pa.int64()))})

    rows = facts.groupBy("shard").applyInArrow(save_facts, "shard int, pairs bigint, tally array<bigint>").collect()
    bi = next(r for r in rows if r["shard"] < 0)
    before = np.sum([r["tally"] for r in rows if r["shard"] >= 0], axis=0)
    more = sum(r["pairs"] for r in rows if r["shard"] >= 0)
    uni = discounts(before)
    free = (uni[0] * before[0] + uni[1] * before[1] + uni[2] * more) / bi["pairs"]
    return Model(words_at, bigrams_at, bases, shards, total, uni, discounts(np.array(bi["tally"])), bi["pairs"], float(free))


class Scorer:
    def __init__(self, model: Model):
        self.m, self.words = model, opened_words(model.words, model.bases)

    def counts(self, context: np.ndarray, word: np.ndarray, hot: np.ndarray) -> np.ndarray:
        out, k = np.zeros(len(word), np.int64), bigram_shard(context, word, hot, self.m.shards)
        key = (context.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64)
        order = np.argsort(k, kind="stable")
        cut = np.searchsorted(k[order], np.arange(self.m.shards + 1))
        for s in np.flatnonzero(np.diff(cut)):
            try:
                keys = core.map_file(f"{self.m.bigrams}/{s:06d}.key", "<u8")
            except FileNotFoundError:
                continue
            try:
                n = core.map_file(f"{self.m.bigrams}/{s:06d}.u4", "<u4")
            except FileNotFoundError:
                n = core.map_file(f"{self.m.bigrams}/{s:06d}.u8", "<u8")
            if len(keys):
                mine = order[cut[s] : cut[s + 1]]
                at = np.minimum(np.searchsorted(keys, key[mine]), len(keys) - 1)
                out[mine] = np.where(keys[at] == key[mine], n[at], 0)
        return out

    def block(self, h: np.ndarray, first: np.ndarray):
        """Per row: tokens, known tokens, base score, score."""
        m = self.m
        if not m.total:
            n = np.diff(first) + 1
            return n, np.zeros(len(n), np.int64), n * 0.0, n * 0.0
        ids, context, starts = stream(h, first, self.words)
        known = ids >= 0
        v = m.bases[-1]
        u, back = np.unique(np.where(known, ids, -1), return_inverse=True)
        real = u >= 0
        count, before = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
        count[real], before[real] = self.words.take(u[real], "count", "<i8"), self.words.take(u[real], "before", "<i8")
        base = np.log10((count + 0.1) / (m.total + 0.1 * (v + 1)))[back]
        low = (np.maximum(before - discount(before, m.uni), 0) / m.pairs + m.uni_free / (v + 1))[back]
        c, back_c = np.unique(context, return_inverse=True)
        real = c >= 0
        total, free, hot = np.zeros(len(c)), np.ones(len(c)), np.zeros(len(c), bool)
        facts = [self.words.take(c[real], x, "<i8") for x in ("total", "n1", "n2", "n3")]
        total[real] = facts[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            free[real] = np.where(facts[0] > 0, sum(d * x for d, x in zip(m.bi, facts[1:], strict=True)) / facts[0], 1.0)
        hot[real] = (c[real] == v) | (self.words.take(np.minimum(c[real], v - 1), "count", "<i8") * HOT_SHARE > m.total)
        p = free[back_c] * low
        at = np.flatnonzero(known & (total[back_c] > 0))
        pair, back_p = np.unique((context[at].astype(np.uint64) << np.uint64(32)) | ids[at].astype(np.uint64), return_inverse=True)
        pc, pw = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        place = np.searchsorted(c, pc)
        n = self.counts(pc, pw, hot[place])
        p[at] += (np.maximum(n - discount(n, m.bi), 0) / total[place])[back_p]
        return np.diff(starts), np.add.reduceat(known.astype(np.int64), starts[:-1]), np.add.reduceat(base, starts[:-1]), np.add.reduceat(np.log10(p), starts[:-1])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row's whole text."""
    core.ship(docs.sparkSession)

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            for i, j, h, first in core.hashed_rows(b.column(1)):
                n, known, base, s = scorer.block(h, first)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(known), pa.array(np.full(j - i, model.total, np.int64)), pa.array(base), pa.array(s), pa.array(10 ** np.minimum(-s / n, 300.0))], names=[key, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = core.table(spark, sf_dir, "documents")
    found = score(docs, learn(docs.filter(core.crc_mod("doc_id", 10) != 0)))
    held = F.coalesce(core.crc_mod("doc_id", 10) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


QUERIES = {"op3_lm_scores": op3_lm_scores}

"""N-gram Jaccard self-join by token-combination prefixes.

A document is its set of distinct k-word shingles (64-bit hashes). Documents
link when 100 * intersection >= 85 * union; the result is their components. The pipeline's
stage joins sets of five-word shingles at 80 percent; what follows is told for 85.

Order all tokens by (class, hash), rare tokens before frequent ones. Any fixed
function of the token may be its class; here frequent tokens are those that more
than SMALL sets hold, as far as they are counted.

* Let x have n tokens and p = n - ceil(0.85 n) + 1. The first token that a pair
  shares lies in both p-prefixes. If it is rare, both sides have it as a single key.
* If it is frequent, all that the pair shares is frequent, so each side has
  fewer than p rare tokens. Only such documents extend their prefix, by
  e = max(p, 2), to p - 1 + e tokens; any pair then shares e of them (the smaller
  e). They index combinations of two frequent tokens at most GAP apart there:
  were every two consecutive shared tokens further apart on either side, the gaps
  would not fit (2 (2p - 2) / (GAP + 1) < e - 1). Prefixes with p <= 8 index all their twos.
  With sizes n <= m of unlike p and q the gaps are (2p - 2 + 2q - 2) / (GAP + 1), so q - 1 < 2 (p - 1) is
  needed: at 80 percent m <= 1.25 n, p - 1 > n / 5 - 1, and q - 1 <= n / 4, which holds from n = 14 on, and p > 8 means
  n >= 40. If only q > 8, n is 32 to 39 and q at most 10: 18 / 6 < 6 - 1. A higher share only narrows this.

An entry says how many of its set's tokens a pair that needs this key can't share: those before a
single key (a pair that shares one of them has an earlier key), all rare ones for a two (a pair that
shares one of them has a single key). What is left of both sets must allow a link. It bounds a near copy
whose own tokens are many: no set but one that has them too is compared with it.

Keys that several sets hold give candidates, verified on whole sets. Up to
SMALL sets of a key are compared all with all; a larger key first compares all
with the one that lacks least, and after components are known, only what is still apart and may link.
So a group of near copies costs a number of checks in proportion to its size and to what is still apart with
few tokens of its own, and no link between different components goes unseen.

Before sets are fetched, a sieve drops pairs by parity sketches: a set's tokens
flip the bits of a table about as large as the set, and two tables differ in no
more bits than the sets differ in tokens. A link at 85 percent allows (n + m) * 15 / 185 of those, so
whatever the sieve drops isn't linked.

Rows move as binary blocks, dealt by hash of the key; sets, classes and labels
lie in the shared folder as sorted arrays that workers map.

Defined cases: a null text, or one without words, has an empty set, n_shingles
0, and is its own component. Fewer than k words are one shingle. Equal sets are
one representative, so copies are never paired. Rows of the same id share a
component. A null id links as any other; a component takes the smallest id that is not null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import components as cc
from . import textcore as core
from . import tokens

K, PERCENT = 4, 85
#: Of the pipeline's stage.
STAGE_K, STAGE_PERCENT = 5, 80
#: What is counted at a time, and from how many sets of such a run a token counts as frequent that isn't counted in full.
FREQUENT, RUN_TOKENS = 4, 2_000_000
GAP, ALL_TWOS, SMALL = 5, 8, 32
#: Tokens below this hash are counted in full: prefixes hold the smallest hashes of a class, 15 % of a set and hardly over 30.
COUNTED = np.uint64(int(0.3 * 2**64))
#: Index entries that a task holds before it hands them on.
FLUSH = 1_000_000
#: Tokens whose classes are looked up at a time.
ASKED = 400_000
#: Sets of a shard's large keys that one task compares with others, and those others that it holds at a time.
ASKING, ANSWERING = 512, 4096

_PAIR = np.uint64(0xD6E8FEB86659FD93)


def mismatch(n: int, percent: int = PERCENT) -> int:
    """p: one more than the tokens of a set that a linked set may lack."""
    return n - (percent * n + 99) // 100 + 1


def fits(n, x, m, y, percent: int = PERCENT):
    """Whether sets of n and m tokens allow a link when they share none of x and y of these."""
    return (100 + percent) * np.minimum(n - x, m - y) >= percent * (n + m)


def set_id(u: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        x = np.array([u.sum(dtype=np.uint64) * _PAIR + core.mix64(u ^ _PAIR).sum(dtype=np.uint64) + np.uint64(len(u))], np.uint64)
    return int(core.mix64(x)[0])


def sets(column, k: int = K):
    """Per row, its sorted distinct shingle hashes."""
    for _, _, h, first in core.hashed_rows(column):
        for i in range(len(first) - 1):
            yield np.unique(core.shingles(h[first[i] : first[i + 1]], k))


def keys(u: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Index keys of a set; frequent: mask over u."""
    return placed_keys(u, frequent, percent)[0]


def placed_keys(u: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set, and for each the tokens of the set that a pair which needs it doesn't share."""
    p = mismatch(len(u), percent)
    rare = u[~frequent][:p]
    if len(rare) >= p:
        return rare, np.arange(p)
    often = u[frequent][: p - 1 + max(p, 2) - len(rare)]
    reach = len(often) if p <= ALL_TWOS else GAP + 1
    with np.errstate(over="ignore"):
        twos = [core.mix64(often[:-d] * _PAIR + often[d:]) for d in range(1, min(reach, len(often)))]
    found = np.concatenate([rare, *twos])
    return found, np.minimum(np.arange(len(found)), len(rare))


def sketch(u: np.ndarray) -> np.ndarray:
    """Size (four bytes) and parity table of a set; the table has a power of two of bits, 64 at least."""
    bits = 64
    while bits < len(u):
        bits *= 2
    table = np.packbits((np.bincount((u & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))
    return np.concatenate([np.array([len(u)], "<u4").view(np.uint8), table])


def may_link(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether sketches allow a link; the larger table is folded onto the smaller one."""
    n = int(x[:4].copy().view("<u4")[0]) + int(y[:4].copy().view("<u4")[0])
    x, y = x[4:], y[4:]
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return (100 + percent) * int(np.bitwise_count(x ^ y).sum()) <= (100 - percent) * n


def sorted_file(uri: str) -> np.ndarray:
    """A file of hashes, empty where none was written."""
    try:
        return core.map_file(uri, "<u8")
    except FileNotFoundError:
        return np.zeros(0, np.uint64)


class Classes:
    """Membership in the sorted files of frequent tokens."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards = folder, shards

    def has(self, u: np.ndarray) -> np.ndarray:
        out = np.zeros(len(u), bool)
        cut = np.searchsorted(tokens.shard_of(u, self.shards), np.arange(self.shards + 1, dtype=np.uint64))
        for k in np.flatnonzero(np.diff(cut)):
            if len(f := sorted_file(f"{self.folder}/{k:06d}")):
                part = u[cut[k] : cut[k + 1]]
                out[cut[k] : cut[k + 1]] = f[np.minimum(np.searchsorted(f, part), len(f) - 1)] == part
        return out


def dealt(h: np.ndarray, columns: list[np.ndarray], shards: int):
    """Rows (shard, one block a column), columns dealt by the hash h."""
    s = tokens.shard_of(core.mix64(h), shards)
    order = np.argsort(s, kind="stable")
    cut = np.searchsorted(s[order], np.arange(shards + 1, dtype=np.uint64))
    for k in np.flatnonzero(np.diff(cut)):
        at = order[cut[k] : cut[k + 1]]
        yield {"shard": int(k)} | {f"c{i}": c[at].tobytes() for i, c in enumerate(columns)}


def block_schema(n: int) -> str:
    return "shard int" + "".join(f", c{i} binary" for i in range(n))


def as_batch(rows: list[dict], n: int) -> pa.RecordBatch:
    schema = pa.schema([("shard", pa.int32()), *((f"c{i}", pa.binary()) for i in range(n))])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def joined(group, i: int, kind="<u8") -> np.ndarray:
    return np.frombuffer(b"".join(group.column(f"c{i}").to_pylist()), kind)


def from_planes(group, i: int, kind) -> np.ndarray:
    return np.concatenate([core.unplanes(x, kind) for x in group.column(f"c{i}").to_pylist()]).astype(np.int64)


def frequent_tokens(docs: DataFrame, shards: int, words: int) -> str:
    """Folder of the frequent tokens' sorted hashes, a file for each hash range.

    Tokens below COUNTED, where prefixes come from, are counted over all distinct sets of each run; they are
    frequent in more than SMALL of them. Others are frequent if a run holds them in FREQUENT sets or more.
    """
    folder = core.shared_folder(docs.sparkSession, "frequent")

    def count(batches):
        held, seen, size = [], set(), 0

        def rows():
            u, n = np.unique(np.concatenate(held), return_counts=True)
            keep = (u < COUNTED) | (n >= FREQUENT)
            u, n = u[keep], n[keep].astype("<u4")
            cut = np.searchsorted(tokens.shard_of(u, shards), np.arange(shards + 1, dtype=np.uint64))
            return [{"shard": int(k), "c0": core.planes(np.diff(u[cut[k] : cut[k + 1]], prepend=np.uint64(0))), "c1": core.planes(n[cut[k] : cut[k + 1]])} for k in np.flatnonzero(np.diff(cut))]

        for b in batches:
            for u in sets(b.column(0), words):
                if len(u) and (s := set_id(u)) not in seen:
                    seen.add(s)
                    held.append(u)
                    size += len(u)
                    if size >= RUN_TOKENS:
                        yield as_batch(rows(), 2)
                        held, seen, size = [], set(), 0
        if held:
            yield as_batch(rows(), 2)

    def save(group):
        k = group.column("shard")[0].as_py()
        u = np.concatenate([np.cumsum(core.unplanes(x, "<u8"), dtype=np.uint64) for x in group.column("c0").to_pylist()])
        n = np.concatenate([core.unplanes(x, "<u4") for x in group.column("c1").to_pylist()])
        order = np.argsort(u, kind="stable")
        u, n = u[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        total, u = np.add.reduceat(n.astype(np.int64), at), u[at]
        core.put_file(f"{folder}/{k:06d}", u[(total > SMALL) | (u >= COUNTED)])
        return pa.table({"shard": pa.array([k], pa.int32())})

    docs.select("t").mapInArrow(count, block_schema(2)).groupBy("shard").applyInArrow(save, "shard int").count()
    return folder


def index_entries(docs: DataFrame, classes: str, shards: int, facts: str, words: int, percent: int) -> DataFrame:
    """Blocks of (key, set id, size, tokens not shared), dealt by key, and from shard `shards` on of (set id, bytes, sketch), by set id.

    Writes (id, size, set id) of every row to `facts` on the way.
    """

    def run(batches):
        from pyspark import TaskContext

        known, seen = Classes(classes, shards), set()
        parts, size, wait, waiting = [], 0, [], 0
        ids, sizes, sids = [], [], []

        def ask() -> int:
            """Keys of the waiting sets, whose classes are looked up together."""
            if not wait:
                return 0
            flat, made = np.concatenate([u for _, u in wait]), 0
            order = np.argsort(flat, kind="stable")
            mask = np.empty(len(flat), bool)
            mask[order] = known.has(flat[order])
            ends = np.cumsum([len(u) for _, u in wait])
            for (s, u), z in zip(wait, ends, strict=True):
                k, lost = placed_keys(u, mask[z - len(u) : z], percent)
                parts.append((k, np.full(len(k), s, np.uint64), np.full(len(k), len(u), "<u4"), lost.astype("<u4"), s, sketch(u)))
                made += len(k)
            wait.clear()
            return made

        def flush():
            k, s, n, lost = (np.concatenate([p[i] for p in parts]) for i in range(4))
            own, tables = np.array([p[4] for p in parts], np.uint64), [p[5] for p in parts]
            to, rows = tokens.shard_of(own, shards), list(dealt(k, [k, s, n, lost], shards))
            for r in rows:
                r |= {c: core.planes(np.frombuffer(r[c], "<u4")) for c in ("c2", "c3")}
            for x in np.unique(to):
                at = np.flatnonzero(to == x)
                rows.append({"shard": int(x) + shards, "c0": own[at].tobytes(), "c1": np.array([len(tables[i]) for i in at], "<u4").tobytes(), "c2": b"".join(tables[i].tobytes() for i in at), "c3": b""})
            return as_batch(rows, 4)

        for b in batches:
            ids.append(b.column(0).cast(pa.int64()))
            for u in sets(b.column(1), words):
                s = set_id(u) if len(u) else 0
                sizes.append(len(u))
                sids.append(s)
                if len(u) and s not in seen:
                    seen.add(s)
                    wait.append((s, u))
                    waiting += len(u)
                    if waiting >= ASKED:
                        size += ask()
                        waiting = 0
                    if size >= FLUSH:
                        yield flush()
                        parts, size = [], 0
        ask()
        if parts:
            yield flush()
        if sids:
            keep = pa.chunked_array(ids, pa.int64()).combine_chunks()
            null = np.asarray(keep.is_null())
            core.put_file(f"{facts}/{TaskContext.get().partitionId():06d}", np.rec.fromarrays([np.asarray(keep.fill_null(0)), null, np.array(sizes, np.int64), np.array(sids, np.uint64)], dtype=FACT))

    return docs.mapInArrow(run, block_schema(4))


FACT = np.dtype([("id", "<i8"), ("null", "?"), ("n", "<i8"), ("sid", "<u8")])


def read_facts(spark: SparkSession, folder: str) -> DataFrame:
    """(id, n, sid) of every row, from the files."""
    fs, path = core.opened(folder) if "://" in folder else core._from_uri(folder)
    import pyarrow.fs as pafs

    names = sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if x.base_name.isdigit())  # not drafts

    def load(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                f = core.map_file(f"{folder}/{names[i]}", FACT)
                for a in range(0, len(f), 100_000):
                    x = f[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(x["id"], mask=np.array(x["null"])), pa.array(x["n"]), pa.array(np.ascontiguousarray(x["sid"]).view(np.int64))], names=["id", "n", "sid"])

    return spark.range(0, len(names), 1, max(1, len(names))).mapInArrow(load, "id bigint, n bigint, sid bigint")


def groups(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal values in a sorted array."""
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return starts, np.concatenate([starts[1:], [len(k)]]).astype(np.int64) if len(k) else starts


def candidates(entries: DataFrame, folder: str, sketches: str, shards: int, percent: int) -> DataFrame:
    """Writes the keys that many sets hold to `folder` and sketches as a Store; blocks of the pairs to verify first."""

    def run(group):
        shard = group.column("shard")[0].as_py()
        if shard >= shards:
            save_store(sketches, shard - shards, joined(group, 0), joined(group, 1, "<u4").astype(np.int64), joined(group, 2, np.uint8))
            return pa.Table.from_batches([as_batch([], 2)])
        key, sid, n, lost = joined(group, 0), joined(group, 1), from_planes(group, 2, "<u4"), from_planes(group, 3, "<u4")
        order = np.lexsort((sid, lost, key))
        key, sid, n, lost = key[order], sid[order], n[order], lost[order]
        once = np.concatenate([[True], (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])])
        key, sid, n, lost = key[once], sid[once], n[once], lost[once]
        a, z = groups(key)
        held = np.repeat(z - a >= 2, z - a)
        key, sid, n, lost = key[held], sid[held], n[held], lost[held]
        a, z = groups(key)
        big = z - a > SMALL
        of_big = np.repeat(big, z - a)
        if of_big.any():
            core.put_file(f"{folder}/{shard:06d}.key", key[of_big])
            core.put_file(f"{folder}/{shard:06d}.sid", sid[of_big])
            core.put_file(f"{folder}/{shard:06d}.n", n[of_big])
            core.put_file(f"{folder}/{shard:06d}.lost", lost[of_big])
        left, right = [], []
        for d in range(1, SMALL):  # all twos of small keys, by distance
            at = np.flatnonzero((key[:-d] == key[d:]) & ~of_big[d:]) if d < len(key) else np.zeros(0, np.int64)
            if not len(at):
                break
            at = at[fits(n[at], lost[at], n[at + d], lost[at + d], percent)]
            left.append(sid[at])
            right.append(sid[at + d])
        first = np.repeat(a, z - a)
        star = np.flatnonzero(of_big & (first != np.arange(len(key))))
        star = star[fits(n[star], lost[star], n[first[star]], lost[first[star]], percent)]
        x, y = np.concatenate([*left, sid[first[star]]]), np.concatenate([*right, sid[star]])
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0) if len(x) else np.zeros((0, 2), np.uint64)
        x, y = pairs[:, 0], pairs[:, 1]
        rows = list(dealt(x ^ (y * _PAIR), [x, y], shards))
        need = np.unique(sid[of_big])
        rows += [r | {"shard": r["shard"] + shards, "c1": b""} for r in dealt(need, [need], shards)]
        return pa.Table.from_batches([as_batch(rows, 2)])

    return entries.groupBy("shard").applyInArrow(run, block_schema(2))


def save_store(folder: str, k: int, s: np.ndarray, n: np.ndarray, values: np.ndarray) -> None:
    """A shard of a Store: the values of each distinct id."""
    once, at = np.unique(s, return_index=True)
    core.put_file(f"{folder}/{k:06d}.hash", once)
    core.put_file(f"{folder}/{k:06d}.end", np.cumsum(n[at]))
    core.put_file(f"{folder}/{k:06d}.ids", values[tokens.ragged((np.cumsum(n) - n)[at], n[at])])


def sieved(pairs: DataFrame, sketches: str, shards: int, percent: int) -> DataFrame:
    """The pairs that sketches allow, each once, and from shard `shards` on the set ids that they need."""

    def run(group):
        pairs = np.unique(np.stack([joined(group, 0), joined(group, 1)], axis=1), axis=0)
        store, keep, last, own = tokens.opened_store(sketches, shards, np.uint8), np.zeros(len(pairs), bool), None, None
        for i, (x, y) in enumerate(pairs):
            if x != last:
                last, own = x, np.array(one_set(store, x))
            keep[i] = may_link(own, one_set(store, y), percent)
        x, y = pairs[keep, 0], pairs[keep, 1]
        need = np.unique(pairs[keep])
        rows = [{"shard": group.column("shard")[0].as_py(), "c0": x.tobytes(), "c1": y.tobytes()}] + [r | {"shard": r["shard"] + shards, "c1": b""} for r in dealt(need, [need], shards)]
        return pa.Table.from_batches([as_batch(rows, 2)])

    return pairs.groupBy("shard").applyInArrow(run, block_schema(2))


def write_sets(docs: DataFrame, needed: DataFrame, shards: int, words: int) -> str:
    """The sets that candidates need, as a Store by set id."""
    spark = docs.sparkSession
    wanted, folder = core.shared_folder(spark, "wanted"), core.shared_folder(spark, "sets")

    def list_ids(group):
        k = group.column("shard")[0].as_py() - shards
        core.put_file(f"{wanted}/{k:06d}", np.unique(joined(group, 0)))
        return pa.table({"shard": pa.array([k], pa.int32())})

    needed.groupBy("shard").applyInArrow(list_ids, "shard int").count()

    def run(batches):
        seen, parts, size = set(), [], 0

        def has(s: int) -> bool:
            held = sorted_file(f"{wanted}/{int(tokens.shard_of(core.mix64(np.array([s], np.uint64)), shards)[0]):06d}")
            at = int(np.searchsorted(held, np.uint64(s)))
            return at < len(held) and int(held[at]) == s

        def flush():
            by: dict[int, list] = {}
            for s, u in parts:
                by.setdefault(int(tokens.shard_of(np.array([s], np.uint64), shards)[0]), []).append((s, u))
            return as_batch([{"shard": k, "c0": np.array([s for s, _ in v], np.uint64).tobytes(), "c1": np.array([len(u) for _, u in v], np.uint32).tobytes(), "c2": b"".join(u.tobytes() for _, u in v)} for k, v in by.items()], 3)

        for b in batches:
            for u in sets(b.column(0), words):
                if len(u) and (s := set_id(u)) not in seen and has(s):
                    seen.add(s)
                    parts.append((s, u))
                    size += len(u)
                    if size >= FLUSH:
                        yield flush()
                        parts, size = [], 0
        if parts:
            yield flush()

    def save(group):
        k = group.column("shard")[0].as_py()
        save_store(folder, k, joined(group, 0), joined(group, 1, "<u4").astype(np.int64), joined(group, 2))
        return pa.table({"shard": pa.array([k], pa.int32())})

    docs.select("t").mapInArrow(run, block_schema(3)).groupBy("shard").applyInArrow(save, "shard int").count()
    return folder


def one_set(store: tokens.Store, s) -> np.ndarray:
    hashes, ends, ids = store.shard(int(tokens.shard_of(np.array([s], np.uint64), store.shards)[0]))
    at = int(np.searchsorted(hashes, s))
    return ids[int(ends[at - 1]) if at else 0 : int(ends[at])]


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    if len(x) < len(y):
        x, y = y, x
    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def as_edges(x, y) -> pa.Table:
    return pa.table({"a": pa.array(np.array(x, np.uint64).view(np.int64)), "b": pa.array(np.array(y, np.uint64).view(np.int64))})


def verified(pairs: DataFrame, folder: str, shards: int, percent: int) -> DataFrame:
    """Linked pairs (a, b) among blocks of candidate pairs."""

    def run(group):
        pairs = np.unique(np.stack([joined(group, 0), joined(group, 1)], axis=1), axis=0)
        store, out, last, own = tokens.opened_store(folder, shards, "<u8"), [], None, None
        for x, y in pairs:
            if x != last:
                last, own = x, np.array(one_set(store, x))
            if linked(own, one_set(store, y), percent):
                out.append((x, y))
        return as_edges([x for x, _ in out], [y for _, y in out])

    return pairs.groupBy("shard").applyInArrow(run, "a bigint, b bigint")


def write_labels(labels: DataFrame, shards: int) -> str:
    """(node, root) as sorted files by set id."""
    folder = core.shared_folder(labels.sparkSession, "labels")
    blocks = 1 << 16

    def pack(batches):
        for b in batches:
            for a in range(0, b.num_rows, blocks):
                s, r = (np.asarray(b.column(i).slice(a, blocks)).view(np.uint64) for i in (0, 1))
                yield as_batch(list(dealt(s, [s, r], shards)), 2)

    def save(group):
        s, r = joined(group, 0), joined(group, 1)
        order = np.argsort(s)
        k = group.column("shard")[0].as_py()
        core.put_file(f"{folder}/{k:06d}.sid", s[order])
        core.put_file(f"{folder}/{k:06d}.root", r[order])
        return pa.table({"shard": pa.array([k], pa.int32())})

    labels.select("node", "root").mapInArrow(pack, block_schema(2)).groupBy("shard").applyInArrow(save, "shard int").count()
    return folder


def roots(s: np.ndarray, labels: str, shards: int) -> np.ndarray:
    """The component of each set id."""
    u, back = np.unique(s, return_inverse=True)  # a set has many keys
    out, k = u.copy(), tokens.shard_of(core.mix64(u), shards)
    order = np.argsort(k, kind="stable")
    cut = np.searchsorted(k[order], np.arange(shards + 1, dtype=np.uint64))
    for x in np.flatnonzero(np.diff(cut)):
        ids, root = (sorted_file(f"{labels}/{x:06d}.{e}") for e in ("sid", "root"))
        if len(ids):
            mine = order[cut[x] : cut[x + 1]]
            at = np.minimum(np.searchsorted(ids, u[mine]), len(ids) - 1)
            hit = ids[at] == u[mine]
            out[mine[hit]] = root[at[hit]]
    return out[back]


def may_ask(n: np.ndarray, lost: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which sets of a key some set of it, itself included, fits."""
    most = (100 + percent) * (n - lost) // percent - n  # a set of more tokens is too large for it
    order = np.argsort(n, kind="stable")
    reach = np.concatenate([[-1], np.maximum.accumulate(most[order])])
    return reach[np.searchsorted(n[order], most, side="right")] >= n


def still_apart(spark: SparkSession, lists: str, sets_at: str, labels: str, shards: int, percent: int) -> DataFrame:
    """Links between different components among the sets of each large key.

    What the largest component of a key has apart from it asks those of the key that it fits. A shard's asking sets are
    dealt into parts of about ASKING, each a row of its own that any task can take, and a task holds
    ANSWERING whole sets at a time.
    """

    def keys_of(shard: int):
        """(sets, their sizes and tokens not shared, components by number, what asks) of the shard's large keys with several components."""
        key, sid = (sorted_file(f"{lists}/{shard:06d}.{e}") for e in ("key", "sid"))
        root = roots(np.array(sid), labels, shards)
        for i, j in zip(*groups(key), strict=True):
            s = np.array(sid[i:j])
            place, counts = np.unique(root[i:j], return_inverse=True, return_counts=True)[1:]
            if len(counts) > 1:
                n, lost = (np.array(core.map_file(f"{lists}/{shard:06d}.{e}", "<i8")[i:j]) for e in ("n", "lost"))
                asking = np.flatnonzero((place != int(counts.argmax())) & may_ask(n, lost, percent))
                if len(asking):
                    yield s, n, lost, place, asking

    def part_of(s: np.ndarray, parts: int) -> np.ndarray:
        return core.mix64(s ^ _PAIR) % np.uint64(parts)

    def listed(batches):
        for b in batches:
            for shard in b.column(0).to_pylist():
                asking = np.unique(np.concatenate([np.zeros(0, np.uint64), *(s[x] for s, *_, x in keys_of(shard))]))
                parts = -(-len(asking) // ASKING)
                if parts:
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([shard] * parts, pa.int64()), "part": pa.array(range(parts), pa.int64()), "parts": pa.array([parts] * parts, pa.int64())})

    def compared(batches):
        for b in batches:
            for shard, part, parts in zip(*(b.column(c).to_pylist() for c in ("shard", "part", "parts")), strict=True):
                store, tested, found = tokens.opened_store(sets_at, shards, "<u8"), {}, []
                for s, n, lost, place, asking in keys_of(shard):
                    asked, own, met = {}, {}, {}
                    for x in asking[part_of(s[asking], parts) == part]:
                        to = np.flatnonzero((place != place[x]) & fits(n, lost, n[x], lost[x], percent))
                        done = tested.get(int(s[x]))
                        if done is not None and len(to):
                            to = to[~np.isin(s[to], done)]
                        if len(to):
                            asked[x] = to
                            tested[int(s[x])] = s[to] if done is None else np.union1d(done, s[to])
                            own[x], met[x] = np.array(one_set(store, s[x])), np.zeros(int(place.max()) + 1, bool)
                    if not asked:
                        continue
                    answer = np.unique(np.concatenate(list(asked.values())))
                    for low in range(0, len(answer), ANSWERING):
                        some = answer[low : low + ANSWERING]
                        whole = [np.array(one_set(store, v)) for v in s[some]]
                        size, near = n[some], place[some]
                        values, code = np.unique(np.concatenate(whole), return_inverse=True)
                        starts, mark = np.cumsum(size) - size, np.zeros(len(values) + 1, np.int64)
                        for x, to in asked.items():
                            mine = np.flatnonzero(np.isin(some, to) & ~met[x][near])
                            if not len(mine):
                                continue
                            at = np.searchsorted(values, own[x])
                            at = np.where(values[np.minimum(at, len(values) - 1)] == own[x], at, len(values))
                            mark[at] = 1
                            mark[-1] = 0
                            of = code[tokens.ragged(starts[mine], size[mine])]
                            both = np.add.reduceat(mark[of], np.cumsum(size[mine]) - size[mine])
                            mark[at] = 0
                            hit = mine[100 * both >= percent * (size[mine] + len(own[x]) - both)]
                            if len(hit):  # one link to each component that it touches
                                places, one = np.unique(near[hit], return_index=True)
                                met[x][places] = True
                                found += [(s[x], s[some[y]]) for y in hit[one]]
                yield from as_edges([x for x, _ in found], [y for _, y in found]).to_batches()

    parts = core.materialise(spark.range(0, shards, 1, shards).mapInArrow(listed, "shard bigint, part bigint, parts bigint"), "apart")
    return parts.repartition(shards, F.xxhash64("shard", "part")).mapInArrow(compared, "a bigint, b bigint")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles, component_id for every row of docs; k words a shingle, links from `percent` on, 80 at least."""
    if not 80 <= percent <= 100:
        raise ValueError("index keys meet only from 80 percent on")
    spark = docs.sparkSession
    core.ship(spark)
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"))
    shards = core.shards_for(rows)
    facts_at, lists = core.shared_folder(spark, "facts"), core.shared_folder(spark, "lists")
    classes = frequent_tokens(rows, shards, k)
    entries = index_entries(rows, classes, shards, facts_at, k, percent)
    sketches = core.shared_folder(spark, "sketches")
    found = core.materialise(candidates(entries, lists, sketches, shards, percent), "candidates")
    left = core.materialise(sieved(found.filter(F.col("shard") < shards), sketches, shards, percent), "sieved")
    need = left.filter(F.col("shard") >= shards).unionByName(found.filter(F.col("shard") >= shards)).select("shard", "c0")
    sets_at = write_sets(rows, need, shards, k)
    first = core.materialise(verified(left.filter(F.col("shard") < shards), sets_at, shards, percent), "links")
    for used in (found, left):
        core.drop_table(used)
    stars = cc.components(first)
    labels = write_labels(stars, shards)
    more = core.materialise(still_apart(spark, lists, sets_at, labels, shards, percent), "links")
    if more.limit(1).count():
        stars = cc.components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    facts = core.materialise(read_facts(spark, facts_at), "facts")
    for used in (lists, sets_at, sketches, labels, classes, facts_at):
        core.drop_folder(used)
    own = facts.filter("n > 0").groupBy("sid").agg(F.min("id").alias("low")).join(stars.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    lowest = own.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = own.join(lowest, "root").select("sid", "component_id")
    alone = facts.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    out = facts.filter("n > 0").join(classes, "sid").select("id", "n", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key `gone` doesn't hold; rows without a key stay. Texts stay where they are: workers look keys up in sorted files."""
    spark = docs.sparkSession
    core.ship(spark)
    folder, shards = core.shared_folder(spark, "gone"), core.shards_for(docs)

    def split(batches):
        for b in batches:
            ids = np.unique(np.asarray(b.column(0).drop_null()).astype("<i8")).view("<u8")
            yield as_batch(list(dealt(ids, [ids], shards)), 1)

    def save(group):
        k = group.column("shard")[0].as_py()
        h = np.unique(core.mix64(joined(group, 0)))
        core.put_file(f"{folder}/{k:06d}", h)
        return pa.table({"shard": pa.array([k], pa.int32())})

    gone.select(F.col(key).cast("bigint")).mapInArrow(split, block_schema(1)).groupBy("shard").applyInArrow(save, "shard int").count()
    at = docs.columns.index(key)

    def keep(batches):
        known = Classes(folder, shards)
        for b in batches:
            ids = b.column(at).cast(pa.int64())
            h = core.mix64(np.asarray(ids.fill_null(0)).astype("<i8").view("<u8"))
            u, back = np.unique(h, return_inverse=True)
            yield b.filter(pa.array(~known.has(u)[back] | np.asarray(ids.is_null())))

    return docs.mapInArrow(keep, docs.schema)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(core.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; documents without words stay, and rows without an id."""
    found = core.materialise(join(docs, k=STAGE_K, percent=STAGE_PERCENT), "groups")
    kept = without(docs, found.filter((F.col("n_shingles") > 0) & (F.col("doc_id") != F.col("component_id"))).select("doc_id"))
    ids = found.agg(F.count("doc_id"), F.countDistinct("doc_id")).first()
    return kept if ids[0] == ids[1] else kept.dropDuplicates(["doc_id", "text"])  # a repeated row is a copy too


QUERIES = {"op10_ngram_jaccard": op10_ngram_jaccard}

# Copies first become one class, and classes meet on shared shingles; components by what a class reaches.
ORACLE = {
    "op10_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT rowid_ AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM (SELECT row_number() OVER () AS rowid_, doc_id, text FROM documents)),
g AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w),
k AS (SELECT s, min(doc_id) AS low, row_number() OVER (ORDER BY min(doc_id)) AS c, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM g WHERE len(s) > 0) GROUP BY s),
t AS (SELECT c, n, unnest(s) AS x FROM k),
l AS (SELECT a.c AS a, b.c AS b FROM t a JOIN t b ON a.x = b.x AND a.c < b.c GROUP BY a.c, a.n, b.c, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
m AS (SELECT c AS a, c AS b FROM k UNION SELECT m.a, e.b FROM m JOIN e ON m.b = e.a),
o AS (SELECT a, min(low) AS component_id FROM m JOIN k ON k.c = m.b GROUP BY a)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, coalesce(o.component_id, g.doc_id) AS component_id FROM g LEFT JOIN k ON k.s = list_sort(g.s) LEFT JOIN o ON o.a = k.c"""
}

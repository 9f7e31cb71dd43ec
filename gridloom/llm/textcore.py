"""Shared pieces: word hashing over Arrow buffers, shared-folder files, sampling.

Words are maximal runs of bytes other than space and \\x09-\\x0D, with A-Z in
lower case. A word's hash is a polynomial over its bytes modulo 2**64, read off
a prefix sum over the whole block, then mixed; no Python object is made per
word. Two different words of a corpus share a 64-bit hash with negligible odds.
"""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship  # noqa: F401

BLOCK_BYTES, SPANS_BYTES = 2 << 20, 1 << 16

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}
#: What ends a word where only letters, digits and non-ASCII bytes count.
PLAIN = np.ones(256, bool)
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Bytes of files that a process keeps in memory where they can't be mapped, and files that it keeps open.
KEPT_BYTES, KEPT_FILES = 256 << 20, 4096
_settled: list[bool] = []
_files: OrderedDict[tuple, np.ndarray | None] = OrderedDict()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def order_of(x: np.ndarray) -> np.ndarray:
    """The stable order of 64-bit values that aren't negative: they are sorted with their places in the low bits, much faster than an argsort. Where both don't fit,
    high bits are, and groups that these don't tell apart are put in order."""
    x, n = np.asarray(x).view(np.uint64), len(x)
    bits = n.bit_length()
    spare, place, low = int(x.max()).bit_length() + bits <= 64 if n else True, np.arange(n, dtype=np.uint64), np.uint64((1 << bits) - 1)
    packed = np.sort(((x << np.uint64(bits)) if spare else (x & ~low)) | place)
    order = (packed & low).astype(np.int64)
    if not spare:
        own, high = x[order], packed >> np.uint64(bits)
        wrong = np.flatnonzero(own[1:] < own[:-1])
        if len(wrong):
            group = np.cumsum(np.concatenate([[0], high[1:] != high[:-1]]))
            bad = np.flatnonzero(np.isin(group, group[wrong]))
            order[bad] = order[bad][np.lexsort((order[bad], own[bad]))]
    return order


def numbered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and of each value its place among them: by a hash table, and only distinct values are sorted."""
    coded = pa.array(h).dictionary_encode()
    u = coded.dictionary.to_numpy()
    order = order_of(u)
    rank = np.empty(len(u), np.int64)
    rank[order] = np.arange(len(u))
    return u[order], rank[coded.indices.to_numpy()]


def one_of_each(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and where one of each stands, any of equal ones."""
    order = order_of(h)
    own = h[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(h) else order
    return own[first], order[first]


def by_row(row: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The stable order by row, then by a 32-bit code: values are sorted with their places, rows by 16 bits at a time, both much faster than a stable sort of 64 bits."""
    order = (np.sort((code.astype(np.uint64) << np.uint64(32)) | np.arange(len(code), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    for shift in range(0, int(row.max()).bit_length() if len(row) else 0, 16):
        order = order[np.argsort(((row >> shift) & 0xFFFF).astype(np.uint16)[order], kind="stable")]
    return order


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def blocks(off: np.ndarray, most: int = BLOCK_BYTES):
    """Row ranges [a, b) of at most `most` bytes; a longer row stands alone."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_bounds(data: np.ndarray, off: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of words in data, and per row the index of its first word (n + 1 values)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space = np.frombuffer(data.tobytes().translate(between.tobytes()), bool)  # faster than between[data]
    turns = np.flatnonzero(space[1:] != space[:-1]) + 1
    edges = np.unique(off[(off > 0) & (off < n)])
    edges = np.repeat(edges[~(space[edges] | space[edges - 1])], 2)  # a row's last word meets the next row's first
    turns = np.insert(turns, np.searchsorted(turns, edges), edges)
    turns = np.concatenate([[] if space[0] else [0], turns, [] if space[-1] else [n]]).astype(np.int64)
    starts, ends = turns[::2].copy(), turns[1::2].copy()
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """Hashes of the spans of a block, in order of their starts, with A-Z in `lower` case; a stretch of SPANS_BYTES at a time, so that its sums stay in cache."""
    case = _LOWER.tobytes()
    out, cut = np.empty(len(starts), np.uint64), np.searchsorted(starts, np.arange(0, len(data) + SPANS_BYTES, SPANS_BYTES))
    for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if a < z:
            low = starts[a]
            own = data[low : ends[a:z].max()]
            up, down = powers(len(own))
            codes = (np.frombuffer(own.tobytes().translate(case), np.uint8) if lower else own).astype(np.uint64)
            codes += np.uint64(1)
            codes *= up
            sums = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(codes, out=sums[1:])
            s = starts[a:z] - low
            out[a:z] = mix64((sums[ends[a:z] - low] - sums[s]) * down[s])
    return out


def word_hashes(data: np.ndarray, off: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of a block, and per row the index of its first word (rows + 1 values)."""
    starts, ends, first = word_bounds(data, off, between)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    return span_hashes(data, starts, ends), first


def word_hash(word: bytes) -> int:
    return int(word_hashes(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0][0])


def plain_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes without punctuation, letters of Latin-1 in lower case too."""
    upper = np.flatnonzero(data[:-1] == 0xC3) + 1
    upper = upper[(data[upper] >= 0x80) & (data[upper] <= 0x9E) & (data[upper] != 0x97)]
    if len(upper):
        data = data.copy()
        data[upper] += 0x20
    return word_hashes(data, off, PLAIN)


def hashed_rows(column, most: int = BLOCK_BYTES, hashes=word_hashes):
    """Blocks (row a, row b, hashes, first) of a string column."""
    data, off = string_buffers(column)
    for a, b in blocks(off, most):
        h, first = hashes(data[off[a] : off[b]], off[a : b + 1] - off[a])
        yield a, b, h, first


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of one row, in order; a shorter row is one window, an empty one none."""
    n = len(h)
    if not n:
        return h
    with np.errstate(over="ignore"):
        if n < k:
            total = np.uint64(n)
            for x in h:
                total = total * np.uint64(_BASE) + x
            return mix64(np.array([total], np.uint64))
        total = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            total = total * np.uint64(_BASE) + h[j : n - k + 1 + j]
    return mix64(total)


def planes(x: np.ndarray) -> bytes:
    """A column's bytes by significance: high bytes, mostly zeros, compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def unplanes(b: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def settle() -> None:
    """Leaves what a worker has loaded by its first task out of garbage collection: PySpark collects in full after each task, and walks all modules for it."""
    if not _settled:
        gc.freeze()
        _settled.append(True)  # asking for the count would walk them all again


_trim, _option = (getattr(ctypes.CDLL(None), x, lambda *a: 0) for x in ("malloc_trim", "mallopt"))  # of glibc
_reused: list[bool] = []


def reuse() -> None:
    """From now on a worker's freed memory stays with it until the end of the task (see give_back): blocks' arrays of a few MB would be mapped and
    cleared by the system each time, which takes as long as sorting them."""
    if not _reused:
        _option(-3, 32 << 20)  # M_MMAP_THRESHOLD, at its largest
        _option(-1, 64 << 20)  # M_TRIM_THRESHOLD
        _reused.append(True)


def give_back(phase: str, info: dict) -> None:
    """After a full collection, as PySpark's workers make after each task, freed memory goes back to the system: idle workers would keep what their largest task took."""
    if phase == "stop" and info["generation"] == 2:
        pa.default_memory_pool().release_unused()
        _trim(0)


gc.callbacks.append(give_back)


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; set here only where the session has none."""
    sc = spark.sparkContext
    if (found := sc._jsc.sc().getCheckpointDir()).isDefined():
        return found.get()
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"/tmp/checkpoints/{os.getpid()}"
    sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a URI (file, hdfs, s3, ...), and the path there."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _from_uri(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return opened(uri)


def put_file(uri: str, *parts) -> None:
    """Writes parts (buffers) under another name, then renames, so a retried task can't leave half a file."""
    fs, path = _from_uri(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        for x in parts:
            out.write(memoryview(x).cast("B") if memoryview(x).nbytes else b"")
    fs.move(draft, path)


class Draft:
    """A file that is written piece by piece and appears under its name, whole, when it is done."""

    def __init__(self, uri: str):
        self.fs, self.path = _from_uri(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.draft = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.draft)

    def write(self, x: np.ndarray) -> None:
        if x.nbytes:
            self.out.write(memoryview(np.ascontiguousarray(x)).cast("B"))

    def done(self) -> None:
        self.out.close()
        self.fs.move(self.draft, self.path)


def map_file(uri: str, dtype) -> np.ndarray:
    """A file as an array: memory-mapped where the folder is mounted, else read from its store.

    The last used files stay open, KEPT_FILES of them, and of those in memory KEPT_BYTES.
    """
    key = uri, np.dtype(dtype).str if np.dtype(dtype).names is None else str(dtype)
    if key in _files:
        _files.move_to_end(key)
        return _files[key]
    fs, path = _from_uri(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        found = np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    else:
        with fs.open_input_file(path) as f:
            found = np.frombuffer(f.read(), dtype)
    _files[key] = found
    size = sum(x.nbytes for x in _files.values() if not isinstance(x, np.memmap))
    while len(_files) > 1 and (len(_files) > KEPT_FILES or size > KEPT_BYTES):
        old = _files.popitem(last=False)[1]
        size -= 0 if isinstance(old, np.memmap) else old.nbytes
    return found


def drop_file(uri: str) -> None:
    fs, path = _from_uri(uri)
    fs.delete_file(path)


def drop_folder(uri: str) -> None:
    fs, path = _from_uri(uri)
    try:
        fs.delete_dir(path)
    except FileNotFoundError:
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    where = shared_folder(spark, name)
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def drop_table(df: DataFrame) -> None:
    """Deletes what materialise wrote."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_folder(folder)


#: Bytes of input, as stored, for a shard of an index or store.
SHARD_BYTES = 32 << 20


def shards_for(df: DataFrame) -> int:
    """Shards of what is made from df: one for SHARD_BYTES that Catalyst expects it to read, and as many as shuffles have at least."""
    spark = df.sparkSession
    least = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, -(-size // SHARD_BYTES)) if size < 1 << 60 else least  # beyond, the size isn't known


def crc_mod(column: str, n: int):
    """crc32 of the id's decimal text, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n))


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About `rows` rows, picked by a hash of the key: the same ones on every run."""
    n = df.count()
    if n <= rows:
        return df
    span = 1 << 40
    return df.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(span)) < int(span * rows / n))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Token-ID files: flat unsigned integers plus 64-bit document offsets.

Each partition of the documents, ranged by key, writes three files: `.bin` (ids,
16 bits where the vocabulary fits, else 32), `.off` (int64, where each document
starts in the partition, and the end) and `.key` (int64). The driver keeps one
count a partition; their prefix sums are the partitions' bases, so a document's
global start is its partition's base plus its offset. Readers map the files.

Defined cases: a null text counts as empty and holds the end id alone. Repeated
keys each get their own range, in the order of a hash of their text. An empty table makes no files
and no rows. A null key sorts first and is stored as the smallest int64. Other
columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as core
from . import tokens

NULL_KEY = -(1 << 63)


@dataclass(frozen=True)
class TokenFiles:
    folder: str
    bases: tuple[tuple[int, int], ...]  # (partition, ids of all partitions before it)
    dtype: str


def write(docs: DataFrame, path: str, kind: str, end_id: int, key: str = "doc_id", text: str = "text") -> TokenFiles:
    """Encodes every whole text and writes the files in ascending key order."""
    spark = docs.sparkSession
    core.ship(spark)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    store, shards = tokens.build_store(rows, "t", tokens.encoder(path), kind)
    folder = core.shared_folder(spark, "tokens")
    dtype = tokens.id_type(path)

    def save(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        opened = tokens.opened_store(store, shards, dtype)
        files, total = None, 0
        for b in batches:
            k = np.asarray(b.column(0).cast(pa.int64()).fill_null(NULL_KEY))
            for i, j, ids, stop in tokens.encoded(b.column(1), opened, kind):
                if files is None:
                    files = [core.Draft(f"{folder}/{part:06d}.{x}") for x in ("bin", "off", "key")]
                    files[1].write(np.zeros(1, "<i8"))
                with_end = np.insert(ids, stop, np.array(end_id, dtype))
                ends = total + stop + np.arange(1, j - i + 1)
                for f, x in zip(files, (with_end, ends.astype("<i8"), k[i:j].astype("<i8")), strict=True):
                    f.write(x)  # a block at a time: a task holds no partition
                total += len(with_end)
        if files:
            for f in files:
                f.done()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([total], pa.int64())})

    n = core.shards_for(rows)
    ordered = rows.repartitionByRange(n, "k").sortWithinPartitions("k", F.xxhash64("t"))
    counts = sorted((r["part"], r["n"]) for r in ordered.mapInArrow(save, "part int, n bigint").collect())
    core.drop_folder(store)
    bases = np.cumsum([0, *(c for _, c in counts)]).tolist()
    return TokenFiles(folder, tuple((p, base) for (p, _), base in zip(counts, bases, strict=False)), dtype.str)


def partition_arrays(files: TokenFiles, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, offsets, keys of one partition, memory-mapped."""
    return tuple(core.map_file(f"{files.folder}/{part:06d}.{x}", d) for x, d in (("bin", files.dtype), ("off", "<i8"), ("key", "<i8")))


def read(spark: SparkSession, files: TokenFiles, key: str = "doc_id", ids: bool = False) -> DataFrame:
    """key, start, n_tokens, ids_crc32 of every document, from the files; its ids too if asked for."""
    core.ship(spark)

    def load(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                part, base = files.bases[i]
                flat, off, keys = partition_arrays(files, part)
                for a in range(0, len(keys), 4096):
                    z = min(a + 4096, len(keys))
                    each = [flat[off[x] : off[x + 1]] for x in range(a, z)]
                    columns = {
                        key: pa.array([None if x == NULL_KEY else int(x) for x in keys[a:z]], pa.int64()),
                        "start": pa.array(base + off[a:z], pa.int64()),
                        "n_tokens": pa.array(np.diff(off[a : z + 1]), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64()),
                    }
                    if ids:
                        columns["ids"] = pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(columns)

    n = len(files.bases)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(load, f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * ids)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write(core.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), "words", 2)
    return read(spark, files)


QUERIES = {"op9_token_files": op9_token_files}

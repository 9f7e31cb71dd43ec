"""Merkle fixity audit of WARC replicas.

A manifest lists a replica's records with byte offset, length and leaf hash.
Offsets are prefix sums of lengths in record order: each partition of the ordered
records sums its own, the driver sums one number a partition. Leaves whose records
start in the same RANGE bytes form a node, every FANOUT nodes the next one, up to
one root. An audit compares roots and follows only branches that differ, down to
the records.

Every replica has offsets of its own. Ranges are those of the first replica: a record of the other lies where the first one has
its key, or else the last key before it. So a record that was lost, grew or came in leaves
all other nodes comparable. A node holds at most RANGE / 64 leaves of the first replica or FANOUT nodes, as
a record's header alone has over 64 bytes; what only the other one has between two records joins their node.

Defined cases: a null body is an empty one, a null URI an empty one. Records are
ordered by key (null first), then leaf; records of one key are compared in that order. Two empty replicas
have no root and differ nowhere; one empty replica lacks every record. Only the named columns are read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as core

RANGE, FANOUT = 1 << 16, 16


def record(key: Column, uri: Column, body: Column) -> Column:
    """A WARC response record's bytes."""
    body = F.encode(F.coalesce(body, F.lit("")), "UTF-8")
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def leaf(data: Column) -> Column:
    return F.sha2(F.concat(F.encode(F.lit("leaf:"), "UTF-8"), data), 256)


def manifest(hashed: DataFrame) -> DataFrame:
    """hashed (key, length, leaf, ...) with `offset`, in the order of key, then leaf."""
    spark = hashed.sparkSession
    core.ship(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = hashed.columns

    def run(batches):
        from pyspark import TaskContext

        import numpy as np

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            length = np.asarray(b.column(names.index("length")))
            ends = at + np.cumsum(length)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - length, pa.int64()), pa.array(np.full(len(length), part), pa.int32())], names=[*names, "local", "part"])
            at = int(ends[-1]) if len(ends) else at

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hashed.schema)
    narrow = core.materialise(hashed, "leaves")
    placed = core.materialise(narrow.repartitionByRange(n, "key", "leaf").sortWithinPartitions("key", "leaf").mapInArrow(run, f"{shape}, local bigint, part int"), "manifest")
    return with_bases(placed, "local", {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.sum("length").alias("n")).collect()}, "offset")


def with_bases(placed: DataFrame, local: str, sizes: dict, name: str) -> DataFrame:
    """placed (part, local, ...) with local plus what all parts before hold; a row a part is broadcast."""
    bases, at = [], 0
    for p in sorted(sizes):
        bases.append((p, at))
        at += sizes[p] or 0
    known = placed.sparkSession.createDataFrame(bases, "part int, base bigint")
    return placed.join(F.broadcast(known), "part").withColumn(name, F.col(local) + F.col("base")).drop(local, "base", "part")


def node_hash(children: Column) -> Column:
    return F.sha2(F.encode(F.concat(F.lit("node:"), F.array_join(F.transform(F.array_sort(children), lambda c: F.concat_ws(":", c["at"].cast("string"), c["hash"])), ",")), "UTF-8"), 256)


def tree(leaves: DataFrame) -> list[DataFrame]:
    """Levels (replica, node, hash) from ranges up to the roots; leaves: (replica, offset, leaf)."""
    last = leaves.agg(F.max("offset")).first()[0]
    if last is None:
        return []
    level = leaves.select("replica", F.floor(F.col("offset") / RANGE).alias("node"), F.struct(F.col("offset").alias("at"), F.col("leaf").alias("hash")).alias("c"))
    levels, width = [], last // RANGE + 1
    while True:
        levels.append(core.materialise(level.groupBy("replica", "node").agg(node_hash(F.collect_list("c")).alias("hash")), "nodes"))
        if width == 1:
            return levels
        width = -(-width // FANOUT)
        level = levels[-1].select("replica", F.floor(F.col("node") / FANOUT).alias("node"), F.struct(F.col("node").alias("at"), "hash").alias("c"))


def differing(nodes: DataFrame, by: str, value: str) -> DataFrame:
    """Rows (by, a, b) whose value differs between replicas a and b, or that one of them lacks."""
    sides = [F.max(F.when(F.col("replica") == r, F.col(value))).alias(r) for r in ("a", "b")]
    return nodes.groupBy(by).agg(*sides).filter(~F.col("a").eqNullSafe(F.col("b")))


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records of both replicas (replica, key, nth, offset, own, length, leaf): `offset` by the first one's order, `own` their own; nth of their key."""
    spark = a.sparkSession
    sides = [df.select(F.lit(r).alias("replica"), "key", F.col("offset").alias("own"), "length", "leaf") for r, df in (("a", a), ("b", b))]
    both = sides[0].unionByName(sides[1])
    key = both.schema["key"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        import numpy as np

        part, last, held, nth = TaskContext.get().partitionId(), -1, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            replica, own = np.asarray(batch.column(0).to_pylist()), np.asarray(batch.column(2))
            names = list(zip(batch.column(1).to_pylist(), replica.tolist(), strict=True))
            order = np.zeros(len(own), np.int64)
            for i, x in enumerate(names):
                nth = nth + 1 if x == held else 0
                held, order[i] = x, nth
            first = np.maximum.accumulate(np.where(replica == "a", np.arange(len(own)), -1))
            offset = np.where(first >= 0, own[np.maximum(first, 0)], last)
            last = int(offset[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(order), pa.array(offset), pa.array(np.full(len(own), part), pa.int32())], names=["replica", "key", "own", "length", "leaf", "nth", "local", "part"])

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shape = f"replica string, key {key}, own bigint, length bigint, leaf string, nth bigint, local bigint, part int"
    placed = core.materialise(both.repartitionByRange(n, "key").sortWithinPartitions("key", "replica", "leaf").mapInArrow(run, shape), "aligned")
    ends = {r["part"]: r["m"] for r in placed.groupBy("part").agg(F.max("local").alias("m")).collect()}
    carry, before = [], 0
    for p in sorted(ends):  # a row a part: where the parts before it end
        carry.append((p, before))
        before = max(before, ends[p])
    known = spark.createDataFrame(carry, "part int, base bigint")
    return placed.join(F.broadcast(known), "part").withColumn("offset", F.when(F.col("local") < 0, F.col("base")).otherwise(F.col("local"))).drop("local", "base", "part")


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Corrupt records: key, rec_offset, rec_length, range_id, status, leaf_a, leaf_b.

    a and b are manifests (key, offset, length, leaf), each by its own offsets. status: changed, missing (in b), extra (in b);
    offset and length are a's, for extra records b's.
    """
    both = aligned(a, b)
    levels = tree(both)
    bad = None
    for nodes in reversed(levels):  # roots first; a level's candidates are the children of what differs above
        if bad is not None:
            nodes = nodes.join(bad.select(F.col("node").alias("up")), F.floor(nodes["node"] / FANOUT) == F.col("up"), "left_semi")
        bad = core.materialise(differing(nodes, "node", "hash").select("node"), "differing")
    low = both.withColumn("range_id", F.floor(F.col("offset") / RANGE))
    if bad is not None:
        low = low.join(bad.select(F.col("node").alias("range_id")), "range_id", "left_semi")
    side = lambda r, c: F.max(F.when(F.col("replica") == r, F.col(c)))
    first = lambda c: F.coalesce(side("a", c), side("b", c))
    rows = low.groupBy("key", "nth").agg(first("own").alias("rec_offset"), first("length").alias("rec_length"), first("range_id").alias("range_id"), side("a", "leaf").alias("leaf_a"), side("b", "leaf").alias("leaf_b"))
    status = F.when(F.col("leaf_a").isNull(), "extra").when(F.col("leaf_b").isNull(), "missing").otherwise("changed")
    return rows.filter(~F.col("leaf_a").eqNullSafe(F.col("leaf_b"))).select("key", "rec_offset", "rec_length", "range_id", status.alias("status"), "leaf_a", "leaf_b")


def op1_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC records against a replica of which every 101st record grew, every 211th is lost, and to which every 307th was added again under another key."""
    pages, key = core.table(spark, sf_dir, "pages"), F.col("page_id")
    made = lambda k, body: record(k, F.col("url"), body)
    facts = lambda n, data: [F.octet_length(data).cast("bigint").alias(f"length_{n}"), leaf(data).alias(f"leaf_{n}")]
    other = -key - 1
    hurt = F.concat(F.lit("#"), F.coalesce("html", F.lit("")))
    own = core.materialise(pages.select(key.alias("key"), other.alias("other"), *facts("own", made(key, F.col("html"))), *facts("hurt", made(key, hurt)), *facts("more", made(other, F.col("html")))), "records")
    side = lambda df, k, n: df.select(F.col(k).alias("key"), F.col(f"length_{n}").alias("length"), F.col(f"leaf_{n}").alias("leaf"))
    lost, grown, again = F.pmod("key", F.lit(211)) == 7, F.pmod("key", F.lit(101)) == 3, F.pmod("key", F.lit(307)) == 11
    is_grown = F.coalesce(grown, F.lit(False))
    kept = own.filter(~F.coalesce(lost, F.lit(False)))
    copy = side(kept.filter(~is_grown), "key", "own").unionByName(side(kept.filter(is_grown), "key", "hurt")).unionByName(side(own.filter(again), "other", "more"))
    return audit(manifest(side(own, "key", "own")), manifest(copy)).withColumnRenamed("key", "page_id")


QUERIES = {"op1_fixity_audit": op1_fixity_audit}

_RECORD = """'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST({0} AS VARCHAR), '') || '>' || chr(13) || chr(10)
 || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen({1}) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || {1} || chr(13) || chr(10) || chr(13) || chr(10)"""
_OWN = _RECORD.format("page_id", "coalesce(html, '')")
ORACLE = {
    "op1_fixity_audit": f"""
WITH a AS (SELECT page_id AS key, {_OWN} AS r FROM pages),
b AS (SELECT page_id AS key, CASE WHEN page_id % 101 = 3 THEN {_RECORD.format("page_id", "('#' || coalesce(html, ''))")} ELSE {_OWN} END AS r FROM pages WHERE page_id % 211 <> 7
 UNION ALL SELECT -page_id - 1, {_RECORD.format("(-page_id - 1)", "coalesce(html, '')")} FROM pages WHERE page_id % 307 = 11),
x AS (SELECT *, CAST(sum(n) OVER (ORDER BY key, leaf ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - n AS at FROM (SELECT key, CAST(strlen(r) AS BIGINT) AS n, sha256('leaf:' || r) AS leaf FROM a)),
y AS (SELECT *, CAST(sum(n) OVER (ORDER BY key, leaf ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - n AS at FROM (SELECT key, CAST(strlen(r) AS BIGINT) AS n, sha256('leaf:' || r) AS leaf FROM b))
SELECT coalesce(x.key, y.key) AS page_id, coalesce(x.at, y.at) AS rec_offset, coalesce(x.n, y.n) AS rec_length, CAST(floor(coalesce(x.at, 0) / 65536.0) AS BIGINT) AS range_id,
 CASE WHEN x.key IS NULL THEN 'extra' WHEN y.key IS NULL THEN 'missing' ELSE 'changed' END AS status, x.leaf AS leaf_a, y.leaf AS leaf_b
FROM x FULL JOIN y ON x.key = y.key WHERE x.leaf IS DISTINCT FROM y.leaf"""
}

"""The frame-by-frame loader: a fold over frames in order, for batch and for streams.

A frame lists the tiles its view selected. State per session: each tile's
state (loading, loaded, error), bytes, last use, attempts and retry time. Each
frame finishes the loads that were in flight, starts what is missing from the centre out,
aborts loads nobody wants beyond the in-flight cap, and evicts the least recently used
tiles until the cache fits. Time is the frame's own, so a fold gives one result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..runtime import ship

OUT = "session string, frame bigint, loads int, loading int, loaded int, aborted int, evicted int, bytes bigint"


def step(tiles: dict, frame: int, now: int, wanted: list[str], sizes: dict[str, int], in_flight: int, byte_cap: int, count_cap: int, base: int = 1000, retries: int = 3, fails: frozenset = frozenset()) -> dict:
    """One frame over the state, in place; what it did."""
    for key, t in tiles.items():
        if t["state"] == "loading" and t["since"] < frame:
            if key in fails:
                t["attempts"] += 1
                t.update(state="error", retry=now + base * 2 ** (t["attempts"] - 1) if t["attempts"] <= retries else None)
            else:
                t.update(state="loaded", bytes=sizes.get(key, 0))
    loads = 0
    for key in wanted:
        t = tiles.get(key)
        if t is None or (t["state"] == "error" and t["retry"] is not None and t["retry"] <= now):
            tiles[key] = {"state": "loading", "since": frame, "bytes": 0, "used": frame, "attempts": t["attempts"] if t else 0, "retry": None}
            loads += 1
        else:
            t["used"] = frame
    flying = sorted((k for k, t in tiles.items() if t["state"] == "loading"), key=lambda k: (tiles[k]["used"], k))
    spare = [k for k in flying if k not in set(wanted)][: max(0, len(flying) - in_flight)]
    for k in spare:
        del tiles[k]
    total = sum(t["bytes"] for t in tiles.values())
    evicted = 0
    for k in sorted((k for k, t in tiles.items() if t["state"] != "loading" and t["used"] < frame), key=lambda k: (tiles[k]["used"], k)):
        if total <= byte_cap and len(tiles) <= count_cap:
            break
        total -= tiles.pop(k)["bytes"]
        evicted += 1
    count = lambda s: sum(t["state"] == s for t in tiles.values())
    return {"frame": frame, "loads": loads, "loading": count("loading"), "loaded": count("loaded"), "aborted": len(spare), "evicted": evicted, "bytes": total}


def _folded(pdf: pd.DataFrame, tiles: dict, caps: tuple[int, int, int]) -> list[dict]:
    return [step(tiles, int(r.frame), int(r.now), list(r.keys), {k: int(r.tile_bytes) for k in r.keys}, *caps) for r in pdf.sort_values("frame").itertuples(index=False)]


def fold(frames: DataFrame, in_flight: int = 6, byte_cap: int = 256 << 20, count_cap: int = 512) -> DataFrame:
    """Batch: frames (session, frame, now, keys, tile_bytes) of a session in order; a row for each frame.

    Sessions are sorted within partitions and read batch by batch: a task holds one session's tiles, not its history.
    """
    ship(frames.sparkSession)
    caps, names = (in_flight, byte_cap, count_cap), [c.split()[0] for c in OUT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, tiles = None, {}
        for pdf in batches:
            rows = []
            for name, own in pdf.groupby("session", sort=False):
                if name != session:
                    session, tiles = name, {}
                rows += [{"session": name} | x for x in _folded(own, tiles, caps)]
            yield pd.DataFrame(rows, columns=names)

    kept = frames.select("session", "frame", "now", "keys", "tile_bytes")
    return kept.repartition("session").sortWithinPartitions("session", "frame").mapInPandas(run, OUT)


def fold_stream(frames: DataFrame, in_flight: int = 6, byte_cap: int = 256 << 20, count_cap: int = 512) -> DataFrame:
    """Stream: the same fold with the state kept between batches; late frames of a session are dropped."""
    ship(frames.sparkSession)
    caps = (in_flight, byte_cap, count_cap)

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, tiles = (state.get[0], json.loads(state.get[1])) if state.exists else (-1, {})
        pdf = pd.concat(list(batches))
        pdf = pdf[pdf["frame"] > last]
        rows = _folded(pdf, tiles, caps) if len(pdf) else []
        if rows:
            state.update((int(pdf["frame"].max()), json.dumps(tiles)))
        yield pd.DataFrame([{"session": key[0]} | x for x in rows], columns=[c.split()[0] for c in OUT.split(", ")])

    return frames.groupBy("session").applyInPandasWithState(run, OUT, "frame bigint, tiles string", "append", "NoTimeout")

"""The whole loader: what a frame draws, asks for, gives up and drops, as a fold over a session's events.

Tiles are `z/x/y` on levels that halve. A tile is loading, decoded, loaded or in error. Events come in order:

* `frame`: the wanted tiles, from the centre out. Missing ones start to load (unless loads are suspended), loads
  beyond the cap that neither are wanted nor lie near what is are given up, loaded coarser and finer tiles stand in
  for what can't be drawn yet, coarser tiles over the view are kept from eviction, and the least recently used go until the cache fits;
* `result`: a load that ended, by tile and attempt; one of an attempt that was given up or replaced is dropped;
* `upload`: decoded tiles become loaded in the order they came, up to a byte cap, one at least;
* `destroy`: the session ends.

Sessions are sorted within partitions and read batch by batch, so a task holds one session's tiles, not its history.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.scheduler import MAX_RETRIES, RETRY_BASE, STAND_IN_DEPTH
from ..runtime import ship

EVENTS = "session string, seq bigint, kind string, now bigint, keys array<string>, key string, attempt int, bytes bigint"
OUT = "session string, seq bigint, kind string, draw array<string>, loads array<string>, gone array<string>, loading int, pending int, size int, bytes bigint"


def place(key: str) -> tuple[int, int, int]:
    return tuple(map(int, key.split("/")))


def over(a: tuple[int, int, int], b: tuple[int, int, int]) -> bool:
    """Whether two tiles' boxes overlap strictly."""
    (z, x, y), (w, u, v) = sorted((a, b))
    return (u >> (w - z), v >> (w - z)) == (x, y)


@dataclass
class Tile:
    state: str
    attempt: int
    used: int
    bytes: int = 0
    failures: int = 0
    retry: int | None = None
    order: int = 0


@dataclass
class Loader:
    in_flight: int = 6
    byte_cap: int = 256 << 20
    count_cap: int = 512
    upload_cap: int = 1 << 20
    base: int = RETRY_BASE
    retries: int = MAX_RETRIES
    tiles: dict[str, Tile] = field(default_factory=dict)
    frames: int = 0
    attempts: int = 0
    decoded: int = 0
    alive: bool = True

    def frame(self, now: int, wanted: list[str], suspended: bool = False) -> tuple[list[str], list[str], list[str]]:
        """What is drawn (coarse first), what starts to load, and what was given up or evicted."""
        if not self.alive:
            return [], [], []
        self.frames += 1
        draw, missing, loads = [], [], []
        for key in wanted:
            tile = self.tiles.get(key)
            if tile:
                tile.used = self.frames
            if tile and tile.state == "loaded":
                draw.append(key)
                continue
            due = tile is not None and tile.state == "error" and tile.retry is not None and now >= tile.retry
            if not suspended and (tile is None or due):
                self.attempts += 1
                self.tiles[key] = Tile("loading", self.attempts, self.frames, failures=tile.failures if tile else 0)
                loads.append(key)
            missing.append(key)
        view = [place(k) for k in wanted]
        gone = self._give_up(set(wanted), view)
        loaded = {place(k): k for k, t in self.tiles.items() if t.state == "loaded"}
        for key in missing:
            own = place(key)
            near = [p for p in loaded if p != own and over(p, own)]
            coarse = max((p[0] for p in near if p[0] < own[0]), default=None)
            fine = min((p[0] for p in near if own[0] < p[0] <= own[0] + STAND_IN_DEPTH), default=None)
            draw += [loaded[p] for p in sorted(near) if p[0] in (coarse, fine)]
        draw = list(dict.fromkeys(draw))
        for key in draw:
            self.tiles[key].used = self.frames
        for p, key in loaded.items():
            if any(p[0] < v[0] and over(p, v) for v in view):
                self.tiles[key].used = self.frames
        gone += self._evict(set(draw))
        return sorted(draw, key=lambda k: place(k)[0]), loads, gone

    def _give_up(self, wanted: set[str], view: list[tuple[int, int, int]]) -> list[str]:
        flying = [k for k, t in self.tiles.items() if t.state == "loading"]
        spare = [k for k in flying if k not in wanted and not any(place(k)[0] - v[0] <= STAND_IN_DEPTH and over(place(k), v) for v in view)]
        spare = sorted(spare, key=lambda k: self.tiles[k].used)[: max(0, len(flying) - self.in_flight)]
        for k in spare:
            del self.tiles[k]
        return spare

    def _evict(self, drawn: set[str]) -> list[str]:
        total, gone = sum(t.bytes for t in self.tiles.values()), []
        settled = [k for k, t in self.tiles.items() if t.state in ("loaded", "error") and t.used < self.frames and k not in drawn]
        for k in sorted(settled, key=lambda k: self.tiles[k].used):
            if total <= self.byte_cap and len(self.tiles) <= self.count_cap:
                break
            total -= self.tiles.pop(k).bytes
            gone.append(k)
        return gone

    def result(self, now: int, key: str, attempt: int, size: int | None) -> bool:
        """Whether a load's end counts; size: its bytes, None if it failed."""
        tile = self.tiles.get(key)
        if not self.alive or tile is None or tile.state != "loading" or tile.attempt != attempt:
            return False
        if size is None:
            tile.failures += 1
            tile.state, tile.retry = "error", now + self.base * 2 ** (tile.failures - 1) if tile.failures <= self.retries else None
        else:
            self.decoded += 1
            tile.state, tile.used, tile.bytes, tile.order = "decoded", self.frames, size, self.decoded
        return True

    def upload(self) -> list[str]:
        """Decoded tiles that become loaded in this frame."""
        out, size = [], 0
        for k in sorted((k for k, t in self.tiles.items() if t.state == "decoded"), key=lambda k: self.tiles[k].order):
            if out and size >= self.upload_cap:
                break
            self.tiles[k].state = "loaded"
            size += self.tiles[k].bytes
            out.append(k)
        return out

    def destroy(self) -> list[str]:
        gone, self.alive = sorted(self.tiles), False
        self.tiles.clear()
        return gone

    def event(self, kind: str, now: int, keys, key, attempt, size) -> tuple[list[str], list[str], list[str]]:
        if kind in ("frame", "suspended"):
            return self.frame(now, list(keys), kind == "suspended")
        if kind == "result":
            return [], [], [] if self.result(now, key, attempt, size) else [key]
        if kind == "upload":
            return self.upload(), [], []
        return [], [], self.destroy()


def fold(events: DataFrame, **caps) -> DataFrame:
    """A row for each event: what it drew (or uploaded), asked for and lost, and the state after it."""
    ship(events.sparkSession)
    names = [c.split()[0] for c in OUT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, loader = None, Loader(**caps)
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if r.session != session:
                    session, loader = r.session, Loader(**caps)
                size = None if pd.isna(r.bytes) else int(r.bytes)
                draw, loads, gone = loader.event(r.kind, int(r.now), () if r.keys is None else r.keys, r.key, None if pd.isna(r.attempt) else int(r.attempt), size)
                state = [t.state for t in loader.tiles.values()]
                held = sum(t.bytes for t in loader.tiles.values() if t.state == "loaded")
                rows.append((r.session, r.seq, r.kind, draw, [f"{k}@{loader.tiles[k].attempt}" for k in loads], gone, state.count("loading"), state.count("decoded"), len(state), held))
            yield pd.DataFrame(rows, columns=names)

    columns = [c.split()[0] for c in EVENTS.split(", ")]
    return events.select(*columns).repartition("session").sortWithinPartitions("session", "seq").mapInPandas(run, OUT)

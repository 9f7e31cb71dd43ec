"""Toxicity by a subsequence-kernel support vector machine with Nystroem landmarks.

The gap-weighted kernel k(x, z) sums over common subsequences of LENGTH letters that skip at most
GAP characters between two of them, each weighted by DECAY to the power of the spans it takes in x and in z, so
inserted characters and gaps lower a match and don't destroy it. Landmarks are
strings that many labelled toxic texts hold and clean ones hardly ever. A segment's features are
min(1, k(x, z) / k(z, z)), whitened by the landmarks' normalised kernel matrix
(Nystroem); a linear support vector machine over them is trained on segments of
the labelled texts, and on these with gaps put in. A text scores as its worst segment, made a
probability by a rising fit on labelled texts that the machine behind their scores didn't see: each of FOLDS parts is
scored by a machine of the others.

Segments are words, and runs of words of one or two letters as one string, as in "i d i o t".
Digits that stand for letters count as those. A segment of over WIDTH characters is read in
windows of that width, STRIDE apart, so any WIDTH - STRIDE neighbouring characters are in one of them. The
kernel is 0 where there is no such subsequence; whether there is one is found for all landmarks at
once in bit vectors, and only those pairs are summed. Every distinct segment of
the corpus is scored once, and texts look their segments up. Kernels of the fit run as Spark tasks too.

Defined cases: a null text counts as empty; an empty text has the score of a text without any
match. Repeated label rows of an id count once, with their largest label; null labels don't
count. Without toxic and clean labels, or without a landmark, all scores are the share of toxic labels
(0 without labels). Only the named columns are read.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as core
from . import tokens

LENGTH, GAP, DECAY, WIDTH, STRIDE = 4, 2, 0.8, 32, 8
#: Bounds of the fit: toxic and clean rows, landmarks (at most 64), training segments.
TOXIC_ROWS, CLEAN_ROWS, LANDMARKS, SEGMENTS = 1500, 3000, 48, 8000
SHORTEST, LONGEST, FOLDS = 4, 10, 4
CUTOFF = 0.7

# Digits and signs that stand for letters.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}

START, STOP = "\x02", "\x03"  # a segment's ends, which match as letters do
_ENDS = np.array([254, 255], np.uint8)

_ASCII = np.zeros(128, np.uint8)
_ASCII[[2, 3]] = _ENDS
_ASCII[97:123] = np.arange(1, 27)
_ASCII[65:91] = np.arange(1, 27)
for _digit, _letter in STANDS_FOR.items():
    _ASCII[ord(_digit)] = _ASCII[ord(_letter)]


def codes(points: np.ndarray) -> np.ndarray:
    """Letters 1 to 26, other scripts' characters 27 to 226, and 0 for what never matches."""
    return np.where(points < 128, _ASCII[np.minimum(points, 127)], 27 + points % 200).astype(np.uint8)


def windows(w: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code matrix (windows, WIDTH) of UTF-8 segments, and the segment of each window."""
    if not len(starts):
        return np.zeros((0, WIDTH), np.uint8), np.zeros(0, np.int64)
    data = w[tokens.ragged(starts, n)]
    ends = np.cumsum(n)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    code = codes(np.frombuffer(data.tobytes().decode().lower().encode("utf-32-le"), np.uint32).astype(np.int64)) if chars[-1] else np.zeros(0, np.uint8)
    if len(code) != chars[-1]:  # a few letters grow in lower case
        code = codes(np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64))
    a, z, i = chars[ends - n], chars[ends], np.arange(len(starts))
    code = np.insert(code, np.stack([a, z], axis=1).ravel(), np.tile(_ENDS, len(starts)))
    a, z = a + 2 * i, z + 2 * i + 2
    size = z - a
    count = np.where(size > WIDTH, -(-(size - WIDTH) // STRIDE) + 1, 1)
    owner = np.repeat(np.arange(len(starts)), count)
    first = a[owner] + tokens.ragged(np.zeros(len(starts), np.int64), count) * STRIDE
    at = first[:, None] + np.arange(WIDTH)
    ok = at < z[owner][:, None]
    return np.where(ok, code[np.minimum(at, len(code) - 1)], 0).astype(np.uint8), owner


def as_matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [x.encode() for x in words]
    n = np.array([len(x) for x in raw], np.int64)
    return windows(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(n) - n, n)


def spelled(words: list[str]) -> np.ndarray:
    """Code matrix of landmarks, whose ends are written out where they count."""
    width = max(map(len, words))
    return np.array([[*codes(np.array([ord(c) for c in w], np.int64)), *[0] * (width - len(w))] for w in words], np.uint8)


def ended(word: str) -> str:
    """A word between its ends, without signs at its edges."""
    return START + re.sub(r"^[\W_]+|[\W_]+$", "", word) + STOP


def pairs(x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, landmark) of all pairs with k(x, z) > 0; landmarks have 31 letters at most."""
    match = np.zeros((256, len(z)), np.uint32)  # bits of the places in a landmark that hold a letter
    for t in range(z.shape[1]):
        match[z[:, t], np.arange(len(z))] |= np.uint32(1 << t)
    match[0] = 0
    none, found = np.zeros((len(x), len(z)), np.uint32), np.zeros((len(x), len(z)), np.uint32)
    reach = [[none] * (GAP + 1) for _ in range(LENGTH - 1)]  # by length and letters back: places that may come next
    for j in range(int((x > 0).any(axis=0).nonzero()[0].max(initial=-1)) + 1):
        ends = match[x[:, j]]
        for r in range(LENGTH - 1):
            before = reach[r][0] | reach[r][1] | reach[r][2]
            reach[r] = [(ends << 1) | (ends << 2) | (ends << 3), *reach[r][:GAP]]
            ends = match[x[:, j]] & before
        found |= ends
    return np.nonzero(found)


def kernel(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """k(x, z) for code matrices (rows, any width) and (landmarks, any width): (rows, landmarks)."""
    out = np.zeros((len(x), len(z)), np.float32)
    for low in range(0, len(x), 2048):
        row, mark = pairs(x[low : low + 2048], z)
        for a in range(0, len(row), 8192):
            r, m = row[a : a + 8192], mark[a : a + 8192]
            out[low + r, m] = summed(x[low + r], z[m])
    return out


def summed(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """k(x, z) of rows of x with rows of z, side by side."""
    width = int((z > 0).any(axis=0).nonzero()[0].max(initial=-1)) + 1
    x, z = np.ascontiguousarray(x.T), np.ascontiguousarray(z.T[:width])
    total, square, decay = np.zeros(x.shape[1], np.float32), np.float32(DECAY * DECAY), np.float32(DECAY)
    none = np.zeros((width, x.shape[1]), np.float32)
    reach = [[none] * (GAP + 1) for _ in range(LENGTH - 1)]  # as in pairs: sums by the place that comes next
    for j in range(int((x > 0).any(axis=1).nonzero()[0].max(initial=-1)) + 1):
        same = np.where((z == x[j]) & (z > 0), square, np.float32(0))
        ends = same
        for r in range(LENGTH - 1):
            before = reach[r][0] + decay * (reach[r][1] + decay * reach[r][2])
            next_to = np.zeros_like(none)
            next_to[1:] = ends[:-1]
            next_to[2:] += decay * ends[:-2]
            next_to[3:] += square * ends[:-3]
            reach[r] = [next_to, *reach[r][:GAP]]
            ends = same * before
        total += ends.sum(axis=0)
    return total


@dataclass
class Model:
    marks: np.ndarray  # codes of landmarks
    own: np.ndarray  # k(z, z)
    weights: np.ndarray  # on min(1, k / own)
    bias: float
    knots: tuple[np.ndarray, np.ndarray]  # decision -> probability

    def segments(self, x: np.ndarray) -> np.ndarray:
        """Decision values of code rows."""
        return features(x, self.marks, self.own) @ self.weights + np.float32(self.bias)

    def probability(self, worst: np.ndarray) -> np.ndarray:
        """Of a text by its worst segment; a hundredth of it rises throughout, to rank texts of one pool."""
        if not len(self.knots[0]):
            return np.full(len(worst), self.bias)
        return 0.99 * np.interp(worst, *self.knots) + 0.01 / (1 + np.exp(-np.clip(worst, -30, 30)))


def features(x: np.ndarray, marks: np.ndarray, own: np.ndarray) -> np.ndarray:
    return np.minimum(kernel(x, marks) / own, 1).astype(np.float32)


def prepared(texts: list[str]) -> tuple[list[str], list[list[int]]]:
    """Distinct segments of texts, and per text the indexes of its own."""
    index, rows = {}, []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        s, e, _ = tokens.pieces("segments", data, np.array([0, len(data)]))
        raw = data.tobytes()
        rows.append(sorted({index.setdefault(x, len(index)) for x in {raw[a:z].decode().lower() for a, z in zip(s, e, strict=True)}}))
    return list(index), rows


def copies(texts: list[str]) -> np.ndarray:
    """Cluster of each text: texts that agree in two of four smallest hashes of their three-word shingles, as copies do."""
    parent = list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    first: dict[tuple, int] = {}
    for i, t in enumerate(texts):
        data = np.frombuffer(t.encode(), np.uint8)
        s = core.shingles(core.word_hashes(data, np.array([0, len(data)]))[0], 3)
        if len(s):
            least = [int(core.mix64(s ^ np.uint64(k * 0x1851F42D4C957F2D)).min()) for k in (1, 2, 3, 4)]
            for a in range(4):
                for b in range(a):
                    parent[root(i)] = root(first.setdefault((a, b, least[a], least[b]), i))
    return np.unique([root(i) for i in range(len(texts))], return_inverse=True)[1]


def landmarks(words: list[str], rows: list[list[int]], toxic: np.ndarray, kin: np.ndarray, each: float = 1.0) -> list[str]:
    """Strings that tell toxic texts from clean ones, the most telling first; each: rows that a clean text stands for.

    Copies of a text (kin) count once. A word that holds a chosen string doesn't count for others.
    """
    once = np.zeros(len(rows), bool)
    once[np.unique(np.stack([kin, ~toxic]), axis=1, return_index=True)[1]] = True
    held = defaultdict(list)
    for i in np.flatnonzero(once):
        for w in rows[i]:
            held[w].append(i)
    n_toxic, n_clean = int((toxic & once).sum()), int((~toxic & once).sum())
    bad = {w: sum(map(toxic.__getitem__, d)) for w, d in held.items()}
    enriched = [w for w, d in held.items() if bad[w] >= 2 and (bad[w] + 0.5) / n_toxic > 8 * (len(d) - bad[w] + 0.5) / n_clean]
    parts = lambda word: {p[i : i + k] for p in re.findall(r"[^\W_\x02\x03]*[\x02\x03]?[^\W_\x02\x03]+[\x02\x03]?", ended(word)) for k in range(SHORTEST, LONGEST + 1) for i in range(len(p) - k + 1)}
    wanted = set().union(*(parts(words[w]) for w in enriched)) if enriched else set()
    if not wanted:
        return []
    finder, holders = ahocorasick.Automaton(), defaultdict(list)
    for p in wanted:
        finder.add_word(p, p)
    finder.make_automaton()
    for w in held:
        for p in {p for _, p in finder.iter(ended(words[w]))}:
            holders[p].append(w)
    least, gone = max(5, 0.01 * n_toxic), set()

    def gain(p: str) -> tuple:
        docs = set().union(*(held[w] for w in holders[p] if w not in gone))
        a = sum(map(toxic.__getitem__, docs))
        clean = each * (len(docs) - a)
        return (a - 3 * clean, len(p), p) if a >= least and clean <= 0.1 * a else (-1, 0, p)

    heap = [tuple((-g[0], -g[1], p)) for p in holders if sum(bad[w] for w in holders[p]) >= least and (g := gain(p))[0] > 0]
    heapq.heapify(heap)
    chosen = []
    while heap and len(chosen) < LANDMARKS:
        top = heapq.heappop(heap)
        now = gain(top[2])
        if now[0] <= 0:
            continue
        if now[0] < -top[0]:  # its words went to others; it waits for its turn
            heapq.heappush(heap, (-now[0], -now[1], top[2]))
            continue
        chosen.append(top[2])
        gone.update(holders[top[2]])
    return chosen


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 12) -> np.ndarray:
    """Weights of a linear support vector machine (the last one is the bias), by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weigh = np.where(y > 0, cost * len(y) / max(1, 2 * (y > 0).sum()), cost * len(y) / max(1, 2 * (y < 0).sum())) / len(y) * 100
    alpha, w, norms, rng = np.zeros(len(y)), np.zeros(x.shape[1]), (x * x).sum(axis=1), np.random.default_rng(3)
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            new = min(max(alpha[i] - (y[i] * (w @ x[i]) - 1) / norms[i], 0.0), weigh[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def monotone(s: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (decision, probability) of the best rising fit, by pooling adjacent violators; each pool leans to the overall share."""
    order = np.argsort(s, kind="stable")
    pools: list[list[float]] = []
    for x, t, w in zip(s[order], y[order], weight[order], strict=True):
        pools.append([t * w, w, x * w])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            t, n, x = pools.pop()
            pools[-1] = [pools[-1][0] + t, pools[-1][1] + n, pools[-1][2] + x]
    at = np.array([x / n for _, n, x in pools])
    share = float(y @ weight / weight.sum())
    return at, np.maximum.accumulate(np.array([(t + share) / (n + 1) for t, n, _ in pools]))


def gapped(word: str, rng) -> str:
    """A word with separators or letters put in."""
    how = rng.integers(3)
    if how == 0:
        return str(rng.choice([".", "-", "*", " ", "_"])).join(word)
    at = int(rng.integers(1, len(word)))
    return word[:at] + ("x" if how == 1 else str(rng.choice([".", "-", "*"]))) + word[at:]


#: Words of a block whose kernels one task computes.
TASK_WORDS = 20_000


def kernel_rows(spark: SparkSession | None, words: list[str], marks: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all windows of words, and the word of each; by Spark tasks, or here without a session."""
    m, owner = as_matrix(words)
    if spark is None:
        return features(m, marks, own), owner
    core.ship(spark)
    width = m.shape[1]
    blocks = [(a, m[a : a + TASK_WORDS].tobytes()) for a in range(0, len(m), TASK_WORDS)]

    def run(batches):
        for b in batches:
            for a, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = features(np.frombuffer(raw, np.uint8).reshape(-1, width), marks, own)
                at = np.flatnonzero(found.any(axis=1))  # most segments have no feature
                yield pa.RecordBatch.from_pydict({"a": pa.array([a], pa.int64()), "at": [at.astype("<i4").tobytes()], "f": [found[at].astype("<f4").tobytes()]})

    rows = spark.createDataFrame(blocks, "a bigint, m binary").repartition(max(1, len(blocks))).mapInArrow(run, "a bigint, at binary, f binary").collect()
    out = np.zeros((len(m), len(marks)), np.float32)  # of the labelled sample alone
    for a, at, f in rows:
        out[a + np.frombuffer(at, "<i4")] = np.frombuffer(f, "<f4").reshape(-1, len(marks))
    return out, owner


def machine(words: list[str], rows: list[list[int]], toxic: np.ndarray, use: np.ndarray, bad: list[str], found: np.ndarray, owner: np.ndarray) -> tuple[Model, np.ndarray]:
    """The machine of the texts in `use` with landmarks `bad`, and the worst decision of every text; found: features of all words' windows."""
    at, marks = np.flatnonzero(use), spelled(bad)
    own = np.diag(kernel(marks, marks)).copy()
    gram = kernel(marks, marks) / np.sqrt(np.outer(own, own))
    value, vector = np.linalg.eigh(gram.astype(float))
    white = vector @ np.diag(np.maximum(value, 1e-2) ** -0.5) @ vector.T
    rng = np.random.default_rng(11)
    has = re.compile("|".join(map(re.escape, sorted(bad, key=len, reverse=True))))
    seen, in_clean = np.zeros(len(words), bool), np.zeros(len(words), bool)
    for i in at:
        seen[rows[i]] = True
        if not toxic[i]:
            in_clean[rows[i]] = True
    up = [i for i in np.flatnonzero(seen & ~in_clean) if has.search(ended(words[i]))][: SEGMENTS // 4]
    plain = [w.strip(START + STOP) for w in bad]
    made = [gapped(w, rng) for w in (plain * (SEGMENTS // 4 // len(bad) + 1))[: SEGMENTS // 4]]
    clean = np.flatnonzero(in_clean)
    down = rng.choice(clean, min(len(clean), SEGMENTS // 4), replace=False)
    extra = features(as_matrix(made)[0], marks, own)
    first, stop = np.searchsorted(owner, np.arange(len(words))), np.searchsorted(owner, np.arange(len(words)), side="right")
    of = lambda some: tokens.ragged(first[some], (stop - first)[some])
    for _ in range(2):  # the second time with what the first took for toxic in clean texts
        low = of(down)
        train = np.concatenate([found[of(np.array(up, np.int64))], extra, found[low]])
        w = svm(train @ white, np.where(np.arange(len(train)) < len(train) - len(low), 1.0, -1.0))
        model = Model(marks, own, (white @ w[:-1]).astype(np.float32), float(w[-1]), (np.zeros(0), np.zeros(0)))
        score = np.full(len(words), -np.inf, np.float32)
        np.maximum.at(score, owner, found @ model.weights + np.float32(model.bias))
        down = np.concatenate([down, clean[np.argsort(-score[clean], kind="stable")][: SEGMENTS // 4]])
    return model, np.array([score[r].max() if r else model.bias for r in rows])


def fit(texts: list[str], toxic: np.ndarray, each: float = 1.0, spark: SparkSession | None = None) -> Model:
    """The model of labelled texts; each: how many rows of the corpus a clean one stands for."""
    share = float(toxic.sum() / (toxic.sum() + each * (~toxic).sum())) if len(toxic) else 0.0
    none = np.zeros(0)
    flat = Model(np.zeros((1, WIDTH), np.uint8), np.ones(1, np.float32), np.zeros(1, np.float32), share, (none, none))
    if not toxic.any() or toxic.all():
        return flat
    (words, rows), kin = prepared(texts), copies(texts)
    part = core.mix64(kin.astype(np.uint64) + np.uint64(1)) % np.uint64(FOLDS)  # copies of a text stay in one
    uses = [np.ones(len(texts), bool), *[part != fold for fold in range(FOLDS)]]
    bad = []
    for use in uses:
        at = np.flatnonzero(use)
        whole = toxic[at].any() and not toxic[at].all()
        bad.append(landmarks(words, [rows[i] for i in at], toxic[at], kin[at], each) if whole else [])
    if not bad[0]:
        return flat
    every = sorted(set().union(*bad))
    marks = spelled(every)
    found, owner = kernel_rows(spark, words, marks, np.diag(kernel(marks, marks)).copy())
    column = {w: i for i, w in enumerate(every)}
    fitted = [machine(words, rows, toxic, use, b, found[:, [column[w] for w in b]], owner) if b else None for use, b in zip(uses, bad, strict=True)]
    model, worst = fitted[0]
    for fold, other in enumerate(fitted[1:]):
        if other:
            worst[part == fold] = other[1][part == fold]
    model.knots = monotone(worst, toxic.astype(float), np.where(toxic, 1.0, each))
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels of at most TOXIC_ROWS and CLEAN_ROWS ids, by a hash of the id; and how many toxic rows' worth a clean one is."""
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.filter(core.crc_mod("doc_id", 3) != 1)
    picked = None
    for label, rows in ((1, TOXIC_ROWS), (0, CLEAN_ROWS)):
        part = marks.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    held = picked.collect()  # at most TOXIC_ROWS + CLEAN_ROWS ids
    if not held:
        return [], np.zeros(0, bool), 1.0
    own = docs.sparkSession.createDataFrame(held, marks.schema)
    rows = docs.filter(F.col("text").isNotNull()).join(F.broadcast(own), "doc_id").select("doc_id", "text", "toxic").collect()
    seen, texts, toxic = set(), [], []
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"])):
        if r["doc_id"] not in seen:
            seen.add(r["doc_id"])
            texts.append(r["text"])
            toxic.append(r["toxic"] == 1)
    all_of = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).filter(F.col("toxic").isin(0, 1)).collect()}
    share = lambda label, rows: all_of.get(label, 0) / max(1, min(rows, all_of.get(label, 0)))
    return texts, np.array(toxic, bool), share(0, CLEAN_ROWS) / max(1.0, share(1, TOXIC_ROWS))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score of every row's whole text."""
    spark = docs.sparkSession
    core.ship(spark)
    bag = spark.sparkContext.broadcast(model)  # at most LANDMARKS landmarks
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def decide(w, starts, n):
        out = np.full(len(starts), -np.inf, np.float32)
        for a in range(0, len(starts), 65536):
            m, owner = windows(w, starts[a : a + 65536], n[a : a + 65536])
            np.maximum.at(out[a : a + 65536], owner, bag.value.segments(m))
        return np.ones(len(starts), np.int64), out

    store, shards = tokens.build_store(rows, "t", decide, "segments")

    def run(batches):
        opened, model = tokens.opened_store(store, shards, "<f4"), bag.value
        for b in batches:
            for i, j, values, ends in tokens.encoded(b.column(1), opened, "segments"):
                starts = np.concatenate([[0], ends[:-1]])
                worst = np.full(j - i, model.bias)
                some = ends > starts
                if some.any():
                    worst[some] = np.maximum.reduceat(values, starts[some])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(model.probability(worst))], names=[key, "score"])

    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = core.table(spark, sf_dir, "documents")
    found = score(docs, fit(*labelled_sample(docs, core.table(spark, sf_dir, "labels")), spark))
    held = F.coalesce(core.crc_mod("doc_id", 3) == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}

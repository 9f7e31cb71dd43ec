"""Secret scanning: fixed patterns plus character Markov models.

Two first-order Markov chains over characters, one of random strings and one of
ordinary identifiers, are counted from labelled samples. A candidate is a maximal run of
RUN characters or more that tokens are made of; it is a secret when the log-likelihood ratio of its transitions
reaches MIN_SUM in all and MIN_MEAN on average. If a run isn't, its parts between / _ = and -
are candidates too, so a key within a path isn't diluted. Everything runs as Column expressions.

Positions are code points, end exclusive. They come from lengths: splitting at a
pattern gives the text between matches, extracting gives the matches, and the
running sum of both gives every start. Sums run over chunks, so their cost grows with the text alone.

Defined cases: a null text counts as empty and has no spans. Repeated rows each
get their own result. Very long texts and runs are scanned whole. `scan` adds one column and
keeps all others, whatever their names; the query's columns are fixed. Without samples all ratios are 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.barrier import computed
from . import textcore as core

# The patterns of the contract, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Least length of a candidate, least ratio (nats) in all and for each transition.
RUN, MIN_SUM, MIN_MEAN = 16, 14.0, 0.75
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{RUN},}}"
PART = rf"(?<![A-Za-z0-9+])[A-Za-z0-9+]{{{RUN},}}"
#: Rows of the sample that the models are counted from.
SAMPLE_DOCS = 2000
#: Observations that the frequency of single characters counts for in a transition.
BACKOFF = 5.0
#: Matches that are summed up together, and characters of a block in which overlaps are looked up.
CHUNK, BLOCK = 256, 4096


_SHAPE = "array<struct<start:int,rank:int,end:int,value:string>>"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    held = {c.lower() for c in df.columns}
    while name in held:
        name += "_"
    return name


def with_matches(df: DataFrame, text: str, wanted: dict[str, tuple]) -> DataFrame:
    """df with the leftmost non-overlapping matches of patterns in its column `text`, none of which is null.

    wanted: column -> (kind, pattern, group whose text counts, test of that text); columns become array<struct<start, rank, end, value>>.
    Each step of the sums is a column of its own, as a lambda computes again what it holds.
    """
    t, held = F.col(f"`{text}`"), df.columns
    steps, chunks = ({k: fresh(df, f"secret_{x}_{k}") for k in wanted} for x in ("steps", "chunks"))

    def step_rows(pattern: str, group: int) -> Column:
        found, between = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.split(t, pattern, -1)
        tested = F.regexp_extract_all(t, F.lit(pattern), F.lit(group))
        rows = F.zip_with(F.arrays_zip(found.alias("m"), tested.alias("v")), between, lambda a, g: F.struct(F.length(g).alias("gap"), F.length(a["m"]).alias("size"), a["v"].alias("v")))
        return F.when(t.rlike(pattern), F.filter(rows, lambda x: x["size"].isNotNull()))  # what follows the last match has none

    def cut(rows: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / CHUNK).cast("int")), lambda c: F.slice(rows, c * CHUNK + 1, F.lit(CHUNK)))

    def spans(parts: Column, kind: str, keep) -> Column:
        none = F.array().cast(_SHAPE)

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            row = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start + x["size"]).alias("end"), x["v"].alias("value"))
            return F.struct((start + x["size"]).alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

        width = lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + x["gap"] + x["size"])
        bases = F.aggregate(F.transform(parts, width), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        summed = F.zip_with(parts, F.slice(bases, 1, F.size(parts)), lambda part, base: F.aggregate(part, F.struct(base.alias("at"), none.alias("out")), step, lambda acc: acc["out"]))
        return F.coalesce(F.filter(F.flatten(summed), lambda s: keep(s["value"])), none)

    df = computed(df, {steps[k]: step_rows(pattern, group) for k, (_, pattern, group, _) in wanted.items()})
    df = computed(df, {chunks[k]: cut(F.col(steps[k])) for k in wanted}, [c for c in df.columns if c not in steps.values()])
    return computed(df, {k: spans(F.col(chunks[k]), kind, keep) for k, (kind, _, _, keep) in wanted.items()}, held)


#: The contract's kinds.
BASE = {
    "assign": ("assign", ASSIGN, 2, lambda v: F.length(v) >= 6),
    "access": ("access", ACCESS, 0, lambda v: F.lit(True)),
    "hex": ("hex", HEX, 0, lambda v: F.lit(True)),
}


def train(samples: DataFrame, value: str = "value", label: str = "random") -> list[float]:
    """Log ratio of each transition, random over ordinary; index = from * width + to.

    Transitions lean to the frequency of the character they lead to. The counts have at most 2 * width * width rows, width being the alphabet's size.
    """
    pairs = samples.select(F.col(label).alias("label"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(value) - 1, F.lit(1))), lambda i: F.substr(F.col(value), i, F.lit(2)))).alias("pair"))
    counts = {(r["label"], r["pair"]): r["n"] for r in pairs.filter(F.length("pair") == 2).groupBy("label", "pair").agg(F.count("*").alias("n")).filter(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).collect()}
    each = {(l, b): sum(counts.get((l, a + b), 0) for a in ALPHABET) + 0.5 for l in (True, False) for b in ALPHABET}
    whole = {l: sum(each[l, b] for b in ALPHABET) for l in (True, False)}
    after = {(l, a): sum(counts.get((l, a + b), 0) for b in ALPHABET) for l in (True, False) for a in ALPHABET}
    log = lambda l, a, b: math.log((counts.get((l, a + b), 0) + BACKOFF * each[l, b] / whole[l]) / (after[l, a] + BACKOFF))
    return [log(True, a, b) - log(False, a, b) for a in ALPHABET for b in ALPHABET]


def by_ascii(model: list[float]) -> str:
    """The model as JSON, by the ASCII codes of both characters."""
    table = [0.0] * (128 * 128)
    for i, a in enumerate(ALPHABET):
        for j, b in enumerate(ALPHABET):
            table[ord(a) * 128 + ord(b)] = round(model[i * len(ALPHABET) + j], 6)
    return "[" + ",".join(f"{x:g}" if x == 0 else f"{x:.6f}" for x in table) + "]"


def ratio(value: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a value's transitions."""
    table = F.from_json(F.lit(by_ascii(model)), "array<double>")
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c))
    pairs = F.zip_with(F.slice(codes, 1, F.length(value) - 1), F.slice(codes, 2, F.length(value) - 1), lambda a, b: F.get(table, a * 128 + b))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def blocks_of(spans: Column, length: Column) -> Column:
    """The spans that reach into each block of BLOCK characters, so that an overlap is looked up in few of them."""
    inside = lambda i: F.filter(spans, lambda s: (s["start"] < (i + 1) * BLOCK) & (s["end"] > i * BLOCK))
    return F.when(F.size(spans) > 0, F.transform(F.sequence(F.lit(0), F.floor(length / BLOCK).cast("int")), inside))


def apart(spans: Column, blocks: Column) -> Column:
    """The spans that touch none of those in the blocks (none at all if null)."""
    first = lambda s: F.floor(s["start"] / BLOCK).cast("int")
    near = lambda s: F.flatten(F.slice(blocks, first(s) + 1, F.floor(s["end"] / BLOCK).cast("int") - first(s) + 1))
    return F.when(blocks.isNull(), spans).otherwise(F.filter(spans, lambda s: ~F.exists(near(s), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))


def markov(model: list[float]) -> dict[str, tuple]:
    """Whole runs, and parts of runs, that the models call random."""

    def likely(v: Column) -> Column:
        return ratio(v, model) >= F.greatest(F.lit(MIN_SUM), MIN_MEAN * (F.length(v) - 1))

    return {"run": ("markov", CANDIDATE, 0, likely), "part": ("markov", PART, 0, likely)}


def sample_strings(docs: DataFrame) -> DataFrame:
    """Labelled strings (value, random) from a bounded sample of documents.

    Random: values of base matches, and digests made from numbers, in hex, in base64, and their letters alone, in either case.
    Ordinary: the documents' other words and numbers, alone and joined by _ or - or capitals as identifiers are.
    """
    spark = docs.sparkSession
    text = core.bounded_sample(docs.filter(F.col("text").isNotNull()), "doc_id", SAMPLE_DOCS).select("text")
    values = with_matches(text, "text", BASE).select(F.explode(F.concat(*[F.transform(k, lambda x: x["value"]) for k in BASE])).alias("value"))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = text.select(F.regexp_extract_all(rest, F.lit(r"[A-Za-z]{3,}|[0-9]{2,}"), F.lit(0)).alias("w"))
    joined = lambda at, by: F.array_join(F.slice("w", at, 40), by)
    camel = F.array_join(F.transform(F.slice("w", 81, 40), lambda w: F.initcap(w)), "")
    ordinary = words.select(F.explode(F.concat("w", F.array(joined(1, "_"), joined(41, "-"), camel))).alias("value"))
    made = spark.range(0, 4000, 1, 4).select(F.sha2(F.col("id").cast("string"), 512).alias("x"))
    letters = F.regexp_replace(F.base64(F.unhex("x")), "[^A-Za-z]", "")
    random = values
    for value in (F.substr("x", F.lit(1), F.lit(40)), F.base64(F.unhex(F.substr("x", F.lit(1), F.lit(64)))), F.lower(F.substr(letters, F.lit(1), F.lit(30))), F.upper(F.substr(letters, F.lit(31), F.lit(30)))):
        random = random.unionByName(made.select(value.alias("value")))
    return random.withColumn("random", F.lit(True)).unionByName(ordinary.withColumn("random", F.lit(False)))


def scan(docs: DataFrame, model: list[float], text: str = "text", out: str = "spans") -> DataFrame:
    """docs with `out`: struct<assign, access, hex, base, every>, each an array<struct<start, rank, end, value>>; `every` by start, then kind.

    A column `out` that docs has is replaced.
    """
    held = docs.drop(out)
    names = {k: fresh(held, f"secret_{k}") for k in ("text", *KINDS[:3], "base", "run", "part", "blocks")}
    own = {k: F.col(v) for k, v in names.items()}
    df = computed(held, {names["text"]: F.coalesce(F.col(text), F.lit(""))})
    df = with_matches(df, names["text"], {names[k]: v for k, v in {**BASE, **markov(model)}.items()})
    df = computed(df, {names["base"]: F.array_sort(F.concat(*[own[k] for k in KINDS[:3]]))})
    df = computed(df, {names["blocks"]: blocks_of(own["base"], F.length(own["text"]))})
    df = computed(df, {names["run"]: apart(own["run"], own["blocks"])})
    df = computed(df, {names["blocks"]: blocks_of(F.concat(own["base"], own["run"]), F.length(own["text"]))})
    df = computed(df, {names["part"]: apart(own["part"], own["blocks"])})
    every = F.array_sort(F.concat(own["base"], own["run"], own["part"]))
    packed = F.struct(*[own[k].alias(k) for k in (*KINDS[:3], "base")], every.alias("every"))
    return computed(df, {out: packed}, held.columns)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, by start, then kind."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = core.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(sample_strings(docs)))
    return found.select(
        "doc_id",
        *[F.size(F.col("spans")[k]).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed(F.col("spans.base")), 256).alias("base_sha256"),
        listed(F.col("spans.every")).alias("spans"),
    )


def mask(text: Column, spans: Column) -> Column:
    """The text with every span replaced by [SECRET]; overlapping spans become one."""
    step = lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.concat(F.array(F.substr(text, acc["at"] + 1, s["start"] - acc["at"])), F.array(F.lit("[SECRET]")))).otherwise(F.array().cast("array<string>"))).alias("out"))
    state = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step, lambda acc: F.concat(acc["out"], F.array(F.substr(text, acc["at"] + 1, F.length(text)))))
    return F.array_join(state, "")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are masked, and n_chars, where there is one, follows the new text."""
    spans = fresh(docs, "secret_spans")
    found = scan(docs, train(sample_strings(docs)), out=spans)
    held = F.size(F.col(spans)["every"]) > 0
    new = {"text": F.when(held, mask(F.col("text"), F.col(spans)["every"])).otherwise(F.col("text"))}
    changed = found.withColumns({spans: held, **new})
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col(spans), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return changed.select(*[F.col(f"`{c}`") for c in docs.columns])


QUERIES = {"op2_secret_scan": op2_secret_scan}

"""Language identification by compression.

Each language owns a zstandard raw-content dictionary: whole sample texts of
that language, concatenated. A text is encoded once with every dictionary; the
language whose encoding is smallest wins, and a narrow margin is a rejection.

Texts are normalised first: lower case, everything but letters becomes spaces,
so that digits, markup and capitals don't count for a language.

Defined cases: a null text, or one without a letter, is `und` with score 0 and
is rejected. Equal sizes go to the language with more sample rows, then to the
smaller name. Rows repeat as they come. Other columns pass through unread; the
result's columns are fixed, so clashing names in the input can't collide. Without
a single labelled row every text is `und`.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as core

#: Bounds of the fit for each language: sample rows and dictionary bytes. Every labelled language is learnt.
SAMPLE_ROWS, DICTIONARY_BYTES, LEVEL = 200, 192 << 10, 3
#: Texts below SHORT_BYTES are also encoded, by the strongest parser, with a second dictionary of this many bytes:
#: the language's commonest sample words. Short matches pay there, as their offsets are small.
SHORT_BYTES, SHORT_LEVEL, COMMON_BYTES, FILLER = 2000, 19, 3072, b" " * 96
#: A margin below this share of the smallest size is a rejection.
MIN_MARGIN = 0.0025
#: Compressed sizes of one text aren't independent evidence for each bit; this tempers them.
TEMPER = 0.05

_KEEP = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal(text: str) -> bytes:
    """Words between single spaces, with one before and after, so that a lone word can match as a whole."""
    return b" %s " % b" ".join(text.lower().encode().translate(_KEEP).split())


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionaries from about SAMPLE_ROWS rows of each language, picked by a hash of the key.

    Languages are ordered by falling number of rows, the order in which ties go.
    """
    labelled = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    counts = {r["l"]: r["n"] for r in labelled.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").collect()}
    if not counts:
        return {}
    span = 1 << 40
    share = F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, min(span, span * SAMPLE_ROWS // n))])
    mark = F.pmod(F.xxhash64("k"), F.lit(span))
    sample = labelled.filter(mark < share[F.col("l")]).select("l", "t", mark.alias("m")).limit(2 * SAMPLE_ROWS * len(counts)).collect()
    rows = sorted(((r["m"], r["l"], r["t"]) for r in sample), key=lambda r: r[:2])
    halves = [assembled(rows[i::2], counts) for i in (0, 1)]
    if all(all(h.values()) for h in halves):  # rows that the other half's dictionaries call another language are mislabelled
        judges = [classifier(h) for h in halves]
        sure = [r for i, r in enumerate(rows) if judges[1 - i % 2](r[2])[0] in (r[1], "und")]
        rows = sure if {r[1] for r in sure} == {r[1] for r in rows} else rows
    return assembled(rows, counts)


def assembled(rows: list[tuple], languages) -> dict[str, bytes]:
    """Dictionaries from (order, language, text) rows; whole texts only, those that don't fit are left out."""
    out = {}
    for l in languages:
        own = [(m, t) for m, x, t in rows if x == l]
        taken, size = [], 0
        for _, t in own:
            piece = normal(t)
            if taken and size + len(piece) > DICTIONARY_BYTES:
                continue
            taken.append(piece)
            size += len(piece)
        out[l] = b"\n".join(taken)
    return out


def common(content: bytes) -> bytes:
    """The commonest words of a dictionary, up to COMMON_BYTES; the commonest last, nearest to the text."""
    taken, size = [], 0
    for w, _ in sorted(Counter(content.split()).items(), key=lambda x: (-x[1], x[0])):
        if size + len(w) + 1 > COMMON_BYTES:
            break
        taken.append(w)
        size += len(w) + 1
    return b" %s " % b" ".join(reversed(taken))


def packer(content: bytes, level: int) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)


def classifier(dictionaries: dict[str, bytes]):
    """text -> (language, score, margin); sizes are of whole texts."""
    packers = []
    for l, content in dictionaries.items():
        if len(content) >= 8:
            packers.append((l, packer(content, LEVEL), packer(common(content), SHORT_LEVEL)))

    def classify(text: str | None) -> tuple[str, float, float]:
        if not text or not packers or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0
        raw = normal(text)
        short = len(raw) < SHORT_BYTES
        if short:  # a tail of spaces, else the encoder stores a tiny text as it is, at equal size everywhere
            raw += FILLER
        sizes = [len(p.compress(raw)) + (len(q.compress(raw)) if short else 0) for _, p, q in packers]
        best = min(sizes)
        at = sizes.index(best)
        weight = [math.exp(-min(700.0, TEMPER * 8 * math.log(2) * (s - best))) for s in sizes]
        rest = [s for i, s in enumerate(sizes) if i != at]
        return packers[at][0], 1 / sum(weight), (min(rest) - best) / best if rest else 1.0

    return classify


def identify(docs: DataFrame, dictionaries: dict[str, bytes], key: str = "doc_id", text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """key, lang_pred, score, margin, rejected - one row for each row of docs."""
    core.ship(docs.sparkSession)
    bag = docs.sparkSession.sparkContext.broadcast(dictionaries)  # a dictionary of bounded size for each language

    def run(batches):
        classify = classifier(bag.value)
        for b in batches:
            got = [classify(t.as_py()) for t in b.column(1)]
            lang, score, margin = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array([l == "und" or m < min_margin for l, m in zip(lang, margin)], pa.bool_())],
                names=[key, "lang_pred", "score", "margin", "rejected"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double, margin double, rejected boolean")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(core.crc_mod("doc_id", 3) != 1)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = core.table(spark, sf_dir, "documents")
    found = identify(docs, fit(training_rows(docs)))
    return found.select("doc_id", F.coalesce(core.crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows whose language is told apart, with all their columns; rejected ones go, in one pass."""
    dictionaries = fit(training_rows(docs))
    core.ship(spark)
    bag = spark.sparkContext.broadcast(dictionaries)

    def run(batches):
        classify = classifier(bag.value)
        for b in batches:
            at = b.schema.get_field_index("text")
            keep = [(l != "und" and m >= MIN_MARGIN) for l, _, m in (classify(t.as_py()) for t in b.column(at))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


QUERIES = {"op7_language_id": op7_language_id}

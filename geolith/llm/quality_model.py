"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Labels come only from rows whose crc32(doc_id as text) modulo 5 is not 0, and of those from at most ``SAMPLE`` rows, the ones with the
smallest hash of doc_id: the one bounded sample here. Their statistics (28 numbers a row) go to the driver, which fits the trees; the
flat arrays of the trees, some ten thousand numbers whatever the input, go to the tasks that score every document. Text is the only
input of a score; doc_id, lang, source and labels are not.

Defined results: a null text scores as the empty text; rows with a null doc_id are scored and not held out; of several labels of one doc_id the
smallest counts, null labels do not; without labels of both kinds every score is the share of label 1 (without any, 0.5); an empty
table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import extended
from .boosting import Trees, fit
from .common import table

SAMPLE = 20_000
THRESHOLD = 0.3
HELD_OUT = 5

_KINDS = ("letter", "upper", "digit", "space", "newline", "symbol", "exclaim", "stop", "comma", "other", "wide", "pipe", "control")


def _kind_table() -> np.ndarray:
    kinds = np.zeros((len(_KINDS), 256), np.uint8)

    def mark(kind: str, chars: bytes) -> None:
        kinds[_KINDS.index(kind), list(chars)] = 1

    mark("letter", bytes(range(65, 91)) + bytes(range(97, 123)))
    mark("upper", bytes(range(65, 91)))
    mark("digit", b"0123456789")
    mark("space", b" ")
    mark("newline", b"\n")
    mark("symbol", b"#*$%&<>@^~=+_\\/{}[]")
    mark("exclaim", b"!?")
    mark("stop", b".;:")
    mark("comma", b",")
    mark("other", b"\"'()-`")
    mark("wide", bytes(range(128, 256)))
    mark("pipe", b"|")
    mark("control", bytes([*range(9), *range(11, 32), 127]))
    return kinds


_TABLE = _kind_table()


def statistics(text: str | None) -> np.ndarray:
    """What the trees see of a text; finite for every text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = _TABLE @ count / n
    words = raw.split()
    k = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    seen = Counter(words)
    top = seen.most_common(1)[0][1] if seen else 0
    pairs = len(set(zip(words, words[1:], strict=False))) if len(words) > 1 else 0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines)) if lines else np.zeros(1, np.int64)
    p = count[count > 0] / n
    first = sum(w[:1].isupper() for w in words)
    upper = sum(w.isupper() for w in words)
    return np.array(
        [
            *shares, np.log1p(len(words)), np.log1p(len(raw)), lengths.mean(), lengths.std(), lengths.max(), (lengths <= 3).mean(), len(seen) / k, top / k, pairs / max(len(words) - 1, 1),
            np.log1p(len(lines)), 1 - len(set(lines)) / max(len(lines), 1), sizes.mean(), -(p * np.log2(p)).sum(), first / k, upper / k,
        ]
    )


def _features(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in texts]).reshape(len(texts), -1)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, quality and statistics of the labelled rows that the trees learn from."""
    learn = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(HELD_OUT)) != 0
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(learn).groupBy("doc_id").agg(F.min("quality").cast("int").alias("g_quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "g_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("g_quality"), pa.array(list(_features(b.column("text"))), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("g_id")).drop("g_id")  # at most ``sample`` rows
    measured = rows.mapInArrow(measure, "doc_id long, quality int, x array<double>")
    return measured.groupBy("doc_id", "quality").agg(F.min("x").alias("x"))  # of rows that repeat a doc_id, the first in order


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    rows = sorted((r["doc_id"], r["quality"], tuple(r["x"])) for r in training_rows(docs, labels, sample).collect())  # at most ``sample`` rows
    x = np.array([r[2] for r in rows]) if rows else np.zeros((0, 0))
    return fit(x, np.array([r[1] for r in rows], float))


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """docs with g_score, a double from 0 to 1 (a column of that name is replaced)."""
    docs = docs.drop("g_score")
    schema = extended(docs.schema, (), "g_score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(_features(b.column("text"))) if b.num_rows else [], pa.float64())], schema.names)

    return docs.mapInArrow(run, schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(HELD_OUT)) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("g_score").alias("score"), (F.col("g_score") >= THRESHOLD).cast("int").alias("predicted"))

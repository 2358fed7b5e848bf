"""Substring dedup by Rabin-Karp: hashes of every fixed-length word window, counted in Spark.

Every window of ``length`` words of a document gets two rolling hashes over two independent hashes of each word: one modulo 2**64
(64 bits), one modulo a prime (31 bits). These 95 bits decide which windows are equal. Windows without a repeated anchor (module ``anchors``) cannot occur twice and are not shipped. Spark groups the others by hash, takes the smallest
doc_id of each, and joins it back; a window that a smaller doc_id has too is repeated, and repeated windows merge into maximal
intervals of words to remove. The grouping pre-aggregates in each task, and the join back is one that Spark can split at a hot key,
so a passage in a third of the documents is no bottleneck. Whole texts that a smaller doc_id has are settled by their SHA-256.

Defined results: a null or empty text has no words; texts under ``length`` words keep all; rows with a null doc_id keep all and
remove nothing elsewhere; rows that repeat a doc_id never remove from one another; an empty table gives no rows; columns of
documents pass through under their own names, but for those named as the added ones: n_words, n_removed, n_spans and kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import copies, extended, is_copy, numbers, repeated_anchors, rolling, rolling_prime, text_bytes, with_copies, word_pairs
from .common import shielded, table, unshielded

LENGTH = 50
ANCHOR = 8


def intervals(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals that runs of ``length`` at the starts cover."""
    s = np.unique(starts)
    if not len(s):
        return s, s
    new = np.append(True, s[1:] > s[:-1] + length)
    return s[new], s[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)] + length


def _candidates(docs: DataFrame, length: int, k: int) -> DataFrame:
    """One row per window that holds a repeated anchor: h1, h2, doc_id, at (upper half: of the text hash, lower half: start)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            skip, anchors = is_copy(batch), batch.column("g_at")
            valid = anchors.is_valid().to_numpy(zero_copy_only=False) & ~skip
            lists = np.flatnonzero(valid)
            if not len(lists):
                continue
            ids, tags = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("g_tag").to_numpy()
            for part in np.array_split(lists, len(lists) // 256 + 1):
                values, others, at = word_pairs(*text_bytes(batch.column("g_text").take(pa.array(part))))
                out = []
                for i, row in enumerate(part):
                    v = values[at[i] : at[i + 1]]
                    n = len(v) - length + 1
                    if n < 1:
                        continue
                    mark = np.zeros(n + 1, np.int32)
                    p = numbers(anchors[int(row)])
                    p = p[p <= len(v) - k]
                    np.add.at(mark, np.minimum(np.maximum(p - length + k, 0), n), 1)
                    np.add.at(mark, np.minimum(p + 1, n), -1)
                    s = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                    first, second = rolling(v, length)[s], rolling_prime(others[at[i] : at[i + 1]], length)[s]
                    place = (int(tags[row]) & 0xFFFFFFFF) << 32
                    place -= (place >> 63) << 64
                    out.append((first.view(np.int64), second.astype(np.int32), np.full(len(s), ids[row], np.int64), s + place))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["h1", "h2", "g_id", "g_place"])

    return docs.mapInArrow(scan, "h1 long, h2 int, g_id long, g_place long")


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """docs with n_words, n_removed, n_spans and kept (the kept words joined by a space)."""
    docs, names = shielded(docs, ("n_words", "n_removed", "n_spans", "kept"))
    copied = copies(docs)
    texts = with_copies(docs, copied)
    anchors = repeated_anchors(texts, k, length, words=True)
    windows = _candidates(texts.join(anchors, F.col("doc_id") == F.col("g_id"), "left").drop("g_id"), length, k)
    first = windows.groupBy("h1", "h2").agg(F.min("g_id").alias("g_first"), F.max("g_id").alias("g_last")).where("g_first < g_last")
    # joined by the complement of the hash, both sides are dealt anew by plain exchanges, which Spark can split at a hot window
    first = first.select(F.bitwise_not("h1").alias("g_not"), F.col("h2").alias("g_h2"), "g_first")
    repeated = windows.join(first, (F.bitwise_not("h1") == F.col("g_not")) & (F.col("h2") == F.col("g_h2"))).where("g_id > g_first")
    marks = repeated.groupBy("g_id").agg(F.collect_list("g_place").alias("g_marks"))
    joined = texts.join(marks, F.col("doc_id") == F.col("g_id"), "left").drop("g_id")
    inner = ("g_text", "g_tag", "g_copies", "g_marks")
    schema = extended(joined.schema, inner, "n_words long, n_removed long, n_spans long, kept string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            skip, marks, tags = is_copy(batch), batch.column("g_marks"), batch.column("g_tag").to_numpy()
            out = []
            for i, text in enumerate(batch.column("g_text")):
                w = text.as_py().encode("utf-8", "surrogatepass").split()
                if skip[i] and len(w) >= length:
                    out.append((len(w), len(w), 1, ""))
                    continue
                place = marks[i].values.to_numpy() if marks[i].is_valid else np.zeros(0, np.int64)
                a, b = intervals(place[((place >> 32) & 0xFFFFFFFF) == (int(tags[i]) & 0xFFFFFFFF)] & 0xFFFFFFFF, length)
                edges = [0, *(int(x) for ab in zip(a, b, strict=True) for x in ab), len(w)]
                kept = [x for lo, hi in zip(edges[::2], edges[1::2], strict=True) for x in w[lo:hi]]
                out.append((len(w), len(w) - len(kept), len(a), b" ".join(kept).decode("utf-8", "surrogatepass")))
            passed = [batch.column(f.name) for f in schema.fields[:-4]]
            yield pa.RecordBatch.from_arrays([*passed, *(pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], schema.names)

    return unshielded(joined.mapInArrow(cut, schema), names)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
f AS (SELECT g, min(doc_id) AS d FROM g GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
s AS (SELECT doc_id, i FROM g JOIN f USING (g) WHERE doc_id > d),
o AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM s),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o),
v AS (SELECT doc_id, list({'a': a, 'b': b} ORDER BY a) AS v FROM (SELECT doc_id, k, min(i) AS a, max(i) + 49 AS b FROM n GROUP BY 1, 2) GROUP BY 1),
k AS (SELECT doc_id, w, v, CASE WHEN v IS NULL THEN w ELSE flatten(list_transform(range(0, len(v) + 1), lambda j: w[CASE WHEN j = 0 THEN 1 ELSE v[j].b + 1 END:CASE WHEN j = len(v) THEN len(w) ELSE v[j + 1].a - 1 END])) END AS kept
  FROM w LEFT JOIN v USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(kept) AS BIGINT) AS n_removed, CAST(coalesce(len(v), 0) AS BIGINT) AS n_spans, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

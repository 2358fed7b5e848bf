"""Suffix-array dedup: bytes in strings of ``length`` bytes that a smaller doc_id has too are removed, by induced sorting.

A run of ``length`` bytes can only repeat if its anchors do (module ``anchors``), so only the surroundings of repeated anchors
(at most ``2 * length - k`` bytes, all runs that hold the anchor) go into suffix arrays. They are dealt to shards by anchor: all
equal runs meet in one shard. A shard joins its distinct contexts with separators, builds its suffix array by induced sorting
and the permuted common prefixes; neighbours with a common prefix of ``length`` or more are one string, whose smallest doc_id
decides for all its places. Comparison is byte by byte; only whole texts that a smaller doc_id has are settled by a hash, their SHA-256,
pre-aggregated in each task. A shard splits into arrays of bounded size between anchors, so memory follows the fullest anchor. Of equal contexts in a task only those of the smallest document are shipped, as
the others are decided by it: a passage in a third of all documents costs a shard its distinct contexts once per task.

Defined results: a null text is empty; texts under ``length`` bytes keep all; rows with a null doc_id keep all and remove nothing
elsewhere; rows that repeat a doc_id never remove from one another; an empty table gives no rows; columns of documents pass
through under their own names, but for those named as the added ones: n_bytes, n_removed, n_spans and kept (binary).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import BUCKETS, bucket_of, copies, dealt, extended, gathered, is_copy, mix, numbers, pack, pack_ids, repeated_anchors, runs, text_bytes, unpack, unpack_ids, with_copies
from .anchors import _BYTE as BYTE_VALUES
from .common import partitions, shielded, table, unshielded
from .substring_dedup import intervals
from .suffix_array import permuted_prefixes, suffix_array

LENGTH = 50
ANCHOR = 20
#: Bytes of contexts that one suffix array holds, unless a single anchor has more.
SHARD = 1 << 21


def _contexts(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Packed contexts of repeated anchors, a row per (task, bucket)."""
    buckets = min(BUCKETS, 2 * partitions(docs.sparkSession))
    document_buckets = min(BUCKETS, partitions(docs.sparkSession))
    reach, width = length - k, 2 * length - k

    def emit(held: list) -> Iterator[pa.RecordBatch]:
        key, doc, tag, place, left, size, wide = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        wide[np.arange(width) >= size[:, None]] = 0
        order, group = like_contexts(left, size, wide)
        least = np.minimum.reduceat(doc[order], runs(group))[group]
        beaten = order[doc[order] > least]  # a smaller document here has the same context, so all its runs go
        if len(beaten):
            first = reach - left[beaten].astype(np.int64)
            bits = ((np.int64(1) << (size[beaten].astype(np.int64) - length + 1)) - 1) << first
            sure = dealt(doc[beaten], {"tag": tag[beaten], "place": place[beaten], "bytes": bits}, document_buckets)
            none = pa.nulls(sure.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([sure.column("bucket"), none, sure.column("doc"), sure.column("tag"), sure.column("place"), none, none, sure.column("bytes")], ["bucket", "key", "doc", "tag", "place", "left", "size", "bytes"])
        order = order[doc[order] == least]
        order = order[np.argsort(key[order], kind="stable")]  # equal anchors, and so like contexts, side by side: they compress
        bucket = bucket_of(key, buckets)
        starts = runs(bucket[order])
        inside = np.arange(width) < size[:, None]
        rows = []
        for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True):
            o = order[a:b]
            rows.append((int(bucket[o[0]]), pack(key[o]), pack_ids(doc[o]), pack(tag[o]), pack(place[o].astype("<u4")), left[o].tobytes(), size[o].tobytes(), pa.compress(wide[o][inside[o]].tobytes(), "zstd", asbytes=True)))
        names = ["bucket", "key", "doc", "tag", "place", "left", "size", "bytes"]
        for i in range(0, len(rows), 32):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "bucket" else pa.binary()) for n, c in zip(names, zip(*rows[i : i + 32], strict=True), strict=True)], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            anchors = batch.column("g_at")
            valid = np.flatnonzero(anchors.is_valid().to_numpy(zero_copy_only=False) & ~is_copy(batch))
            if not len(valid):
                continue
            ids, tags = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("g_tag").to_numpy()
            for part in np.array_split(valid, len(valid) // 512 + 1):
                chosen = [numbers(anchors[int(i)]) for i in part]
                buf, at = text_bytes(batch.column("g_text").take(pa.array(part)))
                doc = np.repeat(np.arange(len(part)), [len(c) for c in chosen])
                place = np.concatenate(chosen)
                fits = place + k <= np.diff(at)[doc]  # positions of another text of the same doc_id may not
                doc, place = doc[fits], place[fits]
                for a in range(0, len(doc), 1 << 15):
                    d, p = doc[a : a + (1 << 15)], place[a : a + (1 << 15)]
                    lo = np.maximum(p - reach, 0)
                    hi = np.minimum(p + length, np.diff(at)[d])
                    full = hi - lo >= length
                    d, p, lo, hi = d[full], p[full], lo[full], hi[full]
                    wide = buf[np.minimum((at[d] + lo)[:, None] + np.arange(width), len(buf) - 1)]
                    grams = (at[d] + p)[:, None] + np.arange(k)
                    key = _gram_keys(buf[grams])
                    held.append((key, ids[part][d].astype(np.int64), (tags[part][d] & 0xFFFFFFFF).astype("<u4"), p, (p - lo).astype(np.uint8), (hi - lo).astype(np.uint8), wide))
                    n += len(d)
                    if n > 1 << 19:
                        yield from emit(held)
                        n = 0
        if held:
            yield from emit(held)

    return docs.mapInArrow(scan, "bucket int, key binary, doc binary, tag binary, place binary, left binary, size binary, bytes binary")


def _gram_keys(grams: np.ndarray) -> np.ndarray:
    """Keys of equal-sized byte strings, one a row."""
    out = np.zeros(len(grams), np.uint64)
    for c in range(grams.shape[1]):
        out = out * np.uint64(0x9E3779B97F4A7C15) + BYTE_VALUES[grams[:, c]]
    return mix(out)


def like_contexts(left: np.ndarray, size: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): contexts in an order that puts equal ones together, and the number of each one's group there. Bytes decide."""
    order = np.argsort(_gram_keys(wide) + left.astype(np.uint64) * np.uint64(257) + size, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = (left[order[1:]] != left[order[:-1]]) | (size[order[1:]] != size[order[:-1]]) | (wide[order[1:]] != wide[order[:-1]]).any(1)
    return order, np.cumsum(new) - 1


def shard_marks(doc: np.ndarray, left: np.ndarray, size: np.ndarray, wide: np.ndarray, length: int, reach: int) -> np.ndarray:
    """For each context, bit i set if the run that starts i bytes past (anchor - reach) also occurs for a smaller doc."""
    width = wide.shape[1]
    wide = np.where(np.arange(width) < size[:, None], wide, 0).astype(np.uint8)
    order, group = like_contexts(left, size, wide)
    heads = runs(group)
    of = np.zeros(len(order), np.int64)
    of[order] = group  # each context's distinct one
    least = np.minimum.reduceat(doc[order], heads)
    left, size, wide = left[order[heads]].astype(np.int64), size[order[heads]].astype(np.int64), wide[order[heads]]
    lines = np.zeros((len(heads), width + 1), np.uint16)
    lines[:, :width] = wide
    lines += 2
    lines[np.arange(len(heads)), size] = 1
    keep = np.arange(width + 1) <= size[:, None]
    text = np.append(lines[keep], 0).astype(np.uint16)
    begin = np.cumsum(size + 1) - size - 1
    order = suffix_array(text, 258, length + 2)
    prefix = permuted_prefixes(text, order, begin, width + 1)
    which = np.repeat(np.arange(len(heads)), size + 1)
    order = order[order < len(which)]
    rest = (begin + size)[which] - np.arange(len(which))  # bytes up to the separator
    new = prefix[order] < length
    if len(new):
        new[0] = True
    starts = np.flatnonzero(new)
    smallest = np.repeat(np.minimum.reduceat(least[which[order]], starts), np.diff(np.append(starts, len(order))))
    decided = np.full((len(heads), reach + 1), np.iinfo(np.int64).max)
    fits = rest[order] >= length
    at, w = order[fits], which[order[fits]]
    decided[w, at - begin[w] + reach - left[w]] = smallest[fits]
    bits = np.int64(1) << np.arange(reach + 1, dtype=np.int64)
    marks = np.zeros(len(doc), np.int64)
    for a in range(0, len(doc), 1 << 16):
        marks[a : a + (1 << 16)] = ((decided[of[a : a + (1 << 16)]] < doc[a : a + (1 << 16), None]) * bits).sum(1)
    return marks


def _decide(packed: DataFrame, length: int, k: int) -> DataFrame:
    """g_id and, for each context with something to remove, lower text hash, anchor position and bits of the runs (32 bits each)."""
    reach, width = length - k, 2 * length - k
    buckets = min(BUCKETS, partitions(packed.sparkSession))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        found: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["key"] is None:  # decided where it came from
                    found.append((unpack_ids(row["doc"]), *(unpack(row[n], "<u4") for n in ("tag", "place", "bytes"))))
                else:
                    parts.setdefault(row["bucket"], []).append(row)
        while parts:
            rows = parts.popitem()[1]
            key, tag, place = (np.concatenate([unpack(r[n], t) for r in rows]) for n, t in (("key", "<u8"), ("tag", "<u4"), ("place", "<u4")))
            doc = np.concatenate([unpack_ids(r["doc"]) for r in rows])
            left, size = (np.concatenate([np.frombuffer(r[n], np.uint8) for r in rows]) for n in ("left", "size"))
            data = np.concatenate([np.frombuffer(pa.decompress(r["bytes"], int(np.frombuffer(r["size"], np.uint8).sum()), "zstd", asbytes=True), np.uint8) for r in rows])
            begin = np.cumsum(size.astype(np.int64)) - size
            rows = None
            order = np.argsort(key, kind="stable")
            key = key[order]
            starts = runs(key)
            ends = np.append(starts[1:], len(key))
            a = 0
            while a < len(starts):  # whole anchors, up to SHARD bytes
                b = max(a + 1, int(np.searchsorted(ends, starts[a] + SHARD // width, "right")))
                o = order[starts[a] : ends[b - 1]]
                a = b
                wide = data[np.minimum(begin[o][:, None] + np.arange(width), len(data) - 1)]
                marks = shard_marks(doc[o], left[o], size[o], wide, length, reach)
                o, marks = o[marks > 0], marks[marks > 0]
                if len(o):
                    found.append((doc[o], tag[o], place[o], marks.astype(np.uint32)))
        if found:  # 20 bytes a mark, once per task, so that rows are as many as (task, bucket) pairs
            doc, tag, place, marks = map(np.concatenate, zip(*found, strict=True))
            yield dealt(doc, {"g_tag_low": tag, "g_place": place, "g_bits": marks}, buckets)

    solved = packed.repartition("bucket").mapInArrow(solve, "bucket int, doc binary, g_tag_low binary, g_place binary, g_bits binary")
    return gathered(solved, ["g_tag_low", "g_place", "g_bits"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept; runs that hold an anchor must number 32 or fewer."""
    if length - k > 31:
        raise ValueError("length - k is over 31")
    docs, names = shielded(docs, ("n_bytes", "n_removed", "n_spans", "kept"))
    copied = copies(docs)
    texts = with_copies(docs, copied)
    anchors = repeated_anchors(texts, k, length, words=False)
    packed = _contexts(texts.join(anchors, F.col("doc_id") == F.col("g_id"), "left").drop("g_id"), length, k)
    marks = _decide(packed, length, k)
    joined = texts.join(marks, F.col("doc_id") == F.col("g_id"), "left").drop("g_id")
    schema = extended(joined.schema, ("g_text", "g_tag", "g_copies", "g_tag_low", "g_place", "g_bits"), "n_bytes long, n_removed long, n_spans long, kept binary")
    reach = length - k

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            skip, tags = is_copy(batch), batch.column("g_tag").to_numpy() & 0xFFFFFFFF
            low, places, marks = (batch.column(c) for c in ("g_tag_low", "g_place", "g_bits"))
            out = []
            for i, text in enumerate(batch.column("g_text")):
                raw = text.as_buffer().to_pybytes()
                if skip[i] and len(raw) >= length:
                    out.append((len(raw), len(raw), 1, b""))
                    continue
                if not marks[i].is_valid:
                    out.append((len(raw), 0, 0, raw))
                    continue
                mine = numbers(low[i]) == tags[i]
                place, bits = numbers(places[i])[mine], numbers(marks[i])[mine]
                row, bit = np.nonzero((bits[:, None] >> np.arange(reach + 1)) & 1)
                a, b = intervals(place[row] - reach + bit, length)
                edges = [0, *(int(x) for ab in zip(a, b, strict=True) for x in ab), len(raw)]
                kept = b"".join(raw[lo:hi] for lo, hi in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(raw), len(raw) - len(kept), len(a), kept))
            passed = [batch.column(f.name) for f in schema.fields[:-4]]
            yield pa.RecordBatch.from_arrays([*passed, *(pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], schema.names)

    return unshielded(joined.mapInArrow(cut, schema), names)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM t)),
f AS (SELECT g, min(doc_id) AS d FROM g GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
s AS (SELECT doc_id, i FROM g JOIN f USING (g) WHERE doc_id > d),
o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM s),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o),
v AS (SELECT doc_id, list({'a': a, 'b': b} ORDER BY a) AS v FROM (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY 1, 2) GROUP BY 1),
k AS (SELECT doc_id, h, v, CASE WHEN v IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(v) + 1), lambda j:
  substr(h, 2 * CASE WHEN j = 0 THEN 0 ELSE v[j].b END + 1, 2 * (CASE WHEN j = len(v) THEN length(h) // 2 ELSE v[j + 1].a END - CASE WHEN j = 0 THEN 0 ELSE v[j].b END))), '') END AS kept
  FROM t LEFT JOIN v USING (doc_id))
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST((length(h) - length(kept)) // 2 AS BIGINT) AS n_removed, CAST(coalesce(len(v), 0) AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM k
"""

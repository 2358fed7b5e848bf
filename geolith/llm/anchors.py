"""Candidate search for repeated token strings, shared by the two substring operators.

Of every run of ``length`` tokens (bytes or words) the ``k``-token strings with the smallest hash are its anchors (window
minimizers). Two equal runs have equal anchors at equal places, so a run can only repeat in another document if each of its
anchors occurs there: the search for anchors that occur in two documents loses no repeat. About 2 in (length - k + 2) tokens
are anchors; they travel packed, a binary row per (task, bucket), about ten bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions

#: Tokens that one numpy step handles; longer documents go in pieces that overlap by a run.
PIECE = 1 << 18
#: Anchors that a task holds before it writes them out.
FLUSH = 1 << 21
#: Words up to so many bytes are hashed together, longer ones one by one.
LONG = 128
#: Buckets that keys or doc_ids are dealt to at most.
BUCKETS = 1 << 24
_U = np.uint64
_BREAK = np.zeros(256, bool)
_BREAK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) | _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as far as they were needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up, self.down = (np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64)))) for b in (_U(self.base), _U(self.inverse)))
        return self.up, self.down


_POWERS = Powers(_BASE)


def rolling(values: np.ndarray, k: int, powers: Powers = _POWERS) -> np.ndarray:
    """Rabin-Karp hashes of all strings of k values: differences of prefix polynomials, scaled back."""
    n = len(values)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers.to(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=prefix[1:])
    return mix((prefix[k:] - prefix[:-k]) * down[: n - k + 1])


#: A prime, so that in arithmetic modulo it no string of values has a power of two in its polynomial.
PRIME = (1 << 31) - 1


class PrimePowers:
    """Powers modulo ``PRIME`` of a base and of its inverse, as far as they were needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, PRIME)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            self.up, self.down = (np.concatenate((x, x * _U(pow(b, len(x), PRIME)) % _U(PRIME))) for x, b in ((self.up, self.base), (self.down, self.inverse)))
        return self.up, self.down


_PRIME_POWERS = PrimePowers(5**13)


def rolling_prime(values: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hashes modulo ``PRIME`` of all strings of k values."""
    n = len(values)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _PRIME_POWERS.to(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values % _U(PRIME) * up[:n] % _U(PRIME), out=prefix[1:])
    return (prefix[k:] - prefix[:-k]) % _U(PRIME) * down[: n - k + 1] % _U(PRIME)


def word_spans(buf: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in buf, which also end at the edges between documents."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_BREAK[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    inner = edges[(edges > 0) & (edges < len(buf))]
    first[inner] = inside[inner]
    last[inner - 1] = inside[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each word: its pieces of eight bytes are mixed in one after another, so words of one length that differ in one
    piece never meet, and no polynomial identity of the bytes makes others meet. Words over ``LONG`` bytes go through XXH3."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * _U(0xD6E8FEB86659FD93) + _U(seed * _BASE % 2**64))
    eight = np.ndarray(len(buf) + 1, "<u8", np.concatenate((buf, np.zeros(8, np.uint8))), strides=(1,))  # the eight bytes from each place on
    live, step = np.flatnonzero(size <= LONG), 0
    while len(live):
        left = np.minimum(size[live] - step, 8).astype(np.uint64)
        piece = eight[starts[live] + step] & (_U(2**64 - 1) >> (_U(64) - left * _U(8)))
        out[live] = mix(out[live] * _U(0x9FB21C651E98DF25) ^ piece)
        step += 8
        live = live[size[live] > step]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes(), seed)
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each value starts in them (one more entry than values)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, at - at[0]


def tokens(buf: np.ndarray, at: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """One value per token of the documents that start at ``at``, and where each document's tokens start."""
    if not words:
        return buf, at
    starts, ends = word_spans(buf, at)
    return word_hashes(buf, starts, ends), np.searchsorted(starts, at)


def word_pairs(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As tokens, with two independent values per word."""
    starts, ends = word_spans(buf, at)
    return word_hashes(buf, starts, ends), word_hashes(buf, starts, ends, 1), np.searchsorted(starts, at)


def _slide(op, a: np.ndarray, w: int) -> np.ndarray:
    done = 1
    while 2 * done <= w:
        a = op(a[:-done], a[done:])
        done *= 2
    return op(a[: -(w - done)], a[w - done :]) if w > done else a


def _pieces(at: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first document, last + 1, first token, last + 1): whole documents together, or a piece of a long one."""
    a = 0
    while a + 1 < len(at):
        b = max(a + 1, int(np.searchsorted(at, at[a] + PIECE, "right")) - 1)
        if at[b] - at[a] <= 2 * PIECE:
            yield a, b, int(at[a]), int(at[b])
        else:
            for lo in range(int(at[a]), int(at[b]), PIECE):
                yield a, b, lo, min(lo + PIECE + length - 1, int(at[b]))
        a = b


def anchor_positions(values: np.ndarray, at: np.ndarray, k: int, length: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, position in it) of the anchors of the wanted documents."""
    hashes, docs, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b, lo, hi in _pieces(at, length):
        if hi - lo < length or not wanted[a:b].any():
            continue
        v = values[lo:hi]
        h = np.maximum(rolling(_BYTE[v] if v.dtype == np.uint8 else v, k), _U(1))
        w = length - k + 1
        least = _slide(np.minimum, h, w)  # of each run, by its start
        edges = np.clip(at[a : b + 1] - lo, 0, hi - lo)
        off = np.zeros(len(least) + 1, np.int32)  # runs that cross into another document or belong to one not wanted
        begin = np.where(wanted[a:b], np.maximum(edges[:-1], edges[1:] - length + 1), edges[:-1])
        np.add.at(off, np.minimum(begin, len(least)), 1)
        np.add.at(off, np.minimum(edges[1:], len(least)), -1)
        least[np.cumsum(off[:-1]) > 0] = 0
        pad = np.zeros(w - 1, np.uint64)
        most = _slide(np.maximum, np.concatenate((pad, least, pad)), w)
        found = np.flatnonzero(most == h)
        doc = np.searchsorted(at, found + lo, "right") - 1
        hashes.append(mix(h[found] + _U(_BASE)))
        docs.append(doc)
        places.append(found + lo - at[doc])
    return np.concatenate(hashes), np.concatenate(docs), np.concatenate(places)


def pack(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes: first all lowest bytes. Upper planes of small numbers compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unpack(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack_ids(ids: np.ndarray) -> bytes:
    return pack(np.diff(ids, prepend=ids.dtype.type(0)).astype("<i8"))


def unpack_ids(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<i8"))


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of the (ordered) keys starts."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def witnesses(group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of entries in order of their group, those to ship: one of the smallest and one of the largest document of each group that
    several documents share, and all of a group of one document. The rest repeat, which needs no other task to tell, so what a
    task ships of a group does not grow with the group."""
    starts = runs(group)
    at = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(group))))
    least, most = np.minimum.reduceat(doc, starts), np.maximum.reduceat(doc, starts)
    ship = (least == most)[at]
    for end in (least, most):
        hit = np.flatnonzero(doc == end[at])
        ship[hit[runs(at[hit])]] = True
    return ship


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key by its upper 32 bits."""
    return ((key >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int32)


def dealt(doc: np.ndarray, columns: dict[str, np.ndarray], buckets: int) -> pa.RecordBatch:
    """Numbers (of 32 bits) about documents, packed: a row per bucket of doc_ids."""
    bucket = bucket_of(mix(doc.view(np.uint64)), buckets)
    order = np.argsort(bucket, kind="stable")
    starts = runs(bucket[order])
    cuts = list(zip(starts, np.append(starts[1:], len(order)), strict=True))
    out = [pa.array([int(bucket[order[a]]) for a, _ in cuts], pa.int32()), pa.array([pack_ids(doc[order[a:b]]) for a, b in cuts], pa.binary())]
    out += [pa.array([pack(c[order[a:b]].astype("<u4")) for a, b in cuts], pa.binary()) for c in columns.values()]
    return pa.RecordBatch.from_arrays(out, ["bucket", "doc", *columns])


def gathered(packed: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``dealt`` -> g_id and the columns' numbers (binary, 32 bits each): one row per document."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(unpack_ids(doc), [unpack(c, "<u4") for c in rest]) for b in batches for _, doc, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if not held:
            return
        doc = np.concatenate([d for d, _ in held])
        order = np.argsort(doc, kind="stable")
        doc = doc[order]
        values = [np.concatenate([c[i] for _, c in held])[order].astype("<u4") for i in range(len(columns))]
        starts = runs(doc)
        for a in range(0, len(starts), 10_000):
            part = np.append(starts[a : a + 10_000], starts[a + 10_000] if a + 10_000 < len(starts) else len(doc))
            at = pa.py_buffer(((part - part[0]) * 4).astype(np.int32).tobytes())
            lists = [pa.Array.from_buffers(pa.binary(), len(part) - 1, [None, at, pa.py_buffer(v[part[0] : part[-1]].tobytes())]) for v in values]
            yield pa.RecordBatch.from_arrays([pa.array(doc[part[:-1]]), *lists], ["g_id", *columns])

    ddl = ", ".join(f"{c} binary" for c in columns)
    return packed.select("bucket", "doc", *columns).repartition("bucket").mapInArrow(gather, f"g_id long, {ddl}")


def numbers(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), "<u4").astype(np.int64)


def prepared(docs: DataFrame) -> DataFrame:
    """docs with g_text (never null) and g_tag, a hash of it. Columns of docs keep their names."""
    return docs.withColumn("g_text", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("g_tag", F.xxhash64("g_text"))


def copies(docs: DataFrame) -> DataFrame:
    """g_id and g_copies: (tag, smallest doc_id) of each of its texts that a smaller doc_id has too.

    Whole texts meet through their SHA-256, pre-aggregated in each task.
    """
    keyed = prepared(docs).where("doc_id IS NOT NULL").select("doc_id", "g_tag", F.unhex(F.sha2("g_text", 256)).alias("k"))
    first = keyed.groupBy("g_tag", "k").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    first = first.select(F.bitwise_not("g_tag").alias("g_not"), F.col("k").alias("k2"), "first")  # so both sides are dealt anew, and Spark can split a large class
    later = keyed.join(first, (F.bitwise_not("g_tag") == F.col("g_not")) & (F.col("k") == F.col("k2"))).where("doc_id > first")
    return later.groupBy(F.col("doc_id").alias("g_id")).agg(F.collect_set(F.struct(F.col("g_tag").alias("tag"), F.col("first").alias("first"))).alias("g_copies"))


def with_copies(docs: DataFrame, copied: DataFrame) -> DataFrame:
    """Every use makes the same left join of the same columns, so that Spark shuffles the texts once and reads them again."""
    return prepared(docs).join(copied, F.col("doc_id") == F.col("g_id"), "left").drop("g_id")


def is_copy(batch: pa.RecordBatch) -> np.ndarray:
    """Rows whose whole text a smaller doc_id has."""
    tags, lists = batch.column("g_tag").to_pylist(), batch.column("g_copies")
    if lists.null_count == len(lists):
        return np.zeros(len(lists), bool)
    return np.array([bool(c) and any(x["tag"] == t for x in c) for t, c in zip(tags, lists.to_pylist(), strict=True)], bool)


def repeated_anchors(docs: DataFrame, k: int, length: int, words: bool) -> DataFrame:
    """docs as of with_copies -> g_id, g_at: positions (32 bits each) of anchors of first copies that occur in two documents or more."""
    spark = docs.sparkSession
    buckets, document_buckets = min(BUCKETS, 2 * partitions(spark)), min(BUCKETS, partitions(spark))

    def emit(held: list) -> Iterator[pa.RecordBatch]:
        key, doc, place = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(key, kind="stable")
        ship = np.zeros(len(key), bool)
        ship[order] = witnesses(key[order], doc[order])  # back in the order of documents, whose differences are small
        if not ship.all():  # known to repeat here; they go on as they are, without their key
            sure = dealt(doc[~ship], {"place": place[~ship]}, document_buckets)
            yield pa.RecordBatch.from_arrays([sure.column("bucket"), pa.nulls(sure.num_rows, pa.binary()), sure.column("doc"), sure.column("place")], ["bucket", "key", "doc", "place"])
        key, doc, place = key[ship], doc[ship], place[ship]
        bucket = bucket_of(key, buckets)
        order = np.argsort(bucket, kind="stable")
        key, doc, place, bucket = key[order], doc[order], place[order], bucket[order]
        starts = runs(bucket)
        rows = [(int(bucket[a]), pack(key[a:b])[: 6 * (b - a)], pack_ids(doc[a:b]), pack(place[a:b].astype("<u4"))) for a, b in zip(starts, np.append(starts[1:], len(key)), strict=True)]
        for i in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64], strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "key", "doc", "place"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = batch.column("doc_id")
            wanted = ~is_copy(batch) & ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            values, at = tokens(*text_bytes(batch.column("g_text")), words)
            key, doc, place = anchor_positions(values, at, k, length, wanted)
            if len(key):
                held.append((key, ids[doc], place))
                n += len(key)
            if n > FLUSH:
                yield from emit(held)
                n = 0
        if held:
            yield from emit(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, places, found = [], [], [], []
        for batch in batches:
            for bucket, key, doc, place in zip(*(batch.column(c).to_pylist() for c in ("bucket", "key", "doc", "place")), strict=True):
                if key is None:
                    found.append((unpack_ids(doc), unpack(place, "<u4")))
                    continue
                low = np.zeros((8, len(key) // 6), np.uint8)
                low[:6] = np.frombuffer(key, np.uint8).reshape(6, -1)
                keys.append(np.ascontiguousarray(low.T).view("<u8").ravel() | _U((bucket & 0xFFFF) << 48))  # a false meeting only makes a candidate
                docs.append(unpack_ids(doc))
                places.append(unpack(place, "<u4"))
        if keys:
            key, doc, place = map(np.concatenate, (keys, docs, places))
            keys = docs = places = None
            order = np.argsort(key)
            key, doc, place = key[order], doc[order], place[order]
            starts = runs(key)
            shared = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
            kept = np.repeat(shared, np.diff(np.append(starts, len(key))))
            found.append((doc[kept], place[kept]))
        if found:
            doc, place = map(np.concatenate, zip(*found, strict=True))
            if len(doc):
                yield dealt(doc, {"g_at": place}, document_buckets)

    packed = docs.mapInArrow(scan, "bucket int, key binary, doc binary, place binary")
    return gathered(packed.repartition("bucket").mapInArrow(meet, "bucket int, doc binary, g_at binary"), ["g_at"])


def extended(schema: T.StructType, drop: tuple[str, ...], more: str) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name not in drop] + T._parse_datatype_string(more).fields)

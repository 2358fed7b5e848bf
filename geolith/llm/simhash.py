"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, Hamming distance verified.

Fingerprint: each bit is 1 where more than half of the shingle hashes have it (word shingles of the text with A-Z lower-cased).
Equal fingerprints are one class through their smallest doc_id, so a group of copies costs one row a task.

``links`` is exact at a small distance d. A fingerprint is split into ``d + 2`` blocks; two within distance d agree on at
least two of them, so every pair of blocks is a join key. Keys with up to ``bucket`` fingerprints join and are verified pair
by pair. Fingerprints under a fuller key are not paired, since that grows with the square of the group: two of them are within
distance 2 exactly if they are both within one bit of a common value, so each is dealt to its 65 such values, and the members of
a value link to its smallest: as many links as rows, and the same components. (For d = 2; other distances pair all keys.)

``wide_links`` serves looser similarity (0.8 of five-word shingles is about 15 % of the bits): fingerprints of several hash lanes, cut into
blocks of a byte, and triples of blocks as keys (24 bits), one triple per block and pair of ``STEPS``, so that two blocks meet in at most one
triple. A differing block spoils ``3 * len(STEPS)`` of the ``len(STEPS)`` x blocks keys, so two fingerprints that differ in less than a third of
their blocks share a key for certain (21 of 64 blocks); beyond that they do by chance, at 15 % of the bits in about 98 of 100 cases. Keys with
up to ``CROWD`` fingerprints give pairs, whose distance over all lanes Spark verifies. Members of a fuller key are compared in
``linked``. These links are candidates: ``confirmed`` compares the sets of shingles of all texts that they connect, again in ``linked``, and
only pairs of Jaccard similarity ``SIMILAR`` or more link.

``linked`` finds links whose components are those of all close pairs in a group, without a task that holds the group: groups of up to ``TILE``
rows meet whole; in larger ones ``LEADERS`` rows, one after another, take the rows close to them as theirs, and only rows of different
leaders, or of none, are compared after that, in pairs of blocks of ``TILE`` rows. A group of copies that are all close to one of
them costs its size; only what no leader takes costs more.

Defined results: null and empty texts have no words and fingerprint zero; a text shorter than a shingle is one shingle; rows that
repeat a doc_id are rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, text_or_empty
from .graph import components

SEED = 42
BITS = 64
#: Hamming distance as a part of all bits that five-word shingles of Jaccard similarity 0.8 differ in, about: 0.15, and room for chance.
NEAR_PART = 0.19
LANES = 8
#: The Jaccard similarity of near copies, as a fraction.
SIMILAR = (4, 5)
#: Steps from a block to the two others of a key; all differences between the three differ.
STEPS = ((1, 3), (4, 9), (6, 13))
#: Fingerprints under one key that are paired outright: up to 1.5 pairs a row, about what comparing a key in one piece moves.
CROWD = 4
#: Rows of a group that are compared with each other at once.
TILE = 64
#: Rows of a large group that take those close to them before the rest is compared.
LEADERS = 1


def _shingle_hashes(text: str, k: int) -> np.ndarray:
    w = text.encode("utf-8", "surrogatepass").lower().split()  # lower() and split() of bytes know ASCII only
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate((ends[:1] * 0, ends[:-1]))
    cuts = map(slice, starts[: len(w) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist())
    return np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)), np.uint64, len(w) - k + 1)


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values have each bit, bit 0 first. Runs of 255 rows are summed in bytes."""
    total = np.zeros(BITS, np.int64)
    for a in range(0, len(h), 255 * 64):
        bits = np.unpackbits(h[a : a + 255 * 64].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:
            total += np.add.reduce(bits[:whole].reshape(-1, 255, BITS), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
        total += np.add.reduce(bits[whole:], axis=0, dtype=np.uint8)
    return total


def _lane(h: np.ndarray, lane: int) -> np.ndarray:
    """Lane 0 is the hashes themselves; others mix them anew."""
    if not lane:
        return h
    x = h ^ np.uint64(lane * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint_lanes(text: str | None, k: int, lanes: int = 1) -> np.ndarray:
    h = _shingle_hashes(text or "", k)
    out = np.zeros(lanes, np.uint64)
    for lane in range(lanes if len(h) else 0):
        out[lane] = np.packbits(_ones(_lane(h, lane)) * 2 > len(h), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, k: int, lanes: int = 1) -> DataFrame:
    """doc_id, tag (a hash of the text) and lanes f0, f1, ... as longs (the bits as they are, so the sign is one of them)."""
    names = [f"f{i}" for i in range(lanes)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            prints = np.array([fingerprint_lanes(x.as_py(), k, lanes) for x in texts], np.uint64).reshape(-1, lanes).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tag"), *[pa.array(prints[:, i]) for i in range(lanes)]], ["doc_id", "tag", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("tag"), text_or_empty().alias("text"))
    return rows.mapInArrow(scan, "doc_id long, tag long, " + ", ".join(f"{n} long" for n in names))


def _block_keys(f: Column, distance: int) -> list[Column]:
    """Values of each pair of the ``distance + 2`` blocks, tagged with the pair."""
    n = distance + 2
    edges = [BITS * i // n for i in range(n + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [F.struct(F.lit(i).alias("pair"), f.bitwiseAND(F.lit(signed(masks[a] | masks[b])).cast("long")).alias("value")) for i, (a, b) in enumerate(combinations(range(n), 2))]


def links(prints: DataFrame, distance: int = 2, bucket: int = 32) -> DataFrame:
    """prints: distinct f (long) -> links (a, b) between fingerprints whose components are those of all pairs within distance."""
    keyed = prints.select("f", F.explode(F.array(*_block_keys(F.col("f"), distance))).alias("key")).select("f", "key.*")
    sizes = keyed.groupBy("pair", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keyed.join(sizes, ["pair", "value"])
    small = shared.where(F.col("n") <= bucket) if distance == 2 else shared
    other = small.select("pair", "value", F.col("f").alias("g"))
    close = F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= distance
    pairs = small.join(other, ["pair", "value"]).where((F.col("f") < F.col("g")) & close).select(F.col("f").alias("a"), F.col("g").alias("b"))
    if distance != 2:
        return pairs
    crowded = shared.where(F.col("n") > bucket).select("f").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) if i < 63 else -(1 << 63)).cast("long") for i in range(BITS)])
    dealt = crowded.select("f", F.explode(F.transform(flips, lambda x: F.col("f").bitwiseXOR(x))).alias("value"))
    least = dealt.groupBy("value").agg(F.min("f").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = dealt.join(least, "value").where("f <> a").select("a", F.col("f").alias("b"))
    return pairs.unionByName(stars)


def near_classes(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, tag, f0 and component_id: the smallest doc_id that links of fingerprints within the distance reach."""
    prints = cut(fingerprints(docs, shingle))
    return _classes(prints, ["f0"], lambda kinds: links(kinds.select(F.col("f0").alias("f")), distance))


def _classes(prints: DataFrame, lanes: list[str], find) -> DataFrame:
    """prints with component_id and first_tag, the smallest tag of its texts in the class. Nodes are fingerprints or texts (by the first column), so texts that share a doc_id are not linked by it."""
    node = lanes[0]
    kinds = cut(prints.groupBy(*lanes).agg(F.min(F.struct("doc_id", "tag")).alias("g_first"))).withColumn("g_least", F.col("g_first.doc_id"))
    reached = components(find(kinds))
    label = F.coalesce("component", node).alias("g_label")
    named = kinds.join(reached, F.col(node) == F.col("node"), "left").select(*lanes, label, "g_first")
    least = named.groupBy("g_label").agg(F.min("g_first").alias("g_first")).select(F.bitwise_not("g_label").alias("g_not"), F.col("g_first.doc_id").alias("component_id"), F.col("g_first.tag").alias("first_tag"))
    keys = named.select(F.bitwise_not(node).alias("k0"), *[F.col(n).alias(f"k{i}") for i, n in enumerate(lanes) if i], "g_label")
    same = reduce(Column.__and__, [F.bitwise_not(node) == F.col("k0"), *[F.col(n) == F.col(f"k{i}") for i, n in enumerate(lanes) if i]])
    labelled = prints.join(keys, same).drop(*[f"k{i}" for i in range(len(lanes))])  # likewise at a fingerprint with many copies
    return labelled.join(least, F.bitwise_not("g_label") == F.col("g_not")).drop("g_label", "g_not")  # dealt anew, so Spark can split at a large component


def _joining(near: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) among near pairs that join all that near pairs join beyond rows of one label (a row without one has its own)."""
    _, group = np.unique(label, return_inverse=True)
    found = []
    while True:
        open_ = near & (group[:, None] != group)
        if not open_.any():
            return found
        i, j = map(int, np.unravel_index(open_.argmax(), open_.shape))
        found.append((i, j))
        group[group == group[j]] = group[i]


def _close(limit: int, data: list[bytes]) -> np.ndarray:
    """Which fingerprints are within the limit of each other."""
    f = np.frombuffer(b"".join(data), np.uint64).reshape(len(data), -1)
    return np.bitwise_count(f[:, None] ^ f).sum(2, dtype=np.int64) <= limit


def _similar(data: list[bytes]) -> np.ndarray:
    """Which sets of hashes have Jaccard similarity ``SIMILAR`` or more with each other."""
    sets = [np.frombuffer(x, np.uint64) for x in data]
    n, (part, whole) = len(sets), SIMILAR
    sizes = np.fromiter(map(len, sets), np.int64, n)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    shared = np.bincount(column, minlength=len(values)) > 1
    row, column = row[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n))
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):  # in runs of columns: long texts have many
        lo, hi = np.searchsorted(column, (a, a + 8192))
        has = np.zeros((n, 8192), np.float32)
        has[row[lo:hi], column[lo:hi] - a] = 1
        both += has @ has.T
    return (part + whole) * both >= part * (sizes[:, None] + sizes)


def _settle(near: Callable[[list[bytes]], np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without a label that are close to their group's leader get its tag as label."""
    for b in batches:
        label = b.column("label").to_pylist()
        mine: dict[int, list[int]] = {}
        for i, (known, lead) in enumerate(zip(label, b.column("lead_tag").to_pylist(), strict=True)):
            if known is None and lead is not None:
                mine.setdefault(lead, []).append(i)
        for lead, at in mine.items():
            for a in range(0, len(at), TILE):
                some = at[a : a + TILE]
                hits = near([b.column("lead_data")[some[0]].as_py(), *(b.column("data")[i].as_py() for i in some)])[0, 1:]
                for i, hit in zip(some, hits, strict=True):
                    label[i] = lead if hit else None
        yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("tag"), b.column("data"), pa.array(label, pa.int64())], ["grp", "tag", "data", "label"])


def _compare(near: Callable[[list[bytes]], np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, held = None, {}

    def done() -> pa.RecordBatch:
        tags = list(held)
        out = _joining(near([held[x][0] for x in tags]), np.array([x if held[x][1] is None else held[x][1] for x in tags])) if len(tags) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([tags[x[i]] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    for b in batches:
        for tile, tag, data, label in zip(*[b.column(c).to_pylist() for c in ("tile", "tag", "data", "label")], strict=True):
            if tile != now:
                if held:
                    yield done()
                now, held = tile, {}
            held[tag] = data, label
    if held:
        yield done()


def linked(rows: DataFrame, near: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """rows (grp, tag, data) -> links (a, b) between tags, whose components are those of all near pairs within a group."""
    rows = cut(rows.select("grp", "tag", "data").dropDuplicates(["grp", "tag"]))
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE).select(F.col("grp").alias("g_large"))
    whole = rows.join(sizes, F.col("grp") == F.col("g_large"), "left_anti").select(F.col("grp").cast("string").alias("tile"), "tag", "data", F.lit(None).cast("long").alias("label"))
    state = cut(rows.join(sizes, F.col("grp") == F.col("g_large"), "left_semi").withColumn("label", F.lit(None).cast("long")))
    tiles, given = whole, None
    if not state.isEmpty():
        for turn in range(LEADERS):
            lead = F.min(F.struct(F.xxhash64(F.lit(turn), "tag").alias("h"), "tag", "data"))
            leaders = state.where("label IS NULL").groupBy("grp").agg(lead.alias("lead")).select(F.bitwise_not("grp").alias("g_not"), F.col("lead.tag").alias("lead_tag"), F.col("lead.data").alias("lead_data"))
            led = state.join(leaders, F.bitwise_not("grp") == F.col("g_not"), "left").drop("g_not")  # dealt anew, so Spark can split at a large group
            state = cut(led.mapInArrow(partial(_settle, near), "grp long, tag long, data binary, label long"))
        given = state.where("label <> tag").select(F.col("label").alias("a"), F.col("tag").alias("b"))
        free, label = F.col("label").isNull().alias("free"), F.coalesce("label", F.lit(0).cast("long")).alias("of")
        counts = state.groupBy("grp", free, label).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("long").alias("blocks"))
        counts = counts.select(F.bitwise_not("grp").alias("c_not"), *[F.col(c).alias(f"c_{c}") for c in ("free", "of")], "blocks")
        same = (F.bitwise_not("grp") == F.col("c_not")) & (F.col("free") == F.col("c_free")) & (F.col("of") == F.col("c_of"))
        placed = state.withColumns({"free": free, "of": label}).join(counts, same).withColumn("block", F.pmod(F.xxhash64("tag"), F.col("blocks")))
        placed = placed.select("grp", "tag", "data", "label", F.struct("free", "of", "block").alias("part"))
        parts = placed.select("grp", "part").distinct()
        a, b = F.col("part"), F.col("other")
        others = parts.select(F.col("grp").alias("o_grp"), F.col("part").alias("other"))
        apart = (a["free"] != b["free"]) | (a["of"] != b["of"])
        pairs = parts.join(others, F.col("grp") == F.col("o_grp")).where((a < b) & (apart | a["free"]) | (a == b) & a["free"])
        tile = F.concat_ws("/", "grp", F.to_json(a), F.to_json(b)).alias("tile")
        ends = pairs.select("grp", tile, F.explode(F.array_distinct(F.array(a, b))).alias("part")).withColumnsRenamed({"grp": "e_grp", "part": "e_part"})
        tiles = whole.unionByName(placed.join(ends, (F.col("grp") == F.col("e_grp")) & (F.col("part") == F.col("e_part"))).select("tile", "tag", "data", "label"))
    found = tiles.repartition("tile").sortWithinPartitions("tile", "tag").mapInArrow(partial(_compare, near), "a long, b long")
    return (found.unionByName(given) if given is not None else found).distinct()


def _deal(names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per key of each fingerprint: the number of the key and three blocks in one long."""
    for b in batches:
        if not b.num_rows:
            continue
        f = np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in names], 1).astype("<i8")
        blocks = np.ascontiguousarray(f).view(np.uint8).astype(np.int64)
        n = blocks.shape[1]
        at = np.arange(n)
        for i, (x, y) in enumerate(STEPS):
            keys = blocks | blocks[:, (at + x) % n] << 8 | blocks[:, (at + y) % n] << 16 | (at + n * i) << 24
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column("tag").to_numpy(), n))], ["key", "tag"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered (key, tag) -> pairs (a, b) under keys of up to ``CROWD`` tags, and (key, tag) as (key, b) under fuller ones."""
    key, held, crowded = None, [], False
    for b in batches:
        keys, tags = b.column("key").to_numpy(), b.column("tag").to_numpy()
        cuts = [*np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist(), len(keys)] if len(keys) else [0]
        out: list[tuple] = []
        alone = np.diff(cuts) == 1
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if keys[lo] != key:
                if len(held) > 1:
                    out += [(None, x, y) for x, y in combinations(held, 2)]
                key, held, crowded = keys[lo], [], False
            if alone[i] and i + 2 < len(cuts) and not held and not crowded:
                held = [int(tags[lo])]
                continue
            for lo_ in range(lo, hi, 10_000):
                if not crowded:
                    held += tags[lo_ : min(lo_ + 10_000, hi)].tolist()
                    if len(held) > CROWD:
                        crowded = True
                        out += [(int(key), None, x) for x in held]
                        held = []
                else:
                    out += [(int(key), None, x) for x in tags[lo_ : min(lo_ + 10_000, hi)].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], ["key", "a", "b"])
    if len(held) > 1:
        out = list(combinations(held, 2))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(out), pa.int64()), *(pa.array([x[i] for x in out], pa.int64()) for i in (0, 1))], ["key", "a", "b"])


def wide_links(reps: DataFrame, lanes: int, limit: int) -> DataFrame:
    """reps (tag, f0, f1, ...) -> links (a, b) between tags, whose components are those of all pairs within ``limit`` bits that share a key."""
    names = [f"f{i}" for i in range(lanes)]
    keyed = reps.select("tag", *names).mapInArrow(partial(_deal, names), "key long, tag long")
    met = cut(keyed.repartition("key").sortWithinPartitions("key", "tag").mapInArrow(_meet, "key long, a long, b long"))
    pairs = met.where("key IS NULL").select("a", "b").distinct()
    for side in ("a", "b"):
        pairs = pairs.join(reps.select(F.col("tag").alias(f"{side}_tag"), *[F.col(n).alias(f"{side}_{n}") for n in names]), F.col(side) == F.col(f"{side}_tag"))
    far = reduce(Column.__add__, [F.bit_count(F.col(f"a_{n}").bitwiseXOR(F.col(f"b_{n}"))) for n in names])
    crowded = met.where("key IS NOT NULL").select(F.col("key").alias("grp"), F.col("b").alias("g_tag")).join(reps, F.col("g_tag") == F.col("tag"))
    data = F.concat(*[F.unhex(F.lpad(F.hex(n), 16, "0")) for n in names]).alias("data")
    fuller = linked(crowded.select("grp", "tag", data), partial(_close, limit))
    return pairs.where(far <= limit).select("a", "b").unionByName(fuller)


def confirmed(docs: DataFrame, kinds: DataFrame, candidates: DataFrame, shingle: int) -> DataFrame:
    """Candidate links between tags -> links whose components are those of all similar pairs within the candidates' components.

    A text is shipped once, as the hashes of its shingles, for the comparison.
    """
    groups = components(candidates).join(kinds.select("tag", "g_least"), F.col("node") == F.col("tag")).select("tag", "g_least", "component")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("t"), text_or_empty().alias("text"))
    mine = texts.join(groups, (F.col("t") == F.col("tag")) & F.col("doc_id").eqNullSafe(F.col("g_least"))).select(F.col("component").alias("grp"), "tag", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [np.unique(_shingle_hashes(x.as_py(), shingle)).tobytes() for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("tag"), pa.array(hashes, pa.binary())], ["grp", "tag", "data"])

    return linked(mine.mapInArrow(sets, "grp long, tag long, data binary"), _similar)


def near_classes_wide(docs: DataFrame, shingle: int = 5, lanes: int = LANES, part: float = NEAR_PART) -> DataFrame:
    """doc_id, tag, component_id and first_tag of documents whose sets of five-word shingles are at least 0.8 similar, or linked by such.

    The first document of a class has doc_id component_id and tag (hash of the text) first_tag.
    """
    names = [f"f{i}" for i in range(lanes)]
    prints = cut(fingerprints(docs, shingle, lanes))
    found = lambda kinds: confirmed(docs, kinds, wide_links(kinds, lanes, int(part * BITS * lanes)), shingle)
    return _classes(prints, ["tag", *names], found).select("doc_id", "tag", "component_id", "first_tag")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")

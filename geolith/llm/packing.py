"""Best-fit packing into bins of several permitted lengths.

Pieces of documents (whole documents, or runs of the largest length of longer ones) are dealt by hash to shards of about ``PIECES``
pieces. In a shard, larger pieces first, each goes to the open bin with the least room that takes it. If none does, a bin opens, and
the permitted lengths compete: each is filled on trial, largest pieces first, with what the shard still has to place, and the length
of least cost per token so placed wins (of equal ones the shortest). At the end every bin shrinks to the smallest permitted length that holds
its contents.

A sequence of length n costs a training step ``n * (1 + n / LINEAR) + OVERHEAD``: the linear layers, attention (its square), and what a
sequence costs whatever its length. LINEAR is the length at which attention costs as much as the linear layers, 6 x width of a model, here
of width 2,048. So short pieces open short bins while those fill well, and a longer bin only where its better fill pays for the square.

Shards are independent, so packing scales with tasks, and at this many pieces the bins that a shard leaves part full are few. A third of
all rows of one length or source is no skew: shards are dealt by (doc_id, piece, copy).

Defined results: a document without words is one piece of 0 tokens in no bin (bin_id null, bin_size 0); null doc_ids and rows that repeat
a doc_id are packed as rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, text_or_empty, words

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD = 16
LINEAR = 6 * 2048
PIECES = 50_000


def bin_cost(length: int) -> float:
    return length * (1 + length / LINEAR) + OVERHEAD


def trial_fill(room: int, counts: list[int], mask: int) -> int:
    """Tokens that a bin takes of pieces with the given counts by size, largest first. Bit s of mask: there is a piece of size s."""
    placed, size = 0, room
    while size and room:
        size = (mask & ((2 << min(size, room)) - 1)).bit_length() - 1
        if size < 1:
            break
        some = min(counts[size], room // size)
        placed += some * size
        room -= some * size
        size -= 1
    return placed


def fit_pieces(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = bin_cost) -> tuple[list[int], list[int], list[int], list[int]]:
    """sizes, falling -> bin of each piece, its offset there, and the length of each bin at its end and when it opened."""
    counts = [0] * (max(lengths) + 1)
    for s in sizes:
        counts[s] += 1
    present = sum(1 << s for s, n in enumerate(counts) if n)  # sizes still to place
    rooms: list[list[int]] = [[] for _ in counts]  # open bins by room
    mask = 0  # bit r: a bin with room r is open
    bins, offsets, used, opened = [], [], [], []
    for s in sizes:
        counts[s] -= 1
        if not counts[s]:
            present ^= 1 << s
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room = min((c for c in lengths if c >= s), key=lambda c: (cost(c) / (s + trial_fill(c - s, counts, present)), c))
            b = len(used)
            used.append(0)
            opened.append(room)
        bins.append(b)
        offsets.append(used[b])
        used[b] += s
        room -= s
        if room:
            rooms[room].append(b)
            mask |= 1 << room
    return bins, offsets, [min(c for c in lengths if c >= u) for u in used], opened


def pieces(docs: DataFrame, longest: int = max(LENGTHS)) -> DataFrame:
    """doc_id, copy, piece, start, n_tokens: a row per piece."""
    sized = docs.select("doc_id", F.size(words(text_or_empty())).cast("long").alias("n"))
    numbered = sized.groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("copies"))  # rows that repeat a doc_id
    blocks = numbered.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / 1000))))  # in two steps: no long arrays
    first = F.col("block") * 1000
    each = blocks.select("doc_id", "n", F.explode(F.sequence(first, F.least(F.col("copies") - 1, first + 999))).alias("copy"))
    cuts = F.sequence(F.lit(0).cast("long"), F.floor((F.greatest(F.col("n"), F.lit(1)) - 1) / longest))
    return each.select("doc_id", "copy", "n", F.explode(cuts).alias("piece")).select(
        "doc_id", "copy", "piece", (F.col("piece") * longest).alias("start"), F.least(F.lit(longest).cast("long"), F.col("n") - F.col("piece") * longest).alias("n_tokens")
    )


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = bin_cost, per_shard: int = PIECES) -> DataFrame:
    """doc_id, copy, piece, start, n_tokens, bin_id, bin_offset, bin_size, bin_opened (the length at opening)."""
    all_pieces = cut(pieces(docs, max(lengths)))
    shards = max(1, -(-all_pieces.count() // per_shard))
    dealt = all_pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "copy"), F.lit(shards)).cast("int"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            sizes = rows.column("n_tokens").to_pylist()
            bins, offsets, size, opened = fit_pieces([s for s in sizes if s], lengths, cost)
            empty = [None] * (len(sizes) - len(bins))  # sizes fall, so they are last
            more = [pa.array([(now << 32) + b for b in bins] + empty, pa.int64()), pa.array(offsets + empty, pa.int64()), *(pa.array([x[b] for b in bins] + [0] * len(empty), pa.int32()) for x in (size, opened))]
            for name, column in zip(("bin_id", "bin_offset", "bin_size", "bin_opened"), more, strict=True):
                rows = rows.append_column(name, column)
            yield from rows.drop_columns(["shard"]).combine_chunks().to_batches(max_chunksize=10_000)

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            a = 0
            while a < len(shard):
                if shard[a] != now:
                    if held:
                        yield from done()
                    now, held = int(shard[a]), []
                b = int(shard.searchsorted(shard[a], "right"))
                held.append(batch.slice(a, b - a))
                a = b
        if held:
            yield from done()

    ordered = dealt.repartition("shard").sortWithinPartitions("shard", F.desc("n_tokens"), "doc_id", "piece", "copy")
    return ordered.mapInArrow(place, "doc_id long, copy long, piece long, start long, n_tokens long, bin_id long, bin_offset long, bin_size int, bin_opened int")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

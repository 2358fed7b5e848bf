"""Each operator against a plain version, on documents with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from geolith.llm import anchors, chat_format, mixing, packing, quality_rules, sharding, simhash, substring_dedup, suffix_dedup, topk

from .data import documents, texts, words


def rows_of(df, *key):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r)) if not key else df.collect()


def brute_substrings(docs, tokens, length):
    first = {}
    for i, t in docs:
        if i is not None:
            w = tokens(t)
            for k in range(len(w) - length + 1):
                key = tuple(w[k : k + length]) if not isinstance(w, bytes) else w[k : k + length]
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in docs:
        w = tokens(t)
        gone = [False] * len(w)
        for k in range(len(w) - length + 1) if i is not None else ():
            key = tuple(w[k : k + length]) if not isinstance(w, bytes) else w[k : k + length]
            if first[key] < i:
                gone[k : k + length] = [True] * length
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(w), sum(gone), spans, [x for x, g in zip(w, gone, strict=True) if not g]))
    return out


def test_suffix_dedup(spark):
    got = suffix_dedup.remove_repeats(documents(spark))
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and "g_id" in got.columns and got.columns.count("kept") == 1
    want = [(i, n, g, s, bytes(k)) for i, n, g, s, k in brute_substrings([r[:2] for r in texts()], lambda t: (t or "").encode(), 50)]
    key = lambda r: (r[0] is None, r[0], r[1:])
    have = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()]
    assert sorted(have, key=lambda r: str(key(r))) == sorted(want, key=lambda r: str(key(r)))


def test_substring_dedup(spark):
    got = substring_dedup.remove_repeats(documents(spark))
    want = [(i, n, g, s, b" ".join(k).decode()) for i, n, g, s, k in brute_substrings([r[:2] for r in texts()], words, 50)]
    have = [(r.doc_id, r.n_words, r.n_removed, r.n_spans, r.kept) for r in got.collect()]
    assert sorted(map(str, have)) == sorted(map(str, want))
    assert {r.g_id for r in got.collect()} == {"mine"}


def thue_morse(n):
    return [bin(i).count("1") & 1 for i in range(n)]


def test_words_that_polynomials_confuse(spark):
    a = "".join("ab"[x] for x in thue_morse(1024))
    b = "".join("ba"[x] for x in thue_morse(1024))
    rest = " ".join(f"w{i}" for i in range(49))
    swapped = " ".join("xy"[i] for i in thue_morse(64)), " ".join("yx"[i] for i in thue_morse(64))
    rows = [(i, t, "en", "s", 1, "", "", 0) for i, t in enumerate([f"{a} {rest}", f"{b} {rest}", *swapped])]
    assert [r.n_removed for r in substring_dedup.remove_repeats(documents(spark, rows)).collect()] == [0, 0, 0, 0]


def test_word_hashes_tell_words_apart():
    r = np.random.default_rng(6)
    some = {bytes(r.integers(97, 99, int(n), dtype=np.uint8)) for n in r.integers(1, 20, 4000)} | {b"c" * n for n in range(1, 300)}
    raw = b" ".join(some)
    buf = np.frombuffer(raw, np.uint8)
    first, second, at = anchors.word_pairs(buf, np.array([0, len(buf)]))
    assert len(set(first.tolist())) == len(set(second.tolist())) == len(some) == at[-1]
    again, _ = anchors.tokens(np.frombuffer(b"x" + raw + b" y", np.uint8)[1:], np.array([0, len(buf) + 2]), True)
    assert again[:-1].tolist() == first.tolist()


def test_very_long_texts(spark):
    """Documents over two pieces, repeats across the cuts between pieces."""
    word = lambda tag, a, b: " ".join(f"{tag}{i}" for i in range(a, b))
    piece = anchors.PIECE
    long = word("a", 0, 2 * piece + 9000)
    passage = word("a", piece - 30, piece + 60)
    other = " ".join([word("b", 0, piece - 20), word("c", 0, 70), word("b", piece, 2 * piece + 50)])
    texts_ = [long, f"new {passage} end", other, f"{word('c', 0, 70)} tail", None, "", long]
    rows = [(i, t, "en", "s", 1, "", "", 0) for i, t in enumerate(texts_)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.n_spans) for r in substring_dedup.remove_repeats(documents(spark, rows)).collect()}
    n = 2 * piece + 9000
    assert got == {0: (n, 0, 0), 1: (92, 90, 1), 2: (2 * piece + 100, 0, 0), 3: (71, 70, 1), 4: (0, 0, 0), 5: (0, 0, 0), 6: (n, n, 1)}
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(documents(spark, rows)).collect()}
    assert found[0][1] == found[2][1] == found[4][0] == found[5][0] == 0 and found[6] == (len(long), len(long), 1, b"")
    assert found[1] == (len(passage) + 8, len(passage) + 2, 1, b"newend")  # the spaces beside the passage are in the long text too
    assert found[3] == (len(word("c", 0, 70)) + 5, len(word("c", 0, 70)) + 1, 1, b"tail")


@pytest.mark.parametrize("run", [suffix_dedup.remove_repeats, substring_dedup.remove_repeats, mixing.mix, sharding.hilbert_shards, simhash.near_classes, simhash.near_classes_wide, quality_rules.judge, packing.pack])
def test_empty_table(spark, run):
    assert run(documents(spark, [])).count() == 0


def test_simhash(spark):
    docs = [r for r in texts() if r[0] is not None] + [(100 + i, f"{'the same words again ' * 30}{i}", "en", "s", 1, "", "", 0) for i in range(60)]
    got = Counter((r.doc_id, r.f0 & (2**64 - 1), r.component_id) for r in simhash.near_classes(documents(spark, docs)).collect())
    prints = []
    for _, t, *_ in docs:
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0)
    kinds = sorted(set(prints))
    pairs = [(a, b) for a in kinds for b in kinds if a < b and (a ^ b).bit_count() <= 2]
    least = {}
    for group in _components(kinds, pairs):
        for f in group:
            least[f] = min(d[0] for d, g in zip(docs, prints, strict=True) if g in group)
    assert got == Counter((d[0], f, least[f]) for d, f in zip(docs, prints, strict=True))


def test_simhash_crowded_keys_lose_no_link(spark):
    r = np.random.default_rng(1)
    center = int(r.integers(0, 2**63))
    values = {center} | {center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in r.integers(0, 64, (80, 2))} | {int(x) for x in r.integers(0, 2**63, 50)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = simhash.links(spark.createDataFrame([(v,) for v in signed], "f long"), 2, bucket=8).collect()
    pairs = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    groups = lambda edges: Counter(frozenset(g) for g in _components(signed, edges))
    assert groups([(x.a, x.b) for x in got]) == groups(pairs)
    assert all(((x.a ^ x.b) & (2**64 - 1)).bit_count() <= 2 for x in got)


def _components(nodes, edges):
    label = {n: n for n in nodes}
    members = {n: {n} for n in nodes}
    for a, b in edges:
        a, b = label[a], label[b]
        if a != b:
            for m in members.pop(b):
                label[m] = a
                members[a].add(m)
    return members.values()


def test_near_classes_wide_joins_near_copies_only(spark):
    r = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, base = [], {}
    for i in range(20):
        w = list(r.choice(vocabulary, 300))
        base[i] = i * 10
        for j in range(4):
            v = list(w)
            for k in r.integers(0, 300, j):
                v[k] = f"edit{k}"
            rows.append((i * 10 + j, " ".join(v), "en", "s", 1, "", "", 0))
    got = {x.doc_id: x.component_id for x in simhash.near_classes_wide(documents(spark, rows)).collect()}
    assert got == {d: d // 10 * 10 for d in got}


def test_mixing(spark):
    got = mixing.mix(documents(spark)).collect()
    size = lambda t: len(words(t))
    by = defaultdict(int)
    for r in texts():
        by[r[3]] += size(r[1])
    order = sorted(by, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        level = (1.5 * sum(by.values()) - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * by[s]}
        if not over:
            break
        target |= {s: 2 * by[s] for s in over}
        free -= over
    target |= {s: level * weight[s] for s in free}
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == by[r.source]
        assert r.taken <= 2 * r.size and len(r.positions) == r.epochs and all(0 <= p <= 1 for p in r.positions)
        taken[r.source] += r.taken
    for s in by:
        assert abs(taken[s] - target[s]) <= max(size(r[1]) for r in texts() if r[3] == s) / 2 + 1
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in mixing.mix(documents(spark).repartition(3)).collect())


@pytest.mark.parametrize("ending", [0.5, 1.0, 1.5])
def test_demand_inverse(spark, ending):
    from pyspark.sql import functions as F

    for t in (0.0, 0.25, 0.5, 0.9, 1.0):
        y = (2 - ending) * t + (ending - 1) * t * t
        assert spark.range(1).select(mixing.demand_inverse(F.lit(y), F.lit(ending))).first()[0] == pytest.approx(t)


def test_quality_rules(spark):
    got = quality_rules.judge(documents(spark)).collect()
    want = []
    for i, t, *_ in texts():
        t = t or ""
        w = words(t)
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        want.append((i, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    have = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got]
    assert sorted(map(str, have)) == sorted(map(str, want))
    assert all(not r.kept for r in got if r.base_failed)


def test_host_verdicts_shrink_to_the_prior(spark):
    rows = [(f"h{h}", k < bad) for h, (n, bad) in enumerate([(400, 396), (2, 2), (300, 20), (500, 30)]) for k in range(n)]
    v = {r.source: r for r in quality_rules.host_verdicts(spark.createDataFrame(rows, "source string, base_failed boolean")).collect()}
    assert not v["h0"].host_kept and v["h2"].host_kept and v["h3"].host_kept
    assert v["h1"].shrunk_rate < 1.0 and v["h0"].shrunk_rate > 0.9


def plain_chats(turns):
    """conv_id -> rendered, by comparing every pair of conversations."""
    by = defaultdict(set)
    for c, t, r, x in turns:
        by[("n", r or "unknown", x or "") if c is None else ("c", c)].add((t is not None and c is not None, (t or 0) if c is not None else 0, r or "unknown", x or ""))
    logs = {own: [t[2:] for t in sorted(s)] for own, s in by.items()}
    kept = {}
    for own, log in logs.items():
        if not any(len(o) > len(log) and o[: len(log)] == log for o in logs.values()) and own == min((k for k, o in logs.items() if o == log), key=str):
            role = lambda r: r.replace("\\", "\\\\").replace("|", "\\|")
            text = lambda x: x.replace("<\\", "<\\\\").replace("<|", "<\\|")
            kept[own] = "".join(f"<|{role(r)}|>\n{text(x)}<|end|>\n" for r, x in log)
    return Counter((own[1] if own[0] == "c" else None, s) for own, s in kept.items())


def test_bad_hosts_lose_all_their_documents(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(h * 1000 + i, good if i >= bad else "too short", "en", f"h{h}", 1, "", "", 0) for h, (n, bad) in enumerate([(40, 2), (40, 4), (300, 295), (40, 1), (3, 3), (40, 6)]) for i in range(n)]
    got = quality_rules.judge(documents(spark, rows)).collect()
    kept = Counter(r.host for r in got if r.kept)
    assert kept == {"h0": 38, "h1": 36, "h3": 39, "h5": 34}  # not the five good ones of h2
    assert all(r.kept == (not r.base_failed) for r in got if r.host != "h2")
    small = {r.host: r.host_rate for r in got}
    assert small["h4"] < 1 and small["h2"] > quality_rules.MAX_HOST_RATE


def test_chat_format(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (3, 2, "user", "more"), (4, 0, "user", "hi"), (4, 1, "assistant", "other")]
    turns += [(5, 0, None, None), (6, 0, None, None), (6, 1, "user", ""), (3, 2, "user", "more"), (7, None, "user", "no turn"), (None, 0, "user", "nobody"), (9, 0, "user", "hi"), (9, 1, "assistant", "hello"), (9, 2, "user", "more")]
    turns += [(None, 4, "user", "nobody"), (None, 1, "user", "hi"), (None, 2, "user", "twice"), (8, 0, "user", "twice"), (10, 0, "us|er\\", "<|end|>\n<|assistant|>\nforged<\\|"), (11, 1, "b", "same turn"), (11, 1, "a", "same turn")]
    turns += [(12, i, "user", f"turn {i % 7}") for i in range(3000)] + [(13, i, "user", f"turn {i % 7}") for i in range(2999)]
    rows = [(*t, "x", "y", 1) for t in turns]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, own string, digest string, place int")
    got = chat_format.render(chat_format.maximal_conversations(made)).collect()
    assert Counter((r.conv_id, r.rendered) for r in got) == plain_chats(turns)
    found = {r.conv_id: r.rendered for r in got}
    assert set(found) == {3, 4, 6, 7, 8, 10, 11, 12, None} and found[10].count("<|") == 2
    assert found[3] == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\nmore<|end|>\n"
    assert found[6] == "<|unknown|>\n<|end|>\n<|user|>\n<|end|>\n"
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.maximal_conversations(empty).count() == 0


def test_packing(spark):
    docs = documents(spark, texts() + [(200, "w " * 9000, None, None, 1, "", "", 0)])
    got = packing.pack(docs, per_shard=10).collect()
    whole = Counter()
    for r in got:
        whole[(r.doc_id, r.copy)] += r.n_tokens
    sizes = Counter((r[0], len(words(r[1]))) for r in texts())
    assert sum(whole.values()) == sum(n * c for (_, n), c in sizes.items()) + 9000
    bins = defaultdict(list)
    for r in got:
        if r.n_tokens == 0:
            assert r.bin_id is None and r.bin_size == 0
        else:
            bins[r.bin_id].append(r)
    for members in bins.values():
        members.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in members:
            assert r.bin_offset == at
            at += r.n_tokens
        size = {r.bin_size for r in members}
        assert size == {min(c for c in packing.LENGTHS if c >= at)}  # downsized to its contents


def plain_fit(sizes, lengths, cost):
    """The rule on plain lists: best fit (of equal rooms the bin filled last), trial fills, downsizing. (length at opening, length, tokens) of each bin."""
    left, bins = list(sizes), []  # bins in the order they were last filled
    for s in sizes:
        left.remove(s)
        fitting = [b for b in bins if b[0] - sum(b[1]) >= s]
        if fitting:
            chosen = min(reversed(fitting), key=lambda b: b[0] - sum(b[1]))
            bins = [b for b in bins if b is not chosen]
        else:

            def per_token(c, s=s):
                room = c - s
                for x in sorted(left, reverse=True):
                    room -= x if x <= room else 0
                return cost(c) / (c - room)

            chosen = (min((c for c in lengths if c >= s), key=lambda c: (per_token(c), c)), [])
        chosen[1].append(s)
        bins.append(chosen)
    return Counter((c, min(x for x in lengths if x >= sum(b)), sum(b)) for c, b in bins)


def test_best_fit_equals_the_plain_rule():
    r = np.random.default_rng(8)
    for trial in range(60):
        lengths = ((8, 16, 32), (5, 7, 12, 40), (64,))[trial % 3]
        sizes = sorted((int(x) for x in r.integers(1, max(lengths) + 1, r.integers(1, 60))), reverse=True)
        cost = lambda c, more=trial % 4: c * (1 + c / 60) + more
        bins, offsets, ends, opened = packing.fit_pieces(sizes, lengths, cost)
        held = Counter()
        for b, at, s in zip(bins, offsets, sizes, strict=True):
            assert held[b] == at
            held[b] += s
        assert Counter((opened[b], ends[b], held[b]) for b in held) == plain_fit(sizes, lengths, cost)


def best_cost(sizes, lengths, cost):
    """The least cost of any packing, by trying all partitions."""
    least = [float("inf")]

    def place(i, bins):
        if i == len(sizes):
            least[0] = min(least[0], sum(cost(min(c for c in lengths if c >= b)) for b in bins))
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= max(lengths):
                place(i + 1, [*bins[:j], bins[j] + sizes[i], *bins[j + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return least[0]


def test_best_fit_is_near_the_best_of_all():
    r = np.random.default_rng(9)
    ratios = []
    for _ in range(60):
        sizes = sorted((int(x) for x in r.integers(1, 33, 7)), reverse=True)
        cost = lambda c: c * (1 + c / 96) + 1
        ends = packing.fit_pieces(sizes, (8, 16, 32), cost)[2]
        ratios.append(sum(map(cost, ends)) / best_cost(sizes, (8, 16, 32), cost))
    assert min(ratios) >= 1 - 1e-9 and max(ratios) < 1.4 and np.mean(ratios) < 1.08


def test_best_fit_opens_several_lengths_and_saves():
    r = np.random.default_rng(5)
    sizes = sorted((int(x) for x in np.clip(r.lognormal(5.5, 1, 20000), 1, 4096)), reverse=True)
    bins, offsets, ends, opened = packing.fit_pieces(sizes)
    assert len(bins) == len(sizes) and sum(sizes) / sum(ends) > 0.97 and set(opened) == set(packing.LENGTHS)
    for single in packing.LENGTHS:
        if single >= sizes[0]:
            one, _, used, _ = packing.fit_pieces(sizes, (single,))
            held = Counter()
            for b, s in zip(one, sizes, strict=True):
                held[b] += s
            shrunk = [min(c for c in packing.LENGTHS if c >= held[b]) for b in held]
            assert sum(map(packing.bin_cost, ends)) < sum(map(packing.bin_cost, shrunk))


def test_packing_of_a_table_opens_several_lengths(spark):
    got = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("bin_id IS NOT NULL").select("bin_id", "bin_opened", "bin_size").distinct().collect()
    assert {r.bin_opened for r in got} == set(packing.LENGTHS) and all(r.bin_size <= r.bin_opened for r in got)


def plain_top_k(v, k=20):
    """Of (vec_id, embedding) rows, by scoring every pair."""
    one = {}
    for i, e in v:
        if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e):
            e = [float(np.float32(x)) for x in e]
            one[i] = min(one.get(i, e), e)
    wide = max(map(len, one.values()), default=0)
    ids = np.array(sorted(one))
    m = np.array([np.floor(64 * np.array(one[i] + [0.0] * (wide - len(one[i])))) for i in ids]).reshape(len(ids), wide)
    out = {}
    for at in np.flatnonzero(ids % 20 == 0):
        s = m @ m[at]
        out[int(ids[at])] = [(int(ids[j]), int(s[j])) for j in np.lexsort((ids, -s)) if j != at][:k]
    return out


def found_top_k(df):
    got = defaultdict(list)
    for x in topk.top_k(df).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
        assert x["rank"] == len(got[x.query_id])
    return got


@pytest.mark.parametrize("block, run, group, chunk", [(1024, 8, 512, 256), (16, 2, 3, 2)])
def test_topk(spark, monkeypatch, block, run, group, chunk):
    for name, value in zip(("BLOCK", "RUN", "GROUP", "CHUNK"), (block, run, group, chunk), strict=True):
        monkeypatch.setattr(topk, name, value)
    r = np.random.default_rng(2)
    v = [(i, [float(x) for x in r.normal(0, 0.1, 16)]) for i in range(300)] + [(i, [0.5] * 16) for i in range(300, 370)]  # the last ones all alike
    v += [(400, None), (420, [None] * 16), (440, [float("nan")] * 16), (460, [float("inf")] * 16), (480, [0.1] * 8), (500, []), (520, [90.0] * 3), (540, [3000.0, -1.5]), (None, [0.2] * 16)]
    v += [(20, v[20][1]), (21, v[21][1]), (40, [9.0] * 16), (41, [-9.0] * 16)]  # vec_ids given twice
    rows = [(i, e, i, "x", i) for i, e in v]  # columns that clash with the operator's own
    got = found_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, run long, vec string, `rank` long"))
    assert got == plain_top_k(v)


def test_topk_of_few_rows(spark):
    ddl = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], ddl)).count() == 0
    assert found_top_k(spark.createDataFrame([(20, [1.0])], ddl)) == {}
    assert found_top_k(spark.createDataFrame([(1, [1.0]), (2, [2.0])], ddl)) == {}
    assert found_top_k(spark.createDataFrame([(0, [1.0]), (20, [2.0]), (3, [2.0])], ddl)) == {0: [(3, 8192), (20, 8192)], 20: [(3, 16384), (0, 8192)]}


def test_topk_skips_blocks_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "RUN", 2)
    r = np.random.default_rng(4)
    centers = r.normal(0, 1, (40, 24))
    v = [(i, [float(np.float32(x)) for x in centers[r.integers(40)] + r.normal(0, 0.05, 24)]) for i in range(4000)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    done = topk.found(topk._placed(df), 20, 20).select("group", "run", "work").distinct().agg({"work": "sum"}).first()[0]
    assert done < 0.5 * 200 * 4000
    assert found_top_k(df) == plain_top_k(v)


def test_topk_beyond_floats():
    big = np.array([[2.0**40, 3.0], [2.0**40, -5.0]])
    row, who, score, _ = topk.search_run(np.array([[2.0**20, 1.0]]), np.array([1, 2]), big, 5, 1)
    assert who.tolist() == [1, 2] and score.tolist() == [2**60 + 3, 2**60 - 5]


def hilbert_walk(bits):
    """The 3-D curve by its own rule, as a list of points: neighbours differ in one step."""
    from geolith.llm.sharding import hilbert_index

    return hilbert_index, bits


def test_hilbert_is_a_curve(spark):
    from pyspark.sql import functions as F

    bits = 3
    n = 1 << bits
    cells = spark.range(n**3).select((F.col("id") % n).alias("x"), (F.floor(F.col("id") / n) % n).alias("y"), F.floor(F.col("id") / n / n).alias("z"))
    walk = cells.select("x", "y", "z", sharding.hilbert_index([F.col(c) for c in "xyz"], bits).alias("h")).orderBy("h").collect()
    assert [r.h for r in walk] == list(range(n**3))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1 for a, b in zip(walk, walk[1:], strict=False))


def test_sharding(spark):
    got = sharding.hilbert_shards(documents(spark), shards=4).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == len(texts()) and max(counts.values()) - min(counts.values()) <= 1 and set(counts) <= set(range(4))
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in texts())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in order] == sorted(r.hilbert for r in got)


def test_sharding_prunes_by_source(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    shards = sharding.hilbert_shards(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("shard").agg(F.min("source").alias("a"), F.max("source").alias("z")).collect()
    sources = [r[0] for r in docs.select("source").distinct().collect()]
    opened = [sum(s.a <= v <= s.z for s in shards) / len(shards) for v in sources]
    assert sum(opened) / len(opened) < 0.4


def test_axes_keep_the_order_of_values(spark):
    rows = [(1, "t", "en", f"host{i:03}") for i in range(200)] + [(2, None, None, None)] + [(3, "t", "", "hot")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = dict(df.select("source", sharding.axis(df, "source").alias("p")).distinct().collect())
    assert got.pop(None) == 0
    places = [got[v] for v in sorted(got)]
    assert places == sorted(places) and set(places) == set(range(1, 32))
    langs = dict(df.select("lang", sharding.axis(df, "lang").alias("p")).distinct().collect())
    assert langs[None] == 0 < langs[""] < langs["en"]
    nulls = spark.createDataFrame([(1, None, None, None)] * 5, "doc_id long, text string, lang string, source string")
    assert sorted(r.slot for r in sharding.hilbert_shards(nulls, shards=2).where("shard = 0").collect()) == [0, 1, 2]


def test_digest_queries_on_tables(spark, sf_dir):
    from geolith.llm.registry import QUERIES

    r = QUERIES["op3_substring_dedup"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {i: (n, g, hashlib.sha256(b" ".join(k)).hexdigest()) for i, n, g, _, k in brute_substrings([tuple(d) for d in docs], words, 50)}
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in r.collect()} == want


def changed(r, base, n):
    """base with n of its words replaced, at least five apart."""
    w, at = list(base), r.sample(range(len(base) // 6), n)
    for i in at:
        w[i * 6 + 2] = f"new{r.random()}"
    return " ".join(w)


def similarity(a, b):
    a, b = (set(simhash._shingle_hashes(t, 5).tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("tile", [2, 64])
def test_near_classes_wide_confirms_similarity(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    r = random.Random(3)
    texts = []
    while len(texts) < 24:  # pairs under 0.8 that the distance alone would link
        base = [f"w{r.random()}" for _ in range(300)]
        other = changed(r, base, 8)
        far = simhash.fingerprint_lanes(" ".join(base), 5, 8) ^ simhash.fingerprint_lanes(other, 5, 8)
        if np.bitwise_count(far).sum() <= simhash.NEAR_PART * 512:
            texts += [" ".join(base), other, changed(r, base, 2), changed(r, base, 3)]
    rows = [(i, t, "en", "s", 1, "", "", 0) for i, t in enumerate(texts)]
    got = {x.doc_id: x.component_id for x in simhash.near_classes_wide(documents(spark, rows)).collect()}
    want = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if similarity(texts[i], texts[j]) >= 0.8:
                    want[i] = want[j] = min(want[i], want[j])
    assert got == dict(enumerate(want)) and len(set(want)) > len(texts) // 4


@pytest.mark.parametrize("tile, crowd, leaders", [(2, 2, 2), (8, 3, 1), (64, 16, 3)])
def test_linked_groups_equal_all_pairs(spark, monkeypatch, tile, crowd, leaders):
    for name, value in (("TILE", tile), ("CROWD", crowd), ("LEADERS", leaders)):
        monkeypatch.setattr(simhash, name, value)
    r = np.random.default_rng(tile)
    rows = []
    for group in range(4):
        centers = r.integers(0, 256, (3, 64), dtype=np.uint8)
        for i in range((5, 60, 25, 1)[group]):
            f = centers[r.integers(3)].copy()
            for bit in r.integers(0, 512, r.integers(0, 40)):
                f[bit // 8] ^= 1 << (bit % 8)
            rows.append((group, group * 1000 + i, bytes(f)))
    got = simhash.linked(spark.createDataFrame(rows + rows[:5], "grp long, tag long, data binary"), lambda d: simhash._close(40, d)).collect()
    far = lambda a, b: (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    pairs = [(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and far(x[2], y[2]) <= 40]
    groups = lambda edges: Counter(frozenset(g) for g in _components([x[1] for x in rows], edges))
    assert groups([(x.a, x.b) for x in got]) == groups(pairs)


@pytest.mark.parametrize("crowd", [2, 16])
def test_wide_links_equal_all_pairs_that_share_a_key(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "TILE", 4)
    r = np.random.default_rng(crowd)
    centers = r.integers(0, 256, (6, 64), dtype=np.uint8)
    prints = []
    for i in range(90):
        f = centers[min(i % 12, 5)].copy()
        for bit in r.integers(0, 512, r.integers(0, 90)):
            f[bit // 8] ^= 1 << (bit % 8)
        prints.append(f)
    rows = [(i, *f.view("<i8").tolist()) for i, f in enumerate(prints)]
    got = [(x.a, x.b) for x in simhash.wide_links(spark.createDataFrame(rows, "tag long, " + ", ".join(f"f{i} long" for i in range(8))), 8, 97).collect()]
    pairs = []
    for a in range(90):
        for b in range(a):
            same = prints[a] == prints[b]
            near = np.bitwise_count(prints[a] ^ prints[b]).sum(dtype=int) <= 97
            if near and any(same[i] and same[(i + x) % 64] and same[(i + y) % 64] for i in range(64) for x, y in simhash.STEPS):
                pairs.append((a, b))
            if (~same).sum() <= 21:
                assert any(same[i] and same[(i + x) % 64] and same[(i + y) % 64] for i in range(64) for x, y in simhash.STEPS)  # pigeonhole
    groups = lambda edges: Counter(frozenset(g) for g in _components(range(90), edges))
    assert groups(got) == groups(pairs)


def test_near_classes_wide_find_nine_of_ten_similar_pairs(spark):
    """Against all pairs of the texts of sf0.1 with five-word Jaccard similarity of 0.8 or more, found by an index of shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    first = {}
    for d, t in sorted(docs.select("doc_id", "text").where("text IS NOT NULL").collect()):
        first.setdefault(t, d)
    sets = {d: s for t, d in first.items() if (s := set(simhash._shingle_hashes(t, 5).tolist()))}
    holders = defaultdict(list)
    for d, s in sets.items():
        for h in s:
            holders[h].append(d)
    both = Counter((a, b) for held in holders.values() for i, a in enumerate(held) for b in held[:i])
    close = [(a, b) for (a, b), n in both.items() if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n)]
    label = {r.doc_id: r.component_id for r in simhash.near_classes_wide(docs).collect()}
    assert len(close) > 20 and np.mean([label[a] == label[b] for a, b in close]) >= 0.9
    print("similar pairs found:", np.mean([label[a] == label[b] for a, b in close]), "of", len(close))
    owner = {d: i for i, g in enumerate(_components(sorted(sets), close)) for d in g}
    assert len({(owner[d], label[d]) for d in sets}) == len({label[d] for d in sets})  # texts of no similarity are not joined


@pytest.mark.parametrize("held", [1, 5, 1 << 20])
def test_components(spark, monkeypatch, held):
    from geolith.llm import graph

    monkeypatch.setattr(graph, "HELD", held)
    r = np.random.default_rng(held % 97)
    edges = [(int(a), int(b)) for a, b in r.integers(-60, 60, (55, 2))] + [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(7, 7)]
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    nodes = sorted({n for a, b in edges if a != b for n in (a, b)})
    assert got == {n: min(g) for g in _components(nodes, [e for e in edges if e[0] != e[1]]) for n in g}


def test_contraction_reaches_the_smallest_node():
    import numpy as np
    import pyarrow as pa

    from geolith.llm import graph

    draw = np.random.default_rng(1)
    for _ in range(100):
        n = int(draw.integers(1, 60))
        u, v = draw.integers(-n, n, (2, int(draw.integers(0, 80))))
        least = {int(x): int(x) for x in (*u, *v)}
        for _ in range(2 * n):  # labels sink along links, one link at a time
            for a, b in zip(u.tolist(), v.tolist(), strict=True):
                least[a] = least[b] = min(least[a], least[b])
        batch = pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        got = {(x["u"], x["v"]) for out in graph._contracted(iter([batch])) for x in out.to_pylist()}
        assert got == {(x, y) for x, y in least.items() if x != y}
    assert not list(graph._contracted(iter([])))

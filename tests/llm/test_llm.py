"""The ten operators against brute force, round trips and held-out labels, and on awkward input."""

import gzip
import itertools
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagelens.llm import decontaminate, htmltext, jaccard, lines, packing, quality, substrings, tokens, topk, warc
from pagelens.llm._text import ngrams, points, words

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\W_]+")


def toks(t):
    return WORD.findall((t or "").lower())


def frame(spark, rows, schema="doc_id LONG, text STRING, row STRING, t INT"):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], schema)


def prose(seed, n, vocabulary=400):
    g = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in g.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def awkward():
    long = prose(1, 3000)
    return [(1, "alpha beta gamma\ndelta"), (2, "alpha beta gamma\nother line"), (None, "alpha beta gamma"), (3, None), (4, ""), (5, " \n\t"), (1, "alpha beta gamma\ndelta"), (6, long), (7, long), (8, "Ünï çödé " + long[:900]), (9, "!!! ???")]


# words


def test_words_match_a_plain_regular_expression():
    texts = ["Hello, wörld! 123abc", "", None, "ÀÉ x_y z", "日本語 text", "a" * 5000]
    w = words(points(pa.array(texts)))
    p = points(pa.array(texts))
    flat = "".join(t or "" for t in texts)
    for i, t in enumerate(texts):
        got = [flat[a:b].lower() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]])]
        assert got == toks(t)
    assert p.at[-1] == len(flat)


def test_equal_words_and_grams_have_equal_hashes():
    texts = ["the cat sat on the mat", "THE CAT, sat; on the mat!", "cat the"]
    w = words(points(pa.array(texts)))
    assert (w.hash[:6] == w.hash[6:12]).all() and w.hash[0] == w.hash[4] != w.hash[1]
    h, t = ngrams(w, 3)
    assert (h[t == 0] == h[t == 1]).all() and (t == 2).sum() == 1


# 1 token blocks


def test_blocks_round_trip():
    g = np.random.default_rng(0)
    each = [g.integers(0, 2**k, n).astype(np.uint32) for k, n in ((1, 0), (8, 1), (16, 127), (16, 128), (17, 129), (31, 1000), (3, 256))]
    each.append(np.array([5] * 300 + [2**31 - 1] * 3, np.uint32))
    counts = np.array([len(x) for x in each])
    data, start, block, byte = tokens.encode(np.concatenate(each), counts)
    for i, x in enumerate(each):
        raw = data[byte[i] : byte[i + 1]].tobytes()
        starts = (start[block[i] : block[i + 1]] - byte[i]).tolist()
        assert (tokens.decode(raw, starts) == x).all()
        if len(starts) > 1:
            assert (tokens.decode_block(raw, starts[1]) == x[128:256]).all()


def test_token_blocks_of_awkward_documents(spark, awkward):
    import public_tokenizers

    enc = tokens.encoder(str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    rows = tokens.token_blocks(frame(spark, awkward)).collect()
    assert sorted(tuple(tokens.decode(bytes(r.data), r.block_starts)) for r in rows) == sorted(tuple(enc.encode_ordinary(t or "")) for _, t in awkward)
    assert all(r.n_tokens == len(tokens.decode(bytes(r.data), r.block_starts)) for r in rows)
    assert tokens.token_blocks(frame(spark, [])).count() == 0


# 2 line dedup


def brute_lines(rows):
    seen, out = set(), {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    for i in order:
        t = rows[i][1]
        if not t:
            out[i] = t
            continue
        kept = []
        for x in t.split("\n"):
            if not x.strip(" \t\r") or x not in seen:
                kept.append(x)
            if x.strip(" \t\r"):
                seen.add(x)
        out[i] = "\n".join(kept)
    return [(rows[i][0], out[i]) for i in range(len(rows))]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_line_dedup(spark, awkward, limit):
    rows = [*awkward, (20, "same\nsame\nsame"), (21, "x\ny\nz"), (22, "z\nx\ny\nnew")]
    out = lines.dedup_lines(frame(spark, rows).coalesce(1), removed_col="n", broadcast_bytes=limit)
    assert out.columns == ["doc_id", "text", "row", "t", "n"]
    got = [(r.doc_id, r.text) for r in out.orderBy("t").collect()]
    assert got == brute_lines(rows)
    assert lines.dedup_lines(frame(spark, [])).count() == 0
    kept = lines.dedup_lines(frame(spark, rows).coalesce(1), drop_emptied=True, broadcast_bytes=limit)
    assert {r.t for r in kept.collect()} == {i for i, (r, (_, t)) in enumerate(zip(rows, brute_lines(rows))) if t == r[1] or t.strip()}


@pytest.mark.parametrize("most", [3, 100])
def test_each_segment_gets_all_its_rows_at_once(spark, most):
    from pagelens.llm._spark import each_segment

    df = spark.range(500, numPartitions=7).select((F.col("id") % 10 - 2).alias("segment"), "id")
    got = each_segment(df, 8, lambda k, t: pa.table({"k": [k], "n": [t.num_rows], "s": [sum(t["id"].to_pylist())]}), "k LONG, n LONG, s LONG", most).collect()
    assert sorted(map(tuple, got)) == [(k, 50, sum(i for i in range(500) if i % 10 - 2 == k)) for k in range(-2, 8)]


# 3 n-gram Jaccard join


def brute_pairs(rows, n=3, least=0.6):
    sets = []
    for i, (d, t) in enumerate(rows):
        w = toks(t)
        s = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
        sets.append((d is None, d or 0, i, d, s))
    sets.sort(key=lambda x: x[:3])
    first, out = {}, []
    for x in sets:
        if x[4]:
            f = first.setdefault(x[4], x)
            if f is not x:
                out.append((f[3], x[3], 1.0))
    for a, b in itertools.combinations(first.values(), 2):
        j = len(a[4] & b[4]) / len(a[4] | b[4])
        if j >= least - 1e-12:
            out.append((a[3], b[3], round(j, 6)))
    return sorted(out, key=str)


def brute_classes(rows, n=3, least=0.6):
    sets = []
    for d, t in rows:
        w = toks(t)
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    size = len(rows)
    near = [{j for j in range(size) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least - 1e-12} for i in range(size)]
    out = []
    for i in range(size):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], min(ids, default=None), len(near[i])))
    return sorted(out, key=str)


def near_copies():
    g = np.random.default_rng(3)
    rows = []
    for f in range(4):
        base = prose(50 + f, 120).split()
        for k in range(9):
            x = list(base)
            for _ in range(k):
                x[g.integers(0, len(x))] = "edit%d" % g.integers(0, 1000)
            rows += [(100 * f + k + 100, " ".join(x))] * (1 + k % 3)
    return rows + [(None, rows[5][1]), (None, prose(90, 30)), (None, prose(90, 30))]


@pytest.mark.parametrize(("region", "limit", "segments"), [(4000, 1 << 26, None), (5, 1 << 26, 64), (5, 0, None), (2, 0, 32)])
def test_jaccard_classes(spark, awkward, region, limit, segments):
    rows = [*awkward, *near_copies()]
    got = jaccard.classes(frame(spark, rows).coalesce(1), region=region, broadcast_bytes=limit, segments=segments).collect()
    assert sorted(((r.doc_id, r.class_id, r.links) for r in got), key=str) == brute_classes(rows)
    assert jaccard.classes(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("region", "limit"), [(4000, 1 << 26), (5, 1 << 26), (5, 0)])
def test_jaccard_pairs(spark, awkward, region, limit):
    rows = list(awkward)
    g = np.random.default_rng(3)
    for f in range(4):
        base = prose(50 + f, 120).split()
        for k in range(9):
            x = list(base)
            for _ in range(k):
                x[g.integers(0, len(x))] = "edit%d" % g.integers(0, 1000)
            rows.append((100 * f + k + 100, " ".join(x)))
    got = jaccard.jaccard_pairs(frame(spark, rows).coalesce(1), region=region, broadcast_bytes=limit).collect()
    assert sorted(((r.doc_a, r.doc_b, round(r.jaccard, 6)) for r in got), key=str) == brute_pairs(rows)
    assert jaccard.jaccard_pairs(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("region", "limit"), [(4000, 1 << 26), (5, 1 << 26), (5, 0)])
def test_copies_in_large_blocks_have_one_first(spark, region, limit):
    base, far = prose(70, 120).split(), prose(71, 120)
    near = [" ".join([*base[:k], f"edit{k}", *base[k + 1 :]]) for k in range(0, 120, 15)]
    rows = [(200 - i, " ".join(base)) for i in range(10)] + [(300 + i, t) for i, t in enumerate(near * 3)]
    rows += [(None, " ".join(base)), (None, near[0]), (191, " ".join(base))] + [(400 + i, far) for i in range(10)]
    got = jaccard.jaccard_pairs(frame(spark, rows).coalesce(1), region=region, broadcast_bytes=limit).collect()
    assert sorted(((r.doc_a, r.doc_b, round(r.jaccard, 6)) for r in got), key=str) == brute_pairs(rows)


@pytest.mark.parametrize("at_once", [1000, 7])
def test_components(spark, at_once):
    edges = [(i, i + 1) for i in range(30)] + [(50, 40), (41, 40), (60, 61), (61, 62), (62, 60)]
    df = spark.createDataFrame(edges, "a LONG, b LONG")
    got = {r.node: r.root for r in jaccard.components(df, at_once).collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 41: 40, 50: 40, 60: 60, 61: 60, 62: 60}
    assert jaccard.components(df.limit(0), at_once).count() == 0


def test_voronoi_regions_lose_no_pair():
    g = np.random.default_rng(1)
    sets = []
    for _ in range(25):
        b = np.unique(g.integers(0, 3000, 150).astype(np.uint64))
        for _ in range(g.integers(1, 25)):
            x = b.copy()
            k = g.integers(0, 50)
            x[g.integers(0, len(x), k)] = g.integers(0, 3000, k)
            sets.append(np.unique(x))
    found = list(jaccard.voronoi_join(jaccard.Sets(sets), 0.6, small=12, pivots=5))
    i, j = np.concatenate([np.full(len(j), i) for i, j, _ in found]), np.concatenate([j for _, j, _ in found])
    plain = [set(s.tolist()) for s in sets]
    want = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if len(plain[a] & plain[b]) / len(plain[a] | plain[b]) >= 0.6 - 1e-12}
    assert len(i) == len(want) and {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())} == want


def test_keep_one_keeps_the_first_of_each_group(spark, awkward):
    out = jaccard.keep_one(frame(spark, awkward).coalesce(1))
    assert out.columns == ["doc_id", "text", "row", "t"]
    groups = {}
    for i, (_, t) in enumerate(awkward):
        groups.setdefault(tuple(toks(t)) or i, []).append(i)
    first = {min(g, key=lambda i: (awkward[i][0] is None, awkward[i][0] or 0, i)) for g in groups.values()}
    assert {r.t for r in out.collect()} == first


# 4 substring dedup


def brute_repeats(rows, length):
    where = {}
    for i, (d, t) in enumerate(rows):
        w = toks(t)
        for k in range(len(w) - length + 1):
            where.setdefault(tuple(w[k : k + length]), []).append(((d is None, d or 0, i), d, k))
    out = []
    for dup in (False, True):
        per = {}
        for places in where.values():
            places.sort()
            for key, d, k in places[1:] if dup else places if len(places) > 1 else []:
                per.setdefault((key, d), []).append(k)
        for (_, d), ks in per.items():
            ks.sort()
            lo = hi = None
            for k in ks:
                if hi is not None and k <= hi:
                    hi = k + length
                    continue
                if hi is not None:
                    out.append((d, lo, hi, dup))
                lo, hi = k, k + length
            out.append((d, lo, hi, dup))
    return sorted(out, key=str)


@pytest.mark.parametrize(("cap", "limit"), [(20_000, 1 << 26), (1, 1 << 26), (20_000, 0), (1, 0)])
def test_repeats(spark, awkward, cap, limit):
    p = prose(7, 30)
    rows = [*awkward, (30, prose(8, 40) + " " + p + " " + prose(9, 20)), (31, prose(10, 15) + " " + p), (32, " ".join(["go"] * 40)), (33, p + ". " + p), (34, prose(11, 9))]
    got = substrings.find_repeats(frame(spark, rows).coalesce(1), length=12, prefix=5, cap=cap, segments=16, broadcast_bytes=limit).collect()
    assert sorted(((r.doc_id, r.start_word, r.end_word, r.duplicate) for r in got), key=str) == brute_repeats(rows, 12)
    assert substrings.find_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("cap", "limit"), [(20_000, 1 << 26), (1, 0)])
def test_long_repeats(spark, cap, limit):
    p, q = prose(12, 1500), prose(13, 420)
    rows = [(1, p), (2, p), (3, prose(14, 100) + " " + q + " " + p[:3000]), (4, q + " " + prose(15, 399)), (5, prose(15, 399))]
    got = substrings.find_repeats(frame(spark, rows).coalesce(1), length=400, cap=cap, broadcast_bytes=limit).collect()
    assert sorted(((r.doc_id, r.start_word, r.end_word, r.duplicate) for r in got), key=str) == brute_repeats(rows, 400)
    assert (1, 0, 1500, False) in brute_repeats(rows, 400)


@pytest.mark.parametrize("seed", range(20))
def test_depths_are_those_of_the_suffix_tree(seed):
    g = np.random.default_rng(seed)
    size = g.integers(6, 15, int(g.integers(1, 12)))
    text = g.integers(0, 3, int(size.sum())).astype(np.uint32)
    begin = np.cumsum(size) - size
    length = 4
    start = np.concatenate([b + np.arange(s - length + 1) for b, s in zip(begin, size)])
    stop = np.concatenate([np.full(s - length + 1, b + s) for b, s in zip(begin, size)])
    node, depth = substrings.depths(text, begin, size, start, length)
    words_ = [tuple(text[a:z]) for a, z in zip(start, stop)]
    common = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    for i, x in enumerate(words_):
        best = max((common(x, y) for j, y in enumerate(words_) if j != i), default=0)
        assert depth[i] == (best if best >= length else 0)
        assert [node[j] == node[i] for j in range(len(words_))] == [y[:length] == x[:length] for y in words_]


def test_dedup_substrings_cuts_later_copies(spark):
    p = prose(7, 30)
    rows = [(1, "Start here, " + p + ". The end"), (2, "Other words; " + p + "! More")]
    got = {r.doc_id: r.text for r in substrings.dedup_substrings(frame(spark, rows).coalesce(1), length=20, prefix=8).collect()}
    assert got == {1: rows[0][1], 2: "Other words; ! More"}


# 5 exact top-k


@pytest.mark.parametrize("limit", [1 << 26, 900])
@pytest.mark.parametrize("asked", [None, "vec_id % 5 = 0"])
def test_topk_against_a_full_sort(spark, limit, asked):
    g = np.random.default_rng(5)
    v = g.normal(size=(90, 6))
    v[40:50] = v[0]
    rows = [(int(i), x.tolist(), "z") for i, x in enumerate(v)] + [(200, [0.0] * 6, "z"), (201, None, "z"), (None, v[3].tolist(), "z"), (202, [1.0, float("nan")], "z"), (203, [], "z"), (204, [1.0, 2.0], "z"), (205, [2.0, 1.0], "z"), (5, v[8].tolist(), "z"), (5, v[8].tolist(), "z")]
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>, q STRING")
    got = {}
    for r in topk.exact_topk(df, None if asked is None else df.filter(asked), k=4, tile=16, fan=2, columns=5, broadcast_bytes=limit).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.neighbor_id, round(r.score, 6)))
    use = [(i, np.array(x, np.float32).astype(float)) for i, x, _ in rows if i is not None and x and np.isfinite(x).all()]
    unit = lambda x: x / np.linalg.norm(x) if np.linalg.norm(x) else x
    want = {}
    for i, x in use:
        if asked is None or i % 5 == 0:
            best = sorted((-round(float(unit(x) @ unit(y)), 9), j) for j, y in use if j != i and len(x) == len(y))[:4]
            want.setdefault(i, []).extend((k + 1, j, round(-s, 6) + 0.0) for k, (s, j) in enumerate(best))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items() if x}
    assert topk.exact_topk(df.limit(0)).count() == 0
    assert topk.exact_topk(df, df.limit(0), broadcast_bytes=limit).count() == 0


# 6 packing


def brute_cuts(sizes, first, window, truncation, split):
    n = len(sizes)
    best = [0.0] + [float("inf")] * n
    for j in range(1, n + 1):
        for i in range(j):
            total = sum(sizes[i:j])
            c = window - total if total <= window else truncation * (total - window)
            best[j] = min(best[j], best[i] + c + (0 if first[i] else split))
    return best[n]


@pytest.mark.parametrize("seed", range(30))
def test_cuts_have_the_least_cost(seed):
    g = np.random.default_rng(seed)
    n = int(g.integers(1, 25))
    sizes, first = g.integers(1, 30, n), g.random(n) < 0.4
    first[0] = True
    truncation, split = float(g.choice([0.3, 1.0, 2.5])), float(g.choice([0, 3, 20]))
    ends = packing.cuts(sizes, first, 25, truncation, split)
    cost, at = 0.0, 0
    for e in ends:
        total = int(sizes[at:e].sum())
        cost += (25 - total if total <= 25 else truncation * (total - 25)) + (0 if first[at] else split)
        at = e
    assert at == n and abs(cost - brute_cuts(sizes.tolist(), first.tolist(), 25, truncation, split)) < 1e-9


def brute_windows(rows, window, truncation=1.0, split=8.0):
    """Windows of all rows as one shard: lists of (id, tokens), from the least-cost cuts found by a full search."""
    flat, sizes, whole = [], [], []
    for d, t in rows:
        units = [u.split() for u in re.findall(r"\S.*?(?:[.!?](?=\s)|(?=\n)|\Z)", t or "", re.S)]
        units = [u for u in units if u]
        flat += [(d, w) for u in units for w in u]
        sizes += [len(u) for u in units]
        whole += [k == len(units) - 1 for k in range(len(units))]
    to = np.cumsum(sizes).tolist()
    cost, back = [0.0], [0]
    for p in range(1, len(flat) + 1):
        unit = next(k for k, t in enumerate(to) if t >= p)
        rest = to[unit] - p
        own = window + ((0 if whole[unit] else split) if rest == 0 else split + truncation * min(rest, window))
        best = min(range(p - 1, max(0, p - window) - 1, -1), key=lambda q: cost[q])
        cost.append(cost[best] + own)
        back.append(best)
    out, p = [], len(flat)
    while p:
        out.append(flat[back[p] : p])
        p = back[p]
    return cost[-1], out[::-1]


@pytest.mark.parametrize("seed", range(3))
def test_packing_against_a_full_search(spark, seed):
    g = np.random.default_rng(seed)
    rows = []
    for i in g.permutation(12).tolist():
        words_ = prose(int(g.integers(1000)), int(g.integers(1, 60))).split()
        rows.append((i * 1_000_003 - 5, " ".join(w + ("." if g.random() < 0.2 else "") for w in words_)))
    out = packing.pack_documents(frame(spark, rows), window=16).orderBy("shard", "window_no").collect()
    cost, want = brute_windows(sorted(rows), 16)
    got = []
    for r in out:
        got.append([(s.doc_id, w) for s in r.segments for w in dict(rows)[s.doc_id][s.start : s.end].split()])
    assert [x for w in got for x in w] == [x for w in want for x in w] and got == want


def test_packing_of_awkward_documents(spark, awkward):
    rows = [*awkward, (50, "One two three. Four five! Six\nseven eight nine ten. Eleven"), (9000, "far away")]
    out = packing.pack_documents(frame(spark, rows), window=10, shard_docs=3, part_bytes=2000).collect()
    texts = {}
    for d, t in rows:
        texts.setdefault(d, set()).add(t)
    for r in out:
        assert r.n_tokens + r.padding == 10 and r.n_tokens == sum(s.tokens for s in r.segments) == len(r.text.split())
        options = [[t[s.start : s.end] for t in texts[s.doc_id] if t and len(t[s.start : s.end].split()) == s.tokens] for s in r.segments]
        assert any(r.text == "\n\n".join(x) for x in itertools.product(*options))
    assert sum(r.n_tokens + r.truncated for r in out) == sum(len((t or "").split()) for _, t in rows)
    assert len({r.shard for r in out}) > 1
    assert packing.pack_documents(frame(spark, [])).count() == 0


@pytest.mark.parametrize("ids", ["consecutive", "hashed", "equal", "null"])
def test_ids_do_not_change_how_well_windows_fill(spark, ids):
    docs = spark.range(600).select({"consecutive": F.col("id"), "hashed": F.xxhash64("id"), "equal": F.lit(7).cast("long"), "null": F.lit(None).cast("long")}[ids].alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(20) + F.col("id") % 9), lambda x: F.concat(F.lit("w"), x.cast("string")))).alias("text"))
    out = packing.pack_documents(docs, window=64, shard_docs=100).collect()
    total = sum(20 + i % 9 for i in range(600))
    assert sum(r.n_tokens for r in out) == total and len({r.shard for r in out}) == 6
    assert len(out) <= 1.08 * total / 64 + 6
    per = [sum(1 for r in out if r.shard == k) for k in range(6)]
    assert max(per) < 2.5 * min(per)
    again = packing.pack_documents(docs, window=64, shard_docs=100).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


@pytest.mark.parametrize("seed", range(30))
def test_token_cuts_hold_all_and_have_the_least_cost(seed):
    g = np.random.default_rng(seed)
    n = int(g.integers(1, 25))
    sizes, first = g.integers(1, 30, n), g.random(n) < 0.4
    first[0] = True
    window, truncation, split = int(g.choice([1, 7, 25])), float(g.choice([0, 0.3, 1.0, 2.5])), float(g.choice([0, 3, 20]))
    to, total = np.cumsum(sizes).tolist(), int(sizes.sum())
    penalty = {p: split + truncation * min(next(t for t in to if t >= p) - p, window) for p in range(1, total + 1)}
    penalty |= {t: 0 if x else split for t, x in zip(to, [*first[1:], True])}
    best = [0.0]
    for p in range(1, total + 1):
        best.append(penalty[p] + window + min(best[max(0, p - window) : p]))
    ends = packing.token_cuts(sizes, first, window, truncation, split)
    assert ends[-1] == total and all(0 < b - a <= window for a, b in zip([0, *ends], ends))
    assert abs(sum(penalty[p] + window for p in ends) - best[total]) < 1e-6


def test_packing_loses_no_token(spark):
    sentences = " ".join(f"a{i} b{i} c{i} d{i}." for i in range(5))
    rows = [(1, prose(1, 15)), (2, "one two three."), (3, "é  ü\t" + prose(2, 73)), (4, sentences), (5, "last words"), (9000, prose(3, 13))]
    out = packing.pack_documents(frame(spark, rows), window=10).orderBy("shard", "window_no").collect()
    got = {d: [] for d, _ in rows}
    for r in out:
        assert r.n_tokens <= 10 and r.truncated == 0 and r.n_tokens + r.padding == 10
        assert r.text == "\n\n".join(dict(rows)[s.doc_id][s.start : s.end] for s in r.segments)
        assert r.doc_ids == [s.doc_id for s in r.segments]
        for s in r.segments:
            got[s.doc_id] += dict(rows)[s.doc_id][s.start : s.end].split()
    assert got == {d: t.split() for d, t in rows}


# 7 decontamination


def brute_spans(rows, items, n=8, least=5):
    ph = {}
    for i, t in items:
        w = toks(t)
        if len(w) >= least:
            for k in range(max(1, len(w) - n + 1)):
                key = tuple(w[k : k + n])
                ph[key] = min(ph.get(key, 10**9), 10**9 if i is None else i)
    out = []
    for d, t in rows:
        w, spans = toks(t), []
        for k in range(len(w)):
            for m in sorted({len(p) for p in ph}):
                key = tuple(w[k : k + m])
                if len(key) == m and key in ph:
                    if spans and k <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], k + m)
                        spans[-1][2].add(ph[key])
                    else:
                        spans.append([k, k + m, {ph[key]}])
        out += [(d, a, b, tuple(None if i == 10**9 else i for i in sorted(s))) for a, b, s in spans]
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1 << 26, 700])
def test_decontamination(spark, awkward, limit):
    items = [(1, prose(60, 20)), (2, prose(61, 8)), (3, "five words are enough here"), (4, "too few"), (5, None), (6, prose(60, 20)), (None, prose(62, 9))]
    x = prose(60, 20).split()
    rows = [*awkward, (40, "Before " + prose(60, 20).upper() + " after"), (41, " ".join(x[:9]) + " zzz " + " ".join(x[5:])), (42, "Five words, are enough: here!"), (43, prose(61, 8)), (44, " ".join(x[:7])), (45, "said " + prose(61, 8) + " " + prose(61, 8) + " end"), (46, prose(62, 9)), (47, prose(63, 40_000) + " " + prose(60, 20) + " " + prose(62, 9))]
    bench = spark.createDataFrame([(*i, "k") for i in items], "item_id LONG, text STRING, spans STRING")
    got = decontaminate.find_spans(frame(spark, rows), bench, broadcast_bytes=limit).collect()
    assert sorted(((r.doc_id, r.start_word, r.end_word, tuple(r["items"])) for r in got), key=str) == brute_spans(rows, items)
    assert (46, 0, 9, (None,)) in brute_spans(rows, items)
    cut = decontaminate.decontaminate(frame(spark, rows), bench, broadcast_bytes=limit)
    assert cut.columns == ["doc_id", "text", "row", "t"]
    left = {r.t: r.text for r in cut.collect()}
    assert left[len(awkward)] == "Before  after" and len(awkward) + 3 not in left
    for i, r in enumerate(awkward):
        assert left[i] == r[1]
    assert decontaminate.find_spans(frame(spark, []), bench).count() == 0
    assert decontaminate.find_spans(frame(spark, rows), bench.limit(0)).count() == 0


def test_fm_index_counts_and_locates():
    g = np.random.default_rng(2)
    text = g.integers(0, 5, 400)
    text[-1] = 0
    index = decontaminate.FMIndex(text, 5)
    for m in (1, 2, 3):
        pattern = np.array(list(itertools.product(range(1, 5), repeat=m)))
        lo, hi = index.search(pattern)
        for row, a, b in zip(pattern, lo, hi):
            want = [i for i in range(len(text) - m + 1) if (text[i : i + m] == row).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# 8 WARC


def records_of(data):
    out = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        out.append((fields, rest[:n]))
        data = rest[n + 4 :]
    return out


def test_warc_archive(spark, tmp_path):
    rows = [(1, "http://a/", "<p>x</p>", None, None), (2, "http://b/", "<p>x</p>", None, None), (3, None, "", None, None), (4, "http://c/", None, None, None), (1, "http://a/", "<p>x</p>", None, None), (None, "http://n/", "<p>x</p>", None, None), (9, "http://r/", None, "revisit", warc.digest(b"<p>x</p>")), (10, "http://q/", None, "revisit", "sha1:UNKNOWN"), (11, "http://é/", "ü" * 70000, None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id LONG, url STRING, html STRING, kind STRING, digest STRING, row INT").coalesce(1)
    out = warc.archive(warc.captures(df, kind_col="kind", digest_col="digest"))
    got = out.collect()
    kinds = sorted((r.page_id or 0, r.warc_type) for r in got)
    assert kinds == [(0, "revisit"), (1, "response"), (1, "revisit"), (2, "revisit"), (3, "response"), (4, "metadata"), (9, "revisit"), (10, "revisit"), (11, "response")]
    first = next(r for r in got if r.page_id == 1 and r.warc_type == "response")
    assert all(r.refers_to == first.record_id for r in got if r.warc_type == "revisit" and r.page_id != 10)
    files = warc.write_warc(out, str(tmp_path / "w")).collect()
    assert sum(f.records for f in files) == len(rows)
    seen = []
    for f in files:
        with gzip.open(f.file) as g:
            seen += records_of(g.read())
    by = {f["WARC-Record-ID"]: (f, b) for f, b in seen if f["WARC-Type"] != "warcinfo"}
    assert len(by) == len(rows)
    for r in got:
        f, body = by[r.record_id]
        assert f["WARC-Type"] == r.warc_type and f["WARC-Block-Digest"] == warc.digest(body)
        if r.warc_type == "response":
            assert f["WARC-Payload-Digest"] == warc.digest(body.partition(b"\r\n\r\n")[2])
    assert warc.archive(warc.captures(df.limit(0), kind_col="kind", digest_col="digest")).count() == 0


# 9 quality


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    learn, rest = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    scored = quality.score(docs, quality.fit(docs, learn)).join(rest, "doc_id").collect()
    clean = [r.score for r in scored if r.quality == 1 and r.toxic == 0]
    assert np.mean(np.array(clean) >= 0.5) > 0.98
    shares = [np.mean([r.score < 0.5 for r in scored if use(r)]) for use in (lambda r: r.quality == 0, lambda r: r.toxic == 1)]
    assert min(shares) > 0.9, shares


def brute_train(x, y, trees, depth, rate, bins, least, l2):
    """The same boosting by plain loops over all splits."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    base = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    score = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)

        def grow(rows, d):
            gs, hs = g[rows].sum(), h[rows].sum()
            best = None
            if d < depth and hs >= 2 * least * 0.05 and len(rows) >= 2 * least:
                for j, cuts in enumerate(edges):
                    for c in cuts:
                        left = rows[x[rows, j] <= c]
                        if len(left) < least or len(rows) - len(left) < least:
                            continue
                        gl, hl = g[left].sum(), h[left].sum()
                        gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                        if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, j, c)
            if best is None:
                score[rows] -= rate * gs / (hs + l2)
                return
            _, j, c = best
            grow(rows[x[rows, j] <= c], d + 1)
            grow(rows[x[rows, j] > c], d + 1)

        grow(np.arange(len(y)), 0)
    return 1 / (1 + np.exp(-score))


@pytest.mark.parametrize("seed", range(3))
def test_histogram_boosting_against_plain_splits(seed):
    g = np.random.default_rng(seed)
    x = g.normal(size=(150, 3)).round(2)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * g.normal(size=150)) > 0).astype(float)
    m = quality.train(x, y, trees=5, depth=3, rate=0.3, bins=16, least=5.0, l2=1.0)
    assert np.allclose(m.predict(x), brute_train(x, y, 5, 3, 0.3, 16, 5.0, 1.0), atol=1e-6)


def test_repeated_ids_and_typical_words(spark):
    rows = [(i % 40, f"{prose(i, 30)} {'rotten' if i % 40 < 10 else 'fresh'}") for i in range(200)]
    labels = spark.createDataFrame([(i, 1, 1 if i < 10 else 0) for i in range(40)] + [(3, 0, None)], "doc_id LONG, quality INT, toxic INT")
    model = quality.fit(frame(spark, rows), labels)
    assert len(model.typical.hash) == 1 and model.typical.hash[0] == words(points(pa.array(["rotten"]))).hash[0]
    src = quality._sample(frame(spark, rows), labels, 20, "doc_id", "text", "quality", "toxic")
    assert src.count() == 20


def test_flat_trees_walk_like_nested_ones():
    g = np.random.default_rng(0)
    x = g.normal(size=(600, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.train(x, y)
    assert ((m.predict(x) > 0.5) == y).mean() > 0.97

    def one(row):
        s = m.base
        for t in range(len(m.feature)):
            i = 0
            while np.isfinite(m.threshold[t, i]):
                i = m.left[t, i] + int(row[m.feature[t, i]] > m.threshold[t, i])
            s += m.value[t, i]
        return 1 / (1 + np.exp(-s))

    assert np.allclose([one(r) for r in x[:50]], m.predict(x[:50]))


def test_quality_of_awkward_documents(spark, awkward):
    docs = frame(spark, awkward)
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (77, 0)], "doc_id LONG, quality INT")
    model = quality.fit(docs, labels)
    out = quality.reject(docs, model)
    assert out.columns == docs.columns and out.count() == len(awkward)  # one class only: nothing goes
    assert quality.score(docs, model).count() == len(awkward)
    assert quality.reject(docs, quality.fit(docs, labels.limit(0))).count() == len(awkward)
    assert quality.score(frame(spark, []), model).count() == 0


# 10 HTML


def test_decoding_never_contradicts_and_is_best():
    g = np.random.default_rng(4)
    for _ in range(200):
        n = int(g.integers(1, 9))
        parent = [-1] + [int(g.integers(0, i)) for i in range(1, n)]
        logit = g.normal(size=n)
        kept = htmltext.decode(parent, logit)
        assert all(parent[i] < 0 or kept[parent[i]] for i in range(n) if kept[i])
        best = max(sum(logit[i] for i in range(n) if s >> i & 1) for s in range(1 << n) if all(parent[i] < 0 or s >> parent[i] & 1 for i in range(n) if s >> i & 1))
        assert abs(logit[kept].sum() - best) < 1e-9


def test_parser_survives_bad_markup():
    t = htmltext.parse("<div><p>one<p>two <b>bold</div></i> tail<br>x<!-- open <p>gone")
    assert [t.tag[v] if v >= 0 else None for v, s in t.chunks if s.strip()] == ["p", "p", "b", None, None]
    for s in ("", "plain", "<", "<a", "</x>", "<p", "<a b='>x", "&amp;&bogus;&#xZZ;", "<ul><li>a<li>b</ul>", "<script>if (a<b) {}", "<p>" * 3000):
        htmltext.extract_batch([s], None)
    assert htmltext.extract_batch([None, "plain", ""], None) == [(None, 0, 0), ("plain", 0, 0), ("", 0, 0)]
    assert htmltext.extract_batch(["<ul><li>a<li>b</ul>"], None)[0][0] == "a\nb"


@pytest.mark.parametrize("bad", ["<a", "<a ", '<a "', "<a '", '<a b="', "<!--", "<![CDATA[", "<!", "<?", "<b>", "</i>", "<b></i>", "<a x", "&", '<a ">', "<li><ul><b>", "<p><b>", "</", "<script>"])
def test_bad_pages_take_linear_time(bad):
    for tail in ("", ">", "<p>end</p>"):
        began = time.process_time()
        htmltext.parse(bad * (100_000 // len(bad)) + tail)
        assert time.process_time() - began < 1


def test_quotes_hide_the_end_of_a_tag_only_if_they_close():
    t = htmltext.parse("<p a='x>y'>one</p><p b=\"z>two</p><p>three</p>")
    assert [s for _, s in t.chunks] == ["one", "two", "three"]
    assert htmltext.extract_batch(["<a " + "x" * 200_000 + ">t</a>"], None)[0][0] == "t"


@pytest.mark.parametrize(
    "raw",
    ["<script>for(i=0;i<n;i++){}</script>", "<script><!-- x </script>", "<SCRIPT>a<b</sCript >", "<style>a{content:'<b'}</style\n>", "<script>x='</scripts><p>no'</script>", "<script>if(a<b&&c>'d){}</script>", "<title>a <b</title>", "<script>s='<![CDATA['</script>"],
)
def test_only_its_own_end_tag_ends_a_raw_element(raw):
    t = htmltext.parse(f"<p>before</p>{raw}<article><p>the article</p></article><script>y</script><p>after</p>")
    assert [(t.tag[v], s) for v, s in t.chunks if s.strip()] == [("p", "before"), ("p", "the article"), ("p", "after")]
    assert [s for _, s in htmltext.parse("<p>one</p><script>a<b </p> never closed").chunks] == ["one"]


def test_extraction_finds_the_articles(spark):
    d = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{d}/pages.parquet")
    model = htmltext.fit(pages, spark.read.parquet(f"{d}/documents.parquet"), sample=120)
    rows = pages.collect()
    exact = 0
    for r, (text, _, _) in zip(rows, htmltext.extract_batch([x.html for x in rows], model)):
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = htmltext.extract_batch([f"<article>{article}</article>"], None)[0][0]
        exact += text.split() == want.split()
    assert exact / len(rows) > 0.95
    odd = spark.createDataFrame([(1, None, 1), (None, "<p>a b</p>", 2), (2, "", 3)], "page_id LONG, html STRING, text INT")
    assert {(x.page_id, x.elements) for x in htmltext.extract(odd, model).collect()} == {(1, 0), (None, 1), (2, 0)}
    assert sorted(str(x.text) for x in htmltext.extract(odd, None).collect()) == ["", "None", "a b"]
    assert htmltext.extract(odd.limit(0), model).count() == 0
    assert htmltext.fit(odd, spark.read.parquet(f"{d}/documents.parquet")) is None


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in c.STAGES[:-1]:
        after = stage(spark, docs, DATA)
        assert after.columns == columns, name
        before, now = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in after.collect()}
        assert set(now) <= set(before)
        rows = sorted(before.items())
        if name == "line_dedup":
            want = {d: t for (d, t), (_, o) in zip(brute_lines(rows), rows) if t == o or t.strip()}
            assert now == want
        if name == "ngram_jaccard":
            gone = {b for _, b, _ in brute_pairs(rows)}
            assert set(now) == set(before) - gone
        if name == "decontamination":
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert not brute_spans(sorted(now.items()), bench) or len(brute_spans(sorted(now.items()), bench)) < len(brute_spans(rows, bench))
            hit = {s[0] for s in brute_spans(rows, bench)}
            assert all(now[d] == before[d] for d in now if d not in hit)
        docs = spark.createDataFrame(after.toPandas(), after.schema) if after.count() else after
    out = c.run(spark, DATA)
    assert out.count() > 0 and out.filter(F.col("n_tokens") > 2048).count() == 0

"""The language model against brute force: a plain sampler, posteriors by recursion, sums to 1."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from muster.llm import hpylm
from muster.llm.common import slices

SF = "/root/testdata/sf0.01"
HELD, SEEN = ([i for i in range(5000) if (zlib.crc32(str(i).encode()) % 7 == 2) == h] for h in (True, False))


def test_counts_and_base_scores(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    texts = dict(zip(t.doc_id, t.text))
    got = hpylm.query(spark, SF).toPandas()
    words = {k: (t or "").encode().lower().split() + [None] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in words}
    c = Counter(w for k, ws in words.items() if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(texts)
    for r in got.itertuples():
        ws = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, held[r.doc_id])
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    own = got[got.held_out]
    assert own.score.sum() > 0.9 * own.base_score.sum() and (own.score > own.base_score).mean() > 0.9


def test_words_are_compared_as_they_are(spark):
    """Two words of 1,024 letters that a polynomial hash modulo 2 ** 64 takes for one."""
    a = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    got = hpylm.score(spark.createDataFrame([(SEEN[0], a), (SEEN[1], b), (SEEN[2], a)], "doc_id bigint, text string")).collect()
    assert {r.train_tokens for r in got} == {6}
    v = 3  # two words and the end
    assert all(math.isclose(r.base_score, math.log10(4 / (6 + v + 1)) + math.log10((3 if r.doc_id != SEEN[1] else 2) / (6 + v + 1))) for r in got)


def plain_sampler(texts, probes, discounts, strengths, sweeps, burn):
    """One customer after another: log10 probabilities of the probes, averaged as probabilities of tokens, and the words' customers
    in the root after each sweep."""
    rng = random.Random(4)
    (d0, d1, d2), (s0, s1, s2) = discounts, strengths
    tokens = [((u, v), w) for t in texts for u, v, w in zip([0, 0, *t.split()], [0, *t.split()], [*t.split(), "</s>"])]
    vocabulary = len({w for _, w in tokens})
    rooms = defaultdict(lambda: defaultdict(list))  # context -> dish -> table sizes
    level = {2: (d2, s2), 1: (d1, s1), 0: (d0, s0)}

    def p(context, w):
        if context is None:
            return 1 / (vocabulary + 1)
        d, s = level[len(context)]
        room = rooms.get(context, {})
        c, t = sum(map(sum, room.values())), sum(map(len, room.values()))
        own = room.get(w, [])
        return (sum(own) - d * len(own) + (s + d * t) * p(up(context), w)) / (s + c)

    def up(context):
        return context[1:] if context else None

    def sit(context, w):
        if context is None:
            return
        d, s = level[len(context)]
        room = rooms[context]
        t, own = sum(map(len, room.values())), room[w]
        weights = [x - d for x in own] + [(s + d * t) * p(up(context), w)]
        k = rng.choices(range(len(weights)), weights)[0]
        if k == len(own):
            own.append(1)
            sit(up(context), w)
        else:
            own[k] += 1

    def leave(context, w):
        if context is None:
            return
        own = rooms[context][w]
        k = rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        if not own[k]:
            own.pop(k)
            leave(up(context), w)

    for c, w in tokens:
        sit(c, w)
    sums, roots = [None] * len(probes), []
    for sweep in range(sweeps):
        for c, w in tokens:
            leave(c, w)
            sit(c, w)
        if sweep >= burn:
            roots.append({w: sum(own) for w, own in rooms[()].items()})
            for i, t in enumerate(probes):
                ws = t.split()
                x = np.array([p((u, v), w) for u, v, w in zip([0, 0, *ws], [0, *ws], [*ws, "</s>"])])
                sums[i] = x if sums[i] is None else sums[i] + x
    return [float(np.log10(x / (sweeps - burn)).sum()) for x in sums], roots


DISCOUNTS, STRENGTHS = (0.5, 0.6, 0.7), (1.0, 1.0, 1.0)


@pytest.fixture(scope="module")
def tiny():
    rng = random.Random(1)
    return [" ".join(rng.choices("abcdefgh", [30, 20, 10, 5, 4, 3, 2, 1], k=rng.randint(3, 12))) for _ in range(60)]


@pytest.fixture(scope="module")
def plain(tiny):
    probes = ["a", "a b", "a a a a b", *tiny[:8]]
    return probes, *plain_sampler(tiny, probes, DISCOUNTS, STRENGTHS, 400, 100)


@pytest.mark.parametrize("bucket_tokens", [1_000_000, 60])
def test_scores_are_those_of_a_plain_sampler(spark, tiny, plain, bucket_tokens):
    """Within what the one root that the last round uses may differ from the average over many; with restaurants in one bucket
    and in several."""
    probes, want, _ = plain
    docs = [*zip(SEEN, tiny), *zip(HELD, probes)]
    got = {r.doc_id: r.score for r in hpylm.score(spark.createDataFrame(docs, "doc_id bigint, text string"), rounds=3, scans=10, samples=50, discounts=DISCOUNTS, strengths=STRENGTHS, bucket_tokens=bucket_tokens).collect()}
    apart = [(got[i] - x) / (len(t.split()) + 1) for i, t, x in zip(HELD, probes, want)]
    assert max(map(abs, apart)) < 0.06 and abs(sum(apart)) / len(apart) < 0.03, apart


def test_customers_are_those_of_a_plain_sampler(tiny, plain):
    """Customers of the words in the root, averaged over the seating of a whole small corpus in one bucket."""
    names = {w: 4 + 2 * i for i, w in enumerate("a b c d e f g h </s>".split())} | {"^": hpylm.START}
    counts = Counter((names[v], names[u], names[w]) for t in tiny for u, v, w in zip(["^", "^", *t.split()], ["^", *t.split()], [*t.split(), "</s>"]))
    keys = np.array(sorted(counts))
    c = np.array([counts[tuple(k)] for k in keys.tolist()])
    row = {"bucket": 0, "chunk": 1, "v": hpylm.packed(keys[:, 0], True), "u": hpylm.packed(keys[:, 1], True), "w": hpylm.packed(keys[:, 2]), "c": hpylm.packed(c)}
    b, rng, base = hpylm.Bucket(pa.Table.from_pylist([row]), 1, DISCOUNTS[1:], STRENGTHS[1:]), np.random.default_rng(0), 1 / 10
    t0, seen = np.ones(len(b.names), np.int64), []
    for k in range(800):
        own = b.own()
        back = (STRENGTHS[0] + DISCOUNTS[0] * t0.sum()) * base
        b.scan(hpylm.Root(own - DISCOUNTS[0] * t0 + back, 1 - DISCOUNTS[0] * t0 / np.maximum(own, 1), own, STRENGTHS[0] + own.sum(), back))
        own = b.own()
        t0 = hpylm.draw_tables(own, np.clip(t0, 1, own), hpylm.Rule(STRENGTHS[0], DISCOUNTS[0], t0.sum() - t0, None, None, np.full(len(own), base)), rng)
        if k >= 100:
            seen.append(own)
    roots = plain[2]
    of = {n: w for w, n in names.items()}
    for n, mine in zip(b.names.tolist(), np.array(seen).T):
        plain = np.array([r.get(of[n], 0) for r in roots])
        assert abs(mine.mean() - plain.mean()) < 0.7 * max(plain.std(), 0.2), (of[n], mine.mean(), plain.mean(), plain.std())


@pytest.mark.parametrize("bucket_tokens", [1_000_000, 40])
def test_probabilities_of_short_texts(spark, bucket_tokens):
    """Of all texts of no, one and two words, with restaurants in one bucket and in several; sums to 1 are tested by bucket."""
    texts = ["a b a c", "a b", "b a", "c", "a b c d e a b"] * 30
    words = [*sorted({w for t in texts for w in t.split()}), "unseen"]
    probes = ["", *words, *[f"{x} {y}" for x in words for y in words]]
    got = hpylm.score(spark.createDataFrame([*zip(SEEN, texts), *zip(HELD, probes)], "doc_id bigint, text string"), bucket_tokens=bucket_tokens)
    p = dict(zip(probes, [10**s for _, s in sorted((r.doc_id, r.score) for r in got.collect() if r.held_out)]))
    assert all(0 < x < 1 for x in p.values()) and p["a b"] > p["a unseen"]
    sums = [p[""], sum(p[w] for w in words), sum(p[f"{x} {y}"] for x in words for y in words)]
    assert 0 < sum(sums) < 1 and sums[0] < sums[1]


def all_seatings(c, d, most):
    """Logarithms of the weights of c customers at 0..most tables, by recursion."""
    row, t = np.append(0.0, np.full(most, -np.inf)), np.arange(1, most + 1)
    for k in range(c):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(k - d * t > 0, np.log(np.maximum(k - d * t, 1e-300)), -np.inf)
        row = np.append(-np.inf, np.logaddexp(row[:-1], row[1:] + stay))
    return row


def test_seating_keeps_customers():
    s = hpylm.Seating(np.array([5, 1, 40, 2]), 0.7, np.random.default_rng(3))
    for _ in range(200):
        i = np.array([0, 2, 3])
        s.leave(i)
        s.sit(i, np.full(3, 5.0))
        assert s.customers.tolist() == [5, 1, 40, 2]
        for k in range(4):
            own = s.size[s.start[k] : s.start[k] + s.room[k]]
            assert own.sum() == s.customers[k] and (own > 0).sum() == s.tables[k] and (own[: s.tables[k]] > 0).all()


@pytest.mark.parametrize("c", [2, 7, 40])
def test_tables_are_drawn_as_customers_sit(c):
    """Tables drawn at once against customers who leave and sit one by one."""
    n, d, w = 4000, 0.5, 2.0
    s = hpylm.Seating(np.full(n, c), d, np.random.default_rng(5))
    i = np.arange(n)
    for _ in range(30 * c):
        s.leave(i)
        s.sit(i, np.full(n, w))
    flat = hpylm.Rule(1.0, d, np.zeros(n), None, None, np.full(n, w))
    flat.step = lambda i, j: np.log(flat.p[i])  # each new table weighs w, whatever there is
    flat.at = lambda i: flat
    t = hpylm.draw_tables(np.full(n, c), np.ones(n, np.int64), flat, np.random.default_rng(6))
    assert abs(t.mean() - s.tables.mean()) < 5 * math.sqrt((t.var() + s.tables.var()) / n)


@pytest.mark.parametrize("c", [200, 10_000])
def test_dishes_sit_as_their_posterior_says(c):
    """All customers of many equal dishes leave and sit again, those of large ones by Metropolis steps, against the posterior."""
    n, d, most = 400, 0.7, 1200
    s, tables, has, of = 1.5, 800.0, 40.0, 9000.0
    rule = hpylm.Rule(s, d, np.full(n, tables), np.full(n, has), np.full(n, of), np.full(n, 0.9))
    t = np.ones(n, np.int64)
    for _ in range(4):
        t = hpylm.draw_tables(np.full(n, c), t, rule, np.random.default_rng(t.sum()))
    k = np.arange(min(c, most))
    log_p = all_seatings(c, d, min(c, most))[1:] + np.cumsum(np.log(0.9 * (s + d * (tables + k)) * (has + k) / (of + k)))
    p = np.exp(log_p - log_p.max())
    p /= p.sum()
    mean = (p * (k + 1)).sum()
    sd = math.sqrt((p * (k + 1) ** 2).sum() - mean**2)
    assert (p[-1] < 1e-9 or c < most) and abs(t.mean() - mean) < 5 * sd / math.sqrt(n) and 0.7 < t.std() / sd < 1.4


@pytest.mark.parametrize("c, d", [(300, 0.5), (300, 0.05), (5000, 0.9)])
def test_seatings_of_many_customers(c, d):
    t = np.unique(np.geomspace(1, c, 40).astype(np.int64))
    assert np.abs(hpylm.log_stirling(np.full(len(t), c), t, d) - all_seatings(c, d, c)[t]).max() < 1e-4


def test_totals_of_a_bucket_hold():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 6, (400, 3)) * [1, 1, 1], axis=0)
    v, u, w = (keys[:, k] * 2 + 4 for k in (0, 1, 2))
    c = rng.integers(0, 400, len(v))
    row = {"bucket": 3, "chunk": 1, "v": hpylm.packed(v, True), "u": hpylm.packed(u, True), "w": hpylm.packed(w), "c": hpylm.packed(c)}
    b = hpylm.Bucket(pa.Table.from_pylist([row]), 1)
    b.burn_in(b.own_root(), 3)
    assert (b.t <= b.c).all() and ((b.t > 0) == (b.c > 0)).all() and (b.t > 1).any()
    assert (b.c1 == np.bincount(b.dish, b.t, len(b.c1))).all() and ((b.t1 > 0) == (b.c1 > 0)).all() and (b.t1 <= b.c1).all()
    assert (b.tables == np.bincount(b.pair, b.t)).all() and (b.of_room == np.bincount(b.room, b.c1)).all() and (b.tables1 == np.bincount(b.room, b.t1)).all()
    root = b.own_root()
    p, root = b.probability(root), root.probability()
    full = {}
    for q in range(len(b.of_pair)):  # what a pair's restaurant says of all names adds up to 1 less what the root leaves
        at = b.pair == q
        room = b.room_of_pair[q]
        (d1, d2), (s1, s2) = b.d, b.s
        p1 = np.full(len(b.names), 0.0)
        own = b.room == room
        p1[b.word[own]] = b.c1[own] - d1 * b.t1[own]
        p1 = (p1 + (s1 + d1 * b.tables1[room]) * root) / (s1 + b.of_room[room])
        all_ = (s2 + d2 * b.tables[q]) * p1
        all_[b.word[b.dish[at]]] += b.c[at] - d2 * b.t[at]
        all_ /= s2 + b.of_pair[q]
        assert np.allclose(all_[b.word[b.dish[at]]], p[at])
        rest = (s2 + d2 * b.tables[q]) / (s2 + b.of_pair[q]) * (s1 + d1 * b.tables1[room]) / (s1 + b.of_room[room]) * (1 - root.sum())
        full[q] = all_.sum() + rest
    assert np.allclose(list(full.values()), 1)


def test_a_restaurant_in_several_buckets_is_one():
    """Customers, tables and probabilities of restaurants whose dishes lie in three buckets, against the same in one bucket."""
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, [2, 6, 40], (600, 3)), axis=0)
    v, u, w = (keys[:, k] * 2 + 4 for k in range(3))
    c, hot, parts = rng.integers(0, 30, len(v)), [4, 6], 2

    def bucket(number, at, **more):
        row = {"bucket": number, "chunk": 1, "v": hpylm.packed(v[at], True), "u": hpylm.packed(u[at], True), "w": hpylm.packed(w[at]), "c": hpylm.packed(c[at])}
        return hpylm.Bucket(pa.Table.from_pylist([row]), 1, (0.5, 0.6), (1.0, 1.0), **more)

    whole, cut = bucket(0, np.full(len(v), True)), [bucket(k, w // 2 % 3 == k, hot=hot) for k in range(3)]
    schema, up = hpylm._arrow(hpylm.ROOT), hpylm._arrow("part bigint, bucket bigint, words binary, c binary, levels array<bigint>")
    said, levels = [{} for _ in cut], []
    for p in range(parts):
        rows = [x | {"bucket": b.number} for b in cut for x in b.to_root(parts) if x["part"] == -1 - p]
        row = hpylm.root_part(pa.Table.from_pylist(rows, up), schema).to_pylist()[0]
        levels.append(row["levels"])
        for k, own in zip(row["bucket"], row["own"]):
            said[k][-1 - p] = {"own": own}
    assert np.sum(levels, axis=0)[:4].tolist() == whole.ones
    root, sums = whole.own_root(), np.zeros(len(whole.of_pair))
    p = root.probability()
    all_pairs = {(x, y): k for k, (x, y) in enumerate(sorted(set(zip(v.tolist(), u.tolist()))))}
    for b, told in zip(cut, said):
        b.hear(told, parts)
        at = [all_pairs[k] for k in zip(*(x[: len(b.pairs)].tolist() for x in b.shared))]
        assert len(at) == len(b.of_pair) and (b.of_pair == whole.of_pair[at]).all() and (b.tables == whole.tables[at]).all()
        assert (b.of_room == whole.of_room).all() and (b.tables1 == whole.tables1).all()
        own = np.searchsorted(whole.names, b.names)
        seen = hpylm.Root(root.weight[own], root.gain[own], root.own[own], root.total, 1.0)
        sums += np.bincount(np.array(at)[b.pair], b.probability(seen), len(sums))
    assert np.allclose(sums, np.bincount(whole.pair, whole.probability(root), len(sums))) and p.sum() < 1
    before = [(b.of_pair.copy(), b.elsewhere.copy()) for b in cut]
    for b in cut:
        b.burn_in(b.own_root(), 2)
    assert all((b.of_pair == x).all() and (b.elsewhere == y).all() for b, (x, y) in zip(cut, before))


def test_packing():
    rng = np.random.default_rng(0)
    for a in (np.zeros(0, np.int64), np.array([7]), rng.integers(-(2**40), 2**40, 1000), np.sort(rng.integers(0, 2**50, 1000))):
        assert (hpylm.unpacked(hpylm.packed(a)) == a).all() and (hpylm.unpacked(hpylm.packed(a, True), True) == a).all()


@pytest.mark.parametrize("bucket_tokens", [1_000_000, 40])
def test_scores_do_not_depend_on_chance(spark, small, monkeypatch, bucket_tokens):
    """Two runs over the table in other partitions, orders and chunks; repeated texts have one score each."""
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("length(text) < 2000 AND doc_id < 100").select("doc_id", "text")
    again = docs.unionByName(docs.filter("doc_id % 3 = 0").withColumn("doc_id", F.lit(None).cast("bigint")))
    got = []
    for n, chunk in ((1, 8 << 20), (3, 30_000)):
        monkeypatch.setattr(hpylm, "slices", lambda b, text, most, cut=slices, chunk=chunk: cut(b, text, chunk))
        rows = hpylm.score(again.repartition(n, F.xxhash64("text", F.lit(n))), bucket_tokens=bucket_tokens).collect()
        got.append(sorted(map(tuple, rows), key=str))
    assert got[0] == got[1]
    text = {r.doc_id: r.text for r in docs.collect()}
    by_text = {}
    for k, _, _, _, _, _, score in got[0]:
        if k is not None:
            by_text.setdefault(text[k], set()).add(score)
    assert all(len(s) == 1 for s in by_text.values())
    assert {x[-1] for x in got[0] if x[0] is None} <= {s for v in by_text.values() for s in v}

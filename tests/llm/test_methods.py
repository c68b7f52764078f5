"""What SQL cannot express: against brute force, round trips, held-out accuracy."""

import hashlib
import math
import re
import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from muster.llm import bpe, exact_dedup, mixing, quality_gbt, quality_rules, simhash, token_counts, url_filter
from muster.llm.common import located, table, without

RANKS = P.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    return dict(zip(t.doc_id, t.text))


@given(st.lists(st.sampled_from("abc"), max_size=40))
@settings(deadline=None, max_examples=200)
def test_repeated_windows(words):
    c = Counter(zip(words, words[1:], words[2:]))
    at = {k + j for k in range(len(words) - 2) if c[tuple(words[k : k + 3])] > 1 for j in range(3)}
    assert quality_rules.repeat_words([w.encode() for w in words]) == len(at)


def test_repeated_windows_compare_words():
    """Two words of 1,024 letters that a polynomial hash modulo 2 ** 64 takes for one."""
    a = b"".join(b"ab"[k.bit_count() % 2 :][:1] for k in range(1024))
    b = a.translate(bytes.maketrans(b"ab", b"ba"))
    assert a != b and quality_rules.repeat_words([b"x", b"y", a, b"q", b"x", b"y", b]) == 0
    assert quality_rules.repeat_words([b"x", b"y", a, b"q", b"x", b"y", a]) == 6


def test_quality_rules_on_labels_left_out(spark):
    """Labels of a fifth of the documents are left out; the verdict holds there."""
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    out = "crc32(cast(doc_id as string)) % 5 = 0"
    got = quality_rules.quality_rules(docs, labels.filter(f"not {out}")).filter(out).join(labels, "doc_id").filter("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99 and got[got.quality == 0].kept.mean() < 0.05 and len(got) > 500


def test_good_documents_stay(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    kept = quality_rules.quality_rules(docs, labels).filter("kept").select("doc_id")
    assert sorted(r[0] for r in quality_rules.keep_good(docs, labels).select("doc_id").collect()) == sorted(r[0] for r in kept.collect())


@pytest.fixture(scope="module")
def library():
    t = bpe.tokenizer(RANKS, P.PATTERN)
    return tiktoken.Encoding("all", pat_str=P.PATTERN, mergeable_ranks={b: i for i, b in enumerate(t.bytes_of)}, special_tokens={})


@given(st.lists(st.sampled_from(["a", "b", "1", " ", "  ", "\n", "\t", ".", ",", "'s", "é", "😀", "\u2003", "\x0b", "word", "Straße ", " x" * 60]), max_size=300))
@settings(deadline=None, max_examples=300)
def test_tree_encodes_like_the_library(library, parts):
    t, text = bpe.tokenizer(RANKS, P.PATTERN), "".join(parts)
    assert t.encode(text) == library.encode_ordinary(text)
    assert t.decode(t.encode(text)) == text.encode()


def test_every_text_goes_through_the_tree(texts, monkeypatch):
    """What is encoded at once is a leaf, a window or a part without a place to cut: of some tens of characters."""
    t, seen, leaf = bpe.tokenizer(RANKS, P.PATTERN), [], bpe.Tokenizer.leaf
    monkeypatch.setattr(bpe.Tokenizer, "leaf", lambda self, x: seen.append(len(x)) or leaf(self, x))
    long = [x for x in texts.values() if x and len(x) > 1000]
    for x in long:
        t.encode(x)
    assert len(seen) > sum(map(len, long)) / bpe.LEAF and sorted(seen)[int(0.999 * len(seen))] <= bpe.LEAF


def test_bpe_of_documents(spark, texts, library):
    had = {r.id: r for r in bpe.round_trip(table(spark, SF, "documents"), RANKS, P.PATTERN).collect()}
    for k, text in texts.items():
        assert list(had[k].ids) == library.encode_ordinary(text or "") and bytes(had[k].decoded) == (text or "").encode()
    t = bpe.tokenizer(RANKS, P.PATTERN)
    for long in ("x" * 50_000 + " y" * 9000 + "\n" * 9000, "ab" * 30_000, " " * 5000 + "a", "é😀" * 3000, "a b" + "c" * 4000 + " d" * 4000):
        assert t.encode(long) == library.encode_ordinary(long)


@pytest.mark.parametrize("text", ["漢字かな交じり文" * 500, "1234567890" * 500, " " * 5000, "abcdefgh" * 1000, "x" * 4000, "\n" * 3000, "Donaudampfschifffahrtsgesellschaft" * 100])
def test_long_matches_go_through_joins(library, monkeypatch, text):
    """What is merged at once is a leaf or a window, of bounded size unless a text is all alike."""
    t, joins, sizes = bpe.Tokenizer(RANKS, P.PATTERN), [], []
    joined, merged = t.joined, t.merged
    monkeypatch.setattr(t, "joined", lambda a, b: joins.append(1) or joined(a, b))
    monkeypatch.setattr(t, "merged", lambda data: sizes.append(len(data)) or merged(data))
    assert t.encode(text) == library.encode_ordinary(text)
    assert len(joins) >= len(text) // bpe.LEAF - 1
    if len(set(text)) > 1:
        assert max(sizes) < 10 * bpe.LEAF


@given(st.text("ab", max_size=400) | st.text("aehnrst", max_size=400) | st.text(st.sampled_from("é漢😀1 \n"), max_size=300))
@settings(deadline=None, max_examples=150)
def test_halves_of_a_match(library, text):
    """Any bytes, cut anywhere: leaves, windows and fits give what merging all at once gives."""
    t, data = bpe.tokenizer(RANKS, P.PATTERN), text.encode()
    want = library._encode_single_piece(data) if data else []
    assert t.merged(data) == want and (not data or t.halved(data) == want)
    for k in range(1, len(data), 37):
        assert t.joined(t.merged(data[:k]), t.merged(data[k:])) == want


def test_bytes_that_are_no_text(spark, labels):
    docs = spark.sql("SELECT 1L AS doc_id, cast(X'61FF6220C3' AS string) AS text, 'en' AS lang, 'src0' AS source")
    (row,) = bpe.round_trip(docs, RANKS, P.PATTERN).collect()
    assert bytes(row.decoded).decode() == "a\ufffdb \ufffd"
    assert quality_rules.quality_rules(docs, labels).first().word_chars == 4
    assert token_counts.section_tokens(docs, RANKS, P.PATTERN).first().char_end == 5
    assert token_counts.field_tokens(docs, ["text", "lang"], RANKS, P.PATTERN).count() == 2


@pytest.mark.parametrize("name", ["section", "n_tokens"])
def test_sections_of_an_identifier_with_a_name_of_theirs(spark, name):
    docs = spark.createDataFrame([("a", "one\ntwo"), ("b", None)], f"{name} string, text string")
    got = token_counts.section_tokens(docs, RANKS, P.PATTERN, id_col=name)
    assert got.columns == [f"{name}_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"]
    assert [tuple(r)[:2] for r in got.orderBy(f"{name}_id", "section").collect()] == [("a", 0), ("a", 1), ("b", 0)]


def test_patterns_need_their_own_places():
    with pytest.raises(ValueError):
        bpe.Tokenizer(RANKS, r"\S+|\s+")
    t = bpe.Tokenizer(RANKS, r"\S+|\s+", r"(?<=\S)\s")
    whole = tiktoken.Encoding("other", pat_str=r"\S+|\s+", mergeable_ranks={b: i for i, b in enumerate(t.bytes_of)}, special_tokens={})
    text = "some words, more words;\n\n and   others " * 50
    assert t.encode(text) == whole.encode_ordinary(text)


def brute_fingerprint(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids, x = list(fps), np.array(list(fps.values()), np.uint64)
    near, lab = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3, np.array(ids)
    while True:
        new = np.array([lab[n].min() for n in near])
        if (new == lab).all():
            return dict(zip(ids, lab.tolist()))
        lab = new


def test_simhash_against_brute_force(spark, texts):
    got = {r.doc_id: r for r in simhash.near_dedup(table(spark, SF, "documents")).collect()}
    fps = {k: brute_fingerprint(t) for k, t in texts.items()}
    assert {k: int(r.fingerprint, 16) for k, r in got.items()} == fps
    assert {k: r.component_id for k, r in got.items()} == brute_components(fps)


@pytest.mark.parametrize("chunk", [3, 512])
def test_links_of_dense_groups(spark, chunk):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 4)]
    fps = set()
    for b in base:
        for _ in range(60):
            fps.add(b ^ sum(1 << int(k) for k in rng.choice(20, rng.integers(0, 6), replace=False)))
    fps = dict(enumerate(sorted(fps)))
    df = spark.createDataFrame([(v,) for v in fps.values()], "fp bigint")
    root = {r.node: r.root for r in simhash.components(simhash.links(df, chunk=chunk)).collect()}
    want = brute_components(fps)
    assert {v: fps[want[k]] for k, v in fps.items()} == {v: root.get(v, v) for v in fps.values()}


def test_masks_cover():
    m = [x & (1 << 64) - 1 for x in simhash.masks()]
    rng = np.random.default_rng(0)
    for _ in range(3000):
        diff = sum(1 << int(k) for k in rng.choice(64, 3, replace=False))
        assert any(diff & x == 0 for x in m)
    assert len(m) == 15 and min(x.bit_count() for x in m) >= 32


def weak(text):
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 1)


def test_dedup_checks_bytes_behind_a_weak_digest(spark, texts):
    got = {r.id: (r.keep.id, r.n, r.kept) for r in exact_dedup.classes(located(table(spark, SF, "documents")), digest=weak).collect()}
    by = {}
    for k, t in texts.items():
        by.setdefault(t or "", []).append(k)
    assert got == {k: (max(v), len(v), k == max(v)) for v in by.values() for k in v}


def test_hot_digests_and_shuffles_agree(spark, monkeypatch):
    """What is broadcast when it is small is joined by a shuffle when it is not."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    few = sorted(map(str, exact_dedup.classes(located(docs)).select("id", "n", "kept").collect()))
    monkeypatch.setattr(exact_dedup, "HOT", 0)
    assert few == sorted(map(str, exact_dedup.classes(located(docs), most_broadcast=0).select("id", "n", "kept").collect()))
    drops = located(docs).filter("row.doc_id % 3 = 0").select("at")
    assert without(located(docs), drops, most=0).count() == without(located(docs), drops).count() == docs.filter("doc_id % 3 != 0").count()
    assert quality_rules.with_trusted(docs, labels, most_broadcast=0).filter("trusted").count() == labels.filter("quality = 1").count()


def test_stream_knows_what_it_has_seen_after_a_restart(spark, tmp_path):
    """A new object over the same folder goes on: counts add up, and bytes are checked against the retained content."""
    folder, seen = str(tmp_path / "dedup"), []
    for k, rows in enumerate(([(1, "a"), (2, "b"), (3, "a")], [(4, "b"), (5, "c")], [(6, None), (7, "")])):
        spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        dedup = exact_dedup.Dedup(spark, folder)
        assert dedup.arrive(located(spark.read.parquet(str(tmp_path / f"in{k}")))).count() == len(rows)
        seen.append({(r.n, r.keep.id) for r in dedup.states().collect()})
        assert dedup.collisions().count() == 0
    assert seen == [{(2, 3), (1, 2)}, {(2, 3), (2, 4), (1, 5)}, {(2, 3), (2, 4), (1, 5), (2, 7)}]
    other = {}
    for k in range(2):  # under this digest all texts are one; the second arrival's differs from the content at the locator
        dedup = exact_dedup.Dedup(spark, str(tmp_path / "weak"), digest=lambda t: F.lit(b"x"))
        spark.createDataFrame([(k, "ab"[k])], "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
        dedup.arrive(located(spark.read.parquet(str(tmp_path / f"w{k}"))))
        other[k] = dedup.collisions().count()
    assert other == {0: 0, 1: 1}


def test_identifiers_of_any_type(spark):
    docs = spark.createDataFrame([("a1", "x"), ("b2", "x"), (None, "x"), ("c", None)], "doc_id string, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == {"a1": ("b2", 3, False), "b2": ("b2", 3, True), None: ("b2", 3, False), "c": ("c", 1, True)}
    assert {r.doc_id: r.component_id for r in simhash.near_dedup(docs).collect()} == {"a1": "a1", "b2": "a1", None: "a1", "c": "c"}


@given(st.lists(st.integers(1, 9), min_size=1, max_size=8))
@settings(deadline=None)
def test_pfair_windows_and_lag(weights):
    total, got = sum(weights), [0] * len(weights)
    for slot, s, j in mixing.period(weights):
        assert j * total // weights[s] <= slot < -(-(j + 1) * total // weights[s])
        got[s] += 1
        assert all(abs(g - (slot + 1) * w / total) < 1 for g, w in zip(got, weights))
    assert got == weights


def test_mixing_order_is_written(spark, tmp_path):
    docs = table(spark, SF, "documents")
    at = {r.row.doc_id: r.position for r in mixing.scheduled(docs).collect()}
    assert sorted(at.values()) == list(range(len(at)))
    mixing.interleaved(docs, rows_per_file=300).write.parquet(str(tmp_path / "m"))
    files = sorted((tmp_path / "m").glob("*.parquet"))
    ids = [i for f in files for i in pq.read_table(f)["doc_id"].to_pylist()]
    assert len(files) > 1 and [at[i] for i in ids] == list(range(len(ids)))


def test_mixing_with_sources_that_are_not_listed(spark):
    """A plain scheduler of blocks: every slot goes to the waiting block with the earliest deadline; empty slots are closed."""
    rows = [(i, ["x", "y", "z", None, "w"][i % 5]) for i in range(333)]
    docs, target, other, block = spark.createDataFrame(rows, "doc_id bigint, source string"), {"x": 3, "y": 1}, 2, 10
    got = {r.row.doc_id: r for r in mixing.scheduled(docs, target, other, block).collect()}
    groups = {}
    for i, s in sorted(rows, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0])):
        groups.setdefault(s if s in target else "other", []).append(i)
    weights, total, position, slot, done = target | {"other": other}, 6, 0, 0, dict.fromkeys(groups, 0)
    while position < len(rows):
        ready = [(-(-(done[s] + 1) * total // w), k, s) for k, (s, w) in enumerate(weights.items()) if done[s] * total // w <= slot]
        s = min(ready)[2]
        for i in groups[s][done[s] * block : (done[s] + 1) * block]:
            r = got[i]
            assert (r.position, r.slot, r.block_no, r.release, r.deadline) == (position, slot, done[s], done[s] * total // weights[s], -(-(done[s] + 1) * total // weights[s]))
            position += 1
        done[s] += 1
        slot += 1


def test_trees_learn(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    got = quality_gbt.quality(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(got) > 500 and (got.predicted == got.quality).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_splits_are_the_best_there_are():
    """The first tree's splits and leaves against a search over all rows, features and thresholds."""
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 12, (400, 3)).astype(float), rng.integers(0, 2, 400).astype(float)
    y[x[:, 1] > 7] = 1.0
    y[(x[:, 1] <= 7) & (x[:, 2] > 5)] = 0.0
    trees = quality_gbt.fit(x, y)
    p = 1 / (1 + math.exp(-trees.prior))
    g, h = y - p, np.full(len(y), p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality_gbt.RIDGE)
    rows_of = {0: np.ones(len(y), bool)}
    for node in range((1 << quality_gbt.DEPTH) - 1):
        m = rows_of[node]
        f, t = trees.feature[0][node], trees.threshold[0][node]
        best = max(((gain(m & (x[:, k] <= v)) + gain(m & (x[:, k] > v)) - gain(m)) for k in range(3) for v in np.unique(x[:, k])[:-1] if h[m & (x[:, k] <= v)].sum() >= 1 and h[m & (x[:, k] > v)].sum() >= 1), default=0.0)
        own = gain(m & (x[:, f] <= t)) + gain(m & (x[:, f] > t)) - gain(m) if np.isfinite(t) else 0.0
        assert math.isclose(max(best, 0.0), own, abs_tol=1e-9)
        rows_of[2 * node + 1], rows_of[2 * node + 2] = m & (x[:, f] <= t), m & (x[:, f] > t)
    for leaf in range(1 << quality_gbt.DEPTH):
        m = rows_of[(1 << quality_gbt.DEPTH) - 1 + leaf]
        assert math.isclose(trees.value[0][leaf], quality_gbt.RATE * g[m].sum() / (h[m].sum() + quality_gbt.RIDGE), abs_tol=1e-9)


def walked(trees, row):
    """One row down all trees, node by node."""
    total = trees.prior
    for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
        total += value[node - len(feature)]
    return 1 / (1 + math.exp(-total))


def test_scores_are_walks_down_the_trees(spark, texts):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    trees = quality_gbt.trained(docs, labels)
    got = {r.doc_id: r for r in quality_gbt.quality(docs, labels).collect()}
    assert len(got) == len(texts)
    for k, t in texts.items():
        x = walked(trees, quality_gbt.statistics((t or "").encode()))
        assert math.isclose(got[k].score, x, rel_tol=1e-9) and got[k].predicted == (got[k].score >= 0.3) and got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0)


def test_trees_without_labels():
    assert quality_gbt.fit(np.zeros((0, 15)), np.zeros(0)).score(np.zeros((2, 15))).tolist() == [0.5, 0.5]
    one = quality_gbt.fit(np.ones((9, 15)), np.ones(9)).score(np.ones((1, 15)))
    assert one[0] > 0.9


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_of_all_documents(spark, texts, library, rule):
    got = token_counts.section_tokens(table(spark, SF, "documents"), RANKS, P.PATTERN, rule=rule).toPandas()
    size = [len(x) for x in bpe.tokenizer(RANKS, P.PATTERN).bytes_of]
    assert set(got.doc_id) == set(texts)
    for k, own in got.groupby("doc_id"):
        own, text = own.sort_values("section"), texts[k] or ""
        starts = [0, *(m.end() for m in re.finditer("\n", text) if m.end() < len(text))]
        place = [i for i, ch in enumerate(text) for _ in ch.encode()]  # the character of each byte
        counts, crossing, at = Counter(), Counter(), 0
        for i in library.encode_ordinary(text):
            first, last = place[at], place[at + size[i] - 1]
            a, b = bisect_right(starts, first) - 1, bisect_right(starts, last) - 1
            held = Counter(bisect_right(starts, c) - 1 for c in range(first, last + 1))
            s = {"first": a, "last": b, "most": max(held, key=lambda x: (held[x], -x))}[rule]
            counts[s] += 1
            crossing[s] += a != b
            at += size[i]
        assert own.char_start.tolist() == starts and own.char_end.tolist() == [*starts[1:], len(text)]
        assert own.n_tokens.tolist() == [counts[s] for s in range(len(starts))] and own.n_crossing.tolist() == [crossing[s] for s in range(len(starts))]


def test_rules_of_allocation():
    first, last, starts = np.array([0, 2, 5]), np.array([1, 4, 9]), np.array([0, 3, 8])
    assert token_counts.allocate(first, last, starts, "first")[0].tolist() == [0, 0, 1]
    assert token_counts.allocate(first, last, starts, "last")[0].tolist() == [0, 1, 2]
    own, cross = token_counts.allocate(first, last, starts, "most")
    assert own.tolist() == [0, 1, 1] and cross.tolist() == [False, True, True]
    with pytest.raises(ValueError):
        token_counts.allocate(first, last, starts, "none")


def test_fields(spark):
    rows = spark.createDataFrame([(1, "Title", None, "the body text"), (2, None, None, None)], "doc_id int, a string, b string, c string")
    got = token_counts.field_tokens(rows, ["a", "b", "c"], RANKS, P.PATTERN).orderBy("doc_id", "section").collect()
    t = bpe.tokenizer(RANKS, P.PATTERN)
    assert [r.char_start for r in got] == [0, 6, 7, 0, 1, 2] and sum(r.n_tokens for r in got[:3]) == len(t.encode("Title\n\nthe body text"))


def test_url_terms():
    terms = url_filter.listed({"casino": 2.0, "Free": 1, "bets": 1.0, "bet": 0.5})
    assert url_filter.hits("http://casino.example/", terms) == (1, 0, 2.0)
    assert url_filter.hits("http://casinoroyal.example/xcasino", terms) == (0, 0, 0)
    assert url_filter.hits("http://x.example/free-free-bets", terms) == (0, 2, 2.0)
    assert url_filter.hits("http://x.example/freedom", terms) == (0, 0, 0)
    assert url_filter.hits("bet", terms) == (0, 1, 0.5) and url_filter.hits("ébets", terms)[1] == 1


@given(st.text(alphabet="abx-./é1", max_size=40))
@settings(deadline=None, max_examples=300)
def test_url_terms_against_plain_search(url):
    words = {"a": 0.5, "ab": 1.0, "b-a": 1.0, "xx": 2.0, "x.x": 0.5}
    found = [w for w in words if re.search(f"(?<![a-z0-9]){re.escape(w)}(?![a-z0-9])", url)]
    got = url_filter.hits(url, url_filter.listed(words))
    assert got == (sum(words[w] >= 2 for w in found), sum(words[w] < 2 for w in found), sum(words[w] for w in found))


def test_url_rules_and_vocabulary_table(spark):
    """Of equally long rules the one with the longer host wins; a vocabulary may be a table, in which nulls mean nothing."""
    pages = spark.createDataFrame([(1, "http://a.com/ab/c"), (2, "http://com/ab/"), (3, "https://x.org/bad"), (4, "https://x.org/worse-bad"), (5, None)], "page_id int, url string")
    rules = (("com", "/ab/", "allow"), ("a.com", "/a", "block"), ("com", "/", "block"))
    vocabulary = spark.createDataFrame([("BAD", 1.0), ("worse", 1.0), ("bad", 0.5), (None, 2.0), ("x", None)], "term string, weight double")
    got = url_filter.url_filter(pages, rules, vocabulary).orderBy("page_id").collect()
    assert [(r.rule, r.verdict, r.weight) for r in got] == [("a.com/a", "block", 0.0), ("com/ab/", "allow", 0.0), (None, "allow", 1.0), (None, "block", 2.0), (None, "allow", 0.0)]


def test_rows_with_equal_identifiers_keep_their_places(spark):
    """Rows with one identifier and different texts have the same positions however they come."""
    rows = [(k % 3 or None, f"text {k}", "src0") for k in range(200)]
    got = []
    for seed in (1, 2):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").orderBy(F.xxhash64("text", F.lit(seed))).repartition(3 + seed)
        got.append(sorted((r.position, r.row.text) for r in mixing.scheduled(docs).collect()))
    assert got[0] == got[1] and [p for p, _ in got[0]] == [*range(200)]


def test_mixing_makes_no_more_files_than_asked(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'a' AS text", "concat('src', id % 3) AS source")
    got = mixing.interleaved(docs, rows_per_file=10, most_files=7)
    assert got.rdd.getNumPartitions() == 7 and got.count() == 5000


def test_mixing_splits_rows_that_share_an_identifier(spark, monkeypatch):
    """Null and the empty text, whose hash is the same, and another identifier hold most rows; the order is that of a plain sort."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 16)
    ids = [None] * 1500 + [""] * 500 + ["often"] * 700 + [str(k) for k in range(900)]
    rows = [(i, f"text {k}", ["src0", "src1"][k % 7 == 0]) for k, i in enumerate(ids)] + [("often", "a copy", "src0")] * 3
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string").repartition(5)
    hashed = docs.select("source", F.md5(F.coalesce("doc_id", F.lit(""))).alias("h"), F.xxhash64("doc_id", "text", "source").alias("x"), F.coalesce("doc_id", F.lit("")).alias("id"), "text")
    plain = {}
    for r in sorted(hashed.collect(), key=lambda r: (r.h, r.x, r.id)):
        plain.setdefault(r.source, []).append(r.text)
    got = {}
    for r in mixing.scheduled(docs, block=8).orderBy("position").collect():
        got.setdefault(r.row.source, []).append(r.row.text)
    assert got == plain
    s = F.when(F.col("source") == "src0", 0).otherwise(1)
    held = {k: len(plain[f"src{k}"]) for k in (0, 1)}
    cut, keys = mixing.ranged(hashed.withColumn("s", s), held)
    sizes = [r["count"] for r in cut.groupBy(*keys).count().collect()]
    assert len(keys) == 4 and sum(sizes) == len(rows) and max(sizes) <= 16 * mixing.HEAVY


@pytest.mark.parametrize("most_broadcast", [0, 1 << 20])
def test_a_text_of_a_third_of_the_rows_is_compared_where_it_is(spark, most_broadcast):
    """Neither way shuffles it but once for each task; weak digests are found out."""
    rows = [(k, "the same " * 200 if k % 3 == 0 else f"text {k // 2}") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs, most_broadcast=most_broadcast, digest=lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 2))).collect()}
    by_text = {}
    for k, t in rows:
        by_text.setdefault(t, []).append(k)
    assert got == {k: (max(by_text[t]), len(by_text[t])) for k, t in rows}


def test_vocabularies_are_measured_before_tasks_get_them(spark):
    assert len(url_filter.vocabulary_file()) == len(url_filter.VOCABULARY) > 40 and set(url_filter.VOCABULARY.values()) == {2.0, 1.5, 1.0, 0.5}
    terms = spark.range(100).selectExpr("concat('term', id) AS term", "1.0D AS weight")
    assert len(url_filter.listed(terms)) == 100
    with pytest.raises(ValueError, match="bytes"):
        url_filter.listed(terms, most_bytes=1000)

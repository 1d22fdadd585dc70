"""Periodic runs, exact top-k and the conversation trie against plain loops."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import pivots, ztrie
from docketry.llm.pivots import scaled_down, top_products
from docketry.llm.queries import QUERIES, plant_periods, splice_openings
from docketry.llm.squares import SquareCatcher, find_runs
from docketry.llm.ztrie import ZFastTrie, gather_turns, prefix_nodes, two_fattest
from tests.llm import brute

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def runs_by_loops(w, least=6, powers=4):
    found = []
    for q in range(1, len(w) // powers + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i + q - start
            if length >= max(least, powers * q):
                if not any(all(w[x] == w[x + d] for x in range(start, start + length - d)) for d in range(1, q)):
                    found.append((start, length, q))
            i += 1
    return sorted(found)


def collapse(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic(rng, n, letters):
    w = []
    while len(w) < n:
        w += [rng.randrange(letters) for _ in range(rng.randint(1, 9))] * rng.randint(1, 8)
    return w[:n]


def test_catcher_finds_all_runs_whatever_the_steps():
    rng = random.Random(1)
    for _ in range(800):
        w = periodic(rng, rng.randint(0, 120), rng.choice([1, 2, 3, 5]))
        want = runs_by_loops(w)
        for steps in ([1], [200], [1, 2, 7, 50]):
            catcher, i = SquareCatcher(), 0
            while i < len(w):
                step = rng.choice(steps)
                catcher.append(np.array(w[i : i + step]))
                i += step
            assert catcher.runs() == want


def test_catcher_needs_four_periods():
    with pytest.raises(ValueError):
        SquareCatcher(3)


def test_equal_hashes_are_no_square():
    """Two Thue-Morse words that a polynomial modulo 2^64 cannot tell apart."""
    word = [0]
    for _ in range(11):
        word += [1 - x for x in word]
    half = np.array(word[:1024] + word[1024:2048])
    catcher = SquareCatcher()
    catcher.append(half)
    assert catcher.runs() == runs_by_loops(half.tolist())


SCHEMA = "doc_id bigint, text string, runs string, rest int, n_words int, collapsed string"


def run_rows():
    rng = random.Random(5)
    texts = [" ".join(f"w{x}" for x in periodic(rng, rng.randint(1, 90), 3)) for _ in range(40)]
    texts += [None, "", " \n\t ", "a", "a a a a a", "a a a a a a", "A a a a a a a", "x\x0bx x\tx\nx x  x", "é é é é é é é"]
    texts += ["a b " * 9_000, " ".join(f"u{i}" for i in range(20_000)) + " u1 u2" * 5, *texts[:4]]
    return [(i, t, "r", 1, 2, "c") for i, t in enumerate(texts)] + [(None, "z " * 8, "r", 1, 2, "c"), (3, texts[3], "r", 1, 2, "c")]


def test_runs_of_documents(spark):
    rows = run_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = find_runs(docs).select("rest.doc_id", "rest.runs", "n_words", F.col("runs").alias("found"), "collapsed").collect()
    want = []
    for i, text, *_ in rows:
        w = re.findall(brute.WORD, text or "")
        found = runs_by_loops(w) if len(w) < 5000 else ([(0, 18_000, 2)] if text[0] == "a" else [(20_000, 10, 2)])
        want.append((i, "r", len(w), str(found), collapse(w, found)))
    assert Counter((r.doc_id, r.runs, r.n_words, str([tuple(x) for x in r.found]), r.collapsed) for r in got) == Counter(want)
    assert find_runs(docs.filter("false")).count() == 0


def test_query_of_runs(spark, tmp_path):
    rows = [(i if i != 7 else None, t) for i, (_, t, *_) in enumerate(run_rows()) if len(t or "") < 20_000] + [(100 + i, "p q r s t " * 9) for i in range(60)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()
    want, planted = [], 0
    for i, text in rows:
        w = re.findall(brute.WORD, text or "")
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, planted = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)], planted + 1
        runs = runs_by_loops(w)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None,) * 3
        milli = 1000 * best[1] // best[2] if runs else None
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        want.append((i, len(runs), *best, milli, sha(lines), sha(collapse(w, runs)), len(w)))
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words"]
    assert Counter(tuple(r[c] for c in columns) for r in got) == Counter(want)
    assert planted > 5 and sum(x[1] > 1 for x in want) > 3


VECTORS = "vec_id bigint, embedding array<float>, label int, row int, v string, cell int, far int"


def vector_rows():
    rng = random.Random(2)
    rows = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(300)]
    rows += [[0.25] * 6] * 120 + [[0.0] * 6] * 3 + [[5.0] + [0.0] * 5, [-1.0] * 6]
    rows += [None, [None] + [1.0] * 5, [float("nan")] * 6, [float("inf")] + [0.0] * 5, [], [1.0, 2.0], [2.0, 1.0], [3.0]]
    out = [(i, v, 1, 2, "v", 3, 4) for i, v in enumerate(rows)]
    return out + [(10, rows[11], 1, 2, "v", 3, 4), (None, rows[3], 1, 2, "v", 3, 4), (10, rows[10], 1, 2, "v", 3, 4)]


def top_by_loops(rows, every, k):
    whole = []
    for n, (i, v, *_) in enumerate(rows):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            whole.append((n, i, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = Counter()
    for n, i, v in whole:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, c)), j) for m, j, c in whole if m != n and len(c) == len(v))
            out.update((i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1))
    return out


@pytest.mark.parametrize("small_groups", [False, True])
@pytest.mark.parametrize("k", [1, 5, 700])
def test_top_products(spark, monkeypatch, k, small_groups):
    if small_groups:
        for name, size in {"CANDIDATES_PER_GROUP": 9, "QUERIES_PER_GROUP": 4, "SAMPLE_VECTORS": 20, "FIRST_STEP": 2}.items():
            monkeypatch.setattr(pivots, name, size)
    frame = spark.createDataFrame(vector_rows(), VECTORS).repartition(4)
    whole = frame.withColumn("whole", scaled_down(F.col("embedding"), 256))
    got = top_products(whole, "vec_id", "whole", F.col("vec_id") % 10 == 0, k, pivots=4).collect()
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == top_by_loops(vector_rows(), 10, k)


def test_top_products_of_nothing(spark):
    whole = spark.createDataFrame(vector_rows(), VECTORS).withColumn("whole", scaled_down(F.col("embedding"), 256))
    for frame in (whole.filter("false"), whole.filter("embedding is null")):
        assert top_products(frame, "vec_id", "whole", F.col("vec_id") % 10 == 0).collect() == []
    assert top_products(whole, "vec_id", "whole", F.lit(False)).collect() == []
    assert len(top_products(whole.filter("vec_id in (0, 1)"), "vec_id", "whole", F.col("vec_id") == 0).collect()) == 1


def test_few_products_are_taken(monkeypatch):
    """The bounds end the search early where vectors lie in clusters."""
    rng = np.random.default_rng(0)
    middles = rng.normal(size=(20, 8)) * 300
    vectors = np.concatenate([m + rng.normal(size=(100, 8)) * 5 for m in middles]).astype(np.int64)
    longest2 = float((vectors.astype(float) ** 2).sum(1).max())
    book = pivots.choose_pivots(vectors[::7], longest2, np.arange(0, 2000, 7), 32)
    far = book.distances(vectors.astype(float), book.last(vectors.astype(float)))
    query = vectors[:1].astype(float)
    apart = book.distances(query, np.zeros(1))
    bounds = book.bound((query**2).sum(1), np.abs(far - apart).max(1))
    scores = vectors @ vectors[0]
    assert (bounds >= scores).all()
    assert (bounds >= np.sort(scores)[-5]).sum() < 500


def test_two_fattest():
    for low in range(70):
        for high in range(low + 1, 71):
            best = max(range(low + 1, high + 1), key=lambda x: x & -x)
            assert two_fattest(low, high) == best


def test_trie_finds_exits_by_hash():
    rng = random.Random(4)
    trie, known = ZFastTrie(), []
    for _ in range(12):
        batch = []
        for _ in range(20):
            start = rng.choice(known)[: rng.randint(0, 60)] if known and rng.random() < 0.7 else []
            batch.append(start + [bytes([rng.randrange(3)]) for _ in range(rng.randint(0, 25))])
        trie.insert([(s, 1, 0) for s in batch])
        known += batch
    prefixes = Counter(tuple(s[:d]) for s in known for d in range(len(s) + 1))
    nodes = trie.nodes()
    whole = {tuple(trie.turns[n.of][: n.extent]) for n in nodes}
    branching = {p for p in prefixes if len({q[len(p)] for q in prefixes if len(q) == len(p) + 1 and q[: len(p)] == p}) > 1}
    assert whole == branching | {tuple(s) for s in known} | {()} and len(whole) == len(nodes)
    assert len(trie.handles) == len(nodes) or not ztrie.BASE
    for s in known[::7]:
        longer = s + [b"new"]
        exit_node = trie.exit(longer, trie._hash(longer))
        assert trie.turns[exit_node.of][: exit_node.extent] == s


def test_trie_survives_equal_hashes(monkeypatch):
    monkeypatch.setattr(ztrie, "BASE", 0)  # the hash of a prefix is that of its last turn
    test_trie_finds_exits_by_hash()


TALK = "conv_id bigint, turn int, role string, text string, turns string, n int, range string"


def talk_rows():
    rng, rows = random.Random(6), []
    for c in range(160):
        n = rng.choice([0, 1, 2, 3, 5, 8, 12]) if c != 41 else 300
        same = rng.random() < 0.4
        for t in range(n):
            text = rng.choice(["hi", "hello é", "", None]) if t < 4 or rng.random() < 0.5 else f"{c} {t}"
            rows.append((c, t if not same else (None if t == 0 else t), rng.choice(["user", "bot", None]) if not same else "user", "hi" if same else text))
    rows += [(1000 + i, t, "user", f"same {t}") for i in range(90) for t in range(4)]
    rows += [(-7, 1, "user", "hi"), (-5, 1, "user", "hi"), (None, 1, "user", "hi"), (None, 2, None, None), (500, 3, None, None), (500, 3, None, None)]
    rng.shuffle(rows)
    return [(*r, "x", 1, "y") for r in rows]


def talks(rows, spliced):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    if not spliced:
        return own
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    # the remainder keeps the sign of c, as in SQL
    return {c: own.get(c - int(np.fmod(c, 5)), [])[: h[c]] + v[h[c] :] for c, v in own.items()}


def trie_by_loops(talk):
    members = {}
    for c, turns in talk.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
         sha(",".join(str(c) for c in sorted(m) if len(talk[c]) == len(p))))
        for p, m in members.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("per_range", [50_000, 40, 1])
@pytest.mark.parametrize("spliced", [False, True])
def test_conversation_nodes(spark, monkeypatch, per_range, spliced):
    monkeypatch.setattr(ztrie, "TURNS_PER_RANGE", per_range)
    monkeypatch.setattr(ztrie, "SEQUENCES_PER_BATCH", 5)
    monkeypatch.setattr(ztrie, "IDS_PER_SEGMENT", 16)
    rows = talk_rows()
    turns = gather_turns(spark.createDataFrame(rows, TALK).repartition(4))
    got = prefix_nodes(splice_openings(turns) if spliced else turns).collect()
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got) == trie_by_loops(talks(rows, spliced))


def test_no_conversations(spark):
    assert prefix_nodes(gather_turns(spark.createDataFrame([], TALK))).collect() == []
    lone = gather_turns(spark.createDataFrame([(3, 1, "user", "é", "", 1, "")], TALK))
    got = prefix_nodes(lone.select("conv_id", F.slice("turns", 1, 0).alias("turns"))).collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == [(3, 0, None, 1, 0, 1, 0, sha("3"))]


def test_planting_keeps_columns(spark):
    docs = spark.createDataFrame([(13, "a b c", 1)], "doc_id bigint, text string, _h int")
    assert plant_periods(docs).columns == ["doc_id", "text", "_h"]

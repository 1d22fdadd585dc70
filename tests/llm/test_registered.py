"""The registered queries and the whole pipeline on a small folder against plain loops, hashes included."""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from docketry.llm.queries import QUERIES
from tests.llm import brute

PAIRS = brute.corpus()
sha = lambda data: hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("small")
    spark.createDataFrame(brute.rows(PAIRS), brute.SCHEMA).repartition(3).write.parquet(str(path / "documents.parquet"))
    return str(path)


@pytest.fixture(scope="module")
def tokenizer():
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rows(spark, folder, name, *columns):
    return Counter(tuple(r[c] for c in columns) for r in QUERIES[name](spark, folder).collect())


def test_substring_dedup(spark, results_only, folder):
    want = Counter((i, n, gone, sha(kept)) for i, (kept, n, gone) in brute.passages(PAIRS).items())
    assert rows(spark, folder, "op2_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_suffix_dedup(spark, results_only, folder):
    want = Counter((i, n, gone, spans, sha(kept)) for i, kept, n, gone, spans in brute.repeated_bytes(PAIRS))
    assert rows(spark, folder, "op3_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_base_of_quality(spark, results_only, folder):
    want = Counter()
    for i, text in PAIRS:
        counts = brute.quality_counts(text)
        want[i, *counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0]] += 1
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows(spark, folder, "op4_quality_rules", *columns) == want


def test_byte_bpe(spark, results_only, folder, tokenizer):
    want = Counter()
    for i, text in PAIRS:
        ids = tokenizer.encode_ordinary(text or "")
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(text or "")] += 1
    assert rows(spark, folder, "op5_byte_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_near_dedup(spark, results_only, folder):
    want = Counter((i, *v) for i, v in brute.near_duplicates(PAIRS, 4).items())
    assert rows(spark, folder, "op9_minhash_near_dedup", "doc_id", "n_shingles", "component_id", "kept") == want


def test_base_of_scores(spark, results_only, folder):
    want = brute.unigram(PAIRS)
    got = {r.doc_id: r for r in QUERIES["op10_maxent_score"](spark, folder).collect()}
    assert {i: (r.held_out, r.n_tokens, r.n_known, r.train_tokens) for i, r in got.items()} == {i: v[:4] for i, v in want.items()}
    assert all(math.isclose(got[i].base_score, v[4], rel_tol=1e-9) for i, v in want.items())


def test_mix_is_whole(spark, results_only, folder):
    got = QUERIES["op6_source_mix"](spark, folder).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in PAIRS)
    assert len({(r.slot, r.rank) for r in got}) == len(got)


def test_pipeline(spark, results_only, folder, tokenizer):
    result = QUERIES["pipeline"](spark, folder)
    verdicts = brute.quality_verdicts([r[:4] for r in brute.rows(PAIRS)])
    kept = {i for i, fine in verdicts if fine}
    pairs = [(i, t) for i, t in PAIRS if i in kept]
    near = brute.near_duplicates(pairs, 5)
    pairs = [(i, t) for i, t in pairs if near[i][2]]
    texts = {i: t if not gone else k for (i, t), (k, n, gone) in zip(sorted(pairs), sorted_values(brute.passages(pairs))) if gone < n or not n}
    assert {r.doc_id: list(r.ids) for r in result.collect()} == {i: tokenizer.encode_ordinary(t) for i, t in texts.items()}
    assert result.filter(~F.col("round_trip")).count() == 0


def sorted_values(found):
    return [found[i] for i in sorted(found)]

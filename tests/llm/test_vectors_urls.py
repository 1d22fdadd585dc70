"""Vectors and urls against plain loops."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from docketry.llm.embeddings import _forest, link_vectors, multi_sequence
from docketry.llm.urls import judge_urls
from tests.llm.brute import Groups


def brute_links(rows, least=0.98):
    groups, n = Groups(), {}
    ok = {i: np.array(v, float) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: l for i, _, l in rows}
    for i, _, _ in rows:
        n[i] = 0
        groups.find(i)
    for a in ok:
        for b in ok:
            if a < b and label[a] == label[b] and len(ok[a]) == len(ok[b]):
                if ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= least:
                    n[a] += 1
                    n[b] += 1
                    groups.join(a, b)
    return {i: (n[i], groups.find(i), groups.find(i) == i) for i in n}


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(160):
        rows.append((i, rng.normal(size=8), i % 3))
    for i in range(160, 400):  # around a few middles, at angles on both sides of the limit
        middle = np.random.default_rng(i % 4).normal(size=8)
        rows.append((i, middle + rng.normal(size=8) * (0.02 if i % 2 else 0.2), i % 2))
    rows = [(i, [float(x) for x in v], l) for i, v, l in rows]
    rows += [(500, rows[0][1], 0), (501, [2 * x for x in rows[0][1]], 0), (502, rows[0][1], None), (503, None, 1), (504, [0.0] * 8, 1)]
    rows += [(505, [1.0, None] + [0.0] * 6, 1), (506, [float("nan")] * 8, 1), (507, [float("inf")] * 8, 1), (508, [1.0], 1), (509, [3.0], 1), (510, [], 1)]
    return rows


SCHEMA = "vec_id bigint, embedding array<double>, label int"


@pytest.mark.parametrize("codewords", [1, 4, 32])
def test_links(spark, codewords):
    rows = vectors()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in link_vectors(spark.createDataFrame(rows, SCHEMA), codewords=codewords).collect()}
    assert got == brute_links(rows)


def test_links_with_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (None, [1.0, 0.0], 1)]
    got = link_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.n_links) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 1)]
    assert link_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_traversal_is_in_order_and_complete():
    a, b = np.array([0.3, 0.0, 0.2]), np.array([0.1, 0.4, 0.0])
    found = list(multi_sequence(a, b, 0.45))
    sums = [a[i] + b[j] for i, j in found]
    assert sums == sorted(sums) and set(found) == {(i, j) for i in range(3) for j in range(3) if a[i] + b[j] <= 0.45}


def test_forest_keeps_components():
    linked = np.array([[1, 0, 0, 0], [0, 1, 1, 0], [0, 0, 1, 1]], bool)
    rows, columns = _forest(linked)
    assert rows.tolist() == [0, 1, 1] and columns.tolist() == [0, 1, 1, 1]


RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
    ("a.b.example.net", "/", "allow"), ("b.example.net", "/x", "block"), ("example.net", "/en/deep/", "block"), ("net", "/", "block"), (None, "/", "allow"),
]
URLS = [
    "http://net/", "https://x.NET/a", "https://example.net/en/1?q", "https://www.example.net/en/deep/2#z", "https://example.net/enx",
    "https://notexample.net/en/", "http://a.b.example.net/xy", "http://b.example.net/xy", "http://c.b.example.net/x", "http://example.com/de/",
    "http://example.com/DE/", "http://example.org/fr/", "http://org", "no scheme", "://x.net/", "", None, "http://EXAMPLE.com:80/de/",
    "http://u:p@example.com/de/1", "ftp://a.b://c/en/", "http://example.net", "http://b.example.net/x\n/y", "http://é.net/ü", "http:///en/",
    "http://example zz.net/en/1", "http://example y.com/de/1", "http://org z/fr/", "http://a\tb.net/x", "http://x\x01.example.net/en/",
    "http://.net/", "http://net./", "http://a..net/", "http://" + "a." * 3000 + "net/" + "x" * 5000, "http://b.example.net/" + "x/" * 9000,
]


def brute_url(url, otherwise="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[2:] if fits else (None, otherwise))


def test_urls(spark, monkeypatch):
    rules = spark.createDataFrame(pa.table(dict(zip(("host", "path", "verdict"), map(list, zip(*RULES))))))
    data = [(k, u, "clash") for k, u in enumerate(URLS * 2)] + [(None, URLS[1], "clash")]
    for hosts_per_sweep in (100_000, 1):
        monkeypatch.setattr("docketry.llm.urls.HOSTS_PER_SWEEP", hosts_per_sweep)
        pages = spark.createDataFrame(data, "page_id bigint, url string, host string")
        got = judge_urls(pages, rules).select("*", "row.page_id", "row.url").collect()
        assert len(got) == len(data)
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == brute_url(r.url), r.url
    assert judge_urls(pages.filter("false"), rules).count() == 0
    assert {r.verdict for r in judge_urls(pages, rules.filter("false"), otherwise="block").collect()} == {"block"}

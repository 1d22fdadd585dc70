"""The same results by plain loops, and a small corpus with the awkward cases."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string, found int, kept boolean, `odd name` string, rest string"


def corpus(seed: int = 7) -> list[tuple]:
    """(doc_id, text): copies, near copies, shared passages, repeats in one text, nulls, ties, one long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, short = say(70), say(49)
    texts = [" ".join(say(rng.randint(1, 160))) for _ in range(14)]
    for _ in range(5):
        texts.append(" ".join(say(30) + passage + say(20)))
    texts.append(" ".join(passage[:60] + say(10) + passage[5:]))
    texts += [" ".join(say(10) + short + say(10)) for _ in range(2)]
    base = say(120)
    texts += [" ".join(base)] * 3
    for place in (3, 60, 119):
        near = list(base)
        near[place] = "changed"
        texts.append(" ".join(near))
    half = base[:60] + say(60)
    texts += [" ".join(half), " ".join(half).upper(), "  \t ".join(half)]
    texts += ["one", "one", "two words", "three small words", "a b c d", "", None, " \n\t ", "x" * 700, "ab" * 500]
    texts.append(" ".join(say(6_000)) + " " + " ".join(passage))
    texts.append("line one here\nline two\nline one here\n\n line one here\n#$ * |\n" * 3)
    texts.append("Released under the MIT License; see CC-BY-NC. Apache License, Version 2.0 under the mit license")
    texts.append("the the the the the the " + "ü " * 60 + "the the the")
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


def rows(pairs, sources=("a", "b", None)):
    """Documents with extra columns whose names clash with what the operators use."""
    return [
        (i, t, ("en", "de", None)[(i or 0) % 3], sources[(i or 0) % len(sources)], None if t is None else len(t), "w", i, True, "o", "r")
        for i, t in pairs
    ]


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


class Groups:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def shingles(text, n):
    w = re.findall(WORD, lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_duplicates(pairs, n, percent=80):
    sets, groups = {i: shingles(t, n) for i, t in pairs}, Groups()
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                groups.join(a, b)
    return {i: (len(s), groups.find(i), groups.find(i) == i) for i, s in sets.items()}


def passages(pairs, window=50):
    first, out = {}, {}
    split = {i: tuple(re.findall(WORD, t or "")) for i, t in pairs}
    for i in sorted(split):
        w = split[i]
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first.setdefault(w[j : j + window], i) < i:
                gone[j : j + window] = [True] * window
        out[i] = (" ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone))
    return out


def repeated_bytes(pairs, length=400):
    """One result per row, in order; rows may repeat."""
    data = [(i, (t or "").encode()) for i, t in pairs]
    seen = Counter(d[j : j + length] for _, d in data for j in range(len(d) - length + 1))
    out = []
    for i, d in data:
        gone = np.zeros(len(d), bool)
        for j in range(len(d) - length + 1):
            if seen[d[j : j + length]] > 1:
                gone[j : j + length] = True
        spans = int(np.count_nonzero(np.diff(np.r_[False, gone].astype(int)) == 1))
        out.append((i, bytes(np.frombuffer(d, np.uint8)[~gone]), len(d), int(gone.sum()), spans))
    return out


def quality_counts(text):
    w = re.findall(WORD, text or "")
    seen, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if seen[w[i], w[i + 1], w[i + 2]] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    symbols = sum((text or "").count(s) for s in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def quality_verdicts(documents, prior=100):
    """Kept or not per (doc_id, text, lang, source), by sketches of leading binary digits and limits drawn to wider kinds."""
    names = ("word_length", "symbols", "dup_lines", "repeat_words")
    digits = lambda v: v >> max(v.bit_length() - 5, 0) << max(v.bit_length() - 5, 0)
    rows = []
    for i, text, lang, source in documents:
        n, chars, symbols, dup, repeat = quality_counts(text)
        lines = len([x for x in (text or "").split("\n") if re.search(WORD, x)])
        values = (1000 * chars // max(n, 1), 1000 * symbols // max(n, 1), 1000 * dup // max(lines, 1), 1000 * repeat // max(n, 1))
        rows.append((i, lang, source, n < 50 or 100 * repeat > 50 * n, values))

    def quantile(values, percent):
        ordered = sorted(map(digits, values))
        return next(v for k, v in enumerate(ordered, 1) if 100 * k >= percent * len(ordered))

    def own(passing, k):
        values = [v[k] for *_, v in passing]
        return 2.0 * quantile(values, 90), 0.5 * quantile(values, 10), quantile(values, 99)

    passing = [r for r in rows if not r[3]]
    draw = lambda n, mine, wider: (n * mine + prior * wider) / (n + prior)
    kept = []
    for i, lang, source, failed, values in rows:
        fine = not failed
        if fine:
            in_lang = [r for r in passing if r[1] == lang]
            group = [r for r in in_lang if r[2] == source]
            for k, name in enumerate(names):
                a, l, g = own(passing, k), own(in_lang, k), own(group, k)
                most, least = (draw(len(group), g[e], draw(len(in_lang), l[e], a[e])) for e in (0, 1))
                fine &= values[k] <= most + (a[2] if k else 0) and (k > 0 or values[k] >= least)
        kept.append((i, fine))
    return kept


def unigram(pairs):
    tokens = {i: [*re.findall(WORD, lower(t)), None] for i, t in pairs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(x for i, t in tokens.items() if not held[i] for x in t)
    n, v = sum(c.values()), len(c)
    return {
        i: (held[i], len(t), sum(x in c for x in t), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t))
        for i, t in tokens.items()
    }

"""License texts and notices in documents, found by voting on diagonals of shared word runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.llm.textops import chunks, span_hashes, word_hashes

# Phrases that name a license wherever they stand, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Paragraphs of license texts and notices, in lower-case words, with their labels.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and "
    "associated documentation files the software to deal in the software without restriction": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the software": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in "
    "compliance with the license": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted "
    "provided that the following conditions are met": "bsd",
    "redistributions of source code must retain the above copyright notice this list of conditions and "
    "the following disclaimer": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu "
    "general public license as published by the free software foundation": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu "
    "lesser general public license as published by the free software foundation": "lgpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "permission to use copy modify and or distribute this software for any purpose with or without fee "
    "is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons attribution 3 0 unported license": "cc-by",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "this work is licensed under a creative commons attribution noncommercial 3 0 unported license": "cc-by-nc",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "this work is licensed under a creative commons attribution noderivatives 4 0 international license": "cc-by-nd",
    "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license": "cc-by-nc-sa",
    "this work is licensed under a creative commons zero v1 0 universal license": "cc0",
    "to the extent possible under law the author has waived all copyright and related or neighboring "
    "rights to this work cc0 1 0 universal": "cc0",
}

# Words are runs of ASCII letters and digits and of all characters beyond ASCII.
_LICENSE_WORD = np.zeros(256, bool)
_LICENSE_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

GRAM = 3
KEY = ["doc_id", "text_hash"]
ROWS_PER_BATCH = 200_000
TEMPLATE_WORDS_LIMIT = 100_000


def _grams(batch_texts: pa.Array, gram: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row, number of words and hashes of all runs of `gram` words of each text."""
    for chunk in chunks(batch_texts, lower=True):
        starts, ends, first = chunk.words(_LICENSE_WORD)
        words = word_hashes(chunk.data, starts, ends)
        at = np.arange(max(len(words) - gram + 1, 0))
        hashes = span_hashes(words, at, at + gram).view(np.int64)
        for i, (low, high) in enumerate(zip(first[:-1].tolist(), first[1:].tolist()), chunk.first_row):
            yield i, high - low, hashes[low : max(high - gram + 1, low)]


def _rows(gram: int):
    """One row per word run of a text, and one without a place that tells its number of words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[np.ndarray] = []
            places: list[np.ndarray] = []
            values: list[np.ndarray] = []

            def flush() -> pa.RecordBatch:
                empty = np.zeros(0, np.int64)
                row, place, value = (np.concatenate([*x, empty]).astype(np.int64) for x in (rows, places, values))
                taken = pa.array(row)
                return pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(taken) for k in KEY), pa.array(place), pa.array(value)], [*KEY, "place", "value"]
                )

            held = 0
            for i, n_words, own in _grams(batch.column("text"), gram):
                rows.append(np.full(len(own) + 1, i))
                places.append(np.arange(-1, len(own)))
                values.append(np.concatenate([[n_words], own]))
                held += len(own) + 1
                if held >= ROWS_PER_BATCH:
                    yield flush()
                    rows, places, values, held = [], [], [], 0
            yield flush()

    return work


def template_grams(docs: DataFrame, gram: int) -> DataFrame:
    """(gram, template, label, phrase, runs, own, at): where each word run stands in the templates.

    `own` lists the places of the runs that no license text of another label has; a single word
    tells some licenses apart. The templates are the module's fixed texts; the limit proves that
    they are small.
    """
    texts = [(t, label, True) for t, label in PHRASES.items()] + [(t, label, False) for t, label in TEMPLATES.items()]
    if sum(len(t.split()) for t, _, _ in texts) > TEMPLATE_WORDS_LIMIT:
        raise ValueError("templates are too long to be sent to every task")
    found = [(i, n_words, own.tolist()) for i, n_words, own in _grams(pa.array([t for t, _, _ in texts]), gram)]
    labels: dict[int, set[str]] = {}
    for i, n_words, own in found:
        if n_words < gram:
            raise ValueError(f"a template has fewer than {gram} words: {texts[i][0]}")
        for value in own:
            labels.setdefault(value, set()).update([] if texts[i][2] else [texts[i][1]])
    rows = []
    for i, _, own in found:
        distinct = [at for at, value in enumerate(own) if labels[value] == {texts[i][1]}]
        rows += [(value, i, texts[i][1], texts[i][2], len(own), distinct, at) for at, value in enumerate(own)]
    names = ("gram", "template", "label", "phrase", "runs", "own", "at")
    return docs.sparkSession.createDataFrame(pa.table(dict(zip(names, map(list, zip(*rows))))))


def scan_licenses(docs: DataFrame, gram: int = GRAM, neighbours: int = 4, least: float = 0.6) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row of `docs` (doc_id, text).

    All rolling runs of `gram` words are joined by hash to their places in the templates. A hit
    votes for the diagonal of its template: place in the text less place in the template. A
    phrase stands wherever one diagonal has all its runs; n_base counts these places, first_word
    and last_word are the smallest and largest of them.

    For the license texts, diagonals that are at most `neighbours` words apart merge (words put
    in or left out shift the diagonal). A span is verified if it holds at least `least` of the
    template's runs and half of those that no other license has, and is no longer than twice the
    template; a single diagonal is also tried by itself. score is the largest share of a template that a verified span holds, 1 for a
    phrase, 0 for nothing. Labels are sorted and joined by commas, empty if there are none.

    The template table is fixed and small, so it is sent to every task and the runs of the texts
    are not shuffled: only hits and one row per text are, votes counted before. All later
    groups are those of one text, and a long text yields its runs in batches. A null or empty text
    has no words. Repeated rows get a row each, and rows with equal or null doc_ids are told apart
    by their texts. An empty table gives no rows; columns beside doc_id and text are left alone.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    runs = rows.mapInArrow(_rows(gram), "doc_id bigint, text_hash bigint, place bigint, value bigint")
    templates = F.broadcast(template_grams(docs, gram))
    hits = runs.join(templates, (F.col("value") == F.col("gram")) & (F.col("place") >= 0), "left")
    diagonals = (
        hits.filter("template is not null or place < 0")
        .groupBy(*KEY, "template", "label", "phrase", "runs", "own", (F.col("place") - F.col("at")).alias("diagonal"))
        .agg(
            F.collect_set("at").alias("found"),
            F.max(F.when(F.col("place") < 0, F.col("value"))).alias("n_words"),
            F.count_if(F.col("place") < 0).alias("copies"),
        )
    )
    line = W.partitionBy(*KEY, "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > neighbours, F.lit(True)) | F.col("phrase")
    spans = (
        diagonals.withColumn("new", new.cast("int"))
        .withColumn("span", F.sum("new").over(line))
        .groupBy(*KEY, "template", "label", "phrase", "runs", "own", "span")
        .agg(
            F.min("diagonal").alias("diagonal"),
            F.array_distinct(F.flatten(F.collect_list("found"))).alias("all_found"),
            F.max(F.struct(F.size("found").alias("n"), "found")).alias("most"),
            F.max(F.col("diagonal") + F.array_max("found")).alias("end"),
            F.min(F.col("diagonal") + F.array_min("found")).alias("start"),
            F.max("n_words").alias("n_words"),
            F.max("copies").alias("copies"),
        )
    )
    spans = spans.withColumns({"merged": F.size("all_found"), "alone": F.col("most.n")})
    fits = F.col("end") - F.col("start") + gram <= 2 * (F.col("runs") + gram - 1)
    held = F.when(fits, F.col("merged")).otherwise(F.col("alone"))
    at = F.when(fits, F.col("all_found")).otherwise(F.col("most.found"))
    told_apart = 2 * F.size(F.array_intersect(at, F.col("own"))) >= F.size("own")
    stands = F.col("phrase") & (F.col("alone") == F.col("runs"))
    verified = stands | (~F.col("phrase") & told_apart & (held >= least * F.col("runs")))
    texts = spans.groupBy(*KEY).agg(
        F.max("copies").alias("copies"),
        F.max("n_words").alias("n_words"),
        F.count_if(stands).alias("n_base"),
        F.min(F.when(stands, F.col("diagonal"))).alias("first_word"),
        F.max(F.when(stands, F.col("diagonal"))).alias("last_word"),
        _joined(F.when(stands, F.col("label"))).alias("base_labels"),
        _joined(F.when(verified, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(verified, held / F.col("runs"))), F.lit(0.0)).alias("score"),
    )
    each = texts.withColumn("copy", F.explode(F.array_repeat("n_base", F.col("copies").cast("int"))))
    return each.drop("copy", "copies", "text_hash")


def _joined(label: Column) -> Column:
    return F.array_join(F.sort_array(F.collect_set(label)), ",")

"""Document quality rules with thresholds that adapt to language and source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.store import materialise

# The white space of the word rule, and the symbols that are counted.
BLANK_PATTERN = "[ \\t-\\r]"
SYMBOLS = "#*$%&|<>"

MEASURES = ("word_length", "symbols", "dup_lines", "repeat_words")
# Measures that most texts have none of: their limit also leaves room for what 99 in 100 texts have.
SPARSE = ("symbols", "dup_lines", "repeat_words")
# So many rows of the next wider kind count for the limits of a group, beside its own.
PRIOR_ROWS = 100


def word_array(text: Column) -> Column:
    """The runs of characters other than white space."""
    return F.filter(F.split(text, BLANK_PATTERN + "+"), lambda w: w != "")


def repeated_places(windows: Column) -> Column:
    """Places, in order, of the windows (h, i), sorted by h and i, whose h occurs twice or more."""
    after = F.zip_with(windows, F.slice(windows, 2, F.size(windows)), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    before = F.concat(F.array(F.lit(False)), after)
    either = F.zip_with(after, before, lambda a, b: a | b)
    places = F.zip_with(windows, either, lambda w, hit: F.when(hit, w["i"]))
    return F.array_sort(F.array_compact(places))


def add_counts(rows: DataFrame) -> DataFrame:
    """Add the counts of every whole `text`: words, their code points, symbols, lines, repeats.

    The words of 3-word windows found twice or more: the windows' hashes are sorted with their
    places, equal neighbours are repeated windows, and the gaps between their places in order
    tell how many words each covers anew. Linear in the text but for the sort.
    """
    body = F.coalesce("text", F.lit(""))
    rows = rows.withColumn("words", word_array(body)).withColumn(
        "lines", F.filter(F.split(body, "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    )
    rows = rows.withColumn(
        "windows",
        F.transform(
            "words",
            lambda w, i: F.struct(
                F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i")
            ),
        ),
    )
    sorted_windows = F.array_sort(F.slice("windows", 1, F.greatest(F.size("words") - 2, F.lit(0))))
    rows = rows.withColumn("windows", sorted_windows).withColumn("places", repeated_places(F.col("windows")))
    anew = F.zip_with(
        "places", F.slice("places", 2, F.greatest(F.size("places"), F.lit(1))),
        lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))),
    )
    return rows.select(
        *[c for c in rows.columns if c not in ("text", "words", "lines", "windows", "places")],
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.aggregate(anew, F.lit(0), lambda a, x: a + x).cast("bigint").alias("n_repeat_words"),
    )


def measures() -> dict[str, Column]:
    """What is compared with thresholds, in thousandths."""
    def per(part: str, whole: str) -> Column:
        return F.expr(f"1000 * {part} div greatest({whole}, 1)")

    return {
        "word_length": per("word_chars", "n_words"),
        "symbols": per("n_symbols", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeat_words": per("n_repeat_words", "n_words"),
    }


def bucket(value: Column) -> Column:
    """The sketch's bucket of a value: its five leading binary digits, so at most 1/16 below it."""
    drop = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(measured: DataFrame, *keys: str) -> DataFrame:
    """Per group and measure a quantile sketch: how many rows fall in each bucket.

    Sketches merge by adding their counts, in any order and with one result. A group has at
    most some hundred buckets per measure.
    """
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES]))
    rows = measured.select(*keys, values.alias("v"))
    return rows.groupBy(*keys, F.col("v.measure").alias("measure"), F.col("v.bucket").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )


def quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """Rows, and the buckets that 10, 90 and 99 in 100 rows do not exceed, per group and measure."""
    by = F.array_sort(F.collect_list(F.struct("bucket", "n")))
    grouped = sketch.groupBy(*keys, "measure").agg(F.sum("n").alias("rows"), by.alias("buckets"))

    def at(percent: int) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("bucket"))
        return F.aggregate(
            "buckets", start,
            lambda a, x: F.struct(
                (a["n"] + x["n"]).alias("n"),
                F.when(a["bucket"].isNull() & (100 * (a["n"] + x["n"]) >= percent * F.col("rows")), x["bucket"])
                .otherwise(a["bucket"]).alias("bucket"),
            ),
            lambda a: a["bucket"],
        )

    return grouped.select(*keys, "measure", "rows", at(10).alias("low"), at(90).alias("high"), at(99).alias("tail"))


def thresholds(sketch: DataFrame, *keys: str) -> DataFrame:
    """Per group its rows and, for each measure, what it says of the highest and the lowest value that passes.

    The room for sparse measures is the same for all groups and added later.
    """
    found = quantiles(sketch, *keys)
    wide = [F.max("rows").alias("rows")]
    for m in MEASURES:
        mine = F.col("measure") == m
        wide.append(F.max(F.when(mine, 2.0 * F.col("high"))).alias(f"{m}_most"))
        wide.append(F.max(F.when(mine, 0.5 * F.col("low"))).alias(f"{m}_least"))
        wide.append(F.max(F.when(mine, F.col("tail"))).alias(f"{m}_tail"))
    return found.groupBy(*keys).agg(*wide)


def judge(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """`rest` (all columns but text), text if asked for, the counts, base_failed and kept per row.

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word windows.
    Rows that pass are judged against their own kind: each (lang, source) has a mergeable
    quantile sketch of four measures (word length, symbols per word, repeated lines per line,
    words in repeated windows per word). Kept is a row whose measures are at most its limits: for
    word length between half the first and twice the last decile; for the others up to twice the
    last decile and as much again as 99 in 100 of all rows have. A group's limits are the mean of
    its own, weighted by its rows, and those of its language, weighted by `PRIOR_ROWS`; a
    language's are drawn to those of all rows alike. So limits change smoothly with the size of a
    group, and no size is a switch. The wider kinds' sketches are the merged ones of the groups.

    The counted rows are written once: the sketches and the filter both read them. Groups are
    counted with partial counts, so a heavy source is no burden; the limits, one row per group,
    are joined to the rows. Null lang and source are groups of their own. A null or empty text
    has no words and fails. A text of any length is counted whole, its windows in one sorted
    array. Repeated rows are judged alike, an empty table gives no rows, and columns of any name
    stay inside `rest`.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    rows = docs.select(rest.alias("rest"), "lang", "source", "text", *[F.col("text").alias("whole")] * with_text)
    counted = add_counts(rows)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = materialise(counted.withColumn("base_failed", failed), "counted")
    judged = judge_counts(counted).drop("lang", "source")
    return judged.withColumnRenamed("whole", "text")


def limits(measured: DataFrame) -> DataFrame:
    """(lang, source, limits) for every group of the rows that passed the base rules."""
    sketch = materialise(sketches(measured.filter(~F.col("base_failed")), "lang", "source"), "sketch")
    by_lang = sketch.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    by_all = sketch.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))

    def packed(found: DataFrame, *keys: str) -> DataFrame:
        return found.select(
            *[F.col(k).alias(f"of_{k}") for k in keys], F.struct(*[c for c in found.columns if c not in keys]).alias("limits")
        )

    own = packed(thresholds(sketch, "lang", "source"), "lang", "source").withColumnRenamed("limits", "own")
    language = packed(thresholds(by_lang, "lang"), "lang").withColumnRenamed("of_lang", "in_lang")
    overall = packed(thresholds(by_all)).scalar()
    joined = own.join(language, F.equal_null("of_lang", "in_lang"), "left").withColumn("all", overall)

    def drawn(rows: Column, mine: Column, wider: Column) -> Column:
        return (rows * mine + PRIOR_ROWS * wider) / (rows + PRIOR_ROWS)

    blended = []
    for m in MEASURES:
        for end in ("most", "least"):
            name = f"{m}_{end}"
            in_lang = drawn(F.col("limits.rows"), F.col(f"limits.{name}"), F.col(f"all.{name}"))
            room = F.col(f"all.{m}_tail") if end == "most" and m in SPARSE else F.lit(0)
            blended.append((drawn(F.col("own.rows"), F.col(f"own.{name}"), in_lang) + room).alias(name))
    return materialise(joined.select("of_lang", "of_source", F.struct(*blended).alias("limits")), "limits")


def judge_counts(counted: DataFrame) -> DataFrame:
    """Add `kept` to counted rows (see `judge`)."""
    measured = counted.withColumns(measures())
    same = F.equal_null("lang", "of_lang") & F.equal_null("source", "of_source")
    judged = measured.join(limits(measured), same, "left")
    passes = [F.col(m) <= F.col(f"limits.{m}_most") for m in MEASURES]
    passes.append(F.col("word_length") >= F.col("limits.word_length_least"))
    kept = ~F.col("base_failed") & F.coalesce(reduce(Column.__and__, passes), F.lit(True))
    return judged.select(*counted.columns, kept.alias("kept"))

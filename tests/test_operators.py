"""Operators against plain Python on small random frames, with one key holding a third of all rows."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docketry import store
from docketry.functions.patterns import required_pieces
from docketry.operators import frequency, ordinal, rollup
from docketry.operators.dictionary import code_table_keys, describe, merge_texts
from docketry.operators.rules import exact_tag, pattern_hits, rule_tag
from docketry.operators.superseded import MOST_HEAVY, drop_superseded, salted, superseded_keys
from tests.records import HTA


def held():
    return F.col("status") == HTA


def random_rows(seed: int, n: int = 600):
    """(row_order, key, status): a hot key, keys of a few rows, missing statuses."""
    rng = random.Random(seed)
    statuses = [HTA, "Dismissed", "Convicted", None]
    return [
        (i, "hot" if rng.random() < 1 / 3 else f"k{rng.randrange(250)}", rng.choice(statuses))
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def rows():
    return random_rows(1)


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "row_order long, key string, status string")


@pytest.mark.parametrize("keep_one", [False, True])
def test_drop_superseded(frame, rows, keep_one):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    expected = set()
    for group in groups.values():
        for row in group:
            if row[2] != HTA or len(group) == 1:
                expected.add(row[0])
        if keep_one and len(group) > 1 and all(r[2] == HTA for r in group):
            expected.add(min(group)[0])
    got = drop_superseded(frame, "key", held(), keep_one).select("row_order").collect()
    assert sorted(r[0] for r in got) == sorted(expected)
    assert any(len(g) > 1 and all(r[2] == HTA for r in g) for g in groups.values())


def test_drop_superseded_keeps_columns(frame):
    assert drop_superseded(frame, "key", held()).columns == frame.columns


def test_freq_table(frame, rows):
    counts = Counter(r[2] for r in rows)
    table = frequency.freq_table(frame, "status").collect()
    assert {r.status: r.n for r in table} == counts
    assert all(r.pct == r.n / len(rows) * 100 for r in table)
    assert [r.n for r in table] == sorted(counts.values(), reverse=True)
    assert abs(sum(r.pct for r in table) - 100) < 1e-9


def test_freq_table_within_groups_including_missing(frame, rows):
    table = frequency.freq_table(frame, "key", within=["status"]).collect()
    totals = Counter(r[2] for r in rows)
    counts = Counter((r[2], r[1]) for r in rows)
    assert {(r.status, r.key): r.n for r in table} == counts
    assert all(r.pct == r.n / totals[r.status] * 100 for r in table)


def test_ranked_listings_break_ties_by_key(make):
    table = make("k string, n long, p double", ("b", 2, 0.1), ("a", 2, 0.9), (None, 2, 1.0), ("c", 5, 0.2), ("d", 1, 0.3))
    keys = lambda df: [r.k for r in df.collect()]
    assert keys(frequency.top_k(table, 3, "n", ["k"])) == ["c", "a", "b"]
    assert keys(frequency.rank_range(table, 2, 4, "n", ["k"])) == ["a", "b", None]
    assert keys(frequency.top_k_of_top_m(table, 2, "p", 3, "n", ["k"])) == ["a", "c"]


def test_first_per_group(frame, rows):
    firsts = {}
    for order, key, status in rows:
        firsts.setdefault(key, status)
    got = rollup.first_per_group(frame, ["key"], "row_order", "status").collect()
    assert {r.key: r.status for r in got} == firsts and len(got) == len(firsts)


def test_share_within_entity(frame, rows):
    hits, size, members = Counter(), Counter(), Counter()
    for _, key, status in rows:
        size[key] += 1
        hits[key] += status in ("Dismissed", HTA)
        members[key] += status == "Dismissed"
    got = rollup.share_within_entity(
        frame, "key", hit=F.col("status").isin("Dismissed", HTA), member=F.col("status") == "Dismissed"
    ).collect()
    assert {r.key: r.share for r in got} == {k: hits[k] / size[k] for k in size if members[k]}


@pytest.mark.parametrize("n", [6, 49, 98, 103, 107])
def test_full_share_is_exactly_one(spark, n):
    df = spark.range(n).select(F.lit("p").alias("p"))
    assert rollup.share_within_entity(df, "p", hit=F.lit(True)).filter("share = 1").count() == 1


def test_ordered_distinct_text(frame, rows):
    seen = list(dict.fromkeys("NA" if r[2] is None else r[2] for r in rows))
    got = rollup.ordered_distinct_text(frame, "status", "row_order", " -- ").collect()
    assert [r.status for r in got] == [" -- ".join(seen)]


def test_exact_tag_ignores_repeated_entries(make):
    codes = make("code_section string", ("a",), ("b",), (None,))
    tagged = exact_tag(codes, make("charge string", ("a",), ("a",), (None,)), "t").collect()
    assert {r.code_section: r.t for r in tagged} == {"a": True, "b": False, None: False}


RULES = [
    ("PC_1(A)", "Include", "Exact"),
    ("PC_2", "Include", "Partial"),
    ("PC_2(B)", "Exclude", "Exact"),
    ("PC_2.5", "Exclude", "Partial"),
    ("PC_1(A)", "Exclude", "Exact"),
]


def test_rule_tag_excludes_win(make):
    rules = make("charge string, include string, match_type string", *RULES)
    codes = ["PC_1(A)", "PC_2(A)", "PC_2(B)", "PC_2.5", "PC_2x5", "XPC_2", "PC_485", "PC_485&490.2", "pc_2"]
    frame = make("code_section string", *[(c,) for c in codes])
    hits = lambda df: [r.code_section for r in df.filter("low_level").collect()]
    assert sorted(hits(rule_tag(frame, rules))) == ["PC_2(A)", "PC_485", "PC_485&490.2", "XPC_2"]
    literal = rule_tag(frame, rules, mode="literal", more_patterns=(), more_codes=())
    assert sorted(hits(literal)) == ["PC_2(A)", "PC_2x5", "XPC_2"]


def random_pattern(rng, depth=0):
    parts = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.7 or depth > 2:
            part = rng.choice(["a", "b", "ab", "_", "1", ".", r"\d", r"\.", "[ab]", "[^b]", "[]a]", r"\(", "^", "$", "b{1,2}", "é"])
        elif kind < 0.97:
            part = rng.choice(["(", "(?:"]) + "|".join(random_pattern(rng, depth + 1) for _ in range(rng.randint(1, 2))) + ")"
        else:
            part = rng.choice(["(?i:B)", r"\Qa.b\E", r"(a|b)\1", "(?=a)", r"\x61", "", r"\\"])
        if part not in ("^", "$", "") and rng.random() < 0.3:
            part += rng.choice(["?", "*", "+", "*?", "+?", "{0,2}", "{2}", "?+"])
        parts.append(part)
    return "".join(parts)


def is_valid(spark, pattern):
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:
        return False
    return True


@pytest.mark.parametrize("mode", ["regex", "literal"])
def test_pattern_hits_are_those_of_a_full_search(spark, mode):
    rng = random.Random(8)
    patterns = ["", "a|", "|", *{"|".join(random_pattern(rng) for _ in range(rng.randint(1, 2))) for _ in range(500)}]
    patterns = [p for p in patterns if is_valid(spark, p)]
    if mode == "literal":
        patterns = ["", "a", "ab", "a.b", "(", "_1", "ab1_ab1_", "ab1_ab1_b", "é"]
    codes = ["", *{"".join(rng.choice("abB_1.(é") for _ in range(rng.randint(1, 14))) for _ in range(60)}, "ab1_ab1_b"]
    rules = spark.createDataFrame([(p, rng.choice(["Include", "Exclude"])) for p in patterns] + [(None, "Include")], "charge string, include string")
    frame = spark.createDataFrame([(c,) for c in [*codes, codes[3], None]], "code_section string")
    got = {r._code: (r._partly_in, r._partly_out) for r in pattern_hits(frame, rules, mode=mode).collect()}
    found = "rlike(code_section, charge)" if mode == "regex" else "contains(code_section, charge)"
    pairs = frame.crossJoin(rules).filter(found).select("code_section", "include").distinct().collect()
    hits = {(r.code_section, r.include) for r in pairs}
    assert got == {c: ((c, "Include") in hits, (c, "Exclude") in hits) for c in codes if {(c, "Include"), (c, "Exclude")} & hits}
    if mode == "regex":
        pieces = rules.select(required_pieces(F.col("charge")).alias("p")).filter("p[0] = ''").count()
        assert pieces < 0.7 * len(patterns) and len(got) > 40


def test_index_gives_few_candidates(spark):
    """5,000 patterns on 1,000 codes: the search sees little more than the hits, and the plan holds no pattern."""
    rules = spark.range(5000).select(F.format_string("^AB_%d[(]A", "id").alias("charge"), F.lit("Include").alias("include"))
    codes = spark.range(1000).select(F.format_string("AB_%d(A)", F.col("id") + 4500).alias("code_section"))
    hits = pattern_hits(codes, rules)
    assert hits.count() == 500
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "collect_list" not in plan


def test_no_rules_tag_nothing(make):
    rules = make("charge string, include string, match_type string", ("x", "Include", "Exact")).filter("false")
    tagged = rule_tag(make("code_section string", ("PC_1",)), rules, more_patterns=(), more_codes=())
    assert tagged.collect()[0].low_level is False


def test_dictionary_merges_in_table_order_and_falls_back(make):
    table = make(
        "row_order long, penal_code string, offense_number string, m_f string, offense_description string",
        (2, "PC", "1 (A)", "M", "SECOND"),
        (1, "PC", " 1(A)", "M", "First"),
        (3, "PC", "2", None, None),
    )
    texts = merge_texts(code_table_keys(table))
    assert {r.key: r.offense_description for r in texts.collect()} == {
        "PC_1(A)_M": "first and/or second -- PC_1(A)_M",
        "PC_2_NA": "NA -- PC_2_NA",
    }
    charges = make("key string", ("PC_1(A)_M",), ("PC_1(A)_M",), ("PC_9_M",), ("HS_11377_F",))
    described = describe(charges, texts).collect()
    assert len(described) == 4
    by_key = {r.key: r.offense_description for r in described}
    assert by_key["PC_9_M"] == "PC_9_M"
    assert by_key["HS_11377_F"] == "fel. possess controlled subst. HS_11377_F"


def test_one_key_with_a_third_of_all_texts(spark):
    """Its texts are joined range by range, then in the order of the table."""
    table = spark.range(3000).select(
        (F.col("id") * 7919 % 3000).alias("row_order"),
        F.when(F.col("id") * 7919 % 3000 % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") * 7919 % 3000 % 100)).alias("key"),
        F.format_string("t%d", F.col("id") * 7919 % 3000).alias("offense_description"),
    )
    expected = defaultdict(list)
    for i in range(3000):
        expected["hot" if i % 3 == 0 else f"k{i % 100}"].append(f"t{i}")
    merged = merge_texts(table.repartition(5))
    assert {r.key: r.offense_description for r in merged.collect()} == {k: " and/or ".join(v) + f" -- {k}" for k, v in expected.items()}
    assert "rangepartitioning(key" in merged._jdf.queryExecution().executedPlan().toString()


def test_shared_folder_is_the_sessions(spark):
    assert store.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


class SessionWithoutFolder:
    """Just what the store asks of a session, with no checkpoint folder set."""

    def __init__(self, master):
        self.conf = {"spark.sql.warehouse.dir": "file:/own/warehouse"}
        self.sparkContext, self.master = self, master

    def getCheckpointDir(self):
        return None


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_without_shared_folder_is_an_error(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_folder(SessionWithoutFolder(master))


def test_a_local_session_may_do_without():
    assert store.shared_folder(SessionWithoutFolder("local[4]")) == "file:/own/warehouse/_checkpoints"


@pytest.fixture
def folder(monkeypatch, tmp_path):
    monkeypatch.setattr(store, "shared_folder", lambda spark: str(tmp_path))
    return tmp_path


def tables_in(folder):
    return sorted(p.name.rsplit("_", 1)[0] for p in folder.glob("docketry/*/*"))


def test_clean_up_deletes_the_applications_own_tables(spark, frame, folder):
    (folder / "docketry" / "other").mkdir(parents=True)
    kept = store.materialise(frame, "rows", ["status"])
    assert sorted(kept.collect()) == sorted(frame.collect()) and kept.columns == frame.columns
    store.clean_up(spark)
    assert [p.name for p in (folder / "docketry").iterdir()] == ["other"]
    store.materialise(frame, "again")
    assert tables_in(folder) == ["again"]
    store.clean_up(spark)


def test_tables_go_with_their_block(spark, frame, folder):
    store.materialise(frame, "outer")
    with store.owned(spark):
        store.materialise(frame, "inner")
        result = store.finished(spark, "result", lambda: store.materialise(frame, "step").filter("key = 'hot'"))
        assert tables_in(folder) == ["inner", "outer", "result"]
        assert result.count() == frame.filter("key = 'hot'").count()
    assert tables_in(folder) == ["outer"]
    with pytest.raises(ZeroDivisionError), store.owned(spark):
        store.materialise(frame, "lost")
        1 / 0
    assert tables_in(folder) == ["outer"]
    store.clean_up(spark)


def test_tables_are_freed_one_by_one(spark, frame, folder):
    first, second = store.materialise(frame, "first"), store.materialise(frame, "second")
    store.free(first, frame)
    store.free(first)
    assert tables_in(folder) == ["second"] and second.count() == frame.count()
    store.clean_up(spark)


def test_python_gets_small_batches_while_a_table_is_written(spark, folder):
    def sizes(batches):
        for batch in batches:
            yield type(batch).from_pydict({"n": [len(batch)]})

    before = spark.conf.get(store.ARROW_SETTING)
    rows = spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long")
    assert max(r.n for r in store.materialise(rows, "sizes").collect()) <= store.ARROW_ROWS < 5000
    assert spark.conf.get(store.ARROW_SETTING) == before
    store.clean_up(spark)


def test_a_result_without_tables_stays_a_plan(spark, frame, folder):
    assert store.finished(spark, "result", lambda: frame) is frame
    assert not list(folder.iterdir())
    assert store.finished(spark, "result", lambda: frame, always=True).count() == frame.count()
    assert tables_in(folder) == ["result"]
    store.clean_up(spark)


def test_offsets_in_two_levels(spark, folder):
    """Many origins, some of them heavy; lines of an origin are consecutive numbers from anywhere."""
    rng = random.Random(9)
    sizes = {(f"f{rng.randrange(9)}", i): rng.randint(1, 9) if i != 7 else 300 for i in range(150)}
    starts = {o: rng.randrange(1 << 40) for o in sizes}
    rows = [(f, b, starts[f, b] + n) for (f, b), size in sizes.items() for n in range(size)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "file string, block int, line long")
    offsets = store.finished(spark, "offsets", lambda: ordinal.origin_offsets(frame, ["file", "block"], "line"))
    assert tables_in(folder) == ["offsets"] and offsets.count() == len(sizes)
    numbered = ordinal.with_row_numbers(frame.withColumn("at", F.struct(*frame.columns)), offsets, ["file", "block"], "line")
    got = {tuple(r["at"]): r.row_number for r in numbered.collect()}
    assert got == {row: n for n, row in enumerate(sorted(rows), 1)}
    assert ordinal.origin_offsets(frame.filter("false"), ["file", "block"], "line").count() == 0
    store.clean_up(spark)


def test_no_window_over_all_origins(spark, folder):
    frame = spark.range(50).select(F.lit(0).alias("file"), F.col("id").alias("line"))
    plan = ordinal.origin_offsets(frame, ["file"], "line")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("windowspecdefinition(") == plan.count("windowspecdefinition(_part") == 1
    store.clean_up(spark)


def test_heavy_keys_are_dealt_out(spark, folder):
    """No (key, salt) holds more than about the bound, and the join finds what the plain one finds."""
    rows = spark.range(6000).select(
        F.col("id").alias("row_order"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 1500)).alias("key")
    )
    keys = store.materialise(superseded_keys(rows, "key", F.col("row_order") >= 0), "keys")
    dealt, repeated = salted(rows, keys, "key", "row_order", rows_per_salt=100)
    assert dealt.count() == 6000 and repeated.filter("key = 'hot'").count() == 20
    assert dealt.groupBy("key", "_salt").count().agg(F.max("count")).first()[0] < 160
    assert dealt.join(repeated.select("key", "_salt"), ["key", "_salt"], "left_semi").count() == rows.join(keys, "key", "left_semi").count()
    few = salted(rows, keys, "key", "row_order", rows_per_salt=0)[1]
    assert few.filter("_salt > 0").select("key").distinct().count() < MOST_HEAVY
    store.clean_up(spark)


def test_segments_make_one_text(spark):
    frame = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("n"), F.format_string("v%d", F.col("id") * 7919 % 5000).alias("v"))
    frame = frame.unionByName(frame.select((F.col("n") + 9000).alias("n"), "v"))
    text = rollup.ordered_distinct_text(frame.repartition(6), "v", "n", ",")
    assert text.first().v == ",".join(f"v{i}" for i in range(5000))
    plan = text._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(_first" in plan and "hashpartitioning(_part" in plan
    empty = rollup.ordered_distinct_text(frame.filter("false"), "v", "n", ",").collect()
    assert [r.v for r in empty] == [""]

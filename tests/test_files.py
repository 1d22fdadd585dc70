"""From files in the shape of the original inputs to the finished fact table and report."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docketry import ChargeTables, CodeLists, build_charges, report
from docketry.constants import PART_NAMES
from docketry.operators.ordinal import ORIGIN, origin_offsets, with_row_numbers
from docketry.operators.rules import rule_tag
from docketry.plans.build import build_from_parts, reconcile, stack_parts
from docketry.plans.report import ANALYSES
from docketry.schemas import CHARGE_FACT_COLUMNS
from docketry.sources import files
from docketry.store import materialise
from tests import records

ORDER = ("part3", "part4", "part5", "part6", "part1")


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    return records.write(tmp_path_factory.mktemp("records"))


@pytest.fixture(scope="module")
def lists(spark, paths):
    return CodeLists(
        wobblers=files.read_code_list(spark, paths["wobblers"]),
        rules=files.read_rules(spark, paths["rules"]),
        svf=files.read_listed_codes(spark, paths["serious"]),
        code_table=files.read_code_table(spark, paths["code_table"]),
    )


@pytest.fixture(scope="module")
def parts(spark, paths):
    return files.read_parts(spark, {tag: paths[tag] for tag in ORDER})


@pytest.fixture(scope="module")
def tables(parts, lists):
    return build_from_parts(parts, lists)


@pytest.fixture(scope="module")
def fact(tables):
    return {r.unique_id: r for r in tables.fact().collect()}


def test_headers_become_snake_case(make):
    assert files.snake_case("Age At Time Of Crime") == "age_at_time_of_crime"
    assert files.snake_case(" Match Type ") == "match_type"
    assert files.snake_case("BCS-Code #2") == "bcs_code_number_2"
    assert files.snake_case("caseLevel") == files.snake_case("CASE Level") == "case_level"
    assert files.snake_case("2nd % of \"all\"") == "x2nd_percent_of_all"
    assert files.snake_case("") == "x"
    assert files.clean_names(make("`A b` int, `a B` int", (1, 2))).columns == ["a_b", "a_b_2"]


def test_lists_lose_blanks_and_line_ends(spark, paths):
    assert [r.charge for r in files.read_code_list(spark, paths["wobblers"]).collect()] == [
        "BP_11320",
        "PC_594(A)",
    ]
    rules = files.read_rules(spark, paths["rules"])
    assert rules.columns == ["charge", "include", "type", "description", "match_type"]
    charges = [r.charge for r in rules.collect()]
    assert "PC_594" in charges and "PC_647" in charges and "NA_#7028(A)(1)/04" in charges
    assert not [c for c in charges if c.endswith(("_", "\r"))]
    assert {r.match_type for r in rules.collect()} == {"Exact", "Partial"}
    quoted = rules.filter("charge = 'PC_647'").collect()[0]
    assert quoted.description == 'Invented "in quotes", with a comma'


def test_code_table_by_position(spark, paths):
    rows = files.read_code_table(spark, paths["code_table"]).orderBy("row_order").collect()
    assert [r.bcs_code for r in rows] == list("12345")
    assert rows[1].offense_number == "422" and rows[2].offense_number == "4 22"
    assert rows[4].offense_description is None


def test_part_types_are_declared_not_guessed(parts):
    types = dict(parts["part5"].dtypes)
    assert types["masked_case_no"] == types["defendant_no"] == "string"
    assert types["age_at_time_of_crime"] == "int" and types["result_date"] == "timestamp"
    assert "case_level" not in parts["part1"].columns


def test_parts_read_from_parquet_alike(spark, paths, parts, tmp_path):
    stored = str(tmp_path / "part5.parquet")
    spark.read.csv(paths["part5"], header=True).write.option(
        "parquet.enable.dictionary", "true"
    ).parquet(stored)
    again = files.read_part(spark, stored, "part5", fmt="parquet")
    columns = [c for c in again.columns if not c.startswith("_")]
    key = lambda r: [str(v) for v in r]
    assert sorted(again.select(*columns).collect(), key=key) == sorted(
        parts["part5"].select(*columns).collect(), key=key
    )


@pytest.fixture
def mixed(tmp_path):
    """A part in files whose headers differ in order, spelling and undeclared columns; one has bad cells."""
    part = tmp_path / "part5"
    part.mkdir()
    (part / "a.csv").write_text("Masked Case No,Count No,Section,Result Date\n1,1,A,2018-01-02\n2,2,B,\n")
    (part / "b.csv").write_text("Section,Masked Case No,Extra,Result Date,Count No\r\nC,3,x,not a date,3\r\nD,4,y,2018-01-04,four\r\n")
    (part / "c.csv").write_text("masked_case_no,count_no,section,result_date\n5,5,E,2018-01-05\n")
    (part / "empty.csv").write_text("")
    (part / "header_only.csv").write_text("Masked Case No,Count No,Section,Result Date\n")
    return str(part)


def test_files_with_other_headers_are_read_by_name(spark, mixed):
    assert sorted(len(f) for f in files.headers(spark, mixed).values()) == [1, 1, 2]
    part = files.read_part(spark, mixed, "part5", bad_cells="missing")
    got = [(r.masked_case_no, r.count_no, r.section, r.result_date and r.result_date.day) for r in part.orderBy("masked_case_no").collect()]
    assert got == [("1", 1, "A", 2), ("2", 2, "B", None), ("3", 3, "C", None), ("4", None, "D", 4), ("5", 5, "E", 5)]
    assert part.select("_file", "_block").distinct().count() == 3
    with pytest.raises(Exception, match="not a date|four"):
        files.read_part(spark, mixed, "part5").collect()
    with pytest.raises(ValueError):
        files.read_part(spark, mixed, "part5", bad_cells="drop")


def test_bad_cells_are_listed_and_counted(spark, mixed, paths):
    rows = files.quarantine(spark, {"part5": mixed, "part6": paths["part6"]}).collect()
    assert sorted((r.part, r.file.rsplit("/", 1)[1], r["column"], r.raw) for r in rows) == [
        ("part5", "b.csv", "count_no", "four"), ("part5", "b.csv", "result_date", "not a date")
    ]
    assert len({(r.block, r.line) for r in rows}) == 2
    counts = files.bad_cell_counts(spark, {"part5": mixed, "part6": paths["part6"]}).collect()
    found = {(r.part, r["column"]): r.bad_cells for r in counts}
    assert len(found) == 6 and {k: v for k, v in found.items() if v} == {("part5", "count_no"): 1, ("part5", "result_date"): 1}
    with pytest.raises(ValueError):
        files.quarantine(spark, {})


def test_a_column_that_some_files_lack_is_an_error(spark, mixed, tmp_path):
    (tmp_path / "part5" / "d.csv").write_text("masked_case_no,count_no,section\n6,6,F\n")
    with pytest.raises(ValueError, match="result_date"):
        files.read_part(spark, mixed, "part5")


def test_every_row_is_accounted_for(spark, parts, tables):
    rows = {r.data_part: r for r in reconcile(parts, tables).collect()}
    assert len(rows) == 5 and all(r.complete for r in rows.values())
    assert {n: r.rows_in for n, r in rows.items()} == {
        n: parts[tag].count() for tag, n in PART_NAMES.items()
    }
    assert rows["juvenile_misdemeanors"].first_number == 1 and rows["juvenile_motion_to_transfer"].last_number == 15
    assert sum(r.rows_kept for r in rows.values()) == tables.charges.count() < 15
    fewer = {**parts, "part5": parts["part5"].limit(2)}
    assert [r.data_part for r in reconcile(fewer, tables).collect() if not r.complete] == ["adult_misdemeanors"]
    with pytest.raises(ValueError):
        reconcile({}, tables)


def test_stack_needs_equal_columns(parts):
    with pytest.raises(Exception, match="section"):
        stack_parts({"part5": parts["part5"], "part6": parts["part6"].drop("section")}).count()
    with pytest.raises(ValueError):
        stack_parts({})


def test_row_numbers_follow_parts_and_lines(tables, parts):
    rows = tables.with_row_numbers(tables.all_charges).orderBy("row_order").collect()
    assert [r.row_number for r in rows] == list(range(1, 16))
    assert [r.unique_id for r in rows] == [f"{i:06d}" for i in range(1, 16)]
    assert [r.masked_case_no for r in rows] == list("413" + "11122" + "778999" + "5")
    assert len(rows) == sum(p.count() for p in parts.values())


def test_row_numbers_follow_lines_when_files_are_split(spark, tmp_path):
    rows = 3000
    path = tmp_path / "long.csv"
    path.write_text("masked_case_no\n" + "\n".join(str(i) for i in range(1, rows + 1)))
    settings = {"spark.sql.files.maxPartitionBytes": "1500", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        part = files.read_part(spark, str(path), "part5").withColumn("_part_no", F.lit(0))
        assert part.select("_block").distinct().count() > 3
        written = materialise(part, "rows")
        offsets = origin_offsets(written, ORIGIN[:-1], ORIGIN[-1])
        numbered = with_row_numbers(written, offsets, ORIGIN[:-1], ORIGIN[-1])
        wrong = numbered.filter("masked_case_no != cast(row_number as string)")
        assert numbered.count() == rows and wrong.count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_row_id_text_grows_past_six_digits(make):
    text = make("row_order long", (1234567,)).select(F.format_string("%06d", "row_order")).collect()
    assert text[0][0] == "1234567"


def test_fact_table_has_all_columns(tables):
    fact = tables.fact()
    assert tuple(fact.columns) == CHARGE_FACT_COLUMNS and len(fact.columns) == 31
    for column in ("charge_id", "person_id", "case_id", "wobbler", "low_level", "svf", "key",
                   "offense_description", "code_section", "code_section_m_f", "age_group"):
        assert fact.filter(F.col(column).isNull()).count() == 0


def test_motion_part_is_filled(fact):
    row = fact["000015"]
    assert (row.case_level, row.charge_level, row.case_type, row.charge_city) == ("F", "F", None, None)
    assert row.data_part == "juvenile_motion_to_transfer"
    assert row.case_category_description == "Transfer"
    assert fact["000001"].case_category_description is None


def test_keys_and_texts(fact):
    row = fact["000004"]
    assert row.charge_id == "5_1_1_PC_594(A)" and row.person_id == "5_1_1" and row.case_id == "5_1"
    assert row.code_section_m_f == "M_PC_594(A)" and row.key == "PC_594(A)_M"
    assert row.minor_zip_code == "90012" and row.plea_description == "Not guilty"
    assert row.data_part == "adult_misdemeanors"
    assert fact["000007"].plea_description == "XX"
    assert fact["000008"].code_section == "NA_#7028(A)(1)/04"
    assert fact["000008"].plea_description is None and fact["000008"].minor_zip_code is None


LOW_LEVEL = {
    "EC_48454": True,
    "PC_484.1&490.2": False,
    "PC_25850(A)": False,
    "PC_594(A)": True,
    "HS_11364": True,
    "VC_14601.1(A)": True,
    "PC_602(M)": True,
    "NA_#7028(A)(1)/04": True,
    "PC_422": True,
    "PC_245(A)(4)": False,
    "BP_11320": False,
    "PC_647.6(A)": False,
}


def test_tags(fact):
    assert {r.code_section: r.low_level for r in fact.values()} == LOW_LEVEL
    assert {r.code_section for r in fact.values() if r.wobbler} == {"BP_11320", "PC_594(A)"}
    assert {r.code_section for r in fact.values() if r.svf} == {"PC_422"}


def test_literal_mode_reads_brackets_as_brackets(parts, lists):
    literal = CodeLists(lists.wobblers, lists.rules, lists.svf, lists.code_table, "literal")
    rows = build_from_parts(parts, literal).charges.select("code_section", "low_level").collect()
    assert dict(map(tuple, rows)) == {**LOW_LEVEL, "PC_602(M)": False}


@pytest.mark.parametrize(
    "code, regex, literal",
    [
        ("PC_602(M)", True, False),  # brackets group in a regular expression, so the exclude misses it
        ("PC_602M", False, True),  # and hits this one instead
        ("PC_647(J)", True, False),
        ("PC_647.6(A)", False, False),
        ("PC_484.1&490.2", False, False),  # included and excluded
        ("PC_530.5(B)", True, True),  # the exclude is written in lower case
        ("VC_24852", True, True),  # 485 anywhere in the code
        ("PC_422.6(A)", True, True),
        ("VC_4902", False, False),
        ("XX_49092", True, True),  # the dot of the added pattern 490.2 is any character
    ],
)
def test_rule_details(make, lists, code, regex, literal):
    codes = make("code_section string", (code,))
    assert rule_tag(codes, lists.rules).collect()[0].low_level is regex
    assert rule_tag(codes, lists.rules, mode="literal").collect()[0].low_level is literal


def test_offence_texts(fact, tables):
    texts = {r.key: r.offense_description for r in fact.values()}
    assert texts["HS_11364_M"] == "paraphernalia -- HS_11364_M"
    assert texts["PC_422_F"] == "criminal threats and/or threats with intent -- PC_422_F"
    assert texts["PC_602(M)_I"] == "trespass: occupy property -- PC_602(M)_I"
    assert texts["PC_594(A)_M"] == "misd. vandalism property -- PC_594(A)_M"
    assert texts["BP_11320_F"] == "BP_11320_F"
    assert tables.fact().count() == tables.charges.count()


def test_superseded_rows(fact, tables, parts, lists):
    assert {f"{i:06d}" for i in range(1, 16)} - set(fact) == {"000009", "000012", "000013"}
    with_first = build_from_parts(parts, lists, keep_one_if_all_superseded=True)
    kept = with_first.with_row_numbers(with_first.charges)
    assert {r.unique_id for r in kept.collect()} == set(fact) | {"000012"}


def test_charges_are_not_moved_for_their_layout(parts, lists, monkeypatch):
    written = {}
    seen = lambda df, name, *layout: (written.update({name: df}), materialise(df, name, *layout))[1]
    monkeypatch.setattr("docketry.plans.build.materialise", seen)
    build_from_parts(parts, lists)
    assert "Rebalance" not in written["charges"]._jdf.queryExecution().optimizedPlan().toString()


def test_persons_are_rolled_up_from_the_charges(parts, lists):
    again = build_from_parts(parts, lists)
    found = {r.person_id: r for r in again.persons.collect()}
    assert "defendants" not in vars(again)
    sums = again.defendants.groupBy("person_id").agg(F.sum("num_charges").alias("n"), F.sum("diverted").alias("diverted"))
    assert {k: (r.num_charges, r.diverted) for k, r in found.items()} == {r.person_id: (r.n, r.diverted) for r in sums.collect()}


def test_rows_are_numbered_before_ids_and_texts_are_added(tables, monkeypatch):
    columns, number = [], ChargeTables.with_row_numbers
    monkeypatch.setattr(ChargeTables, "with_row_numbers", lambda t, df: columns.extend(df.columns) or number(t, df))
    assert tables.fact().columns == [*CHARGE_FACT_COLUMNS]
    assert "result_description" in columns and not {"offense_description", "charge_id", "key"} & {*columns}


def test_codes_may_come_from_elsewhere(parts, lists, fact, make):
    stacked = stack_parts(parts)
    codes = stacked.select("code", "section", "charge_level").unionByName(
        make("code string, section string, charge_level string", ("XX", "1", "M"))
    )
    again = build_from_parts(parts, lists, codes=codes).fact().collect()
    assert {r.unique_id: (r.low_level, r.svf, r.wobbler) for r in again} == {
        k: (r.low_level, r.svf, r.wobbler) for k, r in fact.items()
    }


def test_a_source_of_codes_that_lacks_one_ends_the_build(parts, lists, make):
    codes = make("code string, section string, charge_level string", ("XX", "1", "M"))
    with pytest.raises(Exception, match="the source of codes lacks"):
        build_from_parts(parts, lists, codes=codes)


def test_part_tags_must_differ_in_their_digit(parts):
    with pytest.raises(ValueError, match="digit"):
        stack_parts({"part1": parts["part1"], "part10": parts["part5"]})


def test_report_on_records(tables):
    results = {name: df.collect() for name, df in report(tables).items()}
    one = {name: rows[0] for name, rows in results.items() if len(rows) == 1}
    assert one["charge_count"].n == 12
    assert one["share_by_level"].share == 4 / 12
    assert one["share_low_level"].share == 7 / 12
    assert one["missing_rates"].charge_city_missing == 11 / 12
    # 5_2_1 has a charge without result, so its dismissed share is missing
    assert tuple(one["all_dismissed_persons"]) == (3, 3 / 10)
    assert tuple(one["half_dismissed_persons"]) == (4, 4 / 10)
    assert tuple(one["any_diverted_persons"]) == (2 / 10, 2, 10)
    assert one["any_diverted_persons_pre_dedup"].share == 2 / 11
    assert tuple(one["one_diverted_persons"]) == (2, 2 / 11, 2, 2 / 11)
    assert one["external_ratio"].share == 971 / 10
    assert one["misd_cases"].n == 4
    assert one["misd_defendants"].n == 5
    assert one["text_match_count"].n == 1
    assert tuple(one["declinable_total"]) == (2, 2 / 12)
    assert one["only_declinable_persons"].n == 1
    assert [tuple(r) for r in results["target_share_distribution"]] == [(0.5, 50.0), (1.0, 50.0)]
    assert one["low_level_code_string"].code_section_m_f == " -- ".join(
        ["M_EC_48454", "M_PC_594(A)", "M_HS_11364", "M_VC_14601.1(A)", "I_PC_602(M)",
         "I_NA_#7028(A)(1)/04", "F_PC_422"]
    )
    assert [r.type for r in results["figure1_types"]][0] == "felonies"
    svf = next(r for r in results["figure1_types"] if r.type == "serious_or_violent")
    assert (svf.n, svf.total, svf.pct) == (1, 8, 1 / 8)
    # the case figure's third row is the number of cases
    assert {r.type: r.pct for r in results["case_severity"]} == {
        "felonies": 5 / 9, "misdemeanors": 4 / 9, "n": 9.0
    }
    folded = {r.result_simple: r.n for r in results["folded_results"]}
    assert folded["Other"] == 2 and sum(folded.values()) == 12


def test_report_takes_parameters(tables):
    own = report(tables, top3_misd={"k": 1}, text_match_count=["no such text"], low_level_code_string={"sep": "; "})
    assert own["top3_misd"].count() == 1 and report(tables)["top3_misd"].count() > 1
    assert own["text_match_count"].first().n == 0 and "; " in own["low_level_code_string"].first()[0]
    with pytest.raises(ValueError, match="no_such"):
        report(tables, no_such={})


@pytest.fixture(scope="module")
def empty(tables):
    return ChargeTables(tables.stored.filter("false"), tables.code_table)


@pytest.mark.parametrize("name", sorted(ANALYSES))
def test_analyses_of_no_charges(empty, name):
    """Nothing to count is no error: counts are zero, shares missing, tables empty."""
    for row in ANALYSES[name](empty).collect():
        for column, value in row.asDict().items():
            assert value in (0, None, "") or isinstance(value, str) or column == "sort_order"

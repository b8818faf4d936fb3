"""Rules that are easily got wrong, one test each."""

import re

import pytest

from assetlens import FilterSpec, Register, apply_filters
from assetlens.errors import SearchPatternError
from assetlens.functions.dates import lenient_date, moment
from assetlens.operators import filters, formats, metrics, quality
from assetlens.operators.derive import age_known, derived, with_age
from assetlens.operators.headers import canonical_rows, register_table
from templates import table


def register(spark, headers, rows):
    return Register.of(table(spark, headers, rows))


@pytest.mark.parametrize(
    ("year", "age", "known"),
    [
        ("2020", 5, True), (" 2020 ", 5, True), ("2020.5", 4, True), ("2025.5", 0, True),
        ("2030", -5, True), ("2e3", 25, True), ("+2020", 5, True), (".5", 2024, True),
        ("2020.", 5, True), ("-5", 2030, True),
        ("2020d", 0, False), ("inf", 0, False), ("NaN", 0, False), ("n/a", 0, False),
        ("", 0, False), (None, 0, False), ("1e400", 0, True), ("1e300", 0, True),
        ("2 020", 0, False),
    ],
)
def test_years(spark, year, age, known):
    r = with_age(register(spark, ["Model", "Year Of Purchase"], [("m", year)]), "2025-06-15 10:30:00")
    row = r.df.select("asset_age", age_known(r.col("purchase_year")).alias("known")).first()
    assert row["asset_age"] == age
    assert bool(row["known"]) == known


def test_unknown_years_count_as_new(spark):
    r = with_age(register(spark, ["Model", "Year Of Purchase"], [("m", "x"), ("m", None)]), "2025-01-01")
    assert metrics.age_counts(r).first()["n"] == 2
    summary = metrics.age_summary(r).first()
    assert tuple(summary) == (0, None, False)


def test_without_a_year_column(spark):
    r = with_age(register(spark, ["Model"], [("m",)]))
    assert r.df.first()["asset_age"] == 0


def test_without_a_warranty_column(spark):
    r = derived(register(spark, ["Model", "Place"], [("m", "p")]), "2025-01-01")
    assert r.df.columns == ["model", "place", "asset_age"]
    assert metrics.warranty_counts(r) is None


def test_typed_derived_columns_are_replaced(spark):
    r = register(
        spark,
        ["Model", "Asset Age", "Warranty Expiry Date"],
        [("m", "old", "2030-01-01")],
    )
    row = derived(r, "2025-06-15 10:30:00").df.first()
    assert row["asset_age"] == 0
    assert row["warranty_expiry_date"].year == 2030
    assert row["warranty_status"] == "Active"


def test_a_kind_without_warranty_ignores_it(spark):
    r = derived(register(spark, ["Product", "Product Type", "Warranty Expiry"], [("m", "t", "2020-01-01")]))
    assert r.kind == "Mobile"
    assert "warranty_status" not in r.df.columns


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo", "Asia/Kathmandu"])
def test_dates_do_not_depend_on_the_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # 2018-11-04 00:00 does not exist in Sao Paulo.
        df = table(spark, ["d"], [("2018-11-04",), ("04/11/2018",), ("04.11.2018 07:08",)])
        parsed = df.select(
            lenient_date(df["d"], ["dd/MM/yyyy", "dd.MM.yyyy HH:mm"]).cast("string")
        ).collect()
        assert sorted(r[0] for r in parsed) == [
            "2018-11-04 00:00:00", "2018-11-04 00:00:00", "2018-11-04 07:08:00",
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_moments(spark):
    from datetime import datetime

    row = spark.range(1).select(
        moment("2025-06-15 10:30:00").alias("a"),
        moment(datetime(2025, 6, 15, 10, 30)).alias("b"),
        moment().alias("now"),
    )
    assert dict(row.dtypes) == dict.fromkeys(["a", "b", "now"], "timestamp_ntz")
    first = row.first()
    assert first["a"] == first["b"] == datetime(2025, 6, 15, 10, 30)


USERS = [("a", "u"), ("b", None), ("c", ""), ("d", " ")]


def test_missing_values_per_operator(spark):
    r = register(spark, ["Model", "User"], USERS + [(None, "v")])
    assert quality.missing_user_rows(r).count() == 2  # a blank is a user
    assert {x["model"] for x in metrics.model_counts(r).collect()} == set("abcd")
    domain = filters.filter_domains(r).where("role = 'model'").collect()
    assert {x["value"] for x in domain} == {"a", "b", "c", "d", None}
    assert filters.selected(r, {"model": ["a", None]}).df.count() == 2
    assert filters.selected(r, {"model": [None]}).df.count() == 1
    assert filters.selected(r, {"model": []}).df.count() == 5


def test_empty_tags_are_values_and_missing_ones_are_not(spark):
    rows = [("m", ""), ("m", ""), ("m", None), ("m", None), ("m", "x")]
    r = register(spark, ["Model", "Asset Tag"], rows)
    assert [tuple(x) for x in quality.duplicate_values(r, "asset_tag").collect()] == [("", 2)]
    assert quality.duplicate_rows(r, "asset_tag").count() == 2


def test_report_skips_checks_without_a_column(spark):
    r = register(spark, ["Model", "Asset Tag"], [("m", "x"), ("m", "x")])
    report = quality.quality_report(r).collect()
    assert [tuple(x) for x in report] == [
        ("Duplicate Asset Tags", "high", 1, "Found 1 duplicate asset tags")
    ]
    assert quality.missing_user_rows(r) is None
    assert quality.quality_report(register(spark, ["Model"], [("m",)])).count() == 0


def test_report_order(spark):
    rows = [("m", "t", "s", None, "bad"), ("m", "t", "s", "u", "a@b.com")]
    r = register(spark, ["Model", "Asset Tag", "Serial Number", "User", "Email"], rows)
    assert [(x["issue"], x["n"]) for x in quality.quality_report(r).collect()] == [
        ("Duplicate Asset Tags", 1),
        ("Duplicate Serial Numbers", 1),
        ("Missing User Assignment", 1),
        ("Invalid Email Format", 1),
    ]


def test_of_two_roles_on_one_column_the_later_counts(spark):
    r = register(spark, ["Model", "Workstation", "Site Place"], [("a", "w", "x"), ("b", "w", "y")])
    assert r.roles["site"] == r.roles["place"]
    both = filters.selected(r, {"site": ["x"], "place": ["y"]}).df.collect()
    assert [x["model"] for x in both] == ["b"]
    # The later one counts even when nothing is chosen there.
    assert filters.selected(r, {"site": ["x"]}).df.count() == 2


@pytest.mark.parametrize("role", ["programme", "location"])
def test_only_offered_roles_can_be_selected_on(spark, role):
    with pytest.raises(ValueError, match=role):
        filters.selected(register(spark, ["Model"], [("a",)]), {role: ["x"]})


def test_search(spark):
    rows = [("Straße ÄÖ", "x.y"), ("b", "xzy"), ("c", None)]
    r = derived(register(spark, ["Model", "Place"], rows), "2025-01-01")

    def hits(text, regex=True):
        return {x["model"] for x in filters.searched(r, text, regex).df.collect()}

    assert hits("X.Y") == {"Straße ÄÖ", "b"}
    assert hits("X.Y", regex=False) == {"Straße ÄÖ"}
    assert hits("äö") == {"Straße ÄÖ"}
    assert hits("^b$|^C$") == {"b", "c"}
    assert hits("^0$") == {"Straße ÄÖ", "b", "c"}  # the derived age
    assert hits("nan|null") == set()
    assert hits("\\E", regex=False) == set()
    with pytest.raises(SearchPatternError):
        filters.searched(r, "(")


def test_replacement_is_taken_before_the_search(spark):
    r = register(spark, ["Model", "User"], [("a", "x"), ("a", "y"), ("b", "x")])
    spec = FilterSpec(replacement_models=["a"], search="^y$")
    shown, replacement = apply_filters(r, spec)
    assert (shown.df.count(), replacement.df.count()) == (1, 2)
    assert tuple(metrics.summary_kpis(r, spec).first()) == (1, -1, 2, 200.0)
    assert apply_filters(r, FilterSpec(search="y"))[1] is None


def test_key_figures_of_nothing(spark):
    r = register(spark, ["Model", "Place"], [("a", "p")])
    none = r.with_rows(r.df.where("model = 'zzz'"))
    assert tuple(metrics.summary_kpis(none).first()) == (0, 0, 0, 0.0)
    cube = metrics.region_model_cube(none).collect()
    assert [(x["level"], x["n"]) for x in cube] == [(3, 0)]
    assert metrics.model_share(none).count() == 0
    assert metrics.model_counts(none).count() == 0


def test_a_model_called_total_stays_a_model(spark):
    r = register(spark, ["Model", "Place"], [("Total", "Grand Total"), ("x", "p")])
    cube = metrics.region_model_cube(r).where("level = 0").collect()
    assert {(x["region"], x["model"]) for x in cube} == {("Grand Total", "Total"), ("p", "x")}
    wide = metrics.region_model_pivot(r, metrics.pivot_models(r)).collect()
    assert [x["total"] for x in wide if x["is_total"]] == [2]


def test_models_named_like_columns_of_the_wide_form(spark, tmp_path):
    r = register(spark, ["Model", "Place"], [(m, "p") for m in ("M1", "region", "total", "Total", "m1")])
    wide = metrics.region_model_pivot(r, metrics.pivot_models(r))
    assert wide.columns == ["region", "M1", "Total_", "m1_", "region_", "total__", "total", "is_total"]
    wide.write.parquet(str(tmp_path / "wide"))
    assert [x["total"] for x in spark.read.parquet(str(tmp_path / "wide")).collect()] == [5, 5]


def test_wide_form_without_a_column_per_model(spark):
    assets = [(f"m{k:04}", "p" if k % 3 else "q") for k in range(3000)] + [("m0001", "q"), (None, "q"), ("m0001", None)]
    r = register(spark, ["Model", "Place"], assets)
    wide = metrics.region_model_map(r).collect()
    assert [(x["region"], x["total"], x["is_total"]) for x in wide] == [("p", 2000, False), ("q", 1001, False), (None, 3001, True)]
    counts = [dict(map(tuple, x["models"])) for x in wide]
    assert [len(c) for c in counts] == [2000, 1001, 3000] and [c.get("m0001") for c in counts] == [1, 1, 2]
    nothing = metrics.region_model_map(r.with_rows(r.df.where("model = 'zzz'"))).collect()
    assert [(x["region"], x["models"], x["total"]) for x in nothing] == [(None, [], 0)]


def test_cross_tab_in_blocks_of_very_many_models(spark):
    """No list of models anywhere, rows of bounded size, and a plan that doesn't know how many models there are."""
    rows = spark.range(300_000).selectExpr(
        "concat('m', lpad(id % 100000, 6, '0')) AS Model", "if(id % 3 = 0, 'p', 'q') AS Place"
    )
    r = Register.of(rows)
    blocks = metrics.region_model_blocks(r)
    found = blocks.selectExpr("*", "size(models) AS n").drop("models").collect()
    assert {x["n"] for x in found} == {1000} and len(found) == 300
    assert sum(x["total"] for x in found if x["is_total"]) == 300_000
    assert {x["region"] for x in found} == {None, "p", "q"}
    ends = sorted((x["block"], x["first_model"], x["last_model"]) for x in found if x["is_total"])
    assert ends == [(b, f"m{b * 1000:06}", f"m{b * 1000 + 999:06}") for b in range(100)]
    one = blocks.where("region = 'p' and block = 7").first()
    assert one["models"] == {f"m{k:06}": 1 for k in range(7000, 8000)}
    few = Register.of(spark.createDataFrame([("m", "p")], "Model string, Place string"))
    shape = [re.sub(r"\d+", "", metrics.region_model_blocks(x)._jdf.queryExecution().optimizedPlan().toString()) for x in (r, few)]
    assert len(shape[0].splitlines()) == len(shape[1].splitlines())
    assert len(metrics.region_model_blocks(few).collect()) == 2
    assert metrics.region_model_blocks(few.with_rows(few.df.where("model = 'z'"))).count() == 0


def test_domains_in_order_of_appearance(spark):
    header = ["Asset Tag", "Model", "User", "Site", "Place"]
    cells = [header, ["1", "b", "u", "s2", ""], ["2", "a", "u", "s1", "x"], ["3", "b", "u", "s2", "x"]]
    rows = [("p", "s", k, c) for k, c in enumerate(cells)]
    grid = spark.createDataFrame(rows, "path string, sheet string, pos bigint, cells array<string>")
    found = filters.domains_in_order(canonical_rows(grid, register_table(grid), with_present=True)).collect()
    domains: dict = {}
    for x in sorted(found, key=lambda x: x["first_row"]):
        domains.setdefault(x["role"], []).append(x["value"])
    assert domains == {"model": ["b", "a"], "site": ["s2", "s1"], "place": [None, "x"]}


def test_date_formats_are_elected_by_the_first_value(spark):
    values = {
        "iso": [None, "2020-05-04", "04/05/2020", "2020-13-01"],
        "day first": ["13/01/2020", "02/01/2020", "2020-01-05"],
        "month first": ["01/13/2020", "02/01/2020", "02/14/2020"],
        "either": ["01/02/2020", "03/04/2020"],
        "either, but later": ["01/02/2020", "03/25/2020"],
        "unread first": ["unknown", "04 May 2020", "05 May 2020", "2020-01-01"],
        "nothing": [None, None],
        "no dates": ["x", "17"],
    }
    rows = [(p, "s", k, v) for p, vs in values.items() for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "path string, sheet string, pos bigint, value string")
    elected = formats.elected_formats(df, "value")
    found = {x["path"]: (x["date_format"], x["n_values"], x["n_read"]) for x in elected.collect()}
    assert found == {
        "iso": ("ISO", 3, 1), "day first": ("dd/MM/yyyy", 3, 2), "month first": ("MM/dd/yyyy", 3, 3),
        "either": ("dd/MM/yyyy", 2, 2), "either, but later": ("MM/dd/yyyy", 2, 2),
        "unread first": ("dd MMM yyyy", 4, 2), "nothing": (None, 0, 0), "no dates": (None, 2, 0),
    }
    dated = formats.with_elected_dates(df, elected, "value", "date", rows_per_slice=2)
    dates = {(x["path"], x["pos"]): x["date"] and f"{x['date']:%Y-%m-%d}" for x in dated.collect()}
    assert len(dates) == len(rows)
    assert [dates["iso", k] for k in range(4)] == [None, "2020-05-04", None, None]
    assert [dates["day first", k] for k in range(3)] == ["2020-01-13", "2020-01-02", None]
    assert dates["either, but later", 0] == "2020-01-02" and dates["unread first", 3] is None
    assert dates["no dates", 1] is None


def test_domains_of_a_typed_register(spark):
    from assetlens.plans.register import Register

    df = spark.sql("SELECT 'm' AS Model, 7 AS Site, 'IT' AS Department, DATE'2020-01-02' AS Location")
    found = filters.filter_domains(Register.of(df)).collect()
    assert {r["value"] for r in found} >= {"7", "IT", "2020-01-02"}


def test_patterns_only_one_engine_takes(spark):
    from assetlens.errors import SearchPatternError

    r = register(spark, ["Model", "Place"], [("a(b", "p")])
    with pytest.raises(SearchPatternError):
        filters.found_in([r.col("model")], "(a)?(?(1)b|c)")
    hits = r.df.where(filters.found_in([r.col("model")], "A(B", regex=False))
    assert hits.count() == 1


def test_ties_go_by_value(spark):
    r = register(spark, ["Model", "Location"], [("m", x) for x in "cbaabcd"])
    assert [x[0] for x in metrics.top_values(r, "location", 3).collect()] == ["a", "b", "c"]


def test_a_kind_column_without_values(spark):
    r = register(spark, ["Model", "Workstation Type"], [("m", None)])
    assert metrics.type_counts(r).count() == 0

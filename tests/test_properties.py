"""Relations that hold for any register."""

import random

import pytest

from assetlens import Register
from assetlens.operators import filters, metrics, quality
from assetlens.operators.derive import derived
from templates import WORKSTATION_HEADERS, table


def random_rows(seed, size=400):
    rng = random.Random(seed)
    pools = {
        "Asset Tag": [*map(str, range(150)), None, ""],
        "Model": ["m1", "m2", "m3", "Total", None],
        "Workstation Type": ["Laptop", "Desktop", None],
        "Serial Number": [*map(str, range(300)), None],
        "User": ["u1", "u2", "", None, " "],
        "User Email": ["a@b.com", "bad", "", None],
        "Department": ["IT", "HR", None],
        "Year Of Purchase": ["2020", "2024", "x", None, "2019.5", "2030"],
        "Warranty Expiry": ["2025-06-15", "2025-07-01", "2026-01-01", "?", None, "2020-01-01"],
        "Place": ["p1", "p2", None],
    }
    return [
        tuple(rng.choice(pools.get(h, ["v1", "v2", None])) for h in WORKSTATION_HEADERS)
        for _ in range(size)
    ]


@pytest.fixture(scope="module", params=[11, 12])
def register(spark, request):
    rows = random_rows(request.param)
    return derived(Register.of(table(spark, WORKSTATION_HEADERS, rows)), "2025-06-15 10:30:00")


def total(df):
    return sum(r["n"] for r in df.collect())


def test_labels_cover_all_rows(register):
    assert total(metrics.warranty_counts(register)) == 400
    assert total(metrics.age_counts(register)) == 400


def test_cube_adds_up(register):
    cube = metrics.region_model_cube(register).collect()
    by_level = [sum(r["n"] for r in cube if r["level"] == level) for level in range(4)]
    assert len(set(by_level)) == 1


def test_shares_add_up(register):
    assert sum(r["share"] for r in metrics.model_share(register).collect()) == pytest.approx(100)


def test_order_of_selections_does_not_matter(register):
    a, b = {"model": ["m1", None]}, {"department": ["IT", None]}
    one = filters.selected(filters.selected(register, a), b).df.collect()
    two = filters.selected(filters.selected(register, b), a).df.collect()
    both = filters.selected(register, a | b).df.collect()
    assert sorted(map(str, one)) == sorted(map(str, two)) == sorted(map(str, both))


def test_duplicate_rows_are_those_of_repeated_values(register):
    for role in ("asset_tag", "serial_number"):
        repeated = quality.duplicate_values(register, role)
        assert quality.duplicate_rows(register, role, 3).count() == total(repeated)


def test_report_agrees_with_the_lists(register):
    report = {r["issue"]: r["n"] for r in quality.quality_report(register).collect()}
    assert list(report.values()) == [
        quality.duplicate_values(register, "asset_tag").count(),
        quality.duplicate_values(register, "serial_number").count(),
        quality.missing_user_rows(register).count(),
        quality.invalid_email_rows(register).count(),
    ]


@pytest.mark.parametrize("text", ["m1", "IT", "lapTOP", "2025", "zzz"])
def test_plain_text_is_found_either_way(register, text):
    one = filters.searched(register, text, regex=True).df.collect()
    two = filters.searched(register, text, regex=False).df.collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_counters_agree_with_the_single_results(register):
    spec = filters.FilterSpec({"model": ["m1", "m2"]}, ["m2"], "p1")
    row = metrics.counters(register, spec).first().asDict()
    shown, _ = filters.apply_filters(register, spec)
    assert tuple(metrics.summary_kpis(register, spec).first()) == tuple(row.values())[:4]
    warranty = [r["n"] for r in metrics.warranty_counts(shown).collect()]
    ages = [r["n"] for r in metrics.age_counts(shown).collect()]
    assert warranty == [v for k, v in row.items() if k.startswith("warranty_")]
    assert ages == [v for k, v in row.items() if k.startswith("age_")]
    summary = metrics.age_summary(shown).first()
    assert (summary["sum_age"], summary["mean_age"]) == (row["sum_age"], row["mean_age"])

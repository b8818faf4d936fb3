"""Role resolution and classification, in both forms."""

import random

import pytest
from pyspark.sql import functions as F

from assetlens import Register
from assetlens.errors import ModelColumnMissing
from assetlens.operators import roles
from templates import table

CATALOGUE = {
    "e1": ["User Email", "USER", "asset_tag", "Asset Tag", "Model", "Place"],
    "e2": ["Product Type", "Product", "Programme", "Asset-Tag"],
    "e3": ["Model No", "Product"],
    "e4": ["Estate", "Website", "Replacement", "Model", "Workstation Type"],
    "e5": ["Serial", "Name"],
    "e6": ["program", "Product", "PROGRAMME"],
}


def register_rows(spark, catalogue):
    rows = [
        (path, "Assets", 0, [(i, name) for i, name in enumerate(names)])
        for path, names in catalogue.items()
    ]
    return spark.createDataFrame(
        rows, "path string, sheet string, header_row bigint, columns array<struct<col:int,name:string>>"
    )


def names_by_role(headers):
    kind = roles.kind_of(headers)
    return kind, {role: headers[i] for role, i in roles.resolve(headers, kind).items()}


def test_one_table():
    kind, found = names_by_role(CATALOGUE["e1"])
    assert kind == "Workstation"
    assert found["user"] == "User Email"  # stands before "USER"
    assert found["asset_tag"] == "Asset Tag"  # normalises like "asset_tag"; the last one counts
    assert found["model"] == "Model"
    kind, found = names_by_role(CATALOGUE["e2"])
    assert (kind, found["model"], found["programme"]) == ("Mobile", "Product Type", "Programme")
    kind, found = names_by_role(CATALOGUE["e3"])
    assert (kind, found["model"]) == ("Mobile", "Product")  # a tie
    kind, found = names_by_role(CATALOGUE["e4"])
    assert (found["state"], found["site"], found["place"]) == ("Estate", "Website", "Replacement")
    # The first term goes before an earlier column that only meets the second.
    assert names_by_role(CATALOGUE["e6"])[1]["programme"] == "PROGRAMME"


def random_catalogue(seed, size=200):
    rng = random.Random(seed)
    words = ["Model", "model", "Product", "product type", "User", "USER", "user email", "Place",
             "Site", "Web Site", "State", "Programme", "program", "Asset Tag", "asset_tag", "x",
             "Warranty Expiry", "Workstation Type", "Workstation-Status", "", "Location"]
    return {f"r{i}": rng.choices(words, k=rng.randint(1, 9)) for i in range(size)}


@pytest.mark.parametrize("catalogue", [CATALOGUE, random_catalogue(1)], ids=["fixed", "random"])
def test_many_registers_agree_with_one_table(spark, catalogue):
    registers = register_rows(spark, catalogue)
    kinds = {r["path"]: r["asset_type"] for r in roles.asset_types(registers).collect()}
    found: dict = {path: {} for path in catalogue}
    for r in roles.resolved_roles(registers).collect():
        found[r["path"]][r["role"]] = r["col"]
    for path, headers in catalogue.items():
        kind = roles.kind_of(headers)
        assert kinds[path] == kind, headers
        assert found[path] == roles.resolve(headers, kind), headers
    missing = {r["path"] for r in roles.missing_model(registers).collect()}
    assert missing == {path for path in catalogue if "model" not in found[path]}


def test_scores(spark):
    row = roles.asset_types(register_rows(spark, {"m": CATALOGUE["e2"]})).first()
    assert (row["workstation_score"], row["mobile_score"]) == (0, 3)


def test_register_needs_a_model(spark):
    with pytest.raises(ModelColumnMissing):
        Register.of(table(spark, ["Asset Tag", "User"], [("a", "b")]))


def test_headers_that_differ_in_case_or_hold_dots(spark):
    headers = ["Model", "model", "Model.1", "User ", " User", "Asset Age", "`x`"]
    register = Register.of(table(spark, headers, [tuple("abcdefg")]))
    assert list(register.headers.values()) == ["Model", "model", "Model.1", "User", "Asset Age", "`x`"]
    assert register.df.columns == ["model", "model_2", "model_1", "user", "asset_age", "x"]
    # Headers that normalise alike: the last one is meant.
    assert register.roles["model"] == "model_2"
    assert register.df.select(register.col("model")).first()[0] == "b"
    assert register.df.select("user").first()[0] == "d"


def test_a_column_with_two_roles_is_shown_once(spark):
    register = Register.of(table(spark, ["Model", "User Email"], [("m", "a@b.com")]))
    assert register.roles["user"] == register.roles["user_email"]
    shown = register.df.select(*register.role_columns(["user", "user_email", "model"]))
    assert shown.columns == ["user", "model"]


def test_normalised_text_agrees_with_names(spark):
    from assetlens.functions.text import normalized, normalized_name

    names = ["Asset-Tag", "ÄSSET tag", "User\tEmail", "№ 5", "K", ""]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    rows = df.select("name", normalized(F.col("name")).alias("n")).collect()
    assert {r["name"]: r["n"] for r in rows} == {n: normalized_name(n) for n in names}

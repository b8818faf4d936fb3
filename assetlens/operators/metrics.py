"""Key figures, counts, cross-tabs, shares and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlens.functions.labels import AGE_LABELS, WARRANTY_LABELS, age_label
from assetlens.operators.filters import (
    FilterSpec,
    found_anywhere,
    marked_for_replacement,
    selected,
)
from assetlens.operators.ranks import with_row_numbers
from assetlens.plans.register import Register
from assetlens.session import staged

# Fixed value: how many values a ranking shows.
TOP = 10
#: Models in one row of the cross-tab in blocks.
MODELS_PER_BLOCK = 1000


def kpi_columns(total: Column, replacement: Column) -> list[Column]:
    """The four key figures out of two counts."""
    rate = F.when(total > 0, replacement / total * 100).otherwise(F.lit(0.0))
    return [
        total.alias("total_assets"),
        (total - replacement).alias("active_assets"),
        replacement.alias("replacement_assets"),
        rate.alias("replacement_rate"),
    ]


def summary_kpis(register: Register, spec: FilterSpec | None = None) -> DataFrame:
    """Total, active and replacement assets and the replacement rate, in one pass.

    The total counts rows after the search, the replacement assets rows before it; so the
    number of active ones may fall below zero.
    """
    spec = spec or FilterSpec()
    chosen = selected(register, spec.selections)
    marked = (
        marked_for_replacement(chosen, spec.replacement_models)
        if spec.replacement_models
        else F.lit(False)
    )
    return chosen.df.agg(
        F.count_if(found_anywhere(chosen, spec)).alias("shown"),
        F.count_if(marked).alias("marked"),
    ).select(*kpi_columns(F.col("shown"), F.col("marked")))


def value_counts(register: Register, role: str, counted: str = "n") -> DataFrame | None:
    """Rows per value, missing values left out; None without the column."""
    if not register.has(role):
        return None
    return (
        register.df.select(register.col(role).alias(role))
        .where(F.col(role).isNotNull())
        .groupBy(role)
        .agg(F.count("*").alias(counted))
    )


def ranked_counts(register: Register, role: str, counted: str = "n") -> DataFrame | None:
    """`value_counts`, most frequent first; equal counts in order of value."""
    counts = value_counts(register, role, counted)
    return None if counts is None else counts.orderBy(F.desc(counted), role)


def role_counts(register: Register, roles: Sequence[str]) -> DataFrame:
    """Rows per value of several roles, `role, value, n`, in one pass over the rows.

    For rows that are costly to come by, say after a search: the single counts would each go
    through them again. Every row turns into one pair per role, and the pairs are counted
    before they are shuffled.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(r).alias("role"), register.col(r).cast("string").alias("value"))
            for r in roles
            if register.has(r)
        ]
    )
    return (
        register.df.select(F.inline(pairs))
        .where(F.col("value").isNotNull())
        .groupBy("role", "value")
        .agg(F.count("*").alias("n"))
    )


def type_counts(register: Register) -> DataFrame | None:
    """Assets per kind of device."""
    return ranked_counts(register, "asset_kind")


def model_counts(register: Register) -> DataFrame:
    """Assets per model."""
    return ranked_counts(register, "model", "total_units")


def top_values(register: Register, role: str, top: int = TOP) -> DataFrame | None:
    """The most frequent values of a role."""
    counts = value_counts(register, role)
    return None if counts is None else counts.orderBy(F.desc("n"), role).limit(top)


def labelled(counts: DataFrame, label: str, names: Sequence[str]) -> DataFrame:
    """One row per count column `c0, c1, …`, in the given order."""
    pairs = [
        F.struct(F.lit(name).alias(label), F.col(f"c{i}").alias("n"))
        for i, name in enumerate(names)
    ]
    return counts.select(F.inline(F.array(*pairs)))


def label_counts(df: DataFrame, column: Column, label: str, names: Sequence[str]) -> DataFrame:
    """Rows per label, 0 for absent ones; every task sends one row of counters."""
    counters = [F.count_if(column == name).alias(f"c{i}") for i, name in enumerate(names)]
    return labelled(df.agg(*counters), label, names)


def warranty_counts(register: Register) -> DataFrame | None:
    """Rows per warranty status; None where the register has no warranty."""
    if "warranty_status" not in register.df.columns:
        return None
    return label_counts(
        register.df, F.col("warranty_status"), "warranty_status", WARRANTY_LABELS
    )


def age_counts(register: Register) -> DataFrame:
    """Rows per age category."""
    return label_counts(
        register.df, age_label(F.col("asset_age")), "age_category", AGE_LABELS
    )


def age_summary(register: Register) -> DataFrame:
    """Sum of ages, mean over positive ages, and whether the age section is worth showing."""
    age = F.col("asset_age")
    total = F.coalesce(F.sum(age), F.lit(0).cast("bigint"))
    return register.df.agg(
        total.alias("sum_age"),
        F.avg(F.when(age > 0, age)).alias("mean_age"),
        (total != 0).alias("has_ages"),
    )


def region_model_counts(register: Register) -> DataFrame | None:
    """Rows per region and model, both present; None without a region column."""
    if not register.has(register.region_role):
        return None
    return (
        register.df.select(
            register.col(register.region_role).alias("region"),
            register.col("model").alias("model"),
        )
        .where(F.col("region").isNotNull() & F.col("model").isNotNull())
        .groupBy("region", "model")
        .agg(F.count("*").alias("n"))
    )


def region_model_cube(register: Register) -> DataFrame | None:
    """The cross-tab in long form, with totals per region, per model and over all.

    `level` is 0 for a cell, 1 for a region's total, 2 for a model's total, 3 for the grand
    total, which is there even for an empty table. Totals are summed over the counted cells,
    not over the rows.
    """
    cells = region_model_counts(register)
    if cells is None:
        return None
    totals = cells.groupingSets(
        [["region", "model"], ["region"], ["model"]], "region", "model"
    ).agg(
        F.grouping_id().cast("int").alias("level"),
        F.sum("n").alias("n"),
    )
    grand = cells.agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("n")).select(
        F.lit(None).cast("string").alias("region"),
        F.lit(None).cast("string").alias("model"),
        F.lit(3).alias("level"),
        "n",
    )
    return totals.unionByName(grand)


def region_model_pivot(register: Register, models: Sequence[str]) -> DataFrame | None:
    """The cross-tab in wide form: a row per region, a column per given model, totals.

    For display. `is_total` marks the grand total, so that no region name can be mistaken for
    it. `models` names the columns, with `_` added to a name that is taken but for case; `total`
    covers all models, given or not.
    """
    cells = region_model_counts(register)
    if cells is None:
        return None
    columns = [
        F.coalesce(F.sum(F.when(F.col("model").eqNullSafe(F.lit(m)), F.col("n"))), F.lit(0)).alias(f"c{i}")
        for i, m in enumerate(models)
    ]
    total = F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("total")
    by_region = cells.groupBy("region").agg(*columns, total)
    grand = cells.agg(*columns, total).withColumn("region", F.lit(None).cast("string"))
    taken = {"region", "total", "is_total"}
    named = []
    for i, model in enumerate(models):
        name = "unnamed" if model is None else model
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        named.append(F.col(f"c{i}").alias(name))
    return (
        by_region.withColumn("is_total", F.lit(False))
        .unionByName(grand.withColumn("is_total", F.lit(True)))
        .orderBy("is_total", "region")
        .select("region", *named, "total", "is_total")
    )


def region_model_map(register: Register) -> DataFrame | None:
    """The cross-tab with a row per region and its models in one column, totals.

    `models` has each model of the region with its count, in the order of models. All grouping is
    done in Spark and the plan is the same for any number of models; a row holds the models of its
    region, the total's those of all.
    """
    cells = region_model_counts(register)
    if cells is None:
        return None
    models = F.sort_array(F.collect_list(F.struct("model", "n"))).alias("models")
    total = F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("total")
    by_region = cells.groupBy("region").agg(models, total).withColumn("is_total", F.lit(False))
    grand = cells.groupBy("model").agg(F.sum("n").alias("n")).agg(models, total)
    grand = grand.withColumns({"region": F.lit(None).cast("string"), "is_total": F.lit(True)})
    return by_region.unionByName(grand).orderBy("is_total", "region")


def region_model_blocks(register: Register, models_per_block: int = MODELS_PER_BLOCK) -> DataFrame | None:
    """The cross-tab in wide form, cut into blocks of neighbouring models, for any number of models.

    Models are numbered in their order, and each run of `models_per_block` is a block. A row has a region
    and a block: `first_model` and `last_model` of the block, `models` with the region's count of each of
    the block's models that it has, and `total`, their sum. Rows with `is_total` and no region are the
    totals of all regions. So a row holds a bounded number of models, none is gathered on the driver,
    and the plan is the same for any number of them. Totals are summed over the counted cells. A region that
    has none of a block's models has no row for it.
    """
    cells = region_model_counts(register)
    if cells is None:
        return None
    cells = staged(cells)
    totals = cells.groupBy("model").agg(F.sum("n").alias("n"))
    block = F.floor(F.col("place") / models_per_block).alias("block")
    numbered = staged(with_row_numbers(totals, ["model"], "place").select("model", "n", block))
    ends = numbered.groupBy("block").agg(F.min("model").alias("first_model"), F.max("model").alias("last_model"))
    of_regions = cells.join(numbered.select("model", "block"), "model").withColumn("is_total", F.lit(False))
    of_all = numbered.withColumns({"region": F.lit(None).cast("string"), "is_total": F.lit(True)})
    listed = F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", "n")))).alias("models")
    rows = of_regions.unionByName(of_all).groupBy("is_total", "region", "block").agg(listed, F.sum("n").alias("total"))
    return rows.join(ends, "block").select(
        "region", "block", "first_model", "last_model", "models", "total", "is_total"
    )


def pivot_models(register: Register) -> list[str]:
    """The models in order, as columns for the wide cross-tab.

    Runs a job and holds the list on the driver, as the plan with a column per model does anyway;
    for very many models use `region_model_blocks` or the long form, `region_model_cube`.
    """
    rows = value_counts(register, "model").select("model").orderBy("model")
    return [row["model"] for row in rows.collect()]


def model_share(register: Register) -> DataFrame:
    """Assets per model and their share of the total in percent.

    The total is a scalar subquery over the counts: no task has to hold all of them.
    """
    counts = value_counts(register, "model")
    total = counts.agg(F.sum("n").alias("total")).select("total").scalar()
    return counts.withColumn("share", F.col("n") / total * 100).orderBy(F.desc("n"), "model")


def counters(register: Register, spec: FilterSpec | None = None) -> DataFrame:
    """Key figures, warranty counts and age figures in one row, from one pass.

    Needs the derived columns.
    """
    spec = spec or FilterSpec()
    chosen = selected(register, spec.selections)
    shown = found_anywhere(chosen, spec)
    marked = (
        marked_for_replacement(chosen, spec.replacement_models)
        if spec.replacement_models
        else F.lit(False)
    )
    age = F.when(shown, F.col("asset_age"))
    figures = [
        F.count_if(shown).alias("shown"),
        F.count_if(marked).alias("marked"),
        F.coalesce(F.sum(age), F.lit(0).cast("bigint")).alias("sum_age"),
        F.avg(F.when(age > 0, age)).alias("mean_age"),
    ]
    names = ["sum_age", "mean_age"]
    if "warranty_status" in chosen.df.columns:
        for status in WARRANTY_LABELS:
            name = "warranty_" + status.lower().replace(" ", "_")
            figures.append(F.count_if(shown & (F.col("warranty_status") == status)).alias(name))
            names.append(name)
    for label in AGE_LABELS:
        name = "age_" + label.split()[0].lower()
        figures.append(F.count_if(shown & (age_label(F.col("asset_age")) == label)).alias(name))
        names.append(name)
    return chosen.df.agg(*figures).select(
        *kpi_columns(F.col("shown"), F.col("marked")), *names
    )

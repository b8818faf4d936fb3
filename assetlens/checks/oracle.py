"""SQL per registered query, for comparison on the same tables with another engine."""

from __future__ import annotations

from collections.abc import Sequence

from assetlens.checks.derived import HEADER_STYLES, ORDERS_PER_EXTRACT, WORKBOOK_HEADERS
from assetlens.checks.queries import (
    LITERAL,
    MOBILE_CHOICES,
    MOBILE_SPEC,
    SEARCH,
    WORKSTATION_CHOICES,
    WORKSTATION_SPEC,
    filter_name,
    mobile_name,
)
from assetlens.operators.filters import FilterSpec

# Fixed values, stated here once more: the comparison must not share them with the code it checks.
WORKSTATION, MOBILE = "Workstation", "Mobile"
HEADER_KEYWORDS = (
    "model serial user department asset workstation location site computer employee email product mobile "
    "programme program"
).split()
MISSING_MARKERS = ["", *"#N/A #NA -1.#IND -1.#QNAN -NaN -nan 1.#IND 1.#QNAN <NA> N/A NA NULL NaN None n/a nan null".split()]
MISSING_MARKERS.append("#N/A N/A")
KIND_IDENTIFIERS = {
    WORKSTATION: ["workstation", "model", "warranty", "place"],
    MOBILE: ["product", "programme", "program"],
}
#: Roles in the order of the canonical table, with their terms per kind, normalised.
TERMS = [
    ("asset_tag", ["assettag"], ["assettag"]),
    ("model", ["model"], ["product"]),
    ("asset_kind", ["workstationtype"], ["producttype"]),
    ("serial_number", ["serialnumber"], ["serialnumber"]),
    ("user", ["user"], ["user"]),
    ("user_email", ["email"], ["email"]),
    ("department", ["department"], ["department"]),
    ("location", ["location"], ["location"]),
    ("site", ["site"], ["site"]),
    ("place", ["place"], []),
    ("purchase_year", ["yearofpurchase"], ["yearofpurchase"]),
    ("warranty_expiry", ["warrantyexpiry"], []),
    ("status", ["workstationstatus"], []),
    ("state", ["state"], ["state"]),
    ("programme", [], ["programme", "program"]),
]
ROLES = [role for role, _, _ in TERMS]
#: The roles that may be selected, in the order in which they are offered.
SELECTABLE = {
    WORKSTATION: ["model", "asset_kind", "site", "location", "department", "status", "place", "state"],
    MOBILE: ["model", "asset_kind", "site", "location", "department", "programme", "state"],
}
#: The roles of the counts over several of them.
COUNTED_ROLES = ["asset_kind", "model", "department", "location"]


def role_terms(kind: str) -> dict[str, list[str]]:
    """Terms per role of a kind."""
    return {t[0]: names for t in TERMS if (names := t[1 if kind == WORKSTATION else 2])}


AS_OF = "timestamp '2001-06-15 10:30:00'"

JOINED = """
from lineitem
join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
join region on n_regionkey = r_regionkey"""

WORKSTATION_TABLE = f"""
select
  case when l_orderkey % 97 = 0 then null
       else concat('AT', cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar)) end
    as asset_tag,
  p_brand as model, p_type as workstation_type,
  concat('SN', cast(l_partkey as varchar), '-', cast(l_suppkey as varchar)) as serial_number,
  case when o_custkey % 23 = 0 then null when o_custkey % 29 = 0 then '' else c_name end as "user",
  case when o_custkey % 13 = 0 then null
       when o_custkey % 11 = 0 then concat('user', cast(o_custkey as varchar), '.example.com')
       when o_custkey % 7 = 0 then concat('user', cast(o_custkey as varchar), '@example.com (old)')
       else concat('user', cast(o_custkey as varchar), '@example.com') end as user_email,
  case when o_custkey % 47 = 0 then null else c_mktsegment end as department,
  n_name as location, o_orderpriority as site,
  case when o_orderkey % 31 = 0 then 'n/a' when o_orderkey % 37 = 0 then null
       else cast(year(o_orderdate) as varchar) end as year_of_purchase,
  case when l_orderkey % 41 = 0 then 'unknown' when l_orderkey % 43 = 0 then null
       else cast(cast(l_shipdate + interval 3 year as date) as varchar) end as warranty_expiry,
  case when n_nationkey % 9 = 0 then null else r_name end as place,
  l_linestatus as workstation_status, o_orderstatus as state
{JOINED}"""

MOBILE_TABLE = f"""
select
  case when l_orderkey % 97 = 0 then null
       else concat('MB', cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar)) end
    as asset_tag,
  p_name as product, p_type as product_type,
  concat('SNM', cast(l_partkey as varchar), '-', cast(l_suppkey as varchar)) as serial_number,
  case when o_custkey % 23 = 0 then null when o_custkey % 29 = 0 then '' else c_name end as "user",
  c_mktsegment as department, n_name as location,
  case when n_nationkey % 9 = 0 then null else r_name end as site,
  case when o_orderkey % 31 = 0 then 'n/a' when o_orderkey % 37 = 0 then null
       else cast(year(o_orderdate) as varchar) end as year_of_purchase,
  o_orderpriority as programme, o_orderstatus as state
{JOINED}"""

AGE = r"""
  coalesce(try_cast(trunc(2001 - case
    when regexp_full_match(year_of_purchase, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*')
    then try_cast(year_of_purchase as double) end) as bigint), 0) as asset_age"""

WARRANTY = r"""
  case when regexp_full_match(warranty_expiry, '\s*\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}:\d{2}(\.\d{1,6})?)?\s*')
       then try_cast(warranty_expiry as timestamp) end as warranty_expiry_date"""

DAYS = f"""
  cast(floor((epoch_us(warranty_expiry_date) - epoch_us({AS_OF})) / 86400000000.0) as bigint)
    as days_to_expiry"""

STATUS = """
  case when days_to_expiry < 0 then 'Expired'
       when days_to_expiry between 0 and 90 then 'Expiring Soon'
       when days_to_expiry > 90 then 'Active' else 'Unknown' end as warranty_status"""

AGE_CATEGORY = """
  case when asset_age <= 1 then 'New (0-1 year)' when asset_age <= 3 then 'Active (1-3 years)'
       when asset_age <= 5 then 'Aging (3-5 years)' else 'Old (5+ years)' end"""

EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"

#: The models of the given tables, stated here so that a column that is missing shows.
PIVOT_MODELS = [f"Brand#{i}" for i in range(1, 26)]


class RegisterSql:
    """Names of one kind of register, and the common part of its statements."""

    def __init__(self, kind: str):
        mobile = kind == MOBILE
        self.kind = kind
        self.spec: FilterSpec = MOBILE_SPEC if mobile else WORKSTATION_SPEC
        self.choices = MOBILE_CHOICES if mobile else WORKSTATION_CHOICES
        self.columns = {
            "asset_tag": "asset_tag",
            "model": "product" if mobile else "model",
            "asset_kind": "product_type" if mobile else "workstation_type",
            "serial_number": "serial_number",
            "user": '"user"',
            "department": "department",
            "location": "location",
            "site": "site",
            "state": "state",
            "purchase_year": "year_of_purchase",
        }
        if mobile:
            self.columns["programme"] = "programme"
            self.region = "site"
            self.searched = [
                *[c for c in self.columns.values()],
                "cast(asset_age as varchar)",
            ]
            self.derived = f"with a as (select *, {AGE} from ({MOBILE_TABLE}) t)"
            self.table = "a"
        else:
            self.columns |= {
                "user_email": "user_email",
                "place": "place",
                "status": "workstation_status",
                "warranty_expiry": "warranty_expiry",
            }
            self.region = "place"
            self.searched = [
                *[c for c in self.columns.values()],
                "cast(asset_age as varchar)",
                "strftime(warranty_expiry_date, '%Y-%m-%d %H:%M:%S')",
                "cast(days_to_expiry as varchar)",
                "warranty_status",
            ]
            self.derived = (
                f"with a0 as (select *, {AGE}, {WARRANTY} from ({WORKSTATION_TABLE}) t), "
                f"a1 as (select *, {DAYS} from a0), a as (select *, {STATUS} from a1)"
            )
            self.table = "a"

    def sql(self, body: str) -> str:
        return f"{self.derived}\n{body}"

    def named(self, roles: Sequence[str]) -> str:
        return ", ".join(
            f"{self.columns[r]} as \"{r}\"" for r in roles if r in self.columns
        )

    def found(self, pattern: str, literal: bool = False) -> str:
        if literal:
            tests = [f"contains(lower({c}), lower('{pattern}'))" for c in self.searched]
        else:
            tests = [f"regexp_matches({c}, '{pattern}', 'i')" for c in self.searched]
        return "(" + " or ".join(f"coalesce({t}, false)" for t in tests) + ")"

    def selection(self) -> str:
        return " and ".join(
            member(self.columns[role], values) for role, values in self.spec.selections.items()
        )

    def replaced(self) -> str:
        return member(self.columns["model"], self.spec.replacement_models)


def quoted(values: Sequence[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def member(column: str, values: Sequence[str | None]) -> str:
    tests = []
    present = [v for v in values if v is not None]
    if present:
        tests.append(f"coalesce({column} in ({quoted(present)}), false)")
    if None in values:
        tests.append(f"{column} is null")
    return "(" + " or ".join(tests) + ")"


def counts(r: RegisterSql, role: str, counted: str = "n") -> str:
    column = r.columns[role]
    return (
        f"select {column} as {role}, count(*) as {counted} from a "
        f"where {column} is not null group by {column}"
    )


def duplicates_detail(r: RegisterSql, role: str, shown: Sequence[str]) -> str:
    column = r.columns[role]
    return (
        f"select {r.named(shown)} from a where {column} in (select {column} from a "
        f"where {column} is not null group by {column} having count(*) > 1)"
    )


def register_sql(kind: str) -> dict[str, str]:
    """Statements for the queries that both kinds of register have."""
    r = RegisterSql(kind)
    found = r.found(r.spec.search or "")
    missing = '("user" is null or "user" = \'\')'
    model = r.columns["model"]
    domain = " union ".join(
        f"select '{role}' as role, {r.columns[role]} as value from a"
        for role in SELECTABLE[kind]
        if role in r.columns
    )
    issues = [
        (
            1,
            "Duplicate Asset Tags",
            "high",
            "'Found ' || n || ' duplicate asset tags'",
            "select count(*) as n from (select asset_tag from a where asset_tag is not null "
            "group by asset_tag having count(*) > 1)",
        ),
        (
            2,
            "Duplicate Serial Numbers",
            "high",
            "'Found ' || n || ' duplicate serial numbers'",
            "select count(*) as n from (select serial_number from a where serial_number is not "
            "null group by serial_number having count(*) > 1)",
        ),
        (
            3,
            "Missing User Assignment",
            "medium",
            "n || ' assets without assigned users'",
            f"select count(*) as n from a where {missing}",
        ),
    ]
    if kind == WORKSTATION:
        issues.append(
            (
                4,
                "Invalid Email Format",
                "low",
                "n || ' invalid email addresses'",
                "select count(*) as n from a where user_email is not null "
                f"and not regexp_matches(user_email, '{EMAIL}')",
            )
        )
    report = " union all ".join(
        f"select '{issue}' as issue, '{severity}' as severity, n, {details} as details "
        f"from ({count}) i{number} where n > 0"
        for number, issue, severity, details, count in issues
    )
    rate = (
        "case when shown > 0 then cast(marked as double) / shown * 100 else cast(0 as double) end"
    )
    kpis = (
        "shown as total_assets, shown - marked as active_assets, marked as replacement_assets, "
        f"{rate} as replacement_rate"
    )
    two_counts = (
        f"count(*) filter (where {found}) as shown, "
        f"count(*) filter (where {r.replaced()}) as marked"
    )
    statuses = (
        [
            ("warranty_expired", "warranty_status = 'Expired'"),
            ("warranty_expiring_soon", "warranty_status = 'Expiring Soon'"),
            ("warranty_active", "warranty_status = 'Active'"),
            ("warranty_unknown", "warranty_status = 'Unknown'"),
        ]
        if kind == WORKSTATION
        else []
    )
    ages = [
        ("age_new", "asset_age <= 1"),
        ("age_active", "asset_age > 1 and asset_age <= 3"),
        ("age_aging", "asset_age > 3 and asset_age <= 5"),
        ("age_old", "asset_age > 5"),
    ]
    conditional = ", ".join(
        f"count(*) filter (where {found} and {test}) as {name}" for name, test in statuses + ages
    )
    names = ", ".join(name for name, _ in statuses + ages)
    labels = " union all ".join(
        f"select '{label}' as age_category, count(*) filter (where {test}) as n from a"
        for label, (_, test) in zip(
            ["New (0-1 year)", "Active (1-3 years)", "Aging (3-5 years)", "Old (5+ years)"],
            ages,
            strict=True,
        )
    )
    bodies = {
        "export_all": f"select * from a where {r.selection()} and {found}",
        "export_replacement": f"select * from a where {r.selection()} and {r.replaced()}",
        "asset_age": "select asset_tag, serial_number, year_of_purchase, asset_age, "
        r"coalesce(regexp_full_match(year_of_purchase, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
        r"\s*'), false) as age_known from a",
        "age_category": f"select asset_tag, serial_number, asset_age, {AGE_CATEGORY} "
        "as age_category from a",
        "asset_details": "select * exclude (year_of_purchase) from a",
        "filter_domains": domain,
        "replacement_set": f"select asset_tag, serial_number, {model} from a "
        f"where {r.selection()} and {r.replaced()}",
        "search_all_fields": f"select asset_tag, serial_number, {model}, location from a "
        f"where {r.found(SEARCH)}",
        "duplicate_asset_tags": counts(r, "asset_tag") + " having count(*) > 1",
        "duplicate_asset_tags_detail": duplicates_detail(
            r, "asset_tag", ["asset_tag", "model", "serial_number", "user"]
        ),
        "duplicate_serials": counts(r, "serial_number") + " having count(*) > 1",
        "duplicate_serials_detail": duplicates_detail(
            r, "serial_number", ["serial_number", "model", "asset_tag", "user"]
        ),
        "missing_user": f"select count(*) as n from a where {missing}",
        "missing_user_detail": "select "
        f"{r.named(['asset_tag', 'model', 'serial_number', 'department'])} from a where {missing}",
        "quality_report": report,
        "summary_kpis": f"select {kpis} from (select {two_counts} from a "
        f"where {r.selection()}) k",
        "counters": f"select {kpis}, sum_age, mean_age, {names} from (select {two_counts}, "
        f"cast(coalesce(sum(asset_age) filter (where {found}), 0) as bigint) as sum_age, "
        f"avg(asset_age) filter (where {found} and asset_age > 0) as mean_age, "
        f"{conditional} from a where {r.selection()}) k",
        "role_counts": " union all ".join(
            f"select '{role}' as role, {role} as value, n from ({counts(r, role)}) c_{role}"
            for role in COUNTED_ROLES
        ),
        "type_counts": counts(r, "asset_kind"),
        "age_counts": labels,
        "age_summary": "select cast(coalesce(sum(asset_age), 0) as bigint) as sum_age, "
        "avg(asset_age) filter (where asset_age > 0) as mean_age, "
        "coalesce(sum(asset_age), 0) <> 0 as has_ages from a",
        "model_counts": counts(r, "model", "total_units"),
        "region_model_cube": f"select {r.region} as region, {model} as model, "
        f"cast(grouping({r.region}, {model}) as integer) as level, count(*) as n from a "
        f"where {r.region} is not null and {model} is not null "
        f"group by cube ({r.region}, {model})",
        "region_model_blocks": "select region, block, first_model, last_model, models, total, is_total from ("
        f"with cells as (select {r.region} as region, {model} as model, count(*) as n from a "
        f"where {r.region} is not null and {model} is not null group by all), "
        "totals as (select model, cast(sum(n) as bigint) as n, "
        "cast((row_number() over (order by model) - 1) // 10 as bigint) as block from cells group by model), "
        "ends as (select block, min(model) as first_model, max(model) as last_model from totals group by block), "
        "rows as (select c.region, c.model, c.n, block, false as is_total from cells c join totals using (model) "
        "union all select null, model, n, block, true from totals) "
        "select region, block, first_model, last_model, "
        "string_agg(concat(model, '=', n), '|' order by model) as models, cast(sum(n) as bigint) as total, is_total "
        "from rows join ends using (block) group by all) b",
        "model_share": f"select model, n, cast(n as double) / sum(n) over () * 100 as share "
        f"from ({counts(r, 'model')}) c",
        "top_departments": f"select * from ({counts(r, 'department')}) c "
        "order by n desc, department limit 10",
        "top_locations": f"select * from ({counts(r, 'location')}) c "
        "order by n desc, location limit 10",
    }
    for role, values in r.choices.items():
        bodies[f"filter_by_{filter_name(role)}"] = (
            f"select asset_tag, serial_number, {r.columns[role]} as {role} from a "
            f"where {member(r.columns[role], values)}"
        )
    if kind == WORKSTATION:
        bodies |= workstation_bodies(r)
    return {name: r.sql(body) for name, body in bodies.items()}


def workstation_bodies(r: RegisterSql) -> dict[str, str]:
    """What only workstation registers have."""
    invalid = f"user_email is not null and not regexp_matches(user_email, '{EMAIL}')"
    cells = ", ".join(
        f"cast(count(*) filter (where model = '{m}') as bigint) as \"{m}\"" for m in PIVOT_MODELS
    )
    present = "from a where place is not null and model is not null"
    statuses = " union all ".join(
        f"select '{s}' as warranty_status, count(*) filter (where warranty_status = '{s}') as n "
        "from a"
        for s in ["Expired", "Expiring Soon", "Active", "Unknown"]
    )
    named = "asset_tag, model, serial_number, days_to_expiry from a where"
    return {
        "export_files": f"select 'workstation_assets_20010615' as export, {named} {r.selection()} and {r.found(r.spec.search or "")} "
        f"union all select 'workstation_expired_20010615', {named} {r.selection()} and {r.replaced()} "
        f"union all select 'warranty_expired_20010615', {named} warranty_status = 'Expired'",
        "export_warranty": "select * from a where warranty_status = 'Expired'",
        "warranty_date": "select asset_tag, serial_number, warranty_expiry, "
        "warranty_expiry_date from a",
        "days_to_expiry": "select asset_tag, serial_number, warranty_expiry, days_to_expiry "
        "from a",
        "warranty_status": "select asset_tag, serial_number, days_to_expiry, warranty_status "
        "from a",
        "warranty_counts": statuses,
        "warranty_drilldown": "select warranty_status, model, serial_number, \"user\", "
        "department, location, warranty_expiry from a "
        "where warranty_status in ('Expired', 'Expiring Soon', 'Active')",
        "filter_multi": "select asset_tag, serial_number, model, department from a "
        "where model in ('Brand#1', 'Brand#2') and (department = 'BUILDING' or department is null)",
        "search_literal": "select asset_tag, serial_number, user_email from a "
        f"where {r.found(LITERAL, literal=True)}",
        "invalid_emails": f"select count(*) as n from a where {invalid}",
        "invalid_emails_detail": "select \"user\", user_email, asset_tag, model from a "
        f"where {invalid}",
        "region_model_pivot": f"select place as region, {cells}, count(*) as total, "
        f"false as is_total {present} group by place union all "
        f"select null, {cells}, count(*), true {present}",
    }


# -------------------------------------------------------------------------- grids


def style_values() -> str:
    """Header cells as rows (style, col, name)."""
    rows = [
        f"({style}, {col}, {quoted([name])})"
        for style, names in enumerate(HEADER_STYLES)
        for col, name in enumerate(names)
    ]
    return f"(values {', '.join(rows)}) s(style, col, name)"


GRID = f"""
with styles as (select * from {style_values()}),
placed as (
  select o_orderkey, o_orderkey // {ORDERS_PER_EXTRACT} as k,
    case when (o_orderkey // {ORDERS_PER_EXTRACT}) % 17 = 0 then -1
         else (o_orderkey // {ORDERS_PER_EXTRACT}) % 5 end as hp from orders),
extracts as (select distinct k, hp, k % {len(HEADER_STYLES)} as style from placed),
grid as (
  select k, hp + 1 + o_orderkey % {ORDERS_PER_EXTRACT} as pos, col,
    case when (o_orderkey + col) % 11 = 0 then '' when (o_orderkey + col) % 13 = 0 then 'N/A'
         else concat('v', o_orderkey, '_', col) end as value
  from placed join styles on style = k % {len(HEADER_STYLES)}
  union all
  select k, hp, col, name from extracts join styles using (style) where hp >= 0
  union all
  select k, p, 0, 'Register printout' from extracts, (values (0), (1), (2), (3)) t(p) where p < hp),
hits as (
  select k, pos from grid where pos < 15
    and regexp_matches(lower(value), '{"|".join(HEADER_KEYWORDS)}')
  group by k, pos having count(*) >= 3),
detected as (
  select e.k, coalesce(min(h.pos), 0) as header_row
  from extracts e left join hits h on e.k = h.k group by e.k),
manual as (select k, k % 27 as manual from extracts where k % 10 = 0),
overridden as (
  select d.k, case when manual between 0 and 20 then manual else header_row end as header_row,
    coalesce(manual between 0 and 20, false) as is_manual,
    coalesce(manual not between 0 and 20, false) as is_rejected
  from detected d left join manual m on d.k = m.k),
typed as (
  select g.k, g.col, case when g.value = '' then concat('Unnamed: ', g.col) else g.value end as raw
  from grid g join {{headers}} d on g.k = d.k and g.pos = d.header_row),
numbered as (
  select *, row_number() over (partition by k, raw order by col) - 1 as repeat from typed),
trimmed as (
  select k, col, trim(case when repeat = 0 then raw else concat(raw, '.', repeat) end) as name
  from numbered),
columns as (
  select k, col, name, cast(row_number() over (partition by k order by col) as integer) as ordinal,
    cast(count(*) over (partition by k) as integer) as total_columns
  from (select *, row_number() over (partition by k, name order by col) as nth from trimmed)
  where nth = 1),
normal as (select *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') as normalized from columns),
scores as (
  select k, {{workstation}} as workstation_score, {{mobile}} as mobile_score from normal group by k),
types as (
  select *, case when workstation_score > mobile_score then 'Workstation' else 'Mobile' end
    as asset_type from scores),
entries as (
  select k, normalized, min(col) as first_col, max(col) as col, arg_max(name, col) as name
  from normal group by k, normalized),
terms as (select * from (values {{terms}}) t(kind, role, rank, term)),
resolved as (
  select k, asset_type, role, name, col from (
    select e.k, asset_type, role, name, col,
      row_number() over (partition by e.k, role order by rank, first_col) as choice
    from entries e join types t on e.k = t.k
    join terms on kind = asset_type and contains(normalized, term)) where choice = 1),
cells as (
  select g.k, g.pos, c.name, g.col,
    case when g.value not in ({quoted(MISSING_MARKERS)}) then g.value end as value
  from grid g join {{headers}} d on g.k = d.k join columns c on g.k = c.k and g.col = c.col
  where g.pos > d.header_row),
canonical as (
  select c.k, c.pos, r.asset_type, {{roles}}
  from cells c join resolved r on c.k = r.k and c.col = r.col
  where c.k in (select k from resolved where role = 'model')
  group by c.k, c.pos, r.asset_type)
"""


def grid_sql() -> dict[str, str]:
    """Statements for header detection, promotion, roles and kinds."""

    def score(kind: str) -> str:
        return " + ".join(
            f"max(case when contains(normalized, '{i}') then 1 else 0 end)"
            for i in KIND_IDENTIFIERS[kind]
        )

    terms = ", ".join(
        f"('{kind}', '{role}', {rank}, '{term}')"
        for kind in (WORKSTATION, MOBILE)
        for role, names in role_terms(kind).items()
        for rank, term in enumerate(names)
    )
    roles = ", ".join(f"max(case when role = '{r}' then value end) as \"{r}\"" for r in ROLES)

    def base(headers: str) -> str:
        return GRID.format(
            workstation=score(WORKSTATION),
            mobile=score(MOBILE),
            terms=terms,
            roles=roles,
            headers=headers,
        )

    path = "concat('extract_', k) as path"
    role_names = ", ".join(f'"{r}"' for r in ROLES)
    bodies = {
        "header_row": f"select {path}, 'Assets' as sheet, header_row from detected",
        "header_override": f"select {path}, 'Assets' as sheet, header_row, is_manual, "
        "is_rejected from overridden",
        "promote_header": f"select {path}, 'Assets' as sheet, pos, name, value from cells",
        "clean_columns": f"select {path}, col, name from columns",
        "column_catalogue": f"select {path}, ordinal, name, total_columns from columns",
        "normalize_headers": f"select {path}, ordinal, name, normalized from normal",
        "resolve_roles": f"select {path}, asset_type, role, name, col from resolved",
        "asset_type": f"select {path}, workstation_score, mobile_score, asset_type from types",
        "missing_model_extracts": f"select concat('extract_', t.k) as path, asset_type, header_row "
        "from types t join detected d on t.k = d.k "
        "where t.k not in (select k from resolved where role = 'model')",
        "canonical_register": f"select {path}, pos, asset_type, {role_names} from canonical",
        "search_all_registers": f"select distinct {path.replace('k)', 'c.k)')}, c.pos, asset_type "
        "from cells c join types t on c.k = t.k "
        "where regexp_matches(value, '^V[0-9]*7_[12]$', 'i') "
        "and c.k in (select k from resolved where role = 'model')",
    }
    statements = {name: base("detected") + body for name, body in bodies.items()}
    statements["promote_override"] = base("overridden") + (
        "select concat('extract_', o.k) as path, cast(header_row as bigint) as header_row, "
        "cast(count(*) as integer) as total_columns "
        "from overridden o join columns c on o.k = c.k group by o.k, header_row"
    )
    statements["promote_override_rows"] = base("overridden") + (
        "select concat('extract_', k) as path, 'Assets' as sheet, pos, name, value from cells"
    )
    offered = ", ".join(
        f"('{kind}', '{role}')" for kind, names in SELECTABLE.items() for role in names
    )
    statements["filter_domains_in_order"] = base("detected") + (
        "select concat('extract_', p.k) as path, role, value, min(pos) as first_row from ("
        "select c.k, c.pos, r.role, c.value from cells c join resolved r on c.k = r.k and c.col = r.col "
        f"join (values {offered}) o(kind, role) on o.kind = r.asset_type and o.role = r.role "
        "where c.k in (select k from resolved where role = 'model')) p group by all"
    )
    return statements


# The patterns tried, in order, with what strptime calls them and how their text must look.
DATE_PATTERNS = [
    ("ISO", "%Y-%m-%d", r"\d{4}-\d{2}-\d{2}"),
    ("dd/MM/yyyy", "%d/%m/%Y", r"\d{2}/\d{2}/\d{4}"),
    ("MM/dd/yyyy", "%m/%d/%Y", r"\d{2}/\d{2}/\d{4}"),
    ("dd.MM.yyyy", "%d.%m.%Y", r"\d{2}\.\d{2}\.\d{4}"),
    ("dd MMM yyyy", "%d %b %Y", r"\d{2} [A-Z][a-z]{2} \d{4}"),
]
DATED = f"""
with dated as (
  select concat('register_', o_custkey % 200) as path, o_orderkey as pos,
    case when o_orderkey % 19 = 0 then null when o_orderkey % 23 = 0 then 'unknown'
         when o_orderkey % 29 = 0 then strftime(o_orderdate, '%Y-%m-%d')
         else case o_custkey % 200 % 5 when 0 then strftime(o_orderdate, '%Y-%m-%d')
           when 1 then strftime(o_orderdate, '%d/%m/%Y') when 2 then strftime(o_orderdate, '%m/%d/%Y')
           when 3 then strftime(o_orderdate, '%d %b %Y') else strftime(o_orderdate, '%d.%m.%Y') end end as value
  from orders),
tried as (
  {" union all ".join(
      f"select path, pos, value, {i} as place, '{n}' as name, "
      f"case when regexp_full_match(value, '{p}') then try_strptime(value, '{f}') end as date from dated"
      for i, (n, f, p) in enumerate(DATE_PATTERNS)
  )}),
firsts as (select path, min(pos) as pos from dated where value is not null group by path),
scores as (
  select t.path, place, name, count(date) as n_read, count(value) as n_values,
    count(date) filter (where t.pos = f.pos) as first
  from tried t left join firsts f on t.path = f.path group by t.path, place, name),
elected as (
  select path, case when n_read > 0 then name end as date_format, n_values, n_read from (
    select *, row_number() over (partition by path order by first desc, n_read desc, place) as choice from scores)
  where choice = 1)
"""


def dated_sql() -> dict[str, str]:
    """Statements for the election of date formats."""
    return {
        "date_formats": DATED + "select * from elected",
        "warranty_date_formats": DATED + "select d.path, d.pos, d.value, e.date_format, t.date as warranty_expiry_date "
        "from dated d join elected e on d.path = e.path "
        "left join tried t on t.path = d.path and t.pos = d.pos and t.name = e.date_format",
    }


DELIMITED = """
select c_custkey,
  case c_custkey % 4 when 0 then concat('said "', c_mktsegment, '"', chr(10), chr(10), 'and, left')
    when 1 then concat(c_mktsegment, chr(10)) else c_mktsegment end as note,
  case when c_custkey % 5 <> 0 then c_name end as name,
  case when c_custkey % 3 = 0 then '6" rack' end as place,
  cast(case when c_custkey % 3 = 0 then 4 when c_custkey % 5 <> 0 then 3 else 2 end as integer) as width
from customer"""


# ----------------------------------------------------------------------- workbooks

WORKBOOKS = """
with files as (
  select c_custkey as k, concat('wb_', c_custkey, '.xlsx') as path, c_custkey % 10 <> 9 as accepted,
    c_name, c_mktsegment, c_nationkey,
    strftime(date '2000-01-01' + cast(c_custkey % 1000 as integer), '%Y-%m-%d 00:00:00') as expiry
  from customer),
good as (select * from files where accepted)
"""


def workbook_sql() -> dict[str, str]:
    """Statements for triage, sheet list and grid."""
    bodies = {
        "workbook_triage": "select path, accepted from files",
        "upload_triage": "select concat('f', k % 16, '/', path) as path, k % 25 = 0 as is_empty, "
        "accepted and k % 25 <> 0 as accepted from files",
        "sheet_list": "select path, 0 as sheet_no, 'Assets' as sheet from good union all "
        "select path, 1, 'Notes' from good where k % 3 = 0",
        "workbook_grid": "select path, 'Assets' as sheet, cast(0 as bigint) as pos, 1 as width, "
        "'Asset register' as cells from good "
        "union all select path, 'Assets', 1, 0, '' from good "
        f"union all select path, 'Assets', 2, {len(WORKBOOK_HEADERS)}, "
        f"'{'|'.join(WORKBOOK_HEADERS)}' from good "
        "union all select path, 'Assets', 3, 4, "
        "concat('AT', k, '|', c_mktsegment, '|', c_name, '|', expiry) from good "
        "union all select path, 'Notes', 0, 3, "
        "concat('-|', k, '|', case when c_nationkey % 2 = 0 then 'True' else 'False' end) "
        "from good where k % 3 = 0",
        "workbook_register": "select path, 'Assets' as sheet, cast(3 as bigint) as pos, "
        "'Workstation' as asset_type, concat('AT', k) as asset_tag, c_mktsegment as model, "
        "c_name as \"user\", expiry as warranty_expiry from good",
    }
    return {name: WORKBOOKS + body for name, body in bodies.items()}


def all_sql() -> dict[str, str]:
    """Every statement by query name."""
    statements = workbook_sql() | grid_sql() | dated_sql() | register_sql(WORKSTATION)
    statements["delimited_records"] = DELIMITED
    for name, sql in register_sql(MOBILE).items():
        statements[mobile_name(name)] = sql
    return statements

"""Registered queries: billing cleaning and chart pivots (CLN-*, GRP-1, AGG-1..3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from costlens.operators import clean as C
from costlens.operators import pivots as P
from costlens.functions import davg, dsum
from costlens.plans.registry import d_, davg_, dsum_, query
from costlens.session import scratch_folder
from costlens.sources import billing as B
from costlens.sources.fixtures import Tables

# "First" row of a group follows the report's line order (D1).
AWS_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

# Pivot values of the fixture data: the service names and the locations that
# the fixture mapping can produce (NATION_3 is mapped to null).
AWS_SERVICES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
GCP_SERVICES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
AWS_LOCATIONS = [f"NATION_{i}" for i in range(25) if i != 3]


def aws_clean(t: Tables):
    return C.clean_aws(t.cost_aws_raw, order=AWS_ORDER)


def gcp_clean(t: Tables):
    return C.clean_gcp(t.cost_gcp_raw)


def _first(col: str) -> str:
    return (
        f"first({col} order by l_orderkey, l_linenumber, l_partkey, l_suppkey) "
        f"filter (where {col} is not null) as {col}"
    )


# Oracle text of the AWS clean table (CLN-12), reused by later queries.
CLEAN_AWS_SQL = f"""
select 'aws' as provider, date, product_servicecode as service, line_item_product_code as product_code,
       product_region_code as region, product_location as location,
       line_item_blended_cost - (discount_bundled_discount + discount_total_discount) as cost
from (
  select date, line_item_product_code, product_region_code,
         {_first('product_servicecode')}, {_first('product_location')},
         {_first('line_item_blended_cost')}, {_first('discount_bundled_discount')},
         {_first('discount_total_discount')}
  from (
    select cast(split_part(identity_time_interval, 'T', 1) as date) as date,
           line_item_product_code, product_region_code, product_servicecode, product_location,
           coalesce(line_item_blended_cost, 0.0) as line_item_blended_cost,
           coalesce(discount_bundled_discount, 0.0) as discount_bundled_discount,
           coalesce(discount_total_discount, 0.0) as discount_total_discount,
           l_orderkey, l_linenumber, l_partkey, l_suppkey
    from cost_aws_raw
  ) f
  where date is not null and line_item_product_code is not null and product_region_code is not null
  group by date, line_item_product_code, product_region_code
) g
where line_item_blended_cost - (discount_bundled_discount + discount_total_discount) <> 0
"""

_NUM = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _num(col: str) -> str:
    return f"case when regexp_matches({col}, '{_NUM}') then try_cast(trim({col}) as double) end"


CLEAN_GCP_SQL = f"""
select 'gcp' as provider, cast("Date" as date) as date, "Service description" as service,
       "Service description" as product_code, cast(null as varchar) as region,
       cast(null as varchar) as location, "Cost" as cost
from (
  select distinct "Date", "Service description",
         {_num('"Cost (€)"')} - ({_num('"Discounts (€)"')} + {_num('"Promotions and others (€)"')}) as "Cost"
  from cost_gcp_raw
) d
"""


@query(
    "cln12_clean_aws",
    "CLN-1 CLN-2 CLN-3 CLN-4 CLN-5 CLN-6 CLN-11 CLN-12",
    ["cost_aws_raw"],
    f"select provider, {d_('date')} as date, service, product_code, region, location, cost "
    f"from ({CLEAN_AWS_SQL})",
)
def cln12_clean_aws(spark, sf_dir):
    """Whole AWS clean pipeline over the billing fixture."""
    return aws_clean(Tables(spark, sf_dir))


# CLEAN_AWS_SQL with the amounts of a group added up (D2).
CLEAN_AWS_SUM_SQL = CLEAN_AWS_SQL
for _c in ("line_item_blended_cost", "discount_bundled_discount", "discount_total_discount"):
    CLEAN_AWS_SUM_SQL = CLEAN_AWS_SUM_SQL.replace(_first(_c), f"{dsum_(_c)} as {_c}")


@query(
    "cln12_clean_aws_sum",
    "CLN-4 CLN-12",
    ["cost_aws_raw"],
    f"select provider, {d_('date')} as date, service, product_code, region, location, round(cost, 6) as cost "
    f"from ({CLEAN_AWS_SUM_SQL})",
)
def cln12_clean_aws_sum(spark, sf_dir):
    """The AWS clean pipeline with the amounts of a group added up."""
    clean = C.clean_aws(Tables(spark, sf_dir).cost_aws_raw, order=AWS_ORDER, agg="sum")
    return clean.withColumn("cost", F.round("cost", 6))


def _by_snapshots(spark, sf_dir, agg: str):
    """Two snapshots of the report, kept as two runs' states, merged; the second run is repeated."""
    raw = Tables(spark, sf_dir).cost_aws_raw
    table = scratch_folder(spark, "states")
    odd = F.col("l_orderkey") % 2 == 1
    for run, lines in (("2024-01", odd), ("2024-02", ~odd), ("2024-02", ~odd)):
        B.add_state(C.aws_state(raw.where(lines), AWS_ORDER, agg), table, run)
    return C.clean_aws_state(B.read_states(spark, table))


@query(
    "cln4_merged_states",
    "CLN-4 CLN-12 SNK-1",
    ["cost_aws_raw"],
    f"select provider, {d_('date')} as date, service, product_code, region, location, cost "
    f"from ({CLEAN_AWS_SQL})",
)
def cln4_merged_states(spark, sf_dir):
    """First value per group from the kept states of two snapshots, equal to one pass over both."""
    return _by_snapshots(spark, sf_dir, "first")


@query(
    "cln4_merged_states_sum",
    "CLN-4 CLN-12 SNK-1",
    ["cost_aws_raw"],
    f"select provider, {d_('date')} as date, service, product_code, region, location, round(cost, 6) as cost "
    f"from ({CLEAN_AWS_SUM_SQL})",
)
def cln4_merged_states_sum(spark, sf_dir):
    """Amounts added up from the kept states of two snapshots, equal to one pass over both."""
    return _by_snapshots(spark, sf_dir, "sum").withColumn("cost", F.round("cost", 6))


@query(
    "cln13_clean_gcp",
    "CLN-1 CLN-7 CLN-8 CLN-9 CLN-11 CLN-13",
    ["cost_gcp_raw"],
    f"select provider, {d_('date')} as date, service, product_code, region, location, cost "
    f"from ({CLEAN_GCP_SQL})",
)
def cln13_clean_gcp(spark, sf_dir):
    """Whole GCP clean pipeline: tolerant parse, net cost, distinct."""
    return gcp_clean(Tables(spark, sf_dir))


@query(
    "cln7_to_number",
    "CLN-7",
    ["cost_gcp_raw"],
    f"""select "Cost (€)" as text, {_num('"Cost (€)"')} as value, count(*) as n
        from cost_gcp_raw group by all""",
)
def cln7_to_number(spark, sf_dir):
    """Tolerant text -> number over every distinct cost text of the GCP report."""
    from costlens.functions import to_number

    raw = Tables(spark, sf_dir).cost_gcp_raw
    return raw.groupBy(F.col("`Cost (€)`").alias("text")).agg(F.count(F.lit(1)).alias("n")).select(
        "text", to_number("text").alias("value"), "n"
    )


@query(
    "grp1_per_service",
    "GRP-1",
    ["cost_aws_raw", "cost_gcp_raw"],
    f"""select provider, service, count(*) as rows, {dsum_('cost')} as cost
        from ({CLEAN_AWS_SQL} union all {CLEAN_GCP_SQL}) c group by provider, service""",
)
def grp1_per_service(spark, sf_dir):
    """All services of both providers processed in one grouped job."""
    t = Tables(spark, sf_dir)
    return P.per_service(aws_clean(t).unionByName(gcp_clean(t)), ["provider", "service"])


def _pivot_sql(source: str, row: str, col: str, values: list[str], row_fmt=None) -> str:
    cells = ", ".join(
        f"{dsum_(f'case when {col} = ' + repr(v) + ' then coalesce(cost, 0.0) end')} as \"{v}\"" for v in values
    )
    r = row_fmt(row) if row_fmt else row
    return (
        f"select {r} as {row}, {cells} from ({source}) s "
        f"where {row} is not null and {col} is not null group by {row}"
    )


@query(
    "agg1_cost_by_date_service",
    "AGG-1",
    ["cost_aws_raw"],
    _pivot_sql(CLEAN_AWS_SQL, "date", "product_code", AWS_SERVICES, d_),
)
def agg1_cost_by_date_service(spark, sf_dir):
    """AWS cost by date x product code (wide)."""
    return P.cost_by_date_service(aws_clean(Tables(spark, sf_dir)), AWS_SERVICES)


@query(
    "agg2_cost_by_service_location",
    "AGG-2",
    ["cost_aws_raw"],
    _pivot_sql(CLEAN_AWS_SQL, "product_code", "location", AWS_LOCATIONS),
)
def agg2_cost_by_service_location(spark, sf_dir):
    """AWS cost by product code x location (wide)."""
    return P.cost_by_service_location(aws_clean(Tables(spark, sf_dir)), AWS_LOCATIONS)


@query(
    "agg3_cost_by_date_service_gcp",
    "AGG-3",
    ["cost_gcp_raw"],
    _pivot_sql(CLEAN_GCP_SQL, "date", "service", GCP_SERVICES, d_),
)
def agg3_cost_by_date_service_gcp(spark, sf_dir):
    """GCP cost by date x service (wide)."""
    return P.cost_by_date_service_gcp(gcp_clean(Tables(spark, sf_dir)), GCP_SERVICES)


@query(
    "grp1_small_and_large_sums",
    "GRP-1",
    [],
    f"""select l_returnflag as service, {dsum_('l_tax * 0.000005')} as small, {dsum_('l_extendedprice * 1e8')} as large,
               {davg_('l_tax * 0.000005')} as small_avg from lineitem group by l_returnflag""",
)
def grp1_small_and_large_sums(spark, sf_dir):
    """Exact sums of amounts around 4e-7 and around 5e12 (rounded to 10 decimals each)."""
    t = Tables(spark, sf_dir).lineitem
    g = t.groupBy(F.col("l_returnflag").alias("service")).agg(
        dsum(F.col("l_tax") * 0.000005).alias("small"),
        dsum(F.col("l_extendedprice") * 1e8).alias("large"),
        davg(F.col("l_tax") * 0.000005).alias("small_avg"),
    )
    return g

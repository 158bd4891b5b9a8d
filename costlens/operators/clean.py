"""Billing-report cleaning.

AWS: prune -> fill numeric nulls -> date from interval -> first non-null value
per (date, product code, region) -> net cost -> drop zero cost.
GCP: prune -> tolerant numeric parse -> net cost -> distinct.

Both produce the engine table
`cost_clean(provider, date, service, product_code, region, location, cost)`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens.functions import canonical_service, dsum, exact, finite, interval_date, to_number

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

# Columns of the AWS report the pipeline keeps (everything else is pruned).
AWS_KEEP = [
    "identity_time_interval",
    "line_item_product_code",
    "product_region_code",
    "product_servicecode",
    "product_location",
    "product_to_location",
    "product_to_region_code",
    "line_item_blended_cost",
    "discount_bundled_discount",
    "discount_total_discount",
]
AWS_KEYS = ["date", "line_item_product_code", "product_region_code"]

GCP_KEEP = ["Date", "Service description", "Cost (€)", "Discounts (€)", "Promotions and others (€)"]

CLEAN_COLUMNS = ["provider", "date", "service", "product_code", "region", "location", "cost"]


def row_id() -> Column:
    """A row's number in `cost_clean`: the clean AWS table has one row per (date, product code, region), the clean
    GCP table is distinct on (date, service, cost)."""
    return F.xxhash64("provider", "date", "service", "product_code", "region", "cost")


def prune_columns(df: DataFrame, keep: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """CLN-1: keep only the named columns.  A missing required name fails loudly;
    names in `optional` are kept when present."""
    present = set(df.columns)
    cols = [c for c in keep if c in present or c not in optional]
    return df.select(*[F.col(f"`{c}`") for c in cols])


def fill_numeric(df: DataFrame, value: float = 0.0) -> DataFrame:
    """CLN-2: null -> 0.0 in every numeric column."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]
    return df.fillna(value, subset=num) if num else df


def first_per_group(
    df: DataFrame, keys: Sequence[str], order: Column | Sequence[str], agg: str = "first"
) -> DataFrame:
    """CLN-4: per group, the first non-null value of *each column independently*.

    "First" is by `order` (D1).  With `agg="sum"` numeric columns are added up
    instead (D2).  Rows with a null key are dropped (pandas `groupby` default).
    One aggregate with partial (map-side) combine: per column
    `min_by(value, order)` over the rows where the value is not null; text
    buffers make it a sort aggregate, but a key's rows meet as one partial row
    per task, so key skew does no harm.
    """
    if agg not in ("first", "sum"):
        raise ValueError("agg must be 'first' or 'sum'")
    if not isinstance(order, Column):
        order = F.struct(*[F.col(c) for c in order])
    others = [c for c in df.columns if c not in keys]
    not_null_keys = None
    for k in keys:
        cond = F.col(k).isNotNull()
        not_null_keys = cond if not_null_keys is None else not_null_keys & cond
    d = df.filter(not_null_keys).withColumn("__ord", order)
    summed = {f.name for f in df.schema.fields if agg == "sum" and isinstance(f.dataType, NUMERIC_TYPES)}
    aggs = [
        dsum(c).alias(c) if c in summed else F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__ord"))).alias(c)
        for c in others
    ]
    return d.groupBy(*keys).agg(*aggs)


def group_state(
    df: DataFrame, keys: Sequence[str], order: Column | Sequence[str], agg: str = "first"
) -> DataFrame:
    """CLN-4 as a state that can be kept: per group, what `first_per_group` needs of the rows seen so far.

    A column's state is its first non-null value with that value's order key
    (null: none yet), or with `agg="sum"` and a number its exact total, how many
    finite values it has, and whether all of them and the total are in range.
    States of parts of a table are put together by `merge_states`; `finish_state`
    gives the values.
    """
    if agg not in ("first", "sum"):
        raise ValueError("agg must be 'first' or 'sum'")
    if not isinstance(order, Column):
        order = F.struct(*[F.col(c) for c in order])
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = []
    for c in (c for c in df.columns if c not in keys):
        if agg == "sum" and isinstance(types[c], NUMERIC_TYPES):
            total, n = F.try_sum(exact(c)), F.count(finite(c))
            fits = (F.count(exact(c)) == n) & (total.isNotNull() | (n == 0))
            aggs.append(F.struct(total.alias("total"), n.alias("n"), fits.alias("fits")).alias(c))
        else:
            seen = F.col(c).isNotNull()
            kept = F.struct(F.col("__ord").alias("place"), F.col(c).alias("value"))
            aggs.append(F.min_by(F.when(seen, kept), F.when(seen, F.col("__ord"))).alias(c))
    return df.dropna(subset=list(keys)).withColumn("__ord", order).groupBy(*keys).agg(*aggs)


def merge_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One state per group of any number of them (the rows of several `group_state` tables), combined map-side.

    A total is null if it is out of range; two first values of one order key
    are taken as the same line, and either stays."""
    aggs = []
    for f in (f for f in states.schema.fields if f.name not in keys):
        s = F.col(f.name)
        if "total" in f.dataType.fieldNames():
            total, n = F.try_sum(s["total"]), F.sum(s["n"])
            fits = F.bool_and(s["fits"]) & (total.isNotNull() | (n == 0))
            aggs.append(F.struct(total.alias("total"), n.alias("n"), fits.alias("fits")).alias(f.name))
        else:
            aggs.append(F.min_by(s, s["place"]).alias(f.name))
    return states.groupBy(*keys).agg(*aggs)


def finish_state(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The values of a state: the rows that `first_per_group` gives for all the lines that went into it."""
    cols = []
    for f in (f for f in state.schema.fields if f.name not in keys):
        s = F.col(f.name)
        if "total" in f.dataType.fieldNames():
            cols.append(F.when(s["fits"], s["total"].cast("double")).alias(f.name))
        else:
            cols.append(s["value"].alias(f.name))
    return state.select(*keys, *cols)


def net_cost_aws(df: DataFrame) -> DataFrame:
    """CLN-5: cost = blended − (bundled discount + total discount)."""
    return df.withColumn(
        "cost",
        F.col("line_item_blended_cost") - (F.col("discount_bundled_discount") + F.col("discount_total_discount")),
    ).drop("line_item_blended_cost", "discount_bundled_discount", "discount_total_discount")


def drop_zero_cost(df: DataFrame) -> DataFrame:
    """CLN-6: keep rows whose cost is not 0 (nulls were filled before, D3)."""
    return df.filter(F.col("cost") != 0)


def net_cost_gcp(df: DataFrame) -> DataFrame:
    """CLN-7 + CLN-8: tolerant parse of the three text amounts, then
    cost = cost − (discounts + promotions); null when any part is null."""
    cost = to_number(F.col("`Cost (€)`"))
    disc = to_number(F.col("`Discounts (€)`"))
    promo = to_number(F.col("`Promotions and others (€)`"))
    return df.withColumn("Cost", cost - (disc + promo)).drop(
        "Cost (€)", "Discounts (€)", "Promotions and others (€)"
    )


def distinct_rows(df: DataFrame) -> DataFrame:
    """CLN-9: drop duplicate rows."""
    return df.distinct()


def order_by_date(df: DataFrame, col: str = "date") -> DataFrame:
    """CLN-10: the reference sorts the clean file by date.  A global sort is a
    range shuffle; for files we only sort within partitions (`write_clean`
    does that) and keep this for display."""
    return df.orderBy(col)


def parse_date(c) -> Column:
    """CLN-11: date text -> date; null if it isn't one."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("date")


FILE_ORDER = "__file_order"


def file_order(raw: DataFrame) -> tuple[DataFrame, list[str]]:
    """`raw` with a column that orders its rows by file path, block of the file and place in it.

    Spark deals files out to partitions by size, so a row's partition doesn't
    tell its file.  A table that already has the column (the by-name readers
    add it) keeps it; one that isn't a plain read of files is ordered by its
    partitions."""
    if FILE_ORDER in raw.columns:
        return raw, [FILE_ORDER]
    try:
        meta = [raw["_metadata.file_path"], raw["_metadata.file_block_start"]]
    except AnalysisException:
        meta = []
    place = F.struct(*meta, F.monotonically_increasing_id().alias("id"))
    return raw.withColumn(FILE_ORDER, place), [FILE_ORDER]


def _aws_lines(raw: DataFrame, order: Sequence[str] | Column | None, periods: list[str]) -> DataFrame:
    """CLN-1, CLN-2, CLN-3: the lines of the report with their date and, as `__order`, their place."""
    if order is None:
        raw, order = file_order(raw)
    order_cols = [] if isinstance(order, Column) else list(order)
    keep = periods + AWS_KEEP + [c for c in order_cols if c not in AWS_KEEP]
    df = prune_columns(raw, keep, optional=["product_to_location", "product_to_region_code"])
    df = fill_numeric(df)
    df = df.withColumn("date", interval_date("identity_time_interval")).drop("identity_time_interval")
    ord_col = order if isinstance(order, Column) else F.struct(*[F.col(c) for c in order_cols])
    return df.withColumn("__order", ord_col).drop(*order_cols)


def _aws_costs(groups: DataFrame, periods: list[str]) -> DataFrame:
    """CLN-5, CLN-6: one row per group -> `cost_clean` rows."""
    return drop_zero_cost(net_cost_aws(groups)).select(
        F.lit("aws").alias("provider"),
        "date",
        canonical_service("product_servicecode").alias("service"),
        F.col("line_item_product_code").alias("product_code"),
        F.col("product_region_code").alias("region"),
        F.col("product_location").alias("location"),
        "cost",
        *periods,
    )


def clean_aws(
    raw: DataFrame, order: Sequence[str] | Column | None = None, agg: str = "first", period: str | None = None
) -> DataFrame:
    """CLN-12: the whole AWS pipeline -> `cost_clean` rows with provider 'aws'.

    `agg`: "first" amount of a group, or the "sum" of its amounts (D2).
    `period`: a column of the raw table (the billing period) that is kept;
    groups are then within a period.

    `order` defines "first" inside a group (D1): columns of the raw table, or
    by default the order of the lines in the files, by path (`file_order`).
    Rows whose date is malformed belong to no group, as those with a null key.
    """
    periods = [] if period is None else [period]
    lines = _aws_lines(raw, order, periods)
    return _aws_costs(first_per_group(lines, periods + AWS_KEYS, F.col("__order"), agg).drop("__order"), periods)


def aws_state(raw: DataFrame, order: Sequence[str] | Column | None = None, agg: str = "first") -> DataFrame:
    """CLN-4 of one snapshot of the AWS report, as a state (`group_state`) per date, product code and region.

    `order` must place the lines of all snapshots: columns of the report, or
    by default file path and place, which suits snapshots of different files."""
    lines = _aws_lines(raw, order, [])
    return group_state(lines, AWS_KEYS, F.col("__order"), agg).drop("__order")


def clean_aws_state(states: DataFrame) -> DataFrame:
    """CLN-12 from the states of any number of snapshots: what `clean_aws` gives for all their lines at once."""
    return _aws_costs(finish_state(merge_states(states, AWS_KEYS), AWS_KEYS), [])


def clean_gcp(raw: DataFrame) -> DataFrame:
    """CLN-13: the whole GCP pipeline -> `cost_clean` rows with provider 'gcp'.

    Subtotal columns are pruned, costs parsed and netted, then exact duplicate
    rows removed (after the cost columns are gone, as in the reference).
    """
    df = prune_columns(raw, GCP_KEEP)
    df = distinct_rows(net_cost_gcp(df))
    return df.select(
        F.lit("gcp").alias("provider"),
        parse_date("Date").alias("date"),
        canonical_service("`Service description`").alias("service"),
        F.col("`Service description`").alias("product_code"),
        F.lit(None).cast("string").alias("region"),
        F.lit(None).cast("string").alias("location"),
        F.col("Cost").alias("cost"),
    )


def cost_clean(aws_raw: DataFrame | None, gcp_raw: DataFrame | None, aws_order=None) -> DataFrame:
    """Both providers in one long table."""
    parts = []
    if aws_raw is not None:
        parts.append(clean_aws(aws_raw, aws_order))
    if gcp_raw is not None:
        parts.append(clean_gcp(gcp_raw))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

"""The queries of the data problems, with the parameters they run with in production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import instants, multivalue, orphans, profiling, rowcheck, shredding
from tallyforge.session import table


def _orphan_orders(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(
        table(spark, d, "orders_qa"), table(spark, d, "customers_qa"), table(spark, d, "customer_deletes"),
        ref_id="row_id", ref_key="cust_id", ref_time="createdAtTimestamp", parent_key="cust_id", parent_time="loaded_at", deletion_key="cust_id", deletion_time="deleted_at",
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphan_orders(spark, d).select("row_id", "kind")


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(_orphan_orders(spark, d), table="orders_qa", time="createdAtTimestamp")


def _instants(operator):
    """Of the four time fields, each with the unit it is cut down to."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        feeds = table(spark, d, "feeds")
        customers = {"createdAtTimestamp": 1, "timestamp_micro": 1, "timestamp_millis": 1000}
        return operator(table(spark, d, "customers_qa"), feeds, row_id="row_id", feed_id="feed_id", fields=customers, source="customers_qa").unionByName(
            operator(table(spark, d, "users"), feeds, row_id="row_id", feed_id="feed_id", fields={"reg_date": 1}, source="users")
        )

    return run


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    campaigns = shredding.shred_viewport(table(spark, d, "viewport_event"), "campaigns")
    return campaigns.where("assetId <> ''").select("row_id", "event_pos", "element_pos", F.col("assetId").alias("asset_id"))


def _shredded(which: str):
    return lambda spark, d: shredding.shred_viewport(table(spark, d, "viewport_event"), which)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    lines = rowcheck.failing_lines(table(spark, d, "raw_lines"), [rowcheck.CUSTOMER_ROW, rowcheck.USER_ROW])
    parts = [lines.select(F.lit("raw_lines").alias("source_table"), "row_id", "reason")]
    for schema in (rowcheck.CUSTOMER_ROW, rowcheck.USER_ROW):
        bad = rowcheck.failing_values(table(spark, d, schema.name), schema)
        parts.append(bad.select(F.lit(schema.name).alias("source_table"), "row_id", F.lit("value").alias("reason")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p4_broken_fields(spark: SparkSession, d: str) -> DataFrame:
    return rowcheck.failing_lines(table(spark, d, "raw_lines"), [rowcheck.CUSTOMER_ROW, rowcheck.USER_ROW])


def p4_loaded_customers(spark: SparkSession, d: str) -> DataFrame:
    return rowcheck.valid_lines(table(spark, d, "raw_lines"), rowcheck.CUSTOMER_ROW)


def p4_loaded_users(spark: SparkSession, d: str) -> DataFrame:
    return rowcheck.valid_lines(table(spark, d, "raw_lines"), rowcheck.USER_ROW)


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customers_qa")
    return profiling.load_profile(customers, profiling.CUSTOMER_RULES, columns=customers.columns)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return profiling.departing_loads(profiling.load_profile(table(spark, d, "customers_qa"), profiling.CUSTOMER_RULES))


def _masks(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customers_qa")
    return profiling.mask_profile(customers, [c for c in customers.columns if c not in ("row_id", "load_id")])


def p5_masks(spark: SparkSession, d: str) -> DataFrame:
    return _masks(spark, d).select("load_id", "column_name", "mask", "rows", "distinct_values")


def p5_mask_ranges(spark: SparkSession, d: str) -> DataFrame:
    return _masks(spark, d)


def p5_rare_patterns(spark: SparkSession, d: str) -> DataFrame:
    return profiling.rare_patterns(_masks(spark, d)).drop("pattern")


def p5_divergence(spark: SparkSession, d: str) -> DataFrame:
    return profiling.mask_divergence(_masks(spark, d)).withColumns({c: F.round(c, 6) for c in ("divergence", "from_previous")})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [multivalue.split_values(table(spark, d, t), [c], source=t, least=2) for t, c in (("customers_qa", "phoneType"), ("users", "interests"))]
    return parts[0].unionByName(parts[1]).drop("column_name")


QUERIES = {
    "p1_found": p1_found,
    "p1_counts": p1_counts,
    "p2_found": _instants(instants.normalise_instants),
    "p2_unreadable": _instants(instants.unreadable_instants),
    "p3_found": p3_found,
    "p3_events": _shredded("events"),
    "p3_elements": _shredded("elements"),
    "p3_campaigns": _shredded("campaigns"),
    "p3_unreadable": lambda spark, d: shredding.unreadable_payloads(table(spark, d, "viewport_event")),
    "p4_found": p4_found,
    "p4_broken_fields": p4_broken_fields,
    "p4_loaded_customers": p4_loaded_customers,
    "p4_loaded_users": p4_loaded_users,
    "p5_found": p5_found,
    "p5_profile": p5_profile,
    "p5_masks": p5_masks,
    "p5_mask_ranges": p5_mask_ranges,
    "p5_rare_patterns": p5_rare_patterns,
    "p5_divergence": p5_divergence,
    "p6_found": p6_found,
}

"""Queries on catalogs, manifests and rules over the star tables, pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import AXIS_SCALE, DICE_GATE, absent
from ..operators import records as R
from ..operators import taxonomy
from ..operators.registration import select_candidate
from ..sources import archives
from .registry import query, read

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


# Orders and customers


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 250000")
def scan_project(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").where("o_totalprice > 250000").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F'")
def filter_in(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderstatus") == "F")).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r <= 5")
def limit_per_group(spark: SparkSession, d: str) -> DataFrame:
    return R.first_per_group(read(spark, d, "orders"), 5, ["o_orderstatus"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderstatus", "o_orderkey")


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_required(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return R.required(read(spark, d, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"]).select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, coalesce(n, 0) AS orders, coalesce(s, '') AS last_status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderstatus) AS s FROM orders WHERE o_totalprice > 400000 GROUP BY 1) ON o_custkey = c_custkey")
def left_join_default(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").where("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderstatus").alias("s"))
    return read(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), F.coalesce("s", F.lit("")).alias("last_status"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000)")
def semi_join_cohort(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, d, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')")
def anti_join_missing(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").where("o_orderdate >= timestamp_ntz'1998-01-01 00:00:00'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("SELECT c_custkey, c_name, count(o_orderkey) AS lesion_count_total, coalesce(max(o_orderpriority), 'none') AS worst FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1, 2")
def merge_update(spark: SparkSession, d: str) -> DataFrame:
    """The manifest with the columns that a later stage adds; the stage has a row for every case, or the merge raises."""
    manifest = read(spark, d, "customer").select("c_custkey", "c_name")
    found = read(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderpriority").alias("w"))
    updates = manifest.select("c_custkey").join(found, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("lesion_count_total"), F.coalesce("w", F.lit("none")).alias("worst"))
    return R.merged(manifest, updates, ["c_custkey"]).select("c_custkey", "c_name", "lesion_count_total", "worst")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '1-URGENT' OR o_orderstatus = 'P' AND o_totalprice > 400000 THEN 'failed' WHEN o_orderstatus <> 'P' THEN 'complete' END AS status FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus <> 'P' OR o_totalprice > 400000")
def upsert_precedence(spark: SparkSession, d: str) -> DataFrame:
    """Complete records on disk, overridden by this run's failures, which may also be new."""
    o, failed = read(spark, d, "orders"), (F.col("o_orderpriority") == "1-URGENT") | ((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400000))
    of = lambda where, status: o.where(where).select(F.col("o_orderkey").alias("k"), F.lit(status).alias("status"))
    return R.upsert(of(F.col("o_orderstatus") != "P", "complete"), of(failed, "failed"), ["k"])


@query("SELECT o_orderkey, c_name AS customer, n_name AS nation, r_name AS region, round(o_totalprice / 1000, 6) AS price_k FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def flatten_nested(spark: SparkSession, d: str) -> DataFrame:
    """A nested record for each order, flattened to the manifest's columns."""
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nested = (
        read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", F.struct(F.col("c_name").alias("name"), F.struct(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).alias("place")).alias("customer"), F.col("o_totalprice").alias("price"))
    )
    return nested.select("o_orderkey", F.col("customer.name").alias("customer"), "customer.place.nation", "customer.place.region", F.round(F.col("price") / 1000, 6).alias("price_k"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 250000) AS large FROM orders GROUP BY 1, 2")
def count_by_key(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 250000).alias("large"))


@query("SELECT c_mktsegment, c_custkey::VARCHAR AS patient, row_number() OVER (ORDER BY c_mktsegment, c_custkey::VARCHAR) AS place FROM customer")
def multi_key_sort(spark: SparkSession, d: str) -> DataFrame:
    """Places in the whole order: by segment, then within it, from a count of the segments before."""
    c = read(spark, d, "customer").select("c_mktsegment", F.col("c_custkey").cast("string").alias("patient"))
    sizes = c.groupBy("c_mktsegment").agg(F.count("*").alias("n"))  # a row for each segment
    before = sizes.select("c_mktsegment", F.coalesce(F.sum("n").over(Window.orderBy("c_mktsegment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("patient"))
    return c.join(before, "c_mktsegment").select("c_mktsegment", "patient", (F.col("before") + own).alias("place"))


@query("SELECT o_orderpriority, list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority)::BIGINT AS place, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2")
def custom_order(spark: SparkSession, d: str) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("o_orderpriority"))
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).select("o_orderpriority", place.alias("place"), "n").orderBy("place")


@query("SELECT DISTINCT r_name AS scope FROM region JOIN nation ON r_regionkey = n_regionkey UNION SELECT 'overall'")
def distinct_scopes(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "region").join(read(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("scope"))
    return r.union(spark.createDataFrame([("overall",)], "scope string")).distinct().orderBy("scope")


@query("SELECT o_custkey, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY 1")
def group_collect(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string")), ",").alias("keys"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'header' WHEN o_totalprice > 300000 THEN 'vertebrae_shared_extent' ELSE 'volume_prior' END AS spacing_source, 'status_' || lower(o_orderstatus) || CASE WHEN o_orderpriority LIKE '1%' THEN '_urgent' ELSE '' END AS intensity_source FROM orders")
def provenance_case(spark: SparkSession, d: str) -> DataFrame:
    spacing = F.when(F.col("o_orderstatus") == "F", "header").when(F.col("o_totalprice") > 300000, "vertebrae_shared_extent").otherwise("volume_prior")
    return read(spark, d, "orders").select("o_orderkey", spacing.alias("spacing_source"), F.concat(F.lit("status_"), F.lower("o_orderstatus"), F.when(F.col("o_orderpriority").startswith("1"), "_urgent").otherwise("")).alias("intensity_source"))


_GRADE = "CASE WHEN count(*) >= 12 AND max(o_totalprice) - min(o_totalprice) <= 480000 THEN 'high' WHEN count(*) >= 8 THEN 'medium' ELSE 'low' END"


@query(f"SELECT o_custkey, {_GRADE} AS confidence FROM orders GROUP BY 1")
def confidence_grade(spark: SparkSession, d: str) -> DataFrame:
    n, spread = F.count("*"), F.max("o_totalprice") - F.min("o_totalprice")
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.when((n >= 12) & (spread <= 480000), "high").when(n >= 8, "medium").otherwise("low").alias("confidence"))


@query("SELECT c_custkey, CASE WHEN bool_or(g = 'low') THEN 'low' WHEN bool_or(g = 'medium') THEN 'medium' WHEN count(g) > 0 THEN 'high' ELSE '' END AS worst FROM customer LEFT JOIN (SELECT o_custkey, CASE WHEN o_totalprice < 30000 THEN 'low' WHEN o_totalprice < 150000 THEN 'medium' ELSE 'high' END AS g FROM orders) ON o_custkey = c_custkey GROUP BY 1")
def worst_of(spark: SparkSession, d: str) -> DataFrame:
    grade = F.when(F.col("o_totalprice") < 30000, 0).when(F.col("o_totalprice") < 150000, 1).when(F.col("o_totalprice").isNotNull(), 2)
    worst = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(grade).alias("g"))
    named = F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), F.col("g") + 1)
    return read(spark, d, "customer").select("c_custkey").join(worst, "c_custkey", "left").select("c_custkey", F.when(F.col("g").isNull(), "").otherwise(named).alias("worst"))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def required_lookup(spark: SparkSession, d: str) -> DataFrame:
    region = read(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return R.required(read(spark, d, "nation"), region, ["n_regionkey"]).select("n_name", "r_name")


@query("SELECT event_id FROM events WHERE event_type <> 'error' AND json_extract(props, '$.k')::INT = 42")
def version_filter(spark: SparkSession, d: str) -> DataFrame:
    """Complete records at the current version; what cannot be parsed counts as another version."""
    rows = read(spark, d, "events").where("event_type <> 'error'")
    return rows.where(F.coalesce(F.from_json("props", "k int")["k"] == 42, F.lit(False))).select("event_id")


@query("SELECT o_orderstatus AS dataset, count(*) AS stale FROM orders WHERE o_totalprice > 100000 AND o_orderpriority <> '2-HIGH' AND o_orderstatus <> 'P' GROUP BY 1")
def stale_records(spark: SparkSession, d: str) -> DataFrame:
    """Complete records of another version in datasets that are not replaced."""
    records = read(spark, d, "orders").select(F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("pipeline_version"), (F.col("o_totalprice") > 100000).alias("complete"))
    return R.stale(records, "2-HIGH", ["P"], F.col("complete")).groupBy("dataset").agg(F.count("*").alias("stale"))


# Line items, parts and suppliers


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING list_sort(list(DISTINCT l_returnflag)) = ['A', 'N', 'R'] AND count(DISTINCT l_linestatus) = 1")
def cohort_having_set(spark: SparkSession, d: str) -> DataFrame:
    return R.exact_groups(read(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag", ("A", "N", "R"), F.min("l_linestatus") == F.max("l_linestatus"))


@query("SELECT a.l_orderkey, a.l_linenumber, a.n, b.parts FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) a JOIN (SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) AS parts FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2) b USING (l_orderkey, l_linenumber)")
def composite_key_join(spark: SparkSession, d: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber"]
    li = read(spark, d, "lineitem")
    a = li.where("l_returnflag = 'R'").groupBy(*keys).agg(F.count("*").alias("n"))
    return a.join(li.where("l_returnflag = 'A'").groupBy(*keys).agg(F.count_distinct("l_partkey").alias("parts")), keys)


@query("SELECT p_partkey, CASE WHEN x.mm IS NOT NULL THEN 'level_specific' WHEN p_size BETWEEN 15 AND 48 THEN 'generic' END AS kind, coalesce(x.mm, CASE WHEN p_size BETWEEN 15 AND 48 THEN 30.0 END)::DOUBLE AS reference_mm FROM part LEFT JOIN (VALUES ('ECONOMY', 24.5::DOUBLE), ('SMALL', 27.0), ('LARGE', 31.5)) x(t, mm) ON p_type = t")
def lookup_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A specific reference where the pair is known, else the generic one within its range."""
    known = F.broadcast(spark.createDataFrame([("ECONOMY", 24.5), ("SMALL", 27.0), ("LARGE", 31.5)], "p_type string, mm double"))
    generic = F.when(F.col("p_size").between(15, 48), 30.0)
    return read(spark, d, "part").join(known, "p_type", "left").select("p_partkey", F.when(F.col("mm").isNotNull(), "level_specific").when(generic.isNotNull(), "generic").alias("kind"), F.coalesce("mm", generic).alias("reference_mm"))


_CANDIDATES = "ca AS (SELECT l_orderkey AS k, l_returnflag AS method, max(l_quantity / 50) AS dice, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS place FROM lineitem GROUP BY 1, 2)"


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Registration candidates of each order: centroid (N), rigid (R) and spline (A), in the order they were tried."""
    place = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2)
    return read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("method")).agg(F.max(F.col("l_quantity") / 50).alias("dice"), F.min(place).alias("place"))


_NAMES = {"N": "centroid", "R": "rigid", "A": "bspline"}


@query(f"""WITH {_CANDIDATES}, b AS (SELECT k, max(dice) FILTER (WHERE method <> 'A') AS base, max(dice) FILTER (WHERE method = 'A') AS spline, arg_max(method, dice * 1000 - place) FILTER (WHERE method <> 'A') AS best FROM ca GROUP BY 1),
ch AS (SELECT k, base, spline, CASE WHEN spline IS NOT NULL AND (base IS NULL OR spline >= base - 0.02) THEN 'A' ELSE best END AS m FROM b)
SELECT k, CASE m WHEN 'N' THEN 'centroid' WHEN 'R' THEN 'rigid' ELSE 'bspline' END AS method, CASE m WHEN 'A' THEN spline ELSE base END AS dice, CASE m WHEN 'A' THEN spline ELSE base END >= 0.80 AS usable FROM ch""")  # fmt: skip
def candidate_selection(spark: SparkSession, d: str) -> DataFrame:
    """The spline if it is within 0.02 of the best of the others, else that one; and whether it passes the gate."""
    named = F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair])[F.col("method")]
    return select_candidate(candidates(spark, d).withColumn("method", named), keys=("k",))


@query(f"WITH {_CANDIDATES} SELECT k, method, dice FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY dice DESC, place) AS r FROM ca) WHERE r = 1")
def argmax_candidate(spark: SparkSession, d: str) -> DataFrame:
    return R.first_of(candidates(spark, d), ["k"], [F.col("dice"), -F.col("place")], largest=True).select("k", "method", "dice")


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS r FROM lineitem) WHERE r = 1")
def tuple_argmax(spark: SparkSession, d: str) -> DataFrame:
    best = F.max(F.struct("l_quantity", "l_linenumber", "l_partkey", "l_suppkey")).alias("b")
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(best).select("l_orderkey", "b.l_partkey", "b.l_linenumber")


@query("SELECT l_orderkey, min(l_quantity / 25) >= 0.85 AND max(l_quantity / 25) <= 1.18 AS scales_ok, coalesce(max(l_quantity / 50) >= 0.80, false) AS usable FROM lineitem GROUP BY 1")
def range_gate(spark: SparkSession, d: str) -> DataFrame:
    scales = F.array_agg(F.col("l_quantity") / 25)
    out = read(spark, d, "lineitem").groupBy("l_orderkey").agg(scales.alias("s"), F.max(F.col("l_quantity") / 50).alias("dice"))
    return out.select("l_orderkey", F.forall("s", lambda x: x.between(*AXIS_SCALE)).alias("scales_ok"), F.coalesce(F.col("dice") >= DICE_GATE, F.lit(False)).alias("usable"))


_FLAGS = """list_filter([CASE WHEN l_quantity < 5 THEN 'fov_' || printf('%d', l_quantity::BIGINT) || 'mm_outside_5-45' END, CASE WHEN l_quantity > 45 THEN 'fov_' || printf('%d', l_quantity::BIGINT) || 'mm_outside_5-45' END,
CASE WHEN l_discount >= 0.09 THEN l_returnflag || '_slice_spacing_outside_range' END, CASE WHEN l_tax = 0 THEN 'zero_origin' END], lambda f: f IS NOT NULL)"""


def flagged(spark: SparkSession, d: str) -> DataFrame:
    fov = F.concat(F.lit("fov_"), F.col("l_quantity").cast("bigint").cast("string"), F.lit("mm_outside_5-45"))
    flags = R.reasons((F.col("l_quantity") < 5, fov), (F.col("l_quantity") > 45, fov), (F.col("l_discount") >= 0.09, F.concat(F.col("l_returnflag"), F.lit("_slice_spacing_outside_range"))), (F.col("l_tax") == 0, "zero_origin"))
    return read(spark, d, "lineitem").withColumn("flags", flags)


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string({_FLAGS}, ';') AS flags, len({_FLAGS}) = 0 AS pass FROM lineitem")
def sanity_flags(spark: SparkSession, d: str) -> DataFrame:
    return flagged(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join("flags", ";").alias("flags"), (F.size("flags") == 0).alias("pass"))


@query("WITH o AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '+' ORDER BY l_returnflag) AS usable, min(l_tax) > 0 AS reliable FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_filter([CASE WHEN NOT reliable THEN 'tumour_mask_unreliable' END, CASE WHEN usable <> 'A+N+R' THEN 'usable_phases=' || usable END], lambda r: r IS NOT NULL), ';') AS reasons, reliable AND usable = 'A+N+R' AS clean FROM o")
def clean_with_reasons(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "+").alias("usable"), (F.min("l_tax") > 0).alias("reliable"))
    found = R.reasons((~F.col("reliable"), "tumour_mask_unreliable"), (F.col("usable") != "A+N+R", F.concat(F.lit("usable_phases="), "usable")))
    return o.select("l_orderkey", F.array_join(found, ";").alias("reasons"), (F.size(found) == 0).alias("clean"))


@query("SELECT l_orderkey, array_to_string(list_filter([CASE WHEN count(*) > 6 THEN 'too_many_lines' END, CASE WHEN count(DISTINCT l_linenumber) < count(*) THEN 'repeated_number' END, CASE WHEN max(l_discount) > 0.1 THEN 'discount' END, CASE WHEN min(l_quantity) < 1 THEN 'quantity' END], lambda p: p IS NOT NULL), ';') AS problems FROM lineitem GROUP BY 1")
def constraint_scan(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct("l_linenumber").alias("u"), F.max("l_discount").alias("d"), F.min("l_quantity").alias("q"))
    found = R.reasons((F.col("n") > 6, "too_many_lines"), (F.col("u") < F.col("n"), "repeated_number"), (F.col("d") > 0.1, "discount"), (F.col("q") < 1, "quantity"))
    return o.select("l_orderkey", F.array_join(found, ";").alias("problems"))


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) FILTER (WHERE l_quantity > 0) = 3 AS complete FROM lineitem GROUP BY 1")
def completeness_check(spark: SparkSession, d: str) -> DataFrame:
    needed = F.array(*map(F.lit, ("A", "N", "R")))
    o = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_quantity") > 0, F.col("l_returnflag"))).alias("there"))
    return o.select("l_orderkey", F.forall(needed, lambda f: F.array_contains("there", f)).alias("complete"))


@query("SELECT p_partkey, p_size = 10 AND abs(p_retailprice - 910) <= 50 AS same_grid, abs(p_retailprice - (900 + p_partkey / 10.0)) <= 1e-4 AS same_price FROM part")
def tolerance_compare(spark: SparkSession, d: str) -> DataFrame:
    near = lambda a, b, t: F.abs(a - b) <= t
    price = F.col("p_retailprice")
    return read(spark, d, "part").select("p_partkey", ((F.col("p_size") == 10) & near(price, F.lit(910), 50)).alias("same_grid"), near(price, 900 + F.col("p_partkey") / 10.0, 1e-4).alias("same_price"))


# A three-level hierarchy of the driver's part types.
TAXONOMY = (("ECONOMY", "present", "benign", "small"), ("SMALL", "present", "benign", "small"), ("LARGE", "present", "malignant", "large"), ("MEDIUM", "present", "malignant", "large"), ("STANDARD", "absent", "none", "control"), ("PROMO", "present", "malignant", "other"))


@query("WITH t(p_type, presence, behavior, coarse) AS (VALUES ('ECONOMY', 'present', 'benign', 'small'), ('SMALL', 'present', 'benign', 'small'), ('LARGE', 'present', 'malignant', 'large'), ('MEDIUM', 'present', 'malignant', 'large'), ('STANDARD', 'absent', 'none', 'control'), ('PROMO', 'present', 'malignant', 'other')) SELECT coalesce(presence, 'unknown') AS presence, coalesce(behavior, 'unknown') AS behavior, coalesce(coarse, 'unknown') AS coarse, count(*) AS n, sum(p_size)::BIGINT AS size FROM part LEFT JOIN t USING (p_type) GROUP BY 1, 2, 3")
def taxonomy_rollup(spark: SparkSession, d: str) -> DataFrame:
    levels = ("presence", "behavior", "coarse")
    t = F.broadcast(spark.createDataFrame(list(TAXONOMY), "p_type string, presence string, behavior string, coarse string"))
    named = read(spark, d, "part").join(t, "p_type", "left").select(*[F.coalesce(c, F.lit("unknown")).alias(c) for c in levels], "p_size")
    return named.groupBy(*levels).agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


@query("SELECT l_returnflag AS code, CASE l_returnflag WHEN 'N' THEN 'NC' WHEN 'A' THEN 'AP' WHEN 'R' THEN 'PVP' END AS phase, count(*) AS n FROM lineitem GROUP BY 1, 2")
def code_mapping(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for x in ("N", "NC", "A", "AP", "R", "PVP")])
    return read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("code")).agg(F.count("*").alias("n")).select("code", names[F.col("code")].alias("phase"), "n")


@query("WITH a AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS l FROM lineitem GROUP BY 1) SELECT l_orderkey, list_contains(l, 3) AS has3, coalesce(list_position(l, 4), 0)::BIGINT AS at4, len(list_filter(l, lambda x: x > 5)) > 0 AS any5, array_to_string(list_reverse(l), ',') AS backwards, array_to_string(l[1:2], ',') AS head FROM a")
def array_ops(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("l"))
    text = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",")
    return a.select("l_orderkey", F.array_contains("l", 3).alias("has3"), F.array_position("l", 4).alias("at4"), F.exists("l", lambda x: x > 5).alias("any5"), text(F.reverse("l")).alias("backwards"), text(F.slice("l", 1, 2)).alias("head"))


@query(f"SELECT kind, count(*) AS n FROM (SELECT regexp_replace(unnest({_FLAGS}), '^(N|A|R)_', '') AS kind FROM lineitem) GROUP BY 1 ORDER BY n DESC, kind LIMIT 20")
def top_flags(spark: SparkSession, d: str) -> DataFrame:
    kinds = flagged(spark, d).select(F.explode("flags").alias("flag")).select(F.regexp_replace("flag", "^(N|A|R)_", "").alias("kind"))
    return kinds.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(20)


@query("SELECT l_suppkey, count(DISTINCT l_returnflag) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) = 0 AS only_an, list_sort(list(DISTINCT l_linestatus)) = ['F', 'O'] AS both_states FROM lineitem WHERE l_quantity > 49 GROUP BY 1")
def subset_test(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "lineitem").where("l_quantity > 49").groupBy("l_suppkey").agg(F.collect_set("l_returnflag").alias("f"), F.array_sort(F.collect_set("l_linestatus")).alias("s"))
    return g.select("l_suppkey", (F.size(F.array_except("f", F.array(F.lit("A"), F.lit("N")))) == 0).alias("only_an"), (F.col("s") == F.array(F.lit("F"), F.lit("O"))).alias("both_states"))


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey").subtract(read(spark, d, "lineitem").where("l_quantity > 40").select("l_partkey"))


@query("SELECT s_suppkey, array_to_string(list_sort(list(w)), ',') AS missing FROM supplier CROSS JOIN (SELECT unnest(['A', 'N', 'R']) AS w) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = w AND l_quantity > 49 AND l_discount > 0.05) GROUP BY 1")
def missing_members(spark: SparkSession, d: str) -> DataFrame:
    there = read(spark, d, "lineitem").where("l_quantity > 49 and l_discount > 0.05").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.collect_set("l_returnflag").alias("there"))
    wanted = F.array(*map(F.lit, ("A", "N", "R")))
    rows = read(spark, d, "supplier").select("s_suppkey").join(there, "s_suppkey", "left")
    out = rows.select("s_suppkey", F.array_sort(F.array_except(wanted, F.coalesce("there", F.array().cast("array<string>")))).alias("m"))
    return out.where(F.size("m") > 0).select("s_suppkey", F.array_join("m", ",").alias("missing"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_key_violations(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1")
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_suppkey")
    return R.first_of(rows, ["l_orderkey", "l_linenumber"], [F.col("l_shipdate"), F.col("l_partkey"), F.col("l_suppkey")]).select("l_orderkey", "l_linenumber", "l_partkey")


#: Customers as cases, with diagnoses by number.
_DIAGNOSED = ", ".join("('" + "', '".join(str(x) for x in row) + "')" for row in taxonomy.DIAGNOSES)


@query(f"""WITH t(diagnosis, lesion_presence, p, behavior, b, origin, o, diagnosis_coarse, c, diagnosis_fine, f) AS (VALUES {_DIAGNOSED}),
x AS (SELECT ['CN', 'HH', 'HCC', 'ICC', 'CHCC', 'cHCC-CCA', 'CRLM', 'BCLM'][(c_custkey * 7 + c_nationkey) % 8 + 1] AS diagnosis FROM customer)
SELECT lesion_presence, behavior, b::INT AS behavior_id, origin, o::INT AS origin_id, diagnosis_coarse, c::INT AS diagnosis_coarse_id, diagnosis_fine, f::INT AS diagnosis_fine_id, count(*) AS n FROM x JOIN t USING (diagnosis) GROUP BY ALL""")  # fmt: skip
def diagnosis_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Cases by all levels of the label hierarchy; an unknown diagnosis would raise."""
    names = F.array(*[F.lit(x) for x in ("CN", "HH", "HCC", "ICC", "CHCC", "cHCC-CCA", "CRLM", "BCLM")])
    cases = read(spark, d, "customer").select(F.element_at(names, ((F.col("c_custkey") * 7 + F.col("c_nationkey")) % 8 + 1).cast("int")).alias("diagnosis"))
    levels = ("lesion_presence", "behavior", "behavior_id", "origin", "origin_id", "diagnosis_coarse", "diagnosis_coarse_id", "diagnosis_fine", "diagnosis_fine_id")
    return taxonomy.labelled(cases).groupBy(*levels).agg(F.count("*").alias("n"))


# Pages and documents

#: Pages as members of three archives: most are named as lesion masks, with many names in common, some are empty.
_CATALOG = """ct AS (SELECT 'a' || (page_id % 3) || '.zip' AS archive, CASE WHEN page_id % 5 = 0 THEN 'notes/' || page_id || '.txt' ELSE 'masks/' || (page_id % 40) || '_' || (page_id % 4) || '_' || (page_id // 3 % 3) || '_tumor_seg.nrrd' END AS member,
  CASE WHEN page_id % 11 = 0 THEN 0 ELSE page_id + 1 END AS size FROM pages), cb AS (SELECT *, regexp_extract(member, '[^/]*$') AS basename FROM ct)"""


def catalog(spark: SparkSession, d: str) -> DataFrame:
    i, text = F.col("page_id"), lambda c: c.cast("string")
    mask = F.concat(F.lit("masks/"), text(i % 40), F.lit("_"), text(i % 4), F.lit("_"), text(F.floor(i / 3).cast("bigint") % 3), F.lit("_tumor_seg.nrrd"))
    member = F.when(i % 5 == 0, F.concat(F.lit("notes/"), text(i), F.lit(".txt"))).otherwise(mask)
    rows = read(spark, d, "pages").select(F.concat(F.lit("a"), text(i % 3), F.lit(".zip")).alias("archive"), member.alias("member"), F.when(i % 11 == 0, 0).otherwise(i + 1).alias("size"))
    return rows.withColumn("basename", F.element_at(F.split("member", "/"), -1))


@query(f"WITH {_CATALOG} SELECT basename, count(*) AS n FROM cb GROUP BY 1 HAVING count(*) > 1")
def catalog_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return archives.duplicates(catalog(spark, d))


@query(f"WITH {_CATALOG}, wn AS (SELECT DISTINCT (page_id % 50) || '_' || (page_id % 4) || '_' || (page_id % 3) || '_tumor_seg.nrrd' AS basename FROM pages) SELECT basename FROM wn WHERE basename NOT IN (SELECT basename FROM cb WHERE size > 0)")
def catalog_missing(spark: SparkSession, d: str) -> DataFrame:
    i, text = F.col("page_id"), lambda c: c.cast("string")
    wanted = read(spark, d, "pages").select(F.concat_ws("_", text(i % 50), text(i % 4), text(i % 3), F.lit("tumor_seg.nrrd")).alias("basename")).distinct()
    return archives.missing(catalog(spark, d), wanted)


@query(f"""WITH {_CATALOG}, fi AS (SELECT archive, member, regexp_extract(member, '(\\d+)_(\\d+)_(\\d+)_tumor_seg\\.nrrd$', ['a', 'b', 'c']) AS g, row_number() OVER (PARTITION BY basename ORDER BY archive, member) AS r FROM cb WHERE member LIKE 'masks/%')
SELECT g.a AS patient_id, g.b AS phase, g.c AS lesion, archive, member FROM fi WHERE r = 1""")  # fmt: skip
def lesion_mask_index(spark: SparkSession, d: str) -> DataFrame:
    return archives.lesion_masks(catalog(spark, d))


@query("SELECT page_id, regexp_extract(url, '//([^/]+)/', 1) AS host, regexp_extract(url, '/([a-z]{2})/(\\d+)', 1) AS lang, TRY_CAST(nullif(regexp_extract(url, '/([a-z]{2})/(\\d+)', 2), '') AS BIGINT) AS number FROM pages")
def regex_member_parse(spark: SparkSession, d: str) -> DataFrame:
    part = lambda p, i: F.regexp_extract("url", p, i)
    return read(spark, d, "pages").select("page_id", part("//([^/]+)/", 1).alias("host"), part(r"/([a-z]{2})/(\d+)", 1).alias("lang"), F.nullif(part(r"/([a-z]{2})/(\d+)", 2), F.lit("")).try_cast("bigint").alias("number"))


@query("WITH p AS (SELECT page_id, regexp_replace(url, '\\?.*$', '') || '.nii.gz' AS path FROM pages) SELECT page_id, regexp_extract(path, '[^/]*$') AS name, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.nii\\.gz$', '') AS stem, regexp_extract(path, '\\.[^.]*$') AS suffix, 'fallback/' || regexp_extract(path, '[^/]*$') AS portable FROM p")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages").select("page_id", F.concat(F.regexp_replace("url", r"\?.*$", ""), F.lit(".nii.gz")).alias("path"))
    name = F.element_at(F.split("path", "/"), -1)
    return p.select("page_id", name.alias("name"), F.regexp_replace(name, r"\.nii\.gz$", "").alias("stem"), F.regexp_extract("path", r"\.[^.]*$", 0).alias("suffix"), F.concat(F.lit("fallback/"), name).alias("portable"))


@query("SELECT doc_id, source || '+' || lang AS joined, replace(replace('>' || lang || '-x', '>', 'gt_'), '-', '_') AS column_name, printf('%03d_%s', (doc_id % 1000)::INT, upper(lang)) AS formatted, string_split(source || ';' || lang, ';')[2] AS parted FROM documents")
def string_format(spark: SparkSession, d: str) -> DataFrame:
    column = F.replace(F.replace(F.concat(F.lit(">"), "lang", F.lit("-x")), F.lit(">"), F.lit("gt_")), F.lit("-"), F.lit("_"))
    return read(spark, d, "documents").select(
        "doc_id", F.array_join(F.array("source", "lang"), "+").alias("joined"), column.alias("column_name"), F.format_string("%03d_%s", (F.col("doc_id") % 1000).cast("int"), F.upper("lang")).alias("formatted"),
        F.element_at(F.split(F.concat_ws(";", "source", "lang"), ";"), 2).alias("parted"),
    )


@query("WITH s AS (SELECT DISTINCT CASE WHEN source = 'src0' THEN 'base' ELSE substr(source, 4) END AS id FROM documents) SELECT id, row_number() OVER (ORDER BY TRY_CAST(id AS BIGINT) IS NULL, TRY_CAST(id AS BIGINT), id) AS place FROM s")
def natural_sort(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "documents").select(F.when(F.col("source") == "src0", "base").otherwise(F.substring("source", 4, 20)).alias("id")).distinct()
    return s.select("id", F.row_number().over(Window.orderBy(*R.natural_order("id"))).alias("place"))  # a row for each source


@query("WITH t AS (SELECT conv_id, turn, ['', ' na ', 'N/A', 'None', 'null', role][(conv_id + turn) % 6 + 1] AS token FROM conversations) SELECT conv_id, turn, CASE WHEN upper(trim(token)) NOT IN ('', 'NA', 'N/A', 'NONE', 'NULL') THEN token END AS token FROM t")
def null_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.array(*map(F.lit, ("", " na ", "N/A", "None", "null")), "role")
    token = F.element_at(tokens, ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    return read(spark, d, "conversations").select("conv_id", "turn", absent(token).alias("token"))

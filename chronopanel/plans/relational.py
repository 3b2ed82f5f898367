"""Queries over the warehouse tables, one for each relational operation that the pipeline composes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.stats import rounded
from chronopanel.functions.text import described, grouped
from chronopanel.functions.time import micros
from chronopanel.operators import bootstrap, features, metrics, ranges
from chronopanel.sources import sinks, tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark, folder, name) -> DataFrame:
    return tables.table(spark, folder, name)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def scan_filter_project(spark, folder):
    return t(spark, folder, "orders").where("o_orderstatus = 'F' AND o_totalprice > 200000").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT p_brand, count(*) AS n FROM part WHERE lower(p_type) LIKE '%steel%' OR p_size IN (1, 5, 9) GROUP BY p_brand")
def text_and_membership_filter(spark, folder):
    return t(spark, folder, "part").where(F.lower("p_type").contains("steel") | F.col("p_size").isin(1, 5, 9)).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS mean_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, folder):
    rows = t(spark, folder, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.count("*").alias("n"))


@query("SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 3 GROUP BY n_name")
def join_chain(spark, folder):
    joined = t(spark, folder, "orders").join(t(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, folder, "region").where("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_mktsegment, count(o_orderkey) AS n_orders, count(DISTINCT c_custkey) AS n_customers FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
def left_join_counts(spark, folder):
    joined = t(spark, folder, "customer").join(t(spark, folder, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy("c_mktsegment").agg(F.count("o_orderkey").alias("n_orders"), F.count_distinct("c_custkey").alias("n_customers"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_join(spark, folder):
    large = t(spark, folder, "orders").where("o_totalprice > 400000")
    return t(spark, folder, "customer").join(large, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, folder):
    return t(spark, folder, "customer").join(t(spark, folder, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT n_nationkey AS key, n_name AS name, NULL::INT AS region FROM nation UNION ALL SELECT r_regionkey, r_name, r_regionkey FROM region")
def union_by_name(spark, folder):
    nations = t(spark, folder, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    regions = t(spark, folder, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("region"))
    return nations.unionByName(regions, allowMissingColumns=True)


@query("SELECT c_nationkey AS key FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def key_intersection(spark, folder):
    return t(spark, folder, "customer").select(F.col("c_nationkey").alias("key")).intersect(t(spark, folder, "supplier").select("s_nationkey"))


@query("SELECT p_partkey AS key FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def key_difference(spark, folder):
    return t(spark, folder, "part").select(F.col("p_partkey").alias("key")).exceptAll(t(spark, folder, "lineitem").where("l_quantity > 45").select("l_partkey").distinct())


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(spark, folder):
    return t(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(spark, folder):
    return t(spark, folder, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 2) AS l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax) <= 2")
def top_k_by_group(spark, folder):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax")
    return t(spark, folder, "lineitem").withColumn("n", F.row_number().over(w)).where("n <= 2").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.round("l_extendedprice", 2).alias("l_extendedprice"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY o_orderpriority")
def pivot_counts(spark, folder):
    return t(spark, folder, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT c_nationkey, count(*) AS n, round(quantile_cont(c_acctbal, 0.01), 6) AS p01, round(quantile_cont(c_acctbal, 0.5), 6) AS p50, round(quantile_cont(c_acctbal, 0.99), 6) AS p99, round(stddev_samp(c_acctbal), 6) AS sd FROM customer GROUP BY c_nationkey")
def exact_quantiles(spark, folder):
    rows = t(spark, folder, "customer").select("c_nationkey", "c_acctbal")
    sums = rows.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.stddev_samp("c_acctbal"), 6).alias("sd"))
    found = sums.join(ranges.quantiles(rows, ["c_nationkey"], "c_acctbal", [0.01, 0.5, 0.99]), "c_nationkey", "left")
    return found.select("c_nationkey", "n", *[F.round(F.col("q")[i], 6).alias(name) for i, name in enumerate(("p01", "p50", "p99"))], "sd")


@query("SELECT l_linenumber, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT (l_suppkey, l_partkey)) AS pairs FROM lineitem GROUP BY l_linenumber")
def distinct_counts(spark, folder):
    return t(spark, folder, "lineitem").groupBy("l_linenumber").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_suppkey", "l_partkey").alias("pairs"))


@query("SELECT o_custkey, o_orderkey, CAST(lead(o_orderkey) OVER w AS BIGINT) AS next_order, row_number() OVER w AS n, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 2) AS spent_before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def ordered_windows(spark, folder):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    before = F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return t(spark, folder, "orders").select("o_custkey", "o_orderkey", F.lead("o_orderkey").over(w).alias("next_order"), F.row_number().over(w).cast("bigint").alias("n"), F.round(before, 2).alias("spent_before"))


@query("SELECT c_nationkey, c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 1000)) + (count(*) OVER (PARTITION BY c_nationkey, floor(c_acctbal / 1000)) - 1) / 2.0 AS average_rank FROM customer")
def average_ranks(spark, folder):
    rows = t(spark, folder, "customer").select("c_nationkey", "c_custkey", F.floor(F.col("c_acctbal") / 1000).alias("k"))
    return ranges.average_ranks(rows, ["c_nationkey"], "k", "average_rank").drop("k")


@query("SELECT o_custkey, o_orderstatus, o_orderpriority, dense_rank() OVER (ORDER BY o_custkey, o_orderstatus, o_orderpriority) - 1 AS number FROM (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders)")
def composite_numbers(spark, folder):
    """A number for each distinct key of three columns, in their order."""
    return ranges.dense_numbers(t(spark, folder, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"], "number")


@query("SELECT l_partkey, l_suppkey, l_shipdate, l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_partkey, l_suppkey, l_shipdate, l_orderkey, l_linenumber) - 1 AS row_id FROM lineitem")
def row_ids(spark, folder):
    """A row's number in the order of part, supplier and ship date over the whole table; ties by the rest of the row."""
    rows = t(spark, folder, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber")
    return ranges.row_numbers(rows, ["l_partkey", "l_suppkey", "l_shipdate"], "row_id")


@query("SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS n, round(avg(epoch_us(o_orderdate) % 86400000000 / 3600000000.0), 6) AS mean_hour FROM orders GROUP BY 1, 2")
def date_parts(spark, folder):
    out = t(spark, folder, "orders").groupBy(F.year("o_orderdate").cast("bigint").alias("year"), F.month("o_orderdate").cast("bigint").alias("month")).agg(F.count("*").alias("n"), F.round(F.avg(F.pmod(micros("o_orderdate"), F.lit(86_400_000_000)) / 3.6e9), 6).alias("mean_hour"))
    return out


RULES = [("metal", ("STEEL", "COPPER", "NICKEL")), ("alloy", ("BRASS", "TIN"))]


@query("WITH x AS (SELECT p_size, upper(trim(regexp_replace(p_type, '\\s+', ' ', 'g'))) AS n FROM part) SELECT CASE WHEN n = '' OR contains(n, 'PROMO') THEN NULL WHEN contains(n, 'STEEL') OR contains(n, 'COPPER') OR contains(n, 'NICKEL') THEN 'metal' WHEN contains(n, 'BRASS') OR contains(n, 'TIN') THEN 'alloy' ELSE 'other' END AS kind, count(*) AS n, sum(p_size)::BIGINT AS sizes FROM x GROUP BY 1")
def grouped_by_rules(spark, folder):
    kind = grouped(F.col("p_type"), RULES, ("PROMO",), "other")
    return t(spark, folder, "part").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("p_size").alias("sizes"))


@query("SELECT event_type, round(sum(CASE WHEN event_type = 'click' OR value > 100 THEN (value - 32) * 5 / 9 ELSE value END), 4) AS total FROM events GROUP BY event_type")
def unit_conversion(spark, folder):
    ev = t(spark, folder, "events")
    unit = F.when(F.col("value") > 100, " f ")
    return ev.withColumn("v", features.to_celsius(F.col("event_type"), unit, F.col("value"), ("F", "DEG F"), ("click",))).groupBy("event_type").agg(F.round(F.sum("v"), 4).alias("total"))


@query("SELECT event_type AS item, min(CAST(event_id AS VARCHAR)) AS label FROM events GROUP BY event_type")
def first_label(spark, folder):
    return tables.first_labels(t(spark, folder, "events").select(F.col("event_type").alias("item"), F.col("event_id").cast("string").alias("label")))


@query("SELECT event_type || '__mean' AS name, 'mean of ' || event_type AS description, count(*) AS n FROM events GROUP BY event_type")
def described_names(spark, folder):
    named = t(spark, folder, "events").withColumn("name", F.concat("event_type", F.lit("__mean")))
    return named.groupBy("name").agg(F.count("*").alias("n")).withColumn("description", described(F.col("name")))


SCORED = "scored AS (SELECT l_linestatus AS \"group\", CAST(l_returnflag = 'R' AS INT) AS y, l_quantity / 64 AS p FROM lineitem)"


def scored(spark, folder) -> DataFrame:
    return t(spark, folder, "lineitem").select(F.col("l_linestatus").alias("group"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 64).alias("p"))


@query(
    f'WITH {SCORED}, dist AS (SELECT "group", p, count(*) AS n, sum(y) AS pos FROM scored GROUP BY 1, 2), st AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS taken FROM dist WINDOW w AS (PARTITION BY "group" ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), '
    'ar AS (SELECT "group", sum(n)::BIGINT AS n, sum(pos)::BIGINT AS events, sum((n - pos) * (tp - pos / 2.0)) AS pairs, sum(pos * tp / taken) AS pr FROM st GROUP BY 1) '
    'SELECT ar."group", n, events, round(pairs / (events * (n - events)), 6) AS auc, round(pr / events, 6) AS average_precision, round(brier, 6) AS brier FROM ar JOIN (SELECT "group", avg((p - y) * (p - y)) AS brier FROM scored GROUP BY 1) USING ("group")'
)
def binary_metrics(spark, folder):
    return rounded(metrics.binary_metrics(scored(spark, folder)))


@query(
    f'WITH {SCORED}, ed AS (SELECT "group", list_distinct(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS edges FROM scored GROUP BY 1), b AS (SELECT scored.*, CAST(greatest(len(list_filter(edges, lambda e: e < p)) - 1, 0) AS BIGINT) AS bin FROM scored JOIN ed USING ("group")) '
    'SELECT "group", bin, count(*) AS n, sum(y)::BIGINT AS events, round(min(p), 6) AS least_p, round(avg(p), 6) AS mean_p, round(max(p), 6) AS most_p, round(avg(y), 6) AS rate FROM b GROUP BY 1, 2'
)
def calibration_bins(spark, folder):
    return rounded(metrics.calibration(scored(spark, folder)))


SCREEN_ITEMS = ("l_quantity", "l_discount", "l_tax", "l_linenumber")
_TAIL = "least(1.0, 2 * exp(-z * z / 2) / 2.5066282746310002 * (t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))))"
SCREEN_SQL = (
    f"WITH long AS (SELECT CAST(l_returnflag = 'R' AS INT) AS y, unnest({list(SCREEN_ITEMS)}) AS item, unnest([l_quantity, l_discount, l_tax, l_linenumber::DOUBLE]) AS v FROM lineitem), "
    "dist AS (SELECT item, v, count(*) AS n, sum(y) AS pos FROM long GROUP BY 1, 2), rk AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY item ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS r FROM dist), "
    "su AS (SELECT item, sum(n)::DOUBLE AS n, sum(pos)::DOUBLE AS n1, sum(pos * r) AS r1, sum(pow(n, 3) - n) AS ties FROM rk GROUP BY item), "
    "us AS (SELECT item, n, n1, r1 - n1 * (n1 + 1) / 2 AS u, n1 * (n - n1) AS prod, ties FROM su), "
    "zs AS (SELECT *, greatest(abs(u - prod / 2) - 0.5, 0) / sqrt(prod / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM us), "
    f"ps AS (SELECT *, {_TAIL} AS p_value FROM (SELECT *, 1 / (1 + 0.2316419 * z) AS t FROM zs)), "
    "rr AS (SELECT *, row_number() OVER (ORDER BY p_value, item) AS rn, count(*) OVER () AS m FROM ps) "
    "SELECT item, n::BIGINT AS n, n1::BIGINT AS n1, round(u, 2) AS u, round(p_value, 6) AS p_value, round(2 * u / prod - 1, 6) AS cliffs_delta, round(least(1.0, min(p_value * m / rn) OVER (ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)), 6) AS q_value FROM rr"
)


@query(SCREEN_SQL)
def covariate_screen(spark, folder):
    rows = t(spark, folder, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in SCREEN_ITEMS])).alias("s")).select("y", "s.*")
    found = metrics.adjusted(metrics.rank_tests(rows))
    return rounded(found.withColumn("u", F.round("u", 2)))


@query(
    "WITH x AS (SELECT o_orderpriority AS g, CAST(o_orderstatus = 'F' AS INT) AS a, CAST(o_totalprice > 200000 AS INT) AS b FROM orders), c AS (SELECT g, count(*) FILTER (WHERE a = 1 AND b = 1) AS n11, count(*) FILTER (WHERE a = 1 AND b = 0) AS n10, count(*) FILTER (WHERE a = 0 AND b = 1) AS n01, count(*) FILTER (WHERE a = 0 AND b = 0) AS n00 FROM x GROUP BY g) "
    "SELECT g AS \"group\", n11, n10, n01, n00, round(n11::DOUBLE * n00 / nullif(n10::DOUBLE * n01, 0), 6) AS odds_ratio, round(n11 / nullif(n11 + n10, 0) - n01 / nullif(n01 + n00, 0), 6) AS risk_difference, round((n11 + n10 + n01 + n00) * pow(n11::DOUBLE * n00 - n10::DOUBLE * n01, 2) / nullif((n11 + n10)::DOUBLE * (n01 + n00) * (n11 + n01) * (n10 + n00), 0), 6) AS chi_squared FROM c"
)
def two_by_two(spark, folder):
    rows = t(spark, folder, "orders").select(F.col("o_orderpriority").alias("group"), (F.col("o_orderstatus") == "F").cast("int").alias("a"), (F.col("o_totalprice") > 200000).cast("int").alias("b"))
    return rounded(metrics.two_by_two(rows, "group", "a", "b"))


@query("SELECT 'r' AS \"column\", 'constant' AS reason UNION ALL SELECT 'm', 'all_missing'")
def constant_columns(spark, folder):
    rows = t(spark, folder, "lineitem").select("l_quantity", F.lit(1).alias("r"), F.lit(None).cast("double").alias("m"), "l_tax")
    return metrics.constant_columns(rows, ["l_quantity", "r", "m", "l_tax"])


@query("SELECT o_orderstatus, count(*) AS n, round_even(avg(o_totalprice), 3) AS mean_price, printf('%.3e', sum(o_totalprice)) AS total FROM orders GROUP BY o_orderstatus")
def rounded_report(spark, folder):
    return sinks.report(t(spark, folder, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean_price"), F.sum("o_totalprice").alias("total")), 3, ("total",))


@query("SELECT measure, max(CASE WHEN s = 'F' THEN x END) AS \"F\", max(CASE WHEN s = 'O' THEN x END) AS \"O\", max(CASE WHEN s = 'P' THEN x END) AS \"P\" FROM (SELECT o_orderstatus AS s, unnest(['n', 'customers']) AS measure, unnest([CAST(count(*) AS VARCHAR), CAST(count(DISTINCT o_custkey) AS VARCHAR)]) AS x FROM orders GROUP BY 1) GROUP BY measure")
def transposed_report(spark, folder):
    summary = t(spark, folder, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))
    return sinks.transposed(summary, "o_orderstatus", ["n", "customers"])


@query("SELECT u.user_id AS entity, row_number() OVER (ORDER BY u.user_id) - 1 AS number FROM (SELECT DISTINCT user_id FROM events) u")
def dense_numbers(spark, folder):
    return bootstrap.entity_numbers(t(spark, folder, "events").select(F.col("user_id").alias("entity")))


@query("SELECT event_type, json_extract_string(props, '$.' || json_keys(props)[1]) IS NOT NULL AS has_first, count(*) AS n FROM events GROUP BY 1, 2")
def json_properties(spark, folder):
    first = F.element_at(F.json_object_keys("props"), 1)
    value = F.element_at(F.from_json("props", "map<string,string>"), first)
    return t(spark, folder, "events").groupBy("event_type", value.isNotNull().alias("has_first")).agg(F.count("*").alias("n"))

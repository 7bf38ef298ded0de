"""Joins, aggregates, grouping sets, windows, set operations and limits over the driver's tables."""

from __future__ import annotations

from quernstone.plans.suite import Query

_w = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
_day = "SELECT cast(o_orderdate as date) AS d, round(sum(o_totalprice), 2) AS daily FROM orders GROUP BY cast(o_orderdate as date)"

SUITE: dict[str, Query] = {
    "join_inner": Query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000"),
    "join_composite": Query("SELECT count(*) AS n, DSUM(a.l_quantity) AS s FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey < b.l_partkey"),
    "join_hint_hash": Query("SELECT /*+ SHUFFLE_HASH(c) */ c_mktsegment, count(*) AS n FROM orders o JOIN customer c ON o_custkey = c_custkey GROUP BY c_mktsegment"),
    "join_hint_merge": Query("SELECT /*+ MERGE(c) */ c_mktsegment, count(*) AS n FROM orders o JOIN customer c ON o_custkey = c_custkey GROUP BY c_mktsegment"),
    "join_residual": Query("SELECT o_orderpriority, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate AND l_quantity > 30 GROUP BY o_orderpriority"),
    "join_left": Query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey"),
    "join_right": Query("SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"),
    "join_full": Query("SELECT coalesce(c_nationkey, s_nationkey) AS k, count(c_custkey) AS c, count(s_suppkey) AS s FROM (SELECT * FROM customer WHERE c_nationkey < 15) c FULL OUTER JOIN (SELECT * FROM supplier WHERE s_nationkey > 5) s ON c_nationkey = s_nationkey GROUP BY coalesce(c_nationkey, s_nationkey)"),
    "join_semi": Query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)"),
    "join_anti": Query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)"),
    "join_notin": Query("SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"),
    "join_notin_null": Query("SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT nullif(c_custkey, 1) FROM customer WHERE c_acctbal < 0 OR c_custkey = 1)"),
    "join_theta": Query("SELECT a.n_name AS a, count(*) AS n FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey GROUP BY a.n_name"),
    "join_self": Query("SELECT a.s_nationkey AS k, count(*) AS n FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey GROUP BY a.s_nationkey"),
    "join_text": Query("SELECT p_brand, count(*) AS n FROM part p JOIN (SELECT concat('Brand#', cast(n_nationkey as string)) AS brand FROM nation) b ON p_brand = brand GROUP BY p_brand"),
    "join_cross_series": Query("SELECT n_regionkey, g, count(*) AS n FROM nation CROSS JOIN (SELECT explode(sequence(1, 4)) AS g) s GROUP BY n_regionkey, g", "SELECT n_regionkey, g, count(*) AS n FROM nation CROSS JOIN (SELECT unnest(generate_series(1, 4)) AS g) s GROUP BY n_regionkey, g"),
    "join_multiway": Query("SELECT r_name, count(*) AS n, DSUM(l_extendedprice) AS s FROM lineitem, orders, customer, nation, region WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY r_name"),
    "agg_sum_types": Query("SELECT ISUM(cast(l_linenumber as smallint)) AS s2, ISUM(l_linenumber) AS s4, ISUM(l_partkey) AS s8, DSUM(l_tax) AS sf, cast(sum(cast(l_extendedprice as decimal(15,2))) as decimal(38,2)) AS sn FROM lineitem"),
    "agg_avg_types": Query("SELECT l_returnflag, DAVG(l_linenumber) AS a4, DAVG(l_partkey) AS a8, DAVG(l_quantity) AS af FROM lineitem GROUP BY l_returnflag"),
    "agg_bigint_exact": Query("SELECT cast(sum(cast(l_partkey as decimal(38,0)) * 1000000007) as string) AS s FROM lineitem"),
    "agg_filter": Query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_totalprice > 200000) AS big FROM orders GROUP BY o_orderpriority"),
    "agg_having_subquery": Query("SELECT o_custkey, DSUM(o_totalprice) AS s FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > (SELECT 1.5 * avg(t) FROM (SELECT sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) x)"),
    "agg_stddev": Query("SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_quantity), 6) AS v, round(stddev_pop(l_discount), 6) AS sp, round(var_pop(l_discount), 6) AS vp FROM lineitem GROUP BY l_returnflag"),
    "agg_bool": Query("SELECT o_orderstatus, bool_and(o_totalprice > 900) AS every_one, bool_or(o_totalprice > 400000) AS any_one FROM orders GROUP BY o_orderstatus"),
    "agg_minmax_types": Query("SELECT min(l_shipdate) AS t0, max(l_shipdate) AS t1, min(cast(l_shipdate as date)) AS d0, max(cast(l_shipdate as date)) AS d1, min(l_returnflag) AS s0, max(l_returnflag) AS s1, min(l_tax) AS f0, max(l_tax) AS f1, min(cast(l_tax as decimal(6,2))) AS n0, max(cast(l_tax as decimal(6,2))) AS n1, min(l_linenumber) AS i0, max(l_partkey) AS i1 FROM lineitem"),
    "agg_string": Query("SELECT n_regionkey, listagg(n_name, ';') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_count_distinct_group": Query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps, count(l_orderkey) AS n FROM lineitem GROUP BY l_returnflag"),
    "agg_ordinal": Query("SELECT o_orderstatus, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2"),
    "agg_empty": Query("SELECT count(*) AS n, sum(l_tax) AS s, max(l_partkey) AS m FROM lineitem WHERE l_quantity < 0"),
    "agg_array": Query("SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey"),
    "agg_distinct": Query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "grp_rollup": Query("SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) AS g1, grouping(o_orderpriority) AS g2, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    "grp_cube": Query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, DSUM(o_totalprice) AS s FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "grp_sets": Query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"),
    "win_rank": Query(f"SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, row_number() OVER ({_w}) AS rn FROM orders"),
    "win_ntile": Query("SELECT o_orderkey, ntile(10) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS t FROM orders"),
    "win_rolling7": Query(f"SELECT d, round(avg(daily) OVER (ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 3) AS a7, round(avg(daily) OVER (ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 3) AS a30 FROM ({_day}) t"),
    "win_cumsum": Query(f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({_w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS c FROM orders"),
    "win_total": Query("SELECT o_orderpriority, DSUM(o_totalprice) AS s, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 6) AS part FROM orders GROUP BY o_orderpriority"),
    "win_lag": Query(f"SELECT o_orderkey, lag(o_totalprice) OVER ({_w}) AS before, lead(o_totalprice, 2, 0.0D) OVER ({_w}) AS after FROM orders", f"SELECT o_orderkey, lag(o_totalprice) OVER ({_w}) AS before, lead(o_totalprice, 2, 0.0) OVER ({_w}) AS after FROM orders"),
    "win_values": Query(f"SELECT o_orderkey, first_value(o_orderkey) OVER ({_w}) AS f, last_value(o_orderkey) OVER ({_w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) OVER ({_w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n FROM orders"),
    "win_distribution": Query("SELECT o_orderkey, round(percent_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey), 6) AS p, round(cume_dist() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey), 6) AS c FROM orders"),
    "win_range": Query("SELECT s_suppkey, count(*) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS n FROM supplier"),
    "win_named": Query(f"SELECT o_orderkey, count(*) OVER w AS n, round(max(o_totalprice) OVER w, 2) AS m FROM orders WINDOW w AS ({_w})"),
    "set_union": Query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "set_except_all": Query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier"),
    "set_intersect_all": Query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier"),
    "set_diff_both": Query("(SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer) UNION ALL (SELECT c_custkey FROM customer WHERE c_custkey < 50 EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000)"),
    "sort_topk": Query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25"),
    "sort_nulls": Query("SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS p FROM orders ORDER BY nullif(o_orderpriority, '1-URGENT') ASC NULLS LAST, o_orderkey LIMIT 50"),
    "sort_nulls_first": Query("SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS p FROM orders ORDER BY nullif(o_orderpriority, '1-URGENT') DESC NULLS FIRST, o_orderkey LIMIT 50"),
    "limit_offset": Query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40"),
    "cte_nested": Query("WITH a AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), b AS (SELECT avg(t) AS m FROM a) SELECT count(*) AS n FROM a, b WHERE t > m"),
    "between_subquery": Query("SELECT count(*) AS n FROM lineitem WHERE l_quantity BETWEEN (SELECT min(s_suppkey) FROM supplier) AND (SELECT max(n_nationkey) FROM nation)"),
    "greatest_least": Query("SELECT ISUM(greatest(p_size, 25)) AS g, ISUM(least(p_size, 25)) AS l, count(nullif(p_size, 7)) AS k, DSUM(abs(p_size - 30)) AS a FROM part"),
    "values_source": Query("SELECT a, b FROM (VALUES (1, 'x'), (2, NULL), (NULL, 'z')) AS t(a, b)"),
    "series_source": Query("SELECT explode(sequence(1, 1000, 7)) AS g", "SELECT unnest(generate_series(1, 1000, 7)) AS g"),
    "series_dates": Query("SELECT explode(sequence(date '2020-01-15', date '2020-06-30', interval 1 month)) AS d", "SELECT cast(unnest(generate_series(date '2020-01-15', date '2020-06-30', interval 1 month)) as date) AS d"),
    "update_rewrite": Query("SELECT c_custkey, CASE WHEN c_custkey = 7 THEN round(c_acctbal + 1234.56, 2) ELSE round(c_acctbal, 2) END AS c_acctbal FROM customer"),
    "update_from_aggregate": Query("SELECT c_custkey, round(coalesce(t.s, c_acctbal), 2) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) t ON o_custkey = c_custkey"),
    "events_tumbling": Query("SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n, DSUM(value) AS s FROM events GROUP BY date_trunc('hour', ts), event_type"),
    "events_json": Query("SELECT event_type, count(*) AS n, ISUM(cast(get_json_object(props, '$.k') as int)) AS s FROM events GROUP BY event_type"),
}
SUITE = {f"rel_{name}": q for name, q in SUITE.items()}

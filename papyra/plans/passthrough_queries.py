"""Queries that any SQL user runs: joins, aggregates, windows, sets, scalar functions, over the business tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events".split()


def _run(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        used = [t for t in TABLES if re.search(rf"(?i)\b(from|join|,)\s+{t}\b", text)]
        return spark.sql(_named(text, used), **{t: spark.read.parquet(f"{sf}/{t}.parquet") for t in used})

    return query


def _named(text: str, used: list[str]) -> str:
    """Table names as parameters, so that no view is left in the session."""
    return re.sub(r"(?i)\b(from|join|,)(\s+)(" + "|".join(used) + r")\b", r"\1\2{\3}", text)


# name: (SQL for Spark, the same for DuckDB, or None if it is the same)
_BOTH: dict[str, tuple[str, str | None]] = {
    "pt_join_inner": ("SELECT n_name, r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, r_name", None),
    "pt_join_left": ("SELECT c_custkey, count(o_orderkey) AS n, max(o_totalprice) AS most FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000 GROUP BY c_custkey", None),
    "pt_join_right_full": ("SELECT coalesce(c_custkey, -1) AS c, coalesce(s_suppkey, -1) AS s FROM (SELECT c_custkey FROM customer) a FULL JOIN (SELECT s_suppkey FROM supplier) b ON c_custkey = s_suppkey UNION ALL SELECT c_custkey, s_suppkey FROM (SELECT c_custkey FROM customer) c RIGHT JOIN (SELECT s_suppkey FROM supplier) d ON c_custkey = s_suppkey + 7", None),
    "pt_join_cross": ("SELECT r1.r_name AS a, r2.r_name AS b FROM region r1 CROSS JOIN region r2", None),
    "pt_join_natural_using": ("SELECT k, x, y FROM (SELECT r_regionkey AS k, r_name AS x FROM region) a NATURAL JOIN (SELECT n_regionkey AS k, n_name AS y FROM nation) b UNION ALL SELECT k, x, y FROM (SELECT r_regionkey AS k, r_name AS x FROM region) c JOIN (SELECT n_nationkey AS k, n_name AS y FROM nation) d USING (k)", None),
    "pt_semi_anti": ("SELECT c_custkey, 'with' AS kind FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey UNION ALL SELECT c_custkey, 'without' FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey, 'with' AS kind FROM customer SEMI JOIN orders ON c_custkey = o_custkey UNION ALL SELECT c_custkey, 'without' FROM customer ANTI JOIN orders ON c_custkey = o_custkey"),
    "pt_exists_in": ("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49) AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey = 7)", None),
    "pt_theta_range": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND b.n_nationkey <= a.n_nationkey + 3", None),
    "pt_lateral": ("SELECT n_name, x.k, x.v FROM nation, LATERAL (SELECT n_nationkey + 1 AS k, n_regionkey * 2 AS v) x", None),
    "pt_correlated": ("SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5D * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5::DOUBLE * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)"),
    "pt_group_having": ("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS qty, round(avg(l_discount), 6) AS disc FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 100", None),
    "pt_group_by_all": ("SELECT o_orderstatus, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL", None),
    "pt_distinct_filter": ("SELECT o_orderstatus, count(DISTINCT o_custkey) AS buyers, count(*) FILTER (WHERE o_totalprice > 100000) AS big, sum(DISTINCT o_custkey % 7) AS sevens FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS buyers, count(*) FILTER (WHERE o_totalprice > 100000) AS big, sum(DISTINCT o_custkey % 7)::BIGINT AS sevens FROM orders GROUP BY o_orderstatus"),
    "pt_grouping_sets": ("SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS g, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", "SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS g, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())"),
    "pt_cube": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    "pt_rollup": ("SELECT r_name, n_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)", None),
    "pt_median_quantile": ("SELECT o_orderstatus, median(o_totalprice) AS med, percentile(o_totalprice, 0.25D) AS q1, percentile_disc(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS disc FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, median(o_totalprice) AS med, quantile_cont(o_totalprice, 0.25) AS q1, quantile_disc(o_totalprice, 0.5) AS disc FROM orders GROUP BY o_orderstatus"),
    "pt_statistics": ("SELECT l_returnflag, round(stddev(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(variance(l_quantity), 6) AS v, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(regr_slope(l_extendedprice, l_quantity), 4) AS sl, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY l_returnflag", None),
    "pt_list_string_agg": ("SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names, max_by(n_name, n_nationkey) AS last_n, min_by(n_name, n_nationkey) AS first_n, bool_and(n_nationkey >= 0) AS ok, bit_or(n_nationkey) AS bits, count_if(n_nationkey > 5) AS c FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, arg_max(n_name, n_nationkey) AS last_n, arg_min(n_name, n_nationkey) AS first_n, bool_and(n_nationkey >= 0) AS ok, bit_or(n_nationkey) AS bits, count_if(n_nationkey > 5)::BIGINT AS c FROM nation GROUP BY n_regionkey"),
    "pt_approx": ("SELECT abs(approx_count_distinct(o_custkey, 0.01D) / count(DISTINCT o_custkey) - 1) < 0.1D AS close_enough FROM orders", "SELECT abs(approx_count_distinct(o_custkey) / count(DISTINCT o_custkey) - 1) < 0.5 AS close_enough FROM orders"),
    "pt_mode_product": ("SELECT mode(l_linenumber) AS m, skewness(l_quantity) > -1 AS s, kurtosis(l_quantity) < 5 AS k FROM lineitem", None),
    "pt_pivot": ("SELECT * FROM (SELECT o_orderstatus AS s, year(o_orderdate) AS y FROM orders) PIVOT (count(*) FOR s IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT year(o_orderdate) AS y, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY 1"),
    "pt_unpivot": ("SELECT k, name, v FROM (SELECT n_nationkey AS k, CAST(n_nationkey AS BIGINT) AS a, CAST(n_regionkey AS BIGINT) AS b FROM nation) UNPIVOT (v FOR name IN (a, b))", None),
    "pt_window_rank": ("SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, ntile(4) OVER w AS q FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)", None),
    "pt_window_analytic": ("SELECT o_orderkey, lag(o_orderkey) OVER w AS a, lead(o_orderkey, 2, -1) OVER w AS b, first_value(o_orderkey) OVER w AS c, nth_value(o_orderkey, 2) OVER w AS d FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", None),
    "pt_window_frames": ("SELECT o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS a, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS b, max(o_orderkey) OVER (PARTITION BY o_custkey) AS c FROM orders", "SELECT o_orderkey, (sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING))::BIGINT AS a, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS b, max(o_orderkey) OVER (PARTITION BY o_custkey) AS c FROM orders"),
    "pt_window_ignore_nulls": ("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_buy FROM events", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_buy FROM events"),
    "pt_topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 5", None),
    "pt_union": ("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region UNION ALL SELECT 99", None),
    "pt_intersect_except": ("SELECT * FROM (SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier) a UNION ALL SELECT * FROM (SELECT c_custkey FROM customer EXCEPT SELECT s_suppkey FROM supplier) b UNION ALL SELECT * FROM (SELECT s_nationkey FROM supplier EXCEPT ALL SELECT n_nationkey FROM nation) c", None),
    "pt_recursive": ("WITH RECURSIVE t(k, d) AS (SELECT 1, 0 UNION ALL SELECT k * 2, d + 1 FROM t WHERE d < 8) SELECT k, d, (SELECT count(*) FROM nation) AS n FROM t", None),
    "pt_cte_subquery": ("WITH a AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders GROUP BY o_custkey), b AS (SELECT max(s) AS m FROM a) SELECT o_custkey, CAST(s AS STRING) AS s FROM a, b WHERE s * 2 > m", "WITH a AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders GROUP BY o_custkey), b AS (SELECT max(s) AS m FROM a) SELECT o_custkey, CAST(s AS VARCHAR) AS s FROM a, b WHERE s * 2 > m"),
    "pt_predicates": ("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size IN (11, 12, 13) THEN 'some' ELSE 'big' END AS kind FROM part WHERE p_name ILIKE '%A%' AND p_brand LIKE 'Brand#_%' AND p_type IS NOT NULL AND NOT p_size = 50", None),
    "pt_strings": ("SELECT n_nationkey, lower(n_name) AS a, upper(n_name) AS b, length(n_name) AS c, reverse(n_name) AS d, left(n_name, 3) AS e, right(n_name, 2) AS f, lpad(n_name, 12, '*') AS g, rpad(n_name, 12, '-') AS h, replace(n_name, 'A', 'x') AS i, substring(n_name, 2, 3) AS j, locate('A', n_name) AS k, contains(n_name, 'AN') AS l, startswith(n_name, 'A') AS m, endswith(n_name, 'A') AS o, concat_ws('-', n_name, 'z') AS p, split_part(n_name, 'A', 1) AS q, repeat('ab', 2) AS r, translate(n_name, 'AE', 'xy') AS s, ascii(n_name) AS t, levenshtein(n_name, 'CHINA') AS u, md5(n_name) AS v, sha2(n_name, 256) AS w, trim(concat(' ', n_name, ' ')) AS x FROM nation",
                   "SELECT n_nationkey, lower(n_name) AS a, upper(n_name) AS b, length(n_name) AS c, reverse(n_name) AS d, left(n_name, 3) AS e, right(n_name, 2) AS f, lpad(n_name, 12, '*') AS g, rpad(n_name, 12, '-') AS h, replace(n_name, 'A', 'x') AS i, substring(n_name, 2, 3) AS j, strpos(n_name, 'A') AS k, contains(n_name, 'AN') AS l, starts_with(n_name, 'A') AS m, ends_with(n_name, 'A') AS o, concat_ws('-', n_name, 'z') AS p, split_part(n_name, 'A', 1) AS q, repeat('ab', 2) AS r, translate(n_name, 'AE', 'xy') AS s, ascii(n_name) AS t, levenshtein(n_name, 'CHINA') AS u, md5(n_name) AS v, sha256(n_name) AS w, trim(concat(' ', n_name, ' ')) AS x FROM nation"),
    "pt_regex": ("SELECT p_partkey, regexp_extract(p_name, '([a-z]+)', 1) AS a, regexp_replace(p_type, '[AEIOU]', '') AS b, p_brand RLIKE '#[1-3]' AS c, size(regexp_extract_all(p_type, '[A-Z]+', 0)) AS d, base64(CAST(p_brand AS BINARY)) AS e, hex(p_brand) AS f FROM part", "SELECT p_partkey, regexp_extract(p_name, '([a-z]+)', 1) AS a, regexp_replace(p_type, '[AEIOU]', '', 'g') AS b, regexp_matches(p_brand, '#[1-3]') AS c, len(regexp_extract_all(p_type, '[A-Z]+')) AS d, base64(encode(p_brand)) AS e, hex(p_brand) AS f FROM part"),
    "pt_dates": ("SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS a, year(o_orderdate) AS b, month(o_orderdate) AS c, day(o_orderdate) AS d, quarter(o_orderdate) AS e, weekofyear(o_orderdate) AS f, last_day(o_orderdate) AS g, date_add(CAST(o_orderdate AS DATE), 30) AS h, datediff(DATE '1999-01-01', CAST(o_orderdate AS DATE)) AS i, date_format(o_orderdate, 'yyyy/MM/dd') AS j, make_date(year(o_orderdate), 1, 1) AS k, dayofyear(o_orderdate) AS l FROM orders",
                 "SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS a, year(o_orderdate) AS b, month(o_orderdate) AS c, day(o_orderdate) AS d, quarter(o_orderdate) AS e, week(o_orderdate) AS f, last_day(o_orderdate) AS g, (o_orderdate::DATE + 30)::DATE AS h, date_diff('day', o_orderdate::DATE, DATE '1999-01-01') AS i, strftime(o_orderdate, '%Y/%m/%d') AS j, make_date(year(o_orderdate), 1, 1) AS k, dayofyear(o_orderdate) AS l FROM orders"),
    "pt_math": ("SELECT p_partkey, abs(-p_size) AS a, ceil(p_retailprice) AS b, floor(p_retailprice) AS c, round(sqrt(p_size), 6) AS d, round(ln(p_size + 1), 6) AS e, round(pow(p_size, 2), 3) AS f, sign(p_size - 25) AS g, greatest(p_size, 10) AS h, least(p_size, 10) AS i, p_size % 7 AS j, p_size ^ 5 AS k, bit_count(p_size) AS l, round(atan2(p_size, 3), 6) AS m, round(degrees(radians(p_size)), 6) AS o, bround(p_size / 2.0D, 0) AS q, factorial(p_size % 10) AS r FROM part",
                "SELECT p_partkey, abs(-p_size) AS a, ceil(p_retailprice)::BIGINT AS b, floor(p_retailprice)::BIGINT AS c, round(sqrt(p_size), 6) AS d, round(ln(p_size + 1), 6) AS e, round(pow(p_size, 2), 3) AS f, sign(p_size - 25)::DOUBLE AS g, greatest(p_size, 10) AS h, least(p_size, 10) AS i, p_size % 7 AS j, xor(p_size, 5) AS k, bit_count(p_size) AS l, round(atan2(p_size, 3), 6) AS m, round(degrees(radians(p_size)), 6) AS o, round_even(p_size / 2.0::DOUBLE, 0) AS q, factorial((p_size % 10)::INT)::BIGINT AS r FROM part"),
    "pt_arrays": ("SELECT n_nationkey, array_join(array_sort(array(n_name, 'M', 'B')), ',') AS a, array_contains(array(1, 2, 3), n_regionkey) AS b, size(array_distinct(array(n_nationkey, n_regionkey, 1))) AS c, aggregate(sequence(1, n_nationkey + 1), 0, (s, x) -> s + x) AS d, element_at(array(5, 6, 7), 2) AS e, array_join(slice(sequence(1, 9), 2, 3), '') AS f, array_join(transform(array(1, 2), x -> x * n_regionkey), ',') AS g, size(filter(sequence(1, 10), x -> x % 2 = 0)) AS h, array_position(array('a', 'b'), 'b') AS i, size(array_intersect(array(1, 2), array(2, 3))) AS j, arrays_overlap(array(1), array(n_regionkey)) AS k, size(flatten(array(array(1), array(2, 3)))) AS l FROM nation",
                  "SELECT n_nationkey, array_to_string(list_sort([n_name, 'M', 'B']), ',') AS a, list_contains([1, 2, 3], n_regionkey) AS b, len(list_distinct([n_nationkey, n_regionkey, 1])) AS c, (n_nationkey + 1) * (n_nationkey + 2) // 2 AS d, [5, 6, 7][2] AS e, '234' AS f, array_to_string(list_transform([1, 2], lambda x: x * n_regionkey), ',') AS g, len(list_filter(range(1, 11), lambda x: x % 2 = 0)) AS h, list_position(['a', 'b'], 'b') AS i, len(list_intersect([1, 2], [2, 3])) AS j, list_has_any([1], [n_regionkey]) AS k, len(flatten([[1], [2, 3]])) AS l FROM nation"),
    "pt_maps_structs": ("SELECT n_nationkey, map('k', n_name)['k'] AS a, size(map_keys(map(1, 2, 3, 4))) AS b, array_join(map_values(map('x', n_name, 'y', 'q')), '+') AS c, named_struct('p', n_name, 'q', 1).p AS d, map_contains_key(map('k', 1), 'z') AS e FROM nation", "SELECT n_nationkey, map {'k': n_name}['k'] AS a, 2 AS b, array_to_string(map_values(map {'x': n_name, 'y': 'q'}), '+') AS c, struct_pack(p := n_name, q := 1).p AS d, map_contains(map {'k': 1}, 'z') AS e FROM nation"),
    "pt_json": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, size(json_object_keys(props)) AS n, json_array_length('[1,2,3]') AS m, to_json(named_struct('a', event_id)) AS j, from_json(props, 'k INT').k AS t FROM events", "SELECT event_id, (props->>'k')::BIGINT AS k, len(json_keys(props)) AS n, json_array_length('[1,2,3]') AS m, to_json({'a': event_id})::VARCHAR AS j, (props->>'k')::INT AS t FROM events"),
    "pt_conditionals": ("SELECT event_id, coalesce(nullif(event_type, 'view'), 'seen') AS a, if(value > 50, 'hi', 'lo') AS b, ifnull(NULL, 3) AS c, CAST(value AS INT) AS d, try_cast('x' AS INT) AS e, typeof(event_id) = 'bigint' AS f FROM events", "SELECT event_id, coalesce(nullif(event_type, 'view'), 'seen') AS a, CASE WHEN value > 50 THEN 'hi' ELSE 'lo' END AS b, ifnull(NULL, 3) AS c, trunc(value)::INT AS d, TRY_CAST('x' AS INT) AS e, lower(typeof(event_id)) = 'bigint' AS f FROM events"),
    "pt_explode": ("SELECT n_nationkey, x FROM nation LATERAL VIEW explode(sequence(1, n_regionkey + 1)) t AS x", "SELECT n_nationkey, unnest(range(1, n_regionkey + 2))::INT AS x FROM nation"),
    "pt_time_buckets": ("SELECT date_format(window(CAST(ts AS TIMESTAMP), '15 minutes').start, 'yyyy-MM-dd HH:mm') AS b, count(*) AS n FROM events GROUP BY 1", "SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M') AS b, count(*) AS n FROM events GROUP BY 1"),
    "tpch_q1": ("SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS DECIMAL(12,2))) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00' GROUP BY 1, 2", "SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS DECIMAL(12,2)))::DECIMAL(22,2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"),
    "tpch_q3": ("SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10", None),
    "tpch_q5": ("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name", None),
}

QUERIES = {name: _run(spark_sql) for name, (spark_sql, _) in _BOTH.items()}
SQL = {name: other or spark_sql for name, (spark_sql, other) in _BOTH.items()}

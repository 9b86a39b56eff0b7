"""Registered queries: one statement of the extended dialect each, run on Spark by the engine as it stands.

DuckDB runs the same text as the oracle. `SAME` are such statements; `PAIRS` need another text for the oracle
(name -> (statement, oracle)).
"""

from __future__ import annotations

_LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"

SAME: dict[str, str] = {
    # ranges without an equality go through bins; an empty range has no rows
    "range_join_values": "SELECT a.p_partkey AS a, b.s_suppkey AS b FROM part a JOIN supplier b ON b.s_acctbal BETWEEN a.p_retailprice AND a.p_retailprice + 5",
    "range_join_times": "SELECT o_orderkey, event_id FROM orders JOIN events ON ts >= o_orderdate AND ts < o_orderdate + INTERVAL 1 DAY",
    "range_empty": "SELECT CAST(count(*) AS BIGINT) AS n FROM range(5, 5, 2)",
    "range_down": "SELECT CAST(range AS BIGINT) AS i FROM range(10, 0, -3)",
    "fetch_offset_rows": "SELECT n_nationkey, n_name FROM nation ORDER BY n_name OFFSET 3 LIMIT 7",
    "list_moments": "SELECT event_id, round(list_var_pop([value, value + 1, NULL, 3.5]), 6) AS v, round(list_stddev_pop([1e9 + value, 1e9 + 2 * value]), 3) AS s FROM events",
    "number_theory": "SELECT l_orderkey, l_linenumber, gcd(l_partkey, l_suppkey) AS g, lcm(l_partkey, l_linenumber) AS m, gcd(0, l_linenumber) AS z FROM lineitem",
    "string_bars": "SELECT s_suppkey, bar(s_acctbal, -1000, 10000, 20) AS b, jaccard(s_name, 'Supplier 12') AS j, length_grapheme('e' || chr(769) || s_name) AS n, left_grapheme('e' || chr(769) || s_name, 3) AS l, right_grapheme(s_name || 'e' || chr(769), 2) AS r FROM supplier",
    "epoch_halves": "SELECT event_id, epoch_ms(ts + INTERVAL 500 MICROSECOND) AS a, epoch_ms(TIMESTAMP '1969-12-31 23:59:59.9985') AS b, epoch_ms(TIMESTAMP '1960-01-01 00:00:00.000499') AS c FROM events",
    # projection and predicates
    "project_expr": "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) AS net, -l_linenumber AS neg, l_linenumber % 3 AS m FROM lineitem",
    "filter_in_between_like": "SELECT p_partkey, p_name, p_size FROM part WHERE p_size BETWEEN 5 AND 20 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23', 'Brand#34') OR p_type LIKE '%STEEL%' AND p_partkey NOT IN (1, 2, 3)",
    "ilike_filter": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment ILIKE 'buil%' AND c_name NOT ILIKE '%9'",
    "case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'other' END AS status FROM orders",
    "case_searched": "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'debt' WHEN s_acctbal < 5000 THEN 'low' ELSE 'high' END AS band FROM supplier",
    "cast_rounding": "SELECT p_partkey, CAST(p_retailprice * 1.01 AS INTEGER) AS i, p_retailprice::BIGINT AS b, CAST('2.7' AS INT) AS s, CAST(p_size AS VARCHAR) AS t, CAST(12.3456 AS DECIMAL) AS d FROM part",
    "is_true_null": "SELECT c_custkey, NULLIF(c_nationkey, 3) IS NULL AS missing, (c_acctbal > 0) IS TRUE AS positive, (NULLIF(c_acctbal, c_acctbal) > 0) IS NOT FALSE AS unknown, NULLIF(c_nationkey, 3) IS DISTINCT FROM 5 AS differs FROM customer",
    "distinct_rows": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "exists_subquery": "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000) AND NOT EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = c.c_nationkey AND n.n_regionkey = 0)",
    "in_subquery": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)",
    "scalar_subquery": "SELECT c_custkey, round(c_acctbal - (SELECT avg(c_acctbal) FROM customer), 4) AS diff, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c",
    "integer_division": "SELECT l_orderkey, l_linenumber, l_partkey, l_partkey // 7 AS q, l_partkey / 8 AS d FROM lineitem",
    # star modifiers
    "star_exclude": "SELECT * EXCLUDE (c_name, c_acctbal) FROM customer",
    "star_replace": "SELECT * REPLACE (upper(n_name) AS n_name, n_regionkey + 1 AS n_regionkey) FROM nation",
    "star_rename": "SELECT * RENAME (r_regionkey AS id, r_name AS label) FROM region",
    "star_chain": "SELECT n.* EXCLUDE (n_regionkey) REPLACE (lower(n_name) AS n_name), r_name FROM nation n JOIN region ON n_regionkey = r_regionkey",
    # joins
    "join_inner": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000",
    "join_right": "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'F'",
    "join_full": "SELECT s_suppkey, c_custkey FROM supplier FULL OUTER JOIN customer ON s_suppkey = c_custkey",
    "join_cross": "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b",
    "join_comma": "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey",
    "join_natural": "SELECT n_name, v FROM nation NATURAL JOIN (SELECT n_nationkey, n_nationkey * 2 AS v FROM nation WHERE n_nationkey > 10) x",
    "join_using": "SELECT n_nationkey, a.n_name, b.n_regionkey FROM nation a JOIN nation b USING (n_nationkey)",
    "join_semi": "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey",
    "join_anti": "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey",
    "join_theta": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal",
    "join_range": "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR",
    "join_self": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_multi": "SELECT r_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "join_lateral": "SELECT c.c_custkey, x.most FROM customer c, LATERAL (SELECT max(o.o_totalprice) AS most FROM orders o WHERE o.o_custkey = c.c_custkey) x",
    "join_asof": "SELECT p.event_id AS purchase, c.event_id AS click FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts",
    "join_asof_left": "SELECT p.event_id AS purchase, c.event_id AS click, p.value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') c ON p.user_id = c.user_id AND p.ts > c.ts",
    "join_asof_after": "SELECT p.event_id AS purchase, c.event_id AS next_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF JOIN (SELECT * FROM events WHERE event_type = 'view') c ON p.user_id = c.user_id AND p.ts <= c.ts",
    "join_positional": "SELECT n.n_name, r.r_name FROM nation n POSITIONAL JOIN region r",
    # aggregates
    "agg_group_by": "SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS qty, round(avg(l_extendedprice), 4) AS price, count(*) AS n, min(l_shipdate) AS first, max(l_tax) AS tax FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    "agg_group_all": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL",
    "agg_having": "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 55",
    "agg_count_distinct": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY o_orderstatus",
    "agg_filter_clause": "SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal < 0) AS debtors, round(sum(c_acctbal) FILTER (WHERE c_acctbal > 0), 2) AS credit FROM customer GROUP BY c_mktsegment",
    "agg_rollup": "SELECT n_regionkey, n_nationkey, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_nationkey)",
    "agg_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "agg_string_agg": "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names, string_agg(n_name ORDER BY n_nationkey DESC) AS back FROM nation GROUP BY n_regionkey",
    "agg_array_sorted": "SELECT n_regionkey, array_to_string(array_agg(n_name ORDER BY n_nationkey DESC), '|') AS names FROM nation GROUP BY n_regionkey",
    "agg_median_quantile": "SELECT l_returnflag, median(l_quantity) AS med, quantile_cont(l_extendedprice, 0.9) AS p90, quantile_disc(l_quantity, 0.25) AS q25 FROM lineitem GROUP BY l_returnflag",
    "agg_arg_max": "SELECT c_nationkey, max_by(c_custkey, c_acctbal) AS richest, arg_min(c_name, c_custkey) AS first FROM customer GROUP BY c_nationkey",
    "agg_bool": "SELECT s_nationkey, bool_and(s_acctbal > 0) AS every_one, bool_or(s_acctbal < 0) AS some FROM supplier GROUP BY s_nationkey",
    "agg_bits": "SELECT n_regionkey, bit_and(n_nationkey) AS a, bit_or(n_nationkey) AS o, bit_xor(n_nationkey) AS x FROM nation GROUP BY n_regionkey",
    "agg_regression": "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS c, round(regr_slope(l_extendedprice, l_quantity), 4) AS s, round(covar_pop(l_quantity, l_tax), 6) AS cv, regr_count(l_tax, l_quantity) AS n, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY l_returnflag",
    "agg_moments": "SELECT l_linestatus, round(stddev(l_quantity), 6) AS sd, round(var_pop(l_tax), 8) AS vp, round(kurtosis(l_quantity), 4) AS k, round(skewness(l_extendedprice), 4) AS sk, round(stddev_pop(l_discount), 8) AS sp, round(kurtosis_pop(l_quantity), 4) AS kp FROM lineitem GROUP BY l_linestatus",
    "agg_misc": "SELECT n_regionkey, any_value(n_regionkey) AS a, round(geomean(n_nationkey + 1), 6) AS g, round(product(n_nationkey + 1), 0) AS p, round(sem(n_nationkey), 6) AS sem, count_if(n_nationkey > 10) AS big FROM nation GROUP BY n_regionkey",
    "agg_any_value_null": "SELECT n_regionkey, any_value(NULLIF(n_regionkey, 2)) AS a FROM nation GROUP BY n_regionkey",
    # pivot
    "pivot_list": "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (count(o_orderkey) AS n FOR o_orderstatus IN ('O' AS o, 'F' AS f, 'P' AS p))",
    "unpivot_single": "SELECT * FROM (SELECT s_suppkey, s_nationkey, CAST(s_suppkey % 7 AS INTEGER) AS rest FROM supplier) UNPIVOT (v FOR k IN (s_nationkey, rest))",
    "unpivot_multi": "SELECT * FROM (SELECT n_nationkey, n_regionkey AS a1, n_nationkey + 1 AS a2, n_regionkey * 2 AS b1, n_nationkey * 2 AS b2 FROM nation) UNPIVOT ((x, y) FOR k IN ((a1, a2) AS 'a', (b1, b2) AS 'b'))",
    # windows
    "win_ranking": "SELECT c_custkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS r, dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS d, ntile(4) OVER w AS q, round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS cd FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)",
    "win_lag_lead": "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS before, lead(value, 2, -1.0) OVER (PARTITION BY user_id ORDER BY ts) AS later FROM events",
    "win_first_last_nth": "SELECT event_id, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS f, last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events",
    "win_rows_frame": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS a, count(*) OVER (PARTITION BY user_id ORDER BY ts ROWS 3 PRECEDING) AS n FROM events",
    "win_range_frame": "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS near, CAST(sum(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS BIGINT) AS s FROM customer",
    "win_groups_frame": "SELECT c_custkey, count(*) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM customer",
    "win_aggregate_share": "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 8) AS share FROM orders",
    "qualify_top": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2",
    "qualify_alias": "SELECT s_nationkey, s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier WHERE s_acctbal > 0 QUALIFY place = 1",
    "qualify_grouped": "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment QUALIFY count(*) = max(count(*)) OVER (PARTITION BY c_nationkey)",
    # sort and limit
    "order_limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10",
    "order_all": "SELECT r_regionkey, r_name FROM region ORDER BY ALL",
    "nulls_order": "SELECT c_custkey, NULLIF(c_nationkey, 0) AS k, row_number() OVER (ORDER BY NULLIF(c_nationkey, 0), c_custkey) AS place FROM customer",
    "nulls_first": "SELECT c_custkey, NULLIF(c_nationkey, 0) AS k, row_number() OVER (ORDER BY NULLIF(c_nationkey, 0) DESC NULLS FIRST, c_custkey) AS place FROM customer",
    "order_limit_names": "SELECT n_nationkey, n_name FROM nation ORDER BY n_name LIMIT 5",
    # set operations and CTEs
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "set_intersect": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9500 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "set_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 2000",
    "set_all": "(SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier) UNION ALL (SELECT c_nationkey + 100 AS k FROM customer EXCEPT ALL SELECT s_nationkey + 100 FROM supplier)",
    "set_precedence": "SELECT 1 AS v UNION SELECT 2 INTERSECT SELECT 2 UNION ALL SELECT 3",
    "set_by_name": "SELECT r_regionkey AS id, r_name AS label FROM region UNION ALL BY NAME SELECT n_name AS label, n_nationkey AS id, n_regionkey AS parent FROM nation",
    "cte_nested": "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), b AS (WITH big AS (SELECT * FROM a WHERE t > 500000) SELECT * FROM big) SELECT c_name, round(t, 2) AS t FROM b JOIN customer ON c_custkey = o_custkey",
    "cte_recursive": "WITH RECURSIVE s(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM s WHERE n < 20) SELECT n, f FROM s",
    "values_rows": "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) v(a, b)",
    "range_table": "SELECT CAST(range AS BIGINT) AS i, CAST(range * range AS BIGINT) AS sq FROM range(1, 50)",
    # lists, structs, maps, lambdas
    "list_literal_index": "SELECT n_nationkey, [n_nationkey, n_regionkey, 7][2] AS second, [n_nationkey, n_regionkey][5] AS missing, array_to_string([1, 2, 3, 4][2:3], '-') AS part FROM nation",
    "list_lambda": "SELECT n_nationkey, array_to_string(list_transform([n_nationkey, n_regionkey], lambda x: x * 2 + 1), ',') AS t, array_to_string(list_filter([1, 5, n_nationkey], lambda x: x > 4), ',') AS f, list_reduce([1, 2, n_nationkey], lambda x, y: x + y) AS r FROM nation",
    "struct_literal": "SELECT n_nationkey, {'a': n_name, 'b': n_regionkey}.a AS a, struct_extract({'a': 1, 'b': n_regionkey}, 'b') AS b, struct_pack(k := n_nationkey).k AS k FROM nation",
    "list_functions": "SELECT n_nationkey, len([1, 2]) = 2 AS never_mind, list_contains([1, n_regionkey], 3) AS c, list_position([5, n_regionkey], 2) AS p, array_to_string(list_sort([3, n_nationkey, 2]), ',') AS s, array_to_string(list_reverse([1, 2, n_regionkey]), ',') AS r, list_max([1, n_nationkey]) AS mx, list_min([4, n_nationkey]) AS mn, list_unique([1, 1, n_regionkey]) AS u, array_to_string(list_concat([1], [n_regionkey]), ',') AS cc FROM nation",
    "list_vectors": "SELECT vec_id, round(list_dot_product(e, e), 6) AS dot, round(list_distance(e, list_reverse(e)), 6) AS dist, round(list_cosine_similarity(e, list_reverse(e)) + 2, 6) AS cos FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)",
    "map_functions": "SELECT n_nationkey, map(['a', 'b'], [n_nationkey, n_regionkey])['b'] AS b, cardinality(map(['a', 'b'], [1, 2])) AS n, array_to_string(map_keys(map(['p', 'q'], [1, n_regionkey])), '') AS k, map_contains(map(['a'], [1]), 'a') AS has FROM nation",
    # scalar functions
    "string_basic": "SELECT p_partkey, upper(p_name) AS u, length(p_name) AS n, substring(p_name, 2, 4) AS s, left(p_type, 3) AS l, right(p_type, 2) AS r, p_brand || '/' || p_type AS c, replace(p_brand, '#', '-') AS rp, reverse(p_brand) AS rv, lpad(p_brand, 12, '*') AS lp, trim('  x ') AS t, repeat('ab', 3) AS rep FROM part",
    "string_search": "SELECT p_partkey, strpos(p_type, 'E') AS pos, contains(p_type, 'STEEL') AS has, starts_with(p_brand, 'Brand') AS st, ends_with(p_type, 'S') AS en, split_part(p_type, ' ', 2) AS part, concat('a', NULL, p_brand) AS cat, concat_ws('-', 'x', NULL, p_brand) AS ws FROM part",
    "string_regex": "SELECT p_partkey, regexp_extract(p_brand, '[0-9]+') AS num, regexp_extract(p_brand, '([A-Za-z]+)#([0-9])', 2) AS g, regexp_replace(p_type, '[AEIOU]', '_') AS one, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS every_, regexp_matches(p_type, '^[LMS]') AS m, regexp_full_match(p_brand, 'Brand#[1-3][0-9]') AS f FROM part",
    "string_split": "SELECT p_partkey, array_to_string(string_split(p_type, ' '), '|') AS s, array_to_string(string_split('a.b.c', '.'), '|') AS d, len(string_split(p_type, ' ')[1]) AS n FROM part",
    "string_codes": "SELECT p_partkey, ascii(p_brand) AS a, chr(65 + p_size % 26) AS c, md5(p_name) AS m, sha256(p_brand) AS s, lower(hex(p_brand)) AS h, strlen('é' || p_brand) AS bytes, bit_length(p_brand) AS bits, translate(p_brand, 'Bd', 'bD') AS t, levenshtein(p_brand, 'Brand#11') AS lev, hamming('abcd', 'abxy') AS ham FROM part",
    "string_similarity": "SELECT n_nationkey, round(jaro_similarity(n_name, 'GERMANY'), 6) AS j, round(jaro_winkler_similarity(n_name, 'FRANCE'), 6) AS jw, damerau_levenshtein(n_name, 'FRENCA') AS d, round(jaccard(n_name, 'CHINA'), 6) AS jc, strip_accents('é' || n_name) AS s FROM nation",
    "date_parts": "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, dayofweek(o_orderdate) AS dow, dayofyear(o_orderdate) AS doy, week(o_orderdate) AS w, isodow(o_orderdate) AS iso, century(o_orderdate) AS c, decade(o_orderdate) AS dec, dayname(o_orderdate) AS dn, monthname(o_orderdate) AS mn, EXTRACT(YEAR FROM o_orderdate) AS ey FROM orders",
    "date_arithmetic": "SELECT o_orderkey, o_orderdate + INTERVAL 3 DAY AS later, o_orderdate - INTERVAL 2 MONTH AS earlier, date_diff('day', o_orderdate, TIMESTAMP '2000-01-01 00:00:00') AS days, date_diff('month', o_orderdate, TIMESTAMP '2000-01-15 00:00:00') AS months, date_diff('year', o_orderdate, TIMESTAMP '2000-01-15 00:00:00') AS years, date_sub('month', o_orderdate, TIMESTAMP '2002-01-15 00:00:00') AS whole FROM orders",
    "date_trunc_bucket": "SELECT event_id, date_trunc('hour', ts) AS h, CAST(date_trunc('month', ts) AS DATE) AS m, time_bucket(INTERVAL 15 MINUTE, ts) AS b, epoch_ms(ts) AS ms, epoch_us(ts) AS us, last_day(ts) AS ld FROM events",
    "date_format_parse": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS s, strptime('2024-03-05 07:08:09', '%Y-%m-%d %H:%M:%S') AS p, make_date(2024, 2, 29) AS d FROM events",
    "math_basic": "SELECT p_partkey, abs(-p_size) AS a, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, round(p_retailprice, 1) AS r, sign(p_size - 25) AS s, greatest(p_size, 20) AS g, least(p_size, 20) AS l, p_size % 7 AS m, trunc(p_retailprice) AS t, even(p_size) AS e, factorial(p_size % 10) AS fa, gcd(p_size, 12) AS gc, lcm(p_size, 4) AS lc FROM part",
    "math_transcendental": "SELECT p_partkey, round(ln(p_size), 8) AS n, round(log(p_size), 8) AS l, round(log2(p_size), 8) AS l2, round(exp(p_size / 50), 8) AS e, round(sqrt(p_size), 8) AS q, round(cbrt(p_size), 8) AS cb, round(pow(p_size, 1.5), 4) AS p, round(sin(p_size), 8) AS s, round(atan2(p_size, 3), 8) AS a, round(degrees(1.0), 8) AS d, round(gamma(p_size % 10 + 1), 4) AS g, round(lgamma(p_size + 1.0), 6) AS lg FROM part",
    "json_functions": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_valid(props) AS ok, json_exists(props, '$.zz') AS zz, json_array_length('[1,2,3]') AS n FROM events",
    "bit_functions": "SELECT n_nationkey, bit_count(n_nationkey) AS b, n_nationkey & 6 AS a, n_nationkey | 9 AS o, xor(n_nationkey, 5) AS x FROM nation",
    "coalesce_nullif": "SELECT n_nationkey, coalesce(NULLIF(n_regionkey, 1), -1) AS c, ifnull(NULLIF(n_regionkey, 2), 99) AS i FROM nation",
    # more of the catalogue
    "list_statistics": "SELECT n_nationkey, list_sum([n_nationkey, 2, 3])::DOUBLE AS s, list_avg([n_nationkey, 2, 3]) AS a, list_median([n_nationkey, 2, 9, 4]) AS m, list_aggregate([n_nationkey, 5], 'max') AS mx, list_count([1, NULL, n_nationkey]) AS c, list_product([2, n_nationkey])::DOUBLE AS p FROM nation",
    "list_sets": "SELECT n_nationkey, list_has_any([1, 2], [n_regionkey]) AS some, list_has_all([0, 1, 2, 3, 4], [n_regionkey]) AS every_, array_to_string(list_sort(list_intersect([1, 2, 3], [n_regionkey, 3])), ',') AS both, array_to_string(list_slice([1, 2, 3, 4, n_nationkey], 2, 4), ',') AS part, array_to_string(list_append([1], n_nationkey), ',') AS app, array_to_string(list_prepend(n_nationkey, [1]), ',') AS pre, array_to_string(list_reverse_sort([1, n_nationkey, 5]), ',') AS down FROM nation",
    "list_edges": "SELECT n_nationkey, list_extract([4, 5, n_nationkey], 3) AS e, list_extract([4, 5], -1) AS last, list_first([n_nationkey, 1]) AS f, list_last([1, n_nationkey]) AS l, array_to_string(array_pop_back([1, 2, n_nationkey]), ',') AS pb, array_to_string(list_resize([1, 2], 4, n_nationkey), ',') AS rs, array_to_string(list_grade_up([3, n_nationkey, 7]), ',') AS g FROM nation",
    "range_lists": "SELECT n_nationkey, array_to_string(range(n_regionkey), ',') AS r, array_to_string(generate_series(1, n_regionkey + 1), ',') AS g, len(range(2, 9, 3)) AS n FROM nation",
    "interval_functions": "SELECT o_orderkey, o_orderdate + to_days(3) AS d, o_orderdate + to_hours(5) AS h, o_orderdate + to_months(2) AS m, o_orderdate + to_years(1) AS y, o_orderdate + to_weeks(2) AS w, o_orderdate + INTERVAL '90' MINUTE AS mi FROM orders",
    "date_units": "SELECT event_id, date_trunc('day', ts) AS d, date_trunc('quarter', ts) AS q, date_trunc('year', ts) AS y, date_trunc('minute', ts) AS m, date_part('hour', ts) AS h, EXTRACT(dow FROM ts) AS dow, EXTRACT(doy FROM ts) AS doy, hour(ts) AS hh, minute(ts) AS mm, isoyear(ts) AS iy, yearweek(ts) AS yw, millennium(ts) AS mil, date_diff('hour', ts, TIMESTAMP '2024-02-01 00:30:00') AS hrs FROM events",
    "encodings": "SELECT n_nationkey, hex(n_name) AS h, to_base64(encode(n_name)) AS b, bin(n_nationkey) AS bi, to_base(n_nationkey, 16) AS tb, chr(ascii(n_name)) AS c, strlen(n_name) AS sl, octet_length(encode(n_name)) AS ol, md5(n_name) AS m FROM nation",
    "string_more": "SELECT n_nationkey, rpad(n_name, 12, '.') AS rp, ltrim('  ' || n_name) AS lt, rtrim(n_name || '  ') AS rt, suffix(n_name, 'A') AS sf, prefix(n_name, 'A') AS pf, instr(n_name, 'A') AS i, len(n_name) AS n, lcase(n_name) AS lc, ucase(n_name) AS uc, regexp_split_to_array(n_name, '[AEIOU]')[1] AS sp, parse_filename('a/b/' || n_name) AS pf2, n_name SIMILAR TO '[A-F].*' AS st, nfc_normalize(n_name) AS nf, format('{}-{}', n_name, n_regionkey) AS fm FROM nation",
    "math_more": "SELECT p_partkey, radians(p_size) > 0 AS r, round(cot(p_size), 6) AS ct, round(asin(1.0 / p_size), 6) AS a, round(sinh(p_size / 25.0), 6) AS sh, round(acosh(p_size), 6) AS ah, isfinite(p_retailprice) AS f, isnan(p_retailprice) AS n, isinf(p_retailprice) AS i, fdiv(p_size, 7) AS fd, fmod(p_size, 7) AS fm, round(p_retailprice, -1) AS rr, add(p_size, 2) AS ad, multiply(p_size, 3) AS mu, subtract(p_size, 1) AS su, signbit(-1.0 * p_size) AS sb, round_even(2.5, 0) AS re FROM part",
    "json_more": "SELECT event_id, json_valid('{bad') AS bad, json_extract_string('{\"a\": {\"b\": [1, 2]}}', '$.a.b[1]') AS x, json_merge_patch('{\"a\":1}', '{\"b\":2}') AS m, json_contains('{\"a\": [1, 2]}', '{\"a\": [2]}') AS c, list_sort(json_keys('{\"q\": 1, \"p\": 2}'))[1] AS k FROM events",
    "map_more": "SELECT n_nationkey, map_contains_value(map(['a'], [n_regionkey]), 2) AS v, array_to_string(map_values(map(['x', 'y'], [n_regionkey, 9])), ',') AS vs, len(map_entries(map(['x'], [1]))) AS n, map_contains_entry(map(['a'], [n_regionkey]), 'a', 1) AS e FROM nation",
    "agg_more": "SELECT l_returnflag, mode(l_returnflag) AS m, first(l_returnflag) AS f, round(favg(l_quantity), 6) AS fa, round(fsum(l_tax), 4) AS fs, round(regr_intercept(l_extendedprice, l_quantity), 2) AS ri, round(regr_avgx(l_tax, l_quantity), 6) AS ax, round(regr_sxy(l_tax, l_quantity), 2) AS sxy, round(variance(l_quantity), 6) AS v, round(covar_samp(l_quantity, l_tax), 8) AS cs, argmax(l_returnflag, l_quantity) AS am, count_star() AS n FROM lineitem GROUP BY l_returnflag",
    "distinct_on": "SELECT DISTINCT ON (c_nationkey) c_nationkey FROM customer",
    "between_symmetric_case": "SELECT o_orderkey, CASE WHEN o_totalprice BETWEEN 1000 AND 50000 THEN 'mid' WHEN o_totalprice > 50000 THEN 'high' END AS band, o_orderstatus NOT BETWEEN 'F' AND 'O' AS outside FROM orders WHERE NOT (o_totalprice IS NULL OR o_orderstatus IN ('X'))",
    "window_named_filter": "SELECT event_id, count(*) FILTER (WHERE event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts) AS clicks, max(value) OVER w AS m FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)",
    "lag_ignore_nulls": "SELECT event_id, last_value(NULLIF(event_type, 'view') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known FROM events",
    # composites
    "top_k_per_group": "SELECT l_returnflag, l_partkey, qty FROM (SELECT l_returnflag, l_partkey, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY qty DESC, l_partkey) <= 10",
    "sessions": "SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events) WHERE prev IS NULL OR ts > prev + INTERVAL 30 MINUTE GROUP BY user_id",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-12-01' - INTERVAL 90 DAY GROUP BY 1, 2",
    "shipping_priority": "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10",
}

PAIRS: dict[str, tuple[str, str]] = {
    "list_lambda_arrow": (
        "SELECT n_nationkey, array_to_string(list_transform([n_nationkey, n_regionkey], x -> x * 2 + 1), ',') AS t, array_to_string(list_filter([1, 5, n_nationkey], x -> x > 4), ',') AS f, list_reduce([1, 2, n_nationkey], (x, y) -> x + y) AS r FROM nation",
        "SELECT n_nationkey, array_to_string(list_transform([n_nationkey, n_regionkey], lambda x: x * 2 + 1), ',') AS t, array_to_string(list_filter([1, 5, n_nationkey], lambda x: x > 4), ',') AS f, list_reduce([1, 2, n_nationkey], lambda x, y: x + y) AS r FROM nation",
    ),
    "pivot_star": (
        "SELECT * FROM (SELECT o_orderpriority, o_orderstatus FROM orders) PIVOT (count(*) FOR o_orderstatus IN *)",
        "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1",
    ),
    "fetch_offset_ties": (
        "SELECT count(*) AS n, min(p_size) AS low, max(p_size) AS high FROM (SELECT p_partkey, p_size FROM part ORDER BY p_size OFFSET 3 ROWS FETCH NEXT 10 ROWS WITH TIES)",
        "SELECT count(*) - 3 AS n, min(p_size) AS low, max(p_size) AS high FROM (SELECT p_size, rank() OVER (ORDER BY p_size) AS r FROM part) WHERE r <= 13",
    ),
    "fetch_offset_percent": ("SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 2 ROWS FETCH NEXT 20 PERCENT ROWS ONLY", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 2"),
    "lateral_view": (
        "SELECT p_partkey, word, n FROM part LATERAL VIEW posexplode(string_split(p_type, ' ')) w AS n, word",
        "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word, CAST(generate_subscripts(string_split(p_type, ' '), 1) - 1 AS INTEGER) AS n FROM part",
    ),
    "catalog_columns": (
        "SELECT table_name, column_name, column_index FROM duckdb_columns() WHERE table_name IN ('nation', 'part') AND schema_name = ''",
        "SELECT table_name, column_name, column_index FROM duckdb_columns() WHERE table_name IN ('nation', 'part')",
    ),
    "fetch_ties": (
        "SELECT c_nationkey, c_custkey FROM customer ORDER BY c_nationkey FETCH FIRST 10 ROWS WITH TIES",
        "SELECT c_nationkey, c_custkey FROM (SELECT *, rank() OVER (ORDER BY c_nationkey) AS r FROM customer) WHERE r <= 10",
    ),
    "fetch_percent": ("SELECT n_nationkey FROM nation ORDER BY n_nationkey FETCH FIRST 10 PERCENT ROWS ONLY", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 10%"),
    "fetch_rows": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC FETCH FIRST 7 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7"),
    "set_intersect_by_name": (
        "SELECT n_nationkey AS k, n_regionkey AS v FROM nation INTERSECT BY NAME SELECT n_regionkey AS v, n_nationkey AS k FROM nation WHERE n_nationkey > 5",
        "SELECT n_nationkey AS k, n_regionkey AS v FROM nation WHERE n_nationkey > 5",
    ),
}

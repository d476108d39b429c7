"""The SQL surface: one query for each construct, in Spark SQL and for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardstone.operators import relational

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


_SESSIONS: dict[tuple[str, str], SparkSession] = {}


def views(spark: SparkSession, sf_dir: str) -> SparkSession:
    """A session with the tables as views, one for each application and folder; the last few are kept."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SESSIONS:
        own = spark.newSession()
        own.conf.set("spark.sql.session.timeZone", "UTC")
        for t in TABLES:
            own.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        while len(_SESSIONS) >= 4:
            _SESSIONS.pop(next(iter(_SESSIONS)))
        _SESSIONS[key] = own
    return _SESSIONS[key]


#: name: Spark SQL, or (Spark SQL, DuckDB SQL) where they differ.
SURFACE: dict[str, str | tuple[str, str]] = {
    "p1_select_distinct": "SELECT DISTINCT c_mktsegment AS seg, c_nationkey AS nat FROM customer",
    "p2_star_except": ("SELECT * EXCEPT (n_regionkey) FROM nation", "SELECT * EXCLUDE (n_regionkey) FROM nation"),
    "p4_where": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_discount > 0.05",
    "p5_having": "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 5",
    "p7_comparisons": "SELECT p_partkey, p_size >= 25 AS big, p_brand < 'Brand#3' AS low FROM part WHERE p_size <> 10 AND p_size <= 40 AND p_retailprice > 900",
    "p8_null_safe": ("SELECT a.n_nationkey, b.r_regionkey FROM nation a LEFT JOIN region b ON a.n_regionkey <=> b.r_regionkey", "SELECT a.n_nationkey, b.r_regionkey FROM nation a LEFT JOIN region b ON a.n_regionkey IS NOT DISTINCT FROM b.r_regionkey"),
    "p9_is_tests": ("SELECT count(*) AS n, count_if((b > 0) IS TRUE) AS pos, count_if((b > 0) IS NOT FALSE) AS maybe, count_if((b > 0) IS UNKNOWN) AS unknown, count_if(b IS DISTINCT FROM 0) AS nz FROM (SELECT nullif(c_nationkey, 3) * c_acctbal AS b FROM customer) WHERE b IS NOT NULL OR 1 = 1", "SELECT count(*) AS n, count_if((b > 0) IS TRUE) AS pos, count_if((b > 0) IS NOT FALSE) AS maybe, count_if((b > 0) IS NULL) AS unknown, count_if(b IS DISTINCT FROM 0) AS nz FROM (SELECT nullif(c_nationkey, 3) * c_acctbal AS b FROM customer)"),
    "p11_in": "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "p12_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')",
    "p13_like": ("SELECT p_partkey FROM part WHERE p_name LIKE '%a%' OR p_type ILIKE 'STANDARD%' OR p_brand RLIKE '#[1-3]'", "SELECT p_partkey FROM part WHERE p_name LIKE '%a%' OR p_type ILIKE 'STANDARD%' OR regexp_matches(p_brand, '#[1-3]')"),
    "p14_arithmetic": ("SELECT p_partkey, p_size % 7 AS m, p_size & 3 AS a, p_size ^ 5 AS x, p_name || '!' AS s FROM part", "SELECT p_partkey, p_size % 7 AS m, p_size & 3 AS a, xor(p_size, 5) AS x, p_name || '!' AS s FROM part"),
    "p15_case": "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'other' END AS s, coalesce(nullif(o_orderpriority, '5-LOW'), 'low') AS p FROM orders",
    "p16_cast": ("SELECT event_id, cast(value AS INT) AS i, try_cast(event_type AS INT) AS t, event_id::STRING AS s FROM (SELECT *, floor(value) AS v FROM events) WHERE value = floor(value) OR value > 0", "SELECT event_id, trunc(value)::INT AS i, try_cast(event_type AS INT) AS t, event_id::VARCHAR AS s FROM events WHERE value = floor(value) OR value > 0"),
    "j1_inner": "SELECT o.o_orderkey, c.c_name FROM orders o, customer c WHERE o.o_custkey = c.c_custkey AND c.c_acctbal > 5000",
    "j2_outer": "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P' GROUP BY c.c_custkey",
    "j2_full": "SELECT s.s_nationkey AS a, n.n_nationkey AS b, count(*) AS n FROM (SELECT * FROM supplier WHERE s_nationkey < 12) s FULL OUTER JOIN (SELECT * FROM nation WHERE n_nationkey > 5) n ON s.s_nationkey = n.n_nationkey GROUP BY 1, 2",
    "j3_cross": "SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b",
    "j4_natural": "SELECT n_name, k FROM nation NATURAL JOIN (SELECT n_nationkey, n_nationkey * 2 AS k FROM nation) t",
    "j5_using": "SELECT r_name, count(*) AS n FROM nation JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) r USING (n_regionkey) GROUP BY r_name",
    "j6_anti": ("SELECT c_custkey FROM customer LEFT ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON o_custkey = c_custkey", "SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON o_custkey = c_custkey"),
    "j6_semi": ("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000", "SELECT c_custkey FROM customer SEMI JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON o_custkey = c_custkey"),
    "j8_outer_apply": ("SELECT n_nationkey, t.c FROM nation LEFT JOIN LATERAL (SELECT c_custkey AS c FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < -900 ORDER BY c_custkey LIMIT 2) t ON TRUE", "SELECT n_nationkey, t.c FROM nation LEFT JOIN LATERAL (SELECT c_custkey AS c FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < -900 ORDER BY c_custkey LIMIT 2) t ON TRUE"),
    "j8_lateral": "SELECT n_name, t.n FROM nation, LATERAL (SELECT count(*) AS n FROM customer WHERE c_nationkey = n_nationkey) t",
    "j9_unnest": ("SELECT n_nationkey, w FROM nation LATERAL VIEW explode(split(n_name, '_')) t AS w", "SELECT n_nationkey, unnest(string_split(n_name, '_')) AS w FROM nation"),
    "j10_correlated": "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS m FROM customer",
    "a1_group": "SELECT year(o_orderdate) AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY year(o_orderdate), o_orderstatus",
    "a2_rollup": "SELECT c_nationkey, c_mktsegment, count(*) AS n, grouping(c_nationkey) AS g FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)",
    "a2_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "a2_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "a4_aggregates": "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 2) AS p, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY l_returnflag",
    "a5_distinct": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS c, count(DISTINCT o_orderpriority) AS p FROM orders GROUP BY o_orderstatus",
    "a6_filter": "SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal < 0) AS neg, count(*) AS n FROM customer GROUP BY c_mktsegment",
    "a7_statistics": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(covar_samp(l_quantity, l_discount), 6) AS cs, regr_count(l_quantity, l_tax) AS rc FROM lineitem GROUP BY l_returnflag",
    "a8_every": ("SELECT o_orderpriority, every(o_totalprice > 0) AS e, some(o_orderstatus = 'P') AS s FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, bool_and(o_totalprice > 0) AS e, bool_or(o_orderstatus = 'P') AS s FROM orders GROUP BY o_orderpriority"),
    "a10_string_agg": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "a11_percentile": ("SELECT l_returnflag, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS med FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS med FROM lineitem GROUP BY l_returnflag"),
    "a15_pivot": ("SELECT * FROM (SELECT o_orderstatus, o_orderpriority FROM orders) PIVOT (count(*) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY o_orderpriority"),
    "a15_unpivot": ("SELECT l_orderkey, l_linenumber, name, v FROM lineitem UNPIVOT (v FOR name IN (l_discount AS d, l_tax AS t))", "SELECT l_orderkey, l_linenumber, 'd' AS name, l_discount AS v FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 't', l_tax FROM lineitem"),
    "w1_named_window": "SELECT c_custkey, rank() OVER w AS r FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)",
    "w2_frames": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM orders",
    "w4_ranking": "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS rn, dense_rank() OVER (ORDER BY s_nationkey) AS dr, ntile(4) OVER (ORDER BY s_acctbal, s_suppkey) AS nt, round(percent_rank() OVER (ORDER BY s_nationkey), 6) AS pr, round(cume_dist() OVER (ORDER BY s_nationkey), 6) AS cd FROM supplier",
    "w5_lag_lead": "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS f FROM orders",
    "w6_aggregate_over": "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem",
    "l1_order_limit": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20",
    "l3_offset": "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 30",
    "u1_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "u1_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "u1_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "u4_with": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), top AS (SELECT o_custkey FROM big WHERE t > 500000) SELECT c_custkey, c_name FROM customer JOIN top ON o_custkey = c_custkey",
    "u6_recursive": "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 20) SELECT n FROM r",
    "u7_values": "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y')) AS t(a, b)",
    "f_string": "SELECT p_partkey, upper(p_name) AS u, substring(p_name, 2, 3) AS s, position('a' IN p_name) AS p, trim(BOTH 'S' FROM p_type) AS t, char_length(p_name) AS n, left(p_brand, 3) AS l, right(p_brand, 2) AS r, translate(p_brand, '#', '-') AS x FROM part",
    "f_math": ("SELECT p_partkey, abs(p_size - 25) AS a, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, mod(p_size, 4) AS m, round(power(p_size, 2), 3) AS p, round(sqrt(p_size), 6) AS s, round(ln(p_retailprice), 6) AS l FROM part", "SELECT p_partkey, abs(p_size - 25) AS a, ceil(p_retailprice)::BIGINT AS c, floor(p_retailprice)::BIGINT AS f, p_size % 4 AS m, round(power(p_size, 2), 3) AS p, round(sqrt(p_size), 6) AS s, round(ln(p_retailprice), 6) AS l FROM part"),
    "f_datetime": ("SELECT o_orderkey, extract(YEAR FROM o_orderdate) AS y, month(o_orderdate) AS m, cast(cast(o_orderdate AS DATE) + 3 AS STRING) AS d, datediff(DATE '1999-01-01', cast(o_orderdate AS DATE)) AS k FROM orders", "SELECT o_orderkey, extract(YEAR FROM o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, (o_orderdate::DATE + 3)::DATE::VARCHAR AS d, date_diff('day', o_orderdate::DATE, DATE '1999-01-01')::INT AS k FROM orders"),
    "f_json": ("SELECT event_id, cast(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, (props::JSON ->> '$.k')::INT AS k FROM events"),
    "f_array": ("SELECT n_nationkey, size(split(n_name, '_')) AS n, element_at(split(n_name, '_'), 1) AS a FROM nation", "SELECT n_nationkey, len(string_split(n_name, '_'))::INT AS n, string_split(n_name, '_')[1] AS a FROM nation"),
    "p2_star_replace": ("SELECT n_nationkey, upper(n_name) AS n_name, n_regionkey FROM nation", "SELECT * REPLACE (upper(n_name) AS n_name) FROM nation"),
    "p13_similar": ("SELECT p_partkey FROM part WHERE p_type RLIKE '^(STANDARD|PROMO)[ A-Z]*$' OR p_brand LIKE '%!_#2%' ESCAPE '!'", "SELECT p_partkey FROM part WHERE regexp_full_match(p_type, '(STANDARD|PROMO)[ A-Z]*') OR p_brand LIKE '%!_#2%' ESCAPE '!'"),
    "a3_grouping_id": "SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS g, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "a7_more_statistics": ("SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 6) AS vs, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(corr(l_quantity, l_extendedprice), 6) AS c, round(regr_slope(l_extendedprice, l_quantity), 4) AS rs, round(regr_intercept(l_extendedprice, l_quantity), 2) AS ri, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay, round(regr_sxx(l_extendedprice, l_quantity) / count(*), 4) AS sxx FROM lineitem GROUP BY l_returnflag",)*2,
    "a9_collect": ("SELECT c_nationkey, array_join(array_sort(collect_set(c_mktsegment)), ',') AS segs, size(collect_list(c_custkey)) AS n FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segs, len(list(c_custkey))::INT AS n FROM customer GROUP BY c_nationkey"),
    "a9_fusion": ("SELECT r, array_join(array_sort(array_distinct(flatten(collect_list(segs)))), ',') AS fused, array_join(array_sort(reduce(collect_list(segs), collect_list(segs)[0], (a, x) -> array_intersect(a, x))), ',') AS common FROM (SELECT n_regionkey AS r, n_nationkey, collect_set(c_mktsegment) AS segs FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) GROUP BY r", "WITH s AS (SELECT n_regionkey AS r, n_nationkey AS k, c_mktsegment AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), c AS (SELECT r, count(DISTINCT k) AS n FROM s GROUP BY r), t AS (SELECT r, seg, count(*) AS m FROM s GROUP BY r, seg) SELECT t.r, string_agg(seg, ',' ORDER BY seg) AS fused, coalesce(string_agg(seg, ',' ORDER BY seg) FILTER (WHERE m = n), '') AS common FROM t JOIN c ON t.r = c.r GROUP BY t.r"),
    "a10_array_agg": ("SELECT n_regionkey, array_join(array_sort(array_agg(n_name)), ';') AS names, size(flatten(array_agg(split(n_name, '_')))) AS parts FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(array_agg(n_name)), ';') AS names, len(flatten(array_agg(string_split(n_name, '_'))))::INT AS parts FROM nation GROUP BY n_regionkey"),
    "a11_percentile_disc": ("SELECT l_returnflag, percentile_disc(0.25) WITHIN GROUP (ORDER BY l_quantity) AS q1, percentile_disc(0.9) WITHIN GROUP (ORDER BY l_quantity DESC) AS q9 FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, percentile_disc(0.25) WITHIN GROUP (ORDER BY l_quantity)::DOUBLE AS q1, percentile_disc(0.9) WITHIN GROUP (ORDER BY l_quantity DESC)::DOUBLE AS q9 FROM lineitem GROUP BY l_returnflag"),
    "a12_json_objectagg": ("SELECT n_regionkey, to_json(map_from_entries(array_sort(collect_list(struct(n_name, n_nationkey))))) AS doc, to_json(array_sort(collect_list(n_nationkey))) AS keys FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS doc, '[' || string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) || ']' AS keys FROM nation GROUP BY n_regionkey"),
    "a14_approximate": ("SELECT o_orderstatus, abs(approx_count_distinct(o_custkey, 0.02) - count(DISTINCT o_custkey)) <= 0.1 * count(DISTINCT o_custkey) AS near FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, TRUE AS near FROM orders GROUP BY o_orderstatus"),
    "w2_range": "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS n FROM customer",
    "w5_values": ("SELECT o_orderkey, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n2, last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) IGNORE NULLS OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f, lag(o_orderkey, 1, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS d FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", "SELECT o_orderkey, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n2, last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f, lag(o_orderkey, 1, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS d FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    "l2_limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7 OFFSET 5",
    "l6_sample": ("SELECT count(*) BETWEEN 1 AND 0.5 * (SELECT count(*) FROM lineitem) AS some FROM lineitem TABLESAMPLE (20 PERCENT) REPEATABLE (7)", "SELECT TRUE AS some"),
    "u1_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "u1_except": "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'",
    "u9_match_runs": ("SELECT user_id, run, count(*) AS n, min(event_id) AS first_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM events) WHERE event_type = 'click' GROUP BY user_id, run HAVING count(*) >= 2",)*2,
    "u10_as_of": "SELECT o_custkey, o_orderkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30 00:00:00'",
    "f_string_more": ("SELECT p_partkey, overlay(p_name PLACING '__' FROM 2 FOR 1) AS o, octet_length(p_name) AS ol, char(65 + p_size % 26) AS ch, lower(p_type) AS lo, initcap(p_type) AS i, reverse(p_brand) AS r, repeat('x', p_size % 3) AS rp, replace(p_type, ' ', '_') AS re, lpad(p_brand, 10, '.') AS lp, ascii(p_name) AS a, ltrim(' ' || p_brand) AS lt, split_part(p_type, ' ', 1) AS sp FROM part", "SELECT p_partkey, left(p_name, 1) || '__' || substr(p_name, 3) AS o, strlen(p_name)::INT AS ol, chr(65 + (p_size % 26)::INT) AS ch, lower(p_type) AS lo, array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS i, reverse(p_brand) AS r, repeat('x', p_size % 3) AS rp, replace(p_type, ' ', '_') AS re, lpad(p_brand, 10, '.') AS lp, ascii(p_name) AS a, ltrim(' ' || p_brand) AS lt, split_part(p_type, ' ', 1) AS sp FROM part"),
    "f_math_more": ("SELECT p_partkey, round(exp(p_size / 50.0), 6) AS e, cast(cast(p_retailprice * 10 AS BIGINT) AS DOUBLE) / 10 AS t, sign(p_size - 25) AS s, round(log10(p_retailprice), 6) AS lg, round(cbrt(p_size), 6) AS cb, round(atan2(p_size, 3), 6) AS at, round(sin(p_size) + cos(p_size), 6) AS sc, round(degrees(radians(p_size)), 6) AS dr, round(pi(), 6) AS pi FROM part", "SELECT p_partkey, round(exp(p_size / 50.0), 6) AS e, trunc(p_retailprice * 10) / 10 AS t, sign(p_size - 25)::DOUBLE AS s, round(log10(p_retailprice), 6) AS lg, round(cbrt(p_size), 6) AS cb, round(atan2(p_size, 3), 6) AS at, round(sin(p_size) + cos(p_size), 6) AS sc, round(degrees(radians(p_size)), 6) AS dr, round(pi(), 6) AS pi FROM part"),
    "f_datetime_more": ("SELECT o_orderkey, quarter(o_orderdate) AS q, weekofyear(o_orderdate) AS w, dayofyear(o_orderdate) AS doy, dayofmonth(o_orderdate) AS dom, weekday(o_orderdate) AS wd, date_format(o_orderdate, 'yyyy-MM') AS ym, date_format(date_trunc('MONTH', o_orderdate), 'yyyy-MM-dd') AS m0, cast(last_day(o_orderdate) AS STRING) AS ld, cast(add_months(o_orderdate, 2) AS STRING) AS am, hour(o_orderdate) AS h, unix_date(cast(o_orderdate AS DATE)) AS ud, cast(make_date(year(o_orderdate), 1, 1) AS STRING) AS md, cast(to_date(date_format(o_orderdate, 'yyyyMMdd'), 'yyyyMMdd') AS STRING) AS td FROM orders", "SELECT o_orderkey, quarter(o_orderdate)::INT AS q, weekofyear(o_orderdate)::INT AS w, dayofyear(o_orderdate)::INT AS doy, dayofmonth(o_orderdate)::INT AS dom, (isodow(o_orderdate) - 1)::INT AS wd, strftime(o_orderdate, '%Y-%m') AS ym, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m0, last_day(o_orderdate)::DATE::VARCHAR AS ld, (o_orderdate + INTERVAL 2 MONTHS)::DATE::VARCHAR AS am, hour(o_orderdate)::INT AS h, (o_orderdate::DATE - DATE '1970-01-01')::INT AS ud, make_date(year(o_orderdate), 1, 1)::VARCHAR AS md, o_orderdate::DATE::VARCHAR AS td FROM orders"),
    "f_interval": ("SELECT o_orderkey, cast(cast(o_orderdate AS DATE) + INTERVAL '1-2' YEAR TO MONTH AS STRING) AS a, date_format(o_orderdate - INTERVAL '3 04:05:06' DAY TO SECOND, 'yyyy-MM-dd HH:mm:ss') AS b, timestampdiff(DAY, o_orderdate, TIMESTAMP '2000-01-01 00:00:00') AS c, cast(extract(DAY FROM (TIMESTAMP '2000-01-01 00:00:00' - o_orderdate)) AS INT) AS d FROM orders", "SELECT o_orderkey, (o_orderdate::DATE + INTERVAL 14 MONTHS)::DATE::VARCHAR AS a, strftime(o_orderdate - INTERVAL 3 DAYS - INTERVAL 4 HOURS - INTERVAL 5 MINUTES - INTERVAL 6 SECONDS, '%Y-%m-%d %H:%M:%S') AS b, date_sub('day', o_orderdate, TIMESTAMP '2000-01-01 00:00:00') AS c, date_sub('day', o_orderdate, TIMESTAMP '2000-01-01 00:00:00')::INT AS d FROM orders"),
    "f_map_row": ("SELECT n_nationkey, element_at(map('a', n_regionkey, 'b', n_nationkey), 'b') AS m, named_struct('x', n_name, 'y', n_regionkey).x AS x, aggregate(transform(sequence(1, n_regionkey + 1), x -> x * x), 0, (a, b) -> a + b) AS s, array_join(filter(split(n_name, ''), c -> c > 'M'), '') AS f, exists(split(n_name, ''), c -> c = 'A') AS e, cardinality(map('k', 1)) AS c FROM nation", "SELECT n_nationkey, n_nationkey AS m, n_name AS x, list_sum(list_transform(range(1, n_regionkey + 2), lambda x: x * x))::INT AS s, array_to_string(list_filter(string_split(n_name, ''), lambda c: c > 'M'), '') AS f, contains(n_name, 'A') AS e, 1 AS c FROM nation"),
    "f_json_more": ("SELECT event_id, get_json_object(props, '$.k') IS NOT NULL AS has, to_json(named_struct('u', user_id, 't', event_type)) AS o, to_json(array(event_id, user_id)) AS a, json_array_length(to_json(array(1, user_id))) AS n, try_parse_json(event_type) IS NULL AS bad FROM events", "SELECT event_id, (props::JSON ->> '$.k') IS NOT NULL AS has, '{\"u\":' || user_id || ',\"t\":\"' || event_type || '\"}' AS o, '[' || event_id || ',' || user_id || ']' AS a, 2 AS n, TRUE AS bad FROM events"),
    "f_context": ("SELECT current_user() IS NOT NULL AS u, current_date() <= cast(current_timestamp() AS DATE) AS d, current_catalog() IS NOT NULL AS c FROM region", "SELECT TRUE AS u, TRUE AS d, TRUE AS c FROM region"),
    "f_sequence": ("SELECT n_nationkey, explode(sequence(n_regionkey, n_regionkey + 2)) AS k FROM nation", "SELECT n_nationkey, unnest(range(n_regionkey, n_regionkey + 3)) AS k FROM nation"),
    "q1_pricing": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "q3_shipping": "SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderkey ORDER BY revenue DESC, o_orderkey LIMIT 10",
    "q5_regions": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
}


def p3_select_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SELECT BY: the grouping columns come out before the aggregates."""
    return views(spark, sf_dir).table("orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


def p6_qualify(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views(spark, sf_dir).table("orders")
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return relational.qualify(orders, number, lambda k: k == 1).select("o_custkey", "o_orderkey")


def p10_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds in either order, column by column."""
    lines = views(spark, sf_dir).table("lineitem")
    return lines.where(relational.between_symmetric(F.lit(4), F.col("l_linenumber"), 10 * F.col("l_discount"))).select("l_orderkey", "l_linenumber")


def p12_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views(spark, sf_dir)
    found = [relational.unique(own.table(t), *c).withColumn("name", F.lit("+".join(c))) for t, c in (("orders", ("o_orderkey",)), ("orders", ("o_custkey",)), ("lineitem", ("l_orderkey", "l_linenumber")))]
    return found[0].unionByName(found[1]).unionByName(found[2])


def p17_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir).sql("SELECT c_custkey FROM customer WHERE c_acctbal > ? AND c_mktsegment = ?", [5000.0, "BUILDING"])


def j12_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose balance lies up to 50 above another's."""
    own = views(spark, sf_dir).table("supplier")
    low = own.select(F.col("s_suppkey").alias("x"), F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 50).alias("hi"))
    return relational.range_join(own.select(F.col("s_suppkey").alias("y"), "s_acctbal"), low, "s_acctbal", "lo", "hi", 50).where("x <> y").select("x", "y")


def w3_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views(spark, sf_dir).table("customer").withColumn("k", F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey")))
    return c.select("c_custkey", relational.sum_excluding_current(F.col("k"), ["c_nationkey", "c_mktsegment"]).alias("others"))


def w4_row_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROW_NUMBER over the whole of lineitem, by range and not in one task."""
    lines = views(spark, sf_dir).table("lineitem").select("l_extendedprice", "l_orderkey", "l_linenumber")
    return relational.ranked(lines, ["l_extendedprice", "l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "row_no")


def u11_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views(spark, sf_dir)
    a = own.table("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.collect_list(F.col("c_custkey") % 7).alias("a"))
    b = own.table("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.collect_list(F.col("s_suppkey") % 7).alias("b"))
    text = lambda c: F.array_join(c, ",")
    return a.join(b, "k").select("k", *[text(relational.multiset(F.col("a"), F.col("b"), how)).alias(how[0]) for how in ("union", "intersect", "except")], text(relational.multiset(F.col("a"), F.col("b"), "intersect", True)).alias("d"))


FRAMES = {f.__name__: f for f in (p3_select_by, p6_qualify, p10_between, p12_unique, p17_parameters, j12_range, w3_exclude, w4_row_number, u11_multiset)}
FRAME_SQL = {
    "p3_select_by": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2",
    "p6_qualify": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1",
    "p10_between": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE 4 BETWEEN l_linenumber AND 10 * l_discount OR 4 BETWEEN 10 * l_discount AND l_linenumber",
    "p12_unique": "SELECT count(*) = count(DISTINCT o_orderkey) AS is_unique, 'o_orderkey' AS name FROM orders UNION ALL SELECT count(*) = count(DISTINCT o_custkey), 'o_custkey' FROM orders UNION ALL SELECT count(*) = count(DISTINCT (l_orderkey, l_linenumber)), 'l_orderkey+l_linenumber' FROM lineitem",
    "p17_parameters": "SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'",
    "j12_range": "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON b.s_acctbal BETWEEN a.s_acctbal AND a.s_acctbal + 50 AND a.s_suppkey <> b.s_suppkey",
    "w3_exclude": "SELECT c_custkey, (sum(CASE WHEN c_custkey % 3 > 0 THEN c_custkey END) OVER (PARTITION BY c_nationkey, c_mktsegment ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW))::BIGINT AS others FROM customer",
    "w4_row_number": "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS row_no FROM lineitem",
    "u11_multiset": """WITH a AS (SELECT c_nationkey AS k, c_custkey % 7 AS v, count(*) AS n FROM customer GROUP BY 1, 2), b AS (SELECT s_nationkey AS k, s_suppkey % 7 AS v, count(*) AS n FROM supplier GROUP BY 1, 2),
        f AS (SELECT k, v, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b USING (k, v) WHERE k IN (SELECT k FROM a) AND k IN (SELECT k FROM b))
        SELECT k, string_agg(repeat(v || ',', x + y), '' ORDER BY v)[:-2] AS u, string_agg(repeat(v || ',', least(x, y)), '' ORDER BY v)[:-2] AS i, string_agg(repeat(v || ',', greatest(x - y, 0)), '' ORDER BY v)[:-2] AS e, coalesce(string_agg(v::VARCHAR, ',' ORDER BY v) FILTER (WHERE least(x, y) > 0), '') AS d FROM f GROUP BY k""",
}


def _query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: views(spark, sf_dir).sql(sql)


QUERIES = {k: _query(v if isinstance(v, str) else v[0]) for k, v in SURFACE.items()} | FRAMES
SQL = {k: v if isinstance(v, str) else v[1] for k, v in SURFACE.items()} | FRAME_SQL

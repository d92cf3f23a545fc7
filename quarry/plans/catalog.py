"""Queries over the test tables, one for each operator: text in the dialect, and the same in DuckDB's SQL where it differs.

A query is (dialect text, DuckDB text or None if the same text means the same there).
"""

from __future__ import annotations

Q: dict[str, tuple[str, str | None]] = {}


def _add(key: str, sql: str, duck: str | None = None) -> None:
    Q[key] = (sql, duck)


# -- scan, projection, filter, operators ------------------------------------------------------------------------------
_add(
    "flagship",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
       round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_quantity < 45
       GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10 ORDER BY l_returnflag, l_linestatus LIMIT 10""",
)
_add("scan_full", "SELECT * FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
_add("scan_dual", "SELECT 1 AS one, 'x' AS x", "SELECT CAST(1 AS BIGINT) AS one, 'x' AS x")
_add("scan_values", "SELECT column1 AS a, column2 AS b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v", "SELECT CAST(a AS BIGINT) AS a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(a, b)")
_add("select_star", "SELECT * FROM region", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
_add("qualified_star", "SELECT n.* FROM nation AS n JOIN region AS r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA'", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
_add("alias_expr", "SELECT o_orderkey AS k, o_orderkey + 1 AS k1 FROM orders")
_add("filter_cmp", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 150000 AND o_orderpriority <> '1-URGENT'")
_add("filter_3vl", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE NOT (l.quality = 1 AND d.lang = 'en') OR l.toxic = 1")
_add("filter_date", "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1995-01-01' AND o_orderdate < '1995-03-01'")
_add("arith", "SELECT l_orderkey, l_linenumber, l_orderkey + l_linenumber * 2 - 1 AS a, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_orderkey + l_linenumber * 2 - 1 AS a, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem")
_add("int_div", "SELECT o_orderkey, o_orderkey / 7 AS q, -o_orderkey / 7 AS nq FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, -(o_orderkey // 7) AS nq FROM orders")
_add("mod_op", "SELECT o_orderkey, o_orderkey % 7 AS r, -o_orderkey % 7 AS nr FROM orders")
_add("div_zero", "SELECT n_nationkey, n_nationkey / (n_nationkey - n_nationkey) AS d, n_nationkey % 0 AS m, 1.5 / (n_nationkey - 3) AS f FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(NULL AS BIGINT) AS d, CAST(NULL AS BIGINT) AS m, CASE WHEN n_nationkey = 3 THEN NULL ELSE CAST(1.5 AS DOUBLE) / (n_nationkey - 3) END AS f FROM nation")
_add("unary_neg", "SELECT c_custkey, -c_acctbal AS neg, -(-c_custkey) AS same FROM customer", "SELECT c_custkey, -c_acctbal AS neg, c_custkey AS same FROM customer")
_add("concat_op", "SELECT c_custkey, c_name || '/' || c_mktsegment || '/' || c_custkey AS s FROM customer", "SELECT c_custkey, c_name || '/' || c_mktsegment || '/' || CAST(c_custkey AS VARCHAR) AS s FROM customer")
_add("concat_null", "SELECT d.doc_id, d.lang || l.quality AS s FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id", "SELECT d.doc_id, d.lang || CAST(l.quality AS VARCHAR) AS s FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
_add("is_null", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NULL")
_add("not_null", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL")
_add("is_distinct", "SELECT d.doc_id, l.quality IS 1 AS one, l.quality IS NOT 1 AS other FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id", "SELECT d.doc_id, l.quality IS NOT DISTINCT FROM 1 AS one, l.quality IS DISTINCT FROM 1 AS other FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
_add("like_ci", "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%brass%' OR p_name LIKE 'PART_1%'", "SELECT p_partkey, p_name FROM part WHERE p_type ILIKE '%brass%' OR p_name ILIKE 'PART_1%'")
_add("not_like", "SELECT p_partkey FROM part WHERE p_type NOT LIKE 'p%'", "SELECT p_partkey FROM part WHERE p_type NOT ILIKE 'p%'")
_add("glob_op", "SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand#[1-3]*'")
_add("in_list", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus IN ('F')")
_add("not_in_list", "SELECT n_name FROM nation WHERE n_regionkey NOT IN (0, 2, 4)")
_add("between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
_add("not_between", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45")
_add("case_searched", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band FROM customer")
_add("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS s FROM orders", "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS BIGINT) AS s FROM orders")
_add("cast_int", "SELECT c_custkey, CAST(c_acctbal AS INTEGER) AS i FROM customer", "SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS i FROM customer")
_add("cast_real", "SELECT o_orderkey, CAST(o_orderkey AS REAL) AS r FROM orders", "SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) AS r FROM orders")
_add("cast_text", "SELECT o_orderkey, CAST(o_orderkey AS TEXT) AS t FROM orders", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS t FROM orders")
_add("cast_prefix", "SELECT o_orderkey, CAST(o_orderpriority AS INTEGER) AS p, CAST(o_orderstatus AS INTEGER) AS z FROM orders", "SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS p, CAST(0 AS BIGINT) AS z FROM orders")
_add("cast_bool", "SELECT n_nationkey, CAST(n_regionkey AS BOOLEAN) AS b FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_regionkey <> 0 AS b FROM nation")
_add("bit_ops", "SELECT n_nationkey, n_nationkey & 6 AS a, n_nationkey | 8 AS o, n_nationkey << 2 AS l, n_nationkey >> 1 AS r, ~n_nationkey AS n FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_nationkey & 6 AS BIGINT) AS a, CAST(n_nationkey | 8 AS BIGINT) AS o, CAST(n_nationkey << 2 AS BIGINT) AS l, CAST(n_nationkey >> 1 AS BIGINT) AS r, CAST(~n_nationkey AS BIGINT) AS n FROM nation")
_add("class_compare", "SELECT n_name, n_nationkey < 'a' AS below, n_name = 5 AS same FROM nation", "SELECT n_name, true AS below, false AS same FROM nation")

# -- joins ------------------------------------------------------------------------------------------------------------
_add("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
_add("join_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_add("join_range", "SELECT s.s_suppkey, r.r_name FROM supplier s JOIN region r ON s.s_acctbal >= r.r_regionkey * 2000 AND s.s_acctbal < r.r_regionkey * 2000 + 2000")
_add("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
_add("join_left", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id", "SELECT d.doc_id, CAST(l.quality AS BIGINT) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
_add("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
_add(
    "join_nway",
    "SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY r_name, n_name",
)
_add("join_self", "SELECT a.s_suppkey AS s1, b.s_suppkey AS s2 FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
_add("join_cte", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12) SELECT c_name, n FROM customer JOIN big ON c_custkey = o_custkey")
_add("join_right", "SELECT l.quality, d.doc_id FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id", "SELECT CAST(l.quality AS BIGINT) AS quality, d.doc_id FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id")
_add("join_full", "SELECT c.c_nationkey AS a, s.s_nationkey AS b FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey < 15) AS c FULL JOIN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey > 8) AS s ON c_nationkey = s_nationkey", "SELECT CAST(c_nationkey AS BIGINT) AS a, CAST(s_nationkey AS BIGINT) AS b FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey < 15) FULL JOIN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey > 8) ON c_nationkey = s_nationkey")
_add("join_using", "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)", "SELECT doc_id, lang, CAST(quality AS BIGINT) AS quality FROM documents JOIN labels USING (doc_id)")
_add("semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
_add("anti_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
_add("exists", "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_name = 'CHINA')")
_add("not_exists", "SELECT r_name FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_name = 'ATLANTIS')")
_add("exists_correlated", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)")
_add("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 2 FROM orders)")
_add("scalar_correlated", "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers FROM nation")
_add("derived_table", "SELECT lang, max(n) AS most FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source) AS t GROUP BY lang")

# -- aggregation ------------------------------------------------------------------------------------------------------
_add("agg_global", "SELECT count(*) AS n, sum(l_linenumber) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS mean FROM lineitem", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS mean FROM lineitem")
_add("agg_empty", "SELECT count(*) AS n, sum(o_orderkey) AS s, max(o_totalprice) AS m, total(o_totalprice) AS t, 7 AS seven FROM orders WHERE o_orderkey < 0", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s, max(o_totalprice) AS m, CAST(0 AS DOUBLE) AS t, CAST(7 AS BIGINT) AS seven FROM orders WHERE o_orderkey < 0")
_add("group_by", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderpriority, o_orderstatus")
_add("group_expr", "SELECT p_size % 10 AS bucket, count(*) AS n FROM part GROUP BY p_size % 10", "SELECT CAST(p_size % 10 AS BIGINT) AS bucket, count(*) AS n FROM part GROUP BY 1")
_add("group_ordinal", "SELECT p_brand AS b, count(*) AS n FROM part GROUP BY 1")
_add("group_null_key", "SELECT l.quality AS q, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY l.quality", "SELECT CAST(l.quality AS BIGINT) AS q, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY l.quality")
_add("having_agg", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 55", "SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 55")
_add("having_alias", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand HAVING n > 75", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) > 75")
_add("agg_expr", "SELECT o_orderstatus, max(o_orderkey) - min(o_orderkey) + 1 AS width, count(*) * 2 AS twice FROM orders GROUP BY o_orderstatus")
_add("count_star", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'")
_add("count_col", "SELECT count(l.quality) AS labelled, count(*) AS everything FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
_add("count_distinct", "SELECT count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_returnflag) AS flags FROM lineitem")
_add("sum_agg", "SELECT l_returnflag, sum(l_linenumber) AS s, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS s, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag")
_add("sum_distinct", "SELECT sum(DISTINCT p_size) AS s, avg(DISTINCT p_size) AS a FROM part", "SELECT CAST(sum(DISTINCT p_size) AS BIGINT) AS s, avg(DISTINCT p_size) AS a FROM part")
_add("total_agg", "SELECT o_orderstatus, total(o_orderkey) AS t FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(sum(o_orderkey) AS DOUBLE) AS t FROM orders GROUP BY o_orderstatus")
_add("avg_agg", "SELECT p_brand, round(avg(p_size), 6) AS a FROM part GROUP BY p_brand")
_add("min_agg", "SELECT c_mktsegment, min(c_acctbal) AS lo, min(c_name) AS first FROM customer GROUP BY c_mktsegment")
_add("max_agg", "SELECT c_mktsegment, max(c_acctbal) AS hi, max(c_name) AS last FROM customer GROUP BY c_mktsegment")
_add("group_concat", "SELECT n_regionkey, group_concat(n_name ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
_add("group_concat_sep", "SELECT n_regionkey, group_concat(n_name, ' | ' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, string_agg(n_name, ' | ' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
_add("group_concat_distinct", "SELECT o_orderstatus, group_concat(DISTINCT o_orderpriority) AS p FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS p FROM orders GROUP BY o_orderstatus")
_add("group_concat_column", "SELECT n_regionkey, group_concat(n_name, '<' || n_nationkey || '>' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey", "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, regexp_replace(string_agg('<' || n_nationkey || '>' || n_name, '' ORDER BY n_nationkey), '^<[0-9]+>', '') AS names FROM nation GROUP BY n_regionkey")
_add("bare_column", "SELECT n_regionkey, n_name FROM (SELECT * FROM nation) AS n GROUP BY n_regionkey", "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, min(n_name) AS n_name FROM nation GROUP BY n_regionkey")
_add("agg_filter", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, sum(l_linenumber) FILTER (WHERE l_discount > 0.05) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, CAST(sum(l_linenumber) FILTER (WHERE l_discount > 0.05) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag")

# -- sort, limit, distinct, set operations, CTEs ------------------------------------------------------------------------
_add("order_multi", "SELECT n_regionkey, n_name FROM nation ORDER BY n_regionkey DESC, n_name LIMIT 9", "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, n_name FROM nation ORDER BY n_regionkey DESC, n_name LIMIT 9")
_add(
    "bare_columns",
    "SELECT c_mktsegment, c_nationkey, c_name, count(*) AS n FROM customer GROUP BY c_mktsegment",
    "SELECT c_mktsegment, CAST(s.a AS BIGINT) AS c_nationkey, s.b AS c_name, n FROM (SELECT c_mktsegment, min({'a': c_nationkey, 'b': c_name}) AS s, count(*) AS n FROM customer GROUP BY c_mktsegment)",
)
_add("distinct_aggregate", "SELECT DISTINCT count(*) AS n FROM customer GROUP BY c_nationkey")
_add("collate_nocase", "SELECT p_partkey FROM part WHERE p_brand = 'bRAND#13' COLLATE NOCASE OR p_type COLLATE NOCASE IN ('x', 'PROMO BRUSHED TIN')", "SELECT p_partkey FROM part WHERE lower(p_brand) = 'brand#13' OR lower(p_type) = 'promo brushed tin'")
_add("collate_group", "SELECT upper(min(p_brand)) AS b, count(*) AS n FROM part GROUP BY p_brand COLLATE NOCASE", "SELECT upper(min(p_brand)) AS b, count(*) AS n FROM part GROUP BY lower(p_brand)")
_add("smallest_long", "SELECT n_nationkey, -9223372036854775808 + n_nationkey AS v FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST('-9223372036854775808' AS BIGINT) + n_nationkey AS v FROM nation")
_add("cast_blob", "SELECT p_partkey, hex(CAST(p_name AS BLOB)) AS h, length(CAST(p_name AS BLOB)) AS n FROM part", "SELECT p_partkey, hex(p_name) AS h, CAST(strlen(p_name) AS BIGINT) AS n FROM part")
_add("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer INTERSECT ALL SELECT CAST(s_nationkey AS BIGINT) FROM supplier")
_add("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer EXCEPT ALL SELECT CAST(s_nationkey AS BIGINT) FROM supplier")
_add("join_natural", "SELECT doc_id, lang, quality FROM documents NATURAL JOIN labels", "SELECT doc_id, lang, CAST(quality AS BIGINT) AS quality FROM documents NATURAL JOIN labels")
_add("join_range_left", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_acctbal BETWEEN n_nationkey * 300 AND n_nationkey * 300 + 100")
_add("join_range_tree", "SELECT s_suppkey, a.n_name AS home, b.n_name AS other FROM supplier JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON s_acctbal > b.n_nationkey * 250 AND b.n_nationkey * 250 + 400 >= s_acctbal")
_add("dt_utc", "SELECT o_orderkey, datetime(o_orderdate, 'utc') AS u, datetime(o_orderdate, 'localtime') AS l FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS u, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS l FROM orders")
_add("likely", "SELECT n_name FROM nation WHERE likely(n_regionkey = 1) OR unlikely(n_nationkey = 3)", "SELECT n_name FROM nation WHERE n_regionkey = 1 OR n_nationkey = 3")
_add("cte_recursive_deep", "WITH RECURSIVE s(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM s WHERE i < 400) SELECT count(*) AS n, max(i) AS top, sum(i) AS total FROM s", "SELECT CAST(400 AS BIGINT) AS n, CAST(400 AS BIGINT) AS top, CAST(80200 AS BIGINT) AS total")
_add("cte_recursive_union", "WITH RECURSIVE r(x) AS (SELECT 0 UNION SELECT (x * 7 + 3) % 25 FROM r) SELECT n_name FROM nation WHERE n_nationkey IN (SELECT x FROM r)", "WITH RECURSIVE r(x) AS (SELECT 0 UNION SELECT (x * 7 + 3) % 25 FROM r) SELECT n_name FROM nation WHERE n_nationkey IN (SELECT x FROM r)")
_add("order_nulls", "SELECT d.doc_id, l.quality AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id ORDER BY l.quality, d.doc_id", "SELECT d.doc_id, CAST(l.quality AS BIGINT) AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id ORDER BY l.quality NULLS FIRST, d.doc_id")
_add("order_nulls_last", "SELECT d.doc_id, l.quality AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id ORDER BY l.quality NULLS LAST, d.doc_id", "SELECT d.doc_id, CAST(l.quality AS BIGINT) AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id ORDER BY l.quality NULLS LAST, d.doc_id")
_add("order_ordinal", "SELECT c_name, c_acctbal FROM customer ORDER BY 2 DESC, 1")
_add("order_alias", "SELECT c_custkey, c_acctbal * 2 AS twice FROM customer ORDER BY twice, c_custkey")
_add("order_base", "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey")
_add("order_shadow", "SELECT c_custkey, -c_acctbal AS c_acctbal FROM customer ORDER BY c_acctbal, c_custkey", "SELECT c_custkey, -b AS c_acctbal FROM (SELECT c_custkey, c_acctbal AS b FROM customer) ORDER BY b, c_custkey")
_add("limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 17")
_add("offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
_add("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")
_add("distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
_add("distinct_order_base", "SELECT DISTINCT c_mktsegment FROM customer ORDER BY c_custkey LIMIT 3", "SELECT c_mktsegment FROM customer GROUP BY c_mktsegment ORDER BY min(c_custkey) LIMIT 3")
_add("union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_add("union_all", "SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region")
_add("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_add("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT c_nationkey FROM customer", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation EXCEPT SELECT c_nationkey FROM customer")
_add("setop_left_assoc", "SELECT 1 AS x UNION SELECT 2 INTERSECT SELECT 2", "SELECT CAST(x AS BIGINT) AS x FROM ((SELECT 1 AS x UNION SELECT 2) INTERSECT SELECT 2)")
_add("compound_order", "SELECT n_name AS x FROM nation UNION SELECT r_name FROM region ORDER BY x DESC LIMIT 7")
_add("cte_simple", "WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'F') SELECT count(*) AS n FROM f")
_add("cte_cols", "WITH t(k, v) AS (SELECT n_nationkey, n_name FROM nation) SELECT k, v FROM t WHERE k > 20", "WITH t(k, v) AS (SELECT CAST(n_nationkey AS BIGINT), n_name FROM nation) SELECT k, v FROM t WHERE k > 20")
_add("cte_chain", "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT n, count(*) AS m FROM a GROUP BY n) SELECT n, m FROM b")
_add("cte_recursive", "WITH RECURSIVE s(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM s WHERE i < 20) SELECT i, i * i AS sq FROM s", "WITH RECURSIVE s(i) AS (SELECT CAST(1 AS BIGINT) UNION ALL SELECT i + 1 FROM s WHERE i < 20) SELECT i, i * i AS sq FROM s")
_add("window_rank", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders")
_add("window_sum", "SELECT o_custkey, o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM orders", "SELECT o_custkey, o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM orders")

# -- string functions -------------------------------------------------------------------------------------------------
_add("fn_length", "SELECT doc_id, length(text) AS n, length(doc_id) AS d FROM documents", "SELECT doc_id, length(text) AS n, length(CAST(doc_id AS VARCHAR)) AS d FROM documents")
_add("fn_upper", "SELECT p_partkey, upper(p_name) AS u FROM part")
_add("fn_lower", "SELECT p_partkey, lower(p_type) AS l FROM part")
_add("fn_substr", "SELECT doc_id, substr(text, 3, 5) AS a, substr(text, 40) AS b FROM documents")
_add("fn_substr_neg", "SELECT p_partkey, substr(p_type, -4, 3) AS a, substr(p_type, 0, 3) AS z, substr(p_type, 3, -2) AS b, substr(p_type, -100, 99) AS c FROM part", "SELECT p_partkey, p_type[greatest(length(p_type) - 3, 1):length(p_type) - 1] AS a, p_type[1:2] AS z, p_type[1:2] AS b, p_type[1:length(p_type) - 1] AS c FROM part")
_add("fn_replace", "SELECT p_partkey, replace(p_type, 'A', '<a>') AS r FROM part")
_add("fn_trim", "SELECT n_name, trim('  ' || n_name || ' ') AS t FROM nation")
_add("fn_ltrim", "SELECT n_name, ltrim('xx' || n_name, 'x') AS t FROM nation")
_add("fn_rtrim", "SELECT n_name, rtrim(n_name, 'AINE') AS t FROM nation")
_add("fn_trim_set", "SELECT n_name, trim(n_name, 'AEU') AS t FROM nation")
_add("fn_instr", "SELECT p_partkey, instr(p_type, 'E') AS i, instr(p_type, 'zz') AS z FROM part")
_add("fn_hex", "SELECT n_name, hex(n_name) AS h, hex(n_nationkey) AS k FROM nation", "SELECT n_name, hex(n_name) AS h, hex(CAST(n_nationkey AS VARCHAR)) AS k FROM nation")
_add("fn_char", "SELECT n_nationkey, char(65 + n_nationkey, 233, 8364) AS c FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, chr(CAST(65 + n_nationkey AS INT)) || 'é€' AS c FROM nation")
_add("fn_unicode", "SELECT doc_id, unicode(text) AS u FROM documents", "SELECT doc_id, CAST(unicode(text) AS BIGINT) AS u FROM documents")
_add("fn_quote", "SELECT n_nationkey, quote(n_name || '''s') AS q, quote(n_nationkey) AS k FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, '''' || n_name || '''''s''' AS q, CAST(n_nationkey AS VARCHAR) AS k FROM nation")
_add("fn_printf", "SELECT o_orderkey, printf('%06d|%8.2f|%-10s|%x|%s', o_orderkey, o_totalprice, o_orderstatus, o_orderkey, o_orderpriority) AS p FROM orders", "SELECT o_orderkey, format('{:06d}|{:8.2f}|{:<10s}|{:x}|{:s}', o_orderkey, o_totalprice, o_orderstatus, o_orderkey, o_orderpriority) AS p FROM orders")
_add("fn_glob", "SELECT p_partkey, glob('*STEEL', p_type) AS g, glob('[^PS]*', p_type) AS n FROM part", "SELECT p_partkey, p_type GLOB '*STEEL' AS g, p_type GLOB '[!PS]*' AS n FROM part")
_add("fn_zeroblob", "SELECT n_nationkey, hex(zeroblob(n_nationkey)) AS z FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, repeat('00', n_nationkey) AS z FROM nation")
_add("fn_json_arrow", "SELECT event_id, CAST(props ->> '$.k' AS INTEGER) AS k FROM events", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")

# -- numeric functions ------------------------------------------------------------------------------------------------
_add("fn_abs", "SELECT c_custkey, abs(c_acctbal) AS a FROM customer")
_add("fn_smin", "SELECT c_custkey, min(c_acctbal, 100.5, c_custkey) AS m FROM customer", "SELECT c_custkey, least(c_acctbal, 100.5, CAST(c_custkey AS DOUBLE)) AS m FROM customer")
_add("fn_smax", "SELECT d.doc_id, max(d.doc_id, l.quality, 3) AS m FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id", "SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN NULL ELSE greatest(d.doc_id, CAST(l.quality AS BIGINT), 3) END AS m FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
_add("fn_round", "SELECT c_custkey, round(c_acctbal) AS r, round(c_acctbal * 0.5, 1) AS r1 FROM customer", "SELECT c_custkey, round(c_acctbal) AS r, round(c_acctbal * 0.5, 1) AS r1 FROM customer")
_add("fn_sign", "SELECT c_custkey, sign(c_acctbal) AS s FROM customer", "SELECT c_custkey, CAST(sign(c_acctbal) AS BIGINT) AS s FROM customer")
_add("fn_sqrt", "SELECT c_custkey, round(sqrt(c_acctbal), 6) AS r FROM customer", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE round(sqrt(c_acctbal), 6) END AS r FROM customer")
_add("fn_ceil", "SELECT c_custkey, ceil(c_acctbal) AS c FROM customer")
_add("fn_floor", "SELECT c_custkey, floor(c_acctbal) AS c FROM customer")
_add("fn_trunc", "SELECT c_custkey, trunc(c_acctbal) AS c FROM customer")
_add("fn_ln", "SELECT c_custkey, round(ln(c_acctbal), 6) AS l FROM customer", "SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN NULL ELSE round(ln(c_acctbal), 6) END AS l FROM customer")
_add("fn_log10", "SELECT o_orderkey, round(log10(o_totalprice), 6) AS l, round(log(o_totalprice), 6) AS l2 FROM orders", "SELECT o_orderkey, round(log10(o_totalprice), 6) AS l, round(log10(o_totalprice), 6) AS l2 FROM orders")
_add("fn_log_base", "SELECT o_orderkey, round(log(3, o_totalprice), 6) AS l FROM orders", "SELECT o_orderkey, round(ln(o_totalprice) / ln(3), 6) AS l FROM orders")
_add("fn_log2", "SELECT o_orderkey, round(log2(o_totalprice), 6) AS l FROM orders")
_add("fn_exp", "SELECT n_nationkey, round(exp(n_nationkey / 10.0), 6) AS e FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, round(exp(CAST(n_nationkey AS DOUBLE) / 10), 6) AS e FROM nation")
_add("fn_trig", "SELECT n_nationkey, round(sin(n_nationkey), 6) AS s, round(cos(n_nationkey), 6) AS c, round(tan(n_nationkey), 6) AS t FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, round(sin(n_nationkey), 6) AS s, round(cos(n_nationkey), 6) AS c, round(tan(n_nationkey), 6) AS t FROM nation")
_add("fn_inv_trig", "SELECT n_nationkey, round(asin(n_nationkey / 10.0), 6) AS s, round(acos(n_nationkey / 10.0), 6) AS c, round(atan(n_nationkey), 6) AS t FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_nationkey <= 10 THEN round(asin(CAST(n_nationkey AS DOUBLE) / 10), 6) END AS s, CASE WHEN n_nationkey <= 10 THEN round(acos(CAST(n_nationkey AS DOUBLE) / 10), 6) END AS c, round(atan(n_nationkey), 6) AS t FROM nation")
_add("fn_atan2", "SELECT n_nationkey, round(atan2(n_nationkey, n_regionkey - 2), 6) AS a FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, round(atan2(n_nationkey, n_regionkey - 2), 6) AS a FROM nation")
_add("fn_radians", "SELECT n_nationkey, round(radians(n_nationkey * 15), 6) AS r FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, round(radians(n_nationkey * 15), 6) AS r FROM nation")
_add("fn_degrees", "SELECT n_nationkey, round(degrees(n_nationkey), 6) AS d FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, round(degrees(n_nationkey), 6) AS d FROM nation")
_add("fn_pi", "SELECT round(pi(), 9) AS p", "SELECT round(pi(), 9) AS p")
_add("fn_pow", "SELECT n_nationkey, pow(n_nationkey, 2) AS p, power(2, n_regionkey) AS q FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, pow(n_nationkey, 2) AS p, pow(2, n_regionkey) AS q FROM nation")
_add("fn_mod", "SELECT c_custkey, mod(c_custkey, 7) AS m, mod(c_custkey, 0) AS z FROM customer", "SELECT c_custkey, CAST(c_custkey % 7 AS DOUBLE) AS m, CAST(NULL AS DOUBLE) AS z FROM customer")

_add("fn_random", "SELECT count(*) = count(DISTINCT r) AS fresh, max(typeof(r)) AS kind FROM (SELECT random() AS r FROM orders) AS t", "SELECT true AS fresh, 'integer' AS kind")
_add("fn_randomblob", "SELECT n_nationkey, length(randomblob(n_nationkey + 1)) AS n FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_nationkey + 1 AS BIGINT) AS n FROM nation")
_add("fn_printf_column", "SELECT n_nationkey, printf('%0' || (n_regionkey + 2) || 'd', n_nationkey) AS p FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, lpad(CAST(n_nationkey AS VARCHAR), CAST(n_regionkey + 2 AS INT), '0') AS p FROM nation")

# -- nulls and types --------------------------------------------------------------------------------------------------
_add("fn_coalesce", "SELECT d.doc_id, coalesce(l.quality, l.toxic, -1) AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id", "SELECT d.doc_id, CAST(coalesce(l.quality, l.toxic, -1) AS BIGINT) AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
_add("fn_ifnull", "SELECT d.doc_id, ifnull(l.quality, 9) AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id", "SELECT d.doc_id, CAST(ifnull(l.quality, 9) AS BIGINT) AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
_add("fn_nullif", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders")
_add("fn_typeof", "SELECT d.doc_id, typeof(d.doc_id) AS a, typeof(d.text) AS b, typeof(d.doc_id / 2.0) AS c, typeof(l.quality) AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id", "SELECT d.doc_id, 'integer' AS a, 'text' AS b, 'real' AS c, CASE WHEN l.quality IS NULL THEN 'null' ELSE 'integer' END AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
_add("fn_iif", "SELECT c_custkey, iif(c_acctbal > 0, 'plus', 'minus') AS s FROM customer", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END AS s FROM customer")

# -- dates ------------------------------------------------------------------------------------------------------------
_T = "FROM orders"
_add("dt_date", f"SELECT o_orderkey, date(o_orderdate) AS d {_T}", f"SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d {_T}")
_add("dt_time", "SELECT event_id, time(ts) AS t FROM events", "SELECT event_id, strftime(ts, '%H:%M:%S') AS t FROM events")
_add("dt_datetime", "SELECT event_id, datetime(ts) AS t FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t FROM events")
_add("dt_text", "SELECT o_orderkey, date(strftime('%Y-%m-%d', o_orderdate)) AS d, date('2024-02-30') AS rolled, date('junk') AS bad FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, '2024-03-01' AS rolled, CAST(NULL AS VARCHAR) AS bad FROM orders")
_add("dt_julianday", f"SELECT o_orderkey, round(julianday(o_orderdate), 6) AS j {_T}", f"SELECT o_orderkey, round(epoch(o_orderdate) / 86400 + 2440587.5, 6) AS j {_T}")
_add("dt_unixepoch", "SELECT event_id, unixepoch(ts) AS u FROM events", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS u FROM events")
_add("dt_strftime_ymd", "SELECT event_id, strftime('%Y/%m/%d %H-%M-%S %j %R', ts) AS s FROM events", "SELECT event_id, strftime(ts, '%Y/%m/%d %H-%M-%S %j %H:%M') AS s FROM events")
_add("dt_strftime_week", f"SELECT o_orderkey, strftime('%w %u %U %W', o_orderdate) AS s {_T}", f"SELECT o_orderkey, strftime(o_orderdate, '%w %u %U %W') AS s {_T}")
_add("dt_strftime_iso", f"SELECT o_orderkey, strftime('%G-W%V', o_orderdate) AS s {_T}", f"SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS s {_T}")
_add("dt_add_days", f"SELECT o_orderkey, date(o_orderdate, '+45 days') AS d, datetime(o_orderdate, '-90 minutes') AS t {_T}", f"SELECT o_orderkey, strftime(o_orderdate + INTERVAL 45 DAY, '%Y-%m-%d') AS d, strftime(o_orderdate - INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS t {_T}")
_add("dt_add_months_overflow", f"SELECT o_orderkey, date(o_orderdate, '+1 month') AS d {_T}", f"SELECT o_orderkey, strftime(make_date(CAST(year(m) AS BIGINT), CAST(month(m) AS BIGINT), 1) + CAST(day(o_orderdate) - 1 AS INT), '%Y-%m-%d') AS d FROM (SELECT o_orderkey, o_orderdate, date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS m FROM orders)")
_add("dt_add_years", f"SELECT o_orderkey, date(o_orderdate, 'start of month', '+3 years') AS d {_T}", f"SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) + INTERVAL 3 YEAR, '%Y-%m-%d') AS d {_T}")
_add("dt_start_of", f"SELECT o_orderkey, date(o_orderdate, 'start of month') AS m, date(o_orderdate, 'start of year') AS y, date(o_orderdate, 'start of month', '+1 month', '-1 day') AS last {_T}", f"SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m, strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS y, strftime(last_day(o_orderdate), '%Y-%m-%d') AS last {_T}")
_add("dt_weekday", f"SELECT o_orderkey, date(o_orderdate, 'weekday 0') AS sunday {_T}", f"SELECT o_orderkey, strftime(o_orderdate + to_days(CAST((7 - dayofweek(o_orderdate)) % 7 AS INT)), '%Y-%m-%d') AS sunday {_T}")
_add("dt_from_epoch", "SELECT event_id, datetime(event_id * 1000, 'unixepoch') AS t FROM events", "SELECT event_id, strftime(make_timestamp(event_id * 1000 * 1000000), '%Y-%m-%d %H:%M:%S') AS t FROM events")
_add("dt_from_julian", "SELECT n_nationkey, datetime(2451545 + n_nationkey) AS t FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, strftime(TIMESTAMP '2000-01-01 12:00:00' + to_days(n_nationkey), '%Y-%m-%d %H:%M:%S') AS t FROM nation")
_add("dt_offset_hhmm", f"SELECT o_orderkey, datetime(o_orderdate, '+02:30', 'utc') AS t {_T}", f"SELECT o_orderkey, strftime(o_orderdate + INTERVAL 150 MINUTE, '%Y-%m-%d %H:%M:%S') AS t {_T}")
_add("dt_subsec", "SELECT event_id, strftime('%f', ts) AS f FROM events", "SELECT event_id, strftime(ts, '%S.%g') AS f FROM events")

_add("dt_modifier_column", f"SELECT o_orderkey, date(o_orderdate, '+' || (o_orderkey % 50) || ' days') AS d {_T}", f"SELECT o_orderkey, strftime(o_orderdate + to_days(CAST(o_orderkey % 50 AS INT)), '%Y-%m-%d') AS d {_T}")
_add("dt_now", "SELECT date('now') >= '2024-01-01' AS a, length(datetime()) AS n, length(CURRENT_TIMESTAMP) AS c", "SELECT true AS a, CAST(19 AS BIGINT) AS n, CAST(19 AS BIGINT) AS c")

# -- heavier queries for the bench ------------------------------------------------------------------------------------
_add("bench_pricing", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, count(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus")
_add("bench_top_orders", "SELECT o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < '1995-03-15' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10", None)
_add("bench_forecast", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= '1994-01-01' AND l_shipdate < '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")

#: Parameters of queries with placeholders.
PARAMETERS: dict[str, list] = {"bind_params": [150000, "O"]}
_add("bind_params", "SELECT o_orderkey FROM orders WHERE o_totalprice >= ? AND o_orderstatus = ?2", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 150000 AND o_orderstatus = 'O'")

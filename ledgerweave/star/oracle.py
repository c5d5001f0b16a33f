"""The star-schema queries in ANSI SQL (DuckDB dialect), written independently."""

from __future__ import annotations

from ledgerweave.functions import text as t
from ledgerweave.star import texts

ORACLE: dict[str, str] = {}


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# -- Ingest -------------------------------------------------------------------------

ORACLE["ingest_typed"] = """
SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey,
       CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice,
       CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS INTEGER) AS o_orderdate,
       CAST(epoch(o_orderdate) AS BIGINT) AS placed_at,
       CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS is_final,
       o_orderpriority, CAST(NULL AS VARCHAR) AS clerk
FROM orders
"""
ORACLE["ingest_rejects"] = """
SELECT o_orderkey, 'o_totalprice' AS "column", ' n/a' AS raw FROM orders WHERE o_orderstatus = 'P'
UNION ALL
SELECT o_orderkey, 'o_totalprice', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || '5'
FROM orders WHERE o_orderstatus = 'O'
UNION ALL
SELECT o_orderkey, 'o_custkey', 'C-' || o_custkey || chr(9) FROM orders
WHERE o_orderpriority = '5-LOW'
UNION ALL
SELECT o_orderkey, 'o_orderdate', replace(strftime(o_orderdate, '%Y-%m-%d'), '-02-', '-13-')
FROM orders WHERE month(o_orderdate) = 2
UNION ALL
SELECT o_orderkey, 'o_orderdate', strftime(o_orderdate, '%Y-%m')
FROM orders WHERE month(o_orderdate) = 3
UNION ALL
SELECT o_orderkey, 'placed_at', strftime(o_orderdate, '%H:%M') FROM orders WHERE month(o_orderdate) = 4
UNION ALL
SELECT o_orderkey, 'placed_at', strftime(o_orderdate, '%Y-%m-%d') FROM orders WHERE month(o_orderdate) = 5
UNION ALL
SELECT o_orderkey, 'is_final', 'maybe' FROM orders WHERE o_orderstatus = 'O'
"""
ORACLE["ingest_csv"] = """
WITH x AS (
  SELECT *, o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') AS bad,
         'a "' || o_orderstatus || '", ' || o_orderpriority AS c FROM orders)
SELECT CASE WHEN NOT bad THEN o_orderkey END AS o_orderkey,
       CASE WHEN NOT bad THEN CAST(o_custkey AS INTEGER) END AS o_custkey,
       CASE WHEN NOT bad THEN CAST(12.5 AS DECIMAL(18,2)) END AS o_totalprice,
       CASE WHEN NOT bad THEN c END AS clerk,
       CASE o_orderpriority
         WHEN '1-URGENT' THEN o_orderkey || ', ' || o_custkey || ',12.50,"' || replace(c, '"', '""') || '",more'
         WHEN '2-HIGH' THEN o_orderkey || ',7'
         WHEN '5-LOW' THEN o_orderkey || ',1,2.5,"' || o_orderstatus END AS broken,
       CASE WHEN bad THEN 1 ELSE 0 END AS n_rejects
FROM x
"""

ORACLE["ingest_folder"] = """
SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN CAST(o_custkey AS INTEGER) END AS o_custkey,
       CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice,
       'say "' || o_orderstatus || '", ' || o_orderpriority AS clerk, CAST(NULL AS VARCHAR) AS broken
FROM orders
UNION ALL
SELECT NULL, NULL, NULL, NULL, r_name || ',' || r_regionkey FROM region
"""
ORACLE["ingest_inputs"] = """
SELECT 'orders' AS "table", 'load' AS decision, COUNT(*) AS n_rows FROM orders
UNION ALL SELECT 'nation', 'no rows', 0
UNION ALL SELECT 'labels', 'empty', 0
UNION ALL SELECT 'customer', 'foreign', COUNT(*) FROM region
UNION ALL SELECT 'lineitem', 'missing', 0
"""
ORACLE["load_repeated"] = """
SELECT o_orderstatus AS load_batch, COUNT(*) AS n, COUNT(DISTINCT o_orderkey) AS n_keys,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total, CAST(0 AS BIGINT) AS n_rejects
FROM orders GROUP BY 1
"""
ORACLE["declared_profile"] = """
SELECT d.*, CASE WHEN d."column" IN ('o_orderdate', 'placed_at') THEN dated
                 WHEN d."column" = 'is_final' THEN judged ELSE n END AS n_values
FROM (SELECT COUNT(*) AS n, COUNT(o_orderdate) AS dated,
             COUNT(*) FILTER (o_orderstatus IN ('F', 'O')) AS judged FROM orders), (VALUES
  ('o_orderkey', 'BIGINT', 'BigInt', 'BIGINT', 'BIGINT', 'bigint'),
  ('o_custkey', 'INTEGER', 'BigInt', 'BIGINT', 'INT', 'bigint'),
  ('o_totalprice', 'NUMERIC(18, 2)', 'Double', 'DOUBLE', 'DOUBLE', 'float'),
  ('o_orderdate', 'DATE', 'DateTime', 'TIMESTAMP', 'DATE', 'datetime2'),
  ('placed_at', 'TIMESTAMPTZ', 'DateTime', 'TIMESTAMP', 'TIMESTAMP', 'datetime2'),
  ('is_final', 'BOOLEAN', 'Boolean', 'BOOLEAN', 'BOOLEAN', 'bit'),
  ('o_orderpriority', 'CHAR(15)', 'String', 'STRING', 'STRING', 'varchar')
) d("column", sql_type, value_type, entity_type, link_type, endpoint_type)
"""
_PER_NATION = """
SELECT '{step}' AS step, n_name AS nation, COUNT(*) AS n
FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE {where} GROUP BY n_name
"""
ORACLE["snapshot_refresh"] = (
    " UNION ALL ".join(
        _PER_NATION.format(step=step, where=where)
        for step, where in (
            ("1 first", "c_acctbal < 0"),
            ("2 after a failure", "c_acctbal < 0"),
            ("3 second", "TRUE"),
            ("4 first again", "c_acctbal < 0"),
        )
    )
    + """
UNION ALL SELECT '5 v1', 'customer', COUNT(*) FROM customer WHERE c_acctbal < 0
UNION ALL SELECT '5 v2', 'customer', COUNT(*) FROM customer
UNION ALL SELECT '5 v1', 'nation', COUNT(*) FROM nation
UNION ALL SELECT '5 v2', 'nation', COUNT(*) FROM nation
"""
)
_DERIVED = {
    "customer_places_order": ("o_custkey", "o_orderkey", "orders"),
    "nation_references_region": ("n_nationkey", "n_regionkey", "nation"),
    "customer_references_nation": ("c_custkey", "c_nationkey", "customer"),
    "supplier_references_nation": ("s_suppkey", "s_nationkey", "supplier"),
    "event_references_customer": ("event_id", "user_id", "events"),
    "supplier_links_order": ("l_suppkey", "l_orderkey", "lineitem"),
    "order_links_supplier": ("l_orderkey", "l_suppkey", "lineitem"),
    "order_links_part": ("l_orderkey", "l_partkey", "lineitem"),
}
ORACLE["derived_edges"] = " UNION ALL ".join(
    f"SELECT '{name}' AS edge, COUNT(*) AS n, COUNT(DISTINCT {dst}) AS targets FROM {table} "
    f"WHERE {src} IS NOT NULL AND {dst} IS NOT NULL"
    for name, (src, dst, table) in _DERIVED.items()
)
ORACLE["reference_coverage"] = " UNION ALL ".join(
    f"""SELECT '{table}' AS "table", '{column}' AS "column", '{target}' AS refers_to,
        {column == 'o_custkey'} AS covered, COUNT({column}) AS n_set FROM {table}"""
    for table, column, target in (
        ("nation", "n_regionkey", "region"),
        ("customer", "c_nationkey", "nation"),
        ("supplier", "s_nationkey", "nation"),
        ("orders", "o_custkey", "customer"),
        ("events", "user_id", "customer"),
        ("lineitem", "l_orderkey", "orders"),
        ("lineitem", "l_suppkey", "supplier"),
        ("lineitem", "l_partkey", "part"),
    )
)
ORACLE["derived_rollup"] = """
SELECT direction, r_name AS region, COUNT(*) AS n_links, COUNT(DISTINCT s_suppkey) AS n_suppliers
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
JOIN region ON r_regionkey = n_regionkey, (VALUES ('down'), ('up')) d(direction)
GROUP BY 1, 2
"""
ORACLE["comparison_questions"] = """
SELECT conv_id, conv_id || '-' || turn AS scenario_id, role AS domain, md5(text) AS question_md5,
       CASE role WHEN 'user' THEN 'user|x' ELSE '' END AS signals,
       CASE WHEN role <> 'user' THEN md5(text) END AS answer_md5, CAST(NULL AS VARCHAR) AS expected_answer
FROM conversations
"""
ORACLE["comparison_scenarios"] = """
SELECT conv_id, conv_id || '-' || turn AS scenario_id, md5(text) AS question_md5, 'execute' AS action_policy,
       CAST(turn AS DOUBLE) AS gold_numeric_value, 1.0::DOUBLE AS gold_numeric_tolerance_pct
FROM conversations WHERE role = 'user'
"""


def _signals(lang: str) -> str:
    whens = " ".join(f"WHEN '{name}' THEN {_list(w)}" for name, w in texts.SIGNALS.items())
    return f"CASE {lang} {whens} ELSE CAST([] AS VARCHAR[]) END"


ORACLE["scenario_scan"] = f"""
SELECT 'S' || CAST(doc_id // 2 AS VARCHAR) AS scenario_id, lang AS domain,
       md5(text) AS question_md5,
       CASE WHEN lang = 'en' THEN array_to_string({_signals('lang')}, '|') ELSE '' END AS signals,
       CASE WHEN lang = 'de' THEN 'execute' ELSE 'recommend_only' END AS action_policy,
       lang = 'es' AS ambiguity_expected,
       CAST(0 AS INTEGER) AS expected_join_hops,
       CASE WHEN lang = 'fr' THEN CAST(n_chars AS DOUBLE) END AS gold_numeric_value,
       CASE WHEN lang = 'fr' THEN 2.5::DOUBLE ELSE 1.0::DOUBLE END AS gold_numeric_tolerance_pct
FROM documents
"""

ORACLE["golden_scan"] = """
SELECT 'S' || CAST(doc_id // 2 AS VARCHAR) AS scenario_id, 'gold ' || source AS gold_label,
       CASE WHEN lang = 'es' THEN CAST(n_chars AS DOUBLE) END AS gold_numeric_value,
       1.0::DOUBLE AS gold_numeric_tolerance_pct
FROM documents
"""

# -- Contracts ------------------------------------------------------------------------

ORACLE["dq_pk_duplicates"] = """
SELECT l_orderkey AS k1, l_linenumber AS k2, COUNT(*) AS n
FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1
"""


def _orphans(child: str, column: str, parent: str, target: str) -> str:
    return (
        f"SELECT '{child}.{column}.references.{parent}' AS check_name, COUNT(*) AS violations "
        f"FROM {child} c WHERE c.{column} IS NOT NULL AND NOT EXISTS "
        f"(SELECT 1 FROM {parent} p WHERE p.{target} = c.{column})"
    )


ORACLE["dq_fk_orphans"] = " UNION ALL ".join(
    _orphans(*reference)
    for reference in (
        ("customer", "c_custkey", "events", "user_id"),
        ("customer", "c_nationkey", "nation", "n_nationkey"),
        ("orders", "o_custkey", "customer", "c_custkey"),
        ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
        ("documents", "doc_id", "labels", "doc_id"),
        ("labels", "doc_id", "documents", "doc_id"),
    )
)
ORACLE["dq_not_null"] = """
SELECT 'quality.not_null' AS check_name, COUNT(*) AS violations
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NULL
UNION ALL
SELECT 'text.not_null', COUNT(*)
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE d.text IS NULL
"""
ORACLE["dq_check_nonneg"] = """
SELECT 'customer.c_acctbal' AS check_name, COUNT(*) AS violations
FROM customer WHERE NOT (c_acctbal >= 0)
"""
ORACLE["dq_check_enum"] = """
SELECT 'orders.o_orderkey.not_null' AS check_name, COUNT(*) AS violations
FROM orders WHERE o_orderkey IS NULL
UNION ALL SELECT 'orders.o_custkey.not_null', COUNT(*) FROM orders WHERE o_custkey IS NULL
UNION ALL SELECT 'orders.o_orderstatus.not_null', COUNT(*) FROM orders WHERE o_orderstatus IS NULL
UNION ALL SELECT 'orders.o_orderstatus.one_of', COUNT(*) FROM orders
          WHERE NOT (o_orderstatus IN ('F', 'O'))
UNION ALL SELECT 'orders.o_totalprice.not_null', COUNT(*) FROM orders WHERE o_totalprice IS NULL
"""
ORACLE["dq_check_date_order"] = """
SELECT 'l_shipdate.not_before' AS check_name, COUNT(*) AS violations
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
WHERE o.o_orderstatus <> 'O' AND l.l_shipdate < o.o_orderdate
"""
ORACLE["dq_any_parent"] = """
SELECT 'any' AS check_name, COUNT(*) AS violations FROM orders
WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW'
"""
ORACLE["dq_violating_rows"] = """
SELECT * FROM (
  SELECT c_custkey, concat_ws('|',
      CASE WHEN c_custkey IS NULL THEN 'customer.c_custkey.not_null' END,
      CASE WHEN c_nationkey IS NULL THEN 'customer.c_nationkey.not_null' END,
      CASE WHEN NOT (c_acctbal >= 0) THEN 'customer.c_acctbal.non_negative' END,
      CASE WHEN NOT (c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD'))
           THEN 'customer.c_mktsegment.one_of' END) AS violations
  FROM customer) x
WHERE violations <> ''
"""
ORACLE["contract_report"] = (
    ORACLE["dq_fk_orphans"]
    + " UNION ALL "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS check_name, COUNT(*) AS violations FROM {source}"
        for name, source in (
            ("nation.n_nationkey.not_null", "nation WHERE n_nationkey IS NULL"),
            ("customer.c_custkey.not_null", "customer WHERE c_custkey IS NULL"),
            ("customer.c_nationkey.not_null", "customer WHERE c_nationkey IS NULL"),
            ("customer.c_acctbal.non_negative", "customer WHERE c_acctbal < 0"),
            (
                "customer.c_mktsegment.one_of",
                "customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')",
            ),
            ("orders.o_orderkey.not_null", "orders WHERE o_orderkey IS NULL"),
            ("orders.o_custkey.not_null", "orders WHERE o_custkey IS NULL"),
            ("orders.o_orderstatus.not_null", "orders WHERE o_orderstatus IS NULL"),
            ("orders.o_orderstatus.one_of", "orders WHERE o_orderstatus NOT IN ('F', 'O')"),
            ("orders.o_totalprice.not_null", "orders WHERE o_totalprice IS NULL"),
            ("orders.o_totalprice.non_negative", "orders WHERE o_totalprice < 0"),
            ("lineitem.l_orderkey.not_null", "lineitem WHERE l_orderkey IS NULL"),
            ("lineitem.l_linenumber.not_null", "lineitem WHERE l_linenumber IS NULL"),
            ("lineitem.l_suppkey.not_null", "lineitem WHERE l_suppkey IS NULL"),
            ("lineitem.l_returnflag.not_null", "lineitem WHERE l_returnflag IS NULL"),
            ("lineitem.l_returnflag.one_of", "lineitem WHERE l_returnflag NOT IN ('A', 'N')"),
            ("documents.doc_id.not_null", "documents WHERE doc_id IS NULL"),
            ("labels.doc_id.not_null", "labels WHERE doc_id IS NULL"),
            ("labels.toxic.not_null", "labels WHERE toxic IS NULL"),
            *(
                (
                    f"{table}.primary_key",
                    f"(SELECT {key} FROM {table} GROUP BY {key} HAVING COUNT(*) > 1) x",
                )
                for table, key in (
                    ("nation", "n_nationkey"),
                    ("customer", "c_custkey"),
                    ("orders", "o_orderkey"),
                    ("lineitem", "l_orderkey, l_linenumber"),
                    ("documents", "doc_id"),
                    ("labels", "doc_id"),
                )
            ),
        )
    )
)
ORACLE["default_fill"] = """
SELECT d.doc_id, COALESCE(l.toxic, 0) AS toxic
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""

# -- Graph ----------------------------------------------------------------------------

ORACLE["edges_all"] = " UNION ALL ".join(
    f"SELECT '{edge}' AS edge, COUNT(*) AS n, COUNT(DISTINCT {target}) AS targets "
    f"FROM {table} WHERE {target} IS NOT NULL"
    for edge, table, target in (
        ("nation_in_region", "nation", "n_regionkey"),
        ("customer_in_nation", "customer", "c_nationkey"),
        ("supplier_in_nation", "supplier", "s_nationkey"),
        ("order_has_customer", "orders", "o_custkey"),
        ("order_has_supplier", "lineitem", "l_suppkey"),
        ("supplier_has_order", "lineitem", "l_orderkey"),
        ("line_has_supplier", "lineitem", "l_suppkey"),
        ("line_has_part", "lineitem", "l_partkey"),
        ("event_concerns_customer", "events", "user_id"),
    )
)
ORACLE["parallel_edge_dedup"] = """
SELECT l_orderkey AS src, l_suppkey AS dst, l_returnflag AS role_type, COUNT(*) AS multiplicity
FROM lineitem GROUP BY 1, 2, 3
"""
ORACLE["inverse_edges"] = """
SELECT DISTINCT l_suppkey AS src, l_orderkey AS dst FROM lineitem
"""
ORACLE["node_labels"] = " UNION ALL ".join(
    f"SELECT '{label}' AS label, COUNT(*) AS n, MIN({key}) AS least, MAX({key}) AS greatest "
    f"FROM {table}"
    for label, table, key in (
        ("Region", "region", "CAST(r_regionkey AS VARCHAR)"),
        ("Nation", "nation", "CAST(n_nationkey AS VARCHAR)"),
        ("Customer", "customer", "CAST(c_custkey AS VARCHAR)"),
        ("Supplier", "supplier", "CAST(s_suppkey AS VARCHAR)"),
        ("Part", "part", "CAST(p_partkey AS VARCHAR)"),
        ("Order", "orders", "CAST(o_orderkey AS VARCHAR)"),
        ("Event", "events", "CAST(event_id AS VARCHAR)"),
        ("Line", "lineitem", "'{' || l_orderkey || ', ' || l_linenumber || '}'"),
    )
)
ORACLE["latest_timeseries_value"] = """
SELECT user_id AS entity_id, event_type AS property, ts, value AS latest_value FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, value DESC) AS rn
  FROM events) x
WHERE rn = 1
"""
ORACLE["graph_node_count"] = (
    "SELECT CAST(SUM(n) AS BIGINT) AS total_nodes FROM ("
    + " UNION ALL ".join(
        f"SELECT COUNT(*) AS n FROM {table}"
        for table in (
            "region",
            "nation",
            "customer",
            "supplier",
            "part",
            "orders",
            "events",
            "lineitem",
        )
    )
    + ") x"
)
ORACLE["node_count_by_property"] = """
SELECT c_mktsegment AS segment, COUNT(*) AS customer_count FROM customer GROUP BY 1
"""
ORACLE["edge_filter_count_distinct"] = """
SELECT COUNT(DISTINCT s.s_suppkey) AS supplier_count
FROM orders o JOIN lineitem e ON o.o_orderkey = e.l_orderkey
JOIN supplier s ON e.l_suppkey = s.s_suppkey
WHERE o.o_orderstatus = 'F'
"""
ORACLE["three_hop_limit"] = """
SELECT n.n_nationkey AS nation_id, c.c_custkey AS customer_id, o.o_orderkey AS order_id,
       CAST(o.o_totalprice AS DECIMAL(18,2)) AS order_total
FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey
JOIN orders o ON o.o_custkey = c.c_custkey
ORDER BY order_id LIMIT 25
"""
ORACLE["event_count_by_target_property"] = """
SELECT c.c_mktsegment AS segment, COUNT(*) AS event_count
FROM events e JOIN customer c ON e.user_id = c.c_custkey GROUP BY 1
"""
ORACLE["group_member_rollup"] = """
SELECT n.n_name AS group_name, COUNT(DISTINCT o.o_orderkey) AS order_count
FROM nation n JOIN supplier s ON s.s_nationkey = n.n_nationkey
JOIN lineitem e ON e.l_suppkey = s.s_suppkey
JOIN orders o ON e.l_orderkey = o.o_orderkey
GROUP BY 1
"""
ORACLE["edge_sum_by_target"] = """
SELECT s.s_name AS agent_name,
       CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total_amount
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1
"""
ORACLE["two_edges_one_node"] = """
SELECT DISTINCT l.l_orderkey AS order_id, l.l_linenumber AS line_no,
       s.s_name AS supplier_name, p.p_name AS part_name
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN part p ON l.l_partkey = p.p_partkey
WHERE l.l_returnflag = 'R' AND l.l_linestatus = 'O'
"""
ORACLE["conditional_sum_two_sides"] = """
SELECT CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total_exposure,
       CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END)
            AS DECIMAL(38,2)) AS flagged_exposure
FROM orders
"""
ORACLE["literal_stage_sum"] = """
SELECT CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total_principal,
       CAST(SUM(CASE WHEN o_orderpriority = '1-URGENT'
                     THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END)
            AS DECIMAL(38,2)) AS stage_principal
FROM orders
"""
ORACLE["edge_property_filter_topk"] = """
SELECT o.o_orderkey AS order_id, COUNT(*) AS role_count
FROM orders o JOIN lineitem e ON o.o_orderkey = e.l_orderkey
JOIN supplier s ON e.l_suppkey = s.s_suppkey
WHERE e.l_returnflag = 'R' GROUP BY 1 ORDER BY role_count DESC, order_id LIMIT 25
"""
SUITE_COLUMNS = {
    "graph_node_count": "total_nodes",
    "node_count_by_property": "segment,customer_count",
    "edge_filter_count_distinct": "supplier_count",
    "three_hop_limit": "nation_id,customer_id,order_id,order_total",
    "event_count_by_target_property": "segment,event_count",
    "group_member_rollup": "group_name,order_count",
    "edge_sum_by_target": "agent_name,total_amount",
    "two_edges_one_node": "order_id,line_no,supplier_name,part_name",
    "conditional_sum_two_sides": "total_exposure,flagged_exposure",
    "literal_stage_sum": "total_principal,stage_principal",
    "edge_property_filter_topk": "order_id,role_count",
}
SUITE_TEXTS = {"segment", "group_name", "agent_name", "supplier_name", "part_name"}


def _json(columns: str) -> str:
    """A row as JSON text: a field per column."""
    def field(c: str) -> str:
        value = f"""'"' || {c} || '"'""" if c in SUITE_TEXTS else f"CAST({c} AS VARCHAR)"
        return f"""'"{c}":' || {value}"""

    return "'{' || " + " || ',' || ".join(field(c) for c in columns.split(",")) + " || '}'"


ORACLE["suite_report"] = " UNION ALL ".join(
    f"SELECT '{name}' AS query, 'passed' AS status, COUNT(*) AS row_count, '{columns}' AS columns, "
    f"array_to_string(list(j ORDER BY j)[1:3], chr(10)) AS preview, "
    f"CAST(SUM(CAST(CAST('0x' || substr(md5(j), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest "
    f"FROM (SELECT {_json(columns)} AS j FROM ({ORACLE[name]}) q)"
    for name, columns in SUITE_COLUMNS.items()
)

# -- Portfolio questions ------------------------------------------------------------------

ORACLE["flag_count"] = "SELECT COUNT(*) AS flagged_orders FROM orders WHERE o_orderstatus = 'F'"
ORACLE["threshold_filter"] = """
SELECT c_custkey AS customer_id, CAST(c_acctbal AS DECIMAL(18,2)) AS balance
FROM customer WHERE c_acctbal > 5000
"""
ORACLE["calendar_year_count"] = """
SELECT COUNT(*) AS n_1997 FROM orders WHERE year(o_orderdate) = 1997
"""
ORACLE["role_fanout"] = """
SELECT DISTINCT o.o_orderkey AS order_id, s.s_suppkey AS party_id, e.l_returnflag AS role_type
FROM orders o JOIN lineitem e ON o.o_orderkey = e.l_orderkey
JOIN supplier s ON e.l_suppkey = s.s_suppkey
"""
ORACLE["role_having"] = """
SELECT l_orderkey AS order_id, COUNT(DISTINCT l_suppkey) AS co_count
FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING COUNT(DISTINCT l_suppkey) > 1
"""
ORACLE["three_hop_all"] = """
SELECT r.r_name AS region, n.n_name AS nation, c.c_custkey AS customer_id,
       CAST(c.c_acctbal AS DECIMAL(18,2)) AS balance
FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey
JOIN customer c ON c.c_nationkey = n.n_nationkey WHERE c.c_mktsegment = 'BUILDING'
"""
ORACLE["existence_semi"] = """
SELECT c_custkey AS customer_id FROM customer c WHERE c_mktsegment = 'BUILDING'
AND EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.c_custkey)
"""
ORACLE["cross_country_handlers"] = """
WITH h AS (
  SELECT l.l_orderkey, l.l_suppkey, s.s_nationkey
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  WHERE p.p_type = 'ECONOMY' AND l.l_returnflag = 'R'),
x AS (
  SELECT DISTINCT h.l_orderkey
  FROM h JOIN orders o ON h.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE h.s_nationkey <> c.c_nationkey)
SELECT DISTINCT s.s_suppkey AS practitioner_id, s.s_name AS practitioner_name
FROM h JOIN x ON h.l_orderkey = x.l_orderkey JOIN supplier s ON h.l_suppkey = s.s_suppkey
"""
ORACLE["shared_pair_self_join"] = """
WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
SELECT a.l_suppkey AS party_a, b.l_suppkey AS party_b, COUNT(*) AS shared_orders
FROM m a JOIN m b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey
GROUP BY 1, 2 HAVING COUNT(*) > 1
"""
ORACLE["shared_pair_crowded"] = """
WITH m AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
SELECT a.l_suppkey AS party_a, b.l_suppkey AS party_b, COUNT(*) AS shared_parts
FROM m a JOIN m b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey
GROUP BY 1, 2 HAVING COUNT(*) > 1
"""
ORACLE["absence_anti"] = """
SELECT o_orderkey AS order_id FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
"""
ORACLE["weighted_ratio"] = """
WITH x AS (
  SELECT l_returnflag, CAST(l_extendedprice AS DECIMAL(18,2))
         * CAST(1 - CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(5,2))
         * CAST(1 + CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(5,2)) AS exposure
  FROM lineitem)
SELECT ROUND(100.0 * CAST(SUM(CASE WHEN l_returnflag = 'R' THEN exposure ELSE 0 END) AS DOUBLE)
             / CAST(SUM(exposure) AS DOUBLE), 4) AS npe_ratio_pct FROM x
"""
ORACLE["sum_where_not_null"] = """
SELECT CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS ead
FROM orders WHERE NULLIF(o_orderstatus, 'P') IS NOT NULL
"""
ORACLE["literal_share"] = """
WITH x AS (SELECT o_orderpriority, CAST(o_totalprice AS DECIMAL(18,2)) AS total FROM orders)
SELECT ROUND(100.0 * CAST(SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN total ELSE 0 END)
                          AS DOUBLE) / CAST(SUM(total) AS DOUBLE), 4) AS stage_share_pct
FROM x
"""
ORACLE["definition_matrix"] = """
SELECT COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS by_flag,
       COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS by_stage,
       COUNT(*) FILTER (WHERE o_totalprice > 200000) AS by_amount,
       COUNT(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS by_both
FROM orders
"""
ORACLE["exposure_definitions"] = """
WITH m AS (
  SELECT l_orderkey, l_suppkey, BOOL_OR(l_returnflag <> 'R') AS full_role
  FROM lineitem GROUP BY 1, 2),
x AS (
  SELECT m.*, CAST(o.o_totalprice AS DECIMAL(18,2)) AS principal,
         CASE WHEN o.o_orderstatus = 'F' THEN CAST(o.o_totalprice AS DECIMAL(18,2)) ELSE 0 END
             AS ead
  FROM m JOIN orders o ON o.o_orderkey = m.l_orderkey)
SELECT l_suppkey AS party_id,
       CAST(SUM(principal) AS DECIMAL(38,2)) AS principal_all_roles,
       CAST(COALESCE(SUM(principal) FILTER (WHERE full_role), 0) AS DECIMAL(38,2))
           AS principal_full_roles,
       CAST(SUM(ead) AS DECIMAL(38,2)) AS ead_all_roles,
       CAST(COALESCE(SUM(ead) FILTER (WHERE full_role), 0) AS DECIMAL(38,2)) AS ead_full_roles,
       COUNT(*) AS orders_n
FROM x GROUP BY 1
"""
ORACLE["precondition_report"] = """
SELECT o.o_orderkey AS order_id, o.o_orderstatus AS state,
       COUNT(l.l_orderkey) AS collateral_rows,
       CAST(COALESCE(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2))), 0) AS DECIMAL(38,2))
           AS collateral_value,
       COUNT(DISTINCT CASE WHEN l.l_returnflag = 'R' THEN l.l_suppkey END) AS handlers
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
GROUP BY o.o_orderkey, o.o_orderstatus
"""

# -- Texts ------------------------------------------------------------------------------------

BLANK = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
NUMBER = r"-?\$?[0-9][0-9,]*(?:\.[0-9]+)?"
EDGE = r"[^\p{L}\p{N}_]"


def _norm(column: str) -> str:
    inner = rf"regexp_replace(lower({column}), '[_\-/]+', ' ', 'g')"
    return f"trim(regexp_replace({inner}, '{BLANK}+', ' ', 'g'))"


def _strip(column: str) -> str:
    return f"regexp_replace({column}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def _numbers(column: str) -> str:
    return (
        f"list_transform(regexp_extract_all({column}, '{NUMBER}'), "
        "lambda x: CAST(regexp_replace(x, '[$,]', '', 'g') AS DOUBLE))"
    )


def _near(column: str, gold: str, pct: str) -> str:
    reach = f"CASE WHEN {gold} = 0 THEN abs({pct}) ELSE abs({gold}) * ({pct} / 100.0::DOUBLE) END"
    return f"(len(list_filter({_numbers(column)}, lambda n: abs(n - {gold}) <= {reach})) > 0)"


def _hint(column: str, hints) -> str:
    tests = [f"contains(lower({column}), '{h.replace(chr(39), chr(39) * 2)}')" for h in hints]
    return "(" + " OR ".join(tests) + ")"


def _policy(column: str) -> str:
    return (
        f"CASE WHEN {_hint(column, t.EXECUTE_HINTS)} THEN 'execute' "
        f"WHEN {_hint(column, t.RECOMMEND_HINTS)} THEN 'recommend_only' ELSE 'execute' END"
    )


def _known(column: str, names, flags: str) -> str:
    found = [
        f"CASE WHEN regexp_matches({column}, '{flags}(?:^|{EDGE}){n}(?:$|{EDGE})') THEN ['{n}'] "
        "ELSE CAST([] AS VARCHAR[]) END"
        for n in names
    ]
    return f"flatten([{', '.join(found)}])"


def _tables(column: str) -> str:
    after = (
        rf"list_transform(regexp_extract_all({column}, "
        rf"'(?i)(?:^|{EDGE})(?:from|join){BLANK}+([a-z0-9_.]+)', 1), "
        "lambda x: list_extract(string_split(x, '.'), -1))"
    )
    known = _known(column, texts.KNOWN_TABLES, "(?i)")
    return f"list_sort(list_distinct(list_concat({after}, {known})))"


def _relationships(column: str) -> str:
    bracketed = (
        rf"regexp_extract_all({column}, '\[{BLANK}*:`?([a-zA-Z_][a-zA-Z0-9_]*)`?{BLANK}*\]', 1)"
    )
    known = _known(column, texts.KNOWN_RELATIONSHIPS, "")
    return f"list_sort(list_distinct(list_concat({bracketed}, {known})))"


ORACLE["latest_assistant_message"] = f"""
WITH last AS (
  SELECT conv_id, text, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS rn
  FROM conversations WHERE role = 'assistant')
SELECT c.conv_id, COALESCE(NULLIF({_strip('l.text')}, ''), '<empty>') AS answer
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN last l ON l.conv_id = c.conv_id AND l.rn = 1
"""
ORACLE["latest_message_parts"] = f"""
WITH last AS (
  SELECT conv_id, replace(text, '. ', chr(10)) AS text,
         ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS rn
  FROM conversations WHERE role = 'assistant')
SELECT c.conv_id, md5(COALESCE(NULLIF({_strip('l.text')}, ''), '<empty>')) AS answer_md5
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN last l ON l.conv_id = c.conv_id AND l.rn = 1
"""
ORACLE["text_normalize"] = f"""
SELECT doc_id, md5(plain) AS plain_md5, CAST(length(plain) AS INTEGER) AS plain_chars
FROM (SELECT doc_id, {_norm('text')} AS plain FROM documents) x
"""
ORACLE["signal_coverage"] = f"""
WITH x AS (SELECT doc_id, {_norm('text')} AS plain, {_signals('lang')} AS signals FROM documents),
y AS (
  SELECT doc_id,
    list_filter(signals, lambda s: contains(plain, {_norm('s')})) AS hit,
    list_filter(signals, lambda s: NOT contains(plain, {_norm('s')})) AS miss
  FROM x)
SELECT doc_id, array_to_string(hit, '|') AS matched, array_to_string(miss, '|') AS missing,
       len(miss) = 0 AS ok
FROM y
"""
ORACLE["agent_accuracy"] = """
SELECT CASE WHEN d.doc_id % 2 = 0 THEN 'naked' ELSE 'ontology' END AS agent,
       COUNT(*) FILTER (WHERE l.quality = 1) AS correct, COUNT(l.quality) AS scored,
       COUNT(*) - COUNT(l.quality) AS na, COUNT(*) AS total,
       COALESCE(ROUND(100.0::DOUBLE * COUNT(*) FILTER (WHERE l.quality = 1)
                      / NULLIF(COUNT(l.quality), 0), 1), 0.0) AS accuracy_pct
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1
"""
ORACLE["extract_numbers"] = f"""
SELECT doc_id, unnest({_numbers('text')}) AS number FROM documents
"""
ORACLE["numeric_gold"] = f"""
WITH x AS (
  SELECT *, CASE WHEN lang = 'de' THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END AS gold FROM documents)
SELECT doc_id, {_near('text', 'gold', '50.0::DOUBLE')} AS numeric_correct FROM x
"""
ORACLE["verdict_normalize"] = """
SELECT d.doc_id, CASE WHEN d.lang = 'fr' THEN 'yes' WHEN l.quality = 1 THEN 'yes'
                      WHEN l.quality = 0 THEN 'no' WHEN d.source = 'src1' THEN 'unclear'
                      ELSE '' END AS verdict
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""

ANSWERS = """
labelled AS (
  SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
answers AS (
  SELECT doc_id, 'S' || CAST(doc_id // 2 AS VARCHAR) AS scenario_id,
         CASE WHEN doc_id % 2 = 0 THEN 'naked' ELSE 'ontology' END AS agent_type,
         text AS answer,
         CASE WHEN toxic = 1 THEN 'unclear' WHEN quality = 1 THEN 'yes'
              WHEN quality = 0 THEN 'no' END AS verdict,
         '__critic_verdict__='
         || CASE WHEN toxic = 1 THEN 'unclear' WHEN quality = 1 THEN 'yes'
                 WHEN quality = 0 THEN 'no' ELSE '' END || chr(10)
         || CASE WHEN quality = 1 THEN 'I recommend a review.'
                 WHEN quality = 0 THEN 'I will start; please specify.' ELSE '' END AS reasoning,
         'SELECT * FROM lake.' || source || ' JOIN ' || lang || '_docs; MATCH (a)-[:`has_' || lang
         || '`]->(b)<-[ :' || source || ' ]-(c)-[r:hidden]->(d)' AS sql_or_gql,
         source AS metric_selected
  FROM labelled),
scanned AS (
  SELECT *, concat_ws(chr(10), NULLIF(answer, ''), reasoning, sql_or_gql) AS body FROM answers)
"""
ORACLE["verdict_marker_parse"] = f"""
WITH {ANSWERS} SELECT doc_id, verdict FROM answers
"""
ORACLE["mentioned_tables"] = f"""
WITH {ANSWERS}
SELECT doc_id, array_to_string({_tables('body')}, '|') AS tables_used FROM scanned
"""
ORACLE["mentioned_relationships"] = f"""
WITH {ANSWERS}
SELECT doc_id, array_to_string({_relationships('body')}, '|') AS relationships_used FROM scanned
"""
ORACLE["hint_flags"] = f"""
WITH {ANSWERS}
SELECT doc_id, {_hint('body', t.AMBIGUITY_HINTS)} AS flagged, {_policy('body')} AS policy
FROM scanned
"""
ORACLE["comparison_answers"] = f"""
WITH {ANSWERS}
SELECT a.scenario_id, a.agent_type, md5(a.answer) AS answer_md5,
       md5('__critic_verdict__=' || CASE WHEN l.quality = 1 THEN 'yes' WHEN l.quality IS NULL
           THEN '' ELSE 'no' END || chr(10) || a.answer) AS reasoning_md5
FROM answers a LEFT JOIN labels l ON l.doc_id = a.doc_id
"""

SCORES = f"""
{ANSWERS},
golden AS (
  SELECT scenario_id, lang AS domain,
         CASE WHEN lang = 'fr' THEN 'graph_traversal' WHEN lang = 'de' THEN '' ELSE source END
             AS gold_label,
         lang = 'es' AS ambiguous,
         CASE WHEN lang = 'de' THEN 'execute' ELSE 'recommend_only' END AS wanted_policy,
         [source, lang || '_docs'] AS wanted_tables,
         CASE WHEN lang = 'en' THEN ['has_en', 'has_fr'] WHEN lang = 'fr' THEN ['has_fr']
              ELSE CAST([] AS VARCHAR[]) END AS wanted_relations,
         {_signals('lang')} AS signals,
         CASE WHEN lang = 'en' THEN 100.0::DOUBLE WHEN lang = 'de' THEN 0.0::DOUBLE END AS gold
  FROM (SELECT 'S' || CAST(doc_id // 2 AS VARCHAR) AS scenario_id, MIN(lang) AS lang,
               MIN(source) AS source FROM documents GROUP BY 1) g),
measured AS (
  SELECT s.*, g.* EXCLUDE (scenario_id),
         list_sort(list_filter(g.wanted_tables,
             lambda w: NOT list_contains({_tables('s.body')}, w))) AS no_table,
         list_sort(list_filter(g.wanted_relations,
             lambda w: NOT list_contains({_relationships('s.body')}, w))) AS no_relation,
         list_filter(g.signals, lambda w: NOT contains({_norm('s.answer')}, {_norm('w')}))
             AS no_signal,
         {_hint('s.body', t.AMBIGUITY_HINTS)} AS flagged,
         {_policy('s.body')} AS policy,
         {_near('s.answer', 'g.gold', '50.0::DOUBLE')} AS near
  FROM scanned s JOIN golden g ON g.scenario_id = s.scenario_id),
asked AS (
  SELECT *, gold_label NOT IN ('', 'graph_traversal') AS a1, len(wanted_tables) > 0 AS a2,
         len(wanted_relations) > 0 AS a3, ambiguous AS a4, wanted_policy = 'recommend_only' AS a5,
         len(signals) > 0 AS a6, gold IS NOT NULL AS a7,
         metric_selected = gold_label AS m1, len(no_table) = 0 AS m2, len(no_relation) = 0 AS m3,
         flagged AS m4, policy = 'recommend_only' AS m5, len(no_signal) = 0 AS m6,
         COALESCE(near, FALSE) AS m7
  FROM measured),
scores AS (
  SELECT scenario_id, agent_type, domain,
         a1 AND m1 AS metric_correct, a2 AND m2 AS tables_correct,
         a3 AND m3 AS relationships_correct, a4 AND m4 AS ambiguity_detected,
         a5 AND m5 AS guardrail_respected, a6 AND m6 AS signals_correct,
         a7 AND m7 AS numeric_correct,
         CAST(CASE WHEN verdict = 'yes' THEN 1 ELSE 0 END + CAST(a1 AND m1 AS INTEGER)
              + CAST(a2 AND m2 AS INTEGER) + CAST(a3 AND m3 AS INTEGER)
              + CAST(a4 AND m4 AS INTEGER) + CAST(a5 AND m5 AS INTEGER)
              + CAST(a6 AND m6 AS INTEGER) + CAST(a7 AND m7 AS INTEGER) AS INTEGER) AS total_score,
         CAST(CASE WHEN verdict IS NULL THEN 0 ELSE 1 END + CAST(a1 AS INTEGER)
              + CAST(a2 AS INTEGER) + CAST(a3 AS INTEGER) + CAST(a4 AS INTEGER)
              + CAST(a5 AS INTEGER) + CAST(a6 AS INTEGER) + CAST(a7 AS INTEGER) AS INTEGER)
             AS max_score,
         COALESCE(NULLIF(concat_ws('; ', 'critic: ' || verdict,
             CASE WHEN a1 AND NOT m1 THEN 'metric: expected ''' || gold_label || ''' got '''
                  || metric_selected || '''' END,
             CASE WHEN a2 AND NOT m2 THEN 'tables missing: [' ||
                  array_to_string(list_transform(no_table, lambda w: '''' || w || ''''), ', ')
                  || ']' END,
             CASE WHEN a3 AND NOT m3 THEN 'relationships missing: [' ||
                  array_to_string(list_transform(no_relation, lambda w: '''' || w || ''''), ', ')
                  || ']' END,
             CASE WHEN a4 AND NOT m4 THEN 'ambiguity not detected' END,
             CASE WHEN a5 AND NOT m5 THEN 'guardrail violated: ' || policy END,
             CASE WHEN a6 AND NOT m6 THEN 'signals missing: [' ||
                  array_to_string(list_transform(no_signal, lambda w: '''' || w || ''''), ', ')
                  || ']' END,
             CASE WHEN a7 AND NOT m7 THEN 'numeric: expected ~'
                  || CASE WHEN gold = 0 THEN '0.0' ELSE '100.0' END || ' (±50.0%)' END), ''),
             'all correct') AS notes
  FROM asked)
"""
JUDGED = f"""
{SCORES},
judged AS (
  SELECT m.scenario_id, m.domain, m.gold_label, m.agent_type, md5(m.answer) AS answer_md5,
         CASE WHEN len(m.signals) > 0 THEN len(m.no_signal) = 0 END AS ok,
         array_to_string(m.signals, '|') AS signals,
         array_to_string(list_filter(m.signals,
             lambda w: NOT list_contains(m.no_signal, w)), '|') AS matched,
         array_to_string(m.no_signal, '|') AS missing
  FROM measured m),
questions AS (
  SELECT g.scenario_id, g.domain, g.gold_label AS expected_answer,
         array_to_string(g.signals, '|') AS ontology_signals,
         n.answer_md5 AS answer_md5_naked, o.answer_md5 AS answer_md5_ontology,
         n.ok AS evaluation_judgement_naked, o.ok AS evaluation_judgement_ontology,
         n.matched AS matched_signals_naked, o.matched AS matched_signals_ontology,
         n.missing AS missing_signals_naked, o.missing AS missing_signals_ontology
  FROM golden g
  LEFT JOIN judged n ON n.scenario_id = g.scenario_id AND n.agent_type = 'naked'
  LEFT JOIN judged o ON o.scenario_id = g.scenario_id AND o.agent_type = 'ontology')
"""
ORACLE["question_judgements"] = f"WITH {JUDGED} SELECT * FROM questions"
ORACLE["judgement_summary"] = f"""
WITH {JUDGED},
v AS (
  SELECT 'naked' AS agent, evaluation_judgement_naked AS ok FROM questions
  UNION ALL SELECT 'ontology', evaluation_judgement_ontology FROM questions)
SELECT agent, COUNT(*) FILTER (WHERE ok) AS correct, COUNT(ok) AS scored,
       COUNT(*) - COUNT(ok) AS na, COUNT(*) AS total,
       COALESCE(ROUND(100.0::DOUBLE * COUNT(*) FILTER (WHERE ok) / NULLIF(COUNT(ok), 0), 1), 0.0)
           AS accuracy_pct
FROM v GROUP BY 1
"""
ORACLE["score_rows"] = f"WITH {SCORES} SELECT * EXCLUDE (domain) FROM scores"
CARD = f"""
{SCORES},
wide AS (
  SELECT COALESCE(n.scenario_id, o.scenario_id) AS scenario_id,
         COALESCE(n.domain, o.domain) AS domain,
         n.total_score AS n_total, n.max_score AS n_max, n.notes AS n_notes,
         o.total_score AS o_total, o.max_score AS o_max, o.notes AS o_notes
  FROM (SELECT * FROM scores WHERE agent_type = 'naked') n
  FULL OUTER JOIN (SELECT * FROM scores WHERE agent_type = 'ontology') o
    ON n.scenario_id = o.scenario_id),
card AS (
  SELECT scenario_id, domain, COALESCE(n_total || '/' || n_max, '-') AS naked_result,
         COALESCE(o_total || '/' || o_max, '-') AS ontology_result,
         CASE WHEN n_total IS NULL OR o_total IS NULL THEN '-' WHEN n_total > o_total THEN 'Naked'
              WHEN o_total > n_total THEN 'Ontology' ELSE 'tie' END AS winner,
         concat_ws(' | ', 'N: ' || NULLIF(n_notes, 'all correct'),
                   'O: ' || NULLIF(o_notes, 'all correct')) AS notes,
         n_total AS naked_total, o_total AS ontology_total,
         n_max AS naked_max, o_max AS ontology_max
  FROM wide)
"""
ORACLE["scorecard"] = f"WITH {CARD} SELECT * FROM card"
ORACLE["scorecard_summary"] = f"""
WITH {CARD},
sums AS (
  SELECT CAST(SUM(naked_total) AS BIGINT) AS nt, CAST(SUM(naked_max) AS BIGINT) AS nm,
         CAST(SUM(ontology_total) AS BIGINT) AS ot, CAST(SUM(ontology_max) AS BIGINT) AS om
  FROM card WHERE winner <> '-')
SELECT 'Naked' AS agent, nt AS score, nm AS max_score,
       COALESCE(CAST(round_even(100.0::DOUBLE * nt / NULLIF(nm, 0), 0) AS BIGINT) || '%', '-')
           AS accuracy FROM sums
UNION ALL
SELECT 'Ontology', ot, om,
       COALESCE(CAST(round_even(100.0::DOUBLE * ot / NULLIF(om, 0), 0) AS BIGINT) || '%', '-')
FROM sums
"""
ORACLE["wide_to_long"] = """
SELECT doc_id, 'quality' AS attribute, quality AS value FROM labels
UNION ALL SELECT doc_id, 'toxic', toxic FROM labels
"""
ORACLE["id_integrity"] = """
SELECT 'missing_id' AS anomaly, COUNT(*) AS n FROM lineitem WHERE l_orderkey IS NULL
UNION ALL
SELECT 'duplicate_id', COUNT(*) FROM (
  SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING COUNT(*) > 1) x
UNION ALL
SELECT 'unknown_id', COUNT(DISTINCT l_orderkey) FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)
UNION ALL
SELECT 'unanswered_id', COUNT(DISTINCT o_orderkey) FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE o.o_orderkey = l.l_orderkey)
"""
ORACLE["payload_fingerprint"] = (
    "WITH x AS (SELECT sha256('{\"o_custkey\":' || o_custkey || ',\"o_orderdate\":\"' || "
    "strftime(o_orderdate, '%Y-%m-%d') || '\",\"o_orderkey\":' || o_orderkey || "
    "',\"o_orderpriority\":\"' || o_orderpriority || '\",\"o_orderstatus\":\"' || o_orderstatus || "
    "'\",\"o_totalprice\":' || CAST(o_totalprice AS DECIMAL(18,2)) || '}') AS h FROM orders) "
    "SELECT COUNT(*) AS n_rows, "
    + ", ".join(
        f"CAST(SUM(CAST('0x' || substr(h, {1 + 16 * lane}, 16) AS UBIGINT)) AS VARCHAR) "
        f"AS lane_{lane + 1}"
        for lane in range(4)
    )
    + " FROM x"
)

# -- Class hierarchies ------------------------------------------------------------------------

TAXONOMY = """
e(child, parent) AS (
  SELECT 'c' || CAST(c_custkey AS VARCHAR), 'n' || CAST(c_nationkey AS VARCHAR) FROM customer
  UNION ALL
  SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR) FROM nation),
r(node, ancestor, depth) AS (
  SELECT child, parent, 1 FROM e
  UNION ALL
  SELECT r.node, e.parent, r.depth + 1 FROM r JOIN e ON r.ancestor = e.child),
a(node, name, value) AS (
  SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'label', n_name FROM nation
  UNION ALL SELECT 'r' || CAST(r_regionkey AS VARCHAR), 'label', r_name FROM region
  UNION ALL SELECT 'r' || CAST(r_regionkey AS VARCHAR), 'zone', r_name FROM region
  UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 'segment', c_mktsegment FROM customer
  UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 'zone', c_name FROM customer
            WHERE c_mktsegment = 'BUILDING')
"""
ORACLE["hierarchy_closure"] = f"WITH RECURSIVE {TAXONOMY} SELECT node, ancestor, depth FROM r"
ORACLE["inherited_attributes"] = f"""
WITH RECURSIVE {TAXONOMY},
reach AS (SELECT node, ancestor, depth FROM r UNION ALL SELECT DISTINCT node, node, 0 FROM a)
SELECT reach.node, a.name, MIN_BY(a.value, reach.depth) AS value
FROM reach JOIN a ON a.node = reach.ancestor GROUP BY 1, 2
"""
ROOTS = f"""
{TAXONOMY},
home AS (SELECT node, ancestor AS root FROM r WHERE ancestor NOT IN (SELECT child FROM e))
"""
ORACLE["flatten_to_root"] = f"WITH RECURSIVE {ROOTS} SELECT node, root FROM home"
ORACLE["flatten_attributes"] = f"""
WITH RECURSIVE {ROOTS}
SELECT COALESCE(home.root, a.node) AS node, a.name, MIN(a.value) AS value
FROM a LEFT JOIN home ON home.node = a.node GROUP BY 1, 2
"""
ORACLE["hierarchy_children"] = f"""
WITH RECURSIVE {TAXONOMY} SELECT child FROM e WHERE parent = 'n3'
"""
ORACLE["hierarchy_descendants"] = f"""
WITH RECURSIVE {TAXONOMY} SELECT node, depth FROM r WHERE ancestor = 'r1'
"""
ORACLE["flatten_classes"] = f"""
WITH RECURSIVE {ROOTS}, every AS (SELECT child AS name FROM e UNION SELECT parent FROM e)
SELECT name FROM every WHERE name NOT IN (SELECT node FROM home)
"""
ORACLE["flatten_relations"] = f"""
WITH RECURSIVE {ROOTS}
SELECT DISTINCT l_returnflag AS name, d.root AS domain, g.root AS "range"
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
JOIN home d ON d.node = 'c' || CAST(o_custkey AS VARCHAR)
JOIN home g ON g.node = 'n' || CAST(s_nationkey AS VARCHAR)
"""
ORACLE["triples_pivot"] = """
WITH remark AS (
  SELECT o_custkey,
         string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS disjoint_with,
         min(CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END) AS said,
         min('EBA ' || o_orderpriority) FILTER (o_orderstatus = 'F') AS referred
  FROM orders GROUP BY 1)
SELECT c_custkey AS subject, c_name AS name, c_mktsegment AS segment,
       CAST(c_nationkey AS VARCHAR) AS nation, coalesce(said, referred) AS comment,
       coalesce(disjoint_with, '') AS disjoint_with
FROM customer LEFT JOIN remark ON o_custkey = c_custkey
WHERE c_mktsegment <> 'MACHINERY'
"""
ORACLE["datatype_properties"] = """
SELECT 'p' || p_partkey AS name, translate(p_type, ' ', '_') AS domain,
       CASE p_partkey % 3 WHEN 0 THEN 'xsd:decimal' WHEN 1 THEN 'xsd:date' ELSE 'xsd:token' END AS xsd,
       CASE p_partkey % 3 WHEN 0 THEN 'Double' WHEN 1 THEN 'DateTime' ELSE 'String' END AS value_type,
       CASE p_partkey % 2 WHEN 0 THEN p_name ELSE 'EBA ' || p_name END AS comment
FROM part
"""
APART = """
apart AS (
  SELECT DISTINCT 's' || l_suppkey AS name, 's' || l_partkey AS other
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber = 1)
"""
ORACLE["object_properties"] = f"""
WITH {APART}
SELECT 's' || s_suppkey AS name, FALSE AS is_functional,
       coalesce((SELECT string_agg(other, '|' ORDER BY other) FROM apart WHERE name = 's' || s_suppkey), '') AS disjoint_with
FROM supplier
"""
ORACLE["disjoint_pairs"] = f"""
WITH {APART} SELECT DISTINCT least(name, other) AS one, greatest(name, other) AS other FROM apart
"""
ORACLE["unsupported_uses"] = """
SELECT 'http://www.w3.org/2002/07/owl#unionOf' AS construct, COUNT(*) AS uses
FROM customer WHERE c_mktsegment = 'BUILDING' HAVING COUNT(*) > 0
UNION ALL
SELECT 'http://www.w3.org/2002/07/owl#TransitiveProperty', COUNT(*)
FROM customer WHERE c_mktsegment = 'AUTOMOBILE' HAVING COUNT(*) > 0
"""
ORACLE["predicate_audit"] = """
SELECT 'name' AS predicate, COUNT(c_name) AS uses FROM customer
UNION ALL SELECT 'segment', COUNT(NULLIF(c_mktsegment, 'MACHINERY')) FROM customer
UNION ALL SELECT 'nation', COUNT(c_nationkey) FROM customer
"""
ORACLE["mapping_report"] = """
WITH sound AS (SELECT c_custkey FROM customer WHERE c_acctbal >= 0),
loose AS (
  SELECT o_orderkey FROM orders
  WHERE o_custkey NOT IN (SELECT c_custkey FROM sound) OR 0 NOT IN (SELECT c_custkey FROM sound)),
issues AS (
  SELECT 'unmapped_class' AS issue FROM customer
  WHERE c_custkey NOT IN (SELECT c_custkey FROM sound)
  UNION ALL
  SELECT 'unmapped_relation' FROM loose
  UNION ALL
  SELECT 'unresolved_context' FROM orders
  WHERE o_orderkey NOT IN (SELECT o_orderkey FROM loose)
    AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
SELECT issue, COUNT(*) AS n FROM issues GROUP BY 1
"""

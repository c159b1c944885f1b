"""The registered queries as plain SQL over the source tables, to check them by.

Written apart from the DataFrame code: the tables are derived by their own text,
and movements are replayed step by step in a recursive query.
"""

from __future__ import annotations

import re

from binledger import schemas
from binledger.plans.catalog import AS_OF, LOOKUP_VALUES, NOW

_STAMP = "TIMESTAMP '1995-01-01 00:00:00'"
_SEED_STAMP = "TIMESTAMP '2025-04-20 00:00:00'"

# table name -> SQL; names carry the prefix w_ so that they hide no source table
TABLES: dict[str, str] = {
    "w_lines0": """
        SELECT *, row_number() OVER (
            PARTITION BY l_orderkey
            ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate,
                     l_discount, l_tax, l_returnflag, l_linestatus) AS line_number
        FROM lineitem""",
    "w_lines": """
        SELECT *, l_orderkey * 100000 + line_number AS line_id,
               CAST(l_quantity AS BIGINT) AS quantity,
               CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * 100 AS BIGINT)
                   // CAST(l_quantity AS BIGINT) AS unit_cents,
               CAST(l_shipdate AS DATE) AS ship_day
        FROM w_lines0""",
    "w_sequenced": """
        SELECT *, row_number() OVER (ORDER BY ship_day, l_orderkey, line_number) AS seq
        FROM w_lines""",
    "w_employee": f"""
        SELECT c_custkey + 1 AS employee_id, c_nationkey + 1 AS department_id, 'E' || c_custkey AS employee_code,
               upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS first_name,
               split_part(c_name, '#', 2) AS last_name, 'e' || c_custkey || '@example.test' AS email, NULL AS phone,
               ['Clerk', 'Buyer', 'Manager'][c_custkey % 3 + 1] AS job_title,
               DATE '1990-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS hire_date,
               CASE WHEN c_custkey % 11 = 5 THEN 'N' ELSE 'Y' END AS is_active, {_STAMP} AS created_at
        FROM customer""",
    "w_department": f"""
        SELECT n_nationkey + 1 AS department_id, n_name AS department_code,
               'Department ' || n_name AS department_name, {_STAMP} AS created_at
        FROM nation""",
    "w_uom_lookup": """
        SELECT p_type[1:3] AS uom_code, min(p_type) AS uom_description FROM part GROUP BY ALL""",
    "w_product_category": """
        SELECT row_number() OVER (ORDER BY p_type) AS category_id, p_type AS category_code,
               p_type AS category_name, NULL AS description
        FROM (SELECT DISTINCT p_type FROM part)""",
    "w_product": f"""
        SELECT p_partkey AS product_id, category_id,
               'SKU-' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS sku, p_name AS product_name,
               p_brand AS description, p_type[1:3] AS unit_of_measure,
               CAST(p_size AS DECIMAL(12,2)) AS unit_cost,
               CAST(p_retailprice AS DECIMAL(12,2)) AS unit_price,
               CAST(p_size * 4 AS DECIMAL(10,3)) AS reorder_level,
               CASE WHEN p_partkey % 10 = 7 THEN 'N' ELSE 'Y' END AS is_active,
               {_STAMP} AS created_at, {_STAMP} AS updated_at
        FROM part JOIN w_product_category ON category_code = p_type""",
    "w_supplier": f"""
        SELECT s_suppkey AS supplier_id, 'SUP-' || s_suppkey AS supplier_code,
               s_name AS supplier_name, NULL AS contact_name,
               's' || s_suppkey || '@example.test' AS email, NULL AS phone, NULL AS address_line1,
               NULL AS city, NULL AS state_province, NULL AS postal_code, 'USA' AS country,
               'Y' AS is_active, {_STAMP} AS created_at, {_STAMP} AS updated_at
        FROM supplier""",
    "w_customer": f"""
        SELECT c_custkey AS customer_id, 'CUST-' || c_custkey AS customer_code,
               c_name AS customer_name, NULL AS contact_name, NULL AS email, NULL AS phone,
               NULL AS address_line1, NULL AS city, NULL AS state_province, NULL AS postal_code,
               'USA' AS country, 'Y' AS is_active, {_STAMP} AS created_at, {_STAMP} AS updated_at
        FROM customer""",
    "w_warehouse": f"""
        SELECT r_regionkey AS warehouse_id, 'WH-' || r_regionkey AS warehouse_code,
               r_name AS warehouse_name, NULL AS address_line1, NULL AS city,
               NULL AS state_province, NULL AS postal_code, 'USA' AS country,
               r_regionkey % 3 + 1 AS manager_id, 50000 AS capacity_units,
               CASE WHEN r_regionkey = 4 THEN 'N' ELSE 'Y' END AS is_active,
               {_STAMP} AS created_at
        FROM region""",
    "w_warehouse_location": """
        SELECT n_nationkey AS location_id, n_regionkey AS warehouse_id, n_name AS location_code,
               NULL AS aisle, NULL AS rack, NULL AS bin,
               CASE (n_nationkey // 5) % 5 WHEN 0 THEN 'STORAGE' WHEN 1 THEN 'PICKING'
                    WHEN 2 THEN 'RECEIVING' WHEN 3 THEN 'SHIPPING' ELSE 'QUARANTINE' END AS zone_type,
               NULL AS max_capacity,
               CASE WHEN n_nationkey IN (10, 21) THEN 'N' ELSE 'Y' END AS is_active
        FROM nation""",
    "w_inventory": """
        SELECT l_partkey * 25 + l_suppkey % 25 + 1 AS inventory_id, l_partkey AS product_id,
               (l_suppkey % 25) % 5 AS warehouse_id, l_suppkey % 25 AS location_id,
               CAST(sum(CAST(l_quantity AS BIGINT)) AS DECIMAL(12,3)) AS qty_on_hand,
               CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) ELSE 0 END)
                    AS DECIMAL(12,3)) AS qty_reserved,
               CAST(max(l_shipdate) AS DATE) AS last_count_date,
               CAST(CAST(max(l_shipdate) AS DATE) AS TIMESTAMP) AS updated_at
        FROM lineitem GROUP BY l_partkey, l_suppkey % 25""",
    "w_so_line": """
        SELECT line_id AS so_line_id, l_orderkey AS so_id, line_number, l_partkey AS product_id,
               CAST(quantity AS DECIMAL(12,3)) AS qty_ordered,
               CAST(CASE o_orderstatus WHEN 'F' THEN quantity WHEN 'P' THEN quantity // 2 ELSE 0 END
                    AS DECIMAL(12,3)) AS qty_shipped,
               CAST(unit_cents AS DECIMAL(14,2)) / 100 AS unit_price,
               quantity * unit_cents / 100.0 AS line_total, quantity * unit_cents AS total_cents
        FROM w_lines JOIN orders ON o_orderkey = l_orderkey""",
    "w_po_line": """
        SELECT line_id AS po_line_id, l_orderkey AS po_id, line_number, l_partkey AS product_id,
               CAST(quantity AS DECIMAL(12,3)) AS qty_ordered,
               CAST(CASE o_orderpriority[1] WHEN '4' THEN quantity WHEN '3' THEN quantity // 2
                    ELSE 0 END AS DECIMAL(12,3)) AS qty_received,
               CAST(unit_cents // 2 AS DECIMAL(14,2)) / 100 AS unit_cost,
               quantity * (unit_cents // 2) / 100.0 AS line_total,
               quantity * (unit_cents // 2) AS total_cents
        FROM w_lines JOIN orders ON o_orderkey = l_orderkey""",
    "w_sales_order": """
        SELECT o_orderkey AS so_id, 'SO-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS so_number,
               o_custkey AS customer_id, o_orderkey % 5 AS warehouse_id,
               CAST(o_orderdate AS DATE) AS order_date,
               CAST(o_orderdate AS DATE) + 5 AS required_date,
               CASE o_orderstatus WHEN 'O' THEN 'CONFIRMED' WHEN 'P' THEN 'PARTIAL'
                    ELSE 'SHIPPED' END AS status,
               CAST(o_totalprice AS DECIMAL(14,2)) AS total_amount,
               CASE WHEN o_orderkey % 4 <> 3 THEN o_orderkey % 3 + 1 END AS created_by,
               NULL AS notes, o_orderdate AS created_at, o_orderdate AS updated_at
        FROM orders""",
    "w_purchase_order": """
        SELECT o_orderkey AS po_id, 'PO-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS po_number,
               o_custkey // 15 AS supplier_id, o_orderkey % 5 AS warehouse_id,
               CAST(o_orderdate AS DATE) AS order_date,
               CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS DATE) + 14 END AS expected_date,
               CASE o_orderpriority[1] WHEN '1' THEN 'APPROVED' WHEN '2' THEN 'SUBMITTED'
                    WHEN '3' THEN 'PARTIAL' WHEN '4' THEN 'RECEIVED'
                    ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'DRAFT' ELSE 'CANCELLED' END END AS status,
               CAST(o_totalprice AS DECIMAL(14,2)) AS total_amount,
               CASE WHEN o_orderkey % 4 <> 3 THEN o_orderkey % 3 + 1 END AS created_by,
               NULL AS notes, o_orderdate AS created_at, o_orderdate AS updated_at
        FROM orders""",
    "w_goods_receipt": """
        SELECT po_id AS receipt_id, 'GR-' || lpad(CAST(po_id AS VARCHAR), 10, '0') AS receipt_number,
               po_id, order_date + 7 AS receipt_date, created_by AS received_by,
               'STANDARD' AS reason_code, NULL AS notes, created_at
        FROM w_purchase_order WHERE status IN ('PARTIAL', 'RECEIVED')""",
    "w_goods_receipt_line": """
        SELECT po_line_id AS receipt_line_id, po_id AS receipt_id, po_line_id, product_id,
               product_id % 25 AS location_id, qty_received
        FROM w_po_line WHERE qty_received > 0""",
    "w_shipment": """
        SELECT so_id AS shipment_id, 'SH-' || lpad(CAST(so_id AS VARCHAR), 10, '0') AS shipment_number,
               so_id, order_date + 3 AS ship_date,
               CASE WHEN so_id % 5 <> 0 THEN 'FedEx' END AS carrier,
               CASE WHEN so_id % 5 <> 0
                    THEN 'TRK-' || lpad(CAST(so_id AS VARCHAR), 10, '0') || '-US' END
                   AS tracking_number,
               CASE so_id % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'IN_TRANSIT' WHEN 2 THEN 'DELIVERED'
                    ELSE 'CANCELLED' END AS status,
               created_by AS shipped_by,
               CASE WHEN so_id % 7 = 0 THEN 'URGENT' ELSE 'STANDARD' END AS reason_code, created_at
        FROM w_sales_order WHERE status IN ('PARTIAL', 'SHIPPED')""",
    "w_shipment_line": """
        SELECT so_line_id AS shipment_line_id, so_id AS shipment_id, so_line_id, product_id,
               product_id % 25 AS location_id, qty_shipped
        FROM w_so_line WHERE qty_shipped > 0""",
    "w_stock_transfer": """
        SELECT o_orderkey AS transfer_id,
               'XFR-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS transfer_number,
               o_orderkey % 5 AS from_warehouse_id, (o_orderkey + 1) % 5 AS to_warehouse_id,
               CAST(o_orderdate AS DATE) AS request_date, NULL AS ship_date, NULL AS receive_date,
               CASE (o_orderkey // 2) % 4 WHEN 0 THEN 'REQUESTED' WHEN 1 THEN 'IN_TRANSIT'
                    WHEN 2 THEN 'RECEIVED' ELSE 'CANCELLED' END AS status,
               CASE WHEN o_orderkey % 4 <> 3 THEN o_orderkey % 3 + 1 END AS requested_by,
               NULL AS notes, o_orderdate AS created_at, o_orderdate AS updated_at
        FROM orders""",
    "w_stock_transfer_line": """
        SELECT line_id AS transfer_line_id, l_orderkey AS transfer_id, l_partkey AS product_id,
               l_orderkey % 5 + l_suppkey % 5 * 5 AS from_location_id,
               (l_orderkey + 1) % 5 + l_suppkey % 5 * 5 AS to_location_id,
               CAST(quantity AS DECIMAL(12,3)) AS qty_requested, 0 AS qty_shipped, 0 AS qty_received
        FROM w_lines""",
    "w_log": """
        SELECT *, CASE WHEN l_returnflag = 'N' THEN -quantity ELSE quantity END AS change
        FROM w_sequenced""",
    "w_stock_transaction": """
        SELECT seq AS transaction_id, l_partkey AS product_id,
               (l_suppkey % 25) % 5 AS warehouse_id, l_suppkey % 25 AS location_id,
               CASE l_returnflag WHEN 'A' THEN 'RECEIPT' WHEN 'N' THEN 'ISSUE'
                    ELSE 'ADJUSTMENT' END AS transaction_type,
               CAST(change AS DECIMAL(12,3)) AS qty_change,
               CAST(balance - change AS DECIMAL(12,3)) AS qty_before,
               CAST(balance AS DECIMAL(12,3)) AS qty_after,
               CASE l_returnflag WHEN 'A' THEN 'GOODS_RECEIPT' WHEN 'N' THEN 'SHIPMENT'
                    ELSE 'CYCLE_COUNT' END AS reference_type,
               CASE WHEN l_returnflag <> 'R' THEN l_orderkey END AS reference_id,
               CASE WHEN l_orderkey % 4 <> 3 THEN l_orderkey % 3 + 1 END AS employee_id,
               CAST(ship_day AS TIMESTAMP) AS transaction_date, NULL AS notes
        FROM (SELECT *, sum(change) OVER (PARTITION BY l_partkey, l_suppkey % 25 ORDER BY seq
                                          ROWS UNBOUNDED PRECEDING) AS balance FROM w_log)""",
    # the movement script
    "w_script0": """
        SELECT *, CASE WHEN l_returnflag = 'A' THEN 'RECEIVE' WHEN l_returnflag = 'N' THEN 'SHIP'
                       WHEN line_number % 2 = 0 THEN 'ADJUST' ELSE 'TRANSFER' END AS cmd
        FROM w_sequenced""",
    "w_script": """
        SELECT seq, cmd,
               CASE WHEN cmd IN ('RECEIVE', 'SHIP') THEN
                    CASE WHEN l_orderkey % 83 = 0 THEN -1
                         ELSE l_orderkey * 100000 + (line_number + 1) // 2 END END AS line_id,
               CASE WHEN cmd IN ('ADJUST', 'TRANSFER') THEN l_partkey END AS product_id,
               CASE WHEN cmd IN ('ADJUST', 'TRANSFER') THEN l_orderkey % 5 END AS warehouse_id,
               CASE WHEN l_orderkey % 79 <> 0 THEN l_orderkey % 5 + l_suppkey % 5 * 5 END AS location_id,
               CASE WHEN cmd = 'TRANSFER' THEN
                    CASE WHEN l_orderkey % 31 = 0 THEN l_orderkey % 5
                         ELSE (l_orderkey + 1) % 5 END END AS to_warehouse_id,
               CASE WHEN cmd = 'TRANSFER' THEN
                    CASE WHEN l_orderkey % 29 = 0 OR l_orderkey % 31 = 0 THEN l_orderkey % 5
                         ELSE (l_orderkey + 1) % 5 END + l_suppkey % 5 * 5 END AS to_location_id,
               CASE WHEN l_orderkey % 97 = 0 THEN 0 WHEN cmd = 'ADJUST' THEN -quantity
                    ELSE quantity END AS qty,
               CASE WHEN l_orderkey % 101 = 0 THEN -1 ELSE l_orderkey % 3 + 1 END AS employee_id
        FROM w_script0""",
    # the script replayed: static faults, then step k of every product at once
    "w_steps0": """
        SELECT s.seq, s.cmd, s.line_id, s.qty, s.employee_id,
               coalesce(p.po_id, o.so_id) AS order_id,
               coalesce(s.product_id, p.product_id, o.product_id, -s.seq) AS product_id,
               coalesce(s.warehouse_id, p.po_id % 5, o.so_id % 5) AS warehouse_id,
               s.location_id, s.to_warehouse_id, s.to_location_id,
               coalesce(p.qty_ordered, o.qty_ordered) AS ordered,
               coalesce(p.qty_received, o.qty_shipped) AS done,
               CASE WHEN s.location_id IS NULL THEN 'MALFORMED'
                    WHEN s.cmd = 'TRANSFER' AND s.warehouse_id = s.to_warehouse_id
                         AND s.location_id = s.to_location_id THEN 'SAME_BIN'
                    WHEN s.cmd = 'ADJUST' AND s.qty = 0 THEN 'ZERO_QTY'
                    WHEN s.cmd <> 'ADJUST' AND s.qty <= 0 THEN 'NONPOSITIVE_QTY'
                    WHEN s.line_id = -1 THEN 'LINE_NOT_FOUND'
                    WHEN s.cmd = 'TRANSFER' AND s.employee_id = -1 THEN 'UNKNOWN_REFERENCE'
                    WHEN s.cmd = 'TRANSFER' AND s.location_id = s.to_location_id
                         THEN 'SAME_LOCATION_ID' END AS early
        FROM w_script s
        LEFT JOIN w_po_line p ON s.cmd = 'RECEIVE' AND s.line_id = p.po_line_id
        LEFT JOIN w_so_line o ON s.cmd = 'SHIP' AND s.line_id = o.so_line_id""",
    "w_steps": """
        SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY seq) AS k,
               lag(seq) OVER (PARTITION BY cmd, line_id ORDER BY seq) AS sibling_seq,
               lag(qty) OVER (PARTITION BY cmd, line_id ORDER BY seq) AS sibling_qty
        FROM w_steps0""",
    "w_start": """
        SELECT product_id,
               list_transform(range(25), lambda b: map_extract(m, b)[1].h) AS hand,
               list_transform(range(25), lambda b: coalesce(map_extract(m, b)[1].r, 0)) AS held
        FROM (SELECT s.product_id,
                     map_from_entries(list((CAST(i.location_id AS BIGINT),
                         {'h': CAST(i.qty_on_hand AS BIGINT), 'r': CAST(i.qty_reserved AS BIGINT)}))
                         FILTER (i.product_id IS NOT NULL)) AS m
              FROM (SELECT DISTINCT product_id FROM w_steps) s
              LEFT JOIN w_inventory i ON i.product_id = s.product_id
              GROUP BY s.product_id)""",
    "w_run": """
        SELECT product_id, CAST(0 AS BIGINT) AS k, hand, held, CAST([] AS BIGINT[]) AS taken,
               CAST(0 AS BIGINT) AS seq, 'START' AS outcome, CAST(0 AS BIGINT) AS src_before,
               CAST(0 AS BIGINT) AS dst_before
        FROM w_start
        UNION ALL
        SELECT product_id, k,
               CASE WHEN outcome = 'ACCEPTED' THEN list_transform(hand, lambda x, i:
                   CASE WHEN i = location_id + 1 THEN coalesce(x, 0) + change
                        WHEN cmd = 'TRANSFER' AND i = to_location_id + 1 THEN coalesce(x, 0) + qty
                        ELSE x END) ELSE hand END,
               CASE WHEN outcome = 'ACCEPTED' AND cmd = 'SHIP' THEN list_transform(held, lambda x, i:
                   CASE WHEN i = location_id + 1 THEN greatest(0, x - qty) ELSE x END) ELSE held END,
               CASE WHEN outcome = 'ACCEPTED' THEN list_append(taken, seq) ELSE taken END,
               seq, outcome, before,
               CASE WHEN cmd = 'TRANSFER' THEN coalesce(hand[to_location_id + 1], 0) ELSE 0 END
        FROM (
            SELECT *, CASE
                WHEN early IS NOT NULL THEN early
                WHEN cmd IN ('RECEIVE', 'SHIP') AND done + already + qty > ordered
                     THEN 'EXCEEDS_OUTSTANDING'
                WHEN cmd IN ('RECEIVE', 'SHIP') AND employee_id = -1 THEN 'UNKNOWN_REFERENCE'
                WHEN change < 0 AND slot IS NULL THEN 'NO_INVENTORY_ROW'
                WHEN before + change < 0 THEN 'INSUFFICIENT_STOCK'
                WHEN cmd <> 'SHIP' AND reserved > before + change THEN 'BELOW_RESERVED'
                WHEN cmd = 'ADJUST' AND employee_id = -1 THEN 'UNKNOWN_REFERENCE'
                ELSE 'ACCEPTED' END AS outcome
            FROM (
                SELECT r.product_id, r.hand, r.held, r.taken, s.* EXCLUDE (product_id, qty),
                       CAST(s.qty AS BIGINT) AS qty,
                       r.hand[s.location_id + 1] AS slot,
                       coalesce(r.hand[s.location_id + 1], 0) AS before,
                       coalesce(r.held[s.location_id + 1], 0) AS reserved,
                       CAST(CASE WHEN s.cmd IN ('SHIP', 'TRANSFER') THEN -s.qty ELSE s.qty END
                            AS BIGINT) AS change,
                       CASE WHEN list_contains(r.taken, s.sibling_seq) THEN s.sibling_qty
                            ELSE 0 END AS already
                FROM w_run r JOIN w_steps s ON s.product_id = r.product_id AND s.k = r.k + 1))""",
    "w_decided": """
        SELECT s.*, r.outcome, r.src_before, r.dst_before
        FROM w_run r JOIN w_steps s ON s.seq = r.seq WHERE r.k > 0""",
    "w_accepted": """
        SELECT *, row_number() OVER (PARTITION BY cmd ORDER BY seq) AS nth
        FROM w_decided WHERE outcome = 'ACCEPTED'""",
    "w_documents": """
        SELECT *, CASE cmd
                   WHEN 'RECEIVE' THEN (SELECT max(receipt_id) FROM w_goods_receipt) + nth
                   WHEN 'SHIP' THEN (SELECT max(shipment_id) FROM w_shipment) + nth
                   WHEN 'TRANSFER' THEN (SELECT max(transfer_id) FROM w_stock_transfer) + nth
                   END AS document_id,
               CASE WHEN cmd = 'TRANSFER' THEN 'XFR-2025-' || CASE
                    WHEN (SELECT max(transfer_id) FROM w_stock_transfer) + nth < 10000
                    THEN lpad(CAST((SELECT max(transfer_id) FROM w_stock_transfer) + nth AS VARCHAR), 4, '0')
                    ELSE CAST((SELECT max(transfer_id) FROM w_stock_transfer) + nth AS VARCHAR) END
                    END AS transfer_number
        FROM w_accepted""",
    "w_legs": """
        SELECT seq, 0 AS leg, cmd, product_id, warehouse_id, location_id,
               CASE WHEN cmd IN ('SHIP', 'TRANSFER') THEN -qty ELSE qty END AS change,
               CASE WHEN cmd = 'SHIP' THEN qty ELSE 0 END AS shipped, src_before AS before,
               document_id, employee_id, order_id, transfer_number, warehouse_id AS from_wh,
               to_warehouse_id AS to_wh
        FROM w_documents
        UNION ALL
        SELECT seq, 1, cmd, product_id, to_warehouse_id, to_location_id, qty, 0, dst_before,
               document_id, employee_id, order_id, transfer_number, warehouse_id, to_warehouse_id
        FROM w_documents WHERE cmd = 'TRANSFER'""",
}

# the tables a whole script changes, as they are after it
AFTER: dict[str, str] = {
    "w_after_inventory": """
        SELECT product_id, warehouse_id, location_id, coalesce(qty_on_hand, 0) + coalesce(change, 0) AS qty_on_hand
        FROM w_inventory FULL JOIN (SELECT product_id, warehouse_id, location_id, sum(change) AS change
             FROM w_legs GROUP BY ALL) USING (product_id, warehouse_id, location_id)""",
    "w_after_po_line": """
        SELECT l.* REPLACE (qty_received + coalesce(qty, 0) AS qty_received)
        FROM w_po_line l LEFT JOIN (SELECT line_id, sum(qty) AS qty FROM w_accepted WHERE cmd = 'RECEIVE' GROUP BY line_id)
             ON line_id = po_line_id""",
    "w_after_purchase_order": f"""
        SELECT h.* REPLACE (CASE WHEN to_come IS NULL THEN status WHEN to_come = 0 THEN 'RECEIVED' ELSE 'PARTIAL' END AS status,
                            CASE WHEN to_come IS NULL THEN updated_at ELSE TIMESTAMP '{NOW}' END AS updated_at)
        FROM w_purchase_order h LEFT JOIN (
             SELECT po_id AS moved, sum(qty_ordered - qty_received) AS to_come FROM w_after_po_line
             WHERE po_id IN (SELECT order_id FROM w_accepted WHERE cmd = 'RECEIVE') GROUP BY po_id) ON moved = po_id""",
    "w_after_shipment": f"""
        SELECT shipment_id, so_id, status, shipment_number, ship_date, carrier, tracking_number, reason_code FROM w_shipment
        UNION ALL SELECT document_id, order_id, 'PENDING', NULL, DATE '{NOW[:10]}', NULL, NULL, 'STANDARD'
                  FROM w_documents WHERE cmd = 'SHIP'""",
    "w_after_shipment_line": """
        SELECT shipment_id, qty_shipped FROM w_shipment_line
        UNION ALL SELECT document_id, qty FROM w_documents WHERE cmd = 'SHIP'""",
}

REPRICED = {
    "w_after_product": """
        SELECT * REPLACE (CASE WHEN product_id % 2 = 0 THEN unit_price + 1 ELSE unit_price END AS unit_price,
                          CASE WHEN product_id % 5 = 0 THEN 1 ELSE category_id END AS category_id,
                          CASE WHEN product_id % 3 = 0 THEN 9999 ELSE reorder_level END AS reorder_level,
                          CASE WHEN product_id % 7 = 0 THEN 'N' ELSE 'Y' END AS is_active)
        FROM w_product""",
}

# the same tables with faults
UNCLEAN: dict[str, str] = {
    "w_product_all": TABLES["w_product"],
    "w_product": "SELECT * FROM w_product_all WHERE is_active = 'Y'",
    "w_so_line": """
        SELECT l_orderkey * 100000 + l_linenumber AS so_line_id, l_orderkey AS so_id,
               l_linenumber AS line_number, l_partkey AS product_id,
               CAST(l_quantity AS DECIMAL(12,3)) AS qty_ordered,
               CAST(l_quantity AS DECIMAL(12,3)) AS qty_shipped, 1 AS unit_price,
               l_quantity AS line_total
        FROM lineitem""",
    "w_inventory": f"""
        SELECT seq AS inventory_id, product_id, warehouse_id, location_id, qty AS qty_on_hand,
               0 AS qty_reserved, CAST(NULL AS DATE) AS last_count_date, {_STAMP} AS updated_at
        FROM w_script""",
}

_WORD = re.compile(r"\bw_\w+")
_RECURSIVE = {"w_run"}


def _with(body: str, tables: dict[str, str]) -> str:
    """The body preceded by every derived table it needs, in order of use."""
    done: list[str] = []

    def need(text: str, inside: str = "") -> None:
        for name in _WORD.findall(text):
            if name not in done and name != inside and name in tables:
                need(tables[name], name)
                done.append(name)

    need(body)
    if not done:
        return body
    word = "WITH RECURSIVE " if _RECURSIVE & set(done) else "WITH "
    return word + ",\n".join(f"{n} AS ({tables[n]})" for n in done) + "\n" + body


# how a result column is shown, by name; columns of the tables take their own type
_KINDS: dict[str, str] = {
    **{
        m.group(1): m.group(2)
        for ddl in schemas.TABLE_DDL.values()
        for m in re.finditer(r"(\w+) (BIGINT|INT|STRING|DATE|TIMESTAMP|DECIMAL)", ddl)
    },
    **dict.fromkeys(
        "qty_available stock_value total_on_hand qty_shortage qty_outstanding total_units "
        "total_cost_value total_retail_value total_qty_shipped qty_still_outstanding available "
        "remaining default_qty qty previous_after quantity cost retail".split(),
        "DECIMAL",
    ),
    **dict.fromkeys(
        "line_count product_count days_overdue low_stock_count pending_shipments overdue_pos "
        "warehouse_count slots line_product_id request_id best_location_id default_location_id "
        "line_id header_id n_rows id seq leg document_id to_warehouse_id load_position "
        "to_location_id number".split(),
        "BIGINT",
    ),
}


def _shown(columns: str, body: str, tables: dict[str, str] | None = None, sort: str = "") -> str:
    casts = {
        "DECIMAL": "CAST({0} AS DOUBLE) AS {0}",
        "BIGINT": "CAST({0} AS BIGINT) AS {0}",
        "INT": "CAST({0} AS BIGINT) AS {0}",
        "DATE": "strftime(CAST({0} AS DATE), '%Y-%m-%d') AS {0}",
        "TIMESTAMP": "strftime(CAST({0} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS {0}",
        "STRING": "CAST({0} AS VARCHAR) AS {0}",
    }
    listed = ", ".join(casts[_KINDS.get(c, "STRING")].format(c) for c in columns.split())
    return _with(f"SELECT {listed} FROM ({body}) {sort}", TABLES if tables is None else tables)


def _columns(table: str) -> str:
    return " ".join(re.findall(r"(\w+) (?:BIGINT|INT|STRING|DATE|TIMESTAMP|DECIMAL)",
                               schemas.TABLE_DDL[table]))


def _look(table: str, column: str, by: str) -> str:
    """One value of another table's row, NULL where there is none."""
    return f"(SELECT any_value({column}) FROM w_{table} AS hit WHERE hit.{schemas.PRIMARY_KEY[table]} = {by})"


def _known(table: str, column: str, test: str = "TRUE") -> str:
    return f"{column} IN (SELECT {schemas.PRIMARY_KEY[table]} FROM w_{table} WHERE {test})"


_ON = "is_active = 'Y'"

# every slot with what it is called and worth; names are looked up slot by slot
_SLOTS = f"""
    SELECT *, qty_on_hand - qty_reserved AS qty_available, unit_cost * qty_on_hand AS stock_value
    FROM (SELECT slot.*,
                 {_look("product", "sku", "slot.product_id")} AS sku,
                 {_look("product", "product_name", "slot.product_id")} AS product_name,
                 {_look("product", "unit_cost", "slot.product_id")} AS unit_cost,
                 {_look("product", "unit_price", "slot.product_id")} AS unit_price,
                 {_look("product", "reorder_level", "slot.product_id")} AS reorder_level,
                 {_look("product_category", "category_name", _look("product", "category_id", "slot.product_id"))}
                     AS category_name,
                 {_look("warehouse", "warehouse_code", "slot.warehouse_id")} AS warehouse_code,
                 {_look("warehouse", "warehouse_name", "slot.warehouse_id")} AS warehouse_name,
                 {_look("warehouse_location", "location_code", "slot.location_id")} AS location_code,
                 {_look("warehouse_location", "zone_type", "slot.location_id")} AS zone_type
          FROM w_inventory AS slot)
    WHERE sku IS NOT NULL AND category_name IS NOT NULL AND warehouse_code IS NOT NULL
      AND location_code IS NOT NULL"""

_SLOTS_IN_USE = f"""
    SELECT * FROM ({_SLOTS}) WHERE {_known("product", "product_id", _ON)}
      AND {_known("warehouse", "warehouse_id", _ON)} AND {_known("warehouse_location", "location_id", _ON)}"""

# units of a product in a warehouse, both in use
_HELD = f"""
    SELECT warehouse_id, product_id, sum(qty_on_hand) AS units FROM w_inventory
    WHERE {_known("product", "product_id", _ON)} AND {_known("warehouse", "warehouse_id", _ON)}
    GROUP BY ALL"""

_LOW = f"""
    SELECT *, reorder_level - total_on_hand AS qty_shortage
    FROM (SELECT units AS total_on_hand,
                 {_look("product", "reorder_level", "held.product_id")} AS reorder_level,
                 {_look("product", "sku", "held.product_id")} AS sku,
                 {_look("product", "product_name", "held.product_id")} AS product_name,
                 {_look("warehouse", "warehouse_code", "held.warehouse_id")} AS warehouse_code,
                 {_look("warehouse", "warehouse_name", "held.warehouse_id")} AS warehouse_name
          FROM ({_HELD}) AS held)
    WHERE total_on_hand < reorder_level"""

_VALUATION = f"""
    SELECT {_look("warehouse", "warehouse_code", "held.warehouse_id")} AS warehouse_code,
           {_look("warehouse", "warehouse_name", "held.warehouse_id")} AS warehouse_name,
           {_look("product_category", "category_name", "held.category_id")} AS category_name,
           product_count, total_units, total_cost_value, total_retail_value
    FROM (SELECT warehouse_id, {_look("product", "category_id", "each.product_id")} AS category_id,
                 count(*) AS product_count, sum(units) AS total_units,
                 sum({_look("product", "unit_cost", "each.product_id")} * units) AS total_cost_value,
                 sum({_look("product", "unit_price", "each.product_id")} * units) AS total_retail_value
          FROM ({_HELD}) AS each GROUP BY 1, 2) AS held"""

_PENDING = f"""
    SELECT * FROM (
        SELECT shipment_number, ship_date, status, carrier, tracking_number, reason_code,
               (SELECT sum(qty_shipped) FROM w_shipment_line AS part
                WHERE part.shipment_id = load.shipment_id) AS total_qty_shipped,
               {_look("sales_order", "so_number", "load.so_id")} AS so_number,
               {_look("sales_order", "required_date", "load.so_id")} AS required_date,
               {_look("customer", "customer_name", _look("sales_order", "customer_id", "load.so_id"))} AS customer_name,
               {_look("warehouse", "warehouse_code", _look("sales_order", "warehouse_id", "load.so_id"))}
                   AS warehouse_code
        FROM w_shipment AS load
        WHERE status = 'PENDING' OR status = 'IN_TRANSIT')
    WHERE total_qty_shipped IS NOT NULL AND so_number IS NOT NULL AND customer_name IS NOT NULL"""

# purchase orders to come, with what is still to be received of each
_TO_COME = f"""
    SELECT * FROM (
        SELECT buy.*,
               (SELECT count(*) FROM w_po_line AS part WHERE part.po_id = buy.po_id) AS line_count,
               (SELECT sum(qty_ordered) - sum(qty_received) FROM w_po_line AS part
                WHERE part.po_id = buy.po_id) AS qty_outstanding,
               {_look("supplier", "supplier_name", "buy.supplier_id")} AS supplier_name,
               {_look("supplier", "email", "buy.supplier_id")} AS supplier_email,
               {_look("warehouse", "warehouse_code", "buy.warehouse_id")} AS warehouse_code
        FROM w_purchase_order AS buy
        WHERE status NOT IN ('DRAFT', 'RECEIVED', 'CANCELLED'))
    WHERE line_count > 0 AND supplier_name IS NOT NULL AND warehouse_code IS NOT NULL"""

_OVERDUE = f"""
    SELECT *, date_diff('day', CAST(expected_date AS DATE), DATE '{AS_OF}') AS days_overdue,
           qty_outstanding AS qty_still_outstanding
    FROM ({_TO_COME}) WHERE date_diff('day', CAST(expected_date AS DATE), DATE '{AS_OF}') > 0"""

_WHO = """(SELECT any_value(concat_ws(' ', first_name, last_name)) FROM w_employee AS hit
          WHERE hit.employee_id = {})"""

_LOG_NAMED = f"""
    SELECT entry.*, {_look("product", "sku", "entry.product_id")} AS sku,
           {_look("product", "product_name", "entry.product_id")} AS product_name,
           {_look("warehouse", "warehouse_code", "entry.warehouse_id")} AS warehouse_code,
           {_look("warehouse", "warehouse_name", "entry.warehouse_id")} AS warehouse_name,
           {_look("warehouse_location", "location_code", "entry.location_id")} AS location_code,
           {_WHO.format("entry.employee_id")} AS employee_name
    FROM w_stock_transaction AS entry
    WHERE {_known("product", "entry.product_id")} AND {_known("warehouse", "entry.warehouse_id")}
    ORDER BY transaction_id DESC"""


def _nested(header: str, line: str, key: str, partner: str) -> str:
    """Headers with their lines, a row per line and one for a header without any."""
    return f"""
        SELECT head.*, part.* EXCLUDE ({key}),
               {_look(partner, f"{partner}_name", f"head.{partner}_id")} AS {partner}_name,
               {_look(partner, f"{partner}_code", f"head.{partner}_id")} AS {partner}_code,
               {_look("warehouse", "warehouse_code", "head.warehouse_id")} AS warehouse_code,
               {_look("warehouse", "warehouse_name", "head.warehouse_id")} AS warehouse_name,
               {_WHO.format("head.created_by")} AS created_by_name,
               {_look("product", "sku", "part.product_id")} AS sku,
               {_look("product", "product_name", "part.product_id")} AS product_name,
               {_look("product", "unit_of_measure", "part.product_id")} AS unit_of_measure
        FROM w_{line} AS part
        RIGHT JOIN w_{header} AS head ON head.{key} = part.{key}"""


_TRANSFERS = f"""
    SELECT part.* EXCLUDE (transfer_id), head.*,
           {_look("warehouse", "warehouse_code", "head.from_warehouse_id")} AS from_warehouse_code,
           {_look("warehouse", "warehouse_code", "head.to_warehouse_id")} AS to_warehouse_code,
           {_look("product", "sku", "part.product_id")} AS sku,
           {_look("product", "product_name", "part.product_id")} AS product_name,
           {_look("warehouse_location", "location_code", "part.from_location_id")} AS from_location_code,
           {_look("warehouse_location", "location_code", "part.to_location_id")} AS to_location_code
    FROM w_stock_transfer_line AS part
    RIGHT JOIN w_stock_transfer AS head ON head.transfer_id = part.transfer_id"""


_FREE = "SELECT *, greatest(0, qty_on_hand - qty_reserved) AS free FROM w_inventory"

_REQUESTS = """
    SELECT l.transfer_line_id AS request_id, l.product_id, h.from_warehouse_id AS warehouse_id,
           l.from_location_id AS location_id, h.to_warehouse_id, l.to_location_id,
           l.qty_requested AS qty
    FROM w_stock_transfer_line l JOIN w_stock_transfer h ON h.transfer_id = l.transfer_id"""

_SCRIPT_REQUESTS = f"""
    SELECT s.seq AS request_id, s.product_id, s.warehouse_id, s.location_id, s.to_warehouse_id,
           s.to_location_id, s.qty, coalesce(f.free, 0) AS available
    FROM w_script s LEFT JOIN ({_FREE}) f ON f.product_id = s.product_id
         AND f.warehouse_id = s.warehouse_id AND f.location_id = s.location_id
    WHERE s.cmd = 'TRANSFER'"""

_PROGRESS = """
    SELECT kind, line_id, header_id, remaining,
           CASE WHEN remaining > 0 THEN 'OPEN' ELSE 'FULFILLED' END AS progress
    FROM (SELECT 'PURCHASE' AS kind, po_line_id AS line_id, po_id AS header_id,
                 qty_ordered - qty_received AS remaining FROM w_po_line
          UNION ALL
          SELECT 'SALES', so_line_id, so_id, qty_ordered - qty_shipped FROM w_so_line)"""

# rule -> (table, condition a row must not make false)
_ROW_RULES = {
    "database": {
        "K-01": ("employee", "is_active IN ('Y', 'N')"),
        "K-02": ("product", "is_active IN ('Y', 'N')"),
        "K-03": ("product", "unit_cost >= 0 AND unit_price >= 0 AND reorder_level >= 0"),
        "K-04": ("supplier", "is_active IN ('Y', 'N')"),
        "K-05": ("customer", "is_active IN ('Y', 'N')"),
        "K-06": ("warehouse", "is_active IN ('Y', 'N')"),
        "K-07": ("warehouse_location",
                 "zone_type IN ('STORAGE', 'PICKING', 'RECEIVING', 'SHIPPING', 'QUARANTINE')"),
        "K-08": ("warehouse_location", "is_active IN ('Y', 'N')"),
        "K-09": ("inventory", "qty_on_hand >= 0"),
        "K-10": ("inventory", "qty_reserved >= 0 AND qty_reserved <= qty_on_hand"),
        "K-11": ("purchase_order", "status IN ('DRAFT', 'SUBMITTED', 'APPROVED', 'PARTIAL', "
                                   "'RECEIVED', 'CANCELLED')"),
        "K-12": ("po_line", "line_number > 0"),
        "K-13": ("po_line", "qty_ordered > 0 AND qty_received >= 0 AND qty_received <= qty_ordered"),
        "K-14": ("goods_receipt", "reason_code IN ('STANDARD', 'INITIAL_LOAD', 'RETURN_TO_STOCK', "
                                  "'DAMAGE_CLAIM')"),
        "K-15": ("goods_receipt_line", "qty_received > 0"),
        "K-16": ("sales_order", "status IN ('DRAFT', 'CONFIRMED', 'PICKING', 'PARTIAL', 'SHIPPED', "
                                "'CANCELLED')"),
        "K-17": ("so_line", "line_number > 0"),
        "K-18": ("so_line", "qty_ordered > 0 AND qty_shipped >= 0 AND qty_shipped <= qty_ordered"),
        "K-19": ("shipment", "status IN ('PENDING', 'IN_TRANSIT', 'DELIVERED', 'CANCELLED')"),
        "K-20": ("shipment", "reason_code IN ('STANDARD', 'PARTIAL_SHIP', 'URGENT', 'RETURN')"),
        "K-21": ("shipment_line", "qty_shipped > 0"),
        "K-22": ("stock_transfer", "from_warehouse_id <> to_warehouse_id"),
        "K-23": ("stock_transfer", "status IN ('REQUESTED', 'IN_TRANSIT', 'RECEIVED', 'CANCELLED')"),
        "K-24": ("stock_transfer_line", "from_location_id <> to_location_id"),
        "K-25": ("stock_transfer_line", "qty_requested > 0 AND qty_shipped >= 0 AND "
                                        "qty_received >= 0"),
        "K-26": ("stock_transaction", "transaction_type IN ('RECEIPT', 'ISSUE', 'ADJUSTMENT', "
                                      "'TRANSFER_IN', 'TRANSFER_OUT', 'RETURN')"),
    },
}
_ROW_RULES["application"] = {
    k: v
    for k, v in _ROW_RULES["database"].items()
    if k not in ("K-03", "K-09", "K-12", "K-14", "K-17", "K-20", "K-22", "K-26")
} | {
    "K-07": ("warehouse_location", "zone_type IN ('STORAGE', 'RECEIVING', 'SHIPPING', 'STAGING', "
                                   "'QC', 'CROSS_DOCK')"),
    "K-13": ("po_line", "qty_ordered > 0 AND qty_received >= 0"),
    "K-16": ("sales_order", "status IN ('DRAFT', 'CONFIRMED', 'ALLOCATED', 'PARTIAL', 'SHIPPED', "
                            "'CANCELLED')"),
    "K-18": ("so_line", "qty_ordered > 0 AND qty_shipped >= 0"),
    "K-23": ("stock_transfer", "status IN ('REQUESTED', 'IN_TRANSIT', 'COMPLETED', 'CANCELLED')"),
    "K-25": ("stock_transfer_line", "qty_requested > 0"),
    "R-01": ("po_line", "unit_cost >= 0"),
    "R-02": ("so_line", "unit_price >= 0"),
}


def _all(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def _row_rules(profile: str) -> str:
    return _all(
        f"SELECT '{rule}' AS rule_id, '{table}' AS table_name, "
        f"CAST({schemas.PRIMARY_KEY[table]} AS VARCHAR) AS row_key FROM w_{table} "
        f"WHERE NOT ({test})"
        for rule, (table, test) in _ROW_RULES[profile].items()
    )


_FIGURES = f"""
    SELECT (SELECT coalesce(sum(total_cost_value), 0) FROM ({_VALUATION})) AS total_cost_value,
           (SELECT coalesce(sum(total_retail_value), 0) FROM ({_VALUATION})) AS total_retail_value,
           (SELECT coalesce(sum(total_units), 0) FROM ({_VALUATION})) AS total_units,
           (SELECT count(*) FROM ({_LOW})) AS low_stock_count,
           (SELECT count(*) FROM ({_PENDING})) AS pending_shipments,
           (SELECT count(*) FROM ({_OVERDUE})) AS overdue_pos,
           (SELECT count(*) FROM w_warehouse WHERE is_active = 'Y') AS warehouse_count,
           (SELECT count(*) FROM w_product WHERE is_active = 'Y') AS product_count"""


def _afterwards(body: str, changed: dict[str, str]) -> str:
    """A query on the tables as they are after a change."""
    return _WORD.sub(lambda m: name if (name := f"w_after_{m[0][2:]}") in changed else m[0], body)


def _kept() -> dict[str, str]:
    """Full recomputation on the changed tables."""
    figures = ("total_cost_value total_retail_value total_units low_stock_count pending_shipments overdue_pos "
               "warehouse_count product_count")
    views = _all([
        f"SELECT 'low stock' AS view, warehouse_code AS place, sku AS item, NULL AS number, total_on_hand AS quantity, "
        f"NULL AS cost, NULL AS retail FROM ({_LOW})",
        f"SELECT 'to come', status, po_number, line_count, qty_outstanding, NULL, NULL FROM ({_TO_COME})",
        f"SELECT 'worth', warehouse_code, category_name, product_count, total_units, total_cost_value, total_retail_value "
        f"FROM ({_VALUATION})",
        f"SELECT 'short', NULL, NULL, low_stock_count, total_units, total_cost_value, total_retail_value FROM ({_FIGURES})",
        f"SELECT 'late', NULL, NULL, overdue_pos, NULL, NULL, NULL FROM ({_FIGURES})",
        f"SELECT 'on the way', NULL, NULL, pending_shipments, NULL, NULL, NULL FROM ({_FIGURES})",
    ])
    shown = _shown("view place item number quantity cost retail", _afterwards(views, AFTER), TABLES | AFTER)
    return {"q_kept_views": shown, "q_kept_repriced": _shown(figures, _afterwards(_FIGURES, REPRICED), TABLES | REPRICED)}


def _integrity() -> dict[str, str]:
    rules = "rule_id table_name row_key"
    pk = _all(
        f"SELECT 'PK {t}' AS rule_id, '{t}' AS table_name, CAST({k} AS VARCHAR) AS row_key, "
        f"count(*) AS n_rows FROM w_{t} GROUP BY {k} HAVING count(*) > 1"
        for t, k in schemas.PRIMARY_KEY.items()
    )
    unique = _all(
        f"SELECT 'UQ {t}' AS rule_id, '{t}' AS table_name, "
        + " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in ks)
        + f" AS row_key, count(*) AS n_rows FROM w_{t} WHERE "
        + " AND ".join(f"{k} IS NOT NULL" for k in ks)
        + f" GROUP BY {', '.join(ks)} HAVING count(*) > 1"
        for t, ks in schemas.UNIQUE_KEY.items()
    )
    foreign = _all(
        f"SELECT 'FK {t}.{c}' AS rule_id, '{t}' AS table_name, "
        f"CAST({schemas.PRIMARY_KEY[t]} AS VARCHAR) AS row_key, CAST({c} AS VARCHAR) AS value "
        f"FROM w_{t} WHERE {c} IS NOT NULL AND {c} NOT IN "
        f"(SELECT {schemas.PRIMARY_KEY[p]} FROM w_{p})"
        for t, refs in schemas.FOREIGN_KEYS.items()
        for c, p in refs
    )
    missing = _all(
        f"SELECT 'NN {t}.{c}' AS rule_id, '{t}' AS table_name, "
        f"CAST({schemas.PRIMARY_KEY[t]} AS VARCHAR) AS row_key FROM w_{t} WHERE {c} IS NULL"
        for t in schemas.TABLE_DDL
        for c in re.findall(r"(\w+) [A-Z]+(?:\([\d,]+\))? NOT NULL", schemas.TABLE_DDL[t])
    )
    unclean = {**TABLES, **UNCLEAN}
    return {
        "q_pk_violations": _shown(f"{rules} n_rows", pk, unclean),
        "q_unique_violations": _shown(f"{rules} n_rows", unique, unclean),
        "q_fk_violations": _shown(f"{rules} value", foreign, unclean),
        "q_check_violations": _shown(rules, _row_rules("database"), unclean),
        "q_check_violations_application": _shown(rules, _row_rules("application"), unclean),
        "q_not_null_violations": _shown(rules, missing, unclean),
    }


# The load with faults, written out by table: its key, required columns (the key first), references and breaking values.
_FAULTY = """
uom_lookup | uom_code uom_description | |
department | department_id department_code department_name created_at | |
employee | employee_id department_id employee_code first_name last_name hire_date is_active created_at | department_id>department | is_active='X'
product_category | category_id category_code category_name | |
product | product_id category_id sku product_name unit_of_measure unit_cost unit_price reorder_level is_active created_at updated_at | category_id>product_category unit_of_measure>uom_lookup | is_active='X' unit_cost=-1 unit_price=-1 reorder_level=-1
supplier | supplier_id supplier_code supplier_name is_active created_at updated_at | | is_active='X'
customer | customer_id customer_code customer_name is_active created_at updated_at | | is_active='X'
warehouse | warehouse_id warehouse_code warehouse_name is_active created_at | manager_id>employee | is_active='X'
warehouse_location | location_id warehouse_id location_code zone_type is_active | warehouse_id>warehouse | zone_type='ROOF' is_active='X'
inventory | inventory_id product_id warehouse_id location_id qty_on_hand qty_reserved updated_at | product_id>product warehouse_id>warehouse location_id>warehouse_location | qty_on_hand=-1 qty_reserved=-1
purchase_order | po_id po_number supplier_id warehouse_id order_date status total_amount created_at updated_at | supplier_id>supplier warehouse_id>warehouse created_by>employee | status='LOST'
po_line | po_line_id po_id line_number product_id qty_ordered qty_received unit_cost | po_id>purchase_order product_id>product | line_number=0 qty_ordered=0 qty_received=-1 unit_cost=-1
goods_receipt | receipt_id receipt_number po_id receipt_date reason_code created_at | po_id>purchase_order received_by>employee | reason_code='LOST'
goods_receipt_line | receipt_line_id receipt_id po_line_id product_id location_id qty_received | receipt_id>goods_receipt po_line_id>po_line product_id>product location_id>warehouse_location | qty_received=0
sales_order | so_id so_number customer_id warehouse_id order_date status total_amount created_at updated_at | customer_id>customer warehouse_id>warehouse created_by>employee | status='LOST'
so_line | so_line_id so_id line_number product_id qty_ordered qty_shipped unit_price | so_id>sales_order product_id>product | line_number=0 qty_ordered=0 qty_shipped=-1 unit_price=-1
shipment | shipment_id shipment_number so_id ship_date status reason_code created_at | so_id>sales_order shipped_by>employee | status='LOST' reason_code='LOST'
shipment_line | shipment_line_id shipment_id so_line_id product_id location_id qty_shipped | shipment_id>shipment so_line_id>so_line product_id>product location_id>warehouse_location | qty_shipped=0
stock_transfer | transfer_id transfer_number from_warehouse_id to_warehouse_id request_date status created_at updated_at | from_warehouse_id>warehouse to_warehouse_id>warehouse requested_by>employee | status='LOST' to_warehouse_id=from_warehouse_id
stock_transfer_line | transfer_line_id transfer_id product_id from_location_id to_location_id qty_requested qty_shipped qty_received | transfer_id>stock_transfer product_id>product from_location_id>warehouse_location to_location_id>warehouse_location | to_location_id=from_location_id qty_requested=0 qty_shipped=-1 qty_received=-1
stock_transaction | transaction_id product_id warehouse_id transaction_type qty_change transaction_date | product_id>product warehouse_id>warehouse location_id>warehouse_location employee_id>employee | transaction_type='LOST'
"""
_NATURAL_KEYS = """
department department_code
employee employee_code
product_category category_code
product sku
supplier supplier_code
customer customer_code
warehouse warehouse_code
warehouse_location warehouse_id location_code
inventory product_id warehouse_id location_id
purchase_order po_number
po_line po_id line_number
goods_receipt receipt_number
sales_order so_number
so_line so_id line_number
shipment shipment_number
stock_transfer transfer_number
"""


def _faulty() -> dict[str, str]:
    """The integrity rules on the load with faults, each rule a query of its own."""
    rules = "rule_id table_name row_key"
    load, keys, pk, missing, dangling, unique = dict(TABLES), {}, [], [], [], []
    listed = [[part.split() for part in line.split("|")] for line in _FAULTY.strip().splitlines()]
    for (table,), required, refers, breaking in listed:
        keys[table] = key = required[0]
        faults = [(c, f"null {c}", "NULL") for c in required]
        for ref in refers:
            column, parent = ref.split(">")
            faults.append((column, f"ref {column}", "'NONE'" if parent == "uom_lookup" else "-1"))
        faults += [(c, f"value {c}", v) for c, v in (b.split("=") for b in breaking)]
        names = ", ".join(
            f"CASE WHEN {'true' if table == 'uom_lookup' else f'({key} + {len(c)}) % 5 = 0'} THEN '{name}' END"
            for c, name, _ in faults
        )
        cases: dict[str, str] = {}
        for column, name, value in faults:
            cases[column] = cases.get(column, "") + f" WHEN '{name}' THEN {value}"
        shown = ", ".join(f"CASE fault{when} ELSE {c} END AS {c}" for c, when in cases.items())
        load[f"w_bad_{table}"] = (
            f"SELECT * REPLACE ({shown}) FROM (SELECT *, unnest(list_filter(['none', {names}], lambda x: x IS NOT NULL)) AS fault "
            f"FROM w_{table})"
        )
        row = f"SELECT '{{}}' AS rule_id, '{table}' AS table_name, CAST({key} AS VARCHAR) AS row_key"
        pk.append(
            f"SELECT 'PK {table}' AS rule_id, '{table}' AS table_name, coalesce(CAST({key} AS VARCHAR), '') AS row_key, "
            f"count(*) AS n_rows FROM w_bad_{table} GROUP BY {key} HAVING count(*) > 1 OR {key} IS NULL"
        )
        missing += [f"{row.format(f'NN {table}.{c}')} FROM w_bad_{table} WHERE {c} IS NULL" for c in required]
        for ref in refers:
            column, parent = ref.split(">")
            dangling.append(
                f"{row.format(f'FK {table}.{column}')}, CAST({column} AS VARCHAR) AS value FROM w_bad_{table} AS child "
                f"WHERE {column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM w_bad_{parent} AS parent "
                f"WHERE parent.{{{parent}}} = child.{column})"
            )
    for table, *natural in map(str.split, _NATURAL_KEYS.strip().splitlines()):
        shown = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in natural)
        unique.append(
            f"SELECT 'UQ {table}' AS rule_id, '{table}' AS table_name, {shown} AS row_key, count(*) AS n_rows FROM w_bad_{table} "
            f"WHERE {shown} IS NOT NULL GROUP BY {', '.join(natural)} HAVING count(*) > 1"
        )

    def checks(profile: str) -> str:
        return _all(
            f"SELECT '{rule}' AS rule_id, '{table}' AS table_name, CAST({keys[table]} AS VARCHAR) AS row_key "
            f"FROM w_bad_{table} WHERE NOT ({test})"
            for rule, (table, test) in _ROW_RULES[profile].items()
        )

    return {
        "q_faulty_primary_keys": _shown(f"{rules} n_rows", _all(pk), load),
        "q_faulty_unique_keys": _shown(f"{rules} n_rows", _all(unique), load),
        "q_faulty_references": _shown(f"{rules} value", _all(dangling).format(**keys), load),
        "q_faulty_checks": _shown(rules, checks("database"), load),
        "q_faulty_checks_application": _shown(rules, checks("application"), load),
        "q_faulty_not_null": _shown(rules, _all(missing), load),
    }


def _lookups() -> dict[str, str]:
    from binledger.operators.lookups import LOOKUPS

    found = {}
    for name, (values, dates) in LOOKUP_VALUES.items():
        path = LOOKUPS[name]
        tests = [
            f"{k} = '{v}'" if isinstance(v, str) else f"{k} = {v}"
            for k, v in zip(path.keys, values, strict=True)
        ]
        if dates:
            tests.append(f"{path.date} >= TIMESTAMP '{dates['start']}'")
            tests.append(f"{path.date} < TIMESTAMP '{dates['end']}'")
        body = f"SELECT * FROM w_{path.table} WHERE {' AND '.join(tests)}"
        found[f"q_lookup_{name}"] = _shown(_columns(path.table), body)
    return found


def _movements() -> dict[str, str]:
    cols = {
        "q_movement_outcomes": (
            "seq cmd outcome qty_before",
            "SELECT seq, cmd, outcome, CASE WHEN outcome = 'ACCEPTED' THEN src_before END AS "
            "qty_before FROM w_decided",
        ),
        "q_replay_twice": (
            "seq cmd outcome qty_before",
            "SELECT seq, cmd, outcome, CASE WHEN outcome = 'ACCEPTED' THEN src_before END AS "
            "qty_before FROM w_decided",
        ),
        "q_movement_documents": (
            "seq cmd document_id transfer_number", "SELECT * FROM w_documents",
        ),
        "q_movement_ledger": (
            "transaction_id seq leg product_id warehouse_id location_id transaction_type "
            "qty_change qty_before qty_after reference_type reference_id employee_id notes",
            """
            SELECT (SELECT max(seq) FROM w_script) + row_number() OVER (ORDER BY seq, leg)
                       AS transaction_id,
                   seq, leg, product_id, warehouse_id, location_id,
                   CASE WHEN cmd = 'RECEIVE' THEN 'RECEIPT' WHEN cmd = 'SHIP' THEN 'ISSUE'
                        WHEN cmd = 'ADJUST' THEN 'ADJUSTMENT' WHEN leg = 0 THEN 'TRANSFER_OUT'
                        ELSE 'TRANSFER_IN' END AS transaction_type,
                   change AS qty_change, before AS qty_before, before + change AS qty_after,
                   CASE cmd WHEN 'RECEIVE' THEN 'GOODS_RECEIPT' WHEN 'SHIP' THEN 'SHIPMENT'
                        WHEN 'TRANSFER' THEN 'TRANSFER' ELSE 'MANUAL_ADJUSTMENT' END
                       AS reference_type,
                   document_id AS reference_id, employee_id,
                   CASE WHEN cmd = 'RECEIVE' THEN 'Receipt for PO PO-'
                             || lpad(CAST(order_id AS VARCHAR), 10, '0')
                        WHEN cmd = 'SHIP' THEN 'Shipment for SO SO-'
                             || lpad(CAST(order_id AS VARCHAR), 10, '0')
                        WHEN cmd = 'TRANSFER' AND leg = 0
                             THEN 'Transfer ' || transfer_number || ' OUT to WH-' || to_wh
                        WHEN cmd = 'TRANSFER'
                             THEN 'Transfer ' || transfer_number || ' IN from WH-' || from_wh END
                       AS notes
            FROM w_legs""",
        ),
        "q_movement_inventory": (
            "inventory_id product_id warehouse_id location_id qty_on_hand qty_reserved updated_at",
            f"""
            SELECT coalesce(inventory_id, (SELECT max(inventory_id) FROM w_inventory)
                       + row_number() OVER (PARTITION BY inventory_id IS NULL ORDER BY first_seq))
                       AS inventory_id,
                   product_id, warehouse_id, location_id,
                   coalesce(qty_on_hand, 0) + coalesce(change, 0) AS qty_on_hand,
                   greatest(0, coalesce(qty_reserved, 0) - coalesce(shipped, 0)) AS qty_reserved,
                   CASE WHEN change IS NULL THEN updated_at ELSE TIMESTAMP '{NOW}' END AS updated_at
            FROM w_inventory FULL JOIN
                 (SELECT product_id, warehouse_id, location_id, sum(change) AS change,
                         sum(shipped) AS shipped, min(seq) AS first_seq
                  FROM w_legs GROUP BY product_id, warehouse_id, location_id)
                 USING (product_id, warehouse_id, location_id)""",
        ),
        "q_movement_order_status": (
            "kind header_id status updated_at",
            f"""
            SELECT 'PURCHASE' AS kind, h.po_id AS header_id,
                   CASE WHEN m.po_id IS NULL THEN h.status WHEN m.still_open = 0 THEN 'RECEIVED'
                        ELSE 'PARTIAL' END AS status,
                   CASE WHEN m.po_id IS NULL THEN h.updated_at ELSE TIMESTAMP '{NOW}' END
                       AS updated_at
            FROM w_purchase_order h LEFT JOIN (
                SELECT l.po_id, sum(l.qty_ordered - l.qty_received) - sum(coalesce(a.qty, 0))
                           AS still_open
                FROM w_po_line l LEFT JOIN (SELECT line_id, sum(qty) AS qty FROM w_accepted
                     WHERE cmd = 'RECEIVE' GROUP BY line_id) a ON a.line_id = l.po_line_id
                GROUP BY l.po_id HAVING sum(a.qty) IS NOT NULL) m ON m.po_id = h.po_id
            UNION ALL
            SELECT 'SALES', h.so_id,
                   CASE WHEN m.so_id IS NULL THEN h.status WHEN m.still_open = 0 THEN 'SHIPPED'
                        ELSE 'PARTIAL' END,
                   CASE WHEN m.so_id IS NULL THEN h.updated_at ELSE TIMESTAMP '{NOW}' END
            FROM w_sales_order h LEFT JOIN (
                SELECT l.so_id, sum(l.qty_ordered - l.qty_shipped) - sum(coalesce(a.qty, 0))
                           AS still_open
                FROM w_so_line l LEFT JOIN (SELECT line_id, sum(qty) AS qty FROM w_accepted
                     WHERE cmd = 'SHIP' GROUP BY line_id) a ON a.line_id = l.so_line_id
                GROUP BY l.so_id HAVING sum(a.qty) IS NOT NULL) m ON m.so_id = h.so_id""",
        ),
        "q_movement_receipts": (
            "receipt_id receipt_line_id po_line_id product_id location_id qty_received "
            "receipt_number po_id receipt_date received_by reason_code",
            f"""
            SELECT document_id AS receipt_id,
                   (SELECT max(receipt_line_id) FROM w_goods_receipt_line) + nth AS receipt_line_id,
                   line_id AS po_line_id, product_id, location_id, qty AS qty_received,
                   'GR-' || lpad(CAST(document_id AS VARCHAR), 10, '0') AS receipt_number,
                   order_id AS po_id, DATE '{NOW[:10]}' AS receipt_date,
                   employee_id AS received_by, 'STANDARD' AS reason_code
            FROM w_documents WHERE cmd = 'RECEIVE'""",
        ),
        "q_movement_shipments": (
            "shipment_id shipment_line_id so_line_id product_id location_id qty_shipped "
            "shipment_number so_id carrier tracking_number status shipped_by",
            """
            SELECT document_id AS shipment_id,
                   (SELECT max(shipment_line_id) FROM w_shipment_line) + nth AS shipment_line_id,
                   line_id AS so_line_id, product_id, location_id, qty AS qty_shipped,
                   'SH-' || lpad(CAST(document_id AS VARCHAR), 10, '0') AS shipment_number,
                   order_id AS so_id, 'FedEx' AS carrier,
                   'TRK-' || CASE WHEN document_id < 1000000
                        THEN lpad(CAST(document_id AS VARCHAR), 6, '0')
                        ELSE CAST(document_id AS VARCHAR) END || '-US' AS tracking_number,
                   'PENDING' AS status, employee_id AS shipped_by
            FROM w_documents WHERE cmd = 'SHIP'""",
        ),
        "q_movement_transfers": (
            "transfer_id transfer_line_id product_id from_location_id to_location_id "
            "qty_requested qty_shipped qty_received transfer_number from_warehouse_id "
            "to_warehouse_id status requested_by notes",
            """
            SELECT document_id AS transfer_id,
                   (SELECT max(transfer_line_id) FROM w_stock_transfer_line) + nth
                       AS transfer_line_id,
                   product_id, location_id AS from_location_id, to_location_id,
                   qty AS qty_requested, qty AS qty_shipped, qty AS qty_received, transfer_number,
                   warehouse_id AS from_warehouse_id, to_warehouse_id, 'COMPLETED' AS status,
                   employee_id AS requested_by, 'Direct transfer' AS notes
            FROM w_documents WHERE cmd = 'TRANSFER'""",
        ),
        "q_inbound_ledger": (
            "transaction_id product_id warehouse_id location_id transaction_type qty_change "
            "qty_before qty_after",
            """
            SELECT (SELECT max(seq) FROM w_sequenced) + seq AS transaction_id, product_id,
                   warehouse_id, location_id, 'ADJUSTMENT' AS transaction_type,
                   quantity AS qty_change,
                   coalesce(start, 0) + running - quantity AS qty_before,
                   coalesce(start, 0) + running AS qty_after
            FROM (SELECT c.*, i.qty_on_hand AS start,
                         sum(quantity) OVER (PARTITION BY c.product_id, c.warehouse_id,
                             c.location_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS running
                  FROM (SELECT seq, l_partkey AS product_id, l_orderkey % 5 AS warehouse_id,
                               CASE WHEN l_orderkey % 79 <> 0
                                    THEN l_orderkey % 5 + l_suppkey % 5 * 5 ELSE 0 END
                                   AS location_id, quantity
                        FROM w_sequenced) c
                  LEFT JOIN w_inventory i ON i.product_id = c.product_id
                       AND i.warehouse_id = c.warehouse_id AND i.location_id = c.location_id)""",
        ),
    }
    cols["q_stream_equals_batch"] = cols["q_movement_outcomes"]
    ledger, body = cols["q_movement_ledger"]
    cols["q_stream_ledger"] = (" ".join(c for c in ledger.split() if c not in ("seq", "leg")), body)
    return {name: _shown(columns, body) for name, (columns, body) in cols.items()}


def statements() -> dict[str, str]:
    log = _columns("stock_transaction")
    stock = (
        "inventory_id product_id warehouse_id location_id warehouse_code warehouse_name zone_type "
        "location_code sku product_name category_name qty_on_hand qty_reserved qty_available "
        "reorder_level unit_cost unit_price stock_value updated_at"
    )
    found = {
        f"q_table_{t}": _shown(_columns(t), f"SELECT * FROM w_{t}")
        for t in schemas.TABLE_DDL
    }
    found |= {
        "q_movement_script": _shown(
            "seq cmd line_id product_id warehouse_id location_id to_warehouse_id to_location_id "
            "qty employee_id",
            "SELECT * FROM w_script",
        ),
        "q_line_totals": _shown(
            "kind line_id line_total",
            """
            SELECT 'PURCHASE' AS kind, po_line_id AS line_id, total_cents / 100.0 AS line_total
            FROM w_po_line
            UNION ALL SELECT 'SALES', so_line_id, total_cents / 100.0 FROM w_so_line""",
        ),
        "q_ingest_products": _shown(
            _columns("product"),
            f"""
            SELECT p_partkey AS product_id, 1 AS category_id, 'SKU-' || p_partkey AS sku,
                   p_name AS product_name, NULL AS description,
                   CASE WHEN p_partkey % 3 = 0 THEN 'BOX' ELSE 'EA' END AS unit_of_measure,
                   CASE WHEN p_partkey % 5 <> 0 THEN p_size ELSE 0 END AS unit_cost,
                   0 AS unit_price, 0 AS reorder_level,
                   CASE WHEN p_partkey % 7 = 0 THEN 'N' ELSE 'Y' END AS is_active,
                   TIMESTAMP '{NOW}' AS created_at, TIMESTAMP '{NOW}' AS updated_at
            FROM part WHERE p_partkey % 17 <> 0 AND p_partkey % 19 <> 0""",
        ),
        "q_ingest_rejects": _with(
            """
            SELECT CAST(p_partkey AS VARCHAR) AS product_id,
                   concat_ws(',', CASE WHEN p_partkey % 17 = 0 THEN 'category_id' END,
                                  CASE WHEN p_partkey % 19 = 0 THEN 'unit_cost' END) AS faults
            FROM part WHERE p_partkey % 17 = 0 OR p_partkey % 19 = 0""",
            TABLES,
        ),
        "q_user_sql": _shown(
            "warehouse_code slots stock_value",
            f"""
            SELECT warehouse_code, count(*) AS slots, sum(stock_value) AS stock_value FROM ({_SLOTS_IN_USE}) GROUP BY warehouse_code""",
        ),
        "q_inventory_by_warehouse": _shown(
            "warehouse_code warehouse_name zone_type location_code sku product_name category_name "
            "qty_on_hand qty_reserved qty_available reorder_level unit_cost stock_value "
            "last_count_date updated_at",
            _SLOTS_IN_USE,
        ),
        "q_low_stock": _shown(
            "warehouse_code warehouse_name sku product_name total_on_hand reorder_level "
            "qty_shortage", _LOW,
        ),
        "q_open_purchase_orders": _shown(
            "po_number supplier_name warehouse_code order_date expected_date updated_at status "
            "total_amount line_count qty_outstanding",
            _TO_COME,
        ),
        "q_stock_valuation": _shown(
            "warehouse_code warehouse_name category_name product_count total_units "
            "total_cost_value total_retail_value", _VALUATION,
        ),
        "q_pending_shipments": _shown(
            "so_number customer_name warehouse_code required_date shipment_number ship_date status "
            "carrier tracking_number reason_code total_qty_shipped", _PENDING,
        ),
        "q_overdue_purchase_orders": _shown(
            "po_number supplier_name supplier_email warehouse_code order_date expected_date "
            "days_overdue status total_amount qty_still_outstanding", _OVERDUE,
            sort="ORDER BY days_overdue DESC",
        ),
        "q_dashboard_metrics": _shown(
            "total_cost_value total_retail_value total_units low_stock_count pending_shipments "
            "overdue_pos warehouse_count product_count",
            _FIGURES,
        ),
        "q_recent_transactions": _shown(
            f"{log} sku product_name warehouse_code location_code", f"{_LOG_NAMED} LIMIT 10"
        ),
        "q_transactions": _shown(
            f"{log} sku product_name warehouse_code warehouse_name location_code employee_name",
            f"{_LOG_NAMED} LIMIT 100",
        ),
        "q_latest_audit_20": _shown(
            log, "SELECT * FROM w_stock_transaction ORDER BY transaction_id DESC LIMIT 20"
        ),
        "q_audit_by_date": _shown(
            "transaction_id transaction_type qty_change qty_before qty_after reference_type notes",
            "SELECT * FROM w_stock_transaction",
        ),
        "q_inventory_listing": _shown(stock, _SLOTS, sort="ORDER BY warehouse_code, sku"),
        "q_products": _shown(
            f"{_columns('product')} category_code category_name",
            "SELECT p.*, c.category_code, c.category_name FROM w_product p "
            "JOIN w_product_category c ON c.category_id = p.category_id",
            sort="ORDER BY sku",
        ),
        "q_active_warehouses": _shown(
            _columns("warehouse"), "SELECT * FROM w_warehouse WHERE is_active = 'Y'"
        ),
        "q_active_locations": _shown(
            f"{_columns('warehouse_location')} warehouse_code",
            "SELECT l.*, w.warehouse_code FROM w_warehouse_location l JOIN w_warehouse w "
            "ON w.warehouse_id = l.warehouse_id WHERE l.is_active = 'Y'",
        ),
        "q_locations_of_warehouse": _shown(
            f"{_columns('warehouse_location')} warehouse_code",
            "SELECT l.*, w.warehouse_code FROM w_warehouse_location l JOIN w_warehouse w "
            "ON w.warehouse_id = l.warehouse_id WHERE l.is_active = 'Y' AND l.warehouse_id = 1",
        ),
        "q_purchase_orders_nested": _shown(
            f"{_columns('purchase_order')} supplier_name supplier_code warehouse_code "
            "warehouse_name created_by_name po_line_id line_number product_id qty_ordered "
            "qty_received unit_cost line_total sku product_name unit_of_measure",
            _nested("purchase_order", "po_line", "po_id", "supplier"),
        ),
        "q_sales_orders_nested": _shown(
            f"{_columns('sales_order')} customer_name customer_code warehouse_code "
            "warehouse_name created_by_name so_line_id line_number product_id qty_ordered "
            "qty_shipped unit_price line_total sku product_name unit_of_measure",
            _nested("sales_order", "so_line", "so_id", "customer"),
        ),
        "q_transfers_nested": _shown(
            f"{_columns('stock_transfer')} from_warehouse_code to_warehouse_code transfer_line_id "
            "product_id from_location_id to_location_id qty_requested sku product_name "
            "from_location_code to_location_code",
            _TRANSFERS,
        ),
        "q_active_employees": _shown(
            "employee_id employee_code first_name last_name job_title",
            "SELECT * FROM w_employee WHERE is_active = 'Y'",
        ),
        "q_inventory_search": _shown(
            stock,
            f"""
            SELECT * FROM ({_SLOTS})
            WHERE (contains(lower(sku), 'ring') OR contains(lower(product_name), 'ring')
                   OR contains(lower(location_code), 'ring'))
              AND warehouse_code = 'WH-1' AND category_name = 'SMALL'""",
        ),
        "q_category_values": _shown(
            "category_name",
            "SELECT DISTINCT c.category_name FROM w_product p "
            "JOIN w_product_category c ON c.category_id = p.category_id",
        ),
        "q_available_by_bin": _shown(
            "product_id warehouse_id location_id available",
            f"""
            SELECT r.product_id, r.warehouse_id, l.location_id, coalesce(f.free, 0) AS available
            FROM (SELECT DISTINCT product_id, warehouse_id FROM ({_REQUESTS})) r
            JOIN w_warehouse_location l ON l.warehouse_id = r.warehouse_id AND l.is_active = 'Y'
            LEFT JOIN ({_FREE}) f ON f.product_id = r.product_id
                 AND f.warehouse_id = r.warehouse_id AND f.location_id = l.location_id""",
        ),
        "q_best_source_bin": _shown(
            "request_id product_id warehouse_id best_location_id available",
            f"""
            SELECT r.request_id, r.product_id, r.warehouse_id, b.location_id AS best_location_id,
                   coalesce(b.free, 0) AS available
            FROM ({_REQUESTS}) r LEFT JOIN (
                SELECT f.*, row_number() OVER (PARTITION BY f.product_id, f.warehouse_id
                                               ORDER BY f.free DESC, f.location_id) AS rank
                FROM ({_FREE}) f JOIN w_warehouse_location l ON l.location_id = f.location_id
                     AND l.warehouse_id = f.warehouse_id AND l.is_active = 'Y'
                WHERE f.free > 0) b
            ON b.product_id = r.product_id AND b.warehouse_id = r.warehouse_id AND b.rank = 1""",
        ),
        "q_default_destination_bin": _shown(
            "request_id warehouse_id location_id to_warehouse_id default_location_id",
            f"""
            SELECT r.request_id, r.warehouse_id, r.location_id, r.to_warehouse_id,
                   coalesce(
                       (SELECT min(l.location_id) FROM w_warehouse_location l
                        WHERE l.warehouse_id = r.to_warehouse_id AND l.is_active = 'Y'
                          AND (r.warehouse_id <> r.to_warehouse_id
                               OR l.location_id <> r.location_id)),
                       (SELECT min(l.location_id) FROM w_warehouse_location l
                        WHERE l.warehouse_id = r.to_warehouse_id AND l.is_active = 'Y'))
                       AS default_location_id
            FROM ({_REQUESTS}) r""",
        ),
        "q_line_progress": _shown("kind line_id header_id remaining progress", _PROGRESS),
        "q_default_line_qty": _shown(
            "kind line_id default_qty",
            f"SELECT kind, line_id, remaining AS default_qty FROM ({_PROGRESS})",
        ),
        "q_transfer_feasibility": _shown(
            "request_id product_id warehouse_id location_id to_warehouse_id to_location_id qty "
            "available verdict",
            f"""
            SELECT *, CASE
                WHEN location_id IS NULL OR to_location_id IS NULL THEN 'MISSING_BIN'
                WHEN warehouse_id = to_warehouse_id AND location_id = to_location_id THEN 'SAME_BIN'
                WHEN qty IS NULL OR qty <= 0 THEN 'BAD_QUANTITY'
                WHEN available <= 0 THEN 'NOTHING_AVAILABLE'
                WHEN qty > available THEN 'NOT_ENOUGH' ELSE 'OK' END AS verdict
            FROM ({_SCRIPT_REQUESTS})""",
        ),
        "q_default_transfer_qty": _shown(
            "request_id product_id warehouse_id location_id qty available default_qty",
            f"""
            SELECT *, CASE WHEN available > 0 AND (qty > available OR qty <= 0)
                           THEN least(available, greatest(1, qty)) ELSE qty END AS default_qty
            FROM ({_SCRIPT_REQUESTS})""",
        ),
        "q_cascade_delete": _shown(
            "header result id",
            """
            WITH asked AS (
                SELECT 'purchase_order' AS header, po_id AS id, EXISTS (FROM w_goods_receipt r WHERE r.po_id = a.po_id)
                       OR po_id IN (SELECT po_id FROM w_po_line WHERE po_line_id IN
                                    (SELECT po_line_id FROM w_goods_receipt_line)) AS held
                FROM w_purchase_order a WHERE status = 'CANCELLED' OR status = 'RECEIVED'
                UNION ALL
                SELECT 'sales_order', so_id, EXISTS (FROM w_shipment r WHERE r.so_id = a.so_id)
                       OR so_id IN (SELECT so_id FROM w_so_line WHERE so_line_id IN
                                    (SELECT so_line_id FROM w_shipment_line))
                FROM w_sales_order a WHERE status <> 'SHIPPED'
                UNION ALL SELECT 'goods_receipt', receipt_id, FALSE FROM w_goods_receipt
                          WHERE reason_code = 'STANDARD'
                UNION ALL SELECT 'shipment', shipment_id, FALSE FROM w_shipment WHERE status = 'PENDING'
                UNION ALL SELECT 'stock_transfer', transfer_id, FALSE FROM w_stock_transfer
                          WHERE status = 'CANCELLED'),
            part AS (
                SELECT 'purchase_order' AS header, po_id AS id, po_line_id AS line FROM w_po_line
                UNION ALL SELECT 'sales_order', so_id, so_line_id FROM w_so_line
                UNION ALL SELECT 'goods_receipt', receipt_id, receipt_line_id FROM w_goods_receipt_line
                UNION ALL SELECT 'shipment', shipment_id, shipment_line_id FROM w_shipment_line
                UNION ALL SELECT 'stock_transfer', transfer_id, transfer_line_id FROM w_stock_transfer_line)
            SELECT header, CASE WHEN held THEN 'refused' ELSE 'deleted' END AS result, id FROM asked
            UNION ALL
            SELECT header, 'deleted_lines', line FROM part JOIN asked USING (header, id) WHERE NOT held""",
        ),
        "q_ledger_chain_check": _shown(
            "transaction_id product_id warehouse_id location_id qty_change qty_before qty_after "
            "previous_after fault",
            """
            SELECT *, CASE WHEN qty_before + qty_change <> qty_after THEN 'ARITHMETIC'
                           WHEN previous_after <> qty_before THEN 'CHAIN' END AS fault
            FROM (SELECT *, lag(qty_after) OVER (PARTITION BY product_id, warehouse_id, location_id
                            ORDER BY transaction_id) AS previous_after
                  FROM (SELECT * REPLACE (
                            qty_after + CASE transaction_id % 97 WHEN 11 THEN 5 ELSE 0 END AS qty_after,
                            qty_before - CASE transaction_id % 89 WHEN 7 THEN 2 ELSE 0 END AS qty_before)
                        FROM w_stock_transaction))
            WHERE fault IS NOT NULL""",
        ),
        "q_upsert_repeated_keys": _shown(
            "product_id category_id sku unit_price updated_at",
            f"""
            SELECT product_id, category_id, sku, CASE WHEN product_id % 10 = 3 THEN unit_price ELSE 3 END AS unit_price,
                   CASE WHEN product_id % 10 = 3 OR unit_price IS NOT DISTINCT FROM 3 THEN updated_at
                        ELSE TIMESTAMP '{NOW}' END AS updated_at
            FROM w_product WHERE product_id % 10 = 3 OR product_id % 7 <> 0
            UNION ALL
            SELECT product_id + 1099511627776, category_id, sku, 3, TIMESTAMP '{NOW}'
            FROM w_product WHERE product_id % 10 = 3 AND product_id % 7 <> 0""",
        ),
        "q_assign_surrogate_keys": _shown(
            "load_position receipt_id",
            """
            SELECT load_position, coalesce(given, (SELECT max(o_orderkey) FROM orders
                       WHERE o_orderkey % 3 = 0)
                   + row_number() OVER (PARTITION BY given IS NULL ORDER BY load_position))
                       AS receipt_id
            FROM (SELECT o_orderkey + 1 AS load_position,
                         CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS given FROM orders)""",
        ),
        "q_touch_updated_at": _shown(
            "product_id category_id sku unit_price updated_at",
            f"""
            SELECT product_id, category_id, sku,
                   unit_price + CASE WHEN is_active = 'Y' AND product_id % 2 = 0 THEN 1 ELSE 0 END
                       AS unit_price,
                   CASE WHEN is_active = 'Y' AND product_id % 2 = 0 THEN TIMESTAMP '{NOW}'
                        ELSE updated_at END AS updated_at
            FROM w_product
            UNION ALL
            SELECT product_id + 1099511627776, category_id, sku || '-NEW', unit_price,
                   TIMESTAMP '{NOW}'
            FROM w_product WHERE product_id % 10 = 3""",
        ),
        "q_resolve_natural_keys": _shown(
            "product_id warehouse_id location_id qty_on_hand",
            """
            SELECT p.product_id, w.warehouse_id, l.location_id, r.qty_on_hand
            FROM (SELECT 'SKU-' || lpad(CAST(l_partkey AS VARCHAR), 10, '0') AS sku,
                         'WH-' || (l_suppkey % 25) % 5 AS warehouse_code,
                         'NATION_' || l_suppkey % 25 AS location_code,
                         l_quantity AS qty_on_hand FROM lineitem) r,
                 w_product p, w_warehouse w, w_warehouse_location l
            WHERE p.sku = r.sku AND w.warehouse_code = r.warehouse_code
              AND l.location_code = r.location_code AND l.warehouse_id = w.warehouse_id""",
        ),
        "q_header_totals": _shown(
            "kind header_id total_amount",
            """
            SELECT 'PURCHASE' AS kind, h.po_id AS header_id,
                   coalesce(sum(l.total_cents), 0) / 100.0 AS total_amount
            FROM w_purchase_order h LEFT JOIN w_po_line l ON l.po_id = h.po_id GROUP BY h.po_id
            UNION ALL
            SELECT 'SALES', h.so_id, coalesce(sum(l.total_cents), 0) / 100.0
            FROM w_sales_order h LEFT JOIN w_so_line l ON l.so_id = h.so_id GROUP BY h.so_id""",
        ),
    }
    found["q_ledger_chain_carried"] = found["q_ledger_chain_check"]
    return {**found, **_integrity(), **_faulty(), **_kept(), **_movements(), **_lookups()}

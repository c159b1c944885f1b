"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from binledger.plans import catalog
from binledger.session import local_session

HEADLINE = (
    "q_stock_valuation",
    "q_inventory_by_warehouse",
    "q_low_stock",
    "q_open_purchase_orders",
    "q_overdue_purchase_orders",
    "q_pending_shipments",
    "q_dashboard_metrics",
    "q_transactions",
    "q_purchase_orders_nested",
    "q_best_source_bin",
    "q_transfer_feasibility",
    "q_resolve_natural_keys",
    "q_header_totals",
    "q_ledger_chain_check",
    "q_movement_outcomes",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    found = catalog.queries()
    found["q_stock_valuation"](spark, folder).collect()  # start the JVM's compilers
    seconds = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        found[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()

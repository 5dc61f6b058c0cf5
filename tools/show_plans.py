"""Print the physical plans of the main building blocks.

Usage: python tools/show_plans.py [--sf DIR] [--mode simple|formatted]
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--mode", default="simple")
    args = ap.parse_args()

    from retail_insight.operators import cohorts as coh
    from retail_insight.operators.features import _customer_aggregate, compute_rfmt
    from retail_insight.operators.ranking import distributed_rank
    from retail_insight.plans.catalog import order_transactions
    from retail_insight.session import get_session

    spark = get_session("local[8]", shuffle_partitions=16)
    tx = order_transactions(spark, args.sf)
    blocks = {
        "customer aggregate (grouping sets -> customer)": _customer_aggregate(tx, "ProductCategory", "spend"),
        "distributed rank (on the materialised customer table)":
            distributed_rank(compute_rfmt(tx), [("Recency", False)], "CustomerID", rank_col="r"),
        "cohort retention": coh.cohort_retention(order_transactions(spark, args.sf, with_product=False)),
    }
    for title, df in blocks.items():
        print(f"==== {title}")
        df.explain(mode=args.mode)


if __name__ == "__main__":
    main()

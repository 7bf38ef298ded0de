"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")])

from quernstone.plans import registry  # noqa: E402
from quernstone.session import session  # noqa: E402

HEADLINE = [f"tpch_q{k:02d}" for k in range(1, 23)]
HEADLINE += [n for n in registry.SUITE if n.startswith(("olap_", "crm_", "shop_", "entry_"))]
HEADLINE += [f"micro_{n}" for n in ("sum_int", "groupby_5agg", "groupby_many_groups", "count_distinct", "hashjoin_single", "hashjoin_groupby", "full_outer_join", "exists_semi", "correlated_subquery", "lateral_top3", "interval_arith", "like_interior", "ilike_interior", "regex_mid", "long_combined", "in_expr_4096", "sort_topk", "numeric_agg", "json_agg", "unnest_agg", "wide_20col_sum", "wide1000_span10", "agg_complex_10", "case_lt_100", "case_range_50")]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", shuffle_partitions=int(cpus))
    registry.QUERIES["tpch_q01"](spark, sf_dir).collect()  # starts the JVM's work threads
    took = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).collect()
            best = min(best, time.perf_counter() - began)
        took[name] = round(best, 4)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()

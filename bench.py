"""Headline timings on the tables in $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


from ledgerlens.catalog import QUERIES
from ledgerlens.catalog.mining_queries import forget_runs
from ledgerlens.catalog.views_sql import line_config, line_view, order_config, order_view, wide_config, wide_view
from ledgerlens.mining import ranking
from ledgerlens.mining.mine import Mining, top_store
from ledgerlens.plans.views import VIEWS
from ledgerlens.session import local_session
from ledgerlens.tables import Tables


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory=os.environ.get("BENCH_MEMORY", "16g"))
    t = Tables(spark, folder)
    times: dict[str, float] = {}
    counts: dict[str, float] = {}

    def timed(name, run):
        start = time.time()
        out = run()
        times[name] = round(time.time() - start, 3)
        print(f"{name}: {times[name]} s", file=sys.stderr, flush=True)
        return out

    def mine(view, config):
        run = Mining(view, config)
        drain(top_store(run.findings, 5000))
        return run

    def with_rate(name, run):
        scopes = run.scopes.count()
        counts[f"{name}_scopes"] = scopes
        counts[f"{name}_scopes_per_sec"] = round(scopes / times[name], 1)

    timed("session_warm_up", lambda: drain(t.lineitem.groupBy("l_returnflag").count()))
    run = timed("mine_orders_depth1", lambda: mine(order_view(t), order_config(1)))
    with_rate("mine_orders_depth1", run)
    timed("rank_orders", lambda: drain(ranking.merge_prefilter_rank(run.findings, run.own_digests, 1)))
    with_rate("mine_lines_depth2", timed("mine_lines_depth2", lambda: mine(line_view(t), line_config(2))))

    def shapes():
        for name in sorted(QUERIES):
            if re.match(r"q\d\d", name):
                drain(QUERIES[name](spark, folder))

    def views():
        for recipe in VIEWS.values():
            drain(recipe(t))

    def family(prefix):
        def run():
            for name in sorted(QUERIES):
                if name.startswith(prefix):
                    drain(QUERIES[name](spark, folder))
        return run

    timed("templates_all_shapes", shapes)
    timed("views_all", views)
    timed("data_checks_all", family(("d01", "d02", "d03", "d04", "d05", "d06", "d07", "d08", "d09", "d10", "d11", "d12", "d13")))
    timed("result_operations_all", family("f"))
    timed("text_and_vectors_all", family("n"))
    with_rate("mine_wide_depth2", timed("mine_wide_depth2", lambda: mine(wide_view(t), wide_config(2))))
    forget_runs()
    sf = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "counts": counts, "sf": float(sf.group(1)) if sf else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from wellgrid import catalog
from wellgrid.session import local_session

HEADLINE = [
    "recall_across", "recall_macro", "retrieval_i2p", "tanimoto_topk", "average_precision", "map_significance",
    "ridge_probe", "silhouette_label", "kbet_per_label", "lisi_scores", "pcr_comparison", "sphere", "pca",
    "well_mean", "well_median", "mad_normalise", "quality_filter", "quantile_bounds", "sample_per_well",
    "sample_fraction", "batch_diverse_pick", "bucket_assign", "annotation_priority_join", "site_expansion_join",
    "blob_percentile_norm", "cell_stats", "top_tokens", "correlation_filter", "graph_connectivity", "selected_cells",
    "classical_profiles", "embedding_profiles", "harmony",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    catalog.load_all()
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    catalog.QUERIES["recall_within"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the Python workers
    seconds = {}
    for name in names:
        t = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from workload.queries import queries

HEADLINES = (
    "media_type_filter",
    "tag_dates",
    "tag_locations",
    "resume_from_mark",
    "places_near_media",
    "nearest_place_p3",
    "enrich_media",
    "impute_locations",
    "album_ids",
    "album_ids_by_owner",
    "album_names_dates",
    "album_names_places",
    "content_duplicates_md5",
    "content_duplicates_prefix",
    "placement_manifest",
    "stream_sessions",
    "grouping_run",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalogue = queries()
    chosen = sys.argv[1:] or HEADLINES
    seconds: dict[str, float] = {}
    for name in chosen:
        started = time.perf_counter()
        catalogue[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

"""``python -m rowforge watch LOG``: rows by step and status, as a run's log grows."""

from __future__ import annotations

import argparse


def main() -> None:
    p = argparse.ArgumentParser(prog="rowforge")
    sub = p.add_subparsers(dest="what", required=True)
    watch = sub.add_parser("watch", help="follow a run's log")
    watch.add_argument("log")
    watch.add_argument("--once", action="store_true", help="show what is there and stop")
    a = p.parse_args()
    from .session import local_session
    from .sources.runlog import read_run_log
    from .streaming.enrich import live_counts, stream_run_log

    spark = local_session()
    if a.once:
        live_counts(read_run_log(spark, a.log)).orderBy("step", "status").show(truncate=False)
    else:
        live_counts(stream_run_log(spark, a.log)).writeStream.outputMode("complete").format("console").start().awaitTermination()


if __name__ == "__main__":
    main()

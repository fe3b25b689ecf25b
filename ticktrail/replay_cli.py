"""python -m ticktrail.replay_cli FOLDER ...: replays segment files as text lines, in log order."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.replay import replay_filter
from .sources.rawlog import register

RANGES = {"position": "start_pos", "sequence": "ingress_sequence", "time": "recv_realtime_ns"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ticktrail.replay_cli")
    p.add_argument("folder")
    for name in ("stream", "date", "service", "message"):
        p.add_argument(f"--{name}", type=int, action="append", default=[])
    for name in RANGES:
        p.add_argument(f"--{name}", type=int, nargs=2, metavar=("BEGIN", "END"))
    p.add_argument("--out", help="folder for text files; else lines go to standard output")
    return p


def replay(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Lines of name=value, tab-separated, with their stream and sequence. Damage is a line too."""
    register(spark)
    d = spark.read.format("ticksegments").option("path", args.folder).load()
    select = {"source_stream_id": args.stream, "capture_date": args.date, "service_id": args.service, "message_id": args.message}
    ranges = {RANGES[n]: tuple(v) for n in RANGES if (v := getattr(args, n))}
    ok = replay_filter(d.where("status = 'OK'"), select, ranges)
    names = ["source_stream_id", "segment_sequence", "ingress_sequence", "start_pos", "end_pos", "service_id", "message_id"]
    pair = lambda c: F.concat(F.lit(f"{c}="), F.col(c).cast("string"))
    lines = ok.select("source_stream_id", "ingress_sequence", F.concat_ws("\t", F.lit("record"), *[pair(c) for c in names]).alias("line"))
    bad = d.where("status <> 'OK'").select("source_stream_id", F.lit(None).cast("long").alias("ingress_sequence"), F.concat_ws("\t", F.lit("damage"), pair("segment_sequence"), pair("start_pos"), pair("status")).alias("line"))
    return lines.unionByName(bad)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    rows = replay(spark, args).orderBy("source_stream_id", F.col("ingress_sequence").asc_nulls_last())
    if args.out:
        rows.select("line").write.mode("errorifexists").text(args.out)
    else:
        for r in rows.toLocalIterator():
            print(r.line)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

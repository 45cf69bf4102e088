"""The steps as commands: ``spark-submit run.py <step> ...``.

A topic is a folder, or ``kafka://host:port[,host:port]/topic``.
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from verdictflow.fixed_values import COMMIT_INTERVAL, MAX_IN_FLIGHT
from verdictflow.operators.scorers import HttpScorer, RubricScorer
from verdictflow.operators.snapshots import compact, rollback_to
from verdictflow.plans import steps
from verdictflow.sources.tables import create_database, create_scored_table, register_catalog, use_catalog
from verdictflow.sources.topics import FileTopic, KafkaTopic, Topic
from verdictflow.streaming.backlog import backlog_now, create_backlog_table, watch_backlog
from verdictflow.streaming.metrics import CommitCounts
from verdictflow.streaming.progress import ProgressLog, lag, progress_folder
from verdictflow.streaming.steps import land_stream, paced_replay, score_stream


def topic(text: str) -> Topic:
    if not text.startswith("kafka://"):
        return FileTopic(text)
    servers, _, name = text.removeprefix("kafka://").rpartition("/")
    return KafkaTopic(servers, name)


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="verdictflow", description=__doc__)
    commands = parser.add_subparsers(dest="step", required=True)

    replay = commands.add_parser("replay", help="coded file to raw topic")
    replay.add_argument("--file", required=True)
    replay.add_argument("--raw", type=topic, required=True)

    score = commands.add_parser("score", help="raw topic to scored topic")
    score.add_argument("--raw", type=topic, required=True)
    score.add_argument("--scored", type=topic, required=True)
    who = score.add_mutually_exclusive_group(required=True)
    who.add_argument("--url", help="generate endpoint of the model")
    who.add_argument("--scorer", choices=["rubric"], help="the offline rubric, under its own name")
    score.add_argument("--model", help="model name, sent with every request to --url and kept in the scored message")
    score.add_argument("--max-in-flight", type=int, default=MAX_IN_FLIGHT, help="calls at once per task")
    score.add_argument("--partitions", type=int, help="tasks per commit, if not those of the topic")

    score.add_argument("--quarantine", type=topic, help="topic for texts that are no messages; without one they stop the step")

    score.add_argument("--answers", help="shared folder for the answers of a commit under way; goes with --quarantine")

    land = commands.add_parser("land", help="scored topic to table")
    land.add_argument("--scored", type=topic, required=True)

    pace = commands.add_parser("pace", help="pass messages on at a bounded rate")
    pace.add_argument("--staged", type=topic, required=True, help="topic with one message per file")
    pace.add_argument("--raw", type=topic, required=True)

    watch = commands.add_parser("watch", help="messages without a verdict, kept up to date in a table")
    watch.add_argument("--raw", type=topic, required=True)
    watch.add_argument("--scored", type=topic, required=True)

    for command in (score, land, pace, watch):
        command.add_argument("--checkpoint", required=True)
        command.add_argument("--per-trigger", type=int, default=1 if command is pace else None, help="files or offsets per commit")
        command.add_argument("--interval", default="1 second" if command is pace else COMMIT_INTERVAL)
        command.add_argument("--group", help="consumer group of a Kafka topic")
        command.add_argument("--once", action="store_const", const=None, dest="interval", help="stop when caught up")

    inspect = commands.add_parser("inspect", help="first rows of the table")
    inspect.add_argument("--rows", type=int, default=10)
    inspect.add_argument("--as-of", type=int, help="number of the last commit to include")

    report = commands.add_parser("report", help="verdicts against known outcomes")

    rollback = commands.add_parser("rollback", help="drop the commits after one")
    rollback.add_argument("--to", type=int, required=True, help="number of the last commit to keep")

    compact = commands.add_parser("compact", help="join all but the last commits to one")
    compact.add_argument("--keep", type=int, default=10, help="commits to leave as they are")

    behind = commands.add_parser("lag", help="messages of a topic that a step has yet to take in, by the progress kept beside its checkpoint")
    behind.add_argument("--topic", type=topic, required=True)
    behind.add_argument("--checkpoint", required=True)

    pending = commands.add_parser("pending", help="messages without a verdict")
    pending.add_argument("--raw", type=topic, required=True)
    pending.add_argument("--scored", type=topic, required=True)

    for command in (land, watch, inspect, report, rollback, compact):
        command.add_argument("--table", required=True, help="database.table")
        command.add_argument("--warehouse", required=True, help="folder of the database")
        command.add_argument("--catalog", help="NAME, or NAME=CLASS to declare it; the session's own if left out")
        command.add_argument("--catalog-option", action="append", default=[], metavar="KEY=VALUE")
    return parser


def choose_catalog(spark: SparkSession, catalog: str, options: list[str]) -> None:
    name, _, implementation = catalog.partition("=")
    if implementation:
        register_catalog(spark, name, implementation, **dict(option.split("=", 1) for option in options))
    use_catalog(spark, name)


def told(step: str):
    """Prints the counts of each commit."""
    return lambda batch, counts: print(f"{step} commit {batch}: {counts['rows']} rows, {counts['fallbacks']} fallbacks", flush=True)


def open_table(spark: SparkSession, table: str, warehouse: str) -> None:
    create_database(spark, table.rpartition(".")[0], warehouse)
    create_scored_table(spark, table)


def main(argv: list[str] | None = None) -> None:
    parser = arguments()
    args = parser.parse_args(argv)
    if args.step == "score" and bool(args.model) != bool(args.url):
        parser.error("--model goes with --url, which needs it; the rubric has its own name")
    if args.step == "score" and args.answers and not args.quarantine:
        parser.error("--answers goes with --quarantine")
    for name in ("raw", "scored", "staged"):
        if getattr(args, "group", None) and isinstance(getattr(args, name, None), KafkaTopic):
            setattr(args, name, replace(getattr(args, name), group=args.group))
    spark = SparkSession.builder.appName(f"verdictflow {args.step}").getOrCreate()
    if getattr(args, "catalog", None):
        choose_catalog(spark, args.catalog, args.catalog_option)
    if args.step == "replay":
        sent = steps.replay(spark, args.file, args.raw)
        print(f"no file at {args.file}" if sent is None else f"sent {sent} messages")
    elif args.step == "score":
        scorer = HttpScorer(args.url, args.model) if args.url else RubricScorer()
        with CommitCounts(spark, f"score {args.checkpoint}", told("score")) as counts, ProgressLog(spark, progress_folder(args.checkpoint)):
            query = score_stream(
                spark,
                args.raw,
                args.scored,
                scorer,
                args.checkpoint,
                per_trigger=args.per_trigger,
                interval=args.interval,
                count_as=None if args.quarantine else counts.name,
                quarantine=args.quarantine,
                answers=args.answers,
                model_name=args.model or args.scorer,
                max_in_flight=args.max_in_flight,
                partitions=args.partitions,
            )
            counts.wait_for(query)
    elif args.step == "land":
        open_table(spark, args.table, args.warehouse)
        with CommitCounts(spark, f"land {args.checkpoint}", told("land")) as counts, ProgressLog(spark, progress_folder(args.checkpoint)):
            bounds = {"per_trigger": args.per_trigger, "interval": args.interval, "count_as": counts.name}
            counts.wait_for(land_stream(spark, args.scored, args.table, args.checkpoint, **bounds))
    elif args.step == "watch":
        create_database(spark, args.table.rpartition(".")[0], args.warehouse)
        create_backlog_table(spark, args.table)
        with ProgressLog(spark, progress_folder(args.checkpoint)) as log:
            bounds = {"per_trigger": args.per_trigger, "interval": args.interval}
            log.follow(watch_backlog(spark, args.raw, args.scored, args.table, args.checkpoint, **bounds))
        if args.interval is None:
            backlog_now(spark, args.table).agg(F.coalesce(F.sum("pending"), F.lit(0)).alias("pending")).show()
    elif args.step == "pace":
        bounds = {"per_trigger": args.per_trigger, "interval": args.interval}
        paced_replay(spark, args.staged, args.raw, args.checkpoint, **bounds).awaitTermination()
    elif args.step == "lag":
        lag(spark, args.topic, progress_folder(args.checkpoint)).show()
    elif args.step == "pending":
        steps.pending(spark, args.raw, args.scored).agg(F.coalesce(F.sum("pending"), F.lit(0)).alias("pending")).show()
    else:
        open_table(spark, args.table, args.warehouse)
        if args.step == "inspect":
            steps.show(spark, args.table, args.rows, args.as_of)
        elif args.step == "report":
            steps.report(spark, args.table)
        elif args.step == "compact":
            print(f"joined {compact(spark, args.table, args.keep)} commits")
        else:
            rollback_to(spark, args.table, args.to)


if __name__ == "__main__":
    main()

"""Command line: ``produce`` sample records, ``ingest`` them, and print the totals.

    spark-submit ... -m tidewire produce --folder DIR --count 100
    spark-submit ... -m tidewire ingest --folder DIR --tables DIR --checkpoints DIR

Payloads are JSON, or Protobuf with ``--descriptor FILE --package NAME``.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.codec import JsonCodec, ProtobufCodec
from tidewire.plans.tables import is_folder
from tidewire.registry import DLQ_TABLE, EVENT_PRODUCER, message_name, sample_registry
from tidewire.session import build_session
from tidewire.sources import generator, records
from tidewire.streaming import ingest

log = logging.getLogger("tidewire")


# The names of the commands' flags.
def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tidewire")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("produce", "ingest"):
        command = commands.add_parser(name)
        place = command.add_mutually_exclusive_group(required=True)
        place.add_argument("--folder", help="folder of records")
        place.add_argument("--servers", help="broker addresses")
        command.add_argument("--checkpoints", help="folder for checkpoints")
        command.add_argument("--descriptor", help="descriptor set of Protobuf payloads; JSON without it")
        command.add_argument("--package", default="", help="the messages' package in the descriptor set")
    produce, consume = commands.choices["produce"], commands.choices["ingest"]
    produce.add_argument("--count", type=int, default=generator.DEFAULT_COUNT, help="records per topic")
    produce.add_argument("--interval", type=float, default=generator.DEFAULT_INTERVAL_SECONDS, help="seconds between records when infinite")
    produce.add_argument("--infinite", action="store_true", help="go on until stopped; needs --checkpoints")
    consume.add_argument("--tables", required=True, help="folder for tables, or catalog and namespace")
    consume.add_argument("--starting-offsets", choices=records.STARTING, default="earliest", help="used on the first run only")
    consume.add_argument("--idempotent", action="store_true", help="a replayed micro-batch replaces its rows, or adds none to tables of a catalog, which then need columns for coordinates")
    consume.add_argument("--ledger", help="folder where delivered offsets are kept, so that records delivered again are left out; needs --idempotent")
    consume.add_argument("--progress", help="folder where counts of micro-batches are kept; totals then include earlier runs")
    consume.add_argument("--at-once", type=int, help="streams that run at a time; all unless given")
    consume.add_argument("--rebalance", action="store_true", help="gather rows by day before writing, for backlogs of many days")
    args = parser.parse_args(argv)
    if not args.checkpoints and (args.command == "ingest" or args.infinite):
        parser.error("--checkpoints is required")
    if bool(args.descriptor) != bool(args.package):
        parser.error("--descriptor and --package go together")
    if args.command == "ingest" and args.ledger and not args.idempotent:
        parser.error("--ledger needs --idempotent")
    return args


def codec(spark: SparkSession, args: argparse.Namespace) -> JsonCodec | ProtobufCodec:
    """The payload codec; the descriptor set, one small file, is read through Spark from any store."""
    if not args.descriptor:
        return JsonCodec()
    file = spark.read.format("binaryFile").load(args.descriptor).select("content").first()
    if file is None:
        raise FileNotFoundError(args.descriptor)
    return ProtobufCodec(bytes(file["content"]))


def _send(args: argparse.Namespace, rows: DataFrame) -> None:
    if args.servers:
        records.write_broker(rows, args.servers)
    else:
        records.write_folder(records.placed(rows, F.col("key").cast("string").cast("bigint") - 1), args.folder)


def produce(spark: SparkSession, args: argparse.Namespace) -> None:
    producer = replace(EVENT_PRODUCER, message=message_name(args.package, EVENT_PRODUCER.schema_name))
    wire = {"producers": [producer], "codec": codec(spark, args)}
    if not args.infinite:
        _send(args, generator.records(generator.bounded(spark, args.count), **wire))
        return
    (
        generator.records(generator.unbounded(spark, args.interval), **wire)
        .writeStream.option("checkpointLocation", f"{args.checkpoints}/producer")
        .trigger(processingTime=f"{args.interval} seconds")
        .foreachBatch(lambda batch, batch_id: _send(args, batch))
        .start()
        .awaitTermination()
    )


def consume(spark: SparkSession, args: argparse.Namespace) -> ingest.Totals:
    joint = "/" if is_folder(args.tables) else "."
    specs = sample_registry(args.tables, args.checkpoints, joint=joint, package=args.package)
    if args.servers:
        source = records.BrokerRecords(args.servers, args.starting_offsets)
    else:
        source = records.FolderRecords(args.folder, args.starting_offsets)
    settings = ingest.IngestSettings(
        f"{args.tables}{joint}{DLQ_TABLE}",
        codec(spark, args),
        idempotent=args.idempotent,
        rebalance=args.rebalance,
        ledger=args.ledger,
        progress=args.progress,
    )
    totals = ingest.run(spark, specs, source, settings, args.at_once)
    if args.progress:
        totals = ingest.Totals.stored(spark, args.progress, [s.query_name for s in specs])
    for spec in specs:
        log.info("%s: %s", spec.query_name, dict(totals.routes(spec.query_name)))
    return totals


def main(argv: list[str] | None = None) -> None:
    logging.basicConfig(level="INFO", style="{", format="{asctime} {name} [{levelname}] {message}")
    args = parse_args(argv)
    spark = build_session(f"tidewire-{args.command}")
    try:
        produce(spark, args) if args.command == "produce" else consume(spark, args)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

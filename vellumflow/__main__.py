"""Command line: train a category classifier, or rank the categories of one paper."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import functions as F

from vellumflow.operators import net
from vellumflow.operators.classifier import LOGISTIC, NET, load, save, train_and_evaluate
from vellumflow.session import session
from vellumflow.sources.jsonl import read_examples


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vellumflow")
    commands = p.add_subparsers(dest="command", required=True)
    train = commands.add_parser("train", help="fit a classifier on JSON lines and print its figures")
    train.add_argument("source")
    train.add_argument("model")
    train.add_argument("--least", type=int, default=5, help="papers that a category needs")
    train.add_argument("--features", type=int, default=8000)
    train.add_argument("--seed", type=int, default=42)
    train.add_argument("--kind", choices=(NET, LOGISTIC), default=NET)
    train.add_argument("--epochs", type=int, default=net.EPOCHS)
    train.add_argument("--hidden", type=int, default=net.HIDDEN)
    train.add_argument("--dropout", type=float, default=net.DROPOUT)
    train.add_argument("--patience", type=int, default=net.PATIENCE)
    predict = commands.add_parser("predict", help="print the most probable categories of a paper")
    predict.add_argument("model")
    predict.add_argument("--title", required=True)
    predict.add_argument("--abstract", required=True)
    predict.add_argument("--top", type=int, default=3)
    return p


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session()
    if args.command == "train":
        options = {k: getattr(args, k) for k in ("epochs", "hidden", "dropout", "patience")} if args.kind == NET else {}
        run = train_and_evaluate(read_examples(spark, args.source), least=args.least, features=args.features, seed=args.seed, model=args.kind, **options)
        save(run.classifier, args.model)
        print(json.dumps(run.metrics, sort_keys=True))
    else:
        text = "\n\n".join((args.title, args.abstract))
        paper = spark.createDataFrame([("paper", text)], "arxiv_id string, text string")
        ranked = load(spark, args.model).predict(paper, args.top).select(F.to_json("ranked").alias("r")).head().r
        print(ranked)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""Command line: train, parse, generate-dataset, cross-val-metrics, train-test-metrics, download, link, version.

python -m parlance.cli train DATASET.json MODEL; parse MODEL -q "a sentence" ...; generate-dataset LANG FILE.yaml ...;
cross-val-metrics DATASET.json REPORT.json; train-test-metrics TRAIN.json TEST.json REPORT.json
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from parlance.plans.config import EngineConfig
from parlance.sources.dataset import Dataset
from parlance.sources.resources import fetch, link, load


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="parlance")
    sub = top.add_subparsers(dest="command", required=True)
    train = sub.add_parser("train", help="fit an engine on a dataset and save it")
    train.add_argument("dataset"), train.add_argument("model"), train.add_argument("--config"), train.add_argument("--seed", type=int)
    parse = sub.add_parser("parse", help="parse sentences, or lines of standard input")
    parse.add_argument("model"), parse.add_argument("-q", "--query", action="append"), parse.add_argument("-f", "--intents", help="comma-separated"), parse.add_argument("--pretty", action="store_true")
    make = sub.add_parser("generate-dataset", help="YAML files to the JSON form")
    make.add_argument("language"), make.add_argument("files", nargs="+")
    cross = sub.add_parser("cross-val-metrics", help="cross-validate on a dataset")
    cross.add_argument("dataset"), cross.add_argument("report"), cross.add_argument("-n", "--folds", type=int, default=5), cross.add_argument("-t", "--train-ratio", type=float, default=1.0)
    tested = sub.add_parser("train-test-metrics", help="fit on one dataset and test on another")
    tested.add_argument("train"), tested.add_argument("test"), tested.add_argument("report")
    for command in (cross, tested):
        command.add_argument("-c", "--config"), command.add_argument("-s", "--exclude-slot-metrics", action="store_true"), command.add_argument("-i", "--include-errors", action="store_true")
    for command in (train, parse, cross, tested):
        command.add_argument("-v", "--verbose", action="store_true", help="log what Spark warns of")
        command.add_argument("-r", "--resources", help="folder of a language's resources")
    fetch_ = sub.add_parser("download", help="get an archive of resources")
    fetch_.add_argument("url"), fetch_.add_argument("folder")
    link_ = sub.add_parser("link", help="give a folder of resources another name")
    link_.add_argument("folder"), link_.add_argument("alias"), link_.add_argument("--force", action="store_true")
    sub.add_parser("version")
    return top


def shown(report, slots: bool, errors: bool) -> str:
    """A report as JSON: metrics of intents, their slots and the confusion matrix."""
    numbers = lambda r: {k: r[k] for k in r.asDict() if k not in ("class", "intent", "slot_name")}
    intents = {r["class"]: numbers(r) for r in report.intents.collect()}
    out = {"average_metrics": intents.pop(None, {}), "metrics": {name: {"intent": of} for name, of in sorted(intents.items())}}
    if slots:
        for r in report.slots.collect():
            out["metrics"].setdefault(r["intent"], {}).setdefault("slots", {})[r["slot_name"]] = numbers(r)
    out["confusion_matrix"] = [r.asDict() for r in report.confusion.orderBy("actual", "predicted").collect()]
    if errors:
        out["parsing_errors"] = [r.asDict() for r in report.errors.orderBy("id").collect()]
    return json.dumps(out, indent=2, sort_keys=True, ensure_ascii=False)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        from parlance import __version__

        print(__version__)
        return 0
    if args.command == "download":
        print(fetch(args.url, args.folder))
        return 0
    if args.command == "link":
        if args.force and Path(args.alias).is_symlink():
            Path(args.alias).unlink()
        link(args.folder, args.alias)
        return 0
    if args.command == "generate-dataset":
        print(Dataset.from_yaml(args.language, *args.files).validate().to_json())
        return 0
    from parlance.plans.engine import IntentEngine, IntentEngineModel
    from parlance.session import build_session

    spark = build_session()
    spark.sparkContext.setLogLevel("WARN" if args.verbose else "ERROR")
    config = EngineConfig.from_json(Path(args.config).read_text()) if getattr(args, "config", None) else EngineConfig()
    held = load(spark, args.resources, {kind: sorted(names) for kind, names in config.resources().items()}) if args.resources else {}
    dataset = lambda path: Dataset.from_json(Path(path).read_text())
    if args.command == "train":
        if args.seed is not None:
            config = EngineConfig(config.parsers, args.seed, config.longest_value)
        IntentEngine(spark, config, held).fit(dataset(args.dataset)).save(args.model)
        return 0
    if args.command in ("cross-val-metrics", "train-test-metrics"):
        from parlance.plans import evaluation

        fit = evaluation.engine_fit(spark, config, held)
        if args.command == "cross-val-metrics":
            report = evaluation.cross_validate(spark, dataset(args.dataset), fit, args.folds, args.train_ratio, config.seed)
        else:
            report = evaluation.train_test(spark, dataset(args.train), dataset(args.test), fit)
        Path(args.report).write_text(shown(report, not args.exclude_slot_metrics, args.include_errors))
        return 0
    model = IntentEngineModel.load(spark, args.model)
    said = args.query or [line.rstrip("\n") for line in sys.stdin]
    texts = spark.createDataFrame(list(enumerate(said)), "id long, text string")
    for row in model.to_json(model.parse(texts, args.intents.split(",") if args.intents else None)).orderBy("id").toLocalIterator():
        print(json.dumps(json.loads(row["result"]), indent=2 if args.pretty else None, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())

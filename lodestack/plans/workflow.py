
from __future__ import annotations

import argparse
import importlib
import inspect
import sys
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.patterns import STEP_LABELS
from ..sources import config, files, sinks

Step = Callable[[], object]
TEMPLATE = "Describe the image. Begin with [IMG_TYPE: type]. At most {MAX_TOOL_CALLS} requests for more lines. Answer in {OUTPUT_LANG}."


def run(steps: Sequence[tuple[str, Step]], only: str | None = None, said: Callable[[str], None] = print) -> list[str]:
    """Runs the steps one after the other and stops at the first that fails; returns the names of those that ran."""
    labels, done = dict(STEP_LABELS), []
    for name, step in steps:
        if only in (None, name):
            said(labels.get(name, name))
            step()
            done.append(name)
    return done


def made(spec: str | None, given: Any) -> Any:
    """What ``module:factory`` makes: of the configuration, if it has a parameter without a default, and else of nothing."""
    if not spec:
        raise SystemExit("this step calls a service or a splitter: name its client as module:factory")
    module, _, name = spec.partition(":")
    factory = getattr(importlib.import_module(module), name)
    asks = any(p.default is p.empty and p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) for p in inspect.signature(factory).parameters.values())
    return factory(given) if asks else factory()


def split_step(spark: SparkSession, c: config.Config, splitters: dict[str, Any]) -> list[str]:
    """[O5] Parts of all inputs go to the split folder; the errors are returned, after all files had their turn."""
    from . import parse

    cut = parse.split(files.listing(spark, c.paths["input"]), splitters).cache()
    sinks.write_bytes(cut.where("error is null"), c.paths["split"])
    errors = [f"{r['path']}: {r['error']}" for r in cut.where("error is not null").orderBy("path").collect()]
    cut.unpersist()
    return errors


def parse_step(spark: SparkSession, c: config.Config, client: Any, single: str | None = None) -> dict[str, int]:
    """[U6, J6, R7] Outcomes of the parts and of the inputs that need no splitting, or of a single file."""
    from . import parse

    if single:
        inputs = files.listing(spark, single)
    else:
        none = spark.createDataFrame([], "path string, name string, extension string, length long, modificationTime timestamp")
        at = lambda folder: files.listing(spark, folder) if sinks.exists(spark, folder) else none
        inputs = files.pending_inputs(at(c.paths["input"]), at(c.paths["split"]))
    return {r["status"]: r["files"] for r in parse.run(spark, inputs, c.paths["parsed"], f"{c.paths['parsed']}/status", client, c).collect()}


def organize_step(spark: SparkSession, c: config.Config) -> None:
    """[K5, K11, F22, K9] One Markdown file a subject, its images' paths and files in a folder of the subject."""
    from ..operators import organize

    merged = organize.merged_parts(files.parsed_parts(spark, c.paths["parsed"]))
    named = merged.select(F.col("subject").alias("name"), T.rewritten_paths("content", "subject").alias("content"))
    sinks.write_documents(named, c.paths["markdown"])
    images = files.image_files(files.listing(spark, c.paths["parsed"]))
    placed = images.select("path", F.concat(T.part_of("folder")["subject"], F.lit("/"), "name").alias("target"))
    sinks.copied(organize.image_sources(placed, "target", "path").select("path", "target"), c.paths["images"])


def describe_step(spark: SparkSession, c: config.Config, client: Any, number: int | None = None, seed: str | None = None) -> dict[str, int]:
    from . import describe

    return describe.run(spark, c.paths, client, c, c.options.get("prompt") or TEMPLATE, number, config.seed(seed))


def analyze_step(spark: SparkSession, c: config.Config, everything: bool = False, logfile: str | None = None, threads: bool = False, wanted: str = "90,95,99", output: str | None = None, progress: bool = False) -> str | None:
    """[K1, K7, K8, D8] The report, of the progress alone if asked for; None without a log."""
    from ..operators import sessions
    from .report import progress_of, session_report

    found = files.listing(spark, c.paths["logs"]) if sinks.exists(spark, c.paths["logs"]) else None
    paths = [] if found is None else [r["path"] for r in files.resolved_logs(found, [logfile] if logfile else None, everything).collect()]
    lines = files.log_lines(spark, *paths) if paths else None
    if progress:
        return progress_of(spark, c.paths, lines)
    if lines is None:
        return None
    made_ = sessions.log_sessions(lines)
    text = session_report(made_, tuple(config.percentiles(wanted)) or (90, 95, 99), threads, made_.withColumn("start_seconds", T.seconds_of_day("start_ts")))
    if output:
        sinks.write_session_csv(made_, output)
    if all(sinks.exists(spark, c.paths[k]) for k in ("markdown", "progress")):
        text += "\n" + progress_of(spark, c.paths, lines)
    return text


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestack")
    p.add_argument("-c", "--config")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, what: str, *flags: tuple[str, dict[str, Any]]) -> argparse.ArgumentParser:
        one = sub.add_parser(name, help=what)
        for flag, more in flags:
            one.add_argument(*flag.split("|"), **more)
        return one

    on = {"action": "store_true"}
    logs = [("logs", {"nargs": "?"}), ("--all", on), ("--logfile", {}), ("--threads", on), ("--percentiles", {"default": "90,95,99"}), ("-o|--output", {}), ("--progress", on)]
    clients = [("--splitter", {}), ("--parser", {}), ("--vision", {})]
    sample = [("--test", on), ("--number", {"type": int, "default": 10}), ("--seed", {})]
    command("analyze", "statistics of worker logs", *logs)
    command("splitlog", "one log for each thread", ("logs", {"nargs": "?"}), ("--logfile", {}), ("--output-dir", {"required": True}))
    command("split", "split files into parts", clients[0], ("--input-dir", {}), ("--output-dir", {}))
    command("parse", "parse documents", clients[1], ("--file", {}))
    command("organize", "merge parsed parts", ("parsed", {"nargs": "?"}), ("--output-dir", {}))
    command("img2text", "describe images", clients[2], *sample)
    command("workflow", "all steps", ("-s|--step", {"choices": [n for n, _ in STEP_LABELS]}), *clients, *sample)
    command("init", "write a configuration template", ("--output", {"default": "config.json"}))
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "init":
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(config.Config.of().template())
        return 0
    from ..session import session

    c = config.Config.of()
    if args.config:
        with open(args.config, encoding="utf-8") as f:
            c = config.Config.load(f.read())
    for flag, place in (("logs", "logs"), ("parsed", "parsed"), ("input_dir", "input")):
        if getattr(args, flag, None):
            c.paths[place] = getattr(args, flag)
    spark = session()

    def split() -> None:
        cutter = made(args.splitter, c)
        errors = split_step(spark, c, {"pdf": cutter, "docx": cutter} if callable(cutter) else cutter)
        if errors:
            raise RuntimeError(errors[0])

    def analyze() -> None:
        given = {k: getattr(args, k, None) for k in ("all", "logfile", "threads", "percentiles", "output", "progress")}
        said = analyze_step(spark, c, bool(given["all"]), given["logfile"], bool(given["threads"]), given["percentiles"] or "90,95,99", given["output"], bool(given["progress"]))
        if said is None:
            raise FileNotFoundError("no log found")
        print(said)

    steps: list[tuple[str, Step]] = [
        ("split", split),
        ("parse", lambda: print(parse_step(spark, c, made(args.parser, c), getattr(args, "file", None)))),
        ("organize", lambda: organize_step(spark, c)),
        ("describe", lambda: print(describe_step(spark, c, made(args.vision, c), args.number if args.test else None, args.seed))),
        ("analyze", analyze),
    ]
    try:
        if args.command == "workflow":
            run(steps, args.step)
        elif args.command == "splitlog":
            paths = [r["path"] for r in files.resolved_logs(files.listing(spark, c.paths["logs"]), [args.logfile] if args.logfile else None).collect()]
            if not paths:
                raise FileNotFoundError("no log found")
            sinks.write_thread_logs(files.log_lines(spark, *paths), args.output_dir)
        else:
            if getattr(args, "output_dir", None):
                c.paths["markdown" if args.command == "organize" else "split"] = args.output_dir
            run(steps, {"img2text": "describe"}.get(args.command, args.command), said=lambda _: None)
    except (FileNotFoundError, RuntimeError) as e:
        print(f"{args.command}: {e}", file=sys.stderr)
        return 1
    return 0

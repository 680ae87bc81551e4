"""Command line: python -m loomlog.cli analyze|search|suggest|apply|report."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from loomlog.plans import commands, files, render
from loomlog.plans.generator import GeneratorMissing, make_generator


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomlog")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("analyze", "search", "suggest", "report"):
        s = sub.add_parser(name)
        s.add_argument("--shell", choices=("auto", "bash", "zsh", "powershell"), default="auto")
        s.add_argument("--history-file")
        if name != "search":
            s.add_argument("--min-frequency", type=int, default=5)
        if name in ("analyze", "report"):
            s.add_argument("--top", type=int, default=20)
            s.add_argument("--max-lines", type=int, default=5000)
            s.add_argument("--alerts-to", help="a new folder for the safety alerts if there are too many to print")
        if name in ("analyze", "search", "report"):
            s.add_argument("--format", default="markdown" if name == "report" else "table", choices=("json", "markdown") if name == "report" else ("table", "json", "markdown"))
        if name == "search":
            s.add_argument("query")
            s.add_argument("--index", help="search this index instead of the history")
            s.add_argument("--max-results", type=int, default=10)
            s.add_argument("--explain", action="store_true", help="ask the generator about the best result")
        if name == "suggest":
            s.add_argument("--interactive", action="store_true", help="choose suggestions one by one")
        s.add_argument("--output")
    i = sub.add_parser("index")
    i.add_argument("folder", help="a new folder for the index")
    i.add_argument("--shell", choices=("auto", "bash", "zsh", "powershell"), default="auto")
    i.add_argument("--history-file")
    i.add_argument("--output")
    a = sub.add_parser("apply")
    a.add_argument("--output", help="default: ~/.loomlog_aliases.sh, for PowerShell ~/.loomlog_profile.ps1")
    a.add_argument("--append-to")
    a.add_argument("--dry-run", action="store_true")
    a.add_argument("--no-backup", action="store_true")
    a.add_argument("--interactive", action="store_true", help="choose suggestions one by one")
    return p


def choose(suggestions: list[dict], ask=input) -> tuple[dict[int, str], dict[int, str]]:
    """Statuses and edits by number, from answers a (apply), e (edit, then apply), q (end), or anything else (ignore)."""
    statuses: dict[int, str] = {}
    edits: dict[int, str] = {}
    for i, s in enumerate(suggestions):
        answer = ask(f"{render.suggestions_terminal([s])}\n{i + 1}/{len(suggestions)} [a]pply, [e]dit, [i]gnore, [q]uit? ").strip().lower()
        if answer == "q":
            break
        statuses[i] = "apply" if answer in ("a", "e") else "ignore"
        if answer == "e":
            edits[i] = ask("code: ")
    return statuses, edits


def _review(spark: SparkSession | None, wanted: bool):
    """A review of suggestions if it is wanted and there is somebody to ask."""
    if not wanted:
        return None
    if not (sys.stdin.isatty() and sys.stdout.isatty()):
        print("Nobody can be asked here: all suggestions are taken.", file=sys.stderr)
        return None
    return lambda suggestions: commands.reviewed(spark or SparkSession.builder.getOrCreate(), suggestions, *choose(suggestions))


def main(argv: list[str] | None = None) -> int:
    o = parser().parse_args(argv)
    if o.command == "apply":
        try:
            output, append_to = (x and os.path.expanduser(x) for x in (o.output, o.append_to))
            print(commands.apply(files.suggestions_path(), output, append_to, o.dry_run, not o.no_backup, _review(None, o.interactive)))
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
        return 0
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if o.command == "analyze":
            r = commands.analyze(spark, o.shell, o.history_file, o.min_frequency or 5, o.top or 20, o.max_lines, o.alerts_to)
            text = render.analysis_json(r) if o.format == "json" else render.analysis_markdown(r, o.min_frequency) if o.format == "markdown" else render.analysis_table(r, o.min_frequency)
        elif o.command == "search":
            rows = commands.run_search(spark, o.query, o.shell, o.history_file, o.max_results or 10, o.index)
            if not rows:
                print("No matching commands found. Try a broader query, or look at the history file.", file=sys.stderr)
                return 0
            text = render.search_json(rows) if o.format == "json" else render.search_markdown(rows, o.query) if o.format == "markdown" else render.search_table(rows, o.query)
            if o.explain:
                said = commands.explain(make_generator(spark), spark, rows[0]["command"])
                text += f"\n\nAbout `{rows[0]['command']}`:\n{said}" if said else "\n\nNo explanation could be had: is the generator installed and logged in?"
        elif o.command == "index":
            text = commands.index(spark, o.folder, o.shell, o.history_file)
        elif o.command == "suggest":
            generator = make_generator(spark)
            found = commands.suggest(spark, generator, o.shell, o.history_file, o.min_frequency or 5, files.suggestions_path(), _review(spark, o.interactive))
            for problem in getattr(generator, "problems", []):
                print(problem, file=sys.stderr)
            text = render.suggestions_text(found) if o.output else render.suggestions_terminal(found)
        else:
            text = commands.report(spark, o.format, files.suggestions_path(), warn=lambda said: print(said, file=sys.stderr), shell=o.shell, history_file=o.history_file, min_frequency=o.min_frequency or 5, top=o.top or 20, max_lines=o.max_lines, alerts_to=o.alerts_to)
    except GeneratorMissing as e:
        print(e, file=sys.stderr)
        return 1
    except commands.HistoryEmpty as e:
        print(e, file=sys.stderr)
        return 0
    except commands.HistoryMissing as e:
        print(f"History file not found: {e}" + ("\nName one with --history-file." if e.tip else ""), file=sys.stderr)
        return 1
    if o.output:
        files.write(o.output, text)
    print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""The five commands: analyze, search, suggest, apply and report."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.operators import frequency, redact, responses, safety
from loomlog.operators.assemble import assemble
from loomlog.operators.clean import clean
from loomlog.operators.search import search
from loomlog.operators.search_index import build_index, search_index
from loomlog.plans import files, render
from loomlog.plans.generator import Generator
from loomlog.session import shared_folder
from loomlog.sources.history import DEFAULT_LINES, detect_shell, history_path, scan_lines
from loomlog.sources.tail import read_tail


#: Alerts that the driver holds and a command prints; if there are more, all of them go to files.
MOST_ALERTS = 10_000
_WHOLE = 1 << 62


class HistoryMissing(FileNotFoundError):
    """The history file is not there; ``tip`` says whether its place was a guess."""

    def __init__(self, path: str, tip: bool):
        super().__init__(path)
        self.tip = tip


def load_entries(spark: SparkSession, shell: str | None = None, history_file: str | None = None, max_lines: int | None = DEFAULT_LINES, whole: bool = False) -> tuple[DataFrame, str, str]:
    """Cleaned entries, the shell and the path; of the whole history, scanned in many tasks, or of its last lines."""
    shell = detect_shell(shell)
    path, origin = history_path(shell, history_file)
    try:
        lines = scan_lines(spark, path) if whole else read_tail(spark, path, max_lines)
    except Exception as e:
        if isinstance(e, FileNotFoundError) or "PATH_NOT_FOUND" in str(e):
            raise HistoryMissing(path, origin == "default") from e
        raise
    return clean(assemble(lines, shell, _WHOLE if whole else max_lines)), shell, path


class HistoryEmpty(ValueError):
    """The history has no commands."""

    def __init__(self, path: str):
        super().__init__(f"No commands found in {path}.")


def totals(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("total_commands"), F.count_distinct("command").alias("unique_commands"))


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _alerts(entries: DataFrame, folder: str | None, most: int) -> dict:
    """The first alerts, how many there are, and, if those are not all, the folder that holds all of them.

    Its files are in order and so are the lines of each, one JSON object a line.
    """
    found = safety.safety_alerts(entries)
    head = _rows(found.limit(most + 1))
    n, written = len(head), None
    if n > most:
        spark = entries.sparkSession
        written = folder or shared_folder(spark, "alerts")
        found.write.json(written)  # sorted by ranges, so no task holds all
        n = spark.read.schema(found.schema).json(written).count()
    alerts = [{k: r[k] for k in ("pattern", "frequency", "risk", "safer_alternative")} for r in head[:most]]
    return {"alerts": alerts, "n_alerts": n, "alerts_folder": written}


def analyze_entries(entries: DataFrame, shell: str, path: str, min_frequency: int | None = None, top: int | None = None, alerts_to: str | None = None, most_alerts: int = MOST_ALERTS) -> dict:
    """What analyze and report show.

    alerts_to: a new folder for the alerts, used only if there are more than ``most_alerts``; else one in the shared folder.
    """
    entries = entries.persist()
    try:
        n = totals(entries).first()
        if not n["total_commands"]:
            raise HistoryEmpty(path)
        return {
            "shell": shell,
            "history_file": path,
            "total_commands": n["total_commands"],
            "unique_commands": n["unique_commands"],
            "patterns": _rows(frequency.analyze_frequency(entries, min_frequency, top)),
            **_alerts(entries, alerts_to, most_alerts),
        }
    finally:
        entries.unpersist()


def analyze(spark: SparkSession, shell: str | None = None, history_file: str | None = None, min_frequency: int | None = None, top: int | None = None, max_lines: int | None = DEFAULT_LINES, alerts_to: str | None = None) -> dict:
    return analyze_entries(*load_entries(spark, shell, history_file, max_lines), min_frequency, top, alerts_to)


def index(spark: SparkSession, folder: str, shell: str | None = None, history_file: str | None = None) -> str:
    """Build the index of a whole history in a new folder, for ``run_search``; returns what to tell the user."""
    entries, _, path = load_entries(spark, shell, history_file, whole=True)
    if entries.isEmpty():
        raise HistoryEmpty(path)
    build_index(entries, folder)
    return f"The commands of {path} are indexed in {folder}; search them with --index {folder}."


def run_search(spark: SparkSession, query: str, shell: str | None = None, history_file: str | None = None, max_results: int | None = None, folder: str | None = None) -> list[dict]:
    """The best matches in a history, or in the index that ``folder`` holds."""
    if folder:
        return _rows(search_index(spark, folder, query, max_results))
    entries, _, path = load_entries(spark, shell, history_file)
    found = _rows(search(entries, query, max_results))
    if not found and entries.isEmpty():
        raise HistoryEmpty(path)
    return found


def explain(generator: Generator, spark: SparkSession, command: str) -> str | None:
    """What a generator says about a command, which is redacted first; None if it says nothing."""
    clean_text = spark.createDataFrame([(command,)], "c string").select(redact.scrub(F.col("c"))[0]).first()[0]
    try:
        return generator.explain(clean_text)
    except Exception:  # an explanation is an extra
        return None


def suggest(spark: SparkSession, generator: Generator, shell: str | None = None, history_file: str | None = None, min_frequency: int | None = None, cache: str | None = None, review=None) -> list[dict]:
    """Suggestions for the twenty most frequent patterns; only redacted text leaves the engine.

    review: as for ``apply``; what it leaves is returned and cached.
    """
    entries, shell, path = load_entries(spark, shell, history_file)
    if entries.isEmpty():
        raise HistoryEmpty(path)
    patterns = _rows(redact.scrub_patterns(frequency.analyze_frequency(entries, min_frequency, 20)))
    if not patterns:
        return []
    dangerous = safety.dangerous_commands(entries).select(redact.scrub(F.col("pattern"))[0].alias("p"))
    found = generator.suggestions(patterns, shell)
    alerts = generator.alerts([r["p"] for r in dangerous.collect()], shell)
    if alerts:
        rows = [{"pattern": a["pattern"], "risk": a.get("risk", ""), "safer_alternative": a.get("safer_alternative") or a.get("saferAlternative") or ""} for a in alerts]
        found = found + _rows(responses.alerts_as_suggestions(spark.createDataFrame(rows, "pattern string, risk string, safer_alternative string")))
    if review:
        found = review(found)
    if cache:
        files.write_json(cache, {"shell": shell, "generatedAt": render.iso(datetime.now(UTC)), "suggestions": found})
    return found


def reviewed(spark: SparkSession, suggestions: list[dict], statuses: dict[int, str] | None = None, edits: dict[int, str] | None = None) -> list[dict]:
    """The suggestions that a review leaves: numbered from 0, with apply, ignore or pending each, and edited code.

    Without a review (None) all of them stay.
    """
    if statuses is None or not suggestions:
        return suggestions
    names = list(suggestions[0])
    rows = [(i, statuses.get(i, "pending"), (edits or {}).get(i), *[s.get(n) for n in names]) for i, s in enumerate(suggestions)]
    schema = "number int, status string, edited_code string, " + ", ".join(f"`{n}` string" for n in names)
    return _rows(responses.selected(spark.createDataFrame(rows, schema)).orderBy("number").drop("number"))


def apply(cache: str, output: str | None = None, append_to: str | None = None, dry_run: bool = False, backup: bool = True, review=None) -> str:
    """Write the cached suggestions as shell code; returns what to tell the user.

    review: a function from the suggestions to those that stay, such as ``reviewed`` with its choices.
    """
    cached = files.read_json(cache)
    if not isinstance(cached, dict) or not cached.get("suggestions"):
        raise ValueError("there are no suggestions to apply; run suggest first")
    shell = cached.get("shell", "bash")
    suggestions = review(cached["suggestions"]) if review else cached["suggestions"]
    if not suggestions:
        raise ValueError("no suggestion was chosen")
    code = render.shell_code(suggestions, shell)
    target = append_to or output or files.default_output(shell)
    if dry_run:
        return render.dry_run(code, len(suggestions), target)
    saved = files.backup(target) if backup else None
    (files.append if append_to else files.write)(target, code)
    return render.applied(code, len(suggestions), target, shell, saved, bool(append_to))


def shell_mismatch(cached: object, shell: str) -> str | None:
    """What to tell if the cached suggestions are for another shell than a report's."""
    other = cached.get("shell") if isinstance(cached, dict) and cached.get("suggestions") else None
    if not other or other == shell:
        return None
    return f"The suggestions at hand were made for {other}, and this report is about {shell}; run suggest --shell {shell} for some that match."


def report(spark: SparkSession, fmt: str = "markdown", cache: str | None = None, warn=None, **options) -> str:
    """The analysis with the cached suggestions, as text.

    warn: called with a warning if those are for another shell.
    """
    formats = {"json": render.report_json, "markdown": render.report_markdown}
    if fmt not in formats:
        raise ValueError(f"a report is {' or '.join(formats)}, not {fmt}")
    result = analyze(spark, **options)
    cached = files.read_json(cache) if cache else None
    suggestions = cached.get("suggestions", []) if isinstance(cached, dict) else []
    if warn and (said := shell_mismatch(cached, result["shell"])):
        warn(said)
    return formats[fmt](result, suggestions)

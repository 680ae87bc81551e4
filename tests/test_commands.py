"""Commands, reports and files, and the generator behind its contract."""

import json
import re
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from loomlog import cli
from loomlog.functions import text as T
from loomlog.operators import responses
from loomlog.plans import commands, files, generator, render

WHEN = datetime(2024, 1, 2, 3, 4, 5, 678000)
RESULT = {
    "shell": "zsh",
    "history_file": "/h",
    "total_commands": 12345,
    "unique_commands": 3,
    "patterns": [{"pattern": f"p{i}|`x`\ny", "frequency": 20 - i, "last_used": WHEN if i == 0 else None, "variations": ["v"] * (i == 0)} for i in range(12)],
    "alerts": [{"pattern": "rm -rf /", "frequency": 2, "risk": "gone", "safer_alternative": "rm -i"}],
}
SUGGESTIONS = [
    {"pattern": "git status", "type": "alias", "code": "alias gs='git status'", "name": "gs", "explanation": "word " * 20, "safety": "safe"},
    {"pattern": "x" * 60, "type": "function", "code": "f() {\n  x\n}", "name": "", "explanation": "", "safety": "danger"},
    {"pattern": "c", "type": "script", "code": "\n".join(f"echo {i}" for i in range(40)), "name": "n", "explanation": "", "safety": None},
]


def test_analysis_reports():
    table = render.analysis_table(RESULT, 7)
    assert "Total commands: 12,345" in table and "(min frequency: 7)" in table and "   1     20    p0" in table
    assert "1 dangerous pattern detected" in table and "rm -rf / (2×)" in table
    data = json.loads(render.analysis_json(RESULT))
    assert list(data) == ["shell", "historyFile", "totalCommands", "uniqueCommands", "patterns", "safetyAlerts"]
    assert data["patterns"][0] == {"pattern": "p0|`x`\ny", "frequency": 20, "lastUsed": "2024-01-02T03:04:05.678Z", "variations": ["v"]}
    assert "lastUsed" not in data["patterns"][1] and data["safetyAlerts"][0]["saferAlternative"] == "rm -i"
    markdown = render.analysis_markdown(RESULT)
    assert "| 1 | 20 | `p0\\|\\`x\\` y` |" in markdown and "### Alert 1: `rm -rf /`" in markdown
    none = RESULT | {"patterns": [], "alerts": []}
    assert "No patterns found" in render.analysis_table(none) and "Safety Alerts" not in render.analysis_markdown(none)


def test_full_reports():
    text = render.report_markdown(RESULT, SUGGESTIONS, "2024-01-02T03:04:05.678Z")
    assert "**Generated:** 2024-01-02 03:04:05" in text and "| 10 | 11 |" in text and "| 11 | 10 |" not in text
    assert "### 1. Alias: `gs` for `git status`" in text and "**Safety:** **DANGER**" in text and "```bash\nalias gs" in text
    numbers = lambda n, m: re.findall(r"^(\d)\. ", render.report_markdown(RESULT | {"alerts": RESULT["alerts"] * m}, SUGGESTIONS[:n]).split("## Recommendations")[1], re.M)
    assert [numbers(1, 1), numbers(1, 0), numbers(0, 1), numbers(0, 0)] == [["1", "2", "3"], ["1", "3"], ["2", "3"], ["1"]]
    data = json.loads(render.report_json(RESULT, SUGGESTIONS, "t"))
    assert data["generatedAt"] == "t" and data["summary"] == {"totalCommands": 12345, "uniqueCommands": 3, "automationOpportunities": 3, "safetyAlerts": 1}
    assert len(data["patterns"]) == 12 and data["suggestions"] == SUGGESTIONS


def test_search_reports():
    rows = [{"command": "a | `b`", "score": 0.925, "frequency": 2, "last_used": WHEN, "line_number": 7}, {"command": "c", "score": 0.05, "frequency": 1, "last_used": None, "line_number": 1}]
    assert re.search(r"1 +93% +2× +a \| `b`", render.search_table(rows, "q"))
    assert json.loads(render.search_json(rows))["results"][1] == {"command": "c", "score": 0.05, "frequency": 1, "lastUsed": None, "lineNumber": 1}
    assert "| 1 | 93% | 2× | `a \\| `b`` |" in render.search_markdown(rows, "q")


def test_suggestions_and_code():
    screen, plain = render.suggestions_terminal(SUGGESTIONS), render.suggestions_text(SUGGESTIONS, "t")
    for text in (screen, plain):
        assert 'SUGGESTION 1/3: Alias "gs" for git status' in text and f"SUGGESTION 2/3: Function for {'x' * 47}..." in text
        assert "    f() {\n      x\n    }" in text
    assert "Safety:  Danger" in screen and "Safety:  danger" in plain and "Total suggestions: 3" in plain
    code = render.shell_code(SUGGESTIONS, "bash", "2024-01-02T03:04:05Z").split("\n")
    assert code[3] == "# Suggestion 1: gs" and all(len(x) <= 72 for x in code if x.startswith("# word"))
    assert any(x.startswith("# DANGER") for x in code) and not any(x.startswith("# SAFE") for x in code)


def test_scalars(spark):
    assert T.wrap_text("", 10) == [""] and T.wrap_text("a bb ccc", 4) == ["a bb", "ccc"] and T.wrap_text("abcdefgh ij", 4) == ["abcdefgh", "ij"]
    row = spark.range(1).select(T.thousands(F.lit(1234567)).alias("n"), T.truncate(F.lit("abcdefgh"), 6).alias("t"), T.capitalize(F.lit("aBC")).alias("c")).first()
    assert (row.n, row.t, row.c) == ("1,234,567", "abc...", "ABC")
    assert len(generator.pattern_prompt("a" * 300, "bash").split(": ")[1]) == 100
    assert len(re.search("b+$", generator.alternative_prompt("b" * 300)).group()) == 100
    assert re.search("c+$", generator.explain_prompt("c" * 300)).group() == "c" * 200


@pytest.mark.parametrize("shell, words", [("bash", ["shell automation and ergonomics expert", "Bash and Zsh", "POSIX-compatible"]), ("powershell", ["PowerShell scripting expert", "Set-Alias", "CmdletBinding", "Verb-Noun"])])
def test_prompts_ask_for_the_fields(shell, words):
    text = generator.suggestion_prompt([{"pattern": "git add .", "frequency": 42, "variations": ["git add -A"]}], shell)
    assert all(w in text for w in [*words, "42 times", "git add -A", '"suggestions"', '"pattern"', '"type"', "Do NOT create, modify, or read any files"])
    assert "function" in generator.pattern_prompt("a && b", shell) and "alias" in generator.pattern_prompt("a b", shell)
    safety = generator.safety_prompt(["rm -rf x", "dd of=y"])
    assert all(w in safety for w in ["system security expert", "rm -rf x", "dd of=y", '"alerts"', '"risk"', '"safer_alternative"', "Destructive operations", "Privilege escalation", "Unquoted variables"])


def calling(spark, answers):
    """A generator that takes the answer whose key is in the prompt; what it was asked."""
    asked = []

    def call(prompt):
        asked.append(prompt)
        for key, answer in answers.items():
            if key in prompt:
                if isinstance(answer, Exception):
                    raise answer
                return answer
        return ""

    return generator.CallingGenerator(spark, call), asked


PATTERNS = [{"pattern": f"cmd{i}", "frequency": i, "variations": []} for i in range(9)]


def test_one_call_for_all(spark):
    g, asked = calling(spark, {'"suggestions"': '{"suggestions":[{"pattern":"a","code":"b"},{"pattern":"c","code":"d"}]}', '"alerts"': '[{"command":"rm","frequency":2}]'})
    assert [s["pattern"] for s in g.suggestions(PATTERNS, "bash")] == ["a", "c"]
    assert g.alerts(["rm"], "bash") == [{"pattern": "rm", "frequency": 2.0, "risk": "", "safer_alternative": ""}]
    assert len(asked) == 2 and g.alerts([], "bash") == [] and len(asked) == 2


def test_single_calls_when_the_first_gives_nothing(spark):
    g, asked = calling(spark, {'"suggestions"': RuntimeError("x"), "cmd0": "alias a='cmd0'", "cmd1": RuntimeError("y"), "cmd2": '[{"pattern":"p","code":"1"},{"pattern":"q","code":"2"}]', "cmd3": "?"})
    found = g.suggestions(PATTERNS, "bash")
    assert [(s["pattern"], s["type"], s["code"], s["name"]) for s in found] == [("cmd0", "alias", "alias a='cmd0'", "a"), ("p", "function", "1", ""), ("q", "function", "2", ""), ("cmd3", "function", "?", "")]
    assert found[0]["explanation"] == 'Shortcut for "cmd0" (used 0 times)' and len(asked) == 1 + 7
    g, asked = calling(spark, {'"alerts"': "no", "rm1": "rm -i", "rm2": '[{"pattern":"z","risk":"r"}]'})
    assert g.alerts(["rm1", "rm2", "rm3", "rm4"], "bash") == [
        {"pattern": "rm1", "frequency": 0.0, "risk": "Potentially dangerous command", "safer_alternative": "rm -i"},
        {"pattern": "z", "frequency": 0.0, "risk": "r", "safer_alternative": ""},
    ]
    assert len(asked) == 4


def test_a_missing_generator_ends_it(spark, monkeypatch):
    g, _ = calling(spark, {"": generator.GeneratorMissing("gone")})
    for call in (lambda: g.suggestions(PATTERNS, "bash"), lambda: g.alerts(["rm"], "bash")):
        with pytest.raises(generator.GeneratorMissing):
            call()
    assert commands.explain(g, spark, "x") is None
    for name in ("LOOMLOG_ANSWERS", "LOOMLOG_GENERATOR"):
        monkeypatch.delenv(name, raising=False)
    with pytest.raises(generator.GeneratorMissing):
        generator.make_generator(spark)
    monkeypatch.setenv("LOOMLOG_GENERATOR", "echo said:")
    assert generator.make_generator(spark).explain("ls").startswith("said:")
    with pytest.raises(generator.GeneratorMissing):
        generator.command_call("no-such-program-here")("x")


def test_canned_answers(tmp_path):
    (tmp_path / "suggest_bash.json").write_text("[1]")
    (tmp_path / "suggest_powershell.json").write_text("[2]")
    g = generator.CannedGenerator(str(tmp_path))
    assert (g.suggestions([], "zsh"), g.suggestions([], "powershell"), g.alerts([], "bash")) == ([1], [2], [])


def test_explained_commands_are_redacted(spark):
    g, asked = calling(spark, {"": " It lists. "})
    assert commands.explain(g, spark, "curl -u user:pw https://a") == "It lists."
    assert "user:pw" not in asked[0] and "[REDACTED]" in asked[0]


@pytest.mark.parametrize("shell, default, load", [("bash", ".loomlog_aliases.sh", "source "), ("zsh", ".loomlog_aliases.sh", "exec zsh"), ("powershell", ".loomlog_profile.ps1", ". $PROFILE")])
def test_apply(spark, tmp_path, monkeypatch, shell, default, load):
    monkeypatch.setenv("HOME", str(tmp_path))
    cache = str(tmp_path / "c.json")
    files.write_json(cache, {"shell": shell, "suggestions": SUGGESTIONS})
    said = commands.apply(cache, dry_run=True)
    assert default in said and "echo 39" in said and not (tmp_path / default).exists()
    said = commands.apply(cache)
    assert (tmp_path / default).exists() and load in said and "    ..." in said and "echo 39" not in said and "Backup" not in said
    assert "Backup: " in commands.apply(cache) and (tmp_path / f"{default}.backup").exists()
    commands.apply(cache)
    assert len(list(tmp_path.glob(f"{default}*backup"))) == 2
    (tmp_path / "rc").write_text("mine\n")
    said = commands.apply(cache, append_to=str(tmp_path / "rc"), backup=False)
    text = (tmp_path / "rc").read_text()
    assert text.startswith("mine\n\n\n# ----") and "alias gs" in text and "Appended 3 suggestions" in said and not (tmp_path / "rc.backup").exists()


def test_review(spark, tmp_path):
    assert commands.reviewed(spark, SUGGESTIONS) == SUGGESTIONS
    left = commands.reviewed(spark, SUGGESTIONS, {0: "apply", 1: "ignore", 2: "apply"}, {2: "edited"})
    assert [(s["name"], s["code"]) for s in left] == [("gs", SUGGESTIONS[0]["code"]), ("n", "edited")]
    answers = iter(["i", "e", "new code", "q"])
    assert cli.choose(SUGGESTIONS, lambda _: next(answers)) == ({0: "ignore", 1: "apply"}, {1: "new code"})
    cache = str(tmp_path / "c.json")
    files.write_json(cache, {"shell": "bash", "suggestions": SUGGESTIONS})
    with pytest.raises(ValueError):
        commands.apply(cache, str(tmp_path / "o"), review=lambda s: commands.reviewed(spark, s, {}))
    commands.apply(cache, str(tmp_path / "o"), review=lambda s: commands.reviewed(spark, s, {0: "apply"}))
    assert "Suggestion 1: gs" in (tmp_path / "o").read_text() and "Suggestion 2" not in (tmp_path / "o").read_text()


def test_json_files(tmp_path):
    (tmp_path / "bad.json").write_text("{")
    assert files.read_json(str(tmp_path / "bad.json")) is None and files.read_json(str(tmp_path / "none.json")) is None
    files.write_json(str(tmp_path / "a" / "b.json"), {"é": 1})
    assert files.read_json(str(tmp_path / "a" / "b.json")) == {"é": 1}
    assert files.backup(str(tmp_path / "none")) is None


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("HOME", str(tmp_path))
    monkeypatch.setenv("LOOMLOG_ANSWERS", str(tmp_path))
    log = tmp_path / "h"
    log.write_text("\n".join(["git status", "npm test"] * 6 + ["rm -rf /tmp/x"]) + "\n")
    (tmp_path / "suggest_bash.json").write_text(json.dumps(SUGGESTIONS[:1]))
    (tmp_path / "safety_alerts.json").write_text(json.dumps([{"pattern": "rm -rf x", "frequency": 1, "risk": "gone", "saferAlternative": "rm -i x"}]))
    options = ["--shell", "bash", "--history-file", str(log)]
    assert cli.main(["analyze", *options]) == 0 and "git status" in capsys.readouterr().out
    assert cli.main(["search", *options, "git", "--explain"]) == 0 and "git status" in capsys.readouterr().out
    assert cli.main(["suggest", *options, "--interactive"]) == 0
    said = capsys.readouterr()
    assert "SUGGESTION 2/2" in said.out and "safe-rm" in said.out and "Nobody can be asked" in said.err
    assert cli.main(["apply"]) == 0 and (tmp_path / ".loomlog_aliases.sh").exists()
    assert cli.main(["report", *options, "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out.split("again:")[-1].split("exec bash\n")[-1])["summary"]["automationOpportunities"] == 2
    with pytest.raises(SystemExit):
        cli.main(["report", *options, "--format", "table"])
    assert cli.main(["analyze", "--shell", "bash", "--history-file", str(tmp_path / "none")]) == 1
    with pytest.raises(ValueError):
        commands.report(spark, "table", shell="bash", history_file=str(log))


def test_answers_in_order(spark):
    raw = [(k, f'[{{"pattern":"a{k}","code":"x"}},{{"pattern":"b{k}","code":"y"}}]' if k % 2 else "text", f"c{k}", k) for k in range(6)]
    found = responses.single_suggestions(spark.createDataFrame(raw, "id int, raw string, pattern string, frequency long")).collect()
    assert [r.pattern for r in found] == ["c0", "a1", "b1", "c2", "a3", "b3", "c4", "a5", "b5"]
    assert datetime.now(UTC).tzinfo is UTC

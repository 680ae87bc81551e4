"""Reports as text, from collected results of bounded size.

Headings, labels and the keys of JSON are fixed values that readers of the reports rely on.
"""

from __future__ import annotations

import json
import math
from datetime import UTC, datetime

from loomlog.functions.text import wrap_text

TITLE = "Command History"
PREVIEW_LINES = 25


def cap(s: str) -> str:
    return s[:1].upper() + s[1:]


def escape(s: str) -> str:
    return s.replace("|", "\\|").replace("`", "\\`").replace("\n", " ")


def iso(t: datetime | None) -> str | None:
    return None if t is None else t.strftime("%Y-%m-%dT%H:%M:%S.") + f"{t.microsecond // 1000:03d}Z"


def share(score: float) -> str:
    return f"{math.floor(score * 100 + 0.5)}%"


def _s(n: int) -> str:
    return "" if n == 1 else "s"


def dumps(value: object) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False)


def _pattern(p: dict) -> dict:
    out = {"pattern": p["pattern"], "frequency": p["frequency"]}
    if p.get("last_used") is not None:
        out["lastUsed"] = iso(p["last_used"])
    return out | {"variations": p.get("variations", [])}


def _alert(a: dict) -> dict:
    return {"pattern": a["pattern"], "frequency": a["frequency"], "risk": a["risk"], "saferAlternative": a["safer_alternative"]}


def _n_alerts(r: dict) -> int:
    return r.get("n_alerts", len(r["alerts"]))


def _folder(r: dict) -> dict:
    return {"allSafetyAlerts": r["alerts_folder"]} if r.get("alerts_folder") else {}


def _elsewhere(r: dict) -> list[str]:
    """Where the alerts are that are not shown."""
    return ["", f"The first {len(r['alerts'])} are shown; all {_n_alerts(r)} are in {r['alerts_folder']}."] if r.get("alerts_folder") else []


def analysis_json(r: dict) -> str:
    head = {"shell": r["shell"], "historyFile": r["history_file"], "totalCommands": r["total_commands"], "uniqueCommands": r["unique_commands"]}
    return dumps(head | {"patterns": [_pattern(p) for p in r["patterns"]], "safetyAlerts": [_alert(a) for a in r["alerts"]]} | _folder(r))


def _boxed(lines: list[str]) -> list[str]:
    width = max(map(len, lines))
    side = "─" * (width + 6)
    return [f"╭{side}╮", *[f"│   {x:<{width}}   │" for x in ["", *lines, ""]], f"╰{side}╯"]


def _facts(r: dict) -> list[tuple[str, str]]:
    return [("Shell", cap(r["shell"])), ("History file", r["history_file"]), ("Total commands", f"{r['total_commands']:,}"), ("Unique commands", f"{r['unique_commands']:,}")]


def analysis_table(r: dict, min_frequency: int = 5) -> str:
    out = _boxed([f"{TITLE} - History Analysis", "─" * 55, *[f"{k}: {v}" for k, v in _facts(r)]])
    out += ["", f"TOP REPEATED PATTERNS (min frequency: {min_frequency})", "", "Rank  Count  Pattern", "─" * 68]
    out += [f"{i:>4}  {p['frequency']:>5}    {p['pattern']}" for i, p in enumerate(r["patterns"], 1)] or ["  No patterns found matching the criteria."]
    if r["alerts"]:
        out += ["", f"⚠️  SAFETY ALERTS: {_n_alerts(r)} dangerous pattern{_s(_n_alerts(r))} detected", *_elsewhere(r)]
    for a in r["alerts"]:
        out += ["", f"  ● {a['pattern']} ({a['frequency']}×)", f"    Risk: {a['risk']}", f"    Fix:  {a['safer_alternative']}"]
    return "\n".join([*out, "", "Use 'suggest' to generate automation recommendations."])


def _table(patterns: list[dict], none: str) -> list[str]:
    if not patterns:
        return [none]
    return ["| Rank | Count | Pattern |", "|------|-------|---------|", *[f"| {i} | {p['frequency']} | `{escape(p['pattern'])}` |" for i, p in enumerate(patterns, 1)]]


def analysis_markdown(r: dict, min_frequency: int = 5) -> str:
    f = dict(_facts(r))
    out = [f"# {TITLE} - History Analysis", "", f"**Shell:** {f['Shell']}  ", f"**History File:** `{f['History file']}`  ", f"**Total Commands:** {f['Total commands']}  ", f"**Unique Commands:** {f['Unique commands']}", "", "---", ""]
    out += [f"## Top Repeated Patterns (min frequency: {min_frequency})", "", *_table(r["patterns"], "_No patterns found matching the criteria._")]
    if r["alerts"]:
        out += ["", "---", "", f"## Safety Alerts ({_n_alerts(r)} dangerous pattern{_s(_n_alerts(r))} detected)", *_elsewhere(r), ""]
    for i, a in enumerate(r["alerts"], 1):
        out += [f"### Alert {i}: `{escape(a['pattern'])}`", "", f"**Frequency:** {a['frequency']} times  ", f"**Risk:** {a['risk']}  ", f"**Safer Alternative:** {a['safer_alternative']}", ""]
    return "\n".join([*out, "", "---", "", "_Use `suggest` to generate automation recommendations._", ""])


def report_markdown(r: dict, suggestions: list[dict], generated_at: str | None = None) -> str:
    when = (generated_at or iso(datetime.now(UTC)))[:19].replace("T", " ")
    f, rule = dict(_facts(r)), ["", "---", ""]
    out = [f"# {TITLE} Report", "", f"**Generated:** {when}  ", f"**Shell:** {f['Shell']}  ", f"**History File:** `{f['History file']}`", *rule]
    out += ["## Summary", "", f"- **Total Commands:** {f['Total commands']}", f"- **Unique Commands:** {f['Unique commands']}", f"- **Automation Opportunities Found:** {len(suggestions)}", f"- **Safety Alerts:** {_n_alerts(r)}", *rule]
    out += ["## Top Repeated Patterns", "", *_table(r["patterns"][:10], "_No patterns found._"), *rule]
    if suggestions:
        out += ["## Suggested Automations", ""]
    marks = {"danger": "**DANGER**", "warning": "**WARNING**", "safe": "Safe"}
    for i, s in enumerate(suggestions, 1):
        name = f": `{s['name']}`" if s["name"] else ""
        out += [f"### {i}. {cap(s['type'])}{name} for `{escape(s['pattern'])}`", "", f"**Original Pattern:** `{escape(s['pattern'])}`  ", f"**Type:** {cap(s['type'])}"]
        if s.get("safety"):
            out.append(f"**Safety:** {marks[s['safety']]}")
        out += ["", "```" + ("powershell" if r["shell"] == "powershell" else "bash"), s["code"], "```"]
        if s.get("explanation"):
            out += ["", f"**Rationale:** {s['explanation']}"]
        out += rule
    if r["alerts"]:
        out += ["## Safety Alerts", *_elsewhere(r), ""]
    for i, a in enumerate(r["alerts"], 1):
        out += [f"### Alert {i}: `{escape(a['pattern'])}`", "", f"**Frequency:** {a['frequency']} times  ", f"**Risk:** {a['risk']}", "", "**Safer Alternative:**", "", "```bash", a["safer_alternative"], "```", *rule]
    out += ["## Recommendations", ""]
    n, m = len(suggestions), _n_alerts(r)
    out += [f"1. Look through the {n} suggestion{_s(n)} above and apply what helps"] * bool(n)
    out += [f"2. Replace the {m} dangerous pattern{_s(m)} by the alternatives given"] * bool(m)
    out += [f"{3 if n or m else 1}. Repeat `analyze` from time to time, as habits change", *rule]
    return "\n".join(out)


def report_json(r: dict, suggestions: list[dict], generated_at: str | None = None) -> str:
    counts = {"totalCommands": r["total_commands"], "uniqueCommands": r["unique_commands"], "automationOpportunities": len(suggestions), "safetyAlerts": _n_alerts(r)}
    return dumps({"generatedAt": generated_at or iso(datetime.now(UTC)), "shell": r["shell"], "historyFile": r["history_file"], "summary": counts, "patterns": [_pattern(p) for p in r["patterns"]], "suggestions": suggestions, "safetyAlerts": [_alert(a) for a in r["alerts"]]} | _folder(r))


def search_table(rows: list[dict], query: str) -> str:
    out = [*_boxed([f"{TITLE} - Search", "─" * 55, f'Query: "{query}"', f"Results: {len(rows)}"]), "", "Rank  Score  Freq  Command", "─" * 72]
    return "\n".join(out + [f"{i:>4}  {share(r['score']):>5}  {r['frequency']:>4}×  {r['command']}" for i, r in enumerate(rows, 1)])


def search_json(rows: list[dict]) -> str:
    return dumps({"results": [{"command": r["command"], "score": r["score"], "frequency": r["frequency"], "lastUsed": iso(r["last_used"]), "lineNumber": r["line_number"]} for r in rows]})


def search_markdown(rows: list[dict], query: str) -> str:
    out = [f'# Search Results: "{query}"', "", "| Rank | Score | Freq | Command |", "|------|-------|------|---------|"]
    return "\n".join(out + [f"| {i} | {share(r['score'])} | {r['frequency']}× | `{r['command'].replace('|', chr(92) + '|')}` |" for i, r in enumerate(rows, 1)])


def _title(s: dict) -> str:
    """Type and name of a suggestion, and the pattern it is for, cut to fit a heading."""
    most = 40 if s["name"] else 50
    pattern = s["pattern"] if len(s["pattern"]) <= most else s["pattern"][: most - 3] + "..."
    return cap(s["type"]) + (f' "{s["name"]}"' if s["name"] else "") + f" for {pattern}"


def suggestions_terminal(suggestions: list[dict]) -> str:
    """Suggestions for a screen."""
    rule, out = "━" * 68, [*_boxed([f"{TITLE} - Suggestions"]), ""]
    for i, s in enumerate(suggestions, 1):
        out += [rule, "", f"SUGGESTION {i}/{len(suggestions)}: {_title(s)}", "", f"Pattern: {s['pattern']}", f"Type:    {cap(s['type'])}"]
        if s.get("safety"):
            out.append(f"Safety:  {cap(s['safety'])}")
        out += ["", "Suggested Code:", "", *[f"    {x}" for x in s["code"].split("\n")]]
        if s.get("explanation"):
            out += ["", "Explanation:", f"   {s['explanation']}"]
        out.append("")
    return "\n".join([*out, rule])


def suggestions_text(suggestions: list[dict], generated_at: str | None = None) -> str:
    """Suggestions for a file."""
    rule = "=" * 68
    out = [f"{TITLE} - Suggestions", f"Generated: {generated_at or iso(datetime.now(UTC))}", f"Total suggestions: {len(suggestions)}", "", rule]
    for i, s in enumerate(suggestions, 1):
        out += ["", f"SUGGESTION {i}/{len(suggestions)}: {_title(s)}", "-" * 40, f"Pattern: {s['pattern']}", f"Type:    {cap(s['type'])}"]
        if s.get("safety"):
            out.append(f"Safety:  {s['safety']}")
        out += ["", "Code:", *[f"    {x}" for x in s["code"].split("\n")]]
        if s.get("explanation"):
            out += ["", f"Explanation: {s['explanation']}"]
        out += ["", rule]
    return "\n".join(out) + "\n"


def _next_steps(shell: str, target: str, appended: bool) -> list[str]:
    """How to load the file; nothing is loaded here."""
    load = f"{'.' if shell == 'powershell' else 'source'} {target}"
    if appended:
        return ["", "NEXT STEPS:", "", "Load the changed file:", "", f"    {load}"]
    profile, again = ("$PROFILE", ". $PROFILE") if shell == "powershell" else ("~/.zshrc" if shell == "zsh" else "~/.bashrc", f"exec {shell}")
    return ["", "NEXT STEPS:", "", "For this session:", "", f"    {load}", "", f"For all sessions, put this line into {profile}:", "", f"    {load}", "", "and start anew:", "", f"    {again}"]


def _preview(code: str, most: int | None = None) -> list[str]:
    lines = code.split("\n")
    return ["", "Preview:", "", *[f"    {x}" for x in lines[:most]], *["    ..."] * (most is not None and len(lines) > most)]


def dry_run(code: str, n: int, target: str) -> str:
    return "\n".join([f"Dry run: {n} suggestion{_s(n)} would go to {target}", *_preview(code), "", "No file was changed."])


def applied(code: str, n: int, target: str, shell: str, saved: str | None, appended: bool) -> str:
    """What was written, with the first lines of a new file."""
    out = [f"Backup: {saved}"] * bool(saved) + [f"{'Appended' if appended else 'Wrote'} {n} suggestion{_s(n)} to {target}"]
    return "\n".join([*out, *([] if appended else _preview(code, PREVIEW_LINES)), *_next_steps(shell, target, appended)])


def shell_code(suggestions: list[dict], shell: str, generated_at: str | None = None) -> str:
    """Suggestions as a file that a shell can source."""
    when = (generated_at or iso(datetime.now(UTC)))[:19].replace("T", " ")
    out = [f"# Generated shell shortcuts ({shell})", f"# Generated at: {when}", ""]
    for i, s in enumerate(suggestions, 1):
        out.append(f"# Suggestion {i}: {s['name'] or s['pattern']}")
        out += [f"# {x}" for x in wrap_text(s.get("explanation") or "", 70) if x]
        if s.get("safety") in ("warning", "danger"):
            out.append(f"# {s['safety'].upper()}: review before use")
        out += [s["code"], ""]
    return "\n".join(out)

"""More alerts than a command prints: all of them in files, in order."""

import json
from pathlib import Path

from loomlog.operators import safety
from loomlog.plans import commands, render

FIELDS = ("pattern", "frequency", "risk", "safer_alternative", "rule_name")


def test_more_alerts_than_are_printed(spark, tmp_path):
    rows = [("s", i, f"sudo rm -rf /tmp/{i % 300}" if i % 7 else "git status", None, i + 1) for i in range(1000)]
    entries = spark.createDataFrame(rows, "source string, ord long, command string, timestamp timestamp, line_number int").repartition(3)
    folder = str(tmp_path / "alerts")
    want = [tuple(r) for r in safety.safety_alerts(entries).collect()]
    r = commands.analyze_entries(entries, "bash", "log", alerts_to=folder, most_alerts=20)
    assert r["n_alerts"] == len(want) == 600 and r["alerts_folder"] == folder
    assert [tuple(a.values()) for a in r["alerts"]] == [w[:4] for w in want[:20]]
    lines = [json.loads(x) for f in sorted(Path(folder).glob("part-*")) for x in f.read_text().splitlines()]
    assert [tuple(x[k] for k in FIELDS) for x in lines] == want
    for text in (render.analysis_table(r), render.analysis_markdown(r), render.report_markdown(r, [])):
        assert "The first 20 are shown; all 600 are in" in text and folder in text
    assert json.loads(render.analysis_json(r))["allSafetyAlerts"] == folder
    assert json.loads(render.report_json(r, []))["summary"]["safetyAlerts"] == 600

    few = commands.analyze_entries(entries, "bash", "log", alerts_to=str(tmp_path / "none"))
    assert len(few["alerts"]) == 600 and few["alerts_folder"] is None and not (tmp_path / "none").exists()
    assert "are shown" not in render.analysis_table(few) and "allSafetyAlerts" not in render.analysis_json(few)

"""Rules for dangerous commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.text import trim_all

# Word ends by ASCII letters: Java's own word boundary takes letters of all scripts for part of a word.
_W, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

#: Name, risk and safer alternative of each rule (fixed values).
RULES = (
    ("rm-rf-no-interactive", "rm -rf without -i flag — no confirmation prompt before deletion", "Use `rm -rfi` for interactive confirmation, or preview with `ls` first: `ls -la <path> && rm -rf <path>`"),
    ("sudo-rm", "sudo rm — running destructive delete with elevated privileges without confirmation", "Use `sudo rm -i` for interactive prompts, or double-check the path before execution."),
    ("unquoted-variable", "Unquoted variable expansion — risk of word splitting and glob expansion", 'Always quote variable expansions: use `"$VAR"` instead of `$VAR` to prevent word splitting.'),
    ("ps-remove-item-no-whatif", "Remove-Item -Recurse -Force without -WhatIf or -Confirm — silent recursive deletion", "Add `-WhatIf` to preview changes first, or `-Confirm` for interactive prompts: `Remove-Item -Recurse -Force -WhatIf`"),
    ("dd-no-status", "dd without status=progress — silent data operation with no progress indicator", "Add `status=progress` to see real-time progress: `dd if=... of=... status=progress`"),
    ("chmod-777", "chmod 777 — overly permissive file permissions (world-readable/writable/executable)", "Use minimum necessary permissions: `chmod 755` for directories, `chmod 644` for files."),
)


def _word(c: Column, *words: str) -> Column:
    return c.rlike(f"{_W}(?:{'|'.join(words)}){_E}")


def rule_hits(c: Column) -> list[Column]:
    """One condition for each rule, in order."""
    rm = f"{_W}rm"
    both_flags = c.rlike(rm + r"\s+.*-\S*r\S*f") | c.rlike(rm + r"\s+.*-\S*f\S*r")
    asks = c.rlike(rm + r"\s+.*-\S*i") | c.rlike(rm + _E + r".*\s-i" + _E)
    has = lambda word: c.rlike(f"(?i){word}")
    bare = F.exists(F.split(c, r"\s+"), lambda s: s.rlike(r"\$[A-Za-z_][A-Za-z0-9_]*") & ~F.contains(s, F.lit('"')) & ~F.contains(s, F.lit("'")))
    return [
        _word(c, "rm") & both_flags & ~asks,
        c.rlike(f"{_W}sudo\\s+rm{_E}"),
        _word(c, "rm", "mv", "cp") & bare,
        has("Remove-Item") & has("-Recurse") & has("-Force") & ~has("-WhatIf") & ~has("-Confirm"),
        _word(c, "dd") & c.rlike(f"{_W}(?:if|of)=") & ~F.contains(c, F.lit("status=progress")),
        _word(c, "chmod") & _word(c, "777"),
    ]


def flagged(entries: DataFrame) -> DataFrame:
    """One row per entry and rule that fires: pattern, rule, first."""
    c = trim_all(F.col("command"))
    hits = F.array_compact(F.array(*[F.when(hit, F.lit(i)) for i, hit in enumerate(rule_hits(c))]))
    return entries.select(c.alias("pattern"), F.struct("source", "ord").alias("first"), F.explode(hits).alias("rule"))


def safety_alerts(entries: DataFrame) -> DataFrame:
    """pattern, frequency, risk, safer_alternative, rule_name: most frequent first."""
    found = flagged(entries).groupBy("rule", "pattern").agg(F.count("*").alias("frequency"), F.min("first").alias("first"))
    pick = lambda k: F.element_at(F.array(*[F.lit(r[k]) for r in RULES]), F.col("rule") + 1)
    return found.orderBy(F.desc("frequency"), "first", "rule").select("pattern", "frequency", pick(1).alias("risk"), pick(2).alias("safer_alternative"), pick(0).alias("rule_name"))


def dangerous_commands(entries: DataFrame) -> DataFrame:
    """Distinct commands that any rule flags, in order of first use."""
    return flagged(entries).groupBy("pattern").agg(F.min("first").alias("first")).orderBy("first").select("pattern")

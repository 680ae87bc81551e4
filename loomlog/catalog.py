"""Named queries over the driver's tables, with the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog.functions import text as T
from loomlog.operators import clean, frequency, redact, responses, safety
from loomlog.operators.assemble import assemble, extended_entries, is_extended, plain_entries
from loomlog.operators.chunks import CHUNK, in_chunks
from loomlog.operators.search import command_stats, search
from loomlog.operators.search_index import build_index, search_index
from loomlog.plans.commands import totals
from loomlog.session import shared_folder, stored_by
from loomlog.sources.history import ALL_LINES, events_as_entries, lines_of, parts_as_entries, tail_lines, texts_as_one


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_entries(_read(spark, sf_dir, "events"))


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean(_events(spark, sf_dir))


_ENTRIES = """e AS (SELECT CAST(user_id AS VARCHAR) AS source, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ord, event_type AS command, ts FROM events)"""
_CLEAN = _ENTRIES + """, k AS (SELECT * FROM (SELECT *, lag(command) OVER (PARTITION BY source ORDER BY ord) AS b FROM e WHERE length(command) > 1 AND lower(command) NOT IN ('ls','cd','clear','exit','pwd','history')) WHERE b IS NULL OR b <> command)"""


def _documents_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(_read(spark, sf_dir, "documents"), "doc_id", "text")


_LINES = r"""l AS (SELECT CAST(doc_id AS VARCHAR) AS source, len(parts) AS n_lines, unnest(parts) AS raw, generate_subscripts(parts, 1) - 1 AS line_idx FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS parts FROM documents))"""

_WHITE = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288, 65279))

# Logs made of orders: a time line, and a command over two lines.


def _log_lines(orders: DataFrame, pieces) -> DataFrame:
    texts = orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", *pieces))).alias("rows"))
    names = [f"p{i}" for i in range(len(pieces))]
    text = F.array_join(F.transform("rows", lambda r: F.concat_ws("\n", *[r[n] for n in names])), "\n")
    return tail_lines(lines_of(texts.select("o_custkey", text.alias("text")), "o_custkey", "text"), ALL_LINES)


def _plain_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyyMMdd")
    pieces = [F.concat(F.lit("#1"), day).alias("p0"), F.concat(F.lit("run "), F.col("o_orderpriority"), F.lit(" \\")).alias("p1"), F.concat(F.lit("  --status "), F.col("o_orderstatus"), F.lit("  ")).alias("p2")]
    return _log_lines(_read(spark, sf_dir, "orders"), pieces)


def _extended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyyMMdd")
    pieces = [F.concat(F.lit(": 1"), day, F.lit(":0;ship "), F.col("o_orderstatus")).alias("p0"), F.concat(F.lit("note "), F.col("o_orderpriority")).alias("p1")]
    return _log_lines(_read(spark, sf_dir, "orders"), pieces)


def _q_assemble_plain(spark, sf_dir):
    out = plain_entries(_plain_log(spark, sf_dir))
    return out.select("source", "ord", "command", F.unix_seconds("timestamp").alias("epoch"), "line_number")


def _q_assemble_extended(spark, sf_dir):
    out = extended_entries(_extended_log(spark, sf_dir))
    return out.select("source", "ord", "command", F.unix_seconds("timestamp").alias("epoch"), "line_number")


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dangerous and harmless commands made of part names."""
    p = _read(spark, sf_dir, "part")
    n = F.split("p_name", " ")[0]
    kinds = [
        F.concat(F.lit("rm -rf /tmp/"), n),
        F.concat(F.lit("rm -rf -i "), n),
        F.concat(F.lit("sudo rm "), n),
        F.concat(F.lit("cp $"), n, F.lit(" /tmp")),
        F.concat(F.lit('mv "$'), n, F.lit('" x')),
        F.concat(F.lit("Remove-Item "), n, F.lit(" -recurse -force")),
        F.concat(F.lit("dd if="), n, F.lit(" of=x")),
        F.concat(F.lit("chmod 777 "), n),
        F.concat(F.lit("git add "), n),
    ]
    c = F.element_at(F.array(*kinds), (F.col("p_partkey") % len(kinds) + 1).cast("int"))
    return p.select(F.lit("s").alias("source"), F.col("p_partkey").alias("ord"), c.alias("command"), F.lit(None).cast("timestamp").alias("timestamp"), F.col("p_partkey").cast("int").alias("line_number"))


_N = "split_part(p_name, ' ', 1)"
_COMMANDS = f"""c AS (SELECT p_partkey AS ord, CASE p_partkey % 9 WHEN 0 THEN 'rm -rf /tmp/' || {_N} WHEN 1 THEN 'rm -rf -i ' || {_N} WHEN 2 THEN 'sudo rm ' || {_N} WHEN 3 THEN 'cp $' || {_N} || ' /tmp' WHEN 4 THEN 'mv "$' || {_N} || '" x' WHEN 5 THEN 'Remove-Item ' || {_N} || ' -recurse -force' WHEN 6 THEN 'dd if=' || {_N} || ' of=x' WHEN 7 THEN 'chmod 777 ' || {_N} ELSE 'git add ' || {_N} END AS command FROM part)"""


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_HITS = (
    _COMMANDS
    + r""", h AS (
SELECT ord, command, 0 AS rule FROM c WHERE regexp_matches(command, '\brm\b') AND (regexp_matches(command, '\brm\s+.*-\S*r\S*f') OR regexp_matches(command, '\brm\s+.*-\S*f\S*r')) AND NOT (regexp_matches(command, '\brm\s+.*-\S*i') OR regexp_matches(command, '\brm\b.*\s-i\b'))
UNION ALL SELECT ord, command, 1 FROM c WHERE regexp_matches(command, '\bsudo\s+rm\b')
UNION ALL SELECT ord, command, 2 FROM c WHERE regexp_matches(command, '\b(rm|mv|cp)\b') AND len(list_filter(regexp_split_to_array(command, '\s+'), lambda s: regexp_matches(s, '\$[A-Za-z_]\w*') AND NOT contains(s, '"') AND NOT contains(s, ''''))) > 0
UNION ALL SELECT ord, command, 3 FROM c WHERE regexp_matches(command, '(?i)Remove-Item') AND regexp_matches(command, '(?i)-Recurse') AND regexp_matches(command, '(?i)-Force') AND NOT regexp_matches(command, '(?i)-WhatIf|-Confirm')
UNION ALL SELECT ord, command, 4 FROM c WHERE regexp_matches(command, '\bdd\b') AND regexp_matches(command, '\b(if|of)=') AND NOT contains(command, 'status=progress')
UNION ALL SELECT ord, command, 5 FROM c WHERE regexp_matches(command, '\bchmod\b') AND regexp_matches(command, '\b777\b'))"""
)
_RULES = """r AS (SELECT * FROM (VALUES
(0, 'rm-rf-no-interactive', 'rm -rf without -i flag — no confirmation prompt before deletion', 'Use `rm -rfi` for interactive confirmation, or preview with `ls` first: `ls -la <path> && rm -rf <path>`'),
(1, 'sudo-rm', 'sudo rm — running destructive delete with elevated privileges without confirmation', 'Use `sudo rm -i` for interactive prompts, or double-check the path before execution.'),
(2, 'unquoted-variable', 'Unquoted variable expansion — risk of word splitting and glob expansion', 'Always quote variable expansions: use `"$VAR"` instead of `$VAR` to prevent word splitting.'),
(3, 'ps-remove-item-no-whatif', 'Remove-Item -Recurse -Force without -WhatIf or -Confirm — silent recursive deletion', 'Add `-WhatIf` to preview changes first, or `-Confirm` for interactive prompts: `Remove-Item -Recurse -Force -WhatIf`'),
(4, 'dd-no-status', 'dd without status=progress — silent data operation with no progress indicator', 'Add `status=progress` to see real-time progress: `dd if=... of=... status=progress`'),
(5, 'chmod-777', 'chmod 777 — overly permissive file permissions (world-readable/writable/executable)', 'Use minimum necessary permissions: `chmod 755` for directories, `chmod 644` for files.')
) AS t(rule, rule_name, risk, safer_alternative))"""

_SEARCHED = "almond steel"
_TOKENS = r"""list_filter(regexp_split_to_array(lower(command), '[\s/\-_.=|;:&"''`<>(){}\[\]]+'), lambda t: t <> '')"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts_as_entries(_read(spark, sf_dir, "part"))


def _q_scalars(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    n = F.col("p_name")
    return p.select(
        "p_partkey",
        T.capitalize(n).alias("capital"),
        T.truncate(n, 12).alias("short"),
        T.escape_markdown(F.concat(n, F.lit("|`\n"), n)).alias("escaped"),
        T.percent(F.col("p_size") / 1000.0).alias("percent"),
        T.round3(F.col("p_retailprice") / 7.0).alias("rounded"),
        T.thousands(F.col("p_partkey") * 1237).alias("thousands"),
        T.iso_millis(F.timestamp_millis(F.col("p_partkey") * 98765431)).alias("iso"),
    )


def _q_scores(spark, sf_dir):
    e = _events(spark, sf_dir)
    s = e.groupBy("command").agg(F.count("*").alias("frequency"), F.max("timestamp").alias("last_used"))
    top = s.agg(F.max("frequency").alias("most"), F.max("last_used").alias("newest"))
    s = s.crossJoin(F.broadcast(top))
    return s.select("command", "frequency", F.round(T.frequency_score(F.col("frequency"), F.col("most")), 9).alias("frequency_score"), F.round(T.recency_score(F.col("last_used"), F.col("newest")), 9).alias("recency_score"))


def _part_texts(spark: SparkSession, sf_dir: str, *kinds) -> DataFrame:
    """p_partkey and raw: one of the texts for each part, in turn; each is made of the part's name and type."""
    p = _read(spark, sf_dir, "part")
    made = F.element_at(F.array(*[k(F.col("p_name"), F.col("p_type")) for k in kinds]), (F.col("p_partkey") % len(kinds) + 1).cast("int"))
    return p.select("p_partkey", "p_name", "p_type", made.alias("raw"))


def _q_parse_suggestions(spark, sf_dir):
    """Answers with fenced, bare, wrapped, incomplete, odd, conversational and no suggestions."""
    raw = _part_texts(
        spark,
        sf_dir,
        lambda n, t: F.concat(F.lit('Here:\n```json\n[{"pattern":"'), n, F.lit('","type":"alias","code":"'), t, F.lit('","name":"gs","explanation":"short","safety":"safe"}]\n```')),
        lambda n, t: F.concat(F.lit('{"suggestions":[{"pattern":"'), n, F.lit('","code":"x","type":"odd","safety":"maybe"},{"code":1},7,{"name":"only"},{"pattern":"'), t, F.lit('","type":"script","name":null}]}')),
        lambda n, t: F.concat(F.lit("no answer about "), n),
        lambda n, t: F.concat(F.lit('{"other":["'), n, F.lit('"]}')),
        lambda n, t: F.concat(F.lit("### Alias: `"), n, F.lit("`\n```bash\nalias gs='"), t, F.lit("'\n```\nand\n\n**Function:** "), t, F.lit("\n\n```\nfunction do-it() { x; }\n```\n")),
        lambda n, t: F.concat(F.lit('```\n```\ntext [{"pattern":"'), n, F.lit('","code":"y","safety":"danger"}] text')),
    )
    return responses.parse_suggestions(raw.select("p_partkey", "raw")).drop("raw")


_PARSED_SUGGESTIONS = """WITH p AS (SELECT *, p_partkey % 6 AS k FROM part)
SELECT p_partkey, 0 AS position, p_name AS pattern, 'alias' AS type, p_type AS code, 'gs' AS name, 'short' AS explanation, 'safe' AS safety FROM p WHERE k = 0
UNION ALL SELECT p_partkey, 0, p_name, 'function', 'x', '', '', NULL FROM p WHERE k = 1
UNION ALL SELECT p_partkey, 4, p_type, 'script', '', '', '', NULL FROM p WHERE k = 1
UNION ALL SELECT p_partkey, 0, p_name, 'alias', 'alias gs=''' || p_type || '''', 'gs', '', NULL FROM p WHERE k = 4
UNION ALL SELECT p_partkey, 1, 'Function:** ' || p_type, 'function', 'function do-it() { x; }', 'do-it', '', NULL FROM p WHERE k = 4
UNION ALL SELECT p_partkey, 0, p_name, 'function', 'y', '', '', 'danger' FROM p WHERE k = 5"""


def _q_parse_alerts(spark, sf_dir):
    raw = _part_texts(
        spark,
        sf_dir,
        lambda n, t: F.concat(F.lit('[{"command":"'), n, F.lit('","risk":"gone","safer_alternative":"'), t, F.lit('","frequency":3}]')),
        lambda n, t: F.concat(F.lit('{"alerts":[{"pattern":"'), n, F.lit('","saferAlternative":"'), t, F.lit('","frequency":"7"},{"risk":"nothing"}]}')),
        lambda n, t: F.concat(F.lit("none for "), n),
        lambda n, t: F.concat(F.lit('ok\n```json\n{"alerts":[1,{"pattern":2,"command":"'), n, F.lit('","frequency":2.5}]}\n```')),
    )
    return responses.parse_alerts(raw.select("p_partkey", "raw")).drop("raw")


_PARSED_ALERTS = """WITH p AS (SELECT *, p_partkey % 4 AS k FROM part)
SELECT p_partkey, 0 AS position, p_name AS pattern, CAST(3 AS DOUBLE) AS frequency, 'gone' AS risk, p_type AS safer_alternative FROM p WHERE k = 0
UNION ALL SELECT p_partkey, 0, p_name, 0, '', p_type FROM p WHERE k = 1
UNION ALL SELECT p_partkey, 1, p_name, 2.5, '', '' FROM p WHERE k = 3"""


def _single_answers(spark, sf_dir):
    return _part_texts(
        spark,
        sf_dir,
        lambda n, t: F.concat(F.lit("\x1b[1mSuggestion:\x1b[0m\n\n  alias ab="), t, F.lit("\n\n? Select an option\n> Copy command to clipboard\n")),
        lambda n, t: F.concat(F.lit("deploy() {\n  "), n, F.lit("\n}\n? Select an option [Use arrows]")),
        lambda n, t: F.concat(F.lit("#!/bin/sh\necho "), n),
        lambda n, t: F.concat(F.lit("Set-Alias -Name gg -Value "), n, F.lit("\x07")),
        lambda n, t: F.concat(F.lit("function Get-It {\n"), t, F.lit("\n}\n> Copy command to clipboard")),
        lambda n, t: F.concat(F.lit("  "), t, F.lit(" --all  ")),
        lambda n, t: F.lit(" \x1b[0m \n"),
        lambda n, t: F.concat(F.lit('[{"pattern":"p","code":"'), n, F.lit('"},{"pattern":"q","code":"'), t, F.lit('"}]')),
    )


def _q_suggested_commands(spark, sf_dir):
    rows = _single_answers(spark, sf_dir)
    return rows.select("p_partkey", responses.strip_ansi(F.col("raw")).alias("plain"), responses.suggested_command(F.col("raw")).alias("command"))


_SUGGESTED_COMMANDS = """WITH p AS (SELECT p_partkey, p_name AS n, p_type AS t, p_partkey % 8 AS k, chr(10) AS lf FROM part)
SELECT p_partkey,
 CASE k WHEN 0 THEN 'Suggestion:' || lf || lf || '  alias ab=' || t || lf || lf || '? Select an option' || lf || '> Copy command to clipboard' || lf WHEN 1 THEN 'deploy() {' || lf || '  ' || n || lf || '}' || lf || '? Select an option [Use arrows]' WHEN 2 THEN '#!/bin/sh' || lf || 'echo ' || n WHEN 3 THEN 'Set-Alias -Name gg -Value ' || n WHEN 4 THEN 'function Get-It {' || lf || t || lf || '}' || lf || '> Copy command to clipboard' WHEN 5 THEN '  ' || t || ' --all  ' WHEN 6 THEN '  ' || lf ELSE '[{"pattern":"p","code":"' || n || '"},{"pattern":"q","code":"' || t || '"}]' END AS plain,
 CASE k WHEN 0 THEN 'alias ab=' || t WHEN 1 THEN 'deploy() {' || lf || '  ' || n || lf || '}' WHEN 2 THEN '#!/bin/sh' || lf || 'echo ' || n WHEN 3 THEN 'Set-Alias -Name gg -Value ' || n WHEN 4 THEN 'function Get-It {' || lf || t || lf || '}' WHEN 5 THEN t || ' --all' WHEN 6 THEN '' ELSE '[{"pattern":"p","code":"' || n || '"},{"pattern":"q","code":"' || t || '"}]' END AS command FROM p"""


def _q_single_suggestions(spark, sf_dir):
    rows = _single_answers(spark, sf_dir)
    return responses.single_suggestions(rows.select(F.col("p_partkey").alias("id"), "raw", F.col("p_name").alias("pattern"), F.col("p_partkey").alias("frequency")))


_SINGLE_SUGGESTIONS = f"""WITH c AS ({_SUGGESTED_COMMANDS}), s AS (SELECT p_name AS pattern, p_partkey % 8 AS k, command, 'Shortcut for "' || p_name || '" (used ' || p_partkey || ' times)' AS about, p_type FROM c JOIN part USING (p_partkey))
SELECT pattern, CASE k WHEN 0 THEN 'alias' WHEN 2 THEN 'script' WHEN 3 THEN 'alias' ELSE 'function' END AS type, command AS code, CASE k WHEN 0 THEN 'ab' WHEN 1 THEN 'deploy' WHEN 3 THEN 'gg' WHEN 4 THEN 'Get-It' ELSE '' END AS name, about AS explanation, CAST(NULL AS VARCHAR) AS safety FROM s WHERE k < 6
UNION ALL SELECT 'p', 'function', pattern, '', '', NULL FROM s WHERE k = 7
UNION ALL SELECT 'q', 'function', p_type, '', '', NULL FROM s WHERE k = 7"""


def _q_single_alerts(spark, sf_dir):
    rows = _part_texts(spark, sf_dir, lambda n, t: F.concat(F.lit("use "), t), lambda n, t: F.lit(""), lambda n, t: F.concat(F.lit('[{"pattern":"'), t, F.lit('","risk":"r"},{"command":"c"}]')))
    return responses.single_alerts(rows.select(F.col("p_partkey").alias("id"), "raw", F.col("p_name").alias("command")))


_SINGLE_ALERTS = """SELECT p_name AS pattern, CAST(0 AS DOUBLE) AS frequency, 'Potentially dangerous command' AS risk, 'use ' || p_type AS safer_alternative FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_type, 0, 'r', '' FROM part WHERE p_partkey % 3 = 2
UNION ALL SELECT 'c', 0, '', '' FROM part WHERE p_partkey % 3 = 2"""

#: A line of each kind of secret and what is left of it, around a number n of 7 digits.
_SECRETS = (
    ("password={n} x", "[REDACTED] x"),
    ('API_KEY = "a {n}"', "[REDACTED]"),
    ("export DB_AUTH_MODE={n}", "[REDACTED]"),
    ("docker login -p {n} host", "[REDACTED]"),
    ("ssh -i ~/.ssh/{n} host", "[REDACTED] host"),
    ("ssh-add ~/.ssh/{n}", "[REDACTED]"),
    ("git clone https://user:{n}@host/a", "git clone https://[REDACTED]host/a"),
    ("curl -u user:{n} https://a", "curl [REDACTED] https://a"),
    ("use AKIAABCDEFGHI{n} now", "use [REDACTED] now"),
    ("push ghp_abcdefghijklmnopqrst{n} x", "push [REDACTED] x"),
    ("x glpat-abcdefghij{n} y", "x [REDACTED] y"),
    ("x npm_abcdefghij{n} y", "x [REDACTED] y"),
    ("npm config set //r/:_authToken {n}", "[REDACTED]"),
    ("send Bearer abc.{n} now", "send [REDACTED] now"),
    ("Authorization: Basic {n}", "[REDACTED]"),
    ("key Ab+/Ab+/Ab+/Ab+/Ab+/Ab+/Ab+/Ab+/Ab+/{n}== end", "key [REDACTED] end"),
    ("id=abcdef0123456789abcdef012{n}", "id=[REDACTED]"),
    ("git commit -m {n}", "git commit -m {n}"),
)


def _q_scrub_kinds(spark, sf_dir):
    n = F.lpad(F.col("p_partkey").cast("string"), 7, "0")
    rows = _read(spark, sf_dir, "part").crossJoin(F.broadcast(spark.createDataFrame([(k, a) for k, (a, _) in enumerate(_SECRETS)], "kind int, form string")))
    return redact.scrub_column(rows.select("p_partkey", "kind", F.replace("form", F.lit("{n}"), n).alias("raw")), "raw")


def _noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a log with noise in it."""
    said = F.array(*[F.lit(x) for x in ("ls", "cd", "git status", "x", " LS ", "git status", "npm test", "ls -la", "Exit", "npm test")])
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return _read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("source"), F.row_number().over(order).cast("long").alias("ord"), F.element_at(said, (F.col("o_orderkey") % 10 + 1).cast("int")).alias("command"))


def _q_sniff_kinds(spark, sf_dir):
    """Logs whose first line, 20th or 21st line is extended, blank lines aside."""
    stamp = F.lit(": 1700000000:0;ls\n")
    kinds = [stamp, F.concat(F.repeat(F.lit("a\n"), F.lit(20)), stamp), F.lit("a\nb"), F.concat(F.repeat(F.lit(" \n"), F.lit(30)), stamp), F.concat(F.repeat(F.lit("a\n\n"), F.lit(19)), stamp)]
    text = F.element_at(F.array(*kinds), (F.col("c_custkey") % 5 + 1).cast("int"))
    return is_extended(lines_of(_read(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), "c_custkey", "text"))


def _q_assemble_continued(spark, sf_dir):
    """Extended logs with continued commands, a lone CR, and open lines outside of a command."""
    head = F.concat(F.lit(": 1"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(":0;"))
    kind = F.col("o_orderkey") % 4
    first = F.when(kind == 0, F.concat(head, F.lit("ship \\"))).when(kind == 1, F.concat(head, F.lit("a\rb"))).otherwise(F.concat(head, F.lit("ship "), F.col("o_orderstatus")))
    second = F.when(kind == 0, F.concat(F.lit("  more "), F.col("o_orderstatus"))).when(kind == 3, F.concat(F.lit("note "), F.col("o_orderpriority"), F.lit(" \\"))).otherwise(F.concat(F.lit("note "), F.col("o_orderpriority")))
    out = extended_entries(_log_lines(_read(spark, sf_dir, "orders"), [first.alias("p0"), second.alias("p1")]))
    return out.select("source", "ord", "command", F.unix_seconds("timestamp").alias("epoch"), "line_number")


def _groups_sql(keys: str) -> str:
    """Greedy grouping, key after key in order, of m(key, n, used, kind, w, first); gives g(pattern, frequency, used, variations, i)."""
    return f"""WITH RECURSIVE {keys}, r AS (SELECT *, row_number() OVER (ORDER BY n DESC, kind, w, first, key) AS i FROM m),
near AS (SELECT b.i, list(a.i ORDER BY a.i) AS low FROM r a JOIN r b ON a.i < b.i AND abs(length(a.key) - length(b.key)) <= 3 AND levenshtein(a.key, b.key) <= 3 GROUP BY b.i),
x AS (SELECT r.i, coalesce(low, CAST([] AS BIGINT[])) AS low FROM r LEFT JOIN near USING (i)),
walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS leaders UNION ALL SELECT x.i, CASE WHEN list_has_any(x.low, walk.leaders) THEN walk.leaders ELSE list_append(walk.leaders, x.i) END FROM walk JOIN x ON x.i = walk.i + 1),
ended AS (SELECT leaders FROM walk ORDER BY i DESC LIMIT 1),
led AS (SELECT x.i, CASE WHEN list_has_any(low, leaders) THEN list_min(list_intersect(low, leaders)) ELSE x.i END AS of_i FROM x, ended),
g AS (SELECT max(key) FILTER (r.i = of_i) AS pattern, CAST(sum(n) AS BIGINT) AS frequency, max(used) AS used, coalesce(string_agg(key, '|' ORDER BY r.i) FILTER (r.i <> of_i), '') AS variations, min(r.i) AS i FROM r JOIN led ON r.i = led.i GROUP BY of_i)"""


def _one_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents as one log, with time lines and continued lines among them."""
    lines = tail_lines(texts_as_one(_read(spark, sf_dir, "documents"), "doc_id", "text", "all"), ALL_LINES)
    i = F.col("line_idx")
    made = F.when(i % 11 == 4, F.concat(F.lit("#"), (1_700_000_000 + i).cast("string"))).when(i % 7 == 2, F.concat("raw", F.lit(" \\"))).when(i % 13 == 5, F.lit(" ")).otherwise(F.col("raw"))
    return lines.withColumn("raw", made)


#: Documents as one log and its entries, by windows over the whole log.
_ONE_LOG = rf"""d AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS parts FROM documents),
b AS (SELECT *, coalesce(sum(len(parts)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM d),
p AS (SELECT CAST(base AS BIGINT) + generate_subscripts(parts, 1) - 1 AS i, unnest(parts) AS raw FROM b),
l AS (SELECT i, CASE WHEN i % 11 = 4 THEN '#' || (1700000000 + i) WHEN i % 7 = 2 THEN raw || ' \' WHEN i % 13 = 5 THEN ' ' ELSE raw END AS raw FROM p),
k AS (SELECT i, rtrim(raw, {_WHITE}) AS body, regexp_matches(trim(raw, {_WHITE}), '^#[0-9]{{9,11}}$') AS stamp FROM l),
t AS (SELECT *, NOT stamp AND suffix(body, '\') AS open, NOT stamp AND NOT suffix(body, '\') AS done FROM k),
g AS (SELECT *, coalesce(sum(CAST(done AS INT)) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM t),
c AS (SELECT grp, max(i) FILTER (done) AS ord, min(i) FILTER (NOT stamp) + 1 AS line_number, bool_or(open) AS continued, trim(string_agg(CASE WHEN open THEN body[:-2] ELSE body END, chr(10) ORDER BY i) FILTER (NOT stamp), {_WHITE}) AS command, max(i) FILTER (stamp) AS stamp_i, max_by(TRY_CAST(trim(body, {_WHITE})[2:] AS BIGINT), i) FILTER (stamp) AS epoch FROM g GROUP BY grp),
s AS (SELECT *, max(stamp_i) OVER w AS stamp_at, max(CASE WHEN continued OR command <> '' THEN ord END) OVER (ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS taken FROM c WHERE ord IS NOT NULL WINDOW w AS (ORDER BY grp)),
o AS (SELECT 'all' AS source, s.ord, s.command, CASE WHEN s.stamp_at > coalesce(s.taken, -1) THEN x.epoch END AS epoch, s.line_number FROM s LEFT JOIN c x ON x.stamp_i = s.stamp_at WHERE s.command <> '')"""
_ONE_LOG_CLEAN = _ONE_LOG + """, e AS (SELECT source, ord, command, epoch AS ts FROM o), k2 AS (SELECT * FROM (SELECT *, lag(command) OVER (ORDER BY ord) AS b FROM e WHERE length(command) > 1 AND lower(command) NOT IN ('ls','cd','clear','exit','pwd','history')) WHERE b IS NULL OR b <> command)"""


def _one_log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble(_one_log(spark, sf_dir), max_lines=ALL_LINES)


def _q_one_log_sequences(spark, sf_dir):
    lines = _one_log(spark, sf_dir)
    first = lines.select("n_lines").first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4096, first["n_lines"] // (2 * CHUNK) if first else 0))
    # The commands are moved once, to the task that holds their chunk; of the runs only digests are.
    entries = stored_by(in_chunks(clean.drop_noise(assemble(lines, max_lines=ALL_LINES))), "entries", parts, "source", "chunk")
    runs = frequency.count_sequences(clean.drop_repeats(entries), known_by=frequency.digest)
    return runs.select(F.lower(F.hex(F.substr("key", F.lit(1), F.lit(16)))).alias("key"), "count", F.unix_seconds("last_used").alias("last_used"), "window")


def _q_alert_suggestions(spark, sf_dir):
    return responses.alerts_as_suggestions(safety.safety_alerts(_commands(spark, sf_dir)))


def _reviewed(spark, sf_dir):
    s = F.element_at(F.array(F.lit("apply"), F.lit("ignore"), F.lit("pending")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return _read(spark, sf_dir, "part").select("p_partkey", s.alias("status"), F.col("p_name").alias("code"), F.when(F.col("p_size") > 25, F.upper("p_name")).alias("edited_code"))


def _search_indexed(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    path = shared_folder(spark, "index")
    build_index(_parts(spark, sf_dir), path)
    return search_index(spark, path, query, 10).select("command", "score", "frequency", "line_number")


def _q_scrub_lines(spark, sf_dir):
    """Every line of documents, all kinds; its lookbehinds have no SQL, scrub_kinds and tests/test_redact.py have each kind."""
    return redact.scrub_column(_documents_lines(spark, sf_dir).select("source", "line_idx", "raw"), "raw")


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "frequency_top": lambda s, d: frequency.count_commands(_cleaned(s, d)).filter("count >= 5").orderBy(F.desc("count"), F.desc_nulls_last("last_used"), "first").limit(20).select(F.col("key").alias("pattern"), F.col("count").alias("frequency"), "last_used"),
    "entries": lambda s, d: _events(s, d).select("source", "ord", "command", "timestamp"),
    "clean_entries": lambda s, d: _cleaned(s, d).select("source", "ord", "command"),
    "document_lines": lambda s, d: _documents_lines(s, d).select("source", "n_lines", "line_idx", "raw"),
    "tail_lines": lambda s, d: tail_lines(_documents_lines(s, d), 100).select("source", "line_number", "raw"),
    "assemble_plain": _q_assemble_plain,
    "assemble_extended": _q_assemble_extended,
    "assemble_documents": lambda s, d: assemble(_documents_lines(s, d), max_lines=ALL_LINES).select("source", "ord", "command", "line_number"),
    "format_sniff": lambda s, d: is_extended(_extended_log(s, d)),
    "one_log_lines": lambda s, d: _one_log(s, d).select("source", "n_lines", "line_idx", "raw"),
    "one_log_entries": lambda s, d: _one_log_entries(s, d).select("source", "ord", "command", F.unix_seconds("timestamp").alias("epoch"), "line_number"),
    "one_log_clean": lambda s, d: clean.clean(_one_log_entries(s, d)).select("source", "ord", "command"),
    "one_log_sequences": _q_one_log_sequences,
    "command_counts": lambda s, d: frequency.count_commands(_cleaned(s, d)).select("key", "count", "last_used"),
    "sequence_counts": lambda s, d: frequency.count_sequences(_cleaned(s, d)).select("key", "count", "last_used", "window"),
    "merged_counts": lambda s, d: frequency.merged_counts(_cleaned(s, d)).select("key", "count", "kind"),
    "merged_counts_all": lambda s, d: frequency.merged_counts(_cleaned(s, d)).select("key", "count", "kind"),  # its name of an earlier release
    "totals": lambda s, d: totals(_cleaned(s, d)),
    "near_pairs": lambda s, d: frequency.near_pairs(frequency.count_commands(_parts(s, d)).withColumn("rank", frequency.rank())).select("low", "high"),
    "similar_groups": lambda s, d: frequency.group_similar(frequency.count_commands(_parts(s, d))).select("pattern", "frequency", F.array_join("variations", "|").alias("variations")),
    "analyze_frequency": lambda s, d: frequency.analyze_frequency(_cleaned(s, d)).select("pattern", "frequency", "last_used", F.array_join("variations", "|").alias("variations")),
    "safety_alerts": lambda s, d: safety.safety_alerts(_commands(s, d)),
    "dangerous_commands": lambda s, d: safety.dangerous_commands(_commands(s, d)),
    "tokens": lambda s, d: _parts(s, d).select("ord", F.array_join(T.tokenize(F.col("command")), " ").alias("tokens")),
    "command_stats": lambda s, d: command_stats(_parts(s, d)).select("command", "frequency", "line_number"),
    "search": lambda s, d: search(_parts(s, d), _SEARCHED, 10).select("command", "score", "frequency", "line_number"),
    "search_typo": lambda s, d: search(_parts(s, d), "stell", 10).select("command", "score", "frequency", "line_number"),
    "search_indexed": lambda s, d: _search_indexed(s, d, _SEARCHED),
    "search_indexed_typo": lambda s, d: _search_indexed(s, d, "stell"),
    "scores": _q_scores,
    "scalars": _q_scalars,
    "scrub_kinds": _q_scrub_kinds,
    "clean_noise": lambda s, d: clean.clean(_noisy(s, d)).select("source", "ord", "command"),
    "sniff_kinds": _q_sniff_kinds,
    "assemble_continued": _q_assemble_continued,
    "suggested_commands": _q_suggested_commands,
    "single_suggestions": _q_single_suggestions,
    "single_alerts": _q_single_alerts,
    "scrub_lines": _q_scrub_lines,
    "parse_suggestions": _q_parse_suggestions,
    "parse_alerts": _q_parse_alerts,
    "alert_suggestions": _q_alert_suggestions,
    "selected": lambda s, d: responses.selected(_reviewed(s, d)),
    "review_counts": lambda s, d: responses.review_counts(_reviewed(s, d)),
}


def _search_sql(query: str, tokens: list[str]) -> str:
    q = "[" + ", ".join(_quote(t) for t in tokens) + "]"
    n = float(len(tokens))
    return rf"""WITH e AS (SELECT p_partkey AS ord, p_name || ' ' || p_type AS command FROM part),
s AS (SELECT command, count(*) AS frequency, CAST(max(ord) AS INTEGER) AS line_number, min(ord) AS first, {_TOKENS} AS t FROM e GROUP BY command),
m AS (SELECT greatest(max(frequency), 1) AS most FROM s),
p AS (SELECT s.*, most, list_filter({q}, lambda x: NOT list_contains(t, x)) AS missing FROM s, m),
x AS (SELECT *, len(list_filter({q}, lambda x: list_contains(t, x))) / {n} AS exact,
 CASE WHEN len(missing) = 0 THEN 1.0 ELSE len(list_filter(missing, lambda x: len(list_filter(t, lambda y: abs(length(y) - length(x)) <= 2 AND levenshtein(y, x) <= 2)) > 0)) / {n} END AS fuzzy,
 CASE WHEN contains(lower(command), {_quote(query.lower())}) THEN 1.0 ELSE len(list_filter({q}, lambda x: len(list_filter(t, lambda y: starts_with(y, x) OR starts_with(x, y))) > 0)) / {n} END AS sub,
 CASE WHEN most <= 1 THEN 0.0 ELSE ln(1 + frequency) / ln(1 + most) END AS freq FROM p),
y AS (SELECT *, CAST(0.5 AS DOUBLE) * exact + CAST(0.2 AS DOUBLE) * fuzzy + CAST(0.2 AS DOUBLE) * sub + CAST(0.05 AS DOUBLE) * freq + CAST(0.05 AS DOUBLE) * CAST(0 AS DOUBLE) AS score FROM x)
SELECT command, floor(score * 1000 + CAST(0.5 AS DOUBLE)) / CAST(1000 AS DOUBLE) AS score, frequency, line_number FROM y WHERE score >= 0.05 ORDER BY 2 DESC, frequency DESC, first LIMIT 10"""


def _sequences_sql(longest: int) -> str:
    joined = lambda w: " || ' && ' || ".join(["command", *[f"lead(command, {k}) OVER x" for k in range(1, w)]])
    parts = [f"SELECT source, ord, {joined(w)} AS key, lead(ts, {w - 1}) OVER x AS used, {w} AS w, lead(command, {w - 1}) OVER x AS z FROM k WINDOW x AS (PARTITION BY source ORDER BY ord)" for w in range(2, longest + 1)]
    return "(SELECT * FROM (" + " UNION ALL ".join(f"({p})" for p in parts) + ") WHERE z IS NOT NULL)"


_SQL: dict[str, str] = {
    "frequency_top": f"WITH {_CLEAN} SELECT command AS pattern, count(*) AS frequency, max(ts) AS last_used FROM k GROUP BY command HAVING count(*) >= 5 ORDER BY 2 DESC, 3 DESC, min((source, ord)) LIMIT 20",
    "entries": f"WITH {_ENTRIES} SELECT source, ord, command, ts AS timestamp FROM e",
    "clean_entries": f"WITH {_CLEAN} SELECT source, ord, command FROM k",
    "document_lines": f"WITH {_LINES} SELECT source, CAST(n_lines AS INTEGER) AS n_lines, CAST(line_idx AS INTEGER) AS line_idx, raw FROM l",
    "tail_lines": f"WITH {_LINES} SELECT source, CAST(line_idx - greatest(n_lines - 100, 0) + 1 AS INTEGER) AS line_number, raw FROM l WHERE line_idx >= n_lines - 100",
    "assemble_plain": r"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS source, 3 * i - 1 AS ord, 'run ' || o_orderpriority || ' ' || chr(10) || '  --status ' || o_orderstatus AS command, CAST('1' || strftime(o_orderdate, '%Y%m%d') AS BIGINT) AS epoch, CAST(3 * i - 1 AS INTEGER) AS line_number FROM o""",
    "assemble_extended": r"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS source, 2 * i - 2 AS ord, 'ship ' || o_orderstatus AS command, CAST('1' || strftime(o_orderdate, '%Y%m%d') AS BIGINT) AS epoch, CAST(2 * i - 1 AS INTEGER) AS line_number FROM o
UNION ALL SELECT CAST(o_custkey AS VARCHAR), 2 * i - 1, 'note ' || o_orderpriority, NULL, CAST(2 * i AS INTEGER) FROM o""",
    "assemble_documents": rf"WITH {_LINES} SELECT source, line_idx AS ord, trim(raw, {_WHITE}) AS command, CAST(line_idx + 1 AS INTEGER) AS line_number FROM l WHERE trim(raw, {_WHITE}) <> ''",
    "format_sniff": "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS source FROM orders",
    "one_log_lines": f"WITH {_ONE_LOG} SELECT 'all' AS source, (SELECT count(*) FROM l) AS n_lines, i AS line_idx, raw FROM l",
    "one_log_entries": f"WITH {_ONE_LOG} SELECT source, ord, command, epoch, line_number FROM o",
    "one_log_clean": f"WITH {_ONE_LOG_CLEAN} SELECT source, ord, command FROM k2",
    "one_log_sequences": f"WITH {_ONE_LOG_CLEAN} SELECT md5(key) AS key, count(*) AS count, max(used) AS last_used, CAST(min(w) AS INTEGER) AS \"window\" FROM {_sequences_sql(5).replace('FROM k WINDOW', 'FROM k2 WINDOW')} GROUP BY key",
    "command_counts": f"WITH {_CLEAN} SELECT command AS key, count(*) AS count, max(ts) AS last_used FROM k GROUP BY command",
    "sequence_counts": f"WITH {_CLEAN} SELECT key, count(*) AS count, max(used) AS last_used, CAST(min(w) AS INTEGER) AS \"window\" FROM {_sequences_sql(5)} GROUP BY key",
    "merged_counts": f"WITH {_CLEAN} SELECT command AS key, count(*) AS count, 0 AS kind FROM k GROUP BY command UNION ALL SELECT key, count(*), 1 FROM {_sequences_sql(5)} WHERE key NOT IN (SELECT command FROM k) GROUP BY key",
    "totals": f"WITH {_CLEAN} SELECT count(*) AS total_commands, count(DISTINCT command) AS unique_commands FROM k",
    "near_pairs": "WITH c AS (SELECT p_name || ' ' || p_type AS key, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, f) AS i FROM c) SELECT a.key AS low, b.key AS high FROM r a, r b WHERE a.i < b.i AND abs(length(a.key) - length(b.key)) <= 3 AND levenshtein(a.key, b.key) <= 3",
    "safety_alerts": f"WITH {_HITS}, {_RULES} SELECT command AS pattern, count(*) AS frequency, risk, safer_alternative, rule_name FROM h JOIN r USING (rule) GROUP BY ALL",
    "dangerous_commands": f"WITH {_HITS} SELECT DISTINCT command AS pattern FROM h",
    "tokens": f"WITH e AS (SELECT p_partkey AS ord, p_name || ' ' || p_type AS command FROM part) SELECT ord, array_to_string({_TOKENS}, ' ') AS tokens FROM e",
    "command_stats": "SELECT p_name || ' ' || p_type AS command, count(*) AS frequency, CAST(max(p_partkey) AS INTEGER) AS line_number FROM part GROUP BY 1",
    "search": _search_sql("almond steel", ["almond", "steel"]),
    "search_typo": _search_sql("stell", ["stell"]),
    "search_indexed": _search_sql(_SEARCHED, ["almond", "steel"]),
    "search_indexed_typo": _search_sql("stell", ["stell"]),
    "scores": "WITH s AS (SELECT event_type AS command, count(*) AS frequency, max(ts) AS u FROM events GROUP BY 1), m AS (SELECT max(frequency) AS most, max(u) AS newest FROM s) SELECT command, frequency, round(CASE WHEN most <= 1 THEN 0 ELSE ln(1 + frequency) / ln(1 + most) END, 9) AS frequency_score, round(CASE WHEN epoch_ms(newest) - epoch_ms(u) <= 0 THEN 1 ELSE greatest(0.0, 1 - (epoch_ms(newest) - epoch_ms(u)) / 2592000000.0) END, 9) AS recency_score FROM s, m",
    "scalars": r"""SELECT p_partkey, upper(p_name[1]) || p_name[2:] AS capital, CASE WHEN length(p_name) <= 12 THEN p_name ELSE p_name[1:9] || '...' END AS short, p_name || '\|\` ' || p_name AS escaped, CAST(CAST(floor(p_size / CAST(1000 AS DOUBLE) * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS VARCHAR) || '%' AS percent, floor(p_retailprice / CAST(7 AS DOUBLE) * 1000 + CAST(0.5 AS DOUBLE)) / CAST(1000 AS DOUBLE) AS rounded, format('{:,}', p_partkey * 1237) AS thousands, strftime(make_timestamp(p_partkey * 98765431 * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM part""",
    "scrub_kinds": "SELECT p_partkey, CAST(kind AS INTEGER) AS kind, replace(kept, '{n}', lpad(CAST(p_partkey AS VARCHAR), 7, '0')) AS raw, CAST(CASE WHEN kind < 17 THEN 1 ELSE 0 END AS INTEGER) AS redacted_count FROM part, (VALUES " + ", ".join(f"({k}, {_quote(b)})" for k, (_, b) in enumerate(_SECRETS)) + ") AS t(kind, kept)",
    "clean_noise": """WITH e AS (SELECT CAST(o_custkey AS VARCHAR) AS source, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord, CASE o_orderkey % 10 WHEN 2 THEN 'git status' WHEN 5 THEN 'git status' WHEN 6 THEN 'npm test' WHEN 9 THEN 'npm test' WHEN 7 THEN 'ls -la' END AS command FROM orders)
SELECT source, ord, command FROM (SELECT *, lag(command) OVER (PARTITION BY source ORDER BY ord) AS b FROM e WHERE command IS NOT NULL) WHERE b IS NULL OR b <> command""",
    "sniff_kinds": "SELECT CAST(c_custkey AS VARCHAR) AS source FROM customer WHERE c_custkey % 5 IN (0, 3, 4)",
    "assemble_continued": r"""WITH o AS (SELECT *, o_orderkey % 4 AS k, CAST(o_custkey AS VARCHAR) AS source, strftime(o_orderdate, '%Y%m%d') AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders)
SELECT source, 2 * i - 1 AS ord, 'ship ' || chr(10) || '  more ' || o_orderstatus AS command, CAST('1' || day AS BIGINT) AS epoch, CAST(2 * i - 1 AS INTEGER) AS line_number FROM o WHERE k = 0
UNION ALL SELECT source, 2 * i - 2, ': 1' || day || ':0;a' || chr(13) || 'b', NULL, CAST(2 * i - 1 AS INTEGER) FROM o WHERE k = 1
UNION ALL SELECT source, 2 * i - 2, 'ship ' || o_orderstatus, CAST('1' || day AS BIGINT), CAST(2 * i - 1 AS INTEGER) FROM o WHERE k > 1
UNION ALL SELECT source, 2 * i - 1, 'note ' || o_orderpriority || CASE WHEN k = 3 THEN ' \' ELSE '' END, NULL, CAST(2 * i AS INTEGER) FROM o WHERE k > 0""",
    "similar_groups": _groups_sql("m AS (SELECT p_name || ' ' || p_type AS key, count(*) AS n, NULL AS used, 0 AS kind, 1 AS w, min(p_partkey) AS first FROM part GROUP BY 1)") + " SELECT pattern, frequency, variations FROM g",
    "analyze_frequency": _groups_sql(f"{_CLEAN}, c AS (SELECT command AS key, count(*) AS n, max(ts) AS used, 0 AS kind, 1 AS w, min((source, ord)) AS first FROM k GROUP BY command), q AS (SELECT key, count(*) AS n, max(used) AS used, 1 AS kind, min(w) AS w, min((source, ord)) AS first FROM {_sequences_sql(5)} GROUP BY key), m AS (SELECT * FROM c UNION ALL SELECT * FROM q WHERE key NOT IN (SELECT key FROM c))") + " SELECT pattern, frequency, used AS last_used, variations FROM g WHERE frequency >= 5 ORDER BY frequency DESC, used DESC NULLS LAST, i LIMIT 20",
    "parse_suggestions": _PARSED_SUGGESTIONS,
    "parse_alerts": _PARSED_ALERTS,
    "suggested_commands": _SUGGESTED_COMMANDS,
    "single_suggestions": _SINGLE_SUGGESTIONS,
    "single_alerts": _SINGLE_ALERTS,
    "alert_suggestions": f"WITH {_HITS}, {_RULES} SELECT DISTINCT command AS pattern, 'function' AS type, safer_alternative AS code, 'safe-' || split_part(command, ' ', 1) AS name, 'Safety improvement: ' || risk AS explanation, 'warning' AS safety FROM h JOIN r USING (rule)",
    "selected": "SELECT p_partkey, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS code FROM part WHERE p_partkey % 3 = 0",
    "review_counts": "SELECT count(*) FILTER (WHERE p_partkey % 3 <> 2) AS reviewed, count(*) FILTER (WHERE p_partkey % 3 = 0) AS to_apply, count(*) FILTER (WHERE p_partkey % 3 = 1) AS ignored FROM part",
}


_SQL["merged_counts_all"] = _SQL["merged_counts"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

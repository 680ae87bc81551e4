"""The stored index against scoring every command."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from loomlog import cli
from loomlog.operators.search import search
from loomlog.operators.search_index import build_index, matched_tokens, search_index
from loomlog.session import shared_folder

SCHEMA = "source string, ord long, command string, timestamp timestamp, line_number int"
WORDS = ["git", "commit", "comit", "push", "docker", "run", "rn", "npm", "test", "tests", "-m", "--all", "😀é", "stash", "a", "/usr/bin", "x=y"]
QUERIES = ["git", "it", "git commit", "comm", "gti push", "docker-run", "😀", "é", "test tests test", " npm ", "--all", "zzzzzzzz", "", "  ", "--", "Git COMMIT -m", "usr/bin", "in x", "a"]


def _entries(spark, n, times):
    rng = random.Random(n + times)
    rows = []
    for i in range(n):
        when = None if times == 0 or rng.random() < 0.2 else datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=rng.randint(0, 900))
        command = " ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 1, 2, 3, 5])))
        rows.append((rng.choice("st"), i, command.capitalize() if rng.random() < 0.1 else command, when, i + 1))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(("n", "times"), [(400, 1), (60, 0)])
def test_same_rows_as_search(spark, n, times):
    entries = _entries(spark, n, times).cache()
    path = shared_folder(spark, "index")
    build_index(entries, path, buckets=5)
    for i, query in enumerate(QUERIES[:: 1 if times else 3]):
        k = (3, 500)[i % 2]
        want = [tuple(r) for r in search(entries, query, k).collect()]
        assert [tuple(r) for r in search_index(spark, path, query, k).collect()] == want, (query, k)


def test_many_query_tokens(spark):
    entries = _entries(spark, 50, 1)
    path = shared_folder(spark, "index")
    build_index(entries, path, buckets=2)
    query = " ".join(["git", "tset", "doc"] * 25)
    assert [tuple(r) for r in search_index(spark, path, query).collect()] == [tuple(r) for r in search(entries, query).collect()]


def test_empty_history(spark):
    entries = spark.createDataFrame([], SCHEMA)
    path = shared_folder(spark, "index")
    build_index(entries, path)
    assert search_index(spark, path, "git").collect() == [] and search_index(spark, path, "").columns == search(entries, "git").columns


def test_few_tokens_match(spark):
    tokens = spark.createDataFrame([(0, t) for t in ["git", "legit", "gi", "gut", "commit", "zebra"]], "bucket int, token string")
    assert {r.token for r in matched_tokens(tokens, "git").select("token").collect()} == {"git", "legit", "gi", "gut"}
    assert matched_tokens(tokens, "qqqqqqqq").select(F.count("*")).first()[0] == 0


def test_index_of_a_history(spark, tmp_path, capsys):
    log, folder = tmp_path / "log", str(tmp_path / "index")
    log.write_text("git status\nnpm test\ngit push\n")
    assert cli.main(["index", folder, "--history-file", str(log), "--shell", "bash"]) == 0 and folder in capsys.readouterr().out
    assert cli.main(["search", "psh", "--index", folder, "--format", "json"]) == 0
    by_index = capsys.readouterr().out
    assert cli.main(["search", "psh", "--history-file", str(log), "--shell", "bash", "--format", "json"]) == 0
    assert capsys.readouterr().out == by_index and "git push" in by_index

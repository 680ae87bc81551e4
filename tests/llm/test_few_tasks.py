"""Short tables take few tasks, however many partitions a shuffle has; long ones are dealt over more, with the same result."""

import contextlib
import random

import pytest
from test_components import brute
from test_near_dedup import check, text

from loomlog import session
from loomlog.llm.components import components

PARTITIONS = 40


@contextlib.contextmanager
def many_partitions(spark):
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"]
    before = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, (str(PARTITIONS), "false")):
            spark.conf.set(n, v)
        yield
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)


def tasks_of(spark, run):
    sc = spark.sparkContext
    group = f"few-tasks-{random.random()}"
    sc.setJobGroup(group, "")
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}
    found = [sc.statusTracker().getStageInfo(s) for s in stages]
    return sum(s.numCompletedTasks for s in found if s)


def graph():
    rng = random.Random(3)
    return [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 200)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]


ROWS = [(k, text(f"a{k % 9}_", {k % 5})) for k in range(60)] + [(100 + k, text(f"b{k}_")) for k in range(10)] + [(200, None), (201, "")]


def test_components_of_few_edges_take_few_tasks(spark):
    edges = spark.createDataFrame(graph(), "u long, v long")
    found = []
    with many_partitions(spark):
        tasks = tasks_of(spark, lambda: found.extend(components(edges).collect()))
    assert {r.node: r.component for r in found} == brute(graph())
    assert tasks < 2 * PARTITIONS  # several shuffles a round made hundreds of them


@pytest.mark.parametrize("rows", [7, 64])
def test_more_rows_take_more_tasks(spark, monkeypatch, rows):
    monkeypatch.setattr(session, "ROWS_A_TASK", rows)
    assert [session.tasks_for(n) for n in (0, rows, rows + 1)] == [1, 1, 2]
    with many_partitions(spark):
        got = {r.node: r.component for r in components(spark.createDataFrame(graph(), "u long, v long")).collect()}
        assert got == brute(graph())
        check(spark, ROWS)

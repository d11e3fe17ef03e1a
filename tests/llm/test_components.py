"""Connected components against a plain union, and what their steps take."""

import uuid

from papyrine.llm.components import components


def plain(edges):
    of = {}

    def top(x):
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        of[b] = a
    return {x: top(x) for x in of}


def tasks_of(spark, run):
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "")
    try:
        found, tracker = run(), sc.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
        infos = [i for i in map(tracker.getStageInfo, stages) if i]
        return found, sum(i.numCompletedTasks for i in infos)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_few_edges_take_few_tasks(spark):
    """However many partitions shuffles have: steps on few edges made a file or more a partition each."""
    edges = [(0, i) for i in range(1, 9)] + [(11, 10), (12, 11), (12, 12), (1, 0)]
    held = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame([*edges, (None, 5)], "a long, b long")
        found, tasks = tasks_of(spark, lambda: {r.id: r.component for r in components(df).collect()})
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == plain([e for e in edges if e[0] != e[1]])
    assert tasks < 700, tasks  # 1,014 without a bound

"""Small tables take few tasks, however many partitions a shuffle has, and give what large ones' steps give."""

import contextlib

from tallyframe.llm import jaccard, mixing


@contextlib.contextmanager
def tasks(spark, name, partitions=32):
    """A list that gets the number of tasks of all that runs inside, as planned, with so many partitions a shuffle, however small."""
    conf = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, out = {k: spark.conf.get(k) for k in conf}, []
    for k, v in conf.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup(name, name)
    try:
        yield out
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
        out.append(sum(i.numTasks for i in map(tracker.getStageInfo, stages) if i and i.numCompletedTasks))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
        for k, v in before.items():
            spark.conf.set(k, v)


def test_components_of_few_links(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (102, 101)], "u long, v long")
    with tasks(spark, "components") as ran:
        got = {r["id"]: r["component"] for r in jaccard.components(chain).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100, 102: 100}
    assert ran[0] < 8 * 32


def test_mixing_of_few_cells(spark):
    docs = spark.createDataFrame([(k, f"t{k % 7} " * (k % 50), ("en", "fr", None)[k % 3], f"s{k % 5}") for k in range(400)], "doc_id long, text string, lang string, source string")
    with tasks(spark, "mixing") as ran:
        got = mixing.mix(docs, rounds=2).collect()
    assert len(got) == 400 and ran[0] < 12 * 32


def documents(spark):
    """Two families of near copies of long texts, with edits that add up; short texts; texts alone."""
    rows = [(k, " ".join(f"b{k % 2}w{j if (j * 7 + k) % 97 else -k}" for j in range(150))) for k in range(24)]
    rows += [(100 + k, f"a short text of few words {k % 3}") for k in range(9)] + [(200 + k, " ".join(f"own{k}w{j}" for j in range(60))) for k in range(6)]
    return spark.createDataFrame([*rows, (300, None)], "doc_id long, text string").repartition(3)


def test_large_tables_steps_give_the_same(spark, monkeypatch):
    """The steps of large tables, which small ones do without: keys and sets in parts, sets shuffled, links followed over exchanges."""

    def classes():
        return {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_classes(documents(spark), (80, 100)).collect()}

    small = classes()
    assert 1 < len({small[k] for k in range(24)}) < 24
    monkeypatch.setattr(jaccard, "PART_KEYS", 1)
    monkeypatch.setattr(jaccard, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(jaccard, "TOGETHER", 0)
    assert classes() == small

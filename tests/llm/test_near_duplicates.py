import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from causeway.llm import components
from causeway.llm import ngram_join as J
from causeway.llm.components import connected_components

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, width=5, num=80, den=100):
    """{id: (set size, component)} by comparing all sets that share an n-gram."""
    sets = {}
    for i, t in rows:
        w = WORDS.findall((t or "").encode().lower())
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for g in sets[i] for j in holders[g])
        for j, n in shared.items():
            if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
        for g in sets[i]:
            holders[g].append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus(seed, n=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(30)]
    rows, base = [], [word() for _ in range(80)]
    for i in range(n):
        kind = rng.random()
        if kind < 0.3:
            w = [word() for _ in range(rng.randint(0, 60))]
        elif kind < 0.5:
            w = [word() for _ in range(40)] + passage
        elif kind < 0.6:
            w = list(base)
        else:
            w = list(base)
            for _ in range(rng.randint(1, 5)):
                w[rng.randrange(len(w))] = word()
            base = w if rng.random() < 0.3 else base
        rows.append((i, " ".join(w)))
    return rows


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert result(J.near_classes(docs)) == brute(rows)


def test_split_groups_give_the_same_components(spark):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(J.near_classes(docs, unit_size=400)) == brute(rows)


def test_threshold_is_met_exactly(spark):
    a = [f"a{i}" for i in range(13)]          # 9 shingles
    b = a[:12] + ["z"]                        # 8 shared of 10: exactly 0.8
    c = a[:11] + ["y", "x"]                   # 7 shared of 11 with a
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))]
    got = result(J.near_classes(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[2][1] == 1 and got[3][1] == 3


def test_link_sets_equals_all_pairs():
    rng = np.random.default_rng(4)
    for _ in range(20):
        base = rng.integers(0, 60, 40).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(40) < 0.9], rng.integers(0, 80, 4).astype(np.uint64)])) for _ in range(25)]
        found = J.link_sets(sets, 80, 100)
        up = list(range(len(sets)))

        def root(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for i in range(len(sets)):
            for j in range(i):
                if J.links(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), 80, 100):
                    up[max(root(i), root(j))] = min(root(i), root(j))
        own = list(range(len(sets)))

        def own_root(x, own=own):
            while own[x] != x:
                x = own[x]
            return x

        for a, b in found:
            assert J.links(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]), 80, 100)
            own[max(own_root(a), own_root(b))] = min(own_root(a), own_root(b))
        assert [root(i) for i in range(len(sets))] == [own_root(i) for i in range(len(sets))]


def test_edge_rows(spark, edge_docs, clashing, no_docs):
    got = sorted(J.near_classes(edge_docs).drop("key").collect(), key=str)
    assert got == sorted(J.near_classes(clashing).drop("key").collect(), key=str)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.n_shingles, r.component_id))
    assert by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[3] == {(0, 3)}
    assert by[4] == by[5] == by[None] == {(11, 4)}
    assert by[6] == {(1, 6)} and by[7] == {(1, 7)}
    assert len(got) == 10
    assert J.near_classes(no_docs).count() == 0
    kept = Counter(r.doc_id for r in J.keep_one(edge_docs).collect())
    assert kept == Counter({1: 1, 2: 1, 3: 1, 4: 1, 6: 1, 7: 1, 8: 1, None: 1})
    assert J.keep_one(clashing).columns == clashing.columns


def test_connected_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, x) for x in range(201, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)]
    edges += [(-5, 7), (500, 500), (7, -5)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    df = spark.createDataFrame([(a, b) for a, b in edges] + [(None, 3)], "a long, b long").repartition(6)
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert got == {x: root(x) for x in up if root(x) != x}
    assert connected_components(df.filter(F.lit(False))).count() == 0


def test_components_that_share_their_smallest_id_keep_a_row_each(spark):
    one, two = "the cat sat on the mat and looked at the moon", "a quiet river runs past seven old mills in the north"
    rows = [(1, one), (2, one), (1, two), (3, two), (3, "one text of its own with other words in it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in J.keep_one(docs).collect()) == sorted([rows[0], rows[2], rows[4]])


def chained_python_steps(plan, above=False):
    """Python steps that stand right above another in the same stage of a physical plan."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return chained_python_steps(plan.executedPlan(), above)
    if "Exchange" in name:
        above = False
    own = name.startswith("MapInArrow")
    below = plan.children()
    return int(own and above) + sum(chained_python_steps(below.apply(i), own or above) for i in range(below.size()))


def test_a_task_holds_one_python_worker(spark, monkeypatch):
    found = []

    def watched(df, name, write=components.write_shared):
        found.append((name, chained_python_steps(df._jdf.queryExecution().executedPlan())))
        return write(df, name)

    monkeypatch.setattr(components, "write_shared", watched)
    monkeypatch.setattr(J, "write_shared", watched)
    rows = corpus(8, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(J.near_classes(docs, unit_size=400)) == brute(rows)
    assert {name for name, _ in found} >= {"classes", "edges", "groups", "members"}
    assert [x for x in found if x[1]] == []


def test_connected_components_of_edges_that_are_found(spark):
    def find(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("x"), pa.array([7 * (x // 7) for x in batch.column("x").to_pylist()], pa.int64())], ["a", "b"])

    df = spark.range(50).withColumnRenamed("id", "x").repartition(4)
    assert {r.node: r.root for r in connected_components(df, find).collect()} == {x: 7 * (x // 7) for x in range(50) if x % 7}
    assert connected_components(df.filter(F.lit(False)), find).count() == 0


def test_tables_between_steps_are_written_in_few_files(spark, monkeypatch):
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, files = {k: spark.conf.get(k) for k in held}, []

    def watched(df, name, write=components.write_shared):
        out = write(df, name)
        files.append((name, len(out.inputFiles())))
        return out

    monkeypatch.setattr(components, "write_shared", watched)
    monkeypatch.setattr(J, "write_shared", watched)
    rows = corpus(9, 60)
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
        assert result(J.near_classes(docs)) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {name for name, _ in files} == {"classes", "representatives", "edges", "groups", "members"}
    assert [x for x in files if x[1] > 40 // 16] == []

"""Staged tables of nested and of concurrent scratches."""

import os
import tracemalloc
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from paneleffects.llm import katz, regions, tasks  # noqa: E402
from paneleffects.llm.components import components
from paneleffects.llm.line_dedup import Edits
from paneleffects.llm.tasks import outlive, scratch, stage
from paneleffects.llm.text import chunks
from paneleffects.sources.stages import stage_folder


def test_scratches_remove_their_own_tables(spark):
    folder = stage_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    df = spark.range(5)
    with scratch(spark):
        with scratch(spark):
            inner = stage(df, "inner")
            kept = outlive(df, "kept")
        assert kept.count() == 5 and {f.split("-")[0] for f in set(os.listdir(folder)) - before} == {"kept"}
        assert inner is not None
    assert set(os.listdir(folder)) == before

    def work(k):
        with scratch(spark):
            mine = stage(spark.range(k), "mine")
            return mine.count()

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(work, range(8))) == list(range(8))
    assert set(os.listdir(folder)) == before


def test_lean_tasks_give_memory_back(monkeypatch):
    """At the end of a task, also of one that fails, and not before."""
    given = []
    monkeypatch.setattr(tasks, "give_back", lambda: given.append(1))
    task = tasks.lean(lambda batches: (1 // b for b in batches))
    out = task(iter([1, 1]))
    assert next(out) == 1 and not given
    assert list(out) == [1] and len(given) == 1
    try:
        list(task(iter([0])))
    except ZeroDivisionError:
        assert len(given) == 2
    monkeypatch.undo()
    tasks.give_back()


def test_chunks_hold_no_copy_of_their_batch():
    texts = ["word " * 2000] * 1000 + [None, "", "x" * 3_000_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    held = pa.total_allocated_bytes()
    seen, most = [], 0
    for c in chunks(batch):
        most = max(most, pa.total_allocated_bytes() - held)
        seen += c.column("text").to_pylist()
    assert seen == texts and most < 1 << 20


def test_labels_of_few_nodes_are_written_in_few_files(spark):
    """Chains and a star, under many shuffle partitions that are not put together."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        with scratch(spark):
            pairs = [(i + 1, i) for i in range(300) if i % 50] + [(1000, 1000 + k) for k in range(1, 200)] + [(7, 7)]
            got = components(stage(spark.createDataFrame(pairs, "a bigint, b bigint"), "links"))
            assert len(got.inputFiles()) <= 16
            found = {r.node: r.root for r in got.collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    want = {}
    for a, b in pairs:
        for x in (a, b):
            want[x] = 1000 if x >= 1000 else max((x - 1) // 50 * 50 + 1, 1)
    assert found == want


def _leaf_pairs(key: int, listed: list[list[int]]) -> list[tuple[int, int]]:
    """Pairs put out for one region of items that are alike, each of a component of its own."""
    n = len(listed)
    batch = pa.RecordBatch.from_pydict({
        "key": [key] * n, "class": list(range(n)), "root": list(range(n)), "n": [40] * n,
        "far": [regions.far_vector(np.zeros(0, np.int64))] * n, "first": pa.array(listed, pa.list_(pa.int64())),
        "cell": [0] * n, "tile": [0] * n, "side": [0] * n})
    return [p for b in regions._leaf(Edits())(iter([batch])) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]


def test_pairs_of_several_regions_are_put_out_once():
    """Items 0 and 1 list three regions both are in; 0 and 2 share none that both list, so each region tells of them."""
    listed = [[-5, 3, 8], [-5, 3, 8], [-9, -8, -7]]
    out = {key: _leaf_pairs(key, listed[:2]) for key in (-5, 3, 8)}
    assert out == {-5: [(0, 1)], 3: [], 8: []}
    for key in (11, 40):
        assert (0, 2) in _leaf_pairs(key, listed)


def test_katz_tasks_hold_little_beside_their_block(monkeypatch):
    """Counting and asking take few bytes a token, put a block out in parts, and leave out nothing."""
    rng = np.random.default_rng(4)
    words = np.array([f"w{i}" for i in range(100_000)])
    texts = [" ".join(words[(rng.pareto(0.6, 2000) * 20).astype(np.int64) % len(words)]) for _ in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    prints, doc = katz.tokens_of(batch)
    key, n = np.unique(prints, return_counts=True)
    v = katz.Vocabulary(key[n > 20], n[n > 20], len(prints), len(key), katz.good_turing(np.zeros(7)), 0.1, 1.0)
    known, buckets = SimpleNamespace(value=v), 40
    model = SimpleNamespace(value=katz.Pairs.of(katz.good_turing(np.zeros(7)), np.zeros((v.begin + 1, 7))))
    hot = SimpleNamespace(value=(np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    monkeypatch.setattr(katz, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))

    def rows(run):
        """The task's rows, its most memory in bytes a token, and its largest batch's share of what it puts out."""
        tracemalloc.start()
        out = list(run(iter([batch])))
        _, most = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        sizes = [b.nbytes for b in out]
        return pa.Table.from_batches(out).to_pylist(), most / len(prints), max(sizes) / sum(sizes)

    got, most, share = rows(katz._count_words(buckets))
    assert most < 30 and share < 0.2, (most, share)
    count = np.concatenate([katz.unpack(r["counts"], np.int64) for r in got])
    found = np.concatenate([katz.unpack_sorted(r["keys"]) for r in got])
    assert (np.sort(found) == key).all() and (count[np.argsort(found)] == n).all()
    got, most, share = rows(katz._count_pairs(known, buckets))
    assert most < 35 and share < 0.2, (most, share)
    assert sum(katz.unpack(r["counts"], np.int64).sum() for r in got) == len(prints)
    got, most, share = rows(katz._ask(known, model, hot, buckets))
    assert most < 60 and share < 0.2, (most, share)
    h, w = katz._pairs(v.code(prints), doc, v.begin)
    for kind, of in (katz.PAIR, katz._pair_key(h, w)), (katz.WORD, prints[w >= katz._NUMBERS]):
        own = doc if kind == katz.PAIR else doc[w >= katz._NUMBERS]
        want, n = np.unique(np.rec.fromarrays([of, own]), return_counts=True)
        found = [r for r in got if r["kind"] == kind]
        columns = [np.concatenate([f(r) for r in found]) for f in (
            lambda r: katz.unpack_sorted(r["keys"]), lambda r: katz.unpack(r["docs"], np.uint32), lambda r: katz.unpack(r["counts"], np.uint32))]
        order = np.lexsort(columns[1::-1])
        assert (columns[0][order] == want.f0).all() and (columns[1][order] == want.f1).all() and (columns[2][order] == n).all()

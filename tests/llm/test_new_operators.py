"""Radix deduplication, delta rounds and infilling by their own interfaces."""

import collections

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cinesieve.llm import clusters, exact, infill
from tests.llm import brute


@settings(deadline=None, max_examples=80)
@given(st.lists(st.sampled_from([b"", b"a", b"a" * 64, b"a" * 65, b"a" * 576, b"a" * 577, b"a" * 575 + b"b", b"b" * 5000, b"b" * 4999, b"b" * 4999 + b"c"]), max_size=30))
def test_radix_partition_is_equality(texts):
    wanted = {}
    for i, t in enumerate(texts):
        wanted.setdefault(t, []).append(i)
    assert sorted(exact.equal(texts)) == sorted(wanted.values())


def test_digits_follow_one_another():
    depths = exact._depths(1 << 21)
    assert depths[:4] == [0, 64, 576, 4672] and all(exact.width(a) == b - a for a, b in zip(depths, depths[1:], strict=False))


@pytest.mark.parametrize("broadcast", [exact.BROADCAST, -1])
def test_heavy_groups_are_split_by_further_digits(spark, monkeypatch, broadcast):
    for name, value in {"LEAST": 2000, "MOST": 2000, "FEW": 3, "WINDOW": 4000, "ROWS": 10, "BROADCAST": broadcast}.items():
        monkeypatch.setattr(exact, name, value)
    header = "This text is free for all to use. " * 30
    texts = [f"{header}{i % 40}" for i in range(300)] + ["copied " * 900] * 120 + [""] * 150 + [None] * 20 + [f"short {i}" for i in range(200)] + [f"{header}{i} {header * 5}END" for i in range(8)] * 5 + ["COPIED " * 900]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, "copied " * 900)] * 2 + [(None, "")] * 2 + [(None, "alone")] * 2 + [(9999, "twice")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    trie = []
    monkeypatch.setattr(exact, "staged", lambda df, label, staged=exact.staged: (out := staged(df, label), trie.append(out.count()) if label == "trie" else None)[0])
    got = exact.classes(docs).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(brute.hashlib.sha256(brute.lower(t or "").encode()).hexdigest(), []).append(i)
    assert len(trie) >= 3 and trie[0] and trie[1]
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text_sha256) for r in got) == sorted((-1 if i is None else i, d) for d, own in groups.items() for i in own)
    for r in got:
        own = [i for i in groups[r.text_sha256] if i is not None]
        assert (r.keep_id, r.group_size) == (max(own, default=None), len(groups[r.text_sha256])) and (not r.kept or r.doc_id == r.keep_id)
    kept = [r.text_sha256 for r in got if r.kept]
    assert sorted(kept) == sorted(groups)


def test_windows_make_one_row_of_copies(spark):
    docs = spark.createDataFrame([(i, "a hot text") for i in range(5000)], "id long, text string").coalesce(1)
    assert [len(r.ids) for r in docs.mapInArrow(exact._collapse, exact.COLLAPSED).collect()] == [5000]


@settings(deadline=None, max_examples=150)
@given(st.integers(0, 10_000), st.integers(1, 6), st.sampled_from([3, 1 << 20, (1 << 27) - 1]))
def test_a_delta_round_is_a_full_one(seed, k, largest):
    rng = np.random.default_rng(seed)
    v, old, new = rng.integers(-largest, largest + 1, (40, 5)), rng.integers(-largest, largest + 1, (k, 5)), rng.integers(-largest, largest + 1, (k, 5))
    moved = rng.random(k) < 0.5
    new = np.where(moved[:, None], new, old)
    full = lambda c: (lambda d: (d.argmin(axis=1), d.min(axis=1)))(np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for x in v]))
    none = np.full(40, -1)
    first = clusters.reassigned(v, none, np.zeros(40, np.int64), old, np.ones(k, bool))
    assert all((a == b).all() for a, b in zip(first, full(old), strict=True))
    second = clusters.reassigned(v, *first, new, moved)
    assert all((a == b).all() for a, b in zip(second, full(new), strict=True))
    sums = clusters.transferred(v, none, first[0], k) + clusters.transferred(v, first[0], second[0], k)
    assert all((sums[c, :-1] == v[second[0] == c].sum(axis=0)).all() and sums[c, -1] == (second[0] == c).sum() for c in range(k))


def test_rounds_move_vectors_without_a_shuffle(spark, tables):
    found = clusters.cluster(spark.read.parquet(f"{tables}/embeddings.parquet"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("Bucketed: true") == 2


def test_rounds_end_when_no_centroid_moves(spark, tables, monkeypatch):
    written = []
    monkeypatch.setattr(clusters, "_bucketed", lambda df, label, n, of=clusters._bucketed: written.append(label) or of(df, label, n))
    rows = spark.createDataFrame([(i, [float(i // 10)] * 64) for i in range(20)] + [(100, [50.0] * 64)], "vec_id long, embedding array<float>")
    got = clusters.cluster(rows, k=2, rounds=50).collect()
    assert len(written) < 10 and len(got) == 21
    few = clusters.cluster(rows.limit(3), k=8).collect()
    assert len(few) == 3 and sum(r.distance for r in few) == 0


@pytest.mark.parametrize("most", [1, 40, infill.SLICE])
def test_slices_make_no_difference(spark, documents, monkeypatch, most):
    monkeypatch.setattr(infill, "SLICE", most)
    own = [(k, d.text) for k, d in documents.items() if len(d.text or "") < 2000][:60] + [(None, "no id"), (5, "x" * 50), (5, "x" * 50)]
    rows = infill.transform(spark.createDataFrame(own, "doc_id long, text string").withColumn("n", F.lit("?")))
    got = rows.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    wanted = [(k, *brute.infilled("" if k is None else k, t)[0], brute.infilled("" if k is None else k, t)[1], t or "") for k, t in own]
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)


def test_slices_hold_whole_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["aaaa", None, "b" * 30, "", "c", "dd"])], names=["id", "text"])
    parts = list(infill._slices(batch, 10))
    assert sum((p.column(0).to_pylist() for p in parts), []) == list(range(6)) and len(parts) > 1 and list(infill._slices(batch.slice(0, 0), 10)) == []


def test_radix_rounds_join_a_row_while_its_leaf_is_heavy(spark, monkeypatch):
    """A light text is joined to no node, however many rounds a heavy group of long heads takes."""
    monkeypatch.setattr(exact, "LEAST", 1)
    monkeypatch.setattr(exact, "MOST", 20_000)
    texts = [f"light {i} " * 20 for i in range(400)] + ["h" * 5000 + str(i % 30) for i in range(60)] + ["same"] * 9
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    split, made = exact._split, []

    def counting(*args):
        met, light = split(*args)
        made.append((met.count(), light.count()))
        return met, light

    monkeypatch.setattr(exact, "_split", counting)
    monkeypatch.setattr(exact, "WINDOW", 1)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.classes(rows).collect()}
    last, size = {t: i for i, t in enumerate(texts)}, collections.Counter(texts)
    assert got == {i: (last[t], size[t]) for i, t in enumerate(texts)}
    assert len(made) > 2 and all(m + k <= 60 for m, k in made[1:])

"""Every opN query against brute force, over tables with odd rows, and over empty ones."""

import collections
import json

import numpy as np
import pytest

from cinesieve.llm.queries import ORACLE_SQL, QUERIES
from tests import oracle
from tests.llm import brute
from tests.llm.conftest import SF


def query(spark, prefix, folder):
    (f,) = [f for n, f in QUERIES.items() if n.startswith(prefix + "_")]
    return f(spark, folder)


def test_op1_conversations_read_back(spark, tables):
    turns = collections.defaultdict(list)
    for r in spark.read.parquet(f"{tables}/conversations.parquet").collect():
        turns[r.conv_id].append((-1 if r.turn is None else r.turn, r.role, r.text))
    said = "</s>[INST] ok [/INST]"
    turns[-7] = [(0, "user", said), (1, "assistant", said)]
    got = {r.conv_id: tuple(r)[1:5] for r in query(spark, "op1", tables).collect()}
    assert got == {k: brute.conversation(v) for k, v in turns.items()}


def test_op2_secrets(spark, tables, documents):
    rows = query(spark, "op2", tables).collect()
    assert sorted((r.doc_id, *tuple(r)[1:5]) for r in rows) == sorted((k, *brute.secrets(d.text)) for k, d in documents.items())
    assert any("pem:" in r.spans for r in rows) and sum(r.n_assign for r in rows) >= 3


def test_op3_token_counts(spark, tables, documents):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in query(spark, "op3", tables).collect()}
    for k, d in documents.items():
        n = len(brute.ids("byte_bpe_50k.json", d.text))
        assert got[k] == (len((d.text or "").encode()), n, n > 512), d.text
    assert len(got) == len(documents)


def test_op4_shards(spark, tables, documents):
    rows = query(spark, "op4", tables).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        text = (documents[r.doc_id].text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, brute.zlib.crc32(text), "rows", None)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and set(slots) == set(range(16)) and len(rows) == len(documents)


def test_op5_token_files(spark, tables, documents):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in query(spark, "op5", tables).collect()}
    at = 0
    for k in sorted(documents):
        ids = np.append(brute.ids("word_bpe_49k.json", documents[k].text), 2)
        assert got[k] == (at, len(ids), brute.crc(ids)), documents[k].text
        at += len(ids)
    assert len(got) == len(documents)


def test_op6_simhash(spark, tables, documents):
    keys = sorted(documents)
    prints = [brute.fingerprint(documents[k].text) for k in keys]
    roots = brute.components(prints)
    expected = {k: (f"{f:016x}", keys[r]) for k, f, r in zip(keys, prints, roots, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in query(spark, "op6", tables).collect()} == expected


def test_op7_containment(spark, tables, documents):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()}
    expected = {}
    for k, d in documents.items():
        for item, text in items.items():
            shared, n = brute.shared_shingles(text, d.text)
            if n and shared >= 0.8 * n - 1e-9:
                expected[k, item] = (shared, n)
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in query(spark, "op7", tables).collect()}
    assert got == expected and any(k[0] == 20_000 for k in got)


def test_op8_languages(spark, tables, documents):
    rows = {r.doc_id: r for r in query(spark, "op8", tables).collect()}
    assert set(rows) == set(documents)
    known = {d.lang for d in documents.values() if d.lang}
    right = total = 0
    for k, r in rows.items():
        text = documents[k].text
        assert r.held_out == (brute.zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or "")) and r.lang_pred in known | {"und"}
        assert abs(sum(json.loads(r.mixture).values()) - (r.lang_pred != "und")) < 1e-6
        if r.held_out and documents[k].lang and k < 10_000:
            right, total = right + (r.lang_pred == documents[k].lang), total + 1
    assert total > 20 and right / total > 0.95


def test_op9_quality(spark, tables, documents):
    rows = query(spark, "op9", tables).collect()
    assert sorted((r.doc_id, *tuple(r)[1:7]) for r in rows) == sorted((k, *brute.quality(d.text)) for k, d in documents.items())
    assert not any(r.kept and r.base_failed for r in rows) and sum(r.kept for r in rows) > 100


def test_op10_packing(spark, tables, documents):
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    all_ids = {k: np.append(brute.ids("word_bpe_49k.json", d.text), 1) for k, d in documents.items()}
    for r in query(spark, "op10", tables).collect():
        ids = all_ids[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == brute.crc(ids[r.start : r.start + r.length]), documents[r.doc_id].text
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    ends = {}
    for own in (pieces, sequences):
        for k, parts in own.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at and length > 0
                at += length
            ends[id(own), k] = at
    assert all(ends[id(pieces), k] == len(ids) for k, ids in all_ids.items())
    used = [ends[id(sequences), k] for k in sequences]
    padded = [min(2048, 1 << (n - 1).bit_length()) for n in used]
    assert max(used) <= 2048 and sum(used) > 0.97 * sum(padded)


def test_op11_equal_texts(spark, tables, documents):
    groups = collections.defaultdict(list)
    for k, d in documents.items():
        groups[brute.lower(d.text or "")].append(k)
    expected = {k: (max(own), len(own), k == max(own), brute.hashlib.sha256(t.encode()).hexdigest()) for t, own in groups.items() for k in own}
    assert {r.doc_id: tuple(r)[1:] for r in query(spark, "op11", tables).collect()} == expected and any(len(g) > 2 for g in groups.values())


def test_op12_clusters(spark, tables):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()]
    got = sorted(map(tuple, query(spark, "op12", tables).collect()), key=str)
    assert got == sorted(brute.lloyd(rows), key=str) and len(got) == len(rows) - 8


def test_op13_infill(spark, tables, documents):
    sha = lambda t: brute.hashlib.sha256(t.encode()).hexdigest()
    expected = {}
    for k, d in documents.items():
        head, output = brute.infilled(k, d.text)
        expected[k] = (*head, sha(output), sha(d.text or ""))
    assert {r.doc_id: tuple(r)[1:] for r in query(spark, "op13", tables).collect()} == expected
    assert {v[1] for v in expected.values()} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, no_tables, name):
    rows = QUERIES[name](spark, no_tables).collect()
    assert len(rows) == (1 if name.startswith("op1_") else 0)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = oracle.connect(SF)
    assert oracle.spark_rows(QUERIES[name](spark, SF)) == oracle.sql_rows(con, ORACLE_SQL[name])

"""The corpus pipeline against the same decisions made one document at a time."""

import collections
import re

import numpy as np

import corpus_pipeline
from cinesieve.llm import language, secrets
from tests.llm import brute


def masked(text):
    spans = [(m.start(), m.end()) for _, p, g, least in brute.KINDS for m in p.finditer(text) if len(m[g]) >= least]
    spans += [(m.start(), m.end()) for r in secrets.MORE_RULES for m in re.finditer(r.pattern, text)]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + secrets.MASK
        at = max(at, b)
    return out + text[at:]


def expected(documents, items):
    counts = {}
    for k, d in documents.items():
        if brute.zlib.crc32(str(k).encode()) % 5 and d.lang and (n := brute.ngrams(d.text, language.BUCKETS)) is not None:
            own = counts.setdefault(d.lang, np.zeros(language.BUCKETS, np.int64))
            own[list(n)] += list(n.values())
    langs = sorted(counts)
    model = language.Model(langs, np.stack([counts[lang] for lang in langs], axis=1))
    kept = [k for k in sorted(documents) if (found := model.infer(documents[k].text))[0] != "und" and found[2] >= 0.5]
    roots = brute.near_components([documents[k].text for k in kept])
    kept = [k for i, k in enumerate(kept) if roots[i] == i]
    leaks = {k for k in kept if any(n and shared >= 0.8 * n - 1e-9 for shared, n in (brute.shared_shingles(i, documents[k].text) for i in items))}
    return {k: np.append(brute.ids("word_bpe_49k.json", masked(documents[k].text)), 1).tolist() for k in kept if k not in leaks}, leaks


def test_the_stages_are_named():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "packing"]


def test_pipeline_is_the_sum_of_its_decisions(spark, tables, documents):
    items = [r.text for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    wanted, leaks = expected(documents, items)
    parts = collections.defaultdict(dict)
    for r in corpus_pipeline.run(spark, tables).collect():
        parts[r.doc_id][r.start] = np.frombuffer(r.ids, "<u4").tolist()
    got = {k: [i for start in sorted(own) for i in own[start]] for k, own in parts.items()}
    assert got == wanted
    assert leaks and len(wanted) < len(documents) - 10


def test_stages_keep_the_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(40), tables).columns == docs.columns


def test_empty_documents(spark, no_tables):
    assert corpus_pipeline.run(spark, no_tables).count() == 0

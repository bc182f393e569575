"""The corpus pipeline: every stage and the whole run against brute force, and on awkward tables."""

import os
import random
import re

import pytest
from test_documents import SCHEMA, brute_spans, collect, jaccard_groups, labelled, words

import corpus_pipeline
from quillmill import runtime
from quillmill.llm import decontaminate, mixing, near, quality


def write(spark, folder, documents, labels, benchmark):
    documents.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents of five sources with everything that the stages look for, and awkward rows."""
    rng = random.Random(31)
    base, labels, _ = labelled(spark, 90)
    item = words(rng, 20, 10**6)
    rows = [(r.doc_id, r.text, "en", f"s{r.doc_id % 5}", len(r.text), "i", "v", 1) for r in base.collect()]

    def add(text, source="s0"):
        rows.append((len(rows), text, "en", source, len(text or ""), "i", "v", 1))

    good = "clear careful river mountain forest garden story".split()
    body = lambda n: [f"{rng.choice(good)} {w}" for w in words(rng, n, 10**6)]
    first = body(60)
    add(" ".join(first).capitalize() + ".")
    add(" ".join(first[:55]).capitalize() + ".")
    add(" ".join(first).capitalize() + ".", "s1")
    block = "\n".join(" ".join(body(6)) for _ in range(4))
    for k in range(4):
        add(" ".join(body(30)) + "\n" + block + "\n" + " ".join(body(10)), f"s{k}")
    add(" ".join([*body(40), *item, *body(40)]).capitalize() + ".")
    add(" ".join(item))
    for text in (None, "", "one", " ".join(body(20_000))):
        add(text, "s3")
    rows += [(None, " ".join(first), None, None, None, None, None, None), rows[70], (500, None, None, None, 0, None, None, None)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string")
    return write(spark, tmp_path_factory.mktemp("corpus"), table, labels, bench), " ".join(item)


def brute(name, rows, spark, folder, item):
    """What a stage keeps of ``rows``, as a sorted list."""
    docs = spark.createDataFrame(rows, SCHEMA)
    if name == "quality classifier":
        model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
        verdict = {}
        for r in quality.classify(docs, model).join(docs.select("doc_id"), "doc_id").collect():
            verdict[r.doc_id] = r.quality_score >= 0.5 and r.toxic_score < 0.5
        return [r for r in rows if r[0] is None or verdict[r[0]]], True
    if name == "line dedup":
        seen, out, at = {}, [], {}
        order = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
        for r in order:
            split = [x.strip(" ") for x in (r[1] or "").split("\n")]
            for p in range(len(split) - 2):
                w = tuple(split[p : p + 3])
                if any(w):
                    seen.setdefault(w, (r[0], p))
                    if (r[0], p) > seen[w]:
                        at.setdefault(r[0], set()).update((p, p + 1, p + 2))
        for r in rows:
            gone = at.get(r[0])
            if r[0] is None or not gone:
                out.append(r)
            else:
                left = [x for p, x in enumerate(r[1].split("\n")) if p not in gone]
                out += [(r[0], "\n".join(left), *r[2:])] if left else []
        return out, False
    if name == "near dedup":
        label = dict(jaccard_groups([(r[0], r[1]) for r in rows], near.NearConfig()))
        return [r for r in rows if r[0] is None or label.get(r[0], r[0]) == r[0]], False
    if name == "benchmark decontamination":
        out, limits = [], decontaminate.Limits()
        for r in rows:
            w = re.findall(r"[^\W_]+", (r[1] or "").lower())
            gone = brute_spans(w, [item.split()], limits)
            if not gone:
                out.append(r)
            elif len(gone) < limits.doc_coverage * len(w):
                chunks = re.findall(r"[^\W_]+[\W_]*", r[1])
                out.append((r[0], r[1][: len(r[1]) - sum(map(len, chunks))] + "".join(c for k, c in enumerate(chunks) if k not in gone), *r[2:]))
        return out, False
    return None, False


def test_stages_against_brute_force(spark, corpus):
    folder, item = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        rows = list(map(tuple, docs.collect()))
        kept = list(map(tuple, stage(spark, docs, folder).collect()))
        want, ids_only = brute(name, rows, spark, folder, item)
        if want is not None:
            key = (lambda r: str(r[0])) if ids_only else str
            known = [r for r in kept if r[0] is not None] if ids_only else kept
            assert sorted(map(key, known)) == sorted(map(key, (r for r in want if r[0] is not None) if ids_only else want)), name
        else:
            shares = {r.id for r in mixing.chosen(docs).collect()}
            assert {r[0] for r in kept} == shares and all(r in rows for r in kept)
        assert 0 < len(kept) <= len(rows), name
        docs = spark.createDataFrame(kept, SCHEMA)
    shared = runtime.shared_dir(spark).removeprefix("file:")
    there = set(os.listdir(shared))
    whole = corpus_pipeline.run(spark, folder)
    assert len(set(os.listdir(shared)) - there) == 1  # the last stage's table alone
    assert whole.columns == [x.split()[0] for x in SCHEMA.split(", ")] and collect(whole) == collect(docs) and whole.count() < before


def test_clean_documents_stay_and_planted_ones_go(spark, corpus):
    folder, item = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, folder)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert not any(item in (t or "") for t in texts.values())
    assert 90 in texts and 91 not in texts and 92 not in texts  # one of a group
    assert sum("\n" in (t or "") and (t or "").count("\n") >= 5 for t in texts.values()) == 1  # the block's first occurrence
    assert all(k % 3 == 0 for k in texts if k is not None and k < 90)  # bad and toxic ones


def test_empty_tables_and_no_labels(spark, corpus, tmp_path):
    folder, _ = corpus
    docs, labels, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    none = write(spark, tmp_path / "a", docs.limit(0), labels.limit(0), bench.limit(0))
    assert corpus_pipeline.run(spark, none).count() == 0 and corpus_pipeline.run(spark, none).columns == docs.columns
    bare = write(spark, tmp_path / "b", docs, labels.limit(0), bench.limit(0))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, spark.read.parquet(f"{bare}/documents.parquet"), bare)
        assert got.columns == docs.columns and got.schema == docs.schema, name
        assert stage(spark, docs.limit(0), bare).count() == 0, name
        if name in ("quality classifier", "benchmark decontamination"):
            assert got.count() == docs.count()

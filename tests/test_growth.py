"""What has to stay small, and texts on which engines differ."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill import config
from quillmill.llm import passages
from quillmill.functions import grams
from quillmill.operators import decontaminate, near, pii, tfidf
from quillmill.plans import registry
from quillmill.sources import readers, writers


def test_op6_asks_about_eight_bytes_for_a_shingle(spark):
    for ids in ([5], [7, 7, 8], [-9, 3, 1 << 62], [-(1 << 63), (1 << 63) - 1], range(1000)):
        own = np.array(ids, np.int64)
        assert passages._unpacked(passages._packed(own), len(own)).tolist() == own.tolist()
    docs = spark.createDataFrame([(i, " ".join(f"w{i * 97 + k}" for k in range(60))) for i in range(400)], "doc_id long, text string").coalesce(1)
    asked = passages._asked(passages._blocks(docs), 6, passages.PassageConfig())
    size, n = asked.agg(F.sum(sum(F.octet_length(c) for c in ("high", "low", "doc", "many"))), F.sum(F.octet_length("high") / 4)).first()
    assert n == 400 * 56 and size < 9 * n


def test_simhash_leaders_need_no_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 40)
    rows = [(int(i), int(base[rng.integers(40)] ^ np.bitwise_or.reduce(1 << rng.integers(0, 63, 5)))) for i in rng.permutation(600)]
    rows += [(3, rows[0][1] ^ 1), (7, int(base[0])), (7, int(base[1])), (700, -5), (700, 9)]
    heads = spark.createDataFrame([(i, h, 0, h) for i, h in dict.fromkeys(rows)], "doc_id long, k1 long, k2 long, simhash long")
    c = config.NearConfig(method="simhash")
    of: dict = {}
    for i, h in rows:
        of.setdefault(i, []).append(h)
    led: dict = {}
    for i in sorted(of):
        if i not in led:
            led[i] = i
            for j in of:
                if j not in led and any((g ^ h) % (1 << 64) and ((g ^ h) % (1 << 64)).bit_count() <= 12 or g == h for g in of[i] for h in of[j]):
                    led[j] = i
    for step in (None, 7):
        assert dict(map(tuple, near._simhash_leaders(heads, c, step).collect())) == led
    assert near._simhash_leaders(heads.limit(0), c).count() == 0
    # the whole operator makes no pairs at this bound
    docs = spark.createDataFrame([(i, f"text of {i % 9} words and {i % 5}") for i in range(60)], "doc_id long, text string")
    want = {r.doc_id: r.leader for r in near.leaders(near.simhash_pairs(docs)).collect()}
    old, near._simhash_pairs = near._simhash_pairs, None
    try:
        got = {r.doc_id: r.leader for r in near.groups(docs, c).collect()}
    finally:
        near._simhash_pairs = old
    assert all(got[k] == v for k, v in want.items())


def test_wide_simhash_pairs_are_streamed_in_tiles(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, 30)
    hashes = {int(i): int(base[rng.integers(30)] ^ np.bitwise_or.reduce(1 << rng.integers(0, 63, 7))) for i in rng.permutation(9000)[:1500] - 500}
    heads = spark.createDataFrame([(i, h) for i, h in hashes.items()], "doc_id long, simhash long")
    found = near._simhash_pairs(heads, config.NearConfig(method="simhash"))
    want = {(a, b): 1 - d / 64 for a in hashes for b in hashes if a < b and (d := ((hashes[a] ^ hashes[b]) % (1 << 64)).bit_count()) <= 12}
    rows = found.collect()
    assert len(rows) == len(want) and {(r.id_a, r.id_b): r.score for r in rows} == want
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_candidates_of_personal_data_equal_sql_beyond_ascii(spark):
    words = ["1 foo st\u00fcck", "1 foo st", "1 foo \u017ft", "a 12 o\u212a ROAD", "\u00e91 foo rd", "x@y.co\u00e9", "\u00e9x@y.com", "\u212a@a.o\u212a", "\u00e9123-45-6789\u00e9", "1.2.3.4\u00fc", "\u0663555-123-4567", "a\u0301 5 a la\u0301 ln", "_1 a st_", "1 a\u0131 st", "1 a\u0130 st"]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(words)))
    want = sorted(db.execute(registry.ORACLES["pii_candidates"]).fetchall())
    assert sorted(map(tuple, pii.COUNTS.spark(docs).collect())) == want and sum(sum(r[1:]) for r in want) > 6


def test_csv_gives_back_blanks_at_the_ends(spark, tmp_path):
    texts = [" a", "a ", "\ta\t", "  ", "\n", "\r\n", "\na\n", "a\"\n", "\0a", "\x1fa\x1f", "a\r\nb", "\\", "a,\"b\"", "\u00a0"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    writers.write_documents(df, f"{tmp_path}/x.csv", "csv")
    assert sorted(r.text for r in readers.read_documents(spark, f"{tmp_path}/x.csv").collect()) == sorted(texts)
    writers.write_results(df, f"{tmp_path}/y.csv")
    assert sorted(r.text for r in readers.read_csv(spark, f"{tmp_path}/y.csv", "document").collect()) == sorted(texts)


def test_semantic_pairs_send_no_vector_once_for_each_block(spark):
    x = np.random.default_rng(3).normal(size=(2000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i - 40, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>").unionByName(spark.createDataFrame([(None, [1.0] * 16), (5000, None), (5001, [0.0] * 16)], "id long, v array<float>"))
    c = config.SemanticConfig(threshold=0.75, block=16)
    y = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    i, j = np.nonzero(np.triu(y @ y.T >= 0.75, 1))
    found = near.semantic_pairs(df, "id", "v", c)
    rows = found.collect()
    assert len(rows) == len(i) and {(r.id_a + 40, r.id_b + 40) for r in rows} == set(zip(i.tolist(), j.tolist())) != set()
    assert found.rdd.getNumPartitions() < 100  # blocks of 16 rows: 7875 pairs of them


TEXTS = ["the cat sat on the mat and the dog sat on the cat", "The  Cat,\tsat on!", "", None, "caf\u00e9 \u00e9t\u00e9 caf\u00e9 na\u00efve caf\u00e9 \U0001f600 \U0001f600", "on", "a\u00a0b c", " lead and trail ", "x\ny\r\nz x y z x", "... , !!"]


def _benchmark(spark):
    items = ["cat sat on the mat", "caf\u00e9 \u00e9t\u00e9 caf\u00e9", "\U0001f600 \U0001f600", "y z x", "and trail"]
    return items, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


@pytest.mark.parametrize("characters", [True, False])
def test_windows_that_a_table_holds_are_found_without_a_row_for_each(spark, characters):
    items, benchmark = _benchmark(spark)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for n, low, bare in ((1, True, True), (3, True, False), (2, False, True), (3, False, False)):
        c = config.DecontaminationConfig(n=n, characters=characters, case_insensitive=low, remove_punctuation=bare, uncapped_score=True)

        def units(x):
            x = re.sub("[A-Z]+", lambda m: m.group().lower(), x) if low else x
            x = re.sub(r"[!-/:-@\[-`{-~]+", "", x) if bare else x
            words = re.findall("[^ \t\n\x0b\f\r]+", x)
            return list(" ".join(words)) if characters else words

        def runs(x):
            u = units(x)
            return [("" if characters else " ").join(u[k : k + n]) for k in range(len(u) - n + 1)]

        index = decontaminate.index(benchmark, config=c)
        known = {r.gram for r in index.collect()}
        want = {(i, k, g) for i, t in enumerate(TEXTS) for k, g in enumerate(runs(t or "")) if g in known}
        assert {(r.doc_id, r.position, r.gram) for r in decontaminate.matches(docs, index, c).collect()} == want != set()
        assert {r.doc_id: r.total_ngrams for r in decontaminate.assess(docs, index, c).collect()} == {i: len(runs(t or "")) for i, t in enumerate(TEXTS)}
        rows = grams.candidates(docs, index, c).collect()
        assert len(rows) == len(TEXTS) and sum(len(r.hits) for r in rows) <= len(want) + 1


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_characters_of_texts_are_not_exploded(spark):
    items, benchmark = _benchmark(spark)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    c = config.DecontaminationConfig(n=5, characters=True)
    assert "xxhash64" not in _plan(decontaminate.assess(docs, decontaminate.index(benchmark, config=c), c))


def test_words_of_texts_are_not_exploded_for_matches(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    c = config.DecontaminationConfig(n=3, uncapped_score=True)
    found = decontaminate.matches(docs, decontaminate.index(_benchmark(spark)[1], config=c), c)
    assert "xxhash64" not in _plan(found) and found.columns == ["doc_id", "position", "gram", "dataset"]


def test_words_of_texts_are_not_exploded_for_several_sizes(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = decontaminate.adaptive(docs, _benchmark(spark)[1], sizes=(2, 3))
    assert "xxhash64" not in _plan(found) and {r.doc_id for r in found.collect() if r.contaminated} >= {0}


MODEL = ["model_scores", "model_stats", "model_accuracy", "model_single_stage"]


@pytest.mark.parametrize("name", MODEL)
def test_model_scores_are_counted_in_one_pass(spark, tmp_path, name):
    texts = [None, "", " ", "\t\n", "a", " a  b\r\n\tc ", "Results!  Analysis of  EVIDENCE? caf\u00e9 \u00fc\u00fc", "win free money now. click. easy trick!", "abcdefghij" * 30, "0123456789 " * 9, "x" * 9, "x" * 10, "x" * 11, "The study shows an approach. " * 40, "\u00a0\x0b\x0c!", "one two three. " * 3 + "\U0001f600", "word " * 130 + "."]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, len(texts), 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    db = duckdb.connect()
    for table in ("documents", "labels"):
        db.execute(f"CREATE TABLE {table} AS FROM '{tmp_path}/{table}.parquet/*.parquet'")
    found = registry.QUERIES[name](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(db.execute(registry.ORACLES[name]).fetchall())
    assert "regexp" not in _plan(found)


def test_personal_data_is_sought_once_and_only_where_it_can_be(spark):
    texts = ["", "call 555-867-5309 or (555) 867 5309", "me@site.org, 4111111111111111", "10.20.30.40 x", "12 Long Oak\tStreet", "123-45-6789 and 123456789", "AB123456C 12-3456789", "John Smith", "no digits", "1.1", "7 up", "\u0663\u0664\u0665\u0666 \u00e9", None]
    c = config.PiiConfig(names=True, government_ids=True)
    needs, seen, old = pii._NEEDS, [], pii.detect
    try:
        pii._NEEDS = {}
        want = [pii.detect(t, c) for t in texts]
        pii._NEEDS = needs
        assert [pii.detect(t, c) for t in texts] == want and sum(map(len, want)) >= 9
        pii.detect = lambda *x: seen.append(x) or old(*x)
        assert pii.sanitize(texts[1], c, want[1]) == "call [PHONE] or ([PHONE]" and not seen
    finally:
        pii._NEEDS, pii.detect = needs, old
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.s for r in pii.evaluate(docs, c).selectExpr("doc_id", "pii.sanitized AS s").collect()} == {i: pii.sanitize(t, c) for i, t in enumerate(texts)}


def test_tfidf_pairs_shuffle_no_candidates(spark):
    rng = np.random.default_rng(9)
    base = [[f"w{x}" for x in rng.zipf(1.3, 40) % 300] for _ in range(60)]
    texts = [" ".join(w if rng.random() > 0.06 else f"w{rng.integers(300)}" for w in base[k % 60]) for k in range(700)] + ["", "unseen", None, base[0][0]]
    found = tfidf.pairs(spark.createDataFrame([(i - 90, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    words = [(t or "").split() for t in texts]
    df = Counter(w for x in words for w in set(x))
    idf = {w: np.log((1 + len(texts)) / (1 + n)) + 1 for w, n in df.items() if n >= 2}
    number = {w: k for k, w in enumerate(sorted(idf))}
    x = np.zeros((len(texts), len(idf)))
    for k, own in enumerate(words):
        for w in own:
            if w in idf:
                x[k, number[w]] += idf[w]
    heads = sorted({r.tobytes(): k for k, r in reversed(list(enumerate(x))) if r.any()}.values())
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
    want = {(i - 90, j - 90): s for i in heads for j in heads if i < j and (s := x[i] @ x[j]) >= 0.85}
    got = {(r.id_a, r.id_b): r.score for r in found.collect()}
    assert got.keys() == want.keys() and len(want) > 500 and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert "Join" not in _plan(found) and "Aggregate" not in _plan(found)


def test_semantic_dedup_keeps_what_pairs_of_all_shards_leave(spark):
    x = np.random.default_rng(4).normal(size=(1200, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    y = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    alike, led = y @ y.T >= 0.8, np.zeros(len(x), bool)
    want = [i for i in range(len(x)) if led[i] == 0 and (led.__ior__(alike[i]) is not None)]
    c = config.SemanticConfig(threshold=0.8, block=4)
    assert sorted(r.id for r in near.semantic_dedup(df, "id", "v", c).collect()) == want and len(want) < 1100
    assert near.semantic_pairs(df, "id", "v", c).rdd.getNumPartitions() < 100

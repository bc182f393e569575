"""The operators over documents: brute force on small tables, edge cases, planted cases."""

import random

import numpy as np
import pytest

from quillmill.llm import components, decontaminate, langid, lines, mixing, near, passages, quality, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, value string, a int"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}x" for _ in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns whose names clash with those inside."""
    rng = random.Random(1)
    base = [" ".join(words(rng, 120)) for _ in range(8)]
    texts = [*base, base[0], base[1] + " tail end", None, "", " \n\t ", "one", "a b", "\n".join(["x y z"] * 9), " ".join(words(rng, 30_000)), "\n".join(base[2].split()), "!!! ??? ..."]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t or ""), "i", "v", 1) for i, t in enumerate(texts)]
    rows += [(None, base[3], None, None, None, None, None, None), rows[4], (77, None, None, None, 0, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collect(df):
    return sorted(map(tuple, df.collect()), key=str)


# tokens


def test_token_hashes_follow_the_words():
    import pyarrow as pa

    got = dict(tokens.documents(pa.array(["The cat, THE cat", None, "", "été Été x"])))
    assert got[0][0] == got[0][2] and got[0][1] == got[0][3] and len(got[0]) == 4
    assert len(got[1]) == len(got[2]) == 0 and len(got[3]) == 3 and got[3][0] != got[3][1]


# near duplicates


def jaccard_groups(texts, config):
    sets = {}
    for i, t in texts:
        w = [x.lower() for x in __import__("re").findall(r"(?:[a-zA-Z0-9]|[^\x00-\x7f])+", t or "")]
        if i is not None and w:
            sets.setdefault(i, {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))})
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            common = len(sets[i] & sets[j])
            if common >= config.threshold * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    out = {i: find(i) for i in ids}
    return {(i, g) for i, g in out.items() if sum(x == g for x in out.values()) > 1}


def test_near_groups_equal_brute_force_and_long_lists_are_whole(spark):
    rng = random.Random(4)
    rows = []
    for g in range(6):
        base = words(rng, 80)
        for _ in range(9 if g else 40):
            copy = base[:]
            for _ in range(rng.choice([0, 1, 1, 2])):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, " ".join(words(rng, 60))) for k in range(40)]
    rng.shuffle(rows)
    config = near.NearConfig(list_block=7)
    found = {tuple(r) for r in near.groups(spark.createDataFrame(rows, "doc_id long, text string"), config).collect()}
    want = jaccard_groups(rows, config)
    assert len(found & want) >= 0.95 * len(want) and not {i for i, _ in found} - {i for i, _ in want}


def test_near_edges(table, empty):
    kept = collect(near.deduplicate(table))
    ids = [r[0] for r in kept]
    assert 8 not in ids and 9 not in ids and {0, 1, 10, 11, 12, 77} <= set(ids) and None in ids and ids.count(4) == 2
    assert near.deduplicate(table).columns == table.columns
    assert near.groups(empty).count() == 0 and near.deduplicate(empty).count() == 0


def test_estimate_is_the_union_sketch():
    rng = np.random.default_rng(0)
    x, y = np.unique(rng.integers(1, 1 << 60, 500).astype(np.uint64)), None
    y = np.unique(np.concatenate([x[:400], rng.integers(1, 1 << 60, 100).astype(np.uint64)]))
    k = 64
    union = np.union1d(x, y)[:k]
    want = np.isin(union, np.intersect1d(x, y)).mean()
    assert near.estimate(x[None, :k], y[None, :k], k)[0] == pytest.approx(want)


def test_components_both_ways(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert collect(components.connected_components(df)) == collect(components.connected_components(df, local_edges=0))
    assert components.connected_components(df.where("a < 0")).count() == 0


# passages


def brute_windows(values, width):
    out = []
    for c in np.flatnonzero(values):
        lo = hi = c
        while lo > 0 and values[lo - 1] > values[c]:
            lo -= 1
        while hi + 1 < len(values) and values[hi + 1] >= values[c]:
            hi += 1
        if hi - lo + 1 >= width:
            out.append((c, lo, hi))
    return sorted(out)


@pytest.mark.parametrize("width", [1, 2, 7, 16, 250])
def test_compact_windows(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 6, 200):
        values = rng.integers(0, 50, n).astype(np.uint64) << np.uint64(40)
        c, lo, hi, of = passages.compact_windows(values, width)
        assert sorted(zip(c.tolist(), lo.tolist(), hi.tolist())) == brute_windows(values, width)


def test_passages_against_brute_force(spark):
    rng = random.Random(8)
    shared = [words(rng, 60, 10**6) for _ in range(4)]
    rows = []
    for k in range(60):
        body = words(rng, 150, 10**6)
        if k % 3 == 0:
            piece = shared[k % 4][:]
            if k % 2:
                piece[30] = "edited"
            at = rng.randrange(100)
            body[at:at] = piece
        rows.append((k, " ".join(body)))
    rows += [(60, None), (61, ""), (None, rows[0][1]), (62, " ".join(shared[0][:45])), (63, " ".join(shared[0] * 300))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    config = passages.PassageConfig()
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        if i is not None and len(w) >= config.passage:
            sets[i] = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
    want, found = {}, {}
    for i, s in sets.items():
        for j in sets:
            if j < i:
                names = {g: n for n, g in enumerate({*s, *sets[j]})}
                for a, b in passages.repeated_spans(np.array([names[g] for g in s]), np.array([names[g] for g in sets[j]]), config.width, config.need):
                    want.setdefault(i, set()).update(range(a, b + 4))
    for r in passages.repeated_passages(df).collect():
        assert r.source_doc_id < r.doc_id
        found.setdefault(r.doc_id, set()).update(range(r.first_token, r.after_token))
    total = sum(map(len, want.values()))
    assert sum(len(v & found.get(k, set())) for k, v in want.items()) >= 0.9 * total > 0
    assert all(v <= want.get(k, set()) for k, v in found.items())


def test_passages_edges(table, empty):
    got = {r.doc_id for r in passages.repeated_passages(table).collect()}
    assert {8, 9} <= got and not got & {0, 1, 10, 11, 12, 13, 14, 77, None}
    assert passages.repeated_passages(empty).count() == 0
    with pytest.raises(ValueError):
        passages.PassageConfig(shingle=60)


# lines


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, "\n".join(rng.choice(["a", "b", " c ", "", "d e"]) for _ in range(rng.randrange(12)))) for k in range(60)]
    seen, want = set(), {}
    for k, t in rows:
        split = t.split("\n")
        bare = [x.strip(" ") for x in split]
        gone = set()
        for p in range(len(bare) - 2):
            w = tuple(bare[p : p + 3])
            if any(w):
                gone |= {p, p + 1, p + 2} if w in seen else set()
                seen.add(w)
        if len(gone) < len(split) or not gone:
            want[k] = "\n".join(x for p, x in enumerate(split) if p not in gone)
    got = lines.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert dict(map(tuple, got.collect())) == want


def test_lines_edges(table, empty):
    got = lines.deduplicate_lines(table)
    assert got.columns == table.columns
    kept = {r.doc_id: r.text for r in got.collect()}
    assert kept[15] == "x y z" and kept[11] == "" and kept[10] is None and None in kept and kept[77] is None
    assert lines.deduplicate_lines(empty).count() == 0 and lines.report(empty).count() == 0


# decontamination


def brute_spans(doc, items, limits):
    gone = set()
    for item in items:
        need = limits.need(len(item))
        if len(item) < limits.min_match:
            continue
        grams = {tuple(item[k : k + need]) for k in range(len(item) - need + 1)}
        for k in range(len(doc) - need + 1):
            if tuple(doc[k : k + need]) in grams:
                gone.update(range(k, k + need))
    return gone


def test_automaton_against_brute_force():
    rng = random.Random(5)
    limits = decontaminate.Limits()
    for _ in range(30):
        items = [[f"t{rng.randrange(6)}" for _ in range(rng.randrange(4, 40))] for _ in range(6)]
        machine = decontaminate.Automaton([i for i in items if len(i) >= limits.min_match], limits)
        doc = [f"t{rng.randrange(6)}" for _ in range(60)]
        at, item = rng.randrange(60), rng.choice(items)
        doc[at:at] = item[: rng.randrange(len(item) + 1)]
        spans, _ = machine.matches(doc)
        assert {p for a, b in spans for p in range(a, b)} == brute_spans(doc, items, limits)


def test_decontamination_edges(spark, table, empty):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    docs = table.unionByName(spark.createDataFrame([(50, f"Start here. {item.title()}! And the long rest of it, with many more words than the item itself has.", "en", "s", 1, "", "", 1), (51, item, "en", "s", 1, "", "", 1)], SCHEMA))
    kept = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench).collect()}
    assert kept[50].startswith("Start here. And the long") and 51 not in kept and kept[10] is None and kept[11] == "" and len(kept) == docs.select("doc_id").distinct().count() - 1
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert collect(decontaminate.decontaminate(table, bench.limit(0))) == collect(table)
    many = decontaminate.Limits(max_automaton_tokens=1)
    assert decontaminate.contamination(docs, bench, many).count() == 2


def test_documents_that_are_a_short_item_go(spark):
    bench = spark.createDataFrame([(1, "What is it, then?"), (2, "a long item of the test with its ten tokens here")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "what is it then"), (2, "So what is it then, he asked."), (3, "then"), (4, None)], "doc_id long, text string")
    for limits in (decontaminate.Limits(), decontaminate.Limits(max_automaton_tokens=4)):
        assert {r.doc_id for r in decontaminate.decontaminate(docs, bench, limits).collect()} == {2, 3, 4}
        assert collect(decontaminate.contamination(docs, bench.limit(1), limits)) == [(1, 4, 4, 1, 4, True, "")]


def test_a_split_benchmark_changes_no_result(spark):
    rng = random.Random(11)
    items = [words(rng, 40, 10**6) for _ in range(4)]
    items[1][:16] = items[0][12:28]
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    free = lambda n: words(rng, n, 10**6)
    texts = [
        [*items[0], *free(20), *items[1][20:], *items[2], *free(20)],  # dropped by the parts together
        [*free(60), *items[0][:28], *items[1][16:], *free(60)],  # items that overlap, spans that touch
        [*items[3][:20], *free(30)],
        [*free(15), *items[2], *free(100)],
        [*items[2], *items[3], *free(9)],
        free(50),
    ]
    rows = [(k, ". ".join(t), 1) for k, t in enumerate(texts)]
    rows += [(None, rows[1][1], 2), rows[3], (7, None, 1), (8, "", 1), (9, "!?", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_ int").repartition(3)
    split = decontaminate.Limits(max_automaton_tokens=40)
    for run in (decontaminate.contamination, decontaminate.decontaminate):
        assert collect(run(docs, bench, split)) == collect(run(docs, bench)) and run(docs, bench, split).columns == run(docs, bench).columns
    report = {r.doc_id: r for r in decontaminate.contamination(docs, bench, split).collect()}
    assert report[0].dropped and 0 not in {r.doc_id for r in decontaminate.decontaminate(docs, bench, split).collect()}
    assert decontaminate.contamination(docs, bench, split).count() == 7


# mixing


def test_mixing_follows_the_quotients(spark, table, empty):
    rng = random.Random(6)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 40)), f"s{min(3, int(rng.random() * 6))}") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixture = mixing.Mixture(weights={"s0": 3.0, "s1": 1.0, "s2": 0.0}, block_tokens=60, shard_tokens=4000, keep=0.5)
    _, quotas = mixing.allocate(docs, mixture)
    shards = {}
    for r in quotas.collect():
        shards.setdefault(r.shard, []).append(r)
    for rs in shards.values():
        left = {r.src: r.blocks for r in rs}
        won = dict.fromkeys(left, 0)
        for _ in range(int(np.ceil(0.5 * sum(left.values())))):
            best = max((mixture.weights.get(s, 1.0) / (2 * won[s] + 1), -ord(s[-1])) for s in left if won[s] < left[s] and mixture.weights.get(s, 1.0) > 0) if any(won[s] < left[s] and mixture.weights.get(s, 1.0) > 0 for s in left) else None
            if best is None:
                break
            won[f"s{chr(-best[1])}"] += 1
        assert won == {r.src: r.seats for r in rs}
    a = collect(mixing.mix(docs, mixture))
    assert a == collect(mixing.mix(docs.repartition(7), mixture)) and {r[2] for r in a} == {"s0", "s1", "s3"}
    assert mixing.mix(table).columns == table.columns and 0 < mixing.mix(table).count() <= table.count()
    assert mixing.mix(empty).count() == 0


def test_long_documents_take_the_seats_they_run_over(spark):
    rows = [(k, " ".join(["w"] * 1000), "long") for k in range(400)]
    rows += [(1000 + k, " ".join(["w"] * 50), f"short{k % 2}") for k in range(16_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixture = mixing.Mixture(block_tokens=100, shard_tokens=200_000, keep=0.5)
    _, quotas = mixing.allocate(docs, mixture)
    share = {r.src: (r.b, r.s) for r in quotas.groupBy("src").agg({"blocks": "sum", "seats": "sum"}).toDF("src", "s", "b").select("src", "b", "s").collect()}
    got = {r.src: r.t for r in mixing.chosen(docs, mixture).groupBy("src").agg({"tokens": "sum"}).toDF("src", "t").collect()}
    assert all(abs(got[s] / sum(got.values()) - 1 / 3) < 0.05 for s in ("long", "short0", "short1")), (got, share)
    assert abs(sum(got.values()) - 600_000) < 60_000, got


@pytest.mark.parametrize("weights", [{}, {"s0": 3.0, "s1": 0.5, "s2": 0.0}])
def test_mixing_equals_its_sql_over_several_shards(spark, table, weights):
    import duckdb

    rng = random.Random(16)
    rows = [(k, " ".join(["w"] * rng.choice([1, 5, 30, 30, 400])), f"s{min(4, int(rng.random() * 7))}") for k in range(700)] + [(None, "a b", "s1"), (None, "c", "s1"), (-1, "d", None), (800, None, "s3"), (5, "x y", "s9"), (801, "", "s8")]
    mixture = mixing.Mixture(weights=weights, block_tokens=50, shard_tokens=5000, keep=0.6)
    documents = __import__("pandas").DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.execute(mixing.sql(mixture)).fetchall()
    got = mixing.chosen(spark.createDataFrame(rows, "doc_id long, text string, source string"), mixture).select("id", "src", "shard", "block", "tokens").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len({r[2] for r in want}) > 3


# quality


def labelled(spark, n=120):
    rng = random.Random(7)
    kinds = {(1, 0): "clear careful river mountain forest garden story".split(), (0, 0): "buy click cheap offer deal win".split(), (1, 1): "clear river scum trash filth mountain".split()}
    rows, labels = [], []
    for k in range(n):
        y = list(kinds)[k % 3]
        rows.append((k, " ".join(rng.choice(kinds[y]) for _ in range(30)).capitalize() + "."))
        labels.append((k, *y))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((k, (q, t)) for k, q, t in labels)


def test_quality_held_out_and_edges(spark, table, empty):
    docs, labels, truth = labelled(spark)
    model = quality.train(docs, labels.where("doc_id < 60"))
    got = {r.doc_id: r.keep for r in quality.classify(docs, model).collect()}
    right = [got[k] == (q == 1 and t == 0) for k, (q, t) in truth.items() if k >= 60]
    assert sum(right) >= 0.95 * len(right)
    assert quality.classify(table, model).count() == table.count() and quality.reject(table, model).columns == table.columns
    assert quality.classify(empty, model).count() == 0 and quality.train(empty, labels) is None
    assert quality.reject(table, None).count() == table.count()
    bad = spark.createDataFrame([(1, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, bad) is None


def test_votes_are_exact_neighbours():
    rng = np.random.default_rng(1)
    v = quality.unit(rng.standard_normal((40, 8)).astype(np.float32))
    y = (rng.random(40) < 0.5).astype(float)
    space = quality.Space(np.zeros(0, np.uint64), np.zeros(0), np.zeros((1, 8)), v, y, 0.0, 0.5, 5)
    q = quality.unit(rng.standard_normal((9, 8)).astype(np.float32))
    for got, x in zip(space.vote(q), q):
        c = np.round(v @ x, 5)
        near_ = c >= np.sort(c)[-5]
        w = np.maximum(c, 0) * near_
        assert got == pytest.approx((w * y).sum() / w.sum(), abs=1e-4)


# language


def test_language_held_out_and_edges(spark, table, empty):
    rng = random.Random(9)
    parts = {"en": ["the", "and", "thing", "with", "ing"], "de": ["der", "und", "schön", "mit", "keit"], "fr": ["les", "été", "avec", "eux", "tion"]}
    rows = [(k, " ".join("".join(rng.choices(parts[x], k=2)) for _ in range(40)), x) for k in range(240) for x in [list(parts)[k % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(docs.where("doc_id < 150"))
    got = {r.doc_id: r.predicted_lang for r in langid.identify(docs, net).collect()}
    held = [(got[k], x) for k, _, x in rows if k >= 150]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    edge = {r.doc_id: r for r in langid.identify(table, net).collect()}
    assert edge[10].predicted_lang is None and edge[11].predicted_lang is None and edge[11].confidence == 0 and edge[16].predicted_lang is not None
    assert langid.identify(empty, net).count() == 0 and langid.train(empty) is None
    assert langid.identify(table, None).where("predicted_lang is not null").count() == 0


def test_tables_equal_the_network(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (20, 64)).astype(np.uint8)
    net = langid.fit(x, rng.integers(0, 2, 20), ["a", "b"], langid.LangConfig(window=64, epochs=1))
    e = net.embed[x]
    n = 64 - max(langid.WIDTHS) + 1
    pooled = np.concatenate([sum(e[:, k : k + n] @ w[k] for k in range(len(w))).max(1) for w in net.kernels], 1)
    want = langid.log_softmax(np.maximum(pooled + net.bias, 0) @ net.dense + net.dense_bias)
    assert np.allclose(net.log_probabilities(x, net.tables()), want, atol=1e-4)

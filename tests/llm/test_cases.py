"""Cases that must cost nothing and lose nothing: caps, odd values, very long and deep texts; whole operators against brute force."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from test_documents import labelled, words

from quillmill.llm import html, langid, lines, matroska, near, passages, quality, tokens, warc


# quality


def test_every_correlated_feature_counts(spark):
    rng = random.Random(21)
    rows, labels = [], []
    for k in range(40):
        y = k % 2
        rows.append((k, " ".join(f"{'good' if y else 'bad'}{j}" for j in range(6000))))
        labels.append((k, y, rng.randrange(2)))
    model = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert len(model[0].hashes) >= 12_000 and (np.diff(model[0].hashes.astype(object)) > 0).all()


def test_classification_is_the_brute_force_vote(spark):
    docs, labels, _ = labelled(spark)
    model = quality.train(docs, labels.where("doc_id < 60"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.classify(docs.repartition(5), model).collect():
        _, _, data, starts = next(tokens.blocks(pa.array([texts[r.doc_id]])))
        _, names = quality.features(data, starts)
        found = []
        for space in model:
            x = np.zeros(len(space.hashes) + 1)
            for k, h in enumerate(space.hashes):
                x[k] = np.log1p((names == h).sum()) * space.weights[k]
            x[-1] = space.bias
            v = x @ space.axes
            cosine = np.round((space.vectors @ (v / np.linalg.norm(v)).astype(np.float32)), 5)
            near_ = cosine >= np.sort(cosine)[-space.neighbours] - 1e-5
            weight = np.maximum(cosine, 0) * near_
            found.append((weight @ space.labels) / weight.sum())
        assert r.quality_score == pytest.approx(found[0], abs=0.02) and r.toxic_score == pytest.approx(found[1], abs=0.02)
        assert r.keep == (r.quality_score >= 0.5 and r.toxic_score < 0.5)


# lines


def test_long_repeated_texts_are_cut_in_linear_time(spark):
    text = "\n".join(f"line {k}" for k in range(60_000))
    docs = spark.createDataFrame([(1, text), (2, text), (3, text + "\nend"), (4, None)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.text for r in lines.deduplicate_lines(docs).collect()}
    assert set(got) == {1, 3, 4} and got[1] == text and got[3] == "end" and time.time() - began < 30


# near duplicates


def test_each_text_of_an_id_counts(spark):
    rng = random.Random(22)
    a, b = " ".join(words(rng, 80, 10**6)), " ".join(words(rng, 80, 10**6))
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " end"), (5, b), (6, " ".join(words(rng, 80, 10**6)))]
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        got = sorted(map(tuple, near.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
        assert got == [(1, 1), (2, 1), (3, 1), (5, 1)]


def test_lists_hold_every_pair_that_the_estimate_passes(spark):
    """Whatever passes the estimate shares a list: against all pairs of sketches."""
    rng = random.Random(23)
    base = words(rng, 90, 10**6)
    rows = []
    for k in range(60):
        copy = base[: rng.choice([5, 12, 40, 90])]
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    config = near.NearConfig()
    sketch = near.sketches(spark.createDataFrame(rows, "doc_id long, text string"), config).withColumn("row", __import__("pyspark.sql.functions", fromlist=["x"]).col("id"))
    values = {r.id: np.array(r.sketch, np.int64).view(np.uint64) for r in sketch.collect()}
    lists = {r.id: set(r["values"]) for r in near.listable(sketch, config).collect()}
    passed = 0
    for i, x in values.items():
        for j, y in values.items():
            if i < j:
                union = np.union1d(x, y)[: config.sketch]
                if np.isin(union, np.intersect1d(x, y)).mean() >= config.least:
                    passed += 1
                    assert lists[i] & lists[j], (i, j)
    assert passed > 100


# passages


def test_a_passage_in_many_documents_gives_a_row_each(spark):
    rng = random.Random(24)
    shared, short = words(rng, 70, 10**6), words(rng, 25, 10**6)
    rows = []
    for k in range(80):
        body = words(rng, 120, 10**6)
        body[60:60] = shared if k % 2 else short
        rows.append((k, " ".join(body)))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == set(range(3, 80, 2)) and len(got) == 39
    assert all(r.source_doc_id == 1 and r.first_token <= 60 and r.after_token >= 130 for r in got)


def repeats(rows, config):
    """The rows of repeated_passages by brute force: the least earlier document of every window, windows that touch as one."""
    grams = {}
    for i, t in rows:
        w = t.split()
        grams[i] = [tuple(w[k : k + config.shingle]) for k in range(len(w) - config.shingle + 1)]
    sets, out = {i: set(g) for i, g in grams.items()}, []
    for i, g in sorted(grams.items()):
        mine = []
        for k in range(len(g) - config.width + 1):
            found = [j for j in sets if j < i and sum(x in sets[j] for x in g[k : k + config.width]) >= config.need]
            if found and mine and k <= mine[-1][3]:
                mine[-1] = (i, min(mine[-1][1], *found), mine[-1][2], k + config.passage)
            elif found:
                mine.append((i, min(found), k, k + config.passage))
        out += mine
    return out


def test_every_window_at_the_threshold_is_found(spark):
    rng = random.Random(61)
    config = passages.PassageConfig()
    phrases = [words(rng, 12, 10**6) for _ in range(12)]
    rows = []
    for k in range(60):
        piece = words(rng, 50, 10**6)
        for copy in range(2):  # nine of 46 shingles differ: four fifths are the same
            body = words(rng, 60, 10**6)
            if copy:
                piece = piece[:]
                piece[20], piece[24] = "edited", "again"
            at = rng.randrange(60)
            body[at:at] = piece
            rows.append((100 * copy + k, " ".join(body)))
    for k in range(30):  # phrases that many documents share, in all orders
        rows.append((300 + k, " ".join(sum((rng.choice(phrases) for _ in range(9)), []))))
    half = words(rng, 70, 10**6)
    for k, piece in enumerate((half[:38], half[32:], half, half[1:], half)):  # the first that has some, and those that have all
        rows.append((400 + k, " ".join(words(rng, 30, 10**6) + piece)))
    rng.shuffle(rows)
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), config).collect()
    want = repeats(rows, config)
    assert sorted(map(tuple, got)) == sorted(want)
    assert {100 + k for k in range(60)} <= {i for i, *_ in want} and any(i >= 300 for i, *_ in want)
    assert {(j, i) for i, j, *_ in want if i >= 400} == {(402, 403), (402, 404)}


def test_pairs_that_share_a_short_phrase_alone_are_not_compared(spark, monkeypatch):
    rng = random.Random(62)
    one, other = words(rng, 25, 10**6), words(rng, 25, 10**6)
    rows = [(k, " ".join(words(rng, 20, 10**6) + (other if k % 2 else one) + words(rng, 20, 10**6))) for k in range(200)]
    rows += [(200 + k, " ".join(one + words(rng, 1, 10**6) + other)) for k in range(20)]
    compared, pairs = passages._compared, []

    def counted(asked, *rest):
        pairs.append(asked.count())
        return compared(asked, *rest)

    monkeypatch.setattr(passages, "_compared", counted)
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == repeats(rows, passages.PassageConfig()) and {r.source_doc_id for r in got} == {200}
    assert sum(pairs) < 400


# language


def test_no_language_is_left_out_and_null_ids_train(spark):
    rng = random.Random(25)
    rows = [(None, " ".join(f"{chr(97 + k % 26)}{k}{chr(97 + k // 26 % 26)}" * 2 for _ in range(30)) + f" {rng.random()}", f"l{k:03}") for k in range(260) for _ in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(docs, langid.LangConfig(epochs=1, window=64))
    assert len(net.languages) == 260
    same = spark.createDataFrame([(None, "the same text in every row", "en")] * 3000, "doc_id long, text string, lang string")
    net = langid.train(same)
    assert net.languages == ["en"] and {r.predicted_lang for r in langid.identify(same.limit(5), net).collect()} == {"en"}


def test_identification_is_the_mean_over_windows(spark):
    rng = random.Random(26)
    rows = [(k, " ".join(rng.choice(["der und", "the and", "les et"]) for _ in range(rng.randrange(1, 120))), "abc"[k % 3]) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(docs, langid.LangConfig(epochs=1))
    for r in langid.identify(docs.repartition(4), net).collect():
        raw, total = rows[r.doc_id][1].encode(), np.zeros(len(net.languages))
        for at in range(0, len(raw), net.window):
            part = raw[at : at + net.window]
            x = net.embed[np.frombuffer(part.ljust(net.window, b"\0"), np.uint8)]
            n = net.window - max(langid.WIDTHS) + 1
            pooled = np.concatenate([sum(x[k : k + n] @ w[k] for k in range(len(w))).max(0) for w in net.kernels])
            total += len(part) * langid.log_softmax((np.maximum(pooled + net.bias, 0) @ net.dense + net.dense_bias)[None])[0]
        p = np.exp(langid.log_softmax(total[None] / len(raw)))[0]
        assert r.confidence == pytest.approx(p.max(), abs=1e-3) and p[net.languages.index(r.predicted_lang)] == pytest.approx(p.max(), abs=1e-3)


# media


def test_files_that_follow_each_other():
    one, two = matroska.mux("a\nbb\nccc", "en"), matroska.mux("\n".join("xyz" * k for k in range(1, 9)), "de")
    whole = matroska.parse(one + two)
    first, second = matroska.parse(one), matroska.parse(two)
    assert whole.error is None and len(whole.packets) == len(first.packets) + len(second.packets)
    assert [p[:6] + p[8:] for p in whole.packets] == [p[:6] + p[8:] for p in first.packets + second.packets]
    assert [p[7] for p in whole.packets[len(first.packets) :]] == [p[7] + len(one) for p in second.packets]
    clusters = [p[6] for p in whole.packets]
    assert clusters == sorted(clusters) and clusters[-1] == 2


def test_frames_stay_in_their_block():
    data = b"\x81\x00\x00\x06\x03" + b"\x4f\xff" + b"q" * 50
    with pytest.raises(ValueError):
        matroska.frames(data, 0, 6)
    with pytest.raises(ValueError):
        matroska.frames(b"\x81\x00\x00\x02\x02\xff" + b"\xff" * 40, 0, 6)


# archives


def test_urls_and_ids_as_they_come(spark):
    urls = ["https://a.org/x", "https://a.org/\r\nWARC-Type: evil", " https://b.org ", "", None, "https://c.org/ü ß"]
    pages = spark.createDataFrame([(None if k == 0 else -k, u, f"<p>{k}</p>", "extra") for k, u in enumerate(urls)], "page_id long, url string, html string, record_type string")
    got = {r.payload: r for r in warc.records(warc.archive_pages(pages, None)).collect()}
    assert all(r.valid and r.record_type == "response" for r in got.values()) and len(got) == len(urls)
    assert [got[f"<p>{k}</p>"].url for k in range(6)] == ["https://a.org/x", "https://a.org/%0D%0AWARC-Type: evil", "%20https://b.org%20", None, None, "https://c.org/ü ß"]


def test_the_archive_query_reads_null_and_negative_ids(spark, tmp_path):
    spark.createDataFrame([(None, "u", "a"), (-5, None, None), (7, "v", "")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {(r.page_id, r.html) for r in warc.query(spark, str(tmp_path)).collect()} == {(None, "a"), (-5, ""), (7, "")}


def test_samples_have_the_least_keys(spark):
    from pyspark.sql import functions as F

    from quillmill.llm.sample import least

    rows = [(k % 50, f"v{k:03}") for k in range(200)] + [(0, "v000")] * 30 + [(None, "n")]
    df = spark.createDataFrame(rows, "k long, v string").where("k is not null").repartition(6)
    got = [r.value for r in least(df, F.col("k") % 50, F.col("v"), 60).collect()]
    assert got == [f"v{k:03}" for k in range(len(got))] and 1 <= len(got) <= 50
    assert least(df.limit(0), F.col("k"), F.col("v"), 5).count() == 0


# pages


@pytest.mark.parametrize("page", ["<a " * 350_000, "<b>" * 100_000, "<div>" * 1000 + "</b>" * 100_000, '<a ">" ' * 150_000, "<!" * 500_000, "<p><div>" + "<b>" * 50_000 + "<h1>" * 50_000, "<a x='" + "<i>" * 300_000])
def test_parsing_is_linear(page):
    began = time.time()
    (row,) = html.extract_pages([page], None)
    assert time.time() - began < 15 and row[2] >= 0


def test_attributes_with_brackets_and_open_quotes():
    tree = html.parse("<a title='x > y' class=\"k\">one</a><b title=\"2 < 3\">two</b><i title='open>three</i> 4 < 5")
    assert tree.tag == ["#root", "a", "b", "i"] and "class" in tree.attrs[1] and [t for _, t, _ in tree.pieces] == ["one", "two", "three", " 4 < 5"]


def test_extraction_is_the_page_by_page_brute_force(spark):
    rng = random.Random(27)
    pages = []
    for k in range(40):
        body = "".join(f"<p class='story'>{' '.join(words(rng, 30))}.</p>" for _ in range(rng.randrange(1, 4)))
        side = "".join(f"<li><a href='#'>{rng.choice(['home', 'news', 'buy'])}</a></li>" for _ in range(6))
        tag = "article" if k % 2 else "div"
        pages.append((k, f"u{k}", f"<html><title>T{k}</title><body><nav class='menu'><ul>{side}</ul></nav><{tag}>{body}</{tag}><footer>all rights</footer></body></html>"))
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    model = html.train(table)
    for r in html.extract(table.repartition(3), model).collect():
        tree = html.parse(pages[r.page_id][2])
        x = html.Pages([tree]).features
        p = []
        for row in x:
            score = model.base
            for f, c, leaf in zip(model.feature, model.cut, model.leaf):
                node = 0
                while node < len(f):
                    node = 2 * node + 1 + int(np.searchsorted(model.edges[f[node]], row[f[node]]) > c[node])
                score += leaf[node - len(f)]
            p.append(min(max(1 / (1 + np.exp(-score)), 1e-6), 1 - 1e-6))
        kids = {k: [j for j, q in enumerate(tree.parent) if q == k] for k in range(len(tree.tag))}

        def whole(k):
            return np.log(p[k]) + sum(map(whole, kids[k]))

        def best(k):
            below = [best(j) for j in kids[k]]
            apart = np.log1p(-p[k]) + sum(b[0] for b in below)
            return (whole(k), {k, *(j for j in range(len(p)) if inside(j, k))}) if whole(k) >= apart - 1e-12 else (apart, set().union(*(b[1] for b in below)))

        def inside(j, k):
            while j > k:
                j = tree.parent[j]
            return j == k

        chosen = best(0)[1]
        assert r.content_nodes == len(chosen) and r.title == f"T{r.page_id}"
        assert r.text == html._text(tree, np.array([k in chosen for k in range(len(p))]))

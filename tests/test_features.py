"""Further operators and cases: characters, lists as tables, TF-IDF, windows, presets, pages, resources, jobs."""

import json
import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmill import config, jobs, resources
from quillmill.functions import text as T
from quillmill.functions.dialect import SPARK
from quillmill.operators import content, decontaminate, domain, exact, html, language, license, model, near, pii, tfidf
from quillmill.sources import readers, writers
from quillmill.streaming import dedup

AWKWARD = "doc_id long, text string, t string, host string, rule string, low string, gram string"


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, an empty and a very long text, repeated rows, names that clash with those inside."""
    rows = [(0, "plain words here", "a", "b", "c", "d", "e"), (1, None, None, None, None, None, None), (2, "", "", "", "", "", ""), (3, "long " * 40_000, "a", "b", "c", "d", "e"), (None, "no id", "a", "b", "c", "d", "e")]
    return spark.createDataFrame([*rows, rows[0]], AWKWARD)


# leaks


def test_character_grams_against_brute_force(spark):
    rng = random.Random(41)
    texts = ["".join(rng.choice("aAbé 你") for _ in range(rng.randrange(60))) for _ in range(40)] + [None, ""]
    items = ["".join(rng.choice("ab é你") for _ in range(12)) for _ in range(6)]
    c = config.DecontaminationConfig(n=4, characters=True, case_insensitive=True, uncapped_score=True)
    flat = lambda x: " ".join("".join(ch.lower() if ch.isascii() else ch for ch in x).split(" ")) if x else ""
    flat = lambda x, f=flat: " ".join(f(x).split())
    grams = lambda x: [flat(x)[k : k + 4] for k in range(len(flat(x)) - 3)]
    known = {g for i in items for g in grams(i)}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: (r.total_ngrams, r.matched) for r in decontaminate.assess(docs(spark, texts), decontaminate.index(bench, config=c), c).collect()}
    assert got == {k: (len(grams(t)), sum(g in known for g in grams(t))) for k, t in enumerate(texts)}


def test_index_is_extended_and_thinned(spark, awkward):
    c = config.DecontaminationConfig(n=2, max_frequency=3, threshold=0.5)
    bench = spark.createDataFrame([(1, "a b c"), (2, None)], "item_id long, text string")
    index = decontaminate.index(bench, config=c)
    more = decontaminate.extend(index, spark.createDataFrame([("b c",), ("x y",), (None,)], "gram string"), "extra")
    assert {(r.gram, r.dataset) for r in more.collect()} == {("a b", "benchmark"), ("b c", "extra"), ("x y", "extra")}
    held = docs(spark, ["a b", "a b", "q a b", "x y", "b c d"])
    assert {r.gram for r in decontaminate.without_frequent(more, held, c).collect()} == {"b c", "x y"}
    assert {r.source: r.documents for r in decontaminate.by_dataset(decontaminate.assess(held, more, c)).collect()} == {"benchmark": 3, "extra": 2}
    one = config.DecontaminationConfig(n=1)
    assert {r.gram for r in decontaminate.index(spark.createDataFrame([(1, "the river and stone")], "item_id long, text string"), config=one).collect()} == {"river", "stone"}
    e = decontaminate.effectiveness(held, more, c).first()
    assert (e.flagged, e.before, e.after, e.removed_share) == (5, 5, 0, 1.0)
    kept = decontaminate.clean(awkward, more, c)
    assert kept.columns == awkward.columns and kept.count() == 6
    assert decontaminate.assess(awkward.limit(0), more, c).count() == 0 and decontaminate.assess(awkward, index.limit(0), c).where("matched > 0").count() == 0


def test_adaptive_and_approximate(spark):
    item = " ".join(f"w{k}" for k in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [item, " ".join(item.split()[:9]) + " other", "nothing in common at all", item.replace("w10", "edited") + "!", item.upper() + " tail"]
    got = {r.doc_id: (r.n, r.contaminated) for r in decontaminate.adaptive(docs(spark, texts), bench).collect()}
    assert got[0] == (16, True) and got[1] == (8, True) and got[2] == (8, False)
    near_ = {r.doc_id: r.containment for r in decontaminate.approximate(docs(spark, texts), bench, 0.8).collect()}
    assert near_ == {0: 1.0, 3: round(15 / 18, 6), 4: 1.0}


# TF-IDF


def test_tfidf_pairs_against_brute_force(spark, awkward):
    rng = random.Random(42)
    texts = [" ".join(rng.choice([f"r{k}", f"c{rng.randrange(4)}", f"m{rng.randrange(9)}"]) for _ in range(12)) for k in range(10) for _ in range(4)] + ["", None, "c0 c0", "c0"]
    texts += [texts[0]]
    c = config.SemanticConfig(threshold=0.6)
    counts = [Counter((t or "").split()) for t in texts]
    df = Counter(w for x in counts for w in x)
    vectors = []
    for x in counts:
        v = {w: n * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, n in x.items() if df[w] >= c.min_df}
        size = math.sqrt(sum(w * w for w in v.values()))
        vectors.append({k: w / size for k, w in v.items()})
    head = [next(j for j in range(k + 1) if vectors[j].keys() == v.keys() and all(abs(vectors[j][w] - v[w]) < 1e-12 for w in v)) for k, v in enumerate(vectors)]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if head[i] == i and head[j] == j and sum(w * vectors[j].get(k, 0) for k, w in vectors[i].items()) >= 0.6}
    assert {(r.id_a, r.id_b) for r in tfidf.pairs(docs(spark, texts), c).collect()} == want != set()
    kept = {r.doc_id for r in tfidf.deduplicate(docs(spark, texts), c).collect()}
    assert 40 in kept and 41 in kept and 44 not in kept and len(kept) < len(texts)
    assert tfidf.deduplicate(awkward).columns == awkward.columns and tfidf.pairs(awkward.limit(0)).count() == 0


# near and exact


def test_classes_and_hot_texts(spark, awkward):
    df = docs(spark, ["same text over and over again"] * 50 + ["another one that differs from it"] * 3 + ["alone"])
    assert near.minhash_pairs(df).count() == 0
    assert {(r.doc_id, r.class_id, r.size) for r in near.classes(near.signed(df)).where("doc_id in (0, 49, 52, 53)").collect()} == {(0, 0, 50), (49, 0, 50), (52, 50, 3), (53, 53, 1)}
    for method in ("minhash", "simhash"):
        assert sorted(r.doc_id for r in near.deduplicate(df, config.NearConfig(method=method)).collect())[0] == 0
    assert [r.weight for r in exact.soft_weights(df, config.SoftConfig(0.1, 0.5)).orderBy("doc_id").limit(6).collect()] == [1.0, 0.5, 0.25, 0.125, 0.1, 0.1]
    assert exact.soft_weights(awkward).count() == 6 and exact.soft_weights(awkward.limit(0)).count() == 0


# model and language


def test_windows_and_single_stage(spark):
    assert model.window_perplexities("a" * 20, 10, 5) == [10.0, 10.0, 10.0] and model.window_perplexities("12" * 20, 20, 20)[0] == pytest.approx(10 + 50 + 2 * (11 - 2))
    assert model.window_perplexities("short", 10, 5) == [] and model.window_perplexities(None, 10, 5) == []
    row = model.sliding_perplexity(docs(spark, ["x" * 10, None]), 4, 3).orderBy("doc_id").collect()
    assert row[0].windows == 3 and row[1].windows == 0 and row[1].mean_perplexity is None
    assert {r.result for r in model.single_stage(docs(spark, ["some text"]), 0.0).collect()} == {"KEEP"}


def test_plugged_in_language_model(spark, awkward):
    say = lambda text: F.struct(F.lit("xx").alias("language"), (F.length(text) / 100.0).alias("confidence"))
    got = {r.doc_id: (r.language, r.decision) for r in language.detect_with(docs(spark, ["y" * 90, "y" * 20, "y", None]), say).collect()}
    assert got == {0: ("xx", "keep"), 1: ("xx", "reject"), 2: ("unknown", "too_short"), 3: ("unknown", "too_short")}
    assert {r.language for r in language.detect_with(awkward, None).collect()} == {"unknown"}


# lists, licences, personal data, content


def test_lists_as_tables(spark):
    pages = spark.createDataFrame([(1, "https://bad.org/x", "t"), (2, "http://www.good.tk:80/y", "t"), (3, None, "t"), (4, "https://fine.org/", "t"), (1, "https://bad.org/x", "t")], "page_id long, url string, text string")
    lists = lambda *names: spark.createDataFrame([(n,) for n in names], "entry string")
    got = sorted((r.page_id, r.rule) for r in domain.with_lists(pages, lists("bad.org", " bad.org ", ""), lists("good.tk")).collect())
    assert got == [(1, "blocklist"), (1, "blocklist"), (2, "allowlist"), (3, "reputation"), (4, "passed")]
    same = domain.domain_filter(config.DomainConfig(blocked=("bad.org",), allowed=("good.tk",))).spark(pages)
    assert sorted(map(str, same.collect())) == sorted(map(str, domain.with_lists(pages, lists("bad.org"), lists("good.tk")).collect()))
    found = {r.page_id: r.rule for r in license.with_lists(pages, "url", key="page_id", opted_out=lists("fine.org"), removals=lists("2")).collect()}
    assert found == {1: "domain", 2: "removal", 3: "domain", 4: "opt_out"}
    assert domain.with_lists(pages.limit(0), lists("x"), lists()).count() == 0


def test_robots_and_meta(spark):
    rules = "User-agent: a\nUser-agent: b\nDisallow: /private\nAllow: /private/open\n\nUser-agent: *\nDisallow: /*.pdf$ # files\n"
    assert not license.robots_allows(rules, "/private/x", "b") and license.robots_allows(rules, "/private/open/x", "a") and license.robots_allows(rules, "/private/x", "other")
    assert not license.robots_allows(rules, "/y.pdf") and license.robots_allows(rules, "/y.pdf?z") and license.robots_allows(None, "/")
    pages = spark.createDataFrame([(1, '<meta name="robots" content="index, noai">'), (2, "<meta name='robots' content='all'>"), (3, None)], "page_id long, html string")
    assert {r.page_id: r.x for r in pages.select("page_id", F.expr(license.forbids_by_meta("html")).alias("x")).collect()} == {1: True, 2: False, 3: False}
    assert license.is_open("MIT") and not license.is_open("GPL_V3") and license.NAMES["GPL_V2"] == "GPL v2"


def test_government_ids_have_a_switch():
    text = "his number is AB123456C here"
    assert pii.detect(text) == [] and [k for k, *_ in pii.detect(text, config.PiiConfig(government_ids=True))] == ["GOVERNMENT_ID"]
    assert [k for k, *_ in pii.detect("account GB29 NWBK 6016 1331 9268 19", patterns=resources.patterns())] == ["IBAN"]


def test_content_strategies_merge_and_cases(spark, awkward):
    df = docs(spark, ["you idiot moron loser stupid pathetic worthless clown", "write to anna@firm.org today", "a calm day", None])
    strict = content.process(df)
    assert {r.doc_id: r.final_result for r in strict.collect()} == {0: "REJECT", 1: "SANITIZE", 2: "KEEP", 3: "KEEP"}
    loose = content.process(df, config.ContentConfig(strategy="score", threshold=0.0))
    assert {r.final_result for r in loose.collect()} == {"KEEP", "SANITIZE"}
    assert {r.doc_id: r.text for r in content.merged(df, strict).collect()} == {1: "write to [EMAIL] today", 2: "a calm day", 3: None}
    assert content.merged(awkward, content.process(awkward)).columns == awkward.columns
    for settings, private in content.PRESETS.values():
        assert content.process(df, settings, private=private).count() == 4
    assert content.process(df.limit(0)).count() == 0
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, toxic int")
    assert tuple(content.toxicity_accuracy(df, labels).first()) == (3, 2, 1, 1, 1.0, 0.5)
    own = config.ToxicityConfig(lexicon={"threat": ["calm day"]})
    assert {r.doc_id for r in content.toxicity(own).spark(df).where("categories like '%threat%'").collect()} == {2}


# pages and texts


def test_the_best_element_is_the_content():
    page = '<html lang="fr"><head><title>A Title</title><meta name="Author" content="Someone"></head><body><h1>Big words</h1><p>Here stands what the page is about.</p><nav>One | Two</nav><footer>Rights 2020</footer></body></html>'
    got = html.extract_page(page)
    assert got[:3] == ("A Title", "Here stands what the page is about.", ["Big words"]) and got[9] == "fr" and got[11] == {"author": "Someone"} and got[10] > 0
    assert "Big words" in html.extract_page(page, "subtree")[1]
    assert html.clean_text("cafÃ© – x") == "café - x"
    for deep in ("<div>" * 60_000 + "x", "<p>a</p><nav>b</nav>" * 20_000, "<b>" * 600 + "</i>" * 60_000):
        began = time.time()
        html.extract_page(deep)
        assert time.time() - began < 20
    assert html.extract_page(None)[:2] == ("", "") and html.extract_page("")[7] is False


def test_texts_of_pages(spark):
    df = spark.createDataFrame([(1, '<meta name="author" content="X"><META charset=a><p>a &lt; b&nbsp;&amp;  c</p>'), (2, None)], "page_id long, html string")
    got = {r.page_id: r for r in T.STRIPPED.spark(df).collect()}
    assert got[1].stripped == "a < b & c" and got[1].meta_tags == 2 and got[1].author == "X" and got[2].stripped == "" and got[2].meta_tags == 0
    raw = spark.createDataFrame([(b"\xef\xbb\xbfx",), (b"\xff\xfea",), (b"\xfe\xffa",), (b'<meta charset="KOI8-R">',), (b"plain",), ("é".encode(),)], "raw binary")
    assert [r.e for r in raw.select(F.expr(T.encoding_of_bytes("raw")).alias("e")).collect()] == ["utf-8", "utf-16le", "utf-16be", "koi8-r", "ascii", "utf-8"]
    assert spark.range(1).select(F.expr(T.meta_content(SPARK, "'<meta name=\"k\" content=\"v\">'", "k")).alias("x")).first().x == "v"


# sources, sinks, streams, jobs


def test_more_readers_and_writers(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"Data": [{"Question": "q?", "Answer": {"Value": "v"}}, {"Question": ""}]}')
    assert sorted(r.text for r in readers.read_trivia(spark, str(tmp_path / "t.json")).collect()) == ["q?", "v"]
    (tmp_path / "p.tsv").write_text('index\tsentence1\tsentence2\n0\ta "b"\tc\n1\td\t\n')
    assert sorted(r.text for r in readers.read_sentence_pairs(spark, str(tmp_path / "p.tsv")).collect()) == ['a "b"', "c", "d"]
    (tmp_path / "l.txt").write_text("x\ny\n")
    assert [tuple(r) for r in readers.read_record_lines(spark, str(tmp_path / "l.txt")).orderBy("id").collect()] == [("doc_0", "x"), ("doc_1", "y")]
    df = spark.createDataFrame([(k, f"t{k}", 0.5) for k in range(5)], "doc_id long, text string, weight double")
    writers.write_json_array(df.repartition(2), str(tmp_path / "j"))
    back = [x for f in (tmp_path / "j").glob("*.txt") for x in json.loads(f.read_text())]
    assert sorted(x["doc_id"] for x in back) == list(range(5))
    writers.write_list(df, "text", str(tmp_path / "list"))
    assert readers.read_list(spark, str(tmp_path / "list")).count() == 5
    pages = html.extract(spark.createDataFrame([(1, "u", "<title>T</title><p>body of the page</p>"), (2, None, None)], "page_id long, url string, html string"))
    writers.write_text_blocks(pages, str(tmp_path / "b"))
    text = "".join(f.read_text() for f in (tmp_path / "b").glob("*.txt"))
    assert "=== Document 1 ===\nURL: u\nTitle: T\nLength: 16 characters\n" in text and "body of the page" in text
    writers.write_report(html.report(pages), pages.select("page_id"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/detail")).count() == 2
    index = decontaminate.index(spark.createDataFrame([(1, "a b")], "item_id long, text string"), config=config.DecontaminationConfig(n=2))
    writers.write_matches(decontaminate.matches(docs(spark, ["a b"]), index, config.DecontaminationConfig(n=2)), str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), header=True).first().gram == "a b"
    many = tmp_path / "many"
    many.mkdir()
    for k in range(3):
        (many / f"{k}.txt").write_text("".join(f"{k}-{j}\n" for j in range(100)))
    assert sorted(r.doc_id for r in readers.read_lines(spark, str(many)).collect()) == list(range(300))


def test_streams_with_a_watermark_and_filters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"text": "x", "at": "2024-01-01T00:00:00Z", "t": 1}\n{"text": "x", "at": "2024-01-01T00:01:00Z", "t": 2}\n{"text": "", "at": "2024-01-01T00:01:00Z", "t": 3}\n{"text": "the cat is in the house and it was good", "at": "2024-01-01T00:02:00Z", "t": 4}\n')
    stream = spark.readStream.schema("text string, at timestamp, t int").json(str(tmp_path / "in"))
    for name, made in (("within", dedup.deduplicate_within(stream, "at", "10 minutes")), ("kept_language", dedup.filtered(stream, language.FILTER, "decision = 'keep'"))):
        query = made.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    assert sorted(r.text for r in spark.table("within").collect()) == ["the cat is in the house and it was good", "x"]
    assert [r.t for r in spark.table("kept_language").collect()] == [4]


def test_jobs(spark, tmp_path, capsys):
    (tmp_path / "d.txt").write_text("one line\none line\nanother line of words\n")
    assert jobs.run(spark, ["exact", str(tmp_path / "d.txt"), str(tmp_path / "o"), "--format", "txt"]).count() == 2
    assert spark.read.text(str(tmp_path / "o")).count() == 2
    jobs.run(spark, ["quality", str(tmp_path / "d.txt"), "--analyze"])
    assert "final_result" in capsys.readouterr().out
    (tmp_path / "bench.txt").write_text("another line of words\n")
    config.save_config(config.DecontaminationConfig(n=3), str(tmp_path / "c.json"))
    assert jobs.run(spark, ["decontaminate", str(tmp_path / "d.txt"), str(tmp_path / "k"), "--benchmark", str(tmp_path / "bench.txt"), "--config", str(tmp_path / "c.json")]).count() == 2
    assert jobs.run(spark, ["content", str(tmp_path / "d.txt"), str(tmp_path / "s"), "--preset", "research"]).count() == 3
    with pytest.raises(SystemExit):
        jobs.run(spark, ["exact", str(tmp_path / "d.txt")])


def test_resources(tmp_path):
    assert content.LEXICON == resources.keywords() and "spam-site.com" in domain.DEFAULT_BLOCKED
    (tmp_path / "x.txt").write_text("# c\nthreat: Be Warned\nbad line\n")
    assert resources.keywords(str(tmp_path / "x.txt")) == {"threat": ["be warned"]}
    c = config.DecontaminationConfig.strict()
    assert (c.n, c.threshold) == (8, 0.01) and config.DecontaminationConfig.fast().max_matches == 10 and config.LicenseConfig.strict_preset().strict

"""Matroska, WARC and HTML: exact round trips, faults, held-out accuracy."""

import random

import pytest

from quillmill.llm import html, matroska, warc


def test_lacings_round_trip():
    rng = random.Random(1)
    for lacing in (0, 1, 2, 3):
        for _ in range(40):
            n = 1 if lacing == 0 else rng.randrange(1, 9)
            size = rng.randrange(0, 700)
            parts = [bytes(size if lacing == 2 else rng.choice([0, 3, 254, 255, 256, 600])) for _ in range(n)]
            raw = matroska.block(5, -7, parts, lacing)
            track, time, flags, ranges = matroska.frames(raw, 0, len(raw))
            assert (track, time, flags >> 1 & 3) == (5, -7, lacing) and [raw[a : a + s] for a, s in ranges] == parts


def test_files_round_trip_and_faults(spark):
    text = "\n".join(f"line {k} é" for k in range(23))
    raw = matroska.mux(text, "fr")
    found = matroska.parse(raw)
    assert found.error is None and found.tracks[1]["language"] == "fr"
    lines = [raw[p[7] : p[7] + p[8]].decode() for p in found.packets if p[0] == 1]
    assert lines == text.split("\n")
    assert [p[2] for p in found.packets if p[0] == 1] == [k * 10**9 for k in range(23)]
    assert [int.from_bytes(raw[p[7] : p[7] + p[8]], "big") for p in found.packets if p[0] == 2] == [len(x.encode()) for x in text.split("\n")]
    for cut in range(0, len(raw), 13):
        part = matroska.parse(raw[:cut])
        assert len(part.packets) <= len(found.packets)
    assert matroska.parse(b"junk").error and matroska.parse(b"").error
    df = spark.createDataFrame([(1, None, None), (2, "", "en"), (None, "a\nb", "en"), (3, "x" * 200_000, None), (3, "x", None)], "doc_id long, text string, lang string")
    got = matroska.packets(matroska.mux_documents(df), "media", "doc_id").collect()
    assert {r.doc_id for r in got} == {None, 3} and not [r for r in got if r.error]
    bad = spark.createDataFrame([(9, b"junk"), (8, None), (7, b"")], "doc_id long, media binary")
    assert [(r.doc_id, r.track) for r in matroska.packets(bad, "media", "doc_id").collect() if r.error] == [(9, None)]
    assert matroska.packets(matroska.mux_documents(df.limit(0)), "media", "doc_id").count() == 0


def test_archives_round_trip_and_faults(spark):
    rng = random.Random(2)
    rows = [(k, f"http://h{k}.example/", "<p>" + " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(200)) + f" {k}</p>") for k in range(60)] + [(60, None, None), (61, "u", ""), (61, "u", ""), (62, "v", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    trained = warc.train_dictionary(pages)
    assert trained
    got = warc.records(warc.archive_pages(pages, trained, 7)).collect()
    assert sorted((r.url or "", r.payload) for r in got) == sorted((u or "", h or "") for _, u, h in rows) and all(r.valid for r in got)
    one = warc.write_archive([warc.write_record("u", b"body", "<urn:x>"), warc.write_record("w", b"more", "<urn:y>")], trained)
    whole = list(warc.read_archive(one))
    assert one[whole[1][1] : whole[1][1] + whole[1][2]] and whole[0][1] + whole[0][2] == whole[1][1]
    assert not list(warc.read_archive(one[:-3]))[-1][-2]
    raw = warc.write_record("u", b"body", "<urn:x>")
    for broken in (raw.replace(b"WARC/1.1", b"WARX/1.1"), raw.replace(b"body", b"bodies"), raw.replace(b"WARC-Date", b"X-Date"), raw.replace(b"body", b"bodx")):
        assert [r[-2] for r in warc.read_archive(warc.write_archive([broken, raw], None))] == [False, True]
    assert list(warc.read_archive(b"")) == [] and not list(warc.read_archive(b"nonsense"))[0][-2]
    assert warc.records(warc.archive_pages(pages.limit(0), None)).count() == 0


def page(rng, k):
    menu = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("home", "about", "news"))
    body = "".join(f"<p>Sentence {i} of page {k}, {' '.join(rng.choice(['river', 'stone', 'cloud']) for _ in range(15))}.</p>" for i in range(rng.randrange(3, 7)))
    tag = "article" if k % 2 else "main"
    return f"<!DOCTYPE html><html><head><title>T{k}</title><script>var a='</p>';</script></head><body><!-- c --><nav class='menu'><ul>{menu}</ul></nav><{tag}><h1>Head {k}</h1>{body}</{tag}><div class='ad'>Buy now<br>cheap</div><footer>Rights {k}</footer></body></html>"


def test_extraction_held_out_and_edges(spark):
    rng = random.Random(3)
    rows = [(k, f"u{k}", page(rng, k)) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    model = html.train(pages.where("page_id < 30"))
    held = html.extract(pages.where("page_id >= 30"), model).collect()
    assert all(r.title == f"T{r.page_id}" and "Sentence 0 of page" in r.text and "Buy now" not in r.text and "home" not in r.text and "Rights" not in r.text for r in held)
    odd = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "no tags"), (None, "u", "<p>a</i></div><b>x"), (4, "u", "<div>" * 3000 + "deep"), (4, "u", "<")], "page_id long, url string, html string")
    got = html.extract(odd, model).collect()
    assert len(got) == 6 and [r.text for r in got if r.page_id in (1, 2)] == ["", ""]
    assert html.extract(odd.limit(0), None).count() == 0 and html.train(odd) is None
    assert [r.text for r in html.extract(odd, None).collect() if r.page_id == 3] == ["no tags"]


def test_decoding_is_the_best_consistent_labelling():
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    forest = html.Pages([html.parse("<div><p>a<b>x</b></p><ul><li>y</li><li>z</li></ul></div>")])
    n = len(forest.page)
    for _ in range(10):
        p = rng.random(n)
        best = max((x for x in itertools.product([0, 1], repeat=n) if all(x[k] >= x[forest.parent[k]] for k in range(1, n))), key=lambda x: sum(np.log(q if v else 1 - q) for v, q in zip(x, p)))
        assert forest.decode(p).tolist() == [bool(v) for v in best]
    with pytest.raises(Exception):
        html.parse(None)

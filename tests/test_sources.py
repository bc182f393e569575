"""Readers, writers and streams."""

from quillmill.sources import readers, writers
from quillmill.streaming import dedup


def test_lines_and_csv(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo\nthree\n")
    assert [tuple(r) for r in readers.read_documents(spark, str(tmp_path / "a.txt")).orderBy("doc_id").collect()] == [(0, "one"), (1, "two"), (2, "three")]
    (tmp_path / "a.csv").write_text('id,text\n1,"a, b"\n2,\n3,"say ""x"""\n')
    assert [r.text for r in readers.read_csv(spark, str(tmp_path / "a.csv")).orderBy("doc_id").collect()] == ["a, b", 'say "x"']
    try:
        readers.read_csv(spark, str(tmp_path / "a.csv"), "body")
        raise AssertionError
    except ValueError:
        pass


def test_records_pages_lists(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"id": "1", "text": "t", "metadata": {"k": "v"}}, {"url": "u"}]')
    got = sorted(map(tuple, readers.read_records(spark, str(tmp_path / "r.json")).select("id", "text", "url", "metadata").collect()))
    assert got == [("", "", "u", {}), ("1", "t", "", {"k": "v"})]
    (tmp_path / "h" / "sub").mkdir(parents=True)
    (tmp_path / "h" / "a.HTML").write_text("<p>\nx</p>")
    (tmp_path / "h" / "sub" / "b.htm").write_text("y")
    (tmp_path / "h" / "c.txt").write_text("z")
    assert sorted(r.html for r in readers.read_html(spark, str(tmp_path / "h")).collect()) == ["<p>\nx</p>", "y"]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "quiz.txt").write_text("# c\nitem one\n\nitem two\n")
    assert {(r.text, r.dataset) for r in readers.read_benchmark(spark, str(tmp_path / "b")).collect()} == {("item one", "quiz"), ("item two", "quiz")}
    (tmp_path / "l.txt").write_text("# c\nx.org\ty\nz.org\n")
    assert sorted(map(tuple, readers.read_list(spark, str(tmp_path / "l.txt")).collect())) == [("x.org", "y"), ("z.org", None)]
    (tmp_path / "v.vec").write_text("2 3\ncat 1 x 2.5\ncat 9\n")
    assert {r.word: r.vec for r in readers.read_vectors(spark, str(tmp_path / "v.vec")).collect()} == {"2": [3.0], "cat": [1.0, 2.5]}
    (tmp_path / "q.json").write_text('{"data": [{"title": "t", "paragraphs": [{"context": "c", "qas": [{"question": "q", "answers": [{"text": "a", "answer_start": 0}]}]}]}]}')
    assert sorted(r.text for r in readers.read_question_paragraphs(spark, str(tmp_path / "q.json")).collect()) == ["a", "c", "q"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a, "b"', 0.5)], "doc_id long, text string, weight double")
    for kind in ("txt", "csv", "json", "parquet"):
        writers.write_documents(df, str(tmp_path / kind), kind)
    assert readers.read_csv(spark, str(tmp_path / "csv")).first().text == 'a, "b"'
    writers.write_results(df, str(tmp_path / "w"))
    assert spark.read.csv(str(tmp_path / "w"), header=True).columns == ["document", "weight"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x\ny\nx\n\n")
    stream = spark.readStream.text(str(tmp_path / "in"))
    query = dedup.deduplicate(stream, "value").writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    (tmp_path / "in" / "b.txt").write_text("y\nz\n")
    query.processAllAvailable()
    query.stop()
    assert sorted(r.value for r in spark.table("kept").collect()) == ["x", "y", "z"]

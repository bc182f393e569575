"""Readers of corpora, pages, benchmarks, lists and word vectors. Each gives a DataFrame; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quillmill.runtime import materialize

RECORD = "id string, text string, url string, domain string, content_type string, source_ip string, metadata map<string,string>"


def _numbered(lines: DataFrame) -> DataFrame:
    """Consecutive numbers in reading order: counts by partition, then an offset for each, without one task for all rows.

    The lines are written once, with the place that their task gave them, so that both passes see the same partitions.
    """
    held = materialize(lines.select("value", F.monotonically_increasing_id().alias("m")).select("value", F.shiftright("m", 33).alias("p"), "m"))
    sizes = held.groupBy("p").agg(F.count("*").alias("c"))
    offset = sizes.select("p", F.coalesce(F.sum("c").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))  # a row for each split
    return held.join(F.broadcast(offset), "p").select((F.col("offset") + F.col("m") - F.shiftleft("p", 33)).alias("doc_id"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, text``: a document for each line that isn't empty."""
    return _numbered(spark.read.text(path).where("value <> ''"))


def read_csv(spark: SparkSession, path: str, text_column: str = "text") -> DataFrame:
    """``doc_id, text`` from a column of a CSV with a header; quoted commas and line ends are text."""
    table = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    if text_column not in table.columns:
        raise ValueError(f"{path} has no column {text_column}")
    return _numbered(table.select(F.col(f"`{text_column}`").alias("value")).where("value is not null and value <> ''"))


def read_documents(spark: SparkSession, path: str, text_column: str = "text") -> DataFrame:
    """By the ending: .txt, .csv, .json or .parquet."""
    if path.endswith(".txt"):
        return read_lines(spark, path)
    if path.endswith(".csv"):
        return read_csv(spark, path, text_column)
    if path.endswith(".json"):
        return read_records(spark, path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {path}")


def read_record_lines(spark: SparkSession, path: str) -> DataFrame:
    """``id, text`` with ids ``doc_0``, ``doc_1`` ..."""
    return read_lines(spark, path).select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), "text")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records; what is missing is empty."""
    rows = spark.read.schema(RECORD).json(path, multiLine=True)
    strings = [x.split()[0] for x in RECORD.split(", ")[:-1]]
    return rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in strings), F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """``url, html``: every .html or .htm file below ``path``, whole."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path)
    return files.select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html")).where(r"lower(url) rlike '\\.html?$'")


def read_benchmark(spark: SparkSession, path: str, datasets: dict[str, str] | None = None) -> DataFrame:
    """``item_id, text, dataset``: lines that are neither empty nor comments; the dataset is the file's stem unless ``datasets`` names it."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("stem"))
    lines = lines.where("value <> '' and not startswith(value, '#')")
    name = F.col("stem")
    for stem, dataset in (datasets or {}).items():
        name = F.when(F.col("stem") == stem, dataset).otherwise(name)
    return lines.select(F.monotonically_increasing_id().alias("item_id"), F.col("value").alias("text"), name.alias("dataset"))


def read_question_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """``text`` of contexts, questions and answers of a nested question-answering file."""
    schema = "data array<struct<title: string, paragraphs: array<struct<context: string, qas: array<struct<question: string, answers: array<struct<text: string, answer_start: bigint>>>>>>>>"
    p = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("data").alias("d")).select(F.explode("d.paragraphs").alias("p"))
    q = p.select(F.explode("p.qas").alias("q"))
    return p.select(F.col("p.context").alias("text")).unionByName(q.select(F.col("q.question").alias("text"))).unionByName(q.select(F.explode("q.answers.text").alias("text"))).where("text <> ''")


def read_trivia(spark: SparkSession, path: str) -> DataFrame:
    """``text`` of the questions and answers of a trivia file: ``{"Data": [{"Question", "Answer": {"Value"}}]}``."""
    rows = spark.read.schema("Data array<struct<Question: string, Answer: struct<Value: string>>>").json(path, multiLine=True).select(F.explode("Data").alias("d"))
    return rows.select(F.explode(F.array("d.Question", "d.Answer.Value")).alias("text")).where("text <> ''")


def read_sentence_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``text`` of all sentence columns (``sentence...``, ``question...``, ``premise``, ``hypothesis``) of a tab-separated file with a header."""
    table = spark.read.csv(path, sep="\t", header=True, quote="")
    names = [c for c in table.columns if c.lower().startswith(("sentence", "question")) or c.lower() in ("premise", "hypothesis")]
    if not names:
        raise ValueError(f"{path} has no sentence column")
    return table.select(F.explode(F.array(*(F.col(f"`{c}`") for c in names))).alias("text")).where("text <> ''")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """``entry, reason`` of lines ``entry`` or ``entry<TAB>reason``; comments are skipped."""
    lines = spark.read.text(path).where("value <> '' and not startswith(value, '#')")
    parts = F.split("value", "\t", 2)
    return lines.select(parts[0].alias("entry"), F.try_element_at(parts, F.lit(2)).alias("reason"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``word, vec`` from a text file of word vectors; what isn't a number is skipped, of equal words the first stays."""
    parts = F.split(F.trim("value"), r"\s+")
    vec = F.expr("filter(transform(slice(p, 2, greatest(0, size(p) - 1)), x -> try_cast(x AS FLOAT)), x -> x IS NOT NULL)")
    rows = spark.read.text(path).select(parts.alias("p"), F.monotonically_increasing_id().alias("m")).where("p[0] <> ''").select(F.col("p")[0].alias("word"), vec.alias("vec"), "m")
    return rows.groupBy("word").agg(F.min_by("vec", "m").alias("vec"))

"""Writers: text, CSV, JSON lines, results with weights, reports and lists."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


#: Every character of a text as it is; by default blanks at the ends of a value go.
_CSV = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_documents(docs: DataFrame, path: str, kind: str = "txt", mode: str = "overwrite") -> None:
    """The text column as lines (line ends in a text become spaces), as quoted CSV, JSON lines or Parquet with all columns."""
    if kind == "txt":
        docs.select(F.regexp_replace("text", r"[\r\n]+", " ").alias("value")).write.mode(mode).text(path)
    elif kind == "csv":
        docs.select("text").write.mode(mode).csv(path, **_CSV)
    elif kind == "json":
        docs.write.mode(mode).json(path)
    elif kind == "parquet":
        docs.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"no writer for {kind}")


def write_json_array(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A JSON array in each file, one record a line, indented; an empty task writes an empty array."""

    def lines(batches):
        first = True
        for batch in batches:
            rows = [x if first and k == 0 else "," + x for k, x in enumerate(batch.column(0).to_pylist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array((["["] if first else []) + rows)], names=["value"])
                first = False
        yield pa.RecordBatch.from_arrays([pa.array(["[", "]"] if first else ["]"])], names=["value"])

    docs.select(F.concat(F.lit("  "), F.to_json(F.struct("*"))).alias("value")).mapInArrow(lines, "value string").write.mode(mode).text(path)


def write_text_blocks(extracted: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A block of title line, figures and text for each page of ``html.extract``."""
    head = F.concat(F.lit("=== Document "), F.col("page_id").cast("string"), F.lit(" ==="))
    url = F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("URL: "), "url"))
    title = F.when(F.coalesce("extracted.title", F.lit("")) != "", F.concat(F.lit("Title: "), "extracted.title"))
    length = F.concat(F.lit("Length: "), F.octet_length("extracted.text").cast("string"), F.lit(" characters"))
    score = F.concat(F.lit("Quality Score: "), F.format_number("extracted.quality_score", 3))
    extracted.select(F.concat_ws("\n", head, url, title, length, score, F.lit(""), "extracted.text", F.lit("")).alias("value")).write.mode(mode).text(path)


def write_matches(matches: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The n-gram matches of documents as quoted CSV."""
    matches.select("doc_id", "position", "gram", "dataset").write.mode(mode).csv(path, **_CSV)


def write_results(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``document`` and, where there is one, ``weight``."""
    columns = [F.col("text").alias("document"), *([F.col("weight")] if "weight" in docs.columns else [])]
    docs.select(*columns).write.mode(mode).csv(path, **_CSV)


def write_list(entries: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    entries.select(F.col(column).cast("string").alias("value")).write.mode(mode).text(path)


def write_report(summary: DataFrame, detail: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``summary`` and ``detail`` as JSON lines below ``path``."""
    summary.write.mode(mode).json(f"{path}/summary")
    detail.write.mode(mode).json(f"{path}/detail")

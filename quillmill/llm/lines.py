"""Line deduplication by overlapping windows of three lines.

Every three consecutive lines of a document (lines end at ``\\n``; spaces at the
ends of a line don't count) are hashed to 128 bits. Where a window occurs more
than once in the corpus, the occurrence with the least ``(doc_id, position)``
stays and every later one is removed; overlapping removed windows merge, since it
is positions that are removed.

Two narrow shuffles carry hashes and positions, never text: a count per window,
with map-side combine, so that a window in a billion documents is one row from
each task; then a join of the repeated windows alone with all occurrences, in
which adaptive execution splits a hot window. The text meets the removed
positions in one join by ``doc_id``.

Defined cases: a null or empty text, and one of fewer than three lines, has no
window and stays; windows of blank lines alone don't count; rows that share a
``doc_id`` are one document, so that equal windows at equal positions in them
are no repetition; a row without ``doc_id`` stays as it is; an empty table gives
an empty table; other columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillmill.runtime import broadcast_if_small, materialize, read_table

WINDOW = 3


def _windows(docs: DataFrame) -> DataFrame:
    """``id, at, h1, h2`` of every window of three lines that aren't all blank."""
    line = F.transform(F.split("text", "\n"), lambda x: F.trim(x))
    return (
        docs.select(F.col("doc_id").alias("id"), line.alias("line"))
        .where("id is not null and size(line) >= 3")
        .select("id", F.posexplode_outer(F.expr("transform(slice(line, 1, size(line) - 2), (x, i) -> struct(x AS a, line[i + 1] AS b, line[i + 2] AS c))")).alias("at", "w"))
        .where("length(w.a) + length(w.b) + length(w.c) > 0")  # the outer explode: for the inner one Catalyst infers a filter that splits the text again for every line
        .select("id", "at", F.xxhash64("w.a", "w.b", "w.c").alias("h1"), F.xxhash64(F.lit(7), "w.c", "w.a", F.lit(1), "w.b").alias("h2"))
    )


def removed_positions(docs: DataFrame) -> DataFrame:
    """``id`` and the sorted positions, from 0, of the lines that go."""
    windows = _windows(docs)
    repeated = windows.groupBy("h1", "h2").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = windows.join(repeated.drop("n"), ["h1", "h2"]).where("struct(id, at) > first")
    return (
        later.select("id", F.explode(F.array(*(F.col("at") + k for k in range(WINDOW)))).alias("at"))
        .groupBy("id").agg(F.array_sort(F.collect_set("at")).alias("gone"))
    )


def _cut(text: str) -> Column:
    """``lines``, how many lines the text has, and ``text``, what is left of it without the sorted positions ``gone``: null if nothing is.

    The lines between two that go are taken as one slice, so that the work is in proportion to the lines.
    """
    before = "IF(i = 0, 0, z.g[i - 1] + 1)"
    runs = f"concat(transform(z.g, (x, i) -> struct({before} AS s, x - {before} AS n)), array(struct(element_at(z.g, -1) + 1 AS s, size(z.l) - element_at(z.g, -1) - 1 AS n)))"
    kept = f"flatten(transform(filter({runs}, r -> r.n > 0), r -> slice(z.l, r.s + 1, r.n)))"
    whole = f"struct(size(z.l) AS lines, CASE WHEN size(z.g) < size(z.l) THEN array_join({kept}, '\n') END AS text)"
    # a lambda's variable is computed once, whatever refers to it
    return F.expr(f"transform(array(struct(split({text}, '\n') AS l, gone AS g)), z -> {whole})[0]")


def report(docs: DataFrame) -> DataFrame:
    """The documents that lose lines: ``doc_id, n_lines, removed_lines, text`` with the text that is left."""
    return (
        docs.select("doc_id", "text").join(removed_positions(docs), F.col("doc_id") == F.col("id"))
        .select("doc_id", F.size("gone").alias("removed_lines"), _cut("text").alias("cut"))
        .select("doc_id", F.col("cut.lines").alias("n_lines"), "removed_lines", F.coalesce("cut.text", F.lit("")).alias("text"))
    )


def deduplicate_lines(docs: DataFrame) -> DataFrame:
    """The documents, in the columns they have, without repeated lines; one that loses all its lines goes."""
    names = docs.columns
    numbered = docs.toDF(*(f"c{k}" for k in range(len(names))))
    of = {n: f"c{k}" for k, n in enumerate(names)}
    joined = numbered.join(broadcast_if_small(materialize(removed_positions(docs.select("doc_id", "text")))), F.col(of["doc_id"]) == F.col("id"), "left")
    text = F.when(F.col("gone").isNull(), F.col(of["text"])).otherwise(_cut(of["text"])["text"])
    return joined.withColumn(of["text"], text).where(f"gone IS NULL OR {of['text']} IS NOT NULL").select(*(F.col(c).alias(n) for n, c in of.items()))


def query(spark, sf_dir: str) -> DataFrame:
    return report(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH line AS (
  SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')) AS l FROM documents WHERE text IS NOT NULL
), win AS (
  SELECT doc_id, p, l[p] AS a, l[p + 1] AS b, l[p + 2] AS c FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS p FROM line WHERE len(l) >= 3)
), later AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS k FROM win WHERE length(a) + length(b) + length(c) > 0
), gone AS (
  SELECT doc_id, list(DISTINCT q) AS qs FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM later WHERE k > 1) GROUP BY doc_id
), cut AS (
  SELECT doc_id, string_split(text, chr(10)) AS raw, qs FROM line JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(len(raw) AS INTEGER) AS n_lines, CAST(len(qs) AS INTEGER) AS removed_lines,
       coalesce(array_to_string(list_transform(list_filter(range(1, len(raw) + 1), lambda i: NOT list_contains(qs, i)), lambda i: raw[i]), chr(10)), '') AS text
FROM cut
"""

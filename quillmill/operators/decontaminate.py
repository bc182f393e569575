"""Overlap with benchmarks by n-grams of words or characters: index, matches, assessment and reports.

The n-grams of the benchmarks, deduplicated, meet those of the documents whose hash is in a bitmap of
bounded size in an equi-join; an index of checked size is broadcast. A text of fewer than ``n`` words (or
characters) has no n-gram. Null counts as empty; rows that share a ``doc_id`` are one document for
the counts; an empty index matches nothing; other columns, whatever their names, pass through ``clean``.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillmill.config import DecontaminationConfig
from quillmill.functions import grams as windows
from quillmill.functions.dialect import BLANK, DUCK, PUNCT, SPARK, Dialect
from quillmill.runtime import broadcast_if_small, materialize

#: Single words that no index holds; they can only match where ``n`` is 1.
COMMON = tuple("a all also an and are as at be been but by can do for from had has have he her his i if in is it its more no not of on one or our she so than that the their there they this to up was we were which who will with would you your".split())


def units(d: Dialect, x: str, c: DecontaminationConfig = DecontaminationConfig()) -> str:
    """The words, or the characters, of ``x``."""
    if c.case_insensitive:
        x = d.lower(x)
    if c.remove_punctuation:
        x = d.sub(x, f"[{PUNCT}]+", "")
    if c.characters:
        return d.characters(d.blanks(x) if c.normalize_whitespace else x)
    return d.all(x, f"[^{BLANK}]+")


def _windows(d: Dialect, c: DecontaminationConfig) -> str:
    made = d.windows("__w", c.n)
    return made.replace("' ')", "'')") if c.characters else made


def _exploded(frame: DataFrame, text: str, c: DecontaminationConfig, *keep) -> DataFrame:
    # callers explode with the outer form: for the inner one Catalyst infers a filter that repeats the n-grams with the words inlined
    return frame.select(*keep, F.expr(units(SPARK, f"coalesce({text}, '')", c)).alias("__w")).select(*keep, F.expr(_windows(SPARK, c)).alias("grams"))


def _keys(gram: Column) -> tuple[Column, Column]:
    return F.xxhash64(gram).alias("h1"), F.xxhash64(F.lit(7), gram).alias("h2")


def index(benchmark: DataFrame, dataset="'benchmark'", config: DecontaminationConfig = DecontaminationConfig(), order: str = "item_id") -> DataFrame:
    """``gram, dataset, h1, h2``, written: of several datasets with a gram the one loaded last; common words go."""
    rows = _exploded(benchmark.select("text", F.expr(dataset).alias("dataset"), F.col(order).alias("__o")), "text", config, "dataset", "__o")
    made = rows.select("dataset", "__o", F.explode_outer("grams").alias("gram")).groupBy("gram").agg(F.max_by("dataset", "__o").alias("dataset"))
    return materialize(made.where(F.col("gram").isNotNull() & ~F.col("gram").isin(*COMMON)).select("gram", "dataset", *_keys(F.col("gram"))))


def extend(indexed: DataFrame, grams: DataFrame, dataset: str) -> DataFrame:
    """The index with further n-grams (column ``gram``) of ``dataset``, which take the place of equal ones."""
    new = grams.where("gram is not null").select("gram").distinct().select("gram", F.lit(dataset).alias("dataset"), *_keys(F.col("gram")))
    return materialize(indexed.join(new, ["h1", "h2"], "left_anti").select("gram", "dataset", "h1", "h2").unionByName(new))


def without_frequent(indexed: DataFrame, docs: DataFrame, config: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """The index without the n-grams that ``max_frequency`` documents or more hold: phrases, not leaks."""
    held = _held(docs, indexed, config).join(broadcast_if_small(indexed).select("gram", "h1", "h2"), "gram").select("doc_id", "h1", "h2").distinct()
    frequent = held.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= config.max_frequency)
    return materialize(indexed.join(frequent, ["h1", "h2"], "left_anti").select("gram", "dataset", "h1", "h2"))


def _held(docs: DataFrame, table: DataFrame, config: DecontaminationConfig) -> DataFrame:
    """``doc_id, position, gram`` of the n-grams that the written ``table`` may hold: all that it holds and few others."""
    return windows.candidates(docs, table, config).select("doc_id", F.explode_outer("hits").alias("x")).where("x is not null").select("doc_id", "x.position", "x.gram")


def matches(docs: DataFrame, indexed: DataFrame, config: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """``doc_id, position, gram, dataset``: the first ``max_matches`` of every document by position, all with ``uncapped_score``."""
    found = _held(docs, indexed, config).join(broadcast_if_small(indexed), "gram").select("doc_id", "position", "gram", "dataset")
    if config.uncapped_score:
        return found
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("position"))
    return found.withColumn("__r", rank).where(F.col("__r") <= config.max_matches).drop("__r")


def assess(docs: DataFrame, indexed: DataFrame, config: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """``doc_id, total_ngrams, matched, score, source, contaminated, decision`` for every document; the source is the dataset with most matches, of equals the least name.

    One pass over the texts. With ``uncapped_score`` all matches count, so that long documents can be flagged too.
    """
    rows = windows.candidates(docs, indexed, config).select("doc_id", "total_ngrams", F.explode_outer("hits").alias("x")).select("doc_id", "total_ngrams", "x.gram")
    met = rows.join(broadcast_if_small(indexed).select("gram", "dataset"), "gram", "left")
    found = met.groupBy("doc_id", "total_ngrams", "dataset").agg(F.count("dataset").alias("c"))
    most = F.sum("c") if config.uncapped_score else F.least(F.lit(config.max_matches), F.sum("c"))
    hits = found.groupBy("doc_id", "total_ngrams").agg(most.cast("long").alias("matched"), F.min_by("dataset", F.when(F.col("c") > 0, F.struct(-F.col("c"), "dataset"))).alias("source"))
    score = F.when(F.col("total_ngrams") > 0, F.col("matched") / F.col("total_ngrams")).otherwise(0.0)
    out = hits.select("doc_id", "total_ngrams", "matched", score.alias("__s"), "source").withColumn("contaminated", F.col("__s") >= config.threshold)
    decision = F.when(F.col("contaminated"), F.concat_ws(" ", F.lit("contaminated:"), F.col("matched").cast("string"), F.lit("matches, mostly"), "source")).when(F.col("matched") > 0, "below threshold").otherwise("clean")
    return out.select("doc_id", "total_ngrams", "matched", F.round("__s", 6).alias("score"), "source", "contaminated", decision.alias("decision"))


def adaptive(docs: DataFrame, benchmark: DataFrame, sizes: tuple = (8, 12, 16), config: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """``doc_id, n, score, contaminated``: of several sizes of n-grams the largest that flags a document, else the least size. (A definition of this engine.)"""
    every = None
    for n in sizes:
        c = dataclasses.replace(config, n=n)
        part = assess(docs, index(benchmark, config=c), c).select("doc_id", F.lit(n).alias("n"), "score", "contaminated")
        every = part if every is None else every.unionByName(part)
    best = F.max_by(F.struct("n", "score", "contaminated"), F.when(F.col("contaminated"), F.col("n")).otherwise(-F.col("n"))).alias("b")
    return every.groupBy("doc_id").agg(best).select("doc_id", "b.n", "b.score", "b.contaminated")


def approximate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.9, n: int = 3) -> DataFrame:
    """``doc_id, item_id, containment``: items of whose distinct word n-grams a document holds the share ``threshold`` or more. (A definition of this engine.)"""
    c = DecontaminationConfig(n=n, case_insensitive=True, remove_punctuation=True)
    items = _exploded(benchmark, "text", c, "item_id").select("item_id", F.explode_outer(F.array_distinct("grams")).alias("gram")).where("gram is not null")
    items = materialize(items)
    sizes = items.groupBy("item_id").agg(F.count("*").alias("size"))
    held = _held(docs, items, c).select("doc_id", "gram").distinct().join(broadcast_if_small(items), "gram")
    found = held.groupBy("doc_id", "item_id").agg(F.count("*").alias("c")).join(sizes, "item_id")
    return found.where(F.col("c") >= threshold * F.col("size")).select("doc_id", "item_id", F.round(F.col("c") / F.col("size"), 6).alias("containment"))


def effectiveness(docs: DataFrame, indexed: DataFrame, config: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """One row: documents flagged, benchmark n-grams met before and after the flagged ones go, and the share that went."""
    flagged = assess(docs, indexed, config).select("doc_id", "contaminated")
    met = matches(docs, indexed, dataclasses.replace(config, uncapped_score=True)).groupBy("doc_id").agg(F.count("*").alias("m"))
    both = flagged.join(met, "doc_id", "left").select("contaminated", F.coalesce("m", F.lit(0)).alias("m"))
    sums = both.agg(F.count_if("contaminated").alias("flagged"), F.coalesce(F.sum("m"), F.lit(0)).alias("before"), F.coalesce(F.sum(F.when(~F.col("contaminated"), F.col("m"))), F.lit(0)).alias("after"))
    return sums.select("flagged", "before", "after", F.round(F.when(F.col("before") > 0, 1 - F.col("after") / F.col("before")).otherwise(1.0), 6).alias("removed_share"))


def clean(docs: DataFrame, indexed: DataFrame, config: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """The documents that aren't contaminated, in the columns they have."""
    gone = assess(docs, indexed, config).where("contaminated").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")


def statistics(assessed: DataFrame) -> DataFrame:
    """One row: documents, contaminated, n-grams checked and matched."""
    return assessed.agg(F.count("*").alias("documents"), F.count_if("contaminated").alias("contaminated"), F.sum("total_ngrams").alias("ngrams"), F.sum("matched").alias("matched"))


def histogram(assessed: DataFrame) -> DataFrame:
    return assessed.groupBy("matched").agg(F.count("*").alias("documents"))


def by_dataset(assessed: DataFrame) -> DataFrame:
    """Contaminated documents of each dataset."""
    return assessed.where("contaminated").groupBy("source").agg(F.count("*").alias("documents"))


def _grams_sql(c: DecontaminationConfig) -> str:
    words = units(DUCK, "coalesce(text, '')", c)
    by = "" if c.characters else " "
    return f"""
i AS (SELECT {words} AS w FROM benchmark), b AS (SELECT DISTINCT array_to_string(w[p:p + {c.n - 1}], '{by}') AS gram FROM (SELECT w, unnest(range(1, len(w) - {c.n - 2})) AS p FROM i WHERE len(w) >= {c.n})),
t AS (SELECT doc_id, {words} AS w FROM documents), d AS (SELECT doc_id, p - 1 AS position, array_to_string(w[p:p + {c.n - 1}], '{by}') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - {c.n - 2})) AS p FROM t WHERE len(w) >= {c.n}))"""


def assess_sql(c: DecontaminationConfig = DecontaminationConfig()) -> str:
    cap = "count(*)" if c.uncapped_score else f"least({c.max_matches}, count(*))"
    return f"""
WITH {_grams_sql(c)},
h AS (SELECT doc_id, CAST({cap} AS BIGINT) AS matched FROM d JOIN b USING (gram) GROUP BY doc_id),
n AS (SELECT doc_id, CAST(greatest(0, len(w) - {c.n - 1}) AS INT) AS n FROM t),
s AS (SELECT doc_id, n AS total_ngrams, coalesce(matched, 0) AS matched, CASE WHEN n > 0 THEN coalesce(matched, 0) / CAST(n AS DOUBLE) ELSE 0 END AS s FROM n LEFT JOIN h USING (doc_id))
SELECT doc_id, total_ngrams, matched, round(s, 6) AS score, CASE WHEN matched > 0 THEN 'benchmark' END AS source, s >= {c.threshold} AS contaminated,
       CASE WHEN s >= {c.threshold} THEN 'contaminated: ' || matched || ' matches, mostly benchmark' WHEN matched > 0 THEN 'below threshold' ELSE 'clean' END AS decision FROM s"""


def matches_sql(c: DecontaminationConfig = DecontaminationConfig()) -> str:
    return f"""
WITH {_grams_sql(c)},
r AS (SELECT doc_id, CAST(position AS INT) AS position, gram, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS k FROM d JOIN b USING (gram))
SELECT doc_id, position, gram, 'benchmark' AS dataset FROM r{"" if c.uncapped_score else f" WHERE k <= {c.max_matches}"}"""


def adaptive_sql(sizes: tuple = (8, 12, 16), c: DecontaminationConfig = DecontaminationConfig()) -> str:
    parts = " UNION ALL ".join(f"SELECT doc_id, {n} AS n, score, contaminated FROM ({assess_sql(dataclasses.replace(c, n=n))})" for n in sizes)
    return f"SELECT doc_id, b.n AS n, b.score AS score, b.contaminated AS contaminated FROM (SELECT doc_id, arg_max({{'n': n, 'score': score, 'contaminated': contaminated}}, CASE WHEN contaminated THEN n ELSE -n END) AS b FROM ({parts}) GROUP BY doc_id)"


def approximate_sql(threshold: float = 0.9, n: int = 3) -> str:
    words = units(DUCK, "coalesce(text, '')", DecontaminationConfig(n=n, case_insensitive=True, remove_punctuation=True))
    grams = lambda key, table: f"SELECT DISTINCT {key}, array_to_string(w[p:p + {n - 1}], ' ') AS gram FROM (SELECT {key}, w, unnest(range(1, len(w) - {n - 2})) AS p FROM (SELECT {key}, {words} AS w FROM {table}) WHERE len(w) >= {n})"
    return f"""
WITH i AS ({grams("item_id", "benchmark")}), d AS ({grams("doc_id", "documents")}), z AS (SELECT item_id, count(*) AS size FROM i GROUP BY item_id)
SELECT doc_id, item_id, round(count(*) / CAST(min(size) AS DOUBLE), 6) AS containment FROM d JOIN i USING (gram) JOIN z USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= {threshold} * min(size)"""


def effectiveness_sql(c: DecontaminationConfig = DecontaminationConfig()) -> str:
    return f"""
WITH a AS ({assess_sql(c)}), m AS (SELECT doc_id, count(*) AS m FROM ({matches_sql(dataclasses.replace(c, uncapped_score=True))}) GROUP BY doc_id),
x AS (SELECT contaminated, coalesce(m, 0) AS m FROM a LEFT JOIN m USING (doc_id))
SELECT count(*) FILTER (contaminated) AS flagged, CAST(sum(m) AS BIGINT) AS before, CAST(coalesce(sum(m) FILTER (NOT contaminated), 0) AS BIGINT) AS after, round(1 - coalesce(sum(m) FILTER (NOT contaminated), 0) / CAST(sum(m) AS DOUBLE), 6) AS removed_share FROM x"""

"""Every query of the engine by name, with its DuckDB twin where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillmill.config import DecontaminationConfig, DomainConfig, ExactConfig, LicenseConfig, NearConfig, SemanticConfig
from quillmill.functions import text
from quillmill.functions.dialect import Layers
from quillmill.operators import content, decontaminate, domain, exact, html, language, license, model, near, pii, quality, tfidf
from quillmill import runtime
from quillmill.sources import readers, writers


def read_table(spark, sf_dir: str, name: str):
    return runtime.spread(runtime.read_table(spark, sf_dir, name))


def _written(kind: str):
    """The digests of all texts that are left when the documents are written in a format and read again, with their number."""

    def run(spark, sf_dir):
        path = f"{runtime.shared_dir(spark)}/round-trip-{uuid.uuid4().hex}.{kind}"
        writers.write_documents(read_table(spark, sf_dir, "documents"), path, kind)
        back = spark.read.json(path) if kind == "json" else readers.read_documents(spark, path)
        return back.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("documents"))

    return run


QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, run, sql: str | None = None, table: str = "documents") -> None:
    """Register ``run``, a function of a table (or Layers over it), and its twin."""
    if isinstance(run, Layers):
        sql = run.duck(table) if sql is None else sql
        run = run.spark
    QUERIES[name] = lambda spark, sf_dir, run=run: run(read_table(spark, sf_dir, table))
    if sql is not None:
        ORACLES[name] = sql


_query("exact_dedup", exact.keepers, exact.SQL["exact_dedup"])
_query("exact_dedup_last", lambda docs: exact.keepers(docs, ExactConfig(keep_first=False)), exact.SQL["exact_dedup_last"])
_query("exact_groups", exact.duplicate_groups, exact.SQL["exact_groups"])
_query("exact_stats", exact.statistics, exact.SQL["exact_stats"])
_query("soft_weights", exact.soft_weights, exact.SQL["soft_weights"])
_query("text_hashes", exact.hashes, exact.SQL["text_hashes"])
_query("text_primitives", text.PRIMITIVES)
_query("text_quality", text.TEXT_QUALITY)
_query("url_features", text.URLS, table="pages")
_query("page_head", text.PAGE_HEAD, table="pages")
_query("clean_html_text", text.CLEAN, table="pages")
_query("language_detect", language.DETECT)
_query("language_filter", language.FILTER)
_query("language_stats", language.statistics, language.stats_sql())
_query("quality_length", quality.length())
_query("quality_gibberish", quality.gibberish().spark, quality.gibberish().duck(quality.WITH_BYTES))
_query("quality_repetition", quality.repetition())
_query("quality_format", quality.formats())
_query("quality_metadata", quality.metadata())
_query("quality_processor", quality.processor().spark, quality.processor_sql())
_query("quality_stats", quality.statistics, quality.stats_sql())
_query("model_scores", model.scores, model.SCORES.duck(model.GRAMS))
_query("model_features", model.features, model.FEATURES.duck(quality.WITH_BYTES))
_query("model_stats", model.statistics, model.stats_sql())
_query("unigram_perplexity", model.unigram_perplexity, model.unigram_sql())
QUERIES["model_accuracy"] = lambda spark, d: model.accuracy(read_table(spark, d, "documents"), read_table(spark, d, "labels"))
ORACLES["model_accuracy"] = model.accuracy_sql()
_query("domain_filter", domain.domain_filter(), table="pages")
_query("license_assess", license.assess())
_PAGE_TEXT = license.license_filter(url="url", key="page_id")
_query("license_filter", lambda pages: _PAGE_TEXT.spark(pages.withColumnRenamed("html", "text")), _PAGE_TEXT.duck("(SELECT page_id, url, html AS text FROM pages)"), table="pages")
_query("license_top_rejected", lambda pages: license.top_rejected_domains(_PAGE_TEXT.spark(pages.withColumnRenamed("html", "text"))), f"SELECT host, count(*) AS rejections FROM ({_PAGE_TEXT.duck('(SELECT page_id, url, html AS text FROM pages)')}) WHERE result = 'REJECT' GROUP BY host ORDER BY rejections DESC, host LIMIT 10", table="pages")
_LISTED = {"blocked": ("therha.example.com", "therin.example.net"), "allowed": ("blog.tiontion.example.com",)}


def _hosts(spark, name: str):
    return spark.createDataFrame([(h,) for h in _LISTED[name]], "entry string")


_query("domain_lists", lambda pages: domain.with_lists(pages, _hosts(pages.sparkSession, "blocked"), _hosts(pages.sparkSession, "allowed")), domain.domain_filter(DomainConfig(**_LISTED)).duck("pages"), table="pages")
_OPTED = LicenseConfig(opted_out=_LISTED["blocked"], paywalled_domains=_LISTED["allowed"], removals=("3", "5"))
_query(
    "license_lists",
    lambda pages: license.with_lists(pages.withColumnRenamed("html", "text"), "url", key="page_id", opted_out=_hosts(pages.sparkSession, "blocked"), paywalled=_hosts(pages.sparkSession, "allowed"), removals=pages.sparkSession.createDataFrame([("3",), ("5",)], "entry string")),
    license.license_filter(_OPTED, "url", "page_id").duck("(SELECT page_id, url, html AS text FROM pages)"), table="pages",
)
_query("license_stats", lambda pages: license.statistics(_PAGE_TEXT.spark(pages.withColumnRenamed("html", "text"))), f"SELECT license, rule, count(*) AS documents, round(avg(compliance), 4) AS mean_compliance FROM ({_PAGE_TEXT.duck('(SELECT page_id, url, html AS text FROM pages)')}) GROUP BY ALL", table="pages")
_query("html_stripped", text.STRIPPED, table="pages")
_query("model_single_stage", model.single_stage, f"SELECT doc_id, ensemble_score, CASE WHEN ensemble_score >= {model.STAGES[0][1]} THEN 'KEEP' ELSE 'REJECT' END AS result FROM ({model.SCORES.duck(model.GRAMS)})")
_query("sliding_perplexity", model.sliding_perplexity, model.sliding_sql())
_query("tfidf_pairs", lambda docs: tfidf.pairs(docs).withColumn("score", F.round("score", 6)), tfidf.pairs_sql())
for _kind, _sql in {
    "txt": "SELECT md5(t) AS digest, count(*) AS documents FROM (SELECT regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS t FROM documents) WHERE t <> '' GROUP BY ALL",
    "csv": "SELECT md5(text) AS digest, count(*) AS documents FROM documents WHERE text <> '' GROUP BY ALL",
    "json": "SELECT md5(text) AS digest, count(*) AS documents FROM documents GROUP BY ALL",
}.items():
    QUERIES[f"round_trip_{_kind}"], ORACLES[f"round_trip_{_kind}"] = _written(_kind), _sql
_query("minhash_signatures", lambda docs: near.minhash(docs).select("doc_id", F.md5(F.array_join(F.col("signature").cast("array<string>"), ",")).alias("signature")), near.minhash_sql())
_query("minhash_pairs", near.minhash_pairs, near.pairs_sql())
_query("near_dedup_minhash", lambda docs: near.deduplicate(docs).select("doc_id"), near.dedup_sql())
_query("simhash", near.simhash, near.SIMHASH_SQL)
_query("simhash_pairs", near.simhash_pairs, near.pairs_sql("simhash"))
_query("simhash_classes", lambda docs: near.classes(near.signed(docs, NearConfig(method="simhash"))), f"SELECT doc_id, min(doc_id) OVER w AS class_id, count(*) OVER w AS size FROM ({near.SIMHASH_SQL}) WINDOW w AS (PARTITION BY simhash)")
_query("near_dedup_simhash", lambda docs: near.deduplicate(docs, NearConfig(method="simhash")).select("doc_id"), near.dedup_sql("simhash"))
#: The vectors of the tables are hardly alike: at the default threshold no pair is.
_ALIKE = SemanticConfig(threshold=0.4)
_query("semantic_pairs", lambda v: near.semantic_pairs(v, "vec_id", "embedding", _ALIKE).withColumn("score", F.round("score", 4)), near.semantic_sql(_ALIKE.threshold), table="embeddings")
_query("semantic_dedup", lambda v: near.semantic_dedup(v, "vec_id", "embedding", _ALIKE).select("vec_id"), near.semantic_sql(_ALIKE.threshold, kept=True), table="embeddings")


def _leaks(name: str, run, sql: str | None, config: DecontaminationConfig = DecontaminationConfig()) -> None:
    """Register ``run``, a function of the documents and the benchmark's index."""
    QUERIES[name] = lambda spark, d: run(read_table(spark, d, "documents"), decontaminate.index(runtime.read_table(spark, d, "benchmark"), config=config), config)
    if sql is not None:
        ORACLES[name] = sql


_UNCAPPED = DecontaminationConfig(uncapped_score=True)
_CHARACTERS = DecontaminationConfig(n=50, characters=True, case_insensitive=True, uncapped_score=True)
_assessed = decontaminate.assess_sql()
_leaks("ngram_contamination", decontaminate.assess, _assessed)
_leaks("ngram_contamination_uncapped", decontaminate.assess, decontaminate.assess_sql(_UNCAPPED), _UNCAPPED)
_leaks("ngram_contamination_characters", decontaminate.assess, None, _CHARACTERS)  # SQL takes minutes; tested against brute force
_leaks("ngram_matches", decontaminate.matches, decontaminate.matches_sql())
_leaks("ngram_matches_uncapped", decontaminate.matches, decontaminate.matches_sql(_UNCAPPED), _UNCAPPED)
_leaks("ngram_contamination_stats", lambda *x: decontaminate.statistics(decontaminate.assess(*x)), f"SELECT count(*) AS documents, count(*) FILTER (contaminated) AS contaminated, CAST(sum(total_ngrams) AS BIGINT) AS ngrams, CAST(sum(matched) AS BIGINT) AS matched FROM ({_assessed})")
_leaks("ngram_contamination_by_dataset", lambda *x: decontaminate.by_dataset(decontaminate.assess(*x)), f"SELECT source, count(*) AS documents FROM ({_assessed}) WHERE contaminated GROUP BY source")
_leaks("ngram_contamination_histogram", lambda *x: decontaminate.histogram(decontaminate.assess(*x)), f"SELECT matched, count(*) AS documents FROM ({_assessed}) GROUP BY matched")
_leaks("ngram_effectiveness", decontaminate.effectiveness, decontaminate.effectiveness_sql())
for _name, _run, _sql in (("ngram_adaptive", decontaminate.adaptive, decontaminate.adaptive_sql()), ("ngram_approximate", decontaminate.approximate, decontaminate.approximate_sql())):
    QUERIES[_name] = lambda spark, d, run=_run: run(read_table(spark, d, "documents"), runtime.read_table(spark, d, "benchmark"))
    ORACLES[_name] = _sql
_query("pii_candidates", pii.COUNTS)
_query("pii_spans", pii.spans)
_query("pii_sanitize", lambda docs: pii.evaluate(docs).select("doc_id", "pii.risk", "pii.result", "pii.sanitized"))
_query("toxicity", content.toxicity())
QUERIES["toxicity_accuracy"] = lambda spark, d: content.toxicity_accuracy(read_table(spark, d, "documents"), runtime.read_table(spark, d, "labels"))
ORACLES["toxicity_accuracy"] = content.accuracy_sql()
_query("content_processor", content.process)
_query("content_stats", lambda docs: content.statistics(content.process(docs)))
_query("html_extract", lambda pages: html.extract(pages).select("page_id", "extracted.title", "extracted.text", F.size("extracted.headings").alias("headings"), F.size("extracted.links").alias("links"), "extracted.text_ratio", "extracted.is_valid", "extracted.quality_score"), table="pages")
_query("html_extract_report", lambda pages: html.report(html.extract(pages)), table="pages")
_query("conversation_language", lambda turns: language.DETECT.spark(turns.withColumn("doc_id", F.concat_ws(":", "conv_id", "turn"))), language.DETECT.duck("(SELECT *, conv_id || ':' || turn AS doc_id FROM conversations)"), table="conversations")

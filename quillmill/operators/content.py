"""Toxicity, and the processor that puts domain, toxicity and personal data together. Both follow definitions of this engine.

A category's score is ``hits / (hits + 1)`` over distinct lexicon entries found as whole
words, times ``context_factor`` where the text has the marks of a medical, educational,
news or legal context. The lexicons are short and mild by intention; ``ToxicityConfig.lexicon``
takes their place.

Null counts as empty; repeated rows are judged alike; an empty table gives an empty one; other columns
stay out of the result, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillmill import resources
from quillmill.config import ContentConfig, ToxicityConfig
from quillmill.functions.dialect import Dialect, Layers
from quillmill.operators import domain, pii

LEXICON = resources.keywords()
CONTEXT = {
    "medical": ["clinical", "diagnosis", "medical", "patient", "treatment"], "educational": ["curriculum", "lesson", "research", "students", "university"],
    "news": ["according to police", "correspondent", "news agency", "reported", "reuters"], "legal": ["court", "defendant", "judge", "plaintiff", "statute"],
}


def _word(d: Dialect, entries) -> str:
    # the plain search spares most texts the expression
    return " + ".join(f"CAST((contains(low, {d.text(e)}) AND {d.has('low', rf'(?:^|[^a-z])(?:{e})(?:[^a-z]|$)')}) AS INT)" for e in entries)


def toxicity_layers(d: Dialect, c: ToxicityConfig) -> list[dict]:
    lexicon = {k: c.lexicon.get(k, v) for k, v in LEXICON.items()}
    contexts = " OR ".join(f"({d.how_many('low', w)} >= 2)" for w in CONTEXT.values())
    return [
        {"t": "coalesce(text, '')"}, {"low": d.lower("t")}, {"safe_context": contexts, **{f"{k}_hits": _word(d, v) for k, v in lexicon.items()}},
        {f"{k}_score": f"CAST({k}_hits AS DOUBLE) / ({k}_hits + 1) * (CASE WHEN safe_context THEN CAST({c.context_factor} AS DOUBLE) ELSE CAST(1 AS DOUBLE) END)" for k in LEXICON},
        {"toxicity": f"greatest({', '.join(f'{k}_score' for k in LEXICON)})", "categories": " || ".join(f"(CASE WHEN {k}_hits > 0 THEN '{k},' ELSE '' END)" for k in LEXICON), "toxic": " OR ".join(f"{k}_score >= {c.thresholds[k]}" for k in LEXICON)},
        {"severity": "CASE WHEN toxicity >= 0.8 THEN 'CRITICAL' WHEN toxicity >= 0.7 THEN 'HIGH' WHEN toxicity >= 0.5 THEN 'MEDIUM' WHEN toxicity > 0 THEN 'LOW' ELSE 'NONE' END", "toxicity_result": "CASE WHEN toxic THEN 'REJECT' ELSE 'KEEP' END"},
    ]


def toxicity(config: ToxicityConfig = ToxicityConfig()) -> Layers:
    return Layers(lambda d: toxicity_layers(d, config), ["doc_id", "round(toxicity, 6) AS toxicity", "categories", "safe_context", "severity", "toxicity_result"])


def toxicity_accuracy(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: labelled documents, toxic ones, those whose toxicity reaches the threshold, the hits among them, precision and recall."""
    found = toxicity().spark(docs).join(labels.select(F.col("doc_id").alias("id"), "toxic"), F.col("doc_id") == F.col("id"))
    marked, toxic = F.col("toxicity") >= threshold, F.col("toxic") == 1
    sums = found.agg(F.count("*").alias("labelled"), F.count_if(toxic).alias("toxic"), F.count_if(marked).alias("marked"), F.count_if(marked & toxic).alias("hits"))
    share = lambda of: F.round(F.when(F.col(of) > 0, F.col("hits") / F.col(of)), 6)
    return sums.select("*", share("marked").alias("precision"), share("toxic").alias("recall"))


def accuracy_sql(threshold: float = 0.5) -> str:
    return f"""
SELECT *, round(CASE WHEN marked > 0 THEN hits / CAST(marked AS DOUBLE) END, 6) AS precision, round(CASE WHEN toxic > 0 THEN hits / CAST(toxic AS DOUBLE) END, 6) AS recall FROM (
  SELECT count(*) AS labelled, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (toxicity >= {threshold}) AS marked, count(*) FILTER (toxicity >= {threshold} AND toxic = 1) AS hits
  FROM ({toxicity().duck("documents")}) JOIN labels USING (doc_id))"""


#: How the processor decides: by any rejection or the score, by rejections alone, by the score alone.
STRATEGIES = ("strict", "rejections", "score")
PRESETS = {
    "default": (ContentConfig(), pii.PiiConfig()),
    "strict": (ContentConfig(threshold=0.85), pii.PiiConfig(names=True)),
    "permissive": (ContentConfig(threshold=0.4, strategy="score"), pii.PiiConfig(addresses=False)),
    "privacy": (ContentConfig(weights=(1.0, 1.0, 4.0)), pii.PiiConfig(names=True, government_ids=True)),
    "research": (ContentConfig(strategy="rejections"), pii.PiiConfig(placeholders=False)),
}


def process(docs: DataFrame, config: ContentConfig = ContentConfig(), url: str | None = None, private: pii.PiiConfig = pii.PiiConfig()) -> DataFrame:
    """``doc_id, domain_result, toxicity_result, pii_result, safety_score, final_result, text``: the text with personal data masked where that decides.

    The safety score is the mean of ``1 - risk`` by weight; by ``strategy`` it decides, a rejection does, or either.
    Without a URL column the domain isn't judged.
    """
    rows = docs.select("doc_id", "text", (F.col(url) if url else F.lit(None).cast("string")).alias("url"))
    rows = domain.domain_filter(key="doc_id").add(rows).select("doc_id", "text", "url", F.col("confidence").alias("dc"), F.when(F.lit(bool(url)), F.col("result")).otherwise("KEEP").alias("domain_result"))
    rows = toxicity().add(rows).select("doc_id", "text", "dc", "domain_result", "toxicity", "toxicity_result")
    rows = pii.evaluate(rows, private).select("*", F.col("pii.result").alias("pii_result"))
    a, b, c = config.weights
    safe = F.when(F.lit(bool(url)), F.when(F.col("domain_result") == "KEEP", F.col("dc")).otherwise(1 - F.col("dc"))).otherwise(1.0)
    score = (a * safe + b * (1 - F.col("toxicity")) + c * (1 - F.col("pii.risk"))) / (a + b + c)
    refused, low = (F.col("domain_result") == "REJECT") | (F.col("toxicity_result") == "REJECT") | (F.col("pii_result") == "REJECT"), score < config.threshold
    gone = {"strict": refused | low, "rejections": refused, "score": low}[config.strategy]
    final = F.when(gone, "REJECT").when(F.col("pii_result") == "SANITIZE", "SANITIZE").otherwise("KEEP")
    return rows.select("doc_id", "domain_result", "toxicity_result", "pii_result", F.round(score, 6).alias("safety_score"), final.alias("final_result"), F.when(F.col("pii_result") == "SANITIZE", F.col("pii.sanitized")).otherwise(F.col("text")).alias("text"))


def merged(docs: DataFrame, processed: DataFrame) -> DataFrame:
    """The documents that aren't rejected, in the columns they have, with their masked texts; rows that share a ``doc_id`` are judged as the worst of them."""
    names = docs.columns
    rank = F.when(F.col("final_result") == "REJECT", 2).when(F.col("final_result") == "SANITIZE", 1).otherwise(0)
    verdict = processed.select(F.col("doc_id").alias("__id"), rank.alias("__r"), F.col("text").alias("__text")).groupBy("__id").agg(F.max(F.struct("__r", "__text")).alias("__v"))
    both = docs.join(verdict, F.col("doc_id").eqNullSafe(F.col("__id"))).where("__v.__r < 2")
    return both.select(*(F.when(F.col("__v.__r") == 1, F.col("__v.__text")).otherwise(F.col("text")).alias("text") if n == "text" else F.col(f"`{n}`") for n in names))


def statistics(processed: DataFrame) -> DataFrame:
    return processed.groupBy("final_result", "domain_result", "toxicity_result", "pii_result").agg(F.count("*").alias("documents"), F.round(F.avg("safety_score"), 4).alias("mean_safety"))

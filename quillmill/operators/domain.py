"""Domain and URL filter: the first rule that applies decides. A row without a URL has no reputation and is rejected.

Lists are tuples of settings, or tables of any size (``with_lists``), joined by host. Repeated rows are
judged alike; an empty table gives an empty one; a column named like one of the result is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillmill import resources
from quillmill.config import DomainConfig
from quillmill.functions.dialect import SPARK, Dialect, Layers
from quillmill.runtime import broadcast_if_small, materialize

SHORTENERS = "bit.ly cutt.ly goo.gl is.gd ow.ly rb.gy short.link t.co tinyurl.com v.gd".split()
DOUBTFUL_TLDS = "cf click download ga ml review tk".split()
DEFAULT_BLOCKED = tuple(resources.entries("blocked_hosts"))
_URL = "(?i)^(?:.*[.]tk/.*|.*bit[.]ly/[a-z0-9]{6}.*|.*[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}.*|.*/click.*|.*/redirect.*|.*[0-9]{8,}.*|.*-{3,}.*|.*[.]{2,}.*)$"


def _in(x: str, values) -> str:
    return f"{x} IN ({', '.join(repr(v) for v in values)})" if values else "FALSE"


def _n(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def host_of(d: Dialect, url: str) -> str:
    return d.sub(d.group(url, "https?://(?:www[.])?([^/]+)"), ":[0-9]+$", "")


def listed(frame: DataFrame, host: str, **lists: DataFrame) -> DataFrame:
    """``frame`` with a boolean column for each list (a table with column ``entry``): whether the host expression is on it."""
    frame = frame.withColumn("__host", F.expr(host))
    for name, table in lists.items():
        entries = materialize(table.select(F.trim("entry").alias("__entry")).where("__entry <> ''").distinct().withColumn(name, F.lit(True)))
        frame = frame.join(broadcast_if_small(entries), F.col("__host") == F.col("__entry"), "left").drop("__entry").withColumn(name, F.coalesce(name, F.lit(False)))
    return frame.drop("__host")


def with_lists(pages: DataFrame, blocked: DataFrame | None = None, allowed: DataFrame | None = None, config: DomainConfig = DomainConfig(), key: str = "page_id") -> DataFrame:
    """The filter with lists that are tables; they count beside those of the settings, and the default blocklist only without either."""
    lists = {n: t for n, t in (("__on_blocked", blocked), ("__on_allowed", allowed)) if t is not None}
    return domain_filter(config, key, tuple(lists)).spark(listed(pages, host_of(SPARK, "coalesce(url, '')"), **lists))


def domain_filter(config: DomainConfig = DomainConfig(), key: str = "page_id", tables: tuple = ()) -> Layers:
    blocked = config.blocked or (() if "__on_blocked" in tables else DEFAULT_BLOCKED)
    either = lambda test, name: f"({test} OR {name})" if name in tables else test

    def layers(d: Dialect) -> list[dict]:
        return [
            {"u": "coalesce(url, '')"}, {"host": host_of(d, "u")},
            {
                "tld": d.group("host", "([^.]*)$"), "hyphens": d.count("host", "-"), "dots": d.count("host", "[.]"), "path": d.group("u", "^.{8}[^/]*(/.*)$"), "params": d.group("u", "([?].*)$"),
                "is_blocked": either(_in("host", blocked), "__on_blocked"), "is_allowed": either(_in("host", config.allowed), "__on_allowed"), "url_pattern": d.has("u", _URL), "spam_word": d.any_of(d.lower("u"), config.spam_keywords) if config.spam_keywords else "FALSE",
                "ip_host": d.has("host", "^[0-9]{1,3}([.][0-9]{1,3}){3}$"), "shortener": _in("host", SHORTENERS),
            },
            {
                "odd_host": f"dots > 4 OR {d.has('host', '^(admin|login|secure)[.]')}", "odd_path": f"length(path) > 200 OR {d.any_of('path', ('/ads', '/click', '/redirect', '/track'))}",
                "odd_params": f"{d.count('params', '&')} > 10 OR {d.any_of('params', ('click', 'referrer', 'track'))}",
                "reputation": f"CASE WHEN host = '' OR is_blocked THEN {_n(0)} ELSE least({_n(1)}, (CASE WHEN is_allowed THEN {_n(1)} ELSE {_n('0.5')} END) * (CASE WHEN {_in('tld', DOUBTFUL_TLDS)} THEN {_n('0.3')} WHEN {_in('tld', ('com', 'edu', 'gov', 'org'))} THEN {_n('1.2')} ELSE {_n(1)} END)"
                f" * (CASE WHEN length(host) > 50 THEN {_n('0.8')} ELSE {_n(1)} END) * (CASE WHEN host LIKE 'xn--%' THEN {_n('0.7')} ELSE {_n(1)} END) * (CASE WHEN hyphens > 3 THEN {_n('0.8')} ELSE {_n(1)} END)) END",
            },
            {"suspicion": f"(CAST(odd_host AS INT) + CAST(odd_path AS INT) + CAST(odd_params AS INT) + CAST(spam_word AS INT) + CAST(length(host) > 50 AS INT) + CAST(hyphens > 3 AS INT) + CAST(dots > 4 AS INT)) / {_n(10)}"},
            {"rule": "CASE WHEN host = '' AND u <> '' THEN 'malformed' WHEN is_blocked THEN 'blocklist' WHEN is_allowed THEN 'allowlist'"
             f" WHEN {_in('tld', config.blocked_tlds)} THEN 'tld' WHEN url_pattern THEN 'url_pattern' WHEN spam_word THEN 'spam_word'"
             f" WHEN {'ip_host' if config.block_ip else 'FALSE'} THEN 'ip_address' WHEN {'shortener' if config.check_shorteners else 'FALSE'} THEN 'shortener'"
             " WHEN suspicion > 0.5 THEN 'suspicion' WHEN reputation < 0.3 THEN 'reputation' ELSE 'passed' END"},
            {"result": "CASE WHEN rule IN ('allowlist', 'passed') THEN 'KEEP' ELSE 'REJECT' END",
             "confidence": f"CASE rule WHEN 'malformed' THEN {_n('0.8')} WHEN 'blocklist' THEN {_n('0.95')} WHEN 'allowlist' THEN {_n(1)} WHEN 'tld' THEN {_n('0.8')} WHEN 'url_pattern' THEN {_n('0.85')} WHEN 'spam_word' THEN {_n('0.7')}"
             f" WHEN 'ip_address' THEN {_n('0.9')} WHEN 'shortener' THEN {_n('0.6')} WHEN 'suspicion' THEN suspicion WHEN 'reputation' THEN 1 - reputation ELSE reputation * (1 - suspicion) END"},
        ]

    return Layers(layers, [key, "host", "tld", "round(reputation, 6) AS reputation", "round(suspicion, 6) AS suspicion", "rule", "result", "round(confidence, 6) AS confidence"])

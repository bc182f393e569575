"""Licence and copyright signals, compliance and its report. The host is compared as a whole: a subdomain of a listed domain isn't listed.

Lists are tuples of settings, or tables of any size (``with_lists``). Null counts as empty; repeated rows are
judged alike; an empty table gives an empty one; a column named like one of the result is replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from quillmill.config import LicenseConfig
from quillmill.functions.dialect import SPARK, Dialect, Layers
from quillmill.operators.domain import listed

ALLOWED = "archive.org arxiv.org commons.wikimedia.org github.com gutenberg.org openlibrary.org reddit.com stackoverflow.com wikimedia.org wikipedia.org".split()
COMMONS = "commons.wikimedia.org creativecommons.org flickr.com freesound.org openclipart.org".split()
PUBLIC = "archive.org cdc.gov gutenberg.org loc.gov nasa.gov nih.gov".split()
NAMES = {
    "UNKNOWN": "Unknown", "PUBLIC_DOMAIN": "Public Domain", "MIT": "MIT", "GPL_V2": "GPL v2", "GPL_V3": "GPL v3", "APACHE_2": "Apache 2.0", "BSD_2_CLAUSE": "BSD 2-Clause", "BSD_3_CLAUSE": "BSD 3-Clause",
    **{f"CREATIVE_COMMONS_{k}": v for k, v in {"0": "CC0", "BY": "CC BY", "BY_SA": "CC BY-SA", "BY_NC": "CC BY-NC", "BY_ND": "CC BY-ND"}.items()}, **{x.upper(): x.title() for x in ("proprietary", "copyrighted", "paywalled", "restricted")},
}
OPEN = frozenset(("PUBLIC_DOMAIN", "CREATIVE_COMMONS_0", "CREATIVE_COMMONS_BY", "CREATIVE_COMMONS_BY_SA", "MIT", "APACHE_2", "BSD_2_CLAUSE", "BSD_3_CLAUSE"))
_SIGNS = ("apache", "bsd", "cc by", "cc0", "creative commons", "gpl", "mit license", "public domain")


def is_open(license_type: str) -> bool:
    return license_type in OPEN


def _in(x: str, values) -> str:
    return f"{x} IN ({', '.join(repr(v) for v in values)})" if values else "FALSE"


def _n(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def _has(word: str) -> str:
    return f"contains(low, '{word}')"


DETECT = (
    f"CASE WHEN {_has('creative commons')} OR {_has('cc by')} THEN CASE WHEN {_has('cc0')} THEN 'CREATIVE_COMMONS_0' WHEN {_has('cc by-sa')} THEN 'CREATIVE_COMMONS_BY_SA' WHEN {_has('cc by-nc')} THEN 'CREATIVE_COMMONS_BY_NC'"
    f" WHEN {_has('cc by-nd')} THEN 'CREATIVE_COMMONS_BY_ND' WHEN {_has('cc by')} THEN 'CREATIVE_COMMONS_BY' ELSE 'UNKNOWN' END WHEN {_has('public domain')} OR {_has('cc0')} THEN 'PUBLIC_DOMAIN' WHEN {_has('mit license')} THEN 'MIT'"
    f" WHEN {_has('apache license')} THEN 'APACHE_2' WHEN {_has('gpl')} THEN CASE WHEN {_has('version 3')} OR {_has('v3')} THEN 'GPL_V3' ELSE 'GPL_V2' END WHEN {_has('bsd')} THEN CASE WHEN {_has('3-clause')} THEN 'BSD_3_CLAUSE' ELSE 'BSD_2_CLAUSE' END ELSE 'UNKNOWN' END"
)


def _host(d: Dialect, u: str) -> str:
    return f"CASE WHEN contains({u}, '://') THEN {d.group(u, '://(?:www[.])?([^/]*)')} ELSE {u} END"


def _assess(d: Dialect, config: LicenseConfig, url: str | None, key: str, tables: tuple = ()) -> list[dict]:
    either = lambda test, name: f"({test} OR {name})" if name in tables else test
    u = f"coalesce({url}, '')" if url else "''"
    signs = " || ".join(f"(CASE WHEN {_has(s)} THEN '{s},' ELSE '' END)" for s in _SIGNS)
    return [
        {"t": "coalesce(text, '')", "u": u}, {"low": d.lower("t"), "host": _host(d, "u")},
        {
            "license": DETECT, "notices": d.count("t", "(?s)©.{0,99}"), "indicators": signs, "allowed_domain": _in("host", (*ALLOWED, *COMMONS, *PUBLIC)), "opted_out": either(_in("host", config.opted_out), "__on_opted_out"),
            "removal": either(_in(f"CAST({key} AS STRING)" if d.name == "spark" else f"CAST({key} AS VARCHAR)", config.removals), "__on_removals"),
            "paywalled": f"{either(_in('host', config.paywalled_domains), '__on_paywalled')} OR {d.any_of('low', ('members only', 'paywall', 'premium content', 'subscribe'))}", "broad_notice": d.any_of("low", ("all rights reserved", "copyright", "(c)", "©")),
        },
        {"compliance": f"greatest({_n(0)}, least({_n(1)}, {_n('0.5')} + (CASE WHEN license <> 'UNKNOWN' THEN {_n('0.3')} ELSE {_n(0)} END) + (CASE WHEN allowed_domain THEN {_n('0.2')} ELSE {_n(0)} END) - (CASE WHEN notices > 0 AND license = 'UNKNOWN' THEN {_n('0.3')} ELSE {_n(0)} END) - (CASE WHEN paywalled THEN {_n('0.4')} ELSE {_n(0)} END)))"},
    ]


def assess(config: LicenseConfig = LicenseConfig(), url: str | None = None, key: str = "doc_id") -> Layers:
    """All signals of a row, without a verdict."""
    return Layers(lambda d: _assess(d, config, url, key), [key, "license", "notices", "indicators", "allowed_domain", "paywalled", "broad_notice", "round(compliance, 6) AS compliance"])


def with_lists(frame: DataFrame, url: str, config: LicenseConfig = LicenseConfig(), key: str = "doc_id", opted_out: DataFrame | None = None, paywalled: DataFrame | None = None, removals: DataFrame | None = None) -> DataFrame:
    """The filter with lists that are tables with a column ``entry``: hosts, and for removals ids."""
    hosts = {n: t for n, t in (("__on_opted_out", opted_out), ("__on_paywalled", paywalled)) if t is not None}
    frame = listed(frame, _host(SPARK, f"coalesce({url}, '')"), **hosts)
    if removals is not None:
        frame = listed(frame, f"CAST({key} AS STRING)", __on_removals=removals)
    return license_filter(config, url, key, (*hosts, *(("__on_removals",) if removals is not None else ()))).spark(frame)


def robots_allows(rules: str | None, path: str, agent: str = "*") -> bool:
    """Whether a robots file, given as text, lets an agent fetch a path: the longest rule of its group decides, allowing on a tie."""
    groups: dict[str, list[tuple[bool, str]]] = {}
    names: list[str] = []
    fresh = True
    for line in (rules or "").splitlines():
        field, _, value = line.partition("#")[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if field == "user-agent":
            names = [*([] if fresh else names), value.lower()] if not fresh else [value.lower()]
            fresh = False
            groups.setdefault(value.lower(), [])
        elif field in ("allow", "disallow"):
            fresh = True
            for name in names:
                if value:
                    groups[name].append((field == "allow", value))
    rules_ = groups.get(agent.lower(), groups.get("*", []))
    found = [(len(p), allow) for allow, p in rules_ if re.match(re.escape(p).replace(r"\*", ".*").replace(r"\$", "$"), path)]
    return max(found)[1] if found else True


def forbids_by_meta(html: str) -> str:
    """An expression: whether a page's robots meta tag says ``noindex``, ``noai`` or ``none``."""
    return SPARK.has(f"coalesce({html}, '')", r"(?i)<meta[^>]+name[ ]*=[ ]*.robots.[^>]+content[ ]*=[ ]*.[^>]*\b(noindex|noai|none)\b")


def statistics(found: DataFrame) -> DataFrame:
    """Rows and mean compliance by licence and rule."""
    return found.groupBy("license", "rule").agg(F.count("*").alias("documents"), F.round(F.avg("compliance"), 4).alias("mean_compliance"))


def license_filter(config: LicenseConfig = LicenseConfig(), url: str | None = None, key: str = "doc_id", tables: tuple = ()) -> Layers:
    """The first rule that applies: opt-out, removal, domain, blocklist, paywall, licence, confidence."""
    strict = "TRUE" if config.strict else "FALSE"

    def layers(d: Dialect) -> list[dict]:
        rule = (
            f"CASE WHEN removal THEN 'removal' WHEN opted_out THEN 'opt_out' WHEN NOT allowed_domain THEN 'domain' WHEN {_in('host', config.blocked_domains)} THEN 'blocked' WHEN paywalled THEN 'paywall'"
            f" WHEN NOT {_in('license', config.allowed)} AND ({strict} OR notices > 0) THEN 'license' WHEN {strict} AND compliance < {config.confidence} THEN 'confidence' ELSE 'compliant' END"
        )
        return [*_assess(d, config, url, key, tables), {"rule": rule}, {"result": "CASE WHEN rule = 'compliant' THEN 'KEEP' ELSE 'REJECT' END"}]

    return Layers(layers, [key, "host", "license", "paywalled", "round(compliance, 6) AS compliance", "rule", "result"])


def top_rejected_domains(found, n: int = 10):
    """The ``n`` hosts with most rejections, of a result of ``license_filter``."""
    return found.where("result = 'REJECT'").groupBy("host").agg(F.count("*").alias("rejections")).orderBy(F.desc("rejections"), "host").limit(n)

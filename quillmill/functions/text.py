"""Layers of text metrics in both dialects. Lengths and ratios are in bytes; null counts as empty."""

from __future__ import annotations

from quillmill.functions.dialect import BLANK, PUNCT, Dialect, Layers

SENTENCE_END = "[.!?]"


def base(d: Dialect) -> dict:
    return {"t": "coalesce(text, '')"}


def bytes_of(d: Dialect) -> dict:
    return {
        "n": d.octets("t"), "alpha_n": d.letters("t", "A-Za-z"), "digit_n": d.letters("t", "0-9"),
        "symbol_n": d.octets(d.sub("t", f"[A-Za-z0-9{BLANK}]+", "")), "solid_n": d.octets(d.sub("t", f"[{BLANK}]+", "")),
    }


def ratios(d: Dialect) -> dict:
    return {f"{k}_ratio": d.ratio(f"{k}_n", "n") for k in ("alpha", "digit", "symbol")}


def word_lists(d: Dialect) -> dict:
    return {"words": d.words("t"), "line_list": d.lines("t")}


def sentences(d: Dialect, x: str = "t") -> str:
    return d.count(x, SENTENCE_END)


#: Normalised text, tokens and character n-grams.
def _primitives(d: Dialect) -> list[dict]:
    return [
        base(d),
        {"normalized": d.blanks(d.lower("t")), "no_blanks": d.sub("t", f"[{BLANK}]+", ""), "tokens": d.all(d.lower("t"), "[A-Za-z0-9_]+")},
        {"chars": d.characters("normalized")}, {"grams": d.grams("normalized", 5)},
        {"normalized_md5": "md5(normalized)", "compact_md5": "md5(no_blanks)", "n_tokens": d.size("tokens"), "tokens_md5": f"md5({d.join('tokens', ' ')})", "n_grams": d.size("grams"), "grams_md5": f"md5({d.join('grams', '|')})"},
    ]


PRIMITIVES = Layers(_primitives, ["doc_id", "normalized_md5", "compact_md5", "n_tokens", "tokens_md5", "n_grams", "grams_md5"])

_BOILER = (
    "advertisement", "all rights reserved", "click here", "continue reading", "cookie policy", "copyright", "follow us", "learn more", "like us on facebook",
    "newsletter", "privacy policy", "read more", "share this", "sign up", "sponsored", "subscribe to", "terms of service",
)
_NAVIGATION = "home about contact services products blog news events gallery portfolio".split()[::-1] + "careers login menu navigation register search sitemap team".split()
_ADS = ("ads by", "advertisement", "buy now", "click here", "discount", "free trial", "learn more", "offer", "promoted", "sale", "shop now", "sign up now", "sponsored")


def _quality(d: Dialect) -> list[dict]:
    """Text quality, boilerplate signs and readability."""
    bare = d.keep(d.map(d.all("t", f"[^{BLANK}]+"), "w", d.lower(d.sub("w", f"[{PUNCT}]+", ""))), "w", "w <> ''")
    parts = d.keep("split(t, r'[.!?]+')" if d.name == "spark" else "regexp_split_to_array(t, '[.!?]+')", "s", f"{d.octets('s')} >= 5")
    return [
        base(d),
        {"n": d.octets("t"), "ends": sentences(d), "low": d.lower("t"), "bare": bare, "parts": parts, "proper": d.count("t", r"[.] [A-Z]"), "separators": d.count("t", "[|*>/-]")},
        {"clean_words": d.keep(d.all(d.sub(d.join("parts", " "), r"[!-/:-@\[-`{-~]+", ""), f"[^{BLANK}]+"), "w", "w <> ''")},
        {"syllables": d.total(d.map("clean_words", "w", f"CAST(greatest(1, {d.count('w', '[aeiouAEIOU]+')}) AS BIGINT)"))},
        {
            "text_quality": f"CASE WHEN n = 0 THEN {d.number('0')} ELSE least({d.number('1')}, least(n / {d.number('1000')}, {d.number('1')}) * {d.number('0.3')} + least(ends / {d.number('10')}, {d.number('1')}) * {d.number('0.2')}"
            f" + {d.ratio(d.size(d.distinct('bare')), d.size('bare'))} * {d.number('0.3')} + {d.ratio('proper', 'ends')} * {d.number('0.2')}) END",
            "boilerplate": f"n < 10 OR {d.how_many('low', _BOILER)} > 0.2 * {len(_BOILER)}",
            "flesch": f"CASE WHEN {d.size('parts')} = 0 OR {d.size('clean_words')} = 0 THEN {d.number('0')} ELSE greatest({d.number('0')}, least({d.number('1')}, ({d.number('206.835')} - {d.number('1.015')} * {d.size('clean_words')} / {d.size('parts')} - {d.number('84.6')} * syllables / {d.size('clean_words')}) / {d.number('100')})) END",
            "navigation_text": d.any_of("low", _NAVIGATION), "ad_text": d.any_of("low", _ADS),
            "copyright_text": f"{d.any_of('low', ('all rights reserved', 'copyright', '(c)', '©'))}", "menu_text": "n > 0 AND n <= 100 AND separators > 0.2 * n",
        },
    ]


TEXT_QUALITY = Layers(_quality, ["doc_id", "round(text_quality, 6) AS text_quality", "boilerplate", "round(flesch, 6) AS readability", "navigation_text", "ad_text", "copyright_text", "menu_text"])

_TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "source")


def _urls(d: Dialect) -> list[dict]:
    out = [{"u": "coalesce(url, '')"}, {"low": d.sub(d.lower("u"), "#.*$", "")}, {"clean": f"CASE WHEN length(low) > 1 THEN {d.sub('low', '/$', '')} ELSE low END"}]
    out += [{f"clean{k}": d.sub(f"clean{k - 1}" if k else "clean", f"&?{p}=[^&]*", "")} for k, p in enumerate(_TRACKING)]
    return [*out, {"normalized_url": d.sub(f"clean{len(_TRACKING) - 1}", "[?]$", ""), "domain": d.group("u", "^https?://([^/]+)"), "host": d.group("u", "https?://(?:www[.])?([^/]+)")}, {"external": "u <> '' AND domain <> '' AND domain <> 'example.com'"}]


URLS = Layers(_urls, ["page_id", "normalized_url", "domain", "host", "external"])


def meta_content(d: Dialect, html: str, name: str) -> str:
    """The content of a page's first meta tag with a name, which has to stand before it; '' for none."""
    return d.group(html, f"(?i)<meta[^>]+name[ ]*=[ ]*[\"\\x27]{name}[\"\\x27][^>]+content[ ]*=[ ]*[\"\\x27]([^\"\\x27]*)[\"\\x27]")


def meta_tags(d: Dialect, html: str) -> str:
    """All meta tags of a page, as they stand."""
    return d.all(html, "(?i)<meta[^>]*>")


def encoding_of_bytes(raw: str) -> str:
    """Spark's expression for the encoding of a binary column: byte order mark, charset declaration, ``ascii`` without a high byte, else ``utf-8``."""
    head, latin = f"hex(substring({raw}, 1, 3))", f"decode({raw}, 'ISO-8859-1')"
    said = f"lower(regexp_extract({latin}, r'(?i)charset[ ]*=[ ]*[\"\\x27]?([^\"\\x27> \\t\\n\\r]+)', 1))"
    return f"CASE WHEN {head} = 'EFBBBF' THEN 'utf-8' WHEN {head} LIKE 'FFFE%' THEN 'utf-16le' WHEN {head} LIKE 'FEFF%' THEN 'utf-16be' WHEN {said} <> '' THEN {said} WHEN NOT {latin} RLIKE r'[\\x80-\\xFF]' THEN 'ascii' ELSE 'utf-8' END"


def strip_html(d: Dialect, x: str) -> str:
    """Without tags, five entities decoded, blanks collapsed."""
    x = d.sub(x, "<[^>]*>", "")
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " ")):
        x = f"replace({x}, {d.text(a)}, {d.text(b)})"
    return d.blanks(x)


STRIPPED = Layers(lambda d: [{"h": "coalesce(html, '')"}, {"stripped": strip_html(d, "h"), "tags": meta_tags(d, "h"), "viewport": meta_content(d, "h", "viewport"), "author": meta_content(d, "h", "author")}, {"meta_tags": d.size("tags"), "tags_md5": f"md5({d.join('tags', '|')})"}], ["page_id", "stripped", "meta_tags", "tags_md5", "viewport", "author"])


def _head(d: Dialect) -> list[dict]:
    low = d.lower("h")
    tag = "contains(h, '<') AND contains(h, '>')"
    html = f"contains(h, '<!DOCTYPE html') OR contains(h, '<html') OR contains(h, '<head>') OR contains(h, '<body>')"
    return [
        {"h": "coalesce(html, '')"},
        {"bare": d.sub("h", f"^[{BLANK}]+|[{BLANK}]+$", "")},
        {
            "title": d.group("h", "(?i)<title[^>]*>([^\\n\\r]*?)</title>"), "description": d.group("h", "(?i)<meta[^>]+name[ ]*=[ ]*[\"\\x27]description[\"\\x27][^>]+content[ ]*=[ ]*[\"\\x27]([^\"\\x27]*)[\"\\x27]"),
            "language": d.group("h", "(?i)<html[^>]+lang[ ]*=[ ]*[\"\\x27]([^\"\\x27]+)[\"\\x27]"), "charset": d.group(low, "charset[ ]*=[ ]*[\"\\x27]?([^\"\\x27>{0}]+)".replace("{0}", BLANK)),
            "likely_html": f"{html} OR ({tag})",
            "content_type": f"CASE WHEN h = '' THEN 'UNKNOWN' WHEN {html} OR ({tag} AND contains(h, '</')) THEN 'HTML' WHEN contains(h, '<?xml') OR ({tag} AND contains(h, 'xmlns')) THEN 'XML'"
            f" WHEN (substr(bare, 1, 1) = '{{' AND substr(bare, -1, 1) = '}}') OR (substr(bare, 1, 1) = '[' AND substr(bare, -1, 1) = ']') THEN 'JSON' ELSE 'PLAIN_TEXT' END",
        },
        {"encoding": f"CASE WHEN charset <> '' THEN charset WHEN {d.octets('h')} = {d.chars('h')} THEN 'ascii' ELSE 'utf-8' END"},
    ]


PAGE_HEAD = Layers(_head, ["page_id", "title", "description", "language", "encoding", "likely_html", "content_type"])


def _clean(d: Dialect, x: str = "h", one_line: bool = True) -> list[dict]:
    """Entities, typographic marks, double-encoded letters, blanks and tags, in the documented order."""
    def replaced(x, pairs):
        for a, b in pairs:
            x = f"replace({x}, {d.text(a)}, {d.text(b)})"
        return x

    named = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…")]
    named += [(f"&{k}dquo;", '"') for k in "lr"] + [(f"&{k}squo;", "'") for k in "lr"] + [("&laquo;", "«"), ("&raquo;", "»"), ("&amp;", "&")]
    numeric = [(f"&#{c};", chr(c)) for c in range(32, 127)]
    marks = [("\u00a0", " "), ("\u2013", "-"), ("\u2018", "'"), ("\u2019", "'"), ("\u201c", '"'), ("\u201d", '"'), ("\u2026", "...")]
    broken = [(c.encode().decode("latin-1"), c) for c in "áéíóúèìòùâêîôûãñçà"]
    steps = [
        {"c1": replaced(x, named)}, {"c2": d.sub(replaced("c1", numeric), "&#[0-9]+;", "")}, {"c3": replaced(replaced("c2", marks), broken)},
        {"c4": d.sub("c3", f"[{BLANK}]+", " ")}, {"c5": d.sub("c4", "^ | $", "")}, {"cleaned": f"trim({d.sub('c5', '<[^>]*>', '')})"},
    ]
    return steps


CLEAN = Layers(lambda d: [{"h": "coalesce(html, '')"}, *_clean(d)], ["page_id", "cleaned"])

__all__ = ["PRIMITIVES", "TEXT_QUALITY", "URLS", "PAGE_HEAD", "CLEAN", "base", "bytes_of", "ratios", "word_lists", "sentences"]

"""Settings of the operators, with their defaults, as immutable records; JSON in and out."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field


@dataclass(frozen=True)
class ExactConfig:
    algorithm: str = "sha256"  # md5, sha1, sha256, xxhash64 or text
    keep_first: bool = True


@dataclass(frozen=True)
class NearConfig:
    method: str = "minhash"  # or simhash
    threshold: float = 0.8
    permutations: int = 128
    ngram: int = 5
    bands: int = 16
    rows: int = 8
    bits: int = 64

    def __post_init__(self):
        if self.bands * self.rows > self.permutations:
            raise ValueError("bands * rows must not exceed permutations")


@dataclass(frozen=True)
class SemanticConfig:
    threshold: float = 0.85
    min_df: int = 2
    max_features: int = 10_000
    block: int = 1024


@dataclass(frozen=True)
class SoftConfig:
    min_weight: float = 0.1
    decay: float = 0.5


@dataclass(frozen=True)
class LanguageConfig:
    targets: tuple = ()
    min_confidence: float = 0.65
    min_length: int = 10
    reject_mixed: bool = True
    preprocess: bool = True


@dataclass(frozen=True)
class DecontaminationConfig:
    n: int = 13
    threshold: float = 0.1
    max_matches: int = 100
    normalize_whitespace: bool = True
    case_insensitive: bool = False
    remove_punctuation: bool = False
    uncapped_score: bool = False
    characters: bool = False
    max_frequency: int = 100

    @classmethod
    def strict(cls):
        return cls(n=8, threshold=0.01)

    @classmethod
    def fast(cls):
        return cls(threshold=0.2, max_matches=10)


@dataclass(frozen=True)
class LengthConfig:
    min_words: int = 5
    max_words: int = 1_000_000
    min_chars: int = 20
    max_chars: int = 10_000_000
    strict: bool = False


@dataclass(frozen=True)
class GibberishConfig:
    max_non_alpha: float = 0.3
    max_digit: float = 0.5
    max_symbol: float = 0.2
    max_repetition: float = 0.3
    max_run: int = 50
    min_entropy: float = 2.0


@dataclass(frozen=True)
class RepetitionConfig:
    max_line: float = 0.3
    max_ngram: float = 0.5
    min_unique_words: int = 10
    min_unique_ratio: float = 0.3
    ngram: int = 3
    max_boilerplate: float = 0.7


@dataclass(frozen=True)
class FormatConfig:
    max_html: float = 0.1
    max_code: float = 0.2
    max_single_line: float = 0.8
    max_list: float = 0.6


@dataclass(frozen=True)
class QualityConfig:
    length: LengthConfig = LengthConfig()
    gibberish: GibberishConfig = GibberishConfig()
    repetition: RepetitionConfig = RepetitionConfig()
    format: FormatConfig = FormatConfig()
    weights: tuple = (1.0, 2.0, 1.5, 1.0, 1.2)
    reject_below: float = 0.5


@dataclass(frozen=True)
class DomainConfig:
    blocked: tuple = ()
    allowed: tuple = ()
    blocked_tlds: tuple = ()
    spam_keywords: tuple = ()
    block_ip: bool = False
    check_shorteners: bool = True


@dataclass(frozen=True)
class PiiConfig:
    emails: bool = True
    phones: bool = True
    ssn: bool = True
    cards: bool = True
    ips: bool = True
    addresses: bool = True
    names: bool = False
    government_ids: bool = False
    placeholders: bool = True
    anonymize: bool = True
    safe_domains: tuple = ()


@dataclass(frozen=True)
class LicenseConfig:
    allowed: tuple = ("PUBLIC_DOMAIN", "CREATIVE_COMMONS_0", "CREATIVE_COMMONS_BY", "CREATIVE_COMMONS_BY_SA")
    blocked_domains: tuple = ()
    paywalled_domains: tuple = ()
    opted_out: tuple = ()
    removals: tuple = ()
    strict: bool = False
    confidence: float = 0.7

    @classmethod
    def strict_preset(cls):
        return cls(allowed=cls().allowed[:3], strict=True, confidence=0.8)

    @classmethod
    def permissive_preset(cls):
        return cls(allowed=(*cls().allowed, "MIT", "APACHE_2", "BSD_2_CLAUSE", "BSD_3_CLAUSE"), confidence=0.5)


@dataclass(frozen=True)
class ToxicityConfig:
    """Thresholds by category, and what a safe context multiplies a score by."""

    thresholds: dict = field(default_factory=lambda: {"hate_speech": 0.7, "harassment": 0.8, "profanity": 0.8, "violence": 0.7, "nsfw": 0.6, "threat": 0.7})
    context_factor: float = 0.5
    lexicon: dict = field(default_factory=dict)


@dataclass(frozen=True)
class ContentConfig:
    weights: tuple = (2.0, 3.0, 1.5)
    threshold: float = 0.7
    strategy: str = "strict"  # or rejections, score


def save_config(config, path: str) -> None:
    with open(path, "w") as f:
        json.dump(dataclasses.asdict(config), f, indent=2)


def load_config(kind, path: str):
    """A record of class ``kind`` from JSON; unknown names are an error."""
    with open(path) as f:
        found = json.load(f)
    types = {x.name: x for x in dataclasses.fields(kind)}
    if extra := set(found) - set(types):
        raise ValueError(f"unknown settings: {sorted(extra)}")
    default = kind()
    return kind(**{k: type(getattr(default, k))(**v) if dataclasses.is_dataclass(getattr(default, k)) else tuple(v) if isinstance(v, list) else v for k, v in found.items()})

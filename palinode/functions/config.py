"""Thresholds and weights of the passes."""

from __future__ import annotations

import dataclasses
import tomllib
from pathlib import Path


@dataclasses.dataclass(frozen=True)
class Config:
    """14 thresholds and 18 weights; any value is taken as it is."""

    flag_threshold: float = 0.25
    block_threshold: float = 0.60
    cjk_super_window: int = 6
    cjk_super_threshold: float = 0.55
    cjk_super_min_cjk_frac: float = 0.40
    morse_min_span: int = 10
    morse_min_morse_pct: int = 60
    base64_min_len: int = 12
    leet_min_alpha: int = 4
    leet_min_pct: int = 35
    entropy_high: float = 5.2
    entropy_min_english: float = 0.15
    url_min_run: int = 3
    html_min_entities: int = 4
    weight_bidi: float = 0.90
    weight_base64: float = 0.85
    weight_backslash: float = 0.80
    weight_morse: float = 0.80
    weight_url: float = 0.80
    weight_html: float = 0.80
    weight_invisible: float = 0.75
    weight_fullwidth: float = 0.65
    weight_homoglyph: float = 0.55
    weight_entropy: float = 0.50
    weight_script: float = 0.40
    weight_nfc: float = 0.35
    weight_leet: float = 0.30
    weight_split_string: float = 0.70
    weight_unicode_escape: float = 0.80
    weight_rot13: float = 0.80
    weight_punycode: float = 0.85
    weight_skeleton_match: float = 0.75

    @classmethod
    def from_toml(cls, text: str) -> Config:
        """Fields not named keep their defaults, unknown ones are ignored; raises if the text is no TOML or a value no number."""
        read = tomllib.loads(text)
        given = {}
        for field in dataclasses.fields(cls):
            if field.name in read:
                value = read[field.name]
                if isinstance(value, bool) or not isinstance(value, (int, float)) or field.type == "int" and not isinstance(value, int):
                    raise ValueError(f"{field.name} is no {field.type}: {value!r}")
                given[field.name] = value if field.type == "int" else float(value)
        return cls(**given)

    @classmethod
    def from_file(cls, path: str | Path) -> Config:
        """The configuration of a file; the defaults if it is missing or can't be read as one."""
        try:
            return cls.from_toml(Path(path).read_text())
        except (OSError, ValueError):
            return cls()

    def weight(self, kind: str) -> float:
        """The weight of a pass by its name."""
        return 1.0 if kind == "cjk-superposition" else getattr(self, "weight_" + _WEIGHT[kind])


#: The weight field of each pass.
_WEIGHT = {
    "pre-scan-nfc": "nfc", "invisible-strip": "invisible", "bidi-control": "bidi", "fullwidth-chars": "fullwidth", "backslash-escape": "backslash",
    "unicode-escape": "unicode_escape", "punycode": "punycode", "rot13": "rot13", "url-encoding": "url", "html-entities": "html", "base64": "base64",
    "morse-code": "morse", "homoglyph": "homoglyph", "script-intrusion": "script", "leetspeak": "leet", "entropy-bigram": "entropy",
    "split-string": "split_string", "skeleton-match": "skeleton_match",
}

#: Confidence of a detection before the share of the text that changed is added.
BASE_CONFIDENCE = {
    "pre-scan-nfc": 0.30, "invisible-strip": 0.90, "cjk-superposition": 1.0, "bidi-control": 0.90, "fullwidth-chars": 0.80, "backslash-escape": 0.90,
    "unicode-escape": 0.90, "punycode": 1.0, "rot13": 1.0, "url-encoding": 1.0, "html-entities": 1.0, "base64": 1.0, "morse-code": 1.0,
    "homoglyph": 0.80, "script-intrusion": 0.65, "leetspeak": 0.55, "entropy-bigram": 0.50, "split-string": 0.65, "skeleton-match": 0.80,
}

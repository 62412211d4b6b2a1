"""Settings: a frozen record a section, whose values a YAML file may replace."""

from __future__ import annotations

import dataclasses
import os
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

VARIABLE = "STRATA_CONFIG"


class Section:
    """Values by attribute or by name. What a file says beside the known names is kept in `more`."""

    def __getitem__(self, name: str) -> Any:
        return getattr(self, name) if name in self.names() else self.more[name]

    @classmethod
    def names(cls) -> set[str]:
        return {f.name for f in dataclasses.fields(cls)} - {"more"}

    def having(self, values: dict[str, Any]):
        """This section with other values; a list takes the place of the whole list that was."""
        known = {k: v for k, v in values.items() if k in self.names()}
        return dataclasses.replace(self, **known, more={**self.more, **{k: v for k, v in values.items() if k not in known}})


# Fixed values below: the settings a run has when no file changes them.


@dataclass(frozen=True)
class Crawl(Section):
    user_agent: str = "StrataBot/0.1 (+https://example.com/bot)"
    obey_robots: bool = False
    rate_limit_per_domain: float = 1.0
    timeout: float = 20.0
    max_pages: int = 50
    max_depth: int = 2
    same_domain_only: bool = True
    suffix_rules: str = ""
    max_retries: int = 3
    dynamic_fallback: bool = True
    dynamic_min_chars: int = 200
    dynamic_wait_ms: int = 2000
    render_mode: str = "auto"
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ("*/cookies*", "*/legalNotice", "*/legal-notice", "*/privacy*", "*/request-for-quote*", "*/terms*", "*/login*")
    more: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Extract(Section):
    min_text_chars: int = 200
    more: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Images(Section):
    enabled: bool = True
    min_width: int = 100
    min_height: int = 100
    max_aspect_ratio: float = 10.0
    min_bytes: int = 2048
    allowed_types: tuple[str, ...] = ("jpeg", "jpg", "png", "webp", "gif")
    phash_hamming_threshold: int = 6
    more: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Dedup(Section):
    text_near_dup: bool = True
    minhash_threshold: float = 0.85
    more: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Output(Section):
    root: str = "knowledge"
    image_base_url: str = ""
    more: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Config:
    crawl: Crawl = Crawl()
    extract: Extract = Extract()
    images: Images = Images()
    dedup: Dedup = Dedup()
    output: Output = Output()
    more: dict = field(default_factory=dict)

    def with_values(self, section: str, **values: Any) -> Config:
        """A copy with those values of a section that are not None."""
        return self.having({section: {k: v for k, v in values.items() if v is not None}})

    def having(self, told: dict[str, Any]) -> Config:
        known = {k: getattr(self, k).having(v) for k, v in told.items() if isinstance(getattr(self, k, None), Section) and v}
        return dataclasses.replace(self, **known, more={**self.more, **{k: v for k, v in told.items() if not isinstance(getattr(self, k, None), Section)}})


def load_config(path: str | Path | None = None) -> Config:
    """Built-in values under those of the first file named: the one asked for, the environment's, or ./config/settings.yaml, which need not be there."""
    candidates = [(path, True), (os.environ.get(VARIABLE), True), (Path("config", "settings.yaml"), False)]
    named, required = next((Path(p), must) for p, must in candidates if p)
    if not named.is_file():
        if required:
            raise FileNotFoundError(f"no configuration at {named}")
        return Config()
    import yaml

    with named.open(encoding="utf-8") as f:
        return Config().having(yaml.safe_load(f) or {})

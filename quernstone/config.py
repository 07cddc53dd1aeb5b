"""Settings with their defaults and checks; from_env reads QUERNSTONE_<NAME> variables."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from quernstone.operators.index import Analyser
from quernstone.operators.sharding import parse_group


@dataclass(frozen=True)
class Config:
    spaces: tuple[str, ...] = ("main",)
    shard: str = "1/1"
    languages: tuple[str, ...] = ("english",)
    remove_diacritics: bool = True
    token_chars: str = ""
    separators: str = ""
    least_token_bytes: int = 2
    stopword_cutoff: float = 1.0  # percent of all occurrences
    spelling_least_count: int = 5
    spelling_most_lag: int = 100
    result_cap: int = 10_000
    cache_mb: int = 250
    cache_seconds: float = 600.0
    snippet: str = "window"
    request_seconds: float = 3.0
    expire_seconds: float = 30.0

    def __post_init__(self) -> None:
        index, size = parse_group(self.shard)
        if not self.spaces or len(set(self.spaces)) != len(self.spaces) or not all(self.spaces):
            raise ValueError("spaces must be named, and each once")
        if not 0 <= self.stopword_cutoff <= 100:
            raise ValueError("the stopword cutoff is a percentage")
        if self.request_seconds <= 0 or self.expire_seconds < self.request_seconds or self.cache_seconds < 0:
            raise ValueError("durations must be positive, and a request's shorter than a list's")
        if self.result_cap < 1 or self.cache_mb < 0 or self.least_token_bytes < 1:
            raise ValueError("limits must be positive")
        if self.snippet not in ("window", "tokens", "title"):
            raise ValueError("snippet: window, tokens or title")

    @property
    def shard_index(self) -> int:
        return parse_group(self.shard)[0]

    @property
    def shard_size(self) -> int:
        return parse_group(self.shard)[1]

    def analyser(self) -> Analyser:
        return Analyser(self.languages, self.remove_diacritics, self.token_chars, self.separators, self.least_token_bytes)

    @staticmethod
    def from_env(env: dict[str, str] | None = None) -> Config:
        env = dict(os.environ) if env is None else env
        found = {}
        for f in fields(Config):
            raw = env.get(f"QUERNSTONE_{f.name.upper()}")
            if raw is None:
                continue
            if isinstance(f.default, tuple):
                found[f.name] = tuple(x.strip() for x in raw.split(",") if x.strip())
            elif isinstance(f.default, bool):
                found[f.name] = raw.lower() in ("1", "true", "yes")
            else:
                found[f.name] = type(f.default)(raw)
        return Config(**found)

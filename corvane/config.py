"""Run settings and their checks."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from urllib.parse import urlparse

PREFIX = "CORVANE_"


@dataclass(frozen=True)
class Settings:
    environment: str = "dev"
    max_spend_usd: float = 0.0
    provider: str = "mock"
    model: str = "mock"
    allow_mock_api: bool = False
    input_usd_per_million: float = 0.0
    output_usd_per_million: float = 0.0
    max_output_tokens: int = 2048
    base_url: str = ""
    api_key: str = ""
    store: str = "data/store"
    embedding_model: str = "hashing-64"
    retriever: str = "hybrid"
    query_preprocess: str = "none"
    retrieve_top_n: int = 20
    top_k: int = 5
    score_floor: float | None = None
    reranker: str = ""

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        env, given = os.environ if env is None else env, {}
        for f in fields(cls):
            raw = env.get(PREFIX + f.name.upper())
            if raw is not None:
                kind = type(f.default) if f.default is not None else float
                given[f.name] = raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw)
        return cls(**given)

    @property
    def is_free(self) -> bool:
        local = (urlparse(self.base_url).hostname or "").lower() in ("localhost", "127.0.0.1", "::1")
        return self.provider == "mock" or (self.provider == "openai-compatible" and local)

    def __post_init__(self) -> None:
        paid = self.provider != "mock" and not self.is_free
        prices = (self.input_usd_per_million, self.output_usd_per_million)
        for broken, why in (
            (self.max_spend_usd < 0, "the spending cap can't be negative"),
            (min(prices) < 0, "token prices can't be negative"),
            (self.max_output_tokens < 1, "the output limit must be positive"),
            (min(self.retrieve_top_n, self.top_k) < 1, "retrieval limits must be positive"),
            (self.top_k > self.retrieve_top_n, "top_k can't exceed retrieve_top_n"),
            (self.retriever not in ("dense", "bm25", "hybrid"), "the retriever must be dense, bm25 or hybrid"),
            (self.query_preprocess not in ("none", "lowercase", "query_expansion"), "query_preprocess must be none, lowercase or query_expansion"),
            (self.provider not in ("mock", "openai-compatible", "anthropic"), "the provider must be mock, openai-compatible or anthropic"),
            (paid and self.max_spend_usd <= 0, "paid providers need a positive spending cap"),
            (paid and min(prices) <= 0, "paid providers need both token prices"),
            (self.provider == "anthropic" and not self.api_key, "the anthropic provider needs a key"),
            (self.provider == "openai-compatible" and not self.base_url, "the openai-compatible provider needs a URL"),
        ):
            if broken:
                raise ValueError(why)

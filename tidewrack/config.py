"""Settings of a crawl, as plain values."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class Mode(str, Enum):
    SINGLE_DOMAIN = "single_domain"
    CROSS_DOMAIN = "cross_domain"
    WHITELIST = "whitelist"
    GRAPH = "graph"
    FOCUSED = "focused"

    @classmethod
    def of(cls, text: str) -> Mode:
        """The mode of that name; an unknown one is single_domain."""
        return next((m for m in cls if m.value == text), cls.SINGLE_DOMAIN)


@dataclass(frozen=True)
class GraphConfig:
    """file_type_filters and cross_domain_delay_multiplier are accepted and change nothing."""

    mode: Mode = Mode.SINGLE_DOMAIN
    max_depth: int = 3
    max_domains: int = 100
    allowed: frozenset[str] = frozenset()
    blocked: frozenset[str] = frozenset()
    priority: frozenset[str] = frozenset()
    keywords: tuple[str, ...] = ()
    file_type_filters: frozenset[str] = frozenset()
    min_domain_score: float = 0.1
    cross_domain_delay_multiplier: float = 2.0
    #: "observed": extensions are compared without a dot, so only paths without one match a rule;
    #: "dotted": the rules as they read.
    extension_rules: str = "observed"


@dataclass(frozen=True)
class RetryConfig:
    max_attempts: int = 3
    base_delay: float = 1.0
    max_delay: float = 60.0
    exponential_base: float = 2.0
    retryable: tuple[str, ...] = ("network_timeout", "connection_error", "http_server_error", "rate_limited")


@dataclass(frozen=True)
class PolicyConfig:
    default_delay: float = 1.0
    user_agent: str = "tidewrack/1.0"
    failure_threshold: int = 5
    recovery_seconds: float = 60.0


@dataclass(frozen=True)
class CrawlConfig:
    seeds: tuple[str, ...] = ()
    max_pages: int = 100
    graph: GraphConfig = field(default_factory=GraphConfig)
    max_css_files: int = 50
    dom_depth: int = 8

"""tidewrack: set-oriented analytics over crawled web data, on PySpark."""

from importlib import import_module

_FROM = {
    "config": ("CrawlConfig", "GraphConfig", "Mode", "PolicyConfig", "RetryConfig"),
    "plans.builder": ("Crawl", "CrawlBuilder"),
    "session": ("clean", "make_session", "ship", "store", "table"),
}
__all__ = [name for names in _FROM.values() for name in names]
__version__ = "0.2.0"


def __getattr__(name: str):
    """Public names are looked up when asked for, so that Python workers load only what they run."""
    for module, names in _FROM.items():
        if name in names:
            return getattr(import_module(f"tidewrack.{module}"), name)
    raise AttributeError(name)

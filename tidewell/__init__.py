"""A PySpark engine for mining documentation sites.

The commands as plans: ``crawl_site``, ``crawl_live``, ``scrape_one``,
``scrape_urls``, ``scrape_live``, ``find``, ``link_check``. They are imported
when first asked for.
"""

from importlib import import_module

_WHERE = {"find": "operators.search", "link_check": "operators.linkcheck"} | dict.fromkeys(("crawl_site", "crawl_live", "scrape", "scrape_one", "scrape_urls", "scrape_live"), "plans.commands")
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name in _WHERE:
        return getattr(import_module(f"tidewell.{_WHERE[name]}"), name)
    raise AttributeError(name)

"""Options of a crawl, with the defaults of every flag."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CrawlOptions:
    url: str | None = None
    urls_file: str | None = None
    crawl_start: str | None = None
    out_dir: str = ".docs"
    concurrency: int = 4
    timeout_ms: int = 15_000
    retries: int = 2
    user_agent: str = "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/144.0.0.0 Safari/537.36"
    verbose: bool = False
    overwrite_llms: bool = False
    clutter: bool = False
    render: bool = True
    progress: bool = True
    max_depth: int = 4
    max_pages: int = 6000
    delay_ms: int = 150
    respect_robots: bool = True


@dataclass(frozen=True)
class FindOptions:
    query: str
    directory: str = ".docs"
    files_only: bool = False
    content_only: bool = False
    limit: int = 20
    context_lines: int = 2

"""Command line: crawl, url, urls, find, link-check."""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields
from typing import NoReturn
from urllib.parse import urlsplit

from tidewell.options import CrawlOptions, FindOptions

COMMANDS = ("crawl", "url", "urls", "find", "link-check", "version")
ALIASES = {"linkcheck": "link-check", "scrape": "crawl", "--version": "version"}


def positive_int(text: str) -> int:
    """A whole number; whatever follows its digits is ignored, others are refused."""
    import re

    m = re.match(r"\s*([+-]?\d+)", text)
    if not m:
        raise argparse.ArgumentTypeError(f"not a number: {text}")
    return max(0, int(m[1]))


def checked_url(text: str) -> str:
    u = urlsplit(text)
    if u.scheme not in ("http", "https") or not u.hostname:
        raise argparse.ArgumentTypeError(f"invalid URL: {text}")
    return text


class Parser(argparse.ArgumentParser):
    """Wrong arguments give the help, the reason and exit code 1."""

    def error(self, message: str) -> NoReturn:
        self.print_help(sys.stderr)
        self.exit(1, f"\n{self.prog}: {message}\n")


def parser() -> argparse.ArgumentParser:
    p = Parser(prog="tidewell", description="Mine documentation sites with Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    default = CrawlOptions()
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("-o", "--out-dir", default=default.out_dir)
    common.add_argument("--snapshot", help="Parquet folder with pages (url, html) to take pages from instead of the network")
    for name in ("concurrency", "timeout_ms", "retries", "max_depth", "max_pages", "delay_ms"):
        flag = "--" + name.removesuffix("_ms").replace("_", "-")
        common.add_argument(flag, dest=name, type=positive_int, default=getattr(default, name))
    common.add_argument("--user-agent", default=default.user_agent)
    for f in fields(CrawlOptions):
        if f.type == "bool":
            common.add_argument("--" + f.name.replace("_", "-"), dest=f.name, action=argparse.BooleanOptionalAction, default=getattr(default, f.name))
    sub.add_parser("crawl", parents=[common]).add_argument("crawl_start", type=checked_url)
    sub.add_parser("url", parents=[common]).add_argument("url", type=checked_url)
    many = sub.add_parser("urls", parents=[common])
    many.add_argument("urls_file")
    many.add_argument("--url", type=checked_url)
    find = sub.add_parser("find")
    find.add_argument("query")
    find.add_argument("-d", "-o", "--directory", default=FindOptions("").directory)
    find.add_argument("--files-only", action="store_true")
    find.add_argument("--content-only", action="store_true")
    find.add_argument("-n", "--limit", type=positive_int, default=20)
    find.add_argument("-C", "--context", dest="context_lines", type=positive_int, default=2)
    check = sub.add_parser("link-check")
    check.add_argument("-o", "-d", "--directory", default=default.out_dir)
    check.add_argument("--verbose", action="store_true")
    sub.add_parser("version")
    return p


def parse_args(argv: list[str]) -> argparse.Namespace:
    """A bare URL means crawl; long flags may be written in any case, short ones mean themselves."""
    argv = [name.lower() + gap + value if a.startswith("--") else a for a in argv for name, gap, value in [a.partition("=")]]
    if argv and argv[0] in ALIASES:
        argv[0] = ALIASES[argv[0]]
    elif argv and argv[0] not in COMMANDS and not argv[0].startswith("-"):
        argv = ["crawl", *argv]
    return parser().parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    args = parse_args(sys.argv[1:] if argv is None else argv)
    if args.command == "version":
        print("tidewell 0.1")
        return 0
    from tidewell.plans import commands

    return commands.run(args)


if __name__ == "__main__":
    sys.exit(main())

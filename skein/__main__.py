"""python -m skein PATH QUERY: the context for a query, to standard output or a file."""

from __future__ import annotations

import argparse
import shutil
import sys


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser("skein", description=__doc__)
    p.add_argument("path")
    p.add_argument("query")
    p.add_argument("-b", "--budget", default="50k")
    p.add_argument("-o", "--output")
    p.add_argument("-i", "--include", action="append", default=[])
    p.add_argument("-e", "--exclude", action="append", default=[])
    p.add_argument("-f", "--format", choices=["markdown", "xml"], default="markdown")
    p.add_argument("-p", "--profile", choices=["P", "B"], default="B")
    p.add_argument("-s", "--semantic", action="store_true", help="importance as well as keywords (profile B)")
    p.add_argument("--force-large", action="store_true")
    p.add_argument("--cache", help="folder of the chunk cache")
    p.add_argument("--clean-cache", action="store_true")
    p.add_argument("-c", "--context-only", action="store_true", help="no line of statistics on standard error")
    a = p.parse_args(argv)
    if a.clean_cache and a.cache:
        shutil.rmtree(a.cache, ignore_errors=True)

    from pyspark.sql import SparkSession

    from skein.plans.engine import ContextEngine

    engine = ContextEngine(SparkSession.builder.getOrCreate(), a.profile, a.budget, fast=not a.semantic, cache_dir=a.cache)
    text = engine.build(a.path, a.query, a.format, include=a.include, exclude=a.exclude, force_large=a.force_large)
    if not a.context_only and engine.stats:
        s = engine.stats
        share = 100 * s["total_tokens"] // max(1, s["budget"])
        sys.stderr.write(f"{s['files_included']}/{s['files_scanned']} files, {s['chunks']} chunks, {s['total_tokens']:,} tokens, {share} % of the budget\n")
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        sys.stdout.write(text + "\n")


if __name__ == "__main__":
    main()

"""Command line: ``python -m terravane.cli list | run NAME | sql TEXT | score PRESET | validate`` over a folder of tables."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from terravane import catalog, config
from terravane.operators import governance, runs, scoring
from terravane.plans import projection, views
from terravane.runtime import shared_dir


def presets(path: str | None) -> dict[str, config.Preset]:
    """The built-in presets, and those of a JSON file of name -> values, which start from the default."""
    found = dict(config.PRESETS)
    for name, values in json.loads(Path(path).read_text()).items() if path else ():
        found[name] = config.preset_from(values)
    return found


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="terravane", description=__doc__)
    parser.add_argument("command", choices=["list", "run", "sql", "score", "validate"])
    parser.add_argument("name", nargs="?", help="query, SQL text or preset")
    parser.add_argument("--tables", default="/root/testdata/sf0.01", help="folder of Parquet tables")
    parser.add_argument("--presets", help="JSON file of scoring presets")
    parser.add_argument("--limit", type=int, default=20)
    parser.add_argument("--out", help="write the whole result here as Parquet instead of printing rows")
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    if spark is None:
        spark = SparkSession.builder.appName("terravane").getOrCreate()
    view = lambda name: views.view(spark, args.tables, name)
    if args.command == "validate":
        checks = [governance.row_bounds(view(t), t, 1, 10**12) for t in ("cells", "power_lines", "substations")]
        found, summary, code = runs.run_checks(checks, args.out or f"{shared_dir(spark)}/checks")
        found.show(args.limit, False)
        print(json.dumps(summary))
        return code
    if args.command == "run":
        if args.name not in catalog.QUERIES:
            print(f"unknown query: {args.name}", file=sys.stderr)
            return 2
        df = catalog.QUERIES[args.name](spark, args.tables)
    elif args.command == "score":
        known = presets(args.presets)
        if args.name not in known:
            print(f"unknown preset: {args.name}", file=sys.stderr)
            return 2
        df = scoring.score(view("features").filter("not is_excluded"), known[args.name]).orderBy(F.desc("score"), "cell_id")
    else:
        df = projection.ask({t: view(t) for t in views.VIEWS}, args.name, args.limit)
    if args.out:
        df.write.mode("error").parquet(args.out)
    else:
        df.show(args.limit, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Command line: run the report on a folder of raw tables.

    python -m tidemark list
    python -m tidemark show NAME [--sf-dir DIR | --star DIR] [--rows N] [--as-of YYYY-MM-DD]
    python -m tidemark sql "SELECT ... FROM acv ..." [--sf-dir DIR | --star DIR]
    python -m tidemark build --out DIR [--sf-dir DIR] [--resume]

``--sf-dir`` derives the star from raw tables; ``--star`` reads a stored star
(``OUT/star`` of a build).

`sql` registers every result as a temp view named by its key (Spark parses
and plans the statement); `build` stores the star and all results
(``materialize.build_all``).
"""

from __future__ import annotations

import argparse
import sys
from datetime import date

from tidemark.params import Params
from tidemark.plans import catalog, materialize, registry
from tidemark.session import local_session
from tidemark.sources.star import load_star, read_star

DEFAULT_DIR = "/root/testdata/sf0.01"


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="tidemark")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    for name in ("show", "sql", "build"):
        p = sub.add_parser(name)
        p.add_argument("--sf-dir", default=DEFAULT_DIR)
        if name != "build":
            p.add_argument("--star", help="folder of a build (or a stored star) instead of raw tables")
        p.add_argument("--as-of", type=date.fromisoformat, default=Params().as_of)
        if name == "show":
            p.add_argument("name", choices=sorted(registry.ALL))
        if name == "sql":
            p.add_argument("statement")
        if name in ("show", "sql"):
            p.add_argument("--rows", type=int, default=20)
        if name == "build":
            p.add_argument("--out", required=True)
            p.add_argument("--resume", action="store_true")
    args = ap.parse_args(argv)

    if args.cmd == "list":
        print("\n".join(registry.ALL))
        return 0
    spark = local_session()
    star = getattr(args, "star", None)
    t = read_star(spark, materialize.current_star(spark, star)) if star else load_star(spark, args.sf_dir)
    params = Params(as_of=args.as_of)
    if args.cmd == "show":
        registry.run(args.name, t, params).show(args.rows, truncate=False)
    elif args.cmd == "sql":
        catalog.register_views(t, params)
        spark.sql(args.statement).show(args.rows, truncate=False)
    else:
        for name, path in materialize.build_all(t, params, args.out, resume=args.resume).items():
            print(f"{name}\t{path}")
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())

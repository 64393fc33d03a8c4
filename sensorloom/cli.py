"""Command line: run a plan over an archive store, or list its tags."""

from __future__ import annotations

import argparse
import sys

from .errors import Refusal
from .plans import documents, runner
from .session import local_session
from .sources.archives import Store


def main(argv: list[str] | None = None) -> int:
    """0: done; 2: a mistake in the arguments; 3: a refusal."""
    parser = argparse.ArgumentParser(prog="sensorloom", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    tags = sub.add_parser("tags", help="list the tags of a store")
    tags.add_argument("store")
    run = sub.add_parser("run", help="run a TOML plan")
    run.add_argument("store")
    run.add_argument("plan")
    run.add_argument("--html", help="also write a static report here")
    run.add_argument("--out", help="also write whole result tables below this folder")
    args = parser.parse_args(argv)
    spark = local_session()
    store = Store(spark, args.store)
    try:
        if args.command == "tags":
            print(documents.text_table([r.asDict() for r in store.list_tags().collect()]))
            return 0
        with open(args.plan, encoding="utf-8") as f:
            results, refusals = runner.execute(store.samples(), runner.load_plan(f.read()))
        book = runner.ledger(args.plan, results, refusals, args.out)
        print(documents.document("run", book))
        if args.html:
            with open(args.html, "w", encoding="utf-8") as f:
                f.write(documents.html_report(args.plan, book["findings"]))
        return 0
    except Refusal as refusal:
        print(documents.refusal_document(refusal))
        return 3
    except ValueError as mistake:
        print(mistake, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())

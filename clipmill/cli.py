"""Command line over ``api.Collection``."""

from __future__ import annotations

import argparse
import json
from datetime import datetime

from .api import Collection, rows_json
from .functions.backends import LocalServer, Offline
from .operators.worklists import REASONS
from .session import session
from .sources.config import Models, Tags


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="clipmill")
    p.add_argument("--store", required=True)
    p.add_argument("--tags")
    p.add_argument("--models")
    p.add_argument("--master")
    p.add_argument("--include-all", action="store_true")
    p.add_argument("--exclude", action="append")
    p.add_argument("--include", action="append")
    verbs = p.add_subparsers(dest="verb", required=True)
    a = verbs.add_parser("ingest")
    a.add_argument("folder")
    a.add_argument("--force", action="store_true")
    a.add_argument("--on-gray", choices=("queue", "supersede", "keep_both"), default="queue")
    a = verbs.add_parser("about")
    a.add_argument("query")
    a.add_argument("--method", choices=("semantic", "exact"), default="semantic")
    a.add_argument("--limit", type=int, default=10)
    a.add_argument("--sort", choices=("score", "date"), default="score")
    for name in ("author", "date-from", "date-to", "project"):
        a.add_argument(f"--{name}")
    a = verbs.add_parser("in")
    a.add_argument("document", type=int)
    a = verbs.add_parser("browse")
    a.add_argument("--sort", choices=("source", "doctype", "date"), default="date")
    a.add_argument("--ascending", action="store_true")
    a.add_argument("--tag")
    a = verbs.add_parser("dump")
    a.add_argument("title", nargs="?")
    a = verbs.add_parser("sync")
    a.add_argument("registry")
    a.add_argument("--project")
    for name in ("embed", "derive", "extract"):
        a = verbs.add_parser(name)
        a.add_argument("--limit", type=int)
        for flag in {"derive": (*REASONS, "force", "status"), "extract": ("force", "status")}.get(name, ()):
            a.add_argument("--" + flag.replace("_", "-"), action="store_true")
    verbs.add_parser("diff").add_argument("--force", action="store_true")
    a = verbs.add_parser("relations")
    a.add_argument("action", choices=("repair", "scan", "diff"))
    a.add_argument("--document", type=int, help="repair the family of this document alone; the newer one of a diff")
    a.add_argument("--other", type=int, help="the older document of a diff")
    verbs.add_parser("stats")
    verbs.add_parser("index")
    a = verbs.add_parser("serve")
    a.add_argument("--port", type=int, default=8080)
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    models = Models.load(args.models) if args.models else Models()
    backend = LocalServer(models.url) if models.backend == "local" else Offline()
    c = Collection(session(args.master), args.store, Tags.load(args.tags) if args.tags else Tags(), models, backend)
    hide = {"exclude": args.exclude, "include_all": args.include_all}
    if args.verb == "ingest":
        out = rows_json(c.ingest(args.folder, force=args.force, on_gray=args.on_gray))
    elif args.verb == "about":
        options = {"author": args.author, "date_from": args.date_from, "date_to": args.date_to, "project": args.project, "sort": args.sort} | hide
        out = rows_json(c.search(args.query, **options) if args.method == "exact" else c.similar(args.query, args.limit, **options))
    elif args.verb == "in":
        out = rows_json(c.document(args.document))
    elif args.verb == "browse":
        out = rows_json(c.listing(args.sort, not args.ascending, args.include, tag=args.tag, **hide))
    elif args.verb == "dump":
        out = rows_json(c.dump(args.title))
    elif args.verb == "sync":
        out = [r for df in c.sync(args.registry, datetime.now().strftime("%Y-%m-%dT%H:%M:%S"), args.project) for r in rows_json(df)]
    elif getattr(args, "status", False):
        out = rows_json(c.derive_status() if args.verb == "derive" else c.extraction_status())
    elif args.verb == "derive":
        # As the flags say; without one, documents that have no summary.
        reasons = tuple(r for r in REASONS if getattr(args, r)) or ("missing",)
        out = {"derive": c.derive(limit=args.limit, force=args.force, reasons=reasons)}
    elif args.verb == "extract":
        out = {"extract": c.extract(limit=args.limit, force=args.force)}
    elif args.verb == "embed":
        out = {"embed": c.embed(limit=args.limit)}
    elif args.verb == "diff":
        out = {"diff": c.diff(args.force)}
    elif args.verb == "relations":
        if args.action == "diff" and (args.document is None or args.other is None):
            raise SystemExit("diff needs --document and --other")
        out = rows_json(c.difference(args.other, args.document) if args.action == "diff" else c.repair(args.document) if args.action == "repair" else c.scan())
    elif args.verb == "index":
        c.index()
        out = {"index": "done"}
    elif args.verb == "stats":
        out = rows_json(c.stats()) + rows_json(c.derive_status()) + rows_json(c.extraction_status())
    else:
        from .serve import serve

        return serve(c, args.port)
    print(json.dumps(out, indent=2, ensure_ascii=False))


if __name__ == "__main__":
    main()

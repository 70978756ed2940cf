"""A small HTTP server with JSON answers."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from .api import Collection, NotEmbedded, rows_json
from .functions.text import MARKERS

MARK_TABLE = str.maketrans("", "", MARKERS)


def answer(c: Collection, url: str) -> tuple[int, object]:
    """Status and body for a path with its query."""
    parts = urlparse(url)
    q = {k: v[-1] for k, v in parse_qs(parts.query).items()}
    options = {k: q.get(k) for k in ("author", "date_from", "date_to", "project")} | {"include_all": q.get("include_hidden") in ("1", "true"), "sort": q.get("sort", "score")}
    path = [x for x in parts.path.split("/") if x]
    try:
        match path:
            case ["search"]:
                found = rows_json(c.search(q.get("q", ""), **options))
                for doc in found:
                    for hit in doc["chunks"]:
                        hit["snippet"] = hit.get("snippet", "").translate(MARK_TABLE)
                return 200, found
            case ["similar"]:
                return 200, rows_json(c.similar(q.get("q", ""), int(q.get("limit", 10)), **options))
            case ["get", number]:
                found = rows_json(c.document(int(number)))
                return (200, found[0]) if found else (404, {"error": "no such document"})
            case ["entries", number]:
                return 200, rows_json(c.entries(int(number)))
            case ["stats"]:
                return 200, rows_json(c.stats())[0]
            case ["derive", "status"]:
                return 200, rows_json(c.derive_status())[0]
            case ["derived", number]:
                return 200, rows_json(c.derived(int(number), q.get("type")))
            case ["difference", old, new]:
                return 200, rows_json(c.difference(int(old), int(new)))
            case ["claims", "doc", number]:
                return 200, rows_json(c.claims(int(number)))
            case ["claims", "similar"]:
                return 200, rows_json(c.similar_claims(q.get("q", ""), int(q.get("limit", 10)), include_all=options["include_all"]))
    except NotEmbedded as e:
        return 409, {"error": str(e)}
    except ValueError as e:
        return 400, {"error": str(e)}
    return 404, {"error": "no such path"}


def serve(c: Collection, port: int) -> None:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            status, body = answer(c, self.path)
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

    ThreadingHTTPServer(("127.0.0.1", port), Handler).serve_forever()

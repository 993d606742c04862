"""Command line: `index DIR`, `onboard DIR [HOME]`, `search QUERY`, `status`, `folders`, `reset`, `serve [PORT]`, with --index
PATH and --models PATH.

The folder of models holds `embedder` and `reranker`, each with model.onnx and tokenizer.json; without --models it is looked
for (resolve_model_path). Where there is an embedder only, its vectors rerank; where there is none, the stand-ins work.
"""

from __future__ import annotations

import argparse
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlparse

from pyspark.sql import SparkSession

from .operators.engine import Config, Engine, IndexOptions
from .operators.models import DotReranker, OnnxEmbedder, OnnxReranker, resolve_model_path
from .session import clear_scratch


def providers(models: str | None = None) -> dict:
    """The embedder and reranker that an Engine takes, from the folder of models."""
    where = {name: Path(models) / name if models else resolve_model_path(name) for name in ("embedder", "reranker")}
    found = {name: str(p) for name, p in where.items() if p is not None and p.exists()}
    if models and not found:
        raise FileNotFoundError(f"{models} has neither embedder nor reranker")
    out: dict = {}
    if "embedder" in found:
        out["embedder"] = OnnxEmbedder(found["embedder"])
        out["reranker"] = DotReranker(out["embedder"])
    if "reranker" in found:
        out["reranker"] = OnnxReranker(found["reranker"])
    return out


def serve(engine: Engine, port: int = 8765) -> ThreadingHTTPServer:
    """HTTP: GET /api/search?q=, /api/health, /api/folders, /api/status; POST /api/index, /api/onboard with JSON."""
    busy = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def _say(self, body, code: int = 200) -> None:
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            url = urlparse(self.path)
            if url.path == "/api/search":
                self._say(engine.answer(parse_qs(url.query).get("q", [""])[0]))
            elif url.path == "/api/health":
                self._say({"ok": True})
            elif url.path == "/api/folders":
                self._say([r["dir"] for r in engine.store.indexed_dirs().orderBy("seq").collect()])
            elif url.path == "/api/status":
                self._say({**engine.status(), "indexing": busy.locked()})
            else:
                self._say({"error": "not found"}, 404)

        def do_POST(self) -> None:
            body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            jobs = {
                "/api/index": lambda: engine.index(body["dir"], IndexOptions.background() if body.get("mode") == "background" else None),
                "/api/onboard": lambda: engine.onboard(body["dir"], body.get("home")),
            }
            job = jobs.get(urlparse(self.path).path)
            if job is None:
                return self._say({"error": "not found"}, 404)
            if not busy.acquire(blocking=False):
                return self._say({"status": "busy"}, 409)

            def run() -> None:
                try:
                    job()
                    engine.prepare()
                finally:
                    busy.release()

            threading.Thread(target=run, daemon=True).start()
            self._say({"status": "started"})

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quarrylens")
    p.add_argument("--index", default="quarrylens-index")
    p.add_argument("--models")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index").add_argument("dir")
    onboard = sub.add_parser("onboard")
    onboard.add_argument("dir")
    onboard.add_argument("home", nargs="?")
    sub.add_parser("search").add_argument("query")
    for name in ("status", "folders", "reset"):
        sub.add_parser(name)
    sub.add_parser("serve").add_argument("port", nargs="?", type=int, default=8765)
    a = p.parse_args(args)
    engine = Engine(SparkSession.builder.appName("quarrylens").getOrCreate(), Config(a.index), **providers(a.models))
    if a.command in ("index", "onboard"):
        print(json.dumps(engine.index(a.dir) if a.command == "index" else engine.onboard(a.dir, a.home)))
        engine.prepare()
        clear_scratch(engine.spark)
    elif a.command == "status":
        print(json.dumps(engine.status()))
    elif a.command == "folders":
        print(*(r["dir"] for r in engine.store.indexed_dirs().orderBy("seq").collect()), sep="\n")
    elif a.command == "reset":
        engine.reset()
    elif a.command == "search":
        for bucket, rows in engine.answer(a.query).items():
            print(bucket)
            for r in rows:
                text = r["text"].replace("\n", " ")
                print(f"  {r['score']:.4f}  {r['filePath']}\n    {text[:80] + '...' if len(text) > 80 else text}")
    else:
        serve(engine, a.port).serve_forever()


if __name__ == "__main__":
    main()

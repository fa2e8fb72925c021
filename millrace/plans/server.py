"""The control plane over HTTP: health, metrics, jobs. No pages, only JSON and Prometheus' text."""

from __future__ import annotations

import hmac
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from ..streaming.observe import Progress, prometheus
from .catalog import catalog
from .graph import render
from .spec import JobError, load
from .store import Runner

#: Paths that need no token, for orchestrators and scrapers.
OPEN = {"/healthz", "/readyz", "/metrics"}
#: Bytes of a request's body at most.
MOST = 1 << 20


class Control:
    """Serves a runner on ``port`` (0: any free one). With ``token`` all but the open paths need ``Authorization: Bearer <token>``."""

    def __init__(self, runner: Runner, port: int = 0, host: str = "127.0.0.1", token: str | None = None, progress: Progress | None = None) -> None:
        self.runner, self.token, self.progress = runner, token, progress or Progress()
        runner.spark.streams.addListener(self.progress)
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def _answer(self, method: str) -> None:
                url = urlsplit(self.path)
                if url.path not in OPEN and outer.token and not hmac.compare_digest(self.headers.get("Authorization", "").encode(), f"Bearer {outer.token}".encode()):
                    return self._say(401, {"error": "a token is needed"})
                size = int(self.headers.get("Content-Length") or 0)
                if size > MOST:
                    return self._say(413, {"error": "the body is too large"})
                query = {k: v[-1] for k, v in parse_qs(url.query).items()}
                try:
                    code, body = outer.handle(method, url.path, query, self.rfile.read(size).decode())
                except (JobError, ValueError, KeyError) as e:
                    code, body = 400, {"error": str(e)}
                except FileNotFoundError:
                    code, body = 404, {"error": "no such job"}
                except RuntimeError as e:
                    code, body = 409, {"error": str(e)}
                self._say(code, body)

            def _say(self, code: int, body) -> None:
                text = isinstance(body, str)
                data = (body if text else json.dumps(body, default=str)).encode()
                self.send_response(code)
                self.send_header("Content-Type", "text/plain; version=0.0.4" if text else "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def do_GET(self) -> None:
                self._answer("GET")

            def do_POST(self) -> None:
                self._answer("POST")

            def do_DELETE(self) -> None:
                self._answer("DELETE")

            def log_message(self, *args) -> None:
                pass

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.port = self.server.server_address[1]
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def handle(self, method: str, path: str, query: dict[str, str], body: str) -> tuple[int, object]:
        store, runner = self.runner.store, self.runner
        match method, path.strip("/").split("/"):
            case "GET", ["healthz"] | ["readyz"]:
                return 200, {"status": "ok"}
            case "GET", ["metrics"]:
                return 200, prometheus(self.progress.figures)
            case "GET", ["api", "palette"]:
                return 200, catalog()
            case "GET", ["api", "status"]:
                return 200, runner.status()
            case "GET", ["api", "sample"]:
                return 200, runner.sample(query.get("name"), query.get("stage"))
            case "GET", ["api", "graph"]:
                return 200, json.loads(render(load(store.text(query["name"])), "json"))
            case "GET", ["api", "dlq"]:
                run = runner.pick(query.get("name"))
                held = run.stream.quarantine if run and run.stream else None
                return 200, {"total": held.total, "rows": list(held.rows)} if held else {"total": 0, "rows": []}
            case "GET", ["api", "jobs"]:
                return 200, store.names()
            case "POST", ["api", "jobs"]:
                return 201, {"name": store.save(body).name}
            case "GET", ["api", "jobs", name]:
                return 200, store.text(name)
            case "DELETE", ["api", "jobs", name]:
                runner.stop(name)
                store.delete(name)
                return 200, {"name": name}
            case "POST", ["api", "jobs", name, "duplicate"]:
                return 201, {"name": store.duplicate(name, json.loads(body)["name"]).name}
            case "POST", ["api", "validate"]:
                spec = load(body)
                return 200, {"name": spec.name, "stages": len(spec.stages)}
            case "POST", ["api", "run"]:
                asked = json.loads(body)
                runner.start(asked["name"], **({"bounded": int(asked["rows"])} if "rows" in asked else {}))
                return 202, {"name": asked["name"]}
            case "POST", ["api", "stop"]:
                asked = json.loads(body or "{}")
                runner.stop(asked["name"]) if "name" in asked else runner.stop_all()
                return 200, runner.status()
        return 404, {"error": f"no such path: {path}"}

    def close(self) -> None:
        self.runner.stop_all()
        self.runner.spark.streams.removeListener(self.progress)
        self.server.shutdown()
        self.server.server_close()

"""The service over HTTP, by the standard library alone: POST /chat, POST /search, GET /health, JSON in and out."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from quarry.operators import service
from quarry.operators.agent import Agent

DEFAULT_PORT, MOST_BODY = 8001, 1 << 20


def handler(agent: Agent, sessions: service.Sessions, checks: dict[str, Callable]) -> type[BaseHTTPRequestHandler]:
    def chat(body: dict) -> dict:
        return service.chat(agent, sessions, body.get("user_input"), body.get("session_id") or "default")

    def search(body: dict) -> dict:
        return service.search(agent, body.get("query"), body.get("top_k", 20), body.get("top_n", 5), body.get("filters"))

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body: dict) -> None:
            data = json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            if self.path == "/health":
                self.answer(200, service.health(checks))
            else:
                self.answer(404, {"error": "not found"})

        def do_POST(self) -> None:  # noqa: N802
            call = {"/chat": chat, "/search": search}.get(self.path)
            size = int(self.headers.get("Content-Length") or 0)
            if call is None or size > MOST_BODY:
                self.answer(404 if call is None else 413, {"error": "not found" if call is None else "too large"})
                return
            try:
                body = json.loads(self.rfile.read(size) or b"{}")
                if not isinstance(body, dict):
                    raise ValueError("the body must be an object")
                self.answer(200, call(body))
            except (ValueError, TypeError) as e:
                self.answer(422, {"error": str(e)})
            except Exception as e:  # noqa: BLE001  the service goes on
                self.answer(500, {"error": str(e)[:500]})

        def log_message(self, *args: object) -> None:
            pass

    return Handler


def served(agent: Agent, sessions: service.Sessions, checks: dict[str, Callable], port: int = DEFAULT_PORT, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is bound to its port; `serve_forever` runs it."""
    return ThreadingHTTPServer((host, port), handler(agent, sessions, checks))

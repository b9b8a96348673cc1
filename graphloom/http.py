"""A small HTTP front of the tools: health, ingest and its jobs, graphs for drawing, projects; with a bearer token if one is set."""

from __future__ import annotations

import hmac
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from .functions.scalar import MARK
from .tools import Memory

PAGE = "<!doctype html><meta charset=utf-8><title>graph</title><pre id=g></pre><script>fetch(location.pathname+'?format=json').then(r=>r.json()).then(d=>g.textContent=JSON.stringify(d,null,1))</script>"


def serve(memory: Memory, port: int = 0, token: str = "", host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is ready to run; port 0 takes a free one. The caller runs serve_forever."""

    class Handler(BaseHTTPRequestHandler):
        def reply(self, status: int, body: str, kind: str = "application/json") -> None:
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def handle_any(self, method: str) -> None:
            url = urlsplit(self.path)
            parts, query = [unquote(p) for p in url.path.strip("/").split("/")], {k: v[0] for k, v in parse_qs(url.query).items()}
            if parts == ["health"]:
                return self.reply(200, '{"status": "ok"}')
            if token and not hmac.compare_digest(self.headers.get("Authorization", "").encode(), f"Bearer {token}".encode()):
                return self.reply(401, '{"error": "unauthorized"}')
            try:
                if (method, parts) == ("POST", ["ingest"]):
                    args = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                    job = memory.ingest(args["root"], args["project_id"], args.get("stage") or "local", wait=False)
                    return self.reply(202, json.dumps({"job_id": job.id}))
                if method == "GET" and parts[:2] == ["ingest", "jobs"] and len(parts) == 3:
                    state = memory.job_status(parts[2])
                    return self.reply(404 if state.values["status"] == "unknown" else 200, state.json())
                if (method, parts) == ("GET", ["api", "projects"]):
                    return self.reply(200, memory.list_projects().json())
                if method == "GET" and parts[0] == "graph" and len(parts) in (2, 3):
                    if MARK in parts[1]:
                        return self.reply(400, '{"error": "the project must not contain a stage marker"}')
                    if len(parts) == 3 and parts[2] == "linked":
                        return self.reply(200, memory.linked_projects(parts[1], query.get("stage", "")).json())
                    if len(parts) == 2 and query.get("format") != "json" and "text/html" in self.headers.get("Accept", ""):
                        return self.reply(200, PAGE, "text/html")
                    if len(parts) == 2:
                        sidecars = [s for s in (x.strip() for x in query.get("sidecars", "").split(",")) if s and s != parts[1]]
                        edges = int(query["max_edges"]) if query.get("max_edges", "").isdigit() and int(query["max_edges"]) > 0 else 2000
                        return self.reply(200, memory.graph_data(parts[1], query.get("stage", ""), sidecars, edges).json())
            except (ValueError, KeyError, TypeError) as e:
                return self.reply(400, json.dumps({"error": str(e)}))
            self.reply(404, '{"error": "not found"}')

        def do_GET(self) -> None:
            self.handle_any("GET")

        def do_POST(self) -> None:
            self.handle_any("POST")

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)

"""A project's reports over HTTP, as JSON. The project is read once; impacts are worked out for each request."""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from lattica.plans import report
from lattica.plans.project import Project
from lattica.sources.project_files import ProjectError

PORT = 4787


def line_of(value: str | None) -> int:
    """The leading whole number of a text, 1 at least."""
    text = (value or "").strip()
    digits = ""
    for c in text.removeprefix("+"):
        if not c.isdecimal():
            break
        digits += c
    return max(1, int(digits or 1))


class Answers:
    """What each address answers: a status and what the body holds."""

    def __init__(self, project: Project, opener: Callable[[str, int], None] | None = None) -> None:
        self.project, self.opener = project, opener
        self.fixed = {"/api/explorer-data": project.explorer_data(), "/api/hotspots": project.hotspots(), "/api/code-graph": project.code_graph_data()}

    def __call__(self, method: str, address: str) -> tuple[int, object]:
        parts = urlsplit(address)
        asked = {k: v[0] for k, v in parse_qs(parts.query, errors="replace").items()}
        if method != "GET":
            return 404, "Not found"
        if address in self.fixed:
            return 200, self.fixed[address]
        if address == "/api/diff-impact":
            return 200, self.project.diff_impact()
        if parts.path not in ("/api/impact", "/api/open-source"):
            return 404, "Not found"
        if not asked.get("file"):
            return 400, {"error": "the query parameter 'file' is missing"}
        try:
            if parts.path == "/api/impact":
                return 200, self.project.impact(asked["file"])
            path = self.project.file(asked["file"])[1]
        except ProjectError as e:
            return 404, {"error": str(e)}
        line = line_of(asked.get("line"))
        if self.opener is not None:
            self.opener(path, line)
        return 200, {"opened": self.opener is not None, "file": posixpath.normpath(path), "line": line}


def server(project: Project, port: int = PORT, opener: Callable[[str, int], None] | None = None) -> ThreadingHTTPServer:
    """A server on this machine's own address, not yet started; `opener` gets the file and line of /api/open-source."""
    answers = Answers(project, opener)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            status, data = answers(self.command, self.path)
            body = (data if isinstance(data, str) else report.as_json(data)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain" if isinstance(data, str) else "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        do_GET = do_POST = do_PUT = do_DELETE = _answer

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)

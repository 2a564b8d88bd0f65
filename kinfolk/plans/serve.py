"""A small server for a saved run (WEB1-WEB4): the page, the report and the output files."""

from __future__ import annotations

import os
import signal
import threading
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote, urlsplit

from kinfolk.sinks import REPORT_FILE

PAGE = """<!doctype html><meta charset="utf-8"><title>kinfolk</title>
<style>body{font:16px sans-serif;margin:2em}li{margin:.4em 0}img{max-height:8em;margin:.2em}#error{color:#a00}</style>
<h1>Persons</h1><p id="stats"></p><p id="error"></p><ol id="persons"></ol><h2>Errors</h2><ol id="errors"></ol>
<script>
const text = (parent, tag, value) => { const e = document.createElement(tag); e.textContent = value; parent.append(e); return e; };
const file = path => "/output/" + path.split("/").map(encodeURIComponent).join("/");
fetch("/api/report").then(r => { if (!r.ok) throw new Error("no report"); return r.json(); }).then(r => {
  document.getElementById("stats").textContent = `${r.total_images} images, ${r.total_faces} faces, ${r.total_persons} persons, ${r.errors} errors, ${r.duration}, ${r.gpu ? "GPU" : "CPU"}`;
  for (const p of r.persons || []) {
    const li = text(document.getElementById("persons"), "li", `Person ${p.id}: ${p.photo_count} photos, ${p.face_count} faces. ${p.description || ""}`);
    li.onclick = () => { li.onclick = null; for (const x of p.photos) { const i = document.createElement("img"); i.src = file(x); i.alt = x; li.append(i); } };
  }
  for (const [path, error] of Object.entries(r.file_errors || {})) text(document.getElementById("errors"), "li", `${path}: ${error}`);
}).catch(e => { document.getElementById("error").textContent = String(e); });
</script>"""


def handler(folder: str) -> type[SimpleHTTPRequestHandler]:
    class Handler(SimpleHTTPRequestHandler):
        def __init__(self, *args):
            super().__init__(*args, directory=folder)

        def _send(self, body: bytes, kind: str) -> None:
            self.send_response(200)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            path = unquote(urlsplit(self.path).path)
            if path == "/":
                self._send(PAGE.encode(), "text/html; charset=utf-8")
            elif path == "/api/report":
                try:
                    with open(os.path.join(folder, REPORT_FILE), "rb") as f:
                        self._send(f.read(), "application/json")
                except OSError:
                    self.send_error(404, "no report")
            elif path.startswith("/output/") and ".." not in path.split("/"):
                self.path = self.path[len("/output") :]
                super().do_GET()
            else:
                self.send_error(404)

        def log_message(self, *args) -> None:
            pass

    return Handler


def start(folder: str, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """Serve in the background; ``shutdown()`` ends it. Without authentication: bound to this machine unless told otherwise."""
    server = ThreadingHTTPServer((host, port), handler(os.path.abspath(folder)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def serve(folder: str, port: int = 8080, host: str = "127.0.0.1") -> None:
    """Serve until interrupted or told to end (SIGINT, SIGTERM)."""
    server, ended = start(folder, port, host), threading.Event()
    before = signal.signal(signal.SIGTERM, lambda *_: ended.set())
    try:
        ended.wait()
    except KeyboardInterrupt:
        pass
    finally:
        signal.signal(signal.SIGTERM, before)
        server.shutdown()
        server.server_close()

import contextlib
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from veilspan.operators.model_detector import DetectionFailed, Model, TooLong, ask
from veilspan.sources.http_model import Http


class Handler(BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):
        got = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.seen.append((self.path, self.headers.get("X-Key"), got))
        content = json.dumps({"entities": [{"type": "KISI", "text": "Ali Kaya", "occurrence": 1}]} if "Ali Kaya" in got["messages"][1]["content"] else {"entities": []})
        body = json.dumps({"done": True, "done_reason": "stop", "message": {"content": content, "thinking": "x"}})
        kind = self.path.split("?")[0]
        if kind == "/redirect":
            self.send_response(302)
            self.send_header("Location", "/chat")
            self.end_headers()
            return
        status = {"/500": 500, "/context": 400}.get(kind, 200)
        body = {"/500": "{}", "/context": '{"error": "context length exceeded"}', "/text": "no json", "/list": "[]", "/large": json.dumps({"x": "y" * 5000}), "/cut": '{"done": true, "done_reason": "length"}', "/open": '{"done": false}'}.get(kind, body)
        self.send_response(status)
        self.end_headers()
        with contextlib.suppress(OSError):  # the client may hang up
            for ch in body if kind == "/slow" else [body]:
                self.wfile.write(ch.encode())
                self.wfile.flush()
                time.sleep(0.05 if kind == "/slow" else 0)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def base():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_chat(base):
    model = Model(Http(f"{base}/chat?a=1", "m", (("X-Key", "k"),), think=False), ("KISI",))
    assert ask("Sayın Ali\nKaya ve Ali Kaya", model) == [("KISI", 6, 14), ("KISI", 18, 26)]
    path, key, sent = Handler.seen[-1]
    assert (path, key, sent["think"], sent["stream"]) == ("/chat?a=1", "k", False, False)
    assert sent["format"]["properties"]["entities"]["items"]["properties"]["type"]["enum"] == ["KISI"]


@pytest.mark.parametrize(("path", "error"), [("redirect", DetectionFailed), ("500", DetectionFailed), ("text", DetectionFailed), ("list", DetectionFailed), ("large", DetectionFailed), ("open", DetectionFailed), ("slow", DetectionFailed), ("context", TooLong), ("cut", TooLong)])
def test_failures(base, path, error):
    with pytest.raises(error) as e:
        Http(f"{base}/{path}", "m", seconds=1.0, max_bytes=2000)({"text": "Ali Kaya", "types": ["KISI"], "repair": False})
    assert type(e.value) is error and "Ali" not in str(e.value)


def test_nobody_answers():
    with pytest.raises(DetectionFailed):
        Http("http://127.0.0.1:9/chat", "m", seconds=2.0)({"text": "x", "types": ["KISI"], "repair": False})


@pytest.mark.parametrize("args", [("ftp://x/y", "m"), ("http://u:p@x/y", "m"), ("http://x/y", ""), ("http://x/y", "m", (("a b", "c"),)), ("http://x/y", "m", (("a", "c\r\nd"),))])
def test_configuration(args):
    with pytest.raises(ValueError):
        Http(*args)

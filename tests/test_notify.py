import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

from loreloom.streaming import notify


def test_one_post_and_quiet_failure(spark):
    got = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            got.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(204)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/hook"
    assert notify.send(url, "hello")
    applied = []
    run = notify.after_batch(url, lambda df, epoch: applied.append(epoch))
    run(spark.createDataFrame([("a", "write"), ("b", "write"), ("c", "delete")], "path string, kind string"), 7)
    server.shutdown()
    assert applied == [7] and got == [{"text": "hello"}, {"text": "1 delete, 2 write"}]
    server.server_close()
    assert not notify.send(url, "gone", 1.0)

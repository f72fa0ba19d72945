"""The load sink against a service that fails, refuses and lets go."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from mnemospark.sources import load

SCHEMA = "content string, category string, project string, subject string"


class Service(ThreadingHTTPServer):
    def __init__(self):
        super().__init__(("127.0.0.1", 0), Handler)
        self.got, self.tries, self.now, self.most, self.lock = [], {}, 0, 0, threading.Lock()


class Handler(BaseHTTPRequestHandler):
    def do_POST(self):
        s = self.server
        call = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["params"]["arguments"]
        with s.lock:
            s.now += 1
            s.most = max(s.most, s.now)
            s.tries[call["content"]] = s.tries.get(call["content"], 0) + 1
            turn = s.tries[call["content"]]
        kind = call["content"].split()[0]
        code = 503 if kind == "down" or (kind == "shaky" and turn < 3) else 200
        answer = {"isError": {"result": {"isError": True, "content": [{"text": "no"}]}}, "vague": {"result": {"content": [{"text": json.dumps({"stored": False})}]}}}.get(kind, {"result": {"content": [{"text": "stored"}]}})
        if code == 200 and kind in ("good", "shaky"):
            s.got.append(call)
        body = json.dumps(answer).encode()
        with s.lock:
            s.now -= 1
        self.send_response(code)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def service():
    s = Service()
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def test_tries_refusals_and_counts(spark, service, tmp_path):
    kinds = ["good"] * 30 + ["shaky"] * 4 + ["down"] * 3 + ["vague"] * 5 + ["isError"] * 2
    rows = [(f"{k} {i}", "lesson", "p" if i % 2 else None, None) for i, k in enumerate(kinds)]
    got = load.load(spark.createDataFrame(rows, SCHEMA), f"http://127.0.0.1:{service.server_port}", f"file://{tmp_path}/report.json", wait="0").first()
    assert tuple(got)[:3] == (34, 7, 3)
    assert len(service.got) == 34 and service.most <= load.AT_ONCE
    assert all(service.tries[f"down {i}"] == load.TRIES for i in range(34, 37))
    assert {"content": "good 1", "agent": load.AGENT, "metadata": {"category": "lesson"}, "project": "p"} in service.got
    assert {"content": "good 0", "agent": load.AGENT, "metadata": {"category": "lesson"}} in service.got


def test_a_folder_for_work_without_a_network(spark, tmp_path):
    rows = [("a long enough fact", "c", None, "s"), ("short", "c", None, None), (None, "c", None, None)]
    for _ in range(2):  # a run that is repeated leaves the same files
        got = load.load(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/facts", f"file://{tmp_path}/report.json", at_once=1, wait="0", least="10").first()
    assert tuple(got)[:3] == (1, 1, 1)
    assert [json.loads(x.value)["content"] for x in spark.read.text(f"{tmp_path}/facts").collect()] == ["a long enough fact"]
    assert load.load(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/none", f"file://{tmp_path}/none.json").first()[:3] == (0, 0, 0)


def test_a_job_that_fails_leaves_no_report(spark, tmp_path):
    bad = spark.createDataFrame([("x" * 20, "c", None, None)], SCHEMA).selectExpr("assert_true(false, 'broken') || content as content", "category", "project", "subject")
    with pytest.raises(Exception, match="broken"):
        load.load(bad, f"file://{tmp_path}/facts", f"file://{tmp_path}/report.json")
    assert not (tmp_path / "report.json").exists()

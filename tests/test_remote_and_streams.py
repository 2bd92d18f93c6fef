import http.server
import json
import threading
import time

import pytest

from strokeforge.operators import service
from strokeforge.sources import remote
from strokeforge.streaming import ndjson

SVG = '<svg><path d="M{} 1L5 5"/></svg>'


@pytest.fixture
def server():
    asked, open_now, most = [], [0], [0]
    lock = threading.Lock()

    class Answers(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            given = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            with lock:
                open_now[0] += 1
                most[0] = max(most[0], open_now[0])
                asked.append(given)
            time.sleep(0.02)
            status, body = 200, b"{}"
            if "token_ids" in given:
                body = json.dumps({"svg": str(given["token_ids"])}).encode()
            elif given["svg"] == "busy":
                status = 503
            elif given["svg"] == "refused":
                status = 400
            elif given["svg"] == "slow":
                time.sleep(1.5)
            elif given["svg"] != "odd":
                body = json.dumps({"token_ids": [len(given["svg"])]}).encode()
            with lock:
                open_now[0] -= 1
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{s.server_port}"
    yield at, asked, most
    s.shutdown()
    s.server_close()


def test_what_fails_is_its_rows_error(spark, server):
    at, asked, _ = server
    r = remote.Remote(at, at, timeout=0.5, attempts=3, pause=0.01)
    texts = ["abc", None, "busy", "refused", "odd", "slow", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, svg string").coalesce(1)
    got = {row.id: (row.token_ids, row.decoded, row.error) for row in remote.round_trip(df, r).collect()}
    assert got[0] == ([3], "[3]", None) and got[1] == (None, None, None) and got[6] == ([0], "[0]", None)
    assert got[2] == (None, None, "HTTP 503") and got[3] == (None, None, "HTTP 400")
    assert got[4] == (None, None, "unlike an answer: KeyError") and got[5][2].startswith("no answer")
    count = lambda text: sum(a.get("svg") == text for a in asked)
    assert (count("busy"), count("refused"), count("slow")) == (3, 1, 3)


def test_a_task_has_so_many_requests_open_at_most(spark, server):
    at, asked, most = server
    df = spark.range(40).selectExpr("id", "concat('d', id) AS svg").coalesce(1)
    rows = remote.round_trip(df, remote.Remote(at, at, in_flight=3)).collect()
    assert len(rows) == 40 and len(asked) == 80 and most[0] <= 3


def test_a_deadline_ends_retries(spark):
    r = remote.Remote("http://127.0.0.1:9", "http://127.0.0.1:9", attempts=50, pause=0.2, deadline=0.5)
    at = time.monotonic()
    assert r.both("x")[2].startswith("no answer") and time.monotonic() - at < 2


def test_counts_of_a_running_job(spark, tmp_path):
    class Store(service.MemoryStore):
        states = None

        def put(self, state):
            super().put(state)
            seen.append((state["status"], state["done"], state["n_ok"], state["n_failed"]))

    def slow(batches):
        for b in batches:
            time.sleep(0.3)
            yield b

    seen = []
    rows = spark.range(24).selectExpr("cast(id AS string) AS id", f"IF(id % 4 = 0, '<svg', '{SVG.format(1)}') AS svg", "cast(NULL AS array<int>) AS token_ids").repartition(12)
    store = Store()
    jobs = service.Jobs(spark, str(tmp_path), store=store, every=1)
    view = jobs.wait(jobs.submit(rows.mapInArrow(slow, rows.schema)))
    assert (view["status"], view["done"], view["n_ok"], view["n_failed"]) == ("partial", 24, 18, 6)
    running = [s for s in seen if s[0] == "running"]
    assert any(0 < s[1] < 24 for s in running) and all(s[1] == s[2] + s[3] for s in running)


def test_an_item_of_an_id_is_given_once(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    line = lambda i: json.dumps({"id": i, "op": "tokenize", "svg": SVG.format(2)})

    def run():
        ndjson.write_once(ndjson.read_numbered(spark, src), out, state).awaitTermination()
        return sorted((tuple(r) for r in spark.read.schema("id string, ok boolean, pos struct<line:int>").json(out).select("id", "ok", "pos.line").collect()), key=str)

    # Blank lines keep their numbers, the last line has no end, an id comes twice, broken lines and items without id stay.
    (tmp_path / "in" / "a.json").write_text(line("a") + "\n\n{bad\n" + line("b") + "\n" + line(None) + "\n" + line("a"))
    first = run()
    assert [r[0] for r in first if r[0]].count("a") == 1 and len(first) == 4
    assert {r[2] for r in first if not r[1]} == {2} and {r[2] for r in first if r[0] == "b"} == {3}
    (tmp_path / "in" / "b.json").write_text(line("b") + "\n" + line("c") + "\n{bad\n")
    again = run()
    assert sorted(r[0] for r in again if r[0]) == ["a", "b", "c"] and len(again) == 6


def test_documents_are_asked_for_many_at_once(spark):
    calls, asked = [], set()

    class Many(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            items = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["items"]
            calls.append(len(items))
            out = []
            for i in items:
                svg = i.get("svg")
                if svg is None:
                    out.append({"svg": f"d{i['token_ids'][0]}"} if i["token_ids"] != [4] else {"svg": 4})
                elif svg == "bad":
                    out.append({"status": 400})
                elif svg == "odd":
                    out.append({"token_ids": ["x"]})
                elif svg == "later" and "later" not in asked:
                    asked.add("later")
                    out.append({"status": 503})
                elif svg == "never":
                    out.append({"status": 503})
                else:
                    out.append({"token_ids": [len(svg)]})
            body = json.dumps({"items": out}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Many)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_port}"
        given = ["a", "bad", "odd", "later", "never", None, "four"] + ["x" * 7] * 93
        df = spark.createDataFrame(list(enumerate(given)), "id int, svg string").coalesce(1)
        got = {r.id: (r.token_ids, r.decoded, r.error) for r in remote.round_trip(df, remote.Remote(at, at, attempts=3, pause=0.01, batch=50)).collect()}
    finally:
        server.shutdown()
        server.server_close()
    assert [got[i] for i in range(7)] == [([1], "d1", None), (None, None, "HTTP 400"), (None, None, "unlike an answer: ValueError"), ([5], "d5", None), (None, None, "HTTP 503"), (None, None, None), ([4], None, "unlike an answer: TypeError")]
    assert all(got[i] == ([7], "d7", None) for i in range(7, 100))
    # Two requests for fifty, and two more of what was put off.
    assert len(calls) == 6 and max(calls) == 50

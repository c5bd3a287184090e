"""Paged and listened-to sources on local fixtures."""

import json
import socketserver
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from harborline.sources import feeds, live

RECORDS = [{"event_id_cnty": f"Y{i}", "event_date": f"2024-01-{i % 28 + 1:02d}", "event_type": "Battles", "actor1": "A", "country": "Yemen", "latitude": "1.5", "longitude": "2.5", "fatalities": i} for i in range(47)]


@pytest.fixture
def api():
    """Serves RECORDS in pages of 5 between two days; ``asked`` counts the requests by (start, end, page)."""
    asked = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            asked[q["start"], q["end"], int(q["page"])] += 1
            rows = [r for r in RECORDS if q["start"] <= r["event_date"] <= q["end"]]
            page = int(q["page"])
            body = json.dumps({"data": rows[5 * page - 5 : 5 * page]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/?page={{page}}&start={{start}}&end={{end}}", asked
    server.shutdown()


def test_all_pages_in_ranges(spark, api):
    url, asked = api
    df = live.register(spark).read.format("paged_records").options(url=url, page_size=5, pages_per_task=3).load()
    rows = df.collect()
    assert sorted(r.event_id_cnty for r in rows) == sorted(r["event_id_cnty"] for r in RECORDS)
    assert df.rdd.getNumPartitions() == 4 and max(p for _, _, p in asked) <= 16  # ten pages; doubling goes one step beyond
    assert feeds.conflict_events(df).count() == 47


def test_days_reach_the_api(spark, api):
    url, asked = api
    df = live.register(spark).read.format("paged_records").options(url=url, page_size=5).load()
    got = df.where("event_date >= '2024-01-05' and event_date < '2024-01-08' and country = 'Yemen'").collect()
    assert sorted(r.event_id_cnty for r in got) == sorted(r["event_id_cnty"] for r in RECORDS if "2024-01-05" <= r["event_date"] < "2024-01-08")
    assert {(s, e) for s, e, _ in asked} == {("2024-01-05", "2024-01-08")}
    assert df.where("event_date > '2024-02-01' and event_date < '2024-01-01'").count() == 0


def test_pages_in_files(spark, tmp_path):
    for n, rows in enumerate([RECORDS[:5], RECORDS[5:10], RECORDS[10:12]], 1):
        (tmp_path / f"{n}.json").write_text(json.dumps(rows))
    read = lambda folder: live.register(spark).read.format("paged_records").options(url=f"file://{folder}/{{page}}.json", page_size=5, pages_per_task=1).load().count()
    assert read(tmp_path) == 12
    (tmp_path / "none").mkdir()
    assert read(tmp_path / "none") == 0


class Receiver(socketserver.ThreadingTCPServer):
    """Sends whatever is put into ``out`` to whoever listens, each line once."""

    allow_reuse_address = daemon_threads = True

    def __init__(self):
        self.out, self.logins, self.sent = [], [], 0
        super().__init__(("127.0.0.1", 0), self.Handler)
        threading.Thread(target=self.serve_forever, daemon=True).start()

    class Handler(socketserver.StreamRequestHandler):
        def handle(self):
            self.server.logins.append(self.rfile.readline().decode().strip())
            mine = len(self.server.logins)
            try:
                while mine == len(self.server.logins):  # only the newest listener is told
                    while self.server.sent < len(self.server.out):
                        self.wfile.write(self.server.out[self.server.sent].encode() + b"\r\n")
                        self.server.sent += 1
                    time.sleep(0.05)
            except OSError:
                pass


def test_lines_survive_a_failed_batch_and_a_restart(spark, tmp_path):
    server, seen, state = Receiver(), [], {"fail": True}
    stream = lambda: live.register(spark).readStream.format("vessel_lines").options(host="127.0.0.1", port=server.server_address[1], login="me:secret", journal=str(tmp_path / "journal"), wait=0.5, lines_per_task=4).load()

    def take(batch, number):
        rows = [(r.line_no, r.value) for r in batch.collect()]
        if rows and state["fail"]:
            raise RuntimeError("lost before it was kept")
        seen.extend(rows)

    def run(enough, seconds=60):
        q = stream().writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
        until = time.time() + seconds
        while q.isActive and time.time() < until and not enough():
            time.sleep(0.1)
        if q.isActive:
            q.stop()
        return q

    server.out += [f"!AIVDM,1,1,,A,payload{i},0*1C" for i in range(10)]
    q = run(lambda: False)
    assert q.exception() is not None and not seen  # read, journalled, lost
    state["fail"] = False
    run(lambda: len(seen) >= 10)
    before = len(server.logins)

    def more_once_someone_listens():
        if len(server.logins) > before and len(server.out) == 10:
            server.out += [f"!AIVDM,1,1,,A,payload{i},0*1C" for i in range(10, 23)]
        return len(seen) >= 23

    run(more_once_someone_listens)
    assert sorted(seen) == [(i, f"!AIVDM,1,1,,A,payload{i},0*1C") for i in range(23)]
    assert set(server.logins) == {"me:secret"}
    lines = spark.createDataFrame([(v,) for _, v in seen], "value string")
    assert feeds.sentences(lines).count() == 23
    server.shutdown()

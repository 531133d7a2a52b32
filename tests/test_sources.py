"""Images, remote services behind stand-ins, the graph store, streams."""

import base64

import pytest
from pyspark.sql import functions as F

from loomgraph.flow import Flow
from loomgraph.plans.runtime import Engine
from loomgraph.sources import clients, images
from loomgraph.sources import tables
from loomgraph.sources.tables import Conflict, GraphStore
from loomgraph.streaming import frames

PIXEL = base64.b64encode(b"\x89PNG").decode()


@pytest.fixture
def services():
    # local classes travel to the workers by value
    class FakeService:
        def __init__(self, server, timeout):
            self.server = server

        def call(self, method, path, body=None):
            if "down" in self.server:
                raise OSError("refused")
            if path == "/api/connect":
                return {"session_id": f"s-{body['model_type']}"}
            session, what = path.split("/")[2:4]
            return {
                "is-alive": {"alive": True},
                "set-prompt": {"session_id": session},
                "add-image": {"session_id": session, "added": True, "frame_idx": len((body or {}).get("image", ""))},
                "get-output": {"masks": ["m"], "boxes": [[1, 2, 3, 4]], "scores": [0.5], "count": 1},
                "visualize": {"image": "data:image/png;base64,AA=="},
                "disconnect": {},
            }[what]

    class FakeCameras:
        def resolve(self, camera):
            return {"url": f"http://camera.example/{camera}.m3u8", "width": 100}

    before = dict(clients._factories)
    clients.use(rest=FakeService, cameras=FakeCameras)
    yield
    clients._factories.update(before)


def test_images_by_path_and_by_folder(spark, tmp_path):
    g = Flow()
    saved = g.node("core.image.save", image=f"data:image/png;base64,{PIXEL}", file_path=str(tmp_path / "in" / "a.png"))
    g.out(ok=saved.saved, path=saved.file_path)
    assert tuple(Engine(spark).table(g.payload()).first()) == (True, str(tmp_path / "in" / "a.png"))
    g = Flow()
    g.out(image=g.node("core.image.load", file_path=str(tmp_path / "in" / "a.png")).image)
    assert Engine(spark).table(g.payload()).first()[0] == f"data:image/png;base64,{PIXEL}"
    row = images.load_images(spark, str(tmp_path / "in")).first()
    assert row["image"] == f"data:image/png;base64,{PIXEL}" and row["n_bytes"] == 4
    back = spark.createDataFrame([(row["image"],), (PIXEL,), (None,)], "i string").select(images.image_bytes(F.col("i"))).collect()
    assert [None if r[0] is None else bytes(r[0]) for r in back] == [b"\x89PNG", b"\x89PNG", None]


def test_segmentation_session(spark, services):
    g = Flow()
    session = g.node("segment.connect", model_type="image")
    prompt = g.node("segment.set_prompt", session_id=session.session_id, prompt="car")
    added = g.node("segment.add_image", session_id=prompt.session_id, image="abc", batch=2)
    found = g.node("segment.get_output", session_id=added.session_id, frame_idx=added.frame_idx)
    shown = g.node("segment.visualize", session_id=found.session_id)
    alive = g.node("segment.is_alive", session_id=session.session_id)
    down = g.node("segment.is_alive", session_id="x", server_url="http://down")
    none = g.node("segment.connect", server_url="http://down")
    end = g.node("segment.disconnect", session_id=shown.session_id)
    g.out(s=session.session_id, frame=added.frame_idx, boxes=found.boxes, scores=found.scores, n=found["count"], image=shown.image, alive=alive.alive, down=down.alive, none=none.session_id, end=end.disconnected)
    row = Engine(spark).table(g.payload()).first()
    assert tuple(row) == ("s-image", 3, [[1.0, 2.0, 3.0, 4.0]], [0.5], 1, "data:image/png;base64,AA==", True, False, "", True)


def test_skipped_calls_are_not_made(spark, services):
    g = Flow()
    branch = g.node("core.control.ifelse", condition=g.node("core.logic.compare", a=g.col("id"), b=1, op=">").result)
    call = g.node("segment.set_prompt", session_id="s", prompt=g.node("core.string.substring", text="xyz").result)
    branch.then(call, port="true")
    g.out(id=g.col("id"), s=call.session_id)
    assert [tuple(r) for r in Engine(spark).table(g.payload(), spark.range(3)).collect()] == [(0, None), (1, None), (2, "s")]


def test_cameras(spark, services, tmp_path):
    g = Flow()
    url, stream = g.node("camera.get_stream_url", camera=7), g.node("camera.connect", camera=7, fps=2)
    g.out(url=url.url, w=url.width, h=url.height, id=stream.stream_id, stream=stream.stream, end=g.node("camera.disconnect", stream=stream.stream).stopped)
    assert tuple(Engine(spark).table(g.payload()).first()) == ("http://camera.example/7.m3u8", 100, 480, "camera-7", "camera-7|http://camera.example/7.m3u8|2|10", True)


def test_frames_through_a_graph_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(5):
        (tmp_path / "in" / f"{k}.jpg").write_bytes(bytes([k]))
    stream = frames.read_frames(spark, str(tmp_path / "in"), "cam", fps=2)
    assert stream.isStreaming
    g = Flow()
    frame = g.node("camera.get_frame", stream=g.col("frame"))
    g.out(image=frame.image, has=frame.has_frame, n=g.node("core.container.length", value=frame.image).length)
    out = frames.run_graph(stream.select(F.struct("stream_id", "timestamp", "width", "height", "image").alias("frame")), g.payload())
    frames.show(out, "shown", str(tmp_path / "ck"), available_now=True).awaitTermination(120)
    rows = spark.table("shown").collect()
    assert len(rows) == 5 and all(r["has"] and r["image"].startswith("data:image/jpeg;base64,") and r["n"] == len(r["image"]) for r in rows)


def test_windows_and_sliding_buffers_of_streams(spark, tmp_path):
    spark.sql("SELECT 's' AS stream_id, CAST(id AS double) AS timestamp, timestamp_seconds(id * 40) AS ts, 'click' AS event_type, 1.5D AS value FROM range(6)").write.parquet(str(tmp_path / "in"))
    read = lambda: frames.read_folder(spark, str(tmp_path / "in"), "stream_id string, timestamp double, ts timestamp, event_type string, value double", files_per_batch=100)
    frames.show(frames.windowed(read(), "2 minutes"), "windows", str(tmp_path / "a"), mode="complete", available_now=True).awaitTermination(120)
    assert sorted((r["n"], r["total"]) for r in spark.table("windows").collect()) == [(3, 4.5), (3, 4.5)]
    frames.show(frames.last_frames(read(), 3), "buffers", str(tmp_path / "b"), available_now=True).awaitTermination(120)
    rows = sorted(tuple(r) for r in spark.table("buffers").collect())
    assert rows == [("s", k, float(k), [float(x) for x in range(max(0, k - 2), k + 1)]) for k in range(6)]


def test_graph_store(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "graphs"))
    assert store.graphs().count() == 0
    a, b = store.create("ann", "First", {"nodes": [1]}), store.create("bob", "Second", {})
    assert store.get(a, "ann")["data"] == {"nodes": [1]} and store.get(a, "bob") is None
    assert store.update(a, "ann", name="Renamed", data={"nodes": []}) and not store.update(b, "ann", name="x")
    assert store.get(a, "ann")["name"] == "Renamed" and [r["id"] for r in store.graphs().collect()] == [a, b]
    assert store.search("ann", "RENAM").count() == 1 and store.search("ann", "zzz").count() == 0
    assert store.delete(a, "ann") and not store.delete(a, "ann") and store.graphs("ann").count() == 0


def test_of_two_racing_updates_one_is_refused(spark, tmp_path, monkeypatch):
    store, other = (GraphStore(spark, str(tmp_path / "graphs")) for _ in range(2))
    a = store.create("ann", "First", {"nodes": []})
    assert store.update(a, "ann", version=1, name="Second") and store.get(a, "ann")["version"] == 2
    with pytest.raises(Conflict):
        other.update(a, "ann", version=1, name="From an old one")
    # both read version 2 before either writes
    seen = other.get(a, "ann")
    monkeypatch.setattr(other, "get", lambda *_: dict(seen))
    assert store.update(a, "ann", name="Mine")
    with pytest.raises(Conflict):
        other.update(a, "ann", name="Yours")
    assert store.get(a, "ann")["name"] == "Mine" and store.get(a, "ann")["version"] == 3
    # a claim that its writer never made good is free after a while
    assert store.claims.take(f"{a}.4.0")
    with pytest.raises(Conflict):
        store.delete(a, "ann")
    monkeypatch.setattr(tables, "GRACE", 0.0)
    assert store.delete(a, "ann") and store.graphs().count() == 0


def test_compaction_loses_no_change(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "graphs"))
    a, b = store.create("ann", "A", {"k": 1}), store.create("ann", "B", {})
    for k in range(3):
        store.update(a, "ann", name=f"A{k}")
    store.delete(b, "ann")
    assert store.compact() == 1 and [r["name"] for r in store.graphs().collect()] == ["A2"]
    assert store._rows().count() == 2  # the last rows alone, one of them of what is gone
    # a writer that began in the old generation finds the new one and writes there, too
    late = GraphStore(spark, str(tmp_path / "graphs"))
    numbers, calls = late._numbers, []
    late._numbers = lambda prefix: 0 if prefix == "begun-" and not calls and not calls.append(1) else numbers(prefix)
    late._append((a, "ann", "late", "", "{}", None, None, 6, 0))
    assert store.get(a, "ann")["name"] == "late" and store.update(a, "ann", name="A3") and store.compact() == 2
    assert store.get(a, "ann")["name"] == "A3" and not store.update(b, "ann", name="x")
    store.claims.take("begun-3")
    with pytest.raises(Conflict):
        store.compact()


def test_sides_of_a_branch_go_to_sinks_of_their_own(spark, tmp_path):
    df = spark.range(40).selectExpr("id", "if(id % 5 = 0, null, id % 2 = 0) AS yes", "id * 2 AS twice", "id + 1 AS more")
    tables.write_sides(df, F.col("yes"), str(tmp_path / "out"), ("id", "twice"), ("id", "more"))
    true, false = tables.side(spark, str(tmp_path / "out"), True, ("id", "twice")), tables.side(spark, str(tmp_path / "out"), False, ("id", "more"))
    want = {k for k in range(40) if k % 5 and k % 2 == 0}
    assert {tuple(r) for r in true.collect()} == {(k, 2 * k) for k in want}
    assert {tuple(r) for r in false.collect()} == {(k, k + 1) for k in set(range(40)) - want}
    assert tables.side(spark, str(tmp_path / "out"), True).where("more is not null").count() == 0


def test_sides_of_a_stream(spark, tmp_path):
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).selectExpr("id", "id * 2 AS twice").write.mode("append").parquet(str(tmp_path / "in"))
        stream = frames.read_folder(spark, str(tmp_path / "in"), "id long, twice long", files_per_batch=2)
        tables.stream_sides(stream, F.col("id") % 3 == 0, str(tmp_path / "out"), str(tmp_path / "ck"), ("id", "twice"), ("id",), available_now=True).awaitTermination(120)
    true, false = tables.side(spark, str(tmp_path / "out"), True, ("id", "twice")), tables.side(spark, str(tmp_path / "out"), False, ("id",))
    assert sorted(map(tuple, true.collect())) == [(k, 2 * k) for k in range(0, 30, 3)]
    assert sorted(r[0] for r in false.collect()) == [k for k in range(30) if k % 3]


KILLED = """
import os, sys
from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F
from loomgraph.sources import tables
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", sys.argv[1] + "/w").getOrCreate()

def rows(parts):
    for part in parts:
        yield part
    if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() == 1:
        os._exit(1)  # the worker dies after its rows have gone out

df = spark.range(0, 20000, 1, 4).mapInPandas(rows, "id long")
tables.write_sides(df, F.col("id") % 3 == 0, sys.argv[1] + "/out")
for taken in (True, False):
    x = tables.side(spark, sys.argv[1] + "/out", taken)
    print("SIDE", taken, x.count(), x.distinct().count(), x.where((F.col("id") % 3 == 0) != taken).count())
"""


def test_both_sides_are_whole_after_a_killed_task(tmp_path):
    import subprocess
    import sys

    (tmp_path / "job.py").write_text(KILLED)
    got = subprocess.run([sys.executable, str(tmp_path / "job.py"), str(tmp_path)], capture_output=True, text=True, timeout=300)
    assert [x for x in got.stdout.splitlines() if x.startswith("SIDE")] == ["SIDE True 6667 6667 0", "SIDE False 13333 13333 0"], got.stderr[-2000:]


def jpeg(k):
    return b"\xff\xd8" + f"frame {k}".encode() + bytes([k % 200] * (1 + 37 * k % 50)) + b"\xff\xd9"


def ran(stream, out, checkpoint):
    q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(processingTime="100 milliseconds").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_a_recording_gives_each_frame_once_over_restarts(spark, tmp_path):
    from loomgraph.streaming.recording import read_recording

    path = tmp_path / "cam.mjpeg"
    stream = lambda: read_recording(spark, str(path), stream_id="cam", fps=5, buffer_seconds=3, width=64, height=48, began=100)
    path.write_bytes(b"".join(map(jpeg, range(40))) + jpeg(40)[:9])  # the last one is still being written
    ran(stream(), tmp_path / "out", tmp_path / "ck")
    seen = lambda: sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = lambda n: [("cam", k, 100 + k / 5, 64, 48, "data:image/jpeg;base64," + base64.b64encode(jpeg(k)).decode()) for k in range(n)]
    assert seen() == want(40)
    with path.open("ab") as f:
        f.write(jpeg(40)[9:] + b"".join(map(jpeg, range(41, 60))))
    ran(stream(), tmp_path / "out", tmp_path / "ck")
    assert seen() == want(60)
    ran(stream(), tmp_path / "out", tmp_path / "ck")
    assert seen() == want(60)


def test_a_full_buffer_drops_what_arrives(spark, tmp_path):
    from loomgraph.streaming.recording import RecordingReader, read_recording

    path = tmp_path / "cam.mjpeg"
    path.write_bytes(b"".join(map(jpeg, range(40))))
    options = dict(stream_id="cam", fps=5, buffer_seconds=1, drop=True)  # a buffer of 10
    ran(read_recording(spark, str(path), **options), tmp_path / "out", tmp_path / "ck")
    frames_of = lambda: sorted(r["frame"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert frames_of() == list(range(10))
    with path.open("ab") as f:
        f.write(b"".join(map(jpeg, range(40, 45))))
    ran(read_recording(spark, str(path), **options), tmp_path / "out", tmp_path / "ck")
    assert frames_of() == [*range(10), *range(40, 45)]
    reader = RecordingReader({"path": str(path), "fps": "5", "buffer_seconds": "8"})
    end = reader.latestOffset()
    assert end == {"byte": sum(len(jpeg(k)) for k in range(40)), "frame": 40} and [p.count for p in reader.partitions(reader.initialOffset(), end)] == [16, 16, 8]
    assert RecordingReader({"path": str(tmp_path / "none")}).latestOffset() == {"byte": 0, "frame": 0}


def test_counts_of_nodes_while_a_stream_runs(spark, tmp_path):
    import time

    from loomgraph.streaming.metrics import watch_stream

    (tmp_path / "in").mkdir()
    write = lambda k, rows: spark.createDataFrame(rows, "x int, t string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    g = Flow()
    branch = g.node("core.control.ifelse", id="if", condition=g.node("core.logic.compare", id="test", a=g.col("x"), b=1, op=">").result)
    yes = g.node("core.math.multiply", id="yes", a=g.col("x"), b=2)
    branch.then(yes, port="true")
    bad = g.node("core.math.min", id="bad", a=g.node("core.util.passthrough", value=g.col("t")).value, b=5)
    g.out(yes=yes.product, bad=bad.result)
    write(0, [(1, "1"), (2, "x"), (3, None)])
    stream = frames.read_folder(spark, str(tmp_path / "in"), "x int, t string")
    out, listener = watch_stream(Engine(spark), g.payload(), stream, "counted", {"on_error": "collect"})
    spark.streams.addListener(listener)
    q = out.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="200 milliseconds").start()
    try:
        q.processAllAvailable()
        write(1, [(0, "y"), (5, "7")])
        q.processAllAvailable()
        until = time.time() + 60
        while time.time() < until and len({r[0] for r in listener.rows() if r[3]}) < 2:
            time.sleep(0.2)
        assert q.isActive
    finally:
        q.stop()
        spark.streams.removeListener(listener)
    got = {(r["batch"], r["node_id"]): (r["rows"], r["skipped"], r["nulls"], r["errors"]) for r in listener.table(spark).collect()}
    assert got[0, "yes"] == (2, 1, 0, 0) and got[0, "bad"] == (3, 0, 1, 1) and got[1, "yes"] == (1, 1, 0, 0) and got[1, "bad"] == (2, 0, 1, 1)


@pytest.fixture
def server():
    """A segmentation service and an image host, over HTTP."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    sessions, asked, lock = {}, [], threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def answer(self, status, body, kind="application/json"):
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def handle_one(self, method):
            size = int(self.headers.get("Content-Length") or 0)
            body = json.loads(self.rfile.read(size)) if size else None
            with lock:
                asked.append((method, self.path))
                if self.path.startswith("/images/"):
                    return self.answer(200, b"\x89PNG" + self.path.encode(), "image/png")
                if self.path == "/api/connect":
                    sessions.setdefault(body["model_type"], {"prompt": None, "images": []})
                    return self.answer(200, json.dumps({"session_id": body["model_type"]}).encode())
                _, _, session, what, *rest = self.path.split("/")
                held = sessions.get(session)
                if held is None:
                    return self.answer(404, b"{}")
                out = {"session_id": session}
                if what == "set-prompt":
                    held["prompt"] = body["prompt"]
                elif what == "add-image":
                    held["images"] = [*held["images"], body["image"]][-body["batch"] :]
                    out |= {"added": True, "frame_idx": len(held["images"]) - 1}
                elif what == "get-output":
                    image = held["images"][int(rest[0])]
                    out |= {"masks": [held["prompt"] + ":" + image], "boxes": [[0, 0, len(image), 1]], "scores": [0.5], "count": 1}
                elif what == "visualize":
                    out |= {"image": "data:image/png;base64," + base64.b64encode(held["images"][body["frame_idx"]].encode()).decode()}
                elif what == "is-alive":
                    out |= {"alive": True}
                elif what == "disconnect":
                    del sessions[session]
                self.answer(200, json.dumps(out).encode())

        do_GET = lambda self: self.handle_one("GET")
        do_POST = lambda self: self.handle_one("POST")
        do_DELETE = lambda self: self.handle_one("DELETE")

    host = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=host.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{host.server_address[1]}", sessions, asked
    host.shutdown()


def test_a_service_over_http(spark, server):
    url, sessions, asked = server
    g = Flow()
    n = lambda kind, **ports: g.node(f"segment.{kind}", server_url=url, **ports)
    session = n("connect", model_type=g.col("m"))
    prompted = n("set_prompt", session_id=session.session_id, prompt=g.col("p"))
    first = n("add_image", session_id=prompted.session_id, image="old", batch=2)
    second = n("add_image", session_id=first.session_id, image=g.col("i"), batch=2)
    found = n("get_output", session_id=second.session_id, frame_idx=second.frame_idx)
    shown = n("visualize", session_id=found.session_id, frame_idx=second.frame_idx)
    alive = n("is_alive", session_id=shown.session_id)
    ended = n("disconnect", session_id=alive.session_id)
    gone = n("is_alive", session_id=g.node("core.string.concat", a=g.node("core.string.substring", text=g.node("core.cast.to_string", value=ended.disconnected).value, start=4).result, b="nobody").result)
    g.out(m=g.col("m"), at=second.frame_idx, masks=found.masks, boxes=found.boxes, image=shown.image, alive=alive.alive, ended=ended.disconnected, gone=gone.alive)
    df = spark.createDataFrame([("a", "car", "new"), ("b", "tree", "newer")], "m string, p string, i string")
    rows = {r["m"]: tuple(r)[1:] for r in Engine(spark).table(g.payload(), df).collect()}
    shown_of = lambda x: "data:image/png;base64," + base64.b64encode(x.encode()).decode()
    assert rows == {"a": (1, ["car:new"], [[0.0, 0.0, 3.0, 1.0]], shown_of("new"), True, True, False), "b": (1, ["tree:newer"], [[0.0, 0.0, 5.0, 1.0]], shown_of("newer"), True, True, False)}
    assert not sessions and len(asked) == 2 * 9  # one request a node and row
    g = Flow()
    g.keep("k").out(image=g.node("core.image.load", file_path=g.node("core.string.format", template=url + "/images/{}.png", arg1=g.col("k")).result).image)
    got = {r["k"]: r["image"] for r in Engine(spark).table(g.payload(), spark.range(20).selectExpr("id AS k").repartition(2)).collect()}
    assert got == {k: "data:image/png;base64," + base64.b64encode(f"\x89PNG/images/{k}.png".encode("latin-1")).decode() for k in range(20)}

"""Images, cameras and a segmentation service: nodes whose work is outside of Spark.

Each is one Arrow-batched call; a row whose guard is false is not called. In a loop they are called once a round.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.exprs import Value, failing, is_collecting, is_text, number, pystr, truthy, whole
from ..registry import node, port
from ..sources.clients import factory
from .inputs import Inputs

SERVER = "http://localhost:8765"


#: Calls of a batch that are under way at once, where rows have nothing to do with each other.
AT_ONCE = 8


def calling(f: Callable[..., dict[str, Any]], schema: str, *args: Column, at_once: int = 1) -> Callable[[Column], Column]:
    """For a guard, the Column of structs that f gives for each row's arguments; null where the guard is false.

    at_once: so many calls wait for their answers side by side; with 1 they are made in the rows' order. Where errors are collected the struct has one field more, error: what f raised for the row.
    """
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]
    collects = is_collecting()
    none = dict.fromkeys(names)

    def one(*row: Any) -> dict[str, Any]:
        if not collects:
            return f(*row)
        try:
            return f(*row)
        except Exception as e:
            return none | {"error": str(e) or type(e).__name__}

    def batch(run: pd.Series, *columns: pd.Series) -> pd.DataFrame:
        asked = [tuple(None if x is pd.NA else x for x in row) if go else None for go, *row in zip(run, *columns)]
        answer = lambda row: none if row is None else one(*row)
        if at_once > 1 and sum(x is not None for x in asked) > 1:
            with ThreadPoolExecutor(at_once) as pool:
                rows = list(pool.map(answer, asked))
        else:
            rows = [answer(x) for x in asked]
        return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in (*names, *["error"] * collects)})

    call = F.pandas_udf(batch, schema + ", error string" * collects).asNondeterministic()  # type: ignore[call-overload]
    return lambda guard: call(guard, *args)


def _text(v: Value) -> Column:
    return F.lit("") if v.is_null else F.coalesce(v.col if is_text(v.type) else pystr(v), F.lit(""))


@node("core.image.load", [port("file_path: string", "", True)], ["image: string"], style="call", category="Image", cache_policy="disabled")
def load(v: Inputs):
    """A data URL of the file or http(s) address; an empty path is an error."""
    make = factory("files")
    return calling(lambda path: {"image": make().load(path)}, "image string", _text(v["file_path"]), at_once=AT_ONCE)


@node("core.image.save", [port("image: string?", None, True), port("file_path: string", "", True)], ["saved: boolean", "file_path: string"], style="call", category="Image", cache_policy="disabled")
def save(v: Inputs):
    """Writes a data URL's bytes; saved is false where that fails."""
    make = factory("files")
    return calling(lambda image, path: {"saved": make().save(image, path), "file_path": path}, "saved boolean, file_path string", _text(v["image"]), _text(v["file_path"]))


# --- cameras


@node("camera.get_stream_url", [port("camera: int", 2130)], ["camera: int", "url: string", "width: int", "height: int"], style="call", category="Camera", cache_policy="disabled")
def stream_url(v: Inputs):
    """Address and resolution of a camera's stream (704 x 480 where the resolver does not say)."""
    make = factory("cameras")

    def find(camera: int) -> dict[str, Any]:
        got = make().resolve(int(camera))
        return {"camera": int(camera), "url": got["url"], "width": got.get("width") or 704, "height": got.get("height") or 480}

    return calling(find, "camera long, url string, width long, height long", whole(v["camera"], 2130), at_once=AT_ONCE)


@node("camera.connect", [port("camera: int", 2130), port("url: string"), port("fps: int", 15), port("buffer_seconds: int", 4)], ["stream: stream", "stream_id: string", "url: string", "width: int", "height: int"], style="call", category="Camera", cache_policy="disabled")
def connect(v: Inputs):
    """A stream's description: its id, address, rate, and how many frames a reader holds (at least 10).

    The frames are read by streaming.frames.read_frames, which takes this description.
    """
    make = factory("cameras")

    def open_(camera: int, url: str, fps: int, seconds: int) -> dict[str, Any]:
        got = {} if url else make().resolve(int(camera))
        url = url or got["url"]
        ident = f"camera-{int(camera)}"
        return {"stream": f"{ident}|{url}|{int(fps)}|{max(10, int(fps) * int(seconds))}", "stream_id": ident, "url": url, "width": got.get("width") or 704, "height": got.get("height") or 480}

    return calling(open_, "stream string, stream_id string, url string, width long, height long", whole(v["camera"], 2130), _text(v["url"]), whole(v["fps"], 15), whole(v["buffer_seconds"], 4))


@node("camera.get_frame", [port("stream: stream", None, True), port("timeout: float", 1.0), port("quality: int", 85), port("require_frame: boolean", True), port("pace: boolean", True)], ["image: string?", "has_frame: boolean", "timestamp: float", "width: int", "height: int"], style="column", category="Camera", cache_policy="disabled")
def get_frame(v: Inputs) -> dict[str, Column]:
    """The frame of a stream's row: a struct of image (data URL), timestamp, width and height, as read_frames gives.

    A row without image is an error if require_frame, else has_frame is false.
    """
    s = v["stream"]
    if "image" not in getattr(s.type, "fieldNames", lambda: [])():
        raise TypeError("port 'stream' takes a frame of a streaming source")
    image = s.col["image"]
    return {
        "image": failing(image.isNull() & truthy(v["require_frame"]), "no frame available", image),
        "has_frame": image.isNotNull(),
        "timestamp": F.coalesce(s.col["timestamp"].cast("double"), F.unix_micros(F.current_timestamp()) / 1e6),
        "width": s.col["width"].cast("long"),
        "height": s.col["height"].cast("long"),
    }


@node("camera.disconnect", [port("stream: stream", None, True)], ["stopped: boolean"], category="Camera", cache_policy="disabled")
def disconnect(v: Inputs) -> Column:
    """True where there was a stream; the running query itself ends by Engine.cancel or its stop()."""
    return v["stream"].col.isNotNull()


# --- segmentation service


def _service(v: Inputs, timeout: float = 30.0):
    make = factory("rest")
    return lambda server: make(server or SERVER, timeout)


def _needed(**values: Any) -> None:
    for name, x in values.items():
        if not x:
            raise ValueError(f"no {name} given")


@node("segment.connect", [port("server_url: string", SERVER), port("model_type: string", "image"), port("timeout: int", 30)], ["session_id: string"], style="call", category="Segmentation", cache_policy="disabled")
def segment_connect(v: Inputs):
    """Opens a session; an empty id where that fails."""
    make = factory("rest")

    def open_(server: str, model: str, timeout: float) -> dict[str, Any]:
        try:
            return {"session_id": make(server or SERVER, timeout).call("POST", "/api/connect", {"model_type": model, "timeout": timeout}).get("session_id") or ""}
        except OSError:
            return {"session_id": ""}

    return calling(open_, "session_id string", _text(v["server_url"]), _text(v["model_type"]), number(v["timeout"], 30))


@node("segment.is_alive", [port("session_id: string", None, True), port("server_url: string", SERVER)], ["session_id: string", "alive: boolean"], style="call", category="Segmentation", cache_policy="disabled")
def is_alive(v: Inputs):
    make = _service(v)

    def ask(session: str, server: str) -> dict[str, Any]:
        try:
            return {"session_id": session, "alive": bool(session) and bool(make(server).call("GET", f"/api/{session}/is-alive").get("alive"))}
        except OSError:
            return {"session_id": session, "alive": False}

    return calling(ask, "session_id string, alive boolean", _text(v["session_id"]), _text(v["server_url"]))


@node("segment.set_prompt", [port("session_id: string", None, True), port("prompt: string", None, True), port("server_url: string", SERVER)], ["session_id: string"], style="call", category="Segmentation", cache_policy="disabled")
def set_prompt(v: Inputs):
    """The text that says what to segment."""
    make = _service(v)

    def put(session: str, prompt: str, server: str) -> dict[str, Any]:
        _needed(session_id=session, prompt=prompt)
        return {"session_id": make(server).call("POST", f"/api/{session}/set-prompt", {"prompt": prompt}).get("session_id", session)}

    return calling(put, "session_id string", _text(v["session_id"]), _text(v["prompt"]), _text(v["server_url"]))


@node("segment.add_image", [port("session_id: string", None, True), port("image: string?", None, True), port("batch: int", 1), port("server_url: string", SERVER)], ["session_id: string", "added: boolean", "frame_idx: int"], style="call", category="Segmentation", cache_policy="disabled")
def add_image(v: Inputs):
    """Hands an image over; the service keeps the last batch of them."""
    make = _service(v)

    def put(session: str, image: str, batch: int, server: str) -> dict[str, Any]:
        _needed(session_id=session, image=image)
        got = make(server).call("POST", f"/api/{session}/add-image", {"image": image, "batch": int(batch)})
        return {"session_id": got.get("session_id", session), "added": bool(got.get("added")), "frame_idx": got.get("frame_idx", 0)}

    return calling(put, "session_id string, added boolean, frame_idx long", _text(v["session_id"]), _text(v["image"]), whole(v["batch"], 1), _text(v["server_url"]))


@node("segment.get_output", [port("session_id: string", None, True), port("frame_idx: int", 0), port("server_url: string", SERVER)], ["session_id: string", "masks: list<string>", "boxes: list<any>", "scores: list<float>", "count: int"], style="call", category="Segmentation", cache_policy="disabled")
def get_output(v: Inputs):
    """Masks, boxes and scores of a frame."""
    make = _service(v)

    def ask(session: str, frame: int, server: str) -> dict[str, Any]:
        _needed(session_id=session)
        got = make(server).call("GET", f"/api/{session}/get-output/{int(frame)}")
        boxes = [[float(y) for y in x] for x in got.get("boxes", [])]
        return {"session_id": got.get("session_id", session), "masks": got.get("masks", []), "boxes": boxes, "scores": [float(x) for x in got.get("scores", [])], "count": got.get("count", 0)}

    return calling(ask, "session_id string, masks array<string>, boxes array<array<double>>, scores array<double>, count long", _text(v["session_id"]), whole(v["frame_idx"]), _text(v["server_url"]))


@node("segment.visualize", [port("session_id: string", None, True), port("frame_idx: int", 0), port("alpha: float", 0.5), port("server_url: string", SERVER)], ["session_id: string", "image: string"], style="call", category="Segmentation", cache_policy="disabled")
def visualize(v: Inputs):
    """The frame with its masks over it."""
    make = _service(v)

    def ask(session: str, frame: int, alpha: float, server: str) -> dict[str, Any]:
        _needed(session_id=session)
        got = make(server).call("POST", f"/api/{session}/visualize", {"frame_idx": int(frame), "alpha": alpha})
        return {"session_id": got.get("session_id", session), "image": got.get("image", "")}

    return calling(ask, "session_id string, image string", _text(v["session_id"]), whole(v["frame_idx"]), number(v["alpha"], 0.5), _text(v["server_url"]))


@node("segment.disconnect", [port("session_id: string", None, True), port("server_url: string", SERVER)], ["disconnected: boolean"], style="call", category="Segmentation", cache_policy="disabled")
def segment_disconnect(v: Inputs):
    make = _service(v)

    def end(session: str, server: str) -> dict[str, Any]:
        try:
            make(server).call("DELETE", f"/api/{session}/disconnect")
        except OSError:
            return {"disconnected": False}
        return {"disconnected": bool(session)}

    return calling(end, "disconnected boolean", _text(v["session_id"]), _text(v["server_url"]))

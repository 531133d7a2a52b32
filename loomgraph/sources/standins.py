"""Offline clients that answer by rule, for queries and trials without cameras, services or image files."""

from __future__ import annotations

from typing import Any

from .clients import data_url


class Files:
    """Every path holds its own name; every image can be saved but without a path."""

    def load(self, path: str) -> str:
        if not path:
            raise ValueError("no file path given")
        return data_url(path.encode(), path)

    def save(self, image: str, path: str) -> bool:
        return bool(image) and bool(path)


class Service:
    """A segmentation service in which sessions are named by their model; servers with `down` in the name refuse."""

    def __init__(self, server: str, timeout: float = 30.0):
        self.server = server

    def call(self, method: str, path: str, body: dict[str, Any] | None = None) -> dict[str, Any]:
        if "down" in self.server:
            raise OSError("refused")
        body = body or {}
        if path == "/api/connect":
            return {"session_id": f"session-{body['model_type']}"}
        session, what = path.split("/")[2:4]
        answers: dict[str, dict[str, Any]] = {
            "is-alive": {"alive": True},
            "set-prompt": {"session_id": f"{session}-{body.get('prompt')}"},
            "add-image": {"session_id": session, "added": True, "frame_idx": len(body.get("image") or "")},
            "visualize": {"session_id": session, "image": data_url(session.encode(), "x.png")},
        }
        if what == "get-output":
            frame = int(path.rsplit("/", 1)[1])
            return {"session_id": session, "masks": [session], "boxes": [[0, 0, frame, frame]], "scores": [1 / (1 + frame)], "count": 1}
        return answers.get(what, {})


class Cameras:
    def resolve(self, camera: int) -> dict[str, Any]:
        return {"url": f"http://camera.example/{camera}.m3u8", "width": 640, "height": 360}

"""Predictions over HTTP, for one message at a time; batches and streams go through ``flows`` and ``serve``.

``/api/v1/health``, ``/api/v1/predict`` (JSON with subject, body and mode) and ``/api/v1/predict/raw`` (a raw message). Each
request is a frame of one row through the same functions as a batch.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession

from mailloom.plans import flows
from mailloom.sources import mail

# Class names in answers.
CLASS_NAMES = ("Human Benign", "Human Phishing", "LLM Benign", "LLM Phishing")
Vectors = Callable[[DataFrame], DataFrame]


class Refused(Exception):
    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status = status


@dataclass
class Service:
    """Loaded models by mode: what adds the column features, and the head."""

    spark: SparkSession
    modes: dict[str, tuple[Vectors, Model]] = field(default_factory=dict)
    classifier: str = "rf"
    rule: str = "service"
    default_mode: str = "stylometric"

    def health(self) -> dict:
        return {"status": "healthy" if self.modes else "initializing", "version": "1.0.0", "classifier": self.classifier, "device": "cpu", "available_modes": sorted(self.modes), "models_loaded": {m: m in self.modes for m in ("fusion", "semantic", "stylometric")}}

    def predict(self, subject: str, body: str, mode: str | None = None) -> dict:
        begun, mode = time.perf_counter(), mode or self.default_mode
        if not self.modes:
            raise Refused(503, "models are being loaded")
        if not subject and not body:
            raise Refused(422, "either subject or body must be given")
        if mode not in self.modes:
            raise Refused(422, f"mode {mode!r} is not loaded")
        vectors, model = self.modes[mode]
        message = self.spark.createDataFrame([("message", subject, body)], "id string, subject string, body string")
        r = flows.predict_messages(message, vectors, model, self.rule).first()
        probs = [r["probabilities"][name] for name in flows.CLASSES]  # a map comes in any order
        return {
            "prediction": CLASS_NAMES[r["predicted_class"]],
            "is_phishing": r["is_phishing"],
            "is_llm_generated": r["predicted_class"] in (2, 3),
            "phishing_probability": probs[1] + probs[3],
            "confidence_scores": dict(zip(CLASS_NAMES, probs, strict=True)),
            "processed_preview": r["preview"],
            "metadata": {"classifier": self.classifier, "mode": mode, "latency_ms": 1000 * (time.perf_counter() - begun), "detected_urls": r["n_urls"], "html_stripped": r["is_html"], "thread_history_sliced": r["thread_sliced"]},
        }

    def predict_raw(self, raw: bytes, mode: str | None = None) -> dict:
        if not self.modes:
            raise Refused(503, "models are being loaded")
        if not raw:
            raise Refused(400, "the message is empty")
        try:
            subject, body = mail.service_parse(raw)
        except Exception as x:
            raise Refused(422, f"the message can't be parsed: {x}") from x
        return self.predict(subject, body, mode)


def server(service: Service, port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is not running yet: ``serve_forever`` runs it, ``shutdown`` ends it."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, data: dict) -> None:
            body = json.dumps(data).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def handled(self, routes: dict[str, Callable[[str | None], dict]]) -> None:
            at = urlsplit(self.path)
            mode = parse_qs(at.query).get("mode", [None])[0]
            try:
                if at.path not in routes:
                    raise Refused(404, "no such path")
                self.answer(200, routes[at.path](mode))
            except Refused as x:
                self.answer(x.status, {"detail": str(x)})
            except Exception as x:
                self.answer(500, {"detail": f"inference failed: {x}"})

        def payload(self) -> bytes:
            return self.rfile.read(int(self.headers.get("Content-Length") or 0))

        def structured(self, mode: str | None) -> dict:
            try:
                data = json.loads(self.payload() or b"{}")
                subject, body = str(data.get("subject") or ""), str(data.get("body") or "")
            except (ValueError, AttributeError) as x:
                raise Refused(422, "the payload is no JSON object") from x
            return service.predict(subject, body, mode or data.get("mode"))

        def do_GET(self) -> None:
            self.handled({"/api/v1/health": lambda mode: service.health()})

        def do_POST(self) -> None:
            self.handled({"/api/v1/predict": self.structured, "/api/v1/predict/raw": lambda mode: service.predict_raw(self.payload(), mode)})

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)

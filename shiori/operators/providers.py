"""Models behind an interface: answering, embedding and reading images, with deterministic stand-ins.

No model is called here. A provider's batch method runs in the Python workers on Arrow batches; the
stand-ins make every pipeline runnable and repeatable without a network. Their answers say nothing about
the quality a model would have.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ABSTAIN = "わかりません"
STAGES = ["transcription", "visual_state", "fusion"]


class AnswerClient(Protocol):
    def check(self) -> None: ...
    def generate(self, question: str, context: str) -> str: ...


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class ExtractiveAnswers:
    """Answers with the context line that shares most characters with the question; abstains without any."""

    def check(self) -> None:
        return None

    def generate(self, question: str, context: str) -> str:
        asked = set(question) - set(" \n")
        lines = [x for x in context.split("\n") if x.strip() and not x.startswith("---")]
        best = max(lines, key=lambda x: (len(asked & set(x)), -len(x)), default="")
        return best if len(asked & set(best)) >= max(1, len(asked) // 2) else ABSTAIN


class HashEmbedder:
    """Unit vectors from hashed character pairs."""

    def __init__(self, dimensions: int = 96):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for k, text in enumerate(texts):
            for pair in zip(text, text[1:] or text):
                h = int.from_bytes(hashlib.blake2b("".join(pair).encode(), digest_size=8).digest(), "big")
                out[k, h % self.dimensions] += 1 if h >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)


def embed(units: DataFrame, embedder: Embedder, batch: int = 256) -> DataFrame:
    """(unit_seq, vector) of units (unit_seq, search_text), in batches of at most 256 texts a call."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                vectors = embedder.embed([f"title: none | text: {t or ''}" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(vectors), pa.list_(pa.float32()))], names=["unit_seq", "vector"])

    return units.select("unit_seq", "search_text").mapInArrow(run, "unit_seq long, vector array<float>")


def answer(questions: DataFrame, client: AnswerClient) -> DataFrame:
    """(query_id, answer) of questions (query_id, query, context); an error of the client counts as abstention."""
    client.check()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for query, context in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist()):
                try:
                    out.append(client.generate(query or "", context or "") or ABSTAIN)
                except Exception:
                    out.append(ABSTAIN)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out, pa.string())], names=["query_id", "answer"])

    return questions.select("query_id", "query", "context").mapInArrow(run, f"query_id {dict(questions.dtypes)['query_id']}, answer string")


def model_json(response: str) -> dict:
    """The JSON object of a model's response, which may be fenced as code."""
    bare = re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", response)
    value = json.loads(bare)
    if not isinstance(value, dict):
        raise ValueError("the response is no object")
    return value


def stage_signature(image_sha256: str, model: str, stage: str, prompt_version: str, *upstream: str) -> str:
    """Key of a stage's cached result: everything that it depends on."""
    parts = {"image": image_sha256, "model": model, "stage": stage, "prompt": prompt_version, "upstream": list(upstream)}
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class VisionModel(Protocol):
    def run(self, stage: str, image: bytes, upstream: list[dict]) -> str: ...


class SizeVision:
    """Reports no more than the image's size."""

    def run(self, stage: str, image: bytes, upstream: list[dict]) -> str:
        from ..sources.files import image_size

        return json.dumps({"stage": stage, "size": image_size(image), "n_upstream": len(upstream)})


def analyse_images(images: DataFrame, model: VisionModel) -> DataFrame:
    """(path, transcription, visual_state, fusion, status, retry_count): the three stages one after another.

    images: path, content. The first two see the image only, the last both of their results. A stage
    that gives no object makes the analysis unresolved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: list[list] = [[] for _ in range(4)]
            for content in rows.column(1).to_pylist():
                done, status = [], "verified"
                for stage in STAGES:
                    try:
                        done.append(model_json(model.run(stage, content or b"", [d for d in done if d] if stage == "fusion" else [])))
                    except Exception:
                        done.append(None)
                        status = "unresolved"
                for column, value in zip(out, [*[None if d is None else json.dumps(d, ensure_ascii=False, sort_keys=True) for d in done], status]):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(c, pa.string()) for c in out], pa.array([0] * rows.num_rows, pa.int32())], names=["path", *STAGES, "status", "retry_count"])

    return images.select("path", "content").mapInArrow(run, "path string, transcription string, visual_state string, fusion string, status string, retry_count int")

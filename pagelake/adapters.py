"""Interfaces to models and image codecs, which are not part of the engine.

A model is a function from a pandas frame to a pandas frame that a worker calls
once per batch; the defaults are deterministic stand-ins that say so.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Model = Callable[[pd.DataFrame], pd.DataFrame]


def retrying(model: Model, tries: int = 3, wait: float = 4.0, longest: float = 10.0) -> Model:
    """Call again after an error, waiting twice as long each time."""

    def call(batch: pd.DataFrame) -> pd.DataFrame:
        for k in range(tries):
            try:
                return model(batch)
            except Exception:
                if k + 1 == tries:
                    raise
                time.sleep(min(longest, wait * 2**k))
        raise AssertionError

    return call


def infer(df: DataFrame, model: Model, schema: str, batch: int = 256) -> DataFrame:
    """Run a model over the rows in batches of at most ``batch``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for s in range(0, len(f), batch):
                yield model(f.iloc[s : s + batch])

    return df.mapInPandas(run, schema)


def stub_classifier(classes: int, text: str = "content", key: str = "bbox_uid") -> Model:
    """A stand-in: probabilities from the text's length, not a real classifier."""

    def model(batch: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({key: batch[key], "predicted_class": batch[text].fillna("").str.len() % classes})
        for k in range(classes):
            out[f"class_{k}_probability"] = (out["predicted_class"] == k).astype(float)
        return out

    return model


def stub_transcriber(batch: pd.DataFrame) -> pd.DataFrame:
    """A stand-in for an image-to-text model: names the request instead of reading it."""
    return pd.DataFrame({"custom_id": batch["custom_id"], "content": "transcript of " + batch["custom_id"]})


Renderer = Callable[[bytes], list[bytes]]
ImageStep = Callable[[bytes, dict], bytes]


def rendered_pages(files: DataFrame, render: Renderer) -> DataFrame:
    """(name, page, image) of every page of document files, from (path, content) rows; names are <file>_page_<n>."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                pages = render(bytes(content))
                yield pd.DataFrame({"name": [f"{stem}_page_{k}" for k in range(len(pages))], "page": range(len(pages)), "image": pages})

    return files.select("path", "content").mapInPandas(run, "name string, page int, image binary")


def stub_renderer(content: bytes) -> list[bytes]:
    """A stand-in for a page renderer: the parts between form feeds, not pictures."""
    return content.split(b"\x0c")


def image_steps(plan: DataFrame, steps: list[ImageStep], image: str = "image") -> DataFrame:
    """Apply crop, deskew, pad and encode steps, given from outside, to each row's image; a step sees the row as a dictionary."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = f.to_dict("records")
            out = []
            for r in rows:
                data = bytes(r.pop(image))
                for step in steps:
                    data = step(data, r)
                out.append(data)
            yield f.assign(**{image: out})

    return plan.mapInPandas(run, plan.schema)


def stub_step(data: bytes, row: dict) -> bytes:
    """A stand-in for an image operation: leaves the image as it is."""
    return data

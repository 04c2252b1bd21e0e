"""Boundaries for models that stay outside Spark: matchers, encoders and captioners.

A plug-in is a factory that is called once per Python worker and partition; Spark hands
it Arrow-backed pandas batches. No network ships with the engine; ``stand_in_matcher``
shows the contract and is deterministic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

MATCH = "sat_kp int, drone_kp int, raw int, good int, inliers int, h array<double>, t_match_ms double"


def match(frames: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], keys: list[str]) -> DataFrame:
    """Run a matcher: the factory loads the model, the function it returns maps a batch of rows to MATCH columns in row order."""
    schema = ", ".join(f"`{k}` {t}" for k, t in frames.select(*keys).dtypes) + ", " + MATCH

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for b in batches:
            model = model or factory()
            yield pd.concat([b[keys].reset_index(drop=True), model(b).reset_index(drop=True)], axis=1)

    return frames.mapInPandas(run, schema)


def encode(images: DataFrame, factory: Callable[[], Callable[[pd.Series], list]], column: str, out: str = "emb") -> DataFrame:
    """Run an encoder over a column: one vector per row."""
    schema = ", ".join(f"`{k}` {t}" for k, t in images.dtypes) + f", `{out}` array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for b in batches:
            model = model or factory()
            yield b.assign(**{out: list(model(b[column]))})

    return images.mapInPandas(run, schema)


def caption(images: DataFrame, factory: Callable[[], Callable[[object], str]], column: str, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """Run a captioner with retries, waiting ``wait`` seconds and twice as long each time; a row that keeps failing gets a null caption."""
    schema = ", ".join(f"`{k}` {t}" for k, t in images.dtypes) + ", caption string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        model = factory()

        def one(x):
            for i in range(tries):
                try:
                    return model(x)
                except Exception:  # noqa: BLE001
                    if i < tries - 1:
                        time.sleep(wait * 2**i)
            return None

        for b in batches:
            yield b.assign(caption=[one(x) for x in b[column]])

    return images.mapInPandas(run, schema)


def encode_both(rows: DataFrame, factory: Callable[[], tuple[Callable[[pd.Series], list], Callable[[pd.Series], list]]], image: str, text: str) -> DataFrame:
    """Run a bundle of an image and a text encoder that share their vectors' space: ``emb`` and ``text_emb``, the latter scaled to length 1.

    The factory returns both functions of one loaded model. A row without a text gets a null ``text_emb``.
    """
    schema = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes) + ", emb array<float>, text_emb array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        both = None
        for b in batches:
            both = both or factory()
            some = b[text].notna()
            vectors = iter(both[1](b.loc[some, text]) if some.any() else [])
            unit = lambda v: (np.asarray(v, np.float64) / (np.linalg.norm(v) + 1e-12)).tolist()
            yield b.assign(emb=list(both[0](b[image])), text_emb=[unit(next(vectors)) if x else None for x in some])

    return rows.mapInPandas(run, schema)


def stand_in_encoders() -> tuple[Callable[[pd.Series], list], Callable[[pd.Series], list]]:
    """An encoder bundle without a model: vectors that follow from a number and from a text's length alone."""
    return (lambda s: [[float(i % 7), float(i % 11), 1.0] for i in s]), (lambda s: [[float(len(t)), 1.0, 0.0] for t in s])


def stand_in_captioner() -> Callable[[object], str]:
    """A captioner without a model; numbers divisible by 13 fail, as a model may."""

    def one(i):
        if int(i) % 13 == 0:
            raise ValueError("no caption")
        return f"fields along road {int(i) % 100}"

    return one


def stand_in_matcher() -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A matcher without a model: counts and a shift that follow from seq alone."""

    def model(b: pd.DataFrame) -> pd.DataFrame:
        s = b["seq"].astype("int64")
        h = [[0.6, 0.0, float(i % 97), 0.0, 0.6, float(i % 89), 0.0, 0.0, 1.0] for i in s]
        return pd.DataFrame({"sat_kp": s % 500 + 100, "drone_kp": s % 400 + 100, "raw": s % 300, "good": s % 200, "inliers": s % 60, "h": h, "t_match_ms": 50.0 + s % 700})

    return model

"""Embedding text fields: a pluggable model, batches by token budget, truncation, normalising and quantisation."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass, fields
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantize import PRECISIONS, dequantize, quantize, round_trip


class Model(Protocol):
    """Anything that can be pickled and turns texts into vectors."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class EmbedConfig:
    """How one source field becomes one target field."""

    model: Model | str
    target: str
    dims: int | None = None
    precision: str = "f32"
    normalize: bool = True
    query_prefix: str = ""
    doc_prefix: str = ""
    max_length: int = 1024
    batch_size: int = 32
    max_batch_tokens: int = 8192

    def __post_init__(self):
        if self.precision not in PRECISIONS:
            raise ValueError(f"unknown precision {self.precision}")
        if isinstance(self.model, str):
            raise ValueError(resolve_model(self.model))

    @classmethod
    def of(cls, options: dict) -> EmbedConfig:
        unknown = set(options) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
        return cls(**options)


def resolve_model(name: str) -> str:
    """Why a model's name can't be loaded here: hub names need a network, and no weights come with the library."""
    if name.startswith("hf:"):
        return f"{name}: models aren't fetched; give a local directory's model object"
    return f"{name}: {'a directory; wrap its model in an object with embed()' if os.path.isdir(name) else 'no such model'}"


def plan_batches(texts: list[str], batch_size: int = 32, max_batch_tokens: int = 8192, max_length: int = 1024) -> list[list[int]]:
    """Numbers of texts by batch, longest first, so that a batch's count times its widest stays in the budget. Tokens are guessed as bytes / 3 + 2."""
    guess = [min(max(len(t.encode()) // 3 + 2, 1), max(max_length, 1)) for t in texts]
    out: list[list[int]] = []
    for i in sorted(range(len(texts)), key=lambda i: (-guess[i], i)):
        if not out or len(out[-1]) >= max(batch_size, 1) or (len(out[-1]) + 1) * guess[out[-1][0]] > max(max_batch_tokens, 1):
            out.append([])
        out[-1].append(i)
    return out


def finalise(vector: list[float], config: EmbedConfig) -> list[float]:
    """Cut to dims and brought to length 1."""
    v = [float(x) for x in (vector if config.dims is None else vector[: config.dims])]
    n = math.sqrt(math.fsum(x * x for x in v))
    return [x / n for x in v] if config.normalize and n else v


def embed_column(df: DataFrame, source: str, config: EmbedConfig) -> DataFrame:
    """df with target: the vector of each string in source, quantised and read back; null where source is null. Arrow batches, then batches by tokens."""
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = s.tolist()
            there = [i for i, t in enumerate(texts) if t is not None]
            said = [config.doc_prefix + texts[i] for i in there]
            out: list = [None] * len(texts)
            for part in plan_batches(said, config.batch_size, config.max_batch_tokens, config.max_length):
                for i, v in zip(part, config.model.embed([said[i] for i in part])):
                    out[there[i]] = finalise(v, config)
            yield pd.Series(out, dtype="object")

    out = df.withColumn(config.target, run(F.col(source)))
    if config.precision == "f32":
        return out
    v = F.col(config.target)  # a column by now: higher-order functions take no Python function
    return out.withColumn(config.target, F.when(v.isNotNull(), F.slice(dequantize(quantize(v, config.precision), config.precision), F.lit(1), F.size(v))))


class Embedder:
    """The configured fields of a collection: {source: EmbedConfig}."""

    def __init__(self, configs: dict[str, EmbedConfig | dict]):
        self.configs = {k: c if isinstance(c, EmbedConfig) else EmbedConfig.of(c) for k, c in configs.items()}

    def target_of(self, name: str) -> str:
        return self.configs[name].target if name in self.configs else name

    def config_of(self, name: str) -> EmbedConfig:
        for source, c in self.configs.items():
            if name in (source, c.target):
                return c
        raise ValueError(f"no embedding is configured for {name}")

    def embed_query(self, name: str, text: str) -> list[float]:
        c = self.config_of(name)
        return round_trip(finalise(c.model.embed([c.query_prefix + text])[0], c), c.precision)

    def apply(self, df: DataFrame) -> DataFrame:
        for source, c in self.configs.items():
            if source in df.columns:
                df = embed_column(df, source, c)
        return df

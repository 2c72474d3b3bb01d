"""Embedding and completion services as plug-ins, with retries, and offline stand-ins.

The stand-ins are deterministic and need no network. They are no models: nothing about
quality follows from them.
"""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts per request, retries, and waits in seconds.
BATCH = 8
RETRIES = 5
DEFAULT_WAIT, LONGEST_WAIT, FIRST_WAIT = 30.0, 30.0, 5.0


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class RateLimited(Exception):
    """The service asks to wait: headers as it sent them."""

    def __init__(self, headers: dict[str, str] | None = None) -> None:
        super().__init__("rate limited")
        self.headers = {k.lower(): v for k, v in (headers or {}).items()}


def wait_of(error: RateLimited) -> float:
    """Seconds to wait, at least one."""
    for name, scale in (("retry-after-ms", 1000.0), ("retry-after", 1.0)):
        try:
            return max(1.0, float(error.headers[name]) / scale)
        except (KeyError, ValueError):
            continue
    return DEFAULT_WAIT


def with_retries(call: Callable[[], object], sleep: Callable[[float], None] = time.sleep, retries: int = RETRIES):
    """Calls until it works or the retries are used up; other errors pass through."""
    for n in range(retries + 1):
        try:
            return call()
        except RateLimited as error:
            if n == retries:
                raise
            sleep(wait_of(error))
        except ConnectionError:
            if n == retries:
                raise
            sleep(min(LONGEST_WAIT, FIRST_WAIT * 2**n))


def hashed_embedder(size: int = 64) -> Embedder:
    """Stand-in: signed feature hashing of words, unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), size))
        for k, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[k, h % size] += 1 if h >> 63 else -1
        norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
        return (out / np.where(norm == 0, 1, norm)).tolist()

    return embed


class Completer(Protocol):
    def __call__(self, system: str, prompt: str) -> str: ...


def quoting_completer(system: str, prompt: str) -> str:
    """Stand-in: repeats the first words of one passage with its marker."""
    first = prompt.split("[1]", 1)[-1].split("\n", 1)[-1]
    return f"{first[:80].strip()} [1]."


def embed_texts(texts: list[str], embedder: Embedder, batch: int = BATCH, sleep: Callable[[float], None] = time.sleep, initial: list[list[float]] | None = None) -> list[list[float]]:
    """In order, a batch per request; an error where an answer has another number of vectors.

    initial: vectors of the first texts, which are not asked for again.
    """
    out: list[list[float]] = list(initial or [])
    if len(out) > len(texts):
        raise ValueError("more initial vectors than texts")
    for a in range(len(out), len(texts), batch):
        part = texts[a : a + batch]
        got = with_retries(lambda part=part: embedder(part), sleep)
        if len(got) != len(part):
            raise ValueError("the service returned another number of vectors")
        out += got
    return out


def embed(rows: DataFrame, embedder: Embedder, text_col: str = "embed_text", batch: int = BATCH) -> DataFrame:
    """Adds v (float vector) and text_hash. Retries are inside the task: a repeated task would ask for all rows again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = [x or "" for x in part.column(part.schema.get_field_index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(embed_texts(texts, embedder, batch), pa.list_(pa.float32()))], names=[*part.schema.names, "v"])

    hashed = rows.withColumn("text_hash", F.sha2(text_col, 256))
    return hashed.mapInArrow(run, T.StructType([*hashed.schema.fields, T.StructField("v", T.ArrayType(T.FloatType()))]))


def complete(prompts: DataFrame, completer: Completer) -> DataFrame:
    """(query, text) of rows (query, system, prompt)."""
    kind = prompts.schema["query"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            told = [with_retries(lambda s=s, p=p: completer(s, p)) for s, p in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(told, pa.string())], names=["query", "text"])

    return prompts.select("query", "system", "prompt").mapInArrow(run, f"query {kind}, text string")


def run_id(now: time.struct_time | None = None) -> str:
    """When a run began, and eight hex digits."""
    return time.strftime("%Y%m%dT%H%M%SZ", now or time.gmtime()) + f"-{random.SystemRandom().getrandbits(32):08x}"

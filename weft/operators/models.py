"""Model calls over columns and work in other processes.

A model is any function of a list of inputs to a list of outputs; it is called on
Arrow batches where the data are.  Nothing here reaches a network: ``EchoModel`` is
the offline stand-in, and others are given by the user.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass
class EchoModel:
    """Answers with the prompt; embeds by counting bytes."""

    dim: int = 8

    def generate(self, prompts: list[str]) -> list[str]:
        return list(prompts)

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(sum(b % self.dim == k for b in t.encode())) for k in range(self.dim)] for t in texts]


def _mapped(f: Callable[[list], list], kind: str) -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        known = x.notna()
        out = pd.Series([None] * len(x), dtype=object)
        if known.any():
            out[known.to_numpy()] = pd.Series(f(x[known].tolist()), index=out.index[known.to_numpy()], dtype=object)
        return out

    return run


def generate(df: DataFrame, model, template: str, to: str = "response") -> DataFrame:
    """``template`` names columns in braces; a missing value makes the prompt, and the answer, missing."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    prompt = F.concat(*[F.lit(p) if k % 2 == 0 else F.col(p).cast("string") for k, p in enumerate(parts)])
    return df.withColumn(to, _mapped(model.generate, "string")(prompt))


def embed(df: DataFrame, model, column: str, to: str = "embedding") -> DataFrame: return df.withColumn(to, _mapped(model.embed, "array<double>")(F.col(column)))
def summary(df: DataFrame, model, column: str, to: str = "summary") -> DataFrame: return generate(df, model, f"Summarise: {{{column}}}", to)
summarize = summary
def transcribe(df: DataFrame, model, column: str, to: str = "transcript") -> DataFrame:
    """Text of each sound's bytes by a model's ``transcribe``, a batch at a time."""
    return df.withColumn(to, _mapped(model.transcribe, "string")(F.col(column)))


def detect_language(df: DataFrame, model, column: str, to: str = "language") -> DataFrame:
    """Language spoken in each sound's bytes by a model's ``detect_language``."""
    return df.withColumn(to, _mapped(model.detect_language, "string")(F.col(column)))


def apply_chunk(df: DataFrame, model, f: Callable, schema: str) -> DataFrame:
    """``f(model, batch)`` of batches as pandas frames."""
    return df.mapInPandas(lambda batches: (f(model, b) for b in batches), schema)


def translate(df: DataFrame, model, column: str, language: str, to: str = "translation") -> DataFrame: return generate(df, model, f"Translate to {language}: {{{column}}}", to)
def classify(df: DataFrame, model, column: str, labels: Sequence[str], to: str = "label") -> DataFrame:
    """The first label that the answer holds, else missing."""
    made = generate(df, model, f"One of {', '.join(labels)} for: {{{column}}}", "__a")
    answer = F.substring_index("__a", " for: ", -1)
    return made.withColumn(to, F.coalesce(*[F.when(F.contains(F.lower(answer), F.lit(x.lower())), F.lit(x)) for x in labels])).drop("__a")


def extract(df: DataFrame, model, column: str, schema: str, to: str = "extracted") -> DataFrame: return generate(df, model, f"{{{column}}}", "__a").withColumn(to, F.from_json("__a", schema)).drop("__a")


@dataclass
class Registry:
    """Models by name, kept by the driver."""

    models: dict[str, object] = field(default_factory=dict)

    def register(self, name: str, model) -> None: self.models[name] = model
    def get(self, name: str): return self.models[name]
    def clean(self) -> None: self.models.clear()
    def register_json(self, path: str, make: Callable[[dict], object]) -> None:
        """Models from a file of {name: settings}."""
        import json

        with open(path, encoding="utf-8") as f:
            for name, settings in json.load(f).items():
                self.register(name, make(settings))

    def register_folder(self, folder: str, make: Callable[[dict], object]) -> None:
        """Models from all .json files of a folder, in the order of their names."""
        import pathlib

        for path in sorted(pathlib.Path(folder).glob("*.json")):
            self.register_json(str(path), make)


def predict(df: DataFrame, f: Callable[[pd.DataFrame], pd.Series], columns: list[str], kind: str = "double", to: str = "prediction") -> DataFrame:
    """A fitted model's function of a pandas frame, batch by batch."""
    @F.pandas_udf(kind)
    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(f(rows))

    return df.withColumn(to, run(F.struct(*columns)))


def spawn(spark: SparkSession, f: Callable, arguments: list[tuple], kind: str) -> DataFrame:
    """``f`` of each tuple of arguments as a task: (i, result)."""
    import pickle

    rows = spark.createDataFrame([(k, bytearray(pickle.dumps(a))) for k, a in enumerate(arguments)], "i bigint, a binary")

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"i": b.i, "result": [f(*pickle.loads(bytes(a))) for a in b.a]})

    return rows.repartition(max(1, len(arguments)), "i").mapInPandas(run, f"i bigint, result {kind}")

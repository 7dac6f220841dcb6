"""The seam for language models: structure check and reference fallback, off by default.

A hook maps batches of rows to rows of the same schema on the executors. Without one, rows pass unchanged; a hook that
fails leaves its batch unchanged, as a checker must never lose a document, and adds one to an accumulator if given.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Hook = Callable[[pd.DataFrame], pd.DataFrame]


@dataclass(frozen=True)
class ModelConfig:
    """What a hook needs; key is None where no model is set up, and then hooks are bypassed."""

    name: str = "none"
    key: str | None = None
    timeout_s: int = 60

    @classmethod
    def from_environment(cls, name: str, variable: str) -> ModelConfig:
        """The key that an environment variable holds, if it is set."""
        return cls(name, os.environ.get(variable) or None)


def without_fence(reply: str) -> str:
    return re.sub(r"\s*```$", "", re.sub(r"^```[a-z]*\s*", "", reply.strip()))


def apply_hook(rows: DataFrame, hook: Hook | None = None, config: ModelConfig | None = None, failures=None) -> DataFrame:
    if hook is None or (config is not None and config.key is None):
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                out = hook(batch)
                fits = list(out.columns) == list(batch.columns)
            except Exception:  # noqa: BLE001  a failing model must not fail the pipeline
                out, fits = batch, False
            if not fits and failures is not None:
                failures.add(1)
            yield out if fits else batch

    return rows.mapInPandas(run, rows.schema)


def json_reply_hook(ask: Callable[[str], str], column: str) -> Hook:
    """A hook that sends each value of a column to ask() and takes its reply if it is JSON."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        def one(value: str) -> str:
            reply = without_fence(ask(value))
            try:
                json.loads(reply)
            except ValueError:
                return value
            return reply

        return batch.assign(**{column: batch[column].map(one)})

    return run


def structure_prompt(markdown: str, tree: str) -> str:
    """What a structure checker is asked: the text, the tree found in it, and to reply with the corrected tree alone."""
    return f"Check the hierarchy found in a statute. Reply with the corrected JSON tree and nothing else.\n\nText:\n{markdown}\n\nTree:\n{tree}"


def structure_hook(ask: Callable[[str], str], markdown: str = "text", tree: str = "json") -> Hook:
    """A hook that has each row's tree checked against its text; a reply that is no JSON leaves the tree as it is."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        def one(text: str, found: str) -> str:
            reply = without_fence(ask(structure_prompt(text, found)))
            try:
                json.loads(reply)
            except ValueError:
                return found
            return reply

        return batch.assign(**{tree: [one(*row) for row in zip(batch[markdown], batch[tree])]})

    return run


def healed_folder(spark: SparkSession, path: str, hook: Hook | None = None, config: ModelConfig | None = None, pattern: str = "*.json") -> DataFrame:
    """The texts of a folder's files after the hook."""
    from ..sources.readers import read_folder

    return apply_hook(read_folder(spark, path, pattern), hook, config)


def with_model_references(found: DataFrame, texts: DataFrame, key: list[str], hook: Hook | None, config: ModelConfig | None = None) -> DataFrame:
    """found (key, anchor, target_id, ...) and what a model names besides: (key, anchor, target_id) by batch of texts. A
    target may be a list, joined by commas; an anchor of the unit that is there already, or named twice, is left out."""
    own = found.withColumn("model", F.lit(False))
    if hook is None or (config is not None and config.key is None):
        return own
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                said = hook(batch)[[*key, "anchor", "target_id"]].dropna(subset=["anchor"])
            except Exception:  # noqa: BLE001  a failing model adds nothing
                continue
            if not len(said):
                continue
            targets = said["target_id"].map(lambda t: ",".join(map(str, t)) if isinstance(t, (list, tuple)) else t)
            yield said.assign(target_id=targets)

    said = texts.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in key), "anchor string", "target_id string"]))
    first = Window.partitionBy(*key, "anchor").orderBy("target_id")
    said = said.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    new = said.join(found.select(*key, "anchor"), [*key, "anchor"], "left_anti").withColumn("model", F.lit(True))
    return own.unionByName(new, allowMissingColumns=True)

"""Stages that run a model over rows, and jobs made of stages that are skipped once done."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from talkweave.functions.config import Named
from talkweave.operators import trainset as N

#: Losses by name: each takes rows of losses and weights and gives one row.
LOSSES = Named(
    balanced=N.balanced_loss,
    token=N.token_loss,
    logit_adjusted=lambda rows: N.token_loss(rows, "loss", "adj_loss"),
    all_adjusted=lambda rows: N.all_adjusted_loss(rows.withColumn("loss", rows["adj_loss"])),
    fuzzy=lambda rows: N.token_loss(rows, "fuzzy_loss", "adj_loss"),
)
MODELS = Named()


def model_stage(rows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.Series]], output: str, kind: str = "string") -> DataFrame:
    """Adds a column made by a model: `load` runs once in each task and gives a function of an Arrow batch.

    Recognisers, punctuators, language models and judges are such functions.
    """
    columns = rows.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in parts:
            yield pdf.assign(**{output: model(pdf)})[[*columns, output]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{output}` {kind}"
    return rows.mapInPandas(run, schema)


def run_stages(spark: SparkSession, folder: str, stages: list[tuple[str, Callable[[SparkSession, dict[str, DataFrame]], DataFrame]]]) -> dict[str, DataFrame]:
    """Runs named stages in order, each written to folder/name and read again; a stage that is written is not run.

    A write that did not end leaves no mark, so its stage runs again.
    """
    from talkweave.sources.files import cached

    done: dict[str, DataFrame] = {}
    for name, make in stages:
        done[name] = cached(spark, f"{folder}/{name}", lambda m=make: m(spark, done))
    return done

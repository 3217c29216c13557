"""Plug-in point for models: scorers run in Python workers, batch by batch, loaded once per task."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.numbers import col


def with_model(df: DataFrame, loader: Callable[[], Callable[[list[str]], dict[str, list]]], outputs: str, text: str = "text", batch: int = 32,
               max_chars: int | None = None) -> DataFrame:
    """Add the ``outputs`` columns (a DDL string) computed by a user-supplied scorer.

    ``loader`` runs once per task and gives ``score(texts) -> {column: values}``. The model's own input window, if
    it has one, is ``max_chars``; by default it sees the whole text.
    """
    added = T._parse_datatype_string(outputs)
    schema = T.StructType([*df.schema.fields, *added.fields])
    names = [f.name for f in added.fields]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = loader()
        for pdf in parts:
            done: dict[str, list] = {n: [] for n in names}
            texts = pdf[text].fillna("").tolist()
            for i in range(0, len(texts), batch):
                chunk = [t if max_chars is None else t[:max_chars] for t in texts[i:i + batch]]
                got = score(chunk)
                for n in names:
                    done[n].extend(got[n])
            yield pdf.assign(**done)

    return df.mapInPandas(run, schema)


def prepare_embedding_text(text: Column | str, kind: str = "passage") -> Column:
    """Prefix that retrieval encoders expect: ``query: `` or ``passage: ``."""
    return F.concat(F.lit(f"{kind}: "), col(text))


def keep_topics(labels: Column | str, scores: Column | str, minimum: float = 0.3, n: int = 5) -> Column:
    """The first n labels whose score reaches the minimum."""
    pairs = F.filter(F.arrays_zip(col(labels).alias("l"), col(scores).alias("s")), lambda x: x["s"] >= minimum)
    return F.slice(F.transform(pairs, lambda x: x["l"]), 1, n)

"""Language services as injected functions, with deterministic defaults, and the loops around them.

Every service is a function from columns to a column, so a default stays in the
JVM; one that calls out is a pandas UDF made by batched().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels, sets
from ..functions import text as tx


@dataclass(frozen=True)
class Services:
    """What the cascades and generators ask of a language model."""

    #: Another wording of a question.
    rephrase: Callable[[Column], Column] = lambda q: labels.rephrase(q, F.length(q))
    #: A candidate's logit for a query, from their texts.
    rerank: Callable[[Column, Column], Column] = lambda q, d: 8 * sets.overlap(tx.words(q), tx.words(d)) - 4
    #: Whether an answer fits a question: Entailment, Neutral or Contradiction.
    verify: Callable[[Column, Column], Column] = lambda q, a: F.when(sets.overlap(tx.keywords(q), tx.words(a)) >= 0.5, "Entailment").otherwise("Neutral")
    #: The names that a query is about.
    entities: Callable[[Column], Column] = lambda q: tx.keywords(q)
    #: A merged text of several.
    merge: Callable[[Column], Column] = lambda texts: F.array_join(F.filter(texts, lambda x: F.trim(x) != ""), " ")
    #: A refined question, from question, answer and attempt.
    refine: Callable[[Column, Column, int], Column] = lambda q, a, n: F.concat(q, F.lit(f" ({n})"))
    #: Called with a job's figures (a dict) after each batch.
    progress: Callable[[dict], None] = field(default=lambda figures: None)


def batched(embed: Callable[[list[str]], list[list[float]]], dim: int, size: int = 100) -> Callable[[Column], Column]:
    """A column function over a hosted encoder, called with size texts at a time; a call that fails gives zero vectors."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out: list[list[float]] = []
            own = batch.fillna("").tolist()
            for at in range(0, len(own), size):
                part = own[at : at + size]
                try:
                    made = [list(map(float, v)) for v in embed(part)]
                    if len(made) != len(part) or any(len(v) != dim for v in made):
                        raise ValueError("not a vector a text")
                except Exception:  # any failure of the service counts the same
                    made = [[0.0] * dim for _ in part]
                out += made
            yield pd.Series(out, index=batch.index)

    return encode


def guarded(rows: DataFrame, work: Callable[[dict], dict], fields: str) -> DataFrame:
    """Work on one row at a time; a row that fails has its error in the column error and nulls for the rest, and the others go on."""
    made = T._parse_datatype_string(fields)
    schema = T.StructType([*rows.schema.fields, *made.fields, T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for r in b.to_dict("records"):
                try:
                    got.append({**{f.name: None for f in made.fields}, **work(r), "error": None})
                except Exception as e:
                    got.append({**{f.name: None for f in made.fields}, "error": f"{type(e).__name__}: {e}"})
            extra = pd.DataFrame(got, index=b.index, columns=[*(f.name for f in made.fields), "error"])
            yield pd.concat([b, extra.astype(object).where(extra.notna(), None)], axis=1)

    return rows.mapInPandas(run, schema)


def refined(candidates: DataFrame, near: Callable[[DataFrame, DataFrame], DataFrame], services: Services, most: int = 3) -> DataFrame:
    """Check, refine and accept: candidates (id, question, answer) to accepted pairs with the number of refinements.

    near(rows, all rows) gives the ids of rows that come too near to an earlier accepted or open one. Each
    attempt works on all open rows at once; after the last one they are accepted as they are.
    """
    from ..sources.shared import kept

    todo, out = candidates.select("id", "question", "answer"), None
    for attempt in range(most + 1):
        every = todo if out is None else out.select("id", "question", "answer").unionByName(todo)
        close = kept(near(todo, every).select("id").distinct())
        fine = todo.join(close, "id", "left_anti") if attempt < most else todo
        part = kept(fine.withColumn("refinements", F.lit(attempt)))
        out = part if out is None else out.unionByName(part)
        todo = todo.join(close, "id", "left_semi").withColumn("question", services.refine(F.col("question"), F.col("answer"), attempt + 1))
        todo = kept(todo)
        if attempt == most or not todo.limit(1).count():
            break
    return out


@dataclass
class Router:
    """The newest version of the answering cascade that is switched on."""

    versions: dict[str, Callable]
    enabled: tuple[str, ...] = ("v1",)

    def pick(self) -> str:
        for name in sorted(self.versions, reverse=True):
            if name in self.enabled or name == min(self.versions):
                return name
        raise ValueError("no version of the cascade")

    def answer(self, *args, **kwargs):
        return self.versions[self.pick()](*args, **kwargs)

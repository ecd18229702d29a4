"""Pluggable models, with deterministic defaults that need no network.

An embedder, reranker or summariser works on columns or DataFrames; any of them can
be a pandas UDF around a real model, loaded once per worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import reply_map, says_yes, sigmoid, tokens
from fathom.operators.fusion import overlap_score
from fathom.operators.vector import normalised, zero_vector

DIM = 64
#: Fixed value: what stands between a query and its made-up code, by which clients split them.
MARKER = "\n\nHypothetical code implementation:\n"


def hashed_embedding(text: Column, dim: int = DIM) -> Column:
    """Counts of the tokens' hash slots, at length one; without tokens the zero vector."""
    slots = F.transform(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    return F.transform(normalised(counts), lambda x: x.cast("float"))


def first_sentence(rows: DataFrame) -> DataFrame:
    """id and a summary: the docstring's first line, else the signature or name, with the children's names."""
    own = F.coalesce(F.nullif(F.split("docstring", "\n")[0], F.lit("")), F.col("signature"), F.col("name"))
    kids = F.when(F.size("lines") > 0, F.concat(F.lit(" ["), F.array_join(F.transform("lines", lambda x: F.split(x, ": ")[0]), ", "), F.lit("]"))).otherwise(F.lit(""))
    return rows.select("id", F.concat(own, kids).alias("summary"))


def echo(prompt: str) -> Iterator[str]:
    """Without a language model an answer is its context."""
    yield from prompt.splitlines(keepends=True)


def with_sigmoid(logit: Callable[[str, Column], Column]) -> Callable[[str, Column], Column]:
    """A scorer from one that gives logits."""
    return lambda query, document: sigmoid(logit(query, document))


def zero_on_failure(embed: Callable[[Column], Column], dim: int = DIM) -> Callable[[Column], Column]:
    """An embedder whose missing vectors (null, or of another length) are zero vectors."""

    def run(text: Column) -> Column:
        v = embed(text)
        return F.when(F.size(v) == dim, v).otherwise(zero_vector(dim))

    return run


def expander(complete: Callable[[str], Iterator[str]], decide: str, generate: str) -> Callable[[str], str]:
    """Query expansion by a language model: it decides, and where it says yes its made-up code goes behind the query.

    ``decide`` and ``generate`` are prompts with {query} in them.
    """

    def run(query: str) -> str:
        if not says_yes("".join(complete(decide.format(query=query)))):
            return query
        return f"{query}{MARKER}{''.join(complete(generate.format(query=query)))}"

    return run


def batched_summaries(complete: Callable[[str], Iterator[str]], prompt: str, batch: int = 5) -> Callable[[DataFrame], DataFrame]:
    """A summariser that asks for ``batch`` snippets at a time and takes their replies (JSON, id to text) by id.

    ``prompt`` has {snippets} in it: id, content and, where there are children with summaries, their lines
    under "Context:". Of a reply only what its own batch asked for counts, once per id; a snippet that
    it leaves out, or whose batch has no readable reply, keeps its summary by ``first_sentence``.
    """

    def shown(row) -> str:
        lines = row["lines"] if row["lines"] is not None else []
        return f"{row['id']}:\n{row['content'] or ''}" + ("\nContext:\n" + "\n".join(lines) if len(lines) else "")

    def run(rows: DataFrame) -> DataFrame:
        def ask(parts):
            import pandas as pd

            for part in parts:
                for i in range(0, len(part), batch):
                    asked = part.iloc[i : i + batch]
                    reply = "".join(complete(prompt.format(snippets="\n\n".join(shown(r) for _, r in asked.iterrows()))))
                    yield pd.DataFrame({"reply": [reply], "ids": [list(asked["id"])], "plain": [list(asked["plain"])]})

        lines = F.col("lines") if "lines" in rows.columns else F.array().cast("array<string>")
        plain = first_sentence(rows.withColumn("lines", lines)).withColumnRenamed("summary", "plain")
        told = rows.select("id", "content", lines.alias("lines")).join(plain, "id").mapInPandas(ask, "reply string, ids array<string>, plain array<string>")
        each = told.select(reply_map(F.col("reply")).alias("m"), F.explode(F.arrays_zip("ids", "plain")).alias("x"))
        return each.select(F.col("x.ids").alias("id"), F.coalesce(F.nullif(F.col("m")[F.col("x.ids")], F.lit("")), F.col("x.plain")).alias("summary"))

    return run


@dataclass
class Models:
    embed: Callable[[Column], Column] = hashed_embedding
    summarise: Callable[[DataFrame], DataFrame] = first_sentence
    score: Callable[[str, Column], Column] = overlap_score
    expand: Callable[[str], str] = lambda q: q
    complete: Callable[[str], Iterator[str]] = echo
    use_summary: bool = False

"""Flows: a small graph of named steps, each a DataFrame made from others, as one lazy plan.

A step gets its parameters and the frames of the steps it is fed by. Nothing runs until the
result is read, so independent branches are planned, pruned and run together by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.functions import text
from tarnwick.operators import ingest
from tarnwick.session import table
from tarnwick.sources import outputs

Step = Callable[[dict, list[DataFrame]], DataFrame]
#: What a model does to a batch of texts: a list of JSON records for each.
Model = Callable[[list[str], dict], list[list[dict]]]


@dataclass
class Flow:
    """Nodes by name with (kind, parameters), and edges from a node to the one it feeds."""

    nodes: dict[str, tuple[str, dict]]
    edges: list[tuple[str, str]] = field(default_factory=list)

    def order(self) -> list[str]:
        """Node names, each after those that feed it; a cycle or an edge to no node is an error."""
        if unknown := {n for e in self.edges for n in e} - set(self.nodes):
            raise ValueError(f"edges name no node: {sorted(unknown)}")
        waiting = {n: {a for a, b in self.edges if b == n} for n in self.nodes}
        done: list[str] = []
        while waiting:
            ready = [n for n, before in waiting.items() if before <= set(done)]
            if not ready:
                raise ValueError(f"a cycle among {sorted(waiting)}")
            done += ready
            waiting = {n: b for n, b in waiting.items() if n not in ready}
        return done

    def frames(self, steps: dict[str, Step]) -> dict[str, DataFrame]:
        """The frame of every node."""
        out: dict[str, DataFrame] = {}
        for name in self.order():
            kind, params = self.nodes[name]
            out[name] = steps[kind](params, [out[a] for a, b in self.edges if b == name])
        return out


def extract(docs: DataFrame, model: Model, params: dict, schema: str) -> DataFrame:
    """Records that a model finds in the text of each row, batch by batch where the rows lie; `schema` is theirs."""
    fields = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = model(batch["text"].fillna("").tolist(), params)
            rows = [[key, *(r.get(f) for f in fields)] for key, records in zip(batch["doc_id"], found, strict=True) for r in records]
            yield pd.DataFrame(rows, columns=["doc_id", *fields])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id long, {schema}")


def capitalised(texts: list[str], params: dict) -> list[list[dict]]:
    """A model without a network: runs of capitalised words are names."""
    import re

    pattern = re.compile(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+" if params.get("several") else r"\b[A-Z][a-z]{3,}")
    return [[{"name": m[0], "start": m.start()} for m in pattern.finditer(t)] for t in texts]


def steps(spark: SparkSession, sf_dir: str, model: Model = capitalised) -> dict[str, Step]:
    """The kinds of nodes. Extraction takes any model; here a deterministic one stands in."""

    def gather(params: dict, inputs: list[DataFrame]) -> DataFrame:
        return reduce(lambda a, b: a.join(b, "doc_id", "full_outer"), inputs)

    def counted(params: dict, inputs: list[DataFrame]) -> DataFrame:
        found = extract(inputs[0], model, params, "name string, start int")
        return found.groupBy("doc_id").agg(F.count("*").alias(params["into"]), F.count_distinct(text.fold_key("name")).alias(f"different_{params['into']}"))

    return {
        "table_input": lambda p, _: table(spark, sf_dir, p["table"]).select("doc_id", "text"),
        "text_input": lambda p, _: spark.createDataFrame([(0, p["text"])], "doc_id long, text string"),
        "chunker": lambda p, i: ingest.chunks(i[0], "text", target=p.get("target", 4000), overlap=p.get("overlap", 250)).select("doc_id", "chunk", F.col("chunk_text").alias("text")),
        "extract": counted,
        "measure": lambda p, i: i[0].groupBy("doc_id").agg(F.sum(text.approx_tokens("text")).alias("tokens"), F.count("*").alias("chunks")),
        "filter": lambda p, i: i[0].filter(p["where"]),
        "gather": gather,
        "output": lambda p, i: outputs.consolidated(*i, key="doc_id", transient=tuple(p.get("transient", ()))),
    }

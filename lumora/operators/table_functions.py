"""Table functions for SQL: chunks of a text for LATERAL, and a model's flat-map over a table."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from lumora.plans.judges import Field, Judge, Unanswered, parse_json


class Chunks:
    """chunks(text, size): position and chunk of pieces of so many characters; null and empty texts give none."""

    def eval(self, text: str, size: int) -> Iterator[tuple]:
        for i, at in enumerate(range(0, len(text or ""), size)):
            yield i, text[at : at + size]


def register_chunks(spark: SparkSession, name: str = "chunks") -> None:
    """SELECT ... FROM t, LATERAL chunks(t.text, 500)"""
    spark.udtf.register(name, udtf(Chunks, returnType="position bigint, chunk string", useArrow=True))


def register_flat_map(spark: SparkSession, name: str, judge: Judge, fields: list[Field], task: str) -> None:
    """SELECT ... FROM name(TABLE(SELECT key, ...)): key, the fields and error for each record that the model finds in a row.

    The table's first column is the key, as text; the others are the record that the model sees, within the judge's context. A batch of rows
    is a batch of prompts, asked again like those of sem_flat_map. A row without an answer stays once, with null fields and what went wrong. Equal rows
    are asked once in a batch.
    """
    if judge.model is None:
        raise Unanswered(f"no model for: {task}")
    head = f"{task} Answer with a JSON array of objects. Fields: " + "; ".join(f"{f.name} ({f.type}): {f.description}" for f in fields)
    answers = judge.answerer(head, parse_json)
    names = [f.name for f in fields]

    @arrow_udtf(returnType="key string, " + ", ".join(f"`{f.name}` string" for f in fields) + ", error string")
    class FlatMap:
        def eval(self, table: pa.RecordBatch) -> Iterator[pa.Table]:
            keys, *columns = [c.to_pylist() for c in table.columns]
            given = table.schema.names[1:]
            prompts = [f"{head}\n{json.dumps(dict(zip(given, row, strict=True)), ensure_ascii=False, default=str)}" for row in zip(*columns, strict=True)]
            distinct = list(dict.fromkeys(prompts))
            known = dict(zip(distinct, zip(*answers(distinct), strict=True), strict=True))
            rows: list[tuple] = []
            for key, prompt in zip(keys, prompts, strict=True):
                reply, error = known[prompt]
                key = None if key is None else str(key)
                if error:
                    rows.append((key, *[None] * len(names), error))
                    continue
                found = json.loads(reply)
                for x in found if isinstance(found, list) else [found]:
                    values = [x.get(n) if isinstance(x, dict) else None for n in names]
                    rows.append((key, *[v if v is None or isinstance(v, str) else json.dumps(v) for v in values], None))
            columns = list(zip(*rows, strict=True)) or [[] for _ in range(len(names) + 2)]
            yield pa.table({n: pa.array(list(c), pa.string()) for n, c in zip(["key", *names, "error"], columns, strict=True)})

    spark.udtf.register(name, FlatMap)

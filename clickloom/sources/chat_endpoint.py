"""A connector to a language model behind HTTP, and its offline stand-in.

Each partition opens one client. A client is any callable from prompt to answer;
``http_client`` posts to an endpoint of the common chat shape at temperature 0.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from clickloom.sources import files

Client = Callable[[str], str]


def http_client(url: str, model: str, timeout: float = 300.0) -> Callable[[], Client]:
    """A maker of clients for an endpoint that takes chat messages and answers with choices."""

    def make() -> Client:
        def ask(prompt: str) -> str:
            body = json.dumps({"model": model, "temperature": 0, "messages": [{"role": "user", "content": prompt}]}).encode()
            request = urllib.request.Request(url, data=body, headers={"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.load(answer)["choices"][0]["message"]["content"]

        return ask

    return make


def ask_model(df: DataFrame, prompt: Column, make_client: Callable[[], Client], out: str = "answer", attempts: int = 3) -> DataFrame:
    """Add the model's answer to each prompt; NULL after ``attempts`` failures."""
    from pyspark.sql import types as T

    base = df.withColumn("_prompt", prompt)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()
        for b in batches:
            answers = []
            for p in b.column(b.num_columns - 1).to_pylist():
                answer = None
                for _ in range(attempts if p is not None else 0):
                    try:
                        answer = client(p)
                        break
                    except OSError:
                        continue
                answers.append(answer)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(answers, pa.string())], names=schema.names)

    return base.mapInArrow(run, schema)


def triples_udtf(make_client: Callable[[], Client], attempts: int = 3):
    """A table function from a prompt to the triples of the model's answer, one a row.

    ``spark.udtf.register("extract", triples_udtf(...))``, then ``SELECT p.id, t.* FROM
    prompts p, LATERAL extract(p.text) t``. Fences round the answer are taken off; a
    null prompt, an answer that isn't a list of triples, and ``attempts`` failures of
    the connection give no row.
    Rows go pickled, in batches: by Arrow, every row's few triples were a table of their own.
    """

    class Extract:
        def __init__(self):
            self.client = make_client()

        def eval(self, prompt: str):
            for triple in self.parsed(self.answer(prompt)):
                parts = [triple.get(k) for k in ("head", "relation", "tail")] if isinstance(triple, dict) else [None]
                if all(isinstance(x, str) for x in parts):
                    yield tuple(parts)

        def answer(self, prompt: str | None) -> str:
            for _ in range(attempts if prompt is not None else 0):
                try:
                    return self.client(prompt)
                except OSError:
                    continue
            return ""

        @staticmethod
        def parsed(answer: str) -> list:
            bare = answer.strip().removeprefix("```json").removeprefix("```").removesuffix("```")
            try:
                found = json.loads(bare)
            except ValueError:
                return []
            return found if isinstance(found, list) else []

    return F.udtf(Extract, returnType="head string, relation string, tail string", useArrow=False)


def extract_with_retry(df: DataFrame, key: str, text: str, generate: Callable[[DataFrame, int], DataFrame], validate: Callable[[Column, Column], Column], path: str, rounds: int = 3) -> DataFrame:
    """Generate, validate, and generate anew for rows without a valid triple, ``rounds`` times at most.

    ``generate(rows, attempt)`` adds ``triples``; returns key, triples, attempt. Each
    round is written under ``path``, a folder that all executors share, before the
    next one begins: a model is asked once a row and round, and what it answered stays.
    Rounds that are there whole are read. ``ledger.extract_with_verdicts`` lets a model
    judge each triple, too, and keeps every answer.
    """
    left, done = df.select(key, text), None
    for attempt in range(1, rounds + 1):
        tried = generate(left, attempt).withColumn("triples", validate(F.col("triples"), F.col(text))).withColumn("attempt", F.lit(attempt))
        if not files.exists(df.sparkSession, f"{path}/round={attempt}/_SUCCESS"):  # a call that was cut off goes on
            tried.select(key, text, "triples", "attempt").write.mode("overwrite").parquet(f"{path}/round={attempt}")
        tried = df.sparkSession.read.schema(tried.select(key, text, "triples", "attempt").schema).parquet(f"{path}/round={attempt}")
        good = tried.where(F.size("triples") > 0) if attempt < rounds else tried
        done = good.select(key, "triples", "attempt") if done is None else done.unionByName(good.select(key, "triples", "attempt"))
        left = tried.where(F.size("triples") <= 0).select(key, text)
    return done

"""A ledger of what a model was asked and answered, and extraction in rounds of verdicts on top of it.

Each request is known by the digest of its prompt, under a label (a round, say). Before
anything is asked, requests are joined with the ledger, and equal ones become one; what
is left goes out in waves, each of which is appended when it is done. So a job that is
killed goes on with its next wave, one that runs again asks nothing, and a lost task
asks its share of one wave again, at most. A worker has a bounded number of requests
under way at once. Failures aren't written, so they are asked again next time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clickloom.functions import text as texts
from clickloom.sources import files

Client = Callable[[str], str]
_TRIPLE = "struct<head:string,relation:string,tail:string>"
_VERDICT = "valid boolean, reason string, confidence double"
#: The verdict where an answer isn't one.
NO_VERDICT = "validation parse error"


def known_answers(spark: SparkSession, path: str) -> DataFrame:
    """(digest, answer), one row a digest even where two jobs have asked the same."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], "digest string, answer string")
    return spark.read.schema("digest string, answer string").parquet(path).groupBy("digest").agg(F.min("answer").alias("answer"))


def _asked(requests: DataFrame, make_client: Callable[[], Client], at_once: int, attempts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()

        def one(prompt: str) -> str | None:
            for _ in range(attempts):
                try:
                    return client(prompt)
                except OSError:
                    continue
            return None

        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                for k in range(0, batch.num_rows, 16 * at_once):  # no more wait in the pool
                    part = batch.slice(k, 16 * at_once)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(pool.map(one, part.column(1).to_pylist())), pa.string())], names=["digest", "answer"])

    return requests.select("digest", "prompt").mapInArrow(run, "digest string, answer string").where(F.col("answer").isNotNull())


def ask_once(df: DataFrame, prompt: Column, make_client: Callable[[], Client], path: str, out: str = "answer", label: str = "all", waves: int = 1, at_once: int = 8, attempts: int = 3) -> DataFrame:
    """Add the answer to each row's prompt; equal prompts under one label are asked once, ever.

    NULL prompts have NULL answers, as have those that failed ``attempts`` times.
    ``path`` is a folder that driver and executors share. A plan must not read one label at
    two times, as Spark takes two scans of a folder for the same.
    """
    spark, path = df.sparkSession, f"{path}/label={label}"
    named = df.withColumn("_prompt", prompt).withColumn("_digest", F.when(F.col("_prompt").isNotNull(), F.sha2("_prompt", 256)))
    requests = named.where(F.col("_digest").isNotNull()).groupBy(F.col("_digest").alias("digest")).agg(F.min("_prompt").alias("prompt"))
    for wave in range(waves):
        todo = requests.where(F.pmod(F.xxhash64("digest"), F.lit(waves)) == wave).join(known_answers(spark, path), "digest", "left_anti")
        _asked(todo, make_client, at_once, attempts).write.mode("append").parquet(path)
    answers = known_answers(spark, path).select(F.col("digest").alias("_digest"), F.col("answer").alias(out))
    return named.join(answers, "_digest", "left").drop("_digest", "_prompt")


def generation_prompt(source: Column, attempt: int) -> Column:
    """A plain request for triples; the attempt is told, so that another answer is asked for."""
    return F.concat(F.lit(f"List the facts of the text as a JSON array of objects with head, relation and tail. Attempt {attempt}.\nText: "), source)


def verdict_prompt(source: Column, triple: Column) -> Column:
    """A plain request for a verdict on one triple."""
    told = F.concat_ws(", ", triple["head"], triple["relation"], triple["tail"])
    return F.concat(F.lit('Does the text state this triple? Answer with a JSON object {"valid": true or false, "reason": text, "confidence": 0 to 1}.\nText: '), source, F.lit("\nTriple: "), told)


def parse_verdict(answer: Column) -> Column:
    """valid, reason and confidence of an answer, fences taken off; what isn't a verdict counts as a refusal."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(answer), r"(?i)^```(json)?\s*", ""), r"\s*```$", "")
    refused = F.struct(F.lit(False).alias("valid"), F.lit(NO_VERDICT).alias("reason"), F.lit(0.0).alias("confidence"))
    return texts.bound(F.from_json(bare, _VERDICT), lambda v: F.when(v["valid"].isNull(), refused).otherwise(v))


def extract_with_verdicts(
    df: DataFrame, key: str, source: str, make_client: Callable[[], Client], path: str, rounds: int = 3, forbidden: Sequence[str] = (), generate: Callable[[Column, int], Column] = generation_prompt, judge: Callable[[Column, Column], Column] = verdict_prompt, **asking
) -> DataFrame:
    """Triples of each text that a model states and then confirms; texts without one are asked anew.

    Returns key, ``triples`` (confirmed ones, in the order told), ``attempts`` made, and
    over all attempts ``n_candidates``, ``n_valid`` and ``n_invalid``. Keys are unique.
    ``path`` holds the ledger and the rounds; a second call goes on from there.
    ``asking`` are options of ``ask_once``. NULL texts have no triples, after one attempt.
    """
    spark = df.sparkSession
    left = df.select(F.col(key).alias("_key"), F.col(source).alias("_text")).withColumns({n: F.lit(0).cast("long") for n in ("n_candidates", "n_valid", "n_invalid")})
    done = None
    for attempt in range(1, rounds + 1):
        told = ask_once(left, generate(F.col("_text"), attempt), make_client, f"{path}/ledger", label=f"stated-{attempt}", **asking)
        found = F.filter(texts.parse_triples(F.coalesce("answer", F.lit("[]"))), lambda t: t.isNotNull() & ~F.coalesce(t["relation"].isin(*forbidden), F.lit(False)) if forbidden else t.isNotNull())
        told = told.withColumn("_found", found).drop("answer")
        each = told.select("_key", "_text", F.posexplode("_found").alias("_at", "_t"))
        judged = ask_once(each, judge(F.col("_text"), F.col("_t")), make_client, f"{path}/ledger", label=f"judged-{attempt}", **asking).withColumn("_v", parse_verdict(F.coalesce("answer", F.lit(""))))
        kept = judged.groupBy("_key").agg(
            F.transform(F.array_sort(F.collect_list(F.when(F.col("_v.valid"), F.struct("_at", "_t")))), lambda x: x["_t"]).alias("triples"),
            F.count(F.lit(1)).alias("_n"),
            F.count_if("_v.valid").alias("_good"),
        )
        none = F.expr(f"cast(array() as array<{_TRIPLE}>)")
        after = told.select("_key", "_text", "n_candidates", "n_valid", "n_invalid").join(kept, "_key", "left")
        counts = {"n_candidates": F.col("_n"), "n_valid": F.col("_good"), "n_invalid": F.col("_n") - F.col("_good")}
        after = after.withColumns({n: F.col(n) + F.coalesce(c, F.lit(0)) for n, c in counts.items()}).withColumns({"triples": F.coalesce("triples", none), "attempts": F.lit(attempt)}).drop("_n", "_good")
        after.write.mode("overwrite").parquet(f"{path}/round={attempt}")  # cuts the lineage; answers stay in the ledger
        after = spark.read.schema(after.schema).parquet(f"{path}/round={attempt}")
        ends = (F.size("triples") > 0) | F.col("_text").isNull() | F.lit(attempt == rounds)
        part = after.where(ends).drop("_text")
        done = part if done is None else done.unionByName(part)
        left = after.where(~ends).drop("triples", "attempts")
    return done.select(F.col("_key").alias(key), "triples", "attempts", "n_candidates", "n_valid", "n_invalid")


def scripted(answers: Callable[[str], str]) -> Callable[[], Client]:
    """A maker of clients that answer by a function: a stand-in for a model."""
    return lambda: answers


def fenced(value) -> str:
    """JSON as models like to send it."""
    return f"```json\n{json.dumps(value)}\n```"

"""The request ledger and verdict rounds, subword ids and masks, and epochs by permutation."""

import json
import re
import threading
import time

import pytest
from pyspark.sql import functions as F

from clickloom.models import tokenise
from clickloom.operators import epochs
from clickloom.sources import ledger

LOG = "asked.log"


def logging_client(folder, answer):
    """Clients that note each prompt they are asked in a file of their own."""

    def make():
        lock = threading.Lock()

        def ask(prompt):
            with lock, open(f"{folder}/{LOG}", "a") as f:
                f.write(json.dumps(prompt) + "\n")
            return answer(prompt)

        return ask

    return make


def asked(folder):
    try:
        return sorted(json.loads(line) for line in open(f"{folder}/{LOG}"))
    except FileNotFoundError:
        return []


@pytest.mark.parametrize("waves", [1, 3])
def test_equal_prompts_are_asked_once_ever(spark, tmp_path, waves):
    rows = [(k, None if k == 7 else f"p{k % 5}") for k in range(20)] + [(99, "")]
    df = spark.createDataFrame(rows, "id long, prompt string").repartition(3)
    client = logging_client(tmp_path, str.upper)
    for _ in range(2):
        got = {r["id"]: r["answer"] for r in ledger.ask_once(df, F.col("prompt"), client, f"{tmp_path}/ledger", waves=waves).collect()}
        assert got == {i: None if p is None else p.upper() for i, p in rows}
    assert asked(tmp_path) == ["", "p0", "p1", "p2", "p3", "p4"]
    more = spark.createDataFrame([(1, "p1"), (2, "new")], "id long, prompt string")
    assert ledger.ask_once(more, F.col("prompt"), client, f"{tmp_path}/ledger", waves=waves).count() == 2
    assert asked(tmp_path)[1] == "new" and len(asked(tmp_path)) == 7


def test_a_cut_off_job_goes_on_with_what_is_left(spark, tmp_path):
    df = spark.createDataFrame([(k, f"p{k}") for k in range(40)], "id long, prompt string").coalesce(1)

    def dies(prompt):
        if (tmp_path / "broken").exists() and prompt == "p13":
            raise RuntimeError("killed")
        return prompt

    (tmp_path / "broken").touch()
    with pytest.raises(Exception, match="killed"):
        ledger.ask_once(df, F.col("prompt"), logging_client(tmp_path, dies), f"{tmp_path}/ledger", waves=4, at_once=1)
    done = {r["answer"] for r in ledger.known_answers(spark, f"{tmp_path}/ledger/label=all").collect()}
    (tmp_path / "broken").unlink()
    (tmp_path / LOG).unlink()
    got = ledger.ask_once(df, F.col("prompt"), logging_client(tmp_path, dies), f"{tmp_path}/ledger", waves=4)
    assert sorted(r["answer"] for r in got.collect()) == sorted(f"p{k}" for k in range(40))
    assert not set(asked(tmp_path)) & done and len(asked(tmp_path)) + len(done) == 40


def test_failures_are_asked_again_next_time(spark, tmp_path):
    def fails(prompt):
        if not (tmp_path / "up").exists():
            raise OSError("down")
        return "ok"

    df = spark.createDataFrame([(1, "p")], "id long, prompt string")
    ask = lambda: ledger.ask_once(df, F.col("prompt"), logging_client(tmp_path, fails), f"{tmp_path}/ledger", attempts=2).first()["answer"]
    assert ask() is None and len(asked(tmp_path)) == 2
    (tmp_path / "up").touch()
    assert ask() == "ok" and ask() == "ok" and len(asked(tmp_path)) == 3


def test_a_worker_has_few_requests_under_way(spark, tmp_path):
    def make():
        now, most, lock = [0], [0], threading.Lock()

        def slow(prompt):
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
            time.sleep(0.01)
            with lock:
                now[0] -= 1
            return str(most[0])

        return slow

    df = spark.range(60).select(F.concat(F.lit("p"), "id").alias("prompt")).coalesce(1)
    got = ledger.ask_once(df, F.col("prompt"), make, f"{tmp_path}/ledger", at_once=3).collect()
    assert max(int(r["answer"]) for r in got) <= 3


@pytest.mark.parametrize("answer, valid", [('{"valid": true, "reason": "r", "confidence": 0.5}', True), ('```json\n{"valid": false, "reason": "r", "confidence": 1}\n```', False), ("yes", None), ("", None), (None, None), ('{"reason": "r"}', None)])
def test_verdicts(spark, answer, valid):
    v = spark.createDataFrame([(answer,)], "a string").select(ledger.parse_verdict(F.col("a")).alias("v")).first()["v"]
    assert v["valid"] is bool(valid) and (v["reason"] == ledger.NO_VERDICT) is (valid is None)


def test_triples_in_rounds_of_verdicts(spark, tmp_path):
    """Text b is stated wrongly at first, c never rightly, d not at all, e is NULL."""

    def model(prompt):
        text = re.search("Text: (.*)", prompt)[1]
        if "Triple:" in prompt:
            return ledger.fenced({"valid": "wrong" not in prompt, "reason": "", "confidence": 1})
        first = "Attempt 1" in prompt
        told = [{"head": text, "relation": "is", "tail": "wrong" if text == "c" or (text == "b" and first) else "right"}, {"head": text, "relation": "hidden", "tail": "right"}]
        return "none" if text == "d" else ledger.fenced(told)

    df = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "c"), ("d", "d"), ("e", None)], "id string, q string")
    for _ in range(2):
        got = {r["id"]: (r["attempts"], r["n_candidates"], r["n_valid"], r["n_invalid"], [t["tail"] for t in r["triples"]]) for r in ledger.extract_with_verdicts(df, "id", "q", logging_client(tmp_path, model), f"{tmp_path}/run", forbidden=("hidden",)).collect()}
        assert got == {"a": (1, 1, 1, 0, ["right"]), "b": (2, 2, 1, 1, ["right"]), "c": (3, 3, 0, 3, []), "d": (3, 0, 0, 0, []), "e": (1, 0, 0, 0, [])}
    prompts = asked(tmp_path)
    assert len([p for p in prompts if "Triple:" not in p]) == 4 + 3 + 2  # the second call asked nothing


# tokens


def test_longest_pieces_from_the_left():
    cut = tokenise.Cutter({"un": 2, "unb": 3, "able</w>": 4, "break": 5, "a": 6, "b</w>": 7, "c": 8, "c</w>": 9}, unknown=1)
    assert cut.word("unbreakable") == [1]  # unb, then nothing for 'r'
    assert cut.word("unbreakable"[2:]) == [5, 4] and cut.word("ab") == [6, 7] and cut.word("cc") == [8, 9] and cut.word("ba") == [1]
    assert cut.text("AB cc  zz!", 3) == ([6, 7, 8], 6)


def test_ids_masks_and_padding(spark):
    vocabulary = {"<pad>": 0, "<unk>": 1, "a": 2, "a</w>": 3, "bb</w>": 4}
    df = spark.createDataFrame([(1, "a bb aa"), (2, None), (3, ""), (4, "a " * 500), (5, "zz a")], "sample_id long, text string")
    got = {r["sample_id"]: (r["ids"], r["mask"], r["n_tokens"]) for r in tokenise.tokenise(df, vocabulary, width=6, unknown=1).collect()}
    assert got == {1: ([3, 4, 2, 3, 0, 0], [1, 1, 1, 1, 0, 0], 4), 2: ([0] * 6, [0] * 6, 0), 3: ([0] * 6, [0] * 6, 0), 4: ([3] * 6, [1] * 6, 500), 5: ([1, 3, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0], 2)}


def test_masks_feed_the_pooling(spark):
    from clickloom.functions import vectors

    df = spark.createDataFrame([(1, "a bb"), (2, "")], "sample_id long, text string")
    rows = tokenise.tokenise(df, {"a</w>": 2, "bb</w>": 4}, width=5).withColumn("hidden", F.transform("ids", lambda i: F.array(i.cast("double"), i.cast("double") * 10)))
    got = {r["sample_id"]: r["v"] for r in rows.select("sample_id", vectors.masked_mean(F.col("hidden"), F.col("mask"), 2).alias("v")).collect()}
    assert got[1] == pytest.approx([3.0, 30.0])


def test_a_real_vocabulary():
    public = pytest.importorskip("public_tokenizers")
    vocabulary = tokenise.read_vocabulary(public.path("word_bpe_49k.json"))
    cut = tokenise.Cutter(vocabulary, unknown=0)
    back = {i: p for p, i in vocabulary.items()}
    ids, n = cut.text("The unbelievable quickness of Xylophonists, 42!", 50)
    assert n == len(ids) and "".join(back[i] for i in ids).replace("</w>", " ").strip() == "the unbelievable quickness of xylophonists , 42 !".replace("42", " ".join(re.findall("42|4 2", "".join(back[i] for i in ids).replace("</w>", " "))) or "42")


# epochs


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000])
@pytest.mark.parametrize("key", ["a", "42|3"])
def test_a_permutation_is_one(n, key):
    images = [epochs.permuted(k, n, key) for k in range(n)]
    assert sorted(images) == list(range(n))
    assert n < 16 or images != list(range(n))


def test_epochs_differ_and_cover_all_rows(spark, tmp_path):
    df = spark.range(1000).withColumn("v", F.col("id") * 2).repartition(7)
    n = epochs.write_chunks(df, ["id"], f"{tmp_path}/chunks", chunk_rows=64)
    assert n == 16
    orders = []
    for epoch in range(2):
        rows = []
        for b in range(6):
            rows += [r["id"] for r in epochs.batch(spark, f"{tmp_path}/chunks", ["id"], epoch, b, n, chunks_a_batch=3).collect()]
        assert sorted(rows) == list(range(1000))
        orders.append(rows)
    assert orders[0] != orders[1]
    again = [r["id"] for r in epochs.batch(spark, f"{tmp_path}/chunks", ["id"], 1, 0, n, chunks_a_batch=3).collect()]
    assert again == orders[1][: len(again)]


def test_a_batch_reads_its_chunks_and_shuffles_nothing(spark, tmp_path):
    n = epochs.write_chunks(spark.range(300), ["id"], f"{tmp_path}/chunks", chunk_rows=50)
    df = epochs.batch(spark, f"{tmp_path}/chunks", ["id"], 4, 1, n, chunks_a_batch=2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    assert {r["chunk"] for r in df.select("chunk").distinct().collect()} == set(epochs.chunks_of(4, 2, 4, n))
    assert epochs.batch(spark, f"{tmp_path}/chunks", ["id"], 4, 99, n).count() == 0


def test_the_deal_does_not_depend_on_partitions(spark, tmp_path):
    rows = [(k, None if k % 7 == 0 else f"s{k}") for k in range(200)]
    seen = []
    for parts in (1, 5):
        epochs.write_chunks(spark.createDataFrame(rows, "id long, s string").repartition(parts), ["id"], f"{tmp_path}/{parts}", chunk_rows=30)
        seen.append(sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{parts}").select("id", "s", "chunk").collect()), key=repr))
    assert seen[0] == seen[1] and len({c for _, _, c in seen[0]}) == 7
    assert epochs.write_chunks(spark.createDataFrame([], "id long, s string"), ["id"], f"{tmp_path}/none") == 0


def test_the_graph_stage_by_a_model(spark, tmp_path):
    from clickloom.plans import stages

    def model(prompt):
        if "Triple:" in prompt:
            return ledger.fenced({"valid": "has_brand" in prompt or "click" in prompt, "reason": "", "confidence": 1})
        told = [("user_1", "click_history_id", "product_2"), ("product_7", "has_brand", "Acme"), ("product_7", "has_price", "$1")]
        return ledger.fenced([dict(zip(("head", "relation", "tail"), t, strict=True)) for t in told])

    rows = spark.createDataFrame([(1, "d"), (2, "d")], "sample_id long, Domain string")
    prompts = spark.createDataFrame([(1, "user_1 saw product_2 title: Two ."), (2, "other")], "sample_id long, text string")
    for split, want in (("train", {"click_history_id", "has_brand", "belongs_to_scenario"}), ("test", {"has_brand"})):
        got = {r["sample_id"]: {t["relation"] for t in r["triples"]} for r in stages.model_graph_stage(rows, prompts, split, ledger.scripted(model), f"{tmp_path}/{split}").collect()}
        assert got[2] == want and got[1] == want | ({"has_title"} if split == "train" else set())

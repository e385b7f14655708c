"""The commands over all domains, dropout, and checkpoints that training goes on from."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.models import layers, run
from clickloom.models.autodiff import Var
from clickloom.plans import commands

DOMAINS = ("All_Beauty", "Gift_Cards")


def test_commands_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(5)
    for d in DOMAINS:
        for kind in ("reviews", "meta"):
            (tmp_path / "raw" / d / kind).mkdir(parents=True)
        reviews = [{"reviewerID": f"u{k % 5}", "asin": f"A{k % 7}", "reviewerName": f"N{k % 5}", "overall": float(rng.choice([1, 5])), "unixReviewTime": 86400 * k} for k in range(40)]
        (tmp_path / "raw" / d / "reviews" / "a.json").write_text("\n".join(map(json.dumps, reviews)))
        meta = [{"asin": f"A{k}", "title": f"Thing {k}", "brand": "B", "price": f"${k}.50"} for k in range(7)]
        (tmp_path / "raw" / d / "meta" / "a.json").write_text("\n".join(map(json.dumps, meta)))
    small = ["--domains", *DOMAINS, "--graph_epochs", "1", "--epochs", "2", "--steps", "1", "--accumulate", "1", "--hidden", "8", "--heads", "2", "--rate", "0.01"]
    commands.main(["all", "--root", str(tmp_path), *small], spark)
    at = commands.Layout(spark, str(tmp_path))
    for d in DOMAINS:
        sizes = [at.read("splits", d, s).count() for s in ("train", "valid", "test")]
        assert sizes == [32, 4, 4]
        assert [at.read("graph_vectors", d, s).count() for s in ("train", "valid", "test")] == sizes
        assert "user_hist_id" not in at.read("splits", d, "test").columns
        assert at.read("triples", d, "test").select(F.explode("triples.relation").alias("r")).where("r = 'click_history_id'").count() == 0
    results = at.read("results").collect()
    assert sorted(r["domain"] for r in results) == sorted(DOMAINS)
    assert all(r["epochs_trained"] == 2 and r["train_samples"] == 32 and 0 <= r["test_auc"] <= 1 and r["test_loss"] > 0 for r in results)
    # a second run of a stage keeps what is there, a run of training appends its rows and goes on from the last epoch
    before = at.read("prompts", DOMAINS[0], "train").inputFiles()
    commands.main(["prompt", "--root", str(tmp_path), *small], spark)
    assert at.read("prompts", DOMAINS[0], "train").inputFiles() == before
    with pytest.raises(ValueError, match="unknown provider"):
        commands.provider("none")
    with pytest.raises(ValueError, match="divisible"):
        commands.main(["train", "--root", str(tmp_path), "--heads", "3"], spark)


def test_dropout():
    model = layers.ctr_model(3, 4, fusion="cross_attention_gated", fusion_options={"hidden": 8, "heads": 2}, head_options={"activation": "swish"})
    p = {k: Var(v) for k, v in model.shapes.draw(1).items()}
    a, b = np.ones((6, 3)), np.ones((6, 4))
    plain = model.forward(p, a, b).value
    assert np.ptp(plain) < 1e-9
    with layers.dropping(0.5, 7):
        one = model.forward(p, a, b).value
    with layers.dropping(0.5, 7):
        again = model.forward(p, a, b).value
    assert np.array_equal(one, again) and np.ptp(one) > 0
    assert np.array_equal(model.forward(p, a, b).value, plain)
    with layers.dropping(0.25, 1):
        kept = layers.dropped(Var(np.ones(40_000))).value
    assert set(np.unique(kept)) == {0.0, 1 / 0.75} and abs(kept.mean() - 1) < 0.02
    with pytest.raises(ValueError, match="dropout rate"), layers.dropping(1.0, 1):
        pass
    with pytest.raises(ValueError, match="unknown activation"):
        layers.mlp_head(4, activation="tanh")


def test_training_goes_on_from_a_checkpoint(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, v[:3].tolist(), v[3:].tolist(), int(v[0] + v[4] > 0)) for i, v in enumerate(rng.normal(size=(60, 6)))]
    df = spark.createDataFrame(rows, "sample_id long, kg_vec array<double>, text_vec array<double>, label int").coalesce(1).cache()
    model = layers.ctr_model(3, 3, fusion="concat", fusion_options={"hidden": 8}, head_options={"hidden": (4,)})

    def train(epochs, folder):
        return run.train(df, model, epochs=epochs, optimiser=run.Optimiser(rate=0.03), dropout=0.2, checkpoint=str(tmp_path / folder))

    whole, log = train(4, "whole")
    train(2, "parts")
    parts, later = train(4, "parts")
    assert later == log and all(np.array_equal(whole[k], parts[k]) for k in whole)
    assert train(4, "parts")[1] == log
    got = run.evaluate(df, model, whole)
    assert got["auc"] == max(x["auc"] for x in log) and got["loss"] > 0

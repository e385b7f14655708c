"""The stages as commands over all domains: ``python -m clickloom.plans.commands STAGE --root FOLDER``.

Every stage reads what the one before wrote under the root, a folder that driver
and executors share, and writes a table for each domain (and split). A table that is
there whole is kept unless ``--rebuild`` is given; raw and earlier tables are never
written over, so the cleaning stage leaves its input as the backup. The driver loops
over domains and splits, of which there are a handful, and never over rows.
"""

from __future__ import annotations

import argparse
import importlib
import time
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickloom.functions import markup
from clickloom.models import embed, layers, run
from clickloom.operators import clean, graph, split
from clickloom.plans import config, stages
from clickloom.sources import chat_endpoint, dictionaries, files, lines

#: Providers by name; another one is named as ``module:maker``.
PROVIDERS: dict[str, Callable[[], embed.Provider]] = {"hashed": embed.hashed_provider(64)}


@dataclass(frozen=True)
class Layout:
    """Where the tables are, which domains there are, and whether tables are made anew."""

    spark: SparkSession
    root: str
    data: config.DataSettings = config.DataSettings()
    rebuild: bool = False

    def path(self, kind: str, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), kind, *parts])

    def read(self, kind: str, *parts: str) -> DataFrame:
        return self.spark.read.parquet(self.path(kind, *parts))

    def write(self, make: Callable[[], DataFrame], kind: str, *parts: str) -> DataFrame:
        """The table at a path, made if it isn't there whole; an empty one is an error."""
        path = self.path(kind, *parts)
        if self.rebuild or not files.exists(self.spark, f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return files.verify_written(self.spark.read.parquet(path))

    def each(self) -> list[tuple[str, str]]:
        return [(d, s) for d in self.data.domains for s in self.data.splits]


def provider(name: str) -> Callable[[], embed.Provider]:
    if name in PROVIDERS:
        return PROVIDERS[name]
    module, _, maker = name.partition(":")
    if not maker:
        raise ValueError(f"unknown provider {name}; one of {', '.join(PROVIDERS)}, or module:maker")
    return getattr(importlib.import_module(module), maker)


def process(at: Layout, limit: int | None = None, compat: bool = False) -> None:
    """Raw JSON lines of all domains to processed tables, with one dictionary of users and one of items for all.

    ``raw/DOMAIN/reviews`` and ``raw/DOMAIN/meta`` are files or folders. ``limit`` takes the
    first lines of each, for trials.
    """
    raw = {}
    for d in at.data.domains:
        for kind, schema in (("reviews", files.REVIEW_SCHEMA), ("meta", files.META_SCHEMA)):

            def numbered(d=d, kind=kind, schema=schema) -> DataFrame:
                return lines.numbered_json(at.spark, at.path("raw", d, kind), schema, limit, place="src_idx")

            raw[d, kind] = at.write(numbered, "numbered", d, kind)

    def together(kind: str, *columns: str) -> DataFrame:
        first, *rest = [raw[d, kind].select(*columns) for d in at.data.domains]
        for r in rest:
            first = first.unionByName(r)
        return first

    users, items = stages.dictionaries(together("reviews", "reviewerID", "asin"), together("meta", "asin"))
    users = dictionaries.load_or_build(at.spark, at.path("dictionaries", "users"), lambda: users, at.rebuild)
    items = dictionaries.load_or_build(at.spark, at.path("dictionaries", "items"), lambda: items, at.rebuild)
    for n, d in enumerate(at.data.domains):
        at.write(lambda n=n, d=d: stages.process(raw[d, "reviews"], raw[d, "meta"], users, items, d, n, at.data.history, compat), "processed", d)


def clean_all(at: Layout, compat: bool = False) -> None:
    for d in at.data.domains:
        at.write(lambda d=d: clean.clean_table(at.read("processed", d), compat, markup.visible_of_escaped), "cleaned", d)


def split_all(at: Layout) -> None:
    """Splits by time of the cleaned tables, or of the processed ones where nothing was cleaned."""
    for d in at.data.domains:
        kind = "cleaned" if files.exists(at.spark, at.path("cleaned", d)) else "processed"
        divided = split.require_splits(stages.split_stage(at.read(kind, d)))
        for s in at.data.splits:
            at.write(lambda s=s, divided=divided: split.split_columns(divided, s), "splits", d, s)


def prompt_all(at: Layout) -> None:
    for d, s in at.each():
        at.write(lambda d=d, s=s: stages.prompt_stage(at.read("splits", d, s)), "prompts", d, s)


def embed_all(at: Layout, models: Sequence[str] = ("hashed",)) -> None:
    """Vectors of all prompts by every model."""
    for m in models:
        make = provider(m)
        for d, s in at.each():
            at.write(lambda d=d, s=s, m=m, make=make: embed.embed_texts(at.read("prompts", d, s), make, model=m), "vectors", m, d, s)


def triples_all(at: Layout, limit: int | None = None, make_client: Callable | None = None, rounds: int = 3) -> DataFrame:
    """Triples of all samples; returns the counts of chunks and triples by domain and split.

    With a client a model states and confirms them, in ``rounds`` at most; without one the rule extractor does.
    """
    told = None
    for d, s in at.each():

        def make(d=d, s=s) -> DataFrame:
            rows = at.read("splits", d, s)
            rows, prompts = rows.orderBy("sample_id").limit(limit) if limit else rows, at.read("prompts", d, s)
            if make_client is None:
                return stages.graph_stage(rows, prompts, s)
            return stages.model_graph_stage(rows, prompts.join(rows.select("sample_id"), "sample_id", "left_semi"), s, make_client, at.path("asked", d, s), rounds)

        part = at.write(make, "triples", d, s).withColumns({"domain": F.lit(d), "split": F.lit(s)})
        told = part if told is None else told.unionByName(part)
    return graph.chunk_stats(told, ["domain", "split"])


def graph_all(at: Layout, model: str = "hashed", epochs: int = 10) -> None:
    """Vectors of all graphs, by a graph model that each domain's train split has taught."""
    for d in at.data.domains:

        def features(s: str, d=d) -> DataFrame:
            texts = at.read("vectors", model, d, s)
            narrow = embed.project(texts.select("sample_id", F.col("vec").alias("_v")), len(texts.first()["vec"]), 32, "_v")
            rows = at.read("triples", d, s).join(narrow, "sample_id").join(at.read("splits", d, s).select("sample_id", "asin"), "sample_id")
            return graph.features_in_rows(rows, F.concat(F.lit("product_"), F.col("asin").cast("string")), F.col("_v"))

        for s in at.data.splits:
            at.write(lambda s=s: features(s), "graph_features", d, s)
        kept = at.path("graph_models", d)
        if at.rebuild or not files.exists(at.spark, f"{kept}/_SUCCESS"):
            params, _ = run.train_graph_model(at.read("graph_features", d, "train"), graph.edges(at.read("triples", d, "train")), at.read("splits", d, "train").select("sample_id", "label"), epochs)
            run.save(at.spark, params, kept)
        params = run.load(at.spark, kept)
        for s in at.data.splits:
            at.write(lambda s=s: run.graph_vectors(at.read("graph_features", d, s), graph.edges(at.read("triples", d, s)), params), "graph_vectors", d, s)


def inputs(at: Layout, text_model: str, domain: str, name: str) -> DataFrame:
    """(sample_id, label, kg_vec, text_vec) of a split; a sample without either vector is an error."""
    rows = at.read("splits", domain, name).select("sample_id", "label")
    for column, table in (("kg_vec", at.read("graph_vectors", domain, name)), ("text_vec", at.read("vectors", text_model, domain, name))):
        rows = rows.join(table.select("sample_id", F.col("vec").alias(column)), "sample_id", "left")
        rows = rows.withColumn(column, F.coalesce(column, F.raise_error(F.concat(F.lit(f"no {column} of sample "), F.col("sample_id").cast("string"))).cast("array<float>")))
    return rows


def train_all(at: Layout, model: config.ModelSettings, learn: config.TrainSettings, text_model: str = "hashed", batch_size: int | None = None, steps: int = 8, accumulate: int = 2, options: dict | None = None) -> DataFrame:
    """Train, validate and test on each domain; a row of results each is appended to ``results`` and returned.

    Each epoch is a checkpoint, from which a run that was cut short goes on. An epoch
    has ``steps`` gradients, or as many as ``batch_size`` makes of the rows.
    """
    config.validate(model, learn)
    rows = []
    for d in at.data.domains:
        sets = {s: inputs(at, text_model, d, s) for s in ("train", "valid", "test")}
        data = sets["train"].persist()
        n, ratio = data.agg(F.count(F.lit(1)), F.avg("label")).first()
        first = data.first()
        heads = {} if model.fusion == "concat" else {"heads": model.heads}
        net = layers.ctr_model(len(first["kg_vec"]), len(first["text_vec"]), model.mode, model.fusion, model.head, fusion_options={"hidden": model.hidden, **heads}, head_options=(options or {}).get("head"))
        name = f"{model.mode}-{model.fusion}-{model.head}-{text_model}-{learn.seed}".replace(":", ".")
        saved = at.path("checkpoints", d, f"{name}-{int(time.time())}" if at.rebuild else name)
        batches = max(1, -(-n // batch_size)) if batch_size else steps
        best, log = run.train(data, net, sets["valid"], learn.epochs, batches, accumulate, learn.loss, run.Optimiser(learn.optimiser, learn.rate, learn.decay, clip=learn.clip), learn.scheduler, learn.patience, learn.tolerance, learn.seed, dropout=learn.dropout, checkpoint=saved)
        data.unpersist()
        model_path = at.path("models", d, name)
        run.save(at.spark, best, model_path)
        test = run.evaluate(sets["test"], net, best, learn.loss)
        told = {f"model_{k}": str(v) for k, v in asdict(model).items()} | {f"train_{k}": str(v) for k, v in asdict(learn).items()}
        rows.append((time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime()), d, text_model, max(x["auc"] for x in log), test["loss"], test["auc"], len(log), n, float(ratio), batches, accumulate, model_path, told))
    got = at.spark.createDataFrame(rows, "finished string, domain string, text_model string, best_valid_auc double, test_loss double, test_auc double, epochs_trained int, train_samples long, positive_ratio double, steps int, accumulate int, model_path string, settings map<string,string>")
    files.append_results(got, at.path("results"))
    return got


def _settings(parser: argparse.ArgumentParser, kind: type) -> None:
    for name, value in asdict(kind()).items():
        parser.add_argument(f"--{name}", type=type(value), default=value)


def parse(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("stage", choices=("process", "clean", "split", "prompt", "embed", "triples", "graph", "train", "all"))
    parser.add_argument("--root", required=True, help="the folder of all tables, shared by driver and executors")
    parser.add_argument("--domains", nargs="+", default=config.DataSettings().domains)
    parser.add_argument("--rebuild", action="store_true", help="make tables anew that are there")
    parser.add_argument("--compat", action="store_true", help="results of the replaced pipeline where they differ")
    parser.add_argument("--limit", type=int, help="first rows of each source or split only, for trials of process and triples")
    parser.add_argument("--history", type=int, default=config.DataSettings().history)
    parser.add_argument("--models", nargs="+", default=["hashed"], help="text providers; training takes the first")
    parser.add_argument("--graph_epochs", type=int, default=10)
    parser.add_argument("--endpoint", help="chat endpoint of the model that states and confirms triples; without it a rule does")
    parser.add_argument("--endpoint_model", default="default")
    parser.add_argument("--rounds", type=int, default=3, help="attempts at the triples of a text")
    parser.add_argument("--batch_size", type=int, help="rows of a step; without it an epoch has --steps steps")
    parser.add_argument("--steps", type=int, default=8)
    parser.add_argument("--accumulate", type=int, default=2)
    _settings(parser, config.ModelSettings)
    _settings(parser, config.TrainSettings)
    return parser.parse_args(argv)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    asked = parse(argv)
    model, learn = (kind(**{k: getattr(asked, k) for k in asdict(kind())}) for kind in (config.ModelSettings, config.TrainSettings))
    config.validate(model, learn)
    spark = spark or SparkSession.builder.appName(f"clickloom {asked.stage}").getOrCreate()
    data = replace(config.DataSettings(), domains=tuple(asked.domains), history=asked.history)
    at = Layout(spark, asked.root, data, asked.rebuild)
    todo = {
        "process": lambda: process(at, asked.limit, asked.compat),
        "clean": lambda: clean_all(at, asked.compat),
        "split": lambda: split_all(at),
        "prompt": lambda: prompt_all(at),
        "embed": lambda: embed_all(at, asked.models),
        "triples": lambda: triples_all(at, asked.limit, chat_endpoint.http_client(asked.endpoint, asked.endpoint_model) if asked.endpoint else None, asked.rounds).show(100, False),
        "graph": lambda: graph_all(at, asked.models[0], asked.graph_epochs),
        "train": lambda: train_all(at, model, learn, asked.models[0], asked.batch_size, asked.steps, asked.accumulate).show(100, False),
    }
    for name in todo if asked.stage == "all" else (asked.stage,):
        todo[name]()


if __name__ == "__main__":
    main()

"""The corpus pipeline against brute force, stage by stage and as a whole."""

import hashlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from clickloom.llm import bpe, quality, secrets
from test_jaccard_join import brute
from test_operators_llm import brute_base, brute_hits

SF = "/root/testdata/sf0.001"


def masked(text, spans):
    """The text with base spans masked, overlapping ones together."""
    out, at = [], 0
    for start, end in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def test_pipeline_equals_brute_force(spark):
    import tiktoken

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, model).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if scores[r["doc_id"]] >= 0.5]
    groups = {d: c for d, n, c in brute(rows)}
    rows = [(d, t) for d, t in rows if groups[d] == d]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {r[0] for r in brute_hits(rows, items) if r[5]}
    rows = [(d, t) for d, t in rows if d not in hit]
    owned = {r["doc_id"]: r["spans"] for r in secrets.secret_report(secrets.scan_secrets(docs.where(docs.doc_id.isin([d for d, _ in rows])))).collect()}
    for d, t in rows:
        assert set(filter(None, brute_base(t).split(","))) <= set(owned[d].split(","))
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    want = {}
    for d, t in rows:
        clean = masked(t, owned[d])
        ids = np.array(other.encode_ordinary(clean), dtype="<u4")
        want[d] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(clean.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < docs.count()


def test_stages_keep_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (None, None, None, None, None), (2, "", "en", "s", 0), (3, "password=hunter2hunter2 " + "x " * 50, "en", "s", 124)], "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, SF)
            assert out.columns == docs.columns
            got = out.collect()
            assert len(got) <= rows.count()
            if k == 1 and rows is docs:
                assert sorted((r["doc_id"], r["text"]) for r in got if r["doc_id"]) == [(1, docs.first()["text"]), (2, ""), (3, "password=hunter2hunter2 " + "x " * 50)]
            if k == 3 and rows is docs:
                assert {r["text"][:9] for r in got if r["doc_id"] == 3} == {"[SECRET] "}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == docs.count()


def test_stages_with_clashing_columns_and_long_texts(spark):
    names = ["node", "group", "_id", "_text", "_row", "_base", "matches", "score", "findings", "n", "text_hash", "hash", "_keep_text"]
    long = " ".join(f"word{k} and" for k in range(30_000)) + " api_key='abcd1234efgh'"
    rows = [(k, t, "en", "s", None, *[f"{n}{k}" for n in names]) for k, t in enumerate([long, long, None, "", "short", long + " end"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        kept = {r["doc_id"]: r for r in got.collect()}
        assert all(r["node"] == f"node{i}" and r["_keep_text"] == f"_keep_text{i}" for i, r in kept.items())
        if k == 1:
            assert set(kept) == {0, 2, 3, 4}
        if k == 3:
            assert kept[0]["text"].endswith(" [SECRET]'") and kept[2]["text"] is None and len(kept) == 6
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 6


def test_stage_list():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_copies", "decontamination", "secret_scan", "byte_bpe"]

import random
import re

import pytest

from clickloom.llm import jaccard

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, width=5, num=80, den=100):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append(frozenset([tuple(words)] if 0 < len(words) < width else [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]))
    distinct = sorted({s for s in sets if s}, key=len)
    parent = {s: s for s in distinct}

    def find(s):
        while parent[s] is not s:
            parent[s] = parent[parent[s]]
            s = parent[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if len(a) * den < len(b) * num:
                break
            inter = len(a & b)
            if den * inter >= num * (len(a) + len(b) - inter):
                parent[find(a)] = find(b)
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[find(s)] = min(least.get(find(s), i), i)
    return sorted(((i, len(s), least.get(find(s)) if s else i) for (i, _), s in zip(rows, sets)), key=repr)


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    got = jaccard.jaccard_groups(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    return df


def corpus():
    r = random.Random(5)
    rows, shared = [], [f"common{k}" for k in range(60)]
    for d in range(40):
        rows.append((d, " ".join(f"w{r.randrange(500)}" for _ in range(r.choice([1, 3, 5, 30, 200])))))
    base = [f"b{k}" for k in range(120)]
    for d in range(60):  # a large group of near copies, chained by their edits
        words = list(base)
        for _ in range(r.randrange(1, 3)):
            words[r.randrange(120)] = f"e{d}"
        rows.append((100 + d, " ".join(words)))
    for d in range(50):  # a passage that many documents share, with half their words
        rows.append((300 + d, " ".join([*shared, *(f"p{d}_{k}" for k in range(r.randrange(10, 20)))])))
    rows += [(400 + d, "One two THREE four five six") for d in range(30)]
    rows += [(7, None), (8, ""), (None, " \t "), (None, "one two three four five six"), (500, "ONE two"), (501, "one Two"), (400, "one two three four five six")]
    return rows


def test_groups_equal_brute_force(spark):
    check(spark, corpus())


def test_open_tiles_are_resolved(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL_TILE", 2)
    check(spark, corpus())


def test_whole_documents_of_the_small_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(spark, rows)


@pytest.mark.parametrize("size", [64, 1024, 4096])
def test_long_words_of_regular_build_stay_apart(spark, size):
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(size))
    other = word.translate(str.maketrans("ab", "ba"))
    check(spark, [(1, word), (2, other), (3, word.upper()), (4, f"x {word} y z w v"), (5, f"x {other} y z w v")])


def test_repeated_rows_with_one_id(spark):
    text = " ".join(f"w{k}" for k in range(50))
    check(spark, [(1, text)] * 20 + [(1, text + " more")] * 20 + [(None, text)] * 3)


def test_empty_table(spark):
    check(spark, [])


@pytest.mark.parametrize("bound", [0, 2_000_000])
def test_deduplicate_keeps_one_of_each_group(spark, bound):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    kept = [(r["doc_id"], r["text"]) for r in jaccard.deduplicate(df, broadcast_keys=bound).collect()]
    expected = brute(rows)
    empty = [t for t in expected if t[1] == 0]
    groups = {t[2] for t in expected if t[1]}
    assert len(kept) == len(groups) + len(empty)
    assert {i for i, t in kept if t and t.strip()} == groups


def brute_links(rows, width=5, num=80, den=100):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append(frozenset([tuple(words)] if 0 < len(words) < width else [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]))
    out = [0] * len(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            inter = len(a & b)
            if inter and den * inter >= num * (len(a) + len(b) - inter):
                out[i] += 1
                out[j] += 1
    return sorted(((d, len(s), n) for (d, _), s, n in zip(rows, sets, out)), key=repr)


@pytest.mark.parametrize("tile", [16, 2])
def test_links_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "SMALL_TILE", tile)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    assert sorted(map(tuple, jaccard.count_links(df).collect()), key=repr) == brute_links(rows)


def test_links_of_nothing(spark):
    assert jaccard.count_links(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("keys", [0, 200_000])
def test_links_of_one_text_in_a_third_of_the_rows(spark, keys):
    base = " ".join(f"w{k}" for k in range(40))
    rows = [(k, base) for k in range(60)] + [(100 + k, f"{base} x{k}") for k in range(60)] + [(200 + k, f"other {k} " * 9) for k in range(60)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["n_links"] for r in jaccard.count_links(docs, broadcast_keys=keys).collect()}
    sets = {i: {tuple((t or "").split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))} if (t or "").split() else set() for i, t in rows}
    want = {i: sum(1 for j, b in sets.items() if j != i and a and b and 100 * len(a & b) >= 80 * len(a | b)) for i, a in sets.items()}
    assert got == want and max(want.values()) == 119

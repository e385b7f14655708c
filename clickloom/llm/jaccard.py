"""Exact n-gram Jaccard join with size-banded tiles and bitmap signatures.

A document is the set of 64-bit hashes of its distinct word shingles. Two sets
of Jaccard similarity t or more share ``SHARED`` of the first ``n - ceil(t n) + SHARED``
shingles of each (or all they have in common, if less) in any common order; the order takes shingles that are known to
be frequent last, so shared passages seldom count among them. Documents that
share such a shingle and lie in the same or adjacent size bands form a tile.

Each set has a bitmap as wide as its size band. A bit of one bitmap that the
other lacks stands for at least one shingle of its own, so bit counts bound the
overlap from above; a pair goes on to the exact intersection of the two sorted
arrays only if that bound allows a link.

Groups never give all their pairs. In a tile of many sets only a star is tested:
each set with the leader of its band, and leaders of adjacent bands; tiles with the
same leader make up a cell, which gets a few more stars. If the links found so
far join the whole cell, no more is needed for it. Of whatever remains in pieces, each
set is tested with its nearest in another piece, twice; what is then apart is
compared in full, piece against piece, block by block of bitmaps, and only the
pairs whose bound allows a link become rows and are verified. So components are
exact, while most of a group of near copies costs a number of tests in proportion
to its size. Equal sets are one node throughout: a map task passes one posting a
shingle on, however many sets of its share it, and a set's array comes from the one
document of least id that has it.

A broadcast happens only below ``broadcast_keys`` keys. Above, the smaller side is a
written table, so that both sides are shuffled for the join alone and adaptive
execution splits a key with very many rows. Tables go when their last reader is
written. A node is the 64-bit digest of its set; at n distinct sets two of them are
confused with probability n * n / 2**65.

Defined results: a null, empty or word-free text has an empty set and no links, and
its component is its own id; a text with fewer words than a shingle has one
shingle; repeated rows are one group; null ids take part, and a group's id is the
least id that isn't null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from clickloom.llm._shared import collect_shuffles, discard, in_batches, materialize, sized
from clickloom.llm._text import SPACE_WORDS, buffers, hash_spans, mix, shingles, slices, words_of
from clickloom.llm.components import connected_components

#: Shingles that the order puts last: at most so many (12 bytes each in a broadcast), the most frequent by what scan tasks report.
HEAVY_SHINGLES = 1 << 20
#: A scan task reports a shingle from so many of its documents on.
HEAVY_IN_TASK = 2
#: Tiles up to so many sets are tested in full, larger ones by a star first.
SMALL_TILE = 16
#: Shingles that two sets of a link share among the first ones of each, if they have so many.
SHARED = 4
#: Least bits of a set's bitmap for each of its members.
BITS_A_MEMBER = 4
#: Bytes of bitmaps in a block of a cell whose pieces are compared.
BLOCK_BYTES = 1 << 20
#: Further stars of a cell, with other leaders each.
STAR_ROUNDS = 2
#: Rounds in which a set is tested with its nearest in other pieces, before all of them are compared.
NEAREST_ROUNDS = 2
#: Bytes of arrays that a task sends at once.
SENT_BYTES = 1 << 20
#: Pairs of one set that are verified together.
LEADER_PAIRS = 1000
#: Postings of a bucket of tiles, about, and postings that a scattering task holds.
BUCKET_POSTINGS, HELD_POSTINGS = 500_000, 300_000

#: ``band`` has the size band; ``BIG`` is added where the posting stands for many.
_POSTING = np.dtype([("token", "<u8"), ("node", "<i8"), ("band", "u1")])
BIG = 128


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending shingle hashes) for each row; the text is the last column."""
    data, at = buffers(batch.column(batch.num_columns - 1))
    for i, j in slices(at):
        low, starts, ends, first = words_of(data, at[i : j + 1], SPACE_WORDS)
        for k, s in enumerate(shingles(hash_spans(low, starts, ends), first, width)):
            yield i + k, s


def _digest(s: np.ndarray) -> int:
    total = np.add.reduce(mix(s ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)
    return int(mix(np.array([total ^ np.uint64(len(s) * 0xE7037ED1A0B428DB & (2**64 - 1))], dtype=np.uint64)).view(np.int64)[0])


def _bitmap(s: np.ndarray) -> np.ndarray:
    """Words of a set's bitmap; the width is a power of two, 64 or more."""
    bits = max(64, BITS_A_MEMBER << int(len(s) - 1).bit_length())
    at = (s >> np.uint64(7)) & np.uint64(bits - 1)
    flags = np.zeros(bits, dtype=np.uint8)
    flags[at.astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view("<i8")


def frequent_shingles(texts: DataFrame, width: int, limit: int) -> np.ndarray:
    """The shingles that most documents share, rarest first: at most ``limit`` hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, parts, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def fold():
            every = np.concatenate([keys, *parts])
            weight = np.concatenate([counts, np.ones(len(every) - len(keys), np.int64)])
            order = np.argsort(every, kind="stable")
            every, weight = every[order], weight[order]
            new = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
            sums = np.add.reduceat(weight, new) if len(every) else weight
            return every[new][sums > 1], sums[sums > 1]

        for batch in batches:
            for _, s in _sets(batch, width):
                parts.append(s)
                size += len(s)
                if size > 1_000_000:
                    (keys, counts), parts, size = fold(), [], 0
        keys, counts = fold()
        keep = counts >= HEAVY_IN_TASK
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), pa.array(counts[keep])], names=["h", "c"])

    found = texts.transform(in_batches, run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    found = materialize(found, "frequent")
    # eighths of powers of two: the least from which on no more than ``limit`` shingles are counted
    level, most, n = F.floor(F.log2("c") * 8).cast("int"), None, 0
    for row in found.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # a few hundred rows at most
        n += row["count"]
        if n > limit:
            break
        most = row["level"]
    top = found.where(level >= most).toArrow() if most is not None else None  # bounded by limit
    discard(found)
    if top is None:
        return np.zeros(0, np.uint64)
    h, c = (top.column(k).to_numpy() for k in ("h", "c"))
    return h[np.lexsort((h, c))].view(np.uint64)


def sign(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int) -> DataFrame:
    """Write id, text hash, set size, node, bitmap and the first shingles of every document."""
    texts = docs.select(F.col(text_col).alias("_text"))
    heavy = frequent_shingles(texts, width, HEAVY_SHINGLES)
    order = np.argsort(heavy)
    sent = docs.sparkSession.sparkContext.broadcast((heavy[order], order.astype(np.int32)))
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(text_col)).alias("_h"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, rank = sent.value
        for batch in batches:
            n = batch.num_rows
            sizes, nodes, bits, firsts = np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n, [None] * n
            for row, s in _sets(batch, width):
                sizes[row] = len(s)
                if not len(s):
                    continue
                nodes[row], bits[row] = _digest(s), _bitmap(s)
                take = len(s) - -(-len(s) * num // den) + SHARED
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
                    common = heavy[at] == s
                    rare = s[~common]
                    if len(rare) < take:
                        rare = np.concatenate([rare, s[common][np.argsort(rank[at[common]], kind="stable")]])
                    firsts[row] = rare[:take].view(np.int64)
                else:
                    firsts[row] = s[:take].view(np.int64)
            empty = sizes == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes), pa.array(nodes, mask=empty), *(pa.array(x, pa.list_(pa.int64())) for x in (bits, firsts))],
                names=["_id", "_h", "n", "node", "bits", "first"],
            )

    written = materialize(base.transform(in_batches, run, "_id long, _h long, n long, node long, bits array<long>, first array<long>"), "signatures")
    sent.destroy()
    return written


def _ratio(num: int, den: int) -> float:
    """How much larger a band's sizes are than those of the band below; the bands' numbers fit into 7 bits."""
    return max(den / num, 1.2)


def _band(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Size bands: sets that can link are in one band or in adjacent ones."""
    return np.floor(np.log(n.astype(np.float64)) / np.log(_ratio(num, den)) + 1e-9).astype(np.int64)


def _runs(p: np.ndarray) -> Iterator[np.ndarray]:
    edges = np.flatnonzero(np.concatenate(([True], p["token"][1:] != p["token"][:-1], [True]))) if len(p) else np.zeros(1, np.int64)
    size = np.diff(edges)
    for k in np.flatnonzero(size > 1):
        yield p[edges[k] : edges[k + 1]]


def _star(run: np.ndarray) -> list[tuple[int, int]]:
    """Each set with the leader of its band, and the leaders of adjacent bands."""
    band = run["band"] % BIG
    out, last = [], None
    for b in np.unique(band):
        members = run["node"][band == b]
        out += [(int(members[0]), int(x)) for x in members[1:]]
        if last is not None and last[0] == b - 1:
            out.append((last[1], int(members[0])))
        last = b, int(members[0])
    return out


def _ordered(p: np.ndarray) -> np.ndarray:
    """Postings by token and node, one for each."""
    p = p[np.lexsort((p["band"] < BIG, p["node"], p["token"]))]
    return p[np.concatenate(([True], (p["token"][1:] != p["token"][:-1]) | (p["node"][1:] != p["node"][:-1])))] if len(p) else p


def tile_candidates(signed: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of tiles: (token, a, b, need). Large tiles give stars; of tiles that are paired in full, the token is
    null and ``need`` says in how many of them a pair has to meet.
    """
    total = signed.agg(F.sum(F.size("first"))).first()[0] or 0
    n_buckets = max(16, int(total // BUCKET_POSTINGS) + 1, 4 * signed.sparkSession.sparkContext.defaultParallelism)
    postings = signed.where("node is not null").select("node", "n", "first")

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(parts: list[np.ndarray]) -> pa.RecordBatch:
            p = _ordered(np.concatenate(parts))
            size = np.diff(np.flatnonzero(np.concatenate(([True], p["token"][1:] != p["token"][:-1], [True]))))
            whole = np.repeat(size, size)
            large = p[whole > SMALL_TILE]
            pairs = [(int(r["token"][0]), a, b) for r in _runs(large) for a, b in _star(r)]
            if len(large):  # goes on as one posting for each band, that of the leader
                band = large["band"] % BIG
                large["band"] = band + BIG
                order = np.lexsort((band, large["token"]))
                t, b = large["token"][order], band[order]
                new = np.concatenate(([True], (t[1:] != t[:-1]) | (b[1:] != b[:-1])))
                p = np.concatenate([p[whole <= SMALL_TILE], large[order][new]])
            bucket = ((p["token"] >> np.uint64(11)) % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            p, bucket = p[order], bucket[order]
            edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(p) else [0]
            blobs = [p[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            buckets = [int(bucket[a]) for a in edges[:-1]]
            star = np.array(pairs, dtype=[("token", "<u8"), ("a", "<i8"), ("b", "<i8")])
            buckets += [k % n_buckets for k in range(0, len(star), 4096)]
            stars = [None] * len(blobs) + [star[k : k + 4096].tobytes() for k in range(0, len(star), 4096)]
            blobs += [None] * (len(stars) - len(blobs))
            return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary()), pa.array(stars, pa.binary())], names=["bucket", "blob", "star"])

        parts, size = [], 0
        for batch in batches:
            nodes, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            tokens = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            count = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            p = np.zeros(len(tokens), dtype=_POSTING)
            p["token"], p["node"], p["band"] = tokens.view(np.uint64), np.repeat(nodes, count), np.repeat(_band(n, num, den), count)
            parts.append(p)
            size += len(p)
            if size > HELD_POSTINGS:
                yield send(parts)
                parts, size = [], 0
        if size:
            yield send(parts)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for bucket, blob, star in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if star is not None:
                    s = np.frombuffer(star, dtype=[("token", "<u8"), ("a", "<i8"), ("b", "<i8")])
                    yield _pair_batch(s["token"].view(np.int64), s["a"], s["b"], np.zeros(len(s), np.int64))
                if blob is not None:
                    held.setdefault(bucket, []).append(blob)
        for bucket in list(held):
            p = _ordered(np.frombuffer(b"".join(held.pop(bucket)), dtype=_POSTING))
            token, a, b, need = [], [], [], []
            for run in _runs(p):
                if len(run) <= SMALL_TILE and (run["band"] < BIG).all():
                    i, j = np.triu_indices(len(run), 1)
                    band = run["band"].astype(np.int64)
                    near = np.abs(band[i] - band[j]) <= 1
                    # the least overlap of a link, from the least size in the band
                    least = np.maximum(np.ceil(num / den * _ratio(num, den) ** (np.maximum(band[i], band[j])[near] - 0.001)), 1).astype(np.int64)
                    a += run["node"][i[near]].tolist()
                    b += run["node"][j[near]].tolist()
                    token += [0] * int(near.sum())
                    need += np.minimum(least, SHARED).tolist()
                else:
                    pairs = _star(run)
                    a += [x for x, _ in pairs]
                    b += [y for _, y in pairs]
                    token += [int(run["token"].view(np.int64)[0])] * len(pairs)
                    need += [0] * len(pairs)
            for k in range(0, len(a), 100_000):
                yield _pair_batch(token[k : k + 100_000], a[k : k + 100_000], b[k : k + 100_000], need[k : k + 100_000])

    sent = postings.transform(in_batches, scatter, "bucket int, blob binary, star binary")
    return sent.repartition(n_buckets, "bucket").transform(in_batches, gather, "token long, a long, b long, need long")


def _pair_batch(token, a, b, need) -> pa.RecordBatch:
    a, b, need = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), np.array(need, dtype=np.int64)
    columns = [pa.array(np.array(token, dtype=np.int64), mask=need > 0), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(need)]
    return pa.RecordBatch.from_arrays(columns, names=["token", "a", "b", "need"])


def _missing(x: Column, y: Column) -> Column:
    """Bits of x that y lacks."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, c: s + c)


def _folded(x: Column, y: Column) -> Column:
    """x at the width of y if x is twice as wide."""
    half = F.zip_with(F.slice(x, 1, F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), lambda p, q: p.bitwiseOR(q))
    return F.when(F.size(x) > F.size(y), half).otherwise(x)


def may_link(x: Column, n: Column, y: Column, m: Column, num: int, den: int) -> Column:
    """Whether sizes and bitmaps leave room for similarity num / den."""
    near = (F.least(n, m) * den >= F.greatest(n, m) * num) & (F.size(x) <= F.size(y) * 2) & (F.size(y) <= F.size(x) * 2)
    a, b = _folded(x, y), _folded(y, x)
    bound = F.least(n - _missing(a, b), m - _missing(b, a))
    return F.when(near, bound * den >= (n + m - bound) * num).otherwise(False)


def bitmaps(signed: DataFrame, nodes: DataFrame, broadcast_keys: int) -> DataFrame:
    """Size and bitmap of the sets in ``nodes`` (a written table), a row each."""
    return signed.join(sized(nodes, broadcast_keys), "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))


def test_pairs(pairs: DataFrame, signed: DataFrame, num: int, den: int, broadcast_keys: int) -> DataFrame:
    """Write those of the written ``pairs`` (a, b) whose sizes and bitmaps leave room for a link."""
    nodes = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    marks = bitmaps(signed, nodes, broadcast_keys)
    left = marks.select(F.col("node").alias("a"), F.col("n").alias("_n"), F.col("bits").alias("_p"))
    right = marks.select(F.col("node").alias("b"), F.col("n").alias("_m"), F.col("bits").alias("_q"))
    possible = may_link(F.col("_p"), F.col("_n"), F.col("_q"), F.col("_m"), num, den)
    tested = materialize(pairs.join(left, "a").join(right, "b").where(possible).select("a", "b"), "tested")
    discard(nodes)
    return tested


def verify(pairs: DataFrame, signed: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int, broadcast_keys: int) -> DataFrame:
    """The pairs (a < b) whose sets link, by the exact intersection of their sorted arrays; ``pairs`` is a written table.

    One pass over the texts gives the arrays of the nodes in question, each from the
    document of least id that has it. They go to the pairs' first nodes: ``LEADER_PAIRS``
    of a node's pairs and its own array make up a piece of work, read as a stream.
    """
    count = pairs.count()
    if not count:
        return pairs
    small = 3 * count <= broadcast_keys

    def checked(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    no_id = F.lit(-(2**63))
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / LEADER_PAIRS).cast("int").alias("_s"))
    members = pairs.join(checked(salts), "a").select("a", F.pmod(F.xxhash64("b"), F.col("_s")).cast("int").alias("salt"), F.col("b").alias("node"))
    leaders = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)).alias("salt"), F.col("a").alias("node"))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    holders = signed.join(checked(nodes), "node", "left_semi").groupBy("node").agg(F.coalesce(F.min("_id"), no_id).alias("_holder"))
    roles = materialize(members.unionByName(leaders).join(checked(holders), "node"), "roles")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            nodes, holders, sets, size = [], [], [], 0
            for row, s in _sets(batch, width):
                node = _digest(s) if len(s) else None
                if node is None or (node, ids[row]) in seen:
                    continue
                seen.add((node, ids[row]))
                nodes.append(node)
                holders.append(ids[row])
                sets.append(s.tobytes())
                size += len(sets[-1])
                if size >= SENT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(holders, pa.int64()), pa.array(sets, pa.binary())], names=["node", "_holder", "set"])
                    nodes, holders, sets, size = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(holders, pa.int64()), pa.array(sets, pa.binary())], names=["node", "_holder", "set"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leader, last = None, None, None
        for batch in batches:
            links = []
            for a, salt, node, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                s = np.frombuffer(raw.as_buffer(), "<u8")
                if (a, salt) != key:
                    key, leader, last = (a, salt), None, None
                if node == a:
                    leader = s.copy()
                elif node != last and leader is not None:
                    last = node
                    merged = np.sort(np.concatenate([leader, s]), kind="stable")
                    inter = int(np.count_nonzero(merged[1:] == merged[:-1]))
                    if den * inter >= num * (len(leader) + len(s) - inter):
                        links.append((a, node))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), no_id).alias("_id"), F.col(text_col).alias("_text"))
    ids = materialize(roles.select(F.col("_holder").alias("_id")).distinct(), "holders")
    if ids.count() <= broadcast_keys:  # no other document is cut into shingles again
        texts = texts.join(F.broadcast(ids), "_id", "left_semi")
    found = texts.transform(in_batches, arrays, "node long, _holder long, set binary")
    rows = found.join(checked(roles), ["node", "_holder"]).select("a", "salt", "node", "set")
    dealt = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("node") != F.col("a"), "node")
    links = materialize(dealt.transform(in_batches, exact, "a long, b long"), "links")
    discard(roles)
    discard(ids)
    return links


def overlaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits that two tiles of bitmaps have in common, pair by pair."""
    out = np.empty((len(x), len(y)), dtype=np.int64)
    step = max(1, (1 << 21) // max(1, y.size))
    for k in range(0, len(x), step):
        out[k : k + step] = np.bitwise_count(x[k : k + step, None, :] & y[None, :, :]).sum(axis=2, dtype=np.int64)
    return out


def compare_pieces(cells: DataFrame, num: int, den: int, nearest: bool, broadcast_keys: int) -> DataFrame:
    """Pairs (cell, a, b) of sets that lie in different groups and that sizes and bitmaps leave room for.

    With ``nearest`` a set gives its most promising pair in each piece of work only.

    A cell is cut into blocks of ``BLOCK_BYTES`` of bitmaps, and each pair of blocks is
    a task's work, so a task holds two blocks however large the cell is. ``cells`` is a
    written table.
    """
    blocks = materialize(cells.groupBy("cell").agg(F.ceil(F.sum(F.size("bits") * 8 + 64) / BLOCK_BYTES).cast("int").alias("_blocks")), "blocks")
    rows = cells.join(sized(blocks, broadcast_keys), "cell").withColumn("_own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.select("cell", F.least("_own", "_other").alias("p"), F.greatest("_own", "_other").alias("q"), "_own", "node", "group", "n", "bits")

    def compare(rows: pa.Table) -> pa.Table:
        p, q = rows["p"][0].as_py(), rows["q"][0].as_py()
        own, node, group, n = (rows[c].to_numpy().astype(np.int64) for c in ("_own", "node", "group", "n"))
        bits = rows["bits"].combine_chunks()
        width, flat = bits.value_lengths().to_numpy().astype(np.int64), bits.flatten().to_numpy().view(np.uint64)
        at = np.concatenate(([0], np.cumsum(width)))
        found = [np.zeros((0, 2), np.int64)]
        for w in np.unique(width):
            same, wide = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
            x = np.stack([flat[at[i] : at[i] + w] for i in same])
            folded = [flat[at[i] : at[i] + w] | flat[at[i] + w : at[i + 1]] for i in wide]
            for other, y in ((same, x), (wide, np.stack(folded) if folded else x[:0])):
                if not len(other):
                    continue
                px, py = np.bitwise_count(x).sum(axis=1, dtype=np.int64), np.bitwise_count(y).sum(axis=1, dtype=np.int64)
                step = max(1, (1 << 20) // len(other))
                for k in range(0, len(same), step):
                    i = same[k : k + step]
                    shared = overlaps(x[k : k + step], y)
                    bound = np.minimum(n[i][:, None] - (px[k : k + step][:, None] - shared), n[other][None, :] - (py[None, :] - shared))
                    room = bound * den >= (n[i][:, None] + n[other][None, :] - bound) * num
                    room &= group[i][:, None] != group[other][None, :]
                    if p != q:
                        room &= own[i][:, None] != own[other][None, :]
                    if nearest:
                        best = np.where(room, bound, -1)
                        r, c = np.arange(len(i)), best.argmax(axis=1)
                        r, c = np.concatenate([r, best.argmax(axis=0)]), np.concatenate([c, np.arange(len(other))])
                        r, c = r[best[r, c] >= 0], c[best[r, c] >= 0]
                    else:
                        r, c = np.nonzero(room & (i[:, None] < other[None, :]) if other is same else room)
                    found.append(np.stack([node[i[r]], node[other[c]]], axis=1))
        pairs = np.concatenate(found)
        return pa.table({"cell": pa.array(np.full(len(pairs), rows["cell"][0].as_py())), "a": pa.array(pairs.min(axis=1)), "b": pa.array(pairs.max(axis=1))})

    return rows.groupBy("cell", "p", "q").applyInArrow(compare, "cell long, a long, b long")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100, broadcast_keys: int = 200_000) -> DataFrame:
    """Exact groups of documents that links of similarity num / den or more connect.

    Returns a row per document: ``id_col``, ``text_hash`` (xxhash64), ``n_shingles``,
    ``node`` (digest of the set), ``group`` (node that stands for the group) and
    ``component_id`` (least id in the group).
    """
    signed = sign(docs, id_col, text_col, width, num, den)
    sets = signed.where("node is not null")
    candidates = materialize(tile_candidates(signed, num, den), "candidates")
    collect_shuffles(docs)

    def written(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
        table = materialize(df, name)
        for old in done:
            discard(old)
        return table

    # tiles of one passage or one group of near copies have the same members by and large: a cell is the tiles of one leader
    stars = candidates.where("token is not null")
    leaders = written(stars.groupBy("token").agg(F.min("a").alias("cell")), "leaders")
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(_ratio(num, den))) + 1e-9)
    posted = sets.select("node", band.alias("band"), F.explode("first").alias("token")).join(sized(leaders, broadcast_keys), "token")
    cells = written(posted.groupBy("cell", "node").agg(F.first("band").alias("band")), "cells", leaders)

    # what is tested first: pairs of small tiles that meet often enough, and the stars of large tiles and cells
    met = candidates.where("token is null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("_met"), F.max("need").alias("_need")).where("_met >= _need").select("a", "b")
    first = met.union(stars.select("a", "b"))
    for step in range(1, STAR_ROUNDS + 1):
        lead = cells.groupBy("cell", "band").agg(F.min(F.struct(F.xxhash64("node", F.lit(step)).alias("h"), "node"))["node"].alias("l"))
        lead = lead.select("cell", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "l")
        lead = written(lead, "lead")
        first = first.union(cells.join(sized(lead, broadcast_keys), ["cell", "band"]).where("node != l").select(F.least("node", "l").alias("a"), F.greatest("node", "l").alias("b")))
    first = written(first.distinct(), "first", candidates)
    tested = test_pairs(first, sets, num, den, broadcast_keys)
    discard(first)
    groups = written(connected_components(verify(tested, sets, docs, id_col, text_col, width, num, den, broadcast_keys)), "groups")
    collect_shuffles(docs)

    def grouped(df: DataFrame, col: str, out: str) -> DataFrame:
        return df.join(sized(groups.select(F.col("node").alias(col), F.col("component").alias(out)), broadcast_keys), col, "left").withColumn(out, F.coalesce(out, col))

    # cells that the links so far leave in pieces: sets look for their nearest in other pieces, then all of them are compared
    for step in range(NEAREST_ROUNDS + 1):
        named = grouped(cells.select("cell", "node", "band"), "node", "group")
        split = written(named.groupBy("cell").agg(F.min("group").alias("_low"), F.max("group").alias("_high")).where("_low != _high").select("cell"), "split")
        if not split.limit(1).count():
            break
        pieces = written(named.join(sized(split, broadcast_keys), "cell"), "pieces", split)
        nodes = written(pieces.select("node").distinct(), "nodes")
        marked = written(pieces.join(bitmaps(sets, nodes, broadcast_keys), "node"), "marked", nodes)
        near = written(compare_pieces(marked, num, den, step < NEAREST_ROUNDS, broadcast_keys), "near", marked)
        # a cell without room for any link stays without it, as groups only grow
        open_cells = written(near.select("cell").distinct(), "open_cells")
        cells = written(pieces.join(sized(open_cells, broadcast_keys), "cell", "left_semi"), "cells", cells, pieces, open_cells)
        pairs = written(near.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "pairs", near)
        if not pairs.limit(1).count():
            continue
        tested = written(tested.unionByName(pairs), "tested", tested)
        added = verify(pairs, sets, docs, id_col, text_col, width, num, den, broadcast_keys)
        groups = written(connected_components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(added)), "groups", groups, added, pairs)
        collect_shuffles(docs)

    # the least id goes from nodes to groups and back, so a group with a third of all rows is one row a node
    own = written(grouped(sets.groupBy("node").agg(F.min("_id").alias("_own")), "node", "group"), "own", cells, tested)
    least = written(own.groupBy("group").agg(F.min("_own").alias("_least")), "least")
    named = written(own.join(sized(least, broadcast_keys), "group").select("node", "group", "_least"), "named", own, least, groups)
    rows = signed.select("_id", "_h", "n", "node").join(sized(named, broadcast_keys), "node", "left")
    return rows.select(F.col("_id").alias(id_col), F.col("_h").alias("text_hash"), F.col("n").alias("n_shingles"), "node", "group", F.when(F.col("group").isNull(), F.col("_id")).otherwise(F.col("_least")).alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_keys: int = 200_000, **options) -> DataFrame:
    """One document of each group, the one of least id (then least text hash); the others go.

    Documents with empty sets stay. Columns and the rows kept are unchanged.
    """
    rows = materialize(jaccard_groups(docs, id_col, text_col, broadcast_keys=broadcast_keys, **options), "groups").where("group is not null")
    key = F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id"), F.col("text_hash").alias("h"))
    best = materialize(rows.groupBy("group").agg(F.min(key).alias("_best"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "best")
    judged = rows.join(sized(best, broadcast_keys), "group").withColumn("_stays", key == F.col("_best"))
    gone = judged.where("not _stays").select(F.col(id_col).alias("_gid"), F.col("text_hash").alias("_gh")).distinct()
    twice = judged.where("_stays").groupBy(F.col(id_col).alias("_gid"), F.col("text_hash").alias("_gh")).count().where("count > 1").drop("count")
    gone, twice = materialize(gone, "gone"), materialize(twice, "twice")

    same = F.col(id_col).cast("long").eqNullSafe(F.col("_gid")) & (F.xxhash64(F.col(text_col)) == F.col("_gh"))
    kept = docs.join(sized(gone, broadcast_keys), same, "left_anti")
    if not twice.limit(1).count():
        return kept
    repeated = kept.join(sized(twice, broadcast_keys), same, "left_semi")
    return kept.join(sized(twice, broadcast_keys), same, "left_anti").unionByName(repeated.dropDuplicates([id_col, text_col]))


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100, broadcast_keys: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """Every link between distinct sets, and which set each document has.

    Returns the links (a < b, nodes; each once) and a row per document: ``id_col``,
    ``text_hash``, ``n_shingles`` and ``node``. Unlike the groups, all pairs of a cell are
    compared, so a group of near copies costs the square of its distinct sets.
    """
    signed = sign(docs, id_col, text_col, width, num, den)
    candidates = materialize(tile_candidates(signed, num, den), "candidates")
    sets = signed.where("node is not null")
    # pairs of small tiles that meet often enough
    met = candidates.where("token is null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("_met"), F.max("need").alias("_need")).where("_met >= _need").select("a", "b")
    met = materialize(met, "met")
    room = test_pairs(met, sets, num, den, broadcast_keys)
    # any other pair of a link meets in a large tile: all pairs of its cell
    leaders = materialize(candidates.where("token is not null").groupBy("token").agg(F.min("a").alias("cell")), "leaders")
    posted = sets.select("node", F.explode("first").alias("token")).join(sized(leaders, broadcast_keys), "token")
    cells = materialize(posted.select("cell", "node").distinct(), "cells")
    nodes = materialize(cells.select("node").distinct(), "nodes")
    marked = materialize(cells.join(bitmaps(sets, nodes, broadcast_keys), "node").withColumn("group", F.col("node")), "marked")
    near = compare_pieces(marked, num, den, False, broadcast_keys).select("a", "b")
    pairs = materialize(room.unionByName(near).distinct(), "pairs")
    for done in (candidates, met, room, leaders, cells, nodes, marked):
        discard(done)
    links = verify(pairs, sets, docs, id_col, text_col, width, num, den, broadcast_keys)
    return links, signed.select(F.col("_id").alias(id_col), F.col("_h").alias("text_hash"), F.col("n").alias("n_shingles"), "node")


def count_links(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per document: id, n_shingles and n_links, the other documents whose sets are equal or link; 0 for empty sets."""
    links, members = jaccard_links(docs, id_col, **options)
    # written, so that a hub of links, and a set that a third of all rows have, are skewed joins that can be split
    copies = materialize(members.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("_copies")), "copies")
    both = links.select(F.col("a").alias("_to"), F.col("b").alias("node")).unionByName(links.select(F.col("b").alias("_to"), F.col("a").alias("node")))
    linked = both.join(copies, "node").groupBy(F.col("_to").alias("node")).agg(F.sum("_copies").alias("_linked"))
    counts = copies.join(linked, "node", "left").select("node", (F.col("_copies") - 1 + F.coalesce("_linked", F.lit(0))).alias("_links"))
    counts = materialize(counts, "counts")
    return members.join(counts, "node", "left").select(id_col, "n_shingles", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT r, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END)) AS g FROM d
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r
), p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL
), l AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(e.doc_id) AS component_id
FROM d JOIN reach ON reach.x = d.r JOIN d e ON e.r = reach.y LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id
"""

LINKS_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT r, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END)) AS g FROM d
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r
), p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL
), l AS (SELECT x, count(*) AS links FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 80 * (a.n + b.n - c) GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(l.links, 0) AS n_links FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN l ON l.x = d.r
"""

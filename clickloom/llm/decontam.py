"""Benchmark decontamination with suffix arrays of the training texts.

Each task turns the documents it scans into a shard: a sequence of word numbers,
documents apart, and its suffix array: prefix doubling sorts whole suffixes, each
up to the first word that no item has. Every suffix of every test item is searched
in that array by bisection: first the range of suffixes that share its window, which
are the places of a match, then the place within the range where the whole test
suffix belongs. Its longest match is beside that place, and the words that
neighbours in the array share give the longest match at every other place of the
range. A match that an earlier suffix of the item extends to the left is never made:
places of a range are ordered by the word before them, and those before the suffix's
own are passed over, so runs of repeated words give their ends only.

The test side is broadcast in slices of a checked size, of which one is held at a
time; each slice is one more pass and the hits of all passes are merged, so a large benchmark costs time and
no memory. Nothing of the documents is shuffled where one slice holds the items.

Defined results: null and word-free texts have no words and no hits; null, empty
and word-free items have no window; items with equal texts all count, repeated
rows of one item once; matches of null item ids count as hits and name no item; repeated documents each have
their row; empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from clickloom.llm._shared import discard, in_batches, materialize
from clickloom.llm._text import ALNUM_WORDS, LOWER, buffers

#: Words of a window.
WINDOW = 10
#: Bytes of item text that one broadcast slice holds.
SLICE_ITEM_BYTES = 8 << 20
#: A suffix that is paired with at least one in so many places of its range gets them all from neighbours in the array.
RANGE_SHARE = 8
#: Words after which a shard is closed and its suffix array built.
SHARD_WORDS = 1 << 20

_TO_WORDS = bytes(int(LOWER[b]) if ALNUM_WORDS[LOWER[b]] else 32 for b in range(256))
_MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_start", T.IntegerType()), T.StructField("doc_start", T.LongType()), T.StructField("n_words", T.IntegerType())]))


def split_words(text: bytes) -> list[bytes]:
    """Lower-cased words of ASCII letters, digits and characters beyond ASCII."""
    return text.translate(_TO_WORDS).split()


def word_numbers(text: bytes, get, block: int = 4 << 20) -> np.ndarray:
    """Word numbers of a text, 0 for unknown words; long texts go block by block, cut between words."""
    low, out, at = text.translate(_TO_WORDS), [], 0
    while at < len(low):
        end = len(low) if len(low) - at <= block else low.rfind(b" ", at, at + block) + 1
        if end <= at:  # a word longer than a block
            end = low.find(b" ", at + block) + 1 or len(low)
        words = low[at:end].split()
        out.append(np.fromiter((get(w, 0) for w in words), dtype=np.uint32, count=len(words)))
        at = end
    return out[0] if len(out) == 1 else np.concatenate([np.zeros(0, np.uint32), *out])


class Items:
    """A slice of test items: vocabulary, suffixes and their windows."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.ids = [i for i, _ in items]
        words = [split_words(t) for _, t in items]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for ws in words for w in ws}))}
        self.window = window
        lengths = [min(len(ws), window) for ws in words if ws]
        self.shortest = min(lengths, default=window)
        self.numbers = np.array([self.vocabulary[w] for ws in words for w in ws], dtype=np.uint32)
        ends = np.cumsum([0] + [len(ws) for ws in words])
        # one row for each suffix of a window at least: item, place in the item and in ``numbers``, the item's end there
        sizes = np.array([min(len(ws), window) for ws in words], dtype=np.int64)
        counts = np.where(sizes > 0, np.diff(ends) - sizes + 1, 0)
        self.item = np.repeat(np.arange(len(words)), counts)
        self.start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.at, self.end = ends[self.item] + self.start, ends[self.item + 1]
        # keys of the windows are big-endian word numbers, so bytes sort as the words do
        keys = np.zeros((len(self.at), window), dtype=">u4")
        inside = np.arange(window) < sizes[self.item][:, None]
        keys[inside] = self.numbers[(self.at[:, None] + np.arange(window))[inside]]
        self.low = _as_bytes(keys, window)
        keys[~inside] = 0xFFFFFFFF
        self.high = _as_bytes(keys, window)


def _as_bytes(keys: np.ndarray, window: int) -> np.ndarray:
    return keys.reshape(-1).view(f"S{4 * window}").copy() if len(keys) else np.zeros(0, f"S{4 * window}")


def suffix_array(numbers: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Places of all words but 0, sorted by the words from there to ``stop``; equal suffixes by place.

    Prefix doubling: after each round ranks tell twice as many words apart, and only
    places that still tie, and whose suffix goes on, are sorted again.
    """
    n = len(numbers)
    order = np.flatnonzero(numbers)
    order = order[np.argsort(numbers[order], kind="stable")]
    rank, reach = np.zeros(n + 1, dtype=np.int64), 1
    slots, keys = np.arange(len(order)), numbers[order].astype(np.int64)
    goes_on = np.ones(len(order), dtype=bool)
    while len(slots):
        new = np.append(True, keys[1:] != keys[:-1])
        group = np.cumsum(new) - 1
        rank[order[slots]] = slots[new][group] + 1
        tied = np.bincount(group)[group] > 1
        slots = slots[tied & goes_on]
        places = order[slots]
        after = places + reach
        second = np.where(after < stop[places], rank[np.minimum(after, n)], 0)
        keys = rank[places] * (n + 2) + second
        by = np.argsort(keys, kind="stable")
        order[slots], keys, goes_on = places[by], keys[by], second[by] > 0
        reach *= 2
    return order


def common(a: np.ndarray, at_a: np.ndarray, end_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, end_b: np.ndarray, block: int = 16, rows: int = 1 << 16) -> np.ndarray:
    """Words that the suffixes ``a[at_a:end_a]`` and ``b[at_b:end_b]`` share from their beginnings, for each pair."""
    most = np.minimum(end_a - at_a, end_b - at_b)
    out, steps = np.zeros(len(most), dtype=np.int64), np.arange(block)
    for k in range(0, len(most), rows):
        alive = np.arange(k, min(k + rows, len(most)))
        while len(alive):
            done = out[alive][:, None] + steps
            inside = done < most[alive][:, None]
            same = inside & (a[np.where(inside, at_a[alive][:, None] + done, 0)] == b[np.where(inside, at_b[alive][:, None] + done, 0)])
            whole = same.all(axis=1)
            out[alive] += np.where(whole, block, same.argmin(axis=1))
            alive = alive[whole]
    return out


def _running_least(values: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """The least value so far in each segment; segments are numbered upward."""
    if not len(values):
        return values
    drop = segment * (int(values.max()) + 1)
    return np.minimum.accumulate(values - drop) + drop


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, place in the segment) of segments of so many places."""
    segment = np.repeat(np.arange(len(counts)), counts)
    return segment, np.arange(len(segment)) - np.repeat(np.cumsum(counts) - counts, counts)


class SuffixShard:
    """Word numbers of some documents (0: not in the vocabulary, and between documents) and their suffix array."""

    def __init__(self, numbers: np.ndarray, window: int, shortest: int):
        n = len(numbers)
        gaps = np.flatnonzero(numbers == 0)
        self.shortest = shortest
        self.numbers, self.stop = numbers, np.append(gaps, n)[np.searchsorted(gaps, np.arange(n))]
        order = suffix_array(numbers, self.stop)
        self.places = order[self.stop[order] - order >= shortest]  # shorter ones hold no window
        keys = np.zeros((len(self.places), window), dtype=">u4")
        padded = np.concatenate([numbers, np.zeros(window, numbers.dtype)])
        for k in range(window):
            keys[:, k] = np.where(self.places + k < self.stop[self.places], padded[self.places + k], 0)
        self.keys = _as_bytes(keys, window)

    def _with_items(self, items: Items, which: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Words that test suffixes share with the suffixes at some ranks."""
        places = self.places[ranks]
        return common(items.numbers, items.at[which], items.end[which], self.numbers, places, self.stop[places])

    def _bisect(self, items: Items, which: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The rank in [lo, hi] where each whole test suffix belongs."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                return lo
            mid = (lo[live] + hi[live]) // 2
            w, places = which[live], self.places[mid]
            n = self._with_items(items, w, mid)
            a, b = items.at[w] + n, places + n
            left = np.where(a < items.end[w], items.numbers[np.minimum(a, len(items.numbers) - 1)], 0)
            right = np.where(b < self.stop[places], self.numbers[np.minimum(b, len(self.numbers) - 1)], 0)
            before = left <= right
            hi[live[before]] = mid[before]
            lo[live[~before]] = mid[~before] + 1

    def find(self, items: Items, pairs: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All longest matches, of about so many pairs at once: (numbers of test suffixes, places, words)."""
        lo = np.searchsorted(self.keys, items.low, side="left")
        hi = np.searchsorted(self.keys, items.high, side="right")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            return
        # the places of each distinct range, ordered by the word before: a match that goes on to the left is
        # another suffix's, so of a range only the places before other words than the suffix's own are paired
        bounds, which_range = np.unique(np.stack([lo[hit], hi[hit]], axis=1), axis=0, return_inverse=True)
        sizes = bounds[:, 1] - bounds[:, 0]
        segment, k = _ragged(sizes)
        ranks = bounds[segment, 0] + k
        places = self.places[ranks]
        span = int(max(self.numbers.max(initial=0), items.numbers.max(initial=0))) + 1
        left = segment * span + np.where(places > 0, self.numbers[places - 1], 0)
        by = np.argsort(left, kind="stable")
        left, ranks = left[by], ranks[by]
        first = np.cumsum(sizes) - sizes
        own = which_range.ravel() * span + np.where(items.start[hit] > 0, items.numbers[items.at[hit] - 1], 0)
        cut_lo, cut_hi = np.searchsorted(left, own, side="left"), np.searchsorted(left, own, side="right")
        cut_hi = np.where(items.start[hit] > 0, cut_hi, cut_lo)
        begin, end = first[which_range.ravel()], (first + sizes)[which_range.ravel()]
        counts = end - begin - (cut_hi - cut_lo)
        cuts = np.flatnonzero(np.diff(np.cumsum(counts) // pairs)) + 1
        for block in np.split(np.arange(len(hit)), cuts):
            wide = counts[block] * RANGE_SHARE >= end[block] - begin[block]
            for part, whole in ((block[wide], True), (block[~wide], False)):
                segment, k = _ragged(counts[part])
                at = begin[part][segment] + k
                at += np.where(at >= cut_lo[part][segment], (cut_hi - cut_lo)[part][segment], 0)
                suffix, rank = hit[part][segment], ranks[at]
                if len(suffix):
                    words = self._with_neighbours(items, hit[part], segment, rank, lo[hit[part]], hi[hit[part]]) if whole else self._with_items(items, suffix, rank)
                    yield suffix, self.places[rank], words

    def _shared_with_lower(self, ranks: np.ndarray) -> np.ndarray:
        """Words that the suffixes at some ranks share with those one rank lower.

        In the order of places a suffix shares at most one word less than the suffix
        before it, as long as what is shared can't end in a suffix without a window, so
        words are compared about once.
        """
        out = np.zeros(len(ranks), dtype=np.int64)
        if not len(ranks):
            return out
        places, lower = self.places[ranks], self.places[ranks - 1]
        most = np.minimum(self.stop[places] - places, self.stop[lower] - lower)
        by = np.argsort(places)
        numbers, last, n = self.numbers.tolist(), 0, 0
        for k, p, q, limit in zip(by.tolist(), places[by].tolist(), lower[by].tolist(), most[by].tolist(), strict=True):
            n -= p - last
            n = n if n >= self.shortest else 0
            while n < limit and numbers[p + n] == numbers[q + n]:
                n += 1
            out[k], last = n, p
        return out

    def _with_neighbours(self, items: Items, which: np.ndarray, segment: np.ndarray, rank: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Words shared with places that are much of a suffix's range: from the suffix's own place outward neighbours tell."""
        at = self._bisect(items, which, lo, hi)
        inner = np.unique(_inner(lo, hi))
        shared = self._shared_with_lower(inner)
        sizes = hi - lo
        base, out = np.cumsum(sizes) - sizes, np.zeros(int(sizes.sum()), dtype=np.int64)
        for up in (True, False):  # from the test suffix's place to both ends of its range
            far, k = _ragged(hi - at if up else at - lo)
            near = at[far] + k if up else at[far] - 1 - k
            words = np.empty(len(near), dtype=np.int64)
            begins = k == 0
            words[begins] = self._with_items(items, which[far[begins]], near[begins])
            words[~begins] = shared[np.searchsorted(inner, near[~begins] + (0 if up else 1))]
            out[base[far] + near - lo[far]] = _running_least(words, far)
        return out[base[segment] + rank - lo[segment]]


def _inner(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Ranks above the first of each range; ranges either are the same or don't meet, or lie in one another."""
    bounds = np.unique(np.stack([lo, hi], axis=1), axis=0)
    segment, k = _ragged(bounds[:, 1] - bounds[:, 0] - 1)
    return bounds[segment, 0] + 1 + k


def match_slice(batches: Iterator[tuple[pa.Array, list]], items: Items) -> Iterator[tuple[list, list[int], list[list]]]:
    """Shards of documents against one slice: (row values, word counts, matches) for each shard."""
    get = items.vocabulary.get
    rows, counts, parts, total = [], [], [], 0

    def close():
        numbers = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        starts = np.cumsum([0] + [len(p) for p in parts])[:-1]
        found = [[] for _ in rows]
        for which, places, words in SuffixShard(numbers, items.window, items.shortest).find(items):
            doc = np.searchsorted(starts, places, side="right") - 1
            for d, i, s, p, n in zip(doc.tolist(), items.item[which].tolist(), items.start[which].tolist(), (places - starts[doc]).tolist(), words.tolist(), strict=True):
                found[d].append({"item_id": items.ids[i], "item_start": s, "doc_start": p, "n_words": n})
        return rows, counts, found

    for column, values in batches:
        data, at = buffers(column)
        for k, value in enumerate(values):
            numbers = word_numbers(data[at[k] : at[k + 1]].tobytes(), get)
            rows.append(value)
            counts.append(len(numbers))
            parts.append(np.append(numbers, np.uint32(0)))
            total += len(numbers) + 1
            if total >= SHARD_WORDS:
                yield close()
                rows, counts, parts, total = [], [], [], 0
    if rows:
        yield close()


def item_slices(items: DataFrame, id_col: str, text_col: str, limit: int) -> list[DataFrame]:
    """The items cut by running size into slices of about ``limit`` bytes at most."""
    rows = items.select(F.col(id_col).cast("string").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).distinct()
    size = rows.agg(F.sum(F.octet_length("_text") + 16)).first()[0] or 0
    n = max(1, -(-int(size) * 2 // limit)) if size > limit else 1
    return [rows.where(F.pmod(F.xxhash64("_id", "_text"), F.lit(n)) == k) for k in range(n)]


def find_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", slice_bytes: int = SLICE_ITEM_BYTES) -> DataFrame:
    """Longest verbatim matches of test items in documents.

    Returns per document its id, ``n_words`` and ``matches``: item id, first word in
    the item, first word in the document, words; each match is one window at least.
    """
    spark = docs.sparkSession
    slices = item_slices(items, item_id_col, item_text_col, slice_bytes)
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = base.schema["_id"]

    def one(part: DataFrame, with_hash: bool):
        pairs = [(r["_id"], r["_text"].encode()) for r in part.collect()]  # a slice of checked size
        sent = spark.sparkContext.broadcast(Items(pairs, window))
        left = base.withColumn("_hash", F.sha2("_text", 256)) if with_hash else base
        names = [c for c in left.columns if c != "_text"]
        schema = T.StructType([id_type, *([T.StructField("_hash", T.StringType())] if with_hash else []), T.StructField("n_words", T.LongType()), T.StructField("matches", _MATCH)])
        arrow = _arrow(schema)
        left = left.select(*names, "_text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def feed():
                for b in batches:
                    yield b.column(len(names)), list(zip(*[b.column(k).to_pylist() for k in range(len(names))], strict=True))

            for rows, counts, found in match_slice(feed(), sent.value):
                columns = [pa.array([r[k] for r in rows], arrow.field(k).type) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(found, arrow.field(len(names) + 1).type)], schema=arrow)

        return left.transform(in_batches, run, schema), sent

    if len(slices) == 1:
        return one(slices[0], False)[0].withColumnRenamed("_id", id_col)
    # the passes meet by id and text; equal rows are counted and put back
    merged = None
    for part in slices:
        found, sent = one(part, True)
        found = materialize(found.groupBy("_id", "_hash", "n_words").agg(F.count(F.lit(1)).alias("_copies"), F.first("matches").alias("matches")), "matches")
        sent.destroy()
        merged = found if merged is None else merged.unionByName(found)
    merged = merged.groupBy("_id", "_hash", "n_words").agg(F.first("_copies").alias("_copies"), F.flatten(F.collect_list("matches")).alias("matches"))
    return merged.select(F.col("_id").alias(id_col), "n_words", "matches", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_k")).drop("_k")


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def hit_report(matches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: words, words inside any match, items and their digest, and whether it is hit."""
    spans = F.array_sort(F.transform("matches", lambda m: F.struct(m["doc_start"].alias("a"), (m["doc_start"] + m["n_words"]).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))

    def cover(acc, s):
        return F.struct((acc["n"] + F.greatest(s["b"] - F.greatest(s["a"], acc["to"]), F.lit(0).cast("long"))).alias("n"), F.greatest(acc["to"], s["b"]).alias("to"))

    items = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item_id"]), lambda i: i.isNotNull())))
    return matches.select(
        F.col(id_col),
        "n_words",
        F.aggregate(spans, start, cover, lambda acc: acc["n"]).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("matches") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, **names: str) -> DataFrame:
    """Documents without any window of an item; rows and columns stay as they are."""
    text_col = names.get("text_col", "text")
    item_id, item_text = names.get("item_id_col", "item_id"), names.get("item_text_col", "text")
    spark = docs.sparkSession
    kept, slices, sent = docs, item_slices(items, item_id, item_text, SLICE_ITEM_BYTES), None
    for part in slices:
        if sent is not None:  # of many slices one is held at a time
            kept, old = materialize(kept, "clean"), kept
            discard(old)
            sent.destroy()
        pairs = [(r["_id"], r["_text"].encode()) for r in part.collect()]  # a slice of checked size
        sent = spark.sparkContext.broadcast(Items(pairs, window))
        at = kept.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, at=at) -> Iterator[pa.RecordBatch]:
            waiting, clean = deque(), []  # batches whose rows a shard still holds

            def feed():
                for batch in batches:
                    waiting.append(batch)
                    yield batch.column(at), [None] * batch.num_rows

            for _, _, found in match_slice(feed(), sent.value):
                clean += [not f for f in found]
                while waiting and waiting[0].num_rows <= len(clean):
                    batch = waiting.popleft()
                    yield batch.filter(pa.array(clean[: batch.num_rows], pa.bool_()))
                    del clean[: batch.num_rows]

        kept = kept.transform(in_batches, run, kept.schema)
    return kept


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents
), items AS (SELECT DISTINCT item_id, w, least(len(w), {WINDOW}) AS n FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), windows AS (SELECT DISTINCT item_id, n, unnest([array_to_string(w[i:i + n - 1], ' ') for i in range(1, len(w) - n + 2)]) AS g FROM items
), places AS (SELECT r, n, unnest([array_to_string(w[i:i + n - 1], ' ') for i in range(1, greatest(len(w) - n + 2, 1))]) AS g, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, (SELECT DISTINCT n FROM windows)
), hits AS (SELECT r, i, n, item_id FROM places JOIN windows USING (n, g)
), covered AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS at FROM hits) GROUP BY r
), named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

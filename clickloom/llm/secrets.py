"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Patterns give candidates; their values are hashed and counted over the corpus by
distinct repositories and owners. A value that many owners or many repositories
carry is a widely copied example; a live-looking value that few owners carry in few
repositories is a credential of theirs. The base patterns' spans always stay; the ownership rule adds ``owned``
spans: long mixed tokens beside any keyword that only few owners have.

Positions come from splitting: the pieces between matches and the matches
themselves alternate, so running lengths give every start, in code points. Running
values are gathered run by run, so a text with very many hits costs in proportion.

Counting goes through partial aggregation by (value, owner, repository), so a value
or an owner with a third of all rows is combined before it moves; the counts are
written, and joined back by broadcast up to ``broadcast_keys`` values, else by an
equi-join whose sides are shuffled for it alone, so that adaptive execution splits a
value with very many findings. The scanned table is written once, so texts are searched once.

Defined results: a null text has no spans; a null owner or repository counts as one
owner or repository of its own; repeated rows each get their row and count once as
owner; null ids are kept; an empty table gives no rows; clashing names among other
columns don't matter, as all columns in work start with ``_``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from clickloom.functions.text import bound
from clickloom.llm._shared import materialize, refuse_clashes, sized

# The base patterns, by kind in the order in which ties are listed.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "owned")
#: The hex pattern with its least length: runs are maximal, so the matches kept are the same.
HEX_LONG, ACCESS_LONG = r"[0-9a-f]{32,}", r"AKIA[A-Z0-9]{12,}"
#: Candidates of the ownership rule: runs of token characters.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


#: Elements of a run in which running values are gathered by appending; longer arrays go run by run.
RUN = 128


def running(values: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """For each element of an array what ``step`` makes of all before it; ``step`` is associative.

    Arrays grow by copying, so one run over n elements costs n * n. Runs of ``RUN``
    elements, begun with what the runs before them add up to, cost about n.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")

    def one(part: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), none.alias("out"))
        return F.aggregate(part, start, lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def by_runs(array: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / RUN).cast("int")), lambda k: F.slice(array, k * RUN + 1, F.lit(RUN)))
        return bound(runs, lambda r: F.flatten(F.zip_with(r, one(F.transform(r, lambda part: F.aggregate(part, zero, step)), zero), one)))

    return bound(values, lambda v: F.when(F.size(v) > RUN, by_runs(v)).otherwise(one(v, zero)))


def _spans(text: Column, pattern: str, kind: int, value_group: int = 0, least_value: int = 0) -> Column:
    """Spans of one pattern: start, kind, end (code points) and the value that is hashed."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else hits
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    parts = F.transform(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value")), lambda p: F.struct(p["gap"].alias("gap"), F.coalesce(F.length(p["hit"]), F.lit(0)).alias("n"), p["value"].alias("value")))

    def placed(p: Column) -> Column:
        before = running(F.transform(p, lambda x: x["gap"] + x["n"]), F.lit(0), lambda at, n: at + n, "int")
        spans = F.zip_with(p, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + x["gap"] + x["n"]).alias("end"), x["value"].alias("value")))
        return F.filter(spans, lambda s: s["value"].isNotNull() & (F.length(s["value"]) >= least_value))

    return F.when(F.regexp_like(text, F.lit(pattern)), bound(parts, placed)).otherwise(F.expr(f"cast(array() as {_SPAN})"))


def _outside(tokens: Column, base: Column) -> Column:
    """Tokens that no base span meets: of all spans in order, those with no base end beyond their start before them, and no base start below their end after them."""
    far = F.lit(2**31 - 1)

    def apart(spans: Column) -> Column:
        ends = running(F.transform(spans, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b), "int")
        starts = F.reverse(running(F.reverse(F.transform(spans, lambda s: F.when(s["kind"] < 3, s["start"]).otherwise(far))), far, lambda a, b: F.least(a, b), "int"))
        kept = F.filter(F.arrays_zip(spans.alias("s"), ends.alias("e"), starts.alias("b")), lambda x: (x["s"]["kind"] == 3) & (x["e"] <= x["s"]["start"]) & (x["b"] >= x["s"]["end"]))
        return F.transform(kept, lambda x: x["s"])

    return F.when((F.size(tokens) > 0) & (F.size(base) > 0), bound(F.array_sort(F.concat(base, tokens)), apart)).otherwise(tokens)


def _live_looking(value: Column) -> Column:
    """Digits and letters mixed, ten distinct characters at least, and no placeholder word."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return F.regexp_like(value, F.lit("[0-9]")) & F.regexp_like(value, F.lit("[A-Za-z]")) & (distinct >= 10) & ~F.regexp_like(F.lower(value), F.lit("example|sample|placeholder|changeme|xxxx|0123456789|123456789"))


def scan_secrets(docs: DataFrame, text_col: str = "text", owner_col: str = "source", repo_cols: Sequence[str] = ("source", "lang"), keep: Sequence[str] = ("doc_id",), max_owners: int = 2, example_owners: int = 3, example_repositories: int = 4, out_col: str = "findings", broadcast_keys: int = 200_000) -> DataFrame:
    """Find secrets and weigh every candidate by who owns it.

    Returns ``keep`` and ``out_col``: structs of start, kind (index in KINDS), end,
    value hash, owners, repositories and verdict (``example`` from ``example_owners``
    owners or ``example_repositories`` repositories on, else ``live`` if the value looks
    so, else ``weak``), by start and kind.
    """
    refuse_clashes(keep, [out_col])
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(_spans(text, ASSIGN, 0, 2, 8), _spans(text, ACCESS_LONG, 1), _spans(text, HEX_LONG, 2))
    tokens = F.filter(_spans(text, TOKEN, 3), lambda s: _live_looking(s["value"]))
    scanned = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        *[F.col(c).alias(f"_keep_{c}") for c in keep],
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("_owner"),
        F.concat_ws("\u0000", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols]).alias("_repo"),
        base.alias("_base"),
        tokens.alias("_tokens"),
    )
    outside = _outside(F.col("_tokens"), F.col("_base"))
    scanned = scanned.withColumn("_found", F.transform(F.concat("_base", outside), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash"), _live_looking(s["value"]).alias("live"))))
    scanned = materialize(scanned.drop("_base", "_tokens"), "secret_candidates")

    kept = [F.col(f"_keep_{c}").alias(c) for c in keep]
    each = scanned.where(F.size("_found") > 0).select("_row", "_owner", "_repo", F.explode("_found").alias("_f")).select("_row", "_owner", "_repo", "_f.*")
    seen = each.groupBy("hash", "_owner", "_repo").agg(F.count(F.lit(1)).alias("_n"))
    per_owner = seen.groupBy("hash", "_owner").agg(F.count(F.lit(1)).alias("_repos"))
    owners = per_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("_repos").alias("repositories"))
    owners = materialize(owners, "secret_owners")
    verdict = F.when((F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories), "example").when(F.col("live"), "live").otherwise("weak")
    weighed = each.drop("_owner", "_repo").join(sized(owners, broadcast_keys), "hash").withColumn("verdict", verdict)
    weighed = weighed.where((F.col("kind") < 3) | ((F.col("verdict") == "live") & (F.col("owners") <= max_owners)))
    per_row = weighed.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "hash", "owners", "repositories", "verdict"))).alias("_findings"))
    with_spans = scanned.where(F.size("_found") > 0).join(per_row, "_row", "left")
    empty = F.filter(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("kind"), F.lit(0).alias("end"), F.lit("").alias("hash"), F.lit(0).cast("long").alias("owners"), F.lit(0).cast("long").alias("repositories"), F.lit("").alias("verdict"))), lambda s: s["start"] < 0)
    out = with_spans.select(*kept, F.coalesce("_findings", empty).alias(out_col))
    return out.unionByName(scanned.where(F.size("_found") == 0).select(*kept, empty.alias(out_col)))


def spans_text(findings: Column) -> Column:
    """``kind:start:end`` of the findings, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(findings, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def secret_report(scanned: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans, all spans and the verdicts' counts."""

    def count(test) -> Column:
        return F.size(F.filter("findings", test)).cast("long")

    return scanned.select(
        *[c for c in scanned.columns if c != "findings"],
        count(lambda s: s["kind"] == 0).alias("n_assign"),
        count(lambda s: s["kind"] == 1).alias("n_access"),
        count(lambda s: s["kind"] == 2).alias("n_hex"),
        F.sha2(spans_text(F.filter("findings", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        spans_text(F.col("findings")).alias("spans"),
        count(lambda s: s["verdict"] == "live").alias("n_live"),
        count(lambda s: s["verdict"] == "example").alias("n_example"),
    )


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", **options) -> DataFrame:
    """The documents with every finding replaced by ``mask``; overlapping spans become one.

    All rows and columns stay; texts without findings, null ones included, are unchanged.
    """
    scanned = scan_secrets(docs, text_col=text_col, keep=docs.columns, out_col="_secret_findings", **options)
    text = F.col(text_col)

    def cleared(spans: Column) -> Column:
        """The stretches of text between spans, and what follows the last, joined by masks."""
        seen = running(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b), "int")
        gaps = F.filter(F.zip_with(spans, seen, lambda s, at: F.struct(at.alias("a"), s["start"].alias("b"))), lambda g: g["a"] <= g["b"])
        last = F.struct(F.array_max(F.transform(spans, lambda s: s["end"])).alias("a"), F.length(text).alias("b"))
        return bound(F.concat(gaps, F.array(last)), lambda g: F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(g) - 1) / RUN).cast("int")), lambda k: bound(F.slice(g, k * RUN + 1, F.lit(RUN)), run)), mask))

    def run(gaps: Column) -> Column:
        """The stretches of a run, cut from its own part of the text: finding a place takes time in proportion to it."""
        begin = gaps[0]["a"]
        part = F.substring(text, begin + 1, F.element_at(gaps, -1)["b"] - begin)
        return bound(part, lambda p: F.array_join(F.transform(gaps, lambda g: F.substring(p, g["a"] - begin + 1, g["b"] - g["a"])), mask))

    clean = bound(F.col("_secret_findings"), cleared)
    return scanned.select(*[(F.when(F.size("_secret_findings") > 0, clean).otherwise(text).alias(c) if c == text_col else F.col(c)) for c in docs.columns])


def _sql_spans(name: str, pattern: str, kind: int, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""{name} AS (
  SELECT r, start, {kind} AS kind, start + length(hit) AS stop, value FROM (
    SELECT r, hit, value, sum(gap) OVER w + coalesce(sum(length(hit)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (
      SELECT r, unnest(range(len(hits))) AS i, unnest(hits) AS hit, unnest(vals) AS value, unnest([length(g) for g in gaps[1:len(hits)]]) AS gap FROM (
        SELECT r, regexp_extract_all(t, '{quoted}') AS hits, regexp_extract_all(t, '{quoted}', {group}) AS vals, regexp_split_to_array(t, '{quoted}') AS gaps
        FROM docs WHERE regexp_matches(t, '{quoted}')))
    WINDOW w AS (PARTITION BY r ORDER BY i)) WHERE length(value) >= {least})"""


_LIVE = "regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 10 AND NOT regexp_matches(lower(value), 'example|sample|placeholder|changeme|xxxx|0123456789|123456789')"

ORACLE_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, coalesce(source, '') || chr(1) || coalesce(lang, '') AS repo FROM documents
), {_sql_spans("a", ASSIGN, 0, 2, 8)}, {_sql_spans("b", ACCESS, 1, 0, 16)}, {_sql_spans("c", HEX, 2, 0, 32)}, {_sql_spans("tokens", TOKEN, 3, 0, 0)},
base AS (FROM a UNION ALL FROM b UNION ALL FROM c),
found AS (
  SELECT *, {_LIVE} AS live FROM base
  UNION ALL SELECT *, true FROM tokens t WHERE {_LIVE}
    AND NOT EXISTS (SELECT 1 FROM base x WHERE x.r = t.r AND t.start < x.stop AND x.start < t.stop)
), owners AS (
  SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repositories FROM found JOIN docs USING (r) GROUP BY value
), weighed AS (
  SELECT found.*, owners, CASE WHEN owners >= 3 OR repositories >= 4 THEN 'example' WHEN live THEN 'live' ELSE 'weak' END AS verdict FROM found JOIN owners USING (value)
), chosen AS (
  SELECT *, (['assign', 'access', 'hex', 'owned'])[kind + 1] || ':' || start || ':' || stop AS s FROM weighed WHERE kind < 3 OR (verdict = 'live' AND owners <= 2)
)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(s, ',' ORDER BY start, kind, stop) FILTER (kind < 3), '')) AS base_sha256,
  coalesce(string_agg(s, ',' ORDER BY start, kind, stop), '') AS spans,
  count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example
FROM docs d LEFT JOIN chosen USING (r) GROUP BY r, d.doc_id
"""

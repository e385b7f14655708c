"""Chat formatting by incremental black-box rendering.

A template is any function from turns to a string. To find where a turn stands in
its output, the prefixes of a conversation are rendered one after another: what
prefix k adds to prefix k - 1 is the span of turn k, and rendering prefix k once
more with a sentinel for its text shows where in the span the text begins and
ends. A template whose output for a prefix doesn't begin with the output for the
shorter one rewrites history; that is detected, and such a conversation has no
spans and no loss. Rendering all prefixes costs the square of a conversation's
length, as it must where nothing is known of the template.

Rows are dealt by conversation, sorted, and read as a stream, so a task holds one
conversation at a time and never the rows of others.

Defined results: null roles and texts are empty; a null conversation id is one
conversation; equal turn numbers are ordered by role, then text; repeated rows
are turns each; an empty table gives no conversations; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clickloom.llm._shared import in_batches

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

# Control strings of the default template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_STARTS = re.compile("(?=(" + "|".join(map(re.escape, CONTROL)) + "))")
_MARKS = re.compile("\ue000+")
_TURN = re.compile(r"\[INST\]((?:[^\\\n]|\\.)*)\n(.*?)\[/INST\]", re.DOTALL)


def escape(text: str) -> str:
    """Double backslashes, then put one behind the first character of each control string."""
    doubled = text.replace("\\", "\\\\")
    out, at = [], 0
    for m in _STARTS.finditer(doubled):
        out += [doubled[at : m.start() + 1], "\\"]
        at = m.start() + 1
    return "".join([*out, doubled[at:]])


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


class _Written(dict):
    """Turns as the default template writes them; prefixes of one conversation repeat them. It starts over when full."""

    #: Characters that it holds.
    FULL = 1 << 20

    def __init__(self):
        super().__init__()
        self.size = 0

    def __missing__(self, turn: Turn) -> str:
        role, text = turn
        out = "".join(["[INST]", escape(role).replace("\n", "\\\n"), "\n", escape(text), "[/INST]"])
        if self.size > self.FULL:
            self.clear()
            self.size = 0
        self.size += 2 * len(out)
        self[turn] = out
        return out


_written = _Written()


def default_template(turns: Sequence[Turn]) -> str:
    """Turns between markers: ``<s>``, then ``[INST]role``, a line break, the text, ``[/INST]`` each."""
    return "".join(["<s>", *map(_written.__getitem__, turns)])


def parse_default(formatted: str) -> list[Turn]:
    """The turns of the default template's output."""
    if not formatted.startswith("<s>"):
        raise ValueError("no start marker")
    turns, at = [], 3
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


@dataclass(frozen=True)
class Rendering:
    """A rendered conversation; ``texts`` are each turn's text span, in code points."""

    formatted: str
    spans: list[tuple[int, int]]
    texts: list[tuple[int, int]]
    rewrites: bool


def render(turns: Sequence[Turn], template: Template = default_template) -> Rendering:
    """Render all prefixes and locate every turn and its text in the last output."""
    before, spans, texts = template([]), [], []
    rewrites = False
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        role, text = turns[k - 1]
        longest = max(map(len, _MARKS.findall(role) + _MARKS.findall(text)), default=0)
        sentinel = "\ue000" * (longest + 1)  # a longer run than the turn has itself
        probe = template([*turns[: k - 1], (role, sentinel)])
        at = probe.find(sentinel, len(before)) if now.startswith(before) and probe.startswith(before) else -1
        end = len(now) - (len(probe) - at - len(sentinel))
        if at < 0 or end < at or now[:at] != probe[:at] or now[end:] != probe[at + len(sentinel) :]:
            rewrites = True
            before = now
            continue
        spans.append((len(before), len(now)))
        texts.append((at, end))
        before = now
    return Rendering(before, [], [], True) if rewrites else Rendering(before, spans, texts, False)


def format_conversations(rows: DataFrame, template: Template = default_template, loss_roles: Sequence[str] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", n_partitions: int | None = None) -> DataFrame:
    """A row for each conversation: id, ``formatted``, ``spans``, ``loss_spans`` (code points), ``rewrites_history``."""
    base = rows.select(F.col(conv_col).cast("long").alias("_c"), F.col(turn_col).alias("_t"), F.coalesce(F.col(role_col), F.lit("")).alias("_r"), F.coalesce(F.col(text_col), F.lit("")).alias("_x"))
    dealt = base.repartition("_c") if n_partitions is None else base.repartition(n_partitions, "_c")
    dealt = dealt.sortWithinPartitions("_c", "_t", "_r", "_x").select("_c", "_r", "_x")
    loss = set(loss_roles)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every():
            for b in batches:
                for k in range(0, b.num_rows, 512):
                    yield from zip(*(c.to_pylist() for c in b.slice(k, 512).columns), strict=True)

        def pack(out):
            pairs = [[[{"start": a, "end": b} for a, b in x] for x in (r.spans, [t for t, (role, _) in zip(r.texts, turns, strict=False) if role in loss])] for _, turns, r in out]
            return pa.RecordBatch.from_arrays(
                [pa.array([c for c, _, _ in out], pa.int64()), pa.array([r.formatted for _, _, r in out], pa.string()), pa.array([p[0] for p in pairs], span), pa.array([p[1] for p in pairs], span), pa.array([r.rewrites for _, _, r in out], pa.bool_())],
                names=[conv_col, "formatted", "spans", "loss_spans", "rewrites_history"],
            )

        out, size = [], 0
        for conv, group in groupby(every(), key=lambda r: r[0]):
            turns = [(role, text) for _, role, text in group]
            out.append((conv, turns, render(turns, template)))
            size += len(out[-1][2].formatted)
            if size > 1 << 20:
                yield pack(out)
                out, size = [], 0
        if out:
            yield pack(out)

    kinds = "array<struct<start:long,end:long>>"
    return dealt.transform(in_batches, run, f"`{conv_col}` long, formatted string, spans {kinds}, loss_spans {kinds}, rewrites_history boolean")


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Turns and loss text as the formatted strings and masks give them back: id, roles, texts, loss_text, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                strings, masks = part.column(1).to_pylist(), part.column(2).to_pylist()
                turns = [parse_default(s) for s in strings]
                loss = ["".join(unescape(s[m["start"] : m["end"]]) for m in mask) for s, mask in zip(strings, masks, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([[r for r, _ in t] for t in turns], pa.list_(pa.string())), pa.array([[x for _, x in t] for t in turns], pa.list_(pa.string())), pa.array(loss, pa.string()), pa.array([len(s) for s in strings], pa.int64())],
                    names=[conv_col, "roles", "texts", "loss_text", "formatted_chars"],
                )

    return formatted.select(conv_col, "formatted", "loss_spans").transform(in_batches, run, f"`{conv_col}` long, roles array<string>, texts array<string>, loss_text string, formatted_chars long")


#: The conversation that the query adds: control strings as ordinary text.
ADVERSARIAL = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def _sql_escape(x: str) -> str:
    x = f"replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        x = f"replace({x}, '{c}', '{c[0]}\\{c[1:]}')"
    return x


ORACLE_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, 14 + length(replace({_sql_escape("role")}, chr(10), '\\' || chr(10))) + length({_sql_escape("text")}) AS chars FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(chars))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

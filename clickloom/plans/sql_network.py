"""Forward passes of small networks as SQL, to hold the models against other code.

Weights come from a formula of their place that Spark's side and SQL's side both
write down, so nothing but the formula is shared. ``Network`` adds a column of a list
for each step; tokens are lists of lists.
"""

from __future__ import annotations

import numpy as np

from clickloom.models.layers import Model


def formula_parameters(model: Model) -> dict[str, np.ndarray]:
    """Small weights by the number of the parameter and the place in it."""
    out = {}
    for k, (name, shape) in enumerate(model.shapes.shapes.items()):
        j = np.arange(shape[-1])
        if name.endswith(".g"):
            out[name] = 1 + ((j + k) % 5 - 2) / 10
        elif name.endswith(".var"):
            out[name] = 1 + ((j + k) % 3) / 10
        elif len(shape) == 1:
            out[name] = ((3 * j + 5 * k) % 7 - 3) / 40
        else:
            out[name] = ((7 * np.arange(shape[0])[:, None] + 3 * j + 5 * k) % 11 - 5) / 40
    return out


class Network:
    """SQL of a forward pass over a relation with an id and list columns."""

    def __init__(self, model: Model, start: str):
        self.number = {name: k for k, name in enumerate(model.shapes.shapes)}
        self.shape = model.shapes.shapes
        self.steps, self.n = [f"s0 AS ({start})"], 0

    def add(self, expr: str) -> str:
        self.n += 1
        self.steps.append(f"s{self.n} AS (SELECT *, {expr} AS c{self.n} FROM s{self.n - 1})")
        return f"c{self.n}"

    def weight(self, name: str, i: str, j: str) -> str:
        return f"((((7 * {i} + 3 * {j} + {5 * self.number[name]}) % 11) - 5) / 40.0::DOUBLE)"

    def small(self, name: str, j: str) -> str:
        return f"((((3 * {j} + {5 * self.number[name]}) % 7) - 3) / 40.0::DOUBLE)"

    def _product(self, name: str, x: str) -> str:
        rows, columns = self.shape[name]
        return f"[list_sum([{x}[(i + 1)::BIGINT] * {self.weight(name, 'i', 'j')} for i in range({rows})])"

    def linear(self, name: str, x: str, tokens: bool = False) -> str:
        one = f"{self._product(f'{name}.w', 't' if tokens else x)} + {self.small(f'{name}.b', 'j')} for j in range({self.shape[f'{name}.w'][1]})]"
        return self.add(f"[{one} for t in {x}]" if tokens else one)

    def norm(self, name: str, x: str) -> str:
        n = self.shape[f"{name}.g"][0]
        mean = self.add(f"list_sum({x}) / {n}")
        spread = self.add(f"list_sum([(v - {mean}) * (v - {mean}) for v in {x}]) / {n} + 1e-5::DOUBLE")
        gain = f"(1 + (((j + {self.number[f'{name}.g']}) % 5) - 2) / 10.0::DOUBLE)"
        return self.add(f"[({x}[(j + 1)::BIGINT] - {mean}) / sqrt({spread}) * {gain} + {self.small(f'{name}.o', 'j')} for j in range({n})]")

    def each(self, x: str, of: str) -> str:
        """``of`` refers to a number as v."""
        return self.add(f"[{of} for v in {x}]")

    def relu(self, x: str) -> str:
        return self.each(x, "greatest(v, 0)")

    def swish(self, x: str) -> str:
        return self.each(x, "v / (1 + exp(-v))")

    def sigmoid(self, x: str) -> str:
        return self.each(x, "1 / (1 + exp(-v))")

    def clip(self, x: str, most: int) -> str:
        return self.each(x, f"greatest(least(v, {most}), -{most})")

    def glu(self, x: str, n: int) -> str:
        return self.add(f"[{x}[(j + 1)::BIGINT] / (1 + exp(-{x}[(j + 1 + {n // 2})::BIGINT])) for j in range({n // 2})]")

    def concat(self, *parts: str) -> str:
        out = parts[0]
        for p in parts[1:]:
            out = f"list_concat({out}, {p})"
        return self.add(out)

    def zip(self, n: int, of: str, **names: str) -> str:
        """``of`` refers to the numbers at one place by the names."""
        for name, column in names.items():
            of = of.replace(f"<{name}>", f"{column}[(j + 1)::BIGINT]")
        return self.add(f"[{of} for j in range({n})]")

    def tokens(self, x: str, n: int, width: int) -> str:
        return self.add(f"[{x}[(t * {width} + 1)::BIGINT:(t * {width} + {width})::BIGINT] for t in range({n})]")

    def attend(self, name: str, query: str, other: str, heads: int, n: int, width: int) -> str:
        """The mean over the query's tokens of multi-head attention."""
        q, k, v = self.linear(f"{name}.q", query, True), self.linear(f"{name}.k", other, True), self.linear(f"{name}.v", other, True)
        each = width // heads
        place = f"(h * {each} + d + 1)::BIGINT"
        met = self.add(f"[[[exp(list_sum([x[{place}] * y[{place}] for d in range({each})]) / sqrt({each}::DOUBLE)) for y in {k}] for h in range({heads})] for x in {q}]")
        share = f"list_sum([a[(j // {each} + 1)::BIGINT][(c + 1)::BIGINT] * {v}[(c + 1)::BIGINT][(j + 1)::BIGINT] for c in range({n})]) / list_sum(a[(j // {each} + 1)::BIGINT])"
        out = self.linear(f"{name}.out", self.add(f"[[{share} for j in range({width})] for a in {met}]"), True)
        return self.add(f"[list_sum([t[(j + 1)::BIGINT] for t in {out}]) / {n} for j in range({width})]")

    def sql(self, select: str) -> str:
        return f"WITH {', '.join(self.steps)} SELECT {select} FROM s{self.n}"


def concat_fusion(net: Network, a: str, b: str, hidden: int) -> str:
    sides = [net.norm(f"fusion.{s}.n", net.relu(net.linear(f"fusion.{s}", x))) for s, x in (("kg", a), ("text", b))]
    return net.norm("fusion.mix.n", net.relu(net.linear("fusion.mix", net.concat(*sides))))


def cross_attention_fusion(net: Network, a: str, b: str, hidden: int, heads: int) -> str:
    n, inputs = max(heads, 2), {"kg": a, "text": b}
    side = {s: net.norm(f"fusion.{s}.n", net.swish(net.linear(f"fusion.{s}", x))) for s, x in inputs.items()}
    tok = {s: net.tokens(net.linear(f"fusion.{s}.tokens", x), n, hidden) for s, x in side.items()}
    met = {s: net.attend(f"fusion.{s}.attn", tok[s], tok[o], heads, n, hidden) for s, o in (("kg", "text"), ("text", "kg"))}
    gate = net.sigmoid(net.linear("fusion.gate.2", net.norm("fusion.gate.n", net.swish(net.linear("fusion.gate.1", net.concat(side["kg"], met["kg"], side["text"], met["text"]))))))
    rest = net.norm("fusion.res.n", net.linear("fusion.res", net.concat(a, b)))
    x = net.zip(hidden, "(<g> * <m> + (1 - <g>) * <s> + <g> * <u> + (1 - <g>) * <t>) / 2 + <r>", g=gate, m=met["kg"], s=side["kg"], u=met["text"], t=side["text"], r=rest)
    inner = net.norm("fusion.ffn.n1", net.glu(net.linear("fusion.ffn.1", x), hidden))
    return net.zip(hidden, "<x> + <f>", x=x, f=net.norm("fusion.ffn.n2", net.linear("fusion.ffn.2", inner)))


def interaction_fusion(net: Network, a: str, b: str, hidden: int, heads: int) -> str:
    n = max(heads, 2)
    tok = {s: net.tokens(net.linear(f"fusion.{s}.tokens", net.norm(f"fusion.{s}.n", net.linear(f"fusion.{s}", x))), n, hidden) for s, x in (("kg", a), ("text", b))}
    met = [net.attend(f"fusion.{s}.attn", tok[s], tok[o], heads, n, hidden) for s, o in (("kg", "text"), ("text", "kg"))]
    return net.zip(hidden, "<m> + <r>", m=net.linear("fusion.mix", net.concat(*met)), r=net.linear("fusion.res", a))


def gate(net: Network, name: str, x: str, n: int) -> str:
    return net.zip(n, "<x> * <g>", x=x, g=net.sigmoid(net.linear(f"{name}.2", net.swish(net.linear(f"{name}.1", x)))))


def mlp_head(net: Network, x: str, n: int) -> str:
    return net.linear("head.out", net.norm("head.h0.n", net.relu(net.linear("head.h0", gate(net, "head.gate", x, n)))))


def cross_fm_head(net: Network, x: str, n: int, layers: int = 3) -> str:
    hidden, width, factors = net.shape["head.in.w"][1], *net.shape["head.fm.v"]
    c = net.norm("head.in.n", net.swish(net.linear("head.in", x)))
    for k in range(layers):
        c = net.norm(f"head.cross{k}.n", net.zip(hidden, "<c> + <c> * <l>", c=c, l=net.linear(f"head.cross{k}", c)))
    c = net.norm("head.cross.n", c)
    f = net.norm("head.fm.n", net.swish(net.linear("head.fm", x)))
    f = net.zip(width, "<f> * <g>", f=f, g=net.sigmoid(net.linear("head.fm.gate", f)))
    at, v = f"{f}[(i + 1)::BIGINT]", net.weight("head.fm.v", "i", "j")
    second = net.add(f"list_sum([pow(list_sum([{at} * {v} for i in range({width})]), 2) - list_sum([pow({at} * {v}, 2) for i in range({width})]) for j in range({factors})]) / 2")
    fm = net.zip(1, f"<l> + {second}", l=net.linear("head.fm.first", f))
    return net.linear("head.out", net.norm("head.mix.n", net.swish(net.linear("head.mix", net.concat(c, fm)))))


def cross_modal_fm_head(net: Network, x: str, n: int) -> str:
    a, b = net.linear("head.kg", x), net.linear("head.text", x)
    (kg, factors), (text, _) = net.shape["head.kg.v"], net.shape["head.text.v"]
    met = f"list_sum([{net.weight('head.kg.v', 'i', 'j')} * {net.weight('head.text.v', 'i', 'j')} for j in range({factors})])"
    both = net.add(f"list_sum([{a}[(i + 1)::BIGINT] * {b}[(i + 1)::BIGINT] * {met} for i in range({min(kg, text)})])")
    return net.zip(1, f"<l> + {both}", l=net.linear("head.first", x))


FUSIONS = {"concat": concat_fusion, "cross_attention_gated": cross_attention_fusion, "cross_modal_interaction": interaction_fusion}
HEADS = {"mlp_final": mlp_head, "dcnv3_fm": cross_fm_head, "cross_modal_fm": cross_modal_fm_head}


def forward_sql(model: Model, fusion: str, head: str, mode: str, hidden: int, heads: int) -> str:
    """Logit and probability of the embeddings' halves."""
    net = Network(model, "SELECT vec_id, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b FROM embeddings")
    a, b = net.clip("a", 10), net.clip("b", 10)
    if mode == "kg_text_fusion":
        x, n = FUSIONS[fusion](net, a, b, hidden, *([] if fusion == "concat" else [heads])), hidden
    else:
        x, n = a if mode == "only_kg" else b, 32
    logit = net.clip(HEADS[head](net, x, n), 5)
    return net.sql(f"vec_id, round({logit}[1], 6) AS logit, round(1 / (1 + exp(-{logit}[1])), 6) AS probability")


def graph_sql(model: Model, features: str) -> str:
    """Core vectors of the two attention layers; ``features`` gives CTEs n0 (sample_id, entity, is_core, x) and edges (sample_id, head, tail, w)."""
    net, steps = Network(model, "SELECT 1"), [features]

    def normed(name: str, x: str, relu: bool) -> str:
        n, k = net.shape[f"{name}.g"][0], net.number
        value = f"({x}[(j + 1)::BIGINT] - {net.small(f'{name}.mean', 'j')}) / sqrt(1 + ((j + {k[f'{name}.var']}) % 3) / 10.0::DOUBLE + 1e-5::DOUBLE) * (1 + (((j + {k[f'{name}.g']}) % 5) - 2) / 10.0::DOUBLE) + {net.small(f'{name}.o', 'j')}"
        return f"[{f'greatest({value}, 0)' if relu else value} for j in range({n})]"

    def layer(k: int, x: str) -> None:
        """From n{k}.x to n{k + 1}.x."""
        name, (heads, twice) = f"g{k + 1}", net.shape[f"g{k + 1}.a"]
        each, width = twice // 2, heads * twice // 2
        rest = (f"[list_sum([x[(i + 1)::BIGINT] * {net.weight(f'{name}.res.w', 'i', 'j')} for i in range({net.shape[f'{name}.w'][0]})]) + {net.small(f'{name}.res.b', 'j')} for j in range({width})]" if f"{name}.res.w" in net.shape else "x")
        half = lambda off: f"[list_sum([h[(g * {each} + d + 1)::BIGINT] * {net.weight(f'{name}.a', 'g', f'(d + {off})')} for d in range({each})]) for g in range({heads})]"
        steps.extend([
            f"x{k} AS (SELECT sample_id, entity, is_core, {x} AS x FROM n{k})",
            f"h{k} AS (SELECT *, {net._product(f'{name}.w', 'x')} for j in range({width})] AS h, {rest} AS rest FROM x{k})",
            f"a{k} AS (SELECT *, {half(0)} AS s, {half(each)} AS t FROM h{k})",
            f"e{k} AS (SELECT p.sample_id, p.tail, g, a.h, a.s[(g + 1)::BIGINT] + b.t[(g + 1)::BIGINT] AS z, w FROM edges p JOIN a{k} a ON a.sample_id = p.sample_id AND a.entity = p.head JOIN a{k} b ON b.sample_id = p.sample_id AND b.entity = p.tail, range({heads}) r(g))",
            f"f{k} AS (SELECT *, exp((CASE WHEN z >= 0 THEN z ELSE z * 0.2::DOUBLE END) * w) AS v FROM e{k})",
            f"q{k} AS (SELECT *, v / (sum(v) OVER (PARTITION BY sample_id, tail, g) + 1e-8::DOUBLE) AS alpha FROM f{k})",
            f"m{k} AS (SELECT sample_id, tail, g * {each} + d AS j, sum(alpha * h[(g * {each} + d + 1)::BIGINT]) AS v FROM q{k}, range({each}) r(d) GROUP BY ALL)",
            f"l{k} AS (SELECT sample_id, tail, list(v ORDER BY j) AS v FROM m{k} GROUP BY ALL)",
            f"n{k + 1} AS (SELECT h.sample_id, entity, is_core, [rest[(j + 1)::BIGINT] + coalesce(v[(j + 1)::BIGINT], 0) for j in range({width})] AS x FROM h{k} h LEFT JOIN l{k} l ON l.sample_id = h.sample_id AND l.tail = h.entity)",
        ])

    layer(0, normed("bn1", "x", False))
    layer(1, normed("bn2", "x", True))
    n_out = net.shape["g2.a"][1] // 2
    return f"WITH {', '.join(steps)}, v AS (SELECT sample_id, [greatest(y, 0) for y in x] AS v FROM n2 WHERE is_core) SELECT sample_id, unnest(range({n_out}))::INTEGER AS pos, round(unnest([y / sqrt(list_sum([z * z for z in v]) + 1e-24::DOUBLE) for y in v]), 6) AS x FROM v"

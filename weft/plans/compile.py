"""Query documents as DataFrame plans.

A solution table has one column for each variable, the score, the matches, and ``ord``: the path
of choices (candidate gids, distances, branch numbers) that led to the row. The least ``ord`` for
each return key is the solution a depth-first search in gid order would have met first. Whether a
variable is bound is known while compiling: BOUND, not there, or MAYBE (bound in some branches
of an ``any`` only); a MAYBE variable splits the table at its nulls.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count, groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import names, text
from weft.operators.traverse import reach
from weft.plans import ast
from weft.plans.ast import Expr, Literal, Var
from weft.plans.conjunction import CONDITIONS, LEAVES, Conjunction, can_join, flattened
from weft.plans.conjunction import column as _c
from weft.plans.conjunction import is_literal as _is
from weft.plans.session import cut
from weft.sources.graph import PropertyGraph

BOUND, MAYBE = 2, 1
_LEVELS = count()


@dataclass(frozen=True)
class State:
    """df is None for the single empty solution."""

    df: DataFrame | None
    bound: dict

    def col(self, v: str) -> Column:
        return F.col(_c(v))


def _match(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


class Compiler:
    """``window`` bounds the candidates of a query's first choice, (variable, after, up to); ``trace`` tells what was built."""

    def __init__(self, graph: PropertyGraph, window: tuple | None = None):
        self.graph, self.window = graph, window
        self.trace: list[tuple[int, int]] = []

    # Candidate tables join the solutions here.

    def _add(self, s: State, table: DataFrame, sides: dict, score: Column, matches: list[Column]) -> State:
        """Join table to s. sides: column of table -> selector; other columns feed score and ord."""
        for side, sel in sides.items():
            if isinstance(sel, Literal):
                table = table.where(_is(F.col(side), sel))
        variables: dict[str, list[str]] = {}
        for side, sel in sides.items():
            if isinstance(sel, Var):
                variables.setdefault(sel.key, []).append(side)
        for places in variables.values():
            for other in places[1:]:
                table = table.where(F.col(places[0]) == F.col(other))
        maybe = [v for v in variables if s.bound.get(v) == MAYBE]
        if maybe:
            v = maybe[0]
            known = State(s.df.where(s.col(v).isNotNull()), {**s.bound, v: BOUND})
            free = State(s.df.where(s.col(v).isNull()).drop(_c(v)), {k: b for k, b in s.bound.items() if k != v})
            return self._union([self._add(x, table, sides, score, matches) for x in (known, free)])
        dist = [c for c in table.columns if c == "dist"]
        fresh = [v for v in variables if v not in s.bound]
        order = [F.lpad(F.col(c).cast("string"), 6, "0") for c in dist] + [F.col(variables[v][0]) for v in fresh]
        gain = score.cast("double").alias("_gain")
        picked = table.select(
            *(F.col(p[0]).alias("_" + _c(v)) for v, p in variables.items()), gain, F.array(*matches).alias("_matches"),
            F.array(*order).cast("array<string>").alias("_order")
        )
        if s.df is None:
            out = picked.select(
                *(F.col("_" + _c(v)).alias(_c(v)) for v in fresh), F.col("_gain").alias("score"), F.col("_matches").alias("matched"),
                F.col("_order").alias("ord")
            )
            return State(out, {v: BOUND for v in fresh})
        on = [s.col(v) == F.col("_" + _c(v)) for v in variables if v in s.bound]
        both = s.df.join(picked, reduce(Column.__and__, on)) if on else s.df.crossJoin(picked)
        out = both.select(
            *(_c(v) for v in s.bound), *(F.col("_" + _c(v)).alias(_c(v)) for v in fresh), (F.col("score") + F.col("_gain")).alias("score"),
            F.concat("matched", "_matches").alias("matched"), F.concat("ord", "_order").alias("ord")
        )
        return State(out, {**s.bound, **{v: BOUND for v in fresh}})

    def _union(self, states: list[State]) -> State:
        every = {v for s in states for v in s.bound}
        bound = {v: BOUND if all(s.bound.get(v) == BOUND for s in states) else MAYBE for v in sorted(every)}
        cols = lambda s: s.df.select(*((s.col(v) if v in s.bound else F.lit(None).cast("string")).alias(_c(v)) for v in bound), "score", "matched", "ord")
        return State(reduce(DataFrame.unionByName, (cols(s) for s in states)), bound)

    def _rows(self, s: State) -> State:
        """s with a table, even for the single empty solution."""
        if s.df is not None:
            return s
        one = self.graph.spark.range(1).select(F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("matched"), F.array().cast("array<string>").alias("ord"))
        return State(one, {})

    def eval(self, e: Expr, s: State) -> State:
        return getattr(self, "_" + e.kind)(e, s)

    def _all(self, e: Expr, s: State) -> State:
        """Runs of leaf predicates are one join; the others hold one after the other."""
        for leaves, run in groupby(flattened(e), lambda c: c.kind in LEAVES):
            block = list(run)
            if leaves and can_join(block, s.bound, MAYBE):
                s = self._block(block, s)
            else:
                for child in block:
                    s = self.eval(child, s)
        return s

    def _block(self, block: list[Expr], s: State) -> State:
        mine = {v for e in block for v in ast.variables(e)}
        outer = {v: s.df.select(_c(v)).distinct() for v in s.bound if v in mine}
        window, self.window = self.window, None
        plan = Conjunction(self.graph, block, outer, window)
        df = plan.joined()
        self.trace += plan.trace
        fresh = [v for v in plan.variables if v not in s.bound]
        score, matched, order = F.lit(0.0), F.array().cast("array<string>"), F.array().cast("array<string>")
        if s.df is not None:
            score, matched, order = F.col("score"), F.col("matched"), F.col("ord")
            df = s.df.join(df, [_c(v) for v in outer]) if outer else s.df.crossJoin(df)
        for step in plan.steps:
            score = score + step.score.cast("double")
        matched = F.concat(matched, F.array(*(m for step in plan.steps for m in step.matches)))
        choices = [c for step in plan.steps for c in step.choices]
        order = F.concat(order, F.array(*choices).cast("array<string>"))
        bound = {**s.bound, **{v: BOUND for v in fresh}}
        return State(df.select(*(_c(v) for v in bound), *self._carried(), score.alias("score"), matched.alias("matched"), order.alias("ord")), bound)

    def _any(self, e: Expr, s: State) -> State:
        s = self._rows(s)
        out = []
        for k, child in enumerate(e.children):
            branch = State(s.df.withColumn("ord", F.concat("ord", F.array(F.lit(f"{k:06d}")))), s.bound)
            out.append(self.eval(child, branch))
        return self._union(out)

    def _inner(self, e: Expr, s: State) -> tuple[dict[str, str], State]:
        """The child evaluated on the distinct outer bindings it can see, from score 0.

        Also the columns under which those bindings are found in the result, by variable.
        """
        child = e.children[0]
        shared = {v: f"k{next(_LEVELS)}_{v}" for v in sorted(ast.variables(child)) if v in s.bound}
        if not shared:
            return {}, Compiler(self.graph).eval(child, State(None, {}))
        keys = s.df.select(*(_c(v) for v in shared)).distinct()
        start = keys.select("*", F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("matched"), F.array().cast("array<string>").alias("ord"))
        # Outer bindings travel under names of their own: inner predicates may bind a null one.
        kept = start.select("*", *(F.col(_c(v)).alias(k) for v, k in shared.items()))
        inner = _Carrying(self.graph, list(shared.values()))
        return shared, inner.eval(child, State(kept, {v: s.bound[v] for v in shared}))

    def _not(self, e: Expr, s: State) -> State:
        s = self._rows(s)
        shared, inner = self._inner(e, s)
        if not shared:
            none = self._rows(inner).df.limit(1).agg(F.count(F.lit(1)).alias("_n"))
            df = s.df.crossJoin(none).where("_n = 0").drop("_n")
        else:
            keys = inner.df.select(*shared.values()).distinct()
            df = s.df.join(keys, self._equal(s, shared), "left_anti")
        return State(df.withColumn("matched", F.concat("matched", F.array(F.lit("not")))), s.bound)

    def _exists(self, e: Expr, s: State) -> State:
        s = self._rows(s)
        shared, inner = self._inner(e, s)
        inner = self._rows(inner)
        if not shared:
            best = inner.df.agg(F.max("score").alias("_best")).where("_best is not null")
            df = s.df.crossJoin(best)
        else:
            best = inner.df.groupBy(*shared.values()).agg(F.max("score").alias("_best"))
            df = s.df.join(best, self._equal(s, shared))
        return State(
            df.select(
                *(_c(v) for v in s.bound), *self._carried(), (F.col("score") + F.greatest(F.lit(0.0), "_best")).alias("score"),
                F.concat("matched", F.array(F.lit("exists"))).alias("matched"), "ord"
            ),
            s.bound
        )

    @staticmethod
    def _equal(s: State, shared: dict[str, str]) -> Column:
        return reduce(Column.__and__, (s.col(v).eqNullSafe(F.col(k)) if s.bound[v] == MAYBE else s.col(v) == F.col(k) for v, k in shared.items()))

    def _carried(self) -> list[str]:
        return []

    # Predicates on one node.

    def _node(self, e: Expr, s: State) -> State:
        sel = e.nodes["node"]
        if isinstance(sel, Var) and s.bound.get(sel.key) == BOUND:  # it came from the node table
            return State(s.df.withColumn("score", F.col("score") + 0.05).withColumn("matched", F.concat("matched", F.array(F.lit("node")))), s.bound)
        return self._add(s, self.graph.nodes.select("gid"), {"gid": sel}, F.lit(0.05), [F.lit("node")])

    def _name(self, e: Expr, s: State) -> State:
        op, value = e.args["operator"], e.args["value"]
        table = self.graph.nodes.where(text.text_op(F.col("gid"), op, value)).select("gid")
        return self._add(s, table, {"gid": e.nodes["node"]}, F.lit(text.name_score(op)), [F.lit(f"name:{op}:{value}")])

    def _attribute(self, e: Expr, s: State) -> State:
        key, op = e.args["key"], e.args["operator"]
        table = self.graph.nodes.where(text.attribute_op(F.col("attrs"), key, op, e.args["value"])).select("gid")
        return self._add(s, table, {"gid": e.nodes["node"]}, F.lit(0.65), [F.lit(f"attribute:{key}:{op}")])

    def _text(self, e: Expr, s: State) -> State:
        value = e.args["value"]
        table = self.graph.nodes.select("gid", text.text_score(F.col("gid"), F.col("attrs"), value).alias("points")).where("points > 0")
        return self._add(s, table, {"gid": e.nodes["node"]}, F.col("points"), [F.lit(f"text:{value}")])

    def _degree(self, e: Expr, s: State) -> State:
        op, value = e.args["operator"], e.args["value"]
        table = self.graph.degree().where(text.number_op(F.col("degree"), op, value)).select("gid")
        return self._add(s, table, {"gid": e.nodes["node"]}, F.lit(0.45), [F.lit(f"degree:{op}:{value}")])

    # Predicates on two nodes.

    def _connected(self, e: Expr, s: State) -> State:
        table = self.graph.neighbours.select(F.col("src").alias("left"), F.lit(1).alias("dist"), F.col("dst").alias("right"))
        return self._add(s, table, e.nodes, F.lit(0.7), [F.lit("connected:depth=1")])

    def _path(self, e: Expr, s: State) -> State:
        left, right = e.nodes["left"], e.nodes["right"]
        # Distances are symmetric: start from a literal end, else from a bound one.
        flipped = isinstance(right, Literal) and not isinstance(left, Literal)
        sources = self._ends(right if flipped else left, s)
        if sources is None:
            sources = self._ends(right, s)
            flipped = sources is not None
        if sources is None:
            sources = self.graph.nodes.select("gid")
        far = reach(self.graph.neighbours, sources, e.args["minDepth"], e.args["maxDepth"], e.args["includeSelf"])
        a, b = ("dst", "src") if flipped else ("src", "dst")
        table = far.select(F.col(a).alias("left"), F.col(b).alias("right"), "dist")
        return self._add(s, table, e.nodes, text.path_score(F.col("dist")), [_match("path:depth=", F.col("dist").cast("string"))])

    def _ends(self, sel: Var | Literal, s: State) -> DataFrame | None:
        if isinstance(sel, Literal):
            return self.graph.nodes.where(_is(F.col("gid"), sel)).select("gid")
        if s.bound.get(sel.key) == BOUND:
            return s.df.select(s.col(sel.key).alias("gid")).distinct()
        return None

    def _descendant(self, e: Expr, s: State) -> State:
        lo, hi = max(1, e.args["minDepth"]), e.args["maxDepth"]
        up = self.graph.nodes.select(F.col("gid").alias("descendant"), F.posexplode(F.reverse(names.ancestors(F.col("gid")))).alias("k", "ancestor"))
        table = up.select("ancestor", "descendant", (F.col("k") + 1).alias("levels")).where(F.col("levels").between(lo, hi))
        matches = [_match("ancestor:", F.col("ancestor")), _match("descendant-of:", F.col("ancestor"), " depth=", F.col("levels").cast("string"))]
        return self._add(s, table, e.nodes, F.lit(0.3) + text.descendant_score(F.col("levels")), matches)

    def _pair(self, e: Expr, s: State, same: bool) -> State:
        left, right = e.nodes["left"], e.nodes["right"]
        match = F.lit("same" if same else "not-same")
        known = lambda x: isinstance(x, Literal) or s.bound.get(x.key) == BOUND
        if same and not (isinstance(left, Var) and isinstance(right, Var) and known(left) and known(right)):
            table = self.graph.nodes.select(F.col("gid").alias("left"), F.col("gid").alias("right"))
            return self._add(s, table, e.nodes, F.lit(0.1), [match])
        # Bind both sides at no score, then compare columns.
        for sel in (left, right):
            if not known(sel) or isinstance(sel, Literal):
                s = self._add(s, self.graph.nodes.select("gid"), {"gid": sel}, F.lit(0.0), [])
                s = State(s.df, s.bound)
        value = lambda x: F.lower(s.col(x.key) if isinstance(x, Var) else names.normalized(F.lit(x.name)))
        test = value(left) == value(right) if same else value(left) != value(right)
        return State(s.df.where(test).withColumn("score", F.col("score") + 0.1).withColumn("matched", F.concat("matched", F.array(match))), s.bound)

    def _same(self, e: Expr, s: State) -> State:
        return self._pair(e, s, True)

    def _notSame(self, e: Expr, s: State) -> State:
        return self._pair(e, s, False)


class _Carrying(Compiler):
    """A compiler whose tables keep extra columns (the outer bindings of a nested expression)."""

    def __init__(self, graph: PropertyGraph, extra: list[str]):
        super().__init__(graph)
        self.extra = extra

    def _carried(self) -> list[str]:
        return self.extra

    # The outer bindings ride along as pseudo-variables that no selector names.

    def _lift(self, s: State) -> State:
        return State(s.df.withColumnsRenamed({x: _c("$" + x) for x in self.extra}), {**s.bound, **{"$" + x: BOUND for x in self.extra}})

    def _lower(self, s: State) -> State:
        return State(s.df.withColumnsRenamed({_c("$" + x): x for x in self.extra}), {v: b for v, b in s.bound.items() if "$" not in v})

    def _add(self, s: State, table: DataFrame, sides: dict, score: Column, matches: list[Column]) -> State:
        if any("$" in v for v in s.bound):
            return super()._add(s, table, sides, score, matches)
        return self._lower(super()._add(self._lift(s), table, sides, score, matches))

    def _union(self, states: list[State]) -> State:
        if any("$" in v for s in states for v in s.bound):
            return super()._union(states)
        return self._lower(super()._union([self._lift(s) for s in states]))


def _evaluated(graph: PropertyGraph, q: ast.Query, window: tuple | None, trace: list | None) -> DataFrame:
    """All matches: a column for each variable, score, matched, ord; several rows may have one return key."""
    compiler = Compiler(graph, window)
    s = compiler.eval(ast.effective(q), State(None, {}))
    if trace is not None:
        trace += compiler.trace
    df = s.df
    for v in q.returns:
        if s.bound[v.lower()] == MAYBE:
            df = df.where(F.col(_c(v.lower())).isNotNull())
    return df


def _shaped(df: DataFrame, q: ast.Query, at: str = "") -> DataFrame:
    """A column for each return variable, score, matched_by, ord of the columns of matches."""
    return df.select(
        *(F.col(at + _c(v.lower())).alias(v) for v in q.returns), text.final_score(F.col(at + "score")).alias("score"),
        text.distinct_ignoring_case(F.col(at + "matched")).alias("matched_by"), F.col(at + "ord").alias("ord")
    )


def _firsts(df: DataFrame, q: ast.Query) -> DataFrame:
    """The first match of each return key."""
    cols = [_c(v.lower()) for v in q.returns]
    keys = [F.lower(F.col(c)).alias("k" + c) for c in cols]
    return _shaped(df.groupBy(*keys).agg(F.min(F.struct("ord", "score", "matched", *cols)).alias("s")), q, "s.")


def _single(graph: PropertyGraph, q: ast.Query) -> bool:
    """Whether every match has a return key of its own, so that none need be brought together.

    So it is in a pattern of several relations that returns all its variables, if each is a node of the table (a condition
    sees to that) and no two nodes differ in case alone.
    """
    block = flattened(ast.effective(q))
    if not all(e.kind in LEAVES for e in block) or not can_join(block, {}, MAYBE) or sum(len(ast.variables(e)) > 1 for e in block) < 2:
        return False
    nodes = {e.nodes["node"].key for e in block if e.kind in CONDITIONS and e.kind != "node"}
    return nodes == {v for e in block for v in ast.variables(e)} == {v.lower() for v in q.returns} and graph.told_apart


def solutions(graph: PropertyGraph, query: ast.Query | dict | str, window: tuple | None = None, trace: list | None = None) -> DataFrame:
    """All matches, one for each return key: a column for each return variable, score, matched_by, ord.

    ``window`` (variable, after, up to) keeps the solutions whose first choice, that variable, lies in a range of gids.
    """
    q = query if isinstance(query, ast.Query) else ast.parse(query)
    df = _evaluated(graph, q, window, trace)
    return _shaped(df, q) if _single(graph, q) else _firsts(df, q)


#: Matches that a limited search takes for each key it still wants, before it looks at all of a range.
AHEAD = 4


def _least(df: DataFrame, q: ast.Query, most: int) -> DataFrame:
    """The first matches of the ``most`` keys that come first.

    The least rows hold the first one of each of their keys, so where all variables are returned, and few rows share a
    key, a task keeps these few. All rows are brought together only if they hold too few keys.
    """
    if {v for e in flattened(ast.effective(q)) for v in ast.variables(e)} <= {v.lower() for v in q.returns}:
        top = cut(df.orderBy("ord", "score", "matched", *(_c(v.lower()) for v in q.returns)).limit(AHEAD * most))
        least = cut(_firsts(top, q).orderBy("ord").limit(most))
        if least.count() == most or top.count() < AHEAD * most:
            return least
    return cut(_firsts(df, q).orderBy("ord").limit(most))


#: Candidates of the first choice in each range of a limited search; after these, all that are left.
RANGES = (256, 4096, 65_536)


def first_choice(q: ast.Query) -> tuple[str, list[Expr]] | None:
    """The variable whose gid every solution's order begins with, and the conditions on it; None if there is none."""
    leaves, run = next(groupby(flattened(ast.effective(q)), lambda c: c.kind in LEAVES))
    block = list(run)
    if not leaves or not can_join(block, {}, MAYBE) or block[0].kind == "path":
        return None
    v = next(s.key for s in block[0].nodes.values() if isinstance(s, Var))
    return v, [e for e in block if e.kind in CONDITIONS and e.nodes["node"].key == v]


def search(graph: PropertyGraph, query: ast.Query | dict | str, trace: list | None = None) -> DataFrame:
    """The first matches in search order, at most the query's limit.

    Solutions come in the order of their first choice, so the search goes through ranges of its candidates, each wider
    than the one before, and ends with the range that fills the limit with distinct keys. A key's first solution is in the
    first range that has one. Queries whose order does not begin with a node are searched whole.
    """
    q = query if isinstance(query, ast.Query) else ast.parse(query)
    first = first_choice(q)
    if first is None:
        return solutions(graph, q, trace=trace).orderBy("ord").limit(q.limit).drop("ord")
    v, conditions = first
    gids = Conjunction(graph, conditions, {}).candidates[v].df.select("gid") if conditions else graph.nodes.select("gid")
    found, have, after = None, 0, None
    for most in (*RANGES, None):
        upto, n = None, None
        if most is not None:
            ahead = gids if after is None else gids.where(F.col("gid") > F.lit(after))
            upto, n = ahead.orderBy("gid").limit(most).agg(F.max("gid"), F.count(F.lit(1))).first()
            upto = upto if n == most else None  # the last range is open
        part = _evaluated(graph, q, (v, after, upto), trace)
        if found is not None:
            same = [F.lower(part[_c(r.lower())]) == F.lower(found[r]) for r in q.returns]
            part = part.join(F.broadcast(found), reduce(Column.__and__, same), "left_anti")  # fewer rows than the limit
        part = _least(part, q, q.limit - have)
        found, have, after = part if found is None else found.unionByName(part), have + part.count(), upto
        if have >= q.limit or upto is None:
            break
    return found.orderBy("ord").limit(q.limit).drop("ord")


def matches(found: DataFrame, query: ast.Query | dict | str) -> DataFrame:
    """node (first return variable), bindings, score, matched_by."""
    q = query if isinstance(query, ast.Query) else ast.parse(query)
    pairs = [x for v in q.returns for x in (F.lit(v), F.col(v))]
    return found.select(F.col(q.returns[0]).alias("node"), F.create_map(*pairs).alias("bindings"), "score", "matched_by")

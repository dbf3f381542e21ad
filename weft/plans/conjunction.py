"""Conjunctions of predicates as one join: conditions first, then relations reduced by semi-joins, in any order.

The predicates of a block are sorted into conditions on one variable, relations between two, and comparisons of two
bound variables. All conditions of a variable on its node are one scan. Relations are built from the end whose candidates
are fewest (they are counted), each one narrows the candidates of both its variables, and a pass backwards
narrows the relations that were built before a candidate was ruled out; on a pattern without cycles no row is left
that is in no solution. Then they are joined, least first.

The written order still decides which solution comes first and how scores add up: what each predicate adds to the
score, the matches and the path of choices is put together in that order at the end.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import names, text
from weft.operators.traverse import meet, reach
from weft.plans.ast import Expr, Literal, Var
from weft.plans.session import SMALL, cut, stored
from weft.sources.placed import beside

CONDITIONS = ("node", "name", "attribute", "text")
LEAVES = (*CONDITIONS, "degree", "connected", "path", "descendant", "same", "notSame")


def column(v: str) -> str:
    return "v_" + v


def is_literal(gid: Column, sel: Literal) -> Column:
    """Whether a node is the one a literal names; case does not matter."""
    return F.lower(gid) == F.lower(names.normalized(F.lit(sel.name)))


@dataclass
class Step:
    """What one predicate adds to a solution: in order, its own choices and the variables it is first to bind."""

    score: Column
    matches: list[Column]
    choices: list[Column] = field(default_factory=list)


@dataclass
class Candidates:
    """gid of a variable's candidates and columns of its conditions; ``size`` once they are counted.

    Conditions on the node are cheap to test again; what else a variable must be in is written before it is counted.
    """

    df: DataFrame
    size: int | None = None

    def counted(self) -> "Candidates":
        if self.size is None:
            self.df = cut(self.df)
            self.size = self.df.count()
        return self


@dataclass
class Relation:
    left: str
    right: str
    expr: Expr
    at: int
    df: DataFrame | None = None
    size: int | None = None
    seen: tuple = ()


def flattened(e: Expr) -> list[Expr]:
    """The predicates of an ``all`` in the order in which they hold; nested ones that only hold leaves are taken apart."""
    out: list[Expr] = []
    for c in sorted(e.children, key=lambda c: c.kind == "not"):
        inner = flattened(c) if c.kind == "all" else []
        out += inner if inner and all(x.kind in LEAVES for x in inner) else [c]
    return out


def can_join(block: list[Expr], bound: dict, maybe: int) -> bool:
    """Whether a block needs none of the rules for variables that are bound in some solutions only, or for lone literals."""
    for e in block:
        sides = list(e.nodes.values())
        if not any(isinstance(s, Var) for s in sides) or e.kind == "notSame" and any(isinstance(s, Literal) for s in sides):
            return False
        if any(isinstance(s, Var) and bound.get(s.key) == maybe for s in sides):
            return False
    return True


class Conjunction:
    """One block over a graph. ``outer``: distinct values of variables that are bound already. ``window``: (variable, after, up to)."""

    def __init__(self, graph, block: list[Expr], outer: dict[str, DataFrame], window: tuple | None = None):
        self.graph, self.block, self.outer, self.window = graph, block, outer, window
        self.conditions: dict[str, list] = {}
        self.others: dict[str, list] = {}  # tables (gid, columns) that a variable must be in
        self.relations: list[Relation] = []
        self.filters: list[Column] = []
        self.steps: list[Step] = []
        #: (place of the predicate, rows of its relation) as they were built, for tests and measurements.
        self.trace: list[tuple[int, int]] = []
        self.paths: list[tuple[Expr, int, str, Literal, bool]] = []
        known = set(outer)
        for k, e in enumerate(block):
            self._sort(k, e, known)
            known |= {s.key for s in e.nodes.values() if isinstance(s, Var)}
        self.variables = sorted(known - set(outer)) + sorted(outer)
        if window:
            v, after, upto = window
            at = F.col("gid")
            if after is not None:
                self.conditions.setdefault(v, []).append((at > F.lit(after), None))
            if upto is not None:
                self.conditions.setdefault(v, []).append((at <= F.lit(upto), None))
        self._eager = False
        self.candidates = {v: c for v in self.variables if (c := self._candidates(v)) is not None}

    # Sorting the predicates.

    def _sort(self, k: int, e: Expr, known: set[str]) -> None:
        sides = e.nodes
        order = list(dict.fromkeys(s.key for s in sides.values() if isinstance(s, Var)))
        fresh = [F.col(column(v)) for v in order if v not in known]
        if e.kind in CONDITIONS:
            v = order[0]
            test, score, match, value = self._condition(e)
            if e.kind != "node" or v not in known:
                self.conditions.setdefault(v, []).append((test, (f"_g{k}", value) if value is not None else None))
            self.steps.append(Step(F.col(f"_g{k}") if value is not None else F.lit(score), [F.lit(match)], fresh))
        elif e.kind == "degree":
            self.others.setdefault(order[0], []).append(("degree", e, k))
            self.steps.append(Step(F.lit(0.45), [F.lit(f"degree:{e.args['operator']}:{e.args['value']}")], fresh))
        elif e.kind in ("same", "notSame"):
            self._pair(k, e, order, fresh, known)
        else:
            self._edge(k, e, order, fresh)

    @staticmethod
    def _condition(e: Expr) -> tuple[Column, float, str, Column | None]:
        gid, attrs, a = F.col("gid"), F.col("attrs"), e.args
        if e.kind == "node":
            return F.lit(True), 0.05, "node", None
        if e.kind == "name":
            return text.text_op(gid, a["operator"], a["value"]), text.name_score(a["operator"]), f"name:{a['operator']}:{a['value']}", None
        if e.kind == "attribute":
            return text.attribute_op(attrs, a["key"], a["operator"], a["value"]), 0.65, f"attribute:{a['key']}:{a['operator']}", None
        points = text.text_score(gid, attrs, a["value"])
        return points > 0, 0.0, f"text:{a['value']}", points

    def _pair(self, k: int, e: Expr, order: list[str], fresh: list[Column], known: set[str]) -> None:
        left, right = e.nodes["left"], e.nodes["right"]
        match = [F.lit("same" if e.kind == "same" else "not-same")]
        self.steps.append(Step(F.lit(0.1), match, fresh))
        if e.kind == "same" and any(isinstance(s, Literal) for s in (left, right)):
            literal = left if isinstance(left, Literal) else right
            self.conditions.setdefault(order[0], []).append((is_literal(F.col("gid"), literal), None))
        elif e.kind == "same" and not all(v in known for v in order):
            if len(order) == 1:
                self.conditions.setdefault(order[0], []).append((F.lit(True), None))
            else:
                self.relations.append(Relation(*order, e, k))
        else:
            for v in order:
                if v not in known:
                    self.conditions.setdefault(v, []).append((F.lit(True), None))
            a, b = (F.lower(F.col(column(s.key))) for s in (left, right))
            self.filters.append(a == b if e.kind == "same" else a != b)

    def _edge(self, k: int, e: Expr, order: list[str], fresh: list[Column]) -> None:
        roles = list(e.nodes)
        if e.kind == "descendant":
            top = e.nodes["ancestor"]
            ancestor = F.col(column(top.key)) if isinstance(top, Var) else F.col(f"_a{k}")
            levels = F.col(f"_d{k}")
            step = Step(F.lit(0.3) + text.descendant_score(levels), [F.concat(F.lit("ancestor:"), ancestor), F.concat(F.lit("descendant-of:"), ancestor, F.lit(" depth="), levels.cast("string"))], fresh)
        elif e.kind == "path":
            d = F.col(f"_d{k}")
            step = Step(text.path_score(d), [F.concat(F.lit("path:depth="), d.cast("string"))], [F.lpad(d.cast("string"), 6, "0"), *fresh])
        else:
            step = Step(F.lit(0.7), [F.lit("connected:depth=1")], [F.lit("000001"), *fresh])
        self.steps.append(step)
        if len(order) == 2:
            self.relations.append(Relation(e.nodes[roles[0]].key, e.nodes[roles[1]].key, e, k))
        else:
            self.others.setdefault(order[0], []).append((e.kind, e, k))

    # Candidates of a variable.

    def _candidates(self, v: str) -> Candidates | None:
        df = None
        if v in self.conditions:
            nodes = None
            if self.graph.is_indexed:
                nodes = self.graph.text_index.candidates([e for e in self.block if e.kind in CONDITIONS and isinstance(s := e.nodes["node"], Var) and s.key == v])
            df = (self.graph.nodes if nodes is None else nodes).where(reduce(Column.__and__, (test for test, _ in self.conditions[v])))
            values = [value[1].alias(value[0]) for _, value in self.conditions[v] if value]
            df = df.select("gid", *values)
        if v in self.outer:
            own = self.outer[v].withColumnRenamed(column(v), "gid")
            df = own if df is None else df.join(own, "gid", "left_semi")
        for kind, e, k in sorted(self.others.get(v, []), key=lambda x: x[0] == "path"):
            df = self._narrowed(df, kind, e, k)
        return None if df is None else Candidates(df)

    def _narrowed(self, df: DataFrame | None, kind: str, e: Expr, k: int) -> DataFrame:
        g = self.graph
        if kind == "degree":
            counted = g.degree() if df is None else df.join(
                (g.placed.degree() if g.is_placed else g.neighbours.join(df.select(F.col("gid").alias("src")), "src", "left_semi").groupBy("src").agg(F.count(F.lit(1)).alias("degree"))).withColumnRenamed("src", "gid"),
                "gid", "left"
            ).withColumn("degree", F.coalesce("degree", F.lit(0)))
            return counted.where(text.number_op(F.col("degree"), e.args["operator"], e.args["value"])).drop("degree")
        sides = list(e.nodes.values())
        literals = [s for s in sides if isinstance(s, Literal)]
        if not literals:  # a relation of a variable with itself: the graph has no such edge
            whole = kind == "path" and e.args["minDepth"] == 0 and e.args["includeSelf"]
            own = g.nodes.select("gid", F.lit(0).alias(f"_d{k}")).where(F.lit(whole))
        elif kind == "descendant":
            own = self._family(e).where(is_literal(F.col("ancestor" if isinstance(sides[0], Literal) else "descendant"), literals[0]))
            own = own.select(F.col("descendant" if isinstance(sides[0], Literal) else "ancestor").alias("gid"), F.col("levels").alias(f"_d{k}"), F.col("ancestor").alias(f"_a{k}"))
        elif kind == "connected":
            own = self._pairs().where(is_literal(F.col("src"), literals[0])).select(F.col("dst").alias("gid")).distinct()
        else:
            ends = g.nodes.where(is_literal(F.col("gid"), literals[0])).select("gid")
            lo, hi, me = e.args["minDepth"], e.args["maxDepth"], e.args["includeSelf"]
            if hi > 1 and df is not None:
                own, rows = meet(g.placed, ends, df.select("gid"), lo, hi, me)
                self.trace.append((k, rows))
                own = own.select(F.col("right").alias("gid"), "dist")
            else:
                own = reach(g.placed if hi > 1 or g.is_placed else g.neighbours, ends, lo, hi, me).select(F.col("dst").alias("gid"), "dist")
            own = own.withColumnRenamed("dist", f"_d{k}")
        return own if df is None else df.join(own, "gid")

    def _family(self, e: Expr, below: DataFrame | None = None) -> DataFrame:
        """ancestor, descendant, levels; ``below`` are the descendants that count."""
        nodes = self.graph.nodes.select("gid") if below is None else below
        up = nodes.select(F.col("gid").alias("descendant"), F.posexplode(F.reverse(names.ancestors(F.col("gid")))).alias("k", "ancestor"))
        return up.select("ancestor", "descendant", (F.col("k") + 1).alias("levels")).where(F.col("levels").between(max(1, e.args["minDepth"]), e.args["maxDepth"]))

    # Relations.

    def _pairs(self) -> DataFrame:
        """src, dst of neighbours; written first if that is worth it."""
        return self.graph.placed.pairs if self._places else self.graph.neighbours

    @property
    def _places(self) -> bool:
        """Whether the block asks for the adjacency so often that it is written, or it is already."""
        asked = sum(1 if e.kind == "connected" else e.args["maxDepth"] for e in self.block if e.kind in ("connected", "path"))
        return self.graph.is_placed or asked > 2 or self.window is not None and asked > 1

    def _count_conditions(self) -> None:
        """Sizes of the candidates that only conditions on their node decide, in one scan."""
        plain = [v for r in self.relations for v in (r.left, r.right) if v in self.conditions and v not in self.outer and v not in self.others]
        plain = [v for v in dict.fromkeys(plain) if self.candidates[v].size is None]
        if plain:
            test = lambda v: reduce(Column.__and__, (t for t, _ in self.conditions[v]))
            row = self.graph.nodes.agg(*(F.count_if(test(v)) for v in plain)).first()
            for v, n in zip(plain, row):
                self.candidates[v].size = n

    def _size(self, v: str) -> int | None:
        return self.candidates[v].counted().size if v in self.candidates else None

    def _built(self, r: Relation) -> DataFrame:
        """The relation's rows whose ends are candidates: its two variables and the predicate's columns."""
        g, kind, k = self.graph, r.expr.kind, r.at
        lv, rv = column(r.left), column(r.right)
        sides = {v: self.candidates[v].df.select("gid") for v in (r.left, r.right) if v in self.candidates}
        if kind == "same":
            own = sides.get(r.left, sides.get(r.right, g.nodes.select("gid"))).distinct().select(F.col("gid").alias(lv), F.col("gid").alias(rv))
        elif kind == "descendant":
            own = self._family(r.expr, sides.get(r.right, DataFrame.distinct(g.nodes.select("gid"))).distinct())
            own = own.select(F.col("ancestor").alias(lv), F.col("descendant").alias(rv), F.col("levels").alias(f"_d{k}"))
        elif kind == "path":
            return self._path(r, sides)
        else:
            a, b = r.left, r.right
            if self._eager and self._places and sides:
                if a not in sides or b in sides and self._size(b) < self._size(a):
                    a, b = b, a
                start = sides[a].distinct()
                near = F.col("next")
                if b in sides and (self.candidates[b].size or 0) > SMALL:
                    # Of both sides of the join: else Spark moves the semi-join with b below it, and with it the whole adjacency.
                    near = F.concat(near, F.substr("gid", F.lit(1), F.lit(0)))
                own = g.placed.near(start, "gid", self._size(a)).select(F.col("gid").alias(column(a)), near.alias(column(b)))
                return self._within(own, {v: s for v, s in sides.items() if v != a})
            own = self._pairs().select(F.col("src").alias(lv), F.col("dst").alias(rv))
        return self._within(own, sides)

    def _path(self, r: Relation, sides: dict[str, DataFrame]) -> DataFrame:
        a, k = r.expr.args, r.at
        adj = self.graph.placed if a["maxDepth"] > 1 or self.graph.is_placed else self.graph.neighbours
        lv, rv = column(r.left), column(r.right)
        if len(sides) == 2 and a["maxDepth"] > 1:
            found, rows = meet(adj, sides[r.left], sides[r.right], a["minDepth"], a["maxDepth"], a["includeSelf"])
            self.trace.append((k, rows))
            return found.select(F.col("left").alias(lv), F.col("right").alias(rv), F.col("dist").alias(f"_d{k}"))
        first = r.left if r.left in sides or r.right not in sides else r.right
        far = reach(adj, sides.get(first, self.graph.nodes.select("gid")).distinct(), a["minDepth"], a["maxDepth"], a["includeSelf"])
        own = far.select(F.col("src").alias(column(first)), F.col("dst").alias(rv if first == r.left else lv), F.col("dist").alias(f"_d{k}"))
        return self._within(own, {v: s for v, s in sides.items() if v != first})

    def _within(self, df: DataFrame, sides: dict[str, DataFrame]) -> DataFrame:
        for v, s in sides.items():
            size = self.candidates[v].size
            own = s.select(F.col("gid").alias(column(v)))
            df = df.join(own if size is None else beside(own, size), column(v), "left_semi")
        return df

    def _reduced(self) -> None:
        """Build every relation from its smaller end, narrowing the candidates as it goes; then narrow backwards.

        Two relations need no way back: their join is the same work. A variable of one relation alone narrows no other.
        """
        self._count_conditions()
        left, done = list(self.relations), []
        while left:
            rank = lambda r: min((n for v in (r.left, r.right) if (n := self._size(v)) is not None), default=float("inf"))
            r = min(left, key=rank)
            left.remove(r)
            if rank(r) == float("inf"):  # nothing to narrow it by
                r.df = self._built(r)
                continue
            r.df = self._built(r)
            if left or len(done) > 1:
                self._count(r)
                self._narrow(r)
            done.append(r)
        for r in reversed(done if len(done) > 2 else []):
            if r.seen != tuple(self.candidates[v].size if v in self.candidates else None for v in (r.left, r.right)):
                r.df = self._within(r.df, {v: self.candidates[v].df.select("gid") for v in (r.left, r.right) if v in self.candidates})
                self._count(r)
                self._narrow(r)

    def _count(self, r: Relation) -> None:
        r.df = stored(r.df)
        r.size = r.df.count()
        self.trace.append((r.at, r.size))

    def _narrow(self, r: Relation) -> None:
        for v in (r.left, r.right):
            if sum(v in (x.left, x.right) for x in self.relations) < 2:
                continue
            own = r.df.select(F.col(column(v)).alias("gid")).distinct()
            before = self.candidates.get(v)
            after = cut(own if before is None else before.df.join(own, "gid", "left_semi"))
            n = after.count()
            if before is None or before.size is None or n < before.size:
                self.candidates[v] = Candidates(after, n)
        r.seen = tuple(self.candidates[v].size if v in self.candidates else None for v in (r.left, r.right))

    # The join.

    def joined(self) -> DataFrame:
        """A column for each variable, and those of the steps."""
        edges = [r for r in self.relations if r.expr.kind != "same"]
        # Two relations whose adjacency is not written are one job's work; more are narrowed step by step.
        self._eager = len(edges) > 2 or len(edges) > 1 and self._places or any(r.expr.kind == "path" and r.expr.args["maxDepth"] > 1 for r in edges)
        if self._eager:
            self._reduced()
        else:
            for r in self.relations:
                r.df = self._built(r)
        out, have, left = None, set(), list(self.relations)
        while left:
            linked = [r for r in left if have & {r.left, r.right}]
            # With nothing to link to: the least one; those that nothing narrowed come last.
            r = min(linked or left, key=lambda r: float("inf") if r.size is None else r.size)
            left.remove(r)
            if out is not None and not linked:
                out = out.crossJoin(r.df)  # two patterns without a common variable
            else:
                table = r.df if r.size is None else beside(r.df, r.size)
                out = r.df if out is None else out.join(table, [column(v) for v in (r.left, r.right) if v in have])
            have |= {r.left, r.right}
        for v in self.variables:
            c = self.candidates.get(v)
            if c is None or v in have and len(c.df.columns) == 1:
                continue
            own = c.df.withColumnRenamed("gid", column(v))
            if v in have:
                out = out.join(own if c.size is None else beside(own, c.size), column(v))
            else:
                out = own if out is None else out.crossJoin(own)
            have.add(v)
        for f in self.filters:
            out = out.where(f)
        return out

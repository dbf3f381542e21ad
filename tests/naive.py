"""A plain interpreter of the query language, in node order, for tests."""

from weft.plans.ast import Literal, Query, Var, effective


class Naive:
    def __init__(self, nodes: dict, links: list):
        self.nodes = dict(sorted(nodes.items()))
        self.adj = {g: set() for g in nodes}
        for g in nodes:
            if "/" in g:
                p = g.rsplit("/", 1)[0]
                self.adj[g].add(p)
                self.adj[p].add(g)
        for a, b in links:
            if a != b:
                self.adj[a].add(b)
                self.adj[b].add(a)

    def candidates(self, sol, sel):
        if isinstance(sel, Literal):
            return [sel.name] if sel.name in self.nodes else []
        if sel.key in sol[0]:
            return [sol[0][sel.key]]
        return list(self.nodes)

    @staticmethod
    def bind(sol, sel, node, score=0.0, match=None):
        b, s, m = sol
        if isinstance(sel, Var):
            if sel.key in b and b[sel.key] != node:
                return None
            b = {**b, sel.key: node}
        elif sel.name != node:
            return None
        return b, s + score, m + ([match] if match else [])

    @staticmethod
    def text(op, a, b):
        a, b = a.upper(), b.upper()
        return {"equals": a == b, "notEquals": a != b, "contains": b in a, "startsWith": a.startswith(b), "endsWith": a.endswith(b)}[op]

    def reach(self, start):
        dist, todo = {start: 0}, [start]
        for x in todo:
            for y in self.adj[x]:
                if y not in dist:
                    dist[y] = dist[x] + 1
                    todo.append(y)
        return dist

    def eval(self, e, sols):
        k = e.kind
        if k == "all":
            for c in sorted(e.children, key=lambda c: c.kind == "not"):
                sols = self.eval(c, sols)
            return sols
        out = []
        for sol in sols:
            if k == "any":
                for c in e.children:
                    out += self.eval(c, [sol])
            elif k == "not":
                if not self.eval(e.children[0], [sol]):
                    out.append((sol[0], sol[1], sol[2] + ["not"]))
            elif k == "exists":
                inner = self.eval(e.children[0], [sol])
                if inner:
                    out.append((sol[0], sol[1] + max(0, max(x[1] for x in inner) - sol[1]), sol[2] + ["exists"]))
            elif k in ("node", "name", "attribute", "text", "degree"):
                out += self.unary(e, sol)
            elif k in ("connected", "path"):
                lo, hi, me = (1, 1, False) if k == "connected" else (e.args["minDepth"], e.args["maxDepth"], e.args["includeSelf"])
                for a in self.candidates(sol, e.nodes["left"]):
                    for b, d in sorted(self.reach(a).items(), key=lambda x: (x[1], x[0])):
                        if lo <= d <= hi and (d > 0 or me):
                            s = self.bind(sol, e.nodes["left"], a, 1.0 if d <= 0 else 0.7 / d, f"{k}:depth={d}")
                            s = s and self.bind(s, e.nodes["right"], b)
                            out += [s] if s else []
            else:
                l, r = ("ancestor", "descendant") if k == "descendant" else ("left", "right")
                for a in self.candidates(sol, e.nodes[l]):
                    for b in self.candidates(sol, e.nodes[r]):
                        if k == "descendant":
                            d = b.count("/") - a.count("/")
                            if not (b.startswith(a + "/") and e.args["minDepth"] <= d <= e.args["maxDepth"]):
                                continue
                            s = self.bind(sol, e.nodes[l], a, 0.3, f"ancestor:{a}")
                            s = s and self.bind(s, e.nodes[r], b, 0.75 + 0.25 / d, f"descendant-of:{a} depth={d}")
                        else:
                            if (a == b) != (k == "same"):
                                continue
                            s = self.bind(sol, e.nodes[l], a, 0.1, "same" if k == "same" else "not-same")
                            s = s and self.bind(s, e.nodes[r], b)
                        out += [s] if s else []
        return out

    def unary(self, e, sol):
        out = []
        for n in self.candidates(sol, e.nodes["node"]):
            low = {k.lower(): v for k, v in self.nodes[n].items()}
            if e.kind == "node":
                got = (0.05, "node")
            elif e.kind == "name":
                op, v = e.args["operator"], e.args["value"]
                got = ({"equals": 1.0, "contains": 0.85}.get(op, 0.4), f"name:{op}:{v}") if self.text(op, n, v) else None
            elif e.kind == "attribute":
                op, v, key = e.args["operator"], e.args["value"], e.args["key"]
                has = low.get(key.lower())
                got = (0.65, f"attribute:{key}:{op}") if has is not None and (op == "exists" or self.text(op, has, v)) else None
            elif e.kind == "degree":
                op, v, d = e.args["operator"], e.args["value"], len(self.adj[n])
                ok = {"equals": d == v, "notEquals": d != v, "greaterThan": d > v, "greaterThanOrEqual": d >= v, "lessThan": d < v, "lessThanOrEqual": d <= v}[op]
                got = (0.45, f"degree:{op}:{v}") if ok else None
            else:
                v = e.args["value"].strip()
                every = " ".join([n, *(f"{k} {x}" for k, x in self.nodes[n].items())])
                terms = [t for t in v.split(" ") if len(t) > 1]
                p = 1.0 if n.upper() == v.upper() else 0.85 if v.upper() in n.upper() else 0.65 if any(v.upper() in x.upper() for x in self.nodes[n].values()) else 0.5 if terms and all(t.upper() in every.upper() for t in terms) else 0
                got = (p, f"text:{e.args['value']}") if p else None
            if got:
                s = self.bind(sol, e.nodes["node"], n, *got)
                out += [s] if s else []
        return out

    def solutions(self, q: Query) -> dict:
        """Return key -> (score, matched_by) of the first solution."""
        out = {}
        for b, score, m in self.eval(effective(q), [({}, 0.0, [])]):
            if all(v.lower() in b for v in q.returns):
                key = tuple(b[v.lower()] for v in q.returns)
                out.setdefault(key, (round(max(1, score), 4), list(dict.fromkeys(m))))
        return out

"""Boolean queries: a parser and two ways to plan them.

``|`` binds least, then ``&`` or nothing between two parts, then ``!``; parentheses group; ``*`` is every document and
``_`` none. ``matches`` plans a query as one aggregate over the postings of its terms, with the query as a predicate
over which of them a document has. ``matches_by_joins`` plans it as unions, semi and anti joins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.analysis import TERM
from quire.functions.stem import stemmed
from quire.operators.index import Collection, Endings


@dataclass(frozen=True)
class Node:
    """kind: term, and, or, not, all, none."""

    kind: str
    parts: tuple[Node, ...] = ()
    term: str = ""

    def __str__(self) -> str:
        if self.kind == "term":
            return self.term
        if self.kind in ("all", "none"):
            return "*" if self.kind == "all" else "_"
        if self.kind == "not":
            return f"!{self.parts[0]}"
        return "(" + {"and": " & ", "or": " | "}[self.kind].join(map(str, self.parts)) + ")"

    def terms(self) -> list[str]:
        """The different terms, in order of first mention."""
        own = [self.term] if self.kind == "term" else [t for p in self.parts for t in p.terms()]
        return list(dict.fromkeys(own))


def tree_lines(node: Node, depth: int = 0) -> list[str]:
    """The tree, a node a line, parts under their whole."""
    own = node.term if node.kind == "term" else node.kind
    return ["  " * depth + own, *(line for p in node.parts for line in tree_lines(p, depth + 1))]


class QueryError(ValueError):
    """The query doesn't follow the grammar."""


def parse(query: str, *, fold: bool = True, endings: Endings = ()) -> Node:
    tokens = re.findall(rf"{TERM}|\S", query)
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def either() -> Node:
        nonlocal at
        parts = [both()]
        while peek() == "|":
            at += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else Node("or", tuple(parts))

    def both() -> Node:
        nonlocal at
        parts = [single()]
        while (t := peek()) and t not in "|)":
            if t == "&":
                at += 1
            parts.append(single())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def single() -> Node:
        nonlocal at
        token = peek()
        at += 1
        if token == "!":
            return Node("not", (single(),))
        if token == "(":
            inner = either()
            if peek() != ")":
                raise QueryError(f"missing ) in {query!r}")
            at += 1
            return inner
        if token in ("*", "_"):
            return Node("all" if token == "*" else "none")
        if not re.fullmatch(TERM, token or ""):
            raise QueryError(f"unexpected {token or 'end'!r} in {query!r}")
        word = token.lower() if fold else token
        return Node("term", term=stemmed(word, endings) if endings else word)

    if not tokens:
        raise QueryError("empty query")
    tree = either()
    if at < len(tokens):
        raise QueryError(f"unexpected {tokens[at]!r} in {query!r}")
    return tree


def simplified(node: Node) -> Node:
    """Negations at the leaves, constants folded, nested groups flattened, repeated parts once."""
    if node.kind == "not":
        inner = node.parts[0]
        if inner.kind == "not":
            return simplified(inner.parts[0])
        if inner.kind in ("and", "or"):
            return simplified(Node("or" if inner.kind == "and" else "and", tuple(Node("not", (p,)) for p in inner.parts)))
        if inner.kind in ("all", "none"):
            return Node("none" if inner.kind == "all" else "all")
        return node
    if node.kind not in ("and", "or"):
        return node
    zero, one = ("none", "all") if node.kind == "and" else ("all", "none")
    parts: dict[Node, None] = {}
    for p in map(simplified, node.parts):
        for q in p.parts if p.kind == node.kind else (p,):
            if q.kind == zero:
                return q
            if q.kind != one:
                parts[q] = None
    if not parts:
        return Node(one)
    return next(iter(parts)) if len(parts) == 1 else Node(node.kind, tuple(parts))


def holds(node: Node, present: set[str]) -> bool:
    """The query's value for a document with these terms."""
    if node.kind == "term":
        return node.term in present
    if node.kind == "not":
        return not holds(node.parts[0], present)
    if node.kind in ("all", "none"):
        return node.kind == "all"
    return (all if node.kind == "and" else any)(holds(p, present) for p in node.parts)


def _predicate(node: Node, has: dict[str, Column]) -> Column:
    if node.kind == "term":
        return has[node.term]
    if node.kind == "not":
        return ~_predicate(node.parts[0], has)
    if node.kind in ("all", "none"):
        return F.lit(node.kind == "all")
    parts = [_predicate(p, has) for p in node.parts]
    return reduce((lambda a, b: a & b) if node.kind == "and" else (lambda a, b: a | b), parts)


def matches(c: Collection, query: str | Node) -> DataFrame:
    """docnum of each document that the query holds for: one aggregate, whatever the query."""
    tree = simplified(parse(query, fold=c.fold, endings=c.endings) if isinstance(query, str) else query)
    found = tree.terms()
    if not found:
        return c.docs.select("docnum").where(F.lit(tree.kind == "all"))
    seen = c.postings.where(F.col("term").isin(found)).groupBy("docnum").agg(*(F.max(F.col("term") == t).alias(f"t{k}") for k, t in enumerate(found)))
    has = {t: F.coalesce(F.col(f"t{k}"), F.lit(False)) for k, t in enumerate(found)}
    if holds(tree, set()):  # documents without any of the terms count too
        seen = c.docs.select("docnum").join(seen, "docnum", "left")
    return seen.where(_predicate(tree, has)).select("docnum")


def matches_by_joins(c: Collection, query: str | Node) -> DataFrame:
    """The same by set operations: unions, semi joins and anti joins."""
    everything = c.docs.select("docnum")

    def plan(node: Node) -> DataFrame:
        if node.kind == "term":
            return c.postings.where(F.col("term") == node.term).select("docnum")
        if node.kind in ("all", "none"):
            return everything.where(F.lit(node.kind == "all"))
        if node.kind == "not":
            return everything.join(plan(node.parts[0]), "docnum", "left_anti")
        if node.kind == "or":
            names = [p.term for p in node.parts if p.kind == "term"]
            rest = [plan(p) for p in node.parts if p.kind != "term"]
            if names:
                rest.append(c.postings.where(F.col("term").isin(names)).select("docnum"))
            return reduce(DataFrame.union, rest).distinct()
        kept = [p for p in node.parts if p.kind != "not"]
        out = plan(kept[0]) if kept else everything
        for p in kept[1:]:
            out = out.join(plan(p), "docnum", "left_semi")
        for p in node.parts:
            if p.kind == "not":
                out = out.join(plan(p.parts[0]), "docnum", "left_anti")
        return out

    return plan(simplified(parse(query, fold=c.fold, endings=c.endings) if isinstance(query, str) else query))


def weighted(c: Collection, query: str, *, as_written: bool = False) -> DataFrame:
    """docnum, weight: a term weighs words / (100 * log2(cf_t + 1)); a conjunction has its rarest term's weight, a union the sum."""
    tree = parse(query, fold=c.fold, endings=c.endings)
    tree = tree if as_written else simplified(tree)
    found = tree.terms()
    words = {r["term"]: r for r in c.lexicon.where(F.col("term").isin(found)).collect()}  # a row a query term
    n_words = c.meta.select("n_words").first()["n_words"]
    rarity = lambda n: words[n.term]["f_t"] if n.kind == "term" and n.term in words else sum(map(rarity, n.parts)) if n.kind == "or" else 0 if n.kind == "term" else 1 << 62
    flag = {t: F.coalesce(F.col(f"t{k}"), F.lit(False)) for k, t in enumerate(found)}

    def weight(node: Node) -> Column:
        if node.kind == "term":
            w = F.lit(float(n_words)) / (F.lit(100.0) * F.log2(F.lit(float(words[node.term]["cf_t"] + 1)))) if node.term in words else F.lit(0.0)
            return F.when(flag[node.term], w).otherwise(F.lit(0.0))
        if node.kind == "and":
            return weight(min((p for p in node.parts if p.kind != "not"), key=rarity, default=Node("none")))
        if node.kind == "or":
            return reduce(lambda a, b: a + b, (F.when(_predicate(p, flag), weight(p)).otherwise(F.lit(0.0)) for p in node.parts))
        return F.lit(0.0)

    seen = c.postings.where(F.col("term").isin(found)).groupBy("docnum").agg(*(F.max(F.col("term") == t).alias(f"t{k}") for k, t in enumerate(found)))
    if holds(tree, set()):
        seen = c.docs.select("docnum").join(seen, "docnum", "left")
    return seen.where(_predicate(tree, flag)).select("docnum", weight(tree).alias("weight"))


def answers(c: Collection, query: str, most: int | None = None) -> DataFrame:
    """The matches in order of docnum, the first ``most``."""
    out = matches(c, query).orderBy("docnum")
    return out if most is None else out.limit(most)

"""The boolean query language: terms, NOT, AND, OR, "phrases" and #n(a, b); a parser on the driver, DataFrame algebra for the answer."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.stem import porter
from lexigrid.functions.text import Analyzer
from lexigrid.storage import written


@dataclass(frozen=True)
class Node:
    """kind: term, phrase, near, not, and, or. words of leaves, children of the others, span of near."""

    kind: str
    words: tuple[str, ...] = ()
    children: tuple[Node, ...] = ()
    span: int = 0


_LEXEME = re.compile(r'\s*(?:(?P<near>#(?P<n>\d+)\s*\(\s*(?P<a>[^,()]+?)\s*,\s*(?P<b>[^,()]+?)\s*\))|"(?P<phrase>[^"]*)"|(?P<op>AND|OR|NOT)(?![^\s"#(])|(?P<open>\()|(?P<close>\))|(?P<word>[^\s"()]+))')


def parse(text: str, strict: bool = False) -> Node:
    """NOT binds more than AND, AND more than OR; words side by side are an AND. strict: at most one AND or OR."""
    items, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _LEXEME.match(text, at)
        if not m:
            raise ValueError(f"can't read {text[at:]!r}")
        at = m.end()
        if m["near"]:
            items.append(Node("near", (m["a"], m["b"]), span=int(m["n"])))
        elif m["phrase"] is not None:
            items.append(Node("phrase", tuple(m["phrase"].split())))
        else:
            items.append(m["op"] or m["open"] or m["close"] or Node("term", (m["word"],)))
    if strict and sum(x in ("AND", "OR") for x in items) > 1:
        raise ValueError("one AND or OR at most")
    place = 0

    def peek():
        return items[place] if place < len(items) else None

    def unary() -> Node:
        nonlocal place
        item = peek()
        place += 1
        if item == "NOT":
            return Node("not", children=(unary(),))
        if item == "(":
            inner = either()
            if peek() != ")":
                raise ValueError("a bracket stays open")
            place += 1
            return inner
        if not isinstance(item, Node):
            raise ValueError(f"an operand is missing before {item!r}")
        return item

    def every() -> Node:
        nonlocal place
        got = [unary()]
        while peek() == "AND" or peek() == "NOT" or peek() == "(" or isinstance(peek(), Node):
            place += peek() == "AND"
            got.append(unary())
        return got[0] if len(got) == 1 else Node("and", children=tuple(got))

    def either() -> Node:
        nonlocal place
        got = [every()]
        while peek() == "OR":
            place += 1
            got.append(every())
        return got[0] if len(got) == 1 else Node("or", children=tuple(got))

    tree = either()
    if place < len(items):
        raise ValueError(f"{items[place]!r} stands alone")
    return tree


def leaves(node: Node) -> list[str]:
    return list(node.words) + [w for c in node.children for w in leaves(c)]


def scans(node: Node) -> int:
    """How many times an answer reads the tokens."""
    return sum(map(scans, node.children)) + (len(node.words) if node.kind == "phrase" else node.kind in ("term", "near"))


class Search:
    """Answers queries over a table of documents. Only tokens of a query's own terms are ever made into rows."""

    def __init__(self, docs: DataFrame, analyzer: Analyzer, *fields: str) -> None:
        self.docs, self.analyzer, self.fields = docs, analyzer, fields

    def _term(self, word: str) -> list[str]:
        """A query word as the analyzer has it: its pieces, none if it is a stop word."""
        # a pattern without (?U) means ASCII classes on the index side, as Java has it
        unicode, pattern = self.analyzer.pattern.startswith("(?U)"), self.analyzer.pattern.removeprefix("(?U)")
        pieces = re.findall(pattern, word, 0 if unicode else re.ASCII)
        pieces = [p.lower() for p in pieces] if self.analyzer.lower else pieces
        pieces = [p for p in pieces if p not in self.analyzer.stop]
        return [porter(p) for p in pieces] if self.analyzer.stemmer else pieces

    def answer(self, query: str | Node) -> DataFrame:
        """Distinct doc_id. A stop word, an unknown term and a null text match nothing; NOT is against all documents."""
        tree = parse(query) if isinstance(query, str) else query
        terms = sorted({t for w in leaves(tree) for t in self._term(w)})
        tokens = self.analyzer.explode(self.docs, *self.fields, only=terms)
        if scans(tree) > 1:  # each leaf reads the query's own tokens, not the documents
            tokens = written(tokens, "search")
        return self._eval(tree, tokens)

    def _eval(self, node: Node, tokens: DataFrame) -> DataFrame:
        if node.kind == "not":
            return self.docs.select("doc_id").distinct().join(self._eval(node.children[0], tokens), "doc_id", "left_anti")
        if node.kind in ("and", "or"):
            got = [self._eval(c, tokens) for c in node.children if not (node.kind == "and" and c.kind == "not")]
            less = [self._eval(c.children[0], tokens) for c in node.children if node.kind == "and" and c.kind == "not"]
            out = got[0] if got else self.docs.select("doc_id").distinct()
            for g in got[1:]:
                out = out.join(g, "doc_id", "left_semi") if node.kind == "and" else out.unionByName(g)
            for g in less:
                out = out.join(g, "doc_id", "left_anti")
            return out.distinct() if node.kind == "or" else out
        terms = [t for w in node.words for t in self._term(w)]
        if not terms or (node.kind == "near" and len(terms) != 2):
            return tokens.select("doc_id").where("false")
        if len(terms) == 1:
            return tokens.where(F.col("term") == terms[0]).select("doc_id").distinct()
        if node.kind == "near":
            return near(tokens, terms[0], terms[1], lambda a, b: F.abs(a - b) <= node.span)
        return phrase(tokens, terms)


def phrase(tokens: DataFrame, terms: list[str]) -> DataFrame:
    """Documents with the terms at consecutive positions: equi-joins on (doc_id, start of the phrase)."""
    out = None
    for k, t in enumerate(terms):
        hit = tokens.where(F.col("term") == t).select("doc_id", (F.col("pos") - k).alias("start"))
        out = hit if out is None else out.join(hit, ["doc_id", "start"], "left_semi")
    return out.select("doc_id").distinct()


def near(tokens: DataFrame, a: str, b: str, test) -> DataFrame:
    """Documents with positions of both terms that pass the test (a function of two columns), per document on position arrays."""
    at = tokens.where(F.col("term").isin([a, b])).groupBy("doc_id").agg(F.collect_list(F.when(F.col("term") == a, F.col("pos"))).alias("p"), F.collect_list(F.when(F.col("term") == b, F.col("pos"))).alias("q"))
    return at.where(F.exists("p", lambda x: F.exists("q", lambda y: test(x, y)))).select("doc_id")


def match(**equals) -> Column:
    """A conjunction of equalities."""
    out = F.lit(True)
    for k, v in equals.items():
        out = out & (F.col(k) == F.lit(v))
    return out

"""Text analysis as column expressions: tokenise, lower, stop, stem; positions in one space over all fields."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.functions.stem import porter

#: Token patterns.
ALNUM, ALPHA, LATIN, LATIN_DIGITS, WORD = "[a-zA-Z0-9]+", "[a-zA-Z]+", "(?i)[a-zÀ-ÿ]+", "(?i)[0-9a-zÀ-ÿ]+", r"(?U)\w+"


@dataclass(frozen=True)
class Analyzer:
    """Pluggable pattern, case, stop words and stemmer ("porter" or None)."""

    pattern: str = ALPHA
    lower: bool = True
    stop: frozenset[str] = field(default_factory=frozenset)
    stemmer: str | None = None

    def tokens(self, *texts: Column) -> Column:
        """The tokens of all fields in turn, a null field being empty. Not stemmed: see stemmed()."""
        parts = [F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(self.pattern), F.lit(0)) for t in texts]
        out = F.concat(*parts) if len(parts) > 1 else parts[0]
        if self.lower:
            out = F.transform(out, lambda t: F.lower(t))
        if self.stop:
            stop = F.array(*[F.lit(w) for w in sorted(self.stop)])
            out = F.filter(out, lambda t: ~F.array_contains(stop, t))
        return out

    def explode(self, docs: DataFrame, *fields: str, keep: tuple[str, ...] = ("doc_id",), only: list[str] | None = None) -> DataFrame:
        """(keep..., pos, term), one row a token. only: the terms that matter; all else is dropped before rows are made."""
        if only is not None and len(fields) == 1:
            from lexigrid.operators.terms import occurrences

            return occurrences(docs, replace(self, stemmer=None), fields[0], keep, stem_forms(docs, self, fields[0], only) if self.stemmer else {w: w for w in only})
        listed = F.transform(self.tokens(*[F.col(f) for f in fields]), lambda t, i: F.struct(i.alias("pos"), t.alias("term")))
        if only is not None and not self.stemmer:
            listed = F.filter(listed, lambda x: x["term"].isin(only))
        out = docs.select(*keep, F.explode(listed).alias("t")).select(*keep, "t.pos", "t.term")
        out = stemmed(out) if self.stemmer else out
        return out.where(F.col("term").isin(only)) if only is not None and self.stemmer else out


def counted(docs: DataFrame, analyzer: Analyzer, *fields: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., term, df, cf): rows to be summed. Of one field without stems they are sums of slices; else one (1, 0) for each distinct term of
    a document and one (0, 1) for each token. So the document frequency needs no shuffle by document."""
    if len(fields) == 1 and not analyzer.stemmer:
        from lexigrid.operators.terms import totals

        return totals(docs, analyzer, fields[0], keep)
    all_ = analyzer.tokens(*[F.col(f) for f in fields])
    row = lambda df, cf: lambda t: F.struct(t.alias("term"), F.lit(df).alias("df"), F.lit(cf).alias("cf"))
    both = F.flatten(F.transform(F.array(all_), lambda a: F.concat(F.transform(F.array_distinct(a), row(1, 0)), F.transform(a, row(0, 1)))))
    out = docs.select(*keep, F.explode(both).alias("x")).select(*keep, "x.term", "x.df", "x.cf")
    return stemmed(out) if analyzer.stemmer else out


def once(docs: DataFrame, analyzer: Analyzer, *fields: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., term): each distinct term of a document once."""
    out = docs.select(*keep, F.explode(F.array_distinct(analyzer.tokens(*[F.col(f) for f in fields]))).alias("term"))
    return stemmed(out).distinct() if analyzer.stemmer else out


@F.pandas_udf(T.StringType())
def porter_udf(terms: pd.Series) -> pd.Series:
    return terms.map(porter)


def stem_forms(docs: DataFrame, analyzer: Analyzer, field: str, stems: list[str]) -> dict[str, str]:
    """The words of the distinct vocabulary with one of these stems, and their stems. A word starts with its stem but for the last two letters:
    no rule puts more in a suffix's place than it shares with it and "e", "i" or "le"."""
    from lexigrid.operators import terms

    near = F.lit(False)
    for s in stems:
        near = near | F.col("term").startswith(s[:-2])
    words = terms.words(docs, replace(analyzer, stemmer=None), field).where(near).select("term").distinct()
    return {r.term: r.stem for r in words.withColumn("stem", porter_udf("term")).where(F.col("stem").isin(stems)).collect()}


def stemmed(tokens: DataFrame) -> DataFrame:
    """tokens with stems for terms. Only the distinct vocabulary goes through Python."""
    vocabulary = tokens.select("term").distinct().withColumn("stem", porter_udf("term"))
    return tokens.join(vocabulary, "term").withColumn("term", F.col("stem")).drop("stem")


def lemmatised(tokens: DataFrame, lemmas: DataFrame) -> DataFrame:
    """tokens with the lemma of (term, lemma) for each listed term; others stay."""
    return tokens.join(lemmas, "term", "left").withColumn("term", F.coalesce("lemma", "term")).drop("lemma")


def line_pipeline(lines: DataFrame, analyzer: Analyzer) -> DataFrame:
    """(line_no, line) -> (line_no, tokens), lines that become empty dropped."""
    return lines.select("line_no", analyzer.tokens(F.col("line")).alias("tokens")).where(F.size("tokens") > 0)


def sentences(headline: Column, body: Column) -> Column:
    """array<array<string>>: the sentences of headline, ". " and body, as lists of words."""
    return F.sentences(F.concat_ws(". ", F.coalesce(headline, F.lit("")), F.coalesce(body, F.lit(""))))


def first_digit(n: Column) -> Column:
    return F.substring(n.cast("string"), 1, 1).cast("int")

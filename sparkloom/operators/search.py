"""Full-text search over symbol names: postings, terms, prefixes, phrases, boolean queries, bm25.

The inverted index is a table of postings (term, doc_id, tf, positions). Each
distinct word is stemmed once. A query reads only the postings of its terms; the
bm25 constants are k1 = 1.2 and b = 0.75, and a smaller rank is better.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.stem import stem, stem_column, words

K1, B = 1.2, 0.75
#: Shares of the postings of a term where many are joined with them.
SHARES = 32
_TOKEN = re.compile(r'\s*(?:(\()|(\))|"([^"]*)"(\*?)|(\^?)([\w]+)(\*?))', re.UNICODE)


def postings(docs: DataFrame, id_column: str = "id", text_column: str = "name") -> DataFrame:
    """(term, doc_id, tf, positions): a row for each word of each text."""
    said = docs.select(F.col(id_column).alias("doc_id"), F.posexplode(words(F.col(text_column))).alias("pos", "word"))
    stems = said.select("word").distinct().withColumn("term", stem_column("word"))
    return said.join(stems, "word").groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def corpus(postings: DataFrame) -> tuple[int, float]:
    """(texts with words, mean number of words)."""
    n, total = postings.agg(F.count_distinct("doc_id"), F.sum("tf")).first()
    return n or 0, (total or 0) / n if n else 0.0


def lengths(postings: DataFrame) -> DataFrame:
    return postings.groupBy("doc_id").agg(F.sum("tf").alias("length"))


class SearchSyntaxError(ValueError):
    """The query has a character that the grammar lacks."""


def parse(query: str) -> tuple:
    """Query tree: ("phrase", words, prefix, initial), ("and" | "or" | "not", left, right). Juxtaposed terms are joined by AND."""
    tokens, at = [], 0
    query = query.rstrip()
    while at < len(query):
        m = _TOKEN.match(query, at)
        if not m or m.end() == at:
            raise SearchSyntaxError(f"near {query[at:at + 10]!r}")
        at = m.end()
        if m[1] or m[2]:
            tokens.append(m[1] or m[2])
        elif m[3] is not None:
            tokens.append(("phrase", _split(m[3]), bool(m[4]), False))
        elif m[6] in ("AND", "OR", "NOT"):
            tokens.append(m[6])
        else:
            tokens.append(("phrase", _split(m[6]), bool(m[7]), bool(m[5])))
    pos = 0

    def peek():
        return tokens[pos] if pos < len(tokens) else None

    def unit():
        nonlocal pos
        t = peek()
        if t == "(":
            pos += 1
            inner = either()
            if peek() != ")":
                raise SearchSyntaxError("a bracket isn't closed")
            pos += 1
            return inner
        if not isinstance(t, tuple):
            raise SearchSyntaxError(f"near {t!r}")
        pos += 1
        return t

    def without():
        nonlocal pos
        left = unit()
        while peek() == "NOT":
            pos += 1
            left = ("not", left, unit())
        return left

    def both():
        nonlocal pos
        left = without()
        while peek() not in (None, ")", "OR"):
            if peek() == "AND":
                pos += 1
            left = ("and", left, without())
        return left

    def either():
        nonlocal pos
        left = both()
        while peek() == "OR":
            pos += 1
            left = ("or", left, both())
        return left

    if not tokens:
        raise SearchSyntaxError("empty query")
    tree = either()
    if pos < len(tokens):
        raise SearchSyntaxError(f"near {tokens[pos]!r}")
    return tree


def _split(text: str) -> list[str]:
    return [stem(w) for w in re.split(r"[\W_]+", text.lower()) if w]


def _phrases(tree: tuple) -> list[tuple]:
    if tree[0] == "phrase":
        return [tree]
    return _phrases(tree[1]) + ([] if tree[0] == "not" else _phrases(tree[2]))


def _hits(index: DataFrame, phrase: tuple) -> DataFrame:
    """(doc_id, tf) of texts with the phrase."""
    _, terms, prefix, initial = phrase
    if not terms:
        return index.select("doc_id", "tf").where(F.lit(False))

    def of(k: int) -> DataFrame:
        own = index.where(F.col("term").startswith(terms[k]) if prefix and k == len(terms) - 1 else F.col("term") == terms[k])
        return own.select("doc_id", F.explode("positions").alias("at")).select("doc_id", (F.col("at") - k).alias("at"))

    found = reduce(lambda a, b: a.join(b, ["doc_id", "at"]), map(of, range(len(terms))))
    if initial:
        found = found.where("at = 0")
    return found.groupBy("doc_id").agg(F.count_distinct("at").alias("tf"))


def _matching(index: DataFrame, tree: tuple) -> DataFrame:
    if tree[0] == "phrase":
        return _hits(index, tree).select("doc_id")
    left, right = _matching(index, tree[1]), _matching(index, tree[2])
    if tree[0] == "or":
        return left.union(right).distinct()
    return left.join(right, "doc_id", "left_semi" if tree[0] == "and" else "left_anti")


def search(index: DataFrame, query: str, limit: int | None = 50) -> DataFrame:
    """(doc_id, rank) of texts that match, best first; rank is minus the bm25 score, ties by doc_id."""
    tree = parse(query)
    n, mean = corpus(index)
    scores = []
    for phrase in dict.fromkeys(map(repr, _phrases(tree))):
        hits = _hits(index, next(p for p in _phrases(tree) if repr(p) == phrase))
        df = hits.agg(F.count("*").alias("df"))
        idf = F.greatest(F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        scores.append(hits.crossJoin(F.broadcast(df)).select("doc_id", "tf", idf.alias("idf")))
    found = _matching(index, tree)
    own = index.join(found, "doc_id", "left_semi")
    parts = reduce(DataFrame.unionAll, scores).join(lengths(own), "doc_id")
    term = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean or 1.0)))
    ranked = found.join(parts.groupBy("doc_id").agg(F.sum(term).alias("score")), "doc_id").select("doc_id", (-F.col("score")).alias("rank")).orderBy("rank", "doc_id")
    return ranked if limit is None else ranked.limit(limit)


def blast_radius(changed: DataFrame, symbols: DataFrame, index: DataFrame, per_symbol: int = 50) -> DataFrame:
    """(changed_name, symbol_id, name): for each changed(name) the best symbols of other names that have all its words.

    All names are searched in one join on stemmed words; ranking is by bm25 over
    those words.
    """
    n, mean = corpus(index)
    asked = changed.select(F.col("name").alias("changed_name")).where("changed_name is not null").distinct().withColumn("word", F.explode(F.array_distinct(words(F.col("changed_name")))))
    stems = asked.select("word").distinct().withColumn("term", stem_column("word"))
    terms = asked.join(stems, "word").select("changed_name", "term").distinct()
    need = terms.groupBy("changed_name").agg(F.count("*").alias("need"))
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean or 1.0)))
    # a term may stand in most texts: its postings are dealt out to SHARES, each with all names that ask for it
    asked_for = terms.join(df, "term").join(need, "changed_name").select("changed_name", "term", "need", idf.alias("idf"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    posted = index.select("term", "doc_id", "tf").join(lengths(index), "doc_id").select("term", "doc_id", "tf", "length", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)).cast("int").alias("share"))
    said = posted.join(asked_for, ["term", "share"]).select("changed_name", "doc_id", "need", weight.alias("weight"))
    hit = (
        said.repartition("changed_name", "doc_id")  # so that no task counts all pairs of its share before they are sent
        .groupBy("changed_name", "doc_id").agg(F.count("*").alias("have"), F.max("need").alias("need"), F.sum("weight").alias("score"))
        .where("have = need")
    )
    from pyspark.sql import Window

    best = Window.partitionBy("changed_name").orderBy(F.desc("score"), "doc_id")
    top = hit.withColumn("place", F.row_number().over(best)).where(F.col("place") <= per_symbol)
    return top.join(symbols.select(F.col("id").alias("doc_id"), "name"), "doc_id").where("name <> changed_name").select("changed_name", F.col("doc_id").alias("symbol_id"), "name")

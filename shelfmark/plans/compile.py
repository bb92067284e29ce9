"""Query trees to DataFrame plans over a fielded positional index.

The dictionary is read first, once for all word clauses: exact words by pruned look-up, fuzzy
words in one pass. What it gives is small (at most ``expansions`` words a field and clause) and
becomes a local table that is joined to the pruned postings; one aggregation by document
then yields, for every clause, whether it matched and its score. Phrases read positions of the
same pruned postings; ranges and keywords read the catalogue. The Boolean logic is an expression
over the clauses' flags.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import sinks
from .ast import Bool, Fuzzy, Keyword, Leaves, Node, Phrase, Range, Term

#: Parameters of the ranking function.
K1, B = 1.2, 0.75


#: Rows of the local table of weighed words; a query that needs more is refused.
MOST_WORDS = 500_000


@dataclass(frozen=True)
class FieldedIndex:
    postings: DataFrame  # field, term, doc_id, tf, dl, positions; written ones also bucket
    terms: DataFrame  # field, term, df
    fields: DataFrame  # field, doc_count, sum_tf
    catalog: DataFrame  # doc_id and stored columns

    @functools.cached_property
    def statistics(self) -> dict[str, tuple[int, int]]:
        """(documents, words) by field; read once, a row per field."""
        return {r["field"]: (r["doc_count"], r["sum_tf"]) for r in self.fields.collect()}


def _postings(df: DataFrame, id_col: str, text: dict[str, Column], keywords: dict[str, Column]) -> DataFrame:
    each = [F.struct(F.lit(n).alias("field"), tx.analyze(c).alias("tokens")) for n, c in text.items()]
    each += [F.struct(F.lit(n).alias("field"), F.when(F.length(c) > 0, F.array(F.lower(c))).otherwise(F.array().cast("array<string>")).alias("tokens")) for n, c in keywords.items()]
    tokens = df.select(F.col(id_col).alias("doc_id"), F.explode(F.array(*each)).alias("f")).select("doc_id", "f.field", "f.tokens")
    placed = tokens.select("field", "doc_id", F.size("tokens").cast("bigint").alias("dl"), F.posexplode("tokens").alias("pos", "term"))
    return placed.groupBy("field", "term", "doc_id", "dl").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def _terms(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "term").agg(F.count("*").alias("df"))


def _fields(postings: DataFrame) -> DataFrame:
    by = postings.groupBy("field", "doc_id").agg(F.sum("tf").alias("dl"))
    return by.groupBy("field").agg(F.count("*").alias("doc_count"), F.sum("dl").alias("sum_tf"))


def build(df: DataFrame, id_col: str, text: dict[str, Column], stored: dict[str, Column], keywords: dict[str, Column] | None = None) -> FieldedIndex:
    """Index of unique documents: analysed text fields with positions, keyword fields of one lower-case token, and stored columns for ranges, keywords and display.

    Postings carry the length of their field, so that a query joins nothing but its own words.
    """
    postings = _postings(df, id_col, text, keywords or {})
    return FieldedIndex(postings, _terms(postings), _fields(postings), df.select(F.col(id_col).alias("doc_id"), *(c.alias(n) for n, c in stored.items())))


def write(df: DataFrame, id_col: str, text: dict[str, Column], stored: dict[str, Column], path: str, keywords: dict[str, Column] | None = None) -> None:
    """The index as tables under ``path``; texts are analysed once, dictionary and statistics come from the written postings."""
    spark = df.sparkSession
    sinks.write_by_term(_postings(df, id_col, text, keywords or {}), f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    sinks.write_sorted(_terms(postings), ["term", "field"], f"{path}/terms")
    sinks.write_table(_fields(postings).coalesce(1), f"{path}/fields")  # a row per field
    sinks.write_sorted(df.select(F.col(id_col).alias("doc_id"), *(c.alias(n) for n, c in stored.items())), ["doc_id"], f"{path}/catalog")


def read(spark: SparkSession, path: str) -> FieldedIndex:
    return FieldedIndex(**sinks.read_index(spark, path, ["postings", "terms", "fields", "catalog"]))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf / (tf + K1 * (1 - B + B * dl / avgdl))


def _swapped(word: str) -> list[str]:
    """The word with two neighbours swapped, in every way that changes it."""
    return sorted({word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)} - {word})


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def edits(term: str, word: str, most: int) -> str:
    """An SQL expression (one text is planned faster than many nested columns): the Damerau-Levenshtein distance of column ``term`` and ``word`` up to ``most`` (0 to 2), null beyond.

    A swap of neighbours is one edit. A distance of 2 that plain steps do not reach has a swap in the one or the other word, beside one more edit.
    """
    once = _swapped(word) if most else []
    twice = sorted({v for w in once for v in _swapped(w)})
    listed = lambda ws: f"array({', '.join(map(_literal, ws))})"
    cases = [f"WHEN p BETWEEN 0 AND {min(1, most)} THEN p"]
    if once:
        cases.append(f"WHEN array_contains({listed(once)}, {term}) THEN 1")
    if most == 2:
        cases.append("WHEN p = 2 THEN 2")
    if most == 2 and once:  # only distances of 3 and 4 can shrink by swaps
        swap = f"concat(substring({term}, 1, i - 1), substring({term}, i + 1, 1), substring({term}, i, 1), substring({term}, i + 2))"
        near = [f"array_contains({listed(twice)}, {term})"] if twice else []
        near.append(f"exists({listed(once)}, w -> levenshtein({term}, w, 1) BETWEEN 0 AND 1)")
        near.append(f"exists(sequence(1, greatest(length({term}) - 1, 1)), i -> levenshtein({swap}, {_literal(word)}, 1) BETWEEN 0 AND 1)")
        cases.append(f"WHEN p BETWEEN 3 AND 4 AND ({' OR '.join(near)}) THEN 2")
    return f"element_at(transform(array(levenshtein({term}, {_literal(word)}, {2 * most})), p -> CASE {' '.join(cases)} END), 1)"


def expansions(index: FieldedIndex, nodes: list[tuple[int, Fuzzy]]) -> DataFrame:
    """``(clause, field, term, df, boost)`` of the words near those of fuzzy clauses, by one pass over the dictionary.

    Per clause and field the nearest, at most ``node.expansions``; boost falls with the distance.
    """
    found = []
    for clause, node in nodes:
        n = len(node.text)
        here = f"length(term) BETWEEN {n - node.edits} AND {n + node.edits}"
        if node.fields:
            here += f" AND field IN ({', '.join(map(_literal, node.fields))})"
        found.append(f"named_struct('clause', {clause}, 'length', {n}, 'most', {node.expansions}, 'd', CASE WHEN {here} THEN {edits('term', node.text, node.edits)} END)")
    near = index.terms.selectExpr("field", "term", "df", f"inline(array({', '.join(found)}))").where("d IS NOT NULL")
    near = near.selectExpr("*", "row_number() OVER (PARTITION BY clause, field ORDER BY d, term) AS n").where("n <= most")
    return near.selectExpr("clause", "field", "term", "df", "1.0D - d / least(length(term), length) AS boost")


def phrase_frequency(words: tuple[str, ...], positions: dict[str, Column], slop: int) -> Column:
    """How often a phrase occurs: each start counts ``1 / (1 + moves)``; exact phrases count 1 each. Repeated words need as many positions."""
    
    def moved(w: str, i: int) -> Column:
        return F.transform(positions[w], lambda p: p - i)

    shifted = [moved(w, i) for i, w in enumerate(words)]
    if slop == 0:
        both = shifted[0]
        for s in shifted[1:]:
            both = F.array_intersect(both, s)
        return F.size(both).cast("double")
    starts = F.array_distinct(F.flatten(F.array(*shifted)))

    def found(q: Column) -> Column:
        ends = [F.array_min(F.filter(s, lambda p: p >= q)) for s in shifted]  # one argument: two would pass the index
        width = F.greatest(*ends) - q if len(ends) > 1 else ends[0] - q
        missing = ends[0].isNull()
        for e in ends[1:]:
            missing = missing | e.isNull()
        return F.when(missing | (width > slop), 0.0).otherwise(1.0 / (1.0 + width))

    enough = F.lit(True)
    for w in set(words):
        enough = enough & (F.size(positions[w]) >= words.count(w))
    return F.when(enough, F.aggregate(F.transform(starts, found), F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


class Compiler:
    """One tree over one index."""

    def __init__(self, index: FieldedIndex, all_fields: tuple[str, ...]):
        self.index, self.all_fields = index, all_fields
        self.spark = index.postings.sparkSession
        self.leaves = Leaves()

    def fields_of(self, node: Term | Fuzzy | Phrase) -> tuple[str, ...]:
        return node.fields or self.all_fields

    def collect(self, node: Node) -> tuple:
        """The tree with clause numbers in place of leaves."""
        if isinstance(node, Bool):
            return ("bool", [self.collect(n) for n in node.must], [self.collect(n) for n in node.should], [self.collect(n) for n in node.must_not])
        return ("leaf", self.leaves.add(node))

    def words(self) -> dict[str, list]:
        """Columns clause, field, term, weight and avgdl of all words that word clauses ask for and the dictionary holds."""
        rows: list[tuple[int, str, str, int, float]] = []
        exact = [(i, n) for i, n in enumerate(self.leaves.nodes) if isinstance(n, Term)]
        if exact:
            known: dict[tuple[str, str], int] = {}
            for r in sinks.holding(self.index.terms, [n.text for _, n in exact]).select("field", "term", "df").collect():  # at most a row per asked word and field
                known[r["field"], r["term"]] = r["df"]
            rows += [(i, f, n.text, known[f, n.text], float(n.boost)) for i, n in exact for f in self.fields_of(n) if (f, n.text) in known]
        fuzzy = [(i, Fuzzy(n.text, self.fields_of(n), n.edits, n.expansions)) for i, n in enumerate(self.leaves.nodes) if isinstance(n, Fuzzy)]
        if sum(n.expansions * len(n.fields) for _, n in fuzzy) + len(rows) > MOST_WORDS:
            raise ValueError(f"a query holds at most {MOST_WORDS} words")
        if fuzzy:
            rows += [tuple(r) for r in expansions(self.index, fuzzy).collect()]
        out: dict[str, list] = {c: [] for c in ("clause", "field", "term", "weight", "avgdl")}
        for clause, field, term, df, boost in rows:
            docs, words = self.index.statistics[field]
            for c, v in zip(out, (clause, field, term, boost * math.log(1 + (docs - df + 0.5) / (df + 0.5)), words / docs)):
                out[c].append(v)
        return out

    def word_hits(self) -> DataFrame | None:
        """``(doc_id, clause, score)`` of every posting of the word clauses, not yet summed up."""
        if not any(isinstance(n, Term | Fuzzy) for n in self.leaves.nodes):
            return None
        words = self.words()
        schema = pa.schema([("clause", pa.int32()), ("field", pa.string()), ("term", pa.string()), ("weight", pa.float64()), ("avgdl", pa.float64())])
        weighed = self.spark.createDataFrame(pa.table(words, schema=schema))  # at most MOST_WORDS rows
        posted = sinks.holding(self.index.postings, words["term"]).where(F.col("field").isin(sorted(set(words["field"])))).select("field", "term", "doc_id", "tf", "dl")
        score = F.col("weight") * saturation(F.col("tf"), F.col("dl"), F.col("avgdl"))
        return posted.join(F.broadcast(weighed), ["field", "term"]).select("clause", "doc_id", score.alias("score"))

    def phrase_hits(self, clause: int, node: Phrase) -> DataFrame:
        fields = self.fields_of(node)
        words = list(dict.fromkeys(node.words))
        posted = sinks.holding(self.index.postings, words).where(F.col("field").isin(*fields))
        df = sinks.holding(self.index.terms, words).where(F.col("field").isin(*fields)).join(F.broadcast(self.index.fields), "field")  # a row per field
        idfs = df.withColumn("i", idf(F.col("doc_count"), F.col("df"))).groupBy("field", "doc_count", "sum_tf").pivot("term", words).agg(F.first("i"))
        weight = F.lit(0.0)
        for w in node.words:
            weight = weight + F.coalesce(F.col(f"`{w}`"), F.lit(0.0))
        idfs = idfs.select("field", "doc_count", "sum_tf", weight.alias("weight"))
        docs = posted.groupBy("field", "doc_id", "dl").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"), F.count("*").alias("n")).where(F.col("n") == len(words))
        freq = phrase_frequency(node.words, {w: F.element_at("at", F.lit(w)) for w in words}, node.slop)
        hits = docs.withColumn("tf", freq).where("tf > 0").join(F.broadcast(idfs), "field")
        score = F.col("weight") * saturation(F.col("tf"), F.col("dl"), F.col("sum_tf") / F.col("doc_count"))
        return hits.groupBy("doc_id").agg(F.sum(score).alias("score")).select(F.lit(clause).alias("clause"), "doc_id", "score")

    def catalog_hits(self, clause: int, node: Range | Keyword) -> DataFrame:
        c = F.col(node.column)
        if isinstance(node, Keyword):
            test = c == F.lit(node.value) if node.exact else F.lower(c) == F.lower(F.lit(node.value))
        else:
            test = c.isNotNull()
            test = test & (c >= node.low) if node.low is not None else test
            test = test & (c <= node.high) if node.high is not None else test
        return self.index.catalog.where(test).select(F.lit(clause).alias("clause"), "doc_id", F.lit(1.0).alias("score"))

    def run(self, node: Node) -> DataFrame:
        """``(doc_id, score)`` of every matching document."""
        tree = self.collect(node)
        parts = [p for p in [self.word_hits()] if p is not None]
        for i, n in enumerate(self.leaves.nodes):
            if isinstance(n, Phrase):
                parts.append(self.phrase_hits(i, n))
            elif isinstance(n, (Range, Keyword)):
                parts.append(self.catalog_hits(i, n))
        hits = parts[0]
        for p in parts[1:]:
            hits = hits.unionByName(p)
        if tree[0] == "leaf" or not tree[1] and not tree[3] and all(t[0] == "leaf" for t in tree[2]):  # any of the clauses: their sum
            return hits.groupBy("doc_id").agg(F.sum("score").alias("score"))
        per = hits.groupBy("doc_id").agg(*(F.sum(F.when(F.col("clause") == i, F.col("score"))).alias(f"s{i}") for i in range(len(self.leaves.nodes))))
        matched, score = self.logic(tree)
        return per.where(matched).select("doc_id", score.alias("score"))

    def logic(self, tree: tuple) -> tuple[Column, Column]:
        """Whether a document matches, and its score: the sum over matching must and should clauses."""
        if tree[0] == "leaf":
            s = F.col(f"s{tree[1]}")
            return s.isNotNull(), F.coalesce(s, F.lit(0.0))
        must, should, must_not = ([self.logic(t) for t in part] for part in tree[1:])
        if must:
            ok = must[0][0]
            for m, _ in must[1:]:
                ok = ok & m
        else:
            ok = F.lit(False)
            for m, _ in should:
                ok = ok | m
        for m, _ in must_not:
            ok = ok & ~m
        total = F.lit(0.0)
        for m, s in (*must, *should):
            total = total + F.when(m, s).otherwise(0.0)
        return ok, total


def search(index: FieldedIndex, node: Node | None, fields: tuple[str, ...], k: int | None = 10) -> DataFrame:
    """``(doc_id, score)``, the ``k`` best (all if None), ties by document id; an empty query finds nothing."""
    if node is None:
        return index.catalog.where("false").select("doc_id", F.lit(0.0).alias("score"))
    hits = Compiler(index, fields).run(node).select("doc_id", F.round("score", 6).alias("score"))
    return hits.orderBy(F.desc("score"), "doc_id").limit(k) if k is not None else hits


def search_products(index: FieldedIndex, query: str, fields: tuple[str, ...], k: int = 10, field: str | None = None, fuzzy: bool = True, show: tuple[str, ...] = ("name", "brand", "category", "price_num")) -> DataFrame:
    """Free-text search with stored columns: ``score`` and ``show``, best first. The ``k`` best are found first, so that only their rows of the catalogue are read."""
    from .parser import free_text

    node = free_text(query, (field,) if field else fields, fuzzy)
    best = search(index, node, fields, k).toArrow()  # k rows
    ids = best.column("doc_id").to_pylist()
    hits = index.catalog.sparkSession.createDataFrame(best) if ids else index.catalog.where("false").select("doc_id", F.lit(0.0).alias("score"))
    return F.broadcast(hits).join(index.catalog.where(F.col("doc_id").isin(ids)), "doc_id").select("doc_id", "score", *show).orderBy(F.desc("score"), "doc_id").limit(k)

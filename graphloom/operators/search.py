"""Search: token statistics, tiered lexical ranking, nearest hints, vectors, fusion, briefs.

A query is a short text on the driver: its tokens, their inflections and weights become
literals, so scoring is one scan of the symbols without a shuffle, and a ranked page is a
top-k.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.identifiers import bag_vector, cosine, half_up, idf, idf_number, token_list, tokens, variants
from graphloom.functions.joins import numbered
from graphloom.functions.predicates import about_tests, is_test_path, task_words
from graphloom.operators.graph import context, reach

PATH_WEIGHT, LEAST_FRACTION = 0.6, 0.3


def token_frequency(symbols: DataFrame) -> DataFrame:
    """(token, df): symbols that have the token in name or path; once per symbol."""
    own = F.array_distinct(F.concat(tokens(F.col("qualified_name")), tokens(F.col("file"))))
    return symbols.select(F.explode(own).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def token_idf(symbols: DataFrame) -> DataFrame:
    total = F.broadcast(symbols.agg(F.count("*").alias("total")))
    return token_frequency(symbols).crossJoin(total).select("token", "df", idf(F.col("df"), F.col("total")).alias("idf"))


def query_weights(symbols: DataFrame, query: str, by: str | None = None) -> dict[str | None, dict[str, float]]:
    """The rarity of each query token, by its most frequent inflection; with ``by``, among the symbols of each value of that column.

    One scan: every inflection asked for is counted in the same aggregate.
    """
    asked = {t: variants(t) for t in token_list(query)}
    wanted = sorted({v for vs in asked.values() for v in vs})
    own = F.concat(tokens(F.col("qualified_name")), tokens(F.col("file")))
    group = [F.col(by).alias("part")] if by else []
    rows = symbols.select(*group, own.alias("own")).groupBy(*(["part"] if by else [])).agg(
        F.count("*").alias("total"), *[F.count_if(F.array_contains("own", v)).alias(f"n{i}") for i, v in enumerate(wanted)]).collect()
    return {
        (r.part if by else None): {t: idf_number(max(r[f"n{wanted.index(v)}"] for v in vs), r.total) for t, vs in asked.items()} for r in rows}


def _hits(asked: list[str]) -> list[tuple[Column, Column]]:
    names, paths = tokens(F.col("qualified_name")), tokens(F.col("file"))
    return [(F.arrays_overlap(names, forms), F.arrays_overlap(paths, forms)) for forms in (F.array(*map(F.lit, variants(t))) for t in asked)]


def search(symbols: DataFrame, query: str, by: str | None = None) -> DataFrame:
    """(id, qualified_name, kind, file, score, match): the best tier of each symbol that matches, one per name and kind.

    With ``by``, the symbols of each value of that column (kept in the result) are a project
    of their own, with its own token weights and its own best per name.  A blank query
    matches nothing.
    """
    low = query.strip().lower()
    keep = [by] if by else []
    if not low:
        return symbols.select(*keep, "id", "qualified_name", "kind", "file", F.lit(0.0).alias("score"), F.lit("").alias("match")).limit(0)
    weights = query_weights(symbols, query, by)
    asked = token_list(query)

    def weight(token: str) -> Column:
        if by is None:
            return F.lit(weights.get(None, {}).get(token, 0.0))
        return F.element_at(F.create_map(*[F.lit(x) for part, own in weights.items() for x in (part, own[token])]), F.col(by))

    name, full = F.lower("name"), F.lower("qualified_name")
    exact = (name == low) | (full == low)
    tier = (
        F.when(F.lower("id") == low, F.struct(F.lit(1.0).alias("score"), F.lit("exact-id").alias("match")))
        .when(exact, F.struct(F.lit(0.95).alias("score"), F.lit("exact").alias("match")))
        .when(name.startswith(low), F.struct((0.7 + 0.2 * len(low) / F.greatest(F.length(name), F.lit(1))).alias("score"), F.lit("prefix").alias("match")))
        .when(full.contains(low) | name.contains(low), F.struct((0.5 + 0.15 * F.least(len(low) / F.greatest(F.length(full), F.lit(1)), F.lit(1.0))).alias("score"), F.lit("substring").alias("match")))
        .otherwise(F.struct(F.lit(0.0).alias("score"), F.lit("").alias("match")))
    )
    rows = symbols.select(*keep, "id", "name", "qualified_name", "kind", "file", tier.alias("tier"))
    if asked and weights:
        hits = [(n, p, weight(t)) for t, (n, p) in zip(asked, _hits(asked))]
        got = reduce(lambda a, b: a + b, [F.when(n, w).when(p, PATH_WEIGHT * w).otherwise(0.0) for n, p, w in hits])
        total = reduce(lambda a, b: a + b, [w for _, _, w in hits])
        any_name = reduce(lambda a, b: a | b, [n for n, _, _ in hits])
        rows = rows.withColumn("fraction", F.when(total > 0, got / total).otherwise(0.0)).withColumn("named", any_name)
    else:
        rows = rows.withColumn("fraction", F.lit(0.0)).withColumn("named", F.lit(False))
    by_token = 0.25 + 0.43 * F.col("fraction")
    better = (F.col("fraction") >= LEAST_FRACTION) & (by_token > F.col("tier.score")) & (F.col("tier.score") < 0.95)
    scored = rows.select(
        *keep, "id", "qualified_name", "kind", "file",
        half_up(F.when(better, by_token).otherwise(F.col("tier.score")), 3).alias("score"),
        F.when(better, F.when(F.col("named"), "subtoken").otherwise("path")).otherwise(F.col("tier.match")).alias("match")).filter("score > 0")
    first = Window.partitionBy(*keep, "qualified_name", "kind").orderBy(F.desc("score"), "id")
    return scored.withColumn("place", F.row_number().over(first)).filter("place = 1").drop("place")


def ranked(hits: DataFrame, limit: int = 25) -> DataFrame:
    return hits.orderBy(F.desc("score"), "qualified_name", "id").limit(limit)


def nearest(symbols: DataFrame, query: str, limit: int = 3) -> DataFrame:
    """Hints for a query without hits: any shared token, else words as raw substrings; one per name."""
    rows = symbols.filter("kind <> 'd'")
    asked = token_list(query)
    hit = reduce(lambda a, b: a + b, [F.when(n, 1.0).when(p, PATH_WEIGHT).otherwise(0.0) for n, p in _hits(asked)], F.lit(0.0))
    scored = rows.withColumn("raw", hit / max(len(asked), 1)).filter("raw > 0")
    if scored.isEmpty():
        low = query.strip().lower()
        words = [w for w in low.split() if len(w) >= 3] or ([low] if len(low) >= 3 else [])
        found = reduce(lambda a, b: a | b, [F.lower("qualified_name").contains(w) | F.lower("name").contains(w) for w in words], F.lit(False))
        scored = rows.filter(found).withColumn("raw", F.lit(0.1))
    first = Window.partitionBy("qualified_name").orderBy(F.desc("raw"), "id")
    one = scored.withColumn("place", F.row_number().over(first)).filter("place = 1")
    return one.orderBy(F.desc("raw"), "qualified_name").limit(limit).select("id", "qualified_name", "kind", "file", half_up(F.least("raw", F.lit(0.99)), 3).alias("score"), F.lit("nearest").alias("match"))


def cosine_topk(vectors: DataFrame, query_id: int, k: int = 50, least: float = 0.1) -> DataFrame:
    """The ``k`` rows of ``vectors`` (vec_id, embedding) most like the one with ``query_id``; others lengths are skipped."""
    query = vectors.filter(F.col("vec_id") == query_id).select(F.col("embedding").alias("q")).limit(1)
    joined = vectors.crossJoin(F.broadcast(query)).filter(F.size("embedding") == F.size("q"))  # one row
    return joined.select("vec_id", cosine(F.col("embedding"), F.col("q")).alias("similarity")).filter(F.col("similarity") >= least).orderBy(F.desc("similarity"), "vec_id").limit(k)


def reciprocal_rank(hits: DataFrame, order: list, keep: int | None = None) -> DataFrame:
    """``hits`` with their rank from 1: all of them, or only the first ``keep``."""
    return numbered(hits if keep is None else hits.orderBy(*order).limit(keep), order)


def fuse(first: DataFrame, second: DataFrame, constant: int = 60) -> DataFrame:
    """(id, score, match) of two ranked lists (id, rank): reciprocal ranks, 1.0 for the first of both."""
    part = lambda rank: F.coalesce(1.0 / (constant + F.col(rank)), F.lit(0.0))
    joined = first.select("id", F.col("rank").alias("r1")).join(second.select("id", F.col("rank").alias("r2")), "id", "full")
    score = (part("r1") + part("r2")) / (2.0 / (constant + 1))
    match = F.when(F.col("r1").isNotNull() & F.col("r2").isNotNull(), "hybrid").when(F.col("r1").isNotNull(), "lexical").otherwise("semantic")
    return joined.select("id", half_up(score, 3).alias("score"), match.alias("match"))


def hybrid(symbols: DataFrame, lexical: DataFrame, semantic: DataFrame, query: str, floor: float = 0.7) -> DataFrame:
    """(id, qualified_name, kind, score, match): fused ranking of a query of several words that no name answers; else the lexical one.

    All lexical hits take part, and the ``semantic`` list (id, rank).  Of rows of one name and kind the best stays.
    """
    best = lexical.agg(F.max("score")).first()[0]
    if len(query.split()) < 2 or (best or 0) >= floor or semantic.isEmpty():
        return lexical.select("id", "qualified_name", "kind", "score", "match")
    ranks = reciprocal_rank(lexical.filter("kind <> 'd'"), [F.desc("score"), "qualified_name", "id"])
    fused = fuse(ranks, semantic).join(lexical.select("id", F.col("match").alias("own")), "id", "left")
    joined = fused.join(symbols.select("id", "qualified_name", "kind", "file"), "id")
    cut = F.when(is_test_path(F.col("file")) & F.lit(not about_tests(query)), 0.5).otherwise(1.0)
    match = F.when(F.col("match") == "lexical", F.col("own")).otherwise(F.col("match"))
    scored = joined.select("id", "qualified_name", "kind", half_up(F.col("score") * cut, 3).alias("score"), match.alias("match"))
    first = Window.partitionBy("qualified_name", "kind").orderBy(F.desc("score"), "id")
    return scored.withColumn("place", F.row_number().over(first)).filter("place = 1").drop("place")


def semantic_status(vectors: DataFrame | None, model: bool) -> str:
    """ok, no-index (no symbol has a vector) or no-dependency (no model for the query)."""
    if vectors is None or vectors.isEmpty():
        return "no-index"
    return "ok" if model else "no-dependency"


def embed_missing(symbols: DataFrame, vectors: DataFrame, embed: Callable[[Column], Column] = bag_vector) -> DataFrame:
    """(id, file, embedding) of the symbols in files without any vector; ``embed`` makes a vector of a passage."""
    rest = symbols.join(vectors.select("file").distinct(), "file", "left_anti")
    return passages(rest).join(rest.select("id", "file"), "id").select("id", "file", embed(F.col("passage")).alias("embedding"))


def task_hits(symbols: DataFrame, task: str) -> DataFrame:
    """The hits for a task's content words; if there are none, for the task as it stands; else for each of its longer words."""
    found = search(symbols, " ".join(task_words(task)) or task)
    if not found.isEmpty():
        return found
    found = search(symbols, task)
    if not found.isEmpty():
        return found
    each = [search(symbols, word).withColumn("turn", F.lit(n)) for n, word in enumerate(task_words(task, 2))]
    if not each:
        return found
    rows = reduce(DataFrame.unionAll, each)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("turn", F.desc("score")))).filter("place = 1").drop("place", "turn")


def brief(symbols: DataFrame, salience: DataFrame, task: str, most: int = 10, floor: float = 0.35, weak: float = 0.6) -> DataFrame:
    """(id, qualified_name, match, score, salience, combined) of the symbols a task is likely about."""
    hits = task_hits(symbols, task)
    rows = hits.join(salience.select("id", F.col("score").alias("salience")), "id", "left").withColumn("salience", F.coalesce("salience", F.lit(0.0)))
    confident = rows.filter("kind <> 'd'").filter(F.col("score") >= floor).filter(~(F.col("match").isin("substring", "path") & (F.col("salience") <= 0) & (F.col("score") < weak)))
    cut = F.when(is_test_path(F.col("file")) & F.lit(not about_tests(task)), 0.5).otherwise(1.0)
    combined = half_up((F.col("score") * 0.5 + F.col("salience") * 0.5) * cut, 4)
    return confident.select("id", "qualified_name", "match", "score", "salience", combined.alias("combined")).orderBy(F.desc("combined"), "id").limit(most)


def brief_sections(top: DataFrame, edges: DataFrame, symbols: DataFrame, metrics: DataFrame, inferences: DataFrame, risky: float = 0.1) -> DataFrame:
    """(section, place, text): what a brief says about its symbols ``top``, which are few.

    Their metrics (id, score, stability, coverage), the first one's neighbours and impact,
    what is volatile, and what was inferred before (target, confidence, text).
    """
    spark = top.sparkSession
    rows = F.broadcast(top.select("id", "qualified_name", "combined"))
    place = F.row_number().over(Window.orderBy(F.desc("combined"), "id"))
    own = rows.join(metrics.select("id", F.col("score").alias("own_score"), "stability", "coverage"), "id", "left")
    told = own.select(place.alias("place"), "id", "qualified_name", "own_score", "stability", "coverage")
    text = F.concat_ws(" ", "id", "qualified_name", F.concat(F.lit("salience="), F.coalesce("own_score", F.lit(0.0))), F.concat(F.lit("stability="), F.coalesce("stability", F.lit("unknown"))),
                       F.concat(F.lit("coverage="), F.coalesce("coverage", F.lit("unknown"))))
    sections = [told.select(F.lit("symbols").alias("section"), "place", text.alias("text")),
                told.filter("stability = 'volatile'").select(F.lit("volatile"), "place", "qualified_name")]
    first = top.orderBy(F.desc("combined"), "id").limit(1).select("id").collect()
    if first:
        one = spark.createDataFrame([(first[0].id,)], "id string")
        around = context(edges, symbols, one, 5)
        for side in ("callers", "callees"):
            sections.append(around.select(F.lit(side), F.posexplode(side)).toDF("section", "place", "text"))
        callers = reach(edges, one, 2, backward=True).join(metrics.select("id", F.col("score").alias("own_score"), "coverage"), "id", "left")
        risk = (F.col("distance") == 1) & (F.col("own_score") >= risky) & F.coalesce(F.col("coverage").isin("none", "unknown"), F.lit(True))
        counts = callers.agg(F.count_if(F.col("distance") == 1).alias("direct"), F.count("*").alias("all"), F.count_if(risk).alias("risky"))
        sections.append(counts.select(F.lit("impact"), F.lit(1), F.concat_ws(" ", F.concat(F.lit("direct="), "direct"), F.concat(F.lit("all="), "all"), F.concat(F.lit("risky="), "risky"))))
    known = inferences.join(rows.select(F.col("id").alias("target")), "target", "left_semi").orderBy("seq").limit(5)
    sections.append(known.select(F.lit("known"), F.lit(1), F.concat_ws(" ", "target", F.concat(F.lit("["), F.col("confidence").cast("string"), F.lit("]")), "text")))
    return reduce(DataFrame.unionAll, sections)


def grep(lines: DataFrame, pattern: str) -> DataFrame:
    """(key, line, text) of the lines of texts (key, text) that match."""
    split = lines.select("key", F.posexplode(F.split("text", "\n")).alias("at", "line_text"))
    return split.filter(F.col("line_text").rlike(pattern)).select("key", (F.col("at") + 1).alias("line"), F.col("line_text").alias("text"))


def windows_of(hits: DataFrame, width: int = 120) -> DataFrame:
    """(key, start, stop): windows of ``width`` lines around hits (key, line), joined where they touch."""
    half = width // 2
    rows = hits.select("key", F.greatest(F.lit(1), F.col("line") - half).alias("start"), (F.col("line") + half).alias("stop"))
    order = Window.partitionBy("key").orderBy("start", "stop")
    reached = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("new", (reached.isNull() | (F.col("start") > reached + 1)).cast("int"))
    grouped = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("key", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def keywords(texts: DataFrame, stop_words: tuple[str, ...], most: int = 6) -> DataFrame:
    """The first distinct content words of each text (key, text)."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z_][a-z0-9_]{2,}"), F.lit(0)), lambda w: ~w.isin(*stop_words)))
    return texts.select("key", F.slice(words, 1, most).alias("keywords"))


def passages(symbols: DataFrame, most_signature: int = 200, most: int = 400) -> DataFrame:
    """(id, passage): what stands for a symbol when it is embedded."""
    line = F.filter(F.transform(F.split(F.coalesce("body_text", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) > 0) & ~x.startswith("#") & ~x.startswith("//"))
    first = F.coalesce(F.get(line, F.lit(1)), F.lit(""))
    text = F.concat_ws(" ", "kind", "qualified_name", F.substring("signature", 1, most_signature), first)
    return symbols.filter("kind <> 'd'").select("id", F.substring(text, 1, most).alias("passage"))

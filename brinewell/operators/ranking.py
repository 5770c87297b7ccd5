"""Re-ranking of a page of candidates: TF-IDF cosine, preference, blend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brinewell.functions.text import min_max, query_terms, tokenize
from brinewell.session import cut_lineage

VSM_WEIGHTS = {"title": 0.5, "content": 0.4, "anchor_text": 0.1}
BLEND = {"bm25": 0.60, "vsm": 0.20, "pagerank": 0.15, "preference": 0.05}


def vsm_scores(candidates: DataFrame, id_col: str, q: str, weights: dict[str, float] | None = None) -> DataFrame:
    """(id, vsm): cosine of query and candidate per field, weighted, min-max scaled over the candidates.

    The query is one more document of the batch: idf = ln((N + 1) / (df + 1)) + 1 with N = candidates + 1.
    A candidate without terms has cosine 0. A single candidate, or equal ones, get 0.
    """
    weights = weights or VSM_WEIGHTS
    terms = query_terms(q)
    # a page of candidates is read several times below: the search that found it must not be
    candidates = cut_lineage(candidates.select(id_col, *weights))
    own = {t: terms.count(t) / len(terms) for t in dict.fromkeys(terms)}
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(float(w)).alias("weight"), tokenize(F.col(f)).alias("tokens")) for f, w in weights.items()]))
    fields = candidates.select(F.col(id_col).alias("id"), each.alias("x")).select("id", "x.field", "x.weight", "x.tokens")
    tf = (
        fields.select("id", "field", "weight", F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
        .groupBy("id", "field", "weight", "term", "len")
        .agg(F.count("*").alias("n"))
        .select("id", "field", "weight", "term", (F.col("n").cast("double") / F.col("len")).alias("tf"))
    )
    tf = cut_lineage(tf)
    n_docs = candidates.agg((F.count("*") + 1).cast("double").alias("n_docs"))
    query = F.create_map(*[x for t, v in own.items() for x in (F.lit(t), F.lit(v))]) if own else F.create_map().cast("map<string,double>")
    df = tf.groupBy("field", "term").agg(F.count("*").alias("df"))
    in_query = F.coalesce(F.element_at(query, F.col("term")), F.lit(0.0))
    idf = df.crossJoin(F.broadcast(n_docs)).select(
        "field", "term", in_query.alias("q_tf"), (F.log((F.col("n_docs") + 1) / (F.col("df") + F.when(in_query > 0, 1).otherwise(0) + 1)) + 1).alias("idf")
    )
    # query terms that no candidate has still lengthen the query's vector
    spark = candidates.sparkSession
    terms_df = spark.createDataFrame([(f, t, v) for f in weights for t, v in own.items()], "field string, term string, q_tf double")
    q_norm = (
        terms_df.join(df, ["field", "term"], "left")
        .crossJoin(F.broadcast(n_docs))
        .withColumn("idf", F.log((F.col("n_docs") + 1) / (F.coalesce("df", F.lit(0)) + 2)) + 1)
        .groupBy("field")
        .agg(F.sqrt(F.sum(F.pow(F.col("q_tf") * F.col("idf"), 2))).alias("q_norm"))
    )
    cos = (
        tf.join(idf, ["field", "term"])
        .groupBy("id", "field", "weight")
        .agg(F.sum(F.col("tf") * F.col("idf") * F.col("q_tf") * F.col("idf")).alias("dot"), F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("norm"))
        .join(q_norm, "field")
        .withColumn("cos", F.coalesce(F.col("dot") / F.nullif(F.col("norm") * F.col("q_norm"), F.lit(0.0)), F.lit(0.0)))
    )
    raw = cos.groupBy("id").agg(F.sum(F.col("weight") * F.col("cos")).alias("s"))
    all_ = candidates.select(F.col(id_col).alias("id")).join(raw, "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("s"))
    # candidates are a page: the unpartitioned window holds a page's rows
    w = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return all_.select(F.col("id").alias(id_col), min_max(F.col("s"), F.min("s").over(w), F.max("s").over(w)).alias("vsm"))


def preference_score(title: Column, snippet: Column, category: Column, site: Column, keywords: Column, college: Column, interests: Column) -> Column:
    """Preference of a profile for a result, rounded to 4 places.

    keywords: array of (keyword, weight), matched in any case: 2 x weight in the title, 0.5 x in the
    snippet. college, matched as written: 2 in the title, 0.5 in the snippet or the site. interests,
    any case: 2 in the title, 0.5 in the snippet, 1.5 in the category. Presence counts, not frequency;
    null and empty terms count nothing.
    """
    t, s, c = (F.lower(F.coalesce(x, F.lit(""))) for x in (title, snippet, category))
    kw = F.aggregate(
        F.coalesce(keywords, F.array().cast("array<struct<keyword:string,weight:double>>")),
        F.lit(0.0),
        lambda a, k: a
        + F.when(F.contains(t, F.lower(k["keyword"])), F.lit(2.0) * k["weight"]).otherwise(0.0)
        + F.when(F.contains(s, F.lower(k["keyword"])), F.lit(0.5) * k["weight"]).otherwise(0.0),
    )
    has = F.coalesce(college, F.lit("")) != ""
    col = F.when(has & F.contains(F.coalesce(title, F.lit("")), college), 2.0).otherwise(0.0) + F.when(
        has & (F.contains(F.coalesce(snippet, F.lit("")), college) | F.contains(F.coalesce(site, F.lit("")), college)), 0.5
    ).otherwise(0.0)
    terms = F.filter(F.coalesce(interests, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    count = lambda text: F.size(F.filter(terms, lambda x: F.contains(text, F.lower(x))))
    return F.round(kw + col + F.lit(2.0) * count(t) + F.lit(0.5) * count(s) + F.lit(1.5) * count(c), 4)


def with_profile(results: DataFrame, users: DataFrame, user_id: int | None, keywords: DataFrame) -> DataFrame:
    """Results with ``preference`` for a user; 0 for none or an unknown one. ``keywords``: (role, keyword, weight)."""
    if user_id is None:
        return results.withColumn("preference", F.lit(0.0))
    user = users.where(F.col("id") == user_id).select("role", "college", "interests").limit(1)
    kw = keywords.join(user.select("role"), "role", "left_semi").agg(F.collect_list(F.struct("keyword", "weight")).alias("keywords"))
    joined = results.join(F.broadcast(user), F.lit(True), "left").crossJoin(F.broadcast(kw))  # at most one row each
    score = preference_score(F.col("title"), F.col("snippet"), F.col("category"), F.col("source_site"), F.col("keywords"), F.col("college"), F.col("interests"))
    return joined.select(*results.columns, F.coalesce(score, F.lit(0.0)).alias("preference"))


def blend(results: DataFrame, id_col: str, weights: dict[str, float] | None = None) -> DataFrame:
    """``final_score``: the weighted sum of bm25, vsm, pagerank and preference (nulls count 0), 4 places;
    ordered by it, then bm25, then id."""
    weights = weights or BLEND
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.lit(w) * F.coalesce(c, F.lit(0.0))
    return results.withColumn("final_score", F.round(total, 4)).orderBy(F.desc("final_score"), F.desc("bm25"), id_col)


def related_rank(results: DataFrame, id_col: str) -> DataFrame:
    """``final_score``: search score and preference with equal weights, 4 places."""
    return results.withColumn("final_score", F.round(F.col("score") + F.col("preference"), 4)).orderBy(F.desc("final_score"), F.desc("score"), id_col)

"""Scope phrases: how well hits fit weighted phrases, and filtering or re-scoring by it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.scores import clamp01, round6
from rankloom.functions.text import words
from rankloom.functions.vectors import cosine
from rankloom.session import cut, once, small


#: Phrases up to which every hit carries all of its context; phrases that meet a content in one group; characters of a short phrase's key.
FEW_PHRASES, BUCKET_PHRASES, GRAM = 500, 1000, 3


@dataclass
class ScopeConfig:
    """Fixed default values of the scope rules."""

    min_similarity: float = 0.25
    scope_weight: float = 0.3
    lexical_weight: float = 0.5
    embed_band: tuple[float, float] = (0.1, 0.55)


def lexical_sim(content_lower: Column, content_words: Column, phrase_lower: Column, phrase_words: Column) -> Column:
    """Share of the phrase's words found in the content, plus 0.3 when it contains the phrase; at most 1."""
    recall = F.size(F.array_intersect(phrase_words, content_words)) / F.size(phrase_words)
    bonus = F.when(content_lower.contains(phrase_lower), 0.3).otherwise(0.0)
    usable = (F.size(phrase_words) > 0) & (F.size(content_words) > 0)
    return F.when(usable, F.least(F.lit(1.0), recall + bonus)).otherwise(F.lit(0.0))


def hybrid_sim(lexical: Column, content_emb: Column, phrase_emb: Column, cfg: ScopeConfig) -> Column:
    """Lexical similarity, blended with the cosine when both vectors exist and it lies in the band."""
    low, high = cfg.embed_band
    lw = min(1.0, max(0.0, cfg.lexical_weight))
    inside = (lexical >= low) & (lexical < high) & content_emb.isNotNull() & phrase_emb.isNotNull()
    return F.when(inside, clamp01(lw * lexical + (1 - lw) * clamp01(cosine(content_emb, phrase_emb)))).otherwise(lexical)


def fold_phrases(phrases: DataFrame) -> DataFrame:
    """One row per context with its phrases as an array; words are split and weights checked once."""
    weight = F.col("weight")
    usable = weight.isNotNull() & ~F.isnan(weight) & (weight >= 0) & (weight != float("inf"))
    emb = F.col("embedding") if "embedding" in phrases.columns else F.lit(None).cast("array<double>")
    return (
        phrases.select(
            "context_id",
            F.struct(
                "phrase_id",
                F.lower("text").alias("text"),
                F.array_distinct(words("text")).alias("words"),
                F.when(usable, weight).otherwise(F.lit(1.0)).alias("weight"),
                F.col("min_similarity").alias("floor"),
                emb.alias("embedding"),
            ).alias("p"),
        )
        .groupBy("context_id")
        .agg(F.array_sort(F.collect_list("p")).alias("phrases"), F.max("p.weight").alias("max_weight"))
    )


def phrase_sims(hits: DataFrame, phrases: DataFrame, cfg: ScopeConfig) -> DataFrame:
    """Hits with ``sims``, an array of (sim, weight, floor), one element per phrase of the context.

    The phrases are a small dimension folded to one row per context, so a hit stays one row and
    its content is read in place.
    """
    emb = F.col("embedding") if "embedding" in hits.columns else F.lit(None).cast("array<double>")
    rows = once(
        hits.join(small(fold_phrases(phrases)), "context_id", "left"),
        _lower=F.lower("content"), _words=F.array_distinct(words("content")), _emb=emb,
    )

    def one(p: Column) -> Column:
        lexical = lexical_sim(F.col("_lower"), F.col("_words"), p["text"], p["words"])
        sim = hybrid_sim(lexical, F.col("_emb"), p["embedding"], cfg)
        return F.struct(round6(sim).alias("sim"), p["weight"].alias("weight"), p["floor"].alias("floor"))

    return once(rows, sims=F.transform("phrases", one)).drop("_lower", "_words", "_emb", "phrases")


def _signals(sims: Column, default_floor: Column) -> tuple[Column, Column, Column]:
    passing = F.filter(sims, lambda s: s["sim"] >= F.coalesce(s["floor"], default_floor))
    none = sims.isNull() | (F.size(sims) == 0)

    def best(value) -> Column:
        top = F.coalesce(F.array_max(F.transform(passing, value)), F.lit(0.0))
        return F.when(none, F.lit(1.0)).otherwise(top)

    return (
        best(lambda s: s["sim"]),
        round6(best(lambda s: s["sim"] * s["weight"])),
        none | (F.size(passing) > 0),
    )


def _grams(text: Column, length: int) -> Column:
    """All different runs of ``length`` characters of a text."""
    places = F.sequence(F.lit(1), F.length(text) - (length - 1))
    return F.when(F.length(text) >= length, F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(length))))).otherwise(F.array().cast("array<string>"))


def indexed_signals(hits: DataFrame, phrases: DataFrame, cfg: ScopeConfig, bucket: int = BUCKET_PHRASES) -> DataFrame:
    """``scope_signals`` for any number of phrases: words of phrases are join keys, nothing is broadcast or folded whole.

    A phrase of three words or more that a content contains shares an inner word with it, so candidates are those that share a
    word, and of the others those whose last characters occur. Of them only phrases go on that can pass: by the words that they
    share, or because the content may contain them. They meet the content in groups of about ``bucket``.
    """
    emb = F.col("embedding") if "embedding" in hits.columns else F.lit(None).cast("array<double>")
    with_vectors = "embedding" in hits.columns and "embedding" in phrases.columns
    if with_vectors and cfg.embed_band[0] <= 0:
        raise ValueError("phrases without a common word count here: the band of the embeddings begins at 0")
    rows = cut(hits.withColumn("_hit", F.monotonically_increasing_id()))
    contents = rows.select("_hit", "context_id", F.lower("content").alias("_lower"), emb.alias("_emb"))
    weight = F.col("weight")
    usable = weight.isNotNull() & ~F.isnan(weight) & (weight >= 0) & (weight != float("inf"))
    told = phrases.select(
        F.monotonically_increasing_id().alias("p"), "context_id", F.lower("text").alias("text"), F.size(words("text")).alias("said"),
        F.array_distinct(words("text")).alias("words"), F.when(usable, weight).otherwise(F.lit(1.0)).alias("weight"),
        F.coalesce("min_similarity", F.lit(cfg.min_similarity)).alias("floor"),
        (F.col("embedding") if "embedding" in phrases.columns else F.lit(None).cast("array<double>")).alias("vector"),
    )
    told = cut(told.withColumn("n", F.size("words")))
    per_context = told.groupBy("context_id").agg(F.max("weight").alias("max_weight"), F.bool_or(F.col("floor") <= 0).alias("_free"), F.ceil(F.count("*") / bucket).alias("_buckets"))

    shared = (
        contents.select("_hit", "context_id", F.explode(F.array_distinct(words("_lower"))).alias("word"))
        .join(told.select("context_id", "p", F.explode("words").alias("word")), ["context_id", "word"])
        .groupBy("_hit", "p").agg(F.count("*").alias("matched"))
    )
    short = told.where((F.col("said") <= 2) & (F.col("n") > 0)).withColumn("g", F.least(F.length("text"), F.lit(GRAM)))
    keys = short.select("context_id", "p", F.col("text").substr(F.length("text") - F.col("g") + 1, F.col("g")).alias("gram"))
    grams = contents.select("_hit", "context_id", F.explode(F.array_distinct(F.flatten(F.array(*[_grams(F.col("_lower"), i) for i in range(1, GRAM + 1)])))).alias("gram"))
    inside = grams.join(keys, ["context_id", "gram"]).select("_hit", "p", F.lit(0).cast("bigint").alias("matched"))
    met = shared.unionByName(inside).groupBy("_hit", "p").agg(F.max("matched").alias("matched")).join(told.drop("context_id", "words"), "p")
    may_pass = (F.col("matched") >= F.col("floor") * F.col("n")) | (F.col("said") <= 2) | (F.col("matched") >= F.col("n") - 2)
    met = met.where(may_pass if not with_vectors else may_pass | F.col("vector").isNotNull())
    buckets = per_context.select("context_id", "_buckets")
    placed = met.join(contents.select("_hit", "context_id"), "_hit").join(buckets, "context_id").withColumn("_b", F.pmod("p", F.col("_buckets")))
    groups = placed.groupBy("_hit", "_b").agg(F.collect_list(F.struct("matched", "n", "text", "weight", "floor", "vector")).alias("_met"))

    def one(x: Column) -> Column:
        bonus = F.when(F.col("_lower").contains(x["text"]), 0.3).otherwise(0.0)
        lexical = F.least(F.lit(1.0), x["matched"] / x["n"] + bonus)
        return F.struct(round6(hybrid_sim(lexical, F.col("_emb"), x["vector"], cfg)).alias("sim"), x["weight"].alias("weight"), x["floor"].alias("floor"))

    judged = once(groups.join(contents.where(F.size(words("_lower")) > 0), "_hit"), _sims=F.transform("_met", one))
    passing = F.filter("_sims", lambda x: x["sim"] >= x["floor"])
    found = judged.groupBy("_hit").agg(
        F.max(F.array_max(F.transform(passing, lambda x: x["sim"]))).alias("_sim"),
        F.max(F.array_max(F.transform(passing, lambda x: x["sim"] * x["weight"]))).alias("_weighted"),
    )
    joined = rows.join(found, "_hit", "left").join(per_context.drop("_buckets"), "context_id", "left")
    none = F.col("max_weight").isNull()

    def best(c: str) -> Column:
        return F.when(none, F.lit(1.0)).otherwise(F.coalesce(c, F.lit(0.0)))

    return joined.select(
        *hits.columns, "max_weight", best("_sim").alias("best_sim"), round6(best("_weighted")).alias("best_weighted"),
        (none | F.col("_sim").isNotNull() | F.coalesce("_free", F.lit(False))).alias("any_phrase"),
    )


def scope_signals(hits: DataFrame, phrases: DataFrame, cfg: ScopeConfig | None = None) -> DataFrame:
    """Add best_sim, best_weighted and any_phrase per hit; without phrases they are 1, 1 and true.

    Contexts of at most FEW_PHRASES phrases travel with their hits, in all at most so many; beyond, phrases are looked up by their words.
    """
    cfg = cfg or ScopeConfig()
    if phrases.limit(FEW_PHRASES + 1).count() > FEW_PHRASES and (cfg.embed_band[0] > 0 or "embedding" not in hits.columns):
        return indexed_signals(hits, phrases, cfg)
    rows = phrase_sims(hits, phrases, cfg)
    sim, weighted, some = _signals(F.col("sims"), F.lit(cfg.min_similarity))
    return once(rows, best_sim=sim, best_weighted=weighted, any_phrase=some).drop("sims")


def _kept(cfg: ScopeConfig) -> Column:
    return F.col("any_phrase") & (F.col("best_sim") >= cfg.min_similarity)


def _strength() -> Column:
    return clamp01(F.col("best_weighted") / F.greatest(F.lit(1.0), F.coalesce("max_weight", F.lit(1.0))))


def scope(hits: DataFrame, phrases: DataFrame, mode: str = "filter", cfg: ScopeConfig | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Apply the phrases to (query_id, context_id, rank, id, score, content) lists.

    filter keeps fitting hits in their order; rerank blends the fit into every score and sorts anew; boost
    raises the scores of fitting hits and leaves the order. Columns in ``drop`` end with the fit: a list is put in order without them.
    """
    cfg = cfg or ScopeConfig()
    s = scope_signals(hits, phrases, cfg)
    w = min(1.0, max(0.0, cfg.scope_weight))
    columns = [c for c in hits.columns if c not in ("rank", "score", *drop)]
    per_query = Window.partitionBy("query_id")
    if mode == "filter":
        order = per_query.orderBy("rank", "id")
        return s.filter(_kept(cfg)).select(*columns, "score", F.row_number().over(order).alias("rank"))
    if mode == "rerank":
        scored = s.withColumn("score", round6((1 - w) * F.col("score") + w * _strength()))
        order = per_query.orderBy(F.desc("score"), "rank", "id")
        return scored.select(*columns, "score", F.row_number().over(order).alias("rank"))
    if mode == "boost":
        raised = F.when(_kept(cfg), round6(F.col("score") * (1 + w * _strength()))).otherwise(F.col("score"))
        return s.select(*columns, raised.alias("score"), "rank")
    raise ValueError(f"unknown scope mode {mode}")


def scope_stats(hits: DataFrame, phrases: DataFrame, cfg: ScopeConfig | None = None) -> DataFrame:
    """Per query: hits in, out and filtered, and the mean fit of those kept."""
    cfg = cfg or ScopeConfig()
    s = scope_signals(hits, phrases, cfg).withColumn("kept", _kept(cfg))
    return s.groupBy("query_id").agg(
        F.count("*").alias("n_in"),
        F.count_if("kept").alias("n_out"),
        F.count_if(~F.col("kept")).alias("filtered"),
        round6(F.coalesce(F.avg(F.when(F.col("kept"), F.col("best_sim"))), F.lit(0.0))).alias("mean_sim"),
    )


def scope_discards(hits: DataFrame, phrases: DataFrame, cfg: ScopeConfig | None = None) -> DataFrame:
    """Hits that the filter drops, with their fit and the threshold."""
    cfg = cfg or ScopeConfig()
    s = scope_signals(hits, phrases, cfg).filter(~_kept(cfg))
    return s.select("query_id", "id", F.col("best_sim").alias("similarity"), F.lit(cfg.min_similarity).alias("threshold"))


def scope_sweep(
    hits: DataFrame, phrases: DataFrame, thresholds: list[float], mode: str = "filter", cfg: ScopeConfig | None = None
) -> DataFrame:
    """Per query and threshold: how many hits stay, and which. Fits are computed once per hit.

    Only the filter mode drops hits. Contents are gone before the sweep multiplies rows, and the id lists are
    those of one response, which the data model bounds.
    """
    cfg = cfg or ScopeConfig()
    sims = phrase_sims(hits, phrases, cfg).select("query_id", "rank", "id", "sims")
    points = sims.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    sim, _, some = _signals(F.col("sims"), F.col("threshold"))
    kept = (some & (sim >= F.col("threshold"))) if mode == "filter" else F.lit(True)

    def ids(which: Column) -> Column:
        listed = F.array_sort(F.collect_list(F.when(which, F.struct("rank", "id"))))
        return F.array_join(F.transform(listed, lambda x: x["id"].cast("string")), ",")

    return (
        points.withColumn("kept", kept)
        .groupBy("query_id", "threshold")
        .agg(
            F.count_if("kept").alias("n_kept"),
            F.count_if(~F.col("kept")).alias("n_dropped"),
            ids(F.col("kept")).alias("kept_ids"),
            ids(~F.col("kept")).alias("dropped_ids"),
        )
    )

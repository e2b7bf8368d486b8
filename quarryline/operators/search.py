"""Retrieval over files and vectors, fitting summaries, and edit suggestions.

Defined results: null texts count as empty; a question without words scores nothing; ties are broken by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import cosine, tokens

def lexical_score(text: Column, question: Column, bonus: Column) -> Column:
    """One point for each word of the question (repeats count) found anywhere in the text, 0.3 for entry files."""
    hits = F.aggregate(question, F.lit(0.0), lambda s, t: s + F.when(F.contains(text, t), 1.0).otherwise(0.0))
    return F.round(hits + F.when(bonus & (hits > 0), 0.3).otherwise(0.0), 6)


def retrieve(corpus: DataFrame, questions: list[tuple[int, str]], top: int = 20, rest: int = 10, slices: int = 256) -> DataFrame:
    """Best files for each question: the ``top`` with a score, or the first ``rest`` of all where none has one.

    corpus(id, text, entry). The questions are a list that was asked, so they travel in the plan; every file is scored
    for each of them in one pass. The best of each slice of the files are kept first, so no task sees more rows of a
    question than slices times the length of its list.
    """
    low = corpus.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("_t"), F.coalesce("entry", F.lit(False)).alias("entry"))
    asked = F.array(*[F.struct(F.lit(k).alias("question_id"), tokens(F.lit(q)).alias("words")) for k, q in questions])
    scored = low.select("id", F.explode(F.transform(asked, lambda q: F.struct(q["question_id"].alias("question_id"), lexical_score(F.col("_t"), q["words"], F.col("entry")).alias("score")))).alias("s")).select("id", "s.*")
    order, most = [F.desc("score"), "id"], max(top, rest)
    first = Window.partitionBy("question_id", F.pmod(F.xxhash64("id"), F.lit(slices))).orderBy(*order)
    few = scored.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).drop("_n")
    whole = Window.partitionBy("question_id")
    ranked = few.withColumn("rank", F.row_number().over(whole.orderBy(*order))).where(F.col("rank") <= most).withColumn("_some", F.max("score").over(whole) > 0)
    return ranked.where((F.col("_some") & (F.col("score") > 0) & (F.col("rank") <= top)) | (~F.col("_some") & (F.col("rank") <= rest))).drop("_some")


def rerank(vectors: DataFrame, query: Column, k: int | None = None) -> DataFrame:
    """0.3 of the cosine to the query and 0.7 of the confidence, best first: vectors(id, embedding, confidence)."""
    out = vectors.select("id", F.round(cosine(F.col("embedding"), query) * 0.3 + F.col("confidence") * 0.7, 6).alias("score"))
    out = out.orderBy(F.desc("score"), "id")
    return out.limit(k) if k else out


def suggestion_class(path: Column, functions: Column, classes: Column, is_route: Column, is_api: Column, is_component: Column, warnings: Column) -> tuple[Column, Column]:
    """(confidence, rationale) of a file as an edit target; of the rules that apply the last one holds. Counts are numbers."""
    n = lambda c: c.cast("string")
    low = F.lower(path)
    # The rules in order, the later over the earlier.
    rules = [
        ((functions > 0) & (classes > 0), "High", F.concat(F.lit("Contains "), n(functions), F.lit(" functions and "), n(classes), F.lit(" classes - high edit potential"))),
        ((functions > 0) & (classes == 0), "Med", F.concat(F.lit("Contains "), n(functions), F.lit(" functions - moderate edit potential"))),
        ((functions == 0) & (classes > 0), "Med", F.concat(F.lit("Contains "), n(classes), F.lit(" classes - moderate edit potential"))),
        (is_component & ~(is_route | is_api), "Med", F.lit("React component - UI modification target")),
        (is_route | is_api, "High", F.lit("Route/API file - critical for functionality")),
        (F.contains(low, F.lit("/styles/")) | low.endswith(".css"), "Med", F.lit("print/layout might clip slides")),
        (F.contains(low, F.lit("templates")), "High", F.lit("renderer entry point")),
        (F.contains(low, F.lit("compile")), "High", F.lit("orchestrator")),
        (warnings > 0, "High", F.concat(F.lit("Has "), n(warnings), F.lit(" warnings - likely needs attention")))]
    confidence, rationale = F.lit("Low"), F.lit("General file for potential edits")
    for holds, sure, why in rules:
        confidence, rationale = F.when(holds, sure).otherwise(confidence), F.when(holds, why).otherwise(rationale)
    return confidence, rationale


def suggestions(rows: DataFrame, order: list[str], top: int = 20) -> DataFrame:
    """The first ``top`` suggestions (a report) by confidence, stable by ``order``: rows with confidence and rationale."""
    by = F.when(F.col("confidence") == "High", 0).when(F.col("confidence") == "Med", 1).otherwise(2)
    return rows.orderBy(by, *order).limit(top)


# Parts of a path, with words that speak for a summary of such a file (40) and, for the first, against it (-50); in order.
TOPICS = [
    ("domains", ["domain", "domains", "registration", "search", "add"], ["demo", "component", "navigation", "icon", "svg"]), ("monitor", ["monitor", "monitoring", "status", "health", "uptime"], []),
    ("utils", ["utility", "util", "helper", "tool", "pg-api"], []), ("services", ["service", "business", "logic", "api", "database"], []), ("components", ["component", "ui", "interface", "display"], [])]
NAME_IN_TITLE, STEM_IN_TITLE, NAME_IN_TEXT, LEAST = 100, 80, 60, 80


def best_summaries(files: DataFrame, summaries: DataFrame) -> DataFrame:
    """The summary that fits each file best, if its score is at least LEAST: files(path), summaries(id, title, purpose, detail) -> (path, id, score).

    No score reaches LEAST without the file's stem in the title, or its whole name in the text and the topic's words; so
    candidates come from equal words (the stem or name as a word of title or text) and by containment within words
    through all endings of each word, never from all pairs. Ties go to the least id.
    """
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    f = files.select("path", name.alias("_name"), F.substring_index(name, ".", 1).alias("_stem")).distinct()
    s = summaries.where("title <> '' and purpose <> ''").select("id", F.lower("title").alias("_t"), F.lower(F.concat("purpose", F.coalesce("detail", F.lit("")))).alias("_x"))
    # every part of a title or text that a stem could be: runs of signs of names, cut at each place where one may begin
    grams = lambda c: F.regexp_extract_all(c, F.lit(r"[a-z0-9_.$@\[\]()+-]+"), F.lit(0))
    ends = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(w, i, F.length(w)))
    words = s.select("id", F.explode(F.array_distinct(F.concat(grams(F.col("_t")), grams(F.col("_x"))))).alias("_w"))
    tails = words.select("id", F.explode(ends(F.col("_w"))).alias("_w")).distinct()
    least = 3
    keyed = tails.where(F.length("_w") >= least).select("id", F.substring("_w", 1, least).alias("_k"), "_w")
    long_ = f.where(F.length("_stem") >= least).withColumn("_k", F.substring("_stem", 1, least))
    near = long_.join(keyed, "_k").where(F.startswith("_w", "_stem")).select("path", "_name", "_stem", "id").distinct()
    heads = tails.select("id", F.explode(F.array(*[F.substring("_w", 1, n) for n in range(1, least)])).alias("_stem")).distinct()
    short = f.where((F.length("_stem") < least) & (F.length("_stem") > 0)).join(heads, "_stem").select("path", "_name", "_stem", "id").distinct()
    pairs = near.unionByName(short).join(s, "id")
    has = lambda c, w: F.contains(c, w if isinstance(w, Column) else F.lit(w))
    any_word = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.concat("_t", "_x"), w)) if words else F.lit(False)
    topic = F.lit(0)
    for part, good, bad in reversed(TOPICS):
        topic = F.when(has(F.lower("path"), part), F.when(any_word(good), 40).when(any_word(bad), -50).otherwise(0)).otherwise(topic)
    score = F.when(has(F.col("_t"), F.col("_name")), NAME_IN_TITLE).otherwise(0) + F.when(has(F.col("_t"), F.col("_stem")), STEM_IN_TITLE).otherwise(0) + F.when(has(F.col("_x"), F.col("_name")), NAME_IN_TEXT).otherwise(0) + topic
    scored = pairs.select("path", "id", score.alias("score")).where(F.col("score") >= LEAST)
    return scored.groupBy("path").agg(F.min_by(F.struct("id", "score"), F.struct(-F.col("score"), "id")).alias("_b")).select("path", "_b.*")


def sparse_fallback(rows: DataFrame, synthesized: DataFrame, least: int = 3, first: int = 6) -> DataFrame:
    """The rows, or where they are fewer than ``least`` the first ``first`` of the synthesized ones (ord, *columns of rows)."""
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    few = synthesized.orderBy("ord").limit(first).select(*rows.columns)
    kept = rows.join(F.broadcast(n.where(F.col("_n") >= least)))  # one row or none
    return kept.drop("_n").unionByName(few.join(F.broadcast(n.where(F.col("_n") < least))).drop("_n"))


def glossary(terms: DataFrame, top: int = 50) -> DataFrame:
    """The first ``top`` distinct terms of each snapshot (a report): terms(snapshot_id, term) -> (snapshot_id, term, rank)."""
    w = Window.partitionBy("snapshot_id").orderBy("term")
    return terms.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def generic_lines(lines: DataFrame, allowed: DataFrame) -> DataFrame:
    """Lines without filler words that mention an allowed path: lines(id, line), allowed(path)."""
    kept = lines.where(~F.col("line").rlike(r"(?i)\b(various|several|appropriate|etc|some files)\b"))
    word = F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"[\w./-]+/[\w./-]*\w"), F.lit(0))))
    mentions = kept.select("id", word.alias("path")).join(allowed.select("path").distinct(), "path", "left_semi").select("id").distinct()
    return kept.join(mentions, "id", "left_semi")

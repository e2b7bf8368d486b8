"""Mixing sources to target weights (problem 8).

The budget of a mix is a share of the tokens of all documents. Its targets become the weights of the leaves of a tree
domain - language - source, a source's weight being split over languages by their tokens. A leaf can supply its tokens
times the cap on repeats; what it lacks is handed to its siblings (other sources of the same domain and language), then
to the rest of the domain, then to the rest of the mix, each time by weight among those with room. Each leaf is then
read in seeded epochs: whole epochs, and of the last one the prefix of a seeded order that fits the rest.

The prefix is found without sorting a leaf in one task: tokens are summed by slice of the order first, and only the
slice in which the budget ends is ordered. A leaf of n documents has as many slices as the root of n, so neither the
slices nor the documents of one are many.

Defined results: sources are compared trimmed, in lower case and with '-' as '_', languages without region and '' as
'und'; documents without tokens take no part; a target without documents reports a share of 0; weights that do not sum
to 1 are scaled; an empty table gives shares of 0; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.tokenizing import FOLDER, share_vocabulary, token_count
from quarryline.session import checkpointed

#: Domains of sources, a parameter of the tree; a source that is not listed is a domain of its own.
DOMAINS = {
    "reference": ["file_blurb", "docstring", "readme", "route_doc", "capability_summary"],
    "discussion": ["issue_report", "review_comment", "qa_answer"],
    "operations": ["commit_message", "release_note", "runbook", "incident_log"],
}
#: Languages that are leaves of the tree, a parameter; anything else is 'und'.
KNOWN_LANGS = ["en", "de", "fr", "es", "ru", "el", "ja"]

LEAF = "mix_id int, domain string, lang string, source string, tokens bigint, documents bigint, weight double, target_share double, max_repeats int, budget double"


def source_name(source: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(source)), "[- ]", "_")


def lang_name(lang: Column, known: list[str] = KNOWN_LANGS) -> Column:
    short = F.lower(F.regexp_extract(F.trim(lang), "^[A-Za-z]+", 0))
    return F.when(short.isin(*known), short).otherwise("und")


def domain_name(source: Column, domains: dict[str, list[str]] = DOMAINS) -> Column:
    out = source
    for name, members in domains.items():
        out = F.when(source.isin(*members), name).otherwise(out)
    return out


def sized(documents: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER, langs: list[str] = KNOWN_LANGS) -> DataFrame:
    """(doc_id, lang, source, tokens) of every document."""
    share_vocabulary(documents.sparkSession, vocabulary, folder)
    return documents.select(
        "doc_id", lang_name(F.col("lang"), langs).alias("lang"), source_name(F.col("source")).alias("source"),
        token_count(F.col("text"), vocabulary, folder).alias("tokens"))


def spread(leaves: pd.DataFrame, total: float) -> pd.Series:
    """Tokens granted to each leaf. Columns domain, lang, weight, capacity; shortages go to siblings before ancestors."""
    weight = leaves.weight / (leaves.weight.sum() or 1)
    give = weight * total
    room = leaves.capacity.astype(float)
    groups = [["domain", "lang"], ["domain"], []]
    for level in groups:
        parts = [leaves.index] if not level else [g.index for _, g in leaves.groupby(level, dropna=False)]
        for part in parts:
            while True:  # each round fills a leaf or ends, so there are at most as many rounds as leaves
                short = (give[part] - room[part]).clip(lower=0)
                lack = short.sum()
                open_ = part[(room[part] - give[part] > 1e-9).to_numpy() & (weight[part] > 0).to_numpy()]
                give[part] = give[part] - short
                if lack <= 1e-9 or not len(open_):
                    break
                give[open_] += lack * weight[open_] / weight[open_].sum()
                if not ((give[part] - room[part]) > 1e-9).any():
                    break
            if level and lack > 1e-9 and not len(open_):
                # what no sibling could take stays with the leaves and is handed on at the next level
                give[part] = give[part] + lack * (weight[part] / weight[part].sum() if weight[part].sum() else 1 / len(part))
    return give.clip(upper=room)


def _budgets(leaves: pd.DataFrame) -> pd.DataFrame:
    leaves = leaves.sort_values(["domain", "lang", "source"], kind="stable").reset_index(drop=True)
    leaves["capacity"] = leaves.tokens * leaves.max_repeats.clip(lower=0)
    leaves["granted"] = spread(leaves, float(leaves.budget.iloc[0]))
    return leaves[["mix_id", "domain", "lang", "source", "tokens", "documents", "target_share", "max_repeats", "budget", "granted"]]


GRANTED = "mix_id int, domain string, lang string, source string, tokens bigint, documents bigint, target_share double, max_repeats int, budget double, granted double"


def leaf_budgets(docs: DataFrame, targets: DataFrame, domains: dict[str, list[str]] = DOMAINS) -> DataFrame:
    """Granted tokens of each (mix, leaf). A mix has as many leaves as targets times known languages, whatever the input."""
    held = docs.where("tokens > 0 and source is not null").groupBy("source", "lang").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    everything = docs.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("_all"))
    t = targets.select("mix_id", source_name(F.col("source")).alias("source"), "target_share", "max_repeats", "mix_size_ratio")
    t = t.groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"), F.max("mix_size_ratio").alias("mix_size_ratio"))
    of_source = Window.partitionBy("mix_id", "source")
    leaves = t.join(held, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("documents", F.coalesce("documents", F.lit(0))).withColumn("lang", F.coalesce("lang", F.lit("und")))
    share = F.coalesce(F.try_divide("tokens", F.sum("tokens").over(of_source)), F.lit(1.0))
    leaves = leaves.crossJoin(F.broadcast(everything)).select(  # one row
        "mix_id", domain_name(F.col("source"), domains).alias("domain"), "lang", "source", "tokens", "documents", (F.col("target_share") * share).alias("weight"),
        "target_share", "max_repeats", (F.col("mix_size_ratio") * F.col("_all")).alias("budget"))
    return leaves.groupBy("mix_id").applyInPandas(_budgets, GRANTED)


def mix(docs: DataFrame, targets: DataFrame, seed: int = 7, domains: dict[str, list[str]] = DOMAINS) -> DataFrame:
    """The mixes: (mix_id, doc_id, source, lang, tokens, repeats). ``docs`` as from sized().

    Documents are joined with rows per leaf only, which are broadcast: their number is that of targets times languages.
    """
    grants = checkpointed(leaf_budgets(docs, targets, domains)).where("granted > 0 and tokens > 0").select(
        "mix_id", "source", "lang", F.least(F.floor(F.col("granted") / F.col("tokens") + 1e-9), F.col("max_repeats")).cast("int").alias("whole"),
        F.ceil(F.sqrt("documents")).cast("long").alias("_slices"), "granted", F.col("tokens").alias("_held"), "max_repeats",
    ).withColumn("rest", F.when(F.col("whole") < F.col("max_repeats"), F.col("granted") - F.col("whole") * F.col("_held")).otherwise(0.0))
    used = docs.where("tokens > 0 and source is not null")
    leaf = ["mix_id", "source", "lang"]

    def sliced(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_order", F.xxhash64("doc_id", "mix_id", "whole", F.lit(seed)))
        return rows.withColumn("_slice", F.pmod(F.shiftrightunsigned("_order", 20), F.col("_slices")))

    slices = sliced(used.join(F.broadcast(grants), ["source", "lang"])).groupBy(*leaf, "_slice").agg(F.sum("tokens").alias("_t"), F.first("rest").alias("rest"))
    run = Window.partitionBy(*leaf).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("_t").over(run), F.lit(0)))
    # the slice in which the rest of the budget ends; those before it are taken, those after it are not
    edges = slices.where((F.col("_before") <= F.col("rest")) & (F.col("_before") + F.col("_t") > F.col("rest"))).groupBy(*leaf).agg(F.min_by(F.struct("_slice", "_before"), "_slice").alias("_e"))
    told = checkpointed(grants.join(edges, leaf, "left").select(*leaf, "whole", "_slices", "rest", F.col("_e._slice").alias("_edge"), F.col("_e._before").alias("_before")))
    rows = sliced(used.join(F.broadcast(told), ["source", "lang"]))
    at_edge = Window.partitionBy(*leaf, "_slice").orderBy("_order", "doc_id")
    on_edge = F.coalesce(F.col("_slice") == F.col("_edge"), F.lit(False))
    edge = rows.where(on_edge).withColumn("_in", F.col("_before") + F.sum("tokens").over(at_edge) <= F.col("rest"))
    # without an edge the rest holds the whole leaf
    other = rows.where(~on_edge).withColumn("_in", F.coalesce(F.col("_slice") < F.col("_edge"), F.lit(True)))
    repeats = F.col("whole") + F.col("_in").cast("int")
    return other.unionByName(edge).select(*leaf, "doc_id", "tokens", repeats.alias("repeats")).where("repeats > 0").select("mix_id", "doc_id", "source", "lang", "tokens", "repeats")


def actual_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Report: (mix_id, source, target_share, actual_share, tokens, documents, most_repeats) for every target."""
    got = mixed.groupBy("mix_id", "source").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    t = targets.groupBy("mix_id", source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"))
    rows = t.join(got, ["mix_id", "source"], "left").na.fill(0, ["tokens", "documents", "most_repeats"])
    whole = F.sum("tokens").over(Window.partitionBy("mix_id"))
    share = F.coalesce(F.try_divide("tokens", whole), F.lit(0.0))
    return rows.select("mix_id", "source", "target_share", share.alias("actual_share"), "tokens", "documents", "most_repeats")

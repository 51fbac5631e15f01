"""Inverted index and ranked lexical queries over cards, for whole batches of queries."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import WEIGHTS, as_cards
from .sizes import is_small, joinable, spread
from .substring import substring_join

EXACT_ID, ID_PHRASE, ALIAS, PHRASE, EXCLUDED = 1000.0, 100.0, 500.0, 40.0, 40.0
GRAPH_SHARE, INCOMING = 0.08, 0.6
SEEDS, REASONS = 3, 6
_CJK_OR_LETTER = r"\p{L}\p{N}"


def field_texts(cards: DataFrame) -> DataFrame:
    """id, field, text of all fields of all cards."""
    join = lambda c: F.array_join(F.col(c), " ")
    texts = {
        "id": F.replace(F.col("id"), F.lit("."), F.lit(" ")), "role": F.col("role"), "search": join("search"), "owns": join("owns"),
        "excludes": join("excludes"), "invariant": join("invariant"), "effect": join("effect"), "risk": join("risk"),
        "symbol": F.col("symbol"), "path": F.col("path"), "signature": F.col("signature"),
    }
    fields = F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(c, F.lit("")).alias("text")) for n, c in texts.items()])
    return as_cards(cards).select("id", F.explode(fields).alias("f")).select("id", "f.field", "f.text")


def postings(cards: DataFrame, composed: bool = True, only: DataFrame | None = None) -> DataFrame:
    """token, id, field, tf: one row for each token of each field of each card; only those of only(token), which must be small, if given."""
    tokens = field_texts(spread(cards, "id")).select("id", "field", F.explode(T.tokenize("text", composed)).alias("token"))
    if only is not None:
        tokens = tokens.join(F.broadcast(only), "token", "left_semi")
    return tokens.groupBy("token", "id", "field").agg(F.count("*").alias("tf"))


def document_frequency(index: DataFrame) -> DataFrame:
    """token, df: documents with the token in any field, those of weight zero included."""
    return index.groupBy("token").agg(F.countDistinct("id").alias("df"))


def impacts(index: DataFrame, n_documents: DataFrame, small: bool = False) -> DataFrame:
    """token, id, df, impact: the sum of tf x weight, times ln(1 + (N + 1) / (df + 1)). n_documents has one row, n.

    small: index has few different tokens.
    """
    weight = F.create_map(*[x for f, w in WEIGHTS.items() for x in (F.lit(f), F.lit(float(w)))])
    by_card = index.groupBy("token", "id").agg(F.sum(F.col("tf") * weight[F.col("field")]).alias("weighted"))
    df = by_card.groupBy("token").agg(F.count("*").alias("df"))
    scored = by_card.join(joinable(df, small), "token").crossJoin(F.broadcast(n_documents))
    return scored.select("token", "id", "df", (F.col("weighted") * T.idf(F.col("n"), F.col("df"))).alias("impact"))


def phrases(cards: DataFrame, composed: bool = True) -> DataFrame:
    """id, phrase: normalised strings of role, search, invariant and owns; one may occur repeatedly."""
    c = as_cards(cards)
    every = F.concat(F.array(F.coalesce("role", F.lit(""))), "search", "invariant", "owns")
    each = c.select("id", F.explode(F.array_distinct(every)).alias("raw"))
    return each.select("id", T.normalize_search_text("raw", composed).alias("phrase")).where("phrase <> ''")


def alias_hits(queries: DataFrame, aliases: DataFrame, composed: bool = True) -> DataFrame:
    """query_id, alias, target: aliases(alias, target) inside queries(query_id, q).

    An alias that begins or ends with a Latin letter or digit must end there as a word; next to CJK text it may stand free.
    """
    needles = aliases.select(F.struct("alias", "target").alias("needle_id"), T.normalize_search_text("alias", composed).alias("needle"))
    pairs = substring_join(needles.where("needle <> ''"), queries.select(F.col("query_id").alias("hay_id"), F.col("q").alias("hay")))
    plain = F.regexp_replace("needle", r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    edge = "[A-Za-z0-9]"
    before = F.when(F.col("needle").rlike(f"^{edge}"), F.lit(r"(?<![\p{L}\p{N}_])")).otherwise(F.lit(""))
    after = F.when(F.col("needle").rlike(f"{edge}$"), F.lit(r"(?![\p{L}\p{N}_])")).otherwise(F.lit(""))
    cjk_free = F.when(F.col("needle").rlike(T.CJK), F.lit("")).otherwise(after)
    pattern = F.concat(F.when(F.col("needle").rlike(T.CJK), F.lit("")).otherwise(before), plain, cjk_free)
    return pairs.where(F.regexp_like("hay", pattern)).select(
        F.col("hay_id").alias("query_id"), F.col("needle_id.alias").alias("alias"), F.col("needle_id.target").alias("target")
    )


def normalized_queries(queries: DataFrame, composed: bool = True) -> DataFrame:
    return queries.select("query_id", T.normalize_search_text("query", composed).alias("q"))


def score_parts(cards: DataFrame, queries: DataFrame, aliases: DataFrame | None = None, composed: bool = True) -> DataFrame:
    """query_id, id, ord, score, reason: every contribution of ids, aliases, tokens and phrases to a card's score.

    queries(query_id, query). Tokens of a query count as often as they occur. A shorter posting list doesn't matter
    to the plan: queries meet the index in an equi-join on the token, already summed to a row for each
    token and card. Few queries (as measured) are broadcast, and only their tokens are indexed; cards never are, however
    small their files look.
    """
    cards = as_cards(cards)
    asked = normalized_queries(queries, composed)
    small = is_small(asked, "q")
    ids = cards.select("id", F.lower("id").alias("low"))
    n = cards.agg(F.countDistinct("id").alias("n"))
    exact = ids.join(joinable(asked, small), asked["q"] == ids["low"]).select(
        "query_id", "id", F.lit(0).alias("ord"), F.lit(EXACT_ID).alias("score"), F.lit("exact semantic ID").alias("reason")
    )
    inside = substring_join(
        asked.where(T.utf16_units("q") >= 3).select(F.col("query_id").alias("needle_id"), F.col("q").alias("needle")),
        ids.select(F.col("id").alias("hay_id"), F.col("low").alias("hay")),
    ).where("needle <> hay")
    inside = inside.select(
        F.col("needle_id").alias("query_id"), F.col("hay_id").alias("id"), F.lit(0).alias("ord"), F.lit(ID_PHRASE).alias("score"),
        F.lit("semantic ID phrase").alias("reason"),
    )
    tokens = asked.select("query_id", F.posexplode(T.tokenize("q", composed)).alias("pos", "token"))
    tokens = tokens.groupBy("query_id", "token").agg(F.count("*").alias("times"), F.min("pos").alias("pos"))
    index = postings(cards, composed, tokens.select("token").distinct() if small else None)
    matched = impacts(index, n, small).join(joinable(tokens, small), "token").where("impact > 0")
    by_token = matched.select(
        "query_id", "id", (F.col("pos") + 1_000_000).alias("ord"), (F.col("times") * F.col("impact")).alias("score"),
        F.concat(F.lit("token="), F.col("token")).alias("reason"),
    )
    said = substring_join(
        asked.where(T.utf16_units("q") >= 4).select(F.col("query_id").alias("needle_id"), F.col("q").alias("needle")),
        phrases(cards, composed).select(F.col("id").alias("hay_id"), F.col("phrase").alias("hay")),
    )
    said = said.select(F.col("needle_id").alias("query_id"), F.col("hay_id").alias("id")).distinct()
    said = said.select(
        "query_id", "id", F.lit(2_000_000_000).alias("ord"), F.lit(PHRASE).alias("score"), F.lit("exact phrase").alias("reason")
    )
    parts = [exact, inside, by_token, said]
    if aliases is not None:
        hits = alias_hits(asked, aliases, composed)
        hits = hits.groupBy("query_id", "target").agg(F.min("alias").alias("alias"))
        known = hits.join(ids.hint("merge"), hits["target"] == ids["id"], "left_semi")
        parts.append(
            known.select(
                "query_id", F.col("target").alias("id"), F.lit(1).alias("ord"), F.lit(ALIAS).alias("score"),
                F.concat(F.lit('alias="'), F.col("alias"), F.lit('"')).alias("reason"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def excluded_scope(cards: DataFrame, queries: DataFrame, composed: bool = True) -> DataFrame:
    """query_id, id, score, reasons for queries of the form "excludes: term"; nothing else counts for those."""
    asked = normalized_queries(queries, composed).where("q LIKE 'excludes:%'")
    asked = asked.select("query_id", T.trim_unicode(F.regexp_replace("q", "^excludes:", "")).alias("needle")).where("needle <> ''")
    each = as_cards(cards).select("id", F.explode("excludes").alias("raw"))
    hay = each.select(F.struct("id", "raw").alias("hay_id"), T.normalize_search_text("raw", composed).alias("hay"))
    pairs = substring_join(asked.select(F.col("query_id").alias("needle_id"), "needle"), hay)
    return pairs.groupBy(F.col("needle_id").alias("query_id"), F.col("hay_id.id").alias("id")).agg(
        F.lit(EXCLUDED).alias("score"), F.array(F.concat(F.lit('excludes="'), F.min("hay_id.raw"), F.lit('"'))).alias("reasons")
    )


def summed(parts: DataFrame) -> DataFrame:
    """query_id, id, score, reasons (the first six in order of their contribution).

    Contributions are added in that order too: with F.sum their order would be that of the shuffle, and cards
    with the same contributions would differ in the last bits.
    """
    each = parts.groupBy("query_id", "id").agg(F.array_sort(F.collect_list(F.struct("ord", "reason", "score"))).alias("all"))
    return each.select(
        "query_id", "id", F.aggregate("all", F.lit(0.0), lambda a, x: a + x["score"]).alias("score"),
        F.slice(F.array_distinct(F.transform("all", lambda x: x["reason"])), 1, REASONS).alias("reasons"),
    )


def relation_edges(cards: DataFrame) -> DataFrame:
    """src, dst, kind, confidence of declared relations kind>target."""
    each = as_cards(cards).select("id", F.explode("rel").alias("r")).where(F.instr("r", ">") > 1)
    at = F.instr(F.col("r"), ">")
    return each.select(
        F.col("id").alias("src"), F.expr("substring(r, instr(r, '>') + 1)").alias("dst"), F.expr("substring(r, 1, instr(r, '>') - 1)").alias("kind"),
        F.lit(1.0).alias("confidence"), at.alias("at"),
    ).drop("at")


def adjacency(edges: DataFrame) -> DataFrame:
    """node, neighbor, direction, kind, confidence: each edge once out of its source and once into its target."""
    c = T.clamp(F.coalesce(F.col("confidence"), F.lit(0.0)), 0.0, 1.0).alias("confidence")
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbor"), F.lit("out").alias("direction"), "kind", c)
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbor"), F.lit("in").alias("direction"), "kind", c)
    return out.unionByName(back)


def add_graph_bonus(scores: DataFrame, cards: DataFrame, edges: DataFrame) -> DataFrame:
    """scores with the bonus of the neighbours of each query's three best cards.

    Seeds are taken before any bonus and applied one after another, so a later seed passes on what an earlier one gave it. Only the
    seeds and their neighbours go to the fold, a few rows for each query.
    """
    order = as_cards(cards).select("id", "card_order").hint("merge")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "card_order")
    seeds = scores.where("score > 0").join(order, "id").withColumn("seed", F.row_number().over(best)).where(F.col("seed") <= SEEDS)
    near = seeds.select("query_id", "seed", F.col("id").alias("node")).join(adjacency(edges).hint("merge"), "node")
    near = near.join(order.select(F.col("id").alias("neighbor")).hint("merge"), "neighbor", "left_semi")
    steps = near.groupBy("query_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct("seed", F.col("confidence") * -1, "kind", "neighbor", "direction", "node", "confidence")
            )
        ).alias("steps")
    )
    starts = seeds.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "score"))).alias("starts"))
    folded = starts.join(steps.hint("merge"), "query_id")

    @F.pandas_udf("array<struct<id:string,score:double,ord:int,reason:string>>")
    def fold(starts: pd.Series, steps: pd.Series) -> pd.Series:
        def one(start, rows) -> list[dict]:
            held, out = dict(start), []
            for ord_, r in enumerate(rows):
                bonus = held[r["node"]] * GRAPH_SHARE * r["confidence"] * (1 if r["direction"] == "out" else INCOMING)
                if r["neighbor"] in held:
                    held[r["neighbor"]] += bonus
                reason = f"graph-{r['direction']}:{r['kind']}@{r['confidence']:.2f}"
                out.append({"id": r["neighbor"], "score": bonus, "ord": ord_, "reason": reason})
            return out

        return pd.Series([one(s, r) for s, r in zip(starts, steps, strict=True)])

    bonus = folded.select("query_id", F.explode(fold("starts", "steps")).alias("b")).select("query_id", "b.*")
    base = scores.select("query_id", "id", "score", F.lit(-1).alias("ord"), "reasons")
    more = bonus.select("query_id", "id", "score", "ord", F.array("reason").alias("reasons"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "reasons", "score")))
    return (
        base.unionByName(more)
        .groupBy("query_id", "id")
        .agg(ordered.alias("all"))
        .select(
            "query_id",
            "id",
            F.aggregate("all", F.lit(0.0), lambda a, x: a + x["score"]).alias("score"),
            F.slice(F.array_distinct(F.flatten(F.transform("all", lambda x: x["reasons"]))), 1, REASONS).alias("reasons"),
        )
    )


def ranked(scores: DataFrame, top: int = 5, digits: int | None = None) -> DataFrame:
    """query_id, rank, id, score (three decimals), reasons: the top cards of each query, by score, then id.

    Scores are compared unrounded, or with so many digits after the point.
    """
    by = F.col("score") if digits is None else F.round("score", digits)
    best = Window.partitionBy("query_id").orderBy(by.desc(), "id")
    out = scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(1, min(100, top)))
    return out.select("query_id", "rank", "id", F.round("score", 3).alias("score"), "reasons")


def query_cards(
    cards: DataFrame, queries: DataFrame, aliases: DataFrame | None = None, edges: DataFrame | None = None, top: int = 5, composed: bool = True,
    digits: int | None = None,
) -> DataFrame:
    """Ranked answers to queries(query_id, query); edges default to the relations that cards declare, digits are those of ranked()."""
    plain = queries.where(~F.lower(F.coalesce("query", F.lit(""))).rlike("^\\s*excludes:"))
    scores = summed(score_parts(cards, plain, aliases, composed))
    scores = add_graph_bonus(scores, cards, relation_edges(cards) if edges is None else edges)
    return ranked(scores.unionByName(excluded_scope(cards, queries, composed)), top, digits)


def maintain_postings(old: DataFrame, old_hashes: DataFrame, cards: DataFrame, composed: bool = True) -> tuple[DataFrame, DataFrame]:
    """Postings and hashes (id, hash) after a change of cards: only new and changed cards are read again."""
    hashes = document_hashes(cards)
    same = hashes.join(old_hashes, ["id", "hash"], "left_semi").select("id")
    fresh = postings(cards.join(same, "id", "left_anti"), composed)
    return old.join(same, "id", "left_semi").select(fresh.columns).unionByName(fresh), hashes


def document_hashes(cards: DataFrame) -> DataFrame:
    """id, hash of all indexed fields of a card."""
    rows = field_texts(cards).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("field", "text"))).alias("f"))
    return rows.select("id", F.sha2(F.to_json("f"), 256).alias("hash"))


def set_hash(hashes: DataFrame) -> DataFrame:
    """hash: one digest of sorted lines id:hash."""
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "id", "hash")))
    return hashes.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("hash"))


def index_violations(index: DataFrame, hashes: DataFrame, cards: DataFrame) -> DataFrame:
    """check, n: what an intact index has none of."""
    now = document_hashes(cards)
    checks: dict[str, DataFrame] = {
        "empty token": index.where("token IS NULL OR token = ''"),
        "count below one": index.where("tf < 1"),
        "unknown field": index.where(~F.col("field").isin(*WEIGHTS)),
        "repeated posting": index.groupBy("token", "id", "field").count().where("count > 1"),
        "unknown card": index.join(now, "id", "left_anti"),
        "changed card": now.join(hashes, ["id", "hash"], "left_anti"),
        "removed card": hashes.join(now, "id", "left_anti"),
    }
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, parts)


def discover(files: DataFrame, declarations: DataFrame, queries: DataFrame, top: int = 10) -> DataFrame:
    """query_id, rank, path, line, source, symbol, score, matched: files(path) and declarations(path, line, symbol, signature).

    Each distinct token of a query counts where it first matches: symbol 8, else path 3, else signature 2; a symbol equal to the
    query counts 40 more.
    """
    every = files.select("path", F.lit(0).alias("line"), F.lit("file").alias("source"), F.lit("").alias("symbol"), F.lit("").alias("signature"))
    every = every.unionByName(declarations.select("path", F.col("line").cast("int").alias("line"), F.lit("declaration").alias("source"), "symbol", "signature"))
    c = every.select("*", T.source_tokens("symbol").alias("s"), T.source_tokens("path").alias("p"), T.source_tokens("signature").alias("g"))
    q = queries.select("query_id", T.normalize_search_text("query").alias("q"), T.source_tokens("query").alias("t"))
    pool = c.select("path", "line", "source", "symbol", F.explode(F.array_distinct(F.concat("s", "p", "g"))).alias("token"), "s", "p", "g")
    worth = F.when(F.array_contains("s", F.col("token")), 8).when(F.array_contains("p", F.col("token")), 3).otherwise(2)
    points = pool.select("path", "line", "source", "symbol", "token", worth.cast("double").alias("score"))
    hits = q.select("query_id", F.explode("t").alias("token")).join(points, "token").drop("token")
    whole = q.join(c.where("symbol <> ''").withColumn("low", T.normalize_search_text("symbol")), F.col("q") == F.col("low"))
    hits = hits.unionByName(whole.select("query_id", "path", "line", "source", "symbol", F.lit(40.0).alias("score")))
    scores = hits.groupBy("query_id", "path", "line", "source", "symbol").agg(F.sum("score").alias("score"))
    w = Window.partitionBy("query_id")
    best = w.orderBy(F.desc("score"), "path", "line", "source", "symbol")
    out = scores.select("*", F.row_number().over(best).alias("rank"), F.count("*").over(w).alias("matched"))
    return out.where(F.col("rank") <= top).select("query_id", "rank", "path", "line", "source", "symbol", "score", "matched")


def first_ranks(results: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id, rank: place of the first expected id in results(query_id, rank, id); null if missing."""
    hits = expected.join(results.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg(F.min("rank").alias("rank"))


def retrieval_metrics(results: DataFrame, expected: DataFrame, negatives: DataFrame | None = None) -> DataFrame:
    """cases, recall_at_1, recall_at_5, mrr, negatives, negatives_passed over all cases."""
    ranks = first_ranks(results, expected)
    share: Column = F.avg(F.when(F.col("rank") <= 1, 1.0).otherwise(0.0))
    out = ranks.agg(
        F.count("*").alias("cases"),
        F.coalesce(share, F.lit(0.0)).alias("recall_at_1"),
        F.coalesce(F.avg(F.when(F.col("rank") <= 5, 1.0).otherwise(0.0)), F.lit(0.0)).alias("recall_at_5"),
        F.coalesce(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr"),
    )
    if negatives is None:
        return out.select("*", F.lit(0).cast("long").alias("negatives"), F.lit(0).cast("long").alias("negatives_passed"))
    found = negatives.join(results.select("query_id").distinct().withColumn("found", F.lit(True)), "query_id", "left")
    return out.crossJoin(
        found.agg(F.count("*").alias("negatives"), F.count_if(F.col("found").isNull()).alias("negatives_passed"))
    )


def gate_status(metrics: DataFrame, minimum_cases: int = 1, recall_at_1: float = 0.75, recall_at_5: float = 0.9) -> DataFrame:
    """metrics with status: unmeasured, insufficient, failed or passed."""
    status = (
        F.when(F.col("cases") + F.col("negatives") == 0, "unmeasured")
        .when(F.col("cases") < minimum_cases, "insufficient")
        .when((F.col("recall_at_1") < recall_at_1) | (F.col("recall_at_5") < recall_at_5) | (F.col("negatives_passed") < F.col("negatives")), "failed")
        .otherwise("passed")
    )
    return metrics.withColumn("status", status)


def ordered_hash(hashes: DataFrame) -> DataFrame:
    """hash: one digest of the lines id:hash of hashes(id, hash, card_order), in the order of the cards."""
    lines = F.array_sort(F.collect_list(F.struct("card_order", F.concat_ws(":", "id", "hash").alias("line"))))
    return hashes.agg(F.sha2(F.array_join(F.transform(lines, lambda r: r["line"]), "\n"), 256).alias("hash"))

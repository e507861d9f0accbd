"""Hybrid search: three legs, reciprocal rank fusion, rerank blend and neighbour context.

Every leg starts from the same filtered chunks and carries ids and scores only; contents are joined
for the few that are left. Each leg's top-k is a sort with limit, of which a task sends k rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fulltext, trigram
from ..functions.scalars import once, result_line
from ..functions.vectors import cosine
from ..store import cut
from .filters import filtered

K, WEIGHTS = 60, (0.5, 0.3, 0.2)
DEFAULT_LIMIT, MOST = 10, 50
#: Columns of what ingest stores for the text and trigram legs.
LEXEMES, TRIGRAMS = "lexemes", "trigrams"
#: What a result has of its chunk.
PAYLOAD = ("chunk_id", "content", "metadata", "chunk_index", "data_source_id", "collection_id", "source_url")


def indexed(chunks: DataFrame, text: str = "content") -> DataFrame:
    """chunks with what search() finds stored, to be written at ingest: lexemes with positions, and distinct trigrams."""
    return chunks.withColumns({LEXEMES: fulltext.analyzed(F.col(text)), TRIGRAMS: trigram.listed(F.col(text))})


def _stored(chunks: DataFrame, column: str) -> str | None:
    return column if column in chunks.columns else None


def ranked(leg: DataFrame, score: str, k: int, at: int, key: str = "chunk_id") -> DataFrame:
    """(chunk_id, leg, rank) of the k best of a score without nulls; the window sees k rows at most."""
    best = leg.select(key, score).orderBy(F.desc(score), key).limit(k)
    return best.select(key, F.lit(at).alias("leg"), F.row_number().over(W.orderBy(F.desc(score), key)).alias("rank"))


def vector_leg(chunks: DataFrame, query: list[float], k: int) -> DataFrame:
    q = F.array(*(F.lit(float(x)) for x in query))
    return ranked(once(chunks.select("chunk_id", "embedding"), "score", cosine(F.col("embedding"), q)).where("score is not null"), "score", k, 0)


def text_leg(chunks: DataFrame, terms: fulltext.Terms, k: int, lexemes: str | None = None) -> DataFrame:
    """Over the stored lexemes column if there is one, else over the content, of which only texts that may match are analysed."""
    if lexemes:
        x = chunks.select("chunk_id", F.col(lexemes).alias("lex"))
    else:
        x = once(chunks.where(fulltext.maybe(F.col("content"), terms)).select("chunk_id", "content"), "lex", fulltext.analyzed(F.col("content"))).drop("content")
    return ranked(x.where(fulltext.matches(F.col("lex"), terms)).select("chunk_id", fulltext.rank(F.col("lex"), terms).alias("score")), "score", k, 1)


def trigram_leg(chunks: DataFrame, query: str, k: int, threshold: float = trigram.THRESHOLD, stored: str | None = None) -> DataFrame:
    """Over the stored trigrams for a first choice if there are any; the best stretch is always looked for in the content."""
    x = chunks.select("chunk_id", "content", *([stored] if stored else []))
    return ranked(trigram.trigram_matches(x, query, "content", threshold, stored).select("chunk_id", "word_similarity"), "word_similarity", k, 2)


def fused(legs: list[DataFrame], weights: tuple[float, ...] = WEIGHTS, key: str = "chunk_id") -> DataFrame:
    """(chunk_id, rrf, first_leg, first_rank): the sum of weight / (60 + rank) over the lists that have a chunk.

    The terms are added in the order of the lists, so the result doesn't depend on how rows arrive.
    Lists without a weight count 1/n. Equal scores keep the order in which lists and ranks first name them.
    """
    n = len(legs)
    all_rows = legs[0]
    for x in legs[1:]:
        all_rows = all_rows.unionByName(x)
    g = all_rows.groupBy(key).agg(*(F.max(F.when(F.col("leg") == i, F.col("rank"))).alias(f"r{i}") for i in range(n)), F.min(F.struct("leg", "rank")).alias("first"))
    score = F.lit(0.0)
    for i in range(n):
        w = weights[i] if i < len(weights) else 1.0 / n
        score = score + F.coalesce(F.lit(w) * (F.lit(1.0) / (F.lit(K) + F.col(f"r{i}"))), F.lit(0.0))
    return g.select(key, score.alias("rrf"), F.col("first.leg").alias("first_leg"), F.col("first.rank").alias("first_rank"))


def overlap_score(query: str) -> Callable[[Column], Column]:
    """Stand-in for a rerank model: the share of the query's words that a text has."""
    words = sorted(set(trigram._words(query)))
    named = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")

    def score(content: Column) -> Column:
        own = F.array_distinct(F.regexp_extract_all(F.lower(content), F.lit(fulltext.TOKEN), F.lit(0)))
        return F.size(F.array_intersect(own, named)) / F.lit(float(max(1, len(words))))

    return score


def reranked(results: DataFrame, semantic: str = "semantic", key: str = "chunk_id") -> DataFrame:
    """results with score: half semantic, 0.3 rrf, 0.2 for the place before; semantic scores are held to 0..1.

    With one result or none, or if fewer than half of them have a semantic score, the order stays and
    score is the rrf; a missing semantic score otherwise counts 0.
    """
    order = W.orderBy(F.desc("rrf"), "first_leg", "first_rank", key)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    x = results.withColumns({"place": F.row_number().over(order) - 1, "total": F.count(F.lit(1)).over(every), "scored": F.count(semantic).over(every)})
    held = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col(semantic), F.lit(0.0))))
    blend = F.lit(0.5) * held + F.lit(0.3) * F.col("rrf") + F.lit(0.2) * (F.lit(1.0) - F.col("place") / F.col("total"))
    use = (F.col("total") > 1) & (F.col("scored") * 2 >= F.col("total"))
    return x.withColumn("score", F.when(use, blend).otherwise(F.col("rrf"))).drop("total", "scored")


def with_context(results: DataFrame, chunks: DataFrame, key: str = "chunk_id", preview: int = 500, few: bool = False) -> DataFrame:
    """results with the beginnings of the chunks just before and after in the same source.

    Only neighbours at exactly one place apart count. The wanted places are joined, not the chunks
    sorted; of several chunks at one place the one with the largest id counts. few says that results are known to be
    few, as a search's are, so that their places may be sent to all tasks.
    """
    wanted = results.select(key, "data_source_id", F.explode(F.array(*(F.struct((F.col("chunk_index") + d).alias("chunk_index"), F.lit(d).alias("side")) for d in (-1, 1)))).alias("x")).select(key, "data_source_id", "x.*")
    places = wanted.select("data_source_id", "chunk_index").distinct()
    at = chunks.join(F.broadcast(places) if few else places, ["data_source_id", "chunk_index"], "left_semi")
    beside = at.groupBy("data_source_id", "chunk_index").agg(F.max_by(F.substring("content", 1, preview), key).alias("beside"))
    sides = wanted.join(beside, ["data_source_id", "chunk_index"]).groupBy(key).agg(F.max(F.when(F.col("side") == -1, F.col("beside"))).alias("context_before"), F.max(F.when(F.col("side") == 1, F.col("beside"))).alias("context_after"))
    return results.join(sides, key, "left")


@dataclass
class Request:
    """A search. vector is the embedding of the query (and of a made-up passage, if one was added to it)."""

    org_id: object
    query: str
    vector: list[float]
    collections: tuple = ()
    filters: tuple = ()
    limit: int = DEFAULT_LIMIT
    rerank: bool = False
    expand_context: bool = False
    terms: fulltext.Terms | None = None

    def __post_init__(self):
        if not self.query.strip():
            raise ValueError("the query is empty")
        if not 1 <= self.limit <= MOST:
            raise ValueError(f"limit must lie between 1 and {MOST}")

    def fetched(self) -> int:
        """Rows that each leg fetches."""
        return self.limit * (3 if self.rerank else 2)

    def wanted(self) -> fulltext.Terms:
        return self.terms or fulltext.Terms(all=tuple(trigram._words(self.query)))


def expanded_query(query: str, passage: str | None) -> str:
    """What the vector leg embeds: the query and the first 500 characters of a made-up answer to it."""
    return f"{query}\n\n{passage[:500]}" if passage else query


def expanded_queries(query: Column, passage: Column) -> Column:
    """expanded_query() for a table of queries and their passages."""
    return F.when(F.length(passage) > 0, F.concat(query, F.lit("\n\n"), F.substring(passage, 1, 500))).otherwise(query)


def search(chunks: DataFrame, sources: DataFrame, request: Request, scorer=None) -> DataFrame:
    """Results in order, with name and link of their source.

    chunks: chunk_id, org_id, content, chunk_index, metadata, embedding, data_source_id, collection_id,
    source_url, and what indexed() adds if it is stored. sources: id, title. Legs fetch twice the limit, three times
    with rerank, which sees all that the legs found before the cut to the limit. The best rows are written once, before
    their neighbours are looked up.
    """
    base = filtered(chunks, request.org_id, list(request.collections), list(request.filters))
    k = request.fetched()
    legs = [vector_leg(base, request.vector, k), text_leg(base, request.wanted(), k, _stored(chunks, LEXEMES)), trigram_leg(base, request.query, k, stored=_stored(chunks, TRIGRAMS))]
    own = chunks.where(F.col("org_id") == F.lit(request.org_id))
    return assembled(fused(legs), own.select(*PAYLOAD), sources, request, scorer, lambda top: own)


def assembled(found: DataFrame, payload: DataFrame, sources: DataFrame, request: Request, scorer, around: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results of fused legs: contents joined, reranked if asked for, cut to the limit, named and with their neighbours.

    payload has the chunks that were found, and may have others; around(results) those beside them.
    """
    rows = payload.join(F.broadcast(found), "chunk_id")  # 9 * limit rows at most
    if request.rerank:
        scorer = scorer or overlap_score(request.query)
        rows = reranked(rows.withColumn("semantic", scorer(F.substring("content", 1, 4000)))).drop("semantic", "place")
    else:
        rows = rows.withColumn("score", F.col("rrf"))
    order = [F.desc("score"), "first_leg", "first_rank", "chunk_id"]
    top = rows.orderBy(*order).limit(request.limit)
    names = sources.select(F.col("id").alias("data_source_id"), F.col("title").alias("data_source_name"))
    top = top.join(names, "data_source_id")
    if request.expand_context:
        top = cut(top, "top")
        top = with_context(top, around(top), few=True)
    return top.orderBy(*order).drop("rrf", "first_leg", "first_rank")


# names of the response's fields (fixed values)
RESPONSE = {
    "chunk_id": "chunkId", "content": "content", "score": "score", "metadata": "metadata", "data_source_name": "dataSourceName", "data_source_id": "dataSourceId",
    "source_url": "sourceUrl", "collection_id": "collectionId", "context_before": "contextBefore", "context_after": "contextAfter",
}


def response(results: DataFrame) -> DataFrame:
    """Results as a client gets them: the public fields under their names there, in their order; what isn't there is left out."""
    return results.select(*(F.col(c).alias(n) for c, n in RESPONSE.items() if c in results.columns))


def tool_request(org_id, query: str, vector: list[float], top: int = 5, types: tuple = (), author: str | None = None, collections: tuple = ()) -> Request:
    """The search that an agent's tool call stands for: one type is an equality, several are a list; reranked, with context."""
    chosen = [{"field": "type", "operator": "eq", "value": types[0]}] if len(types) == 1 else [{"field": "type", "operator": "in", "value": list(types)}] if types else []
    if author:
        chosen.append({"field": "slackAuthors", "operator": "eq", "value": author})
    return Request(org_id, query, vector, collections, tuple(chosen), top, rerank=True, expand_context=True)


# what an agent is told when nothing was found (fixed value)
NOTHING_FOUND = "No results found. Consider searching with different terms or breaking the query into sub-queries."


def tool_answer(results: DataFrame) -> DataFrame:
    """One row (results, total_results, suggestion) of a search's rows in order, as its tool returns them."""
    shown = response(results.coalesce(1)).select(F.struct(F.monotonically_increasing_id().alias("at"), F.struct("*").alias("r")).alias("x"))
    g = shown.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias("results"))
    return g.select("results", F.size("results").alias("total_results"), F.when(F.size("results") == 0, NOTHING_FOUND).alias("suggestion"))


def tool_sources(results: DataFrame) -> DataFrame:
    """Of tool outputs (tool, result as JSON, seq), the sources of searches that are complete, in order."""
    schema = "array<struct<chunkId string, content string, score double, dataSourceId string, dataSourceName string>>"
    rest = [c for c in results.columns if c not in ("tool", "result")]
    parsed = results.where(F.col("tool") == "rag-search").select(*rest, F.posexplode(F.from_json(F.get_json_object("result", "$.results"), schema)).alias("pos", "r"))
    return parsed.where("r.chunkId is not null and r.dataSourceId is not null and r.dataSourceName is not null").select(*rest, "pos", "r.*").orderBy("seq", "pos")


def answered(answers: DataFrame, results: DataFrame, key: str = "request_id") -> DataFrame:
    """(request_id, answer, model, sources, usage) of answers (request_id, text, model, input_tokens, output_tokens).

    results are the tools' outputs of each request as tool_sources() takes them; sources keep their order, and a
    request whose tools found nothing has none. Missing token counts are 0.
    """
    found = tool_sources(results)
    source = F.struct("content", "score", F.struct(F.col("dataSourceId").alias("id"), F.col("dataSourceName").alias("name")).alias("dataSource"))
    g = found.select(key, F.struct("seq", "pos", source.alias("s")).alias("x")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]).alias("sources"))
    spent = [F.coalesce(c, F.lit(0)).cast("long") for c in ("input_tokens", "output_tokens")]
    usage = F.struct(spent[0].alias("promptTokens"), spent[1].alias("completionTokens"), (spent[0] + spent[1]).alias("totalTokens"))
    out = answers.join(g, key, "left")
    none = F.array().cast(g.schema["sources"].dataType)
    return out.select(key, F.col("text").alias("answer"), "model", F.coalesce("sources", none).alias("sources"), usage.alias("usage"))


def result_texts(results: DataFrame) -> DataFrame:
    """A search's rows as the lines that a tool server shows: name and score above the content."""
    return results.select("chunk_id", result_line(F.col("data_source_name"), F.col("score"), F.col("content")).alias("text"))


def collection_list(collections: DataFrame) -> DataFrame:
    """One row: the collections (id, name, description, source_count, chunk_count) as the JSON list that a tool server shows, by name."""
    item = F.struct("id", "name", "description", F.col("source_count").alias("sourceCount"), F.col("chunk_count").alias("chunkCount"))
    g = collections.agg(F.array_sort(F.collect_list(F.struct("name", "id", item.alias("c")))).alias("x"))
    return g.select(F.to_json(F.transform("x", lambda x: x["c"]), {"ignoreNullFields": "false"}).alias("text"))

"""The retrieval queries: graph, semantic, hybrid, impact, coverage, violations, context, orphans, listing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.functions import columns as C
from loregraph.functions.storage import discard, persisted
from loregraph.operators.graph import EDGE_KEY, Index, edges_within, incoming, outgoing, reach, reverse_traverse, running_budget, traverse
from loregraph.operators.substring import TextIndex, all_words_search, searchable, text_search
from loregraph.operators.vector import best_chunk_per_node, cosine_search, document_of, nodes_of_documents
from loregraph.schema import CHUNK_SHARE, CONSTANT_SCORE, CONTENT_CUT, CONTEXT_PRIORITY, COVERAGE_RULES, COVERAGE_TEXTS, EDGE_TYPES, KINDS, QueryError


class Tables(dict):
    """Tables by name; one that is given as a function is made when it is first asked for."""

    def __getitem__(self, name: str) -> DataFrame:
        found = super().__getitem__(name)
        if not isinstance(found, DataFrame):
            self[name] = found = found()
        return found


@dataclass
class Result:
    """Rows of a query, further tables and numbers by name, and warnings."""

    rows: DataFrame
    tables: Tables = field(default_factory=Tables)
    warnings: list[str] = field(default_factory=list)


def title_of(nodes_alias: str = "") -> Column:
    """A node's title, or its id."""
    p = f"{nodes_alias}." if nodes_alias else ""
    return F.coalesce(F.try_element_at(F.col(f"{p}fields_text"), F.lit("title")), F.col(f"{p}id"))


def kind_layer(kinds: list[str] | None, layers: list[str] | None) -> Column:
    """Kind and layer in the lists; an absent list lets all pass."""
    passes = F.lit(True)
    if kinds:
        passes = passes & F.col("kind").isin(kinds)
    return passes & F.col("layer").isin(layers) if layers else passes


def postings(index: Index) -> TextIndex | None:
    """The index's stored postings; none if they would have to be made first, as one scan is cheaper."""
    return index.texts if getattr(index.texts, "is_made", True) else None


def find_text(index: Index, query: str, fields: list[str] | None = None) -> DataFrame:
    """``text_search`` over an index, by its stored postings if it has them."""
    texts = postings(index)
    return text_search(index.nodes, query, fields) if texts is None else texts.search(query, fields)


def find_words(index: Index, words: list[str]) -> DataFrame:
    """``all_words_search`` over an index, by its stored postings if it has them."""
    texts = postings(index)
    return all_words_search(index.nodes, words) if texts is None else texts.search_words(words)


def need_node(index: Index, node: str):
    """The node's row, or an error."""
    found = index.nodes.where(F.col("id") == node).select("id", "kind").first()
    if found is None:
        raise QueryError("NODE_NOT_FOUND", f"no node {node}")
    return found


def validate(depth: int | None = None, limit: int | None = None, min_score: float | None = None, edge_types: list[str] | None = None, known: list[str] | None = None) -> None:
    """Strict checks of a query's arguments, for callers that want them; the queries themselves take any."""
    if depth is not None and not 1 <= depth <= 5:
        raise QueryError("INVALID_DEPTH", "Depth must be between 1 and 5")
    if limit is not None and not 1 <= limit <= 100:
        raise QueryError("INVALID_LIMIT", "Limit must be between 1 and 100")
    if min_score is not None and not 0 <= min_score <= 1:
        raise QueryError("INVALID_SCORE_RANGE", "min_score must be between 0.0 and 1.0")
    for kind in edge_types or []:
        if kind.upper() == kind and kind not in (EDGE_TYPES if known is None else known):
            raise QueryError("INVALID_EDGE_TYPE", f"Unknown edge type: {kind}")


def retrieval_quality(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(strategy, queries, precision, p95_seconds): ``hits(query_id, relevant)``, ``queries(query_id, strategy, seconds)``.

    Precision is the mean over queries of the share of relevant hits; queries without hits count for time alone.
    """
    per = hits.groupBy("query_id").agg(F.avg(F.col("relevant").cast("double")).alias("share"))
    rows = queries.join(per, "query_id", "left").groupBy("strategy")
    return rows.agg(F.count("*").alias("queries"), F.avg("share").alias("precision"), F.percentile("seconds", 0.95).alias("p95_seconds"))


def graph_query(index: Index, root: str, depth: int = 2, edge_types: list[str] | None = None, kinds: list[str] | None = None, respect_layers: bool = True) -> Result:
    """What lies within ``depth`` of ``root``, nearer first: node_id, score, snippet, match_source."""
    need_node(index, root)
    index = index.walkable()
    seeds = index.nodes.sparkSession.createDataFrame([(root, root)], "seed string, id string")
    reached = reach(index.adjacency, seeds, depth, edge_types, respect_layers)
    near = reached.where("dist > 0").join(index.nodes, "id").where(kind_layer(kinds, None))
    rows = near.select(F.col("id").alias("node_id"), (1 / (1 + F.col("dist"))).alias("score"), C.snippet(F.col("kind"), title_of()).alias("snippet"), F.lit("graph").alias("match_source"))
    return Result(rows, Tables(edges=lambda: edges_within(index.adjacency, reached, depth, edge_types, respect_layers).drop("seed")))


def need_query(text: str) -> None:
    if len(text.strip()) < 3:
        raise QueryError("QUERY_TOO_SHORT", "a query has at least 3 characters")


def chunks_with_nodes(index: Index, vector: list[float], limit: int, min_score: float, probes: int | None = None) -> DataFrame:
    """The best ``limit`` chunks with their ``node_id``; with ``probes``, the best of the index's so many nearest cells."""
    found = cosine_search(index.embeddings, vector, limit, min_score) if index.near is None or probes is None else index.near.search(vector, limit, probes, min_score)
    best = found.select("id", "score", document_of(F.col("id")).alias("document_id"))
    return best.join(nodes_of_documents(best, index.nodes), "document_id").select("id", "score", "node_id")


def semantic_query(index: Index, vector: list[float], kinds: list[str] | None = None, layers: list[str] | None = None, min_score: float = 0.7, limit: int = 10, text: str | None = None, probes: int | None = None) -> Result:
    """Nodes by their best chunk.  The cut to three times ``limit`` chunks comes before all else.

    ``probes``: search so many cells of a stored index instead of all vectors.
    """
    if text is not None:
        need_query(text)
    if index.embeddings is None:
        raise QueryError("NO_EMBEDDINGS", "the index has no vectors")
    chunks = best_chunk_per_node(chunks_with_nodes(index, vector, limit * 3, min_score, probes))
    found = chunks.join(index.nodes.withColumnRenamed("id", "node_id"), "node_id").where(kind_layer(kinds, layers))
    rows = found.select("node_id", "score", C.snippet(F.col("kind"), F.coalesce(F.try_element_at("fields_text", F.lit("title")), F.col("node_id"))).alias("snippet"), F.lit("semantic").alias("match_source"))
    return Result(rows.orderBy(F.col("score").desc(), "node_id").limit(limit))


def hybrid_query(index: Index, text: str, vector: list[float] | None = None, expand_graph: bool = True, depth: int = 2, kinds: list[str] | None = None, layers: list[str] | None = None, respect_layers: bool = True, min_score: float = 0.5, limit: int = 10, max_tokens: int = 8000, fields: list[str] | None = None) -> Result:
    """Fused semantic, lexical and graph scores, cut by score, tokens and limit.

    ``fields``: text and list fields that lexical matches are looked for in, beside ids and aliases; all if absent.
    """
    need_query(text)
    warnings = []
    spark = index.nodes.sparkSession
    passing = index.nodes.where(kind_layer(kinds, layers))
    if index.embeddings is not None and vector is not None:
        chunks = chunks_with_nodes(index, vector, limit * 3, min_score * CHUNK_SHARE)
        semantic = chunks.groupBy(F.col("node_id").alias("id")).agg(F.max("score").alias("semantic"))
    else:
        warnings.append("NO_EMBEDDINGS: lexical and graph matches only")
        semantic = spark.createDataFrame([], "id string, semantic double")
    lexical = find_text(index, text, fields).where(kind_layer(kinds, layers)).select("id", F.lit(CONSTANT_SCORE).alias("lexical"))
    zero = F.lit(0.0)
    scored = semantic.select("id", "semantic", zero.alias("graph"), zero.alias("lexical")).unionByName(lexical.select("id", zero.alias("semantic"), zero.alias("graph"), "lexical"))
    tables = Tables()
    if expand_graph:
        index = index.walkable()
        seeds = persisted(scored.select("id").distinct())
        hits, touched = near_seeds(index, seeds, depth, respect_layers)
        near = hits.join(passing.select("id"), "id").select("id", zero.alias("semantic"), F.lit(CONSTANT_SCORE).alias("graph"), zero.alias("lexical"))
        scored = scored.unionByName(near)
        tables["graph_expansion"] = touched
    fused = scored.groupBy("id").agg(*[F.max(c).alias(c) for c in ("semantic", "graph", "lexical")])
    fused = fused.withColumn("score", C.fusion_score(*[F.col(c) for c in ("semantic", "graph", "lexical")])).where(F.col("score") >= min_score)
    kept = fused.join(passing, "id").select(F.col("id").alias("node_id"), "score", C.snippet(F.col("kind"), title_of()).alias("snippet"), C.match_source(F.col("semantic"), F.col("graph")).alias("match_source"))
    order = [F.col("score").desc(), F.col("node_id")]
    top = kept.orderBy(*order).limit(max(limit, 1)).withColumn("tokens", C.count_tokens(F.col("snippet")))
    rows = running_budget(top, "tokens", order, max_tokens, first_is_free=True)
    return Result(rows, tables, warnings)


def near_seeds(index: Index, seeds: DataFrame, depth: int, respect_layers: bool) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """(ids within ``depth`` of a seed other than themselves, a function that gives the edges touched), without (seed, node) pairs.

    Each node keeps its two nearest seeds' names and distances: enough to know whether some
    other seed is near, whatever the number of seeds.
    """
    known, last = seeds.select("id", F.col("id").alias("seed"), F.lit(0).alias("dist")), None
    for level in range(1, depth + 1):
        moved = index.adjacency.both(known.where(F.col("dist") == level - 1), None, respect_layers).where("id <> next").select(F.col("next").alias("id"), "seed", F.lit(level).alias("dist"))
        nearest = known.unionByName(moved).groupBy("id", "seed").agg(F.min("dist").alias("dist"))
        first = nearest.groupBy("id").agg(F.min(F.struct("dist", "seed")).alias("a"))
        second = nearest.join(first, "id").where(F.col("seed") != F.col("a.seed")).groupBy("id").agg(F.min(F.struct("dist", "seed")).alias("b"))
        both = first.select("id", F.col("a.seed").alias("seed"), F.col("a.dist").alias("dist")).unionByName(second.select("id", F.col("b.seed").alias("seed"), F.col("b.dist").alias("dist")))
        known = persisted(both)
        if last is not None:
            discard(last)
        last = known
    hits = known.where("seed <> id").select("id").distinct()
    inner = known.where(F.col("dist") < depth).select("id").distinct()
    return hits, lambda: index.adjacency.both(inner, None, respect_layers).drop("id", "next").dropDuplicates(EDGE_KEY)


def impact_query(index: Index, node: str, change: str = "modify_attribute", depth: int = 3) -> Result:
    """Direct: a row for each incoming edge.  Tables: transitive (first path of each node), scenarios, truncated."""
    need_node(index, node)
    index = index.walkable()
    kinds = index.nodes.select(F.col("id").alias("node_id"), "kind", title_of().alias("title"))
    spark = index.nodes.sparkSession
    root = spark.createDataFrame([(node,)], "id string")
    direct = index.adjacency.step(root, "back").select(F.col("next").alias("node_id"), "edge_type").join(kinds, "node_id")
    direct = direct.select("node_id", "kind", "edge_type", C.impact_description(F.col("edge_type"), change).alias("impact_description"))
    own = direct.select("node_id").distinct()
    walked = reverse_traverse(index.adjacency, node, depth, spark) if depth > 1 else spark.createDataFrame([], "id string, dist int, path array<string>, edge_types array<string>")
    beyond = walked.where(F.col("id") != node).withColumnRenamed("id", "node_id").join(own, "node_id", "left_anti")
    transitive = beyond.join(kinds, "node_id").select("node_id", "kind", F.slice("path", 1, F.size("path") - 1).alias("path"), "edge_types", "dist")
    affected = own.unionByName(transitive.select("node_id")).unionByName(spark.createDataFrame([(node,)], "node_id string")).distinct()

    def scenarios() -> DataFrame:
        validating = index.adjacency.step(affected.withColumnRenamed("node_id", "id"), "back", ["VALIDATES"])
        return validating.select(F.col("from_node").alias("node_id"), F.concat(F.lit("Validates "), "to_node", F.lit(" which is affected")).alias("reason")).join(kinds, "node_id").select("node_id", F.col("title").alias("scenario_name"), "reason")

    def truncated() -> DataFrame:
        last = walked.where(F.col("dist") == depth).select("id") if depth > 1 else own.select(F.col("node_id").alias("id"))
        further = index.adjacency.step(last, "back").join(affected.withColumnRenamed("node_id", "from_node"), "from_node", "left_anti")
        return further.select(F.col("from_node").alias("node_id")).distinct()

    return Result(direct, Tables(transitive=transitive, scenarios=scenarios, truncated=truncated))


def coverage_rows(rules: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """Of each rule the distinct other ends of the node's edges of its type."""
    ends = incoming(edges, node).select("edge_type", F.col("from_node").alias("other")).unionByName(outgoing(edges, node).select("edge_type", F.col("to_node").alias("other")))
    found = rules.join(ends, "edge_type", "left").groupBy("pos", "name", "edge_type").agg(F.array_sort(F.collect_set("other")).alias("found"))
    return found.select("pos", "name", "edge_type", F.when(F.size("found") > 0, "covered").otherwise("missing").alias("status"), "found")


def coverage_query(index: Index, node: str, rules: list[tuple[str, str, str]] | None = None) -> Result:
    """Which rules of the node's kind its edges meet; table ``summary`` has present, missing and per cent."""
    kind = need_node(index, node)["kind"]
    own = [(i, name, edge) for i, (k, name, edge) in enumerate(rules or COVERAGE_RULES) if k == kind]
    if not own:
        raise QueryError("UNKNOWN_KIND", f"no coverage rules for {kind}")
    rows = coverage_rows(index.nodes.sparkSession.createDataFrame(own, "pos int, name string, edge_type string"), index.edges, node)
    texts = {name: text for (k, name), text in COVERAGE_TEXTS.items() if k == kind}
    rows = rows.withColumn("description", F.coalesce(*[F.when(F.col("name") == n, F.lit(t)) for n, t in texts.items()], F.lit(None).cast("string")))
    present = F.count_if(F.col("status") == "covered")
    summary = rows.agg(present.alias("present"), (F.count("*") - present).alias("missing"), C.percent(present, F.count("*"), 1).alias("coverage_percent"))
    return Result(rows.orderBy("pos"), Tables(summary=summary))


def violations_query(index: Index, kinds: list[str] | None = None, layers: list[str] | None = None) -> Result:
    """Edges that break the order of layers; ``summary`` has total, analyzed and rate."""
    ends = index.nodes.select("id", "kind", "layer")
    rows = index.edges.where("layer_violation")
    for side in ("from", "to"):
        rows = rows.join(ends.select(F.col("id").alias(f"{side}_node"), F.col("kind").alias(f"{side}_kind"), F.coalesce("layer", F.lit("01-domain")).alias(f"{side}_layer")), f"{side}_node", "left")
    if kinds:
        rows = rows.where(F.col("from_kind").isin(kinds) | F.col("to_kind").isin(kinds))
    if layers:
        rows = rows.where(F.col("from_layer").isin(layers) | F.col("to_layer").isin(layers))
    rows = rows.select("from_node", "to_node", "from_layer", "to_layer", "edge_type")
    total, analyzed = rows.agg(F.count("*").alias("total")), index.edges.agg(F.count("*").alias("analyzed"))
    summary = total.join(analyzed).select("total", "analyzed", C.percent(F.col("total"), F.col("analyzed"), 2).alias("rate"))  # one row each
    return Result(rows, Tables(summary=summary))


def orphans_query(index: Index, edge_types: list[str] | None = None) -> Result:
    """Edges without both ends, and their share of all loaded and orphan edges."""
    rows = index.orphans.where(F.col("edge_type").isin(edge_types)) if edge_types else index.orphans
    counts = [rows.agg(F.count("*").alias("total")), index.orphans.agg(F.count("*").alias("orphans")), index.edges.agg(F.count("*").alias("loaded"))]
    whole = F.col("loaded") + F.col("orphans")
    summary = counts[0].join(counts[1]).join(counts[2]).select("total", whole.alias("analyzed"), C.percent(F.col("total"), whole, 2).alias("rate"))  # one row each
    return Result(rows.select("from_node", "to_node", "edge_type", "source_file", "from_exists", "to_exists", "reason"), Tables(summary=summary))


def list_nodes(index: Index, kinds: list[str] | None = None, domain: str | None = None) -> DataFrame:
    rows = index.nodes.where(kind_layer(kinds, None))
    if domain is not None:
        rows = rows.where(F.col("domain") == domain)
    return rows.select("id", "kind", title_of().alias("title"), "status", "domain")


def stats(index: Index) -> DataFrame:
    parts = [("nodes", index.nodes), ("edges", index.edges), ("orphans", index.orphans)] + ([("embeddings", index.embeddings)] if index.embeddings is not None else [])
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, df in parts]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


def find_spec(index: Index, name: str, vector: list[float] | None = None, fields: list[str] | None = None) -> Result:
    return hybrid_query(index, name, vector, min_score=0.1, limit=5, fields=fields)


# --- context -----------------------------------------------------------------------------


def basename(path: str) -> str:
    """The last part of a path without its last extension; a leading dot is no extension."""
    name = path.split("/")[-1]
    return name[: name.rindex(".")] if name.rfind(".") > 0 else name


def name_variants(name: str, prefixes: list[str] | None = None) -> list[str]:
    """Ids that a name may stand for: as it is and capitalised, with every prefix."""
    names = [name] + ([name[:1].upper() + name[1:]] if name[:1].upper() != name[:1] else [])
    return [f"{p}:{n}" for n in names for p in (prefixes or [p for _, p, *_ in KINDS])]


@dataclass(frozen=True)
class Try:
    """One way to read a hint: ids that it may be, or a text or words to look for."""

    method: str
    ids: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    full_id: bool = False

    def finds(self) -> Column:
        """Whether a node with ``id`` and ``texts`` (lower-cased) is meant."""
        if self.ids:
            return F.col("id").isin(list(self.ids))
        first, *others = [F.lit(w.lower()) for w in self.words]
        found = F.exists("texts", lambda v: F.contains(v, first))
        for word in others:
            found = found & F.contains(F.array_join("texts", " "), word)
        return found


#: A hint's tries are numbered from this many times its place.
MOST_TRIES = 4


def tries_of(hint: str, prefixes: list[str] | None = None) -> list[Try]:
    """The ways to read a hint, the first that finds nodes which no earlier hint took counts."""
    found = [Try("exact", (hint,), full_id=True)] if ":" in hint else []
    if "/" in hint or "." in hint:
        name = basename(hint)
        found += [Try("basename", tuple(name_variants(name, prefixes))), Try("text_search", words=(name,))]
    elif ":" not in hint:
        found.append(Try("exact", tuple(name_variants(hint, prefixes))))
    words = tuple(hint.split())
    return [*found, Try("text_search", words=words if len(words) > 1 else (hint,))]


def resolve_hints(index: Index, hints: list[str], prefixes: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """(node_id, matched_from, match_method, seq) by hint in order, each node once; and warnings.

    All hints are looked for in one pass over the nodes by id, and in another one by text for
    those that no id settles.  What then depends on the hints before is settled over counts: a
    row for each try of a hint reaches the driver, whatever the number of nodes.  A full id that
    exists is settled even if an earlier hint took the node.
    """
    tries = [tries_of(h, prefixes) for h in hints]
    looked = {(s, k) for s, all_ in enumerate(tries) for k, t in enumerate(all_) if t.ids}
    while True:
        matched = persisted(_matched(index, tries, looked), "hints")
        chosen, wanted = _settled(matched, tries, looked)
        if not wanted:
            break
        discard(matched)
        looked |= wanted
    warnings = [f"No match found for hint: '{h}'" for s, h in enumerate(hints) if s not in chosen]
    first = _first_of(chosen)
    said = lambda values: F.get(F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>"), F.col("seq"))
    rows = matched.select(F.col("id").alias("node_id"), F.floor(first / MOST_TRIES).cast("int").alias("seq")).where("seq IS NOT NULL")
    methods = [tries[s][chosen[s]].method if s in chosen else "" for s in range(len(hints))]
    return rows.select("node_id", said(hints).alias("matched_from"), said(methods).alias("match_method"), "seq"), warnings


def _matched(index: Index, tries: list[list[Try]], looked: set[tuple[int, int]]) -> DataFrame:
    """(id, pairs): nodes that any of the looked-for tries finds, with the numbers of these."""
    asked = [(s * MOST_TRIES + k, tries[s][k]) for s, k in sorted(looked)]
    nodes, stored = index.nodes, postings(index)
    if stored is not None and any(t.words for _, t in asked):
        by_text = [stored.rows(list(t.words)) for _, t in asked if t.words]
        by_id = nodes.where(F.col("id").isin([i for _, t in asked for i in t.ids]))
        columns = ("id", "aliases", "fields_text", "fields_list")
        nodes = by_id.select(*columns)
        for rows in by_text:
            nodes = nodes.unionByName(rows.select(*columns))
        nodes = nodes.dropDuplicates(["id"])
    texts = searchable() if any(t.words for _, t in asked) else F.array().cast("array<string>")
    pairs = F.array(*[F.when(t.finds(), n) for n, t in asked]) if asked else F.array().cast("array<int>")
    return nodes.select("id", texts.alias("texts")).select("id", F.filter(pairs, lambda p: p.isNotNull()).alias("pairs")).where(F.size("pairs") > 0)


def _first_of(chosen: dict[int, int]) -> Column:
    """The number of the first chosen try that found a node; null if none did."""
    numbers = [s * MOST_TRIES + k for s, k in chosen.items()]
    return F.array_min(F.filter("pairs", lambda p: p.isin(numbers))) if numbers else F.lit(None).cast("int")


def _settled(matched: DataFrame, tries: list[list[Try]], looked: set[tuple[int, int]]) -> tuple[dict[int, int], set[tuple[int, int]]]:
    """(the try of each hint that finds something, tries that must be looked for before this can be told)."""

    def counts(chosen: dict[int, int]) -> dict[int, tuple[int, int]]:
        """By number of a try: nodes found, and those that no hint before took."""
        each = matched.select(_first_of(chosen).alias("first"), F.explode("pairs").alias("pair"))
        free = F.col("first").isNull() | (F.floor(F.col("first") / MOST_TRIES) >= F.floor(F.col("pair") / MOST_TRIES))
        return {r["pair"]: (r["all"], r["free"]) for r in each.groupBy("pair").agg(F.count("*").alias("all"), F.count_if(free).alias("free")).collect()}

    def read(found: dict[int, tuple[int, int]]) -> tuple[dict[int, int], set[tuple[int, int]]]:
        chosen, wanted = {}, set()
        for s, all_ in enumerate(tries):
            for k, t in enumerate(all_):
                if (s, k) not in looked:
                    wanted.add((s, k))
                    break
                every, free = found.get(s * MOST_TRIES + k, (0, 0))
                if free or every and t.full_id:
                    chosen[s] = k
                    break
        return chosen, wanted

    chosen, wanted = read(counts({}))
    while not wanted:
        now, wanted = read(counts(chosen))
        if now == chosen:
            break
        # all before the first difference stays; what comes after it is told again
        at = min(s for s in range(len(tries)) if now.get(s) != chosen.get(s))
        chosen = {s: k for s, k in chosen.items() if s != at} | ({at: now[at]} if at in now else {})
    return chosen, wanted


def content_of() -> Column:
    """What a node says in a context, by its kind; empty if nothing."""
    none = F.lit("")

    def own(name: str) -> Column:
        listed = F.array_join(F.try_element_at("fields_list", F.lit(name)), "; ")
        return F.coalesce(F.try_element_at("fields_text", F.lit(name)), listed, none)

    def first(*texts: Column) -> Column:
        return F.coalesce(*[F.when(t != "", t) for t in texts], none)

    def both(*names: str) -> Column:
        return F.array_join(F.filter(F.array(*[own(n) for n in names]), lambda t: t != ""), " | ")

    kind = F.col("kind")
    text = F.when(kind.isin("business-rule", "business-policy", "cross-policy"), own("declaration")).when(kind == "entity", first(own("invariants"), own("description")))
    text = text.when(kind == "command", both("preconditions", "postconditions")).when(kind == "use-case", both("description", "preconditions")).when(kind == "requirement", own("description"))
    return C.truncate(text.otherwise(first(own("description"), own("purpose"), F.col("id"))), CONTENT_CUT)


def context_query(index: Index, hints: list[str], depth: int = 1, max_tokens: int = 4000, prefixes: list[str] | None = None, content: Column | None = None, priority: dict[str, int] | None = None) -> Result:
    """Constraints and behaviour about the hinted nodes, by priority and distance, within a token budget."""
    if not hints:
        raise QueryError("EMPTY_HINTS", "name at least one hint")
    resolved, warnings = resolve_hints(index, hints, prefixes)
    index = index.walkable()
    arrow = lambda a, t, b: F.concat(a, F.lit(" -> "), t, F.lit(" -> "), b)
    roots = resolved.select(F.col("node_id").alias("id"), F.col("node_id").alias("via"), F.lit(0).alias("distance"), "seq", F.lit(0).alias("step"), F.col("node_id").alias("root"))
    starts = roots.select("id", "seq")
    out = index.adjacency.step(starts, "out").select(F.col("to_node").alias("id"), arrow(F.col("from_node"), F.col("edge_type"), F.col("to_node")).alias("via"), F.lit(1).alias("distance"), "seq", F.lit(1).alias("step"), F.col("from_node").alias("root"))
    back = index.adjacency.step(starts, "back").select(F.col("from_node").alias("id"), arrow(F.col("from_node"), F.col("edge_type"), F.col("to_node")).alias("via"), F.lit(1).alias("distance"), "seq", F.lit(2).alias("step"), F.col("to_node").alias("root"))
    found = roots.unionByName(out).unionByName(back)
    if depth > 1:
        reached, touched = traverse(index.adjacency, resolved.select(F.col("node_id").alias("seed"), F.col("node_id").alias("id")), depth)
        near = touched.select("seed", F.explode(F.array("from_node", "to_node")).alias("id"), arrow(F.col("from_node"), F.col("edge_type"), F.col("to_node")).alias("via")).groupBy("seed", "id").agg(F.min("via").alias("via"))
        deep = reached.where("dist > 0").join(near, ["seed", "id"]).join(resolved.select(F.col("node_id").alias("seed"), "seq"), "seed")
        found = found.unionByName(deep.select("id", "via", F.lit(2).alias("distance"), "seq", F.lit(3).alias("step"), F.col("seed").alias("root")))
    # the first discovery stays: by hint, root, step
    first = found.groupBy("id").agg(F.min(F.struct("seq", "root", "step", "via", "distance")).alias("d"))
    ranks = priority or CONTEXT_PRIORITY
    rank = F.coalesce(*[F.when(F.col("kind") == k, p) for k, p in ranks.items()], F.lit(3))
    items = first.join(index.nodes, "id").withColumn("content", content if content is not None else content_of()).where("content <> ''")
    items = items.select(F.when(rank <= 1, "constraints").otherwise("behavior").alias("section"), F.col("id").alias("node_id"), "kind", "content", "source_file", F.col("d.via").alias("reached_via"), rank.alias("priority"), F.col("d.distance").alias("distance"), "d")
    items = items.withColumn("tokens", C.estimate_tokens(F.concat_ws(" ", "node_id", "kind", "content", "source_file", "reached_via")))
    order = [F.col("priority"), F.col("distance"), F.col("d.seq"), F.col("d.root"), F.col("d.step"), F.col("node_id")]
    # an item has at least a token, so no more than the budget can fit
    best = items.orderBy(*order).limit(max_tokens)
    rows = running_budget(best, "tokens", order, max_tokens, first_is_free=False).drop("d")
    return Result(rows, Tables(resolved=resolved.drop("seq")), warnings)

"""Nodes and edges of parsed documents by a table of rules, and chunks to embed.

``parse.parse_documents`` makes the rows; a rule of ``FIELDS`` or ``TYPED_EDGES`` is data, so a
further kind needs no code.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loregraph.functions import columns as C
from loregraph.functions.storage import persisted
from loregraph.operators import parse as P
from loregraph.operators.graph import Index, deduplicate_edges, load_graph
from loregraph.schema import EDGES, KINDS, LINK_PREFIXES, NODES

# Headings (any case) of sections that several kinds have; a list's order has no effect.
DESCRIPTION = ["Descripción", "Description"]
DECLARATION = ["Declaración", "Declaration"]
PURPOSE = ["Propósito", "Purpose"]
PRECONDITIONS = ["Precondiciones", "Preconditions"]
POSTCONDITIONS = ["Postcondiciones", "Postconditions"]
INPUT = ["Entrada", "Input"]
ERRORS = ["Errores Posibles", "Possible Errors"]
WHEN = ["Cuándo aplica", "When Applies"]
# Per kind (field, form, headings); form is text, list, table or children.
FIELDS = {
    "entity": [
        ("description", "text", DESCRIPTION), ("attributes", "table", ["Atributos", "Attributes"]),
        ("relations", "table", ["Relaciones", "Relations", "Relationships"]), ("invariants", "list", ["Invariantes", "Invariants", "Constraints"]),
        ("state_machine", "text", ["Ciclo de Vida", "Lifecycle", "State Machine"]),
    ],
    "event": [("description", "text", DESCRIPTION), ("payload", "table", ["Payload"]), ("producer", "text", ["Productor", "Producer"]), ("consumers", "text", ["Consumidores", "Consumers"])],
    "business-rule": [
        ("declaration", "text", DECLARATION), ("when_applies", "text", WHEN), ("why_exists", "text", ["Por qué existe", "Why it exists"]),
        ("violation", "text", ["Qué pasa si se incumple", "Violation", "What happens if violated"]), ("examples", "text", ["Ejemplos", "Examples"]),
    ],
    "business-policy": [
        ("declaration", "text", DECLARATION), ("when_applies", "text", WHEN), ("parameters", "text", ["Parámetros", "Parameters"]),
        ("violation", "text", ["Qué pasa si se incumple", "Violation", "What Happens on Violation"]),
    ],
    "cross-policy": [
        ("purpose", "text", PURPOSE), ("declaration", "text", DECLARATION), ("formalization_ears", "text", ["Formalización EARS", "EARS Formalization"]),
        ("standard_behavior", "text", ["Comportamiento Estándar", "Standard Behavior"]),
    ],
    "command": [("purpose", "text", PURPOSE), ("input_params", "table", INPUT), ("preconditions", "text", PRECONDITIONS), ("postconditions", "text", POSTCONDITIONS), ("errors", "table", ERRORS)],
    "query": [("purpose", "text", PURPOSE), ("input_params", "table", INPUT), ("output_structure", "text", ["Output", "Salida"]), ("errors", "table", ERRORS)],
    "process": [("participants", "text", ["Participantes", "Participants"]), ("steps", "children", ["Pasos", "Steps"]), ("mermaid_flow", "text", ["Diagrama", "Diagram"])],
    "use-case": [
        ("description", "text", DESCRIPTION), ("actors", "text", ["Actores", "Actors"]), ("preconditions", "text", PRECONDITIONS), ("main_flow", "text", ["Flujo Principal", "Main Flow"]),
        ("alternatives", "children", ["Flujos Alternativos", "Alternative Flows"]), ("exceptions", "children", ["Excepciones", "Exceptions"]), ("postconditions", "text", POSTCONDITIONS),
    ],
    "ui-view": [
        ("description", "text", DESCRIPTION), ("layout", "text", ["Layout", "Diseño"]), ("components", "text", ["Componentes", "Components"]),
        ("states", "text", ["Estados", "States"]), ("behavior", "text", ["Comportamiento", "Behavior"]),
    ],
    "ui-component": [("description", "text", DESCRIPTION), ("entities", "text", ["Entidades", "Entities"]), ("use_cases", "text", ["Casos de Uso", "Use Cases"])],
    "requirement": [("description", "text", DESCRIPTION), ("acceptance_criteria", "text", ["Criterios de Aceptación", "Acceptance Criteria"]), ("traceability", "text", ["Trazabilidad", "Traceability"])],
    "objective": [("actor", "text", ["Actor", "Actors"]), ("objective", "text", ["Objetivo", "Objective"]), ("success_criteria", "text", ["Criterios de éxito", "Success Criteria"])],
    "prd": [
        ("problem", "text", ["Problema / Oportunidad", "Problem / Opportunity", "Problema", "Problem"]), ("scope", "children", ["Alcance", "Scope"]),
        ("users", "children", ["Usuarios y Jobs-to-be-done", "Users and Jobs-to-be-done"]), ("metrics", "text", ["Métricas de éxito y telemetría", "Success Metrics"]),
        ("dependencies", "text", ["Dependencias", "Dependencies"]),
    ],
    "adr": [("context", "text", ["Contexto", "Context"]), ("decision", "text", ["Decisión", "Decision"]), ("consequences", "text", ["Consecuencias", "Consequences"])],
    "glossary": [("definition", "text", ["Definición", "Definition"]), ("context", "text", ["Contexto", "Context"]), ("related_terms", "text", ["Términos Relacionados", "Related Terms"])],
}
# Fixed values: (kinds, sections read: the first or all of these headings, or the whole text; headings, pattern of targets or
# None for entities, edge type).
TYPED_EDGES = [
    (["entity"], "all", ["eventos del ciclo de vida", "lifecycle events"], "^EVT-", "EMITS"),
    (["business-rule", "business-policy", "cross-policy"], "first", DECLARATION, None, "ENTITY_RULE"),
    (["command"], "first", POSTCONDITIONS, "^EVT-", "EMITS"),
    (["use-case"], "first", ["Reglas Aplicadas", "Applied Rules", "Rules Applied"], "^(BR|BP|XP)-", "UC_APPLIES_RULE"),
    (["use-case"], "first", ["Comandos Ejecutados", "Commands Executed"], "^CMD-", "UC_EXECUTES_CMD"),
    (["use-case"], "whole", [], "^OBJ-", "UC_STORY"),
]
# Edges that are extracted on request only, in the same form.
FURTHER_EDGES = [
    (["business-policy"], "first", DECLARATION, None, "ENTITY_POLICY"),
    (["entity", "process"], "all", ["Eventos Consumidos", "Consumed Events"], "^EVT-", "CONSUMES"),
    (["ui-view"], "whole", [], "^UC-", "VIEW_TRIGGERS_UC"),
    (["ui-view"], "whole", [], "^UI-", "VIEW_USES_COMPONENT"),
    (["ui-component"], "whole", [], None, "COMPONENT_USES_ENTITY"),
    (["requirement"], "first", ["Trazabilidad", "Traceability"], "^(UC|BR|CMD)-", "REQ_TRACES_TO"),
    (["adr"], "whole", [], "", "DECIDES_FOR"),
]


def _fields(form: str, value, of: str) -> Column:
    """A kind's fields of a form as a map: ``value(headings)`` of each that is there.

    The rules are data, so the expression doesn't grow with their number.
    """
    rules = {kind: [{"name": name, "heads": [h.lower() for h in heads]} for name, form_, heads in fields if form_ == form] for kind, fields in FIELDS.items()}
    own = F.try_element_at(F.from_json(F.lit(json.dumps(rules)), "map<string,array<struct<name:string,heads:array<string>>>>"), F.col("kind"))
    entries = F.filter(F.transform(own, lambda r: F.struct(r["name"].alias("key"), value(r["heads"]).alias("value"))), lambda e: e["value"].isNotNull())
    return F.map_from_entries(F.coalesce(entries, F.array().cast(f"array<struct<key:string,value:{of}>>")))


def nodes_of(documents: DataFrame) -> DataFrame:
    """A node for each parsed document, with the fields that its kind's sections fill."""
    found = F.col("sections")
    content = lambda heads: F.get(P.sections_named(found, heads), 0)["content"]
    field = lambda name: F.try_element_at("front_matter", F.lit(name))
    title = F.map_from_entries(F.filter(F.array(F.struct(F.lit("title").alias("key"), field("title").alias("value"))), lambda e: e["value"].isNotNull()))
    texts = F.map_concat(_fields("text", content, "string"), _fields("children", lambda heads: P.section_with_children(found, heads), "string"), title)
    return documents.select(
        C.node_id(F.col("kind"), F.col("id")).alias("id"), "kind", F.col("path").alias("source_file"), "source_hash", "layer", F.coalesce(field("status"), F.lit("draft")).alias("status"),
        P.listed(field("aliases")).alias("aliases"), field("domain").alias("domain"), texts.alias("fields_text"),
        _fields("list", lambda heads: P.list_items(content(heads)), "array<string>").alias("fields_list"),
        _fields("table", lambda heads: P.let(content(heads), P.table_rows), "array<map<string,string>>").alias("fields_table"),
        F.current_timestamp().alias("indexed_at"),
    ).select(*[c.split()[0] for c in NODES.split(", ")])


WHOLE = "array_join(transform(sections, s -> s.content), '\\n')"
EDGE_ENTRY = "array<struct<rank:int,pos:int,edge_type:string,extraction_method:string,to_node:string,metadata:map<string,string>,layer_violation:boolean,bidirectional:boolean>>"
ENTITY_TARGET = "^(?!" + "|".join(start for start, _ in LINK_PREFIXES) + ")"


def _entry(rank, pos: Column, kind, method: str, to_node: Column, metadata: Column | None = None, flagged: Column | None = None) -> Column:
    """An edge but for its origin; links come before the typed edges, which come by rule."""
    none = F.lit(None).cast("map<string,string>")
    values = {
        "rank": rank, "pos": pos, "edge_type": kind, "extraction_method": F.lit(method), "to_node": to_node, "metadata": none if metadata is None else metadata,
        "layer_violation": F.lit(False) if flagged is None else flagged, "bidirectional": F.lit(flagged is not None),
    }
    return F.struct(*[v.alias(k) for k, v in values.items()])


def _present(**values: Column) -> Column:
    """A map of the values that are there."""
    said = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(said, lambda e: e["value"].isNotNull()))


def _typed(rules: list, first_rank: int) -> Column:
    """Entries by a table of rules (``TYPED_EDGES``, ``FURTHER_EDGES``), which is data."""
    by_kind: dict[str, list] = {}
    for rank, (kinds, which, heads, pattern, kind) in enumerate(rules, first_rank):
        for k in kinds:
            by_kind.setdefault(k, []).append({"rank": rank, "which": which, "heads": [h.lower() for h in heads], "pattern": ENTITY_TARGET if pattern is None else pattern, "kind": kind})
    own = F.try_element_at(F.from_json(F.lit(json.dumps(by_kind)), "map<string,array<struct<rank:int,which:string,heads:array<string>,pattern:string,kind:string>>>"), F.col("kind"))

    def made(r: Column) -> Column:
        found = P.sections_named(F.col("sections"), r["heads"])
        read = F.when(r["which"] == "whole", F.col("sections")).when(r["which"] == "first", F.slice(found, 1, 1)).otherwise(found)
        links = P.wiki_links(F.array_join(F.transform(read, lambda s: s["content"]), "\n"))
        return F.transform(F.filter(links, lambda x: F.rlike(x["target"], r["pattern"])), lambda x, i: _entry(r["rank"], i, r["kind"], "wiki_link", C.resolve_link(x["target"])))

    return F.coalesce(F.flatten(F.transform(own, made)).cast(EDGE_ENTRY), F.array().cast(EDGE_ENTRY))


def _wiki_link(x: Column, i: Column) -> Column:
    to = C.resolve_link(x["target"])
    return P.let(to, lambda node: _entry(F.lit(0), i, F.lit("WIKI_LINK"), "wiki_link", node, _present(domain=x["domain"], alias=x["alias"]), C.is_layer_violation(F.col("layer"), C.guess_layer(node))))


def _relations() -> Column:
    """DOMAIN_RELATION to the first link of each row of an entity's table of relations."""
    table = P.table_rows(P.find_section(F.col("sections"), "Relaciones", "Relations", "Relationships")["content"])

    def made(row: Column, i: Column) -> Column:
        target = F.get(F.flatten(F.transform(F.map_values(row), P.wiki_links)), 0)["target"]
        cardinality = F.coalesce(F.try_element_at(row, F.lit("Cardinalidad")), F.try_element_at(row, F.lit("Cardinality")), F.lit(""))
        relation = F.create_map(F.lit("relation"), F.coalesce(F.get(F.map_values(row), 0), F.lit("")), F.lit("cardinality"), cardinality)
        return _entry(F.lit(9), i, F.lit("DOMAIN_RELATION"), "section_content", F.when(target.isNotNull(), C.resolve_link(target)), relation)

    rows = P.let(F.when(F.col("kind") == "entity", table), lambda t: F.transform(t, made))
    return F.coalesce(F.filter(rows, lambda e: e["to_node"].isNotNull()).cast(EDGE_ENTRY), F.array().cast(EDGE_ENTRY))


def edges_of(documents: DataFrame, further: bool = False) -> DataFrame:
    """Links of whole documents and typed edges, each (from, to, type) once; links come first.

    ``further`` adds the edges of ``FURTHER_EDGES``, references to other domains, and the
    dependencies between layers that links imply.  A document is read once for all of them.
    """
    entries = [F.transform(P.wiki_links(F.expr(WHOLE)), _wiki_link).cast(EDGE_ENTRY), _typed(TYPED_EDGES, 1), _relations()] + ([_typed(FURTHER_EDGES, 10)] if further else [])
    rows = documents.select(C.node_id(F.col("kind"), F.col("id")).alias("from_node"), F.col("path").alias("source_file"), F.explode(F.concat(*entries)).alias("e")).select("from_node", "source_file", "e.*")
    made = rows.withColumn("edge_seq", (F.col("rank") * 1_000_000 + F.col("pos")).cast("bigint")).drop("rank", "pos")
    if further:
        made = made.unionByName(cross_domain_edges(documents)).unionByName(layer_edges(documents))
    return deduplicate_edges(made).select(*[c.split()[0] for c in EDGES.split(", ")])


def _linked(documents: DataFrame) -> DataFrame:
    """A row for each link of a document: from_node, layer, source_file, domain, edge_seq, link, to_node."""
    rows = documents.select(C.node_id(F.col("kind"), F.col("id")).alias("from_node"), "layer", F.col("path").alias("source_file"), F.try_element_at("front_matter", F.lit("domain")).alias("domain"), F.posexplode(P.wiki_links(F.expr(WHOLE))).alias("pos", "link"))
    return rows.withColumns({"to_node": C.resolve_link(F.col("link.target")), "edge_seq": (F.col("pos") + 30_000_000).cast("bigint")})


def _as_edges(rows: DataFrame, kind: str, method: str, metadata: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("map<string,string>")
    return rows.select("edge_seq", "from_node", "to_node", F.lit(kind).alias("edge_type"), "source_file", F.lit(method).alias("extraction_method"), (none if metadata is None else metadata).alias("metadata"), F.lit(False).alias("layer_violation"), F.lit(False).alias("bidirectional"))


def cross_domain_edges(documents: DataFrame) -> DataFrame:
    """CROSS_DOMAIN_REF for links ``[[domain::target]]``: both ends carry their domain before the node's id."""
    rows = _linked(documents).where("link.domain IS NOT NULL")
    own = F.when(F.col("domain").isNotNull(), F.concat("domain", F.lit(":"), "from_node")).otherwise(F.col("from_node"))
    return _as_edges(rows.withColumns({"from_node": own, "to_node": F.concat("link.domain", F.lit(":"), "to_node")}), "CROSS_DOMAIN_REF", "wiki_link", _present(domain=F.col("link.domain")))


def layer_edges(documents: DataFrame) -> DataFrame:
    """LAYER_DEPENDENCY of links from a later layer to an earlier one, requirements apart."""
    there, here = C.layer_number(C.guess_layer(F.col("to_node"))), C.layer_number(F.col("layer"))
    return _as_edges(_linked(documents).where((there > 0) & (here > there)), "LAYER_DEPENDENCY", "implicit")


def both_directions(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from_node, to_node, edge_type, layer_violation) of each edge, and of the way back of bidirectional ones."""
    layers = nodes.select("id", "layer")
    ends = edges.join(layers.select(F.col("id").alias("from_node"), F.col("layer").alias("a")), "from_node").join(layers.select(F.col("id").alias("to_node"), F.col("layer").alias("b")), "to_node")
    way = lambda x, y: (F.col(x).alias("from_node"), F.col(y).alias("to_node"), "edge_type")
    there = ends.select(*way("from_node", "to_node"), C.is_layer_violation(F.col("a"), F.col("b")).alias("layer_violation"))
    back = ends.where("bidirectional").select(*way("to_node", "from_node"), C.is_layer_violation(F.col("b"), F.col("a")).alias("layer_violation"))
    return there.unionByName(back)


# --- chunks ------------------------------------------------------------------------------


def pack(text: str | None, most: int = 1500, overlap: int = 200, delimiter: str = "\n\n") -> list[tuple[int, str]]:
    """(offset, chunk): paragraphs of a text packed into chunks of about ``most`` characters.

    A chunk closes before the paragraph that would make it too long; its last paragraph opens
    the next one if it has at most ``overlap`` characters.  A paragraph that is too long by
    itself is packed by sentences where no chunk is open; its rest stays open.  No sentence is
    cut.  Offsets count trimmed paragraphs and two characters after each, empty ones too; a
    paragraph's later sentence chunks have its own offset.
    """
    import re

    chunks: list[tuple[int, str]] = []
    parts: list[str] = []
    size = start = at = 0
    for paragraph in map(str.strip, (text or "").split(delimiter)):
        if not paragraph:
            at += 2
            continue
        if parts and size + len(paragraph) + 2 > most:
            chunks.append((start, "\n\n".join(parts)))
            parts = parts[-1:] if len(parts[-1]) <= overlap else []
            size = sum(map(len, parts))
            start = at - size - 2
        if not parts:
            start = at
        if parts or len(paragraph) <= most:
            parts.append(paragraph)
            size += len(paragraph) + 2
        else:
            for sentence in filter(None, map(str.strip, re.split(r"(?<=\.)\s+", paragraph))):
                if parts and size + len(sentence) + 1 > most:
                    chunks.append((start, " ".join(parts)))
                    parts, size = [], 0
                parts.append(sentence)
                size += len(sentence) + 1
        at += len(paragraph) + 2
    return chunks + [(start, "\n\n".join(parts))] if parts else chunks


def packed(text: Column, most: int = 1500, overlap: int = 200, delimiter: str = "\n\n") -> Column:
    """Chunks (char_offset, raw_text) of a text column; an empty or null text has none.  The packing carries state, hence Arrow batches."""

    @F.pandas_udf("array<struct<char_offset:int,raw_text:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: [{"char_offset": at, "raw_text": c} for at, c in pack(t, most, overlap, delimiter)])

    return run(text)


def embedded_sections(documents: DataFrame) -> DataFrame:
    """(id, kind, title, sections, section_pos, section): the sections that a document's kind embeds."""
    wanted = F.coalesce(*[F.when(F.col("kind") == k, F.array(*[F.lit(h) for h in heads]).cast("array<string>")) for k, _, _, heads in KINDS])
    found = F.filter("sections", lambda s: F.array_contains(wanted, F.lower(s["heading"])))
    return documents.select("id", "kind", F.try_element_at("front_matter", F.lit("title")).alias("title"), "sections", F.posexplode(found).alias("section_pos", "section"))


def _numbered(flat: DataFrame) -> DataFrame:
    """``chunk_index`` through the document, and the chunk's id and hash."""
    number = F.row_number().over(Window.partitionBy("id", "kind").orderBy("section_pos", "pos")) - 1
    return flat.withColumn("chunk_index", number).select(
        F.concat("id", F.lit(":chunk-"), F.col("chunk_index").cast("string")).alias("id"), F.col("id").alias("document_id"), F.col("kind").alias("document_kind"), F.col("section.path").alias("section_path"),
        "chunk_index", "char_offset", "raw_text", "context_text", F.sha2("raw_text", 256).alias("text_hash"),
    )


def chunks_of(documents: DataFrame, most: int = 1500, overlap: int = 200) -> DataFrame:
    """Chunks of the sections that a document's kind embeds, numbered through the document."""
    rows = embedded_sections(documents).withColumn("texts", packed(F.col("section.content"), most, overlap))
    flat = rows.select("id", "kind", "title", "section_pos", "section", F.posexplode("texts").alias("pos", "chunk")).select("*", "chunk.*")
    header = F.concat_ws("\n", F.concat(F.lit("Document: "), "id"), F.concat(F.lit("Kind: "), "kind"), F.concat(F.lit("Title: "), "title"))
    return _numbered(flat.withColumn("context_text", F.concat_ws("\n\n", header, "raw_text")))


def paragraph_chunks_of(documents: DataFrame, least_words: int = 20) -> DataFrame:
    """The other way to cut: a chunk for each paragraph, with what its ancestors say in front.

    A paragraph of less than ``least_words`` words goes with the next one; a table is a chunk of
    its own.  ``context_text`` has the document, each ancestor section's first sentence (its
    heading if it has no text), and the chunk.
    """
    paragraphs = F.filter(F.transform(F.split(F.col("section.content"), r"\n\s*\n"), C.trim_all), lambda p: p != "")
    words = lambda t: F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    none = F.array().cast("array<string>")
    state = lambda out, held: F.struct(out.alias("out"), held.alias("held"))
    flushed = lambda acc: F.when(acc["held"] != "", F.concat(acc["out"], F.array(acc["held"]))).otherwise(acc["out"])

    def step(acc: Column, p: Column) -> Column:
        text = F.when(acc["held"] != "", F.concat(acc["held"], F.lit("\n\n"), p)).otherwise(p)
        table = state(F.concat(flushed(acc), F.array(p)), F.lit(""))
        return F.when(p.startswith("|"), table).when(words(text) < least_words, state(acc["out"], text)).otherwise(state(F.concat(acc["out"], F.array(text)), F.lit("")))

    texts = F.aggregate(paragraphs, state(none, F.lit("")), step, flushed)
    above = F.filter("sections", lambda a: F.startswith(F.col("section.path"), F.concat(a["path"], F.lit("."))))
    said = F.array_join(F.transform(above, lambda a: F.when(a["content"] != "", F.get(P.sentences(a["content"]), 0)).otherwise(a["heading"])), "\n")
    rows = embedded_sections(documents).select("id", "kind", "section_pos", "section", said.alias("said"), F.posexplode(texts).alias("pos", "raw_text"))
    named = F.concat(F.lit("["), "kind", F.lit(": "), "id", F.lit("]"))
    context = F.concat_ws("\n", named, F.when(F.col("said") != "", F.col("said")), "raw_text")
    return _numbered(rows.withColumn("context_text", context).withColumn("char_offset", F.lit(None).cast("int")))


def detect_level(model: bool, agent: bool) -> str:
    """L3 with a model and an agent, L2 with a model, else L1."""
    return "L1" if not model else "L3" if agent else "L2"


def index_documents(files: DataFrame, encode=None, level: str | None = None, further: bool = False) -> tuple[Index, DataFrame]:
    """(index, skipped) of ``files(path, content)``; ``encode`` maps a text column to a vector column.

    Vectors are made from level L2 on; the level follows from whether there is an encoder.
    """
    documents, skipped = P.parse_documents(files, stored=True)  # nodes, edges and chunks read it
    return index_of(documents, encode, level, further), skipped


def index_of(documents: DataFrame, encode=None, level: str | None = None, further: bool = False) -> Index:
    """``index_documents`` of stored documents."""
    level = level or detect_level(encode is not None, False)
    chunks = None
    if level != "L1" and encode is not None:
        chunks = chunks_of(documents).withColumn("vector", encode(F.col("context_text")))
    return load_graph(nodes_of(documents), persisted(edges_of(documents, further), "edges"), chunks)


def index_log(documents: DataFrame, skipped: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """A row a file in the order of paths: success, node_id, edge_count, embedding_count, skipped_reason, warning."""
    edges = edges_of(documents).groupBy(F.col("source_file").alias("path")).agg(F.count("*").alias("edge_count"))
    made = documents.select("path", F.lit(True).alias("success"), C.node_id(F.col("kind"), F.col("id")).alias("node_id"), F.lit(None).cast("string").alias("skipped_reason"), "warning", "id")
    made = made.join(edges, "path", "left")
    if chunks is not None:
        made = made.join(chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("embedding_count")), "id", "left")
    else:
        made = made.withColumn("embedding_count", F.lit(0).cast("bigint"))
    made = made.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("edge_count", "embedding_count")}).drop("id")
    failed = skipped.select("path", F.lit(False).alias("success"), "skipped_reason", *[F.lit(0).cast("bigint").alias(c) for c in ("edge_count", "embedding_count")])
    return made.unionByName(failed, allowMissingColumns=True).orderBy("path")


def index_counters(log: DataFrame, domain: Column | None = None) -> DataFrame:
    """One row: nodes, edges, embeddings, skipped, domains of an index run's log."""
    return log.agg(
        F.count_if("success").alias("nodes"), F.coalesce(F.sum("edge_count"), F.lit(0)).alias("edges"), F.coalesce(F.sum("embedding_count"), F.lit(0)).alias("embeddings"),
        F.count_if(~F.col("success")).alias("skipped"), F.array_sort(F.collect_set(domain if domain is not None else F.lit(None).cast("string"))).alias("domains"),
    )

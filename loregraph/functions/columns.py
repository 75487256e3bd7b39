"""Column functions of the model: layers, ids, links, texts, scores."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from loregraph.schema import BONUS, DIVISOR, GRAPH_WEIGHT, IMPACT_TEXTS, KINDS, LAYERS, LEXICAL_WEIGHT, LINK_PREFIXES, PREFIX_LAYERS, SEMANTIC_WEIGHT


#: Unicode's white space and the byte order mark.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def trim_all(c: Column) -> Column:
    """Trim all white space, Unicode's too; linear in the text, whatever runs of blanks it has."""
    return F.btrim(c, F.lit(WHITE))


def layer_number(layer: Column) -> Column:
    """0 to 4; null for an unknown layer."""
    found = F.lit(None).cast("int")
    for i, name in enumerate(LAYERS):
        found = F.when(layer == name, i).otherwise(found)
    return found


def is_layer_violation(origin: Column, destination: Column) -> Column:
    """A layer above the requirements refers to a later one."""
    return F.coalesce((layer_number(origin) > 0) & (layer_number(origin) < layer_number(destination)), F.lit(False))


def detect_layer(path: Column) -> Column:
    """The first layer whose name the path has; ``01-domain`` otherwise."""
    return F.coalesce(*[F.when(F.contains(path, F.lit(name)), F.lit(name)) for name in LAYERS], F.lit("01-domain"))


def kind_prefix(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(p)) for k, p, *_ in KINDS])


def expected_path(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(path)) for k, _, path, _ in KINDS])


def node_id(kind: Column, doc_id: Column) -> Column:
    return F.concat(kind_prefix(kind), F.lit(":"), doc_id)


def resolve_link(target: Column) -> Column:
    """Node id that a link's target names."""
    named = [F.when(F.startswith(target, F.lit(start)), F.concat(F.lit(f"{prefix}:"), target)) for start, prefix in LINK_PREFIXES]
    return F.coalesce(*named, F.concat(F.lit("Entity:"), target))


def is_entity_target(target: Column) -> Column:
    return ~target.rlike("^(" + "|".join(start for start, _ in LINK_PREFIXES) + ")")


def guess_layer(node: Column) -> Column:
    """Layer by a node id's prefix; null if unknown."""
    prefix = F.substring_index(node, ":", 1)
    return F.coalesce(*[F.when(prefix.isin(prefixes), F.lit(layer)) for layer, prefixes in PREFIX_LAYERS.items()])


def _ascii_forms() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters with one ASCII sign as their compatible form, those signs, and (character, signs) of the others.

    The compatible form is Unicode's NFKD without marks and signs beyond ASCII.
    """
    import unicodedata

    one, signs, more = [], [], []
    for c in map(chr, [*range(0xA0, 0xD800), *range(0xF900, 0x10000)]):
        form = "".join(x for x in unicodedata.normalize("NFKD", c) if x.isascii())
        if len(form) == 1:
            one.append(c)
            signs.append(form)
        elif form and any(w in unicodedata.name(c, "") for w in ("LATIN", "ROMAN", "FRACTION")):
            more.append((c, form))
    return "".join(one), "".join(signs), more


ASCII_FROM, ASCII_TO, ASCII_MORE = _ascii_forms()


def anchor(heading: Column) -> Column:
    """A heading as an anchor: compatible forms without accents, lower case, other signs dropped, blanks as hyphens."""
    beyond = "[^\\x00-\\x7F]"
    text = F.translate(heading, ASCII_FROM, ASCII_TO)
    # ligatures and the like are rare: a text without one takes no further look
    more = F.from_json(F.lit(json.dumps(dict(ASCII_MORE))), "map<string,string>")
    several = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(more, c), c)), "")
    text = F.lower(F.when(heading.rlike(beyond), F.when(text.rlike(beyond), several).otherwise(text)).otherwise(heading))
    text = F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9_\s-]", ""), r"\s+", "-")
    return F.btrim(text, F.lit("-"))


def snippet(kind: Column, title: Column) -> Column:
    return F.concat(F.lit("["), kind, F.lit("] "), title)


def text_snippet(content: Column, most: int = 200) -> Column:
    """A text without Markdown signs, cut at a sentence or a word."""
    text = trim_all(content)
    for pattern, by in ((r"(?m)^#+\s+", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"(?U)\s+", " ")):
        text = F.regexp_replace(text, pattern, by)
    text = F.trim(text)
    head = F.substring(text, 1, most)
    # places from the start, 0-based, as of the last occurrence; -1 where there is none
    period = F.length(head) - F.instr(F.reverse(head), " .") - 1
    period = F.when(F.instr(F.reverse(head), " .") > 0, period).otherwise(-1)
    space = F.when(F.instr(F.reverse(head), " ") > 0, F.length(head) - F.instr(F.reverse(head), " ")).otherwise(-1)
    cut = F.when(period > most / 2, F.substring(head, F.lit(1), period + 1)).when(space > most / 2, F.concat(F.substring(head, F.lit(1), space), F.lit("..."))).otherwise(F.concat(head, F.lit("...")))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def count_tokens(text: Column) -> Column:
    """At least 1; four characters a token."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("bigint")


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def fusion_score(semantic: Column, graph: Column, lexical: Column) -> Column:
    sources = sum((F.when(c > 0, 1).otherwise(0) for c in (graph, lexical)), F.when(semantic > 0, 1).otherwise(0))
    raw = semantic * SEMANTIC_WEIGHT + graph * GRAPH_WEIGHT + lexical * LEXICAL_WEIGHT + F.when(sources > 1, (sources - 1) * F.lit(BONUS)).otherwise(0.0)
    return F.least(raw / DIVISOR, F.lit(1.0))


def match_source(semantic: Column, graph: Column) -> Column:
    return F.when((semantic > 0) & (graph > 0), "fusion").when(semantic > 0, "semantic").when(graph > 0, "graph").otherwise("lexical")


def impact_description(edge_type: Column, change: str) -> Column:
    text = F.coalesce(*[F.when(edge_type == k, F.lit(v)) for k, v in IMPACT_TEXTS.items()], F.concat(F.lit("Connected via "), edge_type))
    return F.concat(text, F.lit(f" — change type: {change}"))


def percent(part: Column, whole: Column, digits: int) -> Column:
    """Share in per cent, half rounded up; 0 of nothing."""
    k = 10**digits
    return F.when(whole > 0, F.floor(part / whole * (100 * k) + 0.5) / k).otherwise(0.0)


def rounded(c: Column, digits: int = 6) -> Column:
    return F.floor(c * 10**digits + 0.5) / 10**digits


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is 0 or the sizes differ."""
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(total(a, a)) * F.sqrt(total(b, b))  # of a literal a constant, which the planner folds
    return F.when(F.size(a) == F.size(b), total(a, b) / F.nullif(norms, F.lit(0.0)))

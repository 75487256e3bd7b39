"""Parsing of Markdown specifications into rows and columns, by built-in expressions.

A document is a row (path, content).  Front matter is YAML: plain ``key: value`` lines and
lists are read by expressions, all else by a YAML parser in Arrow batches.  Sections are one
fold over a document's lines.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from loregraph.functions import columns as C
from loregraph.functions.storage import persisted

SECTION = "struct<heading:string,level:int,content:string,path:string>"
LINK = "struct<raw:string,target:string,domain:string,alias:string>"
FENCE = r"(?s)^---[ \t]*\r?\n(.*?)\r?\n?---[ \t]*(?:\r?\n|$)"
#: Lines that need no YAML parser: a key with a plain or quoted value or a one-line list, an item of a list, or blanks.
#: The last two have a ``#`` within a word, which opens no comment.
PLAIN = (
    r"^(?:[A-Za-z_][\w-]*:[ \t]*(?:[^\s'\"\[\]{}|>&*!%@`#,][^'\"\[\]{}#:,]*|\"[^\"\\]*\"|'[^']*'|\[[^'\"\[\]{}#:]*\])?[ \t]*|[ \t]+- [^\s'\"\[\]{}|>&*!%@`#,:][^'\"\[\]{}#:,]*|[ \t]*"
    r"|[A-Za-z_][\w-]*: +(?!(?s:.*)(?:\t|[\s,\[][#?-]|[\[,] *[,\]]))(?:[^\s'\"\[\]{}|>&*!%@`#,?-][^'\"\[\]{}:,]*|\[[^'\"\[\]{}:]*\]) *"
    r"| +- (?!(?s:.*)(?:\t|\s[#?-]))[^\s'\"\[\]{}|>&*!%@`#,:?-][^'\"\[\]{}:,]*)$"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once, however often the body names it, in loops too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def yaml_fields(block: str) -> dict[str, str] | None:
    """Fields of a YAML mapping as texts; lists and mappings as JSON; none where it isn't a mapping."""
    import yaml

    try:
        found = yaml.load(block, Loader=yaml.BaseLoader)  # scalars stay as they are written
    except yaml.YAMLError:
        return None
    if found is None:
        return {}
    if not isinstance(found, dict):
        return None
    return {str(k): v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in found.items()}


@F.pandas_udf(MapType(StringType(), StringType()))
def parsed_yaml(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in blocks:
        yield batch.map(lambda b: None if b is None else yaml_fields(b))


#: The same where a row's result is used often: Spark neither repeats it in a filter nor below one.
parsed_once = parsed_yaml.asNondeterministic()


def _block(content: Column) -> tuple[Column, Column, Column]:
    """(whether a text has a fence, what is in it, whether this is plain)."""
    has = content.rlike(FENCE)
    block = F.when(has, F.regexp_replace(F.regexp_extract(content, FENCE, 1), r"\r", ""))
    # line by line: one expression for all lines would recurse with their number
    return has, block, F.forall(F.split(block, "\n"), lambda line: line.rlike(PLAIN))


def _fields_and_body(content: Column, parsed: Column) -> tuple[Column, Column]:
    """``front_matter`` of a text whose block was ``parsed`` if it isn't plain."""
    has, block, plain = _block(content)
    # list items under a key go on its line
    flat = F.regexp_replace(F.coalesce(block, F.lit("")), r"\n[ \t]+- ", " , ")
    pairs = F.filter(F.split(flat, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    key = lambda x: F.trim(F.substring_index(x, ":", 1))
    value = lambda x: F.regexp_replace(C.trim_all(F.regexp_replace(x, r"^[^:]*:", "")), r"^(['\"])(.*)\1$", "$2")
    # the last of a key's lines counts: sorted by key and place, it is the one before another key
    placed = F.array_sort(F.transform(pairs, lambda x, i: F.struct(key(x).alias("key"), i.alias("i"), value(x).alias("value"))))
    lasts = let(placed, lambda all_: F.filter(all_, lambda e, i: (i + 1 == F.size(all_)) | (F.get(all_, i + 1)["key"] != e["key"])))
    last = F.transform(F.array_sort(F.transform(lasts, lambda e: F.struct(e["i"], e["key"].alias("key"), e["value"].alias("value")))), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    fields = F.when(F.coalesce(plain, F.lit(True)), F.map_from_entries(last)).otherwise(parsed)
    is_body = ~has | F.coalesce(~plain & parsed.isNull(), F.lit(False))
    return F.coalesce(fields, F.create_map().cast("map<string,string>")), F.when(is_body, content).otherwise(F.regexp_replace(content, FENCE, ""))


def front_matter(content: Column) -> tuple[Column, Column]:
    """(map of fields, body) of a text.

    A text without a fence at its start, or with something between the fences that is no YAML
    mapping, is all body.  Lists and mappings are JSON texts, but for plain ones (see ``listed``).
    """
    has, block, plain = _block(content)
    return _fields_and_body(content, parsed_yaml(F.when(has & ~plain, block)))


def listed(value: Column) -> Column:
    """A front-matter value as a list: a JSON array, ``[a, b]``, items of lines, or one value; none if empty."""
    inner = F.regexp_replace(F.coalesce(value, F.lit("")), r"^\[|\]$", "")
    items = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(C.trim_all(x), r"^(['\"])(.*)\1$", "$2"))
    made = F.when(value.rlike(r'^\["'), F.from_json(value, "array<string>"))
    return F.filter(F.coalesce(made, items), lambda x: x != "")


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, "^(#+)", 1))


def heading_text(line: Column) -> Column:
    return F.regexp_replace(line, r"^#+\s*", "")


def sections(body: Column, fence_aware: bool = False) -> Column:
    """A text's sections in order.

    Each line that starts with ``#`` is a heading (with ``fence_aware``, not inside a fence of
    backticks); its section has the lines up to the next one.  ``path`` joins the anchors of the
    headings that it stands under.  Text before the first heading belongs to none.
    """
    mark = "struct<i:int,level:int,heading:string,anchor:string>"
    start = F.struct(F.array().cast(f"array<{mark}>").alias("stack"), F.array().cast("array<string>").alias("paths"))

    def places(lines: Column, begin: str) -> Column:
        return F.filter(F.transform(lines, lambda x, i: F.when(x.startswith(begin), i)), lambda i: i.isNotNull())

    def heading(line: Column, i: Column) -> Column:
        text = heading_text(line)
        return let(text, lambda t: F.struct(i.alias("i"), heading_level(line).alias("level"), t.alias("heading"), C.anchor(t).alias("anchor")))

    def step(acc: Column, head: Column) -> Column:
        # levels rise along the stack, so what stays is what is lower
        above = F.concat(F.filter(acc["stack"], lambda s: s["level"] < head["level"]), F.array(head))
        path = lambda now: F.array_join(F.transform(now, lambda s: s["anchor"]), ".")
        return let(above, lambda now: F.struct(now.alias("stack"), F.concat(acc["paths"], F.array(path(now))).alias("paths")))

    def made(lines: Column, heads: Column, paths: Column) -> Column:
        upto = lambda k: F.coalesce(F.get(heads, k + 1)["i"], F.size(lines))
        text = lambda h, k: C.trim_all(F.array_join(F.slice(lines, h["i"] + 2, upto(k) - h["i"] - 1), "\n"))
        return F.transform(heads, lambda h, k: F.struct(h["heading"].alias("heading"), h["level"].alias("level"), text(h, k).alias("content"), F.get(paths, k).alias("path")))

    def found(lines: Column) -> Column:
        at = places(lines, "#")
        if fence_aware:
            at = let(places(lines, "```"), lambda fences: F.filter(places(lines, "#"), lambda i: F.size(F.filter(fences, lambda f: f < i)) % 2 == 0))
        heads = F.transform(at, lambda i: heading(F.get(lines, i), i)).cast(f"array<{mark}>")
        return let(heads, lambda all_: let(F.aggregate(all_, start, step, lambda acc: acc["paths"]), lambda paths: made(lines, all_, paths)))

    return let(F.split(body, "\n", -1), found).cast(f"array<{SECTION}>")


def wiki_links(text: Column) -> Column:
    """Links ``[[domain::target|alias]]`` in order; empty ones are none."""
    raws = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)), C.trim_all), lambda x: x != "")

    def link(raw: Column) -> Column:
        whole = F.split(raw, "::", -1)
        crossed = F.size(whole) > 1
        named = F.when(crossed, C.trim_all(F.get(whole, 1))).otherwise(raw)
        parts = F.split(named, r"\|", -1)
        aliased = F.size(parts) > 1
        return F.struct(raw.alias("raw"), F.when(aliased, C.trim_all(F.get(parts, 0))).otherwise(named).alias("target"), F.when(crossed, C.trim_all(F.get(whole, 0))).alias("domain"), F.when(aliased, C.trim_all(F.get(parts, 1))).alias("alias"))

    return F.transform(raws, link).cast(f"array<{LINK}>")


def link_targets(text: Column) -> Column:
    return F.transform(wiki_links(text), lambda x: x["target"])


def table_rows(content: Column) -> Column:
    """Rows of all lines that start with a bar, as maps by the first one's cells; the second is skipped.

    Rows with too few cells are dropped; of equal headers the last counts.  Null has none.
    """
    none = F.array().cast("array<struct<key:string,value:string>>")
    cells = lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|", -1), C.trim_all)

    def row(values: Column, heads: Column) -> Column:
        entries = F.zip_with(heads, F.slice(values, 1, F.size(heads)), lambda k, v: F.struct(k.alias("key"), v.alias("value")))
        last = F.aggregate(entries, none, lambda acc, e: F.when(F.exists(acc, lambda a: a["key"] == e["key"]), F.transform(acc, lambda a: F.when(a["key"] == e["key"], e).otherwise(a))).otherwise(F.concat(acc, F.array(e))))
        return F.map_from_entries(last)

    def rows(lines: Column, heads: Column) -> Column:
        split = F.transform(F.slice(lines, 3, F.size(lines)), cells)
        return F.transform(F.filter(split, lambda v: F.size(v) >= F.size(heads)), lambda v: row(v, heads))

    def made(lines: Column) -> Column:
        heads = F.transform(cells(F.get(lines, 0)), lambda h: F.regexp_replace(h, "`", ""))
        return F.when(F.size(lines) >= 2, let(heads, lambda h: rows(lines, h))).otherwise(F.array().cast("array<map<string,string>>"))

    lines = F.filter(F.transform(F.split(C.trim_all(content), "\n"), C.trim_all), lambda x: x.startswith("|"))
    return F.when(content.isNotNull(), let(lines, made))


def list_items(content: Column) -> Column:
    """Items of lines that start with ``- `` or ``* ``."""
    lines = F.filter(F.transform(F.split(content, "\n"), C.trim_all), lambda x: x.startswith("- ") | x.startswith("* "))
    return F.transform(lines, lambda x: C.trim_all(F.substring(x, 3, 1 << 30)))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=\.)\s+"), C.trim_all), lambda x: x != "")


def sections_named(found: Column, heads: Column) -> Column:
    """Sections whose heading, in lower case, is one of ``heads``."""
    return F.filter(found, lambda s: F.array_contains(heads, F.lower(s["heading"])))


def find_sections(found: Column, *names: str) -> Column:
    return sections_named(found, F.array(*[F.lit(n.lower()) for n in names]).cast("array<string>"))


def find_section(found: Column, *names: str) -> Column:
    """The first section of any of these headings, in any case; null if none."""
    return F.get(find_sections(found, *names), 0)


def section_with_children(found: Column, heads: Column) -> Column:
    """The first section of one of ``heads`` (lower case), and those deeper ones that follow it, each under a new heading."""

    def under(own: Column, after: Column) -> Column:
        stop = F.array_position(F.transform(after, lambda s: (s["level"] <= own["level"]).cast("int")), 1).cast("int")
        children = F.when(stop > 0, F.slice(after, 1, F.greatest(stop - 1, F.lit(0)))).otherwise(after)
        parts = F.concat(F.filter(F.array(own["content"]), lambda t: t != ""), F.transform(children, lambda s: F.concat(F.lit("### "), s["heading"], F.lit("\n\n"), s["content"])))
        return F.when(F.size(parts) > 0, F.array_join(parts, "\n\n"))

    at = F.array_position(F.transform(found, lambda s: F.array_contains(heads, F.lower(s["heading"])).cast("int")), 1).cast("int")
    return let(at, lambda i: F.when(i > 0, let(F.slice(found, i + 1, F.size(found)), lambda after: under(F.get(found, i - 1), after))))


def read_section(content: Column, wanted: str) -> Column:
    """The raw lines under the heading of an anchor, up to the next one that is not deeper; null if none.

    The anchor may be given with its accents.
    """
    names = F.array(F.lit(wanted), C.anchor(F.lit(wanted)))

    def marks(lines: Column) -> Column:
        heads = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("line"))), lambda x: x["line"].startswith("#"))
        return F.transform(heads, lambda x: F.struct(x["i"].alias("i"), heading_level(x["line"]).alias("level"), C.anchor(heading_text(x["line"])).alias("anchor")))

    def under(lines: Column, heads: Column, own: Column) -> Column:
        following = F.get(F.filter(heads, lambda m: (m["i"] > own["i"]) & (m["level"] <= own["level"])), 0)
        return F.when(own.isNotNull(), C.trim_all(F.array_join(F.slice(lines, own["i"] + 1, F.coalesce(following["i"], F.size(lines)) - own["i"]), "\n")))

    def found(lines: Column) -> Column:
        return let(marks(lines), lambda heads: let(F.get(F.filter(heads, lambda m: F.array_contains(names, m["anchor"])), 0), lambda own: under(lines, heads, own)))

    return let(F.split(content, "\n", -1), found)


def read_sections(files: DataFrame, path: str, wanted: str | None = None) -> DataFrame:
    """(path, section) of the files of this path: the text under the anchor, or the whole text."""
    own = files.where(F.col("path") == path)
    return own.select("path", (F.col("content") if wanted is None else read_section(F.col("content"), wanted)).alias("section"))


def parsed_rows(files: DataFrame) -> DataFrame:
    """A row for each of ``files(path, content)``, with a ``skipped_reason`` where it is no document; its front matter is read once."""
    has, block, plain = _block(F.col("content"))

    def front(parsed: Column) -> Column:
        fields, body = _fields_and_body(F.col("content"), parsed)
        return F.struct(fields.alias("front_matter"), body.alias("body"))

    rows = files.select("path", "content", let(parsed_once(F.when(has & ~plain, block)), front).alias("front")).select("path", "content", "front.*")
    rows = rows.withColumn("kind", C.trim_all(F.lower(F.coalesce(F.try_element_at("front_matter", F.lit("kind")), F.lit("")))))
    reason = F.when(F.col("content").isNull(), "unreadable").when(C.kind_prefix(F.col("kind")).isNull(), F.concat(F.lit("unknown kind: "), "kind"))
    base = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    unexpected = ~F.contains(F.col("path"), C.expected_path(F.col("kind")))
    return rows.select(
        F.coalesce(F.try_element_at("front_matter", F.lit("id")), base).alias("id"), "kind", "path", "front_matter", C.detect_layer(F.col("path")).alias("layer"),
        F.sha2("content", 256).alias("source_hash"), sections(F.col("body")).alias("sections"), link_targets(F.col("body")).alias("links"),
        F.when(unexpected, F.concat(F.lit("expected under "), C.expected_path(F.col("kind")))).alias("warning"), reason.alias("skipped_reason"),
    )


def parse_documents(files: DataFrame, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, skipped) of ``files(path, content)``.

    Documents of an unknown or absent kind are skipped with a reason; one in an unexpected
    folder has a ``warning``.  ``stored``: both are read from a table written once, for callers
    that use them several times.
    """
    rows = parsed_rows(files)
    if stored:
        rows = persisted(rows, "documents")
    skipped = F.col("skipped_reason").isNotNull()
    return rows.where(~skipped).drop("skipped_reason"), rows.where(skipped).select("path", "skipped_reason")

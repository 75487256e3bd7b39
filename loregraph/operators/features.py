"""Specifications that are no Markdown: YAML files, and feature files whose scenarios validate nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loregraph.functions import columns as C
from loregraph.operators import parse as P

# Words that open a feature and a scenario, in English and Spanish.
FEATURE_WORDS = ["Feature", "Característica"]
SCENARIO_WORDS = ["Scenario Outline", "Scenario", "Esquema del escenario", "Escenario"]
#: What a tag or link must look like to name a node that a scenario validates.
VALIDATED = "^(UC|BR|CMD)-"


def yaml_as_markdown(files: DataFrame) -> DataFrame:
    """``files(path, content)`` of YAML specifications as documents that are front matter alone."""
    return files.select("path", F.concat(F.lit("---\n"), F.regexp_replace("content", r"(?m)^---[ \t]*\r?$\n?", ""), F.lit("\n---\n")).alias("content"))


def _title(line: Column, words: list[str]) -> Column:
    return C.trim_all(F.regexp_replace(line, rf"^\s*(?:{'|'.join(words)})\s*:", ""))


def scenarios(files: DataFrame) -> DataFrame:
    """(path, feature, pos, title, text, tags) of each scenario of ``files(path, content)``.

    A scenario has the tags of the lines right before it and those of its feature.
    """
    opens = rf"^\s*(?:{'|'.join(SCENARIO_WORDS)})\s*:"
    feature_opens = rf"^\s*(?:{'|'.join(FEATURE_WORDS)})\s*:"
    tags_of = lambda line: F.filter(F.split(C.trim_all(line), r"\s+"), lambda t: t.startswith("@"))
    none = F.array().cast("array<string>")
    found = "array<struct<title:string,lines:array<string>,tags:array<string>>>"
    start = F.struct(none.alias("waiting"), none.alias("common"), F.lit(None).cast("string").alias("feature"), F.array().cast(found).alias("done"))

    def state(acc: Column, **new: Column) -> Column:
        return F.struct(*[new.get(n, acc[n]).alias(n) for n in ("waiting", "common", "feature", "done")])

    def step(acc: Column, line: Column) -> Column:
        tags = tags_of(line)
        scenario = F.struct(_title(line, SCENARIO_WORDS).alias("title"), none.alias("lines"), F.concat(acc["common"], acc["waiting"]).alias("tags"))
        last = F.element_at(acc["done"], -1)
        longer = F.concat(F.slice(acc["done"], 1, F.size(acc["done"]) - 1), F.array(F.struct(last["title"].alias("title"), F.concat(last["lines"], F.array(line)).alias("lines"), last["tags"].alias("tags"))))
        return (
            F.when(F.size(tags) > 0, state(acc, waiting=F.concat(acc["waiting"], tags)))
            .when(line.rlike(feature_opens), state(acc, waiting=none, common=acc["waiting"], feature=_title(line, FEATURE_WORDS)))
            .when(line.rlike(opens), state(acc, waiting=none, done=F.concat(acc["done"], F.array(scenario))))
            .when(F.size(acc["done"]) > 0, state(acc, waiting=none, done=longer))
            .otherwise(acc)
        )

    parsed = files.select("path", F.aggregate(F.split(F.coalesce("content", F.lit("")), "\n", -1), start, step).alias("f"))
    rows = parsed.select("path", F.col("f.feature").alias("feature"), F.posexplode("f.done").alias("pos", "s"))
    return rows.select("path", "feature", "pos", "s.title", F.array_join("s.lines", "\n").alias("text"), F.col("s.tags").alias("tags"))


def scenario_nodes(found: DataFrame) -> DataFrame:
    """Nodes (id, kind, source_file, layer, fields_text) of scenarios; an id is the file's name and the scenario's number."""
    base = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    return found.select(F.concat(F.lit("Scenario:"), base, F.lit("#"), (F.col("pos") + 1).cast("string")).alias("id"), F.lit("scenario").alias("kind"), F.col("path").alias("source_file"), F.lit("04-verification").alias("layer"), F.create_map(F.lit("title"), F.col("title"), F.lit("feature"), F.coalesce("feature", F.lit(""))).alias("fields_text"), "text", "tags")


def validates_edges(found: DataFrame) -> DataFrame:
    """VALIDATES from scenarios to the use cases, rules and commands that their tags and links name, each once."""
    named = F.concat(F.transform("tags", lambda t: F.substring(t, 2, 1 << 30)), P.link_targets(F.col("text")))
    targets = F.filter(F.array_distinct(named), lambda t: t.rlike(VALIDATED))
    rows = scenario_nodes(found).select("id", "source_file", F.posexplode(targets).alias("pos", "target"))
    return rows.select(
        F.col("pos").cast("bigint").alias("edge_seq"), F.col("id").alias("from_node"), C.resolve_link(F.col("target")).alias("to_node"), F.lit("VALIDATES").alias("edge_type"), "source_file",
        F.lit("wiki_link").alias("extraction_method"), F.lit(None).cast("map<string,string>").alias("metadata"), F.lit(False).alias("layer_violation"), F.lit(False).alias("bidirectional"),
    )

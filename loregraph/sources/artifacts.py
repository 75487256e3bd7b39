"""Reading specifications, and writing and reading an index as files.

An index is a folder of versions ``version=N``, each with Parquet tables ``nodes`` (by kind),
``edges``, ``embeddings`` (by kind) and a one-row JSON table ``manifest``, written last.  The
greatest version with a whole manifest counts, so readers see an index as it was or as it is,
never half of it, and an index can be read, changed and written to its own folder.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.operators.graph import Index, load_graph
from loregraph.schema import EDGES, EMBEDDINGS, MANIFEST, NODES, QueryError


def read_markdown(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """(path, content) of all files below ``root``; files that vanish meanwhile are left out."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("ignoreMissingFiles", True)
    return reader.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_json_index(spark: SparkSession, root: str, with_vectors: bool = True) -> Index:
    """An index kept as JSON: a file per node, lines of edges, arrays of chunks, and a manifest."""
    manifest = spark.read.schema(MANIFEST).option("multiLine", True).json(f"{root}/manifest.json")
    files = spark.read.option("multiLine", True).option("recursiveFileLookup", True)
    nodes = files.schema(NODES).json(f"{root}/nodes")
    edges = spark.read.schema(EDGES).json(f"{root}/edges/edges.jsonl")
    chunks = files.schema(EMBEDDINGS).json(f"{root}/embeddings") if with_vectors and _has_vectors(manifest) else None
    return load_graph(nodes, edges, chunks, manifest)


def _has_vectors(manifest: DataFrame) -> bool:
    row = manifest.select("embeddings").first()
    return bool(row and row["embeddings"])


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def versions(spark: SparkSession, root: str, whole: bool = True) -> list[int]:
    """Versions in the folder, ascending; ``whole``: only those whose manifest is written."""
    path = _path(spark, root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    found = [int(n.split("=")[1]) for n in names if n.startswith("version=")]
    return sorted(v for v in found if not whole or files.exists(_path(spark, f"{root}/version={v}/manifest/_SUCCESS")))


def write_index(index: Index, root: str, manifest: dict[str, object] | None = None, keep: int = 2) -> int:
    """Write the next version and return it; the ``keep`` last ones stay, so that readers of the one before can end.

    Orphans are kept among the edges, as another load may find their ends.
    """
    spark = index.nodes.sparkSession
    number = max(versions(spark, root, whole=False), default=0) + 1
    folder = f"{root}/version={number}"
    write_nodes(index.nodes, f"{folder}/nodes")
    columns = index.edges.columns
    append_edges(index.edges.unionByName(index.orphans.select(*columns)), folder)
    if index.embeddings is not None:
        write_embeddings(index.embeddings, f"{folder}/embeddings")
    counted = spark.read.parquet(f"{folder}/nodes").count(), spark.read.parquet(f"{folder}/edges").count(), spark.read.parquet(f"{folder}/embeddings").count() if index.embeddings is not None else 0
    domains = sorted(r[0] for r in index.nodes.select("domain").distinct().collect() if r[0]) if "domain" in index.nodes.columns else []
    row = {"version": "1.0", "index_level": "L2" if counted[2] else "L1", "nodes": counted[0], "edges": counted[1], "embeddings": counted[2], "domains": domains, "structure": "multi-domain" if len(domains) > 1 else "single-domain"} | (manifest or {})
    names = [c.split()[0] for c in MANIFEST.split(", ")]
    spark.createDataFrame([tuple(row.get(n) for n in names)], MANIFEST).write.json(f"{folder}/manifest")
    for old in versions(spark, root)[:-keep]:
        path = _path(spark, f"{root}/version={old}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return number


def write_nodes(nodes: DataFrame, folder: str) -> None:
    """A table of nodes by kind; kinds that ``nodes`` has are replaced, others stay."""
    nodes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind").parquet(folder)


def write_embeddings(chunks: DataFrame, folder: str) -> None:
    """A table of chunks, by their documents' kind where it is known."""
    (chunks.write.partitionBy("document_kind") if "document_kind" in chunks.columns else chunks.write).parquet(folder)


def clear_edges(index: Index) -> Index:
    """The index without edges."""
    return replace(index, edges=index.edges.limit(0), orphans=index.orphans.limit(0))


def append_edges(edges: DataFrame, root: str) -> None:
    """Add to the table of edges below ``root``."""
    edges.write.mode("append").parquet(f"{root}/edges")


def read_index(spark: SparkSession, root: str, with_vectors: bool = True) -> Index:
    """The last version that ``write_index`` wrote; vectors only if wanted and there are any."""
    found = versions(spark, root)
    if not found:
        raise QueryError("INDEX_NOT_FOUND", root)
    folder = f"{root}/version={found[-1]}"
    manifest = spark.read.schema(MANIFEST).json(f"{folder}/manifest")
    chunks = spark.read.parquet(f"{folder}/embeddings") if with_vectors and _has_vectors(manifest) else None
    return load_graph(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges"), chunks, manifest)

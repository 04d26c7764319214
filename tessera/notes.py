"""Command line for a folder of notes: init, search, status and clear.

    python -m tessera.notes init FOLDER --store DIR --embedder module:function
    python -m tessera.notes search QUERY --store DIR --embedder module:function --tag work --tag home

An embedder is a function from a list of texts to a list of vectors. It is handed in; none is bundled.
"""

from __future__ import annotations

import argparse
import importlib
import shutil
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from .operators.scalar import ScalarIndex
from .sources import notes, store


def embedder_of(name: str) -> Callable[[list[str]], Any]:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def build(spark: SparkSession, folder: str, where: str, embedder: Callable[[list[str]], Any], bits: int = 4) -> int:
    """Chunk, embed and index the notes of a folder; returns the number of chunks."""
    rows = notes.embedded(notes.note_chunks(notes.markdown_files(spark, folder)), embedder)
    rows.write.mode("overwrite").parquet(f"{where}/chunks")  # embedded once
    rows = spark.read.parquet(f"{where}/chunks")
    first = rows.first()
    if first is None:
        return 0
    index = ScalarIndex(spark, len(first.embedding), bits)
    index.add_batch(rows.select("id", "embedding"))
    store.save(index, f"{where}/index")
    notes.write_sidecar(rows.select("id", "path", "chunk_idx", "text", "tags", "folder"), f"{where}/sidecar")
    return len(index)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera.notes", description="Search a folder of markdown notes.")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("init", "search", "status", "clear"):
        c = commands.add_parser(name)
        c.add_argument("--store", required=True)
        if name in ("init", "search"):
            c.add_argument("text", metavar="FOLDER" if name == "init" else "QUERY")
            c.add_argument("--embedder", required=True, help="module:function")
        if name == "search":
            c.add_argument("-k", type=int, default=5)
            c.add_argument("--tag", action="append", help="any of these; may be given several times")
    a = parser.parse_args(argv)
    if a.command == "clear":
        if not (Path(a.store) / "index" / store.POINTER).exists():
            print(f"no index in {a.store}")
            return 1
        for part in ("index", "sidecar", "chunks"):
            shutil.rmtree(Path(a.store) / part, ignore_errors=True)
        return 0
    spark = SparkSession.builder.getOrCreate()
    where = f"file://{Path(a.store).resolve()}"
    if a.command == "init":
        print(f"{build(spark, a.text, where, embedder_of(a.embedder))} chunks")
        return 0
    side = notes.read_sidecar(spark, f"{where}/sidecar")
    if a.command == "status":
        print(", ".join(f"{n} {k}" for k, n in notes.status(side).first().asDict().items()))
        return 0
    index = store.load(spark, f"{where}/index")
    for r in notes.search_notes(index, side, embedder_of(a.embedder)([a.text])[0], a.k, a.tag).collect():
        print(f"{r.rank}. {r.score:.3f} {r.path}#{r.chunk_idx} [{', '.join(r.tags)}]\n   {r.snippet}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""A reader for the subset of Turtle that class hierarchies and shapes are written in."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^[\w:]+)?|<[^>]*>|[;.,\[\]()]|[^\s;,\[\]()]+?(?=\s|[;,\[\]()]|\.\s|\.$|$)')


def read_turtle(text: str) -> list[tuple[str, str, str]]:
    """Triples of plain statements (subject, predicate lists and object lists); blank nodes and lists are skipped."""
    text = re.sub(r"(?m)^\s*@prefix[^\n]*$|(?m:^\s*#[^\n]*$)", "", text)
    out, subject, predicate, depth = [], None, None, 0
    for token in _TOKEN.findall(text):
        if token in "[(":
            depth += 1
        elif token in "])":
            depth -= 1
        elif depth:
            continue
        elif token == ".":
            subject = predicate = None
        elif token == ";":
            predicate = None
        elif token == ",":
            continue
        elif subject is None:
            subject = token
        elif predicate is None:
            predicate = token
        else:
            out.append((subject, predicate, token))
    return out


def local(name: str) -> str:
    return re.sub(r"^.*[:#/]", "", name.strip("<>"))


def subclasses(spark: SparkSession, triples: list[tuple[str, str, str]]) -> DataFrame:
    """(child, parent)"""
    rows = [(local(s), local(o)) for s, p, o in triples if local(p) == "subClassOf"]
    return spark.createDataFrame(rows, "child string, parent string")


def terms(spark: SparkSession, triples: list[tuple[str, str, str]]) -> DataFrame:
    """(name, kind): declared classes and properties."""
    kinds = {"Class": "class", "ObjectProperty": "object_property", "DatatypeProperty": "datatype_property"}
    rows = [(local(s), kinds[local(o)]) for s, p, o in triples if p in ("a", "rdf:type") and local(o) in kinds]
    return spark.createDataFrame(rows, "name string, kind string")


def subclass_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """(child, parent) from Turtle of one statement a line, as large ontologies are exchanged; each line is parsed where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(local(s), local(o)) for text in batch.column(0).to_pylist() if text for s, p, o in read_turtle(text) if local(p) == "subClassOf"]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], names=["child", "parent"])

    return lines.select(line).mapInArrow(run, "child string, parent string").distinct()

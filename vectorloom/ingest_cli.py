"""Command line: a document in, JSON with chunks and vectors out."""

from __future__ import annotations

import argparse

from vectorloom.evaluate import providers_from_environment, session
from vectorloom.operators.ingest import Pipeline
from vectorloom.sources.anchors import read_corpus
from vectorloom.sources.documents import from_files
from vectorloom.sources.sinks import write_json


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Ingest documents and write their chunks and vectors as JSON.")
    parser.add_argument("--doc", required=True, help="path or pattern of .txt, .md, .html or .pdf files")
    parser.add_argument("--output", required=True, help="folder for the JSON lines")
    parser.add_argument("--strategy", default="recursive")
    parser.add_argument("--providers", nargs="*", help="by priority; default: all with a key")
    parser.add_argument("--anchors", help="JSON array of anchor texts, needed as soon as a fallback happens")
    options = parser.parse_args(arguments)
    providers = providers_from_environment(options.providers)
    spark = session("ingest")
    anchors = read_corpus(spark, options.anchors) if options.anchors else None
    done = Pipeline(spark, providers, options.strategy, anchors=anchors).ingest(from_files(spark, options.doc))
    write_json(done.chunks, done.docs, options.output)
    done.docs.show(truncate=False)


if __name__ == "__main__":
    main()

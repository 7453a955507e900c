"""python -m loamlake load PATH | ask CHUNKS QUESTION... | queries"""

from __future__ import annotations

import argparse
import json


def main() -> None:
    parser = argparse.ArgumentParser(prog="loamlake", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    load = sub.add_parser("load", help="load Bronze files into the Gold tables")
    load.add_argument("path")
    load.add_argument("--source", choices=("local", "minio"), default="local")
    load.add_argument("--kind", choices=("site", "pdf", "all"), default="all")
    load.add_argument("--limit", type=int)
    load.add_argument("--no-vectors", action="store_true")
    ask = sub.add_parser("ask", help="answer questions over a chunk table (Parquet) with columns id, documento_id, titulo, texto, url, categoria, autor")
    ask.add_argument("chunks")
    ask.add_argument("question", nargs="+")
    ask.add_argument("--top-k", type=int, default=5)
    ask.add_argument("--mode", choices=("hybrid", "vector", "lexical"), default="hybrid")
    sub.add_parser("queries", help="list the registered queries")
    args = parser.parse_args()

    if args.command == "queries":
        from loamlake.plans.registry import QUERIES

        print("\n".join(sorted(QUERIES)))
        return
    from pyspark.sql import SparkSession

    from loamlake.operators.embed import embed_documents
    from loamlake.plans.config import AnswerConfig, EvidenceConfig, RetrievalConfig
    from loamlake.plans.engine import Engine
    from loamlake.plans.load import LoadRequest, run_pipeline
    from loamlake.ship import ship_code

    spark = SparkSession.builder.appName("loamlake").getOrCreate()
    ship_code(spark)
    if args.command == "load":
        rows = run_pipeline(spark, LoadRequest(args.path, args.source, args.kind, args.limit, load_vectors=not args.no_vectors))
    else:
        chunks = spark.read.parquet(args.chunks)
        engine = Engine(chunks, embed_documents(chunks, "id", "texto"), RetrievalConfig.from_env(), EvidenceConfig.from_env(), AnswerConfig())
        rows = engine.ask(spark.createDataFrame(list(enumerate(args.question)), "qid long, question string"), args.top_k, args.mode)
    for row in rows.toJSON().collect():
        print(json.dumps(json.loads(row), ensure_ascii=False))


if __name__ == "__main__":
    main()

"""python -m quarry --data DIR: run a query, search, ask the agent, serve it, or run the pipeline; without any of these, talk to the agent."""

from __future__ import annotations

import argparse
import os
import sys
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession

from quarry import etl, server
from quarry.operators import collection, service
from quarry.operators.agent import Agent
from quarry.plans import catalog, raw, search
from quarry.sources.shared import fresh_path, shared_folder

LEAVE = ("exit", "quit", "q")


def port_of(text: str | None) -> int:
    try:
        return int(text or server.DEFAULT_PORT)
    except ValueError:
        return server.DEFAULT_PORT


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quarry", description=__doc__)
    parser.add_argument("--data", required=True, help="a folder of Parquet tables")
    parser.add_argument("--query", choices=sorted(catalog.QUERIES))
    parser.add_argument("--search")
    parser.add_argument("--chat", help="ask the agent once")
    parser.add_argument("--top", type=int, default=5)
    parser.add_argument("--pipeline", action="store_true", help="from raw answers to papers and chunks with vectors")
    parser.add_argument("--out", help="where the pipeline's tables go; a fresh folder if not told")
    parser.add_argument("--collection", help="a folder that --pipeline made (its `collection`): search that, not the tables of documents")
    parser.add_argument("--api", action="store_true", help="serve /chat, /search and /health")
    parser.add_argument("--port", type=int, default=port_of(os.environ.get("API_PORT")))
    parser.add_argument("--session", default=os.environ.get("AGENT_SESSION_ID", "default"))
    return parser


def talk(agent: Agent, sessions: service.Sessions, session: str, lines: Iterable[str], say: Callable[[str], None] = print) -> int:
    """A conversation by lines, kept after every turn, until one of them says to leave. The number of turns."""
    turns = 0
    for line in lines:
        text = line.strip()
        if text.lower() in LEAVE:
            break
        if text:
            say(service.chat(agent, sessions, text, session)["answer"])
            turns += 1
    return turns


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("quarry").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.query:
        catalog.QUERIES[args.query](spark, args.data).show(20, truncate=80)
        return 0
    if args.pipeline:
        out = args.out or fresh_path(spark, "pipeline")
        made = etl.run(spark, raw.answers(spark, args.data, 2), out)
        etl.summary(spark, made).orderBy("name").show(truncate=False)
        held = f"{out}/collection-{uuid.uuid4().hex}"
        collection.build(made, held)
        print(f"search it with --collection {held}")
        return 0
    agent = collection.Collection(spark, args.collection).agent() if args.collection else Agent(spark, search.corpus(spark, args.data), search.vectors(spark, args.data))
    sessions = service.Sessions(spark, f"{shared_folder(spark)}/sessions")
    if args.search:
        for hit in service.search(agent, args.search, top_n=args.top)["results"]:
            print(hit["score"], hit["pmcid"], hit["text"][:100].replace("\n", " "))
    elif args.chat:
        talk(agent, sessions, args.session, [args.chat])
    elif args.api:
        checks = {t: lambda t=t: spark.read.parquet(f"{args.data}/{t}.parquet").schema for t in ("documents", "embeddings")}
        server.served(agent, sessions, checks, args.port).serve_forever()
    else:
        talk(agent, sessions, args.session, sys.stdin)
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""python -m loamline index | refresh | inspect | ask | apply | agents | serve | status"""

from __future__ import annotations

import argparse
import sys

from loamline import agents, serve
from loamline.config import BACKENDS
from loamline.plans import index as I
from loamline.plans import store, vault

SHOWN_ENTITIES, SHOWN_PROBES, EXCERPT = 12, 10, 220


def positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError(f"{text} isn't a positive number")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loamline")
    p.add_argument("--vault", default=".")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "refresh"):
        s = sub.add_parser(name)
        s.add_argument("--max-files", type=positive)
        s.add_argument("--chunk-size", type=positive, dest="chunk_size_words")
        s.add_argument("--chunk-overlap", type=int, dest="chunk_overlap_words")
        s.add_argument("--entities", type=positive, dest="selected_entity_limit")
        s.add_argument("--backend", choices=BACKENDS, dest="embedding_backend")
    s = sub.add_parser("inspect")
    s.add_argument("query", nargs="?")
    s.add_argument("--json", action="store_true")
    s = sub.add_parser("ask")
    s.add_argument("query")
    s.add_argument("--limit", type=positive)
    s.add_argument("--target")
    s.add_argument("--json", action="store_true")
    sub.add_parser("apply").add_argument("target")
    sub.add_parser("agents").add_argument("agent", choices=sorted(agents.FILES))
    sub.add_parser("serve")
    sub.add_parser("status")
    return p


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("loamline").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def ask_json(spark, at: str, query: str, limit: int | None = None, target: str | None = None) -> str:
    hits, matched = vault.ask_vault(spark, at, query, limit, target)
    return vault.results_json(hits, matched, query, at, target).first().json


def inspect_json(spark, at: str, query: str | None = None) -> str:
    return vault.inspect_json(vault.load_index(spark, at), query).first().json


def run(args: argparse.Namespace) -> None:
    at = args.vault
    if args.command == "agents":
        print("\n".join(map(str, agents.install(at, args.agent))))
        return
    if args.command == "status":
        m = store.read_manifest(store.index_path(at))
        print(f"{m['root']}: made {m['generated_at']}, {m['embedding']['model']}, {len(m['targets'])} targets")
        return
    spark = session()
    if args.command in ("index", "refresh"):
        names = ("max_files", "chunk_size_words", "chunk_overlap_words", "selected_entity_limit", "embedding_backend")
        made = vault.index_vault(spark, at, {k: v for k in names if (v := getattr(args, k)) is not None})
        print(", ".join(f"{v} {k}" for k, v in I.stats(made).items()))
    elif args.command == "inspect":
        if args.json:
            print(inspect_json(spark, at, args.query))
            return
        found, known = vault.inspect_vault(spark, at, args.query)
        for e in known.limit(SHOWN_ENTITIES).collect():
            print(f"{e.entity_id}  {e.document_count} notes, {e.activity_trend}, {e.score:.2f}")
        for q in found.limit(SHOWN_PROBES).collect():
            print(f"? {q.text}")
    elif args.command == "ask":
        if args.json:
            print(ask_json(spark, at, args.query, args.limit, args.target))
            return
        hits, matched = vault.ask_vault(spark, at, args.query, args.limit, args.target)
        for q in matched.orderBy("rank").collect():
            print(f"? {q.text}")
        rows = hits.collect()
        for r in rows:
            print(f"{r['rank']}. {r.title} ({r.relative_path}) {r.score}\n   {r.content[:EXCERPT]}")
        if not rows:
            print("No matching notes found.")
    elif args.command == "apply":
        e = vault.apply_corpus(spark, at, args.target)
        print(f"{e['path']}: {e['doc_count']} notes, target {e['id']}")
    elif args.command == "serve":
        tools = {"inspect": lambda query=None: inspect_json(spark, at, query), "ask": lambda query, limit=None, target=None: ask_json(spark, at, query, limit, target)}
        serve.run(tools, sys.stdin, sys.stdout)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        run(args)
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

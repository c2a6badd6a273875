"""Commands: queries over a folder of tables, and analyses of a folder of code."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, integrate
from .plans import code_facts, flows, lexer, statements
from .sources import code_files, store
from .workbench import Workbench


def analysed(spark: SparkSession, folder: str, owner: str) -> dict[str, DataFrame]:
    """The facts of all units below a folder: units, facts, writers, flows, chunks."""
    units = code_files.read_units(spark, folder, owner)
    named = units.select(F.concat_ws(".", "owner", "name", F.regexp_replace("unit_type", " ", "_")).alias("unit"), "text")
    return {"units": units.drop("text", "spec"), "facts": code_facts.facts(named), "writers": statements.writers_of(named), "flows": flows.flows_of(named), "chunks": statements.chunked(named).drop("text")}


def integrated(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Calls, table uses and lineage steps out of the facts of units."""
    facts = tables["facts"].withColumn("node", F.concat_ws(".", F.regexp_replace("unit", r"\.[^.]*$", ""), F.nullif("path", F.lit(""))))
    use = facts.filter("fact = 'table'").select("node", F.col("what").alias("table_name"), "op")
    calls = facts.filter("fact = 'call'").groupBy(F.col("node").alias("src"), F.col("what").alias("dst")).agg(F.sort_array(F.collect_set("line")).alias("lines"))
    return {"crud": graph.crud_matrix(use), "calls": calls, "steps": graph.lineage_steps(use), "findings": integrate.counts_by_kind(facts.filter("fact = 'mark'").select(F.col("what").alias("kind")))}


def _shown(df: DataFrame, most: int) -> None:
    got = df.limit(most + 1).collect()
    for r in got[:most]:
        print(json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False))
    if len(got) > most:
        print(f"more than {most} rows", file=sys.stderr)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, said in (("sql", "run a query over a folder of tables"), ("explain", "its plan"), ("check", "what is wrong with it"), ("count", "how many rows it gives")):
        p = commands.add_parser(name, help=said)
        p.add_argument("folder")
        p.add_argument("query")
        p.add_argument("--most", type=int, default=500)
    p = commands.add_parser("split", help="the statements of a script, with kinds and risks")
    p.add_argument("file")
    p = commands.add_parser("run", help="analyse a folder of code into a new bundle")
    p.add_argument("folder")
    p.add_argument("bundle")
    p.add_argument("--owner", default="APP")
    p = commands.add_parser("show", help="a table of a bundle")
    p.add_argument("bundle")
    p.add_argument("table")
    p.add_argument("--most", type=int, default=100)
    args = parser.parse_args(argv)
    if args.command == "split":
        with open(args.file, "rb") as f:
            for statement, kind, line in lexer.split_script(code_files.decode(f.read())):
                print(json.dumps({"line": line, "kind": kind, "read_only": lexer.is_read_only(statement), "risks": lexer.risks(statement), "statement": statement}, ensure_ascii=False))
        return 0
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    if args.command == "run":
        facts = analysed(spark, args.folder, args.owner)
        made = store.export_bundle(facts | integrated(facts), args.bundle, {"owner": args.owner})
        print(json.dumps({name: t["rows"] for name, t in made["tables"].items()}))
        return 0
    if args.command == "show":
        tables = store.import_bundle(spark, args.bundle)
        if args.table not in tables:
            print(f"no such table; there are {', '.join(sorted(tables))}", file=sys.stderr)
            return 2
        _shown(tables[args.table], args.most)
        return 0
    bench = Workbench(spark, args.folder)
    problem = bench.problem(args.query)
    if problem is not None:
        print(problem, file=sys.stderr)
        return 1
    if args.command == "sql":
        _shown(bench.sql(args.query), args.most)
    elif args.command == "explain":
        print(bench.explain(args.query))
    elif args.command == "count":
        print(bench.count(args.query))
    return 0


if __name__ == "__main__":
    sys.exit(main())

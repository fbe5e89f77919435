"""python -m sieveworks diagnose|clean|repl FILE ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sieveworks")
    parser.add_argument("--master", default="local[*]")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, what in (("diagnose", "run all checks"), ("clean", "repair what needs no judgement"), ("repl", "work on tables by commands")):
        sub = commands.add_parser(name, help=what)
        sub.add_argument("path", nargs="?" if name == "repl" else None)
        sub.add_argument("--json", action="store_true")
        sub.add_argument("--workspace", default="workspace")
        if name != "diagnose":
            sub.add_argument("--policy", choices=("auto", "all"), default="auto")
            sub.add_argument("--resume")
    args = parser.parse_args(argv)
    spark = SparkSession.getActiveSession() or SparkSession.builder.master(args.master).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    from .agent.session import Session, run_clean_once
    from .api import diagnose

    try:
        if args.command == "diagnose":
            report = diagnose(args.path)
            print(report.to_json() if args.json else report)
        elif args.command == "clean":
            summary = run_clean_once(Session(args.workspace, spark=spark, resume=args.resume), args.path, policy=args.policy)
            print(json.dumps(summary, indent=2) if args.json else "\n".join(f"{k}: {v}" for k, v in summary.items()))
        else:
            repl(Session(args.workspace, spark=spark, resume=args.resume), args.path, args.policy)
    except (OSError, ValueError, NotImplementedError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


def repl(session, path: str | None, policy: str) -> None:
    """/load /clean /clean-family /skills /why /trace /quit; anything else is a question."""
    from .agent.session import by_policy

    if path:
        session.load(path)
    for line in sys.stdin:
        word, _, rest = line.strip().partition(" ")
        try:
            if word in ("/quit", "/exit"):
                return
            if word == "/load":
                session.load(*rest.split()[:2])
            elif word == "/clean":
                print(session.clean(rest or next(reversed(session.tables)), by_policy(policy)).to_markdown())
            elif word == "/clean-family":
                print(json.dumps(session.clean_family(*rest.split()[:2]), indent=2))
            elif word == "/skills":
                print("\n".join(f"{e['name']}: {e['state']}" for e in session.library.entries.values()) or "none")
            elif word == "/why":
                print(session.why(rest or None))
            elif word == "/trace":
                print("\n".join(f"{e['ev_id']} {e['kind']}" for e in session.transcript.events()))
            elif word:
                print(session.ask(line.strip(), by_policy(policy)).to_markdown())
        except Exception as e:  # noqa: BLE001 - a prompt outlives its errors
            print(f"error: {type(e).__name__}: {e}", file=sys.stderr)


if __name__ == "__main__":
    sys.exit(main())

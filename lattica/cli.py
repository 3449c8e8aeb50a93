"""python -m lattica.cli [PATH] [--json | --graph] [--hotspots | --impact FILE | --impact-diff | --serve [--port N]] [--version]"""

from __future__ import annotations

import argparse
import sys

from lattica import VERSION
from lattica.plans import report
from lattica.plans.project import Project
from lattica.plans.server import PORT, server
from lattica.sources.project_files import ProjectError


def port(text: str) -> int:
    if not text.isdecimal() or not 1 <= int(text) <= 65535:
        raise argparse.ArgumentTypeError(f'"{text}" is no port number')
    return int(text)


def parsed(args: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="lattica", description="Questions to the code graph of a JavaScript or TypeScript project.")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("--json", action="store_true", help="JSON instead of text")
    one = p.add_mutually_exclusive_group()
    one.add_argument("--graph", action="store_true", help="the whole code graph, as JSON")
    one.add_argument("--hotspots", action="store_true")
    one.add_argument("--impact", metavar="FILE")
    one.add_argument("--impact-diff", action="store_true")
    one.add_argument("--serve", action="store_true", help="answer over HTTP")
    p.add_argument("--port", type=port, help=f"with --serve, {PORT} if not given")
    a = p.parse_args(args)
    if a.serve and a.json:
        p.error("--json doesn't go with --serve")
    if a.port is not None and not a.serve:
        p.error("--port goes with --serve only")
    return a


def main(args: list[str] | None = None) -> int:
    a = parsed(args)

    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("lattica").getOrCreate()
    try:
        project = Project(spark, a.path)
        if a.serve:
            s = server(project, a.port or PORT)
            print(f"http://127.0.0.1:{s.server_port}", flush=True)
            s.serve_forever()
        if a.graph:
            print(report.as_json(project.code_graph_data()))
            return 0
        if a.hotspots:
            data, text = project.hotspots(), report.hotspots_text
        elif a.impact is not None:
            data, text = project.impact(a.impact), report.impact_text
        elif a.impact_diff:
            data, text = project.diff_impact(), report.diff_text
        else:
            data, text = project.summary(), report.summary_text
        print(report.as_json(data) if a.json else text(data))
        return 0
    except KeyboardInterrupt:
        return 0
    except ProjectError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

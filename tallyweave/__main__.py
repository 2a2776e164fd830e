"""``python -m tallyweave FILE... [--out DIR]``: files to result files, from the command line.

Exit status 0 when every file was read, else 1. ``--json`` prints one object a file.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from importlib import metadata

from pyspark.sql import SparkSession

from tallyweave.functions import vocabulary as V
from tallyweave.operators.pipeline import MODES
from tallyweave.sources.results import process, result_files, results

VERSION = "0.2.0"


def health() -> dict:
    """Versions of what the engine stands on, and the engines that can read pictures (none is built in)."""
    def version(name: str) -> str | None:
        try:
            return metadata.version(name)
        except metadata.PackageNotFoundError:
            return None

    return {"version": VERSION, "python": sys.version.split()[0], "ocr_engines": [], "packages": {n: version(n) for n in ("pyspark", "pandas", "pyarrow")}}


def _line(path: str, r: dict, files: list[str]) -> str:
    s = r["summary"]
    flagged = f"{s.get('balance_mismatches', 0)} flagged" if s["balance_checked"] else "balance not checked"
    what = f"{len(r['rows'])} rows, {flagged}" if r["rows"] else f"table, {len(r['grid'])} rows" if r["grid"] else "text"
    return f"{path}: {what} [{'+'.join(s['sources'])}] -> {', '.join(files)}"


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    ap = argparse.ArgumentParser(prog="tallyweave", description="Documents to ledgers, tables or text.")
    ap.add_argument("files", nargs="*")
    ap.add_argument("--out", default=".", help="output folder (default: current folder)")
    ap.add_argument("--mode", choices=MODES, default="auto")
    ap.add_argument("--engine", choices=["auto", *V.ENGINES], default="auto")
    ap.add_argument("--json", action="store_true", help="one JSON object a file on stdout")
    ap.add_argument("--health", action="store_true", help="versions and engines")
    ap.add_argument("--version", action="version", version=VERSION)
    a = ap.parse_args(argv)
    if a.health:
        print(json.dumps(health(), indent=2))
        return 0
    if not a.files:
        ap.error("no files given")
    spark = spark or SparkSession.builder.appName("tallyweave").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    paths = [os.path.abspath(f) for f in a.files]
    out = process(spark, paths, a.mode, a.engine)
    files = result_files(out).cache()
    os.makedirs(a.out, exist_ok=True)
    # a command's files are few and go to this machine's folder, one at a time; a corpus is written by sinks.save
    for f in files.where("name IS NOT NULL").toLocalIterator():
        with open(os.path.join(a.out, f.name), "wb") as target:
            target.write(f.content)
    found = {r.doc_id: (r.ok, json.loads(r.json)) for r in results(out, files).collect()}
    for given, path in zip(a.files, paths):
        ok, r = found[path]
        if a.json:
            print(json.dumps({"file": given, **r}))
        elif ok:
            print(_line(given, r, [n for k, n in r["outputs"].items() if not k.endswith("_error")]))
        else:
            print(f"{given}: ERROR {r['error']}", file=sys.stderr)
    files.unpersist()
    return 0 if all(found[p][0] for p in paths) else 1


if __name__ == "__main__":
    sys.exit(main())

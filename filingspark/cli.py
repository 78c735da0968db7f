"""Command line: `python -m filingspark.cli extract|taxonomy|pack|transform ...`."""

from __future__ import annotations

import argparse
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

VERSION = "0.1.0"
OK, FAILED, USAGE, INTERRUPTED = 0, 1, 2, 130


def exit_code(files_ok: int, files_err: int, stream_error: BaseException | None = None, continue_on_error: bool = False) -> int:
    """0 only if the input was read to its end and gave a document, and none failed (or failures are
    let pass)."""
    if isinstance(stream_error, KeyboardInterrupt):
        return INTERRUPTED
    if stream_error is not None or files_ok < 1 or (files_err and not continue_on_error):
        return FAILED
    return OK


def session(workers: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("filingspark").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    if "SPARK_REMOTE" not in os.environ and "MASTER" not in os.environ:
        builder = builder.master(f"local[{workers or '*'}]")
    return builder.getOrCreate()


def batch_report(by_file: DataFrame, rows: int = 1000) -> str:
    """Markdown table of a comparison's status per file, of its first files by name."""
    lines = ["| file | status | pairs | must | observe |", "|---|---|---|---|---|"]
    for r in by_file.orderBy("source_file").limit(rows).collect():
        lines.append(f"| {r.source_file} | {r.status} | {r.paired_rows} | {r.must_mismatches} | {r.observe_mismatches} |")
    return "\n".join(lines) + "\n"


def _spooled(stdin) -> str:
    """Standard input in a file; a zip or gzip is refused."""
    from filingspark.sources import names as N

    data = stdin.read()
    if N.is_gzip(data[:512]):
        raise ValueError("cannot read gzip from stdin: .tar.gz is not supported")
    kind = N.sniff(data[:512])
    if kind == N.ZIP:
        raise ValueError("cannot read zip from stdin: save it to a file first")
    if kind == N.UNKNOWN:
        raise ValueError("unsupported input on stdin")
    handle, path = tempfile.mkstemp(suffix={N.TAR: ".tar", N.TAR_ZST: ".tar.zst"}.get(kind, ".xml"))
    with os.fdopen(handle, "wb") as f:
        f.write(data)
    return path


def extract(args: argparse.Namespace, stdin=None, log=sys.stderr) -> int:
    from pyspark.sql import functions as F

    from filingspark.operators.extract import bind, facts_of, status_of, summary
    from filingspark.operators.parser import parse_documents
    from filingspark.sources.datasource import read_filings
    from filingspark.sources.tables import write_facts_file

    began, error, spool = time.time(), None, None
    out = open(args.output, "w", newline="", encoding="utf-8") if args.output else sys.stdout
    totals = {"members": 0, "files_ok": 0, "files_err": 0, "corrections": 0, "facts": 0}
    samples: list[str] = []
    try:
        spark = session(args.workers)
        path = args.input
        if path == "-":
            path = spool = _spooled(stdin or sys.stdin.buffer)
        members = read_filings(spark, path)
        if spool and spool.endswith(".xml"):
            members = members.withColumn("source_file", F.lit("-"))
        bound = bind(parse_documents(members)).persist()
        write_facts_file(facts_of(bound), out)
        totals = summary(status_of(bound)).first().asDict()
        samples = [r.error for r in status_of(bound).where("NOT ok").limit(20).collect()]
        bound.unpersist()
    except KeyboardInterrupt as e:
        error = e
    except Exception as e:
        error = e
    finally:
        if args.output:
            out.close()
        if spool:
            os.unlink(spool)
    print("done: " + " ".join(f"{k}={v}" for k, v in totals.items()) + f" elapsed={time.time() - began:.3f}s out={args.output or 'stdout'}", file=log)
    for s in samples:
        print(f"  {s}", file=log)
    if error is not None:
        print(f"stream: {error}", file=log)
    return exit_code(totals["files_ok"], totals["files_err"], error, args.continue_on_error)


def taxonomy(args: argparse.Namespace, log=sys.stderr) -> int:
    from filingspark.operators import taxonomy as X
    from filingspark.sources.tables import write_concepts
    from filingspark.sources.taxonomies import fetch, read_sources

    try:
        archives = [fetch(s, args.cache) for s in read_sources(args.sources)]
        rows = X.sorted_rows(X.merge(X.concepts(X.zip_schemas(session(), archives))))
        print(f"{len(rows)} concepts in {write_concepts(rows, args.output)}", file=log)
        return OK
    except Exception as e:
        print(f"taxonomy: {e}", file=log)
        return FAILED


def pack(args: argparse.Namespace, log=sys.stderr) -> int:
    from filingspark.sources import archives as A

    files = {}
    for path in A.folder_files(args.dir):
        with open(path, "rb") as f:
            files[A.base(path)] = f.read()
    if not files:
        print(f"pack: no documents in {args.dir}", file=log)
        return FAILED
    if args.out.endswith(".zip"):
        A.pack_zip(files, args.out, args.member_prefix)
    else:
        A.pack_tar_zst({args.member_prefix + n: d for n, d in files.items()}, args.out)
    return OK


def transform(args: argparse.Namespace, log=sys.stderr) -> int:
    from filingspark.operators.transform import accounts_wide, write_wide
    from filingspark.sources.tables import read_facts

    write_wide(accounts_wide(read_facts(session(), args.facts)), args.output)
    return OK


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="filingspark")
    p.add_argument("-V", "--version", action="version", version=VERSION)
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract", help="facts of filings as CSV")
    e.add_argument("-o", "--output")
    e.add_argument("-workers", "--workers", type=int)
    e.add_argument("--continue-on-error", action="store_true")
    e.add_argument("input", help="file, folder, archive, URL, or - for standard input")
    t = sub.add_parser("taxonomy", help="concept lookup from schema archives")
    t.add_argument("-o", "--output", default=".")
    t.add_argument("-c", "--cache", default=".taxonomy-cache")
    t.add_argument("-s", "--sources", required=True)
    k = sub.add_parser("pack", help="a folder's documents as .tar.zst or .zip")
    k.add_argument("-dir", "--dir", required=True)
    k.add_argument("-out", "--out", required=True)
    k.add_argument("-member-prefix", "--member-prefix", default="")
    w = sub.add_parser("transform", help="wide Parquet from facts CSV")
    w.add_argument("-o", "--output", required=True)
    w.add_argument("facts")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return {"extract": extract, "taxonomy": taxonomy, "pack": pack, "transform": transform}[args.command](args)


if __name__ == "__main__":
    sys.exit(main())

"""Command line: export, schema, validate.

Exit codes: 2 usage, 3 input or output, 4 a damaged snapshot, 5 a failed validation, 1 anything else.
"""

from __future__ import annotations

import argparse
import os
import re
import shutil
import sys
import uuid
from contextlib import contextmanager

from .api import SnapshotIOError, SnapshotUnreadableError, SnapshotValueError
from .codec.names import DEFAULT_CHUNK
from .functions.schemas import TYPES, describe, parse_heuristics, parse_types
from .operators.tables import PART_BYTES
from .runtime import shared_dir
from .sources import sinks
from .sources.parquetblocks import open_fs

USAGE, IO, CORRUPT, VALIDATION, OTHER = 2, 3, 4, 5, 1


def positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be 1 or more")
    return n


def byte_size(text: str) -> int:
    """A number of bytes with gb, mb, kb or b behind it, in any case; steps of 1024."""
    m = re.fullmatch(r"\s*([0-9]+)\s*(gb|mb|kb|b)?\s*", text.lower())
    if not m:
        raise argparse.ArgumentTypeError(f"no size: {text!r}")
    n = int(m[1]) << {"gb": 30, "mb": 20, "kb": 10}.get(m[2], 0)
    if not 0 < n < 2**63:
        raise argparse.ArgumentTypeError("out of range")
    return n


def checked(parse):
    def check(text: str):
        try:
            parse(text)
        except ValueError as e:
            raise argparse.ArgumentTypeError(str(e)) from None
        return text

    return check


def shard_name(text: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_-]+", text):
        raise argparse.ArgumentTypeError("only letters, digits, _ and -")
    return text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="keyquarry")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("export", help="write a snapshot's tables")
    e.add_argument("file", help="a snapshot, a folder or glob of them, or - for standard input")
    e.add_argument("-o", "--output")
    e.add_argument("-f", "--format", choices=list(sinks.EXTENSIONS), default="parquet")
    e.add_argument("--compression", type=checked(sinks.parse_compression), default="zstd")
    e.add_argument("--db", type=int)
    e.add_argument("--type", dest="types", type=checked(parse_types))
    e.add_argument("--key-pattern")
    e.add_argument("--batch-size", type=positive)
    e.add_argument("--row-group-size", type=positive, help="rows of a Parquet row group")
    e.add_argument("--part-bytes", type=byte_size, default=PART_BYTES, help="larger snapshots are read in parts of so many bytes")
    e.add_argument("--shard-id", type=shard_name)
    chunks = e.add_mutually_exclusive_group()
    chunks.add_argument("--max-key-elements", type=positive, default=DEFAULT_CHUNK)
    chunks.add_argument("--no-chunking", action="store_true")
    e.add_argument("--batch-bytes", type=byte_size)
    e.add_argument("--max-entry-bytes", type=byte_size)
    e.add_argument("--heuristic", type=checked(parse_heuristics), default="all")
    s = sub.add_parser("schema", help="print the tables' columns")
    s.add_argument("--type", choices=TYPES)
    s.add_argument("--output", choices=("text", "json"), default="text")
    v = sub.add_parser("validate", help="compare an export with its snapshot")
    v.add_argument("file")
    v.add_argument("output")
    return p


@contextmanager
def spooled(spark, file: str):
    """The file, or standard input as one in the shared folder, as executors can't read it otherwise; deleted after use."""
    if file != "-":
        yield file
        return
    filesystem, folder = open_fs(shared_dir(spark))
    path = f"{folder}/stdin-{uuid.uuid4().hex}.rdb"
    filesystem.create_dir(folder, recursive=True)
    try:
        with filesystem.open_output_stream(path) as f:
            shutil.copyfileobj(sys.stdin.buffer, f)
        yield f"{shared_dir(spark)}/{path.rpartition('/')[2]}"
    finally:
        if filesystem.get_file_info(path).type.name == "File":
            filesystem.delete_file(path)


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("keyquarry").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def run_export(a) -> int:
    from . import api

    out = a.output or ("rdb_export" if a.file == "-" else os.path.splitext(os.path.basename(a.file.rstrip("/")))[0] or "rdb_export")
    old = sinks.existing(out, a.format)
    if old:
        print(f"warning: {out} already holds {', '.join(old)}", file=sys.stderr)
    spark = session()
    with spooled(spark, a.file) as file:
        written = api.export(
            spark, file, out if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", out) else os.path.abspath(out), a.format, compression=a.compression, row_group_size=a.row_group_size, heuristic=a.heuristic,
            max_entry_bytes=a.max_entry_bytes, db=a.db, types=a.types, key_pattern=a.key_pattern, shard=a.shard_id, max_key_elements=a.max_key_elements, chunking=not a.no_chunking,
            batch_rows=a.batch_size, batch_bytes=a.batch_bytes, part_bytes=a.part_bytes,
        )
    for kind, rows in written.items():
        print(f"{kind}: {rows:,} rows", file=sys.stderr)
    for why, n in written.skipped.items():
        if n:
            print(f"warning: {n:,} values skipped: {why.replace('_', ' ')}", file=sys.stderr)
    return 0


def run_validate(a) -> int:
    from . import api
    from .operators.tables import read_info

    spark = session()
    with api.told():
        head = read_info(spark, a.file).orderBy("file").collect()
    for h in head:
        print(f"{h['file']} ({h['magic']} {h['version']}), checksum {'verified' if h['crc_checked'] else 'not available'}", file=sys.stderr)
    rows = api.validate(spark, a.file, a.output)
    show = lambda n: "-" if n is None else f"{n:,}"
    print(f"{'type':<12} {'keys':>12} {'rows':>14} {'exported':>14}  status", file=sys.stderr)
    for r in rows:
        print(f"{r['type']:<12} {show(r['keys']):>12} {show(r['rdb_rows']):>14} {show(r['parquet_rows']):>14}  {r['status']}", file=sys.stderr)
    bad = sum(r["status"] != "ok" for r in rows)
    print(f"{'FAIL' if bad else 'PASS'} ({len(rows) - bad}/{len(rows)})", file=sys.stderr)
    return VALIDATION if bad else 0


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        if a.command == "schema":
            print(describe([a.type] if a.type else None, a.output))
            return 0
        return run_export(a) if a.command == "export" else run_validate(a)
    except (SnapshotValueError, SnapshotIOError) as e:
        print(f"error: {e}", file=sys.stderr)
        return IO if isinstance(e, SnapshotUnreadableError) else CORRUPT  # a file that ends early is a damaged one
    except OSError as e:
        print(f"error: {e}", file=sys.stderr)
        return IO
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return USAGE
    except Exception as e:  # noqa: BLE001
        print(f"error: {e}", file=sys.stderr)
        return OTHER


if __name__ == "__main__":
    sys.exit(main())

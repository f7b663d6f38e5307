"""Commands: ``python -m tempolog COMMAND ...``.  Exit codes: 0, 1 for errors, 2 for bad arguments, 3 with warnings."""

from __future__ import annotations

import argparse
import sys

from .functions import text
from .model import LogError
from .operators.select import bound_nanos


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tempolog")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str, times: bool = False, topics: bool = False, out: bool = False):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        if times:
            for side in ("start", "end"):
                c.add_argument(f"--{side}")
                c.add_argument(f"--{side}-nsecs", type=int)
                c.add_argument(f"--{side}-secs", type=int)
        if topics:
            c.add_argument("-y", "--include-topic-regex", action="append", default=[])
            c.add_argument("-n", "--exclude-topic-regex", action="append", default=[])
        if out:
            c.add_argument("-o", "--output", required=True)
            c.add_argument("--compression", default="zstd", choices=["zstd", "lz4", "none"])
            c.add_argument("--chunk-size", type=int, default=1 << 20)
            if name in ("filter", "sort", "compress", "decompress", "merge"):
                c.add_argument("--exclude-metadata", action="store_true")
                c.add_argument("--exclude-attachments", action="store_true")
        return c

    c = command("cat", times=True)
    c.add_argument("files", nargs="+")
    c.add_argument("--topics", default="")
    c.add_argument("--format", default="text", choices=["text", "ndjson", "csv"])
    c = command("filter", "file", times=True, topics=True, out=True)
    c.add_argument("-l", "--last-per-channel-topic-regex", action="append", default=[])
    c.add_argument("--order", default="log_time", choices=["log_time", "topic"])
    c = command("sort", "file", out=True)
    c.add_argument("--order", default="log_time", choices=["log_time", "topic"])
    for name in ("compress", "decompress", "convert", "recover"):
        command(name, "file", out=True)
    c = command("merge", out=True)
    c.add_argument("files", nargs="+")
    c.add_argument("--coalesce-channels", default="auto", choices=["auto", "force", "none"])
    c.add_argument("--allow-duplicate-metadata", action="store_true")
    command("completion").add_argument("shell", choices=["bash", "zsh", "fish"])
    command("doctor", "file").add_argument("--strict-message-order", action="store_true")
    command("info", "file")
    command("validate", "file")
    command("du", "file").add_argument("--approximate", action="store_true")
    c = command("list")
    c.add_argument("what", choices=["channels", "schemas", "chunks", "attachments", "metadata"])
    c.add_argument("file")
    c = command("get")
    c.add_argument("what", choices=["attachment", "metadata"])
    c.add_argument("file")
    c.add_argument("--name", required=True)
    c.add_argument("--offset", type=int)
    c = command("add")
    c.add_argument("what", choices=["attachment", "metadata"])
    c.add_argument("file")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--name")
    c.add_argument("--attachment-file")
    c.add_argument("--content-type", default="application/octet-stream")
    c.add_argument("--log-time", type=int, default=0)
    c.add_argument("--creation-time", type=int, default=0)
    c.add_argument("--key", action="append", default=[], help="key=value")
    return p


def completion(shell: str) -> str:
    """A script that completes commands and their options; made from the parser."""
    subs = next(a for a in parser()._actions if isinstance(a, argparse._SubParsersAction)).choices
    options = {name: [o for a in p._actions for o in a.option_strings if o.startswith("--")] for name, p in subs.items()}
    if shell == "fish":
        lines = [f"complete -c tempolog -n __fish_use_subcommand -a {name}" for name in subs]
        return "\n".join(lines + [f"complete -c tempolog -n '__fish_seen_subcommand_from {name}' -l {o[2:]}" for name, os_ in options.items() for o in os_])
    cases = "\n".join(f'    {name}) COMPREPLY=($(compgen -f -W "{" ".join(os_)}" -- "$cur"));;' for name, os_ in options.items())
    first = "autoload -U +X bashcompinit && bashcompinit\n" if shell == "zsh" else ""
    return f"""{first}_tempolog() {{
  local cur="${{COMP_WORDS[COMP_CWORD]}}"
  if [ "$COMP_CWORD" = 1 ]; then COMPREPLY=($(compgen -W "{" ".join(subs)}" -- "$cur")); return; fi
  case "${{COMP_WORDS[1]}}" in
{cases}
  esac
}}
complete -F _tempolog tempolog"""


def _show(df, out) -> None:
    rows = df.toLocalIterator()  # row by row: never the whole result on the driver
    if len(df.columns) == 1 and df.columns[0] == "value":
        for r in rows:
            print(r.value, file=out)
        return
    print("\t".join(df.columns), file=out)
    for r in rows:
        print("\t".join("" if v is None else str(v) for v in r), file=out)


def run(args: argparse.Namespace, engine, out=sys.stdout) -> int:
    """One parsed command on an engine; returns the exit code."""
    a, warnings = args, []
    bounds = {}
    if hasattr(a, "start"):
        bounds = {s: bound_nanos(getattr(a, s), getattr(a, f"{s}_nsecs"), getattr(a, f"{s}_secs")) for s in ("start", "end")}
    write = {"compression": a.compression, "chunkSize": a.chunk_size} if hasattr(a, "chunk_size") else {}
    if hasattr(a, "exclude_metadata"):
        write |= {"include_metadata": not a.exclude_metadata, "include_attachments": not a.exclude_attachments}
    if a.command == "completion":
        print(completion(a.shell), file=out)
    elif a.command == "cat":
        got = engine.cat(",".join(a.files), a.format, topics=a.topics.split(",") if a.topics else None, **bounds)
        _show(got.df, out)
        warnings = got.warnings
    elif a.command == "filter":
        engine.filter(a.file, a.output, a.include_topic_regex, a.exclude_topic_regex, a.last_per_channel_topic_regex, order_by=a.order, **bounds, **write)
    elif a.command == "sort":
        engine.filter(a.file, a.output, order_by=a.order, **write)
    elif a.command in ("compress", "decompress"):
        engine.filter(a.file, a.output, **write | ({"compression": "none"} if a.command == "decompress" else {}))
    elif a.command == "convert":
        engine.convert(a.file, a.output, **write)
    elif a.command == "recover":
        got = engine.recover(a.file, a.output, **write)
        _show(got.df.where("recovered > 0 or discarded > 0 or truncated"), out)
        warnings = got.warnings
    elif a.command == "merge":
        engine.merge(a.files, a.output, a.coalesce_channels, a.allow_duplicate_metadata, **write)
    elif a.command == "doctor":
        got = engine.doctor(a.file, a.strict_message_order)
        _show(got.df, out)
        return 1 if got.df.where("severity = 'error'").head(1) else 0
    elif a.command == "validate":
        warnings = engine.validate(a.file).warnings
    elif a.command in ("info", "du"):
        for name, df in (engine.info(a.file) if a.command == "info" else engine.du(a.file, a.approximate)).items():
            print(f"# {name}", file=out)
            _show(df, out)
    elif a.command == "list":
        _show(engine.listed(a.file, a.what), out)
    elif a.command == "get":
        if a.what == "metadata":
            _show(engine.metadata(a.file, a.name).selectExpr("to_json(metadata) as value"), out)
        else:
            for r in engine.attachment(a.file, a.name, a.offset).toLocalIterator():
                getattr(out, "buffer", sys.stdout.buffer).write(bytes(r.data))
    elif a.command == "add":
        if a.what == "metadata":
            engine.add(a.file, a.output, metadata=(a.name, dict(k.split("=", 1) for k in a.key)))
        else:
            with open(a.attachment_file, "rb") as f:
                engine.add(a.file, a.output, attachment={"name": a.name or a.attachment_file, "media_type": a.content_type, "log_time": a.log_time, "create_time": a.creation_time, "data": f.read()})
    for w in warnings:
        print(f"warning: {text.table([[w]])}", file=sys.stderr)
    return 3 if warnings else 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from .engine import Engine

    spark = SparkSession.builder.appName("tempolog").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        return run(args, Engine(spark))
    except (LogError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

"""Command line: ``python -m quillpack compile PATH... [-o OUT]`` and ``python -m quillpack schema PATH... [-o OUT]``.

OUT is one file if its name has an ending, otherwise a folder of part files, which is what many texts are for.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import SCOPE_MODES, Settings
from .functions import text as X
from .operators import finish
from .operators.schemas import schema_texts, unreadable
from .plans.compile import compile_lines, concatenated
from .sources.files import ENDINGS, read_markdown, read_schemas, write_one, write_texts

#: Warnings that are spelt out; the others are only counted.
SPELT_OUT = 100


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillpack")
    modes = top.add_subparsers(dest="what", required=True)
    for name in ("compile", "schema"):
        one = modes.add_parser(name)
        one.add_argument("inputs", nargs="+")
        one.add_argument("-o", "--output", help="file (a name with an ending) or folder for the result; standard output if there is none")
        one.add_argument("--config", help="settings file")
        if name == "compile":
            one.add_argument("-c", "--compression", type=int, choices=(0, 1, 2))
            one.add_argument("--scope-mode", choices=SCOPE_MODES)
            one.add_argument("--keep-urls", action="store_true")
            one.add_argument("--sentence-split", action="store_true")
            one.add_argument("--anchor-every", type=int)
            one.add_argument("--endings", nargs="+", default=list(ENDINGS), help="endings of the files that are read from folders")
            one.add_argument("--separate", action="store_true", help="each file by itself instead of all as one text")
    return top


def warn(what: str, where: list[str]) -> None:
    for x in where[:SPELT_OUT]:
        print(f"warning: {x} {what}" if what.startswith("isn't") else f"warning: this {what}: {x}", file=sys.stderr)
    if len(where) > SPELT_OUT:
        print(f"warning: there are more than these {SPELT_OUT}", file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    given = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("quillpack").getOrCreate()
    settings = Settings.load(given.config)
    if given.what == "schema":
        found = read_schemas(spark, *given.inputs)
        result = schema_texts(found, settings).persist()
        warn("isn't JSON", [r.schema_id for r in unreadable(found).take(SPELT_OUT + 1)])
    else:
        settings = settings.override(given.compression, given.scope_mode, given.keep_urls, given.sentence_split, given.anchor_every)
        files = read_markdown(spark, *given.inputs, endings=tuple(given.endings))
        if files.isEmpty():
            print("error: no input files found", file=sys.stderr)
            return 1
        docs = files if given.separate else concatenated(files.withColumnRenamed("doc_id", "path"))
        # Compiled once: the lines serve the check, the result and its counts.
        lines = compile_lines(docs, settings).persist()
        result = finish.texts(lines)
        early = finish.violations(lines).join(lines, ["doc_id", "line_no"]).orderBy("doc_id", "line_no")
        warn("stands before any scope", [f"line {r.line_no + 1} of {r.doc_id}: {r.line}" for r in early.take(SPELT_OUT + 1)])
    if given.output:
        (write_one if "." in given.output.rpartition("/")[2] else write_texts)(result, given.output)
        n, tokens = result.agg(F.count(F.lit(1)), F.sum(X.token_count(F.col("compiled")))).first()
        print(f"{n} text(s) -> {given.output} (about {tokens or 0} tokens)", file=sys.stderr)
    else:
        for row in result.select("compiled").toLocalIterator():
            sys.stdout.write(row.compiled)
    return 0


if __name__ == "__main__":
    sys.exit(main())

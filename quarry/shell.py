"""A SQL shell: python -m quarry.shell [STORE] [SQL]. Reads statements from the arguments, a pipe or the terminal."""

from __future__ import annotations

import sys
from typing import TextIO

from quarry.errors import QuarryError
from quarry.session import Engine
from quarry.sources.csv_files import import_csv
from quarry.sources.render import MODES
from quarry.sql.lexer import statements, tokens

HELP = """.tables               names of all tables
.schema               their CREATE statements
.mode table|csv|json|line
.import FILE TABLE    append a CSV file with a header
.help
.exit"""


class Shell:
    def __init__(self, engine: Engine, out: TextIO = sys.stdout):
        self.engine, self.out, self.mode = engine, out, "table"

    def say(self, text: str) -> None:
        print(text, file=self.out)

    def run(self, sql: str) -> None:
        for s in statements(sql):
            head = s.lstrip().split(None, 1)[0].lower()
            if head in ("select", "with", "values", "pragma", "explain") or head.startswith("("):
                df = self.engine.sql(s)
                if df.columns and not (head == "pragma" and "=" in s):
                    for line in MODES[self.mode](df.columns, df.toLocalIterator()):
                        self.say(line)
            else:
                self.engine.execute(s)

    def command(self, line: str) -> bool:
        """A dot command; False ends the shell."""
        word, *args = line.split()
        if word in (".exit", ".quit"):
            return False
        if word == ".tables":
            self.say("\n".join(self.engine.table_names()))
        elif word == ".schema":
            self.say("\n".join(f"{s};" for s in self.engine.schema()))
        elif word == ".mode" and args and args[0] in MODES:
            self.mode = args[0]
        elif word == ".import" and len(args) == 2:
            self.say(f"{import_csv(self.engine, *args)} rows")
        else:
            self.say(HELP)
        return True

    def feed(self, lines, prompt: bool = False) -> None:
        """Runs lines; a statement ends at a line that closes it with a semicolon."""
        buffer = ""
        for line in lines:
            try:
                if not buffer and line.strip().startswith("."):
                    if not self.command(line.strip()):
                        return
                else:
                    buffer += line if line.endswith("\n") else line + "\n"
                    if buffer.rstrip().endswith(";") and tokens(buffer)[-2].text == ";":
                        text, buffer = buffer, ""
                        self.run(text)
            except QuarryError as e:
                buffer = ""
                self.say(f"Error: {e}")
            if prompt:
                print("   ...> " if buffer else "quarry> ", end="", flush=True)
        if buffer.strip():
            self.run(buffer)


def main() -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    shell = Shell(Engine(spark, sys.argv[1] if len(sys.argv) > 1 and sys.argv[1] != ":memory:" else None))
    if len(sys.argv) > 2:
        shell.run(" ".join(sys.argv[2:]))
    else:
        if sys.stdin.isatty():
            print("quarry> ", end="", flush=True)
        shell.feed(sys.stdin, prompt=sys.stdin.isatty())


if __name__ == "__main__":
    main()

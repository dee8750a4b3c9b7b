"""Interactive shell.  Statements end with a semicolon outside of strings and comments; several may share a line.

Lines that begin with a dot are commands: .tables, .schema [name], .help, .exit and .quit.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterable

from tessera.database import Database, Result
from tessera.plans.lexer import cut_script

GREETING = "tessera on {where}; statements end with ; and .help lists the commands"
PROMPT, MORE = "sql> ", "  -> "


def cell(value) -> str:
    return "NULL" if value is None else repr(value) if isinstance(value, float) else str(value)


def text_table(columns: list[str], rows: list[list]) -> str:
    """Columns padded to their widest cell; the layout is a fixed value."""
    grid = [list(columns), *([cell(x) for x in row] for row in rows)]
    width = [max(len(line[k]) for line in grid) for k in range(len(columns))]
    drawn = [" | ".join(f"{x:<{w}}" for x, w in zip(line, width)) for line in grid]
    return "\n".join([drawn[0], "-+-".join("-" * w for w in width), *drawn[1:]])


def described(result: Result, seconds: float) -> str:
    """What the shell says of a result."""
    took = f"{1000 * seconds:.1f} ms"
    if result.kind not in ("select", "explain"):
        return f"{result.message} [{took}]"
    many = f"{len(result.rows)} {'row' if len(result.rows) == 1 else 'rows'} [{took}]"
    return "\n".join([text_table(result.columns, result.rows), many] if result.rows else [many])


class Shell:
    """Takes lines, says what comes of them; ``over`` once a command has ended it."""

    def __init__(self, db: Database, say: Callable[[str], None] = print):
        self.db, self.say = db, say
        self.unfinished = ""
        self.over = False
        self.commands = {".tables": self._tables, ".schema": self._schema, ".help": self._help, ".exit": self._leave, ".quit": self._leave}

    def _tables(self, *names: str) -> None:
        for table in self.db.tables():
            self.say(table)

    def _schema(self, *names: str) -> None:
        for table, v in self.db.tables().items():
            if table in (names or (table,)):
                rules = {c: " NOT NULL" for c in v.not_null} | {v.pk: " PRIMARY KEY"}
                self.say(f"CREATE TABLE {table} ({', '.join(f'{c} {kind}{rules.get(c, str())}' for c, kind in v.columns)});")

    def _help(self, *names: str) -> None:
        self.say(__doc__.strip())

    def _leave(self, *names: str) -> None:
        self.over = True

    def take(self, line: str) -> None:
        words = line.split()
        if not self.unfinished and words and words[0].startswith("."):
            known = self.commands.get(words[0].lower())
            known(*words[1:]) if known else self.say(f"no command {words[0]}; there are {' '.join(self.commands)}")
            return
        done, self.unfinished = cut_script(f"{self.unfinished}{line}\n")
        for statement in done:
            self._run(statement)

    def _run(self, statement: str) -> None:
        began = time.perf_counter()
        try:
            result = self.db.execute(statement)
        except Exception as e:  # a shell outlives its statements
            self.say(f"! {type(e).__name__}: {e}")
        else:
            self.say(described(result, time.perf_counter() - began))

    def session(self, lines: Iterable[str]) -> None:
        for line in lines:
            self.take(line)
            if self.over:
                return


def typed(shell: Shell) -> Iterable[str]:
    """Lines from the terminal until its end."""
    while True:
        try:
            yield input(MORE if shell.unfinished else PROMPT)
        except EOFError:
            return


def main(argv: list[str] | None = None) -> int:
    args = sys.argv[1:] if argv is None else argv
    with Database(*args[:1]) as db:
        print(GREETING.format(where="a temporary database" if db.temporary else db.path))
        shell = Shell(db)
        shell.session(typed(shell))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

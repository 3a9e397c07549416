"""Source files that do not parse.

The extension of a file names its language.  Each language has a lexer of its lines and cards, which
finds unterminated literals, text outside its columns, broken continuations and merge-conflict markers,
and a pushdown stack over the tokens, which finds unbalanced delimiters and scopes, statements without
their words and premature ends: scopes and parentheses in COBOL; parentheses and literals over all lines
of a statement, IF, PROC and CNTL scopes and in-stream data in JCL; in SQL, embedded or not, recursive
descent over expressions, queries, changes, tables, triggers and blocks, while the options of rarer
statements are judged by their delimiters and terminators alone.  Only syntax counts, not whether names
are declared.

Files are checked one by one where they are read, in Arrow batches; nothing is shuffled but the counts
of ``rates``.  Work is in proportion to the text.

Defined cases: a file of another extension or without a name is no case; a null text is no case; an
empty or blank text is broken (it lacks the beginning its language asks for); any letter case and any
line ends; a missing last line end is no fault; SQL nested deeper than some 150 levels counts as broken; texts are checked whole; repeated rows are reported
once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Extensions and the languages they announce.
LANGUAGES = {"cbl": "cobol", "cob": "cobol", "cpy": "copybook", "copy": "copybook", "jcl": "jcl", "ddl": "ddl", "sql": "ddl", "bms": "bms", "map": "bms"}


class Broken(Exception):
    """Why a text does not parse."""


_MARKER = re.compile(r"(?:<{7}|>{7}|\|{7})(?: |$)|={7}$")


def _lines(text: str) -> list[str]:
    lines = re.split(r"\r\n|\n|\r", text)
    for n, line in enumerate(lines, 1):
        if _MARKER.match(line.rstrip()):
            raise Broken(f"merge conflict in line {n}")
    return lines


# ---------------------------------------------------------------- SQL

_SQL_TOKEN = re.compile(
    r"\s+|--[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/|(?P<literal>(?:[XGN]|BX|GX|UX)?'(?:[^']|'')*')|(?P<quoted>\"[^\"\n]+\")|(?P<number>\d+(?:\.\d+)?(?:E[+-]?\d+)?(?!\w))|(?P<word>[A-Za-z@#$_][\w@#$]*)|(?P<mark><=|>=|<>|!=|\|\||[(),.;=<>+*/:%?-])", re.I
)
#: Words that end an expression or a list, and so name nothing.
_RESERVED = set(
    "SELECT FROM WHERE AND OR NOT ON GROUP ORDER HAVING UNION EXCEPT INTERSECT INTO VALUES SET THEN ELSE ELSEIF END WHEN IN LIKE BETWEEN IS AS JOIN INNER LEFT RIGHT FULL CROSS BY FETCH FOR WITH USING CASE CREATE ALTER DROP INSERT UPDATE DELETE DO OPTIMIZE QUERYNO".split()
)
_UNITS = {u + s for u in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND", "MICROSECOND") for s in ("", "S")}
_COMPARED = {"=", "<", ">", "<=", ">=", "<>", "!="}
_TYPES = set("BIGINT INTEGER INT SMALLINT DATE TIME TIMESTAMP REAL DOUBLE FLOAT DECFLOAT DECIMAL NUMERIC DEC CHAR CHARACTER VARCHAR GRAPHIC VARGRAPHIC CLOB BLOB DBCLOB BINARY VARBINARY XML ROWID BOOLEAN LONG NCHAR NVARCHAR".split())
_OBJECTS = set("TABLE VIEW INDEX TRIGGER PROCEDURE FUNCTION TABLESPACE DATABASE STOGROUP SEQUENCE ALIAS SYNONYM TYPE SCHEMA ROLE VARIABLE MASK PERMISSION COLUMN CONSTRAINT PACKAGE BUFFERPOOL AUXILIARY GLOBAL UNIQUE LOB LARGE DISTINCT TRUSTED PUBLIC NICKNAME SERVER WRAPPER EVENT WORKLOAD".split())
#: First words of statements that are judged by their delimiters alone.
_LOOSE = set(
    "GRANT REVOKE COMMENT LABEL COMMIT ROLLBACK SAVEPOINT RELEASE LOCK CONNECT DECLARE RENAME EXPLAIN TRUNCATE MERGE SET CALL REFRESH EXCHANGE TRANSFER SIGNAL RESIGNAL GET RETURN OPEN CLOSE FETCH LEAVE ITERATE GOTO ALLOCATE ASSOCIATE PREPARE EXECUTE DESCRIBE WHENEVER INCLUDE DISCONNECT FREE HOLD USE TERMINATE".split()
)
#: Words that begin a statement of their own: where one stands among the options of another, a terminator is missing.
_STARTS = set("CREATE ALTER DROP INSERT GRANT REVOKE COMMENT COMMIT SELECT TRUNCATE MERGE".split())


class _Sql:
    """Statements by recursive descent over tokens (kind, word, line)."""

    def __init__(self, tokens: list[tuple[str, str, int]], hosts: bool = False):
        self.tokens, self.at, self.hosts = tokens, 0, hosts

    def word(self, ahead: int = 0) -> str:
        k = self.at + ahead
        return self.tokens[k][1] if k < len(self.tokens) and self.tokens[k][0] in ("word", "mark") else ""

    def kind(self, ahead: int = 0) -> str:
        k = self.at + ahead
        return self.tokens[k][0] if k < len(self.tokens) else ""

    def fail(self) -> None:
        if self.at >= len(self.tokens):
            raise Broken("ends within a statement")
        raise Broken(f"SQL near {self.tokens[self.at][1][:20]!r} in line {self.tokens[self.at][2]}")

    def take(self, *words: str) -> bool:
        """Go over these words if they are next."""
        if all(self.word(k) == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        for w in words:
            if not self.take(w):
                self.fail()

    def one_of(self, *words: str) -> str:
        w = self.word()
        if w not in words:
            self.fail()
        self.at += 1
        return w

    def named(self) -> bool:
        return self.kind() == "quoted" or (self.kind() == "word" and self.word() not in _RESERVED)

    def name(self) -> None:
        """A name with its qualifiers."""
        if not self.named():
            self.fail()
        self.at += 1
        while self.word() == "." and self.kind(1) in ("word", "quoted"):
            self.at += 2

    def several(self, one) -> None:
        one()
        while self.take(","):
            one()

    def listed(self, one) -> None:
        self.need("(")
        self.several(one)
        self.need(")")

    def loose(self, stop: set[str], banned: set[str] = _STARTS) -> None:
        """Tokens up to a word of ``stop`` or the end, parentheses balanced, no word of ``banned`` outside them."""
        depth = 0
        while self.at < len(self.tokens) and (depth or self.word() not in stop):
            if self.word() == ";" or (self.word() in banned and not depth and self.word(-1) not in ("FOR", "ON", ",")):
                self.fail()
            depth += (self.word() == "(") - (self.word() == ")")
            if depth < 0:
                self.fail()
            self.at += 1
        if depth:
            self.fail()

    # -- expressions

    def condition(self) -> None:
        self.both()
        while self.take("OR"):
            self.both()

    def both(self) -> None:
        self.predicate()
        while self.take("AND"):
            self.predicate()

    def predicate(self) -> None:
        while self.take("NOT"):
            pass
        if self.take("EXISTS"):
            self.need("(")
            self.query()
            self.need(")")
            return
        self.sum()
        if self.word() in _COMPARED:
            self.at += 1
            if self.word() in ("ANY", "ALL", "SOME") and self.word(1) == "(":
                self.at += 1
            self.sum()
        elif self.take("IS"):
            self.take("NOT")
            if self.take("DISTINCT"):
                self.need("FROM")
                self.sum()
            else:
                self.need("NULL")
        else:
            negated = self.take("NOT")
            if self.take("IN"):
                self.sum()
            elif self.take("BETWEEN"):
                self.sum()
                self.need("AND")
                self.sum()
            elif self.take("LIKE"):
                self.sum()
                if self.take("ESCAPE"):
                    self.sum()
            elif negated:
                self.fail()

    def sum(self) -> None:
        self.factor()
        while True:
            if self.word() in ("+", "-", "*", "/", "%", "||", "CONCAT"):
                self.at += 1
                self.factor()
            elif self.kind() == "number" and self.tokens[self.at][1][0] in "+-":  # a sign read with its number
                self.factor()
            else:
                return

    def factor(self) -> None:
        while self.word() in ("+", "-"):
            self.at += 1
        self.primary()
        if self.word() in _UNITS:
            self.at += 1

    def host(self) -> None:
        self.need(":")
        self.name()
        if self.word() == ":" or self.take("INDICATOR"):
            self.need(":")
            self.name()

    def primary(self) -> None:
        if self.kind() in ("literal", "number") or self.word() in ("NULL", "?"):
            self.at += 1
        elif self.word() == ":":
            self.host()
        elif self.take("CASE"):
            if self.word() != "WHEN":
                self.sum()
            if self.word() != "WHEN":
                self.fail()
            while self.take("WHEN"):
                self.condition()
                self.need("THEN")
                self.condition()
            if self.take("ELSE"):
                self.condition()
            self.need("END")
        elif self.word() in ("CAST", "XMLCAST") and self.word(1) == "(":
            self.at += 2
            self.condition()
            self.need("AS")
            self.type()
            self.need(")")
        elif self.take("("):
            if self.word() in ("SELECT", "WITH", "VALUES"):
                self.query()
            else:
                self.several(self.condition)
            self.need(")")
        elif self.word() in ("CURRENT", "SESSION") and self.kind(1) == "word" and self.word(1) not in _RESERVED:
            self.at += 2
            if self.word() in ("ZONE", "SQLID", "USER"):
                self.at += 1
        elif self.word() in ("LEFT", "RIGHT", "INSERT", "VALUES") and self.word(1) == "(":
            self.at += 1
            self.listed(self.condition)
        elif self.word() in ("NEXT", "PREVIOUS") and self.word(1) in ("VALUE", "VAL") and self.word(2) == "FOR":
            self.at += 3
            self.name()
        else:
            self.name()
            if self.take("("):
                self.arguments()
                if self.take("OVER"):
                    self.need("(")
                    self.loose({")"}, set())
                    self.need(")")

    def arguments(self) -> None:
        if self.take(")"):
            return
        if self.word() in ("DISTINCT", "ALL"):
            self.at += 1
        if self.take("*"):
            self.need(")")
        elif self.word() in ("SELECT", "WITH"):
            self.query()
            self.need(")")
        else:
            self.several(self.condition)
            self.loose({")"}, set())  # keywords between arguments, as of TRIM or XMLTABLE
            self.need(")")

    def type(self) -> None:
        if self.word() in _TYPES:
            self.at += 1
            if self.word() in ("VARYING", "PRECISION", "LARGE"):
                self.at += 1 + (self.word() == "LARGE")
        else:
            self.name()
        if self.take("("):
            if self.kind() != "number":
                self.fail()
            self.at += 1
            if self.word() in ("K", "M", "G", "OCTETS", "CODEUNITS32"):
                self.at += 1
            if self.take(","):
                if self.kind() != "number":
                    self.fail()
                self.at += 1
            self.need(")")
        if self.word() == "FOR" and self.word(2) == "DATA":
            self.at += 3
        if self.word() in ("WITH", "WITHOUT") and self.word(1) == "TIME":
            self.at += 3

    # -- queries and changes

    def query(self) -> None:
        if self.take("WITH"):
            self.several(self.common)
        self.term()
        while self.word() in ("UNION", "EXCEPT", "INTERSECT"):
            self.at += 1
            self.take("ALL") or self.take("DISTINCT")
            self.term()
        while True:
            if self.take("ORDER", "BY"):
                self.several(self.ordered)
            elif self.take("FETCH"):
                self.one_of("FIRST", "NEXT")
                if self.kind() == "number":
                    self.at += 1
                self.one_of("ROW", "ROWS")
                self.need("ONLY")
            elif self.word() == "FOR" and self.word(1) in ("UPDATE", "READ", "FETCH"):
                self.at += 1
                if self.take("UPDATE"):
                    if self.take("OF"):
                        self.several(self.name)
                else:
                    self.at += 1
                    self.need("ONLY")
            elif self.word() == "WITH" and self.word(1) in ("UR", "CS", "RS", "RR"):
                self.at += 2
            elif self.word() in ("OPTIMIZE", "QUERYNO", "OFFSET", "LIMIT"):
                self.at += 1
                self.take("FOR")
                if self.kind() != "number":
                    self.fail()
                self.at += 1
                self.take("ROWS") or self.take("ROW")
            else:
                return

    def common(self) -> None:
        self.name()
        if self.word() == "(":
            self.listed(self.name)
        self.need("AS", "(")
        self.query()
        self.need(")")

    def ordered(self) -> None:
        self.sum()
        self.take("ASC") or self.take("DESC")
        if self.take("NULLS"):
            self.one_of("FIRST", "LAST")

    def term(self) -> None:
        if self.take("("):
            self.query()
            self.need(")")
        elif self.take("VALUES"):
            self.several(self.condition)
            if self.take("INTO"):
                self.several(self.sum)
        else:
            self.need("SELECT")
            self.take("DISTINCT") or self.take("ALL")
            self.several(self.item)
            if self.take("INTO"):
                self.several(self.host if self.hosts else self.sum)
            self.need("FROM")
            self.several(self.joined)
            if self.take("WHERE"):
                self.condition()
            if self.take("GROUP", "BY"):
                self.several(self.condition)
            if self.take("HAVING"):
                self.condition()

    def item(self) -> None:
        if self.take("*"):
            return
        if self.named() and self.word(1) == "." and self.word(2) == "*":
            self.at += 3
            return
        self.condition()
        if self.take("AS") or self.named():
            self.name()

    def alias(self) -> None:
        if self.take("AS") or self.named():
            self.name()
            if self.word() == "(":
                self.listed(self.name)

    def source(self) -> None:
        if self.word() in ("TABLE", "FINAL", "OLD", "NEW", "UNNEST", "XMLTABLE") and ("(" in (self.word(1), self.word(2))):
            while not self.take("("):
                self.at += 1
            self.loose({")"}, set())
            self.need(")")
        elif self.take("("):
            if self.word() in ("SELECT", "WITH", "VALUES", "("):
                self.query()
            else:
                self.joined()
            self.need(")")
        else:
            self.name()
        self.alias()

    def joined(self) -> None:
        self.source()
        while self.word() in ("JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS"):
            cross = self.take("CROSS")
            if not cross and self.word() != "JOIN":
                self.at += 1
                self.take("OUTER")
            self.need("JOIN")
            self.source()
            if not cross:
                self.need("ON")
                self.condition()

    def value(self) -> None:
        if not self.take("DEFAULT"):
            self.condition()

    def change(self) -> bool:
        """INSERT, UPDATE, DELETE, CALL or a query; False if it is none of them."""
        if self.take("INSERT"):
            self.need("INTO")
            self.name()
            if self.word() == "(" and self.word(1) not in ("SELECT", "WITH"):
                self.listed(self.name)
            if self.take("VALUES"):
                self.several(lambda: self.listed(self.value) if self.word() == "(" else self.value())
            else:
                self.query()
        elif self.take("UPDATE"):
            self.name()
            self.alias()
            self.need("SET")
            self.several(self.assignment)
            self.where()
        elif self.take("DELETE"):
            self.need("FROM")
            self.name()
            self.alias()
            self.where()
        elif self.take("CALL"):
            self.host() if self.word() == ":" else self.name()
            if self.take("("):
                self.arguments()
        elif self.word() in ("SELECT", "WITH", "VALUES", "("):
            self.query()
        else:
            return False
        return True

    def where(self) -> None:
        if self.take("WHERE") and not self.take("CURRENT", "OF"):
            self.condition()
        elif self.word(-1) == "OF":
            self.name()
        if self.word() == "WITH" and self.word(1) in ("UR", "CS", "RS", "RR"):
            self.at += 2

    def assignment(self) -> None:
        if self.word() == "(":
            self.listed(self.name)
        elif self.word() == ":":
            self.host()
        else:
            self.name()
        self.need("=")
        self.value()

    # -- definitions

    def script(self) -> None:
        if not self.tokens:
            raise Broken("no statement")
        while self.at < len(self.tokens):
            self.statement()
            self.need(";")

    def statement(self) -> None:
        first = self.word()
        if first == "SET" and self.word(1) != "CURRENT" and self.word(2) == "=":
            self.at += 1
            self.several(self.assignment)
        elif first == "CREATE" or first == "ALTER" or first == "DROP":
            self.definition()
        elif first == "BEGIN":
            self.block()
        elif first in _LOOSE and first != "CALL":
            self.at += 1
            if first in ("GRANT", "REVOKE"):
                self.loose({"TO", "FROM"}, {"CREATE", "DROP", "COMMENT", "COMMIT"})
                self.at += 1
                self.several(self.name)
            if first == "COMMENT":
                self.need("ON")
                self.loose({"IS"})
                self.need("IS")
            self.loose({";"}, set() if first in ("MERGE", "DECLARE", "EXPLAIN") else _STARTS)
        elif not self.change():
            self.fail()

    def definition(self) -> None:
        first = self.one_of("CREATE", "ALTER", "DROP")
        self.take("OR", "REPLACE")
        if self.word() not in _OBJECTS:
            self.fail()
        if first == "CREATE" and self.take("TABLE"):
            self.name()
            if self.take("LIKE"):
                self.name()
            elif self.take("AS"):
                self.need("(")
                self.query()
                self.need(")")
            else:
                self.listed(self.part)
            self.loose({";"})
        elif first == "CREATE" and (self.take("UNIQUE", "INDEX") or self.take("INDEX")):
            self.name()
            self.need("ON")
            self.name()
            self.listed(self.ordered)
            self.loose({";"})
        elif first == "CREATE" and self.take("VIEW"):
            self.name()
            if self.word() == "(":
                self.listed(self.name)
            self.need("AS")
            self.query()
            if self.take("WITH"):
                self.loose({"CHECK"})
                self.need("CHECK", "OPTION")
        elif first == "CREATE" and self.take("TRIGGER"):
            self.trigger()
        elif first == "CREATE" and self.word() in ("PROCEDURE", "FUNCTION"):
            self.at += 1
            self.name()
            self.loose({"BEGIN", "RETURN", ";", "SELECT", "UPDATE", "INSERT", "DELETE", "SET", "CALL"}, {"CREATE", "DROP", "ALTER", "COMMENT"})
            if self.word() not in (";", ""):
                self.block_part()
        elif first == "ALTER" and self.take("TABLE"):
            self.name()
            if self.word() not in ("ADD", "ALTER", "DROP", "RENAME", "SET", "DATA", "AUDIT", "VALIDPROC", "ACTIVATE", "PCTFREE", "ROTATE", "APPEND", "VOLATILE", "NOT", "CCSID", "ORGANIZE", "ENABLE", "DISABLE"):
                self.fail()
            while self.at < len(self.tokens) and self.word() != ";":
                if self.take("ADD"):
                    if self.word() in ("PARTITION", "VERSIONING", "CLONE", "MATERIALIZED", "RESTRICT", "PERIOD"):
                        self.loose({";", "ADD"})
                    else:
                        self.take("COLUMN")
                        self.part()
                else:
                    self.at += 1
                    self.loose({";", "ADD"}, {"CREATE", "INSERT", "GRANT", "COMMENT"})
        else:
            self.at += 1
            while self.word() in _OBJECTS:
                self.at += 1
            if not self.named():
                self.fail()
            self.loose({";"})

    def part(self) -> None:
        """A column or a constraint of a table."""
        if self.take("CONSTRAINT"):
            self.name()
        if self.word() in ("PRIMARY", "FOREIGN", "UNIQUE", "CHECK", "PERIOD"):
            self.constraint()
            return
        if self.word(-1) not in ("(", ",", "ADD", "COLUMN"):
            self.fail()
        if self.kind() not in ("word", "quoted"):
            self.fail()
        self.at += 1
        self.type()
        while True:
            if self.take("NOT"):
                self.need("NULL") if self.word() == "NULL" else self.one_of("HIDDEN", "LOGGED", "COMPACT")
            elif self.take("WITH", "DEFAULT") or self.take("DEFAULT"):
                if self.kind() in ("literal", "number") or self.word() in ("NULL", "CURRENT", "USER", "SESSION_USER", "-", "+") or (self.named() and self.word(1) == "("):
                    self.factor()
            elif self.take("NULL") or self.take("IMPLICITLY", "HIDDEN") or self.take("LOGGED") or self.take("COMPACT"):
                pass
            elif self.take("CONSTRAINT"):
                self.name()
            elif self.word() == "GENERATED" or (self.word() == "AS" and self.word(1) == "IDENTITY"):
                if self.take("GENERATED"):
                    self.take("ALWAYS") or self.need("BY", "DEFAULT")
                if self.take("AS") and not self.take("IDENTITY"):
                    if self.word() == "(":
                        self.primary()
                    else:
                        self.need("ROW")
                        self.loose({",", ")"})
                elif self.take("FOR"):
                    self.loose({",", ")"}, set())
                if self.word() == "(":
                    self.at += 1
                    self.loose({")"})
                    self.need(")")
            elif self.word() in ("PRIMARY", "UNIQUE", "CHECK", "REFERENCES"):
                self.constraint()
            elif self.word() in ("CCSID", "FIELDPROC"):
                self.at += 2
            elif self.take("INLINE", "LENGTH"):
                self.at += 1
            elif self.take("COMPRESS"):
                self.take("SYSTEM", "DEFAULT")
            else:
                return

    def constraint(self) -> None:
        if self.take("PRIMARY"):
            self.need("KEY")
            if self.word() == "(":
                self.listed(self.name)
        elif self.take("UNIQUE"):
            if self.word() == "(":
                self.listed(self.name)
        elif self.take("CHECK"):
            self.need("(")
            self.condition()
            self.need(")")
        elif self.take("PERIOD"):
            self.loose({",", ")"})
        else:
            if self.take("FOREIGN"):
                self.need("KEY")
                if self.word() != "(":
                    self.name()
                self.listed(self.name)
            self.need("REFERENCES")
            self.name()
            if self.word() == "(":
                self.listed(self.name)
            while self.take("ON"):
                self.one_of("DELETE", "UPDATE")
                self.take("SET", "NULL") or self.take("SET", "DEFAULT") or self.take("NO", "ACTION") or self.one_of("CASCADE", "RESTRICT")
        while self.word() in ("ENFORCED", "NOT") and "ENFORCED" in (self.word(), self.word(1)):
            self.at += 1

    def trigger(self) -> None:
        self.name()
        self.take("NO", "CASCADE")
        if not self.take("INSTEAD", "OF"):
            self.one_of("BEFORE", "AFTER")
        while True:
            if self.one_of("INSERT", "DELETE", "UPDATE") == "UPDATE" and self.take("OF"):
                self.several(self.name)
            if not self.take("OR"):
                break
        self.need("ON")
        self.name()
        if self.take("REFERENCING"):
            if self.word() not in ("NEW", "OLD", "NEW_TABLE", "OLD_TABLE"):
                self.fail()
            while self.word() in ("NEW", "OLD", "NEW_TABLE", "OLD_TABLE"):
                self.at += 1
                self.take("ROW") or self.take("TABLE")
                self.take("AS")
                self.name()
        if self.take("FOR"):
            self.need("EACH")
            self.one_of("ROW", "STATEMENT")
        self.take("MODE", "DB2SQL")
        self.take("NOT", "SECURED") or self.take("SECURED")
        if self.take("WHEN"):
            self.need("(")
            self.condition()
            self.need(")")
        self.block_part()

    def block(self) -> None:
        self.need("BEGIN")
        self.take("NOT")
        self.take("ATOMIC")
        self.block_parts({"END"})
        self.need("END")
        if self.named():
            self.at += 1

    def block_parts(self, stop: set[str]) -> None:
        """Statements, each with its terminator; at least one."""
        self.block_part()
        self.need(";")
        while self.at < len(self.tokens) and self.word() not in stop:
            self.block_part()
            self.need(";")

    def block_part(self) -> None:
        if self.kind() == "word" and self.word(1) == ":":
            self.at += 2
        first = self.word()
        if first == "BEGIN":
            self.block()
        elif self.take("IF"):
            self.condition()
            self.need("THEN")
            self.block_parts({"ELSE", "ELSEIF", "END"})
            while self.take("ELSEIF"):
                self.condition()
                self.need("THEN")
                self.block_parts({"ELSE", "ELSEIF", "END"})
            if self.take("ELSE"):
                self.block_parts({"END"})
            self.need("END", "IF")
        elif self.take("CASE"):
            if self.word() != "WHEN":
                self.sum()
            while self.take("WHEN"):
                self.condition()
                self.need("THEN")
                self.block_parts({"WHEN", "ELSE", "END"})
            if self.take("ELSE"):
                self.block_parts({"END"})
            self.need("END", "CASE")
        elif first in ("WHILE", "FOR", "LOOP", "REPEAT"):
            self.at += 1
            if first == "WHILE":
                self.condition()
                self.need("DO")
            elif first == "FOR":
                self.loose({"DO"}, set())
                self.need("DO")
            self.block_parts({"END", "UNTIL"})
            if first == "REPEAT":
                self.need("UNTIL")
                self.condition()
            self.need("END", first)
            if self.named():
                self.at += 1
        elif first == "SET":
            self.at += 1
            self.several(self.assignment)
        elif first in ("CREATE", "ALTER", "DROP"):
            self.definition()
        elif first in _LOOSE and first != "CALL":
            handler = first == "DECLARE" and "HANDLER" in (self.word(2), self.word(1))
            self.at += 1
            if handler:
                self.loose({"BEGIN", "SET", "INSERT", "UPDATE", "DELETE", "CALL", "SIGNAL", "RESIGNAL", "GET", "RETURN", "IF", ";"}, set())
                if self.word() != ";":
                    self.block_part()
            else:
                self.loose({";"}, {"CREATE", "COMMENT", "BEGIN"})
        elif not self.change():
            self.fail()


def ddl(text: str) -> None:
    text = "\n".join(_lines(text))
    tokens, at, line, counted = [], 0, 1, 0
    while at < len(text):
        m = _SQL_TOKEN.match(text, at)
        if not m:
            raise Broken(f"character {text[at]!r} or open literal in line {text.count(chr(10), 0, at) + 1}")
        if m.lastgroup:
            line, counted = line + text.count("\n", counted, at), at
            if m.lastgroup == "literal" and "\n" in m[0]:
                raise Broken("literal over the end of a line")
            tokens.append((m.lastgroup, m[0] if m.lastgroup in ("literal", "quoted") else m[0].upper(), line))
        at = m.end()
    _Sql(tokens).script()


# ---------------------------------------------------------------- COBOL

_COBOL_TOKEN = re.compile(
    r"\s+|(?P<literal>'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\")|(?P<pseudo>==.*?==)|(?P<number>[+-]?\d+(?:\.\d+)?(?![\w-]))"
    r"|(?P<word>[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*)|(?P<mark>\*\*|>=|<=|<>|!=|\|\||[.,;:()=<>+*/&%?-])"
)
_PICTURE = re.compile(r"[+\-]?(?:[ABEGNPSVXZ9/0,.+\-*$]|CR|DB)(?:\(\d+\))?(?:(?:[ABEGNPSVXZ9/0,.+\-*$]|CR|DB)(?:\(\d+\))?)*", re.I)
_FIGURATIVE = set("SPACE SPACES ZERO ZEROS ZEROES HIGH-VALUE HIGH-VALUES LOW-VALUE LOW-VALUES QUOTE QUOTES NULL NULLS".split())
_VERBS = set(
    "ACCEPT ADD ALTER CALL CANCEL CLOSE COMPUTE CONTINUE DELETE DISPLAY DIVIDE ENTRY EVALUATE EXEC EXIT GO GOBACK IF INITIALIZE INSPECT MERGE MOVE MULTIPLY OPEN PERFORM READ RELEASE RETURN REWRITE SEARCH SET SORT START STOP STRING SUBTRACT UNSTRING WRITE XML JSON INVOKE ALLOCATE".split()
)
_SCOPED = {"IF", "EVALUATE", "READ", "PERFORM", "STRING", "UNSTRING", "CALL", "COMPUTE", "ADD", "SUBTRACT", "MULTIPLY", "DIVIDE", "WRITE", "REWRITE", "DELETE", "START", "SEARCH", "RETURN"}
_ENDS = {f"END-{v}" for v in _SCOPED}
_CLAUSES = set(
    "TO FROM BY INTO GIVING USING WHEN ELSE THEN UNTIL VARYING THRU THROUGH TIMES AND OR NOT AT END ON SIZE ERROR DELIMITED REPLACING TALLYING ALL LEADING FIRST OTHER IS EQUAL GREATER LESS THAN REMAINDER ROUNDED CONTENT REFERENCE VALUE INPUT OUTPUT I-O EXTEND RUN SECTION DIVISION POINTER COUNT IN OF UPON WITH NO ADVANCING INVALID KEY ALSO TRUE FALSE AFTER BEFORE FOR CHARACTERS INITIAL CORRESPONDING CORR NUMERIC ALPHABETIC POSITIVE NEGATIVE OVERFLOW EXCEPTION TEST DEPENDING PARAGRAPH PROGRAM LENGTH ADDRESS FUNCTION NEXT SENTENCE RECORD RETURNING PIC PICTURE OCCURS REDEFINES COMP COMP-3 COPY PROCEDURE".split()
)
_OPERATORS = {"=", "<", ">", ">=", "<=", "<>"}

# Statements as patterns over one letter per token: I name, L literal, N number, F figurative constant, other words in < >.
_V = "[ILNF]"
_Q = r"(?:I(?:(?:<OF>|<IN>)I)*(?:\([INF:+\-*/,]+\))*)"
_X = rf"(?:(?:<LENGTH>|<ADDRESS>)<OF>{_Q}|<ALL>[LF]|{_Q}|[LNF])"
_EXPR = rf"(?:[-+]?\(*[-+]?{_X}\)*(?:[-+*/^]\(*[-+]?{_X}\)*|N\)*)*)"
_TEST = rf"(?:(?:<NOT>)?\(*{_EXPR}(?:(?:<IS>)?(?:<NOT>)?(?:[=<>]|>=|<=|<>|<EQUAL>(?:<TO>)?|<GREATER>(?:<THAN>)?|<LESS>(?:<THAN>)?){_EXPR}|(?:<IS>)?(?:<NOT>)?(?:<NUMERIC>|<ALPHABETIC>|<POSITIVE>|<NEGATIVE>|F))?\)*)"
_COND = rf"{_TEST}(?:(?:<AND>|<OR>){_TEST})*"
_TARGETS = rf"(?:{_Q}(?:<ROUNDED>)?,?)+"
_STATEMENTS = {
    "MOVE": rf"(?:<CORR>|<CORRESPONDING>)?{_X}<TO>(?:{_Q},?)+",
    "ADD": rf"(?:{_X},?)+(?:<TO>(?:{_TARGETS}|{_X}<GIVING>{_TARGETS})|<GIVING>{_TARGETS})",
    "SUBTRACT": rf"(?:{_X},?)+<FROM>(?:{_TARGETS}|{_X}<GIVING>{_TARGETS})(?:<GIVING>{_TARGETS})?",
    "MULTIPLY": rf"{_X}<BY>(?:{_TARGETS}|{_X})(?:<GIVING>{_TARGETS})?",
    "DIVIDE": rf"{_X}(?:<BY>|<INTO>)(?:{_X})(?:<ROUNDED>)?(?:<GIVING>{_TARGETS})?(?:<REMAINDER>{_Q})?",
    "COMPUTE": rf"{_TARGETS}=(?:{_EXPR})",
    "DISPLAY": rf"(?:{_X},?)+(?:<UPON>I)?(?:(?:<WITH>)?<NO><ADVANCING>)?",
    "ACCEPT": rf"{_Q}(?:<FROM>.+)?",
    "CALL": rf"[LI](?:<USING>(?:(?:(?:<BY>)?(?:<CONTENT>|<REFERENCE>|<VALUE>))?(?:{_X}),?)+)?(?:<RETURNING>{_Q})?",
    "STRING": rf"(?:(?:{_X},?)+<DELIMITED>(?:<BY>)?(?:<SIZE>|{_X}))+<INTO>{_Q}(?:(?:<WITH>)?<POINTER>{_Q})?",
    "UNSTRING": rf"{_Q}(?:<DELIMITED>(?:<BY>)?(?:<ALL>)?{_X}(?:<OR>(?:<ALL>)?{_X})*)?<INTO>(?:{_Q},?)+(?:(?:<WITH>)?<POINTER>{_Q})?(?:<TALLYING>(?:<IN>)?{_Q})?",
    "INSPECT": rf"{_Q}(?:<TALLYING>{_Q}<FOR>(?:<CHARACTERS>|(?:<ALL>|<LEADING>){_X}))?(?:<REPLACING>(?:(?:<ALL>|<LEADING>|<FIRST>){_X}<BY>{_X}|<CHARACTERS><BY>{_X})+)?",
    "WRITE": rf"{_Q}(?:<FROM>{_X})?(?:(?:<AFTER>|<BEFORE>)(?:<ADVANCING>)?{_X}I?)?",
    "REWRITE": rf"{_Q}(?:<FROM>{_X})?",
    "DELETE": r"I(?:<RECORD>)?",
    "START": rf"I(?:<KEY>(?:<IS>)?.+{_Q})?",
    "READ": rf"I(?:<NEXT>)?(?:<RECORD>)?(?:<INTO>{_Q})?(?:<KEY>(?:<IS>)?{_Q})?",
    "RETURN": rf"I(?:<RECORD>)?(?:<INTO>{_Q})?",
    "OPEN": r"(?:(?:<INPUT>|<OUTPUT>|<I-O>|<EXTEND>)(?:I,?)+)+",
    "CLOSE": r"(?:I,?)+",
    "GO": r"<TO>(?:I|(?:I,?)+<DEPENDING>(?:<ON>)?I)",
    "GOBACK": "", "CONTINUE": "", "STOP": r"<RUN>|[LN]", "EXIT": r"(?:<PROGRAM>|<PARAGRAPH>|<SECTION>|<PERFORM>)?",
    "INITIALIZE": rf"(?:{_Q},?)+", "CANCEL": r"(?:[LI],?)+", "ENTRY": rf"L(?:<USING>(?:{_Q},?)+)?",
    "SET": rf"(?:{_Q},?)+(?:<TO>(?:<TRUE>|<FALSE>|{_X})|(?:I<BY>{_X}))", "IF": rf"{_COND}(?:<THEN>)?", "EVALUATE": rf"(?:{_COND}|<TRUE>|<FALSE>)(?:<ALSO>(?:{_COND}|<TRUE>|<FALSE>))*",
    "WHEN": rf"<OTHER>|(?:<NOT>)?(?:{_COND}|<TRUE>|<FALSE>)(?:(?:<THRU>|<THROUGH>){_X})?(?:<ALSO>(?:{_COND}|<TRUE>|<FALSE>))*", "ELSE": "",
    "SEARCH": r"(?:<ALL>)?I(?:<VARYING>I)?", "SORT": ".+", "MERGE": ".+", "RELEASE": rf"I(?:<FROM>{_X})?", "ALTER": ".+", "XML": ".+", "JSON": ".+", "INVOKE": ".+", "ALLOCATE": ".+",
}
_LOOP = rf"(?:(?:<WITH>)?<TEST>(?:<BEFORE>|<AFTER>))?(?:<VARYING>{_Q}<FROM>{_X}<BY>{_X}<UNTIL>{_COND}(?:<AFTER>{_Q}<FROM>{_X}<BY>{_X}<UNTIL>{_COND})*|<UNTIL>{_COND}|{_X}<TIMES>)"
_STATEMENTS = {k: re.compile(v) for k, v in _STATEMENTS.items()}
_PERFORM_OUT = re.compile(rf"I(?:(?:<THRU>|<THROUGH>)I)?(?:{_LOOP})?")
_PERFORM_IN = re.compile(_LOOP)
_EXCEPTION = re.compile(r"(?:<NOT>)?(?:(?:<AT>)?<END>|(?:<ON>)?<SIZE><ERROR>|(?:<ON>)?<EXCEPTION>|(?:<ON>)?<OVERFLOW>|<INVALID>(?:<KEY>)?)$")


def _cobol_lines(text: str) -> list[tuple[int, str]]:
    """(line number, text from column 8) of all lines that are no comments."""
    out = []
    for n, line in enumerate(_lines(text), 1):
        line = line.expandtabs(8)
        if not line.strip():
            continue
        if line[:6].strip() and not re.match(r"\d{6}", line):
            raise Broken(f"text in columns 1 to 6 of line {n}")
        mark = line[6:7]
        if mark == "*":
            continue
        if mark not in ("", " "):
            raise Broken(f"column 7 of line {n}")
        out.append((n, line[7:]))
    return out


def _cobol_tokens(lines: list[tuple[int, str]]) -> list[tuple[str, str, int, bool]]:
    """(kind, text, line, begins in area A); pictures are one token of kind picture."""
    out: list[tuple[str, str, int, bool]] = []
    for n, line in lines:
        at = 0
        while at < len(line):
            if out and out[-1][1] in ("PIC", "PICTURE") or (len(out) > 1 and out[-1][1] == "IS" and out[-2][1] in ("PIC", "PICTURE")):
                m = re.compile(r"\s*(?:IS\s+)?(\S+)", re.I).match(line, at)
                if m:
                    picture = m[1]
                    end = m.end()
                    if picture.endswith("."):
                        picture, end = picture[:-1], end - 1
                    if not _PICTURE.fullmatch(picture):
                        raise Broken(f"picture in line {n}")
                    out.append(("picture", picture, n, False))
                    at = end
                    continue
            m = _COBOL_TOKEN.match(line, at)
            if not m:
                raise Broken(f"character {line[at]!r} or open literal in line {n}")
            if m.lastgroup:
                word = m[0] if m.lastgroup in ("literal", "pseudo") else m[0].upper()
                out.append((m.lastgroup, word, n, at < 4 and not line[:at].strip()))
            at = m.end()
    return out


_SUBSCRIPT = re.compile(r"(?<!<FUNCTION>)I\([INF:+\-*/,]+\)")
_INNER = re.compile(r"<FUNCTION>(?:I|<[A-Z0-9-]+>)(?:\([^()]*\)){0,2}")


def _functions(code: str) -> str:
    """Calls of functions become one identifier each, the innermost first."""
    before = ""
    while before != code:
        before, code = code, _INNER.sub("I", _SUBSCRIPT.sub("I", code))
    return code


def _code(tokens: list[tuple[str, str, int, bool]]) -> str:
    """Tokens of a statement, one letter or bracketed word each."""
    out = []
    for kind, word, _, _ in tokens:
        if kind == "literal":
            out.append("L")
        elif kind == "number":
            out.append("N")
        elif kind == "mark":
            out.append("^" if word == "**" else word)
        elif kind != "word":
            out.append("?")
        elif word in _FIGURATIVE:
            out.append("F")
        elif word in _CLAUSES or word in _VERBS:
            out.append(f"<{word}>")
        elif not re.search("[A-Z]", word) and "-" not in word:
            out.append("?")
        else:
            out.append("I")
    return _functions("".join(out)) if "<FUNCTION>" in out else "".join(out)


def _data_entries(tokens: list[tuple[str, str, int, bool]], at: int, stop: set[str], copies: bool) -> int:
    """Data description entries from ``at`` on, up to a word of ``stop`` at the beginning of an entry."""
    while at < len(tokens):
        kind, word, n, _ = tokens[at]
        if word in stop:
            return at
        end = at
        while end < len(tokens) and tokens[end][1] != ".":
            if end > at and tokens[end][0] == "number" and tokens[end - 1][2] != tokens[end][2] and re.fullmatch(r"\d\d?", tokens[end][1]):
                break
            end += 1
        if end == len(tokens) or tokens[end][1] != ".":
            raise Broken(f"no period after the entry of line {n}")
        entry = tokens[at + 1 : end]
        if word == "COPY" and copies:
            _copy(entry, n)
        elif kind == "number" and re.fullmatch(r"\d\d?", word) and (1 <= int(word) <= 49 or int(word) in (66, 77, 88)):
            _entry(int(word), entry, n)
        elif word in ("FD", "SD", "SELECT") and copies:
            if not entry or entry[0][0] != "word":
                raise Broken(f"name missing in line {n}")
        else:
            raise Broken(f"{word!r} where an entry begins, line {n}")
        at = end + 1
    return at


def _copy(entry: list[tuple[str, str, int, bool]], n: int) -> None:
    kinds = "".join({"word": "w", "pseudo": "p", "literal": "l"}.get(k, "x") if w not in ("REPLACING", "BY", "OF", "IN") else f"<{w}>" for k, w, _, _ in entry)
    if not re.fullmatch(r"[wl](?:(?:<OF>|<IN>)[wl])?(?:<REPLACING>(?:[pwl]<BY>[pwl])+)?", kinds):
        raise Broken(f"COPY in line {n}")


_ENTRY = re.compile(
    r"(?:n|f)?(?:<REDEFINES>n|<OCCURS>9(?:<TO>9)?(?:<TIMES>)?(?:<DEPENDING>(?:<ON>)?n)?(?:<INDEXED>(?:<BY>)?n+)?|(?:<PIC>|<PICTURE>)(?:<IS>)?p|(?:<USAGE>(?:<IS>)?)?(?:<COMP>|<COMP-1>|<COMP-2>|<COMP-3>|<COMP-4>|<COMP-5>|<BINARY>|<DISPLAY>|<PACKED-DECIMAL>|<INDEX>|<POINTER>)"
    r"|<VALUE>(?:<IS>)?v|<JUSTIFIED>(?:<RIGHT>)?|<BLANK>(?:<WHEN>)?v|<SYNC>|<EXTERNAL>|<GLOBAL>|<SIGN>(?:<IS>)?(?:<LEADING>|<TRAILING>)(?:<SEPARATE>(?:<CHARACTER>)?)?)*"
)
_ENTRY_WORDS = set("REDEFINES OCCURS TO TIMES DEPENDING ON INDEXED BY PIC PICTURE IS USAGE COMP COMP-1 COMP-2 COMP-3 COMP-4 COMP-5 BINARY DISPLAY PACKED-DECIMAL INDEX POINTER VALUE VALUES ARE JUSTIFIED RIGHT BLANK WHEN SYNC EXTERNAL GLOBAL SIGN LEADING TRAILING SEPARATE CHARACTER THRU RENAMES".split())


def _entry(level: int, entry: list[tuple[str, str, int, bool]], n: int) -> None:
    code = []
    for kind, word, _, _ in entry:
        if kind == "word" and word in _ENTRY_WORDS:
            code.append(f"<{word}>")
        elif kind == "word" and word in _FIGURATIVE or kind == "literal":
            code.append("v")
        elif kind == "number":
            code.append("9")
        elif kind == "picture":
            code.append("p")
        elif kind == "word" and re.search("[A-Z]", word):
            code.append("n")
        elif word != ",":
            code.append("?")
    text = "".join(code)
    if level == 88:
        good = re.fullmatch(r"n(?:<VALUE>|<VALUES>)(?:<IS>|<ARE>)?(?:[v9](?:<THRU>[v9])?)+", text)
    elif level == 66:
        good = re.fullmatch(r"n<RENAMES>n(?:<THRU>n)?", text)
    else:
        good = text.startswith("n") and _ENTRY.fullmatch(text.replace("<VALUE>9", "<VALUE>v").replace("<VALUE><IS>9", "<VALUE>v"))
    if not good:
        raise Broken(f"entry in line {n}")


def copybook(text: str) -> None:
    tokens = _cobol_tokens(_cobol_lines(text))
    if not tokens:
        raise Broken("nothing in it")
    if _data_entries(tokens, 0, set(), False) != len(tokens):
        raise Broken("more than entries")


def _expect(tokens: list[tuple[str, str, int, bool]], at: int, *words: str) -> int:
    for w in words:
        if at >= len(tokens):
            raise Broken(f"ends before {w}")
        if tokens[at][1] != w:
            raise Broken(f"{tokens[at][1]!r} instead of {w} in line {tokens[at][2]}")
        at += 1
    return at


def cobol(text: str) -> None:
    tokens = _cobol_tokens(_cobol_lines(text))
    at = _expect(tokens, 0, *([tokens[0][1]] if tokens and tokens[0][1] in ("IDENTIFICATION", "ID") else ["IDENTIFICATION"]), "DIVISION", ".", "PROGRAM-ID", ".")
    if at >= len(tokens) or tokens[at][0] not in ("word", "literal"):
        raise Broken("no program name")
    at = _expect(tokens, at + 1, ".")
    while at < len(tokens) and tokens[at][1] in ("AUTHOR", "INSTALLATION", "DATE-WRITTEN", "DATE-COMPILED", "SECURITY", "REMARKS"):
        line = tokens[at][2]
        at = _expect(tokens, at + 1, ".")
        while at < len(tokens) and tokens[at][2] == line:
            at += 1
        if tokens[at - 1][1] != ".":
            raise Broken(f"no period in line {line}")
    if at < len(tokens) and tokens[at][1] == "ENVIRONMENT":
        at = _expect(tokens, at, "ENVIRONMENT", "DIVISION", ".")
        while at < len(tokens) and tokens[at][1] not in ("DATA", "PROCEDURE"):
            end = at
            while end < len(tokens) and tokens[end][1] != ".":
                end += 1
            if end == len(tokens) or any(in_a for _, _, _, in_a in tokens[at + 1 : end]):
                raise Broken(f"no period after the entry of line {tokens[at][2]}")
            if tokens[at][1] == "SELECT":
                words = [w for _, w, _, _ in tokens[at + 1 : end] if w != "OPTIONAL"]
                if words[1:2] != ["ASSIGN"] or len(words) < 3 or words.count("ASSIGN") > 1:
                    raise Broken(f"SELECT in line {tokens[at][2]}")
            at = end + 1
    if at < len(tokens) and tokens[at][1] == "DATA":
        at = _expect(tokens, at, "DATA", "DIVISION", ".")
        while at < len(tokens) and tokens[at][1] in ("FILE", "WORKING-STORAGE", "LOCAL-STORAGE", "LINKAGE"):
            at = _expect(tokens, at, tokens[at][1], "SECTION", ".")
            at = _data_entries(tokens, at, {"WORKING-STORAGE", "LOCAL-STORAGE", "LINKAGE", "PROCEDURE"}, True)
    at = _expect(tokens, at, "PROCEDURE", "DIVISION")
    if at < len(tokens) and tokens[at][1] == "USING":
        at += 1
        while at < len(tokens) and tokens[at][0] == "word":
            at += 1
    at = _expect(tokens, at, ".")
    _procedure(tokens, at)


def _procedure(tokens: list[tuple[str, str, int, bool]], at: int) -> None:
    stack: list[list] = []  # open scopes: [verb, line, state]
    ended = True  # the last sentence has its period
    while at < len(tokens):
        kind, word, n, in_a = tokens[at]
        if word == ".":
            for scope in stack:
                if scope[0] == "PERFORM" or scope[2] == "empty":
                    raise Broken(f"{scope[0]} of line {scope[1]} is not closed")
            if stack:
                raise Broken(f"{stack[-1][0]} of line {stack[-1][1]} is not closed")
            if ended:
                raise Broken(f"period without a statement in line {n}")
            ended = True
            at += 1
        elif in_a and kind in ("word", "number") and word not in _VERBS and word not in ("END", "COPY"):
            if not ended or stack:
                raise Broken(f"no period before line {n}")
            if at + 1 < len(tokens) and tokens[at + 1][1] == "SECTION":
                at += 1
            if at + 1 >= len(tokens) or tokens[at + 1][1] != "." or not re.search("[A-Z]", word):
                raise Broken(f"paragraph name in line {n}")
            at += 2
        elif word == "END" and in_a and ended and at + 1 < len(tokens) and tokens[at + 1][1] == "DECLARATIVES":
            at = _expect(tokens, at + 2, ".")
        elif word == "END" and in_a and ended:
            at = _expect(tokens, at, "END", "PROGRAM")
            if at >= len(tokens) or tokens[at][0] not in ("word", "literal"):
                raise Broken("END PROGRAM without a name")
            at = _expect(tokens, at + 1, ".")
            if at < len(tokens):
                raise Broken(f"text after the program in line {tokens[at][2]}")
        elif word in ("EJECT", "SKIP1", "SKIP2", "SKIP3") and ended:
            at += 2 if at + 1 < len(tokens) and tokens[at + 1][1] == "." else 1
        elif word in ("COPY", "USE", "REPLACE") and ended:
            end = at
            while end < len(tokens) and tokens[end][1] != ".":
                end += 1
            if end == len(tokens):
                raise Broken(f"no period after {word} in line {n}")
            if word == "COPY":
                _copy(tokens[at + 1 : end], n)
            at = end + 1
        elif word in _ENDS:
            verb = word[4:]
            if not stack or stack[-1][0] != verb:
                raise Broken(f"{word} without {verb} in line {n}")
            if stack[-1][2] == "empty":
                raise Broken(f"{verb} of line {stack[-1][1]} holds nothing")
            stack.pop()
            at += 1
            ended = False
        elif word == "EXEC":
            end = at
            while end < len(tokens) and tokens[end][1] != "END-EXEC":
                if end > at and tokens[end][1] == "EXEC":
                    raise Broken(f"EXEC of line {n} is not closed")
                end += 1
            if end == len(tokens):
                raise Broken(f"EXEC of line {n} is not closed")
            _exec(tokens[at + 1 : end], n)
            _holds(stack)
            ended, at = False, end + 1
        elif word in ("ELSE", "WHEN") or word in _VERBS:
            end = at + 1
            while end < len(tokens) and not (tokens[end][1] == "." or (tokens[end][0] == "word" and (tokens[end][1] in _VERBS or tokens[end][1] in _ENDS or tokens[end][1] in ("ELSE", "WHEN", "EXEC")))):
                if tokens[end][3] and tokens[end][2] != tokens[end - 1][2] and tokens[end][0] == "word" and end + 1 < len(tokens) and tokens[end + 1][1] == ".":
                    raise Broken(f"no period before line {tokens[end][2]}")
                end += 1
            _statement(word, tokens[at + 1 : end], n, stack)
            ended, at = False, end
        else:
            raise Broken(f"{word!r} where a statement begins, line {n}")
    if stack:
        raise Broken(f"{stack[-1][0]} of line {stack[-1][1]} is not closed")
    if not ended:
        raise Broken("no period at the end")


def _holds(stack: list[list]) -> None:
    if stack and stack[-1][2] == "empty":
        stack[-1][2] = "filled"
    if stack and stack[-1][0] == "EVALUATE" and stack[-1][2] == "start":
        raise Broken(f"EVALUATE of line {stack[-1][1]} without WHEN")


def _statement(verb: str, operands: list[tuple[str, str, int, bool]], n: int, stack: list[list]) -> None:
    _balanced(operands, n)
    code = _code(operands)
    tail = _EXCEPTION.search(code)
    conditional = bool(tail) and verb in _SCOPED and verb not in ("IF", "EVALUATE", "PERFORM")
    if conditional:
        code = code[: tail.start()]
    if verb == "ELSE":
        if code or not stack or stack[-1][0] != "IF" or stack[-1][2] != "filled" or len(stack[-1]) > 3:
            raise Broken(f"ELSE in line {n}")
        stack[-1][2] = "empty"
        stack[-1].append("else")
        return
    if verb == "WHEN":
        if not stack or stack[-1][0] not in ("EVALUATE", "SEARCH") or not _STATEMENTS["WHEN"].fullmatch(code):
            raise Broken(f"WHEN in line {n}")
        stack[-1][2] = "empty"
        return
    _holds(stack)
    if verb == "PERFORM":
        if _PERFORM_IN.fullmatch(code):
            stack.append(["PERFORM", n, "empty"])
        elif not _PERFORM_OUT.fullmatch(code):
            raise Broken(f"PERFORM in line {n}")
        return
    if not _STATEMENTS[verb].fullmatch(code):
        raise Broken(f"{verb} in line {n}")
    if verb == "IF":
        stack.append(["IF", n, "empty"])
    elif verb in ("EVALUATE", "SEARCH"):
        stack.append([verb, n, "start"])
    elif conditional:
        stack.append([verb, n, "empty"])


def _exec(body: list[tuple[str, str, int, bool]], n: int) -> None:
    """What stands between EXEC and END-EXEC: SQL by the grammar of SQL, else by its delimiters."""
    if len(body) < 2 or body[0][1] not in ("SQL", "CICS", "DLI"):
        raise Broken(f"EXEC in line {n}")
    _balanced(body, n)
    if body[0][1] != "SQL":
        return
    sql = _Sql([(k if k in ("literal", "number") else "mark" if k == "mark" else "word", w, line) for k, w, line, _ in body[1:]], hosts=True)
    if sql.word() == "DECLARE" and "CURSOR" in (sql.word(2), sql.word(3), sql.word(4)):
        sql.at += 1
        sql.name()
        sql.loose({"FOR"}, {"SELECT"})
        sql.need("FOR")
        if sql.word() in ("SELECT", "WITH", "("):
            sql.query()
        else:
            sql.name()
    elif sql.word() in ("BEGIN", "END") and sql.word(1) == "DECLARE":
        return
    else:
        sql.statement()
    sql.take(";")
    if sql.at < len(sql.tokens):
        sql.fail()


def _balanced(tokens: list[tuple[str, str, int, bool]], n: int) -> None:
    depth = 0
    for _, word, _, _ in tokens:
        depth += (word == "(") - (word == ")")
        if depth < 0:
            break
    if depth:
        raise Broken(f"parenthesis in the statement of line {n}")


# ---------------------------------------------------------------- JCL

_CARD = re.compile(r"//([A-Z@#$][A-Z0-9@#$.]{0,16})?[ ]+(\S+)(?:[ ]+(.*))?$", re.I)
_NAME8 = re.compile(r"[A-Z@#$][A-Z0-9@#$]{0,7}(?:\.[A-Z@#$][A-Z0-9@#$]{0,7})?", re.I)
_OPERATIONS = {"JOB", "PROC", "EXEC", "DD", "PEND", "IF", "ELSE", "ENDIF", "SET", "INCLUDE", "JCLLIB", "OUTPUT", "CNTL", "ENDCNTL", "COMMAND", "XMIT"}
_EXEC_KEYS = {"PGM", "PROC", "COND", "PARM", "REGION", "TIME", "ACCT", "ADDRSPC", "DPRTY", "DYNAMNBR", "PERFORM", "RD", "CCSID", "MEMLIMIT", "PARMDD"}
_DD_KEYS = set(
    "DSN DSNAME DISP SPACE UNIT VOL VOLUME DCB SYSOUT DUMMY RECFM LRECL BLKSIZE DSORG LABEL PATH PATHDISP PATHOPTS PATHMODE DATACLAS MGMTCLAS STORCLAS LIKE AMP DEST COPIES OUTPUT FREE HOLD KEYLEN KEYOFF RETPD EXPDT REFDD SUBSYS TERM DDNAME DLM CHARS FCB FLASH BURST AVGREC AVGR EATTR DSNTYPE SEGMENT SPIN PROTECT RLS SECMODEL BLKSZLIM FILEDATA LGSTREAM MODIFY QNAME OUTLIM UCS ACCODE CNTL CCSID BUFNO OPTCD".split()
)
_JOB_KEYS = set("CLASS MSGCLASS MSGLEVEL NOTIFY REGION TIME USER PASSWORD RESTART TYPRUN COND PRTY ADDRSPC BYTES CARDS LINES PAGES GROUP RD SECLABEL SCHENV PERFORM MEMLIMIT JOBRC JESLOG SYSAFF SYSTEM EMAIL CCSID UJOBCORR GDGBIAS DSENQSHR ACCT".split())


class _Operands:
    """The operand field of a statement over all its lines: a stack of parentheses and the open literal are carried along."""

    def __init__(self) -> None:
        self.parts, self.part, self.depth, self.open = [], "", 0, False

    def feed(self, text: str, n: int) -> bool:
        """Operands up to the first blank outside literals; whether the statement goes on."""
        at = 0
        while at < len(text):
            c = text[at]
            if self.open:
                if c == "'":
                    if text[at + 1 : at + 2] == "'":
                        self.part += c
                        at += 1
                    else:
                        self.open = False
            elif c == "'":
                self.open = True
            elif c == "(":
                self.depth += 1
            elif c == ")":
                self.depth -= 1
                if self.depth < 0:
                    raise Broken(f"parenthesis in line {n}")
            elif c == " ":
                break
            elif c == "," and not self.depth:
                self.parts.append(self.part)
                self.part, c = "", ""
            self.part += c
            at += 1
        return self.open or (at > 0 and text[at - 1] == ",")

    def end(self, n: int) -> list[str]:
        if self.open:
            raise Broken(f"open literal in line {n}")
        if self.depth:
            raise Broken(f"parenthesis in line {n}")
        if self.part or not self.parts:
            self.parts.append(self.part)
        return self.parts


def _operands(text: str, n: int) -> tuple[list[str], bool]:
    """Operands of a statement on one line, and whether the list goes on."""
    fields = _Operands()
    goes_on = fields.feed(text, n)
    return fields.end(n), goes_on


#: What closes a scope of JCL, and which scope that is.
_CLOSES = {"ENDIF": "IF", "PEND": "PROC", "ENDCNTL": "CNTL"}


def jcl(text: str) -> None:
    lines = _lines(text)
    while lines and not lines[-1].strip():
        lines.pop()
    first, at, stack = True, 0, []  # stack: open IF, PROC and CNTL scopes
    data: tuple[str, bool] | None = None  # in in-stream data: its delimiter, and whether // cards end it too
    while at < len(lines):
        line, n = lines[at].rstrip(), at + 1
        at += 1
        if data and not (line.startswith(data[0]) or (data[1] and line.startswith("//"))):
            continue
        if data and line.startswith(data[0]):
            data = None
            continue
        data = None
        if line.startswith(("//*", "/*")) or line == "//":
            continue
        if not line.startswith("//"):
            raise Broken(f"line {n} is no statement")
        m = _CARD.match(line)
        if not m:
            raise Broken(f"statement in line {n}")
        name, op, rest = m[1], m[2].upper(), m[3] or ""
        if op not in _OPERATIONS:
            raise Broken(f"operation {op!r} in line {n}")
        if name and not _NAME8.fullmatch(name):
            raise Broken(f"name in line {n}")
        if first and op not in ("JOB", "PROC"):
            raise Broken(f"{op} comes first")
        if op == "JOB" and not name:
            raise Broken(f"no name in line {n}")
        if op == "PROC" and not first or op == "CNTL":
            stack.append([op, n])
        first = False
        if op == "IF":
            while not re.search(r"(?i)(?:^|[ )])THEN(?: |$)", rest):
                more = re.match(r"//[ ]+(\S.*)$", lines[at].rstrip()) if at < len(lines) else None
                if not more or more[1].split(" ")[0].upper() in _OPERATIONS:
                    raise Broken(f"IF without THEN in line {n}")
                rest, at = f"{rest} {more[1]}", at + 1
            test = re.split(r"(?i)(?:(?<=[ )])|^)THEN(?: |$)", rest)[0].strip()
            if not test or test.count("(") != test.count(")") or not re.search(r"[A-Za-z0-9]", test):
                raise Broken(f"IF in line {n}")
            stack.append(["IF", n])
            continue
        if op == "ELSE":
            if not stack or stack[-1][0] != "IF" or len(stack[-1]) > 2:
                raise Broken(f"ELSE without IF in line {n}")
            stack[-1].append("else")
            continue
        if op in _CLOSES:
            if not stack or stack[-1][0] != _CLOSES[op]:
                raise Broken(f"{op} without {_CLOSES[op]} in line {n}")
            stack.pop()
            continue
        fields = _Operands()
        goes_on = fields.feed(rest, n)
        while goes_on:
            if fields.open and len(line) < 71:
                raise Broken(f"open literal in line {at}")
            while at < len(lines) and lines[at].startswith("//*"):
                at += 1
            if at >= len(lines):
                raise Broken("ends in a continued statement")
            line = lines[at].rstrip()
            more = re.match(r"//[ ]{13}(.*)$" if fields.open else r"//[ ]{1,13}(\S.*)$", line[:71] if fields.open else line)
            if not more or (not fields.open and more[1].split(" ")[0].upper() in _OPERATIONS):
                raise Broken(f"line {at + 1} does not continue the statement")
            goes_on = fields.feed(more[1], at + 1)
            at += 1
        parts = fields.end(n)
        _card(op, parts, n)
        if op == "DD" and parts[0].upper() in ("*", "DATA"):
            ends = [p.split("=", 1)[1].strip("'") for p in parts if p.upper().startswith("DLM=")]
            data = (ends[0], False) if ends else ("/*", parts[0] == "*")
    if first:
        raise Broken("no statement")
    if stack:
        raise Broken(f"{stack[-1][0]} of line {stack[-1][1]} is not closed")


def _card(op: str, parts: list[str], n: int) -> None:
    keyed = [p.split("=", 1) for p in parts]
    for k in keyed:
        if len(k) == 2 and (not re.fullmatch(r"[A-Z@#$][A-Z0-9@#$]*(?:\.[A-Z@#$][A-Z0-9@#$]*)?", k[0], re.I) or not (k[1] or op in ("PROC", "SET") or (op == "EXEC" and "PGM" not in keyed[0][0].upper()))):
            raise Broken(f"operand in line {n}")
        if len(k) == 2 and k[1][:1] == "(" and k[1][-1] != ")":
            raise Broken(f"operand in line {n}")
    names = {k[0].upper().split(".")[0] for k in keyed if len(k) == 2}
    if op == "EXEC":
        if len(keyed[0]) == 2:
            if keyed[0][0].upper() not in ("PGM", "PROC") or not re.fullmatch(r"&?[A-Z@#$0-9][A-Z0-9@#$.*]*", keyed[0][1], re.I):
                raise Broken(f"EXEC in line {n}")
        elif not _NAME8.fullmatch(keyed[0][0]):
            raise Broken(f"EXEC in line {n}")
        if len(keyed[0]) == 2 and keyed[0][0].upper() == "PGM" and (names - _EXEC_KEYS or any(len(k) == 1 for k in keyed)):
            raise Broken(f"EXEC operand in line {n}")
    elif op == "DD":
        if parts == [""]:
            raise Broken(f"DD without operands in line {n}")
        if any(len(k) == 1 and k[0].upper() not in ("*", "DATA", "DUMMY", "DYNAM") for k in keyed) or names - _DD_KEYS:
            raise Broken(f"DD operand in line {n}")
    elif op == "JOB":
        if names - _JOB_KEYS:
            raise Broken(f"JOB operand in line {n}")
    elif op == "PROC" and parts != [""] and any(len(k) == 1 for k in keyed):
        raise Broken(f"PROC operand in line {n}")


# ---------------------------------------------------------------- BMS

_MACROS = {"DFHMSD", "DFHMDI", "DFHMDF"}


def bms(text: str) -> None:
    lines = _lines(text)
    while lines and not lines[-1].strip():
        lines.pop()
    at, state, maps = 0, "start", 0
    while at < len(lines):
        line, n = lines[at].expandtabs(8).rstrip(), at + 1
        at += 1
        if line.startswith("*") or not line:
            if state == "end" and line:
                continue
            continue
        goes_on = len(line) > 71 and line[71] != " "
        m = re.match(r"([A-Za-z@#$][A-Za-z0-9@#$]{0,7})?[ ]+(\S+)(?:[ ]+(\S.*))?$", line[:71].rstrip())
        if not m:
            raise Broken(f"statement in line {n}")
        label, op, text_ = m[1], m[2].upper(), m[3] or ""
        while goes_on:
            if at >= len(lines):
                raise Broken("ends in a continued statement")
            more = lines[at].expandtabs(8).rstrip()
            at += 1
            if more[:15].strip() or len(more) < 16 or (more[15] == " " and text_.count("'") % 2 == 0):
                raise Broken(f"line {at} does not continue at column 16")
            goes_on = len(more) > 71 and more[71] != " "
            if not text_.rstrip().endswith(",") and text_.count("'") % 2 == 0:
                raise Broken(f"line {n} is continued without a comma")
            text_ = text_.rstrip() + more[15:71].rstrip()
        parts, open_end = _operands(text_, n)
        if open_end:
            raise Broken(f"line {n} ends with a comma")
        if op in ("PRINT", "TITLE", "EJECT", "SPACE", "COPY", "CSECT"):
            continue
        if op == "END":
            if state != "final" or label:
                raise Broken("END before TYPE=FINAL")
            state = "end"
            continue
        if op not in _MACROS or state in ("final", "end"):
            raise Broken(f"{op!r} in line {n}")
        keys = {}
        for p in parts:
            k, eq, v = p.partition("=")
            if not eq or not re.fullmatch(r"[A-Za-z]{2,8}", k) or not v or (v[0] == "(" and v[-1] != ")") or (v[0] == "'" and (len(v) < 2 or v[-1] != "'")):
                raise Broken(f"operand {p!r} in line {n}")
            keys[k.upper()] = v
        if set(keys) - _BMS_KEYS:
            raise Broken(f"operand in line {n}")
        if op == "DFHMSD":
            if state == "start":
                if not label or "TYPE" not in keys or keys["TYPE"].upper() == "FINAL":
                    raise Broken("no mapset begins")
                state = "set"
            elif keys.get("TYPE", "").upper() == "FINAL":
                if not maps:
                    raise Broken("no map in the set")
                state = "final"
            else:
                raise Broken(f"second DFHMSD in line {n}")
        elif op == "DFHMDI":
            if state not in ("set", "map") or not label:
                raise Broken(f"DFHMDI in line {n}")
            state, maps = "map", maps + 1
        elif state != "map" or not re.fullmatch(r"\(\d+,\d+\)|\d+", keys.get("POS", "(1,1)")):
            raise Broken(f"DFHMDF in line {n}")
    if state not in ("final", "end"):
        raise Broken("no DFHMSD TYPE=FINAL")


_BMS_KEYS = set("TYPE LANG MODE STORAGE CTRL TERM SUFFIX TIOAPFX BASE EXTATT MAPATTS DSATTS DATA COLOR HILIGHT SIZE LINE COLUMN HEADER TRAILER JUSTIFY POS LENGTH ATTRB INITIAL XINIT GINIT PICIN PICOUT OCCURS GRPNAME CASE VALIDN PS OUTLINE SOSI TRANSP FOLD TRIGRAPH CURSLOC FIELDS OBFMT PARTN VTAB LDC HTAB".split())

CHECKS = {"cobol": cobol, "copybook": copybook, "jcl": jcl, "ddl": ddl, "bms": bms}


def fault(text: str, language: str) -> str | None:
    """Why the text does not parse, or None."""
    try:
        CHECKS[language](text)
    except Broken as e:
        return str(e)
    except RecursionError:
        return "nested too deeply"
    return None


def language(source_file: Column) -> Column:
    """The language that the extension announces; null for others."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.element_at(known, F.lower(F.regexp_extract(source_file, r"\.([A-Za-z]+)\s*$", 1)))


@F.arrow_udf(T.StringType())
def _fault_of(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for text, lang in texts:
        yield pa.array([None if t is None or k is None else fault(t, k) for t, k in zip(text.to_pylist(), lang.to_pylist(), strict=True)], pa.string())


def checked(files: DataFrame) -> DataFrame:
    """(source_file, codebase_id, language, fault) of every file with a language and a text; fault is null where it parses."""
    named = files.select("source_file", "codebase_id", language(F.col("source_file")).alias("language"), "text").where(F.col("language").isNotNull() & F.col("text").isNotNull())
    return named.select("source_file", "codebase_id", "language", _fault_of(F.col("text"), F.col("language")).alias("fault"))


def broken_files(files: DataFrame) -> DataFrame:
    return checked(files).where(F.col("fault").isNotNull()).select("source_file").distinct()


def rates(files: DataFrame) -> DataFrame:
    """Files, broken files and their share per codebase and language."""
    n = F.count_if(F.col("fault").isNotNull())
    return checked(files).groupBy("codebase_id", "language").agg(F.count(F.lit(1)).alias("n_files"), n.alias("n_broken"), F.round(n / F.count(F.lit(1)), 4).alias("share"))

"""A small SQL dialect that compiles to filters, pipelines and updates.

    SELECT [DISTINCT] * | item {, item} FROM name [[AS] alias] {[INNER|LEFT|RIGHT|FULL|CROSS] JOIN name [[AS] alias] [ON path = path]}
        [WHERE cond] [GROUP BY path {, path}] [HAVING cond] [ORDER BY path [ASC|DESC] {, ...}] [LIMIT n] [OFFSET n | SKIP n]
    item := path | COUNT(*) | SUM|AVG|MIN|MAX|COUNT(path), each [[AS] alias]
    INSERT INTO name [(columns)] VALUES (literals) {, (literals)} [ON CONFLICT (columns) DO NOTHING | DO UPDATE SET column = value {, ...}]
    UPDATE name SET column = literal {, ...} [WHERE cond]
    DELETE FROM name [WHERE cond]; each of the three may end with RETURNING * | columns; value: a literal or EXCLUDED.column
    cond: AND, OR, NOT, parentheses, = == != <> < <= > >=, [NOT] LIKE, [NOT] IN (...), [NOT] BETWEEN a AND b, IS [NOT] NULL

Conditions are two-valued, as filters are. Literals are numbers, 'text', TRUE, FALSE, NULL and parameters: ? in order or :name.
UPDATE and DELETE take all matching rows. What follows a statement is an error. SELECTs beyond this are Spark SQL: see `ansi`."""

from __future__ import annotations

import re
from typing import Any, NamedTuple


class SqlError(ValueError):
    """The text isn't valid."""


_token = re.compile(r"\s*(?:(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<text>'(?:[^']|'')*')|(?P<quoted>\"(?:[^\"]|\"\")*\"|`[^`]*`)|(?P<param>\?|:[A-Za-z_]\w*)|(?P<word>[A-Za-z_]\w*)|(?P<op><>|!=|<=|>=|==|[=<>(),.*;+-]))")
_joins = {"JOIN": "inner", "INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full", "CROSS": "cross"}
_aggregates = {"COUNT", "SUM", "AVG", "MIN", "MAX"}
_reserved = {"FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "SKIP", "ON", "AND", "OR", "NOT", "AS", "SET", "VALUES", "UNION", "RETURNING", *_joins}


class Token(NamedTuple):
    kind: str
    value: Any


class Item(NamedTuple):
    """An output column: a path, or an aggregate of a path (None for all rows)."""

    path: str | None
    aggregate: str | None
    name: str


class Join(NamedTuple):
    how: str
    table: str
    alias: str
    left: str | None
    right: str | None


class Select(NamedTuple):
    items: list[Item] | None
    distinct: bool
    table: str
    alias: str
    joins: list[Join]
    where: dict
    group: list[str]
    having: dict
    order: list[tuple[str, int]]
    limit: int | None
    offset: int | None


class Insert(NamedTuple):
    table: str
    columns: list[str] | None
    rows: list[list]
    conflict: tuple[list[str], dict | None] | None = None  # key, and what to set: ("excluded", column) or a value
    returning: list[str] | None = None


class Update(NamedTuple):
    table: str
    values: dict
    where: dict
    returning: list[str] | None = None


class Delete(NamedTuple):
    table: str
    where: dict
    returning: list[str] | None = None


Statement = Select | Insert | Update | Delete


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _token.match(text, at)
        if not m or m.end() == at:
            raise SqlError(f"unexpected {text[at:at + 12]!r}")
        at, kind, v = m.end(), m.lastgroup or "", m[m.lastgroup or 0]
        if kind == "number":
            v = float(v) if re.search(r"[.eE]", v) else int(v)
        elif kind == "text":
            v = v[1:-1].replace("''", "'")
        elif kind == "quoted":
            kind, v = "name", v[1:-1].replace('""', '"')
        out.append(Token(kind, v))
    return out


class Parser:
    def __init__(self, text: str, params: Any = None) -> None:
        self.t, self.i, self.params, self.used = tokens(text), 0, params, 0

    # ---- tokens
    def peek(self, k: int = 0) -> Token:
        return self.t[self.i + k] if self.i + k < len(self.t) else Token("end", None)

    def is_(self, *words: str) -> bool:
        t = self.peek()
        return t.kind == "word" and t.value.upper() in words or t.kind == "op" and t.value in words

    def take(self, *words: str) -> bool:
        if self.is_(*words):
            self.i += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise SqlError(f"expected {word}, found {self.peek().value!r}")

    def name(self) -> str:
        t = self.peek()
        if t.kind not in ("word", "name") or t.kind == "word" and t.value.upper() in _reserved:
            raise SqlError(f"expected a name, found {t.value!r}")
        self.i += 1
        return t.value

    def path(self) -> str:
        parts = [self.name()]
        while self.peek().value == "." and self.peek().kind == "op":
            self.i += 1
            t = self.peek()
            if t.kind == "number":
                self.i += 1
                parts.append(str(t.value))
            else:
                parts.append(self.name())
        return ".".join(parts)

    def literal(self) -> Any:
        sign = -1 if self.take("-") else 1
        self.take("+")
        t = self.peek()
        self.i += 1
        if t.kind == "number":
            return sign * t.value
        if t.kind == "text":
            return t.value
        if t.kind == "param":
            if t.value == "?":
                if self.params is None or self.used >= len(self.params):
                    raise SqlError("a parameter is missing")
                self.used += 1
                return self.params[self.used - 1]
            try:
                return self.params[t.value[1:]]
            except (KeyError, TypeError):
                raise SqlError(f"the parameter {t.value} is missing") from None
        if t.kind == "word" and t.value.upper() in ("TRUE", "FALSE", "NULL"):
            return {"TRUE": True, "FALSE": False, "NULL": None}[t.value.upper()]
        raise SqlError(f"expected a literal, found {t.value!r}")

    def whole(self) -> int:
        n = self.literal()
        if not isinstance(n, int) or isinstance(n, bool) or n < 0:
            raise SqlError("expected a whole number")
        return n

    # ---- conditions
    def condition(self) -> dict:
        parts = [self.conjunction()]
        while self.take("OR"):
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else {"$or": parts}

    def conjunction(self) -> dict:
        parts = [self.atom()]
        while self.take("AND"):
            parts.append(self.atom())
        return parts[0] if len(parts) == 1 else {"$and": parts}

    def atom(self) -> dict:
        if self.take("NOT"):
            return {"$not": self.atom()}
        if self.take("("):
            out = self.condition()
            self.need(")")
            return out
        left = self.item_path()
        if self.take("IS"):
            no = self.take("NOT")
            self.need("NULL")
            return {left: {"$ne" if no else "$eq": None}}
        no = self.take("NOT")
        if self.take("IN"):
            self.need("(")
            values = [self.literal()]
            while self.take(","):
                values.append(self.literal())
            self.need(")")
            return {left: {"$nin" if no else "$in": values}}
        if self.take("BETWEEN"):
            lo = self.literal()
            self.need("AND")
            out = {left: {"$gte": lo, "$lte": self.literal()}}
            return {"$not": out} if no else out
        if self.take("LIKE"):
            pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in str(self.literal()))
            out = {left: {"$regex": f"^{pattern}$", "$options": "s"}}
            return {"$not": out} if no else out
        if no:
            raise SqlError("expected IN, BETWEEN or LIKE after NOT")
        ops = {"=": "$eq", "==": "$eq", "!=": "$ne", "<>": "$ne", "<": "$lt", "<=": "$lte", ">": "$gt", ">=": "$gte"}
        t = self.peek()
        if t.kind != "op" or t.value not in ops:
            raise SqlError(f"expected a comparison, found {t.value!r}")
        self.i += 1
        return {left: {ops[t.value]: self.literal()}}

    def item_path(self) -> str:
        """A path, or in HAVING an aggregate by the name that it would get."""
        if self.peek().kind == "word" and self.peek().value.upper() in _aggregates and self.peek(1).value == "(":
            return self.item().name
        return self.path()

    # ---- statements
    def item(self) -> Item:
        word = self.peek()
        if word.kind == "word" and word.value.upper() in _aggregates and self.peek(1) == Token("op", "("):
            self.i += 2
            f = word.value.lower()
            path = None if self.take("*") else self.path()
            self.need(")")
            item = Item(path, f, f"{f}_{path.replace('.', '_')}" if path else f)
        else:
            path = self.path()
            item = Item(path, None, path.rpartition(".")[2])
        if self.take("AS") or self.peek().kind in ("word", "name") and not (self.peek().kind == "word" and self.peek().value.upper() in _reserved | {"IS", "IN", "BETWEEN", "LIKE", "ASC", "DESC"}):
            item = item._replace(name=self.name())
        return item

    def alias(self, table: str) -> str:
        if self.take("AS") or self.peek().kind in ("word", "name") and not (self.peek().kind == "word" and self.peek().value.upper() in _reserved):
            return self.name()
        return table

    def select(self) -> Select:
        distinct = self.take("DISTINCT")
        items = None
        if not self.take("*"):
            items = [self.item()]
            while self.take(","):
                items.append(self.item())
        self.need("FROM")
        table = self.name()
        alias, joins = self.alias(table), []
        while self.is_(*_joins):
            how = _joins[self.peek().value.upper()]
            self.i += 1
            if how != "inner" or self.is_("JOIN", "OUTER"):
                self.take("OUTER")
                self.take("JOIN")
            other = self.name()
            name, left, right = self.alias(other), None, None
            if how != "cross":
                self.need("ON")
                left = self.path()
                self.need("=")
                right = self.path()
            joins.append(Join(how, other, name, left, right))
        where = self.condition() if self.take("WHERE") else {}
        group, having, order, limit, offset = [], {}, [], None, None
        if self.take("GROUP"):
            self.need("BY")
            group.append(self.path())
            while self.take(","):
                group.append(self.path())
        if self.take("HAVING"):
            having = self.condition()
        if self.take("ORDER"):
            self.need("BY")
            while True:
                path = self.item_path()
                d = -1 if self.take("DESC") else 1
                self.take("ASC")
                order.append((path, d))
                if not self.take(","):
                    break
        while self.is_("LIMIT", "OFFSET", "SKIP"):
            if self.take("LIMIT"):
                limit = self.whole()
            else:
                self.i += 1
                offset = self.whole()
        return Select(items, distinct, table, alias, joins, where, group, having, order, limit, offset)

    def insert(self) -> Insert:
        self.need("INTO")
        table, columns, rows = self.name(), None, []
        if self.take("("):
            columns = [self.name()]
            while self.take(","):
                columns.append(self.name())
            self.need(")")
        self.need("VALUES")
        while True:
            self.need("(")
            row = [self.literal()]
            while self.take(","):
                row.append(self.literal())
            self.need(")")
            if columns and len(row) != len(columns):
                raise SqlError(f"{len(columns)} columns, {len(row)} values")
            rows.append(row)
            if not self.take(","):
                break
        return Insert(table, columns, rows, self.conflict(), self.returning())

    def conflict(self) -> tuple[list[str], dict | None] | None:
        if not self.take("ON"):
            return None
        self.need("CONFLICT")
        self.need("(")
        key = [self.name()]
        while self.take(","):
            key.append(self.name())
        self.need(")")
        self.need("DO")
        if self.take("NOTHING"):
            return key, None
        self.need("UPDATE")
        self.need("SET")
        values: dict = {}
        while True:
            path = self.path()
            self.need("=")
            if self.take("EXCLUDED"):
                self.need(".")
                values[path] = ("excluded", self.name())
            else:
                values[path] = self.literal()
            if not self.take(","):
                return key, values

    def returning(self) -> list[str] | None:
        if not self.take("RETURNING"):
            return None
        if self.take("*"):
            return ["*"]
        out = [self.path()]
        while self.take(","):
            out.append(self.path())
        return out

    def update(self) -> Update:
        table, values = self.name(), {}
        self.need("SET")
        while True:
            path = self.path()
            self.need("=")
            values[path] = self.literal()
            if not self.take(","):
                break
        return Update(table, values, self.condition() if self.take("WHERE") else {}, self.returning())

    def statement(self) -> Statement:
        if self.take("SELECT"):
            out: Statement = self.select()
        elif self.take("INSERT"):
            out = self.insert()
        elif self.take("UPDATE"):
            out = self.update()
        elif self.take("DELETE"):
            self.need("FROM")
            out = Delete(self.name(), self.condition() if self.take("WHERE") else {}, self.returning())
        else:
            raise SqlError(f"expected SELECT, INSERT, UPDATE or DELETE, found {self.peek().value!r}")
        self.take(";")
        if self.i < len(self.t):
            raise SqlError(f"unexpected {self.peek().value!r}")
        return out


def parse(text: str, params: Any = None) -> Statement:
    return Parser(text, params).statement()

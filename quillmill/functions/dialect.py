"""One spelling of an expression for two engines.

Operators are written once as SQL templates. ``SPARK`` renders them for the
engine, ``DUCK`` for the checks against DuckDB. Regular expressions stay within what
Java and RE2 read alike: ASCII classes, no look-around, no back-references. ``\\b`` and
``(?i)`` are RE2's; for Java they are spelled out.
"""

from __future__ import annotations

import re

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII blanks and punctuation, as the inside of a character class.
BLANK = r" \t\n\x0B\f\r"
PUNCT = r"!-/:-@\[-`{-~"


class Dialect:
    """Renders the few things in which the engines differ."""

    name = ""

    def re(self, pattern: str) -> str:
        raise NotImplementedError

    def text(self, value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def lower(self, x: str) -> str:
        """ASCII letters in lower case, all else as it is."""
        return f"translate({x}, '{UPPER}', '{LOWER}')"

    def blanks(self, x: str) -> str:
        """Runs of blanks as one space, none at the ends."""
        return f"trim({self.sub(x, f'[{BLANK}]+', ' ')})"

    def letters(self, x: str, inside: str) -> str:
        """The bytes of ``x`` in an ASCII class."""
        return self.octets(self.sub(x, f"[^{inside}]+", ""))

    def any_of(self, x: str, words) -> str:
        return "(" + " OR ".join(f"contains({x}, {self.text(w)})" for w in words) + ")"

    def how_many(self, x: str, words) -> str:
        return "(" + " + ".join(f"CAST(contains({x}, {self.text(w)}) AS INT)" for w in words) + ")"

    def ratio(self, a: str, b: str, otherwise: str = "0.0D") -> str:
        return f"(CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE {self.number(otherwise)} END)"

    def number(self, x: str) -> str:
        return f"CAST({x.rstrip('D')} AS DOUBLE)"

    def strip(self, x: str) -> str:
        return self.sub(x, f"^[{PUNCT}]+|[{PUNCT}]+$", "")

    def words(self, x: str) -> str:
        """Runs of other than blanks, without punctuation at their ends, none empty."""
        return self.keep(self.map(self.all(x, f"[^{BLANK}]+"), "w", self.strip("w")), "w", "w <> ''")


def _java(pattern: str) -> str:
    """``pattern`` as RE2 reads it: word boundaries between ASCII characters alone, and with ``(?i)`` the two letters beyond ASCII whose other case is an ASCII letter."""
    word = "[0-9A-Za-z_]"
    edge = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    parts = re.findall(r"\\x[0-9A-Fa-f]{2}|\\.|\(\?[a-z]*[:)]?|\[\^?\]?(?:\\.|[^\]\\])*\]|.", pattern, re.S)
    folded = pattern.startswith("(?i)")

    def one(x: str) -> str:
        if x == r"\b":
            return edge
        if folded and x[0] == "[" and ("a-z" in x or "A-Z" in x):
            return x[:-1] + "\u017f\u212a]"
        return {"s": "[s\u017f]", "k": "[k\u212a]"}.get(x.lower(), x) if folded else x

    return "".join(map(one, parts))


class Spark(Dialect):
    name = "spark"

    def re(self, pattern: str) -> str:
        return f"r'{_java(pattern)}'"

    def text(self, value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"

    def octets(self, x):
        return f"octet_length({x})"

    def chars(self, x):
        return f"char_length({x})"

    def has(self, x, pattern):
        return f"({x} RLIKE {self.re(pattern)})"

    def count(self, x, pattern):
        return f"regexp_count({x}, {self.re(pattern)})"

    def sub(self, x, pattern, to):
        return f"regexp_replace({x}, {self.re(pattern)}, '{to}')"

    def all(self, x, pattern):
        return f"regexp_extract_all({x}, {self.re(pattern)}, 0)"

    def group(self, x, pattern, n=1):
        return f"regexp_extract({x}, {self.re(pattern)}, {n})"

    def map(self, xs, name, body):
        return f"transform({xs}, {name} -> {body})"

    def keep(self, xs, name, body):
        return f"filter({xs}, {name} -> {body})"

    def size(self, xs):
        return f"size({xs})"

    def distinct(self, xs):
        return f"array_distinct({xs})"

    def has_item(self, xs, x):
        return f"array_contains({xs}, {x})"

    def total(self, xs):
        return f"aggregate({xs}, 0L, (s, v) -> s + v)"

    def array(self, items):
        return f"array({', '.join(items)})"

    def join(self, xs, by):
        return f"array_join({xs}, {self.text(by)})"

    def lines(self, x):
        """Parts between line ends; a last empty one doesn't count."""
        return f"split(regexp_replace({x}, r'\\n$', ''), '\\n')"

    def windows(self, xs, n):
        """Runs of ``n`` items, joined by a space; none if there are fewer."""
        return f"(CASE WHEN size({xs}) >= {n} THEN transform(sequence(1, size({xs}) - {n - 1}), i -> array_join(slice({xs}, i, {n}), ' ')) ELSE array() END)"

    def grams(self, x, n):
        """Runs of ``n`` characters of ``x``, whose characters are in column ``chars``; a shorter text is one."""
        return f"(CASE WHEN char_length({x}) >= {n} THEN transform(sequence(1, char_length({x}) - {n - 1}), (v, i) -> concat({', '.join(f'chars[i + {k}]' for k in range(n))})) ELSE array({x}) END)"

    def characters(self, x):
        return f"split({x}, '')"


class Duck(Dialect):
    name = "duckdb"

    def re(self, pattern: str) -> str:
        return f"'{pattern}'"

    def octets(self, x):
        return f"strlen({x})"

    def chars(self, x):
        return f"length({x})"

    def has(self, x, pattern):
        return f"regexp_matches({x}, {self.re(pattern)})"

    def count(self, x, pattern):
        return f"len(regexp_extract_all({x}, {self.re(pattern)}))"

    def sub(self, x, pattern, to):
        return f"regexp_replace({x}, {self.re(pattern)}, '{to}', 'g')"

    def all(self, x, pattern):
        return f"regexp_extract_all({x}, {self.re(pattern)})"

    def group(self, x, pattern, n=1):
        return f"regexp_extract({x}, {self.re(pattern)}, {n})"

    def map(self, xs, name, body):
        return f"list_transform({xs}, lambda {name}: {body})"

    def keep(self, xs, name, body):
        return f"list_filter({xs}, lambda {name}: {body})"

    def size(self, xs):
        return f"CAST(len({xs}) AS INT)"

    def distinct(self, xs):
        return f"list_distinct({xs})"

    def has_item(self, xs, x):
        return f"list_contains({xs}, {x})"

    def total(self, xs):
        return f"CAST(coalesce(list_sum({xs}), 0) AS BIGINT)"

    def array(self, items):
        return f"[{', '.join(items)}]"

    def join(self, xs, by):
        return f"array_to_string({xs}, {self.text(by)})"

    def lines(self, x):
        return f"string_split(regexp_replace({x}, '\\n$', ''), chr(10))"

    def windows(self, xs, n):
        return f"list_transform(range(1, greatest(1, len({xs}) - {n - 2})), lambda i: array_to_string({xs}[i:i + {n - 1}], ' '))"

    def grams(self, x, n):
        return f"(CASE WHEN length({x}) >= {n} THEN list_transform(range(1, length({x}) - {n - 2}), lambda i: {' || '.join(f'chars[i + {k}]' for k in range(n))}) ELSE [{x}] END)"

    def characters(self, x):
        return f"regexp_extract_all({x}, '(?s).')"


SPARK, DUCK = Spark(), Duck()


class Layers:
    """Columns in layers: each may use those of the layers before.

    ``layers`` is a function of a dialect that returns a list of dicts, name to expression. ``prepare``
    adds columns to Spark's frame before the layers, where DuckDB has layers of its own for them.

    A column of the frame that has the name of one of these is replaced by it; ``keep`` and ``spark`` are
    safe with any names.
    """

    def __init__(self, layers, out: list[str], where: str | None = None, prepare=None):
        self.layers, self.out, self.where, self.prepare = layers, out, where, prepare

    def add(self, df, *also):
        """``df`` with the columns of all layers, and further ``(name, Column)`` before them."""
        made = [layer for layer in self.layers(SPARK) if layer]
        names = {n.lower() for layer in made for n in layer}
        df = df.drop(*(c for c in df.columns if c.lower() in names))
        if self.prepare:
            df = self.prepare(df)
        for name, column in also:
            df = df.withColumn(name, column)
        for layer in made:
            df = df.selectExpr("*", *(f"{x} AS {n}" for n, x in layer.items()))
        return df

    def keep(self, df, where: str):
        """The rows of ``df`` for which a condition on the layers' columns holds, in the columns they have."""
        own = {c: f"__own{k}" for k, c in enumerate(df.columns)}
        both = df.selectExpr("*", *(f"`{c}` AS {p}" for c, p in own.items()))
        return self.add(both).where(where).selectExpr(*(f"{p} AS `{c}`" for c, p in own.items()))

    def spark(self, df, *also):
        df = self.add(df, *also)
        return (df.where(self.where) if self.where else df).selectExpr(*self.out)

    def inner(self, source: str) -> str:
        """DuckDB's query for all columns of all layers."""
        sql = f"SELECT * FROM {source}"
        for layer in filter(None, self.layers(DUCK)):
            sql = f"SELECT *, {', '.join(f'{x} AS {n}' for n, x in layer.items())} FROM ({sql})"
        return sql

    def duck(self, source: str) -> str:
        return f"SELECT {', '.join(self.out)} FROM ({self.inner(source)})" + (f" WHERE {self.where}" if self.where else "")

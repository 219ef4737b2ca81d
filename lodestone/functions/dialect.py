"""Expressions written once, rendered for Spark SQL and for DuckDB.

A *program* is a list of layers; each layer names new columns and gives, for a dialect, their SQL text.  On
Spark the layers are projections that Catalyst collapses where that repeats no work; for the oracle they
become common table expressions over the same rule data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Layer = dict[str, Callable[["Dialect"], str]]
Program = list[Layer]


class Dialect:
    name = ""

    def text(self, s: str) -> str:
        """A string literal, whatever characters it holds."""
        raise NotImplementedError

    def fold_accents(self, x: str) -> str:
        raise NotImplementedError

    def replace_all(self, x: str, pattern: str, by: str) -> str:
        raise NotImplementedError

    def replace_first(self, x: str, pattern: str, by: str) -> str:
        raise NotImplementedError

    def replace_dynamic(self, x: str, pattern: str, by: str) -> str:
        """All hits of a pattern expression, by the text of another (which holds no sign of its own)."""
        raise NotImplementedError

    def has(self, x: str, pattern: str) -> str:
        raise NotImplementedError

    def find(self, x: str, pattern: str, group: int = 0) -> str:
        """The group of the first hit, or null."""
        raise NotImplementedError

    def find_all(self, x: str, pattern: str, group: int = 0) -> str:
        raise NotImplementedError

    def split(self, x: str, pattern: str) -> str:
        raise NotImplementedError

    def array(self, *xs: str) -> str:
        raise NotImplementedError

    def filter(self, xs: str, cond: str) -> str:
        """Elements ``x`` for which ``cond`` holds."""
        raise NotImplementedError

    def filter_place(self, xs: str, cond: str) -> str:
        """As ``filter``; ``i`` is the place from 1."""
        raise NotImplementedError

    def map(self, xs: str, expr: str) -> str:
        raise NotImplementedError

    def fold(self, xs: str, expr: str) -> str:
        """``expr`` over ``a`` (so far, from the first element) and ``x``; null for an empty array."""
        raise NotImplementedError

    def at(self, xs: str, place: str) -> str:
        raise NotImplementedError

    def cut(self, xs: str, a: str, b: str) -> str:
        """Places a to b."""
        raise NotImplementedError

    def concat(self, *xs: str) -> str:
        raise NotImplementedError

    def join(self, xs: str, by: str) -> str:
        raise NotImplementedError

    def size(self, xs: str) -> str:
        raise NotImplementedError

    def sort(self, xs: str) -> str:
        raise NotImplementedError

    def lookup(self, table: dict[str, str], key: str) -> str:
        raise NotImplementedError

    def explode(self, xs: str) -> str:
        raise NotImplementedError

    # What both write alike.

    def trim(self, x: str) -> str:
        return self.replace_all(x, r"^\s+|\s+$", "")

    def replaces(self, x: str, rules: Iterable[tuple[str, str]], flags: str = "(?i)") -> str:
        for pattern, by in rules:
            x = self.replace_all(x, flags + pattern, by)
        return x

    def cases(self, pairs: Iterable[tuple[str, str]], other: str = "NULL") -> str:
        return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {other} END"

    def first_place(self, xs: str, cond: str) -> str:
        """The place of the first element for which ``cond`` (over ``x``) holds, or null."""
        flags = self.map(xs, f"CASE WHEN {cond} THEN 1 ELSE 0 END")
        return f"CAST(nullif({self.place(flags, chr(49))}, 0) AS INT)"

    def place(self, xs: str, value: str) -> str:
        raise NotImplementedError

    def without(self, xs: str, place: str) -> str:
        return f"CASE WHEN {place} IS NULL THEN {xs} ELSE {self.filter_place(xs, f'i <> {place}')} END"

    def within(self, x: str, values: Iterable[str]) -> str:
        return f"{x} IN ({', '.join(map(self.text, values))})"


class Spark(Dialect):
    name = "spark"

    def text(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t") + "'"

    def fold_accents(self, x: str) -> str:
        from lodestone.functions.text import LATIN

        return f"translate({x}, {self.text(''.join(LATIN))}, {self.text(''.join(LATIN.values()))})"

    def replace_all(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by.replace(chr(92), '$'))})"

    def replace_first(self, x: str, pattern: str, by: str) -> str:
        flags, rest = (pattern[:4], pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
        return f"regexp_replace({x}, {self.text(f'{flags}(?s)^(.*?)(?:{rest})')}, {self.text('$1' + by)})"

    def replace_dynamic(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {pattern}, {by})"

    def has(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.text(pattern)})"

    def find(self, x: str, pattern: str, group: int = 0) -> str:
        return f"nullif(regexp_extract({x}, {self.text(pattern)}, {group}), '')"

    def find_all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.text(pattern)}, {group})"

    def split(self, x: str, pattern: str) -> str:
        return f"split({x}, {self.text(pattern)})"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def filter(self, xs: str, cond: str) -> str:
        return f"filter({xs}, x -> {cond})"

    def filter_place(self, xs: str, cond: str) -> str:
        return f"filter({xs}, (x, i0) -> {cond.replace('i ', '(i0 + 1) ', 1)})"

    def map(self, xs: str, expr: str) -> str:
        return f"transform({xs}, x -> {expr})"

    def fold(self, xs: str, expr: str) -> str:
        return f"aggregate({xs}, CAST(NULL AS STRING), (a, x) -> CASE WHEN a IS NULL THEN x ELSE {expr} END)"

    def at(self, xs: str, place: str) -> str:
        return f"try_element_at({xs}, {place})"

    def cut(self, xs: str, a: str, b: str) -> str:
        return f"slice({xs}, {a}, greatest({b} - {a} + 1, 0))"

    def concat(self, *xs: str) -> str:
        return f"concat({', '.join(xs)})"

    def join(self, xs: str, by: str) -> str:
        return f"array_join({xs}, {self.text(by)})"

    def size(self, xs: str) -> str:
        return f"size({xs})"

    def sort(self, xs: str) -> str:
        return f"array_sort({xs})"

    def lookup(self, table: dict[str, str], key: str) -> str:
        return f"map({', '.join(f'{self.text(k)}, {self.text(v)}' for k, v in table.items())})[{key}]"

    def explode(self, xs: str) -> str:
        return f"explode({xs})"

    def place(self, xs: str, value: str) -> str:
        return f"array_position({xs}, {value})"


class Duck(Dialect):
    name = "duckdb"

    def text(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def fold_accents(self, x: str) -> str:
        return f"strip_accents({x})"

    def replace_all(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)}, 'g')"

    def replace_first(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)})"

    def replace_dynamic(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {pattern}, {by}, 'g')"

    def has(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.text(pattern)})"

    def find(self, x: str, pattern: str, group: int = 0) -> str:
        return f"nullif(regexp_extract({x}, {self.text(pattern)}, {group}), '')"

    def find_all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.text(pattern)}, {group})"

    def split(self, x: str, pattern: str) -> str:
        return f"string_split_regex({x}, {self.text(pattern)})"

    def array(self, *xs: str) -> str:
        return f"[{', '.join(xs)}]"

    def filter(self, xs: str, cond: str) -> str:
        return f"list_filter({xs}, lambda x: {cond})"

    def filter_place(self, xs: str, cond: str) -> str:
        return f"list_filter({xs}, lambda x, i: {cond})"

    def map(self, xs: str, expr: str) -> str:
        return f"list_transform({xs}, lambda x: {expr})"

    def fold(self, xs: str, expr: str) -> str:
        return f"CASE WHEN len({xs}) > 0 THEN list_reduce({xs}, lambda a, x: {expr}) END"

    def at(self, xs: str, place: str) -> str:
        return f"list_extract({xs}, {place})"

    def cut(self, xs: str, a: str, b: str) -> str:
        return f"list_slice({xs}, {a}, {b})"

    def concat(self, *xs: str) -> str:
        out = xs[0]
        for x in xs[1:]:
            out = f"list_concat({out}, {x})"
        return out

    def join(self, xs: str, by: str) -> str:
        return f"array_to_string({xs}, {self.text(by)})"

    def size(self, xs: str) -> str:
        return f"len({xs})"

    def sort(self, xs: str) -> str:
        return f"list_sort({xs})"

    def lookup(self, table: dict[str, str], key: str) -> str:
        keys, values = (", ".join(map(self.text, t)) for t in (table, table.values()))
        return f"MAP([{keys}], [{values}])[{key}]"

    def explode(self, xs: str) -> str:
        return f"unnest({xs})"

    def place(self, xs: str, value: str) -> str:
        return f"list_position({xs}, {value})"


SPARK, DUCK = Spark(), Duck()


def apply(df: DataFrame, program: Program) -> DataFrame:
    """The program's columns added to ``df``."""
    for layer in program:
        df = df.withColumns({c: F.expr(f(SPARK)) for c, f in layer.items()})
    return df


def oracle(source: str, program: Program, select: str, name: str = "s") -> str:
    """DuckDB SQL: the program over a query, then a selection of its columns."""
    return f"WITH {ctes(source, program, name)} {select.replace('$', f'{name}{len(program)}')}"


def ctes(source: str, program: Program, name: str = "s") -> str:
    """The program as common table expressions ``name0`` (the source) to ``name<n>``."""
    parts = [f"{name}0 AS ({source})"]
    for k, layer in enumerate(program):
        cols = ", ".join(f"{f(DUCK)} AS {c}" for c, f in layer.items())
        parts.append(f"{name}{k + 1} AS (SELECT *, {cols} FROM {name}{k})")
    return ", ".join(parts)

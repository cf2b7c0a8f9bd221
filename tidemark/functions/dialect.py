"""One definition of each scalar function, rendered for Spark SQL (the engine) and DuckDB (the oracle).

Expressions are SQL text. A function takes a dialect and SQL operands and returns SQL; what the two systems spell
differently (lambdas, regular expressions, lists, literals) is written once here."""

from __future__ import annotations

from collections.abc import Callable, Iterable

#: What Python's \s matches in text; neither Java's nor RE2's \s does.
SPACES = r"\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

#: Letters beyond ASCII, for an engine whose word boundaries stop at ASCII.
WIDE = r"[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{370}-\x{1FFF}\x{3040}-\x{D7FF}]"


class Dialect:
    """Spark SQL."""

    spark = True
    array, double, integer, string = "array", "DOUBLE", "INT", "STRING"

    def lit(self, value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"

    def pattern(self, value: str) -> str:
        unicode = "(?U)" if r"\b" in value else ""  # a word boundary also stands beside letters beyond ASCII
        return "r'" + unicode + value.replace("'", r"\x27") + "'"

    def group(self, k: int) -> str:
        return f"${k}"

    def matches(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.pattern(pattern)})"

    def replace_all(self, x: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({x}, {self.pattern(pattern)}, {self.lit(by)})"

    def replace_first(self, x: str, pattern: str, by: str) -> str:
        """The first match replaced; text after a line end is left out."""
        return f"regexp_replace({x}, {self.pattern(f'^(.*?){pattern}(.*)$')}, {self.lit('$1' + by + '$2')})"

    def table(self, name: str) -> str:
        return f"tidemark_{name}"

    def extract(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.pattern(pattern)}, {group})"

    def extract_all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.pattern(pattern)}, {group})"

    def split(self, x: str, pattern: str) -> str:
        return f"split({x}, {self.pattern(pattern)}, -1)"

    def _lambda(self, names: tuple[str, ...], body: str) -> str:
        return f"{names[0] if len(names) == 1 else '(' + ', '.join(names) + ')'} -> {body}"

    def transform(self, a: str, body: Callable[[str], str], name: str = "x") -> str:
        return f"transform({a}, {self._lambda((name,), body(name))})"

    def filter(self, a: str, body: Callable[[str], str], name: str = "x") -> str:
        return f"filter({a}, {self._lambda((name,), body(name))})"

    def filter_at(self, a: str, body: Callable[[str, str], str], name: str = "x", index: str = "i") -> str:
        """body gets the item and its place, from 1."""
        return f"filter({a}, {self._lambda((name, index), body(name, f'({index} + 1)'))})"

    def position(self, a: str, x: str) -> str:
        return f"array_position({a}, {x})"

    def size(self, a: str) -> str:
        return f"size({a})"

    def head(self, a: str, n: int) -> str:
        return f"slice({a}, 1, {n})"

    def join(self, a: str, by: str) -> str:
        return f"array_join({a}, {self.lit(by)})"

    def concat(self, *arrays: str) -> str:
        return f"concat({', '.join(arrays)})"

    def list(self, items: Iterable[str]) -> str:
        items = list(items)
        return f"array({', '.join(items)})" if items else "CAST(array() AS array<string>)"

    def has(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def let(self, value: str, body: Callable[[str], str], name: str) -> str:
        """body of a value that it uses several times, or in a lambda: it is made once a row."""
        return f"get(transform(array({value}), {name} -> {body(name)}), 0)"

    def flatten(self, a: str) -> str:
        return f"flatten({a})"

    def greatest_of(self, a: str, default: str) -> str:
        return f"coalesce(array_max({a}), {default})"

    def trim(self, x: str, chars: str) -> str:
        return f"trim(BOTH {self.lit(chars)} FROM {x})"

    def rtrim(self, x: str, chars: str) -> str:
        return f"trim(TRAILING {self.lit(chars)} FROM {x})"

    def try_int(self, x: str) -> str:
        return f"try_cast({x} AS INT)"

    def at(self, a: str, k: int) -> str:
        """The item at place k from 1, null if there is none."""
        return f"get({a}, {k - 1})"

    def rows(self, name: str, columns: tuple[str, ...], rows: Iterable[tuple]) -> str:
        """A derived table of literal rows."""
        cell = lambda v: "NULL" if v is None else self.lit(v) if isinstance(v, str) else str(v)
        return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS {name}({', '.join(columns)}))"

    # what both spell alike, in terms of the above
    def contains(self, x: str, value: str) -> str:
        return f"contains({x}, {self.lit(value)})"

    def any_in(self, x: str, values: Iterable[str]) -> str:
        return "(" + " OR ".join(self.contains(x, v) for v in values) + ")"

    def count_in(self, x: str, values: Iterable[str]) -> str:
        return "(" + " + ".join(f"CASE WHEN {self.contains(x, v)} THEN 1 ELSE 0 END" for v in values) + ")"

    def is_in(self, x: str, values: Iterable[str]) -> str:
        return f"({x} IN ({', '.join(self.lit(v) for v in sorted(values))}))"

    def starts(self, x: str, value: str) -> str:
        return f"(left({x}, {len(value)}) = {self.lit(value)})"

    def ends(self, x: str, value: str) -> str:
        return f"(right({x}, {len(value)}) = {self.lit(value)})"


class Duck(Dialect):
    """DuckDB."""

    spark = False
    string = "VARCHAR"

    def lit(self, value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def pattern(self, value: str) -> str:
        return "'" + value.replace("'", r"\x27") + "'"

    def group(self, k: int) -> str:
        return f"\\{k}"

    def _bounded(self, x: str, pattern: str) -> str:
        """x with letters beyond ASCII as underscores where word boundaries matter, as RE2 knows ASCII words only."""
        return f"regexp_replace({x}, '{WIDE}', '_', 'g')" if r"\b" in pattern else x

    def extract(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({self._bounded(x, pattern)}, {self.pattern(pattern)}, {group})"

    def extract_all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({self._bounded(x, pattern)}, {self.pattern(pattern)}, {group})"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_matches({self._bounded(x, pattern)}, {self.pattern(pattern)})"

    def replace_all(self, x: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({x}, {self.pattern(pattern)}, {self.lit(by)}, 'g')"

    def replace_first(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.pattern(pattern)}, {self.lit(by)})"

    def table(self, name: str) -> str:
        return name

    def split(self, x: str, pattern: str) -> str:
        return f"regexp_split_to_array({x}, {self.pattern(pattern)})"

    def _lambda(self, names: tuple[str, ...], body: str) -> str:
        return f"lambda {', '.join(names)}: {body}"

    def transform(self, a: str, body: Callable[[str], str], name: str = "x") -> str:
        return f"list_transform({a}, {self._lambda((name,), body(name))})"

    def filter(self, a: str, body: Callable[[str], str], name: str = "x") -> str:
        return f"list_filter({a}, {self._lambda((name,), body(name))})"

    def filter_at(self, a: str, body: Callable[[str, str], str], name: str = "x", index: str = "i") -> str:
        return f"list_filter({a}, {self._lambda((name, index), body(name, index))})"

    def position(self, a: str, x: str) -> str:
        return f"list_position({a}, {x})"

    def size(self, a: str) -> str:
        return f"CAST(len({a}) AS INT)"

    def head(self, a: str, n: int) -> str:
        return f"list_slice({a}, 1, {n})"

    def join(self, a: str, by: str) -> str:
        return f"array_to_string({a}, {self.lit(by)})"

    def concat(self, *arrays: str) -> str:
        out = arrays[0]
        for a in arrays[1:]:
            out = f"list_concat({out}, {a})"
        return out

    def list(self, items: Iterable[str]) -> str:
        items = list(items)
        return f"[{', '.join(items)}]" if items else "CAST([] AS VARCHAR[])"

    def has(self, a: str, x: str) -> str:
        return f"list_contains({a}, {x})"

    def let(self, value: str, body: Callable[[str], str], name: str) -> str:
        return body(value)

    def distinct(self, a: str) -> str:
        # list_distinct does not keep order
        return self.filter_at(a, lambda x, i: f"list_position({a}, {x}) = {i}", "dx", "di")

    def greatest_of(self, a: str, default: str) -> str:
        return f"coalesce(list_max({a}), {default})"

    def trim(self, x: str, chars: str) -> str:
        return f"trim({x}, {self.lit(chars)})"

    def rtrim(self, x: str, chars: str) -> str:
        return f"rtrim({x}, {self.lit(chars)})"

    def at(self, a: str, k: int) -> str:
        return f"list_extract({a}, {k})"


SPARK, DUCK = Dialect(), Duck()

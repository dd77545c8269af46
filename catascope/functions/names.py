"""Column expressions over catalog names, types, codes and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def lookup(pairs: dict, key: Column) -> Column:
    return F.try_element_at(literal_map(pairs), key)


# --- fixed values: catalog codes, type widths, type aliases, index methods ---
CONSTRAINT_KINDS = {"p": "primary_key", "f": "foreign_key", "u": "unique", "c": "check", "x": "exclusion"}
PARTITION_STRATEGIES = {"r": "range", "l": "list", "h": "hash"}
VOLATILITIES = {"i": "immutable", "s": "stable", "v": "volatile"}
POLICY_COMMANDS = {"r": "SELECT", "a": "INSERT", "w": "UPDATE", "d": "DELETE", "*": "ALL"}
IDENTITIES = {"a": "always", "d": "by default"}
TYPE_WIDTHS = {
    "smallint": 2, "int2": 2, "integer": 4, "int": 4, "int4": 4, "bigint": 8, "int8": 8, "real": 4, "float4": 4, "double precision": 8,
    "float8": 8, "boolean": 1, "bool": 1, "date": 4, "timestamp without time zone": 8, "timestamp": 8, "timestamp with time zone": 8,
    "timestamptz": 8, "uuid": 16, "inet": 19, "cidr": 19, "macaddr": 6, "oid": 4, "numeric": 16, "text": 32, "character varying": 32,
    "varchar": 32, "character": 32, "char": 32, "bpchar": 32, "bytea": 32, "jsonb": 64, "json": 64, "xml": 64,
}
TYPE_ALIASES = {
    "int2": "smallint", "int4": "integer", "int": "integer", "int8": "bigint", "float4": "real", "float8": "double precision",
    "bool": "boolean", "timestamptz": "timestamp with time zone", "timestamp": "timestamp without time zone",
}


def constraint_kind(code: Column) -> Column:
    return lookup(CONSTRAINT_KINDS, code)


def partition_strategy(code: Column) -> Column:
    return lookup(PARTITION_STRATEGIES, code)


def volatility(code: Column) -> Column:
    return F.coalesce(lookup(VOLATILITIES, code), F.lit("volatile"))


def policy_command(code: Column) -> Column:
    return F.coalesce(lookup(POLICY_COMMANDS, code), F.lit("ALL"))


def identity(code: Column) -> Column:
    return lookup(IDENTITIES, code)


def statistics_target(value: Column) -> Column:
    return F.nullif(value, F.lit(-1))


def is_user_object(schema: Column) -> Column:
    return ~schema.isin("pg_catalog", "information_schema", "pg_toast") & ~schema.startswith("pg_temp_") & ~schema.startswith("pg_toast_temp_")


def key_columns(columns: Column, n_keys: Column) -> Column:
    return F.when((n_keys > 0) & (n_keys < F.size(columns)), F.slice(columns, F.lit(1), n_keys)).otherwise(columns)


def include_columns(columns: Column, n_keys: Column) -> Column:
    inside = (n_keys > 0) & (n_keys < F.size(columns))
    return F.when(inside, F.slice(columns, n_keys + 1, F.size(columns))).otherwise(F.array().cast("array<string>"))


def is_snake_case(name: Column) -> Column:
    return name.rlike("^[a-z][a-z0-9_]*$")


def looks_plural(name: Column) -> Column:
    ies = name.endswith("ies")
    return (ies & (name != "series")) | (~ies & name.endswith("s") & ~name.rlike("(?:ss|us|is)$"))


def base_type(name: Column) -> Column:
    """Lower-case type name without modifiers and one pair of array brackets."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"\(.*$", ""), r"\[\]$", ""))


def type_width(name: Column) -> Column:
    """Average bytes of a value, 32 where unknown."""
    return F.coalesce(lookup(TYPE_WIDTHS, base_type(name)), F.lit(32))


def canonical_type(name: Column) -> Column:
    low = F.lower(F.trim(name))
    return F.coalesce(lookup(TYPE_ALIASES, low), low)


def parse_pg_array(text: Column) -> Column:
    """Items of an array text: braces optional, double-quoted items with backslash escapes."""
    body = F.regexp_replace(F.trim(text), r"^\{|\}$", "")
    raw = F.regexp_extract_all(body, F.lit(r'("(?:[^"\\]|\\.)*"|[^,]+)'), F.lit(1))
    unquote = lambda x: F.when(x.startswith('"'), F.regexp_replace(F.substring(x, 2, 1 << 30), r'"$', "")).otherwise(F.rtrim(x))
    return F.transform(raw, lambda x: F.regexp_replace(unquote(F.ltrim(x)), r"\\(.)", "$1"))


def parse_version(text: Column) -> Column:
    """(major, minor, patch) of the first word that starts with a digit and holds a dot."""
    word = F.regexp_extract(text, r"(?:^|\s)([0-9]\S*\.\S*)", 1)
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(F.get(F.split(word, r"\."), F.lit(i)), "^([0-9]+)", 1), F.lit("")).cast("int"), F.lit(0))
    return F.when(word != "", F.struct(part(0).alias("major"), part(1).alias("minor"), part(2).alias("patch")))


def format_bytes(n: Column) -> Column:
    size = lambda power, unit: F.format_string(f"%.1f {unit}", n / float(1 << power))
    return F.when(n >= 1 << 30, size(30, "GB")).when(n >= 1 << 20, size(20, "MB")).when(n >= 1 << 10, size(10, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" bytes")))


def format_number(n: Column) -> Column:
    """Whole number with a comma between thousands."""
    return F.format_number(F.round(n), 0)


def generated(code: Column) -> Column:
    """``s`` is a stored generated column; anything else is not generated."""
    return F.when(code == "s", F.lit("stored"))


def filter_column(condition: Column) -> Column:
    """Column that a filter text starts with: outer parentheses off, first word, what follows the last dot."""
    word = F.regexp_extract(F.regexp_replace(F.trim(condition), r"^\(+", ""), r"^(\S+)", 1)
    last = F.regexp_extract(word, r"([^.]*)$", 1)
    return F.when(last.rlike("^[A-Za-z0-9_]+$"), last)


def index_method(type_name: Column) -> Column:
    low = F.lower(type_name)
    return F.when(low.isin("jsonb", "tsvector"), "gin").when(low.startswith("geometry") | low.startswith("geography") | low.contains("range"), "gist").otherwise("btree")

"""Functions of map, array, struct and JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


class Dict:
    def __init__(self, column: Column) -> None:
        self.c = column

    def __getitem__(self, key) -> Column: return F.try_element_at(self.c, F.lit(key))
    def at(self, key) -> Column:
        """A missing key is an error."""
        return F.when(self.c.isNull() | F.map_contains_key(self.c, key), self[key]).otherwise(F.raise_error(F.lit(f"no key {key!r}")))

    def get(self, key, default=None) -> Column: return F.when(F.map_contains_key(self.c, key), self[key]).otherwise(F.lit(default))
    def contains(self, key) -> Column: return F.map_contains_key(self.c, key)
    def len(self) -> Column: return F.size(self.c)
    def remove(self, key) -> Column: return F.map_filter(self.c, lambda k, v: k != F.lit(key))

    def set(self, key, value) -> Column:
        value = value if isinstance(value, Column) else F.lit(value)
        return F.map_concat(self.remove(key), F.create_map(F.lit(key), value))


class List:
    def __init__(self, column: Column) -> None:
        self.c = column

    def __getitem__(self, k: int) -> Column: return F.get(self.c, k) if k >= 0 else F.try_element_at(self.c, F.lit(k))
    def at(self, k: int) -> Column:
        """A place outside is an error."""
        inside = F.size(self.c) > k if k >= 0 else F.size(self.c) >= -k
        return F.when(self.c.isNull() | inside, self[k]).otherwise(F.raise_error(F.lit(f"no place {k}")))

    def len(self) -> Column: return F.size(self.c)


class Struct:
    def __init__(self, column: Column) -> None:
        self.c = column

    def field(self, *names: str) -> Column:
        out = self.c
        for n in names:
            out = out.getField(n)
        return out


def flatjson(a: Column, paths: dict[str, str], kinds: dict[str, str] | None = None) -> list[Column]:
    """A column for each name and JSON path, cast where a kind is named; what isn't there is missing."""
    kinds = kinds or {}
    return [F.get_json_object(a, path).try_cast(kinds.get(name, "string")).alias(name) for name, path in paths.items()]


def extract_kv(a: Column, keys: list[str], item: str = ",", pair: str = "=") -> list[Column]:
    """A column for each key of text like ``k1=1,k2=3``."""
    entries = F.str_to_map(a, F.lit("\\Q" + item + "\\E"), F.lit("\\Q" + pair + "\\E"))
    return [F.try_element_at(entries, F.lit(k)).alias(k) for k in keys]


def collect_kv(columns: dict[str, Column], item: str = ",", pair: str = "=") -> Column:
    """Text like ``k1=1,k2=3`` of the columns that aren't missing."""
    return F.array_join(F.filter(F.array(*[F.when(c.isNotNull(), F.concat(F.lit(k + pair), c.cast("string"))) for k, c in columns.items()]), lambda x: x.isNotNull()), item)

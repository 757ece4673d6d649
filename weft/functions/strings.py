"""String functions of a text column, named as in ``Series.str``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


class Str:
    """Accessor over one column; every method gives a column."""

    def __init__(self, column: Column) -> None:
        self.c = column

    def lower(self): return F.lower(self.c)
    def upper(self): return F.upper(self.c)
    def len(self): return F.length(self.c)
    def reverse(self): return F.reverse(self.c)

    def capitalize(self) -> Column:
        return F.concat(F.upper(F.substring(self.c, 1, 1)), F.lower(F.substring(self.c, 2, 1 << 30)))

    def title(self) -> Column:
        """Every run of letters starts in upper case and goes on in lower case."""
        return F.array_join(F.transform(F.regexp_extract_all(self.c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")

    def swapcase(self) -> Column:
        return F.array_join(F.transform(F.split(self.c, ""), lambda x: F.when(x == F.upper(x), F.lower(x)).otherwise(F.upper(x))), "")

    def strip(self, chars: str | None = None) -> Column: return self._strip(chars, True, True)
    def lstrip(self, chars: str | None = None) -> Column: return self._strip(chars, True, False)
    def rstrip(self, chars: str | None = None) -> Column: return self._strip(chars, False, True)

    def _strip(self, chars: str | None, left: bool, right: bool) -> Column:
        one = r"\s" if chars is None else "[" + "".join("\\" + c if c in r"\^]-[&" else c for c in chars) + "]"
        pattern = "|".join([f"^{one}+"] * left + [f"{one}+$"] * right)
        return F.regexp_replace(self.c, pattern, "")

    def contains(self, pattern: str, regex: bool = True) -> Column:
        return self.c.rlike(pattern) if regex else self.c.contains(pattern)

    def match(self, pattern: str) -> Column: return self.c.rlike(f"^(?:{pattern})")
    def fullmatch(self, pattern: str) -> Column: return self.c.rlike(f"^(?:{pattern})$")
    def startswith(self, text: str) -> Column: return self.c.startswith(text)
    def endswith(self, text: str) -> Column: return self.c.endswith(text)
    def find(self, text: str) -> Column: return F.locate(text, self.c) - 1

    def rfind(self, text: str) -> Column:
        """Last place, -1 if there is none."""
        back = F.locate(text[::-1], F.reverse(self.c))
        return F.when(back == 0, F.lit(-1)).otherwise(F.length(self.c) - back - (len(text) - 1))

    def count(self, pattern: str) -> Column: return F.regexp_count(self.c, F.lit(pattern))

    def replace(self, pattern: str, to: str, regex: bool = False) -> Column:
        return F.regexp_replace(self.c, pattern, to) if regex else F.replace(self.c, F.lit(pattern), F.lit(to))

    def slice(self, start: int = 0, stop: int | None = None) -> Column:
        size = F.length(self.c)
        at = lambda k: F.lit(k) if k >= 0 else F.greatest(size + k, F.lit(0))
        low = at(start)
        high = size if stop is None else at(stop)
        return self.c.substr(low + 1, F.greatest(high - low, F.lit(0)))

    def get(self, k: int) -> Column:
        size = F.length(self.c)
        inside = size > k if k >= 0 else size >= -k
        return F.when(inside, self.c.substr(F.lit(k + 1) if k >= 0 else size + k + 1, F.lit(1)))

    def pad(self, width: int, side: str = "left", fill: str = " ") -> Column:
        size = F.length(self.c)
        grown = F.lpad(self.c, width, fill) if side == "left" else F.rpad(self.c, width, fill)
        if side == "both":
            gap = F.greatest(F.lit(width) - size, F.lit(0))
            # the odd one goes left if the width is odd, as Python's center does
            left = F.floor(gap / 2) + (gap % 2) * (width % 2)
            grown = F.concat(F.repeat(F.lit(fill), left.cast("int")), self.c, F.repeat(F.lit(fill), (gap - left).cast("int")))
        return F.when(size >= width, self.c).otherwise(grown)

    def ljust(self, width: int, fill: str = " ") -> Column: return self.pad(width, "right", fill)
    def rjust(self, width: int, fill: str = " ") -> Column: return self.pad(width, "left", fill)
    def center(self, width: int, fill: str = " ") -> Column: return self.pad(width, "both", fill)

    def zfill(self, width: int) -> Column:
        """Zeros go after a sign."""
        signed = self.c.rlike("^[+-]")
        rest = F.when(signed, F.substring(self.c, 2, 1 << 30)).otherwise(self.c)
        sign = F.when(signed, F.substring(self.c, 1, 1)).otherwise(F.lit(""))
        fill = F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.length(self.c), F.lit(0)))
        return F.concat(sign, fill, rest)

    def repeat(self, n: int) -> Column: return F.repeat(self.c, n)
    def removeprefix(self, text: str) -> Column: return F.when(self.c.startswith(text), F.substring(self.c, len(text) + 1, 1 << 30)).otherwise(self.c)
    def removesuffix(self, text: str) -> Column: return F.when(self.c.endswith(text), self.c.substr(F.lit(1), F.length(self.c) - len(text))).otherwise(self.c)

    def split(self, by: str | None = None, n: int = -1) -> Column:
        """Pieces as an array; without a separator, words between white space."""
        if by is None:
            return F.regexp_extract_all(self.c, F.lit(r"(\S+)"), F.lit(1))
        return F.split(self.c, _quoted(by), n + 1 if n > 0 else -1)

    def rsplit(self, by: str, n: int = -1) -> Column:
        if n <= 0:
            return self.split(by)
        parts = F.split(self.c, _quoted(by))
        cut = F.greatest(F.size(parts) - n, F.lit(1))
        return F.concat(F.array(F.array_join(F.slice(parts, 1, cut), by)), F.when(F.size(parts) > 1, F.slice(parts, cut + 1, F.lit(n))).otherwise(F.array().cast("array<string>")))

    def partition(self, by: str) -> Column:
        at = F.locate(by, self.c)
        return F.when(at == 0, F.array(self.c, F.lit(""), F.lit(""))).otherwise(F.array(self.c.substr(F.lit(1), at - 1), F.lit(by), self.c.substr(at + len(by), F.length(self.c))))

    def extract(self, pattern: str, group: int = 1) -> Column:
        got = F.regexp_extract(self.c, pattern, group)
        return F.when(self.c.rlike(pattern), got)

    def findall(self, pattern: str) -> Column: return F.regexp_extract_all(self.c, F.lit(f"({pattern})"), F.lit(1))
    def extractall(self, pattern: str, groups: int = 1) -> Column:
        """An array with the groups of each match, as an array."""
        found = [F.regexp_extract_all(self.c, F.lit(pattern), F.lit(g + 1)) for g in range(groups)]
        return F.transform(F.arrays_zip(*[f.alias(f"g{g}") for g, f in enumerate(found)]), lambda z: F.array(*[z[f"g{g}"] for g in range(groups)]))

    def cat(self, *others: Column, sep: str = "") -> Column: return F.concat(*[x for k, o in enumerate([self.c, *others]) for x in ([F.lit(sep)] if k else []) + [o]])
    def join(self, sep: str) -> Column: return F.array_join(F.split(self.c, ""), sep)
    def wrap(self, width: int) -> Column: return F.regexp_replace(self.c, rf"(.{{1,{width}}})(?:\s+|$)", "$1\n")
    def encode(self, charset: str = "UTF-8") -> Column: return F.encode(self.c, charset)
    def decode(self, charset: str = "UTF-8") -> Column: return F.decode(self.c, charset)
    def normalize_space(self) -> Column: return F.trim(F.regexp_replace(self.c, r"\s+", " "))
    def translate(self, source: str, to: str) -> Column: return F.translate(self.c, source, to)

    def _all(self, pattern: str) -> Column: return self.c.rlike(f"^{pattern}+$")
    def isalnum(self) -> Column: return self._all(r"[\p{L}\p{N}]")
    def isalpha(self) -> Column: return self._all(r"\p{L}")
    def isdigit(self) -> Column: return self._all(r"\p{Nd}")
    def isdecimal(self) -> Column: return self._all(r"\p{Nd}")
    def isnumeric(self) -> Column: return self._all(r"\p{N}")
    def isspace(self) -> Column: return self._all(r"\s")
    def islower(self) -> Column: return (self.c == F.lower(self.c)) & (self.c != F.upper(self.c))
    def isupper(self) -> Column: return (self.c == F.upper(self.c)) & (self.c != F.lower(self.c))
    def istitle(self) -> Column: return (self.c == self.title()) & self.c.rlike(r"\p{L}")

"""One definition of a scalar in two dialects: Spark SQL, and the SQL of the check.

A scalar is a function of a dialect that returns SQL text. Regular expressions
keep to what both engines read alike; white space is the Unicode class WS.
"""

from __future__ import annotations

#: Unicode white space as the inside of a character class.
WS = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


class Spark:
    #: Whether a value that is used more than once gets a name; the check's SQL repeats it instead.
    names = True

    def let(self, x: str, name: str, use) -> str:
        """``use`` of a value that is worked out once for each row, however often it is used: a lambda of one element."""
        return f"get(transform(array({x}), {name} -> {use(name)}), 0)"

    def text(self, s: str) -> str:
        return "r'" + s.replace("'", "\\x27") + "'" if "'" not in s else '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'

    def sub(self, x: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by.replace('$', chr(92) + '$').replace(chr(92) + '1', '$1').replace(chr(92) + '2', '$2').replace(chr(92) + '3', '$3'))})"

    def like(self, x: str, pattern: str) -> str:
        return f"({x} rlike {self.text(pattern)})"

    def get(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, {self.text(pattern)}, {group})"

    def every(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.text(pattern)}, 0)"

    def octets(self, x: str) -> str:
        return f"cast(octet_length({x}) as bigint)"

    def chars(self, x: str) -> str:
        return f"cast(char_length({x}) as bigint)"

    def split(self, x: str, sign: str) -> str:
        return f"split({x}, {self.text(chr(92) + 'Q' + sign + chr(92) + 'E') if sign else self.text('')})"

    def map(self, xs: str, var: str, body: str) -> str:
        return f"transform({xs}, {var} -> {body})"

    def keep(self, xs: str, var: str, body: str) -> str:
        return f"filter({xs}, {var} -> {body})"

    def smallest(self, xs: str) -> str:
        return f"array_min({xs})"

    def size(self, xs: str) -> str:
        return f"cast(size({xs}) as bigint)"

    def join(self, xs: str, sign: str) -> str:
        return f"array_join({xs}, {self.text(sign)})"

    def item(self, xs: str, i: int) -> str:
        return f"coalesce(get({xs}, {i}), '')" if i >= 0 else f"coalesce(try_element_at({xs}, {i}), '')"

    def whole(self, x: str) -> str:
        return f"try_cast({x} as bigint)"

    def hex(self, x: str) -> str:
        return f"cast(conv({x}, 16, 10) as bigint)"

    def double(self, x: str) -> str:
        return f"try_cast({x} as double)"

    def replace(self, x: str, old: str, new: str) -> str:
        return f"replace({x}, {self.text(old)}, {self.text(new)})"

    def contains(self, x: str, part: str) -> str:
        return f"contains({x}, {part})"

    def div(self, a: str, b: str) -> str:
        return f"({a} div {b})"

    def atan2(self, y: str, x: str) -> str:
        return f"atan2({y}, {x})"

    def hex2(self, x: str) -> str:
        return f"lower(lpad(hex(cast({x} as bigint)), 2, '0'))"

    def both(self, a: str, b: str) -> str:
        return f"cast(size(array_intersect({a}, {b})) as bigint)"

    def fewer(self, a: str, b: str) -> str:
        return f"cast(size(array_except({a}, {b})) as bigint)"

    def base64(self, x: str) -> str:
        return f"regexp_replace(base64(encode({x}, 'UTF-8')), r'[\\r\\n]', '')"


class Duck(Spark):
    names = False

    def let(self, x, name, use):
        return use(x)

    def text(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def sub(self, x, pattern, by=""):
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)}, 'g')"

    def like(self, x, pattern):
        return f"regexp_matches({x}, {self.text(pattern)})"

    def every(self, x, pattern):
        return f"regexp_extract_all({x}, {self.text(pattern)})"

    def octets(self, x):
        return f"CAST(strlen({x}) AS BIGINT)"

    def chars(self, x):
        return f"CAST(length({x}) AS BIGINT)"

    def split(self, x, sign):
        return f"string_split({x}, {self.text(sign)})"

    def map(self, xs, var, body):
        return f"list_transform({xs}, lambda {var}: {body})"

    def keep(self, xs, var, body):
        return f"list_filter({xs}, lambda {var}: {body})"

    def smallest(self, xs):
        return f"list_min({xs})"

    def size(self, xs):
        return f"CAST(len({xs}) AS BIGINT)"

    def join(self, xs, sign):
        return f"array_to_string({xs}, {self.text(sign)})"

    def item(self, xs, i):
        return f"coalesce({xs}[{i + 1 if i >= 0 else i}], '')"

    def hex(self, x):
        return f"CAST('0x' || {x} AS BIGINT)"

    def whole(self, x):
        return f"TRY_CAST({x} AS BIGINT)"

    def double(self, x):
        return f"TRY_CAST({x} AS DOUBLE)"

    def div(self, a, b):
        return f"({a} // {b})"

    def hex2(self, x):
        return f"lower(lpad(to_hex(CAST({x} AS BIGINT)), 2, '0'))"

    def both(self, a, b):
        return f"CAST(len(list_intersect({a}, {b})) AS BIGINT)"

    def fewer(self, a, b):
        return f"CAST(len(list_filter(list_distinct({a}), lambda z: NOT list_contains({b}, z))) AS BIGINT)"

    def base64(self, x):
        return f"base64(encode({x}))"


SPARK, DUCK = Spark(), Duck()

"""Column expressions over decompiled text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An identifier token whose end after an underscore is six or more hex digits.
ADDRESS_TOKEN = r"(?<![A-Za-z0-9_])([A-Za-z0-9_]*_)[0-9a-fA-F]{6,}(?![A-Za-z0-9_])"
COMMENT = r"(?s)//[^\n]*|/\*.*?(?:\*/|\z)"
#: Words before a star that are no type.
NO_TYPE = ("return", "if", "while", "for", "switch", "case", "break", "continue", "else", "do", "goto")


def normalised_body(c: Column) -> Column:
    """Addresses in identifiers become ``<ADDR>``."""
    return F.regexp_replace(c, ADDRESS_TOKEN, "$1<ADDR>")


def fingerprint(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.md5(normalised_body(c)))


def stripped(c: Column) -> Column:
    """Without comments."""
    return F.regexp_replace(c, COMMENT, "")


def _rest(c: Column) -> Column:
    at = F.instr(c, "{")
    return F.when(at > 0, F.regexp_replace(F.substring(c, at, F.length(c)), r"\s+$", ""))


def is_empty_body(c: Column) -> Column:
    """No brace, an elided body, or nothing but comments; null for null."""
    rest = _rest(c)
    inner = F.regexp_extract(rest, r"(?s)^\{(.*)\}$", 1)
    blank = F.regexp_replace(stripped(inner), r"\s+", "") == ""
    return F.when(c.isNotNull(), rest.isNull() | rest.isin("{...}", "{ ... }") | ~rest.rlike(r"(?s)^\{.*\}$") | blank)


def reads_wild_pointer(c: Column) -> Column:
    """Whether a local pointer is declared and dereferenced but never assigned; null for null."""
    lines = F.split(c, "\n")
    declared = F.filter(
        F.transform(lines, lambda x: F.struct(
            F.regexp_extract(x, r"^\s*[^=(,;]*?([\w\[\]:<>&]+)\s*(?:\*\s*)+(?:[A-Za-z_]\w*)\s*;\s*$", 1).alias("t"),
            F.regexp_extract(x, r"^\s*[^=(,;]*?[\w\[\]:<>&]+\s*(?:\*\s*)+([A-Za-z_]\w*)\s*;\s*$", 1).alias("n"),
        )),
        lambda s: (s["n"] != "") & ~s["t"].isin(*NO_TYPE),
    )
    names = F.array_distinct(F.transform(declared, lambda s: s["n"]))

    def wild(n: Column) -> Column:
        # the declaration itself is a line that ends after the name
        others = F.filter(lines, lambda x: ~F.regexp_like(x, F.concat(F.lit(r"\*\s*"), n, F.lit(r"\s*;\s*$"))) | x.rlike(r"[=(,]"))
        word = F.concat(F.lit(r"(?<!\w)"), n, F.lit(r"(?!\w)"))
        assigned = F.exists(others, lambda x: F.regexp_like(x, F.concat(F.lit(r"(?:^|[^*\s])\s*"), word, F.lit(r"\s*=(?!=)"))))
        used = F.exists(others, lambda x: F.regexp_like(x, F.concat(F.lit(r"\*\s*"), word)) | F.regexp_like(x, F.concat(word, F.lit("->"))))
        return used & ~assigned

    return F.exists(names, wild)


def is_degenerate(c: Column) -> Column:
    return F.when(is_empty_body(c), True).otherwise(reads_wild_pointer(F.regexp_extract(_rest(c), r"(?s)^\{(.*)\}$", 1)))


def first_parameter(c: Column) -> Column:
    """Name of the first parameter in the header, null for none or void."""
    inside = F.regexp_extract(c, r"(?s)^[^{(]*\(([^{]*)\)[^{)]*\{", 1)
    head = F.trim(F.split(inside, ",")[0])
    return F.when((head != "") & (head != "void"), F.regexp_extract(head, r"([^ *]+)[ *]*$", 1))


def own_slots(body: Column, name: Column) -> Column:
    """How many different slots of the object in parameter ``name`` a body touches."""
    text = F.regexp_extract(body, r"(?s)(\{.*)$", 1)
    array = F.transform(F.regexp_extract_all(text, F.concat(name, F.lit(r"\[([^\]]*)\]")), 1), lambda x: F.trim(x))
    plus = F.transform(F.regexp_extract_all(text, F.concat(name, F.lit(r" \+ ([0-9a-fA-Fx]+)")), 1), lambda x: F.concat(F.lit("+"), x))
    star = F.when(F.regexp_like(text, F.concat(F.lit(r"\*"), name, F.lit(r"(?![A-Za-z0-9_\[])"))), F.array(F.lit("*"))).otherwise(F.array().cast("array<string>"))
    return F.when(name.isNotNull() & (name != ""), F.size(F.array_distinct(F.concat(array, plus, star)))).otherwise(0)


def words(c: Column) -> Column:
    """Distinct lower-case words of camelCase and digit boundaries, longer than two and not all digits."""
    apart = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), "([A-Za-z])([0-9])", "$1 $2"), "([0-9])([A-Za-z])", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(apart), "[^a-z0-9]+"), lambda x: (F.length(x) > 2) & ~x.rlike("^[0-9]+$")))


def int_literal(c: Column) -> Column:
    """A whole number in decimal or, after 0x, in hex; null beyond 64 bits."""
    t = F.trim(c)
    hexa = F.regexp_extract(t, r"^0[xX]0*([0-9a-fA-F]{1,16})$", 1)
    small = (F.length(hexa) < 16) | hexa.rlike("^[0-7]")
    return F.when(hexa != "", F.when(small, F.conv(hexa, 16, 10).try_cast("bigint"))).when(t.rlike(r"^-?\d+$"), t.try_cast("bigint"))


def symbol_address(c: Column) -> Column:
    """The address in a symbol's name: the last part between underscores that is all hex, null if it is a short decimal."""
    parts = F.filter(F.split(c, "_"), lambda x: x.rlike("^[0-9a-fA-F]+$"))
    last = F.when(F.size(parts) > 0, F.element_at(parts, -1))
    return F.when(~last.rlike("^[0-9]{1,5}$"), F.concat(F.lit("0x"), F.lower(last)))


def top_level(c: Column, mark: str = "\x01") -> Column:
    """The parts between commas outside any brackets, trimmed; none for a blank text."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        depth = s["depth"] + F.when(x.isin("(", "[", "{", "<"), 1).when(x.isin(")", "]", "}", ">"), -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.concat(s["out"], F.when((x == ",") & (depth <= 0), mark).otherwise(x)).alias("out"))

    nested = F.aggregate(F.split(c, ""), start, step)["out"]
    parts = F.transform(F.split(F.when(c.rlike(r"[(\[{<]"), nested).otherwise(F.replace(c, F.lit(","), F.lit(mark))), mark), lambda x: F.trim(x))
    return F.when(F.trim(c) == "", F.array().cast("array<string>")).otherwise(parts)

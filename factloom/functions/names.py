"""Column expressions that bring addresses, predicates, class names and values to one spelling.

All are built-in expressions, so they stay inside generated code.  Null in, null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that only say that nothing is known (compared trimmed, in lower case).
NOTHING_KNOWN = (
    "?", "-", "--", "---", "n/a", "na", "none", "null", "nil", "unknown", "<unknown>",
    "(unknown)", "<none>", "not determined", "undetermined", "not known", "not available", "tbd",
)
#: Spellings of yes and no.
YES = ("true", "t", "yes", "y", "1", "on")
NO = ("false", "f", "no", "n", "0", "off")


def squeeze(c: Column) -> Column:
    """Without white space at either end (tabs and line ends included)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def canonical_address(c: Column) -> Column:
    """``0x`` and lower-case hex without leading zeros; null if the text is no address.

    Reads ``0x1F``, ``0X1f``, ``1fh``, ``00000001`403a2390`` and padded forms.
    """
    t = F.lower(F.regexp_replace(c, r"[\s`_]", ""))
    digits = F.regexp_extract(t, r"^(?:0x)?0*([0-9a-f]+)h?$", 1)
    return F.when(c.rlike("^0x[1-9a-f][0-9a-f]*$"), c).when(digits != "", F.concat(F.lit("0x"), digits))


def address_or_text(c: Column) -> Column:
    """The canonical address, or the trimmed text where it is none."""
    return F.coalesce(canonical_address(c), squeeze(c))


def canonical_predicate(c: Column) -> Column:
    """snake_case of any of ``hasName``, ``HAS_NAME``, ``has-name``, `` has_name ``."""
    t = F.regexp_replace(squeeze(c), r"([a-z0-9])([A-Z])", "$1_$2")
    return F.when(c.rlike("^[a-z0-9_]+$"), c).otherwise(F.lower(F.regexp_replace(t, r"[\s\-]+", "_")))


def _decode_lengths(t: Column) -> Column:
    """``4core3Foo`` to ``core::Foo``: each part is preceded by its length."""
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(F.regexp_extract_all(t, F.lit(r"(\d+)"), 1))))
    start = F.struct(t.alias("rest"), F.lit("").alias("out"))

    def step(s: Column, _: Column) -> Column:
        n = F.regexp_extract(s["rest"], r"^(\d+)", 1)
        body = F.substring(s["rest"], F.length(n) + 1, F.length(s["rest"]))
        size = F.coalesce(n.try_cast("int"), F.lit(0))
        part = F.substring(body, F.lit(1), size)
        joined = F.when(s["out"] == "", part).otherwise(F.concat(s["out"], F.lit("::"), part))
        going = size > 0
        return F.struct(
            F.when(going, F.substring(body, size + 1, F.length(body))).otherwise(s["rest"]).alias("rest"),
            F.when(going, joined).otherwise(s["out"]).alias("out"),
        )

    end = F.aggregate(rounds, start, step)
    return F.when(end["rest"].isin("", "E"), end["out"])


def canonical_class(c: Column) -> Column:
    """``ns::Name`` without keyword, blanks, leading ``::`` or type-name encoding; null if blank."""
    t = F.regexp_replace(squeeze(c), r"^(?:(?:class|struct|union|enum|public|protected|private|virtual|typename|const)\s+)+", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\s*::\s*", "::"), r"^(?:::)+", "")
    encoded = F.regexp_extract(t, r"^(?:_*Z?T[ISV])?N?(\d+[A-Za-z_].*)$", 1)
    at = F.regexp_extract(t, r"^\.?\?A[VUT](.+?)@*$", 1)
    plain = F.when(t != "", t)
    return (
        F.when(t.rlike(r"^(?:_*Z?T[ISV])?N?\d+[A-Za-z_]"), F.coalesce(_decode_lengths(encoded), plain))
        .when(at != "", F.array_join(F.reverse(F.split(at, "@")), "::"))
        .otherwise(plain)
    )


def says_something(c: Column) -> Column:
    """True if the text is not null, not blank and no mere mark that nothing is known."""
    t = F.lower(squeeze(c))
    return F.coalesce((t != "") & ~t.isin(*NOTHING_KNOWN), F.lit(False))


def text_or_null(c: Column) -> Column:
    t = squeeze(c)
    return F.when(t != "", t)


def yes_no(c: Column) -> Column:
    """1 or 0, null for anything that is neither."""
    t = F.lower(squeeze(c))
    return F.when(t.isin(*YES), F.lit(1)).when(t.isin(*NO), F.lit(0))


def whole_bytes(c: Column) -> Column:
    """A whole number of bytes from ``42``, ``0x2A``, ``2ah``, ``4,096``, ``16 B``, ``8 bytes``, ``2.0``, ``2 KiB``."""
    t = F.lower(squeeze(c))
    t = F.regexp_replace(t, r"^(\d[\d,_.' ]*?|0x[0-9a-f]+(?=\s))\s*(?:bytes?|b)$", "$1")
    hexa = F.regexp_extract(t, r"^0x([0-9a-f]{1,15})$", 1)
    hexh = F.regexp_extract(t, r"^([0-9][0-9a-f]{0,14})h$", 1)
    digits = F.when(hexa != "", hexa).when(hexh != "", hexh)
    unit = F.regexp_extract(t, r"([kmg])ib$", 1)
    factor = F.when(unit == "k", 1024).when(unit == "m", 1024**2).when(unit == "g", 1024**3).otherwise(1)
    bare = F.regexp_replace(t, r"\s*[kmg]ib$", "")
    whole = F.regexp_extract(bare, r"^\+?(\d{1,18}|\d{1,3}(?:[,_' ]\d{3}){1,5})(?:\.0*)?$", 1)
    number = F.regexp_replace(whole, r"[^0-9]", "").try_cast("bigint")
    return F.coalesce(F.conv(digits, 16, 10).try_cast("bigint"), number * factor)

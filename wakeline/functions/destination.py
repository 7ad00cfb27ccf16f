"""Column functions on the free text that crews enter as destination."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that become spaces.
MARKS = ",.-/_$#!:?;'&^()*[]{}%=+`~<>\"\n\r\\"
#: White space in the wide sense (what Java's \s leaves out is listed).
SPACE = r"[\s\u001c-\u001f\u0085   -     　]"
#: Texts that say nothing about a port.
NOISE = (
    "(((open|high|opl|(out)*[ ]*at)*[ ]*(seas*))|(a*wait(ing)*))*[ ]*((f(o|0)r|to)*[ ]*order[a-z]*)*",
    "(pacific|atlantic|pax|pan)*[ ]*ocean[ ]*(ographic|apex|patriot)*",
    "(arm(ed)* *guards*)* *(ob|on *board)*",
    "(aeb|aep|asp|awp|pbg|pebg|pgb|pjs|psb|pwbg)+ *(a|b|c|d|g|p)*",
    "eopl|(east *)*opl|opl drifting|out *side|avoid typhoon|buoy|terminal|shipyard|sea( |-)*(trial|front)",
    "driftin*g for sch*edule",
)
#: Country prefixes of the export groups.
COUNTRY_GROUPS = {
    "gr_ro_bg_cy_mt": "GR RO BG CY MT",
    "au_nz_pg_fj": "AU NZ PG FJ",
    "nl_be": "NL BE",
    "dk_no_se": "DK NO SE",
    "de_pl_ru_fi_lv_lt_ee": "DE PL RU FI LV LT EE",
    "es_pt_gi": "ES PT GI",
    "in": "IN",
    "it_hr_si": "IT HR SI",
    "gb_ie_is": "GB IE IS",
    "ca": "CA",
    "us": "US",
}


def normalised(text: Column) -> Column:
    """Lower case, marks as spaces, single spaces, none at the ends."""
    marks = "[" + "".join(f"\\{c}" for c in MARKS if c not in "\n\r") + "\n\r]"
    return F.trim(F.regexp_replace(F.lower(text), f"(?:{marks}|{SPACE})+", " "))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def clean_destination(text: Column) -> Column:
    """The part of the text that names the port, normalised; null for null.

    Long texts end at a double quote. Where `>` points to the destination, the
    last part with three letters or more counts, and two letters before a last
    part of three are its country.
    """
    t = F.when((F.length(text) > 30) & F.contains(text, F.lit('"')), F.substring_index(text, '"', 1)).otherwise(text)
    right, left = F.instr(t, ">"), F.instr(t, "<")
    parts = F.split(t, ">", -1)
    clean = F.transform(parts, normalised)
    named = F.filter(F.reverse(clean), lambda x: F.length(F.replace(x, F.lit(" "), F.lit(""))) >= 3)
    picked = F.coalesce(F.get(named, F.lit(0)), F.get(clean, F.lit(0)))
    last, country = F.get(clean, F.lit(1)), stripped(F.get(parts, F.lit(0)))
    glued = (F.size(parts) == 2) & (F.length(last) == 3) & ~F.contains(last, F.lit(" ")) & (F.length(country) == 2)
    arrow = F.when(glued, F.concat(F.lower(country), last)).otherwise(picked)
    return F.when((right > 0) & ((left == 0) | (left > right)), arrow).otherwise(normalised(t))


def is_valid_destination(text: Column) -> Column:
    """Whether text is there and three characters or more are left of it, spaces counted."""
    return F.coalesce(F.length(clean_destination(text)) >= 3, F.lit(False))


def noise_full(clean: Column, patterns: Sequence[str] = NOISE) -> Column:
    """Whether one pattern takes the whole text."""
    d = F.lower(clean)
    return F.array_contains(F.array(*(F.regexp_extract(d, p, 0) == d for p in patterns)), True)


def noise_part(clean: Column, patterns: Sequence[str] = NOISE) -> Column:
    """Whether one pattern takes something of the text that is not blank."""
    d = F.lower(clean)
    return F.array_contains(F.array(*(F.exists(F.regexp_extract_all(d, F.lit(p), F.lit(0)), lambda x: F.trim(x) != "") for p in patterns)), True)


def last_word(clean: Column) -> Column:
    return F.substring_index(F.trim(clean), " ", -1)


def is_numeric_text(clean: Column) -> Column:
    """Whether cleaned text reads as a number."""
    return F.trim(clean).rlike(r"^(?:\d+(?:e\d+)?|nan|inf(?:inity)?)$")


def code_candidates(clean: Column) -> Column:
    """Array of candidate codes, in the order to try them."""
    d = F.trim(clean)
    words = F.split(d, " ")
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    one = F.when(F.length(d) == 5, F.array(F.concat(F.substring(d, 4, 2), F.substring(d, 1, 3)), d)).otherwise(words)
    two = (
        F.when((F.length(first) == 2) & (F.length(second) == 3), F.array(F.concat(first, second)))
        .when((F.length(first) == 3) & (F.length(second) == 2), F.array(F.concat(second, first)))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.when(F.size(words) == 1, one).when(F.size(words) == 2, two).otherwise(F.reverse(words))


def country_prefix(code: Column) -> Column:
    return F.substring(code, 1, 2)


def country_group(code: Column) -> Column:
    """The export group of a five-character code by its country; null for all others."""
    group = F.lit(None).cast("string")
    for name, countries in reversed(COUNTRY_GROUPS.items()):
        group = F.when(country_prefix(code).isin(*countries.split()), name).otherwise(group)
    return F.when(F.length(code) == 5, group)


def sanitised_code(code: Column) -> Column:
    return F.regexp_replace(code, "[^a-zA-Z0-9]", "")

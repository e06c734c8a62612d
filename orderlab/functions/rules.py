"""Rule tables for the free-text order-line fields (T1-T10) and their compilers.

Every rule is data: an ordered list of (pattern, output) pairs where the first
match wins.  ``*_col`` builders compile a table into one nested CASE expression
(``F.when`` chain) so the whole cascade stays inside whole-stage codegen; no
Python runs per row.  ``*_sql`` builders emit the same cascade as ANSI SQL text
for the DuckDB oracle.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the reference's tables for equal results;
# they are stated here as plain text, in their original order.
# ---------------------------------------------------------------------------

TOPS_KEYWORDS = [
    "game jersey", "game tee", "away jersey", "home jersey",
    "3rd kit jersey", "3rd jersey", "kit tee",
    "temporary jersey", "temporary home jersey", "temporary away jersey",
    "temporary 3rd jersey", "temporary uniform",
]
BOTTOMS_KEYWORDS = [
    "game short", "away short", "home short",
    "3rd kit short", "3rd short",
    "temporary short", "temporary home short", "temporary away short",
    "temporary adidas short", "temporary home game adidas short",
    "temporary away game adidas short",
]
SOCKS_KEYWORDS = [
    "game sock", "away sock", "home sock",
    "copa zone", "3rd kit sock", "3rd sock",
    "temporary sock", "temporary home sock", "temporary away sock",
    "temporary navi sock", "temporary navy sock",
    "temporary white sock", "temporary red sock", "temporary black sock",
]
EXCLUDE_KEYWORDS = [
    "practice", "training", "hoodie", "hoody", "jacket", "polo",
    "backpack", "ball", "camp", "shoe", "pump", "hat", "beanie",
    "crew", "pant", "water bottle", "hydroflask", "sackpack", "bib",
    "1/4 zip", "quarter zip", "bracelet", "hair bow", "metro",
    "goal keeper", "goalkeeper", "gk ",
]

WOMEN_PATTERNS = ["women", "womens", "women's", "girls"]

# Size phrase table, searched by substring in this order (first match wins).
SIZE_PHRASES = [
    ("youth xs", "YXS"), ("youth xsmall", "YXS"), ("youth x-small", "YXS"),
    ("youth s", "YS"), ("youth small", "YS"),
    ("youth m", "YM"), ("youth medium", "YM"), ("youth med", "YM"),
    ("youth l", "YL"), ("youth large", "YL"),
    ("youth xl", "YXL"), ("youth x-large", "YXL"),
    ("adult s", "AS"), ("adult small", "AS"), ("men s", "AS"), ("men's s", "AS"),
    ("adult m", "AM"), ("adult medium", "AM"), ("adult med", "AM"),
    ("men m", "AM"), ("men's m", "AM"),
    ("adult l", "AL"), ("adult large", "AL"), ("men l", "AL"), ("men's l", "AL"),
    ("adult xl", "AXL"), ("adult x-large", "AXL"),
    ("adult xxl", "AXXL"), ("adult xx-large", "AXXL"),
    ("women xs", "WXS"), ("women's xs", "WXS"), ("woman xs", "WXS"),
    ("women s", "WS"), ("women's s", "WS"), ("woman s", "WS"),
    ("women m", "WM"), ("women's m", "WM"), ("woman m", "WM"),
    ("women l", "WL"), ("women's l", "WL"), ("woman l", "WL"),
    ("women xl", "WXL"), ("women's xl", "WXL"), ("woman xl", "WXL"),
    ("women xsmall", "WXS"), ("women small", "WS"), ("women medium", "WM"),
    ("women large", "WL"), ("women xlarge", "WXL"),
    ("woman xsmall", "WXS"), ("woman small", "WS"), ("woman medium", "WM"),
    ("woman large", "WL"), ("woman xlarge", "WXL"),
]

# Whole-token size codes (case-insensitive).
DIRECT_SIZE_CODES = {
    "yxs": "YXS", "ys": "YS", "ym": "YM", "yl": "YL", "yxl": "YXL",
    "as": "AS", "am": "AM", "al": "AL", "axl": "AXL", "axs": "AS",
    "axxl": "AXXL", "2xl": "AXXL",
    "wxs": "WXS", "ws": "WS", "wm": "WM", "wl": "WL", "wxl": "WXL",
}
SIZE_CODE_REGEX = r"\b(yxs|ys|ym|yl|yxl|axxl|axl|as|am|al|wxs|ws|wm|wl|wxl)\b"
SIZE_WORD_REGEX = r"\b(x-?small|small|medium|large|x-?large|xlarge)\b"
SIZE_WORDS = {
    "xsmall": "AS", "x-small": "AS", "small": "AS",
    "medium": "AM", "large": "AL",
    "xlarge": "AXL", "x-large": "AXL",
}
SIZE_LETTER_REGEX = r"\b(xxl|xl|xs|s|m|l)\b"
SIZE_LETTERS = {"XS": "AS", "S": "AS", "M": "AM", "L": "AL", "XL": "AXL", "XXL": "AXXL"}
UNKNOWN_SIZE = "UNKNOWN"

COLORS = [
    "navy", "white", "black", "red", "royal", "yellow", "green",
    "sky blue", "scuba blue", "orange", "pink", "purple", "grey", "gray",
    "neon green", "neon orange", "neon yellow",
]

NUMBER_CUSTOM_REGEX = r"add number.*?for.*?\$"
NUMBER_DIGITS_REGEX = r"#\s*(\d+)"

# Season by order month (P12) and the uniform-set month fallback.
FALL_MONTHS = (7, 8, 9, 10)
WINTER_MONTHS = (11, 12, 1, 2)
SPRING_MONTHS = (3, 4, 5, 6)

# The 14 default sizes, in catalogue order (youth, adult men, women).
DEFAULT_SIZES = ["YXS", "YS", "YM", "YL", "YXL", "AS", "AM", "AL", "AXL",
                 "WXS", "WS", "WM", "WL", "WXL"]
CATEGORIES = ["top", "bottom", "socks"]
SEASONS = ["fall", "winter", "spring"]

# Ordinal feature maps (T9): size rank (missing -> 7) and season number (missing -> 0).
SIZE_RANK = {"yxs": 1, "ys": 2, "ym": 3, "yl": 4, "yxl": 5, "wxs": 6, "ws": 7, "wm": 8,
             "wl": 9, "wxl": 10, "as": 11, "am": 12, "al": 13, "axl": 14}
SIZE_RANK_DEFAULT = 7
SEASON_NUM = {"fall": 1, "winter": 2, "spring": 3, "cfa": 4}
SEASON_NUM_DEFAULT = 0


@dataclass(frozen=True)
class CategoryRules:
    """First-match cascade: exclusions, then socks, bottoms, tops."""

    exclude: list = field(default_factory=lambda: list(EXCLUDE_KEYWORDS))
    ordered: list = field(default_factory=lambda: [("socks", list(SOCKS_KEYWORDS)),
                                                   ("bottom", list(BOTTOMS_KEYWORDS)),
                                                   ("top", list(TOPS_KEYWORDS))])


REFERENCE_CATEGORY_RULES = CategoryRules()


def corrected_size_phrases() -> list:
    """Q4 option: phrases sorted longest first, so 'women s' wins over 'men s'."""
    return sorted(SIZE_PHRASES, key=lambda kv: -len(kv[0]))


# ---------------------------------------------------------------------------
# Spark column builders
# ---------------------------------------------------------------------------

def _any_contains(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def _map_lit(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def classify_product_col(name: Column, rules: CategoryRules = REFERENCE_CATEGORY_RULES,
                         low: Column | None = None) -> Column:
    """Product name -> category or NULL (case-insensitive substring cascade).

    Pass ``low`` = lower(name) when it is already projected: the cascade tests
    it dozens of times and Spark does not share subexpressions across CASE
    branches."""
    low = F.lower(name) if low is None else low
    # one quoted-literal alternation per class: when Catalyst pushes the
    # "category is not null" filter below the projection it inlines ``low``
    # once per class instead of once per keyword
    expr = F.when(low.rlike(_literal_alternation(rules.exclude)), F.lit(None).cast("string"))
    for label, words in rules.ordered:
        expr = expr.when(low.rlike(_literal_alternation(words)), F.lit(label))
    return expr.otherwise(F.lit(None).cast("string"))


def _literal_alternation(words) -> str:
    """Java regex matching any of the words as a literal substring."""
    return "(?:" + "|".join(r"\Q" + w + r"\E" for w in words) + ")"


def season_col(month: Column) -> Column:
    """7-10 fall, 11-2 winter, anything else (NULL included) spring."""
    return (F.when(month.isin(*FALL_MONTHS), "fall")
            .when(month.isin(*WINTER_MONTHS), "winter").otherwise("spring"))


def uniform_set_col(name: Column, month: Column, low: Column | None = None) -> Column:
    """Season word in the name, else 'cfa' prefix, else month, else unknown."""
    low = F.lower(name) if low is None else low
    return (F.when(low.contains("fall"), "fall")
            .when(low.contains("winter"), "winter")
            .when(low.contains("spring"), "spring")
            .when(low.startswith("cfa"), "cfa")
            .when(month.isin(*FALL_MONTHS), "fall")
            .when(month.isin(*WINTER_MONTHS), "winter")
            .when(month.isin(*SPRING_MONTHS), "spring")
            .otherwise("unknown"))


def gender_age_col(name: Column, low: Column | None = None) -> Column:
    """Womens when any women pattern occurs, else mens_youth."""
    low = F.lower(name) if low is None else low
    return F.when(_any_contains(low, WOMEN_PATTERNS), "womens").otherwise("mens_youth")


def size_col(variant: Column, phrases: list | None = None, low: Column | None = None) -> Column:
    """T4: variant text -> size code, seven ordered steps, UNKNOWN at the end.

    ``low`` = lower(trim(variant)) when already projected."""
    phrases = SIZE_PHRASES if phrases is None else phrases
    low = F.lower(F.trim(variant)) if low is None else low
    codes = _map_lit(DIRECT_SIZE_CODES)
    # step 2: first '/'- or ','-separated part that is, once stripped, a size
    # code; array_intersect keeps the order of the parts.  Only strings with a
    # separator need it.
    parts = F.split(low, r"\s*[/,]\s*")
    first_code_part = F.try_element_at(
        F.array_intersect(parts, F.array(*[F.lit(k) for k in DIRECT_SIZE_CODES])), F.lit(1))
    step2 = F.when(low.contains("/") | low.contains(","), F.try_element_at(codes, first_code_part))
    phrase = first_contained(low, phrases)
    code_tok = F.regexp_extract(low, SIZE_CODE_REGEX, 1)
    word_tok = F.regexp_extract(low, SIZE_WORD_REGEX, 1)
    letter_tok = F.upper(F.regexp_extract(low, SIZE_LETTER_REGEX, 1))
    # coalesce evaluates the steps lazily and each at most once (a CASE would
    # evaluate a step in its condition and again for its value)
    return F.when(variant.isNull(), F.lit(UNKNOWN_SIZE)).otherwise(F.coalesce(
        F.try_element_at(codes, low),
        step2,
        phrase,
        F.try_element_at(codes, code_tok),
        F.try_element_at(_map_lit(SIZE_WORDS), word_tok),
        F.try_element_at(_map_lit(SIZE_LETTERS), letter_tok),
        F.lit(UNKNOWN_SIZE)))


def first_contained(low: Column, table: list) -> Column:
    """Output of the first (pattern, output) pair whose pattern occurs in
    ``low``, in table order; NULL when none does.

    The table is one literal array scanned by ``filter``: long cascades
    written as CASE chains are inlined into the fused stage and push the
    generated method past the JVM's 64 KB limit (Spark then falls back to
    interpreted evaluation for the whole stage)."""
    arr = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(o).alias("o")) for p, o in table])
    hit = F.try_element_at(F.filter(arr, lambda e: low.contains(e["p"])), F.lit(1))
    return hit["o"]


def _colors_by_length():
    # longest phrase first; Python's sort is stable, so ties keep list order
    return sorted(COLORS, key=len, reverse=True)


def color_col(name: Column, low: Column | None = None) -> Column:
    """T5: longest colour phrase contained in the name, title case, else Unknown."""
    low = F.lower(name) if low is None else low
    return F.coalesce(first_contained(low, [(c, c.title()) for c in _colors_by_length()]), F.lit("Unknown"))


def number_col(variant: Column, low: Column | None = None) -> Column:
    """Jersey number from the variant: NULL, 'custom' or the digits after '#'."""
    low = F.lower(variant) if low is None else low
    digits = F.regexp_extract(variant, NUMBER_DIGITS_REGEX, 1)
    null = F.lit(None).cast("string")
    return (F.when(variant.isNull(), null)
            .when(low.contains("no number"), null)
            .when(low.contains("with name & number") | low.contains("with name and number"), "custom")
            .when(low.contains("with name, no number"), null)
            .when(low.rlike(NUMBER_CUSTOM_REGEX), "custom")
            .when(digits != "", digits)
            .otherwise(null))


def item_key_col(category: Column, gender: Column, size: Column) -> Column:
    """lower(category_gender_size); a NULL part renders as the text 'none'
    would in the reference's f-string, so NULLs are spelled out explicitly."""
    parts = [F.coalesce(c.cast("string"), F.lit("None")) for c in (category, gender, size)]
    return F.lower(F.concat_ws("_", *parts))


def size_group_col(size: Column) -> Column:
    """First letter y -> youth, w -> women, else adult_men."""
    low = F.lower(size)
    return F.when(low.startswith("y"), "youth").when(low.startswith("w"), "women").otherwise("adult_men")


def size_rank_col(size: Column) -> Column:
    """Ordinal size rank (1-14), default 7."""
    return F.coalesce(F.try_element_at(_map_lit(SIZE_RANK), F.lower(size)), F.lit(SIZE_RANK_DEFAULT))


def season_num_col(season: Column) -> Column:
    """Season number 1-4, default 0."""
    return F.coalesce(F.try_element_at(_map_lit(SEASON_NUM), F.lower(season)), F.lit(SEASON_NUM_DEFAULT))


def lifecycle_year_col(year: Column, first_period_years) -> Column:
    """1 for the listed years, else 2."""
    return F.when(year.isin(*list(first_period_years)), 1).otherwise(2)


# ---------------------------------------------------------------------------
# SQL text builders (the same tables, for the DuckDB oracle)
# ---------------------------------------------------------------------------

def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any_contains_sql(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {_q(w)})" for w in words) + ")"


def classify_product_sql(name: str, rules: CategoryRules = REFERENCE_CATEGORY_RULES) -> str:
    low = f"lower({name})"
    s = f"CASE WHEN {_any_contains_sql(low, rules.exclude)} THEN NULL "
    for label, words in rules.ordered:
        s += f"WHEN {_any_contains_sql(low, words)} THEN {_q(label)} "
    return s + "ELSE NULL END"


def season_sql(month: str) -> str:
    return (f"CASE WHEN {month} IN {FALL_MONTHS} THEN 'fall' "
            f"WHEN {month} IN {WINTER_MONTHS} THEN 'winter' ELSE 'spring' END")


def uniform_set_sql(name: str, month: str) -> str:
    low = f"lower({name})"
    return (f"CASE WHEN contains({low}, 'fall') THEN 'fall' WHEN contains({low}, 'winter') THEN 'winter' "
            f"WHEN contains({low}, 'spring') THEN 'spring' WHEN starts_with({low}, 'cfa') THEN 'cfa' "
            f"WHEN {month} IN {FALL_MONTHS} THEN 'fall' WHEN {month} IN {WINTER_MONTHS} THEN 'winter' "
            f"WHEN {month} IN {SPRING_MONTHS} THEN 'spring' ELSE 'unknown' END")


def gender_age_sql(name: str) -> str:
    return f"CASE WHEN {_any_contains_sql(f'lower({name})', WOMEN_PATTERNS)} THEN 'womens' ELSE 'mens_youth' END"


def _map_case(x: str, d: dict) -> str:
    return "CASE " + " ".join(f"WHEN {x} = {_q(k)} THEN {_q(v)}" for k, v in d.items()) + " ELSE NULL END"


def size_sql(variant: str, phrases: list | None = None) -> str:
    phrases = SIZE_PHRASES if phrases is None else phrases
    low = f"lower(trim({variant}))"
    parts = f"list_transform(regexp_split_to_array({low}, '[/,]'), lambda p: trim(p))"
    first = f"list_filter({parts}, lambda p: p IN ({', '.join(_q(k) for k in DIRECT_SIZE_CODES)}))[1]"
    phrase = "CASE " + " ".join(f"WHEN contains({low}, {_q(p)}) THEN {_q(o)}" for p, o in phrases) + " ELSE NULL END"
    code_tok = f"regexp_extract({low}, {_q(SIZE_CODE_REGEX)}, 1)"
    word_tok = f"regexp_extract({low}, {_q(SIZE_WORD_REGEX)}, 1)"
    letter_tok = f"upper(regexp_extract({low}, {_q(SIZE_LETTER_REGEX)}, 1))"
    return (f"CASE WHEN {variant} IS NULL THEN 'UNKNOWN' "
            f"WHEN ({_map_case(low, DIRECT_SIZE_CODES)}) IS NOT NULL THEN {_map_case(low, DIRECT_SIZE_CODES)} "
            f"WHEN ({first}) IS NOT NULL THEN {_map_case(first, DIRECT_SIZE_CODES)} "
            f"ELSE coalesce({phrase}, {_map_case(code_tok, DIRECT_SIZE_CODES)}, "
            f"CASE WHEN {word_tok} <> '' THEN coalesce({_map_case(word_tok, SIZE_WORDS)}, 'UNKNOWN') END, "
            f"CASE WHEN {letter_tok} <> '' THEN coalesce({_map_case(letter_tok, SIZE_LETTERS)}, 'UNKNOWN') END, "
            f"'UNKNOWN') END")


def color_sql(name: str) -> str:
    low = f"lower({name})"
    return "CASE " + " ".join(f"WHEN contains({low}, {_q(c)}) THEN {_q(c.title())}"
                              for c in _colors_by_length()) + " ELSE 'Unknown' END"


def number_sql(variant: str) -> str:
    low = f"lower({variant})"
    digits = f"regexp_extract({variant}, {_q(NUMBER_DIGITS_REGEX)}, 1)"
    return (f"CASE WHEN {variant} IS NULL THEN NULL WHEN contains({low}, 'no number') THEN NULL "
            f"WHEN contains({low}, 'with name & number') OR contains({low}, 'with name and number') THEN 'custom' "
            f"WHEN contains({low}, 'with name, no number') THEN NULL "
            f"WHEN regexp_matches({low}, {_q(NUMBER_CUSTOM_REGEX)}) THEN 'custom' "
            f"WHEN {digits} <> '' THEN {digits} ELSE NULL END")


def size_group_sql(size: str) -> str:
    return (f"CASE WHEN starts_with(lower({size}), 'y') THEN 'youth' "
            f"WHEN starts_with(lower({size}), 'w') THEN 'women' ELSE 'adult_men' END")


def size_rank_sql(size: str) -> str:
    return ("coalesce(CASE " + " ".join(f"WHEN lower({size}) = {_q(k)} THEN {v}" for k, v in SIZE_RANK.items())
            + f" END, {SIZE_RANK_DEFAULT})")


def season_num_sql(season: str) -> str:
    return ("coalesce(CASE " + " ".join(f"WHEN lower({season}) = {_q(k)} THEN {v}" for k, v in SEASON_NUM.items())
            + f" END, {SEASON_NUM_DEFAULT})")

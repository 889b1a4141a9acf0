"""Text functions: normalising, counting, trimming to a budget, assembling."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

SECRET_WORDS = "token|api_key|apikey|secret|password"
REDACTED = "[redacted]"
WORD = r"[\p{L}\p{N}_]+"
#: Named character references of HTML 4 and the apostrophe.
REFERENCES = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'"}
#: References that need no semicolon, longer names first.
BARE_NAMES = sorted((name for name in html5 if not name.endswith(";")), key=lambda name: (-len(name), name))
REFERENCES |= {name: html5[name] for name in BARE_NAMES}
NUMBERED = r"^#([0-9]+|[xX][0-9a-fA-F]+);?"
NAMED = r"^([A-Za-z][A-Za-z0-9]{1,31});"
BARE = f"^({'|'.join(BARE_NAMES)})"
EDGES = r" ,.\-–—"  # inside a character class
#: What in a title tells of the file and not of the work, in this order; {who} stands for the maker's name.
TITLE_NOISE = (
    r"^file:",
    r"\s*label\s+QS:.*$",
    r",?\s*source\s*-.*$",
    r",?\s*from the {who} (studio|press).*$",
    r",?\s*{who} press$",
    r",?\s*c\.\s*\d{4}'?s?$",
    r"^painting\s+(of\s+)?(\d+\s+)?",
    r"\(\s*\d{4}\s*-\s*\d+\s*\)",
    r"\.(jpe?g|png|webp|tiff?)$",
    r"{who}\s*\(\d{4}-\d{4}\)",
    r"^{who}\s*[,\-–—:]?\s*",
    r"\bby\s+{who}\b",
    r"[-–—]\s*{who}$",
    r"\b{who}$",
    r"\s*-\s*google art project",
    r"\bwellcome\s+v\d+",
    r"\bva\s+ac\s+\w+",
    r"\brcin\s+\d+",
    r"-\s*royal collection",
    r"\((cropped|crop|duplicate|another version)\)",
    r"\bcrop\b",
    r"\([^)]*(oleograph|chromolithograph)[^)]*\)",
    r",\s*{who}\b",
    r"\(\s*\d+\s*\)$",
    r"\(\d{4}\)",
    r"\d+$",
)
#: Number words of answers.
COUNT_WORDS = {"none": 0, "no": 0, "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8}
INDIC = r"[\x{0900}-\x{0DFF}]"


def redacted(text: Column) -> Column:
    """The whole message is hidden if it names a secret and assigns something."""
    return F.when(F.lower(text).rlike(SECRET_WORDS) & text.rlike("[=:]"), F.lit(REDACTED)).otherwise(text)


def word_pattern(words: Sequence[str]) -> str:
    """Any of the words as a whole, in the plural too."""
    return r"(^|[^\p{L}\p{N}_])(" + "|".join(words) + r")s?([^\p{L}\p{N}_]|$)"


def informative(text: Column, stop: Sequence[str], banned: Sequence[str]) -> Column:
    return text.isNotNull() & (F.trim(text) != "") & ~F.lower(F.trim(text)).isin(*stop) & ~F.lower(text).rlike(word_pattern(banned))


def title_noise(who: str) -> list[str]:
    """The noise patterns of titles for a maker, given as a pattern of the name."""
    return ["(?i)" + pattern.replace("{who}", f"(?:{who})") for pattern in TITLE_NOISE]


def unescaped(text: Column, names: dict[str, str] | None = None) -> Column:
    """Character references decoded once: decimal and hexadecimal ones, with a semicolon or not, and named ones; a few
    old names need no semicolon, of which the longest that fits is taken. What is no character becomes U+FFFD; unknown names stay."""
    table = F.create_map(*[F.lit(x) for pair in (names or REFERENCES).items() for x in pair])

    def decoded(part):
        number, digits = F.regexp_extract(part, NUMBERED, 0), F.regexp_extract(part, NUMBERED, 1)
        hexadecimal = F.lower(F.substring(digits, 1, 1)) == "x"
        plain = F.regexp_replace(F.when(hexadecimal, F.substring(digits, 2, 1_000_000)).otherwise(digits), "^0+(?=.)", "")
        code = F.when(F.length(plain) > 7, -1).when(hexadecimal, F.conv(plain, 16, 10)).otherwise(plain).try_cast("int")
        fine = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
        char = F.when(fine, F.decode(F.unhex(F.lpad(F.hex(F.when(fine, code).otherwise(32)), 8, "0")), "UTF-32")).otherwise("\ufffd")
        known = F.try_element_at(table, F.regexp_extract(part, NAMED, 1))
        bare = F.regexp_extract(part, BARE, 1)
        rest = lambda n: F.substring(part, n + 1, F.length(part))
        return (
            F.when(number != "", F.concat(char, rest(F.length(number))))
            .when(known.isNotNull(), F.concat(known, rest(F.length(F.regexp_extract(part, NAMED, 0)))))
            .when(bare != "", F.concat(F.try_element_at(table, bare), rest(F.length(bare))))
            .otherwise(F.concat(F.lit("&"), part))
        )

    parts = F.split(text, "&")
    return F.when(text.contains("&"), F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), decoded), ""))).otherwise(text)


def trim_edges(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{EDGES}]+|[{EDGES}]+\z", "")


def clean_title(text: Column, noise: Sequence[str] = (), least: int = 3) -> Column:
    """Tags to blanks, references decoded, underscores to blanks, double quotes dropped, noise patterns taken off twice
    with the edges trimmed after each, blanks squeezed, CamelCase split where no blank is; null if too short."""
    t = F.replace(unescaped(F.regexp_replace(text, "<[^>]+>", " ")), F.lit("_"), F.lit(" "))
    t = F.regexp_replace(F.replace(t, F.lit('"'), F.lit("")), r"^\s+|\s+\z", "")
    for pattern in [*noise, *noise]:
        t = trim_edges(F.regexp_replace(t, pattern, " "))
    t = trim_edges(F.regexp_replace(t, r"\s+", " "))
    t = F.when(t.contains(" "), t).otherwise(F.regexp_replace(t, "([a-z])([A-Z])", "$1 $2"))
    return F.when(F.length(t) >= least, t)


def extract_year(text: Column, low: int, high: int, pattern: str = r"\((\d{4})\)") -> Column:
    """The first bracketed year, if it lies in the range."""
    year = F.try_to_number(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.lit("9999")).cast("int")
    return F.when(year.between(low, high), year)


def strip_tokens(text: Column, tokens: Sequence[str]) -> Column:
    """Takes trigger tokens out, with a comma behind them."""
    return F.regexp_replace(F.regexp_replace(text, "(" + "|".join(tokens) + r"),?\s*", ""), r"^[ ,]+|[ ,]+\z", "")


def with_trigger(text: Column, trigger: str) -> Column:
    return F.when(text.contains(trigger), text).otherwise(F.concat(F.lit(f"{trigger}, "), text))


def short_title(text: Column, words: int = 12) -> Column:
    """The first sentence, of so many words at most, without catalogue residue and Indic script (and its label).

    A sentence ends at a full stop between a small letter or a bracket and a blank, so that initials do not end it.
    """
    t = F.regexp_replace(text, r"\s*\b(title|label)\s+QS:.*$", "")
    t = F.regexp_replace(F.regexp_replace(t, rf"\b[A-Z][a-z]+:\s*(?={INDIC})", ""), f"{INDIC}+", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\s{2,}", " "), r"^[ ,:\-]+|[ ,:\-]+\z", "")
    t = F.regexp_replace(t, r"^\s+|\s+\z", "")
    first = F.regexp_replace(F.regexp_replace(t, r"([a-z)])\.\s[\s\S]*\z", "$1"), r"\.+\z", "")
    held = F.split(F.regexp_replace(first, r"^\s+|\s+\z", ""), r"\s+")
    return F.when(F.size(held) > words, F.array_join(F.slice(held, 1, words), " ")).otherwise(first)


@dataclass(frozen=True)
class AdditiveCost:
    """A cost that follows from measures which add up over the parts of a joined text.

    measures: of a text, each a whole number. total: from their sums; it must not fall when one of them grows. A measure
    adds up only where a separator keeps parts apart: ``apart`` tells whether one does.
    """

    measures: tuple[Callable[[Column], Column], ...]
    total: Callable[..., Column]
    apart: Callable[[str], bool] = lambda separator: True

    def __call__(self, text: Column) -> Column:
        return self.total(*[m(text).cast("long") for m in self.measures])


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def _commas(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))


#: An estimate: 1.3 for each word, rounded down, and one for each comma.
token_count = AdditiveCost(
    (_words, _commas),
    lambda words, commas: (F.floor(words * F.lit(13) / 10) + commas).cast("long"),
    lambda separator: bool(separator) and not (separator[0].isalnum() or separator[0] == "_" or separator[-1].isalnum() or separator[-1] == "_"),
)


def _fitting(start: Sequence[Column], parts: Column, budget: int, cost: AdditiveCost, at_once: Callable[[Column], Sequence[Column]], least: int) -> Column:
    """How many parts the budget allows, one pass over their running sums. start: sums before any part; at_once(k): what
    the k-th part brings along; least: so many always stay."""
    names = [f"m{j}" for j in range(len(cost.measures))]
    state = F.struct(F.lit(0).alias("k"), F.lit(least).alias("best"), *[m.cast("long").alias(n) for n, m in zip(names, start, strict=True)])

    def step(held, part):
        k = held["k"] + 1
        sums = [held[n] + m(part).cast("long") + more for n, m, more in zip(names, cost.measures, at_once(k), strict=True)]
        return F.struct(k.alias("k"), F.when((k <= least) | (cost.total(*sums) <= budget), k).otherwise(held["best"]).alias("best"), *[x.cast("long").alias(n) for n, x in zip(names, sums, strict=True)])

    return F.aggregate(parts, state, step, lambda held: F.least(held["best"], F.size(parts)))


def trim_to_budget(parts: Column, budget: int, cost: Callable[[Column], Column] = token_count, separator: str = ", ", note: Column | None = None) -> Column:
    """The longest prefix of parts, joined, within the budget; the first part always stays. A note is put behind the
    second part and stays, too. Parts arrive without nulls, in order of priority.

    An additive cost is summed up part by part; any other is asked for every prefix anew.
    """

    def put(k):
        held = F.slice(parts, 1, k)
        if note is None:
            return F.array_join(held, separator)
        at = F.least(F.lit(2), k)
        noted = F.concat(F.slice(held, 1, at), F.array(note), F.slice(held, at + 1, F.greatest(k - at, F.lit(0))))
        return F.array_join(F.when(note.isNull(), held).otherwise(noted), separator)

    if isinstance(cost, AdditiveCost) and cost.apart(separator):
        between = [m(F.lit(separator)) for m in cost.measures]
        own = [F.lit(0)] * len(between) if note is None else [F.coalesce(m(note) + x, F.lit(0)) for m, x in zip(cost.measures, between, strict=True)]
        kept = _fitting(own, parts, budget, cost, lambda k: [F.when(k > 1, x).otherwise(0) for x in between], 1)
        return F.when(F.size(parts) > 0, put(kept))
    sizes = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda k: (k == 1) | (cost(put(k)) <= budget))
    return F.when(F.size(parts) > 0, put(F.array_max(sizes)))


def parse_count(text: Column) -> Column:
    """A number word up to eight, a word for none, or digits; null for anything else."""
    table = F.create_map(*[x for w, k in COUNT_WORDS.items() for x in (F.lit(w), F.lit(k))])
    key = F.lower(F.trim(text))
    return F.coalesce(table[F.when(key.isin(*COUNT_WORDS), key)], F.when(key.rlike(r"^\d{1,9}$"), key).cast("int"))


def rewritten(text: Column, rewrites: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda t, x: F.regexp_replace(t, x[0], x[1]), rewrites, text)


def assembled(fields: Column, order: Sequence[str], unknown: str = "unknown") -> Column:
    """A text of the fields of a map in order, without empty and unknown ones, each once."""
    values = F.array(*[fields[k] for k in order])
    return F.array_join(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (F.trim(x) != "") & (x != unknown))), ", ")


def text_block(fields: dict[str, Column]) -> Column:
    """A heading and a value per field, null fields as unknown."""
    return F.concat_ws("\n\n", *[F.concat(F.lit(f"{k}:\n"), F.coalesce(c, F.lit("unknown"))) for k, c in fields.items()])


def brightness_band(value: Column) -> Column:
    return F.when(value < 85, "dark").when(value > 170, "bright").otherwise("balanced")


def palette_band(r: Column, g: Column, b: Column) -> Column:
    """Which channel leads: red by eight hundredths over each of the others, blue and green by anything."""
    most = F.greatest(g, b)
    return F.when(r > most * 1.08, "warm").when(b > F.greatest(r, g), "cool").when(g > F.greatest(r, b), "green").otherwise("neutral")


def orientation(w: Column, h: Column) -> Column:
    ratio = w / h
    return F.when(ratio < 0.9, "portrait").when(ratio > 1.1, "landscape").otherwise("square")


def without_terms(text: Column, terms: Sequence[str]) -> Column:
    """A comma list without the given terms."""
    kept = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: (x != "") & ~F.lower(x).isin(*terms))
    return F.array_join(kept, ", ")


def dropped_caption(key: Column, text: Column, percent: int, seed: int) -> Column:
    """For a share of the keys, by a digest of key and seed, the text before its first comma; the same at every run."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long") % 100
    return F.when(drawn < percent, F.substring_index(text, ",", 1)).otherwise(text)


def output_name(prefix: Column, seed: Column) -> Column:
    return F.concat(prefix, F.lit("_seed"), seed.cast("string"))


def trim_optional(required: Column, optional: Column, budget: int, cost: Callable[[Column], Column] = token_count, separator: str = ", ") -> Column:
    """All required parts and as many of the optional ones, each once and in order, as the budget allows."""
    more = F.array_distinct(optional)
    put = lambda k: F.array_join(F.concat(required, F.slice(more, 1, k)), separator)
    if isinstance(cost, AdditiveCost) and cost.apart(separator):
        between = [m(F.lit(separator)) for m in cost.measures]
        start = [F.coalesce(m(F.array_join(required, separator)), F.lit(0)) for m in cost.measures]
        first = F.size(required) == 0  # the first part then has no separator before it
        return put(_fitting(start, more, budget, cost, lambda k: [F.when((k == 1) & first, 0).otherwise(x) for x in between], 0))
    fits = F.filter(F.sequence(F.lit(0), F.size(more)), lambda k: (k == 0) | (cost(put(k)) <= budget))
    return put(F.array_max(fits))


def coerced(answer: Column, scene: Column, subject: str = "subject") -> Column:
    """The values of a JSON object as texts: items of lists joined, true as it is written in answers, what is empty,
    false, zero or null dropped. Null where the answer is no object or its subject does not hold the scene as it is."""
    found = F.from_json(answer, "map<string,variant>")
    kind = lambda v: F.schema_of_variant(v)
    flat = lambda v: F.try_variant_get(v, "$", "string")

    def told(k, v):
        listed = F.array_join(F.try_variant_get(v, "$", "array<string>"), ", ")
        return F.when(kind(v).startswith("ARRAY"), listed).when(kind(v) == "BOOLEAN", F.initcap(flat(v))).otherwise(flat(v))

    texts = F.transform_values(F.map_filter(found, lambda k, v: v.isNotNull()), told)
    kept = F.map_filter(texts, lambda k, v: v.isNotNull() & ~v.isin("", "False", "0", "0.0", "{}"))
    return F.when(F.coalesce(F.try_element_at(kept, F.lit(subject)).contains(scene), F.lit(False)), kept)

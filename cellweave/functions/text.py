"""Normalisers, serialisers, prompts and parsers of cell and entity texts, as Column functions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ids that stand for "no entity".
NIL_WORDS = ("", "nil", "none", "null")
#: Texts that count as missing in the unbracketed serialisation.
BLANK_WORDS = ("none", "nan")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def blank(x: Column | str) -> Column:
    return F.coalesce(strip(x) == "", F.lit(True))


def last_segment(x: Column | str, trim: bool = False) -> Column:
    """What follows the last slash."""
    out = F.element_at(F.split(_c(x), "/"), -1)
    return strip(out) if trim else out


def unquote(x: Column | str) -> Column:
    """Percent-decoded; a plus stays a plus and a text that can't be decoded stays as it is."""
    x = _c(x)
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def normalize_entity_id(x: Column | str) -> Column:
    """The canonical form under which entity ids are compared."""
    s = strip(x)
    local = F.when(s.startswith("wiki:"), unquote(F.substring(s, 6, 1 << 30))).otherwise(s)
    tail = F.when(local.contains("://"), F.element_at(F.split(last_segment(local), ":"), -1)).otherwise(local)
    cut = F.element_at(F.split(tail, r"\("), 1)
    spaced = strip(F.lower(F.replace(cut, F.lit("_"), F.lit(" "))))
    plain = F.regexp_replace(spaced, r"(?U)\s+", " ")
    return F.when(_c(x).isNull() | F.lower(s).isin(*NIL_WORDS), "nil").when(s.rlike(r"^\p{Nd}+$"), s).otherwise(plain)


def tokenize(x: Column | str) -> Column:
    """Lower-case words of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(_c(x)), F.lit(r"(?U)(\w+)"), 1)


def normalize_name(x: Column | str) -> Column:
    """A name for error analysis (P4): lowered and stripped, then marks become spaces and runs of spaces one."""
    return F.regexp_replace(F.regexp_replace(strip(F.lower(_c(x))), r"(?U)[^\w\s]", " "), r"(?U)\s+", " ")


def name_match(a: Column | str, b: Column | str) -> Column:
    """Whether two names are equal when normalised; never if one is missing or empty (P5)."""
    return F.coalesce((_c(a) != "") & (_c(b) != "") & (normalize_name(a) == normalize_name(b)), F.lit(False))


def row_context(columns: Sequence[str]) -> Column:
    """`h1: v1 | h2: v2` with nulls as empty values."""
    return F.concat_ws(" | ", *(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns))


def marked_row(cells: Column | str, headers: Column | str, target: Column | str) -> Column:
    """`h: v` parts joined by ` | `, the target cell (from 0) in markers."""
    value = F.transform(_c(cells), lambda v, i: F.when(i == _c(target), F.concat(F.lit("[M] "), F.coalesce(v, F.lit("")), F.lit(" [/M]"))).otherwise(F.coalesce(v, F.lit(""))))
    return F.array_join(F.zip_with(_c(headers), value, lambda h, v: F.concat(h, F.lit(": "), v)), " | ")


def _clean(x: Column | str) -> Column:
    s = strip(F.coalesce(_c(x), F.lit("")))
    return F.when(F.lower(s).isin(*BLANK_WORDS), "").otherwise(s)


def ser_ditto(title: Column | str, brand: Column | str) -> Column:
    """`COL title VAL x COL brand VAL y`, the brand left out if it is missing (P10)."""
    t, b = _clean(title), _clean(brand)
    return strip(F.concat(F.lit("COL title VAL "), t, F.when(b != "", F.concat(F.lit(" COL brand VAL "), b)).otherwise("")))


def ser_ditto_entity(name: Column | str) -> Column:
    """`COL name VAL x` (P10)."""
    return strip(F.concat(F.lit("COL name VAL "), _clean(name)))


def _words(x: Column | str, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.coalesce(_c(x), F.lit("")), " "), 1, n), " ")


def ser_bracket(title: Column | str, brand: Column | str, title_words: int = 50, brand_words: int = 5) -> Column:
    """`[COL] title [VAL] x [COL] brand [VAL] y` with words cut off."""
    part = lambda name, x, n: F.trim(F.concat(F.lit(f"[COL] {name} [VAL] "), _words(x, n)))
    return F.concat_ws(" ", part("title", title, title_words), part("brand", brand, brand_words))


def ser_bracket_entity(name: Column | str, words: int = 60) -> Column:
    """`[COL] name [VAL] x` with words cut off."""
    return strip(F.concat(F.lit("[COL] name [VAL] "), _words(name, words)))


def strip_colval(x: Column | str) -> Column:
    """Bracket markup as `f: v | f: v`; a text without it is only stripped."""
    x = _c(x)
    # a part reaches to the next marker or the end
    pattern = F.lit(r"\[COL\]\s*(.*?)\s*\[VAL\]\s*(.*?)\s*(?=\[COL\]|$)")
    names, values = F.regexp_extract_all(x, pattern, 1), F.regexp_extract_all(x, pattern, 2)
    joined = F.array_join(F.zip_with(names, values, lambda a, b: F.concat(a, F.lit(": "), b)), " | ")
    return F.when(F.size(names) > 0, joined).otherwise(strip(x))


def parse_row_context(context: Column | str, cell: Column | str) -> Column:
    """struct(title, brand): the first values named so that aren't empty; with neither, the cell is the title."""
    parts = F.transform(F.split(F.coalesce(_c(context), F.lit("")), r"\|"), strip)

    def value(name: str) -> Column:
        own = F.filter(parts, lambda p: F.lower(strip(F.substring_index(p, ":", 1))) == name)
        found = F.filter(F.transform(own, lambda p: strip(F.regexp_replace(p, r"^[^:]*:", ""))), lambda v: v != "")
        return F.coalesce(F.get(found, F.lit(0)), F.lit(""))

    title, brand = value("title"), value("brand")
    return F.struct(F.when((title == "") & (brand == ""), F.coalesce(_c(cell), F.lit(""))).otherwise(title).alias("title"), brand.alias("brand"))


def path_segments(x: Column | str) -> Column:
    """The segments of a taxonomy path `A > B`; `Unknown` for an empty one."""
    parts = F.filter(F.transform(F.split(F.coalesce(_c(x), F.lit("")), ">"), strip), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("Unknown")))


def path_depth(x: Column | str, most: int = 9) -> Column:
    return F.least(F.size(path_segments(x)) - 1, F.lit(most))


def readable_title(x: Column | str) -> Column:
    return F.replace(_c(x), F.lit("_"), F.lit(" "))


#: The forms of a property's id and path.
PROPERTY_FORMS = {"": "Standard > ", "http://dbpedia.org/ontology/": "DBpedia > ", "http://schema.org/": "Schema.org > "}


def expand_property(name: Column | str) -> Column:
    """array of struct(id, name, type, path) for the plain, DBpedia and Schema.org forms of a property (P16); explode it."""
    n = _c(name)
    return F.array(*(F.struct(F.concat(F.lit(i), n).alias("id"), n.alias("name"), F.lit("OntologyProperty").alias("type"), F.concat(F.lit(p), n).alias("path")) for i, p in PROPERTY_FORMS.items()))


#: The wording of the prompts. Braces name what is filled in.
SELECT_PROMPTS = {
    "bracket": (
        "Select a record from the following candidates that refers to the same real-world entity as the given record. "
        'Answer with the corresponding record number surrounded by "[]" or "[0]" if there is none.\n\n'
        "Given entity record: {cell}\n\nCandidate records:\n{candidates}"
    ),
    "bare": "Query product: {cell}\n\nCandidates:\n{candidates}\n\nWhich candidate matches?",
    "digits": (
        "You are an entity matching expert. Given a product mention from a web table, select the most likely matching entity from the candidate list.\n\n"
        'Product mention: "{cell}"\nRow context: "{context}"\n\nCandidate entities:\n{candidates}\n\n'
        "Instructions:\n- Output ONLY the number (1-{n}) of the best matching entity.\n- If none match, output 0.\n- Do not explain, just output the number."
    ),
}
#: The system message that goes with the style `bare`.
BARE_SYSTEM = (
    "You are a product matching assistant. Given a query product and a numbered list of candidate product names, decide which single candidate refers to the SAME product as the query. "
    "Respond with ONLY a single number: 1..K for the matching candidate, or 0 if none match. Do not add any other text."
)
#: The wording of the pair prompt.
PAIR_PROMPT = "Do the two product descriptions refer to the same real-world product? Entity 1: '{left}'. Entity 2: '{right}'."
#: How each style writes a candidate of number i.
_LISTED = {
    "bracket": lambda i, c: F.concat(F.lit("["), i, F.lit("] "), c["name"]),
    "bare": lambda i, c: F.concat(i, F.lit(". "), c["name"]),
    "digits": lambda i, c: F.concat(i, F.lit(". "), c["name"], F.lit(" (ID: "), c["id"], F.lit(")")),
}


def _fill(wording: str, **values: Column) -> Column:
    """The wording with columns in place of its names in braces; nulls are empty."""
    parts = re.split(r"\{(\w+)\}", wording)
    return F.concat(*(F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def prompt_select(cell: Column | str, candidates: Column | str, style: str = "bracket", context: Column | str | None = None) -> Column:
    """The prompt that asks which of candidates, an array of struct(id, name), a cell names.

    parse_reply reads the answer in the same style. The style `bare` is a user message for BARE_SYSTEM.
    """
    c = _c(candidates)
    lines = F.array_join(F.transform(c, lambda x, i: _LISTED[style]((i + 1).cast("string"), x)), "\n")
    return _fill(SELECT_PROMPTS[style], cell=_c(cell), candidates=lines, context=F.lit("") if context is None else _c(context), n=F.size(c))


def prompt_pair(left: Column | str, right: Column | str) -> Column:
    """The prompt that asks whether two texts name one product, without bracket markup."""
    return _fill(PAIR_PROMPT, left=strip_colval(left), right=strip_colval(right))


#: How a reply names its choice: a number in brackets, a number by itself, the first run of digits.
REPLY_STYLES = {"bracket": r"\[(\d+)\]", "bare": r"(?<!\d)(\d+)(?!\d)", "digits": r"(\d+)"}


def parse_reply(x: Column | str, k: int, style: str = "bracket") -> Column:
    """The choice from 1 to k that a reply names; null if it abstains, fails or names none."""
    x = F.coalesce(_c(x), F.lit(""))
    n = F.regexp_extract(x, REPLY_STYLES[style], 1).try_cast("int")
    return F.when(~x.startswith("ERROR") & n.between(1, k), n)


def sft_row(left: Column | str, right: Column | str, label: Column | str) -> Column:
    """struct(prompt, answer) of an instruction row."""
    return F.struct(prompt_pair(left, right).alias("prompt"), F.when(_c(label) == 1, "Yes").otherwise("No").alias("answer"))


def with_prefix(x: Column | str, prefix: str) -> Column:
    """A text as a query or passage of an encoder that wants one named (P20)."""
    return F.concat(F.lit(prefix), _c(x))


def truncate(x: Column | str, n: int) -> Column:
    """At most n characters, the last two dots if cut; `---` for null (P25)."""
    x = _c(x)
    return F.when(x.isNull(), "---").when(F.length(x) <= n, x).otherwise(F.concat(F.substring(x, 1, n - 2), F.lit("..")))


def first_link_title(links: Column | str) -> Column:
    """The first title of surfaceLinks that isn't empty."""
    titles = F.transform(_c(links), lambda x: x["target"]["title"])
    return F.get(F.filter(titles, lambda t: t.isNotNull() & (t != "")), F.lit(0))


def cell_at(table: Column | str, row: Column | str, col: Column | str) -> Column:
    """The text of a nested cell; empty if out of range."""
    return F.coalesce(strip(F.get(F.get(_c(table), _c(row)), _c(col))["text"]), F.lit(""))


def row_text(cells: Column | str, skip_blank: bool = True) -> Column:
    """The texts of a nested row joined by ` | `."""
    texts = F.transform(_c(cells), lambda c: F.coalesce(strip(c["text"]), F.lit("")))
    return F.array_join(F.filter(texts, lambda t: t != "") if skip_blank else texts, " | ")


def with_context(cell: Column | str, context: Column | str) -> Column:
    """`cell [SEP] context`; the one that isn't blank; a space if both are."""
    return F.when(~blank(cell) & ~blank(context), F.concat(_c(cell), F.lit(" [SEP] "), _c(context))).when(~blank(cell), _c(cell)).when(~blank(context), _c(context)).otherwise(" ")


def split_md5_32(x: Column | str) -> Column:
    """Bucket 0 to 9 of the first 32 bits of the id's MD5."""
    return F.conv(F.substring(F.md5(_c(x).cast("string")), 1, 8), 16, 10).cast("long") % 10


def split_md5_128(x: Column | str) -> Column:
    """Bucket 0 to 9 of the whole MD5 of the id (N2): 16^16 is 6 modulo 10."""
    h = F.md5(_c(x).cast("string"))
    hi, lo = (F.conv(F.substring(h, i, 16), 16, 10).cast("decimal(20,0)") % 10 for i in (1, 17))
    return ((hi * 6 + lo) % 10).cast("long")


def split_name(bucket: Column) -> Column:
    return F.when(bucket < 8, "train").when(bucket == 8, "valid").otherwise("test")

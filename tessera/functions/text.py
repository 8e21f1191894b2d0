"""Text columns: token counts, digests, clipping, redaction, small parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as one token each (kana, Han, Hangul, and what lies up to the compatibility forms).
WIDE = "[\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}\\x{AC00}-\\x{D7A3}\\x{8C48}-\\x{FAFF}]"
#: Letters with marks and the letters they are searched as.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
IMAGE_TOKENS = 800


def token_count(text: Column) -> Column:
    """One token for a wide character, one for each four of the others or part of four; 0 for null."""
    text = F.coalesce(text, F.lit(""))
    others = F.char_length(F.regexp_replace(text, WIDE, ""))
    return (F.char_length(text) - others + F.floor((others + 3) / 4)).cast("long")


def part_text(parts: Column) -> Column:
    """The text parts of a message, joined by line breaks; an image stands as [image]."""
    return F.array_join(F.transform(parts, lambda p: F.when(p["type"] == "image", F.lit("[image]")).otherwise(F.coalesce(p["text"], F.lit("")))), "\n")


def part_tokens(parts: Column) -> Column:
    """Tokens of the text parts, and IMAGE_TOKENS for an image."""
    texts = F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit("")))
    images = F.size(F.filter(parts, lambda p: p["type"] == "image"))
    return token_count(F.array_join(texts, "\n")) + F.lit(IMAGE_TOKENS) * images


def folded(text: Column) -> Column:
    """Lower case, without the marks on Latin letters."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN)


def search_terms(text: Column) -> Column:
    """Runs of letters and digits of the folded text; a CJK run is one term."""
    return F.regexp_extract_all(folded(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def content_digest(content: Column, metadata: Column | None = None) -> Column:
    """sha1 of the content, and of the metadata's sorted JSON behind a zero character if there is any."""
    content = F.coalesce(content, F.lit(""))
    if metadata is None:
        return F.sha1(content)
    pairs = F.array_sort(F.map_entries(metadata))
    return F.when(metadata.isNull() | (F.size(metadata) == 0), F.sha1(content)).otherwise(F.sha1(F.concat(content, F.lit("\0"), F.to_json(F.map_from_entries(pairs)))))


def joined_digest(*columns: Column) -> Column:
    """sha1 of the columns joined by line feeds of the record kind (0x1E); null counts as empty."""
    return F.sha1(F.concat_ws("\x1e", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)))


def clip(text: Column, most: int) -> Column:
    """The text, cut after `most` characters, with how many were cut."""
    over = F.char_length(text) - most
    return F.when(over > 0, F.concat(F.substring(text, 1, most), F.lit("…(+"), over.cast("string"), F.lit(")"))).otherwise(text)


def one_line(text: Column, most: int = 120) -> Column:
    """The text on one line, cut after `most` characters with an ellipsis."""
    flat = F.translate(text, "\n", " ")
    return F.when(F.char_length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


#: Key names and parts of names whose values are hidden, value patterns that are masked, the user's part of a home path, keys that stay as they are.
SECRET_NAMES = ("key", "token", "secret", "password", "passwd", "auth", "authorization", "bearer", "credential", "credentials", "api_key", "apikey", "access_token", "refresh_token")
SECRET_PARTS = ("api_key", "apikey", "secret", "password", "passwd", "access_token", "refresh_token")
SECRET_VALUES = ("sk-[A-Za-z0-9_-]{12,}|Bearer\\s+\\S+|\\b[A-Za-z0-9_-]{32,}\\b",)
HOME_PATH = "(/Users/|/home/)([^/]+)"
OPEN_NAMES = ("run_id", "step_index")
MASK = "***"


def secret_name(name: Column) -> Column:
    """Whether a key's value is to be hidden."""
    low = F.lower(name)
    hit = low.isin(*SECRET_NAMES)
    for part in SECRET_PARTS:
        hit = hit | low.contains(part)
    return hit & ~name.isin(*OPEN_NAMES)


def masked(text: Column, patterns: tuple[str, ...] = SECRET_VALUES) -> Column:
    """The text with what looks like a secret masked, and the user's name in home paths."""
    for p in patterns:
        text = F.regexp_replace(text, p if p.startswith("(?") else f"(?U){p}", MASK)
    return F.regexp_replace(text, HOME_PATH, f"$1{MASK}")


def redacted(values: Column, most: int = 4000) -> Column:
    """A map<string,string> with secret keys' values hidden and the others masked and clipped; key names are masked too, open keys stay as they are."""
    keys = F.transform(F.map_keys(values), lambda k: F.when(k.isin(*OPEN_NAMES), k).otherwise(masked(k)))
    clean = F.transform(F.map_entries(values), lambda e: F.when(e["key"].isin(*OPEN_NAMES), e["value"]).when(secret_name(e["key"]), F.lit(MASK)).otherwise(clip(masked(e["value"]), most)))
    # masked names may fall together: the first of them stays
    pairs = F.arrays_zip(keys.alias("k"), clean.alias("v"))
    first = F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1)
    return F.when(values.isNotNull(), F.map_from_arrays(F.transform(first, lambda p: p["k"]), F.transform(first, lambda p: p["v"])))


def short_repr(text: Column, most: int = 40) -> Column:
    """The first characters of a text, with an ellipsis where it goes on."""
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def tool_name(text: Column) -> Column:
    """A name of letters, digits, _ and -, at most 64; `tool` if nothing is left."""
    clean = F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9_-]", "_"), 1, 64)
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("tool"))


def bullet_lines(text: Column) -> Column:
    """The lines of a list, without bullets and numbers, empty ones left out."""
    lines = F.split(text, "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "^[ \\t]*([-*•]|[0-9]+[.)])[ \\t]*", ""))), lambda x: x != "")


def query_list(queries: Column, original: Column, most: int = 8) -> Column:
    """Distinct queries that are not blank, in order, at most `most`; the original alone if none is left."""
    fine = F.slice(F.array_distinct(F.filter(queries, lambda q: F.trim(q) != "")), 1, most)
    return F.when(F.size(fine) > 0, fine).otherwise(F.array(original))


def json_in_prose(text: Column) -> Column:
    """The text from the first opening brace or bracket to the last closing one, as VARIANT; null if it is no JSON."""
    bare = F.regexp_replace(text, "```[a-z]*", "")
    return F.try_parse_json(F.nullif(F.regexp_extract(bare, "(?s)[\\[{].*[\\]}]", 0), F.lit("")))


def heading_path(title: Column, heading: Column) -> Column:
    return F.concat_ws(" > ", F.nullif(title, F.lit("")), F.nullif(heading, F.lit("")))


def with_heading(heading: Column, content: Column) -> Column:
    """The content under its heading, if there is one."""
    return F.when(F.coalesce(heading, F.lit("")) != "", F.concat(heading, F.lit("\n"), content)).otherwise(content)


def wrapped_external(text: Column, flagged: Column, source: Column) -> Column:
    """Text from outside between marks that name it as data, where flagged."""
    return F.when(flagged, F.concat(F.lit("[external content from "), source, F.lit("]\n"), text, F.lit("\n[end of external content]"))).otherwise(text)


def sanitized(text: Column, most: int | None = None) -> Column:
    """Without control and format characters, but for tab, line feed, carriage return, joiners and the soft hyphen."""
    clean = F.regexp_replace(text, "[\\p{Cc}\\p{Cf}&&[^\\t\\n\\r\\x{200C}\\x{200D}\\x{00AD}]]", "")
    return clean if most is None else clip(clean, most)


def contextualizer_fingerprint(kind: str, **settings: object) -> str:
    """What a document's fingerprint takes in of the way its chunks get their context: another way, or other settings, and all chunks are due again."""
    return "|".join([kind, *(f"{k}={settings[k]}" for k in sorted(settings))])

"""Surrogates for personal data: keyed, type-consistent and distinct replacements.

Every detected entity gets a replacement of its own kind and format, drawn with a keyed hash from its canonical
form, so the same entity is replaced alike in every document, and nobody without the key can tell which it was.
A first pass gathers the distinct entities of the whole table. Replacements that two entities share, or that
are themselves real entities, are found by grouping and drawn again until none is left; a second pass
writes the texts. Only entities that had to be drawn again are carried into that pass.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import free_name, materialize, read, small_batches

#: Patterns of the entities, in the order in which they claim text.
EMAIL = (
    r"(?P<email>(?<![A-Za-z0-9_%+-])[A-Za-z0-9_%+-](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?"
    r"@(?:[^\W_](?:(?:[^\W_]|-){0,61}[^\W_])?\.){1,8}(?:[A-Za-z]{2,24}|(?:(?![A-Za-z])[^\W\d_]){2,24}))"
)
IPV4 = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|(?:{_HEX}:){{1,7}}:|:(?::{_HEX}){{1,7}})(?![\w:]|\.\d)"
IP = rf"(?P<ip>{IPV4}|{IPV6})"
IBAN = r"(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|(?: ?[A-Z0-9]{4}){2} ?[A-Z0-9]{3})(?!\w))"
CARD = r"(?P<card>(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]))"
SSN = r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
PHONE = (
    r"(?P<phone>(?<![\w.(])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}"
    r"|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w))"
)
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Mlle", "Sra", "Señora", "Srta", "Doña", "Signora", "Госпожа", "Κυρία"),
    "m": ("Mr", "Mister", "Herr", "M", "Monsieur", "Sr", "Señor", "Don", "Signor", "Господин", "Κύριος"),
    "n": ("Dr", "Prof", "Mx"),
}
#: Given names by script and gender; family names are built from SYLLABLES.
GIVEN = {
    "LATIN": {"f": ("Anna", "Clara", "Elena", "Irene", "Julia", "Laura", "Maria", "Nora", "Paula", "Sofia"), "m": ("Adam", "Bruno", "Daniel", "Felix", "Hugo", "Leon", "Martin", "Oscar", "Paul", "Victor"), "n": ("Alex", "Kim", "Robin", "Sasha")},
    "CYRILLIC": {"f": ("Анна", "Вера", "Елена", "Ирина", "Мария", "Ольга"), "m": ("Антон", "Борис", "Иван", "Олег", "Павел", "Юрий"), "n": ("Саша", "Женя")},
    "GREEK": {"f": ("Άννα", "Ελένη", "Μαρία", "Σοφία"), "m": ("Γιώργος", "Νίκος", "Παύλος", "Πέτρος"), "n": ("Άλεξ",)},
}
SYLLABLES = {"LATIN": "ba be bi bo da de di do ka ke ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se so ta te ti to va ve vi".split(), "CYRILLIC": "ба бе бо ва ве во да де ка ко ла ло ма ми мо на не ни ра ро са со та ти".split(), "GREEK": "βα γα δα κα λα μα να ρα σα τα κο λο μο νο ρο σο το".split()}
#: What may follow a title before the name.
DEGREES = ("med", "rer", "nat", "phil", "jur", "Ing", "ing", "habil", "h.c", "h. c", "theol", "dent")
_SIGN = {t: g for g, names in TITLES.items() for t in names}
_one_of = lambda names: "|".join(map(re.escape, sorted(names, key=len, reverse=True)))
#: Titles in a row; a letter alone is a title at the start only, elsewhere an initial.
_FURTHER = rf"(?:{_one_of([t for t in _SIGN if len(t) > 1])})(?!\w)"
RUN_OF_TITLES = rf"(?:{_one_of(_SIGN)})(?:\. ?| )(?:(?:{_FURTHER}\.?|(?:{_one_of(DEGREES)})\.) ?)*"
TITLE_RUN = re.compile(RUN_OF_TITLES)
_CAPITAL = r"[^\W\d_a-zа-яα-ω]"
#: A word of a name with the initials before it.
_WORD = rf"(?:{_CAPITAL}(?:\. ?| ))*(?!{_FURTHER}){_CAPITAL}(?:['’]?[^\W\d_])+"
NAME = rf"(?P<name>(?<!\w){RUN_OF_TITLES}{_WORD}(?:[ -]{_WORD}){{0,2}})"
TITLE_WORD = re.compile(rf"(?<!\w)(?:{_one_of(_SIGN)})(?!\w)")
ENTITY = re.compile("|".join((EMAIL, IP, IBAN, CARD, SSN, PHONE, NAME)))
#: Whether any pattern can match: an at sign, a digit or a title.
HINT = re.compile(rf"[@\d]|(?<!\w)(?:{'|'.join(map(re.escape, _SIGN))})\b")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d *= 1 + k % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


#: Letters of a family name from which on it is looked for without a title too.
FAMILY_LETTERS = 4


def mentions(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Where the people of `found` are named again without a title: by the whole name, or by a family name that is capitalised there and no word of the text in lower case."""
    people: dict[str, str] = {}
    for _, _, kind, canonical in found:
        if kind == "name":
            words = canonical.partition(":")[2].split()
            if len(words) > 1:
                people.setdefault(" ".join(words), canonical)
            if len(words[-1]) >= FAMILY_LETTERS and words[-1][:1].isupper() and not re.search(rf"(?<!\w){re.escape(words[-1].lower())}(?!\w)", text):
                people.setdefault(words[-1], f"{canonical.partition(':')[0]}:{words[-1]}")
    if not people:
        return []
    taken = [(a, b) for a, b, _, _ in found]
    out, k = [], 0
    for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(people, key=len, reverse=True)))})(?!\w)", text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k == len(taken) or m.end() <= taken[k][0]:
            out.append((m.start(), m.end(), "name", people[m[0]]))
    return out


def detect(text: str, strict_cards: bool) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities, left to right, without overlap."""
    out: list[tuple[int, int, str, str]] = []
    if not HINT.search(text):
        return out
    at = 0
    while m := ENTITY.search(text, at):
        kind, found = m.lastgroup, m[0]
        at = m.end()
        if kind == "email":
            canonical = found.lower()
        elif kind == "name":
            end = TITLE_RUN.match(found).end()
            signs = [_SIGN[t] for t in TITLE_WORD.findall(found[:end])]
            canonical = f"{next((x for x in signs if x != 'n'), 'n')}:{found[end:]}"
        elif kind in ("card", "ssn", "phone", "iban"):
            # digits of any script count by their value
            canonical = "".join(str(int(c)) if c.isdecimal() else c for c in found if c.isdecimal() or c == "+" or "A" <= c <= "Z")
            if kind == "card" and strict_cards and not luhn(canonical):
                continue
        elif ":" in found:
            try:
                canonical = ipaddress.ip_address(found).compressed
            except ValueError:
                continue
            if not any(c.isdigit() for c in found) and found.count(":") < 3:
                continue  # a name of program text rather than an address
        else:
            canonical = found
        out.append((m.start(), m.end(), kind, canonical))
    return sorted(out + mentions(text, out))


class Stream:
    """Numbers from a keyed hash of kind, canonical form and draw."""

    def __init__(self, key: bytes, kind: str, canonical: str, draw: int):
        self.seed, self.key, self.count, self.pool = f"{kind}\0{draw}\0{canonical}".encode("utf-8", "replace"), key, 0, 0
        self.left = 1

    def below(self, n: int) -> int:
        if self.left < 1 << 64:
            block = hmac.new(self.key, self.seed + self.count.to_bytes(4, "big"), hashlib.sha256).digest()
            self.pool, self.left, self.count = int.from_bytes(block, "big"), 1 << 256, self.count + 1
        self.pool, out = divmod(self.pool, n)
        self.left //= n
        return out


def script_of(name: str) -> str:
    for c in name:
        if c.isalpha():
            return unicodedata.name(c, "LATIN").split()[0].split("-")[0]
    return "LATIN"


@cache
def letters_of(script: str) -> tuple[str, ...]:
    """The first letters of a script of the basic plane, for scripts that have no syllables here."""
    letters = (chr(c) for c in range(0x250, 0xD800) if unicodedata.category(chr(c)) in ("Lo", "Ll") and unicodedata.name(chr(c), "").startswith(f"{script} "))
    return tuple(islice(letters, 500)) or ("x",)


def cased(new: str, old: str) -> str:
    if old.isupper() and len(old) > 1:
        return new.upper()
    return new.lower() if old.islower() else new


def digits_like(found: str, fresh: Iterator[str]) -> str:
    """`found` with each digit replaced by the next of `fresh`, in its own script; what is left of `fresh` comes last."""
    return "".join(chr(ord(c) - int(c) + int(next(fresh))) if c.isdecimal() else c for c in found) + "".join(fresh)


def surrogate(kind: str, canonical: str, key: bytes, draw: int = 0) -> str:
    """The replacement of a canonical form, itself in canonical form.

    Later draws come from wider ranges, as a table may hold more entities than a format's own range has values: addresses
    beyond the private range, social security numbers with any first digit, phone numbers with another country and then with further digits.
    """
    s = Stream(key, kind, canonical, draw)
    if kind == "email":
        local, domain = canonical.rsplit("@", 1)
        swap = "".join(chr(97 + s.below(26)) if c.isalpha() else str(s.below(10)) if c.isdigit() else c for c in local)
        tail = "".join(chr(97 + s.below(26)) for _ in range(max(0, 8 - len(local))))
        # addresses of one domain stay together
        d = Stream(key, kind, f"domain:{domain}", 0)
        return f"{swap}{tail}@{''.join(chr(97 + d.below(26)) for _ in range(9))}.example.{('com', 'net', 'org')[d.below(3)]}"
    if kind == "ip" and ":" in canonical:
        return ":".join(f"{g:x}" for g in (0xFD00 + s.below(256), *(1 + s.below(0xFFFF) for _ in range(7))))
    if kind == "ip":
        low, high = ((10, 11), (240, 256), (1, 256))[min(draw // 4, 2)]
        return f"{low + s.below(high - low)}.{s.below(256)}.{s.below(256)}.{1 + s.below(254)}"
    if kind == "card":
        body = canonical[0] + "".join(str(s.below(10)) for _ in canonical[1:-1])
        check = next(str(d) for d in range(10) if luhn(body + str(d)))
        return body + (check if luhn(canonical) else str((int(check) + 1 + s.below(9)) % 10))
    if kind == "ssn":
        return f"{9 if draw < 4 else s.below(10)}{s.below(100):02d}{10 + s.below(90)}{s.below(10000):04d}"
    if kind == "phone":
        plus, body = canonical.startswith("+"), canonical.lstrip("+")
        head = plus + (body[0] not in "17") if plus and draw < 8 else 0  # the country stays
        return "+" * plus + body[:head] + "".join(str(s.below(10)) for _ in range(len(body) - head + max(0, draw // 4 - 3)))
    if kind == "iban":
        return canonical[:2] + "".join(str(s.below(10)) if c.isdigit() else chr(65 + s.below(26)) for c in canonical[2:])
    gender, _, name = canonical.partition(":")
    words = name.split()
    script = script_of(name)
    given, syllables = GIVEN.get(script, {}).get(gender), SYLLABLES.get(script) or letters_of(script)
    out = []
    for k, old in enumerate(words):
        last = k == len(words) - 1
        # the family name depends on nothing else, so that forms with and without given names agree
        draws = Stream(key, kind, f"family:{old.lower()}", draw if len(words) == 1 else 0) if last else s
        made = "".join(syllables[draws.below(len(syllables))] for _ in range(5 if last else 3 + draw // 3)).capitalize()
        if len(old.rstrip(".")) == 1:
            new = made[0] + old[1:]
        else:
            new = given[s.below(len(given))] if given and k == 0 and not last and draw < 4 else made
        out.append(cased(new, old))
    return f"{gender}:{' '.join(out)}"


def written(found: str, kind: str, new: str) -> str:
    """The canonical replacement in the format of what was found."""
    if kind == "email":
        return new.upper() if found.isupper() else new
    if kind == "name":
        titles = TITLE_RUN.match(found)
        return found[: titles.end() if titles else 0] + new.partition(":")[2]
    if kind in ("card", "ssn", "phone"):
        return digits_like(found, iter(new.lstrip("+")))
    if kind == "iban":
        fresh = iter(new)
        return "".join(next(fresh) if c.isalnum() else c for c in found)
    return new


ENTITIES = "kind string, canonical string, n long"


def entities(docs: DataFrame, text_col: str = "text", strict_cards: bool = False) -> DataFrame:
    """kind, canonical, n: the distinct entities of the whole table and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: dict[tuple[str, str], int] = {}
            for v in batch.column(0):
                for _, _, kind, canonical in detect(v.as_py() or "", strict_cards):
                    count[kind, canonical] = count.get((kind, canonical), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in count], pa.string()), pa.array([c for _, c in count], pa.string()), pa.array(count.values(), pa.int64())], names=["kind", "canonical", "n"])

    return small_batches(docs.select(text_col)).mapInArrow(run, ENTITIES).groupBy("kind", "canonical").agg(F.sum("n").alias("n"))


#: Draws after which a format counts as used up: the ranges have long been widened then.
MOST_DRAWS = 256


def collided(found: DataFrame, key: bytes, most_draws: int = MOST_DRAWS) -> DataFrame:
    """kind, canonical, draw of the entities whose first replacement is not theirs alone.

    Of entities that share a replacement the smallest canonical form keeps it, unless it is a real entity; the others draw again, until
    no replacement is shared. If `most_draws` draws are not enough it raises: no text may be written with a shared replacement.
    """

    def draw_column(frame: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                new = [surrogate(k, c, key, d) for k, c, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], names=[*b.schema.names, "new"])

        return frame.select("kind", "canonical", "draw").mapInArrow(run, "kind string, canonical string, draw int, new string")

    real = found.select("kind", F.col("canonical").alias("new"))
    held = materialize(draw_column(found.withColumn("draw", F.lit(0))), "pii-draws")
    for _ in range(most_draws):
        owner = held.groupBy("kind", "new").agg(F.min(F.struct("draw", "canonical")).alias("o"), F.count("*").alias("rows"))
        taken = real.withColumn("real", F.lit(True))
        shared = owner.join(taken, ["kind", "new"], "left").where("rows > 1 OR real")
        marked = held.join(shared, ["kind", "new"])
        again = marked.where(F.col("real").isNotNull() | (F.col("canonical") != F.col("o.canonical"))).select("kind", "canonical", "draw")
        again = materialize(again, "pii-again")
        if not again.limit(1).count():
            break
        rest = held.join(again.select("kind", "canonical"), ["kind", "canonical"], "left_anti")
        held = materialize(rest.unionByName(draw_column(again.withColumn("draw", F.col("draw") + 1))), "pii-draws")
    else:
        raise ValueError(f"replacements still collide after {most_draws} draws")
    return held.where("draw > 0").select("kind", "canonical", "draw")


def pseudonymize(docs: DataFrame, *, key: bytes, text_col: str = "text", strict_cards: bool = False, broadcast_rows: int = 200_000) -> DataFrame:
    """`docs` with surrogates for personal data in `text_col`, and n_entities, how many were replaced.

    A null text stays null; an empty one stays empty; both count no entities. All other columns and rows stay as they are, whatever their names; a
    column n_entities is replaced, repeated rows get equal texts, an empty table gives an empty one.
    The entities that had to be drawn again are broadcast up to `broadcast_rows`; more of them are
    joined to the documents that hold them. `strict_cards` leaves alone long numbers whose check digit is wrong.
    """
    names = [c for c in docs.columns if c != "n_entities"]
    kept = small_batches(docs.select(*names))
    at = names.index(text_col)
    draws = materialize(collided(materialize(entities(docs, text_col, strict_cards), "pii-entities"), key), "pii-redrawn")
    few = draws.limit(broadcast_rows + 1).count() <= broadcast_rows
    shared = docs.sparkSession.sparkContext.broadcast({(r.kind, r.canonical): r.draw for r in draws.collect()} if few else {})

    def rewrite(text: str, redrawn: dict[tuple[str, str], int]) -> tuple[str, int]:
        out, done = [], 0
        spans = detect(text, strict_cards)
        for a, b, kind, canonical in spans:
            out += text[done:a], written(text[a:b], kind, surrogate(kind, canonical, key, redrawn.get((kind, canonical), 0)))
            done = b
        return "".join([*out, text[done:]]) if spans else text, len(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for k, v in enumerate(batch.column(at)):
                text = v.as_py()
                redrawn = {(r["kind"], r["canonical"]): r["draw"] for r in batch.column(len(names))[k].as_py() or []} if not few else shared.value
                new, n = (None, 0) if text is None else rewrite(text, redrawn)
                texts.append(new)
                counts.append(n)
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=[*names, "n_entities"])

    schema = T.StructType([*kept.schema, T.StructField("n_entities", T.LongType())])
    return (kept if few else _with_redrawn(kept, draws, text_col, strict_cards)).mapInArrow(run, schema)


def _with_redrawn(docs: DataFrame, draws: DataFrame, text_col: str, strict_cards: bool) -> DataFrame:
    """`docs` with a last column, the draws of the entities of each text, by a join on the entities."""
    number, last = free_name(docs.columns, "_row"), free_name(docs.columns, "_redrawn")

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, kind, canonical) for r, t in zip(*(c.to_pylist() for c in batch.columns)) for kind, canonical in sorted({x[2:] for x in detect(t or "", strict_cards)})]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])], names=["_row", "kind", "canonical"])

    # every row has a number of its own, so copies of a text, however many, are dealt out evenly
    held = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "pii-rows")
    found = small_batches(held.select(number, text_col)).mapInArrow(wanted, "_row long, kind string, canonical string")
    redrawn = found.join(draws, ["kind", "canonical"]).groupBy(F.col("_row").alias(number)).agg(F.collect_list(F.struct("kind", "canonical", "draw")).alias(last))
    return held.join(redrawn, number, "left").select(*docs.columns, last)


#: The key of the registered query and of the pipeline; in production it comes from a secret store.
DEMO_KEY = b"tessera demonstration key"


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(read(spark, sf_dir, "documents").select("doc_id", "text"), key=DEMO_KEY)

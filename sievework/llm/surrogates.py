"""Personal data replaced by keyed, type-consistent surrogates."""

from __future__ import annotations

import hashlib
import hmac
import json
import re
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import table

#: Entities with a changed surrogate that tasks receive as a map; beyond it they are joined to the texts.
MAPPED = 50_000
ROUNDS = 8

_LATIN_M = ("Mr", "Herr", "Herrn", "Señor", "Sr", "Monsieur", "Don")
_LATIN_F = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Doña")
_LATIN_N = ("Dr", "Prof", "Professor")
_CYRILLIC_M, _CYRILLIC_F = ("господин", "Господин", "г-н"), ("госпожа", "Госпожа", "г-жа")
_TITLES = {**dict.fromkeys(_LATIN_M + _CYRILLIC_M, "m"), **dict.fromkeys(_LATIN_F + _CYRILLIC_F, "f"), **dict.fromkeys(_LATIN_N, "n")}
_TITLE_WORDS = tuple(sorted(_TITLES, key=len, reverse=True))
_NAME = re.compile(rf"(?<!\w)({'|'.join(map(re.escape, _TITLE_WORDS))})\.? ((?:[^\W\d_]+(?:[-'’][^\W\d_]+)*)(?: [^\W\d_]+(?:[-'’][^\W\d_]+)*){{0,2}})")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: (type, pattern, group that is the entity); where two overlap, the earlier type wins.
_KINDS = (
    ("secret", re.compile(r"(?i)(?<![a-z0-9])(?:token|secret|passwd|password|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?([a-z0-9+/_\-]{8,})"), 1),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|[0-9a-f]{40}|[0-9a-f]{64})(?![A-Za-z0-9])"), 0),
    ("email", re.compile(r"[\w.%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"), 0),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), 0),
    ("card", re.compile(r"(?<![\d+])\d(?:[ -]?\d){12,18}(?![\d])"), 0),
    ("ip", re.compile(rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)"), 0),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), 0),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5}|(?:\d{1,3}[ .-])?\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w)"), 0),
)
#: What a match of one of the patterns holds in any case, to spare most texts the pattern.
_DIGIT, _SHORT_PHONE = re.compile(r"\d[\d .()\-]{5,}"), re.compile(r"\+\d{5}")
_HEX, _IBAN = re.compile(r"[0-9a-f]{40}"), re.compile(r"[A-Z]{2}\d{2} ?[A-Z0-9]{4}")


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical value) of a text's entities, in order, without overlaps.

    Words of a titled name (the last one as family name, the others as given names) are entities wherever
    the same capitalised word stands again in the text. Where two overlap, the earlier type stays, and of
    one type the earlier and longer one; each new one is compared with its neighbours alone.
    """
    found: list[tuple[int, int, str, str]] = []
    digits = _DIGIT.search(text) is not None
    # The long s matches an s of a pattern that ignores case, and lower() keeps it.
    low = text.lower().replace("ſ", "s") if ("=" in text or ":" in text) else ""
    hints = (
        any(w in low for w in ("token", "secret", "passw", "key")),
        "AKIA" in text or _HEX.search(text) is not None,
        "@" in text,
        _IBAN.search(text) is not None,
        digits,  # card
        digits,  # ip
        digits,  # ssn
        digits or _SHORT_PHONE.search(text) is not None,
    )
    for (kind, pattern, group), hint in zip(_KINDS, hints, strict=True):
        if hint:
            for m in pattern.finditer(text):
                found.append((m.start(group), m.end(group), kind, canonical(kind, m.group(group))))
    if any(t in text for t in _TITLE_WORDS):
        found += _names(text)
    out: list[tuple[int, int, str, str]] = []
    order = {k: i for i, k in enumerate(dict.fromkeys(k for k, _, _ in _KINDS))}
    taken: list[tuple[int, int]] = []  # disjoint, in order
    for e in sorted(found, key=lambda e: (order.get(e[2], len(order)), e[0], -e[1])):
        at = bisect_left(taken, (e[0], e[1]))
        if (at == 0 or taken[at - 1][1] <= e[0]) and (at == len(taken) or taken[at][0] >= e[1]):
            insort(taken, (e[0], e[1]))
            out.append(e)
    return sorted(out)


def _titled(text: str) -> list[tuple[str, list[str]]]:
    """(title's gender, capitalised words after it) of each titled name."""
    out = []
    for m in _NAME.finditer(text):
        words = []
        for w in m.group(2).split(" "):
            if not w[0].isupper():
                break
            words.append(w)
        out.append((_TITLES[m.group(1)], words))
    return out


def _names(text: str) -> list[tuple[int, int, str, str]]:
    roles: dict[str, str] = {}
    for _, words in _titled(text):
        for i, w in enumerate(words):
            roles.setdefault(w.casefold(), "family" if i == len(words) - 1 else "given")
    if not roles:
        return []
    spans = []
    for m in re.finditer(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*", text):
        role = roles.get(m.group().casefold())
        if role and m.group()[0].isupper():
            spans.append((m.start(), m.end(), role, m.group().casefold()))
    return spans


def genders(text: str) -> set[tuple[str, str]]:
    """(given name, m or f) as a text's titles tell."""
    if not any(t in text for t in _TITLE_WORDS):
        return set()
    return {(w.casefold(), g) for g, words in _titled(text) if g != "n" for w in words[:-1]}


def by_form(name: str) -> str:
    """The gender that a given name's ending suggests, for names that no title tells."""
    return "f" if name[-1:] in "aeiyáéаяеи" else "m"


def canonical(kind: str, value: str) -> str:
    """What makes two mentions the same entity: digits without their layout, letters without case."""
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", value)
    if kind == "phone":
        return ("+" if value.startswith("+") else "") + re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    return value.lower() if kind == "email" else value


#: The calling codes of two digits; 1 and 7 have one digit, all others three.
TWO_DIGITS = {20, 27, 30, 31, 32, 33, 34, 36, 39, 40, 41, 43, 44, 45, 46, 47, 48, 49, 51, 52, 53, 54, 55, 56, 57, 58, 60, 61, 62, 63, 64, 65, 66, 81, 82, 84, 86, 90, 91, 92, 93, 94, 95, 98}


def calling_code(digits: str) -> int:
    """Number of digits of the country's code that an international number begins with."""
    return 1 if digits[:1] in ("1", "7") else 2 if int(digits[:2] or 0) in TWO_DIGITS else 3


class Maker:
    """Surrogates of entities; the same key, type, value and attempt always give the same."""

    def __init__(self, key: bytes):
        self.key = key

    def number(self, *parts) -> int:
        return int.from_bytes(hmac.digest(self.key, "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), "sha256"), "big")

    def digits(self, value: str, *tweak) -> str:
        """A permutation of the digit strings of one length (a balanced Feistel network)."""
        if len(value) < 2:
            return str((int(value) + self.number("one", *tweak)) % 10) if value else ""
        half = len(value) // 2
        a, b = value[:half], value[half:]
        for r in range(ROUNDS):
            n = len(a)
            a, b = b, str((int(a) + self.number(r, b, n, *tweak)) % 10**n).zfill(n)
        return (a + b) if ROUNDS % 2 == 0 else (b + a)

    def word(self, script: str, syllables: int, *parts) -> str:
        onset, vowel = ("bdfgklmnprstvz", "aeiou") if script == "latin" else ("бвгдзклмнпрст", "аеиоу")
        n, out = self.number(script, *parts), ""
        for _ in range(syllables):
            n, i = divmod(n, len(onset))
            n, j = divmod(n, len(vowel))
            out += onset[i] + vowel[j]
        return out

    def surrogate(self, kind: str, value: str, attempt: int = 0, gender: str | None = None) -> str:
        """The canonical surrogate of a canonical value; a given name's has its gender's ending."""
        if kind == "ip":
            n = 0
            for octet in value.split("."):
                n = n * 256 + int(octet)
            a, b = n >> 16, n & 0xFFFF
            for r in range(ROUNDS):
                a, b = b, a ^ (self.number("ip", attempt, r, b) & 0xFFFF)
            n = (a << 16) | b
            return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
        if kind == "card":
            middle = self.digits(value[1:-1], "card", attempt, value[0])
            shift = int(value[-1]) - luhn(value[:-1])
            return value[0] + middle + str((luhn(value[0] + middle) + shift) % 10)
        if kind == "ssn":
            return self.digits(value, "ssn", attempt)
        if kind == "phone":
            # The country code, or what is over ten digits, says where a number belongs and stays.
            own = value.lstrip("+")
            keep = max(len(own) - 10, calling_code(own) if value.startswith("+") else 0)
            return value[: len(value) - len(own)] + own[:keep] + self.digits(own[keep:], "phone", attempt, own[:keep])
        if kind == "iban":
            shapes = "".join("9" if c.isdigit() else "A" for c in value[4:])
            numbers = iter(self.digits("".join(c for c in value[4:] if c.isdigit()), "iban", attempt, value[:2], shapes))
            n = self.number("iban", attempt, shapes)
            body = "".join(next(numbers) if c.isdigit() else chr(65 + (ord(c) - 65 + (n >> i)) % 26) for i, c in enumerate(value[4:]))
            return value[:2] + iban_check(value[:2], body) + body
        if kind == "email":
            local, _, domain = value.partition("@")
            tail = re.search(r"\d*$", local).group()
            name = self.word("latin", 6 + attempt, "email", local, domain, attempt)
            return f"{name}{self.digits(tail, 'mail', attempt, local) if tail else ''}@{self.word('latin', 4, 'domain', domain)}.example.{domain.rpartition('.')[2]}"
        if kind == "secret":
            hexed = re.fullmatch(r"[0-9a-f]+", value) is not None
            out, block = [], 0
            for i, c in enumerate(value):
                if i % 16 == 0:
                    block = self.number("secret", attempt, value, i)
                block, r = divmod(block, 7919)
                if hexed:
                    out.append("0123456789abcdef"[r % 16])
                elif c.isdigit():
                    out.append(str(r % 10))
                elif c.isalpha():
                    out.append(chr((97 if c.islower() else 65) + r % 26))
                else:
                    out.append(c)
            return "".join(out)
        script = "cyrillic" if re.search(r"[Ѐ-ӿ]", value) else "latin"
        if kind == "family":
            return self.word(script, 5 + attempt, kind, value, attempt) + ("n" if script == "latin" else "н")
        ends = {"m": ("s", "с"), "f": ("la", "ла")}[gender or by_form(value)]
        return self.word(script, 4 + attempt, kind, value, attempt) + ends[script != "latin"]


def luhn(digits: str) -> int:
    """The check digit that follows `digits`."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_check(country: str, body: str) -> str:
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{98 - number % 97:02d}"


def laid_out(kind: str, mention: str, made: str) -> str:
    """The canonical surrogate in the mention's format: separators, case, spaces."""
    if kind in ("card", "ssn", "phone", "iban"):
        chars = iter(made.lstrip("+") if kind == "phone" else made)
        return "".join(next(chars) if c.isalnum() else c for c in mention)
    if kind == "email" and mention.isupper():
        return made.upper()
    if kind in ("given", "family"):
        return made.upper() if len(mention) > 1 and mention.isupper() else made.capitalize()
    return made


def replaced(text: str, maker: Maker, attempts: dict) -> tuple[str, list[str]]:
    """The text with surrogates, and the types replaced."""
    out, here, kinds = [], 0, []
    for start, end, kind, value in entities(text):
        made = maker.surrogate(kind, value, *attempts.get((kind, value), (0, None)))
        out += [text[here:start], laid_out(kind, text[start:end], made)]
        here = end
        kinds.append(kind)
    return "".join(out) + text[here:], kinds


def collisions(found: DataFrame, maker_key: bytes) -> DataFrame:
    """(kind, value, attempt, gender) of those distinct entities whose surrogate is not the plain one.

    `found`: distinct (kind, value, gender), gender where titles tell another than a name's form. A
    surrogate will not do if another entity of the kind has it (the least value keeps it) or if it is
    some entity of the kind itself. The rest try again until all differ; of n entities about
    n * n / 2 / space need it, and each round is joins on the surrogate.
    """

    def make(batches):
        maker = Maker(maker_key)
        for b in batches:
            told = b["gender"].astype(object).where(b["gender"].notna(), None)
            b["made"] = [maker.surrogate(k, v, a, g) for k, v, a, g in zip(b["kind"], b["value"], b["attempt"], told, strict=True)]
            yield b

    state = found.select("kind", "value", "gender", F.lit(0).alias("attempt"))
    for _ in range(20):
        made = table(state.mapInPandas(make, "kind string, value string, gender string, attempt int, made string"), "pii-surrogates")
        winners = made.groupBy("kind", "made").agg(F.min("value").alias("first"), F.count("*").alias("n"))
        shared = winners.where("n > 1").select("kind", "made", "first")
        real = made.join(found.select("kind", F.col("value").alias("made")), ["kind", "made"], "left_semi").select("kind", "made", F.lit(None).cast("string").alias("first"))
        bad = made.join(shared.unionByName(real), ["kind", "made"]).where(F.col("first").isNull() | (F.col("value") != F.col("first"))).select("kind", "value").distinct()
        bad = table(bad, "pii-again")
        if bad.isEmpty():
            break
        again = bad.withColumn("again", F.lit(1))
        state = made.join(again, ["kind", "value"], "left").select("kind", "value", "gender", (F.col("attempt") + F.coalesce("again", F.lit(0))).cast("int").alias("attempt"))
    else:
        raise RuntimeError("surrogates still collide after 20 attempts: the space of a type is full")
    return made.where("attempt > 0 OR gender IS NOT NULL").select("kind", "value", "attempt", "gender")


def pseudonymise(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, text, n_entities, kinds) of every row of `docs`, with surrogates for personal data.

    The same entity has the same surrogate in all rows, different entities of a type different ones. A
    given name is one entity whatever its title; its surrogate has the gender that most titles in the
    corpus tell, or else that of the name's form. Names without a title anywhere in their text stay.
    kinds: the types replaced, distinct, sorted, comma-joined. Only distinct entities are shuffled.
    A null text stays null with no entity, an empty one empty; very long texts are taken whole; null and
    repeated keys and repeated rows stay; kept columns may have any names but those of the result; an
    empty table gives an empty one.
    """
    maker_key = hashlib.sha256(secret.encode()).digest()

    def find(batches):
        for b in batches:
            got: dict[tuple[str, str], list[int]] = {(k, v): [0, 0] for t in b["text"] if t for _, _, k, v in entities(t)}
            for t in b["text"]:
                for name, g in genders(t) if t else ():
                    if ("given", name) in got:
                        got["given", name][g == "f"] += 1
            rows = [(k, v, m, f) for (k, v), (m, f) in sorted(got.items())]
            yield pd.DataFrame(rows, columns=["kind", "value", "m", "f"])

    texts = docs.select(F.col(text).alias("text"))
    seen = texts.mapInPandas(find, "kind string, value string, m long, f long").groupBy("kind", "value").agg(F.sum("m").alias("m"), F.sum("f").alias("f"))
    form = F.when(F.substring("value", -1, 1).rlike("^[aeiyáéаяеи]$"), "f").otherwise("m")
    told = F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f")
    found = table(seen.select("kind", "value", F.when((F.col("kind") == "given") & (told != form), told).alias("gender")), "pii-entities")
    changed = collisions(found, maker_key)
    several = changed.limit(MAPPED + 1).collect()
    rows = docs.select(F.col(key).alias("__key"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("__text"))
    attempts: dict = {}
    if len(several) <= MAPPED:
        attempts = {(r["kind"], r["value"]): (r["attempt"], r["gender"]) for r in several}
        rows = rows.withColumn("__over", F.lit(None).cast("string"))
    else:

        def mentions(batches):
            for b in batches:
                got = [(h, k, v) for h, t in zip(b["h"], b["text"], strict=True) if t for k, v in {e[2:] for e in entities(t)}]
                yield pd.DataFrame(got, columns=["h", "kind", "value"])

        named = texts.select(F.md5(F.col("text").cast("binary")).alias("h"), "text").mapInPandas(mentions, "h string, kind string, value string")
        over = named.distinct().join(changed, ["kind", "value"]).groupBy("h").agg(F.to_json(F.collect_list(F.array("kind", "value", F.col("attempt").cast("string"), F.coalesce("gender", F.lit(""))))).alias("__over"))
        rows = rows.withColumn("h", F.md5(F.col("__text").cast("binary"))).join(over, "h", "left").drop("h")
    names = ["__key", *[f"k{i}" for i in range(len(keep))]]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        maker = Maker(maker_key)
        for b in batches:
            made = [
                (None, []) if t is None else replaced(t, maker, attempts if o is None else {(k, v): (int(a), g or None) for k, v, a, g in json.loads(o)})
                for t, o in zip(b["__text"], b["__over"], strict=True)
            ]
            out = b.drop(columns=["__text", "__over"])
            out["text"], out["n_entities"] = [m[0] for m in made], [len(m[1]) for m in made]
            out["kinds"] = [",".join(sorted(set(m[1]))) for m in made]
            yield out

    done = rows.mapInPandas(run, schema + ", text string, n_entities long, kinds string")
    return done.select(F.col("__key").alias(key), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("text").alias(text), "n_entities", "kinds")

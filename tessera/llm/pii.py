"""Surrogates for personal data.

Detected entities get replacements drawn from a keyed hash of type and
normalised value: the same entity gets the same surrogate everywhere, in the
format of each occurrence.  Surrogates keep type, length, separators, letter
case, script and, for names, gender.

Names are announced by a title.  Each of their parts is an entity, given or
family name, so that ``Mr. John Smith`` and ``Ms. Smith`` share a surname after
the change; further mentions of a part in the same text, with no title, change
along.

Collision checks: the distinct entities of the corpus are gathered; where two
of them would get one surrogate, or a surrogate equals an entity that occurs,
all but the first take their next draw, until none collide.  Later draws are
longer, so that no space runs out.  Only entities whose first draw was not free
are joined back to documents.
"""

from __future__ import annotations

import hashlib
import hmac
import itertools
import re
from ipaddress import AddressValueError, IPv6Address

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import words as W
from .store import Scratch

#: fixed values: titles that announce a name, with the gender they tell
TITLES = {"Mr": "m", "Mister": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Señorita": "f", "Don": "m", "Doña": "f"}
#: fixed values: titles before names that end in two family names
TWO_FAMILY = ("Señor", "Señora", "Señorita", "Don", "Doña")
#: fixed values: words within names that are no names
PARTICLES = ("de", "del", "della", "da", "das", "dos", "di", "du", "la", "le", "van", "von", "der", "den", "ter", "zu")
#: fixed values: words before a secret
PASSWORDS, KEYS = ("password", "passwd", "pwd"), ("token", "secret", "api_key", "api-key", "apikey", "access_key")


def _any_case(words: tuple[str, ...]) -> str:
    return "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else re.escape(c) for c in w) for w in words)


_UPPER = "".join(c for c in map(chr, range(0x41, 0x560)) if c.isupper())
_WORD = rf"(?!(?:{'|'.join(TITLES)})\b)[{_UPPER}](?:[^\W\d_]|['’-](?!s\b)(?=[^\W\d_]))+"
_PART = rf"(?:[{_UPPER}]\.|(?:(?:{'|'.join(PARTICLES)}) )*{_WORD})"
_HEX = "[0-9A-Fa-f]{1,4}"
PATTERN = re.compile(
    r"(?P<email>[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<aws>\bAKIA[0-9A-Z]{16}\b)"
    rf"|(?:{_any_case(PASSWORDS)})[\"']?[ \t]*[:=][ \t]*[\"']?(?P<password>[^\s\"']+)"
    rf"|(?:{_any_case(KEYS)})[\"']?[ \t]*[:=][ \t]*[\"']?(?=[^\s\"']*\d)(?P<secret>[^\s\"']+)"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?\b)"
    r"|(?P<phone>(?<!\w)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w.-])\d{3}-\d{3}-\d{4}(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.-])(?:\d{4}[ -]){3}\d{4}(?![\w-])|(?<![\w.-])\d{13,19}(?!\w))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d))"
    rf"|(?P<ipv6>(?<![\w:.])(?:{_HEX}:){{2,7}}(?::?{_HEX})(?::{_HEX})*(?![\w:])|(?<![\w:.]){_HEX}::{_HEX}(?::{_HEX})+(?![\w:]))"
    rf"|(?P<name>\b(?:{'|'.join(TITLES)})\b\.?(?: [{_UPPER}]\.)* (?:(?:{'|'.join(PARTICLES)}) )*{_WORD}(?: {_PART})*)"
)
#: types as they are counted; name parts count as names
KINDS = ("email", "aws", "secret", "iban", "phone", "ssn", "card", "ip", "name")
_COUNTED = {"password": "secret", "ipv6": "ip", "given": "name", "family": "name", "initial": "name"}


def _wide_digits() -> re.Pattern:
    """UTF-8 of any decimal digit beyond ASCII: ``\\d`` of PATTERN has them too."""
    last: dict[bytes, bytes] = {}
    for c in filter(str.isdecimal, map(chr, range(128, 0x110000))):
        x = c.encode()
        last[x[:-1]] = last.get(x[:-1], b"") + x[-1:]
    return re.compile(b"|".join(re.escape(k) + b"[" + re.escape(v) + b"]" for k, v in last.items()))


_WIDE = _wide_digits()
_HINTS = [b"AKIA"] + [f"{t} ".encode() for t in TITLES] + [f"{t}. ".encode() for t in TITLES]
_LOW_HINTS = [w.encode() for w in PASSWORDS + KEYS]


def normal(kind: str, value: str) -> str:
    """The entity behind a spelling: what must stay the same surrogate."""
    if kind in ("phone", "card", "ssn"):
        return _ascii(re.sub(r"\D", "", value))
    if kind == "iban":
        return _ascii(value.replace(" ", ""))
    if kind == "ip":
        return _ascii(value)
    if kind == "ipv6":
        return IPv6Address(value).exploded
    if kind == "email":
        return value.lower()
    if kind in ("given", "family"):
        return value.capitalize()
    return value


def _ascii(value: str) -> str:
    """The same with ASCII digits."""
    return value if value.isascii() else "".join(str(int(c)) if c.isdecimal() else c for c in value)


def _script(digit: str, sample: str) -> str:
    """An ASCII digit in the script of another digit."""
    return chr(ord(sample) - int(sample) + int(digit)) if digit.isdecimal() and sample.isdecimal() else digit


def _stream(key: bytes, kind: str, entity: str, draw: int):
    block, buf = 0, b""
    while True:
        if not buf:
            buf = hmac.new(key, f"{kind}\0{entity}\0{draw}\0{block}".encode(), hashlib.sha256).digest()
            block += 1
        yield buf[0]
        buf = buf[1:]


def _pick(stream, n: int) -> int:
    """Uniform below n, from two bytes with rejection."""
    while True:
        x = next(stream) << 8 | next(stream)
        if x < 65536 // n * n:
            return x % n


_SYLLABLES = "ba be bo da de di do fa fe ga ge ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi".split()
_GREEK = str.maketrans("abdefgiklmnoprstv", "αβδεφγικλμνοπρστβ")
_CYRILLIC = str.maketrans("abdefgiklmnoprstv", "абдефгиклмнопрств")


def _name(stream, sample: str, ending: str, syllables: int) -> str:
    out = "".join(_SYLLABLES[_pick(stream, len(_SYLLABLES))] for _ in range(syllables)) + ending
    if "Ͱ" <= sample[0] <= "Ͽ":
        out = out.translate(_GREEK)
    elif "Ѐ" <= sample[0] <= "ӿ":
        out = out.translate(_CYRILLIC)
    return out.capitalize()


def surrogate(key: bytes, kind: str, entity: str, draw: int = 0) -> str:
    """The entity's replacement in normal form.  From the third draw on it is
    longer than the entity by one sign or more: every space grows in the end."""
    s = _stream(key, kind, entity, draw)
    more = max(0, draw - 1)
    digits = lambda n: "".join(str(_pick(s, 10)) for _ in range(n))
    if kind == "given":
        name, gender = entity.rsplit("|", 1)
        return _name(s, name, "a" if gender == "f" else "n", 3 + draw) + "|" + gender
    if kind == "family":
        return _name(s, entity, "k", 3 + draw)
    if kind == "initial":
        return "ABCDEFGHIJKLMNOPRSTUVW"[_pick(s, 22)] + "."
    if kind == "ip" and draw < 9:
        if entity.startswith("10.") and draw < 5:
            return ".".join(["10", *(str(_pick(s, 256)) for _ in range(3))])
        return ".".join([str(240 + _pick(s, 15)), *(str(_pick(s, 256)) for _ in range(3))])  # reserved, never routed
    if kind in ("ip", "ipv6"):
        return IPv6Address("2001:db8:" + ":".join(f"{_pick(s, 65536):x}" for _ in range(6))).exploded  # reserved for documentation
    if kind == "email":
        user, _, _ = entity.partition("@")
        return "".join(_letter(s, c) for c in user) + "x" * more + f"@{_WORDS[_pick(s, len(_WORDS))]}{_pick(s, 1000 * 10**min(more, 1))}.example.org"
    if kind == "card":
        body = entity[0] + digits(len(entity) - 2 + more)
        return body + (str(next(d for d in range(10) if luhn(body + str(d)))) if luhn(entity) else digits(1))
    if kind == "phone":
        keep = len(entity) - 10 if len(entity) > 10 else 0
        return entity[:keep] + digits(len(entity) - keep + more)
    if kind == "aws":
        return "AKIA" + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[_pick(s, 32)] for _ in range(len(entity) - 4 + more))
    if kind in ("password", "secret") and re.fullmatch(r"[0-9a-f]+", entity):
        return "".join("0123456789abcdef"[_pick(s, 16)] for _ in range(len(entity) + more))
    if kind == "iban":
        return entity[:2] + "".join(_letter(s, c) for c in entity[2:]) + digits(more)
    return "".join(_letter(s, c) for c in entity) + digits(more)


_WORDS = ("mail", "post", "inbox", "letter", "note", "memo", "relay", "bureau")


def _letter(s, c: str) -> str:
    if c.isdigit():
        return str(_pick(s, 10))
    if "a" <= c <= "z":
        return chr(97 + _pick(s, 26))
    if "A" <= c <= "Z":
        return chr(65 + _pick(s, 26))
    return c


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def shaped(kind: str, value: str, new: str) -> str:
    """``new`` in the spelling of this occurrence."""
    if kind in ("phone", "card", "ssn", "iban"):
        left = iter(new)
        return "".join(_script(next(left), c) if c.isalnum() else c for c in value) + "".join(left)
    if kind == "ip" and not value.isascii():
        wide = next(c for c in value if c.isdecimal() and not c.isascii())
        return "".join(_script(c, wide) for c in new)
    if kind == "ipv6":
        short = IPv6Address(new).compressed
        return short.upper() if value.isupper() else short
    if kind == "email":
        return new.upper() if value.isupper() else new
    if kind in ("given", "family"):
        new = new.rsplit("|", 1)[0]
        return new.upper() if value.isupper() else new
    return new


def _suspects(data: np.ndarray, offs: np.ndarray, raw: bytes) -> list[int]:
    """Rows with anything an entity needs: two digits side by side or about a
    dot, two colons at most five bytes apart, a digit beyond ASCII, an @ or a
    hint.  All rows of ``find`` and more."""
    digit = (data >= 48) & (data <= 57)
    flag = np.zeros(len(data) + 1, np.int64)
    mark = data == ord("@")
    mark[1:] |= digit[1:] & digit[:-1]
    mark[2:] |= digit[2:] & (data[1:-1] == ord(".")) & digit[:-2]
    np.cumsum(mark, out=flag[1:])
    some = set(np.flatnonzero(flag[offs[1:]] > flag[offs[:-1]]).tolist())
    colon = np.flatnonzero(data == ord(":"))
    near = colon[1:][np.diff(colon) <= 5]
    some.update((np.searchsorted(offs, near, "right") - 1).tolist())
    for hints, where in ((_HINTS, raw), (_LOW_HINTS, raw.lower())):
        for hint in hints:
            at = where.find(hint)
            while at >= 0:
                row = int(np.searchsorted(offs, at, "right")) - 1
                some.add(row)
                at = where.find(hint, int(offs[row + 1]))
    wide = None if raw.isascii() else _WIDE.search(raw)
    while wide:
        row = int(np.searchsorted(offs, wide.start(), "right")) - 1
        some.add(row)
        wide = _WIDE.search(raw, int(offs[row + 1]))
    return sorted(some)


def find(text: str) -> list[tuple[str, int, int]]:
    """(type, start, end) of what PATTERN finds and the checks of its type pass."""
    out = []
    for m in PATTERN.finditer(text):
        kind = m.lastgroup
        a, b = m.span(kind)
        if kind == "card" and not luhn(_ascii(re.sub(r"\D", "", text[a:b]))):
            continue
        if kind == "ipv6":
            try:
                IPv6Address(text[a:b])
            except AddressValueError:
                continue
        out.append((kind, a, b))
    return out


def _parts(text: str, a: int, b: int) -> list[tuple[str, str, int, int]]:
    """Parts of a titled name: given names and, at the end, family names."""
    words = [(m.group(), a + m.start(), a + m.end()) for m in re.finditer(r"\S+", text[a:b])]
    title = words[0][0].rstrip(".")
    words = [w for w in words[1:] if w[0] not in PARTICLES]
    named = [k for k, w in enumerate(words) if not w[0].endswith(".")]
    family = set(named[-2:] if title in TWO_FAMILY and len(named) > 2 else named[-1:])
    out = []
    for k, (w, x, y) in enumerate(words):
        kind = "family" if k in family else "given" if k in named else "initial"
        out.append((kind, normal(kind, w) + ("" if kind == "family" else "|" + TITLES[title]), x, y))
    return out


def mentions(text: str) -> list[tuple[str, str, int, int]]:
    """(type, entity, start, end) of all that is to be replaced, in order."""
    out, known = [], {}
    for kind, a, b in find(text):
        if kind != "name":
            out.append((kind, normal(kind, text[a:b]), a, b))
            continue
        for part in _parts(text, a, b):
            out.append(part)
            if part[0] != "initial":
                word = text[part[2] : part[3]]
                for spelt in (word, word.upper(), word.capitalize()):
                    if part[0] == "family" or spelt not in known:
                        known[spelt] = part[:2]
    if known:  # further mentions without a title
        taken = [(a, b) for _, _, a, b in out]
        k = 0
        for m in re.finditer(r"\b(?:" + "|".join(map(re.escape, sorted(known, key=len, reverse=True))) + r")\b", text):
            while k < len(taken) and taken[k][1] <= m.start():
                k += 1
            if k == len(taken) or m.end() <= taken[k][0]:
                out.append((*known[m.group()], *m.span()))
        out.sort(key=lambda x: x[2])
    return out


def _found(part, data, offs, keyed: bool):
    raw, ids = data.tobytes(), part.column(0).to_pylist()
    rows: dict[tuple, None] = {}
    for k in _suspects(data, offs, raw):
        for kind, entity, _, _ in mentions(raw[offs[k] : offs[k + 1]].decode("utf-8", "replace")):
            if kind != "initial":  # a letter: not one of many things
                rows[(ids[k], kind, entity) if keyed else (kind, entity)] = None
    cols = list(zip(*rows)) if rows else [()] * (2 + keyed)
    kinds = [pa.int64()] * keyed + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["id", "kind", "entity"][1 - keyed :])


def _entities(batches):
    for part, data, offs in W.slices(batches):
        yield _found(part, data, offs, False)


def _occurs(batches):
    for part, data, offs in W.slices(batches):
        yield _found(part, data, offs, True)


def _draw(key: bytes, make):
    def run(batches):
        for b in batches:
            rows = list(zip(*(b.column(i).to_pylist() for i in range(3))))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array([make(key, *r) for r in rows], pa.string())], names=["kind", "entity", "draw", "new"])

    return run


def _replace(key: bytes, exceptions: bool, make):
    def run(batches):
        for part, data, offs in W.slices(batches):
            raw, texts, counts = data.tobytes(), part.column(1).to_pylist(), np.zeros((part.num_rows, len(KINDS)), np.int32)
            known = part.column(2).to_pylist() if exceptions else [None] * part.num_rows
            for k in _suspects(data, offs, raw):
                text, out, end = texts[k], [], 0
                own = {(x["kind"], x["entity"]): x["new"] for x in known[k] or ()}
                said = mentions(text)
                for j, (kind, entity, a, b) in enumerate(said):
                    new = own.get((kind, entity)) or make(key, kind, entity)
                    out += [text[end:a], shaped(kind, text[a:b], new)]
                    end = b
                    counted = _COUNTED.get(kind, kind)
                    if counted != "name" or kind == "family" or j + 1 == len(said) or said[j + 1][2] > b + 1:  # a name once, by its last part
                        counts[k, KINDS.index(counted)] += 1
                texts[k] = "".join(out) + text[end:] if out else text
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(texts, pa.string()), pa.array(counts.sum(1), pa.int32()), *(pa.array(np.ascontiguousarray(counts[:, i]), pa.int32()) for i in range(len(KINDS)))],
                names=["row", "text", "n_entities", *(f"n_{x}" for x in KINDS)],
            )

    return run


def pii_surrogates(docs: DataFrame, key: bytes = b"tessera surrogates", make=surrogate, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with its text replaced, plus n_entities and a count per type.

    All columns and rows stay, in their types; null and empty texts stay as
    they are.  Null and repeated ids are fine: entities, not rows, decide.
    Entities that fill their space (ten one-digit passwords) get longer ones.
    ``make`` draws a surrogate and must give ever new ones in the end.  A clash
    of the added names with columns of ``docs`` is resolved in favour of the
    added ones.  Very long texts are handled whole.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "pii")
    added = ["n_entities", *(f"n_{k}" for k in KINDS)]
    docs = docs.drop(*added)
    slim = docs.select(F.col(id_col).cast("bigint").alias("row"), F.col(text_col).alias("text"))
    every = scratch.put(slim.mapInArrow(_entities, "kind string, entity string").distinct(), "entities")
    drawn = scratch.put(every.withColumn("draw", F.lit(0)).mapInArrow(_draw(key, make), "kind string, entity string, draw int, new string"), "draw-0")
    for k in itertools.count(1):
        real = every.select("kind", F.col("entity").alias("new"), F.lit(True).alias("real"))
        first = drawn.groupBy("kind", "new").agg(F.min(F.struct("draw", "entity")).alias("first"))
        judged = drawn.join(first, ["kind", "new"]).join(real, ["kind", "new"], "left")
        clash = (F.col("first.entity") != F.col("entity")) | F.coalesce("real", F.lit(False))
        bad = scratch.put(judged.where(clash).select("kind", "entity", (F.col("draw") + 1).alias("draw")), f"clash-{k}")
        if bad.isEmpty():
            break
        again = bad.mapInArrow(_draw(key, make), "kind string, entity string, draw int, new string")
        drawn = scratch.put(drawn.join(bad.select("kind", "entity"), ["kind", "entity"], "left_anti").unionByName(again), f"draw-{k}")
        scratch.drop(f"draw-{k - 1}", f"clash-{k}")
    moved = drawn.where("draw > 0").select("kind", "entity", "new")
    rest = [c for c in docs.columns if c != text_col]
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(text_col).alias("text"))
    exceptions = not moved.isEmpty()
    if exceptions:
        where = slim.mapInArrow(_occurs, "id bigint, kind string, entity string").join(moved, ["kind", "entity"])
        own = where.groupBy("id").agg(F.collect_set(F.struct("kind", "entity", "new")).alias("known")).select(F.col("id").alias("_id"), "known")
        own = scratch.put(own, "exceptions")  # its size is known when the join is planned
        source = source.withColumn("_key", F.col(f"row.{id_col}").cast("bigint")).join(own, F.col("_key").eqNullSafe(F.col("_id")), "left").select("row", "text", "known")
    schema = T.StructType([source.schema["row"], T.StructField("text", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in added)])
    out = source.mapInArrow(_replace(key, exceptions, make), schema)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns], *added)

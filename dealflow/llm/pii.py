"""Operator 2: personal data replaced by keyed, type-consistent surrogates.

Detected: e-mail addresses, phone, payment-card and social-security numbers,
IPv4 addresses and persons named with a title, with every untitled mention of
their names in the same text.  A surrogate is drawn from a
keyed hash of the entity: the same entity has the same surrogate in every
document, digits stay digits, letters stay letters of the same case and
script, a card keeps its issuer digit and checksum, an address its octet form,
a person the title's gender and the name's script.  A person is made of given
names and a surname, each with a surrogate of its own, so that full and short
mentions agree.

Distinctness is checked over the whole corpus: entities of one kind (all parts
of persons' names count as one kind) that drew
the same surrogate, or one that is itself an entity of the corpus, draw again
(all but one of them) until none is left.  The table of entities stays
distributed; it is joined back to the texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflow.llm.common import byte_list, materialize, remove_table, slices

# Titles by gender, and names by gender and script to draw from.
TITLES = {"m": ["Mr", "Herr", "Señor", "Monsieur", "Sir", "Lord", "Господин"],
          "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "Lady", "Dame", "Госпожа"],
          "n": ["Dr", "Doctor", "Doktor", "Prof", "Professor", "Mx", "Rev", "Judge", "Доктор", "Профессор"]}
FIRST = {("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Jonas", "Leo", "Martin",
                          "Oscar", "Paul", "Simon", "Thomas", "Victor"],
         ("f", "latin"): ["Alice", "Clara", "Diana", "Emma", "Flora", "Helena", "Ida", "Julia", "Laura", "Maria",
                          "Nora", "Paula", "Sofia", "Teresa", "Vera"],
         ("m", "cyrillic"): ["Алексей", "Борис", "Виктор", "Григорий", "Иван", "Николай", "Олег", "Павел"],
         ("f", "cyrillic"): ["Алина", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"]}
for _script in ("latin", "cyrillic"):
    FIRST["n", _script] = FIRST["m", _script] + FIRST["f", _script]
LAST = {"latin": ["Abel", "Berger", "Conrad", "Dalton", "Ebner", "Falk", "Garner", "Holm", "Irving", "Jansen",
                  "Keller", "Lindner", "Moreau", "Norris", "Ortega", "Palmer", "Quist", "Roland", "Sander", "Torres"],
        "cyrillic": ["Орлов", "Соколов", "Волков", "Зайцев", "Лебедев", "Новиков", "Морозов", "Павлов"]}

_GENDER = {t: g for g, titles in TITLES.items() for t in titles}
_EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", re.ASCII)
_IP = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w.]*\d)", re.ASCII)
_CARD = re.compile(r"(?<![\w.-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])", re.ASCII)
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.ASCII)
_PHONE = re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}"
                    r"|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])", re.ASCII)
_UP = "A-Z" + "".join(chr(c) for c in range(0xC0, 0x250) if chr(c).isupper())
_LOW = "a-z" + "".join(chr(c) for c in range(0xC0, 0x250) if chr(c).islower())
# inner capitals, apostrophes and hyphens belong to a name: McLean, O'Neil, Keller-Schmidt
_NAME = "(?:" + "|".join(rf"(?:[{u}]['’])?(?:[{u}][{w}]+)+(?:[-'’](?:[{u}][{w}]+)+)*"
                         for u, w in ((_UP, _LOW), ("А-ЯЁ", "а-яё"))) + r")(?![\w])(?![-'’][" + _UP + "А-ЯЁ])"
_TITLE = "(?:" + "|".join(_GENDER) + r")\b"
_PERSON = re.compile(rf"\b((?:{_TITLE}\.?[ ])+)((?!{_TITLE}){_NAME}(?:[ ](?!{_TITLE}){_NAME})?)")

Mention = tuple[int, int, str, str]  # start, end, kind, entity in normal form


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def person_parts(kind: str, entity: str) -> list[tuple[str, str]]:
    """(kind, entity) of a person's given names and surname."""
    *given, last = entity.split(" ")
    return [*(("given" + kind[6:], g) for g in given), ("surname", last)]


def _persons(text: str) -> list[Mention]:
    """Persons with a title, then other mentions of their names as whole words."""
    titled = []
    for m in _PERSON.finditer(text):
        genders = [g for t in m[1].replace(".", " ").split() if (g := _GENDER[t]) != "n"]
        titled.append((m.start(2), m.end(2), genders[0] if genders else "n", m[2]))
    if not titled:
        return []
    gender = {}  # of a full name, known from any of its titles
    for *_, g, name in titled:
        if gender.get(name, "n") == "n":
            gender[name] = g
    found = [(s, e, f"person-{gender[name] if ' ' in name else g}", name) for s, e, g, name in titled]
    known: dict[str, tuple[str, str]] = {}
    for *_, kind, name in found:
        known.setdefault(name, (kind, name))
    for *_, kind, name in found:
        known.setdefault(name.split(" ")[-1], (kind, name.split(" ")[-1]))
    for *_, kind, name in found:
        for part in person_parts(kind, name)[:-1]:
            known.setdefault(part[1], part)
    names = "|".join(map(re.escape, sorted(known, key=len, reverse=True)))
    again = re.compile(rf"(?<![\w])(?<!\w[-'’])(?:{names})(?![\w])(?![-'’][{_UP}А-ЯЁ])")
    return found + [(m.start(), m.end(), *known[m[0]]) for m in again.finditer(text)]


def detect(text: str) -> list[Mention]:
    """Mentions by place, none overlapping; earlier patterns win."""
    found: list[Mention] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in _EMAIL.finditer(text)]
    found += [(m.start(), m.end(), "ip", m[0]) for m in _IP.finditer(text)
              if all(int(x) < 256 for x in m[0].split("."))]
    found += [(m.start(), m.end(), "card", d) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19]
    found += [(m.start(), m.end(), "ssn", _digits(m[0])) for m in _SSN.finditer(text)]
    found += [(m.start(), m.end(), "phone", d) for m in _PHONE.finditer(text) if 7 <= len(d := _digits(m[0])) <= 15]
    if any(t in text for t in _GENDER):
        found += _persons(text)
    out: list[Mention] = []
    for m in found:
        if all(m[1] <= o[0] or o[1] <= m[0] for o in out):
            out.append(m)
    return sorted(out)


def checksum_ok(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


class _Draw:
    """Numbers from a keyed hash of (kind, entity, attempt)."""

    def __init__(self, key: bytes, *what: str):
        self.seed = hashlib.blake2b("\0".join(what).encode(), key=key).digest()
        self.state, self.turn = int.from_bytes(self.seed, "little"), 0

    def below(self, n: int) -> int:
        if self.state < 1 << 64:
            self.turn += 1
            self.state = int.from_bytes(hashlib.blake2b(self.seed, salt=self.turn.to_bytes(8, "little")).digest(), "little")
        self.state, x = divmod(self.state, n)
        return x

    def alike(self, text: str) -> str:
        """Letters for letters, digits for digits, the rest as it is."""
        return "".join(str(self.below(10)) if c.isdigit() else chr(97 + self.below(26)) if c.isalpha() else c
                       for c in text)


def surrogate(key: bytes, kind: str, entity: str, attempt: int) -> str:
    """The entity's surrogate in normal form; never the entity itself."""
    for again in range(attempt * 1000, attempt * 1000 + 1000):
        draw = _Draw(key, kind, entity, str(again))
        if kind == "email":
            local, _, domain = entity.partition("@")
            names, _, top = domain.rpartition(".")
            out = f"{draw.alike(local)}@{_Draw(key, 'domain', names, str(again)).alike(names)}.{top}"
        elif kind == "ip":
            out = ".".join(str(1 + draw.below(254)) for _ in range(4))
        elif kind == "card":
            out = entity[0] + draw.alike(entity[1:])
            if checksum_ok(entity):
                out = next(x for n in range(10) if checksum_ok(x := out[:-1] + str(n)))
        elif kind == "phone":
            out = entity[:-7] + draw.alike(entity[-7:]) if len(entity) > 7 else draw.alike(entity)
        elif kind == "ssn":
            out = draw.alike(entity)
        elif kind.startswith("person"):
            out = " ".join(surrogate(key, k, part, attempt) for k, part in person_parts(kind, entity))
        else:
            script = "cyrillic" if "Ѐ" <= entity[0] <= "ӿ" else "latin"
            pool = LAST[script] if kind == "surname" else FIRST[kind[-1], script]
            # later attempts lengthen the name, so that names never run out
            out = pool[draw.below(len(pool))] + "".join(
                c for _ in range(attempt) for c in LAST[script][draw.below(len(LAST[script]))].lower())
        if out != entity:
            return out
    raise RuntimeError("no surrogate found")


def render(mention: str, kind: str, new: str) -> str:
    """A surrogate in the mention's own format (separators, letter case)."""
    if kind == "email":
        if len(mention) == len(new):
            return "".join(c.upper() if m.isupper() else c for m, c in zip(mention, new))
        return new
    if kind in ("card", "ssn", "phone"):
        rest = iter(new)
        return "".join(next(rest) if c.isdigit() else c for c in mention)
    return new


def replace(text: str, names: dict[tuple[str, str], str]) -> tuple[str, str]:
    """The text with surrogates, and its mentions as kind:start:end in the new text.

    ``names``: surrogates by (kind, entity); of persons, those of their parts do.
    """
    out, spans, at, size = [], [], 0, 0
    for start, end, kind, entity in detect(text):
        new = names.get((kind, entity)) or " ".join(names[p] for p in person_parts(kind, entity))
        new = render(text[start:end], kind, new)
        out += [text[at:start], new]
        size += start - at
        spans.append(f"{kind}:{size}:{size + len(new)}")
        size, at = size + len(new), end
    return "".join([*out, text[at:]]), ",".join(spans)


def entities(docs: DataFrame) -> DataFrame:
    """(blob, kind, entity): the distinct entities of each text that has some, persons in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = [(k, *e) for k, t in zip(b.column("blob").to_pylist(), byte_list(b.column("text")))
                    for e in dict.fromkeys(p for m in detect(t.decode()) for p in (
                        person_parts(*m[2:]) if m[2].startswith("person") else [m[2:]]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string()),
                 pa.array([r[2] for r in rows], pa.string())], ["blob", "kind", "entity"])

    return docs.mapInArrow(run, "blob binary, kind string, entity string")


def assign(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, surrogate) of distinct entities, with no two alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, names, turns = (b.column(c).to_pylist() for c in ("kind", "entity", "attempt"))
            new = [surrogate(key, *x) for x in zip(kinds, names, turns)]
            yield pa.RecordBatch.from_arrays(
                [b.column("kind"), b.column("entity"), b.column("attempt"), pa.array(new, pa.string())],
                ["kind", "entity", "attempt", "surrogate"])

    schema = "kind string, entity string, attempt int, surrogate string"
    cur = materialize(found.withColumn("attempt", F.lit(0)).mapInArrow(run, schema), "surrogates")
    alike = F.when(F.col("kind").rlike("^(given|surname)"), "person").otherwise(F.col("kind"))
    while True:
        # those that drew most often keep theirs; the others, and any that hit an entity, draw again
        best = cur.groupBy(alike.alias("of"), "surrogate").agg(
            F.min(F.struct(-F.col("attempt"), "entity", "kind")).alias("b")).select(
            "of", "surrogate", F.col("b.entity").alias("owner"), F.col("b.kind").alias("owner_kind"))
        real = cur.select(alike.alias("of"), F.col("entity").alias("surrogate"), F.lit(True).alias("real")).distinct()
        judged = cur.withColumn("of", alike).join(best, ["of", "surrogate"]).join(
            real, ["of", "surrogate"], "left").withColumn(
            "clash", (F.col("owner") != F.col("entity")) | (F.col("owner_kind") != F.col("kind")) | F.col("real").isNotNull())
        if judged.where("clash").isEmpty():
            return cur.select("kind", "entity", "surrogate")
        again = judged.select("kind", "entity", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"))
        nxt = materialize(again.mapInArrow(run, schema), "surrogates")
        remove_table(cur)
        cur = nxt


def pseudonymise(docs: DataFrame, secret: bytes, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text, n_entities, spans) of every row, mentions replaced.

    ``spans`` are the surrogates' kind:start:end in the new text.  Texts without
    mentions stay as they are; a null text is empty.  Null and repeated keys and
    repeated rows stay; equal texts get equal results.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn(
        "blob", F.unhex(F.sha2("text", 256)))
    found = materialize(entities(rows.select("blob", "text")).distinct(), "entities")
    named = found.join(assign(found.select("kind", "entity").distinct(), secret), ["kind", "entity"])
    per_text = named.groupBy("blob").agg(F.collect_list(F.struct("kind", "entity", "surrogate")).alias("names"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out = [replace(t.decode(), {(n["kind"], n["entity"]): n["surrogate"] for n in names}) if names
                   else (t.decode(), "")
                   for t, names in zip(byte_list(b.column("text")), b.column("names").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([x for x, _ in out], pa.string()),
                 pa.array([s.count(",") + 1 if s else 0 for _, s in out], pa.int64()),
                 pa.array([s for _, s in out], pa.string())], ["doc_id", "text", "n_entities", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.join(per_text.hint("merge"), "blob", "left").select("doc_id", "text", "names").mapInArrow(
        run, f"doc_id {kind}, text string, n_entities long, spans string")

"""Surrogates for personal data, in built-in functions only.

One expression finds entities in one scan of each text; those with a check digit count only if it holds. An entity is
replaced by a value of its own kind that a keyed digest (HMAC) makes from its canonical form: the same entity gets the same
surrogate everywhere, in whatever format it is written. Letters stay letters of their case and script, digits digits,
punctuation stays; names keep gender and script, card and account numbers their check digits. A person is a title, which
stays, a given name and a surname, each an entity of its own: who shares a surname shares its surrogate, and two persons
never become one. All entities of the corpus are checked: where two share a surrogate, or a surrogate is an entity
that is there (its own included), the later one is made anew with the next number, in a space that grows with it for names, until
all differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import maybe_broadcast, stash, table, unstash

#: The key of the registered query; others pass their own, from where they keep secrets.
KEY = b"surrogate-key-1"

# Given names by gender and script, titles, cues before a name, syllables and ends of made-up names.
NAMES = {
    ("f", "latin"): "Anna Maria Laura Julia Sarah Emma Sofia Elena Clara Alice Marta Nina Paula Lucia Irene Eva".split(),
    ("m", "latin"): "John Peter Paul Thomas Daniel Martin David Lucas Simon Adrian Oscar Hugo Felix Bruno Leon Victor".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана".split(),
    ("m", "cyrillic"): "Иван Пётр Павел Сергей Андрей Дмитрий Николай Виктор".split(),
}
TITLES = {"f": "Mrs Ms Miss Frau Mme Sra Señora".split(), "m": "Mr Herr Monsieur Sr Señor".split(), "x": "Dr Prof".split()}
CUES = ("name is", "named", "signed by", "written by", "Name:", "Author:", "Contact:", "Attn:", "From:", "Dear", "egards,", "incerely,")
NO_NAMES = ("Sir", "Madam", "All", "Team", "Customer", "Support", "The")
ENDS = {("f", "latin"): "a", ("m", "latin"): "n", ("f", "cyrillic"): "я", ("m", "cyrillic"): "н"}
SYLLABLES = {"latin": "ba be bi bo da de di do fa fe ga go ka ke la le li lo ma me mi mo na ne no pa ra re ri ro sa se so ta te to va ve vi zo".split(), "cyrillic": "ба бе би бо ва ве ви га го да де до ка ко ла ле ли ло ма ме ми мо на не но па по ра ре ри ро са се со та те то ха хо".split()}

_either = lambda words: "|".join(sorted({x for w in words for x in (w, w.upper())}, key=lambda x: (-len(x), x)))
_TITLE = rf"(?:{_either(t for v in TITLES.values() for t in v)})\.? "
_WORD = rf"(?!(?:{'|'.join(NO_NAMES)})\b)\p{{Lu}}[\p{{L}}'’-]+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_H = r"[0-9A-Fa-f]{1,4}"
# Forms of entities, in the order in which they are tried; none has a group. All begin where no letter or digit is before.
FORMS = (
    ("email", r"[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("ip", rf"(?<!\d\.)(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"),
    ("ip6", rf"(?<!:)(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,6}}(?::{_H}){{1,6}})(?![\w:])"),
    ("iban", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("phone", r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4}(?!\d|\.\d)"),
    ("card", r"(?:\d{13,19}|\d{4}(?: \d{4}){2} \d{1,7}|\d{4}(?:-\d{4}){2}-\d{1,7}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?![\p{L}\d])"),
    ("ssn", r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])"),
    ("secret", r"AKIA[A-Z0-9]{16}\b|(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![\p{L}\d])|(?<=password=)[^\s\"']{6,}"),
    ("person", rf"(?=\p{{Lu}})(?:{_TITLE}{_WORD}(?: {_WORD}){{0,2}}|(?:{_either(n for v in NAMES.values() for n in v)}) {_WORD}|(?<=(?:{'|'.join(CUES)})[ \n]){_WORD}(?: {_WORD}){{0,2}})"),
)
_ANY = r"(?<![\p{L}\p{N}_])(?:" + "|".join(f"({p})" for _, p in FORMS) + ")"
#: Code points that no character has: one that the text does not hold goes around entities, another between the forms.
_MARKS = ("﷐", "﷑", "﷒", "﷓")
_BETWEEN = "﷔"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parts_of(text: Column) -> Column:
    """The text as an array of what is plain (even places) and entities (odd places); an entity stands in the field of its form. A text that
    holds all of the marks, or the one between forms, has the white space of a match in it and is scanned once more for the gaps."""
    fields = lambda m: m + _BETWEEN.join(f"${k + 1}" for k in range(len(FORMS))) + m
    marked = lambda m: F.split(F.regexp_replace(text, _ANY, fields(m)), m)
    gaps, found = F.split(text, _ANY, -1), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))
    alone = F.transform(found, lambda x: F.regexp_replace(x, _ANY, _BETWEEN.join(f"${k + 1}" for k in range(len(FORMS)))))
    slow = F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), alone.alias("f")), lambda z: F.array_compact(F.array(z["g"], z["f"]))))
    out = slow
    for m in reversed(_MARKS):
        out = F.when(~F.contains(text, F.lit(m)), marked(m)).otherwise(out)
    return F.when(text.isNull(), F.lit(None).cast("array<string>")).otherwise(F.when(F.contains(text, F.lit(_BETWEEN)), slow).otherwise(out))


def _form(part: Column) -> Column:
    """(kind, m) of an entity's part."""
    m = F.translate(part, _BETWEEN, "")
    return F.struct(F.get(F.array(*(F.lit(k) for k, _ in FORMS)), F.instr(part, m) - 1).alias("kind"), m.alias("m"))


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The remainder by 10 of the sum that a card's check digit brings to zero."""
    d = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 1, F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") * 2 / 10)).otherwise(c.cast("int")).cast("int"))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10


def _mod97(iban: Column) -> Column:
    """The remainder by 97 of an account number without spaces, 1 if its check digits hold."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    return F.aggregate(_chars(turned), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97).cast("int"))


def _valid(kind: Column, m: Column) -> Column:
    return F.when(kind == "card", _luhn(_digits(m)) == 0).when(kind == "iban", _mod97(F.translate(m, " ", "")) == 1).otherwise(F.lit(True))


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _gender(title: Column, given: Column) -> Column:
    """By the name if it is a known one, else by the title, else by its end."""
    own = lambda g: [n.lower() for (x, _), v in NAMES.items() if x == g for n in v]
    said = lambda g: [x for t in TITLES[g] for x in (t, t.upper())]
    low = F.lower(given)
    return F.when(low.isin(own("f")), "f").when(low.isin(own("m")), "m").when(title.isin(said("f")), "f").when(title.isin(said("m")), "m").when(low.rlike("[aeiаяие]$"), "f").otherwise("m")


def person_parts(m: Column) -> Column:
    """(title with its space, given name or '', surname, gender)."""
    def rest(t: Column) -> Column:
        return _let(F.substring(m, F.length(t) + 1, F.length(m)), lambda r: named(t, r))

    def named(t: Column, r: Column) -> Column:
        last = F.substring_index(r, " ", -1)
        given = F.rtrim(F.substring(r, F.lit(1), F.length(r) - F.length(last)))
        return F.struct(t.alias("title"), given.alias("given"), last.alias("last"), _gender(F.regexp_replace(t, r"\.? $", ""), given).alias("gender"))

    return _let(F.regexp_extract(m, rf"^(?:{_TITLE})?", 0), rest)


def atoms(kind: Column, m: Column) -> Column:
    """Array of (kind, m): what gets a surrogate of its own. A person's are the surname and the given name with its gender."""
    atom = lambda k, x: F.struct(k.alias("kind"), x.alias("m"))
    def of(p: Column) -> Column:
        last = atom(F.lit("surname"), p["last"])
        return F.when(p["given"] == "", F.array(last)).otherwise(F.array(last, atom(F.concat(F.lit("given-"), p["gender"]), p["given"])))

    return F.when(kind == "person", _let(person_parts(m), of)).otherwise(F.array(atom(kind, m)))


def canon(kind: Column, m: Column) -> Column:
    """What identifies an entity in any format."""
    family = F.regexp_replace(F.lower(m), "(ов|ев|ин)а$", "$1")
    return F.when(kind.isin("phone", "card", "ssn"), _digits(m)).when(kind == "iban", F.translate(m, " ", "")).when(kind == "surname", family).when(kind == "secret", F.when(m.rlike("^[0-9A-F]{32,64}$"), F.lower(m)).otherwise(m)).otherwise(F.lower(m))


def hmac(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 in hexadecimal."""
    import hashlib

    k = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda b: F.lit(bytes(x ^ b for x in k))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))), 256)


def _byte(digest: Column, i: Column) -> Column:
    """The byte of a place from 0; beyond the digest's end they come again, shifted."""
    return F.conv(F.substring(digest, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int") + F.floor(i / 32).cast("int") * 7


# Letters that one of a class becomes; with the last mark on, a to f are digits of a number.
_ALPHABETS = (("[0-9]", "0123456789"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (r"[а-яё]", "абвгдежзиклмнопрстуфхцчшэюя"), (r"[А-ЯЁ]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"), (r"\p{Lu}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (r"[\p{L}\p{N}]", "abcdefghijklmnopqrstuvwxyz"))
_KNOWN = r"[\p{L}\p{N}]"


def _like(s: Column, digest: Column, hexadecimal: Column) -> Column:
    """``s`` with its letters and digits dealt anew from the digest, counted without the marks between them."""
    zero = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))

    def letters(c: Column) -> Column:
        of = F.lit(_ALPHABETS[-1][1])
        for test, a in reversed(_ALPHABETS[:-1]):
            a = F.when(hexadecimal, F.substring(F.lit(a), 1, 6)).otherwise(a) if test in ("[a-z]", "[A-Z]") else F.lit(a)
            of = F.when(c.rlike(test), a).otherwise(of)
        return of

    def step(a: Column, c: Column) -> Column:
        one = _let(letters(c), lambda x: F.substring(x, F.pmod(_byte(digest, a["n"]), F.length(x)) + 1, F.lit(1)))
        return F.when(c.rlike(_KNOWN), F.struct((a["n"] + 1).alias("n"), F.concat(a["out"], one).alias("out"))).otherwise(F.struct(a["n"].alias("n"), F.concat(a["out"], c).alias("out")))

    return F.aggregate(_chars(s), zero, step)["out"]


def _with_luhn(made: Column) -> Column:
    """A card number whose last digit is made the check digit."""
    return _let(_digits(made), lambda x: F.concat(F.substring(made, F.lit(1), F.length(made) - 1), F.pmod(-_luhn(F.concat(F.substring(x, F.lit(1), F.length(x) - 1), F.lit("0"))), F.lit(10)).cast("string")))


def _with_mod97(made: Column) -> Column:
    """An account number whose check digits hold."""
    zero = F.concat(F.substring(made, 1, 2), F.lit("00"), F.substring(made, F.lit(5), F.length(made)))
    return F.concat(F.substring(made, 1, 2), F.lpad((98 - _mod97(F.translate(zero, " ", ""))).cast("string"), 2, "0"), F.substring(made, F.lit(5), F.length(made)))


def _syllables(d: Column, script: str, n: Column) -> Column:
    parts = F.array(*map(F.lit, SYLLABLES[script]))
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(parts, F.pmod(_byte(d, i), F.lit(len(SYLLABLES[script]))))), "")


def _cased(word: Column, made: Column) -> Column:
    return F.when((F.upper(word) == word) & (F.length(word) > 1), F.upper(made)).otherwise(F.initcap(made))


def _digest(key: bytes, kind: Column, m: Column, number: Column) -> Column:
    return hmac(key, F.concat_ws("|", kind, canon(kind, m), number.cast("string")))


def name_surrogate(key: bytes, kind: Column, word: Column, number: Column) -> Column:
    """A surname is made of four syllables, and one more for each number. A given name is a known one for number 0, a made-up one of
    three syllables, and one more for each number, after that."""
    def made(d: Column) -> Column:
        family = F.regexp_extract(F.lower(word), "(?:ов|ев|ин)а?$", 0)
        size = F.when(kind == "surname", number + 4).otherwise(number + 2)

        def of(script: str) -> Column:
            end = F.when(kind == "given-f", ENDS["f", script]).when(kind == "given-m", ENDS["m", script]).otherwise(family)
            return F.concat(_syllables(d, script, size), end)

        known = F.lit(None).cast("string")
        for (gender, script), names in NAMES.items():
            own = F.get(F.array(*map(F.lit, names)), F.pmod(_byte(d, F.lit(0)), F.lit(len(names))))
            known = F.when((number == 0) & (kind == f"given-{gender}") & (_script(word) == script), own).otherwise(known)
        return F.coalesce(known, F.when(_script(word) == "cyrillic", of("cyrillic")).otherwise(of("latin")))

    return _let(_let(_digest(key, kind, word, number), made), lambda x: F.when((F.upper(word) == word) & (F.length(word) > 1), F.upper(x)).otherwise(F.initcap(x)))


def other_surrogate(key: bytes, kind: Column, m: Column, number: Column) -> Column:
    """What is dealt anew sign by sign: the local part of an address, the rest whole, with what its kind keeps."""
    domain = F.substring_index(m, "@", -1)
    inner = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1)
    host = _let(hmac(key, F.concat(F.lit("domain|"), F.lower(inner))), lambda h: _like(inner, h, F.lit(False)))
    number_like = (kind == "ip6") | ((kind == "secret") & m.rlike("^(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})$"))
    keeps = F.when(kind.isin("phone", "iban"), 2).when(kind == "card", 1).when((kind == "secret") & m.rlike("^AKIA[A-Z0-9]{16}$"), 4).otherwise(0)

    def made(d: Column) -> Column:
        ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_byte(d, i) % 254 + 1).cast("string")), ".")
        whole = _like(F.when(kind == "email", F.substring_index(m, "@", 1)).otherwise(m), d, number_like)
        kept = _let(whole, lambda x: F.concat(F.substring(m, F.lit(1), keeps), F.substring(x, keeps + 1, F.length(x))))
        ssn = lambda x: F.concat((_byte(d, F.lit(31)) % 5 + 1).cast("string"), F.substring(x, F.lit(2), F.length(x)))
        own = lambda x: F.when(kind == "email", F.concat(x, F.lit("@"), host, F.lit("."), F.substring_index(domain, ".", -1))).when(kind == "card", _with_luhn(x)).when(kind == "iban", _with_mod97(x)).when(kind == "ssn", ssn(x)).otherwise(x)
        return F.when(kind == "ip", ip).otherwise(_let(kept, own))

    return _let(_digest(key, kind, m, number), made)


def surrogate(key: bytes, kind: Column, m: Column, number: Column) -> Column:
    """The replacement of an atom; its number is 0 unless the check has made it larger."""
    return F.when(kind.isin("surname", "given-f", "given-m"), name_surrogate(key, kind, m, number)).otherwise(other_surrogate(key, kind, m, number))


def renumbered(found: DataFrame, key: bytes, rounds: int = 60) -> DataFrame:
    """(kind, canon, number) of the atoms of ``found(kind, m)`` whose surrogate of number 0 would not do.

    Given names of both genders are checked together. A kind whose format has room for fewer than twice its entities cannot be
    dealt anew without a clash, and ends in an error.
    """
    own = stash(found.groupBy("kind", canon(F.col("kind"), F.col("m")).alias("canon")).agg(F.min("m").alias("m")).withColumn("number", F.lit(0)), "pii-entities")
    group = F.substring_index("kind", "-", 1)
    for _ in range(rounds):
        made = own.withColumn("sc", canon(F.col("kind"), surrogate(key, F.col("kind"), F.col("m"), F.col("number")))).withColumn("group", group)
        nth = F.row_number().over(Window.partitionBy("group", "sc").orderBy("number", "kind", "canon"))
        taken = own.select(group.alias("group"), F.col("canon").alias("sc")).distinct().withColumn("taken", F.lit(True))
        again = ((F.col("nth") > 1) | F.coalesce("taken", F.lit(False))).cast("int")
        nxt = stash(made.withColumn("nth", nth).join(taken, ["group", "sc"], "left").select("kind", "canon", "m", (F.col("number") + again).alias("number"), again.alias("again")), "pii-entities")
        unstash(own)
        own = nxt
        if own.where("again = 1").isEmpty():
            return own.where("number > 0").select("kind", "canon", "number")
        own = own.drop("again")
        own._stash_path = nxt._stash_path
    raise RuntimeError("surrogates do not come apart: a format has too little room for its entities")


def replace_pii(docs: DataFrame, text: str = "text", key: bytes = KEY) -> DataFrame:
    """``docs`` with the entities of ``text`` replaced, and ``n_entities``; a column of this name is replaced, all others stay.

    A null text stays null with no entities; a text without entities stays as it is; rows that repeat are alike; an empty
    table gives an empty one. Texts are scanned once, whole, and written to the shared folder in parts; only entities are
    shuffled. Texts with an entity whose number the check has changed meet the numbers by their row; the others do not move.
    """
    own = [c for c in docs.columns if c != "n_entities"]
    others = [F.col(f"`{c}`") for c in own if c != text]
    rest = F.struct(*others) if others else F.lit(0)
    cut = stash(docs.select(rest.alias("doc"), parts_of(F.col(f"`{text}`")).alias("parts")).withColumn("row", F.monotonically_increasing_id()), "pii-parts")
    odd = F.filter("parts", lambda p, i: i % 2 == 1)
    entity = cut.where("size(parts) > 1").select("row", F.explode(odd).alias("p")).select("row", _form(F.col("p")).alias("e")).where(_valid(F.col("e.kind"), F.col("e.m")))
    distinct = entity.select("e").distinct()
    found = stash(distinct.select(F.inline(atoms(F.col("e.kind"), F.col("e.m")))).distinct(), "pii-found")
    other = stash(renumbered(found, key), "pii-other")
    many = other.count()
    name = lambda k, c: F.concat_ws("|", k, c)
    with_entities = cut.where("size(parts) > 1").withColumn("numbers", F.lit(None).cast("map<string,int>"))
    if many:
        keyed = other.select(name(F.col("kind"), F.col("canon")).alias("k"), "number")
        at = entity.select("row", F.inline(atoms(F.col("e.kind"), F.col("e.m")))).select("row", name(F.col("kind"), canon(F.col("kind"), F.col("m"))).alias("k")).distinct()
        per = stash(at.join(maybe_broadcast(keyed, many), "k").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("k", "number"))).alias("numbers")), "pii-numbers")
        with_entities = with_entities.drop("numbers").join(maybe_broadcast(per, per.count(), 100_000), "row", "left")
    number = lambda k, m: F.coalesce(F.try_element_at("numbers", name(k, canon(k, m))), F.lit(0))

    def person(p: Column) -> Column:
        kinds = F.array(F.struct(F.concat(F.lit("given-"), p["gender"]).alias("kind"), p["given"].alias("m")), F.struct(F.lit("surname").alias("kind"), p["last"].alias("m")))
        named = F.transform(F.filter(kinds, lambda a: a["m"] != ""), lambda a: name_surrogate(key, a["kind"], a["m"], number(a["kind"], a["m"])))
        return F.concat(p["title"], F.array_join(named, " "))

    def replaced(e: Column) -> Column:
        other = other_surrogate(key, e["kind"], e["m"], number(e["kind"], e["m"]))
        return F.when(~_valid(e["kind"], e["m"]), e["m"]).when(e["kind"] == "person", _let(person_parts(e["m"]), person)).otherwise(other)

    made = with_entities.withColumn("n", F.size(F.filter(odd, lambda p: _let(_form(p), lambda e: _valid(e["kind"], e["m"])))))
    made = made.withColumn("text", F.array_join(F.transform("parts", lambda p, i: F.when(i % 2 == 1, _let(_form(p), replaced)).otherwise(p)), ""))
    plain = cut.where("parts IS NULL OR size(parts) <= 1").select("doc", F.get("parts", F.lit(0)).alias("text"), F.lit(0).alias("n"))
    out = plain.unionByName(made.select("doc", "text", "n"))
    unstash(found)
    return out.select(*(F.col("text").alias(c) if c == text else F.col("doc")[c].alias(c) for c in own), F.col("n").cast("long").alias("n_entities"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_entities")

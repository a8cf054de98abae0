"""Operator 4, PII: keyed surrogates that keep type, format, script and gender, in DataFrame operations alone.

One pattern with an alternative for each type cuts a text, in one pass, into gaps and entities. The surrogate of an
entity is a function of a secret key, its type, its canonical form and an attempt number, so the same number or address
gets the same surrogate everywhere without any exchange of data. Names are keyed part by part, a given name together
with the gender of the title, so that "Mr John Smith" and "Mr Smith" stay one person. The distinct entities and parts of
the corpus are then checked: two that meet in one surrogate, or a surrogate that is a real entity, take the next attempt
until all are distinct, in every written form. Later attempts have more room: names grow by keyed letters, and so do the
local parts of e-mail addresses. Types of fixed form cannot grow; where their room is too small for the corpus an error
says so. Only texts that hold such an entity need to be told; they get their attempts by a join, and where there is none
the join is left out.

No pattern has an unbounded group that could backtrack, so the time and the stack that a text takes do not depend on
what is in it but for its length. A card number is one only if its issuer's digits exist and its check digit is right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, settings, settle

# Titles by gender, scripts with their letters.
_MALE = ["Mr", "Herr", "Sr", "Monsieur", "Señor", "Господин", "Κύριος"]
_FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Sra", "Madame", "Señora", "Госпожа", "Κυρία"]
_LATIN = "abcdefghijklmnopqrstuvwxyz"
_CYRILLIC = "абвгдежзиклмнопрстуфхцчшя"
_GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
_MALE_NAMES = ["Adam", "Boris", "Carl", "David", "Emil", "Frank", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Nico", "Oscar", "Paul"]
_FEMALE_NAMES = ["Anna", "Berta", "Clara", "Dora", "Emma", "Frida", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula"]
_MORE = 16  # the most syllables or letters that later attempts add
_SYLLABLES = ["ba", "de", "fi", "go", "hu", "ka", "le", "mi", "no", "pu", "ra", "se", "ti", "vo", "wu", "za"]

_EDGE = r"""[^\s@"'<>(),;:|\[\]{}=]"""
_TITLES = "|".join(sorted(_MALE + _FEMALE, key=len, reverse=True))
PATTERNS = {
    "email": rf"(?<!{_EDGE}){_EDGE}++@[\p{{L}}\p{{N}}-]++(?:\.[\p{{L}}\p{{N}}-]++)++",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?!\d)|(?<![\p{L}\p{N}+(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\p{L}\p{N}+.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "national_id": r"(?<![\p{L}\p{N}.-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk[-_][A-Za-z0-9_-]{16,})",
    "card": r"(?<![\p{L}\p{N}.-])(?=[3-6]|2[2-7])(?:\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}|\d{13,19})(?![\p{L}\p{N}])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLES})\.? \p{{Lu}}\p{{L}}+(?:[ -]\p{{Lu}}\p{{L}}+){{0,2}}",
}
TYPES = list(PATTERNS)
# Marks of what is cut: a text's own control character is doubled by another one first.
_OWN, _OWN_AS, _CUT = "\x01", "\x01\x02", "\x01\x03"
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_ANY = _ANY.replace(r"([ -]?)\d{4}\1\d{4}\1", r"(?<s>[ -]?)\d{4}\k<s>\d{4}\k<s>")
_HINT = rf"[0-9@]|(?:{_TITLES})\.? \p{{Lu}}|AKIA|gh[pousr]_|sk[-_]"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def type_of(entity: Column) -> Column:
    """The first type whose pattern the whole entity has; null for a number that only looks like a card's."""
    out = F.lit("name")
    for name in reversed(TYPES[:-1]):
        kind = F.lit(name) if name != "card" else F.when(_luhn(F.regexp_replace(entity, r"[^0-9]", "")) % 10 == 0, F.lit(name))
        out = F.when(entity.rlike(_whole(PATTERNS[name])), kind).otherwise(out)
    return out


def pieces_of(text: Column) -> Column:
    """The text cut at its entities: gap, entity, gap, ..., gap. Texts without digit, @ or title are one gap."""
    marked = F.regexp_replace(F.replace(text, F.lit(_OWN), F.lit(_OWN_AS)), _ANY, f"{_CUT}$0{_CUT}")
    cut = F.transform(F.split(marked, _CUT, -1), lambda p: F.replace(p, F.lit(_OWN_AS), F.lit(_OWN)))
    return F.when(text.rlike(_HINT), cut).otherwise(F.array(text))


def entities_in(pieces: Column) -> Column:
    """The entities among the pieces, in order, as structs (e, k): the text and its type."""
    found = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.struct(p.alias("e"), type_of(p).alias("k"))))
    return F.filter(found, lambda x: x.k.isNotNull())


def _name_parts(entity: Column, part, join, words_join):
    """``part(kind, word)`` of each hyphenated part of each word after the title, put together by the two functions."""
    title = F.regexp_extract(entity, rf"^(?:{_TITLES})\.? ", 0)
    given = F.when(title.rlike(rf"^(?:{'|'.join(_FEMALE)})\b"), F.lit("given_female")).otherwise(F.lit("given_male"))
    words = F.split(F.substring(entity, F.length(title) + 1, F.length(entity)), " ")
    kind = lambda i: F.when(i < F.size(words) - 1, given).otherwise(F.lit("surname"))
    return title, words_join(F.transform(words, lambda w, i: join(F.transform(F.split(w, "-"), lambda p: part(kind(i), p)))))


def units_of(entity: Column, kind: Column) -> Column:
    """What is keyed in an entity, as structs (kind, canon, sample): itself, or the parts of a name."""
    unit = lambda k, e: F.struct(k.alias("kind"), canonical(e, k).alias("canon"), e.alias("sample"))
    return F.when(kind == "name", _name_parts(entity, unit, lambda x: x, F.flatten)[1]).otherwise(F.array(unit(kind, entity)))


def canonical(entity: Column, kind: Column) -> Column:
    """What makes two mentions one: the digits of numbers, else the lower-case letters."""
    digits = F.regexp_replace(entity, r"[^0-9]", "")
    return (
        F.when(kind.isin("phone", "card", "national_id"), digits)
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .otherwise(F.lower(entity))
    )


def _stream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """Keyed hexadecimal digits, four for each character of the canonical form and 64 more."""
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string"), F.lit(key)), 256)
    blocks = F.sequence(F.lit(0), F.floor(F.length(canon) / 16).cast("int") + 1)
    return _let(seed, lambda s: F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("\x1f", F.lit(key), s, b.cast("string")), 256)), ""))


def _at(stream: Column, i: Column) -> Column:
    """A number from 0 to 255 for position i."""
    return F.conv(F.substring(stream, i * 2 + 1, 2), 16, 10).cast("int")


def _nth(letters: str, i: Column) -> Column:
    return F.substring(F.lit(letters), (i % len(letters)) + 1, 1)


def _letterwise(text: Column, stream: Column, letters: str = _LATIN) -> Column:
    """Each digit by a digit and each letter by one of its script and case; other characters stay. Linear in the text."""

    def one(c: Column, x: Column) -> Column:
        small = F.when(c.rlike(r"\p{IsCyrillic}"), _nth(_CYRILLIC, x)).when(c.rlike(r"\p{IsGreek}"), _nth(_GREEK, x)).otherwise(_nth(letters, x))
        return F.when(c.rlike(r"[0-9]"), (x % 10).cast("string")).when(c.rlike(r"\p{Lu}"), F.upper(small)).when(c.rlike(r"\p{L}"), small).otherwise(c)

    numbers = F.regexp_extract_all(stream, F.lit(".."), F.lit(0))
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return _let(numbers, lambda n: F.array_join(F.transform(chars, lambda c, i: one(c, F.conv(n[i], 16, 10).cast("int"))), ""))


def _luhn(digits: Column) -> Column:
    """The sum whose last digit is 0 for a valid card number."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _number(canon: Column, kind: Column, stream: Column) -> Column:
    """As many digits; a card number keeps the first two, which tell its issuer, and is valid."""
    digits = lambda n: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: (_at(stream, i) % 10).cast("string")), "")
    head = F.concat(F.substring(canon, 1, 2), digits(F.length(canon) - 3))
    valid = _let(head, lambda d: F.concat(d, ((10 - _luhn(F.concat(d, F.lit("0"))) % 10) % 10).cast("string")))
    return F.when(kind == "card", valid).otherwise(digits(F.length(canon)))


def _in_format(entity: Column, number: Column) -> Column:
    """Lays the digits of ``number`` in the places of the entity's; a country code after + stays."""
    code = F.length(F.regexp_extract(entity, r"^\+(\d{1,3})", 1))

    def one(c: Column, i: Column) -> Column:
        at = F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), r"[^0-9]", ""))
        return F.when(c.rlike(r"[0-9]") & (at > code), F.substring(number, at, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(entity, ""), lambda c: c != ""), one), "")


def _part(word: Column, kind: Column, stream: Column, attempt: Column) -> Column:
    """A part of a name: a given name of the gender, or a surname of keyed syllables; other scripts letter by letter.

    Each attempt but the first adds a syllable, or a letter of the script. All capitals stay all capitals.
    """
    more = F.least(attempt, F.lit(_MORE))
    pick = lambda names, x: F.element_at(F.array(*map(F.lit, names)), (x % len(names)) + 1)
    syllable = lambda k: pick(_SYLLABLES, _at(stream, k))
    added = F.array_join(F.transform(F.slice(F.sequence(F.lit(0), F.lit(_MORE)), F.lit(1), more), lambda k: syllable(k + 20)), "")
    made = F.when(kind == "given_female", pick(_FEMALE_NAMES, _at(stream, F.lit(0)))).when(kind == "given_male", pick(_MALE_NAMES, _at(stream, F.lit(0)))).otherwise(F.initcap(F.concat(*(syllable(F.lit(k)) for k in range(4)))))
    made = F.concat(made, added)
    made = F.when((F.length(word) > 1) & (word == F.upper(word)), F.upper(made)).otherwise(made)
    longer = F.concat(word, F.repeat(F.lower(F.right(word, F.lit(1))), more))
    return F.when(word.rlike(r"^\p{IsLatin}+$"), made).otherwise(_letterwise(longer, stream))


def surrogate(entity: Column, kind: Column, canon: Column, stream: Column, attempt: Column) -> Column:
    """The replacement of an entity or a part of a name, made of the keyed stream of its canonical form and attempt."""
    more = F.least(F.greatest(attempt - 3, F.lit(0)), F.lit(_MORE))  # the first attempts at an address keep its length
    local, domain = F.concat(F.substring_index(entity, "@", 1), F.repeat(F.lit("x"), more)), F.substring_index(entity, "@", -1)
    tld = F.regexp_extract(domain, r"\.[^.]*$", 0)
    name = F.substring(domain, F.lit(1), F.length(domain) - F.length(tld))
    tail = F.substring(stream, F.length(local) * 2 + 1, F.length(stream))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: _at(stream, i).cast("string")), ".")
    return (
        F.when(kind == "email", F.concat(_letterwise(local, stream), F.lit("@"), _letterwise(name, tail), tld))
        .when(kind == "ip", octets)
        .when(kind.isin("phone", "card", "national_id"), _let(_number(canon, kind, stream), lambda d: _in_format(entity, d)))
        .when(kind == "secret", F.when(entity.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), _hex(entity, stream)).otherwise(F.concat(F.substring(entity, 1, 4), _letterwise(F.substring(entity, F.lit(5), F.length(entity)), stream))))
        .when(kind == "iban", F.concat(F.substring(entity, 1, 2), _letterwise(F.substring(entity, F.lit(3), F.length(entity)), stream)))
        .otherwise(_part(entity, kind, stream, attempt))
    )


def _hex(entity: Column, stream: Column) -> Column:
    out = F.substring(stream, F.lit(1), F.length(entity))
    return F.when(entity.rlike("[A-F]"), F.upper(out)).otherwise(out)


def _replacement(entity: Column, key: str, attempts: Column | None) -> Column:
    """The surrogate of a piece that the pattern found; the piece itself if it is no entity after all."""

    def made(kind: Column, sample: Column) -> Column:
        attempt = F.lit(0) if attempts is None else F.coalesce(attempts[F.concat_ws("\x1f", kind, canonical(sample, kind))], F.lit(0))
        unit = F.struct(kind.alias("k"), canonical(sample, kind).alias("c"), attempt.alias("a"), sample.alias("e"))
        return _let(unit, lambda u: _let(_stream(key, u.k, u.c, u.a), lambda s: surrogate(u.e, u.k, u.c, s, u.a)))

    title, names = _name_parts(entity, made, lambda x: F.array_join(x, "-"), lambda x: F.array_join(x, " "))
    return _let(type_of(entity), lambda k: F.when(k.isNull(), entity).when(k == "name", F.concat(title, names)).otherwise(made(k, entity)))


def replace_entities(pieces: Column, key: str, attempts: Column | None = None) -> Column:
    """The text of the pieces, entities replaced; ``attempts``: a map from kind and canonical form to the attempt number."""
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 0, p).otherwise(_replacement(p, key, attempts))), "")


def attempts_of(entities: DataFrame, key: str, max_rounds: int = 100) -> DataFrame:
    """(kind, canon, attempt) for distinct written forms (kind, canon, sample), so that all surrogates differ.

    In each round, of the entities that share a surrogate in any form the one first in order keeps it; the others, and
    those with a surrogate that is an entity of the corpus, take the next attempt. Collisions that outlast the rounds
    are an error: the types of fixed form have only so many surrogates.
    """
    now = settle(_with_surrogates(entities.withColumn("attempt", F.lit(0)), key), "pii-entities")
    real = now.select("kind", F.col("canon").alias("made")).distinct()
    with settings(entities.sparkSession, spark__sql__codegen__wholeStage="false"):  # small plans, not worth compiling
        for left in reversed(range(max_rounds + 1)):
            shared = now.groupBy("kind", "made").agg(F.min("canon").alias("first"), F.max("canon").alias("last")).where("first <> last")
            late = now.join(shared, ["kind", "made"]).where("canon <> first").select("kind", "canon")
            taken = now.join(real, ["kind", "made"], "left_semi").select("kind", "canon")
            bad = settle(late.unionByName(taken).distinct(), "pii-collisions")
            if bad.isEmpty():
                break
            if not left:
                kinds = {r["kind"]: r["count"] for r in bad.groupBy("kind").count().collect()}  # a row for each type
                raise ValueError(f"entities without a surrogate of their own after {max_rounds} rounds: {kinds}")
            flagged = now.join(bad.withColumn("bad", F.lit(1)), ["kind", "canon"], "left")
            raised = flagged.where("bad = 1").select("kind", "canon", "sample", (F.col("attempt") + 1).alias("attempt"))
            now = settle(flagged.where("bad is null").drop("bad").unionByName(_with_surrogates(raised, key)), "pii-entities")
    return now.select("kind", "canon", "attempt").distinct()


def _with_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """Adds ``made``, the canonical form of the surrogate, to (kind, canon, sample, attempt)."""
    told = entities.withColumn("stream", _stream(key, F.col("kind"), F.col("canon"), F.col("attempt")))
    told = told.withColumn("made", surrogate(F.col("sample"), F.col("kind"), F.col("canon"), F.col("stream"), F.col("attempt")))
    return told.select("kind", "canon", "sample", "attempt", canonical(F.col("made"), F.col("kind")).alias("made"))


_SALTS = 16


def pseudonymise(docs: DataFrame, key: str, *, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the entities of ``text_col`` replaced; all columns and rows stay; ``count_col`` adds their number.

    The same entity has the same surrogate in every row, different entities have different ones; so have the parts of
    names. A null text stays null, an empty one empty. Repeated rows stay equal. An empty table stays empty. Texts
    without entities come back unchanged, whatever their length. Other columns are left alone, whatever their names.
    """
    taken = list(docs.columns)
    text = F.col(f"`{text_col}`")
    hash_name, salt_name, map_name, cut_name = (free_name(taken, n) for n in ("_text_key", "_salt", "_attempts", "_pieces"))
    found = docs.where(text.isNotNull()).select(F.xxhash64(text).alias("text_key"), F.explode(entities_in(pieces_of(text))).alias("x"))
    found = found.select("text_key", F.explode(units_of(F.col("x.e"), F.col("x.k"))).alias("u")).select("text_key", "u.*")
    found = settle(found.distinct(), "pii-mentions")
    attempts = attempts_of(found.select("kind", "canon", "sample").distinct(), key)
    raised = settle(attempts.where("attempt > 0"), "pii-raised")
    pieces = F.col(f"`{cut_name}`")
    columns = [F.col(f"`{c}`") for c in taken]

    def told(rows: DataFrame, new: Column) -> DataFrame:
        new = F.when(text.isNotNull(), new)
        count = [] if count_col is None else [F.when(text.isNull(), 0).otherwise(F.size(entities_in(pieces))).alias(count_col)]
        return rows.withColumn(cut_name, pieces_of(text)).select(*(new.alias(text_col) if n == text_col else c for n, c in zip(taken, columns, strict=True)), *count)

    if raised.isEmpty():
        return told(docs, replace_entities(pieces, key))
    # A row for each text with a raised unit, for each salt; rows that share a text, or have none, are dealt by the salt.
    entry = F.struct(F.concat_ws("\x1f", "kind", "canon").alias("k"), F.col("attempt").alias("v"))
    of_text = found.select("text_key", "kind", "canon").distinct().join(raised.select("kind", "canon", "attempt").hint("merge"), ["kind", "canon"])
    of_text = of_text.groupBy("text_key").agg(F.map_from_entries(F.collect_set(entry)).alias(map_name))
    of_text = of_text.select(F.col("text_key").alias(hash_name), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias(salt_name), map_name)
    others = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name != text_col and not f.dataType.simpleString().count("map<") and not f.dataType.simpleString().count("variant")]
    salt = F.pmod(F.xxhash64(F.lit(0), *others), F.lit(_SALTS)).cast("int")
    rows = docs.withColumns({hash_name: F.when(text.isNotNull(), F.xxhash64(text)), salt_name: salt}).join(of_text.hint("merge"), [hash_name, salt_name], "left")
    return told(rows, F.when(F.col(map_name).isNull(), replace_entities(pieces, key)).otherwise(replace_entities(pieces, key, F.col(map_name))))

"""Personal data and secrets replaced by keyed surrogates, in SQL functions.

Entities are found by one pattern. Each is brought to a normal form (an e-mail
in lower case, a number as its digits), so that all its spellings share one
surrogate, which is drawn from a keyed hash of that form: digits stay digits,
letters stay letters of their case, hexadecimal stays hexadecimal, signs and
spaces stay where they are, an address keeps its top-level domain and addresses
of one domain keep sharing one, a phone number keeps its country code, the parts
of an IP address stay in range, and a name becomes one of the same gender and
script.

Surrogates are checked over the whole corpus: two entities never share one, and
none is an entity that occurs. Whoever loses a clash draws again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalktally.llm import shared

# Titles that announce a name, and names to draw from.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Господжа", "Госпожа")
GIVEN = {
    ("latin", "male"): ("Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Henry", "Ivan", "Jonas", "Karl", "Leo", "Marco", "Noel", "Oscar", "Paul", "Simon"),
    ("latin", "female"): ("Alice", "Bella", "Clara", "Diana", "Emma", "Flora", "Hanna", "Irene", "Julia", "Karen", "Laura", "Maria", "Nora", "Olivia", "Paula", "Sofia"),
    ("cyrillic", "male"): ("Иван", "Павел", "Олег", "Антон", "Борис", "Денис", "Егор", "Кирилл"),
    ("cyrillic", "female"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Ольга", "Юлия"),
}
SYLLABLES = {
    "latin": "bar del fin gor hal jan kel lor mar nor pel quin ros sel tor val wen yor zan der",
    "cyrillic": "бар вел гор дан зор кор лен мар нов пол рос сан тав фин хол цер чар шев лин ром",
}

_NAME = r"\p{Lu}[\p{L}'’-]+(?:[ ]\p{Lu}[\p{L}'’-]+){0,2}"
_TITLE = "|".join((*MALE_TITLES, *FEMALE_TITLES))
# In the order in which a piece of text is judged.
PATTERNS = {
    # Bounds of the format: 64 characters before the sign, labels of 63, at most 127 of
    # them. It starts at an edge, so a long run is not tried from each of its letters.
    "email": (
        r"(?<![A-Za-z0-9])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?"
        r"@(?:[A-Za-z0-9-]{1,63}+\.){1,127}[A-Za-z]{2,63}"
    ),
    "secret": (
        r"(?<=\b(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key|key)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?)"
        r"[A-Za-z0-9_+/=-]{8,}"
        r"|\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{30,}\b|\b(?=[0-9a-fA-F]*[a-fA-F])(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{32,}\b"
    ),
    "iban": r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "phone": (
        r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)"
        r"|(?<![\d(])\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"
    ),
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.])(?:\d{4}[ -]){3}\d{4}(?!\d)|(?<![\d.])\d{13,19}(?!\d)",
    "name": rf"(?<=\b(?:{_TITLE})\.?[ ]){_NAME}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these holds nothing that the pattern finds.
_HINT = rf"\d|@|(?i:token|secret|passw|key)|(?:{_TITLE})\.?[ ]\p{{Lu}}"
ROUNDS = 64


def kind_of(entity: Column) -> Column:
    """The first kind that the whole entity has the form of."""
    hex_or_long = entity.rlike(r"^(?=.*\d)(?=.*[A-Za-z])[A-Za-z0-9_+/=-]+$") | ~entity.rlike(
        r"[\d@]|\p{L}.*\p{L}"
    )
    kind = F.when(entity.rlike(rf"^(?:{PATTERNS['email']})$"), "email")
    for name in ("iban", "ip", "phone", "ssn", "card"):
        kind = kind.when(entity.rlike(rf"^(?:{PATTERNS[name]})$"), name)
    return kind.when(hex_or_long, "secret").when(entity.rlike(rf"^{_NAME}$"), "name").otherwise("secret")


def entities(text: Column) -> Column:
    """All entities of a text in their order; none for a null text."""
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    return F.when(text.rlike(_HINT), found).otherwise(F.array().cast("array<string>"))


def normal(entity: Column, kind: Column) -> Column:
    digits = F.regexp_replace(entity, r"[^0-9]", "")
    return (
        F.when(kind == "email", F.lower(entity))
        .when(kind.isin("phone", "ssn", "card"), digits)
        .when(kind == "iban", F.regexp_replace(entity, " ", ""))
        .when(kind == "secret", F.when(entity.rlike("^[0-9a-fA-F]+$"), F.lower(entity)).otherwise(entity))
        .otherwise(entity)
    )


def _drawn(key: str, *what: Column) -> Column:
    """256 hexadecimal digits from a keyed hash."""
    seeds = (F.sha2(F.concat_ws("\x1f", F.lit(f"{key}\x1e{i}"), *what), 256) for i in range(4))
    return F.concat(*seeds)


def _number(stream: Column, place: Column, size: int) -> Column:
    """A number below ``size`` from four digits of the stream."""
    at = F.pmod(place * 4, F.lit(252)) + 1
    return F.pmod(F.conv(F.substr(stream, at, F.lit(4)), 16, 10).cast("int"), F.lit(size))


def _spelled(entity: Column, stream: Column, keep: Column, hexadecimal: Column) -> Column:
    """Every digit and letter of an entity drawn anew, in its case; the first
    ``keep`` of them and all signs stay. The draw goes by how many letters and
    digits stand before, so it is the same in every spelling."""

    # Bound once: in a function of a character they would be worked out for each.
    given = F.struct(
        entity.alias("text"), stream.alias("stream"), keep.alias("keep"), hexadecimal.alias("hex")
    )

    def spelled(g: Column) -> Column:
        def one(c: Column, place: Column) -> Column:
            letter = F.when(g["hex"], _number(g["stream"], place, 6)).otherwise(
                _number(g["stream"], place, 26)
            )
            return (
                F.when(place < g["keep"], c)
                .when(c.rlike("[0-9]"), F.char(_number(g["stream"], place, 10) + 48))
                .when(c.rlike("[a-z]"), F.char(letter + 97))
                .when(c.rlike("[A-Z]"), F.char(letter + 65))
                .otherwise(c)
            )

        def drawn(chars: Column) -> Column:
            counts = F.transform(chars, lambda c: c.rlike("[0-9A-Za-z]").cast("int"))
            return F.array_join(F.zip_with(chars, shared.sums_before(counts), one), "")

        return shared.let(_characters(g["text"]), drawn)

    return shared.let(given, spelled)


def _characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _checksum(digits: Column) -> Column:
    """Sum of the digits of a card, every second one from the last doubled."""
    turned = F.reverse(_characters(digits))

    def value(d: Column, i: Column) -> Column:
        n = d.cast("int") * (1 + i % 2)
        return F.when(n > 9, n - 9).otherwise(n)

    return F.aggregate(F.transform(turned, value), F.lit(0), lambda a, n: a + n) % 10


def _checked_card(entity: Column, drawn: Column) -> Column:
    """The last digit such that the checksum is right, if it was before."""

    def digits(text: Column) -> Column:
        return F.regexp_replace(text, "[^0-9]", "")

    head = F.left(drawn, F.length(drawn) - 1)
    last = F.pmod(10 - _checksum(F.concat(digits(head), F.lit("0"))), F.lit(10))
    return F.when(
        _checksum(digits(entity)) == 0, F.concat(head, last.cast("string"))
    ).otherwise(drawn)


def _checked_iban(entity: Column, drawn: Column) -> Column:
    """Both check digits such that the rest modulo 97 is right, if it was before."""

    def rest(text: Column, check: Column) -> Column:
        bare = F.regexp_replace(text, " ", "")
        turned = F.concat(F.substr(bare, F.lit(5)), F.left(bare, F.lit(2)), check)

        def on(left: Column, c: Column) -> Column:
            letter = F.ascii(c) - 55
            return F.when(c.rlike("[0-9]"), left * 10 + c.cast("int")).otherwise(left * 100 + letter) % 97

        return F.aggregate(_characters(turned), F.lit(0), on)

    given = F.substr(entity, F.lit(3), F.lit(2))
    check = F.lpad((98 - rest(drawn, F.lit("00"))).cast("string"), 2, "0")
    return F.when(
        rest(entity, given) == 1, F.concat(F.left(drawn, F.lit(2)), check, F.substr(drawn, F.lit(5)))
    ).otherwise(drawn)


def _name(entity: Column, gender: Column, stream: Column, attempt: Column) -> Column:
    """A given name of the gender, and a family name if there are two words. Every
    further draw has a syllable more to choose, so there are always free names."""
    cyrillic = entity.rlike(r"\p{IsCyrillic}")
    two = F.contains(entity, F.lit(" "))

    def made(script: str) -> Column:
        lists = {g: F.array(*map(F.lit, GIVEN[script, g])) for g in ("male", "female")}
        size = len(GIVEN[script, "male"])
        given = F.when(
            gender == "female", F.get(lists["female"], _number(stream, F.lit(0), size))
        ).otherwise(F.get(lists["male"], _number(stream, F.lit(0), size)))
        parts = F.array(*map(F.lit, SYLLABLES[script].split()))
        family = F.initcap(
            F.array_join(
                F.transform(
                    F.sequence(F.lit(1), attempt + 4), lambda i: F.get(parts, _number(stream, i, 20))
                ),
                "",
            )
        )
        return F.when(two, F.concat_ws(" ", given, family)).otherwise(family)

    return F.when(cyrillic, made("cyrillic")).otherwise(made("latin"))


def surrogate(entity: Column, kind: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The surrogate of an entity in its spelling, at its ``attempt``-th draw."""
    norm = normal(entity, kind)
    stream = _drawn(key, kind, norm, attempt.cast("string"))
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    top = F.substring_index(domain, ".", -1)
    rest = F.substr(domain, F.lit(1), F.length(domain) - F.length(top))
    of_domain = _drawn(key, F.lit("domain"), F.lower(domain), F.lit(""))
    none, plain = F.lit(0), F.lit(False)
    octets = F.concat_ws(
        ".", *((_number(stream, F.lit(i), 254) + 1).cast("string") for i in range(4))
    )
    code = F.when(
        F.startswith(entity, F.lit("+")), F.length(F.regexp_extract(entity, r"^\+(\d{1,3}?)(?=[ .(-]|\d{6})", 1))
    ).otherwise(0)
    return (
        F.when(
            kind == "email",
            F.concat(_spelled(local, stream, none, plain), F.lit("@"), _spelled(rest, of_domain, none, plain), top),
        )
        .when(kind == "ip", octets)
        .when(kind == "name", _name(entity, gender, stream, attempt))
        .when(kind == "phone", _spelled(entity, stream, code, plain))
        .when(kind == "iban", shared.let(_spelled(entity, stream, F.lit(2), plain), lambda d: _checked_iban(entity, d)))
        .when(kind == "card", shared.let(_spelled(entity, stream, none, plain), lambda d: _checked_card(entity, d)))
        .otherwise(_spelled(entity, stream, none, entity.rlike("^[0-9a-fA-F]+$")))
    )


def _row() -> Column:
    """128 bits of a row's id and text, by which it is found again."""
    return F.struct(
        F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "text", "doc_id").alias("b")
    )


def _found(docs: DataFrame) -> DataFrame:
    """(row, at, entity, kind, gender, norm) per entity of every document."""
    text = F.col("text").cast("string")
    before = F.get(F.split("_t", ANY, -1), F.col("at"))
    gender = F.when(before.rlike(rf"\b(?:{'|'.join(FEMALE_TITLES)})\.?[ ]$"), "female").otherwise("male")
    return (
        docs.select(_row().alias("row"), text.alias("_t"))
        .withColumn("_e", entities(F.col("_t")))
        # Outer, as a filter for non-empty arrays would search every text again.
        .select("row", "_t", F.posexplode_outer("_e").alias("at", "entity"))
        .where("entity is not null")
        .withColumn("kind", kind_of(F.col("entity")))
        .withColumn("gender", F.when(F.col("kind") == "name", gender).otherwise(""))
        .select("row", "at", "entity", "kind", "gender", normal(F.col("entity"), F.col("kind")).alias("norm"))
        .distinct()
    )


def draws(found: DataFrame, key: str) -> DataFrame:
    """(kind, gender, norm, attempt): at which draw each distinct entity gets a
    surrogate that no other has and that occurs nowhere as an entity."""
    names = ["kind", "gender", "norm"]
    real = shared.written(found.select(*names).distinct(), "entities")
    known = real.select("kind", F.col("norm").alias("drawn")).distinct()
    open_ones, settled, taken = real, None, known
    for attempt in range(ROUNDS):
        drawn = surrogate(F.col("norm"), F.col("kind"), F.col("gender"), F.lit(attempt), key)
        tried = shared.written(
            open_ones.withColumn("drawn", normal(drawn, F.col("kind"))), "tried"
        )
        best = tried.groupBy("kind", "drawn").agg(F.min(F.struct("gender", "norm")).alias("_best"))
        first = tried.join(best, ["kind", "drawn"]).where(F.struct("gender", "norm") == F.col("_best"))
        won = shared.written(
            first.join(taken, ["kind", "drawn"], "left_anti").select(
                *names, "drawn", F.lit(attempt).alias("attempt")
            ),
            "won",
        )
        settled = won if settled is None else settled.union(won)
        open_ones = open_ones.join(won.select(*names), names, "left_anti")
        if open_ones.isEmpty():
            return settled.drop("drawn")
        taken = taken.union(won.select("kind", "drawn"))
        open_ones = shared.written(open_ones, "open")
    raise ValueError(f"no free surrogates after {ROUNDS} draws; lengthen the formats")


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text with surrogates,
    n_entities, and kinds, the kinds found, in order, with commas between.

    Texts without entities come back as they are, a null text as null. Work grows with
    the length of a text, also of one without blanks. The same
    entity has the same surrogate in all documents; whoever has the key can draw
    it again, others can't. Rows with the same doc_id are treated apart. Other
    columns are not looked at; an empty table gives an empty result.
    """
    found = shared.written(_found(docs), "found")
    drawn = draws(found, key)
    new = surrogate(F.col("entity"), F.col("kind"), F.col("gender"), F.col("attempt"), key)
    by_row = (
        found.join(drawn, ["kind", "gender", "norm"])
        .select("row", "at", "kind", new.alias("new"))
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("at", "new", "kind"))).alias("_new"))
    )
    parts = F.split("text", ANY, -1)
    filled = F.array_join(
        F.flatten(F.zip_with(parts, F.col("_new.new"), lambda p, n: F.array(p, F.coalesce(n, F.lit(""))))),
        "",
    )
    return (
        docs.select("doc_id", F.col("text").cast("string"), _row().alias("row"))
        .join(by_row, "row", "left")
        .select(
            "doc_id",
            F.when(F.col("_new").isNull(), F.col("text")).otherwise(filled).alias("text"),
            F.coalesce(F.size("_new"), F.lit(0)).cast("long").alias("n_entities"),
            F.coalesce(
                F.array_join(F.sort_array(F.array_distinct("_new.kind")), ","), F.lit("")
            ).alias("kinds"),
        )
    )

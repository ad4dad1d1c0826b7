"""Personal data replaced by keyed surrogates of the same type, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.shared import table, written

#: Forms of address by gender.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Sra", "Señora", "Госпожа"),
    "m": ("Mr", "Herr", "Monsieur", "Sr", "Señor", "Господин"),
}
_TITLE = "|".join(t for titles in TITLES.values() for t in titles)
#: A capitalised word that is no form of address, without a genitive at its end.
_NAME = rf"(?!(?:{_TITLE})(?!\p{{L}}))\p{{Lu}}(?:\p{{L}}|'(?!s(?!\p{{L}}))(?=\p{{L}})|-(?=\p{{L}})){{1,30}}+"
#: Words of small letters inside a name; they stay.
_PARTICLE = r"(?:(?:van|von)(?: de[rnm]?)?|vom|de(?: l[ao]s?)?|del|della|di|dos|du|bin|ibn|ter)"
_BYTE = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Entities in the order in which they are looked for at a place.
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+)+",
    "phone": r"(?<![0-9A-Za-z])(?:\+\d{1,3}[^0-9A-Za-z]{0,6})?\(?\d{3}[^0-9A-Za-z]{1,6}\d{3}[-. ]\d{4}(?![0-9])",
    "ssn": r"(?<![0-9-])\d{3}-\d{2}-\d{4}(?![0-9-])",
    "ip": rf"(?<![0-9.])(?:{_BYTE}\.){{3}}{_BYTE}(?![0-9]|\.[0-9])",
    "secret": r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,64}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![0-9A-Za-z])",
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.? {_NAME}(?:(?: {_PARTICLE})? {_NAME})*+",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity holds; texts without it are not searched.
HINT = rf"[0-9@]|(?<!\p{{L}})(?:{_TITLE})\.? \p{{Lu}}"
#: Syllables of invented names by script.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi fo ga go ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to",
    "cyrillic": "ба бе би бо да де ди до ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со та те ти то",
}
#: Draws that an entity makes in a space before it draws from a larger one.
PATIENCE = 3
#: Endings of given names by script and gender.
ENDINGS = {("latin", "f"): "na", ("latin", "m"): "ton", ("cyrillic", "f"): "на", ("cyrillic", "m"): "тон"}


def _kind(surface: Column) -> Column:
    tests = [F.when(surface.rlike(rf"\A(?:{p})\z"), kind) for kind, p in PATTERNS.items()]
    return F.coalesce(*tests)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _gender(surface: Column) -> Column:
    has = lambda g: surface.rlike(rf"\A(?:{'|'.join(TITLES[g])})\b")
    return F.when(has("f"), "f").otherwise("m")


def _parts(surface: Column) -> Column:
    """Entities of a surface as (type, canonical value, place of the word).

    The last word of a name is its family name, capitalised ones between it and the form of address are given names.
    """
    kind, digits = _kind(surface), _digits(surface)
    words = F.split(surface, " ")
    part = lambda t, v, i: F.struct(t.alias("type"), v.alias("value"), i.cast("int").alias("at"))
    given = F.concat(F.lit("given-"), _gender(surface))
    each = F.transform(words, lambda w, i: part(F.when(i == F.size(words) - 1, "family").otherwise(given), F.lower(w), i))
    names = F.filter(each, lambda p: (p["at"] > 0) & F.element_at(words, p["at"] + 1).rlike(r"\A\p{Lu}"))
    number = F.when(kind == "phone", F.right(digits, F.lit(10))).otherwise(digits)
    value = F.when(kind.isin("phone", "ssn", "card"), number).otherwise(F.lower(surface))
    return F.when(kind == "name", names).otherwise(F.array(part(kind, value, F.lit(0))))


def _stream(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """256 hexadecimal digits from a nested keyed hash of the entity and the attempt."""
    message = F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string"))
    inner = F.sha2(message.cast("binary"), 512)
    return F.concat(*[F.sha2(F.concat(F.lit(f"{key}{i}"), inner).cast("binary"), 512) for i in (1, 2)])


def _pick(stream: Column, i: Column | int, choices: int) -> Column:
    """A number below ``choices`` from the i-th four digits of the stream."""
    place = (i if isinstance(i, Column) else F.lit(i)) % 64 * 4 + 1
    return F.conv(F.substring(stream, place, 4), 16, 10).cast("int") % choices


def _reshaped(value: Column, stream: Column, letters: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """Letters and digits redrawn, all else kept: length and format stay."""
    draw = lambda chars, i: F.substring(F.lit(chars), _pick(stream, i, len(chars)) + 1, 1)
    one = lambda c, i: (
        F.when(c.rlike(r"[0-9]"), draw("0123456789", i)).when(c.rlike(r"\p{L}"), draw(letters, i)).otherwise(c)
    )
    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn_sum(digits: Column, doubled_first: Column) -> Column:
    """Sum of a digit string, every second digit doubled with its own digits added."""
    each = F.transform(
        F.split(digits, ""),
        lambda c, i: F.when((i + doubled_first) % 2 == 0, F.element_at(F.array(*map(F.lit, [0, 2, 4, 6, 8, 1, 3, 5, 7, 9])), c.cast("int") + 1)).otherwise(
            c.cast("int")
        ),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _card(value: Column, stream: Column) -> Column:
    """As many digits; the last one keeps the distance of the original from a valid check sum."""
    n = F.length(value)
    body = F.substring(_reshaped(value, stream), F.lit(1), n - 1)
    rest = _luhn_sum(value, n % 2) % 10
    check = (rest - _luhn_sum(body, n % 2) % 10 + 10) % 10
    return F.concat(body, check.cast("string"))


def _octet(c: Column, i: Column, stream: Column, grown: Column) -> Column:
    """As many digits, still a byte; any byte in a grown space."""
    return (
        F.when(grown > 0, _pick(stream, i, 256))
        .when(F.length(c) == 1, 1 + _pick(stream, i, 9))
        .when(F.length(c) == 2, 10 + _pick(stream, i, 90))
        .otherwise(100 + _pick(stream, i, 155))
        .cast("string")
    )


def _invented(value: Column, stream: Column, gender: str | None, grown: Column) -> Column:
    """A name of the script of ``value``; given names end by gender. A grown space has longer names."""

    def of(script: str) -> Column:
        syllables = F.split(F.lit(SYLLABLES[script]), " ")
        places = F.sequence(F.lit(0), F.least(grown + 2, F.lit(40)))
        drawn = F.transform(places, lambda i: F.element_at(syllables, _pick(stream, i, len(SYLLABLES[script].split())) + 1))
        return F.initcap(F.concat(F.array_join(drawn, ""), F.lit(ENDINGS[script, gender] if gender else "")))

    return F.when(value.rlike(r"\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))


def surrogate(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """The replacement of a canonical value, the same wherever it occurs.

    The space grows with the attempts: names and the local parts of addresses get longer, quads
    take any byte, phone numbers any exchange. Other numbers keep their length: as many values as
    they have real ones must be free.
    """
    s = _stream(key, kind, value, attempt)
    grown = F.floor(attempt / PATIENCE).cast("int")
    more = F.transform(F.sequence(F.lit(1), F.least(grown, F.lit(40))), lambda i: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _pick(s, 64 - i, 26) + 1, 1))
    more = F.when(grown > 0, F.array_join(more, "")).otherwise("")
    local, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    phone = F.concat(
        F.substring(_reshaped(value, s), 1, 3),
        F.when((F.substring(value, 4, 3) == "555") & (grown == 0), "555").otherwise(F.substring(_reshaped(value, s), 4, 3)),
        F.substring(_reshaped(value, s), 7, 4),
    )
    named = [F.when(kind == f"given-{g}", _invented(value, s, g, grown)) for g in "fm"]
    return F.coalesce(
        F.when(kind == "email", F.concat(_reshaped(local, s), more, F.lit("@"), _reshaped(host, F.reverse(s)), F.lit(".example.org"))),
        F.when(kind == "phone", phone),
        F.when(kind == "ip", F.array_join(F.transform(F.split(value, r"\."), lambda c, i: _octet(c, i, s, grown)), ".")),
        F.when(kind == "secret", _reshaped(value, s, "abcdef")),
        F.when(kind == "card", _card(value, s)),
        F.when(kind == "family", _invented(value, s, None, grown)),
        *named,
        _reshaped(value, s),
    )


def resolve(entities: DataFrame, key: str) -> DataFrame:
    """``type, value, surrogate`` with no surrogate twice in a type and none that is a real value.

    Every entity draws by its own keyed hash. Of those that draw the same, the one with the fewest
    attempts, then the smallest value, keeps it; the others and those that drew a value
    of the corpus draw again until none is left.
    """
    state = entities.select("type", "value", F.lit(0).alias("attempt"))
    while True:
        drawn = written(state.withColumn("surrogate", surrogate(key, F.col("type"), F.col("value"), F.col("attempt"))), "surrogates")
        lowered = F.lower("surrogate").alias("drawn")
        owners = drawn.groupBy("type", lowered).agg(F.min(F.struct("attempt", "value")).alias("owner"))
        taken = entities.select("type", F.col("value").alias("drawn"), F.lit(True).alias("real"))
        judged = (
            drawn.withColumn("drawn", F.lower("surrogate"))
            .join(owners, ["type", "drawn"])
            .join(taken, ["type", "drawn"], "left")
            .withColumn("again", F.col("real").isNotNull() | (F.col("owner.value") != F.col("value")))
        )
        if judged.where("again").isEmpty():
            return drawn.select("type", "value", "surrogate")
        state = judged.select("type", "value", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))


def _filled(surface: Column, drawn: Column) -> Column:
    """The surrogates, by place, in the form of the surface: its separators, case and prefix digits."""
    kind, digits, first = _kind(surface), _digits(surface), F.element_at(drawn, F.lit(0))
    fill = F.concat(F.substring(digits, F.lit(1), F.length(digits) - F.length(first)), first)
    numbers = F.aggregate(
        F.split(surface, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda a, c: F.when(
            c.rlike("[0-9]"), F.struct(F.concat(a["out"], F.substring(fill, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))
        ).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))),
        lambda a: a["out"],
    )
    words = F.split(surface, " ")
    name = F.array_join(F.transform(words, lambda w, i: F.coalesce(F.element_at(drawn, i), w)), " ")
    shouted = (F.upper(surface) == surface) & surface.rlike(r"\p{L}")
    cased = lambda c: F.when(shouted, F.upper(c)).otherwise(c)
    return F.when(kind.isin("phone", "ssn", "card"), numbers).when(kind == "name", name).otherwise(cased(first))


def _mentions(segment: Column, names: Column, pattern: Column) -> Column:
    """A piece of text with the names of the whole text replaced where they stand alone."""

    def other(word: Column) -> Column:
        drawn = F.element_at(names, F.lower(word))
        return F.coalesce(F.when(F.upper(word) == word, F.upper(drawn)).otherwise(drawn), word)

    found = F.transform(F.regexp_extract_all(segment, pattern, F.lit(0)), other)
    pieces = F.zip_with(F.split(segment, pattern, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(pattern.isNull(), segment).otherwise(F.array_join(pieces, ""))


def replace_personal_data(docs: DataFrame, key: str = "surrogate key") -> DataFrame:
    """``docs`` with surrogates in ``text`` and two columns more: ``n_entities`` and ``entity_types``.

    An entity, whatever its format, has one surrogate in the whole corpus, and different
    entities of a type have different ones. A name found behind a form of address is replaced wherever
    its words stand capitalised in that text; such mentions are not counted in ``n_entities``. The same ``key`` and corpus give the same texts.
    Texts without an entity stay as they are and move nowhere; null stays null. Equal texts and
    repeated rows get equal results; ids play no part, so null or repeated ids do no harm; other
    columns stay, and columns called like the two new ones are replaced.
    """
    docs = docs.drop("n_entities", "entity_types")
    columns = [c for c in docs.columns]
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    plain, marked = docs.where(~hinted), docs.where(hinted)
    surfaces = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    text_key = F.sha2(F.col("text").cast("binary"), 256)
    found = marked.select(text_key.alias("text_key"), F.explode(F.array_distinct(surfaces)).alias("surface")).distinct()
    parts = written(
        found.select("text_key", "surface", F.explode(_parts(F.col("surface"))).alias("part")).select(
            "text_key", "surface", F.col("part.at").alias("at"), F.col("part.type").alias("type"), F.col("part.value").alias("value")
        ),
        "entities",
    )
    resolved = resolve(parts.select("type", "value").distinct(), key)
    drawn = (
        parts.join(resolved, ["type", "value"])
        .groupBy("text_key", "surface")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("at", "surrogate"))).alias("drawn"),
            F.collect_list(F.when(F.col("type").isin("family", "given-f", "given-m"), F.struct("value", "type", "surrogate"))).alias("names"),
        )
    )
    # Of a word that is both a given and a family name, the first by type counts.
    once = F.array_sort(F.array_distinct(F.flatten(F.collect_list("names"))))
    first = F.filter("once", lambda x, i: (i == 0) | (F.get(F.col("once"), i - 1)["value"] != x["value"]))
    longest = F.reverse(F.array_sort(F.transform(F.map_keys("names"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))))
    alternatives = F.array_join(F.transform(longest, lambda x: x["w"]), "|")
    maps = (
        drawn.select("text_key", "surface", _filled(F.col("surface"), F.col("drawn")).alias("filled"), "names")
        .groupBy("text_key")
        .agg(F.map_from_entries(F.collect_list(F.struct("surface", "filled"))).alias("filled"), once.alias("once"))
        .withColumn("names", F.map_from_entries(F.transform(first, lambda x: F.struct(x["value"], x["surrogate"]))))
        .withColumn(
            "pattern",
            F.when(F.size("names") > 0, F.concat(F.lit(r"(?<!\p{L})(?=\p{Lu})(?iu:"), alternatives, F.lit(r")(?!\p{L})"))),
        )
        .select("text_key", "filled", "names", "pattern")
    )
    segments = F.transform(F.split("text", ANY, -1), lambda s: _mentions(s, F.col("names"), F.col("pattern")))
    replaced = F.transform(surfaces, lambda s: F.element_at(F.col("filled"), s))
    glued = F.array_join(F.zip_with(segments, replaced, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    kinds = F.array_sort(F.array_distinct(F.transform(surfaces, _kind)))
    done = marked.withColumn("text_key", text_key).join(maps, "text_key", "left")
    done = done.withColumns({"glued": glued, "n_entities": F.size(surfaces).cast("long"), "entity_types": kinds})
    done = done.withColumn("text", F.when(F.col("filled").isNotNull(), F.col("glued")).otherwise(F.col("text")))
    untouched = plain.withColumns({"n_entities": F.lit(0).cast("long"), "entity_types": F.array().cast("array<string>")})
    return done.select(*columns, "n_entities", "entity_types").unionByName(untouched)


def op9_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its personal data replaced."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return replace_personal_data(docs)

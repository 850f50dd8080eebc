"""Surrogates for personal data, with DataFrame functions only.

Entities are found by one pattern over the whole text. Each distinct entity of a
type gets a keyed surrogate of the same type and form: digits stay digits and
letters stay letters of their script and case, separators stay, card numbers and
IBANs that are valid stay valid. A person is a given name of the gender that the
title tells, and a family name; each has surrogates of its own, from lists by
script and gender (letters of the script where there is no list). So `Mr Smith`
shares the family name of `Mr John Smith`, and `Mrs John Smith` does not share
his given name. A full name that a document mentions with a title is found there
without one too. All mentions of an entity, however written, share its surrogate
(coreference). Surrogates of distinct entities are distinct and are no entity of
the input: collisions are found by grouping, the smallest entity keeps the
surrogate and the others draw again, until none is left.

A text is cut at its entities and put together again with the surrogates, which
join by entity and then by document. Entities of more mentions than a task's
share, no more than there are tasks, are joined by a broadcast; no other key is
larger than that share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import checkpointed, packed, shuffle_partitions, unpacked, written

#: Titles that tell a gender, and names by script and gender.
TITLES = {"m": "Mr Herr Monsieur Señor Sr Don Господин Г-н".split(), "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Señorita Sra Doña Госпожа Г-жа".split()}
NAMES = {
    "latin m": "Adam Albert Andrew Arthur Carl Daniel David Edward Felix Frank Hugo Jacob James Leon Louis Marco Martin Oscar Paul Peter Robert Samuel Thomas Victor Walter".split(),
    "latin f": "Ada Alice Anna Bianca Carla Clara Diana Elena Emma Eva Flora Helen Irene Julia Laura Lena Lucia Maria Nina Olga Paula Rosa Sara Sofia Vera".split(),
    "latin": "Abbott Archer Bailey Barton Becker Bellamy Carver Clement Cooper Dalton Delgado Duval Ellis Fischer Fontaine Garner Girard Hartman Hobbs Keller Lambert Lennox Marin Mercer Moreau Navarro Norris Olsen Palmer Quintero Renard Romero Sawyer Schuster Thorne Tucker Vargas Vogel Weber Winter".split(),
    "cyrillic m": "Алексей Антон Борис Виктор Глеб Денис Иван Кирилл Максим Олег Павел Роман Сергей Тимур Юрий".split(),
    "cyrillic f": "Алина Анна Вера Галина Дарья Елена Инна Ксения Лариса Мария Нина Ольга Полина Софья Юлия".split(),
    "cyrillic": "Агапенко Бойко Власенко Гончар Демченко Живаго Ильенко Коваль Левченко Мельник Назаренко Онищенко Павленко Руденко Савченко Ткач Франко Черных Шевчук Яценко".split(),
}
_TITLE = "|".join(sorted((t for g in TITLES.values() for t in g), key=lambda t: (-len(t), t)))
_NAME = r"\p{Lu}[\p{L}'’\-]+"
#: The entity types in order of precedence, and the pattern of each.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]+@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)+",
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.? {_NAME}(?: {_NAME})?",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:sk|pk|ghp|xox[a-z])[_-][A-Za-z0-9_\-]{16,})(?![\p{L}\p{N}])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![\p{N}+])\+?[0-9]{0,3}[ .\-]?\([0-9]{2,4}\)[ .\-]?[0-9]{3,4}[ .\-][0-9]{3,4}(?!\p{N})|(?<![\p{N}+])\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,5}(?!\p{N})|(?<![\p{N}\-])[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?![\p{N}\-])",
    "ssn": r"(?<![\p{N}\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{N}\-])",
    "card": r"(?<![\p{L}\p{N}])[0-9]{4}(?:[ \-]?[0-9]{4}){3}(?:[ \-]?[0-9]{1,3})?(?![\p{L}\p{N}])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Scripts with lower-case letters or letters without case, drawn for letters of the same script.
LATIN = "abcdefghijklmnopqrstuvwxyz"
SCRIPTS = {
    name: "".join(map(chr, range(first, last + 1)))
    for name, first, last in (
        ("Cyrillic", 0x430, 0x44F), ("Greek", 0x3B1, 0x3C1), ("Armenian", 0x561, 0x586), ("Georgian", 0x10D0, 0x10F0), ("Hebrew", 0x5D0, 0x5EA), ("Arabic", 0x62D, 0x63A), ("Devanagari", 0x915, 0x939),
        ("Thai", 0xE01, 0xE2E), ("Hiragana", 0x3042, 0x3093), ("Katakana", 0x30A2, 0x30F3), ("Hangul", 0xAC00, 0xACC7), ("Han", 0x4E00, 0x4EC7),
    )
}
ROUNDS = 64
#: Set this in the session's configuration to the secret that decides all surrogates.
KEY = "spark.factloom.pii.key"


def _untitled(entity: Column) -> Column:
    return F.regexp_replace(entity, rf"^(?:{_TITLE})\.? ", "")


def kind(entity: Column) -> Column:
    """The entity's type; what matches no pattern is a name found again without its title."""
    return F.coalesce(*[F.when(entity.rlike(f"^(?:{p})$"), F.lit(t)) for t, p in PATTERNS.items()], F.lit("name"))


def norm(entity: Column, type_: Column) -> Column:
    """What all ways of writing an entity share: digits of numbers (the last ten of phones), an IBAN without spaces, lower case of addresses; secrets as they are."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    return (
        F.when(type_ == "phone", F.right(digits, F.lit(10)))
        .when(type_.isin("ssn", "card"), digits)
        .when(type_ == "iban", F.replace(entity, F.lit(" ")))
        .when(type_ == "email", F.lower(entity))
        .otherwise(entity)
    )


def gender(entity: Column) -> Column:
    title = F.regexp_extract(entity, rf"^({_TITLE})\.? ", 1)
    return F.when(title.isin(TITLES["f"]), "f").otherwise("m")


def _bytes(key: str, *parts: Column) -> Column:
    """128 hexadecimal digits drawn by the key for the parts."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 512)


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, 2 * (i % 64) + 1, F.lit(2)), 16, 10).cast("int")


def _like(text: Column, stream: Column, from_: int = 0) -> Column:
    """Text with each digit and letter (from a place on) drawn anew, in its script and case; the rest as it is. Letters of other scripts become Latin."""
    def each(c: Column, i: Column) -> Column:
        letters = F.when(c.rlike("[0-9]"), "0123456789").when(c.rlike("[a-zA-Z]"), LATIN).when(~c.rlike(r"\p{L}"), c)
        for name, own in SCRIPTS.items():
            letters = letters.when(c.rlike(rf"\p{{Is{name}}}"), own)
        letters = letters.otherwise(LATIN)
        new = F.substr(letters, _byte(stream, i) % F.char_length(letters) + 1, F.lit(1))
        return F.when(i < from_, c).when(c.rlike(r"\p{Lu}"), F.upper(new)).otherwise(new)

    return F.array_join(F.transform(F.split(text, ""), each), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a number in which the last digit counts once."""
    reversed_ = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(reversed_, F.lit(0), lambda s, x: s + x)


def _mod97(code: Column) -> Column:
    """Remainder by 97 of a code in which letters stand for 10 to 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(code, ""), F.lit(0), lambda s, c: (s * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def _iban(text: Column, stream: Column) -> Column:
    drawn = _like(text, stream, 2)
    country, rest = F.substr(text, F.lit(1), F.lit(2)), F.substr(drawn, F.lit(5))
    check = F.lpad((98 - _mod97(F.concat(rest, country, F.lit("00")))).cast("string"), 2, "0")
    valid = _mod97(F.concat(F.substr(text, F.lit(5)), F.substr(text, F.lit(1), F.lit(4)))) == 1
    return F.when(valid, F.concat(country, check, rest)).otherwise(drawn)


def _card(text: Column, stream: Column) -> Column:
    drawn = _like(text, stream, 1)
    body = F.substr(drawn, F.lit(1), F.char_length(drawn) - 1)
    check = (10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    return F.when(_luhn_sum(text) % 10 == 0, F.concat(body, check.cast("string"))).otherwise(drawn)


def _secret(text: Column, stream: Column) -> Column:
    hexed = F.array_join(F.transform(F.split(text, ""), lambda c, i: F.substr(stream, i % 128 + 1, F.lit(1))), "")
    return F.when(text.rlike("^[0-9a-f]+$"), hexed).when(text.rlike("^[0-9A-F]+$"), F.upper(hexed)).otherwise(_like(text, stream, 3))


def _email(text: Column, stream: Column, key: str) -> Column:
    """Equal hosts get equal hosts; the part before @ grows from the fourth draw on."""
    local, domain = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    host, top = F.regexp_replace(domain, r"\.[^.]*$", ""), F.regexp_extract(domain, r"\.[^.]*$", 0)
    longer = F.when(F.col("round") < 3, F.lit("")).otherwise(F.substr(F.sha2(stream, 256), F.lit(1), F.least(F.lit(2) * F.col("round"), F.lit(64))))
    return F.concat(_like(local, stream), longer, F.lit("@"), _like(host, _bytes(key, F.lit("domain"), host)), top)


def _name(text: Column, stream: Column, key: str) -> Column:
    """A name of the list of its script and type in lower case; two joined by a hyphen, and then drawn letters too, where it has to draw again."""
    wide = lambda i: _byte(stream, F.lit(i)) * 256 + _byte(stream, F.lit(i + 1))
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x.lower()) for x in names]), wide(i) % len(names) + 1)
    listed = lambda i: reduce(lambda c, n: c.when((script == n.split()[0]) & (F.col("type") == {"m": "given m", "f": "given f"}.get(n.split()[-1], "family")), pick(NAMES[n], i)), NAMES, F.when(F.lit(False), ""))
    script = F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsLatin}"), "latin").otherwise("")
    more = [F.when(F.col("round") > 2 + i, _like(F.lit("abcdef"), _bytes(key, stream, F.lit(str(i))))) for i in range(3)]
    return F.when(script == "", _like(text, stream)).when(F.col("round") == 0, listed(0)).otherwise(F.concat_ws("-", listed(0), listed(2), *more))


def _surrogate(key: str) -> Column:
    """The draw numbered `round` for columns type and norm."""
    text, type_ = F.col("norm"), F.col("type")
    stream = _bytes(key, type_, text, F.col("round").cast("string"))
    octet = lambda i: F.when(F.lit(i) == 0, _byte(stream, F.lit(0)) % 223 + 1).otherwise(_byte(stream, F.lit(i)))
    ip = F.concat_ws(".", *[octet(i).cast("string") for i in range(4)])
    return (
        F.when(type_ == "email", _email(text, stream, key))
        .when(type_ == "ip", ip)
        .when(type_ == "card", _card(text, stream))
        .when(type_ == "iban", _iban(text, stream))
        .when(type_ == "secret", _secret(text, stream))
        .when(type_.isin("given m", "given f", "family"), _name(text, stream, key))
        .otherwise(_like(text, stream))
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """type, norm, surrogate for distinct entities (type, norm): distinct within a type, and no entity of the input."""
    pending = entities.select("type", "norm", F.lit(0).alias("round"))
    done, draw = None, _surrogate(key)
    originals = entities.select("type", F.col("norm").alias("drawn"))
    for _ in range(ROUNDS):
        drawn = checkpointed(pending.withColumn("drawn", draw))
        taken = originals if done is None else originals.union(done.select("type", F.col("surrogate").alias("drawn")))
        winner = drawn.groupBy("type", "drawn").agg(F.min("norm").alias("norm"), F.first(F.lit(True)).alias("won"))
        settled = checkpointed(drawn.join(winner, ["type", "drawn", "norm"], "left").join(taken.withColumn("used", F.lit(True)).distinct(), ["type", "drawn"], "left").withColumn("ok", F.coalesce("won", F.lit(False)) & F.col("used").isNull()))
        good = settled.where("ok").select("type", "norm", F.col("drawn").alias("surrogate"))
        done = good if done is None else done.union(good)
        pending = settled.where("not ok").select("type", "norm", (F.col("round") + 1).alias("round"))
        if not pending.limit(1).count():
            return done
    raise ValueError(f"entities without a surrogate of their own after {ROUNDS} draws")


def _render(piece: Column, type_: Column, surrogate: Column) -> Column:
    """The surrogate in the way that a mention is written: separators, spaces and case."""
    digits = F.regexp_replace(piece, "[^0-9]", "")
    given = F.concat(F.substr(digits, F.lit(1), F.char_length(digits) - F.char_length(surrogate)), surrogate)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def lay(source: Column, slot: str) -> Column:
        step = lambda s, c: F.when(c.rlike(slot), F.struct(F.concat(s["out"], F.substr(source, s["at"] + 1, F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
        return F.aggregate(F.split(piece, ""), start, step, lambda s: s["out"])

    capital = F.array_join(F.transform(F.split(surrogate, "-"), lambda p: F.concat(F.upper(F.substr(p, F.lit(1), F.lit(1))), F.substr(p, F.lit(2)))), "-")
    name = F.when((piece == F.upper(piece)) & (F.char_length(piece) > 1), F.upper(surrogate)).otherwise(capital)
    cased = F.when(F.char_length(piece) == F.char_length(surrogate), F.array_join(F.transform(F.split(surrogate, ""), lambda c, i: F.when(F.substr(piece, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")).otherwise(surrogate)
    return F.when(type_.isin("phone", "ssn", "card"), lay(given, "[0-9]")).when(type_ == "iban", lay(surrogate, "[A-Z0-9]")).when(type_.isin("given m", "given f", "family"), name).when(type_ == "email", cased).otherwise(surrogate)


def mentions_of(rows: DataFrame) -> DataFrame:
    """Two pieces for each mention in rows (id, row, text): the given name, if any, and the family name or the whole entity.

    entity is the mention's type; type and norm name what is to be replaced (type is null where a piece is nothing
    but a title or empty); before and after stay around the piece; bare holds the document's full names.
    """
    found = F.regexp_extract_all("text", F.lit(ANY), 0)
    titled = F.filter("found", lambda e: e.rlike(rf"^(?:{_TITLE})\.? {_NAME} {_NAME}$"))
    lists = rows.withColumn("found", found).where(F.size("found") > 0).withColumn("titled", titled).withColumn("bare", F.array_distinct(F.transform("titled", _untitled)))
    again = F.when(F.size("bare") > 0, F.regexp_extract_all("text", _with_bare(F.col("bare")), F.lit(0))).otherwise(F.col("found"))
    each = lists.select("id", "row", "titled", F.when(F.size("bare") > 0, F.col("bare")).alias("bare"), F.posexplode(again).alias("at", "mention"))
    each = each.withColumn("entity", kind(F.col("mention"))).withColumn("name", _untitled(F.col("mention")))
    is_name, two = F.col("entity") == "name", (F.col("entity") == "name") & F.col("name").contains(" ")
    told = F.when(F.col("name") == F.col("mention"), F.get(F.filter("titled", lambda t: _untitled(t) == F.col("mention")), 0)).otherwise(F.col("mention"))
    given, family = F.substring_index("name", " ", 1), F.substring_index("name", " ", -1)
    title = F.substr("mention", F.lit(1), F.char_length("mention") - F.char_length("name"))
    first = F.struct(F.lit(0).alias("part"), F.when(two, F.concat(F.lit("given "), gender(told))).alias("type"), F.when(two, F.lower(given)).alias("norm"), F.when(two, given).otherwise(F.lit("")).alias("piece"), F.when(is_name, title).otherwise(F.lit("")).alias("before"), F.when(two, F.lit(" ")).otherwise(F.lit("")).alias("after"))
    second = F.struct(F.lit(1).alias("part"), F.when(is_name, F.lit("family")).otherwise(F.col("entity")).alias("type"), F.when(is_name, F.lower(family)).otherwise(norm(F.col("mention"), F.col("entity"))).alias("norm"), F.when(is_name, family).otherwise(F.col("mention")).alias("piece"), F.lit("").alias("before"), F.lit("").alias("after"))
    return each.select("id", "row", "at", "entity", F.when(F.col("at") == 0, F.col("bare")).alias("bare"), F.explode(F.array(first, second)).alias("p")).select("id", "row", "at", "entity", "bare", "p.*")


def _with_bare(bare: Column) -> Column:
    """The pattern of all entities and of these full names."""
    return F.concat(F.lit(ANY + r"|(?<!\p{L})(?:"), F.array_join(bare, "|"), F.lit(r")(?![\p{L}'’\-])"))


def replace_entities(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with the text's entities replaced, n_entities int and surrogates array<struct<type, surrogate>> in text order.

    The key (by default the session's spark.factloom.pii.key) decides all surrogates: the same key gives the same
    ones for the same table. A null text stays null and has no entities. Rows with equal doc_id are separate
    documents, equal rows get equal results. The other columns stay, whatever their names; columns named n_entities
    or surrogates are replaced. An empty table gives an empty table. Numbers that differ only in what stands
    before the last ten digits of a phone keep that difference.
    """
    spark = docs.sparkSession
    key = key or spark.conf.get(KEY, "factloom")
    rows = packed(docs, F.col("doc_id").alias("id"), F.col("text").alias("text"), F.xxhash64("text").alias("row"))
    mentions = written(mentions_of(rows.select("id", "text", "row")).dropDuplicates(["id", "row", "at", "part"]), "mentions")
    entities = checkpointed(mentions.where(F.col("type").isNotNull()).groupBy("type", "norm").agg(F.count(F.lit(1)).alias("n")))
    found = surrogates(entities, key)
    share = mentions.count() / shuffle_partitions(spark)
    hot = found.join(entities.where(F.col("n") > share).select("type", "norm"), ["type", "norm"]).select("type", "norm", F.col("surrogate").alias("hot"))  # fewer than there are partitions
    known = mentions.join(F.broadcast(hot), ["type", "norm"], "left")
    ready = F.col("hot").isNotNull() | F.col("type").isNull()
    named = known.where(ready).withColumnRenamed("hot", "surrogate").unionByName(known.where(~ready).drop("hot").join(found, ["type", "norm"]))
    named = named.withColumn("new", F.concat("before", F.coalesce(_render(F.col("piece"), F.col("type"), F.col("surrogate")), F.lit("")), "after"))
    lists = named.groupBy("id", "row").agg(F.array_sort(F.collect_list(F.struct("at", "part", "entity", "new", "bare"))).alias("new"))
    lists = lists.select(F.col("id").alias("i"), F.col("row").alias("r"), "new")
    joined = rows.join(lists.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("i")) & (F.col("row") == F.col("r")), "left")
    piece = lambda i: F.coalesce(F.get("new", i)["new"], F.lit(""))
    bare = F.get("new", F.lit(0))["bare"]
    cut = F.when(F.size(bare) > 0, F.split("text", _with_bare(bare), F.lit(-1))).otherwise(F.split("text", F.lit(ANY), F.lit(-1)))
    put = F.array_join(F.transform(cut, lambda p, i: F.concat(p, piece(2 * i), piece(2 * i + 1))), "")
    listed = F.transform(F.filter("new", lambda x: x["part"] == 0), lambda x, i: F.struct(x["entity"].alias("type"), F.concat(x["new"], piece(2 * i + 1)).alias("surrogate")))
    none = F.array().cast("array<struct<type:string,surrogate:string>>")
    with_any = F.col("new").isNotNull()
    return unpacked(
        joined,
        docs.columns,
        text=F.when(with_any, put).otherwise(F.col("text")),
        n_entities=F.when(with_any, (F.size("new") / 2).cast("int")).otherwise(F.lit(0)),
        surrogates=F.when(with_any, listed).otherwise(none),
    )

"""Surrogates for personal data and secrets.

Entities are found by one pattern a text. Each gets a replacement of its own kind: digits for digits,
letters of the same case for letters, check digits where the original's hold, valid octets for octets, names
of the same gender and script for names, with the marks between kept. Replacements come from a keyed digest of
the entity, so an entity has the same one wherever it occurs. A person is a name, whatever its case and title:
its gender is settled over all mentions in the corpus, and its last name is replaced by the last name alone, so
relatives and mentions by last name agree. Checks over the distinct entities of the corpus find replacements
that two entities share or that are an entity themselves, and draw again for all but one of these until none
is left. Only built-in functions are used.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let, text_of

#: Secret of the digests in tests and queries here; give your own.
KEY = "cartolith-surrogates"
#: Draws for an entity after which no clean one is expected: an error.
DRAWS = 64

_TITLES_M, _TITLES_F = "Mr|Herr|Monsieur|Señor|Don", "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Doña"
_NAME = r"\p{Lu}[\p{L}\p{M}'’-]+"
#: kind -> Java pattern; the first that fits counts.
PATTERNS: dict[str, str] = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "assigned": r"(?<![\p{L}\p{N}])(?i:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key)\s{0,2}[=:]\s{0,2}(?:\"[^\"\n]{4,}+\"|'[^'\n]{4,}+')",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-fA-F]{32,}+|(?:sk|pk|ghp|gho|xox[abp]|AKIA|AIza|eyJ)[-_A-Za-z0-9.]{16,}+)(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}+.-])(?:\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\p{L}\p{N}]|\.\d)",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\p{L}\p{N}])",
    "person": rf"(?<![\p{{L}}\p{{N}}])(?:(?:{_TITLES_M}|{_TITLES_F}|Dr|Prof|Sr)\.? |(?:[Mm]y name is|[Nn]ame:|[Ii]ch heiße|[Jj]e m'appelle|[Mm]e llamo) ){_NAME}(?: {_NAME}){{0,2}}",
}
#: The back reference of "card" must name its own group among all patterns: it's the first. No entity starts
#: behind a letter or digit, which is asked once instead of by each pattern.
_ALL = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(PATTERNS.values())})"
_TITLED = rf"\b(?:{_TITLES_M}|{_TITLES_F}|Dr|Prof|Sr)\.? \p{{Lu}}"
#: Parts of the words, in lower case, without which a text without digits, "@" and titles holds no entity.
_CUES = ("name", "heiße", "appelle", "llamo", "token", "passw", "pwd", "secret", "key")

#: First names by script and gender, and syllables of last names by script.
FIRST_NAMES = {
    ("latin", "m"): ("Adam", "Boris", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Leo", "Martin", "Noah", "Oscar", "Paul"),
    ("latin", "f"): ("Anna", "Berta", "Clara", "Dora", "Emma", "Flora", "Greta", "Helen", "Ida", "Julia", "Karla", "Lena", "Maria", "Nora", "Olga", "Paula"),
    ("latin", "n"): ("Alex", "Ari", "Chris", "Dana", "Eli", "Jamie", "Jo", "Kim", "Luca", "Noel", "Quinn", "Robin", "Sam", "Sasha", "Toni", "Val"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Олег"),
    ("cyrillic", "f"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"),
    ("cyrillic", "n"): ("Женя", "Саша", "Валя", "Слава", "Шура", "Паша", "Никита", "Юля"),
    ("greek", "m"): ("Άρης", "Γιάννης", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος", "Φώτης", "Χρήστος"),
    ("greek", "f"): ("Άννα", "Δάφνη", "Ελένη", "Ζωή", "Θάλεια", "Μαρία", "Σοφία", "Χλόη"),
    ("greek", "n"): ("Άρης", "Δάφνη", "Ζωή", "Νίκη", "Φοίβη", "Χλόη", "Ήβη", "Μυρτώ"),
}
SYLLABLES = {
    "latin": ("ba", "be", "bo", "da", "de", "do", "ka", "ke", "ko", "la", "le", "lo", "ma", "me", "mo", "na"),
    "cyrillic": ("ба", "бе", "бо", "да", "де", "до", "ка", "ке", "ко", "ла", "ле", "ло", "ма", "ме", "мо", "на"),
    "greek": ("βα", "βε", "βο", "δα", "δε", "δο", "κα", "κε", "κο", "λα", "λε", "λο", "μα", "με", "μο", "να"),
}
#: Names whose gender is known without a title.
KNOWN_MALE = "Adam|Ahmed|Andreas|Antoine|Carlos|Charles|Daniel|David|Diego|George|Hans|Jack|James|Jean|John|José|Juan|Karl|Klaus|Louis|Luis|Mark|Michael|Miguel|Mohammed|Paul|Pedro|Peter|Pierre|Robert|Thomas|William"
KNOWN_FEMALE = "Alice|Amina|Ana|Anna|Anne|Barbara|Carmen|Claire|Elena|Elizabeth|Emma|Fatima|Helga|Jane|Jennifer|Julia|Karen|Laura|Linda|Lucía|Maria|Marie|María|Mary|Monika|Nancy|Olivia|Patricia|Petra|Sabine|Sarah|Sophie|Susan"


def kind_of(entity: Column) -> Column:
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        found = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(found)
    return found


def maybe(text: Column) -> Column:
    """Whether a text may hold an entity: plain searches, as most texts hold none."""
    any_of = lambda value, parts: reduce(or_, (value.contains(p) for p in parts))
    titles = [*_TITLES_M.split("|"), *_TITLES_F.split("|"), "Dr", "Prof", "Sr"]
    return text.rlike("[@0-9]") | any_of(F.lower(text), _CUES) | (any_of(text, titles) & text.rlike(_TITLED))


def matches(text: Column) -> Column:
    """All entities of a text, in order, repeats included."""
    none = F.array().cast("array<string>")
    return F.when(maybe(text), F.regexp_extract_all(text, F.lit(_ALL), F.lit(0))).otherwise(none)


_CUE = rf"^(?:(?:{_TITLES_M}|{_TITLES_F}|Dr|Prof|Sr)\.? |(?:[Mm]y name is|[Nn]ame:|[Ii]ch heiße|[Jj]e m'appelle|[Mm]e llamo) )"
_TITLE = rf"^(?:{_TITLES_M}|{_TITLES_F}|Dr|Prof|Sr)\.? "
_ASSIGNED = r"^[^=:]*[=:]\s*[\"']"


def core(entity: Column, kind: Column) -> Column:
    """What two mentions of one entity share: without case, marks, cues or titles."""
    return (
        F.when(kind == "email", F.lower(entity))
        .when(kind.isin("phone", "card", "ssn"), F.regexp_replace(entity, r"[^0-9]", ""))
        .when(kind == "iban", F.regexp_replace(entity, " ", ""))
        .when(kind == "assigned", F.regexp_replace(F.regexp_replace(entity, _ASSIGNED, ""), r"[\"']$", ""))
        .when(kind == "person", F.initcap(F.regexp_replace(entity, _CUE, "")))
        .otherwise(entity)
    )


def family(entity: Column, kind: Column) -> Column:
    """Kinds whose entities must stay distinct from each other: a secret is one with or without its name.
    One name after a title is a last name."""
    last = (kind == "person") & entity.rlike(_TITLE) & ~F.regexp_replace(entity, _CUE, "").contains(" ")
    return F.when(kind == "assigned", F.lit("secret")).when(last, F.lit("last")).otherwise(kind)


def gender(entity: Column) -> Column:
    """What a mention of a person tells: m, f or n."""
    name = F.regexp_replace(entity, _CUE, "")
    return (
        F.when(entity.rlike(rf"^(?:{_TITLES_M})\b") | name.rlike(rf"^(?i:{KNOWN_MALE})\b"), F.lit("m"))
        .when(entity.rlike(rf"^(?:{_TITLES_F})\b") | name.rlike(rf"^(?i:{KNOWN_FEMALE})\b"), F.lit("f"))
        .otherwise(F.lit("n"))
    )


def _shape(text: Column, digest: Column, hexadecimal: bool | Column = False) -> Column:
    """A text with its letters and digits replaced by the next ones of the digest, all else kept."""
    hexadecimal = F.lit(hexadecimal) if isinstance(hexadecimal, bool) else hexadecimal

    def step(a: Column, c: Column) -> Column:
        x = F.substring(digest, a["k"] % 128 + 1, F.lit(1))
        digit, letter = F.translate(x, "abcdef", "246813"), F.translate(x, "0123456789abcdef", "abcdefghikmnoprs")
        is_digit, is_letter = c.rlike(r"^\p{N}$"), c.rlike(r"^\p{L}$")
        low = F.when(hexadecimal, x).when(is_digit, digit).otherwise(letter)
        new = F.when(is_letter & (c == F.upper(c)) & (c != F.lower(c)), F.upper(low)).otherwise(low)
        hit = is_digit | is_letter
        return F.struct(F.when(hit, F.concat(a["out"], new)).otherwise(F.concat(a["out"], c)).alias("out"), F.when(hit, a["k"] + 1).otherwise(a["k"]).alias("k"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))
    return F.aggregate(F.split(text, ""), start, step, lambda a: a["out"])


def _octets(digest: Column) -> Column:
    each = [F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10) for i in range(4)]
    return F.concat_ws(".", *each)


def _pick(items: tuple[str, ...], digest: Column, at: int) -> Column:
    index = F.conv(F.substring(digest, at, 2), 16, 10).cast("int") % len(items)
    return F.element_at(F.array(*[F.lit(x) for x in items]), index + 1)


def _by_script(name: Column, of: dict[str, Column]) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), of["cyrillic"]).when(name.rlike(r"\p{IsGreek}"), of["greek"]).otherwise(of["latin"])


def _syllables(name: Column, digest: Column, first: int, n: Column) -> Column:
    """n syllables of the script of a name, from a place of the digest on."""
    pool = _by_script(name, {s: F.lit("".join(two)) for s, two in SYLLABLES.items()})
    at = lambda i: F.conv(F.substring(digest, 2 * (i % 40) + first, F.lit(2)), 16, 10).cast("int") % 16
    made = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(pool, 2 * at(i) + 1, F.lit(2)))
    return F.when(n > 0, F.array_join(made, "")).otherwise(F.lit(""))


def last_name(name: Column, draw: Column, key: str) -> Column:
    """The replacement of a last name. Later draws are longer: there are more of them."""
    seed = F.concat_ws("\x00", F.lit(key), F.lit("last"), F.initcap(name), draw.cast("string"))
    return let(F.sha2(seed.cast("binary"), 512), lambda d: F.initcap(_syllables(name, d, 3, F.conv(F.substring(d, 1, 1), 16, 10).cast("int") % 2 + draw + 3)))


def _name(entity: Column, digest: Column, draw: Column, sex: Column, last_draw: Column, key: str) -> Column:
    """A name of the given gender, of the same script, case and number of parts, after the same title or cue."""
    cue, name = F.regexp_extract(entity, _CUE, 0), F.regexp_replace(entity, _CUE, "")
    parts = F.split(name, " ")

    def given(at: int) -> Column:
        by = {s: F.when(sex == "m", _pick(FIRST_NAMES[s, "m"], digest, at)).when(sex == "f", _pick(FIRST_NAMES[s, "f"], digest, at)).otherwise(_pick(FIRST_NAMES[s, "n"], digest, at)) for s in SYLLABLES}
        return _by_script(name, by)

    first = F.concat(given(1), _syllables(name, digest, 10, draw))
    last = last_name(F.element_at(parts, -1), last_draw, key)
    middle = F.when(F.size(parts) > 2, F.concat(given(5), F.lit(" "))).otherwise(F.lit(""))
    new = F.when(F.size(parts) > 1, F.concat(first, F.lit(" "), middle, last)).when(entity.rlike(_TITLE), last).otherwise(first)
    return F.concat(cue, F.when((name == F.upper(name)) & (F.length(name) > 2), F.upper(new)).otherwise(new))


def _luhn(digits: Column) -> Column:
    """The check digit that belongs behind digits."""
    each = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c, i: let(c.try_cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda v: v % 10 + F.floor(v / 10)))
    return ((10 - F.aggregate(each, F.lit(0).cast("long"), lambda a, v: a + v) % 10) % 10).cast("string")


def _iban_check(country: Column, rest: Column) -> Column:
    """The two check digits of an account number, by the remainder of 97."""

    def step(r: Column, c: Column) -> Column:  # A is 10, and so on
        return F.when(c.rlike("[0-9]"), (r * 10 + c.try_cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)

    chars = F.filter(F.split(F.concat(rest, country, F.lit("00")), ""), lambda c: (c != "") & (c != " "))
    return F.lpad((98 - F.aggregate(chars, F.lit(0), step)).cast("string"), 2, "0")


def surrogate(entity: Column, kind: Column, draw: Column, key: str, sex: Column | None = None, last_draw: Column | None = None) -> Column:
    """The replacement of an entity, by the digest of its core and the number of draws before. Of a person also
    by the settled gender, and the draws of the last name."""
    sex, last_draw = gender(entity) if sex is None else sex, F.lit(0) if last_draw is None else last_draw

    def of(value: Column) -> Column:
        seed = F.concat_ws("\x00", F.lit(key), family(entity, kind), value, draw.cast("string"))
        return let(F.sha2(seed.cast("binary"), 512), lambda d: drawn(value, d))

    def drawn(value: Column, d: Column) -> Column:
        country = F.regexp_extract(entity, r"^\+\d{1,3}(?=[^0-9])", 0)
        # what is shaped, with what stands before and after it; codes keep to hexadecimal digits
        code = kind.isin("assigned", "secret") & value.rlike("^[0-9a-fA-F]+$")
        before = (
            F.when(kind == "assigned", F.regexp_extract(entity, _ASSIGNED, 0))
            .when(kind == "phone", country)
            .when(kind == "iban", F.substring(entity, 1, 2))
            .when(kind == "card", F.substring(entity, 1, 1))
            .otherwise(F.lit(""))
        )
        middle = (
            F.when(kind.isin("assigned", "secret"), value)
            .when(kind == "phone", F.substring(entity, F.length(country) + 1, F.lit(100)))
            .when(kind == "iban", F.substring(entity, 3, 100))
            .when(kind == "card", F.substring(entity, 2, 100))
            .when(kind == "email", F.regexp_extract(entity, r"^[^@]*@[^.]*", 0))
            .otherwise(entity)
        )
        after = F.when(kind == "assigned", F.substring(entity, -1, 1)).when(kind == "email", F.lit(".example.net")).otherwise(F.lit(""))

        def joined(shaped: Column) -> Column:
            cased = F.when(code & (value == F.upper(value)) & value.rlike("[A-F]"), F.upper(shaped)).otherwise(shaped)
            whole = F.concat(before, cased, after)
            digits = F.regexp_replace(whole, "[^0-9]", "")
            body = lambda x: F.substring(x, F.lit(1), F.length(x) - 1)
            card = F.when(_luhn(body(value)) == F.substring(value, -1, 1), F.concat(body(whole), _luhn(body(digits)))).otherwise(whole)
            holds = _iban_check(F.substring(value, 1, 2), F.substring(value, 5, 100)) == F.substring(value, 3, 2)
            iban = F.when(holds, F.concat(before, _iban_check(before, F.substring(whole, 5, 100)), F.substring(whole, 5, 100))).otherwise(whole)
            return F.when(kind == "card", card).when(kind == "iban", iban).otherwise(whole)

        return F.when(kind == "ip", _octets(d)).when(kind == "person", _name(entity, d, draw, sex, last_draw, key)).otherwise(let(_shape(middle, d, code), joined))

    return let(core(entity, kind), of)


def _settle(entities: DataFrame, new: Column, scratch: Scratch) -> DataFrame:
    """The entities (family, core ...) with the draw that each ends with; ``new``: replacement by draw.

    Of those that share a replacement, the one with the smallest core keeps it; one whose replacement is an
    entity of the corpus draws again too.
    """
    settled, names = entities.withColumn("draw", F.lit(0)), entities.columns
    real = entities.select("family", F.col("core").alias("new"), F.lit(True).alias("real"))
    for _ in range(DRAWS):
        now = scratch.save(settled.withColumn("new", new), "draws")
        shared = now.groupBy("family", "new").agg(F.min(F.struct("core")).alias("keeps"), F.count(F.lit(1)).alias("c")).where("c > 1").select("family", "new", F.col("keeps.core").alias("keeps"))
        again = now.join(shared, ["family", "new"], "left").join(real, ["family", "new"], "left")
        clash = F.coalesce("real", F.lit(False)) | F.coalesce(F.col("core") != F.col("keeps"), F.lit(False))
        settled = scratch.save(again.select(*names, (F.col("draw") + clash.cast("int")).alias("draw"), clash.alias("clash")), "draws")
        if not settled.where("clash").limit(1).count():
            return settled.drop("clash")
        settled = settled.drop("clash")
    raise RuntimeError(f"replacements still clash after {DRAWS} draws")


def settled_entities(docs: DataFrame, text_col: str, key: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """What the digest of a mention doesn't tell, over all documents: (family, core, draw, sex) of entities that
    draw again or whose mentions tell different genders, and (last, last_draw) of last names that draw again."""
    found = docs.select(F.explode(F.array_distinct(matches(text_of(text_col)))).alias("e")).distinct()
    # written, so that later steps read the kind rather than work it out in each expression that names it
    found = scratch.save(found.select("e", kind_of(F.col("e")).alias("kind")), "found")
    found = found.withColumn("family", family(F.col("e"), F.col("kind"))).withColumn("core", core(F.col("e"), F.col("kind")))
    # one mention stands for all: they differ in marks alone
    votes = [F.max((F.col("kind") == "person") & (gender(F.col("e")) == g)).alias(g) for g in "mfn"]
    every = found.groupBy("family", "core").agg(F.min(F.struct("e", "kind")).alias("one"), *votes)
    sex = F.when(F.col("m") & ~F.col("f"), F.lit("m")).when(F.col("f") & ~F.col("m"), F.lit("f")).otherwise(F.lit("n"))
    mixed = F.col("m").cast("int") + F.col("f").cast("int") + F.col("n").cast("int") > 1
    last = F.when(F.col("one.kind") == "person", F.element_at(F.split("core", " "), -1))
    every = scratch.save(every.select("family", "core", F.col("one.e").alias("e"), F.col("one.kind").alias("kind"), sex.alias("sex"), mixed.alias("mixed"), last.alias("last")), "entities")
    lasts = every.where("last IS NOT NULL").select(F.lit("last").alias("family"), F.col("last").alias("core")).distinct()
    lasts = _settle(lasts, last_name(F.col("core"), F.col("draw"), key), scratch).where("draw > 0").select(F.col("core").alias("last"), F.col("draw").alias("last_draw"))
    lasts = scratch.save(lasts, "lasts")
    others = every.where("family <> 'last'").join(lasts, "last", "left").withColumn("last_draw", F.coalesce("last_draw", F.lit(0)))
    drawn = let(surrogate(F.col("e"), F.col("kind"), F.col("draw"), key, F.col("sex"), F.col("last_draw")), lambda new: core(new, F.col("kind")))
    return _settle(others, drawn, scratch).where("draw > 0 OR mixed").select("family", "core", "draw", "sex"), lasts


def replaced(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY, scratch: Scratch | None = None) -> DataFrame:
    """The input with its text replaced, and ``_entities``: the kinds of what was replaced, in order.

    Null texts stay null and have no entities; repeated rows are replaced alike; ids may be null or
    repeat. Columns of the input keep their names and values.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    names = docs.columns
    settled, lasts = settled_entities(docs, text_col, key, scratch)
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), F.col(text_col).alias("_text"), matches(text_of(text_col)).alias("_found"))
    settled = scratch.save(settled, "settled")
    if settled.limit(1).count() or lasts.limit(1).count():
        rows = rows.withColumn("_i", F.coalesce(F.xxhash64(F.col("_row")), F.lit(0)))
        each = rows.select("_i", F.explode(F.array_distinct("_found")).alias("e")).withColumn("kind", kind_of(F.col("e")))
        each = each.select("_i", "e", family(F.col("e"), F.col("kind")).alias("family"), core(F.col("e"), F.col("kind")).alias("core"), (F.col("kind") == "person").alias("named"))
        each = each.withColumn("last", F.when(F.col("named"), F.element_at(F.split("core", " "), -1)))
        told = each.join(settled, ["family", "core"], "left").join(lasts, "last", "left").where("draw IS NOT NULL OR last_draw IS NOT NULL")
        told = told.groupBy("_i").agg(F.map_from_entries(F.collect_set(F.struct("e", F.struct("draw", "sex", "last_draw")))).alias("_told"))
        rows = rows.join(told, "_i", "left")
    else:
        rows = rows.withColumn("_told", F.lit(None).cast("map<string,struct<draw:int,sex:string,last_draw:int>>"))

    def one(e: Column) -> Column:
        def of(kind: Column, told: Column) -> Column:
            new = surrogate(e, kind, F.coalesce(told["draw"], F.lit(0)), key, F.coalesce(told["sex"], gender(e)), F.coalesce(told["last_draw"], F.lit(0)))
            return F.struct(kind.alias("kind"), new.alias("new"))

        return let(F.struct(kind_of(e).alias("kind"), F.try_element_at("_told", e).alias("told")), lambda x: of(x["kind"], x["told"]))

    def built(new: Column) -> Column:
        parts = F.transform(F.split("_text", _ALL), lambda piece, i: F.concat(piece, F.coalesce(F.get(new, i)["new"], F.lit(""))))
        return F.struct(F.array_join(parts, "").alias("text"), F.transform(new, lambda x: x["kind"]).alias("kinds"))

    some = let(F.transform("_found", one), built)
    result = F.when(F.size("_found") > 0, some).otherwise(F.struct(F.col("_text").alias("text"), F.array().cast("array<string>").alias("kinds")))
    out = rows.select("_row", result.alias("_new"))
    return out.select(*[(F.col("_new.text") if n == text_col else F.col(f"_row.`{n}`")).alias(n) for n in names], F.col("_new.kinds").alias("_entities"))


def surrogates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """(id, text, n_entities, n_email, n_phone, n_ip, n_card, n_secret, n_person, n_other) of every document."""
    done = replaced(docs.select(id_col, text_col), id_col, text_col, key)
    count = lambda *kinds: F.size(F.filter("_entities", lambda k: k.isin(*kinds)))
    return done.select(
        id_col, text_col, F.size("_entities").alias("n_entities"), count("email").alias("n_email"), count("phone").alias("n_phone"), count("ip").alias("n_ip"),
        count("card").alias("n_card"), count("secret", "assigned").alias("n_secret"), count("person").alias("n_person"), count("iban", "ssn").alias("n_other"),
    )

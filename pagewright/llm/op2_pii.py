"""Surrogates for personal data: keyed replacements of the same kind, script and format."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, table

#: What is detected, in the order in which alternatives are tried.
MALE, FEMALE = "Mr|Mister|Sir|Lord|Herr|Monsieur|Señor|Don|Господин", "Mrs|Ms|Miss|Lady|Dame|Frau|Madame|Mme|Mademoiselle|Señora|Señorita|Doña|Госпожа"
TITLE = rf"(?:{MALE}|{FEMALE}|Dr|Doctor|Doktor|Prof|Professor|Доктор|Профессор)"
#: Given names that begin a name without a title. None of them is a common word.
KNOWN = {
    "m": "Alexander Andrew Anthony Antonio Arthur Benjamin Brian Bruno Carlos Charles Christopher Daniel David Edward Emil Enrique Felix Francisco Georg George Gregory Günther Hans Heinrich Henry Hugo James Javier Jean Jürgen John Johann José Joseph Juan Jacques Karl Kevin Klaus Leonard Louis Ludwig Luis Manuel Martin Matthew Michael Miguel Nicholas Oliver Pablo Patrick Paul Pedro Peter Philippe Pierre Rafael Richard Robert Ronald Samuel Stefan Stephen Steven Thomas Timothy Vincent Walter Werner William Wolfgang Александр Алексей Андрей Борис Виктор Владимир Дмитрий Иван Михаил Николай Павел Пётр Сергей".split(),
    "f": "Alexandra Alice Amanda Andrea Angela Anna Anne Barbara Beatriz Brigitte Camille Carmen Caroline Catherine Charlotte Christine Claudia Deborah Dolores Dorothy Elena Elisabeth Elizabeth Emily Emma Françoise Gertrud Hannah Heidi Helen Helga Ingrid Isabel Isabelle Jennifer Jessica Johanna Julia Karen Katharina Laura Linda Lisa Louise Lucía Margaret Margarita María Maria Marie Mary Monika Nathalie Nicole Patricia Petra Pilar Rebecca Rosa Sabine Sandra Sarah Sophie Stephanie Susan Susanne Teresa Ursula Valérie Victoria Анастасия Анна Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
}
#: Words between names that stay as they are.
PARTICLES = "von van vom zu zur der den de del della di da dos du la le ter ten".split()
#: A word of a name, after initials and particles if there are any.
WORD_OF_NAME = rf"(?:(?:{'|'.join(PARTICLES)}) |\p{{Lu}}\.? )*(?:\p{{Ll}}{{1,3}}['’-])?\p{{Lu}}[\p{{L}}'’-]{{0,40}}\p{{L}}"
_FIRST = rf"(?=\p{{Lu}})(?:{'|'.join(KNOWN['m'] + KNOWN['f'])})"
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-fA-F]{32,128}|AKIA[0-9A-Z]{16}|(?:sk-|ghp_)[A-Za-z0-9]{20,64})(?![\p{L}\p{N}])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?!\d)",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<!\d)(?:\(\d{3}\) ?|\d{3}-)\d{3}-\d{4}(?!\d)",
    "name": rf"(?<!\p{{L}})(?:{TITLE}\.? {WORD_OF_NAME}(?: {WORD_OF_NAME})*|{_FIRST}(?: {WORD_OF_NAME})+)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these has no entity.
HINT = rf"[0-9@]|(?<!\p{{L}})(?=\p{{Lu}})(?:{TITLE}\.?|{_FIRST}) \p{{Lu}}"

#: Given names by script and gender, and syllables that make up family names.
GIVEN = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Leo"],
    ("latin", "f"): ["Ada", "Bella", "Clara", "Diana", "Emma", "Frida", "Hanna", "Lea"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Павел", "Роман"],
    ("cyrillic", "f"): ["Анна", "Белла", "Вера", "Галина", "Дарья", "Ирина", "Ольга", "Раиса"],
}
SYLLABLES = {
    "latin": ["ba", "de", "ka", "lo", "mi", "na", "no", "pe", "ra", "ri", "sa", "so", "ta", "ti", "va", "vo"],
    "cyrillic": ["ба", "де", "ка", "ло", "ми", "на", "но", "пе", "ра", "ри", "са", "со", "та", "ти", "ва", "во"],
}
#: A family name has so many syllables, and one more each time it is bumped, as far as PATTERNS["name"] finds it whole.
FEWEST, MOST = 4, 15
#: Codes of countries after the +, fixed values: one digit, two, and otherwise three.
CALLING = r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
#: Between what a part of a name is and the part.
PART = "\x1f"
_HEX = "0123456789abcdef"


def _keyed(key: str, *parts: Column) -> Column:
    """A keyed hash of the parts, as hex."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *(p.cast("string") for p in parts)), 256)


def _number(key: str, *parts: Column) -> Column:
    """The first 60 bits of a keyed hash."""
    return F.conv(F.substring(_keyed(key, *parts), 1, 15), 16, 10).cast("long")


def _ten_to(n: Column) -> Column:
    return F.element_at(F.array(*(F.lit(10**i).cast("long") for i in range(17))), n + 1)


def _let(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x), with x computed once: a lambda's variable holds it."""
    return F.get(F.transform(F.array(x), lambda y: then(y)), F.lit(0))


def _feistel(a: Column, b: Column, most_a: Column, most_b: Column, key: str, tweak: Column, then: Callable[[Column, Column], Column]) -> Column:
    """Four rounds over two numbers, then `then` of them: a bijection, so different values stay different."""

    def turn(a: Column, b: Column, r: int) -> Column:
        if r == 4:
            return then(a, b)
        if r % 2:
            return _let(F.pmod(b + _number(key, tweak, F.lit(r), a), most_b), lambda x: turn(a, x, r + 1))
        return _let(F.pmod(a + _number(key, tweak, F.lit(r), b), most_a), lambda x: turn(x, b, r + 1))

    return _let(a, lambda x: _let(b, lambda y: turn(x, y, 0)))


def _permute_digits(digits: Column, key: str, bump: Column) -> Column:
    """Another string of as many digits; bijective for each length and bump."""

    def of(d: Column, n: Column, half: Column) -> Column:
        a, b = F.coalesce(F.substr(d, F.lit(1), half).try_cast("long"), F.lit(0).cast("long")), F.substr(d, half + 1, n - half).cast("long")
        text = lambda x, width: F.lpad(x.cast("string"), width, F.lit("0"))
        return _feistel(a, b, _ten_to(half), _ten_to(n - half), key, F.concat_ws(":", n.cast("string"), bump.cast("string")), lambda x, y: F.concat(text(x, half), text(y, n - half)))

    return _let(digits, lambda d: _let(F.length(d), lambda n: _let(F.floor(n / 2).cast("int"), lambda half: of(d, n, half))))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _into_format(v: Column, digits: Column) -> Column:
    """`v` with its digits replaced in order by `digits`."""

    def at(i: Column) -> Column:
        c = F.substr(v, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substr(digits, F.length(_digits(F.substr(v, F.lit(1), i))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(v)), at), "")


def _checksum(body: Column) -> Column:
    """The Luhn sum of a number's digits but the last."""

    def digit(i: Column) -> Column:
        d = F.substr(body, i, F.lit(1)).cast("int")
        twice = F.when((F.length(body) - i) % 2 == 0, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(body)), F.lit(0), lambda s, i: s + digit(i))


def _card(v: Column, key: str, bump: Column) -> Column:
    """Digits change, the number stays valid or invalid under its checksum as it was."""

    def of(d: Column, body: Column, new: Column) -> Column:
        last = F.pmod(F.substr(d, F.length(d), F.lit(1)).cast("int") + _checksum(body) - _checksum(new), F.lit(10))
        return _let(F.concat(new, last.cast("string")), lambda x: _into_format(v, x))

    return _let(_digits(v), lambda d: _let(F.substr(d, F.lit(1), F.length(d) - 1), lambda body: _let(_permute_digits(body, key, bump), lambda new: of(d, body, new))))


def _phone(v: Column, key: str, bump: Column) -> Column:
    """The country's code stays, however the number is written; all other digits change."""
    code = F.regexp_extract(F.concat(F.regexp_extract(v, r"^\+", 0), _digits(v)), rf"^\+({CALLING})", 1)

    def of(c: Column, d: Column) -> Column:
        return _let(_permute_digits(F.substr(d, F.length(c) + 1, F.length(d)), key, bump), lambda new: _let(F.concat(c, new), lambda x: _into_format(v, x)))

    return _let(code, lambda c: _let(_digits(v), lambda d: of(c, d)))


def _ip(v: Column, key: str, bump: Column) -> Column:
    part = lambda i: F.regexp_extract(v, r"^(\d+)\.(\d+)\.(\d+)\.(\d+)$", i).cast("long")
    full = F.lit(65536).cast("long")
    dotted = lambda a, b: F.concat_ws(".", *(x.cast("string") for x in (F.floor(a / 256), a % 256, F.floor(b / 256), b % 256)))
    return _feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), full, full, key, bump, dotted)


def _letters(hexes: Column) -> Column:
    return F.translate(hexes, _HEX, "abcdefghijklmnop")


def _email(v: Column, key: str, bump: Column) -> Column:
    local, domain = F.regexp_extract(v, "^(.*)@", 1), F.regexp_extract(v, "@(.*)$", 1)

    def of(mark: Column, tail: Column) -> Column:
        digits = F.translate(F.substr(mark, F.lit(20), F.length(tail) - 1), "abcdef", "012345")
        return F.concat(_letters(F.substring(mark, 1, 12)), F.when(tail != "", F.concat(F.substring(tail, 1, 1), digits)).otherwise(F.lit("")))

    own = _let(_keyed(key, F.lower(v), bump), lambda mark: _let(F.regexp_extract(local, r"[._+-][0-9]{1,9}$", 0), lambda tail: of(mark, tail)))
    new = F.concat(own, F.lit("@"), _letters(F.substring(_keyed(key, F.lower(domain)), 1, 6)), F.lit(".example."), F.lower(F.regexp_extract(domain, r"([A-Za-z]+)$", 1)))
    return _let(new, lambda x: F.when((v == F.upper(v)) & (v != F.lower(v)), F.upper(x)).otherwise(x))


def _secret(v: Column, key: str, bump: Column) -> Column:
    """A known prefix stays; capitals stay capitals, and name the same secret as small letters."""
    head = F.regexp_extract(v, "^(AKIA|sk-|ghp_)", 1)
    own = F.when(head == "", F.lower(v)).otherwise(v)
    body = F.substr(F.concat(*(_keyed(key, own, bump, F.lit(i)) for i in range(2))), F.lit(1), F.length(v) - F.length(head))
    capital = (head == "") & (v == F.upper(v)) & (v != F.lower(v))
    return _let(body, lambda x: F.concat(head, F.when(head == "AKIA", F.upper(_letters(x))).when(capital, F.upper(x)).otherwise(x)))


def _rest_of_97(v: Column) -> Column:
    """An IBAN's letters and digits as a number, the first four of them last, modulo 97: 1 if it is valid."""
    moved = F.concat(F.substr(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))

    def digit(i: Column) -> Column:
        c = F.substr(moved, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(moved)), digit), F.lit(0), lambda r, d: (r * F.when(d > 9, 100).otherwise(10) + d) % 97)


def _iban(v: Column, key: str, bump: Column) -> Column:
    """Country and layout stay, letters become letters and digits digits; its check digits are right if they were, and else wrong."""

    def at(own: Column, mark: Column, i: Column) -> Column:
        c, h = F.substr(own, i, F.lit(1)), F.substr(mark, i, F.lit(1))
        return F.when(i <= 2, c).when(i <= 4, F.lit("0")).when(c.rlike("[0-9]"), F.translate(h, "abcdef", "123456")).otherwise(F.upper(_letters(h)))

    def checked(own: Column, blank: Column) -> Column:
        right = 98 - _rest_of_97(blank)
        digits = F.when(_rest_of_97(own) == 1, right).otherwise(F.when(right < 98, right + 1).otherwise(2))
        return F.concat(F.substring(blank, 1, 2), F.lpad(digits.cast("string"), 2, "0"), F.substr(blank, F.lit(5), F.length(blank)))

    def spaced(new: Column) -> Column:
        at = lambda i: F.when(F.substr(v, i, F.lit(1)) == " ", F.lit(" ")).otherwise(F.substr(new, F.length(F.replace(F.substr(v, F.lit(1), i), F.lit(" "), F.lit(""))), F.lit(1)))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(v)), at), "")

    def of(own: Column, mark: Column) -> Column:
        blank = F.array_join(F.transform(F.sequence(F.lit(1), F.length(own)), lambda i: at(own, mark, i)), "")
        return _let(_let(blank, lambda b: checked(own, b)), spaced)

    plain = F.replace(v, F.lit(" "), F.lit(""))
    return _let(plain, lambda own: _let(F.concat(_keyed(key, own, bump), _keyed(key, own, bump, F.lit(1))), lambda mark: of(own, mark)))


def _pick(items: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (F.pmod(n, F.lit(len(items))) + 1).cast("int"))


def _title(v: Column) -> Column:
    return F.regexp_extract(v, rf"^{TITLE}\.? ", 0)


def _name_keys(v: Column) -> Column:
    """A name's parts, each with what it is: the family name, which is the last word, and then each word before with the gender.

    The gender is the title's or, if it has none, that of a known given name; `n` is for neither.
    """

    def of(title: Column, rest: Column) -> Column:
        script = F.when(rest.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))
        gender = F.when(title.rlike(rf"^(?:{MALE})\.? $"), "m").when(title.rlike(rf"^(?:{FEMALE})\.? $"), "f")
        for g, known in KNOWN.items():
            gender = gender.when(rest.rlike(rf"^(?:{'|'.join(known)}) "), g)
        part = lambda what, x, g: F.concat_ws(PART, F.lit(what), script, g, F.lower(x))
        words = F.split(rest, " ")
        family = F.array(part("family", F.element_at(words, -1), F.lit("-")))
        return _let(gender.otherwise("n"), lambda g: F.concat(family, F.transform(F.slice(words, F.lit(1), F.size(words) - 1), lambda x: part("given", x, g))))

    return _let(_title(v), lambda title: of(title, F.substr(v, F.length(title) + 1, F.length(v))))


def _part(k: Column, key: str, bump: Column) -> Column:
    """The surrogate of a part of a name, of its script and gender. A given name that is bumped gets syllables."""
    what = F.split(k, PART)
    syllables = lambda s, n: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: _pick(SYLLABLES[s], _number(key, k, bump, i))), "")
    out = F.when(F.lit(False), F.lit(""))
    either = {(script, "n"): GIVEN[script, "m"] + GIVEN[script, "f"] for script in SYLLABLES}
    for (script, gender), names in (GIVEN | either).items():
        given = F.concat(_pick(names, _number(key, k, bump, F.lit("given"))), F.when(bump > 0, syllables(script, F.least(bump, F.lit(MOST - 5)))).otherwise(F.lit("")))
        out = out.when((what[0] == "given") & (what[1] == script) & (what[2] == gender), given)
    for script in SYLLABLES:
        out = out.when(what[1] == script, F.initcap(syllables(script, F.least(bump + FEWEST, F.lit(MOST)))))
    return out


def _name(v: Column, key: str, bump_of: Callable[[Column], Column]) -> Column:
    """The title stays; each given name and the family name have their surrogates, so a family name's is the same with and without given names.

    An initial becomes one letter, that of its surrogate.
    """
    initial = rf"{PART}\p{{L}}\.?$"

    def put(k: Column) -> Column:
        dot = F.when(F.endswith(k, F.lit(".")), ".").otherwise("")
        own = F.element_at(F.split(k, PART), -1)
        return _let(_part(k, key, bump_of(k)), lambda new: F.when(own.isin(PARTICLES), own).when(k.rlike(initial), F.concat(F.substring(new, 1, 1), dot)).otherwise(new))

    words = lambda keys: F.concat(F.slice(keys, F.lit(2), F.size(keys) - 1), F.slice(keys, 1, 1))
    return F.concat(_title(v), _let(_name_keys(v), lambda keys: F.array_join(F.transform(words(keys), put), " ")))


def kind_of(v: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        hit = v.rlike(rf"^(?:{pattern})$")
        out = F.when(hit, F.lit(kind)) if out is None else out.when(hit, F.lit(kind))
    return out.otherwise(F.lit("phone"))


def canonical(v: Column, kind: Column) -> Column:
    """What is the same entity in other letters or layouts: addresses and hex secrets in small letters, IBANs, cards and phones without gaps and marks."""
    small = (kind == "email") | ((kind == "secret") & ~v.rlike("^(AKIA|sk-|ghp_)"))
    return F.when(small, F.lower(v)).when(kind == "iban", F.replace(v, F.lit(" "), F.lit(""))).when(kind == "card", _digits(v)).when(kind == "phone", F.concat(F.regexp_extract(v, r"^\+", 0), _digits(v))).otherwise(v)


def keys_of(v: Column) -> Column:
    """What an entity is known by: its canonical form, or the parts of a name."""
    return _let(kind_of(v), lambda kind: F.when(kind == "name", _name_keys(v)).otherwise(F.array(canonical(v, kind))))


def surrogate(v: Column, bump_of: Callable[[Column], Column], key: str) -> Column:
    """The replacement of an entity, by the bumps of what it is known by. The same entity, bump and key give the same one."""
    makers = {"email": _email, "iban": _iban, "secret": _secret, "ip": _ip, "card": _card}

    def of(kind: Column, bump: Column) -> Column:
        out = F.when(kind == "ssn", _let(_permute_digits(_digits(v), key, bump), lambda d: _into_format(v, d)))
        for name, make in makers.items():
            out = out.when(kind == name, make(v, key, bump))
        return out.when(kind == "name", _name(v, key, bump_of)).otherwise(_phone(v, key, bump))

    return _let(kind_of(v), lambda kind: _let(bump_of(canonical(v, kind)), lambda bump: of(kind, bump)))


def surrogate_key(k: Column, bump: Column, key: str) -> Column:
    """What the surrogate of an entity is known by, from what the entity is: keys_of() of its replacement."""
    name = F.concat(F.regexp_extract(k, f"^.*{PART}", 0), F.lower(_part(k, key, bump)))
    other = _let(surrogate(k, lambda _: bump, key), lambda new: canonical(new, kind_of(k)))
    return F.when(F.contains(k, F.lit(PART)), name).otherwise(other)


def entities(text: Column) -> Column:
    """All entities of a text in order, repeats included."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def find_collisions(values: DataFrame, key: str) -> DataFrame:
    """(value, bump) of the values, as keys_of() has them, whose plain surrogate can't stand.

    It can't if another value has the same one, or if it is itself a value of the corpus. Such
    values are hashed anew with a counter until all surrogates differ from each other and from the
    values. Most digit formats are permuted, so few values come here; names grow with the counter, so
    there are always enough of them.
    """
    now = keep(values.select("value", F.lit(0).alias("bump")), "pii-values")
    while True:
        made = keep(now.select("value", "bump", surrogate_key(F.col("value"), F.col("bump"), key).alias("new")), "pii-made")
        taken = made.select(F.col("value").alias("new"), F.lit(True).alias("real"))
        order = Window.partitionBy("new").orderBy("bump", "value")
        ranked = made.withColumn("rank", F.row_number().over(order)).join(taken, "new", "left")
        judged = keep(ranked.select("value", "bump", ((F.col("rank") > 1) | F.col("real").isNotNull()).alias("bad")), "pii-judged")
        if judged.filter("bad").isEmpty():
            return judged.filter("bump > 0").select("value", "bump")
        now = judged.select("value", F.when(F.col("bad"), F.col("bump") + 1).otherwise(F.col("bump")).alias("bump"))


def replace_entities(docs: DataFrame, key: str = "corpus", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put surrogates in place of the personal data of all texts.

    Returns the columns of `docs` with the text replaced, and n_entities, in place of a column of that
    name. One entity has one surrogate in the whole corpus (coreference), whatever the case of an
    address or the layout of an IBAN, card or phone; a family name has one after any title, with given
    names or without, and each given name one for its gender. A name is a title or a known given name
    and all words with capitals that follow; other names aren't detected. Two entities never have the
    same surrogate (distinctness). Names in scripts other than Latin and Cyrillic get Latin ones. A
    null text stays null with 0 entities. Rows with equal or null ids are handled each for itself.
    """
    seen = docs.withColumn("_pii_found", entities(F.col(text_col)))
    found = F.col("_pii_found")
    known = lambda values: F.array_distinct(F.flatten(F.transform(values, keys_of)))
    each = seen.select(F.explode(found).alias("value")).distinct().select(F.explode(keys_of(F.col("value"))).alias("value")).distinct()
    bumps = find_collisions(each, key)

    def rebuilt(rows: DataFrame) -> DataFrame:
        whole = F.zip_with(F.split(F.col(text_col), ANY, -1), "_pii_new", lambda p, s: F.concat(F.coalesce(p, F.lit("")), F.coalesce(s, F.lit(""))))
        out = F.when(F.size("_pii_new") > 0, F.array_join(whole, "")).otherwise(F.col(text_col))
        return rows.select(*(out.alias(c) if c == text_col else F.col(c) for c in docs.columns if c != "n_entities"), F.size("_pii_new").alias("n_entities"))

    if bumps.isEmpty():
        return rebuilt(seen.withColumn("_pii_new", F.transform(found, lambda v: surrogate(v, lambda _: F.lit(0), key))))
    # Texts with a bumped value get their counters by the text's own hash.
    version = F.sha2(F.col(text_col), 256)
    hits = seen.select(version.alias("_pii_of"), F.explode(known(found)).alias("value")).distinct().join(bumps, "value")
    maps = hits.groupBy("_pii_of").agg(F.map_from_entries(F.collect_list(F.struct("value", "bump"))).alias("_pii_bumps"))
    joined = seen.withColumn("_pii_version", version).join(maps, F.col("_pii_version") == F.col("_pii_of"), "left")
    return rebuilt(joined.withColumn("_pii_new", F.transform(found, lambda v: surrogate(v, lambda k: F.coalesce(F.try_element_at("_pii_bumps", k), F.lit(0)), key))))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates in place of personal data: doc_id, text, n_entities."""
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"))

"""Surrogates for personal data, in DataFrame functions alone.

One pattern finds e-mail addresses, IPv4 addresses, phone numbers, social security numbers, payment card numbers, and
names after a title. A name of two or more words that a text gives with a title is then found without one too, anywhere
in that text. All repeats of the pattern are bounded or possessive, so no text can make it recurse deeply. Mentions of
one entity have one canonical form: digits without their punctuation, addresses and names in lower case. The surrogate of a canonical form is computed from a keyed digest of it, so that it is the same
in every document and on every worker, without a table, and has the form's kind: digits for digits, letters for
letters, octets with as many digits, one domain for one domain, a card's issuer and check digit, a phone's country code,
the script of a name, the gender that its title shows, and as many words. A mention gets the surrogate in
its own punctuation and case.

Collision checks: over all distinct entities of the corpus, two that have the same surrogate, or one whose surrogate is
a real entity, are found by grouping and joining; all but the smallest get the surrogate of their next attempt, until
none is left. Domains are entities of their own and are settled first. Later attempts have more room: octets of any number
of digits, longer names, local parts and hosts, so that a kind whose first attempts are all taken does not run out. The few entities beyond their first attempt are all that has to be looked up; up to a bound they go along
as a map, beyond it they are joined.

Defined results: a null text stays null and an empty one empty; a null id stays null; equal rows each give a row; other
columns stay where replace() is used and are ignored by the query; an empty table gives an empty table. If the
surrogates of a kind run out, it raises an error rather than letting two entities become one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import discard, read_table, scratch_path, written

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?=[A-Za-z0-9.-]{1,255}+(?![A-Za-z0-9.-]))[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){0,125}\.[A-Za-z]{2,63}+"
IP = rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9A-Za-z+])(?:\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
CARD = r"(?<![0-9A-Za-z])[2-6](?:[0-9]{12,18}|[0-9]{3}(?:[ -][0-9]{4}){3})(?![0-9A-Za-z])"
MALE = ["Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"]
NEUTRAL = ["Dr", "Prof"]
TITLES = "|".join(MALE + FEMALE + NEUTRAL)
NAME = rf"(?<!\p{{L}})(?:{TITLES})\.?\x20\p{{Lu}}[\p{{L}}'-]++(?:\x20\p{{Lu}}[\p{{L}}'-]++){{0,2}}"
ANY = "|".join((EMAIL, IP, PHONE, SSN, CARD, NAME))
#: Texts without any of these have no mention: a quick look before the pattern.
HINT = rf"[@0-9]|(?<!\p{{L}})(?:{TITLES})\.?\x20"
KINDS = ["email", "ip", "phone", "ssn", "card", "name"]
TITLE = rf"^({TITLES})\.?\x20"
SYLLABLES = {"Latin": ("bcdfghjklmnprstvwz", "aeiou"), "Cyrillic": ("бвгдзклмнпрстф", "аеиоу"), "Greek": ("βγδζκλμνπρστφ", "αεηιο")}
#: Of given names after male, female and other titles.
ENDINGS = {"Latin": ("o", "a", "e"), "Cyrillic": ("о", "а", "е"), "Greek": ("ος", "α", "ε")}
MAX_ATTEMPTS = 60
#: Entities beyond their first attempt that may go along with every task: about 100 bytes each.
BROADCAST_ENTITIES = 50_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def kind_of(mention: Column) -> Column:
    return (
        F.when(mention.contains("@"), "email").when(mention.rlike(TITLE), "name").when(mention.rlike(rf"^{IP}$"), "ip")
        .when(mention.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").when(mention.rlike(rf"^(?:{PHONE})$"), "phone").otherwise("card")
    )


def canonical(mention: Column, kind: Column) -> Column:
    """The form that all mentions of an entity share; a name's begins with m, f or n and a bar."""
    gender = F.when(mention.rlike(rf"^(?:{'|'.join(MALE)})\.?\x20"), "m|").when(mention.rlike(rf"^(?:{'|'.join(FEMALE)})\.?\x20"), "f|").otherwise("n|")
    return (
        F.when(kind == "email", F.lower(mention)).when(kind == "ip", mention)
        .when(kind == "name", F.concat(gender, F.lower(F.regexp_replace(mention, TITLE, "")))).otherwise(F.regexp_replace(mention, "[^0-9+]", ""))
    )


def _stream(key: str, *seed: Column) -> Column:
    """512 hexadecimal digits from the key and the seed, with a length before each part so that parts can't run together."""
    parts = F.concat(*(F.concat(F.length(s).cast("string"), F.lit(":"), s) for s in seed))
    return F.concat(*(F.sha2(F.concat(F.lit(f"{key}/{j}/"), parts), 512) for j in range(4)))


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (i % 256) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _each(text: Column, change: Callable[[Column, Column], Column]) -> Column:
    """text with change(char, place) for each character."""
    return F.when(F.length(text) > 0, F.array_join(F.transform(F.split(text, ""), change), "")).otherwise("")


def _digit(char: Column, by: Column) -> Column:
    return ((char.cast("int") + by) % 10).cast("string")


def _like(text: Column, stream: Column) -> Column:
    """Letters for small letters, digits for digits, the rest as it is."""
    letters = "abcdefghijklmnopqrstuvwxyz"

    def change(s: Column) -> Callable[[Column, Column], Column]:
        return lambda c, i: F.when(c.rlike("[0-9]"), _digit(c, _byte(s, i))).when(c.rlike("[a-z]"), F.substring(F.lit(letters), _byte(s, i) % 26 + 1, F.lit(1))).otherwise(c)

    return let(stream, lambda s: _each(text, change(s)))


def _more(stream: Column, attempt: Column) -> Column:
    """As many letters as the attempt says."""
    return F.when(attempt == "0", "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), attempt.cast("int")), lambda i: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _byte(stream, i + 128) % 26 + 1, F.lit(1))), ""))


def _domain(form: Column, attempt: Column, key: str) -> Column:
    host, top = F.regexp_replace(form, r"\.[a-z]+$", ""), F.substring_index(form, ".", -1)
    return let(_stream(key, F.lit("domain"), form, attempt), lambda s: F.concat(_like(host, s), _more(s, attempt), F.lit("."), top))


def _email(form: Column, attempt: Column, key: str, domain: Column) -> Column:
    local = F.substring_index(form, "@", 1)
    return let(_stream(key, F.lit("email"), form, attempt), lambda s: F.concat(_like(local, s), _more(s, attempt), F.lit("@"), domain))


def _ip(form: Column, attempt: Column, key: str) -> Column:
    def octet(part: Column, v: Column) -> Column:
        size = F.length(part)
        return F.when(attempt != "0", v % 256).when(size == 3, 100 + v % 156).when(size == 2, 10 + v % 90).otherwise(v % 10).cast("string")

    return let(_stream(key, F.lit("ip"), form, attempt), lambda s: F.array_join(F.transform(F.split(form, r"\."), lambda part, i: octet(part, F.conv(F.substring(s, i * 8 + 1, F.lit(7)), 16, 10).cast("int"))), "."))


def _digits(form: Column, attempt: Column, key: str, kind: str, fixed: Column) -> Column:
    """Other digits from place `fixed` on."""
    return let(_stream(key, F.lit(kind), form, attempt), lambda s: _each(form, lambda c, i: F.when((i < fixed) | (c == "+"), c).otherwise(_digit(c, _byte(s, i)))))


def _check_sum(digits: Column) -> Column:
    """The sum of a card number's digits, every second from the right doubled, modulo 10."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return (total + F.when(d > 9, d - 9).otherwise(d)) % 10

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _card(form: Column, attempt: Column, key: str) -> Column:
    def checked(made: Column) -> Column:
        body = F.substring(made, F.lit(1), F.length(made) - 1)
        return let(F.concat(body, F.lit("0")), lambda b: F.concat(body, ((10 - _check_sum(b)) % 10).cast("string")))

    return let(_digits(form, attempt, key, "card", F.lit(1)), lambda made: F.when(_check_sum(form) == 0, checked(made)).otherwise(made))


def _name(form: Column, attempt: Column, key: str) -> Column:
    """Word for word from syllables of the script; given names end as their gender does. Each attempt adds a syllable."""
    gender = F.substring(form, 1, 1)

    def word(w: Column, given: Column) -> Column:
        def of(script: str, s: Column) -> Column:
            consonants, vowels = SYLLABLES[script]
            sounds = F.transform(F.sequence(F.lit(0), F.lit(1) + _byte(s, F.lit(255)) % 2 + attempt.cast("int")), lambda i: F.concat(F.substring(F.lit(consonants), _byte(s, i * 2) % len(consonants) + 1, F.lit(1)), F.substring(F.lit(vowels), _byte(s, i * 2 + 1) % len(vowels) + 1, F.lit(1))))
            ending = F.when(given, F.when(gender == "m", ENDINGS[script][0]).when(gender == "f", ENDINGS[script][1]).otherwise(ENDINGS[script][2])).otherwise(F.substring(F.lit(consonants), _byte(s, F.lit(254)) % len(consonants) + 1, F.lit(1)))
            return F.concat(F.array_join(sounds, ""), ending)

        seed = F.when(given, F.concat(F.lit("given|"), gender)).otherwise("surname")
        return let(_stream(key, seed, w, attempt), lambda s: F.when(w.rlike(r"\p{IsCyrillic}"), of("Cyrillic", s)).when(w.rlike(r"\p{IsGreek}"), of("Greek", s)).otherwise(of("Latin", s)))

    return let(F.split(F.substring(form, F.lit(3), F.length(form)), " "), lambda words: F.array_join(F.transform(words, lambda w, i: word(w, i < F.size(words) - 1)), " "))


def surrogate(kind: Column, form: Column, attempt: Column, key: str, domain: Column | None = None) -> Column:
    """The surrogate of a canonical form at an attempt. A name's is without gender and bar; an address takes its domain's."""
    n = attempt.cast("string")
    country = F.when(form.startswith("+1"), 2).when(form.startswith("+"), 3).otherwise(0)
    return (
        F.when(kind == "email", _email(form, n, key, F.lit("") if domain is None else domain)).when(kind == "ip", _ip(form, n, key)).when(kind == "name", _name(form, n, key))
        .when(kind == "phone", _digits(form, n, key, "phone", country)).when(kind == "ssn", _digits(form, n, key, "ssn", F.lit(0))).otherwise(_card(form, n, key))
    )


def rendered(mention: Column, kind: Column, made: Column) -> Column:
    """The surrogate with the punctuation and case of the mention."""
    def digits(m: Column) -> Callable[[Column], Column]:
        def place(i: Column) -> Column:
            return F.length(F.regexp_replace(F.substring(m, F.lit(1), i), "[^0-9+]", ""))

        # Numbers have at most some thirty characters.
        return lambda s: _each(m, lambda c, i: F.when(c.rlike("[0-9+]"), F.substring(s, place(i) + 1, F.lit(1))).otherwise(c))

    name = F.regexp_replace(mention, TITLE, "")
    name_made = F.concat(F.regexp_extract(mention, TITLE, 0), F.when(name == F.upper(name), F.upper(made)).otherwise(F.initcap(made)))
    # Where a later attempt has made the surrogate longer, places don't match, and it stays in lower case.
    email_made = let(made, lambda s: F.when(F.length(s) != F.length(mention), s).otherwise(_each(mention, lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(F.substring(s, i + 1, F.lit(1)))).otherwise(F.substring(s, i + 1, F.lit(1))))))
    return F.when(kind == "email", email_made).when(kind == "ip", made).when(kind == "name", name_made).otherwise(let(made, digits(mention)))


def _named(found: Column) -> Column:
    """(name, form) of the names of two or more words among the mentions."""
    titled = F.filter(found, lambda m: m["kind"] == "name")
    names = F.transform(titled, lambda m: F.struct(F.regexp_replace(m["mention"], TITLE, "").alias("name"), m["form"].alias("form")))
    return F.filter(names, lambda n: n["name"].contains(" "))


def mentions(text: Column) -> Column:
    """(pattern, found): the pattern of the text's mentions, and an array of (mention, kind, form) in their order; null for texts without any."""

    def all_of(pattern: Column, named: Column | None = None) -> Column:
        def one(m: Column) -> Column:
            plain = let(kind_of(m), lambda k: F.struct(m.alias("mention"), k.alias("kind"), canonical(m, k).alias("form")))
            if named is None:
                return plain
            same = F.filter(named, lambda n: n["name"] == m)
            return F.when(F.size(same) > 0, F.struct(m.alias("mention"), F.lit("name").alias("kind"), F.try_element_at(same, F.lit(1))["form"].alias("form"))).otherwise(plain)

        return F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), one)

    def with_names(found: Column) -> Column:
        def wider(named: Column) -> Column:
            # Letters, hyphens, apostrophes and spaces stand for themselves in a pattern.
            names = F.concat(F.lit(ANY + r"|(?<!\p{L})(?:"), F.array_join(F.transform(named, lambda n: n["name"]), "|"), F.lit(r")(?!\p{L})"))
            return F.when(F.size(named) > 0, let(names, lambda pattern: F.struct(pattern.alias("pattern"), all_of(pattern, named).alias("found")))).otherwise(F.struct(F.lit(ANY).alias("pattern"), found.alias("found")))

        return let(_named(found), wider)

    return F.when(text.rlike(HINT), let(all_of(F.lit(ANY)), with_names))


def entities(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct (kind, form) of all texts; the domain of an address is one too."""
    found = df.select(F.explode(mentions(F.col(text_col))["found"]).alias("m")).select("m.kind", "m.form").distinct()
    domain = F.struct(F.lit("domain").alias("kind"), F.substring_index("form", "@", -1).alias("form"))
    both = F.when(F.col("kind") == "email", F.array(F.struct("kind", "form"), domain)).otherwise(F.array(F.struct("kind", "form")))
    return found.select(F.explode(both).alias("e")).select("e.kind", "e.form").distinct()


def _settled(known: DataFrame, of: Callable[[Column], Column]) -> DataFrame:
    """(kind, form, attempt) of (kind, form, domain): all attempts, such that no two surrogates, which are of(attempt), are the same and none is real."""
    made = known.withColumn("attempt", F.lit(0))
    made = made.withColumn("made", of(F.col("attempt")))
    real = known.select(F.col("kind").alias("real_kind"), F.when(F.col("kind") == "name", F.substring("form", F.lit(3), F.length("form"))).otherwise(F.col("form")).alias("real_form")).distinct()
    for _ in range(MAX_ATTEMPTS):
        first = made.groupBy("kind", "made").agg(F.min("form").alias("first"), F.count("*").alias("n")).filter("n > 1")
        double = made.join(first, ["kind", "made"]).filter("form > first").select("kind", "form")
        taken = made.join(real, (F.col("kind") == F.col("real_kind")) & (F.col("made") == F.col("real_form")), "left_semi").select("kind", "form")
        again = written(double.unionByName(taken).distinct().withColumn("again", F.lit(1)), "pii-collisions")
        if again.isEmpty():
            discard(again)
            return made.select("kind", "form", "attempt")
        made = made.join(again, ["kind", "form"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0)))
        made = written(made.select("kind", "form", "domain", "attempt", of(F.col("attempt")).alias("made")), "pii-surrogates")
    raise RuntimeError("two entities still share a surrogate: a kind has more entities than surrogates")


def later_attempts(known: DataFrame, key: str) -> DataFrame:
    """(kind, form, attempt) of the entities whose first surrogate collides. known is a written table."""
    form = F.col("form")
    domains = written(_settled(known.filter("kind = 'domain'").withColumn("domain", F.lit("")), lambda n: _domain(form, n.cast("string"), key)), "pii-domains")
    of = domains.select(form.alias("of"), _domain(form, F.col("attempt").cast("string"), key).alias("domain"))
    rest = known.filter("kind != 'domain'").join(of, (F.col("kind") == "email") & (F.substring_index("form", "@", -1) == F.col("of")), "left")
    rest = written(rest.select("kind", "form", F.coalesce("domain", F.lit("")).alias("domain")), "pii-known")
    settled = _settled(rest, lambda n: surrogate(F.col("kind"), form, n, key, F.col("domain")))
    return written(settled.unionByName(domains).filter("attempt > 0"), "pii-later")


def _rebuilt(text: Column, pattern: Column, found: Column, attempt_of: Callable[[Column, Column], Column], key: str) -> Column:
    """text with each mention found replaced."""
    def new(m: Column) -> Column:
        name = F.substring_index(m["form"], "@", -1)
        domain = F.when(m["kind"] == "email", _domain(name, attempt_of(F.lit("domain"), name).cast("string"), key))
        return let(surrogate(m["kind"], m["form"], attempt_of(m["kind"], m["form"]), key, domain), lambda made: rendered(m["mention"], m["kind"], made))

    # split with the same pattern gives the text between the mentions, one part more than there are mentions.
    parts = F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("m")), lambda x: F.concat(x["gap"], F.when(x["m"].isNotNull(), new(x["m"])).otherwise("")))
    return F.array_join(parts, "")


def _entity_key(kind: Column, form: Column) -> Column:
    return F.concat_ws(":", kind, form)


def _number(found: Column, kind: str) -> Column:
    return F.coalesce(F.size(F.filter(found, lambda m: m["kind"] == kind)), F.lit(0)).cast("long")


def replace(df: DataFrame, text_col: str = "text", key: str = "tidewater", found_col: str = "pii") -> DataFrame:
    """df with all mentions in its texts replaced, and found_col: how many of each kind a text had. Other columns stay.

    key makes the surrogates; who has it can compute them for guessed originals, so production passes a secret.
    """
    spark = df.sparkSession
    known = written(entities(df, text_col), "pii-entities")
    later = later_attempts(known, key)
    names = [c for c in df.columns if c != text_col]
    work = df.select(F.col(text_col).alias("__text"), F.struct(*(df[c] for c in names)).alias("__row") if names else F.lit(None).alias("__row"))
    work = work.withColumn("__found", mentions(F.col("__text")))
    few = later.limit(BROADCAST_ENTITIES + 1).count() <= BROADCAST_ENTITIES
    if few:
        table = {f"{r.kind}:{r.form}": r.attempt for r in later.collect()}
        if table:
            attempts = F.map_from_arrays(F.lit(list(table)), F.lit(list(table.values())))
            attempt_of = lambda kind, form: F.coalesce(F.element_at(attempts, _entity_key(kind, form)), F.lit(0))
        else:
            attempt_of = lambda kind, form: F.lit(0)
    else:
        # Too many to go along: rows get an id in a written table, their own attempts are joined and come back as a map.
        path = scratch_path(spark, "pii-rows")
        work.drop("__found").withColumn("__id", F.monotonically_increasing_id()).write.parquet(path)
        work = spark.read.parquet(path).withColumn("__found", mentions(F.col("__text")))
        own = work.select("__id", F.explode("__found.found").alias("m")).select("__id", "m.kind", "m.form")
        own = own.unionByName(own.filter("kind = 'email'").select("__id", F.lit("domain").alias("kind"), F.substring_index("form", "@", -1).alias("form"))).distinct().join(later, ["kind", "form"])
        own = own.groupBy("__id").agg(F.map_from_entries(F.collect_list(F.struct(_entity_key(F.col("kind"), F.col("form")), "attempt"))).alias("__attempts"))
        work = work.join(own, "__id", "left")
        attempt_of = lambda kind, form: F.coalesce(F.element_at(F.col("__attempts"), _entity_key(kind, form)), F.lit(0))
    found = F.col("__found")["found"]
    new = F.when(F.size(found) > 0, _rebuilt(F.col("__text"), F.col("__found")["pattern"], found, attempt_of, key)).otherwise(F.col("__text"))
    numbers = F.struct(*(_number(found, k).alias(k) for k in KINDS))
    return work.select(*(new.alias(text_col) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in df.columns), numbers.alias(found_col))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents with surrogates for the personal data in it."""
    done = replace(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "text", *(F.col(f"pii.{k}").alias(f"n_{k}") for k in KINDS))

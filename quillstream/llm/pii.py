"""Personal data replaced by surrogates: keyed, of the same type, format, script and gender, distinct and coreferent.

Entities: e-mail addresses, IPv4 addresses, phone numbers, card and account numbers, social-security numbers, IBANs, and persons.
A person is named after a title, by a known given name with a family name, or after words that announce one ("my name is",
"Dear", "signed"). What a document calls its persons is then looked for in all of it: bare mentions, with another given name
before a family name, and two capitalised words after "and", "met" and the like. Everything is column expressions over the text.

Numbers go through a keyed Feistel permutation of their digits (an IPv4 address of its 32 bits), so two numbers never share a
surrogate and one number has the same wherever and however it is written; separators, country codes and the validity of a
card's check digit stay. Known given names go through a keyed permutation of the list of their script and gender. E-mail
addresses, family names and other given names get a hash-made surrogate of the same shape, which may collide: all that the
corpus holds are compared, those that share a surrogate with another or equal a real value (all but the first) are made anew
until none collides, and the few changed ones are joined to the documents that name them.

The key is the caller's secret: with it the digits' permutation can be undone, without it not.

Defined results: a null text stays null, an empty one empty; texts without entities stay as they are; repeated rows get
the same surrogates, whatever their ids, which are not looked at; an empty table gives an empty result; all other columns,
whatever their names, are passed through `replace`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.common import cut, fresh, let

#: The setting that holds the secret of the registered queries, and what stands in for it where it is unset, as in tests.
KEY_SETTING, NO_SECRET = "spark.quillstream.surrogates.key", "not a secret"
ROUNDS = 6
#: Rows of changed surrogates up to which they are broadcast.
BROADCAST_ROWS = 200_000

# Given names by script and gender, and titles by gender.
GIVEN = {
    ("latin", "f"): "Alice Anna Barbara Carmen Charlotte Claire Elena Elizabeth Emma Greta Hannah Ingrid Isabel Jennifer Julia Laura Lucia Maria Marie Mary Patricia Sarah Sophie Susan".split(),
    ("latin", "m"): "Antonio Carlos Charles Daniel David Fritz Hans Henri Jacques James Jean Johann John Juan Karl Louis Michael Miguel Pablo Paul Peter Pierre Robert Thomas".split(),
    ("cyrillic", "f"): "Анна Екатерина Елена Ирина Мария Наталья Ольга Татьяна".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Владимир Дмитрий Иван Михаил Сергей".split(),
    ("greek", "f"): "Αικατερίνη Ελένη Ιωάννα Μαρία".split(),
    ("greek", "m"): "Γεώργιος Δημήτριος Ιωάννης Νικόλαος".split(),
}
TITLES_F = "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra".split()
TITLES_M = "Mr Herr Monsieur Señor Sr".split()
TITLES_X = "Dr Prof".split()
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
RANGES = {"cyrillic": r"Ѐ-ӿ", "greek": r"Ͱ-Ͽ"}

# What announces a name, what joins one person to another, and capitalised words that are no names.
CUES = ["[Mm]y name is", "I am called", "[Nn]ame:", "[Cc]ontact:", "[Aa]ttn:?", "Dear", "Hi", "Hello", "[Ss]igned,?", "[Ss]incerely,", "[Rr]egards,", "[Pp]atient:?", "[Cc]ustomer:?", "[Cc]lient:?", "[Ww]ritten by", "[Aa]uthor:"]
JOINS = "and met knows told asked with married called und y et".split()
NO_NAMES = """A After Ask Attn Author Client Contact Dear Hello Hi Name Patient Regards Signed Sincerely Thanks Written Mr Mrs Ms Miss Dr Prof Herr Frau All Also An And As At Because Before But By Can Colleague Colleagues Come Customer Did Do Don Each Even Every
For Friday Friend Friends From Had Has Have He Her Here His How I If In Is It Its Ladies Last Later Let Madam May Monday My New
No Not Now Of On One Only Or Other Our Reader Readers Said Saturday She Since Sir Sirs So Some Such Sunday Team Than That The
Their Then There These They This Those Though Thursday To Today Tuesday Under Until Was We Wednesday Were What When Where Which
While Who Why Will With Yes Yet You Your""".split()

_ALL_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
_TITLE = "|".join([*TITLES_F, *TITLES_M, *TITLES_X])
_NAME = r"\p{Lu}\p{L}*+(?:['’-](?!s\b)\p{L}++)*+"
_REAL = rf"(?!(?:{'|'.join(NO_NAMES)})\b){_NAME}"
_CUE = rf"(?<=\b(?:{'|'.join(c.replace('?', '{0,1}') for c in CUES)}) )"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
IP = r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)(?!\p{L})"
PHONE = r"(?<![\p{L}\p{N}])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\p{L}\p{N}])"
SSN = r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])"
CARD = r"(?<![\p{L}\p{N}])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
PERSON = rf"\b(?=\p{{Lu}})(?:(?:{_TITLE})\.? {_NAME}(?: {_NAME})?|(?:{_ALL_GIVEN}) {_NAME})"
#: A name after words that announce it; looked for only in texts that have such words, for looking back is dear.
ANNOUNCED = rf"{_CUE}(?:{_REAL})(?: {_REAL}){{0,2}}"
ENTITY = "(?U)" + "|".join((EMAIL, IP, SSN, PHONE, CARD, IBAN, PERSON))
ENTITY_OR_ANNOUNCED = f"{ENTITY}|{ANNOUNCED}"
#: What every entity holds: cheap to look for.
_CUE_HINT = rf"\b(?:{'|'.join(CUES)}) \p{{Lu}}"
_PERSON_HINT = rf"\b(?=\p{{Lu}})(?:(?:{_TITLE})\.? \p{{Lu}}|(?:{_ALL_GIVEN}) \p{{Lu}})|{_CUE_HINT}"
HINT = rf"[0-9@]|{_PERSON_HINT}"
#: What follows ENTITY where a document names persons: their names, each between quotation marks of the pattern.
_MORE = rf"|(?<=\b(?:{'|'.join(JOINS)}) ){_REAL} {_REAL}|(?<![\p{{L}}\p{{N}}])(?:{_REAL} )?(?:"
_MORE_END = r")(?![\p{L}\p{N}])"


def _sha(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def _number(hexes: Column, digits: int = 15) -> Column:
    return F.conv(F.substring(hexes, 1, digits), 16, 10).cast("decimal(38,0)")


def permuted_digits(s: Column, key: str, kind: str) -> Column:
    """A keyed bijection of the digit strings of a length: halves are changed in turn by what the other hashes to."""

    def turn(x: Column, y: Column, r: Column) -> Column:
        size = F.rpad(F.lit("1"), F.length(x) + 1, F.lit("0")).cast("decimal(38,0)")
        total = (x.cast("decimal(38,0)") + _number(_sha(key, kind, r, F.length(x), y))).cast("decimal(38,0)")
        return F.lpad(F.pmod(total, size).cast("decimal(38,0)").cast("string"), F.length(x), F.lit("0"))

    def step(a: Column, r: Column) -> Column:
        return F.when(r % 2 == 0, F.struct(turn(a["l"], a["r"], r).alias("l"), a["r"].alias("r"))).otherwise(F.struct(a["l"].alias("l"), turn(a["r"], a["l"], r).alias("r")))

    half = (F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), half).alias("l"), F.substring(s, half + 1, F.length(s)).alias("r"))
    long = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda a: F.concat(a["l"], a["r"]))
    return F.when(F.length(s) < 2, s).otherwise(long)


def luhn(s: Column) -> Column:
    """The check digit that belongs after s."""
    n = F.length(s)
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    parts = F.transform(F.sequence(F.lit(1), n), lambda i: let(F.substring(s, i, F.lit(1)).cast("int"), lambda d: F.when((n - i) % 2 == 0, twice(d)).otherwise(d)))
    return F.pmod(10 - F.pmod(F.aggregate(parts, F.lit(0), lambda a, x: a + x), F.lit(10)), F.lit(10))


def only_digits(e: Column) -> Column:
    return F.regexp_replace(e, "[^0-9]", "")


def refill(e: Column, digits: Column) -> Column:
    """e with its digits, in order, replaced by others."""
    place = lambda i: F.length(only_digits(F.substring(e, F.lit(1), i)))
    put = F.transform(F.sequence(F.lit(1), F.length(e)), lambda i: let(F.substring(e, i, F.lit(1)), lambda c: F.when(c.rlike("[0-9]"), F.substring(digits, place(i), F.lit(1))).otherwise(c)))
    return F.array_join(put, "")


def _phone(e: Column, key: str) -> Column:
    code = F.regexp_extract(e, r"^\+(\d{1,3})(?=[ .(-])", 1)
    return let(F.struct(code.alias("c"), only_digits(e).alias("d")), lambda x: refill(e, F.concat(x["c"], permuted_digits(F.substring(x["d"], F.length(x["c"]) + 1, F.length(x["d"])), key, "phone"))))


def _card(e: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        body = F.substring(d, F.lit(1), F.length(d) - 1)
        off = F.substring(d, F.length(d), F.lit(1)).cast("int") - luhn(body)
        return let(permuted_digits(body, key, "card"), lambda b: refill(e, F.concat(b, F.pmod(luhn(b) + off, F.lit(10)).cast("string"))))

    return let(only_digits(e), made)


def _ip(e: Column, key: str) -> Column:
    o = F.transform(F.split(e, r"\."), lambda x: x.cast("int"))
    start = let(o, lambda o: F.struct((F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1))).alias("l"), (F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3))).alias("r")))
    mixed = lambda x, y, r: x.bitwiseXOR(_number(_sha(key, "ip", r, y), 4).cast("int"))
    step = lambda a, r: F.when(r % 2 == 0, F.struct(mixed(a["l"], a["r"], r).alias("l"), a["r"].alias("r"))).otherwise(F.struct(a["l"].alias("l"), mixed(a["r"], a["l"], r).alias("r")))
    show = lambda a: F.concat_ws(".", *[x.cast("int").cast("string") for h in ("l", "r") for x in (F.shiftright(a[h], 8), a[h].bitwiseAND(F.lit(255)))])
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, show)


def _shape(e: Column, seed: Column) -> Column:
    """A string of e's shape: letters for letters of the same script and case, digits for digits, by the seed's hash."""
    n = F.length(e)
    byte = lambda h, i: F.conv(F.substring(h, 2 * F.pmod(i - 1, F.lit(32)) + 1, F.lit(2)), 16, 10).cast("int")

    def made(i: Column) -> Column:
        def put(x: Column) -> Column:
            c, b = x["c"], x["b"]
            letter = lambda s: F.substring(F.lit(LETTERS[s]), b % len(LETTERS[s]) + 1, F.lit(1))
            new = F.when(c.rlike(rf"[{RANGES['cyrillic']}]"), letter("cyrillic")).when(c.rlike(rf"[{RANGES['greek']}]"), letter("greek")).otherwise(letter("latin"))
            return F.when(c.rlike("[0-9]"), (b % 10).cast("string")).when(c.rlike(r"\p{Lu}"), F.upper(new)).when(c.rlike(r"\p{L}"), new).otherwise(c)

        return let(F.struct(F.substring(e, i, F.lit(1)).alias("c"), byte(_sha(seed, ((i - 1) / 32).cast("int")), i).alias("b")), put)

    return F.when(n == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), n), made), ""))


def made_anew(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The hash-made surrogate of a canonical (lower-case) e-mail address, family or given name; later attempts are longer."""
    more = F.repeat(F.lit("a"), F.greatest(F.lit(0), attempt - 3))
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    labels = F.regexp_extract(domain, r"^(.*)(\.[^.]+)$", 1)
    kept = domain.rlike(r"(^|\.)example\.(com|net|org)$")
    new_domain = F.when(kept, domain).otherwise(F.concat(_shape(labels, _sha(key, "domain", domain)), F.regexp_extract(domain, r"^(.*)(\.[^.]+)$", 2)))
    email = F.concat(_shape(F.concat(local, more), _sha(key, "email", canon, attempt)), F.lit("@"), new_domain)
    return F.when(kind == "email", email).otherwise(_shape(F.concat(canon, more), _sha(key, kind, canon, attempt)))


def _given_map(key: str) -> Column:
    """Known given name (lower case) to the next in its list's keyed order: a permutation without fixed points."""
    import hashlib

    pairs = []
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}:{n}".encode()).hexdigest())
        pairs += [F.lit(x) for a, b in zip(order, order[1:] + order[:1]) for x in (a.lower(), b.lower())]
    return F.create_map(*pairs)


def _cased(new: Column, like: Column) -> Column:
    """new with the case of `like`: all capitals, a capital first, or as it is."""
    return F.when((F.length(like) > 1) & (F.upper(like) == like) & like.rlike(r"\p{L}"), F.upper(new)).when(like.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(new, F.lit(1), F.lit(1))), F.substring(new, F.lit(2), F.length(new)))).otherwise(new)


def kind_of(e: Column) -> Column:
    whole = lambda p: e.rlike(f"(?U)^(?:{p})$")
    return F.when(F.instr(e, "@") > 0, F.lit("email")).when(whole(IP), F.lit("ip")).when(whole(SSN), F.lit("ssn")).when(whole(PHONE), F.lit("phone")).when(whole(CARD), F.lit("card")).when(whole(IBAN), F.lit("iban")).otherwise(F.lit("person"))


def _name_parts(e: Column) -> Column:
    """The parts of a person entity with what they are: title, known (given name) or name."""
    w = F.split(e, " ")
    title = F.get(w, F.lit(0)).rlike(rf"^(?:{_TITLE})\.?$")
    known = lambda x: x.rlike(rf"^(?:{_ALL_GIVEN})$")
    kind = lambda x, i: F.when((i == 0) & title, F.lit("title")).when(known(x), F.lit("known")).otherwise(F.lit("name"))
    return F.transform(w, lambda x, i: F.struct(x.alias("w"), kind(x, i).alias("k")))


_PAIRS = "array<struct<kind:string,canon:string>>"


def checked_values(entities: Column) -> Column:
    """(kind, canon) of all that gets a hash-made surrogate, of an array of entities."""
    one = lambda k, c: F.array(F.struct(k.alias("kind"), c.alias("canon")))
    pair = lambda p: F.struct(p["k"].alias("kind"), F.lower(p["w"]).alias("canon"))
    parts = lambda e: F.transform(F.filter(_name_parts(e), lambda p: p["k"] == "name"), pair)
    values = lambda e: F.when(F.instr(e, "@") > 0, one(F.lit("email"), F.lower(e))).when(kind_of(e) == "person", parts(e)).otherwise(F.array().cast(_PAIRS))
    return F.flatten(F.transform(entities, values))


def surrogate(e: Column, changed: Column, key: str) -> Column:
    """changed: map from "kind:canon" to the surrogate of those that collided at first, or null."""
    fixed = lambda k, c: F.coalesce(F.get(changed, F.lit(0)).getItem(F.concat(k, F.lit(":"), c)), made_anew(k, c, F.lit(0), key))
    part = lambda p: F.when(p["k"] == "title", p["w"]).when(p["k"] == "known", _cased(F.element_at(_given_map(key), F.lower(p["w"])), p["w"])).otherwise(_cased(fixed(p["k"], F.lower(p["w"])), p["w"]))
    person = F.array_join(F.transform(_name_parts(e), part), " ")
    iban = F.concat(F.substring(e, 1, 2), let(F.substring(e, F.lit(3), F.length(e)), lambda x: refill(x, permuted_digits(only_digits(x), key, "iban"))))
    return let(kind_of(e), lambda k: F.when(k == "email", _cased(fixed(F.lit("email"), F.lower(e)), F.substring_index(e, "@", 1))).when(k == "ip", _ip(e, key)).when(k == "ssn", refill(e, permuted_digits(only_digits(e), key, "ssn"))).when(k == "phone", _phone(e, key)).when(k == "card", _card(e, key)).when(k == "iban", iban).otherwise(person))


def entities(text: Column) -> Column:
    """Struct of the text's entities `e`, in order, and the pattern `p` that finds them (null: ENTITY alone)."""
    find = lambda p: F.regexp_extract_all(text, p if isinstance(p, Column) else F.lit(p), F.lit(0))

    def with_names(first: Column, announced: Column) -> Column:
        persons = F.filter(first, lambda e: kind_of(e) == "person")
        parts = F.filter(F.flatten(F.transform(persons, _name_parts)), lambda p: (p["k"] != "title") & (F.length(p["w"]) > 1))
        quoted = lambda n: F.array_join(F.transform(n, lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))), "|")
        pattern = lambda n: F.when(F.size(n) > 0, F.concat(F.lit(ENTITY_OR_ANNOUNCED + _MORE), quoted(n), F.lit(_MORE_END))).when(announced, F.lit(ENTITY_OR_ANNOUNCED))
        return let(F.array_distinct(F.transform(parts, lambda p: p["w"])), pattern)

    def found(x: Column) -> Column:
        again = lambda p: F.struct(F.when(p.isNull(), x["first"]).otherwise(find(p)).alias("e"), p.alias("p"))
        return let(F.when(x["person"], with_names(x["first"], x["announced"])), again)

    def first(x: Column) -> Column:
        some = F.when(x["announced"], find(ENTITY_OR_ANNOUNCED)).otherwise(find(ENTITY))
        return let(F.struct(some.alias("first"), x["person"].alias("person"), x["announced"].alias("announced")), found)

    def hinted() -> Column:
        hints = let(text.rlike(_PERSON_HINT), lambda person: F.struct(person.alias("person"), (person & text.rlike(_CUE_HINT)).alias("announced")))
        return let(hints, first)

    nothing = F.struct(F.array().cast("array<string>").alias("e"), F.lit(None).cast("string").alias("p"))
    return F.when(text.rlike(HINT), hinted()).otherwise(nothing)


def session_key(spark: SparkSession) -> str:
    """The secret in the session's setting; a constant that protects nothing where it is unset."""
    return spark.conf.get(KEY_SETTING, NO_SECRET)


def collisions(values: DataFrame, key: str, max_rounds: int = 30) -> DataFrame:
    """(kind, canon, new) of the distinct values whose first surrogate had to be made anew."""
    new = made_anew(F.col("kind"), F.col("canon"), F.col("attempt"), key)
    state = cut(values.distinct().withColumn("attempt", F.lit(0)).withColumn("new", new))
    for _ in range(max_rounds):
        twins = state.groupBy("kind", "new").agg(F.min(F.struct("attempt", "canon"))["canon"].alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        real = state.select("kind", F.col("canon").alias("new")).distinct()
        bad = state.join(twins, ["kind", "new"]).filter("canon <> first").select("kind", "canon").union(state.join(real, ["kind", "new"], "left_semi").select("kind", "canon"))
        bad = cut(bad.distinct())
        if bad.isEmpty():
            return state.filter("attempt > 0").select("kind", "canon", "new")
        state = cut(state.join(bad.withColumn("again", F.lit(1)), ["kind", "canon"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0))).drop("again", "new").withColumn("new", new))
    raise RuntimeError("collisions: surrogates still collide after max_rounds rounds")


def replace(docs: DataFrame, key: str, text: str = "text", counts: bool = False) -> DataFrame:
    """docs with surrogates, keyed by the caller's secret, in its text column; with counts also n_entities and kinds (of the entities, in order)."""
    own = fresh(docs, "_pii")
    named = docs.select(F.col(text).alias("t")).filter(F.coalesce(F.col("t").rlike(f"@|{_PERSON_HINT}"), F.lit(False)))
    values = named.select(F.xxhash64("t").alias("text_hash"), F.explode_outer(checked_values(entities(F.col("t"))["e"])).alias("v"))
    values = values.select("text_hash", "v.kind", "v.canon").filter("canon is not null")
    changed = cut(collisions(values.select("kind", "canon"), key))
    maps = "map<string,string>"
    # bound by a lambda, so that the optimizer does not put the search for entities into each column that reads it
    once = lambda m: let(F.struct(entities(F.col(text)).alias("f"), m.alias("m")), lambda x: x)
    if changed.isEmpty():
        rows = docs.withColumn(own, once(F.lit(None).cast(maps)))
    else:
        entry = F.struct(F.concat_ws(":", "kind", "canon").alias("k"), F.col("new").alias("v"))
        per = values.distinct().join(changed, ["kind", "canon"]).groupBy("text_hash").agg(F.map_from_entries(F.collect_set(entry)).alias("m"))
        # nullable from here on: lambdas that read the map after the left join keep the type it has now, and most texts have none
        per = per.withColumn("m", F.when(F.size("m") > 0, F.col("m")))
        per = cut(per.select(F.struct("text_hash", "m").alias(fresh(docs, "_map"))))
        known = per[per.columns[0]]
        hashed = F.xxhash64(docs[text])
        joined = lambda rows, side: rows.join(side, hashed == known["text_hash"], "left")
        if per.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            rows = joined(docs, F.broadcast(per))
        else:
            rows = joined(docs, per)
        rows = rows.withColumn(own, once(known["m"]))

    def filled(x: Column) -> Column:
        """The text between entities, with surrogates in their places."""
        f = x["f"]
        changed_here = F.when(x["m"].isNotNull(), F.array(x["m"])).otherwise(F.array().cast(f"array<{maps}>"))
        parts = F.struct(F.split(F.col(text), F.coalesce(f["p"], F.lit(ENTITY)), -1).alias("g"), F.transform(f["e"], lambda e: surrogate(e, changed_here, key)).alias("s"))
        joined = lambda y: F.array_join(F.transform(y["g"], lambda g, i: F.concat(g, F.coalesce(F.get(y["s"], i), F.lit("")))), "")
        return F.when(F.size(f["e"]) > 0, let(parts, joined)).otherwise(F.col(text))

    found_here = F.col(f"{own}.f.e")
    out = [let(F.col(own), filled).alias(c) if c == text else docs[c] for c in docs.columns]
    extra = [F.size(found_here).cast("long").alias("n_entities"), F.array_join(F.transform(found_here, kind_of), ",").alias("kinds")] if counts else []
    return rows.select(*out, *extra)

"""Personal data: keyed surrogates of the same type, gender, script and format, distinct and coreferent. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm.common import table, written

#: Titles that announce a name, by gender, and the classes whose characters stand in for one another.
MALE = ["Mr", "Herr", "Señor", "Sr", "Don", "Monsieur", "Господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Doña", "Madame", "Mme", "Госпожа"]
NEUTRAL = ["Dr", "Prof", "Mx", "Доктор"]
CLASSES = ["0123456789", "aeiou", "AEIOU", "bcdfghjklmnpqrstvwxyz", "BCDFGHJKLMNPQRSTVWXYZ", "àáâäåèéêëìíîïòóôöùúûü", "ÀÁÂÄÅÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ", "çñšžćł", "ÇÑŠŽĆŁ", "аеиоуыэюя", "АЕИОУЫЭЮЯ", "бвгджзклмнпрстфхцчшщ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ"]
SYLLABLES = {"latin": ["ba", "ren", "do", "lin", "mar", "to", "sel", "vi", "kor", "na", "tal", "fe", "ris", "gu", "hel", "mo"], "cyrillic": ["ба", "рен", "до", "лин", "мар", "то", "сел", "ви", "кор", "на", "тал", "фе", "рис", "гу", "хел", "мо"]}
ENDINGS = {("latin", "m"): ["rick", "win", "bert", "nand"], ("latin", "f"): ["lia", "nora", "wina", "rette"], ("latin", "u"): ["ley", "lin", "ris", "quin"], ("latin", "last"): ["man", "well", "ford", "stein"], ("cyrillic", "m"): ["слав", "мир", "тин", "дей"], ("cyrillic", "f"): ["слава", "мира", "тина", "лия"], ("cyrillic", "u"): ["ша", "ня", "ка", "ра"], ("cyrillic", "last"): ["енко", "ич", "ук", "ян"]}
TLDS = ["com", "org", "net"]
#: Words within a name that stay, and letters (and digits) for those of an email that are in no class, by what they match.
PARTICLES = ["de", "del", "da", "do", "dos", "das", "di", "du", "des", "la", "las", "los", "le", "van", "von", "der", "den", "ter", "ten", "zu", "zum", "zur", "vom", "af", "av", "bin", "ibn", "al", "el", "y", "e", "i"]
OTHERS = [(r"\p{IsHan}", "安白陈丁方高何江林马宁潘秦孙王周"), (r"\p{IsHiragana}", "あいかきさしたちなにはひまみらり"), (r"\p{IsKatakana}", "アイカキサシタチナニハヒマミラリ"), (r"\p{IsHangul}", "가나다라마바사아자차카타파하고노"), (r"\p{IsGreek}", "αβγδεζηθικλμνξοπ"), (r"\p{IsCyrillic}", "абвгдежзиклмнопр"), (r"\p{IsArabic}", "ابتثجحدرسشصعفقكل"), (r"\p{IsHebrew}", "אבגדהוזחטיכלמנסע"), (r"\p{IsDevanagari}", "कखगघचछजटडतदनपबमर"), (r"\p{IsThai}", "กขคจชดตทนบปผพมยร"), (r"\p{L}", "bcdfghklmnprstvz"), (r"\p{N}", "0123456789")]

_TITLE = rf"(?:{'|'.join(MALE + FEMALE + NEUTRAL)})"
_MORE = rf"(?:{'|'.join(NEUTRAL)})"
_PARTICLE = rf"(?:{'|'.join(PARTICLES)})"
_WORD = rf"(?!{_MORE}(?!\p{{L}}))\p{{Lu}}[\p{{L}}'’-]{{1,40}}+"
_NAME = rf"(?<![\p{{L}}\p{{N}}]){_TITLE}\.?\x20(?:{_MORE}\.?\x20)*(?:{_PARTICLE}\x20)*{_WORD}(?:\x20(?:{_PARTICLE}\x20)*{_WORD})*"
_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP = rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.\d)"
_CARD = r"(?<![\p{L}\p{N}._-])\d{4}(?:\d{9,15}|(?:[\x20-]\d{4}){2}[\x20-]\d{1,7})(?![\p{L}\p{N}]|[.-]\d)"
_PHONE = r"(?<![\p{L}\p{N}._+-])(?:\+\d{1,3}[\x20.-]?)?(?:\(\d{2,4}\)[\x20.-]?|\d{2,4}[.-])\d{3,4}[\x20.-]\d{3,4}(?![\p{L}\p{N}]|[.-]\d)|(?<![\p{L}\p{N}._+-])\+\d{1,3}(?:\x20\d{2,4}){2,4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}._+-])(?:\+\d{1,3}[\x20.-]?\d{6,12}|(?<!\d\x20)\d{3}\x20\d{3}\x20\d{4}(?!\x20\d))(?![\p{L}\p{N}]|[.-]\d)"
#: Country codes, where nothing parts them from the number.
_COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_HEX = "[0-9A-Fa-f]{1,4}"
#: IPv6: eight groups, or fewer around "::"; a digit somewhere.
_IP6 = rf"(?<![\p{{L}}\p{{N}}:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![\p{{L}}\p{{N}}:]|\.\d)"
ENTITY = f"{_NAME}|{_EMAIL}|{_IP6}|{_IP}|{_CARD}|{_PHONE}"
#: What a text with an entity has for sure: a digit or @, or a title before a capital.
_HINT = rf"[0-9@]|{_TITLE}\.?\x20(?:{_PARTICLE}\x20)*\p{{Lu}}"
#: Up to so many entities with another than their first surrogate go to the executors as one map; more are joined.
MAP_ROWS = 10_000


def let(value: Column, use) -> Column:
    """use(value) with the value computed once and the expression held once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _byte(h: Column, i: Column | int) -> Column:
    """The i-th of 31 numbers below 256 in a hex digest."""
    return F.conv(F.substring(h, F.lit(1) + (F.lit(i) if isinstance(i, int) else i) % 31 * 2, F.lit(2)), 16, 10).cast("int")


def _pick(h: Column, i: int, of: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, of)), _byte(h, i) % len(of))


def _alike(s: Column, h: Column) -> Column:
    """Every character replaced by a keyed one of its class; others stay."""

    def one(c: Column, i: Column) -> Column:
        out = F.when(c == "", "")
        for cls in CLASSES:
            out = out.when(F.instr(F.lit(cls), c) > 0, F.substring(F.lit(cls), F.lit(1) + _byte(h, i) % len(cls), F.lit(1)))
        for match, letters in OTHERS:
            out = out.when(c.rlike(match), F.substring(F.lit(letters), F.lit(1) + _byte(h, i) % len(letters), F.lit(1)))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(s, ""), one), "")


def _luhn(digits: Column, shift: int) -> Column:
    """The Luhn sum modulo 10 of a string of digits that `shift` more would follow."""
    at = lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
    double = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + F.when((i + shift) % 2 == 0, double(at(i))).otherwise(at(i))) % 10


def _refill(raw: Column, digits: Column) -> Column:
    """raw with its digits replaced in turn by those given."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))
    step = lambda a, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(a["s"], F.substring(digits, a["k"], F.lit(1))).alias("s"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k")))
    return F.aggregate(F.split(raw, ""), start, step)["s"]


def _digits(raw: Column) -> Column:
    return F.regexp_replace(raw, r"[^0-9]", "")


def kind(raw: Column) -> Column:
    """email, ip, ip6, card, phone or name; null for a number that is no card (its check digit or issuer is wrong)."""
    issuer = r"^(?:4|5[1-5]|3[47]|6011|64[4-9]|65|35|2(?:2[3-9]|[3-6]\d|7[01])|222[1-9]|2720)"
    card = let(_digits(raw), lambda d: F.when((_luhn(d, 0) == 0) & d.rlike(issuer) & F.length(d).between(13, 19), "card"))
    return (
        F.when(F.instr(raw, "@") > 0, "email")
        .when(raw.rlike(f"^{_OCTET}(?:\\.{_OCTET}){{3}}$"), "ip")
        .when(raw.rlike("^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), "ip6")
        .when(raw.rlike(r"^\d{13,19}$|^\d{4}[\x20-]\d{4}[\x20-]\d{4}[\x20-]\d+$"), card)
        .when(raw.rlike(r"^[+(\d]"), "phone")
        .otherwise("name")
    )


def _gender(raw: Column) -> Column:
    said = lambda titles: raw.rlike(rf"^(?:{'|'.join(titles)})\.?\x20")
    return F.when(said(MALE), "m").when(said(FEMALE), "f").otherwise("u")


def _stays(token: Column) -> Column:
    """Whether a word after a name's title is a further title or a particle."""
    return token.rlike(rf"^(?:{_MORE}\.?|{_PARTICLE})$")


def _said(tokens: Column) -> Column:
    """A name's own words: without its title, further ones and particles."""
    rest = F.when(F.size(tokens) > 1, F.slice(tokens, 2, F.size(tokens))).otherwise(tokens)
    return F.filter(rest, lambda t: ~_stays(t))


def own_names(text: Column) -> Column:
    """struct<last, first>: the family and given names, each array<string>, that the text has with a title."""

    def parts(name: Column) -> Column:
        last = lambda w: F.when(F.size(w) > 1, F.slice(w, 2, F.size(w))).otherwise(w)
        first = lambda w: F.when(F.size(w) > 1, F.slice(w, 1, 1)).otherwise(F.array().cast("array<string>"))
        return let(_said(F.split(name, " ")), lambda w: F.struct(last(w).alias("last"), first(w).alias("first")))

    found = F.transform(F.regexp_extract_all(text, F.lit(_NAME), F.lit(0)), parts)
    both = lambda x: {k: F.array_distinct(F.flatten(F.transform(x, lambda n: n[k]))) for k in ("last", "first")}
    return let(found, lambda x: F.struct(both(x)["last"].alias("last"), F.array_except(both(x)["first"], both(x)["last"]).alias("first")))


def pattern(own: Column) -> Column:
    """ENTITY, and a text's own names (see own_names()) wherever they stand alone, also in capitals; family names also with one capital."""
    cases = lambda a, *forms: F.flatten(F.transform(a, lambda w: F.array(w, *[f(w) for f in forms])))
    words = F.array_distinct(F.concat(cases(own["last"], F.upper, F.initcap), cases(own["first"], F.upper)))
    alone = lambda w: F.concat(F.lit(ENTITY + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(w, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return let(words, lambda w: F.when(F.size(w) == 0, F.lit(ENTITY)).otherwise(alone(w)))


def entities(text: Column, own: Column) -> Column:
    """array<struct<raw, kind, parts array<struct<type, canon, gender>>>> of a text's entities, in order; own: its own_names().

    parts is what is replaced. Of a titled name's words the last is a family name; the first of several is a given name, of the title's
    gender here, those between count as family names (no list of names tells 'Maria' from 'García'), and particles stay. A
    word alone is a given name if the text has it as such and not as a family name.
    """
    kinds = F.transform(F.regexp_extract_all(text, pattern(own), F.lit(0)), lambda r: F.struct(r.alias("raw"), kind(r).alias("kind")))
    parts = lambda x: _parts(x["raw"], x["kind"], own["first"])
    return F.transform(kinds, lambda x: F.struct(x["raw"].alias("raw"), x["kind"].alias("kind"), parts(x).alias("parts")))


def _country(raw: Column) -> Column:
    """The country code's digits, or nothing."""
    return F.when(raw.rlike(r"^\+\d{1,3}[^0-9]"), F.regexp_extract(raw, r"^\+(\d{1,3})(?=[^0-9])", 1)).otherwise(F.regexp_extract(raw, _COUNTRY, 1))


def _parts(raw: Column, k: Column, given: Column) -> Column:
    def part(t, c: Column, gender: Column | None = None) -> Column:
        t = F.lit(t) if isinstance(t, str) else t
        return F.struct(t.alias("type"), c.alias("canon"), (F.lit("") if gender is None else gender).alias("gender"))

    def word(w: Column, i: Column, said: Column) -> Column:
        alone = (F.size(said) == 1) & ~raw.contains(" ") & F.exists(given, lambda g: F.lower(g) == F.lower(w))
        first = ((i == 0) & (F.size(said) > 1)) | alone
        return part(F.when(first, "first").otherwise("last"), F.lower(w), F.when(first, _gender(raw)).otherwise(""))

    names = let(_said(F.split(raw, " ")), lambda said: F.transform(said, lambda w, i: word(w, i, said)))
    return (
        F.when(k == "email", F.array(part("email", F.lower(raw))))
        .when(k == "ip", F.array(part("ip", raw)))
        .when(k == "ip6", F.array(part("ip6", F.lower(raw))))
        .when(k == "card", F.array(part("card", _digits(raw))))
        .when(k == "phone", F.array(part("phone", let(_country(raw), lambda c: F.substring(_digits(raw), F.length(c) + 1, F.lit(40))))))
        .when(k == "name", names)
        .otherwise(F.array().cast("array<struct<type:string,canon:string,gender:string>>"))
    )


def _more(h: Column, attempt: Column, of: list[str]) -> Column:
    """As many keyed pieces as there were attempts before, so that there are always enough surrogates."""
    places = F.slice(F.sequence(F.lit(0), attempt), F.lit(2), attempt)
    return F.array_join(F.transform(places, lambda i: F.get(F.array(*map(F.lit, of)), _byte(h, i + 9) % len(of))), "")


def _name(canon: Column, role: Column, gender: Column, h: Column, attempt: Column) -> Column:
    """A name of two or three syllables and an ending, and one more syllable for each attempt."""

    def made(script: str) -> Column:
        ending = lambda k: _pick(h, 9, ENDINGS[script, k])
        end = F.when(role == "last", ending("last")).when(gender == "m", ending("m")).when(gender == "f", ending("f")).otherwise(ending("u"))
        syllable = lambda i: _pick(h, i, SYLLABLES[script])
        third = F.when(_byte(h, 2) % 2 == 0, syllable(3)).otherwise("")
        return F.concat(syllable(0), syllable(1), third, _more(h, attempt, SYLLABLES[script]), end)

    return F.when(canon.rlike(r"\p{IsCyrillic}"), made("cyrillic")).otherwise(made("latin"))


def surrogate(part: Column, attempt: Column, key: str) -> Column:
    """The canonical surrogate of a part (type, canon, gender), from a keyed digest of its type and canon and the attempt."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), part["type"], part["canon"], attempt.cast("string")), 256)
    seed = F.struct(part["type"].alias("t"), part["canon"].alias("c"), part["gender"].alias("g"), attempt.alias("a"), digest.alias("h"))
    hexes = [f"{x:x}" for x in range(16)]

    def made(x: Column) -> Column:
        t, c, h = x["t"], x["c"], x["h"]
        local, label = F.split(c, "@")[0], F.split(F.split(c, "@")[1], r"\.")[0]
        number = lambda: F.concat(F.substring(c, 1, 1), _alike(F.substring(c, F.lit(2), F.length(c) - 2), h))
        card = let(number(), lambda d: F.concat(d, ((F.lit(10) - _luhn(d, 1)) % 10).cast("string")))
        mail = F.concat(_alike(local, h), _more(h, x["a"], SYLLABLES["latin"]), F.lit("@"), let(F.sha2(h, 256), lambda g: _alike(label, g)))
        groups = F.transform(F.split(c, ""), lambda ch, i: F.when(ch.isin(":", ""), ch).otherwise(F.get(F.array(*map(F.lit, hexes)), _byte(h, i) % 16)))
        return (
            F.when(t == "email", F.concat(mail, F.lit(".example."), _pick(h, 30, TLDS)))
            .when(t == "ip", F.array_join(F.transform(F.array(*map(F.lit, range(4))), lambda i: (F.lit(1) + _byte(h, i) % 254).cast("string")), "."))
            .when(t == "ip6", F.array_join(groups, ""))
            .when(t == "card", card)
            .when(t == "phone", _alike(c, h))
            .otherwise(_name(c, t, x["g"], h, x["a"]))
        )

    return let(seed, made)


def _cased(new: Column, old: Column) -> Column:
    return F.when(old == F.upper(old), F.upper(new)).when(old.rlike(r"^\p{Lu}"), F.initcap(new)).otherwise(new)


#: What is known of a part beyond the text: the attempt, and a given name's gender.
AGAIN = "map<string,struct<attempt:int,gender:string>>"


def replaced(found: Column, again: Column, key: str) -> Column:
    """Entities (see entities()) with their surrogates, in their formats; again: AGAIN by type and canon, of those that need it."""

    def new(p: Column) -> Column:
        known = lambda k: F.struct(p["type"].alias("type"), p["canon"].alias("canon"), F.coalesce(k["gender"], p["gender"]).alias("gender"))
        return let(F.try_element_at(again, F.concat_ws("\x1f", p["type"], p["canon"])), lambda k: surrogate(known(k), F.coalesce(k["attempt"], F.lit(0)), key))

    made = F.transform(found, lambda x: F.struct(x["raw"].alias("raw"), x["kind"].alias("kind"), F.transform(x["parts"], new).alias("new")))

    def filled(x: Column) -> Column:
        raw, k, first = x["raw"], x["kind"], F.get(x["new"], F.lit(0))
        # the surrogates take their words' places in turn
        start = F.struct(F.array().cast("array<string>").alias("s"), F.lit(0).alias("k"))
        put = lambda a, t, more: F.struct(F.concat(a["s"], F.array(t)).alias("s"), (a["k"] + more).alias("k"))
        stays = lambda a, t: (F.size(a["s"]) == 0) & raw.contains(" ") | _stays(t)
        step = lambda a, t: F.when(stays(a, t), put(a, t, 0)).otherwise(put(a, _cased(F.get(x["new"], a["k"]), t), 1))
        name = F.array_join(F.aggregate(F.split(raw, " "), start, step)["s"], " ")
        return (
            F.when(k.isin("email", "ip6"), F.when(raw == F.upper(raw), F.upper(first)).otherwise(first))
            .when(k == "ip", first)
            .when(k == "card", _refill(raw, first))
            .when(k == "phone", _refill(raw, F.concat(_country(raw), first)))
            .when(k == "name", name)
            .otherwise(raw)
        )

    return F.transform(made, filled)


def _attempts(found: DataFrame, key: str, rounds: int = 40) -> DataFrame:
    """The parts (type, canon, attempt, gender) whose first surrogate won't do, as it is another part's too, or stands for someone in the
    corpus; and the given names met with several genders (gender: what titles say of them).

    Of parts with one surrogate, the smallest keeps it. Only parts in conflict change, each to its next attempt, until there are none. Names
    and addresses grow with the attempts, so that there are always enough.
    """
    said = F.min(F.when(F.col("gender") != "u", F.col("gender")))
    known = found.groupBy("type", "canon").agg(F.coalesce(said, F.max("gender")).alias("gender"), (F.min("gender") != F.max("gender")).alias("several"))
    now = written(known.withColumn("attempt", F.lit(0)), "pii-known")
    known = now.select("type", F.col("canon").alias("new"))
    for _ in range(rounds):
        made = written(now.withColumn("new", surrogate(F.struct("type", "canon", "gender"), F.col("attempt"), key)), "pii-surrogates")
        clash = made.groupBy("type", "new").agg(F.count("*").alias("n"), F.min("canon").alias("keeps")).where("n > 1")
        lost = made.join(clash, ["type", "new"]).where("canon <> keeps").select("type", "canon")
        taken = made.join(known, ["type", "new"], "left_semi").select("type", "canon")
        bad = written(lost.unionByName(taken).distinct().withColumn("bad", F.lit(1)), "pii-clashes")
        if not bad.count():
            return made.where("attempt > 0 or several").select("type", "canon", "attempt", "gender")
        now = made.join(bad, ["type", "canon"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("bad", F.lit(0))).drop("bad", "new")
    raise RuntimeError("surrogates still collide")


def _free(name: str, columns: list[str]) -> str:
    """name, with as many underscores before it as no column has."""
    while name.lower() in (c.lower() for c in columns):
        name = f"_{name}"
    return name


def anonymise(docs: DataFrame, key: str = "surrogates") -> DataFrame:
    """docs with their text's emails, phone numbers, payment cards, IP addresses and titled names replaced; the other columns stay.

    Adds n_entities (long; with underscores before it where docs has that name). A part has one surrogate in the whole table (coreference, also
    across formats and cases, titles, and phone numbers with and without a country code), no two parts of a type share one
    (distinctness), and none is a part that the table itself holds. Null and empty texts stay as they are; repeated rows are replaced alike; an
    empty table gives no rows. A text column is needed; all others pass through, whatever their names.
    """
    columns, text = docs.columns, F.col("text")
    count, own, mine, again_, sha = (_free(n, columns) for n in ("n_entities", "__own", "__mine", "__again", "__sha"))
    hinted = F.coalesce(text.rlike(_HINT), F.lit(False))
    hits = docs.where(hinted).withColumn(own, own_names(text))
    every = F.flatten(F.transform(entities(text, F.col(own)), lambda x: x["parts"]))
    parts = hits.select(F.explode(every).alias("p")).select("p.type", "p.canon", "p.gender").distinct()
    again = written(_attempts(written(parts, "pii-parts"), key), "pii-again")
    label = F.concat_ws("\x1f", "type", "canon")
    entry = F.struct(label.alias("k"), F.struct("attempt", "gender").alias("v"))
    as_map = F.map_from_entries(F.collect_list(entry)).alias(again_)
    n = again.count()
    if n <= MAP_ROWS:
        hits = hits.crossJoin(F.broadcast(again.agg(as_map))) if n else hits.withColumn(again_, F.create_map().cast(AGAIN))
    else:  # too many for a broadcast: each text's own share of them, joined by the text's digest
        tagged = hits.select(F.sha2(text, 256).alias(sha), F.explode(F.array_distinct(every)).alias("p"))
        tagged = tagged.select(sha, F.col("p.type").alias("type"), F.col("p.canon").alias("canon")).distinct()
        share = tagged.join(again, ["type", "canon"]).groupBy(sha).agg(as_map)
        hits = hits.withColumn(sha, F.sha2(text, 256)).join(share, sha, "left").withColumn(again_, F.coalesce(again_, F.create_map().cast(AGAIN)))
    hits = hits.withColumn(mine, entities(text, F.col(own)))
    pieces = F.split(text, pattern(F.col(own)), -1)
    new = F.array_join(F.zip_with(pieces, replaced(F.col(mine), F.col(again_), key), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    found = F.size(F.filter(mine, lambda x: x["kind"].isNotNull())).cast("long")
    hits = hits.select(*[F.col(f"`{c}`") if c != "text" else new.alias("text") for c in columns], found.alias(count))
    return hits.unionByName(docs.where(~hinted).withColumn(count, F.lit(0).cast("long")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, with surrogates."""
    return anonymise(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")

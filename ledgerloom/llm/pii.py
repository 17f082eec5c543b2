"""PII surrogates, in DataFrame expressions only.

Every entity found gets a replacement of its own type and form, drawn by a keyed hash: phone and card
numbers keep their layout, cards their check digit, addresses stay valid, keys their alphabet and
length, IBANs their check digits, phones their country code, names their gender and script. The same entity gets the same surrogate everywhere, however it is
written; different entities get different ones, and none is the surrogate of a real one: a table of the
distinct entities is checked, and those that collide draw again.

Scale: only entities are shuffled, once per distinct text; texts without any pass straight through, and
the others meet their surrogates in one join by text. Rounds of redrawing work on the entity table alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize
from ledgerloom.llm.names import spread
from ledgerloom.llm.quality import bound

#: First names by script and gender, and last names by script: what names are told by and surrogates are made of.
FIRST = {
    ("latin", "f"): ["Maria", "Emma", "Sophie", "Laura", "Julia", "Charlotte", "Isabella", "Margaret", "Patricia", "Elena", "Lucia", "Camille", "Anna", "Sarah", "Jennifer", "Elizabeth", "Katharina", "Ingrid", "Fatima", "Aisha", "Priya", "Mei", "Yuki", "Chloe", "Carmen", "Pilar", "Francesca", "Giulia", "Hannah", "Rebecca"],
    ("latin", "m"): ["James", "Robert", "Michael", "Thomas", "Lukas", "Pierre", "Antonio", "Carlos", "William", "Matthias", "Julien", "Diego", "John", "David", "Richard", "Joseph", "Daniel", "Andreas", "Stefan", "Ahmed", "Omar", "Mohammed", "Rajesh", "Kenji", "Hiroshi", "Jean", "Luis", "Marco", "Giovanni", "Peter"],
    ("cyrillic", "f"): ["Мария", "Анна", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Светлана"],
    ("cyrillic", "m"): ["Иван", "Алексей", "Дмитрий", "Сергей", "Михаил", "Николай", "Андрей", "Владимир"],
}
LAST = {
    "latin": ["Keller", "Moreau", "Garcia", "Fischer", "Bennett", "Dubois", "Navarro", "Hoffman", "Sullivan", "Lambert", "Vargas", "Brandt", "Whitaker", "Fontaine", "Castillo", "Lindner"],
    "cyrillic": ["Коваленко", "Шевченко", "Бондаренко", "Ткаченко", "Мельник", "Гончар", "Савченко", "Руденко"],
}
#: What longer family names are made of, one for each hex digit.
SYLLABLES = {
    "latin": ["ba", "den", "ko", "lin", "mar", "no", "ral", "sen", "ti", "ver", "wick", "dor", "fel", "gar", "hol", "mi"],
    "cyrillic": ["ба", "ден", "ко", "лин", "мар", "но", "рал", "сен", "ти", "вер", "вик", "дор", "фел", "гар", "хол", "ми"],
}
#: Family names that stand before the given name.
LEADING = ["Wang", "Zhang", "Liu", "Chen", "Yang", "Huang", "Zhao", "Zhou", "Nguyen", "Tanaka", "Suzuki", "Sato"]
#: What stands before a name that no list knows.
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Mme", "Monsieur", "Madame", "Señor", "Señora", "Sr", "Sra"]
#: Country codes of telephone numbers with one and with two digits; all others have three (fixed values).
CODES_1, CODES_2 = "[17]", "2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_GIVEN = [n for names in FIRST.values() for n in names] + LEADING
_TAILS = "|".join(sorted({n[1:] for n in _GIVEN}))
_INITIALS = "".join(sorted({n[0] for n in _GIVEN}))
_TITLE_BEGINS, _TITLE_ENDS = ("".join(sorted({t[k] for t in TITLES})) for k in (0, -1))
#: What stands right before a number or a name that its form does not give away.
CUES = {
    "phone": r"(?i:tel|phone|phone number|telephone|mobile|cell|fax|call|telefon|mobil|téléphone|teléfono)",
    "ssn": r"(?i:ssn|social security|social security number|social security no\.)",
    "name": r"(?:[Nn]ame|NAME|[Nn]ame is|[Ss]igned|[Ss]igned by|[Cc]ontact|[Aa]ttn|[Nn]om|[Nn]ombre)",
}
_PARTICLES = "von|van|de|der|den|la|da|di|del|bin|al"
_WORD = r"\p{Lu}[\p{L}'\-]+"
#: Between given and family name. It is repeated possessively, as backtracking would take stack for each repetition.
_MIDDLE = rf"(?:\p{{Lu}}\.|(?:{_PARTICLES})(?!\p{{L}}))"
#: The rest of a phone number after its area code: in one piece, in two groups, or in groups of two digits.
_REST = r"(?:\d{6,8}|\d{3,4}[ .\-]\d{3,4}|\d{2,3}(?:[ .\-]\d{2}){2,3})"
#: Detectors by type, in order of precedence (Java regular expressions without capturing groups). Each begins
#: with the cheapest test that rules out most places.
DETECTORS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+){0,125}\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z_\-])(?=[0-9A-Za-z_\-]{12})(?=[_\-]*[0-9A-Za-z])(?<=[=:\s\"'])(?<=(?i:token|secret|password|passwd|api_key|apikey)\s{0,2}[=:]\s{0,2}[\"']{0,1})[0-9A-Za-z_\-]{12,}+",
    "key": r"(?=AKIA)(?<![0-9A-Za-z])AKIA[0-9A-Z]{12,20}+(?![0-9A-Za-z])",
    "phone": r"(?=[+(0])(?<![\w+])(?:\+\d{1,3}[ .\-]?(?:\(\d{2,4}\)|\d{2,4})[ .\-]?\d{3,4}[ .\-]?\d{3,4}"
    rf"|\+\d{{1,3}}[ .\-]\(?\d{{1,4}}\)?(?:[ .\-]\d{{2,4}}){{3,5}}|\(\d{{2,5}}\) ?{_REST}|(?<![.,\-])0\d{{1,4}}[ /]{_REST})(?!\d)"
    rf"|(?=[2-9]\d\d[\-.]\d)(?<![\w.+\-])(?:[2-9]\d\d-\d{{3}}-\d{{4}}|[2-9]\d\d\.\d{{3}}\.\d{{4}})(?![\w\-]|\.\d)"
    rf"|(?=\d{{7}})(?<=[\p{{L}}.:] {{0,1}})(?<=(?<!\p{{L}}){CUES['phone']}[.:]{{0,2}} {{0,1}})(?:\d{{7,8}}|\d{{10,11}})(?![\w\-]|[.,]\d)",
    "ipv4": rf"(?=\d)(?<![\w.]){_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}(?!\.?\d)",
    "card": r"(?=\d{4})(?<![\w.])\d{4}(?:\d{9,12}|[ \-]\d{4}[ \-]\d{4}[ \-]\d{4})(?![\d])",
    "ssn": r"(?=\d{3}-)(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
    rf"|(?=\d{{3}} ?\d\d ?\d{{4}})(?<=[\p{{L}}.:#] {{0,1}})(?<=(?<!\p{{L}}){CUES['ssn']}[:#]{{0,1}} {{0,1}})(?:\d{{9}}|\d{{3}} \d\d \d{{4}})(?![\w\-]|[.,]\d)",
    "iban": r"(?=[A-Z]{2}\d)(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "name": rf"(?=[{_INITIALS}])(?<!\p{{L}})(?:{'|'.join(_GIVEN)})(?: {_MIDDLE})*+(?: {_WORD}){{1,2}}(?!\p{{L}})"
    rf"|(?=\p{{Lu}})(?<=[{_TITLE_ENDS}.] )(?<=(?<!\p{{L}})(?:{'|'.join(TITLES)})\.? )(?:\p{{Lu}}\. )*+{_WORD}(?: {_WORD})?(?!\p{{L}})"
    rf"|(?=\p{{Lu}}[\p{{L}}'\-])(?<=[:sy] )(?<=(?<!\p{{L}}){CUES['name']}:{{0,1}} )(?<=(?:: |is |by )){_WORD}(?: {_MIDDLE})*+(?: {_WORD}){{1,2}}(?!\p{{L}})",
}
PATTERN = "|".join(f"(?:{p})" for p in DETECTORS.values())
#: Every match has one of these in or right before it; texts without are not looked at further.
HINTS = ("[0-9@=:]|AKIA", rf"[{_INITIALS}](?:{_TAILS}) [\p{{L}}]|(?=[{_TITLE_BEGINS}])(?:{'|'.join(TITLES)})\.? \p{{Lu}}|(?:ame is|igned by) \p{{Lu}}")
HEX = "0123456789abcdef"


def _type(value: Column) -> Column:
    """The detector that a matched string belongs to; its surroundings are gone, so each form is told by itself."""
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike(r"^AKIA[0-9A-Z]{12,20}$"), "key")
        .when(value.rlike(r"^[+(]|^0\d{1,4}[ /]|^(?:\d{7,8}|\d{10,11})$|^[2-9]\d\d([\-.])\d{3}\1\d{4}$"), "phone")
        .when(value.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ipv4")
        .when(value.rlike(r"^\d{3}([ \-]?)\d{2}\1\d{4}$"), "ssn")
        .when(value.rlike(r"^\d{13,16}$|^\d{4}([ \-]\d{4}){3}$"), "card")
        .when(value.rlike(r"^[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?$"), "iban")
        .when(value.rlike(rf"^(?:\p{{Lu}}[\p{{L}}'\-]*\.?|{_PARTICLES})(?: (?:\p{{Lu}}[\p{{L}}'\-]*+\.?|(?:{_PARTICLES})(?!\p{{L}})))*+$") & value.rlike(r"\p{Ll}|\. "), "name")
        .otherwise("secret")
    )


def _norm(kind: Column, value: Column) -> Column:
    """What stays the same however an entity is written."""
    plus = F.when((kind == "phone") & value.startswith("+"), F.lit("+")).otherwise(F.lit(""))
    return F.when(kind.isin("phone", "card", "ssn"), F.concat(plus, F.regexp_replace(value, r"\D", ""))).when(kind.isin("email", "name"), F.lower(value)).when(kind == "iban", F.replace(value, F.lit(" "), F.lit(""))).otherwise(value)


def _keyed(secret: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """128 hex digits."""
    return F.sha2(F.encode(F.concat_ws("\x1f", F.lit(secret), kind, norm, attempt.cast("string")), "utf-8"), 512)


def _number(h: Column, at: int) -> Column:
    return F.conv(F.substring(h, at, 8), 16, 10).cast("bigint")


def _char_map(text: Column, h: Column) -> Column:
    """Each digit, small and capital letter becomes another of its class; everything else stays."""
    at = lambda i, letters: F.translate(F.substring(h, (i % 128 + 1).cast("int"), F.lit(1)), HEX, letters)
    one = lambda c, i: F.when(c.rlike("[0-9]"), at(i, "0123456789012345")).when(c.rlike("[a-z]"), at(i, "abcdefghiklmnoprs"[:16])).when(c.rlike("[A-Z]"), at(i, "ABCDEFGHIKLMNOPRS"[:16])).otherwise(c)
    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum with the last digit not doubled."""
    def one(c: Column, i: Column) -> Column:
        x = c.cast("int") * (1 + i % 2)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), one), F.lit(0), lambda a, x: a + x)


def _mod97(digits: Column) -> Column:
    """An IBAN's remainder: digits as they are, letters as 10 to 35."""
    def add(rest: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(digits, ""), lambda c: c != ""), F.lit(0), add)


def _person(norm: Column, h: Column, attempt: Column, tries: int) -> Column:
    """As many words as the name has: given names of its gender and script, a family name at the end; initials stay initials."""
    once = lambda words, told: _person_of(words, told["girl"], told["cyrillic"], told["last_at"], h, attempt, tries)
    female, male = ([x.lower() for s in ("latin", "cyrillic") for x in FIRST[s, g]] for g in "fm")

    def told(words: Column) -> Column:
        """What holds for all words: found once, as a name may have very many."""
        girl = words[0].isin(female) | (~words[0].isin(male) & (F.conv(F.substring(h, 57, 8), 16, 10).cast("bigint") % 2 == 0))
        last_at = F.when(words[0].isin([x.lower() for x in LEADING]), F.lit(0)).otherwise(F.size(words) - 1)
        return F.struct(girl.alias("girl"), norm.rlike(r"\p{IsCyrillic}").alias("cyrillic"), last_at.alias("last_at"))

    return bound(F.split(norm, " "), lambda words: bound(told(words), lambda t: once(words, t)))


def _person_of(words: Column, girl: Column, cyrillic: Column, last_at: Column, h: Column, attempt: Column, tries: int) -> Column:
    at = lambda i: F.conv(F.substring(h, (i * 8 % 64 + 1).cast("int"), F.lit(8)), 16, 10).cast("bigint")

    def pick(names: list[str], n: Column, word: Column) -> Column:
        """One of the names, but not the word itself."""
        drawn = lambda k: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
        return F.when(F.lower(drawn(n)) == word, drawn(n + 1)).otherwise(drawn(n))

    def given(w: Column, i: Column) -> Column:
        return F.when(cyrillic & girl, pick(FIRST["cyrillic", "f"], at(i), w)).when(cyrillic, pick(FIRST["cyrillic", "m"], at(i), w)).when(girl, pick(FIRST["latin", "f"], at(i), w)).otherwise(pick(FIRST["latin", "m"], at(i), w))

    def family(w: Column, i: Column) -> Column:
        return F.when(cyrillic, pick(LAST["cyrillic"], at(i), w)).otherwise(pick(LAST["latin"], at(i), w))

    # More attempts, longer names: a second family name of 5, 7, 9, ... syllables, and of 32 (128 bits) in the end.
    def second(script: str) -> Column:
        digits = F.filter(F.split(F.substring(h, F.lit(90), F.when(attempt > tries, 32).otherwise(3 + 2 * attempt)), ""), lambda c: c != "")
        return F.initcap(F.array_join(F.transform(digits, lambda c: F.get(F.array(*map(F.lit, SYLLABLES[script])), F.conv(c, 16, 10).cast("int"))), ""))

    more = F.when(attempt > 0, F.concat(F.lit("-"), F.when(cyrillic, second("cyrillic")).otherwise(second("latin")))).otherwise(F.lit(""))

    def one(w: Column, i: Column) -> Column:
        initial = F.concat(F.upper(F.translate(F.substring(h, (i * 8 % 64 + 1).cast("int"), F.lit(1)), HEX, "abcdefghiklmnopr")), F.lit("."))
        return F.when(i == last_at, F.concat(family(w, i), more)).when(w.endswith("."), initial).when(w.isin(_PARTICLES.split("|")), w).otherwise(given(w, i))

    return F.array_join(F.transform(words, one), " ")


def _core(kind: Column, norm: Column, h: Column, attempt: Column, tries: int = 12) -> Column:
    """The surrogate of an entity in normal form.

    After `tries` collisions the form is given up for a token of 128 bits, so that drawing ends for every kind.
    """
    n = F.length(norm)
    stream = F.translate(h, HEX, "0123456789012345")
    # A country code stays, and so does a national number's leading 0.
    code = F.length(F.regexp_extract(norm, rf"^\+(?:{CODES_1}|(?:{CODES_2})|\d\d?\d?)", 0))
    kept = F.greatest(code, norm.startswith("0").cast("int"))
    phone = F.concat(F.substring(norm, F.lit(1), kept), F.substring(F.repeat(stream, 2), F.lit(1), n - kept))
    body = F.concat(F.substring(norm, 1, 1), F.substring(stream, F.lit(2), n - 2))
    check = ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    card = F.concat(body, F.when(_luhn(norm) % 10 == 0, check).otherwise(F.substring(stream, n, F.lit(1))))
    ipv4 = F.concat_ws(".", *[(_number(h, 1 + 8 * k) % 254 + 1).cast("string") for k in range(4)])
    tld = F.regexp_extract(norm, r"(\.[a-z]+)$", 1)
    longer = F.when(attempt > tries, F.concat(F.lit("."), F.substring(h, 100, 24))).otherwise(F.lit(""))
    local, domain = F.substring_index(norm, "@", 1), F.regexp_replace(F.substring_index(norm, "@", -1), r"\.[a-z]+$", "")
    email = F.concat(_char_map(local, h), longer, F.lit("@"), _char_map(domain, F.reverse(h)), tld)
    hexes = F.substring(F.repeat(h, F.ceil(n / 128).cast("int")), F.lit(1), n)
    secret = F.when(norm.rlike("^[0-9a-f]+$"), hexes).otherwise(_char_map(norm, h))
    key = F.concat(F.lit("AKIA"), _char_map(F.substring(norm, F.lit(5), n - 4), h))
    bban = _char_map(F.substring(norm, F.lit(5), n - 4), h)
    iban = F.concat(F.substring(norm, 1, 2), F.lpad((98 - _mod97(F.concat(bban, F.substring(norm, 1, 2), F.lit("00")))).cast("string"), 2, "0"), bban)
    token = F.concat(kind, F.lit("-"), F.substring(h, 1, 32))
    formed = F.when(kind == "phone", phone).when(kind == "ssn", F.substring(stream, F.lit(1), n)).when(kind == "card", card).when(kind == "ipv4", ipv4).when(kind == "key", key).when(kind == "iban", iban).otherwise(secret)
    return F.when(kind == "email", email).when(kind == "name", _person(norm, h, attempt, tries)).when(attempt > tries, token).otherwise(formed)


def _formed(kind: Column, value: Column, core: Column) -> Column:
    """The surrogate written as the value was: its layout of digits, its blanks, its capitals."""
    plain = F.regexp_replace(core, r"^\+", "")
    digits = F.aggregate(
        F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
        lambda a, c: F.struct(F.concat(a["out"], F.when(c.rlike(r"^\d$"), F.substring(plain, a["k"], F.lit(1))).otherwise(c)).alias("out"), (a["k"] + c.rlike(r"^\d$").cast("int")).alias("k")),
        lambda a: a["out"],
    )
    blocks = F.when(value.contains(" "), F.rtrim(F.regexp_replace(core, "(.{4})", "$1 "))).otherwise(core)
    upper = F.when((value == F.upper(value)) & (value != F.lower(value)), F.upper(core)).otherwise(core)
    return F.when(core.startswith(F.concat(kind, F.lit("-"))), core).when(kind.isin("phone", "card", "ssn"), digits).when(kind == "iban", blocks).when(kind.isin("email", "name"), upper).otherwise(core)


def surrogates(entities: DataFrame, secret: str, *, tries: int = 12) -> DataFrame:
    """entities, a table of distinct (kind, norm), with core; other columns stay, but for attempt and probe.

    Those whose surrogate is a real entity, or also that of an entity before them, draw again until none is left:
    after `tries` collisions surrogates have 96 bits or more, so that drawing ends whatever the entities are. A
    round's draws are looked up among the entities and the settled surrogates; when they are few, neither is shuffled.
    """
    known = materialize(entities, "pii-entities")
    at, now, settled = ["kind", "probe"], known.withColumn("attempt", F.lit(0)), None
    while True:
        keyed = _keyed(secret, F.col("kind"), F.col("norm"), F.col("attempt"))  # once an entity, not once a character of it
        drawn = now.withColumn("core", bound(keyed, lambda h: _core(F.col("kind"), F.col("norm"), h, F.col("attempt"), tries)))
        drawn = materialize(drawn.withColumn("probe", _norm(F.col("kind"), F.col("core"))), "pii-drawn")
        first = materialize(drawn.groupBy(*at).agg(F.min("norm").alias("norm")), "pii-first")
        taken = known.select("kind", F.col("norm").alias("probe")).join(first.select(*at), at, "left_semi")
        if settled is not None:
            taken = taken.union(settled.select(*at).join(first.select(*at), at, "left_semi"))
        fit = materialize(first.join(taken, at, "left_anti"), "pii-fit")
        fresh = drawn.join(fit, [*at, "norm"], "left_semi")
        settled = fresh if settled is None else settled.unionByName(fresh)
        again = drawn.join(fit, [*at, "norm"], "left_anti")
        if again.isEmpty():
            return settled.select(*known.columns, "core")
        now = again.select(*known.columns, (F.col("attempt") + 1).alias("attempt"))


def _again(piece: Column, parts: Column) -> Column:
    """A piece of text with the words of names that the document gives in full replaced as they are there."""
    old = F.array_distinct(F.transform(parts, lambda p: p["old"]))
    new = F.map_from_arrays(old, F.transform(old, lambda o: F.filter(parts, lambda p: p["old"] == o)[0]["new"]))
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:\Q"), F.array_join(old, r"\E|\Q"), F.lit(r"\E)(?!\p{L})"))
    hits = F.regexp_extract_all(piece, pattern, F.lit(0))
    return F.when(piece.rlike(r"\p{Lu}"), F.array_join(F.transform(F.split(piece, pattern, -1), lambda x, i: F.concat(x, F.coalesce(F.element_at(new, F.get(hits, i)), F.lit("")))), "")).otherwise(piece)


def replace(docs: DataFrame, *, secret: str = "corpus", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with every detected entity in text_col replaced by its surrogate; other columns stay as they are.

    secret: the key of the hash; whoever has it can recompute surrogates. count_col: also add the number
    of entities. A person's given or family name that stands alone in a document with the full name becomes that
    part of the surrogate (of two persons' common part, the first's). Null and empty texts stay; equal texts get equal replacements; an empty table stays empty.
    Columns beginning with _ld_ are the operator's own. Texts of any length are taken whole: the work grows with the text, and
    no form takes stack for its length. A host of more than 127 labels, which no address has, is replaced up to there.
    """
    names, text = docs.columns, F.col(f"`{text_col}`")
    has = F.coalesce(F.when(text.rlike(HINTS[0]) | text.rlike(HINTS[1]), text.rlike(PATTERN)), F.lit(False))
    held = materialize(docs.where(has), "pii-texts")
    found = held.select(F.md5(F.encode(text, "utf-8")).alias("_ld_key"), F.regexp_extract_all(text, F.lit(PATTERN), 0).alias("values"))
    texts = materialize(found.groupBy("_ld_key").agg(F.first("values").alias("values"), F.count(F.lit(1)).alias("n")), "pii-lists")
    rows = texts.select("_ld_key", F.posexplode("values").alias("pos", "value")).withColumn("kind", _type(F.col("value")))
    rows = materialize(rows.withColumn("norm", _norm(F.col("kind"), F.col("value"))), "pii-found")
    cores = materialize(surrogates(rows.groupBy("kind", "norm").agg(F.count(F.lit(1)).alias("n")), secret), "pii-cores")
    formed = spread(rows, cores, ["kind", "norm"], cores.select("kind", "norm", "n"), "n").select("_ld_key", F.struct("pos", _formed(F.col("kind"), F.col("value"), F.col("core")).alias("new"), "kind", "value").alias("_ld_new"))
    lists = formed.groupBy("_ld_key").agg(F.sort_array(F.collect_list("_ld_new")).alias("_ld_new"))
    dirty = spread(held.withColumn("_ld_key", F.md5(F.encode(text, "utf-8"))), lists, ["_ld_key"], texts.select("_ld_key", F.col("n").alias("_ld_n")), "_ld_n")
    # Texts between the matches, and the surrogates, one after the other.
    between = F.split(text, PATTERN, -1)
    words = lambda e: F.filter(F.transform(F.arrays_zip(F.split(e["value"], " ").alias("old"), F.split(e["new"], " ").alias("new")), lambda p: F.struct(p["old"].alias("old"), p["new"].alias("new"))), lambda p: p["old"].rlike(rf"^\p{{Lu}}[\p{{L}}'\-]+$"))
    parts = F.flatten(F.transform(F.filter("_ld_new", lambda e: e["kind"] == "name"), words))
    dirty = dirty.withColumn("_ld_parts", parts)
    whole = lambda x: F.when(F.size("_ld_parts") > 0, _again(x, F.col("_ld_parts"))).otherwise(x)
    joined = F.array_join(F.transform(between, lambda x, i: F.concat(whole(x), F.coalesce(F.get("_ld_new", i)["new"], F.lit("")))), "")
    counted = [] if count_col is None else [F.size("_ld_new").cast("long").alias(count_col)]
    kept = lambda new: [new if c == text_col else F.col(f"`{c}`") for c in names if c != count_col]
    clean = docs.where(~has).select(*kept(text), *([] if count_col is None else [F.lit(0).cast("long").alias(count_col)]))
    return clean.unionByName(dirty.select(*kept(joined.alias(text_col)), *counted))

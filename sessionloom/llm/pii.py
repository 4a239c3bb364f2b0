"""Personal data replaced by surrogates (operator 9), in DataFrame and SQL expressions only.

Each distinct entity gets a keyed replacement of its own type: digits for digits,
letters of the same script and case for letters, names of the same gender, valid
addresses for addresses, valid check digits for valid ones. Replacements are
drawn by HMAC-SHA256 under a secret key, and drawn again until none is shared by
two entities or equal to a real one, so different entities stay different, and
the same entity has one replacement in all documents.

Found are mail addresses, keys with known prefixes, hexadecimal tokens of 32 to
128 digits, IPv4 and IPv6 addresses, phone numbers (with a plus, parentheses, or
parted 3-3-4 by points, dashes or blanks), US social security numbers, IBANs, numbers of
13 to 19 digits as on cards, and names after a title. Not found are names
without a title and unparted phone numbers.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import drop_tables, free_names, materialize

TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Г-н|Г-жа"
#: Entity types in order of precedence; each pattern is anchored by what may not stand beside it.
#: Repeated groups are bounded, as each repeat takes stack in Java: a host name has 127 parts at most.
PATTERNS: dict[str, str] = {
    "email": r"(?<![\w.%+-])[\w.%+-]++(?<=\w)@[\w-]++(?:\.[\w-]++){0,126}\.[A-Za-z]{2,24}(?![\w-])",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|(?:sk|pk|ghp|gho|ghs|xoxb|xoxp)[-_][A-Za-z0-9_-]{16,}+)(?![A-Za-z0-9])",
    "token": r"(?<![A-Za-z0-9])(?:(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])[0-9a-f]{32,128}+|(?=[0-9]*+[A-F])(?=[A-F]*+[0-9])[0-9A-F]{32,128}+)(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "ipv6": r"(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\w:])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])|(?<![\w.,+-])(?<!\d )\d{3} \d{3} \d{4}(?![\w-]| \d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "number": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "name": rf"(?<![\p{{L}}])(?:{TITLES})\.? \p{{Lu}}\p{{Ll}}++(?: \p{{Lu}}\p{{Ll}}++)?(?![\p{{L}}])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: One of these characters or titles stands in every entity.
HINT = rf"[0-9@]|\b(?:{TITLES})\b|Г-н|Г-жа|(?:sk|pk|gh[pos]|xox[bp])[-_]"
FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Г-жа)\b"
NEUTRAL = r"^(?:Dr|Prof)\b"
#: Given names for surrogates, by gender.
GIVEN = {
    "f": ["Anna", "Clara", "Elena", "Julia", "Laura", "Maria", "Nina", "Paula", "Rosa", "Sofia", "Vera", "Irene"],
    "m": ["Adam", "Bruno", "David", "Felix", "Hugo", "Ivan", "Leo", "Martin", "Oscar", "Paul", "Simon", "Victor"],
}
GIVEN["n"] = GIVEN["f"] + GIVEN["m"]
#: The session setting that holds the secret.
KEY_SETTING = "spark.sessionloom.surrogate.key"
#: Rounds of drawing before a type is held to have more entities than surrogates; from the fourth on, names and addresses grow.
ROUNDS = 16

_drawn_keys: dict[str, str] = {}


def surrogate_key(spark: SparkSession) -> str:
    """The secret of the session's setting; where there is none, one drawn at random for this application."""
    drawn = _drawn_keys.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING, drawn)


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def kind_of(raw: str) -> str:
    """SQL for the type of a matched text."""
    cases = " ".join(f"when {raw} rlike {quoted(f'^(?:{p})$')} then '{k}'" for k, p in PATTERNS.items())
    return f"case {cases} else 'number' end"


DIGITS = "regexp_replace(raw, '[^0-9]', '')"
#: The form in which an entity is the same wherever it stands; a phone number is without the country code 1.
CANONICAL = f"""case
    when kind in ('email', 'ipv6') then lower(raw)
    when kind = 'token' then lower(raw)
    when kind = 'phone' and length({DIGITS}) = 11 and {DIGITS} like '1%' then substr({DIGITS}, 2)
    when kind in ('phone', 'ssn', 'number') then {DIGITS}
    when kind = 'iban' then replace(raw, ' ', '')
    when kind = 'name' then concat(case when raw rlike {quoted(FEMALE)} then 'f' when raw rlike {quoted(NEUTRAL)} then 'n' else 'm' end, regexp_replace(raw, '^[^ ]+ ', ' '))
    else raw end"""
#: The k-th keyed random number below 256 of an entity; 160 of them, then again from the first.
RANDOM = "cast(conv(substr(stream, 1 + 2 * (k % 160), 2), 16, 10) as int)"
#: Each character gives way to one of its class: digit, hexadecimal digit, or letter of its script and case.
SAME_CLASS = f"""array_join(transform(filter(split(canonical, ''), c -> c <> ''), (c, k) -> case
    when kind = 'token' then substr('0123456789abcdef', 1 + {RANDOM} % 16, 1)
    when (kind = 'key' and k < 4) or (kind = 'iban' and k < 2) or (kind = 'phone' and k < length(canonical) - 10) or (kind = 'number' and k < 1) then c
    when kind = 'email' and k >= ending then c
    when kind = 'phone' and k = greatest(0, length(canonical) - 10) then cast(2 + {RANDOM} % 8 as string)
    when kind = 'ipv6' and c <> ':' then substr('0123456789abcdef', 1 + {RANDOM} % 16, 1)
    when c between '0' and '9' then cast({RANDOM} % 10 as string)
    when c between 'a' and 'z' then char(97 + {RANDOM} % 26)
    when c between 'A' and 'Z' then char(65 + {RANDOM} % 26)
    when c between 'а' and 'я' then substr('абвгдежзийклмнопрстуфхцчшщъыьэюя', 1 + {RANDOM} % 32, 1)
    when c between 'α' and 'ω' then substr('αβγδεζηθικλμνξοπρστυφχψω', 1 + {RANDOM} % 24, 1)
    when c rlike '\\\\p{{IsLatin}}' then if(c = upper(c), char(65 + {RANDOM} % 26), char(97 + {RANDOM} % 26))
    else c end), '')"""
OCTETS = "array_join(transform(sequence(0, 3), k -> cast(1 + {r} % 254 as string)), '.')".format(r=RANDOM)
#: A surname of four syllables; a given name of the same gender before it where there was one.
SURNAME = f"initcap(array_join(transform(sequence(0, 3), k -> concat(substr('bdfgklmnprstvz', 1 + {RANDOM} % 14, 1), substr('aeiou', 1 + ({RANDOM} div 14) % 5, 1))), ''))"
CYRILLIC = "initcap(array_join(transform(sequence(0, 3), k -> concat(substr('бвгдклмнпрст', 1 + {r} % 12, 1), substr('аеиоу', 1 + ({r} div 12) % 5, 1))), ''))".format(r=RANDOM)


def given(gender: str) -> str:
    names = ", ".join(f"'{n}'" for n in GIVEN[gender])
    return f"array({names})[{RANDOM.replace('(k % 160)', '40')} % {len(GIVEN[gender])}]"


NAME = f"""concat(substr(canonical, 1, 1), ' ',
    case when canonical rlike '[\\\\p{{IsCyrillic}}]' then concat({CYRILLIC}, if(canonical rlike ' .* ', concat(' ', {SURNAME.replace('bdfgklmnprstvz', 'бвгдклмнпрстфз').replace('aeiou', 'аеиоу')}), ''))
    else concat(if(canonical rlike ' .* ', concat(case substr(canonical, 1, 1) when 'f' then {given('f')} when 'm' then {given('m')} else {given('n')} end, ' '), ''), {SURNAME}) end)"""


def luhn(digits: str) -> str:
    """SQL for the sum of a number's digits in which every second one from the right counts double."""
    doubled = f"cast(substr({digits}, i, 1) as int) * if((length({digits}) - i) % 2 = 1, 2, 1)"
    return f"aggregate(transform(sequence(1, length({digits})), i -> {doubled}), 0, (a, v) -> a + cast(v div 10 as int) + v % 10)"


def mod97(text: str) -> str:
    """SQL for an account number's remainder, letters counting from 10 on, its first four characters last."""
    turned = f"concat(substr({text}, 5), substr({text}, 1, 4))"
    value = "if(c between '0' and '9', a * 10 + cast(c as int), a * 100 + ascii(c) - 55)"
    return f"aggregate(filter(split({turned}, ''), c -> c <> ''), 0, (a, c) -> ({value}) % 97)"


#: A surrogate of a number with a valid check digit, or of an account with valid ones, gets valid ones.
CHECKED = f"""case
    when kind = 'number' and {luhn('canonical')} % 10 = 0 then concat(substr(drawn, 1, length(drawn) - 1), cast((10 - {luhn("concat(substr(drawn, 1, length(drawn) - 1), '0')")} % 10) % 10 as string))
    when kind = 'iban' and {mod97('canonical')} = 1 then concat(substr(drawn, 1, 2), lpad(cast(98 - {mod97("concat(substr(drawn, 1, 2), '00', substr(drawn, 5))")} as string), 2, '0'), substr(drawn, 5))
    when attempt > 3 and kind = 'email' then concat(substr(stream, 300, 4 + attempt), drawn)
    when attempt > 3 and kind = 'name' then concat(drawn, translate(substr(stream, 280, 2 + attempt), '0123456789abcdef', if(canonical rlike '[\\\\p{{IsCyrillic}}]', 'аеиоубвгдклмнпрс', 'aeioubdfgklmnprs')))
    else drawn end"""


def keyed_hash(key: str, message: str) -> str:
    """SQL for the HMAC-SHA256 of a text under ``key``, in hexadecimal digits."""
    held = key.encode()
    held = (hashlib.sha256(held).digest() if len(held) > 64 else held).ljust(64, b"\0")
    inner, outer = (bytes(x ^ pad for x in held).hex() for pad in (0x36, 0x5C))
    return f"sha2(concat(X'{outer}', unhex(sha2(concat(X'{inner}', encode({message}, 'UTF-8')), 256))), 256)"


def draw(entities: DataFrame, key: str) -> DataFrame:
    """Add the surrogate of each (kind, canonical, attempt)."""
    blocks = ", ".join(keyed_hash(key, f"concat_ws('|', kind, canonical, attempt, '{b}')") for b in range(5))
    drawn = entities.withColumn("stream", F.expr(f"concat({blocks})")).withColumn("ending", F.expr("length(canonical) - instr(reverse(canonical), '.') + 1"))
    drawn = drawn.withColumn("drawn", F.expr(f"case kind when 'ip' then {OCTETS} when 'name' then {NAME} else {SAME_CLASS} end"))
    return drawn.withColumn("surrogate", F.expr(CHECKED)).drop("stream", "ending", "drawn")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, surrogate) with no surrogate shared or equal to a real entity of the kind."""
    drawn = materialize(draw(entities.select("kind", "canonical").withColumn("attempt", F.lit(0)), key), "surrogates")
    for left in range(ROUNDS, -1, -1):
        taken = drawn.select("kind", F.col("canonical").alias("surrogate"), F.lit(True).alias("real"))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("canonical").alias("first"))
        checked = drawn.join(first, ["kind", "surrogate"]).join(taken, ["kind", "surrogate"], "left")
        checked = checked.withColumn("clash", F.col("real").isNotNull() | (F.col("first") != F.col("canonical")))
        clashes = checked.where("clash").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt"))
        if clashes.isEmpty():
            return drawn.select("kind", "canonical", "surrogate")
        if not left:
            kinds = ", ".join(sorted(r.kind for r in clashes.select("kind").distinct().collect()))
            raise ValueError(f"no surrogates are left for entities of the types {kinds}")
        kept = checked.where("not clash").select("kind", "canonical", "attempt", "surrogate")
        again = materialize(kept.unionByName(draw(clashes, key)), "surrogates")
        drop_tables(drawn.sparkSession, drawn)
        drawn = again


#: The place of a character among the digits and letters of a text.
PLACE = "length(regexp_replace(substr(raw, 1, k + 1), '[^0-9A-Za-z]', ''))"
#: The surrogate in the form in which the entity stood; a phone number keeps its country code.
FORMATTED = f"""case
    when kind in ('phone', 'ssn', 'number', 'iban') then array_join(transform(filter(split(raw, ''), c -> c <> ''), (c, k) ->
        if(c rlike '[0-9A-Za-z]' and {PLACE} > lead, substr(surrogate, {PLACE} - lead, 1), c)), '')
    when kind = 'name' then concat(regexp_extract(raw, '^[^ ]+', 0), substr(surrogate, 2))
    when kind in ('email', 'token', 'ipv6') and raw = upper(raw) then upper(surrogate)
    else surrogate end"""


def replace_personal_data(docs: DataFrame, key: str) -> DataFrame:
    """Replace every detected entity in the whole texts.

    ``key`` is the secret under which surrogates are drawn: whoever holds it can
    draw them too, so keep it, and plans and event logs of this job, private.
    Returns all columns of ``docs`` with the new text, n_entities (places
    replaced) and entity_kinds (their distinct types, sorted, comma-joined); where
    ``docs`` has a column of such a name, the new one has "_" after it. Only
    texts that hold entities are rebuilt; a text's entities come together by
    row, and the join with the surrogates is a sort-merge join, in which adaptive
    execution splits the partition of a hot entity.

    Null and empty texts and texts without entities stay as they are with
    n_entities 0. Texts of any length are read whole; what repeats in a pattern
    is bounded or takes no stack. Repeated rows are rewritten alike; null ids are
    kept; an empty table gives no rows; other columns pass through, whatever
    their names. ValueError, where a type has more entities than surrogates.
    """
    if not key:
        raise ValueError("surrogates need a secret key")
    names = docs.columns
    places, kinds = free_names(["n_entities", "entity_kinds"], names)
    has = F.coalesce(F.col("text").rlike(HINT) & F.col("text").rlike(ANY), F.lit(False))
    clean = docs.where(~has).select("*", F.lit(0).alias(places), F.lit("").alias(kinds))
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    found = materialize(docs.where(has).select(row, F.monotonically_increasing_id().alias("uid")), "personal")
    text = F.col("row.text")
    raws = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    mentions = (
        found.select("uid", F.posexplode(raws).alias("place", "raw"))
        .withColumn("kind", F.expr(kind_of("raw")))
        .withColumn("canonical", F.expr(CANONICAL))
    )
    mentions = materialize(mentions, "mentions")
    table = materialize(surrogates(mentions.select("kind", "canonical").distinct(), key), "replacements")
    lead = F.expr(f"if(kind = 'phone', greatest(0, length({DIGITS}) - length(canonical)), 0)").alias("lead")
    replaced = mentions.join(table, ["kind", "canonical"]).select("*", lead).select("uid", "place", "kind", F.expr(FORMATTED).alias("new"))
    by_row = replaced.groupBy("uid").agg(
        F.array_sort(F.collect_list(F.struct("place", "new"))).alias("new"),
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias(kinds),
    )
    pieces = F.zip_with(
        F.split(text, ANY, -1), F.col("new"), lambda gap, new: F.concat(gap, F.coalesce(new["new"], F.lit("")))
    )
    changed = found.join(by_row, "uid").select(
        *[F.array_join(pieces, "").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names],
        F.size("new").alias(places), kinds,
    )
    return clean.unionByName(changed)

"""PII: format-preserving Feistel pseudonyms, with SQL functions alone.

Personal values are found by one pattern and validated: card numbers by their check digit, IBANs by theirs,
dates by the calendar, social security numbers and addresses by the ranges of their parts; what fails stays.
Each value is replaced by a keyed permutation of the valid values of its format, so equal values get equal
pseudonyms in all documents, and different ones differ. Within a value, letters and digits move within their
own alphabets while separators stay.

A Feistel network over the two halves of a string: in each round one half is shifted, character by
character and within the character's alphabet, by a keyed hash of the other half. Every round can be
undone, so the whole is a permutation of the strings of the same shape.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Setting of the session that holds the key of the permutation; Spark redacts settings of such names.
KEY_SETTING = "spark.quire.pseudonym.secret"
#: Alphabets: a character moves within its own; characters of none stay.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "αβγδεζηθικλμνξοπρστυφχψωςάέήίόύώ", "абвгдежзийклмнопрстуфхцчшщъыьэюяё")
#: Rounds; even, so that the halves end where they began.
ROUNDS = 8
#: Days that dates are permuted among, from FIRST_DAY on (1900-01-01 to 2099-12-31).
FIRST_DAY, DAYS = "1900-01-01", 73_049

EMAIL = r"[\p{L}\p{N}._%+\-]+@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9\-]*[A-Za-z0-9])+"
SECRET = r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|(?i:\b(?:password|passwd|secret|token|api_key)\s*[=:]\s*)[\"']?[A-Za-z0-9_\-/+]{8,}[\"']?"
IP = r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?!\w|\.[0-9])"
_D, _M, _Y = r"(?:0?[1-9]|[12][0-9]|3[01])", r"(?:0?[1-9]|1[0-2])", r"(?:19|20)[0-9]{2}"
_NAME = r"(?i:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
_DAY = _D + r"(?i:st|nd|rd|th)?"
#: Day, month and year in any order with one separator; a time may follow after T.
_NUMERIC = "|".join(f"{_Y}{x}(?:0[1-9]|1[0-2]){x}(?:0[1-9]|[12][0-9]|3[01])|{_D}{x}{_M}{x}{_Y}|{_M}{x}{_D}{x}{_Y}" for x in ("-", "[.]", "/"))
DATE = rf"(?<![\w.\-/])(?:{_NUMERIC})(?![\-/]|\.[0-9]|(?!T[0-9]{{2}})\w)|(?<![\w.\-/])(?:{_DAY}(?:[ \-]|(?i: of ))(?:{_NAME}),?[ \-]|(?:{_NAME}) {_DAY},? ){_Y}(?![\w\-/])"
SSN = r"(?<![\w\-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w\-])"
PHONE = r"(?<![\w.])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\)[ .\-]?|[0-9]{3}[.\- ])[0-9]{3}[.\- ][0-9]{4}(?!\w)|(?<!\w)\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,5}(?!\w)"
NUMBER = r"(?<![\w.])(?:[0-9]{4}(?:[ \-]?[0-9]{4}){2}[ \-]?[0-9]{1,7}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?!\w|\.[0-9])"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|(?: ?[A-Z0-9]{4}){2} ?[A-Z0-9]{3})\b"
#: Kinds in the order in which they are tried at a place.
KINDS = {"secret": SECRET, "email": EMAIL, "iban": IBAN, "ip": IP, "date": DATE, "ssn": SSN, "phone": PHONE, "number": NUMBER}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: What every value holds: texts without it are passed by.
HINT = r"[0-9@]|(?i:passw|secret|token|api_key)"


def _sql(text: str) -> str:
    """A pattern as a SQL literal."""
    return "r'" + text.replace("'", "\\x27") + "'"


def shift(char: str, hexes: str, i: str) -> str:
    """SQL: char moved within its alphabet by the i-th byte of a hash in hex; other characters stay."""
    by = f"cast(conv(substr({hexes}, ({i} % 64) * 2 + 1, 2), 16, 10) as int)"
    moved = [f"when {char} between '{x[0]}' and '{x[-1]}' then chr({ord(x[0])} + (ascii({char}) - {ord(x[0])} + {by}) % {len(x)})" for x in ALPHABETS[:3]]
    moved += [f"when {char} > '\x7f' and locate({char}, '{x}') > 0 then substr('{x}', (locate({char}, '{x}') - 1 + {by}) % {len(x)} + 1, 1)" for x in ALPHABETS[3:]]
    return f"case {' '.join(moved)} else {char} end"


def permuted(value: str, tag: str, key: str) -> str:
    """SQL: the Feistel permutation of a string expression, of its own for each tag and key."""
    hexes = f"sha2(concat({key}, '|', {tag}, '|', r, '|', s.b), 512)"
    moved = f"array_join(transform(split(s.a, ''), (c, i) -> {shift('c', 'g', 'i').replace('substr(g', 'substr(' + hexes)}), '')"
    return f"""aggregate(sequence(1, {ROUNDS}),
        named_struct('a', substr({value}, 1, cast(length({value}) div 2 as int)), 'b', substr({value}, cast(length({value}) div 2 as int) + 1)),
        (s, r) -> named_struct('a', s.b, 'b', {moved}),
        s -> concat(s.a, s.b))"""


def luhn(digits: str) -> str:
    """SQL: the sum that card numbers hold at a multiple of ten, of digits with a last one to be appended."""
    at = f"cast(substr({digits}, length({digits}) - i, 1) as int)"
    return f"aggregate(transform(split({digits}, ''), (c, i) -> if(i % 2 = 0, (2 * {at}) div 10 + (2 * {at}) % 10, {at})), 0, (a, x) -> cast(a + x as int))"


def mod97(text: str) -> str:
    """SQL: the remainder by 97 of a string of digits and letters, A standing for 10."""
    return f"aggregate(split({text}, ''), 0, (a, c) -> if(c between '0' and '9', (a * 10 + cast(c as int)) % 97, (a * 100 + ascii(c) - 55) % 97))"


def respelt(value: str, digits: str, kind: str = "0-9") -> str:
    """SQL: value with its digits (or characters of the kind), in order, replaced by those of another string."""
    return f"array_join(transform(split({value}, ''), (c, i) -> if(c rlike '[{kind}]', substr({digits}, length(regexp_replace(substr({value}, 1, i + 1), '[^{kind}]', '')), 1), c)), '')"


def date(value: str, key: str) -> str:
    """SQL: the pseudonym of a date in the form of the date, null if there is no such day.

    Of 1/2/2003 the month comes first, of 1.2.2003 and 1-2-2003 the day, unless the other number alone can be
    the month; such dates are permuted among themselves (days after the 12th), so no two dates meet in one form.
    """
    part = lambda n: f"element_at(split({value}, '[./-]'), {n})"
    pick = lambda pattern: f"regexp_extract({value}, {_sql(pattern)}, 0)"
    is_ = lambda pattern: f"{value} rlike {_sql(pattern)}"
    year_first, named, slash = is_("^[0-9]{4}"), is_("[A-Za-z]{3}"), f"contains({value}, '/')"
    name, day = pick("[A-Za-z]{3,9}"), pick("(?<![0-9])[0-9]{1,2}(?![0-9])")
    month = f"cast((locate(lower(substr({name}, 1, 3)), 'janfebmaraprmayjunjulaugsepoctnovdec') + 2) div 3 as string)"
    iso = lambda y, m, d: f"concat({y}, '-', lpad({m}, 2, '0'), '-', lpad({d}, 2, '0'))"
    other = f"(not {year_first} and not {named} and cast({part(1)} as int) > 12 = {slash} and greatest(cast({part(1)} as int), cast({part(2)} as int)) > 12)"
    day_first = f"({slash} = {other})"
    found = f"case when {year_first} then {iso(part(1), part(2), part(3))} when {named} then {iso(f'substr({value}, -4)', month, day)} when {day_first} then {iso(part(3), part(2), part(1))} else {iso(part(3), part(1), part(2))} end"
    moved = lambda v: permuted(v, "'date'", key)
    good = f"cast(d as int) < {DAYS} and (not f.other or day(date_add(date'{FIRST_DAY}', cast(d as int))) > 12)"
    start = moved(f"lpad(cast(datediff(f.day, date'{FIRST_DAY}') as string), 5, '0')")
    walk = f"aggregate(sequence(1, 64), {start}, (d, k) -> if({good}, d, {moved('d')}))"
    short = f"{is_('(?:^|[./-])0[1-9][./-]')}"
    number = lambda c: f"if({short}, lpad(cast({c} as string), 2, '0'), cast({c} as string))"
    mark = f"substr(regexp_replace({value}, '[0-9]', ''), 1, 1)"
    word = f"date_format(x, if(length({name}) > 4 or lower({name}) in ('june', 'july'), 'MMMM', 'MMM'))"
    word = f"case when {name} = upper({name}) then upper({word}) when {name} = lower({name}) then lower({word}) else {word} end"
    ordinal = f"if({is_('[0-9](?i:st|nd|rd|th)')}, case when day(x) in (1, 21, 31) then 'st' when day(x) in (2, 22) then 'nd' when day(x) in (3, 23) then 'rd' else 'th' end, '')"
    figure = f"concat(if({day} like '0%', lpad(cast(day(x) as string), 2, '0'), cast(day(x) as string)), {ordinal})"
    spelt = f"regexp_replace(regexp_replace(concat(substr({value}, 1, length({value}) - 4), year(x)), '[A-Za-z]{{3,9}}', {word}), '(?<![0-9])[0-9]{{1,2}}(?![0-9])(?i:st|nd|rd|th)?', {figure})"
    printed = f"""case when x is null then null when {year_first} then date_format(x, concat('yyyy', {mark}, 'MM', {mark}, 'dd')) when {named} then {spelt}
        when {day_first} then concat_ws({mark}, {number('day(x)')}, {number('month(x)')}, year(x)) else concat_ws({mark}, {number('month(x)')}, {number('day(x)')}, year(x)) end"""
    return f"element_at(transform(transform(array(named_struct('day', try_to_date({found}), 'other', {other})), f -> if(f.day is null, null, date_add(date'{FIRST_DAY}', cast({walk} as int)))), x -> {printed}), 1)"


def pseudonym(value: str, key: str) -> str:
    """SQL: the pseudonym of one matched value."""
    digits = f"regexp_replace({value}, '[^0-9]', '')"
    full = lambda kind: f"{value} rlike {_sql('^(?:' + KINDS[kind] + ')$')}"
    payload = f"substr({digits}, 1, length({digits}) - 1)"
    moved = permuted(payload, "'number'", key)
    last = f"cast(pmod(cast(substr({digits}, -1, 1) as int) + {luhn(payload)} - {luhn('p')}, 10) as string)"
    number = f"element_at(transform(array({moved}), p -> concat(p, {last})), 1)"
    octets = f"split({value}, '[.]')"
    pairs = lambda a, b: f"cast(element_at({octets}, {a}) as int) * 256 + cast(element_at({octets}, {b}) as int)"
    block = f"pmod(s.a + cast(conv(substr(sha2(concat({key}, '|ip|', r, '|', s.b), 256), 1, 8), 16, 10) as bigint), 65536)"
    ip = f"""aggregate(sequence(1, {ROUNDS}), named_struct('a', cast({pairs(1, 2)} as bigint), 'b', cast({pairs(3, 4)} as bigint)), (s, r) -> named_struct('a', s.b, 'b', {block}),
        s -> concat_ws('.', s.a div 256, s.a % 256, s.b div 256, s.b % 256))"""
    bare = f"replace({value}, ' ', '')"
    bban = permuted(f"substr({bare}, 5)", f"concat('iban', substr({value}, 1, 2))", key)
    check = f"lpad(cast(98 - {mod97(f'concat(b, substr({value}, 1, 2), 0, 0)')} as string), 2, '0')"
    iban = respelt(value, f"concat(substr({value}, 1, 2), {check}, b)", "0-9A-Z")
    iban = f"element_at(transform(array({bban}), b -> {iban}), 1)"
    ssn_again = permuted("d", "'ssn'", key)
    ssn = f"aggregate(sequence(1, 64), {permuted(digits, "'ssn'", key)}, (d, k) -> if(d rlike '^(?!000|666|9)[0-9]{{3}}(?!00)[0-9]{{2}}(?!0000)[0-9]{{4}}$', d, {ssn_again}))"
    mark = f"regexp_extract({value}, {_sql(r'^((?:AKIA|ASIA)|[A-Za-z_]+[ ]*[=:][ ]*)')}, 1)"
    country = f"regexp_extract({value}, {_sql(r'^([+][0-9]{1,3}(?![0-9])|[+])')}, 1)"
    rest = lambda head: f"substr({value}, length({head}) + 1)"
    return f"""case
        when {full('secret')} then concat({mark}, {permuted(rest(mark), "'secret'", key)})
        when {full('email')} then concat({permuted(f"lower(substring_index({value}, '@', 1))", "'email'", key)}, '@', substring_index({value}, '@', -1))
        when {full('iban')} then if({mod97(f'concat(substr({bare}, 5), substr({bare}, 1, 4))')} = 1, {iban}, {value})
        when {full('ip')} then {ip}
        when {full('date')} then coalesce({date(value, key)}, {value})
        when {full('ssn')} then {respelt(value, ssn)}
        when {full('phone')} then concat({country}, {respelt(rest(country), permuted(f"regexp_replace({rest(country)}, '[^0-9]', '')", "'phone'", key))})
        when {full('number')} then if({luhn(payload)} % 10 = pmod(-cast(substr({digits}, -1, 1) as int), 10), {respelt(value, number)}, {value})
        else {value} end"""


def session_key(spark: SparkSession) -> str:
    """The key in the session's setting KEY_SETTING. Where none is set, a random one is, so values stay linked within the session alone."""
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING)


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """docs with text replaced, n_chars (if there) brought up to date where it was, plus n_pseudonyms (values that came out different).

    Valid cards and IBANs stay valid, dates stay dates, social security numbers stay in their ranges; e-mail
    addresses keep their domain. Left in clear: numbers that fail their check, dates without a day or a four-digit
    year from 1900 to 2099, and those with month names other than English ones; telephone numbers without any
    separator or plus sign, secrets under eight characters, passport numbers; letters of an address beyond
    the Latin, Greek and Cyrillic ones. Four numbers that could be an address (10.2.3.4) and a version that could be a date
    (1.2.2003) count as these. A null text stays null with 0 pseudonyms; texts without such values
    stay as they are; repeated rows are treated each; an empty table gives an empty result; a column named
    n_pseudonyms is replaced.
    """
    found = F.when(F.col("text").rlike(HINT), F.regexp_extract_all(F.col("text"), F.lit(ANY), F.lit(0)))
    names = [c for c in docs.columns if c not in ("n_pseudonyms", "__found", "__key")]
    hits = docs.select(*names, F.coalesce(found, F.array().cast("array<string>")).alias("__found"))
    # the key comes in as the row of a table, so no plan, event log or message prints it
    hits = hits.withColumn("__key", docs.sparkSession.createDataFrame([(key,)], "key string").scalar())
    pairs: Column = F.expr(f"transform(__found, v -> named_struct('old', v, 'new', {pseudonym('v', '__key')}))")
    # pieces and values take turns; there is one piece more than values
    rest = F.split("text", ANY, -1)
    hits = hits.withColumn("__found", pairs)
    woven = F.array_join(F.flatten(F.zip_with(rest, "__found", lambda a, b: F.array(a, F.coalesce(b["new"], F.lit(""))))), "")
    text = F.when(F.size("__found") > 0, woven).otherwise(F.col("text"))
    times = F.size(F.filter("__found", lambda x: x["old"] != x["new"]))
    new = {"text": text}
    if "n_chars" in names:  # as it was where nothing was replaced
        new["n_chars"] = F.when(F.size("__found") > 0, F.length(woven).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return hits.select(*[new[c].alias(c) if c in new else F.col(c) for c in names], times.alias("n_pseudonyms"))

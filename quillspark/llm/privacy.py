"""PII: detected entities get keyed, type-consistent surrogates.

Kinds: e-mail addresses, IBANs (with right check digits), IPv4 addresses, payment cards (with the
right Luhn digit), social security numbers, phone numbers, and names after a title (given names by
the gender of the title, surnames) with their further mentions in the same text.

* Values of a format are permuted within it: a keyed Feistel network over their letters and digits
  (octets of an address), each with its own number of values. A permutation keeps different
  entities apart on any number of them, has no need of a loop, and is made so that nothing stays as
  it is. Separators, length, case, the top-level domain, the country or calling code and a card's
  first digit stay; check digits are made anew. The network is over what spellings of an entity
  have in common, so it has one surrogate in every document and spelling.
* Names get made-up ones of the same script, case and gender, drawn from SHA-512 over the key, the
  name and a number of attempt. Collision checks over the distinct names keep them apart: of those
  that share a surrogate all but the first take their next attempt, and so does one whose surrogate
  is a real name of the corpus. An attempt has a syllable more than the one before, so there are
  always enough names. A given name has the gender of its titles; after a title without one it
  follows the others, so "Dr Anna Smith" and "Mrs Anna Smith" stay one person.

Not found: names that never follow a title in their text. Found by mistake: words in a text that
are written as a name of that text is.

Everything is DataFrame and SQL functions. Only rows with an entity are stored and joined; all
others pass by. Defined cases: null texts stay null; rows that share a doc_id are treated each
for itself; an empty table gives an empty result; all columns are kept, ``n_chars`` follows the
text of rows with an entity, and a column ``pii`` (the number of entities after titles or of a
format) is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, split_join, stored, table
from .matches import quoted

TITLES = {"m": "Mr|Herr|Monsieur|Señor|Sr|Г-н|Κος", "f": "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Г-жа|Κα", "n": "Dr|Prof"}
_TITLE = "|".join(TITLES.values())
_NAME = r"\p{Lu}\p{L}{1,30}"
_BEFORE = r"(?<![\p{L}])"
#: Kinds with their patterns, in the order in which they are tried at a place. The group of unbounded
#: repetition is possessive: Java repeats it in a loop, a greedy one on the stack.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "card": r"(?<![\d.+-])(?:(?:\d{4}[ -]){3}\d{4}|\d{13,19})(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w+])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)",
    # the capital letter is looked for first: only there is it worth looking back for a title
    "given": rf"(?=\p{{Lu}})(?<={_BEFORE}(?:{_TITLE})\.? ){_NAME}(?= {_NAME})",
    "surname": rf"(?=\p{{Lu}})(?<=(?:{_TITLE})\.? )(?<={_BEFORE}(?:{_TITLE})\.? ){_NAME}|(?=\p{{Lu}})(?<=\p{{L}} )(?<={_BEFORE}(?:{_TITLE})\.? {_NAME} ){_NAME}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
MENTION = rf"{_BEFORE}{_NAME}(?!\p{{L}})"
#: Texts without any of these, an @ or a title cannot hold an entity; they are passed by quickly.
MAYBE = r"\d[\d .()-]{5}|[A-Z]{2}\d{2}"
#: The calling codes that have one or two digits; all others have three.
CALLING = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
#: Letters of names by script: they are made of syllables of a consonant and a vowel.
SCRIPTS = {
    r"\p{IsCyrillic}": ("бвгдзклмнпрст", "аеио", "а", "н"),
    r"\p{IsGreek}": ("βγδζκλμνπρστφ", "αειο", "α", "ς"),
    r"\p{L}": ("bdfgklmnprstv", "aeio", "a", "n"),
}
#: Rounds of the Feistel network, and syllables of a name at the first attempt.
ROUNDS, SYLLABLES = 6, 3


def _let(value: str, name: str, body: str) -> str:
    """SQL: body with the value computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _byte(h: str, i: str) -> str:
    return f"cast(conv(substring({h}, 2 * (({i}) % 64) + 1, 2), 16, 10) as int)"


def permuted(values: str, sizes: str, key: str, tweak: str) -> str:
    """SQL: a permutation of arrays of numbers, each below its size, without fixed points.

    All but the last number go through a Feistel network of two halves, which depends on the last;
    the last is then moved by at least one, by what the others have become.
    """
    told = f"concat_ws('|', {quoted(key)}, {tweak}, array_join(m, ',')"
    moved = lambda half, other, at: _let(f"sha2({told}, element_at(v, -1), r, array_join({other}, ',')), 512)", "h", f"transform({half}, (c, i) -> (c + {_byte('h', 'i')}) % m[i + {at}])")
    k = "int((size(v) - 1) div 2)"
    net = f"""aggregate(sequence(1, {ROUNDS}), named_struct('a', slice(v, 1, {k}), 'b', slice(v, {k} + 1, size(v) - 1 - {k})),
        (s, r) -> if(r % 2 = 1, named_struct('a', s.a, 'b', {moved("s.b", "s.a", k)}), named_struct('a', {moved("s.a", "s.b", "0")}, 'b', s.b)), s -> concat(s.a, s.b))"""
    by = _byte(f"sha2({told}, 'end', array_join(w, ',')), 512)", "0")
    last = f"(element_at(v, -1) + 1 + {by} % (element_at(m, -1) - 1)) % element_at(m, -1)"
    whole = _let(net, "w", f"concat(w, array({last}))")
    return _let(values, "v", _let(sizes, "m", f"if(size(v) = 0, v, {whole})"))


def of_text(text: str, key: str, tweak: str) -> str:
    """SQL: a permutation of texts of digits and lower-case letters."""
    each = lambda x: f"transform(split(t, ''), c -> if(c between '0' and '9', {x}))"
    inner = permuted(each("cast(c as int), ascii(c) - 97"), each("10, 26"), key, tweak)
    back = f"array_join(transform({inner}, (x, i) -> if(substring(t, i + 1, 1) between '0' and '9', cast(x as string), chr(97 + x))), '')"
    return _let(text, "t", f"if(t = '', '', {back})")


def _luhn(digits: str) -> str:
    """SQL: the Luhn sum modulo 10 of a string of digits."""
    d = "cast(substring(t, char_length(t) - i, 1) as int)"
    return "(" + _let(digits, "t", f"aggregate(sequence(0, char_length(t) - 1), 0, (n, i) -> n + if(i % 2 = 0, {d}, if({d} > 4, 2 * {d} - 9, 2 * {d})))") + " % 10)"


def _mod97(text: str) -> str:
    """SQL: digits and capital letters (A is 10) as a number modulo 97."""
    return f"aggregate(split({text}, ''), 0, (n, c) -> if(c between '0' and '9', n * 10 + cast(c as int), n * 100 + ascii(c) - 55) % 97)"


def _laid_out(raw: str, symbols: str) -> str:
    """SQL: raw with its letters and digits replaced by the symbols in their order, in its case."""
    put = "if(c between 'A' and 'Z', upper(substring(y, s.j + 1, 1)), substring(y, s.j + 1, 1))"
    step = f"(s, c) -> if(c rlike '[A-Za-z0-9]', named_struct('out', concat(s.out, {put}), 'j', s.j + 1), named_struct('out', concat(s.out, c), 'j', s.j))"
    return _let(symbols, "y", f"aggregate(split({raw}, ''), named_struct('out', '', 'j', 0), {step}, s -> s.out)")


def _normal() -> str:
    """SQL: what spellings of one entity have in common, from columns kind and raw. A phone number
    without a calling code is one of the code 1."""
    only = "regexp_replace(raw, '[^0-9A-Za-z]', '')"
    return f"case when kind in ('given', 'surname', 'email', 'ip') then lower(raw) when kind = 'phone' and not raw like '+%' then concat('1', {only}) else {only} end"


#: Characters of the longest address: 64 before the @ and 255 after it.
ADDRESS = 320
#: What has a kind's form but isn't one stays as it is: wrong check digits, and runs that no mail system takes.
VALID = f"case kind when 'email' then char_length(raw) <= {ADDRESS} when 'card' then {_luhn('norm')} = 0 when 'iban' then {_mod97('concat(substring(norm, 5), substring(norm, 1, 4))')} = 1 else true end"


def surrogate(key: str) -> str:
    """SQL: the surrogate of the columns raw and norm by kind, of kinds that have a format."""
    tld = "regexp_extract(norm, '[.][a-z0-9-]+$', 0)"
    plain = lambda x: f"regexp_replace({x}, '[^0-9a-z]', '')"
    parts = [plain("substring_index(norm, '@', 1)"), plain(f"substring(norm, instr(norm, '@'), char_length(norm) - char_length({tld}) - instr(norm, '@') + 1)")]
    address = f"concat({of_text(parts[0], key, repr('local'))}, {of_text(parts[1], key, repr('domain'))})"
    email = f"concat({_laid_out(f'substring(raw, 1, char_length(raw) - char_length({tld}))', address)}, substring(raw, char_length(raw) - char_length({tld}) + 1))"
    octets = "transform(split(raw, '[.]'), x -> cast(x as int))"
    ip = f"array_join({permuted(octets, 'array(256, 256, 256, 256)', key, repr('ip'))}, '.')"
    code = f"regexp_extract(norm, '^(?:{CALLING}|[0-9]{{3}})', 0)"
    number = of_text(f"substring(norm, char_length({code}) + 1)", key, f"concat('phone', {code})")
    phone = _laid_out("raw", f"if(raw like '+%', concat({code}, {number}), {number})")
    middle = of_text("substring(norm, 2, char_length(norm) - 2)", key, "concat('card', substring(norm, 1, 1))")
    digit = _luhn("concat(d, '0')")
    card = _laid_out("raw", _let(f"concat(substring(norm, 1, 1), {middle})", "d", f"concat(d, cast((10 - {digit}) % 10 as string))"))
    account = of_text("lower(substring(norm, 5))", key, "concat('iban', substring(norm, 1, 2))")
    check = _mod97("concat(b, substring(norm, 1, 2), '00')")
    iban = _laid_out("raw", _let(f"upper({account})", "b", f"concat(substring(norm, 1, 2), lpad(cast(98 - {check} as string), 2, '0'), b)"))
    ssn = _laid_out("raw", of_text("norm", key, "'ssn'"))
    return f"case kind when 'email' then {email} when 'ip' then {ip} when 'phone' then {phone} when 'card' then {card} when 'iban' then {iban} when 'ssn' then {ssn} end"


def _name() -> str:
    """SQL: a made-up name in lower case, from the hash h, the attempt, the script of norm and the
    gender, which the ending shows."""
    cases = []
    pick = lambda letters, i: f"substring('{letters}', {_byte('h', i)} % {len(letters)} + 1, 1)"
    for script, (consonants, vowels, female, male) in SCRIPTS.items():
        body = f"array_join(transform(sequence(1, {SYLLABLES} + attempt), k -> concat({pick(consonants, '2 * k')}, {pick(vowels, '2 * k + 1')})), '')"
        cases.append(f"when norm rlike {quoted(script)} then concat({body}, {pick(consonants, '0')}, case gender when 'f' then '{female}' when 'm' then '{male}' else '{vowels[1]}' end)")
    return "case " + " ".join(cases) + " end"


def _styled(made: str, raw: str) -> str:
    return f"if({raw} = upper({raw}), upper({made}), initcap({made}))"


def _found(hits: DataFrame, row: str, text: str) -> DataFrame:
    """One row per occurrence: row, at, kind, gender, raw, norm, valid."""
    rx = quoted(ANY)
    kind = "case " + " ".join(f"when raw rlike {quoted('^(?:' + p + ')$')} then '{k}'" for k, p in PATTERNS.items() if k not in ("given", "surname"))
    # a name is a given name when the next match follows after one blank
    kind += " when next = ' ' and gap <> ' ' then 'given' else 'surname' end"
    title = lambda g: f"gap rlike {quoted('(?:' + TITLES[g] + ')' + chr(92) + '.? $')}"
    gender = f"case when kind <> 'given' then '' when {title('f')} then 'f' when {title('m')} then 'm' else '' end"
    rows = hits.select(F.col(row).alias("row"), F.expr(f"split({text}, {rx}, -1)").alias("gaps"), F.expr(f"regexp_extract_all({text}, {rx}, 0)").alias("raws"))
    rows = rows.select("row", "gaps", F.posexplode("raws").alias("at", "raw")).select("row", "at", "raw", F.expr("gaps[at]").alias("gap"), F.expr("gaps[at + 1]").alias("next"))
    rows = rows.withColumn("kind", F.expr(kind)).withColumn("gender", F.expr(gender)).withColumn("norm", F.expr(_normal())).withColumn("valid", F.expr(VALID))
    return rows.select("row", "at", "kind", "gender", "raw", "norm", "valid")


def names(seen: DataFrame, key: str) -> DataFrame:
    """kind, gender (as found), norm, made (a name in lower case) and n (occurrences) of each
    distinct name; no two names of a kind are made the same, and none is a real one."""
    spark = seen.sparkSession
    kinds, p1 = stored(seen.where("kind in ('given', 'surname')").groupBy("kind", "norm", "gender").agg(F.count("*").alias("n")), "names")
    # a name with titles of one gender has it after other titles too
    genders = kinds.groupBy("kind", "norm").agg(F.max("gender").alias("last"), F.count_distinct(F.when(F.col("gender") != "", F.col("gender"))).alias("several"))
    whose = kinds.join(genders, ["kind", "norm"]).withColumn("of", F.when((F.col("gender") == "") & (F.col("several") == 1), F.col("last")).otherwise(F.col("gender")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    now, path = stored(whose.select("kind", "norm", F.col("of").alias("gender")).distinct().withColumn("attempt", F.lit(0)).repartition(parts, "norm"), "entities")
    real, p2 = stored(kinds.select("kind", F.col("norm").alias("made")).distinct(), "real-names")

    def drawn(e: DataFrame) -> DataFrame:
        h = F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "gender", "norm", F.col("attempt").cast("string")), 512)
        return e.withColumn("h", h).withColumn("made", F.expr(_name())).drop("h")

    while True:
        nth = F.row_number().over(Window.partitionBy("kind", "made").orderBy("attempt", "norm", "gender"))
        checked = drawn(now).join(real.withColumn("real", F.lit(1)), ["kind", "made"], "left").withColumn("again", (nth > 1) | F.col("real").isNotNull())
        after, to = stored(checked.select("kind", "norm", "gender", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"), "again").repartition(parts, "norm"), "entities")
        discard(spark, path)
        now, path = after.drop("again"), to
        if after.where("again").limit(1).count() == 0:
            break
    made = whose.join(drawn(now).select("kind", "norm", F.col("gender").alias("of"), "made"), ["kind", "norm", "of"]).select("kind", "gender", "norm", "made", "n")
    made, _ = stored(made, "made-names")
    discard(spark, path, p1, p2)
    return made


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The documents with surrogates in their texts, and ``pii``, the number of entities."""
    docs = docs.drop("pii")
    columns = docs.columns
    row, whole, fakes, made = fresh(docs, "row", "whole", "fakes", "made")
    t = f"coalesce(`{text}`, '')"
    quick = [f"contains({t}, {quoted(x)})" for x in ["@", *(title + end for title in _TITLE.split("|") for end in (" ", ". "))]]
    has = F.expr(f"({' or '.join(quick)} or {t} rlike {quoted(MAYBE)}) and {t} rlike {quoted(ANY)}")
    rest = docs.where(~has).withColumn("pii", F.lit(0).cast("long"))
    hits, _ = stored(docs.where(has).withColumn(row, F.monotonically_increasing_id()).withColumn(whole, F.expr(t)), "entities-texts")
    seen, _ = stored(_found(hits, row, whole), "occurrences")

    known = names(seen, key)
    each = F.concat_ws("\x1f", "kind", "gender", "norm")
    called = seen.where("kind in ('given', 'surname')").withColumn("name", each)
    called = split_join(called, known.select(each.alias("name"), "made", "n"), "name", seen.count())
    called, _ = stored(called.select("row", "at", "kind", "raw", "norm", "made"), "called")
    formal = seen.where("kind not in ('given', 'surname')")
    formal = formal.select("row", "at", F.when(F.col("valid"), F.expr(surrogate(key))).otherwise(F.col("raw")).alias("fake"), F.col("valid").cast("int").alias("one"))
    both = formal.union(called.select("row", "at", F.expr(_styled("made", "raw")), F.lit(1)))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("at", "fake"))), lambda x: x["fake"])
    by_row = both.groupBy(F.col("row").alias(row)).agg(in_order.alias(fakes), F.sum("one").cast("long").alias("pii"))
    # a word that is a given name here and a surname there is taken as the surname
    once = called.groupBy("row", "norm").agg(F.max_by("made", "kind").alias("made"))
    mentions = once.groupBy(F.col("row").alias(row)).agg(F.map_from_entries(F.collect_list(F.struct("norm", "made"))).alias(made))

    word = _let("get(ws, j)", "w", f"if({made}[lower(w)] is null, w, {_styled(f'{made}[lower(w)]', 'w')})")
    gap = _let(f"regexp_extract_all(g, {quoted(MENTION)}, 0)", "ws", f"array_join(transform(split(g, {quoted(MENTION)}, -1), (x, j) -> concat(x, coalesce({word}, ''))), '')")
    out = hits.join(by_row, row).join(mentions, row, "left")
    out = out.withColumn(text, F.expr(f"array_join(transform(split({whole}, {quoted(ANY)}, -1), (g, i) -> concat(if({made} is null, g, {gap}), coalesce(get({fakes}, i), ''))), '')"))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.char_length(text).cast("long"))
    return rest.unionByName(out.select(*columns, "pii"))


def query(spark, sf_dir: str) -> DataFrame:
    """With the key of ``spark.quillspark.pii.key``; where it is unset, a key is drawn for this
    run, so its surrogates can't be guessed, and differ from those of other runs."""
    from secrets import token_hex

    key = spark.conf.get("spark.quillspark.pii.key", None) or token_hex(32)
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key)

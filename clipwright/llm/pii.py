"""Private data: detected entities are replaced by keyed surrogates of the same type and format; DataFrame functions only.

Detection is one alternation of patterns.  A surrogate is drawn from SHA-256 of (key, kind, normal form, attempt), so an entity has
the same surrogate wherever it stands and however it is written (case of an e-mail address, spacing of a number).  Digits become digits,
letters letters of the same case and script, a card that passes the Luhn check passes it again, an IBAN keeps its country and gets right
check digits, a phone number keeps its country code, an address stays an address, and a name keeps its title's gender and its script.

A name is found by its title.  Where the same document has its words again without one, before or after, they are mentions of it and get the
same surrogate.  Only whole words in the same spelling are mentions, so inflected forms stay.

Collision check: over all distinct entities of the corpus, a surrogate that two entities would share, or that is itself an entity of the
corpus, is given up; the least entity keeps a shared one, the others draw again with the next attempt, until all are distinct.
Nearly always every entity keeps attempt 0 and the documents need no join at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, stage, table

#: Titles that a name may follow, by the gender they tell.
MALE = "Mr|Herr|Monsieur|Señor|Sr|г-н|господин|κύριος|κος"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|г-жа|госпожа|κυρία|κα"
EITHER = "Dr|Prof|Doctor|Professor|доктор|профессор"
#: One or more titles, and initials, which stay.
TITLE = rf"(?:(?:{MALE}|{FEMALE}|{EITHER})\.? ){{1,3}}(?:\p{{Lu}}\. ?){{0,2}}"
#: Letters of the scripts that a name may be in, beside Latin, and the lengths of a word of a name in those without capitals.
SCRIPTS = {
    "cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "armenian": r"\p{IsArmenian}", "han": r"\p{IsHan}", "hangul": r"\p{IsHangul}",
    "kana": r"[\p{IsHiragana}\p{IsKatakana}ー]", "arabic": r"\p{IsArabic}", "hebrew": r"\p{IsHebrew}", "devanagari": r"\p{IsDevanagari}",
}
LENGTHS = {"han": "1,4", "hangul": "2,5", "kana": "2,10", "arabic": "2,15", "hebrew": "2,15", "devanagari": "2,15"}
WORD = "|".join([r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?(?!\p{L})", *(f"{SCRIPTS[s]}{{{n}}}+(?!{SCRIPTS[s]})" for s, n in LENGTHS.items())])
WORD = f"(?:{WORD})"
LABELS = "password|passwd|pwd|token|secret|api_key|apikey|access_key"
#: A label and what parts it from its value.
LABELLED = rf"(?i:{LABELS})[\"']?\s{{0,2}}[=:]\s{{0,2}}"
#: A value: in quotes, or from 8 plain signs on, or with a digit and without brackets; to the quote or white space, less closing punctuation.
VALUE = (
    r"(?:\"(?=[^\"\s]*[A-Za-z0-9])[^\"\s]{8,}+|'(?=[^'\s]*[A-Za-z0-9])[^'\s]{8,}+"
    r"|[\"']?[A-Za-z0-9+/_-]{8,}+(?:[^\s\"'<>]*[^\s\"'<>.,;:!?)\]}])?"
    r"|(?=[^\s\"'<>()\[\]{}]*\d)[^\s\"'<>()\[\]{}]{7,}[^\s\"'<>()\[\]{}.,;:!?])"
)
PATTERNS = [
    r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}\p{M}._%+-]*+@[\p{L}\p{N}\p{M}-]+(?:\.[\p{L}\p{N}\p{M}-]+)*\.\p{L}{2,}",
    rf"(?<![A-Za-z]){LABELLED}{VALUE}",
    r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![0-9A-Za-z]|\.\d)",
    r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)",
    r"\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\d)",
    r"(?<![0-9A-Za-z.-])(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?![0-9A-Za-z-])",
    r"(?<![0-9A-Za-z-])\d{3}-\d{2}-\d{4}(?![0-9A-Za-z-])",
    r"(?<![0-9A-Za-z.-])\d(?:[ -]?\d){12,18}(?![0-9A-Za-z-])",
    rf"(?<!\p{{L}}){TITLE}{WORD}(?: {WORD})?",
]
PATTERN = "|".join(PATTERNS)
#: Cheap test that every text with an entity passes, since each pattern implies a part: an @, two near digits, a digit and a dot, a key's
#: first letters, a label in any case, or a title.
HINT = rf"@|\d.?.?\d|\d\.|AKIA|ASIA|{LABELLED}|(?<!\p{{L}})(?:{MALE}|{FEMALE}|{EITHER})\.? "
#: Country codes of telephone numbers (fixed values): those of one and two digits, all others have three.
COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

#: Parts of invented names: beginnings, then ends of male, female and other given names and of surnames.
NAMES = {
    "latin": {
        "stems": "Al Ber Cor Dan El Fer Gil Hal Iv Jor Kal Lor Mar Nor Or Per Ros Sil Tor Ul Val Wil Yor Zan", "m": "an bert do en fried ian mund on ric us vin win",
        "f": "a bella da ela gard ina ia linde na ora sa vira", "n": "ari ey is lin ory ren rin ris ry ti", "s": "berg dale feld ham ley man ner ridge son stein ton wood",
    },
    "cyrillic": {
        "stems": "Ал Бор Вал Гал Дан Ел Зор Ил Кир Лад Мир Ник Ол Пет Рад Сав Тим Фед", "m": "ей ан ий он слав мир ир ор", "f": "ина ья ана ира ея слава ора она", "n": "ти ша си ле ри ня",
        "s": "ов ин ев ский ник енко ук ич",
    },
    "greek": {"stems": "Αλ Βασ Γερ Δαμ Ελ Ζην Θαλ Καλ Λαμ Μελ Νικ Ορ Παν Σελ Τιμ Φαν", "m": "ος ης ων ας ιος ευς", "f": "ια η ινα ω ανα ιδα", "n": "ις υ ι ε", "s": "ιδης ακης οπουλος ινος ατος ελλης"},
    "armenian": {"stems": "Ար Բար Գոռ Դավ Եր Զար Կար Լև Մար Նար Սար Տիգ", "m": "են ամ ոն իկ", "f": "ինե ուհի անա իդա", "n": "ի ե ու", "s": "յան ունի ենց ոնց"},
    "han": {"stems": "安 白 常 方 高 江 康 林 明 宁 平 青 石 文 夏 云", "m": "刚 军 伟 峰", "f": "芳 娟 丽 婷", "n": "一 乐 和 宁", "s": "山 川 田 原 木 野"},
    "hangul": {"stems": "가 나 다 라 마 바 사 아 자 하", "m": "준 훈 석 철", "f": "희 숙 미 영", "n": "진 윤 현", "s": "람 솔 온 별"},
    "kana": {"stems": "アキ カズ サト タカ ナオ ハル マサ ユキ ヨシ リョ", "m": "オ スケ ロウ ト", "f": "コ ミ エ ナ", "n": "キ ラ ル", "s": "ヤマ カワ モリ ノ"},
    "arabic": {"stems": "بد جم حم رش زه سل طل عم فر كر مر ند", "m": "ان ير يم اد", "f": "ية اء ينة اح", "n": "ور وان ال", "s": "اوي وني ابي اسي"},
    "hebrew": {"stems": "אב בר גל דן הד זה טל יר לב מר נע שח", "m": "יאל ון ור ים", "f": "ית ה נה לה", "n": "י ל ן", "s": "מן סון ברג ני"},
    "devanagari": {"stems": "अम बल चं दे गो हर जय कम मन नर", "m": "ेश ीन राज दीप", "f": "िता ना ला या", "n": "न ल र", "s": "वाल कर नी देव"},
}
#: Letters that stand for letters beyond ASCII: (what they stand for, alphabet).
ALPHABETS = [
    (r"[\p{IsCyrillic}&&\p{Ll}]", "".join(map(chr, range(0x430, 0x450)))), (r"\p{IsCyrillic}", "".join(map(chr, range(0x410, 0x430)))),
    (r"[\p{IsGreek}&&\p{Ll}]", "".join(map(chr, range(0x3B1, 0x3C2)))), (r"\p{IsGreek}", "".join(map(chr, range(0x391, 0x3A1)))),
    (r"[\p{IsLatin}&&\p{Lu}]", "".join(map(chr, range(0xC0, 0xD7)))), (r"\p{IsLatin}", "".join(map(chr, range(0xE0, 0xF7)))),
    (r"\p{IsHan}", "".join(map(chr, range(0x4E00, 0x4E80)))), (r"\p{L}", "abcdefghijklmnopqrstuvwxyz"), (r"\p{N}", "0123456789"),
]


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def find_all(text: Column) -> Column:
    """The entities in a text, in order; empty for null."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def units(match: Column) -> Column:
    """What is replaced of one match: array of (kind, text); the rest of the match stays. A name has one or two units."""
    one = lambda kind, text: F.array(F.struct(F.lit(kind).alias("kind"), text.alias("text")))
    title = F.regexp_extract(match, f"^{TITLE}", 0)
    name = F.substring(match, F.length(title) + 1, F.length(match))
    script = F.lit("latin")
    for at, letters in SCRIPTS.items():
        script = F.when(name.rlike(letters), at).otherwise(script)
    told = lambda titles: title.rlike(rf"(?:^| )(?:{titles})\.? ")
    gender = F.when(told(FEMALE), "f").when(told(MALE), "m").otherwise("n")
    parts = F.split(name, " ")
    named = F.transform(
        parts,
        lambda p, i: F.struct(F.concat(F.when((F.size(parts) == 2) & (i == 0), "given ").otherwise("surname "), script, F.lit(" "), gender).alias("kind"), p.alias("text")),
    )
    labelled = F.regexp_extract(match, rf"^{LABELLED}[\"']?(.+)$", 1)
    return (
        F.when(match.rlike(f"^{LABELLED}"), one("secret", labelled))
        .when(match.contains("@"), one("email", match))
        .when(match.rlike(r"^(?:AKIA|ASIA)"), one("access", match))
        .when(title != "", named)
        .when(match.rlike(r"^[A-Z]{2}\d{2}"), one("iban", match))
        .when(match.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), one("ip", match))
        .when(match.rlike(r"^\d{3}-\d{2}-\d{4}$"), one("ssn", match))
        .when(match.rlike(r"^[+(]|^\d{3}([-.])\d{3}\1\d{4}$"), one("phone", match))
        .otherwise(one("card", match))
    )


def _national(text: Column) -> Column:
    """Digits of a telephone number behind its country code."""
    return F.regexp_replace(F.regexp_replace(text, COUNTRY, ""), r"\D", "")


def normal(kind: Column, text: Column) -> Column:
    """The form in which two ways to write one entity agree."""
    plain = F.regexp_replace(F.lower(text), r"[^0-9a-z]", "")
    return (
        F.when(kind == "phone", F.concat(F.when(text.startswith("+"), F.regexp_extract(text, COUNTRY, 1)).otherwise("1"), F.lit(" "), _national(text)))
        .when(kind.isin("card", "ssn", "iban"), plain)
        .when(kind.isin("email"), F.lower(text))
        .when(kind == "surname cyrillic f", F.regexp_replace(text, "а$", ""))
        .otherwise(text)
    )


def identity(kind: Column, text: Column) -> Column:
    """Kind and normal form; a surname is one entity for both genders."""
    return F.concat(F.regexp_replace(kind, r"^(surname \w+) [mfn]$", "$1"), F.lit("|"), normal(kind, text))


def _byte(hexes: Column, k: Column) -> Column:
    return F.conv(F.substring(hexes, (k % 128) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letter(ch: Column, b: Column) -> Column:
    """The sign that a byte draws for a digit or letter: of the same kind, case and script; other signs stay."""
    letters = F.when(ch.rlike("[0-9]"), "0123456789").when(ch.rlike("[a-z]"), "abcdefghijklmnopqrstuvwxyz").when(ch.rlike("[A-Z]"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    for those, these in ALPHABETS:
        letters = letters.when(ch.rlike(those), these)
    # The byte stands in the expression once, not with each alphabet: surrogates are drawn in many places of a plan.
    return _let(letters, lambda of: F.coalesce(F.substring(of, b % F.length(of) + 1, F.lit(1)), ch))


def _redrawn(text: Column, hexes: Column) -> Column:
    """Each digit and letter drawn anew by its place."""
    return F.when(F.length(text) == 0, text).otherwise(F.array_join(F.transform(F.split(text, ""), lambda ch, i: _letter(ch, _byte(hexes, i))), ""))


def _redrawn_right(text: Column, hexes: Column, most: Column) -> Column:
    """Each digit and Latin letter drawn anew by its place from the right, whatever signs part them; those beyond ``most`` places stay. For short texts."""

    def one(i):
        ch = F.substring(text, i, F.lit(1))
        place = F.length(F.regexp_replace(F.substring(text, i, F.length(text)), r"[^0-9A-Za-z]", ""))
        return F.when(place > most, ch).otherwise(_letter(ch, _byte(hexes, place)))

    return F.when(F.length(text) == 0, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), one), ""))


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn check of a string of digits; a multiple of 10 passes."""

    def add(total, i):
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add)


def _mod97(text: Column) -> Column:
    """Remainder by 97 of a string of digits and capital letters, letters as 10 to 35."""

    def add(rest, i):
        c = F.ascii(F.substring(text, i, F.lit(1)))
        return F.when(c < 65, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), F.lit(0), add)


def _words(role: str) -> Column:
    """Map from script to the parts of names for a role."""
    return F.create_map(*[x for script, parts in NAMES.items() for x in (F.lit(script), F.array(*map(F.lit, parts[role].split())))])


def surrogate(kind: Column, text: Column, attempt: Column, key: str) -> Column:
    """What stands for a unit at an attempt."""
    seed = F.concat(F.lit(f"{key}|"), identity(kind, text), F.lit("|"), attempt.cast("string"), F.lit("|"))
    hexes = F.concat(*[F.sha2(F.concat(seed, F.lit(str(k))), 256) for k in range(4)])

    def drawn(h):
        valid = _luhn(F.regexp_replace(text, r"\D", "")) % 10 == 0
        checked = lambda card: F.concat(
            F.substring(card, F.lit(1), F.length(card) - 1),
            ((F.right(card, F.lit(1)).cast("int") + 10 - _luhn(F.regexp_replace(card, r"\D", "")) % 10) % 10).cast("string"),
        )
        card = _let(_redrawn_right(text, h, F.length(F.regexp_replace(text, r"\D", "")) - 1), lambda c: F.when(valid, checked(c)).otherwise(c))
        local, domain = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
        host = F.when(F.size(F.split(domain, r"\.")) > 2, F.substring_index(domain, ".", 1)).otherwise("mail")
        email = F.concat(_redrawn(local, h), F.lit("@"), _redrawn(host, F.reverse(h)), F.lit(".example."), F.substring_index(domain, ".", -1))
        octets = F.array_join(F.transform(F.array(*map(F.lit, range(4))), lambda i: (_byte(h, i) % 254 + 1).cast("string")), ".")
        body = F.substring(text, F.lit(5), F.length(text))
        country = F.substring(text, 1, 2)
        check = lambda new: F.lpad((98 - _mod97(F.concat(F.regexp_replace(new, " ", ""), country, F.lit("00")))).cast("string"), 2, "0")
        iban = _let(_redrawn_right(body, h, F.lit(1_000_000)), lambda new: F.concat(country, check(new), new))
        out = (
            F.when(kind == "email", email)
            .when(kind == "ip", octets)
            .when(kind == "card", card)
            .when(kind == "phone", _redrawn_right(text, h, F.length(_national(text))))
            .when(kind == "iban", iban)
            .when(kind == "access", F.concat(F.substring(text, 1, 4), _redrawn(F.substring(text, F.lit(5), F.length(text)), h)))
            .when(
                (kind == "secret") & text.rlike("^[0-9a-f]+$"),
                F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(h, (i % 256) + 1, F.lit(1))), ""),
            )
        )
        script, gender = F.split_part(kind, F.lit(" "), F.lit(2)), F.split_part(kind, F.lit(" "), F.lit(3))
        stems = F.try_element_at(_words("stems"), script)
        role = F.when(kind.startswith("surname"), "s").otherwise(gender)
        ends = F.coalesce(*[F.when(role == r, F.try_element_at(_words(r), script)) for r in "mfns"])
        part = lambda words, k: F.try_element_at(words, (_byte(h, k) % F.greatest(F.size(words), F.lit(1)) + 1).cast("int"))
        more = F.when(attempt > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt, F.lit(1))), lambda i: F.lower(part(stems, i))), "")).otherwise("")
        end = part(ends, F.lit(100))
        feminine = F.when((kind == "surname cyrillic f") & end.isin("ов", "ин", "ев"), "а").otherwise("")
        out = out.when(kind.rlike("^(given|surname) "), F.concat(part(stems, F.lit(0)), more, end, feminine))
        # A secret with few letters and digits runs out of others like it: it grows with its attempts.
        return out.otherwise(F.concat(_redrawn(text, h), F.when((kind == "secret") & (attempt > 3), F.lower(F.hex(attempt))).otherwise("")))

    return _let(hexes, drawn)


def attempts(found: DataFrame, key: str) -> DataFrame:
    """(identity, attempt) of the entities whose attempt isn't 0, from ``found`` (kind, text) with one row for each way an entity is written."""
    known = stage(found.withColumn("identity", identity(F.col("kind"), F.col("text"))).groupBy("identity").agg(F.min(F.struct("kind", "text")).alias("e")).select("identity", "e.kind", "e.text"))
    open_, taken, n = known, known.select("identity"), 0
    moved = None
    while True:
        told = _let(surrogate(F.col("kind"), F.col("text"), F.lit(n), key), lambda new: identity(F.col("kind"), new))
        drawn = open_.select("identity", "kind", "text", told.alias("drawn"))
        first = drawn.groupBy("drawn").agg(F.min("identity").alias("identity"))
        free = stage(first.join(taken.select(F.col("identity").alias("drawn")), "drawn", "left_anti"))
        if n:
            won = free.select("identity", F.lit(n).alias("attempt"))
            moved = won if moved is None else moved.unionByName(won)
        open_ = stage(open_.join(free.select("identity"), "identity", "left_anti"))
        if open_.isEmpty():
            return moved
        taken = taken.unionByName(free.select(F.col("drawn").alias("identity")))
        n += 1


def replace_private(docs: DataFrame, key: str, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """(``docs`` with its entities replaced, name of a new column with the number of entities and mentions). All other columns stay.

    Null texts stay null, texts without entities stay as they are. Repeated rows give repeated rows.
    """
    text = F.col(f"`{text_col}`")
    count, matches, moved_col, joined, names_col, words_col, pieces_col = (fresh(docs, x) for x in ("n_entities", "matches", "moved", "id", "names", "words", "pieces"))
    found = docs.select(F.explode(find_all(text)).alias("m")).groupBy("m").count().select(F.explode(units(F.col("m"))).alias("u")).select("u.kind", "u.text").distinct()
    moved = attempts(found, key)
    out = docs.withColumn(matches, find_all(text))
    if moved is None:
        attempt_of = lambda _: F.lit(0)
    else:
        moved = stage(moved)
        each = docs.select(F.col(f"`{id_col}`").alias(joined), F.explode(find_all(text)).alias("m")).select(joined, F.explode(units(F.col("m"))).alias("u"))
        each = each.select(joined, identity(F.col("u.kind"), F.col("u.text")).alias("identity")).distinct().join(moved, "identity")
        held = each.groupBy(joined).agg(F.map_from_entries(F.collect_list(F.struct("identity", "attempt"))).alias(moved_col))
        out = out.join(held, F.col(f"`{id_col}`").eqNullSafe(F.col(joined)), "left").drop(joined)
        attempt_of = lambda who: F.coalesce(F.try_element_at(F.col(moved_col), who), F.lit(0))

    def told(match):
        return _let(
            units(match),
            lambda us: F.aggregate(
                us,
                F.struct(match.alias("left"), F.lit("").alias("done")),
                # The text before the unit, then its surrogate; what follows the last unit comes at the end.
                lambda acc, u: F.struct(
                    F.substring(acc["left"], F.instr(acc["left"], u["text"]) + F.length(u["text"]), F.length(acc["left"])).alias("left"),
                    F.concat(acc["done"], F.substring(acc["left"], F.lit(1), F.instr(acc["left"], u["text"]) - 1), surrogate(u["kind"], u["text"], attempt_of(identity(u["kind"], u["text"])), key)).alias("done"),
                ),
                lambda acc: F.concat(acc["done"], acc["left"]),
            ),
        )

    join = lambda rest, put: F.array_join(F.zip_with(rest, put, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    names, words, pieces = F.col(names_col), F.col(words_col), F.col(pieces_col)

    def renamed(word):
        """The surrogate of the first titled name of the document that is written so."""
        who = F.element_at(F.filter(names, lambda n: n["text"] == word), 1)
        return _let(who, lambda n: surrogate(n["kind"], n["text"], attempt_of(identity(n["kind"], n["text"])), key))

    titled = F.filter(F.col(matches), lambda m: m.rlike(f"^{TITLE}{WORD}"))
    out = out.withColumn(names_col, F.filter(F.flatten(F.transform(titled, units)), lambda n: F.length(n["text"]) > 1)).withColumn(
        pieces_col, F.when(F.size(matches) > 0, F.split(text, f"(?:{PATTERN})", -1))  # texts without entities are searched once
    )
    longest = F.reverse(F.sort_array(F.array_distinct(F.transform(names, lambda n: F.struct(F.length(n["text"]).alias("n"), n["text"].alias("text"))))))
    out = out.withColumn(words_col, F.when(F.size(names) > 0, F.concat(F.lit(r"(?<![\p{L}\p{M}])(?:"), F.array_join(longest["text"], "|"), F.lit(r")(?![\p{L}\p{M}])"))))
    between = F.transform(pieces, lambda p: F.when(F.regexp_like(p, words), join(F.split(p, words, -1), F.transform(F.regexp_extract_all(p, words, F.lit(0)), renamed))).otherwise(p))
    written = join(F.when(F.size(names) > 0, between).otherwise(pieces), F.transform(F.col(matches), told))
    # Pieces don't touch one another, so a line's end between them parts no mention and makes none.
    mentions = F.when(F.size(names) > 0, F.size(F.regexp_extract_all(F.array_join(pieces, "\n"), words, F.lit(0)))).otherwise(0)
    out = out.withColumn(count, F.size(matches) + mentions).withColumn(text_col, F.when(F.size(matches) > 0, written).otherwise(text))
    return out.drop(matches, names_col, words_col, pieces_col, *([moved_col] if moved is not None else [])), count


def op9_pii(spark: SparkSession, sf_dir: str, key: str = "surrogate key of the query") -> DataFrame:
    """doc_id, text with surrogates, n_entities, for every document."""
    out, count = replace_private(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
    return out.select("doc_id", "text", F.col(count).alias("n_entities"))


QUERIES = {"op9_pii": op9_pii}
ORACLES: dict[str, str] = {}

"""Surrogates for personal data, by DataFrame expressions alone.

Entities are found by one pattern: e-mail addresses, telephone numbers, IPv4 and IPv6
addresses, payment cards, social security numbers, IBANs, access keys, secrets
after words such as password=, and names after one to three titles (up to five words, with
particles, hyphens, apostrophes and initials; in capitals up to two). Where a text has
such a name, its later mentions without a title, in full or by the surname, are found too.

An entity is made of units, and each unit's surrogate is drawn from a keyed hash of
its canonical form and kind alone:

- an address has its local part and its domain, which all addresses there share;
- a name has its given names and its surname, which all names with it share, so that
  Mr John Smith and Mr Smith stay the same family;
- any other entity is one unit.

Surrogates have the same type and format: digits stay digits, letters stay letters of
their script and case, punctuation stays; octets stay octets; a card keeps its first
digit and, if it had a valid check digit, gets one; an address keeps its top-level
domain, a number its country code, a name its title and particles. Given names come
from a list of the title's gender in the name's script, surnames are made up in that
script. Letters of scripts that have no alphabet here become Latin ones. A secret
without any letter or digit gets letters and digits.

Distinct entities stay distinct: all units are gathered once, as sums per canonical
form, and a surrogate that two of them would share, or that is itself a unit of the
corpus, is drawn again with the next attempt number, until none is left. Only those
exceptions are joined back; all others follow from the key. Names that a text has
without a title only aren't found, nor are mentions by the given name alone. A name after
titles of both sexes or of none (Dr Kim Lee) gets given names of either.

Entities may be of any length: no pattern repeats a group in a way that takes the
stack, and no surrogate is put together in more than a few passes over its text.

Defined cases: a null text stays null and has no entities; an empty one stays
empty. Rows with the same text get the same text. Null ids need no care: rows are
told apart by text. An empty table gives an empty result. Extra columns of the
input are ignored by with_surrogates unless named in keep.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hinted, settled, small_enough

KEY = "sluice-surrogates-1"
#: After so many attempts each, a surrogate gets one letter or digit more than the
#: format has: where a format's space is nearly used up, distinctness comes first.
PATIENCE = 6
#: More rounds than this would mean that a format can't grow, which is an error.
MOST_ROUNDS = 60
#: Exceptions are broadcast up to this many, in all texts together.
BROADCAST_EXCEPTIONS = 200_000

LETTER = r"\p{L}\p{M}"
# Groups that repeat without a bound would recurse: a domain is one run of characters that ends as
# a domain does, and parts of names repeat possessively, each up to where it must end.
EMAIL = rf"(?<![{LETTER}\p{{N}}._%+-])[{LETTER}\p{{N}}._%+-]++@(?=[{LETTER}\p{{N}}-])[{LETTER}\p{{N}}.-]*\.\p{{L}}{{2,}}"
PHONE = (
    r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?![\w-])|(?<![\w-])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\w-])"
    r"|(?<![\w+.,-])00\d{1,3}(?:[ .-]\d{2,8}){2,4}(?![\w-])|(?<![\w+.,-])0\d{2,5}[ /-]\d{4,8}(?:[ -]\d{1,6})?(?![\w-])"
)
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IP = rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?![\w]|\.\d)"
HEX_GROUPS = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})"
IP6 = rf"(?<![\w:.])(?:{HEX_GROUPS}{{7}}|(?=:{{0,2}}[0-9A-Fa-f])(?:{HEX_GROUPS}{{0,6}})?::(?:{HEX_GROUPS}{{0,6}})?)(?![\w:])"
CARD = r"(?<![\w-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{3,4}(?![\w-])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])|(?<=(?:SSN|ssn)[:# ]{1,3})\d{9}(?![\w-])"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
ACCESS_KEY = r"(?<!\w)A(?:KI|SI)A[0-9A-Z]{16}(?!\w)"
#: After "password is" only what has a digit is taken for one.
SECRET = r"(?i:(?<!\w)(?:password|passwd|pwd|token|secret|api[_-]?key)) ?[=:] ?\"?[^\s\"]{6,}\"?|(?i:(?<!\w)(?:password|passwd)) is \"?(?=[^\s\"]*\d)[^\s\"]{6,}\"?"
MALE = ("Mr", "Sir", "Lord", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος", "Κος")
FEMALE = ("Mrs", "Ms", "Miss", "Lady", "Dame", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία", "Κα")
NEUTRAL = ("Dr", "Prof", "Professor", "Doktor", "Mx")
TITLES = MALE + FEMALE + NEUTRAL
PARTICLES = ("af", "al", "bin", "ben", "da", "das", "de", "del", "della", "den", "der", "di", "do", "dos", "du", "el", "ibn", "la", "le", "ten", "ter", "van", "von", "y", "zu", "zur")
#: Words of a name that stay as they are, in this case only: Ben and Al are given names.
KEPT = (*PARTICLES, "St.", "Ste.")
#: A name's word: a capital and letters, parts after hyphens, and after apostrophes with a capital.
NAME_WORD = rf"\p{{Lu}}(?:[{LETTER}]++|['’]\p{{Lu}}[{LETTER}]*+)(?:(?:-[{LETTER}]++|['’]\p{{Lu}}[{LETTER}]*+)(?![\p{{N}}_]))*+"
#: Scripts without capitals: two or three characters where words aren't parted, else one or two words.
PLAIN_NAME = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]{2,3}|\p{Lo}[\p{Lo}\p{M}]+(?: \p{Lo}[\p{Lo}\p{M}]+)?"
CAPITALS = rf"\p{{Lu}}[\p{{Lu}}\p{{M}}'’-]+"


def _one_of(words: Iterable[str]) -> str:
    """A pattern for any of the words, longer ones first."""
    return "|".join(w.replace(".", r"\.") for w in sorted(words, key=len, reverse=True))


TITLE_RUN = rf"(?:(?:{_one_of({*TITLES, *(t.upper() for t in TITLES)})})\.? ){{1,3}}"
NOT_AFTER, NOT_BEFORE = rf"(?<![{LETTER}\p{{N}}_])", rf"(?![{LETTER}\p{{N}}_])"
NAME = (
    rf"{NOT_AFTER}(?:(?:(?:{_one_of(TITLES)})\.? ){{1,3}}(?:(?:(?:{NAME_WORD}|\p{{Lu}}\.|{_one_of(KEPT)}) ){{0,4}}{NAME_WORD}{NOT_BEFORE}|{PLAIN_NAME})"
    rf"|(?:(?:{_one_of({t.upper() for t in TITLES})})\.? ){{1,3}}{CAPITALS}(?: {CAPITALS})?{NOT_BEFORE})"
)
KINDS = {"email": EMAIL, "secret": SECRET, "key": ACCESS_KEY, "iban": IBAN, "ip": IP, "ip6": IP6, "card": CARD, "ssn": SSN, "phone": PHONE, "name": NAME}
#: What an entity alone looks like where its pattern asks for something before it.
ALONE = {"ssn": r"\d{3}-?\d{2}-?\d{4}"}
ENTITY = "|".join(f"(?:{p})" for p in KINDS.values())
#: The kind of what names a person by a name that the same text has with a title.
MENTION = "mention"

SCRIPTS = ("latin", "cyrillic", "greek")
MALE_NAMES = (
    "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Noah Oscar Paul",
    "Антон Борис Виктор Глеб Денис Егор Иван Кирилл",
    "Αλέξης Γιάννης Κώστας Νίκος Πέτρος Σπύρος Τάσος Χρήστος",
)
FEMALE_NAMES = (
    "Anna Bella Clara Diana Emma Flora Greta Helena Irene Julia Klara Laura Maria Nora Olivia Paula",
    "Анна Вера Дарья Елена Ирина Ксения Мария Нина",
    "Άννα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία Χαρά",
)
VOWELS, CONSONANTS = ("aeiou", "аеиоу", "αεηιου"), ("bdfgklmnprstvz", "бвгдзклмнпрст", "βγδκλμνπρστ")
#: First and last character of a range, and what its characters are replaced with.
ALPHABETS = (
    ("0", "9", "0123456789"),
    ("a", "z", "abcdefghijklmnopqrstuvwxyz"),
    ("A", "Z", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("а", "я", "абвгдежзийклмнопрстуфхцчшщъыьэюя"),
    ("А", "Я", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"),
    ("α", "ω", "αβγδεζηθικλμνξοπρστυφχψω"),
    ("Α", "Ω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    ("À", "Þ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"),
    ("ß", "ÿ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"),
    ("ά", "ί", "άέήί"),
    ("ό", "ώ", "όύώ"),
    ("Ά", "Ώ", "ΆΈΉΊΌΎΏ"),
    ("ѐ", "ӿ", "ёђѓєѕіїјљњћќўџ"),
    ("Ѐ", "Џ", "ЁЂЃЄЅІЇЈЉЊЋЌЎЏ"),
    ("א", "ת", "אבגדהוזחטיכלמנסעפצקרשת"),
    ("ء", "ي", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"),
    ("अ", "ह", "कखगघचछजझटठडढतथदधनपफबभमयरलवशसह"),
    ("ぁ", "ゖ", "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ"),
    ("ァ", "ヺ", "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ"),
    ("가", "힣", "가나다라마바사아자차카타파하고노도로모보소오조초코토포호구누두루무부수우주추쿠투푸후"),
    ("㐀", "鿿", "安白蔡曹陈程丁董杜范方冯高郭韩何胡黄江姜金孔李梁林刘陆罗吕马孟潘彭秦沈宋孙唐田王魏吴夏谢徐许杨叶于余袁张赵郑周朱"),
)
#: Latin letters beyond these ranges, by case.
OTHER_LOWER, OTHER_UPPER = "āăąćčďđēęěğģīįķļłńņňōőœŕřśşšťţūůűųźżž", "ĀĂĄĆČĎĐĒĘĚĞĢĪĮĶĻŁŃŅŇŌŐŒŔŘŚŞŠŤŢŪŮŰŲŹŻŽ"
HEX, PLAIN = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789"
MARK = "\x1f"
FOUND = "array<struct<entity: string, kind: string, units: array<struct<kind: string, canon: string>>>>"


def kind_of(e: Column) -> Column:
    out = None
    for name, pattern in KINDS.items():
        # An entity is judged alone, so what stands around it doesn't matter any more.
        test = e.rlike(rf"\A(?:{ALONE.get(name, pattern)})\z")
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit(MENTION))


def may_have_entities(text: Column) -> Column:
    """What every text with an entity satisfies, by plain searches that cost little."""
    out = text.rlike(r"\d[\d ()./-]{5}")
    spelled = {*TITLES, *(t.upper() for t in TITLES)}
    # A title that begins as another one does is found with it.
    starts = sorted(t for t in spelled if not any(t != u and t.startswith(u) for u in spelled))
    for part in ("@", "=", ":", "AKIA", "ASIA", "assword is ", "asswd is ", "ASSWORD is ", *starts):
        out = out | F.contains(text, F.lit(part))
    return out


def secret_value(e: Column) -> Column:
    return F.regexp_extract(e, r"(?:[=:]| is) ?\"?([^\s\"]+)", 1)


def titles_of(e: Column) -> Column:
    """A name's titles, with the space after them."""
    return F.regexp_extract(e, rf"\A({TITLE_RUN})", 1)


def bare_name(e: Column) -> Column:
    """A name without its titles."""
    return F.regexp_replace(e, rf"\A{TITLE_RUN}", "")


def _lower_words(e: Column) -> Column:
    """A name's words but titles and particles, in lower case."""
    return F.transform(F.filter(F.split(bare_name(e), " "), lambda w: ~w.isin(*KEPT)), lambda w: F.lower(w))


def bare_forms(found: Column) -> Column:
    """How a text may mention those whom it names with a title: structs of the words, in
    full or the surname alone, and their units; longer ones first. found: structs of
    entity, kind and units."""

    def forms(x: Column) -> Column:
        name = bare_name(x["entity"])
        last = F.element_at(F.split(name, " "), -1)
        full, surname = (F.struct(text.alias("form"), own.alias("units")) for text, own in ((name, x["units"]), (last, F.slice(x["units"], F.lit(-1), F.lit(1)))))
        return F.array(full, surname)

    # Where words aren't parted or have no capitals, a short name could be part of any word.
    named = F.filter(found, lambda x: (x["kind"] == "name") & bare_name(x["entity"]).rlike(r"\p{Lu}"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(named, forms))), lambda a, b: F.length(b["form"]) - F.length(a["form"]))


def entity_or_mention(forms: Column) -> Column:
    """The pattern of all entities and of what stands in forms."""
    words = F.array_join(F.array_distinct(F.transform(forms, lambda f: F.regexp_replace(f["form"], r"([.()\[\]{}^$*+?|\\])", r"\\$1"))), "|")
    return F.concat(F.lit(rf"{ENTITY}|{NOT_AFTER}(?=\p{{Lu}}|{_one_of(KEPT)})(?:"), words, F.lit(rf"){NOT_BEFORE}"))


def units(e: Column, kind: Column) -> Column:
    """What an entity is made of: structs of kind and canonical form, which is the same
    however the entity is spaced, punctuated or cased."""

    def unit(name: Column | str, canon: Column) -> Column:
        return F.struct((F.lit(name) if isinstance(name, str) else name).alias("kind"), canon.alias("canon"))

    words = _lower_words(e)
    title = F.transform(F.split(F.rtrim(titles_of(e)), " "), lambda t: F.upper(F.rtrim(t, F.lit("."))))
    male, female = (F.arrays_overlap(title, F.array(*[F.lit(t.upper()) for t in ts])) for ts in (MALE, FEMALE))
    gender = F.when(male & ~female, F.lit("given-m")).when(female & ~male, F.lit("given-f")).otherwise(F.lit("given-n"))
    surname = unit("surname", F.element_at(words, -1))
    bare = F.lower(F.regexp_replace(e, r"[^\p{L}\p{N}]", ""))
    return (
        F.when(kind == "email", F.array(unit("email", F.lower(e)), unit("domain", F.lower(F.regexp_extract(e, r"@(.*)\z", 1)))))
        .when(kind == "name", F.when(F.size(words) > 1, F.array(unit(gender, F.array_join(words, " ")), surname)).otherwise(F.array(surname)))
        .when(kind == "secret", F.array(unit(kind, secret_value(e))))
        .when(kind == "ip", F.array(unit(kind, e)))
        .when(kind == "ip6", F.array(unit(kind, F.lower(e))))
        .when((kind == "phone") & e.startswith("+"), F.array(unit(kind, F.concat(F.lit("+"), bare))))
        .when((kind == "phone") & e.startswith("00"), F.array(unit(kind, F.concat(F.lit("+"), F.substring(bare, F.lit(3), F.length(bare))))))
        .otherwise(F.array(unit(kind, bare)))
    )


def table(parts: Iterable[str]) -> Column:
    """Fixed texts as an array, which the optimiser makes one literal of."""
    return F.split(F.lit("|".join(parts)), r"\|")


def draw(seed: Column, i: Column, letters: Column) -> Column:
    """The letter that seed and i draw from letters."""
    return F.get(F.transform(F.array(letters), lambda x: F.substring(x, (F.pmod(F.xxhash64(seed, i), F.length(x)) + 1).cast("int"), F.lit(1))), 0)


def alphabet_of(c: Column) -> Column:
    """What a letter or digit is replaced with. Letters of no range here become Latin ones."""
    n = len(ALPHABETS)
    lows, highs = ("".join(x[k] for x in ALPHABETS) for k in (0, 1))
    inside = F.get(F.filter(F.sequence(F.lit(1), F.lit(n)), lambda k: (c >= F.substring(F.lit(lows), k, F.lit(1))) & (c <= F.substring(F.lit(highs), k, F.lit(1)))), 0)
    beyond = F.when(c.rlike(r"\p{IsLatin}"), F.when(c != F.lower(c), F.lit(n + 2)).otherwise(F.lit(n + 1))).when(c.rlike(r"\p{L}"), F.lit(2)).otherwise(F.lit(1))
    return F.element_at(table([x[2] for x in ALPHABETS] + [OTHER_LOWER, OTHER_UPPER]), F.coalesce(inside, beyond))


def substituted(s: Column, seed: Column) -> Column:
    """s with every digit or letter drawn anew from its own alphabet."""
    return F.array_join(F.transform(F.split(s, ""), lambda c, i: F.when(c.rlike(r"[\p{L}\p{N}]"), draw(seed, i, alphabet_of(c))).otherwise(c)), "")


def drawn_anew(s: Column, seed: Column, letters: str) -> Column:
    """s with every character drawn from letters."""
    return F.array_join(F.transform(F.split(s, ""), lambda c, i: draw(seed, i, F.lit(letters))), "")


def secret_text(value: Column, seed: Column) -> Column:
    made = drawn_anew(value, seed, HEX)
    return (
        F.when(value.rlike(r"\A[0-9a-f]+\z"), made)
        .when(value.rlike(r"\A[0-9A-F]+\z"), F.upper(made))
        .when(~value.rlike(r"[\p{L}\p{N}]"), drawn_anew(value, seed, PLAIN))
        .otherwise(substituted(value, seed))
    )


def filled(shape: Column, content: Column) -> Column:
    """shape with its digits and letters replaced in order by content's, in shape's case,
    and the rest of content, if it has more, at the end."""
    own = F.regexp_replace(content, r"[^\p{L}\p{N}]", "")
    # Bound once, so that a step takes the same time however long shape is.
    bound = F.struct(F.split(shape, r"[\p{L}\p{N}]", -1).alias("gaps"), F.split(own, "").alias("letters"), own.alias("own"), F.regexp_extract_all(shape, F.lit(r"[\p{L}\p{N}]"), F.lit(0)).alias("marks"))

    def put(b: Column) -> Column:
        def one(c: Column, k: Column) -> Column:
            letter = F.coalesce(F.get(b["letters"], k), F.lit(""))
            return F.concat(F.get(b["gaps"], k), F.when(c != F.lower(c), F.upper(letter)).otherwise(letter))

        rest = F.substring(b["own"], F.size(b["marks"]) + 1, F.length(b["own"]))
        return F.concat(F.array_join(F.transform(b["marks"], one), ""), F.element_at(b["gaps"], -1), rest)

    return F.get(F.transform(F.array(bound), put), 0)


def luhn_sum(digits: Column) -> Column:
    """The weighted digit sum whose last digit is 0 for a valid number."""

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weigh), F.lit(0), lambda a, x: a + x)


def card_digits(digits: Column, seed: Column) -> Column:
    head = F.concat(F.left(digits, F.lit(1)), F.substring(substituted(digits, seed), F.lit(2), F.length(digits) - 2))
    check = (F.pmod(10 - luhn_sum(F.concat(head, F.lit("0"))) % 10, F.lit(10))).cast("string")
    return F.concat(head, F.when(luhn_sum(digits) % 10 == 0, check).otherwise(F.right(substituted(digits, seed), F.lit(1))))


def script_of(word: Column) -> Column:
    """The place of word's script in SCRIPTS from 1, or 0."""
    return F.when(word.rlike(r"\p{IsCyrillic}"), 2).when(word.rlike(r"\p{IsGreek}"), 3).when(word.rlike(r"\p{IsLatin}"), 1).otherwise(0)


def made_up(word: Column, seed: Column, syllables: Column | int, ending: Column) -> Column:
    """A name of syllables in word's script, part by part where word has hyphens; after
    ending (a) it ends in a vowel, else in a consonant."""
    consonants, vowels = (lambda p: F.element_at(table(CONSONANTS), script_of(p))), (lambda p: F.element_at(table(VOWELS), script_of(p)))

    def part(p: Column, i: Column) -> Column:
        own = F.xxhash64(seed, i)
        syllable = F.transform(F.sequence(F.lit(1), F.lit(syllables)), lambda k: F.concat(draw(own, 2 * k, consonants(p)), draw(own, 2 * k + 1, vowels(p))))
        end = F.when(ending, F.concat(draw(own, F.lit(-3), consonants(p)), F.left(vowels(p), F.lit(1)))).otherwise(F.left(consonants(p), F.lit(1)))
        return F.when(script_of(p) > 0, F.concat(F.array_join(syllable, ""), end)).otherwise(substituted(p, own))

    return F.array_join(F.transform(F.split(word, "-"), part), "-")


def given_names(canon: Column, seed: Column, attempt: Column, kind: Column) -> Column:
    """New given names for all words of canon but the last, in lower case. An initial
    stays one, while draws last."""

    def one(w: Column, i: Column) -> Column:
        own = F.xxhash64(seed, i)
        listed = F.split(F.element_at(table([*MALE_NAMES, *FEMALE_NAMES]), script_of(w) + F.when(female, len(SCRIPTS)).otherwise(0)), " ")
        names = F.filter(listed, lambda x: F.lower(x) != w)
        pick = F.lower(F.when(script_of(w) > 0, F.get(names, F.pmod(own, F.size(names)).cast("int"))).otherwise(substituted(w, own)))
        short = F.when(w.endswith("."), F.concat(F.left(pick, F.lit(1)), F.lit("."))).otherwise(pick)
        return F.when(attempt < PATIENCE, short).otherwise(made_up(F.regexp_replace(w, r"\.", ""), own, 2, female))

    # Of a person of unknown sex all given names are drawn from one list.
    female = (kind == "given-f") | ((kind == "given-n") & (F.pmod(seed, F.lit(2)) == 0))
    words = F.split(canon, " ")
    return F.array_join(F.transform(F.slice(words, F.lit(1), F.size(words) - 1), one), " ")


def made(u: Column) -> Column:
    """The surrogate of a unit (kind, canon, attempt, seed), in canonical form. Given names
    and local parts are followed by the surname or domain that they are distinct under."""
    kind, canon, seed = u["kind"], u["canon"], u["seed"]
    extra = F.floor(u["attempt"] / PATIENCE).cast("int")
    letters, digits = (F.when(extra > 0, drawn_anew(F.repeat(F.lit("a"), extra), F.xxhash64(seed, F.lit(-2)), x)).otherwise(F.lit("")) for x in (ALPHABETS[1][2], ALPHABETS[0][2]))
    local, domain = F.regexp_extract(canon, r"\A([^@]*)@", 1), F.regexp_extract(canon, r"\A(?:.*@)?(.*)\z", 1)
    surname = F.element_at(F.split(canon, " "), -1)
    octets = F.array_join(F.transform(F.split(canon, r"\."), lambda o, i: (F.pmod(F.xxhash64(seed, i), F.lit(254)) + 1).cast("string")), ".")
    # The country code of a number stays, and so do the marks of a key or an account.
    kept = F.when(kind == "key", F.lit(4)).when(kind == "iban", F.lit(2)).when(kind == "phone", F.when(canon.rlike(r"\A\+[17]"), F.lit(2)).when(canon.startswith("+"), F.lit(3)).otherwise(F.lit(0))).otherwise(F.lit(0))
    plain = F.concat(F.left(canon, kept), F.substring(substituted(canon, seed), kept + 1, F.length(canon)), digits)
    return (
        F.when(kind == "email", F.concat(substituted(local, seed), letters, F.lit("@"), domain))
        .when(kind == "domain", F.concat(substituted(F.regexp_extract(canon, r"\A(.*)\.[^.]*\z", 1), seed), letters, F.regexp_extract(canon, r"(\.[^.]*)\z", 1)))
        .when(kind.isin("given-m", "given-f", "given-n"), F.concat(given_names(canon, seed, u["attempt"], kind), letters, F.lit(" "), surname))
        .when(kind == "surname", F.concat(made_up(canon, seed, 4, F.lit(False)), letters))
        .when(kind == "secret", F.concat(secret_text(canon, seed), letters))
        .when(kind == "ip", octets)
        .when(kind == "ip6", F.concat(F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when(c == ":", c).otherwise(draw(seed, i, F.lit(HEX)))), ""), digits))
        .when(kind == "card", F.concat(card_digits(canon, seed), digits))
        .otherwise(plain)
    )


def seeded(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """A unit with the seed of its surrogate."""
    seed = F.xxhash64(F.sha2(F.concat_ws(MARK, F.lit(key), kind, canon, attempt.cast("string")), 256))
    return F.struct(kind.alias("kind"), canon.alias("canon"), attempt.alias("attempt"), seed.alias("seed"))


def dressed_name(e: Column, own: Column) -> Column:
    """Title and particles of e as they were, its other words from its units' surrogates."""
    words = F.split(bare_name(e), " ")
    surname = F.element_at(own, -1)
    given = F.split(F.when(F.size(own) > 1, F.element_at(own, 1)).otherwise(F.lit("")), " ")

    def word(w: Column, i: Column) -> Column:
        before = F.size(F.filter(words, lambda x, j: (j < i) & ~x.isin(*KEPT)))
        made = F.when(i == F.size(words) - 1, surname).otherwise(F.get(given, before))
        titled = F.array_join(F.transform(F.split(made, "-"), lambda p: F.initcap(p)), "-")
        return F.when(w.isin(*KEPT), w).when((F.length(w) > 2) & (w == F.upper(w)), F.upper(made)).otherwise(titled)

    return F.concat(titles_of(e), F.array_join(F.transform(words, word), " "))


def dressed(x: Column) -> Column:
    """The surrogate of an entity (entity, kind, made: its units' surrogates), in its format."""
    e, kind, own = x["entity"], x["kind"], x["made"]
    first = F.element_at(own, 1)
    at = F.instr(e, F.lit("@"))
    # A domain may have grown; its end is put back as it was.
    stem = F.regexp_extract(e, r"@(.*)\.[^.]*\z", 1)
    email = F.concat(filled(F.left(e, at - 1), F.regexp_extract(first, r"\A([^@]*)@", 1)), F.lit("@"), filled(stem, F.regexp_extract(F.element_at(own, -1), r"\A(.*)\.[^.]*\z", 1)), F.regexp_extract(e, r"(\.[^.]*)\z", 1))
    secret = F.concat(F.regexp_extract(e, r"\A(\S+?(?: ?[=:]| is) ?\"?)", 1), first, F.when(e.endswith('"'), F.lit('"')).otherwise(F.lit("")))
    return F.when(kind == "email", email).when(kind == "secret", secret).when(kind == "ip", first).when(kind == "ip6", F.when(e.rlike("[A-F]") & (e == F.upper(e)), F.upper(first)).otherwise(first)).when(kind.isin("name", MENTION), dressed_name(e, own)).when((kind == "phone") & e.startswith("00"), filled(e, F.concat(F.lit("00"), first))).otherwise(filled(e, first))


def exceptions(found: DataFrame, key: str) -> DataFrame:
    """(mark, attempt) of the units (kind, canon) whose first surrogate is taken."""
    table = settled(found.select("kind", "canon").distinct().withColumn("attempt", F.lit(0)))
    known = table.select("kind", F.col("canon").alias("made"), F.lit(True).alias("real"))
    for _ in range(MOST_ROUNDS):
        unit = seeded(F.col("kind"), F.col("canon"), F.col("attempt"), key)
        drawn = table.withColumn("unit", unit).select("kind", "canon", "attempt", made(F.col("unit")).alias("made"))
        # Who has tried more often keeps what it has.
        keeps = drawn.groupBy("kind", "made").agg(F.min(F.struct(-F.col("attempt"), F.col("canon"))).alias("first"))
        clash = drawn.join(keeps, ["kind", "made"]).join(known, ["kind", "made"], "left")
        again = (F.col("canon") != F.col("first.canon")) | F.coalesce("real", F.lit(False))
        table = settled(clash.select("kind", "canon", F.col("attempt").alias("before"), (F.col("attempt") + again.cast("int")).alias("attempt")))
        last = table.where("attempt <> before").isEmpty()
        table = table.drop("before")
        if last:
            return table.where("attempt > 0").select(F.concat_ws(MARK, "kind", "canon").alias("mark"), "attempt")
    raise RuntimeError(f"some surrogates are still taken after {MOST_ROUNDS} rounds")


def with_surrogates(docs: DataFrame, text_col: str = "text", key: str = KEY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, text (with surrogates), n_entities and changed."""
    def described_by(pattern: Column) -> Column:
        entities = F.regexp_extract_all("__sl_text", pattern, F.lit(0))
        kinds = F.transform(entities, lambda e: F.struct(e.alias("entity"), kind_of(e).alias("kind")))
        return F.transform(kinds, lambda x: F.struct(x["entity"].alias("entity"), x["kind"].alias("kind"), units(x["entity"], x["kind"]).alias("units")))

    rows = docs.select(*keep, F.col(text_col).alias("__sl_text"))
    first = described_by(F.lit(ENTITY))
    found = rows.withColumn("__sl_first", F.when(may_have_entities(F.col("__sl_text")), first).otherwise(F.array().cast(FOUND)))
    named = found.withColumn("__sl_forms", F.when(F.exists("__sl_first", lambda x: x["kind"] == "name"), bare_forms(F.col("__sl_first"))))
    mentioned = F.size("__sl_forms") > 0
    known = lambda x: F.get(F.filter("__sl_forms", lambda f: f["form"] == x["entity"]), 0)["units"]
    with_mentions = F.transform(described_by(F.col("__sl_pattern")), lambda x: F.struct(x["entity"].alias("entity"), x["kind"].alias("kind"), F.when(x["kind"] == MENTION, known(x)).otherwise(x["units"]).alias("units")))
    patterned = named.withColumn("__sl_pattern", F.when(mentioned, entity_or_mention(F.col("__sl_forms"))).otherwise(F.lit(ENTITY)))
    described = patterned.select(*keep, "__sl_text", "__sl_pattern", F.when(mentioned, with_mentions).otherwise(F.col("__sl_first")).alias("__sl_found"))
    each = described.where(F.size("__sl_found") > 0).select("__sl_text", F.explode("__sl_found").alias("x")).select("__sl_text", F.explode("x.units").alias("u"))
    taken = settled(exceptions(each.select("u.*"), key))
    if taken.isEmpty():
        joined = described.withColumn("__sl_attempts", F.lit(None).cast("map<string,int>"))
    else:
        # Texts with an exception get their attempts as a map, by the text's digest.
        marked = each.select(F.sha2("__sl_text", 256).alias("__sl_sha"), F.concat_ws(MARK, "u.kind", "u.canon").alias("mark"))
        pairs = settled(marked.join(hinted(taken, BROADCAST_EXCEPTIONS), "mark").distinct())
        by_text = pairs.groupBy("__sl_sha").agg(F.map_from_entries(F.collect_list(F.struct("mark", "attempt"))).alias("__sl_attempts"))
        by_text = F.broadcast(by_text) if small_enough(pairs, BROADCAST_EXCEPTIONS) else by_text
        joined = described.withColumn("__sl_sha", F.sha2("__sl_text", 256)).join(by_text, "__sl_sha", "left")

    def attempted(u: Column) -> Column:
        attempt = F.coalesce(F.try_element_at("__sl_attempts", F.concat_ws(MARK, u["kind"], u["canon"])), F.lit(0))
        return seeded(u["kind"], u["canon"], attempt, key)

    ready = F.transform("__sl_found", lambda x: F.struct(x["entity"].alias("entity"), x["kind"].alias("kind"), F.transform(x["units"], attempted).alias("units")))
    finished = F.transform(ready, lambda x: F.struct(x["entity"].alias("entity"), x["kind"].alias("kind"), F.transform(x["units"], made).alias("made")))
    some = F.size("__sl_found") > 0
    text = F.array_join(F.zip_with(F.split("__sl_text", F.col("__sl_pattern"), -1), F.transform(finished, dressed), lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    return joined.select(
        *keep,
        F.when(some, text).otherwise(F.col("__sl_text")).alias("text"),
        F.size("__sl_found").cast("long").alias("n_entities"),
        some.alias("changed"),
    )

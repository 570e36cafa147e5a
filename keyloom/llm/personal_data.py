"""Problem 10: personal data in free text, found by typed patterns and replaced by keyed surrogates.

E-mail addresses, phone numbers, identity numbers and street addresses are told by their form. Names are told by form and
context: a full name in any of several scripts where a phrase speaks of a person, a given name followed by a surname, where
given names are a short list and what the corpus itself shows (words that stand first in names told by context, hardly
ever elsewhere). Each entity gets a replacement that depends on a key, its type and its canonical form only, so that one person,
number or address is replaced alike everywhere (coreference), in the format, script and gender of the original. Replacements
that clash with each other or with real entities of the corpus are drawn again until none does.
"""

import bisect
import hashlib
import hmac
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators.skew import spread
from keyloom.store import discard, written

#: Blanks or a line break with the marks of quoted mail.
S = r"(?:[ \t]+|[ \t]*\r?\n[ \t>|]*)"

#: Given names.
FEMALE = "Ada Agnes Alice Amira Ana Andrea Anna Anne Aisha Barbara Beatrice Bianca Carla Caroline Charlotte Chiara Claire Clara Dana Diana Elena Elif Elisa Elizabeth Ella Emily Emma Esther Eva Fatima Fiona Frida Giulia Greta Hanna Hannah Helen Helena Helga Ida Ines Ingrid Irene Iris Isabel Jana Jane Johanna Judith Julia Karin Katarina Lara Laura Lea Leila Lena Linda Lisa Lucia Maria Marie Marta Maya Mira Nadia Nina Nora Olga Paula Petra Rosa Ruth Sara Sarah Selma Silvia Sofia Sophie Susan Vera Yara Zoe".split()
MALE = "Adam Ahmed Alan Albert Alex Ali Andreas Anton Arno Arthur Ben Boris Bruno Carlos Christian Daniel David Diego Emil Eric Erik Felix Finn Frank Georg George Hans Hassan Henrik Hugo Igor Ivan Jakob James Jan Joao John Jonas Jorge Jose Karim Karl Kevin Lars Leo Liam Luca Lucas Luis Luka Marc Marco Mario Mark Martin Matteo Max Michael Miguel Milan Mohamed Nico Noah Oliver Omar Oskar Otto Pablo Paul Pavel Pedro Peter Philip Rafael Robert Samir Samuel Sergei Simon Stefan Sven Thomas Tim Tobias Tom Viktor Walter".split()
GIVEN = "|".join(sorted({*FEMALE, *MALE}, key=lambda w: (-len(w), w)))
#: Words with a capital that are no surnames, and what a street is called.
NOT_NAMES = frozenset("Regards Gruss Grüsse Best Thanks Thank Hello Hi Dear Cheers Street Road Lane Avenue Drive Court Close Square Factory Sort Join View Monday Tuesday Wednesday Thursday Friday Saturday Sunday The This That We It See Please Ask Call Patch Author Subject Contact Kontakt Reviewed Reported Signed Address Postal Phone Tel Fax Test Build Error And Or".split())
#: Capitalised words that lead up to a name or begin a sentence.
LEADS = frozenset("Yesterday Today Tomorrow Dr Prof Mr Mrs Ms Herr Frau Mme Sr Sra Ing Ask According Thanks To By From With On In At As If When While After Before And But For Then So Now Also Dear Hi Hello Hallo Author Contact Maintainer Note Der Die Das Ein Eine Le La Les El Los Monsieur Madame Is Are Was".split())
TITLES = r"(?:Dr|Prof|Mr|Mrs|Ms|Herr|Frau|Mme|Sr|Sra|Ing)\.?"

#: Letters of names: Latin with its extensions, Cyrillic, Greek.
UP = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĴĶĹĻĽĿŁŃŅŇŊŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽА-ЯЁІЇЄҐΑ-Ω"
LOW = "a-zß-öø-ÿā-žа-яёіїєґά-ώ"
NAME_PART = r"[^\W\d_a-z](?:[a-zß-öø-ÿā-ž]+|[’'][A-Z][a-z]+)(?:-[A-Z][a-z]+)?"
PART_TAIL = rf"(?:[{LOW}]+(?:[A-Z][a-z]+)?|[’'][{UP}][{LOW}]+)(?:-[{UP}][{LOW}]+)*"
PART = rf"[{UP}]{PART_TAIL}"
#: The first part of a name; the capital comes first, so that the search skips to it.
HEAD = rf"[{UP}](?<![\w@.'’/$#-][{UP}]){PART_TAIL}"
PARTICLE = r"(?:van|von|der|den|de|del|della|di|da|dos|du|la|le|el|al|bin|ibn|ben|ter|zu)"
INITIAL = r"[A-Z]\."
def _trie(words: set[str]) -> str:
    """A pattern for a set of words that shares their first letters; longer words first."""
    heads: dict[str, list[str]] = {}
    for w in sorted(words, key=lambda w: (-len(w), w)):
        heads.setdefault(w[0], []).append(w[1:])
    return "|".join(h + "(?:" + "|".join(map(re.escape, tails)) + ")" for h, tails in sorted(heads.items()))


DOMAIN = re.compile(r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w@])")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.+%-")
SPELT = re.compile(
    rf"(?<![\w.+@-])[A-Za-z0-9_][\w.+-]*{S}?(?:\((?:at|AT|ät|a)\)|\[(?:at|AT)\]|\{{(?:at|AT)\}}|<at>){S}?[A-Za-z0-9-]+(?:(?:\.|{S}?(?:\(dot\)|\[dot\]|\{{dot\}}){S}?|{S}(?:dot|DOT){S})[A-Za-z0-9-]+)+"
    rf"|(?<![\w.+@-])[A-Za-z0-9_][\w.+-]*{S}AT{S}[A-Za-z0-9-]+(?:(?:\.|{S}(?:dot|DOT){S})[A-Za-z0-9-]+)+"
    rf"|(?<![\w.+@-])[A-Za-z0-9_][\w.+-]*{S}at{S}[A-Za-z0-9-]+(?:{S}(?:dot|DOT){S}[A-Za-z0-9-]+)+"
)
SPELT_SIGNS = ("(at)", "[at]", "{at}", "<at>", "(a)", "(AT)", "[AT]", "(ät)", "AT", "dot", "DOT")
MACHINES = re.compile(r"(?i)(?:git|svn|hg|cvs|no-?reply|do-?not-?reply|.*[-_.]bot|bot|jenkins|builds?|ci|root|daemon|mailer-daemon|postmaster|nobody|notifications?|automation|cron)(?:\+.*)?")
PHONE = re.compile(
    r"""[+(0-9](?<![\w.+\-/:#=(].)(?:
      (?<=\+)\d{1,3}[ .\-/]?(?:\(\d{1,5}\)|\d{1,5})(?:[ .\-/]\d{2,8}){1,5}
    | (?<=\+)\d{8,14}
    | (?<=0)0\d{1,3}[ .\-/]?(?:\(\d{1,5}\)|\d{1,5})(?:[ .\-/]\d{2,8}){1,5}
    | (?<=0)0\d{2}[ ]\(\d{1,5}\)[ ]?\d{5,9}
    | (?<=\()\d{3}\)[ ]?\d{3}[-. ]\d{4}
    | (?<=\()0\d{1,4}\)[ ]?\d{3,9}(?:[-. ]\d{2,5}){0,3}
    | (?<=[2-9])\d{2}[-.]\d{3}[-.]\d{4}
    | (?<=0)\d(?:\.\d{2}){4}
    | (?<=0)\d(?:[ ]\d{2}){4}
    | (?<=0)\d{1,4}/\d{3,8}(?:-\d{1,5})?
    | (?<=0)\d{3,4}[ ]\d{3}[ ]\d{3,4}
    | (?<=0)\d{2,4}[ -]\d{6,8}
    )(?![\w]|[-.]\d)""",
    re.VERBOSE,
)
LABEL = r"(?i:ssn|social\s+security(?:\s+(?:no|nr|number|num))?|soc\.?\s*sec\.?(?:\s+no)?|national\s+(?:id|insurance)(?:\s+(?:no|number))?|nino|ahv(?:-?\s?(?:nr|nummer))?|avs|steuer-?\s?(?:id(?:-?nr|entifikationsnummer)?|nummer|nr)|idnr|tax(?:payer)?\s+(?:id(?:entification)?|identification)(?:\s+(?:no|nr|number))?|personal\s+(?:id(?:entity)?\s+)?(?:number|no)|personnummer|personal-?nr|born/id|identity\s+(?:card|number|no)(?:\s+(?:no|number))?|id\s+card(?:\s+(?:no|number))?|id\s+(?:number|no)|passport(?:\s+(?:no|nr|number))?|reisepass(?:-?\s?nr|nummer)?|passeport|pasaporte|ausweis(?:-?\s?nr|nummer)?|personalausweis|pesel|insee|codice\s+fiscale)|TIN|DNI|NIE|NIR|CPF"
IDNUM = re.compile(rf"(?<![\w-])(?:{LABEL})(?:\.|\b)[ \t]*[:#=]?{S}?(?:is{S})?((?:[A-Z]{{1,3}}[ ]?)?\d[\dA-Z]*(?:[ .\-/]\d[\dA-Z]*)*)(?!\w)")
LABEL_SIGNS = ("ssn", "social", "soc.", "national", "nino", "ahv", "avs", "steuer", "idnr", "tax", "personal", "personnummer", "born/id", "identity", "id card", "id number", "id no", "passport", "reisepass", "passeport", "pasaporte", "ausweis", "pesel", "insee", "codice")
LABEL_CAPITALS = ("TIN", "DNI", "NIE", "NIR", "CPF")
BARE_ID = re.compile(r"[0-9](?<![\w.-].)(?:(?<=7)56\.\d{4}\.\d{4}\.\d{2}|\d{2}-\d{2}-\d{4})(?![\w-]|\.\d)")

#: Addresses are looked for around the word that names the street.
STREETS = r"(?:Street|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Drive|Court|Ct\.|Close|Square|Boulevard|Blvd\.?|Terrace|Crescent|Way|Place|Parkway|Row|Hill|Gardens|Walk|Alley|Grove|Mews|St\.|Dr\.)"
STREET_WORD = re.compile(rf"{STREETS}(?!\w)")
STREET_BEFORE = re.compile(rf"(?<![\w.+@/#-])\d{{1,5}}[a-zA-Z]?{S}(?:[NSEW]\.?{S})?(?:{NAME_PART}{S}){{1,3}}\Z")
#: From the last digit of the number on, since digits are rarer than the letters of these words.
RUE_WORD = re.compile(rf"[0-9](?:{S}?(?:bis|ter|quater))?,?{S}(rue|avenue|chemin|boulevard|place|allée|impasse|quai|route|cours|square|passage|faubourg)(?=[ \t\r\n])")
RUE_BEFORE = re.compile(rf"(?<![\w.+@/#-])\d{{1,5}}(?:{S}?(?:bis|ter|quater))?,?{S}\Z")
RUE_AFTER = re.compile(rf"{S}(?:(?:de{S}la|des|de|du){S}|(?:de{S})?[ld]['’])?{NAME_PART}")
GASSE_WORD = re.compile(rf"(?:straße|strasse|str\.|gasse|weg|platz|allee|ring|damm|ufer|steig|graben|markt){S}\d{{1,4}}(?:[ ]?[a-z]\b)?(?![\w.-]*\d)")
GASSE_BEFORE = re.compile(r"(?<![\w-])[A-ZÄÖÜ][a-zäöüß-]+\Z")
CALLE = re.compile(rf"(?:Calle|Avenida|Avda\.|Plaza|Paseo|Carrera|Via|Viale|Piazza|Corso|Rua|ulica|ul\.|aleja|al\.)(?={S}){S}(?:(?:de|del|de{S}la|di|da|do){S})?{NAME_PART}(?:{S}{NAME_PART})?,?{S}(?:n[.º°]?{S}?)?\d{{1,4}}[a-z]?(?!\w)")

#: Names are looked for around a given name, an initial, or a phrase that follows a person.
CUES = rf"(?:[Aa]sk|[Aa]ccording{S}to|[Tt]hanks{S}to|[Bb]y:?|cc:?|CC:?|Cc:?|[Tt]alked{S}to|[Cc]ontact:?|[Kk]ontakt:?|[Aa]uthor:?|[Ff]rom:?|[Tt]o:|[Mm]aintainer:?|[Ww]ith|(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day|{TITLES})"
AFTER = rf"(?:,{S}who\b|{S}wrote\b|{S}about{S}this|{S}\(see{S}above\)|{S}before{S}you|{S}?,?{S}?[<(\[]?[\w.+-]+(?:@|{S}?[(\[]at[)\]]|{S}AT{S}|{S}at{S}[\w-]+{S}dot))"
GIVEN_WORD = re.compile(rf"(?:{_trie({*FEMALE, *MALE})})(?![\w@'’-])")
SURNAME = re.compile(rf"(?:{S}{INITIAL}|{S}(?:{GIVEN})(?!\w)(?={S}{NAME_PART}))?{S}(?:(?:van|von|de|der|di|da|la|le|del){S})*({NAME_PART}|[A-ZÀ-Þ]{{3,}})(?![\w@])")
REVERSED = re.compile(rf"(?<![\w@.'’-])({NAME_PART}|[A-ZÀ-Þ]{{3,}}),{S}\Z")
INITIAL_AFTER = re.compile(rf"{S}{INITIAL}(?!\w)")
INITIAL_WORD = re.compile(r"[A-Z]\.(?=[ \t\r\n,A-Z<(])")
INITIAL_NAME = re.compile(rf"(?:{S}?{INITIAL})?{S}({NAME_PART})(?![\w@(])")
BEFORE = re.compile(rf"(?:(?<!\w){CUES}|-by:?|=[ ]?[\"']|@author){S}?(?:{TITLES}{S})?\Z")
FOLLOW = re.compile(AFTER)
PHRASE = re.compile(r"(?:, who\b|wrote\b|about this|\(see above\)|before you)")
CUED = re.compile(rf"(?<![\w@.-]){CUES}{S}(?:{TITLES}{S})?(?P<name>(?P<first>{NAME_PART}){S}(?P<last>{NAME_PART})){S}?\Z")
BACK = 90
#: A full name of any given name: two to four parts, initials and particles between them.
FULL = re.compile(rf"{HEAD}(?=[ \t])(?:[ \t]+[{UP}]\.|[ \t]+{PARTICLE}|[ \t]+{PART}){{0,3}}[ \t]+{PART}(?![\w@(/$'’]|-\w|\.\w)")
#: Phrases right before and right after a person's full name.
PERSON_BEFORE = re.compile(
    rf"(?:(?<!\w)(?:[Aa]sk(?:ed)?|[Aa]ccording{S}to|[Tt]hanks?(?:{S}to)?|[Tt]hank{S}you,?|[Tt]alk(?:ed)?{S}(?:to|with)|[Ss]p(?:ea|o)ke?{S}(?:to|with)|[Mm]eet|[Mm]et|[Ee]-?mailed|[Pp]honed|[Cc]ontact(?:ed)?|[Ii]nvited?|[Hh]ired|[Ii]nterviewed|[Mm]y{S}name{S}is|[Ii]{S}am|[Dd]ear|[Hh]i|[Hh]ello|[Hh]allo|[Bb]onjour|{TITLES}|(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day,?|[Сс]пасибо,?|[Сс]просите(?:{S}у)?|[Уу]важаем(?:ый|ая)|请问|感谢|联系|请)"
    rf"|(?:-by|@author|(?<!\w)(?:[Aa]uthors?|[Cc]ontact|[Kk]ontakt|[Ff]rom|[Tt]o|[Cc][Cc]|[Mm]aintainer|[Rr]eporter|[Rr]eviewer|[Aa]ssignee|[Nn]ame|[Ww]ritten{S}by|[Rr]eported{S}by|[Ff]ixed{S}by|Автор|Контакт|作者|联系人|姓名))[ \t]*[:：]"
    rf"|(?<!\w)(?:[Ww]ritten|[Rr]eported|[Rr]eviewed|[Ss]igned|[Ff]ound|(?:[Cc]o-)?[Aa]uthored|[Ss]uggested|[Tt]ested){S}by){S}?(?:{TITLES}{S})?\Z"
)
PERSON_AFTER = re.compile(
    rf"(?:,{S}who\b|{S}(?:wrote|writes|said|says|asked|suggested|reported|noticed|mentioned|thinks|told|replied|answered|phoned|agrees|lives|писал[аи]?|говорит)\b|{S}about{S}this|{S}\(see{S}above\)|{S}before{S}you|{S}can{S}be{S}reached|{S}[<(\[][\w.+-]+(?:@|{S}?[(\[]at[)\]]|{S}AT{S}|{S}at{S}[\w-]+{S}dot)|[,:(]?{S}?\(?\+\d|[ ]?(?:先生|女士|老师|写道|さん))"
)
#: What closes a letter, on the line before the name.
CLOSING = re.compile(r"(?:^|\n)[ \t>|]*(?:(?:[Bb]est|[Kk]ind|[Ww]arm)?[ ]?[Rr]egards|[Bb]est|[Cc]heers|[Tt]hanks|[Ss]incerely|[Yy]ours|[Gg]r(?:uss|uß|üße|üsse)|[Cc]ordialement|[Ss]aludos|С уважением|此致)[,!.]?[ \t]*(?:\n[ \t>|]*)+\Z")
#: Surnames of one character that are frequent in Chinese, and Korean ones; one or two characters follow.
HAN_SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
HANGUL_SURNAMES = "김이박최정강조윤장임한오서신권황안송류홍"
HAN_NAME = re.compile(rf"(?<![\u4e00-\u9fff\uac00-\ud7a3])(?:[{HAN_SURNAMES}][\u4e00-\u9fff]{{1,2}}|[{HANGUL_SURNAMES}][\uac00-\ud7a3]{{2}})(?![\u4e00-\u9fff\uac00-\ud7a3])")
HAN_AFTER = re.compile(rf"[{HAN_SURNAMES}][\u4e00-\u9fff]{{1,2}}(?=先生|女士|老师|写道|说)")
HAN_LABEL = re.compile(rf"(?:作者|联系人|姓名)[：:][ ]?([{HAN_SURNAMES}][\u4e00-\u9fff]{{1,2}})(?![\u4e00-\u9fff])")
#: Endings of East Slavic surnames, which tell a name without further context.
SLAVIC = re.compile(r"(?:ов|ова|ев|ева|ёв|ёва|ин|ина|ын|ына|ский|ская|цкий|цкая|енко|чук|юк|швили|дзе|ян)\Z")
#: A word is learned as a given name if it begins LEAST_SEEN names told by context, in LEAST_SHARE or more of its texts, and is hardly ever written small.
LEAST_SEEN, LEAST_SHARE, MOST_SMALL = 2, 0.02, 0.3


def _before(pattern: re.Pattern, text: str, at: int, back: int = BACK) -> re.Match | None:
    """The match of a pattern that ends at a place."""
    return pattern.search(text, max(0, at - back), at)


def _line_alone(text: str, a: int, b: int) -> bool:
    """Whether nothing else stands on the lines of a piece."""
    start, end = text.rfind("\n", 0, a) + 1, text.find("\n", b)
    return not text[start:a].strip(" \t>|") and not text[b : end if end >= 0 else len(text)].strip()


def _person(text: str, a: int, b: int) -> bool:
    """Whether a piece stands where a person is spoken of."""
    return bool(_before(PERSON_BEFORE, text, a) or PERSON_AFTER.match(text, b)) or _line_alone(text, a, b) and bool(_before(CLOSING, text, a, 60))


def full_names(text: str) -> Iterator[tuple[int, int, str, bool]]:
    """(start, end, first word, told by context) of each piece that has the form of a full name."""
    for m in FULL.finditer(text):
        a, b = m.span()
        words = text[a:b].split()
        # a capital at the beginning of a sentence, or a title, may be no part of the name
        while len(words) > 2 and (words[0] in NOT_NAMES or words[0] in LEADS):
            a += len(words[0])
            a += len(text[a:b]) - len(text[a:b].lstrip())
            words = words[1:]
        if words[0] in LEADS or NOT_NAMES.intersection(words):
            continue
        yield a, b, words[0], _person(text, a, b)


REVERSED_FULL = re.compile(rf"{HEAD},[ \t]+{PART}(?:[ \t]+[{UP}]\.)?(?![\w@(/$'’,]|-\w|\.\w)")


def _general_names(text: str, learned: frozenset) -> Iterator[tuple[int, int]]:
    for a, b, first, told in full_names(text):
        if told or first in learned or first[0] > "Ͽ" and SLAVIC.search(text[a:b]):
            yield a, b
            continue
        for m in list(re.finditer(r"\S+", text[a:b]))[1:-1]:
            if m.group() in learned:
                yield a + m.start(), b
                break
    for m in REVERSED_FULL.finditer(text):
        last, first = re.findall(r"[^\s,]+", m.group())[:2]
        if last not in LEADS and not NOT_NAMES & {first, last} and (_before(PERSON_BEFORE, text, m.start()) or first in learned):
            yield m.span()
    if not text.isascii():
        for m in HAN_NAME.finditer(text):
            if _person(text, *m.span()):
                yield m.span()
        for m in HAN_AFTER.finditer(text):
            yield m.span()
        for m in HAN_LABEL.finditer(text):
            yield m.span(1)


def _names(text: str) -> Iterator[tuple[int, int]]:
    for m in GIVEN_WORD.finditer(text):
        a, b = m.span()
        if a and (text[a - 1].isalnum() or text[a - 1] in "_@.'’-"):
            continue
        after = SURNAME.match(text, b)
        if after and after.group(1) not in NOT_NAMES:
            yield a, after.end()
            continue
        head = _before(REVERSED, text, a)
        if head and head.group(1).capitalize() not in NOT_NAMES:
            initial = INITIAL_AFTER.match(text, b)
            yield head.start(), initial.end() if initial else b
    for m in INITIAL_WORD.finditer(text):
        a, b = m.span()
        if a and (text[a - 1].isalnum() or text[a - 1] in "_@.'’-"):
            continue
        after = INITIAL_NAME.match(text, b)
        if after and after.group(1) not in NOT_NAMES:
            b = after.end()
        else:
            head = _before(REVERSED, text, a)
            if not head or head.group(1).capitalize() in NOT_NAMES:
                continue
            a = head.start()
        if _line_alone(text, a, b) or _before(BEFORE, text, a) or FOLLOW.match(text, b):
            yield a, b
    for m in PHRASE.finditer(text):
        if (c := _before(CUED, text, m.start())) and c["first"] not in NOT_NAMES and c["last"] not in NOT_NAMES:
            yield c.span("name")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("@")
    while at >= 0:
        a = at
        while a > 0 and text[a - 1] in LOCAL:
            a -= 1
        while a < at and text[a] in ".%+-":
            a += 1
        m = DOMAIN.match(text, at + 1)
        if a < at and m and not MACHINES.fullmatch(text[a:at]):
            b = m.end()
            repository = text[b : b + 1] == ":" and text[b + 1 : b + 2].strip() or text[max(0, a - 3) : a] == "://"
            if not repository and not (a and text[a - 1] in "@/"):
                yield a, b
        at = text.find("@", at + 1)
    if any(x in text for x in SPELT_SIGNS):
        for m in SPELT.finditer(text):
            if not MACHINES.fullmatch(re.split(r"[\s(\[{<]", m.group())[0]):
                yield m.span()


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in STREET_WORD.finditer(text):
        if head := _before(STREET_BEFORE, text, m.start()):
            yield head.start(), m.end()
    for m in RUE_WORD.finditer(text):
        if (head := _before(RUE_BEFORE, text, m.start(1), 20)) and (tail := RUE_AFTER.match(text, m.end())):
            yield head.start(), tail.end()
    for m in GASSE_WORD.finditer(text):
        if head := _before(GASSE_BEFORE, text, m.start(), 40):
            yield head.start(), m.end()
    for m in CALLE.finditer(text):
        if not (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_")):
            yield m.span()


def find(text: str, learned: frozenset = frozenset()) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each piece of personal data, in order, without overlaps. learned: further given names."""
    found: list[tuple[int, int, str]] = []  # in order

    def add(kind: str, spans: Iterator[tuple[int, int]]) -> None:
        for a, b in spans:
            i = bisect.bisect_left(found, (a,))
            if (not i or found[i - 1][1] <= a) and (i == len(found) or b <= found[i][0]):
                found.insert(i, (a, b, kind))

    add("email", _emails(text))
    low = text.lower()
    if any(x in low for x in LABEL_SIGNS) or any(x in text for x in LABEL_CAPITALS):
        add("idnum", (m.span(1) for m in IDNUM.finditer(text) if sum(ch.isdigit() for ch in m.group(1)) >= 6))
    add("idnum", (m.span() for m in BARE_ID.finditer(text)))
    add("phone", (m.span() for m in PHONE.finditer(text) if 8 <= sum(ch.isdigit() for ch in m.group()) <= 15))
    add("address", sorted(_addresses(text), key=lambda x: (x[0], -x[1])))
    add("name", _general_names(text, learned))
    add("name", _names(text))
    return [(kind, a, b) for a, b, kind in found]


# --- given names from the corpus


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, first, large, small): texts in which a word begins a name told by context, is written large, is written small."""
    for batch in batches:
        first, large, small = Counter(), Counter(), Counter()
        for text in batch.column(0).to_pylist():
            words = {w.strip(MARKS) for w in set(text.split())}
            words = {w for w in words if w.isalpha()}
            large.update(w for w in words if w[0].isupper())
            small.update(w.capitalize() for w in words if w.islower())
            first.update({w for _, _, w, told in full_names(text) if told})
        words = sorted(large)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in (first, large, small))], ["word", "first", "large", "small"])


#: What may stand around a word of running text; words inside addresses and identifiers do not count.
MARKS = ",;:.!?()[]<>\"'"
#: The share of all names told by context that a learned word begins at least, so that there are at most 2^20 of them.
LEAST_OF_ALL = 2.0**-20


def given_names(texts: DataFrame, text: str) -> frozenset:
    """Words that begin names in the corpus (see LEAST_SEEN), counted over all texts. At most 1 / LEAST_OF_ALL, whatever the input, so they may go to the driver and the tasks."""
    rows = spread(texts.select(F.col(text).alias("text")).filter("text is not null"))
    counts = rows.mapInArrow(_word_counts, "word string, first bigint, large bigint, small bigint").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("first", "large", "small")))
    kept = counts.filter((F.col("first") >= LEAST_SEEN) & (F.col("first") >= LEAST_SHARE * F.col("large")) & (F.col("small") <= MOST_SMALL * F.col("large")))
    kept = written(kept, "given_names")
    total = kept.agg(F.sum("first")).first()[0] or 0
    return frozenset(r["word"] for r in kept.filter(F.col("first") >= LEAST_OF_ALL * total).select("word").collect())


# --- replacement


def digest(key: bytes, *parts: str) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(parts).encode("utf-8", "surrogatepass"), hashlib.sha256).digest()[:16])


def permuted(key: bytes, kind: str, digits: str) -> str:
    """A keyed permutation of the digit strings of one length: a Feistel network of ten rounds."""
    half = len(digits) // 2
    if not half:
        return str((int(digits) + digest(key, kind)) % 10) if digits else ""
    a, b = digits[:half], digits[half:]
    for r in range(10):
        mask = digest(key, kind, str(len(digits)), str(r), b) % 10 ** len(a)
        a, b = b, str((int(a) + mask) % 10 ** len(a)).zfill(len(a))
    return a + b


def canonical(kind: str, piece: str) -> str:
    """What names the entity, whatever its notation."""
    flat = re.sub(r"[\s>|]+", " ", piece).strip()
    if kind == "name":
        if "," in flat:
            last, first = (x.strip() for x in flat.split(",", 1))
            flat = f"{first} {last}"
        return flat.casefold()
    if kind == "email":
        flat = re.sub(r"\s*(?:[(\[{<](?:at|a|ät)[)\]}>]|@)\s*|\s+at\s+", "@", flat, count=1, flags=re.IGNORECASE)
        return re.sub(r"\s*[(\[{]dot[)\]}]\s*|\s+dot\s+", ".", flat, flags=re.IGNORECASE).casefold()
    if kind in ("phone", "idnum"):
        return "".join(ch for ch in flat if ch.isalnum()).casefold()
    return flat.casefold()


SYLLABLES = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
#: Syllables and given names by script (female, male); a script without its own gets Latin ones.
CYRILLIC = [a + b for a in "бвгдзклмнпрст" for b in "аеиоу"]
GREEK = [a + b for a in "βγδζκλμνπρστφ" for b in "αειου"]
SCRIPTS = {
    "latin": (SYLLABLES, FEMALE, MALE),
    "cyrillic": (CYRILLIC, "Анна Вера Дарья Елена Ирина Лидия Мария Нина Ольга София".split(), "Антон Борис Виктор Глеб Денис Егор Игорь Кирилл Максим Павел".split()),
    "greek": (GREEK, "Άννα Ελένη Μαρία Σοφία Χρύσα".split(), "Νίκος Πέτρος Γιώργος Σπύρος Ανδρέας".split()),
}


def word(n: int, syllables: int, of: list[str] = SYLLABLES) -> str:
    out = ""
    for _ in range(syllables):
        n, r = divmod(n, len(of))
        out += of[r]
    return out.capitalize()


def script(piece: str) -> str:
    c = next((c for c in piece if c.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "han" if "一" <= c <= "鿿" else "hangul" if "가" <= c <= "힣" else "latin"


def like(model: str, new: str) -> str:
    return new.upper() if model.isupper() and len(model) > 2 else new.lower() if model.islower() else new


def _name(n: int, piece: str) -> str:
    """A name in the script, order and gender of the original; initials stay initials. n: 120 bits."""
    kind = script(piece)
    if kind in ("han", "hangul"):
        first, base, size = (HAN_SURNAMES, 0x4E00, 0x9FA5 - 0x4E00) if kind == "han" else (HANGUL_SURNAMES, 0xAC00, 11172)
        n, r = divmod(n, len(first))
        return first[r] + "".join(chr(base + n // size**k % size) for k in range(max(len(piece) - 1, 2)))
    syllables, female, male = SCRIPTS[kind]
    flat = re.sub(r"[\s>|]+", " ", piece).strip()
    turned = "," in flat
    last, first = (x.strip() for x in flat.split(",", 1)) if turned else (flat.rsplit(" ", 1)[::-1] if " " in flat else (flat, ""))
    heads = first.split()
    given = heads[0] if heads else ""
    known = {w.casefold() for w in female}, {w.casefold() for w in male}
    pool = female if given.casefold() in known[0] else male if given.casefold() in known[1] else sorted({*female, *male})
    n, r = divmod(n, len(pool))
    shown = [like(given, pool[r] if len(given.rstrip(".")) > 1 else pool[r][0] + ".")] if heads else []
    for x in heads[1:]:
        n, r = divmod(n, len(pool))
        shown.append(pool[r][0] + "." if x.endswith(".") else x if re.fullmatch(PARTICLE, x) else pool[r])
    family = like(last, word(n, 6, syllables))
    if kind == "cyrillic":
        family += "ова" if last.endswith(("а", "ая")) else "ов"
    return f"{family}, {' '.join(shown)}" if turned else " ".join([*shown, family])


def surrogate(key: bytes, kind: str, piece: str, salt: int = 0) -> str:
    """The replacement of a piece, in its format; another salt gives another one."""
    name = canonical(kind, piece)
    n = digest(key, kind, name, str(salt))
    if kind in ("phone", "idnum"):
        old = [ch for ch in piece if ch.isdigit()]
        new = iter(permuted(key if not salt else key + str(salt).encode(), kind, "".join(old)))
        letters = iter(word(n, 8).upper() * 3)
        return "".join(next(new) if ch.isdigit() else like(ch, next(letters)) if ch.isalpha() else ch for ch in piece)
    if kind == "email":
        m = re.match(rf"[\w.+%-]+?(?={S}?(?:@|[(\[{{<]))|[\w.+%-]+", piece)
        rest = piece[m.end() :]
        at = re.match(rf"(?:{S}?(?:@|[(\[{{<]\w+[)\]}}>]){S}?|{S}(?:at|AT){S})", rest)
        return like(m.group(), word(n, 10).lower()) + (at.group() if at else "@") + like(rest, "example.org")
    if kind == "address":
        old = re.findall(r"\d+", piece)
        street = word(n >> 16, 8)
        m = re.search(rf"(?:{NAME_PART}{S})+?(?={STREETS})", piece)
        if m:
            out = piece[: m.start()] + street + " " + piece[m.end() :]
        else:
            m = re.search(r"(\w+?)(straße|strasse|str\.|gasse|weg|platz|allee|ring|damm|ufer|steig|graben|markt)", piece)
            if m:
                out = piece[: m.start()] + street + m.group(2) + piece[m.end() :]
            else:
                last = list(re.finditer(NAME_PART, piece))[-1]
                out = piece[: last.start()] + street + piece[last.end() :]
        return re.sub(r"\d+", lambda m: permuted(key, "number", m.group()) if len(m.group()) > 1 else m.group(), out, count=len(old))
    return _name(n, piece)


def replace(text: str, key: bytes, mode: str = "placeholder", salts: dict[int, int] | None = None, learned: frozenset = frozenset()) -> str:
    """The text with every piece replaced: [KIND:tag] with a keyed tag of 80 bits, or the surrogate itself. salts: by the piece's start."""
    out, last, salts = [], 0, salts or {}
    for kind, a, b in find(text, learned):
        piece = text[a:b]
        new = f"[{kind.upper()}:{digest(key, kind, canonical(kind, piece)) >> 48:020x}]" if mode == "placeholder" else surrogate(key, kind, piece, salts.get(a, 0))
        out += [text[last:a], new]
        last = b
    return "".join([*out, text[last:]])


def _find_all(learned):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, starts, ends, pieces = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for kind, a, b in find(text, learned.value):
                    at.append(i)
                    kinds.append(kind)
                    starts.append(a)
                    ends.append(b)
                    pieces.append(text[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(pieces, pa.string())], ["id", "kind", "start_at", "end_at", "piece"])

    return run


def personal_data(texts: DataFrame, key: str, text: str, learned: frozenset | None = None) -> DataFrame:
    """(id, kind, start_at, end_at, piece) of each place; code points from 0, the end excluded.

    Null texts have none; a null key is kept, repeated rows come repeatedly; other columns are not read. Given names beyond the
    fixed list are those of given_names(), made in a pass of its own over all texts unless they are passed in.
    """
    learned = given_names(texts, text) if learned is None else learned
    rows = texts.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("text is not null")
    held = texts.sparkSession.sparkContext.broadcast(learned)
    return spread(rows).mapInArrow(_find_all(held), f"id {texts.schema[key].dataType.simpleString()}, kind string, start_at int, end_at int, piece string")


def _canonicals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, pieces = batch.column(1).to_pylist(), batch.column(3).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array([canonical(k, p) for k, p in zip(kinds, pieces)], pa.string())], ["id", "kind", "start_at", "piece", "name"])


def _shown(secret: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, names, pieces, salts = (batch.column(c).to_pylist() for c in range(4))
            shown = [canonical(k, surrogate(secret, k, p, s)) for k, p, s in zip(kinds, pieces, salts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shown, pa.string())], ["kind", "name", "piece", "salt", "shown"])

    return run


def surrogates(entities: DataFrame, secret: bytes) -> DataFrame:
    """(kind, name, piece, salt, shown) of distinct entities (kind, name, one piece): salts so that no two entities of a kind share a surrogate, and none is a real entity.

    All but the first entity of each clash get the next salt, until there are none. The clashing are found by aggregates and
    joins, however many there are, and each round redraws only those.
    """
    kinds = "kind string, name string, piece string, salt int, shown string"
    drawn = written(entities.select("kind", "name", "piece", F.lit(0).alias("salt")).mapInArrow(_shown(secret), kinds), "drawn")
    while True:
        first = drawn.groupBy("kind", "shown").agg(F.min("name").alias("first"), F.count(F.lit(1)).alias("n"))
        real = drawn.select("kind", F.col("name").alias("shown"), F.lit(True).alias("real"))
        # few surrogates clash, so what joins back is small
        taken = first.join(real, ["kind", "shown"], "left").filter("n > 1 or real").select("kind", "shown", "first", "real")
        clash = drawn.join(taken, ["kind", "shown"]).filter("real or name > first").select("kind", "name", "piece", (F.col("salt") + 1).alias("salt"))
        again = written(clash.mapInArrow(_shown(secret), kinds), "drawn_again")
        if again.isEmpty():
            return drawn
        old, drawn = drawn, written(drawn.join(again, ["kind", "name"], "left_anti").unionByName(again), "drawn")
        discard(old)
        discard(again)


def _rewrite(secret: bytes, mode: str, learned):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            salts = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * len(texts)
            new = [None if t is None else replace(t, secret, mode, {x["start_at"]: x["salt"] for x in s or ()}, learned.value) for t, s in zip(texts, salts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], ["id", "text"])

    return run


def entities_of(texts: DataFrame, text: str, learned: frozenset) -> DataFrame:
    """(digest, kind, start_at, piece, name) of each place of each distinct text; digest names the text, name the entity."""
    rows = texts.select(F.sha2(F.col(text).cast("binary"), 256).alias("digest"), F.col(text).alias("text")).filter("text is not null").dropDuplicates(["digest"])
    found = personal_data(rows, "digest", "text", learned).select("id", "kind", "start_at", "piece")
    return found.mapInArrow(_canonicals, "id string, kind string, start_at int, piece string, name string").withColumnRenamed("id", "digest")


def pseudonymised(texts: DataFrame, key: str, text: str, secret: bytes, mode: str = "surrogate", learned: frozenset | None = None) -> DataFrame:
    """(id, text) of each row with its personal data replaced; mode placeholder gives [KIND:tag], surrogate keyed look-alikes.

    Null texts stay null, texts without personal data stay as they are; a null key is kept, repeated rows come repeatedly. Tags are
    80 bits of a keyed hash, so n entities share one with probability n^2 / 2^81. Surrogates of different entities are
    distinct and no real entities, see surrogates(); the few with a salt join back to the texts that hold them.
    """
    learned = given_names(texts, text) if learned is None else learned
    held = texts.sparkSession.sparkContext.broadcast(learned)
    rows = texts.select(F.col(key).alias("id"), F.col(text).alias("text"))
    schema = f"id {texts.schema[key].dataType.simpleString()}, text string"
    if mode == "placeholder":
        return spread(rows).mapInArrow(_rewrite(secret, mode, held), schema)
    places = written(entities_of(texts, text, learned), "places")
    drawn = surrogates(places.groupBy("kind", "name").agg(F.min("piece").alias("piece")), secret)
    salted = places.join(drawn.filter("salt > 0").select("kind", "name", "salt"), ["kind", "name"]).groupBy("digest").agg(F.collect_list(F.struct("start_at", "salt")).alias("salts"))
    keyed = spread(rows).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    return keyed.join(salted, "digest", "left").select("id", "text", "salts").mapInArrow(_rewrite(secret, mode, held), schema)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, kind, start_at of each piece of personal data."""
    found = personal_data(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text")
    return found.filter("id is not null").select(F.col("id").alias("doc_id"), "kind", "start_at").distinct()


def _hashed(out: DataFrame) -> DataFrame:
    return out.select(F.col("id").alias("doc_id"), F.length("text").cast("bigint").alias("n_chars"), F.sha1(F.col("text").cast("binary")).alias("text_hash"))


def p10_replaced(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, n_chars, text_hash: each document with typed placeholders, its text given by length and SHA-1."""
    return _hashed(pseudonymised(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text", b"demonstration key", "placeholder"))


def p10_surrogates(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, n_chars, text_hash: each document with surrogates, its text given by length and SHA-1."""
    return _hashed(pseudonymised(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text", b"demonstration key", "surrogate"))


def p10_distinctness(spark: SparkSession, d: str) -> DataFrame:
    """kind, any, distinct, coreferent, unreal: for each kind, whether there are entities, as many surrogates, one for each entity, and none of them real."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    places = written(entities_of(docs, "text", given_names(docs, "text")), "places")
    drawn = surrogates(places.groupBy("kind", "name").agg(F.min("piece").alias("piece")), b"demonstration key")
    # the surrogates as they come out in each notation of an entity, not only in the one they were drawn for
    every = places.select("kind", "name", "piece").distinct().join(drawn.select("kind", "name", "salt"), ["kind", "name"]).select("kind", "name", "piece", "salt").mapInArrow(_shown(b"demonstration key"), "kind string, name string, piece string, salt int, shown string")
    real = drawn.select("kind", F.col("name").alias("shown"), F.lit(1).alias("real"))
    by = every.select("kind", "name", "shown").distinct().join(real, ["kind", "shown"], "left")
    n = by.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("names"), F.countDistinct("shown").alias("shown"), F.count("real").alias("real"))
    return n.select("kind", (F.col("names") > 0).alias("any"), (F.col("shown") == F.col("n")).alias("distinct"), (F.col("names") == F.col("n")).alias("coreferent"), (F.col("real") == 0).alias("unreal"))


QUERIES = {"p10_found": p10_found, "p10_replaced": p10_replaced, "p10_surrogates": p10_surrogates, "p10_distinctness": p10_distinctness}
SQL = {"p10_distinctness": "SELECT kind, true AS \"any\", true AS \"distinct\", true AS coreferent, true AS unreal FROM (VALUES ('address'), ('email'), ('idnum'), ('name'), ('phone')) AS k(kind)"}
